"""Readers against serial parsers, whatever the blocks that files are cut into."""

import random
import re

import pytest

from quillon.operators import align, reads
from quillon.operators.seeds import Pieces
from quillon.operators.text import pieces
from quillon.plans.config import AlignConfig
from quillon.sources import sequences
from quillon.sources.records import MACHINES, OUT, passed_through

SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def serial_fasta(text):
    found, at = [], text.find(">")
    while at >= 0:
        end = text.find("\n", at)
        if end < 0:
            break
        nxt = text.find(">", end)
        found.append((text[at + 1 : end], SPACE.sub("", text[end : nxt if nxt >= 0 else len(text)]), None, None))
        at = nxt
    return found


def serial_fastq(text):
    found, at = [], text.find("@")
    while at >= 0:
        end = text.find("\n", at)
        plus = text.find("+", end) if end >= 0 else -1
        line = text.find("\n", plus) if plus >= 0 else -1
        if line < 0:
            break
        seq, got, i = SPACE.sub("", text[end:plus]), "", line
        while len(got) < len(seq) and i < len(text):
            got, i = got + SPACE.sub("", text[i]), i + 1
        if len(got) < len(seq):
            break
        found.append((text[at + 1 : end], seq, text[plus + 1 : line], got))
        at = text.find("@", i)
    return found


def serial_text(text):
    """(name, bases) of reference fragments, character by character."""
    found, name, inside = [], None, False
    for c in text:
        if c == ">":
            name, inside = "", True
        elif inside:
            if c == "\n":
                found.append([name, ""])
                inside = False
            else:
                name += c
        elif found and c in "ACGTN":
            found[-1][1] += c
    return [(n, b) for n, b in found if b]


SERIAL = {"fasta": serial_fasta, "fastq": serial_fastq}


@pytest.fixture
def tiny_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_machines_at_any_cut(kind):
    """Blocks of whole lines cut anywhere, composed in order, give the serial parser's records."""
    rng, alphabet = random.Random(kind), ">ACG \n" if kind == "fasta" else "@+ACI \n\n"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        lines, ended = text.split("\n"), text.endswith("\n")
        lines = lines[:-1] if ended else lines
        cuts = sorted(rng.sample(range(1, len(lines)), min(len(lines) - 1, rng.randrange(4)))) if len(lines) > 1 else []
        state, records, parts = (OUT, 0, -1, -1), [], {}
        for block, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
            m = MACHINES[kind](block, state)
            for k in range(i, j):
                m.line(lines[k], ended or k < len(lines) - 1)
            m.close()
            told = passed_through(state, m.seen, m.opens, m.turns)
            assert told is None or told[0] == m.kind and told[2:] == m.state[2:] and (kind == "fasta" or told == m.state)
            state = m.state
            records += [((block, no), *rest) for no, *rest in m.done]
            for origin, no, *rest in m.parts:
                parts.setdefault((origin, no), []).append(rest)
        for key, got in parts.items():
            if kind == "fasta" or got[-1][-1]:
                first = lambda k: next((g[k] for g in got if g[k] is not None), None)
                records.append((key, first(0), "".join(g[1] for g in got), first(2), "".join(g[3] for g in got)))
        got = [(i, s, p, q if kind == "fastq" else None) for _, i, s, p, q in sorted(records)]
        assert got == SERIAL[kind](text), text


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
@pytest.mark.parametrize("size", [60, 100_000])
def test_reads_of_files_in_blocks(spark, tmp_path, tiny_blocks, kind, size):
    rng, texts = random.Random(size), []
    for f in range(2):
        body = ""
        for i in range(5):
            seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 20, 90])))
            wrapped = "\n".join(seq[k : k + 17] for k in range(0, len(seq), 17)) if i % 2 else seq
            qual = "".join(rng.choice("@+I5>") for _ in seq)
            body += f">f{f}r{i}\n{wrapped}\n" if kind == "fasta" else f"@f{f}r{i}\n{wrapped}\n+x{i}\n{qual[:5]}\n{qual[5:]}\n"
        texts.append(body if f else body + {"fasta": ">cut", "fastq": "@cut\nACGT\n+\nII"}[kind])
        (tmp_path / f"{f}.txt").write_text(texts[-1])
    tiny_blocks(size)
    rows = sequences.read_reads(spark, str(tmp_path), kind).orderBy("read_ord").collect()
    want = [r for t in texts for r in SERIAL[kind](t)]
    assert [(r.read_id, r.raw, r.plus, r.quality_raw) for r in rows] == want and [r.read_ord for r in rows] == list(range(len(want)))


@pytest.mark.parametrize("size", [40, 100_000])
def test_pieces_of_files_in_blocks(spark, tmp_path, tiny_blocks, size):
    """Quirks of headers, empty fragments, fragments over many blocks; pieces are those of the whole sequences."""
    rng = random.Random(size)
    bodies = ["junk\nACG\n>a>b\nACgtRYNAC\n>\n>empty\nacgt\n>c x\r\nAC\r\nGT>d\nGGG\n", "nothing\n", ">e\n" + "\n".join("".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 9))) for _ in range(60)) + "\n>f\n\n\nT\n>g", ">h\nACGT"]
    for i, b in enumerate(bodies):
        (tmp_path / f"{i}.fa").write_bytes(b.encode())
    tiny_blocks(size)
    found, names = sequences.read_pieces(spark, str(tmp_path), 4, 6, 10)
    want, text = [], []
    for b in bodies:
        if serial_text(b):
            text.append(serial_text(b))
    for f, fragments in enumerate(text):
        want += [(f, i, name, len(bases)) for i, (name, bases) in enumerate(fragments)]
    assert sorted(map(tuple, names.collect())) == want
    frag = spark.createDataFrame([(f, i, b, len(b)) for f, t in enumerate(text) for i, (_, b) in enumerate(t)], "file_ord int, frag_ord long, seq string, len int")
    assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, pieces(frag, 10, 6, 4).collect()))
    back = sequences.read_reference(spark, str(tmp_path)).orderBy("file_ord", "frag_ord").collect()
    assert [(r.ref_id, r.seq) for r in back] == [x for t in text for x in t]


def test_pieces_align_as_fragments(spark, tmp_path, tiny_blocks):
    rng = random.Random(8)
    ref = "".join(rng.choice("ACGT") for _ in range(900))
    (tmp_path / "r.fa").write_text(">x\n" + "\n".join(ref[i : i + 50] for i in range(0, 900, 50)) + "\n")
    rd = reads.prepare(spark.createDataFrame([(i, ref[j : j + 30]) for i, j in enumerate(range(0, 860, 41))], "read_ord long, raw string"))
    config = AlignConfig(seed_length=16)
    tiny_blocks(100)
    found, _ = sequences.read_pieces(spark, str(tmp_path), 20, 40, 64)
    frag = spark.createDataFrame([(0, 0, ref, 900)], "file_ord int, frag_ord long, seq string, len int")
    key = lambda m: sorted((r.read_ord, r.strand, r.pos, r.k) for r in m.collect())
    assert key(align.seed_matches(found, rd, config)) == (want := key(align.seed_matches(frag, rd, config))) and len(want) >= 21
    with pytest.raises(ValueError):
        align.seed_matches(Pieces(found.rows, 64, 20, 20), rd, config)
