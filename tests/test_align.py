import itertools

import pytest

from quillon.functions import scoring
from quillon.operators import align, choose, reads, text
from quillon.plans.config import AlignConfig
from quillon.plans.run import align_files, align_reads
from quillon.sources import sequences

A, B = "ACGTACGTTTGACCATGGCATTACGGATCCAGTTCAAGGCTATTGCACGT", "TTGACCATGGCATTACGGATNCAGTTCAAGG"
READS = ["TTGACCATGGCATTACGGAT", "TTGACCATGGCATTACGGATCCAG", "TGCAATAGCCTTGAACTG", "ACGTACGTTTGACCTTGGCA", "GGCTATTGCACGN", "ACGT"]
SMALL = AlignConfig(seed_length=12)


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fixture")
    (d / "ref.fa").write_text(f">chrA desc\n{A}\n>chrB\n{B}\n")
    (d / "reads.txt").write_text("".join(f">r{i + 1}\n{r}\n" for i, r in enumerate(READS)))
    return str(d / "ref.fa"), str(d / "reads.txt")


def test_all_hits(spark, fixture):
    rows = align_files(spark, *fixture, SMALL.with_(unique=False)).report.collect()
    got = sorted((r.read_id, r.strand, r.ref_id, r.pos, r.errors, round(r.score, 4)) for r in rows)
    assert got == [
        ("r1", "+", "chrA desc", 9, 0, 40.7575), ("r1", "+", "chrB", 1, 0, 40.7575), ("r2", "+", "chrA desc", 9, 0, 49.3266),
        ("r3", "-", "chrA desc", 30, 0, 36.7303), ("r4", "+", "chrA desc", 1, 1, 29.6631),
    ]
    assert next(r.seq for r in rows if r.read_id == "r3") == "CAGTTCAAGGCTATTGCA"


@pytest.mark.parametrize("config, ids", [(SMALL.with_(scored=False), {"r2", "r3", "r4"}), (SMALL.with_(filter_level=0), {"r1", "r2", "r3", "r4"}), (SMALL, {"r2", "r3", "r4"})])
def test_unique(spark, fixture, config, ids):
    assert {r.read_id for r in align_files(spark, *fixture, config).report.collect()} == ids


def test_seeds_are_complete(spark):
    """Every window within the bounds is found, by brute force over both strands."""
    import random

    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(600)) + "N" + "ACGT" * 20
    flip = str.maketrans("ACGT", "TGCA")
    patterns = []
    for i in range(40):
        p = list(ref[(j := rng.randrange(560)) : j + rng.randrange(16, 60)])
        for _ in range(i % 7):
            p[rng.randrange(len(p))] = rng.choice("ACGT")
        patterns.append("".join(p) if i % 2 else "".join(p)[::-1].translate(flip))
    frag = spark.createDataFrame([(0, 0, "x", ref, len(ref))], "file_ord int, frag_ord long, ref_id string, seq string, len int")
    rd = reads.prepare(spark.createDataFrame(list(enumerate(patterns)), "read_ord long, raw string"))
    for s, n in itertools.product((0, 1, 2), (12, 16, 24, 32)):
        c = AlignConfig(seed_mismatches=s, seed_length=n)
        got = {(r.read_ord, r.strand, r.pos) for r in align.all_hits(align.seed_matches(frag, rd, c)).collect()}
        want = set()
        for i, p in enumerate(patterns):
            for strand, w in (("+", p), ("-", p[::-1].translate(flip))):
                for at in range(len(ref) - len(w) + 1):
                    x = ref[at : at + len(w)]
                    d = [a != b for a, b in zip(x, w)]
                    if "N" not in w + x and len(w) >= n and sum(d) <= 5 and sum(d[:n] if strand == "+" else d[-n:]) <= s:
                        want.add((i, strand, at))
        assert got == want and want


@pytest.mark.parametrize("events, state", [([("X", 50), ("Y", 51.5), ("Z", 53), ("Y", 51.5)], None), ([("X", 50), ("Y", 50)], None), ([("X", 50), ("Y", 51.5), ("Z", 53)], "Z")])
def test_fold(spark, events, state):
    rows = [(1, 0, ord(x), 0, "+", i, 0, float(v), 28) for i, (x, v) in enumerate(events)]
    m = spark.createDataFrame(rows, "read_ord long, file_ord int, frag_ord long, pos int, strand string, pair_idx int, k int, score double, len int")
    got = choose.unique_by_fold(m, AlignConfig(filter_level=2)).collect()  # epsilon 28 * 5 / 70 = 2
    assert [chr(r.frag_ord) for r in got] == ([state] if state else [])


def test_scoring_values():
    o, v = scoring.odds(AlignConfig()), scoring.log_odds(AlignConfig())
    want = {
        "A": (3.38242282, 0.001545677, 0.00756849, 0.001074115), "C": (0.004448535, 4.833900157, 0.00640155, 0.021782482),
        "G": (0.021782482, 0.00640155, 4.833900157, 0.004448535), "T": (0.001074115, 0.00756849, 0.001545677, 3.38242282),
    }
    assert {x + y: v for x, row in want.items() for y, v in zip("ACGT", row)} == pytest.approx(o, rel=1e-6)
    assert v["AA"] == pytest.approx(1.758057015) and v["GG"] == pytest.approx(2.273187675)


def test_config():
    c = AlignConfig(seed_mismatches=4, total_mismatches=20, seed_length=35)
    assert (c.seed_mismatches, c.total_mismatches, c.seed_length, AlignConfig(seed_length=70).seed_length, AlignConfig(total_mismatches=-1).total_mismatches) == (2, 15, 32, 64, 15)
    assert [round(AlignConfig(filter_level=k).epsilon(36), 6) for k in range(5)] == [0, 1.285714, 2.571429, 5.142857, 7.714286]
    with pytest.raises(ValueError):
        AlignConfig(seed_length=3)


@pytest.mark.parametrize("body, want", [(">a>b\nACgtRYNAC\n", [("b", "ACNAC")]), (">a\nAC>b\nGT\n", [("a", "AC"), ("b", "GT")]), (">a\r\nAC\r\n", [("a\r", "AC")]), (">a\nAC\n>b", [("a", "AC")])])
def test_reference_quirks(spark, tmp_path, body, want):
    (tmp_path / "x.fa").write_bytes(body.encode())
    rows = sequences.read_reference(spark, str(tmp_path)).orderBy("frag_ord").collect()
    assert [(r.ref_id, r.seq) for r in rows] == want


@pytest.mark.parametrize("body, want", [("junk\n>q1 x\nAC GT\nacgt\n", [("q1 x", "ACGTacgt", None, None)]), ("@a\nAC\nGT\n+p\n@+II\n@b\nA\n+\nI\n@c\nACG\n+\nII", [("a", "ACGT", "p", "@+II"), ("b", "A", "", "I")])])
def test_read_parsers(spark, tmp_path, body, want):
    (tmp_path / "r").write_text(body)
    rows = sequences.read_reads(spark, str(tmp_path / "r"), "fastq" if body[0] == "@" else "fasta").orderBy("read_ord").collect()
    assert [(r.read_id, r.raw, r.plus, r.quality_raw) for r in rows] == want


def test_fold_of_parts(spark, monkeypatch):
    """Summaries of parts, cut anywhere, against a loop over the events in their order."""
    import random

    from quillon.operators import fold

    monkeypatch.setattr(fold, "STRETCH", 3)
    rng, rows, want = random.Random(3), [], {}
    for read in range(150):
        own = sorted({(rng.randrange(2), rng.choice("+-"), rng.randrange(3), rng.randrange(2), rng.randrange(9)) for _ in range(rng.randrange(1, 40))})
        score = {}
        best, alone = None, False
        for file, strand, pair, frag, pos in own:
            s = score.setdefault((file, frag, pos, strand), float(rng.randrange(1, 12)))
            rows.append((read, file, frag, pos, strand, pair, 0, s, 28))
            if best is None or s > best[0] + 2:
                best, alone = (s, file, frag, pos, strand), True
            elif alone and s > best[0] - 2 and (file, frag, pos) != best[1:4]:
                alone = False
        want[read] = (*best, 1 if alone else 2)
    rng.shuffle(rows)
    m = spark.createDataFrame(rows, "read_ord long, file_ord int, frag_ord long, pos int, strand string, pair_idx int, k int, score double, len int")
    got = {r.read_ord: (r.score, r.file_ord, r.frag_ord, r.pos, r.strand, r.loci) for r in fold.states(m, AlignConfig(filter_level=2)).collect()}
    assert got == want and {x[-1] for x in want.values()} == {1, 2}


@pytest.mark.parametrize("quals, offset", [(["DDDD"], 0), (["D*", "h"], 33), (["Dh", "*"], 64)])
def test_quality_offset(spark, quals, offset):
    df = spark.createDataFrame(list(enumerate(quals)), "read_ord long, quality_raw string")
    assert reads.quality_offset(df).first().quality_offset == offset


def test_rewrite_order_and_round_trip(spark, tmp_path):
    rd = reads.prepare(spark.createDataFrame([(0, "A" * 40), (1, "A" * 35 + "N"), (2, "A" * 36)], "read_ord long, raw string"))
    assert [r.read_ord for r in reads.rewrite_order(rd).orderBy("new_ord").collect()] == [2, 1, 0]
    sequences.write_reads(rd, str(tmp_path / "r"))
    assert sequences.read_bucketed(spark, str(tmp_path / "r")).count() == 3


def test_report_file(spark, fixture, tmp_path):
    run = align_files(spark, *fixture, SMALL)
    assert run.counts == {"reads": 6, "matched": 4, "unique": 3}
    sequences.write_report(run.report, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines[0].split("\t") == ["r2", READS[1], "49.3266", "1", "a", "24", "+", "chrA desc", "9", "", "0"]


def test_windows_across_segments(spark):
    seq = "ACGT" * 200
    frag = spark.createDataFrame([(0, 0, "x", seq, len(seq))], "file_ord int, frag_ord long, ref_id string, seq string, len int")
    got = sorted((r.pos, r.seed) for r in text.windows(frag, 16).collect())
    assert got == [(i, seq[i : i + 16]) for i in range(len(seq) - 15)]


def test_stream(spark, tmp_path):
    from quillon.streaming.reads import align_stream

    frag = spark.createDataFrame([(0, 0, "chrA desc", A, len(A))], "file_ord int, frag_ord long, ref_id string, seq string, len int")
    reads.prepare(spark.createDataFrame([(0, "r2", READS[1])], "read_ord long, read_id string, raw string")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = align_stream(frag, src, SMALL, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.pos for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [9]
    assert align_reads(frag, spark.read.parquet(str(tmp_path / "in")), SMALL).count() == 1


def test_linear_pieces(spark):
    """A long fragment is cut in time proportional to its length; pieces and what follows them give the text back."""
    import time

    from pyspark.sql import functions as F

    def run(n):
        frag = spark.range(1).select(F.lit(0).alias("file_ord"), F.col("id").alias("frag_ord"), F.expr(f"repeat('ACGTTGCA', {n // 8})").alias("seq"), F.lit(n).alias("len"))
        began = time.time()
        assert text.pieces(frag, 256, 31).agg(F.sum(F.length("piece")).alias("n")).first().n == n + 31 * (n // 256 - 1)
        return time.time() - began

    run(1 << 16)
    assert run(1 << 22) < 60
    frag = spark.createDataFrame([(0, 1, "ACGTACGTAC", 10)], "file_ord int, frag_ord long, seq string, len int")
    assert [(r.no, r.piece) for r in text.pieces(frag, 4, 6).orderBy("no").collect()] == [(0, "ACGTACGTAC"), (1, "ACGTAC"), (2, "AC")]


def test_reads_of_texts_of_their_own_length(spark):
    from quillon.operators import simulate

    docs = spark.createDataFrame([(1, "a" * 40), (2, "ab" * 150), (3, "")], "doc_id long, text string")
    assert [r.read_ord for r in simulate.reads_of_documents(docs, 40).collect()] == [2]


def test_report_order(spark):
    """Unique hits come by read length, then input order; without rewriting, in input order; all hits keep the order of a read's hits."""
    import random

    rng = random.Random(9)
    ref = "".join(rng.choice("ACGT") for _ in range(400))
    frag = spark.createDataFrame([(0, 0, "x", ref, 400)], "file_ord int, frag_ord long, ref_id string, seq string, len int")
    rd = reads.prepare(spark.createDataFrame([(0, "a", ref[10:50]), (1, "b", ref[60:95] + "N"), (2, "c", ref[100:136])], "read_ord long, read_id string, raw string"))
    order = lambda c: [r.read_id for r in align_reads(frag, rd, c).collect()]
    c = AlignConfig(seed_length=32, scored=False)
    assert order(c) == ["c", "a"] and order(c.with_(rewrite=False)) == ["a", "c"]
    rows = align_reads(frag, rd, c.with_(unique=False)).collect()
    assert [(r.read_id, r.errors, r.pos) for r in rows] == sorted((r.read_id, r.errors, r.pos) for r in rows)


def test_simulated_reads_come_back(spark, tmp_path):
    """Reads with few substitutions are found at their true places, through FASTQ files."""
    from quillon.operators import simulate

    docs = spark.createDataFrame([(i, " ".join(f"{(i * 977 + j * j * 31) % 9973:x}xyzq" + "abcdefghij"[(i + j) % 10] for j in range(90))) for i in range(8)], "doc_id long, text string").selectExpr("*", "'en' as lang")
    frag, rd = text.fragments_of_documents(docs), reads.prepare(simulate.reads_of_documents(docs))
    sequences.write_lines(sequences.fastq_lines(rd), str(tmp_path / "q"))
    back = sequences.read_reads(spark, str(tmp_path / "q"), "fastq")
    assert sorted((r.read_id.split(" ")[0], r.seq) for r in back.collect()) == sorted((r.read_id, r.seq) for r in rd.collect())
    hits = {(r.read_ord, r.pos) for r in align.all_hits(align.seed_matches(frag, rd, AlignConfig(seed_length=24))).collect()}
    easy = [r for r in rd.collect() if r.read_id.count("_") - ("_inv" in r.read_id) <= 2]
    assert easy and all((r.read_ord, r.truth_pos) in hits for r in easy)


def test_no_reference_files(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a\nACGT\n")
    assert sequences.read_reference(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("body", ["ACGT\n", ""])
def test_sniff_refuses(spark, tmp_path, body):
    (tmp_path / "r.txt").write_text(body)
    with pytest.raises(ValueError):
        sequences.sniff(spark, str(tmp_path / "r.txt"))
