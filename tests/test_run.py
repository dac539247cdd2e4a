"""Whole runs, the read store and the table function."""

import io
import random

import pytest

from quillon.functions import table
from quillon.operators import align, reads
from quillon.operators.reads import usable
from quillon.plans import run
from quillon.plans.config import AlignConfig
from quillon.sources import sequences

CONFIG = AlignConfig(seed_length=16)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, d = random.Random(5), tmp_path_factory.mktemp("run")
    ref = "".join(rng.choice("ACGT") for _ in range(400))
    (d / "t.fa").write_text(f">chr\n{ref}\n")
    own = [ref[10:40], ref[100:131], ref[200:210] + "N" + ref[211:230], "ACGT", ref[300:326] + ref[328:350]]
    (d / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(own)))
    return str(d / "t.fa"), str(d / "r.fq"), [f"r{i}" for i in range(5)], own


def test_store_round_trip_and_pruning(spark, files, tmp_path):
    """What was written comes back, and files of reads that cannot be aligned are not read."""
    rd = sequences.read_reads(spark, files[1], "fastq")
    sequences.write_reads(rd, str(tmp_path / "s"))
    back = sequences.read_bucketed(spark, str(tmp_path / "s"))
    key = lambda df: sorted((r.read_ord, r.read_id, r.raw, r.plus, r.quality_raw, r.seq, r.len, r.has_n) for r in df.collect())
    assert key(back) == key(rd) and len(key(rd)) == 5
    good = usable(back, 16).select("read_ord")
    plan = good._jdf.queryExecution().executedPlan()
    assert good.count() == 3 and "PartitionFilters: [" in plan.toString() and "has_n" in plan.toString().split("PartitionFilters: [")[1].split("]")[0]
    scans = [plan]
    plan.execute().count()
    while scans:
        node = scans.pop()
        if node.metrics().contains("numFiles"):
            assert node.metrics().apply("numFiles").value() == 3  # of 5 partitions
        kids = node.children()
        scans += [kids.apply(i) for i in range(kids.length())]


def test_run_from_standard_input(spark, files, tmp_path, monkeypatch):
    """The same report as from the file; counts; gapped places of what has no hit; unknown options are told."""
    shifted = "".join(chr(ord(c) + 31) if k % 4 == 3 and c != "\n" else c for k, line in enumerate(open(files[1])) for c in line)  # offset 64
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO(shifted.encode())})())
    piped = run.align_files(spark, files[0], "-", CONFIG.with_(gapped=True))
    plain = run.align_files(spark, files[0], files[1], CONFIG.with_(quality_offset=33))
    assert list(map(tuple, piped.report.collect())) == list(map(tuple, plain.report.collect())) and plain.gapped is None
    assert piped.counts == {"reads": 5, "matched": 2, "unique": 2}
    assert [(r.read_ord, r.gap, r.gap_in, r.pos) for r in piped.gapped.collect()] == [(4, 2, "read", 300)]
    assert run.align_files(spark, files[0], files[1], CONFIG.with_(quality_offset=33, unique=False)).counts == {"reads": 5, "hits": 2}


def test_command(spark, files, tmp_path, capsys):
    run.main(["-t", files[0], "-p", files[1], "-o", str(tmp_path / "o"), "-l", "16", "-Q", "33", "-f", "0.5", "-x", "1"])
    err = capsys.readouterr().err
    assert "reads: 5 matched: 2 unique: 2" in err and "-x" in err
    assert spark.read.text(str(tmp_path / "o")).count() == 2
    with pytest.raises(ValueError):
        run.main(["-t", files[0], "-p", files[1], "-o", str(tmp_path / "p"), "-T", "0"])


def test_table_function(spark):
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(300)) + "ACGT" * 12
    frag = spark.createDataFrame([(0, 7, ref, len(ref))], "file_ord int, frag_ord long, seq string, len int")
    flip = str.maketrans("ACGT", "TGCA")
    own = [ref[i * 9 : i * 9 + 28] for i in range(30)] + ["ACGT" * 6]
    rd = reads.prepare(spark.createDataFrame([(i, s if i % 2 else s[::-1].translate(flip)) for i, s in enumerate(own)], "read_ord long, raw string"))
    for s in (0, 2):
        config = CONFIG.with_(seed_mismatches=s)
        table.register(spark, frag, rd, config, "met")
        rows = spark.sql(f"SELECT * FROM align_hits(TABLE(met) PARTITION BY (pair_idx, key) ORDER BY side, seed_length => 16, seed_mismatches => {s}, total_mismatches => 5)").collect()
        assert sorted((r.read_ord, r.strand, r.pos, r.k) for r in rows) == sorted((r.read_ord, r.strand, r.pos, r.k) for r in align.seed_matches(frag, rd, config).collect())
