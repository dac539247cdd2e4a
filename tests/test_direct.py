import itertools
import random

import pytest

from quillon import catalog
from quillon.operators import align, choose, direct, reads
from quillon.plans.config import AlignConfig

FLIP = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def pair(spark):
    """Fragments with a line in common and repeats, and reads of many lengths from them."""
    rng = random.Random(11)
    line, some = "".join(rng.choice("ACGT") for _ in range(90)), lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = [some(70) + line + some(50), line, some(5000) + line + "ACGT" * 30 + "N" + line, "ACGT" * 40, some(20)]
    patterns = []
    for i in range(60):
        t = rng.choice([line, "ACGT" * 20, texts[0], texts[2][4500:]])
        p = list(t[(j := rng.randrange(len(t) - 12)) : j + rng.randrange(10, 80)])
        for _ in range(i % 5):
            p[rng.randrange(len(p))] = rng.choice("ACGTN" if i % 11 == 0 else "ACGT")
        patterns.append("".join(p) if i % 2 else "".join(p)[::-1].translate(FLIP))
    frag = spark.createDataFrame([(i % 2, i, str(i), t, len(t)) for i, t in enumerate(texts)], "file_ord int, frag_ord long, ref_id string, seq string, len int")
    rows = [(i, f"r{i}", p, [(i * 7 + j * 3) % 41 for j in range(len(p))]) for i, p in enumerate(patterns)]
    return frag, reads.prepare(spark.createDataFrame(rows, "read_ord long, read_id string, raw string, qual array<int>"))


@pytest.mark.parametrize("s, n", [*itertools.product((0, 1, 2), (12, 32)), (2, 64)])
def test_hits_in_tasks_are_those_of_the_join(spark, pair, monkeypatch, s, n):
    monkeypatch.setattr(direct, "CHUNK", 7)  # parts are cut within a window's meetings
    c = AlignConfig(seed_mismatches=s, seed_length=n)
    want = align.with_score(align.seed_matches(*pair, c), c, True).select("read_ord", "strand", "file_ord", "frag_ord", "pos", "k", "score").collect()
    got = align.distinct_hits(*pair, c, True, True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and (want or n == 64)
    assert "Exchange hashpartitioning(read_ord" not in got._jdf.queryExecution().executedPlan().toString()


def test_reads_beyond_the_broadcast_take_the_join(spark, pair, monkeypatch):
    c = AlignConfig(seed_length=12)
    want = sorted(map(tuple, align.distinct_hits(*pair, c, False, True).collect()))
    monkeypatch.setattr(direct, "MOST_BYTES", 100)
    met = align.distinct_hits(*pair, c, False, True).select("read_ord", "strand", "file_ord", "frag_ord", "pos", "k")
    assert sorted(map(tuple, met.collect())) == want


@pytest.mark.parametrize("name", ["align_all", "align_all_scored", "align_masked_text"])
def test_hits_are_not_shuffled(spark, name):
    """Hits grow as the square of a text with common lines; no exchange may stand above the search."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above


def test_counts_are_those_of_the_hits(spark, pair):
    c = AlignConfig(seed_length=12)
    hits = align.distinct_hits(*pair, c, once=True).groupBy("read_ord").agg({"k": "min", "*": "count"}).select("read_ord", "count(1)", "min(k)")
    assert sorted(map(tuple, align.hit_counts(*pair, c, True).collect())) == sorted(map(tuple, hits.collect()))


@pytest.mark.parametrize("level", [0, 2])
def test_best_hits_tell_the_unique_ones(spark, pair, monkeypatch, level):
    """Two hits a task and read give what all hits give, also if they come in many parts."""
    c = AlignConfig(seed_length=12, filter_level=level)
    met = align.with_score(align.seed_matches(*pair, c), c, True).persist()
    monkeypatch.setattr(direct, "CHUNK", 5)
    rows = lambda df: sorted(map(tuple, df.select("read_ord", "strand", "file_ord", "frag_ord", "pos", "k").collect()))
    found, scored = align.telling_hits(*pair, c), align.telling_hits(*pair, c, True)
    assert 0 < found.groupBy("read_ord").count().agg({"count": "max"}).first()[0] <= 2 * found.rdd.getNumPartitions()
    assert rows(choose.unique_by_errors(found)) == rows(choose.unique_by_errors(met))
    want = choose.unique_by_score(met, c)
    assert rows(choose.unique_by_score(scored, c)) == rows(want)
    score = lambda df: {r.read_ord: r.score for r in df.collect()}
    assert score(choose.unique_by_score(scored, c)) == score(want)


def test_events_kept_tell_the_fold(spark, pair, monkeypatch):
    """Events that a task drops change no outcome, however its runs are cut; and the fold of random runs agrees with that of what is kept."""
    import numpy as np

    c = AlignConfig(seed_length=12)
    rows = lambda df: sorted(map(tuple, df.select("read_ord", "strand", "file_ord", "frag_ord", "pos", "k", "score").collect()))
    want = rows(choose.unique_by_fold(align.events(align.with_score(align.seed_matches(*pair, c), c, True)), c))
    monkeypatch.setattr(direct, "CHUNK", 5)
    monkeypatch.setattr(direct, "MOST_EVENTS", 3)
    assert rows(choose.unique_by_fold(align.telling_events(*pair, c), c)) == want and want

    def fold(scores, places, eps):
        best, where, alone = None, None, True
        for v, p in zip(scores, places):
            if best is None or v > best + eps:
                best, where, alone = v, p, True
            elif v > best - eps and p != where:
                alone = False
        return best, where, alone

    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 12)
        score, place = np.array([rng.randrange(8) / 2 for _ in range(n)]), np.array([rng.randrange(4) for _ in range(n)])
        kept = direct.telling(np.zeros(n, int), score, place[None])
        for entering in (None, (rng.randrange(8) / 2, rng.randrange(4))):
            head = [entering] if entering else []
            run = lambda own: fold([*[x[0] for x in head], *score[own]], [*[x[1] for x in head], *place[own]], 1.0)
            assert run(kept) == run(np.arange(n))


def test_hits_are_ranked_after_one_exchange(spark):
    plan = catalog.QUERIES["align_all_ranked"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("MapInArrow")].count("Exchange") == 1


def test_gapped_search_reads_its_reads_from_a_table(spark):
    """The reads without a hit are found once, not in each of the search's four passes over them."""
    assert "LeftAnti" not in catalog.QUERIES["align_gapped"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
