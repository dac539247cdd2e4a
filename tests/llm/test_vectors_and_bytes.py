"""Operators 11, 12 and 13."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillon.llm import byte_bpe, hard_negatives, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, n long, at int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if v is None else float(v) for v in e], label, "x", 1, 2) for i, e, label in rows], VECTORS)


def random_rows(n, d, seed, spread=1.0, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(d)], rng.randrange(labels)) for i in range(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [None, 1, 1], 1), (903, [float("nan"), 1, 1], 1), (904, [float("inf"), 1, 1], 1), (905, [1, 2], 1), (906, [3e38, 1, 1], 1)]


# 11. whitening


def whitened(spark, rows):
    good, d = whitening.of_usual_length(whitening.whole_vectors(vectors(spark, rows)))
    model = whitening.fit_whitening(good, d)
    return model, {(r.vec_id, k): (r.deviation, w) for r in whitening.whiten(good, model).collect() for k, w in enumerate(r.whitened)}


def held_against_numpy(rows, model, got):
    x = np.floor(np.array([e for _, e, _ in rows], np.float32).astype(float) * 64).astype(object).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)[: len(model.explained)]
    assert model.n == n and model.sums == s.tolist() and np.allclose(model.explained, value[order] / v.trace(), rtol=1e-9)
    want = ((n * x - s) / n) @ vector[:, order] / np.sqrt(value[order])
    for (i, _, _), d, w in zip(rows, ((n * x - s) ** 2).sum(1), want):
        assert got[i, 0][0] == d
        assert np.allclose(np.abs([got[i, k][1] for k in range(len(order))]), np.abs(w), atol=1e-8)
    assert model.identity_error < 1e-9


def test_whitening_against_numpy(spark):
    rows = random_rows(300, 20, 1)
    model, got = whitened(spark, rows)
    assert len(model.explained) == 16 and len(got) == 300 * 16
    held_against_numpy(rows, model, got)


def test_whitening_fits_distinct_vectors_once(spark):
    rows = random_rows(40, 3, 2)
    hot = rows + [(1000 + i, rows[7][1], 0) for i in range(200)]
    model, got = whitened(spark, hot + ODD)
    assert model.n == 40 and {i for i, _ in got} == {i for i, _, _ in hot}
    held_against_numpy(rows, model, got)
    assert all(got[1000, k] == got[7, k] for k in range(3))


def test_whitening_of_large_entries_is_exact(spark):
    """Sums and deviations beyond 64 bits on the way; a deviation that is no long is null."""
    rows = [(i, [v * 2.0**e for v in (1, -3, i)], 0) for i, e in enumerate((40, 41, 42, 43, 44))]
    model, got = whitened(spark, rows)
    x = [[int(v * 64) + 1_000_000 for v in e] for _, e, _ in rows]
    s = [sum(c) for c in zip(*x)]
    assert model.sums == s
    for i, e in enumerate(x):
        want = sum((5 * a - b) ** 2 for a, b in zip(e, s))
        assert got[i, 0][0] == (want if want < 1 << 63 else None)


def test_whitening_odd(spark):
    flat = [(i, [1.0, 2.0, 3.0], 0) for i in range(5)]
    assert whitened(spark, [])[1] == {} and whitened(spark, ODD[:4])[1] == {} and whitened(spark, flat)[1] == {}
    model, got = whitened(spark, random_rows(3, 5, 3))  # three points lie in a plane
    assert len(model.explained) == 2 and math.isclose(sum(model.explained), 1) and model.identity_error < 1e-9
    assert len(got) == 6
    model, got = whitened(spark, [(None, e, 0) for _, e, _ in random_rows(30, 2, 4)])
    assert set(got) == {(None, 0), (None, 1)}


def test_whitening_query(spark):
    df = whitening.op11_whitening(spark, SF)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = df.collect()
    assert len(rows) == 500 * 16 and {r.component for r in rows} == set(range(1, 17)) and all(r.identity_error < 1e-9 for r in rows)


# 12. byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(byte_bpe.ranks_path())


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


ODD_TEXTS = [
    "", None, " ", "  a  b \n\n c  d   e's it's they'LL 12ab3  \t", "　 x　y   z", "é à là\x1c \x85 z\xa0 b" * 3, "x" * 5000, "漢字 " * 300, "a,b.c;d'se 's 've",
    "\U0001f600\U0001f600 क्ष é", "<|endoftext|> <|", "\r\n\r\n  \r\n", "..." * 400 + "\t\t\tq", "\x00\x01 \x1f\x1f a",
]


def encoded(spark, texts):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, number int")
    return {r.doc_id: r for r in byte_bpe.decode_docs(byte_bpe.encode_docs(docs, byte_bpe.ranks_path()), byte_bpe.ranks_path()).collect()}


def test_bpe_against_library(spark, library, monkeypatch):
    """Ids and bytes of whole texts, in one block and in many, whose words are merged in many goes."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD_TEXTS
    rng = random.Random(1)
    alphabet = "abz AZ\n\t'.,0é　漢́\x1c\x85sdtl"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    for size in (None, 2000):
        if size:
            monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", size)
            monkeypatch.setattr(byte_bpe, "ENCODE_BYTES", size)
        got = encoded(spark, texts)
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or "") and got[i].decoded == (t or "").encode()


def test_merges_of_any_bytes(ranks, library):
    """Side by side and by the heap: the same ids as the library for single pieces."""
    m, rng = byte_bpe.Merges(ranks), random.Random(2)
    words = [bytes(rng.choice(b"aeinst\xc3\xa9\x80 ") for _ in range(rng.randrange(1, 60))) for _ in range(500)] + [b"a" * 64, b"ab" * 32]
    flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ids, n = m.encode(flat, np.cumsum(sizes) - sizes, sizes)
    for w, got in zip(words, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == m.one(w)
        assert b"".join(library.decode_single_token_bytes(i) for i in got.tolist()) == w
    for w in ("internationalization" * 20, "a" * 1000, "Donaudampfschiff" * 30):
        assert m.one(w.encode()) == library.encode_ordinary(w)


def test_parts_keep_pretokens(ranks):
    """Cutting a text into parts first gives the pattern's own matches."""
    import regex

    rng, alphabet = random.Random(3), "aZ \n\t'\u0085 　 é,7\x1ćs"
    find = regex.compile(byte_bpe.pattern()).findall
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        raw = s.encode()
        at = byte_bpe.part_starts(np.frombuffer(raw, np.uint8)).tolist()
        parts = [raw[i:j].decode() for i, j in zip([0, *at], [*at, len(raw)])]
        assert [w for p in parts for w in find(p)] == find(s)


def test_bpe_odd(spark, odd, none):
    path = byte_bpe.ranks_path()
    got = byte_bpe.encode_docs(odd, path)
    assert got.count() == odd.count() and sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in odd.collect())))
    assert byte_bpe.encode_docs(none, path).count() == 0
    ids = spark.createDataFrame([(1, bytearray(np.array([1 << 20], "<u4").tobytes())), (2, None), (3, bytearray())], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode_docs(ids, path).collect()} == {1: None, 2: None, 3: b""}


def test_bpe_query_and_plan(spark, library):
    df = byte_bpe.op12_byte_bpe(spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in df.collect():
        ids, raw = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 2  # words to buckets, ids to blocks: the documents' own numbers are not shuffled


# 13. hard negatives


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, label, x) as lists of integers."""
    out = []
    for a, (anchor, label, q) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        score = [(-sum(u * v for u, v in zip(q, x)), i, other == label) for b, (i, other, x) in enumerate(rows) if b != a]
        for s, p, _ in sorted(t for t in score if t[2])[:positives]:
            fit = sorted((t, i) for t, i, same in score if not same and low * -s <= 100 * -t <= high * -s)
            out += [(anchor, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, step, **more):
    df = spark.createDataFrame([(i, label, x, "k") for i, label, x in rows], "vec_id long, label long, x array<int>, near string")
    return sorted(map(tuple, hard_negatives.mine(df, df["vec_id"] % step == 0, **more).collect()))


def integer_rows(n, d, seed, size=40, labels=4):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randrange(-size, size) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("n, d, size, pass_bytes", [(400, 8, 40, 1 << 25), (300, 3, 3, 1 << 25), (400, 6, 20, 6000)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, n, d, size, pass_bytes):
    """Many ties, many blocks, several passes; a sample of a few rows."""
    monkeypatch.setattr(hard_negatives, "SAMPLE", 20)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rows = integer_rows(n, d, n + d, size)
    assert mined(spark, rows, 10, pass_bytes=pass_bytes) == (want := brute(rows, lambda i: i % 10 == 0)) and want


def test_hard_negatives_equal_rows(spark):
    """Repeated rows, a vector that a third of the rows share, anchors that occur twice, rows of one label alone."""
    rows = integer_rows(120, 4, 7, 9, 3)
    rows += rows[:20] + [(500 + i, i % 2, [3, -2, 5, 1]) for i in range(60)] + [(1000, 9, [1, 1, 1, 1])]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_pivots_pass_rows_over(spark):
    """Clustered rows: most pairs are settled by pivot distances alone."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (20, 16))
    x = np.repeat(centres, 50, 0) + rng.integers(-4, 5, (1000, 16))
    label = np.repeat(np.arange(20), 50) % 5
    square = int((x.astype(np.int64) ** 2).sum(1).max())
    pivots = hard_negatives.pick_pivots(x[::7], square)
    q = x[::50]
    anchors = hard_negatives.Anchors(np.arange(len(q)), label[::50], q, pivots.of_anchors(q), (q.astype(np.int64) ** 2).sum(1))
    n = len(q)
    s = hard_negatives.Search(anchors, pivots, (np.arange(n), np.full(n, -(1 << 62)), np.full(n, 1 << 62)), 6, True)
    s = hard_negatives.opened(s, label[::7], np.arange(1000)[::7], x[::7])
    far = pivots.of_rows(x)
    for i in range(0, 1000, 50):
        own = slice(i, i + 50)
        s.block(int(label[i]), np.arange(1000)[own], x[own], far[own], far[own].min(0), far[own].max(0))
    assert s.checked < s.seen / 10
    for k in range(n):
        scores = sorted(((-int(q[k] @ x[j]), j) for j in range(1000) if label[j] == anchors.label[k]))[:6]
        mine = s.found[0] == k
        assert [(-v, j) for v, j in zip(s.found[2][mine].tolist(), s.found[1][mine].tolist())] == scores


def test_hard_negatives_query_and_odd(spark):
    import duckdb

    got = hard_negatives.op13_hard_negatives(spark, SF)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cols = got.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, c.execute(f"select {', '.join(cols)} from ({hard_negatives.SQL['op13_hard_negatives']})").fetchall()))
    rows = random_rows(60, 3, 9) + ODD + [(None, [1.0, 2.0, 3.0], 1), (50, [1.0, 1.0, 1.0], None)]
    clean = hard_negatives.whole_rows(vectors(spark, rows))
    assert clean.count() == 60 + 1  # the row of two entries goes with the usual length
    want = brute([(r.vec_id, r.label, r.x) for r in clean.collect() if len(r.x) == 3], lambda i: i % 50 == 0)
    assert sorted(map(tuple, hard_negatives.mine(clean, clean["vec_id"] % 50 == 0).collect())) == want
    none = hard_negatives.whole_rows(vectors(spark, ODD[:3]))
    assert hard_negatives.mine(none, none["vec_id"] % 50 == 0).count() == 0
    alone = hard_negatives.whole_rows(vectors(spark, random_rows(30, 3, 1)[1:]))
    assert hard_negatives.mine(alone, alone["vec_id"] % 50 == 0).count() == 0  # no anchors
