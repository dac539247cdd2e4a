"""Operator 3: toxicity by the nearest labelled examples.

A text's vector holds all of its words (lower-cased), and the leading 4 and 5 letters of a word where those go with a label. From a bounded hash
sample of labelled documents (SAMPLE) the words and leads that go with a label beyond chance (exact hypergeometric tail, Bonferroni over all
terms) are learned; they weigh more than others by how certain they are, and no word is left out. Document frequencies
are counted over all documents for each term of the examples; a word that no example has meets none, and lengthens the vector as a word
of one document. The examples' TF-IDF vectors lie in a block-max inverted index. The postings of a text's rarer terms are read list by list; they bound the K-th best
cosine from below. The DENSE commonest terms are kept by blocks of BLOCK examples of like directions, with each term's largest weight in the block:
a block is read only where these maxima, with the best found in it so far, may reach the K-th best. Cosines are exact and no nearer example is passed over.
Neighbours vote with weight 1 / (1.05 - cosine); a monotone table fitted by leaving each example out maps vote shares to observed rates.
A text that shares no word with any example gets the rate of examples without words.

The driver gathers the learned terms, the words of the examples and their vectors, and broadcasts them: as much as the sample's texts.

Defined results: a null or empty text has no terms; an empty table gives an empty result; a very long text is one vector, made whole in one task; with
no labelled documents all scores are 0; of several texts under one labelled doc_id each is an example; equal cosines are ranked by example
order (doc_id, then text); repeated rows each get their row; a document with several labels counts as toxic if any says so; labels that
are null are no labels; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, fold, map_rows, small_batches, stash, table, texts

SAMPLE, K, BLOCK, BATCH, LEVEL, CHUNK, DENSE = 12_000, 15, 64, 256, 0.001, 65_536, 256
WORD = re.compile(r"\w+")
ASCII_GAPS = {i: " " for i in range(128) if not WORD.match(chr(i))}


def words_of(text: str) -> list[str]:
    text = text.lower()
    return text.translate(ASCII_GAPS).split() if text.isascii() else WORD.findall(text)


def terms_of(text: str | None) -> Counter:
    counts = Counter(words_of(text)) if text else Counter()
    for w, n in list(counts.items()):
        for k in (4, 5):
            if len(w) >= k:
                counts[w[:k] + "*"] += n
    return counts


class Vocabulary:
    """Numbers the terms of a text: learned leads first, then all words of the examples (a list, or one string with line feeds). Kept as one
    string until a task needs it."""

    def __init__(self, leads: list[str], words: list[str] | str):
        words = words if isinstance(words, str) else "\n".join(words)
        self.joined, self.number = "\n".join([*leads, *[words] * bool(words)]), None
        self.size = self.joined.count("\n") + bool(self.joined)
        self.heads = {t.rstrip("*")[:4] for t in leads}

    def __getstate__(self):
        return {**self.__dict__, "number": None}

    def vector(self, text: str | None):
        """Term numbers and counts as arrays, and the counts of the words that have no number."""
        import numpy as np

        if self.number is None:
            self.number = {t: i for i, t in enumerate(self.joined.split("\n"))} if self.size else {}
        number, heads, found, rest = self.number, self.heads, {}, []
        for w, n in Counter(words_of(text)).items() if text else ():
            i = number.get(w)
            if i is None:
                rest.append(n)
            else:
                found[i] = n
            if len(w) > 3 and w[:4] in heads:
                for k in (4, 5):
                    i = number.get(w[:k] + "*") if len(w) >= k else None
                    if i is not None:
                        found[i] = found.get(i, 0) + n
        return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found)), np.array(rest, np.int32)


def tail(a: int, marked: int, n1: int, n: int) -> float:
    """log P(at least a of the marked documents are among the n1), hypergeometric."""
    def choose(x, y):
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    top = min(marked, n1)
    logs = [choose(n1, i) + choose(n - n1, marked - i) - choose(n, marked) for i in range(a, top + 1) if marked - i <= n - n1]
    if not logs:
        return -math.inf
    m = max(logs)
    return m + math.log(math.fsum(math.exp(x - m) for x in logs))


def learn_terms(sample: DataFrame, level: float = LEVEL) -> tuple[dict[str, float], list[str]]:
    """The terms whose documents carry one label more often than chance allows, with their weights (over 1), and all words of the sample."""

    def make():
        def each(text, toxic):
            seen: dict[str, list[int]] = {}
            for t, y in zip(text, toxic):
                for term in terms_of(t):
                    seen.setdefault(term, [0, 0])[y] += 1
            return list(seen), [c[0] for c in seen.values()], [c[1] for c in seen.values()]

        return each

    parts = map_rows(sample.select("text", "toxic"), make, "term string, clean long, toxic long")
    counts = stash(parts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-terms")
    sides = sample.groupBy("toxic").count().collect()  # two rows
    n = {r.toxic: r["count"] for r in sides}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    words = sorted(counts.filter(~F.endswith("term", F.lit("*"))).select("term").toArrow().column(0).to_pylist())  # as much as the sample's texts
    if not n0 or not n1:
        return {}, words
    tests = 2 * counts.count()
    limit = math.log(level / tests)

    def certain(batches):
        import pandas as pd

        for pdf in batches:
            out = [(t, min(tail(int(b), int(a + b), n1, n0 + n1), tail(int(a), int(a + b), n0, n0 + n1))) for t, a, b in zip(pdf["term"], pdf["clean"], pdf["toxic"])]
            yield pd.DataFrame([x for x in out if x[1] < limit], columns=["term", "p"])

    # only a term off the base rate can pass
    worth = counts.filter((F.abs(F.col("toxic") - (F.col("clean") + F.col("toxic")) * (n1 / (n0 + n1))) > 2))
    best = worth.mapInPandas(certain, "term string, p double").collect()  # some of the sample's terms
    return {r.term: 1 + limit - r.p for r in sorted(best, key=lambda r: (r.p, r.term))}, words


class Index:
    """Inverted index of example vectors; example: (name, label, {term: weight}) or (name, label, (terms, weights)), of unit length."""

    def __init__(self, examples: list[tuple]):
        import numpy as np

        pairs = [self.arrays(v) for _, _, v in examples]
        terms, weights = (np.concatenate([np.zeros(0, t), *[p[i] for p in pairs]]) for i, t in ((0, np.int64), (1, np.float64)))
        self.build([e[0] for e in examples], [e[1] for e in examples], [len(p[0]) for p in pairs], terms, weights)

    @classmethod
    def flat(cls, names, labels, lengths, terms, weights) -> Index:
        """From the examples' vectors laid end to end."""
        index = cls.__new__(cls)
        index.build(names, labels, lengths, terms, weights)
        return index

    def build(self, names, labels, lengths, terms, weights):
        import numpy as np

        self.names, self.labels, self.places = names, np.array(labels, np.float64), None
        self.read = self.skipped = 0  # blocks of examples, over all queries so far
        n, df = len(names), np.bincount(terms)
        common = np.argsort(-df, kind="stable")[:DENSE]
        self.row = np.full(len(df) + 1, -1, np.int32)
        self.row[common] = np.arange(len(common))
        ids, row = np.repeat(np.arange(n, dtype=np.int32), lengths), self.row[terms]
        dense = np.zeros((n, len(common)))
        dense[ids[row >= 0], row[row >= 0]] = weights[row >= 0]
        self.order = self.alike(dense)  # slot -> example
        slot = np.empty(n, np.int32)
        slot[self.order] = np.arange(n, dtype=np.int32)
        full = np.zeros((-(-n // BLOCK) * BLOCK, len(common)))
        full[:n] = dense[self.order]
        del dense
        self.blocks = np.ascontiguousarray(full.reshape(-(-n // BLOCK), BLOCK, len(common)).transpose(0, 2, 1))
        self.most = np.ascontiguousarray(self.blocks.max(2).T)
        rare = row < 0
        terms, ids, weights = terms[rare], slot[ids[rare]], weights[rare]
        order = np.argsort(terms, kind="stable")
        self.ids, self.weights = ids[order], weights[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(df)))])

    @staticmethod
    def alike(vectors, groups: int = 16, rounds: int = 5):
        """An order in which examples of like directions are neighbours, so that blocks have low maxima: by the nearest of some means."""
        import numpy as np

        n = len(vectors)
        if n <= BLOCK:
            return np.arange(n)
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        means = unit[np.linspace(0, n - 1, groups).astype(int)]
        for _ in range(rounds):
            near = unit @ means.T
            group = near.argmax(1)
            means = np.eye(groups)[group].T @ unit
            means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
        return np.lexsort((-near.max(1), group))

    @staticmethod
    def arrays(v):
        import numpy as np

        return (np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), np.float64, len(v))) if isinstance(v, dict) else v

    def scores(self, queries, k: int):
        """Dot products of some queries (terms, weights) with all examples, by slot, and for each query a bound that the k-th best reaches. What
        reaches it is exact; blocks of examples whose maxima do not are not read, and their examples have too low a score."""
        import numpy as np

        n = len(self.blocks) * BLOCK
        dense, out = np.zeros((len(queries), len(self.most))), np.zeros((len(queries), n))
        for q, (terms, weights) in enumerate(queries):
            known = terms < len(self.row) - 1
            terms, weights = terms[known], weights[known]
            row = self.row[terms]
            dense[q, row[row >= 0]] = weights[row >= 0]
            terms, weights = terms[row < 0], weights[row < 0]
            order = np.argsort(terms)
            terms, weights = terms[order], weights[order]
            runs = list(zip(self.start[terms].tolist(), self.start[terms + 1].tolist()))
            if runs:
                value = np.concatenate([self.weights[i:j] for i, j in runs])
                value *= np.repeat(weights, [j - i for i, j in runs])
                if len(value):
                    out[q] = np.bincount(np.concatenate([self.ids[i:j] for i, j in runs]), value, n)
        by_block = out.reshape(len(queries), -1, BLOCK)
        bound = dense @ self.most + by_block.max(2)
        # the most promising blocks first: their best and those of the others, so far, bound the k-th best from below
        cut = max(0, len(self.blocks) - 2 * k)
        first = (bound >= np.partition(bound, cut, axis=1)[:, cut, None]) & (bound > 0)
        self.add(dense, by_block, first)
        tops = by_block.max(2) if len(self.blocks) > k else out
        cut = tops.shape[1] - k
        least = np.partition(tops, cut, axis=1)[:, cut] - 1e-9 if cut >= 0 else np.full(len(queries), -1e-9)
        rest = (bound >= least[:, None]) & (bound > 0) & ~first
        self.add(dense, by_block, rest)
        self.read += int(first.sum() + rest.sum())
        self.skipped += int((~first & ~rest).sum())
        return out, least

    def add(self, dense, by_block, wanted) -> None:
        """Adds the commonest terms' part to the scores of the wanted (query, block) pairs."""
        import numpy as np

        for b in np.flatnonzero(wanted.any(0)).tolist():
            q = np.flatnonzero(wanted[:, b])
            by_block[q, b] += dense[q] @ self.blocks[b]

    def leave_out(self, scores, name) -> None:
        """Takes the example of a name out of its own scores; of several the most similar, which is the query itself or its equal."""
        if self.places is None:
            self.places = {}
            for i, x in enumerate(self.order.tolist()):
                self.places.setdefault(self.names[x], []).append(i)
        if name in self.places:
            scores[max(self.places[name], key=lambda i: scores[i])] = 0

    def nearest_of(self, queries: list, k: int = K, own: list | None = None) -> list[list[tuple[float, int]]]:
        """For each query, the k examples of largest cosine (above 0), exactly; ties by example order. own: queries are the examples of
        these names, and each leaves itself out."""
        import numpy as np

        found, queries = [], [self.arrays(q) for q in queries]
        for at in range(0, len(queries) if self.names else 0, BATCH):
            for scores, least in zip(*self.scores(queries[at : at + BATCH], k + (own is not None))):
                if own is not None:
                    self.leave_out(scores, own[len(found)])
                seen = np.flatnonzero(scores >= max(least, 1e-300))
                value, ids = scores[seen].round(12), self.order[seen]
                order = np.lexsort((ids, -value))[:k]
                found.append([(float(value[i]), int(ids[i])) for i in order])
        if not self.names:
            found = [[] for _ in queries]
        return found

    def nearest(self, q, k: int = K) -> list[tuple[float, int]]:
        return self.nearest_of([q], k)[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [1 / (1.05 - min(1.0, s)) for s, _ in near]
        return float(sum(w * self.labels[i] for w, (_, i) in zip(weights, near)) / sum(weights))


def unit(counts: dict[int, int], idf: list[float]) -> dict[int, float]:
    v = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
    length = math.sqrt(math.fsum(x * x for x in v.values()))
    return {t: x / length for t, x in v.items()} if length else {}


class Model:
    """What scoring needs. shared: a broadcast of the words, weights and example vectors, bounded by the sample's texts; a Python worker
    builds the index from it once and keeps it for its tasks. rates: of the ten bins of votes; empty: of a text without neighbours."""

    def __init__(self, shared, rates: list[float], empty: float):
        self.shared, self.rates, self.empty = shared, rates, empty

    def part(self, what: str):
        import numpy as np

        held = self.shared.value
        if "index" not in held:
            terms, counts, sizes = (np.frombuffer(held.pop(x), np.int32) for x in ("terms", "counts", "sizes"))
            weights = np.log(counts)
            weights += 1
            weights *= held["idf"][terms]
            ends = np.cumsum(sizes)
            for i, j, r in zip((ends - sizes).tolist(), ends.tolist(), held.pop("rests")):
                weights[i:j] /= math.sqrt(weights[i:j] @ weights[i:j] + r * held["alone"] ** 2)
            held["vocabulary"] = Vocabulary(held["leads"], held["words"])
            held["index"] = Index.flat(held["names"], held["labels"], sizes, terms, weights)
        return held[what]

    def unit(self, vector):
        """Terms and weights of a vector (terms, counts, counts of other words), of unit length with the other words."""
        import numpy as np

        terms, counts, rest = vector
        v, r = (1 + np.log(counts)) * self.part("idf")[terms], (1 + np.log(rest)) * self.shared.value["alone"]
        return terms, v / math.sqrt(v @ v + r @ r) if len(v) else v

    def score(self, text: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        index, vocabulary = self.part("index"), self.part("vocabulary")
        near = index.nearest_of([self.unit(vocabulary.vector(t)) for t in text])
        return [(self.rates[min(9, int(index.vote(x) * 10))], x) if x else (self.empty, []) for x in near]


def pooled(bins: list[tuple[float, float]]) -> list[float]:
    """Rates y / n of bins (y, n), made monotone by pooling neighbours."""
    pools: list[list] = []
    for i, (y, n) in enumerate(bins):
        pools.append([y, n, [i]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            y2, n2, i2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2] + i2]
    return [y / n for y, n, members in pools for _ in members]


def labelled_sample(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of about sample labelled documents that learn(doc_id) admits, chosen by hash; all of them when there are fewer."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stash(known, "toxicity-labels")
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + (share == 1)))
    picked = docs.select("doc_id", "text").join(drawn, "doc_id")
    return stash(picked, "toxicity-sample")


def term_counts(docs: DataFrame, vocabulary: Vocabulary):
    """How many documents have each term of the vocabulary, as an array, and how many documents there are. A task counts its own and hands
    out packed runs of CHUNK terms; runs are summed where they meet, so rows do not grow with the texts."""
    import numpy as np

    parts = -(-vocabulary.size // CHUNK)
    schema = arrow_schema("chunk int, n binary")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total, rows = np.zeros(parts * CHUNK, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                total[vocabulary.vector(t)[0]] += 1
                rows += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(parts)], pa.int32()), pa.array([np.int64(rows).tobytes(), *[total[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(parts)]], pa.binary())], schema=schema)

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for b in batches:
            for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[c] = sums.get(c, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=schema)

    small_batches(docs.sparkSession)
    runs = docs.select("text").mapInArrow(count, "chunk int, n binary").repartition("chunk").mapInArrow(add, "chunk int, n binary").collect()  # one a chunk
    found = {r.chunk: np.frombuffer(r.n, np.int64) for r in runs}
    df = np.concatenate([np.zeros(0, np.int64), *[found.get(i, np.zeros(CHUNK, np.int64)) for i in range(parts)]])[: vocabulary.size]
    return df, int(found[-1][0]) if found else 0


def learn_model(docs: DataFrame, labels: DataFrame, learn=lambda c: F.lit(True), sample: int = SAMPLE) -> Model:
    import numpy as np

    drawn = labelled_sample(docs, labels, learn, sample)
    learned, words = learn_terms(drawn)
    leads = [t for t in learned if t.endswith("*")]
    vocabulary, more = Vocabulary(leads, words), np.ones(len(leads) + len(words))
    for k, t in enumerate(leads):
        more[k] = learned[t]
    for t, w in learned.items():
        if not t.endswith("*"):
            more[len(leads) + bisect.bisect_left(words, t)] = w
    words = "\n".join(words)
    df, n = term_counts(docs, vocabulary)
    idf, alone = (np.log((n + 1) / (df + 0.5)) + 1) * more, math.log((n + 1) / 1.5) + 1
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def each(ids, text, toxic):
            found = list(zip(*[[x.tobytes() for x in vocabulary.vector(t)] for t in text])) or [[], [], []]
            return ids, toxic, *found

        return each

    vectors = stash(map_rows(texts(drawn, "toxic"), make, f"doc_id {id_type}, toxic int, terms binary, counts binary, rest binary"), "toxicity-vectors")
    shared = docs.sparkSession.sparkContext.broadcast({**examples_of(vectors), "idf": idf, "alone": alone, "leads": leads, "words": words})
    model = Model(shared, [0.0] * 10, 0.0)

    def votes():
        def each(ids, toxic, terms, counts, rest):
            index = model.part("index")
            queries = [model.unit([np.frombuffer(x, np.int32) for x in v]) for v in zip(terms, counts, rest)]
            near = index.nearest_of(queries, own=ids)
            return toxic, [min(9, int(index.vote(x) * 10)) if x else -1 if len(q[0]) else -2 for x, q in zip(near, queries)]

        return each

    # votes of each example without itself, in ten bins; -1: no neighbours, -2: no words
    rows = map_rows(vectors, votes, "toxic int, bin int").groupBy("bin").agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).collect()  # at most 12
    if rows:
        base, found = sum(r.y for r in rows) / sum(r.n for r in rows), {r.bin: (r.y, r.n) for r in rows}
        y, n = found.get(-2, (0, 0))
        model.empty = (y + base) / (n + 1)
        model.rates = pooled([(found.get(i, (0, 0))[0] + base, found.get(i, (0, 0))[1] + 1.0) for i in range(10)])
    return model


def examples_of(vectors: DataFrame) -> dict:
    """The examples with words, by doc_id and then by the bytes of their vectors, laid end to end; about SAMPLE rows on the driver."""
    import numpy as np

    got = vectors.filter("length(terms) > 0").toArrow()
    ids, toxic = got.column("doc_id").to_pylist(), got.column("toxic").to_pylist()
    alike = Counter(ids)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], *[got.column(c)[i].as_py() for c in ("terms", "counts", "rest") if alike[ids[i]] > 1]))
    out = {"names": [ids[i] for i in order], "labels": [toxic[i] for i in order]}
    for name in ("terms", "counts"):
        column = got.column(name).to_pylist()
        out["sizes"] = np.array([len(column[i]) // 4 for i in order], np.int32).tobytes()
        out[name] = b"".join([column[i] for i in order])
    column = got.column("rest").to_pylist()
    out["rests"] = [float(((1 + np.log(np.frombuffer(column[i], np.int32))) ** 2).sum()) for i in order]
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, learn=lambda c: F.lit(True), sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, score, predicted, evidence (the nearest examples: doc_id, cosine, label)."""
    model = learn_model(docs, labels, learn, sample)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def each(ids, text):
            found = model.score(text)
            index = model.part("index")
            evidence = [[{"doc_id": index.names[i], "cosine": s, "label": int(index.labels[i])} for s, i in near] for _, near in found]
            return ids, [s for s, _ in found], [int(s >= 0.5) for s, _ in found], evidence

        return each

    return map_rows(texts(docs), make, f"doc_id {id_type}, score double, predicted int, evidence array<struct<doc_id: {id_type}, cosine: double, label: int>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn=lambda c: F.lit(True), sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text the model does not call toxic."""
    model = learn_model(docs, labels, learn, sample)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([s < 0.5 for s, _ in model.score(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, learn=lambda c: fold(c) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
