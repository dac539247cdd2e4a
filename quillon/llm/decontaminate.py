"""Operator 1: benchmark decontamination.

Test items are cut into entries of at most ENTRY words and put into a BM25 inverted index, weights divided by the score of an entry with
itself. Every passage of every document (windows of 2 * ENTRY words, each ENTRY apart, so an entry lies whole in some passage) is a query. Block-max
WAND finds all entries at THRESHOLD or more: the most frequent terms, which give no entry more than COMMON, open no passage; the other
terms' largest weight in each block of entries, summed over a passage, bounds its scores there; blocks that may reach the threshold
are scored exactly. Postings of all other blocks are skipped. A retrieved item is then verified around the passage: of the SHINGLE-word shingles of its question and
of its answer (its last sentence, when it has several) half or more must be there.

The index is built from at most INDEX_WORDS words of items at a time; a larger benchmark is split by hash into that many more passes, each with
the statistics of the whole benchmark, so that scores and finds are the same for any number of passes.

Defined results: null or empty documents and items match nothing; an item of one sentence has no answer to verify; equal items are
reported each; repeated documents are reported each; an empty table on either side gives an empty result; other columns are
ignored. Very long texts are passages like others, in one task; of passages that tie, the one of the larger overlaps is reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, spread, stash, table, texts

ENTRY, BLOCK, THRESHOLD, COMMON, SHINGLE, OVERLAP, INDEX_WORDS, CHUNKS = 48, 8, 0.5, 0.2, 3, 0.5, 500_000, 4_096
K1, B = 1.2, 0.75
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, the last sentence of several."""
    parts = [w for w in (words_of(s) for s in re.split(r"(?<=[.?!])\s+|\n+", text or "")) if w]
    if len(parts) < 2:
        return [w for p in parts for w in p], []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def entries_of(text: str | None) -> list[list[str]]:
    """An item's words in runs of ENTRY; a short rest is covered by the last ENTRY words, so nothing of an item is left out."""
    q, a = split_item(text)
    whole = q + a
    parts = [whole[k : k + ENTRY] for k in range(0, len(whole), ENTRY)]
    if len(parts) > 1 and len(parts[-1]) < 8:
        parts[-1] = whole[-ENTRY:]
    return parts


class Statistics:
    """What BM25 needs of all entries, whatever pass they are in: how many there are, their mean length, and in how many each term is."""

    def __init__(self, entries: int, words: int, df: dict[str, int]):
        self.entries, self.mean, self.df = entries, words / max(1, entries), df

    @classmethod
    def of_items(cls, items: list[tuple]):
        every = [e for _, t in items for e in entries_of(t)]
        return cls(len(every), sum(map(len, every)), Counter(t for e in every for t in set(e)))


class Index:
    """BM25 index of items [(item_id, text)], normalised so that an entry scores 1 with itself. Postings lie by term, then block of entries."""

    def __init__(self, items: list[tuple], statistics: Statistics | None = None):
        import numpy as np

        known = statistics or Statistics.of_items(items)
        self.items = [(i, *split_item(t)) for i, t in items]
        self.entries = [(n, part) for n, (_, t) in enumerate(items) for part in entries_of(t)]
        lists: dict[str, list[tuple[int, float]]] = {}
        for e, (_, w) in enumerate(self.entries):
            idf = {t: math.log(1 + (known.entries - known.df[t] + 0.5) / (known.df[t] + 0.5)) for t in set(w)}
            weights = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / known.mean)) for t, f in Counter(w).items()}
            own = math.fsum(weights.values())
            for t, x in weights.items():
                lists.setdefault(t, []).append((e, x / own))
        self.number = {t: i for i, t in enumerate(lists)}
        self.posts = [(np.array([e for e, _ in p]), np.array([x for _, x in p])) for p in lists.values()]
        self.ids = np.concatenate([np.zeros(0, np.int64), *[ids for ids, _ in self.posts]])
        self.weights = np.concatenate([np.zeros(0), *[x for _, x in self.posts]])
        self.read = 0  # postings read so far
        # the most frequent terms add COMMON at most to any entry's score: that is allowed for, and only the others open a passage
        common = np.zeros(len(self.entries))
        essential = np.ones(len(self.posts) + 1, bool)
        essential[-1] = False
        for t in np.argsort([-len(ids) for ids, _ in self.posts], kind="stable"):
            ids, x = self.posts[t]
            if (common[ids] + x).max() > COMMON:
                break
            common[ids] += x
            essential[t] = False
        self.essential, self.n_blocks = essential, -(-len(self.entries) // BLOCK)
        self.need = np.full(self.n_blocks, THRESHOLD - 1e-9)
        if len(self.entries):
            allowed = np.zeros(self.n_blocks)
            np.maximum.at(allowed, np.arange(len(self.entries)) // BLOCK, common)
            self.need -= allowed
        blocks, most, sizes = [], [], []
        for ids, x in self.posts:
            b, n = np.unique(ids // BLOCK, return_counts=True)
            m = np.zeros(len(b))
            np.maximum.at(m, np.searchsorted(b, ids // BLOCK), x)
            blocks.append(b)
            most.append(m)
            sizes.append(n)
        self.at = np.cumsum([0, *map(len, blocks)])
        self.block = np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int64)
        self.most = np.concatenate([*most, np.zeros(0)])
        self.size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size  # where a term's postings of a block begin

    def passages(self, found, chunk, last) -> list[tuple[int, int]]:
        """(first chunk of a passage, block) where the block's maxima may reach the threshold. found: term of each word; chunk: its number;
        last: whether a chunk ends its text. A passage is a chunk and the next of the same text."""
        import numpy as np

        out = []
        for c0 in range(0, len(last), CHUNKS):
            c1 = min(c0 + CHUNKS + 1, len(last))  # one more, for the last passage
            i, j = np.searchsorted(chunk, [c0, c1])
            keep = self.essential[found[i:j]]
            pair = np.unique((chunk[i:j][keep] - c0) * (len(self.posts) + 1) + found[i:j][keep])  # a term counts once a chunk
            c, t = np.divmod(pair, len(self.posts) + 1)
            n = self.at[t + 1] - self.at[t]
            take = np.arange(n.sum()) + np.repeat(self.at[t] - (np.cumsum(n) - n), n)
            s = np.bincount(np.repeat(c, n) * self.n_blocks + self.block[take], self.most[take], (c1 - c0) * self.n_blocks).reshape(-1, self.n_blocks)
            s[:-1] += np.where(last[c0 : c1 - 1, None], 0, s[1:])
            first, block = np.nonzero(s[: CHUNKS if c1 < len(last) else None] >= self.need)
            out += zip((first + c0).tolist(), block.tolist())
        return out

    def search(self, terms: list[int], blocks: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """The entries of the blocks whose exact score with the query terms (distinct) is at the threshold or above. Postings of other blocks are skipped."""
        import numpy as np

        terms = np.array(terms, np.int64)
        rows = spread(self.at[:-1], np.diff(self.at), terms)
        rows = rows[np.isin(self.block[rows], list(blocks))]
        take = spread(self.first, self.size, rows)
        self.read += len(take)
        if not len(take):
            return []
        low = int(self.ids[take].min())
        score = np.bincount(self.ids[take] - low, self.weights[take])
        return [(int(e) + low, float(score[e])) for e in np.flatnonzero(score >= threshold - 1e-9)]

    def verify(self, near: list[str], n: int) -> tuple[float, float]:
        """Shares of item n's question shingles and of its answer's shingles, in their order of words, that the words near a passage hold."""
        _, question, answer = self.items[n]

        def held(words):
            size = min(SHINGLE, len(words))
            want, have = shingles(words), {tuple(near[k : k + size]) for k in range(len(near) - size + 1)}
            return len(want & have) / len(want) if want else 1.0

        return held(question), held(answer)

    def leaks(self, all_texts: list) -> list[list[tuple]]:
        """Per whole text: (item_id, bm25, question_overlap, answer_overlap) of every verified item, its best passage each."""
        import numpy as np

        get, none = self.number.get, len(self.number)
        words = [words_of(t) for t in all_texts]
        sizes = np.array([len(w) for w in words], np.int64)
        best: list[dict[int, tuple]] = [{} for _ in words]
        if not self.entries or not sizes.sum():
            return [[] for _ in words]
        found = np.fromiter((get(w, none) for ws in words for w in ws), np.int64, int(sizes.sum()))
        chunks = -(-sizes // ENTRY)
        first_chunk, first_word = np.cumsum(chunks) - chunks, np.cumsum(sizes) - sizes
        inside = np.arange(len(found)) - np.repeat(first_word, sizes)
        chunk = inside // ENTRY + np.repeat(first_chunk, sizes)
        last = np.zeros(int(chunks.sum()), bool)
        last[(first_chunk + chunks - 1)[chunks > 0]] = True
        by: dict[int, set[int]] = {}
        for c, b in self.passages(found, chunk, last):
            by.setdefault(c, set()).add(b)
        for c, blocks in by.items():
            d = int(np.searchsorted(first_chunk, c, "right")) - 1
            while not chunks[d]:  # a text without words begins at the same chunk
                d -= 1
            i = (c - int(first_chunk[d])) * ENTRY
            j = min(i + 2 * ENTRY, int(sizes[d]))
            terms = [t for t in set(found[first_word[d] + i : first_word[d] + j].tolist()) if t != none]
            for e, score in self.search(terms, blocks):
                n = self.entries[e][0]
                reach = len(self.items[n][1]) + len(self.items[n][2])
                q, a = self.verify(words[d][max(0, i - reach) : j + reach], n)
                if q >= OVERLAP and a >= OVERLAP and (n not in best[d] or best[d][n][1:] < (score, q, a)):
                    best[d][n] = (self.items[n][0], score, q, a)
        return [[b[n] for n in sorted(b)] for b in best]


def indexes(benchmark: DataFrame, words_a_pass: int | None = None):
    """The indexes of all passes, one built at a time: each gathers at most about words_a_pass (INDEX_WORDS) words to the driver, and the counts of its own
    terms over all entries of all passes, so that scores do not depend on how many passes there are."""
    words_a_pass = words_a_pass or INDEX_WORDS
    rows = benchmark.select("item_id", "text").filter("length(trim(text)) > 0")
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-words // words_a_pass)) if words else 0
    key = lambda x: (x[0] is None, x)
    if passes <= 1:
        if passes:
            yield Index(sorted(((r.item_id, r.text) for r in rows.collect()), key=key))
        return
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).cast("int")

    def make():
        def each(number, text):
            out = [(p, t, 1) for p, x in zip(number, text) for e in entries_of(x) for t in set(e)]
            out += [(p, None, len(e)) for p, x in zip(number, text) for e in entries_of(x)]  # an entry and its words
            return list(zip(*out)) if out else [[]] * 3

        return each

    counted = map_rows(rows.select(part.alias("part"), "text"), make, "part int, term string, n long")
    counted = stash(counted.groupBy("part", "term").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "benchmark-terms")
    total = counted.filter("term is null").agg(F.sum("df").alias("entries"), F.sum("n").alias("words")).first()
    df = counted.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    for p in range(passes):
        own = df.join(counted.filter((F.col("part") == p) & F.col("term").isNotNull()).select("term"), "term", "left_semi")
        known = Statistics(total.entries, total.words, {r.term: r.df for r in own.collect()})  # the terms of one pass
        yield Index(sorted(((r.item_id, r.text) for r in rows.filter(part == p).collect()), key=key), known)


def find_leaks(docs: DataFrame, benchmark: DataFrame, words_a_pass: int | None = None) -> DataFrame:
    """doc_id, item_id, bm25 (1: as the item with itself), question_overlap, answer_overlap of every verified leak."""
    id_type, item_type = (x.simpleString() for x in (docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType))
    ddl = f"doc_id {id_type}, item_id {item_type}, bm25 double, question_overlap double, answer_overlap double"

    def one(index: Index) -> DataFrame:
        def make():
            def each(ids, text):
                rows = [(d, *leak) for d, found in zip(ids, index.leaks(text)) for leak in found]
                return list(zip(*rows)) if rows else [[]] * 5

            return each

        return map_rows(texts(docs), make, ddl)

    out, last = [], None
    for index in indexes(benchmark, words_a_pass):
        if last is not None:  # of several passes each is written before the next index is gathered
            out.append(stash(one(last), "leaks"))
        last = index
    if last is None:
        return docs.sparkSession.createDataFrame([], ddl)
    out.append(stash(one(last), "leaks") if out else one(last))
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, words_a_pass: int | None = None) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    texts(docs.select("doc_id", "text"))

    def without(docs: DataFrame, index: Index) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                text = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not found for found in index.leaks(text)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    last = None
    for index in indexes(benchmark, words_a_pass):
        if last is not None:
            docs = stash(without(docs, last), "unleaked")
        last = index
    return docs if last is None else without(docs, last)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
SQL: dict[str, str] = {}
