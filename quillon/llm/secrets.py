"""Operator 7: secret scans with inferred credential grammars.

Base patterns find assignments, access keys and hex runs. Their values, labelled by kind, teach one probabilistic automaton a kind: the prefix tree of a
bounded sample of distinct values, over classes of characters, is merged layer by layer, states of one depth where their outgoing frequencies are
statistically compatible (Hoeffding's bound on classes, characters and ends, checked down the subtrees). Depth is kept, and with it prefixes, places
of marks and lengths; a string that the states do not suit is judged by the kind's own frequencies of characters. Every other candidate token of every text is then
scored: the log-likelihood of its best credential automaton against a background automaton of ordinary candidates, one state a layer. A candidate
at MARGIN bits a symbol or more above the background is added as a span of kind "format". Candidates are unbroken runs of the value alphabet of 12
characters or more that no base spans cover whole; a run that reaches beyond a base span within it is scored as a whole.

The sample holds at most about SAMPLE distinct values a kind of at most LONGEST characters (of 64 parts by hash, the lowest hashes of each); it is
all that the driver gathers, whatever the input's size. The scan covers every whole text and scores candidates of any length.

Defined results: a null text is an empty one; base spans of one kind never overlap, spans of different kinds may, and so may a "format" span and the
base spans within it; ties in start go in the order assign, access, hex, format; repeated rows each get their row; a very long text is
scanned whole in one task, in time proportional to its length; an empty table gives an empty result and automata that accept nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, stash, table, texts

KINDS = ("assign", "access", "hex", "format")
SAMPLE, LONGEST, MARGIN, MERGE_ALPHA, MIN_TRAIN, DEPTH, TABLE = 2_000, 256, 1.5, 0.01, 30, 64, 3.0

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: What the automata judge: unbroken runs of 12 or more characters of the value alphabet, as short as a value may be.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
#: Characters by class; a mark is a class of its own.
CLASS = {**dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "0")}
#: An assignment needs one of these in lower case.
HINTS = ("passw", "secret", "token", "key")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class State:
    """A state: how often it was seen, ended in, and left by each character; kids by class."""

    __slots__ = ("seen", "ends", "chars", "kids")

    def __init__(self):
        self.seen, self.ends, self.chars, self.kids = 0, 0, Counter(), {}


class Automaton:
    """A deterministic probabilistic automaton: transitions[state][class] = state, and log2 probabilities of characters and of the end. What a state has not
    seen has a share of one observation, spread as the characters of all strings are; beyond the last state these alone count."""

    def __init__(self, states: list[State], number: dict[int, int], overall: Counter, n: int, symbols: int):
        total = sum(overall.values()) + n + 0.5 * (symbols + 1)
        self.rare = math.log2(0.5 / total)
        self.common = {c: math.log2((k + 0.5) / total) for c, k in overall.items()}
        self.stop = math.log2((n + 0.5) / total)
        self.transitions = [{c: number[id(k)] for c, k in s.kids.items()} for s in states]
        self.seen = [s.seen for s in states]
        self.left = [{c: math.log2((k + 2 ** self.common[c]) / (s.seen + 1)) for c, k in s.chars.items()} for s in states]
        self.ends = [math.log2((s.ends + 2**self.stop) / (s.seen + 1)) for s in states]

    def bits(self, s: str) -> float:
        """log2 likelihood of s: by the states, or, at TABLE bits, by the strings' characters alone, which tells formats that no label has."""
        state, total, table = 0 if self.transitions else None, 0.0, self.stop - TABLE
        for c in s:
            common = self.common.get(c, self.rare)
            table += common
            if state is None:
                total += common
                continue
            p = self.left[state].get(c)
            total += common - math.log2(self.seen[state] + 1) if p is None else p
            state = self.transitions[state].get(CLASS.get(c, c))
        return max(table, total + (self.stop if state is None else self.ends[state]))


def infer(strings: Counter, alpha: float = MERGE_ALPHA, symbols: int = 70, depth: int = DEPTH) -> Automaton:
    """Merge the compatible states of each layer of the strings' prefix tree, from the root on; from depth on all states of a layer are one."""
    root, overall = State(), Counter()
    for s, times in sorted(strings.items()):
        at = root
        for c in s:
            at.seen += times
            at.chars[c] += times
            at = at.kids.setdefault(CLASS.get(c, c), State())
        at.seen += times
        at.ends += times
        for c, k in Counter(s).items():
            overall[c] += k * times
    reach = math.sqrt(0.5 * math.log(2 / alpha))

    def differs(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > reach * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: State, b: State) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if differs(x.ends, x.seen, y.ends, y.seen) or any(differs(x.chars[c], x.seen, y.chars[c], y.seen) for c in x.chars.keys() | y.chars.keys()):
                return False
            for c in x.kids.keys() | y.kids.keys():
                p, q = x.kids.get(c), y.kids.get(c)
                if differs(p.seen if p else 0, x.seen, q.seen if q else 0, y.seen):
                    return False
                if p and q:
                    todo.append((p, q))
        return True

    def absorb(a: State, b: State) -> None:
        """Add state b and all below it to a; both are still trees."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            x.seen, x.ends = x.seen + y.seen, x.ends + y.ends
            x.chars.update(y.chars)
            for c, k in y.kids.items():
                if c in x.kids:
                    todo.append((x.kids[c], k))
                else:
                    x.kids[c] = k

    states, layer, at = [], [root], 0
    while layer:
        states += layer
        at += 1
        below: list[State] = []
        for s in layer:
            for c in sorted(s.kids):
                same = next((r for r in below if at >= depth or compatible(r, s.kids[c])), None)
                if same is None:
                    below.append(s.kids[c])
                else:
                    absorb(same, s.kids[c])
                    s.kids[c] = same
        layer = below
    if not strings:
        return Automaton([], {}, overall, 0, symbols)
    return Automaton(states, {id(s): i for i, s in enumerate(states)}, overall, sum(strings.values()), symbols)


def labelled_values(docs: DataFrame) -> DataFrame:
    """kind, value: the values of the base matches, and as kind "none" the candidates that no base pattern touches."""

    def make():
        def each(_, text):
            kinds, values = [], []
            for t in text:
                spans = base_spans(t)
                for start, kind, end in spans:
                    m = ASSIGN.match(t, start) if kind == 0 else None
                    kinds.append(KINDS[kind])
                    values.append(m[2] if m else t[start:end])
                for start, end in free_candidates(t, spans):
                    kinds.append("none")
                    values.append(t[start:end])
            return kinds, values

        return each

    return map_rows(texts(docs), make, "kind string, value string")


def free_candidates(text: str | None, spans: list[tuple[int, int, int]]):
    """Candidates that touch no base span (sorted by start): one pass over both lists."""
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text or ""):
        # all spans that begin before the candidate ends; the furthest end of them tells whether one touches it
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m.span()


def uncovered_candidates(text: str | None, spans: list[tuple[int, int, int]]):
    """Candidates that the base spans (sorted by start) do not cover whole: one pass over both lists."""
    joined: list[list[int]] = []
    for start, _, end in spans:
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    at = 0
    for m in CANDIDATE.finditer(text or ""):
        while at < len(joined) and joined[at][1] <= m.start():
            at += 1
        if at == len(joined) or joined[at][0] > m.start() or joined[at][1] < m.end():
            yield m.span()


def learn_automata(docs: DataFrame, sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton a kind and one for ordinary candidates, from at most sample distinct values of each."""
    values = labelled_values(docs).filter(F.length("value") <= LONGEST).distinct().withColumn("h", F.xxhash64("value"))
    # the lowest hashes of a kind: pre-aggregated, so no task holds more than the sample
    parts = values.withColumn("salt", F.pmod(F.col("h"), F.lit(64)))
    some = parts.withColumn("n", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("h", "value"))).filter(f"n <= {-(-sample // 64)}")
    by: dict[str, Counter] = {k: Counter() for k in (*KINDS[:3], "none")}
    for kind, value in some.select("kind", "value").collect():  # at most 4 * sample short strings
        by[kind][value] += 1
    return automata_of(by)


def automata_of(by: dict[str, Counter]) -> dict[str, Automaton]:
    """An automaton a kind, and the background, "none": that of the ordinary candidates' first layer, a letter table with lengths, so that the few credentials
    among them leave no grammar of their own in it. Those that a credential automaton tells from it at half the margin are taken out of it, again and again."""
    found = {k: infer(c) for k, c in by.items() if k != "none" and sum(c.values()) >= MIN_TRAIN}
    plain = by["none"]
    while True:  # each round takes some out or is the last
        background = infer(plain, depth=0)
        kept = Counter({s: n for s, n in plain.items() if not found or max(a.bits(s) for a in found.values()) - background.bits(s) < MARGIN / 2 * len(s)})
        if len(kept) == len(plain):
            return found | {"none": background}
        plain = kept


def format_spans(text: str | None, spans: list[tuple[int, int, int]], automata: dict[str, Automaton], margin: float = MARGIN):
    background = automata["none"]
    kinds = [a for k, a in automata.items() if k != "none"]
    for start, end in uncovered_candidates(text, spans):
        token = text[start:end]
        if kinds and max(a.bits(token) for a in kinds) - background.bits(token) >= margin * len(token):
            yield start, 3, end


def scan_secrets(docs: DataFrame, automata: dict[str, Automaton] | None = None) -> DataFrame:
    """Per row of docs: doc_id, starts, ends, kinds (parallel lists by start, then kind)."""
    known = learn_automata(docs) if automata is None else automata

    def make():
        def each(ids, text):
            found = [sorted([*s, *format_spans(t, s, known)]) for t, s in ((t, base_spans(t)) for t in text)]
            return ids, [[x[0] for x in f] for f in found], [[x[2] for x in f] for f in found], [[KINDS[x[1]] for x in f] for f in found]

        return each

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(texts(docs), make, f"doc_id {id_type}, starts array<long>, ends array<long>, kinds array<string>")


def redact_secrets(docs: DataFrame, automata: dict[str, Automaton] | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mask (overlapping spans by one) and n_chars counted anew where it is a column."""
    known = learn_automata(docs) if automata is None else automata

    def clean(text: str | None) -> str | None:
        base = base_spans(text)
        spans = sorted((s, e) for s, _, e in [*base, *format_spans(text, base, known)])
        if not spans:
            return text
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    texts(docs.select("doc_id", "text"))
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    joined = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"]))
    base = F.filter(joined, lambda x: ~x.startswith("format:"))
    return found.select(
        "doc_id", *[n(k) for k in KINDS[:3]], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(joined, ",").alias("spans"),
        F.size(F.filter("kinds", lambda x: x == "format")).cast("long").alias("n_format"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
SQL: dict[str, str] = {}
