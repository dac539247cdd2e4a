"""The registered queries over the driver's tables, and the SQL that says the same.

Documents serve as reference text (one file a language, one fragment a document) and, through the simulator, as reads; benchmark items
are reads for the search of contamination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scoring, table
from .functions.alphabet import PAIRS, code, differing, encode_text, hamming, pair_codes, quarters, reverse_complement, uncode
from .operators import align, choose, gapped, reads, simulate, stored, text
from .plans.config import AlignConfig
from .sources import sequences
from .sources.blocks import scratch_path

CONFIG = AlignConfig()
L = CONFIG.seed_length
LENGTH = 40


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents")


def _fragments(spark, d):
    return text.fragments_of_documents(_docs(spark, d))


def _reads(spark, d):
    return reads.prepare(simulate.reads_of_documents(_docs(spark, d), LENGTH))


def _matches(spark, d, scored=False):
    m = align.seed_matches(_fragments(spark, d), _reads(spark, d), CONFIG)
    return align.with_score(m, CONFIG, True) if scored else m


def _once(spark, d):
    """Whether no two documents share a number, so that no two reads or fragments do."""
    return _docs(spark, d).groupBy("doc_id").count().filter("count > 1").isEmpty()


def _all(spark, d, scored=False):
    return align.distinct_hits(_fragments(spark, d), _reads(spark, d), CONFIG, scored, _once(spark, d))


def _telling(spark, d, scored=False):
    return align.telling_hits(_fragments(spark, d), _reads(spark, d), CONFIG, scored)


def _hit(df, *more):
    return df.select("read_ord", "strand", "file_ord", "frag_ord", F.col("pos").cast("long").alias("pos"), F.col("k").cast("int").alias("k"), *more)


def q_encode_text(spark, d):
    return _docs(spark, d).select("doc_id", encode_text(F.col("text")).alias("seq"))


def q_base_composition(spark, d):
    seq = _fragments(spark, d)
    counts = F.array(*[F.struct(F.lit(b).alias("base"), (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias("n")) for b in "ACGT"])
    return seq.select("file_ord", F.inline(counts)).groupBy("file_ord", "base").agg(F.sum("n").alias("n"))


def q_read_count(spark, d):
    r = _reads(spark, d)
    return r.agg(F.count("*").alias("n_reads"), F.min_by("len", "read_ord").alias("first_len"))


#: As encode_text, but q, x and z become N.
MASKED = "".join("N" if c in "qxz" else "CGTA"[i % 4] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"))


def _masked_text(spark, d):
    """Documents as fragments in which some letters are unknown."""
    raw = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", MASKED)
    return _docs(spark, d).select(F.lit(0).alias("file_ord"), F.col("doc_id").alias("frag_ord"), F.col("doc_id").cast("string").alias("ref_id"), raw.alias("seq"), F.length(raw).alias("len"))


TILE = 60


def _masked(spark, d):
    """Every document as consecutive reads of TILE bases in which some letters are unknown; the last is as long as what is left."""
    tiles = text.pieces(_masked_text(spark, d), TILE, 0)
    return reads.prepare(tiles.select((F.col("frag_ord") * 1_000_000 + F.col("no")).alias("read_ord"), F.col("piece").alias("raw")))


def q_dontcare_filter(spark, d):
    return _masked(spark, d).select("read_ord", "seq", "len", "has_n", ((F.col("len") >= L) & ~F.col("has_n")).alias("usable"))


def q_read_length_buckets(spark, d):
    return reads.length_buckets(_masked(spark, d))


def q_rewrite_order(spark, d):
    return reads.rewrite_order(_masked(spark, d)).select("read_ord", "len", "has_n", F.col("new_ord").cast("long").alias("new_ord"))


def q_revcomp(spark, d):
    r = _reads(spark, d)
    return r.select("read_ord", reverse_complement(F.col("seq")).alias("rc"))


def q_quality_offset(spark, d):
    raw = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    return reads.quality_offset(_reads(spark, d).select("read_ord", raw.alias("quality_raw")))


def q_windows(spark, d):
    w = text.windows(_fragments(spark, d), L)
    return w.groupBy("file_ord", "frag_ord").agg(F.count("*").alias("n_windows"), F.min("seed").alias("first_seed"), F.max("seed").alias("last_seed"), F.sum(F.col("pos").cast("long")).alias("sum_pos"))


def q_seed_signatures(spark, d):
    m = quarters(F.substring("seq", 1, L), L)
    return _reads(spark, d).select("read_ord", *[code(x).alias(f"m{i}") for i, x in enumerate(m)])


def q_pair_signatures(spark, d):
    return _reads(spark, d).select("read_ord", F.inline(pair_codes([code(x) for x in quarters(F.substring("seq", 1, L), L)], L)))


def q_signature_histogram(spark, d):
    return text.windows(_fragments(spark, d), L).groupBy(F.substring("seed", 1, 6).alias("prefix")).agg(F.count("*").alias("n"))


def _truth(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("read_ord"), encode_text(F.col("text")).alias("s"))
    r = _reads(spark, d).join(docs, "read_ord")
    own = F.when(F.col("read_ord") % 2 == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return r.select("read_ord", own.alias("own"), F.substring("s", F.col("truth_pos") + 1, F.lit(LENGTH)).alias("there"))


def q_hamming_codes(spark, d):
    q = lambda c: code(F.substring(c, 1, 16))
    return _truth(spark, d).select("read_ord", differing(q("own"), q("there")).alias("differing"), hamming(F.col("own"), F.col("there")).alias("distance"))


def q_rest_distance(spark, d):
    tail = lambda c: F.substring(c, L + 1, LENGTH - L)
    return _truth(spark, d).select("read_ord", hamming(tail("own"), tail("there")).alias("rest"))


def q_fragment_starts(spark, d):
    return text.fragment_starts(_fragments(spark, d)).select("file_ord", "frag_ord", *[F.col(c).cast("long").alias(c) for c in ("start", "next_start")])


def q_position_to_fragment(spark, d):
    """The first and the last position of every fragment, found again from the position alone."""
    starts = text.fragment_starts(_fragments(spark, d))
    ends = F.array_distinct(F.array(F.col("start"), F.col("next_start") - 1))
    positions = starts.select("file_ord", F.explode(ends).alias("p"))
    return text.locate(positions, starts).select("file_ord", F.col("p").cast("long").alias("p"), "frag_ord", F.col("pos").cast("long").alias("pos"))


def q_odds_matrix(spark, d):
    rows = [(k[0], k[1], v, scoring.log_odds(CONFIG)[k]) for k, v in scoring.odds(CONFIG).items()]
    return spark.createDataFrame(rows, "ref_base string, read_base string, odds double, log2_odds double").select("ref_base", "read_base", F.round("odds", 9).alias("odds"), F.round("log2_odds", 9).alias("log2_odds"))


def q_score_table(spark, d):
    base = spark.createDataFrame([(k[0], k[1], v) for k, v in scoring.log_odds(CONFIG).items()], "ref_base string, read_base string, v double")
    certain = F.array(*[F.lit(1 - e) for e in scoring.ERROR_OF_QUALITY])
    each = base.withColumn("quality", F.explode(F.sequence(F.lit(0), F.lit(62))))
    return each.select("ref_base", "read_base", "quality", (F.round(F.col("v") * F.element_at(certain, F.col("quality") + 1), 6) + F.lit(0.0)).alias("entry"))


def q_filter_value(spark, d):
    lens = _masked(spark, d).select("len").distinct()
    each = F.array(*[F.struct(F.lit(v).alias("level"), F.round(CONFIG.with_(filter_level=v).epsilon(F.col("len")), 6).alias("epsilon")) for v in range(5)])
    return lens.select("len", F.inline(each))


def q_align_all(spark, d):
    return _hit(_all(spark, d))


def q_align_all_scored(spark, d):
    return _hit(_all(spark, d, True), F.round("score", 4).alias("score"))


def q_align_all_ranked(spark, d):
    hits = align.ranked(_all(spark, d))
    order = Window.partitionBy("read_ord").orderBy("k", "pos", "file_ord", "frag_ord", "strand")
    return _hit(hits.withColumn("rank", F.row_number().over(order)), "rank")


def q_hits_per_read(spark, d):
    counts = align.hit_counts(_fragments(spark, d), _reads(spark, d), CONFIG, _once(spark, d))
    return counts.select("read_ord", "n_hits", F.col("least_k").cast("int").alias("least_k"))


def q_align_unique(spark, d):
    return _hit(choose.unique_by_errors(_telling(spark, d)))


def q_unique_count(spark, d):
    return choose.unique_by_errors(_telling(spark, d)).groupBy("strand").agg(F.count("*").alias("n_unique"))


def q_align_unique_scored_canonical(spark, d):
    return _hit(choose.unique_by_score(_telling(spark, d, True), CONFIG), F.round("score", 4).alias("score"))


def q_align_unique_scored_fold(spark, d):
    return _hit(choose.unique_by_fold(align.telling_events(_fragments(spark, d), _reads(spark, d), CONFIG), CONFIG), F.round("score", 4).alias("score"))


def q_matched_reads(spark, d):
    return align.matched(_reads(spark, d), _telling(spark, d)).select("read_ord")


def q_unmatched_reads(spark, d):
    return align.unmatched(_reads(spark, d), _telling(spark, d)).select("read_ord")


def q_alignment_report(spark, d):
    best = choose.unique_by_score(_telling(spark, d, True), CONFIG)
    out = choose.report(best, _reads(spark, d), _fragments(spark, d), True)
    return out.withColumn("score", F.round("score", 4))


def q_simulate_reads(spark, d):
    return simulate.reads_of_documents(_docs(spark, d), LENGTH).select("read_ord", "read_id", "raw", F.array_join(F.transform("qual", lambda x: x.cast("string")), ",").alias("qual"))


def q_random_text(spark, d):
    return simulate.random_text(spark, 60_000)


ITEM = 36


def q_contamination_hits(spark, d):
    """Whole benchmark items as reads of ITEM bases (or the item's own, down to a seed's), one after the other and one at the end, against all documents."""
    items = _table(spark, d, "benchmark").select("item_id", encode_text(F.col("text")).alias("s")).filter(F.length("s") >= L)
    items = items.withColumn("m", F.least(F.lit(ITEM), F.length("s")))
    last = F.length("s") - F.col("m")
    each = items.select("item_id", "s", "m", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.col("m")), F.array(last)))).alias("at"))
    each = each.select((F.col("item_id") * 100_000 + F.col("at")).alias("read_ord"), F.substr("s", F.col("at") + 1, F.col("m")).alias("raw"))
    return _hit(align.all_hits(align.seed_matches(_fragments(spark, d), reads.prepare(each), CONFIG)))


def q_align_masked_text(spark, d):
    """All hits in documents with unknown letters: no window may hold one."""
    m = align.distinct_hits(_masked_text(spark, d), _reads(spark, d), CONFIG, once=_once(spark, d))
    return m.select("read_ord", "strand", "frag_ord", F.col("pos").cast("long").alias("pos"), F.col("k").cast("int").alias("k"))


def q_windows_dontcare_free(spark, d):
    """How many windows of each document hold no unknown letter."""
    return text.windows(_masked_text(spark, d), L).groupBy("frag_ord").agg(F.count("*").alias("n_windows"), F.sum(F.col("pos").cast("long")).alias("sum_pos"))


def q_bases_of_codes(spark, d):
    """Seeds to codes and back."""
    m = quarters(F.substring("seq", 1, L), L)
    return _reads(spark, d).select("read_ord", F.concat(*[uncode(code(x), L // 4) for x in m]).alias("seed"))


def q_score_of_probabilities(spark, d):
    """Scores of bases whose four call probabilities are known, on a grid of them."""
    grid = [(0.25, 0.25, 0.25, 0.25), (1.0, 0.0, 0.0, 0.0), (0.1, 0.2, 0.3, 0.4), (0.0, 0.5, 0.5, 0.0), (0.05, 0.05, 0.05, 0.85)]
    rows = [(x, *p, scoring.odds_of_probabilities(CONFIG, x, *p)) for x in "ACGT" for p in grid]
    return spark.createDataFrame(rows, "ref_base string, a double, c double, g double, t double, score double").withColumn("score", F.round("score", 6))


def q_reads_as_fastq(spark, d):
    """The simulated reads as FASTQ records, truth in the ids."""
    return sequences.fastq_lines(_reads(spark, d), 33)


def q_quality_offset_64(spark, d):
    raw = F.array_join(F.transform("qual", lambda q: F.char(q + 64)), "")
    return reads.quality_offset(_reads(spark, d).select("read_ord", raw.alias("quality_raw")))


def q_align_hits_in_sql(spark, d):
    """All hits by the table function, in SQL text."""
    table.register(spark, _fragments(spark, d), _reads(spark, d), CONFIG, "quillon_meetings")
    return spark.sql(f"""SELECT DISTINCT read_ord, strand, file_ord, frag_ord, pos, k FROM align_hits(TABLE(quillon_meetings) PARTITION BY (pair_idx, key) ORDER BY side,
      seed_length => {L}, seed_mismatches => {CONFIG.seed_mismatches}, total_mismatches => {CONFIG.total_mismatches})""")


def q_align_indexed(spark, d):
    """All hits with one mismatch at most in the seed, from an index of the documents that is written first and opened again."""
    frag, path, config = _fragments(spark, d), scratch_path(spark, "index"), CONFIG.with_(seed_mismatches=1)
    stored.write_index(frag, frag, path, config, LENGTH)
    return _hit(align.all_hits(stored.indexed_matches(stored.open_index(spark, path), _reads(spark, d), config)))


PART = 70


def _spliced(spark, d):
    """One read from each document of 200 bases or more, PART of its bases with one to three left out, or put in, after the seed."""
    own = _docs(spark, d).filter("doc_id is not null").select("doc_id", F.inline(F.array(F.struct(encode_text(F.col("text")).alias("s"))))).filter(F.length("s") >= 200)
    place = (F.col("doc_id") * 7919 % (F.length("s") - (PART + 10))).cast("int")
    part = own.select("doc_id", F.substr("s", place + 1, F.lit(PART)).alias("part"), (36 + F.col("doc_id") % 20).cast("int").alias("cut"), (F.col("doc_id") % 3 + 1).cast("int").alias("gap"))
    new = F.translate(F.substr("part", F.col("cut") + 1, F.col("gap")), "ACGT", "GTAC")
    out = F.col("doc_id") % 4 < 2
    tail = F.when(out, F.substr("part", F.col("cut") + F.col("gap") + 1, F.lit(PART))).otherwise(F.concat(new, F.substr("part", F.col("cut") + 1, F.lit(PART))))
    qual = F.transform(F.sequence(F.lit(0), F.lit(PART + 3)), lambda j: (20 + (F.col("doc_id") * 13 + j * 7) % 20).cast("int"))
    return reads.prepare(part.select(F.col("doc_id").alias("read_ord"), F.concat(F.left("part", F.col("cut")), tail).alias("raw"), qual.alias("qual")))


def q_align_gapped(spark, d):
    """Spliced reads that have no hit without a gap: where they lie with one."""
    frag, own = _fragments(spark, d), _spliced(spark, d)
    best = gapped.align_gapped(frag, own, align.telling_hits(frag, own, CONFIG), CONFIG)
    return best.select("read_ord", "file_ord", "frag_ord", "pos", "gap", "gap_in", "gap_pos", "loci", F.round("score", 4).alias("score"))


QUERIES = {k.removeprefix("q_"): f for k, f in list(globals().items()) if k.startswith("q_")}

# --- the same in SQL ---

_ENC = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'CGTACGTACGTACGTACGTACGTACG')"
_RC = "translate(reverse({0}), 'ACGT', 'TGCA')".format
_DIFF = "len(list_filter(range(1, length({0}) + 1), lambda j: substr({0}, j, 1) != substr({1}, j, 1)))".format
_FRAG = f"frag AS (SELECT * FROM (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS file_ord, doc_id AS frag_ord, CAST(doc_id AS VARCHAR) AS ref_id, {_ENC} AS seq FROM documents) WHERE length(seq) > 0)"
_READS = f"""src AS (SELECT doc_id, s, doc_id * 7919 % (length(s) - {LENGTH}) AS place FROM (SELECT doc_id, {_ENC} AS s FROM documents) WHERE length(s) >= 200),
part AS (SELECT doc_id, place, substr(s, CAST(place + 1 AS BIGINT), {LENGTH}) AS p FROM src),
mut AS (SELECT *, list_transform(range(0, {LENGTH}), lambda j: (doc_id * 31 + j * j * 17) % (7 + doc_id % 17) = 0) AS hit FROM part),
new AS (SELECT *, array_to_string(list_transform(range(0, {LENGTH}), lambda j: CASE WHEN hit[j + 1] THEN translate(substr(p, j + 1, 1), 'ACGT', 'CGTA') ELSE substr(p, j + 1, 1) END), '') AS n FROM mut),
reads AS (SELECT doc_id AS read_ord, place, p, CASE WHEN doc_id % 2 = 1 THEN {_RC('n')} ELSE n END AS seq,
  'p' || place || CASE WHEN doc_id % 2 = 1 THEN '_inv' ELSE '' END || coalesce(array_to_string(list_transform(list_filter(range(0, {LENGTH}), lambda j: hit[j + 1]), lambda j: '_' || j || substr(p, j + 1, 1) || translate(substr(p, j + 1, 1), 'ACGT', 'CGTA')), ''), '') AS read_id,
  list_transform(range(0, {LENGTH}), lambda j: 20 + (doc_id * 13 + j * 7) % 20) AS qual FROM new)"""


def _seeded(frag: str, reads_cte: str, s: int, e: int) -> str:
    """CTEs up to events: windows and reads whose seeds are near by the definition, each hit once for each pair of quarters that agree.

    Seeds of two mismatches or less agree in one of three parts, another cut than the engine's; the tests hold both against all pairs."""
    q, t = L // 4, L // 3
    third = lambda c: f"left({c}, {t}), substr({c}, {t + 1}, {t}), substr({c}, {2 * t + 1})"
    agree = [f"substr(seed, {i * q + 1}, {q}) = substr(rseed, {i * q + 1}, {q})" for i in range(4)]
    pairs = ", ".join(f"CASE WHEN {agree[a]} AND {agree[b]} THEN {i} END" for i, (a, b) in enumerate(PAIRS))
    return f"""{frag}, {reads_cte},
win AS (SELECT file_ord, frag_ord, place, substr(seq, CAST(place + 1 AS BIGINT), {L}) AS seed FROM (SELECT file_ord, frag_ord, seq, unnest(range(0, length(seq) - {L - 1})) AS place FROM frag)),
two AS (SELECT read_ord, '+' AS strand, seq AS w, substr(seq, 1, {L}) AS rseed, length(seq) AS m, qual AS q FROM reads WHERE length(seq) >= {L}
  UNION ALL SELECT read_ord, '-', {_RC('seq')}, right({_RC('seq')}, {L}), length(seq), list_reverse(qual) FROM reads WHERE length(seq) >= {L}),
cut AS (SELECT *, unnest([{third('seed')}]) AS part, unnest([0, 1, 2]) AS no FROM win WHERE NOT contains(seed, 'N')), rcut AS (SELECT *, unnest([{third('rseed')}]) AS part, unnest([0, 1, 2]) AS no FROM two),
near AS (SELECT DISTINCT file_ord, frag_ord, place, seed, read_ord, strand, w, rseed, m, q FROM cut JOIN rcut USING (no, part) WHERE hamming(seed, rseed) <= {s}),
met AS (SELECT *, CASE WHEN strand = '+' THEN place ELSE place - (m - {L}) END AS pos, unnest(list_filter([{pairs}], lambda i: i IS NOT NULL)) AS pair_idx FROM near),
placed AS (SELECT met.*, substr(f.seq, CAST(pos + 1 AS BIGINT), m) AS ref FROM met JOIN frag f ON f.file_ord = met.file_ord AND f.frag_ord = met.frag_ord WHERE pos >= 0 AND pos + m <= length(f.seq)),
events AS (SELECT *, hamming(ref, w) AS k FROM placed WHERE hamming(ref, w) <= {e} AND NOT contains(ref, 'N'))"""


_LL = "[" + ", ".join(repr(scoring.log_odds(CONFIG)[a + b]) + "::DOUBLE" for a in "ACGT" for b in "ACGT") + "]"
_QE = "[" + ", ".join(f"{e!r}::DOUBLE" for e in scoring.ERROR_OF_QUALITY) + "]"
_SCORE = f"1 + list_sum(list_transform(range(1, m + 1), lambda j: ({_LL})[4 * (strpos('ACGT', substr(ref, j, 1)) - 1) + strpos('ACGT', substr(w, j, 1))] * (1 - ({_QE})[q[j] + 1])))"
_S, _E = CONFIG.seed_mismatches, CONFIG.total_mismatches
_EVENTS = "WITH " + _seeded(_FRAG, _READS, _S, _E)
_SCORED = _EVENTS + f", scored AS (SELECT *, {_SCORE} AS score FROM events)"
_OUT = "read_ord, strand, CAST(file_ord AS INT) AS file_ord, frag_ord, CAST(pos AS BIGINT) AS pos, CAST(k AS INT) AS k"
_EPS = f"m * {CONFIG.total_mismatches} / 70.0"
_MASKED_TEXT = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{MASKED}')"
_MASK_FRAG = f"frag AS (SELECT 0 AS file_ord, doc_id AS frag_ord, {_MASKED_TEXT} AS seq FROM documents)"
_MASK_READS = f"""whole AS (SELECT doc_id, {_MASKED_TEXT} AS s FROM documents),
masked AS (SELECT doc_id * 1000000 + i AS read_ord, substr(s, i * {TILE} + 1, {TILE}) AS seq FROM (SELECT *, unnest(range(0, CAST(ceil(length(s) / {TILE}.0) AS BIGINT))) AS i FROM whole))"""
_UNIQUE = """, locus AS (SELECT read_ord, file_ord, frag_ord, pos, min(k) AS k, arg_min(strand, {'k': k, 's': strand}) AS strand FROM events GROUP BY ALL),
low AS (SELECT *, min(k) OVER (PARTITION BY read_ord) AS e FROM locus), one AS (SELECT *, count(*) OVER (PARTITION BY read_ord) AS n FROM low WHERE k = e)"""
_CANON = f""", locus AS (SELECT read_ord, m, file_ord, frag_ord, pos, max({{'score': score, 'plus': strand = '+', 'nk': -k}}) AS b FROM scored GROUP BY ALL),
top AS (SELECT *, max(b.score) OVER (PARTITION BY read_ord) AS best FROM locus),
one AS (SELECT *, count(*) OVER (PARTITION BY read_ord) AS n FROM top WHERE b.score > best - {_EPS} OR b.score = best),
best AS (SELECT read_ord, file_ord, frag_ord, pos, CASE WHEN b.plus THEN '+' ELSE '-' END AS strand, -b.nk AS k, b.score AS score FROM one WHERE n = 1)"""
_CODE = lambda c: f"CAST(list_sum(list_transform(range(1, length({c}) + 1), lambda i: (strpos('ACGT', substr({c}, i, 1)) - 1) * CAST(pow(4, length({c}) - i) AS BIGINT))) AS BIGINT)"
_STARTS = "starts AS (SELECT file_ord, frag_ord, sum(length(seq)) OVER (PARTITION BY file_ord ORDER BY frag_ord) - length(seq) AS start, sum(length(seq)) OVER (PARTITION BY file_ord ORDER BY frag_ord) AS next_start FROM frag)"


def _odds_sql() -> str:
    c = CONFIG
    bias, change = c.gc_bias * (1 - c.gc) / c.gc, 1 - c.similarity
    return f"""WITH b(x) AS (VALUES ('A'), ('C'), ('G'), ('T')),
p AS (SELECT r.x AS ref_base, d.x AS read_base, CASE WHEN r.x = d.x THEN NULL ELSE {change!r}::DOUBLE * CASE WHEN r.x || d.x IN ('AG', 'GA', 'CT', 'TC') THEN {c.transitions!r}::DOUBLE ELSE {(1 - c.transitions) / 2!r}::DOUBLE END
  / {bias + 1!r}::DOUBLE * CASE WHEN r.x IN ('G', 'C') THEN {bias / c.gc!r}::DOUBLE ELSE {1 / (1 - c.gc)!r}::DOUBLE END END AS moved FROM b r, b d),
o AS (SELECT ref_base, read_base, coalesce(moved, 1 - sum(moved) OVER (PARTITION BY ref_base)) * {1 - c.error_rate!r}::DOUBLE / CASE WHEN read_base IN ('G', 'C') THEN {c.gc / 2!r}::DOUBLE ELSE {(1 - c.gc) / 2!r}::DOUBLE END AS odds FROM p)"""


_FOLD = f""", ev AS (SELECT read_ord, list({{'st': 0, 'f': CAST(file_ord AS BIGINT), 'g': frag_ord, 'p': CAST(pos AS BIGINT), 's': strand, 'k': CAST(k AS BIGINT), 'v': score, 'e': {_EPS}::DOUBLE}} ORDER BY file_ord, strand, pair_idx, frag_ord, pos) AS es FROM scored GROUP BY read_ord),
fold AS (SELECT read_ord, list_reduce(es, lambda a, x: CASE
  WHEN a.st = 0 OR x.v > a.v + x.e THEN {{'st': 1, 'f': x.f, 'g': x.g, 'p': x.p, 's': x.s, 'k': x.k, 'v': x.v, 'e': x.e}}
  WHEN a.st = 1 AND x.v > a.v - x.e AND NOT (a.f = x.f AND a.g = x.g AND a.p = x.p) THEN {{'st': 2, 'f': a.f, 'g': a.g, 'p': a.p, 's': a.s, 'k': a.k, 'v': a.v, 'e': a.e}}
  ELSE a END, {{'st': 0, 'f': 0::BIGINT, 'g': 0::BIGINT, 'p': 0::BIGINT, 's': '', 'k': 0::BIGINT, 'v': 0::DOUBLE, 'e': 0::DOUBLE}}) AS r FROM ev)"""

_SPLICED = f"""src AS (SELECT doc_id, s, doc_id * 7919 % (length(s) - {PART + 10}) AS place FROM (SELECT doc_id, {_ENC} AS s FROM documents) WHERE length(s) >= 200),
part AS (SELECT doc_id, substr(s, CAST(place + 1 AS BIGINT), {PART}) AS p, 36 + doc_id % 20 AS cut, doc_id % 3 + 1 AS gap FROM src),
reads AS (SELECT doc_id AS read_ord, left(p, cut) || CASE WHEN doc_id % 4 < 2 THEN substr(p, cut + gap + 1) ELSE translate(substr(p, cut + 1, gap), 'ACGT', 'GTAC') || substr(p, cut + 1) END AS seq,
  list_transform(range(0, {PART + 4}), lambda j: 20 + (doc_id * 13 + j * 7) % 20) AS qual FROM part)"""
# every cell of the seven diagonals; scores in billionths
_GAPPED = f""", cand AS (SELECT row_number() OVER () AS c, * FROM (SELECT DISTINCT n.read_ord, n.file_ord, n.frag_ord, n.place, seed, w, q, m - {L} AS m, substr(f.seq, CAST(n.place + {L} + 1 AS BIGINT), 2 * m) AS t
  FROM near n JOIN frag f ON f.file_ord = n.file_ord AND f.frag_ord = n.frag_ord WHERE strand = '+' AND read_ord NOT IN (SELECT read_ord FROM events)) WHERE length(t) > 0 AND m > 0),
cell AS (SELECT c, off, k, t, w, q, k + greatest(off, 0) AS i, k + greatest(-off, 0) AS j FROM (SELECT *, unnest(range(-3, 4)) AS off FROM cand), range(1, 101) r(k) WHERE k + greatest(off, 0) <= length(t) AND k + greatest(-off, 0) <= m),
value AS (SELECT c, off, k, CAST(round(({_LL})[4 * (strpos('ACGT', substr(t, CAST(i AS BIGINT), 1)) - 1) + strpos('ACGT', substr(w, CAST({L} + j AS BIGINT), 1))] * (1 - ({_QE})[q[{L} + j] + 1]) * 1e9) AS BIGINT) AS v FROM cell),
summed AS (SELECT c, off, k, CAST(sum(v) OVER (PARTITION BY c, off ORDER BY k) AS BIGINT) AS s FROM value),
lead AS (SELECT x.c, x.off, x.k, x.s, CASE WHEN x.off = 0 THEN 0 ELSE d.s - x.s END AS a FROM summed x JOIN summed d ON d.c = x.c AND d.k = x.k AND d.off = 0),
most AS (SELECT *, greatest(0, max(a) OVER (PARTITION BY c, off ORDER BY k)) AS top, greatest(0, coalesce(max(a) OVER (PARTITION BY c, off ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM lead),
done AS (SELECT c, off, k, s + top AS g, max(CASE WHEN a > before THEN k ELSE 0 END) OVER (PARTITION BY c, off ORDER BY k) AS gap_pos FROM most),
ends AS (SELECT d.*, n.read_ord, n.file_ord, n.frag_ord, n.place, n.seed, n.w, n.q, CASE WHEN d.k + greatest(-d.off, 0) = n.m THEN d.off ELSE 10 - d.off END AS turn, g + 1000000000 * (-1 - abs(off) - CASE WHEN abs(off) % 3 = 0 THEN 1 ELSE 0 END) AS total
  FROM done d JOIN cand n USING (c) WHERE g >= -100000000000 AND (d.k + greatest(-d.off, 0) = n.m OR d.off >= 0 AND n.m + 3 > length(n.t) AND d.k = length(n.t) - d.off AND d.k < n.m)),
chosen AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY c ORDER BY total DESC, turn) = 1),
scored AS (SELECT *, 1000000000 + total + CAST(list_sum(list_transform(range(1, {L + 1}), lambda j: CAST(round(({_LL})[4 * (strpos('ACGT', substr(seed, j, 1)) - 1) + strpos('ACGT', substr(w, j, 1))] * (1 - ({_QE})[q[j] + 1]) * 1e9) AS BIGINT))) AS BIGINT) AS score FROM chosen WHERE off != 0),
tops AS (SELECT *, count(*) OVER (PARTITION BY read_ord) AS loci FROM (SELECT *, max(score) OVER (PARTITION BY read_ord) AS top FROM scored) WHERE score >= top - 1000)
SELECT read_ord, CAST(file_ord AS INT) AS file_ord, frag_ord, place AS pos, CAST(abs(off) AS INT) AS gap, CASE WHEN off < 0 THEN 'text' ELSE 'read' END AS gap_in, CAST(gap_pos AS INT) AS gap_pos, loci, round(score / 1e9, 4) AS score
FROM tops QUALIFY row_number() OVER (PARTITION BY read_ord ORDER BY score DESC, file_ord, frag_ord, place) = 1"""

SQL = {
    "encode_text": f"SELECT doc_id, {_ENC} AS seq FROM documents",
    "base_composition": f"WITH {_FRAG} SELECT CAST(file_ord AS INT) AS file_ord, base, CAST(sum(length(seq) - length(replace(seq, base, ''))) AS BIGINT) AS n FROM frag, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY ALL",
    "read_count": f"WITH {_READS} SELECT count(*) AS n_reads, CAST(arg_min(length(seq), read_ord) AS INT) AS first_len FROM reads",
    "dontcare_filter": f"WITH {_MASK_READS} SELECT read_ord, seq, CAST(length(seq) AS INT) AS len, contains(seq, 'N') AS has_n, length(seq) >= {L} AND NOT contains(seq, 'N') AS usable FROM masked",
    "read_length_buckets": f"WITH {_MASK_READS} SELECT CAST(length(seq) AS INT) AS len, contains(seq, 'N') AS has_n, count(*) AS n_reads FROM masked GROUP BY ALL",
    "rewrite_order": f"WITH {_MASK_READS} SELECT read_ord, CAST(length(seq) AS INT) AS len, contains(seq, 'N') AS has_n, row_number() OVER (ORDER BY length(seq), contains(seq, 'N'), read_ord) - 1 AS new_ord FROM masked",
    "revcomp": f"WITH {_READS} SELECT read_ord, {_RC('seq')} AS rc FROM reads",
    "quality_offset": f"WITH {_READS}, c AS (SELECT read_ord, unnest(qual) + 33 AS o, unnest(range(0, {LENGTH})) AS i FROM reads), x AS (SELECT arg_min(o, read_ord * 1000 + i) AS o FROM c WHERE o <= 54 OR o >= 94) SELECT CASE WHEN o IS NULL THEN 0 WHEN o <= 54 THEN 33 ELSE 64 END AS quality_offset FROM x",
    "windows": f"WITH {_FRAG}, w AS (SELECT file_ord, frag_ord, seq, unnest(range(0, length(seq) - {L - 1})) AS pos FROM frag) SELECT CAST(file_ord AS INT) AS file_ord, frag_ord, count(*) AS n_windows, min(substr(seq, CAST(pos + 1 AS BIGINT), {L})) AS first_seed, max(substr(seq, CAST(pos + 1 AS BIGINT), {L})) AS last_seed, CAST(sum(pos) AS BIGINT) AS sum_pos FROM w GROUP BY ALL",
    "seed_signatures": f"WITH {_READS}, m AS (SELECT read_ord, " + ", ".join(f"substr(seq, {i * L // 4 + 1}, {L // 4}) AS s{i}" for i in range(4)) + " FROM reads) SELECT read_ord, " + ", ".join(f"{_CODE(f's{i}')} AS m{i}" for i in range(4)) + " FROM m",
    "pair_signatures": f"WITH {_READS}, k AS (" + " UNION ALL ".join(f"SELECT read_ord, {i} AS pair_idx, substr(seq, {a * L // 4 + 1}, {L // 4}) || substr(seq, {b * L // 4 + 1}, {L // 4}) AS s FROM reads" for i, (a, b) in enumerate(PAIRS)) + f") SELECT read_ord, pair_idx, {_CODE('s')} AS key FROM k",
    "signature_histogram": f"WITH {_FRAG}, w AS (SELECT seq, unnest(range(0, length(seq) - {L - 1})) AS pos FROM frag) SELECT substr(seq, CAST(pos + 1 AS BIGINT), 6) AS prefix, count(*) AS n FROM w GROUP BY ALL",
    "hamming_codes": f"WITH {_READS}, t AS (SELECT read_ord, p, CASE WHEN read_ord % 2 = 1 THEN {_RC('seq')} ELSE seq END AS own FROM reads) SELECT read_ord, CAST({_DIFF('left(own, 16)', 'p')} AS INT) AS differing, CAST({_DIFF('own', 'p')} AS INT) AS distance FROM t",
    "rest_distance": f"WITH {_READS}, t AS (SELECT read_ord, right(p, {LENGTH - L}) AS p, right(CASE WHEN read_ord % 2 = 1 THEN {_RC('seq')} ELSE seq END, {LENGTH - L}) AS own FROM reads) SELECT read_ord, CAST({_DIFF('own', 'p')} AS INT) AS rest FROM t",
    "fragment_starts": f"WITH {_FRAG}, {_STARTS} SELECT CAST(file_ord AS INT) AS file_ord, frag_ord, CAST(start AS BIGINT) AS start, CAST(next_start AS BIGINT) AS next_start FROM starts",
    "position_to_fragment": f"WITH {_FRAG}, {_STARTS}, pos AS (SELECT DISTINCT file_ord, unnest([start, next_start - 1]) AS p FROM starts) SELECT CAST(s.file_ord AS INT) AS file_ord, CAST(p AS BIGINT) AS p, frag_ord, CAST(p - start AS BIGINT) AS pos FROM pos JOIN starts s ON s.file_ord = pos.file_ord AND p >= start AND p < next_start",
    "odds_matrix": _odds_sql() + " SELECT ref_base, read_base, round(odds, 9) AS odds, round(log2(odds), 9) AS log2_odds FROM o",
    "score_table": _odds_sql() + f" SELECT ref_base, read_base, CAST(q AS INT) AS quality, round(log2(odds) * (1 - ({_QE})[CAST(q + 1 AS BIGINT)]), 6) + 0::DOUBLE AS entry FROM o, range(0, 63) r(q)",
    "filter_value": f"WITH {_MASK_READS} SELECT DISTINCT CAST(length(seq) AS INT) AS len, level, round(length(seq) * mult * {CONFIG.total_mismatches} / 70.0, 6) AS epsilon FROM masked, (VALUES (0, 0.0::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE), (3, 2.0::DOUBLE), (4, 3.0::DOUBLE)) v(level, mult)",
    "align_all": f"{_EVENTS} SELECT DISTINCT {_OUT} FROM events",
    "align_all_scored": f"{_SCORED} SELECT DISTINCT {_OUT}, round(score, 4) AS score FROM scored",
    "align_all_ranked": f"{_EVENTS}, h AS (SELECT DISTINCT {_OUT} FROM events) SELECT *, CAST(row_number() OVER (PARTITION BY read_ord ORDER BY k, pos, file_ord, frag_ord, strand) AS INT) AS rank FROM h",
    "hits_per_read": f"{_EVENTS}, h AS (SELECT DISTINCT {_OUT} FROM events) SELECT read_ord, count(*) AS n_hits, min(k) AS least_k FROM h GROUP BY read_ord",
    "align_unique": f"{_EVENTS}{_UNIQUE} SELECT {_OUT} FROM one WHERE n = 1",
    "unique_count": f"{_EVENTS}{_UNIQUE} SELECT strand, count(*) AS n_unique FROM one WHERE n = 1 GROUP BY strand",
    "align_unique_scored_canonical": f"{_SCORED}{_CANON} SELECT {_OUT}, round(score, 4) AS score FROM best",
    "align_unique_scored_fold": f"{_SCORED}{_FOLD} SELECT read_ord, r.s AS strand, CAST(r.f AS INT) AS file_ord, r.g AS frag_ord, r.p AS pos, CAST(r.k AS INT) AS k, round(r.v, 4) AS score FROM fold WHERE r.st = 1",
    "matched_reads": f"{_EVENTS} SELECT DISTINCT read_ord FROM events",
    "unmatched_reads": f"{_EVENTS} SELECT read_ord FROM reads WHERE read_ord NOT IN (SELECT read_ord FROM events)",
    "alignment_report": f"{_SCORED}{_CANON} SELECT read_id, CASE WHEN strand = '-' THEN {_RC('seq')} ELSE seq END AS seq, round(score, 4) AS score, 1 AS n_hits, 'a' AS pair, {LENGTH} AS len, strand, CAST(frag_ord AS VARCHAR) AS ref_id, CAST(pos + 1 AS BIGINT) AS pos, '' AS hit_type, CAST(k AS INT) AS errors FROM best JOIN reads USING (read_ord)",
    "simulate_reads": f"WITH {_READS} SELECT read_ord, read_id, seq AS raw, array_to_string(qual, ',') AS qual FROM reads",
    "random_text": "SELECT i // 60 AS line_no, string_agg(substr('ACGT', CAST(((((i + 1) * 1103515245 + 12345) % 2147483648) >> 16) % 4 + 1 AS BIGINT), 1), '' ORDER BY i) AS line FROM range(0, 60000) r(i) GROUP BY ALL",
    # every window against every part of every item, no seeds: the definition itself
    "contamination_hits": f"""WITH {_FRAG}, whole AS (SELECT item_id, {_ENC} AS s FROM benchmark),
sized AS (SELECT *, least({ITEM}, length(s)) AS m FROM whole WHERE length(s) >= {L}),
parts AS (SELECT DISTINCT item_id, s, m, unnest(list_append(range(0, length(s) - m + 1, m), length(s) - m)) AS place FROM sized),
items AS (SELECT item_id * 100000 + place AS read_ord, substr(s, CAST(place + 1 AS BIGINT), m) AS s FROM parts),
two AS (SELECT read_ord, '+' AS strand, s AS w, left(s, {L}) AS rseed FROM items UNION ALL SELECT read_ord, '-', {_RC('s')}, right({_RC('s')}, {L}) FROM items),
win AS (SELECT file_ord, frag_ord, place, substr(seq, CAST(place + 1 AS BIGINT), {L}) AS seed FROM (SELECT *, unnest(range(0, length(seq) - {L - 1})) AS place FROM frag)),
near AS (SELECT *, CASE WHEN strand = '+' THEN place ELSE place - (length(w) - {L}) END AS pos FROM win JOIN two ON hamming(seed, rseed) <= {_S}),
placed AS (SELECT near.*, substr(f.seq, CAST(pos + 1 AS BIGINT), length(w)) AS ref FROM near JOIN frag f ON f.file_ord = near.file_ord AND f.frag_ord = near.frag_ord WHERE pos >= 0 AND pos + length(w) <= length(f.seq))
SELECT read_ord, strand, CAST(file_ord AS INT) AS file_ord, frag_ord, CAST(pos AS BIGINT) AS pos, CAST(hamming(ref, w) AS INT) AS k FROM placed WHERE hamming(ref, w) <= {_E}""",
    "align_masked_text": "WITH " + _seeded(_MASK_FRAG, _READS, _S, _E) + " SELECT DISTINCT read_ord, strand, frag_ord, CAST(pos AS BIGINT) AS pos, CAST(k AS INT) AS k FROM events",
    "reads_as_fastq": f"WITH {_READS} SELECT read_ord, '@' || read_id || ' length=' || length(seq) || chr(10) || seq || chr(10) || '+' || chr(10) || array_to_string(list_transform(qual, lambda q: chr(CAST(q + 33 AS INT))), '') AS record FROM reads",
    "quality_offset_64": f"WITH {_READS}, c AS (SELECT read_ord, unnest(qual) + 64 AS o, unnest(range(0, {LENGTH})) AS i FROM reads), x AS (SELECT arg_min(o, read_ord * 1000 + i) AS o FROM c WHERE o <= 54 OR o >= 94) SELECT CASE WHEN o IS NULL THEN 0 WHEN o <= 54 THEN 33 ELSE 64 END AS quality_offset FROM x",
    "align_hits_in_sql": f"{_EVENTS} SELECT DISTINCT {_OUT} FROM events",
    "align_indexed": "WITH " + _seeded(_FRAG, _READS, 1, _E) + f" SELECT DISTINCT {_OUT} FROM events",
    "align_gapped": "WITH " + _seeded(_FRAG, _SPLICED, _S, _E) + _GAPPED,
    "windows_dontcare_free": f"WITH {_MASK_FRAG}, w AS (SELECT frag_ord, seq, unnest(range(0, length(seq) - {L - 1})) AS pos FROM frag) SELECT frag_ord, count(*) AS n_windows, CAST(sum(pos) AS BIGINT) AS sum_pos FROM w WHERE NOT contains(substr(seq, CAST(pos + 1 AS BIGINT), {L}), 'N') GROUP BY ALL",
    "bases_of_codes": f"WITH {_READS} SELECT read_ord, left(seq, {L}) AS seed FROM reads",
    "score_of_probabilities": _odds_sql() + ", g(a, c, g, t) AS (VALUES (0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE), (1, 0, 0, 0), (0.1, 0.2, 0.3, 0.4), (0, 0.5, 0.5, 0), (0.05, 0.05, 0.05, 0.85)) SELECT ref_base, a, c, g, t, round(log2(sum(odds * CASE read_base WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END)), 6) AS score FROM o, g GROUP BY ref_base, a, c, g, t",
}
