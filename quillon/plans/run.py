"""A whole alignment, from files to a report and its counts."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators import align, choose, fold, gapped
from quillon.operators.reads import quality_offset, usable
from quillon.operators.seeds import Pieces
from quillon.sources import sequences
from quillon.sources.blocks import scratch_path, written

from .config import AlignConfig


def align_reads(text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig, policy: str = "fold", names: DataFrame | None = None) -> DataFrame:
    """The report of reads(read_ord, read_id, seq, len, has_n[, qual]) on text: fragments, or pieces with the names of their fragments (file_ord, frag_ord,
    ref_id). policy of unique scored mode: fold or canonical."""
    return reported(align.seed_matches(text, reads, config), reads, config, policy, text if names is None else names)


def reported(matches: DataFrame, reads: DataFrame, config: AlignConfig, policy: str, names: DataFrame) -> DataFrame:
    best, rewrite = chosen(matches, reads, config, policy)
    return choose.report(best.filter("loci = 1") if config.unique else best, reads, names, config.scored, rewrite)


def chosen(matches: DataFrame, reads: DataFrame, config: AlignConfig, policy: str) -> tuple[DataFrame, bool]:
    """(hits, or in unique mode one row a read that has any, with loci; whether the report is in rewritten order)."""
    if config.scored:
        matches = align.with_score(matches, config, "qual" in reads.columns)
    if not config.unique:
        return align.all_hits(matches), False
    if not config.scored:
        return choose.states_by_errors(matches), config.rewrite
    return fold.states(align.events(matches), config) if policy == "fold" else choose.states_by_score(matches, config), config.rewrite


@dataclass(frozen=True)
class Run:
    """report; counts: reads (all), matched (reads with a hit), unique (reads reported), or hits (all mode), gathered as rows were written; gapped: the best
    gapped place of each read without a hit, if asked for."""

    report: DataFrame
    counts: dict[str, int]
    gapped: DataFrame | None = None


def align_files(spark: SparkSession, text: str, patterns: str, config: AlignConfig | None = None, policy: str = "fold") -> Run:
    """An alignment of FASTA or FASTQ reads ("-": standard input) to FASTA text.

    The reads are written once as a store partitioned by length and whether they hold N, which counts them; what cannot be aligned is never read from it
    again. The chosen hits, one row a read, are written once too, which counts them."""
    config = config or AlignConfig()
    offset = config.quality_offset
    if patterns == "-":
        patterns = sequences.spooled(spark, sys.stdin.buffer)
        offset = offset or 64  # what is piped in is read once, so its offset is not looked for
    kind = sequences.sniff(spark, patterns)
    total, store = Observation(), scratch_path(spark, "reads")
    sequences.write_reads(sequences.read_reads(spark, patterns, kind).observe(total, F.count(F.lit(1)).alias("reads")), store)
    reads = sequences.read_bucketed(spark, store)
    if kind == "fastq":
        offset = offset or quality_offset(reads).first().quality_offset
        if not offset:
            raise ValueError("the quality offset cannot be told from these reads")
        reads = sequences.with_quality(reads, offset)
    else:
        reads = reads.drop("plus", "quality_raw")
    n = config.seed_length
    longest = max(n, usable(reads, n).agg(F.max("len")).first()[0] or 0)
    pieces, names = sequences.read_pieces(spark, text, longest, n + 2 * longest)
    best, rewrite = chosen(align.seed_matches(pieces, reads, config), reads, config, policy)
    seen = Observation()
    what = {"matched": F.count(F.lit(1)), "unique": F.count_if(F.col("loci") == 1)} if config.unique else {"hits": F.count(F.lit(1))}
    columns = [c for c in ("read_ord", "file_ord", "frag_ord", "pos", "strand", "k", "score", "loci") if c in best.columns]
    kept = written(best.select(*columns).observe(seen, *[c.alias(k) for k, c in what.items()]), "hits")
    report = choose.report(kept.filter("loci = 1") if config.unique else kept, reads, names, config.scored, rewrite)
    extra = gapped.align_gapped(pieces, reads, kept, config) if config.gapped else None
    return Run(report, {**total.get, **seen.get}, extra)


def main(argv: list[str] | None = None) -> None:
    """python -m quillon.plans.run -t text -p reads (- for standard input) -o folder [options]; counts go to standard error"""
    import argparse

    a = argparse.ArgumentParser(description=main.__doc__)
    for flag, name in (("-t", "text"), ("-p", "patterns"), ("-o", "output")):
        a.add_argument(flag, dest=name, required=True)
    d = AlignConfig()
    for flag, name, kind in (
        ("-s", "seed_mismatches", int), ("-e", "total_mismatches", int), ("-l", "seed_length", int), ("-u", "unique", int), ("-q", "scored", int), ("-Q", "quality_offset", int), ("-R", "rewrite", int), ("-g", "gapped", int),
        ("-similarity", "similarity", float), ("-err", "error_rate", float), ("-trans", "transitions", float), ("-gc", "gc", float), ("-gcmut_bias", "gc_bias", float), ("-filter_level", "filter_level", int),
    ):
        a.add_argument(flag, dest=name, type=kind, default=getattr(d, name))
    a.add_argument("-T", dest="threads", type=int, help="tasks at once, of a local session that this call starts")
    a.add_argument("-f", "-m", dest="memory", type=float, help="share of memory for the text; Spark's own settings rule, so this is read and left")
    given, unknown = a.parse_known_args(argv)
    for x in unknown:
        print(f"unknown argument {x} is left out", file=sys.stderr)
    x = vars(given)
    text, patterns, output, threads, _ = (x.pop(k) for k in ("text", "patterns", "output", "threads", "memory"))
    if threads is not None and threads < 1:
        raise ValueError("at least one thread is needed")
    x |= {k: bool(x[k]) for k in ("unique", "scored", "rewrite", "gapped")}
    builder = SparkSession.builder
    spark = (builder.master(f"local[{threads}]") if threads and SparkSession.getActiveSession() is None else builder).getOrCreate()
    run = align_files(spark, text, patterns, AlignConfig(**x))
    sequences.write_report(run.report, output)
    if run.gapped is not None:
        run.gapped.write.parquet(f"{output.rstrip('/')}.gapped")
    print(*(f"{k}: {v}" for k, v in run.counts.items()), file=sys.stderr)


if __name__ == "__main__":
    main()
