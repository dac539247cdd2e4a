"""Operator 5: URL filters.

Two rule kinds decide on a URL. *Host rules* (action, host, path) fit a host and its subdomains when the URL's path starts with the
rule's path; they are found by an equi-join on the URL's host suffixes, and the longest wins. *Pattern rules* are regular expressions
indexed by their rarest literal token: a token is a maximal run of [a-z0-9] that every match must contain whole. A URL's own tokens
fetch candidate rules by an equi-join, and only those candidates run their expression.

Everything is DataFrame code. A rule table is broadcast only up to MAX_BROADCAST_RULES rows; beyond that the joins shuffle.

Defined results: a null URL or one without "://" has an empty host and path, fits no host rule, and is judged by the patterns alone (a
null URL has no tokens: the default verdict). Repeated rows are judged alike, each with its own output row. An empty table gives an
empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sc
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, local_table, table

MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """regex runs on the ASCII-lower-cased URL; the first rule in list order that matches decides."""

    action: str
    regex: str


def _is_word(code: int) -> bool:
    return chr(code) in "abcdefghijklmnopqrstuvwxyz0123456789"


def _set_has_word(items: list) -> bool:
    for op, arg in items:
        if op is sc.LITERAL and _is_word(arg):
            return True
        if op is sc.RANGE and any(_is_word(x) for x in range(arg[0], min(arg[1], 127) + 1)):
            return True
        if op in (sc.NEGATE, sc.CATEGORY):
            return True
    return False


def literal_tokens(regex: str) -> list[str]:
    """Tokens that every match of regex contains whole: literal runs closed on both sides by something that is no token character."""
    found, run, closed = [], "", False
    for op, arg in [*sre.parse(regex), (sc.FAILURE, None)]:
        if op is sc.LITERAL and _is_word(arg):
            run += chr(arg)
            continue
        ends = (op is sc.LITERAL) or (op is sc.AT) or (op is sc.IN and not _set_has_word(arg))
        if op is sc.SUBPATTERN:  # a group of alternatives, each one a single non-word character or the end
            inner = list(arg[-1])
            ends = len(inner) == 1 and (
                (inner[0][0] is sc.IN and not _set_has_word(inner[0][1]))
                or (inner[0][0] is sc.BRANCH and all(len(b) == 1 and (b[0][0] is sc.AT or (b[0][0] is sc.LITERAL and not _is_word(b[0][1])) or (b[0][0] is sc.IN and not _set_has_word(b[0][1]))) for b in inner[0][1][1]))
            )
        if run and closed and ends:
            found.append(run)
        run, closed = "", bool(ends)
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, whole, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.expr("filter(split(_low, '[^a-z0-9]+'), t -> t != '')"))


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST_RULES else df


def pattern_index(spark: SparkSession, tokens: DataFrame, rules: list[PatternRule]) -> DataFrame:
    """rank, action, regex, token: each rule under that of its literal tokens which the URLs (tokens: one row a URL and token) use least."""
    rows = []
    for rank, r in enumerate(rules):
        lits = literal_tokens(r.regex)
        if not lits:
            raise ValueError(f"no literal token is certain in every match of {r.regex!r}")
        rows += [(rank, r.action, r.regex, t) for t in dict.fromkeys(lits)]
    lit = local_table(spark, rows, "rank int, action string, regex string, token string")
    uses = tokens.join(_sized(lit.select("token").distinct(), len(rows)), "token", "left_semi").groupBy("token").agg(F.count("*").alias("uses"))
    first = Window.partitionBy("rank").orderBy(F.coalesce("uses", F.lit(0)), "token")
    return lit.join(uses, "token", "left").withColumn("n", F.row_number().over(first)).filter("n = 1").select("rank", "action", "regex", "token")


def judge_urls(pages: DataFrame, host_rules: list[HostRule], pattern_rules: list[PatternRule], default: str = "allow") -> DataFrame:
    """Per row of pages(page_id, url): page_id, url, host, path, rule (the host rule or null), pattern (the deciding expression or null), verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = rows.filter("url is not null").select("url", "host", "path").distinct()
    tokens = urls.select("url", ascii_lower(F.col("url")).alias("_low")).select("url", "_low", F.explode(url_tokens(F.col("_low"))).alias("token"))
    index = pattern_index(spark, tokens.select("token"), pattern_rules)
    by_pattern = (
        tokens.join(_sized(index, len(pattern_rules)), "token").filter("_low rlike regex")
        .groupBy("url").agg(F.min(F.struct("rank", "action", "regex")).alias("p"))
    )
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> concat_ws('.', slice(split(host, '[.]'), i, size(split(host, '[.]')))))")
    hosts = local_table(spark, [(r.action, r.host, r.path) for r in host_rules], "h_action string, h_host string, h_path string")
    by_host = (
        urls.withColumn("h_host", F.explode(suffixes)).join(_sized(hosts, len(host_rules)), "h_host").filter("startswith(path, h_path)")
        .groupBy("url").agg(F.max(F.struct((F.length("h_host") + F.length("h_path")).alias("len"), F.col("h_action").alias("action"), F.concat("h_host", "h_path").alias("rule"))).alias("h"))
    )
    found = by_pattern.join(by_host, "url", "full_outer")
    return rows.join(found, "url", "left").select(
        "page_id", "url", "host", "path", F.col("h.rule").alias("rule"), F.col("p.regex").alias("pattern"),
        F.coalesce("h.action", "p.action", F.lit(default)).alias("verdict"),
    )


HOST_RULES = [
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
]

#: Feed and listing copies, session and account pages, and advertising endpoints.
PATTERN_RULES = [
    PatternRule("allow", r"[?&]ref=x&lang=[a-z]+"),
    PatternRule("block", r"[?&]utm_source=feed(&|#|$)"),
    PatternRule("block", r"[?&]page=[0-9]+"),
    PatternRule("block", r"[?&]sessionid=[0-9a-f]+"),
    PatternRule("block", r"[?&]replytocom=[0-9]+"),
    PatternRule("block", r"/wp-login[.]php(\?|#|$)"),
    PatternRule("block", r"/cart(/|\?|#|$)"),
    PatternRule("block", r"/checkout(/|\?|#|$)"),
    PatternRule("block", r"/login(/|\?|#|$)"),
    PatternRule("block", r"/signup(/|\?|#|$)"),
    PatternRule("block", r"/tag/[^/]+/page/[0-9]+"),
    PatternRule("block", r"/print/[0-9]+"),
    PatternRule("block", r"//ads[.]"),
    PatternRule("block", r"[./]doubleclick[.]net"),
    PatternRule("block", r"/casino(/|-|\?|#|$)"),
    PatternRule("block", r"/viagra(/|-|\?|#|$)"),
    PatternRule("block", r"[.]xxx(/|:|$)"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), HOST_RULES, PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quoted(r.action)}, {quoted(r.host)}, {quoted(r.path)})" for r in HOST_RULES)
    first = "CASE " + " ".join(f"WHEN regexp_matches(low, {quoted(r.regex)}) THEN {i}" for i, r in enumerate(PATTERN_RULES)) + " END"
    rules = ", ".join(f"({i}, {quoted(r.action)}, {quoted(r.regex)})" for i, r in enumerate(PATTERN_RULES))
    return f"""
WITH h(action, host, path) AS (VALUES {hosts}), p(rank, action, regex) AS (VALUES {rules}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER_SQL}', '{LOWER_SQL}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
             translate(url, '{UPPER_SQL}', '{LOWER_SQL}') AS low FROM pages),
d AS (SELECT u.*, {first} AS first_p,
             (SELECT max({{'len': length(h.host) + length(h.path), 'action': h.action, 'rule': h.host || h.path}}) FROM h
              WHERE (u.host = h.host OR ends_with(u.host, '.' || h.host)) AND starts_with(u.path, h.path)) AS best FROM u)
SELECT page_id, d.host, d.path, best.rule AS rule, coalesce(best.action, p.action, 'allow') AS verdict, p.regex AS pattern
FROM d LEFT JOIN p ON p.rank = first_p"""


UPPER_SQL, LOWER_SQL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {"op5_url_filters": _sql()}
QUERIES = {"op5_url_filters": op5_url_filters}
