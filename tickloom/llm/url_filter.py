"""URL filters as a sort-merge range join.

A rule's host, with its labels reversed, is a prefix of the reversed hosts it fits, so every rule is an interval of
the ordered keys and intervals nest. Pages and rules are dealt to key ranges; in each range a sweep in key order keeps
the stack of rules whose interval is open. A rule whose interval spans several ranges goes to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: Key ranges for each so many pages, and the most ranges; boundaries go to the driver, at most RANGES of them.
PAGES_A_RANGE, RANGES = 2_000, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"

# The production rules as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without '://'."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({u}, locate('://', {u}) + 3)".format(u="url")))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a slash, which no host holds: 'a.org' is 'org/a/'."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws("/", F.reverse(F.split(host, r"\."))), F.lit("/")))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by range, key and kind (rules first). The stack holds a level for each open host: its rules by path."""
    at, stack = None, []
    for rows in batches:
        found: list[tuple] = []
        for part, key, kind, page, path, rule, verdict in rows[["part", "key", "kind", "page", "path", "rule", "verdict"]].itertuples(index=False, name=None):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                stack[-1][1].setdefault(path, (rule, verdict))
                stack[-1][2].add(len(path))
                continue
            best = None
            for host, by_path, lengths in stack:
                if host == key or (host and key.startswith(host)):
                    for n in lengths:
                        if n <= len(path) and (hit := by_path.get(path[:n])) and (best is None or (len(hit[0]), len(host)) > best[0]):
                            best = ((len(hit[0]), len(host)), hit)
            found.append((page, *(best[1] if best else (None, None))))
        yield pd.DataFrame(found, columns=["page", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url); rules: host, path, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host + path wins, then the
    longer host; of equal rules the least verdict counts. Without a fitting rule: null and ``default``. Null urls and
    urls without '://' have empty parts, which only a rule with an empty host and path fits. Rules with nulls are
    ignored. Repeated rows are each judged; empty tables give empty results (or the default). Distinct (host, path)
    pairs are joined, so that many copies of one url weigh as one; other columns are not read.
    """
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = cut(parted.groupBy("host", "path").count().select("host", "path", host_key(F.col("host")).alias("key")))
    total = urls.count()
    parts = min(RANGES, total // PAGES_A_RANGE + 1)
    # Cuts fall between (key, path) pairs, so that a host with very many pages is dealt to many ranges.
    sort_key = F.concat("key", F.lit("\t"), "path")
    share = min(1.0, 100.0 * parts / max(total, 1))
    picked = urls.select(sort_key.alias("s")).sample(False, share, 1).sort("s") if parts > 1 else None
    seen = [r["s"] for r in picked.collect()] if picked is not None else []
    cuts = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    part_of = lambda c: F.size(F.filter(bounds, lambda b: b <= c)) if cuts else F.lit(0)
    probes = urls.select(part_of(sort_key).alias("part"), "key", F.lit(1).alias("kind"), F.struct("host", "path").alias("page"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    kept = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    kept = kept.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    # From the first key that the rule's host can have to the last.
    spans = F.sequence(part_of(F.col("key")), part_of(F.concat("key", F.lit("\U0010ffff"))))
    no_page = F.lit(None).cast("struct<host:string,path:string>")
    active = kept.select(F.explode(spans).alias("part"), "key", F.lit(0).alias("kind"), no_page.alias("page"), "path", F.concat("host", "path").alias("rule"), "verdict")
    dealt = active.unionByName(probes).repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path")
    flat = dealt.select("part", "key", "kind", F.to_json("page").alias("page"), "path", "rule", "verdict")
    swept = flat.mapInPandas(_sweep, "page string, rule string, verdict string")
    hits = swept.select(F.from_json("page", "host string, path string").alias("p"), "rule", "verdict").select("p.host", "p.path", "rule", "verdict").filter(F.col("rule").isNotNull())
    return parted.join(hits, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(host, path, verdict) AS (VALUES {_VALUES}), j AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM j WHERE k = 1
"""
