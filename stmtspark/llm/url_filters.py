"""URL filters as a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals: an entry of a pattern holds until the next entry of the
same pattern.  Every capture is joined as of its fetch time with the entries of its host, its parent
domains and its host with first path segment: entries and captures of a pattern stand in the order of
their times, and each capture takes the last entry before it, so the work is linear in both however many
dates a pattern has.  The longest active pattern decides.

A hot host is spread: captures carry a salt of their URL and time, and the intervals, the small side, are
repeated for each salt.  Captures of one URL and time are judged once.

Hosts are compared in lower case and without a final dot, path segments as they are written.

Null, empty or host-less URLs and null fetch times match nothing and are kept; they take no part in a join.  Entries with a null
pattern or date are left out; of several entries of one pattern and date a block wins.  Repeated
captures give repeated rows; other columns pass through, except that ``blocked``, ``pattern`` and
``listed_since`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """The lower-case host without a final dot, or an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def pattern_of(written: Column) -> Column:
    """A listed pattern with its host as ``host_of`` has it, and its path as written."""
    host = F.regexp_replace(F.lower(F.regexp_extract(written, "^[^/]*", 0)), r"\.$", "")
    return F.concat(host, F.regexp_extract(written, "(?s)/.*", 0))


def patterns_of(url: Column) -> Column:
    """The patterns that could list a URL: host, parent domains of two labels or more, host/segment."""
    host, segment = host_of(url), F.regexp_extract(url, SEGMENT, 1)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) from dated entries (pattern, action, since); until is open at the end."""
    one = entries.filter("pattern IS NOT NULL AND since IS NOT NULL").groupBy(pattern_of(F.col("pattern")).alias("pattern"), "since").agg(F.max(F.expr("action = 'block'")).alias("block"))
    own = Window.partitionBy("pattern").orderBy("since")
    return one.select("pattern", "block", "since", F.lead("since").over(own).alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with blocked, pattern (the deciding one) and listed_since."""
    captures = captures.drop("blocked", "pattern", "listed_since")
    timed = F.col(url).isNotNull() & F.col(fetched).isNotNull()
    one = captures.filter(timed).select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).distinct()
    asked = one.withColumn("_salt", F.pmod(F.xxhash64("_url", "_at"), F.lit(SALTS))).select("_url", "_at", "_salt", F.explode(patterns_of(F.col("_url"))).alias("pattern"))
    listed = intervals(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = listed.select("pattern", "_salt", F.col("since").alias("_t"), F.lit(0).alias("_side"), F.struct("block", "since", "until").alias("_entry")).unionByName(asked.withColumns({"_t": F.col("_at"), "_side": F.lit(1)}), allowMissingColumns=True)
    before = Window.partitionBy("pattern", "_salt").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = both.withColumn("_entry", F.last("_entry", ignorenulls=True).over(before)).filter("_side = 1 AND _entry IS NOT NULL AND (_entry.until IS NULL OR _at < _entry.until)")
    active = latest.select("_url", "_at", "pattern", "_entry.block", "_entry.since")
    verdict = active.groupBy("_url", "_at").agg(F.max_by(F.struct("block", "pattern", "since"), F.struct(F.length("pattern"), "pattern")).alias("_v"))
    judged = captures.filter(timed).join(verdict, (F.col(url) == F.col("_url")) & (F.col(fetched) == F.col("_at")), "left").select(*captures.columns, "_v")
    rest = captures.filter(~timed).withColumn("_v", F.lit(None).cast(verdict.schema["_v"].dataType))
    return judged.union(rest).select(*captures.columns, F.coalesce("_v.block", F.lit(False)).alias("blocked"), F.col("_v.pattern").alias("pattern"), F.col("_v.since").alias("listed_since"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time for each page, spread over 2024 by page_id."""
    return pages.select("page_id", "url", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 366) as int))").alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the hosts of the pages: each host is blocked and later allowed at dates of its hash,
    some as their parent domain, some with a first path segment that occurs."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", SEGMENT, 1).alias("segment")).filter("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    pattern = F.when((F.col("h") % 3 == 0) & (F.instr("host", ".") > 0), F.expr("substring(host, instr(host, '.') + 1)")).when((F.col("h") % 3 == 1) & (F.col("segment") != ""), F.concat("host", F.lit("/"), "segment")).otherwise(F.col("host"))
    day = lambda e: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({e} as int))")
    rows = seen.withColumn("h", number).withColumn("pattern", pattern)
    first = rows.select("pattern", F.lit("block").alias("action"), day("h % 300").alias("since"))
    later = rows.select("pattern", F.lit("allow").alias("action"), day("h % 300 + 20 + h % 97").alias("since"))
    return first.union(later).distinct()


ORACLE = r"""
WITH parts AS (
  SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages WHERE url IS NOT NULL),
hosts AS (SELECT *, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM parts WHERE host <> ''),
named AS (
  SELECT h, CASE WHEN h % 3 = 0 AND instr(host, '.') > 0 THEN substr(host, instr(host, '.') + 1)
              WHEN h % 3 = 1 AND segment <> '' THEN host || '/' || segment ELSE host END AS pattern FROM hosts),
entries AS (
  SELECT pattern, true AS block, TIMESTAMP '2024-01-01' + to_days((h % 300)::INT) AS since FROM named
  UNION ALL SELECT pattern, false, TIMESTAMP '2024-01-01' + to_days((h % 300 + 20 + h % 97)::INT) FROM named),
one AS (SELECT pattern, since, bool_or(block) AS block FROM entries GROUP BY 1, 2),
spans AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM one),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 37 % 366)::INT) AS fetched,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS segment FROM pages),
asked AS (
  SELECT *, list_distinct(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END)) AS patterns
  FROM captures),
found AS (
  SELECT a.page_id, s.*, row_number() OVER (PARTITION BY a.page_id ORDER BY length(s.pattern) DESC, s.pattern DESC) AS n
  FROM (SELECT page_id, fetched, unnest(patterns) AS pattern FROM asked WHERE host <> '') a
  JOIN spans s ON s.pattern = a.pattern AND s.since <= a.fetched AND (s.until IS NULL OR a.fetched < s.until))
SELECT c.page_id, c.url, c.fetched, coalesce(f.block, false) AS blocked, f.pattern, f.since AS listed_since
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id AND f.n = 1
"""
