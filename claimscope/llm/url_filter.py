"""URL filtering by dated lists: a temporal list join.

List entries (add or remove, each with a date) become validity intervals per list, scope and
pattern.  A capture has one key per host suffix, one for its host and one per path prefix; an
as-of join keeps the entries whose interval holds the capture's fetch date.  The most specific
active entry decides: path prefixes (longest first), then the exact host, then domains (most
labels first); at a tie block wins.  Only DataFrame functions are used.

Skew: a host that a third of all captures share is dealt over ``SALTS`` copies of the (small)
entry side; matches are folded per capture by a maximum, never collected.

Edge cases: an add and a remove on one date count as a remove; repeated entries count once; null
or unparsable URLs and null dates match nothing and are kept with action "none"; repeated
captures (same id, URL and date) are one row with ``copies``; empty tables give empty results or
"none"; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import table, written

SALTS = 8
_URL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), _URL, 1), r"\.$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (list_name, scope, pattern, verdict, action, day) as intervals: since <= day < until.
    One row per list, scope, pattern, verdict and date goes into the window: its size is bounded by
    the number of dates, whatever the number of entries."""
    key = ["list_name", "scope", "pattern", "verdict"]
    daily = entries.filter(F.col("day").isNotNull()).groupBy(*key, "day").agg(F.max("action").alias("action"))  # remove > add
    until = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    return daily.withColumn("until", until).filter(F.col("action") == "add").select(*key, F.col("day").alias("since"), "until")


def capture_keys(host: Column, path: Column) -> Column:
    """array<struct<scope, pattern, weight>> of one capture."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("pattern"), k.alias("weight")),
    )
    exact = F.array(F.struct(F.lit("host").alias("scope"), host.alias("pattern"), F.lit(1_000).alias("weight")))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda k: F.struct(F.lit("path").alias("scope"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("pattern"), (k + 1_000_000).alias("weight")),
        ),
    ).otherwise(F.slice(exact, 1, 0))
    return F.when(host != "", F.concat(domains, exact, prefixes)).otherwise(F.slice(exact, 1, 0))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """Per distinct capture: id, url, fetched, copies, action (block, allow, none), list_name, scope,
    pattern and since of the deciding entry, n_active (entries active for the capture)."""
    caps = captures.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).alias("fetched")).agg(F.count(F.lit(1)).alias("copies"))
    caps = written(caps, "captures")
    salt = F.pmod(F.xxhash64("id", "url", "fetched"), F.lit(SALTS))
    keyed = caps.select("id", "url", "fetched", salt.alias("salt"), F.explode(capture_keys(url_host(F.col("url")), url_path(F.col("url")))).alias("k"))
    keyed = keyed.select("id", "url", "fetched", "salt", "k.scope", "k.pattern", "k.weight")
    active = written(intervals(entries), "list-intervals")
    active = active.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    hit = keyed.join(active, ["salt", "scope", "pattern"]).filter((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = hit.groupBy("id", "url", "fetched").agg(
        F.max(F.struct("weight", "verdict", "list_name", "scope", "pattern", "since")).alias("best"), F.count(F.lit(1)).alias("n_active")
    )
    best = best.select(F.col("id").alias("b_id"), F.col("url").alias("b_url"), F.col("fetched").alias("b_fetched"), "best", "n_active")
    same = F.col("id").eqNullSafe(F.col("b_id")) & F.col("url").eqNullSafe(F.col("b_url")) & F.col("fetched").eqNullSafe(F.col("b_fetched"))
    return caps.join(best, same, "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(day_col), "copies",
        F.coalesce("best.verdict", F.lit("none")).alias("action"), "best.list_name", "best.scope", "best.pattern", "best.since",
        F.coalesce("n_active", F.lit(0).cast("bigint")).alias("n_active"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: a fetch date in 2024 that follows from the page id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from the pages: every host is blocked for a while and again
    later, every parent domain of a host is allowed from some date on, every first path folder is
    allowed for 60 days."""
    host = url_host(F.col("url"))
    first = F.regexp_extract(url_path(F.col("url")), r"^/([^/]+)/", 1)
    seen = pages.select("page_id", host.alias("host"), first.alias("folder")).filter(F.col("host") != "")
    hosts = seen.groupBy("host").agg(F.min("page_id").alias("m"))
    parents = seen.select("page_id", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent")).filter(F.col("parent") != "").groupBy("parent").agg(F.min("page_id").alias("m"))
    folders = seen.filter(F.col("folder") != "").select("page_id", F.concat_ws("/", "host", "folder").alias("prefix")).groupBy("prefix").agg(F.min("page_id").alias("m"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    start = F.pmod(F.col("m") * 11, F.lit(300))

    def events(df: DataFrame, pattern: str, name: str, scope: str, verdict: str, *acts: tuple[str, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), day(d).alias("day")) for a, d in acts])).alias("e")
        return df.select(F.lit(name).alias("list_name"), F.lit(scope).alias("scope"), F.col(pattern).alias("pattern"), F.lit(verdict).alias("verdict"), each).select("list_name", "scope", "pattern", "verdict", "e.action", "e.day")

    return (
        events(hosts, "host", "hosts", "host", "block", ("add", start), ("remove", start + 30 + F.length("host")), ("add", start + 150))
        .unionByName(events(parents, "parent", "domains", "domain", "allow", ("add", F.pmod(F.col("m") * 7, F.lit(365)))))
        .unionByName(events(folders, "prefix", "folders", "path", "allow", ("add", F.pmod(F.col("m") * 5, F.lit(200))), ("remove", F.pmod(F.col("m") * 5, F.lit(200)) + 60)))
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(derived_captures(pages), derived_entries(pages))


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id * 37) % 365 + 365) % 365 AS INTEGER) AS fetched,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?', 1), '\.$', '') AS host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?', 2) AS path FROM pages),
hosts AS (SELECT host AS pattern, min(page_id) AS m FROM p WHERE host <> '' GROUP BY 1),
parents AS (SELECT regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS pattern, min(page_id) AS m FROM p WHERE regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) <> '' GROUP BY 1),
folders AS (SELECT host || '/' || regexp_extract(path, '^/([^/]+)/', 1) AS pattern, min(page_id) AS m FROM p
  WHERE host <> '' AND regexp_extract(path, '^/([^/]+)/', 1) <> '' GROUP BY 1),
spans AS (
  SELECT 'hosts' AS list_name, 'host' AS scope, pattern, 'block' AS verdict, (m * 11) % 300 AS a, LEAST((m * 11) % 300 + 30 + length(pattern), (m * 11) % 300 + 150) AS b FROM hosts
  WHERE 30 + length(pattern) <> 150
  UNION ALL SELECT 'hosts', 'host', pattern, 'block', (m * 11) % 300 + 150, CASE WHEN 30 + length(pattern) > 150 THEN (m * 11) % 300 + 30 + length(pattern) END FROM hosts WHERE 30 + length(pattern) <> 150
  UNION ALL SELECT 'domains', 'domain', pattern, 'allow', (m * 7) % 365, NULL FROM parents
  UNION ALL SELECT 'folders', 'path', pattern, 'allow', (m * 5) % 200, (m * 5) % 200 + 60 FROM folders),
caps AS (SELECT page_id, url, fetched, host, path, count(*) AS copies FROM p GROUP BY ALL),
keys AS (
  SELECT page_id, url, fetched, 'host' AS scope, host AS pattern, 1000 AS weight FROM caps WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 'domain', array_to_string(string_split(host, '.')[len(string_split(host, '.')) - k + 1:], '.'), k
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM caps WHERE host <> '')
  UNION ALL SELECT page_id, url, fetched, 'path', host || '/' || array_to_string(parts[1:k], '/'), 1000000 + k
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM caps WHERE host <> ''))),
hit AS (
  SELECT page_id, url, fetched, weight, verdict, list_name, s.scope, s.pattern, DATE '2024-01-01' + CAST(a AS INTEGER) AS since
  FROM keys JOIN spans s USING (scope, pattern)
  WHERE fetched >= DATE '2024-01-01' + CAST(a AS INTEGER) AND (b IS NULL OR fetched < DATE '2024-01-01' + CAST(b AS INTEGER))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY weight DESC, verdict DESC, list_name DESC, scope DESC, pattern DESC, since DESC) AS nth,
  count(*) OVER (PARTITION BY page_id, url, fetched) AS n FROM hit)
SELECT c.page_id, c.url, c.fetched, c.copies, coalesce(verdict, 'none') AS action, list_name, scope, pattern, since, coalesce(n, 0) AS n_active
FROM caps c LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) r ON c.page_id = r.page_id AND c.url IS NOT DISTINCT FROM r.url AND c.fetched = r.fetched
"""
