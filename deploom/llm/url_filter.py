"""Temporal list join: captures against dated block and allow lists, as the lists stood when each capture was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if the URL has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def lookup_keys(url: Column) -> Column:
    """Every list pattern that could cover a URL: each suffix of the host, and the whole host with each leading path of segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    paths = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    empty = F.array().cast("array<string>")
    return F.when(host == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(suffixes, F.when(F.size(segments) > 0, paths).otherwise(empty))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (pattern, action, listed_on) to intervals (pattern, action, valid_from, valid_to).

    An entry holds from its date until the next entry of the same pattern; action `remove` ends a listing. Of entries of one pattern
    and date the one that sorts last holds (`remove` over `block` over `allow`). Entries with a null pattern, action or date never hold.
    """
    clean = entries.where("pattern is not null and action is not null and listed_on is not null").groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    after = F.expr("lead(listed_on) over (partition by pattern order by listed_on)")
    return clean.select("pattern", "action", F.col("listed_on").alias("valid_from"), after.alias("valid_to")).where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """captures with `matched_pattern`, `listed_since` and `blocked`, each judged by the entries active when it was fetched.

    The longest active pattern decides; a capture under no active pattern is not blocked. A null URL, a URL without host, and a null
    fetch date match nothing. Repeated rows all come back. Columns of captures named like the outputs are replaced.

    The intervals of one pattern are gathered in one row (a pattern has few dates), so the as-of step is a lookup in a short array and
    an ordinary equi-join. Captures are first combined to distinct (URL, date) with their count, so a hot URL is looked up once.
    """
    kept = [c for c in captures.columns if c not in ("matched_pattern", "listed_since", "blocked")]
    timeline = validity_intervals(entries).groupBy(F.col("pattern").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "action"))).alias("_spans"))
    timeline = small(materialize(timeline, "url-timeline"), 400)
    asked = captures.select(captures[url].alias("_u"), captures[fetched].alias("_t")).where("_u is not null and _t is not null").distinct()
    keyed = asked.select("_u", "_t", F.explode(lookup_keys(F.col("_u"))).alias("_key"))
    active = F.filter("_spans", lambda s: (s["valid_from"] <= F.col("_t")) & (s["valid_to"].isNull() | (s["valid_to"] > F.col("_t"))))
    hits = keyed.join(timeline, "_key").select("_u", "_t", "_key", active.alias("_on")).where(F.size("_on") > 0)
    best = hits.groupBy("_u", "_t").agg(F.max(F.struct(F.length("_key").alias("n"), F.col("_key").alias("key"), F.col("_on")[0]["valid_from"].alias("since"), F.col("_on")[0]["action"].alias("action"))).alias("_b"))
    # Columns of captures travel in a struct, so that none can clash with those of the join.
    held = captures.select(captures[url].alias("_u"), captures[fetched].alias("_t"), F.struct(*[captures[c] for c in kept]).alias("_row"))
    # Written, so that the join's side is a table, which a hot URL's captures are dealt over; those without a URL or date meet nothing and are
    # dealt by their rows.
    apart = F.when(F.col("_u").isNull() | F.col("_t").isNull(), F.xxhash64(F.to_json("_row"))).otherwise(0)
    held = held.withColumn("_salt", apart)
    best = best.select(F.col("_u").alias("_bu"), F.col("_t").alias("_bt"), "_b", F.lit(0).cast("long").alias("_bs"))
    best = materialize(best, "url-best")
    out = held.join(best, (F.col("_u") == F.col("_bu")) & (F.col("_t") == F.col("_bt")) & (F.col("_salt") == F.col("_bs")), "left")
    return out.select(
        "_row.*", F.col("_b.key").alias("matched_pattern"), F.col("_b.since").alias("listed_since"),
        F.coalesce(F.col("_b.action") == "block", F.lit(False)).alias("blocked"),
    )


#: The dated list of the query: listings, an exception, a return and a removal, for domains, hosts and paths.
LIST = """(VALUES
 ('example.net', 'block', DATE '2024-03-01'), ('example.net', 'remove', DATE '2024-06-01'), ('example.net', 'block', DATE '2024-10-01'),
 ('tionsh.example.net', 'allow', DATE '2024-03-15'), ('tionsh.example.net', 'remove', DATE '2024-05-01'),
 ('tionsh.example.net/en', 'block', DATE '2024-04-01'), ('tionsh.example.net/en', 'allow', DATE '2024-11-01'),
 ('blog.tionble.example.com', 'block', DATE '2024-01-10'), ('blog.tionble.example.com', 'remove', DATE '2024-01-20'),
 ('tionble.example.com', 'block', DATE '2024-09-09'), ('m.ththth.example.net/en', 'block', DATE '2024-02-02'),
 ('example.org', 'allow', DATE '2024-01-01'), ('thther.example.org', 'block', DATE '2024-07-07'), ('thther.example.org', 'block', DATE '2024-08-08'),
 ('ththth.example.com/fr', 'block', DATE '2024-05-05'), ('com', 'block', DATE '2024-12-24')
) AS list(pattern, action, listed_on)"""


def op1_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages judged by LIST. pages has no fetch date; the query dates a capture by its page_id, day by day through 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE '2024-01-01', cast(page_id % 366 as int))").alias("fetched_on"))
    return judge(pages, spark.sql(f"SELECT * FROM {LIST}"))


ORACLE = f"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g') || '/' AS path FROM pages),
  l AS (SELECT pattern, action, listed_on, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM {LIST}),
  m AS (SELECT page_id, pattern, action, listed_on, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS n
    FROM c JOIN l ON fetched_on >= listed_on AND (until IS NULL OR fetched_on < until) AND action <> 'remove'
      AND (host = pattern OR suffix(host, '.' || pattern) OR (contains(pattern, '/') AND starts_with(host || path, pattern || '/'))))
SELECT c.page_id, c.url, c.fetched_on, m.pattern AS matched_pattern, m.listed_on AS listed_since, coalesce(m.action = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.n = 1
"""
