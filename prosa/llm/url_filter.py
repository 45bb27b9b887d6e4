"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Built-in functions only. The filter has a fixed number of 64-bit blocks (a parameter), so the one
row that holds it has a known size whatever the length of the list; a longer list only lets more
false hits through, and the exact join that follows removes them.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule, is on no list
and is allowed. Repeated pages each get a row. Extra columns are ignored. Empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import ascii_lower

#: (verdict, host, path). A rule holds for the host and all that end in a dot and the host.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
BLOCKS = 1 << 15
BITS = 6


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without slashes at its end; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule_of(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest fitting rule, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bits_of(key: Column) -> Column:
    """The key's bits within its block: six bits each of a second hash give one position."""
    second = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    at = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.call_function("shiftleft", one, p) for p in at])


def bloom(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row, ``bloom``: the blocks' bits as an array. ``keys``: one column, ``key``."""
    set_bits = keys.where("key is not null").groupBy(block_of(F.col("key"), blocks).alias("block")).agg(
        F.bit_or(bits_of(F.col("key"))).alias("bits"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("bits"))
    dense = set_bits.unionByName(every).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    rows = F.sort_array(F.collect_list(F.struct("block", "bits")))
    return dense.agg(F.transform(rows, lambda x: x["bits"]).alias("bloom"))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int = BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.

    ``listed``: one column, ``key``, of canonical URLs; repeats and nulls are allowed. What no rule
    decides is blocked if it is listed.
    """
    keys = listed.where("key is not null").distinct()
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("key", canonical(F.col("host"), F.col("path")))
    block = F.get(bloom(keys, blocks).scalar(), block_of(F.col("key"), blocks))
    mask = bits_of(F.col("key"))
    maybe = F.coalesce(F.col("key").isNotNull() & (block.bitwiseAND(mask) == mask), F.lit(False))
    tested = parsed.withColumn("maybe", maybe)
    hits = tested.where("maybe").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    rest = tested.where("not maybe").withColumn("listed", F.lit(False))
    columns = ["page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")]
    judged = hits.select(columns).unionByName(rest.select(columns))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The list the registered query uses: canonical URLs that more than one page claims."""
    key = canonical(host_of(F.col("url")), path_of(F.col("url")))
    return pages.select(key.alias("key")).where("key is not null").groupBy("key").count().where("count > 1").select("key")


SQL = """
WITH p AS (
  SELECT page_id, translate(CASE WHEN instr(url, '://') > 0 THEN
      regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0) ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(url, '://') > 0 THEN
      regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
k AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS key FROM p),
l AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
r AS (SELECT k.*, l.key IS NOT NULL AS listed, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM k LEFT JOIN l USING (key))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict,
  listed FROM r
"""
