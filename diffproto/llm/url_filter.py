"""URL filters: host and path rules, and a list of canonical URLs behind a
blocked Bloom filter.

The list's URLs are hashed; each key sets eight bits, one in each 64-bit word
of a single 512-bit block.  Blocks are built by one ``bit_or`` aggregate.  A
page's URL looks up its one block, so a miss costs one lookup, and only
possible hits take part in the exact hash join that removes the filter's
false positives.  Everything is native column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import fits_broadcast
from .common import ascii_lower, read

#: (verdict, host, path): fixed rules of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Labels of hosts whose pages make up the query's list of URLs.
LISTED_LABELS = ("spam-farm", "ads-track")
WORDS = 8  # 64-bit words in a block, one bit of a key in each
KEYS_PER_BLOCK = 32  # about 16 bits a key
MAX_RULES = 1000


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """``host/path`` without scheme, a leading ``www.`` or ``m.``, query,
    fragment, a trailing ``.html`` or ``/``.  Null, or no host: null."""
    h = F.regexp_replace(host(url), r"^(www|m)\.", "")
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), r"(\.html)?/*$", "")))


def rule_of(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  A rule fits
    its host and every subdomain, where the path starts with the rule's.
    Among rules of one length the first listed wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules: longer lists belong in the URL list")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    for what, rh, rp in reversed(ordered):  # the last one wrapped is asked first
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        rule = F.when(fits, F.lit(rh + rp)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def blocked_bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of ``listed.key``; blocks without keys have no row."""
    aggs = [F.bit_or(m).alias(f"__w{i}") for i, m in enumerate(_masks(F.col(key)))]
    return listed.groupBy(_block(F.col(key), n_blocks).alias("__block")).agg(*aggs)


def possible(df: DataFrame, key: str, keys: DataFrame, keys_key: str, n_blocks: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``keys``, by a filter of
    ``n_blocks`` blocks.  With a fixed number of blocks the filter's size is
    bounded whatever ``keys`` holds; with very many keys it only passes more."""
    bloom = blocked_bloom(keys, keys_key, n_blocks)
    if fits_broadcast(df.sparkSession, n_blocks, 8 * (WORDS + 2)):
        bloom = F.broadcast(bloom)
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(m) == m)
    probe = df.withColumn("__b", _block(F.col(key), n_blocks))
    return probe.join(bloom, F.col("__b") == F.col("__block")).filter(hit).select(*df.columns)


def listed_urls(df: DataFrame, key: Column, listed: DataFrame, listed_key: str = "canonical") -> DataFrame:
    """``df`` with a boolean column ``listed``: is ``key`` in the list?  A null
    key is not.  Rows are kept as they are, whatever they repeat."""
    spark = df.sparkSession
    keys = listed.select(F.col(listed_key).alias("__key")).filter("__key is not null").distinct()
    n_keys = keys.count()
    n_blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    bloom = blocked_bloom(keys, "__key", n_blocks)
    row = 8 * (WORDS + 2)
    small = fits_broadcast(spark, n_blocks, row)  # the filter's size is known from its number of blocks
    probe = df.withColumn("__k", key)
    probe = probe.withColumn("__b", _block(F.col("__k"), n_blocks))
    joined = probe.join(F.broadcast(bloom) if small else bloom, F.col("__b") == F.col("__block"), "left")
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("__k"))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(m) == m)
    joined = joined.withColumn("__maybe", F.col("__k").isNotNull() & F.coalesce(hit, F.lit(False)))
    joined = joined.drop("__b", "__block", *[f"__w{i}" for i in range(WORDS)])
    # only possible hits reach the exact join; the others never move
    sure = joined.filter(~F.col("__maybe")).withColumn("listed", F.lit(False))
    exact = joined.filter("__maybe").join(keys, F.col("__k") == F.col("__key"), "left").withColumn(
        "listed", F.col("__key").isNotNull()
    ).drop("__key")
    return sure.unionByName(exact).drop("__k", "__maybe")


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule``, ``listed`` and
    ``verdict``: the rule's verdict where one fits; else block for a URL in
    ``listed`` (a column ``canonical``), allow for others.

    A null URL, or one without ``://``, has an empty host and path, fits no
    rule, is in no list and is allowed.  Repeated rows stay.  Columns of
    ``pages`` with the names of the added ones are replaced."""
    pages = pages.drop(*[c for c in ("host", "path", "rule", "listed", "verdict") if c != url])
    parts = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = listed_urls(parts, canonical(F.col(url)), listed)
    return seen.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of all pages served over https from a
    host with one of ``LISTED_LABELS`` among its labels."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.split(host(F.col("url")), r"\.")
    listed = pages.filter(
        F.startswith("url", F.lit("https://")) & F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS)))
    ).select(canonical(F.col("url")).alias("canonical"))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_PARTS = r"""
  SELECT page_id, url,
         COALESCE(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
"""

SQL = rf"""
WITH p AS ({_PARTS}),
c AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(www|m)\.', '') <> ''
            THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') END AS canonical
  FROM p),
k AS (
  SELECT DISTINCT canonical FROM c
  WHERE url LIKE 'https://%' AND canonical IS NOT NULL
    AND (list_contains(string_split(host, '.'), 'spam-farm') OR list_contains(string_split(host, '.'), 'ads-track'))),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    canonical IS NOT NULL AND canonical IN (SELECT canonical FROM k) AS listed
  FROM c)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
