"""Line dedup by distinct-site spread.

Each line hash gets a HyperLogLog sketch of the sites it occurs on, merged by
aggregation.  Lines whose estimate is clearly over the threshold are
boilerplate and clearly under it are not; only lines in between, within the
sketch's error, get an exact distinct count.  Boilerplate lines are removed
from every document.

Shape: rows are numbered and their lines hashed once, and stored with them.
Sketches are built from the lines as they come, merged in each task first, so a
line on a third of all rows is one small sketch per task; (line, site) pairs are
only made for near-threshold lines.  A row then meets the list of its own
boilerplate hashes by its number, so no id, line or site is ever one task's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from .common import read, stored

MIN_SITES = 10
LG_K = 9  # 512 registers: a standard error of about 4.6 %
SIGMAS = 4.0


def lines(text: Column) -> Column:
    """The lines of a text; null: an empty array."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def line_key(line: Column) -> Column:
    """64-bit hash of a line without white space at its ends; blank lines: null."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(t != "", F.xxhash64(t))


def hashed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__row``, a number of the row's own, and ``__h``, the hash
    of each line (null for a blank one), stored."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn(
        "__h", F.transform(lines(F.col(text)), line_key)), "hashed-lines")


def _each(hashed: DataFrame, *columns: str) -> DataFrame:
    return hashed.select(*columns, F.explode(F.array_distinct("__h")).alias("line")).filter("line is not null")


def spread(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES,
           lg_k: int = LG_K, sigmas: float = SIGMAS) -> DataFrame:
    """(line, sites) of the lines on at least ``min_sites`` distinct non-null
    sites.  ``sites`` is exact for near-threshold lines and the sketch's
    estimate for the rest; membership is exact for near-threshold lines, and
    beyond ``sigmas`` standard errors for the rest."""
    hashed = docs if "__h" in docs.columns else hashed_lines(docs, text)
    told = _each(hashed.filter(F.col(site).isNotNull()), site)
    sketched = told.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, lg_k)).alias("estimate"))
    band = max(1.0, sigmas * 1.04 / math.sqrt(2 ** lg_k) * min_sites)
    sketched = stored(sketched.filter(F.col("estimate") >= min_sites - band), "line-spread")
    sure = sketched.filter(F.col("estimate") > min_sites + band).select("line", F.col("estimate").cast("long").alias("sites"))
    near = sketched.filter(F.col("estimate") <= min_sites + band).select("line")
    pairs = told.join(_small(near), "line", "left_semi").select("line", site).distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites))


def _small(found: DataFrame) -> DataFrame:
    """A list of line hashes, broadcast where its counted size allows."""
    return bounded_broadcast(found, found.count(), 16)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and with
    ``n_lines`` and ``n_removed`` (long).

    Kept lines stay as they are, in order, blank lines too.  Null text stays
    null with 0 lines; an empty text is one blank line; a text of any length
    is handled whole.  Rows without a site count towards no line but are
    cleaned.  Repeated rows, rows that share an id and rows without one all
    stay, each for itself.  An empty table gives an empty result.  Columns of
    ``docs`` with the names of the added ones are replaced."""
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (id_col, site, text)])
    hashed = hashed_lines(docs, text)
    bad = stored(spread(hashed, site, text, **options).select("line"), "boilerplate")
    # a row's boilerplate hashes: at most as many as it has lines
    own = _each(hashed, "__row").join(_small(bad), "line", "left_semi").groupBy(F.col("__row").alias("__r")).agg(F.collect_list("line").alias("__bad"))
    every = hashed.join(own, F.col("__row") == F.col("__r"), "left")
    ls = lines(F.col(text))
    kept = F.filter(ls, lambda x, i: ~F.coalesce(F.array_contains(F.col("__bad"), F.get("__h", i)), F.lit(False)))
    some = F.col("__bad").isNotNull()
    every = every.withColumn("n_lines", F.size(ls).cast("long")).withColumn("__kept", F.when(some, kept))
    return every.withColumn(
        "n_removed", F.when(some, F.col("n_lines") - F.size("__kept")).otherwise(F.lit(0)).cast("long")
    ).withColumn(text, F.when(some, F.array_join("__kept", "\n")).otherwise(F.col(text))).select(*docs.columns, "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


_TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
SQL = rf"""
WITH l AS (
  SELECT doc_id, source, line, i, {_TRIM} AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING COUNT(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.*, b.key IS NOT NULL AS bad FROM l LEFT JOIN b ON l.key = b.key),
g AS (
  SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE bad) AS n_removed,
         COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS clean_text
  FROM m GROUP BY doc_id)
SELECT d.doc_id, COALESCE(g.n_lines, 0) AS n_lines, COALESCE(g.n_removed, 0) AS n_removed,
       CASE WHEN g.n_removed > 0 THEN g.clean_text ELSE d.text END AS clean_text
FROM documents d LEFT JOIN g USING (doc_id)
"""
