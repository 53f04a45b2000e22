"""Benchmark decontamination: size-partitioned MinHash containment search.

Which documents contain a benchmark item?  Documents are partitioned by the
size of their shingle set, in powers of two, and each size class has its own
MinHash: one permutation whose range is cut into as many bins as the class's
largest size, the smallest hash of a bin being its value.  The signature
grows with the class, so that a few dozen shared shingles are as likely to
show up in a document of 20,000 words as in one of 50.  An item has a
signature in each class.  A document and an item become a candidate pair
when they agree in a bin (bands of one row); the exact containment of the
item's shingles in the document then decides.

With 2^b bins a shingle, a shared one is not the minimum of its bin in the
document with a chance of at most 2^-(b + 1), independently over shingles;
b follows from the smallest item, so that a pair over the threshold is
missed with a chance of at most 2^-20 (b = 0 if that shares 20 shingles).

Everything is native: arrays of hashes inside a row, one equi-join on
(class, value), a distinct, and one equi-join back to the documents that a
blocked Bloom filter of the candidates passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from .common import SHINGLE, once, read, stored, with_shingles
from .url_filter import possible

THRESHOLD = (3, 4)
MISS_BITS = 20  # a pair over the threshold is missed with a chance of at most 2^-MISS_BITS
#: Size classes are 2^0 .. 2^MAX_CLASS shingles; larger documents are in the last.
MAX_CLASS = 30
_ITEM_ROWS = 1 << 18
#: Blocks of the filter on candidate documents: 512 bits each, 5 MB at most.
FILTER_BLOCKS = 1 << 16


def size_class(n: Column) -> Column:
    """The least c with n <= 2^c."""
    return F.least(F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(MAX_CLASS))


def finer(shared: int) -> int:
    """How many bits to add to a class's bins for items that share at least
    ``shared`` shingles: with 2^b bins a shingle, one is not its bin's minimum
    with a chance of at most 2^-(b + 1)."""
    return -(-MISS_BITS // shared) - 1


def bin_minima(sorted_hashes: Column, bits: Column) -> Column:
    """One-permutation MinHash.  A hash's bin is its ``bits`` highest bits,
    so in an ascending array every bin is a run and its first entry the
    minimum.  The array must be a column of its own, as it is read twice."""
    at = lambda x: F.call_function("shiftrightunsigned", x, (F.lit(64) - bits).cast("int"))
    return F.filter(
        sorted_hashes,
        lambda x, i: (bits > 0) & ((i == 0) | (at(x) != at(F.get(sorted_hashes, i - 1)))) | (bits == 0) & (i == 0),
    )


def item_sets(items: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(item_id, item_set); items without words have no set and match nothing."""
    s = with_shingles(items.select(F.col(id_col).alias("item_id"), F.col(text).alias("__t")), "__t", "item_set", k)
    return s.filter(F.size("item_set") > 0).filter("item_id is not null").select("item_id", "item_set")


def candidates(docs: DataFrame, items: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Distinct (doc_id, item_id) that agree in a bin.  ``docs``: doc_id and
    doc_set; ``items``: item_id and item_set."""
    # the smallest item decides how fine the bins are, so that one signature serves all items
    least = items.agg(F.min(F.size("item_set"))).first()[0] or 1
    bits = F.least(F.col("c") + finer(-(-least * threshold[0] // threshold[1])), F.lit(62))
    classes = items.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(MAX_CLASS))))
    values = classes.select("item_id", "c", F.explode(bin_minima(F.col("item_set"), bits)).alias("value"))
    few = values.limit(_ITEM_ROWS + 1).count() <= _ITEM_ROWS
    values = bounded_broadcast(values, _ITEM_ROWS, 24) if few else values
    doc = docs.withColumn("c", size_class(F.size("doc_set"))).filter(F.size("doc_set") > 0)
    signature = doc.select("doc_id", "c", F.explode(once(bin_minima(F.col("doc_set"), bits))).alias("value"))
    return signature.join(values, ["c", "value"]).select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every pair in which
    the document holds at least ``threshold`` of the item's distinct
    shingles.

    Shingles are of ``k`` words, A-Z lower-cased; a text of fewer words is
    one shingle, its whole sequence, so such an item matches only a document
    that is the same sequence.  Texts without words, null texts, ids that
    are null, and empty tables match nothing.  Rows of one document id are
    verified one by one, and a pair is listed once, with its best row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__t")).filter("doc_id is not null and __t is not null")
    doc = with_shingles(base, "__t", "doc_set", k).select("doc_id", "doc_set")
    its = stored(item_sets(items, item_id, item_text, k), "items")
    pairs = stored(candidates(doc, its, threshold), "candidates")
    # only candidate documents come back, each with the list of its items; a Bloom filter of
    # bounded size keeps the texts of nearly all others out of the shuffle
    wanted = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("__items"))
    back = possible(base, "doc_id", pairs, "doc_id", FILTER_BLOCKS).join(wanted, "doc_id")
    back = with_shingles(back, "__t", "doc_set", k).select("doc_id", "doc_set", F.explode("__items").alias("item_id"))
    few = its.limit(_ITEM_ROWS // 64 + 1).count() <= _ITEM_ROWS // 64
    side = bounded_broadcast(its, _ITEM_ROWS // 64, 2048) if few else its
    exact = back.join(side, "item_id").select(
        "doc_id", "item_id", F.size("item_set").cast("long").alias("n_item"),
        F.size(F.array_intersect("item_set", "doc_set")).cast("long").alias("n_shared"),
    ).filter(F.col("n_shared") * threshold[1] >= F.col("n_item") * threshold[0])
    best = exact.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", null_ids: bool = False,
                  **options) -> DataFrame:
    """``docs`` without the rows that contain an item.  Of rows that share an
    id only those whose own text contains an item go.  Rows without an id all
    stay, or with ``null_ids`` are searched like the others."""
    # what a row contains depends on its text alone, so the text's digest is the key
    key = F.md5(F.col(text).cast("binary"))
    key = key if null_ids else F.when(F.col(id_col).isNotNull(), key)
    hit = contained(docs.select(key.alias("__row"), F.col(text)), items, id_col="__row", text=text, **options)
    return docs.join(hit.select(F.col("doc_id").alias("__hit")).distinct(), key == F.col("__hit"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def shingle_sql(table: str, key: str, k: int = SHINGLE) -> str:
    """DuckDB: (key, shingle) distinct rows of the texts in ``table``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
      SELECT DISTINCT {key}, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ')
                    ELSE array_to_string(list_slice(w, i, i + {k - 1}), ' ') END AS g
      FROM (SELECT {key}, w, unnest(range(1, CAST(greatest(len(w) - {k - 2}, 2) AS BIGINT))) AS i
            FROM (SELECT {key}, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w
                  FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0)"""


SQL = f"""
WITH d AS ({shingle_sql('documents', 'doc_id')}),
i AS ({shingle_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, COUNT(*) AS n_item FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, COUNT(*) AS n_shared FROM d JOIN i USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE n_shared * 4 >= n_item * 3
"""
