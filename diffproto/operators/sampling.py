"""Seeded per-class sampling: caps, m-shot fit samples, dev complements.

Order within a class is the md5 of ``seed:key...`` (ties broken by the key),
so the same seed gives the same split in Spark and in DuckDB, and the m = 2
sample is always inside the m = 4 sample.

Scale notes
* Top-n per class is a mergeable bottom-n in one pass, or, for large n, a rank
  inside hash buckets that start before place n, so a class holding a third of
  all rows never reaches one task.
* The uncapped dev set is a ``left_anti`` join against the fit keys (at most
  n_classes * m rows per seed), never a full ranking.
* Exact positions of dev rows (``dataset_index``) come from a bucketed rank:
  rows are split by the first hex digits of their md5 (monotone in the order),
  counted per (class, bucket) -- a table of at most n_classes * 16^k rows --
  and numbered inside (class, bucket).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..plans.broadcast import bounded_broadcast

KEY = ("claim_id", "set_pos")
LABEL_CODES = (0, 1, 2)


def _seeds(seeds) -> list[int]:
    return [int(seeds)] if isinstance(seeds, int) else [int(s) for s in seeds]


def with_seed(df: DataFrame, seeds) -> DataFrame:
    """Add a ``seed`` column; several seeds multiply the rows (generator)."""
    s = _seeds(seeds)
    if len(s) == 1:
        return df.withColumn("seed", F.lit(s[0]))
    return df.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in s])))


def shuffle_key(key: Sequence[str] = KEY) -> Column:
    return seeded_hash("seed", *key)


def _bucketed(df: DataFrame, seeds, by: Sequence[str], key: Sequence[str], hex_digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their order key ``_h`` and its first digits ``_b``, and per
    (seed, class, bucket) the number of rows in earlier buckets, ``_off``."""
    d = with_seed(df, seeds).withColumn("_h", shuffle_key(key)).withColumn("_b", F.substring("_h", 1, hex_digits))
    counts = d.groupBy("seed", *by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("seed", *by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return d, counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def _null_safe(d: DataFrame, offsets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that keeps rows whose class is null."""
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in on], "_off")
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        cond = e if cond is None else cond & e
    return d.join(o, cond).drop(*[f"_o_{c}" for c in on])


#: Up to this many rows a class, the first ones come from one pass (Spark's own bound of its window group limit).
ONE_PASS = 1000
DEALT = 64


def top_per_class(df: DataFrame, seeds, n: int, by: Sequence[str] = ("label",),
                  key: Sequence[str] = KEY, hex_digits: int = 3) -> DataFrame:
    """Rows with ``rank <= n`` in the seeded order of their class (+ seed, rank).

    A small sample is a mergeable bottom-n in one pass over the rows for all
    seeds: every task keeps at most n rows of each (seed, class, part), the
    parts' n are merged by a second window over at most ``DEALT`` * n rows of
    a class.  A larger one goes by buckets: the order key is a hash, so its
    first digits cut a class into up to 16^hex_digits buckets in order, which
    are counted (map-side combined); those that start at or beyond place n are
    dropped before any row is shuffled, and the rest are ranked inside their
    bucket only.  Either way no task gets a whole class, whatever its share
    of the rows and whatever the session's settings, and the rows are the same."""
    n = int(n)
    if n <= ONE_PASS:
        d = with_seed(df, seeds).withColumn("_h", shuffle_key(key)).withColumn("_p", F.substring("_h", -2, 2))
        d = d.withColumn("_p", F.pmod(F.conv("_p", 16, 10).cast("int"), F.lit(DEALT)))
        part = Window.partitionBy("seed", *by, "_p").orderBy("_h", *key)
        whole = Window.partitionBy("seed", *by).orderBy("_h", *key)
        few = d.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= F.lit(n))
        return (few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= F.lit(n))
                .drop("_h", "_p"))
    d, offsets = _bucketed(df, seeds, by, key, hex_digits)
    kept = _null_safe(d, offsets.filter(F.col("_off") < F.lit(n)), ["seed", *by, "_b"])
    w = Window.partitionBy("seed", *by, "_b").orderBy("_h", *key)
    return (kept.withColumn("rank", (F.col("_off") + F.row_number().over(w)).cast("int"))
            .filter(F.col("rank") <= F.lit(n))
            .drop("_h", "_b", "_off"))


def fit_sample(df: DataFrame, seeds, m: int, by: Sequence[str] = ("label",),
               key: Sequence[str] = KEY) -> DataFrame:
    """The m-shot fit sample per class; a class with fewer rows gives all."""
    return top_per_class(df, seeds, m, by, key)


def cap_per_class(df: DataFrame, seeds, caps: dict[int, int], by: str = "label",
                  key: Sequence[str] = KEY) -> DataFrame:
    """Seeded shuffle then a per-class cap (e.g. 3333 / 1666 / 1667)."""
    cap_col = None
    for code, cap in caps.items():
        cond = F.col(by) == F.lit(code)
        cap_col = F.when(cond, F.lit(int(cap))) if cap_col is None else cap_col.when(cond, F.lit(int(cap)))
    # a class without a cap is a mistake of the caller's, not an empty class
    cap_col = cap_col.otherwise(F.raise_error(F.concat(F.lit("no cap for class "), F.coalesce(F.col(by).cast("string"), F.lit("null")))))
    top = top_per_class(df, seeds, max(caps.values()), (by,), key)
    return top.filter(F.col("rank") <= cap_col)


def dev_capped(df: DataFrame, seeds, n: int, by: str = "label", key: Sequence[str] = KEY) -> DataFrame:
    """An independent dev file capped at n per class (70 in the reference)."""
    return top_per_class(df, seeds, n, (by,), key)


def split_capped(df: DataFrame, seeds, m: int, caps: dict[int, int], by: str = "label",
                 key: Sequence[str] = KEY) -> DataFrame:
    """Capped pool with ``split`` = fit (rank <= m) or dev (m < rank <= cap)."""
    pool = cap_per_class(df, seeds, caps, by, key)
    return pool.withColumn("split", F.when(F.col("rank") <= m, F.lit("fit")).otherwise(F.lit("dev")))


def dev_complement(df: DataFrame, seeds, m: int, by: str = "label", key: Sequence[str] = KEY,
                   n_classes: int = len(LABEL_CODES)) -> DataFrame:
    """All rows that are not in the m-shot fit sample (uncapped dev set).

    A left-anti join against the fit keys; their number is bounded by
    seeds * classes * m, checked before broadcasting.
    """
    s = _seeds(seeds)
    fit_keys = fit_sample(df, s, m, (by,), key).select("seed", *key)
    fit_keys = bounded_broadcast(fit_keys, len(s) * n_classes * m, 64)
    return with_seed(df, s).join(fit_keys, ["seed", *key], "left_anti")


def exact_rank(df: DataFrame, seeds, by: Sequence[str] = ("label",), key: Sequence[str] = KEY,
               hex_digits: int = 3) -> DataFrame:
    """Full seeded rank within class without a window over the whole class.

    The first ``hex_digits`` of the md5 order key split each class into up to
    16^k buckets; counts per (seed, class, bucket) give each bucket's offset
    (a small table, broadcast), and ``row_number`` runs inside buckets only.
    """
    d, offsets = _bucketed(df, seeds, by, key, hex_digits)
    wb = Window.partitionBy("seed", *by, "_b").orderBy("_h", *key)
    return (_null_safe(d, offsets, ["seed", *by, "_b"])
            .withColumn("rank", F.col("_off") + F.row_number().over(wb))
            .drop("_h", "_b", "_off"))


def dev_with_index(df: DataFrame, seed: int, m: int, by: str = "label", key: Sequence[str] = KEY,
                   class_order: Iterable[int] = LABEL_CODES) -> DataFrame:
    """Uncapped dev rows with ``dataset_index``: 0-based place in the dev list
    (classes in ``class_order``, each in shuffled order)."""
    return with_index(exact_rank(df, seed, (by,), key), m, by, class_order)


def with_index(ranked: DataFrame, m: int, by: str = "label", class_order: Iterable[int] = LABEL_CODES) -> DataFrame:
    """The rows after rank ``m`` of an exact ranking, with ``dataset_index``."""
    ranked = ranked.filter(F.col("rank") > m)
    sizes = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    order = F.create_map(*[x for i, c in enumerate(class_order) for x in (F.lit(c), F.lit(i))])
    wo = Window.orderBy(F.element_at(order, F.col(by))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    offsets = bounded_broadcast(offsets, len(list(class_order)) + 1, 32)
    return (ranked.join(offsets, by)
            .withColumn("dataset_index", F.col("_off") + F.col("rank") - F.lit(m) - 1)
            .drop("_off"))


def capped_with_index(df: DataFrame, seed: int, m: int, caps: dict[int, int], by: str = "label",
                      key: Sequence[str] = KEY, class_order: Iterable[int] = LABEL_CODES) -> DataFrame:
    """Capped split with ``dataset_index`` for the dev rows.  The pool
    (bounded by sum(caps) rows) feeds both the dev rows and the class
    offsets, so it is stored once instead of ranked twice."""
    from ..session import scratch_table

    pool = scratch_table(split_capped(df, seed, m, caps, by, key), "capped-pool")
    dev = pool.filter(F.col("split") == "dev")
    sizes = dev.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    order = F.create_map(*[x for i, c in enumerate(class_order) for x in (F.lit(c), F.lit(i))])
    wo = Window.orderBy(F.element_at(order, F.col(by))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    offsets = bounded_broadcast(offsets, len(list(class_order)) + 1, 32)
    return (pool.join(offsets, by, "left")
            .withColumn("dataset_index",
                        F.when(F.col("split") == "dev", F.col("_off") + F.col("rank") - F.lit(m) - 1))
            .drop("_off"))


def binary_split(df: DataFrame, seeds, m: int, caps: dict[int, int] | None = None,
                 key: Sequence[str] = KEY) -> DataFrame:
    """Binary task split: classes 1 and 2 merged into one pool ``not`` that is
    re-ranked as a whole.  With ``caps`` the three-way pool is capped first.

    Returns fit rows and dev rows with ``blabel`` and ``split``.
    """
    from ..functions.labels import label_to_binary

    s = _seeds(seeds)
    merge = lambda d: d.withColumn("blabel", label_to_binary("label"))
    if caps:
        src = merge(cap_per_class(df, s, caps, "label", key).drop("rank"))
        # one seed at a time: the pool, and so the ranking, differs by seed
        fits = [top_per_class(src.filter(F.col("seed") == x).drop("seed"), x, m, ("blabel",), key) for x in s]
        fit = fits[0]
        for f in fits[1:]:
            fit = fit.unionByName(f)
    else:
        src = merge(with_seed(df, s))
        fit = top_per_class(merge(df), s, m, ("blabel",), key)
    keys = bounded_broadcast(fit.select("seed", *key), len(s) * 2 * m, 64)
    dev = src.join(keys, ["seed", *key], "left_anti")
    fit = fit.withColumn("split", F.lit("fit"))
    dev = dev.withColumn("rank", F.lit(None).cast("int")).withColumn("split", F.lit("dev"))
    return fit.unionByName(dev)
