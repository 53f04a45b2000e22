"""Readers for nested claim records and corpora, and their flattening into
claim/evidence pairs ``(claim_id, set_pos, claim, evidence, label)``.

Always read with an explicit schema: inference turns the evidence map into a
struct with one field per document id, and a numeric array schema silently
nulls quoted ids.  ``mode=FAILFAST`` raises on type mismatches; missing
required fields are checked separately, since they read as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import seeded_index
from ..functions.labels import CLAIM_LABELS, CORPUS_LABELS, encode_label
from ..functions.text import join_selected, normalize_claim, normalize_evidence, to_doc_id
from .tables import EVIDENCE_SCHEMA

NESTED_CLAIM_SCHEMA = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("claim", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("sentences", T.ArrayType(T.StringType())),
    T.StructField("evidence_sets", T.ArrayType(T.ArrayType(T.IntegerType()))),
])

FIRST_EVIDENCE_SCHEMA = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("claim", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("evidences", T.ArrayType(T.ArrayType(T.StringType()))),
])

CORPUS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("abstract", T.ArrayType(T.StringType())),
])

CORPUS_CLAIM_SCHEMA = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("claim", T.StringType()),
    T.StructField("evidence", EVIDENCE_SCHEMA),
    # ids appear as 4 and as "4": a string array takes both, then cast
    T.StructField("cited_doc_ids", T.ArrayType(T.StringType())),
])


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Raise on NULL in required fields (a missing JSON key reads as NULL).

    The check is a filter, so Catalyst cannot prune it away."""
    checks = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing required field: {c}")))
              for c in cols]
    return df.filter(F.coalesce(*checks, F.lit(True)))


def scan_json(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return require(df, *required) if required else df


def scan_claims(spark: SparkSession, path: str) -> DataFrame:
    return scan_json(spark, path, NESTED_CLAIM_SCHEMA, ("claim", "label", "sentences", "evidence_sets"))


def flatten_pairs(claims: DataFrame, labels: dict[str, int] = CLAIM_LABELS,
                  single_only: bool = False) -> DataFrame:
    """One row per evidence set; the evidence is the chosen sentences joined
    by one blank, in set order.  A record with no sets gives no row; an empty
    set gives an empty evidence text.  ``single_only`` keeps sets of exactly
    one sentence (filtered inside the array, before the explode)."""
    sets = F.transform("evidence_sets", lambda s, i: F.struct(i.alias("pos"), s.alias("idx")))
    if single_only:
        sets = F.filter(sets, lambda x: F.size(x["idx"]) == 1)
    # the texts are joined inside the array: a row holds its own evidence, not the record's sentences
    texts = F.transform(sets, lambda x: F.struct(x["pos"].alias("pos"), join_selected("sentences", x["idx"]).alias("evidence")))
    return (claims.select("claim_id", "claim", "label", F.explode(texts).alias("_s"))
            .select("claim_id",
                    F.col("_s.pos").alias("set_pos"),
                    "claim",
                    F.col("_s.evidence").alias("evidence"),
                    encode_label("label", labels).alias("label")))


def flatten_first_evidence(claims: DataFrame, labels: dict[str, int] = CLAIM_LABELS,
                           fix_claim_order: bool = False) -> DataFrame:
    """First evidence text of each record, cleaned: evidence -> brackets,
    lower, strip; claim -> lower, strip, brackets (see ``normalize_claim``)."""
    first = F.get(F.get(F.col("evidences"), 0), 0)
    checked = F.when(first.isNotNull(), first).otherwise(F.raise_error(F.lit("record without evidence")))
    return claims.select(
        "claim_id",
        F.lit(0).alias("set_pos"),
        normalize_claim("claim", fix_claim_order).alias("claim"),
        normalize_evidence(checked).alias("evidence"),
        encode_label("label", labels).alias("label"))


def corpus_dedup(corpus: DataFrame, order_col: str | None = None) -> DataFrame:
    """Corpus keyed by ``doc_id``; a repeated id keeps the last record by
    ``order_col``, ties by a digest of the record.  Without an ordering column
    the ids must be unique: a count of repeated ids (a shuffle of ids only)
    feeds a scalar subquery that makes the scan raise."""
    if order_col is None:
        n_dup = (corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
                 .filter(F.col("_n") > 1).agg(F.count(F.lit(1)))).scalar()
        return corpus.filter(F.when(n_dup > 0, F.raise_error(
            F.lit("repeated doc_id: pass an order column to keep the last record"))).otherwise(F.lit(True)))
    # winners are found on ids, versions and digests; whole records are only fetched for them
    rest = [c for c in corpus.columns if c not in ("doc_id", order_col)]
    digest = F.xxhash64(*rest) if rest else F.lit(0)
    last = corpus.select(F.col("doc_id").alias("_id"), F.struct(F.col(order_col).alias("v"), digest.alias("h")).alias("_w")).groupBy("_id").agg(
        F.max("_w").alias("_w"))
    won = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col(order_col).eqNullSafe(F.col("_w.v")) & (digest == F.col("_w.h"))
    # records that are equal in everything are one
    return corpus.join(last, won, "left_semi").dropDuplicates(["doc_id"])


#: Cited documents up to this number are sent to the corpus instead of the corpus to them.
MAX_BROADCAST_IDS = 100_000


def _looked_up(keys: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every key with the abstract of its ``doc_id``.  The corpus is first cut
    down to the cited documents, by a semi-join whose small side is counted
    before it is broadcast; only those documents are checked and joined.  A
    cited id that is missing raises, and so does one that is there twice."""
    ids = keys.select("doc_id").distinct()
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    cited = corpus.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    once = cited.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.any_value("abstract").alias("abstract"))
    j = keys.join(once, "doc_id", "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("doc_id").cast("string")))
    return j.withColumn("abstract", F.when(F.col("_n") == 1, F.col("abstract")).when(
        F.col("_n") > 1, fail("repeated in the corpus, dedup it by an order column first: ")).otherwise(
        fail("document not in corpus: "))).drop("_n")


def cited_documents(claims: DataFrame) -> DataFrame:
    """One row per claim and cited document: the first annotation of a claim's
    evidence map, or none for the cited ids of a claim without evidence."""
    gold = F.transform(F.map_entries("evidence"), lambda e: F.struct(e["key"].alias("doc_key"), e["value"].alias("anns")))
    none = F.transform("cited_doc_ids", lambda d: F.struct(d.alias("doc_key"), F.lit(None).alias("anns")))
    entries = F.when(F.size("evidence") > 0, gold).otherwise(none)
    return (claims.select("claim_id", "claim", F.explode(entries).alias("e"))
            .select("claim_id", "claim", to_doc_id(F.col("e.doc_key")).alias("doc_id"),
                    F.element_at("e.anns", 1).alias("ann")))


def corpus_pairs(claims: DataFrame, corpus: DataFrame, seed: int = 0, labels: dict[str, int] = CORPUS_LABELS) -> DataFrame:
    """Claims with an evidence map: one pair per cited document, only the
    first annotation counts, label from that annotation.  Claims with an
    empty evidence map: one pair per cited document with one seeded-random
    sentence of it; the label is always 1.  The corpus is joined once."""
    j = _looked_up(cited_documents(claims), corpus)
    pick = F.element_at("abstract", (seeded_index(F.lit(seed), F.size("abstract"), "claim_id", "doc_id") + 1).cast("int"))
    gold = F.col("ann").isNotNull()
    return j.select("claim_id", F.col("doc_id").cast("int").alias("set_pos"), "claim",
                    F.when(gold, join_selected("abstract", F.col("ann.sentences"))).otherwise(pick).alias("evidence"),
                    F.when(gold, encode_label(F.col("ann.label"), labels)).otherwise(F.lit(1)).alias("label"))


def corpus_pairs_gold(claims: DataFrame, corpus: DataFrame, labels: dict[str, int] = CORPUS_LABELS) -> DataFrame:
    """The pairs of claims with an evidence map."""
    return corpus_pairs(claims.filter(F.size("evidence") > 0), corpus, labels=labels)


def corpus_pairs_neutral(claims: DataFrame, corpus: DataFrame, seed: int = 0) -> DataFrame:
    """The pairs of claims with an empty evidence map."""
    return corpus_pairs(claims.filter(F.size("evidence") == 0), corpus, seed)
