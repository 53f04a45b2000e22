"""Views over the driver tables that feed every operator.

The driver tables hold no claim data, so each input of the reference is
derived by a fixed rule (the same rule is written in DuckDB SQL for the
oracle):

* ``vec_pairs``      embeddings -> claim/evidence vector pairs, 3 classes
* ``nested_claims``  documents + labels -> nested claim records
* ``corpus``         documents -> corpus records (doc_id, abstract)
* ``corpus_claims``  benchmark -> claims with an evidence map or cited ids
* ``text_pairs``     conversations -> (user turn, assistant reply) pairs
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hex8_to_int, seeded_hash
from ..functions.text import non_blank_lines
from ..functions.vectors import as_double

# Fixed values of the vec_pairs rule: class k mixes the claim vector with a
# partner vector; evidence = w_claim * a + w_partner * b.
VEC_PAIR_WEIGHTS = [(0, 0.8, 0.2), (1, 0.4, 0.6), (2, 0.0, 1.0)]

# Fixed value of the corpus_claims rule: documents that an odd item cites.
CITED = 25

EVIDENCE_SCHEMA = T.MapType(
    T.StringType(),
    T.ArrayType(T.StructType([
        T.StructField("sentences", T.ArrayType(T.IntegerType())),
        T.StructField("label", T.StringType()),
    ])),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, set_pos, pair_id, label, claim_vec, evidence_vec)``.

    Every embeddings row ``a`` (ids 0..n-1) gives three pairs; for class k the
    partner ``b`` is row ``(a + 1 + k) mod n`` and the evidence is a mix of
    ``a`` and ``b``.  n comes from a scalar subquery, the partner from an
    equi-join (shuffled at scale, no row is sent to the driver).
    """
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = emb.agg(F.count(F.lit(1))).scalar()
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(wa).cast("double").alias("wa"),
                                 F.lit(wb).cast("double").alias("wb"))
                        for k, wa, wb in VEC_PAIR_WEIGHTS])
    a = (emb.select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("a"),
                    F.explode(weights).alias("w"))
         .withColumn("partner", F.pmod(F.col("claim_id") + 1 + F.col("w.k"), n)))
    b = emb.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("b"))
    j = a.join(b, "partner")
    ev = F.zip_with(as_double("a"), as_double("b"),
                    lambda x, y: x * F.col("w.wa") + y * F.col("w.wb"))
    return j.select(
        F.col("claim_id"),
        F.col("w.k").cast("int").alias("set_pos"),
        (F.col("claim_id") * 3 + F.col("w.k")).alias("pair_id"),
        F.col("w.k").cast("int").alias("label"),
        as_double("a").alias("claim_vec"),
        ev.alias("evidence_vec"),
    )


def nested_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, claim, label, sentences, evidence_sets)`` like the
    reference's nested claim records (label is the word)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id")
    sentences = non_blank_lines("text")
    label = (F.when(F.col("toxic") == 1, F.lit("REFUTES"))
             .when(F.col("quality") == 1, F.lit("SUPPORTS"))
             .otherwise(F.lit("NOT ENOUGH INFO")))
    return (j.select(F.col("doc_id").alias("claim_id"), sentences.alias("sentences"), label.alias("label"))
            .select("claim_id",
                    F.get(F.col("sentences"), 0).alias("claim"),
                    "label",
                    "sentences",
                    evidence_sets(F.size("sentences")).alias("evidence_sets")))


def evidence_sets(n) -> F.Column:
    """Sets over all ``n`` sentences, each in one set: [0], [1, 2], [3], [4, 5]
    and so on, the last one as long as there are sentences."""
    block = lambda j: F.filter(
        F.array(F.array(j * 3), F.filter(F.array(j * 3 + 1, j * 3 + 2), lambda i: i < n)), lambda s: F.size(s) > 0)
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 3).cast("int"), F.lit(0)))
    return F.when(n > 0, F.flatten(F.transform(blocks, block))).otherwise(F.array().cast("array<array<int>>"))


def first_evidence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with ``evidences ARRAY<ARRAY<STRING>>`` (the evidence texts of
    each set), for the first-evidence reader."""
    nc = nested_claims(spark, sf_dir)
    return nc.select(
        "claim_id", "claim", "label",
        F.transform("evidence_sets",
                    lambda s: F.transform(s, lambda i: F.element_at("sentences", i + 1))).alias("evidences"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, abstract)``: the non-blank lines of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", non_blank_lines("text").alias("abstract"))


def corpus_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, claim, evidence, cited_doc_ids)`` from ``benchmark``.

    Documents are picked by hash over the whole corpus: number ``j`` of an
    item is the document whose place is the hash of (item, j) modulo the
    number of documents (ids are 0 .. n-1).  Even items cite their documents
    0 to 4, each with one gold sentence, picked by hash over all of its
    sentences (CONTRADICT when ``item_id % 4 = 2``, else SUPPORT); odd items
    have an empty evidence map and cite ``CITED`` documents.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(non_blank_lines("text")).alias("n_sentences"))
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    j = F.when(F.pmod("item_id", F.lit(2)) == 0, F.sequence(F.lit(0), F.lit(4))).otherwise(F.sequence(F.lit(0), F.lit(CITED - 1)))
    cited = b.select("item_id", F.explode(j).alias("j")).withColumn(
        "doc_id", F.pmod(hex8_to_int(seeded_hash(F.lit("cite"), "item_id", "j")), n).cast("bigint"))
    cited = cited.dropDuplicates(["item_id", "doc_id"])
    sized = cited.join(docs, "doc_id").filter(F.col("n_sentences") > 0)
    sentence = F.pmod(hex8_to_int(seeded_hash(F.lit("gold"), "item_id", "doc_id")), F.col("n_sentences")).cast("int")
    ann = F.array(F.struct(
        F.array(sentence).alias("sentences"),
        F.when(F.pmod("item_id", F.lit(4)) == 2, F.lit("CONTRADICT")).otherwise(F.lit("SUPPORT")).alias("label")))
    # an item cites at most CITED documents, so its map is small
    per = sized.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), ann))).alias("gold"),
        F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("cited_doc_ids"))
    even = F.pmod("item_id", F.lit(2)) == 0
    empty = F.create_map().cast(EVIDENCE_SCHEMA)
    return b.join(per, "item_id").select(
        F.col("item_id").alias("claim_id"), F.col("text").alias("claim"),
        F.when(even, F.col("gold").cast(EVIDENCE_SCHEMA)).otherwise(empty).alias("evidence"), "cited_doc_ids")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, set_pos, claim, evidence, label)``: a user turn and the
    assistant turn right after it (turn + 1); label = conv_id mod 3.

    An equi-join on (conv_id, turn) rather than a window over conv_id, so a
    very long conversation is spread over many tasks.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = c.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("next_turn"), F.col("turn"), F.col("text").alias("claim"))
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("evidence"))
    return (user.join(reply, ["conv_id", "next_turn"])
            .select(F.col("conv_id").alias("claim_id"),
                    F.col("turn").cast("int").alias("set_pos"),
                    "claim", "evidence",
                    F.pmod(F.col("conv_id"), 3).cast("int").alias("label")))
