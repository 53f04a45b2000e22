"""Run logs: rendering, reading, noise removal and record parsing.

A run log is plain text: maybe a section marker line, then one record per
run, each a number of lines (a header, ``Accuracy: x``, ``F1-macro: y`` ...).
Files are read splittably.  A line's number is its split's offset, from a
table of one row per split, plus its place in the split; later steps number
lines in buckets of ``BUCKET`` lines with offsets from a table of one row per
bucket.  No task needs a whole file.

Layouts are data: the lines of a record that carry values, and the order of
the values once the fixed words are stripped.  Records are found by a header
line (the default) or by a fixed number of lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_text

# Text removed from the picked lines before splitting into
# fields, in this order.
STRIP_TOKENS = ["Accuracy: ", "Acc: ", "F1-macro: ", "F1-labelwise: ", "seed: ", "# of shots: ", "index of run:", ";", "[", "]"]
MARKER = "fever_fever"
BUCKET = 4096


@dataclass
class Layout:
    """``stride`` lines a record; ``lines``: offset -> text with ``{field}``
    places; ``fields``: (name, type) in the order of the values, a None name
    being skipped."""

    stride: int
    lines: dict[int, str]
    fields: Sequence[tuple[str | None, str]]
    strip_tokens: Sequence[str] = field(default_factory=lambda: list(STRIP_TOKENS))

    @property
    def picks(self) -> list[int]:
        return sorted(self.lines)

    @property
    def header(self) -> str:
        """Pattern of the record's first line."""
        value = {"int": r"\d+", "double": r"[0-9.eE+-]+", "string": r"\S+"}
        types = {n: t for n, t in self.fields if n}
        parts = re.split(r"(\{\w+\})", self.lines[0])
        return "^" + "".join(value[types.get(p[1:-1], "double")] if p[:1] == "{" else re.escape(p) for p in parts) + "$"


_RUN = [("seed", "int"), ("m", "int"), ("run", "int")]
_MODEL = [("model", "string"), ("m", "int"), ("seed", "int")]
_RUN_LINE = "seed: {seed}; # of shots: {m}; index of run:{run}"
_RUN_LINES = {0: "seed: {seed}", 1: "# of shots: {m}", 2: "index of run:{run}"}
_MODEL_LINES = {0: "{model}", 1: "# of shots: {m}", 2: "seed: {seed}"}
_PLAIN = [("accuracy", "double"), ("f1", "double")]
_THREE = [("accuracy", "double"), ("s", "double"), ("n", "double"), ("c", "double")]
_EIGHT = [(f"{p}_{x}_{t}", "double") for p in ("before", "after") for t in ("train", "dev") for x in ("acc", "f1")]
_EIGHT_LINES = {o: ("Acc: {%s}" if "_acc_" in n else "F1-macro: {%s}") % n for o, (n, _) in zip((2, 3, 5, 6, 8, 9, 11, 12), _EIGHT)}

# The eleven layouts of the published result logs.
LAYOUTS = {
    "prototype_plain": Layout(3, {0: "{m} {model} {seed}", 1: "Accuracy: {accuracy}", 2: "F1-macro: {f1}"},
                              [("m", "int"), ("model", "string"), ("seed", "int"), *_PLAIN]),
    "baseline_five": Layout(5, {0: _RUN_LINE, 4: "Acc: {accuracy}; F1-macro: {f1}"}, [*_RUN, *_PLAIN]),
    "baseline_three": Layout(3, {0: _RUN_LINE, 2: "Acc: {accuracy}; F1-macro: {f1}"}, [*_RUN, *_PLAIN]),
    "prototype_classes": Layout(9, _MODEL_LINES | {3: "Accuracy: {accuracy}", 4: "F1-macro: [{s} {n} {c}]"}, [*_MODEL, *_THREE]),
    "prototype_binary": Layout(16, _MODEL_LINES | {10: "Accuracy: {accuracy}", 12: "F1-labelwise: [{s} {not}]"},
                               [*_MODEL, ("accuracy", "double"), ("s", "double"), ("not", "double")]),
    "prototype_corpus": Layout(13, _MODEL_LINES | {6: "Accuracy: {accuracy}", 7: "F1-macro: [{s} {n} {c}]"}, [*_MODEL, *_THREE]),
    "baseline_binary": Layout(33, _RUN_LINES | {26: "F1-labelwise: [{s} {not}]", 27: "Accuracy: {accuracy}"},
                              [*_RUN, ("s", "double"), ("not", "double"), ("accuracy", "double")]),
    "baseline_classes": Layout(34, _RUN_LINES | {27: "Accuracy: {accuracy}", 28: "F1-macro: [{s} {n} {c}]"}, [*_RUN, *_THREE]),
    "baseline_corpus": Layout(33, _RUN_LINES | {26: "Accuracy: {accuracy}", 27: "F1-macro: [{s} {n} {c}]"}, [*_RUN, *_THREE]),
    "before_after": Layout(13, {0: _RUN_LINE} | _EIGHT_LINES, [*_RUN, *_EIGHT]),
    "before_after_tuned": Layout(13, {0: _RUN_LINE + " {rate} {epochs}"} | _EIGHT_LINES,
                                 [*_RUN, (None, "double"), (None, "double"), *_EIGHT]),
}
PROTOTYPE_PLAIN = LAYOUTS["prototype_plain"]


def fmt4(c) -> F.Column:
    return F.format_string("%.4f", c)


def render_records(records: DataFrame, noise_line: str | None = None, layout: Layout = PROTOTYPE_PLAIN,
                   marker: str | None = MARKER) -> DataFrame:
    """Run records -> log lines ``(model, line_no, line)`` in a layout: a
    marker line if given, then the records ordered by (seed, m, run) within
    each model's file.  Lines of a record that carry no value are filled; a
    noise line, if given, follows each header."""
    def text(o):
        if o not in layout.lines:
            return F.lit(f"step {o}")
        parts = [p for p in re.split(r"(\{\w+\})", layout.lines[o]) if p]
        double = {n for n, t in layout.fields if t == "double"}
        value = lambda n: fmt4(n) if n in double else F.col(n).cast("string")
        return F.concat(*[value(p[1:-1]) if p[0] == "{" else F.lit(p) for p in parts])

    parts = [text(o) for o in range(layout.stride)]
    if noise_line is not None:
        parts.insert(1, F.lit(noise_line))
    k, first = len(parts), int(marker is not None)
    order = [c for c in ("seed", "m", "run") if c in records.columns]
    recs = records.withColumn("_i", F.row_number().over(Window.partitionBy("model").orderBy(*order)) - 1)
    body = recs.select("model", F.posexplode(F.array(*parts)).alias("_j", "line"), "_i").select(
        "model", (F.lit(first) + F.col("_i") * k + F.col("_j")).alias("line_no"), "line")
    if marker is None:
        return body
    return records.select("model").distinct().select(
        "model", F.lit(0).alias("line_no"), F.lit(marker).alias("line")).unionByName(body)


def write_log(lines: DataFrame, path: str) -> None:
    """One text file per model, lines in order."""
    (lines.repartition("model").sortWithinPartitions("model", "line_no")
     .select("model", "line").write.mode("overwrite").partitionBy("model").text(path))


def _numbered(lines: DataFrame, count_if, file_col: str) -> DataFrame:
    """Adds ``_before``: how many earlier lines of the file satisfy
    ``count_if``.  Lines are counted in buckets of ``BUCKET`` lines."""
    d = lines.withColumn("_b", F.floor(F.col("line_no") / BUCKET)).withColumn("_x", count_if.cast("int"))
    per = d.groupBy(file_col, "_b").agg(F.sum("_x").alias("_n"))
    upto = Window.partitionBy(file_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(file_col, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(file_col, "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(per, [file_col, "_b"])
            .withColumn("_before", F.col("_off") + F.coalesce(F.sum("_x").over(inner), F.lit(0)))
            .drop("_b", "_x", "_off"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` for every line of every file under ``path``;
    lines are stripped.  The lines of one split of a file are read in order by
    one task, so their ids are consecutive from the split's smallest."""
    from ..session import scratch_table

    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = scratch_table(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
                                   F.monotonically_increasing_id().alias("_id"), "value"), "log-lines")
    splits = raw.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    return raw.join(splits, ["file", "_at"]).select(
        "file", (F.col("_off") + F.col("_id") - F.col("_first")).cast("int").alias("line_no"), strip_text("value").alias("line"))


def after_marker(lines: DataFrame, marker: str = MARKER, file_col: str = "file") -> DataFrame:
    """Lines strictly after the first marker line of each file, renumbered
    from 0; a file without the marker raises."""
    first = lines.groupBy(file_col).agg(F.min(F.when(F.col("line") == marker, F.col("line_no"))).alias("_start"))
    first = first.withColumn("_start", F.coalesce("_start", F.raise_error(
        F.concat(F.lit(f"no line {marker!r} in "), F.col(file_col)))))
    j = lines.join(first, file_col).filter(F.col("line_no") > F.col("_start"))
    return j.select(file_col, (F.col("line_no") - F.col("_start") - 1).alias("line_no"), "line")


def drop_noise(lines: DataFrame, noise: Sequence[str], file_col: str = "file") -> DataFrame:
    """Remove known noise lines and renumber the rest."""
    is_noise = F.col("line").isin(list(noise))
    d = _numbered(lines, is_noise, file_col).filter(~F.col("line").isin(list(noise)))
    return d.select(file_col, (F.col("line_no") - F.col("_before")).cast("int").alias("line_no"), "line")


def _records(rel: DataFrame, layout: Layout, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, ``_f``, line) of picked lines -> typed records; only
    records with their last picked line are kept (a cut-off one is dropped,
    as ``zip`` does)."""
    picks = layout.picks
    recs = (rel.filter(F.col("_f").isin(picks)).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_f").alias("o"), F.col("line").alias("l")))).alias("_ls"),
                 F.max("_f").alias("_last")))
    text = F.concat_ws(" ", F.transform("_ls", lambda s: s["l"]))
    for tok in layout.strip_tokens:
        text = F.replace(text, F.lit(tok), F.lit(""))
    out = recs.filter(F.col("_last") == max(picks)).select(F.split(F.trim(text), r"\s+").alias("_p"))
    return out.select(*[F.element_at("_p", i + 1).cast(t).alias(name) for i, (name, t) in enumerate(layout.fields) if name])


def parse_anchored(lines: DataFrame, layout: Layout, file_col: str = "file") -> DataFrame:
    """Records that start at each line of the header's form, whatever stands
    between them; values are taken at the layout's offsets from there."""
    d = lines.withColumn("_b", F.floor(F.col("line_no") / BUCKET)).withColumn(
        "_h", F.when(F.col("line").rlike(layout.header), F.col("line_no")))
    per = d.groupBy(file_col, "_b").agg(F.max("_h").alias("_m"))
    upto = Window.partitionBy(file_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(file_col, "_b", F.max("_m").over(upto).alias("_carry"))
    inner = Window.partitionBy(file_col, "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rel = (d.join(per, [file_col, "_b"]).withColumn("_rec", F.coalesce(F.max("_h").over(inner), "_carry"))
           .filter(F.col("_rec").isNotNull()))
    rel = rel.select(file_col, "_rec", (F.col("line_no") - F.col("_rec")).alias("_f"), "line")
    return _records(rel, layout, [file_col, "_rec"])


def parse_stride(lines: DataFrame, layout: Layout, file_col: str = "file") -> DataFrame:
    """Records of exactly ``layout.stride`` lines, from the first line on."""
    rel = lines.select(file_col, F.floor(F.col("line_no") / layout.stride).alias("_rec"),
                       F.pmod(F.col("line_no"), F.lit(layout.stride)).alias("_f"), "line")
    return _records(rel, layout, [file_col, "_rec"])


def parse_runs(spark: SparkSession, path: str, layout: Layout = PROTOTYPE_PLAIN, marker: str | None = MARKER,
               noise: Sequence[str] = (), anchored: bool = True) -> DataFrame:
    """Read a run log folder and parse it with ``layout``."""
    lines = read_lines(spark, path)
    if marker is not None:
        lines = after_marker(lines, marker)
    if noise:
        lines = drop_noise(lines, noise)
    return parse_anchored(lines, layout) if anchored else parse_stride(lines, layout)


DRIFT_SCHEMA = T.StructType([
    T.StructField("step", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("Support", T.DoubleType()),
    T.StructField("Neutral", T.DoubleType()),
    T.StructField("Contradict", T.DoubleType()),
])


DRIFT_RATE_SCHEMA = T.StructType([T.StructField("step", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("s", "n", "c")])
BEFORE_AFTER_SCHEMA = T.StructType([T.StructField("m", T.IntegerType())] + [
    T.StructField(f"{k}_{n}", T.DoubleType()) for k in ("mean", "std") for n, _ in _EIGHT])


def read_drift(spark: SparkSession, path: str | list[str], schema: T.StructType = DRIFT_SCHEMA) -> DataFrame:
    """Tab-separated table with a header: drift, drift rate or before/after
    summary, by its schema.  Folders ``name=value`` become columns."""
    return (spark.read.option("sep", "\t").option("header", "true").option("mode", "FAILFAST")
            .schema(schema).csv(path))
