"""Language ID with string kernels.

The kernel of two texts counts the character n-grams (n = 1 .. ``SPECTRUM``)
present in both, over the geometric mean of how many each has (a blended
spectrum of presences, normalised).  N-grams of the lower-cased text, every
non-letter being a space, are hashed to ``BUCKETS``.  Nyström landmarks turn
the kernel into features of bounded size, and one-versus-rest kernel ridge
regression is solved on them in closed form.  A batch of texts is scored by
two matrix products: presences by landmarks, kernels by weights.

The model is fitted on a bounded sample (at most ``MAX_TRAIN`` labelled
rows, spread evenly over the languages, chosen by a hash of their id), of
which only presence bits travel to the driver.  Prediction is a map over
every whole text; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from ..session import ship_package
from .common import once, read, stored

SPECTRUM = 3
BUCKETS = 1 << 15
MAX_TRAIN = 1600
LANDMARKS = 200
RIDGE = 1e-2
UNDETERMINED = "und"
#: A text is rejected below this score: every one-versus-rest output is then under -0.8.
MIN_SCORE = 0.1
HELD_OUT = 2  # the remainder of crc32(id) mod 4 that is never learned from
_BATCH_CHARS = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def _codes() -> np.ndarray:
    """Code point -> itself for letters, else the space; for the lower planes."""
    t = np.full(0x3100, 32, dtype=np.uint32)
    for c in range(len(t)):
        if chr(c).isalpha():
            t[c] = c
    return t


_CODES = _codes()


def _points(text: str) -> np.ndarray:
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = p < len(_CODES)
    return _CODES[p] if low.all() else np.where(low, _CODES[np.where(low, p, 0)], p)


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """The buckets of all n-grams, one for each start."""
    h = np.full(max(0, len(points) - n + 1), n, dtype=np.uint32)
    for i in range(n):
        h = (h ^ points[i: len(points) - n + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def presence(texts: list[str], column: np.ndarray, width: int) -> np.ndarray:
    """(texts x width) 0/1 matrix of the n-grams' columns; ``column`` maps a
    bucket to its column, or to ``width`` if it has none."""
    out = np.zeros((len(texts), width + 1), dtype=np.float32)
    flat = out.ravel()
    pts = [_points(t) for t in texts]
    for n in range(1, SPECTRUM + 1):
        for row, p in enumerate(pts):
            if len(p) >= n:
                flat[column[grams(p, n)] + row * (width + 1)] = 1
    return out[:, :width]


def chunks(texts: list[str], most: int = 256):
    """Runs of at most ``most`` texts and about ``_BATCH_CHARS`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most or size + len(t) > _BATCH_CHARS):
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


@dataclass
class Model:
    langs: list[str]
    column: np.ndarray  # bucket -> column of the landmarks' n-grams
    landmarks: np.ndarray  # columns x landmarks, each over the root of its count
    weights: np.ndarray  # landmarks x languages

    def kernel(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(1.0, x.sum(axis=1, dtype=np.float64))).astype(np.float32)
        return (x @ self.landmarks) / norm[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.langs:
            return lang, score
        told = [texts[i] for i in rows]
        for start, part in chunks(told):
            s = self.kernel(presence(part, self.column, self.landmarks.shape[0])) @ self.weights
            best = s.argmax(axis=1)
            for j, b in enumerate(best):
                i = rows[start + j]
                lang[i] = self.langs[b]
                score[i] = min(1.0, max(0.0, (float(s[j, b]) + 1) / 2))
        return lang, score


def fit_bits(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model of presence rows (texts x BUCKETS) and their languages.  Rows
    come grouped evenly over the languages; every k-th one is a landmark."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros(BUCKETS, dtype=np.int64), np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    chosen = np.unique(np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int))
    used = np.flatnonzero(bits[chosen].any(axis=0))
    column = np.full(BUCKETS, len(used), dtype=np.int64)
    column[used] = np.arange(len(used))
    x = bits[:, used].astype(np.float32)
    marks = x[chosen].T / np.sqrt(np.maximum(1, x[chosen].sum(axis=1)))
    model = Model(langs, column, np.ascontiguousarray(marks), np.zeros((len(chosen), len(langs)), dtype=np.float32))
    k_nm = model.kernel(x).astype(float)
    k_mm = k_nm[chosen]
    w, v = np.linalg.eigh((k_mm + k_mm.T) / 2)
    root = v / np.sqrt(np.maximum(w, 1e-8 * w.max()))  # Nyström: the kernel's inverse square root
    phi = k_nm @ root
    y = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + ridge * len(bits) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    model.weights = (root @ beta).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is ``HELD_OUT``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Fits on rows with a language, a text with letters, and an id that is not
    held out: about ``max_train`` of them, spread evenly over the languages, and
    two at least of each, however many there are.  The landmarks bound the
    model; a language costs it one column of weights."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        (F.pmod(F.xxhash64(F.col(id_col), F.length(text)), F.lit(1 << 30)) / (1 << 30)).alias("h"),
    )
    counts = stored(rows.groupBy(F.col("lang").alias("__l")).agg(F.count(F.lit(1)).alias("__n")), "lang-counts")
    n_langs = counts.count()
    if not n_langs:
        return fit_bits(np.zeros((0, BUCKETS), dtype=np.uint8), [])
    each = max(2, max_train // n_langs)
    # a hash threshold thins the rows in the scan; what is left is ranked, a few times the quota
    known = rows.join(bounded_broadcast(counts, n_langs, 128), F.col("lang") == F.col("__l"))
    top = Window.partitionBy("lang").orderBy("h", "text")
    sample = known.filter(F.col("h") < 3.0 * each / F.col("__n")).withColumn("i", F.row_number().over(top)).filter(F.col("i") <= each)

    def bits(batches):
        every = np.arange(BUCKETS)
        for b in batches:
            told = [(g, t) for g, t in zip(b["lang"], b["text"], strict=True) if _LETTER.search(t)]
            for start, part in chunks([t for _, t in told], 64):
                x = presence(part, every, BUCKETS).astype(bool)
                yield pd.DataFrame({
                    "lang": [told[start + j][0] for j in range(len(part))], "bits": [np.packbits(r).tobytes() for r in x]
                })

    got = sorted(sample.select("lang", "text").mapInPandas(bits, "lang string, bits binary").collect(), key=lambda r: (r["lang"], r["bits"]))
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)) for r in got], dtype=np.uint8).reshape(-1, BUCKETS)
    return fit_bits(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``out`` and ``score`` (0 to 1).

    A text that is null or has no letter gets ``und`` and 0, as does every
    text if the model was fitted on nothing.  Every row gives one row.
    Columns of ``docs`` named ``out`` or ``score`` are replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by LANDMARKS x BUCKETS

    @F.pandas_udf("lang string, score double")
    def run(col):
        lang, s = shared.value.predict(list(col))
        return pd.DataFrame({"lang": lang, "score": s})

    rest = docs.drop(*[c for c in (out, score) if c != text])
    return rest.withColumn("__p", run(F.col(text))).withColumn(out, F.col("__p.lang")).withColumn(score, F.col("__p.score")).drop("__p")


def accepted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE,
             relabel: bool = False) -> DataFrame:
    """``docs`` without the texts that are in no language: null texts, texts
    without a letter, and those that the classifier scores below
    ``min_score`` for every language.  With no label to learn from, a score
    rejects nothing, and every text with a letter stays.  With ``relabel``,
    ``lang`` becomes the language found, where there was one to learn."""
    ship_package(docs.sparkSession)
    model = fit(docs, id_col=id_col, text=text, lang=lang)
    if not model.langs:
        @F.pandas_udf("boolean")
        def lettered(col):
            return pd.Series([bool(t and _LETTER.search(t)) for t in col], dtype=bool)

        return docs.filter(lettered(F.col(text)))
    told = identify(docs, model, text=text, out="__lang", score="__score")
    # each text predicted once: a filter pushed below the prediction would repeat it, with one more Python worker a task
    told = told.withColumn("__lang", once(F.col("__lang")))
    return told.filter((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= min_score)).select(
        *[F.col("__lang").alias(c) if relabel and c == lang else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
