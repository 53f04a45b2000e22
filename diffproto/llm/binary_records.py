"""Token-ID / binary output: length-delimited binary records and an offset index.

A record is

    u64 payload length | u32 masked CRC of these 8 bytes |
    payload | u32 masked CRC of the payload | end byte 0x0A

all little-endian; the payload is i64 doc_id, u8 flags (1: the id is null,
2: a tag follows), u8 width of an id in bytes (2 where the vocabulary fits,
else 4), the tag if any (u16 length, UTF-8 bytes) and the ids.  The CRC is zlib's CRC-32, masked by a rotation and a constant, so that
a checksum of data holding checksums stays sound.

Documents are range-partitioned and sorted by id; each task encodes its rows
and writes its files, at most ``PER_FILE`` records and ``FILE_BYTES`` bytes
each, through Spark's writer, whose commit survives lost and repeated tasks on
any file system.
The index has a row per record: file, record, offset, length.  Files in the
order of the part number and the file counter in their names, as integers,
are in the order of the ids in them, so a document's global token offset is
its file's running total plus its place in the file.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .common import longs, read
from .pieces import ByteLevel, Pieces, joined

PER_FILE = 2048
END_ID = 0
FILE_BYTES = 8 << 20  # of a file; a longer record is a file of its own
HEAD = 64  # characters of a text that part the rows of one id
SALT = 256  # parts of rows whose ids and heads are equal
CACHE = 400_000  # pieces that a task remembers
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBB")
_CRC = struct.Struct("<I")
_TAG = struct.Struct("<H")
_END = 10


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its end byte."""
    n = struct.pack("<Q", len(payload))
    return n + _CRC.pack(masked_crc(n)) + payload + _CRC.pack(masked_crc(payload))


def records(content: bytes, check: bool = True) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length, payload) of a file's records; raises on a wrong checksum, length or end."""
    view, at = memoryview(content), 0
    while at < len(view):
        if len(view) - at < _HEAD.size:
            raise ValueError(f"record at {at}: cut off")
        n, crc = _HEAD.unpack_from(view, at)
        if crc != masked_crc(view[at: at + 8]):
            raise ValueError(f"record at {at}: wrong checksum of the length")
        body, end = at + _HEAD.size, at + _HEAD.size + n
        if end + _CRC.size + 1 > len(view) or view[end + _CRC.size] != _END:
            raise ValueError(f"record at {at}: cut off")
        payload = view[body:end]
        if check and _CRC.unpack_from(view, end)[0] != masked_crc(payload):
            raise ValueError(f"record at {at}: wrong checksum of the payload")
        yield at, end + _CRC.size + 1 - at, payload
        at = end + _CRC.size + 1


def pack(doc_id: int | None, width: int, ids: bytes, tag: str | None = None) -> bytes:
    t = b"" if tag is None else tag.encode("utf-8", "surrogatepass")
    if len(t) >= 1 << 16:
        raise ValueError(f"a tag of {len(t)} bytes")
    return _BODY.pack(0 if doc_id is None else doc_id, (doc_id is None) | (tag is not None) << 1, width) + (b"" if tag is None else _TAG.pack(len(t)) + t) + ids


def _head(payload: memoryview) -> tuple[int | None, int, int, str | None]:
    """(doc_id, width of an id, where the ids begin, tag) of a payload."""
    doc_id, flags, width = _BODY.unpack_from(payload)
    at, tag = _BODY.size, None
    if flags & 2:
        end = at + _TAG.size + _TAG.unpack_from(payload, at)[0]
        at, tag = end, bytes(payload[at + _TAG.size: end]).decode("utf-8", "surrogatepass")
    return (None if flags & 1 else doc_id), width, at, tag


def body(payload: memoryview) -> tuple[int | None, int, int]:
    """(doc_id, width of an id, number of ids) of a payload."""
    doc_id, width, at, _ = _head(payload)
    return doc_id, width, (len(payload) - at) // width


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as little-endian u32)."""
    doc_id, width, at, _ = _head(payload)
    return doc_id, np.frombuffer(payload[at:], dtype="<u2" if width == 2 else "<u4").astype("<u4")


def tag_of(payload: memoryview) -> str | None:
    return _head(payload)[3]


class Encoder:
    """A tokenizers file as text -> packed ids.

    A byte-level tokenizer merges nothing across the places where ``pieces``
    cuts, so the ids of a text are those of its pieces, and each distinct
    piece is encoded once and remembered.  Texts that hold a special token's
    string, and other kinds of tokenizers, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                         and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.type = "<u2" if self.width == 2 else "<u4"
        level = ByteLevel(self.tok)
        self.pieces = Pieces(lambda p: [level.learn(p)], [self.type], marks=True, most=CACHE)

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype=self.type).tobytes() for e in got]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if not self.by_piece:
            return self.whole(texts)
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.added)]
        plain = list(texts)
        for i in special:
            plain[i] = ""
        data, ends = joined([t.encode() for t in plain])
        out = [b""] * len(texts)
        if len(data):
            slots, begins = self.pieces.slots(data, ends)
            ids, n = self.pieces.gather(slots)
            per = np.add.reduceat(np.append(n, 0), np.append(np.searchsorted(begins, np.append(0, ends[:-1])), len(n)))[:-1]
            per[np.diff(ends, prepend=0) == 0] = 0
            at = (np.append(0, np.cumsum(per)) * self.width).tolist()
            packed = memoryview(ids.tobytes())
            out = [bytes(packed[a:b]) for a, b in zip(at, at[1:], strict=False)]
        for i, ids_ in zip(special, self.whole([texts[i] for i in special]), strict=True):
            out[i] = ids_
        return out


def runs(texts: list[str], most: int = 1024, chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of a bounded size; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most or size + len(t) > chars):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def write_records(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text: str = "text",
                  end_id: int = END_ID, per_file: int = PER_FILE, tag: str | None = None) -> tuple[str, str]:
    """Writes the records of ``docs`` and their index; returns both paths.

    Null text counts as empty and gives the end id alone.  Null ids come
    first.  Rows with equal ids follow each other by text, repeated rows all stay;
    however many rows share an id, they are dealt over the range partitions
    (by the first ``HEAD`` characters, and by chance where these are equal).  A file holds at most ``per_file``
    records and about ``FILE_BYTES`` bytes; a text of any length is one
    record.  An empty table gives no records.  The string in the column
    ``tag``, if one is named, is kept in a row's record; other columns are
    ignored."""
    spark = docs.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "records")
    tagged = tag is not None
    extra = [F.col(tag).cast("string").alias("tag")] if tagged else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra,
                       F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int").alias("part"))
    dealt = rows.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange("doc_id", "head", "part")
    order = ["doc_id", "text", *(["tag"] if tagged else [])]
    ordered = dealt.select(*order).sortWithinPartitions(*order)

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.type).tobytes()
        last = bytes([_END])
        held, size = [], 0
        # workers are used again, by other stages too: what they remember goes with the task
        enc.pieces.clear()
        for b in batches:
            ids, texts = b["doc_id"], list(b["text"])
            tags = [None if pd.isna(t) else t for t in b["tag"]] if tagged else [None] * len(texts)
            for a, z in runs(texts):
                for doc_id, packed, t in zip(ids[a:z], enc.batch(texts[a:z]), tags[a:z], strict=True):
                    record = frame(pack(None if pd.isna(doc_id) else int(doc_id), enc.width, packed + end, t))
                    if held and (len(held) >= per_file or size + len(record) > FILE_BYTES):
                        yield pd.DataFrame({"file": [last.join(held)]})
                        held, size = [], 0
                    held.append(record)
                    size += len(record) + 1
        enc.pieces.clear()
        if held:
            yield pd.DataFrame({"file": [last.join(held)]})

    # a row is a file: the text writer puts its bytes as they are, followed by the last record's end byte
    ordered.mapInPandas(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1).option("lineSep", chr(_END)).text(f"{path}/data")

    index_records(spark, path, tagged)
    return f"{path}/data", f"{path}/index"


def index_records(spark: SparkSession, path: str, tagged: bool = False) -> None:
    """Reads the files back, every checksum verified and every id decoded, and
    writes the index: file, record, doc_id, offset, length, n_tokens,
    ids_crc32 (unsigned CRC-32 of the ids as little-endian u32), before,
    the ids of earlier records of the file, and with ``tagged`` the tag."""
    ship_package(spark)
    schema = "file string, record long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long, before long"
    schema += ", tag string" if tagged else ""

    def scan(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                seen, got = 0, []
                for k, (offset, length, payload) in enumerate(records(content)):
                    doc_id, ids = unpack(payload)
                    row = (name, k, doc_id, offset, length, len(ids), zlib.crc32(ids.tobytes()), seen)
                    got.append((*row, tag_of(payload)) if tagged else row)
                    seen += len(ids)
                yield _frame(got, [c.split()[0] for c in schema.split(", ")])

    _files(spark, path).mapInPandas(scan, schema).write.parquet(f"{path}/index")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    cols = dict(zip(columns, zip(*rows, strict=True) if rows else [()] * len(columns), strict=True))
    return pd.DataFrame({c: longs(v) if c == "doc_id" else list(v) for c, v in cols.items()})


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(name.alias("path"), "content")


def _file_order(file: Column) -> list[Column]:
    """A task's part number and its file counter: Spark pads them to five and
    three digits, so from the 1001st file of a task on names do not sort."""
    return [F.regexp_extract(file, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(file, r"-c(\d+)(?:\.|$)", 1).cast("long")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, as read back for the index: doc_id, start (the
    number of ids in all documents before it), n_tokens, ids_crc32, where
    the record lies (file, record, offset, length), and the tag if there are tags."""
    index = spark.read.parquet(f"{path}/index")
    # one row per file, whatever number of documents it holds
    per = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy(*_file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    return index.join(base, "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "record", "offset", "length",
        *[c for c in index.columns if c == "tag"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    data, _ = write_records(docs, tokenizer or default_tokenizer())
    return read_records(spark, data.removesuffix("/data"))
