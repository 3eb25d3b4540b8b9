"""Token ids in files of length-delimited binary records, with a separate offset index.

A record of a file is

====================  ===============================================================
8 bytes               length n of the payload, unsigned, little-endian
4 bytes               masked CRC-32 of those 8 bytes
n bytes               payload: id (signed 64 bits), 1 if the id is null (8 bits), bytes a token (8 bits: 2 or 4),
                      then the tokens, unsigned, little-endian
4 bytes               masked CRC-32 of the payload
1 byte                end mark, a line feed
====================  ===============================================================

A checksum c is masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2^32, so that checksums of data that hold checksums
stay useful. Files are written by Spark's own text writer (a record is a "line" of bytes, the end mark its separator)
and read by Spark's binary file reader. So they can be in any store that Spark reaches, and a lost task is written
again under the usual commit protocol. Part files in the order of their numbers have the records in ascending id order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.arrowmap import map_texts
from fathomline.llm.common import fresh_path, located, shuffle_partitions, written

_HEAD, _SUM, _ABOUT = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
#: Bytes of text that make one file at most, on average; a file is read back as one value.
FILE_BYTES = 16 << 20
#: Files whose starts may be broadcast, at about 60 bytes each, and files whose tokens are summed up in one task.
FILES, FILES_A_TASK = 50_000, 10_000


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record without its end mark."""
    payload = _ABOUT.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def read_frame(file: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(id, tokens, offset of the next record) of the record at an offset; ValueError if it is damaged."""
    head = bytes(file[at : at + 8])
    if len(head) < 8 or _SUM.unpack_from(file, at + 8)[0] != masked(head):
        raise ValueError(f"damaged length at byte {at}")
    n = _HEAD.unpack(head)[0]
    payload = bytes(file[at + 12 : at + 12 + n])
    if len(payload) < n or _SUM.unpack_from(file, at + 12 + n)[0] != masked(payload) or file[at + 16 + n] != 10:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, null, width = _ABOUT.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_ABOUT.size), at + 17 + n


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: b if b in own else 256 + others.index(b) for b in range(256)}


class Encoder:
    """Ids of whole texts from a tokenizer file, with a cache of bounded size over the words that texts are cut into.

    Tokenizers that normalise by NFC, one blank for white space and lower case, and cut words by letters, single
    digits and other signs, are given the words one by one; texts with anything but ASCII and Latin-1 letters are cut
    at blanks alone. Other tokenizers get the whole texts.
    """

    _WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    _OTHER = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")

    def __init__(self, path: str, cached: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (about["normalizer"] or {}).get("normalizers", [])]
        cut = (about["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.by_words = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in cut] == ["Split", "ByteLevel"]
            and cut[0]["pattern"] == {"Regex": words}
            and about["model"]["type"] == "BPE"
            and not about["model"].get("ignore_merges")
        )
        self.special = [x["content"] for x in about["added_tokens"]]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.cached, self.cache = cached, {}

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        plain = self._OTHER.search(text) is None and not any(x in text for x in self.special)
        parts = self._WORD.findall(text.lower()) if plain else text.replace("\n", " ").split(" ")
        cache, out = self.cache if plain else {}, []
        for p in parts:
            ids = cache.get(p)
            if ids is None:
                if plain:
                    ids = [x.id for x in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
                else:
                    ids = self.tokenizer.encode(p, add_special_tokens=False).ids
                ids = array(self.type, ids).tobytes()
                if len(cache) >= self.cached:
                    cache.clear()
                if len(p) <= 48:
                    cache[p] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), self.kind)

    @property
    def type(self) -> str:
        return "H" if self.width == 2 else "I"


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(located(path))
    return _LOADED[path]


def write(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, files: int | None = None) -> None:
    """Encode every text of ``df`` and write the records below ``path`` in ascending id order.

    A null text counts as empty; its record holds the end id alone. Null ids come first. Repeated ids give a record
    each, in the order of their texts' hashes, and may lie in several files. An empty table gives no records.
    ``tokenizer`` is a file's path, which must be readable on every executor, or the name of a public tokenizer.
    """
    if files is None:
        files = max(shuffle_partitions(df.sparkSession), (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // FILE_BYTES + 1)
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).withColumn("h", F.xxhash64("text"))
    # The row's place in the input cuts an id that very many rows share; it is the same in a task that runs again.
    order = [F.col("id").asc_nulls_first(), F.col("h").asc(), F.col("at").asc()]
    rows = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batch):
        e = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        out = [frame(i, np.concatenate((e.encode(t or ""), end)), e.width) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # The cast keeps the bytes as they are.
    map_texts(rows, run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


def read(spark, path: str) -> DataFrame:
    """The records below ``path``, all checksums verified: ``file``, ``record`` (number in the file), ``offset``,
    ``length`` (of the payload), ``doc_id``, ``n_tokens``, ``ids_crc32`` (of the tokens as unsigned 32-bit integers)
    and ``before`` (tokens of the file's earlier records)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = "file string, record long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                file, out = memoryview(content.as_buffer()), []
                at = before = n = 0
                while at < len(file):
                    doc_id, ids, then = read_frame(file, at)
                    out.append((name.as_py(), n, at, then - at - 17, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    at, before, n = then, before + len(ids), n + 1
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.string()) for k, c in enumerate(zip(*out[i : i + 10_000]))], names).cast(pa.schema([(x, pa.string() if x == "file" else pa.int64()) for x in names]))

    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def _starts(totals: DataFrame) -> DataFrame:
    """(file, base) for each row (file, n) of ``totals``: the tokens of all files of a smaller number.

    Sums are made in stretches of FILES_A_TASK files, and over the stretches' sums.
    """
    numbered = totals.withColumn("number", F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"))
    numbered = numbered.withColumn("stretch", F.floor(F.col("number") / FILES_A_TASK))
    sums = numbered.groupBy("stretch").agg(F.sum("n").alias("all"))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stretch", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("stretch").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    known = numbered.select("file", "stretch", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    return known.join(sums, "stretch").select("file", (F.col("before") + F.col("inside")).alias("base"))


def index(spark, path: str) -> DataFrame:
    """The offset index of the files below ``path``: ``read``'s rows with ``start``, the tokens of all records before.

    It is written beside the files, as the table ``_index``. Files count in the order of their numbers.
    """
    rows = read(spark, path)
    rows.write.parquet(f"{path}/_index")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/_index")
    known = written(_starts(rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))), "record-starts")
    known = F.broadcast(known) if known.count() <= FILES else known
    return rows.join(known, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def fetch(path: str, places: list[tuple[str, int]], opener=open) -> list[tuple[int | None, np.ndarray]]:
    """Records by (file, offset) from the index, in the order asked for: the shuffled read of a training job."""
    out = []
    for file, at in places:
        with opener(f"{path}/{file}", "rb") as f:
            f.seek(at)
            n = _HEAD.unpack(f.read(8))[0]
            f.seek(at)
            out.append(read_frame(f.read(n + 17), 0)[:2])
    return out


def encoded_index(df: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """``write`` and then ``index``; without a path, below the shared folder."""
    path = path or fresh_path(df.sparkSession, "records")
    write(df, tokenizer, path, **options)
    return index(df.sparkSession, path)
