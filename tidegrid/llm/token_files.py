"""Token-id output: Parquet files of token lists with chosen encoding, row groups and pages, and selective reads.

Documents are dealt by ranges of doc_id, so that the files in order hold the documents in order. Each row has the
document's ids, its end id included, their number, the file part it lies in and the ids before it in that part; the
ids before a part are a sum over the parts' totals. A reader of lengths and places alone never touches the column of
ids, and a reader of a few documents skips row groups and pages by the statistics of doc_id.

Nulls count as empty texts and get the end id alone. Repeated rows are written as often as they occur; rows of one id
are in the order of their texts. Rows without doc_id come first. An empty table gives files without rows; columns but
doc_id and text are never looked at.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Memo, file_of, once, shared_dir

SCHEMA = "doc_id long, part int, before long, n_tokens int, tokens array<int>"
#: Memoised pieces of text in each of two generations, in each Python worker.
MEMO_PARTS = 600_000
#: White space as the pre-tokeniser sees it, and a part: white space and what follows it up to the next.
SPACE = r"[^\S\x1c-\x1f]"
PARTS = re.compile(rf"{SPACE}*(?:\S|[\x1c-\x1f])+|{SPACE}+")
#: White space other than blanks and line ends, and what the split below marks line ends with.
RARE = ("\0", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
RUNS = ("  ", "\n\n", " \n", "\n ")
#: The commonest shape of a part: a word of Latin letters, perhaps with a blank or line end before and signs after it.
SHAPE = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([^\w\s']*)")


class ByteBpe:
    """Ids of a byte-level tokenizer file. A token never reaches from a character into white space after it, so parts are memoised.

    Words of a part of the usual shape go straight to the file's model, which spares the library its bookkeeping of
    places; all other parts take the library's whole way.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self._encode, MEMO_PARTS)
        self.signs = Memo(self._whole, 10_000)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.blank = self.letters[32]

    def _whole(self, part: str) -> bytes:
        return array("i", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        shown = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = self.tokenizer.model.tokenize(shown)
        return array("i", [x.id for x in found]).tobytes()

    def _encode(self, key: str) -> bytes:
        part = key[1:] if key[:1] == "\0" else " " + key
        m = SHAPE.fullmatch(part)
        if m is None:
            return self._whole(part)
        line, word, signs = m.groups()
        if not line and not signs:
            return self._word(word)
        own = self.memo[word[1:] if word[0] == " " else "\0" + word]
        return (self.signs[line] if line else b"") + own + (self.signs[signs] if signs else b"")

    def keys(self, text: str) -> list[str]:
        """The text's parts: without the blank that they begin with, or else after a zero byte."""
        if any(map(text.__contains__, RARE)) or any(map(text.__contains__, RUNS)):
            return [x[1:] if x[0] == " " and x[1:2] != "\0" else "\0" + x for x in PARTS.findall(text)]
        s = text.replace("\n", " \0\n").split(" ")
        if text[0] == "\n":
            return s[1:]
        s[0] = "\0" + s[0]
        return s if text[0] != " " else s[1:]

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers in the machine's order."""
        return b"".join(map(self.memo.__getitem__, self.keys(text))) if text else b""


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "delta", row_group_mb: int = 32, page_rows: int = 1000) -> None:
    """Encode `docs` (doc_id, text) and write files of SCHEMA below `path`.

    encoding: "delta" (bit-packed differences) or "dictionary" (ids by their place in a dictionary, the usual choice
    where few different ids occur in a row group). page_rows: rows of a page, which the page index describes.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding!r}")
    file_of(tokenizer)
    tail = array("i", [end_id]).tobytes()

    def run(batches):
        it = once(("byte_bpe", tokenizer), lambda: ByteBpe(tokenizer))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(k, ROWS_AT_ONCE)
                ids = [it.encode(s or "") + tail for s in rows.column(1).to_pylist()]
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(before + ends - counts), pa.array(counts, pa.int32()), tokens], ["doc_id", "part", "before", "n_tokens", "tokens"])
                before += int(ends[-1])

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SCHEMA).write.options(**{
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows), "compression": "snappy",
    }).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, without reading ids. One row for each file part meets in one task."""
    rows = read(spark, path).select("doc_id", "part", "before", "n_tokens")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").cast("long").alias("ids"), F.min("doc_id").alias("first"))
    so_far = F.sum("ids").over(Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(parts.select("part", F.coalesce(so_far, F.lit(0)).alias("base")), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"))


def digests(docs: DataFrame, tokenizer: str, end_id: int, **layout) -> DataFrame:
    """Write the files into the shared folder and return doc_id, start, n_tokens, ids_crc32, as read from them."""
    import uuid
    import zlib

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/stages/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, **layout)

    def run(batches):
        for batch in batches:
            tokens = batch.column(3)
            flat, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].astype("<u4", copy=False)) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([b - a for a, b in zip(at[:-1], at[1:])], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    rows = read(spark, path)
    found = rows.select("doc_id", "part", "before", "tokens").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").cast("long").alias("ids"), F.min("doc_id").alias("first"))
    so_far = F.sum("ids").over(Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(so_far, F.lit(0)).alias("base"))
    return found.join(parts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
