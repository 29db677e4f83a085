"""Substring dedup by words: remove each word covered by a window of `size` words whose words also start earlier.

First pass: each task hashes all windows of its texts and counts them in a Count-min sketch of ROWS rows. What it sends
is its part of the sketch, cut into ranges of CHUNK cells: the cells that it met, and those met more than once. Parts of
a range are merged; a cell counts as repeated if it was met twice in one part or in two parts. Counts are never too low,
so a window that has a cell below two in some row is a single one, and all repeated windows have none.

Second pass: only windows whose cells are all repeated go on. A task holds its own ones against each other and sends the
earliest of equals alone, with 96 bits of hash, document and place, so even a window that every document has comes but
once from each task. Buckets of hashes are solved exactly in sorted order: all of a group but its earliest occurrence
start later than another. Places that start later are gathered by parts of the documents and mark the words to remove.

The sketch's cells follow the corpus, two or more for each word (by its bytes), up to CELLS a row; so its merged bits,
ROWS * CELLS / 8 bytes at most (128 MB), are what is broadcast, at any size of corpus. Beyond that more single windows
pass the first pass and are told apart by the second, whose cost is linear; none is lost either way.

Words are maximal runs without blanks (space, U+0009 to U+000D). Nulls and blank texts have no words; texts of fewer words
than a window keep all. An order of documents is that of doc_id; rows without an id come last. Repeated rows (id and
text) are one document and get the same result; texts that share an id are different documents, in an order of their
hashes. Empty tables give empty results; columns but doc_id and text are never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 20
ROWS = 2
CHUNK = 1 << 20
#: Most cells of a row.
CELLS = 1 << 29
#: Windows that a task holds before it sends what it has.
HELD = 1 << 22
#: Bytes of texts that are hashed at one time.
PIECE = 1 << 20
#: Windows for each bucket of the second pass, about, if all went on.
BUCKET = 1 << 21
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
FOUND = "bucket int, part int, data binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _mix(h: np.ndarray, by: np.uint64 = _M[1]) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * by


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of `raw`, which is made in pieces that end at blanks."""
    out, n, at = [], len(raw), 0
    while at < n:
        end = min(at + PIECE, n)
        while end < n and not (stop := _BLANK[raw[end : end + PIECE]]).any():
            end = min(end + PIECE, n)
        if end < n:
            end += int(stop.argmax())
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    value = _mix((raw[start[0] :].astype(np.uint64) + np.uint64(1)) * _M[0] + place.astype(np.uint64) * _M[2])
    value = _mix(value, _M[3])
    value[blank[start[0] :]] = 0
    return _mix(np.add.reduceat(value, start - start[0]) + (stop - start).astype(np.uint64) * _M[0])


def window_hashes(words: np.ndarray, size: int, by: np.uint64 = _M[2]) -> np.ndarray:
    """A hash of each `size` adjacent words, joined from those of powers of two."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, width, done, told = words, 1, 0, None
    while True:
        if size & width:
            part = power[done : done + n]
            told = part if told is None else _mix(_mix(told, _M[3]) * by + part)
            done += width
        if done == size:
            return _mix(_mix(told, _M[3]), by)
        power = _mix(power[:-width]) * by + power[width:]
        width *= 2


def hashed(texts: Iterable[bytes | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, hashes of its words) for texts that have a window."""
    for k, text in enumerate(texts):
        if text is not None and len(text) >= 2 * size - 1 and len(words := word_hashes(np.frombuffer(text, np.uint8))) >= size:
            yield k, words


def _cell(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.uint32)


def packed(places: np.ndarray) -> bytes:
    """Sorted places in a chunk: the width of the steps, then the steps, compressed."""
    steps = np.diff(places, prepend=places[:1] * 0)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if not len(steps) or int(steps.max()) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + pa.compress(steps.astype(kind).tobytes(), "zstd", asbytes=True) + len(places).to_bytes(4, "little")


def unpacked(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]]
    n = int.from_bytes(data[-4:], "little")
    steps = pa.decompress(data[1:-4], decompressed_size=n * data[0], codec="zstd", asbytes=True) if n else b""
    return np.cumsum(np.frombuffer(steps, kind).astype(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _rows_of(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


def sketch_parts(size: int, cells: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns texts into a task's parts of the sketch: chunk, cells met, cells met twice or more."""

    def parts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held) if held else np.zeros(0, np.uint64)
        for row in range(ROWS if len(h) else 0):
            met = np.sort(_cell(h, row, cells))
            new = np.concatenate(([True], met[1:] != met[:-1]))
            one = met[new]
            many = one[np.diff(np.append(np.flatnonzero(new), len(met))) > 1]
            ends = np.arange(0, cells + 1, min(CHUNK, cells), dtype=np.int64)
            a, b = np.searchsorted(one, ends), np.searchsorted(many, ends)
            told = [(row * (len(ends) - 1) + k, packed(one[a[k] : a[k + 1]] - np.uint32(ends[k])), packed(many[b[k] : b[k + 1]] - np.uint32(ends[k]))) for k in range(len(ends) - 1) if a[k] < a[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told), (pa.int32(), pa.binary(), pa.binary()))], ["chunk", "met", "again"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in _rows_of(batches):
            for _, words in hashed(_texts(batch), size):
                held.append(window_hashes(words, size))
                n += len(held[-1])
                if n >= HELD:
                    yield from parts(held)
                    held, n = [], 0
        yield from parts(held)

    return run


def merged(cells: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns parts of whole chunks into bits of the cells that are repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, counts = min(CHUNK, cells), {}
        for batch in _rows_of(batches):
            for chunk, met, again in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk not in counts:
                    counts[chunk] = (np.zeros(width, bool), np.zeros(width, bool))
                once, twice = counts[chunk]
                at = unpacked(met)
                twice[at[once[at]]] = True
                once[at] = True
                twice[unpacked(again)] = True
        for chunk, (_, twice) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    return run


def sketch(texts: DataFrame, size: int, cells: int) -> np.ndarray:
    """Bits of the repeated cells, a row of cells / 8 bytes for each row of the sketch."""
    chunks = ROWS * max(1, cells // CHUNK)
    n = min(chunks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = texts.select("text").mapInArrow(sketch_parts(size, cells), "chunk int, met binary, again binary")
    told = parts.repartitionById(n, F.col("chunk") % n).mapInArrow(merged(cells), "chunk int, bits binary")
    bits = np.zeros((chunks, min(CHUNK, cells) // 8), np.uint8)
    for row in told.toLocalIterator():  # ROWS * cells / 8 bytes in all, a partition's at a time
        bits[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(ROWS, cells // 8)


_held: dict[str, np.ndarray] = {}


def _held_bits(name: str, data: Callable[[], bytes], cells: int) -> np.ndarray:
    """The sketch of this name; a Python worker holds the last one asked for alone."""
    if name not in _held:
        _held.clear()
        told = pa.decompress(data(), decompressed_size=ROWS * cells // 8, codec="zstd")
        _held[name] = np.frombuffer(told, np.uint8).reshape(ROWS, cells // 8)
    return _held[name]


def estimated(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which windows have no cell below two."""
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        c = _cell(h, row, 8 * bits.shape[1])
        out &= (bits[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0
    return out


def _named(ids: np.ndarray, marks: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted places in documents: the documents once, then to which each place belongs, and the places; compressed."""
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))
    told = np.concatenate((ids[new].view(np.uint8), marks[new].view(np.uint8), new.astype(np.uint8), places.astype("<u4").view(np.uint8)))
    return np.array([len(ids), int(new.sum())], "<u4").tobytes() + pa.compress(told.tobytes(), "zstd", asbytes=True)


def _unnamed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, docs = (int(x) for x in np.frombuffer(data, "<u4", 2))
    told = np.frombuffer(pa.decompress(data[8:], decompressed_size=16 * docs + 5 * n, codec="zstd", asbytes=True), np.uint8)
    who = np.cumsum(told[16 * docs : 16 * docs + n].astype(np.int64)) - 1
    return told[: 8 * docs].view(np.int64)[who], told[8 * docs : 16 * docs].view(np.int64)[who], told[16 * docs + n :].copy().view("<u4").astype(np.int64)


def part_of(ids: np.ndarray, marks: np.ndarray, parts: int) -> np.ndarray:
    """In which part of the documents each one is; copies of a text are in many."""
    return np.mod(ids ^ marks, parts)


def _by_part(ids: np.ndarray, marks: np.ndarray, places: np.ndarray, parts: int, buckets: int) -> pa.RecordBatch:
    """A row for each part of the documents, with the places that start later."""
    part = part_of(ids, marks, parts)
    order = np.lexsort((places, marks, ids, part))
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    told = [{"bucket": k % buckets, "part": k, "data": _named(*(x[order[a:b]] for x in (ids, marks, places)))} for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]
    return pa.RecordBatch.from_pylist(told, _FIELDS)


def _later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, marks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest occurrence of each window, and of those that start later than it."""
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    often = np.concatenate((same, [False])) | np.concatenate(([False], same))
    alone, some = order[~often], order[often]
    some = some[np.lexsort((places[some], marks[some], ids[some], h2[some], h1[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (h1[some][1:] != h1[some][:-1]) | (h2[some][1:] != h2[some][:-1])
    first = some[new][np.cumsum(new) - 1]
    later = (ids[some] != ids[first]) | (marks[some] != marks[first]) | (places[some] != places[first])  # a repeated row isn't later than itself
    return np.concatenate((alone, some[new])), some[later]




def _blob(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, marks: np.ndarray, places: np.ndarray) -> bytes:
    """A bucket's occurrences: 96 bits of hash, document and place of each."""
    order = np.lexsort((places, marks, ids))
    return len(h1).to_bytes(4, "little") + h2[order].astype("<u4").tobytes() + h1[order].tobytes() + _named(ids[order], marks[order], places[order])


def _unblob(data: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<u8", n, 4 + 4 * n), np.frombuffer(data, "<u4", n, 4), *_unnamed(data[4 + 12 * n :])


def candidates(size: int, bits: Callable[[], np.ndarray], buckets: int, parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns documents into blobs of their windows that may be repeated, earliest of each task, by bucket (part null); and the places known to start later, by part."""

    def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h1, h2, ids, marks, places = (np.concatenate(x) for x in zip(*held))
        first, later = _later(h1, h2, ids, marks, places)
        yield _by_part(ids[later], marks[later], places[later], parts, buckets)
        bucket = (_mix(h1[first], _M[0]) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        for k in range(buckets):
            if len(own := first[order[ends[k] : ends[k + 1]]]):
                yield pa.RecordBatch.from_pylist([{"bucket": k, "part": None, "data": _blob(*(x[own] for x in (h1, h2, ids, marks, places)))}], _FIELDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = bits(), [], 0
        for batch in _rows_of(batches):
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            for k, words in hashed(_texts(batch), size):
                h1 = window_hashes(words, size)
                if len(at := np.flatnonzero(estimated(h1, table))):
                    h2 = window_hashes(words, size, _M[0])[at] >> np.uint64(32)
                    held.append((h1[at], h2.astype(np.uint32), np.full(len(at), ids[k]), np.full(len(at), marks[k]), at))
                    n += len(at)
                if n >= HELD:
                    yield from told(held)
                    held, n = [], 0
        yield from told(held)

    return run


def solved(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns whole buckets into places that start later, by part of the documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in _rows_of(batches, 1024):
            known = batch.column("part").is_valid()
            yield batch.filter(known)
            blobs += [_unblob(data) for data in batch.filter(pa.compute.invert(known)).column("data").to_pylist()]
        if blobs:
            columns = [np.concatenate(x) for x in zip(*blobs)]
            del blobs
            _, later = _later(*columns)
            yield _by_part(*(x[later] for x in columns[2:]), parts, 1)

    return run


def _removed(n: int, size: int, places: np.ndarray) -> np.ndarray:
    marks = np.bincount(places, minlength=n + 1)[: n + 1] - np.bincount(places + size, minlength=n + 1)[: n + 1]
    return np.cumsum(marks)[:n] > 0


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(docs: pa.Table, later: pa.Table, size: int) -> pa.Table:
    """A part's documents without the words of windows that start later."""
    told = [np.concatenate(x) for x in zip(*map(_unnamed, later.column("data").to_pylist()))] if later.num_rows else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((told[1], told[0]))
    ids, marks, places = (x[order] for x in told)
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))) if len(ids) else np.zeros(0, np.int64)
    of = {(ids[a], marks[a]): (a, b) for a, b in zip(new.tolist(), np.append(new[1:], len(ids)).tolist())}
    out = []
    for batch in _rows_of(docs.to_batches()):
        rows = []
        for text, key in zip(_texts(batch), zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist())):
            words = kept = (text or b"").split()  # bytes know these six blanks only
            if key in of:
                gone = _removed(len(words), size, places[slice(*of[key])])
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, f.type) for x, f in zip(zip(*rows), list(OUT)[1:])]], schema=OUT))
    return pa.Table.from_batches(out, OUT)


def remove(docs: DataFrame, size: int = SIZE, most_cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of `docs`."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    there = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cells = 1 << min(max(16, (there // 3 - 1).bit_length() if there > 3 else 0), most_cells.bit_length() - 1)
    shared = spark.sparkContext.broadcast(pa.compress(sketch(rows, size, cells), "zstd", asbytes=True))

    name = uuid.uuid4().hex

    def bits() -> np.ndarray:
        return _held_bits(name, lambda: shared.value, cells)

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), there // 6 // BUCKET)
    parts = 4 * buckets + 1
    keyed = rows.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("mark"), "doc_id", "text")
    sent = keyed.select("id", "mark", "text").mapInArrow(candidates(size, bits, buckets, parts), FOUND)
    later = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(solved(parts), FOUND).select("part", "data")
    dealt = keyed.withColumn("part", F.pmod(F.col("id").bitwiseXOR(F.col("mark")), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(lambda docs, places: _kept(docs, places, size), "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs, size).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
