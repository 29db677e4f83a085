"""Suffix-array dedup: remove each byte covered by a string of `length` bytes that also starts anywhere else.

Two equal strings of that length have the same least `GRAM`-byte gram at the same place in them (by a hash; ties: the
last), so all starts of equal strings share an anchor, and a document's starts fall into runs of starts with one
anchor. A run's segment is the text from its first start to the end of its last string. Only segments of an anchor met
twice can hold repeats; equal segments are one row with a count, so copies cost nothing more.

Those segments are dealt by anchor, and in each task their starts are put into classes of equal strings by
bucket-pointer refinement: starts are first in buckets of their distance from the anchor and their first q bytes; a
bucket is refined by sorting its members on the buckets of the starts that follow them by the depth reached, and since
these have been refined as deep by then, the depth doubles with every round (the last round takes the offset that ends
at `length`). A bucket's number is its first member's place in the order reached, so members stay in order and only
buckets are sorted inside; buckets of one member, and places whose string would leave their segment, need no more
rounds. A class that holds two starts or more, counted with the segments' counts, is a repeat. An anchor whose segments
are all equal needs no rounds: all its starts are repeats.

An anchor with more than HOT different segments isn't gathered in one task. Its bucket is refined first by what all
strings have in common whose starts lie in the same WIDTHS[0] places before the anchor: equal strings lie at the same
distance from it, so such a piece of a segment gets a new anchor, the hash of the bytes that all these strings share
(all but some at both ends). Pieces are handled as segments are, equal ones as one row with a count; near copies differ
in few of them. A piece's anchor that is still over HOT is refined again by the next width, at last by single starts,
whose shared bytes are the whole string.

Passages shorter than `length` bytes can be told apart (`passages`): of each `words` adjacent words the piece of PIECE_WORDS
with the least hash is chosen, so two documents with the same `words` words have a piece in common, and a document
without PIECE_WORDS words of another one has none (hashes of 64 bits).

Nulls count as empty texts; rows without doc_id stay whole and make nothing a repeat. Texts shorter than `length` have
no starts. Copies of a document remove each other wholly (from `length` bytes on), and so do repeated rows; where an id
is repeated with other texts, each text is treated by itself. Empty tables give empty results; columns but doc_id and
text are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, map_batches, stage

GRAM = 32
#: Different segments of an anchor from which its starts are counted as rows.
HOT = 1024
#: Starts that a piece of a hot anchor's segment may have, at each refinement; the last must be 1.
WIDTHS = (32, 4, 1)
#: Words of a piece, a power of two.
PIECE_WORDS = 32
#: Bytes that are hashed at one time, of long texts.
PIECE = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_PLACE_BITS = 21
RUNS = "doc_id long, mark long, anchor long, seg_a long, seg_b long, first int, starts int, back int"
PIECES = RUNS + ", n long"


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams, joined from those of half their size."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    size = 1
    while size < GRAM:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * _MIX[1] + h[size:] * _MIX[2]
        size *= 2
    return (h ^ (h >> np.uint64(32))) * _MIX[0]


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` adjacent keys, from running minima inside blocks of that width."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(raw: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(anchor hash, first start, number of starts, anchor's place) of each run; hashes as signed 64-bit integers."""
    n = len(raw)
    out: list[tuple[int, int, int, int]] = []
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for base in range(0, max(0, n - length + 1), PIECE):
        part = raw[base : base + PIECE + length - 1]
        h = grams(part)
        places = np.arange(len(h), dtype=np.uint64)
        m = least((h & ~low) | (low - places), length - GRAM + 1)
        at = (low - (m & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sizes = np.diff(np.append(first, len(at)))
        out += zip(h[at[first]].view(np.int64).tolist(), (first + base).tolist(), sizes.tolist(), (at[first] + base).tolist())
    return out


def refine(text: np.ndarray, starts: np.ndarray, length: int, column: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
    """A class number for each of `starts`: equal where the `length` bytes from there are equal, and the columns.

    column: of each place, under 2**31; by default all have one. left: bytes from each place on that its strings may have,
    by default all that follow. All strings of `starts` must fit.
    """
    n, depth = len(text), min(4, length)
    left = np.arange(n, 0, -1) if left is None else left
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    key = np.zeros(n, np.int64) if column is None else column.astype(np.int64)
    for k in range(depth):
        key = (key << np.int64(8)) | padded[k : n + k].astype(np.int64)
    bucket, active = np.zeros(n, np.int64), np.flatnonzero(left >= depth)
    key, old = key[active], np.zeros(len(active), np.int64)
    while len(active):
        order = np.argsort(key, kind="stable")  # members are in the order of their buckets: sorted nearly in one pass
        active, key = active[order], key[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(heads, len(key)))
        lead = np.concatenate(([True], old[heads[1:]] != old[heads[:-1]]))
        number = old[heads] + heads - heads[np.maximum.accumulate(np.where(lead, np.arange(len(heads)), 0))]
        told = np.repeat(number, sizes)
        bucket[active] = told
        if depth == length:
            break
        step = min(depth, length - depth)
        keep = np.repeat(sizes > 1, sizes) & (left[active] >= depth + step)
        active, old = active[keep], told[keep]
        key = old * np.int64(n + 1) + bucket[active + step]
        depth += step
    return bucket[starts]


def _ranges(marks: np.ndarray) -> list[dict]:
    """Maximal runs of true marks as from, upto."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _keys(part: memoryview | bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(part)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _table(columns: list[list[int]], schema: str) -> pa.RecordBatch:
    told = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.int32()) for c, (_, kind) in zip(columns, told)], [name for name, _ in told])


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list[int]] = [[] for _ in range(8)]
            for doc_id, mark, raw in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(raw or b"")
                for anchor, first, starts, at in runs(np.frombuffer(view, np.uint8), length) if len(view) >= length else ():
                    for c, v in zip(columns, (doc_id, mark, anchor, *_keys(view[first : first + starts - 1 + length]), first, starts, at - first)):
                        c.append(v)
            return _table(columns, RUNS)

        return work

    return map_batches(texts_of(docs).filter("doc_id is not null"), make, RUNS)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark (tells texts of one id apart), raw."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("raw"))


def pieces(segment: bytes, anchor: int, length: int, width: int) -> list[tuple[int, int, int]]:
    """(new anchor, first start, number of starts) of each part of a segment whose starts lie in the same `width` places before the anchor."""
    ((_, _, starts, at),) = runs(np.frombuffer(segment, np.uint8), length)
    view, out, lo = memoryview(segment), [], 0
    while lo < starts:
        near = (at - lo) // width * width  # the least distance from the anchor in this part
        shared = view[at - near : at - near - width + 1 + length]
        x = xxhash.xxh3_64_intdigest(shared, (anchor + near) & (1 << 64) - 1)
        hi = min(starts, at - near + 1)
        out.append((x - (1 << 63), lo, hi - lo))
        lo = hi
    return out


CUT = "anchor long, seg_a long, seg_b long, n long, hot boolean, segment binary, starts int, back int"
#: Segments that are refined at one time, about: what their places need stays in a core's cache.
SEGMENTS = 200


def _repeats(found: DataFrame, texts: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """seg_a, seg_b, ranges: for each different segment with repeats where its repeated starts lie (lo, hi: from, up to).

    found: staged; RUNS and n, how often the run occurs. texts: doc_id, mark, raw.
    """
    at = F.min(F.struct("doc_id", "mark", "first", "starts", "back")).alias("at")
    segments = found.groupBy("anchor", "seg_a", "seg_b").agg(F.sum("n").alias("n"), at)
    anchors = segments.groupBy("anchor").agg(F.sum("n").alias("met"), F.count("*").alias("kinds")).filter("met > 1")
    wanted = segments.join(anchors.select("anchor", (F.col("kinds") > HOT).alias("hot"), (F.col("kinds") == 1).alias("alone")), "anchor")
    wanted = stage(wanted.select("anchor", "seg_a", "seg_b", "n", "hot", "alone", "at.doc_id", "at.mark", "at.first", "at.starts", "at.back"), "segments")
    any_hot = not wanted.filter("hot").isEmpty()
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("starts").alias("hi"))).alias("ranges")
    alone = wanted.filter("alone").select("seg_a", "seg_b", whole)
    asked = wanted.filter("not alone").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "seg_a", "seg_b", "n", "hot", "first", "starts", "back")).alias("asked"))  # bounded by the document's own length

    def cut(batches):
        for rows in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            out: dict[str, list] = {x.split()[0]: [] for x in CUT.split(", ")}
            for raw, asked_ in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for x in asked_:
                    for c in ("anchor", "seg_a", "seg_b", "n", "hot", "starts", "back"):
                        out[c].append(x[c])
                    out["segment"].append(raw[x["first"] : x["first"] + x["starts"] - 1 + length])
            kinds = (*(pa.int64(),) * 4, pa.bool_(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    segs = texts.join(asked, ["doc_id", "mark"]).select("raw", "asked").mapInArrow(cut, CUT)
    segs = stage(segs, "hot-and-other", compression="zstd") if any_hot else segs

    def classes(batches):
        for t in grouped(batches, "anchor", SEGMENTS):
            seg = t.column("segment").to_pylist()
            starts = t.column("starts").to_numpy()
            counts = t.column("n").to_numpy()
            text = np.frombuffer(b"".join(seg), np.uint8)
            anchor = t.column("anchor").to_numpy()
            size = starts.astype(np.int64) - 1 + length
            base = np.cumsum(size) - size
            group = np.cumsum(np.concatenate(([False], anchor[1:] != anchor[:-1])))
            place = np.arange(len(text))
            column = place + np.repeat((2 * group + 1) * length - t.column("back").to_numpy() - base, size)
            own = np.repeat(np.arange(len(seg)), starts)
            within = np.arange(len(own)) - np.repeat(np.cumsum(starts) - starts, starts)
            kind = refine(text, base[own] + within, length, column, np.repeat(base + size, size) - place)
            marks = np.bincount(kind, weights=counts[own])[kind] > 1.5
            ends = np.cumsum(starts)
            ranges = [_ranges(marks[b - s : b]) for b, s in zip(ends, starts)]
            keep = [k for k, r in enumerate(ranges) if r]
            told = pa.array([ranges[k] for k in keep], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[keep]) for c in ("seg_a", "seg_b")] + [told], ["seg_a", "seg_b", "ranges"])

    cool = segs.filter("not hot").select("anchor", "n", "seg_a", "seg_b", "starts", "back", "segment").repartition("anchor").sortWithinPartitions("anchor")
    cool = cool.mapInArrow(classes, "seg_a long, seg_b long, ranges array<struct<lo:int,hi:int>>")
    cool = cool.unionByName(alone)
    if not any_hot:
        return cool
    width, *rest = widths

    def split(batches):
        for rows in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            columns: list[list[int]] = [[] for _ in range(9)]
            for a, b, anchor, n, back, segment in zip(*(c.to_pylist() for c in rows.columns)):
                for told, lo, starts in pieces(segment, anchor, length, width):
                    key = _keys(memoryview(segment)[lo : lo + starts - 1 + length])
                    for c, v in zip(columns, (a, b, told, *key, lo, starts, back - lo, n)):
                        c.append(v)
            yield _table(columns, PIECES)

    hot = segs.filter("hot")
    parts = stage(hot.select("seg_a", "seg_b", "anchor", "n", "back", "segment").mapInArrow(split, PIECES), "pieces")
    inner = _repeats(parts, hot.select(F.col("seg_a").alias("doc_id"), F.col("seg_b").alias("mark"), F.col("segment").alias("raw")), length, tuple(rest))
    moved = F.transform("ranges", lambda r: F.struct((r["lo"] + F.col("first")).alias("lo"), (r["hi"] + F.col("first")).alias("hi")))
    back = parts.join(inner, ["seg_a", "seg_b"]).select("doc_id", "mark", moved.alias("ranges")).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return cool.unionByName(back.select(F.col("doc_id").alias("seg_a"), F.col("mark").alias("seg_b"), "ranges"))


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, first, ranges: for each run with repeats where its repeated starts lie, counted from `first` (lo, hi: from, up to)."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    found = stage(find_runs(docs, length), "runs")
    ranges = _repeats(found.withColumn("n", F.lit(1).cast("long")), texts_of(docs), length, WIDTHS)
    return found.join(ranges, ["seg_a", "seg_b"]).select("doc_id", "mark", "first", "ranges")


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_POWERS = np.cumprod(np.full(4096, _MIX[1]))


def word_pieces(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces chosen of each `words` adjacent words, and the texts that they are of."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(first) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), first, "right")
    inside = np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    value = (raw[first[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[inside % 4096]
    value[space[first[0] :]] = 0
    h = np.add.reduceat(value, first - first[0])
    h, size = (h ^ (h >> np.uint64(32))) * _MIX[0], 1
    while size < PIECE_WORDS:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * _MIX[1] + h[size:] * _MIX[2]
        size *= 2
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    whole = of[: len(first) - words + 1] == of[words - 1 :]
    told, of = least(h, words - PIECE_WORDS + 1)[whole], of[: len(whole)][whole]
    fresh = np.flatnonzero(np.concatenate(([True], (told[1:] != told[:-1]) | (of[1:] != of[:-1])))[: len(told)])
    return told[fresh].view(np.int64), of[fresh]


def passages(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, passages: how many chosen pieces other documents have, too; only rows that have one."""
    if words < PIECE_WORDS:
        raise ValueError(f"words must be at least {PIECE_WORDS}")

    def run(batches):
        for rows in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            piece, of = word_pieces([x or b"" for x in rows.column(2).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([pa.array(piece), rows.column(0).take(pa.array(of)), rows.column(1).take(pa.array(of))], ["piece", "doc_id", "mark"])

    chosen = texts_of(docs).filter("doc_id is not null").mapInArrow(run, "piece long, doc_id long, mark long")
    same = Window.partitionBy("piece")
    met = chosen.withColumn("met", F.min("doc_id").over(same) < F.max("doc_id").over(same)).filter("met")
    return met.groupBy("doc_id", "mark").agg(F.count("*").alias("passages"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """doc_id, spans (byte ranges lo, hi that go), kept (the bytes that stay) for each row; with `words` its passages, too."""
    marks = repeated(docs, length).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "ranges")).alias("marks"))  # bounded by the document's own length
    both = texts_of(docs).join(marks, ["doc_id", "mark"], "left")
    both = both.join(passages(docs, words), ["doc_id", "mark"], "left") if words else both.withColumn("passages", F.lit(0).cast("long"))
    both = both.select("doc_id", "raw", "marks", F.coalesce("passages", F.lit(0)).alias("passages"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                spans, kept = [], []
                for raw, own in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                    raw = raw or b""
                    told = merged([(m["first"] + r["lo"], m["first"] + r["hi"] - 1 + length) for m in own or () for r in m["ranges"]])
                    at, parts = 0, []
                    for lo, hi in told:
                        parts.append(raw[at:lo])
                        at = hi
                    spans.append([{"lo": a, "hi": b} for a, b in told])
                    kept.append(b"".join([*parts, raw[at:]]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary()), rows.column(3)], ["doc_id", "spans", "kept", "passages"])

    told = both.mapInArrow(run, "doc_id long, spans array<struct<lo:long,hi:long>>, kept binary, passages long")
    return told if words else told.drop("passages")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def digests(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]), F.lit(0).cast("long"))
    return remove(docs, length, words).select("doc_id", (F.length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), *(["passages"] if words else []))
