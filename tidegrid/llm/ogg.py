"""Ogg media columns: write payloads into physical streams of two logical ones, and read them back with all checks.

A stored form is one chained-free physical bitstream: an audio stream of 8-bit mono samples (a header packet, then
packets of a fixed number of samples; the granule position of a page is the number of samples up to the end of its
last finished packet) and a notes stream that is multiplexed with it (its granule position counts packets). Reading
verifies each page's checksum and sequence number, joins packets over pages from their lacing values, takes the
logical streams apart by serial number, and derives each packet's time from the granule positions.

A null payload gives null media; null media gives null fields. Damaged media raises no error: its row names the fault
in `fault`, and its other fields are null. Rows are independent; ties, repeated rows and empty tables need no care.
"""

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage

RATE = 8000
#: Samples of an audio packet.
PACKET = 4080
#: Segments of a page, at most 255.
SEGMENTS = 255
AUDIO_HEAD = struct.Struct("<8sIHH")
NOTES_HEAD = struct.Struct("<8sIQ")
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, start 0, bits not mirrored: that of zlib on mirrored bytes, mirrored back."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    rest = lacing + body
    found = checksum(PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + rest)
    return PAGE.pack(b"OggS", 0, kind, granule, serial, number, found, len(lacing)) + rest


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of a logical stream; each packet comes with the granule position at its end. The first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, ended, open_at_start = bytearray(), [], -1, False

    def flush(last: bool, still_open: bool) -> None:
        nonlocal lacing, body, ended, open_at_start
        kind = CONTINUED * open_at_start | FIRST * (not out) | LAST * last
        out.append(page(kind, ended, serial, len(out), bytes(lacing), b"".join(body)))
        lacing, body, ended, open_at_start = bytearray(), [], -1, still_open

    for k, (packet, granule) in enumerate(packets):
        at, left = 0, len(packet) // 255 + 1
        while left:
            take = min(left, SEGMENTS - len(lacing))
            if not take:
                flush(False, at > 0)
                continue
            left -= take
            size = len(packet) - at if not left else take * 255
            lacing += b"\xff" * (take - 1) + bytes([size - (take - 1) * 255])
            body.append(packet[at : at + size])
            at += size
        ended = granule
        if not k and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return out


def encode(payload: bytes) -> bytes:
    """The stored form of `payload`; equal payloads have equal forms."""
    serial = zlib.crc32(payload)
    audio = [(AUDIO_HEAD.pack(b"PCM8mono", RATE, 1, 8), 0)]
    audio += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    notes = [(NOTES_HEAD.pack(b"NOTEnote", serial, len(payload)), 0), (f"samples={len(payload)}".encode(), 1)]
    a, b = pages(audio, serial), pages(notes, serial ^ 0xFFFFFFFF)
    return b"".join([a[0], b[0], *a[1:2], b[1], *a[2:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end, -1 where its page gives that of a later one.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: list[bytes] = field(default_factory=list)


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises ValueError on damage."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise ValueError("cut page")
        magic, version, kind, granule, serial, number, found, n = PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page")
        lacing = media[at + PAGE.size : at + PAGE.size + n]
        start = at + PAGE.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("cut page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != found:
            raise ValueError("checksum")
        if bool(kind & FIRST) == (serial in streams):
            raise ValueError("start of stream")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended or bool(kind & CONTINUED) != bool(s.part):
            raise ValueError("order of pages")
        done = 0
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append(b"".join([*s.part, media[start : start + size]]))
                s.part = []
                start, size, done = start + size, 0, done + 1
        if size or (n and lacing[-1] == 255):
            s.part.append(media[start : start + size])
        s.granules += [-1] * (done - 1) + [granule] * bool(done)
        s.pages += 1
        s.ended = bool(kind & LAST)
        at = end
    for s in streams.values():
        if s.part or not s.ended:
            raise ValueError("no end")
    return streams


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload and what the streams tell: pages, packets, seconds, the time at which each timed packet ends."""
    streams = demultiplex(media)
    audio = [s for s in streams.values() if s.packets[0][:8] == b"PCM8mono"]
    notes = [s for s in streams.values() if s.packets[0][:8] == b"NOTEnote"]
    if len(audio) != 1 or len(notes) != 1:
        raise ValueError("streams")
    _, rate, channels, bits = AUDIO_HEAD.unpack(audio[0].packets[0])
    payload = b"".join(audio[0].packets[1:])
    _, other, samples = NOTES_HEAD.unpack(notes[0].packets[0])
    if (channels, bits) != (1, 8) or samples != len(payload) or other != zlib.crc32(payload) or audio[0].granules[-1] != samples:
        raise ValueError("samples")
    times = [g / rate for g in audio[0].granules[1:] if g >= 0]
    return payload, {"pages": sum(s.pages for s in streams.values()), "streams": len(streams), "packets": sum(len(s.packets) for s in streams.values()), "seconds": times[-1] if times else 0.0, "times": times}


def write_column(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """`df` with a binary column `media`; a column of that name is replaced."""
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else encode(bytes(x)))

    return df.withColumn(media, F.pandas_udf(run, "binary")(F.col(payload)))


FIELDS = "payload binary, pages int, streams int, packets int, seconds double, times array<double>, fault string"


def read_column(df: DataFrame, media: str = "media", info: str = "info") -> DataFrame:
    """`df` with a struct column `info` of FIELDS, read from the stored form."""
    def one(x):
        if x is None:
            return (None,) * 7
        try:
            payload, told = decode(bytes(x))
        except ValueError as e:
            return (None,) * 6 + (str(e),)
        return payload, told["pages"], told["streams"], told["packets"], told["seconds"], told["times"], None

    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in column], columns=[x.split()[0] for x in FIELDS.split(", ")], dtype=object)

    return df.withColumn(info, F.pandas_udf(run, FIELDS)(F.col(media)))


def padded(text: str | None, unit: int = 192) -> tuple[int, bytes]:
    """Bytes of the text (null: empty), and these with spaces up to a positive multiple of `unit`."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % unit or (0 if raw else unit))


def digests(df: DataFrame) -> DataFrame:
    """Write each text of `df` (doc_id, text) as media into the shared folder, read the stored bytes back and return what the media query asks for."""

    def make():
        def store(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [padded(s) for s in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([encode(x) for _, x in both], pa.binary())], ["doc_id", "n_bytes", "media"])

        return store

    def make_back():
        def back(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for media in batch.column(2).to_pylist():
                payload, told = decode(media)
                for k, v in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-16:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", f"pages={told['pages']};packets={told['packets']};seconds={told['seconds']:.4f}")):
                    out[k].append(v)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v) for v in out.values())], ["doc_id", "n_bytes", *out])

        return back

    stored = stage(map_batches(df.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")
    return map_batches(stored, make_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
