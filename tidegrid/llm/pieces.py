"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The text is cut where no piece can reach over (before a word mark that follows another character, and before a
line end, which is no character of any piece); merges on one side then never depend on the other. Each part is
encoded left to right: the longest vocabulary match (Aho-Corasick) is taken if it may stand beside the token before
it, that is if merging the two tokens' joined text again gives just these two; otherwise the next shorter match is
tried, and where none is left the position is marked in a bitfield of failed positions and the last token is given up.
Characters without a piece become their UTF-8 bytes' pieces.

Nulls count as empty texts: no ids, decoded to the empty text. Rows are independent of each other, so ties and
repeated rows give equal results and an empty table an empty one. Extra columns go through `encode` and `decode`
unchanged, whatever their names; the column that is made replaces one of its name.
"""

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, file_of, map_batches, numbered, once

MARK = "▁"
#: Memoised parts in each of two generations, in each Python worker.
MEMO_PARTS = 200_000
#: Rows whose ids are held at one time.
ROWS = 256
#: Ranges of Latin letters.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A run of Latin letters, with marks before it, or a run without them.
WORDS = re.compile(f"{MARK}*[{LATIN}]+|(?:(?!{MARK}*[{LATIN}]).)+", re.S)


class PieceCodec:
    """Encoder and decoder of a merge-type piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if model.is_byte(i)}
        self.ids, self.score = {}, {}
        for i, piece in enumerate(self.pieces):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.unknown = model.unk_id()
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.longer = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.matcher = ahocorasick.Automaton()  # a lone character matches itself anyway
        for piece in self.ids:
            if len(piece) > 1:
                self.matcher.add_word(piece, (piece, len(piece) - 1))
        self.matcher.make_automaton()
        #: Pieces never join a Latin letter and another character than the mark before it: between these a part can be cut again.
        self.mixed = any(re.search(f"[{LATIN}][^{LATIN}]|[^{LATIN}][{LATIN}]", p.lstrip(MARK)) for p in self.ids)
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        self.plain = frozenset(self.ids.values())
        self.names = list(map(str, range(size)))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefix: dict[str, str] = {}
        self.memo = Memo(self._part, MEMO_PARTS)
        self.words = Memo(self._word, MEMO_PARTS // 2)

    def forget(self) -> None:
        """Empty the memos: a Python worker that outlives its task holds little."""
        for memo in (self.memo, self.words):
            memo.clear()
            memo.old = {}
        self.pairs = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: of the adjacent pairs whose joined text is a piece, the best (then leftmost) is joined."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _beside(self, left: str, right: str) -> bool:
        """Whether `right` may follow `left` (at the start: whether it is what its own text merges to)."""
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        told = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return told

    def _shorter(self, token: str) -> str:
        """The longest piece that is a proper prefix of `token`; a lone character has none."""
        found = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), token[0] if len(token) > 1 else "")
        self.prefix[token] = found
        return found

    def backtrack(self, part: str) -> list[str]:
        n = len(part)
        longest: list[str] = list(part)
        for end, (piece, back) in self.matcher.iter(part):  # in the order of their ends: of a start's matches the longest comes last
            longest[end - back] = piece
        pairs, prefix = self.pairs, self.prefix
        tokens: list[str] = []
        failed, at, last, token = 0, 0, "", longest[0]
        while True:
            end = at + len(token)
            ok = not failed >> end & 1
            if ok:
                ok = pairs.get((last, token))
                if ok is None:
                    ok = self._beside(last, token)
            if ok:
                tokens.append(token)
                if end == n:
                    return tokens
                at, last, token = end, token, longest[end]
                continue
            shorter = prefix.get(token)
            if shorter is None:
                shorter = self._shorter(token)
            while not shorter:
                failed |= 1 << at
                token = tokens.pop()
                at -= len(token)
                last = tokens[-1] if tokens else ""
                shorter = prefix.get(token)
                if shorter is None:
                    shorter = self._shorter(token)
            token = shorter

    def _ids(self, tokens: list[str]) -> list[int]:
        try:
            return [self.ids[t] for t in tokens]
        except KeyError:
            pass
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in t.encode())
        return out

    def _word(self, word: str) -> bytes:
        return array("i", self._ids(self.backtrack(word))).tobytes()

    def _part(self, part: str) -> bytes:
        words = None if self.mixed else WORDS.findall(part)
        if words is None or len(words) < 2:
            return self._word(part)
        return b"".join(self.words.all(words))

    def _parts(self, text: str) -> list[str]:
        s = MARK + text.replace(" ", MARK)
        if self.longer:
            return [s]
        if MARK + MARK in s or "\0" in s:
            return re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*", s)
        return s.replace(MARK, "\0" + MARK).replace("\n", "\0\n").split("\0")[1:]

    def ids_of(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.memo.all(self._parts(text))) if text else b"", np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids_of(text).tolist()

    def _text(self, ids: list[int]) -> str:
        """Text of ids, with the mark as a space and without regard to the start of the text."""
        if self.plain.issuperset(ids):
            return "".join([self.surface[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.surface[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`; the mark put before a text when it was encoded goes again."""
        text = self._text(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(MARK) else text

    def both(self, text: str) -> tuple[str, str]:
        """The ids as joined text, and the text that the ids decode to."""
        ids = self.encode(text)
        return ",".join(map(self.names.__getitem__, ids)), self.decode(ids)


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that is part of no whole character becomes U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[k : k + n]).decode() if k + n <= len(raw) else 1 / 0)
                k += n
                break
            except (UnicodeDecodeError, ZeroDivisionError):
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def codec(path: str) -> PieceCodec:
    return once(("pieces", path), lambda: PieceCodec(path))


def _with_columns(df: DataFrame, made: dict[str, str], source: str, path: str, make) -> DataFrame:
    """`df` with the columns of `made` (names and kinds), by make(codec, array of `source`) from slices of ROWS rows; other columns go through."""
    file_of(path)
    kept = [f for f in df.schema.fields if f.name not in made]
    names = [*(f.name for f in kept), *made]
    rows = numbered(df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias("source")))

    def run(batches):
        it = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(it, part.columns[-1])], names)
        it.forget()

    return rows.mapInArrow(run, T.StructType([*kept, *[T.StructField(c, T._parse_datatype_string(kind)) for c, kind in made.items()]]))


def _arrays(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with a column `ids` (array of int) of the encoded text; a column of that name is replaced."""
    return _with_columns(df, {ids: "array<int>"}, text, path, lambda it, column: [_arrays([it.ids_of(s) for s in column.to_pylist()])])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`df` with a column `text` decoded from `ids`; a column of that name is replaced, null ids give an empty text."""
    return _with_columns(df, {text: "string"}, ids, path, lambda it, column: [pa.array(["" if x is None else it.decode(x) for x in column.to_pylist()], pa.string())])


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """`df` with both columns, in one pass through Python."""

    def make(it: PieceCodec, column: pa.Array) -> list[pa.Array]:
        found = [it.ids_of(s) for s in column.to_pylist()]
        return [_arrays(found), pa.array([it.decode(x.tolist()) for x in found], pa.string())]

    return _with_columns(df, {ids: "array<int>", back: "string"}, text, path, make)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of `df`: each encoded, and its ids decoded, in one pass."""
    file_of(path)

    def make():
        it = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                told, back = it.both(text or "")
                counts.append(told.count(",") + 1 if told else 0)
                a.append(hashlib.sha256(told.encode()).hexdigest())
                b.append(hashlib.sha256(back.encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        work.end = it.forget
        return work

    return map_batches(df.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
