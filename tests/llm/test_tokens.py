import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import pieces, token_files

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def random_texts(seed, alphabet, n):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_pieces_equal_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCodec(MODEL)
    texts = ["", " ", "  ", "a  b", "\n\n a", "▁", "é😀\0x", "<s> </s><0x41>", "a" * 3000, " ▁x <s> é", "ab\r\n\tc", "日本語 한국어", "x ⁇ y"]
    texts += random_texts(1, "abcdefghijklmnopqrstuvwxyzABCDEéüß0123 ,.▁\n th in er", 3000)
    for s in texts:
        ids = lib.encode(s)
        assert own.encode(s) == ids
        assert own.decode(ids) == lib.decode(ids) == own.both(s)[1]


def test_decoding_of_any_ids():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCodec(MODEL)
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.randint(0, 300) if r.random() < 0.6 else r.randint(0, 31999) for _ in range(r.randint(0, 6))]
        assert own.decode(ids) == lib.decode(ids)


def test_memo_forgets_without_harm():
    own = pieces.PieceCodec(MODEL)
    own.memo.limit = own.words.limit = 3
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for s in random_texts(3, "abc de", 200):
        assert own.encode(s) == lib.encode(s)


def test_piece_digests(odd, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {r["doc_id"]: r for r in pieces.digests(odd, MODEL).collect()}
    for r in odd.collect():
        ids = lib.encode(r["text"] or "")
        f = found[r["doc_id"]]
        assert (f["n_tokens"], f["ids_sha256"], f["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert pieces.digests(none, MODEL).count() == 0
    back = pieces.decode(pieces.encode(odd, MODEL), MODEL, text="back").select("text", "back").collect()
    assert all(r["back"] == (r["text"] or "") for r in back)


def test_byte_parts_equal_the_library():
    lib, own = Tokenizer.from_file(BYTES), token_files.ByteBpe(BYTES)
    alphabet = ["a,", "b", " Then,", "a.b", " ", "\n", "\t", "\x1c", "\xa0", "　", "é", "1", ".", "<|endoftext|>", "'s", "\r", "\x85", "​", "\0", "the", "_"]
    for s in ["", " ", *random_texts(4, alphabet, 4000)]:
        assert np.frombuffer(own.encode(s), "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids


def test_token_files(spark, odd, none, tmp_path):
    lib = Tokenizer.from_file(BYTES)
    for encoding in ("delta", "dictionary"):
        start = 0
        found = {r["doc_id"]: r for r in token_files.digests(odd, BYTES, 2, encoding=encoding, page_rows=5).collect()}
        for r in odd.orderBy("doc_id").collect():
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            f = found[r["doc_id"]]
            assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_files.digests(none, BYTES, 2).count() == 0
    token_files.write(odd, f"{tmp_path}/t", BYTES, 2)
    places = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in token_files.places(spark, f"{tmp_path}/t").collect()}
    assert places == {k: (r["start"], r["n_tokens"]) for k, r in found.items()}


def test_file_layout(odd, tmp_path):
    import glob

    import pyarrow.parquet as pq

    for encoding, name in (("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")):
        token_files.write(odd, f"{tmp_path}/{encoding}", BYTES, 2, encoding=encoding)
        meta = pq.read_metadata(max(glob.glob(f"{tmp_path}/{encoding}/*.parquet"), key=lambda p: pq.read_metadata(p).num_rows))
        column = meta.row_group(0).column(meta.num_columns - 1 if hasattr(meta, "num_columns") else 4)
        assert name in column.encodings and column.has_offset_index


def test_readers_skip_pages(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.col("id")).alias("text")).coalesce(1)
    token_files.write(rows, f"{tmp_path}/t", BYTES, 2, page_rows=50)
    one = token_files.read(spark, f"{tmp_path}/t").filter("doc_id = 1234")
    assert [r["doc_id"] for r in one.collect()] == [1234]
    plan = one._jdf.queryExecution().executedPlan()
    assert 1 <= plan.collectLeaves().head().metrics().apply("numOutputRows").value() < 400


def test_rows_of_one_id_are_ordered_by_text(spark):
    rows = [(3, "b b b"), (3, "a"), (1, "z"), (3, None), (3, "a")]
    for order in (rows, rows[::-1]):
        told = token_files.digests(spark.createDataFrame(order, "doc_id bigint, text string"), BYTES, 2)
        assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in told.collect()) == [(1, 0, 2), (3, 2, 1), (3, 3, 2), (3, 5, 2), (3, 7, 4)]


def test_columns_of_any_name_go_through(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2), (2, None, None, None), (2, None, None, None)], "doc_id bigint, text string, _source_ string, `a.b` int")
    told = pieces.decode(pieces.encode(df, MODEL), MODEL, text="back").orderBy("doc_id").collect()
    assert [(r["text"], r["_source_"], r["a.b"], r["back"]) for r in told] == [("a b", "x", 2, "a b"), (None, None, None, ""), (None, None, None, "")]
