import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidegrid.llm import labels, quality, secret_scan
from tidegrid.llm.common import fold, table

from .test_duplicates import brute_classes

DATA = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_steps(spark):
    """Each stage again in plain Python, on the rows that the one before keeps."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    rows, share = labels.sample(table(spark, DATA, "documents"), table(spark, DATA, "labels"), "quality", fold("doc_id", 5) != 0, corpus_pipeline.LABELLED)
    it = quality.fit(rows, share)
    import numpy as np

    docs = {k: t for k, t in docs.items() if it.score(np.array([quality.describe(t or "")]))[0] >= corpus_pipeline.CUT}
    ids = sorted(docs)
    docs = {ids[k]: docs[ids[k]] for k, (_, c) in enumerate(brute_classes([docs[i] for i in ids], 5, 80)) if c == k}
    items = [r["text"] for r in table(spark, DATA, "benchmark").collect()]
    docs = {k: t for k, t in docs.items() if not any(x in t for x in items)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(out) == set(docs)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for k, text in docs.items():
        found = secret_scan.spans(text)
        if not found:
            assert out[k]["ids"] == lib.encode(text) and out[k]["round_trip"]


def test_stages_keep_columns(spark):
    docs = table(spark, DATA, "documents").withColumn("text", F.when(F.col("doc_id") % 50 == 0, None).otherwise(F.col("text")))
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
