"""Ids are joined and decoded by one worker: a task of the last stage holds one Python process and no second copy of the ids."""

import public_tokenizers

from strideforge.llm import byte_bpe


def test_round_trip_is_encode_then_decode_in_one_worker(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["hello there", None, "", "naïve — 日本語\n\n x  y", "a b " * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    apart = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"]), path, digests=True, keep_ids=True)
    together = byte_bpe.round_trip(docs, keep_ids=True)
    assert together.schema == apart.schema
    assert sorted(together.collect()) == sorted(apart.collect())
    steps = together._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert steps == 2  # words to ids, and blocks to rows; the cut into blocks is written before
