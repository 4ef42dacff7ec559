"""Columns of the caller whose names the tokenizer uses itself."""

import public_tokenizers

from strideforge.llm import byte_bpe


def test_clashing_names(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "hello there", "w", 5, 9), (2, None, "x", None, 8)], "doc_id long, text string, _words string, _bytes long, n_tokens int")
    found = byte_bpe.encode(docs, path, pattern)
    assert found.columns == [*docs.columns, "ids"]
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1]._words, rows[1]._bytes, rows[1].n_tokens) == ("w", 5, 9) and rows[2].ids == []
    decoded = byte_bpe.decode(found, path, digests=True)
    assert decoded.columns == ["doc_id", "text", "_words", "_bytes", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: r.n_tokens for r in decoded.collect()} == {1: len(rows[1].ids), 2: 0}
    plain = byte_bpe.encode(docs.select("doc_id", "_words"), path, pattern, text="_words")
    assert plain.columns == ["doc_id", "_words", "ids"] and byte_bpe.decode(plain, path).filter("doc_id = 1").first().decoded == b"w"
