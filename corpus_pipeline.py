"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from pyspark.sql import functions as F

from strideforge.llm import bm25_leaks, byte_bpe, line_dedup, minhash, quality_ftrl
from strideforge.llm.common import fresh, materialize, table, without


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject (score of 0.3 or more)."""
    weights = quality_ftrl.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return quality_ftrl.score(docs, weights, name=name).filter(F.col(name) >= quality_ftrl.THRESHOLD).drop(name)


def lines(spark, docs, sf_dir):
    """Documents without the passages of lines that stand in an earlier place; n_chars follows the text.

    Copies of whole documents stay as they are, for the next stage.
    """
    count = fresh(docs, "n_removed")
    cleaned = line_dedup.remove_passages(docs, copies=line_dedup.COPY, count=count).drop(count)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8), that of the least doc_id."""
    return minhash.one_of_each(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    found = bm25_leaks.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, materialize(found.select("_id", "_th").distinct(), "leaks"))


def tokens(spark, docs, sf_dir):
    """doc_id, ids, n_tokens and the digests of the ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: The trained classifier, the shingle graph and the BPE merges are not SQL; the tests hold the operators against brute force
#: and the stages and run() against planted cases.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
