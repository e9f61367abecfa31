"""A corpus from raw documents to token ids: toxicity, near copies, repeated passages, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its decision
takes effect: rejected documents go, repeated passages are cut out of the texts. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.catalog.registry import register
from cohortia.llm import decontaminate, minhash, pieces, substrings, toxicity
from cohortia.llm.queries import tokenizer_path
from cohortia.llm.tables import SMALL_BYTES, cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the threshold; learnt from labels outside the held-out third."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every near-duplicate component (five words, similarity 0.8)."""
    judged = minhash.near_duplicates(docs, size=5, percent=80)
    # A doc_id goes if any of its rows was judged a copy; texts move only if the list is too long to send.
    gone = cut(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    listed = F.broadcast(gone) if gone.count() * 16 <= SMALL_BYTES else gone
    return docs.join(listed, F.col("doc_id") == F.col("__gone"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that a document of smaller id has; n_chars follows."""
    cleaned = substrings.remove_repeats(docs, keep_text=True)
    changed = F.col("__n_removed") > 0
    kind = docs.schema["n_chars"].dataType
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(kind)
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to."""
    return pieces.encode_texts(docs, pieces.load_model(tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", keep_one_copy),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Learnt weights and token ids are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, each one's result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
