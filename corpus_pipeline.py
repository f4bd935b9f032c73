"""The corpus pipeline: toxicity, near and exact repeats, benchmark leaks, then the mix of sources.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes every stage to the
shared folder and reads it back, so a lost executor costs at most one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, mixing, nearcopies, substring, toxicity
from tessera.llm.common import durable, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; labels of held-out rows are not learned from."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    name = fresh("toxicity_score", docs.columns)
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of documents with 0.8 or more of their five-word shingles in common.

    Candidates come from the Gray-order index over 256-bit SimHash fingerprints; 64 bits tell too little at 0.8, where about
    10 of them differ. What is linked is checked exactly."""
    return nearcopies.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 50-word windows that an earlier document has."""
    # other columns travel under names that can't clash with those of the operator
    rest = {c: f"_{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    out = substring.remove_repeats(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in rest.items())))
    cut = F.col("n_removed") > 0
    back = {c: F.col(n) for c, n in rest.items()} | {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in rest:
        back["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col(rest["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return out.select(*(back[c].alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies (how often each is taken) and taken."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
