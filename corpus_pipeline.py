"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with their columns; the last one returns packed pieces. ``run`` writes each
stage's result as Parquet in the shared folder and reads it again for the next,
so a lost executor repeats one stage's work at most; a stage's input goes once its
result is written.

Every stage takes tables with nulls in any column, empty and very long texts,
repeated rows, no rows at all, and further columns of any name, which the first
four hand on. What each stage makes of them is said with it.
"""

from __future__ import annotations

from semloom.llm import decontaminate, jaccard, lines, packing, quality
from semloom.llm.store import bounded_batches, discard, written


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the quality model; the others go.

    Null and empty texts have fewer than 50 words and go; repeated rows are judged each
    by itself; a probability of just the threshold stays; without both labels the base rules decide alone.
    """
    bounded_batches(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark, docs, sf_dir):
    """Repeated multi-line chunks leave the texts.

    Null and empty texts stay as they are; the first holder by doc_id keeps a chunk (a null doc_id
    comes last), rows of one doc_id each their first; a text that loses all its words goes.
    """
    bounded_batches(spark)
    return lines.dedup_stage(docs)


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near duplicates (5-word shingles, similarity 0.8): the one with the least doc_id.

    Texts without words have no group and stay; of rows with the same doc_id and text one stays;
    a group without any doc_id keeps each different text; a similarity of just 0.8 links.
    """
    bounded_batches(spark)
    return jaccard.dedup_stage(docs, 5, 80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold too much of the benchmark go.

    Null and empty texts hold nothing and stay, as does all without a benchmark; repeated rows are judged each by itself;
    hits in just 5 % of the words are too many.
    """
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark, docs, sf_dir):
    """Pieces of training sequences: a null or empty text packs as its end id, repeated rows each by themselves."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            discard(before)
    return docs
