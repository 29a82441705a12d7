"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from . import chat, ctw, decontaminate, html_pages, jaccard, lines, negatives, packing, quality, spelling, substring, tokens, toxicity
from .store import bounded_batches


def _read(spark, sf_dir: str, name: str):
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op2_jaccard_join(spark, sf_dir):
    return jaccard.report(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substring.passages(_read(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op7_html_extraction(spark, sf_dir):
    return html_pages.extract(_read(spark, sf_dir, "pages"))


def op8_line_dedup(spark, sf_dir):
    return lines.report(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op10_lm_scoring(spark, sf_dir):
    return ctw.score(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.report(_read(spark, sf_dir, "embeddings"))


def op12_chat_formatting(spark, sf_dir):
    return chat.report(_read(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.report(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard.ORACLE_SQL,
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL,
        "op12_chat_formatting": chat.ORACLE_SQL,
        "op13_spelling_variants": spelling.ORACLE_SQL,
    }
