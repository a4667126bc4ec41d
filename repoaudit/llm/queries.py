"""Registered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from repoaudit.llm import (
    align,
    backoff,
    bpe,
    fim,
    html_text,
    jaccard,
    mixing,
    oracles,
    packing,
    pii,
    quality,
    toolcalls,
    toxicity,
    vectors,
)
from repoaudit.llm.common import table


def op1_tool_call_linking(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return toolcalls.toolcalls_digest(turns, repeated=True)


def op2_pii(spark, sf_dir):
    return pii.pii_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html_text(spark, sf_dir):
    return html_text.html_digest(table(spark, sf_dir, "pages", "page_id", "html"))


def op5_embedding_duplicates(spark, sf_dir):
    return vectors.vectors_digest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.toxicity_digest(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_quality_rules(spark, sf_dir):
    return quality.quality_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_lm_scoring(spark, sf_dir):
    return backoff.lm_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_packing(spark, sf_dir):
    return packing.packing_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_bpe(spark, sf_dir):
    return bpe.bpe_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_fill_in_middle(spark, sf_dir):
    return fim.fim_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_tokenizer_alignment(spark, sf_dir):
    return align.align_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


ALL = {
    f.__name__: f
    for f in (
        op1_tool_call_linking,
        op2_pii,
        op3_ngram_jaccard,
        op4_html_text,
        op5_embedding_duplicates,
        op6_toxicity,
        op7_quality_rules,
        op8_mixing,
        op9_lm_scoring,
        op10_packing,
        op11_bpe,
        op12_fill_in_middle,
        op13_tokenizer_alignment,
    )
}
ORACLES: dict[str, str] = {"op12_fill_in_middle": oracles.fill_in_middle()}
