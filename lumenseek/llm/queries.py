"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from lumenseek.llm import (alignment, decontaminate, extraction, fingerprints, language, mixing, near_dedup, quality, revisits, sharding,
                           tokens, toxicity, variants)
from lumenseek.llm.common import table


def _file(name: str) -> str:
    """Path of a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_mixing": lambda spark, sf: mixing.op1_mixing(table(spark, sf, "documents")),
    "op2_toxicity": lambda spark, sf: toxicity.op2_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op3_sharding": lambda spark, sf: sharding.manifest(table(spark, sf, "documents")),
    "op4_near_dedup": lambda spark, sf: near_dedup.op4_near_dedup(table(spark, sf, "documents")),
    "op5_language": lambda spark, sf: language.op5_language(table(spark, sf, "documents")),
    "op6_revisits": lambda spark, sf: revisits.op6_revisits(table(spark, sf, "pages")),
    "op7_fingerprints": lambda spark, sf: fingerprints.op7_fingerprints(table(spark, sf, "documents")),
    "op8_tokens": lambda spark, sf: tokens.op8_tokens(spark, table(spark, sf, "documents"), _file("word_bpe_49k.json")),
    "op9_decontaminate": lambda spark, sf: decontaminate.op9_decontaminate(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op11_extraction": lambda spark, sf: extraction.op11_extraction(table(spark, sf, "pages")),
    "op12_variants": lambda spark, sf: variants.op12_variants(table(spark, sf, "documents")),
    "op13_alignment": lambda spark, sf: alignment.op13_alignment(
        spark, table(spark, sf, "documents"), _file("byte_bpe_50k.json"), _file("piece_bpe_32k.model")),
    "op10_quality": lambda spark, sf: quality.op10_quality(table(spark, sf, "documents"), table(spark, sf, "labels")),
}

ORACLES = {"op6_revisits": revisits.OP6_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
