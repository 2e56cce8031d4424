"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from factloom.llm.bpe import op2_bpe
from factloom.llm.chat_format import op6_chat_format
from factloom.llm import decontamination, divergence, license_scan
from factloom.llm.jaccard_join import op12_jaccard_join
from factloom.llm.minhash_dedup import op1_minhash_dedup
from factloom.llm.pii import op5_pii
from factloom.llm.quality_classifier import op4_quality_classifier
from factloom.llm.quality_rules import op9_quality_rules
from factloom.llm.spelling import op11_spelling_variants
from factloom.llm.substring_dedup import op7_substring_dedup
from factloom.llm.toxicity import op10_toxicity
from factloom.session import tune


def _tuned(fn):
    return lambda spark, sf_dir: fn(tune(spark), sf_dir)


QUERIES = {
    fn.__name__: _tuned(fn)
    for fn in (
        op1_minhash_dedup,
        op2_bpe,
        decontamination.op3_decontamination,
        op4_quality_classifier,
        op5_pii,
        op6_chat_format,
        op7_substring_dedup,
        license_scan.op8_license_scan,
        op9_quality_rules,
        op10_toxicity,
        op11_spelling_variants,
        op12_jaccard_join,
        divergence.op13_source_divergence,
    )
}
ORACLES: dict[str, str] = {
    "op3_decontamination": decontamination.SQL,
    "op8_license_scan": license_scan.SQL,
    "op13_source_divergence": divergence.SQL,
}
