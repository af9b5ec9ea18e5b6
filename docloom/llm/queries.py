"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, bpe, chat_format, collocations, divergence, html_extract, licenses, line_dedup, lm_score, mixing, quality, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_simhash": simhash.op4_simhash,
    "op5_ann": ann.op5_ann,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_divergence": divergence.op11_divergence,
    "op12_licenses": licenses.op12_licenses,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
