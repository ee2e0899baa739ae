"""One query per training-data operator and the pipeline, over whole tables with production parameters."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, fim, html, imatch, jaccard, language, lines, mixing, phrases, ppm, simhash, suffix, topk

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe": bpe.op1_bpe,
    "op2_imatch": imatch.op2_imatch,
    "op3_language": language.op3_language,
    "op4_html": html.op4_html,
    "op5_simhash": simhash.op5_simhash,
    "op6_lines": lines.op6_lines,
    "op7_topk": topk.op7_topk,
    "op8_ppm": ppm.op8_ppm,
    "op9_mixing": mixing.op9_mixing,
    "op10_suffix": suffix.op10_suffix,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_fim": fim.op12_fim,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES: dict[str, str] = {"op6_lines": lines.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_fim": fim.ORACLE, "op13_phrases": phrases.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
