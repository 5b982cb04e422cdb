"""The queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidewatch.llm import balltree, html, licenses, minhash, mixing, oracles, packing, phrases, pii, quality, rollup, runs, substrings, warc


def queries():
    return {
        "op1_pii": pii.op1_pii,
        "op2_html": html.op2_html,
        "op3_top_k": balltree.op3_top_k,
        "op4_mixing": mixing.op4_mixing,
        "op5_substrings": substrings.op5_substrings,
        "op6_warc": warc.op6_warc,
        "op7_quality": quality.op7_quality,
        "op8_packing": packing.op8_packing,
        "op9_token_counts": rollup.op9_token_counts,
        "op9_token_counts_bpe": rollup.op9_token_counts_bpe,
        "op10_near_duplicates": minhash.op10_near_duplicates,
        "op11_phrases": phrases.op11_phrases,
        "op12_licenses": licenses.op12_licenses,
        "op13_runs": runs.op13_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return oracles.oracle_sql() | own
