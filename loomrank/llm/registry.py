"""The queries and SQL of this package, and the pipeline of corpus_pipeline.py."""

from __future__ import annotations

from . import decontaminate, divergence, fingerprint, html_main, language, licenses, near_dedup, packing, quality, ranked_search, repeats, sentence_dedup, toxicity


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, which stands beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_licenses": licenses.op1_licenses,
        "op2_packing": packing.op2_packing,
        "op3_quality": quality.op3_quality,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_substring_dedup": sentence_dedup.op5_substring_dedup,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_main_text": html_main.op7_main_text,
        "op8_repeats": repeats.op8_repeats,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_language": language.op10_language,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op9_decontaminate": decontaminate.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op13_divergence": divergence.ORACLE}
