"""Queries and DuckDB SQL of the training-data operators."""

from . import (
    op1_quality,
    op2_pii_surrogates,
    op3_ngram_join,
    op4_html_text,
    op5_token_files,
    op6_nbest,
    op7_nn_descent,
    op8_substring_dedup,
    op9_decontamination,
    op10_sharding,
    op11_alignment,
    op12_packing,
    op13_resampling,
)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_quality": op1_quality.query,
        "op2_pii_surrogates": op2_pii_surrogates.query,
        "op3_ngram_join": op3_ngram_join.query,
        "op4_html_text": op4_html_text.query,
        "op5_token_files": op5_token_files.query,
        "op6_nbest": op6_nbest.query,
        "op7_nn_descent": op7_nn_descent.query,
        "op8_substring_dedup": op8_substring_dedup.query,
        "op9_decontamination": op9_decontamination.query,
        "op10_sharding": op10_sharding.query,
        "op11_alignment": op11_alignment.query,
        "op12_packing": op12_packing.query,
        "op13_resampling": op13_resampling.query,
        "pipeline": pipeline,
    }


def oracle_sql():
    """SQL has no tokenizers, models or edit distances within budgets; the other queries are tested
    against brute force or a round trip in tests/llm."""
    return {"op13_resampling": op13_resampling.ORACLE_SQL}
