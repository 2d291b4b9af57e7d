"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from vigilake.llm import bpe, chat, exact_dedup, fim, importance, line_dedup, lm, media, packing, quality, simhash, tag_paths, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_mil": quality.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_tag_paths": tag_paths.query,
        "op4_chat_formatting": chat.query,
        "op5_simhash_gray": simhash.query,
        "op6_byte_bpe": bpe.query,
        "op7_context_mixing": lm.query,
        "op8_best_fit_packing": packing.query,
        "op9_media_matroska": media.query,
        "op10_warc_derivatives": warc.query,
        "op11_fill_in_middle": fim.query,
        "op12_line_dedup": line_dedup.query,
        "op13_importance_resampling": importance.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op10_warc_derivatives": warc.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
