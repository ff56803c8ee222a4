"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from dagql.llm import ann, decontaminate, lang_id, mix, near_dup, quality, secrets, shard, substrings, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_ann": ann.op2_ann,
        "op3_quality": quality.op3_quality,
        "op4_secrets": secrets.op4_secrets,
        "op5_near_dup": near_dup.op5_near_dup,
        "op6_shard": shard.op6_shard,
        "op7_substrings": substrings.op7_substrings,
        "op8_mix": mix.op8_mix,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_lang_id": lang_id.op10_lang_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.SQL, "op2_ann": ann.SQL, "op4_secrets": secrets.SQL, "op5_near_dup": near_dup.SQL, "op7_substrings": substrings.SQL, "op8_mix": mix.SQL, "op9_decontaminate": decontaminate.SQL}
