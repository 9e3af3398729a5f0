"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from folio.llm import ann, chat_format, fim, importance, langid, line_dedup, media, mixing, near_dup, packing, quality, sharding, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_nearest": ann.op2_nearest,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_quality": quality.op4_quality,
        "op5_language_id": langid.op5_language_id,
        "op6_media": media.op6_media,
        "op7_chat_formatting": chat_format.op7_chat_formatting,
        "op8_packing": packing.op8_packing,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
        "op11_warc": warc.op11_warc,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_importance": importance.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op3_near_dup": near_dup.SQL, "op7_chat_formatting": chat_format.SQL, "op9_mixing": mixing.SQL, "op11_warc": warc.SQL, "op12_fill_in_middle": fim.SQL, "op13_importance": importance.SQL}
