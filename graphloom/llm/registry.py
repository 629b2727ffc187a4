"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, impact, mixing, pieces, quality, secrets, sharding, simhash, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_warc": warc.op2_warc,
        "op3_ann": ann.op3_ann,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality": quality.op5_quality,
        "op6_topk": impact.op6_topk,
        "op7_mixing": mixing.op7_mixing,
        "op8_pieces": pieces.op8_pieces,
        "op9_simhash": simhash.op9_simhash,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict:
    return {"op2_warc": warc.OP2_SQL, "op6_topk": impact.OP6_SQL, "op7_mixing": mixing.OP7_SQL}
