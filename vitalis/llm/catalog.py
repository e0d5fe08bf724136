"""The registered training-data queries and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from vitalis.llm import decontam, langid, packing, quality, repair, repeats, secrets, setsketch, sharding, simhash, spelling, tokens, vptree


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": simhash.op1_simhash,
        "op2_sharding": sharding.op2_sharding,
        "op3_packing": packing.op3_packing,
        "op4_secrets": secrets.op4_secrets,
        "op5_quality": quality.op5_quality,
        "op6_decontam": decontam.op6_decontam,
        "op7_tokens": tokens.op7_tokens,
        "op8_langid": langid.op8_langid,
        "op9_ann": vptree.op9_ann,
        "op10_repeats": repeats.op10_repeats,
        "op11_spelling": spelling.op11_spelling,
        "op12_conversations": repair.op12_conversations,
        "op13_setsketch": setsketch.op13_setsketch,
    }


def oracle_sql() -> dict[str, str]:
    """Oracles where SQL expresses the result; the other queries are tested against brute force."""
    return {"op6_decontam": decontam.OP6_SQL, "op9_ann": vptree.OP9_SQL, "op10_repeats": repeats.OP10_SQL, "op11_spelling": spelling.OP11_SQL, "op13_setsketch": setsketch.OP13_SQL}
