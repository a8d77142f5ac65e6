"""The numbered operators' queries, and the SQL of those that SQL can state."""

from __future__ import annotations

from herald.llm import bpe, conversations, decontamination, fingerprints, language, lines, mixing, pii, quality, repeats, secrets, simhash, whitening


def queries():
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality": quality.op3_quality,
        "op4_repeats": repeats.op4_repeats,
        "op5_pii": pii.op5_pii,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_secrets": secrets.op7_secrets,
        "op8_language": language.op8_language,
        "op9_mixing": mixing.op9_mixing,
        "op10_bpe": bpe.op10_bpe,
        "op11_conversations": conversations.op11_conversations,
        "op12_whitening": whitening.op12_whitening,
        "op13_decontamination": decontamination.op13_decontamination,
    }


def oracle_sql():
    return {"op4_repeats": repeats.SQL, "op5_pii": pii.SQL, "op9_mixing": mixing.SQL, "op13_decontamination": decontamination.SQL}
