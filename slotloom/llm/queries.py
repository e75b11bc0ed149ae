"""The queries of this subpackage, by name, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from slotloom.llm import ann, bpe, langid, media, mixing, pii, quality, simhash, tokenbin, toxicity

QUERIES = {
    "op1_tokenbin": tokenbin.op1_tokenbin,
    "op2_media": media.op2_media,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_poisson_mix": mixing.op5_poisson_mix,
    "op6_langid": langid.op6_langid,
    "op7_ann": ann.op7_ann,
    "op8_bpe": bpe.op8_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
}
ORACLE_SQL = {"op5_poisson_mix": mixing.ORACLE}
