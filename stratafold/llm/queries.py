"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, extract, langid, licenses, lm, neardup, packing, topk, toxicity, warc

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_licenses": licenses.op2_licenses,
    "op3_language": langid.op3_language,
    "op4_topk": topk.op4_topk,
    "op5_neardup": neardup.op5_neardup,
    "op6_extract": extract.op6_extract,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_lm": lm.op10_lm,
}
ORACLES = {
    "op1_decontamination": decontam.ORACLE,
    "op2_licenses": licenses.ORACLE,
    "op4_topk": topk.ORACLE,
    "op5_neardup": neardup.ORACLE,
    "op9_warc": warc.ORACLE,
}
