"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from spindrift.llm import ann, brown, fingerprint, infill, jaccard, licenses, mixing, packing, passages, quantize, sharding, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_mixing": mixing.op3_mixing,
        "op4_licenses": licenses.op4_licenses,
        "op5_brown": brown.op5_brown,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_ann": ann.op8_ann,
        "op9_packing": packing.op9_packing,
        "op10_sharding": sharding.op10_sharding,
        "op11_infill": infill.op11_infill,
        "op12_passages": passages.op12_passages,
        "op13_quantize": quantize.op13_quantize,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op3_mixing": mixing.OP3_SQL, "op6_jaccard": jaccard.OP6_SQL, "op10_sharding": sharding.OP10_SQL, "op11_infill": infill.OP11_SQL, "op12_passages": passages.OP12_SQL, "op13_quantize": quantize.OP13_SQL}
