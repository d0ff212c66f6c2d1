"""The training-data queries, by name."""

from __future__ import annotations

from . import chunks, decontaminate, merkle, minhash, mixing, packing, pii, quality, resampling, sharding, suffixes, vectors, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_minhash": minhash.op2,
    "op3_vectors": vectors.op3,
    "op4_mixing": mixing.op4,
    "op5_warc": warc.op5,
    "op6_chunks": chunks.op6,
    "op7_pii": pii.op7,
    "op8_suffixes": suffixes.op8,
    "op9_quality": quality.op9,
    "op10_sharding": sharding.op10,
    "op11_merkle": merkle.op11,
    "op12_packing": packing.op12,
    "op13_resampling": resampling.op13,
}


def oracles() -> dict[str, str]:
    """DuckDB SQL by query; operators that SQL cannot express have none."""
    return {
        "op1_decontaminate": decontaminate.op1_sql(),
        "op2_minhash": minhash.op2_sql(),
        "op3_vectors": vectors.op3_sql(),
        "op5_warc": warc.op5_sql(),
        "op7_pii": pii.op7_sql(),
        "op8_suffixes": suffixes.op8_sql(),
        "op10_sharding": sharding.op10_sql(),
        "op11_merkle": merkle.op11_sql(),
        "op13_resampling": resampling.op13_sql(),
    }
