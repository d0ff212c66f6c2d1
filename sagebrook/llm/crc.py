"""CRC-32 in DuckDB SQL, which has no such function."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320


def _table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text expression, as BIGINT."""
    codes = "[" + ", ".join(f"{c}::BIGINT" for c in _table()) + "]"
    first = 0xFFFFFFFF
    # Two hex digits a byte; the start value comes first in the list that is folded.
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr({digits}, CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)"
    step = f"xor(c >> 8, ({codes})[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_concat([{first}::BIGINT], {octets}), lambda c, b: {step}), {first}::BIGINT)"
