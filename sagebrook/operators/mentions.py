"""Mentions of stored names in texts, with their places.

The different names are one automaton, built once a worker; a text is read once, whatever the number
of names.  Names beyond a bound are dealt into blocks of bounded size, each an automaton of its own
that reads the texts again, so none is left out.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of one automaton.
NAMES = 200_000

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = frozenset(string.ascii_letters + string.digits)
#: The automaton that a worker holds, by the block it was built for.
_built: dict[str, object] = {}


def lowered(text: Column) -> Column:
    """A-Z, and nothing else, in lower case: places stay what they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _finder(names, token: str, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built.get(token)
        if automaton is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for name in names.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            _built.clear()
            _built[token] = automaton
        for batch in batches:
            rows, found, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column(keys).to_pylist()):
                if not text:
                    continue
                text = text.lower() if text.isascii() else text.translate(_LOWER)
                for last, name in automaton.iter(text):
                    start, end = last + 1 - len(name), last + 1
                    if (start == 0 or text[start - 1] not in _WORD) and (end == len(text) or text[end] not in _WORD):
                        rows.append(i)
                        found.append(name)
                        starts.append(start)
                        ends.append(end)
            if rows:
                at = pa.array(rows, pa.int64())
                arrays = [batch.column(k).take(at) for k in range(keys)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(found), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*batch.schema.names[:keys], "name", "start", "end"]
                )

    return run


def mentions(texts: DataFrame, names: DataFrame, key: Sequence[str] = ("document_id",), most: int = NAMES) -> DataFrame:
    """(*key, name, start, end): every place where a text (*key, text) has one of ``names`` (name) as
    whole words, A-Z and a-z alike; in code points, the end exclusive, overlapping ones too.

    ``name`` is in lower case.  Null and empty texts and names mention nothing.
    """
    spark = texts.sparkSession
    different = names.select(lowered(F.col("name")).alias("name")).filter("name <> ''").distinct()
    blocks = max(1, -(-different.count() // most))
    given = texts.select(*key, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in key)
    out = None
    for block in range(blocks):
        # A block's names are within a bound; the driver holds one block at a time.
        mine = different.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([r["name"] for r in mine])
        part = given.mapInArrow(_finder(sent, uuid.uuid4().hex, len(key)), f"{fields}, name string, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out
