"""Chunking of texts by characters and by sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..config import CONFIG

# Fixed value: where a sentence ends.
SENTENCE_END = re.compile(r"([.!?]+)(\s+(?=[A-Z])|[\n]+|$)")


def char_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most ``size`` characters, cut back to the last sentence or line end in
    their second half; each starts ``overlap`` before the end of the one before."""
    at, n = 0, len(text)
    while at < n:
        stop = at + size
        if stop < n:
            mark = max(text.rfind(". ", at, stop), text.rfind("\n", at, stop))
            if mark - at > size * 0.5:
                stop = mark + 1
        yield at, stop
        at = stop - overlap


def char_chunks(text: str, size: int = CONFIG.chunk_chars, overlap: int = CONFIG.chunk_overlap_chars) -> list[str]:
    """The windows' texts without outer spaces; empty ones are dropped."""
    if size <= 0 or overlap < 0 or overlap >= size / 2:
        raise ValueError("the overlap must be under half the size")
    pieces = (text[a:b].strip() for a, b in char_spans(text, size, overlap))
    return [p for p in pieces if p]


def sentences(text: str, shortest: int = CONFIG.min_sentence_chars) -> list[tuple[str, int, int, int]]:
    """(text, start, end, index) of sentences of at least ``shortest`` characters.

    Positions count one space between sentences, so they are approximate.  A blank piece
    before an end mark moves the reading by one part only: the mark then opens a sentence.
    """
    parts: list[str] = []
    at = 0
    for end in SENTENCE_END.finditer(text):
        parts += [text[at : end.start()], end[1], end[2] or ""]
        at = end.end()
    parts.append(text[at:])
    found: list[tuple[str, int, int, int]] = []
    position = i = 0
    while i < len(parts):
        if not parts[i].strip():
            i += 1
            continue
        whole = "".join(parts[i : i + 3]).strip()
        i += 3
        if len(whole) < shortest:
            position += len(whole)
        else:
            found.append((whole, position, position + len(whole), len(found)))
            position += len(whole) + 1
    return found


def pack(rows: list[tuple[str, int, int, int]], size: int = CONFIG.chunk_tokens, overlap: int = CONFIG.overlap_tokens) -> list[list[tuple]]:
    """Sentences packed into chunks of about ``size`` tokens (four characters each).  A chunk
    begins with the last sentences of the one before that fit into ``overlap`` tokens."""
    cost = [len(r[0]) // 4 for r in rows]
    chunks: list[list[int]] = []
    now: list[int] = []
    for i in range(len(rows)):
        if now and sum(cost[j] for j in now) + cost[i] > size:
            chunks.append(now)
            room, tail = overlap, []
            while len(tail) < len(now) and cost[now[-1 - len(tail)]] <= room:
                room -= cost[now[-1 - len(tail)]]
                tail.append(now[-1 - len(tail)])
            now = tail[::-1]
        now.append(i)
    if now:
        chunks.append(now)
    return [[rows[j] for j in chunk] for chunk in chunks]


CHAR_SCHEMA = "chunk_index int, chunk_text string"
SENTENCE_SCHEMA = (
    "chunk_index int, chunk_text string, sentence_count int, first_sentence_index int, last_sentence_index int, "
    "char_count int, token_estimate int, start_pos int, end_pos int"
)


def _char_rows(text: str | None, size: int, overlap: int) -> list[tuple]:
    return list(enumerate(char_chunks(text or "", size, overlap)))


def _sentence_rows(text: str | None, size: int, overlap: int) -> list[tuple]:
    out = []
    for i, chunk in enumerate(pack(sentences(text or ""), size, overlap)):
        joined = " ".join(s[0] for s in chunk)
        out.append((i, joined, len(chunk), chunk[0][3], chunk[-1][3], len(joined), len(joined) // 4, chunk[0][1], chunk[-1][2]))
    return out


def _expand(df: DataFrame, text_column: str, schema: str, rows, size: int, overlap: int) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    kept = [c for c in df.columns if c != text_column]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, *row) for i, text in enumerate(batch[text_column]) for row in rows(text, size, overlap)]
            chunks = pd.DataFrame(made, columns=["__row", *names])
            base = batch[kept].reset_index(drop=True).loc[chunks.pop("__row")].reset_index(drop=True)
            yield pd.concat([base, chunks], axis=1)

    return df.mapInPandas(run, ", ".join([*fields, schema]))


def chunk_by_chars(df: DataFrame, text_column: str, size: int = CONFIG.chunk_chars, overlap: int = CONFIG.chunk_overlap_chars) -> DataFrame:
    """One row per chunk, with the other columns of ``df``; null and blank texts have none."""
    return _expand(df, text_column, CHAR_SCHEMA, _char_rows, size, overlap)


def chunk_by_sentences(df: DataFrame, text_column: str, size: int = CONFIG.chunk_tokens, overlap: int = CONFIG.overlap_tokens) -> DataFrame:
    """One row per sentence-packed chunk, with the other columns of ``df``."""
    return _expand(df, text_column, SENTENCE_SCHEMA, _sentence_rows, size, overlap)


def envelope(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per document: how many sentences-chunks, characters and tokens it has, and the chunks."""
    chunks = chunk_by_sentences(df.select(id_column, text_column), text_column)
    return chunks.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum("sentence_count").alias("total_sentences"),
        F.sum("char_count").alias("total_chars"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("chunks"),
    )


def register(spark: SparkSession) -> None:
    """SQL table functions: ``char_chunks(text, size, overlap)`` and ``sentence_chunks(...)``."""

    @udtf(returnType=CHAR_SCHEMA)
    class CharChunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from _char_rows(text, size, overlap)

    @udtf(returnType=SENTENCE_SCHEMA)
    class SentenceChunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from _sentence_rows(text, size, overlap)

    spark.udtf.register("char_chunks", CharChunks)
    spark.udtf.register("sentence_chunks", SentenceChunks)
