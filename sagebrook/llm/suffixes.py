"""Repeated passages: every byte covered by a LENGTH-byte string that also starts elsewhere.

Prefix doubling, distributed: positions are ranked by the GRAM bytes that start there, Spark
sorts the pairs (rank, rank at an offset), and a position's new rank is that of its pair, which
is equal only where both ranks are.  Offsets double (64, 128) until two overlapping halves
make up the threshold; positions whose rank is alone drop out on the way.

To rank far fewer positions than there are bytes, without losing one:

* Every LENGTH-byte window is led by the position in it whose GRAM-byte string has the least
  hash.  Equal windows are led from the same place, so only leaders (about one in 70 bytes)
  are compared at length GRAM, each with all the windows that it leads.  A leader that is
  alone has only windows that are alone.
* Leaders that stand in equal surroundings (the union of their windows) are one class with a
  count: all windows of a class of two or more are repeated.
* Classes that share a leader's name but not its surroundings go on in blocks of BLOCK
  windows: a block whose common part (LENGTH - BLOCK + 1 bytes) is alone is settled, and so
  is a block whose union is not.
* The positions that are left are ranked by doubling.

A 64-bit fingerprint may only ever keep a position in question.  What takes bytes out is
equality of ranks, or of 128-bit digests of the bytes themselves.  ``every_position`` ranks
all positions without that reduction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import NO_ID, batched, discard, materialize, narrow, table

LENGTH = 200
GRAM = 64
BLOCK = 8
U64 = np.uint64


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, text): equal rows have equal keys."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("long")
    return docs.select(
        F.coalesce(doc, F.lit(NO_ID)).alias("k1"), F.xxhash64(text, doc.isNull()).alias("k2"), text.alias("text")
    )


class Spans:
    """Fingerprints and digests of spans of one piece of bytes."""

    def __init__(self, data: np.ndarray):
        self.raw = data.tobytes()
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(kernel.BYTE_VALUE[data] * kernel.powers(kernel.BASE, len(data)), out=self.prefix[1:])
        self.back = kernel.powers(kernel.BASE_INVERSE, len(data) + 1)

    def digests(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
        """128 bits of a digest of each span, and of a number with it, as two columns."""
        salts = np.zeros(len(start), np.int64) if salt is None else salt
        out = [
            hashlib.blake2b(self.raw[lo:hi], digest_size=16, salt=x.to_bytes(8, "little")).digest()
            for lo, hi, x in zip(start.tolist(), end.tolist(), salts.tolist())
        ]
        return np.frombuffer(b"".join(out), dtype=np.int64).reshape(-1, 2)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each span: equal for equal bytes, and no proof of them."""
        return kernel.mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(U64))


def leaders(spans: Spans, offsets: np.ndarray, length: int, gram: int):
    """(leader, first window, last window) of each run of windows with one leader."""
    n = int(offsets[-1])
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none
    at = np.arange(n - gram + 1)
    key = (spans(at, at + gram) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    size, least = 1, key
    width = length - gram + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - size :][: len(key) - width + 1])
    valid = np.zeros(len(least), dtype=bool)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= length:
            valid[lo : hi - length + 1] = True
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none
    lead = (least[window] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (lead[1:] != lead[:-1]) | (window[1:] != window[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(window)])) - 1
    return lead[first], window[first], window[last]


LEADERS = "k1 long, k2 long, h long, u long, w long, a long, lo int, hi int, sha binary"


def _leaders(length: int, gram: int):
    """Leaders of every text (place ``a``, its windows start ``hi``..``lo`` bytes before it, the
    fingerprint h of its gram, the digest (u, w) of its windows' union), and one row without h
    for the text itself: a is its size, sha its digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        ids = [batch.column(c).to_numpy() for c in (0, 1)]
        sha = []
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for begin, _, data, offsets in kernel.slices(batch.column(2)):
            sizes[begin : begin + len(offsets) - 1] = np.diff(offsets)
            spans = Spans(data)
            sha += [hashlib.sha256(spans.raw[lo:hi]).digest() for lo, hi in zip(offsets[:-1], offsets[1:])]
            if int(offsets[-1]) < length:
                continue
            lead, first, last = leaders(spans, offsets, length, gram)
            if len(lead):
                doc = np.searchsorted(offsets, lead, side="right") - 1
                union = spans.digests(first, last + length, lead - first)
                parts.append((doc + begin, spans(lead, lead + gram), union[:, 0], union[:, 1], lead - offsets[doc], lead - last, lead - first))
        if parts:
            doc, h, u, w, a, lo, hi = (np.concatenate(x) for x in zip(*parts))
        else:
            doc = h = u = w = a = lo = hi = np.zeros(0, dtype=np.int64)
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((ids[0][doc], ids[0]))),
                pa.array(np.concatenate((ids[1][doc], ids[1]))),
                pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.array(u), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.array(w), pa.nulls(n, pa.int64())]),
                pa.array(np.concatenate((a, sizes))),
                pa.array(np.concatenate((lo, np.zeros(n, np.int64))).astype(np.int32)),
                pa.array(np.concatenate((hi, np.zeros(n, np.int64))).astype(np.int32)),
                pa.concat_arrays([pa.nulls(len(doc), pa.binary()), pa.array(sha, pa.binary())]),
            ],
            names=["k1", "k2", "h", "u", "w", "a", "lo", "hi", "sha"],
        )

    return run


def with_text(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``grouped`` (k1, k2, ...), one row per document, with the texts of its documents."""
    return docs.join(narrow(grouped.select("k1", "k2")), ["k1", "k2"], "left_semi").join(grouped, ["k1", "k2"])


def _flat(batch: pa.RecordBatch, column: int):
    """A list<struct> column as (row of every entry, its fields)."""
    lists = batch.column(column)
    entries = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, [f.to_numpy() for f in entries.flatten()]


def _pieces(batch: pa.RecordBatch, row: np.ndarray):
    """(spans, places of the piece's texts, which entries are in it) of a batch's texts."""
    for begin, end, data, offsets in kernel.slices(batch.column(2)):
        here = np.flatnonzero((row >= begin) & (row < end))
        if len(here):
            yield Spans(data), offsets[row[here] - begin], np.diff(offsets)[row[here] - begin], here


def _ranges(low: np.ndarray, high: np.ndarray):
    """(index of the range, value) for every value of ranges low..high."""
    many = high - low + 1
    index = np.repeat(np.arange(len(low)), many)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many) + low[index]


def _blocks(length: int, block: int):
    """Rows (k1, k2, h, a, b, core, u, w, lo, hi, n) for the blocks of classes to be split."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, (a, lo, hi, h, n) = _flat(batch, 3)
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for spans, at, size, here in _pieces(batch, row):
            i, b = _ranges(lo[here] // block, hi[here] // block)
            lead, r = a[here][i], row[here][i]
            start = lead - block * b
            core = spans(at[i] + start, at[i] + start - block + 1 + length)
            inside = (start - block + 1 >= 0) & (start + length <= size[i])
            whole = np.empty((len(i), 2), dtype=np.int64)
            whole[inside] = spans.digests((at[i] + start - block + 1)[inside], (at[i] + start + length)[inside])
            # A union that leaves its text equals no other.
            own = kernel.mix(k1[r].view(U64) * U64(31) + k2[r].view(U64) + lead.astype(U64)).view(np.int64)
            whole[~inside] = np.stack((own, k1[r]), axis=1)[~inside]
            yield _rows(
                ["k1", "k2", "h", "a", "b", "core", "u", "w", "lo", "hi", "n"],
                [k1[r], k2[r], h[here][i], lead, b, core.view(np.int64), whole[:, 0], whole[:, 1], np.maximum(lo[here][i], b * block), np.minimum(hi[here][i], b * block + block - 1), n[here][i]],
            )

    return run


def slot_offsets(length: int, gram: int) -> np.ndarray:
    """Where the grams start that make up ``length`` bytes: two halves of the greatest
    gram * 2**t below it, each of 2**t grams; the halves overlap."""
    size = gram
    while size * 2 < length:
        size *= 2
    return np.concatenate((np.arange(0, size, gram), np.arange(0, size, gram) + length - size))


def _windows(length: int, gram: int):
    """Rows (k1, k2, i, n, slot, x, y): the names (x, y) of the grams of windows to be ranked."""
    offsets = slot_offsets(length, gram)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, (a, lo, hi, _, n) = _flat(batch, 3)
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for spans, at, _, here in _pieces(batch, row):
            i, d = _ranges(lo[here], hi[here])
            start, r = a[here][i] - d, row[here][i]
            grams = (at[i] + start)[:, None] + offsets[None, :]
            places, which = np.unique(grams.ravel(), return_inverse=True)
            names = spans.digests(places, places + gram)[which]
            r, start, many = (np.repeat(x, len(offsets)) for x in (r, start, n[here][i]))
            slot = np.tile(np.arange(len(offsets)), len(i))
            yield _rows(["k1", "k2", "i", "n", "slot", "x", "y"], [k1[r], k2[r], start, many, slot, names[:, 0], names[:, 1]])

    return run


def _everywhere(gram: int):
    """Rows (k1, k2, i, x, y): the name of the gram at every position of a text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for begin, _, data, offsets in kernel.slices(batch.column(2)):
            spans = Spans(data)
            r, i = _ranges(np.zeros(len(offsets) - 1, np.int64), np.maximum(np.diff(offsets) - gram, -1))
            names = spans.digests(offsets[r] + i, offsets[r] + i + gram)
            yield _rows(["k1", "k2", "i", "x", "y"], [k1[r + begin], k2[r + begin], i, names[:, 0], names[:, 1]])

    return run


def _ranked(names: DataFrame, name: str) -> DataFrame:
    """(x, y, r): the pairs that more than one position has, sorted, and their ranks."""
    often = names.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("x", "y")
    return materialize(often.sort("x", "y").withColumn("r", F.monotonically_increasing_id()), f"{name}-ranks")


def _doubled(named: DataFrame, slots: int, name: str) -> DataFrame:
    """(k1, k2, i, n) of windows that another one equals, from the names of their grams."""
    while slots > 1:
        before, ranks = named, _ranked(named, name)
        pair = [F.max(F.when(F.col("slot") % 2 == side, F.col("r"))).alias(c) for side, c in enumerate("xy")]
        named = (
            before.join(ranks, ["x", "y"])
            .groupBy("k1", "k2", "i", "n", F.floor(F.col("slot") / 2).cast("long").alias("slot"))
            .agg(*pair)
            .filter("x is not null and y is not null")
        )
        named = materialize(named, f"{name}-pairs")
        discard(before, ranks)
        slots //= 2
    again = named.groupBy("x", "y").agg(F.sum("n").alias("w")).filter("w > 1").drop("w")
    return materialize(named.join(materialize(again, f"{name}-again"), ["x", "y"]).select("k1", "k2", "i", "n"), f"{name}-found")


def every_position(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, name: str = "suffixes") -> DataFrame:
    """(k1, k2, first, last) of starts whose ``length`` bytes also start elsewhere, by prefix
    doubling over every position of ``docs`` (k1, k2, text): some 30 bytes a byte of text go
    through each of several shuffles.  Rows equal in k1 and k2 must not be there."""
    named = materialize(batched(docs, _everywhere(gram), "k1 long, k2 long, i long, x long, y long"), f"{name}-names")
    size = gram
    while True:
        before, ranks = named, _ranked(named, name)
        rank = materialize(before.join(ranks, ["x", "y"]).select("k1", "k2", "i", "r"), f"{name}-ranked")
        discard(before, ranks)
        if size == length:
            return rank.select("k1", "k2", F.col("i").alias("first"), F.col("i").alias("last"))
        step = min(size, length - size)
        ahead = rank.select("k1", "k2", (F.col("i") - step).alias("i"), F.col("r").alias("y"))
        named = materialize(rank.withColumnRenamed("r", "x").join(ahead, ["k1", "k2", "i"]), f"{name}-pairs")
        discard(rank)
        size += step


def _rows(names: list[str], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in arrays], names=names)


def _by_text(rows: DataFrame) -> DataFrame:
    """(k1, k2, list of (a, lo, hi, h, n)): no more entries than a text has windows."""
    entry = F.struct("a", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "h", "n")
    return rows.groupBy("k1", "k2").agg(F.collect_list(entry).alias("es"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, name: str = "suffixes"):
    """(texts, ranges, tables): texts (k1, k2, size, sha), one row per document, the ranges
    (k1, k2, first, last) of starts whose ``length`` bytes also start elsewhere, and the
    tables that the ranges rest on, to be discarded once these are stored.

    ``docs`` has the columns k1, k2 and text.
    """
    every = materialize(batched(docs, _leaders(length, gram), LEADERS), f"{name}-leaders")
    texts = materialize(every.filter("h is null").select("k1", "k2", F.col("a").alias("size"), "sha"), f"{name}-texts")
    found = every.filter("h is not null").drop("sha")

    # Leaders whose gram is not alone.
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    # A table of its own, so that the join's sides are plain and a hot gram can be split.
    often = materialize(often, f"{name}-often")
    shared = materialize(found.join(often, "h"), f"{name}-shared")
    discard(often, every)
    classes = shared.groupBy("h", "u", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "a", "lo", "hi")).alias("r"))
    classes = materialize(classes.select("h", "u", "w", "n", "r.*"), f"{name}-classes")
    settled = shared.join(classes.filter("n > 1").select("h", "u", "w"), ["h", "u", "w"]).select(
        "k1", "k2", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last")
    )

    # Grams with several surroundings: blocks of windows.
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    split = classes.join(several, "h").select("k1", "k2", "a", "lo", "hi", "h", "n")
    cut = lists = materialize(_by_text(split), f"{name}-split")
    blocks = batched(
        with_text(docs, lists).select("k1", "k2", "text", "es"),
        _blocks(length, block),
        "k1 long, k2 long, h long, a long, b long, core long, u long, w long, lo long, hi long, n long",
    )
    blocks = materialize(blocks, f"{name}-blocks")
    discard(cut)
    unions = blocks.groupBy("h", "b", "core", "u", "w").agg(
        F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "a")).alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    unions = materialize(unions.select("h", "b", "core", "u", "w", "n", "lo", "hi", "r.*"), f"{name}-unions")
    in_blocks = (
        blocks.filter("n = 1")
        .join(unions.filter("n > 1").select("h", "b", "core", "u", "w"), ["h", "b", "core", "u", "w"])
        .select("k1", "k2", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))
    )

    # Common parts with several unions: windows, by doubling.
    mixed = unions.groupBy("h", "b", "core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    mixed = materialize(mixed, f"{name}-several")
    lists = materialize(_by_text(unions.join(mixed, ["h", "b", "core"])), f"{name}-mixed")
    windows = batched(
        with_text(docs, lists).select("k1", "k2", "text", "es"), _windows(length, gram), "k1 long, k2 long, i long, n long, slot long, x long, y long"
    )
    windows = materialize(windows, f"{name}-windows")
    discard(mixed, lists)
    doubled = _doubled(windows, len(slot_offsets(length, gram)), name)
    alone = doubled.filter("n = 1").select("k1", "k2", F.col("i").alias("first"), F.col("i").alias("last"))
    ranges = settled.unionByName(in_blocks).unionByName(alone)
    return texts, ranges, (shared, classes, blocks, unions, doubled)


def _remove(length: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, many, kept = [], [], [], []
        lists = batch.column(3)
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py().encode()
            entries = lists[i].values
            first, last = (f.to_numpy() for f in entries.flatten())
            order = np.argsort(first, kind="stable")
            out, at, gone, runs = [], 0, 0, 0
            for lo, hi in zip(first[order].tolist(), (last[order] + length).tolist()):
                if lo > at or (runs == 0):
                    out.append(text[at:lo])
                    gone += hi - lo
                    runs += 1
                    at = hi
                elif hi > at:
                    gone += hi - at
                    at = hi
            out.append(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            many.append(runs)
            kept.append(b"".join(out))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())],
            names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", name: str = "suffixes") -> tuple[DataFrame, DataFrame]:
    """(texts, changed): (k1, k2, size, sha) of all rows, and (k1, k2, n_bytes, n_removed,
    n_spans, kept) of the texts that lose bytes, once for equal rows."""
    rows_ = keyed(docs, id_col, text_col)
    texts, ranges, used = repeated_windows(rows_, length, name=name)
    lists = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("es"))
    lists = materialize(lists, f"{name}-ranges")
    discard(*used)
    rows = with_text(rows_, lists).select("k1", "k2", "text", "es")
    return texts, batched(rows, _remove(length), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", name: str = "suffixes") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Null texts are empty and lose nothing; a row without doc_id is a document like any other;
    repeated rows are documents of their own, so each loses all that ``length`` bytes cover.
    Other columns are ignored; an empty table gives an empty result.
    """
    texts, changed = remove_repeats(docs, length, id_col, text_col, name)
    digests = changed.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["k1", "k2"])
    digests = materialize(digests, f"{name}-kept")
    return texts.join(digests, ["k1", "k2"], "left").select(
        F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id"),
        F.col("size").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents, taken out."""
    return deduplicate(table(spark, sf_dir, "documents"))


def op8_sql(length: int = LENGTH) -> str:
    """The same by counting the windows of all texts, spelt as hexadecimal digits."""
    return f"""WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) AS d FROM (SELECT doc_id, h, unnest(range(n - {length - 1})) AS i FROM docs WHERE n >= {length})),
again AS (SELECT d FROM starts GROUP BY d HAVING count(*) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM starts JOIN again USING (d)),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS e FROM numbered GROUP BY doc_id, run),
pieces AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
kept AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS text
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE text || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""
