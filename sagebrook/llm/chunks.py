"""Content-defined chunking: texts are cut where a gear rolling hash says so, and chunks whose
digest has been seen before are taken out.

A cut depends on the WINDOW bytes before it alone, so an insertion moves the cuts next to it
and no others, and a passage that two texts share falls into equal chunks in both, but for
its ends.  Of equal chunks the first in the order of doc_id and place stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import NO_ID, batched, discard, materialize, table
from .suffixes import keyed, with_text

#: Bytes that a cut depends on, and bits of the hash that must be zero: a cut every
#: 2**BITS bytes on average, beyond MIN.
WINDOW = 16
BITS = 5
#: Bounds of a chunk's bytes; the last chunk of a text may be shorter.
MIN, MAX = 16, 512
#: Repeated chunks are taken out where they make up a run of at least so many bytes, or a whole
#: text: shorter ones inside a text are common turns of phrase.
MIN_RUN = 64
GEAR = kernel.stream(41, 256).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: the sum of GEAR[byte j back] << j over WINDOW bytes."""
    h = GEAR[data]
    size = 1
    while size < WINDOW:
        more = np.zeros_like(h)
        more[size:] = h[:-size] << np.uint32(size)
        h = h + more
        size *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of all texts of a piece."""
    mask = np.uint32(((1 << BITS) - 1) << (WINDOW - BITS))
    wanted = np.flatnonzero((gear(data) & mask) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    starts: list[int] = []
    ends: list[int] = []
    at = np.searchsorted(wanted, offsets)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        last = lo
        for cut in wanted[at[i] : at[i + 1]].tolist():
            if cut - lo < WINDOW or cut - last < MIN:
                continue
            while cut - last > MAX:
                starts.append(last)
                last += MAX
                ends.append(last)
            if cut - last >= MIN:
                starts.append(last)
                ends.append(cut)
                last = cut
        while hi > last:
            starts.append(last)
            last = min(last + MAX, hi)
            ends.append(last)
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


ROWS = "k1 long, k2 long, c1 long, c2 long, start long, size int, sha binary, chunks long"


def _chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The chunks of every text, and one row without digest for the text itself: start is its
    size, sha its digest."""
    n = batch.num_rows
    sizes, many = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    sha, docs, starts, lengths, digests = [], [], [], [], []
    for begin, end, data, offsets in kernel.slices(batch.column(2)):
        sizes[begin:end] = np.diff(offsets)
        raw = data.tobytes()
        sha += [hashlib.sha256(raw[lo:hi]).digest() for lo, hi in zip(offsets[:-1], offsets[1:])]
        start, stop = cuts(data, offsets)
        doc = np.searchsorted(offsets, start, side="right") - 1
        many[begin:end] = np.bincount(doc, minlength=end - begin)
        digests += [hashlib.blake2b(raw[lo:hi], digest_size=16).digest() for lo, hi in zip(start.tolist(), stop.tolist())]
        docs.append(doc + begin)
        starts.append(start - offsets[doc])
        lengths.append(stop - start)
    doc, start, length = (np.concatenate(x) for x in (docs, starts, lengths))
    c = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    m = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((k1[doc], k1))),
            pa.array(np.concatenate((k2[doc], k2))),
            pa.concat_arrays([pa.array(np.ascontiguousarray(c[:, 0])), pa.nulls(n, pa.int64())]),
            pa.concat_arrays([pa.array(np.ascontiguousarray(c[:, 1])), pa.nulls(n, pa.int64())]),
            pa.array(np.concatenate((start, sizes))),
            pa.array(np.concatenate((length, np.zeros(n, np.int64))).astype(np.int32)),
            pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(sha, pa.binary())]),
            pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(many)]),
        ],
        names=["k1", "k2", "c1", "c2", "start", "size", "sha", "chunks"],
    )


def _remove(min_run: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, many, kept, whole = [], [], [], []
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py().encode()
            start, size = (f.to_numpy() for f in batch.column(3)[i].values.flatten())
            order = np.argsort(start, kind="stable")
            start, end = start[order], (start + size)[order]
            new = np.concatenate(([True], start[1:] != end[:-1]))
            lo, hi = start[new], end[np.concatenate((new[1:], [True]))]
            long = (hi - lo >= min_run) | (hi - lo == len(text))
            out, at = [], 0
            for a, b in zip(lo[long].tolist(), hi[long].tolist()):
                out.append(text[at:a])
                at = b
            out.append(text[at:])
            removed.append(int((hi - lo)[long].sum()))
            many.append(int(long.sum()))
            kept.append(b"".join(out))
            whole.append(int((hi - lo).sum()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())],
            names=["k1", "k2", "n_repeated", "n_removed", "n_spans", "kept"],
        )

    return run


def remove_repeats(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", name: str = "chunks") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, changed, shared): all texts with their sizes; those that have repeated chunks,
    with the bytes they keep; and how much of each text occurs elsewhere and where first."""
    rows = keyed(docs, id_col, text_col)
    every = materialize(batched(rows, _chunk, ROWS), f"{name}-all")
    texts = every.filter("c1 is null").select("k1", "k2", F.col("start").alias("n_bytes"), "sha", F.col("chunks").alias("n_chunks"))
    texts = materialize(texts, f"{name}-texts")
    chunks = every.filter("c1 is not null").select("k1", "k2", "c1", "c2", "start", "size")
    often = chunks.groupBy("c1").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("c1")
    # A table of its own, so that the join's sides are plain and a hot chunk can be split.
    often = materialize(often, f"{name}-often")
    shared = materialize(chunks.join(often, "c1"), f"{name}-shared")
    discard(often, every)
    first = shared.groupBy("c1", "c2").agg(
        F.min(F.struct("k1", "k2", "start")).alias("f"), F.max(F.struct("k1", "k2", "start")).alias("l")
    )
    first = first.filter("f <> l").select("c1", "c2", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"), F.col("f.start").alias("fs"))
    first = materialize(first, f"{name}-first")
    found = materialize(shared.join(first, ["c1", "c2"]), f"{name}-found")
    discard(shared, first)
    where = found.groupBy("k1", "k2").agg(F.sum("size").alias("n_shared"), F.min("f1").alias("f1"))
    where = materialize(where, f"{name}-where")
    again = found.filter("k1 <> f1 or k2 <> f2 or start <> fs")
    entry = F.struct("start", F.col("size").cast("long").alias("size"))
    lists = materialize(again.groupBy("k1", "k2").agg(F.collect_set(entry).alias("es")), f"{name}-lists")
    discard(found)
    changed = batched(
        with_text(rows, lists).select("k1", "k2", "text", "es"),
        _remove(min_run),
        "k1 long, k2 long, n_repeated long, n_removed long, n_spans long, kept binary",
    )
    return texts, changed, where


def deduplicate(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", name: str = "chunks") -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_shared, n_repeated, n_removed, n_spans, first_doc_id,
    kept_sha256) for every row of ``docs``.

    ``n_shared`` counts bytes in chunks that occur more than once, ``n_repeated`` those that
    stood earlier, ``n_removed`` those taken out, in runs of ``min_run`` bytes or more and in
    shorter texts of nothing but repeated chunks; ``first_doc_id`` is the least document that
    a chunk of this one stands in.  Null texts are empty and have no chunks.  Rows equal in
    doc_id and text count as one document; a row without doc_id comes first in order.  Other
    columns are ignored; an empty table gives an empty result.
    """
    texts, changed, where = remove_repeats(docs, min_run, id_col, text_col, name)
    digests = changed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept").dropDuplicates(["k1", "k2"])
    digests = materialize(digests, f"{name}-kept")
    # Equal rows repeat each of their chunks once per row.
    copies = texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    where = where.join(copies, ["k1", "k2"]).withColumn("n_shared", (F.col("n_shared") / F.col("rows")).cast("long")).drop("rows")
    zero = F.lit(0).cast("long")
    return texts.join(where, ["k1", "k2"], "left").join(digests, ["k1", "k2"], "left").select(
        F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id"),
        "n_bytes",
        "n_chunks",
        *[F.coalesce(c, zero).alias(c) for c in ("n_shared", "n_repeated", "n_removed", "n_spans")],
        F.when(F.col("f1") != NO_ID, F.col("f1")).alias("first_doc_id"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated chunks of all documents, taken out."""
    return deduplicate(table(spark, sf_dir, "documents"))
