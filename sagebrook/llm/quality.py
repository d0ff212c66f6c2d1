"""Text quality: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Five families of n-grams are hashed into one space of ``2**BITS`` weights: words, word pairs,
word shapes (case, length, digits, punctuation), shape pairs, and whether a word repeats one
of its last ``BACK`` predecessors.  A feature's value is its share of its family's n-grams, so
a score is one gather and one sum per text, whatever its length.

Training reads at most ``MAX_TRAIN`` labelled rows (those with the least seeded hash of their
doc_id), whole texts each; it runs in one task over rows whose number that parameter bounds.
Scoring covers every row.  The model is ``2**BITS`` doubles (2 MB) at any corpus size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import batched, table

BITS = 18
BACK = 4
#: Bound of the labelled rows used for training.
MAX_TRAIN = 8000
EPOCHS = 3
#: Scores of at least this are predicted as good.
THRESHOLD = 0.3
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
FAMILIES = 5
U64 = np.uint64

_KINDS = np.zeros((4, 256), dtype=np.int64)
_KINDS[0, 65:91] = 1
_KINDS[1, 97:123] = 1
_KINDS[2, 48:58] = 1
_KINDS[3, 33:48] = _KINDS[3, 58:65] = _KINDS[3, 91:97] = _KINDS[3, 123:127] = 1


def features(column: pa.Array, bits: int = BITS):
    """Per slice of a text column: (first row, n-gram indices [family, word], whether each
    counts, first word of each row)."""
    salts = kernel.stream(31, FAMILIES)
    top = U64(64 - bits)
    for first, _, data, offsets in kernel.slices(column):
        starts, ends, at = kernel.word_spans(data, offsets)
        n = len(starts)
        grams = np.zeros((FAMILIES, n), dtype=np.int64)
        valid = np.ones((FAMILIES, n), dtype=bool)
        if n:
            words = kernel.span_hashes(kernel.LOWER[data], starts, ends)
            kinds = []
            for kind in _KINDS:
                sums = np.concatenate(([0], np.cumsum(kind[data])))
                kinds.append(np.minimum(sums[ends] - sums[starts], 3))
            size = np.minimum(np.log2(ends - starts + 1).astype(np.int64), 7)
            code = size
            for kind in kinds:
                code = code * 4 + kind
            shapes = kernel.mix(code.astype(U64) + U64(977))
            follows = np.ones(n, dtype=bool)
            follows[at[:-1][np.diff(at) > 0]] = False
            before = np.arange(n) - 1
            same = np.zeros(n, dtype=np.int64)
            place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
            for d in range(BACK, 0, -1):
                again = np.zeros(n, dtype=bool)
                again[d:] = words[d:] == words[:-d]
                same[again & (place >= d)] = d
            keys = (
                words,
                words * U64(0x9E3779B97F4A7C15) + words[before],
                shapes,
                shapes * U64(0x9E3779B97F4A7C15) + shapes[before],
                kernel.mix(same.astype(U64) * U64(8191) + U64(13)),
            )
            for i, key in enumerate(keys):
                grams[i] = (kernel.mix(key ^ salts[i]) >> top).astype(np.int64)
            valid[1] = valid[3] = follows
        yield first, grams, valid, at


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over (indices, values, label); the last is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2)
            w[np.abs(zi) <= L1] = 0.0
            p = 1.0 / (1.0 + np.exp(-np.clip(np.dot(w, value), -35, 35)))
            g = (p - label) * value
            n[index] = ni + g * g
            z[index] = zi + g - (np.sqrt(n[index]) - root) / ALPHA * w
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0.0
    return w


def _sparse(bits: int):
    """A labelled text as (order, label, indices, values)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, value = [], []
        for _, grams, valid, at in features(batch.column(2), bits):
            for lo, hi in zip(at[:-1], at[1:]):
                ids = [np.array([1 << bits])]
                values = [np.ones(1)]
                for i in range(FAMILIES):
                    one = grams[i, lo:hi][valid[i, lo:hi]]
                    if len(one):
                        seen, often = np.unique(one, return_counts=True)
                        ids.append(seen)
                        values.append(often / len(one))
                ids, where = np.unique(np.concatenate(ids), return_inverse=True)
                index.append(ids)
                value.append(np.bincount(where, weights=np.concatenate(values)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(index, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64()))],
            names=["o", "label", "i", "v"],
        )

    return run


def _fit(bits: int, epochs: int):
    """Trains on all batches of one task, held as a few flat arrays."""

    def run(batches):
        order, labels, sizes, index, value = [], [], [], [], []
        for batch in batches:
            o, label, i, v = batch.columns
            order.append(o.to_numpy().copy())
            labels.append(label.to_numpy().copy())
            sizes.append(np.diff(i.offsets.to_numpy()))
            index.append(i.flatten().to_numpy().astype(np.int32))
            value.append(v.flatten().to_numpy().copy())
        if not order:
            yield pa.RecordBatch.from_arrays([pa.array([np.zeros((1 << bits) + 1).tobytes()], pa.binary())], names=["w"])
            return
        order, labels, sizes, index, value = map(np.concatenate, (order, labels, sizes, index, value))
        at = np.concatenate(([0], np.cumsum(sizes)))
        # Rows of one doc_id and label come in an order that their features alone decide.
        tie = np.array([zlib.crc32(index[lo:hi].tobytes()) for lo, hi in zip(at[:-1], at[1:])])
        by = np.lexsort((tie, sizes, labels, order))
        rows = [(index[at[r] : at[r + 1]], value[at[r] : at[r + 1]], labels[r]) for r in by]
        w = train(rows, bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    return run


def held_out(doc_id="doc_id"):
    """Rows that no label may be learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from labelled, not held-out rows; zeros (score 1/2) without any."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
        .filter("doc_id is not null and label is not null")
        .filter(~held_out())
        .select("doc_id", "label", F.xxhash64("doc_id", F.lit(29)).alias("o"))
        .orderBy("o", "doc_id", "label")
        .limit(max_train)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("o", "label", "text")
    sparse = batched(rows, _sparse(bits), "o long, label double, i array<long>, v array<double>")
    # A doc_id repeated in the table may bring more rows than were chosen.
    sparse = sparse.orderBy("o", "label").limit(max_train)
    out = sparse.coalesce(1).mapInArrow(_fit(bits, epochs), "w binary").collect()
    return np.frombuffer(bytes(out[0]["w"]), dtype=np.float64) if out else np.zeros((1 << bits) + 1)


def score_column(docs: DataFrame, weights: np.ndarray, bits: int, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of docs, none of them named ``score``, and the score of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    picked = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))
    schema = picked.drop("__text").schema.simpleString()[len("struct<") : -1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        out = np.empty(batch.num_rows)
        for first, grams, valid, at in features(batch.column(batch.num_columns - 1), bits):
            total = np.full(len(at) - 1, w[-1])
            for i in range(FAMILIES):
                # Sums by text, which no neighbour in the batch can sway.
                sums = np.zeros(len(at) - 1)
                many = np.zeros(len(at) - 1)
                full = np.diff(at) > 0
                if full.any():
                    sums[full] = np.add.reduceat(w[grams[i]] * valid[i], at[:-1][full])
                    many[full] = np.add.reduceat(valid[i].astype(np.int64), at[:-1][full])
                total += sums / np.maximum(many, 1)
            out[first : first + len(total)] = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(out)], names=[*columns, "score"])

    return batched(picked, run, f"{schema}, score double")


def quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels come only from rows that are not held out; language, source and doc_id are never
    inputs of a score.  Null and empty texts score by the bias alone.  Rows with a null
    doc_id are scored and teach nothing.  Repeated rows get equal scores, other columns are
    ignored, an empty table gives an empty result, and without labels every score is 1/2.
    """
    weights = fit(docs, labels, bits, max_train, epochs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_column(ids, weights, bits, ["doc_id"]).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
