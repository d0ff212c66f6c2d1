"""Near duplicates among vectors: an exact metric range join.

On unit vectors cosine >= c is a Euclidean distance of at most eps = sqrt(2 - 2c).  Pivots,
taken farthest-first from a bounded sample, divide the vectors into cells by the nearest
pivot.  By the triangle inequality a vector y of cell p has a partner in cell q only if
d(y, q) <= d(y, p) + 2 eps, and, as distances are Euclidean, only if it lies within eps of
the plane midway between both pivots; where both hold it is also sent to q.  Of two cells the
one with the smaller number compares, so every pair is judged once.  How many pivots are
used follows from the cost that the sample predicts; that choice alters no result.

Cells join independently.  A cell is compared in pairs of blocks of about BLOCK vectors, and
a task holds two.  It returns sums of links and a spanning forest, not pairs.  Equal vectors
are one class throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, batched, materialize, table
from .components import components

COSINE = 0.9
#: Vectors of a block.
BLOCK = 4096
#: Bound of the sample that pivots come from.
SAMPLE = 2048
PIVOTS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: Rounding allowed for in bounds and in the single-precision screen.
SLACK = 1e-4


def _values(cell: pa.ListScalar) -> np.ndarray | None:
    """A vector's components in double precision, or None where it can link with nothing."""
    if cell is None or not cell.is_valid or cell.values is None or not len(cell.values) or cell.values.null_count:
        return None
    v = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    digest, data = [], []
    for cell in batch.column(1):
        v = _values(cell)
        raw = None if v is None else v.tobytes()
        small = raw is not None and bool((v.astype(np.float32) == v).all())
        packed = None if raw is None else (b"f" + v.astype(np.float32).tobytes() if small else b"d" + raw)
        data.append(packed)
        digest.append(None if raw is None else hashlib.sha256(packed).digest()[:16])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "digest", "v"]
    )


def unpack(cells) -> np.ndarray:
    """Rows of equal length in double precision from their packed bytes."""
    return np.array([np.frombuffer(c, "<f4" if c[:1] == b"f" else "<f8", offset=1).astype(np.float64) for c in cells])


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def homes(u: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and which other, smaller cells it is sent to as well."""
    dots = u @ pivots.T
    home = dots.argmax(axis=1)
    best = dots[np.arange(len(u)), home]
    distance = np.sqrt(np.maximum(2 - 2 * dots, 0))
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))
    near = distance <= np.sqrt(np.maximum(2 - 2 * best, 0))[:, None] + 2 * eps + SLACK
    near &= best[:, None] - dots <= (eps + SLACK) * apart[home]
    near &= np.arange(len(pivots))[None, :] < home[:, None]
    return home, near


def choose_pivots(sample: np.ndarray, n: int, eps: float) -> np.ndarray:
    """Pivots, farthest first, in the number that the sample predicts to cost least."""
    chosen, least = [0], 1 - sample @ sample[0]
    for _ in range(min(PIVOTS[-1], len(sample)) - 1):
        far = int(least.argmax())
        if least[far] <= 1e-9:
            break
        chosen.append(far)
        least = np.minimum(least, 1 - sample @ sample[far])
    best, found = None, sample[:1]
    for p in PIVOTS:
        if p > len(chosen):
            break
        home, near = homes(sample, sample[chosen[:p]], eps)
        share = np.bincount(home, minlength=p) / len(sample)
        pairs = float((share * (share / 2 + near.mean(axis=0))).sum()) * n * n
        sent = float((1 + near.sum(axis=1)).mean()) * n
        blocks = 1 + float(((share + near.mean(axis=0)) ** 2).sum()) * n / BLOCK
        cost = pairs * sample.shape[1] * 1e-10 + sent * blocks * 2e-6
        if best is None or cost < best:
            best, found = cost, sample[chosen[:p]]
    return found


def _cells(pivots: np.ndarray, eps: float):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = [c.as_py() for c in batch.column(2)]
        sizes = np.array([(len(c) - 1) // (4 if c[:1] == b"f" else 8) for c in cells])
        row, cell, home = [], [], []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size == pivots.shape[1]:
                own, near = homes(units(unpack([cells[i] for i in at])), pivots, eps)
                r, q = np.nonzero(near)
                row += [at, at[r]]
                cell += [own, q]
                home += [np.ones(len(at), bool), np.zeros(len(r), bool)]
            else:
                row.append(at)
                cell.append(np.zeros(len(at), np.int64))
                home.append(np.ones(len(at), bool))
        row = np.concatenate(row)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(sizes[row].astype(np.int64)),
                pa.array(np.concatenate(cell).astype(np.int64)),
                pa.array(np.concatenate(home)),
                batch.column(0).take(take),
                batch.column(1).take(take),
                batch.column(2).take(take),
                batch.column(3).take(take),
            ],
            names=["dim", "cell", "home", "rep", "many", "v", "tie"],
        )

    return run


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least index connected with each of n nodes by links (p, q)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            return label


TILE = 512


def _compare(same: bool, rows: list[tuple], cosine: float):
    """(u, v, links, tie) rows of one block pair: sums of links (v null) of the class (u, tie),
    and forest edges."""
    first = np.array([r[0] for r in rows])
    home = np.array([r[1] for r in rows])
    rep = np.array([r[2] for r in rows])
    many = np.array([r[3] for r in rows])
    exact = unpack([r[4] for r in rows])
    tie = np.array([r[5] for r in rows])
    exact /= np.abs(exact).max(axis=1, keepdims=True)
    norm = np.linalg.norm(exact, axis=1)
    quick = (exact / norm[:, None]).astype(np.float32)
    xs = np.arange(len(rows)) if same else np.flatnonzero(first)
    ys = xs if same else np.flatnonzero(~first)
    ps, qs = [], []
    for a in range(0, len(xs), TILE):
        x = xs[a : a + TILE]
        for b in range(a if same else 0, len(ys), TILE):
            y = ys[b : b + TILE]
            p, q = np.nonzero(quick[x] @ quick[y].T >= cosine - SLACK)
            p, q = x[p], y[q]
            ok = home[p] | home[q]
            if same:
                ok &= p < q
            p, q = p[ok], q[ok]
            dots = np.einsum("ij,ij->i", exact[p], exact[q]) / (norm[p] * norm[q]) if len(p) else np.zeros(0)
            ok = dots >= cosine
            ps.append(p[ok])
            qs.append(q[ok])
    p, q = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (ps, qs))
    if not len(p):
        return None
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, p, many[q])
    np.add.at(links, q, many[p])
    label = _forest(len(rows), p, q)
    some = np.flatnonzero(links)
    hung = np.flatnonzero(label != np.arange(len(rows)))
    u = np.concatenate((rep[some], rep[hung]))
    v = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[label[hung]], pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(u), v, pa.array(np.concatenate((links[some], hung * 0))), pa.array(np.concatenate((tie[some], tie[hung])))],
        names=["u", "v", "links", "tie"],
    )


def _join(cosine: float):
    """Streams rows sorted by block pair; holds one block pair at a time."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in range(4)]
            columns = [batch.column(c).to_pylist() for c in range(4, 10)]
            for i in range(batch.num_rows):
                now = tuple(int(x[i]) for x in names)
                if now != key:
                    if held and (out := _compare(key[2] == key[3], held, cosine)) is not None:
                        yield out
                    held, key = [], now
                held.append(tuple(c[i] for c in columns))
        if held and (out := _compare(key[2] == key[3], held, cosine)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", name: str = "vectors") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Null, empty and zero vectors and those with null or non-finite components link with
    nothing, and so do rows without a vec_id (component null, kept) and vectors of different
    lengths.  Repeated rows are vectors of their own that link with each other.  Different
    vectors of one vec_id count their own links and share its component.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col))
    read = materialize(batched(rows, _read, "vec_id long, digest binary, v binary"), f"{name}-rows")
    able = read.filter("digest is not null and vec_id is not null")
    classes = able.groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v")
    )
    classes = materialize(classes, f"{name}-classes")
    n = classes.count()
    # The sample is the same in every run: least hashes of the digest.
    sample = classes.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("v").collect()
    packed = [bytes(r["v"]) for r in sample]
    sizes = [len(c) if c[:1] == b"d" else 2 * len(c) - 1 for c in packed]
    usual = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    chosen = unpack([c for c, s in zip(packed, sizes) if s == usual]) if sizes else np.ones((1, 1))
    pivots = choose_pivots(units(chosen), n, eps)

    # Rows of one vec_id may hold several vectors, so a rep may stand for several classes: one
    # node of the components, but each with links of its own, told apart by ``tie``.
    tied = classes.select("rep", "many", "v", F.xxhash64("digest").alias("tie"))
    celled = batched(tied, _cells(pivots, eps), "dim long, cell long, home boolean, rep long, many long, v binary, tie long")
    celled = materialize(celled, f"{name}-cells")
    counts = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int")
    tasks = (
        celled.join(F.broadcast(counts) if len(pivots) * len(set(sizes)) <= 10_000 else counts, ["dim", "cell"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "dim", "cell", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
            (F.col("block") <= F.col("other")).alias("first"), "home", "rep", "many", "v", "tie",
        )
    )
    arrow_limits(spark)
    judged = (
        tasks.repartition("dim", "cell", "p", "q")
        .sortWithinPartitions("dim", "cell", "p", "q")
        .mapInArrow(_join(cosine), "u long, v long, links long, tie long")
    )
    judged = materialize(judged, f"{name}-judged")
    links = judged.filter("v is null").groupBy(F.col("u").alias("rep"), "tie").agg(F.sum("links").alias("links"))
    again = able.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    same = able.join(again, "vec_id").join(classes.select("digest", "rep"), "digest").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    parts = components(judged.filter("v is not null").select("u", "v").union(same), f"{name}-parts")
    where = (
        classes.select("digest", "rep", "many", F.xxhash64("digest").alias("tie"))
        .join(links, ["rep", "tie"], "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    joined = read.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(where, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_sql(cosine: float = COSINE) -> str:
    """The same by comparing all pairs."""
    return f"""WITH RECURSIVE able AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {cosine}),
many AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, links.y FROM reach JOIN links ON links.x = reach.r),
parts AS (SELECT v AS vec_id, min(r) AS component_id FROM reach GROUP BY v)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN many USING (vec_id) JOIN parts USING (vec_id)"""
