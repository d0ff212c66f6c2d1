"""Near-duplicate texts: MinHash with tensored banding, verified on full shingle sets.

Two collections of ``M`` sub-keys (``A`` minhashes each) are computed.  The key of table
(i, j) pairs sub-key i of the first with sub-key j of the second, so M * M tables cost only
2 * M * A minhashes.  Two texts of similarity s meet in a table unless one collection has no
agreeing sub-key: probability at most 2 * (1 - s**A)**M, which is 1.9e-5 at s = 0.75 for the
defaults.

Copies (equal sets) are one class.  The tables (i, i) come first: the classes of a bucket are
compared with its least one, which joins most groups of near copies.  The other tables matter
only where a bucket still holds two components, so they are not written out for all: a class
stays in question while sub-keys of both collections are shared with another component.  Such
classes are compared with the one of each group that has the fewest shingles of its own, and
what is then still apart is compared by blocks, where a pair is judged if it meets in any
table.  A group's largest component is compared with the rest and never with itself, so no
group of near copies is expanded into pairs, and only links come out of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import NARROW_ROWS, arrow_limits, batched, discard, materialize, narrow, table
from .components import stars

M = 14
A = 2
WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Classes and shingles of a block, and shingles of a piece, when groups are compared by blocks.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
PIECE = 4096
#: A group of one sub-key whose rest fills more blocks than this is cut by the second collection.
CUT = 8
U64 = np.uint64


def shingle_sets(column: pa.Array, k: int = WORDS):
    """Per slice of a text column: (first row, sorted distinct 64-bit shingle hashes of all
    its rows one after another, offsets)."""
    for first, end, data, offsets in kernel.slices(column):
        data = kernel.LOWER[data]
        starts, ends, at = kernel.word_spans(data, offsets)
        words = kernel.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, U64)
        # Mixed after each word, so that sums of hashes mean nothing.
        grams = np.full(max(len(words) - k + 1, 0), k, dtype=U64)
        for j in range(k if len(grams) else 0):
            grams = kernel.mix(grams ^ words[j : len(words) - k + 1 + j])
        size = np.diff(at)
        few = (size > 0) & (size < k)
        whole = size.astype(U64)
        for j in range(k - 1):
            on = few & (size > j)
            whole[on] = kernel.mix(whole[on] ^ words[at[:-1][on] + j])
        sets = []
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            if hi - lo >= k:
                one = np.sort(grams[lo : hi - k + 1])
                sets.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
            else:
                sets.append(whole[i : i + 1] if few[i] else grams[:0])
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        yield first, np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def _reduce(fn, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """fn.reduceat over non-empty groups; 0 for empty ones."""
    out = np.zeros(len(at) - 1, dtype=values.dtype)
    full = np.diff(at) > 0
    if full.any():
        out[full] = fn.reduceat(values, at[:-1][full])
    return out


SKETCH = "doc_id long, n long, d1 long, d2 long, a array<long>, b array<long>"


def _sketch(m: int, a: int, k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        n, d1, d2 = (np.zeros(rows, dtype=np.int64) for _ in range(3))
        keys = np.zeros((rows, 2 * m), dtype=np.int64)
        for first, sets, at in shingle_sets(batch.column(1), k):
            part = slice(first, first + len(at) - 1)
            n[part] = np.diff(at)
            d1[part] = _reduce(np.add, kernel.mix(sets), at).view(np.int64)
            d2[part] = _reduce(np.add, kernel.mix(sets ^ U64(0x5BF03635)), at).view(np.int64)
            keys[part] = _sub_keys(sets, at, m, a)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(d1), pa.array(d2), _lists(keys[:, :m]), _lists(keys[:, m:])],
            names=["doc_id", "n", "d1", "d2", "a", "b"],
        )

    return run


def _sub_keys(sets: np.ndarray, at: np.ndarray, m: int, a: int) -> np.ndarray:
    """The 2 * m sub-keys of each set, first collection first."""
    hashes = 2 * m * a
    factor = kernel.stream(21, hashes) | U64(1)
    shift = kernel.stream(22, hashes)
    keys = np.zeros((len(at) - 1, 2 * m), dtype=np.int64)
    for i in range(2 * m):
        key = np.zeros(len(at) - 1, dtype=U64)
        for j in range(i * a, i * a + a):
            least = _reduce(np.minimum, sets * factor[j] + shift[j], at)
            key = kernel.mix(key + least + U64(j + 1))
        keys[:, i] = key.view(np.int64)
    return keys


def _lists(rows: np.ndarray) -> pa.Array:
    step = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(step), pa.array(np.ascontiguousarray(rows).ravel()))


def _sets(m: int, a: int, k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, keys = [], np.zeros((batch.num_rows, 2 * m), dtype=np.int64)
        for first, sets, at in shingle_sets(batch.column(1), k):
            out += [sets[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])]
            keys[first : first + len(at) - 1] = _sub_keys(sets, at, m, a)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.binary()), _lists(keys[:, :m]), _lists(keys[:, m:])],
            names=["doc_id", "s", "a", "b"],
        )

    return run


def _confirm(percent: int):
    """Links among candidate rows (x, y, sx, sy), judged on whole sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs, ys = batch.column(2), batch.column(3)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x = np.frombuffer(xs[i].as_buffer(), dtype=U64)
            y = np.frombuffer(ys[i].as_buffer(), dtype=U64)
            if len(x) > len(y):
                x, y = y, x
            if not len(x):
                continue
            where = np.searchsorted(y, x)
            where[where == len(y)] = 0
            both = int(np.count_nonzero(y[where] == x))
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keep)], names=["x", "y", "linked"]
        )

    return run


def _sent(df: DataFrame, most: int, name: str) -> DataFrame:
    """``df`` as the small side of a join.  It has at most ``most`` rows: if so many may be
    broadcast, it is neither stored nor counted before."""
    if most <= NARROW_ROWS:
        return F.broadcast(df)
    kept = materialize(df, name)
    side = narrow(kept)
    side._stored_at = kept._stored_at
    return side


def _ids(reps: DataFrame, most: int, name: str) -> DataFrame:
    """The right side of a semi join, where repeated ids do no harm while they are few."""
    return _sent(reps if most <= NARROW_ROWS else reps.distinct(), most, name)


def _star(classes: DataFrame, most: int, percent: int, name: str) -> DataFrame:
    """(x, y): every class of a bucket of the tables (i, i) with the bucket's least class, if
    their sizes allow a link; there are at most ``most`` buckets of several."""
    both = F.arrays_zip("a", "b")
    rows = classes.select("rep", "n", F.posexplode(both).alias("i", "p")).select(
        F.xxhash64("i", "p.a", "p.b").alias("key"), "rep", "n"
    )
    least = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("x"), F.min_by("n", "rep").alias("x_n"))
    # If it is large, a table of its own, so that the join's sides are plain and a hot bucket can be split.
    least = _sent(least.filter("c > 1").select("key", "x", "x_n"), most, f"{name}-least")
    met = rows.join(least, "key").filter(f"rep <> x and 100 * x_n >= {percent} * n and 100 * n >= {percent} * x_n")
    return met.select("x", F.col("rep").alias("y")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y, linked) for candidate pairs (x, y), for each of the texts of x and y."""
    loaded = (
        pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x")
        .join(sets.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y")
        .select("x", "y", "sx", "sy")
    )
    return batched(loaded, _confirm(percent), "x long, y long, linked boolean")


def _parted(reps: DataFrame, found: DataFrame) -> DataFrame:
    """``reps`` with the component of each, as ``part``; ``found`` holds those of other nodes than its least."""
    nodes = found.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    return reps.join(narrow(nodes), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")


def _lifted(links: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` and ``links`` (u, v), each between the components of its ends."""
    for end in ("u", "v"):
        to = narrow(found.select(F.col("u").alias(end), F.col("v").alias("to")))
        links = links.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return found.select("u", "v").union(links.select("u", "v"))


def _mixed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows of the sub-keys (i, k) that more than one component has, at most ``most`` sub-keys."""
    several = rows.groupBy("i", "k").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 < p1")
    return materialize(rows.join(_sent(several.select("i", "k"), most, f"{name}-several"), ["i", "k"]), f"{name}-mixed")


def _open(classes: DataFrame, n: int, m: int, found: DataFrame, name: str) -> DataFrame:
    """(rep, n, part, i, k): the sub-keys of the first collection that another component
    shares, of the classes that share one of the second collection too.  There are ``n``
    classes with ``m`` sub-keys of either collection."""
    placed = _parted(classes.select("rep", "n", "a", "b"), found)
    first = _mixed(placed.select("rep", "n", "part", F.posexplode("a").alias("i", "k")), n * m // 2, name)
    rows = first.count()
    some = _ids(first.select("rep"), rows, f"{name}-some")
    second = _mixed(
        placed.join(some, "rep", "left_semi").select("rep", "part", F.posexplode("b").alias("i", "k")), min(n, rows) * m // 2, name
    )
    both = _ids(second.select("rep"), second.count(), f"{name}-some")
    out = _mixed(first.join(both, "rep", "left_semi"), rows // 2, name)
    discard(first, some, second, both)
    return out


def _tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
    ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["rep", "t"])


def _lone(sets: DataFrame) -> DataFrame:
    """(rep, u): how many shingles of a class no other class of ``sets`` has."""
    tokens = batched(sets.select("doc_id", "s"), _tokens, "rep long, t long")
    once = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).filter("c = 1")
    return once.groupBy("rep").agg(F.count(F.lit(1)).alias("u"))


def _hopeful(open_: DataFrame, most: int, percent: int, name: str) -> DataFrame:
    """Of ``most`` open rows those of classes that can still link with a class of the sizes in
    their groups."""
    least = _sent(open_.groupBy("i", "k").agg(F.min("n_min").alias("s")), most, f"{name}-sizes")
    per_rep = _sent(open_.join(least, ["i", "k"]).groupBy("rep").agg(F.min("s").alias("s")), most, f"{name}-sizes")
    both = "(n_max - u)"
    possible = f"100 * {both} >= {percent} * (n_min + greatest(s, {both}) - {both})"
    return open_.join(per_rep, "rep").filter(f"texts > 1 or {possible}").drop("s")


def _bound(percent: int) -> str:
    """What sizes and lone shingles say of a pair: false only where no link is possible."""
    both = "least(n_max - u, y_n_max - y_u)"
    return (
        f"100 * n_max >= {percent} * y_n_min and 100 * y_n_max >= {percent} * n_min"
        f" and 100 * {both} >= {percent} * (n_min + y_n_min - {both})"
    )


def _intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every x with every y, by products of 0/1 matrices over
    pieces of the shingles that occur on both sides."""
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    flat_x, flat_y = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(flat_x, flat_y)
    row_x = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    row_y = np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    for lo in range(0, len(both), PIECE):
        piece = both[lo : lo + PIECE]
        sides = []
        for flat, row, n in ((flat_x, row_x, len(xs)), (flat_y, row_y, len(ys))):
            at = np.searchsorted(piece, flat)
            at[at == len(piece)] = 0
            hit = piece[at] == flat
            side = np.zeros((n, len(piece)), dtype=np.float32)
            side[row[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _block_links(i: int, j: int, same: bool, rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links within one block, or between two, of the classes that agree on sub-key i.

    Rows are (rep, part, first block, set, a, b).  A pair is judged where its first common
    sub-key of the first collection is the i-th, and only if it has one of the second too:
    the j-th as the first, where the group was cut by it.
    """
    xs = rows if same else [r for r in rows if r[2]]
    ys = rows if same else [r for r in rows if not r[2]]
    if not xs or not ys:
        return []
    ax, ay = np.array([r[4] for r in xs]), np.array([r[4] for r in ys])
    bx, by = np.array([r[5] for r in xs]), np.array([r[5] for r in ys])
    rep_x, rep_y = np.array([r[0] for r in xs]), np.array([r[0] for r in ys])
    nx, ny = np.array([len(r[3]) for r in xs]), np.array([len(r[3]) for r in ys])
    ask = np.array([r[1] for r in xs])[:, None] != np.array([r[1] for r in ys])[None, :]
    ask &= 100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :])
    if same:
        ask &= rep_x[:, None] < rep_y[None, :]
    for t in range(i):
        ask &= ax[:, t][:, None] != ay[:, t][None, :]
    if not ask.any():
        return []
    meet = np.zeros_like(ask)
    for t in range(j + 1 if j >= 0 else bx.shape[1]):
        equal = bx[:, t][:, None] == by[:, t][None, :]
        meet = equal & ~meet if t == j else meet | equal
    ask &= meet
    in_x, in_y = np.flatnonzero(ask.any(1)), np.flatnonzero(ask.any(0))
    if not len(in_x):
        return []
    sx, sy = [xs[q][3] for q in in_x], [ys[q][3] for q in in_y]
    both = _intersections(sx, sy).astype(np.int64)
    either = nx[in_x][:, None] + ny[in_y][None, :] - both
    linked = ask[np.ix_(in_x, in_y)] & (100 * both >= percent * either) & (both > 0)
    return [(int(rep_x[in_x[p]]), int(rep_y[in_y[q]])) for p, q in zip(*np.nonzero(linked))]


def _judge_blocks(percent: int):
    """Streams rows sorted by block pair; holds one block pair at a time."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in range(6)]
            rep, part, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in (6, 7, 8))
            a, b = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in (10, 11))
            found = []
            for q in range(batch.num_rows):
                now = tuple(int(x[q]) for x in names)
                if now != key:
                    if held:
                        found += _block_links(key[0], key[2], key[4] == key[5], held, percent)
                    held, key = [], now
                s = np.frombuffer(batch.column(9)[q].as_py(), dtype=U64)
                held.append((int(rep[q]), int(part[q]), bool(first[q]), s, a[q].copy(), b[q].copy()))
            if found:
                yield _pairs(found)
        if held and (found := _block_links(key[0], key[2], key[4] == key[5], held, percent)):
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(found, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["u", "v"])


GROUP = ["i", "k", "j", "l"]


def _groups(members: DataFrame, block: int, name: str) -> DataFrame:
    """Groups of several components: their largest one (``main``) and how many blocks that
    one (``d``) and the rest (``r``) are dealt into."""
    parts = members.groupBy(*GROUP, "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    groups = parts.groupBy(*GROUP).agg(
        F.max(F.struct("c", "w", "part")).alias("m"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("parts")
    )

    def blocks(c: str, w: str):
        return F.expr(f"cast(ceil(greatest(({c}) / {block}, ({w}) / {BLOCK_SHINGLES})) as int)")

    return materialize(
        groups.filter("parts > 1").select(
            *GROUP, F.col("m.part").alias("main"), blocks("c - m.c", "w - m.w").alias("r"), blocks("m.c", "m.w").alias("d")
        ),
        f"{name}-groups",
    )


def _dealt(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members under every block pair that they are part of: blocks of the rest come first
    and meet each other and those of the main component, which do not meet each other."""
    main = F.col("part") == F.col("main")
    spread = F.xxhash64("rep", "i")
    block = F.when(main, F.col("r") + F.pmod(spread, F.col("d"))).otherwise(F.pmod(spread, F.col("r"))).cast("int")
    last = F.when(main, F.col("r") - 1).otherwise(F.col("r") + F.col("d") - 1)
    return (
        members.join(narrow(groups), GROUP)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(
            *GROUP, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
            "rep", "part", (F.col("block") <= F.col("other")).alias("first"),
        )
    )


def _blocked(
    open_: DataFrame, sets: DataFrame, percent: int, name: str, block: int = BLOCK, cut: int = CUT, once: bool = False
) -> DataFrame:
    """Links (u, v) among open classes in different components; ``once``: every class has one
    text, and so is there once under a sub-key.

    The classes that agree on a sub-key of the first collection are a group; a large one is
    cut by the sub-keys of the second.  A group's largest component is dealt into blocks, and
    so is the rest, by the hash of their ids.  Every block of the rest is compared with every
    other block, so a task never holds more than two blocks of a group, a set is sent once for
    each block of the rest, and only links come out.
    """
    members = open_ if once else open_.groupBy("i", "k", "rep", "part").agg(F.max("n").alias("n"))
    members = members.select("i", "k", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("l"), "rep", "part", "n")
    if not once:
        members = materialize(members, f"{name}-members")
    groups = _groups(members, block, name)
    large = groups.filter(f"r > {cut}").select("i", "k")
    tasks = _dealt(members, groups.filter(f"r <= {cut}"))
    if large.count():
        keys = sets.select(F.col("doc_id").alias("rep"), F.posexplode("b").alias("j", "l"))
        pieces = members.drop("j", "l").join(large, ["i", "k"]).join(keys, "rep").select(*GROUP, "rep", "part", "n").distinct()
        pieces = materialize(pieces, f"{name}-pieces")
        tasks = tasks.unionByName(_dealt(pieces, _groups(pieces, block, name)))
    mine = sets.withColumnRenamed("doc_id", "rep")
    rows = tasks.join(mine, "rep").select(*GROUP, "p", "q", "rep", "part", "first", "s", "a", "b")
    arrow_limits(open_.sparkSession)
    links = (
        rows.repartition(*GROUP, "p", "q")
        .sortWithinPartitions(*GROUP, "p", "q")
        .mapInArrow(_judge_blocks(percent), "u long, v long")
    )
    return links if once else links.distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    k: int = WORDS,
    m: int = M,
    a: int = A,
    name: str = "minhash",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A text's set is its distinct k-word shingles (A-Z lower-cased, words are runs of
    non-spaces); a shorter text is one shingle; an empty or null text has no shingle and no
    link.  Rows that share a doc_id count as one document with several texts.  A row without
    doc_id links with nothing: its component is null and it is kept.  Other columns are
    ignored, whatever they are called.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(batched(docs, _sketch(m, a, k), SKETCH), f"{name}-sketch")
    classes = (
        sketch.filter("n > 0 and doc_id is not null")
        .groupBy("n", "d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"))
    )
    classes = materialize(classes, f"{name}-classes")
    n = classes.count()
    # Only where documents have several texts, a class or a component is more than one text's.
    again = sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    once = again.count() == 0

    def sized(rows: DataFrame) -> DataFrame:
        if once:
            return rows.withColumns({"n_min": F.col("n"), "n_max": F.col("n"), "texts": F.lit(1)})
        # A rep that stands for several classes is there with each size.
        sizes = classes.groupBy("rep").agg(
            F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count(F.lit(1)).alias("texts")
        )
        return rows.join(sizes, "rep")

    def sets_of(reps: DataFrame, most: int) -> DataFrame:
        ids = _ids(reps.select(F.col("rep").alias("doc_id")), most, f"{name}-met")
        schema = "doc_id long, s binary, a array<long>, b array<long>"
        out = materialize(batched(docs.join(ids, "doc_id", "left_semi"), _sets(m, a, k), schema), f"{name}-sets")
        discard(ids)
        return out

    # The tables (i, i): every class of a bucket with the bucket's least class.
    star = materialize(_star(classes, n * m // 2, percent, name), f"{name}-pairs")
    sets = sets_of(star.select(F.explode(F.array("x", "y")).alias("rep")), 2 * star.count())
    first = judged = materialize(_verify(star, sets, percent), f"{name}-star")
    links = judged.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    found = stars(links, f"{name}-parts")
    discard(star, sets)

    # All tables: classes that still share sub-keys of both collections with other components.
    # A shingle that no other class in question has can be in no intersection, which bounds
    # what a class can link with; most are settled by that, without a pair.
    met = _open(classes, n, m, found, f"{name}-open")
    rows = met.count()
    sets = sets_of(met, rows)
    lone = _sent(_lone(sets), min(n, rows), f"{name}-lone")
    # Of a rep that stands for several texts nothing is known.
    alone = F.when(F.col("texts") == 1, F.coalesce("u", F.lit(0))).otherwise(F.lit(0))
    placed = materialize(sized(met.join(lone, "rep", "left")).withColumn("u", alone), f"{name}-placed")
    able = materialize(_hopeful(placed, rows, percent, name), f"{name}-able")
    hopeful = _mixed(able, rows // 2, f"{name}-hopeful")
    discard(met, lone, placed, able)
    # A second star, around the class of each group with the fewest shingles of its own.
    rows = hopeful.count()
    core = hopeful.groupBy("i", "k").agg(F.min(F.struct("u", "rep", "n_min", "n_max", "part")).alias("c"))
    core = core.select("i", "k", *[F.col(f"c.{c}").alias(f"y_{c}") for c in ("rep", "u", "n_min", "n_max", "part")])
    core = _sent(core, rows // 2, f"{name}-core")
    star = hopeful.join(core, ["i", "k"]).filter(f"part <> y_part and {_bound(percent)}")
    star = star.select(F.least("rep", "y_rep").alias("x"), F.greatest("rep", "y_rep").alias("y")).distinct()
    star = materialize(star.join(narrow(judged.select("x", "y")), ["x", "y"], "left_anti"), f"{name}-pairs")
    second = materialize(_verify(star, sets, percent), f"{name}-star")
    links = second.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    before, found = found, stars(_lifted(links, found), f"{name}-parts")
    discard(before)
    # Then the classes still apart, with those of their groups' other components, by blocks.
    open_ = _mixed(_parted(hopeful.drop("part"), found), rows // 2, f"{name}-open")
    more = materialize(_blocked(open_, sets, percent, name, once=once), f"{name}-rest")
    discard(hopeful, core, star, open_, sets)
    links = more
    if not once:
        same = (
            sketch.select("doc_id", "n", "d1", "d2")
            .join(again, "doc_id")
            .join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
            .select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        )
        links = more.union(same)
    before, found = found, stars(_lifted(links, found), f"{name}-parts")
    discard(before, first, second, more)

    # Copies follow their class.
    ends = found.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    where = classes.select("n", "d1", "d2", "rep").join(ends, "rep", "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    joined = sketch.select("doc_id", "n", "d1", "d2").join(where, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sql(percent: int = PERCENT, k: int = WORDS) -> str:
    """The same by counting the common shingles of all pairs that have any."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, {words} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda s: array_to_string(w[s:s + {k - 1}], ' '))) AS g
  FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * m >= {percent} * (p.n + q.n - m)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.y FROM reach JOIN links ON links.x = reach.r),
parts AS (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN parts USING (doc_id)"""
