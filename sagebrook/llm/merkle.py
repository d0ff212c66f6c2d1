"""A Merkle manifest of a data set: one tree of arity 16 a source, one over the sources' roots.

Leaves are numbered by a range sort, whatever the size of a source, and cut into aligned blocks of
16**3.  A block is one row.  Going up, every block becomes its root and the roots are blocks again
until a source has one node left.  Going down, each block walks over its leaves in order: stacks
of tree hashes run ahead of the walk, each by one run of its own level, so that the siblings of the
next leaf are ready when it comes and a level holds two runs and its stacks, no more.  To what the
block finds the shared path above it is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, discard, materialize, narrow, table
from .crc import crc32_sql

ARITY = 16
#: Levels of a block, which so has up to 4096 leaves.
DEPTH = 3
#: The fields of a document that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one batch of proofs: some 5 KB each.
PROOFS = 256

_HEX = 64
_STEP = "array<struct<left:string,right:string>>"


def _node(run: Sequence[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above ``leaves`` leaves until one node remains."""
    levels, width = 0, 1
    while width < leaves:
        levels, width = levels + 1, width * ARITY
    return levels


class TreeHash:
    """The nodes of one level, from leaves that are pushed in order; below it a stack of less than
    16 nodes a level."""

    def __init__(self, level: int) -> None:
        self.stacks: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def push(self, node: str) -> None:
        for stack in self.stacks:
            stack.append(node)
            if len(stack) < ARITY:
                return
            node = _node(stack)
            stack.clear()
        self.nodes.append(node)

    def end(self) -> None:
        """No leaf follows: short runs become nodes too."""
        node = None
        for stack in self.stacks:
            if node is not None:
                stack.append(node)
            node = _node(stack) if stack else None
            stack.clear()
        if node is not None:
            self.nodes.append(node)


def block_root(leaves: Sequence[str], levels: int) -> str:
    tree = TreeHash(levels)
    for leaf in leaves:
        tree.push(leaf)
    if levels:
        tree.end()
    return tree.nodes[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block its siblings, level by level: what stands left of its own node in
    the run, and what stands right of it, each concatenated.

    At level h a run covers 16**(h + 1) leaves.  While the walk is inside one run, a tree hash takes
    one leaf of the next run a step, and has finished that run when the walk gets there.
    """
    n, spans = len(leaves), [ARITY ** (h + 1) for h in range(levels)]

    def advance(tree: TreeHash, at: int) -> None:
        tree.push(leaves[at])
        if at == n - 1:
            tree.end()

    runs = []
    for h, span in enumerate(spans):
        first = TreeHash(h)
        for at in range(min(span, n)):
            advance(first, at)
        runs.append("".join(first.nodes))
    ahead = [TreeHash(h) for h in range(levels)]
    for i in range(n):
        for h, span in enumerate(spans):
            if i and i % span == 0:
                runs[h] = "".join(ahead[h].nodes)
                ahead[h] = TreeHash(h)
        path = []
        for h, run in enumerate(runs):
            at = i // ARITY**h % ARITY * _HEX
            path.append((run[:at], run[at + _HEX :]))
        yield path
        for h, span in enumerate(spans):
            if i + span < n:
                advance(ahead[h], i + span)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from left to right and from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with pos and size: the place among all rows of the same ``tree``, from 0, in
    ``order``, nulls first, and how many there are.

    Rows are range-sorted over all trees, so that one tree is spread over as many tasks as it has
    rows for, and stored with their place; only (tree, task) rows are counted and summed.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), f"{name}-ranged")
    task = F.shiftright("at", 33)
    parts = ranged.groupBy("tree", task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        F.col("tree").alias("tree_"),
        F.col("task").alias("task_"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(tree).alias("size"),
    )
    parts = materialize(parts, f"{name}-parts")
    same = F.col("tree").eqNullSafe(F.col("tree_")) & (task == F.col("task_"))
    return ranged.join(narrow(parts), same).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "tree_", "task_", "shift")


def _blocks(nodes: DataFrame, items: Sequence[str], depth: int, name: str) -> DataFrame:
    """The stored blocks (tree, block, height, nodes) of (tree, pos, height, digest, *items): at
    most 16**depth nodes in a row, in order."""
    one = F.struct("pos", "digest", *items)
    rows = nodes.groupBy("tree", F.expr(f"pos div {ARITY**depth}").alias("block"), "height").agg(
        F.array_sort(F.collect_list(one)).alias("nodes")
    )
    return materialize(rows, name)


def _root(depth: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        heights = batch.column(2).to_pylist()
        levels = [min(depth, h) for h in heights]
        roots = [block_root(d, k) for d, k in zip(batch.column(3).to_pylist(), levels)]
        left = [h - k for h, k in zip(heights, levels)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(left, pa.int32()), pa.array(roots, pa.string())],
            names=["tree", "pos", "height", "digest"],
        )

    return run


def _climb(blocks: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all rounds, from the leaves up, and (tree, digest, round) of every tree's root."""
    rounds, done = [blocks], None
    while True:
        given = rounds[-1].select("tree", "block", "height", F.transform("nodes", lambda n: n["digest"]).alias("digests"))
        ups = materialize(batched(given, _root(depth), "tree string, pos long, height int, digest string"), f"{name}-roots")
        ready = ups.filter("height = 0").select("tree", "digest", F.lit(len(rounds) - 1).alias("round"))
        done = ready if done is None else done.unionByName(ready)
        above = ups.filter("height > 0")
        if above.isEmpty():
            return rounds, done
        rounds.append(_blocks(above, [], depth, f"{name}-blocks"))


def _walk(depth: int):
    """One row a node of each block: its fields and its path, with the path above the block."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        trees, heights = batch.column(0), batch.column(1).to_pylist()
        for row in range(batch.num_rows):
            nodes = batch.column(2)[row].values
            fields = dict(zip([nodes.type.field(i).name for i in range(nodes.type.num_fields)], nodes.flatten()))
            above = [(p["left"], p["right"]) for p in batch.column(3)[row].as_py() or ()]
            paths = traverse(fields["digest"].to_pylist(), min(depth, heights[row]))
            for at in range(0, len(nodes), PROOFS):
                size = min(PROOFS, len(nodes) - at)
                flat, ends = [], [0]
                for _, path in zip(range(size), paths):
                    flat += path
                    flat += above
                    ends.append(len(flat))
                steps = pa.StructArray.from_arrays(
                    [pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], names=["left", "right"]
                )
                tree = pa.array([trees[row].as_py()] * size, pa.string())
                arrays = [tree, *(v.slice(at, size) for v in fields.values())]
                path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps).cast(step)
                yield pa.RecordBatch.from_arrays([*arrays, path], names=["tree", *fields, "path"])

    return run


def _paths(blocks: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, digest, *items, path) of every node of ``blocks``; ``above``: (tree_, block_,
    above), the path of each block's root."""
    same = F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("block_"))
    given = blocks.join(above, same).select("tree", "height", "nodes", "above")
    item = blocks.schema["nodes"].dataType.elementType
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in item.fields)
    return batched(given, _walk(depth), f"tree string, {fields}, path {_STEP}")


def _descend(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The paths of the nodes of the first round; ``tops``: (tree, round, path), the path above
    every tree's root and the round at which the tree has one node left."""
    found = None
    for i in range(len(rounds) - 1, -1, -1):
        above = tops.filter(F.col("round") == i).select(F.col("tree").alias("tree_"), F.lit(0).cast("long").alias("block_"), F.col("path").alias("above"))
        if found is not None:
            above = above.unionByName(found.select(F.col("tree").alias("tree_"), F.col("pos").alias("block_"), F.col("path").alias("above")))
        found = _paths(rounds[i], above, depth)
    return found


@dataclass
class Manifest:
    """The stored trees of a data set."""

    #: (tree, digest, round): the root of every source's tree.
    subroots: DataFrame
    rounds: list[DataFrame]
    source_rounds: list[DataFrame]
    source_roots: DataFrame
    #: The name of every carried column, by its name in the blocks.
    carried: dict[str, str]
    depth: int

    def root(self) -> DataFrame:
        """(root): one row, none for an empty data set."""
        return self.source_roots.select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """(tree, pos, digest, *carried, path, subroot, root): every leaf with its siblings up to
        the root."""
        none = F.array().cast(_STEP)
        sources = _descend(self.source_rounds, self.source_roots.select("tree", "round", none.alias("path")), self.depth)
        root = self.source_roots.select("tree", F.col("digest").alias("root"))
        sources = sources.join(F.broadcast(root), "tree").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path", "root")
        sources = materialize(sources, "merkle-sources")
        known = sources.select(F.col("tree").alias("tree_"), "subroot", "root")
        tops = self.subroots.join(
            narrow(sources.select(F.col("tree").alias("tree_"), "path")), F.col("tree").eqNullSafe(F.col("tree_"))
        ).select("tree", "round", "path")
        leaves = _descend(self.rounds, tops, self.depth)
        return leaves.join(narrow(known), F.col("tree").eqNullSafe(F.col("tree_"))).drop("tree_").withColumnsRenamed(self.carried)


def manifest(leaves: DataFrame, tree: str = "source", order: Sequence[str] = ("doc_id",), leaf: str = "leaf", depth: int = DEPTH, name: str = "merkle") -> Manifest:
    """The trees over ``leaves``: one for each value of ``tree``, its leaves in ``order``.

    A null ``tree`` is a tree of its own, first among the others; equal orders are settled by the
    digest, and equal rows are interchangeable leaves.  Nulls in ``order`` come first.  Columns
    besides these are carried along to the proofs, whatever they are called.  An empty table has no
    trees and no root.
    """
    used = [tree, leaf]
    items = [c for c in leaves.columns if c not in used]
    plain = {c: f"c{i}" for i, c in enumerate(items)}
    rows = leaves.select(
        F.col(f"`{tree}`").cast("string").alias("tree"),
        F.col(f"`{leaf}`").alias("digest"),
        *[F.col(f"`{c}`").alias(plain[c]) for c in items],
    )
    rows = materialize(rows, f"{name}-leaves")
    ranked = _numbered(rows, [*(plain[c] for c in order), "digest"], name)
    powers = F.array(*[F.lit(ARITY**k) for k in range(16)])
    levels = F.size(F.filter(powers, lambda p: p < F.col("size"))).alias("height")
    ranked = ranked.select("*", levels)
    blocks = _blocks(ranked, list(plain.values()), depth, f"{name}-blocks")
    rounds, subroots = _climb(blocks, depth, name)
    subroots = materialize(subroots, f"{name}-subroots")

    tops = subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    tops = _numbered(tops, ["name"], f"{name}-sources")
    n = tops.count()
    tops = _blocks(tops.withColumn("height", F.lit(height(n))), ["name"], depth, f"{name}-sources-blocks")
    source_rounds, source_roots = _climb(tops, depth, f"{name}-sources")
    discard(rows)
    return Manifest(subroots, rounds, source_rounds, source_roots, {v: k for k, v in plain.items()}, depth)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, its digest, and what the root folds to where a fifth of the
    texts is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = [F.col(c) for c in FIELDS]
    changed = F.translate("text", upper, upper.lower())
    bent = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(*values[:-1], changed))
    leaves = docs.select("doc_id", "source", leaf_of(*values).alias("leaf"), bent.alias("bent"))
    found = manifest(leaves)
    rows = found.proofs()
    fold = folded(F.coalesce("bent", "digest"), F.col("path"))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_sql(levels: int = 6) -> str:
    """The same rows level by level, for up to 16**levels documents a source and as many sources."""

    def sql_encoded(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def sql_leaf(text: str) -> str:
        return "sha256(" + " || ".join([*(sql_encoded(c) for c in FIELDS[:-1]), sql_encoded(text)]) + ")"

    def climb(base: str, prefix: str) -> list[str]:
        """CTEs of the nodes (tree, pos, digest, n) of every level over ``base``."""
        out = [f"{prefix}0 AS ({base})"]
        for h in range(levels):
            out.append(
                f"{prefix}{h + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, pos // {ARITY} AS pos, "
                f"CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest "
                f"FROM {prefix}{h} GROUP BY tree, pos // {ARITY}))"
            )
            out.append(
                f"{prefix}runs{h} AS (SELECT tree, pos // {ARITY} AS run, string_agg(digest, '' ORDER BY pos) AS digests "
                f"FROM {prefix}{h} WHERE n > 1 GROUP BY tree, pos // {ARITY})"
            )
        return out

    def walk(first: str, prefix: str, tree: str, pos: str, start: str) -> list[str]:
        """CTEs that lead the rows of ``first`` up all levels."""
        out, now = [], first
        for h in range(levels):
            at = f"(({pos} // {ARITY**h}) % {ARITY}) * {_HEX}"
            left, right = f"left(r.digests, CAST({at} AS BIGINT))", f"substr(r.digests, CAST({at} + {_HEX + 1} AS BIGINT))"
            out.append(
                f"{start}{h} AS (SELECT w.* REPLACE (CASE WHEN r.run IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold, "
                f"proof || CASE WHEN r.run IS NULL THEN '' ELSE {left} || {right} END AS proof) FROM {now} w "
                f"LEFT JOIN {prefix}runs{h} r ON {tree} IS NOT DISTINCT FROM r.tree AND {pos} // {ARITY ** (h + 1)} = r.run)"
            )
            now = f"{start}{h}"
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rank = "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1"
    parts = [
        f"leaves AS (SELECT doc_id, source AS tree, {sql_leaf('text')} AS digest, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 "
        f"THEN {sql_leaf(lower)} END AS bent FROM documents)",
        f"placed AS (SELECT *, {rank} AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
        *climb("SELECT tree, pos, digest, n FROM placed", "a"),
        f"subroots AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos FROM a{levels})",
        *climb("SELECT 0 AS tree, pos, digest, count(*) OVER () AS n FROM subroots", "b"),
        f"started AS (SELECT p.*, s.digest AS subroot, s.pos AS place, coalesce(p.bent, p.digest) AS fold, '' AS proof FROM placed p "
        "JOIN subroots s ON p.tree IS NOT DISTINCT FROM s.name)",
        *walk("started", "a", "w.tree", "w.pos", "u"),
        *walk(f"u{levels - 1}", "b", "0", "w.place", "v"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, w.digest AS leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, "
        f"fold AS folded_root, fold = t.digest AS verified FROM v{levels - 1} w, b{levels} t"
    )
