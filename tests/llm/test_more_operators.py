"""Merkle manifest, packing and resampling on awkward rows, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import merkle, packing, resampling

from .helpers import DOCUMENTS, LOWER, WORD


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        i //= 16
    return out


def proofs(leaves):
    """Counter of (doc_id, leaf, subroot, root, path) of (source, doc_id, leaf)."""
    by = defaultdict(list)
    for source, doc, leaf in leaves:
        by[source].append((doc is not None, doc or 0, leaf, doc))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in by}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for i, (_, _, leaf, doc) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            out[doc, leaf, trees[s][-1][0], top[-1][0], tuple(path_of(trees[s], i) + path_of(top, k))] += 1
    return out


def proven(found):
    return Counter((r["doc_id"], r["digest"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in found.proofs().collect())


@pytest.mark.parametrize("n, levels", [(1, 1), (2, 1), (15, 1), (16, 1), (17, 2), (256, 2), (257, 3), (300, 3), (4096, 3), (1, 3), (16, 2)])
def test_traversal(n, levels):
    """Siblings of every leaf, also where a short block is raised further than it needs."""
    leaves = [H(str(i)) for i in range(n)]
    nodes = [leaves]
    for _ in range(levels):
        nodes.append([H(*nodes[-1][i : i + 16]) for i in range(0, len(nodes[-1]), 16)])
    want = [path_of(nodes[: levels + 1], i) for i in range(n)]
    assert list(merkle.traverse(leaves, levels)) == want
    assert merkle.block_root(leaves, levels) == nodes[levels][0]


def test_traversal_keeps_little(monkeypatch):
    """A walk holds two runs and its stacks a level, whatever the number of leaves."""
    trees = []
    monkeypatch.setattr(merkle, "TreeHash", lambda level, new=merkle.TreeHash: trees.append(new(level)) or trees[-1])
    for _ in merkle.traverse([H(str(i)) for i in range(2000)], 3):
        assert all(len(t.nodes) <= 16 and all(len(s) < 16 for s in t.stacks) for t in trees[-3:])


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest(spark, rows, documents, depth):
    """Whatever the size of a block: the proofs of plain trees, that fold to the root."""
    leaf = merkle.leaf_of(*[F.col(c) for c in merkle.FIELDS])
    many = [(1000 + i, f"text {i}", "en", "many", 7) for i in range(700)]
    docs = documents.unionByName(spark.createDataFrame(many, DOCUMENTS))
    found = merkle.manifest(docs.select("source", "doc_id", leaf.alias("leaf"), F.lit(1).alias("pos"), F.lit(2).alias("path_"), F.lit(3).alias("digest_"), F.lit(4).alias("tree")), depth=depth)

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    want = proofs([(r[3], r[0], H(*map(enc, (r[0], r[3], r[2], r[4], r[1])))) for r in rows + many])
    # The column called pos is carried, and not taken for the place.
    assert "path_" in found.proofs().columns
    assert proven(found) == want
    rows_ = found.proofs().select((merkle.folded(F.col("digest"), F.col("path")) == F.col("root")).alias("ok"))
    assert rows_.filter("ok").count() == len(rows) + len(many)
    assert [r["root"] for r in found.root().collect()] == [next(iter(want))[3]]


def test_manifest_of_little(spark, empty):
    leaves = empty.select("source", "doc_id", F.lit("x").alias("leaf"))
    found = merkle.manifest(leaves)
    assert found.proofs().count() == 0 and found.root().count() == 0
    one = merkle.manifest(spark.createDataFrame([("s", 1, H("a"))], "source string, doc_id long, leaf string"))
    assert proven(one) == Counter({(1, H("a"), H("a"), H("a"), ()): 1})


def test_tampered_documents_do_not_verify(spark, sf_dir):
    got = merkle.op11(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text != text.translate(LOWER)
        assert r["verified"] == (r["folded_root"] == r["root"]) == (not touched)


# 12


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for room in {f for f in free if f >= items[i]}:
            at = free.index(room)
            free[at] -= items[i]
            go(i + 1, free)
            free[at] += items[i]
        free.append(capacity - items[i])
        go(i + 1, free)
        free.pop()

    go(0, [])
    return best[0]


def check_plan(plan, counts, capacity):
    numbers, bins = defaultdict(list), defaultdict(list)
    for length, lo, n, per, first, at in plan.rows:
        for k in range(n):
            numbers[length].append(lo + k)
            bins[first + k // per].append((at + k % per * length, length))
    assert all(sorted(numbers[x]) == list(range(n)) for x, n in enumerate(counts))
    assert set(bins) == set(range(plan.sequences))
    for parts in bins.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= capacity


def test_reduction_keeps_the_optimum():
    rng, fixed = random.Random(2), 0
    for _ in range(400):
        capacity = rng.randint(5, 20)
        items = [rng.randint(rng.randint(1, capacity // 2), capacity) for _ in range(rng.randint(0, 10))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
        plan = packing._Plan(counts)
        packing.reduce_by_dominance(plan, capacity)
        rest = [x for x, n in enumerate(plan.left) for _ in range(n)]
        fixed += len(items) - len(rest)
        assert plan.sequences + optimum(rest, capacity) == optimum(items, capacity)
        packing.best_fit(plan, capacity)
        check_plan(plan, counts, capacity)
    assert fixed > 1000


def test_plan_grows_with_lengths_only():
    rng = np.random.default_rng(0)
    few = rng.integers(0, 5, packing.CAPACITY + 1)
    few[0] = 0
    check_plan(packing.plan_of(few), few, packing.CAPACITY)
    many = packing.plan_of(few * 10**8)
    assert len(many.rows) < 40_000
    assert many.sequences < 1.02 * (few * np.arange(len(few))).sum() * 10**8 / packing.CAPACITY


def check_packed(found, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want, bins, got = Counter(), defaultdict(list), Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), capacity):
            want[doc, i // capacity, i, tuple(ids[i : i + capacity])] += 1
    for r in found.collect():
        got[r["doc_id"], r["piece"], r["start"], tuple(r["ids"])] += 1
        assert r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in bins.values():
        assert sum(n for _, n in parts) <= capacity
        assert [at for at, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    return bins, sum(len(k[3]) * n for k, n in want.items())


@pytest.mark.parametrize("capacity", [2048, 50])
def test_packing(spark, rows, clashing, capacity):
    odd = [(200, "It's <|endoftext|> o'clock here, ça va? ΣΑΣ ̈x é 1234"), (201, "<|startoftext|><|endoftext|>'"), (202, "你好 " * 50)]
    docs = clashing.unionByName(spark.createDataFrame([(*r, None, None, None) for r in odd], DOCUMENTS), allowMissingColumns=True)
    found = packing.pack(docs, capacity=capacity)
    bins, tokens = check_packed(found, [r[:2] for r in rows] + odd, capacity)
    assert len(bins) <= -(-tokens // capacity) + 2
    whole = packing.sequences(found).collect()
    assert len(whole) == len(bins) and sum(len(r["ids"]) for r in whole) == tokens


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_packing_of_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bins, tokens = check_packed(packing.pack(docs), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert len(bins) <= -(-tokens // 2048) + 1
    assert packing.op12(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# 13


def resampled(docs, target):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * all_s) / ((n + 1) * all_t))) for b, n in s.items()}
    rows = []
    for doc, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(H(f"42:{'' if doc is None else doc}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, n, len(found), weight, score))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = 5 * len(able) // 100
    ranks = Counter((*r, i + 1) for i, r in enumerate(able[:drawn]))
    return ranks + Counter((*r, None) for r in able[drawn:] + [r for r in rows if r[1] < 20])


def test_resampling(spark, rows, clashing):
    more = [(300 + i, rows[21][1]) for i in range(40)] + [(None, rows[21][1])] * 3
    docs = clashing.unionByName(spark.createDataFrame([(*r, None, None, None) for r in more], DOCUMENTS), allowMissingColumns=True).withColumn("b1", F.lit(1)).withColumn("copies", F.lit(9))
    target = [" ".join(rows[21][1].split()[:40]), None, "", "ONE two", rows[5][1]]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").withColumn("k1", F.lit(1))
    got = Counter(tuple(r) for r in resampling.resample(docs, items).collect())
    want = resampled([r[:2] for r in rows] + more, target)
    assert got == want and sum(n for k, n in got.items() if k[5]) > 3


def test_resampling_of_nothing(spark, documents, empty):
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert resampling.resample(empty, items).count() == 0
    found = resampling.resample(documents, items.limit(0))
    assert found.count() == documents.count() and found.filter("rank = 1").count() == 1


def test_resampling_of_a_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = Counter((k[0], *k[2:]) for k in resampled(docs, target).elements())
    assert Counter(tuple(r) for r in resampling.op13(spark, sf_dir).collect()) == want


