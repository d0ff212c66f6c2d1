"""Stored indexes: trigrams of texts and pivots of vectors, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.operators import keywords, nearest, retrieval
from sagebrook.plans import registry
from sagebrook.sources.fixtures import Tables

ALPHABET = "abcdé 你𝄞#%_"


def some_text(rng, longest):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest)))


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(1)
    rows = [(i, some_text(rng, 30).upper() if i % 7 else None, some_text(rng, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    return rows, df, keywords.build(df, [F.col("a"), F.col("b")], [F.col("k").desc()])


def contained(rows, needles):
    return {(k, n) for k, a, b in rows for n in needles if n in (a or "").lower() or n in b.lower()}


def test_index_finds_what_contains(spark, held):
    """Needles of any length, letters outside the basic plane, wildcards, and none across fields."""
    rows, _, index = held
    rng = random.Random(2)
    needles = sorted({some_text(rng, 5) for _ in range(400)} - {""})
    asked = spark.createDataFrame([(n,) for n in [*needles, needles[0], None, ""]], "needle string")
    got = [(r["k"], r["needle"]) for r in index.hits(asked).collect()]
    assert len(got) == len(set(got)) and set(got) == contained(rows, needles)


@pytest.mark.parametrize("least", [0, 10**6])
def test_first_hits_in_order(spark, held, monkeypatch, least):
    monkeypatch.setattr(keywords, "LEAST_ROWS", least)
    rows, _, index = held
    needles = ["a", "ab", "é", "a b", "abc", "你", "zz", " "]
    want = {}
    for k, n in sorted(contained(rows, needles), reverse=True):
        want.setdefault(n, []).append(k)
    got = index.first(spark.createDataFrame([(n,) for n in needles], "needle string"), 5).collect()
    assert {(r["needle"], r["rank"], r["k"]) for r in got} == {(n, i + 1, k) for n, ks in want.items() for i, k in enumerate(ks[:5])}


def test_index_is_opened_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Blue Bolt"), (2, None), (3, "red")], "k int, a string")
    keywords.build(rows, [F.col("a")], path=f"file://{tmp_path}/i")
    again = keywords.KeywordIndex.open(spark, f"file://{tmp_path}/i")
    assert [tuple(r) for r in again.hits(spark.createDataFrame([("e b",)], "needle string")).collect()] == [(1, "Blue Bolt", "e b")]
    empty = keywords.build(rows.limit(0), [F.col("a")])
    assert empty.hits(spark.createDataFrame([("a",), ("abc",)], "needle string")).count() == 0


@pytest.mark.parametrize("block", [3, 10**6])
def test_needles_are_found_by_their_words(spark, monkeypatch, block):
    """Phrases over lines and tabs, words within words, spaces around, blocks of needles; an index for one search has no trigrams."""
    monkeypatch.setattr(keywords, "BLOCK", block)
    texts = ["cold gears and bolts", "a COLD\n gear", "cold\tgear", "old gear, x", "cold  gear", "", " ", "gears old", "cold gear of old " * 3, "x" * 500 + "old gear"]
    needles = ["old gear", "cold gear", "d gears and b", "old\tgear", "gear", " old", "old ", "d\n g", "ear", "x" * 70, " ", "gear of o", "gears  and", "nowhere at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, a string").repartition(3)
    index = keywords.build(rows, [F.col("a")], [F.col("k")])
    assert index.grams is None and index.postings is None
    want = {(k, n) for k, t in enumerate(texts) for n in needles if n in t.lower()}
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = [(r["k"], r["needle"]) for r in index.hits(asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    best = {(r["k"], r["needle"], r["rank"]) for r in index.first(asked, 2).collect()}
    assert best == {(k, n, i + 1) for n in needles for i, k in enumerate(sorted(k for k, m in want if m == n)[:2])}


@pytest.mark.parametrize("needles", [0, 100])
@pytest.mark.parametrize("share", [2, 64])
def test_edges_in_two_stretches(spark, monkeypatch, needles, share):
    """Keywords that the surest edges settle, that need the others, and that are nowhere; ties, dangling edges, none of a confidence."""
    monkeypatch.setattr(retrieval, "NEEDLES", needles)
    monkeypatch.setattr(retrieval, "EDGE_SHARE", share)
    rng = random.Random(4)
    names = {f"e{i}": rng.choice(["Red gear", "blue Ring", "old bolt"]) + (" rare" if i in (3, 4) else "") for i in range(60)}
    entities = spark.createDataFrame([(k, "Part", "TRUSTED", v, "") for k, v in names.items()], "entity_id string, entity_type string, lifecycle_state string, extracted_text string, source_sentence string")
    rows = [(f"r{i}", f"e{rng.randrange(64)}", f"e{rng.randrange(60)}", rng.choice(["OWNS", "USES"]), "TRUSTED" if i % 9 else "STAGING", None if i % 50 == 0 else rng.randrange(12) / 10) for i in range(400)]
    edges = spark.createDataFrame(rows, "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, lifecycle_state string, confidence double")
    asked = {1: "red gear", 2: "rare", 3: "own bolt", 4: "nowhere", 5: "uses rare ring"}
    want = set()
    for q, text in asked.items():
        found = []
        for word in text.split():
            held = [r for r in rows if r[4] == "TRUSTED" and r[1] in names and r[2] in names and any(word in x.lower() for x in (r[3], names[r[1]], names[r[2]]))]
            held.sort(key=lambda r: (r[5] is None, -(r[5] or 0), r[0]))
            found += [r[0] for r in held[:40] if r[0] not in found]
        want |= {(q, r, i + 1) for i, r in enumerate(found[:40])}
    got = retrieval.retrieve_edges(spark.createDataFrame(list(asked.items()), "query_id int, query string"), edges, entities)
    assert sorted((r["query_id"], r["relationship_id"], r["position"]) for r in got.collect()) == sorted(want)


def test_texts_are_sliced_after_their_join(spark, sf_dir):
    """No join where no vector is asked for, and none that takes a whole text along for every slice."""
    plan = Tables(spark, sf_dir).chunks.select("document_id", "chunk_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = Tables(spark, sf_dir).chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_vectors_of_one_id_stay_two(spark, sf_dir, tmp_path):
    """A vector's id that occurs twice gives a chunk twice, as a join does."""
    t = Tables(spark, sf_dir)
    t.raw("documents").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = t.raw("embeddings")
    vectors.union(vectors.limit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    again = Tables(spark, str(tmp_path)).chunks.select("document_id")
    assert again.count() > t.chunks.select("document_id").count()


def test_retrieval_is_the_same_through_the_index(spark, sf_dir, monkeypatch):
    """Whether needles are looked for in one pass or looked up: the same rows, and no join but on keys."""
    t = Tables(spark, sf_dir)
    for name in ("keyword_entities", "keyword_edges", "keyword_chunks"):
        query = registry.queries()[name]
        monkeypatch.setattr(retrieval, "NEEDLES", 10**6)
        want = sorted(map(tuple, query(spark, sf_dir).collect()))
        monkeypatch.setattr(retrieval, "NEEDLES", 0)
        assert sorted(map(tuple, query(spark, sf_dir).collect())) == want
    many = spark.range(100_000).select(F.concat(F.lit("n"), F.col("id")).alias("needle"))
    index = keywords.build(t.entities, [F.col("extracted_text")])
    plan = index.hits(many)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute(rows, asked, k, least=-2.0):
    out = {}
    for q, v in asked:
        found = []
        for key, w in rows:
            if v and w and len(v) == len(w) and None not in w and np.isfinite(v).all() and np.isfinite(w).all() and any(v) and any(w):
                alike = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)
                if alike >= least:
                    found.append((-alike, key))
        for i, (s, key) in enumerate(sorted(found)[:k]):
            out[q, i + 1] = (key, -s)
    return out


@pytest.mark.parametrize("part_rows", [25, 16_384])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_nearest_vectors(spark, spread, part_rows):
    """Clusters and no structure, ties, equal vectors, odd ones, two lengths, cells in parts."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(size=6) * spread).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(60)] + [(500 + i, rng.normal(size=3).round(2).tolist()) for i in range(30)]
    rows += [(600, None), (601, []), (602, [0.0] * 6), (603, [float("nan")] * 6), (604, [None] + [1.0] * 5)]
    asked = [(i, (centres[i % 8] + rng.normal(size=6) * spread).tolist()) for i in range(20)]
    asked += [(20, rows[5][1]), (21, [1.0, 2.0, 3.0]), (22, None), (23, [0.0] * 6), (24, [1.0] * 5)]
    held = spark.createDataFrame(rows, "k int, v array<double>")
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")
    table = nearest.build(held, "v", ["k"], part_rows=part_rows)
    assert len(table.cells) > 2 and (part_rows > 25 or table.parts)
    got = {(r["query_id"], r["rank"]): (r["k"], r["similarity"]) for r in table.near(queries, 7, [("k", "ascending")], ["k"]).collect()}
    assert got == brute(rows, asked, 7) and len(got) == 22 * 7
    got = {(r["query_id"], r["rank"]): (r["k"], r["similarity"]) for r in table.near(queries, 3, [("k", "ascending")], ["k"], 0.9).collect()}
    assert got == brute(rows, asked, 3, 0.9)


def test_cells_out_of_reach_are_not_searched(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.02).tolist()) for i in range(3600)]
    table = nearest.build(spark.createDataFrame(rows, "k int, v array<double>"), "v", ["k"])
    asked = spark.createDataFrame([(0, "x", rows[0][1])], "query_id int, note string, vector array<double>").select("query_id", "vector", F.lit(0.9).alias("bound"))
    visits = asked.mapInArrow(nearest._visits(table.pivots, table.cells, table.parts, 5, False, False), "query_id int, vector array<double>, cell int, part int")
    seen = sum(table.cells[r["cell"]][0] for r in visits.select("cell").collect())
    assert seen < 1000 and len(table.cells) > 8


def test_mentions_in_blocks(spark):
    """Whole words, overlaps, letters of two bytes, names in one automaton or in several."""
    from sagebrook.operators import mentions

    names = ["Blue Bolt", "bolt", "BOLT gear", "é", "x-1", "", None, "blue bolt"]
    rows = [(1, "A blue bolt gear, bolts; BOLT"), (2, "é Blue\nBolt xx-1 x-1."), (3, None), (4, ""), (5, "bolté boltz 1bolt")]
    texts = spark.createDataFrame(rows, "document_id int, text string")
    want = {(1, "blue bolt", 2, 11), (1, "bolt", 7, 11), (1, "bolt gear", 7, 16), (1, "bolt", 25, 29), (2, "é", 0, 1), (2, "bolt", 7, 11), (2, "x-1", 17, 20), (5, "bolt", 0, 4), (5, "é", 4, 5)}
    # A letter outside A-Z ends a word; one inside does not.
    want -= {(5, "é", 4, 5)}
    for most in (200_000, 2):
        got = {tuple(r) for r in mentions.mentions(texts, spark.createDataFrame([(n,) for n in names], "name string"), most=most).collect()}
        assert got == want


def test_default_extractor_knows_all_types():
    from sagebrook.operators.extraction import ENTITY_TYPES, RELATIONSHIP_TYPES, PatternExtractor

    text = (
        "The PayTeam owns the PayService. PayService depends on the LedgerDB! ApiService calls PayService. CoreComponent supports the PayService.\n"
        "Engineer Ada Byron is a member of the PayTeam. INC-42 was caused by the EventQueue. INC-42 affects the HotCache. Dr Grace wrote it."
    )
    model = PatternExtractor()
    found = {(n, k) for n, k, _, _ in model.entities(text)}
    assert {k for _, k in found} == set(ENTITY_TYPES) and ("Ada Byron", "Person") in found and ("Grace", "Person") in found
    links = {(a, k, b) for a, k, b, _, _ in model.relationships(text, [n for n, _ in found])}
    assert links == {
        ("PayTeam", "OWNS", "PayService"), ("PayService", "DEPENDS_ON", "LedgerDB"), ("ApiService", "CALLS", "PayService"), ("CoreComponent", "SUPPORTS", "PayService"),
        ("Ada Byron", "MEMBER_OF", "PayTeam"), ("INC-42", "CAUSED_BY", "EventQueue"), ("INC-42", "AFFECTS", "HotCache"),
    }
    assert {k for _, k, _ in links} == set(RELATIONSHIP_TYPES)
