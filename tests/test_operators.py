"""Operators against rows worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagebrook import schemas
from sagebrook.operators import extraction, folds, graph, lifecycle, listing, memory, resolution, retrieval, rules, scoring, wiki
from sagebrook.sources import readers, sinks, synthetic

def as_of():
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")


E = (
    "entity_id string, entity_type string, lifecycle_state string, confidence double, extracted_text string, source_document_id string, "
    "source_sentence string, access_count int, created_at timestamp_ntz"
)
R = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, lifecycle_state string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(
        [
            ("1", "Service", "TRUSTED", 0.92, "PaymentService", "doc-1", "s1", 0, T0),
            ("2", "Team", "TRUSTED", 0.88, "Platform", "doc-1", "s2", 0, T0),
            ("3", "Database", "STAGING", 0.55, "OrdersDB", "doc-2", "s3", 0, T0),
        ],
        E,
    )


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a1", "2", "1", "OWNS", 0.85, "TRUSTED")], R)


def ids(df, column="entity_id"):
    return sorted(r[column] for r in df.collect())


def test_listing_filters(entities, edges):
    assert ids(listing.list_entities(entities)) == ["1", "2"]
    assert ids(listing.list_entities(entities, state="STAGING", name="orders")) == ["3"]
    assert ids(listing.list_entities(entities, min_confidence=0.9)) == ["1"]
    assert ids(listing.list_relationships(edges, entities, source_type="Team"), "relationship_id") == ["a1"]
    assert ids(listing.list_relationships(edges, entities, target_type="Team"), "relationship_id") == []
    assert ids(listing.neighbours(edges, entities, "1"), "relationship_id") == ["a1"]


def test_wildcards_are_literal(entities):
    assert ids(listing.list_entities(entities, name="%")) == []


@pytest.mark.parametrize(
    "applied, violated, priority, enabled",
    [(60, 50, 5, False), (25, 0, 6, True), (30, 15, 4, True), (10, 0, 5, True)],
)
def test_rule_evolution(spark, applied, violated, priority, enabled):
    rows = spark.createDataFrame([("r", 5, True, applied, violated)], "rule_name string, priority int, enabled boolean, times_applied int, times_violated int")
    got = rules.evolve(rows).first()
    assert (got["priority"], got["enabled"]) == (priority, enabled)


def test_priority_has_a_floor_and_disabled_rules_rest(spark):
    rows = spark.createDataFrame([("a", 0, True, 30, 15), ("b", 3, False, 60, 60)], "rule_name string, priority int, enabled boolean, times_applied int, times_violated int")
    assert {r["rule_name"]: (r["priority"], r["action"]) for r in rules.evolve(rows).collect()} == {"a": (0, "lower"), "b": (3, "none")}


def test_fileback(spark, entities):
    answers = spark.createDataFrame([(1, 0.85, ["1"]), (2, 0.30, ["2"]), (3, 0.9, [])], "response_id int, confidence double, entity_ids array<string>")
    got = {r["entity_id"]: round(r["confidence"], 6) for r in folds.fileback(entities, answers).collect()}
    assert got == {"1": 0.93, "2": 0.86, "3": 0.55}


def test_fold_is_ordered_and_latches(spark, entities):
    steps = [("1", i, -0.06) for i in range(10)] + [("1", 10, 0.9), ("2", 0, 0.5), ("2", 1, -0.1), ("3", 0, -0.5), ("x", 0, 1.0)]
    changes = spark.createDataFrame(steps, "entity_id string, seq int, delta double")
    got = {r["entity_id"]: (round(r["confidence"], 6), r["lifecycle_state"]) for r in folds.fold(entities, changes).collect()}
    assert got == {"1": (1.0, "ARCHIVED"), "2": (0.9, "TRUSTED"), "3": (0.05, "STAGING")}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1, 1, allow_nan=False), max_size=20))
def test_fold_stays_within_bounds(spark, deltas):
    one = spark.createDataFrame([("1", "TRUSTED", 0.5)], "entity_id string, lifecycle_state string, confidence double")
    changes = spark.createDataFrame([("1", i, float(d)) for i, d in enumerate(deltas)], "entity_id string, seq int, delta double")
    assert 0.0 <= folds.fold(one, changes).first()["confidence"] <= 1.0


def plain_fold(c, state, deltas):
    """One change after the other, in hundredths."""
    c = round(c * 100)
    for d in (round(d * 100) for d in deltas):
        c = min(c + d, 100) if d >= 0 else max(c + d, 0)
        state = "ARCHIVED" if d < 0 and c < 40 and state == "TRUSTED" else state
    return c / 100, state, len(deltas)


def histories(n, longest, seed=4):
    """Short histories with the deltas in use, many of them around the threshold."""
    rng = np.random.default_rng(seed)
    rows = [(str(i), ("TRUSTED", "STAGING")[i % 7 == 0], int(rng.integers(0, 101)) / 100) for i in range(n)]
    return rows, {e: rng.choice([0.03, -0.05, -0.02, 0.0, 0.01], size=rng.integers(0, longest)).tolist() for e, _, _ in rows}


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_any_grouping_of_changes_folds_alike(spark, block):
    rows, deltas = histories(400, 40)
    rows.append(("hot", "TRUSTED", 0.46))
    deltas["hot"] = np.random.default_rng(8).choice([0.03, -0.05, -0.02], size=3000).tolist()
    some = spark.createDataFrame(rows, "entity_id string, lifecycle_state string, confidence double")
    changes = [(e, i, d) for e in deltas for i, d in enumerate(deltas[e])] + [("0", 99, None), (None, 1, 0.5)]
    changes = spark.createDataFrame(changes, "entity_id string, seq int, delta double").repartition(3)
    got = {r["entity_id"]: (r["confidence"], r["lifecycle_state"], r["n_changes"]) for r in folds.fold(some, changes, block=block).collect()}
    assert got == {e: plain_fold(c, s, deltas[e]) for e, s, c in rows}


def test_fold_has_no_rounding(spark):
    """0.46 less three times 0.02 is the threshold, not under it."""
    one = spark.createDataFrame([("1", "TRUSTED", 0.46), ("2", "TRUSTED", None)], "entity_id string, lifecycle_state string, confidence double")
    changes = spark.createDataFrame([(e, i, -0.02) for e in "12" for i in range(3)], "entity_id string, seq int, delta double")
    assert sorted(map(tuple, folds.fold(one, changes).collect())) == [("1", "TRUSTED", 0.4, 3), ("2", "TRUSTED", None, 3)]


def test_near_entries_equal_all_pairs(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(6, 8))
    def some(n):
        return [(centres[i % 6] + random.normal(size=8) * 0.25).round(3).tolist() for i in range(n)]
    held, asked = some(60), some(40)
    held[7], held[8], held[9], held[10] = held[6], [0.0] * 8, [float("nan")] * 8, [1.0, 2.0]
    asked[3], asked[4], asked[5], asked[6] = held[6], [0.0] * 8, None, [2.0, 4.0]
    entries = spark.createDataFrame([(v, T0 + dt.timedelta(days=i % 3), str(i), f"r{i}") for i, v in enumerate(held)], "query_embedding array<double>, created_at timestamp_ntz, id string, response_json string")
    got = retrieval.near_entries(spark.createDataFrame(list(enumerate(asked)), "query_id int, vector array<double>"), entries, 0.95)
    want = {}
    for q, v in enumerate(asked):
        for i, e in enumerate(held):
            if v and len(v) == len(e) and any(v) and any(e):
                alike = round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 6)
                if alike >= 0.95:
                    want[q] = max(want.get(q, ()), (alike, i % 3, str(i)))
    assert {r["query_id"]: (r["near"]["similarity"], r["near"]["response_json"]) for r in got.collect()} == {q: (w[0], f"r{w[2]}") for q, w in want.items()}
    assert len(want) > 10


def test_unknown_judgments(spark):
    rows = spark.createDataFrame([("correct",), ("maybe",), (None,)], "judgment string")
    assert folds.invalid_feedback(rows).count() == 2


def test_promotion(spark, entities, edges):
    out, _ = lifecycle.promote_all(entities, edges)
    assert ids(out.filter("lifecycle_state = 'TRUSTED'")) == ["1", "2", "3"]
    asked = spark.createDataFrame([("3",), ("1",), ("9",)], "entity_id string")
    assert {r["entity_id"]: r["status"] for r in lifecycle.promote(entities, asked)[1].collect()} == {"1": "wrong_state", "3": "ok", "9": "not_found"}
    assert ids(lifecycle.demote(entities, asked)[0].filter("lifecycle_state = 'ARCHIVED'")) == ["1"]


def test_edges_follow_both_ends(spark, entities):
    staged = spark.createDataFrame([("x", "1", "2", "OWNS", 0.9, "STAGING"), ("y", "1", "3", "OWNS", 0.9, "STAGING")], R)
    got = {r["relationship_id"]: r["lifecycle_state"] for r in lifecycle.promote_edges(staged, entities).collect()}
    assert got == {"x": "TRUSTED", "y": "STAGING"}


def test_evidence_takes_the_best_of_a_group(spark):
    rows = [("1", "S", "STAGING", 0.9, "a", "d1", "", 0, T0), ("2", "S", "STAGING", 0.1, "A", "d2", "", 0, T0), ("3", "S", "STAGING", 0.9, "b", "", "", 0, T0)]
    decided = lifecycle.evidence(spark.createDataFrame(rows, E), min_sources=1)
    assert {r["entity_id"]: r["decision"] for r in decided.collect()} == {"1": "promote", "2": "promote", "3": "few_sources"}


def test_merge_and_repoint(spark):
    rows = [("1", "S", "STAGING", 0.9, "a", "d1", "", 0, T0), ("2", "S", "STAGING", 0.8, "A", "d2", "", 0, T0), ("3", "S", "STAGING", 0.5, "a", "d3", "", 0, T0), ("4", "S", "STAGING", 0.5, "b", "d3", "", 0, T0)]
    edge = spark.createDataFrame([("x", "2", "4", "USES", 0.5, "STAGING"), ("y", "2", "3", "USES", 0.5, "STAGING")], R)
    merged, moved = resolution.merge_staging_duplicates(spark.createDataFrame(rows, E), edge)
    got = {r["entity_id"]: (r["lifecycle_state"], round(r["confidence"], 6), r["merged_into"]) for r in merged.collect()}
    assert got == {"1": ("STAGING", 1.0, None), "2": ("ARCHIVED", 0.8, "1"), "3": ("ARCHIVED", 0.5, "1"), "4": ("STAGING", 0.5, None)}
    assert {r["relationship_id"]: (r["source_entity_id"], r["target_entity_id"]) for r in moved.collect()} == {"x": ("1", "4"), "y": ("1", "1")}
    again, _ = resolution.merge_staging_duplicates(merged.drop("merged_into", "merge_reason"), moved)
    assert again.filter("merged_into is not null").count() == 0
    assert resolution.repoint(edge, spark.createDataFrame([("3", "2")], "entity_id string, survivor string"), clean=True).count() == 1


def test_cross_document(spark):
    rows = [("1", "S", "TRUSTED", 0.9, "a", "d1", "", 0, T0), ("2", "S", "TRUSTED", 0.99, "A", "d2", "", 0, T0), ("3", "S", "STAGING", 0.5, "a", "d3", "", 0, T0), ("4", "S", "STAGING", 0.5, None, "d3", "a", 0, T0)]
    edge = spark.createDataFrame([("x", "3", "4", "USES", 0.5, "STAGING")], R)
    out, moved = resolution.resolve_cross_document(spark.createDataFrame(rows, E), edge)
    got = {r["entity_id"]: (r["lifecycle_state"], round(r["confidence"], 6)) for r in out.collect()}
    assert got == {"1": ("TRUSTED", 0.93), "2": ("TRUSTED", 1.0), "3": ("ARCHIVED", 0.5), "4": ("STAGING", 0.5)}
    assert moved.first()["source_entity_id"] == "2"


def test_names_resolve_by_state_then_confidence(spark, entities):
    more = entities.unionByName(spark.createDataFrame([("5", "Service", "STAGING", 0.99, "paymentservice", "d", "s", 0, T0)], E))
    names = spark.createDataFrame([("PAYMENTSERVICE",), ("nope",)], "name string")
    assert {r["name"]: r["entity_id"] for r in resolution.resolve_names(names, more).collect()} == {"PAYMENTSERVICE": "1", "nope": None}


def test_cache_and_memory(spark):
    writes = spark.createDataFrame(
        [("s", "k", "a", "x", 0, T0, T0 + dt.timedelta(days=60), 1), ("s", "k", "b", "y", 1, T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=61), 2), ("s", "old", "c", "y", 1, T0, T0, 3)],
        "session_id string, key string, value string, agent string, step_number int, created_at timestamp_ntz, expires_at timestamp_ntz, seq long",
    )
    state = memory.upsert(writes)
    row = memory.get(state, "s", "k", as_of()).first()
    assert (row["value"], row["created_at"]) == ("b", T0)
    assert memory.get(state, "s", "old", as_of()).count() == 0
    left, gone = memory.cleanup(state, as_of())
    assert (left.count(), gone.first()["deleted"]) == (1, 1)
    left, gone = memory.delete(state, "s")
    assert (left.count(), gone.first()["deleted"]) == (0, 2)
    assert memory.upsert(writes.filter("seq = 2"), memory.upsert(writes.filter("seq = 1"))).first()["created_at"] == T0

    entries = spark.createDataFrame([("What is it? ", "{}", 0.9, [1.0, 0.0])], "query_text string, response_json string, confidence double, query_embedding array<float>")
    cache = memory.cache_put(entries, as_of(), 10)
    asked = spark.createDataFrame([(1, "WHAT IS IT?", [0.0, 1.0]), (2, "other", [1.0, 0.05]), (3, "other", [0.0, 1.0])], "query_id int, query string, vector array<float>")
    hits = {r["query_id"]: r["hit"] for r in retrieval.cache_lookup(asked, cache, as_of()).collect()}
    assert hits == {1: "exact", 2: "semantic", 3: "miss"}
    late = F.expr("timestamp_ntz'2024-02-02 00:00:00'")
    assert {r["hit"] for r in retrieval.cache_lookup(asked, cache, late).collect()} == {"miss"}


def test_wiki(spark, entities, edges):
    pages = wiki.compile_pages(entities, edges)
    assert pages.count() == 2
    page = wiki.get_page(pages, "Service", "paymentservice").first()["markdown"]
    assert "Relationships" in page and "<- **OWNS** Platform" in page
    stored = wiki.upsert_pages(pages.select("entity_type", "title", "markdown", "confidence_avg").withColumns({"created_at": F.lit(T0).cast("timestamp_ntz"), "updated_at": F.lit(T0).cast("timestamp_ntz")}), pages.limit(1), as_of())
    assert stored.count() == 2 and stored.filter("created_at = timestamp_ntz'2024-01-01 00:00:00'").count() == 2
    assert wiki.list_pages(pages, "Team").count() == 1
    titles = spark.createDataFrame([(entities.first()["source_document_id"], "The handbook")], "document_id string, title string")
    titled = wiki.compile_pages(entities, edges, documents=titles)
    assert titled.count() == 2 and titled.filter("markdown like '%- The handbook%'").count() > 0


def test_no_context_is_insufficient(spark, entities, edges):
    asked = spark.createDataFrame([(1, "zzz qqq")], "query_id int, query string")
    found, links = retrieval.retrieve_entities(asked, entities), retrieval.retrieve_edges(asked, edges, entities)
    docs = spark.createDataFrame([], "query_id int")
    report = retrieval.uncertainty(asked, found, links, docs).first()
    assert (report["overall_confidence"], report["recommendation"], len(report["reasons"])) == (0.0, "insufficient_context", 2)


@pytest.mark.parametrize("confidence, level", [(0.85, "high"), (0.7, "medium"), (0.5, "low"), (0.1, "very_low")])
def test_levels(spark, confidence, level):
    assert spark.range(1).select(retrieval.confidence_level(F.lit(confidence)).alias("x")).first()["x"] == level


def test_k_hop_of_many_seeds(spark):
    """More seeds than a word has bits, a hub, loops, seeds without edges and seeds given twice."""
    rng = np.random.default_rng(5)
    pairs = [(f"n{rng.integers(0, 150)}", f"n{rng.integers(0, 150)}") for _ in range(160)] + [("hub", f"n{i}") for i in range(0, 150, 3)] + [("n1", "n1")]
    edges = spark.createDataFrame([(a, b, "TRUSTED") for a, b in pairs] + [("n1", "far", "STAGING")], "source_entity_id string, target_entity_id string, lifecycle_state string")
    seeds = [f"n{i}" for i in range(140)] + ["hub", "hub", "alone"]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for s in set(seeds):
        hops, frontier = {s: 0}, {s}
        for hop in (1, 2, 3):
            frontier = {n for x in frontier for n in near.get(x, ())} - set(hops)
            hops.update(dict.fromkeys(frontier, hop))
        want |= {(s, n, h) for n, h in hops.items()}
    got = graph.k_hop(edges, spark.createDataFrame([(s,) for s in seeds], "entity_id string"), 3).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("most", [0, 2, 64])
def test_k_hop_counts(spark, monkeypatch, most):
    """Twins, a hub, loops, seeds without edges, given twice, and classes of any bound: what k_hop finds, counted."""
    monkeypatch.setattr(graph, "TWIN_NEIGHBOURS", most)
    rng = np.random.default_rng(6)
    pairs = [(f"n{rng.integers(0, 40)}", f"n{rng.integers(0, 40)}") for _ in range(40)] + [(f"leaf{i}", f"n{i % 4}") for i in range(30)]
    pairs += [(f"two{i}", f"n{k}") for i in range(5) for k in (1, 2)] + [("n1", "n1"), ("pair1", "pair2"), ("leaf1", "leaf1")]
    edges = spark.createDataFrame([(a, b, "TRUSTED") for a, b in pairs] + [("n1", "far", "STAGING")], "source_entity_id string, target_entity_id string, lifecycle_state string")
    seeds = spark.createDataFrame([(s,) for s in [*sorted({a for a, _ in pairs}), "leaf1", "alone"]], "entity_id string")
    for hops in (1, 2, 3):
        want = graph.k_hop(edges, seeds, hops).groupBy("seed", "hop").count().collect()
        assert sorted(map(tuple, graph.k_hop_counts(edges, seeds, hops).collect())) == sorted(map(tuple, want))


def test_k_hop_counts_searches_classes(spark):
    """A hub's thousand leaves are one class."""
    edges = spark.range(1000).selectExpr("concat('leaf', id) source_entity_id", "'hub' target_entity_id", "'TRUSTED' lifecycle_state")
    of, sizes, between = graph._classes(edges, edges.select(F.col("source_entity_id").alias("entity_id")), "TRUSTED")
    assert of.count() == 1001 and sorted(r["n"] for r in sizes.collect()) == [1, 1000] and between.count() == 2


def test_rules_are_ranked_once_for_equal_types(spark):
    """Rules meet the different lists of types, never each question."""
    rules = spark.createDataFrame([(f"r{i}", i % 7, i % 5 > 0, [None, [], ["A"], ["B", "C"]][i % 4]) for i in range(40)], "rule_name string, priority int, enabled boolean, applies_to_entity_types array<string>")
    types = [["A"], ["B"], ["A", "C"], ["D"], []]
    asked = spark.createDataFrame([(q, types[q % 5]) for q in range(300)], "query_id int, types array<string>")
    got = retrieval.applicable_rules(asked, rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(types" in plan and "windowspecdefinition(query_id" not in plan
    scopes = {f"r{i}": (i % 7, [None, [], ["A"], ["B", "C"]][i % 4]) for i in range(40) if i % 5}
    want = set()
    for q in range(300):
        fit = sorted((-p, r) for r, (p, scope) in scopes.items() if types[q % 5] and (not scope or set(scope) & set(types[q % 5])))
        want |= {(q, r, i + 1) for i, (_, r) in enumerate(fit[:10])}
    assert {(r["query_id"], r["rule_name"], r["rank"]) for r in got.collect()} == want


def test_k_hop(spark, edges):
    chain = spark.createDataFrame([(str(i), str(i), str(i + 1), "X", 0.5, "TRUSTED") for i in range(4)], R)
    seeds = spark.createDataFrame([("1",)], "entity_id string")
    assert {(r["entity_id"], r["hop"]) for r in graph.k_hop(chain, seeds, 2).collect()} == {("1", 0), ("0", 1), ("2", 1), ("3", 2)}
    # Repeated edges and edges in both directions count once; farther hops take the least number.
    ring = chain.unionByName(chain).unionByName(spark.createDataFrame([("r", "2", "1", "X", 0.5, "TRUSTED")], R))
    far = graph.k_hop(ring, seeds, 4).collect()
    assert sorted((r["entity_id"], r["hop"]) for r in far) == [("0", 1), ("1", 0), ("2", 1), ("3", 2), ("4", 3)]


def test_kept_tables_are_released(spark, sf_dir):
    from sagebrook.plans import registry

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert registry.queries()["fallback_answers"](spark, sf_dir).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


CASES = [
    ("It is 42 units", "42", "", True, 1.0, "exact_match"),
    ("It ran from 2024 to 2027.", "2024-2027", "", True, 1.0, "timeline_match"),
    ("They use Blue gears", "red wheels, blue gears", "Name one of them", True, 1.0, "name_one_match"),
    ("the gears are blue", "red wheels, blue gears", "Name any", True, 0.95, "name_one_words"),
    ("Atlas it was", "Apollo (or Atlas)", "", True, 1.0, "alternative_match"),
    ("There are eighty-two and 100 more", "1,00", "", True, 1.0, "normalized_match"),
    ("The rate was 6.7% in Berlin", "6.67% Berlin", "", True, 1.0, "nums_1/1_words_1/1"),
    ("the documents do not contain it: not found", "[NOT IN DOCUMENTS]", "", True, 1.0, "trick_correct_reject"),
    ("It is four", "[NOT IN DOCUMENTS]", "", False, 0.0, "trick_hallucinated"),
    ("a long and substantive answer", "[Answer depends on document content]", "", True, 0.8, "policy_answered"),
    ("no", "[Answer depends on document content]", "", False, 0.0, "policy_empty"),
    ("That is not supported by the system today", "No, the platform lacks support today", "is the system supported", True, 0.85, "negation_verdict_match"),
    ("xyz", "quite unrelated words here indeed now", "", False, None, "no_match"),
    ("There is no information on that", "quite unrelated words here indeed now", "", False, 0.0, "no_info_found"),
]


@pytest.mark.parametrize("actual, expected, question, passed, score, reason", CASES)
def test_scoring(spark, actual, expected, question, passed, score, reason):
    rows = spark.createDataFrame([(question, expected, actual)], "question string, expected string, actual string")
    got = scoring.score_answers(rows).first()
    assert got["reason"].startswith(reason) and got["pass"] == passed
    assert score is None or got["score"] == pytest.approx(score)


def test_lone_commas_are_no_numbers(spark):
    row = spark.range(1).select(scoring.numbers(F.lit("a, b 1,000.5")).alias("n"), scoring.numbers(F.lit("a, b"), compat=True).alias("c")).first()
    assert row["n"] == ["1000.5"] and row["c"] == [""]


def test_extraction(spark, entities):
    chunks = spark.createDataFrame([("d", 0, "The CoreTeam owns the PayService. PayService uses nothing. PayService depends on PayService.")], "document_id string, chunk_index int, chunk_text string")
    found, linked = extraction.extract(chunks)
    good = extraction.valid_entities(found)
    assert {(r["canonical_name"], r["entity_type"]) for r in good.collect()} == {("CoreTeam", "Team"), ("PayService", "Service")}
    edges = extraction.valid_relationships(linked)
    assert [(r["source_name"], r["relationship_type"], r["target_name"]) for r in edges.collect()] == [("CoreTeam", "OWNS", "PayService")]
    new, new_edges, errors = extraction.stage(resolution.dedup_entities(good.withColumnRenamed("order", "seq")), edges, entities, as_of())
    assert (new.count(), new_edges.count(), errors.count()) == (2, 1, 0)


class Prompted(extraction.PatternExtractor):
    """Like the default, with room for 1200 characters and 20 names."""

    prompted = True

    def entities(self, text):
        assert len(text) <= 1200
        return super().entities(text)

    def relationships(self, text, names):
        assert len(text) <= 1200 and len(names) <= 20
        return super().relationships(text, names)


@pytest.mark.parametrize("extractor", [None, Prompted()])
@pytest.mark.parametrize("end", [".", ""])
def test_extraction_reads_whole_chunks(spark, extractor, end):
    names = [f"{a}{b}Team" for a in "ABCDEF" for b in "abcdefghij"]
    wanted = {(a, "OWNS", b) for a, b in zip(names, names[::-1])}
    text = " ".join(f"then {a} owns the {b}{end} some more words" for a, _, b in sorted(wanted))
    assert len(text) > 2 * 1200
    chunks = spark.createDataFrame([("d", 0, text), ("e", 0, None), ("f", 0, "x" * 200_000 + " ATeam")], "document_id string, chunk_index int, chunk_text string")
    found, linked = extraction.extract(chunks, extractor)
    assert {r["canonical_name"] for r in found.collect()} == {*names, "ATeam"}
    assert {(r["source_name"], r["relationship_type"], r["target_name"]) for r in linked.collect()} == wanted
    assert extraction.extract(chunks, extractor, compat=True)[1].count() < 20


@pytest.mark.parametrize("n", [1, 2, 20, 21, 45])
def test_any_two_names_share_a_group(n):
    groups = extraction.name_groups(list(range(n)), 20)
    assert all(len(g) <= 20 for g in groups)
    assert {(a, b) for g in groups for a in g for b in g} == {(a, b) for a in range(n) for b in range(n)}


def test_validity(spark):
    rows = spark.createDataFrame([("a", "Service|Team", 1.7, None), ("b", "Planet", 0.5, "s"), ("", "Team", 0.5, "s")], "canonical_name string, entity_type string, confidence double, source_sentence string")
    assert [tuple(r) for r in extraction.valid_entities(rows).collect()] == [("a", "Service", 1.0, "")]


def test_inserts(spark, entities, edges):
    new = spark.createDataFrame([("1", "Service", "again"), ("9", "Team", "New"), ("9", "Team", "New")], "entity_id string, entity_type string, name string")
    out = sinks.insert_entities(entities, new, as_of())
    assert ids(out) == ["1", "2", "3", "9"] and out.filter("entity_id = '9'").first()["confidence"] == 0.95
    rows = spark.createDataFrame([("n1", "1", "2", "OWNS"), ("n2", "1", "77", "OWNS")], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string")
    stored, errors = sinks.insert_edges(edges, entities, rows, as_of())
    assert ids(stored, "relationship_id") == ["a1", "n1"] and ids(errors, "relationship_id") == ["n2"]


def test_snapshots(spark, tmp_path, entities):
    at = str(tmp_path / "snapshot")
    sinks.swap(entities, at)
    sinks.swap(spark.read.parquet(at).filter("entity_id <> '1'"), at)
    assert spark.read.parquet(at).count() == 2
    with pytest.raises(ValueError):
        sinks.truncate(spark, at)
    sinks.truncate(spark, at, confirm=True)
    assert spark.read.parquet(at).count() == 0


def test_snapshots_survive_a_stopped_writer(spark, tmp_path, entities):
    at = tmp_path / "snapshot"
    assert sinks.snapshot(spark, str(at)) is None
    sinks.swap(entities, str(at))
    at.rename(f"{at}.old")
    assert sinks.snapshot(spark, str(at)).count() == 3 and at.exists()
    # An older remainder gives way, and what can't be read is no missing snapshot.
    sinks.swap(entities, f"{at}.old")
    sinks.swap(sinks.snapshot(spark, str(at)).filter("entity_id <> '1'"), str(at))
    assert sinks.snapshot(spark, str(at)).count() == 2 and not (tmp_path / "snapshot.old").exists()
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|footer|schema"):
        sinks.snapshot(spark, str(broken)).count()


def test_late_writes_find_their_place(spark, tmp_path):
    from sagebrook.sources.keyed import KeyedTable
    from sagebrook.streaming import state

    schema = "session_id string, key string, value string, agent string, step_number int, created_at timestamp_ntz, expires_at timestamp_ntz, seq long"
    day = dt.timedelta(days=1)
    batches = [[("s", "k", "new", "x", 0, T0 + 2 * day, T0 + 90 * day, 5), ("s", "gone", "v", "x", 0, T0, T0, 6)], [("s", "k", "late", "x", 0, T0 + day, T0 + 90 * day, 3)], [("s", "k", "new", "x", 0, T0 + 2 * day, T0 + 90 * day, 5)]]
    at = str(tmp_path / "state")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.upsert_stream(stream, at, str(tmp_path / "checkpoint"), as_of()).awaitTermination()
        row = KeyedTable(spark, at).read().collect()
        assert [(r["key"], r["value"]) for r in row] == [("k", "new")]
        assert row[0]["created_at"] == T0 + (2 if i == 0 else 1) * day


def test_feedback_by_response(spark, entities):
    records = spark.createDataFrame([(1, "r1", "correct", T0), (2, "r1", "nonsense", T0), (3, "r9", "correct", T0), (4, "r2", "incorrect", T0)], "feedback_id int, response_id string, judgment string, created_at timestamp_ntz")
    responses = spark.createDataFrame([("r1", "b1"), ("r2", "b9")], "response_id string, bundle_id string")
    bundles = spark.createDataFrame([("b1", ["1", "1", "none"])], "bundle_id string, entity_ids array<string>")
    out, errors = folds.feedback_by_response(entities, records, responses, bundles)
    assert {r["entity_id"]: r["n_changes"] for r in out.collect()} == {"1": 1, "2": 0, "3": 0}
    assert {(r["feedback_id"], r["error"]) for r in errors.collect()} == {(2, "unknown judgment"), (3, "unknown response"), (4, "unknown response")}


def test_readers(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "All docs").mkdir(parents=True)
    (folder / "run_book.md").write_text("# A\ntext")
    (folder / "All docs" / "run_book.md").write_text("# A\ntext")
    (folder / "x.bin").write_bytes(b"1")
    got = readers.read_documents(spark, str(folder), recursive=False).collect()
    assert {(r["title"], r["error"] is None) for r in got} == {("run book", True), ("x", False)}
    assert readers.read_corpus(spark, str(folder)).count() == 1
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "question": "a?", "expected_answer": "b"}]}')
    (tmp_path / "l.json").write_text('[{"id": "1", "question": "a?", "expected_answer": "b"}, {"id": "2", "question": "c?", "expected_answer": "d"}]')
    (tmp_path / "q.md").write_text("head\n### Q1\n**Question:** a?\n**Answer:** b\n**Type:** kind\n\n### Q2\n**Question:** only\n")
    assert readers.read_questions(spark, str(tmp_path / "q.json"), "json_questions").count() == 1
    assert readers.read_questions(spark, str(tmp_path / "l.json"), "json_questions").count() == 2
    assert readers.read_questions(spark, str(tmp_path / "l.json"), "json_array").count() == 2
    assert [tuple(r) for r in readers.read_questions(spark, str(tmp_path / "q.md"), "markdown").collect()] == [("1", "a?", "b", "kind", "")]
    with pytest.raises(ValueError):
        readers.read_questions(spark, "x", "yaml")


def test_docx():
    import io
    import zipfile

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>T</w:t></w:r><w:r><w:t>wo</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    assert readers.docx_text(data.getvalue()) == "One\nTwo"


@pytest.mark.parametrize("seed", range(2))
def test_refreshed_pages_equal_full_compilation(spark, seed):
    """Random changes of names, states, confidences and edges, hub pages in several parts."""
    rng = np.random.default_rng(seed)
    kinds, states, names = ["A", "B"], ["TRUSTED", "TRUSTED", "STAGING"], ["Hub", "hub", "x", "y", "Z", None]

    def entity(i):
        return (f"e{i}", str(rng.choice(kinds)), str(rng.choice(states)), int(rng.integers(0, 100)) / 100, f"d{rng.integers(0, 6)}" if i % 5 else None, f"s{i}", names[int(rng.integers(0, len(names)))])

    def edge(i):
        return (f"r{i}", f"e{rng.integers(0, 42)}", f"e{rng.integers(0, 42)}", "X", str(rng.choice(states)), int(rng.integers(0, 100)) / 100)

    e_schema = "entity_id string, entity_type string, lifecycle_state string, confidence double, source_document_id string, source_sentence string, extracted_text string"
    r_schema = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, lifecycle_state string, confidence double"
    was_e, was_r = [entity(i) for i in range(40)], [edge(i) for i in range(120)]
    # Changed, deleted and new ones.
    some = set(rng.choice(40, 4, replace=False).tolist())
    is_e = [entity(i) if i in some else x for i, x in enumerate(was_e) if i != 7] + [entity(40)]
    some_r = set(rng.choice(120, 5, replace=False).tolist())
    is_r = [edge(i) if i in some_r else x for i, x in enumerate(was_r) if i != 9] + [edge(120)]
    frames = [spark.createDataFrame(x, s) for x, s in ((was_e, e_schema), (is_e, e_schema), (was_r, r_schema), (is_r, r_schema))]
    diff_e = spark.createDataFrame([x for x in was_e if x not in is_e] + [x for x in is_e if x not in was_e], e_schema)
    diff_r = spark.createDataFrame([x for x in was_r if x not in is_r] + [x for x in is_r if x not in was_r], r_schema)
    before = wiki.compile_parts(frames[0], frames[2], most=4)
    want = sorted(map(tuple, wiki.compile_parts(frames[1], frames[3], most=4).collect()))
    got = wiki.refresh(before, frames[1], frames[3], diff_e, diff_r, most=4)
    assert sorted(map(tuple, got.collect())) == want and max(r[4] for r in want) == 4 and max(r[3] for r in want) > 1


def test_synthetic(spark):
    small = synthetic.small(spark)
    assert [small[k].count() for k in ("entities", "relationships", "documents", "rules")] == [12, 13, 4, 4]
    big = synthetic.scaled(spark, 20, 30, 5)
    assert big["entities"].count() == 59
    assert big["relationships"].filter("type = 'DEPLOYS_WITH'").count() == 4 * 10


def test_schemas(spark, entities):
    whole = schemas.conform(entities, "entities")
    assert whole.schema == schemas.schema("entities")
    assert whole.filter(schemas.valid("entities")).count() == 3


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_late_changes_fold_like_a_batch(spark, tmp_path, rocksdb):
    """Changes that come in any order over many batches end as if all had come at once."""
    from sagebrook.streaming import state

    rows, deltas = histories(12, 60, seed=9)
    changes = [(e, 7 * i, d, c, s) for e, s, c in rows for i, d in enumerate(deltas[e])]
    schema = "entity_id string, seq long, delta double, confidence double, lifecycle_state string"
    order = np.random.default_rng(1).permutation(len(changes))
    for i, part in enumerate(np.array_split(order, 4)):
        spark.createDataFrame([changes[j] for j in part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    last = {}

    def keep(batch, _):
        last.update({r["entity_id"]: (r["confidence"], r["lifecycle_state"], r["n_changes"]) for r in batch.collect()})

    query = state.fold_stream(stream, width=64).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert last == {e: plain_fold(c, s, deltas[e]) for e, s, c in rows if deltas[e]}


def test_streams(spark, tmp_path, rocksdb):
    from sagebrook.streaming import state

    source = str(tmp_path / "in")
    spark.createDataFrame([("1", 1, -0.2, 0.5, "TRUSTED"), ("1", 2, 0.3, 0.5, "TRUSTED"), ("2", 1, 0.1, 0.5, "STAGING")], "entity_id string, seq int, delta double, confidence double, lifecycle_state string").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = state.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["entity_id"], round(r["confidence"], 6), r["lifecycle_state"]) for r in spark.table("folded").collect()} == {("1", 0.6, "ARCHIVED"), ("2", 0.6, "STAGING")}

    writes = spark.createDataFrame([("s", "k", "a", "x", 0, T0, T0, 1), ("s", "k", "b", "x", 0, T0, T0, 2)], "session_id string, key string, value string, agent string, step_number int, created_at timestamp_ntz, expires_at timestamp_ntz, seq long")
    writes.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(writes.schema).parquet(str(tmp_path / "w"))
    state.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    from sagebrook.sources.keyed import KeyedTable

    assert [r["value"] for r in KeyedTable(spark, str(tmp_path / "state")).read().collect()] == ["b"]


def test_report_and_command_line(spark, tmp_path, capsys):
    import json

    from sagebrook import __main__ as cli

    rows = [{"q_id": "1", "question": "q", "expected": "42", "actual": "it is 42", "category": "a", "difficulty": "Easy", "latency_s": 1.0}, {"q_id": "2", "question": "q", "expected": "[NOT IN DOCUMENTS]", "actual": "four", "category": "a", "difficulty": "hard", "latency_s": 3.0}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    cli.main(["score", str(tmp_path / "a.json"), "--report", str(tmp_path / "r.txt")])
    assert "Pass rate: 50.0%" in (tmp_path / "r.txt").read_text() and "failed 2" in capsys.readouterr().out
    assert json.loads((tmp_path / "r.json").read_text())["summary"]["avg_latency"] == 2.0
    cli.main(["list"])
    assert "hybrid_search" in capsys.readouterr().out


def test_stored_answers(spark, tmp_path):
    bundles = spark.createDataFrame([(1, "q")], "query_id int, query string")
    answers = spark.createDataFrame([(1, "a", 0.5)], "query_id int, answer string, confidence double")
    sinks.store_response(bundles, answers, str(tmp_path / "b"), str(tmp_path / "r"), as_of())
    assert spark.read.parquet(str(tmp_path / "b")).first()["id"] == spark.read.parquet(str(tmp_path / "r")).first()["bundle_id"]
    sinks.store_turn(spark.createDataFrame([("s", "q", "a")], "session_id string, query_text string, response_text string"), str(tmp_path / "t"), as_of())
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_prompts_and_reasoners(spark, sf_dir):
    from sagebrook.plans import pipeline, registry
    from sagebrook.sources.fixtures import Tables

    t = Tables(spark, sf_dir)
    parts = pipeline.context(registry.asked(t), t.entities, t.edges, t.chunks, t.rules, t.sessions)
    prompted = pipeline.prompts(registry.asked(t), parts, t.chunks)
    text = prompted.filter("query_id = 100").first()["prompt"]
    assert text.startswith("# Question") and "## Entities" in text and "## Documents" in text
    got = pipeline.answers(prompted, Echo()).filter("query_id = 100").first()
    assert (got["answer"], got["confidence_level"]) == ("seen", "high")


def test_ingestion_totals(spark, entities, edges):
    from sagebrook.plans import pipeline

    docs = spark.createDataFrame([("d1", "The CoreTeam owns the PayService. PayService uses nothing."), ("d2", None)], "document_id string, text string")
    out = pipeline.ingest(docs, entities, edges, as_of())
    assert {r["metric"]: r["n"] for r in out["totals"].collect()} == {"documents": 2, "chunks": 1, "entities": 2, "relationships": 1, "orphans": 0}
    assert out["entities"].count() == 5 and out["edges"].count() == 2


class Echo:
    def answer(self, prompt):
        return '{"answer": "seen", "confidence": 0.9}'
