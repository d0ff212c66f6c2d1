"""The engine's queries over the domain tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, vector
from ..functions import text as text_
from ..operators import folds, graph, lifecycle, lineage, listing, memory, mentions, resolution, retrieval, scoring, wiki
from ..operators import rules as rules_
from ..sources import sinks
from ..sources.fixtures import AS_OF, Tables
from ..sources.stored import materialize
from . import oracles as oracles_
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

def _query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def as_of():
    return F.expr(AS_OF)


def asked(t: Tables) -> DataFrame:
    """(query_id, query, session_id, vector): every stored vector whose id is divisible by 100, with
    the first question of the conversation of a hundredth of its number."""
    first = t.questions.filter("opening").select("query", "session_id")
    vectors = asked_vectors(t).withColumn("session_id", (F.col("query_id") / 100).cast("long").cast("string"))
    return vectors.join(first, "session_id").select("query_id", "query", "session_id", "vector")


def asked_vectors(t: Tables) -> DataFrame:
    """(query_id, vector): every stored vector whose id is divisible by 100."""
    return t.raw("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def texts(t: Tables) -> DataFrame:
    """(query_id, query): all questions."""
    return t.questions.select("query_id", "query")


def _numbered(df: DataFrame, *order, limit: int, offset: int = 0) -> DataFrame:
    paged = listing.page(df, list(order), limit, offset)
    return paged.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@_query
def entity_list(t):
    found = listing.list_entities(t.entities, "Customer", "customer#0000", min_confidence=0.3)
    return _numbered(found, *listing.by_confidence("entity_id"), limit=50, offset=5).select("entity_id", "confidence", "position")


@_query
def entity_page_total(t):
    return listing.list_entities(t.entities, "Customer", min_confidence=0.3).agg(F.count(F.lit(1)).alias("total"))


@_query
def entity_detail_neighbors(t):
    found = listing.neighbours(t.edges, t.entities, "Nation:7")
    return found.select("relationship_id", "relationship_type", "source_name", "target_name", "confidence")


@_query
def relationship_list(t):
    found = listing.list_relationships(t.edges, t.entities, "Supplier", "Part", "SUPPLIES", 0.5)
    rows = _numbered(found, *listing.by_confidence("relationship_id"), limit=60)
    return rows.select("relationship_id", "source_name", "target_name", "confidence", "position")


@_query
def chunk_list(t):
    found = listing.list_chunks(t.chunks, query="onble", title="en", doc_type="src3")
    return _numbered(found, F.col("document_id"), F.col("chunk_index"), limit=50, offset=2).select("document_id", "chunk_index", "position")


@_query
def document_chunks(t):
    return listing.document_chunks(t.chunks, "d-12").select("chunk_index", "chunk_text")


@_query
def system_stats(t):
    return listing.stats(entities=t.entities, edges=t.edges, chunks=t.chunks, rules=t.rules, feedback=t.feedback, sessions=t.sessions)


@_query
def staging_summary(t):
    return listing.staging_summary(t.entities, t.edges, "doc-3")


@_query
def staging_sample(t):
    return listing.staging_sample(t.entities, "doc-3").select("entity_id", "confidence")


@_query
def keyword_entities(t):
    return retrieval.retrieve_entities(texts(t), t.entities).select("query_id", "entity_id", "confidence", "position")


@_query
def keyword_edges(t):
    return retrieval.retrieve_edges(texts(t), t.edges, t.entities).select("query_id", "relationship_id", "confidence", "position")


@_query
def access_stat_update(t):
    hits = retrieval.access_updates(texts(t), t.entities)
    return retrieval.with_access(t.entities, hits, as_of()).filter(F.col("last_accessed") == as_of()).select("entity_id", "access_count")


@_query
def vector_topk(t):
    found = retrieval.vector_top_k(t.chunks, asked_vectors(t))
    return found.select("query_id", "document_id", "chunk_index", "similarity", "rank")


@_query
def vector_topk_typed(t):
    found = retrieval.vector_top_k(t.chunks, asked_vectors(t), doc_type="src3")
    return found.select("query_id", "document_id", "chunk_index", "similarity", "rank")


@_query
def context_expansion(t):
    hits = retrieval.vector_top_k(t.chunks, asked_vectors(t), k=6)
    return retrieval.expand_context(t.chunks, hits).select("query_id", "document_id", "chunk_index", "doc_rank", "similarity")


@_query
def keyword_chunks(t):
    found = retrieval.keyword_chunks(texts(t), t.chunks)
    return found.select("query_id", "document_id", "chunk_index", "keyword_hits", "similarity", "rank")


@_query
def hybrid_search(t):
    return retrieval.hybrid_search(asked(t).select("query_id", "query"), asked(t).select("query_id", "vector"), t.chunks)


@_query
def applicable_rules(t):
    found = retrieval.retrieve_entities(texts(t), t.entities)
    return retrieval.applicable_rules(retrieval.types_of(found), t.rules).select("query_id", "rule_name", "priority", "rank")


@_query
def session_context(t):
    return retrieval.session_context(t.sessions).select("session_id", "turn", "position")


@_query
def uncertainty_report(t):
    found, links = retrieval.retrieve_entities(texts(t), t.entities), retrieval.retrieve_edges(texts(t), t.edges, t.entities)
    docs = retrieval.keyword_chunks(texts(t), t.chunks)
    report = retrieval.uncertainty(texts(t), found, links, docs)
    return report.withColumns({"low_items": F.concat_ws("|", "low_items"), "reasons": F.concat_ws("|", "reasons")})


@_query
def evidence_chain(t):
    found = retrieval.retrieve_entities(asked(t).select("query_id", "query"), t.entities)
    docs = retrieval.vector_top_k(t.chunks, asked(t).select("query_id", "vector")).withColumnRenamed("rank", "position")
    return retrieval.evidence_chain(found, docs)


@_query
def dup_groups(t):
    groups = resolution.duplicate_groups(t.entities)
    return groups.select(
        "label", "entity_type", F.concat_ws(",", F.transform("members", lambda m: m["id"])).alias("ids"), F.concat_ws(",", "documents").alias("documents"), "n"
    )


@_query
def conflicts(t):
    return lifecycle.conflicts(t.entities)


def _extracted(t: Tables) -> DataFrame:
    """Entities as if extracted, in order of id."""
    return t.entities.select(
        F.col("entity_id").alias("seq"), "entity_type", F.concat(F.lit(" "), F.coalesce("extracted_text", "source_sentence")).alias("canonical_name"),
        "confidence", "source_sentence", F.col("source_document_id").alias("document_id"), F.lit(0).alias("chunk_index"),
    )


@_query
def dedup_entities(t):
    rows = resolution.dedup_entities(_extracted_numbered(t))
    return rows.select("k_type", "k_name", "seq", "canonical_name", "confidence", "source_sentence", "extraction_count")


def _extracted_numbered(t: Tables) -> DataFrame:
    # A number in place of the id: the kind's letter and the key, the repeat after all others.
    key = F.regexp_extract("seq", r":(\d+)", 1).cast("long") * 10
    kind = F.position(F.substring("seq", 1, 1), F.lit("RNSCP")).cast("long") * 10_000_000_000
    return _extracted(t).withColumn("seq", kind + key + F.col("seq").endswith(":dup").cast("long"))


@_query
def dedup_relationships(t):
    named = listing.with_endpoints(t.edges, t.entities)
    rows = named.select(
        (F.regexp_extract("source_entity_id", r":(\d+)", 1).cast("long") * 1_000_000 + F.regexp_extract("target_entity_id", r":(\d+)", 1).cast("long")).alias("seq"),
        F.col("source_type").alias("source_name"), F.lower("relationship_type").alias("relationship_type"), "target_name", "confidence", F.col("relationship_id").alias("source_sentence"),
    )
    return resolution.dedup_relationships(rows).select("k_source", "k_type", "k_target", "seq", "confidence", "source_sentence", "extraction_count")


@_query
def merge_duplicates_entities(t):
    merged, _ = resolution.merge_staging_duplicates(t.entities, t.edges)
    return merged.select("entity_id", "lifecycle_state", F.round("confidence", 6).alias("confidence"), "merged_into", "merge_reason")


@_query
def merge_duplicates_edges(t):
    _, edges = resolution.merge_staging_duplicates(t.entities, t.edges)
    return edges.select("relationship_id", "source_entity_id", "target_entity_id")


@_query
def cross_doc_matches(t):
    return resolution.cross_document_matches(t.entities).select("staging_id", "trusted_id", "staging_document", "trusted_document")


@_query
def cross_doc_resolve(t):
    out, _ = resolution.resolve_cross_document(t.entities, t.edges)
    return out.select("entity_id", "lifecycle_state", F.round("confidence", 6).alias("confidence"), "resolved_into")


def _merged_rounds(t: Tables):
    """(entities, lineage) after two rounds: duplicates merged, then resolved across documents."""
    start = t.entities.withColumns({"conflicts": F.array().cast("array<struct<merged_into:string,reason:string>>"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    one, edges = resolution.merge_staging_duplicates(start, t.edges, as_of=as_of())
    history = lineage.record(lineage.empty(t.spark), one, "merged_into", "dedup_merge", 1)
    two, _ = resolution.resolve_cross_document(one.drop("merged_into", "merge_reason"), edges, as_of=as_of())
    return two, lineage.record(history, two, "resolved_into", "cross_doc_resolution", 2)


@_query
def conflict_history(t):
    entities, _ = _merged_rounds(t)
    steps = F.transform("conflicts", lambda c: F.concat_ws(":", c["reason"], c["merged_into"]))
    return entities.filter(F.size("conflicts") > 0).select("entity_id", "lifecycle_state", F.concat_ws(",", steps).alias("steps"), (F.col("updated_at") == as_of()).alias("updated"))


@_query
def lineage_survivors(t):
    return lineage.survivors(_merged_rounds(t)[1])


@_query
def lineage_edges(t):
    return lineage.lead(t.edges, _merged_rounds(t)[1]).select("relationship_id", "source_entity_id", "target_entity_id")


@_query
def endpoint_validation(t):
    named = t.edges.select("relationship_id", F.col("source_entity_id").alias("source_name"), F.col("target_entity_id").alias("target_name"))
    trusted = t.entities.filter("lifecycle_state = 'TRUSTED'").select(F.col("entity_id").alias("name"))
    return resolution.validate_endpoints(named, trusted)[0].select("relationship_id")


@_query
def orphan_edges(t):
    return resolution.orphan_edges(t.edges, t.entities).select("relationship_id", "missing")


@_query
def name_resolution(t):
    names = t.raw("part").select(F.upper("p_name").alias("name")).union(t.raw("customer").select("c_name")).union(t.spark.createDataFrame([("nobody",)], "name string"))
    return resolution.resolve_names(names, t.entities)


@_query
def promote_bulk(t):
    out, _ = lifecycle.promote_all(t.entities, t.edges)
    return out.select("entity_id", "lifecycle_state")


@_query
def promote_evidence(t):
    out, _, _ = lifecycle.promote_with_evidence(t.entities, t.edges, min_sources=2)
    return out.select("entity_id", "lifecycle_state")


@_query
def evidence_decisions(t):
    return lifecycle.promote_with_evidence(t.entities, t.edges, min_sources=2)[2]


@_query
def promote_edges(t):
    out, edges = lifecycle.promote_all(t.entities, t.edges)
    return edges.select("relationship_id", "lifecycle_state")


@_query
def promote_one(t):
    ids = t.spark.createDataFrame([("Customer:1",), ("Customer:6",), ("Nobody:1",)], "entity_id string")
    return lifecycle.promote(t.entities, ids)[1]


@_query
def demote_one(t):
    ids = t.spark.createDataFrame([("Customer:1",), ("Customer:6",), ("Nobody:1",)], "entity_id string")
    out, _ = lifecycle.demote(t.entities, ids)
    return out.groupBy("lifecycle_state").agg(F.count(F.lit(1)).alias("n"))


@_query
def stale_entities(t):
    return lifecycle.stale(t.entities, F.expr("timestamp_ntz'2024-04-20 00:00:00'")).select("entity_id", "access_count", "last_accessed")


@_query
def feedback_fold(t):
    out = folds.feedback(t.entities, t.feedback).filter("n_changes > 0")
    return out.select("entity_id", "lifecycle_state", F.round("confidence", 6).alias("confidence"), "n_changes")


@_query
def feedback_by_response(t):
    out, _ = folds.feedback_by_response(t.entities, t.response_feedback, t.responses, t.bundles)
    return out.filter("n_changes > 0").select("entity_id", "lifecycle_state", F.round("confidence", 6).alias("confidence"), "n_changes")


@_query
def feedback_records(t):
    severity = F.when(F.col("feedback_id") % 3 == 0, F.lit("major")).when(F.col("feedback_id") % 3 == 1, F.lit("unheard of"))
    given = t.response_feedback.withColumns({"human_correction": F.lit(None).cast("string"), "severity": severity})
    rows = folds.feedback_records(given, t.responses, t.bundles)
    return rows.select("id", "bundle_id", "query_text", "response_text", "judgment", "severity", F.array_join("entities_involved", ",").alias("entities"))


@_query
def feedback_errors(t):
    return folds.feedback_by_response(t.entities, t.response_feedback, t.responses, t.bundles)[1]


@_query
def fileback_fold(t):
    responses = t.raw("events").select(
        F.col("event_id").alias("response_id"), (F.col("event_id") % 10 / 10.0).alias("confidence"),
        F.array(F.concat(F.lit("Customer:"), F.col("user_id")), F.concat(F.lit("Supplier:"), F.col("user_id") % 10)).alias("entity_ids"),
    )
    out = folds.fileback(t.entities, responses).filter("n_changes > 0")
    return out.select("entity_id", F.round("confidence", 6).alias("confidence"), "n_changes")


@_query
def confidence_calibration(t):
    rows = t.feedback.join(t.entities.select("entity_id", "confidence"), "entity_id").withColumn("correct", F.col("judgment") == "correct")
    out = folds.calibration(rows)
    return out.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("predicted", "actual", "gap")])


@_query
def rule_evolution(t):
    return rules_.evolve(t.rules).select("rule_name", "priority", "enabled", "action")


@_query
def rule_validation(t):
    found = retrieval.retrieve_entities(texts(t), t.entities)
    links = retrieval.retrieve_edges(texts(t), t.edges, t.entities)
    applicable = retrieval.applicable_rules(retrieval.types_of(found), t.rules)
    said = texts(t).select("query_id", F.when(F.col("query_id") % 2 == 0, F.lit("A Critical path")).otherwise(F.lit("fine")).alias("answer"))
    return rules_.validate(applicable, said, found, links, "Part", "SUPPLIES")


@_query
def rule_counters(t):
    checks = t.feedback.select(
        F.concat(F.lit("rule-"), F.regexp_extract("entity_id", r":(\d+)", 1)).alias("rule_name"), F.when(F.col("judgment") == "incorrect", F.lit("violation")).otherwise(F.lit("pass")).alias("outcome")
    )
    return rules_.count_checks(t.rules, checks).select("rule_name", "times_applied", "times_violated")


@_query
def owner_violations(t):
    found = retrieval.retrieve_entities(texts(t), t.entities)
    links = retrieval.retrieve_edges(texts(t), t.edges, t.entities)
    return rules_.owner_violations(found, links, "Part", "SUPPLIES")


def _texts_in(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", "text")


@_query
def char_chunks(t):
    chunks = chunking.chunk_by_chars(_texts_in(t), "text")
    return chunks.select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"), F.char_length("chunk_text").alias("chars"))


@_query
def extract_chunks(t):
    chunks = chunking.chunk_by_chars(_texts_in(t), "text", 1000, 100)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("chunk_text")).alias("chars"))


@_query
def sentence_chunks(t):
    return chunking.chunk_by_sentences(_texts_in(t), "text").drop("chunk_text")


@_query
def document_embedding(t):
    docs = t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("type"), F.concat_ws(" ", "lang", "doc_id").alias("title"), F.col("text").alias("content"))
    rows = pipeline.embed_documents(docs)
    return rows.select("document_id", "chunk_index", F.size("embedding").alias("dimension"), F.round(vector.norm(F.col("embedding")), 4).alias("length"))


@_query
def wiki_pages(t):
    return wiki.compile_pages(t.entities, t.edges, documents=t.titles)


@_query
def wiki_page_parts(t):
    return wiki.compile_parts(t.entities, t.edges, documents=t.titles, most=20)


@_query
def wiki_refresh(t):
    """Parts that were compiled before all staged entities of high confidence were promoted, refreshed."""
    before = wiki.compile_parts(t.entities, t.edges, most=20)
    entities, edges = lifecycle.promote_all(t.entities, t.edges, 0.9)
    was, is_ = t.entities, entities

    def changed(a, b, key):
        ids = materialize(a.alias("a").join(b.alias("b"), key).filter("a.lifecycle_state <> b.lifecycle_state").select(key), "changed")
        return a.join(ids, key, "left_semi").unionByName(b.join(ids, key, "left_semi"))

    return wiki.refresh(before, is_, edges, changed(was, is_, "entity_id"), changed(t.edges, edges, "relationship_id"), most=20)


@_query
def wiki_list(t):
    pages = wiki.candidates(t.entities)
    return _numbered(wiki.list_pages(pages, "Part", "ring"), F.col("entity_type"), F.col("title"), limit=20).select("title", "position")


@_query
def wm_upsert(t):
    return memory.upsert(t.memory_writes)


@_query
def wm_get_all(t):
    found = memory.get_all(memory.upsert(t.memory_writes), "7", as_of())
    order = Window.orderBy("step_number", "created_at", "key")
    return found.select("key", "value", "step_number", F.row_number().over(order).alias("position"))


@_query
def wm_delete(t):
    return memory.delete(memory.upsert(t.memory_writes), "7")[1]


@_query
def ttl_cleanup(t):
    return memory.cleanup(memory.upsert(t.memory_writes), as_of())[0].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def cache_lookup(t):
    vectors = t.raw("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    turns = t.sessions.withColumn("vec_id", F.col("session_id").cast("long")).join(vectors, "vec_id", "left")
    cache = turns.select(
        F.concat_ws(":", "session_id", "turn").alias("id"), text_.query_hash(F.col("query_text")).alias("query_hash"), F.col("vector").alias("query_embedding"),
        F.concat(F.lit("answer "), "session_id").alias("response_json"), "created_at", F.expr("created_at + make_dt_interval(cast(vec_id % 40 as int))").alias("expires_at"),
    )
    # Asked again in other letters, or as another question.
    again = F.when(F.col("turn") % 3 == 0, F.translate("query_text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(F.lit("x"), "query_text"))
    asked_ = turns.filter("vector is not null").select(
        (F.col("vec_id") * 1000 + F.col("turn")).alias("query_id"), again.alias("query"), "vector"
    )
    return retrieval.cache_lookup(asked_, cache, as_of())


@_query
def score_answers(t):
    rows = scoring.score(t.answers)
    return rows.select("q_id", "result.pass", F.round("result.score", 6).alias("score"), F.coalesce("result.reason", F.lit("open")).alias("reason"))


@_query
def score_fuzzy(t):
    return scoring.score_answers(t.answers).select("q_id", "pass", F.round("score", 6).alias("score"), "reason")


def _results(t: Tables) -> DataFrame:
    rows = scoring.score(t.answers).withColumns({"pass": F.coalesce("result.pass", F.lit(False)), "score": F.coalesce("result.score", F.lit(0.0))})
    return rows.select("q_id", "category", "difficulty", "latency_s", "pass", "score")


@_query
def eval_summary(t):
    return scoring.summary(_results(t))


@_query
def eval_breakdown(t):
    return scoring.breakdown(_results(t))


@_query
def khop_2(t):
    seeds = t.spark.createDataFrame([("Region:2",), ("Supplier:3",)], "entity_id string")
    return graph.k_hop(t.edges, seeds, 2)


@_query
def khop_suppliers(t):
    """What every supplier reaches in two hops, counted by hop."""
    seeds = t.raw("supplier").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("entity_id"))
    return graph.k_hop_counts(t.edges.filter("relationship_type <> 'SUPPLIES'"), seeds, 2)


@_query
def insert_entities(t):
    new = t.raw("customer").select(
        F.concat(F.lit("Customer:"), F.col("c_custkey") + 500).alias("entity_id"), F.lit("Customer").alias("entity_type"), F.col("c_name").alias("name")
    )
    return sinks.insert_entities(t.entities, new, as_of()).groupBy("entity_type", "lifecycle_state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@_query
def insert_edges(t):
    new = t.raw("orders").select("o_custkey").distinct().select(
        F.concat(F.lit("o>"), "o_custkey").alias("relationship_id"), F.concat(F.lit("Customer:"), "o_custkey").alias("source_entity_id"),
        F.concat(F.lit("Region:"), F.col("o_custkey") % 7).alias("target_entity_id"), F.lit("ORDERS_IN").alias("relationship_type"),
    )
    edges, errors = sinks.insert_edges(t.edges, t.entities, new, as_of())
    return edges.filter("relationship_type = 'ORDERS_IN'").select("relationship_id", F.lit("stored").alias("status")).unionByName(errors.select("relationship_id", F.lit("error").alias("status")))


@_query
def maintenance(t):
    return pipeline.maintenance(t.entities, t.rules, memory.upsert(t.memory_writes), as_of())


def _settled(result: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """A result of few rows, written as a table so that what it was made from can be released."""
    out = materialize(result, "result")
    pipeline.release(parts)
    return out


def _reports(t: Tables) -> DataFrame:
    """Documents after a line about three parts: who owns what, and what that depends on."""
    last = t.raw("part").agg(F.max("p_partkey").alias("last"))
    rows = t.raw("documents").select("doc_id", "text").join(F.broadcast(last))
    for name, times in (("a", 1), ("b", 3), ("c", 7)):
        part = t.raw("part").select(F.col("p_partkey").alias(f"k{name}"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias(name))
        rows = rows.withColumn(f"k{name}", F.col("doc_id") * times % F.col("last") + 1).join(part, f"k{name}")
    line = F.concat(F.lit("The "), "a", F.lit("Team owns the "), "b", F.lit("Service. "), "b", F.lit("Service depends on the "), "c", F.lit("DB.\n"), "text")
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), line.alias("text"))


@_query
def ingest_documents(t):
    out = pipeline.ingest(_reports(t), t.entities, t.edges, as_of())
    count = F.count(F.lit(1)).alias("n")
    entities = out["entities"].groupBy(F.lit("entity").alias("kind"), F.col("entity_type").alias("type"), "lifecycle_state").agg(count)
    edges = out["edges"].groupBy(F.lit("edge").alias("kind"), F.col("relationship_type").alias("type"), "lifecycle_state").agg(count)
    return _settled(entities.unionByName(edges), out)


@_query
def name_mentions(t):
    """Where documents and questions mention parts, nations, or the first words of benchmark items."""
    first = t.raw("benchmark").select(F.regexp_extract("text", r"^\S+\s+\S+\s+\S+", 0).alias("name"))
    names = first.union(t.raw("part").select("p_name")).union(t.raw("nation").select("n_name"))
    texts_ = t.raw("documents").select(F.concat(F.lit("d-"), "doc_id").alias("document_id"), "text")
    asked_ = t.questions.select(F.concat(F.lit("q-"), "query_id").alias("document_id"), F.col("query").alias("text"))
    return mentions.mentions(texts_.union(asked_), names)


def _bundle(t: Tables) -> DataFrame:
    parts = pipeline.context(asked(t), t.entities, t.edges, t.chunks, t.rules, t.sessions)
    return _settled(pipeline.bundle(asked(t), parts), parts)


@_query
def context_bundle(t):
    return _bundle(t)


@_query
def fallback_answers(t):
    parts = pipeline.context(asked(t), t.entities, t.edges, t.chunks, t.rules, t.sessions)
    out = pipeline.answers(pipeline.prompts(asked(t), parts, t.chunks))
    return _settled(out.select("query_id", "answer", "confidence", "confidence_level"), parts)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return oracles_.oracles()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(Tables(spark, sf_dir))
