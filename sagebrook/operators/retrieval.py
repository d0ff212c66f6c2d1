"""Retrieval over entities, edges, chunks, rules and sessions.

Queries are a DataFrame (query_id, query), so any number of questions share each scan.  Only
its keywords and phrases, a few per query, meet the corpus: up to NEEDLES different ones are
searched for in one pass that lower-cases a text once, and more by the words that they are made of.
A needle's best rows are kept before the questions that share it are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions import text
from ..sources.stored import materialize
from . import keywords, nearest
from .listing import display_name, with_endpoints

QUERY_ROWS = 20_000
#: The most different needles that one pass over texts looks for.
NEEDLES = 100


#: The part of the edges, the surest ones, that is searched first.
EDGE_SHARE = 64


def within_bounds(df: DataFrame) -> bool:
    return df.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS


def small_side(df: DataFrame, bounded: bool | None = None) -> DataFrame:
    """``df`` broadcast if it is within bounds.  A caller that has counted the queries says so
    by ``bounded``: what is kept of each query is at most a constant number of rows."""
    return F.broadcast(df) if (within_bounds(df) if bounded is None else bounded) else df


def _needles(queries: DataFrame, list_: Column, limit: int) -> DataFrame:
    """(query_id, pos, needle): the first ``limit`` of a list."""
    return queries.select("query_id", F.posexplode(F.slice(list_, 1, limit)).alias("pos", "needle"))


def words_of(needles: DataFrame) -> list[str] | None:
    """The different needles, or None where they are too many to be spelt out in a plan."""
    words = [r[0] for r in needles.select("needle").distinct().limit(NEEDLES + 1).collect()]
    return sorted(words) if len(words) <= NEEDLES else None


def found_words(fields: list[Column], words: list[str]) -> Column:
    """Those of the words (in lower case) that one of the fields contains; a null field is empty."""
    all_ = F.lit(words) if words else F.array().cast("array<string>")
    # A list of one entry, so that the lower-cased fields are made once a row.
    lowered = F.array(F.struct(*[F.lower(F.coalesce(f, F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)]))

    def hit(row: Column, needle: Column) -> Column:
        out = F.lit(False)
        for i in range(len(fields)):
            out = out | F.contains(row[f"f{i}"], needle)
        return out

    return F.flatten(F.transform(lowered, lambda row: F.filter(all_, lambda needle: hit(row, needle))))


def containing(rows: DataFrame, fields: list[Column], needles: DataFrame, words: list[str] | None) -> DataFrame:
    """``rows`` once for each of the different ``needles`` (needle, in lower case) that one of the
    fields contains.  ``words`` are these needles where a plan spells them out; more
    are looked for in an index that is made for them."""
    if words is None:
        return keywords.build(rows, fields).hits(needles)
    return rows.withColumn("needle", F.explode(found_words(fields, words)))


def first_containing(rows: DataFrame, fields: list[Column], needles: DataFrame, words: list[str] | None, order: list[Column], n: int) -> DataFrame:
    """Of ``containing`` the first n rows of each needle in ``order``, with their ``rank``."""
    if words is None:
        return keywords.build(rows, fields, order).first(needles, n)
    return _top(containing(rows, fields, needles, words), order, n, "needle")


def _top(df: DataFrame, order: list[Column], n: int, *by: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def entity_matches(queries: DataFrame, entities: DataFrame, config: Config = CONFIG, bounded: bool | None = None) -> DataFrame:
    """Trusted entities by keyword, at most so many each: rows (query_id, pos, rank, ...)."""
    needles = _needles(queries, text.entity_keywords(F.col("query")), config.max_keywords)
    trusted = entities.filter("lifecycle_state = 'TRUSTED'")
    order = [F.col("confidence").desc(), F.col("access_count").desc(), F.col("entity_id")]
    fields = [F.col("extracted_text"), F.col("source_sentence")]
    # Ranked once a needle, before the questions that share it are joined.
    best = first_containing(trusted, fields, needles, words_of(needles), order, config.entities_per_keyword)
    return best.join(small_side(needles, bounded), "needle")


def _merged(matches: DataFrame, key: str, n: int) -> DataFrame:
    """Matches of all keywords in order, each row once, the first n."""
    once = _top(matches, [F.col("pos"), F.col("rank")], 1, "query_id", key, name="seen").drop("seen")
    return _top(once, [F.col("pos"), F.col("rank")], n, "query_id", name="position").drop("pos", "rank", "needle")


def retrieve_entities(queries: DataFrame, entities: DataFrame, config: Config = CONFIG, bounded: bool | None = None) -> DataFrame:
    return _merged(entity_matches(queries, entities, config, bounded), "entity_id", config.entities_per_keyword)


def access_updates(queries: DataFrame, entities: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(entity_id, hits): one access for every keyword that found the entity."""
    return entity_matches(queries, entities, config).groupBy("entity_id").agg(F.count(F.lit(1)).alias("hits"))


def with_access(entities: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """Entities with their access statistics brought up to date."""
    joined = entities.join(hits, "entity_id", "left")
    return joined.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("hits", F.lit(0)).cast("int"),
            "last_accessed": F.when(F.col("hits") > 0, as_of).otherwise(F.col("last_accessed")),
        }
    ).drop("hits")


def retrieve_edges(queries: DataFrame, edges: DataFrame, entities: DataFrame, config: Config = CONFIG, bounded: bool | None = None) -> DataFrame:
    """Trusted edges with a keyword in their type or in the name of an end.

    Names are searched once an entity.  Edges are searched from the surest on, in two stretches: most
    keywords that are in many names are done with the first, and of the other edges only those meet
    their ends that have an open keyword.
    """
    needles = materialize(_needles(queries, text.entity_keywords(F.col("query")), config.max_keywords), "needles")
    words = words_of(needles)
    trusted = edges.filter("lifecycle_state = 'TRUSTED'")
    named = containing(entities.select("entity_id", display_name().alias("__name")), [F.col("__name")], needles, words).select("entity_id", "needle")
    kinds = containing(trusted.select("relationship_type").distinct(), [F.col("relationship_type")], needles, words)
    named, kinds = materialize(named, "named"), materialize(kinds, "kinds")
    order, n = [F.col("confidence").desc(), F.col("relationship_id")], config.edges_per_keyword
    sure = trusted.agg(F.percentile_approx("confidence", 1 - 1 / EDGE_SHARE)).first()[0]
    if sure is None:
        parts = [trusted]
    else:
        # An edge without a confidence comes last.
        parts = [trusted.filter(F.col("confidence") >= sure), trusted.filter((F.col("confidence") < sure) | F.col("confidence").isNull())]
    best = None
    for i, part in enumerate(parts):
        hits = _edges_with(part, named, kinds)
        found = _top(with_endpoints(hits, entities).withColumn("needle", F.explode("__words")).drop("__words"), order, n, "needle")
        found = materialize(found, "edge-hits")
        best = found if best is None else best.unionByName(found)
        if i + 1 < len(parts):
            done = materialize(found.groupBy("needle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n).select("needle"), "needles-done")
            named, kinds = materialize(named.join(done, "needle", "left_anti"), "named"), materialize(kinds.join(done, "needle", "left_anti"), "kinds")
    best = _top(best.drop("rank"), order, n, "needle")
    # The keywords of a question are brought together once; the windows over it take no further shuffle.
    matches = best.join(small_side(needles, bounded), "needle").repartition("query_id")
    return _merged(matches, "relationship_id", n)


def _edges_with(edges: DataFrame, named: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges with the needles (``__words``) of their type by ``kinds`` (relationship_type, needle), or of an
    end by ``named`` (entity_id, needle); edges without any are left out."""
    names = named.groupBy("entity_id").agg(F.collect_set("needle").alias("__set"))
    names = small_side(materialize(names, "names"))
    types = kinds.groupBy("relationship_type").agg(F.collect_set("needle").alias("__of_type"))
    hits = edges.join(F.broadcast(types), "relationship_type", "left")
    for end in ("source", "target"):
        hits = hits.join(names.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("__set").alias(f"__of_{end}")), f"{end}_entity_id", "left")
    none = F.array().cast("array<string>")
    of = ("__of_type", "__of_source", "__of_target")
    words = F.array_distinct(F.concat(*[F.coalesce(c, none) for c in of]))
    return hits.withColumn("__words", words).filter(F.size("__words") > 0).drop(*of)


def vector_table(chunks: DataFrame, doc_type: str | None = None) -> nearest.VectorTable:
    """The stored table that ``vector_top_k`` searches, of all chunks or of one type."""
    rows = chunks if doc_type is None else chunks.filter(F.col("document_type") == doc_type)
    rows = rows.select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")
    return nearest.build(rows, "embedding", ["document_id", "chunk_index"])


def vector_top_k(
    chunks: DataFrame, vectors: DataFrame, k: int = CONFIG.vector_top_k, doc_type: str | None = None, table: nearest.VectorTable | None = None
) -> DataFrame:
    """(query_id, document_id, chunk_index, similarity, rank): the k chunks nearest to each
    query vector (query_id, vector).  A stored ``table`` of the chunks saves making one."""
    table = vector_table(chunks, doc_type) if table is None else table
    order = [("document_id", "ascending"), ("chunk_index", "ascending")]
    return table.near(vectors, k, order, ["document_id", "chunk_index"])


def expand_context(chunks: DataFrame, hits: DataFrame, config: Config = CONFIG, bounded: bool | None = None) -> DataFrame:
    """All other chunks of the first documents among ``hits``, at a fraction of the
    similarity of their document's best hit: (query_id, doc_rank, ...)."""
    per = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("best"), F.max("similarity").alias("doc_similarity"))
    first = _top(per, [F.col("best")], config.expanded_documents, "query_id", name="doc_rank")
    there = chunks.drop("embedding").join(small_side(first.select("query_id", "document_id", "doc_rank", "doc_similarity"), bounded), "document_id")
    known = hits.select("query_id", "document_id", "chunk_index")
    fresh = there.join(small_side(known, bounded), ["query_id", "document_id", "chunk_index"], "left_anti")
    return fresh.withColumn("similarity", F.round(F.col("doc_similarity") * config.expansion_factor, 6)).drop("doc_similarity")


def _sided(words: Column, side: str) -> Column:
    return F.transform(words, lambda w: F.struct(F.lit(side).alias("side"), w.alias("needle")))


def keyword_chunks(queries: DataFrame, chunks: DataFrame, k: int = CONFIG.keyword_results, config: Config = CONFIG, bounded: bool | None = None) -> DataFrame:
    """Chunks by weighted hits of phrases, keywords and title words: the best k, with rank."""
    words = text.search_keywords(F.col("query"))
    kinds = [
        (text.search_phrases(F.col("query")), config.max_phrases, config.rows_per_phrase, config.phrase_weight, "text"),
        (words, config.max_search_keywords, config.rows_per_keyword, config.keyword_weight, "text"),
        (words, config.max_title_keywords, config.rows_per_title, config.title_weight, "title"),
    ]
    needles = None
    for i, (list_, limit, rows, weight, where) in enumerate(kinds):
        part = _needles(queries.filter(F.size(words) > 0), list_, limit).select(
            "query_id", F.lit(i).alias("kind"), "pos", "needle", F.lit(rows).alias("rows"), F.lit(weight).alias("weight"), F.lit(where).alias("side")
        )
        needles = part if needles is None else needles.unionByName(part)
    needles = materialize(needles, "needles")
    words, sides = words_of(needles), (("text", "chunk_text"), ("title", "document_title"))
    # Without an order of their own, the rows of a needle are the first by document and place.
    order = [F.col("document_id"), F.col("chunk_index")]
    most = max(rows for _, _, rows, _, _ in kinds)
    if words is None:
        first = None
        for side, column in sides:
            slim = chunks.select("document_id", "chunk_index", column)
            part = first_containing(slim, [F.col(column)], needles.filter(F.col("side") == side), None, order, most).drop(column).withColumn("side", F.lit(side))
            first = part if first is None else first.unionByName(part)
    else:
        # Texts and titles in one pass over the chunks.
        found = F.concat(*[_sided(found_words([F.col(column)], words), side) for side, column in sides])
        hits = chunks.select("document_id", "chunk_index", F.explode(found).alias("f")).select("document_id", "chunk_index", "f.*")
        first = _top(hits, order, most, "side", "needle")
    # A needle's rows stay one list until the questions that share it are dealt out.
    lists = first.groupBy("side", "needle").agg(F.collect_list(F.struct("rank", "document_id", "chunk_index")).alias("found"))
    given = lists.join(small_side(needles, bounded), ["side", "needle"]).select("query_id", "rows", "weight", "found").repartition("query_id")
    kept = given.select("query_id", "rows", "weight", F.inline("found")).filter("rank <= rows")
    scores = kept.groupBy("query_id", "document_id", "chunk_index").agg(F.sum("weight").cast("long").alias("keyword_hits"))
    best = F.max("keyword_hits").over(Window.partitionBy("query_id"))
    likeness = F.least(F.lit(0.5) + F.lit(0.4) * F.col("keyword_hits") / F.greatest(best, F.lit(1)), F.lit(0.85))
    scored = scores.withColumn("similarity", F.round(likeness, 6))
    return _top(scored, [F.col("keyword_hits").desc(), F.col("document_id"), F.col("chunk_index")], k, "query_id")


def hybrid_search(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = CONFIG.vector_top_k, config: Config = CONFIG, bounded: bool | None = None, table: nearest.VectorTable | None = None) -> DataFrame:
    """Vector hits, their documents' context, and keyword hits that neither has, in order of
    ``position``: expanded documents first, then other hits, then keyword hits."""
    bounded = within_bounds(queries) if bounded is None else bounded
    # A few rows a question, read by all that follows.
    hits = materialize(vector_top_k(chunks, vectors, k, table=table), "hits")
    context = expand_context(chunks, hits, config, bounded)
    per = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("best"))
    ranks = _top(per, [F.col("best")], config.expanded_documents, "query_id", name="doc_rank").drop("best")
    key = ["query_id", "document_id", "chunk_index"]
    found = hits.select(*key, "similarity").join(ranks, ["query_id", "document_id"], "left")
    merged = found.unionByName(context.select(*key, "similarity", "doc_rank")).withColumn(
        "section", F.when(F.col("doc_rank").isNotNull(), F.lit(0)).otherwise(F.lit(1))
    )
    extra = keyword_chunks(queries, chunks, config.keyword_results, config, bounded).select(*key, "similarity", F.col("rank").alias("doc_rank"))
    extra = extra.join(merged.select(*key), key, "left_anti").withColumn("section", F.lit(2))
    everything = merged.unionByName(extra)
    inner = F.when(F.col("section") == 0, F.col("chunk_index"))
    order = Window.partitionBy("query_id").orderBy(
        "section", F.col("doc_rank").asc_nulls_last(), inner, F.col("similarity").desc(), "document_id", "chunk_index"
    )
    return everything.withColumn("position", F.row_number().over(order)).select(*key, "similarity", "section", "position")


def applicable_rules(bundle_types: DataFrame, rules: DataFrame, config: Config = CONFIG, bounded: bool | None = None) -> DataFrame:
    """Enabled rules whose scope is open or shares a type with (query_id, types).

    Questions with the same types have the same rules, so rules are ranked once for each different
    list of types, and the few that are kept are joined to its questions on equal lists."""
    scope = F.col("applies_to_entity_types")
    open_ = scope.isNull() | (F.size(scope) == 0)
    fits = F.coalesce(F.arrays_overlap(scope, F.col("types")), F.lit(False)) | open_
    asked = bundle_types.filter(F.size("types") > 0)
    joined = rules.filter("enabled").join(F.broadcast(asked.select("types").distinct()), fits)
    best = _top(joined, [F.col("priority").desc(), F.col("rule_name")], config.max_rules, "types")
    return best.join(small_side(asked, bounded), "types").drop("types")


def types_of(entities: DataFrame) -> DataFrame:
    """(query_id, types) of retrieved entities."""
    return entities.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_type")).alias("types"))


def session_context(sessions: DataFrame, n: int = CONFIG.session_turns) -> DataFrame:
    """The last n turns of every session, numbered oldest first."""
    last = _top(sessions, [F.col("created_at").desc(), F.col("turn").desc()], n, "session_id", name="back")
    order = Window.partitionBy("session_id").orderBy("created_at", "turn")
    return last.withColumn("position", F.row_number().over(order)).drop("back")


def tier(confidence: Column, config: Config = CONFIG) -> Column:
    return (
        F.when(confidence >= config.confidence_high, F.lit("high")).when(confidence >= config.confidence_medium, F.lit("medium")).otherwise(F.lit("low"))
    )


def confidence_level(confidence: Column, config: Config = CONFIG) -> Column:
    """The four-step label of an answer's confidence."""
    return (
        F.when(confidence >= config.confidence_high, F.lit("high"))
        .when(confidence >= config.confidence_medium, F.lit("medium"))
        .when(confidence >= config.confidence_low, F.lit("low"))
        .otherwise(F.lit("very_low"))
    )


def uncertainty(queries: DataFrame, entities: DataFrame, edges: DataFrame, documents: DataFrame, config: Config = CONFIG) -> DataFrame:
    """One row per query: facts by tier, weighted confidence, recommendation, reasons, and
    the first few uncertain entities."""
    facts = entities.select("query_id", F.lit("entity").alias("kind"), "confidence", "position", "entity_type", "entity_id").unionByName(
        edges.select("query_id", F.lit("edge").alias("kind"), "confidence"), allowMissingColumns=True
    )
    facts = facts.unionByName(documents.select("query_id", F.lit("document").alias("kind")), allowMissingColumns=True)
    rated = F.col("kind") != "document"
    level = tier(F.coalesce("confidence", F.lit(0.5)), config)
    low = F.when(
        (F.col("kind") == "entity") & (level == "low"),
        F.struct("position", F.concat(F.lit("Entity: "), "entity_type", F.lit(" (ID: "), "entity_id", F.lit(")")).alias("fact"), "confidence"),
    )
    counted = facts.groupBy("query_id").agg(
        *[F.count_if(rated & (level == t)).alias(t) for t in ("high", "medium", "low")],
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("entity", "edge", "document")],
        F.slice(F.array_sort(F.collect_list(low)), 1, config.max_low_items).alias("low_items"),
    )
    whole = queries.select("query_id").join(counted, "query_id", "left").fillna(0)
    total = F.col("high") + F.col("medium") + F.col("low")
    weights = config.tier_weights
    weighted = F.col("high") * weights[0] + F.col("medium") * weights[1] + F.col("low") * weights[2]
    overall = F.coalesce(F.try_divide(weighted, total.cast("double")), F.lit(0.0))
    advice = (
        F.when(total == 0, F.lit("insufficient_context"))
        .when(overall >= config.confidence_high, F.lit("proceed"))
        .when(overall >= config.confidence_low, F.lit("caution"))
        .otherwise(F.lit("insufficient_context"))
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_entity") == 0, F.lit("No matching entities found in knowledge graph")),
            F.when((F.col("n_edge") == 0) & (F.col("n_entity") > 0), F.lit("Entities found but no relationships - limited context")),
            F.when(F.col("n_document") == 0, F.lit("No similar documents found in episodic memory")),
        )
    )
    return whole.select(
        "query_id",
        F.round(overall, 6).alias("overall_confidence"),
        advice.alias("recommendation"),
        F.col("high").alias("high_facts"),
        F.col("medium").alias("medium_facts"),
        F.col("low").alias("low_facts"),
        F.coalesce(F.transform("low_items", lambda s: s["fact"]), F.array().cast("array<string>")).alias("low_items"),
        reasons.alias("reasons"),
    )


def evidence_chain(entities: DataFrame, documents: DataFrame, config: Config = CONFIG) -> DataFrame:
    """The first few entities and documents of each query that are certain enough."""
    sure = config.evidence_confidence
    facts = entities.filter((F.col("position") <= config.evidence_entities) & (F.col("confidence") >= sure)).select(
        "query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("source"), F.col("position"), "confidence"
    )
    texts = documents.filter((F.col("position") <= config.evidence_documents) & (F.col("similarity") >= sure)).select(
        "query_id", F.lit("document").alias("kind"), F.concat_ws("#", "document_id", "chunk_index").alias("source"), F.col("position"), F.col("similarity").alias("confidence")
    )
    return facts.unionByName(texts)


def near_entries(asked: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """(query_id, near): the nearest of ``entries`` (query_embedding, created_at, id,
    response_json) to each ``asked`` (query_id, vector) with cosine ``least`` or more, the newest
    of equally near ones.

    Equal vectors are one row on both sides; only cells within reach of a query are searched.
    """
    newest = F.max(F.struct("created_at", "id", "response_json")).alias("e")
    there = entries.groupBy("query_embedding").agg(newest).select("query_embedding", "e.*")
    table = nearest.build(there, "query_embedding", ["created_at", "id"], "cache")
    wanted = asked.select("vector").distinct().withColumn("query_id", F.col("vector"))
    fields = ["created_at", "id", "response_json"]
    found = table.near(wanted, 1, [(c, "descending") for c in fields], fields, least)
    best = found.select(F.col("query_id").alias("vector"), F.struct("response_json", "similarity").alias("near"))
    return asked.join(best, "vector").select("query_id", "near")


def cache_lookup(queries: DataFrame, cache: DataFrame, as_of: Column, config: Config = CONFIG) -> DataFrame:
    """For each (query_id, query, vector): the newest live entry of the same query, else the
    nearest live entry by vector if it is near enough.  Only queries without the first look
    for the second; vectors that are zero or not finite are near to nothing."""
    live = cache.filter(F.col("expires_at") > as_of)
    asked = queries.withColumn("query_hash", text.query_hash(F.col("query")))
    exact = live.groupBy("query_hash").agg(F.max_by("response_json", F.struct("created_at", "id")).alias("exact"))
    found = asked.join(exact, "query_hash", "left")
    best = near_entries(found.filter("exact is null").select("query_id", "vector"), live, config.cache_similarity)
    joined = found.join(best, "query_id", "left")
    return joined.select(
        "query_id",
        F.when(F.col("exact").isNotNull(), F.lit("exact")).when(F.col("near").isNotNull(), F.lit("semantic")).otherwise(F.lit("miss")).alias("hit"),
        F.coalesce("exact", "near.response_json").alias("response_json"),
        F.when(F.col("exact").isNotNull(), F.lit(1.0)).otherwise(F.col("near.similarity")).alias("similarity"),
    )
