"""Entity pages in parts of a bounded size, compiled for all entities in one job or, after changes,
for the pages that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains
from ..sources.stored import materialize
from .listing import all_of, display_name
from .places import numbered


def candidates(entities: DataFrame, type_: str | None = None) -> DataFrame:
    """The distinct (entity_type, title) that pages are made for."""
    named = entities.filter("lifecycle_state = 'TRUSTED' and extracted_text is not null")
    if type_ is not None:
        named = named.filter(F.col("entity_type") == type_)
    return named.select("entity_type", F.col("extracted_text").alias("title")).distinct()


#: Lines of one part of a page.
PART_LINES = 500
KEY = ["entity_type", "k"]


def _members(entities: DataFrame) -> DataFrame:
    """The entities that pages are about, with the key of their page."""
    named = entities.filter("lifecycle_state = 'TRUSTED' and extracted_text is not null")
    return named.select("entity_id", "entity_type", "extracted_text", F.lower("extracted_text").alias("k"), "confidence", "source_document_id")


def _parted(lines: DataFrame, order: list[Column], section: str, most: int) -> DataFrame:
    """(entity_type, k, section, part, n_lines, text) of (entity_type, k, line, ...) in an order:
    a page's lines, ``most`` in a row."""
    placed = numbered(lines, KEY, order, f"page-{section}")
    parts = placed.groupBy(*KEY, F.expr(f"pos div {most}").cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines")
    )
    return parts.select(*KEY, F.lit(section).alias("section"), "part", "n_lines", F.array_join("lines.line", "\n").alias("text"))


def compile_parts(
    entities: DataFrame, edges: DataFrame, type_: str | None = None, documents: DataFrame | None = None, only: DataFrame | None = None, most: int = PART_LINES
) -> DataFrame:
    """(entity_type, title, section, part, n_lines, text): pages in parts of a bounded size.

    A page covers the trusted entities of its type with its name, whatever their case, and
    the trusted edges at them; an arrow leads away from an entity of the page.  Sources are
    named by their titles in ``documents`` (document_id, title), or else by their ids.  The sections
    are facts, relationships and sources, in this order; the latter two have as many parts as they
    need, or none.  ``only`` (entity_type, k) limits the work to these pages, k being the title in
    lower case.
    """
    members = _members(entities)
    if type_ is not None:
        members = members.filter(F.col("entity_type") == type_)
    if only is not None:
        members = members.join(only.select(*KEY).distinct(), KEY, "left_semi")
    facts = members.groupBy(*KEY).agg(F.round(F.avg("confidence"), 6).alias("confidence_avg"), F.count(F.lit(1)).alias("n_entities"))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Type: "), "entity_type"),
        F.concat(F.lit("Confidence: "), F.floor(F.col("confidence_avg") * 100 + 0.5).cast("string"), F.lit("%")),
        F.concat(F.lit("Entities: "), F.col("n_entities").cast("string")),
    )
    facts = facts.select(*KEY, F.lit("facts").alias("section"), F.lit(0).alias("part"), F.lit(3).cast("long").alias("n_lines"), head.alias("text"))
    relationships = _parted(_lines(members, entities, edges), [F.col("confidence").desc(), F.col("relationship_id")], "relationships", most)
    sources = _sources(members, documents).withColumn("line", F.concat(F.lit("- "), "shown"))
    sources = _parted(sources, [F.col("source_document_id")], "sources", most)
    titles = members.select("entity_type", "k", F.col("extracted_text").alias("title")).distinct()
    parts = facts.unionByName(relationships).unionByName(sources)
    return titles.join(parts, KEY).select("entity_type", "title", "section", "part", "n_lines", "text")


def _sources(members: DataFrame, documents: DataFrame | None) -> DataFrame:
    """(entity_type, k, source_document_id, shown): the documents of each page, each once."""
    found = members.filter("source_document_id is not null").select(*KEY, "source_document_id").distinct()
    if documents is None:
        return found.withColumn("shown", F.col("source_document_id"))
    titles = documents.groupBy(F.col("document_id").alias("source_document_id")).agg(F.min("title").alias("shown"))
    return found.join(titles, "source_document_id", "left").withColumn("shown", F.coalesce("shown", "source_document_id"))


def _lines(members: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_type, k, relationship_id, confidence, line): the edges at each page, each once; one
    with both ends on the page leads away."""
    names = entities.select(F.col("entity_id").alias("other_id"), display_name().alias("other"))
    live = edges.filter("lifecycle_state = 'TRUSTED'").select("relationship_id", "source_entity_id", "target_entity_id", "relationship_type", "confidence")
    out = live.select("*", F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("other_id"), F.lit("->").alias("arrow"))
    back = live.select("*", F.col("target_entity_id").alias("entity_id"), F.col("source_entity_id").alias("other_id"), F.lit("<-").alias("arrow"))
    touching = out.unionByName(back).join(members.select("entity_id", *KEY), "entity_id")
    once = touching.groupBy(*KEY, "relationship_id").agg(F.max(F.struct("arrow", "relationship_type", "other_id", "confidence")).alias("e"))
    line = F.concat_ws(" ", F.lit("-"), "arrow", F.concat(F.lit("**"), "relationship_type", F.lit("**")), "other")
    return once.select(*KEY, "relationship_id", "e.*").join(names, "other_id").select(*KEY, "relationship_id", "confidence", line.alias("line"))


def touched(entities: DataFrame, edges: DataFrame, changed_entities: DataFrame, changed_edges: DataFrame) -> DataFrame:
    """(entity_type, k): the pages that changes can alter.  ``changed_entities`` and
    ``changed_edges`` hold the changed rows as they were and as they are; ``entities`` and ``edges``
    are the tables as they are."""
    ids = changed_entities.select("entity_id")
    ends = [changed_edges.select(F.col(f"{e}_entity_id").alias("entity_id")) for e in ("source", "target")]
    # A changed entity is named on the pages of its neighbours.
    near = [
        edges.join(ids.distinct(), edges[f"{a}_entity_id"] == ids["entity_id"], "left_semi").select(F.col(f"{b}_entity_id").alias("entity_id"))
        for a, b in (("source", "target"), ("target", "source"))
    ]
    there = ends[0].unionByName(ends[1]).unionByName(near[0]).unionByName(near[1]).distinct()
    by_id = _members(entities).join(there, "entity_id", "left_semi").select(*KEY)
    own = changed_entities.filter("extracted_text is not null").select("entity_type", F.lower("extracted_text").alias("k"))
    return by_id.unionByName(own).distinct()


def refresh(
    parts: DataFrame, entities: DataFrame, edges: DataFrame, changed_entities: DataFrame, changed_edges: DataFrame, documents: DataFrame | None = None, most: int = PART_LINES
) -> DataFrame:
    """Stored ``parts`` brought up to date: only the pages that changes touch are compiled."""
    pages = materialize(touched(entities, edges, changed_entities, changed_edges), "pages-touched")
    gone = pages.select("entity_type", F.col("k").alias("__k"))
    same = (parts["entity_type"] == gone["entity_type"]) & (F.lower(parts["title"]) == gone["__k"])
    return parts.join(gone, same, "left_anti").unionByName(compile_parts(entities, edges, documents=documents, only=pages, most=most))


def compile_pages(entities: DataFrame, edges: DataFrame, type_: str | None = None, documents: DataFrame | None = None, most: int = PART_LINES) -> DataFrame:
    """(entity_type, title, confidence_avg, n_entities, n_edges, n_sources, markdown).

    The whole text of each page in one row, of its parts (``compile_parts``); a page of a great many
    edges is better read in parts.
    """
    pages = candidates(entities, type_).withColumn("k", F.lower("title"))
    members = _members(entities)
    facts = members.groupBy(*KEY).agg(F.round(F.avg("confidence"), 6).alias("confidence_avg"), F.count(F.lit(1)).alias("n_entities"))
    lines = _parted(_lines(members, entities, edges), [F.col("confidence").desc(), F.col("relationship_id")], "relationships", most)
    sources = _sources(members, documents).withColumn("line", F.concat(F.lit("- "), "shown"))
    sources = _parted(sources, [F.col("source_document_id")], "sources", most)

    def whole(parts: DataFrame, n: str, text: str) -> DataFrame:
        joined = F.array_join(F.array_sort(F.collect_list(F.struct("part", "text")))["text"], "\n")
        return parts.groupBy(*KEY).agg(F.sum("n_lines").alias(n), joined.alias(text))

    joined = pages.join(facts, KEY).join(whole(lines, "n_edges", "lines"), KEY, "left").join(whole(sources, "n_sources", "shown"), KEY, "left")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "title"),
        F.concat(F.lit("Type: "), "entity_type"),
        F.concat(F.lit("Confidence: "), F.floor(F.col("confidence_avg") * 100 + 0.5).cast("string"), F.lit("%")),
        F.lit("## Relationships"),
        F.coalesce("lines", F.lit("None")),
        F.lit("## Sources"),
        F.coalesce("shown", F.lit("")),
    )
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_edges", "n_sources")]
    return joined.select("entity_type", "title", "confidence_avg", "n_entities", *counts, body.alias("markdown"))


def upsert_pages(pages: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """Stored pages with fresh ones in their place; the time of creation stays."""
    key = ["entity_type", "title"]
    old = pages.select(*key, F.col("markdown").alias("o_markdown"), F.col("confidence_avg").alias("o_avg"), F.col("created_at").alias("o_created"), F.col("updated_at").alias("o_updated"))
    joined = old.join(fresh.select(*key, "markdown", "confidence_avg").withColumn("new", F.lit(True)), key, "full")
    return joined.select(
        *key,
        F.coalesce("markdown", "o_markdown").alias("markdown"),
        F.coalesce("confidence_avg", "o_avg").alias("confidence_avg"),
        F.coalesce("o_created", as_of).alias("created_at"),
        F.when(F.col("new"), as_of).otherwise(F.col("o_updated")).alias("updated_at"),
    )


def get_page(pages: DataFrame, type_: str, title: str) -> DataFrame:
    return pages.filter((F.col("entity_type") == type_) & (F.lower("title") == title.lower()))


def list_pages(pages: DataFrame, type_: str | None = None, name: str | None = None) -> DataFrame:
    return pages.filter(
        all_of(None if type_ is None else F.col("entity_type") == type_, None if name is None else contains(F.col("title"), F.lit(name)))
    ).orderBy("entity_type", "title")
