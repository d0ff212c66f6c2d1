"""Extraction of entities and relationships from chunks, validation, and staging."""

from __future__ import annotations

import re
from itertools import combinations
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.text import name_key, stable_id
from .resolution import resolve_names

# What may be extracted.
ENTITY_TYPES = ("Service", "Component", "Team", "Person", "Database", "Cache", "Queue", "Incident")
RELATIONSHIP_TYPES = ("DEPENDS_ON", "OWNS", "CALLS", "MEMBER_OF", "SUPPORTS", "CAUSED_BY", "AFFECTS")

ENTITY_SCHEMA = "canonical_name string, entity_type string, confidence double, source_sentence string"
EDGE_SCHEMA = "source_name string, relationship_type string, target_name string, confidence double, source_sentence string"


class Extractor(Protocol):
    """Finds entities and relationships in a text; must be picklable.

    One without a prompt, so that any length of text and of names will do, says so by
    ``prompted = False``.
    """

    def entities(self, text: str) -> list[tuple[str, str, float, str]]: ...

    def relationships(self, text: str, names: list[str]) -> list[tuple[str, str, str, float, str]]: ...


class PatternExtractor:
    """The default: names by their endings or the words before them, relationships by verbs
    between two names; all types are among them."""

    prompted = False
    #: Endings and numbers of names, and what they say; people are named after a role or a title.
    NAMES = re.compile(
        r"\b(?:([A-Z][A-Za-z]*(?:Service|Component|Team|Database|DB|Cache|Queue))|(INC-[0-9]+)"
        r"|(?:(?:[Ee]ngineer|[Mm]anager|[Ll]ead|[Oo]wner|[Dd]eveloper|Dr|Mr|Ms)\.? )([A-Z][a-z]+(?: [A-Z][a-z]+)?))\b"
    )
    KINDS = {"Service": "Service", "Component": "Component", "Team": "Team", "Database": "Database", "DB": "Database", "Cache": "Cache", "Queue": "Queue"}
    VERBS = {
        "owns": "OWNS", "depends on": "DEPENDS_ON", "relies on": "DEPENDS_ON", "calls": "CALLS", "supports": "SUPPORTS", "is a member of": "MEMBER_OF",
        "belongs to": "MEMBER_OF", "was caused by": "CAUSED_BY", "is caused by": "CAUSED_BY", "affects": "AFFECTS", "affected": "AFFECTS",
    }

    def _sentences(self, text: str) -> list[str]:
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]

    def _named(self, sentence: str) -> list[tuple[str, str, int, int]]:
        """(name, type, start, end) of the names in a sentence."""
        out = []
        for m in self.NAMES.finditer(sentence):
            at = next(i for i in (1, 2, 3) if m[i])
            kind = "Incident" if at == 2 else "Person" if at == 3 else next(v for k, v in self.KINDS.items() if m[1].endswith(k))
            out.append((m[at], kind, m.start(at), m.end(at)))
        return out

    def entities(self, text: str) -> list[tuple[str, str, float, str]]:
        return [(name, kind, 0.8, sentence) for sentence in self._sentences(text) for name, kind, _, _ in self._named(sentence)]

    def relationships(self, text: str, names: list[str]) -> list[tuple[str, str, str, float, str]]:
        out, known = [], set(names)
        for sentence in self._sentences(text):
            places = re.finditer(r"(?<!\w)(" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")(?!\w)", sentence) if known else ()
            found = [(m[1], m.start(), m.end()) for m in places]
            for (a, _, end), (b, start, _) in zip(found, found[1:]):
                between = re.fullmatch(r" (.+?) (?:the |a |an )?(?:[a-z]+ )?", sentence[end:start])
                kind = between and self.VERBS.get(between[1])
                if kind:
                    out.append((a, kind, b, 0.7, sentence))
        return out


SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def pieces(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters that cover a text, cut at ends of sentences.

    A longer sentence is cut between words, and each of its pieces begins in the middle of
    the one before, so that what lies within half a piece is whole in one of them.
    """
    out, start = [], 0
    while len(text) - start > size:
        window = text[start : start + size]
        ends = [m.end() for m in SENTENCE_END.finditer(window)]
        cut = ends[-1] if ends else max(window.rfind(" ") + 1, window.rfind("\t") + 1) or size
        out.append(window[:cut])
        if not ends:
            half = window.rfind(" ", 0, size // 2) + 1 or size // 2
            cut = min(cut, max(half, 1))
        start += cut
    return [*out, text[start:]]


def name_groups(names: list[str], size: int) -> list[list[str]]:
    """Groups of at most ``size`` names, two at least, such that any two names share one."""
    if len(names) <= size:
        return [names]
    half = max(size // 2, 1)
    blocks = [names[i : i + half] for i in range(0, len(names), half)]
    return [a + b for a, b in combinations(blocks, 2)] or [names]


def extracted(
    chunks: DataFrame, extractor: Extractor | None = None, max_chars: int = CONFIG.extract_chars, max_names: int = CONFIG.extract_names, compat: bool = False
) -> DataFrame:
    """(document_id, chunk_index, x): what the extractor finds in each chunk (document_id,
    chunk_index, chunk_text), entities as x.e and relationships as x.r.

    Whole chunks are read.  Extractors with a prompt are given pieces of at most ``max_chars``
    and groups of at most ``max_names`` of a chunk's names; with ``compat`` any extractor
    is given the first piece and the first names only.
    """
    model = extractor or PatternExtractor()
    prompted = getattr(model, "prompted", True)

    @F.pandas_udf(f"struct<e:array<struct<{_as_struct(ENTITY_SCHEMA)}>>,r:array<struct<{_as_struct(EDGE_SCHEMA)}>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found, linked = [], []
        for text in texts:
            text = text or ""
            parts = [text[:max_chars]] if compat else pieces(text, max_chars) if prompted else [text]
            entities = [e for part in parts for e in model.entities(part)]
            names = list(dict.fromkeys(e[0] for e in entities))
            groups = [names[:max_names]] if compat else name_groups(names, max_names) if prompted else [names]
            links = [r for part in parts for group in groups for r in model.relationships(part, group)]
            if len(parts) * len(groups) > 1:
                links = list(dict.fromkeys(map(tuple, links)))
            found.append([dict(zip(("canonical_name", "entity_type", "confidence", "source_sentence"), e)) for e in entities])
            linked.append([dict(zip(("source_name", "relationship_type", "target_name", "confidence", "source_sentence"), r)) for r in links])
        return pd.DataFrame({"e": found, "r": linked})

    return chunks.select("document_id", "chunk_index", run("chunk_text").alias("x"))


def by_kind(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of what ``extracted`` gave, one row each, with their order."""

    def flat(column: str) -> DataFrame:
        rows = done.select("document_id", "chunk_index", F.posexplode(f"x.{column}").alias("place", "row"))
        seq = F.struct("document_id", "chunk_index", "place")
        return rows.select("document_id", "chunk_index", seq.alias("order"), "row.*")

    return flat("e"), flat("r")


def extract(chunks: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of chunks; the parameters are those of ``extracted``."""
    return by_kind(extracted(chunks, *args, **kwargs))


def _as_struct(schema: str) -> str:
    return ",".join(":".join(part.split()) for part in schema.split(", "))


def valid_entities(rows: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """Rows with a name and a known type (the first of a ``a|b`` list), confidence clamped."""
    kind = F.trim(F.element_at(F.split("entity_type", r"\|"), 1))
    return (
        rows.withColumn("entity_type", kind)
        .withColumn("confidence", F.col("confidence").cast("double"))
        .filter((F.col("canonical_name") != "") & F.col("entity_type").isin(*types) & F.col("confidence").isNotNull())
        .withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")), "source_sentence": F.coalesce("source_sentence", F.lit(""))})
    )


def valid_relationships(rows: DataFrame, types: tuple[str, ...] = RELATIONSHIP_TYPES) -> DataFrame:
    """Rows with all fields, a known type, a confidence within bounds and two different ends."""
    whole = F.lit(True)
    for c in ("source_name", "relationship_type", "target_name", "confidence", "source_sentence"):
        whole = whole & F.col(c).isNotNull()
    return rows.filter(
        whole & F.col("relationship_type").isin(*types) & F.col("confidence").cast("double").between(0.0, 1.0) & (name_key(F.col("source_name")) != name_key(F.col("target_name")))
    )


def stage(entities: DataFrame, relationships: DataFrame, stored: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new entities, new edges, errors): extractions as staged rows.  Ends of edges are found
    by name among the new and the stored entities; an edge with an unknown end is an error."""
    new = entities.select(
        stable_id(F.lit("entity"), name_key(F.col("entity_type")), name_key(F.col("canonical_name")), F.coalesce("document_id", F.lit(""))).alias("entity_id"),
        "entity_type",
        F.lit("STAGING").alias("lifecycle_state"),
        "confidence",
        F.col("document_id").alias("source_document_id"),
        "source_sentence",
        F.col("canonical_name").alias("extracted_text"),
        as_of.alias("created_at"),
    )
    known = stored.select("entity_id", "entity_type", "lifecycle_state", "confidence", "source_document_id", "source_sentence", "extracted_text", "created_at")
    everything = known.unionByName(new)
    names = relationships.select(F.col("source_name").alias("name")).union(relationships.select("target_name"))
    ids = resolve_names(names, everything)
    a = ids.select(F.col("name").alias("source_name"), F.col("entity_id").alias("source_entity_id"))
    b = ids.select(F.col("name").alias("target_name"), F.col("entity_id").alias("target_entity_id"))
    joined = relationships.join(a, "source_name", "left").join(b, "target_name", "left")
    whole = F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull()
    edges = joined.filter(whole).select(
        stable_id(F.lit("edge"), "source_entity_id", "relationship_type", "target_entity_id").alias("relationship_id"),
        "source_entity_id",
        "target_entity_id",
        "relationship_type",
        F.lit("STAGING").alias("lifecycle_state"),
        "confidence",
        "source_sentence",
    )
    errors = joined.filter(~whole).select("source_name", "relationship_type", "target_name", F.lit("unresolved end").alias("error"))
    return new.dropDuplicates(["entity_id"]), edges.dropDuplicates(["relationship_id"]), errors
