"""Text functions as column expressions: keywords, phrases, normal forms, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are no keywords of an entity query.
ENTITY_STOP_WORDS = (
    "what", "which", "who", "where", "when", "how", "is", "are",
    "the", "a", "an", "does", "do", "did", "has", "have", "had",
    "for", "to", "from", "on", "with", "by", "in", "of", "at",
)
# The words that are no keywords of a text search.
SEARCH_STOP_WORDS = (
    "what", "which", "who", "where", "when", "how", "is", "are", "does",
    "the", "a", "an", "do", "did", "has", "have", "had", "for", "to",
    "from", "on", "with", "by", "in", "of", "at", "be", "was", "were",
    "been", "being", "will", "would", "could", "should", "can", "may",
    "this", "that", "these", "those", "it", "its", "their", "and", "or",
    "but", "not", "than", "about", "between", "many", "much", "most",
    "name", "total", "expected", "company", "value", "one", "listed",
)
# What is stripped from both ends of a word.
ENTITY_STRIP = "?.,!"
SEARCH_STRIP = "?.,!()\"'-"
# Fixed value: two or more capitalised words in a row.
CAPITALISED = r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)+"


def words_of(text: Column) -> Column:
    """Runs of non-spaces."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _in(word: Column, words: tuple[str, ...]) -> Column:
    return word.isin(*words)


def entity_keywords(query: Column, strict: bool = False) -> Column:
    """Keywords of a query over entities: stop words are tested before stripping.  Keywords
    that strip to nothing are dropped, unless ``strict`` keeps them."""
    kept = F.filter(words_of(F.lower(query)), lambda w: ~_in(w, ENTITY_STOP_WORDS))
    stripped = F.transform(kept, lambda w: F.btrim(w, F.lit(ENTITY_STRIP)))
    return stripped if strict else F.filter(stripped, lambda w: w != "")


def search_keywords(query: Column) -> Column:
    """Keywords of a text search: stripped first, over two letters, no stop words."""
    stripped = F.transform(words_of(F.lower(query)), lambda w: F.btrim(w, F.lit(SEARCH_STRIP)))
    return F.filter(stripped, lambda w: ~_in(w, SEARCH_STOP_WORDS) & (F.char_length(w) > 2))


def capitalised_phrases(query: Column) -> Column:
    return F.transform(F.regexp_extract_all(query, F.lit(CAPITALISED), F.lit(0)), F.lower)


def bigrams(words: Column) -> Column:
    """Neighbours joined by a space."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def search_phrases(query: Column) -> Column:
    """Capitalised phrases, then neighbouring keywords; repeats count again."""
    return F.concat(capitalised_phrases(query), bigrams(search_keywords(query)))


def contains(column: Column, needle: Column) -> Column:
    """Case-insensitive containment; the needle is literal and a null column is empty."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(needle))


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def name_key(column: Column) -> Column:
    return F.lower(F.trim(column))


def query_hash(query: Column) -> Column:
    """The digest of a query up to case and outer spaces."""
    return F.sha2(F.lower(F.trim(query)), 256)


def last_index(text: Column, needle: str) -> Column:
    """The 0-based place of the last occurrence, -1 without any."""
    at = F.locate(needle[::-1], F.reverse(text))
    return F.when(at == 0, F.lit(-1)).otherwise(F.char_length(text) - at - len(needle) + 1)


def stable_id(*parts: Column) -> Column:
    """An id that depends on its parts alone."""
    return F.md5(F.concat_ws("\u001f", *parts))


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("int")


def title_of(path: Column) -> Column:
    """A title from a file name: no suffix, underscores and dashes as spaces."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, "[_-]", " ")
