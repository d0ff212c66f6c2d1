"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds a posting (term, document, position) for every training token that is a term
of the benchmark, and for every document one posting with an empty term that carries its
number of words.  It is written once and every later step reads only the index.

A phrase is looked up from its rarest term: each of that term's postings, moved back by the
term's offset, proposes a start; the list of the second rarest term, adjusted likewise,
is intersected with it; the starts that are left are checked against the postings of all
other terms.  A start stays only if every term of the phrase stands at its place, so matches
are exact.  ``nearby`` asks less: every other term within a few words of its place, in any
order, which words put in, left out or exchanged do not hide.  ``proximity`` is that of two
single terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, discard, materialize, small_enough, table

#: Words of a window.
WINDOW = 10
#: How many words a term of a near match may be away from its place.
SLOP = 3
#: The most phrase terms that are sent to every executor; more are joined by shuffling.
BROADCAST_ROWS = 400_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of what no word holds; A-Z count as letters here and are lower-cased a word at a time.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words of a text before lower-casing; the last may be empty."""
    return F.split(F.regexp_replace(text, "^" + _BREAK, ""), _BREAK)


def lowered(word: Column) -> Column:
    """A word with A-Z, and nothing else, in lower case."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, UPPER.lower())
    )


def row_key(doc: Column, text: Column) -> tuple[Column, Column]:
    """A key of two numbers for a row with this id and text; equal rows have equal keys."""
    doc = doc.cast("long")
    return F.coalesce(doc, F.lit(NO_ID)), F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), doc.isNull())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, text): the rows with their keys."""
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def phrases(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(phrase, terms, items): the distinct windows of the items and the items that have them.

    An item with fewer words than a window, but not none, is one window.
    """
    words = F.filter(F.transform(raw_words(F.col("text")), lowered), lambda w: w != "")
    rows = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).select("item", words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    windows = (
        rows.filter(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s"), window).alias("terms"))
    )
    return windows.groupBy("terms").agg(F.collect_set("item").alias("items"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "postings") -> DataFrame:
    """The stored postings (term, k1, k2, pos) of ``terms`` (term) in ``docs``, and of the
    empty term, where pos is the document's number of words.

    One pass over the texts, written as it comes; positions start at 1.
    """
    size = (F.size("w") - (F.element_at("w", -1) == "").cast("int")).alias("n")
    long = (
        keyed(docs, id_col, text_col)
        .select("k1", "k2", raw_words(F.col("text")).alias("w"))
        .select("k1", "k2", size, F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
        .filter("pos = 0 or word <> ''")
        .select(lowered(F.col("word")).alias("term"), "k1", "k2", F.when(F.col("pos") > 0, F.col("pos")).otherwise(F.col("n")).alias("pos"))
    )
    wanted = terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    if small_enough(terms, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    return materialize(long.join(wanted, "term"), name)


def _plan(index: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(phrase, term, at, rank, len): the terms of every phrase that can occur, rarest first."""
    often = index.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    # A table of its own, small as the benchmark, so that no window's terms meet in one task.
    often = materialize(often, f"{name}-often")
    terms = found.select("phrase", F.size("terms").alias("len"), F.posexplode("terms").alias("at", "term"))
    known = terms.join(F.broadcast(often) if small_enough(often, BROADCAST_ROWS) else often, "term")
    by = Window.partitionBy("phrase")
    ranked = known.withColumn("rank", F.row_number().over(by.orderBy("often", "term", "at")))
    # A phrase with a term that the corpus lacks occurs nowhere.
    whole = ranked.withColumn("have", F.count(F.lit(1)).over(by)).filter("have = len")
    return materialize(whole.select("phrase", "term", "at", "rank", "len"), f"{name}-plan")


def _hint(plan: DataFrame):
    """Broadcasts what is as large as the plan, where that is within bounds."""
    return F.broadcast if small_enough(plan, BROADCAST_ROWS) else (lambda df: df)


def _candidates(index: DataFrame, plan: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(starts, seconds): where each posting of a phrase's rarest term would have it start, with
    its second term (term, at2), and the postings of all second terms."""
    lists, hint = index.filter("term <> ''"), _hint(plan)
    first = plan.filter("rank = 1").select("phrase", "len", "term", "at")
    second = plan.filter("rank = 2").select("phrase", F.col("term").alias("term2"), F.col("at").alias("at2"))
    starts = (
        lists.join(hint(first.join(second, "phrase", "left")), "term")
        .select("k1", "k2", (F.col("pos") - F.col("at")).alias("start"), "phrase", "len", F.col("term2").alias("term"), "at2")
        .filter("start >= 1")
    )
    seconds = lists.join(hint(second.select(F.col("term2").alias("term")).distinct()), "term").select("term", "k1", "k2", "pos")
    return materialize(starts, f"{name}-starts"), materialize(seconds, f"{name}-seconds")


def _others(index: DataFrame, plan: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, there): the places (pos) of all further terms of ``pairs``, and the postings of
    the few documents that have any."""
    where = materialize(pairs.filter("len > 2").select("k1", "k2").distinct(), "postings-where")
    lists = index.filter("term <> ''")
    there = lists.join(F.broadcast(where) if small_enough(where, BROADCAST_ROWS) else where, ["k1", "k2"], "left_semi")
    others = plan.filter("rank > 2").select("phrase", "term", "at")
    checks = (
        pairs.filter("len > 2")
        .join(_hint(plan)(others), "phrase")
        .select("k1", "k2", "start", "phrase", "len", "at", "term", (F.col("start") + F.col("at")).alias("pos"))
    )
    return checks, there


def occurrences(index: DataFrame, plan: DataFrame, starts: DataFrame, seconds: DataFrame, name: str = "postings") -> DataFrame:
    """(k1, k2, start, phrase, len): every exact occurrence of the phrases of ``plan``."""
    one_term = starts.filter("len = 1").select("k1", "k2", "start", "phrase", "len")
    pairs = (
        starts.filter("len > 1")
        .withColumn("pos", F.col("start") + F.col("at2"))
        .join(seconds, ["k1", "k2", "term", "pos"], "left_semi")
        .select("k1", "k2", "start", "phrase", "len")
    )
    pairs = materialize(pairs, f"{name}-pairs")
    checks, there = _others(index, plan, pairs)
    # Equal rows of the corpus have equal keys, so a posting can be there more than once.
    held = checks.drop("at").distinct().join(there, ["k1", "k2", "term", "pos"], "left_semi")
    full = (
        held.groupBy("k1", "k2", "start", "phrase", "len")
        .agg(F.count(F.lit(1)).alias("c"))
        .filter("c = len - 2")
        .drop("c")
    )
    out = materialize(full.union(pairs.filter("len = 2").distinct()).union(one_term.distinct()), f"{name}-hits")
    discard(pairs)
    return out


def _within(asked: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Rows of ``asked`` (k1, k2, term, pos, ...) with a posting at most ``slop`` words away.

    Places are met by blocks of 2 * slop + 1 words, of which a reach touches at most two.
    """
    width = 2 * slop + 1
    ends = F.array_distinct(F.array(*[F.floor((F.col("pos") + d) / width) for d in (-slop, slop)]))
    asked = asked.withColumn("block", F.explode(ends))
    there = postings.select("k1", "k2", "term", F.col("pos").alias("__pos"), F.floor(F.col("pos") / width).alias("block"))
    key = ["k1", "k2", "term", "block"]
    close = F.abs(F.col("pos") - F.col("__pos")) <= slop
    return asked.join(there, key).filter(close).drop("block", "__pos").distinct()


def nearby(index: DataFrame, plan: DataFrame, starts: DataFrame, seconds: DataFrame, slop: int = SLOP, name: str = "postings") -> DataFrame:
    """(k1, k2, phrase): the phrases of ``plan`` whose rarest term stands in a text with every
    other one at most ``slop`` words from its place; exact occurrences among them."""
    one_term = starts.filter("len = 1").select("k1", "k2", "phrase")
    pairs = _within(starts.filter("len > 1").withColumn("pos", F.col("start") + F.col("at2")), seconds, slop)
    pairs = materialize(pairs.select("k1", "k2", "start", "phrase", "len"), f"{name}-near-pairs")
    checks, there = _others(index, plan, pairs)
    held = _within(checks, there, slop)
    full = held.groupBy("k1", "k2", "start", "phrase", "len").agg(F.count(F.lit(1)).alias("c")).filter("c = len - 2")
    two = pairs.filter("len = 2").select("k1", "k2", "phrase")
    out = materialize(full.select("k1", "k2", "phrase").union(two).union(one_term).distinct(), f"{name}-near")
    discard(pairs)
    return out


def proximity(index: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """(k1, k2, pos, other): postings of two terms at most ``within`` words apart.

    Positions are met by blocks of ``within`` words, so only neighbours are compared.
    """
    a = index.filter(F.col("term") == left).select("k1", "k2", "pos").distinct()
    b = index.filter(F.col("term") == right).select("k1", "k2", F.col("pos").alias("other")).distinct()
    a = a.withColumn("block", F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])))
    b = b.withColumn("block", F.floor(F.col("other") / within))
    return (
        a.join(b, ["k1", "k2", "block"])
        .filter((F.abs(F.col("pos") - F.col("other")) <= within) & (F.lit(left != right) | (F.col("pos") < F.col("other"))))
        .select("k1", "k2", "pos", "other")
    )


def judged_rows(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    name: str = "postings",
    slop: int | None = None,
) -> DataFrame:
    """What ``contamination`` finds, under the keys (k1, k2) of ``row_key`` in place of doc_id;
    ``n_near`` only where a ``slop`` is given."""
    found = phrases(items, item_col, item_text_col, window)
    found = materialize(found.withColumn("phrase", F.monotonically_increasing_id()), f"{name}-phrases")
    terms = found.select(F.explode("terms").alias("term")).distinct()
    index = build_index(docs, terms, id_col, text_col, name)
    plan = _plan(index, found, name)
    starts, seconds = _candidates(index, plan, name)
    hits = occurrences(index, plan, starts, seconds, name)
    near = None if slop is None else nearby(index, plan, starts, seconds, slop, name)
    rows = materialize(index.filter("term = ''").select("k1", "k2", F.col("pos").cast("long").alias("n_words")), f"{name}-texts")
    discard(index, plan, starts, seconds)

    spans = hits.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    earlier = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(earlier), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0))
    covered = spans.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"))
    which = (
        hits.select("k1", "k2", "phrase")
        .distinct()
        .join(found.select("phrase", F.explode("items").alias("item")), "phrase")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    judged = covered.join(which, ["k1", "k2"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    if near is not None:
        items_of = near.join(found.select("phrase", F.explode("items").alias("item")), "phrase")
        n_near = items_of.groupBy("k1", "k2").agg(F.count_distinct("item").alias("n_near"))
        judged = judged.join(n_near, ["k1", "k2"], "full")
    return rows.join(judged, ["k1", "k2"], "left").select(
        "k1",
        "k2",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *([] if near is None else [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    name: str = "postings",
    slop: int = SLOP,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every row of
    ``docs``; ``n_near`` counts the items with a window that is nearby (see there) or exact.

    Null and empty texts have no words and no hits.  Rows with a null doc_id are judged like
    any other; repeated rows get equal results; an item without words has no window; a null
    item_id counts as the empty string.  Other columns are ignored, whatever they are called.
    Without documents the result is empty, without items nothing is contaminated.
    """
    found = judged_rows(docs, items, window, id_col, text_col, item_col, item_text_col, name, slop)
    doc = F.when(F.col("k1") != NO_ID, F.col("k1"))
    return found.select(doc.alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_sql(window: int = WINDOW, slop: int = SLOP) -> str:
    """The same by comparing the windows of all texts as strings."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH docs AS (SELECT doc_id, {words} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS g FROM (
  SELECT item, unnest(list_transform(range(1, greatest(len(w) - {window - 1}, 1) + 1), lambda s: w[s:s + {window - 1}])) AS x FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lens WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, s, n, item FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM starts) JOIN wins USING (n, g)),
often AS (SELECT t AS term, count(*) AS c FROM (SELECT unnest(w) AS t FROM docs) GROUP BY t),
terms AS (SELECT g, n, unnest(string_split(g, ' ')) AS term, unnest(range(n)) AS ofs FROM (SELECT DISTINCT g, n FROM wins)),
ranked AS (SELECT g, n, terms.term, ofs, row_number() OVER (PARTITION BY g ORDER BY c, terms.term, ofs) AS rank FROM terms JOIN often USING (term)
  QUALIFY count(*) OVER (PARTITION BY g) = n),
posts AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM docs),
leads AS (SELECT doc_id, pos - ofs AS s, g, n FROM posts JOIN ranked USING (term) WHERE rank = 1 AND pos - ofs >= 1),
seen AS (SELECT DISTINCT l.doc_id, l.s, l.g, l.n, r.ofs FROM leads l JOIN ranked r ON r.g = l.g AND r.rank = 2
  JOIN posts p ON p.doc_id = l.doc_id AND p.term = r.term AND abs(p.pos - l.s - r.ofs) <= {slop}),
further AS (SELECT l.doc_id, l.s, l.g, l.n, count(DISTINCT r.ofs) AS have FROM seen l JOIN ranked r ON r.g = l.g AND r.rank > 2
  JOIN posts p ON p.doc_id = l.doc_id AND p.term = r.term AND abs(p.pos - l.s - r.ofs) <= {slop} GROUP BY ALL),
close AS (SELECT doc_id, g FROM further WHERE have = n - 2 UNION SELECT doc_id, g FROM seen WHERE n = 2 UNION SELECT doc_id, g FROM leads WHERE n = 1),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM close JOIN wins USING (g) GROUP BY doc_id),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)"""
