"""Importance resampling towards a target distribution of hashed word n-grams.

Texts become a table of positions, one row a word; a window over each text brings the words that
follow next to it, so that every row has the n-grams of all orders that start there, as hash
buckets.  The table is stored once.  Its counts and those of the target give every bucket's gain;
the gains, one row a bucket, are joined back and summed by text.  Equal texts are one text with a
count.  Documents are then drawn without replacement by the highest sums with Gumbel noise of the
document's id, ranked by a range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, narrow, table
from .crc import crc32_sql
from .decontaminate import lowered, raw_words

ORDERS = 3
BUCKETS = 10_000
#: Documents of fewer words are never drawn; of the others so many in a hundred are.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42


def text_key(text: Column) -> tuple[Column, Column]:
    """Two numbers for a text, of 120 bits of its SHA-256; null is the empty text."""
    digest = F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def positions(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, name: str = "positions") -> DataFrame:
    """The stored table (k1, k2, copies, b1 .. b<orders>) of (k1, k2, text): a row a word of each
    different text, with the bucket of the n-gram of each order that starts at it, if there is
    one.  A text without words has one row without buckets.
    """
    # Texts are gathered by their keys; exploded and windowed rows stay where their text is.
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("copies"))
    words = once.select("k1", "k2", "copies", F.posexplode(raw_words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    words = words.filter("word <> '' or pos = 0").select("k1", "k2", "copies", "pos", lowered(F.nullif("word", F.lit(""))).alias("word"))
    by = Window.partitionBy("k1", "k2").orderBy("pos")
    following = words.select("*", *[F.lead("word", i).over(by).alias(f"w{i}") for i in range(1, orders)])
    grams, gram = [], F.col("word")
    for i in range(1, orders + 1):
        grams.append((F.crc32(gram) % buckets).cast("int").alias(f"b{i}"))
        gram = F.concat(gram, F.lit(" "), F.col(f"w{i}")) if i < orders else gram
    return materialize(following.select("k1", "k2", "copies", *grams), name)


def counts(table_: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): features in each bucket over all documents, copies of a text counted."""
    out = None
    for i in range(1, orders + 1):
        part = table_.filter(f"b{i} is not null").groupBy(F.col(f"b{i}").alias("bucket")).agg(F.sum("copies").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: a thousand times the log of how much more often the target
    has it, both counts with one added, as a whole number."""
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    rows = rows.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    every = Window.partitionBy()
    rows = rows.select("*", F.sum("s").over(every).alias("all_s"), F.sum("t").over(every).alias("all_t"))
    ratio = F.expr(f"((t + 1) * (all_s + {buckets})) / ((s + 1) * (all_t + {buckets}))")
    return rows.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weights(table_: DataFrame, gain: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(k1, k2, n_words, n_features, weight) of every text of a table of positions."""
    rows = table_
    for i in range(1, orders + 1):
        rows = rows.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{i}"), F.col("gain").alias(f"g{i}"))), f"b{i}", "left")
    found = [F.col(f"g{i}") for i in range(1, orders + 1)]
    features = sum((g.isNotNull().cast("long") for g in found), F.lit(0))
    total = sum((F.coalesce(g, F.lit(0)) for g in found), F.lit(0))
    return rows.groupBy("k1", "k2").agg(
        F.count("b1").alias("n_words"), F.sum(features).alias("n_features"), F.sum(total).alias("weight")
    )


def noise(doc: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, as a whole number; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: Sequence[Column], drawn: Column, name: str = "ranked") -> DataFrame:
    """``rows`` with their rank in ``order`` from 1, null beyond ``drawn`` of them (a column over
    ``n``, their number).  One range sort; only the numbers of rows of its tasks are summed."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), name)
    task = F.shiftright("at", 33)
    parts = sorted_.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("task").alias("task_"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("n")
    )
    parts = materialize(parts.select("task_", "before", drawn.alias("drawn")), f"{name}-tasks")
    place = F.col("before") + F.col("at") - F.shiftleft(task, 33) + 1
    found = sorted_.join(narrow(parts), task == F.col("task_"))
    return found.withColumn("rank", F.when(place <= F.col("drawn"), place)).drop("at", "task_", "before", "drawn")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS,
    buckets: int = BUCKETS, seed: int = SEED, name: str = "resampling",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn to be
    like the texts of ``target``.

    Null and empty texts, and those without words, have no features and weight 0.  Rows without
    a doc_id share the noise of the empty id; rows with equal scores are drawn by doc_id, null
    first, then by text, and equal rows are interchangeable.  Other columns are ignored; an empty
    table gives an empty result, and an empty target is one with no features.
    """
    k1, k2 = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    wanted = target.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    corpus = positions(rows.drop("doc_id"), orders, buckets, f"{name}-corpus")
    aimed = positions(wanted, orders, buckets, f"{name}-target")
    gain = materialize(gains(counts(corpus, orders), counts(aimed, orders), buckets).coalesce(1), f"{name}-gains")
    by_text = materialize(weights(corpus, gain, orders), f"{name}-weights")
    discard(corpus, aimed, gain)
    # Stored before it is ranked: the last key only tells equal rows apart, so that a range sort
    # can split any number of them.
    scored = rows.drop("text").join(by_text, ["k1", "k2"])
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("u", F.rand(seed))
    scored = materialize(scored, f"{name}-scored")
    discard(by_text)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("u")]
    drawn = ranked(scored.filter(F.col("n_words") >= least_words), order, F.expr(f"{percent} * n div 100"), f"{name}-ranked")
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return drawn.select(columns).unionByName(short.select(columns))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sql() -> str:
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

    def grams(source: str, key: str) -> str:
        runs = " UNION ALL ".join(
            f"SELECT {key} AS key, unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS gram FROM {source}"
            for n in range(1, ORDERS + 1)
        )
        return f"SELECT key, gram, count(*) AS n FROM ({runs}) GROUP BY ALL"

    h = f"(CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
m AS (SELECT item_id, {words} AS w FROM benchmark),
dg AS ({grams('d', 'doc_id')}), mg AS ({grams('m', 'item_id')}),
known AS (SELECT gram, {crc32_sql('gram')} % {BUCKETS} AS bucket FROM (SELECT gram FROM dg UNION SELECT gram FROM mg)),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dg JOIN known USING (gram) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM mg JOIN known USING (gram) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}))
  / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT key AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM dg JOIN known USING (gram) JOIN gain USING (bucket) GROUP BY key),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln({h})))::BIGINT AS score FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, {PERCENT} * count(*) OVER () // 100 AS drawn
  FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
