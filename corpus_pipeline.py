"""Corpus preparation in five stages, each a training-data operator over all that the stage
before it kept: quality, near duplicates, benchmark leaks, mixing, sharding.

Each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of ``docs``; the last adds ``slot`` and ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from sagebrook.llm import decontaminate, minhash, mixing, quality, sharding
from sagebrook.llm.common import discard, materialize, narrow, scratch, table


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., which no name used inside a stage can clash with, and
    the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def _row_key(doc, text):
    """The doc_id, or for a row without one a number made of its text, above every usual id."""
    digest = F.shiftrightunsigned(F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit("no id")), 3)
    return F.coalesce(doc.cast("long"), digest + F.lit(2**62))


def _one_a_key(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """One row of each ``__key``: that with the least hash of its text, then of the row, so that
    reruns keep the same one."""
    plain = [f.name for f in rows.select(*columns).schema.fields if isinstance(f.dataType, AtomicType)]
    one = F.min_by(F.struct(*columns, *(c for c in rows.columns if c.startswith("__t"))), F.struct(F.xxhash64(text), F.xxhash64(*plain)))
    return rows.groupBy("__key").agg(one.alias("__one")).select("__key", "__one.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject.

    Repeated rows and null ids are judged alike, null and empty texts by the bias alone; other
    columns pass through, whatever they are called, and an empty table stays empty.
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, name = _numbered(docs)
    scored = quality.score_column(rows, weights, quality.BITS, rows.columns, name["text"])
    return scored.filter(F.col("score") >= quality.THRESHOLD).drop("score").toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Rows without a doc_id come after all that have one, and those of equal texts are one
    document; without words they are near to nothing and all stay.  Of rows that share a
    doc_id one stays, the same in every run.  Other columns pass through, whatever they are
    called; an empty table stays empty.
    """
    rows, name = _numbered(docs)
    rows = rows.withColumn("__key", _row_key(F.col(name["doc_id"]), F.col(name["text"])))
    found = minhash.near_duplicates(rows.select(F.col("__key").alias("doc_id"), F.col(name["text"]).alias("text")))
    by_id = found.groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size")
    )
    odd = materialize(by_id.filter("not kept or n > 1"), "odd")
    # Most ids are alone and kept: only the others are looked up.
    gone = odd.filter("not kept").select(F.col("doc_id").alias("__key"))
    again = odd.filter(f"kept and (size > 0 or doc_id < {2**62})").select(F.col("doc_id").alias("__key"))
    left = rows.join(narrow(gone), "__key", "left_anti")
    once = left.join(narrow(again), "__key", "left_anti")
    repeated = _one_a_key(rows.join(narrow(again), "__key", "left_semi"), list(name.values()), name["text"])
    return once.unionByName(repeated).drop("__key").toDF(*docs.columns)


def not_in_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Each row is judged by its own text, whatever other rows have its doc_id or none; texts
    without words hold nothing.  Other columns pass through, whatever they are called; an
    empty table stays empty.
    """
    found = decontaminate.judged_rows(docs, table(spark, sf_dir, "benchmark"))
    leaked = materialize(found.filter("contaminated").select("k1", "k2").distinct(), "leaked")
    k1, k2 = decontaminate.row_key(docs["doc_id"], docs["text"])
    same = (k1 == leaked["k1"]) & (k2 == leaked["k2"])
    return docs.join(narrow(leaked), same, "left_anti").select(*_named(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it doesn't take are left out, and so
    are texts without words.

    Rows without a doc_id are told apart by their texts.  Of rows that share a doc_id one
    stands for all, as often as the mix takes them together.  Other columns pass through,
    whatever they are called; an empty table stays empty.
    """
    rows, name = _numbered(docs)
    rows = rows.withColumn("__key", _row_key(F.col(name["doc_id"]), F.col(name["text"])))
    takes = mixing.mix(rows.select(F.col("__key").alias("doc_id"), F.col(name["source"]).alias("source"), F.col(name["text"]).alias("text")))
    times = F.coalesce(F.try_divide("taken", "size"), F.lit(0)).cast("int")
    takes = takes.groupBy(F.col("doc_id").alias("__key")).agg(
        F.sum(times).cast("int").alias("__times"), F.count(F.lit(1)).alias("__n")
    )
    takes = materialize(takes.filter("__times > 0"), "takes")
    taken = rows.join(narrow(takes), "__key")
    once = taken.filter("__n = 1").drop("__n")
    repeated = _one_a_key(taken.filter("__n > 1").drop("__n"), list(name.values()), name["text"])
    copies = F.explode(F.sequence(F.lit(1), F.col("__times")))
    out = once.unionByName(repeated).withColumn("__copy", copies)
    return out.select(*name.values()).toDF(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document that is left: ``docs`` with slot and shard, in place of
    columns of these names.  Rows with equal ids, nulls among them, share a shard; texts make
    no difference; an empty table stays empty."""
    return sharding.place(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier, the near duplicates and the mix have no SQL; tests check the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.  What a stage
    stored for itself goes when it is written, and what it was given when the next one is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}", keep=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
