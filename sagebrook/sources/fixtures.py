"""The domain tables, derived from the star-schema tables of a data directory."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
#: The moment that stands for now in every query over these tables.
AS_OF = "timestamp_ntz'2024-01-20 00:00:00'"
#: Fixed slices of texts, where a plain chunking will do.
SLICE, STEP = 800, 700


@dataclass(frozen=True)
class Tables:
    """Lazy views over one data directory."""

    spark: SparkSession
    sf_dir: str
    _read: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def raw(self, name: str) -> DataFrame:
        """A table, whose files are listed once however often it is asked for."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def _named(self) -> DataFrame:
        parts = [
            ("Region", "region", "r_regionkey", "r_name"),
            ("Nation", "nation", "n_nationkey", "n_name"),
            ("Supplier", "supplier", "s_suppkey", "s_name"),
            ("Customer", "customer", "c_custkey", "c_name"),
            ("Part", "part", "p_partkey", "p_name"),
        ]
        frames = [
            self.raw(table).select(F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("key"), F.col(name).alias("name"))
            for kind, table, key, name in parts
        ]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    @cached_property
    def entities(self) -> DataFrame:
        named = self._named()
        state = (
            F.when(F.col("key") % 10 < 5, F.lit("STAGING")).when(F.col("key") % 10 < 9, F.lit("TRUSTED")).otherwise(F.lit("ARCHIVED"))
        )
        first = named.select(
            F.concat_ws(":", "entity_type", "key").alias("entity_id"),
            "entity_type",
            state.alias("lifecycle_state"),
            ((F.col("key") * 37 % 101) / 100.0).alias("confidence"),
            F.concat(F.lit("doc-"), (F.col("key") % 50).cast("string")).alias("source_document_id"),
            F.concat(F.lit("The record of "), "name").alias("source_sentence"),
            F.when(F.col("key") % 7 != 0, F.col("name")).alias("extracted_text"),
            (F.col("key") % 11 != 0).alias("resolved"),
            F.expr(f"{EPOCH} + make_dt_interval(cast(key % 30 as int))").alias("created_at"),
            F.when(F.col("entity_type") == "Customer", F.col("key")).alias("user_id"),
        )
        again = named.filter("entity_type in ('Customer', 'Supplier') and key % 5 = 0").select(
            F.concat(F.concat_ws(":", "entity_type", "key"), F.lit(":dup")).alias("entity_id"),
            "entity_type",
            F.lit("STAGING").alias("lifecycle_state"),
            ((F.col("key") * 53 % 101) / 100.0).alias("confidence"),
            F.concat(F.lit("doc-"), ((F.col("key") + 7) % 50).cast("string")).alias("source_document_id"),
            F.concat(F.lit("The record of "), "name").alias("source_sentence"),
            F.when(F.col("key") % 7 != 0, F.upper("name")).alias("extracted_text"),
            F.lit(True).alias("resolved"),
            F.expr(f"{EPOCH} + make_dt_interval(cast(key % 30 as int), 12)").alias("created_at"),
            F.lit(None).cast("long").alias("user_id"),
        )
        seen = self.raw("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_accessed"))
        return (
            first.unionByName(again)
            .join(seen, "user_id", "left")
            .select(
                "entity_id", "entity_type", "lifecycle_state", "confidence", "source_document_id", "source_sentence",
                "extracted_text", "resolved", "created_at", F.coalesce("n", F.lit(0)).cast("int").alias("access_count"), "last_accessed",
            )
        )

    @cached_property
    def edges(self) -> DataFrame:
        def edge(df: DataFrame, source: str, a: str, kind: str, target: str, b: str) -> DataFrame:
            return df.select(
                F.concat_ws(":", F.lit(source), F.col(a)).alias("source_entity_id"),
                F.lit(kind).alias("relationship_type"),
                F.concat_ws(":", F.lit(target), F.col(b)).alias("target_entity_id"),
                F.col(a).cast("long").alias("a"),
                F.col(b).cast("long").alias("b"),
            )

        based = self.raw("customer").withColumn("n", F.when(F.col("c_custkey") % 97 == 0, 999).otherwise(F.col("c_nationkey")))
        rows = (
            edge(self.raw("supplier"), "Supplier", "s_suppkey", "LOCATED_IN", "Nation", "s_nationkey")
            .unionByName(edge(self.raw("nation"), "Nation", "n_nationkey", "MEMBER_OF", "Region", "n_regionkey"))
            .unionByName(edge(based, "Customer", "c_custkey", "BASED_IN", "Nation", "n"))
            .unionByName(edge(self.raw("lineitem").select("l_suppkey", "l_partkey").distinct(), "Supplier", "l_suppkey", "SUPPLIES", "Part", "l_partkey"))
        )
        return rows.select(
            F.concat_ws(">", "source_entity_id", "relationship_type", "target_entity_id").alias("relationship_id"),
            "source_entity_id",
            "target_entity_id",
            "relationship_type",
            F.when((F.col("a") + F.col("b")) % 3 == 0, F.lit("STAGING")).otherwise(F.lit("TRUSTED")).alias("lifecycle_state"),
            ((F.col("a") * 31 + F.col("b") * 17) % 101 / 100.0).alias("confidence"),
            F.concat(F.lit("doc-"), (F.col("a") % 50).cast("string")).alias("source_document_id"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        """(query_id, query, session_id, opening): every turn of a user, after the name of a part."""
        by = Window.partitionBy("conv_id")
        turns = self.raw("conversations").filter("role = 'user'").withColumn("opening", F.col("turn") == F.min("turn").over(by))
        last = self.raw("part").agg(F.max("p_partkey").alias("last"))
        part = ((F.col("conv_id") * 8 + F.col("turn")) % F.col("last") + 1).alias("p_partkey")
        named = turns.join(F.broadcast(last)).select("conv_id", "turn", "text", "opening", part).join(self.raw("part").select("p_partkey", "p_name"), "p_partkey")
        return named.select(
            (F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("query_id"),
            F.concat_ws(" ", "p_name", "text").alias("query"),
            F.col("conv_id").cast("string").alias("session_id"),
            "opening",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Fixed slices of documents with the vector of their document, where it has one."""
        n = F.greatest(F.ceil((F.char_length("text") - (SLICE - STEP)) / float(STEP)), F.lit(1)).cast("int")
        docs = self.raw("documents").select("doc_id", "lang", "source", "text", n.alias("n"))
        vectors = self.raw("embeddings").select("vec_id", "embedding")
        twice = vectors.filter("vec_id is not null").groupBy("vec_id").count().filter("count > 1")
        if twice.isEmpty():
            # Of a side that has a key once, Spark leaves the join out where no vector is asked for.
            vectors = vectors.dropDuplicates(["vec_id"])
        # Whole texts are joined once and sliced after that.
        joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        return joined.select(
            F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("document_id"),
            F.col("source").alias("document_type"),
            F.concat_ws(" ", "lang", "doc_id").alias("document_title"),
            F.substring("text", F.col("chunk_index") * STEP + 1, F.lit(SLICE)).alias("chunk_text"),
            "chunk_index",
            "embedding",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        by = Window.partitionBy("conv_id").orderBy("turn")
        turns = self.raw("conversations").select(
            "conv_id", "turn", "role", "text", F.lead("role").over(by).alias("next_role"), F.lead("text").over(by).alias("reply")
        )
        return turns.filter("role = 'user' and next_role = 'assistant'").select(
            F.col("conv_id").cast("string").alias("session_id"),
            F.col("turn").cast("int").alias("turn"),
            F.col("text").alias("query_text"),
            F.col("reply").alias("response_text"),
            F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast(turn as int))").alias("created_at"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        def events(*kinds: str):
            return F.count_if(F.col("event_type").isin(*kinds))

        counted = self.raw("events").groupBy("user_id").agg(
            F.count(F.lit(1)).alias("applied"), events("error").alias("some"), events("error", "click", "view").alias("most")
        )
        violated = (
            F.when(F.col("user_id") % 4 == 0, F.lit(0)).when(F.col("user_id") % 4 == 1, F.col("some")).when(F.col("user_id") % 4 == 2, F.col("most")).otherwise(F.col("applied"))
        )
        kinds = F.array(*[F.lit(k) for k in ("Customer", "Supplier", "Part", "Nation")])
        scope = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 5 == 1, F.array().cast("array<string>")).otherwise(
            F.array(F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")))
        )
        text = F.element_at(
            F.array(F.lit("Every service must have an owner"), F.lit("critical paths need a circuit breaker"), F.lit("escalation path is required"), F.lit("no rule")),
            (F.col("user_id") % 4 + 1).cast("int"),
        )
        return counted.select(
            F.concat(F.lit("rule-"), F.col("user_id").cast("string")).alias("rule_name"),
            F.lit("validation").alias("rule_type"),
            text.alias("condition"),
            (F.col("user_id") % 9).cast("int").alias("priority"),
            (F.col("user_id") % 13 != 0).alias("enabled"),
            scope.cast("array<string>").alias("applies_to_entity_types"),
            F.col("applied").cast("int").alias("times_applied"),
            violated.cast("int").alias("times_violated"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """Feedback on customers; signups say nothing."""
        judgment = F.create_map(*[F.lit(x) for p in (("purchase", "correct"), ("error", "incorrect"), ("click", "partial"), ("view", "uncertain")) for x in p])
        return self.raw("events").filter("event_type <> 'signup'").select(
            F.col("event_id").alias("feedback_id"),
            F.concat(F.lit("Customer:"), F.col("user_id").cast("string")).alias("entity_id"),
            judgment[F.col("event_type")].alias("judgment"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def responses(self) -> DataFrame:
        """An answer for every event; its bundle is one of 500 ids."""
        return self.raw("events").select(
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response_id"), F.concat(F.lit("b"), (F.col("event_id") % 500).cast("string")).alias("bundle_id"),
            F.concat(F.lit("what did "), F.col("user_id").cast("string"), F.lit(" do?")).alias("query_text"), F.col("event_type").alias("answer"),
        )

    @cached_property
    def bundles(self) -> DataFrame:
        """The contexts of answers: 400 of the 500 that answers name, with two entities each."""
        k = F.col("id").cast("string")
        return self.spark.range(400).select(
            F.concat(F.lit("b"), k).alias("bundle_id"),
            F.array(F.concat(F.lit("Customer:"), k), F.concat(F.lit("Supplier:"), (F.col("id") % 10).cast("string"))).alias("entity_ids"),
        )

    @cached_property
    def response_feedback(self) -> DataFrame:
        """A judgment of every answer; signups judge nothing, and every 7th names no answer."""
        judgment = F.create_map(*[F.lit(x) for p in (("purchase", "correct"), ("error", "incorrect"), ("click", "partial"), ("view", "uncertain")) for x in p])
        at = F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("r"), F.col("event_id").cast("string")))
        return self.raw("events").select(
            F.col("event_id").alias("feedback_id"), at.alias("response_id"), judgment[F.col("event_type")].alias("judgment"), F.col("ts").alias("created_at")
        )

    @cached_property
    def titles(self) -> DataFrame:
        """Titles of the documents with an even id that entities come from."""
        return self.raw("documents").filter("doc_id < 50 and doc_id % 2 = 0").select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.concat_ws(" ", F.lit("Document"), "lang", "doc_id").alias("title")
        )

    @cached_property
    def memory_writes(self) -> DataFrame:
        """Writes of working memory: a session per user, a key per k of the event."""
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("session_id"),
            F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"),
            F.col("value").alias("value"),
            F.col("event_type").alias("agent"),
            (F.col("event_id") % 7).cast("int").alias("step_number"),
            F.col("ts").alias("created_at"),
            F.expr("ts + make_dt_interval(cast(user_id % 20 as int))").alias("expires_at"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Question, expected answer and actual answer: every document against a benchmark
        passage, both whole; the items take turns in order of their ids."""
        docs = self.raw("documents").select("doc_id", "lang", "text")
        items = self.raw("benchmark").select("item_id", F.col("text").alias("passage"))
        by_id = Window.orderBy("item_id", "passage")
        # The table of test items is small whatever the corpus, so one task can number it.
        items = items.withColumn("place", F.row_number().over(by_id) - 1)
        docs = docs.withColumn("place", F.pmod("doc_id", F.lit(max(items.count(), 1))))
        kind = F.col("doc_id") % 8
        text, passage = F.col("text"), F.col("passage")
        expected = (
            F.when(kind == 0, text)
            .when(kind == 1, F.concat(F.lit("Yes, "), passage))
            .when(kind == 2, F.lit("[NOT IN DOCUMENTS]"))
            .when(kind == 3, F.lit("[Answer depends on document content]"))
            .when(kind == 4, F.concat(F.lit("2024-"), (F.lit(2025) + F.col("doc_id") % 3).cast("string")))
            .when(kind == 5, F.concat(passage, F.lit(" (or "), F.col("lang"), F.lit(")")))
            .when(kind == 6, F.concat(F.lit("about 12 "), passage))
            .otherwise(passage)
        )
        actual = (
            F.when(F.col("doc_id") % 11 == 0, F.lit("The context does not provide this."))
            .when(kind == 0, F.concat(F.lit("It says: "), text))
            .when(kind == 1, F.concat(F.lit("Yes. "), text))
            .when(kind == 4, F.concat(F.lit("It ran from 2024 to "), (F.lit(2025) + F.col("doc_id") % 2).cast("string")))
            .when(kind == 6, F.concat(F.lit("Some 12.1 "), text))
            .otherwise(text)
        )
        question = F.when(F.col("doc_id") % 3 == 0, F.lit("Name one of the parts")).otherwise(F.lit("What is thatnd of the onesen?"))
        return docs.join(items, "place").select(
            F.col("doc_id").alias("q_id"),
            question.alias("question"),
            expected.alias("expected"),
            actual.alias("actual"),
            F.col("lang").alias("category"),
            F.when(kind < 3, F.lit("Easy")).when(kind < 6, F.lit("medium")).otherwise(F.lit("hard")).alias("difficulty"),
            (F.col("doc_id") % 17 / 10.0).alias("latency_s"),
        )
