"""Confidence under a sequence of changes: an ordered, clamped fold per entity.

Clamping makes the order matter, and a decrease below the threshold archives a trusted entity
for good.  A run of changes still is one small function of the confidence before it, and functions
compose in any grouping: so changes are folded in a tree, in whole numbers, without rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import CONFIG, Config
from ..sources.stored import materialize


def feedback_delta(judgment: Column, config: Config = CONFIG) -> Column:
    """The change that a judgment makes; null for an unknown one."""
    out = None
    for name, delta in config.feedback_deltas:
        out = F.when(judgment == name, F.lit(delta)) if out is None else out.when(judgment == name, F.lit(delta))
    return out


#: Confidences and changes are whole numbers of this fraction while they are folded, so that sums
#: have no rounding and any grouping of the changes gives the same.
UNIT = 1_000_000
#: Changes, or functions, that one row composes.
BLOCK = 1024
_FAR = 2**62


def units(value: Column) -> Column:
    """A confidence or a change in millionths."""
    return F.round(value * UNIT).cast("long")


def change(delta: Column, config: Config = CONFIG) -> Column:
    """What a change in millionths does to the confidence c before it, as a function

        least(hi, greatest(lo, c + shift)), and below the threshold at a decrease where c < drop.
    """
    up = delta >= 0
    return F.struct(
        F.when(up, F.lit(-_FAR)).otherwise(F.lit(0)).cast("long").alias("lo"),
        F.when(up, F.lit(UNIT)).otherwise(F.lit(_FAR)).cast("long").alias("hi"),
        delta.alias("shift"),
        F.when(up, F.lit(-_FAR)).otherwise(F.lit(round(config.archive_below * UNIT)) - delta).cast("long").alias("drop"),
    )


def then(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``, as one function of the same form."""

    def clamped(x: Column) -> Column:
        return F.least(g["hi"], F.greatest(g["lo"], x + g["shift"]))

    # Where f's outcome is under g's threshold: always, from some confidence down, or never.
    under = F.when(f["hi"] < g["drop"], F.lit(_FAR)).when(f["lo"] < g["drop"], g["drop"] - f["shift"]).otherwise(F.lit(-_FAR))
    return F.struct(
        clamped(f["lo"]).alias("lo"), clamped(f["hi"]).alias("hi"), (f["shift"] + g["shift"]).alias("shift"),
        F.greatest(f["drop"], under).cast("long").alias("drop"),
    )


def _composed(rows: DataFrame, *by: str | Column) -> DataFrame:
    """One row (entity_id, ..., at, n, f) of each group of functions ``f``, in the order of ``at``."""
    parts = F.array_sort(F.collect_list(F.struct("at", "n", "f"))).alias("parts")
    grouped = rows.groupBy("entity_id", *by).agg(parts)
    kept = [c for c in grouped.columns if c != "parts"]
    first = F.element_at("parts", 1)
    rest = F.slice("parts", 2, F.size("parts"))
    f = F.aggregate(rest, first["f"], lambda a, p: then(a, p["f"]))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return grouped.select(*kept, first["at"].alias("at"), n.alias("n"), f.alias("f"))


def composed(changes: DataFrame, config: Config = CONFIG, block: int = BLOCK) -> DataFrame:
    """(entity_id, n, f): the changes (entity_id, seq, delta) of each entity, in the order of seq,
    as one function and their number.

    Changes are range-sorted by entity and order, so an entity is spread over as many tasks as it
    has rows for, and composed in a tree: blocks of rows that follow each other, then blocks of
    blocks, until an entity has few enough for one row.
    """
    keys = ["entity_id", "seq", "delta"]
    ranged = changes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows = ranged.select("entity_id", "at", F.lit(1).cast("long").alias("n"), change(F.col("delta"), config).alias("f"))
    width = block
    rows = materialize(_composed(rows, F.expr(f"at div {width}").alias("block")).drop("block"), "fold")
    while (rows.groupBy("entity_id").count().agg(F.max("count")).first()[0] or 0) > block:
        width *= block
        rows = materialize(_composed(rows, F.expr(f"at div {width}").alias("block")).drop("block"), "fold")
    return _composed(rows).drop("at")


def fold(entities: DataFrame, changes: DataFrame, config: Config = CONFIG, block: int = BLOCK) -> DataFrame:
    """Entities after ``changes`` (entity_id, seq, delta), in the order of seq.

    Adds ``n_changes``.  Changes of unknown entities, and null deltas, have no effect; an entity
    without a confidence stays so.  A confidence that changes is a whole number of millionths.
    """
    changes = changes.filter("delta is not null and entity_id is not null").select("entity_id", "seq", units(F.col("delta")).alias("delta"))
    joined = entities.join(composed(changes, config, block), "entity_id", "left")
    f, before = F.col("f"), units(F.col("confidence"))
    after = F.least(f["hi"], F.greatest(f["lo"], before + f["shift"])) / F.lit(float(UNIT))
    dropped = (before < f["drop"]) & (F.col("lifecycle_state") == "TRUSTED")
    new = {
        "confidence": F.when(f.isNotNull() & F.col("confidence").isNotNull(), after).otherwise(F.col("confidence")),
        "lifecycle_state": F.when(dropped, F.lit("ARCHIVED")).otherwise(F.col("lifecycle_state")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in entities.columns], F.coalesce("n", F.lit(0)).cast("int").alias("n_changes"))


def feedback(entities: DataFrame, records: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Entities after feedback (entity_id, judgment, created_at, feedback_id)."""
    changes = records.select("entity_id", F.struct("created_at", "feedback_id").alias("seq"), feedback_delta(F.col("judgment"), config).alias("delta"))
    return fold(entities, changes, config)


def feedback_by_response(
    entities: DataFrame, records: DataFrame, responses: DataFrame, bundles: DataFrame, config: Config = CONFIG
) -> tuple[DataFrame, DataFrame]:
    """(entities, errors) after feedback (feedback_id, response_id, judgment, created_at) on
    responses (response_id, bundle_id): each judgment counts for every entity of the response's
    bundle (bundle_id, entity_ids).

    Errors (feedback_id, response_id, error) are unknown judgments and responses that are not
    there, or whose bundle is not; an entity that a bundle repeats counts once.
    """
    held = responses.select("response_id", "bundle_id").join(bundles.select("bundle_id", "entity_ids"), "bundle_id")
    joined = records.join(held, "response_id", "left")
    delta = feedback_delta(F.col("judgment"), config)
    error = F.when(delta.isNull(), F.lit("unknown judgment")).when(F.col("bundle_id").isNull(), F.lit("unknown response"))
    judged = joined.withColumns({"delta": delta, "error": error})
    changes = judged.filter("error is null").select(
        F.explode(F.array_distinct("entity_ids")).alias("entity_id"), F.struct("created_at", "feedback_id").alias("seq"), "delta"
    )
    return fold(entities, changes, config), judged.filter("error is not null").select("feedback_id", "response_id", "error")


def feedback_records(records: DataFrame, responses: DataFrame, bundles: DataFrame) -> DataFrame:
    """The rows to store of feedback (feedback_id, response_id, judgment, human_correction, severity,
    created_at), in the columns of the feedback table: what was asked and answered, and the entities
    of the response's bundle, null where it has none.

    Feedback on unknown responses, with an unknown judgment or an unknown severity makes no row.
    """
    held = responses.select("response_id", "bundle_id", "query_text", F.col("answer").alias("response_text"))
    involved = bundles.select("bundle_id", F.array_distinct("entity_ids").alias("entities_involved"))
    found = records.join(held, "response_id").join(involved, "bundle_id", "left").withColumn("id", F.col("feedback_id").cast("string"))
    found = found.withColumn("entities_involved", F.when(F.size("entities_involved") > 0, F.col("entities_involved")))
    return schemas.conform(found.filter(schemas.valid("feedback")), "feedback")


def invalid_feedback(records: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Records whose judgment is not one of the known ones."""
    return records.filter(F.col("judgment").isNull() | ~F.col("judgment").isin(*[n for n, _ in config.feedback_deltas]))


def fileback(entities: DataFrame, responses: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Entities after answers (response_id, confidence, entity_ids): those that an uncertain
    answer rests on lose a little, the others gain a little."""
    delta = F.when(F.col("confidence") < config.fileback_below, F.lit(config.fileback_down)).otherwise(F.lit(config.fileback_up))
    changes = responses.select(F.explode("entity_ids").alias("entity_id"), F.col("response_id").alias("seq"), delta.alias("delta"))
    return fold(entities, changes, config)


def calibration(records: DataFrame, confidence: str = "confidence", correct: str = "correct", buckets: int = 10) -> DataFrame:
    """Predicted and actual rates by confidence bucket, and the gap (an extension)."""
    bucket = F.least(F.floor(F.col(confidence) * buckets), F.lit(buckets - 1)).cast("int")
    by = records.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("predicted"), F.avg(F.col(correct).cast("double")).alias("actual")
    )
    return by.withColumn("gap", F.abs(F.col("predicted") - F.col("actual")))
