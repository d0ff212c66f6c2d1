"""State under a versioned manifest, against one upsert of all writes."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sagebrook.operators import memory
from sagebrook.sources.keyed import Conflict, KeyedTable

T0 = dt.datetime(2024, 1, 1)
WRITES = "session_id string, key string, value string, agent string, step_number int, created_at timestamp_ntz, expires_at timestamp_ntz, seq long"


def writes(spark, rows):
    out = [(f"s{s}" if s is not None else None, f"k{k}", f"v{n}", None if n % 5 == 0 else "a", n % 3, T0 + dt.timedelta(hours=n), T0 + dt.timedelta(days=n % 9), n) for n, (s, k) in rows]
    return spark.createDataFrame(out, WRITES)


def state(df):
    return sorted(map(str, df.select("session_id", "key", "value", "agent", "step_number", "created_at", "expires_at").collect()))


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_batches_in_any_order_equal_one_upsert(spark, tmp_path):
    rng = random.Random(3)
    rows = [(n, (rng.randrange(12) if n % 17 else None, rng.randrange(6))) for n in range(300)]
    rng.shuffle(rows)
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4, most_folders=3)
    for i in range(6):
        table.write(writes(spark, rows[i * 50 : i * 50 + 50]), i)
        table.write(writes(spark, rows[i * 50 : i * 50 + 50]), i)  # once more: nothing changes
    assert all(len(names) <= 3 for names in table.manifest()["folders"].values())
    assert state(table.read()) == state(memory.upsert(writes(spark, rows)))
    # A version stays what it was until it is vacuumed.
    first = state(table.read(1))
    assert first == state(memory.upsert(writes(spark, rows[:50])))
    assert table.vacuum(1) > 0 and state(table.read()) == state(memory.upsert(writes(spark, rows)))
    assert len(table.versions()) == 1


def test_a_small_batch_writes_few_bytes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    many = spark.range(100_000).select(
        F.concat(F.lit("s"), F.col("id") % 1000).alias("session_id"), F.concat(F.lit("k"), "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"),
        F.lit("a").alias("agent"), F.lit(1).alias("step_number"), F.lit(T0).cast("timestamp_ntz").alias("created_at"), F.lit(T0).cast("timestamp_ntz").alias("expires_at"), F.col("id").alias("seq"),
    )
    table.write(many)
    before = size(tmp_path)
    table.write(many.filter("seq % 100 = 0").withColumn("seq", F.col("seq") + 10**6))
    assert size(tmp_path) - before < 0.03 * before
    assert table.read().count() == 100_000


def test_a_stopped_writer_loses_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=2)
    table.write(writes(spark, [(1, (1, 1)), (2, (2, 2))]), 0)
    before = state(table.read())
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.write(writes(spark, [(3, (1, 1))]), 1)
    monkeypatch.undo()
    assert state(table.read()) == before
    table.write(writes(spark, [(3, (1, 1))]), 1)
    assert state(table.read()) == state(memory.upsert(writes(spark, [(1, (1, 1)), (2, (2, 2)), (3, (1, 1))])))
    assert table.vacuum() == 1


def test_two_writers_do_not_replace_each_other(spark, tmp_path):
    one, two = (KeyedTable(spark, str(tmp_path / "t"), buckets=2) for _ in range(2))
    one.write(writes(spark, [(1, (1, 1))]))
    stale = two.manifest()
    one.write(writes(spark, [(2, (2, 2))]))
    with pytest.raises(Conflict):
        two._commit(stale, {}, None)
    assert len(state(one.read())) == 2 and not list((tmp_path / "t" / "versions").glob("*.new"))


def test_deletes_and_expiry(spark, tmp_path):
    rows = [(n, (n % 5, n % 4)) for n in range(40)]
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read().count() == 0 and table.delete("s1") == 0
    table.write(writes(spark, rows))
    whole = memory.upsert(writes(spark, rows))
    assert table.delete("s1", "k2") == 1 and table.delete("s3") == 4 and table.delete("none") == 0
    left = whole.filter("not (session_id = 's1' and key = 'k2') and session_id <> 's3'")
    assert state(table.read()) == state(left)
    as_of = F.lit(T0 + dt.timedelta(days=4)).cast("timestamp_ntz")
    table.compact(as_of)
    assert state(table.read()) == state(memory.cleanup(left, as_of)[0])


@pytest.mark.parametrize("seed", range(3))
def test_lineage_over_many_rounds(spark, seed):
    """Long chains, revivals, and edges that end at the last survivor; no entity gets lost."""
    from sagebrook.operators import lineage

    rng = random.Random(seed)
    alive, rows = [f"e{i}" for i in range(60)], []
    for round_ in range(1, 30):
        gone, kept = (rng.sample(alive, 2) if len(alive) > 3 else (None, None))
        if gone:
            alive.remove(gone)
            rows.append((gone, kept, "merge", round_))
    # One that was merged away lives again: another goes into it later.
    revived, last = rows[4][0], alive.pop()
    rows.append((last, revived, "merge", 40))
    alive.append(revived)
    into = {e: i for e, i, _, _ in rows if e != revived}

    def end(e):
        steps = 0
        while e in into:
            e, steps = into[e], steps + 1
        return e, steps

    history = spark.createDataFrame(rows, lineage.SCHEMA)
    got = {r["entity_id"]: (r["survivor"], r["steps"]) for r in lineage.survivors(history).collect()}
    assert got == {e: end(e) for e in into}
    assert {s for s, _ in got.values()} <= set(alive)
    edges = spark.createDataFrame([(f"r{i}", f"e{i}", f"e{59 - i}", "X") for i in range(60)], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string")
    led = lineage.lead(edges, history).collect()
    assert len(led) == 60 and all((r["source_entity_id"], r["target_entity_id"]) == (end(f"e{r['relationship_id'][1:]}")[0], end(f"e{59 - int(r['relationship_id'][1:])}")[0]) for r in led)
