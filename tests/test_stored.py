"""Who owns the tables between steps, and when they go."""

import os
import subprocess
import sys
from pathlib import Path

from sagebrook.sources import stored


def files(path):
    return [p for p in Path(path.removeprefix("file://")).rglob("*.parquet")]


def test_scratch_deletes_what_is_not_kept(spark):
    rows = spark.range(10)
    with stored.scratch(spark) as outer:
        with stored.scratch(spark) as inner:
            one, two = stored.materialize(rows, "one"), stored.materialize(rows, "two", keep=True)
            assert one.count() == two.count() == 10
            assert files(one._stored_at) and one._stored_at.startswith(inner) and two._stored_at.startswith(outer)
        assert not files(one._stored_at) and two.count() == 10
        stored.discard(two)
        assert not files(two._stored_at)
        three = stored.materialize(rows, "three", keep=True)
    assert three.count() == 10 and not Path(outer.removeprefix("file://")).exists()
    stored.discard(three)


def test_scratch_deletes_after_an_error(spark):
    try:
        with stored.scratch(spark):
            one = stored.materialize(spark.range(3), "one")
            raise RuntimeError
    except RuntimeError:
        assert not files(one._stored_at)


SESSION = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
import __spark_entry__ as entry
from pathlib import Path
for name in sys.argv[3:]:
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0
assert list(Path(sys.argv[1].removeprefix("file://")).rglob("*.parquet"))
spark.stop()
"""


def test_nothing_is_left_when_a_session_ends(tmp_path, sf_dir):
    root = Path(__file__).resolve().parent.parent
    env = os.environ | {"PYTHONPATH": str(root)}
    args = [sys.executable, "-c", SESSION, f"file://{tmp_path}", sf_dir, "feedback_fold", "khop_2"]
    subprocess.run(args, check=True, env=env, cwd=root, capture_output=True, timeout=300)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
