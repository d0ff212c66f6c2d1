"""Every registered query of the engine against its SQL."""

import pytest

from sagebrook.plans import registry

from .conftest import compare

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    compare(registry.queries()[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(registry.queries())


def test_flagship(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert registry.flagship(spark, sf_dir).count() == asked > 2
