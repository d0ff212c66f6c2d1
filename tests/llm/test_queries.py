"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sagebrook.llm import chunks, minhash, pii, quality, queries

from ..conftest import compare
from . import helpers


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_matches_sql(spark, sf_dir, duck, name):
    compare(queries.QUERIES[name](spark, sf_dir), duck, queries.oracles()[name])


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_minhash", "op6_chunks", "op7_pii", "op8_suffixes"])
def test_whole_tables(spark, sf_dir, name):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    if name.startswith("op1"):
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
        for d, n, hit, many, sha, bad in helpers.contamination(docs, items):
            assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"], got[d]["items_sha256"], got[d]["contaminated"]) == (n, hit, many, sha, bad)
    elif name.startswith("op2"):
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == helpers.near_duplicates(docs)
    elif name.startswith("op7"):
        for d, text in docs:
            kinds = [s[2] for s in helpers.personal(text)]
            assert [got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
            assert got[d]["n_spans"] == len(helpers.more_personal(text))
            base = helpers.joined(helpers.personal(text))
            assert (got[d]["base_sha256"], got[d]["spans"]) == (hashlib.sha256(base.encode()).hexdigest(), helpers.joined(helpers.more_personal(text)))
    elif name.startswith("op6"):
        for d, want in helpers.without_chunks(docs, chunks).items():
            assert tuple(got[d][c] for c in ("n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256")) == want
    else:
        for (d, _), want in zip(docs, helpers.repeats([t for _, t in docs])):
            assert tuple(got[d][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, documents, rows, sf_dir, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    source = str(tmp_path / "sf")
    documents.write.parquet(f"{source}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(90)] + [(86, 0), (88, 0)], "doc_id long, quality int").write.parquet(f"{source}/labels.parquet")
    leak = " ".join(rows[71 - 14][1].split()[45:60]) if rows[71 - 14][1] else "x"
    items = [(1, leak)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{source}/benchmark.parquet")

    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{source}/documents.parquet")
    good = steps["quality"](spark, docs, source)
    assert good.columns == docs.columns
    scored = quality.quality(docs, spark.read.parquet(f"{source}/labels.parquet"))
    assert good.count() == scored.filter("predicted = 1").count()

    one = steps["near_duplicates"](spark, docs, source)
    assert one.columns == docs.columns
    parts = helpers.near_duplicates([(d, t) for d, t in {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 90}.items()])
    left = [r["doc_id"] for r in one.collect()]
    assert sorted(d for d in left if d is not None and d != 90) == sorted(d for d, (_, c) in parts.items() if d == c)
    # Of the two rows without an id one is a copy of others and one has no words.
    assert left.count(None) == 1 and left.count(90) == 1

    clean = steps["decontamination"](spark, docs, source)
    bad = {r[0] for r in helpers.contamination([r[:2] for r in rows], items) if r[5]}
    assert bad and sorted(map(str, [r["doc_id"] for r in clean.collect()])) == sorted(str(r[0]) for r in rows if r[0] not in bad)

    mixed = steps["mixing"](spark, one, source)
    assert mixed.columns == docs.columns
    from sagebrook.llm import mixing

    wanted = mixing.mix(one).filter("doc_id is not null").collect()
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in wanted}
    have = [r["doc_id"] for r in mixed.filter("doc_id is not null").collect()]
    assert all(have.count(d) == n for d, n in taken.items())
    assert set(steps["sharding"](spark, docs, source).columns) == {*docs.columns, "slot", "shard"}

    result = corpus_pipeline.run(spark, source)
    assert result.count() > 0 and set(result.columns) == {*docs.columns, "slot", "shard"}
    assert minhash.PERCENT == 75


def test_leaks_go_by_their_own_text(spark, tmp_path):
    import corpus_pipeline

    leak = "one two three four five six seven eight nine ten eleven"
    docs = [(None, f"so {leak} on"), (None, "clean without an id"), (None, None), (5, leak.upper()), (5, "clean under a repeated id"), (5, leak), (6, "clean"), (6, "clean"), (-(2**63), "least id")]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = [r[5] for r in helpers.contamination(docs, [(1, leak)])]
    assert bad.count(True) == 3
    clean = corpus_pipeline.not_in_benchmarks(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(str, map(tuple, clean.collect()))) == sorted(str(d) for d, b in zip(docs, bad) if not b)


def test_stages_with_clashing_names_and_without_rows(spark, rows, sf_dir):
    import corpus_pipeline

    some = [r for r in rows if r[0] is None or r[0] % 3 == 0]
    docs = spark.createDataFrame(some, helpers.DOCUMENTS)
    names = ["score", "__id", "__key", "__times", "__copy", "a.b", "c0", "c3", "slot", "shard", "k1", "rep", "key", "component_id"]
    more = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
        added = ["slot", "shard"] if name == "sharding" else []
        assert set(wide.columns) == {*docs.columns, *names}, name
        kept = [c for c in names if c not in added]
        got = wide.select(*[F.col(f"`{c}`") for c in [*docs.columns, *added]])
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(*docs.columns, *added).collect())), name
        values = [F.col(f"`{c}`") for c in kept]
        assert {tuple(r) for r in wide.select(*values).collect()} <= {tuple(names.index(c) for c in kept)}, name
        nothing = stage(spark, docs.limit(0), sf_dir)
        assert nothing.count() == 0 and set(nothing.columns) == {*docs.columns, *added}, name


def test_rows_without_ids_are_near_copies_too(spark, sf_dir):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten"
    docs = [(None, text, "x"), (None, text, "y"), (None, text + " eleven", "x"), (None, "another text altogether, of some words", "x"), (None, "", "x"), (None, None, "x"), (7, text, "x"), (9, "a b c d e f g", "x"), (9, "a b c d e f h", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    left = [corpus_pipeline.one_of_each(spark, d, sf_dir).collect() for d in (df, df.orderBy("text").repartition(3))]
    assert Counter(left[0]) == Counter(left[1])
    assert Counter(r["doc_id"] for r in left[0]) == {None: 3, 7: 1, 9: 1}


def test_personal_data_in_sql(rows):
    """The SQL is itself right on awkward rows: marks, separators and neighbours of runs."""
    import duckdb

    more = ["123-45-6789" + "é" * 38 + "tax 123-45-6780-1", "SSN 123-45-6789, 123-45-6788 tax 000-12-3456 social 12-123-45-6789"]
    more += ["\U0001f600 GB82 WEST 1234 5698 7654 32 xDE89370400440532013000 \x01DE89370400440532013000\x02", "4111  1111 4111111111111111 4111-1111 1111-1111"]
    more += ['token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "Key: aaaaaaaaaaaaaaaaaaaaaaaa ABC_def-123/456+789== passwords 123456789012345678901"]
    docs = [r[:2] for r in rows] + list(enumerate(more, 200))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = connection.execute(f"SELECT doc_id, n_spans, base_sha256, spans FROM ({pii.op7_sql()})").fetchall()
    want = []
    for d, text in docs:
        every = helpers.more_personal(text)
        want.append((d, len(every), hashlib.sha256(helpers.joined(helpers.personal(text)).encode()).hexdigest(), helpers.joined(every)))
    assert sorted(map(str, got)) == sorted(map(str, want))
