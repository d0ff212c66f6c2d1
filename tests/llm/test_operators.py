"""The training-data operators on awkward rows, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import chunks, common, components, decontaminate, kernel, minhash, mixing, pii, quality, sharding, suffixes, vectors, warc

from . import helpers


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def known(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


# 1


def test_decontamination(spark, rows, documents, clashing):
    base, short = rows[21][1], rows[5][1]
    given = [(1, " ".join(base.split()[30:60])), (2, "Completely unseen words of an item that is nowhere in any document at all"), (10, "ONE"), (3, None), (4, "!!"), (None, short), (1, " ".join(base.split()[80:95]))]
    items = spark.createDataFrame(given, "item_id long, text string")
    want = Counter(helpers.contamination([r[:2] for r in rows], given))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert bag(decontaminate.contamination(documents, items), *names) == want
    assert bag(decontaminate.contamination(clashing, items.withColumn("phrase", F.lit(1))), *names) == want


def test_near_matches(spark):
    """Words put in, left out and exchanged hide a window from exact matches alone."""
    item = "one two three four five six seven eight nine ten"
    docs = [
        (1, f"so {item} on"), (2, "one two three four extra word five six seven eight nine ten"), (3, "two one three four five six eight seven nine ten"),
        (4, "one two three four five a b c d e six seven eight nine ten"), (5, "ten nine eight"), (6, None), (7, "alpha beta gamma"), (8, "beta alpha"), (9, "solo"),
    ]
    items = spark.createDataFrame([(1, item), (2, "alpha beta"), (3, "solo"), (4, item)], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert {r["doc_id"]: (r["n_items"], r["n_near"]) for r in got.collect()} == {1: (2, 2), 2: (0, 2), 3: (0, 2), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (1, 1), 8: (0, 1), 9: (1, 1)}


def test_decontamination_of_nothing(spark, documents, empty):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(documents, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red one two blue three four red"), (2, "blue red blue")], "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame([("red",), ("blue",)], "term string"))
    got = {(r["k1"], r["pos"], r["other"]) for r in decontaminate.proximity(index, "red", "blue", 3).collect()}
    assert got == {(1, 1, 4), (1, 7, 4), (2, 2, 1), (2, 2, 3)}


def test_decontamination_shuffles_beyond_bounds(spark, rows, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    given = [(1, " ".join(rows[21][1].split()[30:60]))]
    items = spark.createDataFrame(given, "item_id long, text string")
    assert bag(decontaminate.contamination(documents, items), "doc_id", "n_hit") == Counter((r[0], r[2]) for r in helpers.contamination([r[:2] for r in rows], given))


# 2


def check_groups(found, rows):
    once = {d: t for d, t in known(rows) if d not in (3, 90)}
    want = helpers.near_duplicates(list(once.items()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect() if r["doc_id"] in once}
    assert got == want


def test_near_duplicates(rows, documents, clashing):
    found = minhash.near_duplicates(documents)
    assert found.count() == len(rows)
    check_groups(found, rows)
    check_groups(minhash.near_duplicates(clashing), rows)
    loose = found.filter("doc_id is null").collect()
    assert {(r["component_id"], r["kept"]) for r in loose} == {(None, True)}
    # Two texts of one doc_id are one document.
    assert {r["component_id"] for r in found.filter("doc_id = 90").collect()} == {90}


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_with_stored_sides(rows, documents, monkeypatch):
    """Where ids and sub-keys are too many to be broadcast uncounted, they are stored and the result is the same."""
    made = []
    monkeypatch.setattr(minhash, "NARROW_ROWS", -1, raising=False)
    monkeypatch.setattr(components, "NARROW_ROWS", 0)
    monkeypatch.setattr(minhash, "materialize", lambda df, name: made.append(name) or common.materialize(df, name))
    check_groups(minhash.near_duplicates(documents), rows)
    assert {"minhash-least", "minhash-open-several", "minhash-open-some", "minhash-met", "minhash-lone", "minhash-core"} <= set(made)


def test_near_duplicates_take_few_tasks(spark):
    """What is small is not stored and counted between two shuffles, which costs a task for each of their partitions."""
    rng = random.Random(4)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else "x" for w in words[i % 20])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    now = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("few tasks", "")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in now.items():
            spark.conf.set(key, value)
    assert got == helpers.near_duplicates(rows)
    track = context.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("few tasks") for s in track.getJobInfo(j).stageIds}
    wide = [i for i in map(track.getStageInfo, stages) if i and i.numCompletedTasks >= 40]
    assert 0 < len(wide) <= 35, len(wide)


def test_large_group_of_near_copies(spark):
    """Copies edited so much that many do not link: every component is right all the same."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(400):
        copy = list(words)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    want = helpers.near_duplicates(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def thue_morse(n):
    """Two different words of n letters whose polynomial hashes modulo 2**64 are equal from
    n = 1024 on, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_forged_words_do_not_link(spark):
    rows = []
    for i, n in enumerate((1024, 2048, 4096)):
        a, b = thue_morse(n)
        rows += [(10 * i, a), (10 * i + 1, b), (10 * i + 2, f"one two {a} three four"), (10 * i + 3, f"one two {b} three four")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {d: d for d, _ in rows}


@pytest.mark.parametrize("block, cut", [(512, 8), (7, 8), (7, 1), (3, 0)])
def test_block_pairs_find_all_links(spark, block, cut):
    """Whatever the size of blocks and where groups are cut: the links of any two classes that
    meet in a table and are in different components."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        copy = list(words)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(copy), i % 7 if i % 3 else 0))
    docs = spark.createDataFrame(texts, "doc_id long, text string, part long")
    sets = common.materialize(common.batched(docs.select("doc_id", "text"), minhash._sets(14, 2, 5), "doc_id long, s binary, a array<long>, b array<long>"), "test")
    open_ = sets.join(docs.select("doc_id", "part"), "doc_id").select(F.col("doc_id").alias("rep"), "part", (F.octet_length("s") / 8).cast("long").alias("n"), F.posexplode("a").alias("i", "k"))
    got = [(r["u"], r["v"]) for r in minhash._blocked(open_, sets, 75, "test", block, cut).collect()]
    keys = {r["doc_id"]: (r["a"], r["b"]) for r in sets.collect()}
    want = set()
    for i, t, p in texts:
        for j, u, q in texts[:i]:
            meet = all(any(x == y for x, y in zip(keys[i][c], keys[j][c])) for c in (0, 1))
            s, r = helpers.shingles(t), helpers.shingles(u)
            if p != q and meet and 100 * len(s & r) >= 75 * len(s | r):
                want.add((j, i))
    assert want and len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == want


def test_pieces_find_all_links(monkeypatch):
    """Small pieces give what one piece gives."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(40)]
    monkeypatch.setattr(minhash, "PIECE", 7)
    got = minhash._intersections(sets, sets)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (None, 3)] + [(1000, i) for i in range(1001, 1100)]
    found = components.components(spark.createDataFrame(pairs, "u long, v long"))
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert {r["node"]: r["component"] for r in found.collect()} == helpers.union_find(real, {x for p in real for x in p})
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_components_stop_at_stars(spark, monkeypatch, bound):
    """One round settles what one round can settle, with what is sent to all or shuffled."""
    made = []
    monkeypatch.setattr(components, "NARROW_ROWS", bound, raising=False)
    monkeypatch.setattr(components, "materialize", lambda *a: made.append(a) or common.materialize(*a))
    pairs = [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(5)] + [(50, 51), (52, 51), (None, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(40)} | {i: 50 for i in (50, 51, 52)}
    assert len(made) == 2
    chain = [(i, i + 1) for i in range(60)]
    assert {r["component"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0}


# 3


def embeddings():
    rng = np.random.default_rng(2)
    out = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    for i in range(60):
        out.append((200 + i, (np.array(out[i % 7][1]) + rng.normal(size=8) * 0.25).tolist()))
    out += [(300, None), (301, [0.0] * 8), (302, [1.0, None] * 4), (303, [math.nan] * 8), (304, [math.inf] * 8), (305, []), (306, [1.0, 2.0])]
    out += [(310 + i, out[0][1]) for i in range(3)] + [(5, out[5][1]), (307, (np.array(out[1][1]) * 3).tolist()), (308, [1.0, 2.0]), (None, out[0][1])]
    return out


def brute_links(rows):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(p, q) for p in range(len(good)) for q in range(len(good)) if p != q and len(good[p][1]) == len(good[q][1]) and good[p][1] @ good[q][1] / (np.linalg.norm(good[p][1]) * np.linalg.norm(good[q][1])) >= 0.9]
    many = Counter(p for p, _ in links)
    parts = helpers.union_find([(good[p][0], good[q][0]) for p, q in links], {i for i, _ in rows if i is not None})
    return good, many, parts


@pytest.mark.parametrize("pivots, block", [((1, 2, 4, 8, 16), 4096), ((16,), 40), ((1,), 30)])
def test_vectors(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = embeddings()
    # Vectors at double precision: some components are no single-precision numbers.
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rep int")
    got = vectors.near_vectors(df).collect()
    good, many, parts = brute_links(rows)
    assert len(got) == len(rows)
    assert Counter((r["vec_id"], r["n_links"]) for r in got) == Counter([(i, many[p]) for p, (i, _) in enumerate(good)] + [(i, 0) for i, v in rows if not any(i == j for j, _ in good)])
    assert all(r["component_id"] == parts[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_vectors_of_one_id_count_their_own_links(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (8, [0.0, 1.0, 0.01]), (9, [0.0, 1.0, 0.02])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter([(5, 1, 5), (5, 2, 5), (7, 1, 5), (8, 2, 5), (9, 2, 5)])


def test_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 4


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, free = share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(rows, documents, clashing):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(sizes)
    got = mixing.mix(documents).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[round(r["target"], 6)] += r["taken"]
    for source, target in want.items():
        sums = {0}
        for _, text, _, mine, _ in rows:
            if mine == source:
                sums |= {s + len((text or "").split()) for s in sums}
        whole = int(round(target)) // sizes[source]
        nearest = min(abs(s + whole * sizes[source] - round(target)) for s in sums) if whole < 2 else 0
        assert abs(taken[round(target, 6)] - round(target)) == nearest
    names = ["doc_id", "size", "taken"]
    assert bag(mixing.mix(documents), *names) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == bag(mixing.mix(clashing.repartition(5)), *names)


def test_mixing_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert mixing.mix(none).first()["taken"] == 0


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_exact_where_it_can_be(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 60, 12))
    counts = rng.integers(1, 6, len(lengths))
    total = int((lengths * counts).sum())
    reachable = {0}
    for n, c in zip(lengths.tolist(), counts.tolist()):
        reachable = {s + n * k for s in reachable for k in range(c + 1)}
    for budget in rng.integers(0, total + 10, 20).tolist():
        took = mixing.fill(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        got = int((took * lengths).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in reachable) or budget >= total


@pytest.mark.parametrize("unit, most", [(1, 300), (7, 60), (1000, 40), (4001, 12)])
def test_fill_is_exact_for_long_documents(unit, most):
    """Lengths and budgets far above any bound of a plain table over sums."""
    rng = np.random.default_rng(unit)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, most, rng.integers(1, 6))) * unit
        counts = rng.integers(0, 6, len(lengths))
        total = int((lengths * counts).sum())
        reachable = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reachable = {s + n * k for s in reachable for k in range(c + 1)}
        for budget in rng.integers(0, total + 10, 6).tolist():
            took = mixing.fill(lengths, counts, budget)
            assert (took <= counts).all() and (took >= 0).all()
            assert int((took * lengths).sum()) == min(reachable, key=lambda s: (abs(s - budget), s)) or budget >= total


def test_fill_reaches_what_can_be_reached():
    for lengths, counts, budget in [([39_000, 20_000], [1, 3], 60_000), ([39_000, 20_000], [10, 30], 100_000), ([39_999, 20_000], [10**6] * 2, 2 * 10**9 + 7777)]:
        took = mixing.fill(np.array(lengths), np.array(counts), budget)
        assert int((took * np.array(lengths)).sum()) == budget


def test_mixing_of_a_whole_table(spark, sf_dir):
    """All rows, targets by hand, and no other take of a source's documents nearer to its target."""
    docs = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sizes = Counter()
    for _, source, n in docs:
        sizes[source] += n
    want, got = brute_targets(sizes), {r["doc_id"]: r for r in mixing.op4(spark, sf_dir).collect()}
    assert {(r["doc_id"], r["size"]) for r in got.values()} == {(d, n) for d, _, n in docs}
    for source, target in want.items():
        mine = [(got[d], n) for d, s, n in docs if s == source]
        assert all(r["source_size"] == sizes[source] and abs(r["target"] - target) < 1e-6 for r, _ in mine)
        assert all(r["taken"] in (0, n, 2 * n) for r, n in mine)
        sums = 1
        for _, n in mine:
            sums |= sums << n
        rest = round(target) - round(target) // sizes[source] * sizes[source] if round(target) < 2 * sizes[source] else 0
        miss = next(e for e in range(10**6) if rest - e >= 0 and sums >> (rest - e) & 1 or sums >> (rest + e) & 1)
        assert abs(sum(r["taken"] for r, _ in mine) - round(target)) == miss


def test_fill_hits_large_budgets():
    lengths, counts = np.arange(1, 3000), np.full(2999, 50)
    took = mixing.fill(lengths, counts, 12_345_678)
    assert int((took * lengths).sum()) == 12_345_678 and (took <= counts).all()


# 5

PAGES = [(1, "u1", "<p>same</p>"), (7, "u7", "<p>same</p>"), (5, "u\r\n5", "<p>same</p>"), (2, None, None), (3, "u3", ""), (4, "u4", "é\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u9", "x" * 100_000), (9, "u9", "x" * 100_000), (None, "u", "lone"), (None, "v", "<p>same</p>")]


def expected_pages(pages, least=0):
    import base64

    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        response = len(body) < least or i == top
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else top))
    return Counter(out)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 20])
def test_warc(spark, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, sha256 int")
    assert bag(warc.round_trip(pages, least), *COLUMNS) == expected_pages(PAGES, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_holds_each_payload_once_and_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    at = f"file://{tmp_path}/archive"
    warc.write_archive(pages, at)
    assert spark.read.parquet(f"{at}/payloads").count() == 5
    records = warc.restore(spark, at)
    warc.write_files(records, f"file://{tmp_path}/files")
    back = warc.read_files(spark, f"file://{tmp_path}/files/*")
    whole = [(bytes(r["header"]), bytes(r["payload"])) for r in records.collect()]
    revisit = [(h, b"" if b"WARC-Type: revisit" in h else p) for h, p in whole]
    assert Counter((bytes(r["header"]), bytes(r["payload"])) for r in back.collect()) == Counter(revisit)
    said = warc.parse(records).collect()
    assert all(r["stated_digest"] == "sha1:" + r["payload_digest"] for r in said)
    # Equal rows are records of their own, and urls come back as they were.
    assert len({r["record_id"] for r in said}) == len(PAGES) and Counter(r["url"] for r in said) == Counter(p[1] for p in PAGES)


def test_damaged_files_are_rows(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, f"file://{tmp_path}/a")
    warc.write_files(warc.restore(spark, f"file://{tmp_path}/a").coalesce(1), f"file://{tmp_path}/f")
    whole = next((tmp_path / "f").glob("part-*")).read_bytes()
    (tmp_path / "g").mkdir()
    for name, data in {"whole": whole, "cut": whole[:-40], "empty": b"", "other": b"no archive"}.items():
        (tmp_path / "g" / name).write_bytes(data)
    rows = [(r["path"].rsplit("/", 1)[1], r["error"] is None) for r in warc.read_files(spark, f"file://{tmp_path}/g/*").collect()]
    assert Counter(rows) == Counter({("whole", True): 3, ("cut", True): 2, ("cut", False): 1, ("other", False): 1})


def test_damaged_archives_are_refused(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    warc.write_archive(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"), at)
    stored = spark.read.parquet(f"{at}/payloads")
    import zstandard

    bad = zstandard.ZstdCompressor().compress(b"other")
    stored.withColumn("packed", F.lit(bytearray(bad))).write.parquet(f"{at}/p2")
    spark.read.parquet(f"{at}/p2").write.mode("overwrite").parquet(f"{at}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.restore(spark, at).collect()


# 6


def test_chunks(rows, documents, clashing, empty):
    got = chunks.deduplicate(documents)
    assert got.count() == len(rows)
    unique = sorted({(-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows if not (r[0] is None and r[1] is None)}, key=lambda x: (x[0], 0))
    parts = {x: helpers.chunked(x[1].encode(), chunks) for x in unique}
    often = Counter(x[1].encode()[a:b] for x in unique for a, b in parts[x])
    have = {(r["doc_id"], r["n_bytes"]): r for r in got.collect()}
    for doc, text in unique:
        data = text.encode()
        r = have[(None if doc == -(2**63) else doc, len(data))]
        assert r["n_chunks"] == len(parts[(doc, text)])
        assert r["n_shared"] == sum(b - a for a, b in parts[(doc, text)] if often[data[a:b]] > 1)
    first = got.filter("doc_id = 20").first()
    copies = got.filter("doc_id between 21 and 25").collect()
    assert {r["n_removed"] for r in copies} == {first["n_bytes"]} and {r["kept_sha256"] for r in copies} == {hashlib.sha256(b"").hexdigest()}
    names = ["doc_id", "n_bytes", "n_removed", "kept_sha256"]
    assert bag(got, *names) == bag(chunks.deduplicate(clashing), *names)
    assert chunks.deduplicate(empty).count() == 0


def test_short_copies_go_whole(spark):
    rows = [(1, "a short text"), (2, "a short text"), (3, ""), (4, None), (5, "another"), (6, "a short text")]
    got = chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got.collect()} == {1: (0, 0), 2: (12, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (12, 1)}


def test_cuts_resist_shifts():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate((data[:5000], [65], data[5000:])).astype(np.uint8)
    a = {data[s:e].tobytes() for s, e in zip(*chunks.cuts(data, np.array([0, len(data)])))}
    b = {moved[s:e].tobytes() for s, e in zip(*chunks.cuts(moved, np.array([0, len(moved)])))}
    assert len(a - b) <= 3


# 7


def test_personal_data(rows, documents, clashing, empty):
    found = pii.detect(documents, columns=["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    for r in found:
        base = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["pii"] if s["rank"] < pii.BASE]
        assert base == helpers.personal(r["text"])
    added = {s["kind"] for r in found for s in r["pii"] if s["rank"] >= pii.BASE}
    assert added == {"iban", "ssn", "secret"}
    wide = pii.detect(clashing)
    assert set(wide.columns) == set(clashing.columns) and pii.detect(empty).count() == 0
    values = {r["text"]: r["pii"] for r in found}
    same = [c for c in clashing.columns if c not in ("pii", *documents.columns)]
    expected = clashing.first().asDict()
    for r in wide.collect():
        assert r["pii"] == values[r["text"]] and all(r[c] == expected[c] for c in same)


def test_many_matches_and_hostile_texts(spark):
    texts = ["1.2.3.4 " * 2000, "a" * 100_000 + "@", "a." * 30_000 + "@b", "x@" + "a." * 30_000 + "b", "1 2-" * 20_000, "+1 " + "(" * 50_000, "é1.2.3.4 €+1 2345678901", "4" * 60_000, "00000000001.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["pii"] if s["rank"] < pii.BASE] == helpers.personal(r["text"])


def test_checksums(spark):
    row = spark.range(1).select(
        pii.luhn(F.lit("4111111111111111")).alias("a"), pii.luhn(F.lit("4111111111111112")).alias("b"), pii.mod97(F.lit("GB82 WEST 1234 5698 7654 32")).alias("c"), pii.mod97(F.lit("GB82WEST12345698765433")).alias("d")
    ).first()
    assert list(row) == [True, False, True, False]


# 8


def test_repeats(rows, documents, clashing, empty):
    want = Counter((r[0], *x) for r, x in zip(rows, helpers.repeats([r[1] for r in rows])))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert bag(suffixes.deduplicate(documents), *names) == want
    assert bag(suffixes.deduplicate(clashing), *names) == want
    assert suffixes.deduplicate(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_edges(spark, seed):
    """Passages around the threshold, cut at every length, in texts of few letters."""
    rng = random.Random(seed)
    passage = "".join(rng.choices("ab ", k=330))
    rows = []
    for i in range(60):
        at, size = rng.randrange(0, 60), rng.choice([150, 199, 200, 201, 207, 230, 260])
        rows.append((i, "".join(rng.choices("xyz", k=rng.randrange(0, 50))) + passage[at : at + size] + "".join(rng.choices("xyz", k=rng.randrange(0, 50)))))
    rows += [(100, "ab" * 400), (101, "ab" * 120), (102, "é" * 99), (103, "é" * 100), (104, "é" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((r[0], *x) for r, x in zip(rows, helpers.repeats([r[1] for r in rows])))
    assert bag(suffixes.deduplicate(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_forged_passages_stay(spark):
    """Strings that a polynomial hash modulo 2**64 takes for equal."""
    a, b = thue_morse(1024)
    rows = [(1, a), (2, b), (3, "x" + a[:900]), (4, None)]
    got = bag(suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((r[0], *x) for r, x in zip(rows, helpers.repeats([r[1] for r in rows])))


@pytest.mark.parametrize("length, gram", [(200, 64), (64, 64), (65, 64), (128, 64), (150, 16), (129, 64)])
def test_every_position(spark, length, gram):
    """Doubling over all positions, and over what leaders leave, finds what counting does."""
    rng = random.Random(length)
    passage = "".join(rng.choices("ab ", k=330))
    texts = []
    for i in range(40):
        at, size = rng.randrange(0, 60), rng.choice([30, 150, 199, 200, 201, 230, 260])
        texts.append("".join(rng.choices("xyz", k=rng.randrange(0, 50))) + passage[at : at + size])
    texts += ["", "é" * 90, "ab" * 200]
    often = Counter(b[i : i + length] for b in map(str.encode, texts) for i in range(len(b) - length + 1))
    want = {(d, i) for d, t in enumerate(texts) for i in range(len(t.encode()) - length + 1) if often[t.encode()[i : i + length]] > 1}
    docs = suffixes.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    got = [(r["k1"], r["first"]) for r in suffixes.every_position(docs, length, gram).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    if gram < length:
        _, ranges, _ = suffixes.repeated_windows(docs, length, gram)
        assert {(r["k1"], i) for r in ranges.collect() for i in range(r["first"], r["last"] + 1)} == want


# 9


def test_quality(spark, sf_dir, documents, rows, clashing, empty):
    docs, labels = common.table(spark, sf_dir.replace("sf0.001", "sf0.1"), "documents"), common.table(spark, sf_dir.replace("sf0.001", "sf0.1"), "labels")
    scored = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in scored) / len(scored)
    kept = [r["predicted"] for r in scored if r["quality"] == 1]
    assert right > 0.97 and sum(kept) / len(kept) > 0.99
    mine = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = quality.quality(documents, mine)
    assert got.count() == len(rows) and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert bag(got, "doc_id", "score") == bag(quality.quality(clashing, mine), "doc_id", "score")
    assert {r["score"] for r in quality.quality(documents, mine.limit(0)).collect()} == {0.5}
    assert quality.quality(empty, mine).count() == 0


def test_scores_are_those_of_plain_loops(spark, documents, rows):
    """Every score against features and updates written apart, one number at a time."""
    import zlib

    given = [(i, i % 3 % 2) for i in range(85)] + [(87, 1), (None, 1), (83, None)]
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    got = quality.quality(documents, labels).collect()
    texts = [r[:2] for r in rows]
    order = {r["d"]: r["o"] for r in spark.range(100).select(F.col("id").alias("d"), F.xxhash64("id", F.lit(29)).alias("o")).collect()}
    known = {d: q for d, q in given if d is not None and q is not None and zlib.crc32(str(d).encode()) % 5}
    taught = [(order[d], known[d], t) for d, t in texts if d in known]
    features = {t: helpers.quality_features(t, quality.BITS) for _, t in texts}
    weight = helpers.ftrl([(features[t], q) for _, q, t in sorted(taught, key=lambda r: r[0])], quality.EPOCHS, quality.ALPHA, quality.BETA, quality.L1, quality.L2)
    want = Counter((d, round(helpers.sigmoid(sum(weight(i) * x for i, x in features[t].items())), 6)) for d, t in texts)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == want
    assert len({s for _, s in want}) > 20
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_held_out_labels_teach_nothing(spark, documents):
    import zlib

    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 0) for i in ids], "doc_id long, quality int")
    assert not quality.fit(documents, labels).any()
    assert {r["doc_id"] for r in quality.quality(documents, labels).filter("held_out and doc_id is not null").collect()} <= set(ids)


# 10


def test_sharding(rows, documents, clashing, empty):
    placed = sharding.place(documents)
    assert placed.columns == [*documents.columns, "slot", "shard"]
    by_id = defaultdict(set)
    for r in placed.collect():
        by_id[r["doc_id"]].add(r["shard"])
        want = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r["slot"] == want and r["shard"] == sharding.lookup_table(sharding.shard_names())[want]
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.place(clashing).count() == len(rows) and sharding.place(empty).count() == 0


def test_lookup_tables_are_even_and_steady():
    names = sharding.shard_names(16)
    full = sharding.lookup_table(names, 4099)
    shares = Counter(full).values()
    assert max(shares) - min(shares) <= 1
    less = sharding.lookup_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(full, less) if a != 15)
    assert moved / 4099 < 0.25
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 4099)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4098)


# the kernel


def test_words_of_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kernel, "SLICE_BYTES", 7)
    texts = ["a bb", None, "", " c\n", "dddddddddddd e", "é ü"]
    assert kernel.count_words(pa.array(texts)).tolist() == [len((t or "").split()) for t in texts]
    assert kernel.count_words(pa.array(texts).slice(2)).tolist() == [len((t or "").split()) for t in texts[2:]]


def test_span_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abc xabc abc", dtype=np.uint8)
    a, b, c = kernel.span_hashes(data, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert a == b == c != kernel.span_hashes(data, np.array([4]), np.array([7]))[0]


def test_span_hashes_of_every_length():
    data = np.frombuffer(bytes(random.Random(1).choices(range(256), k=300)), dtype=np.uint8)
    starts, ends = (x.ravel() for x in np.meshgrid(np.arange(0, 150, 7), np.arange(150, 300, 11)))
    twice = np.concatenate((np.zeros(5, np.uint8), data, data[:3]))
    assert (kernel.span_hashes(data, starts, ends) == kernel.span_hashes(twice, starts + 5, ends + 5)).all()
    short = np.arange(60)
    hashes = kernel.span_hashes(data, short * 0 + 100, short + 100)
    assert len(set(hashes.tolist())) == 60
