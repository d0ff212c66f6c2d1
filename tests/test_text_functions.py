from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagebrook.functions import chunking, modeltext, text, vector


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_entity_keywords_test_before_stripping(spark):
    found = one(spark, text.entity_keywords(F.col("q")), q="Who owns the PaymentService? is, ?")
    assert found == ["owns", "paymentservice", "is"]


def test_search_keywords_and_phrases(spark):
    q = "What is the Falcon X Engine budget (for 2024)?"
    assert one(spark, text.search_keywords(F.col("q")), q=q) == ["falcon", "engine", "budget", "2024"]
    assert one(spark, text.search_phrases(F.col("q")), q=q) == ["falcon engine", "engine budget", "budget 2024"]
    assert one(spark, text.search_phrases(F.col("q")), q="Michael Chang leads") == ["michael chang", "michael chang", "chang leads"]


def test_bigrams_of_few(spark):
    assert one(spark, text.bigrams(F.split(F.col("q"), " ")), q="one") == []


def test_last_index(spark):
    assert one(spark, text.last_index(F.col("q"), ". "), q="a. b. c") == 4
    assert one(spark, text.last_index(F.col("q"), ". "), q="abc") == -1


def test_title(spark):
    assert one(spark, text.title_of(F.col("q")), q="file:/a/b/run_book-1.v2.md") == "run book 1.v2"


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(vector.cosine(F.col("a"), F.col("b")).alias("c"), vector.cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert got["c"] == pytest.approx(0.5**0.5) and got["z"] is None
    assert vector.with_cosine(row, "a", [1.0, 1.0]).first()["similarity"] == pytest.approx(0.5**0.5)


def test_embedder_is_stable(spark):
    rows = spark.createDataFrame([("alpha",), (None,)], "t string")
    first = [r["embedding"] for r in vector.embed(rows, "t").collect()]
    assert first == [r["embedding"] for r in vector.embed(rows, "t").collect()]
    assert sum(x * x for x in first[0]) == pytest.approx(1.0, abs=1e-5) and not any(first[1])


@pytest.mark.parametrize(
    "length, chunks",
    [(0, 0), (700, 1), (800, 2), (1500, 3)],
)
def test_char_chunks_of_plain_text(length, chunks):
    """A last slice longer than size - overlap leaves a tail that the slice holds already."""
    assert len(chunking.char_chunks("x" * length)) == chunks


def test_char_chunks_cut_at_sentences():
    text_ = "a" * 500 + ". " + "b" * 600
    first, second = chunking.char_chunks(text_)[:2]
    assert first == "a" * 500 + "." and second.startswith("a" * 99 + ".")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_char_spans_cover_the_text(value):
    at = 0
    for start, stop in chunking.char_spans(value, 50, 10):
        assert start <= at and stop > at
        at = stop
    assert at >= len(value)


def test_sentences():
    got = chunking.sentences("First sentence here. Second one is here! tiny. And a last one here")
    assert [s[0] for s in got] == ["First sentence here.", "Second one is here! tiny.", "And a last one here"]
    assert [s[1:] for s in got] == [(0, 20, 0), (21, 46, 1), (47, 66, 2)]


def test_short_sentences_are_dropped_but_move_on():
    got = chunking.sentences("Short. This sentence is long enough.")
    assert got == [("This sentence is long enough.", 6, 35, 0)]


def test_pack_overlaps_whole_sentences():
    rows = [("x" * 400, 0, 0, i) for i in range(8)]
    packed = chunking.pack(rows, size=250, overlap=110)
    assert [[r[3] for r in c] for c in packed] == [[0, 1], [1, 2], [2, 3], [3, 4], [4, 5], [5, 6], [6, 7]]
    assert [[r[3] for r in c] for c in chunking.pack(rows, size=250, overlap=50)] == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_table_functions(spark):
    chunking.register(spark)
    spark.createDataFrame([(1, "A first sentence. Then a second sentence.")], "id int, t string").createOrReplaceTempView("d")
    rows = spark.sql("SELECT id, chunk_index, sentence_count FROM d, LATERAL sentence_chunks(t, 512, 50)").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 2)]
    assert spark.sql("SELECT * FROM char_chunks('abc', 800, 100)").collect()[0]["chunk_text"] == "abc"


def test_envelope(spark):
    docs = spark.createDataFrame([(1, "A first sentence. Then a second sentence."), (2, None)], "id int, t string")
    rows = chunking.envelope(docs, "id", "t").collect()
    assert [(r["id"], r["total_chunks"], r["total_sentences"]) for r in rows] == [(1, 1, 2)]


def test_json_repair(spark):
    cut = '```json\n[{"a\\_b": 1,}, {"c": [1, 2'
    assert one(spark, modeltext.repair_json(F.col("q")), q=cut) == '[{"a_b": 1}]'


def test_answers(spark):
    rows = spark.createDataFrame([('```json\n{"answer": ["x", "y"], "confidence": 2}\n```',), ("plain",)], "t string")
    got = [r["a"] for r in rows.select(modeltext.parse_answer(F.col("t")).alias("a")).collect()]
    assert (got[0]["answer"], got[0]["confidence"]) == ("x; y", 1.0)
    assert (got[1]["answer"], got[1]["confidence"], len(got[1]["caveats"])) == ("plain", 0.5, 1)


def test_sequence_ratio(spark):
    from sagebrook.operators.scoring import sequence_ratio

    assert one(spark, sequence_ratio("a", "b"), a="abcd", b="bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()
