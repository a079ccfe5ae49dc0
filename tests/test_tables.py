"""Tables with a key, the walk over chunks, timed searches, all similarities and English terms."""

import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from proofline.operators import chunking, keywords, retrieval
from proofline.sources import tables

COLUMNS = "`a.b` long, k string, list array<int>"


def rows(spark, ids, value=0):
    return spark.createDataFrame([(value, f"k{i}", [i]) for i in ids], COLUMNS)


def content(spark, path):
    return {r.k: r["a.b"] for r in tables.read_table(spark, path).collect()}


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.write_table(rows(spark, range(100)), path, "k", rows_per_bucket=10) == 100
    first = tables.read_table(spark, path)
    assert tables.write_table(rows(spark, [3, 200], 1), path, "k", rows_per_bucket=10) == 2
    assert content(spark, path) == {f"k{i}": 0 for i in range(100)} | {"k3": 1, "k200": 1}
    assert first.where("`a.b` = 1").count() == 0 and first.count() == 100  # what was read before stays
    folders = Counter(r.folder for r in tables._newest(spark, path))
    assert len(folders) == 2 and min(folders.values()) <= 2
    assert tables.read_table(spark, path).columns == ["a.b", "k", "list"]
    tables.write_table(rows(spark, range(1000, 1200)), path, "k", rows_per_bucket=10)  # dealt anew
    assert len(content(spark, path)) == 301 and tables._newest(spark, path)[0].buckets > 20
    tables.write_table(rows(spark, [1]), path, "k", recreate=True)
    assert content(spark, path) == {"k1": 0}


def test_a_write_that_ends_early_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_table(rows(spark, range(5)), path, "k")
    bad = rows(spark, [1, 2], 7).withColumn("list", F.when(F.col("k") == "k2", F.raise_error(F.lit("lost"))).otherwise(F.col("list")))
    with pytest.raises(Exception, match="lost"):
        tables.write_table(bad, path, "k")
    assert content(spark, path) == {f"k{i}": 0 for i in range(5)}

    def die(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # all files are there, the commit is not
        m.setattr(type(spark), "createDataFrame", die)
        with pytest.raises(KeyboardInterrupt):
            tables.write_table(rows(spark, [1, 2], 7), path, "k")
    assert content(spark, path) == {f"k{i}": 0 for i in range(5)}


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    assert tables.write_table(rows(spark, []), path, "k") == 0 and content(spark, path) == {}
    assert tables.write_table(rows(spark, [1]), path, "k") == 1 and tables.write_table(rows(spark, []), path, "k") == 0
    assert content(spark, path) == {"k1": 0}
    with pytest.raises(ValueError, match="repeat"):
        tables.write_table(rows(spark, [1, 1]), path, "k")
    with pytest.raises(ValueError, match="repeat"):
        tables.write_table(spark.createDataFrame([(1, None, [1])], COLUMNS), path, "k")
    with pytest.raises(ValueError, match="other columns"):
        tables.write_table(rows(spark, [2]).drop("list"), path, "k")
    assert content(spark, path) == {"k1": 0}


def walked(spans, quotas, per_chunk, seed):
    hashed = lambda *x: md5(":".join(map(str, (seed, *x))).encode()).hexdigest()
    room, given, taken = dict(quotas), Counter(), set()
    for s in sorted(set(spans), key=lambda s: (hashed(*s[:2]), hashed(*s[:4]), s[2], s[3])):
        if room.get(s[4], 0) > 0 and given[s[:2]] < per_chunk:
            room[s[4]] -= 1
            given[s[:2]] += 1
            taken.add(s)
    return taken


@pytest.mark.parametrize(("per_chunk", "quotas"), [(1, {"easy": 6, "medium": 5, "hard": 4}), (2, {"easy": 3, "medium": 30, "hard": 1}), (3, {"easy": 500, "medium": 500, "hard": 500}), (1, {"easy": 0, "hard": 2, "none": 4})])
def test_the_walk_over_chunks_is_the_plain_one(spark, per_chunk, quotas):
    rng = random.Random(per_chunk)
    spans = [(doc, c, first, n, ("easy", "medium", "hard")[min(2, n - 1 + (rng.random() < 0.2))] if doc % 5 else "easy") for doc in range(40) for c in range(3) for first in range(3) for n in range(1, 4 - first)]
    spans = [s for s in spans if s[4] != "hard" or s[0] > 30]
    frame = spark.createDataFrame(spans + spans[:1], "doc_id long, chunk_no int, first int, n int, difficulty string").repartition(5)
    found = chunking.greedy_spans(frame, quotas, per_chunk, seed=per_chunk)
    assert {tuple(r) for r in found.collect()} == walked(spans, quotas, per_chunk, per_chunk)
    assert chunking.greedy_spans(frame.where("false"), quotas).count() == 0


def test_timed_searches_find_all_and_say_how_long(spark):
    queries = spark.createDataFrame([(k, "a") for k in range(20)], "query_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "a b")], "doc_id long, text string")
    found, took = retrieval.timed(queries, lambda block: retrieval.bm25(block, docs, 1), 8)
    assert sorted(r.query_id for r in found.collect()) == list(range(20)) and {r.doc_id for r in found.collect()} == {1}
    times = took.collect()
    assert sum(r.n_queries for r in times) == 20 and len(times) > 1 and all(0 < r.latency_ms < 600_000 for r in times)
    found, took = retrieval.timed(queries.where("false"), lambda block: retrieval.bm25(block, docs, 1))
    assert found.count() == took.count() == 0


def test_english_terms(spark):
    text = "The dog's bodies and PONIES, boxes; it's the class' bus — shoes, James’s gas trees don't. As 3s"
    row = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(keywords.english_terms(F.col("text")).alias("t")).collect()
    assert row[0].t == ["dog", "body", "pony", "boxe", "class", "bus", "shoes", "jame", "gas", "trees", "don't", "3s"]
    assert row[1].t is None and row[2].t == []
    docs = spark.createDataFrame([(1, "The bodies of dogs"), (2, "a body"), (3, "the of")], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "the dog's body"), (2, "the of")], "query_id long, text string")
    found = retrieval.bm25(questions, docs, 5, keywords.english_terms).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (1, 2)]


def test_all_similarities(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "doc_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (9, None)], "query_id long, embedding array<double>")
    every = [1, 0, -1, 0, 0.6, 0.8, -0.6, 0]
    for size in (1, 512):
        found = retrieval.similarity_extent(queries, vectors, size=size).first()
        assert (found.n, found.low, found.high, round(found["mean"], 9)) == (8, -1.0, 1.0, round(sum(every) / 8, 9))
    found = retrieval.similarity_extent(queries, vectors, apart=True).first()
    assert (found.n, found.low, found.high) == (6, -1.0, 0.6)
    assert tuple(retrieval.similarity_extent(queries.where("false"), vectors).first()) == (0, None, None, None) == tuple(retrieval.similarity_extent(queries, vectors.where("false")).first())
