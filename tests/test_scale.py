"""Steps whose memory or time grew faster than their input."""

import random

import numpy as np
import pyarrow as pa
from proofline.operators import cells, chunking, keywords, retrieval
from proofline.plans import indexing
from proofline.sources import providers, sinks
from pyspark.sql import functions as F


def _sorts(found):
    return found._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_blocks_of_queries_share_one_ranking(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "doc_id long, embedding array<double>")
    q = v.withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_search(q, v, 3, apart=True, size=1000).collect()))
    found = retrieval.vector_search(q, v, 3, apart=True, size=10)
    assert _sorts(found) == 1 and sorted(map(tuple, found.collect())) == want


def test_cells_share_one_ranking(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "doc_id long, embedding array<double>")
    q = v.withColumnRenamed("doc_id", "query_id")
    blocks = lambda rows, key: retrieval.in_blocks(rows, key, 10)
    monkeypatch.setattr(cells, "in_blocks", blocks)
    found = cells.cell_search(q, cells.build_cells(v, 3), 3)
    assert _sorts(found) == 1 and found.groupBy("query_id").count().where("count > 3").isEmpty()


def test_recall_of_class_is_that_of_all_pairs(spark):
    at = random.Random(3)
    rows = [(i, at.choice([0, 1, 2, None])) for i in range(30)] + [(i, 1) for i in range(0, 30, 4)]
    q = spark.createDataFrame([r for r in rows if r[0] % 3 == 0] + [(99, 2)], "query_id int, label int")
    members = spark.createDataFrame(rows, "sid int, label int")
    pool = spark.createDataFrame([(a, at.randrange(30)) for a in range(0, 30, 3) for _ in range(6)], "query_id int, sid int")
    gold = q.join(members, "label").where("query_id <> sid").select("query_id", "sid").distinct()
    want = retrieval.recall_at_k(gold, pool, q.select("query_id").distinct())
    found = retrieval.recall_of_class(q, members, pool)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_numbers_are_given_by_many_tasks(spark):
    rows = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"), F.lit("t").alias("t"))
    found = sinks.numbered(rows, "seq", "x")
    assert found.columns == ["x", "t", "seq"] and all(r.x == r.seq for r in found.collect())
    assert sinks.numbered(rows.where("false"), "seq", "x").isEmpty()


def test_a_batch_is_split_a_few_rows_at_a_time(monkeypatch):
    sizes, split = [], chunking._split
    monkeypatch.setattr(chunking, "_split", lambda texts: sizes.append(len(texts)) or split(texts))
    texts = [f" One {i}. Two é? " * (i % 4) or None for i in range(1000)]
    found = chunking._sliced(chunking._split, pa.array(texts)).to_pylist()
    assert max(sizes) <= chunking._ROWS and found == [chunking.sentence_spans(t) for t in texts]
    assert chunking._sliced(split, pa.array([], pa.string())).to_pylist() == []


def test_replies_are_handed_on_a_few_rows_at_a_time(spark):
    rows = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))

    class Echo:
        def complete(self, prompt):
            return prompt

    found = providers.complete_column(rows, Echo)
    assert found.where("reply = prompt").count() == 1000


def test_index_counts_within_rows_and_merges_repeated_ids(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("a", "x z z"), ("b", "y"), ("c", None), (None, "x x")], "doc_id string, text string")
    index = keywords.build_index(docs, docs_per_shard=2)
    assert tuple(index.totals.select("n_docs", "mean_size").first()) == (5, 9 / 5)
    parts = {(r.term, p.doc_id): p.part for r in index.lists.collect() for p in r.postings}
    part = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 1.8))
    assert parts.keys() == {("x", "a"), ("y", "a"), ("z", "a"), ("y", "b")}
    assert np.isclose(parts["x", "a"], part(3, 3)) and np.isclose(parts["z", "a"], part(2, 3)) and np.isclose(parts["y", "b"], part(1, 1))
    assert {r.term: r.df for r in index.terms.collect()} == {"x": 1, "y": 2, "z": 1}
    plan = index.lists._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_index_keeps_to_the_asked_terms_however_many(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} common w{i % 3}") for i in range(40)], "doc_id int, text string")
    only = spark.createDataFrame([("common",), ("w1",), ("w4",), ("none",)], "term string")
    lists = lambda: sorted((r.shard, r.term, r.n, r.most, sorted(map(tuple, r.postings))) for r in keywords.build_index(docs, only, docs_per_shard=16).lists.collect())
    few = lists()
    monkeypatch.setattr(keywords, "_SENT_TERMS", 2)
    assert lists() == few and {row[1] for row in few} == {"common", "w1", "w4"}


def test_only_the_vector_search_embeds(spark):
    class Never(providers.HashingEmbedder):
        def embed(self, texts):
            assert not any("asked" in t for t in texts)
            return super().embed(texts)

    docs = spark.createDataFrame([(1, "red sea"), (2, "blue sky")], "doc_id long, text string")
    q = providers.embed_column(spark.createDataFrame([(7, "blue")], "query_id long, text string"), providers.HashingEmbedder)
    found = retrieval.hybrid_search(q, docs, 2, make=Never)
    want = retrieval.hybrid_search(q, providers.embed_column(docs, providers.HashingEmbedder), 2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("embedded(") <= 1


def test_sentences_of_chunks_that_do_not_overlap_are_not_shuffled(spark):
    s = "struct<sentence_id: string, document_id: string, text: string, page: int, section_path: array<string>>"
    chunks = spark.createDataFrame([("c1", 1, ["p"], [("s1", "d", "a", None, None), ("s2", "d", "b", 2, ["q"])]), ("c2", 3, ["r"], [("s3", "d", "c", 0, [])])], f"chunk_id string, page int, section_path array<string>, sentences array<{s}>")
    once = indexing.sentence_rows(chunks, overlap=False)
    assert sorted(map(str, once.collect())) == sorted(map(str, indexing.sentence_rows(chunks).collect()))
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()


def _splits(found):
    return found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "Aa bb. Cc dd."), (2, None), (3, " ")], "doc_id long, text string")
    found = chunking.split_sentences(docs)
    assert _splits(found) == 1 and [tuple(r)[:3] for r in found.orderBy("sentence_no").collect()] == [(1, 0, "Aa bb."), (1, 1, "Cc dd.")]
    layout = spark.createDataFrame([(1, 0, None, "Aa bb. Cc.", 1), (1, 1, None, None, 1)], "doc_id long, para_no int, role string, content string, page int")
    assert _splits(chunking.chunk_layout(layout)) == 2  # the texts, and what of them each chunk has


def test_neighbours_numbers_are_those_of_built_chunks_without_their_texts(spark):
    at = random.Random(5)
    rows = [(i, " ".join("W" + "x" * at.randrange(9) + " ab" * at.randrange(9) + "." for _ in range(at.randrange(90)))) for i in range(30)]
    docs = spark.createDataFrame([*rows, (98, None), (99, " ")], "doc_id long, text string")
    section = lambda k: F.floor(k / 40).cast("string")
    members = chunking.chunk_sentences(chunking.pack_chunks(chunking.split_sentences(docs).withColumn("section", section(F.col("sentence_no"))), 20, 5))
    found = chunking.lists_overlap(chunking.chunk_numbers(chunking.with_sentences(docs), section, 20, 5))
    want = sorted(map(tuple, chunking.adjacent_overlap(members).collect()))
    assert len(want) > 100 and {True, False} == {r[2] for r in want} and sorted(map(tuple, found.collect())) == want
    shuffled = [row for row in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in row]
    assert shuffled and not any("text" in row or "format_string" in row for row in shuffled)


def test_packing_reads_lists_as_they_are():
    tokens, sections = [[4, 4, 4, 4], [], [4, 4, 4], [50], None, [3, 2, 2, 5]], [["a"] * 4, [], ["a", None, "b"], ["a"], None, ["a"] * 4]
    for part in (slice(0, 6), slice(2, 4)):
        t, s = (pa.array(x, pa.list_(kind))[part] for x, kind in ((tokens, pa.int32()), (sections, pa.string())))
        want = [[{"first": a, "last": b} for a, b in chunking.pack(x or [], y or [], 8, 4)] for x, y in zip(tokens[part], sections[part], strict=True)]
        assert chunking._packed(8, 4)(t, s).to_pylist() == want
