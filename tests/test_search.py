"""Keyword and vector indexes, second looks and failing models."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline import queries as Q
from proofline.functions import replies
from proofline.operators import cells, keywords, retrieval
from proofline.sources import providers, readers

SF = "/root/testdata/sf0.01"


def bm25_by_hand(questions, docs, k):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    found = []
    for q, text in questions:
        scores = {}
        for i, x in words.items():
            tf = Counter(x)
            own = [w for w in set(re.findall(r"\w+", (text or "").lower())) if tf[w]]
            if own:
                scores[i] = round(sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in own), 6)
        found += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(found)


@pytest.mark.parametrize("docs_per_shard", [4, 9, 10_000])
def test_keyword_search_is_that_of_a_full_reading(spark, tmp_path, docs_per_shard):
    rng = random.Random(docs_per_shard)
    vocabulary = [f"w{int(1.35**k)}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(300)] + [(300 + k, "same words here W1") for k in range(40)] + [(400, None), (401, "")]
    questions = [(k, text(rng.randrange(1, 12))) for k in range(30)] + [(90, "same here"), (91, "unknown"), (92, None), (93, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(questions, "query_id long, text string")
    want = bm25_by_hand(questions, docs, 5)
    index = keywords.build_index(d, docs_per_shard=docs_per_shard)
    assert sorted(map(tuple, keywords.search_index(q, index, 5).collect())) == want
    index.save(str(tmp_path / "index"))
    assert sorted(map(tuple, keywords.search_index(q, keywords.KeywordIndex.load(spark, str(tmp_path / "index")), 5).collect())) == want
    assert sorted(map(tuple, retrieval.bm25(q, d, 5).collect())) == want
    assert index.lists.agg(F.max("n")).first()[0] <= 342 and index.totals.first()["n_docs"] == 342


def test_keyword_search_of_nothing(spark):
    d, q = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert retrieval.bm25(q, d, 5).collect() == [] == retrieval.bm25(q.where("false"), d, 5).collect()
    named = spark.createDataFrame([("x", "a"), ("y", "a"), (None, "a")], "doc_id string, text string")
    assert [(r.doc_id, r.rank) for r in retrieval.bm25(q, named, 5).orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def test_shards_that_cannot_reach_the_bound_are_not_scored():
    ids = np.arange(4)
    lists = {"rare": (np.array([0]), np.array([2.0]), 2.0), "common": (ids, np.array([1.0, 0.9, 0.5, 0.4]), 1.0)}
    ask = lambda least: list(keywords._best_of_shard([keywords._Question("q", ["rare", "common"], [3.0, 0.5], least)], lists, ids, 2))
    assert [row[1] for row in ask(0.0)] == [0, 1] and ask(6.6) == []
    assert [row[1] for row in ask(1.0)] == [0] and ask(1.0)[0][2] == ask(0.0)[0][2] == 6.5


def test_cells_find_what_the_exact_search_finds(spark):
    found, exact = Q.vector_topk_cells(spark, SF), Q.vector_topk(spark, SF)
    recall = cells.recall_of(found, exact).agg(F.avg("recall").alias("mean"), F.count("*").alias("n")).first()
    assert recall["n"] == exact.select("query_id").distinct().count() and recall["mean"] >= 0.9
    assert found.join(exact, ["query_id", "doc_id"]).where(F.abs(found.score - exact.score) > 1e-6).count() == 0


def test_cells_read_only_a_part_and_hold_every_vector(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16))
    rows = [(k, (middles[k % 40] + 0.1 * rng.normal(size=16)).tolist()) for k in range(2000)] + [(5000 + k, middles[0].tolist()) for k in range(700)]
    odd = [(9000, None), (9001, [1.0, 2.0]), (9002, [0.0] * 16)]
    vectors = spark.createDataFrame(rows + odd, "doc_id long, embedding array<double>")
    index = cells.build_cells(vectors)
    assert index.vectors.count() == len(rows) + 1 and index.probes < len(index.centres) / 3
    asked = vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    recall = cells.recall_of(cells.cell_search(asked, index, 20, apart=True), retrieval.vector_search(asked, vectors, 20, apart=True))
    # Copies are equally near: what counts is how near hits are.
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9
    empty = cells.build_cells(vectors.where("false"))
    assert cells.cell_search(asked, empty, 3).count() == 0
    assert cells.cell_search(asked.where("false"), index, 3).count() == 0


def test_hits_are_looked_at_again(spark):
    hits = spark.createDataFrame([(1, k, 1.0 - k / 10, k) for k in range(1, 5)], "query_id long, doc_id long, score double, rank int")
    questions = spark.createDataFrame([(1, "red fox den")], "query_id long, text string")
    rows = spark.createDataFrame([(1, "a dog", None), (2, "the RED fox", ["Den"]), (3, "fox", []), (4, None, None)], "doc_id long, text string, section_path array<string>")
    again = retrieval.rescored(hits, questions, rows, 3, providers.OverlapScorer)
    assert [(r.doc_id, r.rescore, r.rank) for r in again.orderBy("rank").collect()] == [(2, 1.0, 1), (3, 1 / 3, 2), (1, 0.0, 3)]
    plain = retrieval.rescored(hits, questions, rows, 2)
    assert [(r.doc_id, r.rescore, r.rank) for r in plain.orderBy("rank").collect()] == [(1, None, 1), (2, None, 2)]

    class Broken:
        def score(self, pairs):
            if any("dog" in text for _, text, _ in pairs if text):
                raise TimeoutError("busy")
            return [1.0 if text is None else 0.5 for _, text, _ in pairs]

    left = retrieval.rescored(hits, questions, rows, 4, Broken)
    assert [(r.doc_id, r.rescore) for r in left.orderBy("rank").collect()] == [(4, 1.0), (2, 0.5), (3, 0.5), (1, None)]


def test_texts_fail_one_by_one(spark):
    class Model:
        def embed(self, texts):
            if any("bad" in x for x in texts):
                raise ValueError("refused")
            return [[float(len(x))] for x in texts]

    rows = spark.createDataFrame([(k, "bad" if k in (3, 17) else "x" * k) for k in range(30)], "id long, text string").coalesce(1)
    found = {r.id: (r.embedding, r.embed_error) for r in providers.embed_column(rows, Model, errors=True).collect()}
    assert {k for k, (_, error) in found.items() if error} == {3, 17} and found[3] == (None, "ValueError: refused") and found[9] == ([9.0], None)
    with pytest.raises(Exception, match="refused"):
        providers.embed_column(rows, Model).collect()
    calls = []

    def flaky(items):
        calls.append(len(items))
        if len(calls) == 1:
            raise ConnectionError("once")
        return items

    assert providers._halved(["a"], flaky) == [("a", None)] and calls == [1, 1]
    assert providers._halved(["a", "b"], lambda items: items[:1]) == [("a", None), ("b", None)]


def test_whole_numbers_in_any_form(spark):
    given = '{"supporting_indices": [0, 2.0, true, "1", 3.7, "x", null, -1, 99, 1e0, 12345678901]}'
    assert spark.range(1).select(replies.support_reply(F.lit(given), F.lit(5)).alias("r")).first()["r"]["indices"] == [0, 2, 1, 3]


def test_malformed_layouts_raise(spark, tmp_path):
    for name, text in (("good", json.dumps({"paragraphs": [{"content": "x"}]})), ("broken", "{nothing")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "layout.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ_FILE"):
        readers.read_layout(spark, str(tmp_path)).collect()
