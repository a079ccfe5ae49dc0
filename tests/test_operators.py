import json

from pyspark.sql import functions as F

from proofline.operators import chunking, citation, gates, metrics, retrieval
from proofline.sources import providers, readers, sinks


def test_sentences_cut_exactly(spark):
    docs = spark.createDataFrame([(1, "One two.  Three!\nfour"), (2, None), (3, "   "), (4, "")], "doc_id long, text string")
    rows = chunking.split_sentences(docs).orderBy("doc_id", "sentence_no").collect()
    assert [(r.doc_id, r.sentence_no, r.text) for r in rows] == [(1, 0, "One two."), (1, 1, "Three!"), (1, 2, "four")]
    assert all("One two.  Three!\nfour"[r.char_start : r.char_end] == r.text for r in rows)


def test_marks_within_numbers_and_acronyms_close_no_sentence():
    split = lambda text: [s["text"] for s in chunking.sentence_spans(text)]
    assert split("It grew 3.5 percent in the U.S. economy. See v1.2! Why?? A. B") == ["It grew 3.5 percent in the U.S. economy.", "See v1.2!", "Why??", "A.", "B"]
    assert split("... wait... so.\n!") == ["...", "wait...", "so.", "!"] and split(None) == split(" \n") == []
    text = "A b. " * 50_000
    assert len(split(text)) == 50_000 and len(split("x" * 2_000_000)) == 1


def test_titles_add_up_and_end_headings(spark):
    rows = [(1, k, role, text) for k, (role, text) in enumerate([("sectionHeading", "H0"), (None, "a"), ("title", "T1"), ("pageHeader", "x"), (None, "b"), ("sectionHeading", "H1"), (None, "c"), ("title", "T2"), (None, "d"), (None, " ")])]
    found = chunking.breadcrumbs(spark.createDataFrame(rows, "doc_id long, para_no int, role string, content string"))
    paths = {r.content: r.section_path for r in found.collect()}
    assert paths["a"] == ["H0"] and paths["b"] == ["T1"] and paths["c"] == ["T1", "H1"] and paths["d"] == ["T1 — T2"] and "x" not in paths


def test_packing_overlaps_after_overflow_only():
    assert chunking.pack([4, 4, 4, 4], ["a"] * 4, 8, 4) == [(0, 1), (1, 2), (2, 3)]
    assert chunking.pack([4, 4, 4], ["a", "a", "b"], 100, 4) == [(0, 1), (2, 2)]
    assert chunking.pack([50], ["a"], 10, 2) == [(0, 0)]
    assert chunking.pack([], [], 10, 2) == []
    assert chunking.pack([3, 2, 2, 5], ["a"] * 4, 7, 4) == [(0, 2), (1, 3)]
    assert chunking.pack([3, 2, 2, 5], ["a"] * 4, 7, 1) == [(0, 2), (2, 3)]


def test_chunk_offsets_cut_sentences_out_of_the_chunk(spark):
    docs = spark.createDataFrame([(1, "Aa bb. Cc dd. Ee ff. Gg hh.")], "doc_id long, text string")
    s = chunking.split_sentences(docs).withColumn("section", F.lit("x"))
    packed = chunking.pack_chunks(s, 4, 2)
    members = chunking.chunk_sentences(packed)
    chunks = {r.chunk_id: r.text for r in packed.collect()}
    assert chunks["1-c0000"] == "Aa bb. Cc dd."
    assert all(chunks[r.chunk_id][r.char_start : r.char_end] == r.text for r in members.collect())
    assert chunking.unique_sentences(members).count() == 4
    assert all(r.overlaps for r in chunking.adjacent_overlap(members).collect())


def test_chunks_lists_are_built_once_when_they_are_taken_apart(spark):
    docs = spark.createDataFrame([(1, "Aa bb. Cc dd.")], "doc_id long, text string")
    members = chunking.chunk_sentences(chunking.pack_chunks(chunking.split_sentences(docs).withColumn("section", F.lit("x"))))
    for rows in (members, chunking.unique_sentences(members), chunking.adjacent_overlap(members)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not any("transform(" in row for row in plan.splitlines() if "Filter" in row)
    lists = spark.createDataFrame([("a", 1, 0, []), ("b", 1, 1, None), ("c", 1, 2, [("x",), None])], "chunk_id string, doc_id long, chunk_no int, sentences array<struct<sentence_id: string>>")
    assert [(r.chunk_id, r.sentence_id) for r in chunking.chunk_sentences(lists).collect()] == [("c", "x"), ("c", None)]


def test_spans_and_their_sample(spark):
    s = spark.createDataFrame([(1, 0, k, f"s{k}.") for k in range(5)], "doc_id long, chunk_no int, sentence_no int, text string")
    found = chunking.spans(s)
    assert found.count() == 5 + 4 + 3
    sample = chunking.sample_spans(found.withColumn("difficulty", F.lit("easy")), {"easy": 3})
    assert sample.count() == 1  # one of each chunk


def test_inline_tags(spark):
    answers = spark.createDataFrame([("q", "One.[s:a][s:z] Two.[s:a][s:a]")], "answer_id string, text string")
    tags = citation.inline_citations(answers, spark.createDataFrame([("q", "a")], "answer_id string, sid string"))
    report = citation.inline_report(tags).first()
    assert (report.n_tags, report.n_valid, report.hallucinated) == (4, 3, ["z"])
    spans = spark.createDataFrame([("q", [(0, 4), (5, 9)])], "answer_id string, spans array<struct<start: int, end: int>>")
    assert sorted((r.sentence_no, r.sid) for r in citation.attributed(tags, spans).collect()) == [(0, "a"), (1, "a")]


def test_alignment_has_a_threshold_a_cap_and_an_order(spark):
    a = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query_id int, sentence_no int, embedding array<float>")
    b = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (0, 3, [0.0, 1.0]), (0, 4, [0.0, 0.0])], "query_id int, sid int, embedding array<float>")
    assert [(r.sid, r["rank"]) for r in citation.align(a, b, 0.75, 1).collect()] == [(1, 1)]
    assert citation.align(a, b, 0.75, 3).count() == 2


def test_dual_context(spark):
    hits = spark.createDataFrame([(0, "c1", 1)], "query_id int, chunk_id string, rank int")
    parents = spark.createDataFrame([(0, "c1"), (0, "c0")], "query_id int, chunk_id string")
    context = retrieval.dual_context(hits, parents)
    assert [(r.chunk_id, r.source) for r in context.orderBy("place").collect()] == [("c1", "both"), ("c0", "sentence_parent")]


def test_recall_without_gold_is_one(spark):
    queries = spark.createDataFrame([(0,), (1,)], "query_id int")
    gold = spark.createDataFrame([(0, "a"), (0, "b")], "query_id int, sid string")
    pool = spark.createDataFrame([(0, "a")], "query_id int, sid string")
    assert {r.query_id: r.recall for r in retrieval.recall_at_k(gold, pool, queries).collect()} == {0: 0.5, 1: 1.0}


def test_runs_that_cite_nothing_count(spark):
    runs = spark.createDataFrame([("q", 0), ("q", 1), ("e", 0)], "question string, run int")
    cites = spark.createDataFrame([("q", 0, "a"), ("q", 0, "b")], "question string, run int, sid string")
    found = {r.question: r for r in metrics.stability(runs, cites).collect()}
    assert found["q"].stability == 0.0 and found["e"].stability == 1.0
    pairs = {r.question: r for r in metrics.pairwise_jaccard(metrics.run_sets(runs, cites)).collect()}
    assert pairs["q"].mean_jaccard == 0.0 and pairs["q"].coverage_rate == 0.5 and pairs["e"].mean_jaccard == 1.0


def test_optional_means_leave_nulls_out(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 0.0, 0.5), ("b", 1.0, None)], "strategy string, f1 double, stability double")
    found = {r.strategy: r for r in metrics.summarize(rows, ["strategy"], ("f1",), ("stability",)).collect()}
    assert (found["a"].f1, found["a"].stability, found["b"].stability) == (0.5, 0.5, None)
    table = {r.metric: r for r in metrics.markdown_table(rows, ["a", "c"], ("f1",)).collect()}
    assert table["f1"].a == "0.500" and table["f1"].c == "n/a"


def test_all_faithful_is_false_without_citations(spark):
    spine = spark.createDataFrame([(0,), (1,)], "s int")
    judged = spark.createDataFrame([(0, True), (0, False)], "s int, entails boolean")
    by = metrics.faithfulness_by_sentence(spine, judged, ["s"])
    assert {r.s: (r.any_faithful, r.all_faithful) for r in by.collect()} == {0: (True, False), 1: (False, False)}
    report = metrics.faithfulness_report(by, []).first()
    assert (report.percent_faithful, report.percent_sentences_any_faithful, report.coverage) == (50.0, 100.0, 50.0)


def test_span_text_keeps_order_and_drops_unknown_ids(spark):
    items = spark.createDataFrame([("q", ["b", "x", "a"]), ("e", [])], "question_id string, span_ids array<string>")
    s = spark.createDataFrame([("a", "A."), ("b", "B."), ("c", " ")], "sid string, text string")
    assert {r.question_id: r.span for r in gates.span_text(items, s).collect()} == {"q": "B. A.", "e": ""}


def test_benchmark_lines(spark):
    lines = [
        {"query_id": "q1", "query": "?", "quotes": [{"idx": 1, "text": "a"}, {"idx": 2, "text": "b"}], "answers": [{"answer": " "}, {"answer": "yes", "attributable": ["1", {"idx": 2}, "9"]}]},
        {"query_id": "q2", "query": "?", "quotes": [{"text": "a"}], "answers": [{"answer": "x"}]},
    ]
    rows = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    found = readers.hagrid_items(rows).collect()
    assert [(r.item_id, r.answer, sorted(r.gold)) for r in found] == [("q1", "yes", ["1", "2"])]
    alce = spark.createDataFrame([(json.dumps({"id": "a", "question": "?", "answer": "y", "docs": [{"text": ""}, {"id": "d1", "text": "t"}, {"text": "u"}], "citations": [0, 1, 5]}),)], "value string")
    assert readers.alce_items(alce).first().gold == ["d1", "1"]


def test_conditions_on_benchmark_items_do_not_read_their_lines_again(spark):
    lines = spark.range(3).select(F.format_string('{"id": "%d", "question": "?", "quotes": [], "docs": []}', "id").alias("value"))
    for items in (readers.hagrid_items(lines), readers.alce_items(lines)):
        plan = items.select("item_id")._jdf.queryExecution().optimizedPlan().toString()
        assert not any("get_json_object" in row for row in plan.splitlines() if "Filter" in row)


def test_runs_and_reviews_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("q", "r", "other", "low", ["x"], "n1", "2024-01-01"), ("q", "r", "other", "high", ["x"], "n2", "2024-01-02")], readers.REVIEW)
    sinks.write_reviews(rows, str(tmp_path / "reviews"))
    assert [r.confidence for r in readers.read_reviews(spark, str(tmp_path / "reviews")).collect()] == ["high"]
    folder = sinks.write_run(str(tmp_path), spark.createDataFrame([(2,)], "n int"), "run1", items=rows)
    assert sinks.write_run(str(tmp_path), spark.createDataFrame([(2,)], "n int")).endswith("Z")
    assert spark.read.json(f"{folder}/items").count() == 2 and spark.read.json(f"{folder}/manifest").first().n == 2


def test_models_fail_row_by_row(spark):
    class Model:
        def complete(self, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

    rows = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    found = {r.prompt: (r.reply, r.error) for r in providers.complete_column(rows, Model).collect()}
    assert found == {"ok": ("OK", None), "bad": (None, "ValueError: no")}
    vectors = providers.embed_column(rows, providers.HashingEmbedder, "prompt").collect()
    assert all(abs(sum(x * x for x in v.embedding) - 1) < 1e-5 for v in vectors)


def test_vector_search_asks_with_any_number_of_queries_in_blocks(spark):
    vectors = spark.range(60).select(F.col("id").alias("doc_id"), F.transform(F.array(*map(F.lit, range(8))), lambda k: F.sin(F.col("id") * (k + 1.5)) + 0.1).alias("embedding"))
    rows = {r.doc_id: r.embedding for r in vectors.collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    queries = vectors.select(F.col("doc_id").alias("query_id"), "embedding")
    found = retrieval.vector_search(queries, vectors, 3, apart=True, size=7)
    expected = {(q, d, r + 1) for q in rows for r, d in enumerate(sorted((d for d in rows if d != q), key=lambda d: (-round(cosine(rows[q], rows[d]), 6), d))[:3])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == expected
    assert {r["rank"] for r in retrieval.vector_search(queries, vectors, 1).where("query_id = doc_id").collect()} == {1}


def test_items_without_a_review_stay_with_a_null_confidence(spark):
    items = spark.createDataFrame([(1,), (2,)], "question_id long")
    reviews = spark.createDataFrame([(1, "high", ["seen"])], "question_id long, confidence string, flags array<string>")
    assert {r.question_id: r.confidence for r in metrics.with_reviews(items, reviews).collect()} == {1: "high", 2: None}
