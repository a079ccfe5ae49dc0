"""The flows on small rows with stand-in models: modes, failures, order of precedence and empty cases."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from proofline.functions import replies
from proofline.operators import chunking, citation, metrics, retrieval
from proofline.plans import answering, authoring, evaluation, gating, indexing, judging, replicas, retrieving
from proofline.sources import providers, readers, sinks, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module

NESTED = "sentence_id string, document_id string, text string, page int, section_path array<string>"
CHUNKS = f"chunk_id string, document_id string, page int, section_path array<string>, text string, token_count int, sentences array<struct<{NESTED.replace(' string', ': string').replace(' int', ': int').replace(' array', ': array')}>>"
SENTENCES = "sentence_id string, chunk_id string, document_id string, page int, section_path array<string>, text string"


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Plans of few rows run faster than they compile."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def nested(sid, text, page=None, path=None):
    return (sid, "d", text, page, path)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("c1", "d", 3, ["A"], "apples are red. apples grow on trees.", 7, [nested("s1", "apples are red."), nested("s2", "apples grow on trees.", 4, ["B"])]),
        ("c2", "d", 5, ["B"], "pears are green. apples grow on trees.", 7, [nested("s2", "apples grow on trees."), nested("s3", "pears are green.")]),
        ("c3", "d", None, None, "nothing of this kind stands here", 6, []),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    flat = [("s1", "c1", "d", 3, ["A"], "apples are red."), ("s2", "c1", "d", 4, ["B"], "apples grow on trees."), ("s3", "c2", "d", 5, ["B"], "pears are green."), ("s9", "gone", "d", None, None, "green pears are apples")]
    return chunks, spark.createDataFrame(flat, SENTENCES)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("q1", "are apples red"), ("q2", "green pears")], "query_id string, text string")


@pytest.mark.parametrize("mode", ["dual", "chunks", "sentences"])
def test_three_modes(questions, corpus, mode):
    found = retrieving.retrieve(questions, *corpus, mode, k_sentences=2, k_chunks=1)
    context = {(r.query_id, r.place): (r.chunk_id, r.source, r.page) for r in found.context.collect()}
    candidates = [(r.query_id, r["rank"], r.sentence_id, r.page, r.section_path) for r in found.candidates.orderBy("query_id", "rank").collect()]
    stats = {r.query_id: (r.chunk_search_hits, r.sentence_search_hits, r.parent_chunks_added) for r in found.stats.collect()}
    if mode == "sentences":
        assert not context and stats["q1"] == (0, 2, 0) and {c[2] for c in candidates if c[0] == "q2"} == {"s3", "s9"}
        assert next(c for c in candidates if c[2] == "s9")[3:] == (0, [])
    elif mode == "chunks":
        assert context["q1", 1] == ("c1", "chunk_search", 3) and stats["q1"] == (1, 0, 0)
        assert candidates[:2] == [("q1", 1, "s1", 3, ["A"]), ("q1", 2, "s2", 4, ["B"])]  # the chunk's page where a sentence has none
    else:
        # q2's hit s9 has a parent that is not in the index: it adds nothing and leaves no gap.
        assert context["q2", 1] == ("c2", "both", 5) and stats["q2"] == (1, 2, 0) and ("q2", 2) not in context
        assert context["q1", 1][:2] == ("c1", "both")
    with pytest.raises(ValueError, match="mode"):
        retrieving.retrieve(questions, *corpus, "other")


def test_searches_without_rows(spark, questions, corpus):
    chunks, sentences = corpus
    found = retrieving.retrieve(questions, chunks.limit(0), sentences.limit(0))
    assert found.context.count() == 0 and found.candidates.count() == 0 and found.stats.count() == 2
    assert retrieving.retrieve(questions.limit(0), chunks, sentences).stats.count() == 0


def test_vectors_of_other_lengths_and_nulls_are_not_found(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [2.0, 0.0])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [3.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r.doc_id, r.score) for r in retrieval.vector_search(queries, vectors, 5).orderBy("rank").collect()] == [(1, 1.0), (5, 1.0), (2, 0.0)]


def test_stored_retrievals_are_read_again(tmp_path, questions, corpus):
    folder = str(tmp_path / "r")
    first = retrieving.stored(retrieving.retrieve(questions, *corpus), folder)
    again = retrieving.stored(retrieving.retrieve(questions, *(rows.limit(0) for rows in corpus)), folder)
    assert first.context.count() == again.context.count() > 0
    assert retrieving.stored(retrieving.retrieve(questions.limit(1), *corpus), folder).queries.count() == 1
    assert retrieving.stored(retrieving.retrieve(questions, *(rows.limit(0) for rows in corpus)), folder, live=True).context.count() == 0


def test_context_has_sections_pages_and_cut_bodies(spark, corpus):
    context = corpus[0].select(F.lit("q").alias("query_id"), F.when(F.col("chunk_id") == "c1", 1).when(F.col("chunk_id") == "c3", 2).otherwise(3).alias("place"), "*")
    row = citation.context_blocks(context.where("place < 3")).first()
    assert row.block == "[Chunk 1: c1 | doc=d | A | p.3]\n[s:s1] apples are red.\n[s:s2] apples grow on trees.\n\n[Chunk 2: c3 | doc=d | p.0]\nnothing of this kind stands here"
    assert row.sentence_ids == ["s1", "s2"]
    bare = citation.context_blocks(context.where("place = 1"), tagged=False, most_chars=10).first()
    assert bare.block == "[Chunk 1: c1 | doc=d | A | p.3]\napples are …" and bare.sentence_ids == []


class Says:
    """Replies by a table of what the prompt has in it."""

    def __init__(self, **table):
        self.table = table

    def complete(self, prompt, **options):
        for key, reply in self.table.items():
            if key.replace("_", " ") in prompt:
                if reply is None:
                    raise ConnectionError("down")
                return reply(prompt, **options) if callable(reply) else reply
        return ""


def gold(spark):
    return spark.createDataFrame([("q1", "are apples red", "easy", [["s1"], ["s1", "s7"]]), ("q2", "green pears", "hard", [["s3"]])], "question_id string, question string, difficulty string, gold_citations array<array<string>>")


def test_evaluation_keeps_failures_as_rows(spark, corpus):
    items = gold(spark).withColumn("retrieve_error", F.lit(None).cast("string")).unionByName(spark.createDataFrame([("q3", "?", "easy", [["s1"]], "Timeout: 5 s")], "question_id string, question string, difficulty string, gold_citations array<array<string>>, retrieve_error string"))
    model = lambda: Says(are_apples_red=lambda p: "apples are red.[s:s1][s:zz] Other words.[s:s2]" if "[s:" in p else "apples are red. Unrelated noise.", green_pears=None)
    found = evaluation.evaluate_items(items, *corpus, model, "m", k_sentences=2, k_chunks=1, tau=0.9, top_k=1)
    rows = {(r.question_id, r.strategy): r for r in found.items.collect()}
    assert len(rows) == 6
    inline, aligned = rows["q1", answering.INLINE], rows["q1", answering.ALIGNED]
    assert (inline.precision, inline.recall, inline.coverage, inline.n_answer_sentences, inline.n_gold_ids, inline.n_pred_ids) == (0.5, 0.5, 1.0, 2, 2, 2)
    assert (aligned.pred_citation_ids, aligned.coverage, aligned.retrieval_recall_at_k, aligned.error) == (["s1"], 0.5, 0.5, None)
    failed = rows["q2", answering.INLINE]
    assert failed.error == "generate_or_cite_failed: ConnectionError: down" and failed.retrieval_recall_at_k == 1.0 and failed.f1 == 0.0 and failed.answer_text is None
    lost = rows["q3", answering.ALIGNED]
    assert lost.error == "retrieve_failed: Timeout: 5 s" and lost.retrieval_recall_at_k == 0.0 and lost.n_gold_ids == 1
    report = found.cited.report.where("query_id = 'q1'").first()
    assert (report.n_tags, report.n_valid, report.hallucinated) == (3, 2, ["zz"])
    reviews = spark.createDataFrame([("q1", "low", "pm", ["other"], "n")], "question_id string, confidence string, reviewer_role string, flags array<string>, notes string")
    judged = judging.judge(found.cited, found.retrieval, lambda: Says(Statement=None), "j")
    extra = evaluation.enriched(found.items, judged, reviews=reviews)
    assert {(r.question_id, r.reviewer_confidence) for r in extra.collect()} == {("q1", "low"), ("q2", None), ("q3", None)}
    assert extra.where("question_id = 'q1' and strategy = 'inline_prompted'").first().error.startswith("judge_failed: sentence 0: judge call failed: ConnectionError")
    sums = evaluation.summaries(extra)
    assert {(r.strategy, r.n, r.percent_faithful) for r in sums["by_strategy"].collect()} == {(answering.INLINE, 3, 0.0), (answering.ALIGNED, 3, 0.0)}
    assert sums["by_confidence"].count() == 2 and sums["by_difficulty"].count() == 4
    record = answering.cited_answers(found.cited).where("query_id = 'q1' and strategy = 'inline_prompted'").first()
    assert [[c.sentence_id for c in s.citations] for s in record.sentences] == [["s1"], ["s2"]] and record.sentences[0].citations[0].source == "llm"
    assert answering.auditor_view(found.cited, found.retrieval).where("sentence_id = 's1'").first().text == "apples are red."


def test_strategies_are_known_ones(spark, corpus, questions):
    found = retrieving.retrieve(questions, *corpus)
    with pytest.raises(ValueError, match="strategy"):
        answering.prompts(found, ("other",))
    with pytest.raises(Exception, match="unknown strategy"):
        answers = answering.generate(found, lambda: Says(), "m").withColumn("strategy", F.lit("other"))
        answering.cite(answers, found).citations.collect()
    with pytest.raises(ValueError, match="one run"):
        answering.generate(found, lambda: Says(), "m", runs=0)


def test_metadata_and_source_texts_prefer_other_sides(spark, corpus, questions):
    found = retrieving.retrieve(questions, *corpus, k_sentences=2, k_chunks=1)
    other = found.candidates.where("sentence_id = 's1'").withColumns({"chunk_id": F.lit("cX"), "text": F.lit("other text")})
    changed = retrieving.Retrieval(found.queries, found.mode, found.context, other, found.stats)
    key = lambda rows, c: {(r.query_id, r.sentence_id): r[c] for r in rows.collect()}
    assert key(answering.sentence_meta(changed), "chunk_id")["q1", "s1"] == "cX" and key(answering.sentence_meta(changed), "chunk_id")["q1", "s2"] == "c1"
    assert key(answering.source_texts(changed), "text")["q1", "s1"] == "apples are red."
    # q2 has no candidates left: its pool is what its context holds.
    assert {r.sentence_id for r in answering.candidate_pool(changed).where("query_id = 'q2'").collect()} == {"s2", "s3"}


def test_benchmark_passages(spark):
    items = spark.createDataFrame([("i", "?", [("7", "One two. Three."), ("8", "...")], ["7"]), ("e", "??", [("0", "zero words")], ["0"])], "item_id string, question string, passages array<struct<passage_id: string, text: string>>, gold array<string>")
    found = retrieving.packaged(items)
    assert [(r.chunk_id, r.token_count, len(r.sentences)) for r in found.context.where("query_id = 'i'").orderBy("place").collect()] == [("bench::i::p0000", 3, 2), ("bench::i::p0001", 1, 1)]
    model = lambda: Says(**{"Question:_??": None, "Question:_?": "A.[s:bench::i::p0000::s0001] B.[s:bench::i::p0001::s0000][s:no]"})
    rows = {r.question_id: r for r in evaluation.evaluate_benchmark(items, model, "m", (answering.INLINE,)).items.collect()}
    assert (rows["i"].precision, rows["i"].recall, rows["i"].pred_citation_ids, rows["i"].retrieval_recall_at_k) == (0.5, 1.0, ["7", "8"], 1.0)
    assert rows["e"].error.startswith("generate_or_cite_failed") and rows["e"].retrieval_recall_at_k == 1.0


def cited_answer(spark, corpus, questions, text="A.[s:s1][s:s2] B."):
    found = retrieving.retrieve(questions.where("query_id = 'q1'"), *corpus, k_sentences=2, k_chunks=1)
    return answering.cite(answering.generate(found, lambda: Says(Question=text), "m", (answering.INLINE,)), found), found


@pytest.mark.parametrize(
    ("reply", "entails", "error"),
    [
        ('[{"entails": true, "reason": "r"}, {"entails": false}]', [True, False], None),
        ('{"judgments": [{"entails": true}]}', [True, False], None),
        ('[{"entails": "false"}, {"entails": 0}]', [True, False], None),
        ('```json\n[{"entails": 1}, {"entails": null}, {"x": 1}]\n```', [True, False], None),
        ('[{"entails": true}, {"x": 1}]', [False, False], "parse failed"),
        ("no json", [False, False], "parse failed"),
        (None, [False, False], "judge call failed"),
    ],
)
def test_judging(spark, corpus, questions, reply, entails, error):
    judged = judging.judge(*cited_answer(spark, corpus, questions), lambda: Says(Statement=reply), "j")
    assert [r.entails for r in judged.judgments.orderBy("sentence_no", "place").collect()] == entails
    errors = [r.error for r in judged.errors.collect()]
    assert (not errors) if error is None else errors[0].startswith(error)
    assert {(r.sentence_no, r.n_citations) for r in judged.by_sentence.collect()} == {(0, 2), (1, 0)}
    batch = judged.batch.first()
    assert (batch["items"], batch.total_citations, batch.percent_faithful) == (1, 2, 50.0 * sum(entails))


def test_nobody_judges_himself(spark, corpus, questions):
    with pytest.raises(ValueError, match="must not judge"):
        judging.judge(*cited_answer(spark, corpus, questions), lambda: Says(), " M ")
    with pytest.raises(ValueError, match="three models"):
        providers.Roles("a", "b", "A").checked()


def test_replicas(spark, corpus, questions):
    def say(prompt, run, temperature):
        assert temperature == 0.7
        return ["A.[s:s1] B.[s:s2]", "A.[s:s1] B.", "A.[s:s1] B.[s:s2]", "A.[s:s2]"][run]

    found = retrieving.retrieve(questions.where("query_id = 'q1'"), *corpus, k_sentences=2, k_chunks=1)
    three = replicas.run_replicas(found, lambda: Says(Question=say), "m", n_runs=3).reports.first()
    assert (three.union_ids, three.intersection_ids, three.stable_anchors, three.stability) == (["s1", "s2"], ["s1"], ["s1", "s2"], 0.5)
    assert [(x.sid, x.freq) for x in three.frequency] == [("s1", 3), ("s2", 2)] and three.coverage_rate == 1.0
    assert three.per_position == [1.0, pytest.approx(1 / 3)]
    four = replicas.run_replicas(found, lambda: Says(Question=say), "m", n_runs=4)
    assert four.reports.first().per_position is None and four.batch.first()["items"] == 1
    nothing = replicas.run_replicas(found, lambda: Says(Question=None), "m", n_runs=2).reports.first()
    assert (nothing.stability, nothing.mean_jaccard, nothing.coverage_rate, nothing.union_ids, nothing.per_position) == (1.0, 1.0, 0.0, [], None)
    empty = replicas.stability_batch(four.reports.limit(0)).first()
    assert (empty["items"], empty.mean_stability) == (0, 0.0)


ITEM = "question_id string, question string, gold_answer string, gold_citations array<array<string>>, author_model string, document_id string, page int, source_span_sentence_ids array<string>"


def test_gates_flag_and_never_drop(spark, corpus):
    rows = [
        ("ok", "q one?", "apples are red.", [["s1"], ["s1", "s2"]], "author", "d", 1, ["s1"]),
        ("no", "q two?", "pears are green.", [["s3"]], "author", "d", None, ["s3", "gone"]),
        ("bad", "q three?", "apples", [["s1"]], None, None, None, []),
        ("down", "q four?", "trees", [["s2"]], "author", "d", 1, ["s2"]),
    ]
    hits = spark.createDataFrame([(q, s, k + 1) for q in ("ok", "no", "bad", "down") for k, s in enumerate(["s1", "s2", "s3", "s9"])], "question_id string, sentence_id string, rank int")
    yes, no = json.dumps({"well_formed": True, "supported": "Yes", "reasons": "r"}), json.dumps({"well_formed": "1", "supported": "no"})
    model = lambda: Says(**{"numbered": '{"supporting_indices": [1, "0", 1, 7, "x"]}', "one": yes, "two": no, "three": '{"well_formed": "perhaps"}', "four": None})
    found = gating.run_quality_gates(spark.createDataFrame(rows, ITEM), corpus[1], model, "judge", top_k=3, hits=hits)
    items = {r.question_id: r for r in found.items.collect()}
    assert len(items) == 4 and items["ok"].judge_supported and items["ok"].judge_model == "judge"
    # The span is taken out after the cut of three: s2 and s3 are left, in the order that the judge names them.
    assert items["ok"].union_additions == ["s3", "s2"] and items["ok"].gold_citations == [["s1", "s3", "s2"], ["s1", "s2", "s3"]]
    assert items["no"].gold_citations == [["s3"]] and items["no"].union_additions == [] and not items["no"].judge_supported and items["no"].judge_well_formed
    assert "boolean" in items["bad"].judge_reasons and "ConnectionError" in items["down"].judge_reasons
    counters = found.counters.first()
    assert (counters.n, counters.passed, counters.failed, counters.union_additions_total) == (4, 1, 3, 2)
    assert {(r.question_id, r.stage) for r in found.failures.collect()} == {("no", "agreement"), ("bad", "agreement"), ("down", "agreement")}
    every = gating.run_quality_gates(spark.createDataFrame(rows[:2], ITEM), corpus[1], model, "judge", top_k=3, hits=hits, skip_failed=False)
    assert {r.question_id: r.union_additions for r in every.items.collect()}["no"] == ["s2", "s1"]
    lost = gating.run_quality_gates(spark.createDataFrame(rows[:1], ITEM), corpus[1], lambda: Says(numbered=None, one=yes), "judge", hits=hits)
    assert lost.items.first().gold_citations == [["s1"], ["s1", "s2"]] and lost.failures.first().stage == "union_labeler"
    with pytest.raises(ValueError, match="must not judge"):
        gating.run_quality_gates(spark.createDataFrame(rows, ITEM), corpus[1], model, "Author", hits=hits)


def test_gates_search_by_themselves(spark, corpus):
    rows = [("ok", "q one?", "green pears", [["s1"]], "author", "d", 1, ["s3"])]
    model = lambda: Says(numbered='{"supporting_indices": [0]}', one='{"well_formed": true, "supported": true}')
    found = gating.run_quality_gates(spark.createDataFrame(rows, ITEM), corpus[1], model, "judge", top_k=2)
    assert found.items.first().union_additions == ["s9"]


def test_authoring_keeps_failures(spark, corpus):
    chunks = corpus[0].withColumns({"doc_id": F.lit("d"), "chunk_no": F.substring("chunk_id", 2, 1).cast("int")})
    spans = authoring.chunk_spans(chunks)
    assert {(r.chunk_id, tuple(r.sentence_ids), r.difficulty) for r in spans.collect()} >= {("c1", ("s1",), "easy"), ("c1", ("s1", "s2"), "medium"), ("c2", ("s3",), "easy")} and spans.count() == 6
    ones = spans.where("n = 1").withColumn("document_id", F.lit("d"))
    good = json.dumps({"question": " why? ", "gold_answer": "Because. And so."})
    model = lambda: Says(**{"are red": good, "are green": "prose", "grow on": json.dumps({"question": "why?", "gold_answer": " "})})
    found = authoring.author_items(ones, model, providers.Roles("a", "b", "c"))
    item = found.items.first()
    assert (item.question, item.gold_citations, item.author_model, item.question_id) == ("why?", [["s1"], ["s1"]], "b", "synth-0000-c1")
    assert sorted(r.error for r in found.failures.collect()) == ["empty gold_answer", "empty gold_answer", "no JSON object"]
    assert {r.difficulty: r.n for r in found.counts.collect()} == {"easy": 1, "medium": 0, "hard": 0}
    assert chunking.quotas(10) == {"easy": 4, "medium": 4, "hard": 2} and chunking.quotas(0) == {"easy": 0, "medium": 0, "hard": 0}


def test_layouts_become_chunks_and_indexes(spark, tmp_path):
    for name, paragraphs in (("b", [{"content": "T", "role": "title"}, {"content": "One two three. Four five."}, {"content": "H", "role": "sectionHeading"}, {"content": "Six.", "boundingRegions": [{"pageNumber": 2}]}, {"content": "9", "role": "pageNumber"}]), ("a", [{"content": "Just this."}, {"content": " "}])):
        (tmp_path / "parsed" / name).mkdir(parents=True)
        (tmp_path / "parsed" / name / "layout.json").write_text(json.dumps({"paragraphs": paragraphs}))
    (tmp_path / "parsed" / "empty").mkdir()
    stats = {r.document_id: (r.n_chunks, r.n_sentences, r.n_sections) for r in indexing.chunk_directory(spark, str(tmp_path / "parsed"), str(tmp_path / "chunks"), target_tokens=3, overlap_tokens=1).collect()}
    # Titles and headings are content too, and each section starts a chunk.
    assert set(stats) == {"a", "b"} and stats["a"] == (1, 1, 1)
    chunks = readers.read_chunks(spark, str(tmp_path / "chunks"))
    six = next(r for r in chunks.collect() if r.text.endswith("Six."))
    assert (six.section_path, six.document_id) == (["T", "H"], "b") and next(s for s in six.sentences if s.text == "Six.").page == 2
    assert indexing.offsets_hold(chunks).where("n_sentences <> n_round_trips").count() == 0
    index = str(tmp_path / "index")
    n = indexing.build_index(chunks, index, providers.HashingEmbedder)
    assert n == (chunks.count(), 1 + 5) and indexing.build_index(chunks.limit(1), index, providers.HashingEmbedder)[0] == 1
    assert tables.read_table(spark, f"{index}/chunks").count() == n[0]
    assert tuple(indexing.round_trip(chunks, tables.read_table(spark, f"{index}/chunks"), "chunk_id").first()) == (n[0], n[0])
    with pytest.raises(ValueError, match="repeat"):
        tables.write_table(chunks.unionByName(chunks), index, "chunk_id")
    assert retrieval.fetch_chunks(spark.createDataFrame([(six.chunk_id,), ("none",), (six.chunk_id,)], "chunk_id string"), chunks).count() == 1
    only = readers.read_layout(spark, str(tmp_path / "parsed"), ["a"])
    assert {r.doc_id for r in only.collect()} == {"a"}


def test_what_is_still_to_do(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "document_id string, sha256 string")
    parsed = spark.createDataFrame([("a", 3)], "document_id string, page_count int")
    assert [r.document_id for r in indexing.to_parse(files, parsed).collect()] == ["b"] and indexing.to_parse(files, parsed, force=True).count() == 2
    assert indexing.ingested(files, parsed).first().page_count == 3
    assert [r.document_id for r in indexing.manifest(spark, [("x", "t", "u"), ("y", "t", "u")], ["y"]).collect()] == ["y"]
    items = spark.createDataFrame([(k, k % 2 == 0, True) for k in range(10)] + [(10, None, True)], "question_id int, judge_well_formed boolean, judge_supported boolean")
    reviews = spark.createDataFrame([(0,), (2,)], "question_id int")
    left = indexing.to_review(items, reviews)
    assert sorted(r.question_id for r in left.collect()) == [4, 6, 8] and indexing.to_review(items, reviews, n=2).count() == 2
    assert indexing.to_review(items, reviews, include_failing=True).count() == 9
    lines = indexing.citation_lines(indexing.demo_sentences(spark.createDataFrame([("q", "One . Two")], "query_id string, text string")), spark.createDataFrame([("q", 0, 2, "b"), ("q", 0, 1, "a")], "query_id string, sentence_no int, place int, sentence_id string"))
    assert [r.line for r in lines.orderBy("sentence_no").collect()] == ["One [a, b]", "Two"]


def test_reviews_last_line_wins_and_bad_ones_raise(spark, tmp_path):
    path = tmp_path / "reviews.jsonl"
    line = lambda **x: json.dumps({"question_id": "q", "confidence": "low", "flags": ["other", "unknown"], **x})
    path.write_text("\n".join([line(notes="first", reviewed_at="2025"), "", line(notes="last", confidence="high", reviewed_at="2024"), line(question_id="r", reviewer_role="pm")]))
    found = {r.question_id: r for r in readers.read_reviews(spark, str(path)).collect()}
    assert (found["q"].notes, found["q"].confidence, found["q"].reviewer, found["q"].reviewer_role, found["r"].reviewer_role) == ("last", "high", "unknown", "other", "pm")
    assert readers.read_reviews(spark, str(tmp_path / "none")).count() == 0
    assert spark.createDataFrame([(["other", "unknown"],)], "f array<string>").select(readers.known_flags(F.col("f")).alias("f")).first().f == ["other"]
    flags = spark.createDataFrame([(["b", "a"],), (["a"],), (["c"],)], "flags array<string>")
    assert [(r.flag, r.n) for r in metrics.top_flags(flags, 2).collect()] == [("a", 2), ("b", 1)]
    for bad in (line(confidence="sure"), line(reviewer_role="boss"), "{"):
        path.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            readers.read_reviews(spark, str(path)).collect()


def test_ground_truth_is_read_strictly(spark, tmp_path):
    path = tmp_path / "gt.jsonl"
    rows = [{"question_id": f"q{k}", "judge_well_formed": k != 1, "judge_supported": None if k == 2 else True} for k in range(5)]
    path.write_text("\n\n".join(map(json.dumps, rows)))
    assert readers.read_ground_truth(spark, str(path)).count() == 5
    assert [r.question_id for r in readers.read_ground_truth(spark, str(path), only_passing=True, limit=2).collect()] == ["q0", "q3"]
    path.write_text('{"question_id": ')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_ground_truth(spark, str(path)).collect()


def test_binaries_and_exports(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = readers.read_binaries(spark, str(tmp_path / "x.bin")).first()
    assert (row.size, row.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    rounded = sinks.rounded(spark.createDataFrame([(0.66665, 2.5)], "x double, y double"), 0).first()
    assert (rounded.x, rounded.y) == (1.0, 2.0)
    parents = spark.createDataFrame([("q", 1), ("r", 2)], "id string, n int")
    children = spark.createDataFrame([("q", "b"), ("q", "a")], "id string, s string")
    documents = {r.id: json.loads(r.document) for r in sinks.nested(parents, children, "id", "parts").collect()}
    assert documents["q"] == {"id": "q", "n": 1, "parts": [{"s": "a"}, {"s": "b"}]}
    summary = retrieval.agreement_summary(spark.createDataFrame([(0.5,), (1.0,)], "agreement double"), {"chunks": spark.createDataFrame([(1.0,), (9.0,), (2.0,)], "latency_ms double")}).first()
    assert (summary.mean_agreement, summary.min_agreement, summary.chunks_median_ms, summary.chunks_max_ms) == (0.75, 0.5, 2.0, 9.0)
    assert {r.by: r.coverage for r in metrics.coverage(spark.createDataFrame([("a", 0), ("a", 2)], "by string, n_citations int"), ["by"]).collect()} == {"a": 0.5}


def test_replies_of_authors_and_labellers(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    assert one(replies.author_reply(F.lit('{"question": "", "gold_answer": "a"}'))).error == "empty question"
    assert one(replies.author_reply(F.lit(None).cast("string"))).error == "no JSON object"
    assert one(replies.verdict_reply(F.lit('{"well_formed": "NO", "supported": 1}'))).supported is True
    assert one(replies.support_reply(F.lit('{"supporting_indices": [2, "1", 2, 9]}'), F.lit(3))).indices == [2, 1]
    assert one(replies.support_reply(F.lit("prose"), F.lit(3))).error == "no JSON object"


def test_completions_carry_what_the_service_says(spark):
    class Service:
        def complete(self, prompt):
            return providers.Completion(prompt.upper(), 3, 4, "stop")

    rows = providers.complete_column(spark.createDataFrame([("a",), (None,)], "prompt string"), Service).collect()
    assert [(r.reply, r.prompt_tokens, r.completion_tokens, r.finish_reason) for r in rows] == [("A", 3, 4, "stop"), (None, None, None, None)]
    given = spark.createDataFrame([("x", [1.0])], "text string, embedding array<double>")
    assert providers.embed_column(given, None).first().embedding == [1.0]
