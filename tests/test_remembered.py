"""What models were asked before, limits in the order of files, and failing embeddings as rows."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from proofline.plans import answering, evaluation
from proofline.sources import readers, remembered
from proofline.sources.providers import HashingEmbedder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Plans of few rows run faster than they compile."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Fails(HashingEmbedder):
    """Fails on every batch that has a text with ``word`` in it."""

    def __init__(self, word):
        super().__init__()
        self.word = word

    def embed(self, texts):
        if any(self.word in text for text in texts):
            raise ConnectionError(self.word)
        return super().embed(texts)


class Never:
    def embed(self, texts):
        raise AssertionError("asked again")

    def complete(self, prompt, **options):
        raise AssertionError("asked again")


def test_vectors_are_asked_for_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "a b"), (4, None), (5, "")], "id long, text string")
    got = {r.id: r for r in remembered.embed_remembered(rows, lambda: Fails("bad"), path, "m").collect()}
    assert len(got) == 5 and got[1].embedding == got[3].embedding == HashingEmbedder().embed(["a b"])[0]
    assert got[2].embedding is None and got[2].embed_error == "ConnectionError: bad" and got[4].embedding == got[5].embedding
    again = {r.id: r for r in remembered.embed_remembered(rows.where("id <> 2"), Never, path, "m").collect()}
    assert {k: r.embedding for k, r in again.items()} == {k: r.embedding for k, r in got.items() if k != 2} and not any(r.embed_error for r in again.values())
    assert remembered.embed_remembered(rows.where("id = 2"), HashingEmbedder, path, "m").first().embedding is not None
    assert remembered.embed_remembered(rows.where("id = 1"), Never, path, "another").first().embed_error == "AssertionError: asked again"
    assert remembered.embed_remembered(rows.limit(0), Never, str(tmp_path / "none"), "m").collect() == []


def test_replies_are_asked_for_once_by_prompt_model_and_options(spark, tmp_path):
    class Echo:
        def complete(self, prompt, temperature):
            return f"{prompt} {temperature}"

    path = str(tmp_path / "replies")
    rows = spark.createDataFrame([(1, "x", 0.0), (2, "x", 1.0), (3, None, 0.0), (4, "x", 0.0)], "id long, prompt string, temperature double")
    said = lambda model, name="m": {r.id: (r.reply, r.error) for r in remembered.complete_remembered(rows, model, path, name, options=["temperature"]).collect()}
    first = said(Echo)
    assert first == {1: ("x 0.0", None), 2: ("x 1.0", None), 3: (None, None), 4: ("x 0.0", None)}
    assert said(Never) == first
    assert said(Never, "other")[1] == (None, "AssertionError: asked again")


@pytest.mark.parametrize("split", ["64", "1000000"])
def test_limits_take_the_first_lines_of_files(spark, tmp_path, split):
    names = [f"q{(k * 37) % 101}" for k in range(60)]
    (tmp_path / "b.jsonl").write_text("\n\n".join(json.dumps({"question_id": q, "judge_well_formed": True, "judge_supported": k % 3 != 0}) for k, q in enumerate(names[30:], 30)))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"question_id": q, "judge_well_formed": True, "judge_supported": k % 3 != 0}) for k, q in enumerate(names[:30])))
    alce = tmp_path / "alce.json"
    alce.write_text("\n".join(json.dumps({"id": q, "question": "?", "docs": [{"id": "d", "text": "t"}], "citations": [0] if k % 2 else []}) for k, q in enumerate(names)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        of = lambda rows: sorted(r[0] for r in rows.collect())
        passing = [q for k, q in enumerate(names) if k % 3]
        for n in (1, 7, 25):
            assert of(readers.read_ground_truth(spark, str(tmp_path / "*.jsonl"), limit=n).select("question_id")) == sorted(names[:n])
            assert of(readers.read_ground_truth(spark, str(tmp_path / "*.jsonl"), only_passing=True, limit=n).select("question_id")) == sorted(passing[:n])
            assert of(readers.read_alce(spark, str(alce), n).select("item_id")) == sorted(names[1::2][:n])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_failing_embeddings_are_rows(spark):
    class Model:
        def complete(self, prompt, **options):
            return "the second says zzz." if "lemons" in prompt.split("Sources:")[0] else "apples are red."

    sentence = "struct<sentence_id: string, text: string, page: int, section_path: array<string>, char_start: int, char_end: int>"
    chunks = spark.createDataFrame([("c1", "d", 1, ["A"], "apples are red. lemons too.", 5, [("s1", "apples are red.", 1, ["A"], 0, 15), ("s2", "lemons too.", 1, ["A"], 16, 27)])], f"chunk_id string, document_id string, page int, section_path array<string>, text string, token_count int, sentences array<{sentence}>")
    sentences = chunks.select("chunk_id", "document_id", F.explode("sentences").alias("s")).select("chunk_id", "document_id", "s.sentence_id", "s.text", "s.page", "s.section_path")
    items = spark.createDataFrame([("q1", "are apples red", "easy", [["s1"]]), ("q2", "what of zzz", "easy", [["s1"]]), ("q3", "what of lemons", "easy", [["s2"]])], "question_id string, question string, difficulty string, gold_citations array<array<string>>")
    found = evaluation.evaluate_items(items, chunks, sentences, Model, "m", k_sentences=2, k_chunks=1, tau=0.9, top_k=1, embedder=lambda: Fails("zzz"))
    rows = {(r.question_id, r.strategy): r for r in found.items.collect()}
    assert len(rows) == 6
    assert rows["q1", answering.ALIGNED].f1 == 1.0 and rows["q1", answering.ALIGNED].error is None
    assert all(rows["q2", s].error == "retrieve_failed: ConnectionError: zzz" and rows["q2", s].retrieval_recall_at_k == 0.0 for s in answering.STRATEGIES)
    lost = rows["q3", answering.ALIGNED]
    assert lost.error == "generate_or_cite_failed: ConnectionError: zzz" and lost.f1 == 0.0 and lost.answer_text is None and lost.retrieval_recall_at_k == 1.0
    assert rows["q3", answering.INLINE].error is None
