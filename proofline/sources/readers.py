"""Readers of the pipeline's JSON lines, layouts, binaries, reviews and public benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE = "struct<sentence_id: string, chunk_id: string, document_id: string, text: string, page: int, section_path: array<string>, char_start: int, char_end: int, embedding: array<float>>"
CHUNK = f"chunk_id string, document_id string, page int, section_path array<string>, text string, token_count int, embedding array<float>, sentences array<{SENTENCE}>"
GROUND_TRUTH = (
    "question_id string, question string, difficulty string, gold_answer string, gold_citations array<array<string>>, author_model string, document_id string, page int, section_path array<string>, "
    "source_span_sentence_ids array<string>, judge_model string, judge_reasons string, judge_well_formed boolean, judge_supported boolean, union_additions array<string>"
)
LAYOUT = "paragraphs array<struct<content: string, role: string, boundingRegions: array<struct<pageNumber: int>>>>"
#: What reviews may say.
CONFIDENCES, ROLES = ("high", "medium", "low"), ("ml-engineer", "pm", "other")
FLAGS = ("question_unclear", "question_not_answerable", "gold_answer_wrong", "gold_answer_incomplete", "citation_mismatch", "citation_insufficient", "out_of_scope", "other")
REVIEW = "question_id string, reviewer string, reviewer_role string, confidence string, flags array<string>, notes string, reviewed_at string"


def read_chunks(spark: SparkSession, path: str, document_ids: list[str] | None = None) -> DataFrame:
    """Chunks of one file or of a directory's files, with the name of their ``file`` to order by, perhaps of some documents only; a malformed line raises."""
    rows = spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_name"))
    return rows if document_ids is None else rows.where(F.col("document_id").isin(document_ids))


#: What lines of files are ordered by: names, then the parts that a file is read in, then the lines of a part.
IN_ORDER = ("file", "path", "block", "line")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, *IN_ORDER) of the lines that are not blank; their order is that of the files, however these are split."""
    meta = {"file": "file_name", "path": "file_path", "block": "file_block_start"}
    lines = spark.read.text(path).select("value", *(F.col(f"_metadata.{name}").alias(c) for c, name in meta.items()), F.monotonically_increasing_id().alias("line"))
    return lines.where("trim(value) <> ''")


def first_lines(rows: DataFrame, limit: int | None) -> DataFrame:
    """``rows`` (*IN_ORDER, ...), or the first ``limit`` of them, without what they are ordered by."""
    return (rows.orderBy(*IN_ORDER).limit(limit) if limit else rows).drop(*IN_ORDER)


def read_ground_truth(spark: SparkSession, path: str, only_passing: bool = False, limit: int | None = None) -> DataFrame:
    """Ground-truth items; ``only_passing`` leaves those that both verdicts are true for, ``limit`` the first of these in the files; a malformed line raises."""
    items = ordered_lines(spark, path).select(*IN_ORDER, F.from_json("value", GROUND_TRUTH, {"mode": "FAILFAST"}).alias("r"))
    items = items.select(*IN_ORDER, "r.*")
    return first_lines(items.where("judge_well_formed and judge_supported") if only_passing else items, limit)


def read_layout(spark: SparkSession, root: str, document_ids: list[str] | None = None) -> DataFrame:
    """(doc_id, para_no, role, content, page) from ``root``/<document>/layout.json; directories without the file are passed over, a malformed file raises."""
    files = spark.read.schema(LAYOUT).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/layout.json").withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/layout\.json$", 1))
    if document_ids is not None:
        files = files.where(F.col("doc_id").isin(document_ids))
    page = F.coalesce(F.get("p.boundingRegions", F.lit(0))["pageNumber"], F.lit(1))
    return files.select("doc_id", F.posexplode("paragraphs").alias("para_no", "p")).select("doc_id", "para_no", "p.role", "p.content", page.alias("page"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The last review of each question_id, by its line in files in order of their names; no file gives no reviews.

    A malformed line, an unknown confidence and an unknown role raise.
    """
    try:
        lines = ordered_lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], REVIEW)
    read = lines.select(*IN_ORDER, F.from_json("value", REVIEW, {"mode": "FAILFAST"}).alias("r")).select(*IN_ORDER, "r.*")
    return last_wins(checked_reviews(read), "question_id", list(IN_ORDER)).drop(*IN_ORDER)


def checked_reviews(reviews: DataFrame) -> DataFrame:
    """``reviews`` with an unknown reviewer and the role "other" where none is given; other confidences and roles than the known ones raise."""
    known = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c}: "), F.coalesce(c, F.lit("none")))))
    filled = reviews.withColumns({"reviewer": F.coalesce("reviewer", F.lit("unknown")), "reviewer_role": F.coalesce("reviewer_role", F.lit("other"))})
    return filled.withColumns({"confidence": known("confidence", CONFIDENCES), "reviewer_role": known("reviewer_role", ROLES), "flags": F.coalesce("flags", F.array().cast("array<string>"))})


def known_flags(flags: Column) -> Column:
    """``flags`` without those that are not among ``FLAGS``, in order."""
    return F.filter(flags, lambda x: x.isin(*FLAGS))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def first_of(*columns: Column) -> Column:
    """The first value that is neither null, empty nor 0, as text; each column is worked out once."""
    return F.get(F.filter(F.array(*columns), lambda c: (c != "") & (c != "0")), F.lit(0))


def _first_text(*columns: Column) -> Column:
    """The first value that is neither null nor empty; each column is worked out once."""
    return F.get(F.filter(F.array(*columns), lambda c: c != ""), F.lit(0))


def _worked_out(lines: DataFrame, carry: Sequence[str], **columns: Column) -> DataFrame:
    """``lines`` with ``carry`` and ``columns``: conditions on these find them worked out, while a select's would be read out of the JSON again for each mention."""
    return lines.select(*carry, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _json(line: Column, *paths: str) -> list[Column]:
    return [F.get_json_object(line, p) for p in paths]


def _ids(text: Column) -> Column:
    """The ids of a JSON list of numbers, texts, or objects with idx, id or quote_id (where an idx of 0 is no id)."""
    entries = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    one = lambda x: F.when(F.startswith(x, F.lit("{")), first_of(*_json(x, "$.idx", "$.id", "$.quote_id"))).otherwise(x)
    return F.filter(F.transform(entries, one), lambda x: x.isNotNull())


def _passages(raw: Column, ids: Sequence[str], texts: Sequence[str]) -> Column:
    """array<struct<passage_id, text>> of those entries of ``raw`` that have a text; one without an id has its place among them."""
    read = F.transform(raw, lambda x: F.struct(first_of(*_json(x, *ids)).alias("id"), _first_text(*_json(x, *texts)).alias("text")))
    return F.transform(F.filter(read, lambda p: p["text"].isNotNull()), lambda p, i: F.struct(F.coalesce(p["id"], i.cast("string")).alias("passage_id"), p["text"].alias("text")))


def read_hagrid(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(item_id, question, answer, passages, gold) of quote-attributed answers, perhaps the first ``limit`` items of the files; see ``hagrid_items``."""
    return first_lines(hagrid_items(ordered_lines(spark, path), IN_ORDER), limit)


def hagrid_items(lines: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Items from lines of JSON (``value``), with the columns ``carry`` of their lines.

    Alternative keys are taken in turn; a passage without an id has its place
    among the passages with a text; gold is the union of the answers' and their
    sentences' lists, restricted to passages that exist.  Items without a
    question, passages or gold are left out.
    """
    v = F.col("value")
    raw = F.from_json(F.coalesce(*_json(v, "$.quotes", "$.passages")), "array<string>")
    passages = _passages(raw, ("$.idx", "$.id", "$.quote_id"), ("$.text", "$.quote"))
    answers = F.coalesce(F.from_json(F.get_json_object(v, "$.answers"), "array<string>"), F.array().cast("array<string>"))
    own = lambda a: F.flatten(F.array(*(_ids(c) for c in _json(a, "$.attributable", "$.quotes_used", "$.supporting_quotes"))))
    sentences = lambda a: F.coalesce(F.from_json(F.get_json_object(a, "$.sentences"), "array<string>"), F.array().cast("array<string>"))
    inner = lambda a: F.flatten(F.transform(sentences(a), lambda s: F.flatten(F.array(*(_ids(c) for c in _json(s, "$.attributable_quotes", "$.supporting_quotes"))))))
    gold = F.array_distinct(F.flatten(F.transform(answers, lambda a: F.concat(own(a), inner(a)))))
    said = F.get(F.filter(F.transform(answers, lambda a: F.coalesce(*_json(a, "$.answer", "$.text"))), lambda t: F.trim(t) != ""), F.lit(0))
    items = _worked_out(lines, carry, item_id=F.coalesce(*_json(v, "$.query_id", "$.id", "$.qid")), question=first_of(*_json(v, "$.query", "$.question")), answer=said, passages=passages, gold=gold)
    restricted = items.withColumn("gold", F.array_intersect("gold", F.transform("passages", lambda p: p["passage_id"])))
    return restricted.where("question is not null and size(passages) > 0 and size(gold) > 0")


def read_alce(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(item_id, question, answer, passages, gold), perhaps of the first ``limit`` items of the files; see ``alce_items``."""
    return first_lines(alce_items(ordered_lines(spark, path), IN_ORDER), limit)


def alce_items(lines: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Items, with the columns ``carry`` of their lines, whose citations are places, from 0, among the documents with a text; places outside are left out, and so are items without gold."""
    v = F.col("value")
    raw = F.from_json(F.get_json_object(v, "$.docs"), "array<string>")
    passages = _passages(raw, ("$.id", "$.docid"), ("$.text", "$.snippet"))
    places = F.from_json(F.coalesce(*_json(v, "$.citations", "$.gold_citations")), "array<int>")
    items = _worked_out(lines, carry, item_id=F.coalesce(*_json(v, "$.id", "$.question_id")), question=first_of(*_json(v, "$.question", "$.query")), answer=F.get_json_object(v, "$.answer"), passages=passages, places=places)
    gold = F.array_distinct(F.transform(F.filter("places", lambda i: (i >= 0) & (i < F.size("passages"))), lambda i: F.get("passages", i)["passage_id"]))
    return items.withColumn("gold", F.coalesce(gold, F.array().cast("array<string>"))).drop("places").where("question is not null and size(passages) > 0 and size(gold) > 0")
