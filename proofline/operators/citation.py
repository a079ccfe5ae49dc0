"""Attaching citations to answers: by inline tags or by cosine alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sets as S
from ..functions import text as T

TAU, TOP_K = 0.75, 3


def inline_citations(answers: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(answer_id, tag_no, sid, at, valid) for each tag of ``answers`` (answer_id, text); valid ids are in ``whitelist`` (answer_id, sid)."""
    tags = answers.select("answer_id", F.posexplode(T.tag_anchors(F.col("text"))).alias("tag_no", "tag")).select("answer_id", "tag_no", "tag.sid", "tag.at")
    known = whitelist.select("answer_id", "sid").distinct().withColumn("valid", F.lit(True))
    return tags.join(known, ["answer_id", "sid"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def attributed(tags: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, sid, place): valid tags at the sentence of the stripped text they belong to, each id once, in order.

    ``answers`` has (answer_id, spans: array<struct<start, end>>).
    """
    joined = tags.where("valid").join(answers.select("answer_id", "spans"), "answer_id")
    placed = joined.withColumn("sentence_no", T.anchor_sentence(F.col("spans"), F.col("at")))
    first = placed.groupBy("answer_id", "sentence_no", "sid").agg(F.min("tag_no").alias("tag_no"))
    return first.select("answer_id", "sentence_no", "sid", F.row_number().over(Window.partitionBy("answer_id", "sentence_no").orderBy("tag_no")).alias("place"))


def inline_report(tags: DataFrame) -> DataFrame:
    """(answer_id, n_tags, n_valid, hallucinated): counts before repeats are dropped, and the invalid ids in order."""
    bad = F.transform(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("tag_no", "sid")))), lambda x: x["sid"])
    return tags.groupBy("answer_id").agg(F.count("*").alias("n_tags"), F.count_if("valid").alias("n_valid"), bad.alias("hallucinated"))


def align(sentences: DataFrame, candidates: DataFrame, tau: float = TAU, top_k: int = TOP_K) -> DataFrame:
    """(query_id, sentence_no, sid, confidence, rank): up to ``top_k`` candidates at or above ``tau`` for each answer sentence.

    ``sentences`` has (query_id, sentence_no, embedding), ``candidates``
    (query_id, sid, embedding): only candidates of the same query are compared.
    """
    return rank_pairs(similarities(sentences, candidates), tau, top_k)


def similarities(sentences: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, sentence_no, sid, sim) of every answer sentence and candidate of a query; sim has 6 digits."""
    a = sentences.select("query_id", "sentence_no", S.unit(F.col("embedding")).alias("a"))
    b = candidates.select("query_id", "sid", S.unit(F.col("embedding")).alias("b"))
    return a.join(b, "query_id").select("query_id", "sentence_no", "sid", F.round(S.dot(F.col("a"), F.col("b")), 6).alias("sim"))


def align_within(sentences: DataFrame, pool: DataFrame, keys: list[str], tau: float = TAU, top_k: int = TOP_K) -> DataFrame:
    """(keys, sentence_no, sentence_id, confidence, rank): as ``align``, for answers told apart by ``keys``, one of them query_id.

    ``pool`` has (query_id, sentence_id, embedding); an id that it has twice is
    ranked twice, as it is not reduced.
    """
    a = sentences.select(*keys, "sentence_no", S.unit(F.col("embedding")).alias("a"))
    b = pool.select("query_id", "sentence_id", S.unit(F.col("embedding")).alias("b"))
    sims = a.join(b, "query_id").select(*keys, "sentence_no", "sentence_id", F.round(S.dot(F.col("a"), F.col("b")), 6).alias("sim")).where(F.col("sim") >= tau)
    rank = F.row_number().over(Window.partitionBy(*keys, "sentence_no").orderBy(F.desc("sim"), "sentence_id"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= top_k).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "sim"))).drop("sim")


def similarity_range(pairs: DataFrame) -> DataFrame:
    """(low, high, mean) of the similarities of ``pairs``."""
    return pairs.agg(F.min("sim").alias("low"), F.max("sim").alias("high"), F.avg("sim").alias("mean"))


def rank_pairs(pairs: DataFrame, tau: float, top_k: int) -> DataFrame:
    """The best pairs at or above ``tau`` of each sentence; confidence is the cosine within 0 and 1."""
    rank = F.row_number().over(Window.partitionBy("query_id", "sentence_no").orderBy(F.desc("sim"), "sid"))
    kept = pairs.where(F.col("sim") >= tau).withColumn("rank", rank).where(F.col("rank") <= top_k)
    return kept.select("query_id", "sentence_no", "sid", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "sim")).alias("confidence"), "rank")


def sweep(pairs: DataFrame, n_sentences: int, taus: list[float], ks: list[int]) -> DataFrame:
    """(tau, top_k, n_citations, cited, uncited, per_sentence) for each pair of parameters.

    The pairs are ranked once and each parameter reads a prefix of that ranking.
    """
    spark = pairs.sparkSession
    best = rank_pairs(pairs, min(taus), max(ks))
    params = spark.createDataFrame([(t, k) for t in taus for k in ks], "tau double, top_k int")
    hit = best.join(F.broadcast(params), F.expr("confidence >= tau and rank <= top_k"))
    counted = hit.groupBy("tau", "top_k").agg(F.count("*").alias("n_citations"), F.countDistinct("query_id", "sentence_no").alias("cited"))
    filled = params.join(counted, ["tau", "top_k"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_citations", "cited")})
    return filled.withColumns({"uncited": F.lit(n_sentences) - F.col("cited"), "per_sentence": F.round(F.col("n_citations") / max(1, n_sentences), 2)})


def first_by_priority(preferred: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """One row of each key: of ``preferred`` where it has one, else the first of ``others``; both have a column ``place``."""
    both = preferred.withColumn("turn", F.lit(0)).unionByName(others.withColumn("turn", F.lit(1)))
    return both.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "place"))).where("k = 1").drop("k", "turn", "place")


def context_blocks(context: DataFrame, tagged: bool = True, most_chars: int | None = None) -> DataFrame:
    """(query_id, block, sentence_ids): the chunks of each query's context in order, and the ids that a tag stands for.

    ``context`` has (query_id, place, chunk_id, document_id, page, section_path,
    text, sentences).  Each chunk has a header with its section, where it has
    one, and its page.  Below stand its tagged sentences, those without an id or
    text left out, if ``tagged`` and it has any; else its text, cut after
    ``most_chars``.  A blank line is between chunks.
    """
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    none = F.array().cast("array<string>")
    sentences = F.filter("sentences", lambda s: (F.coalesce(s["sentence_id"], F.lit("")) != "") & (F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    has = F.lit(tagged) & (F.size(F.coalesce("sentences", F.array().cast(context.schema["sentences"].dataType))) > 0)
    label = F.when(F.size(F.coalesce("section_path", none)) > 0, F.concat(F.lit(" | "), F.array_join("section_path", " > "))).otherwise("")
    head = F.concat(F.format_string("[Chunk %d: %s | doc=%s", "n", "chunk_id", F.col("document_id").cast("string")), label, F.format_string(" | p.%d]", F.coalesce("page", F.lit(0))))
    text = F.trim(F.coalesce("text", F.lit("")))
    body = text if most_chars is None else F.when(F.length(text) > most_chars, F.concat(F.rtrim(F.substring(text, 1, most_chars)), F.lit(" …"))).otherwise(text)
    lines = F.transform(sentences, lambda s: F.concat(F.lit("[s:"), s["sentence_id"], F.lit("] "), F.trim(s["text"])))
    parts = context.withColumn("n", n).select(
        "query_id", "n", F.array_join(F.when(has, F.concat(F.array(head), lines)).otherwise(F.array(head, body)), "\n").alias("part"),
        F.when(has, F.transform(sentences, lambda s: s["sentence_id"])).otherwise(none).alias("ids"),
    )
    rows = F.array_sort(F.collect_list(F.struct("n", "part", "ids")))
    joined = parts.groupBy("query_id").agg(rows.alias("rows"))
    return joined.select("query_id", F.rtrim(F.array_join("rows.part", "\n\n")).alias("block"), F.flatten("rows.ids").alias("sentence_ids"))
