"""Keyword search over an inverted index that is dealt by document, with the most that each list can add to a score.

Documents are dealt into shards of a bounded size.  A shard has one row for each
of its terms: the documents with it, their BM25 parts, and the largest of them.  So
a frequent term's list is as many rows as there are shards, a search reads the
rows of its terms only, and what tasks hand on are ``k`` rows of a query and
shard.  A few shards are searched first; the ``k``-th score found there is what a
hit elsewhere must reach.  A shard whose largest parts together can't reach it
is not scored, and lists that can't all together count only for documents that
others bring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.sinks import kept

#: The published constants of Okapi BM25.
K1, B = 1.2, 0.75
#: Documents of a shard, about; one shard in so many is searched first.
DOCS_PER_SHARD, FIRST_SHARDS = 4096, 16
#: Queries whose terms are sent to the tasks at once.
_SENT_QUERIES = 4000
#: Scores are rounded to 6 digits; what may still round up to a bound is not left out.
_SLACK = 1e-5
#: So many distinct question terms are broadcast; rows whose terms are counted at once.
_SENT_TERMS, _COUNTED_ROWS = 200_000, 512
_TERM = r"[\p{L}\p{N}]+"
_WORD = "[\\p{L}\\p{N}]+(?:['\u2019][\\p{L}\\p{N}]+)*"
#: The English stop words of the public search library whose analyser the index names.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def plain_terms(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def stemmed(word: Column) -> Column:
    """A word in lower case without an English plural's ending: -ies becomes -y, -es and -s lose the s.

    Words of under four letters, and those on -us, -ss, -aes, -ees and -oes, stay
    as they are, and so do those on -aies and -eies.
    """
    ends = lambda *endings: reduce(or_, (F.endswith(word, F.lit(e)) for e in endings))
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    keeps = (F.length(word) < 4) | ~ends("s") | ends("us", "ss", "aes", "ees", "oes", "aies", "eies")
    return F.when(keeps, word).when(ends("ies"), F.concat(cut(3), F.lit("y"))).otherwise(cut(1))


def english_terms(text: Column) -> Column:
    """Words in lower case, apostrophes within them kept, without possessive endings and ``STOP_WORDS``, as ``stemmed`` leaves them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    owned = F.transform(words, lambda w: F.when(F.endswith(w, F.lit("'s")) | F.endswith(w, F.lit("\u2019s")), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))
    return F.transform(F.filter(owned, lambda w: ~w.isin(*STOP_WORDS)), stemmed)


class KeywordIndex(NamedTuple):
    """``lists``: (shard, term, n, most, postings: array<struct<doc_id, part>>); ``terms``: (term, df); ``totals``: (n_docs, mean_size, shards), one row."""

    lists: DataFrame
    terms: DataFrame
    totals: DataFrame

    def save(self, folder: str) -> None:
        """Write the index; lists and terms are sorted by term, so that a search reads only the row groups of its terms."""
        self.lists.repartitionByRange("term", "shard").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/lists")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        self.totals.write.mode("overwrite").parquet(f"{folder}/totals")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> KeywordIndex:
        """The index that ``save`` wrote."""
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in cls._fields))


def build_index(docs: DataFrame, only: DataFrame | None = None, analyse: Callable[[Column], Column] = plain_terms, docs_per_shard: int = DOCS_PER_SHARD) -> KeywordIndex:
    """The index of ``docs`` (doc_id, text): of all terms, or of ``only`` these (term).

    Texts are split once, and their terms counted within the row; what is
    shuffled is a row for each document, dealt to its shard, which one task turns
    into lists.  A null text has no terms but counts as a document; a document
    without an id counts but is not found.
    """
    words = docs.select("doc_id", F.coalesce(analyse(F.col("text")), F.array().cast("array<string>")).alias("words"))
    sent, many = None, False
    if only is not None:
        asked = [row["term"] for row in only.select("term").distinct().limit(_SENT_TERMS + 1).collect()]  # bounded by ``_SENT_TERMS``
        many = len(asked) > _SENT_TERMS
        sent = None if many else docs.sparkSession.sparkContext.broadcast(frozenset(asked))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = kept(words.mapInArrow(_counted(sent), f"doc_id {id_type}, size int, terms array<string>, tfs array<int>"), "term_counts")
    totals = counts.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("size") / F.count("*"), F.lit(0.0)).alias("mean_size"))
    totals = kept(totals.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / docs_per_shard)).cast("int")), "totals")
    known = totals.first()
    rows = counts.where("doc_id is not null and size(terms) > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(known["shards"])).cast("int"))
    lists = rows.groupBy("shard").applyInArrow(_listed(float(known["mean_size"] or 1)), f"shard int, term string, n long, most double, postings array<struct<doc_id: {id_type}, part: double>>")
    if many:
        lists = lists.join(only.select("term"), "term", "left_semi").select(*lists.columns)
    lists = kept(lists, "lists")
    return KeywordIndex(lists, kept(lists.groupBy("term").agg(F.sum("n").alias("df")), "terms"), totals)


def _counted(sent: Broadcast | None):
    """A pass over (doc_id, words) that counts each document's terms within its row, of those that are ``sent``, or of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _COUNTED_ROWS):
                piece = batch.slice(at, _COUNTED_ROWS)
                lists = piece.column("words")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
                coded = lists.flatten().dictionary_encode()
                row, code = np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy(zero_copy_only=False)
                if sent is not None:
                    use = np.array([word in sent.value for word in coded.dictionary.to_pylist()], bool)[code]
                    row, code = row[use], code[use]
                pair, tf = np.unique(row * max(1, len(coded.dictionary)) + code, return_counts=True)
                row, code = np.divmod(pair, max(1, len(coded.dictionary)))
                ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(code, pa.int64())))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes), terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["doc_id", "size", "terms", "tfs"])

    return count


def _listed(mean_size: float):
    """From a shard's documents (shard, doc_id, size, terms, tfs) to its lists; rows of one id and size are one document."""

    def lists(table: pa.Table) -> pa.Table:
        ids = pa.concat_arrays(table.column("doc_id").chunks).dictionary_encode()
        terms, tfs = (pa.concat_arrays(table.column(c).chunks) for c in ("terms", "tfs"))
        row = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy(zero_copy_only=False))
        coded = terms.flatten().dictionary_encode()
        doc, size = ids.indices.to_numpy(zero_copy_only=False)[row], table.column("size").to_numpy()[row]
        code, tf = coded.indices.to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((size, doc, code))
        code, doc, size, tf = code[order], doc[order], size[order], tf[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(doc) != 0) | (np.diff(size) != 0)]))
        code, doc, size, tf = code[first], doc[first], size[first], np.add.reduceat(tf, first)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_size))
        start = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        ends = np.append(start, len(code))
        postings = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(doc, pa.int64())), pa.array(part)], names=["doc_id", "part"])
        return pa.table({
            "shard": pa.array(np.full(len(start), table.column("shard")[0].as_py()), pa.int32()), "term": coded.dictionary.take(pa.array(code[start], pa.int64())), "n": pa.array(np.diff(ends), pa.int64()),
            "most": pa.array(np.maximum.reduceat(part, start)), "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings),
        })

    return lists


def asked_terms(queries: DataFrame, analyse: Callable[[Column], Column] = plain_terms) -> DataFrame:
    """(query_id, term): the distinct terms of ``queries`` (query_id, text)."""
    return queries.select("query_id", F.explode(analyse(F.col("text"))).alias("term")).distinct()


class _Question(NamedTuple):
    query_id: object
    terms: list[str]
    idf: list[float]
    least: float


def _best_of_shard(questions: list[_Question], lists: dict[str, tuple[np.ndarray, np.ndarray, float]], ids: np.ndarray, k: int) -> Iterator[tuple[object, object, float]]:
    """(query_id, doc_id, score) of each question's ``k`` best documents; ``lists``: places in ``ids``, parts and the largest part by term."""
    for question in questions:
        mine = sorted((idf * lists[term][2], idf, term) for term, idf in zip(question.terms, question.idf, strict=True) if term in lists)
        spared, at = 0.0, 0
        while at < len(mine) and spared + mine[at][0] < question.least:
            spared += mine[at][0]
            at += 1
        if at == len(mine):
            continue
        scores = np.zeros(len(ids))
        for _, idf, term in mine[at:]:
            places, parts, _ = lists[term]
            scores[places] += idf * parts
        able = (scores > 0) & (scores + spared >= question.least)
        if not able.any():
            continue
        for _, idf, term in mine[:at]:
            places, parts, _ = lists[term]
            scores[places] += idf * parts
        able = np.flatnonzero(able)
        found = np.round(scores[able], 6)
        if len(able) > k:
            near = found >= np.partition(found, len(found) - k)[len(found) - k]
            able, found = able[near], found[near]
        for score, place in sorted(zip((-found).tolist(), able.tolist(), strict=True))[:k]:
            yield question.query_id, ids[place], -score


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search_index(queries: DataFrame, index: KeywordIndex, k: int, analyse: Callable[[Column], Column] = plain_terms) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of the index for ``queries`` (query_id, text), by BM25.

    Scores are rounded to 6 digits before they are ranked; ties go by doc_id.
    Documents without any of a query's terms are not found.  Queries are sent to
    the tasks, ``_SENT_QUERIES`` of them at a time.
    """
    known = index.totals.first()
    n_docs = F.lit(known["n_docs"])
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked_terms(queries, analyse).join(index.terms, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("terms"))
    weighed = kept(weighed, "asked")
    n = max(1, -(-weighed.count() // _SENT_QUERIES))
    kinds = {name: kind for name, kind in (*queries.select("query_id").dtypes, ("doc_id", index.lists.schema["postings"].dataType.elementType["doc_id"].dataType.simpleString()))}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"

    def searched(rows: list, least: dict, lists: DataFrame) -> DataFrame:
        questions = queries.sparkSession.sparkContext.broadcast([_Question(row["query_id"], [t["term"] for t in row["terms"]], [t["idf"] for t in row["terms"]], least.get(row["query_id"], 0.0)) for row in rows])
        terms = queries.sparkSession.createDataFrame([(term,) for term in {t["term"] for row in rows for t in row["terms"]}], "term string")

        def shard(table: pa.Table) -> pa.Table:
            postings = table.column("postings").combine_chunks()
            every = postings.flatten()
            coded = every.field("doc_id").dictionary_encode()
            names = np.array(coded.dictionary.to_pylist(), object)
            order = np.argsort(names, kind="stable")
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            ids, place = names[order], turn[coded.indices.to_numpy(zero_copy_only=False)]
            parts, ends = every.field("part").to_numpy(), np.cumsum([0, *postings.value_lengths().to_pylist()])
            known = {term: (place[a:b], parts[a:b], most) for term, most, a, b in zip(table.column("term").to_pylist(), table.column("most").to_pylist(), ends[:-1], ends[1:], strict=True)}
            found = list(_best_of_shard(questions.value, known, ids, k))
            return pa.table([pa.array([row[j] for row in found], kind) for j, kind in enumerate(kinds_of)], names=["query_id", "doc_id", "score"])

        read = lists.join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "most", "postings")
        return read.groupBy("shard").applyInArrow(shard, schema)

    kinds_of = [field.type for field in to_arrow_schema(StructType.fromDDL(schema))]
    hits = None
    for at in range(n):
        rows = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == at).collect()  # bounded by ``_SENT_QUERIES``, about
        if not rows:
            continue
        lists, least, found = index.lists, {}, None
        if known["shards"] >= FIRST_SHARDS:
            first = F.col("shard") % FIRST_SHARDS == 0
            found = kept(_best(searched(rows, {}, lists.where(first)), k), "first_hits")
            least = {row["query_id"]: row["least"] - _SLACK for row in found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect()}
            lists = lists.where(~first)
        more = searched(rows, least, lists)
        more = _best(more if found is None else more.unionByName(found.drop("rank")), k)
        hits = more if hits is None else hits.unionByName(more)
    return hits if hits is not None else queries.sparkSession.createDataFrame([], f"{schema}, rank int")
