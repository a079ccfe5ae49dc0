"""Toxicity scores from the nearest labelled examples.

A bounded sample of labelled texts becomes an inverted index of TF-IDF
vectors.  Terms are words and their first 3 to 6 characters, and pieces of
words that are very long or of scripts written without spaces; those whose
presence is associated with the label (log-likelihood ratio) are kept, so that
cosines compare what matters.  Examples stand in blocks; for each term and
block the index has the largest weight.  A query adds these maxima up to an
upper bound for each block, visits blocks in falling order of their bounds and
stops when no other block can hold a nearer example: the neighbours are exactly
those of a full scan.

Neighbours vote with weight similarity / (distance + 0.05) and with the weight
of their class, which undoes the even sampling of classes; a small prior vote
keeps distant neighbours from deciding alone.  The share of toxic votes becomes
a probability by a rising map that is fitted on the examples themselves, each
judged by the others only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, whole_row

_WORD = re.compile(r"\w+")
#: Longer words count as their pieces of so many characters.
_WORD_CHARS, _PIECE = 40, 6
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters: a run of them has no spaces and counts as its pairs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_PREFIXES = (3, 4, 5, 6)
_BLOCK = 64
_PRIOR_VOTE = 0.1
#: Words whose terms a worker keeps.
_KNOWN_WORDS = 50_000


def _cut_up(word: str) -> bool:
    return len(word) > _WORD_CHARS or (not word.isascii() and _UNSPACED.search(word) is not None)


def word_terms(word: str) -> Iterable[str]:
    """The terms of a lower-case word: itself, and its beginnings with a star; the pieces of a word that is cut up."""
    if _cut_up(word):
        n = 2 if _UNSPACED.search(word) else _PIECE
        return (word[k : k + n] for k in range(max(1, len(word) - n + 1)))
    return (word, *(word[:n] + "*" for n in _PREFIXES if len(word) > n))


def term_counts(text: str | None) -> Counter[str]:
    """How often each term is in ``text``."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for term in word_terms(word):
            counts[term] += n
    return counts


class Examples:
    """Block-max inverted index of labelled examples, and the votes of the nearest ones."""

    def __init__(self, ids: list[int], toxic: list[int], class_weight: tuple[float, float], terms: list[tuple[str, float]], postings: np.ndarray, neighbours: int = 15):
        """``terms``: (term, idf); ``postings``: rows of (example's place in ``ids``, term's place in ``terms``, count)."""
        self.neighbours, self.class_weight = neighbours, class_weight
        self.term_ids = {term: k for k, (term, _) in enumerate(terms)}
        self.beginnings = {term[: _PREFIXES[0]] for term, _ in terms}
        self.idf = np.array([idf for _, idf in terms], float)
        found = np.asarray(postings, np.int64).reshape(-1, 3)
        weight = (1 + np.log(found[:, 2])) * self.idf[found[:, 1]]
        norm = np.sqrt(np.bincount(found[:, 0], weight**2, len(ids)))
        weight = weight / norm[found[:, 0]]
        # Alike examples stand together: in order of their heaviest term.
        heaviest = np.full(len(ids), len(terms), np.int64)
        rising = np.argsort(weight, kind="stable")
        heaviest[found[rising, 0]] = found[rising, 1]
        order = np.lexsort((np.arange(len(ids)), heaviest))
        order = order[heaviest[order] < len(terms)]
        place = np.full(len(ids), -1, np.int64)
        place[order] = np.arange(len(order))
        self.ids = [ids[k] for k in order]
        self.place = {doc_id: at for at, doc_id in enumerate(self.ids)}
        self.toxic = np.array([toxic[k] for k in order], float)
        self.vote = np.where(self.toxic > 0, class_weight[1], class_weight[0])
        slot = place[found[:, 0]]
        by_block = np.lexsort((found[:, 1], slot // _BLOCK))
        slot, term, weight = slot[by_block], found[by_block, 1], weight[by_block]
        self.blocks = -(-len(order) // _BLOCK)
        self.starts = np.searchsorted(slot // _BLOCK, np.arange(self.blocks + 1))
        self.slot, self.term, self.weight = slot % _BLOCK, term, weight
        # The largest weight of each (term, block), term by term.
        pair, inverse = np.unique(term * max(1, self.blocks) + slot // _BLOCK, return_inverse=True)
        highest = np.zeros(len(pair))
        np.maximum.at(highest, inverse, weight)
        self.max_block, self.max_weight = pair % max(1, self.blocks), highest
        self.max_starts = np.searchsorted(pair // max(1, self.blocks), np.arange(len(terms) + 1))
        # Examples without any term say what such a text is.
        bare = [(class_weight[toxic[k]], toxic[k]) for k in range(len(ids)) if heaviest[k] == len(terms)]
        everyone = sum(class_weight[y] for y in toxic)
        self.base = sum(class_weight[y] for y in toxic if y) / everyone if everyone else 0.0
        self.bare_score = (sum(w for w, y in bare if y) + _PRIOR_VOTE * self.base) / (sum(w for w, _ in bare) + _PRIOR_VOTE)
        self._known: dict[str, tuple[int, ...]] = {}
        #: The calibration's raw votes and probabilities, both rising; without any, votes are the score.
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fit the map from votes to probabilities: isotonic regression with the class weights, straight between its steps."""
        weight = np.where(toxic > 0, *reversed(self.class_weight))
        order = np.argsort(votes, kind="stable")
        steps: list[list[float]] = []
        for x, y, w in zip(votes[order].tolist(), toxic[order].tolist(), weight[order].tolist(), strict=True):
            steps.append([x * w, y * w, w])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
        if len(steps) > 1:
            x, y, w = np.array(steps).T
            self.curve = (np.concatenate([[0.0], x / w, [1.0]]), np.concatenate([[0.0], y / w, [1.0]]))

    def probability(self, votes: float) -> float:
        return float(np.interp(votes, *self.curve))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the text's terms and their weights, of length 1."""
        counts: dict[int, int] = {}
        known, ids, beginnings = self._known, self.term_ids, self.beginnings
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            # Most words begin as no term does; only others need a second look.
            if word[: _PREFIXES[0]] not in beginnings and len(word) <= _WORD_CHARS and word.isascii():
                continue
            found = known.get(word)
            if found is None:
                found = tuple(ids[t] for t in word_terms(word) if t in ids)
                if len(word) <= _WORD_CHARS:
                    if len(known) >= _KNOWN_WORDS:
                        known.clear()
                    known[word] = found
            for k in found:
                counts[k] = counts.get(k, 0) + n
        terms = np.array(sorted(counts), np.int64)
        weights = (1 + np.log(np.array([counts[k] for k in terms.tolist()], float))) * self.idf[terms]
        return terms, weights / (np.sqrt((weights**2).sum()) or 1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> list[tuple[float, int]]:
        """(similarity, place) of the nearest examples with a term in common, nearest first, then by place; the example with the id ``without`` is none."""
        bounds = np.zeros(self.blocks)
        for k, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.max_starts[k], self.max_starts[k + 1]
            bounds[self.max_block[a:b]] += w * self.max_weight[a:b]
        query = np.zeros(len(self.idf))
        query[terms] = weights
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or len(best) == self.neighbours and bounds[block] < -best[-1][0] - 1e-12:
                break
            a, b = self.starts[block], self.starts[block + 1]
            similar = np.bincount(self.slot[a:b], query[self.term[a:b]] * self.weight[a:b], _BLOCK)
            if without is not None and without // _BLOCK == block:
                similar[without % _BLOCK] = 0
            near = similar > 0 if len(best) < self.neighbours else similar >= -best[-1][0]
            if near.any():
                best += [(-float(similar[k]), block * _BLOCK + k) for k in np.flatnonzero(near).tolist()]
                best = sorted(best)[: self.neighbours]
        return [(-s, k) for s, k in best]

    def votes(self, text: str | None, own_id: int | None = None) -> tuple[float, list[tuple[int, float, int]]]:
        """The share of toxic votes, and the neighbours as (id, similarity, toxic); the example ``own_id`` has no vote."""
        terms, weights = self.vector(text)
        if not len(terms):
            return self.bare_score, []
        near = self.nearest(terms, weights, self.place.get(own_id) if own_id is not None else None)
        yes, all_ = _PRIOR_VOTE * self.base, _PRIOR_VOTE
        for similarity, k in near:
            vote = similarity / (max(0.0, 1 - similarity) + 0.05) * self.vote[k]
            yes, all_ = yes + vote * self.toxic[k], all_ + vote
        return float(yes / all_), [(self.ids[k], float(s), int(self.toxic[k])) for s, k in near]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """The calibrated score, and the neighbours."""
        votes, near = self.votes(text)
        return self.probability(votes), near


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
            counts = term_counts(text)
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([toxic] * n, pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["doc_id", "toxic", "term", "n"])


def _association(toxic: Column, clean: Column, of_toxic: int, of_clean: int) -> Column:
    """The log-likelihood ratio of a term's presence and the label."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    share = (toxic + clean) / F.lit(float(of_toxic + of_clean))
    return 2 * sum(
        (part(seen, share * of) + part(of - seen, (1 - share) * of) for seen, of in ((toxic, of_toxic), (clean, of_clean))),
        F.lit(0.0),
    )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, least_association: float = 15.0, most_terms: int = 20_000, neighbours: int = 15, seed: int = 5) -> Examples:
    """The index of at most ``per_class`` labelled examples of each class.

    ``docs`` has (doc_id, text), ``labels`` (doc_id, toxic 0/1); other labels
    and labels without a document are left out, of several labels the highest
    holds, of several texts the last in order.  ``per_class`` bounds what
    is sampled, in the order of a seeded hash; at most ``most_terms`` terms, the
    most associated ones (of those with a ratio of ``least_association``), are
    kept.  Everything that reaches the driver is bounded by these two.  The map
    from votes to probabilities is fitted with each example left out in turn.

    Defined cases: null and empty texts are examples without terms; with labels
    of one class only, no term is associated and all texts have the score of
    that class; without labels all score 0.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    of = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), "doc_id")
    sampled = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = checkpointed(sampled[0].unionByName(sampled[1]))
    examples = checkpointed(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))
    rows = sorted((row["doc_id"], row["toxic"]) for row in examples.select("doc_id", "toxic").collect())
    ids, toxic = [r[0] for r in rows], [r[1] for r in rows]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    whole = sum(of.values())
    class_weight = tuple((of.get(y, 0) / whole) / (n / len(rows)) if n else 1.0 for y, n in ((0, n0), (1, n1)))
    occurrences = examples.mapInArrow(_example_terms, "doc_id long, toxic int, term string, n long")
    stats = occurrences.groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("yes"))
    rated = stats.withColumn("association", _association(F.col("yes"), F.col("df") - F.col("yes"), n1, n0)) if n0 and n1 else stats.where("false").withColumn("association", F.lit(0.0))
    terms = [(row["term"], row["df"]) for row in rated.where(F.col("association") >= least_association).orderBy(F.desc("association"), "term").limit(most_terms).collect()]
    table = spark.createDataFrame([(term, k) for k, (term, _) in enumerate(terms)], "term string, place long")
    postings = np.zeros((0, 3), np.int64)
    if terms:
        found = occurrences.join(F.broadcast(table), "term").select("doc_id", "place", "n").toArrow()
        postings = np.stack([found.column(c).to_numpy() for c in ("doc_id", "place", "n")], axis=1)
        postings[:, 0] = np.searchsorted(np.array(ids, np.int64), postings[:, 0])
        postings = postings[np.lexsort(postings.T[::-1])]
    model = Examples(ids, toxic, class_weight, [(term, float(np.log(1 + len(rows) / df))) for term, df in terms], postings, neighbours)
    if n0 and n1:
        shared = spark.sparkContext.broadcast(model)

        @F.arrow_udf("double")
        def left_out(own: pa.Array, texts: pa.Array) -> pa.Array:
            return pa.array([shared.value.votes(text, i)[0] for i, text in zip(own.to_pylist(), texts.to_pylist(), strict=True)], pa.float64())

        judged = examples.select("doc_id", "toxic", left_out("doc_id", "text").alias("votes")).collect()
        shared.destroy()
        judged.sort(key=lambda row: (row["votes"], row["doc_id"]))
        model.calibrate(np.array([row["votes"] for row in judged]), np.array([float(row["toxic"]) for row in judged]))
    return model


def score_toxicity(docs: DataFrame, model: Examples) -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (replacing columns of these names).

    ``docs`` has a column text and any others.  ``score`` (0 to 1) is the
    calibrated share of toxic votes among the nearest examples; ``evidence``
    lists them as (doc_id, similarity, toxic), nearest first.

    Defined cases: null and empty texts, and texts without a term of the
    index, have no neighbours and the score of the examples without such terms;
    equal texts get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, evidence: array<struct<doc_id: long, similarity: double, toxic: int>>>")
    def judged(texts: pa.Array) -> pa.Array:
        scores, ends, ids, similarities, toxic = [], [0], [], [], []
        for text in texts:
            score, near = shared.value.score(text.as_py())
            scores.append(score)
            for doc_id, similarity, label in near:
                ids.append(doc_id)
                similarities.append(similarity)
                toxic.append(label)
            ends.append(len(ids))
        entries = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(similarities, pa.float64()), pa.array(toxic, pa.int32())], names=["doc_id", "similarity", "toxic"])
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=["score", "evidence"])

    found = docs.drop("score", "evidence").withColumn("__judged", judged("text"))
    return found.withColumns({"score": F.col("__judged.score"), "evidence": F.col("__judged.evidence")}).drop("__judged")


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 4, is 2 (never for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """``labels`` without the held-out rows."""
    return labels.where(~held_out(F.col("doc_id")))


def drop_toxic(docs: DataFrame, model: Examples, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns, of whatever names, are kept as they are.

    Defined cases: as in ``score_toxicity``; equal rows go or stay together, and
    an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(text.as_py())[0] for text in texts], pa.float64())

    rows = docs.select(scored("text").alias("score"), whole_row(docs).alias("row"))
    return rows.where(F.col("score") < threshold).select("row.*")
