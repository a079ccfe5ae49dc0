"""Models behind two narrow interfaces, called in Arrow batches, with offline stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: So many rows of vectors, and of replies, are handed on at once.
_HANDED_ROWS, _ASKED_ROWS = 1024, 128


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    """Scores texts against queries; ``keywords`` are what else is known of a text, such as its section."""

    def score(self, pairs: Sequence[tuple[str, str, Sequence[str]]]) -> list[float]: ...


class OverlapScorer:
    """The share of a query's distinct words that a text or its keywords have: deterministic, for tests and offline use."""

    def score(self, pairs: Sequence[tuple[str, str, Sequence[str]]]) -> list[float]:
        found = []
        for query, text, keywords in pairs:
            asked = set((query or "").lower().split())
            met = asked & set(" ".join([text or "", *(x or "" for x in keywords or ())]).lower().split())
            found.append(len(met) / len(asked) if asked else 0.0)
        return found


class Completion(NamedTuple):
    """A reply with what a service says about it."""

    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    finish_reason: str | None = None


class ChatModel(Protocol):
    """``complete`` may take further columns of the row by their names, such as ``run`` or ``temperature``."""

    def complete(self, prompt: str) -> str | Completion: ...


class Roles(NamedTuple):
    """The identities of the three models: who answers, who writes the ground truth and who judges; they differ, in any case of letters."""

    answer: str
    author: str
    judge: str

    def checked(self) -> Roles:
        if len({name.strip().lower() for name in self}) < 3:
            raise ValueError(f"answer, author and judge must be three models, not {', '.join(self)}")
        return self


@lru_cache(maxsize=1 << 16)
def _hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


class HashingEmbedder:
    """Words hashed into a vector of length 1: deterministic, and alike for texts with common words."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        words = [(text or "").lower().split() for text in texts]
        place = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        bins = np.fromiter((_hash(word) % self.dimensions for w in words for word in w), np.int64, len(place))
        rows = np.bincount(place * self.dimensions + bins, minlength=len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return (rows / np.where(norms < 1e-12, 1, norms)).tolist()


def score_pairs(rows: DataFrame, make: Callable[[], PairScorer], batch: int = 64) -> DataFrame:
    """``rows`` (query_text, text, keywords, ...) with ``rescore``; ``make`` builds the scorer once for each task, which gets ``batch`` pairs at a time.

    A batch that fails is halved until the pair that fails is alone; it has no
    score then, and no row is lost.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for part in batches:
            pairs = list(zip(*(part.column(c).to_pylist() for c in ("query_text", "text", "keywords")), strict=True))
            found = [value for at in range(0, len(pairs), batch) for value, _ in _halved(pairs[at : at + batch], scorer.score)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, "rescore"])

    return rows.mapInArrow(scored, T.StructType([*rows.schema, T.StructField("rescore", T.DoubleType())]))


def _halved(items: list, ask: Callable[[list], list], retries: int = 1) -> list[tuple[object, str | None]]:
    """(answer, error) of each item: a batch that fails is asked again as its halves, a single item so many times more."""
    if not items:
        return []
    for left in reversed(range(retries + 1 if len(items) == 1 else 1)):
        try:
            answers = ask(items)
            if len(answers) != len(items):
                raise ValueError(f"{len(answers)} answers to {len(items)} texts")
            return [(answer, None) for answer in answers]
        except Exception as failure:  # any failure of a model is a row's outcome
            if len(items) == 1 and not left:
                return [(None, f"{type(failure).__name__}: {failure}")]
    half = len(items) // 2
    return _halved(items[:half], ask, retries) + _halved(items[half:], ask, retries)


def _vectors(found: list) -> pa.Array:
    """Vectors as a column; those of one length go through one matrix, which is many times faster."""
    if len({None if vector is None else len(vector) for vector in found} | {None}) == 2 and None not in found:
        matrix = np.array(found, np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))
    return pa.array(found, pa.list_(pa.float64()))


def embed_column(rows: DataFrame, make: Callable[[], Embedder], column: str = "text", batch: int = 64, errors: bool = False) -> DataFrame:
    """``rows`` with ``embedding``; ``make`` builds the model once for each task, which gets ``batch`` texts at a time.

    A batch that fails is halved until the text that fails is alone and has
    failed again.  With ``errors`` such a row has no embedding and its
    ``embed_error``; without, its error is raised.  Rows that have an ``embedding`` column keep it: what was embedded before is not asked for again.
    """
    if "embedding" in rows.columns:
        return rows.withColumn("embed_error", F.lit(None).cast("string")) if errors and "embed_error" not in rows.columns else rows

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in batches:
            for start in range(0, part.num_rows, _HANDED_ROWS):
                piece = part.slice(start, _HANDED_ROWS)
                vectors, failures = [], []
                for at in range(0, piece.num_rows, batch):
                    found = _halved([x or "" for x in piece.column(column).slice(at, batch).to_pylist()], model.embed)
                    if not errors and any(error for _, error in found):
                        raise RuntimeError(next(error for _, error in found if error))
                    vectors.append(_vectors([vector for vector, _ in found]))
                    failures += [error for _, error in found]
                more = [pa.concat_arrays(vectors)] + [pa.array(failures, pa.string())] * errors
                yield pa.RecordBatch.from_arrays([*piece.columns, *more], names=[*piece.schema.names, *added])

    added = ["embedding"] + ["embed_error"] * errors
    fields = [T.StructField("embedding", T.ArrayType(T.DoubleType()))] + [T.StructField("embed_error", T.StringType())] * errors
    return rows.mapInArrow(embedded, T.StructType([*rows.schema, *fields]))


_COMPLETED = [("reply", T.StringType(), pa.string()), ("error", T.StringType(), pa.string()), ("prompt_tokens", T.LongType(), pa.int64()), ("completion_tokens", T.LongType(), pa.int64()), ("finish_reason", T.StringType(), pa.string()), ("latency_ms", T.DoubleType(), pa.float64())]


def complete_column(rows: DataFrame, make: Callable[[], ChatModel], column: str = "prompt", options: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``reply``, ``error`` and what the model says of the completion: what fails has an error and no reply, and no row is lost.

    A row without a prompt is not asked for and has neither.  ``options`` are
    columns that the model is given by name.  A replay after a lost executor
    asks the model again; write the result before it is used twice.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in (batch.slice(at, _ASKED_ROWS) for batch in batches for at in range(0, batch.num_rows, _ASKED_ROWS)):
            given = zip(part.column(column).to_pylist(), *(part.column(c).to_pylist() for c in options), strict=True)
            found = []
            for prompt, *values in given:
                began = time.perf_counter()
                said, error = Completion(None), None
                if prompt is not None:
                    try:
                        reply = model.complete(prompt, **dict(zip(options, values, strict=True)))
                        said = reply if isinstance(reply, Completion) else Completion(reply)
                    except Exception as failure:  # any failure of a model is a row's outcome
                        error = f"{type(failure).__name__}: {failure}"
                found.append((said.text, error, said.prompt_tokens, said.completion_tokens, said.finish_reason, (time.perf_counter() - began) * 1000))
            columns = [pa.array([f[k] for f in found], kind) for k, (_, _, kind) in enumerate(_COMPLETED)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(name for name, _, _ in _COMPLETED)])

    kept = rows.drop(*(name for name, _, _ in _COMPLETED))
    return kept.mapInArrow(asked, T.StructType([*kept.schema, *(T.StructField(name, kind) for name, kind, _ in _COMPLETED)]))
