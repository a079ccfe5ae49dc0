"""Phrases that occur more often than their parts suggest, found by hashed passes.

Phrases grow by a word in each pass.  While a pass counts phrases of one
length exactly, it counts those of the next length by hash bucket only; buckets
that are full enough become a bitmap of fixed size, and so do the frequent
phrases themselves.  The next pass counts a phrase exactly only if its bucket's
bit is set and both its shorter parts are frequent: what does not pass can't be
frequent, whatever collides with it.  Bitmaps are all that is broadcast; texts
are read once a pass and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_words import Words, buffer_of, chunks, table_of, words_of
from .common import checkpointed

#: Piece separators: . , ; : ! ? and line feed to carriage return.
_ENDS = table_of(lambda byte: byte in b".,;:!?\x0a\x0b\x0c\x0d")
_WORD_BYTES = table_of(lambda byte: byte not in b" \t") & ~_ENDS
#: A bucket for so many bytes of text, within these numbers of buckets (as powers of two); the largest bitmap has 16 MB.
_BYTES_PER_BUCKET, _LEAST_BITS, _MOST_BITS = 16, 20, 27
#: Bytes of text that are looked at together: several arrays hold a number for each word of them.
_CHUNK_BYTES = 1 << 20
#: Bytes of a batch that are copied at once, about: a language's texts among them stand together.
_COPIED_BYTES = 1 << 23
#: Occurrences by bucket, and bytes of counted phrases, that a task gathers before it hands them on.
_HELD_BUCKETS, _HELD_BYTES = 1_000_000, 1 << 22
#: Rows of the last ranking that one task sorts, about.
_ROWS_PER_RANKING = 50_000
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of longer phrases from those of a first part and the next word."""
    x = (left * _ODD[0]) ^ (right * _ODD[1] + _ODD[2])
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes that passes give the phrases; each word of a batch is hashed once."""
    names = langs.dictionary_encode()
    found = np.array([_lang_hash(lang) for lang in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
    data, offsets = buffer_of(phrases)
    words = words_of(data, offsets, _WORD_BYTES)
    after, n_words = words.hashes[words.code], np.bincount(words.text, minlength=len(phrases))
    first = np.cumsum(n_words) - n_words
    for k in range(max(n_words, default=0)):
        on = np.flatnonzero(n_words > k)
        found[on] = _mixed(found[on], after[first[on] + k])
    return found


class Bits:
    """A set of buckets as a bitmap."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = hashes & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bitmap(buckets: DataFrame, bits: int) -> Bits:
    """The bitmap of a column ``bucket``; at most ``2 ** bits`` bits reach the driver."""
    packed = buckets.groupBy(F.shiftright("bucket", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("word")).toArrow()
    words = np.zeros(max(1, 2**bits // 64), np.uint64)
    words[packed.column("at").to_numpy()] = packed.column("word").to_numpy().astype(np.uint64)
    return Bits(words)


def _frequent_bits(found: DataFrame, bits: int) -> Bits:
    """The bitmap of exact phrases (lang, phrase)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = phrase_hashes(*batch.columns) & np.uint64(2**bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64))], ["bucket"])

    return _bitmap(found.select("lang", "phrase").mapInArrow(hashed, "bucket long"), bits)


class _Buckets:
    """Occurrences by bucket of a task, handed on now and then."""

    def __init__(self, bits: int):
        self._mask, self._type, self._held, self._size = np.uint64(2**bits - 1), np.uint32 if bits <= 32 else np.uint64, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._held.append((hashes & self._mask).astype(self._type))
        self._size += len(hashes)
        if self._size > _HELD_BUCKETS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        held = np.concatenate([np.zeros(0, self._type), *self._held])
        self._held, self._size = [], 0
        held.sort()
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])[: len(held)])
        bucket, n = held[first], np.diff(np.append(first, len(held)))
        for k in range(0, len(bucket), 50_000):
            part = pa.array(bucket[k : k + 50_000].astype(np.int64))
            yield _rows(pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.string()), part, n[k : k + 50_000])


class _Phrases:
    """Exact counts of a task's phrases, handed on now and then; null is all words of a language."""

    def __init__(self):
        self._held, self._size = [], 0

    def add(self, lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._held.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "n"]))
        self._size += self._held[-1].nbytes
        if self._size > _HELD_BYTES:
            self._merge()
            if self._size > _HELD_BYTES // 2:
                yield from self.rest()

    def _merge(self) -> None:
        if self._held:
            summed = pa.Table.from_batches(self._held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            self._held = summed.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches()
            self._size = summed.nbytes

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for batch in self._held:
            for k in range(0, len(batch), 50_000):
                lang, phrase, n = batch.slice(k, 50_000).columns
                yield _rows(lang, phrase, pa.nulls(len(n), pa.int64()), n)
        self._held, self._size = [], 0


_COUNTED = "lang string, phrase string, bucket long, n long"


def _rows(lang: pa.Array, phrase: pa.Array, bucket: pa.Array, n: Iterable[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, bucket, pa.array(n, pa.int64())], names=["lang", "phrase", "bucket", "n"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_rows = max(1, len(batch) * _COPIED_BYTES // max(1, batch.nbytes))
        yield from (batch.slice(at, n_rows) for at in range(0, len(batch), n_rows))


def _counts(words: Words, at: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of ``length`` words that begin at the words ``at``, and how often each does."""
    code, most = words.code[at], len(words.distinct)
    for n in range(1, length):
        if most > 2**62 // len(words.distinct):
            found, code = np.unique(code, return_inverse=True)
            most = len(found)
        code, most = code * len(words.distinct) + words.code[at + n], most * len(words.distinct)
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    names, own = pa.array(words.distinct, pa.string()), at[first]
    parts = [names.take(pa.array(words.code[own + n])) for n in range(length)]
    return pc.binary_join_element_wise(*parts, " "), times


def _pass(length: int, last: bool, bits: int, shorter: Bits | None, full: Bits | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact counts of the phrases of ``length`` words that can be frequent, and, but for the last pass, bucket counts of those one word longer.

    A phrase can be if both its parts of one word less are in ``shorter`` and its bucket is in ``full``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, phrases = _Buckets(bits), _Phrases()
        for batch in _parts(batches):
            langs = batch.column("lang").dictionary_encode()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = buffer_of(batch.column("text").filter(pa.array(langs.indices.to_numpy() == number)))
                for _, begin, bounds in chunks(data, offsets, _ENDS, _CHUNK_BYTES):
                    part = data[begin : begin + int(bounds[-1])]
                    words = words_of(part, bounds, _WORD_BYTES)
                    if not len(words.code):
                        continue
                    # A piece's number rises with each separator and each text.
                    piece = np.cumsum(_ENDS[part])[words.start] + words.text * (len(part) + 1)
                    # By first word: the hashes of phrases of so many words, up to ``length``.
                    after = words.hashes[words.code]
                    parts, made = None, _mixed(np.full(len(words.hashes), _lang_hash(lang)), words.hashes)[words.code]
                    for n in range(1, length):
                        parts, made = made, _mixed(made[:-1], after[n:])
                    may = piece[: len(made)] == piece[length - 1 :]
                    if parts is not None:
                        frequent = shorter(parts)
                        at = np.flatnonzero(may & frequent[:-1] & frequent[1:])
                        may = np.zeros(len(made), bool)
                        may[at[full(made[at])]] = True
                    yield from phrases.add(lang, *_counts(words, np.flatnonzero(may), length))
                    if length == 1:
                        yield from phrases.add(lang, pa.nulls(1, pa.string()), [len(words.code)])
                    if not last:
                        on = may[:-1] & may[1:] & (piece[: len(made) - 1] == piece[length:])
                        yield from buckets.add(_mixed(made[:-1], after[length:])[on])
        yield from phrases.rest()
        yield from buckets.rest()

    return counted


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, bucket_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times, (lang, n) of all words).

    ``docs`` has (lang, text), neither null.  ``2 ** bucket_bits`` buckets are
    a broadcast bitmap of an eighth as many bytes.  Their number grows with the
    texts, up to a bound, so that about as many of them are empty at every size;
    the result does not depend on it.

    Defined cases: as in ``collocations``.
    """
    if bucket_bits is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bucket_bits = min(_MOST_BITS, max(_LEAST_BITS, (size // _BYTES_PER_BUCKET).bit_length()))
    shorter = full = totals = None
    found = []
    for length in range(1, longest + 1):
        rows = docs.select("lang", "text").mapInArrow(_pass(length, length == longest, bucket_bits, shorter, full), _COUNTED)
        summed = checkpointed(rows.groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull() & F.col("bucket").isNull()))
        found.append(summed.where("phrase is not null").select("lang", "phrase", "n"))
        if length == 1:
            totals = summed.where("phrase is null and bucket is null").select("lang", "n")
        if length < longest:
            shorter, full = _frequent_bits(found[-1], bucket_bits), _bitmap(summed.where("bucket is not null"), bucket_bits)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, totals


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, best: int = 2000, bucket_bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    ``docs`` has (text, lang) and any further columns, which are not read.  ``a``
    is how often the phrase occurs, ``l`` and ``r`` how often its parts do at the cut
    that scores lowest, ``n`` the language's words; the score is a * a / (l * r) in whole
    millionths.  A phrase is dropped if a longer frequent one that holds it
    occurs at least half as often.

    Defined cases: null texts are empty, a null lang is ``und``; a text or piece
    without words counts for nothing; equal scores of cuts go to the earlier
    cut, equal phrases to the more frequent one and then by bytes; repeated rows
    count one by one; a very long text is read in parts; an empty table gives no
    rows.
    """
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every, totals = frequent_phrases(named, least, longest, bucket_bits)
    candidates = every.withColumn("words", F.split("phrase", " ", -1)).where(F.size("words") > 1).withColumnRenamed("n", "a")
    cut = "explode(transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') as left, array_join(slice(words, k + 1, size(words)), ' ') as right)))"
    cuts = candidates.select("lang", "phrase", "a", F.expr(cut).alias("cut")).select("lang", "phrase", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(every.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("lowest")).select("lang", "phrase", "a", "lowest.score", "lowest.l", "lowest.r")
    held = "explode(flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' ')))))"
    inside = candidates.where(F.size("words") > 2).select("lang", "a", F.expr(held).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = checkpointed(lowest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True))).drop("longer"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    parts = max(1, kept.count() // _ROWS_PER_RANKING)
    few = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
