"""From paragraphs to sentences, section paths, packed chunks and spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.sinks import kept

#: Layout roles that are no content.
NOISE_ROLES = ("pageHeader", "pageFooter", "pageNumber", "footnote")


_SENTENCE = re.compile(T.SENTENCE)
#: What is trimmed from sentences.
_SPACE = " \t\n\x0b\f\r"
#: So many rows of a batch are taken apart at once.
_ROWS = 64


def sentence_spans(text: str | None) -> list[dict]:
    """The sentences of a text as (text, char_start, char_end): trimmed, never blank, in order."""
    found = []
    for match in _SENTENCE.finditer(text or ""):
        sentence = match[0].strip(_SPACE)
        if sentence:
            start = match.start() + len(match[0]) - len(match[0].lstrip(_SPACE))
            found.append({"text": sentence, "char_start": start, "char_end": start + len(sentence)})
    return found


def with_sentences(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``sentences``: array<struct<text, char_start, char_end>> of its text; every text is split within its row."""

    @F.arrow_udf("array<struct<text: string, char_start: int, char_end: int>>")
    def split(texts: pa.Array) -> pa.Array:
        return _sliced(_split, texts)

    return docs.withColumn("sentences", split(column))


def _sliced(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """What ``work`` makes of the columns, a few rows at a time: of a batch only Arrow's own memory is held whole."""
    parts = [work(*(column.slice(at, _ROWS) for column in columns)) for at in range(0, max(1, len(columns[0])), _ROWS)]
    return pa.concat_arrays(parts)


def _split(texts: pa.Array) -> pa.Array:
    found, starts, ends = [], [], [0]
    for text in texts.to_pylist():
        for match in _SENTENCE.finditer(text or ""):
            raw = match[0]
            if sentence := raw.strip(_SPACE):
                found.append(sentence)
                starts.append(match.start() + len(raw) - len(raw.lstrip(_SPACE)))
        ends.append(len(found))
    stops = [start + len(sentence) for start, sentence in zip(starts, found, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["text", "char_start", "char_end"]))


def split_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, text, char_start, char_end) of ``docs`` (doc_id, text).

    Sentences are trimmed and never blank; offsets count code points from 0 and
    cut exactly the sentence out of the text; numbers have no gaps.  Null and
    blank texts have none.
    """
    # Without "outer" a test of the list goes before the rows are taken out of it, which splits every text once more.
    rows = with_sentences(docs.select("doc_id", "text")).select("doc_id", F.posexplode_outer("sentences").alias("sentence_no", "s"))
    return rows.where("sentence_no is not null").select("doc_id", "sentence_no", "s.text", "s.char_start", "s.char_end")


def breadcrumbs(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` (doc_id, para_no, role, content) that have content, with ``section_path``.

    Titles add up over the document, joined by " — "; a title ends the heading
    before it, a heading replaces it; noise roles are left out.
    """
    kept = paragraphs.where("(role is null or role not in ({})) and trim(coalesce(content, '')) <> ''".format(", ".join(f"'{r}'" for r in NOISE_ROLES)))
    so_far = Window.partitionBy("doc_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.array_join(F.collect_list(F.when(F.col("role") == "title", F.col("content"))).over(so_far), " — ")
    counted = kept.withColumn("part", F.count(F.when(F.col("role") == "title", 1)).over(so_far)).withColumn("title", title)
    within = Window.partitionBy("doc_id", "part").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("role") == "sectionHeading", F.col("content")), ignorenulls=True).over(within)
    path = F.filter(F.array(F.col("title"), F.coalesce(heading, F.lit(""))), lambda x: x != "")
    return counted.withColumn("section_path", path).drop("part", "title")


def pack(tokens: list[int], sections: list[str | None], target: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) sentence of each chunk.

    A chunk ends before a sentence that would exceed ``target`` or stands in
    another section.  After an overflow the next chunk starts with the last
    sentences again: at least one, then more until ``overlap`` is reached, never
    beyond it.
    """
    chunks, first, size = [], 0, 0
    for at, n in enumerate(tokens):
        if at > first or size:
            moved = sections[at] != sections[at - 1]
            if moved or size + n > target:
                chunks.append((first, at - 1))
                start, size = at, 0
                if not moved:
                    start, size = at - 1, tokens[at - 1]
                    while start > first and size < overlap and size + tokens[start - 1] <= overlap:
                        start -= 1
                        size += tokens[start]
                first = start
        size += n
    return [*chunks, (first, len(tokens) - 1)] if tokens else chunks


def pack_chunks(sentences: DataFrame, target_tokens: int = 400, overlap_tokens: int = 40, tokens: Callable[[Column], Column] = T.words) -> DataFrame:
    """(chunk_id, doc_id, chunk_no, page, section_path, text, token_count, n_sentences, sentences) from ``sentences``.

    ``sentences`` has (doc_id, sentence_no, text, section) with numbers from 0
    without gaps, and may have page and section_path, which a chunk has from its
    first sentence.  The text joins the sentences by a space, ``tokens`` counts
    within it, and offsets of the nested sentences are into it.  A document's
    sentences are gathered once; chunks are slices of them.
    """
    page = F.col("page").cast("int") if "page" in sentences.columns else F.lit(None).cast("int")
    path = F.col("section_path") if "section_path" in sentences.columns else F.array().cast("array<string>")
    row = F.struct("sentence_no", "text", page.alias("page"), path.alias("section_path"), tokens(F.col("text")).alias("n"), F.coalesce("section", F.lit("")).alias("section"))
    lists = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    own = _cut(lists, F.col("rows"), target_tokens, overlap_tokens).select("doc_id", "chunk_no", T.chunk_id(F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"), "rows")
    ends = F.aggregate("rows", F.array(F.lit(0)), lambda seen, s: F.concat(seen, F.array(F.element_at(seen, -1) + F.length(s["text"]) + 1)))
    nested = F.transform(
        "rows",
        lambda s, k: F.struct(
            T.sentence_id(F.col("doc_id"), s["sentence_no"]).alias("sentence_id"), s["sentence_no"].alias("sentence_no"), s["text"].alias("text"), s["page"].alias("page"), s["section_path"].alias("section_path"),
            F.get("ends", k).alias("char_start"), (F.get("ends", k) + F.length(s["text"])).alias("char_end"),
        ),
    )
    first = F.get("rows", F.lit(0))
    built = own.withColumn("ends", ends).select("chunk_id", "doc_id", "chunk_no", first["page"].alias("page"), first["section_path"].alias("section_path"), F.array_join("rows.text", " ").alias("text"), F.size("rows").alias("n_sentences"), nested.alias("sentences"))
    return built.withColumn("token_count", tokens(F.col("text")))


def chunk_numbers(docs: DataFrame, section: Callable[[Column], Column], target_tokens: int = 400, overlap_tokens: int = 40, tokens: Callable[[Column], Column] = T.words) -> DataFrame:
    """(doc_id, chunk_no, rows): the numbers of the sentences in each chunk of ``pack_chunks``, without its texts.

    ``docs`` has (doc_id, sentences) as ``with_sentences`` gives them; ``section``
    makes a sentence's section of its number.  A document's sentences stay
    within its row, and no text is shuffled; rows of one id make one document.
    """
    row = lambda s, k: F.struct(k.alias("sentence_no"), tokens(s["text"]).alias("n"), F.coalesce(section(k), F.lit("")).alias("section"))
    counted = docs.select("doc_id", F.transform("sentences", row).alias("rows"))
    lists = counted.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    return _cut(lists, F.col("rows.sentence_no"), target_tokens, overlap_tokens)


def _cut(lists: DataFrame, column: Column, target: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_no, rows): what of ``column``, a list beside each document's ``rows``, belongs to each chunk."""

    @F.arrow_udf("array<struct<first: int, last: int>>")
    def packed(tokens: pa.Array, sections: pa.Array) -> pa.Array:
        return _sliced(_packed(target, overlap), tokens, sections)

    # Only ``column`` is repeated for each chunk.
    needed = lists.select("doc_id", column.alias("rows"), F.col("rows.n").alias("n"), F.col("rows.section").alias("section"))
    chunks = needed.select("doc_id", "rows", F.posexplode(packed("n", "section")).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", "chunk_no", F.slice("rows", F.col("chunk.first") + 1, F.col("chunk.last") - F.col("chunk.first") + 1).alias("rows"))


def _packed(target: int, overlap: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def lists(tokens: pa.Array, sections: pa.Array) -> pa.Array:
        sizes = tokens.flatten().to_numpy().tolist()
        # Sections are only compared: numbers do for their names.
        names = sections.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).tolist()
        ends = [0, *accumulate(pc.fill_null(pc.list_value_length(tokens), 0).to_pylist())]
        found = [pack(sizes[a:b], names[a:b], target, overlap) for a, b in zip(ends, ends[1:])]
        firsts, lasts = (pa.array([pair[k] for pairs in found for pair in pairs], pa.int32()) for k in (0, 1))
        ends = list(accumulate((len(pairs) for pairs in found), initial=0))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([firsts, lasts], names=["first", "last"]))

    return lists


def chunk_sentences(chunks: DataFrame) -> DataFrame:
    """A row for each sentence in each chunk: (chunk_id, doc_id, chunk_no, sentence_id, sentence_no, text, page, section_path, char_start, char_end)."""
    # Without "outer" a test of the list goes before the rows are taken out of it, which builds the list again for each mention of its parts.
    rows = chunks.select("chunk_id", "doc_id", "chunk_no", F.posexplode_outer("sentences").alias("pos", "s"))
    return rows.where("pos is not null").select("chunk_id", "doc_id", "chunk_no", "s.*")


def chunk_layout(paragraphs: DataFrame, target_tokens: int = 400, overlap_tokens: int = 40) -> DataFrame:
    """The chunks of ``pack_chunks`` from ``paragraphs`` (doc_id, para_no, role, content, page): section paths, sentences, packing and nested sentences in one go."""
    rows = with_sentences(breadcrumbs(paragraphs), "content").select("doc_id", "para_no", "page", "section_path", F.posexplode_outer("sentences").alias("pos", "s")).where("pos is not null")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_no", "pos")) - 1
    numbered = rows.select("doc_id", number.alias("sentence_no"), "s.text", "page", "section_path", F.to_json("section_path").alias("section"))
    return pack_chunks(numbered, target_tokens, overlap_tokens)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_sentences, tokens, mean_tokens, n_sections) of each document's chunks."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("n_sentences").alias("n_sentences"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("mean_tokens"), F.countDistinct("section_path").alias("n_sections")
    )


def unique_sentences(members: DataFrame) -> DataFrame:
    """The first row of each sentence_id, in order of chunks."""
    order = Window.partitionBy("sentence_id").orderBy("chunk_no")
    return members.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def spans(sentences: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, chunk_no, first, n, text): every run of 1 to ``most`` neighbouring sentences of a chunk that is not blank; further columns of the first sentence are kept."""
    ahead = Window.partitionBy("doc_id", "chunk_no").orderBy("sentence_no").rowsBetween(0, most - 1)
    runs = sentences.withColumn("run", F.collect_list("text").over(ahead)).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("run"))))
    text = F.array_join(F.slice("run", 1, F.col("n")), " ")
    others = [c for c in sentences.columns if c not in ("doc_id", "chunk_no", "sentence_no", "text")]
    return runs.select("doc_id", "chunk_no", F.col("sentence_no").alias("first"), "n", text.alias("text"), *others).where("trim(text) <> ''")


def adjacent_overlap(members: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, chunk_no, overlaps): whether one of a chunk's last ``n`` sentences is among the next one's first ``n``."""
    return lists_overlap(members.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list("sentence_no")).alias("rows")), n)


def lists_overlap(lists: DataFrame, n: int = 5) -> DataFrame:
    """``adjacent_overlap`` of chunks (doc_id, chunk_no, rows) that have their sentences' numbers as a list, in order."""
    following = F.lead("rows").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    tail = F.slice("rows", F.greatest(F.lit(1), F.size("rows") - n + 1), F.lit(n))
    return lists.withColumn("following", following).where("following is not null").select("doc_id", "chunk_no", F.arrays_overlap(tail, F.slice("following", 1, n)).alias("overlaps"))


def quotas(n: int, shares: tuple[float, float] = (0.4, 0.35)) -> dict[str, int]:
    """How many of ``n`` items are easy and medium, each rounded half to even, and hard, which are the rest."""
    easy, medium = (round(n * share) for share in shares)
    return {"easy": easy, "medium": medium, "hard": n - easy - medium}


def sample_spans(rows: DataFrame, quotas: dict[str, int], per_chunk: int = 1, seed: int = 7) -> DataFrame:
    """At most ``quotas`` spans of each difficulty and ``per_chunk`` of each chunk, in the order of a seeded hash.

    ``rows`` has (doc_id, chunk_no, first, n, difficulty) and any others.  Each
    chunk offers its first span of each difficulty; class by class, in the order
    of ``quotas``, the first ones of chunks that have not given ``per_chunk`` yet
    are taken, so a chunk whose span finds no room can still give another.
    """
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id", "chunk_no", "first", "n"))
    order = ["turn", "doc_id", "chunk_no", "first", "n"]
    offer = rows.where(F.col("difficulty").isin(*quotas)).withColumn("turn", turn)
    offer = offer.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "chunk_no", "difficulty").orderBy(*order))).where("k = 1").drop("k")
    taken, given = None, None
    for name, quota in quotas.items():
        free = offer.where(F.col("difficulty") == name)
        if given is not None:
            full = given.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n_given")).where(F.col("n_given") >= per_chunk)
            free = free.join(full, ["doc_id", "chunk_no"], "left_anti")
        chosen = free.withColumn("k", F.row_number().over(Window.partitionBy("difficulty").orderBy(*order))).where(F.col("k") <= quota).drop("k")
        taken = chosen if taken is None else taken.unionByName(chosen)
        given = taken.select("doc_id", "chunk_no")
    return taken.drop("turn")


def greedy_spans(rows: DataFrame, quotas: dict[str, int], per_chunk: int = 1, seed: int = 7) -> DataFrame:
    """The spans that a walk over the chunks takes, ``quotas`` of each difficulty at most.

    ``rows`` has (doc_id, chunk_no, first, n, difficulty) and any others.  Chunks
    come in the order of a seeded hash, and so do a chunk's spans; a span is taken
    if its difficulty still has room and its chunk gave fewer than ``per_chunk``.

    The walk reads the next chunks that offer what is still open, as many as
    there is room for.  Each gives a span unless a difficulty fills up
    meanwhile, so there are no more readings than difficulties, and what comes
    to the driver is bounded by quotas times difficulties times ``per_chunk``
    whatever the table's size.  A repeated row is taken once and comes back as
    often as it is there.
    """
    hashed = lambda *columns: F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))
    offer = rows.where(F.col("difficulty").isin(*quotas)).select(hashed("doc_id", "chunk_no").alias("chunk"), hashed("doc_id", "chunk_no", "first", "n").alias("turn"), "doc_id", "chunk_no", "first", "n", "difficulty").distinct()
    # No more than ``per_chunk`` of a difficulty can be taken of a chunk.
    place = F.row_number().over(Window.partitionBy("chunk", "difficulty").orderBy("turn", "first", "n"))
    offer = kept(offer.withColumn("k", place).where(F.col("k") <= per_chunk).drop("k"), "offered_spans")
    room, taken, after = dict(quotas), [], ""
    while any(left > 0 for left in room.values()):
        ahead = offer.where(F.col("difficulty").isin([name for name, left in room.items() if left > 0]) & (F.col("chunk") > after))
        chunks = ahead.select("chunk").distinct().orderBy("chunk").limit(sum(left for left in room.values() if left > 0))
        found = sorted(ahead.join(F.broadcast(chunks), "chunk", "left_semi").collect(), key=lambda r: (r["chunk"], r["turn"], r["first"], r["n"]))
        if not found:
            break
        given = Counter()
        for row in found:
            if given[row["chunk"]] < per_chunk and room[row["difficulty"]] > 0:
                given[row["chunk"]] += 1
                room[row["difficulty"]] -= 1
                taken.append((row["doc_id"], row["chunk_no"], row["first"], row["n"]))
        after = found[-1]["chunk"]
    key = ["doc_id", "chunk_no", "first", "n"]
    picked = rows.sparkSession.createDataFrame(taken, rows.select(*key).schema)
    return rows.where(F.col("difficulty").isin(*quotas)).join(F.broadcast(picked), key, "left_semi")
