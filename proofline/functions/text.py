"""Sentences, token estimates, tags, identifiers and context lines as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence: up to and with closing marks that white space or the end follows, or what is left. Marks within "3.5" and acronyms such as "U.S." close none.
SENTENCE = r"(?:[A-Z]\.(?:[A-Z]\.)+|[A-Z]|[^.!?A-Z]+|[.!?]+[^.!?\x20\x09-\x0D])+[.!?]*|[.!?]+"
#: Fixed value: an inline citation tag.
TAG = r"\[s:([^\]\s]+?)\]"


def words(text: Column) -> Column:
    """How many words stand in ``text``, split by white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def strip_tags(text: Column) -> Column:
    """``text`` without citation tags."""
    return F.regexp_replace(text, TAG, "")


def tag_anchors(text: Column) -> Column:
    """array<struct<sid, at>>: each tag's id and where it stood, as an offset into the stripped text."""
    pieces = F.split(text, TAG, -1)
    ids = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    ends = F.aggregate(
        pieces,
        F.array(F.lit(0)),
        lambda seen, piece: F.concat(seen, F.array(F.element_at(seen, -1) + F.length(piece))),
    )
    return F.transform(ids, lambda sid, i: F.struct(sid.alias("sid"), F.get(ends, i + 1).alias("at")))


def anchor_sentence(spans: Column, at: Column) -> Column:
    """The index of the sentence that a tag at ``at`` belongs to, in array<struct<start, end>>.

    The one that contains it, else the last that ends at or before it, else 0.
    """
    indexed = F.transform(spans, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    inside = F.filter(indexed, lambda s: (s["start"] <= at) & (at < s["end"]))
    before = F.filter(indexed, lambda s: s["end"] <= at)
    return F.coalesce(F.get(inside, F.lit(0))["i"], F.get(F.reverse(before), F.lit(0))["i"], F.lit(0))


def sentence_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s-s%05d", document_id.cast("string"), index)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s-c%04d", document_id.cast("string"), index)


def passage_of(sid: Column) -> Column:
    """The third part of a ``bench::`` id, else null."""
    third = F.split_part(sid, F.lit("::"), F.lit(3))
    return F.when(F.startswith(sid, F.lit("bench::")) & (third != ""), third)


def section_label(path: Column) -> Column:
    """The path joined by " > ", or "(root)"."""
    return F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit("(root)"))


def difficulty(n_sentences: Column, text: Column) -> Column:
    """hard from three sentences on, medium for two; one is easy if it has a digit or is short."""
    one = F.when(text.rlike(r"\d") | (F.length(text) < 120), "easy").otherwise("medium")
    return F.when(n_sentences >= 3, "hard").when(n_sentences == 2, "medium").otherwise(one)


def truncated(text: Column, n: int) -> Column:
    """The first ``n`` characters, with " …" where something is cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(" …"))).otherwise(text)


def cited(text: Column, sids: Column) -> Column:
    """The form ``text [sid, sid]``; the text alone without ids."""
    return F.when(F.size(sids) > 0, F.concat(text, F.lit(" ["), F.array_join(sids, ", "), F.lit("]"))).otherwise(text)
