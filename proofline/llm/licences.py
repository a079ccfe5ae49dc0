"""Licence scans by canonical digest.

A text's canonical form is free of what varies between copies of a licence:
case, punctuation, white space, copyright notices and equivalent spellings.  It
does not depend on where lines break.  The digest of the form is joined with
the digests of known licences and notices.  The units looked up are the entire
text and each of its lines, so a notice within a longer document is found as
well as a file that is a licence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import KNOWN_LICENCES

#: Words that count as one: a text that is there then, a pattern on lower-case words with one space between, and what it becomes.
SPELLINGS = [
    ("https", r"\bhttps\b", "http"),
    ("licenc", "licenc", "licens"),
    ("non commercial", r"\bnon commercial\b", "noncommercial"),
    ("acknowledgement", "acknowledgement", "acknowledgment"),
    ("merchantib", "merchantib", "merchantab"),
    ("per cent", r"\bper cent\b", "percent"),
    ("copyright", r"\bcopyright (holder|owner)", "rights holder"),
    ("whilst", r"\bwhilst\b", "while"),
    ("fulfill", "fulfill", "fulfil"),
    ("willful", "willful", "wilful"),
    ("avour", "avour", "avor"),
    ("abour", "abour", "abor"),
    ("onour", "onour", "onor"),
    ("isation", "isation", "ization"),
    ("ise", r"(\p{L}{3})ise(d|s)?\b", "$1ize$2"),
    ("ising", r"(\p{L}{3})ising\b", "$1izing"),
]
#: No spelling makes a form shorter than this share of it.
_SHRINKS = 0.75
#: What a copyright notice begins with: the word with the sign, a year, a template's bracket or "by"; or a sign alone, which "(c)" is only with one of these.
_NOTICE = r"(?:\bcopyright\b[\s,:]*(?:\(c\)|©|\d{4}|[<\[{]|by\b)|\(c\)[\s,:]*(?:\d{4}|[<\[{]|copyright\b|by\b)|©)"
#: Where the holder's name ends: before words that a licence goes on with, or a blank line.
_AFTER = r"(?:\b(?:permission (?:is|to)|released under|licensed under|redistribution and|all\s+rights|this (?:software|program|work|file|library|notice))\b|\n[ \t\r]*\n)"
#: A reservation of rights goes as well.
RESERVED = r"(?i)\ball\s+rights\s+reserved\b"
#: A notice up to there, if that is near; else up to the end of its line.
NOTICE_TO_WORDS, NOTICE_LINE = rf"(?i){_NOTICE}[^\x00]{{0,300}}?({_AFTER})", rf"(?i){_NOTICE}[^\n]*"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_notices(text: Column) -> Column:
    """``text`` without copyright notices and reservations; words such as "copyright holders" or a clause "(c)" are none."""

    def cut(x: Column) -> Column:
        lower = F.lower(x)
        some = F.contains(lower, F.lit("copyright")) | F.contains(lower, F.lit("(c)")) | F.contains(x, F.lit("©"))
        reserved = F.contains(lower, F.lit("reserved"))
        bare = F.when(some, F.regexp_replace(F.regexp_replace(x, NOTICE_TO_WORDS, "\n$1"), NOTICE_LINE, " ")).otherwise(x)
        return F.when(reserved, F.regexp_replace(bare, RESERVED, " ")).otherwise(bare)

    return _bound(text, cut)


def _marked(text: Column) -> Column:
    """Lower-case words and digits without notices, with one space between, and the line breaks."""
    return F.regexp_replace(F.lower(F.replace(_without_notices(text), F.lit("&"), F.lit(" and "))), r"[^\p{L}\p{N}\n]+", " ")


def _one_line(marked: Column) -> Column:
    return F.regexp_replace(F.translate(marked, "\n", " "), " {2,}", " ")


def _spelled(form: Column) -> Column:
    def spell(x: Column) -> Column:
        some, spelled = F.lit(False), x
        for needed, pattern, instead in SPELLINGS:
            some = some | F.contains(x, F.lit(needed))
            spelled = F.regexp_replace(spelled, pattern, instead)
        return F.trim(F.when(some, spelled).otherwise(x))

    return _bound(form, spell)


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; empty where nothing is left."""
    return _spelled(_one_line(_marked(text)))


def _digest(form: Column) -> Column:
    return F.md5(F.nullif(form, F.lit("")).cast("binary"))


def digest(text: Column) -> Column:
    """The digest of the canonical form; null for null texts and where nothing is left."""
    return _digest(canonical(text))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(licence, digest, n_chars) of ``known`` (licence, title, text), which stand for any table of licences; without one, of the public ones listed here.

    Each is known with its title and without.

    Defined cases: null titles count as empty; null texts and those that are
    nothing but notices are left out; of several licences of one digest the
    first in order holds; an empty table gives no digests.
    """
    texts = spark.createDataFrame(KNOWN_LICENCES, "licence string, title string, text string") if known is None else known
    forms = texts.select("licence", F.explode(F.array(F.col("text"), F.concat_ws("\n\n", "title", "text"))).alias("form")).where("form is not null")
    forms = forms.select("licence", canonical(F.col("form")).alias("form")).where("form <> ''")
    return forms.groupBy("form").agg(F.min("licence").alias("licence")).select("licence", _digest(F.col("form")).alias("digest"), F.length("form").alias("n_chars"))


def scan_licences(docs: DataFrame, digests: DataFrame, broadcast_limit: int = 200_000) -> DataFrame:
    """``docs`` rows as (doc_id, text_licence, n_notices, licences).

    ``docs`` has (doc_id, text) and any others, which are ignored; ``digests``
    (digest, licence, n_chars) are broadcast while there are at most
    ``broadcast_limit``; units too long for any of them are not looked at further.
    ``text_licence`` is the licence that the entire text is, else null;
    ``n_notices`` the number of lines that are a known notice or licence;
    ``licences`` the sorted distinct ones of both.

    Defined cases: null, empty and wordless texts have none; lines that are
    nothing but punctuation or a copyright notice are no unit; of several
    identifiers for one digest the first in order holds; rows that repeat a
    doc_id and text get equal results, other texts of the id their own; no known
    digests give no finding; an empty table gives no rows.
    """
    md5 = F.md5(F.col("text").cast("binary"))
    # explode(array(...)) keeps the canonical form from being computed again for each use.
    forms = docs.select("doc_id", md5.alias("text_md5"), F.explode(F.array(_marked(F.col("text")))).alias("form"))
    known = digests.groupBy("digest").agg(F.min("licence").alias("licence"), F.max("n_chars").alias("n_chars"))
    n, longest = known.agg(F.count("*"), F.coalesce(F.max("n_chars"), F.lit(0))).first()
    fit = lambda form: _bound(form, lambda x: F.when(F.length(x) <= int(longest / _SHRINKS) + 1, _digest(_spelled(x))))
    digested = F.concat(F.array(fit(F.trim(_one_line(F.col("form"))))), F.transform(F.split("form", "\n", -1), lambda line: fit(F.trim(line))))
    units = forms.select("doc_id", "text_md5", F.posexplode(digested).alias("place", "digest")).where("digest is not null")
    known = known.select("digest", "licence")
    found = units.join(F.broadcast(known) if n <= broadcast_limit else known, "digest").groupBy("doc_id", "text_md5")
    found = found.agg(F.max(F.when(F.col("place") == 0, F.col("licence"))).alias("text_licence"), F.collect_set(F.when(F.col("place") > 0, F.col("place"))).alias("places"), F.array_sort(F.collect_set("licence")).alias("licences"))
    joined = docs.select("doc_id", md5.alias("text_md5")).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.text_md5 = f.text_md5"), "left")
    return joined.select("d.doc_id", "text_licence", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"))
