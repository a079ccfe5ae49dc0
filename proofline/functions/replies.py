"""Tolerant reading of model replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bare(reply: Column) -> Column:
    """The reply without fences and outer white space."""
    return F.regexp_replace(reply, r"(?m)^\s*```[A-Za-z]*\s*|\s*```\s*$|^\s+|\s+\z", "")


def json_object(reply: Column) -> Column:
    """The text of the JSON object in a reply: without fences, else from the first { to the last }; null if none parses."""
    bare = _bare(reply)
    inner = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    is_object = lambda x: F.startswith(F.ltrim(x), F.lit("{")) & F.json_object_keys(x).isNotNull()
    return F.when(is_object(bare), bare).when(is_object(inner), inner)


def strict_bool(value: Column) -> Column:
    """true, yes and 1 or false, no and 0 in any case; null for anything else."""
    said = F.lower(F.trim(value.cast("string")))
    return F.when(said.isin("true", "yes", "1"), True).when(said.isin("false", "no", "0"), False)



def _truthy(entry: Column) -> Column:
    """Whether the entry's ``entails`` counts as true, as a script language takes it: true, numbers but 0, texts but the empty one (so "false" is true); null where the entry has none."""
    text = F.try_variant_get(entry, "$.entails", "string")

    def taken(kind: Column) -> Column:
        number = F.coalesce(F.try_variant_get(entry, "$.entails", "double"), F.lit(0.0)) != 0
        nested = F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT"))
        return F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind == "VOID", F.lit(False)).when(nested, ~text.isin("[]", "{}")).when(kind.isNotNull(), number)

    return _bound(F.schema_of_variant(F.try_variant_get(entry, "$.entails", "variant")), taken)


def judge_reply(reply: Column, expected: Column) -> Column:
    """struct<judgments: array<struct<entails, reason>>, error> with exactly ``expected`` judgments.

    Reads an array, one object, or an object that holds the array as judgments,
    results or items; a short list is filled up with false, a long one cut.
    Without JSON, or with an entry that has no ``entails``, all are false and
    ``error`` says why; else it is null.
    """
    filler = lambda reason: F.array_repeat(F.struct(F.lit(False).alias("entails"), F.lit(reason).alias("reason")), expected)

    def listed(value: Column) -> Column:
        arrays = F.coalesce(*(F.try_variant_get(value, path, "array<variant>") for path in ("$", "$.judgments", "$.results", "$.items")))
        return F.coalesce(arrays, F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.array(value)))

    def checked(read: Column) -> Column:
        error = F.when(read.isNull(), "no JSON list of judgments").when(F.exists(read, lambda x: x["entails"].isNull()), "malformed entry in the judgments")
        full = F.slice(F.concat(read, filler("fewer judgments than citations")), F.lit(1), expected)
        return F.struct(F.when(error.isNull(), full).otherwise(filler("")).alias("judgments"), error.alias("error"))

    value = F.coalesce(F.try_parse_json(_bare(reply)), F.try_parse_json(json_object(reply)))
    entries = F.slice(_bound(value, listed), F.lit(1), expected)
    read = F.transform(entries, lambda x: F.struct(_truthy(x).alias("entails"), F.coalesce(F.try_variant_get(x, "$.reason", "string"), F.lit("")).alias("reason")))
    return _bound(read, checked)


def judge_array(reply: Column, expected: Column) -> Column:
    """The judgments of ``judge_reply``; what cannot be read is all false."""
    return judge_reply(reply, expected)["judgments"]


def author_reply(reply: Column) -> Column:
    """struct<question, gold_answer, error> of an author's reply: both trimmed and not empty, else ``error`` says what is missing."""
    found = json_object(reply)
    part = lambda name: F.trim(F.coalesce(F.get_json_object(found, f"$.{name}"), F.lit("")))
    error = F.when(found.isNull(), "no JSON object").when(part("question") == "", "empty question").when(part("gold_answer") == "", "empty gold_answer")
    return F.struct(part("question").alias("question"), part("gold_answer").alias("gold_answer"), error.alias("error"))


def verdict_reply(reply: Column) -> Column:
    """struct<well_formed, supported, reasons, error> of a verdict; both are false where either is no boolean."""
    found = json_object(reply)
    well, supported = (strict_bool(F.get_json_object(found, f"$.{name}")) for name in ("well_formed", "supported"))
    error = F.when(found.isNull(), "no JSON object").when(well.isNull(), "well_formed is no boolean").when(supported.isNull(), "supported is no boolean")
    reasons = F.substring(F.trim(F.coalesce(F.get_json_object(found, "$.reasons"), F.lit(""))), 1, 500)
    return F.struct(F.coalesce(well & error.isNull(), F.lit(False)).alias("well_formed"), F.coalesce(supported & error.isNull(), F.lit(False)).alias("supported"), reasons.alias("reasons"), error.alias("error"))


def support_reply(reply: Column, n: Column) -> Column:
    """struct<indices, error> of a labelling reply: the distinct places within 0 and ``n`` - 1, in order; none from a reply that is no JSON."""
    found = json_object(reply)
    indices = F.coalesce(F.from_json(F.get_json_object(found, "$.supporting_indices"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(union_indices(indices, n).alias("indices"), F.when(found.isNull(), "no JSON object").alias("error"))


def union_indices(indices: Column, n: Column) -> Column:
    """The distinct whole numbers of a text array that lie within 0 and n - 1, in order.

    Numbers may be written in any form: a fraction is cut off, true and false
    are 1 and 0; what is no number is left out.
    """

    def whole(x: Column) -> Column:
        value = F.when(F.lower(x) == "true", 1.0).when(F.lower(x) == "false", 0.0).otherwise(x.try_cast("double"))
        # Beyond what a place can be there is nothing to cut off.
        return F.when(F.abs(value) < 2.0**31, value.cast("int"))

    numbers = F.transform(indices, whole)
    return F.array_distinct(F.filter(numbers, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
