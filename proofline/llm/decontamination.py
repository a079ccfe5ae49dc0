"""Benchmark decontamination by word windows.

Every window of ``n`` consecutive words of a benchmark item goes into a set
keyed by its 64-bit hash.  Training texts are split into words once; the hash
of every window is probed against the broadcast set, and only a hit's words
are compared with the item's.
"""

from __future__ import annotations

from string import ascii_letters, ascii_lowercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_az, sent_if_few, whole_row



def _run_of(inside: str) -> str:
    """The pattern of a run of ``inside`` and of characters beyond ASCII.

    It names each character that ends a run: Java looks such a class up in one
    table, where it would test a class of ranges range by range.
    """
    return "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in inside) + "]+"


#: A word is a run of ASCII letters and digits and of any character beyond ASCII; A-Z are in lower case already.
WORD = _run_of(ascii_lowercase + digits)
#: The same words before A-Z are in lower case.
RAW_WORD = _run_of(ascii_letters + digits)


def normalised_words(text: Column) -> Column:
    """The words of ``text`` with A-Z in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_az(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(window, length, hash, item_ids): each distinct window with the items it occurs in.

    An item of fewer than ``n`` words, but at least one, is one window.
    """
    words = benchmark.select("item_id", F.explode(F.array(normalised_words(F.col("text")))).alias("words")).where("size(words) > 0")
    windows = words.withColumn("length", F.least(F.size("words"), F.lit(n))).select(
        "item_id", "length", F.explode(F.expr("transform(sequence(1, size(words) - length + 1), i -> slice(words, i, length))")).alias("window")
    )
    return windows.groupBy("window", "length").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")).withColumn("hash", F.xxhash64("window"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_limit: int = 1_000_000) -> DataFrame:
    """(doc_id, text_md5, start, length, item_ids): verified occurrences of windows; start counts words from 1.

    Texts are split once and windows of all lengths are hashed in one
    projection.  The window set is broadcast while it has at most ``set_limit``
    windows.  A larger one is dealt by hash into as many sets as needed, and the
    texts are scanned once for each, which finds the same hits in bounded
    memory.

    Defined cases: null and wordless texts and items have no hits; rows that
    repeat a doc_id and text give the same hits once each; a null doc_id is kept.
    """
    windows = benchmark_windows(benchmark, n)
    sizes = {row["length"]: row["n"] for row in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = sorted(sizes) or [n]
    passes = max(1, -(-sum(sizes.values()) // set_limit))
    # explode(array(...)) keeps the optimizer from copying the split into the expressions over its words.
    words = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.explode(F.array(normalised_words(F.col("text")))).alias("words"))
    hashed = [f"if(size(words) < {k}, cast(array() as array<bigint>), transform(sequence(1, size(words) - {k - 1}), i -> xxhash64(slice(words, i, {k}))))" for k in lengths]
    # Hashed in a projection of its own, the windows explode and probe within generated code;
    # "outer" so that no filter on the number of hashes is inferred, which would hash twice.
    probes = words.withColumn("hashes", F.expr(f"concat({', '.join(hashed)})" if len(hashed) > 1 else hashed[0])).select("doc_id", "text_md5", "words", F.posexplode_outer("hashes").alias("at", "hash"))
    # The hashes of one length follow those of all shorter ones.
    before = " ".join(f"when {k} then {' + '.join(f'greatest(0, size(words) - {j - 1})' for j in lengths if j < k) or 0}" for k in lengths)
    start = F.col("at") + 1 - F.expr(f"case length {before} end") if len(lengths) > 1 else F.col("at") + 1
    hits = None
    for k in range(passes):
        known = windows.where(f"pmod(hash, {passes}) = {k}") if passes > 1 else windows
        found = probes.join(F.broadcast(known), "hash").withColumn("start", start)
        # Two comparisons, not one equality: that would become a join key, built for every window.
        text_window = F.when(F.expr("start between 1 and size(words) - length + 1"), F.slice(F.col("words"), F.col("start"), F.col("length")))
        same = found.where((text_window >= F.col("window")) & (text_window <= F.col("window"))).select("doc_id", "text_md5", "start", "length", "item_ids")
        hits = same if hits is None else hits.unionByName(same)
    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_limit: int = 1_000_000) -> DataFrame:
    """``docs`` rows as (doc_id, text_md5, n_words, spans, n_hit, item_ids, contaminated).

    ``spans`` are the hit stretches of words as structs (first, last), counted
    from 1, merged and in order; ``n_hit`` is the number of words in them and
    ``item_ids`` the sorted items (as strings) with a window in the text.

    Defined cases: null or wordless texts have no words and are clean; items
    with a null text or without words have no windows; an item with a null id
    marks words but is not listed; equal rows get equal results; an empty
    benchmark leaves all clean.
    """
    base = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    per_text = (
        find_hits(docs, benchmark, n, set_limit)
        .groupBy("doc_id", "text_md5")
        .agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length") - 1).alias("end")))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    )
    # Starts are in order: a span opens where a window begins behind every earlier end.
    merged = """aggregate(found, cast(array() as array<struct<first: int, last: int>>), (spans, w) ->
        if(size(spans) > 0 and get(spans, size(spans) - 1).last >= w.start - 1,
           concat(slice(spans, 1, size(spans) - 1), array(named_struct('first', get(spans, size(spans) - 1).first, 'last', greatest(get(spans, size(spans) - 1).last, w.end)))),
           concat(spans, array(named_struct('first', w.start, 'last', w.end)))))"""
    per_text = per_text.select("doc_id", "text_md5", F.expr(merged).alias("spans"), "item_ids")
    joined = base.alias("b").join(per_text.alias("p"), F.expr("b.doc_id <=> p.doc_id and b.text_md5 <=> p.text_md5"), "left")
    none = "cast(array() as array<struct<first: int, last: int>>)"
    return joined.select("b.doc_id", "b.text_md5", "n_words", F.expr(f"coalesce(spans, {none})").alias("spans"), F.expr("coalesce(item_ids, cast(array() as array<string>))").alias("item_ids")).withColumns(
        {"n_hit": F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)"), "contaminated": F.expr("size(spans) > 0")}
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as structs beside what they are joined on, so that no column of theirs can clash."""
    return docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), whole_row(docs).alias("row")).alias("d")


_SAME_TEXT = "d.doc_id <=> h.doc_id and d.md5 <=> h.text_md5"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs; all columns are kept.

    Defined cases: as in ``find_hits``; null, empty and wordless texts stay, of
    a doc_id with several texts only the contaminated ones go, repeated rows go
    or stay together, and columns may have any names.
    """
    found = checkpointed(find_hits(docs, benchmark, n).select("doc_id", "text_md5").distinct())
    # The few that are hit go to where the texts are; many are worth moving the texts.
    return _keyed(docs).join(sent_if_few(found).alias("h"), F.expr(_SAME_TEXT), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with every hit stretch of words, and what stands between those words, cut out of the text.

    Defined cases: texts without a hit, null ones among them, stay as they are;
    no row is lost or added, and columns may have any names.
    """
    spans = decontaminate(docs, benchmark, n).where("contaminated").select("doc_id", "text_md5", "spans").dropDuplicates(["doc_id", "text_md5"]).alias("h")
    joined = _keyed(docs).join(spans, F.expr(_SAME_TEXT), "left").select("row", "spans")
    # Raw words and the gaps before, between and behind them; lower-casing A-Z keeps both aligned.
    parts = joined.withColumns({"words": F.regexp_extract_all("row.text", F.lit(RAW_WORD), F.lit(0)), "gaps": F.split("row.text", RAW_WORD, -1)})
    kept = """concat(get(gaps, 0), array_join(transform(words, (w, i) ->
        if(exists(spans, s -> i + 1 between s.first and s.last), '', w)
        || if(exists(spans, s -> i + 1 >= s.first and i + 1 < s.last), '', get(gaps, i + 1))), ''))"""
    return parts.select(F.col("row").withField("text", F.expr(f"if(spans is null, row.text, {kept})")).alias("row")).select("row.*")
