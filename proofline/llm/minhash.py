"""Near-duplicate groups by HyperMinHash sketches, banding and exact verification.

A text's set holds its distinct five-word shingles.  Each of ``BANDS * ROWS``
registers keeps the minimum of one hash over the set, compressed to its count
of leading zeros and the mantissa bits behind them.  Texts with equal sets are
one node.  Nodes that agree on all registers of a band are candidates; the
registers' collision-corrected Jaccard estimate drops hopeless ones, and the
others are compared on their full sets.

No large bucket is expanded into all its pairs.  First every node is compared
with its buckets' most central node (the one with most bucket mates: in a group
of edited copies, the original) and with two seeded members.  What is linked
then needs no more comparing.  Of buckets that still hold several components,
small ones are compared pair by pair across components; the nodes of others go
through an exact prefix filter on their shingles: only pairs that share one of
their rarest shingles are compared.  So each similar pair is either compared or
known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, checkpointed, left_join_hot, sent_if_few, whole_row
from .shingles import shingle_sets

#: 32 bands of 5: a pair of similarity 0.75 shares none with a chance of 2 in 10,000.
BANDS, ROWS = 32, 5
MANTISSA_BITS = 10
_HASHES = BANDS * ROWS
_RANDOM = np.random.Generator(np.random.PCG64(77))
_XOR = _RANDOM.integers(0, 2**63, _HASHES, dtype=np.uint64)
_TIMES = _RANDOM.integers(1, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Mixed buckets of up to so many nodes are compared pair by pair, a bounded number for each node.
SMALL_BUCKET = 16
#: So many document ids (8 bytes each) may be broadcast.
BROADCAST_IDS = 2_000_000
#: Sets are sketched in pieces of so many shingles.
_PIECE = 4096
#: Standard deviations below the threshold at which an estimate still counts as a candidate.
_SLACK = 5


def compress(minima: np.ndarray) -> np.ndarray:
    """Leading zeros (six bits) and the ten bits behind the first one of 64-bit minima."""
    fraction, exponent = np.frexp((minima >> np.uint64(11)).astype(np.float64))
    mantissa = np.maximum((fraction - 0.5) * 2 ** (MANTISSA_BITS + 1), 0).astype(np.uint16)
    return ((53 - exponent).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    minima = np.full(_HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _PIECE):
            piece = shingles[at : at + _PIECE]
            for k in range(_HASHES):
                minima[k] = min(minima[k], ((piece ^ _XOR[k]) * _TIMES[k]).min())
    return compress(minima)


def estimate(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers.

    Of registers whose minima differ, about 0.17 * 4nm / (n + m)^2 in every
    2^bits agree by chance; they are taken out.
    """
    ratio = 4.0 * n * m / np.square(n.astype(float) + m)
    chance = 0.169919487159739093975 * ratio / 2**MANTISSA_BITS
    return (agreeing / _HASHES - chance) / (1 - chance)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        some = [len(s) > 0 for s in sets]
        carried = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in carried),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if x else None for s, x in zip(sets, some, strict=True)], pa.binary()),
                pa.array([sketch(s).tobytes() if x else None for s, x in zip(sets, some, strict=True)], pa.binary()),
            ],
            names=[*carried, "n_shingles", "node", "registers"],
        )
        del sets
        pa.default_memory_pool().release_unused()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in shingle_sets(batch.column("text"))]
        nodes = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])
        del sets, nodes
        pa.default_memory_pool().release_unused()


def _promising(threshold: float):
    least = threshold - _SLACK * (threshold * (1 - threshold) / _HASHES) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, _HASHES) for c in ("a_registers", "b_registers"))
            n, m = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
            good = pa.array(estimate((a == b).sum(axis=1), n, m) >= least)
            yield batch.select(["a", "b", "a_n", "b_n"]).filter(good)

    return keep


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` of their union in common."""
    of = {x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("registers").alias(f"{x}_registers")) for x in "ab"}
    sized = pairs.join(of["a"], "a").join(of["b"], "b").where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    promising = sized.select("a", "b", "a_n", "b_n", "a_registers", "b_registers").mapInArrow(_promising(percent / 100), "a binary, b binary, a_n long, b_n long")
    full = promising.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
    shared = full.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_set", "b_set")).cast("long").alias("shared"))
    return shared.where(f"100 * shared >= {percent} * (a_n + b_n - shared)").select("a", "b")


def connected(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Large-star and small-star steps alternate until every link points at a
    root: no node has two links upwards, and none is pointed at that points
    elsewhere.  Each round ends in a checkpoint.  The number of rounds grows
    with the logarithm of the links; more than ``max_rounds`` raise RuntimeError.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    for _ in range(max_rounds):
        ends = edges.select(F.explode(F.array(F.struct("v", F.col("u").alias("m")), F.struct(F.col("u").alias("v"), F.col("u").alias("m")))).alias("e"))
        lowest = ends.groupBy(F.col("e.v").alias("u")).agg(F.min("e.m").alias("m"))
        larger = edges.join(lowest, "u").select("v", F.col("m").alias("u"))
        lowest = larger.groupBy("v").agg(F.min("u").alias("m"))
        pulled = larger.join(lowest, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        edges = checkpointed(pulled.select("e.v", "e.u").where("u <> v").distinct())
        sides = edges.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s"))
        if sides.groupBy("s.node").agg(F.sum("s.up").alias("up"), F.max("s.down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"links did not come to their roots in {max_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _open(busy: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, key, mates, root) of the buckets that hold more than one component."""
    labelled = busy.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return labelled.join(mixed, "key")


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``left`` (node, root) in different components that can be similar, by their rarest shingles.

    Two sets with ``percent`` of their union in common cannot miss each other
    in the rarest (100 - percent) percent, and one more, of either's shingles.
    What many texts have in common is frequent and so in no prefix, unless it
    is nearly all of a text; then what stands before it in that order, and is
    not shared, tells how much can be shared at most.
    """
    shingles = left.join(sets, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = checkpointed(shingles.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"))
    # The shingles that more than one row in HOT_SHARE has, fewer than HOT_SHARE, are broadcast: their rows stay where they are.
    least = often.agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0] / HOT_SHARE
    hot = often.where(F.col("often") > least)
    cold = shingles.join(F.broadcast(hot.select("shingle")), "shingle", "left_anti").join(often.where(F.col("often") <= least), "shingle")
    known = cold.unionByName(shingles.join(F.broadcast(hot), "shingle"))
    rare = known.groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("common"))
    # A shingle of one text alone comes before all these; it takes a place in the prefix and meets nothing.
    length = F.expr(f"n - cast(ceil({percent} * n / 100.0) as int) + 1 - (n - size(common))")
    prefix = rare.withColumn("length", length).where("length > 0")
    placed = prefix.select("node", "root", "n", (F.col("n") - F.size("common")).alias("alone"), F.posexplode(F.slice("common", 1, F.col("length"))).alias("at", "one"))
    spread = checkpointed(placed.select("one.shingle", "one.often", "node", "root", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("upto")))
    # Shingles of a shared passage stand in the same texts: of those with equal postings the first in order is enough.
    postings = [F.count("*").alias("texts"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two")]
    mixed = spread.groupBy("shingle", "often").agg(F.min("root").alias("low"), F.max("root").alias("high"), *postings).where("low <> high")
    spread = spread.join(mixed.groupBy("texts", "one", "two").agg(F.min(F.struct("often", "shingle"))["shingle"].alias("shingle")).select("shingle"), "shingle")
    other = spread.select("shingle", F.col("node").alias("y"), F.col("root").alias("y_root"), F.col("n").alias("m"), F.col("upto").alias("y_upto"))
    # From the first common shingle on (``upto`` counts from there), both have room for all that they must share.
    enough = f"root < y_root and {100 + percent} * least(upto, y_upto) >= {percent} * (n + m)"
    return _pairs(spread.withColumnRenamed("node", "x").join(other, "shingle").where(enough))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...).

    Two texts are linked when 100 * |A and B| >= ``percent`` * |A or B|.
    ``component_id`` is the smallest doc_id reachable, ``kept`` marks the row
    that has it.

    Defined cases: null and wordless texts have no shingles and are linked
    with nothing; equal texts, also very many, are one node; a row without a
    doc_id is linked with nothing, has a null component and is kept; a
    repeated doc_id counts as one document wherever its texts are equal.
    """
    rows, by_node = _components(docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("binary").alias("md5"), "text"), percent)
    keyed = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    known = left_join_hot(keyed, by_node, ["node"])
    return known.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, md5, text) as (doc_id, md5, n_shingles, node, registers), and (node, first) of the nodes with a doc_id: the first (doc_id, md5) of their component."""
    rows = checkpointed(docs.mapInArrow(_sketches, "doc_id long, md5 binary, n_shingles long, node binary, registers binary"))
    nodes = checkpointed(rows.where("doc_id is not null and node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "md5")).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")))
    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("registers", width * k + 1, width)) for k in range(BANDS)))
    bands = nodes.select("node", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    busy = checkpointed(bands.join(shared, "key"))
    central = checkpointed(busy.groupBy("node").agg(F.sum("mates").alias("mates")))
    members = checkpointed(nodes.select("node", "first").join(central.select("node"), "node", "left_semi").select("first.doc_id"))
    # Few ids go to where the texts are; many are worth moving the texts.
    texts = docs.select("doc_id", "text").join(sent_if_few(members, BROADCAST_IDS), "doc_id", "left_semi")
    sets = checkpointed(texts.mapInArrow(_sets, "node binary, shingles array<long>").dropDuplicates(["node"]))

    turn = F.xxhash64(F.lit(1), "node")
    one = lambda half: F.min(F.when(F.pmod(turn, F.lit(2)) == half, F.struct(turn.alias("turn"), "node")))["node"]
    some = busy.drop("mates").join(central, "node").groupBy("key").agg(F.array(F.max(F.struct("mates", "node"))["node"], one(0), one(1)).alias("some"))
    met = busy.select("key", F.col("node").alias("x")).join(some.select("key", F.explode("some").alias("y")), "key")
    tested = checkpointed(_pairs(met.where("y is not null")))
    links = checkpointed(_verified(tested, nodes, sets, percent))
    roots = connected(links)
    open_ = checkpointed(_open(busy, roots))
    if not open_.isEmpty():
        small = open_.where(F.col("mates") <= SMALL_BUCKET)
        other = small.select("key", F.col("node").alias("y"), F.col("root").alias("y_root"))
        near = _pairs(small.withColumnRenamed("node", "x").join(other, "key").where("root < y_root"))
        far = _prefix_pairs(open_.where(F.col("mates") > SMALL_BUCKET).select("node", "root").distinct(), sets, percent)
        fresh = checkpointed(near.unionByName(far).distinct().join(tested, ["a", "b"], "left_anti"))
        found = checkpointed(_verified(fresh, nodes, sets, percent))
        if not found.isEmpty():
            roots = checkpointed(connected(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))

    component = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = component.groupBy("root").agg(F.min("first").alias("first"))
    return rows, checkpointed(component.select("node", "root").join(lowest, "root").select("node", "first"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns are kept.

    Rows are told apart by doc_id and text, so other texts of a repeated doc_id
    stay.  Of each group the row with the smallest doc_id, then the smallest
    digest of its text, stays.  Rows that repeat its doc_id and text are reduced
    to one; rows without a doc_id all stay.  So do null and wordless texts of
    different ids.  Columns may have any names; an empty table stays empty.
    """
    md5 = F.unhex(F.md5(F.col("text").cast("binary")))
    rows, by_node = _components(docs.select(F.col("doc_id").cast("long"), md5.alias("md5"), "text"), percent)
    grouped = rows.where("doc_id is not null and node is not null").select("doc_id", "md5", "node")
    gone = checkpointed(left_join_hot(grouped, by_node, ["node"]).where("first.doc_id <> doc_id or first.md5 <> md5").select("doc_id", "md5").distinct())
    repeated = checkpointed(rows.where("doc_id is not null").groupBy("doc_id", "md5").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "md5"))
    same = F.expr("d.doc_id <=> k.doc_id and d.md5 <=> k.md5")
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), md5.alias("md5"), whole_row(docs).alias("row")).alias("d").join(sent_if_few(gone).alias("k"), same, "left_anti").alias("d")
    if not repeated.isEmpty():
        # Only texts of rows that repeat are moved.
        single, several = (left.join(sent_if_few(repeated).alias("k"), same, how) for how in ("left_anti", "left_semi"))
        left = single.unionByName(several.dropDuplicates(["doc_id", "md5"]))
    return left.select("row.*")
