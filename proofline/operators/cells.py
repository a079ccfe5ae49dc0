"""An approximate vector index: vectors dealt into cells around centres, of which a search reads the nearest.

Centres are found by spherical k-means on a seeded sample of a stated size;
every vector is then dealt to its nearest centre and written by cell.  A search
sends each query to as many cells as a stated recall takes, measured on the
sample itself, and reads those cells' files only.  A cell of very many vectors
is read by as many tasks as it has splits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder
from .retrieval import in_blocks, top_k

#: Rows of the sample, rounds of k-means, and rows of the sample that ask the others when probes are chosen.
SAMPLE, ROUNDS, ASKING = 20_000, 12, 200
MOST_CELLS = 1024


class CellIndex(NamedTuple):
    """``vectors``: (doc_id, embedding, cell), written by cell; ``centres`` of length 1; how many cells a query is sent to."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm < 1e-12, 1, norm)


def _centres(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Spherical k-means; a centre that nothing is near to moves to the vector that fits its own centre worst."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, seed: int) -> int:
    """The fewest cells that hold, of the sample's own nearest ``k`` of some of its rows, the share ``recall``."""
    asking = np.random.default_rng(seed + 1).permutation(len(sample))[:ASKING]
    own = (sample @ centres.T).argmax(axis=1)
    similar = sample[asking] @ sample.T
    similar[np.arange(len(asking)), asking] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    # How far down a query's list of cells each of its neighbours stands.
    order = np.argsort(-(sample[asking] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    depth = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def build_cells(vectors: DataFrame, k: int = 20, recall: float = 0.97, cells: int | None = None, seed: int = 7) -> CellIndex:
    """The index of all ``vectors`` (doc_id, embedding).

    At most ``SAMPLE`` rows, in the order of a seeded hash over all of them, are
    brought to the driver to find centres (about the root of the number of vectors, at most
    ``MOST_CELLS``) and the number of probes for ``recall`` of the ``k`` nearest.
    Null vectors and those of another length than most of the sample are not
    indexed; a zero vector is in the first cell.
    """
    named = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    rows = named.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id"))).limit(SAMPLE).collect()
    sizes, counts = np.unique([len(row["embedding"]) for row in rows], return_counts=True)
    length = int(sizes[counts.argmax()]) if len(sizes) else 0
    sample = _unit(np.array([row["embedding"] for row in rows if len(row["embedding"]) == length], np.float64).reshape(-1, max(1, length)))
    if cells is None:
        cells = int(named.count() ** 0.5)
    cells = max(1, min(cells, MOST_CELLS, len(sample)))
    centres = _centres(sample, cells, seed) if len(sample) else np.zeros((1, max(1, length)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), length))
            if batch.num_rows:
                v = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, length)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((v @ centres.T).argmax(axis=1), pa.int32())], names=["doc_id", "embedding", "cell"])

    placed = named.mapInArrow(dealt, f"doc_id {dict(named.dtypes)['doc_id']}, embedding array<double>, cell int")
    folder = f"{shared_folder(vectors)}/cells-{uuid.uuid4().hex}"
    # Cells are split by id as well, so that a hot one is several files.
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartition(parts, "cell", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("cell").parquet(folder)
    read = vectors.sparkSession.read.schema(placed.schema).parquet(folder)
    return CellIndex(read, centres, _probes(sample, centres, k, recall, seed) if len(sample) else 1)


def cell_search(queries: DataFrame, index: CellIndex, k: int, apart: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` nearest vectors by cosine, among the cells that each of ``queries`` (query_id, embedding) is sent to.

    Scores are those of the exact search.  With ``apart`` a query does not find
    the vector that has its own id.  Queries without a vector of the index's
    length find nothing.
    """
    centres, length = index.centres, index.centres.shape[1]
    kinds = {name: kind for name, kind in (*queries.select("query_id").dtypes, *index.vectors.dtypes)}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == length)
    found = None
    for block in in_blocks(asked, "query_id"):
        rows = block.collect()  # bounded by the block's size
        if not rows:
            continue
        ids, q = [row["query_id"] for row in rows], _unit(np.array([row["embedding"] for row in rows], np.float64))
        sent = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, : index.probes]
        by_cell = {cell: np.flatnonzero((sent == cell).any(axis=1)) for cell in np.unique(sent).tolist()}

        def near(batches: Iterator[pa.RecordBatch], ids=ids, q=q, by_cell=by_cell) -> Iterator[pa.RecordBatch]:
            pools: list[list[tuple[float, object]]] = [[] for _ in ids]
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                vectors = _unit(np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, length))
                names = np.array(batch.column("doc_id").to_pylist(), object)
                for one in np.unique(cell).tolist():
                    mine, asking = np.flatnonzero(cell == one), by_cell[one]
                    scores = np.round(q[asking] @ vectors[mine].T, 6) + 0.0
                    for at, row in zip(asking.tolist(), scores, strict=True):
                        keep = names[mine] != ids[at] if apart else np.ones(len(mine), bool)
                        least = pools[at][-1][0] if len(pools[at]) == k else np.inf
                        keep &= -row <= least
                        pools[at] = sorted(pools[at] + list(zip((-row[keep]).tolist(), names[mine][keep].tolist(), strict=True)))[:k]
            hits = [(ids[at], doc, -score) for at, pool in enumerate(pools) for score, doc in pool]
            if hits:
                yield pa.RecordBatch.from_pydict({"query_id": [h[0] for h in hits], "doc_id": [h[1] for h in hits], "score": [h[2] for h in hits]})

        read = index.vectors.where(F.col("cell").isin(list(by_cell)))
        best = read.mapInArrow(near, schema)
        found = best if found is None else found.unionByName(best)
    # One ranking over all blocks: a task holds one sort, not one for each block.
    return top_k(found, k) if found is not None else queries.sparkSession.createDataFrame([], f"{schema}, rank int")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the ``exact`` hits (query_id, doc_id) that were ``found``; null where there are none."""
    hit = found.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return exact.select("query_id", "doc_id").distinct().join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
