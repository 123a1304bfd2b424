"""Operator 13: centroid clustering by dimension-sharded Lloyd rounds.

The vectors are cut into groups of rows and blocks of columns (shards).  In
each round a task on a shard computes the exact partial distances of its rows to
its slice of the centroids; the blocks of a group are added up and the nearest
centroid taken; every shard then adds its own columns up by cluster, and the
task of a column block updates its own slice of the centroids.

All arithmetic is on integers: 64 bits where the largest possible distance
fits, Python's own integers otherwise.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut

Centroids = list[list[int]]
SHARDS = "rows string, block int, ids binary, part binary"


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly, in the smallest integers that hold it."""
    if x.size == 0 or np.abs(x).max() < 2.0**62 / scale and math.log2(scale).is_integer():
        q = np.floor(x * scale).astype(np.int64)
        most = int(np.abs(q).max(initial=0))
        return q.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
    exact = [(v.as_integer_ratio()) for v in x.ravel().tolist()]
    return np.array([scale * a // b for a, b in exact] + [None], object)[:-1].reshape(x.shape)


def _wide(q: np.ndarray, most: int) -> np.ndarray:
    """As 64-bit integers if a value of size ``most`` fits, else as Python integers."""
    return q.astype(np.int64 if most < 1 << 62 else object)


def _largest(q: np.ndarray) -> int:
    return max(abs(int(q.min())), abs(int(q.max()))) if q.size else 0


def _shards(dims: int, blocks: int, group: int, scale: int):
    """Rows of all usable vectors by groups, one row per column block."""
    cuts = [dims * b // blocks for b in range(blocks + 1)]

    def out(name: str, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        q = quantise(np.concatenate(vectors), scale)
        whole = pickle.dumps(np.concatenate(ids))
        # the ids go with the first block alone
        own = [whole] + [None] * (blocks - 1)
        parts = [pickle.dumps(np.ascontiguousarray(q[:, a:b])) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * blocks), pa.array(range(blocks), pa.int32()), pa.array(own, pa.binary()), pa.array(parts, pa.binary())], ["rows", "block", "ids", "part"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                rows = batch.slice(at, group)
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                yield out(f"{task}-{made}", [np.array(rows.column(0).to_pylist(), object)], [x])
                made += 1

    return run


def _partial(slices: dict[int, Centroids], dims: int):
    """Distances of a shard's rows to its slice of every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for name, block, part in zip(batch.column("rows").to_pylist(), batch.column("block").to_pylist(), batch.column("part").to_pylist()):
                q, c = pickle.loads(part), np.array(slices[block], object)
                span = _largest(q) + _largest(c)
                q, c = _wide(q, dims * span * span), _wide(c, dims * span * span)
                names.append(name)
                parts.append(pickle.dumps(np.stack([((q - row) ** 2).sum(1) for row in c], 1)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["rows", "part"])

    return run


def _nearest(table: pa.Table) -> pa.Table:
    """Blocks of one group of rows added up; the nearest centroid of each row."""
    total = 0
    for part in table["part"].to_pylist():
        total = total + pickle.loads(part)
    nearest = total.argmin(1)
    distance = total[np.arange(len(nearest)), nearest]
    return pa.table({"rows": table["rows"][:1], "nearest": pa.array([pickle.dumps((nearest.astype(np.int32), distance))], pa.binary())})


def _sums(k: int):
    """Per task, block and cluster: the rows and the sum of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for block, part, nearest in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("nearest").to_pylist()):
                q, (mine, _) = pickle.loads(part), pickle.loads(nearest)
                q = _wide(q, _largest(q) * len(q))
                counts, sums = found.setdefault(block, [[0] * k, np.zeros((k, q.shape[1]), object)])
                for c in np.unique(mine).tolist():
                    rows = q[mine == c]
                    counts[c] += len(rows)
                    sums[c] += rows.sum(0).astype(object)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array([pickle.dumps(v) for v in found.values()], pa.binary())], ["block", "sums"]
            )

    return run


def _update(slices: dict[int, Centroids]):
    """The new slice of one column block: exact floors of the means, an empty
    cluster's slice as it was."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        counts, sums = 0, 0
        for each in table["sums"].to_pylist():
            c, s = pickle.loads(each)
            counts, sums = counts + np.array(c, object), sums + s
        new = [[v // n for v in row] if n else old for n, row, old in zip(counts.tolist(), sums.tolist(), slices[block])]
        return pa.table({"block": table["block"][:1], "part": pa.array([pickle.dumps(new)], pa.binary())})

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector: id, cluster, distance (as text)."""
    for batch in batches:
        for ids, nearest in zip(batch.column("ids").to_pylist(), batch.column("nearest").to_pylist()):
            names, (mine, distance) = pickle.loads(ids), pickle.loads(nearest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.tolist(), pa.int64()), pa.array(mine, pa.int32()), pa.array([str(d) for d in distance.tolist()])], ["vec_id", "cluster", "distance"]
            )


def usable(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of vectors of ``dims`` finite components."""
    v = F.col(vector_col).cast("array<double>")
    big = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))
    return rows.filter((F.size("embedding") == dims) & sound)


def first_centroids(kept: DataFrame, k: int, salt: str, scale: int) -> Centroids:
    """The vectors of the ``k`` smallest hashes of ``salt`` and the id, ties by
    the vector; a vector without an id has no hash and comes last."""
    chosen = kept.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    rows = chosen.orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).collect()
    return [quantise(np.array(r.embedding, np.float64), scale).tolist() for r in rows]


def lloyd(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, blocks: int = 4, scale: int = 1024, salt: str = "3:", group: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance as decimal text) of every usable vector, and the final centroids.

    Vectors that are NULL, have another number of components than ``dims``, or
    hold NULL or non-finite ones are left out.  The rest become integers
    floor(``scale`` * x).  Ties go to the smaller cluster number; repeated rows
    are vectors of their own; with fewer vectors than ``k`` each is a
    centroid; an empty table gives no rows and no centroids; other columns are
    ignored whatever their names.  The shards are written once under the
    shared folder and every round reads them from there; the driver holds the
    centroids, ``k`` times ``dims`` numbers.
    """
    kept = usable(vectors, dims, id_col, vector_col)
    centroids = first_centroids(kept, k, salt, scale)
    shards = cut(kept.mapInArrow(_shards(dims, blocks, group, scale), SHARDS), "shards")
    cuts = [dims * b // blocks for b in range(blocks + 1)]

    def sliced() -> dict[int, Centroids]:
        return {b: [c[cuts[b] : cuts[b + 1]] for c in centroids] for b in range(blocks)}

    def nearest() -> DataFrame:
        partial = shards.select("rows", "block", "part").mapInArrow(_partial(sliced(), dims), "rows string, part binary")
        return partial.groupBy("rows").applyInArrow(_nearest, "rows string, nearest binary")

    for _ in range(rounds if centroids else 0):
        mine = shards.select("rows", "block", "part").join(nearest(), "rows")
        sums = mine.mapInArrow(_sums(len(centroids)), "block int, sums binary")
        new = sums.groupBy("block").applyInArrow(_update(sliced()), "block int, part binary").collect()
        by_block = {r.block: pickle.loads(r.part) for r in new}
        centroids = [[v for b in range(blocks) for v in by_block[b][c]] for c in range(len(centroids))]
    if not centroids:
        return kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("string").alias("distance")).limit(0), []
    named = shards.filter("block = 0").select("rows", "ids").join(nearest(), "rows")
    return named.mapInArrow(_rows, "vec_id long, cluster int, distance string"), centroids


def report(vectors: DataFrame, **parameters) -> DataFrame:
    """The contract's columns.  A distance or a sum of distances beyond the
    range of a long is NULL."""
    rows, centroids = lloyd(vectors, **parameters)
    rows = cut(rows.select("vec_id", "cluster", F.try_to_number("distance", F.lit("9" * 38)).alias("exact")), "clusters")
    per = rows.groupBy("cluster").agg(F.when(F.count("exact") == F.count("*"), F.try_sum("exact")).alias("s"))
    # one row per centroid
    sums = {r.cluster: r.s for r in per.collect()}
    total = None if None in sums.values() else sum(sums.values())
    digest = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids)}

    def whole(x: int | None) -> int | None:
        return int(x) if x is not None and x < 1 << 63 else None

    spark = vectors.sparkSession
    table = spark.createDataFrame([(c, whole(s), whole(total), digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", F.col("exact").try_cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
