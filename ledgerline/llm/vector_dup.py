"""Operator 2: near-duplicate vectors by collision-counting projections.

Each unit vector is projected on ``projections`` random directions.  Two
vectors collide in one projection if the second lies in the window of
half-width ``window`` centred on the first in that projection's sorted order.
A pair with at least ``least_count`` collisions is verified by its exact
cosine in double precision.  ``least_count`` is calibrated: a pair exactly at
the threshold falls short with probability ``miss`` at most.

Only vectors of one label and length meet.  Large labels are first cut into
cells by ``tables`` tables of ``depth`` quantised projections each; depth is
chosen by a cost model from the size of the largest label, and tables so that
a pair at the threshold shares a cell in none of them with probability
``miss`` at most.  A pair is counted in its first common cell only.
Cells are compared in pairs of hashed blocks, so no cell is gathered.
Equal vectors collapse into one representative first and are counted by
weight; links of blocks leave the task as counts and a spanning star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import block_pairs, connected_components, cut, lowest_reachable


@dataclass(frozen=True)
class VectorDup:
    cosine: float = 0.93
    projections: int = 24
    spread: float = 1.5
    cell_width: float = 4.0
    miss: float = 1e-4
    block_rows: int = 1024
    seed: int = 7

    @property
    def distance(self) -> float:
        """Distance of unit vectors whose cosine is the threshold."""
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def window(self) -> float:
        return self.spread * self.distance

    @property
    def least_count(self) -> int:
        """Largest count that a pair at the threshold reaches with 1 - miss."""
        p, n = math.erf(self.spread / math.sqrt(2)), self.projections
        below, count = 0.0, 0
        while True:
            below += math.comb(n, count) * p**count * (1 - p) ** (n - count)
            if below > self.miss:
                return count
            count += 1

    def same_cell(self, distance: float) -> float:
        """Chance that two vectors share one quantised projection."""
        w = self.cell_width * self.distance / distance
        return math.erf(w / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * w) * (1 - math.exp(-w * w / 2))

    def tables(self, depth: int) -> int:
        hit = self.same_cell(self.distance) ** depth
        return 1 if hit >= 1 else math.ceil(math.log(self.miss) / math.log(1 - hit))

    def depth(self, largest: int) -> int:
        """Depth of least cost for a label of ``largest`` vectors: copies to
        tables (weighed as 2000 compared pairs each) and pairs within cells."""
        far = self.same_cell(math.sqrt(2))
        return min(range(13), key=lambda k: self.tables(k) * (2000 + largest * far**k))


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, size, raw: doubles of usable vectors, else NULL."""
    for batch in batches:
        raw, size = [], []
        for row in batch.column(1):
            v = None
            if row.is_valid and len(row.values) and not row.values.null_count:
                v = np.asarray(row.values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(v).max()
                v = v if np.isfinite(top) and top > 0 else None
            raw.append(None if v is None else (v + 0.0).tobytes())
            size.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "size", "raw"]
        )


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Every vector times the power of two that brings its largest component
    below 1: no product overflows or vanishes, and no digit changes."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _units(raw: np.ndarray) -> np.ndarray:
    scaled = _scaled(raw)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _cells(p: VectorDup, depth: int, tables: int):
    """One row per vector with the cell of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for raw in batch.column(0).to_pylist():
                unit = _units(np.frombuffer(raw)[None, :])[0]
                rng = np.random.default_rng([p.seed, 1, len(unit)])
                if depth:
                    width = p.cell_width * p.distance
                    at = np.floor((rng.standard_normal((tables * depth, len(unit))) @ unit) / width + rng.random(tables * depth))
                    at = at.astype(np.int64).reshape(tables, depth)
                    cells.append([hash(tuple(x)) for x in at.tolist()])
                else:
                    cells.append([0])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], batch.column(0), pa.array(cells, pa.list_(pa.int64()))], ["rep", "copies", "label", "size", "raw", "cells"])

    return run


def _side(rows: list[dict]) -> tuple[np.ndarray, ...]:
    raw = _scaled(np.array([np.frombuffer(x["raw"]) for x in rows]))
    return np.array([x["rep"] for x in rows]), np.array([x["copies"] for x in rows]), raw, np.array([x["cells"] for x in rows])


def _links(p: VectorDup):
    """Rows (id, root, links): weighted link counts, and a star per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, table in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), batch.column("table").to_pylist()):
                yield from linked(left, right, table)

    def linked(left: list[dict], right: list[dict], table: int) -> Iterator[pa.RecordBatch]:
        own = not right
        a_id, a_n, a_raw, a_cell = _side(left)
        b_id, b_n, b_raw, b_cell = (a_id, a_n, a_raw, a_cell) if own else _side(right)
        direction = np.random.default_rng([p.seed, 2, a_raw.shape[1]]).standard_normal((a_raw.shape[1], p.projections))
        a_unit, b_unit = _units(a_raw), _units(b_raw)
        a_at, b_at = a_unit @ direction, b_unit @ direction
        count = np.zeros((len(a_id), len(b_id)), np.uint8)
        for k in range(p.projections):
            order = np.argsort(b_at[:, k])
            rank = np.empty(len(order), np.int16)
            rank[order] = np.arange(len(order), dtype=np.int16)
            line = b_at[order, k]
            low = np.searchsorted(line, a_at[:, k] - p.window, "left").astype(np.int16)
            high = np.searchsorted(line, a_at[:, k] + p.window, "right").astype(np.int16)
            count += (rank >= low[:, None]) & (rank < high[:, None])
        i, j = np.nonzero(count >= p.least_count)
        if own:
            i, j = i[i < j], j[i < j]
        for t in range(table):
            fresh = a_cell[i, t] != b_cell[j, t]
            i, j = i[fresh], j[fresh]
        norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a_raw, b_raw))
        near = []
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536], j[s : s + 65536]
            near.append(np.einsum("ij,ij->i", a_raw[x], b_raw[y]) / (norm_a[x] * norm_b[y]) >= p.cosine)
        keep = np.concatenate(near) if near else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        ids = np.unique(np.concatenate([a_id[i], b_id[j]]))
        x, y = np.searchsorted(ids, a_id[i]), np.searchsorted(ids, b_id[j])
        links = np.bincount(x, b_n[j], len(ids)) + np.bincount(y, a_n[i], len(ids))
        root = lowest_reachable(x, y, len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(links.astype(np.int64))], ["id", "root", "links"])

    return run


def near_vectors(
    vectors: DataFrame, p: VectorDup = VectorDup(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    * Vectors that are NULL, empty, all zero, or hold NULL, NaN or infinite
      components, and vectors without label or id, link with nothing.
    * Vectors of different length do not meet; their scale doesn't matter, from
      the smallest to the largest finite doubles.
    * Rows repeating a vec_id are counted as vectors of their own, but are one
      node of the components.  Extra columns are ignored; empty in, empty out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    label_type = rows.schema["label"].dataType.simpleString()
    rows = cut(rows.mapInArrow(_normalised, f"vec_id long, label {label_type}, size int, raw binary"), "vectors")
    usable = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL")
    reps = cut(usable.groupBy("label", "size", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "representatives")
    largest = reps.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    depth = p.depth(largest)
    cells = reps.select("raw", "rep", "copies", "label", "size").mapInArrow(
        _cells(p, depth, p.tables(depth)), f"rep long, copies long, label {label_type}, size int, raw binary, cells array<long>"
    )
    members = cells.select("*", F.posexplode("cells").alias("table", "cell"))
    pairs = block_pairs(members, ["label", "size", "table", "cell"], "rep", ["rep", "copies", "raw", "cells"], p.block_rows)
    found = cut(pairs.select("left", "right", "table").mapInArrow(_links(p), "id long, root long, links long"), "links")
    components = connected_components(found, "id", "root")
    counts = cut(found.groupBy("id").agg(F.sum("links").alias("links")).join(components, "id", "full"), "counts")
    # several representatives may share an id: sum by id as the node
    of_rep = reps.withColumnRenamed("raw", "v").join(counts.withColumnRenamed("id", "rep"), "rep", "left")
    out = rows.join(of_rep.withColumnsRenamed({"label": "l", "size": "s"}), F.expr("label = l AND size = s AND raw = v AND vec_id IS NOT NULL"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
