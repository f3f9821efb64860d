"""Embedding near-dedup by collision-counting projections.

Two unit vectors of cosine c differ by sqrt(2 - 2c) in length, so on a random Gaussian direction they differ by a normal
amount of that deviation, while unrelated vectors differ by one of about 1.4. Each vector is projected on many such
directions; the rows that a task holds are sorted along one of them, each query looks at its window on it, counts in how
many directions a row falls into its window, and rows whose count passes a calibrated bound are verified by the exact
cosine in double precision. ``bound`` is the largest count that a pair at the threshold reaches with ``recall``.

So that no task sees a whole label, each label is split in halves along further directions until about CELL vectors are in
a cell; a vector is a query in its own cell and a candidate in every cell that its window reaches, so the split loses a
pair only where it leaves the window of a split direction (WIDE deviations). A crowded cell is cut into tiles of queries
and of candidates. Equal vectors of one label are one class with a count. Which pairs are found doesn't depend on order.

Defined results: rows with a null label, and null or zero vectors and vectors with null or non-finite components, have no
links and are kept; vectors of different lengths aren't compared; equal rows are vectors of their own; rows of a null
vec_id link with nothing, as in the query's SQL, and are kept; ties go to the smallest vec_id; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.graph import Joined, components
from harborwatch.llm.near import _whole_groups, group_starts
from harborwatch.session import staged

DIRECTIONS = 24
MOST_SPLITS = 20
CELL, TILE = 512, 256
#: Half widths of the windows, in deviations of a pair at the threshold.
NARROW, WIDE = 2.5, 4.0
BLOCK = 64


def directions(size: int) -> np.ndarray:
    """Shared Gaussian directions for vectors of a size: DIRECTIONS to count on, then MOST_SPLITS to split by."""
    return np.random.default_rng([17, size]).standard_normal((size, DIRECTIONS + MOST_SPLITS))


def bound(recall: float = 0.9999, n: int = DIRECTIONS) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(NARROW / math.sqrt(2))
    tail, count = 0.0, n + 1
    while tail < recall and count > 0:
        count -= 1
        tail += math.comb(n, count) * p**count * (1 - p) ** (n - count)
    return count


def _unit(column: pa.Array) -> np.ndarray:
    values = np.array(column.to_pylist(), dtype=np.float64)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _cells(classes: DataFrame, width: float) -> DataFrame:
    """(grp, cell, home, ...): a row for each cell that a vector's windows reach; ``home`` marks its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            splits = batch.column("splits").to_numpy()
            for size in np.unique(sizes):
                for q in np.unique(splits[sizes == size]):
                    rows = np.flatnonzero((sizes == size) & (splits == q))
                    for at in range(0, len(rows), 5_000):
                        part = rows[at : at + 5_000]
                        taken = batch.take(pa.array(part))
                        p = _unit(taken.column("embedding")) @ directions(int(size))[:, DIRECTIONS : DIRECTIONS + q]
                        cell = np.zeros(len(part), np.int64)
                        owner = np.arange(len(part))
                        for k in range(q):  # grow the list of cells split by split
                            side = (p[:, k] > 0).astype(np.int64)
                            both = np.abs(p[owner, k]) <= width
                            other = cell[both] * 2 + 1 - side[owner[both]]
                            cell = np.concatenate([cell * 2 + side[owner], other])
                            owner = np.concatenate([owner, owner[both]])
                        home = np.zeros(len(owner), dtype=bool)
                        home[: len(part)] = True
                        out = taken.select(["grp", "id", "n", "embedding"]).take(pa.array(owner))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(home), pa.array(np.full(len(owner), q, np.int32))], ["grp", "id", "n", "embedding", "cell", "home", "splits"])

    return classes.select("grp", "id", "n", "embedding", "size", "splits").mapInArrow(run, "grp long, id long, n long, embedding array<double>, cell long, home boolean, splits int")


def _compared(tiles: DataFrame, cosine: float) -> DataFrame:
    """(u, v, n): n links of class u (v null), and links (u, v) that join what is linked."""
    sigma = math.sqrt(2 - 2 * cosine)
    narrow, wide, least = NARROW * sigma, WIDE * sigma, bound()
    keys = ["grp", "cell", "query_tile", "tile"]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for rows in _whole_groups(batches, keys):
            starts = group_starts(rows, keys)
            u, v, n = [], [], []
            for a, b in zip(starts, [*starts[1:], len(rows["id"])], strict=True):
                part = slice(a, b)
                query = rows["query"][part]
                unit = np.array(rows["embedding"][part].tolist(), dtype=np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                ids, weight = rows["id"][part], rows["n"][part]
                p = unit @ directions(unit.shape[1])[:, : DIRECTIONS + int(rows["splits"][a])]
                order = np.argsort(p[:, 0], kind="stable")
                asks, others = order[query[order]], order[~query[order]]
                along = p[others, 0]
                for k in range(0, len(asks), BLOCK):
                    ask = asks[k : k + BLOCK]
                    lo, hi = np.searchsorted(along, [p[ask[0], 0] - wide, p[ask[-1], 0] + wide])
                    some = others[lo:hi]
                    if not len(some):
                        continue
                    count = np.zeros((len(ask), len(some)), dtype=np.int8)
                    for d in range(DIRECTIONS):
                        count += np.abs(p[ask, d][:, None] - p[some, d]) <= narrow
                    count[ids[ask][:, None] == ids[some]] = 0
                    for d in range(DIRECTIONS, p.shape[1]):
                        count[np.abs(p[ask, d][:, None] - p[some, d]) > wide] = 0
                    x, y = np.nonzero(count >= least)
                    linked = np.einsum("ij,ij->i", unit[ask[x]], unit[some[y]]) >= cosine
                    x, y = ask[x[linked]], some[y[linked]]
                    if len(x):
                        at, inverse = np.unique(x, return_inverse=True)
                        u.extend(ids[at].tolist())
                        v.extend([None] * len(at))
                        n.extend(np.bincount(inverse, weight[y]).astype(np.int64).tolist())
                        for i, j in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
                            if joined.join(i, j):
                                u.append(i)
                                v.append(j)
                                n.append(0)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return tiles.mapInArrow(run, "u long, v long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    good = marked.filter("sound").withColumn("size", F.size("embedding")).withColumn("grp", F.xxhash64("label", "size")).withColumn("same", F.xxhash64("label", "embedding"))
    # Equal vectors of a label are one class; its id is their smallest.
    classes = staged(good.groupBy("grp", "size", "same", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    per = classes.groupBy("grp").agg(F.count("*").alias("members"))
    splits = F.least(F.lit(MOST_SPLITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("members") / CELL)).cast("int")))
    cells = staged(_cells(classes.join(per.select("grp", splits.alias("splits")), "grp"), WIDE * math.sqrt(2 - 2 * cosine)), "cells")
    crowd = cells.groupBy("grp", "cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("all")).filter("homes > 0")
    placed = cells.join(crowd, ["grp", "cell"]).withColumn("query_tiles", F.ceil(F.col("homes") / TILE).cast("int")).withColumn("tiles", F.ceil(F.col("all") / TILE).cast("int"))
    mine = F.pmod(F.xxhash64("id"), "query_tiles").cast("int")
    its = F.pmod(F.xxhash64(F.lit(1), "id"), "tiles").cast("int")
    asks = placed.filter("home").select("grp", "cell", mine.alias("query_tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("query"), "id", "n", "embedding", "splits")
    others = placed.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("query_tiles") - 1)).alias("query_tile"), its.alias("tile"), F.lit(False).alias("query"), "id", "n", "embedding", "splits")
    keys = ["grp", "cell", "query_tile", "tile"]
    tiles = asks.unionByName(others).repartition(*keys).sortWithinPartitions(*keys, "id")
    found = staged(_compared(tiles, cosine), "vector-links")
    counts = found.filter("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("v is not null").select("u", "v"), "vector-edges").withColumnRenamed("node", "id")
    known = classes.select("grp", "same", "id", "n").join(counts, "id", "left").join(roots, "id", "left")
    known = known.select("grp", "same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    keyed = marked.withColumn("grp", F.when(F.col("sound"), F.xxhash64("label", F.size("embedding")))).withColumn("same", F.when(F.col("sound"), F.xxhash64("label", "embedding")))
    out = keyed.select("vec_id", "grp", "same").join(known, ["grp", "same"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
