"""Hard-negative mining by an STR-packed R-tree over integer vectors, searched best-first by inner product.

1. Packing. Spark deals the rows into tiles in sort-tile order: slabs of one coordinate (by mergeable quantiles), then ranges
   of a second one inside the slabs, with a hash behind them so that equal coordinates can be split. A task sorts and tiles
   its rows along further coordinates into leaves, and packs boxes over boxes: least and largest value of every coordinate,
   labels, smallest id. A tile is a file of rows in leaf order and one of boxes in the shared folder.
2. Search. Anchors are dealt to tasks by hash. A box gives each coordinate of the anchor an interval of products, so its rows'
   scores lie between two sums. A queue opens the box of the largest upper bound first. A box is dropped if its interval misses
   the score window, if its labels can't serve, or if its upper bound is strictly below the kth score found (at an equal bound,
   if its smallest id is larger than the kth). Tiles are mapped, so a task holds the boxes above the tiles and what it opens.

The search is exact: bounds and scores are integers, so nothing in a dropped box could have been returned. Where vectors are
unrelated in all coordinates boxes overlap and few are dropped; an anchor then reads all rows, as a plain search would.

Defined results: rows with a null id, a null label, a null or empty vector, null or non-finite components, or components of
2**24 or more in size after scaling (their products fit no long) take no part; vectors of different lengths aren't
compared. Repeated rows are rows of their own: each is an anchor, each can be a positive of the other, and each is returned.
Ties go to the smaller id. An anchor without positives, or a window without rows, returns nothing; so does an empty table.
Texts don't occur; other columns don't matter, and may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.store import mapped, new_folder, put
from harborwatch.session import staged

#: Rows of a tile and of a leaf, boxes under a box.
TILE, LEAF, FAN = 65_536, 128, 32
#: Components this large take no part.
LARGEST = 2.0**24
_ROWS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(i, label, size, v array<int>) of the rows that take part."""
    wide = df.select(
        F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("long").alias("label"),
        F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("d"),
    ).filter("i is not null and label is not null and size(d) > 0")
    wide = wide.filter(F.forall("d", lambda c: F.coalesce((F.abs(c) < LARGEST) & ~F.isnan(c), F.lit(False))))
    return wide.select("i", "label", F.size("d").alias("size"), F.col("d").cast("array<int>").alias("v"))


# ---- packing


def str_order(x: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
    """Row order of a tile: labels first, then slabs of the widest coordinates in turn, down to a leaf."""

    def order(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth >= len(widest):
            return [rows]
        rows = rows[np.argsort(x[rows, widest[depth]], kind="stable")]
        slabs = int(np.ceil(np.sqrt(leaves))) if depth + 1 < len(widest) else leaves
        step = -(-leaves // slabs) * leaf
        return [part for k in range(0, len(rows), step) for part in order(rows[k : k + step], depth + 1)]

    widest = np.argsort(-x.var(axis=0), kind="stable")[:8]
    out = []
    rows = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[rows])) + 1
    for group in np.split(rows, cuts):
        out += order(group, 0) if len(group) > leaf else [group]
    return np.concatenate(out)


class Boxes:
    """One level of a tree: bounds of the coordinates, of labels, the smallest id, and the children's range."""

    def __init__(self, low, high, label_low, label_high, least_id, first, last):
        self.low, self.high, self.label_low, self.label_high = low, high, label_low, label_high
        self.least_id, self.first, self.last = least_id, first, last

    def packed(self, fan: int) -> "Boxes":
        """The boxes over each run of ``fan`` boxes."""
        first = np.arange(0, len(self.first), fan)
        last = np.append(first[1:], len(self.first))
        return Boxes(
            np.minimum.reduceat(self.low, first), np.maximum.reduceat(self.high, first), np.minimum.reduceat(self.label_low, first),
            np.maximum.reduceat(self.label_high, first), np.minimum.reduceat(self.least_id, first), first, last,
        )

    def array(self) -> np.ndarray:
        """One row of int64 for each box."""
        return np.column_stack([self.label_low, self.label_high, self.least_id, self.first, self.last, self.low, self.high]).astype("<i8")

    @staticmethod
    def of(array: np.ndarray) -> "Boxes":
        size = (array.shape[1] - 5) // 2
        return Boxes(array[:, 5 : 5 + size], array[:, 5 + size :], *(array[:, k] for k in range(5)))

    def intervals(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product with the rows of each box."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        low, high = self.low[rows], self.high[rows]
        return low @ plus + high @ minus, high @ plus + low @ minus


def levels(x: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int, fan: int) -> list[Boxes]:
    """Boxes of rows in leaf order, leaves first, up to one box."""
    first = np.arange(0, len(x), leaf)
    last = np.append(first[1:], len(x))
    out = [Boxes(
        np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.minimum.reduceat(labels, first),
        np.maximum.reduceat(labels, first), np.minimum.reduceat(ids, first), first, last,
    )]
    while len(out[-1].first) > 1:
        out.append(out[-1].packed(fan))
    return out


def write_tile(at: str, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int, fan: int) -> np.ndarray:
    """Write a tile's files; the root box."""
    tree = levels(x, labels, ids, leaf, fan)
    sizes = [len(t.first) for t in tree]
    put(f"{at}.rows", [x.astype("<i4").tobytes()])
    put(f"{at}.names", [np.column_stack([ids, labels]).astype("<i8").tobytes()])
    put(f"{at}.boxes", [np.array([len(sizes), x.shape[1], len(x), *sizes], "<i8").tobytes(), *(t.array().tobytes() for t in tree)])
    return tree[-1].array()[0]


def spread(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of rows and variance of each coordinate, by vector length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                x = vectors_of(batch.column(1).filter(pa.array(sizes == size)), size).astype(np.float64)
                total[size] = total.get(size, 0.0) + np.vstack([np.ones(size) * len(x), x.sum(axis=0), (x * x).sum(axis=0)])
        for size, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), *map(pa.array, t)], names)

    names = ["size", "cell", "n", "one", "two"]
    parts = rows.select("size", "v").mapInArrow(add, "size long, cell long, n double, one double, two double")
    found: dict[int, list] = {}
    for r in parts.groupBy("size", "cell").agg(*(F.sum(c).alias(c) for c in names[2:])).orderBy("size", "cell").collect():
        found.setdefault(r["size"], []).append((r["n"], r["two"] / r["n"] - (r["one"] / r["n"]) ** 2))
    return {size: (int(cells[0][0]), np.array([v for _, v in cells])) for size, cells in found.items()}


def vectors_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), size)


def build(rows: DataFrame, folder: str, tile: int = TILE, leaf: int = LEAF, fan: int = FAN) -> list[tuple[int, int]]:
    """Write the tiles and the boxes over them. Returns (vector length, number of tiles) of each tree."""
    made = []
    for size, (n, variance) in sorted(spread(rows).items()):
        mine = rows.filter(F.col("size") == size)
        tiles = -(-n // tile)
        slabs = int(np.ceil(np.sqrt(tiles)))
        widest = np.argsort(-variance, kind="stable")[:2].tolist()
        a, b = F.col("v")[widest[0]], F.col("v")[widest[-1]]
        slab = F.lit(0)
        if slabs > 1:
            cuts = mine.agg(F.percentile_approx(a, [k / slabs for k in range(1, slabs)], 1000)).collect()[0][0]
            slab = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda cut: cut < a))
        dealt = mine.select("i", "label", "v", slab.alias("slab"), b.alias("b"), F.monotonically_increasing_id().alias("h"))
        dealt = dealt.repartitionByRange(tiles, "slab", "b", "h").select("i", "label", "v")

        def write(batches: Iterator[pa.RecordBatch], size=size) -> Iterator[pa.RecordBatch]:
            held = [batch for batch in batches if len(batch)]  # a range of about ``tile`` rows
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels = (table.column(k).to_numpy() for k in (0, 1))
            x = vectors_of(table.column(2).combine_chunks(), size)
            order = str_order(x, labels, leaf)
            number = TaskContext.get().partitionId()
            root = write_tile(f"{folder}/{size}/{number}", ids[order], labels[order], x[order].astype(np.int64), leaf, fan)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([root.tolist()], pa.list_(pa.int64()))], ["tile", "box"])

        def top(batches: Iterator[pa.RecordBatch], size=size) -> Iterator[pa.RecordBatch]:
            """The boxes of all tiles, in tile order: one for ``tile`` rows."""
            found = sorted((t, b) for batch in batches for t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if found:
                boxes = np.array([b for _, b in found], "<i8")
                boxes[:, 3] = [t for t, _ in found]  # the tile's name in place of its children
                put(f"{folder}/{size}/top", [boxes.tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], ["n"])

        roots = staged(dealt.mapInArrow(write, "tile long, box array<long>"), "negatives-roots")
        made.append((size, roots.repartition(1).mapInArrow(top, "n long").agg(F.sum("n")).collect()[0][0]))
    return made


# ---- search


class Tile:
    """A mapped tile."""

    def __init__(self, at: str):
        raw = mapped(f"{at}.boxes", "<i8")
        if not len(raw):
            raise FileNotFoundError(f"a tile of the tree is missing: {at}")
        depth, size, n = (int(v) for v in raw[:3])
        counts, k = raw[3 : 3 + depth].tolist(), 3 + depth
        self.levels = []
        for count in counts:
            self.levels.append(Boxes.of(raw[k : k + count * (5 + 2 * size)].reshape(count, 5 + 2 * size)))
            k += count * (5 + 2 * size)
        self.rows = mapped(f"{at}.rows", "<i4").reshape(n, size)
        self.names = mapped(f"{at}.names", "<i8").reshape(n, 2)


class Forest:
    """The trees of one folder, opened as a task needs them."""

    def __init__(self, folder: str, shapes: list[tuple[int, int]]):
        self.folder, self.shapes, self._top, self._tiles = folder, dict(shapes), {}, {}

    def __getstate__(self):
        return {"folder": self.folder, "shapes": self.shapes, "_top": {}, "_tiles": {}}

    def top(self, size: int) -> Boxes:
        if size not in self._top:
            raw = mapped(f"{self.folder}/{size}/top", "<i8")
            if len(raw) != self.shapes[size] * (5 + 2 * size):
                raise FileNotFoundError(f"the boxes of the tree in {self.folder}/{size} are missing or cut")
            self._top[size] = Boxes.of(raw.reshape(-1, 5 + 2 * size))
        return self._top[size]

    def tile(self, size: int, number: int) -> Tile:
        if (size, number) not in self._tiles:
            self._tiles[size, number] = Tile(f"{self.folder}/{size}/{number}")
        return self._tiles[size, number]

    def best(self, q: np.ndarray, windows: list[tuple[int, int]], count: int, label: int, same: bool) -> list[list[tuple[int, int]]]:
        """For each score window (low, high) the first ``count`` (score, id) of rows of that label, or of the others."""
        size = len(q)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]  # (-score, id), sorted, ``count`` at most
        floor, ceiling = min(w[0] for w in windows), max(w[1] for w in windows)
        q64 = q.astype(np.int64)
        queue: list = []
        serial = 0

        def wanted(low: int, high: int, least_id: int) -> bool:
            for (a, b), have in zip(windows, found, strict=True):
                if high < a or low > b:
                    continue
                if len(have) < count or (-min(high, b), least_id) <= have[-1]:
                    return True
            return False

        def push(boxes: Boxes, rows: slice, where: tuple) -> None:
            nonlocal serial
            lows, highs = boxes.intervals(q64, rows)
            if same:
                serves = (boxes.label_low[rows] <= label) & (boxes.label_high[rows] >= label)
            else:
                serves = (boxes.label_low[rows] != label) | (boxes.label_high[rows] != label)
            serves &= (highs >= floor) & (lows <= ceiling)
            for k in np.flatnonzero(serves).tolist():
                low, high, least = int(lows[k]), int(highs[k]), int(boxes.least_id[rows.start + k])
                if wanted(low, high, least):
                    serial += 1
                    heapq.heappush(queue, (-min(high, ceiling), least, serial, low, high, boxes, rows.start + k, where))

        top = self.top(size)
        push(top, slice(0, len(top.first)), (None, -1))
        while queue:
            _, least, _, low, high, boxes, k, (tile, level) = heapq.heappop(queue)
            if not wanted(low, high, least):
                continue
            first, last = int(boxes.first[k]), int(boxes.last[k])
            if tile is None:
                tile = self.tile(size, first)
                level = len(tile.levels)
                push(tile.levels[-1], slice(0, 1), (tile, level - 1))
            elif level > 0:
                push(tile.levels[level - 1], slice(first, last), (tile, level - 1))
            else:
                scores = tile.rows[first:last].astype(np.float64) @ q if exact(tile.rows.shape[1], q) else tile.rows[first:last].astype(np.int64) @ q64
                keep = (scores >= floor) & (scores <= ceiling) & ((tile.names[first:last, 1] == label) == same)
                if keep.any():
                    hits = sorted(zip((-scores[keep].astype(np.int64)).tolist(), tile.names[first:last, 0][keep].tolist(), strict=True))
                    for w, (a, b) in enumerate(windows):
                        mine = [h for h in hits if a <= -h[0] <= b]
                        if mine:
                            found[w] = sorted(found[w] + mine)[:count]
        return [[(-s, i) for s, i in have] for have in found]


def exact(size: int, q: np.ndarray) -> bool:
    """Whether floats hold every sum of products with a row."""
    return float(np.abs(q).max(initial=0)) * LARGEST * size < 2.0**53


#: Below and above every score.
NOWHERE = 2**63 - 1


def mine_one(forest: Forest, anchor: int, label: int, q: np.ndarray, positives: int, negatives: int, low: int, high: int) -> list[tuple]:
    """Rows of one anchor."""
    own = int(q.astype(np.int64) @ q.astype(np.int64))
    q = q.astype(np.float64)
    near = forest.best(q, [(-NOWHERE, NOWHERE)], positives + 1, label, True)[0]
    # The anchor itself is one of the rows of its id and score; where it isn't among the first, one is too many.
    if (own, anchor) in near:
        near.remove((own, anchor))
    near = near[:positives]
    if not near:
        return []
    windows = [(-(-low * score // 100), high * score // 100) for score, _ in near]
    out = []
    for (score, positive), have in zip(near, forest.best(q, windows, negatives, label, False), strict=True):
        out += [(anchor, positive, rank, i, score, s) for rank, (s, i) in enumerate(have, 1)]
    return out


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", tile: int = TILE, leaf: int = LEAF, fan: int = FAN,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``i``, the id. A negative of a positive has another label than the anchor and
    between ``low`` and ``high`` percent of the positive's score.
    """
    spark = vectors.sparkSession
    rows = staged(integers(vectors, id_col, label_col, vector_col, scale), "negatives-rows")
    folder = new_folder(spark, "negatives-tree")
    forest = Forest(folder, build(rows, folder, tile, leaf, fan))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(2)
            values, ends = vector.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(vector).to_pylist()])
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            out = [r for k, (i, label) in enumerate(names)
                   for r in mine_one(forest, i, label, values[ends[k] : ends[k + 1]], positives, negatives, low, high)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.filter(anchors).select("i", "label", "v").repartition(tasks).mapInArrow(search, _ROWS)
