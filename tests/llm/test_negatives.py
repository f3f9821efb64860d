"""Hard negatives against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, count=10, low=30, high=90):
    sound = [(i, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, lab in rows
             if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) and abs(c) < 2**16 for c in v)]
    out = []
    for at, (i, lab, q) in enumerate(sound):
        if not is_anchor(i):
            continue
        scored = [(-sum(map(int.__mul__, q, x)), j, other) for k, (j, other, x) in enumerate(sound) if k != at and len(x) == len(q)]
        for p, j, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            fit = sorted(s for s in scored if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p)
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(fit[:count], 1)]
    return sorted(out)


def vectors(seed, n, size, labels, copies=0.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    rows = []
    for i in range(n):
        lab = rng.randrange(labels)
        v = rows[rng.randrange(len(rows))][1] if rows and rng.random() < copies else [c / 2 + rng.gauss(0, 0.4) for c in centres[lab]]
        rows.append((i, v, lab))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "size", "labels", "copies"), [(1, 400, 6, 4, 0.0), (2, 300, 2, 3, 0.5), (3, 150, 1, 2, 0.2), (4, 120, 9, 60, 0.9)])
def test_same_as_a_plain_search(spark, seed, n, size, labels, copies):
    rows = vectors(seed, n, size, labels, copies)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # Small tiles, leaves and boxes, so that all levels of the tree and several slabs are used.
    out = negatives.mine(df, F.col("i") % 10 == 0, tile=40, leaf=4, fan=3)
    assert sorted(map(tuple, out.collect())) == plain(rows, lambda i: i % 10 == 0)


def test_boxes_apart_are_not_opened(tmp_path):
    """Clusters far apart: a search reads few leaves, and still finds what a plain one does."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (40, 4))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 21, (4000, 4))).astype(np.int64)
    labels, ids = rng.integers(0, 3, 4000), np.arange(4000)
    order = negatives.str_order(x, labels, 16)
    assert sorted(order.tolist()) == list(range(4000))
    at = str(tmp_path / "4" / "0")
    root = negatives.write_tile(at, ids[order], labels[order], x[order], 16, 8)
    boxes = root.reshape(1, -1).copy()
    boxes[0, 3] = 0
    (tmp_path / "4" / "top").write_bytes(boxes.tobytes())
    forest = negatives.Forest(str(tmp_path), [(4, 1)])

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice) and self.ndim == 2:
                Counted.read += key.stop - key.start
            return super().__getitem__(key)

    tile = forest.tile(4, 0)
    tile.rows = np.array(tile.rows).view(Counted)
    q = x[7].astype(float)
    got = forest.best(q, [(-negatives.NOWHERE, negatives.NOWHERE)], 10, int(labels[7]), True)[0]
    mine = labels == labels[7]
    assert got == sorted(((int(s), int(i)) for s, i in zip((x @ x[7])[mine], ids[mine], strict=True)), key=lambda h: (-h[0], h[1]))[:10]
    assert 0 < Counted.read < 1000


def test_odd_rows(spark):
    rows = vectors(9, 40, 3, 2)
    odd = [(None, [1.0, 0.0, 0.0], 1), (100, None, 1), (101, [], 1), (102, [1.0, None, 0.0], 1), (103, [float("nan"), 0.0, 0.0], 1),
           (104, [1.0, 0.0, 0.0], None), (110, [1.0, 0.0], 0), (120, [0.5, 0.1], 0), (111, [0.3, 0.1], 1), (105, [float("inf"), 0.0, 0.0], 0),
           (106, [3e38, 0.0, 0.0], 0), (130, [0.0, 0.0, 0.0], 1)]
    rows = rows + odd + rows[:12] + rows[:3]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumn("i", F.lit("x")).withColumn("v", F.lit(None).cast("int")).withColumn("size", F.lit(1))
    out = negatives.mine(df, F.col("i") % 10 == 0, tile=30, leaf=4, fan=2)
    assert sorted(map(tuple, out.collect())) == plain(rows, lambda i: i % 10 == 0)


def test_empty_tables_and_single_rows(spark):
    for rows in ([], [(0, [1.0], 0)], [(0, None, None)], [(0, [1.0], 0), (1, [1.0], 1)]):
        assert negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("i") % 10 == 0).collect() == []


def test_a_missing_tile_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        negatives.Tile(str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        negatives.Forest(str(tmp_path), [(4, 1)]).top(4)
