"""Whitening against plain eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, scale=1024, shift=100_000):
    x = np.array([[int(np.floor(float(np.float32(c)) * scale)) + shift for c in v] for _, v in rows], dtype=object)
    n = len(x)
    sums = x.sum(axis=0)
    away = n * x - sums
    cov = (away.T @ away).astype(float) / n**3 * 1.0
    values, units = np.linalg.eigh(cov)
    return n, (away**2).sum(axis=1), cov, values[::-1], units[:, ::-1], away.astype(float) / n


def check(out, rows, components=8):
    n, deviation, cov, values, units, centred = plain(rows)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    k = min(components, len(values))
    assert sorted(got) == sorted(i for i, _ in rows)
    for at, (i, _) in enumerate(rows):
        mine = got[i]
        assert sorted(mine) == list(range(1, k + 1))
        assert {r["n"] for r in mine.values()} == {n} and {int(r["deviation"]) for r in mine.values()} == {deviation[at]}
        w = np.array([mine[c]["whitened"] for c in range(1, k + 1)])
        want = centred[at] @ units[:, :k] / np.sqrt(values[:k])
        assert np.allclose(np.abs(w), np.abs(want), rtol=1e-6, atol=1e-7)
        assert np.allclose([mine[c]["explained"] for c in range(1, k + 1)], values[:k] / np.trace(cov), rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine.values())


def test_factor_and_rotations_give_eigenvectors():
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 17, 40):
        a = rng.standard_normal((size, size + 3)) * 10.0 ** rng.integers(-3, 3, size)[:, None]
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, rtol=1e-12, atol=1e-12 * np.abs(v).max())
        values, units = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-8)
        assert np.allclose(units.T @ units, np.eye(size), atol=1e-12)
        assert np.allclose(v @ units, units * values, atol=1e-9 * values[0])


def test_pivots_show_the_rank():
    a = np.random.default_rng(6).standard_normal((9, 4))
    assert whitening.pivoted_cholesky(a @ a.T).shape == (9, 4)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_every_pair_meets_once():
    for count in (2, 4, 10):
        met = [tuple(sorted(pair)) for p, q in whitening.rounds(count) for pair in zip(p.tolist(), q.tolist(), strict=True)]
        assert len(met) == len(set(met)) == count * (count - 1) // 2


def test_products_are_exact_beyond_floats():
    d = np.array([[3, -(2**30)], [2**36 + 1, 7]])
    want = [[9 + (2**36 + 1) ** 2, -3 * 2**30 + 7 * (2**36 + 1)]] * 2
    assert whitening.products(d)[0].tolist() == want[0]


def test_whole_table(spark):
    out = queries.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes)["deviation"] == "bigint"
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    check(out.collect(), [(r["vec_id"], r["embedding"]) for r in table])


def test_unsound_rows_take_no_part(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(3)]) for i in range(20)]
    rows += [(100, rows[3][1]), (101, rows[3][1])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [1.0, 2.0]), (55, [float("inf"), 0.0, 0.0]),
           (56, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], SCHEMA).withColumn("component", F.lit("x")).withColumn("v", F.lit(1))
    check(whitening.whiten(df.repartition(5)).collect(), rows)
    doubled = whitening.whiten(df.unionByName(df.filter("vec_id is null or vec_id < 2").withColumn("vec_id", F.lit(None).cast("long"))))
    assert doubled.filter("vec_id is null").count() == 6 and doubled.first()["n"] == 24


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    out = whitening.whiten(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA))
    assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_components_end_at_the_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(out) == 6 and {r["component"] for r in out} == {1} and abs(out[0]["explained"] - 1) < 1e-12
