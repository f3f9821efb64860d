"""Histories, deadness, check points, look-ups, table maintenance and audits."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harborwatch.operators import audit, origins, replay, tables
from harborwatch.plans import skew
from harborwatch.plans.skew import SALTS_CONF, pick_top, spread_join
from harborwatch.schemas import PATH_COLUMNS, TABLES

NOW = datetime(2024, 1, 31)
H12 = timedelta(hours=12)


def as_of():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def table(spark, name, rows):
    schema = TABLES[name]
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def history(spark, rows):
    return table(spark, "origin_history", [
        {"_id_origin_history": i, "additional_infos": x, "updated_time": t, "_id_origin": o} for i, (o, t, x) in enumerate(rows)
    ])


def origin(spark, *rows):
    return table(spark, "origin", [{"_id_origin": i, "domain": f"d{i}", "category": 1, **r} for i, r in enumerate(rows)])


def test_exactly_twelve_hours_is_fresh(spark):
    h = history(spark, [(0, NOW - H12, "a"), (1, NOW - H12 - timedelta(milliseconds=1), "a")])
    assert [r["_id_origin"] for r in origins.stale_origins(h, as_of()).collect()] == [1]


def test_latest_history_keeps_ties_and_drops_other_categories(spark):
    h = history(spark, [(0, NOW, "a"), (0, NOW, "b"), (0, NOW - H12, "c"), (1, NOW, "d")])
    o = origin(spark, {}, {"category": 0}, {})
    assert sorted(r["additional_infos"] for r in origins.latest_history(o, h).collect()) == ["a", "b"]
    assert [r["additional_infos"] for r in origins.latest_history(o, h, None, ties=False).orderBy("_id_origin").collect()] == ["b", "d"]


def refreshed(spark, rows, checks, **kw):
    c = spark.createDataFrame(checks, "_id_origin long, additional_infos string")
    got = origins.refresh_history(history(spark, rows), c, as_of(), **kw).collect()
    return sorted((r["_id_origin"], r["additional_infos"], r["updated_time"]) for r in got)


OLD = NOW - timedelta(days=1)


def test_refresh_moves_adds_or_leaves(spark):
    rows = [(0, OLD, "same"), (1, OLD, "old"), (2, NOW, "old"), (3, OLD, "unchecked"), (0, OLD - H12, "older")]
    checks = [(0, "same"), (1, "new"), (2, "new")]
    assert refreshed(spark, rows, checks) == [
        (0, "older", OLD - H12), (0, "same", NOW), (1, "new", NOW), (1, "old", OLD), (2, "old", NOW), (3, "unchecked", OLD),
    ]
    assert refreshed(spark, rows, [(0, "same")], channel=True)[1:3] == [(0, "same", OLD), (0, "same", NOW)]


def scores(spark, checks, start=2, **kw):
    log = spark.createDataFrame(
        [(0, NOW + timedelta(minutes=i), r, s) for i, (r, s) in enumerate(checks)],
        "_id_origin long, ts timestamp, reachable boolean, stale boolean",
    )
    return origins.deadness(origin(spark, {"is_dead_score": start}), log, **kw).collect()[0]["is_dead_score"]


FAIL, RESET, FRESH = (False, True), (True, True), (True, False)


@pytest.mark.parametrize("checks,channel,web", [
    ([FAIL, FAIL], 4, 2),
    ([FAIL, FRESH], 3, 2),
    ([FAIL, RESET], 0, 3),
    ([FAIL, RESET, FAIL, FAIL], 2, 3),
    ([], 2, 2),
])
def test_deadness(spark, checks, channel, web):
    assert scores(spark, checks, mode="channel") == channel
    assert scores(spark, checks, mode="web") == web
    assert scores(spark, checks, mode="web", semantics="intended") == channel


def test_deadness_mode_is_checked(spark):
    with pytest.raises(ValueError):
        scores(spark, [FAIL], mode="mail")


@pytest.mark.parametrize("last,seen,want", [(None, [], None), (None, [3, 1], 3), (5, [3], 5), (5, [9, 7], 9)])
def test_checkpoint_never_moves_back(spark, last, seen, want):
    s = spark.createDataFrame([(0, m) for m in seen], "_id_origin long, message_id long")
    assert origins.advance_checkpoint(origin(spark, {"last_checked": last}), s).collect()[0]["last_checked"] == want


def test_author_lookup_needs_exactly_one(spark):
    a = table(spark, "author", [{"_id_author": i, "tag": t, "username": "u"} for i, t in enumerate(["x", "y", "y", None])])
    s = table(spark, "source", [{"_id_source": k, "_id_origin": 1, "_id_author": i} for k, i in enumerate([0, 0, 1, 2, 3])])
    probes = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "_id_origin long, tag string")
    got = {(r["_id_origin"], r["tag"]): r["_id_author"] for r in origins.author_lookup(a, s, probes).collect()}
    assert got == {(1, "x"): 0, (1, "y"): None, (2, "x"): None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, how):
    """One key holds two thirds of the rows."""
    fact = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k long, v long")
    dim = spark.createDataFrame([(0, "a"), (3, "b"), (999, "c")], "k long, name string")
    plain = sorted(tuple(r) for r in fact.join(dim, "k", how).collect())
    for n in ("1", "5"):
        spark.conf.set(SALTS_CONF, n)
        assert sorted(tuple(r) for r in spread_join(fact, dim, ["k"], ["v"], how).collect()) == plain
    spark.conf.unset(SALTS_CONF)
    with pytest.raises(ValueError):
        spread_join(fact, dim, ["k"], ["v"], "outer")


def test_pick_top_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = pick_top(df, ["k"], [F.col("id").desc()], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r["id"] for r in pick_top(df, ["k"], [F.col("id").desc()], 2).collect()) == [996, 997, 998, 999]


def test_upsert_authors_keeps_known_and_adds_untagged(spark):
    current = table(spark, "author", [{"_id_author": 1, "tag": "t", "username": "u", "description": "d"}])
    new = spark.createDataFrame([("t", "u", 1), ("t", "v", 2), ("t", "v", 3), (None, "u", 4), (None, "u", 5)], "tag string, username string, row_key long")
    got = tables.upsert_authors(current, new).collect()
    assert sorted((r["tag"] or "", r["username"]) for r in got) == [("", "u"), ("", "u"), ("t", "u"), ("t", "v")]
    assert len({r["_id_author"] for r in got}) == 4


def test_upsert_paths_replaces_and_adds(spark):
    def path(o, p):
        return {**{c: p for c in PATH_COLUMNS}, "_id_forum_path": o, "is_auto_generated": True, "_id_origin": o}

    got = tables.upsert_paths(table(spark, "forum_path", [path(1, "a"), path(2, "b")]), table(spark, "forum_path", [path(2, "c"), path(3, "d")]))
    assert got.columns == TABLES["forum_path"].names
    assert sorted((r["_id_origin"], r["table_body_path"]) for r in got.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert got.filter("_id_origin = 2").collect()[0]["_id_forum_path"] == 2


def test_add_origins_twice_adds_once(spark):
    new = spark.createDataFrame([(0, "d", "i"), (0, "d", "i"), (2, "d", "i")], "category int, domain string, additional_infos string")
    added, first = tables.add_origins(origin(spark), new, as_of())
    assert added.count() == 2 and first.count() == 2
    again, none = tables.add_origins(added, new, as_of())
    assert again.count() == 0 and none.count() == 0


def test_reset_and_cascade(spark, tmp_path):
    data = table(spark, "data", [{"_id_data": i, "_og_hashmd5": "ab"[i % 2]} for i in range(4)])
    gone = spark.createDataFrame([("a",)], "_og_hashmd5 string")
    assert [r["_id_data"] for r in tables.cascade_delete(data, gone).orderBy("_id_data").collect()] == [1, 3]
    assert tables.refused_deletes(gone, data, "_og_hashmd5").collect()[0]["n"] == 2
    data.write.parquet(f"{tmp_path}/data")
    tables.reset_tables(spark, {"data": f"{tmp_path}/data"})
    back = spark.read.parquet(f"{tmp_path}/data")
    assert back.count() == 0 and back.columns == TABLES["data"].names


def test_audits(spark):
    every = {
        "author": table(spark, "author", [
            {"_id_author": 1, "tag": None, "username": "u"}, {"_id_author": 2, "tag": None, "username": "u"},
            {"_id_author": 3, "tag": "t", "username": "u"}, {"_id_author": 3, "tag": "t", "username": "u"},
        ]),
        "source": table(spark, "source", [{"_id_source": 1, "_id_origin": 9, "_id_author": None}, {"_id_source": 2, "_id_origin": 9, "_id_author": 8}]),
        "origin": table(spark, "origin", [{"_id_origin": 1, "domain": "x" * 256, "category": None}]),
    }
    unique = {(r["rule"], r["key"]): r["n"] for r in audit.unique_violations(every).collect()}
    assert unique == {("author(_id_author)", "3"): 2, ("author(tag,username)", "t|u"): 2}
    orphan = {(r["rule"], r["key"]): r["n"] for r in audit.orphan_rows(every).collect()}
    assert orphan == {("source._id_origin", "9"): 2, ("source._id_author", "8"): 1}
    lengths = {r["rule"]: r["n"] for r in audit.length_violations(every).collect()}
    assert lengths == {
        "origin.domain:length": 1, "origin.category:null": 1,
        "source.crawled_time:null": 2, "source.updated_time:null": 2,
    }


def test_orphans_of_many_keys_are_dealt_by_rows(spark, monkeypatch):
    """So many tasks as the rows need, whatever the session says; hot keys and few keys count the same."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    keys = [*range(1000), *[7] * 400, *[2000] * 300, *[None] * 100]
    every = {
        "source_telegram": table(spark, "source_telegram", [{"_id_source_telegram": i, "_id_source": k} for i, k in enumerate(keys)]),
        "source": table(spark, "source", [{"_id_source": k} for k in range(0, 1000, 2)]),
        "database_metadata": table(spark, "database_metadata", [{"_og_hashmd5": "x", "_id_source": k} for k in (4, 5, 5)]),
    }
    found = audit.orphan_rows(every)
    got = {(r["rule"], r["key"]): r["n"] for r in found.collect()}
    want = {("source_telegram._id_source", str(k)): 401 if k == 7 else 1 for k in range(1, 1000, 2)}
    assert got == {**want, ("source_telegram._id_source", "2000"): 300, ("database_metadata._id_source", "5"): 2}
    assert found.rdd.getNumPartitions() >= len(keys) // 50


def test_unique_keys_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    keys = [*range(1000), *range(0, 1000, 9), *[7] * 400, *[None] * 100]
    every = {"source": table(spark, "source", [{"_id_source": k} for k in keys])}
    found = audit.unique_violations(every)
    want = {("<null>" if k is None else str(k)): n for k, n in Counter(keys).items() if n > 1}
    assert {r["key"]: r["n"] for r in found.collect()} == want
    assert found.rdd.getNumPartitions() >= len(keys) // 50


def plain_replay(rows, log, age, channel):
    """One check after the other."""
    rows = [list(r) for r in rows]  # origin, time, infos, in the order of their ids
    fixed = len(rows)
    for o in sorted({r[0] for r in rows}):
        for ts in sorted({t for p, t, _ in log if p == o and t is not None}):
            infos = min((x for p, t, x in log if p == o and t == ts), key=lambda x: (x is not None, x or ""))
            newest = max(r[1] for r in rows if r[0] == o)
            tied = [r for k, r in enumerate(rows) if r[0] == o and r[1] == newest]
            if ts <= newest + age:
                continue
            if not channel and tied[-1][2] == infos:
                for r in tied:
                    r[1] = ts
            else:
                rows.append([o, ts, infos])
    assert len(rows) >= fixed
    return sorted(rows, key=repr)


@pytest.mark.parametrize("channel", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_replay_is_one_check_after_the_other(spark, seed, channel):
    import random

    rng = random.Random(seed)
    start = datetime(1969, 12, 28)  # times before and after the epoch
    minutes = [0, 1, 719, 720, 721, 1440, 3000]
    rows = [(o, start + timedelta(minutes=rng.choice(minutes)), rng.choice(["a", "b", None])) for o in (0, 0, 0, 1, 2, 3)]
    rows += [(0, max(t for o, t, _ in rows if o == 0), "a")]  # a tie
    log = []
    for _ in range(400):  # origin 0 has most of them, with gaps, ties and exact twelve hours
        o = rng.choice([0, 0, 0, 0, 1, 2, 9])
        log.append((o, start + timedelta(minutes=rng.choice([720 * rng.randint(0, 30), rng.randint(0, 9000), 30_000 + rng.randint(0, 2000)])), rng.choice(["a", "b", "b", None])))
    log += log[:20] + [(0, None, "a"), (1, None, None)]
    df = spark.createDataFrame(log, "_id_origin long, ts timestamp, additional_infos string").withColumn("run", F.lit("x"))
    out = replay.replay_checks(history(spark, rows), df, channel=channel)
    got = sorted(([r["_id_origin"], r["updated_time"], r["additional_infos"]] for r in out.collect()), key=repr)
    assert got == plain_replay(rows, log, H12, channel)
    assert out.select("_id_origin_history").distinct().count() == len(got)


def test_replay_of_empty_tables(spark):
    rows = [(0, NOW, "a")]
    none = spark.createDataFrame([], "_id_origin long, ts timestamp, additional_infos string")
    assert replay.replay_checks(history(spark, rows), none).count() == 1
    log = spark.createDataFrame([(0, NOW, "a")], none.schema)
    assert replay.replay_checks(history(spark, []), log).count() == 0
