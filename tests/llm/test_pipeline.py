"""Each stage of the pipeline against its own brute-force version, stage by stage on what its predecessor kept."""

import hashlib
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from harborwatch.llm import queries, toxicity
from harborwatch.session import staged
from tests.llm.test_dedup import plain_removal
from tests.llm.test_texts import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stage_order_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["toxicity", "near_dedup", "substring_dedup", "secrets", "packing"]
    for _, frame in stages[1:-1]:
        assert frame.columns == stages[0][1].columns and frame.dtypes == stages[0][1].dtypes


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out())
    scores = {r.doc_id: r.score for r in toxicity.score_documents(stages[0][1], toxicity.fit(stages[0][1], labels)).collect()}
    assert set(rows(stages[1][1])) == {i for i, s in scores.items() if s < 0.7}


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    sets = {}
    for i, r in before.items():
        w = (r.text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    gone = set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    gone = {i for i in ids if root(i) != i}
    assert set(after) == set(ids) - gone
    assert all(after[i] == before[i] for i in after)


def test_repeats_go(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    assert set(before) == set(after)
    for i, _, removed, digest in plain_removal([(i, r.text) for i, r in before.items()], 35):
        if removed:
            assert hashlib.sha256((after[i].text or "").encode()).hexdigest() == digest
        else:
            assert after[i].text == before[i].text
        assert after[i].n_chars == len(after[i].text or "")


def test_secrets_go(stages):
    before, after = rows(stages[3][1]), rows(stages[4][1])
    assert set(before) == set(after)
    for i, r in before.items():
        if base_spans(r.text or ""):
            assert "[" in after[i].text and not base_spans(after[i].text)


def test_packing_covers_every_document(stages):
    packed = stages[5][1]
    assert packed.select("doc_id").distinct().count() == stages[4][1].count()
    worst = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert worst.filter("n != end or n > 1024").count() == 0


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r)[:5] for r in stages[5][1].collect())


def test_rest_imports_without_the_subpackage():
    code = (
        "import sys; sys.modules['harborwatch.llm'] = None; sys.path.insert(0, '.')\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'harborwatch.llm'): raise ModuleNotFoundError(name=name)\n"
        "del sys.modules['harborwatch.llm']; sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op1_') for n in e.queries())"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=queries.__file__.split("/harborwatch/")[0], timeout=100).returncode == 0
