"""Small graphs and intermediate tables: few tasks for the driver to remember, and the same rows as by rounds of stars."""

import random

import pytest

from terrasift.llm import common, graph
from terrasift.llm.jaccard_join import jaccard_join


def tasks(spark, group, run):
    """What run() returns, and how many tasks its jobs had."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


@pytest.fixture
def wide(spark):
    """So many shuffle partitions that what is not gathered shows."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def edges(kind):
    rng = random.Random(7)
    if kind == "path":
        nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
        return list(zip(nodes, nodes[1:]))
    if kind == "star":
        return [(0, k) for k in range(1, 300)] + [(k, k) for k in range(5)]
    if kind == "none":
        return [(5, 5)]
    return [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]


def by_hand(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("kind", ["path", "star", "none", "random"])
def test_components_in_one_task_and_by_stars(spark, kind):
    pairs = edges(kind)
    df = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    want = by_hand(pairs)
    assert sorted(map(tuple, graph.components(df).collect())) == want
    assert sorted(map(tuple, graph.components(df, few=0).collect())) == want


def test_few_edges_take_few_tasks(wide):
    df = wide.createDataFrame(edges("path"), "u long, v long")
    rows, n = tasks(wide, "few-edges", lambda: graph.components(df).collect())
    assert len(rows) == 300 and n < 200


def texts():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(40)]
    return [(k * 100 + j, text if j < 2 else text.rsplit(" ", j - 1)[0]) for k, text in enumerate(base) for j in range(5)]


def test_join_of_few_documents_takes_few_tasks(wide):
    docs = wide.createDataFrame(texts(), "doc_id long, text string")
    rows, n = tasks(wide, "few-documents", lambda: jaccard_join(docs).collect())
    assert {r.doc_id: r.component_id for r in rows} == {k * 100 + j: k * 100 for k in range(40) for j in range(5)}
    assert n < 1500


@pytest.mark.parametrize("most", [256, 4])
def test_join_without_gathering_gives_the_same(spark, monkeypatch, most):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join(docs, most=most).collect()))
    monkeypatch.setattr(common, "GATHER_BYTES", -1)
    monkeypatch.setattr(graph.components, "__defaults__", (0,))
    assert sorted(map(tuple, jaccard_join(docs, most=most).collect())) == want
