import random

from strataview.llm.components import connected_components


def edges_of(spark, parts=6):
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(100, 600)]
    star = [(700, k) for k in range(701, 900)]
    some = [tuple(rng.sample(range(1000, 1400), 2)) for _ in range(250)]
    rows = path + star + some + some[:9] + [(5, 5)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "a long, b long").repartition(parts)


def expected(rows):
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in rows:
        if a != b:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {x: root(x) for x in list(low)}


def test_few_edges_take_no_rounds(spark):
    rows, edges = edges_of(spark)
    spark.sparkContext.setJobGroup("components", "few edges")
    try:
        out = connected_components(edges)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    pairs = [tuple(r) for r in out.collect()]
    assert len(pairs) == len(set(pairs)) and dict(pairs) == expected(rows)
    assert len(jobs) <= 12


def test_more_edges_take_rounds(spark):
    rows, edges = edges_of(spark)
    for at_once in (0, 100):
        pairs = [tuple(r) for r in connected_components(edges, at_once=at_once).collect()]
        assert len(pairs) == len(set(pairs)) and dict(pairs) == expected(rows)


def test_no_edges(spark):
    for at_once in (0, 100):
        assert connected_components(spark.createDataFrame([(4, 4)], "a long, b long"), at_once=at_once).count() == 0
