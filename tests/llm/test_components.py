import random

from driftcurve.llm.components import connected_components
from driftcurve.llm.storage import Scratch


def test_equals_union_find(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)] + [(9, 9)]
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src bigint, dst bigint")
    got = {r.node: r.label for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in up}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint"), Scratch(spark, "t")).count() == 0
