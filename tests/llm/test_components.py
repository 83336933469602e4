import random

from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch


def test_equals_union_find(spark):
    r = random.Random(7)
    edges = [(a, a + 1) for a in range(100, 160)] + [(1000, x) for x in range(900, 950)] + [(r.randrange(500), r.randrange(500)) for _ in range(150)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert len(got) == len(root) and {x.node: x.component for x in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
