import random

from jobweave.llm.components import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def run(spark, edges, kind):
    return {r.node: r.component for r in components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()}


def test_random_graphs(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3), (7, None)]
    assert run(spark, edges, "long") == plain(edges)


def test_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)]
    assert run(spark, edges, "long") == plain(edges)


def test_strings_and_nothing(spark):
    assert run(spark, [("b", "a"), ("c", "b")], "string") == {"a": "a", "b": "a", "c": "a"}
    assert run(spark, [], "long") == {}
