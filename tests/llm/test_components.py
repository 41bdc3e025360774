import random

import pytest

from stratalens.llm import components as module
from stratalens.llm.components import components


def roots(edges):
    """Union-find over (u, v); nodes without an edge to another one are left out."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def shapes():
    rng = random.Random(5)
    path = list(range(-40, 160))
    rng.shuffle(path)
    sparse = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    star = [(7, x) for x in range(1000, 1300)] + [(x, 1299) for x in range(2000, 2020)]
    return {
        "path": list(zip(path, path[1:])),
        "sparse": sparse + sparse[:50],
        "star": star,
        "two smaller ends": [(9, 1), (9, 2), (8, 2), (8, 3)],
        "odd": [(None, 1), (2, None), (3, 3), (-(1 << 62), 1 << 62), (1 << 62, 5)],
        "empty": [],
    }


@pytest.mark.parametrize("shape", list(shapes()))
@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_same_as_union_find(spark, shape, at_once, monkeypatch):
    monkeypatch.setattr(module, "AT_ONCE", at_once)
    edges = shapes()[shape]
    random.Random(1).shuffle(edges)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == roots(edges)


def test_settled_edges_take_no_round(spark, monkeypatch):
    """One large group and many pairs, as near copies have: stars already, so nothing is left to do but to see that."""
    made, written = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name, **k: made.append(name) or written(df, name, **k))
    edges = [(x, 0) for x in range(1, 400)] + [(x, x - 1) for x in range(1001, 1800, 2)]
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()} == roots(edges)
    assert made == ["edges"]
