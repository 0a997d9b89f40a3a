"""Components of made-up graphs, against a plain search."""

import random

import pytest

from contrada.llm.components import components


def reached(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(k for k, v in near.items() if v - {k}):
        todo = [] if x in out else [x]
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near[y]
    return out


rng = random.Random(4)
PATH = rng.sample(range(100), 20)
GRAPHS = {
    "none": [], "loop": [(3, 3)], "path": [(i, i + 1) for i in range(20)], "shuffled path": [(a, b) for a, b in zip(PATH, PATH[1:], strict=False)],
    "stars": [(50, i) for i in range(5)] + [(60, i) for i in range(10, 14)] + [(7, 50)], "two centres": [(9, 1), (9, 2)], "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(80)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    assert {r.id: r.root for r in got} == reached(GRAPHS[name]) and len(got) == len({r.id for r in got})


def test_all_rows_of_a_repeated_id_are_counted(spark):
    from contrada.llm import ngram_join

    rows = spark.createDataFrame([(1, [1, 2, 3], 3), (2, [7, 8], 2), (2, [2, 3, 4], 3), (3, [1], 1), (9, [5], 1)], "id long, grams array<long>, n long")
    pairs = spark.createDataFrame([(5, 1, 2), (5, 1, 3), (-6, 2, 3), (7, 1, 4)], "block long, hub long, id long")
    got = sorted(map(tuple, ngram_join._counted(pairs, rows).collect()))
    assert got == [(-6, 2, 3, 0, 2, 1), (-6, 2, 3, 0, 3, 1), (5, 1, 2, 0, 3, 2), (5, 1, 2, 2, 3, 3), (5, 1, 3, 1, 3, 1)]
