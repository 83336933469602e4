import numpy as np
import pytest

from tidemark.llm import grid_join


def brute(rows, cosine=0.93):
    good = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    link = [[False] * len(rows) for _ in rows]
    for i, (_, u, l) in enumerate(rows):
        for j, (_, v, m) in enumerate(rows):
            if i != j and good[i] and good[j] and l == m and len(u) == len(v):
                link[i][j] = np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], int(sum(link[i])), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("dims", [2, 24])
def test_equals_brute_force(spark, dims):
    r = np.random.default_rng(dims)
    centres = r.normal(size=(12, dims))
    rows = [(int(k), (centres[k % 12] + r.normal(scale=0.25, size=dims)).tolist(), int(k) % 3 % 2) for k in range(700)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(40)] + [(5, rows[1][1], 1), (2000, [0.0] * dims, 0), (2001, None, 0), (2002, rows[3][1], None), (2003, [float("nan")] * dims, 0), (2004, [None] * dims, 0), (2005, [], 0), (None, rows[5][1], 1), (2006, [1.0] * (dims + 1), 0)]
    df = spark.createDataFrame([(*x, "n") for x in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted(map(tuple, grid_join.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert grid_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_lengths_beyond_the_range_of_squares(spark):
    """Vectors of doubles whose squares overflow or vanish are compared like any other."""
    rows = [(1, [3e200, 4e200], 1), (2, [3.0, 4.0], 1), (3, [3e-200, 4e-200], 1), (4, [-3e200, 4e200], 1), (5, [float("inf"), 1.0], 1)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in grid_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
