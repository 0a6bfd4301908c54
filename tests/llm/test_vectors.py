import numpy as np
import pytest

from asmlens.llm import vectors as V


def brute(x, cosine):
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = label.copy()
        i, j = np.nonzero(near)
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize(("crowd", "dims"), [(2000, 64), (5, 64), (2000, 12), (2000, 3)])
def test_against_brute_force(spark, monkeypatch, crowd, dims):
    monkeypatch.setattr(V, "CROWD", crowd)
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((120, dims))
    x = np.concatenate([x, x[:40] + rng.standard_normal((40, dims)) * 0.3 * rng.random((40, 1)), x[:5] + rng.standard_normal((30, 5, dims)).reshape(150, dims)[::30][:5] * 0.02, x[3:4], x[3:4] * 2]).astype(np.float32).astype(float)
    got = V.near_vectors(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    links, label = brute(x, 0.95)
    assert [r.n_links for r in got] == links.tolist()
    assert [r.component_id for r in got] == label.tolist()
    assert [r.kept for r in got] == [r.vec_id == r.component_id for r in got]


def test_bad_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    links = {}
    for r in got:
        links.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert all(links[k] == [(0, k)] for k in (1, 2, 3, 4, 5, 6, 9))
    assert [r.kept for r in got if r.vec_id is None] == [False] and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert links[7] == [(3, 7)] * 2 and links[8] == [(3, 7)] and links[None] == [(3, 7)]
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_double_precision_and_extreme_lengths(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e300, 2e300]), (3, [1e-60, 2e-60]), (4, [-1.0, 0.5]), (5, [1e-300, 2e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4)}
    # two vectors that are equal as floats but lie on both sides of the threshold as doubles
    c = 0.95
    s = float(np.sqrt(1 - c * c))
    near, far = [c + 1e-9, s], [c - 1e-9, s]
    got = {r.vec_id: r.n_links for r in V.near_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, near)], "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 1, 1: 1}
    got = {r.vec_id: r.n_links for r in V.near_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (2, far)], "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 0, 2: 0}


def test_cells_place_and_reach(monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((400, 6)) * 0.2
    cells = V.Cells.fit(points, 20)
    home = cells.home(points)
    assert len(set(home.tolist())) >= 16 and np.bincount(home).max() <= 20
    met = {(int(w), c) for who, c in cells.visits(points, 0.04) for w in who}
    apart = ((points[:, None] - points[None]) ** 2).sum(2)
    for a, b in zip(*np.nonzero((apart <= 0.04) & (home[:, None] != home[None]))):
        assert (int(a), int(home[b])) in met
    assert all(home[w] != c for w, c in met)
