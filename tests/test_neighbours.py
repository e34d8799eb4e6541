"""The pivot index gives the rows of a full comparison, under every metric and view, and compares far fewer pairs."""
import numpy as np
import pytest

from veiltab.operators import neighbours as N
from veiltab.operators.neighbours import View, Visits, knn

SCHEMA = "id long, num array<double>, cat array<long>, w array<double>"


def table(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in n], [int(x) for x in c], [float(x) for x in w]) for i, n, c, w in rows], SCHEMA)


def distance(metric, q, a, view):
    def part(row):
        num, w = [row[1][i] for i in view.num], [row[3][j] for j in view.cat]
        if metric != "cosine":
            return num, w
        length = np.sqrt(sum(x * x for x in num) + sum(x * x for x in w)) + 1e-12
        return [x / length for x in num], [x / length for x in w]

    (qn, qw), (an, aw) = part(q), part(a)
    same = [q[2][j] == a[2][j] for j in view.cat]
    if metric == "l1":
        total = sum(abs(x - y) for x, y in zip(qn, an)) + sum(abs(x - y) if s else x + y for x, y, s in zip(qw, aw, same))
    else:
        total = np.sqrt(sum((x - y) ** 2 for x, y in zip(qn, an)) + sum((x - y) ** 2 if s else x * x + y * y for x, y, s in zip(qw, aw, same)))
    return round(float(total), 9)


@pytest.mark.parametrize("metric", ["l1", "cosine"])
def test_index_equals_full_comparison(spark, metric):
    rnd = np.random.default_rng(4)
    make = lambda n, at: [(at + i, np.round(rnd.random(3), 2), rnd.integers(0, 3, 2), [1.0, 0.5]) for i in range(n)]
    a, c = make(260, 0), make(25, 1000)
    a += [(500 + i, a[0][1], a[0][2], a[0][3]) for i in range(40)]  # more copies than k
    views = [View("x", (0, 1, 2), (0, 1)), View("y", (0, 2), ()), View("z", (1,), (1,))]
    got = {}
    for r in knn(table(spark, a), table(spark, c), 3, metric, views, block_rows=32, cell_rows=20).collect():
        got.setdefault((r.part, r.qid), []).append((r["rank"], r.dist, r.id))
    for view in views:
        for q in c:
            best = sorted((distance(metric, q, x, view), x[0]) for x in a)[:3]
            found = [x[1:] for x in sorted(got[view.name, q[0]])]
            assert [x[1] for x in found] == [x[1] for x in best], (view, q[0])
            assert np.allclose([x[0] for x in found], [x[0] for x in best], atol=2e-9)


def test_compared_pairs_grow_well_below_all_pairs(spark):
    rnd = np.random.default_rng(8)
    shares = []
    for n in (500, 2_000):
        rows = [(i, x, [], []) for i, x in enumerate(rnd.random((n, 2)))]
        visits = Visits()
        found = knn(table(spark, rows), table(spark, [(n + i, x, [], []) for i, x in enumerate(rnd.random((60, 2)))]), 2, "l2", block_rows=512, cell_rows=20, visits=visits)
        assert found.count() == 120
        shares.append(visits.pairs() / (n * 60))
    assert shares[0] < 0.5 and shares[1] < 0.5 * shares[0]  # four times the rows, less than twice the pairs


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
def test_leaves_give_the_rows_of_all_pairs_and_measure_few(monkeypatch, metric):
    rnd = np.random.default_rng(5)

    def made(n):
        out = object.__new__(N.Vectors)
        out.num, out.cat, out.w = np.round(rnd.random((n, 3)), 3), rnd.integers(0, 4, (n, 1)), np.full((n, 1), 0.7)
        return out

    rows, asked, seen, measure = made(6000), made(50), [], N._measure
    monkeypatch.setattr(N, "_measure", lambda m, q, at, leaves, leaf: seen.append(len(leaf) * N.LEAF) or measure(m, q, at, leaves, leaf))
    views = [View("x", (0, 1, 2), (0,)), View("y", (0, 2), ()), View("z", (), (0,))]
    m = N.Metric(metric, views, 3, 1)
    ids = rnd.permutation(6000)
    for v in range(len(views)):
        q, a = np.divmod(np.arange(50 * 6000), 6000)
        every = np.round(m.exact(v, asked.take(q), rows.take(a)), N.DIGITS).reshape(50, 6000)
        seen.clear()
        at, ids_found, dist = N._hits_by_leaves(m, v, 3, asked, rows, ids, np.full(50, np.inf))
        for i in range(50):
            best = np.lexsort((ids, every[i]))[:3]
            assert sorted(zip(dist[at == i], ids_found[at == i])) == list(zip(every[i][best], ids[best]))
        assert views[v].name == "z" or sum(seen) < 0.2 * 50 * 6000


def test_copies_of_a_vector_are_compared_once(spark):
    rnd = np.random.default_rng(9)
    kinds = [(np.round(rnd.random(2), 2), rnd.integers(0, 3, 1)) for _ in range(30)]
    a = [(100 * j + (7 * i) % 40, n, c, [1.0]) for i, (n, c) in enumerate(kinds) for j in range(40)]
    a = [(i, *row[1:]) for i, row in enumerate(a)]
    c = [(5000 + i, rnd.random(2), rnd.integers(0, 3, 1), [1.0]) for i in range(8)]
    visits, got = Visits(), {}
    for r in knn(table(spark, a), table(spark, c), 5, visits=visits).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.dist, r.id))
    everything = View("*", (0, 1), (0,))
    for q in c:
        best = sorted((distance("l1", q, x, everything), x[0]) for x in a)[:5]
        assert [x[2] for x in sorted(got[q[0]])] == [x[1] for x in best]
    assert visits.pairs() == 8 * len({(*n, *c) for n, c in kinds})


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
def test_rows_of_other_levels_and_flags_are_hardly_measured(monkeypatch, metric):
    rnd = np.random.default_rng(6)

    def made(n):
        out = object.__new__(N.Vectors)
        out.num = np.column_stack([rnd.random((n, 3)), rnd.integers(0, 2, (n, 2))])
        out.cat, out.w = rnd.integers(0, 5, (n, 2)), np.full((n, 2), 1.0)
        return out

    rows, asked, seen, measure = made(12000), made(60), [], N._measure
    monkeypatch.setattr(N, "_measure", lambda m, q, at, leaves, leaf: seen.append(len(leaf) * N.LEAF) or measure(m, q, at, leaves, leaf))
    m, ids = N.Metric(metric, [View("*", (0, 1, 2, 3, 4), (0, 1))], 5, 2), rnd.permutation(12000)
    at, found, dist = N._hits_by_leaves(m, 0, 3, asked, rows, ids, np.full(60, np.inf))
    q, a = np.divmod(np.arange(60 * 12000), 12000)
    every = np.round(m.exact(0, asked.take(q), rows.take(a)), N.DIGITS).reshape(60, 12000)
    for i in range(60):
        best = np.lexsort((ids, every[i]))[:3]
        assert sorted(zip(dist[at == i], found[at == i])) == list(zip(every[i][best], ids[best]))
    assert sum(seen) < 0.015 * 60 * 12000


def test_products_take_many_queries_at_a_time():
    wide = View("*", tuple(range(64)), ())
    assert N.Metric("l2", [wide], 64, 0).stretch(8192) >= 16


def test_trees_of_trees_and_repeated_ids_give_the_rows_of_a_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(N, "FAN", 4)
    rnd = np.random.default_rng(11)
    make = lambda n, at: [(at + i, [*np.round(rnd.random(2), 3), i % 2], rnd.integers(0, 4, 1), [1.0]) for i in range(n)]
    a, c = make(400, 0), make(30, 1000)
    a += [(i, *row[1:]) for i, row in enumerate(make(40, 0))]  # ids met twice
    visits, got = Visits(), {}
    for r in knn(table(spark, a), table(spark, c), 3, block_rows=64, cell_rows=20, visits=visits).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.dist, r.id))
    everything = View("*", (0, 1, 2), (0,))
    for q in c:
        best = sorted((distance("l1", q, x, everything), x[0]) for x in a)[:3]
        found = sorted(got[q[0]])
        assert [x[2] for x in found] == [x[1] for x in best]
        assert np.allclose([x[1] for x in found], [x[0] for x in best], atol=2e-9)
    assert visits.pairs() < 0.25 * len(a) * len(c)


def test_boxes_of_other_levels_are_out_of_reach():
    m = N.Metric("l1", [View("*", (0,), (0,))], 1, 1)
    boxes = [[np.array([[0.0]]), np.array([[1.0]])], [np.array([[1.0]]), np.array([[1.0]])], [np.array([[3]]), np.array([[5]])]]
    q = (np.array([[0.5], [0.5]]), np.array([[4], [9]]), np.ones((2, 1)))
    assert N._low(m, q, np.arange(2)[:, None], boxes, np.array([[0]])).tolist() == [[0.0], [2.0]]  # 9 is not among levels 3 to 5
