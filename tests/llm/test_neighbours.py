import heapq

import numpy as np

from cairn.llm.neighbours import Forest, top_k


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([c + 0.25 * rng.standard_normal((20, 16)) for c in centres]).astype(np.float32).astype(np.float64)
    x[100:400] = x[100]  # a quarter of all rows are copies
    ids = list(range(1, len(x) + 1))
    df = spark.createDataFrame([(i, v.tolist(), 0, "c") for i, v in zip(ids, x)], "entry_id bigint, vector array<float>, rep int, near string")
    got: dict = {}
    for r in top_k(df, "entry_id", "vector", dim=16, k=5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    true = brute(ids, x, 5)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[i]) & set(true[i])) / 5 for i in ids]) >= 0.9
    assert got[101] == [102, 103, 104, 105, 106] and got[400] == [101, 102, 103, 104, 105]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, None]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    got = {(r.id, r.neighbour): r.score for r in top_k(spark.createDataFrame(rows, "i bigint, v array<float>"), "i", "v", dim=2, k=2).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)} and abs(got[1, 2] - 1) < 1e-12
    assert top_k(spark.createDataFrame([], "i bigint, v array<float>"), "i", "v", dim=2).count() == 0
    assert top_k(spark.createDataFrame(rows[:1], "i bigint, v array<float>"), "i", "v", dim=2).count() == 0


def test_recall_in_deep_trees(spark):
    """In cells of 512 rows and leaves of 16, with asks in blocks; the share of rows that is compared falls with the rows."""
    x = np.random.default_rng(2).standard_normal((4096, 16))
    ids = list(range(1, len(x) + 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "entry_id bigint, vector array<double>")
    got: dict = {}
    for r in top_k(df, "entry_id", "vector", dim=16, k=10, leaf_rows=16, cell_rows=512, ask_rows=700).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = ids[::20]
    near = np.argsort(-(u[::20] @ u.T), axis=1)[:, 1:11] + 1
    assert np.mean([len(got[i] & set(n.tolist())) / 10 for i, n in zip(ask, near)]) >= 0.9


def test_bound_is_what_the_queue_gives():
    """The bound equals the priority of the last leaf of a heap that all trees share, and cells below the queue's levels agree with it."""
    x = np.random.default_rng(3).standard_normal((900, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = Forest(x, 3, 5, 1)
    bound, row, cell, own = f.cells(x[:40], 0.2, 5)
    take = int(np.ceil(0.2 * 3 * 32))
    for i in range(40):
        queue, got = [(0.0, t, 1) for t in range(3)], []
        while len(got) < take:
            near, t, node = heapq.heappop(queue)
            if node >= 32:
                got.append((near, (t << 5) + node - 32))
                continue
            m = float(x[i] @ f.normals[t, node] - f.offsets[t, node])
            heapq.heappush(queue, (max(near, m, 0.0), t, 2 * node))
            heapq.heappush(queue, (max(near, -m, 0.0), t, 2 * node + 1))
        assert abs(got[-1][0] - bound[i]) < 1e-5
        assert {c for _, c in got} <= set(cell[row == i].tolist()) and own[row == i].sum() == 3


def test_lines_of_points(spark):
    """Vectors that nearly all lie alike to most hyperplanes still end in small leaves."""
    rows = [(i, [1.0 if k in (0, i % 60 + 1) else 0.0 for k in range(64)]) for i in range(300)] + [(1000 + i, [1.0, *[0.0] * 62, i / 500]) for i in range(500)]
    got = top_k(spark.createDataFrame(rows, "i bigint, v array<double>"), "i", "v", k=3, leaf_rows=8).groupBy("id").count().toPandas()
    assert len(got) == 800 and (got["count"] == 3).all()
