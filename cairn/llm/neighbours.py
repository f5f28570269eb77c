"""Problem 3: the k most similar vectors of every vector.

Method: a forest of random-projection trees, searched through a priority queue that all trees share.  Each tree splits at the
median of projections on the difference of two random points.  A leaf's priority for a vector is the greatest margin by which its
path leaves the vector's own side; the queue gives the leaves of least priority over all trees.  As the number of leaves taken is
fixed, what the queue gives is all leaves up to a bound, the priority of the last one, and that is how it is computed: for all
vectors of a batch at once.  The candidates of the leaves are reranked by exact cosine in double precision.

Scale: only the upper levels of the forest are broadcast; they are fitted on a bounded sample (``sample_rows``, documented below)
and give each vector its bound and the cells - subtrees of about ``cell_rows`` rows - that it has to look into.  A vector is sent
once to each of these, not to each leaf.  The lower levels of a cell are fitted in its task on all of its rows and go down to
``leaf_rows`` rows whatever the size, so the work grows less than with the square of the rows: the share of rows compared falls.
Identical vectors are one point in the forest and are expanded by (class, rank) joins afterwards, so no list of copies is ever
collected.  Vectors that ask in one cell are split into blocks of about ``ask_rows``.

Defined results: vectors that are null, of another length, with null, NaN or infinite elements, or all zero take no part;
rows of one id are one entry (the smallest vector in array order); ties in similarity go to the smaller id; an entry with fewer
than k others gets as many as there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.lineage import bounded, cut, stage
from cairn.operators.skew import salted_join

#: Levels of the trees over which the shared queue is run to find each vector's bound.
QUEUE_DEPTH = 9


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.float32, np.ndarray]:
    """(normal, offset, projections) of a hyperplane between the rows of ``x``: normal to the difference of two of them or, if that
    leaves nearly all rows on one side, of a random direction, on which distinct rows have distinct places."""
    for attempt in range(4):
        if attempt < 3 and len(x) > 1:
            a, b = rng.choice(len(x), 2, replace=False)
            v = x[a] - x[b]
        else:
            v = rng.standard_normal(x.shape[1]).astype(np.float32)
        size = np.linalg.norm(v)
        if size > 1e-6:
            v = (v / size).astype(np.float32)
            p = x @ v
            off = np.float32(np.median(p)) if len(p) else np.float32(0)
            if len(x) < 8 or 0.2 * len(x) < np.count_nonzero(p <= off) < 0.8 * len(x):
                break
    return v, off, p


class Forest:
    """Complete binary trees of one depth; ``normals[t, n]`` and ``offsets[t, n]`` split node n (the root is 1)."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.normals = np.zeros((trees, 1 << depth, sample.shape[1]), dtype=np.float32)
        self.offsets = np.zeros((trees, 1 << depth), dtype=np.float32)
        for t in range(trees):
            rows = {1: np.arange(len(sample))}
            for node in range(1, 1 << depth):
                idx = rows.pop(node)
                v, off, p = _split(sample[idx], rng)
                self.normals[t, node], self.offsets[t, node] = v, off
                rows[2 * node], rows[2 * node + 1] = idx[p <= off], idx[p > off]

    def priorities(self, x: np.ndarray, t: int, depth: int) -> list[np.ndarray]:
        """For each level up to ``depth`` of tree ``t``, the priority of every node for every row: 0 on the row's own path."""
        margin = x @ self.normals[t, : 1 << depth].T - self.offsets[t, : 1 << depth]
        levels = [np.zeros((len(x), 1), dtype=np.float32)]
        for d in range(depth):
            m, up = margin[:, 1 << d : 2 << d], levels[-1]
            down = np.empty((len(x), 2 << d), dtype=np.float32)
            down[:, 0::2], down[:, 1::2] = np.maximum(up, np.maximum(m, 0)), np.maximum(up, np.maximum(-m, 0))
            levels.append(down)
        return levels

    def cells(self, x: np.ndarray, share: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bound of each row, row, cell, own) - the nodes at level ``depth`` of all trees that a row looks into, with ``own`` where it lies
        itself.  The bound is the priority of the last leaf that the shared queue gives if ``share`` of the leaves are taken."""
        queue = min(QUEUE_DEPTH, self.depth)
        levels = [self.priorities(x, t, queue) for t in range(self.trees)]
        leaves = np.concatenate([lv[-1] for lv in levels], axis=1)
        take = min(leaves.shape[1], max(1, int(np.ceil(share * leaves.shape[1]))))
        bound = np.partition(leaves, take - 1, axis=1)[:, take - 1]
        row, cell, own = [], [], []
        for t, lv in enumerate(levels):
            r, c = np.nonzero(lv[min(depth, queue)] <= bound[:, None])
            near = lv[min(depth, queue)][r, c]
            for d in range(queue, depth):  # below the queue's levels only nodes within the bound are followed
                node = c + (1 << d)
                m = np.einsum("ij,ij->i", x[r], self.normals[t, node]) - self.offsets[t, node]
                r, c = np.r_[r, r], np.r_[2 * c, 2 * c + 1]
                near = np.r_[np.maximum(near, np.maximum(m, 0)), np.maximum(near, np.maximum(-m, 0))]
                keep = near <= bound[r]
                r, c, near = r[keep], c[keep], near[keep]
            row.append(r)
            cell.append(c + (t << depth))
            own.append(near == 0)
        return bound, np.concatenate(row), np.concatenate(cell), np.concatenate(own)


def search_cell(data: np.ndarray, asks: np.ndarray, bound: np.ndarray, leaf_rows: int, rng: np.random.Generator, visit: Callable) -> None:
    """Fits the lower levels of a tree on ``data`` and gives ``visit`` the rows of each leaf with the asks whose bound reaches it."""
    todo = [(np.arange(len(data)), np.arange(len(asks)))]
    while todo:
        rows, who = todo.pop()
        if len(rows) == 0 or len(who) == 0:
            continue
        if len(rows) <= 1.5 * leaf_rows:
            visit(rows, who)
            continue
        v, off, p = _split(data[rows], rng)
        m = asks[who] @ v - off
        todo += [(rows[p <= off], who[m <= bound[who]]), (rows[p > off], who[-m <= bound[who]])]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in four bytes an element if that is exact, else in eight."""
    low = x.astype(np.float32)
    return [a.tobytes() if e else b.tobytes() for a, b, e in zip(low, x, (low == x).all(axis=1))]


def _unpacked(raw, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in raw])


def share_taken(share: float, n: int) -> float:
    """The share of the queue's leaves that is taken for ``n`` vectors: ``share`` up to 40,000, 1.3 times as much for each ten times more.
    Leaves get smaller against the whole, so the share of rows compared falls all the same."""
    return min(1.0, share * max(1.0, n / 40_000) ** 0.114)


def top_k(entries: DataFrame, id_col: str, vector_col: str, *, dim: int = 64, k: int = 10, trees: int = 4, share: float = 0.1, leaf_rows: int = 128, cell_rows: int = 32768, ask_rows: int = 131072, sample_rows: int = 32768, seed: int = 5) -> DataFrame:
    """``(id, neighbour, score, rank)``: for every entry its ``k`` most similar others.

    The upper levels of ``trees`` trees are fitted on at most ``sample_rows`` distinct vectors, chosen by hash; of their leaves the share
    ``share_taken`` is searched, in leaves of about ``leaf_rows`` rows."""
    spark = entries.sparkSession
    v = F.col(vector_col)
    valid = entries.select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    )
    # Vectors of ids that occur once are not shuffled.
    many = bounded(valid.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    one = valid.join(many, "id", "left_anti").unionByName(valid.join(many, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))
    # Classes of identical vectors, by 128 bits of hash; the smallest id stands for the class.
    members = stage(one.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(17)).alias("g")), "p3-members")
    classes = members.groupBy("h", "g").agg(F.min("id").alias("rep"))
    of_class = cut(salted_join(members.select("id", "h", "g"), classes, ["h", "g"]).select("id", "rep"))
    points = members.select(F.col("id").alias("rep"), "v").join(bounded(of_class.where("id <> rep").select(F.col("id").alias("rep"))), "rep", "left_anti")
    n = of_class.where("id = rep").count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, neighbour bigint, score double, rank int")
    sample = points.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(sample_rows).select("v").toPandas()["v"]
    low = _unit(np.stack(sample)).astype(np.float32)
    cell_depth = max(0, int(np.ceil(np.log2(n / cell_rows))))
    # Eight rows of the sample or more stand behind a leaf of the queue; cells are never finer than the sample can tell.
    most = max(0, int(np.log2(len(low) / 8)))
    cell_depth = min(cell_depth, most)
    model = Forest(low, trees, min(most, max(QUEUE_DEPTH, cell_depth)), seed)
    taken = share_taken(share, n)
    looks = model.cells(low[:2048], taken, cell_depth)
    blocks = max(1, round(n * len(looks[1]) / len(looks[0]) / (trees << cell_depth) / ask_rows))
    forest = spark.sparkContext.broadcast(model)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 2048):
                part = pdf.iloc[s : s + 2048]
                x = np.stack(part["v"])
                raw, rep = np.array(_packed(x), dtype=object), part["rep"].to_numpy()
                bound, row, cell, own = forest.value.cells(_unit(x).astype(np.float32), taken, cell_depth)
                mine = rep[row] % blocks
                # Each row asks in its block of every cell it looks into, and is data in all blocks of its own.
                sent = [(row, cell, mine, own, np.ones(len(row), dtype=bool))]
                sent += [(row[o], cell[o], np.full(o.sum(), b), own[o], np.zeros(o.sum(), dtype=bool)) for b in range(blocks) if (o := own & (mine != b)).any()]
                row, cell, block, data, ask = (np.concatenate(c) for c in zip(*sent))
                yield pd.DataFrame({"cell": cell, "block": block, "rep": rep[row], "vec": raw[row], "bound": bound[row], "is_data": data, "ask": ask})

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x, ids = _unit(_unpacked(pdf["vec"], dim)), pdf["rep"].to_numpy()
        d, q = np.flatnonzero(pdf["is_data"].to_numpy(dtype=bool)), np.flatnonzero(pdf["ask"].to_numpy(dtype=bool))
        bound, data, asks = pdf["bound"].to_numpy(dtype=np.float32)[q], x[d].astype(np.float32), x[q].astype(np.float32)
        slots = k + 4  # some more than asked for, as these scores are of single precision
        best = np.full((len(q), slots), -2.0, dtype=np.float32)
        who = np.zeros((len(q), slots), dtype=np.int64)

        def visit(rows: np.ndarray, askers: np.ndarray) -> None:
            for s in range(0, len(askers), 4096):
                a = askers[s : s + 4096]
                sim = asks[a] @ data[rows].T
                sim[ids[q[a]][:, None] == ids[d[rows]][None, :]] = -2.0
                better = np.flatnonzero(sim.max(axis=1) > best[a].min(axis=1))
                if len(better):
                    a, sim = a[better], np.hstack([best[a[better]], sim[better]])
                    names = np.hstack([who[a], np.broadcast_to(rows, (len(a), len(rows)))])
                    top = np.argpartition(-sim, slots - 1, axis=1)[:, :slots]
                    best[a], who[a] = np.take_along_axis(sim, top, axis=1), np.take_along_axis(names, top, axis=1)

        search_cell(data, asks, bound, leaf_rows, np.random.default_rng((seed, int(pdf["cell"].iloc[0]))), visit)
        near, score = [], []
        for s in range(0, len(q), 4096):
            w = who[s : s + 4096]
            exact = np.einsum("ij,ikj->ik", x[q[s : s + 4096]], x[d[w]]) if len(d) else np.zeros(w.shape)
            exact[best[s : s + 4096] < -1.5] = -np.inf
            names = ids[d[w]] if len(d) else w
            top = np.lexsort((names, -exact), axis=1)[:, :k]
            for a, b in zip(np.take_along_axis(names, top, axis=1), np.take_along_axis(exact, top, axis=1)):
                ok = b > -2
                near.append(a[ok])
                score.append(b[ok])
        return pd.DataFrame({"rep": ids[q], "near": near, "score": score})

    sent = points.repartition(max(1, min(4096, n // 2048)), "rep").mapInPandas(route, "cell int, block int, rep bigint, vec binary, bound float, is_data boolean, ask boolean")
    found = sent.groupBy("cell", "block").applyInPandas(rerank, "rep bigint, near array<bigint>, score array<double>")
    # One shuffle of lists by the asking vector; what follows is partitioned alike.
    pairs = found.where(F.size("near") > 0).repartition("rep").select("rep", F.explode(F.arrays_zip("near", "score")).alias("x")).select("rep", "x.near", "x.score")
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
    near = pairs.groupBy("rep", "near").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rep", "near", "score")
    # Expand classes: of each class only its k + 1 smallest ids can be neighbours of anything.
    first = of_class.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("near"), F.col("id").alias("neighbour"))
    options = near.unionByName(of_class.where("id = rep").select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("score"))).join(first, "near")
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "neighbour")
    lists = options.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("rep", "neighbour", "score")
    each = salted_join(of_class, lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "neighbour"))).alias("l")), ["rep"])
    mine = each.select("id", F.posexplode(F.slice(F.filter("l", lambda e: e["neighbour"] != F.col("id")), 1, k)).alias("p", "e"))
    return mine.select("id", F.col("e.neighbour").alias("neighbour"), (-F.col("e.neg")).alias("score"), (F.col("p") + 1).alias("rank"))
