"""Communities of each question's graph: greedy modularity in a task per graph, and connected components as joins."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def greedy_modularity(n: int, pairs: set[tuple[int, int]]) -> list[int]:
    """Community of each node: the pair whose union raises modularity most is joined until none does. Ties go to the smaller numbers.

    pairs: undirected edges (a <= b), each of weight 1.
    """
    m = float(len(pairs))
    if not m:
        return list(range(n))
    degree = [0.0] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + 1.0
    share = [d / (2 * m) for d in degree]
    gain = lambda a, b: 2 * (near[a][b] / (2 * m) - share[a] * share[b])
    heap = [(-gain(a, b), a, b) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    into = list(range(n))
    while heap:
        g, a, b = heapq.heappop(heap)
        if into[a] != a or into[b] != b or b not in near[a] or -g != gain(a, b):
            continue
        if -g <= 0:
            break
        into[b] = a
        for c, w in near[b].items():
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + w
                del near[c][b]
        del near[a][b]
        near[b] = {}
        share[a] += share[b]
        for c in near[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y))
    root = list(range(n))
    for i in range(n):
        while root[i] != into[root[i]]:
            root[i] = into[root[i]]
    return root


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, node_id, community (the least n_ord in it)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        node = left.sort_by("n_ord").to_pydict()
        number = {x: i for i, x in enumerate(node["node_id"])}
        pairs = {tuple(sorted((number[u], number[v]))) for u, v in zip(right["src"].to_pylist(), right["dst"].to_pylist(), strict=True)} if left.num_rows else set()
        found = greedy_modularity(len(number), pairs)
        return pa.table({"qid": pa.array(node["qid"], pa.string()), "node_id": pa.array(node["node_id"], pa.string()), "community": pa.array(found, pa.int64())})

    n = nodes.select(F.col("qid").cast("string").alias("qid"), "node_id", "n_ord")
    e = edges.select(F.col("qid").cast("string").alias("qid"), "src", "dst")
    return n.groupBy("qid").cogroup(e.groupBy("qid")).applyInArrow(run, "qid string, node_id string, community long")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (qid, node_id), edges (qid, src, dst) -> qid, node_id, component: the least node_id that edges lead to.

    Labels spread along edges and then jump to their label's label; a few rounds for long chains.
    """
    label = stored(nodes.select("qid", "node_id", F.col("node_id").alias("component")))
    both = edges.select("qid", "src", "dst").union(edges.select("qid", "dst", "src")).where("src <> dst").distinct()
    both = stored(both)
    while True:
        near = both.join(label, (both.qid == label.qid) & (both.src == label.node_id)).groupBy(both.qid, F.col("dst").alias("node_id")).agg(F.min("component").alias("m"))
        spread = label.join(near, ["qid", "node_id"], "left").select("qid", "node_id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        spread = stored(spread)
        of = spread.select("qid", F.col("node_id").alias("component"), F.col("component").alias("further"))
        jumped = stored(spread.join(of, ["qid", "component"], "left").select("qid", "node_id", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        changed = jumped.where("component <> old").limit(1).count()
        label = jumped.drop("old")
        if not changed:
            return label
