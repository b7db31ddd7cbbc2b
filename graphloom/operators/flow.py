"""Push-relabel flow diffusion from a question's seed nodes.

`seeds` is declarative. `diffuse` is exact: within a question nodes act one after the
other on shared state, so each question's graph is one group of a cogrouped task and
questions run in parallel. `round_of` is one synchronous round as plain DataFrame
operations, for a graph too large for a task; there all nodes act on the state at the
round's start, which is another (also conserving) schedule and not the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FlowConfig

RESULT = "qid string, param_id string, kind string, id string, dst string, score double, absorbed double, flow double, rank int, path string, steps int, num_seeds int"
_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def seeds(scored: DataFrame, cfg: FlowConfig = FlowConfig(), *keys: str) -> DataFrame:
    """scored (qid, node_id, n_ord, sim) with s0, is_seed, excess and height.

    Only a pool's best few nodes are ranked (each task sends its own best), and come back to its nodes as one short row.
    """
    keys = keys or ("qid",)
    out = scored.withColumn("s0", F.greatest(F.lit(0.0), F.col("sim")))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("s0"), "n_ord"))
    top = out.select(*keys, "node_id", "n_ord", "s0").withColumn("r", best).where(F.col("r") <= max(cfg.max_seeds, cfg.fallback_seeds))
    ranked = top.groupBy(*keys).agg(F.collect_list(F.struct("r", "node_id", "s0")).alias("t"))
    over = F.filter("t", lambda x: (x["r"] <= cfg.max_seeds) & (x["s0"] >= cfg.seed_threshold))
    ranked = ranked.withColumn("t", F.when(F.size(over) > 0, over).otherwise(F.filter("t", lambda x: x["r"] <= cfg.fallback_seeds)))
    total = F.aggregate(F.array_sort(F.transform("t", lambda x: x["s0"])), F.lit(0.0), lambda a, x: a + x)
    ranked = ranked.select(*keys, F.transform("t", lambda x: x["node_id"]).alias("_seeds"), total.alias("_total"))
    out = out.join(ranked, list(keys)).withColumn("is_seed", F.array_contains("_seeds", F.col("node_id")))
    if cfg.query_aware:
        excess, height = F.col("s0") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")), cfg.alpha * F.col("s0")
    else:
        excess, height = 1.0 / F.size("_seeds"), F.lit(cfg.alpha)
    zero = lambda c: F.when(F.col("is_seed"), c).otherwise(0.0)
    return out.withColumn("excess", zero(excess)).withColumn("height", zero(height)).drop("_seeds", "_total")


class FlowGraph:
    """One question's residual network. Arcs are numbered in insertion order; an arc without a counterpart gets one that is never pushed on."""

    def __init__(self, n: int, src: list[int], dst: list[int], capacity: list[float]):
        self.n, self.src, self.dst, self.capacity = n, list(src), list(dst), list(capacity)
        at = {(u, v): a for a, (u, v) in enumerate(zip(src, dst, strict=True))}
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.into: list[list[int]] = [[] for _ in range(n)]
        for a, (u, v) in enumerate(zip(src, dst, strict=True)):
            self.arcs[u].append(a)
            self.into[v].append(a)
        self.back = []
        for u, v in zip(src, dst, strict=True):
            if (v, u) not in at:
                at[v, u] = len(self.src)
                self.src.append(v)
                self.dst.append(u)
                self.capacity.append(0.0)
            self.back.append(at[v, u])
        self.flow = [0.0] * len(self.src)

    def run(self, excess: list[float], height: list[float], cfg: FlowConfig) -> tuple[list[float], int]:
        """(absorbed by node, rounds). Flows stay in self.flow."""
        e, h, flow, cap, dst, back = list(excess), list(height), self.flow, self.capacity, self.dst, self.back
        absorbed, rounds = [0.0] * self.n, 0
        for rounds in range(cfg.max_rounds + 1):
            waiting = [u for u in range(self.n) if e[u] > cfg.epsilon]
            if not waiting or rounds == cfg.max_rounds:
                break
            moved = False
            for u in waiting:
                left = e[u]
                if left <= cfg.epsilon:
                    continue
                pushed, lowest = False, None
                for a in self.arcs[u]:
                    room = cap[a] - flow[a]
                    if room > cfg.residual_floor and h[u] > h[dst[a]]:
                        amount = min(left, cfg.step * (h[u] - h[dst[a]]) * room)
                        if amount > cfg.push_floor:
                            flow[a] += amount
                            flow[back[a]] -= amount
                            left -= amount
                            e[dst[a]] += amount
                            pushed = moved = True
                        if left <= cfg.epsilon:
                            break
                if left > cfg.epsilon and not pushed:
                    lowest = min((h[dst[a]] for a in self.arcs[u] if cap[a] - flow[a] > cfg.residual_floor), default=None)
                    if lowest is None:
                        absorbed[u] += left
                        left = 0.0
                    else:
                        h[u], moved = lowest + cfg.step, True
                stays = left * (1.0 - cfg.damping)
                absorbed[u] += stays
                e[u] = left - stays
            if not moved:
                rounds += 1
                break
        return [a + x for a, x in zip(absorbed, e, strict=True)], rounds

    def trace(self, target: int, is_seed: list[bool], cfg: FlowConfig) -> list[int] | None:
        """The path from a seed to the target whose least flow is greatest, searched backwards over the strongest unvisited predecessors."""
        front, seen, best, best_flow = [([target], 1.0)], {target}, None, -1.0
        for path, least in front:  # grows while it is read
            node = path[-1]
            if len(path) > 1 and is_seed[node]:
                if least > best_flow:
                    best, best_flow = path[::-1], least
                continue
            if len(path) > cfg.path_depth + 1:
                continue
            ways = [(self.flow[a], self.src[a]) for a in self.into[node] if self.src[a] not in seen]
            for f, u in sorted(ways, key=lambda x: -x[0])[: cfg.path_fan_out]:
                seen.add(u)
                front.append(([*path, u], min(least, max(f, cfg.path_floor))))
        return best


def _task(cfg: FlowConfig, top_k: int, params: dict[str, FlowConfig] | None, with_flows: bool):
    def run(key: tuple, node_rows: pa.Table, edge_rows: pa.Table) -> pa.Table:
        node = node_rows.sort_by("n_ord").to_pydict()
        qid, pid = key[0].as_py(), key[1].as_py()
        own = cfg if params is None else params[pid]
        number = {x: i for i, x in enumerate(node["node_id"])}
        edge = edge_rows.sort_by("ord").to_pydict() if edge_rows.num_rows else {c: [] for c in ("src", "dst", "capacity", "weight", "relation", "edge_type")}
        src, dst = [number[x] for x in edge["src"]], [number[x] for x in edge["dst"]]
        g = FlowGraph(len(number), src, dst, edge["capacity"])
        seed = node["is_seed"]
        absorbed, steps = g.run(node["excess"], node["height"], own)
        incoming = np.zeros(len(number))
        np.add.at(incoming, dst, np.maximum(0.0, g.flow[: len(dst)]))
        first = [h / own.alpha if own.alpha > 0 else 0.0 for h in node["height"]]
        score = np.array(absorbed) + own.incoming_weight * incoming + own.seed_weight * np.array(first)
        kind = node["node_type"]
        total = {i: score[i] for i, k in enumerate(kind) if k == "passage"}
        for u, v, w in zip(src, dst, edge["weight"], strict=True):
            if u in total and kind[v] == "entity":
                total[u] += own.entity_weight * w * score[v]
        order = sorted(total, key=lambda i: -total[i])
        rank = {i: r + 1 for r, i in enumerate(order)}
        arc = {(u, v): a for a, (u, v) in enumerate(zip(src, dst, strict=True))}
        show = lambda i: f"({kind[i]}: {node['display_name'][i]})"

        def path(i: int) -> str:
            found = g.trace(i, seed, own)
            if not found:
                return f"Query -> [Direct Retrieval] -> {node['display_name'][i]}"
            out = ["Query", show(found[0])]
            for u, v in zip(found, found[1:], strict=False):
                a = arc[u, v]
                out += [f"--[{edge['relation'][a] or edge['edge_type'][a] or 'connected_to'} | flow={g.flow[a]:.3f}]-->", show(v)]
            return " ".join(out)

        rows = [(qid, pid, "passage", node["pid"][i], None, float(total[i]), absorbed[i], None, rank[i], path(i) if rank[i] <= top_k else None, steps, sum(seed)) for i in order]
        rows += [(qid, pid, "node", node["node_id"][i], None, float(score[i]), absorbed[i], None, None, None, steps, sum(seed)) for i in range(len(number))]
        if with_flows:
            rows += [(qid, pid, "edge", edge["src"][a], edge["dst"][a], None, None, g.flow[a], None, None, steps, sum(seed)) for a in range(len(src))]
        types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        return pa.table([pa.array(c, types[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), RESULT.split(", "), strict=True)], names=_COLUMNS)

    return run


def diffuse(seeded: DataFrame, edges: DataFrame, cfg: FlowConfig = FlowConfig(), top_k: int = 5, params: dict[str, FlowConfig] | None = None, with_flows: bool = False) -> DataFrame:
    """seeded nodes (of `seeds`, with param_id) and edges -> rows of kind passage, node and, if asked for, edge."""
    n = seeded if "param_id" in seeded.columns else seeded.withColumn("param_id", F.lit("default"))
    if params is None:
        e = edges.withColumn("param_id", F.lit("default"))
    else:
        e = edges.withColumn("param_id", F.explode(F.array(*[F.lit(p) for p in params])))
    n = n.select(F.col("qid").cast("string").alias("qid"), "param_id", "node_id", "node_type", "pid", "display_name", "n_ord", "is_seed", "excess", "height")
    e = e.select(F.col("qid").cast("string").alias("qid"), "param_id", "src", "dst", "ord", "edge_type", "relation", "capacity", "weight")
    return n.groupBy("qid", "param_id").cogroup(e.groupBy("qid", "param_id")).applyInArrow(_with_nodes(_task(cfg, top_k, params, with_flows)), RESULT)


def _with_nodes(task):
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], types[x.split()[1]]) for x in RESULT.split(", ")], names=_COLUMNS)
        return task(key, left, right)

    return run


def round_of(state: DataFrame, edges: DataFrame, cfg: FlowConfig = FlowConfig()) -> tuple[DataFrame, DataFrame]:
    """One synchronous round. state: qid, node_id, e, h, absorbed. edges: qid, src, dst, ord, capacity, flow -> the same after it.

    A node's pushes in order are a running sum of what each arc would take.
    """
    u = state.select("qid", F.col("node_id").alias("src"), F.col("e").alias("e_u"), F.col("h").alias("h_u"))
    v = state.select("qid", F.col("node_id").alias("dst"), F.col("h").alias("h_v"))
    arcs = edges.join(u, ["qid", "src"]).join(v, ["qid", "dst"]).withColumn("room", F.col("capacity") - F.col("flow"))
    wish = F.when((F.col("e_u") > cfg.epsilon) & (F.col("room") > cfg.residual_floor) & (F.col("h_u") > F.col("h_v")), cfg.step * (F.col("h_u") - F.col("h_v")) * F.col("room")).otherwise(0.0)
    arcs = arcs.withColumn("wish", wish).withColumn("wish", F.when(F.col("wish") > cfg.push_floor, F.col("wish")).otherwise(0.0))
    before = W.partitionBy("qid", "src").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("e_u") - F.coalesce(F.sum("wish").over(before), F.lit(0.0))
    arcs = arcs.withColumn("push", F.when(left <= cfg.epsilon, 0.0).otherwise(F.least("wish", left)))
    out = arcs.groupBy("qid", F.col("src").alias("node_id")).agg(F.sum("push").alias("out"), F.min(F.when(F.col("room") > cfg.residual_floor, F.col("h_v"))).alias("lowest"))
    into = arcs.groupBy("qid", F.col("dst").alias("node_id")).agg(F.sum("push").alias("into"))
    s = state.join(out, ["qid", "node_id"], "left").join(into, ["qid", "node_id"], "left").fillna(0.0, ["out", "into"])
    active, rest = F.col("e") > cfg.epsilon, F.col("e") - F.col("out")
    stuck = active & (F.col("out") == 0)
    dead = stuck & F.col("lowest").isNull()
    stays = F.when(dead, rest).when(active, rest * (1 - cfg.damping)).otherwise(0.0)
    s = s.select("qid", "node_id", (rest - stays + F.col("into")).alias("e"), F.when(stuck & ~dead, F.col("lowest") + cfg.step).otherwise(F.col("h")).alias("h"), (F.col("absorbed") + stays).alias("absorbed"))
    reverse = arcs.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("push").alias("back"))
    e = arcs.join(reverse, ["qid", "src", "dst"], "left").select("qid", "src", "dst", "ord", "capacity", (F.col("flow") + F.col("push") - F.coalesce("back", F.lit(0.0))).alias("flow"))
    return s, e


def diffuse_rounds(seeded: DataFrame, edges: DataFrame, rounds: int, cfg: FlowConfig = FlowConfig()) -> tuple[DataFrame, DataFrame]:
    """Up to `rounds` synchronous rounds, with the state in the checkpoint folder after each, so that plans stay short and outlive executors."""
    from ..sources.storage import stored

    state = seeded.select("qid", "node_id", F.col("excess").alias("e"), F.col("height").alias("h"), F.lit(0.0).alias("absorbed"))
    arcs = edges.select("qid", "src", "dst", "ord", "capacity", F.lit(0.0).alias("flow"))
    for _ in range(rounds):
        state, arcs = (stored(x) for x in round_of(state, arcs, cfg))
        if not state.where(F.col("e") > cfg.epsilon).limit(1).count():
            break
    return state, arcs
