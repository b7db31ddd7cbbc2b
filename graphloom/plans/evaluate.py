"""Experiments: every question of a dataset in one plan for each configuration."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.text import extractive_answer
from ..operators.extract import extract
from ..operators.graph import entity_hybrid, passage_entity_graph
from ..operators.metrics import answer_metrics, consolidated, retrieval_metrics, summary
from ..operators.retrieve import community_retrieval, dual_retrieval, flow_retrieval, flow_state, vector_retrieval
from ..sources.datasets import gold_passages
from ..sources.storage import stored

#: A retriever takes (questions, passages, nodes, edges, cfg) and gives a row for each passage: qid, pid, p_ord, score, rank, path, steps.
Retriever = Callable[[DataFrame, DataFrame, "DataFrame | None", "DataFrame | None", RetrievalConfig], DataFrame]
RETRIEVERS: dict[str, Retriever] = {
    "vector": lambda questions, passages, nodes, edges, cfg: vector_retrieval(questions, passages, cfg),
    "community": community_retrieval,
    "dual": dual_retrieval,
    "flow": flow_retrieval,
}
WITHOUT_GRAPH = {"vector"}
METHODS = ("vector", "community", "dual", "flow")
SENSITIVITY = ((1.0, 0.01, 0.2), (2.0, 0.01, 0.2), (3.0, 0.01, 0.2), (2.0, 0.005, 0.2), (2.0, 0.05, 0.2), (2.0, 0.01, 0.1), (2.0, 0.01, 0.4))


def build(passages: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all questions, kept: several retrievers read them. `extracted`: the passages' extraction, if it is at hand."""
    nodes, edges = passage_entity_graph(stored(extract(passages, cfg.boundary)) if extracted is None else extracted, cfg.graph, cfg.embed)
    return stored(nodes), stored(edges)


def register_retriever(name: str, retriever: Retriever, graph: bool = True) -> None:
    """Makes a retriever known by name. graph: whether it wants nodes and edges."""
    RETRIEVERS[name] = retriever
    WITHOUT_GRAPH.discard(name) if graph else WITHOUT_GRAPH.add(name)


def retrieve(method: str, questions: DataFrame, passages: DataFrame, graph: tuple[DataFrame, DataFrame] | None, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    nodes, edges = (None, None) if method in WITHOUT_GRAPH else graph or build(passages, cfg)
    return RETRIEVERS[method](questions, passages, nodes, edges, cfg)


FORMS = {
    "numbered": lambda: F.concat(F.lit("[Passage "), F.col("rank"), F.lit(": "), F.col("title"), F.lit("]\n"), F.col("text")),
    "titled": lambda: F.concat(F.lit("["), F.col("title"), F.lit("]\n"), F.col("text")),
    "line": lambda: F.concat(F.lit("["), F.col("title"), F.lit("] "), F.col("text")),
}


def context(top: DataFrame, form: str = "numbered") -> DataFrame:
    """top (qid, rank, pid, title, text) -> qid, retrieved, titles, context."""
    rows = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "title", FORMS[form]().alias("block"), "path", "steps"))).alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    return rows.select("qid", pick("pid").alias("retrieved"), pick("title").alias("retrieved_titles"), F.array_join(pick("block"), "\n\n").alias("context"), F.coalesce(F.get(pick("path"), 0), F.lit("")).alias("sample_path"), F.array_max(pick("steps")).alias("diffusion_steps"))


def samples(questions: DataFrame, passages: DataFrame, results: DataFrame, k: int, form: str = "numbered", boundary: str = "unicode") -> DataFrame:
    """A row for each question: what was retrieved, the answer, and all metrics. Questions without passages have empty results."""
    top = results.where(F.col("rank") <= k).join(passages.select("qid", "pid", "title", "text"), ["qid", "pid"])
    none = F.array().cast("array<string>")
    rows = questions.join(context(top, form), "qid", "left").join(gold_passages(questions, passages), "qid")
    rows = rows.withColumns({"retrieved": F.coalesce("retrieved", none), "retrieved_titles": F.coalesce("retrieved_titles", none), "context": F.coalesce("context", F.lit("")), "sample_path": F.coalesce("sample_path", F.lit("")), "diffusion_steps": F.coalesce("diffusion_steps", F.lit(0))})
    rows = rows.withColumn("predicted_answer", extractive_answer(F.col("question"), F.col("context"), boundary))
    rows = answer_metrics(retrieval_metrics(rows, (1, 2, 3, k)), "predicted_answer", "answer", "answer_aliases", boundary)
    recalls = [F.col(f"`recall@{x}`") for x in sorted({1, 2, 3, k})]
    return rows.select("qid", "dataset", "question", F.col("answer").alias("gold_answer"), "predicted_answer", "exact_match", "f1", "mrr", *recalls, F.size("retrieved").alias("num_retrieved_passages"), "diffusion_steps", "retrieved_titles", "sample_path")


def evaluate(questions: DataFrame, passages: DataFrame, method: str = "flow", cfg: RetrievalConfig = RetrievalConfig(), graph: tuple | None = None, timed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary, samples) of one method.

    timed: with the mean time in ms that a question took to retrieve and to answer. Questions run together, so that this is the
    stage's time over their number; building the graph isn't part of it.
    """
    graph = graph if graph or method in WITHOUT_GRAPH else build(passages, cfg)
    if not timed:
        rows = samples(questions, passages, retrieve(method, questions, passages, graph, cfg), cfg.top_k, boundary=cfg.boundary).withColumn("method", F.lit(method))
        return summary(rows, cfg.top_k, "dataset", "method"), rows
    n, began = max(1, questions.count()), time.perf_counter()
    found = stored(retrieve(method, questions, passages, graph, cfg))
    retrieved = time.perf_counter()
    rows = stored(samples(questions, passages, found, cfg.top_k, boundary=cfg.boundary).withColumn("method", F.lit(method)))
    took = {"retrieval_latency_ms": retrieved - began, "generation_latency_ms": time.perf_counter() - retrieved}
    took["total_latency_ms"] = sum(took.values())
    rows = rows.withColumns({k: F.lit(1000 * x / n) for k, x in took.items()})
    return summary(rows, cfg.top_k, "dataset", "method"), rows


def compare_methods(questions: DataFrame, passages: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), methods: tuple[str, ...] = METHODS) -> DataFrame:
    graph = build(passages, cfg)
    return consolidated([evaluate(questions, passages, m, cfg, graph)[0] for m in methods])


def ablations(questions: DataFrame, passages: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    extracted = stored(extract(passages, cfg.boundary))
    full = build(passages, cfg, extracted)
    uniform = replace(cfg, flow=replace(cfg.flow, query_aware=False))
    runs = {
        "full": ("flow", cfg, full),
        "no_diffusion": ("vector", cfg, full),
        "uniform_seeds": ("flow", uniform, full),
        "no_synonymy": ("flow", cfg, passage_entity_graph(extracted, replace(cfg.graph, synonymy=False), cfg.embed)),
        "no_facts": ("flow", cfg, passage_entity_graph(extracted, replace(cfg.graph, facts=False), cfg.embed)),
        "entity_graph": ("flow", cfg, entity_hybrid(extracted)),
    }
    return consolidated([evaluate(questions, passages, m, c, g)[0].withColumn("ablation", F.lit(name)) for name, (m, c, g) in runs.items()])


def sensitivity(questions: DataFrame, passages: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), grid: tuple = SENSITIVITY) -> DataFrame:
    """All parameter points in one diffusion, grouped by question and point."""
    params = {f"alpha={a}_eps={e}_step={s}": replace(cfg.flow, alpha=a, epsilon=e, step=s) for a, e, s in grid}
    nodes, edges = build(passages, cfg)
    state = stored(flow_state(questions, passages, nodes, edges, cfg, params).where("kind = 'passage'"))
    place = passages.select("qid", "pid", "p_ord")
    out = []
    for name, flow in params.items():
        found = state.where(F.col("param_id") == name).select("qid", F.col("id").alias("pid"), "score", "rank", "path", "steps").join(place, ["qid", "pid"])
        rows = samples(questions, passages, found, cfg.top_k, boundary=cfg.boundary)
        out.append(summary(rows, cfg.top_k, "dataset").withColumns({"alpha": F.lit(flow.alpha), "epsilon": F.lit(flow.epsilon), "step_size": F.lit(flow.step)}))
    return consolidated(out)


def graph_view(nodes: DataFrame, edges: DataFrame, state: DataFrame, top: DataFrame, small: float = 0.001, high: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a drawing with sizes by absorbed flow, labels and widths by flow. `state` has flows."""
    absorbed = state.where("kind = 'node'").select("qid", F.col("id").alias("node_id"), "absorbed")
    flows = state.where("kind = 'edge'").select("qid", F.col("id").alias("src"), "dst", F.when(F.col("flow") > small, F.col("flow")).otherwise(0.0).alias("flow"))
    picked = top.select("qid", F.concat(F.lit("p::"), "pid").alias("node_id"), F.lit(True).alias("picked"))
    n = nodes.join(absorbed, ["qid", "node_id"], "left").join(picked, ["qid", "node_id"], "left")
    label = F.when(F.length("display_name") > 25, F.concat(F.substring("display_name", 1, 25), F.lit("..."))).otherwise(F.col("display_name"))
    size = F.when(F.col("picked"), 25).when(F.col("node_type") == "passage", 18).otherwise(14 + F.least((F.coalesce("absorbed", F.lit(0.0)) * 30).cast("int"), F.lit(20)))
    n = n.select("qid", "node_id", "node_type", label.alias("label"), F.coalesce("picked", F.lit(False)).alias("retrieved"), F.coalesce("absorbed", F.lit(0.0)).alias("flow"), size.alias("size"))
    e = edges.join(flows, ["qid", "src", "dst"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
    relation = F.coalesce("relation", "edge_type", F.lit(""))
    return n, e.select("qid", "src", "dst", F.when(F.col("flow") > high, relation).otherwise("").alias("label"), "flow", (F.col("flow") > high).alias("high"), F.greatest(F.lit(1.0), F.least(F.col("flow") * 8.0, F.lit(6.0))).alias("width"))


def plot_subgraph(nodes: DataFrame, edges: DataFrame, state: DataFrame, seeded: DataFrame, least: float = 0.01, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """The nodes that a figure of each graph shows, the first `most` of those with flow, seeds and passages, and the edges between them."""
    absorbed = state.where("kind = 'node'").select("qid", F.col("id").alias("node_id"), "absorbed")
    n = nodes.join(absorbed, ["qid", "node_id"], "left").join(seeded.select("qid", "node_id", "is_seed"), ["qid", "node_id"], "left")
    n = n.where((F.col("absorbed") > least) | F.col("is_seed") | (F.col("node_type") == "passage"))
    n = n.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy("n_ord"))).where(F.col("_r") <= most).drop("_r")
    ends = n.select("qid", "node_id")
    e = edges.join(ends.withColumnRenamed("node_id", "src"), ["qid", "src"], "left_semi").join(ends.withColumnRenamed("node_id", "dst"), ["qid", "dst"], "left_semi")
    return n, e


def answer_question(questions: DataFrame, passages: DataFrame, method: str = "flow", cfg: RetrievalConfig | None = None) -> DataFrame:
    """What a request for one or many questions gives: three passages unless cfg says otherwise, contexts headed by titles."""
    cfg = cfg or replace(RetrievalConfig(), top_k=3)
    return samples(questions, passages, retrieve(method, questions, passages, None, cfg), cfg.top_k, "titled", cfg.boundary)

