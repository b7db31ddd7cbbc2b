"""Four retrievers over all questions at once.

Each gives a row for each passage: qid, pid, p_ord, score, rank (ties to the earlier
passage), path (for the top_k), steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FlowConfig, RetrievalConfig
from ..functions.embed import with_similarity
from .community import communities
from .flow import diffuse, seeds


def ranked(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*(keys or ("qid",))).orderBy(F.desc("score"), "p_ord")))


def _finish(scored: DataFrame, path, steps: int, top_k: int) -> DataFrame:
    r = ranked(scored)
    return r.select("qid", "pid", "p_ord", "score", "rank", F.when(F.col("rank") <= top_k, path(r)).alias("path"), F.lit(steps).alias("steps"))


def passage_similarity(questions: DataFrame, passages: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = passages.select("qid", "pid", "p_ord", "title", text.alias("body")).join(questions.select("qid", "question"), "qid")
    return with_similarity(rows, "question", "body", "sim", cfg.embed).drop("body", "question")


def vector_retrieval(questions: DataFrame, passages: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    scored = passage_similarity(questions, passages, cfg).withColumn("score", F.col("sim"))
    path = lambda r: F.concat(F.lit("Query -> [Vector Similarity="), F.format_string("%.3f", "score"), F.lit("] -> ("), F.col("title"), F.lit(")"))
    return _finish(scored, path, 0, cfg.top_k)


def community_retrieval(questions: DataFrame, passages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """A passage scores by its community's text and its own; the community's text is that of its nodes in order."""
    found = communities(nodes, edges).join(nodes, ["qid", "node_id"])
    bodies = passages.select("qid", F.concat(F.lit("p::"), "pid").alias("node_id"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 150)).alias("body"))
    found = found.join(bodies, ["qid", "node_id"], "left")
    of = found.groupBy("qid", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_ord", F.coalesce("body", "name", "node_id").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    of = with_similarity(of.join(questions.select("qid", "question"), "qid").select("qid", "community", "text", "question"), "question", "text", "community_sim", cfg.embed)
    member = found.where("node_type = 'passage'").select("qid", "pid", "community").join(of.select("qid", "community", "community_sim"), ["qid", "community"])
    direct = passage_similarity(questions, passages, cfg).join(member.select("qid", "pid", "community_sim"), ["qid", "pid"], "left")
    score = F.when(F.col("community_sim").isNull(), cfg.orphan_share * F.col("sim")).otherwise(cfg.community_share * F.col("community_sim") + (1 - cfg.community_share) * F.col("sim"))
    path = lambda r: F.concat(F.lit("Query -> Community #"), F.col("rank") - 1, F.lit(" -> ("), F.col("title"), F.lit(")"))
    return _finish(direct.withColumn("score", score), path, 1, cfg.top_k)


def dual_scores(high: DataFrame, entity_sims: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """high: qid, pid, p_ord, sim. entity_sims: qid, node_id, sim. -> high with low (scaled to 1 at most) and score."""
    up = edges.select("qid", F.col("src").alias("node_id"), "dst").join(entity_sims.where(F.col("sim") > cfg.entity_cut).select("qid", "node_id", F.col("sim").alias("e")), ["qid", "node_id"])
    low = up.groupBy("qid", F.col("dst").alias("node_id")).agg(F.sum("e").alias("low"))
    both = high.withColumn("node_id", F.concat(F.lit("p::"), "pid")).join(low, ["qid", "node_id"], "left").withColumn("low", F.coalesce("low", F.lit(0.0)))
    most = F.max("low").over(W.partitionBy("qid"))
    both = both.withColumn("low", F.when(most > 0, F.col("low") / most).otherwise(F.col("low"))).drop("node_id")
    return both.withColumn("score", cfg.low_share * F.col("low") + (1 - cfg.low_share) * F.col("sim"))


def dual_retrieval(questions: DataFrame, passages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    names = nodes.where("node_type = 'entity'").select("qid", "node_id", F.coalesce("name", "node_id").alias("name")).join(questions.select("qid", "question"), "qid")
    entity = with_similarity(names, "question", "name", "sim", cfg.embed)
    scored = dual_scores(passage_similarity(questions, passages, cfg), entity, edges, cfg)
    path = lambda r: F.concat(F.lit("Query -> [DualLevel: High="), F.format_string("%.2f", "sim"), F.lit(", Low="), F.format_string("%.2f", "low"), F.lit("] -> ("), F.col("title"), F.lit(")"))
    return _finish(scored, path, 1, cfg.top_k)


def flow_state(questions: DataFrame, passages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), params: dict[str, FlowConfig] | None = None, with_flows: bool = False) -> DataFrame:
    """Diffusion results of all kinds; with `params` for each parameter set, told apart by param_id."""
    rows = nodes.join(questions.select("qid", "question"), "qid").select("qid", "node_id", "node_type", "pid", "display_name", "n_ord", "text", "question")
    scored = with_similarity(rows, "question", "text", "sim", cfg.embed).drop("question", "text")
    if params is None:
        return diffuse(seeds(scored, cfg.flow), edges, cfg.flow, cfg.top_k, None, with_flows)
    seeded = None
    for name, flow in params.items():
        one = seeds(scored, flow).withColumn("param_id", F.lit(name))
        seeded = one if seeded is None else seeded.union(one)
    return diffuse(seeded, edges, cfg.flow, cfg.top_k, params, with_flows)


def flow_retrieval(questions: DataFrame, passages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    found = flow_state(questions, passages, nodes, edges, cfg).where("kind = 'passage'").select("qid", F.col("id").alias("pid"), "score", "rank", "path", "steps")
    return found.join(passages.select("qid", "pid", "p_ord"), ["qid", "pid"]).select("qid", "pid", "p_ord", "score", "rank", "path", "steps")
