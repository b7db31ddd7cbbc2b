"""Folding extracted passages into weighted graphs.

Every row carries `ord`, its place of first insertion, because ties later go to what came
first. All folds are hash aggregations with map-side combination.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EmbedConfig, GraphConfig
from ..functions.text import strip
from .extract import entity_rows, triple_rows

EDGES = ("qid", "src", "dst", "ord", "edge_type", "relation", "capacity", "weight")
_PASSAGE, _PHASE, _STEP = 1 << 40, 1 << 36, 8


def passage_node(pid: Column) -> Column:
    return F.concat(F.lit("p::"), pid)


def entity_node(name: Column) -> Column:
    return F.concat(F.lit("e::"), F.lower(strip(name)))


def _at(phase: int, index: Column, step: int = 0) -> Column:
    return F.col("p_ord").cast("long") * _PASSAGE + phase * _PHASE + index.cast("long") * _STEP + step


def contributions(extracted: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """qid, pid, name, w, ord: each name of a passage, then both arguments of each triple. One pass over the passages."""
    full = F.filter("facts", lambda t: (strip(t["subj"]) != "") & (strip(t["obj"]) != ""))
    named = F.transform("names", lambda n, i: F.struct(strip(n).alias("name"), F.lit(cfg.mention_weight).alias("w"), _at(1, i).alias("ord")))
    argument = lambda t, c, i, step: F.struct(strip(t[c]).alias("name"), F.lit(cfg.argument_weight).alias("w"), _at(2, i, step).alias("ord"))
    given = F.flatten(F.transform(full, lambda t, i: F.array(argument(t, "subj", i, 1), argument(t, "obj", i, 2))))
    return extracted.select("qid", "pid", F.explode(F.concat(named, given)).alias("x")).select("qid", "pid", "x.*").where("name <> ''")


def nodes(extracted: DataFrame) -> DataFrame:
    """qid, node_id, node_type, pid, name, display_name, text, n_ord: passages and entities in order of first insertion."""
    p = extracted.select("qid", passage_node(F.col("pid")).alias("node_id"), F.lit("passage").alias("node_type"), "pid", F.lit(None).cast("string").alias("name"),
                         F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("Passage "), F.col("pid"))).alias("display_name"),
                         F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 200)).alias("text"), _at(0, F.lit(0)).alias("ord"))
    e = contributions(extracted)
    e = e.groupBy("qid", entity_node(F.col("name")).alias("node_id")).agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    e = e.select("qid", "node_id", F.lit("entity").alias("node_type"), F.lit(None).cast("string").alias("pid"), "name", F.col("name").alias("display_name"), F.col("name").alias("text"), "ord")
    return p.union(e).withColumn("n_ord", F.row_number().over(W.partitionBy("qid").orderBy("ord", "node_id")) - 1).drop("ord")


def association_edges(extracted: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """Passage to entity and back: capacities add up, the weight is that of the first contribution."""
    folded = contributions(extracted, cfg).groupBy("qid", passage_node(F.col("pid")).alias("p"), entity_node(F.col("name")).alias("e"))
    folded = folded.agg(F.sum("w").alias("capacity"), F.min_by("w", "ord").alias("weight"), F.min("ord").alias("ord"))
    edge = lambda a, b, step: folded.select("qid", F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("ord") * 2 + step).alias("ord"), F.lit("association").alias("edge_type"), F.lit("mentions").alias("relation"), "capacity", "weight")
    return edge("p", "e", 0).union(edge("e", "p", 1))


def fact_edges(extracted: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """Subject to object, and a weaker edge back. The first triple of a pair sets both edges' type and weight; later ones add to their own direction."""
    t = triple_rows(extracted).select("qid", entity_node(F.col("subj")).alias("s"), entity_node(F.col("obj")).alias("o"), strip(F.col("rel")).alias("rel"), _at(2, F.col("t_ord")).alias("ord"))
    t = t.where((F.col("s") != F.col("o")) & (F.col("s") != "e::") & (F.col("o") != "e::"))
    pair = t.groupBy("qid", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(
        F.min_by(F.struct("s", "o", "rel"), "ord").alias("first"), F.min("ord").alias("ord"),
        F.sum(F.when(F.col("s") == F.least("s", "o"), 1.0).otherwise(0.0)).alias("up"), F.count(F.lit(1)).cast("double").alias("n"),
    )
    forward = F.when(F.col("first.s") == F.col("a"), F.col("up")).otherwise(F.col("n") - F.col("up"))
    there = pair.select("qid", F.col("first.s").alias("src"), F.col("first.o").alias("dst"), (F.col("ord") * 2).alias("ord"), F.lit("fact").alias("edge_type"), F.col("first.rel").alias("relation"), forward.alias("capacity"), F.lit(1.0).alias("weight"))
    back = pair.select("qid", F.col("first.o").alias("src"), F.col("first.s").alias("dst"), (F.col("ord") * 2 + 1).alias("ord"), F.lit("fact_reciprocal").alias("edge_type"), F.concat(F.lit("inv_"), F.col("first.rel")).alias("relation"), (F.lit(cfg.reciprocal) + F.col("n") - forward).alias("capacity"), F.lit(cfg.reciprocal).alias("weight"))
    return there.union(back)


def synonymy_pairs(names: DataFrame, threshold: float, embed: EmbedConfig = EmbedConfig(), block: int = 1024) -> DataFrame:
    """names (qid, name, distinct) -> qid, left, right, sim, i, j for pairs of one pool at the threshold or above, left before right.

    A pool's names are compared block by block; only what passes leaves the task.
    """

    def run(rows: pa.Table) -> pa.Table:
        from ..functions.embed import embedder

        ordered = sorted(rows["name"].to_pylist())
        v = embedder(embed).many(ordered)
        a, b, s = [], [], []
        for i in range(0, len(ordered), block):
            for j in range(i, len(ordered), block):
                sims = v[i : i + block] @ v[j : j + block].T
                x, y = np.nonzero(sims >= threshold)
                keep = x + i < y + j
                a += (x[keep] + i).tolist()
                b += (y[keep] + j).tolist()
                s += sims[x[keep], y[keep]].astype(float).tolist()
        qid = rows["qid"][0].as_py()
        return pa.table({"qid": pa.array([qid] * len(a), pa.string()), "left": pa.array([ordered[i] for i in a], pa.string()), "right": pa.array([ordered[j] for j in b], pa.string()), "sim": pa.array(s, pa.float64()), "i": pa.array(a, pa.int64()), "j": pa.array(b, pa.int64())})

    return names.select(F.col("qid").cast("string").alias("qid"), "name").groupBy("qid").applyInArrow(run, "qid string, left string, right string, sim double, i long, j long")


def synonymy_edges(extracted: DataFrame, cfg: GraphConfig = GraphConfig(), embed: EmbedConfig = EmbedConfig()) -> DataFrame:
    """Both directions of each similar pair of surface forms; of forms that share nodes the last pair counts. Forms that differ in case only give a loop."""
    names = contributions(extracted, cfg).select("qid", "name").distinct()
    pairs = synonymy_pairs(names, cfg.synonymy_threshold, embed)
    both = pairs.select("qid", entity_node(F.col("left")).alias("src"), entity_node(F.col("right")).alias("dst"), "sim", "i", "j", F.lit(0).alias("way"))
    both = both.union(both.select("qid", "dst", "src", "sim", "i", "j", F.lit(1)))
    order = F.struct("i", "j", "way")
    folded = both.groupBy("qid", "src", "dst").agg(F.max_by("sim", order).alias("sim"), F.min(order).alias("first"))
    late = F.lit(1 << 62) + F.col("first.i") * (1 << 24) + F.col("first.j") * 2 + F.col("first.way")
    return folded.select("qid", "src", "dst", late.alias("ord"), F.lit("synonymy").alias("edge_type"), F.lit("synonym").alias("relation"), F.col("sim").alias("capacity"), F.col("sim").alias("weight"))


def upsert(base: DataFrame, over: DataFrame) -> DataFrame:
    """Edges of `over` replace those of `base` between the same nodes but keep their place in the order."""
    tagged = base.select(*EDGES, F.lit(0).alias("_p")).union(over.select(*EDGES, F.lit(1).alias("_p")))
    best = tagged.groupBy("qid", "src", "dst").agg(F.min("ord").alias("ord"), F.max_by(F.struct("edge_type", "relation", "capacity", "weight"), "_p").alias("x"))
    return best.select("qid", "src", "dst", "ord", "x.*")


def passage_entity_graph(extracted: DataFrame, cfg: GraphConfig = GraphConfig(), embed: EmbedConfig = EmbedConfig()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each question's passages."""
    edges = association_edges(extracted, cfg) if cfg.associations else None
    if cfg.facts:
        edges = fact_edges(extracted, cfg) if edges is None else edges.union(fact_edges(extracted, cfg))
    if edges is None:
        edges = association_edges(extracted, cfg).limit(0)
    if cfg.synonymy:
        edges = upsert(edges, synonymy_edges(extracted, cfg, embed))
    return nodes(extracted), edges


def entity_graph(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities only, told apart by case. nodes: qid, node_id, pids, n_ord; edges with all distinct relations and summed weight."""
    e = entity_rows(extracted).select("qid", "pid", strip(F.col("name")).alias("node_id"), _at(1, F.col("e_ord")).alias("ord"))
    t = triple_rows(extracted).select("qid", "pid", strip(F.col("subj")).alias("src"), strip(F.col("obj")).alias("dst"), strip(F.col("rel")).alias("rel"), _at(2, F.col("t_ord")).alias("ord"))
    t = t.where((F.col("src") != "") & (F.col("dst") != "") & (F.lower("src") != F.lower("dst")))
    every = e.where("node_id <> ''").union(t.select("qid", "pid", "src", F.col("ord") + 1)).union(t.select("qid", "pid", "dst", F.col("ord") + 2))
    found = every.groupBy("qid", "node_id").agg(F.array_sort(F.collect_set("pid")).alias("pids"), F.min("ord").alias("ord"))
    found = found.withColumn("n_ord", F.row_number().over(W.partitionBy("qid").orderBy("ord", "node_id")) - 1).drop("ord")
    edges = t.groupBy("qid", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rel"))), lambda x: x["rel"])).alias("relations"), F.min("ord").alias("ord"))
    edges = edges.withColumn("relation", F.col("relations")[0]).withColumn("relations", F.filter("relations", lambda r: r != ""))
    return found, edges.select("qid", "src", "dst", "ord", F.lit("fact").alias("edge_type"), "relation", "relations", "weight")


def entity_hybrid(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entity graph with passage nodes linked both ways to their entities at capacity 1."""
    found, facts = entity_graph(extracted)
    e = found.select("qid", "node_id", F.lit("entity").alias("node_type"), F.lit(None).cast("string").alias("pid"), F.lit(None).cast("string").alias("name"), F.col("node_id").alias("display_name"), F.col("node_id").alias("text"), F.col("n_ord").cast("long").alias("ord"))
    p = nodes(extracted).where("node_type = 'passage'").select("qid", "node_id", "node_type", "pid", "name", "display_name", "text", (F.lit(1 << 40) + F.col("n_ord")).alias("ord"))
    all_nodes = e.union(p).withColumn("n_ord", F.row_number().over(W.partitionBy("qid").orderBy("ord", "node_id")) - 1).drop("ord")
    order = extracted.select("qid", "pid", "p_ord")
    links = found.select("qid", "node_id", "n_ord", F.explode("pids").alias("pid")).join(order, ["qid", "pid"])
    at = F.lit(1 << 61) + (F.col("p_ord").cast("long") * (1 << 24) + F.col("n_ord")) * 2
    link = lambda a, b, step: links.select("qid", a.alias("src"), b.alias("dst"), (at + step).alias("ord"), F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("string").alias("relation"), F.lit(1.0).alias("capacity"), F.lit(1.0).alias("weight"))
    p_node, e_node = passage_node(F.col("pid")), F.col("node_id")
    facts = facts.select("qid", "src", "dst", "ord", "edge_type", "relation", F.col("weight").alias("capacity"), "weight")
    return all_nodes, facts.union(link(p_node, e_node, 0)).union(link(e_node, p_node, 1))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, num_nodes, num_edges, num_passages, num_entities."""
    n = nodes.groupBy("qid").agg(F.count(F.lit(1)).alias("num_nodes"), F.count_if(F.col("node_type") == "passage").alias("num_passages"), F.count_if(F.col("node_type") == "entity").alias("num_entities"))
    return n.join(edges.groupBy("qid").agg(F.count(F.lit(1)).alias("num_edges")), "qid", "left").fillna(0, ["num_edges"])
