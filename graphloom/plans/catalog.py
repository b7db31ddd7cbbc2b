"""The engine's registered queries over the shared tables, and SQL for those that SQL can state. Retrieval and evaluation are in retrieval_catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FlowConfig, GraphConfig
from ..functions.embed import cosine, features
from ..functions.text import exact_match, extractive_answer, mentions, normalize_answer, sentences, token_f1
from ..operators.community import connected_components
from ..operators.extract import entity_rows, extract, triple_rows
from ..operators.flow import round_of, seeds
from ..operators.graph import association_edges, entity_graph, fact_edges, graph_stats, passage_entity_graph
from ..operators.metrics import pair_metrics
from ..operators.similar import nearest, similar_pairs
from ..sources.datasets import read_conversations, sample_summary
from ..sources.storage import spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pools(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read_conversations(spark, f"{d}/conversations.parquet")


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extract(_pools(spark, d)[1], "ascii")


def vector_topk(spark, d):
    """Vectors with an id divisible by 20 against all others."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return nearest(v.where("id % 20 = 0"), v, 5).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"), "rank")


def label_retrieval_metrics(spark, d):
    """Relevant to a query: the other vectors of its label."""
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    of = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold_key"))
    hits = vector_topk(spark, d).join(of, "query_id").join(e, "vec_id").select("query_id", "gold_key", "rank", (F.col("label") == F.col("gold_key")).alias("hit"))
    sizes = e.groupBy(F.col("label").alias("gold_key")).agg((F.count(F.lit(1)) - 1).alias("n"))
    out = pair_metrics(hits, sizes, 5)
    return out.select("query_id", F.col("gold_key").alias("label"), *[F.round(c, 6).alias(n) for c, n in (("recall", "recall_5"), ("precision", "precision_5"), ("hit", "hit_5"), ("rr", "rr"))])


def label_metric_averages(spark, d):
    m = label_retrieval_metrics(spark, d)
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("num_samples"), F.round(F.avg("precision_5"), 5).alias("precision_5"), F.round(F.avg("rr"), 5).alias("mrr"))


def synonymy_pairs(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("label").alias("pool"), F.col("vec_id").alias("id"), "embedding")
    return similar_pairs(v, 0.25).select(F.col("pool").cast("int").alias("label"), "a", "b", F.round("sim", 6).alias("sim"))


def sentence_split(spark, d):
    return spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("s_ord", "sentence"))


def entity_mentions(spark, d):
    return spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(mentions(F.col("text"), "ascii")).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def relation_triples(spark, d):
    """Triples of documents under their source's name; without a relation, the source's links to names."""
    docs = spread(_t(spark, d, "documents").select("doc_id", "source", "text")).select(F.col("source").alias("qid"), F.col("doc_id").alias("p_ord"), F.col("doc_id").cast("string").alias("pid"), F.col("source").alias("title"), "text")
    return triple_rows(extract(docs, "ascii")).select(F.col("p_ord").alias("doc_id"), "subj", "rel", "obj")


def association(spark, d):
    return association_edges(_extracted(spark, d)).select("qid", "src", "dst", F.round("capacity", 6).alias("capacity"), "weight")


def facts(spark, d):
    return fact_edges(_extracted(spark, d)).select("qid", "src", "dst", "edge_type", "relation", "capacity", "weight")


def entity_graph_fold(spark, d):
    return entity_graph(_extracted(spark, d))[1].select("qid", "src", "dst", "relation", F.size("relations").alias("n_relations"), "weight")


def entity_passages(spark, d):
    return entity_graph(_extracted(spark, d))[0].select("qid", F.col("node_id").alias("name"), F.size("pids").alias("n_passages"))


def graph_cardinality(spark, d):
    return graph_stats(*passage_entity_graph(_extracted(spark, d), GraphConfig(synonymy=False)))


def pool_summary(spark, d):
    return sample_summary(*_pools(spark, d)).select("qid", "num_passages", "num_gold")


def answer_scores(spark, d):
    """The last turn as a prediction of the second."""
    c = _t(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("prediction"))
    gold = c.where("turn = 1").select("conv_id", F.col("text").alias("gold"))
    p, g = F.col("prediction"), F.col("gold")
    return last.join(gold, "conv_id").select("conv_id", F.md5(normalize_answer(p, "ascii")).alias("normal"), exact_match(p, g, "ascii").alias("em"), F.round(token_f1(p, g, "ascii"), 6).alias("f1"))


def extractive_answers(spark, d):
    q, p = _pools(spark, d)
    context = p.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_ord", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    return q.join(context, "qid").select("qid", extractive_answer(F.col("question"), F.col("context"), "ascii").alias("answer"))


def hash_features(spark, d):
    f = features(spread(_t(spark, d, "documents").select("doc_id", "text")), "text").where(F.size("buckets") > 0)
    return f.select("doc_id", F.size("buckets").cast("long").alias("n_buckets"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w), 4).alias("sum_sq"))


def _seeded(spark, d, cfg: FlowConfig):
    e = _t(spark, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = e.join(q, "label").select(F.col("label").alias("qid"), F.col("vec_id").alias("node_id"), F.col("vec_id").alias("n_ord"), cosine(F.col("q"), F.col("embedding")).alias("sim"))
    return seeds(scored, cfg).select("qid", "node_id", "is_seed", F.round("excess", 6).alias("excess"), F.round("height", 6).alias("height"))


def seed_init(spark, d):
    return _seeded(spark, d, FlowConfig())


def seed_init_uniform(spark, d):
    return _seeded(spark, d, FlowConfig(query_aware=False))


def _trade(spark, d):
    """Nations as nodes; an edge's capacity is the share of its lines that customers of one nation order from suppliers of another."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey").join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    n = lines.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("src"))
    edges = n.select(F.lit("trade").alias("qid"), "src", "dst", F.col("dst").alias("ord"), (share * 20).alias("capacity"), F.lit(0.0).alias("flow"))
    first = F.col("n_regionkey") == 0
    state = _t(spark, d, "nation").select(F.lit("trade").alias("qid"), F.col("n_nationkey").alias("node_id"), F.when(first, 0.2).otherwise(0.0).alias("e"), F.when(first, 1.0 + F.col("n_nationkey") / 25).otherwise(F.col("n_nationkey") / 100).alias("h"), F.lit(0.0).alias("absorbed"))
    return state, edges


def _rounds(n: int):
    def query(spark, d):
        state, edges = _trade(spark, d)
        for _ in range(n):
            state, edges = round_of(state, edges)
        return state.select("node_id", *[F.round(c, 6).alias(c) for c in ("e", "h", "absorbed")])

    return query


def entity_components(spark, d):
    nodes, edges = entity_graph(_extracted(spark, d))
    return connected_components(nodes.select("qid", "node_id"), edges).select("qid", F.col("node_id").alias("name"), "component")


def entities_of_passages(spark, d):
    return entity_rows(_extracted(spark, d)).select("qid", "pid", "name")


QUERIES = {
    "vector_topk": vector_topk, "label_retrieval_metrics": label_retrieval_metrics, "label_metric_averages": label_metric_averages, "synonymy_pairs": synonymy_pairs,
    "sentence_split": sentence_split, "entity_mentions": entity_mentions, "relation_triples": relation_triples, "passage_entities": entities_of_passages, "association_edges": association, "fact_edges": facts,
    "entity_graph_fold": entity_graph_fold, "entity_passages": entity_passages, "graph_stats": graph_cardinality, "sample_summary": pool_summary,
    "answer_scores": answer_scores, "extractive_answer": extractive_answers, "hash_features": hash_features, "seed_init": seed_init, "seed_init_uniform": seed_init_uniform,
    "flow_round_1": _rounds(1), "flow_round_2": _rounds(2), "flow_round_3": _rounds(3), "entity_components": entity_components,
}

_TOP = """q as (select vec_id as query_id, label, embedding::DOUBLE[] as v from embeddings where vec_id % 20 = 0),
    s as (select query_id, q.label, c.vec_id, c.label as l2, list_cosine_similarity(v, c.embedding::DOUBLE[]) as sim from q join embeddings c on c.vec_id <> query_id),
    top as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s qualify rank <= 5)"""
_LABELS = _TOP + """,
    n as (select label, count(*) - 1 as n from embeddings group by label),
    m as (select query_id, any_value(top.label) as label, sum((label = l2)::INT) as hits, min(case when label = l2 then rank end) as first from top group by query_id),
    lm as (select query_id, label, round(case when n = 0 then 1.0 else hits / n end, 6)::DOUBLE as recall_5, round(hits / 5, 6)::DOUBLE as precision_5, case when n = 0 or hits > 0 then 1.0 else 0.0 end::DOUBLE as hit_5,
           round(case when n = 0 then 1.0 when first is null then 0.0 else 1.0 / first end, 6)::DOUBLE as rr from m join n using (label))"""
_STOP = "('The','This','That','It','They','He','She','In','On','At','For','With')"
_NAMES = rf"""p as (select conv_id::VARCHAR as qid, turn, conv_id || '_p' || turn as pid, 'Turn ' || turn as title, coalesce(text, '') as text from conversations where turn > 0),
    mention as (select qid, turn, pid, title, unnest(regexp_extract_all(text, '\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*\b')) as name from p),
    name as (select distinct qid, pid, title, name from (select qid, pid, title, name from mention where length(name) > 2 and name not in {_STOP} union all select qid, pid, title, title from p)),
    fact as (select qid, pid, title as subj, name as obj from name where lower(name) <> lower(title))"""
_PARTS = """part as (select qid, 'p::' || pid as p, 'e::' || lower(name) as e, 1.0::DOUBLE as w from name
             union all select qid, 'p::' || pid, 'e::' || lower(subj), 0.8 from fact union all select qid, 'p::' || pid, 'e::' || lower(obj), 0.8 from fact),
    assoc as (select qid, p, e, round(sum(w), 6) as capacity from part group by qid, p, e)"""
_TOKENS = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


#: An answer needs qid, ctx and q0 of the relation named; ANSWER is the rules' first that finds something.
ANSWER_PARTS = r"select *, lower(q0) as q, regexp_extract_all(ctx, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b') as multi, regexp_extract_all(ctx, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') as names from {}"
ANSWER = r"""coalesce(
      case when regexp_matches(q, '^(were|was|is|are|did|does|do) ') and (contains(q, 'same person') or contains(q, 'both')) then case when len(list_distinct(multi)) < len(multi) then 'yes' else 'no' end end,
      case when contains(q, 'capital') then nullif(trim(regexp_extract(ctx, 'capital is ([A-Z][A-Za-z\s]+?)(?:,|\.|\s+while)', 1)), '') end,
      case when contains(q, 'award') or contains(q, 'prize') then nullif(trim(regexp_extract(ctx, '(?:received|won|earned|shared)\s+(?:the\s+)?(Nobel Prize in [A-Za-z]+)', 1)), '') end,
      case when contains(q, 'birthplace') or contains(q, 'born') then nullif(trim(regexp_extract(ctx, 'born in ([A-Z][A-Za-z\s.]+?)(?:,|\.|\s+on|\s+in|\s+Germany)', 1)), '') end,
      case when contains(q, 'headquarter') then nullif(trim(regexp_extract(ctx, '(?i)Headquartered in ([A-Z][A-Za-z\s.]+?)(?:,|\.|\s+Texas)', 1)), '') end,
      case when contains(q, 'directed') or contains(q, 'director') then nullif(trim(regexp_extract(ctx, 'directed by ([A-Z][A-Za-z\s.]+?)(?:,|\.|\s+and)', 1)), '') end,
      case when contains(q, 'year') or contains(q, 'when') then nullif(trim(regexp_extract(ctx, 'founded in (\d{4})', 1)), '') end,
      case when contains(q, 'year') or contains(q, 'when') then nullif(regexp_extract(ctx, '\b(1\d{3}|20\d{2})\b', 1), '') end,
      list_filter(names, lambda e: not contains(q, lower(e)) and e not in ('The','This','That','It','Passage','Context','Answer'))[1],
      'Insufficient context to answer')"""


def _seed_sql(aware: bool) -> str:
    e, h = ("s0 / case when coalesce(sum(case when seed then s0 end) over g, 0) = 0 then 1 else sum(case when seed then s0 end) over g end", "2.0 * s0") if aware else ("1.0 / sum(seed::INT) over g", "2.0")
    return f"""with q as (select label, arg_min(embedding, vec_id)::DOUBLE[] as v from embeddings group by label),
    s as (select label as qid, vec_id as node_id, greatest(0, list_cosine_similarity(v, embedding::DOUBLE[])) as s0 from embeddings join q using (label)),
    r as (select *, row_number() over (partition by qid order by s0 desc, node_id) as r from s), p as (select *, r <= 10 and s0 >= 0.2 as pass from r),
    z as (select *, case when bool_or(pass) over (partition by qid) then pass else r <= 2 end as seed from p)
    select qid, node_id, seed as is_seed, round(case when seed then {e} else 0 end, 6)::DOUBLE as excess, round(case when seed then {h} else 0 end, 6)::DOUBLE as height from z window g as (partition by qid)"""


def _flow_sql(n: int) -> str:
    sql = """with n as (select c_nationkey as src, s_nationkey as dst, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2),
    e0 as (select src, dst, n / sum(n) over (partition by src) * 20 as cap, 0.0::DOUBLE as f from n),
    s0 as (select n_nationkey as node_id, case when n_regionkey = 0 then 0.2 else 0.0 end::DOUBLE as e, case when n_regionkey = 0 then 1.0 + n_nationkey / 25 else n_nationkey / 100 end::DOUBLE as h, 0.0::DOUBLE as a from nation)"""
    for i in range(n):
        j = i + 1
        sql += f""",
    w{j} as (select x.*, u.e as eu, cap - f as room, v.h as hv, case when u.e > 0.01 and cap - f > 1e-6 and u.h > v.h and 0.2 * (u.h - v.h) * (cap - f) > 1e-7 then 0.2 * (u.h - v.h) * (cap - f) else 0.0 end as wish from e{i} x join s{i} u on src = u.node_id join s{i} v on dst = v.node_id),
    r{j} as (select *, eu - coalesce(sum(wish) over (partition by src order by dst rows between unbounded preceding and 1 preceding), 0) as rem from w{j}),
    d{j} as (select *, case when rem <= 0.01 then 0 else least(wish, rem) end as push from r{j}),
    o{j} as (select src, sum(push) as po, min(case when room > 1e-6 then hv end) as low from d{j} group by src), i{j} as (select dst, sum(push) as pi from d{j} group by dst),
    t{j} as (select node_id, e, h, a, coalesce(po, 0) as po, coalesce(pi, 0) as pi, low, e > 0.01 as act from s{i} left join o{j} on node_id = src left join i{j} on node_id = dst),
    k{j} as (select *, case when act and po = 0 and low is null then e - po when act then (e - po) * 0.15 else 0 end as stay from t{j}),
    s{j} as (select node_id, e - po - stay + pi as e, case when act and po = 0 and low is not null then low + 0.2 else h end as h, a + stay as a from k{j}),
    e{j} as (select x.src, x.dst, x.cap, x.f + x.push - coalesce(y.push, 0) as f from d{j} x left join d{j} y on x.src = y.dst and x.dst = y.src)"""
    return sql + f" select node_id, round(e, 6) as e, round(h, 6) as h, round(a, 6) as absorbed from s{n}"


SQL = {
    "vector_topk": f"with {_TOP} select query_id, vec_id, round(sim, 6) as sim, rank::INT as rank from top",
    "label_retrieval_metrics": f"with {_LABELS} select * from lm",
    "label_metric_averages": f"with {_LABELS} select label, count(*) as num_samples, round(avg(precision_5), 5) as precision_5, round(avg(rr), 5) as mrr from lm group by label",
    "synonymy_pairs": "select x.label, x.vec_id as a, y.vec_id as b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) as sim from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.25",
    "sentence_split": r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents)
    select doc_id, (unnest(range(len(l))))::INT as s_ord, unnest(l) as sentence from s""",
    "entity_mentions": rf"with m as (select doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*\b')) as name from documents) select doc_id, name, count(*) as n from m where length(name) > 2 and name not in {_STOP} group by doc_id, name",
    "relation_triples": rf"""with m as (select doc_id, source, unnest(regexp_extract_all(text, '\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*\b')) as name from documents)
    select distinct doc_id, source as subj, 'associated_with' as rel, name as obj from m where length(name) > 2 and name not in {_STOP} and lower(name) <> lower(source)""",
    "passage_entities": f"with {_NAMES} select qid, pid, name from name",
    "association_edges": f"with {_NAMES}, {_PARTS} select qid, p as src, e as dst, capacity, 1.0::DOUBLE as weight from assoc union all select qid, e, p, capacity, 1.0 from assoc",
    "fact_edges": f"""with {_NAMES}, f as (select qid, 'e::' || lower(subj) as s, 'e::' || lower(obj) as o, count(*)::DOUBLE as n from fact group by all)
    select qid, s as src, o as dst, 'fact' as edge_type, 'associated_with' as relation, n as capacity, 1.0::DOUBLE as weight from f union all select qid, o, s, 'fact_reciprocal', 'inv_associated_with', 0.5, 0.5 from f""",
    "entity_graph_fold": f"with {_NAMES} select qid, subj as src, obj as dst, 'associated_with' as relation, 1::INT as n_relations, count(*)::DOUBLE as weight from fact group by qid, subj, obj",
    "entity_passages": f"with {_NAMES} select qid, name, count(distinct pid)::INT as n_passages from name group by qid, name",
    "graph_stats": f"""with {_NAMES}, {_PARTS}, f as (select qid, count(distinct ('e::' || lower(subj), 'e::' || lower(obj))) as nf from fact group by qid),
    n as (select qid, count(distinct p) as np, count(distinct e) as ne, count(*) as na from assoc group by qid)
    select qid, np + ne as num_nodes, np as num_passages, ne as num_entities, 2 * na + 2 * coalesce(nf, 0) as num_edges from n left join f using (qid)""",
    "sample_summary": "select a.conv_id::VARCHAR as qid, count(b.turn) as num_passages, count(b.turn) filter (b.turn = 1) as num_gold from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn > 0 where a.turn = 0 group by a.conv_id",
    "answer_scores": f"""with t as (select conv_id, arg_max(text, turn) as prediction, any_value(text) filter (turn = 1) as gold from conversations group by conv_id having count(*) filter (turn = 1) > 0),
    n as (select conv_id, {_TOKENS.format('prediction')} as p, {_TOKENS.format('gold')} as g from t),
    pt as (select conv_id, w, count(*) as c from (select conv_id, unnest(string_split(p, ' ')) as w from n where p <> '') group by all), gt as (select conv_id, w, count(*) as c from (select conv_id, unnest(string_split(g, ' ')) as w from n where g <> '') group by all),
    o as (select conv_id, sum(least(pt.c, gt.c)) as common from pt join gt using (conv_id, w) group by conv_id),
    l as (select conv_id, p, g, case when p = '' then 0 else len(string_split(p, ' ')) end as np, case when g = '' then 0 else len(string_split(g, ' ')) end as ng from n)
    select conv_id, md5(p) as normal, (p = g)::INT::DOUBLE as em, round(case when np = 0 or ng = 0 then (np = ng)::INT else coalesce(2.0 * common / (np + ng), 0) end, 6)::DOUBLE as f1 from l left join o using (conv_id)""",
    "extractive_answer": rf"""with c as (select conv_id::VARCHAR as qid, string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) filter (turn > 0) as ctx, any_value(coalesce(text, '')) filter (turn = 0) as q0 from conversations group by conv_id having count(*) filter (turn > 0) > 0 and count(*) filter (turn = 0) > 0),
    b as ({ANSWER_PARTS.format('c')}) select qid, {ANSWER} as answer from b""",
    "hash_features": r"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(trim(text)), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    t as (select doc_id, unnest(ws) as token, 1.0::DOUBLE as v from w
          union all select doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])), 1.5 from w where len(ws) > 1
          union all select doc_id, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))), 0.5 from (select doc_id, unnest(ws) as x from w) where length(x) >= 3),
    f as (select doc_id, ('0x' || right(md5(token), 3))::INT as bucket, sum(v) as weight from t group by all)
    select doc_id, count(*) as n_buckets, round(sum(weight * weight), 4) as sum_sq from f group by doc_id""",
    "seed_init": _seed_sql(True),
    "seed_init_uniform": _seed_sql(False),
    "flow_round_1": _flow_sql(1),
    "flow_round_2": _flow_sql(2),
    "flow_round_3": _flow_sql(3),
    "entity_components": f"""with recursive {_NAMES}, e as (select qid, subj as a, obj as b from fact union select qid, obj, subj from fact),
    r as (select distinct qid, name as node, name as reach from name union select r.qid, r.node, e.b from r join e on r.qid = e.qid and r.reach = e.a)
    select qid, node as name, min(reach) as component from r group by qid, node""",
}
