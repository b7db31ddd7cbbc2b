"""Registered queries of the retrievers and the evaluation, and SQL for those that SQL can state.

The questions are those of the conversations. Vectors are unprojected here (EXACT), so that SQL can compute the same cosines.
The projected vectors of the default config have the same retrieval code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EmbedConfig, RetrievalConfig
from ..functions.text import RELATIONS
from ..operators.community import communities, connected_components
from ..operators.extract import extract, triple_rows
from ..operators.graph import fact_edges
from ..operators.metrics import answer_metrics, pivot, retrieval_metrics
from ..operators.retrieve import flow_state
from ..sources.storage import stored
from . import evaluate as ev
from .catalog import _NAMES, _PARTS, _TOKENS, ANSWER, ANSWER_PARTS, _pools, _t

EXACT = RetrievalConfig(embed=EmbedConfig(dimension=4096), boundary="ascii")
COMPARED = ("vector", "dual")
_METRICS = ("exact_match", "f1", "mrr", "recall@1", "recall@2", "recall@3", "recall@5")


def _method(name: str, cfg: RetrievalConfig = RetrievalConfig()):
    def query(spark, d):
        found = ev.retrieve(name, *_pools(spark, d), None, cfg)
        return found.select("qid", "pid", "p_ord", F.round("score", 6).alias("score"), "rank", "steps") if cfg is EXACT else found

    return query


def _renamed(df):
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c.replace("@", "_")) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def evaluation_samples(spark, d):
    rows = ev.evaluate(*_pools(spark, d), "dual", EXACT)[1]
    return _renamed(rows.select("qid", "predicted_answer", *[f"`{c}`" for c in _METRICS], "num_retrieved_passages"))


def _compared(spark, d):
    return ev.compare_methods(*_pools(spark, d), EXACT, COMPARED)


def method_comparison(spark, d):
    return _renamed(_compared(spark, d).select("dataset", "method", "num_samples", *[f"`{c}`" for c in _METRICS]))


def method_pivot(spark, d):
    return _renamed(pivot(_compared(spark, d), "mrr", list(COMPARED)))


def all_methods(spark, d):
    return ev.compare_methods(*_pools(spark, d))


def ablation_study(spark, d):
    return ev.ablations(*_pools(spark, d))


def sensitivity_grid(spark, d):
    return ev.sensitivity(*_pools(spark, d))


def flow_edges(spark, d):
    """What a drawing of each graph shows of its edges."""
    q, p = _pools(spark, d)
    nodes, edges = ev.build(p)
    state = stored(flow_state(q, p, nodes, edges, with_flows=True))
    top = state.where("kind = 'passage' and rank <= 5").select("qid", F.col("id").alias("pid"))
    return ev.graph_view(nodes, edges, state, top)[1]


def flow_invariants(spark, d):
    """What holds of every diffusion: all flow is absorbed, seeds are as chosen, every passage is ranked once."""
    q, p = _pools(spark, d)
    state = stored(flow_state(q, p, *ev.build(p, EXACT), EXACT))
    nodes = state.where("kind = 'node'").groupBy("qid").agg(F.round(F.sum("absorbed"), 6).alias("absorbed"), F.max("num_seeds").alias("num_seeds"), F.count(F.lit(1)).alias("num_nodes"))
    ranks = state.where("kind = 'passage'").groupBy("qid").agg(F.count_distinct("rank").alias("num_ranks"), F.max("rank").alias("last_rank"))
    return nodes.join(ranks, "qid")


def community_invariants(spark, d):
    """What holds of every partition: all nodes are in one community, and none spans two components."""
    nodes, edges = ev.build(_pools(spark, d)[1], EXACT)
    both = communities(nodes, edges).join(connected_components(nodes, edges), ["qid", "node_id"])
    each = both.groupBy("qid", "community").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("parts"))
    return each.groupBy("qid").agg(F.sum("n").alias("num_nodes"), F.max("parts").alias("most_components"))


def ranking_metrics(spark, d):
    """Every pool's passages by length, against those at every third place."""
    p = _pools(spark, d)[1]
    rows = p.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("l"), "p_ord", "pid"))).alias("r"), F.array_sort(F.collect_list(F.when(F.col("p_ord") % 3 == 1, F.col("pid")))).alias("gold"))
    out = retrieval_metrics(rows.select("qid", F.transform("r", lambda x: x["pid"]).alias("retrieved"), "gold"), (1, 3))
    return out.select("qid", *[F.round(F.col(f"`{c}`"), 6).alias(c.replace("@", "_")) for c in ("mrr", "recall@1", "recall@3", "precision@1", "precision@3", "hit@1", "hit@3")])


def alias_scores(spark, d):
    """The first turn as an answer, scored against the second and, as its aliases, all later ones."""
    c = _t(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    rows = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("prediction"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("answer"), F.collect_list(F.when(F.col("turn") > 1, F.col("text"))).alias("aliases"))
    out = answer_metrics(rows.where("prediction is not null and answer is not null"), "prediction", "answer", "aliases", "ascii")
    return out.select("conv_id", "exact_match", F.round("f1", 6).alias("f1"))


#: Sentences that each relation pattern matches, from a nation's name (n), its region's (r) and the next nation's (m).
_SENTENCES = (
    "{n} Lee was born in {r}, in 1900.", "{n} is the largest part of {r}, by far.", "Its capital is {n}, while {r} has none.", "{n} Ann married {r} Bob, in May.", "{r} Bob married {n} Ann, in June.",
    "It was directed by {n} Roe, and seen.", "{n} Poe directed the film {r} Moon, and left.", "It was produced by {m} Ltd, and sold.", "It was founded in 1901 by {n} Roe, in {r}.", "They are headquartered in {m}, and busy.",
    "He was educated at {r} College, and won the {n} Prize, with honours.", "She collaborated with {m} Lee, on maps.", "A novel by {n} Poe, and no other.", "{n} Ann married {r} Bob, again.",
)


def _told(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    other = _t(spark, d, "nation").select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("m"))
    n = n.join(other, "n_nationkey", "left")
    text = F.lit(" ".join(_SENTENCES))
    for name, column in (("{n}", F.initcap("n_name")), ("{r}", F.initcap("r_name")), ("{m}", F.initcap(F.coalesce("m", F.lit("Nowhere"))))):
        text = F.replace(text, F.lit(name), column)
    return n.select(F.col("n_regionkey").cast("string").alias("qid"), F.col("n_nationkey").cast("int").alias("p_ord"), F.col("n_nationkey").cast("string").alias("pid"), F.initcap("n_name").alias("title"), text.alias("text"))


def pattern_triples(spark, d):
    return triple_rows(extract(_told(spark, d), "ascii")).select("qid", "pid", F.col("t_ord").cast("int").alias("t_ord"), "subj", "rel", "obj")


def pattern_fact_edges(spark, d):
    return fact_edges(extract(_told(spark, d), "ascii")).select("qid", "src", "dst", "edge_type", "relation", "capacity", "weight")


QUERIES = {
    "vector_retrieval": _method("vector", EXACT), "dual_retrieval": _method("dual", EXACT), "community_retrieval": _method("community"), "flow_retrieval": _method("flow"),
    "evaluation_samples": evaluation_samples, "method_comparison": method_comparison, "method_pivot": method_pivot, "all_methods": all_methods, "ablation_study": ablation_study, "sensitivity_grid": sensitivity_grid,
    "flow_edges": flow_edges, "flow_invariants": flow_invariants, "community_invariants": community_invariants,
    "ranking_metrics": ranking_metrics, "alias_scores": alias_scores, "pattern_triples": pattern_triples, "pattern_fact_edges": pattern_fact_edges,
}

#: sims: cosines of (qid, body) pairs; `asked` and `body` have a key k and a text t.
_VECTORS = r"""told as (select 'q' || qid as k, question as t from asked union all select k, t from body),
    ws as (select k, list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from (select distinct k, t from told)),
    token as (select k, unnest(w) as x, 1.0::DOUBLE as v from ws union all select k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 1.5 from ws where len(w) > 1
              union all select k, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))), 0.5 from (select k, unnest(w) as x from ws) where length(x) >= 3),
    vec as materialized (select k, ('0x' || right(md5(x), 3))::INT as b, sum(v) as v from token group by all),
    norm as (select k, sqrt(sum(v * v)) as n from vec group by k),
    dot as (select body.qid, body.k, sum(x.v * y.v) as s from (select distinct qid, k from body) body join vec x on x.k = 'q' || qid join vec y on y.k = body.k and x.b = y.b group by body.qid, body.k),
    sims as (select body.qid, body.k, coalesce(s / (a.n * c.n), 0) as sim from (select distinct qid, k from body) body left join dot using (qid, k) left join norm a on a.k = 'q' || body.qid left join norm c on c.k = body.k)"""
_ASKED = "asked as (select conv_id::VARCHAR as qid, coalesce(text, '') as question from conversations where turn = 0)"
_ENTITIES = "ent as (select distinct qid, 'e::' || lower(name) as k, lower(name) as t from name)"
_SCORED = f"""{_NAMES}, {_PARTS}, {_ASKED}, {_ENTITIES},
    body as (select qid, 'p::' || pid as k, title || ' ' || text as t from p union all select qid, k, t from ent), {_VECTORS},
    up as (select qid, p as k, sum(sim) as low from (select qid, p, e as k from assoc) join sims using (qid, k) where sim > 0.2 group by qid, p),
    high as (select p.qid, p.pid, (turn - 1)::INT as p_ord, title, text, coalesce(sim, 0) as sim, coalesce(low, 0) as low from p join asked using (qid) left join sims on sims.qid = p.qid and sims.k = 'p::' || pid left join up on up.qid = p.qid and up.k = 'p::' || pid),
    lows as (select *, case when max(low) over (partition by qid) > 0 then low / max(low) over (partition by qid) else low end as low1 from high),
    scored as (select 'vector' as method, qid, pid, p_ord, title, text, sim as score, 0 as steps from high union all select 'dual', qid, pid, p_ord, title, text, 0.5 * low1 + 0.5 * sim, 1 from lows),
    ranked as (select *, (row_number() over (partition by method, qid order by score desc, p_ord))::INT as rank from scored)"""
_SAMPLES = f"""{_SCORED},
    ctx0 as (select method, qid, string_agg('[Passage ' || rank || ': ' || title || ']' || chr(10) || text, chr(10) || chr(10) order by rank) as ctx, count(*)::INT as got, min(case when p_ord = 0 then rank end) as first from ranked where rank <= 5 group by method, qid),
    ctx1 as (select m.method, asked.qid, question as q0, coalesce(ctx, '') as ctx, coalesce(got, 0) as got, first, gold is not null as has, coalesce(gold, '') as gold
             from asked cross join (select unnest({list(COMPARED)}) as method) m left join ctx0 on ctx0.method = m.method and ctx0.qid = asked.qid
             left join (select conv_id::VARCHAR as qid, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] as gold from conversations where turn = 1) g on g.qid = asked.qid),
    ctx2 as ({ANSWER_PARTS.format('ctx1')}),
    ans as (select *, {ANSWER} as answer from ctx2),
    nrm as (select *, {_TOKENS.format('answer')} as na, {_TOKENS.format('gold')} as ng from ans),
    tok as (select method, qid, 0 as side, unnest(string_split(na, ' ')) as w from nrm where na <> '' union all select method, qid, 1, unnest(string_split(ng, ' ')) from nrm where ng <> ''),
    cnt as (select method, qid, w, sum(1 - side) as a, sum(side) as b from tok group by all),
    com as (select method, qid, sum(least(a, b)) as c, sum(a) as a, sum(b) as b from cnt group by all),
    samples as (select method, qid, answer as predicted_answer, (na = ng)::INT::DOUBLE as exact_match, case when na = '' or ng = '' then (na = ng)::INT::DOUBLE else 2.0 * c / (a + b) end as f1,
                case when not has then 1.0 else coalesce(1.0 / first, 0) end as mrr, {', '.join(f"case when not has then 1.0 else coalesce(first <= {k}, false)::INT end::DOUBLE as recall_{k}" for k in (1, 2, 3, 5))}, got as num_retrieved_passages from nrm left join com using (method, qid))"""
_SHOWN = "exact_match, round(f1, 6) as f1, round(mrr, 6) as mrr, recall_1, recall_2, recall_3, recall_5"
_MEANS = ", ".join(f"round(avg({c}), 6) as {c}" for c in ("exact_match", "f1", "mrr", "recall_1", "recall_2", "recall_3", "recall_5"))
_POOL_NODES = "union all ".join(("select qid, 'p::' || pid as k, title || ' ' || substr(text, 1, 200) as t from p ", "select qid, k, t from ent"))


def _told_sql() -> str:
    text = " ".join(_SENTENCES)
    cap = lambda c: f"upper(left({c}, 1)) || lower(substr({c}, 2))"
    words = lambda c: f"array_to_string(list_transform(string_split({c}, ' '), lambda x: {cap('x')}), ' ')"
    body = f"'{text}'"
    for name, column in (("{n}", "title"), ("{r}", "region"), ("{m}", "other")):
        body = f"replace({body}, '{name}', {column})"
    return f"""base as (select n.n_regionkey::VARCHAR as qid, n.n_nationkey::INT as p_ord, {words('n.n_name')} as title, {words('r_name')} as region, coalesce({words('o.n_name')}, 'Nowhere') as other from nation n join region on n.n_regionkey = r_regionkey left join nation o on o.n_nationkey = n.n_nationkey + 1),
    doc as (select qid, p_ord, title, {body} as text from base),
    sent0 as (select qid, p_ord, title, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as l from doc),
    sent as (select qid, p_ord, title, unnest(range(len(l))) as i, trim(unnest(l)) as s from sent0),
    matched as ({' union all '.join(_pattern_sql(j, *r) for j, r in enumerate(RELATIONS))}),
    found as (select qid, p_ord, title, (row_number() over (partition by p_ord order by i, j, k) - 1)::INT as t_ord, trim(subj) as subj, rel, trim(obj) as obj from matched)"""


def _pattern_sql(j: int, pattern: str, rel: str, groups: int) -> str:
    all_of = lambda g: f"regexp_extract_all(s, '{pattern}', {g})"
    at = f"select qid, p_ord, title, i, {j} as j, unnest(range(len({all_of(1)}))) as k, "
    if groups == 1:
        return at + f"title as subj, '{rel}' as rel, unnest({all_of(1)}) as obj from sent"
    if groups == 2:
        return at + f"unnest({all_of(1)}) as subj, '{rel}' as rel, unnest({all_of(2)}) as obj from sent"
    before, after = rel.split("{rel}")
    return at + f"unnest({all_of(1)}) as subj, '{before}' || trim(unnest({all_of(2)})) || '{after}' as rel, unnest({all_of(3)}) as obj from sent"


SQL = {
    **{f"{m}_retrieval": f"with {_SCORED} select qid, pid, p_ord, round(score, 6) as score, rank, steps from ranked where method = '{m}'" for m in COMPARED},
    "evaluation_samples": f"with {_SAMPLES} select qid, predicted_answer, {_SHOWN}, num_retrieved_passages from samples where method = 'dual'",
    "method_comparison": f"with {_SAMPLES} select 'conversations' as dataset, method, count(*) as num_samples, {_MEANS} from samples group by method",
    "method_pivot": f"with {_SAMPLES} select 'conversations' as dataset, round(avg(mrr) filter (method = 'vector'), 6) as vector, round(avg(mrr) filter (method = 'dual'), 6) as dual from samples",
    "flow_invariants": f"""with {_NAMES}, {_ASKED}, {_ENTITIES}, body as ({_POOL_NODES}), {_VECTORS},
    s as (select qid, count(*) as n, least(10, count(*) filter (sim >= 0.2)) as over, max(sim) > 0 as any_flow from sims group by qid)
    select s.qid, case when any_flow then 1.0 else 0.0 end as absorbed, (case when over > 0 then over else least(2, n) end)::INT as num_seeds, n as num_nodes, np as num_ranks, np::INT as last_rank from s join (select qid, count(*) as np from p group by qid) using (qid) where qid in (select qid from asked)""",
    "community_invariants": f"with {_NAMES}, {_ENTITIES} select qid, (np + ne)::BIGINT as num_nodes, 1::BIGINT as most_components from (select qid, count(*) as np from p group by qid) join (select qid, count(*) as ne from ent group by qid) using (qid)",
    "ranking_metrics": """with p as (select conv_id::VARCHAR as qid, turn - 1 as o, coalesce(text, '') as t from conversations where turn > 0),
    r as (select *, row_number() over (partition by qid order by length(t) desc, o) as rank, o % 3 = 1 as gold from p),
    g as (select qid, count(*) as n, count(*) filter (gold) as g, min(rank) filter (gold) as first, count(*) filter (gold and rank <= 1) as h1, count(*) filter (gold and rank <= 3) as h3 from r group by qid)
    select qid, round(case when g = 0 then 1 else 1 / first end, 6) as mrr, round(case when g = 0 then 1 else h1 / g end, 6) as recall_1, round(case when g = 0 then 1 else h3 / g end, 6) as recall_3,
    round(h1 / least(1, n), 6) as precision_1, round(h3 / least(3, n), 6) as precision_3, (g = 0 or h1 > 0)::INT::DOUBLE as hit_1, (g = 0 or h3 > 0)::INT::DOUBLE as hit_3 from g""",
    "alias_scores": f"""with t as (select conv_id, turn, {_TOKENS.format("coalesce(text, '')")} as n from conversations),
    pair as (select a.conv_id, b.turn, a.n as p, b.n as g from t a join t b on a.conv_id = b.conv_id and a.turn = 0 and b.turn > 0 where a.conv_id in (select conv_id from t where turn = 1)),
    tok as (select conv_id, turn, 0 as side, unnest(string_split(p, ' ')) as w from pair where p <> '' union all select conv_id, turn, 1, unnest(string_split(g, ' ')) from pair where g <> ''),
    cnt as (select conv_id, turn, w, sum(1 - side) as a, sum(side) as b from tok group by all),
    com as (select conv_id, turn, sum(least(a, b)) as c, sum(a) as a, sum(b) as b from cnt group by all)
    select conv_id, max((p = g)::INT::DOUBLE) as exact_match, round(max(case when p = '' or g = '' then (p = g)::INT::DOUBLE else 2.0 * c / (a + b) end), 6) as f1 from pair left join com using (conv_id, turn) group by conv_id""",
    "pattern_triples": f"with {_told_sql()} select qid, p_ord::VARCHAR as pid, t_ord, subj, rel, obj from found",
    "pattern_fact_edges": f"""with {_told_sql()}, t as (select qid, p_ord * 1000 + t_ord as o, 'e::' || lower(subj) as s, 'e::' || lower(obj) as d, rel from found where lower(subj) <> lower(obj) and subj <> '' and obj <> ''),
    f as (select qid, least(s, d) as a, greatest(s, d) as b, arg_min(s, o) as s1, arg_min(d, o) as d1, arg_min(rel, o) as r1, count(*) as n, count(*) filter (s = least(s, d)) as up from t group by qid, least(s, d), greatest(s, d)),
    g as (select *, case when s1 = a then up else n - up end as fwd from f)
    select qid, s1 as src, d1 as dst, 'fact' as edge_type, r1 as relation, fwd::DOUBLE as capacity, 1.0::DOUBLE as weight from g union all select qid, d1, s1, 'fact_reciprocal', 'inv_' || r1, (0.5 + n - fwd)::DOUBLE, 0.5 from g""",
}
