"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only. A source's documents are dealt to equally many
hash blocks; their hash order is the permutation. A source's target words become an
exact quota of block draws: whole passes over its blocks, then a last pass up to the
block in which the target falls. A binary tree over the output shards divides the
vector of quotas: at each node the left half's vector is one multivariate
hypergeometric draw. A shard then owns disjoint runs of each source's permuted draws
and orders its documents by a keyed hash.

Sizes: the tree's rows are shards x sources and the block table has a row for each
`block_words` words, never one for each document. Prefix sums over blocks run in two
levels of at most 1,024 rows a group for each million blocks. Only the block in which
a source's target falls is folded document by document: about `block_words` words.

A row holds the quotas of all sources: the tree is meant for some thousands of sources, not for one a document.

Defined results: a null text has size 0 and its document is taken with its block at
0 words; null sources form one source, ordered last; rows with equal doc_id are taken
together; an empty table gives an empty mix; other columns aren't looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: ln(x!) for small x; Stirling's series holds beyond.
_SMALL = "array(" + ",".join(f"{math.lgamma(x + 1)!r}D" for x in range(16)) + ")"


def _let(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, which is so evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ln_fact(x: str) -> str:
    big = "(f+0.5D)*ln(f) - f + 0.9189385332046727D + 1D/(12D*f) - 1D/(360D*f*f*f) + 1D/(1260D*f*f*f*f*f)"
    return _let(f"double({x})", "f", f"if(f < 16, element_at({_SMALL}, int(f) + 1), {big})")


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_fact(n)} - {_ln_fact(k)} - {_ln_fact(f'{n} - ({k})')})"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for one draw by inversion: of `drawn` from `total`, how many are of the `good`.

    The sum starts 9 standard deviations and 10 below the mean, where the
    remaining probability is under 1e-18.
    """
    a = "a.t, a.g, a.d"
    mean, sd = "a.d * a.g / a.t", "sqrt(greatest(0D, a.d * (a.g / a.t) * (1D - a.g / a.t)))"
    low = f"greatest(0L, a.d + a.g - a.t, bigint(floor({mean} - 9D * {sd})) - 10L)"
    high = f"least(a.g, a.d, bigint(ceil({mean} + 9D * {sd})) + 10L)"
    p = f"exp({_ln_choose('a.g', 'b.lo')} + {_ln_choose('a.t - a.g', 'a.d - b.lo')} - {_ln_choose('a.t', 'a.d')})"
    step = "named_struct('x', i + 1L, 'p', s.p * ((a.g - i) / (i + 1D)) * ((a.d - i) / (a.t - a.g - a.d + i + 1D)), 'c', s.c + s.p * ((a.g - i) / (i + 1D)) * ((a.d - i) / (a.t - a.g - a.d + i + 1D)))"
    walk = f"aggregate(sequence(b.lo, b.hi - 1L), {_let(p, 'p', chr(110) + 'amed_struct(' + repr('x') + ', b.lo, ' + repr('p') + ', p, ' + repr('c') + ', p)')}, (s, i) -> if(s.c >= a.u, s, {step})).x"
    inner = _let(f"named_struct('lo', {low}, 'hi', {high})", "b", f"if(b.lo >= b.hi, b.lo, {walk})")
    return _let(f"named_struct('t', {total}, 'g', {good}, 'd', {drawn}, 'u', {u})", "a", f"if(a.t = 0L, 0L, {inner})")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size -> and n (place by code point, null last), target.

    Targets share all words by weight, at most `cap` times a source's own; what
    is above goes to the others by weight. In the order of cap / weight the
    capped sources come first, so that one pass finds the level of the rest.
    A row for each source: this table is as long as the list of sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    ranked = sizes.withColumn("n", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")).withColumn("w", w.cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("w"), "n")
    level = (
        ranked.withColumn("k", F.row_number().over(order))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")).cast("double") / F.col("open"))
    )
    fits = F.when(F.col("level") * F.col("w") <= F.col("source_size") * cap, F.struct("k", "level"))
    return level.withColumn("level", F.min(fits).over(everything)["level"]).select(
        "source", "n", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("w")).alias("target")
    )


def split(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """One row with `q`, the draws of each source -> a row (shard, q) for each of 2**levels shards."""
    u = f"(shiftrightunsigned(xxhash64({seed}L, node, size(acc.q)), 11) * {2.0**-53!r}D)"
    fold = (
        "aggregate(q, named_struct('t', aggregate(q, 0L, (x, y) -> x + y), 'd', aggregate(q, 0L, (x, y) -> x + y) div 2L, 'q', cast(array() as array<bigint>)),"
        f" (acc, k) -> {_let(hypergeometric('acc.t', 'k', 'acc.d', u), 'x', 'named_struct(' + repr('t') + ', acc.t - k, ' + repr('d') + ', acc.d - x, ' + repr('q') + ', array_append(acc.q, x))')}).q"
    )
    tree = quotas.select(F.lit(1).cast("long").alias("node"), "q")
    for level in range(levels):
        if level == 10:  # a thousand nodes: from here on the tree is worth dealing out
            tree = tree.repartition(tree.sparkSession.sparkContext.defaultParallelism, "node")
        halves = tree.select("node", "q", F.expr(fold).alias("left"))
        tree = halves.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
                )
            ).alias("half")
        ).select("half.*")
    return tree.select((F.col("node") - 2**levels).alias("shard"), "q")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 1 << 16, shard_words: int = 1 << 21, seed: int = 17) -> DataFrame:
    """docs with doc_id, text, source -> a row for each: doc_id, source, size, source_size, target, draws.

    draws: array of (epoch, shard, place), a member for each time the mix takes
    the document; `place` orders a shard. See the module for the method.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), h.alias("h")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    bits = F.when(F.col("source_size") > block_words, F.ceil(F.log2(F.col("source_size") / block_words))).otherwise(0).cast("int")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = stored(sources.withColumn("bits", bits).withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")))

    s = sources.select(F.col("source").alias("_s"), "n", "source_size", "target", "bits")
    placed = sized.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("block", F.expr("shiftright(h, 60 - bits)"))

    # Words before each block, first over runs of 1,024 blocks and then within a run.
    blocks = placed.groupBy("n", "block").agg(F.sum("size").alias("words")).withColumn("run", F.expr("block div 1024"))
    runs = blocks.groupBy("n", "run").agg(F.sum("words").alias("run_words"))
    runs = runs.select("n", "run", (F.sum("run_words").over(W.partitionBy("n").orderBy("run")) - F.col("run_words")).alias("run_start"))
    within = W.partitionBy("n", "run").orderBy("block")
    blocks = blocks.withColumn("_w", F.sum("words").over(within) - F.col("words")).join(runs, ["n", "run"])
    blocks = stored(
        blocks.join(sources.select("n", "bits", "epochs", "rest"), "n").select(
            "n", "block", "bits", "epochs", "rest", "words", (F.col("run_start") + F.col("_w")).alias("start")
        )
    )

    # Quotas in draws, split among the shards; each draw of a source then belongs to one shard.
    some = F.when(F.col("start") < F.col("rest"), F.col("block") + 1).otherwise(0)
    quota = blocks.groupBy("n").agg((F.max(F.expr("epochs * shiftleft(1L, bits)")) + F.max(some)).alias("draws"), F.first("epochs").alias("epochs"))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    levels = max(0, math.ceil(math.log2(max(1.0, total / shard_words))))
    vector = quota.agg(F.array_sort(F.collect_list(F.struct("n", "draws"))).alias("q")).select("q.n", F.col("q.draws").alias("q"))
    ids = vector.select(F.posexplode("n").alias("at", "n"))
    shares = split(vector.select("q"), levels, seed).select("shard", F.posexplode("q").alias("at", "quota"))
    shares = shares.withColumn("start", F.sum("quota").over(W.partitionBy("at").orderBy("shard")) - F.col("quota")).where("quota > 0")
    shares = shares.join(ids, "at").select("n", "shard", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("draw"))
    drawn = blocks.select("n", "block", F.explode(F.expr("sequence(0L, epochs)")).alias("epoch"), "epochs", "start", "rest", "bits").where("epoch < epochs or start < rest")
    drawn = drawn.withColumn("draw", F.expr("epoch * shiftleft(1L, bits) + block")).join(shares, ["n", "draw"])
    drawn = drawn.groupBy("n", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("got"))
    blocks = blocks.join(drawn, ["n", "block"], "left").select(
        "n", "block", "got", F.when((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") > F.col("rest")), F.col("rest") - F.col("start")).alias("gap"), "epochs"
    )

    # In the block where the target falls, documents in permuted order are taken while they fit.
    docs_at = placed.join(blocks, ["n", "block"])
    edge = docs_at.where("gap is not null and size > 0").groupBy("n", "block", "gap", "h", "doc_id").agg(F.sum("size").alias("size"))
    edge = edge.groupBy("n", "block", "gap").agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "size"))).alias("all"))
    fold = F.expr("aggregate(all, named_struct('gap', gap, 'in', cast(array() as array<struct<h:bigint,doc_id:bigint>>)), (a, d) -> if(d.size <= a.gap, named_struct('gap', a.gap - d.size, 'in', array_append(a.in, named_struct('h', d.h, 'doc_id', d.doc_id))), a)).in")
    fits = edge.select("n", F.explode(fold).alias("d")).select("n", F.col("d.h").alias("h"), F.col("d.doc_id").alias("_id"), F.lit(True).alias("fits"))
    docs_at = docs_at.join(fits, (docs_at.n == fits.n) & (docs_at.h == fits.h) & docs_at.doc_id.eqNullSafe(fits._id), "left").drop(fits.n).drop(fits.h)
    taken = F.expr("filter(coalesce(got, array()), g -> g.epoch < epochs or gap is null or fits)")
    placed_draws = F.transform(taken, lambda g: F.struct(g["epoch"].alias("epoch"), g["shard"].alias("shard"), F.xxhash64(F.lit(seed), g["epoch"], g["shard"], "h", "doc_id").alias("place")))
    return docs_at.select("doc_id", "source", "size", "source_size", "target", placed_draws.alias("draws"))


def materialize(docs: DataFrame, mixed: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: each document of `docs` as often as `mixed` took it, shard by shard, shuffled within.

    docs' own columns come back unchanged and alone. Rows of an equal doc_id share
    the decision.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    draws = mixed.groupBy(F.col("doc_id").alias("_id2")).agg(F.first("draws").alias("_draws"))
    out = row.join(draws, F.col("_id").eqNullSafe(F.col("_id2"))).select("_row", F.explode("_draws").alias("_draw"))
    out = out.repartition(shards, "_draw.shard") if shards else out.repartition("_draw.shard")
    return out.sortWithinPartitions("_draw.shard", "_draw.place").select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def mix_sql(documents: str) -> str:
    """DuckDB SQL: CTEs up to `mixed` (doc_id, size, source_size, target, copies) over the relation `documents`."""
    return f"""
    sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT as size,
                     ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT as h from {documents}),
    src0 as (select source, sum(size)::BIGINT as source_size, (row_number() over (order by source nulls last) - 1)::INT as n from sized group by source),
    src1 as (select *, [5, 2, 1][n % 3 + 1]::BIGINT as w from src0),
    src2 as (select *, row_number() over (order by source_size::DOUBLE / w, n) as k,
                    (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size::DOUBLE / w, n rows between unbounded preceding and 1 preceding), 0))::DOUBLE
                      / (sum(w) over (order by source_size::DOUBLE / w, n rows between current row and unbounded following))::DOUBLE as lev from src1),
    src3 as (select *, least((source_size * 3)::DOUBLE, (select lev from src2 where lev * w <= source_size * 3 order by k limit 1) * w) as target from src2),
    src4 as (select *, case when source_size > 65536 then ceil(log2(source_size / 65536.0))::INT else 0 end as bits,
                    case when source_size > 0 then floor(target / source_size)::BIGINT else 0 end as epochs from src3),
    src as (select *, floor(target - epochs * source_size + 0.5)::BIGINT as rest from src4),
    placed as (select d.*, n, source_size, target, epochs, rest, (h >> (60 - bits)) as block from sized d join src s on d.source is not distinct from s.source),
    blk0 as (select n, block, epochs, rest, sum(size)::BIGINT as words from placed group by all),
    blk as (select *, (sum(words) over (partition by n order by block) - words)::BIGINT as start from blk0),
    edge as (select p.n, p.h, p.doc_id, p.size, b.rest - b.start as gap, row_number() over (partition by p.n order by h, doc_id) as rn
             from placed p join blk b on p.n = b.n and p.block = b.block where b.start < b.rest and b.start + b.words > b.rest and p.size > 0),
    fold as (select n, rn, doc_id, size <= gap as fits, gap - case when size <= gap then size else 0 end as gap from edge where rn = 1
             union all
             select e.n, e.rn, e.doc_id, e.size <= f.gap, f.gap - case when e.size <= f.gap then e.size else 0 end from fold f join edge e on e.n = f.n and e.rn = f.rn + 1),
    mixed as (select p.doc_id, p.size, p.source_size, p.target,
                     p.epochs + case when b.start < b.rest and b.start + b.words <= b.rest then 1
                                     when b.start < b.rest then coalesce(f.fits, p.size = 0)::INT else 0 end as copies
              from placed p join blk b on p.n = b.n and p.block = b.block left join fold f on f.n = p.n and f.doc_id = p.doc_id)"""


OP1_SQL = f"with recursive {mix_sql('documents')} select doc_id, size, source_size, target, (size * copies)::BIGINT as taken from mixed"

QUERIES = {"op1_mix_sources": op1_mix_sources}
SQL = {"op1_mix_sources": OP1_SQL}
