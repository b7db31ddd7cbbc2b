"""Quality rules under weak supervision. DataFrame and SQL functions only.

Rules look at a document's counts and vote bad, good or abstain. They come in families of
three that look at one kind of defect in different ways (markup, shouting, repetition,
fragments). Whether a document has a family's defect is hidden; expectation-maximisation over
the family's vote patterns estimates the share of documents that do, and how each rule votes
on those and on the others. Three rules tell a defect from one rule's misfires by agreement:
a rule that alone votes bad on many documents is found to be inaccurate and is overruled.
One sign constraint names the classes: on documents with the defect each of its rules votes
bad at least half of the time. Start rates count as PRIOR documents, so that the corpus'
own votes decide. The posterior probability of quality is that of having no defect at all;
a document is kept if it is at least a half.

Documents are pre-aggregated to vote patterns (at most 3 ** 12 rows, by 4 families at most 27
each), so EM's cost doesn't grow with the corpus. A row is judged by its own text.

Defined results: a null or empty text has all counts 0 and fails the base rule; an
empty table gives no rows; repeated rows, and rows of an equal or null doc_id, are judged one
by one and alike if their texts are; other columns aren't looked at. Whole texts are read,
whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored, table

#: family: (rule, SQL for a bad vote, SQL for a good vote); anything else abstains. Three rules each.
FAMILIES = {
    "markup": (
        ("symbols", "n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
        ("plain_words", "n_plain * 10 < n_words * 6", "n_plain * 10 >= n_words * 8"),
        ("alphanumeric", "n_alnum * 100 < word_chars * 85", "n_alnum * 100 >= word_chars * 92"),
    ),
    "shouting": (
        ("capitals", "n_capitals * 3 > word_chars", "n_capitals * 8 <= word_chars"),
        ("upper_words", "n_upper * 3 > n_words", "n_upper * 10 <= n_words"),
        ("marks", "n_marks * 10 > n_words", "n_marks * 50 <= n_words"),
    ),
    "repetition": (
        ("repeated_lines", "n_dup_lines * 3 > n_lines", "n_dup_lines = 0"),
        ("repeated_words", "n_repeat_words * 3 > n_words", "n_repeat_words * 10 <= n_words"),
        ("variety", "n_distinct * n_distinct < n_words * 9", "n_distinct * n_distinct >= n_words * 25"),
    ),
    "fragments": (
        ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars >= 4 * n_words and word_chars <= 9 * n_words"),
        ("line_words", "n_words < 4 * n_lines", "n_words >= 8 * n_lines"),
        ("sentence_ends", "n_ends * 5 < n_lines", "n_ends * 2 >= n_lines"),
    ),
}
RULES, PER = tuple(r for f in FAMILIES.values() for r in f), 3
#: Rates of bad, abstain and good votes before the first step, on documents without and with the defect, and the share without.
START_GOOD, START_BAD, START_SHARE = (0.05, 0.15, 0.80), (0.70, 0.20, 0.10), 0.9
STEPS, PRIOR, LEAST = 30, 20.0, 0.5

_PLAIN = r"""["'(\[«¿¡]{0,2}[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*[.,;:!?)"'\]»…]{0,3}"""
_END = rf"""[.!?…]["')\]»]*{SPACE}*\z"""
COUNTS = ("n_words", "word_chars", "n_symbols", "n_plain", "n_alnum", "n_capitals", "n_upper", "n_marks", "n_distinct", "n_lines", "n_dup_lines", "n_ends", "n_repeat_words")


def counts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with text -> the columns `carry` and COUNTS, as longs, of each text.

    A window of three words is known by 64 bits of hash. Sorting its windows
    within a document's row finds the repeated ones; rows without a repeat
    (told by counting distinct hashes) skip the sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    windows = F.when(
        F.size("_w") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    # (hash, place) sorted by hash: neighbours of equal hash are repeats; a word is covered by the windows starting at most two before it.
    at = F.expr("array_sort(transform(_h, (x, i) -> named_struct('h', x, 'i', i)))")
    starts = F.expr("transform(filter(_s, (x, i) -> (i > 0 and _s[i - 1].h = x.h) or (i + 1 < size(_s) and _s[i + 1].h = x.h)), x -> x.i)")
    covered = F.expr("size(array_distinct(flatten(transform(_r, i -> array(i, i + 1, i + 2)))))")
    sides = f"^{SPACE}+|{SPACE}+$"
    count = lambda p: F.regexp_count("_t", F.lit(p)).cast("long")
    out = docs.select(*carry, text.alias("_t"))
    out = out.select(
        *carry,
        F.split(F.regexp_replace("_t", sides, ""), f"{SPACE}+").alias("_w"),
        (F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(rf"(?<![^\x20\x09-\x0D]){_PLAIN}(?![^\x20\x09-\x0D])").alias("n_plain"),
        F.length(F.regexp_replace("_t", r"[^\p{L}\p{M}\p{N}]+", "")).cast("long").alias("n_alnum"),
        count("[A-Z]").alias("n_capitals"),
        count("[A-Z]{2,}").alias("n_upper"),
        count("[!?]{2,}").alias("n_marks"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"),
    )
    none = F.col("word_chars") == 0
    keep = (*carry, *(c for c in COUNTS if c != "n_repeat_words"))
    out = out.select(
        *carry,
        F.when(none, 0).otherwise(F.size("_w")).cast("long").alias("n_words"),
        "word_chars", "n_symbols", "n_plain", "n_alnum", "n_capitals", "n_upper", "n_marks",
        F.when(none, 0).otherwise(F.size(F.array_distinct("_w"))).cast("long").alias("n_distinct"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(_END))).cast("long").alias("n_ends"),
        windows.alias("_h"),
    )
    out = out.select(*keep, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), at).alias("_s"))
    out = out.select(*keep, F.when(F.col("_s").isNotNull(), starts).alias("_r"))
    return out.select(*keep, F.coalesce(F.when(F.col("_r").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote_sql(bad: str, good: str) -> str:
    return f"case when {bad} then 0 when {good} then 2 else 1 end"


def voted(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """counts with `pattern`: the rules' votes (0 bad, 1 abstain, 2 good) as base-3 digits, and `base_failed`."""
    pattern: Column = sum((F.expr(_vote_sql(bad, good)) * 3**j for j, (_, bad, good) in enumerate(RULES)), F.lit(0)).cast("int")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts(docs, carry).withColumn("pattern", pattern).withColumn("base_failed", failed)


def _digits(families: int) -> Column:
    """(family, code) of a pattern: the votes of the family's three rules as a number below 27."""
    code = lambda f: F.pmod(F.floor(F.col("pattern") / F.pow(F.lit(27), f)), F.lit(27)).cast("int")
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(families - 1)), lambda f: F.struct(f.alias("family"), code(f).alias("code"))))


def _array(rates: tuple) -> str:
    return f"array({','.join(f'{x}D' for x in rates)})"


def fit(seen: DataFrame, families: int = len(FAMILIES), steps: int = STEPS) -> DataFrame:
    """seen (pattern, n) -> family, seen (code, n, v of each code), s: share without the defect, `good` and `bad` rates by rule and vote.

    One row for each family; its table of at most 27 codes is refitted `steps` times within the row.
    """
    codes = seen.select("n", _digits(families).alias("x")).groupBy("x.family", "x.code").agg(F.sum("n").alias("n"))
    votes = F.array(*[F.floor(F.col("code") / 3**j).cast("int") % 3 for j in range(PER)])
    one = codes.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("code", F.col("n").cast("double").alias("n"), votes.alias("v")))).alias("seen"))
    like = lambda t: " * ".join(f"{t}[{j}][p.v[{j}]]" for j in range(PER))
    chance = f"transform(seen, p -> named_struct('n', p.n, 'v', p.v, 'a', s.share * {like('s.good')}, 'b', (1D - s.share) * {like('s.bad')}))"
    split = f"transform({chance}, p -> named_struct('v', p.v, 'g', p.n * p.a / (p.a + p.b), 'd', p.n * p.b / (p.a + p.b)))"
    mass = lambda c, only="true": f"aggregate(e, 0D, (t, p) -> t + if({only}, p.{c}, 0D))"
    rates = lambda c, start: "array(" + ", ".join("array(" + ", ".join(f"({mass(c, f'p.v[{j}] = {k}')} + {PRIOR * start[k]}D) / ({mass(c)} + {PRIOR}D)" for k in range(3)) + ")" for j in range(PER)) + ")"
    sign = f"transform({rates('d', START_BAD)}, r -> if(r[0] < {LEAST}D, array({LEAST}D, r[1] * {1 - LEAST}D / (1D - r[0]), r[2] * {1 - LEAST}D / (1D - r[0])), r))"
    update = f"named_struct('share', ({mass('g')} + {PRIOR * START_SHARE}D) / ({mass('g')} + {mass('d')} + {PRIOR}D), 'good', {rates('g', START_GOOD)}, 'bad', {sign})"
    step = f"element_at(transform(array({split}), e -> {update}), 1)"
    start = f"named_struct('share', {START_SHARE}D, 'good', array_repeat({_array(START_GOOD)}, {PER}), 'bad', array_repeat({_array(START_BAD)}, {PER}))"
    return one.select("family", "seen", F.expr(f"aggregate(sequence(1, {steps}), {start}, (s, i) -> {step})").alias("s"))


def accuracies(fitted: DataFrame) -> DataFrame:
    """What EM estimates, a row for each rule: its chance of a bad vote with the defect (`hit`) and without (`misfire`), and the defect's share."""
    rows = fitted.select("family", (1 - F.col("s.share")).alias("defect_share"), F.posexplode(F.arrays_zip(F.col("s.good").alias("good"), F.col("s.bad").alias("bad"))).alias("rule", "r"))
    return rows.select("family", (F.col("family") * PER + F.col("rule")).alias("rule"), "defect_share", F.col("r.bad")[0].alias("hit"), F.col("r.good")[0].alias("misfire"))


def posterior(patterns: DataFrame, families: int = len(FAMILIES), steps: int = STEPS) -> DataFrame:
    """patterns: `pattern` of each document -> pattern, p_good. One row for each pattern seen, at most 27 ** families."""
    seen = stored(patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    like = lambda t: " * ".join(f"{t}[{j}][p.v[{j}]]" for j in range(PER))
    free = f"transform(seen, p -> named_struct('code', p.code, 'p', s.share * {like('s.good')} / (s.share * {like('s.good')} + (1D - s.share) * {like('s.bad')})))"
    by_code = fit(seen, families, steps).select("family", F.explode(F.expr(free)).alias("x")).select("family", "x.code", "x.p")
    return seen.select("pattern", _digits(families).alias("x")).select("pattern", "x.family", "x.code").join(F.broadcast(by_code), ["family", "code"]).groupBy("pattern").agg(F.product("p").alias("p_good"))  # 27 rows a family


def _judged(votes: DataFrame) -> DataFrame:
    p = F.broadcast(posterior(votes.select("pattern")))  # 12 bytes for each of at most 3 ** 12 patterns
    return votes.join(p, "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def judge(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text -> the counts, `base_failed`, `p_good` and `kept` of each row."""
    return _judged(stored(voted(docs)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns. No row shuffles: each is stored with its votes and filtered by their posterior."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    return _judged(stored(voted(rows, ("_row",)).select("_row", "pattern", "base_failed"))).where("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_sql(documents: str) -> str:
    """DuckDB SQL: CTEs up to `judged` over the relation `documents`."""
    word, families = "[^\\x20\\x09-\\x0D]+", len(FAMILIES)
    quoted = lambda p: p.replace("'", "''")
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))::BIGINT"
    like = lambda t: " * ".join(f"{t}[{j + 1}][v[{j + 1}] + 1]" for j in range(PER))
    pattern = " + ".join(f"{3**j} * {_vote_sql(b, g)}" for j, (_, b, g) in enumerate(RULES))
    rates = lambda w, start: "[" + ", ".join("[" + ", ".join(f"(coalesce(sum({w}) filter (v[{j + 1}] = {k}), 0) + {PRIOR * start[k]}) / (sum({w}) + {PRIOR})" for k in range(3)) + "]" for j in range(PER)) + "]"
    each = lambda rates: f"list_transform(range({PER}), lambda j: {list(rates)}::DOUBLE[])"
    sign = f"list_transform(bad, lambda r: case when r[1] < {LEAST} then [{LEAST}, r[2] * {1 - LEAST} / (1 - r[1]), r[3] * {1 - LEAST} / (1 - r[1])] else r end)"
    return f"""
    txt as (select doc_id, coalesce(text, '') as t from {documents}),
    ws as (select doc_id, t, regexp_extract_all(t, '{word}') as w from txt),
    win0 as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from ws where len(w) >= 3),
    win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from win0),
    rep as (select doc_id, i, count(*) over (partition by doc_id, s) as c from win),
    cov as (select doc_id, count(distinct p)::BIGINT as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep where c > 1) group by doc_id),
    ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as l from txt),
    feat as (select ws.doc_id, len(w)::BIGINT as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT as word_chars,
             {count('[#*$%&|<>]')} as n_symbols, len(list_filter(w, lambda x: regexp_full_match(x, '{quoted(_PLAIN)}')))::BIGINT as n_plain,
             length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))::BIGINT as n_alnum, {count('[A-Z]')} as n_capitals, {count('[A-Z]{2,}')} as n_upper, {count('[!?]{2,}')} as n_marks,
             len(list_distinct(w))::BIGINT as n_distinct, len(l)::BIGINT as n_lines, (len(l) - len(list_distinct(l)))::BIGINT as n_dup_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '{quoted(_END)}')))::BIGINT as n_ends, coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words
             from ws join ln using (doc_id) left join cov using (doc_id)),
    voted as materialized (select *, {pattern} as pattern from feat),
    pats as materialized (select pattern, count(*)::DOUBLE as n from voted group by pattern),
    part as (select pattern, n, f, ((pattern // (27 ** f)::BIGINT) % 27)::INT as code from pats, range({families}) r(f)),
    fam as materialized (select f, code, sum(n) as n, list_transform(range({PER}), lambda j: (code // (3 ** j)::INT) % 3) as v from part group by f, code),
    em as (select 0 as step, f, {START_SHARE}::DOUBLE as share, {each(START_GOOD)} as good, {each(START_BAD)} as bad from range({families}) r(f)
           union all
           select step, f, share, good, {sign} as bad from (
             select step + 1 as step, f, (sum(n * g) + {PRIOR * START_SHARE}) / (sum(n) + {PRIOR}) as share, {rates('n * g', START_GOOD)} as good, {rates('n * (1 - g)', START_BAD)} as bad from
               (select step, em.f, n, v, share * {like('good')} / (share * {like('good')} + (1 - share) * {like('bad')}) as g from em join fam on em.f = fam.f where step < {STEPS}) group by step, f)),
    free as (select em.f, code, share * {like('good')} / (share * {like('good')} + (1 - share) * {like('bad')}) as p from em join fam on em.f = fam.f where step = {STEPS}),
    post as (select pattern, product(p) as p_good from part join free using (f, code) group by pattern),
    judged as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and p_good >= 0.5 as kept from voted join post using (pattern))"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {"op8_quality_rules": f"with recursive {quality_sql('documents')} select * from judged"}
