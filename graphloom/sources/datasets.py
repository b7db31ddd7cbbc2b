"""Readers of three multi-hop question formats into (questions, passages).

questions: qid, q_ord, dataset, question, answer, answer_aliases, supporting_facts, entities, metadata (JSON text).
passages: qid, p_ord, pid, title, text, is_supporting, entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTS = "array<struct<title:string,sent_id:int,text:string>>"
_MUSIQUE = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<id:bigint,question:string,answer:string>>"
_PAIRS = "_id string, id string, question string, answer string, answer_aliases array<string>, type string, level string, supporting_facts array<array<string>>, context array<array<string>>, evidences array<array<string>>"


def _limited(questions: DataFrame, passages: DataFrame, max_samples: int | None) -> tuple[DataFrame, DataFrame]:
    if max_samples:
        questions = questions.orderBy("q_ord").limit(max_samples)
        passages = passages.join(questions.select("qid"), "qid", "left_semi")
    return questions, passages


def numbered_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """value, line (from 0 in its file), q_ord (from 0 over all files, by name). blank: whether empty lines count.

    Splits are read in parallel: a line's number is that within its split and the lines of the splits before it,
    of which there is a row for each split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    raw = raw if blank else raw.where(F.trim("value") != "")
    splits = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = lambda *keys: F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before("file").alias("in_file"), before(F.lit(0)).alias("in_all"))
    place = F.col("at") - F.col("first")
    return raw.join(F.broadcast(splits), ["file", "start"]).select("value", (F.col("in_file") + place).alias("line"), (F.col("in_all") + place).alias("q_ord"))


def read_musique(spark: SparkSession, path: str, max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON lines; blank and malformed ones are skipped. A missing id is musique_{line}, lines counted from 0."""
    raw = numbered_lines(spark, path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    row = raw.where(F.trim("value") != "").withColumn("r", F.from_json("value", _MUSIQUE + ", _bad string", options)).where(F.col("r._bad").isNull()).select("line", "q_ord", "r.*").drop("_bad")
    row = row.withColumn("qid", F.coalesce("id", F.concat(F.lit("musique_"), F.col("line")))).withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>")))
    facts = F.transform(F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(False))), lambda p: F.struct(p["title"].alias("title"), F.lit(-1).alias("sent_id"), p["paragraph_text"].alias("text")))
    hops = F.coalesce("question_decomposition", F.array().cast("array<struct<id:bigint,question:string,answer:string>>"))
    questions = row.select(
        "qid", "q_ord", F.lit("musique").alias("dataset"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("answer_aliases"), facts.cast(FACTS).alias("supporting_facts"),
        F.array_distinct(F.transform("paragraphs", lambda p: F.coalesce(p["title"], F.lit("")))).alias("entities"),
        F.to_json(F.struct(hops.alias("question_decomposition"), F.size(hops).alias("num_hops"))).alias("metadata"),
    )
    passages = row.select("qid", F.posexplode("paragraphs").alias("p_ord", "p")).select(
        "qid", "p_ord", F.concat("qid", F.lit("_p"), F.coalesce(F.col("p.idx"), F.col("p_ord"))).alias("pid"), F.coalesce("p.title", F.lit("")).alias("title"),
        F.coalesce("p.paragraph_text", F.lit("")).alias("text"), F.coalesce("p.is_supporting", F.lit(False)).alias("is_supporting"),
        F.filter(F.array("p.title"), lambda t: F.coalesce(t, F.lit("")) != "").alias("entities"),
    )
    return _limited(questions, passages, max_samples)


def _read_pairs(spark: SparkSession, path: str, dataset: str, prefix: str, kind: str, max_samples: int | None) -> tuple[DataFrame, DataFrame]:
    """A JSON array or JSON lines, told by the first character; a malformed record raises."""
    head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1)).limit(1).collect()
    if head and head[0][0] == "[":  # one array is one split
        raw = spark.read.schema(_PAIRS).option("mode", "FAILFAST").option("multiLine", True).json(path).withColumn("q_ord", F.monotonically_increasing_id())
    else:
        raw = numbered_lines(spark, path, blank=False).select("q_ord", F.from_json("value", _PAIRS, {"mode": "FAILFAST"}).alias("r")).select("q_ord", "r.*")
    raw = raw.withColumn("qid", F.coalesce("_id", "id", F.concat(F.lit(prefix), F.col("q_ord")))).withColumn("context", F.coalesce("context", F.array().cast("array<array<string>>")))
    sentences = lambda c: F.from_json(c[1], "array<string>")
    found = F.transform(F.filter(F.coalesce("supporting_facts", F.array().cast("array<array<string>>")), lambda f: F.size(f) >= 2), lambda f: F.struct(f[0].alias("title"), f[1].cast("int").alias("sent_id")))
    if dataset == "hotpotqa":
        text = lambda f: F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(F.col("context"), lambda c: (F.size(c) >= 2) & (c[0] == f["title"])), lambda c: F.when(f["sent_id"] >= 0, F.get(sentences(c), f["sent_id"]))), lambda x: x.isNotNull()), F.lit(-1)), F.lit(""))
    else:
        text = lambda f: F.lit("")
    facts = F.transform(found, lambda f: F.struct(f["title"].alias("title"), f["sent_id"].alias("sent_id"), text(f).alias("text")))
    meta = F.struct(F.coalesce("type", F.lit(kind)).alias("type"), F.coalesce("level", F.lit("medium")).alias("level")) if dataset == "hotpotqa" else F.struct(F.coalesce("type", F.lit(kind)).alias("type"), F.col("evidences"))
    questions = raw.select(
        "qid", "q_ord", F.lit(dataset).alias("dataset"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"),
        (F.array().cast("array<string>") if dataset == "hotpotqa" else F.coalesce("answer_aliases", F.array().cast("array<string>"))).alias("answer_aliases"), facts.cast(FACTS).alias("supporting_facts"),
        F.array_distinct(F.transform(F.filter("context", lambda c: F.size(c) >= 2), lambda c: c[0])).alias("entities"), F.to_json(meta).alias("metadata"),
    )
    titles = F.transform(F.filter(F.coalesce("supporting_facts", F.array().cast("array<array<string>>")), lambda f: F.size(f) >= 1), lambda f: f[0])
    body = F.coalesce(F.array_join(F.from_json(F.col("c")[1], "array<string>"), " "), F.col("c")[1])
    passages = raw.select("qid", titles.alias("gold"), F.posexplode("context").alias("p_ord", "c")).where(F.size("c") >= 2)
    passages = passages.select("qid", "p_ord", F.concat("qid", F.lit("_p"), F.col("p_ord")).alias("pid"), F.col("c")[0].alias("title"), body.alias("text"), F.coalesce(F.array_contains("gold", F.col("c")[0]), F.lit(False)).alias("is_supporting"), F.array(F.col("c")[0]).alias("entities"))
    return _limited(questions, passages, max_samples)


def read_hotpotqa(spark: SparkSession, path: str, max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    return _read_pairs(spark, path, "hotpotqa", "hotpot_", "bridge", max_samples)


def read_twowiki(spark: SparkSession, path: str, max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    return _read_pairs(spark, path, "2wikimultihopqa", "2wiki_", "compositional", max_samples)


#: A reader takes (session, path, max_samples) and gives (questions, passages). Others can be added by name.
Reader = Callable[[SparkSession, str, "int | None"], tuple[DataFrame, DataFrame]]
READERS: dict[str, Reader] = {"musique": read_musique, "hotpotqa": read_hotpotqa, "2wikimultihopqa": read_twowiki}


def read_dataset(spark: SparkSession, name: str, path: str, max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    return READERS[name.lower()](spark, path, max_samples)


def sample_by_id(datasets: list[tuple[DataFrame, DataFrame]], qid: str) -> tuple[DataFrame, DataFrame]:
    """The question of that id and its passages, of the first dataset that has it; LookupError if none does."""
    for questions, passages in datasets:
        found = questions.where(F.col("qid") == qid).limit(1)
        if not found.isEmpty():
            return found, passages.where(F.col("qid") == qid)
    raise LookupError(f"no sample {qid!r}")


def read_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as questions: the first turn asks, the others are its passages, the second is the gold one; the answer is its first sentence."""
    raw = spark.read.parquet(path).select(F.col("conv_id").cast("string").alias("qid"), F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rest = raw.where("turn > 0").select("qid", (F.col("turn") - 1).alias("p_ord"), F.concat_ws("_p", "qid", "turn").alias("pid"), F.concat(F.lit("Turn "), F.col("turn")).alias("title"), "text", (F.col("turn") == 1).alias("is_supporting"))
    answers = raw.where("turn = 1").select("qid", F.split("text", r"(?<=[.!?])\s+")[0].alias("answer"))
    asked = raw.where("turn = 0").select("qid", F.col("qid").cast("long").alias("q_ord"), F.lit("conversations").alias("dataset"), F.col("text").alias("question"))
    questions = asked.join(answers, "qid", "left").select("qid", "q_ord", "dataset", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.array().cast("array<string>").alias("answer_aliases"), F.array().cast(FACTS).alias("supporting_facts"), F.lit("{}").alias("metadata"))
    return questions, rest


def custom_query(spark: SparkSession, question: str, texts: list[dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """One question over given passages: no gold passages, no known answer."""
    q = spark.createDataFrame([("custom", 0, "custom", question, "N/A (Custom Query)", [], [], [], "{}")], f"qid string, q_ord long, dataset string, question string, answer string, answer_aliases array<string>, supporting_facts {FACTS}, entities array<string>, metadata string")
    rows = [("custom", i, f"cust_{i}", t.get("title", f"Passage {i}"), t.get("text", ""), False) for i, t in enumerate(texts)]
    return q, spark.createDataFrame(rows, "qid string, p_ord int, pid string, title string, text string, is_supporting boolean")


def gold_passages(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, gold (array of pid): supporting passages, or else those whose title a supporting fact has (ignoring case)."""
    titles = questions.select("qid", F.transform("supporting_facts", lambda f: F.lower(F.trim(f["title"]))).alias("t"))
    both = passages.join(titles, "qid").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_supporting"), F.col("pid")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.array_contains("t", F.lower(F.trim("title"))), F.col("pid")))).alias("b"),
    )
    both = both.select("qid", F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")).alias("gold"))
    return questions.select("qid").join(both, "qid", "left").select("qid", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"))


def sample_summary(questions: DataFrame, passages: DataFrame) -> DataFrame:
    n = passages.groupBy("qid").agg(F.count(F.lit(1)).alias("num_passages"))
    return questions.select("qid", "dataset", "question").join(n, "qid", "left").join(gold_passages(questions, passages), "qid").select("qid", "dataset", "question", F.coalesce("num_passages", F.lit(0)).alias("num_passages"), F.size("gold").cast("long").alias("num_gold"))
