"""Entities and triples of passages. One narrow projection: nothing shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mentions, strip, triples


def extract(passages: DataFrame, boundary: str = "unicode") -> DataFrame:
    """passages (qid, p_ord, pid, title, text, ...) with `names` (distinct, in order) and `facts`.

    Order: the title, mentions as they come, then arguments of triples. A passage
    without a relation links its title to each of its other names.
    """
    title = strip(F.coalesce(F.col("title"), F.lit("")))
    found = passages.withColumn("_title", title).withColumn("_m", mentions(F.coalesce(F.col("text"), F.lit("")), boundary)).withColumn("facts", triples(F.coalesce(F.col("text"), F.lit("")), title))
    arguments = F.flatten(F.transform("facts", lambda t: F.array(t["subj"], t["obj"])))
    names = F.filter(F.array_distinct(F.concat(F.array("_title"), F.transform("_m", strip), arguments)), lambda n: n != "")
    found = found.withColumn("names", names)
    linked = F.transform(F.filter("names", lambda n: F.lower(n) != F.lower("_title")), lambda n: F.struct(F.col("_title").alias("subj"), F.lit("associated_with").alias("rel"), n.alias("obj")))
    return found.withColumn("facts", F.when((F.size("facts") == 0) & (F.col("_title") != ""), linked).otherwise(F.col("facts"))).drop("_title", "_m")


def entity_rows(extracted: DataFrame) -> DataFrame:
    return extracted.select("qid", "p_ord", "pid", F.posexplode("names").alias("e_ord", "name"))


def triple_rows(extracted: DataFrame) -> DataFrame:
    return extracted.select("qid", "p_ord", "pid", F.posexplode("facts").alias("t_ord", "t")).select("qid", "p_ord", "pid", "t_ord", "t.subj", "t.rel", "t.obj")
