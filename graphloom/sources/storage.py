"""Tables kept between steps, and result sinks."""

from __future__ import annotations

import hashlib
import os
import tempfile
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder that the session names. Only a session within one process (tests) may name none."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "graphloom-checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks at least as the cluster runs at once: a small file is one split, however long its rows take."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


class GraphStore:
    """Graphs as Parquet, a folder for each dataset and set of build parameters; so graphs of other parameters are never reused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, dataset: str, config) -> str:
        params = hashlib.sha256(repr(sorted(asdict(config).items())).encode()).hexdigest()[:16]
        return f"{self.root}/dataset={dataset}/params={params}"

    def save(self, dataset: str, config, nodes: DataFrame, edges: DataFrame) -> None:
        nodes.write.mode("overwrite").parquet(self._path(dataset, config) + "/nodes")
        edges.write.mode("overwrite").parquet(self._path(dataset, config) + "/edges")

    def load(self, dataset: str, config) -> tuple[DataFrame, DataFrame] | None:
        try:
            return tuple(self.spark.read.parquet(f"{self._path(dataset, config)}/{x}") for x in ("nodes", "edges"))
        except AnalysisException:
            return None

    def exists(self, dataset: str, config) -> bool:
        return self.load(dataset, config) is not None


class EmbeddingCache:
    """Vectors by (model, text). `embed` computes those that are missing and appends them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def key(model, text):
        return F.sha2(F.concat(model, F.lit("::"), text), 256)

    def table(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "key string, text string, embedding array<float>")

    def missing(self, texts: DataFrame, model: str) -> DataFrame:
        wanted = texts.select("text").distinct().withColumn("key", self.key(F.lit(model), F.col("text")))
        return wanted.join(self.table().select("key"), "key", "left_anti")

    def embed(self, texts: DataFrame, model: str, cfg) -> DataFrame:
        """texts (text) -> text, embedding for each distinct text."""
        from ..functions.embed import with_embedding

        with_embedding(self.missing(texts, model).select("key", "text"), "text", "embedding", cfg).write.mode("append").parquet(self.path)
        wanted = texts.select("text").distinct().withColumn("key", self.key(F.lit(model), F.col("text"))).select("key")
        return self.table().join(wanted, "key", "left_semi").select("text", "embedding")


def clean_name(pipeline: str) -> str:
    return pipeline.lower().replace(" ", "_").replace("-", "_")


def save_metrics(summary: DataFrame, samples: DataFrame, pipeline: str, folder: str) -> None:
    """{name}_results: one JSON document with `summary` (of one method and dataset) and `samples`, in order of q_ord or qid; {name}_samples: CSV with lists as JSON.

    A document is one row of one task: for evaluations of some thousands of questions. `save_table` has no such bound.
    """
    if summary.limit(2).count() != 1:
        raise ValueError("a results document is of one method and one dataset")
    name, order = clean_name(pipeline), "q_ord" if "q_ord" in samples.columns else "qid"
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = samples.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), whole(samples).alias("s")))), lambda x: x["s"]).alias("samples"))  # one document is one row, whatever writes it
    summary.select(whole(summary).alias("summary")).join(rows, F.lit(True), "left").coalesce(1).write.mode("overwrite").json(f"{folder}/{name}_results")
    save_table(samples, f"{folder}/{name}_samples")


def save_table(table: DataFrame, path: str) -> None:
    """A consolidated, comparison, ablation or sensitivity table as one CSV file with a header; lists as JSON."""
    as_text = [F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "struct")) else F.col(f"`{c}`") for c, t in table.dtypes]
    table.select(*as_text).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """A saved CSV table, all columns strings."""
    return spark.read.option("header", True).csv(path)
