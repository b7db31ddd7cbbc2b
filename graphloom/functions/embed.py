"""Hashed n-gram embeddings: words, their 3-grams and neighbouring pairs, projected to a dense unit vector.

`Embedder` works on Arrow batches. `features` gives its sparse vectors, `with_embedding` the dense
ones and `with_similarity` cosines; a text's vector is made within its row, so nothing shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EmbedConfig


@lru_cache(maxsize=4)
def projection(dimension: int, buckets: int, seed: int) -> np.ndarray:
    """dimension x buckets with orthonormal rows, the same everywhere for a seed (up to signs of rows)."""
    gauss = np.random.RandomState(seed).randn(dimension, buckets).astype(np.float32)
    return np.ascontiguousarray(np.linalg.qr(gauss.T)[0].T[:dimension]).astype(np.float32)


@lru_cache(maxsize=1 << 18)
def _bucket(token: str) -> int:
    """md5 modulo 4096: its last three hex digits."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[-2:], "big") & 0xFFF


class Embedder:
    """Text to a unit vector (zero for a text without words). Keeps the last texts' vectors."""

    def __init__(self, cfg: EmbedConfig = EmbedConfig()):
        self.cfg, self.whole = cfg, cfg.dimension == cfg.buckets
        self.columns = None if self.whole else np.ascontiguousarray(projection(cfg.dimension, cfg.buckets, cfg.seed).T)
        self.one = lru_cache(maxsize=(1 << 25) // ((8 if self.whole else 4) * cfg.dimension))(self._one)  # 32 MB of vectors

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, ascending; summed weights) before the vector is scaled to length 1."""
        words, c = text.lower().split(), self.cfg
        grams = [_bucket(w[i : i + 3]) for w in words for i in range(len(w) - 2)]
        pairs = [_bucket(f"{a}_{b}") for a, b in zip(words, words[1:], strict=False)]
        where = [_bucket(w) for w in words] + grams + pairs
        weight = np.repeat([c.word_weight, c.gram_weight, c.pair_weight], [len(words), len(grams), len(pairs)])
        dense = np.bincount(np.array(where, np.int64), weights=weight, minlength=c.buckets)
        used = np.flatnonzero(dense)
        return used, dense[used]

    def _one(self, text: str) -> np.ndarray:
        used, weight = self.sparse(text)
        if self.whole:
            v = np.zeros(self.cfg.dimension)
            v[used] = weight / np.linalg.norm(weight) if len(used) else weight
            return v
        if not len(used):
            return np.zeros(self.cfg.dimension, np.float32)
        v = (weight / np.linalg.norm(weight)).astype(np.float32) @ self.columns[used]
        n = np.linalg.norm(v)
        return v / n if n > 0 else v

    def many(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.one(t) for t in texts]) if texts else np.zeros((0, self.cfg.dimension), np.float32)


class Embeds(Protocol):
    """What a worker embeds with: vectors of unit length, zero for a text without words."""

    def one(self, text: str) -> np.ndarray: ...

    def many(self, texts: list[str]) -> np.ndarray: ...


class EmbeddingModel(Protocol):
    """What a config names: hashable and picklable, with a name, a dimension and a way to make the worker's object."""

    name: str
    dimension: int

    def make(self) -> Embeds: ...


@dataclass(frozen=True)
class RemoteModel:
    """A model behind a service. connect() gives a function from texts to vectors; where there is none, or a call fails, the hashed embedder of the same dimension stands in."""

    name: str
    dimension: int
    connect: Callable[[], Callable[[list[str]], np.ndarray]] | None = None

    def fallback(self) -> EmbedConfig:
        return EmbedConfig(dimension=self.dimension, name=f"fallback-{self.name}")

    def make(self) -> Embeds:
        return _Remote(self)


class _Remote:
    def __init__(self, model: RemoteModel):
        self.local, self.call = Embedder(model.fallback()), None
        try:
            self.call = model.connect() if model.connect else None
        except Exception:
            self.call = None
        self.one = lru_cache(maxsize=(1 << 25) // (4 * model.dimension))(lambda text: self.many([text])[0])

    def many(self, texts: list[str]) -> np.ndarray:
        if self.call is not None and texts:
            try:
                v = np.asarray(self.call(texts), np.float32)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                return v / np.where(n == 0, 1, n)
            except Exception:
                self.call = None
        return self.local.many(texts)


def embedding_model(name: str, dimension: int | None = None, connect: Callable | None = None) -> EmbeddingModel | EmbedConfig:
    """A model by (a part of) its name; an unknown name is the hashed embedder under that name."""
    known = name.lower().strip()
    if "nvidia" in known or "nv-embed" in known:
        return RemoteModel("nvidia/nv-embed-v2", dimension or 4096, connect)
    if "openai" in known or "text-embedding-3" in known:
        return RemoteModel("text-embedding-3-small", dimension or 1536, connect)
    return EmbedConfig(dimension=dimension or 256, name="local-hash-embed" if "local" in known or "hash" in known else name)


_made: dict[EmbedConfig | EmbeddingModel, Embeds] = {}


def embedder(cfg: EmbedConfig | EmbeddingModel) -> Embeds:
    if cfg not in _made:
        _made[cfg] = Embedder(cfg) if isinstance(cfg, EmbedConfig) else cfg.make()
    return _made[cfg]


def features(df: DataFrame, text: str, cfg: EmbedConfig = EmbedConfig()) -> DataFrame:
    """df with `buckets` (ascending) and `weights`: each text's sparse vector before it is scaled to length 1."""
    at, names = df.columns.index(text), [*df.columns, "buckets", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [embedder(cfg).sparse(t or "") for t in b.column(at).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]), pa.int32())
            used, weights = (np.concatenate([np.empty(0, kind), *x]) for x, kind in (([x for x, _ in found], np.int64), ([w for _, w in found], float)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(used.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weights))], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def with_embedding(df: DataFrame, text: str, name: str = "embedding", cfg: EmbedConfig = EmbedConfig()) -> DataFrame:
    """df with an array<float> of each text. For many equal texts take distinct ones first."""
    at, names = df.columns.index(text), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embedder(cfg).many([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * cfg.dimension, pa.int32()), pa.array(v.ravel().astype(np.float32)))], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def with_similarity(df: DataFrame, left: str, right: str, name: str, cfg: EmbedConfig = EmbedConfig()) -> DataFrame:
    """df with the cosine of two texts' embeddings. Vectors stay in the worker: only texts travel."""
    i, j, names = df.columns.index(left), df.columns.index(right), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = embedder(cfg).one
            sims = [float(one(x or "") @ one(y or "")) for x, y in zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sims, pa.float64())], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision; 0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
