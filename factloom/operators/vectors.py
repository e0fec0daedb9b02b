"""Nearest vectors of a query set: exact, in blocks, or by an inverted-list index.

Exact: queries and rows are dealt into blocks; each pair of blocks meets in one task as two matrices, whose
product is cut to the best k per query at once. What is shuffled afterwards is k rows per query
and block of rows. Neither side passes through the driver. The work is that of all pairs.

Indexed: centroids are fitted on a bounded sample; every row is put into the list of its nearest centroid, and a query
meets only the lists of its nearest ones. A long list is split into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.search import top_k
from factloom.session import cut_lineage

QUERY_BLOCK, ROW_BLOCK = 1024, 20_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; cosine similarity for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector with length 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def _best(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query": [], "doc": [], "score": []})
        a = np.stack([np.asarray(v, np.float64) for v in queries["vector"]])
        rows = rows.sort_values("id", kind="stable")
        b = np.stack([np.asarray(v, np.float64) for v in rows["vector"]])
        s = a @ b.T
        n = min(k, s.shape[1])
        order = np.argsort(-s, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"query": np.repeat(queries["id"].to_numpy(), n), "doc": rows["id"].to_numpy()[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, score, rank): for each query the k rows with the greatest dot product.

    A query finds itself if it is among the rows. Rows with a NULL vector or id are left out. Filters
    belong on ``rows``: they are applied before any product is taken.
    """
    q = queries.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    r = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    n_q, n_r = -(-q.count() // QUERY_BLOCK) or 1, -(-r.count() // ROW_BLOCK) or 1
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = r.withColumn("rb", deal(n_r)).withColumn("qb", every(n_q))
    right = q.withColumn("qb", deal(n_q)).withColumn("rb", every(n_r))
    kind = dict(q.dtypes)["id"]
    best = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(_best(k), f"query {kind}, doc {kind}, score double")
    return top_k(best, k)


#: Most rows that centroids are fitted on.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Index:
    """Every row (id, vector, list, part), how many parts each list has, and the centroids: as many numbers as lists times dimensions."""

    rows: DataFrame
    parts: DataFrame
    centroids: np.ndarray


def _lists(centroids, probes: int):
    """Numbers of the ``probes`` nearest centroids of each vector."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def near(vectors: pd.Series) -> pd.Series:
        c = centroids.value
        if not len(vectors):
            return pd.Series([], dtype=object)
        v = np.stack([np.asarray(x, np.float64) for x in vectors])
        far = (c * c).sum(axis=1) - 2 * v @ c.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return near


def build_index(rows: DataFrame, n_lists: int = 64, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 5, sample_rows: int = SAMPLE_ROWS) -> Index:
    """An index of all rows with an id and a vector. Only the fit of the centroids looks at a sample, of about ``sample_rows`` rows at most."""
    spark = rows.sparkSession
    r = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    n = r.count()
    if not n:
        centroids = np.zeros((1, 1))
    else:
        sample = r.sample(min(1.0, sample_rows / n), seed).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        centroids = np.asarray(KMeans(k=max(2, min(n_lists, n // 2)), seed=seed, maxIter=10).fit(sample).clusterCenters())
    put = _lists(spark.sparkContext.broadcast(centroids), 1)
    listed = r.withColumn("list", F.get(put("vector"), F.lit(0)))
    parts = cut_lineage(listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("parts")))
    dealt = listed.join(F.broadcast(parts), "list").select("id", "vector", "list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    return Index(cut_lineage(dealt), parts, centroids)


def nearest_indexed(queries: DataFrame, index: Index, k: int, probes: int = 16, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, score, rank): for each query the ``k`` rows with the greatest dot product among the lists of its ``probes`` nearest
    centroids. More probes find more of the exact result, and all lists all of it."""
    spark = queries.sparkSession
    q = queries.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    ask = _lists(spark.sparkContext.broadcast(index.centroids), probes)
    asked = q.withColumn("list", F.explode(ask("vector"))).join(F.broadcast(index.parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind = dict(q.dtypes)["id"]
    best = index.rows.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(_best(k), f"query {kind}, doc {kind}, score double")
    return top_k(best, k)


def embed(df: DataFrame, doc_id: str, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(doc_id, embedding): unit vectors of each text from an injected embedder, called with ``batch`` texts at a time.

    The embedder is made once per task if it caches its model itself. NULL texts are embedded as empty ones.
    """
    kind = dict(df.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                v = np.asarray(embedder([t or "" for t in part["text"]]), np.float64)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list((v / np.where(norm > 0, norm, 1)).astype(np.float32))})

    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", doc_id)
