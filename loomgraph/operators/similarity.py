"""Top-k by vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, negative_distance


def similarity(a, b, metric: str = "cosine"):
    if metric == "cosine":
        return cosine(a, b)
    if metric == "euclidean":
        return negative_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def find_similar(vectors: DataFrame, key, k: int = 10, metric: str = "cosine", id_col: str = "uri", vec_col: str = "vec") -> DataFrame:
    """The k rows most similar to the row `key`, itself left out; ties by id, none if the key is unknown.

    The one query row is sent to all tasks; each keeps k rows, and only those meet."""
    q = vectors.filter(F.col(id_col) == F.lit(key)).select(F.col(vec_col).alias("q")).limit(1)
    others = vectors.filter(F.col(id_col) != F.lit(key))
    scored = others.join(F.broadcast(q)).select(id_col, similarity(F.col(vec_col), F.col("q"), metric).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_texts(query: str, candidates: DataFrame, encode, k: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The k candidates nearest to a query text under an encoder, repeated texts kept."""
    q = encode(candidates.sparkSession.createDataFrame([(query,)], f"{text_col} string"), text_col).select(F.col("vec").alias("q"))
    coded = encode(candidates, text_col)
    scored = coded.join(F.broadcast(q)).select(id_col, text_col, cosine(F.col("vec"), F.col("q")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


class HashedNgrams:
    """A text encoder without a model: character trigrams hashed into `dim` places, counted. Built-in functions only."""

    def __init__(self, dim: int = 64, n: int = 3):
        self.dim, self.n = dim, n

    def __call__(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (self.n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(self.n)))
        number = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long")
        places = F.transform(grams, lambda g: F.pmod(number(g), F.lit(self.dim)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.size(F.filter("places", lambda p: p == i)).cast("float"))
        return rows.withColumn("places", places).withColumn("vec", counts).drop("places")


class CallableEncoder:
    """A Python function from texts to a 2-d array, called in batches on the executors."""

    def __init__(self, encode, batch_size: int = 32):
        self.encode, self.batch_size = encode, batch_size

    def __call__(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        encode, size = self.encode, self.batch_size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for i in range(0, len(pdf), size):
                    part = pdf.iloc[i : i + size]
                    yield part.assign(vec=list(np.asarray(encode(part[text_col].tolist()), dtype=np.float32)))

        from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("vec", ArrayType(FloatType()))]))
