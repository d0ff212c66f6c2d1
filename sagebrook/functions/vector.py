"""Vector functions: similarity as column expressions and in blocks, and embedders."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def with_cosine(df: DataFrame, column: str, query: list[float], out: str = "similarity") -> DataFrame:
    """Adds the similarity of an array column with one query vector, a matrix product per
    Arrow batch.  Null and ragged vectors give null."""
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def similarity(vectors: pd.Series) -> pd.Series:
        result = np.full(len(vectors), np.nan)
        fits = np.array([v is not None and len(v) == len(q) for v in vectors], dtype=bool)
        if fits.any():
            rows = np.stack(vectors[fits].to_numpy()).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                result[fits] = rows @ q / np.linalg.norm(rows, axis=1)
        return pd.Series(result).where(~np.isnan(result), None)

    return df.withColumn(out, similarity(F.col(column)))


class Embedder(Protocol):
    """Texts to vectors; must be picklable."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """The default embedder: hashed character trigrams of lower-cased text, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            data = np.frombuffer(text.lower().encode(), dtype=np.uint8).astype(np.uint64)
            if len(data) >= 3:
                grams = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
                mixed = grams * np.uint64(0x9E3779B97F4A7C15)
                sign = np.where((mixed >> np.uint64(63)) == 0, 1.0, -1.0)
                np.add.at(out[i], ((mixed >> np.uint64(20)) % np.uint64(self.dimension)).astype(np.int64), sign)
            length = np.linalg.norm(out[i])
            if length:
                out[i] /= length
        return out


def embed(df: DataFrame, text_column: str, out: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    """Adds a vector column by an embedder, a batch at a time."""
    model = embedder or HashedNgrams()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed(["" if t is None else t for t in texts]).astype(np.float32)))

    return df.withColumn(out, run(F.col(text_column)))
