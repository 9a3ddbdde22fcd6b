"""Models as plug-ins: loaded once in each Python worker, run over Arrow batches.

``load`` is a function without arguments that returns the model; it runs where the model is used, at its first batch, and its result is kept for the
life of the worker. A model file is named by a path all executors reach, or shipped with ``SparkContext.addFile``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextEncoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


_LOADED: dict[Any, Any] = {}


def loaded(load: Callable[[], Any], name: str) -> Any:
    """The model of this worker; made at the first call."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def embedder(load: Callable[[], TextEncoder], name: str, batch: int = 256) -> Callable[..., DataFrame]:
    """An embed(rows, key, text) for the engine and the index: (key, embedding), vectors normalised, none for an empty text."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load, name)
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), batch):
                v = np.asarray(model(list(texts.iloc[at : at + batch])), np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                out += list(np.divide(v, n, out=np.zeros_like(v), where=n > 0))
            yield pd.Series(out, index=texts.index, dtype=object)

    def embed(rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.where(F.trim(text) != "").select(key, encode(F.col(text)).alias("embedding"))

    return embed


def scorer(load: Callable[[], PairScorer], name: str, batch: int = 64) -> Callable[[Column, Column], Column]:
    """A score(query, document) for reranking; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(load, name)
        for queries, documents in batches:
            pairs = list(zip(queries.fillna(""), documents.fillna("")))
            parts = [np.asarray(model(pairs[at : at + batch]), np.float64) for at in range(0, len(pairs), batch)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0), index=queries.index)

    return score
