"""Interfaces of models outside the engine, with deterministic stand-ins for tests and offline use."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def hash_vector(text: str, size: int = 16) -> list[float]:
    """A vector from a SHA-256 digest: the same for the same text everywhere."""
    digest = hashlib.sha256(text.encode()).digest()
    return [digest[i % 32] / 127.5 - 1 for i in range(size)]


def embedded(rows: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """``rows`` with an ``embedding`` of a text column; each worker loads the model once and calls it in batches."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            texts = f[text_col].fillna("").tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])]
            yield f.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def hash_model() -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [hash_vector(t) for t in texts]


def extractive_answer(question: str, evidence: list[tuple[str, str]]) -> str:
    """The first evidence that shares a word with the question, cited; else a refusal."""
    words = set(question.lower().split())
    for citation, text in evidence:
        if words & set(text.lower().split()):
            return f"{text} [{citation}]"
    return "I do not have enough evidence to answer."
