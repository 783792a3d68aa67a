"""Plug-ins for models outside the engine: each takes and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Models(Protocol):
    """What a pipeline asks of models; outputs enter as columns."""

    def embed(self, df: DataFrame, text: str) -> DataFrame: ...

    def logits(self, df: DataFrame, question: str, text: str) -> DataFrame: ...

    def variants(self, questions: DataFrame) -> DataFrame: ...

    def answers(self, prompts: DataFrame) -> DataFrame: ...


def batched_scores(df: DataFrame, question: str, text: str, score: Callable[[list[str], list[str]], list[float]], batch: int = 4, name: str = "logit") -> DataFrame:
    """Adds a score by a function over lists, in Arrow batches; the function is loaded once per worker."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        out: list[float] = []
        for i in range(0, len(texts), batch):
            out += score(questions.iloc[i : i + batch].tolist(), texts.iloc[i : i + batch].tolist())
        return pd.Series(out, dtype="float64")

    return df.withColumn(name, run(question, text))
