"""Calls to models from a plan: injectable clients, retries with growing pauses, results as rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call(rows: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]], attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """(key, ok, answer, error, attempt): one row a prompt, whether or not the model answered.

    ``client`` makes a worker's own callable once; it is pickled, its connections are not. A failed call is tried again
    after pause, twice that, and so on, with some chance in it so that workers do not come back together. A null prompt
    is an error without a call. Offline, a client that looks answers up in a table replays a run.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            out = []
            for k, text in batch.itertuples(index=False, name=None):
                answer, error, attempt = None, None if text is not None else "no prompt", 0
                while text is not None and attempt < attempts and answer is None:
                    attempt += 1
                    try:
                        answer, error = ask(text), None
                    except Exception as e:  # noqa: BLE001 - any failure of a client is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                        if attempt < attempts:
                            time.sleep(pause * 2 ** (attempt - 1) * random.uniform(0.8, 1.2))
                out.append((k, answer is not None, answer, error, attempt))
            yield pd.DataFrame(out, columns=["k", "ok", "answer", "error", "attempt"])

    found = rows.select(key, prompt).mapInPandas(run, f"k {kind}, ok boolean, answer string, error string, attempt int")
    return found.withColumnRenamed("k", key)


def embed(rows: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """``rows`` with ``vector``: the model is loaded once a worker and gets ``batch`` texts at a time; null is as empty."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])], dtype=object)

    return rows.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(text)))


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)
