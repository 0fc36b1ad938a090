"""The boundary to models: a predictor is a function over batches of rows, or a rule over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.functions import vocabulary as V

_METRICS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}


def predict(rows: DataFrame, answer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Adds pred: answer is called once per Arrow batch in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(pred=answer(batch))

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, pred string")


def oracle(rows: DataFrame) -> DataFrame:
    """Answers with the truth about the facts asked for."""
    return rows.withColumn("pred", V.answer(F.col("facts"), {f: F.col(f) for f in V.FACTS}))


def majority_answers(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Answers with each fact's majority label; best is (fact, label), one row a fact."""
    wide = best.groupBy().pivot("fact", V.FACTS).agg(F.max("label"))
    labels = wide.select(F.struct(*V.FACTS).alias("major"))
    return rows.crossJoin(F.broadcast(labels)).withColumn("pred", V.answer(F.col("facts"), {f: F.col(f"major.{f}") for f in V.FACTS})).drop("major")


def prior_answers(rows: DataFrame, label: str = "lesion") -> DataFrame:
    """Answers with the prior box (of detection.with_prior) as coordinate tokens."""
    corners = (F.col(f"prior.{c}") for c in ("x0", "y0", "x1", "y1"))
    said = F.concat(B.tokens(*corners, F.col("w"), F.col("h")), F.lit(f" {label}"))
    return rows.withColumn("pred", F.coalesce(said, F.lit("none")))


def register_metric(name: str, metric: Callable[[DataFrame], DataFrame], description: str = "") -> None:
    _METRICS[name] = metric, description


def describe_metrics() -> dict[str, str]:
    return {name: description for name, (_, description) in _METRICS.items()}


def measure(name: str, rows: DataFrame) -> DataFrame:
    return _METRICS[name][0](rows)
