"""Models inside tasks: loaded once by each worker, read in batches, with a way on
where there is none.

A model is a function that loads it and gives a function of a list of texts. The
column ``scores`` is null where the model gave nothing: where it cannot be loaded
or failed on a text. A batch that fails (too long for the memory of a device, as a
rule) is halved until single texts fail, so one text costs only itself.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.storage import importable

Predict = Callable[[list[str]], list]
#: What this worker has loaded, by name; None for good where loading failed.
_LOADED: dict[str, Predict | None] = {}


@dataclass(frozen=True)
class Model:
    """``load`` runs in the worker. Texts go to the model in lists of ``batch`` at
    most. ``loads`` counts how often it was loaded, over all workers."""

    name: str
    load: Callable[[], Predict]
    batch: int = 32
    loads: Accumulator | None = None

    def get(self) -> Predict | None:
        if self.name not in _LOADED:
            try:
                _LOADED[self.name] = self.load()
            except Exception as e:  # noqa: BLE001 - no model means the fallback
                logging.getLogger(__name__).warning("%s cannot be loaded: %s", self.name, e)
                _LOADED[self.name] = None
            if self.loads is not None:
                self.loads.add(1)
        return _LOADED[self.name]

    def predict(self, texts: list[str]) -> list:
        """A result for each text; None where there is none."""
        predict = self.get()
        if predict is None or not texts:
            return [None] * len(texts)
        try:
            found = predict(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} results of {len(texts)} texts")
            return found
        except Exception as e:  # noqa: BLE001 - any failure of a model
            if len(texts) == 1:
                logging.getLogger(__name__).warning("%s failed on a text: %s", self.name, e)
                return [None]
            half = len(texts) // 2
            return self.predict(texts[:half]) + self.predict(texts[half:])


def predicted(model: Model, text: Column, kind: T.DataType) -> Column:
    """The model's result for each text, null where it has none. Texts that stand
    together in a batch and are equal are read once; null texts are not read."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            known: dict = {None: None}
            wanted = list(dict.fromkeys(t for t in texts if t is not None))
            for at in range(0, len(wanted), model.batch):
                part = wanted[at : at + model.batch]
                known.update(zip(part, model.predict(part), strict=True))
            yield pd.Series([known[t] for t in texts], dtype=object)

    # The hints of the types choose the iterator form.
    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(text)


def with_scores(df: DataFrame, text: str, name: str, model: Model | None, fallback: Callable[[Column], Column]) -> DataFrame:
    """``df`` with a map of scores by label: the model's, or the fallback's where it
    has none; ``<name>_by`` tells which."""
    if model is None:
        return df.withColumns({name: fallback(F.col(text)), f"{name}_by": F.lit("fallback")})
    importable(df.sparkSession)
    out = df.withColumn(f"{name}_of", predicted(model, F.col(text), T.MapType(T.StringType(), T.DoubleType())))
    given = F.col(f"{name}_of").isNotNull()
    return out.withColumns({name: F.when(given, F.col(f"{name}_of")).otherwise(fallback(F.col(text))), f"{name}_by": F.when(given, model.name).otherwise("fallback")}).drop(f"{name}_of")
