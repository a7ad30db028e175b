"""Texts to vectors by any encoder that turns a list of texts into a matrix: models are injected, batches go through Arrow."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class Encoder(Protocol):
    """What is asked of an encoder: one row of the matrix for each text. It is sent to the workers, so it must pickle."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Letters:
    """Counts of some letters: an encoder without a model."""

    def __init__(self, letters: str):
        self.letters = letters

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in self.letters] for t in texts], float).reshape(len(texts), len(self.letters))


def unit_vectors(text: Column, encoder: Encoder) -> Column:
    """The encoder's vector of each text, of length one; null texts count as empty, a vector of zeros stays."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(texts: pd.Series) -> pd.Series:
        found = np.asarray(encoder.encode(texts.fillna("").tolist()), float)
        size = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return pd.Series(list(found / np.where(size > 0, size, 1)))

    return encode(text)


def best_prompt(vector: Column, prompts: dict[str, list[np.ndarray]], least: float, margin: float) -> Column:
    """The label whose best prompt is nearest, with its cosine and weight, if that reaches ``least`` and leads by ``margin``; else null.

    The weight rises from 0.25 at ``least`` to 0.4 at 0.65.
    """

    def cosine(v: np.ndarray) -> Column:
        return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)

    scores = [F.struct(F.greatest(*s).alias("score") if len(s := [cosine(v) for v in some]) > 1 else s[0].alias("score"), F.lit(label).alias("label")) for label, some in prompts.items()]
    ranked = F.sort_array(F.array(*scores), False)
    first, second = ranked[0], ranked[1]
    weight = F.least(F.lit(0.4), 0.25 + 0.15 * (first["score"] - least) / (0.65 - least))
    fits = (first["score"] >= least) & (first["score"] - second["score"] >= margin)
    return F.when(fits, F.struct(first["label"].alias("label"), first["score"].alias("score"), weight.alias("weight")))
