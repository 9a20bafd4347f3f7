"""Vectors of texts: by a model that the caller brings, or by hashed terms without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T


def embed(docs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", out: str = "embedding") -> DataFrame:
    """docs with unit vectors. load is called once a task and gives what turns a batch of texts into rows of numbers; a
    null text counts as empty, and a row of zeros stays."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            rows = np.asarray(encode(texts.fillna("").tolist()), dtype=np.float32)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(norm > 0, norm, 1)))

    return docs.withColumn(out, run(F.col(text)))


def hashed_model(docs: DataFrame, text: str = "text", size: int = 1024) -> PipelineModel:
    """A model without training data of its own: terms are hashed into size places and weighed by how few documents have
    them. One pass over docs counts the documents of each place."""
    stages = [HashingTF(numFeatures=size, inputCol="_terms", outputCol="_tf"), IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit")]
    return Pipeline(stages=stages).fit(docs.select(T.terms(F.col(text)).alias("_terms")))


def hashed_vectors(docs: DataFrame, model: PipelineModel, text: str = "text", out: str = "embedding") -> DataFrame:
    """docs with the unit vectors of a hashed model; a text without terms has a vector of zeros."""
    made = model.transform(docs.withColumn("_terms", T.terms(F.col(text))))
    return made.withColumn(out, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_tfidf", "_unit")
