"""Classifiers of labelled spans: words and word pairs weighted by rarity, or features by name, under a logistic model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(df: DataFrame, key: str, label: str, share: int = 4) -> tuple[DataFrame, DataFrame]:
    """(training, test): of each label about one row in `share`, by hash, is for testing."""
    place = F.pmod(F.xxhash64(F.col(label).cast("string"), F.col(key)), F.lit(share))
    return df.where(place != 0), df.where(place == 0)


def text_classifier(df: DataFrame, text: str, label: str, penalty: float = 0.01) -> PipelineModel:
    """A model that adds `predicted` to rows with `text`."""
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(df)
    stages = [
        index,
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_w", minDF=2),
        CountVectorizer(inputCol="_pairs", outputCol="_p", minDF=2),
        VectorAssembler(inputCols=["_w", "_p"], outputCol="_counts"),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_predicted", regParam=penalty, maxIter=50),
        IndexToString(inputCol="_predicted", outputCol="predicted", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(df)


def feature_ranker(df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.01) -> PipelineModel:
    """A model of a 0/1 label that adds `probability` (a vector) to rows with the numeric features."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"), LogisticRegression(featuresCol="_features", labelCol=label, regParam=penalty, maxIter=50)]
    return Pipeline(stages=stages).fit(df)
