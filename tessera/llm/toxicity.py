"""Toxicity categories by a chain of linear classifiers.

The categories are predicted in a fixed order; each one's logistic model sees the words of the text and the earlier
categories' probabilities. For training, those probabilities are out of fold: each document's come from models that
have not seen it (folds go by a hash of the text, so that copies share one). For scoring they come from models of all
labelled documents.

Words are lower-case runs of letters. A word counts by its beginnings of BEGINNINGS letters, a shorter word as it is, so
that forms of one word that no label has shown are known by their stem; a beginning counts once a document. Each model
looks at the beginnings that a chi-squared test connects with its category in its own training rows (CONNECTED), however
many they are and whatever their language, and at the text's length, since a long text has more of anything. Models see at most MOST_LABELLED labelled documents, those first by a hash of
their id, and of rows with one id the first by a hash of the text. Scoring covers every document's whole text.

Defined results: a null text counts as empty; a text without known words gets the models' base rates. Labels that are
null are left out of that category's training. A category with only one label value is predicted at its rate. Repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

MOST_LABELLED = 20_000
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 3
#: The chi-squared statistic from which on a beginning is looked at: some one in 100,000 are there by chance.
CONNECTED = 19.5
#: Strength of the penalty on weights, all of it on their sum, so that few beginnings get one.
PENALTY = 0.0001
ITERATIONS = 60
#: A document is toxic from this probability on.
TOXIC = 0.5


def words(text: Column) -> Column:
    """The distinct beginnings of the distinct words of a text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.array(*(F.substr(w, F.lit(1), F.lit(k)) for k in BEGINNINGS)))))


@dataclass
class Link:
    """A category's model: the words that it looks at, and their weights with those of the earlier categories. Without a model, `rate`."""

    rate: float
    words: CountVectorizerModel | None = None
    weights: LogisticRegressionModel | None = None

    def predict(self, df: DataFrame, earlier: Sequence[str], name: str) -> DataFrame:
        if self.weights is None:
            return df.withColumn(name, F.lit(self.rate))
        found = self.weights.transform(_assembled(df, self.words, earlier))
        return found.withColumn(name, vector_to_array("_probability")[1]).drop("_features", "_probability", "_raw", "_prediction")


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: tuple[Link, ...]

    def score(self, df: DataFrame) -> DataFrame:
        """`df` (words, ...) with a column p_<category> for each category."""
        found = df
        for k, link in enumerate(self.models):
            found = link.predict(found, self.categories[:k], f"p_{self.categories[k]}")
        return found


def _assembled(df: DataFrame, vocabulary: CountVectorizerModel, earlier: Sequence[str]) -> DataFrame:
    found = vocabulary.transform(df.withColumn("_length", F.log1p(F.size("words"))))
    found = VectorAssembler(inputCols=["_own", "_length", *(f"p_{c}" for c in earlier)], outputCol="_features").transform(found)
    # The steps name every word in the column's metadata, which plans would carry along.
    return found.withMetadata("_features", {}).drop("_own", "_length")


def _fit(rows: DataFrame, connected: list[str], category: str, earlier: Sequence[str], penalty: float) -> Link:
    """The model of the rows (words, category, p_<earlier>), which are few: a job an iteration is quickest with one task."""
    known = rows.where(F.col(category).isNotNull())
    told = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(category), F.lit(0)).alias("ones")).first()
    rate = float(told["ones"]) / max(told["n"], 1)
    if told["ones"] in (0, told["n"]) or not (connected or earlier):
        return Link(rate)
    vocabulary = CountVectorizerModel.from_vocabulary(connected or [""], "words", "_own")
    fit = LogisticRegression(featuresCol="_features", labelCol=category, predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=ITERATIONS)
    return Link(rate, vocabulary, fit.fit(_assembled(known, vocabulary, earlier).select("_features", category).coalesce(1)))


def _connected(rows: DataFrame, counts: DataFrame, category: str, without: int | None, folds: int) -> list[str]:
    """The words that the test connects with the category, over the rows of all folds but one: few of the bounded rows' words."""
    of = [f for f in range(folds) if f != without]
    told = rows.where(F.col("_fold").isin(of)).agg(F.count(category).alias("n"), F.coalesce(F.sum(category), F.lit(0.0)).alias("ones")).first()
    has = sum((F.col(f"{category}_n{f}") for f in of), F.lit(0.0))
    both = sum((F.col(f"{category}_ones{f}") for f in of), F.lit(0.0))
    n, ones = F.lit(float(told["n"])), F.lit(float(told["ones"]))
    statistic = n * (both * n - has * ones) ** 2 / F.nullif(has * (n - has) * ones * (n - ones), F.lit(0.0))
    return sorted(r[0] for r in counts.where(statistic > CONNECTED).select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, folds: int = FOLDS, penalty: float = PENALTY) -> Chain:
    """The chain for the `docs` that have `labels`: ids with a column of 0, 1 or null for each category.

    The labels used are `most` at most, and so may be broadcast: the texts stay where they are until theirs are picked.
    A category's model of all rows and those that leave a fold out are trained side by side.
    """
    some = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *(F.col(c).cast("double").alias(c) for c in categories))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).join(F.broadcast(some), F.col("_own") == F.col("_id"))
    rows = rows.withColumn("_hash", F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))))
    once = F.row_number().over(Window.partitionBy("_id").orderBy("_hash"))
    rows = rows.withColumn("_once", once).where("_once = 1")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(rows.select(F.pmod("_hash", F.lit(folds)).cast("int").alias("_fold"), words(F.col("_text")).alias("words"), *categories))
    of = lambda c, f: F.when(F.col("_fold") == f, F.col(c))
    tallies = [x for c in categories for f in range(folds) for x in (F.count(of(c, f)).cast("double").alias(f"{c}_n{f}"), F.coalesce(F.sum(of(c, f)), F.lit(0.0)).alias(f"{c}_ones{f}"))]
    counts = scratch.write(rows.select(F.explode("words").alias("word"), "_fold", *categories).groupBy("word").agg(*tallies))
    known, models = rows, []
    for k, category in enumerate(categories):
        earlier, last = categories[:k], k == len(categories) - 1

        def one(without: int | None, known: DataFrame = known, category: str = category, earlier: Sequence[str] = earlier) -> Link:
            part = known if without is None else known.where(F.col("_fold") != without)
            return _fit(part, _connected(rows, counts, category, without, folds), category, earlier, penalty)

        left_out = [None, *([] if last else range(folds))]
        with ThreadPool(len(left_out)) as pool:
            whole, *others = pool.map(inheritable_thread_target(docs.sparkSession)(one), left_out)
        models.append(whole)
        if not last:
            known = reduce(DataFrame.unionByName, [link.predict(known.where(F.col("_fold") == f), earlier, f"p_{category}") for f, link in enumerate(others)])
    scratch.drop()
    return Chain(tuple(categories), tuple(models))


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", toxic: str = "toxic", least: float = TOXIC) -> DataFrame:
    """(id, p_<category> for each category, is_toxic) for every row of `docs`."""
    rows = docs.select(F.col(id_col), words(F.col(text_col)).alias("words"))
    return chain.score(rows).drop("words").withColumn("is_toxic", F.col(f"p_{toxic}") >= least)
