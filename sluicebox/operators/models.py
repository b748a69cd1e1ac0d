"""Word vectors, feature tables and classifiers, by Spark's own library; other models come as predictions.

Equal in kind, not in bits, to other libraries: random numbers and solvers differ.
"""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.operators.metrics import pooled_vectors, threshold

WIDTH, CONTEXT_WINDOW, LEAST, EPOCHS = 300, 10, 10, 5


def word_vectors(chunks: DataFrame, tokens: str = "tokens", width: int = WIDTH, least: int = LEAST, epochs: int = EPOCHS, seed: int = 0, parts: int = 1) -> DataFrame:
    """``token, vector`` of a skip-gram model over the chunks; ``parts`` partitions are trained side by side and averaged."""
    model = Word2Vec(vectorSize=width, windowSize=CONTEXT_WINDOW, minCount=least, maxIter=epochs, seed=seed, numPartitions=parts, maxSentenceLength=1000, inputCol=tokens, outputCol="_v").fit(chunks)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vector"))


def embedding_rows(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, vector``: the embedding matrix as rows; id 0 stands for padding and unknown tokens and is all zeros, a token has index + 1."""
    known = vocabulary.join(vectors, "token").select((F.col("index") + 1).cast("int").alias("id"), "vector")
    zero = vectors.limit(1).select(F.lit(0).alias("id"), F.transform("vector", lambda x: x * 0).alias("vector"))
    return known.unionByName(zero)


def pooled_features(windows: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """windows with ``features``: the mean vector of their known tokens."""
    each = windows.select(key, F.explode("tokens").alias("token"))
    pooled = pooled_vectors(each, key, vectors, width)
    zeros = F.array(*[F.lit(0.0)] * width)
    return windows.join(pooled, key, "left").withColumn("features", array_to_vector(F.coalesce("vector", zeros))).drop("vector")


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with ``weight``: rows / (classes * rows of the class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    counts = {r[label]: r["_n"] for r in n.collect()}  # a class each
    total = sum(counts.values())
    weight = F.when(F.lit(False), F.lit(0.0))
    for y, c in counts.items():
        weight = weight.when(F.col(label) == y, F.lit(total / (len(counts) * c)))
    return rows.withColumn("weight", weight)


def forest(train: DataFrame, test: DataFrame, trees: int = 300, seed: int = 0) -> DataFrame:
    """test with ``guess``, by a random forest over class-balanced rows."""
    model = RandomForestClassifier(numTrees=trees, weightCol="weight", seed=seed, featuresCol="features", labelCol="label", maxDepth=10).fit(balanced_weights(train))
    return model.transform(test).withColumn("guess", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")


def perceptron(train: DataFrame, test: DataFrame, width: int, hidden: tuple[int, ...] = (256, 128), rounds: int = 500, seed: int = 0) -> DataFrame:
    """test with ``guess``, by a perceptron with hidden layers."""
    model = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=rounds, seed=seed, featuresCol="features", labelCol="label").fit(train)
    return model.transform(test).withColumn("guess", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")


def external(test: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """test with ``guess`` of another model's ``key, p``; a row without a prediction is an error when it is read."""
    p = F.when(F.col("p").isNotNull(), F.col("p")).otherwise(F.raise_error(F.lit("a row has no prediction")).cast("double"))
    return test.join(predictions.select(key, "p"), key, "left").withColumn("guess", threshold(p)).drop("p")
