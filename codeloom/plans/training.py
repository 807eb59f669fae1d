"""Feature preparation, training and evaluation on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StringIndexer)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.labels import binary_label
from codeloom.functions.text import (
    TFIDF_TOKEN, WORD_CHAR, char_sequence, code_tokens_c, pad_ids, strip_comments)
from codeloom.operators.densenets import train_weights
from codeloom.operators.embeddings import (
    bpe_encode, bpe_train, index_labels, lookup_embeddings, train_word2vec)
from codeloom.operators.forests import Fit, forest_scores, train_forest
from codeloom.operators.nearmiss import nearmiss_undersample
from codeloom.operators.sampling import train_test_split
from codeloom.operators.scale import seeded_hash
from codeloom.session import staged


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _token_stage(code: str) -> SQLTransformer:
    start, end = f"(?<!{WORD_CHAR})", f"(?!{WORD_CHAR})"
    # The letter first: elsewhere the other tests are not made.
    one_letter = _sql_text(rf"(?=[A-Za-z]){start}([A-Za-z])\1*+{end}")
    clean = f"regexp_replace(`{code}`, {one_letter}, '')"
    return SQLTransformer(statement=(
        f"SELECT *, regexp_extract_all(lower({clean}), {_sql_text(TFIDF_TOKEN)}, 1) AS tokens "
        "FROM __THIS__"))


def _counter(tokenized: DataFrame, terms: int) -> CountVectorizerModel:
    # Ties at the end of the vocabulary go by term, so that training can be repeated exactly.
    top = (
        tokenized.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "term").limit(terms).collect())
    return CountVectorizerModel.from_vocabulary(
        [r["term"] for r in top], inputCol="tokens", outputCol="tf")


def _weights(counted: DataFrame) -> list[Transformer]:
    # Spark's IDF is the smoothed logarithm; the weighting adds one to it.
    idf = IDF(inputCol="tf", outputCol="idf").fit(counted).idf.toArray() + 1.0
    return [
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="weighted"),
        Normalizer(p=2.0, inputCol="weighted", outputCol="features")]


def fit_tfidf(tokenized: DataFrame, terms: int = 3000) -> list[Transformer]:
    """Counts of the top terms, smoothed IDF plus one, unit length; from a ``tokens`` column."""
    counter = _counter(tokenized, terms)
    return [counter, *_weights(counter.transform(tokenized))]


def _label_stage(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")


def train_random_forest(train: DataFrame, code: str = "code", label: str = "label", trees: int = 300,
                        terms: int = 3000, depth: int = 30, seed: int = 30) -> PipelineModel:
    """TF-IDF features into a random forest (gini, sqrt features per split), grown over packed rows.

    Texts become tokens and counts once. All trees grow in common passes (``operators/forests.py``); the model is Spark's.
    """
    cut = _token_stage(code)
    marked = train.select(code, label, F.xxhash64(F.monotonically_increasing_id(), code).alias("_draw"))
    tokens = staged(cut.transform(marked).drop(code), "tokens")
    counter, labels = _counter(tokens, terms), _label_stage(label).fit(tokens)
    counted = staged(counter.transform(tokens).drop("tokens"), "counts")
    weights = _weights(counted)
    ready = PipelineModel([*weights, labels]).transform(counted).select("features", "label_index", "_draw")
    forest = train_forest(ready, "features", "label_index", len(labels.labels) + 1, len(counter.vocabulary), trees, depth, seed)
    return PipelineModel([cut, counter, *weights, labels, forest])


def accuracy(model: PipelineModel, df: DataFrame, label: str = "label_index") -> DataFrame:
    return model.transform(df).agg(
        F.count("*").alias("n"),
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def train_dense_net(train: DataFrame, features: str, label_index: str, classes: int,
                    hidden: Sequence[int], iterations: int = 120, block: int = 128,
                    seed: int = 30, width: int | None = None) -> PipelineModel:
    """Feed-forward net on an id-array column: sigmoid hidden layers, softmax output.

    The weights are learnt by matrix products over ``operators/densenets.py``'s blocks; the model is Spark's.
    ``block`` is the number of rows that the model stacks.
    """
    width = width or train.select(F.size(features)).first()[0]
    layers = [width, *hidden, classes]
    weights = train_weights(train, features, label_index, layers, iterations, seed)
    one = train.sparkSession.createDataFrame([(Vectors.dense([0.0] * width), 0.0)], ["features", "label_index"])
    net = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label_index", layers=layers, maxIter=0, blockSize=block, seed=seed,
        initialWeights=Vectors.dense(weights)).fit(one)
    return PipelineModel([net])


def train_dnn(train: DataFrame, features: str, label_index: str, classes: int, max_len: int = 150,
              **options) -> PipelineModel:
    return train_dense_net(
        train, features, label_index, classes, [max_len, max_len // 4], width=max_len, **options)


# Hidden layer sizes of the large net.
MULTI_DNN_LAYERS = [2000, 1500, 800, 400, 150]


def train_multi_dnn(train: DataFrame, features: str, label_index: str, classes: int,
                    layers: Sequence[int] = tuple(MULTI_DNN_LAYERS), **options) -> PipelineModel:
    return train_dense_net(train, features, label_index, classes, layers, **options)


def predict_ids(model: PipelineModel, df: DataFrame, features: str) -> DataFrame:
    return model.transform(df.withColumn(
        "features", array_to_vector(F.col(features).cast("array<double>"))))


def process_data(df: DataFrame, row_id: str, kind: str = "multiclass", statements: bool = True,
                 max_len: int = 150, balance: bool = False, test_ratio: float = 0.30,
                 seed: int = 30) -> DataFrame:
    """(code, label) rows to model input: labels, ids ``X`` (statements), label index, balance, split."""
    if kind == "binary":
        df = binary_label(df)
    elif kind != "multiclass":
        raise ValueError(f"kind must be binary or multiclass, not {kind}")
    if statements:
        df = df.withColumn("X", char_sequence(F.col("code"), max_len))
    df = index_labels(df)
    if balance:
        if not statements:
            raise ValueError("balancing needs the id arrays of statements")
        df = nearmiss_undersample(df, "label", row_id, "X").drop("distance")
    return train_test_split(df, row_id, test_ratio, seed)


def learning_curve(df: DataFrame, row_id: str, code: str = "code", label: str = "label",
                   fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 20,
                   seed: int = 30, trees: int = 300, terms: int = 3000, depth: int = 30, parallel: int = 4) -> DataFrame:
    """(fraction, fold, n_train, n_test, train_score, test_score) of a random forest by training size.

    Folds and training subsets are cut by hash, so each subset contains the smaller ones. Texts become
    tokens, counts and features once; ``parallel`` forests at a time grow in common passes over packed rows
    (``operators/forests.py``), and all their scores come from one pass.
    """
    spark = df.sparkSession
    slot = F.conv(F.substring(seeded_hash(seed, row_id), 1, 8), 16, 10).cast("bigint")
    share = F.conv(F.substring(seeded_hash(seed + 1, row_id), 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = df.select(code, label, F.pmod(slot, F.lit(folds)).cast("int").alias("_fold"), share.alias("_share"),
                       F.xxhash64(row_id, code).alias("_draw"))
    tokens = staged(_token_stage(code).transform(marked).drop(code), "tokens")
    counter, labels = _counter(tokens, terms), _label_stage(label).fit(tokens)
    counted = staged(counter.transform(tokens).drop("tokens"), "counts")
    ready = PipelineModel([*_weights(counted), labels]).transform(counted)
    steps = [Fit(fold, float(fraction)) for fold in range(folds) for fraction in fractions]
    found = forest_scores(
        ready.select("features", "label_index", "_fold", "_share", "_draw"), "features", "label_index", len(labels.labels) + 1,
        len(counter.vocabulary), steps, trees, depth, seed, parallel)
    return spark.createDataFrame(
        [(step.share, step.fold, *scores) for step, scores in zip(steps, found)],
        "fraction double, fold int, n_train long, n_test long, train_score double, test_score double")


class Vectorized(NamedTuple):
    rows: DataFrame        # the input with its id arrays ``X``
    index: DataFrame       # (idx, token)
    embeddings: DataFrame  # (idx, token, vector)


def vectorize_functions(df: DataFrame, code: str = "code", vocab_size: int = 50_000,
                        num_merges: int | None = None, max_length: int = 1024, size: int = 100,
                        min_count: int = 5, partitions: int | None = None) -> Vectorized:
    """Function text to id arrays, and one vector per id.

    Comments are removed, C tokens learn and receive a subword vocabulary, ids are padded with zeros
    on the left to the longest row, word vectors are trained on the ids, and every vocabulary entry
    gets its vector, or zeros if it was too rare to have one.
    """
    spark = df.sparkSession
    # Written once each: tokens are read by the training of subwords and the encoding, ids four times.
    tokens = staged(df.withColumn("_tokens", code_tokens_c(strip_comments(F.col(code)))), "tokens")
    vocab, merges = bpe_train(
        tokens.select(F.explode_outer("_tokens").alias("word")), vocab_size=vocab_size, num_merges=num_merges)
    encoded = staged(bpe_encode(tokens, "_tokens", vocab, merges, "_ids", max_length).drop("_tokens"), "encoded")
    longest = encoded.agg(F.max(F.size("_ids"))).first()[0] or 0
    rows = encoded.withColumn("X", pad_ids(F.col("_ids"), longest, side="left")).drop("_ids")
    sentences = encoded.select(F.transform("_ids", lambda i: i.cast("string")).alias("ids"))
    vectors = train_word2vec(
        sentences, "ids", size=size, min_count=min_count, partitions=partitions).getVectors()
    index = spark.createDataFrame(list(enumerate(vocab)), "idx int, token string")
    from pyspark.ml.functions import vector_to_array
    known = vectors.select(F.col("word").cast("int").alias("idx"), vector_to_array("vector").alias("vector"))
    named = index.join(known, "idx").select("token", "vector")
    return Vectorized(rows, index, lookup_embeddings(index, named, len(vocab), size))
