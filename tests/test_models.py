import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from codeloom.operators import embeddings as E
from codeloom.operators import evaluation as V
from codeloom.operators import forests
from codeloom.operators.tfidf import tfidf
from codeloom.plans import training as T
from codeloom.sources import tables


def sequential_bpe(words, merges):
    """One merge at a time, all pairs counted anew; ties to the lower pair."""
    table = {tuple(w): n for w, n in Counter(words).items()}
    out = []
    for _ in range(merges):
        pairs = Counter()
        for w, n in table.items():
            for p in zip(w, w[1:]):
                pairs[p] += n
        pairs = {p: n for p, n in pairs.items() if n >= 2}
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        new = Counter()
        for w, n in table.items():
            parts, i = [], 0
            while i < len(w):
                if w[i:i + 2] == best:
                    parts.append(w[i] + w[i + 1])
                    i += 2
                else:
                    parts.append(w[i])
                    i += 1
            new[tuple(parts)] += n
        table = new
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bpe_batches_equal_single_merges(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef" if i % 2 else "ab") for _ in range(rng.randint(1, 7))) for i in range(150)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    vocab, merges = E.bpe_train(df, num_merges=20)
    assert merges == sequential_bpe(words, 20)
    assert vocab[:5] == ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]
    ids = {t: i for i, t in enumerate(vocab)}
    out = E.bpe_encode(spark.createDataFrame([(["abab", "zz"],)], "t array<string>"), "t", vocab, merges, pad_to=12).first()
    back = [vocab[i] for i in out.ids]
    assert back[0] == "<s>" and "</s>" in back and len(back) == 12 and back[-1] == "<pad>"
    body = back[1:back.index("</s>")]
    assert body[-2:] == ["<unk>", "<unk>"] and "".join(body[:-2]) == "abab" and all(t in ids for t in body)
    short = E.bpe_encode(spark.createDataFrame([(["abcdef"] * 9,)], "t array<string>"), "t", vocab, merges, max_length=6)
    assert len(short.first().ids) == 6 and short.first().ids[-1] == 2


@pytest.mark.parametrize("held", [E.HELD_SYMBOLS, 300, 0])
def test_bpe_learns_all_merges_in_order(spark, monkeypatch, held):
    """To the last pair that occurs twice, with overlaps, in one place, by rounds, and by some rounds first."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aab" if i % 3 else "abcd") for _ in range(rng.randint(1, 9))) for i in range(120)] + ["aaaaa", "é🙂é🙂"]
    monkeypatch.setattr(E, "HELD_SYMBOLS", held)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    vocab, merges = E.bpe_train(df, num_merges=40 if held == 0 else None)
    want = sequential_bpe(words, 40 if held == 0 else 10_000)
    assert merges == want and len(set(vocab)) == len(vocab)
    letters = sorted(set("".join(words)))
    assert vocab == [*E.RESERVED, *letters, *(m for m in dict.fromkeys(l + r for l, r in want) if m not in letters)]
    assert E.bpe_train(df, vocab_size=20)[0] == vocab[:20]


def test_vectorize_functions_learns_the_whole_vocabulary(spark, tmp_path):
    """The query takes the operator's own vocabulary and width: all merges of its words, 100 numbers a vector."""
    import __spark_entry__ as entry
    from codeloom.functions.text import code_tokens_c, strip_comments
    from codeloom.plans.inputs import c_sources

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60)]
    spark.createDataFrame([(i, " ".join(rng.choices(words, k=30)) + ".", "x", "en", 240) for i in range(40)],
                          "doc_id long, text string, source string, lang string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    tokens = c_sources(spark, str(tmp_path)).select(F.explode(code_tokens_c(strip_comments(F.col("text")))).alias("word"))
    vocab, merges = E.bpe_train(tokens)
    assert len(merges) > 100
    got = entry.queries()["vectorize_functions"](spark, str(tmp_path)).filter("part = 'embeddings'").collect()
    assert [(r.width, r.n) for r in got] == [(100, len(vocab))]


def test_lookup_fills_zeros(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, token string")
    known = spark.createDataFrame([("a", [1.0, 2.0])], "token string, vector array<double>")
    got = {r.token: r.vector for r in E.lookup_embeddings(index, known, 2, 2).collect()}
    assert got == {"a": [1.0, 2.0], "b": [0.0, 0.0]}


def test_word_vectors_of_like_words_are_near_and_reload(spark, tmp_path):
    """Words that stand among the same words are nearer to each other than to the rest."""
    rng = random.Random(3)
    frames = {"copy": ["buf", "len", "src"], "move": ["buf", "len", "src"], "open": ["path", "mode", "file"], "load": ["path", "mode", "file"]}
    rows = []
    for _ in range(600):
        word = rng.choice(list(frames))
        around = [rng.choice(frames[word]) for _ in range(6)]
        rows.append((around[:3] + [word] + around[3:],))
    df = spark.createDataFrame(rows, "tokens array<string>")
    model = E.train_word2vec(df, "tokens", size=16, partitions=1, iterations=15)
    E.save_word2vec(model, str(tmp_path / "w"))
    again = E.load_word2vec(str(tmp_path / "w"))
    for word, like in (("copy", "move"), ("open", "load")):
        near = {r.word: r.similarity for r in again.findSynonyms(word, 10).collect()}
        assert near[like] > max(near[w] for w in frames if w not in (word, like))
    assert [r.vector for r in model.getVectors().orderBy("word").collect()] == [r.vector for r in again.getVectors().orderBy("word").collect()]


def test_subwords_reload(spark, tmp_path):
    vocab, merges = E.bpe_train(spark.createDataFrame([("abab",), ("abc",), ("cab",)], "word string"), num_merges=3)
    E.save_subwords(spark, vocab, merges, str(tmp_path / "s"))
    assert E.load_subwords(spark, str(tmp_path / "s")) == (vocab, merges)


def test_decode_labels(spark):
    classes = E.index_labels(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string"))
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 9), (4, None)], "id int, at int")
    got = {r.id: r.decoded for r in E.decode_labels(df, F.col("at"), classes).collect()}
    assert got == {1: "a", 2: "c", 3: None, 4: None}


def test_learning_curve_reads_one_feature_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, ("strcpy(buf, s);" if i % 2 else "return 0;") + f" x{i % 5}", "V" if i % 2 else "B") for i in range(80)],
                               "id int, code string, label string")
    cut, fits = [], T._token_stage
    monkeypatch.setattr(T, "_token_stage", lambda code: cut.append(code) or fits(code))
    rows = T.learning_curve(df, "id", fractions=(0.4, 1.0), folds=3, trees=4, terms=30, depth=4).collect()
    assert len(cut) == 1 and len(rows) == 6 and sum(r.n_test for r in rows if r.fraction == 1.0) == 80
    assert all(r.n_train + r.n_test == 80 for r in rows if r.fraction == 1.0)
    assert all(r.test_score == 1.0 and r.train_score == 1.0 for r in rows if r.fraction == 1.0)


def test_label_index_by_ranges(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    assert {tuple(r) for r in E.index_labels(df).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_model_tfidf_equals_relation(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["int a1; aa = b2", "int a1, c3", "x9 int int"])], "id int, code string")
    stage = T._token_stage("code")
    tokens = stage.transform(df)
    from pyspark.ml import PipelineModel
    stages = T.fit_tfidf(tokens, 50)
    rows = PipelineModel(stages).transform(tokens).select("id", "features").collect()
    vocab = stages[0].vocabulary
    model = {(r.id, vocab[i]): round(v, 9) for r in rows for i, v in zip(r.features.indices, r.features.values)}
    plain = {(r.id, r.term): round(r.weight, 9) for r in tfidf(tokens, "id", "tokens", 50).collect()}
    assert model == plain


def test_forest_learns_and_reloads(spark, tmp_path):
    df = spark.createDataFrame([(i, "strcpy(buf, s);" if i % 2 else "return 0;", "Vulnerable" if i % 2 else "Benign")
                                for i in range(40)], "id int, code string, label string")
    model = T.train_random_forest(df, trees=5, terms=50, depth=3)
    assert T.accuracy(model, df).first().accuracy == 1.0
    tables.save_model(model, str(tmp_path / "m"))
    assert T.accuracy(tables.load_model(str(tmp_path / "m")), df).first().n == 40


def test_process_data_balances(spark):
    df = spark.createDataFrame([(i, "abc" * (i % 7), "CWE-1" if i < 6 else "Benign") for i in range(30)],
                               "id int, code string, label string")
    out = T.process_data(df, "id", kind="binary", balance=True)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"Benign": 6, "Vulnerable": 6}
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 4, "train": 8}
    with pytest.raises(ValueError):
        T.process_data(df, "id", kind="other")


def test_auc_counts_ties_half(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.6)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(V.evaluate(df, "y", "s").first().auc - want) < 1e-12


def test_evaluation_of_one_class(spark):
    from codeloom.operators.evaluation import evaluate

    df = spark.createDataFrame([(1, 0.7), (1, 0.2)], "y int, s double")
    row = evaluate(df, "y", "s").first()
    assert row.n == 2 and row.accuracy == 0.5 and row.auc is None
    assert evaluate(df.filter("false"), "y", "s").first().n == 0


def test_word_vectors_stay_a_table(spark, monkeypatch):
    """Every frequent word gets a vector, by name and not by hash, and none passes through the driver's model."""
    from pyspark.sql import DataFrame

    from codeloom.operators import wordvectors

    monkeypatch.setattr(wordvectors, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(wordvectors, "SHARD_BYTES", 2_000)
    df = spark.createDataFrame([([f"w{i}", f"w{i}", None, f"r{i}"],) for i in range(300)] + [(None,), ([],)], "tokens array<string>")
    model = E.train_word2vec(df, "tokens", size=8, min_count=2, partitions=3)
    assert isinstance(model.table, DataFrame)
    got = {r.word: list(r.vector) for r in model.getVectors().collect()}
    assert set(got) == {f"w{i}" for i in range(300)} and all(len(v) == 8 and any(v) for v in got.values())
    assert E.train_word2vec(df.filter("false"), "tokens", size=8).getVectors().count() == 0


def test_dense_net_learns_in_blocks_and_is_sparks_model(spark):
    """The gradient is that of the loss; Spark's model with these weights tells classes apart that no line divides."""
    import numpy as np

    from codeloom.operators import densenets as D
    random, sizes = np.random.default_rng(1), [3, 4, 5, 2]
    w, x, y = D.first_weights(sizes, 3), random.normal(size=(9, 3)), np.arange(9) % 2
    _, slope = D.loss_and_gradient(w, sizes, x, y)
    near = [(D.loss_and_gradient(w + e, sizes, x, y)[0] - D.loss_and_gradient(w - e, sizes, x, y)[0]) / 2e-5 for e in np.eye(len(w)) * 1e-5]
    assert np.allclose(slope, near, atol=1e-6)

    df = spark.createDataFrame([([i % 2, i // 2 % 2, 1], (i + i // 2) % 2) for i in range(400)], "X array<int>, label_index int")
    read = D.blocks(df, "X", "label_index").collect()
    assert sum(r.n for r in read) == 400 and {r.kind for r in read} == {"|u1"}
    model = T.train_dense_net(df, "X", "label_index", 2, [6, 4])
    out = T.predict_ids(model, df, "X")
    assert out.filter("prediction = label_index").count() == 400
    loss, _ = D.loss_and_gradient(
        model.stages[0].weights.toArray(), [3, 6, 4, 2], np.array([[0.0, 1, 1]]), np.array([1]))
    (p,) = {r.probability[1] for r in out.filter("X[0] = 0 AND X[1] = 1").collect()}
    assert abs(np.exp(-loss) - p) < 1e-9


def test_forest_scores_are_those_of_sparks_forest(spark):
    """Held-out scores within two hundredths of Spark's forest on noisy sparse rows; thresholds, not only zeros, count."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        at = sorted(rng.sample(range(40), 8))
        values = [round(rng.uniform(0.05, 1), 3) for _ in at]
        x = dict(zip(at, values))
        y = float((x.get(3, 0) > 0.5) ^ (7 in x)) if rng.random() < 0.9 else 2.0
        rows.append((Vectors.sparse(40, at, values), y, i % 3, (i * 7919 % 1500 + 0.5) / 1500))
    df = spark.createDataFrame(rows, ["features", "y", "_fold", "_share"]).withColumn("_draw", F.xxhash64("_share"))
    fits = [forests.Fit(f, s) for f in range(3) for s in (0.5, 1.0)]
    got = forests.forest_scores(df, "features", "y", 3, 40, fits, trees=30, depth=8, seed=1, at_a_time=4)
    assert got == forests.forest_scores(df.repartition(5), "features", "y", 3, 40, fits, trees=30, depth=8, seed=1, at_a_time=4)
    spark_scores = []
    for fit, (n, m, a, b) in zip(fits, got):
        train = df.filter((F.col("_fold") != fit.fold) & (F.col("_share") <= fit.share))
        test = df.filter(F.col("_fold") == fit.fold)
        assert (n, m) == (train.count(), test.count())
        model = RandomForestClassifier(labelCol="y", numTrees=30, maxDepth=8, seed=1).fit(train)
        spark_scores.append([model.transform(d).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] for d in (train, test)])
    mean = lambda xs: sum(xs) / len(xs)
    assert abs(mean([g[3] for g in got]) - mean([s[1] for s in spark_scores])) < 0.02
    assert abs(mean([g[2] for g in got]) - mean([s[0] for s in spark_scores])) < 0.02
    assert mean([g[3] for g in got]) > 0.7


@pytest.mark.parametrize("open_nodes", [forests.OPEN, 7])
def test_forest_over_packed_rows_is_sparks_model(spark, monkeypatch, open_nodes):
    """Trees that grow in common passes, over all open nodes or a few at a time, are a model that Spark writes and reads."""
    monkeypatch.setattr(forests, "OPEN", open_nodes)
    monkeypatch.setattr(forests, "GROUPS", 2)
    monkeypatch.setattr(forests, "MODEL_NODES", 50)
    rng = random.Random(6)
    rows = []
    for i in range(400):
        x = {j: round(rng.uniform(0.05, 1), 3) for j in rng.sample(range(12), 4)}
        rows.append((Vectors.sparse(12, sorted(x), [x[j] for j in sorted(x)]), 2.0 if rng.random() < 0.1 else float(x.get(3, 0) > 0.5), i))
    df = spark.createDataFrame(rows, ["features", "y", "i"]).withColumn("_draw", F.xxhash64("i"))
    trees = 8 if open_nodes == 7 else 40
    model = forests.train_forest(df, "features", "y", 4, 12, trees, 6, 1)
    assert (model.getNumTrees, model.numClasses, model.numFeatures, model.getMaxDepth()) == (trees, 4, 12, 6)
    assert all(t.depth <= 6 for t in model.trees) and model.totalNumNodes > 5 * trees
    want = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=6, seed=1).fit(df)
    right = lambda m: m.transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert abs(right(model) - right(want)) < (0.05 if trees == 8 else 0.03)
    assert int(model.featureImportances.toArray().argmax()) == 3
    out = model.transform(df).select(F.col("probability").alias("p")).collect()
    assert all(abs(r.p.toArray().sum() - 1) < 1e-9 and r.p[3] == 0 for r in out)


def test_best_split_is_that_of_all_cuts(spark):
    """Of random counts: the first cut with the largest gain, over all bins of all features."""
    k, classes, nodes = 3, 2, 6
    each = (k * forests.BINS + 1) * classes
    random_ = np.random.default_rng(2)
    full = np.zeros((nodes, each), np.int64)
    for node in range(nodes - 1):  # the last one has no rows of another bin than the zero's
        some = random_.choice(k * forests.BINS * classes, 25, replace=False)
        some = some[some // classes % forests.BINS > 0]
        full[node, some] = random_.integers(1, 5, len(some))
    full[:, k * forests.BINS * classes:] = 200 + random_.integers(0, 9, (nodes, classes))
    cells = np.flatnonzero(full)
    halves = [cells[::2], cells[1::2], cells[::3]]
    weights = [full.reshape(-1)[h] for h in halves]
    weights[2] = weights[2] * 0 + 1
    full.reshape(-1)[halves[2]] += 1
    df = spark.createDataFrame([(0, bytearray(h.astype("<i8").tobytes()), bytearray(w.astype("<i8").tobytes())) for h, w in zip(halves, weights)],
                               "part long, cells binary, n binary")
    got = {r.node: r for r in forests._best(df, k, classes).collect()}
    for node in range(nodes):
        total = full[node, k * forests.BINS * classes:].astype(float)
        left = full[node, :k * forests.BINS * classes].reshape(k, forests.BINS, classes).astype(float)
        left[:, 0] = total - left[:, 1:].sum(1)
        left = left.cumsum(1)[:, :-1]
        right = total - left
        with np.errstate(all="ignore"):
            gain = (left ** 2).sum(2) / left.sum(2) + (right ** 2).sum(2) / right.sum(2) - (total ** 2).sum() / total.sum()
        gain[(left.sum(2) == 0) | (right.sum(2) == 0)] = -1
        at = int(gain.argmax())
        assert got[node].total == total.tolist()
        if gain.max() > 1e-9:
            assert (got[node].slot, got[node].bin) == divmod(at, forests.BINS - 1) and got[node].lefts == left.reshape(-1, classes)[at].tolist()
        else:
            assert got[node].slot == -1


def test_learning_curve_holds_no_row_of_all_terms(spark, monkeypatch):
    """Fits read bins of what is not zero, a few bytes each, and none of them makes Spark's dense rows."""
    made, keep = [], forests.staged
    monkeypatch.setattr(forests, "staged", lambda df, name: made.append(keep(df, name)) or made[-1])
    df = spark.createDataFrame([(i, f"strcpy(a{i % 7}, b); word{i} = {i};", "V" if i % 2 else "B") for i in range(300)],
                               "id int, code string, label string")
    rows = T.learning_curve(df, "id", fractions=(1.0,), folds=2, trees=2, terms=300, depth=3).collect()
    assert sum(r.n_test for r in rows) == 300 and len(made) == 1
    packed = made[0].agg(*(F.sum(F.length(c)) for c in ("row", "at", "bin")), F.sum("n")).first()
    assert packed[3] == 300 and sum(packed[:3]) < 300 * 20 * 7


def test_quantile_cuts():
    values = np.array([0.2, 0.4, 0.4, 0.6])
    feature, cut = forests.quantile_cuts(np.array([1, 1, 1, 3]), values, 3)
    assert feature.tolist() == [1, 3] and np.allclose(cut, [0.3, 0.3])  # 1 has no zeros among three rows
    many = np.arange(1, 1001) / 1000
    feature, cut = forests.quantile_cuts(np.zeros(1000, int), many, 1000)
    assert len(cut) == 31 and np.abs(np.searchsorted(many, cut) - np.arange(1, 32) * 1000 / 32).max() <= 1
    feature, cut = forests.quantile_cuts(np.zeros(100, int), many[:100], 1000)  # nine tenths are zeros
    assert cut[0] == 0.0005 and len(cut) == 4


def test_null_ids_and_labels_in_a_learning_curve(spark):
    df = spark.createDataFrame([(i if i % 10 else None, "a(b);" if i % 2 else "return", None if i % 7 == 0 else "V" if i % 2 else "B")
                                for i in range(100)], "id int, code string, label string")
    rows = T.learning_curve(df, "id", fractions=(0.0, 1.0), folds=2, trees=3, terms=20, depth=0).collect()
    assert sum(r.n_test for r in rows if r.fraction == 1.0) == 100
    assert [(r.n_train, r.train_score) for r in rows if r.fraction == 0.0] == [(0, None)] * 2


def test_letters_alone_or_repeated_are_no_tokens(spark):
    """One pattern removes what two did, one after the other."""
    code = "a aa aA ab _a a1 x-yy-z éa aé 𝕒a bbb.c(dd) zZz q"
    df = spark.createDataFrame([(code,), ("",), ("kk",)], "code string")
    edge = T.WORD_CHAR
    clean = F.regexp_replace(F.regexp_replace("code", rf"(?<!{edge})([A-Za-z])\1+(?!{edge})", ""), f"(?<!{edge})[A-Za-z](?!{edge})", "")
    twice = df.select(F.regexp_extract_all(F.lower(clean), F.lit(T.TFIDF_TOKEN), 1).alias("tokens"))
    assert T._token_stage("code").transform(df).select("tokens").collect() == twice.collect()
