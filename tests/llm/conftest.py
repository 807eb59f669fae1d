import pytest

CLASH = ["fp", "id", "first", "root", "key", "hits", "copy", "pos", "quality_", "shingles", "n", "lang_pred", "spans",
         "component_id", "score", "kept", "base", "ids", "decoded", "n_tokens", "n_words", "mask", "a", "b", "__item"]

LONG = "ab " * 30_000 + "z" * 20_000

# (doc_id, text): nulls, empty texts, white space, a very long text, repeats of rows and of texts.
EDGES = [(None, None), (None, "some words of a text"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG),
         (6, "x"), (6, "x"), (7, "y z"), (8, "The end. " * 30), (9, "The end. " * 30), (10, "é ü ß 漢字   a b")]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with extra columns of names that operators use inside."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    for i, name in enumerate(CLASH):
        df = df.selectExpr("*", f"{i} AS `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.filter("false")
