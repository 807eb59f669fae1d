import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import labels as L
from codeloom.functions import text as X


def one(spark, value, *cols, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"s {kind}").select(*cols).first())


def test_char_ids_and_padding(spark):
    ids, seq = one(spark, "int a\t=é1;", X.char_ids(F.col("s")), X.char_sequence(F.col("s"), 12))
    assert ids == [19, 24, 30, 95, 11, 96, 81, 2, 79]
    assert seq == ids + [0, 0, 0]
    assert one(spark, "", X.char_ids(F.col("s")), X.char_sequence(F.col("s"), 3)) == ([], [0, 0, 0])
    pad = lambda v, side: one(spark, v, X.pad_ids(F.col("s"), 5, side), kind="array<int>")[0]
    assert pad([1, 2, 3], "right") == [1, 2, 3, 0, 0]
    assert pad([1, 2, 3], "left") == [0, 0, 1, 2, 3]
    assert pad([1, 2, 3, 4, 5, 6, 7], "right") == [3, 4, 5, 6, 7]


def test_cleaning_fixtures(spark):
    assert one(spark, "int a; /* x */ b(); // t\n\tc();", X.strip_comments(F.col("s"))) == ("int a;  b(); c();",)
    assert one(spark, "aaa b cc int Aa", X.rf_clean_text(F.col("s"))) == ("   int Aa",)
    assert one(spark, "a->b; x != 1", X.code_tokens_regex(F.col("s")))[0] == [
        "a", "->", "b", ";", " ", "x", " ", "!=", " "]


def test_c_tokens(spark):
    source = 's = "a\\"b c"; x->y /* q r */ <<= 0x1fUL \'\\\'\' 1.5e-3 "open'
    assert one(spark, source, X.code_tokens_c(F.col("s")))[0] == [
        "s", "=", '"a\\"bc"', ";", "x", "->", "y", "/*qr*/", "<<=", "0x1fUL", "'\\''", "1.5e-3", '"', "open"]
    # Long literals with many escapes must not exhaust the stack.
    long = '"' + "\\x41" * 20000 + '"'
    assert one(spark, long, X.code_tokens_c(F.col("s")))[0] == [long]


def test_long_comment_is_removed(spark):
    assert one(spark, "a/*" + "* x " * 20000 + "*/b", X.strip_comments(F.col("s"))) == ("ab",)


TEXTS = st.text(alphabet=string.ascii_letters + " \t\n\r\x0b\x0c\x1c\x1e\x1f\x85\xa0  ;é_", max_size=30)


@settings(max_examples=1, deadline=None)
@given(st.lists(TEXTS, min_size=60, max_size=80))
def test_space_and_lines_follow_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(
        "s", X.split_lines(F.col("s")), X.strip_all_whitespace(F.col("s")), X.trim_space(F.col("s"))).collect()
    for s, lines, bare, trimmed in got:
        assert lines == s.splitlines()
        assert bare == "".join(s.split())
        assert trimmed == s.strip()


def test_paths(spark):
    names = ["a.c", "b.H", "c.cpp", "d.py", "Makefile", "e.tar.c", "f.c++", "x/.c", "dir.c/name"]
    from codeloom.sources.trees import filter_sources
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kept = [r.path for r in filter_sources(df).collect()]
    assert kept == ["a.c", "b.H", "c.cpp", "e.tar.c", "f.c++"]


def test_labels(spark):
    assert one(spark, ["CWE-unknown", "CWE-20"], L.clean_cwe_list(F.col("s")), kind="array<string>") == (["CWE-20"],)
    assert one(spark, "['CWE-120']", L.plain_cwe(F.col("s"))) == ("CWE-120",)
    def relabel(values):
        df = spark.createDataFrame([(v,) for v in values], "label string")
        return [r.label for r in L.binary_label(df).collect()]
    assert relabel(["Benign", "CWE-1"]) == ["Benign", "Vulnerable"]
    assert relabel(["0", "1"]) == ["Benign", "Vulnerable"]
    assert relabel(["a", "b"]) == ["a", "b"]
