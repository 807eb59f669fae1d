import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import containment as C
from codeloom.operators.cvematch import projects_in_cve, required_literal
from compare import rows


def fixture(seed=3):
    """Texts over few letters, and passages of every length class that do or do not occur."""
    rng = random.Random(seed)
    texts = [("f%d" % (i % 3), i, "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 3, 9, 60, 300]))))
             for i in range(60)]
    passages = set()
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33, 50]:
        for _ in range(8):
            file, _, text = rng.choice(texts)
            at = rng.randrange(max(1, len(text) - n + 1))
            passages.add((file, text[at:at + n]))
            passages.add((file, "".join(rng.choice("abé") for _ in range(n))))
    return texts, sorted(passages)


@pytest.mark.parametrize("max_passages", [C.MAX_PASSAGES, 0])
@pytest.mark.parametrize("keyed", [True, False])
def test_contained_equals_brute_force(spark, max_passages, keyed):
    texts, passages = fixture()
    t = spark.createDataFrame(texts, "file string, id int, body string")
    p = spark.createDataFrame(passages, "file string, part string")
    keys = ["file"] if keyed else []
    got = C.contained(t, p, "id", "body", "part", keys=keys, max_passages=max_passages)
    want = {(i, part) for f, i, body in texts for g, part in passages if part in body and (f == g or not keyed)}
    assert sorted((r["id"], r["part"]) for r in got.collect()) == sorted(want)


def test_hot_passages_share_their_anchor(spark):
    """Very many passages with one long common part, all in one text, are found without pairing."""
    head = "for(inti=0;i<count;i++)table[i]="
    passages = [(head + str(i) + ";",) for i in range(500)]
    text = "x".join(p for (p,) in passages[::2])
    t = spark.createDataFrame([(1, text), (2, head)], "id int, body string")
    p = spark.createDataFrame(passages, "part string")
    for bound in (C.MAX_PASSAGES, 0):
        got = C.contained(t, p, "id", "body", "part", max_passages=bound)
        assert sorted(r["part"] for r in got.collect()) == sorted(p for (p,) in passages[::2])


def test_projects_in_cve(spark):
    records = spark.createDataFrame([("1", "Flaw in Contiki 2.4"), ("2", "GCC C++ front end"), ("3", None)],
                                    "cve_id string, description string")
    projects = spark.createDataFrame([("data/contiki",), ("x/c++",), ("linux-rpi",)], "project string")
    assert rows(projects_in_cve(records, projects)) == [
        ("data/contiki", True), ("linux-rpi", False), ("x/c++", True)]
    patterns = spark.createDataFrame([("x/cont.ki",), ("y/riot$",)], "project string")
    assert rows(projects_in_cve(records, patterns, regex=True)) == [("x/cont.ki", True), ("y/riot$", False)]


LITERALS = {"cont.ki": ("cont", False), "linux": ("linux", True), "a+bc*d": ("a", False), "(abc)+x": ("abc", False), "ab|cd": ("", False),
            r"\d+-rpi$": ("-rpi", False), "x(?:yz)w": ("xyzw", True), "[ab]c?": ("", False), "lib(?=c)": ("lib", False),
            "(?i)Lib": ("", False), r"\p{L}x": ("", False), r"\va": ("", False), "^root": ("root", False), "": ("", True), "q{2,3}r": ("q", False)}


@pytest.mark.parametrize("pattern", LITERALS)
def test_required_literal(pattern):
    assert required_literal(pattern) == LITERALS[pattern]


def test_patterns_meet_texts_by_their_literal(spark):
    rnd = random.Random(8)
    texts = [("%d" % i, "".join(rnd.choice("abcx- 1") for _ in range(rnd.randrange(80)))) for i in range(60)] + [("n", None), ("e", "")]
    patterns = ["ab+c", "a.c", "x-1", "(ab|ba)c", "^ab", "1$", "cc?b", "[abc]{9}", "x{3}", r"\bab\b", "nowhere", "a(?!b)", "zz*", "1 ?x", "b(?:c)a"]
    patterns += [f"{x}{y}+{z}" for x in "abcx" for y in "1-" for z in "abc"]
    records = spark.createDataFrame(texts, "cve_id string, description string")
    projects = spark.createDataFrame([(f"git/{p}",) for p in patterns if "/" not in p], "project string")
    want = [(f"git/{p}", any(t is not None and re.search(p, t) is not None for _, t in texts)) for p in patterns]
    assert rows(projects_in_cve(records, projects, regex=True)) == sorted(want, key=repr)


def test_null_texts_contain_nothing(spark):
    texts = spark.createDataFrame([(1, None), (2, "abc")], "id int, text string")
    passages = spark.createDataFrame([("b",), (None,)], "p string")
    for bound in (C.MAX_PASSAGES, 0):
        found = C.contained(texts, passages, "id", "text", "p", max_passages=bound)
        assert [(r.id, r.p) for r in found.collect()] == [(2, "b")]


def test_names_in_any_text_are_found_without_rows_of_texts(spark, monkeypatch):
    """Random names of several lengths against brute force, over texts cut into small chunks, with more lengths than allowed too."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    names = sorted({"".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(0, 7))) for _ in range(400)}) + [None]
    t = spark.createDataFrame([(1, x) for x in texts], "id int, body string")
    p = spark.createDataFrame([(n,) for n in names * 2], "name string")
    want = {n for n in names if n is not None and any(n in x for x in texts if x is not None)}
    monkeypatch.setattr(C, "_CHUNK_CHARS", 100)
    got = [r.name for r in C.occurring(t, p, "id", "body", "name").collect()]
    assert set(got) == want and len(got) == len(want) < len(names) - 1 and "" in want
    assert C.occurring(t.filter("body IS NULL"), p, "id", "body", "name").count() == 0
    monkeypatch.setattr(C, "MAX_LENGTHS", 3)
    unique = t.withColumn("id", F.monotonically_increasing_id())
    assert {r.name for r in C.occurring(unique, p, "id", "body", "name").collect()} == want


def test_names_are_found_across_spans_and_told_once(spark, monkeypatch):
    """Pieces over the ends of tested spans are found, a small memory of what was told loses none, and a large one repeats none."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé𝄞") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    names = sorted({"".join(rng.choice("abcé𝄞") for _ in range(n)) for n in (1, 2, 3, 4, 30) for _ in range(60)} | {texts[3][5:35], texts[4]})
    want = {n for n in names if any(n in x for x in texts)}
    t = spark.createDataFrame([(1, x) for x in texts], "id int, body string").coalesce(1)
    p = spark.createDataFrame([(n,) for n in names], "name string")
    told = []
    monkeypatch.setattr(type(t), "mapInArrow", lambda self, *a, made=type(t).mapInArrow: told.append(made(self, *a)) or told[-1])
    assert {r.name for r in C.occurring(t, p, "id", "body", "name").collect()} == want
    rows = [r.name for r in told[-1].collect()]
    assert len(rows) == len(set(rows)) and len(rows) < 2 * len(want)
    monkeypatch.setattr(C, "_SPAN", 7)
    monkeypatch.setattr(C, "_TOLD", 2)
    assert {r.name for r in C.occurring(t, p, "id", "body", "name").collect()} == want
