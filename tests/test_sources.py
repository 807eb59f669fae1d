import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.operators import findings as N
from codeloom.schemas import FINDING_COLUMNS
from codeloom.sources import archives, cve, reports, tables, trees
from compare import rows

CPPCHECK = """<results version="2"><errors>
 <error id="nullPointer" severity="error" msg="Null pointer" verbose="Null pointer" cwe="476" file0="p/a.c">
  <location file="p/a.c" line="3" column="5" info="deref"/><location file="p/a.c" line="9" column="1"/></error>
 <error id="unusedVariable" severity="style" msg="Unused" verbose="Unused" file0="p/a.c"><location file="p/a.c" line="2" column="7"/></error>
 <error id="onlyStyle" severity="style" msg="s" verbose="s" file0="p/b.c"><location file="p/b.c" line="1" column="1"/></error>
 <error id="missingInclude" severity="information" msg="no location"/>
</errors></results>"""
RATS = """<rats_output><vulnerability><severity>High</severity><type>strcpy</type><message>Check bounds</message>
 <file><name>p/a.c</name><line>4</line><line>8</line></file></vulnerability></rats_output>"""
FLAWFINDER = '''File,Line,Column,DefaultLevel,Level,Category,Name,Warning,Suggestion,Note,CWEs,Context,Fingerprint,ToolVersion,RuleId,HelpUri
p/a.c,5,1,4,4,buffer,strcpy,"Does not check, ever","Use ""safe""",,CWE-120,"  strcpy(a, ""b"");",f,2,R1,http://h
'''


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_reports_to_findings(spark, tmp_path):
    ff = reports.read_flawfinder(spark, put(tmp_path, "ff.csv", FLAWFINDER))
    cc = N.prefix_cwe(reports.read_cppcheck(spark, put(tmp_path, "cc.xml", CPPCHECK)))
    sources = spark.createDataFrame([("p/a.c", "\n".join("line %d;" % i for i in range(1, 9)))], "path string, text string")
    cc = N.attach_context(cc, sources)
    rats = reports.read_rats(spark, put(tmp_path, "rats.xml", RATS))
    out = N.normalize_findings(ff, cc, rats)
    assert out.columns == FINDING_COLUMNS
    short = rows(out.select("tool", "file", "line", "cwe", "context", "note", "category", "name"))
    assert short == [
        ("CppCheck", "p/a.c", "3", "CWE-476", "line 3;", "deref", "-", "nullPointer"),
        ("CppCheck", "p/a.c", "9", "CWE-476", "", "-", "-", "nullPointer"),
        ("CppCheck", "p/b.c", "1", "CWE-unknown", "", "-", "-", "onlyStyle"),
        ("FlawFinder", "p/a.c", "5", "CWE-120", 'strcpy(a, "b");', 'Use "safe"', "buffer", "strcpy"),
        ("Rats", "p/a.c", "4", "CWE-unknown", "-", "-", "strcpy", "-"),
        ("Rats", "p/a.c", "8", "CWE-unknown", "-", "-", "strcpy", "-"),
    ]
    assert N.filter_statement_context(out).count() == 2
    loose = N.prefix_cwe(reports.read_cppcheck(spark, str(tmp_path / "cc.xml")), unknown_for_null=True)
    assert loose.filter("id = 'unusedVariable'").first().cwe == "CWE-unknown"


def test_attach_context_edges(spark):
    sources = spark.createDataFrame([("a", "first\nmid\nlast\n")], "path string, text string")
    asked = spark.createDataFrame([("a", n) for n in (0, 1, 3, 4)], "file string, line int")
    got = {r.line: r.context for r in N.attach_context(asked, sources).collect()}
    assert got == {0: "", 1: "first", 3: "last", 4: ""}


def test_infer(spark, tmp_path):
    put(tmp_path, "report.json", json.dumps([{"file": "a.c", "line": 3}, {"file": "b.c", "line": 4}]))
    assert rows(reports.read_infer(spark, str(tmp_path / "report.json"))) == [
        ("a.c", 3, "infer"), ("b.c", 4, "infer")]


def test_source_tree_and_archives(spark, tmp_path):
    tree = tmp_path / "tree" / "sub"
    tree.mkdir(parents=True)
    (tree / "a.c").write_bytes("é;".encode("utf-8"))
    (tree / "b.H").write_bytes("é;".encode("latin-1"))
    (tree / "c.py").write_text("x")
    (tree / "Makefile").write_text("x")
    got = trees.read_source_tree(spark, str(tmp_path / "tree"), "prj").select("lang", "text", "project")
    assert rows(got) == [("c", "é;", "prj"), ("h", "é;", "prj")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.cpp", "int a;")
        z.writestr("d/readme.txt", "no")
    assert rows(trees.read_zip_sources(spark, str(tmp_path / "z.zip")).select("path", "lang", "text")) == [
        ("d/a.cpp", "cpp", "int a;")]


def test_archives_are_read_in_ranges(spark, tmp_path):
    """One archive with every packing method goes to several tasks; what nobody wants is not unpacked."""
    body = {f"src/f{i}.c": f"int f{i};" * (i + 1) for i in range(40)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.mkdir("src")
        for i, (name, text) in enumerate(body.items()):
            z.writestr(name, text, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[i % 4])
        z.writestr("src/empty.h", "")
        z.writestr("big.bin", bytes(1000))
    path = str(tmp_path / "z.zip")
    ranges = archives.entry_ranges(archives.archive_paths(spark, path), range_bytes=300)
    assert ranges.count() > 5 and ranges.select("no").distinct().count() == ranges.count()
    got = trees.read_zip_sources(spark, path, range_bytes=300)
    assert {r.path: r.text for r in got.collect()} == body | {"src/empty.h": ""}
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    every = trees.unzip_entries(archives.archive_paths(spark, path))
    assert {r.path for r in every.collect()} == {*body, "src/empty.h", "big.bin"}
    # An unwanted entry that cannot be unpacked does no harm.
    raw = (tmp_path / "z.zip").read_bytes()
    at = raw.index(b"big.bin") + len("big.bin")
    (tmp_path / "z.zip").write_bytes(raw[:at] + b"x" + raw[at + 1:])
    assert got.count() == 41


def test_large_archive_by_seek(spark, tmp_path):
    """An archive of over 2 GB, most of it a hole: entries before and after it are read by seek."""
    path = tmp_path / "large.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("first.c", "int a;")
        hole = zipfile.ZipInfo("hole.bin")
        hole.file_size = hole.compress_size = 5 << 29
        hole.CRC = 0
        at = z.fp.tell()
        hole.header_offset = at
        z.fp.write(hole.FileHeader(zip64=True))
        z.fp.seek(5 << 29, 1)
        z.start_dir = z.fp.tell()
        z.filelist.append(hole)
        z.NameToInfo[hole.filename] = hole
        z.writestr("last.c", "int z;")
    assert path.stat().st_size > 2**31
    got = trees.read_zip_sources(spark, str(path))
    assert {r.path: r.text for r in got.collect()} == {"first.c": "int a;", "last.c": "int z;"}


def test_broken_entries_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.c", "int a;")
    raw = (tmp_path / "z.zip").read_bytes()
    (tmp_path / "z.zip").write_bytes(raw.replace(b"int a;", b"int b;"))
    with pytest.raises(Exception, match="checksum of a.c"):
        trees.read_zip_sources(spark, str(tmp_path / "z.zip")).collect()


def item(name, refs):
    return {
        "cve": {"CVE_data_meta": {"ID": name, "ASSIGNER": "x"},
                "references": {} if refs is None else {"reference_data": refs},
                "description": {"description_data": [{"lang": "en", "value": "text"}]}},
        "configurations": {"nodes": [{"operator": "OR", "children": []}]},
        "impact": {"baseMetricV2": {"cvssV2": {"vectorString": "AV:N", "baseScore": 7.5}, "exploitabilityScore": 1.0},
                   "baseMetricV3": {"exploitabilityScore": 2.5, "impactScore": 3.5}},
        "publishedDate": "2020-01-01T00:00Z"}


def test_cve(spark, tmp_path):
    feed = {"CVE_data_type": "CVE", "CVE_Items": [
        item("CVE-1", [{"url": "u"}]), item("CVE-2", []), item("CVE-3", None)]}
    put(tmp_path, "nvdcve-1.1-2020.json", json.dumps(feed))
    feeds = cve.read_cve_feeds(spark, cve.feed_paths(str(tmp_path), [2020]))
    flat = cve.cast_all_string(cve.flatten_cve(feeds))
    assert len(flat.columns) == 34 and flat.columns[:4] == [
        "cve_id", "published_date", "last_modified_date", "description"]
    assert {t for _, t in flat.dtypes} == {"string"}
    by_id = {r.cve_id: r for r in flat.collect()}
    assert set(by_id) == {"CVE-1", "CVE-3"}
    assert (by_id["CVE-1"].exploitability_score, by_id["CVE-1"].cvss2_base_score) == ("2.5", "7.5")
    assert json.loads(by_id["CVE-1"].nodes) == [{"operator": "OR", "children": []}]
    assert cve.flatten_cve(feeds, keep_unreferenced=False).count() == 1


def test_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("a;", "Benign"), ("a;", "CWE-1"), ("b", "CWE-1")], "context string, cwe string")
    tables.append_table(df, root, "p1")
    tables.append_table(df, root, "p2")
    assert tables.read_table(spark, root).groupBy("project").count().count() == 2
    snap = str(tmp_path / "s")
    tables.replace_table(df, snap)
    tables.replace_table(tables.read_table(spark, snap).filter("cwe <> 'Benign'"), snap)
    assert tables.read_table(spark, snap).count() == 2
    csv = str(tmp_path / "c")
    odd = spark.createDataFrame([('x "q",\n y', "l"), ('x "q",\n y', "l"), (None, "l")], "code string, label string")
    tables.write_dataset_csv(odd, csv)
    assert rows(tables.read_labelled_csv(spark, csv)) == [('x "q",\n y', "l")]


def test_appends_after_a_replacement_are_read(spark):
    from codeloom.session import scratch_path
    from codeloom.sources import tables

    root = scratch_path(spark, "log")
    row = lambda p: spark.createDataFrame([(p, 1)], "project string, n int")
    have = lambda: sorted(r.project for r in tables.read_table(spark, root).collect())
    tables.append_table(row("007"), root)
    assert have() == ["007"]
    tables.replace_table(tables.read_table(spark, root), root)
    tables.append_table(row("q"), root)
    tables.append_table(row("r"), root, batch="x")
    tables.append_table(row("s"), root, batch="x")
    assert have() == ["007", "q", "s"]
    tables.replace_table(tables.read_table(spark, root).filter("project <> 'q'"), root)
    assert have() == ["007", "s"]


def test_rules_may_share_group_names_and_be_many(spark):
    from codeloom.operators.findings import scan_rules

    rule = lambda name, pattern: dict(name=name, pattern=pattern, cwe="CWE-1", level="1", category="c", msg="m")
    lines = spark.createDataFrame([("f", 1, "call foo(x);"), ("f", 2, "bar bar"), ("f", 3, None)], "file string, line int, context string")
    rules = [rule("a", r"(?<x>foo)\("), rule("b", r"(?<x>bar) \k<x>"), rule("c", "call")]
    rules += [rule(f"r{i}", f"never{i}") for i in range(1500)]
    assert sorted((r.line, r.name) for r in scan_rules(lines, rules).collect()) == [("1", "a"), ("1", "c"), ("2", "b")]


def test_small_ranges_share_tasks(spark, tmp_path):
    """Many ranges of little work are dealt to some tasks for each core; every entry is read."""
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(300):
            z.writestr(f"d{i}.c", f"int f{i}(void);\n" * 20)
    ranges = archives.entry_ranges(archives.archive_paths(spark, str(tmp_path / "z.zip")), range_bytes=100)
    assert ranges.count() == 300
    got = archives.read_ranges(ranges)
    assert got.rdd.getNumPartitions() == min(300, archives.TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    assert rows(got.select("path", got.content.cast("string"))) == sorted(
        ((f"d{i}.c", f"int f{i}(void);\n" * 20) for i in range(300)), key=repr)
