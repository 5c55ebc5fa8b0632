"""Names, scanning, resolution and documents."""

import json
import posixpath
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from unitgraph.functions import names
from unitgraph.operators import includes, resolve, scan
from unitgraph.plans import fixtures, oracles, queries
from unitgraph.sources import corpus, graph_json
from unitgraph.sources import rules as rule_files

GLOBS = [
    ("Vcl.Forms", "Vcl.Forms", True), ("Vcl.Forms", "Vcl.Grids", False), ("vcl.FORMS", "Vcl.Forms", True), ("Forms", "Vcl.Forms", False), ("*", "x", True), ("Vcl.*", "Vcl.Forms", True),
    ("Vcl.*", "Vcl.", True), ("*.Forms", "Vcl.Forms", True), ("V*s", "Vcl.Forms", True), ("*c*o*", "Vcl.Forms", True), ("Vcl.F?rms", "Vcl.Forms", True), ("Vcl.?", "Vcl.", False),
    ("", "x", False), ("*", "", True), ("a%b", "axb", False), ("a_b", "axb", False), ("a!b", "a!b", True),
]


def test_globs(spark):
    df = spark.createDataFrame(GLOBS, "p string, v string, e boolean")
    assert df.where(names.glob_match(F.col("p"), F.col("v")) != F.col("e")).collect() == []


def scan_text(text, defines=("MSWINDOWS",), includes=None, folders=()):
    s = scan.Scanner({d.upper() for d in defines}, {"COMPILERVERSION": 37.0}, scan._finder({p.lower(): (p, t) for p, t in (includes or {}).items()}, folders))
    s.scan("A.pas", text)
    return s


@pytest.mark.parametrize("text,expected", [
    ("True", True), ("Defined(MSWINDOWS)", True), ("Defined(X)", False), ("Declared(X)", None), ("CompilerVersion >= 37", True), ("CompilerVersion < 37.0", False), ("not Defined(X)", True),
    ("Defined(X) or Declared(Y)", None), ("Defined(X) and Declared(Y)", False), ("(Defined(X) or True) and True", True), ("", None), ("1 +", None), ("Unknown > 3", None), ("Defined(X", None),
])
def test_expressions(text, expected):
    assert scan.evaluate(text, {"MSWINDOWS"}, {"COMPILERVERSION": 37.0}) is expected


def test_scan_sections_and_conditions():
    s = scan_text("unit A; { uses No; }\ninterface\nuses B, // x\n  C in 'c''d.pas',\n{$IFDEF MSWINDOWS} D, {$ELSE} E, {$ENDIF}\n F;\nimplementation\nuses &G.H;\nend.")
    got = [(e["unit_name"], e["section"], e["certainty"], e["cond"], e["line"]) for e in s.entries]
    assert got == [("B", "interface", "unconditional", "", 3), ("C", "interface", "unconditional", "", 4), ("D", "interface", "conditional", "MSWINDOWS", 5), ("F", "interface", "unconditional", "", 6), ("G.H", "implementation", "unconditional", "", 8)]
    assert s.entries[1]["in_path"] == "c'd.pas"
    assert s.warnings == []


def test_scan_unknown_takes_every_branch():
    s = scan_text("unit A;\ninterface\nuses\n{$IF Declared(X)} B, {$ELSE} C, {$IFEND} D;\n{$IFOPT D+} {$ENDIF} {$IF Foo} {$IFEND}")
    assert [(e["unit_name"], e["certainty"], e["cond"]) for e in s.entries] == [("B", "unevaluated", "Declared(X)"), ("C", "unevaluated", "not (Declared(X))"), ("D", "unconditional", "")]
    assert s.warnings == [("A.pas", 4, "cannot evaluate {$IF Declared(X)}, taking every branch")]


def test_scan_includes_and_defines():
    s = scan_text("unit A;\ninterface\n{$DEFINE X}\nuses B,\n{$I more}\nZ;\n{$I gone.inc}", includes={"more.inc": "{$IFDEF X}\nC,\n{$ENDIF}"})
    assert [(e["unit_name"], e["file"], e["line"]) for e in s.entries] == [("B", "A.pas", 4), ("C", "more.inc", 2), ("Z", "A.pas", 6)]
    assert [w[1:] for w in s.warnings] == [(7, 'include file not found: "gone.inc"')]


def test_scan_include_folders_in_order():
    """Beside the file that names it, then the search folders in order, and nowhere else."""
    files = {"lib2/a.inc": "Two,", "lib1/a.inc": "One,", "lib1/b.inc": "{$I c}", "lib1/c.inc": "Beside,", "lib2/c.inc": "Far,", "other/d.inc": "No,", "lib1/loop.inc": "{$I loop}"}
    s = scan_text("unit A; interface uses {$I a.inc} {$I 'b.inc'} {$I d.inc} {$I loop.inc} {$I %DATE%} Z;", includes=files, folders=["lib1", "LIB2/"])
    assert [(e["unit_name"], e["file"]) for e in s.entries] == [("One", "lib1/a.inc"), ("Beside", "lib1/c.inc"), ("Z", "A.pas")]
    assert s.warnings == [("A.pas", 1, 'include file not found: "d.inc"'), ("lib1/loop.inc", 1, 'include cycle detected at "loop"')]
    assert s.included == ["lib1/a.inc", "lib1/b.inc", "lib1/c.inc", "lib1/loop.inc"]


def test_scan_warnings_name_the_directive():
    """The file and line of the directive, also for entries of an include, and after a decidable branch."""
    s = scan_text("unit A;\ninterface\nuses\n{$IF Foo}\n{$I x.inc}\n{$ELSEIF Defined(MSWINDOWS)} B, {$ENDIF} C;\n{$ELSE}", includes={"x.inc": "\n\nX,"})
    assert [(e["unit_name"], e["file"], e["line"]) for e in s.entries] == [("X", "x.inc", 3), ("B", "A.pas", 6), ("C", "A.pas", 6)]
    assert s.warnings == [("A.pas", 4, "cannot evaluate {$IF Foo}, taking every branch"), ("A.pas", 7, "{$ELSE} without a matching {$IF}")]
    t = scan_text("unit A; interface uses {$IF Foo} {$ELSEIF Defined(MSWINDOWS)} B, {$ENDIF} C; {$IFDEF X}")
    assert [w[2] for w in t.warnings] == ["cannot evaluate {$IF Foo}, taking every branch", "1 conditional directive(s) were never closed"]


def test_includes_belong_to_their_graph(spark):
    files = spark.createDataFrame([(g, "A.pas", "unit A; interface uses {$I x} Z;") for g in ("g", "h")], "graph_id string, path string, content string")
    inc = spark.createDataFrame([("g", "lib/x.inc", "G,"), ("h", "lib/x.inc", "H,")], files.schema)
    targets = spark.createDataFrame([("g", [], {}, ["lib"]), ("h", [], {}, ["none"])], "graph_id string, defines array<string>, numerics map<string,double>, folders array<string>")
    out = scan.scan_corpus(files, targets, inc)
    assert sorted((r["graph_id"], r["unit_name"]) for r in scan.uses_entries(out).collect()) == [("g", "G"), ("g", "Z"), ("h", "Z")]
    assert [(r["graph_id"], r["message"]) for r in scan.scan_warnings(out).collect()] == [("h", 'include file not found: "x"')]


def test_scanned_files_are_handed_on_in_small_lots():
    """A batch of 40 files with 300 entries each leaves a worker in lots of few entries, and whole."""
    files = pd.DataFrame([("g", f"F{n}.pas", f"unit F{n}; interface uses {','.join(f'U{k}' for k in range(300))};", [], {}, [], None) for n in range(40)], columns=["graph_id", "path", "content", "defines", "numerics", "folders", "own"])
    lots = list(scan.scan_batches(iter([files]), {}, 1000))
    assert max(sum(map(len, lot["entries"])) for lot in lots) <= 1300
    assert [(p, len(e)) for lot in lots for p, e in zip(lot["path"], lot["entries"])] == [(f"F{n}.pas", 300) for n in range(40)]
    assert list(scan.scan_batches(iter([files[:0]]), {})) == []


def test_warnings_are_handed_on_in_small_lots():
    """Files with no entry but many warnings do not gather in a worker either."""
    files = pd.DataFrame([("g", f"F{n}.pas", "unit F; " + "{$ENDIF}" * 300, [], {}, [], None) for n in range(40)], columns=["graph_id", "path", "content", "defines", "numerics", "folders", "own"])
    lots = list(scan.scan_batches(iter([files[:20], files[20:]]), {}, 1000))
    assert max(sum(map(len, lot["warnings"])) for lot in lots) <= 1300
    assert [(p, len(w)) for lot in lots for p, w in zip(lot["path"], lot["warnings"])] == [(f"F{n}.pas", 300) for n in range(40)]


PATHS = ["a/b.inc", "./a//b", "../x", "a/../../x", "/..", "//a/./b", "///a", "", ".", "a/..", "../../a/../b/", "/a/../../c"]


def test_paths_are_normal_as_in_python(spark):
    df = spark.createDataFrame([(p, posixpath.normpath(p)) for p in PATHS], "p string, e string")
    assert df.select("p", "e", includes.normal_path(F.col("p")).alias("n")).where("n <> e").collect() == []


def test_include_names(spark):
    """All that a scan may read as an include directive, also where one stands in what looks like another."""
    text = "{$I a} {$i 'B c.inc'}{$INCLUDE\t\\x\\y}(*$I d.inc *) {$I+}{$IFDEF Q}{$I %DATE%} // {$I open\n{$I last} (*$I a*) {$I '} {$I end"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(includes.include_names(F.col("t")).alias("n")).collect()
    assert set(got[0]["n"]) == {"a", "b c.inc", "/x/y", "d.inc", "open\n{$i last", "last", "'", "end"}
    assert (got[1]["n"], got[2]["n"]) == ([], None)


def test_joined_includes_give_what_held_ones_give(spark):
    """Random trees of files, names, quotes, folders, cycles and missing files, in two graphs with two targets each."""
    rnd = random.Random(7)
    folder = lambda: rnd.choice(["", "lib/", "Lib/Sub/", "inc/", "../up/"])
    stem = lambda: rnd.choice("abcdefg")

    def body():
        out = []
        for _ in range(rnd.randint(0, 4)):
            name = f"{rnd.choice(['', '', './', '../', 'sub/', 'lib\\\\', '/lib/'])}{stem()}{rnd.choice(['', '.inc', '.INC', '.pas'])}"
            out.append(rnd.choice([f"{{$I {name}}}", f"{{$INCLUDE '{name}'}}", f"(*$i {name}*)", f"// {{$I {name}\n", "{$IFDEF X}", "{$ELSE}", "{$ENDIF}", "{$DEFINE X}", "{$I+}"]))
            out.append(f" U{rnd.randint(0, 99)},\n")
        return "".join(out)

    schema = "graph_id string, path string, content string"
    inc = spark.createDataFrame([(g, f"{folder()}{stem()}{rnd.choice(['.inc', '', '.pas', '.Inc'])}", rnd.choice([body(), body(), None])) for g in "gh" for _ in range(30)], schema)
    files = spark.createDataFrame([(g, f"{folder()}F{n}.pas", f"unit F{n}; interface uses {body()}{body()} Z;") for g in "gh" for n in range(40)] + [("g", "none.pas", None)], schema)
    targets = spark.createDataFrame([(g, d, {}, f) for g in "gh" for d, f in (([], ["lib", "INC/"]), (["X"], ["inc", "..\\up", "lib/sub"]))], "graph_id string, defines array<string>, numerics map<string,double>, folders array<string>")
    held, joined = [sorted(map(str, scan.scan_corpus(files, targets, inc, most).collect())) for most in (scan.MOST_INCLUDED, 0)]
    assert len(held) == 2 * 81 and held == joined
    assert sum("included=['" in r for r in held) > 40
    assert scan.scan_corpus(files.limit(0), targets, inc, 0).collect() == []
    assert scan.scan_corpus(files, targets, inc.limit(0), 0).count() == 2 * 81


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("{$IFDEF\tFOO} C, {$ENDIF} D", [("C", "conditional", "FOO"), ("D", "unconditional", "")]),
        ("{$IFDEF\nFOO} C, {$ENDIF} D", [("C", "conditional", "FOO"), ("D", "unconditional", "")]),
        ("{$IFNDEF FOO} C, {$ENDIF} D", [("D", "unconditional", "")]),
        ("{$IF(DEFINED(FOO))} C, {$IFEND} D", [("C", "conditional", "(DEFINED(FOO))"), ("D", "unconditional", "")]),
        ("{$IFDEF BAR} C, {$ELSE//x} E, {$ENDIF} D", [("E", "conditional", "not (BAR)"), ("D", "unconditional", "")]),
        ("{$IFDEF FOO bar} C, {$ENDIF} D", [("D", "unconditional", "")]),
        ("{$DEFINE\tX}{$IFDEF X} C, {$ENDIF} D", [("C", "conditional", "X"), ("D", "unconditional", "")]),
        ("{$DEFINE X y}{$IFDEF X} C, {$ENDIF} D", [("D", "unconditional", "")]),
        ("{$UNDEF\tFOO}{$IFDEF FOO} C, {$ENDIF} D", [("D", "unconditional", "")]),
        ("{$I'x.inc'} D", [("C", "unconditional", ""), ("D", "unconditional", "")]),
        ("{$ IFDEF BAR} D", [("D", "unconditional", "")]),
        ("(*$IFDEF\tFOO*) C, (*$ENDIF *) D", [("C", "conditional", "FOO"), ("D", "unconditional", "")]),
    ],
)
def test_directive_names_are_letters(source, expected):
    """Whatever parts a directive from its parameter: tabs, line ends, brackets, quotes, comments."""
    s = scan_text(f"unit A; interface uses {source};", defines={"FOO"}, includes={"x.inc": "C,"})
    assert [(e["unit_name"], e["certainty"], e["cond"]) for e in s.entries] == expected
    assert s.warnings == []


def test_program_header():
    s = scan_text("program MyApp;\nuses A in 'A.pas', B;\nbegin end.")
    assert (s.name, s.is_program, [e["section"] for e in s.entries]) == ("MyApp", True, ["program", "program"])
    assert scan_text("{$IFDEF Q}\nunit A;").warnings[-1][1] == 0


def test_resolution_order(spark):
    uses = spark.createDataFrame([("g", "Classes", "app"), ("g", "Own", "app"), ("g", "Late", "app"), ("g", "None", "app")], "graph_id string, unit_name string, folder string")
    ns = spark.createDataFrame([("g", 0, "System")], "graph_id string, ns_pos int, prefix string")
    sp = spark.createDataFrame([("g", 0, "lib1", "project"), ("g", 1, "lib2", "rtl")], "graph_id string, path_pos int, folder string, origin string")
    ex = spark.createDataFrame([], "graph_id string, unit_name string, file string")
    ls = spark.createDataFrame([("lib2", "system.classes.PAS"), ("app", "own.pas"), ("lib1", "own.pas"), ("lib1", "late.dcu"), ("lib2", "late.pas")], "folder string, file_name string")
    out = {r["unit_name"]: (r["resolved_name"], r["file"], r["origin"], r["is_source"]) for r in resolve.resolve_units(uses, ns, sp, ex, ls).collect()}
    assert out["Classes"] == ("System.Classes", "lib2/system.classes.PAS", "rtl", True)
    assert out["Own"][1] == "app/own.pas"
    assert out["Late"] == ("Late", "lib2/late.pas", "rtl", True)
    assert out["None"][0] is None


def test_rules(spark, tmp_path):
    f = tmp_path / "rules.txt"
    f.write_text("Vcl.*  # no\n\n// x\n!Vcl.Forms\n")
    assert [(r["allow"], r["pattern"], r["line"]) for r in rule_files.read_rules(spark, str(f)).orderBy("rule_pos").collect()] == [(False, "Vcl.*", 1), (True, "Vcl.Forms", 4)]
    for bad in ("!\n", "A B\n"):
        f2 = tmp_path / f"bad{len(bad)}.txt"
        f2.write_text(bad)
        with pytest.raises(rule_files.RuleError):
            rule_files.read_rules(spark, str(f2))
    both = rule_files.combine_rules(rule_files.rules_from_lists(spark, "A*; B,"), rule_files.rules_from_lists(spark, "", "C"))
    assert [(r["rule_pos"], r["pattern"], r["allow"]) for r in both.orderBy("rule_pos").collect()] == [(1, "A*", False), (2, "B", False), (3, "C", True)]


def test_graph_documents(spark, tmp_path):
    doc = {"schemaVersion": 2, "project": {"rootUnit": "MyApp"}, "nodes": [{"name": "MyApp", "source": "Program", "parsed": True}, {"name": "X", "source": "odd"}], "edges": [{"from": "MyApp", "to": "X", "line": 7}, {"from": "myapp", "to": "x", "line": 9}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    g = graph_json.read_graph_json(spark, str(tmp_path / "a.json"))
    assert sorted((r["name"], r["kind"], r["parsed"]) for r in g["nodes"].collect()) == [("MyApp", "program", True), ("X", "unresolved", False)]
    assert [(r["section"], r["certainty"], r["line"]) for r in g["edges"].collect()] == [("interface", "unconditional", 7)]
    for i, bad in enumerate(['{"x": 1', '{"nodes": []}', '{"schemaVersion": 99, "nodes": []}', '{"schemaVersion": 2}']):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(graph_json.GraphFormatError):
            graph_json.read_graph_json(spark, str(tmp_path / f"bad{i}.json"))


def test_graph_of_many_documents(spark, tmp_path):
    """Two graphs in parts of three rows: what is read is what was written, in order; a small one is one plain document."""
    graphs = spark.createDataFrame([(g, "A", *[""] * 6, None, None) for g in "gh"], "graph_id string, root_unit string, dproj string, dpr string, compiler string, compiler_name string, platform string, config string, app_type string, project_version string")
    nodes = spark.createDataFrame([(g, f"N{i}", f"n{i}", "", "project", True, [f"a{i}"] if i % 2 else []) for g, n in (("g", 8), ("h", 2)) for i in range(n)], "graph_id string, key string, name string, file_name string, kind string, parsed boolean, aliases array<string>")
    edges = spark.createDataFrame([(g, i * 7, f"n{i}", f"n{i + 1}", "interface", "unconditional", "", "f", i) for g, n in (("g", 7), ("h", 1)) for i in range(n)], "graph_id string, seq long, from_unit string, to_unit string, section string, certainty string, cond string, file string, line int")
    warnings = spark.createDataFrame([("g", i, "f", i, f"w{i}") for i in range(4)], "graph_id string, seq long, file string, line int, message string")
    paths = spark.createDataFrame([("g", 0, "x", "rtl")], "graph_id string, path_pos int, folder string, origin string")
    defines = spark.createDataFrame([("g", "D"), ("h", "D")], "graph_id string, define string")
    docs = graph_json.graph_documents(graphs, nodes, edges, warnings, paths, defines, 3)
    assert sorted((r["graph_id"], r["slice"]) for r in docs.collect()) == [("g", 0), ("g", 1), ("g", 2), ("h", 0)]
    plain = json.loads(docs.where("graph_id = 'h'").first()["value"])
    assert "part" not in plain and plain["summary"] == {"units": 2, "edges": 1, "unresolved": 0, "warnings": 0}
    graph_json.write_graph_json(docs, str(tmp_path / "o"))
    got = graph_json.read_graph_json(spark, str(tmp_path / "o"))
    name = lambda r: r["graph_id"][-1]
    assert sorted((name(r), r["name"], r["aliases"]) for r in got["nodes"].collect()) == sorted((r["graph_id"], r["name"], r["aliases"]) for r in nodes.collect())
    assert [(name(r), r["from_unit"], r["line"]) for r in got["edges"].orderBy("graph_id", "seq").collect()] == [(r["graph_id"], r["from_unit"], r["line"]) for r in edges.orderBy("graph_id", "seq").collect()]
    assert [r["message"] for r in got["warnings"].orderBy("seq").collect()] == ["w0", "w1", "w2", "w3"]
    assert sorted(map(name, got["graphs"].collect())) == ["g", "h"] and got["search_paths"].count() == 1 and got["defines"].count() == 2


def test_documents_are_dealt_one_by_one(spark, tmp_path):
    """Twenty documents go to twenty tasks, not to as many as there are shuffle partitions; packed files are read like plain ones."""
    graphs = spark.createDataFrame([("g", "A", *[""] * 6, None, None)], "graph_id string, root_unit string, dproj string, dpr string, compiler string, compiler_name string, platform string, config string, app_type string, project_version string")
    nodes = spark.range(100).selectExpr("'g' as graph_id", "'N' || id as key", "'n' || id as name", "'' as file_name", "if(id < 7, 'unresolved', 'project') as kind", "true as parsed", "cast(array() as array<string>) as aliases")
    edges = spark.createDataFrame([], "graph_id string, seq long, from_unit string, to_unit string, section string, certainty string, cond string, file string, line int")
    warnings = spark.range(60).selectExpr("'g' as graph_id", "id as seq", "'f' as file", "cast(id as int) as line", "'w' || id as message")
    paths = spark.createDataFrame([], "graph_id string, path_pos int, folder string, origin string")
    docs = graph_json.graph_documents(graphs, nodes, edges, warnings, paths, spark.createDataFrame([], "graph_id string, define string"), 5)
    assert "graph_id#" in (plan := docs._jdf.queryExecution().optimizedPlan().toString()) and "RepartitionByExpression [graph_id#" in plan
    assert {line.rstrip().rpartition("], ")[2] for line in plan.splitlines() if "RepartitionByExpression [graph_id#" in line} == {"21"}
    summary = {"units": 100, "edges": 0, "unresolved": 7, "warnings": 60}
    texts = {r["slice"]: json.loads(r["value"]) for r in docs.collect()}
    assert sorted(texts) == list(range(20)) and all(t["summary"] == summary and len(t["nodes"]) == 5 for t in texts.values())
    graph_json.write_graph_json(docs, str(tmp_path / "o"), "gzip")
    got = graph_json.read_graph_json(spark, str(tmp_path / "o"))
    assert [r["message"] for r in got["warnings"].orderBy("seq").collect()] == [f"w{i}" for i in range(60)]
    assert sorted(r["name"] for r in got["nodes"].collect()) == sorted(f"n{i}" for i in range(100)) and got["edges"].count() == 0
    assert "LogicalRDD" not in got["warnings"]._jdf.queryExecution().optimizedPlan().toString()


def test_corpus(spark, tmp_path):
    (tmp_path / "Unit1.PAS").write_text("unit Unit1;")
    r = corpus.read_corpus(spark, str(tmp_path)).first()
    assert (r["file_name"], r["file_name_lower"], r["ext"], r["content"]) == ("Unit1.PAS", "unit1.pas", ".pas", "unit Unit1;")


def test_corpus_charsets(spark, tmp_path):
    """Byte order marks are left out, other charsets are read, and what can not be read is a warning."""
    texts = {"a.pas": "unit é;".encode(), "b.pas": b"\xef\xbb\xbfunit B;", "c.pas": b"\xff\xfe" + "unit é;".encode("utf-16-le"), "d.pas": b"\xfe\xff" + "unit D;".encode("utf-16-be"), "e.pas": "unit é;".encode("latin-1"), "g.pas": b"\xff\xfea"}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    read = corpus.read_corpus(spark, str(tmp_path))
    assert {r["file_name"]: r["content"] for r in read.collect()} == {"a.pas": "unit é;", "b.pas": "unit B;", "c.pas": "unit é;", "d.pas": "unit D;", "e.pas": "unit é;", "g.pas": "\ufffd"}
    assert corpus.unreadable(spark, str(tmp_path), read).collect() == []
    assert [r["file"].rpartition("/")[2] for r in corpus.unreadable(spark, str(tmp_path), read.where("file_name != 'd.pas'")).collect()] == ["d.pas"]


def test_written_corpus_as_sql(spark):
    """The files that ``read_corpus`` writes and reads are those that its SQL describes."""
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    expected = con.execute(f"select path, ext, chars, sha256 from ({oracles.ORACLES['read_corpus']})").fetchall()
    got = [tuple(r) for r in queries.queries()["read_corpus"](spark, at).select("path", "ext", "chars", "sha256").collect()]
    assert expected and sorted(got) == sorted(expected)
