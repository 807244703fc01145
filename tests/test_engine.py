"""Operators on Spark: joins, aggregates, sources, reports, and SQL agreement."""

import io
import json
import math
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinweave.functions.similarity import length_band, ratio
from twinweave.operators import classes, jsonconfig, matching, scores
from twinweave.plans import queries, report
from twinweave.sources import files
from twinweave.sources.zip_source import ZipProject
from twinweave.streaming.ingest import ingest


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def file_table(spark, rows):
    return files.typed(spark.createDataFrame([(1, p, c) for p, c in rows], "pair_id int, path string, content string")).select("pair_id", "file_type", "path", "content")


def test_cascade(spark):
    left = file_table(spark, [("a/x.css", ".a{b:c}"), ("ui/Button.jsx", "1"), ("index.html", "<p>"), ("h/Header.tsx", "let a"), ("src/main.css", ".m{a:b} .n{c:d}"), ("src/next-env.d.ts", ""),
                              ("q/zzz.css", "x" * 30)])
    right = file_table(spark, [("a/x.css", ".a{b:c}"), ("ui/Buttons.jsx", "1"), ("indx.html", "<p>"), ("f/Footer.tsx", "function q(){}"), ("lib/other9.css", ".m{a:b} .n{c:d}"), ("w/k.css", "x" * 29 + "y")])
    m = {(r.original, r.modified): (r.match_type, r.score) for r in matching.cascade(left, right).collect()}
    assert {k: v[0] for k, v in m.items()} == {
        ("a/x.css", "a/x.css"): "exact", ("ui/Button.jsx", "ui/Buttons.jsx"): "fuzzy", ("index.html", "indx.html"): "fuzzy",
        ("src/main.css", "lib/other9.css"): "fuzzy+structure", ("q/zzz.css", "w/k.css"): "content"}
    assert m[("ui/Button.jsx", "ui/Buttons.jsx")][1] == pytest.approx(20 / 21)
    assert {r.path for r in matching.unmatched(left, right, matching.cascade(left, right)).collect()} == {"h/Header.tsx", "f/Footer.tsx"}
    assert matching.cascade(left.limit(0), right).count() == 0


def test_context(spark):
    left, right = file_table(spark, [("src/main.css", "")]), file_table(spark, [("src/style.css", "")])
    matched = spark.createDataFrame([(1, "css", "src/k.css", "src/k.css")], "pair_id int, file_type string, original string, modified string")
    assert rows_of(matching.context_candidates(left, right, matched).select("score")) == [(0.5,)]
    assert matching.context_candidates(file_table(spark, [("a.css", "")]), file_table(spark, [("b.css", "")]), matched).count() == 0


def test_greedy(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(g, "css", f"l{i}", f"r{j}", rng.randrange(1, 8) / 8) for g in range(4) for i in range(6) for j in range(6)]
        df = spark.createDataFrame(rows, "pair_id int, file_type string, original string, modified string, score double")
        want = []
        for g in range(4):
            used = set()
            for i in sorted({r[2] for r in rows}):
                free = [r for r in rows if r[0] == g and r[2] == i and r[3] not in used]
                best = max(free, key=lambda r: (r[4], [-ord(c) for c in r[3]])) if free else None
                if best and best[4] >= 0.5:
                    used.add(best[3])
                    want.append(best)
        assert rows_of(matching.greedy(df, 0.5)) == rows_of(matching.greedy_native(df, 0.5)) == sorted(want, key=repr)


def test_blocking_loses_nothing():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(12))) for _ in range(2))
        if ratio(a, b) >= 0.75:
            assert 2 * min(len(a), len(b)) >= 0.75 * (len(a) + len(b))


def test_class_lines(spark):
    df = spark.createDataFrame([(1, '<a className="x y">\n<b class="x">\n\n<c class = "  foo   bar\n baz\tqux  ">')], "id int, content string")
    got = {r["class"]: (r.n, r.lines) for r in classes.class_lines(df, ["id"]).collect()}
    assert got == {"x": (2, [1, 2]), "y": (1, [1]), "foo": (1, [4]), "bar": (1, [4]), "baz": (1, [4]), "qux": (1, [4])}


def test_classes(spark):
    count = lambda items: spark.createDataFrame([(1, k, n) for k, n in items], "id int, class string, n long")
    a, b = count([("x", 2), ("y", 1)]), count([("x", 1), ("z", 1)])
    r = classes.compare_counts(a, b, ["id"]).first()
    assert (r.frequency_similarity, r.set_similarity, r.hybrid_similarity) == pytest.approx((1 / 4, 1 / 3, 7 / 24))
    assert [tuple(c) for c in classes.impact_lists(a, b, ["id"]).first().changes] == [("x", 2, 1, 1), ("y", 1, 0, 1), ("z", 0, 1, 1)]
    registry = classes.Analyzers()
    registry.register("counts", classes.compare_counts)
    registry.register("impact", classes.change_impact)
    assert {r.analyzer for r in registry.run_all(a, b, ["id"]).collect()} == {"counts", "impact"}


def test_html_class_locations(spark):
    df = spark.createDataFrame([(1, '<div class="p  q"><i class="p"></i></div>')], "id int, content string")
    assert {r["class"]: (r.n, r.locations) for r in classes.html_classes(df, ["id"]).collect()} == {
        "p": (2, ['<div class="p q">', '<i class="p">']), "q": (1, ['<div class="p q">'])}


def test_scores(spark):
    pairs = spark.createDataFrame([(1, "css", "a", "b", 0.8)], "pair_id int, file_type string, original string, modified string, similarity double")
    rest = spark.createDataFrame([(1, "css", "original", "c"), (1, "css", "modified", "d")], "pair_id int, file_type string, side string, path string")
    assert scores.type_scores(pairs, rest).first().similarity == pytest.approx(0.8 / 3)
    assert scores.type_scores(pairs.limit(0), rest).first().similarity == 0.0
    none = spark.createDataFrame([], "hybrid_similarity double, set_similarity double, frequency_similarity double, n_classes long")
    s = scores.similarity_stats(none, [])
    assert tuple(s.first()) == (0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)
    assert tuple(scores.config_mean(spark.createDataFrame([], "config_similarity double")).first()) == (0.0, 0)


def test_find_file(spark):
    df = spark.createDataFrame([(1, "b/package.json", "2"), (1, "a/package.json", "1"), (1, "a/b/package.json", "3")], "pair_id int, path string, content string")
    assert jsonconfig.find_file(df, "package.json", ["pair_id"]).first().path == "a/package.json"


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, data in entries.items():
            z.writestr(path, data)
    return out.getvalue()


PROJECTS = {
    "one": {"index.html": "<body><p class='a'>Hi</p></body>", "css/m.css": ".a{b:c}", "tailwind.config.js": "module.exports = {theme: {extend: {colors: {a: 1}}}}", "x.png": b"\xff\x00", "../evil.js": "1", "package.json": "{}"},
    "two": {"index.html": "<body><p class='a'>Hi</p></body>", "css/m.css": ".a{b:d}", "tailwind.config.js": "module.exports = {theme: {extend: {colors: {a: 1, b: 2}}}}", "bad.css": b"\xe9{}", "package.json": "{}"}}


@pytest.fixture
def archives(tmp_path):
    tmp_path = tmp_path / "in"
    tmp_path.mkdir()
    for name, entries in PROJECTS.items():
        (tmp_path / f"{name}.zip").write_bytes(archive(entries))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    return tmp_path


def test_archives(spark, archives, tmp_path):
    rows = files.read_archives(spark, str(archives))
    assert {(r.project_id, r.path) for r in rows.collect()} == {(p, f) for p, e in PROJECTS.items() for f in e if ".." not in f}
    assert rows.where("path = 'bad.css'").first().content == "é{}"
    pairs = spark.createDataFrame([(1, "one", "two")], "pair_id int, original_id string, modified_id string")
    c = report.compare_projects(*files.sides(rows, pairs))
    doc = json.loads(report.project_report(c).first().report)
    types = {t["file_type"]: t["similarity"] for t in doc["types"]}
    assert types == {"html": 1.0, "css": 0.0} and doc["files"] == 4 and doc["config_similarity"] == 0.75
    assert doc["overall_similarity"] == round(2 / 4, 3)
    report.write_reports(report.project_report(c), str(tmp_path / "reports"))
    assert report.compact(report.project_report(c)).first().prediction.startswith("Moderate")
    spark.dataSource.register(ZipProject)
    found = spark.read.format("zip_project").load(f"{archives}/*o*.zip")
    assert {r.path for r in found.collect()} == {"index.html", "css/m.css", "tailwind.config.js", "bad.css"}


def test_directory_and_stream(spark, archives, tmp_path):
    folder = tmp_path / "tree"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.css").write_text("x")
    (folder / ".hidden.js").write_text("y")
    rows = files.read_directory(spark, str(folder), "p")
    assert {r.path for r in rows.collect()} == {"sub/a.css", ".hidden.js"}
    assert [r.path for r in files.by_extension(rows, [".css", ".js"]).collect()] == ["sub/a.css"]
    assert [r.category for r in files.by_category(rows).collect()] == ["css"]
    assert files.assets(rows).count() == 2
    ingest(spark, str(archives), str(tmp_path / "t"), str(tmp_path / "c"))
    n = spark.read.parquet(str(tmp_path / "t")).count()
    ingest(spark, str(archives), str(tmp_path / "t"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == n == 7


def test_damaged_and_large_members(spark, tmp_path):
    """A damaged member beside good ones, and one of 70 MB, which is read whole."""
    good = archive({"a.html": "<p>a</p>", "b.css": ".b{c:d}" * 200, "c.js": "f()"})
    with zipfile.ZipFile(io.BytesIO(good)) as z:
        at = next(i for i in z.infolist() if i.filename == "b.css").header_offset
    broken = bytearray(good)
    broken[at + 40 : at + 50] = b"\xff" * 10
    assert dict(files.members(bytes(broken))) == {"a.html": b"<p>a</p>", "b.css": None, "c.js": b"f()"}
    (tmp_path / "x.zip").write_bytes(bytes(broken))
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("large.css", "/* " + "x" * (70 << 20) + " */ .a{b:c}")
        z.writestr("b.css", ".b{c:d}")
        z.writestr("a.html", "<p>a</p>")
    rows = {(r.project_id, r.path): r.n for r in files.read_archives(spark, str(tmp_path)).selectExpr("project_id", "path", "length(content) AS n").collect()}
    assert rows["y", "large.css"] > 70 << 20 and rows["x", "b.css"] is None and len(rows) == 6
    everything = files.read_archives(spark, str(tmp_path)).where("path <> 'large.css'")
    pairs = spark.createDataFrame([(1, "x", "y")], "pair_id int, original_id string, modified_id string")
    c = report.compare_projects(*files.sides(everything, pairs))
    assert {r.original for r in c.pairs.collect()} == {"a.html"}  # what cannot be read is like nothing
    assert {(r.side, r.path) for r in c.unmatched.collect()} == {("original", "b.css"), ("original", "c.js"), ("modified", "b.css")}


def test_deep_json(spark):
    def nested(depth, leaf):
        return "{" + '"k":{' * depth + f'"a":1,"b":{leaf}' + "}" * (depth + 1)

    rows = spark.createDataFrame([(d, f'{{"compilerOptions":{nested(d, 1)}}}', f'{{"compilerOptions":{nested(d, 2)}}}') for d in (0, 5, 12, 20)], "pair_id int, original string, modified string")
    assert {r.pair_id: r.tsconfig_similarity for r in jsonconfig.tsconfig_similarity(rows).collect()} == dict.fromkeys((0, 5, 12, 20), 0.5)


def test_variables_are_content():
    assert matching._script_score("var a = 1; var b = 2;", "var a = 1; var b = 2;") == 1.0
    assert matching._script_score("let a = 1;", "const b = 2;") > 0 and matching._script_score("f(); g();", "f(); g();") == 0.0


def test_length_bands(spark):
    """Every pair whose ratio may reach the threshold is in neighbouring bands."""
    texts = spark.createDataFrame([("x" * n,) for n in range(0, 400)], "t string")
    for threshold in (0.3, 0.6, 0.75):
        rows = texts.select(F.length("t").alias("n"), length_band(F.col("t"), threshold).alias("band")).collect()
        band = {r.n: r.band for r in rows}
        assert all(abs(band[a] - band[b]) <= 1 for a in band for b in band if 2 * min(a, b) >= threshold * (a + b) and (a and b or a == b))


def test_file_pair(spark):
    columns = "pair_id int, html1 string, html2 string, css1 string, css2 string, jsx1 string, jsx2 string, js1 string, js2 string"
    df = spark.createDataFrame([(1, "<p>a</p>", "<p>a</p>", ".a{b:c}", ".a{b:d}", None, None, "f(", "f()"), (2, *[None] * 8)], columns)
    got = {r.pair_id: r for r in report.file_pair_report(df).collect()}
    assert got[1].html_similarity == 1.0 and got[1].css_similarity == 0.0 and got[1].js_similarity == 0.0 and got[1].overall_similarity == 1.0
    assert got[1].html_summary.startswith("equal ") and got[1].html_summary.endswith("changed 0, left only 0, right only 0 of " + got[1].html_summary.split()[1].rstrip(",")) and got[2].overall_similarity == 0.0
    assert "HTML: 100.00%" in report.text_report(report.file_pair_report(df)).where("pair_id = 1").first().text


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows
    if sql := entry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("pages", "documents", "part", "lineitem", "events", "conversations", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted((tuple(value(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall()), key=repr) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_functions(spark):
    from twinweave.functions.register import register

    register(spark)
    assert spark.sql("SELECT ratio('ab', 'ab') AS r").first().r == 1.0
    assert [r.prop for r in spark.sql("SELECT prop FROM css_decls('.a{b:c;d:e}') ORDER BY ord").collect()] == ["b", "d"]
    assert spark.sql("SELECT count(*) AS n FROM html_nodes('<p>x</p>')").first().n == 3
    assert spark.sql("SELECT avg(e.score) AS s FROM (SELECT explode(tree_compare(parse_html('<p>a</p>'), parse_html('<p>a</p>'))) AS e)").first().s == 1.0


def test_jsx_and_config_expressions(spark):
    from pyspark.sql import functions as F

    from twinweave.functions import jsx
    from twinweave.operators import css as css_operators

    df = spark.createDataFrame([(1, '{"compilerOptions":{"a":1,"b":2,"paths":{"x":[]},"baseUrl":"."},"include":["s"],"extends":"k"}', '{"compilerOptions":{"a":1,"c":3,"paths":{"x":[],"y":[]},"baseUrl":"."},"exclude":["s"]}')], "id int, l string, r string")
    maps = df.select("id", jsonconfig.object_map(F.col("l")).alias("l"), jsonconfig.object_map(F.col("r")).alias("r"))
    assert jsonconfig.paths_extends_table(maps, "id", "l", "r").first().paths_similarity == pytest.approx((0.5 + 1 + 0) / 3)
    one = maps.select(
        jsonconfig.include_exclude_similarity(F.col("l"), F.col("r")), jsonconfig.compiler_options_similarity(*(F.create_map(F.lit("a"), F.lit("1"), F.lit(k), F.lit("2")) for k in "bc")),
        jsx.html_attribute(F.lit("className")), jsx.html_attribute(F.lit("onClick")), jsx.kebab(F.lit("backgroundColor")), jsx.html_value(F.lit("{x}")),
        css_operators.selector_similarity(F.create_map(F.lit("Color"), F.lit("#FFF")), F.create_map(F.lit("color"), F.lit("#ffffff"), F.lit("m"), F.lit("0")))).first()
    assert tuple(one) == (1.0, pytest.approx(0.6 / 3 + 0.4), "class", "onclick", "background-color", "[dynamic]", 0.5)


def test_command_line(archives, capsys, tmp_path):
    from twinweave.__main__ import main

    assert main(["zip", "a.txt", "b.zip"]) == 2 and main(["files"]) == 2
    (tmp_path / "c.zip").write_bytes(archive({"i.html": '<p class="b a">\n<b class="a">'}))
    assert main(["classes", str(tmp_path / "c.zip")]) == 0
    assert [x.split() for x in capsys.readouterr().out.splitlines()] == [["i.html"], ["a", "2", "1", "2"], ["b", "1", "1"], []]
    assert main(["zip", str(archives / "one.zip"), str(archives / "two.zip")]) == 0
    assert '"overall_similarity"' in capsys.readouterr().out
