"""Readers, sinks, the workbook source, whole studies and the stream."""

import datetime
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalens.operators import guard, trajectory
from stratalens.plans import study
from stratalens.operators.explore import Explorer
from stratalens.sources import results, sorted as sorted_tables, tables, typed, xlsx
from stratalens.streaming.rates import windowed_band

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets, shared=False):
    words = []

    def cell(v):
        if shared and isinstance(v, str):
            words.append(v)
            return f'<c t="s"><v>{len(words) - 1}</v></c>'
        return "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        if words:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{w[:1]}</t></r><r><t>{w[1:]}</t></r></si>" for w in words) + "</sst>")


INFO = [["Random ID", "ME BS Degree Status", "CGPA at ETM to any campus", "Graduating CGPA", "Enrolled Terms (SU included)", "CHEM 110 Outcome After 1st AY"], ["S-00998", "Graduated", 3.0, 3.5, 8, "1st Attempt=ABC"], ["S-12345", "Not Graduated", 2.0, None, 0, None]]
TERMS = [["Random ID", "1st Term", "1st Fall", "1st Spring", "1st Summer"], ["B-00998", 2168, 3.0, None, 4.0]]


def test_build_from_a_workbook(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    workbook(path, {"Info": INFO, "Terms": TERMS})
    assert list(xlsx.sheet_columns(spark, path)) == ["Info", "Terms"]
    study.main(["build", "--excel", path, "--out", str(tmp_path / "out")])
    wide = {r["merge_id"]: r for r in spark.read.parquet(str(tmp_path / "out/wide")).collect()}
    a, b = wide["00998"], wide["12345"]
    assert (a.graduated_me, b.graduated_me, a.cgpa_gap, b.cgpa_gap) == (1, 0, 0.5, None)
    assert a.chem_110_attempts_to_abc == 1.0 and b.etm_total_attempts_to_abc == 0.0 and a.first_term_label == "Fall 2016"
    assert a.terms_with_gpa == 2 and b.terms_with_gpa is None and a.summer_term_ratio == 0.5
    assert spark.read.parquet(str(tmp_path / "out/terms_long")).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y,g\n1,NaN,n/a\n,2.5,b\n")
    df = tables.read(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.orderBy("x").collect()] == [(None, 2.5, "b"), (1, None, None)]
    assert tables.load_frames(spark, str(tmp_path / "t.csv"), str(tmp_path / "none.csv"))[1] is None
    assert tables.first_existing(spark, None, str(tmp_path / "none.csv"), str(tmp_path / "t.csv")).endswith("t.csv")
    assert tables.find_sheet({"a": ["z"], "b": ["random_id"]}, ["random_id"]) == "b" and tables.find_term_sheet({"a": ["random_id", "1st_term", "1st_fall"]}) == "a"
    assert "g: 50.0%" in tables.data_report(df, ["x", "nope"], None, guard.missing_rates)


def test_run_all(spark, tmp_path):
    rows = [(f"s{i}", float(i % 2), float(i % 7) + i % 2, "ab"[i % 2 if i % 5 else 0], None if i % 3 else 1.0) for i in range(200)]
    spark.createDataFrame(rows, "random_id string, graduated_me double, score double, program string, sparse double").write.parquet(str(tmp_path / "wide"))
    long = [(f"s{i}", t, 2.0 + (i % 2) * t / 4) for i in range(200) for t in (1, 2, 3)]
    spark.createDataFrame(long, "random_id string, term_index int, term_gpa double").write.parquet(str(tmp_path / "long"))
    study.run_all(spark, str(tmp_path / "wide"), str(tmp_path / "out"), long=str(tmp_path / "long"))
    last = lambda command: Path(results.current(spark, str(tmp_path / f"out/{command}")))
    assert json.loads((last("scan") / "sanitizer_report.json").read_text())["na_heavy_cols"] == ["sparse"]
    text = (last("scan") / "top_trends.md").read_text()
    assert "`score`" in text and "program" in text and "rising series" in text
    assert spark.read.option("header", True).csv(str(last("scan") / "histograms")).filter("part = '1'").count() > 0
    # The sanitized table goes before the given one, and thresholds come from the command.
    study.main(["trends", "--clean", str(tmp_path / "none"), "--out", str(tmp_path / "out"), "--num_k", "1", "--cat_k", "0", "--bucket_k", "0"])
    assert [r["kind"] for r in spark.read.option("header", True).csv(str(last("trends") / "trends")).collect()] == ["numeric_effect"]
    study.main(["slices", "--out", str(tmp_path / "out"), "--feature", "score", "--confounders", "program"])
    found = spark.read.option("header", True).csv(str(last("slices") / "slices")).collect()
    assert found and {r["confounder"] for r in found} == {"program"} and {r["metric"] for r in found} == {"mean_diff"}
    assert spark.read.option("header", True).csv(str(last("trends") / "effect_sizes")).count() == 1


def test_stream(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(t(1), "a", 1.0), (t(2), "a", 3.0), (t(30), "b", 5.0)], "ts timestamp, g string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, g string, v double").parquet(str(tmp_path / "in"))
    q = windowed_band(stream, "ts", F.col("v"), ["g"], "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("bands").start()
    q.processAllAvailable()
    q.stop()
    got = {r["g"]: (r["count"], r["mean"]) for r in spark.sql("SELECT * FROM bands").collect()}
    assert got == {"a": (2, 2.0), "b": (1, 5.0)}


@pytest.mark.parametrize("shared", [False, True])
def test_workbooks_as_a_data_source(spark, tmp_path, monkeypatch, shared):
    """A partition for each sheet, text or typed columns, only those asked for, and rows' numbers."""
    rows = [["a", "b", "a", None, "n"]] + [[f"x{i}", i / 2, f"y{i}", i, i if i % 2 else "odd"] for i in range(25)]
    other = [["n", "z"], [7, "seven"], [None, "none"]]
    workbook(str(tmp_path / "one.xlsx"), {"First": rows, "Second": other}, shared)
    workbook(str(tmp_path / "two.xlsx"), {"First": rows[:3], "Third": []}, shared)
    xlsx.register(spark)
    book = lambda **options: spark.read.format("xlsx").options(**options)
    first = book().load(str(tmp_path / "one.xlsx"))
    assert first.columns == ["a", "b", "a_2", "column_4", "n"] and first.count() == 25 and first.rdd.getNumPartitions() == 1
    assert [tuple(r) for r in book(sheet="Second", ordinal="at").load(str(tmp_path / "one.xlsx")).collect()] == [("7", "seven", 0), (None, "none", 1)]
    narrow = book(sheet="*", sheet_column="s").schema("n double, s string, at bigint, b bigint").load(f"file://{tmp_path}/one.xlsx")
    assert narrow.rdd.getNumPartitions() == 2
    got = narrow.collect()
    assert len(got) == 27 and [(r.n, r.s, r.b) for r in got[:5]] == [(None, "First", 0), (1.0, "First", None), (None, "First", 1), (3.0, "First", None), (None, "First", 2)] and got[-2].n == 7.0
    every = book(sheet="*", sheet_column="s", ordinal="at").load(str(tmp_path))
    assert every.rdd.getNumPartitions() == 4 and {(r["s"], r["n"]) for r in every.groupBy("s").agg(F.count("*").alias("n")).collect()} == {("First", 27), ("Second", 2)}
    assert set(every.columns) == {"a", "b", "a_2", "column_4", "n", "z", "s", "at"}
    with pytest.raises(Exception, match="string, double or bigint"):
        book().schema("a date").load(str(tmp_path / "one.xlsx")).collect()


def test_a_failing_run_leaves_the_last_one(spark, tmp_path):
    out = str(tmp_path / "out")
    assert results.current(spark, out) is None and results.manifest(spark, out)["tables"] == []
    for k in range(3):
        with results.run(spark, out) as place:
            tables.write_csv(spark.range(k + 1), f"{place}/one")
            tables.write_text(spark, f"run {k}", f"{place}/two.md")
    with pytest.raises(RuntimeError), results.run(spark, out) as place:
        tables.write_csv(spark.range(100), f"{place}/one")
        raise RuntimeError("in the middle")
    last = results.current(spark, out)
    assert spark.read.option("header", True).csv(f"{last}/one").count() == 3 and Path(f"{last}/two.md").read_text() == "run 2"
    assert results.manifest(spark, out)["tables"] == ["one", "two.md"]
    assert len(list((tmp_path / "out").glob("run-*"))) == results.KEPT and not list((tmp_path / "out/_staging").glob("run-*"))


def test_a_failing_scan_leaves_the_last_one(spark, tmp_path, monkeypatch):
    rows = [(f"s{i}", float(i % 2), float(i % 7)) for i in range(120)]
    spark.createDataFrame(rows, "random_id string, graduated_me double, score double").write.parquet(str(tmp_path / "wide"))
    study.run_all(spark, str(tmp_path / "wide"), str(tmp_path / "out"))
    before = results.current(spark, str(tmp_path / "out/scan"))
    monkeypatch.setattr(study.synth, "bullets", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        study.run_all(spark, str(tmp_path / "wide"), str(tmp_path / "out"))
    assert results.current(spark, str(tmp_path / "out/scan")) == before and Path(before, "top_trends.md").exists()
    study.main(["sanitize", "--clean", str(tmp_path / "none"), "--upload", str(tmp_path / "wide"), "--out", str(tmp_path / "out")])
    study.main(["report", "--clean", str(tmp_path / "wide"), "--out", str(tmp_path / "out")])
    assert results.manifest(spark, str(tmp_path / "out/sanitize"))["tables"] == ["quarantine", "sanitized.csv", "sanitizer_report.json"]
    assert results.manifest(spark, str(tmp_path / "out/report"))["tables"] == ["data_report.md"]


def test_types_of_a_sample_and_what_comes_later(spark, tmp_path):
    lines = [f"{i},{i}.5,true,t{i},," for i in range(300)]
    (tmp_path / "t.csv").write_text("\n".join(["a,b,c,d,e,f", *lines, "late,1.5d,maybe,t,1.25,x", "7,-inf,FALSE,,NA,"]))
    assert dict(tables.read(spark, str(tmp_path / "t.csv")).dtypes) == {"a": "string", "b": "string", "c": "string", "d": "string", "e": "double", "f": "string"}
    df, fit = typed.read_csv(spark, str(tmp_path / "t.csv"), tables.NA_TOKENS, 100)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "double", "f": "double"}
    rows = df.collect()
    assert len(rows) == 302 and tuple(rows[-2]) == (None, None, None, "t", 1.25, None) and tuple(rows[-1]) == (7, float("-inf"), False, None, None, None)
    assert fit.misfits() == {"a": 1, "b": 1, "c": 1, "f": 1}
    df, fit = typed.read_csv(spark, str(tmp_path / "t.csv"), tables.NA_TOKENS, 100)
    text = tables.data_report(df, [], None, guard.missing_rates, fit=fit)
    assert "- a: 1 not bigint" in text and "- f: 1 not double" in text
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("FileScan") == 1


def _read(df):
    """Rows and files that a scan gave."""
    files = df.withColumn("_file", F.col("_metadata.file_path")).select("_file").distinct().count() if df.columns else 0
    return df.count(), files


def test_a_lookup_reads_one_file(spark, tmp_path):
    long = spark.range(4000).select(F.format_string("s%05d", F.col("id") % 400 * 2).alias("random_id"), (F.col("id") % 10).cast("int").alias("term_index"), F.rand(1).alias("term_gpa"))
    path = str(tmp_path / "terms")
    sorted_tables.write_sorted(long, path, "random_id", ["term_index"], 8)
    assert len(list((tmp_path / "terms").glob("*.parquet"))) == 8
    ids = [r["random_id"] for r in spark.read.parquet(path).coalesce(1).collect()]
    parts = [[(r["random_id"], r["term_index"]) for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "terms").glob("*.parquet"))]
    assert sum(map(len, parts)) == len(ids) == 4000 and all(p == sorted(p) for p in parts)
    assert len(sorted_tables.files_of(spark, path, "s00400")) == 1 and sorted_tables.files_of(spark, path, "t") == []
    assert len(sorted_tables.files_of(spark, path, "s00401")) <= 1  # unknown, between two
    found = sorted_tables.find(spark, path, "random_id", "s00400")
    assert _read(found) == (10, 1) and sorted_tables.find(spark, path, "random_id", "s00401").count() == 0
    assert len(found.inputFiles()) == 1 and "EqualTo(random_id,s00400)" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted_tables.find(spark, path, "random_id", "t").inputFiles() == []


def test_series_of_a_bucketed_table_move_no_rows(spark, tmp_path):
    long = spark.range(900).select((F.col("id") % 90).alias("random_id"), (F.col("id") * 7 % 31).cast("int").alias("term_index"), F.lit("f").alias("term_slot"), F.rand(1).alias("term_gpa"), F.lit(0).alias("is_summer"), F.lit(1).alias("is_regular"))
    sorted_tables.write_bucketed(long, "terms_by_entity", str(tmp_path / "terms"), "random_id", ["term_index"], 4)
    try:
        stored = spark.table("terms_by_entity")
        for of in (trajectory.summarise(stored, "random_id"), trajectory.slopes(stored, "random_id")):
            assert of.count() == 90 and "Exchange hash" not in of._jdf.queryExecution().executedPlan().toString()
        want = {r["random_id"]: r["gpa_slope"] for r in trajectory.slopes(long, "random_id").collect()}
        assert {r["random_id"]: r["gpa_slope"] for r in trajectory.slopes(stored, "random_id").collect()} == pytest.approx(want)
    finally:
        spark.sql("DROP TABLE terms_by_entity")


def test_scope_of_an_explorer(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7), i % 2, "ab"[i % 2]) for i in range(30)], "random_id long, x double, y double, chem_110_ever_passed int, g string")
    view = Explorer(df).between("x", 0, 9).among("g", ["a"])
    corr = lambda t: t.filter("col1 = 'x' and col2 = 'y'").first()["corr"]
    assert corr(view.correlations(["x", "y"])) == pytest.approx(corr(Explorer(df).correlations(["x", "y"])))
    assert corr(view.correlations(["x", "y"], "view")) == pytest.approx(corr(Explorer(view.df).correlations(["x", "y"])))
    assert view.mastery(["chem_110"]).first()["ever_pass"] == 0.5 and view.mastery(["chem_110"], "view").first()["ever_pass"] == 0.0
    long = df.select("random_id", F.lit(1).alias("term_index"), F.col("x").alias("term_gpa"))
    assert {(r["g"], r["count"]) for r in view.trajectories(long, "g", "random_id").collect()} == {("a", 15), ("b", 15)}
    assert {(r["g"], r["count"]) for r in view.trajectories(long, "g", "random_id", "view").collect()} == {("a", 5)}
