"""Preview rows, issue lists, the findings table, readers and the archive."""

from __future__ import annotations

import json

import pytest
from conftest import by, same_rows

from tamperlens.analysis import analyze
from tamperlens.operators.evidence import (
    cell_highlights,
    context_rows,
    context_totals,
    id_sequence,
    issue_counts,
    issues_from_duplicates,
    issues_from_movement,
    issues_from_outliers,
    issues_from_segments,
    issues_from_sorting,
    row_issues,
    segment_range_rows,
    suspicious_vs_normal,
    zscore_outliers,
)
from tamperlens.operators.findings import findings_long, findings_summary
from tamperlens.operators.ordering import duplicate_id_rows, out_of_sequence_ids
from tamperlens.plans.limits import Limits
from tamperlens.sources.archive import extract_json_blocks, read_reports, report_ratings
from tamperlens.sources.detect import dataset_metadata, detect_file_types
from tamperlens.sources.sequences import read_fasta, read_vcf
from tamperlens.sources.sinks import write_findings
from tamperlens.plans.staging import with_row_id
from tamperlens.sources.tabular import in_file_order, read_csv, read_delimited, read_json, read_table


# --- preview --------------------------------------------------------------


def numbers(spark, n):
    return spark.range(n).selectExpr("id AS row_id", "cast(id * 2 AS double) AS v")


def test_context_rows(spark):
    df = numbers(spark, 100)
    found = context_rows(df, [1, 20, 23, 99]).orderBy("row_id").collect()
    assert [r["row_id"] for r in found] == [0, 1, 2, 3, 4, 18, 19, 20, 21, 22, 23, 24, 25, 97, 98, 99]
    assert {r["row_id"]: r["omitted_before"] for r in found if r["omitted_before"]} == {18: 13, 97: 71}
    assert [r["row_id"] for r in found if r["is_suspicious"]] == [1, 20, 23, 99]
    totals = context_totals(df, context_rows(df, [1, 20, 23, 99])).first()
    assert tuple(totals) == (16, 84)


def test_context_rows_in_blocks(spark):
    df = numbers(spark, 500)
    rows = list(range(3, 500, 29))
    assert same_rows(context_rows(df, rows), context_rows(df, rows, limits=Limits(block_rows=7)))


def test_outliers(spark):
    df = spark.range(60).selectExpr("id AS row_id", "if(id = 7, 100D, cast(id % 3 AS double)) AS v", "1 AS c")
    found = zscore_outliers(df).collect()
    assert [(r["row_index"], r["column"], r["value"]) for r in found] == [(7, "v", 100.0)]


def test_id_sequence_and_side_means(spark):
    df = spark.createDataFrame([(0, 1, "a", 2.0), (1, 2, "b", 4.0), (2, 3, "a", 6.0)], "row_id bigint, i int, g string, y double")
    found = by(id_sequence(df, "i", "g", [2]).collect(), "row_number")
    assert found[2]["is_suspicious"] and not found[0]["is_suspicious"] and found[1]["id_value"] == 2
    means = by(suspicious_vs_normal(df, [2], "g", ["y"]).collect(), "is_suspicious", "group")
    assert means[(True, "a")]["mean"] == 6 and means[(False, "a")]["mean"] == 2


@pytest.mark.parametrize(
    ("indices", "rows", "expected"),
    [
        ("[3, 5]", "100-200", [3, 5]),
        ('["4", 6, "x"]', None, [4, 6]),
        ("9", "1-2", [9]),
        ("[]", "100-2300", list(range(100, 2301))),
        (None, "7-9", [7, 8, 9]),
        ("abc", "9-7", []),
        (None, None, []),
    ],
)
def test_segment_range_rows(spark, indices, rows, expected):
    df = spark.createDataFrame([(indices, rows)], "i string, r string")
    assert [r["row_index"] for r in segment_range_rows(df, "i", "r").collect()] == expected


# --- issues ---------------------------------------------------------------


@pytest.fixture(scope="module")
def issues(spark):
    rows = [(r, f"p{n}", "a") for r, n in enumerate([3, 1, 2, 4, 4])]
    df = spark.createDataFrame(rows, "row_id bigint, pid string, g string")
    outliers = spark.createDataFrame([(0, "y", 9.0, 4.0, 2.5), (0, "z", 9.0, 4.0, 2.5)], "row_index bigint, column string, value double, z_score double, threshold double")
    movement = spark.createDataFrame([("b", 2, "moved")], "path string, data_row_index bigint, explanation string")
    segments = spark.createDataFrame(
        [(0, "odd", ["pid"], 7), (1, None, None, None)],
        "row_index bigint, description string, columns_involved array<string>, severity int",
    )
    return (
        issues_from_sorting(out_of_sequence_ids(df, "pid", "g"), "pid"),
        issues_from_movement(movement),
        issues_from_duplicates(duplicate_id_rows(df, "pid"), "pid"),
        issues_from_outliers(outliers),
        issues_from_segments(segments, "pid"),
    )


def test_row_issues(issues):
    found = row_issues(*issues).collect()
    assert [r["row_index"] for r in found] == sorted(r["row_index"] for r in found)
    texts = by(found, "row_index", "issue_type")
    assert texts[(0, "sorting_anomaly")]["explanation"] == "id p3 follows id None in g=a"
    assert texts[(3, "duplicate_id")]["explanation"] == "id p4 stands in 2 rows"
    # two outlying columns, the first explanation stays
    assert texts[(0, "statistical_anomaly")]["explanation"] == "y: z-score beyond 2.5"
    assert texts[(0, "segment_anomaly")]["explanation"] == "odd [columns pid; severity 7]"
    assert texts[(1, "segment_anomaly")]["explanation"] == "no description [columns unknown; severity unknown]"
    assert texts[(2, "excel_movement")]["explanation"] == "moved"
    counts = by(issue_counts(row_issues(*issues)).collect(), "issue_type")
    assert counts["duplicate_id"]["rows"] == 2 and counts["statistical_anomaly"]["rows"] == 1


def test_cell_highlights_keep_the_last(issues):
    found = by(cell_highlights(*issues).collect(), "row_index", "column")
    assert found[(0, "pid")]["cell_type"] == "segment_anomaly"  # written after sorting
    assert found[(3, "pid")]["cell_type"] == "duplicate"
    assert found[(0, "z")]["cell_type"] == "outlier"
    assert (2, None) not in found  # moved rows mark no cell


# --- findings -------------------------------------------------------------


def test_findings_table(spark, tmp_path):
    parts = {
        "sorting_anomaly": spark.createDataFrame([(4, 9, "d", True)], "row_index int, severity int, description string, flag boolean"),
        "with_without_comparison": spark.createDataFrame([("y", True), ("z", False)], "column string, significance_changed boolean"),
    }
    table = findings_long(parts)
    found = by(findings_summary(table).collect(), "type")
    assert found["sorting_anomaly"]["title"] == "Sorting Anomaly" and not found["sorting_anomaly"]["significance_changed"]
    two = found["with_without_comparison"]
    assert (two["finding_count"], two["significance_changed"], two["total_issues"], two["distinct_types"]) == (2, True, 3, 2)
    folder = str(tmp_path / "out")
    write_findings(table, folder)
    lines = [json.loads(r["value"]) for r in spark.read.text(folder).collect()]
    one = [r for r in lines if r["type"] == "sorting_anomaly"][0]
    assert one["significance_changed"] is None and json.loads(one["details"])["flag"] is True


def test_analyze_planted(spark):
    ids = list(range(60))
    ids = ids[40:48] + ids[:40] + ids[48:]
    rows = [(i, n, "a", 50.0 + i % 7 + (8 if i < 8 else 0)) for i, n in enumerate(ids)]
    rows += [(60 + i, 100 + i, "b", 50.0 + i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, pid int, g string, y double")
    found = analyze(df, "pid", "g", ["y"], ["pos"])
    order = found["sorting_anomaly"].collect()
    assert {r["row_index"] for r in order if r["position_difference"] == 40} == set(range(8))
    assert found["duplicate_ids"].isEmpty()
    summary = by(findings_summary(findings_long(found)).collect(), "type")
    assert summary["sorting_anomaly"]["finding_count"] == 48
    with pytest.raises(ValueError):
        analyze(df, "nope", "g", ["y"], ["pos"])


# --- readers --------------------------------------------------------------


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,name\n1,é\n2,�\n", encoding="utf-8")
    (tmp_path / "l.csv").write_bytes("id,name\n1,é\n".encode("latin-1"))
    utf = read_csv(spark, str(tmp_path / "u.csv")).orderBy("id").collect()
    assert [r["name"] for r in utf] == ["é", "�"]  # a genuine replacement mark is valid UTF-8
    assert read_csv(spark, str(tmp_path / "l.csv")).first()["name"] == "é"
    assert dict(read_table(spark, str(tmp_path / "u.csv")).dtypes) == {"id": "int", "name": "string"}


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("a.tsv", "id\tv\n1\t2.5\n2\t3\n"),
        ("b.txt", "id,v\n1,2.5\n2,3\n"),
        ("c.txt", "id;v\n1;2.5\n2;3\n"),
        ("d.txt", "id   v\n1  2.5\n 2 3\n\n"),
    ],
)
def test_delimiters(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    found = read_delimited(spark, str(tmp_path / name)).orderBy("id")
    assert [(r["id"], r["v"]) for r in found.collect()] == [(1, 2.5), (2, 3.0)]


def test_blank_text_types(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b c\n1 1.5 x\n2 2 y\n")
    found = read_delimited(spark, str(tmp_path / "t.txt"))
    assert dict(found.dtypes) == {"a": "int", "b": "double", "c": "string"}


def test_untidy_csv(spark, tmp_path):
    (tmp_path / "my a.csv").write_text('id,v,t\n1111111111111111111,NA,"x\ny"\n1111111111111111112,2,z\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,v,t\n3,null,é\n", encoding="latin-1")
    (tmp_path / "c.csv").write_text("id,v,t\n4,5,é\n", encoding="utf-8")
    found = read_csv(spark, str(tmp_path))
    assert dict(found.dtypes) == {"id": "bigint", "v": "int", "t": "string"}
    assert {(r["id"], r["v"], r["t"]) for r in found.collect()} == {
        (1111111111111111111, None, "x\ny"), (1111111111111111112, 2, "z"), (3, None, "é"), (4, 5, "é")
    }
    (tmp_path / "wide.csv").write_text("id\n99999999999999999998\n99999999999999999999\n")
    assert read_csv(spark, str(tmp_path / "wide.csv")).distinct().count() == 2


def test_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n" + "".join(f"{i * 7 % 50}\n" for i in range(50)))
    found = read_csv(spark, str(tmp_path / "a.csv"), file_order=True)
    rows = with_row_id(found, in_file_order()).orderBy("row_id").collect()
    assert [r["id"] for r in rows] == [i * 7 % 50 for i in range(50)]


def test_surplus_fields_of_blank_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\n1 2\n3 4 5 6\n7\n")
    found = by(read_delimited(spark, str(tmp_path / "t.txt")).collect(), "a")
    assert found[3]["extra_fields"] == ["5", "6"] and found[7]["b"] is None


def test_variant_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tS1\n1\t10\tx\n")
    (tmp_path / "b.vcf").write_text("#CHROM\tPOS\tS2\n2\t20\ty\n")
    found = by(read_vcf(spark, str(tmp_path)).collect(), "CHROM")
    assert (found[1]["S1"], found[1]["S2"], found[2]["S1"], found[2]["S2"]) == ("x", None, None, "y")


def test_json(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"id": 1}\n{"id": 2}\n\n{"id": 3}\n')
    (tmp_path / "lines" / "b.json").write_text('[{"id": 4},\n{"id": 5}]')
    assert sorted(r["id"] for r in read_json(spark, str(tmp_path / "lines")).collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "t.json").write_text('[\n {"id": 1},\n {"id": 2}\n]')
    assert read_json(spark, str(tmp_path / "t.json")).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "x.sav")


def test_fasta(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">a first one\r\nACGT\r\nAC\r\n>b\n" + "G" * 70 + "\n>c empty\n")
    found = by(read_fasta(spark, str(tmp_path / "s.fa")).collect(), "id")
    assert (found["a"]["description"], found["a"]["length"], found["a"]["sequence"]) == ("a first one", 6, "ACGTAC")
    assert found["b"]["length"] == 70 and found["b"]["first_bases"] == "G" * 50
    assert found["c"]["length"] == 0


def test_vcf_keeps_the_header(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\n##x\n#CHROM\tPOS\tREF\n1\t10\tA\n2\t20\tC\n")
    found = read_vcf(spark, str(tmp_path / "v.vcf")).orderBy("POS").collect()
    assert [(r["CHROM"], r["POS"], r["REF"]) for r in found] == [(1, 10, "A"), (2, 20, "C")]
    (tmp_path / "w.vcf").write_text("##fileformat=VCFv4.2\n")
    with pytest.raises(ValueError):
        read_vcf(spark, str(tmp_path / "w.vcf"))


def test_file_types(spark, tmp_path):
    files = {
        "a.CSV": "x",
        "b.fna": "x",
        "c.json": "{}",
        "d.vcf": "x",
        "e": ">seq\nA",
        "f": "##fileformat=VCFv4\n",
        "g": "a,b\n",
        "h.dat": "a\tb\n",
        "i": "plain\nlater, comma",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = {r["path"].rsplit("/", 1)[1]: r["file_type"] for r in detect_file_types(spark, str(tmp_path)).collect()}
    assert found == {
        "a.CSV": "tabular",
        "b.fna": "sequence",
        "c.json": "json",
        "d.vcf": "variant",
        "e": "sequence",
        "f": "variant",
        "g": "tabular",
        "h.dat": "tabular",
        "i": "unknown",
    }


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,v\n1,2.5\n2,3\n")
    one = dataset_metadata(read_csv(spark, str(tmp_path / "m.csv"))).first()
    assert (one["row_count"], one["column_count"], one["file_size"]) == (2, 2, (tmp_path / "m.csv").stat().st_size)
    assert one["column_names"] == ["id", "v"] and one["column_types"] == {"id": "int", "v": "double"}


# --- archive --------------------------------------------------------------

REPORT = """MANIPULATION_RATING: 8
## Columns
```json
{"id_columns": ["a", "b"], "group_columns": ["g"], "note": "x"}
```
## Findings
```json
[{"type": "sorting_anomaly", "details": [1]}, {"type": "duplicate_ids"}]
```
"""


def test_archive(spark, tmp_path):
    stamps = {"r1": 100.5, "r2": 300.0, "r3": 200.0}
    for name, stamp in stamps.items():
        folder = tmp_path / name
        folder.mkdir()
        info = {"id": name, "filename": "d.csv", "timestamp": stamp, "report_filename": "report d.md"}
        (folder / "analysis_info.json").write_text(json.dumps(info))
        if name != "r3":
            (folder / "report d.md").write_text(REPORT if name == "r1" else "nothing rated")
    (tmp_path / "r1" / "p.png").write_bytes(b"x")
    (tmp_path / "r1" / "q.svg").write_bytes(b"x")
    reports, pictures = read_reports(spark, str(tmp_path))
    found = report_ratings(reports, pictures).collect()
    assert [r["id"] for r in found] == ["r2", "r3", "r1"]
    assert (found[2]["manipulation_rating"], found[2]["rating_band"], found[2]["visualization_count"]) == (8, "high", 2)
    assert found[0]["manipulation_rating"] is None and found[0]["date"] == "1970-01-01 00:05:00"
    assert found[1]["visualization_count"] == 0


def test_json_blocks(spark):
    one_block = "```json\n{}\n```"
    broken = "```json\n{oops\n```\ntext\n```json\n[{]\n```"
    df = spark.createDataFrame([(1, REPORT), (2, one_block), (3, broken), (4, None)], "i int, report string")
    found = by(extract_json_blocks(df, "report").collect(), "i")
    assert found[1]["column_count"] == 3 and found[1]["finding_count"] == 2
    assert [f["type"] for f in found[1]["findings"]] == ["sorting_anomaly", "duplicate_ids"]
    assert found[2]["column_count"] is None and found[4]["finding_count"] is None
    assert found[3]["column_count"] == 0 and found[3]["finding_count"] == 0


@pytest.mark.parametrize("query, files", [
    ("csv_documents", "*.csv"), ("delimited_order", "*.csv"), ("json_documents", "kind=lines/*.json"),
])
def test_no_single_task_writes_the_files_of_a_query(spark, sf_dir, tmp_path, monkeypatch, query, files):
    from catalog import source_queries

    docs = tmp_path / "tables"
    for name in ("documents", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(4).write.parquet(f"{docs}/{name}.parquet")
    monkeypatch.setattr(source_queries, "scratch", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        getattr(source_queries, query)(spark, str(docs)).count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob(f"[cjt]s*/{files}"))) > 1


def test_documents_of_json_files_are_inferred_from_their_texts(spark, tmp_path):
    from tamperlens.sources.tabular import _document_schema, read_json

    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": "é"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"a": 2.5,\n "c": [1]}]', encoding="utf-8")
    own = spark.read.json(str(tmp_path), multiLine=True)
    assert _document_schema(spark, str(tmp_path)) == own.schema
    found = read_json(spark, str(tmp_path))
    assert found.schema == own.schema and sorted(found.collect(), key=str) == sorted(own.collect(), key=str)


def test_first_lines_of_files(spark):
    from tamperlens.sources.tabular import first_lines

    lines = spark.createDataFrame([("x", 3, "c"), ("x", 2, "b"), ("y", 9, "z"), ("y", 11, "a")], "file string, place bigint, line string")
    assert sorted(tuple(r) for r in first_lines(lines, "line", "place")) == [("x", "b"), ("y", "z")]
