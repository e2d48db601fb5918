"""Calculation-chain rules and workbook files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pytest
from conftest import by, same_rows

from tamperlens.operators.calcchain import chain_anomalies, fill_sheet_ids, row_movement, split_cell_ref
from tamperlens.plans.limits import Limits
from tamperlens.sources.workbooks import (
    _batches,
    _free_names,
    parse_calc_chains,
    parse_workbook_cells,
    read_calc_chains,
    read_workbooks,
    unreadable_workbooks,
    workbook_files,
    workbook_tables,
)

SCHEMA = "path string, sheet_id string, index bigint, cell_ref string"


def chain(spark, **sheets):
    rows, index = [], 0
    for sheet, refs in sheets.items():
        for ref in refs:
            rows.append(("book", sheet, index, f"F{ref}" if isinstance(ref, int) else ref))
            index += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_references(spark):
    df = spark.createDataFrame([("AB12",), ("A1:B2",), ("12",), ("a1",), (None,), ("B007",)], "cell_ref string")
    found = by(split_cell_ref(df).collect(), "cell_ref")
    assert (found["AB12"]["column"], found["AB12"]["row"]) == ("AB", 12)
    assert (found["A1:B2"]["column"], found["A1:B2"]["row"]) == ("A", 1)
    assert found["B007"]["row"] == 7
    assert all(found[r]["row"] is None for r in ("12", "a1", None))


def test_ascending_chain_fires_rule_one(spark):
    found = chain_anomalies(chain(spark, s1=[5, 6, 7])).collect()
    assert [(f["cell_ref"], f["evidence_type"], f["confidence_score"], f["original_sheet_row"]) for f in found] == [
        ("F6", "calculation_order_anomaly", 4, 6)
    ]
    assert found[0]["explanation"] == (
        "F6: row 6 skips rows of the chain step 5 to 7"
    )


def test_gap_rule(spark):
    found = by(chain_anomalies(chain(spark, s1=[3, 2, 40, 1, 1, 1])).collect(), "suspicious_row")
    assert found[40]["evidence_type"] == "calculation_gap" and found[40]["confidence_score"] == 2
    assert found[40]["original_sheet_row"] is None
    assert (found[40]["prev_row"], found[40]["next_row"]) == (2, 1)
    between = by(chain_anomalies(chain(spark, s1=[20, 9, 2, 2])).collect(), "suspicious_row")
    assert between[9]["original_sheet_row"] == 3  # next row + 1 on a falling chain


def test_outlier_rule_uses_the_upper_median(spark):
    steps = [30, 28, 26, 24, 22, 20, 18, 16, 14, 12, 10, 8, 6, 4, 2]
    found = by(chain_anomalies(chain(spark, s1=steps)).collect(), "suspicious_row")
    # every step is two rows, so only the distance to the median of the context tells
    context = sorted(steps[0:12])  # entry 1 sees positions 0 to 11
    assert found[28]["median_context_row"] == context[len(context) // 2] == 20
    assert found[28]["evidence_type"] == "position_outlier" and found[28]["distance"] == 8
    assert found[28]["original_sheet_row"] == 20
    assert chain_anomalies(chain(spark, s1=[9, 9, 9, 9, 9])).isEmpty()


def test_ends_and_short_chains_are_not_tested(spark):
    assert chain_anomalies(chain(spark, s1=[1], s2=[1, 90])).isEmpty()
    assert {f["calc_index"] for f in chain_anomalies(chain(spark, s1=[1, 50, 1])).collect()} == {1}


def test_references_without_row_do_not_separate_neighbours(spark):
    with_junk = chain_anomalies(chain(spark, s1=[5, "TOTAL", 6, "X", 7])).collect()
    assert [(f["cell_ref"], f["prev_row"], f["next_row"]) for f in with_junk] == [("F6", 5, 7)]


def test_sheets_are_apart_and_a_missing_id_is_a_sheet(spark):
    df = spark.createDataFrame(
        [("b", None, 0, "A5"), ("b", "2", 1, "A90"), ("b", None, 2, "A6"), ("b", None, 3, "A7")], SCHEMA
    )
    found = chain_anomalies(df).collect()
    assert [(f["sheet_id"], f["cell_ref"]) for f in found] == [(None, "A6")]


@pytest.mark.parametrize("block", [3, 11, 50])
def test_blocks_give_the_same_anomalies(spark, block):
    refs = [(i * 7919) % 97 + 1 if i % 5 else i for i in range(200)]
    df = chain(spark, s1=refs, s2=refs[::-1])
    limits = Limits(window_rows=1, block_rows=block)
    assert same_rows(chain_anomalies(df, "window"), chain_anomalies(df, "auto", limits))


def test_sheet_ids_are_carried_across_blocks(spark):
    rows = [("b", "1" if i == 0 else "2" if i == 30 else None, i, f"A{i}") for i in range(60)]
    filled = fill_sheet_ids(spark.createDataFrame(rows, SCHEMA), Limits(block_rows=7)).collect()
    assert all(r["sheet_id"] == ("1" if r["index"] < 30 else "2") for r in filled)


def test_row_movement_consolidates_both_offsets(spark):
    df = chain(spark, s1=[5, 6, 7, 8, 9])
    found = by(row_movement(df, [5]).collect(), "data_row_index")
    row = found[5]
    # data row 5 is sheet row 6 or 7; both fire rule one
    assert [e["suspicious_row"] for e in row["evidence"]] == [6, 7]
    assert row["confidence_score"] == 8 and row["confidence"] == "high"
    assert row["mapping_strategies"] == [
        "sheet row = data row + 1",
        "sheet row = data row + 2",
    ]
    assert row["probable_original_position"] == 5
    assert row["explanation"].count("; ") == 1


def test_zero_original_position_counts_as_missing(spark):
    found = row_movement(chain(spark, s1=[0, 1, 9, 9, 9]), [0]).collect()
    assert found[0]["probable_original_position"] is None


def test_rows_listed_per_workbook(spark):
    df = chain(spark, s1=[5, 6, 7])
    other = df.selectExpr("'other' AS path", "sheet_id", "index", "cell_ref")
    listed = spark.createDataFrame([("other", 5)], "path string, row_index bigint")
    assert [r["path"] for r in row_movement(df.union(other), listed).collect()] == ["other"]
    assert row_movement(df, [5]).count() == 1
    with pytest.raises(ValueError):
        row_movement(df.union(other), [5])


def test_one_sort_serves_the_windows_of_a_chain(spark):
    found = chain_anomalies(chain(spark, s1=[5, 6, 7, 8, 9]), "window")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 1


def test_row_movement_broadcasts_neither_rows_nor_sheets(spark):
    df = chain(spark, s1=[5, 6, 7, 8, 9])
    listed = spark.createDataFrame([("book", 5)], "path string, row_index bigint")
    plan = row_movement(df, listed)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)


@pytest.fixture
def books(tmp_path):
    chain_xml = f'<calcChain xmlns="{NS}"><c r="F5" i="1"/><c r="F6"/><c r="G7"/><c r="F2" i="2"/></calcChain>'
    sheet = (
        f'<worksheet xmlns="{NS}"><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>score</t></is></c></row>'
        '<row r="2"><c r="A2"><v>11</v></c><c r="B2"><v>1.5</v></c></row>'
        '<row r="3"><c r="A3"><v>12</v></c><c r="B3" t="b"><v>1</v></c></row>'
        "</sheetData></worksheet>"
    )
    shared = f'<sst xmlns="{NS}"><si><r><t>i</t></r><r><t>d</t></r></si></sst>'
    other = (
        f'<worksheet xmlns="{NS}"><sheetData>'
        '<row r="1"><c r="A1" t="inlineStr"><is><t>score</t></is></c><c r="C1" t="inlineStr"><is><t>id</t></is></c></row>'
        '<row r="2"><c r="A2"><v>2.5</v></c><c r="C2"><v>21</v></c></row></sheetData></worksheet>'
    )
    named = (
        f'<workbook xmlns="{NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Data" sheetId="1" r:id="rId7"/></sheets></workbook>'
    )
    links = (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>'
    )
    workbook(
        tmp_path / "one.xlsx",
        {"xl/calcChain.xml": chain_xml, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared},
    )
    (tmp_path / "sub").mkdir()
    workbook(
        tmp_path / "sub" / "two.xlsx",
        {"xl/workbook.xml": named, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/first.xml": other},
    )
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip file")
    workbook(tmp_path / "bad_chain.xlsx", {"xl/calcChain.xml": '<calcChain><c r="A1" i="1"/><c r="A2"'})
    return str(tmp_path)


def test_read_calc_chains(spark, books):
    rows = read_calc_chains(spark, books).orderBy("index").collect()
    assert [(r["sheet_id"], r["index"], r["cell_ref"]) for r in rows] == [
        ("1", 0, "F5"),
        ("1", 1, "F6"),
        ("1", 2, "G7"),
        ("2", 3, "F2"),
    ]
    assert all(r["path"].endswith("one.xlsx") for r in rows)
    assert chain_anomalies(read_calc_chains(spark, books)).count() == 1


def test_read_workbooks(spark, books):
    table = read_workbooks(spark, books)
    assert set(table.columns) == {"path", "sheet_row", "id", "score"}
    rows = sorted((r["path"].rsplit("/", 1)[1], r["sheet_row"], r["id"], r["score"]) for r in table.collect())
    assert rows == [("one.xlsx", 2, 11, "1.5"), ("one.xlsx", 3, 12, "true"), ("two.xlsx", 2, 21, "2.5")]


def test_repeated_and_blank_headers_lose_no_cell(spark):
    cells = [("b", "S", 1, "A", 1, "x"), ("b", "S", 1, "B", 2, "x")]
    cells += [("b", "S", 2, c, i, str(10 * i)) for i, c in enumerate("ABC", start=1)]
    schema = "path string, sheet string, row bigint, column string, column_index int, value string"
    row = workbook_tables(spark.createDataFrame(cells, schema)).first()
    assert (row["x"], row["x_2"], row["column_3"]) == (10, 20, 30)


def test_broken_workbooks_are_reported(spark, books):
    files = workbook_files(spark, books)
    found = {r["path"].rsplit("/", 1)[1]: r["error"] for r in unreadable_workbooks(files).collect()}
    assert not {"one.xlsx", "two.xlsx"} & set(found)
    assert all(found.values()) and any("BadZipFile" in e for e in found.values())


def test_rows_of_small_workbooks_share_a_batch(spark, books):
    files = workbook_files(spark, books)
    for found in (parse_workbook_cells(files), parse_calc_chains(files), unreadable_workbooks(files)):
        assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    rows = ((str(i), "x") for i in range(70_000))
    schema = pa.schema([("path", pa.string()), ("error", pa.string())])
    assert [b.num_rows for b in _batches(rows, schema)] == [50_000, 20_000]


def test_names_of_columns_are_free_whatever_their_case():
    assert _free_names(["x", "X", "x_2", "x", "y"]) == ["x", "X_3", "x_2", "x_4", "y"]
