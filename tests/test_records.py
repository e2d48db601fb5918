"""Delimited records cut in parallel against whole-file reading and a plain parser."""

from __future__ import annotations

import csv
import io
import random

import pandas as pd
import pytest

from tamperlens.plans.staging import with_row_id
from tamperlens.sources.detect import detect_file_types
from tamperlens.sources.records import ends_inside, raw_lines, scan_splits, start_states
from tamperlens.sources.sequences import read_vcf
from tamperlens.sources.workbooks import _date_text, _free_names, _shows_dates
from tamperlens.sources.tabular import header_names, in_file_order, read_csv, read_delimited, read_json, read_table


@pytest.fixture
def small_splits(spark):
    """Files are cut every few bytes, so that splits begin anywhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield use
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def untidy_csv(seed, rows=120, end="\n"):
    rng = random.Random(seed)
    parts = ["a", "b c", "\n", '"', ",", "é", "\n\n", "x,y", "12", '""', ' "', "end\n"]
    table = [
        [str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(4))), rng.choice(["", "t", "q\nr", "plain text"])]
        for i in range(rows)
    ]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "text", "more"])
    writer.writerows(table)
    return out.getvalue(), table


@pytest.mark.parametrize("seed, size, end", [(1, 37, "\n"), (2, 101, "\r\n"), (3, 5, "\n"), (4, 4000, "\n")])
def test_records_equal_the_written_table(spark, tmp_path, small_splits, seed, size, end):
    text, table = untidy_csv(seed, 40 if size < 10 else 120, end)
    (tmp_path / "t.csv").write_bytes(text.encode())
    small_splits(size)
    found = read_csv(spark, str(tmp_path / "t.csv"), file_order=True)
    rows = found.orderBy(*in_file_order()).collect()
    assert [r.id for r in rows] == [int(t[0]) for t in table]
    assert [r.text or "" for r in rows] == [t[1] for t in table]
    assert [r.more or "" for r in rows] == [t[2] for t in table]
    if size < 1000:
        assert raw_lines(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 5


def test_records_equal_whole_file_reading(spark, tmp_path, small_splits):
    """Stray quotes, short and long rows, blank lines, junk behind a closing quote."""
    lines = ['id,a,b', '1,5" pipe,x', '2,"two\nlines",y', "", '3,"say ""hi"", he said",z', "4,short", '5,"q"junk,w',
             '6,a,b,extra', '7, "spaced",v', '8,"a\r\nb",u', '9,"",t', '10,x"y"z,s', "  ", '11,"last, open', "1,2,3"]
    (tmp_path / "w.csv").write_bytes(("\n".join(lines) + "\n").encode())
    small_splits(1 << 20)
    want = spark.read.csv(str(tmp_path / "w.csv"), header=True, multiLine=True, quote='"', escape='"')
    # the unclosed last value ends without the line end of the file
    want = [tuple(v and v.rstrip("\n") for v in r) for r in want.collect() if any(v and v.strip() for v in r)]
    for size in (7, 31, 1 << 20):
        small_splits(size)
        found = read_csv(spark, str(tmp_path / "w.csv"), "," , "id string, a string, b string", file_order=True)
        got = [(r.id, r.a, r.b) for r in found.orderBy(*in_file_order()).collect()]
        assert got == want, size


def test_lines_with_an_open_value():
    for line, outside, inside in [
        (b"a,b", False, True), (b'a,"b', True, False), (b'a,"b"', False, False), (b'"a""', True, False),
        (b'5" x', False, False), (b'x"', False, False), (b'x",y', False, False), (b'x","y', True, True),
        (b'""', False, True), (b'a,""""', False, True), (b'', False, True),
    ]:
        assert (ends_inside(line, False, b","), ends_inside(line, True, b",")) == (outside, inside), line
    assert ends_inside(b'a||"b', False, b"||") and not ends_inside(b'a|"b', False, b"||")


def test_states_of_splits(spark, tmp_path, small_splits):
    (tmp_path / "s.csv").write_text('a,b\n1,"x\n' + "y\n" * 30 + 'z"\n2,w\n')
    small_splits(10)
    splits = scan_splits(raw_lines(spark, str(tmp_path / "s.csv")), ",").collect()
    states = start_states(splits)
    assert len(splits) > 4 and sum(inside for inside, _ in states.values()) >= len(splits) - 3
    assert {owner for inside, owner in states.values() if inside} == {0}


def test_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,id\n30,3\n")
    (tmp_path / "c.csv").write_text('id,note,x\n5,"two\nlines",50\n')
    (tmp_path / "d.csv").write_text('\nnote,id\n"more\nlines",7\n')
    got = {r.id: (r.x, r.note) for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: (2, None), 3: (30, None), 5: (50, "two\nlines"), 7: (None, "more\nlines")}
    assert header_names("a,,a,A,a0", ",") == ["a0", "_c1", "a2", "A3", "a0_"]


def test_returns_alone_end_lines_too(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b'id,t\r1,"a\rb"\r2,c\r')
    (tmp_path / "n.csv").write_bytes(b'id,t\n3,"a\nb"\n')
    assert {r.id: r.t for r in read_csv(spark, str(tmp_path)).collect()} == {1: "a\nb", 2: "c", 3: "a\nb"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "e.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "p")).count() == 0


def test_blank_separated_headers_and_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id  score\n1 10\n2   20\n")
    (tmp_path / "b.txt").write_text("score id note\n30 3 x\n40 4 y z\n")
    found = read_delimited(spark, str(tmp_path), file_order=True)
    rows = found.orderBy(*in_file_order()).collect()
    assert [(r.id, r.score, r.note, r.extra_fields) for r in rows] == [
        (1, 10, None, None), (2, 20, None, None), (3, 30, "x", []), (4, 40, "y", ["z"]),
    ]
    numbered = with_row_id(read_delimited(spark, str(tmp_path / "a.txt"), file_order=True), in_file_order())
    assert [r.id for r in numbered.orderBy("row_id").collect()] == [1, 2]


def test_variant_header_is_the_chrom_line(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#AUTHOR me\n#CHROM\tPOS\n1\t10\n")
    (tmp_path / "b.vcf").write_text("#CHROM\tPOS\n2\t20\n#CHROMATIC\n")
    assert {r.CHROM: r.POS for r in read_vcf(spark, str(tmp_path)).collect()} == {1: 10, 2: 20}
    (tmp_path / "c.vcf").write_text("#AUTHOR me\n1\t10\n")
    with pytest.raises(ValueError, match="c.vcf"):
        read_vcf(spark, str(tmp_path))


def test_empty_files_have_a_type(spark, tmp_path):
    for name in ("e.csv", "my e.TSV", "plain"):
        (tmp_path / name).write_text("")
    (tmp_path / "full.csv").write_text("a,b\n1,2\n")
    found = {r.path.rsplit("/", 1)[-1]: r.file_type for r in detect_file_types(spark, str(tmp_path)).collect()}
    assert found == {"e.csv": "tabular", "my%20e.TSV": "tabular", "plain": "unknown", "full.csv": "tabular"}


def test_dates_of_workbooks():
    assert [_shows_dates(c) for c in ("yyyy-mm-dd", "General", '0.0" days"', "[Red]0.00", "[h]:mm", "#,##0", r"dd\.mm", "@", "0_d")] == [
        True, False, False, False, True, False, True, False, False
    ]
    assert _date_text("44562", False) == "2022-01-01" and _date_text("44562.5", False) == "2022-01-01 12:00:00"
    assert _date_text("1", False) == "1900-01-01" and _date_text("61", False) == "1900-03-01"
    assert _date_text("0", True) == "1904-01-01" and _date_text("0.25", False) == "06:00:00"
    assert _date_text("-3", False) == "-3" and _date_text("x", False) == "x" and _date_text("1e9", False) == "1e9"


def test_names_of_columns_are_free():
    frame = pd.DataFrame({"path": "b", "column_index": [4, 1, 2, 3, 5], "_given": ["A", "a", "a", "a_2", "b"]})
    assert _free_names(frame)["_name"].tolist() == ["a", "a_3", "a_2", "A_4", "b"]


def test_json_and_tables_in_file_order(spark, tmp_path):
    lines = "".join('{"id": %d}\n' % (i * 7 % 50) for i in range(50))
    (tmp_path / "a.json").write_text(lines)
    (tmp_path / "b.json").write_text("[" + ",".join('{"id": %d}' % i for i in (103, 101, 102)) + "]")
    (tmp_path / "c.tsv").write_text("id\tv\n2\tx\n1\ty\n")
    found = read_json(spark, str(tmp_path / "*.json"), file_order=True)
    assert [r.id for r in found.orderBy(*in_file_order()).collect()] == [i * 7 % 50 for i in range(50)] + [103, 101, 102]
    found = read_table(spark, str(tmp_path / "c.tsv"), file_order=True)
    assert [r.id for r in found.orderBy(*in_file_order()).collect()] == [2, 1]
