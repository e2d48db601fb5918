"""Row lists, missing values, roles, profiles and segments."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import by, same_rows

from tamperlens.functions.columns import missing_columns, normalize_missing, numeric_columns, require_columns
from tamperlens.operators.profile import (
    column_profile,
    frame_profile,
    listed_values,
    review_candidates,
    schema_table,
    suspicion_summary,
    suspicious_columns,
)
from tamperlens.operators.rows import (
    column_roles,
    flag_rows,
    head_sample,
    parse_row_spec,
    preview_columns,
    random_sample,
    rows_frame,
    split_suspicious,
)
from tamperlens.operators.segments import (
    assign_segments,
    extract_response_json,
    report_findings,
    segment_apply,
    segment_bounds,
    segment_describe,
    segment_report,
    segment_rollup,
    segment_types,
)

NAN = float("nan")


# --- rows -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("spec", "rows"),
    [
        ("12, 45-50, 78", [12, 45, 46, 47, 48, 49, 50, 78]),
        ("5-3", []),
        ("x,7", [7]),
        ("-5", []),
        ("1-2-3", []),
        ("3, 3, 2-4", [2, 3, 3, 3, 4]),
        (" 8 - 9 ", [8, 9]),
        ("", []),
        ("1.5", []),
    ],
)
def test_row_spec(spark, spec, rows):
    found = parse_row_spec(spark.createDataFrame([(spec,)], "s string"), "s")
    assert sorted(r["row_index"] for r in found.collect()) == rows


def test_long_row_range(spark):
    found = parse_row_spec(spark.createDataFrame([("10-350009",)], "s string"), "s")
    assert found.agg({"row_index": "sum"}).first()[0] == sum(range(10, 350010)) and found.count() == 350_000


def test_missing_values(spark):
    df = spark.createDataFrame([(1, NAN, 2.0, "x"), (2, None, NAN, None)], "i int, a double, b double, s string")
    rows = normalize_missing(df).orderBy("i").collect()
    assert [r["a"] for r in rows] == [None, None] and [r["b"] for r in rows] == [2.0, None]
    assert [r["b"] for r in normalize_missing(df, ["a"]).orderBy("i").collect()][1] != 2.0


def test_column_selection(spark):
    df = spark.createDataFrame([], "id int, g string, a double, b decimal(5,2), c boolean, d date")
    assert numeric_columns(df) == ["id", "a", "b", "c"]
    assert numeric_columns(df, exclude=["id"], prioritize=["c", "zz", "b"]) == ["c", "b", "a"]
    assert numeric_columns(df, ["b", "g", "a"]) == ["b", "a"]
    assert missing_columns(df, ["x", "a", "y"]) == ["x", "y"]
    with pytest.raises(ValueError, match="x, y"):
        require_columns(df, ["x", "a", "y"])


def test_suspicious_split(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    parts = {k: sorted(r[0] for r in v.collect()) for k, v in split_suspicious(df, [2, 2, 7, 99]).items()}
    assert parts["suspicious_only"] == [2, 7]
    assert parts["without_suspicious"] == [0, 1, 3, 4, 5, 6, 8, 9] and len(parts["full_dataset"]) == 10
    flagged = flag_rows(df, rows_frame(spark, [2, 7])).filter("is_suspicious").count()
    assert flagged == 2


def test_roles_and_preview(spark):
    df = spark.createDataFrame([], "Case_No int, score double, group_a string, treatment string, grouping string, note string, extra int")
    found = by(column_roles(df).collect(), "column")
    assert found["Case_No"]["is_id"] and found["score"]["is_outcome"] and found["treatment"]["is_group"]
    assert not any(found["note"][f"is_{r}"] for r in ("id", "group", "outcome"))
    assert preview_columns(df, "duplicate_id") == ["Case_No", "score", "group_a", "treatment"]
    assert preview_columns(df, "excel_movement") == ["Case_No", "group_a", "treatment", "score"]
    assert preview_columns(df, "statistical_anomaly", ["extra"]) == ["Case_No", "extra"]
    assert preview_columns(df, "sorting_anomaly", ["group_a"]) == ["Case_No", "group_a"]
    plain = spark.createDataFrame([], "a int, b int, c int, d int, e int, f int")
    assert preview_columns(plain, "sorting_anomaly") == ["a", "b", "c", "d", "e"]


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    assert [r[0] for r in head_sample(df, 4).collect()] == [0, 1, 2, 3]
    once = random_sample(df, 50, seed=3, key=["row_id"])
    again = random_sample(df.repartition(7), 50, seed=3, key=["row_id"])
    assert same_rows(once, again) and once.distinct().count() == 50
    assert not same_rows(once, random_sample(df, 50, seed=4, key=["row_id"]))
    assert random_sample(df, 5000).count() == 1000


def test_listed_rows_travel_as_bits(spark):
    """F8: the table stays where it is, whatever the number of listed rows."""
    from tamperlens.plans.limits import Limits

    df = spark.range(-70, 20_000).selectExpr("id AS row_id", "id * 2 AS v").unionAll(
        spark.sql("SELECT CAST(NULL AS BIGINT), 1L")
    )
    listed = spark.range(-70, 30_000, 3).selectExpr("if(id = 2, NULL, id) AS row_index")
    listed = listed.unionAll(listed.limit(40))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = flag_rows(df, listed)
        assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
        many = flag_rows(df, listed, limits=Limits(mark_blocks=0))
        assert sorted(many.collect(), key=repr) == sorted(marked.collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = {r for r in range(-70, 20_000, 3) if r != 2}
    rows = marked.collect()
    assert len(rows) == 20_071 and {r.row_id for r in rows if r.is_suspicious} == want


# --- profiles -------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, float(i % 4), "ab"[i % 2], None if i % 5 == 0 else NAN if i % 5 == 1 else 1.0, True) for i in range(40)]
    rows.append((40, -0.0, None, 1.0, None))
    return spark.createDataFrame(rows, "id bigint, q double, s string, m double, flag boolean")


def test_column_profile(spark, mixed, tiny):
    found = by(column_profile(mixed).collect(), "column")
    assert found["id"]["unique_count"] == 41 and found["id"]["uniqueness_ratio"] == 1
    assert found["q"]["unique_count"] == 4  # negative zero is zero
    assert found["s"]["unique_count"] == 3 and found["s"]["non_null_count"] == 40  # NULL is a value
    assert found["s"]["uniqueness_ratio"] == pytest.approx(3 / 40) and found["s"]["mean"] is None
    assert found["m"]["unique_count"] == 2 and found["m"]["non_null_count"] == 25  # NaN is NULL
    assert found["id"]["median"] == 20 and found["q"]["max"] == 3
    assert found["flag"]["is_numeric"] and not found["s"]["is_numeric"]
    assert same_rows(column_profile(mixed), column_profile(mixed, limits=tiny))
    assert {r["column"] for r in review_candidates(column_profile(mixed)).collect()} == {"id"}


def test_profile_of_all_types_meets_each_value_once(spark, tiny, monkeypatch):
    """medians come from the counted values, whatever the type, not from the cells."""
    from tamperlens.operators import profile

    kinds = {
        "t": "CAST(v AS TINYINT)", "i": "CAST(v AS INT)", "b": "9007199254740992L + v", "f": "CAST(v / 3 AS FLOAT)",
        "d": "if(v = 0, -0.0D, if(v = 3, double('NaN'), v / 7D))", "n": "CAST(v AS DECIMAL(20,2)) / 4", "o": "v % 2 = 0",
        "day": "date_add(DATE'2024-02-27', v)", "at": "TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,v)",
        "ntz": "TIMESTAMP_NTZ'2024-01-01' + make_interval(0,0,0,0,v)", "s": "concat('x', v)", "none": "CAST(NULL AS INT)",
    }
    cells = spark.range(1200).selectExpr("if(id % 13 = 12, NULL, CAST(id % 13 AS INT)) AS v")
    df = cells.selectExpr(*[f"{sql} AS `{name}`" for name, sql in kinds.items()])
    given, real = [], profile.grouped_quantiles

    def spy(rows, *args):
        given.append(rows.filter("value IS NOT NULL AND `column` NOT IN ('n', 'o')").count())
        return real(rows, *args)

    monkeypatch.setattr(profile, "grouped_quantiles", spy)
    plain = column_profile(df)
    assert given == [12 * 4 + 11]
    assert same_rows(plain, column_profile(df, limits=tiny))
    found = by(plain.collect(), "column")
    text = df.selectExpr(*[f"CAST({'nanvl(d, NULL) + 0D' if c == 'd' else f'`{c}`'} AS STRING) AS `{c}`" for c in df.columns])
    for c, rows in {c: [r[0] for r in text.select(f"`{c}`").collect()] for c in df.columns}.items():
        known = [r for r in rows if r is not None and r != "NaN"]
        want = (len(set(known)) + (len(known) < len(rows)), len(rows), len(known))
        assert (found[c]["unique_count"], found[c]["total_count"], found[c]["non_null_count"]) == want, c
    for c in ("t", "i", "b", "f", "d", "n", "o"):
        value = f"CAST(`{c}` AS DOUBLE)" if c != "d" else "nullif(d, double('NaN'))"
        want = df.selectExpr(f"percentile({value}, 0.5D)", f"avg({value})", f"min({value})", f"max({value})", f"stddev_samp({value})").first()
        got = [found[c][n] for n in ("median", "mean", "min", "max", "std")]
        assert got == pytest.approx(list(want)), c
    assert [found["none"][n] for n in ("unique_count", "median", "mean", "std")] == [1, None, None, None]


def test_column_profile_with_values(mixed):
    found = by(column_profile(mixed, ["s", "id"], with_values=True).collect(), "column")
    assert found["s"]["values"] == ["nan", "a", "b"] and found["s"]["unique_count"] == 3
    assert found["id"]["is_sampled"] and found["id"]["median"] == 20


def test_profile_of_text_and_of_nothing(spark, mixed):
    text = column_profile(mixed, ["s"]).collect()[0]
    assert text["median"] is None and text["total_count"] == 41
    empty = by(column_profile(mixed.limit(0)).collect(), "column")
    assert empty["q"]["unique_count"] == 0 and empty["q"]["uniqueness_ratio"] is None


def test_listed_values(spark, mixed):
    found = by(listed_values(mixed).collect(), "column")
    assert found["s"]["values"] == ["nan", "a", "b"] and not found["s"]["is_sampled"]
    assert len(found["id"]["values"]) == 20 and found["id"]["is_sampled"]
    assert found["q"]["values"] == ["0.0", "1.0", "2.0", "3.0"]
    assert same_rows(listed_values(mixed), listed_values(mixed.repartition(9)))


def test_rating_summary(spark):
    ratings = spark.createDataFrame(
        [("a", 6, 10), ("b", 9, 20), ("c", 7, 30), ("d", None, 40)],
        "column string, suspicion_rating int, unique_count bigint",
    )
    assert [r["column"] for r in suspicious_columns(ratings).collect()] == ["b", "c"]
    one = suspicion_summary(ratings).first()
    assert (one["total_columns_analyzed"], one["suspicious_columns"], one["average_suspicion"]) == (4, 2, 5.5)


def test_frame_profile(mixed):
    found = by(frame_profile(mixed).collect(), "column")
    assert found["m"]["null_count"] == 16 and found["id"]["null_count"] == 0
    assert found["s"]["row_count"] == 41 and found["s"]["column_count"] == 5
    assert [(r["column"], r["dtype"]) for r in schema_table(mixed).orderBy("position").collect()][:2] == [
        ("id", "bigint"),
        ("q", "double"),
    ]


# --- segments -------------------------------------------------------------


@pytest.mark.parametrize(
    ("total", "size", "chunks", "covered"),
    [(30, 50, 1, 30), (1000, 500, 2, 1000), (1009, 100, 10, 1000), (4999, 499, 10, 4990), (7000, 500, 10, 5000)],
)
def test_segment_sizes(spark, total, size, chunks, covered):
    df = spark.range(total).withColumnRenamed("id", "row_id")
    found = segment_bounds(assign_segments(df)).orderBy("chunk").collect()
    assert sum(r["n"] for r in found) == total
    assert found[0]["rows"] == f"0-{min(size, total)}"
    first = segment_bounds(assign_segments(df, max_chunks=10)).collect()
    assert len(first) == chunks and sum(r["n"] for r in first) == covered


def test_segment_describe_and_apply(spark):
    df = spark.range(1200).selectExpr("id AS row_id", "cast(id AS double) AS v", "'x' AS s")
    segments = assign_segments(df)
    found = by(segment_describe(segments).collect(), "chunk", "column")
    first = pd.Series(range(120), dtype=float).describe()
    assert found[(1, "v")]["q25"] == first["25%"] and found[(1, "v")]["std"] == pytest.approx(first["std"])

    def scorer(pdf):
        if pdf["row_id"].min() == 240:
            raise RuntimeError("boom")
        return pd.DataFrame({"total": [pdf["v"].sum()]})

    scored = by(segment_apply(segments, scorer, "total double").collect(), "chunk")
    assert scored[1]["total"] == sum(range(120)) and scored[1]["error"] is None
    assert scored[3]["error"] == "boom" and scored[3]["total"] is None and scored[3]["rows"] == "240-360"


RESPONSES = [
    (1, 'Sure!\n{"anomalies_detected": true, "confidence": 8, "explanation": "e", "findings": '
        '[{"type": "t1", "severity": 5, "row_indices": [1, 2], "columns_involved": ["a"]}, {"type": "t2"}]}\nBye'),
    (2, '{"anomalies_detected": true, "confidence": 6, "findings": [{"type": "t3"}]}'),
    (3, '{"anomalies_detected": false, "confidence": 9}'),
    (4, '{"anomalies_detected": tru'),
    (5, "no json here " * 200),
    (6, '{"anomalies_detected": true, "confidence": "7", "findings": [{"type": "t1", "row_indices": '
        "[1,2,3,4,5,6,7,8,9,10,11,12]}]}"),
    (7, "[1, 2]"),
    (8, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return extract_response_json(spark.createDataFrame(RESPONSES, "chunk int, response string"))


def test_responses(parsed):
    found = by(parsed.collect(), "chunk")
    assert found[1]["anomalies_detected"] and found[1]["confidence"] == 8 and len(found[1]["findings"]) == 2
    assert found[3]["findings"] is None and found[3]["error"] is None
    for chunk in (4, 5, 7, 8):
        assert found[chunk]["error"] and not found[chunk]["anomalies_detected"]
    assert len(found[5]["raw_response"]) > 1003
    assert found[4]["raw_response"] == '{"anomalies_detected": tru'


def test_rollups(parsed):
    one = segment_rollup(parsed).first()
    assert (one["anomaly_chunks"], one["total_anomalies"], one["total_chunks"]) == (2, 3, 8)
    assert one["anomaly_types"] == 2
    assert sorted(r["type"] for r in segment_types(parsed).collect()) == ["t1", "t2"]
    report = segment_report(parsed).first()
    assert tuple(report) == (8, 4, 3, 2)


def test_reported_findings(parsed):
    found = by(report_findings(parsed).collect(), "chunk", "finding")
    assert found[(1, 1)]["rows_affected"] == "1, 2" and found[(1, 1)]["columns_involved"] == "a"
    assert found[(1, 2)]["rows_affected"] is None and found[(1, 2)]["severity"] == "N/A"
    assert found[(6, 1)]["rows_affected"] == "1, 2, 3, 4, 5, ... (2 more rows) ..., 8, 9, 10, 11, 12"
    assert found[(6, 1)]["columns_involved"] == "Unknown"
