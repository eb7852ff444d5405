"""CSV ingest: round trip, FAILFAST all-or-nothing, quarantine of malformed rows."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from revlens import operators as ops
from revlens.sources import load_csv, load_table, save_raw, sales_table, varchar_violations, write_csv


def _tmp():
    return tempfile.mkdtemp(prefix="revlens-test-")


def test_csv_round_trip(spark, sf_small):
    raw = sales_table(spark, sf_small)
    path = os.path.join(_tmp(), "sales_csv")
    write_csv(raw, path)
    back = load_csv(spark, path)
    assert back.schema == raw.schema
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    assert ops.load_profile(back).first() == ops.load_profile(raw).first()


def test_save_raw_overwrites(spark, sf_small):
    raw = sales_table(spark, sf_small)
    path = os.path.join(_tmp(), "saas_sales")
    save_raw(raw.limit(5), path)
    save_raw(raw.limit(7), path)
    assert spark.read.parquet(path).count() == 7
    save_raw(raw.limit(3), "revlens_test_saas_sales")
    save_raw(raw.limit(4), "revlens_test_saas_sales")
    assert spark.table("revlens_test_saas_sales").count() == 4


def _bad_csv():
    d = _tmp()
    header = (
        "row_id,order_id,order_date,date_key,contact_name,country,city,region,subregion,customer,customer_id,"
        "industry,segment,product,license,sales,quantity,discount,profit"
    )
    good = "1,O1,2023-01-05,20230105,Ann,Peru,Lima,AMER,South,acme,c1,Tech,SMB,alpha,L1,957.5775,2,0.1,10.5"
    bad = "2,O2,not-a-date,20230105,Bob,Peru,Lima,AMER,South,acme,c1,Tech,SMB,alpha,L1,abc,2,0.1,10.5"
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write("\n".join([header, good, bad]) + "\n")
    return d


def test_failfast_rejects_whole_load(spark):
    with pytest.raises(Exception):
        load_csv(spark, _bad_csv()).collect()


def test_quarantine_keeps_bad_rows_aside(spark):
    df = load_csv(spark, _bad_csv(), mode="quarantine")
    rows = df.collect()
    assert len(rows) == 2
    good = [r for r in rows if r._corrupt_record is None]
    assert len(good) == 1 and str(good[0].sales) == "957.58"  # rounded to NUMERIC(12,2) scale


def test_varchar_limits(spark, sf_small):
    raw = sales_table(spark, sf_small)
    assert varchar_violations(raw).count() == 0
    long_row = raw.limit(1).withColumn("region", F.lit("x" * 51))
    assert varchar_violations(long_row).count() == 1


HEADER = (
    "row_id,order_id,order_date,date_key,contact_name,country,city,region,subregion,customer,customer_id,"
    "industry,segment,product,license,sales,quantity,discount,profit"
)


def _written(rows):
    d = _tmp()
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write("\n".join([HEADER, *rows]) + "\n")
    return d


def _row(i, customer="acme", contact="Ann", profit="10.5"):
    return f"{i},O{i},2023-01-05,20230105,{contact},Peru,Lima,AMER,South,{customer},c1,Tech,SMB,alpha,L1,957.57,2,0.1,{profit}"


def test_copy_dialect_of_hand_written_file(spark):
    given = ['"say ""hi"" x"', '"Acme ""X"", Inc"', '"back\\"', "plain\\", '"a,b"', '""', ""]
    want = ['say "hi" x', 'Acme "X", Inc', "back\\", "plain\\", "a,b", "", None]
    table = load_table(spark, _written([_row(i, c) for i, c in enumerate(given)]), os.path.join(_tmp(), "t"))
    assert [r.customer for r in table.orderBy("row_id").collect()] == want
    path = _written([_row(0, '""'), _row(1, "")])
    both_null = load_table(spark, path, os.path.join(_tmp(), "t"), quoted_empty_as_null=True)
    assert [r.customer for r in both_null.collect()] == [None, None]


def test_written_csv_is_read_back_with_quotes_and_empty_text(spark, sf_small):
    path = _written([_row(0, '"a ""q"" \\ b"'), _row(1, '""'), _row(2, "")])
    raw = load_csv(spark, path)
    out = os.path.join(_tmp(), "again")
    write_csv(raw, out)
    assert sorted(map(str, load_csv(spark, out).collect())) == sorted(map(str, raw.collect()))


@pytest.mark.parametrize(
    "bad",
    [_row(1, profit="abc"), "1,O1,2023-01-05", _row(1, contact="x" * 101), _row(1).replace("2023-01-05", "2023-13-05")],
)
def test_load_is_all_or_nothing_whatever_column_is_bad(spark, bad):
    target = os.path.join(_tmp(), "t")
    with pytest.raises(Exception):
        load_table(spark, _written([_row(0), bad]), target)
    assert not os.path.exists(os.path.join(target, "_SUCCESS"))


def test_varchar_cuts_only_blanks(spark):
    table = load_table(spark, _written([_row(0, contact='"' + "x" * 100 + '   "')]), os.path.join(_tmp(), "t"))
    assert table.first().contact_name == "x" * 100


def test_load_check_is_gathered_by_the_load_itself(spark, sf_small, tmp_path):
    from pyspark.sql import Observation

    from revlens.operators import load_profile, nonpositive_sales, null_profile, raw_row_count
    from revlens.sources import load_table
    from revlens.sources.store import sales_csv

    source, seen = sales_csv(spark, sf_small), Observation("load")
    sc = spark.sparkContext
    sc.setJobGroup("observed", "observed")
    try:
        raw = load_table(spark, source, str(tmp_path / "raw"), metrics=seen)
        assert len(sc.statusTracker().getJobIdsForGroup("observed")) == 1  # the job that writes
        got = seen.get
        assert len(sc.statusTracker().getJobIdsForGroup("observed")) == 1
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    for check in (raw_row_count, load_profile, null_profile, nonpositive_sales):
        want = check(raw).first().asDict()
        assert {k: got[k] for k in want} == want


def test_load_check_of_an_empty_file(spark, tmp_path):
    from pyspark.sql import Observation

    from revlens.schema import RAW_SCHEMA
    from revlens.sources import load_table

    (tmp_path / "in.csv").write_text(",".join(RAW_SCHEMA.fieldNames()) + "\n")
    seen = Observation()
    assert load_table(spark, str(tmp_path / "in.csv"), str(tmp_path / "raw"), metrics=seen).count() == 0
    assert seen.get["total_rows"] == 0 and seen.get["earliest_order"] is None
