"""Stored tables: one-step replacement, reuse by later sessions, incremental grain, constant driver calls."""

import datetime as dt
import os
import re
import shutil
import time
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from revlens import operators as ops
from revlens.plans import registry
from revlens.sources import grain, star, store, versions
from revlens.sources.store import clean_table, grain_table

GRAIN_KEYS = [k for k, (kind, _) in registry.CATALOG.items() if kind == registry.GRAIN]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def _folders(root):
    return {f for f in os.listdir(root) if not f.startswith(("_", "."))}


# ---- versions ----


def test_replacement_is_one_step(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None and versions.find(spark, root, "a") is None
    first = versions.replace(spark.range(10), root, "a")
    reader = spark.read.parquet(versions.current(spark, root)["path"])
    spark.range(3).write.parquet(f"{root}/v-unpublished")  # a load that died before it was published
    assert versions.find(spark, root, "a") == first and reader.count() == 10
    second = versions.replace(spark.range(20), root, "b")
    assert versions.find(spark, root, "a") is None and versions.find(spark, root, "b") == second
    assert reader.count() == 10 and spark.read.parquet(second).count() == 20  # the old reader keeps its rows
    assert versions.prune(spark, root) == 2 and _folders(root) == {os.path.basename(second)}
    assert versions.current(spark, root)["number"] == 2 and versions.publish(spark, root, {"path": second, "source": "b"})["number"] == 3
    versions.drop(spark, root)
    assert not os.path.exists(root)


def test_a_written_version_leaves_no_shuffle_files(spark, tmp_path):
    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return set(re.findall(r"shuffle_(\d+)_", blocks.mkString(" ")))

    before = shuffles()
    path = versions.replace(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "t"), "a")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.read.parquet(path).count() == 7


def test_a_manifest_number_is_given_once(spark, tmp_path):
    root = str(tmp_path / "t")
    made = [versions.publish(spark, root, {"path": str(i), "source": str(i)})["number"] for i in range(4)]
    assert made == [1, 2, 3, 4] and versions.current(spark, root)["source"] == "3"


def test_signature_sees_added_rewritten_and_removed_files(spark, tmp_path):
    folder = tmp_path / "t.parquet"
    folder.mkdir()
    seen = {versions.signature(spark, str(folder)), versions.signature(spark, str(tmp_path / "none"))}
    for i, (name, text) in enumerate([("a", "x"), ("b", "x"), ("b", "xy"), ("b", None)]):
        if text is None:
            (folder / name).unlink()
        else:
            (folder / name).write_text(text)
        os.utime(folder, (1000 + i, 1000 + i))  # times of one run may be equal
        seen.add(versions.signature(spark, str(folder)))
    assert len(seen) == 6


def test_signature_of_many_files_takes_a_fixed_number_of_calls(spark, tmp_path):
    for t in star.STAR_TABLES:
        (tmp_path / f"{t}.parquet").mkdir()
    for i in range(2000):
        (tmp_path / "lineitem.parquet" / f"part-{i}.parquet").write_text("x")
    store._source(spark, str(tmp_path))
    t = time.perf_counter()
    for _ in range(5):
        store._source(spark, str(tmp_path))
    assert (time.perf_counter() - t) / 5 < 0.2


# ---- stored tables ----


def test_a_second_session_writes_nothing(spark, sf_small, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_base", lambda spark: str(tmp_path / "revlens-tables"))
    saved = dict(store._TABLES)
    try:
        store._TABLES.clear()
        first = _rows(grain_table(spark, sf_small))
        before = {(d, f) for d, _, files in os.walk(tmp_path) for f in files}
        store._TABLES.clear()  # what a new session starts with
        assert _rows(grain_table(spark, sf_small)) == first
        assert clean_table(spark, sf_small).count() > 0
        assert {(d, f) for d, _, files in os.walk(tmp_path) for f in files} == before
        store.drop_tables(spark, sf_small)
        assert not _folders(tmp_path / "revlens-tables")
        assert _rows(grain_table(spark, sf_small)) == first
    finally:
        store._TABLES.clear()
        store._TABLES.update(saved)


def test_csv_export_is_small_and_loads_whole(spark, sf_small, monkeypatch):
    store.drop_tables(spark, sf_small)
    fact = store.sales_table(spark, sf_small)
    monkeypatch.setitem(store.CSV_OPTIONS, "maxRecordsPerFile", 500)  # several files with a header each
    export = store.sales_csv(spark, sf_small).removeprefix("file:")
    files = [f for f in os.listdir(export) if f.startswith("part-")]
    text = sum(map(len, spark.read.text(export).toPandas()["value"]))
    assert len(files) > fact.count() // 500 // 2
    assert sum(os.path.getsize(f"{export}/{f}") for f in files) < text / 2
    loaded = store.csv_table(spark, sf_small)
    assert _rows(loaded) == _rows(fact)


def test_rewritten_input_is_read_again(spark, sf_small, tmp_path):
    for t in star.STAR_TABLES:
        shutil.copy(f"{sf_small}/{t}.parquet", tmp_path / f"{t}.parquet")
    n = clean_table(spark, str(tmp_path)).count()
    lines = pq.read_table(f"{sf_small}/lineitem.parquet")
    pq.write_table(lines.slice(0, len(lines) // 2), tmp_path / "lineitem.parquet")
    assert 0 < clean_table(spark, str(tmp_path)).count() < n


# ---- grain ----


def _sales(spark, rows):
    schema = "customer_id string, customer string, segment string, region string, order_month date, sales decimal(12,2), product string"
    return spark.createDataFrame([(*r[:4], dt.date(2024, r[4], 1), Decimal(r[5]), "p") for r in rows], schema)


def test_only_new_files_are_read(spark, tmp_path):
    source, root = str(tmp_path / "clean"), str(tmp_path / "grain")
    day1 = [("C1", "A", "Smb", "Eu", 1, "10.10"), ("C1", "A", "Smb", "Eu", 1, "0.05"), ("C2", None, None, "Us", 2, "5.00")]
    day2 = [("C1", "A", "Smb", "Eu", 1, "1.00"), ("C1", "A2", "Smb", "Eu", 1, "2.00"), ("C2", None, None, "Us", 3, "7.00")]
    _sales(spark, day1).coalesce(1).write.parquet(source)
    assert len(grain.refresh(spark, source, root)) == 1
    assert grain.refresh(spark, source, root) == []  # nothing new: nothing written
    one = _folders(root)
    old = grain.grain(spark, root)
    _sales(spark, day2).coalesce(1).write.mode("append").parquet(source)
    first = versions.current(spark, root)["files"][0].replace("file:", "").replace("//", "")
    with open(first, "r+b") as f:  # an unreadable old file: it must not be opened again
        f.seek(-4, 2)
        f.write(b"XXXX")
    assert len(grain.refresh(spark, source, root)) == 1
    with open(first, "r+b") as f:
        f.seek(-4, 2)
        f.write(b"PAR1")
    got = {(r.customer_id, r.customer, r.order_month.month): r.sales for r in grain.grain(spark, root).collect()}
    assert got == {
        ("C1", "A", 1): Decimal("11.15"), ("C1", "A2", 1): Decimal("2.00"),
        ("C2", None, 2): Decimal("5.00"), ("C2", None, 3): Decimal("7.00"),
    }
    assert old.count() == 2 and one < _folders(root)  # a reader of the old version is not disturbed
    # a file that goes takes its sums with it: all parts are made anew
    os.remove(first)
    assert len(grain.refresh(spark, source, root)) == 1
    assert {r.sales for r in grain.grain(spark, root).collect()} == {Decimal("1.00"), Decimal("2.00"), Decimal("7.00")}
    versions.prune(spark, root)
    assert len(_folders(root)) == 2 and grain.grain(spark, root).count() == 3


def test_parts_are_merged_by_one_exchange(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    row = lambda c, name, sales: (c, name, "Smb", "Asia", day, Decimal(sales))
    columns = "customer_id string, customer string, segment string, region string, order_month date, sales decimal(12,2)"
    parts = []
    for k, rows in enumerate([[row("C1", "A", "1"), row("C2", "B", "2"), row(None, None, "5")], [row("C1", "A", "3"), row("C1", "Z", "4"), row(None, None, "6")]]):
        parts.append(str(tmp_path / f"p{k}"))
        grain.grain_of(spark.createDataFrame(rows, columns)).write.parquet(parts[-1])
    merged = grain._rows(spark, parts, 3)
    assert _plan(merged).count("Exchange hashpartitioning") == 1
    got = {(r.customer_id, r.customer): r.sales for r in merged.collect()}
    assert got == {("C1", "A"): 4, ("C1", "Z"): 4, ("C2", "B"): 2, (None, None): 11} and merged.count() == 4


def test_grain_of_no_sales(spark, tmp_path):
    source, root = str(tmp_path / "clean"), str(tmp_path / "grain")
    _sales(spark, []).write.parquet(source)
    grain.refresh(spark, source, root)
    assert grain.grain(spark, root).count() == 0
    with pytest.raises(ValueError):
        grain.grain(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("key", GRAIN_KEYS)
def test_queries_scan_the_grain_with_equal_results(spark, sf_small, key):
    _, op = registry.CATALOG[key]
    by_grain = registry.run(spark, sf_small, key)
    assert "revlens_grain_" in _plan(by_grain) or "customer_month-" in _plan(by_grain) or key == "customer_tiers_brief"
    assert _rows(by_grain) == _rows(registry.report(op(clean_table(spark, sf_small))))


@pytest.mark.parametrize("op", [ops.churn_status, ops.customer_running_revenue, ops.revenue_movement, ops.revenue_churn, ops.churned_revenue_list])
def test_customer_windows_need_no_exchange(spark, sf_small, op):
    plan = _plan(op(grain_table(spark, sf_small))).split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Window" in line)
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert any("Scan" in line for line in below) and not any("Exchange" in line for line in below)


def test_grain_keeps_one_row_per_name_and_month(spark, sf_small):
    g = grain_table(spark, sf_small)
    assert g.count() == g.select(*grain.GRAIN_KEYS).distinct().count()
    C = clean_table(spark, sf_small)
    assert g.agg(F.sum("sales")).first()[0] == C.agg(F.sum("sales")).first()[0]
