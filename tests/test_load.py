"""The load of CSV files into the raw table: its length check and how it stores its columns."""

import pyarrow.parquet as pq
import pytest

from revlens.schema import RAW_SCHEMA
from revlens.sources import load_table

HEADER = ",".join(RAW_SCHEMA.fieldNames())


def _csv(folder, order_ids):
    folder.mkdir()
    rows = [f"{i},{o},2023-01-05,20230105,Ann,Peru,Lima,AMER,South,acme,c1,Tech,SMB,alpha,L1,957.58,2,0.1,10.5" for i, o in enumerate(order_ids)]
    (folder / "part.csv").write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")
    return str(folder)


def test_lengths_are_counted_in_characters(spark, tmp_path):
    ids = ["ü" * 50, "\U0001f600" * 50, "é" * 49 + "   ", "a" * 50, "b" * 49 + "   "]
    got = load_table(spark, _csv(tmp_path / "in", ids), str(tmp_path / "t")).collect()
    assert sorted(r.order_id for r in got) == sorted(x[:50] for x in ids)


@pytest.mark.parametrize("long", ["ü" * 51, "a" * 51])
def test_longer_text_fails_the_load(spark, tmp_path, long):
    with pytest.raises(Exception, match="value too long"):
        load_table(spark, _csv(tmp_path / "in", ["O1", long]), str(tmp_path / "t"))


def test_loaded_rows_have_dictionaries_for_repeated_values_only(spark, tmp_path):
    load_table(spark, _csv(tmp_path / "in", [f"O{i}" for i in range(500)]), str(tmp_path / "t"))
    coded = set()
    for file in (tmp_path / "t").glob("*.parquet"):
        for g in range(pq.read_metadata(file).num_row_groups):
            group = pq.read_metadata(file).row_group(g)
            coded |= {group.column(i).path_in_schema for i in range(group.num_columns) if group.column(i).has_dictionary_page}
    assert "region" in coded and not coded & {"row_id", "order_id", "customer", "sales"}
