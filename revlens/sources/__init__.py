"""Sources and sinks: star-schema mapping, CSV load, Parquet save, materialised fact."""

from revlens.sources.csv import load_csv, load_table, save_raw, varchar_violations, write_csv  # noqa: F401
from revlens.sources.star import read_table, star_sales  # noqa: F401
from revlens.sources.store import clean_table, csv_table, drop_tables, grain_table, sales_csv, sales_frame, sales_table  # noqa: F401
