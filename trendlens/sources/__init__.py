"""Sources and sinks: CSV exports, map files, Parquet tables."""

from trendlens.sources.atlas import atlas_country_names, read_atlas, write_names
from trendlens.sources.csv import ingest_csv, read_csv, write_csv
from trendlens.sources.infer import cell_types, typed_by_cells
from trendlens.sources.rewrite import open_table, recover, rewrite_files
from trendlens.sources.tables import append_rows, replace_table, save_table, vacuum_table

__all__ = ["append_rows", "atlas_country_names", "cell_types", "ingest_csv", "open_table", "read_atlas", "read_csv", "recover",
           "replace_table", "rewrite_files", "save_table", "typed_by_cells", "vacuum_table", "write_csv", "write_names"]
