"""Reading tables, row ids, and writing reports."""

from .reports import store_cell, write_detail, write_summary
from .tables import as_text, load_csv, load_parquet, with_row_id

__all__ = ["as_text", "load_csv", "load_parquet", "store_cell", "with_row_id", "write_detail", "write_summary"]
