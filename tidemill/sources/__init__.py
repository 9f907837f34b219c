"""Tables: Parquet and pipe-delimited text in, Parquet and printed rows out."""

from .tables import TABLES, import_tbl, import_tbl_dir, load, print_records, register_views, shared_root, write

__all__ = ["TABLES", "import_tbl", "import_tbl_dir", "load", "print_records", "register_views", "shared_root", "write"]
