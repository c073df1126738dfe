"""Where rows come from."""

from strata.sources.derby import DERBY, derby_table
from strata.sources.files import archive, jdbc, pending, read_file
from strata.sources.xlsx import XlsxSource, register, write_xlsx

__all__ = ["DERBY", "XlsxSource", "archive", "derby_table", "jdbc", "pending", "read_file", "register", "write_xlsx"]
