"""Sources: Parquet tables, file trees and event logs as DataFrames."""

from loomdex.sources.tables import table

__all__ = ["table"]
