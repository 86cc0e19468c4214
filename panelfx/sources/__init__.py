"""Sources and sinks: CSV/parquet readers, stage writers, and the test-panel builder."""

from .io import (export_csv, read_csv, read_stage, read_table, read_wide_csv, stage_path,
                 write_stage)

__all__ = ["export_csv", "read_csv", "read_stage", "read_table", "read_wide_csv", "stage_path",
           "write_stage"]
