"""Plot-ready tables (Y12). Drawing is not built: these are the tidy rows a figure needs
(facet, x, series, y) and the shared axis range of a combined figure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_table(df: DataFrame, facets: Sequence[str], x: str, series: Sequence[str], y: str = "y",
                 series_name: str = "series") -> DataFrame:
    """One row per (facet..., x, series) with its value (narrow unpivot, no shuffle)."""
    return df.select(*facets, x, *series).unpivot([*facets, x], list(series), series_name, y)


def axis_bounds(table: DataFrame, figure: Sequence[str], y: str = "y") -> DataFrame:
    """Common y range of every facet of a combined figure (ycommon)."""
    return table.groupBy(*figure).agg(F.min(y).alias("y_min"), F.max(y).alias("y_max"),
                                      F.count(y).alias("n_points"))
