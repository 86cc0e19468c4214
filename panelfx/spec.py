"""PanelSpec: which columns identify a unit and which orders its series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class PanelSpec:
    """A long panel is unique on ``unit + (time,)``.

    Series operators are row-offset (the previous *row* of the unit, not the
    previous calendar step); use ``complete_panel`` first for calendar offsets.
    Windows partition by the unit only, so a task holds one unit's series --
    bounded by the length of the calendar, not by the size of the data.
    """

    unit: tuple[str, ...]
    time: str

    def __init__(self, unit, time: str):
        object.__setattr__(self, "unit", (unit,) if isinstance(unit, str) else tuple(unit))
        object.__setattr__(self, "time", time)

    @property
    def keys(self) -> list[str]:
        return [*self.unit, self.time]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.unit).orderBy(F.col(self.time))

    def frame(self, start: int, end: int) -> WindowSpec:
        return self.window().rowsBetween(start, end)

    def unit_window(self) -> WindowSpec:
        return Window.partitionBy(*self.unit)

    def unit_cols(self) -> list[Column]:
        return [F.col(c) for c in self.unit]

    def with_unit(self, *extra: str) -> "PanelSpec":
        """Same panel nested inside extra grouping keys (e.g. a cohort id)."""
        return PanelSpec((*extra, *self.unit), self.time)
