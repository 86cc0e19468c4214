"""panelfx: panel (unit x time) data preparation and effect estimation on Spark DataFrames."""

from .spec import PanelSpec

__version__ = "0.1.0"
__all__ = ["PanelSpec"]
