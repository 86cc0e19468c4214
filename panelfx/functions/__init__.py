"""Column-level expressions (JVM-side, codegen-friendly)."""

from .agg import agg_expr, complete, strict_avg, strict_sum, window_agg
from .inference import ci_columns, z_from_p
from .ratio import (finite_or_null, is_inf, is_nan, is_outlier, null_if_negative, ratio,
                    sign_flag, zero_over_zero)
from .scalar import (DAY_EPOCH, clean_label, date_to_epoch_day, epoch_day_to_date, index_to_date,
                     iso_week, member_flag, parse_date, post_flag, relative_time, threshold_flag,
                     threshold_flags, week_start)

__all__ = [
    "agg_expr", "complete", "strict_avg", "strict_sum", "window_agg", "ci_columns", "z_from_p",
    "finite_or_null", "is_inf", "is_nan", "is_outlier", "null_if_negative", "ratio", "sign_flag",
    "zero_over_zero", "DAY_EPOCH", "clean_label", "date_to_epoch_day", "epoch_day_to_date",
    "index_to_date", "iso_week", "member_flag", "parse_date", "post_flag", "relative_time",
    "threshold_flag", "threshold_flags", "week_start",
]
