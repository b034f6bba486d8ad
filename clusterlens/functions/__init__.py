"""Column-level functions (built-in Spark expressions only)."""

from .numeric import null_sentinel, safe_div, signif
from .time import (hour_block, hour_label, hour_of, ntz_to_epoch, to_day, to_ts,
                   weekday, weekday_index)
from .tokens import has_empty_segment, quoted_tokens, strip_quotes, strip_ws

__all__ = [
    "signif", "null_sentinel", "safe_div", "to_ts", "ntz_to_epoch", "hour_of",
    "hour_label", "hour_block", "weekday", "weekday_index", "to_day",
    "quoted_tokens", "has_empty_segment", "strip_quotes", "strip_ws",
]
