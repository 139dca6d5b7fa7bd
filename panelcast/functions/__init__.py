"""Column expressions: cleaning, date parsing, labels and formatting."""

from panelcast.functions.cleaning import clean_numeric_frame, detection_limit, nan_to_null
from panelcast.functions.dates import date_label, parse_any_timestamp, parse_day, parse_timestamp
from panelcast.functions.labels import clip_nonnegative, format_mean_sd, is_event, station_year

__all__ = [
    "clean_numeric_frame", "detection_limit", "nan_to_null", "date_label", "parse_any_timestamp",
    "parse_day", "parse_timestamp", "clip_nonnegative", "format_mean_sd", "is_event", "station_year",
]
