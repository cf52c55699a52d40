from .closed_form import expected_count, expected_sum
from .numbers import int_div
from .records import unwrap, wrap
from .text import (
    histogram_text,
    list_text,
    parse_histogram_rows,
    parse_list_rows,
    parse_payload_lines,
    parse_total_lines,
    scalar_text,
    state_line,
)

__all__ = [
    "expected_count",
    "expected_sum",
    "histogram_text",
    "int_div",
    "list_text",
    "parse_histogram_rows",
    "parse_list_rows",
    "parse_payload_lines",
    "parse_total_lines",
    "scalar_text",
    "state_line",
    "unwrap",
    "wrap",
]
