from .aggregating import ColumnAggregate, aggregating_state, sum_aggregate
from .histogram import histogram_parts, histogram_rows, nest_histogram
from .listing import list_parts, list_rows
from .reducing import COMBINERS, reducing_state, reducing_state_ordered
from .routing import route
from .value import running_value, value_state

__all__ = [
    "COMBINERS",
    "ColumnAggregate",
    "aggregating_state",
    "histogram_parts",
    "histogram_rows",
    "list_parts",
    "list_rows",
    "nest_histogram",
    "reducing_state",
    "reducing_state_ordered",
    "route",
    "running_value",
    "sum_aggregate",
    "value_state",
]
