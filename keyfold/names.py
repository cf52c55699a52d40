"""Names shared by batch plans, streaming jobs and savepoints."""

# The identity of each operator. A savepoint is matched by these
# names, never by position or by a display name.
VALUE = "value_state"
REDUCING = "reducing_state"
AGGREGATING = "aggregating_state"
LIST = "list_state"
MAP = "map_state"

OPERATORS = (VALUE, REDUCING, AGGREGATING, LIST, MAP)
