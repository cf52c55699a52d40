from .sequence import indexed_records, sequence, sequence_stream
from .slices import land_slices, open_slices
from .tables import events_as_sequence, events_keyed, table

__all__ = [
    "events_as_sequence",
    "events_keyed",
    "indexed_records",
    "land_slices",
    "open_slices",
    "sequence",
    "sequence_stream",
    "table",
]
