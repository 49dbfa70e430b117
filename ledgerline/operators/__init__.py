"""DataFrame-level operators shared by the reports."""

from .latest import asc_key, latest_per_key, sequence_per_key
from .asof import asof_prev_next
from .gaps import gaps
from .lists import list_rows, text_list_per_key
from .mode import mode_per_key
from .schedule import expand_periods
from .semi import semi_flag
from .literal import literal_table
from .packed import latest_per_key_packed, packed_order
from .eav import attribute_ids, eav_values

__all__ = [
    "asc_key", "latest_per_key", "sequence_per_key", "asof_prev_next", "gaps", "mode_per_key",
    "expand_periods", "semi_flag", "literal_table", "attribute_ids", "eav_values", "list_rows", "text_list_per_key",
    "latest_per_key_packed", "packed_order",
]
