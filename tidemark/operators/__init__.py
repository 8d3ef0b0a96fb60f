"""Operators on flows: each factory gives a function from flow to flow."""

from .joins import as_table, join_stream, join_table, join_table_state, upsert_table
from .keyed import buffer_count, distinct_until_changed, last_states, scan_op
from .rate import debounce, sample, throttle, timeout
from .stateless import assign_trace_id, fan_out, filter_op, flat_map, identity, key_by, map_op, map_payload, merge, skip, take, tap, validate
from .windows import assign_watermarks, session_window, sliding_window, tumbling_window

__all__ = [
    "as_table", "assign_trace_id", "assign_watermarks", "buffer_count", "debounce", "distinct_until_changed", "fan_out", "filter_op", "flat_map", "identity",
    "join_stream", "join_table", "join_table_state", "key_by", "last_states", "map_op", "map_payload", "merge", "sample", "scan_op", "session_window", "skip",
    "sliding_window", "take", "tap", "throttle", "timeout", "tumbling_window", "upsert_table", "validate",
]
