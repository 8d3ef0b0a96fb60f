"""The operators on streams, and jobs that run them."""

from .job import Job, Subscription
from .processors import debounce_stream, distinct_stream, folded_stream, join_stream, late_stream, lookup_stream, sample_stream, scan_stream, throttle_stream, timeout_stream, windows_stream

__all__ = [
    "Job", "Subscription", "debounce_stream", "distinct_stream", "folded_stream", "join_stream", "late_stream", "lookup_stream", "sample_stream", "scan_stream",
    "throttle_stream", "timeout_stream", "windows_stream",
]
