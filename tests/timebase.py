from datetime import datetime, timezone

#: The start of the tests' event time.
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
