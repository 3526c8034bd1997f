"""Once-only milestones on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def once_stream(events: DataFrame) -> DataFrame:
    """Each (install, name) passes once, ever.

    There is no watermark on purpose: one that expires would let a milestone pass
    again.  State grows with installs times names, not with events."""
    return events.dropDuplicates(["user_id", "event_type"])
