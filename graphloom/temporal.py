"""Read coordinates: valid time, tombstones and recorded time as Columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import TemporalError

MODES = ("current", "asOf", "includeEnded", "includeTombstones")
#: ``recorded_to`` of rows that are still open; the largest revision.
OPEN_REVISION = (1 << 53) - 1


def instant(value: str | dt.datetime) -> dt.datetime:
    """A UTC instant from a datetime or canonical text such as 2024-01-01T00:00:00.000Z."""
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%dT%H:%M:%S.%fZ")
    except ValueError as e:
        raise TemporalError(f"not a canonical UTC instant: {value}") from e


@dataclass(frozen=True)
class Coordinate:
    """What a read sees. ``now`` is pinned once, so that all parts of a query agree."""

    mode: str = "current"
    as_of: dt.datetime | None = None
    recorded: int | None = None
    now: dt.datetime | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise TemporalError(f"unknown temporal mode {self.mode}")
        if (self.as_of is not None) != (self.mode == "asOf"):
            raise TemporalError("as_of goes with mode asOf, and only with it")

    def pinned(self) -> Coordinate:
        return self if self.now else replace(self, now=dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def visible(self, prefix: str = "") -> Column:
        """Whether a row is seen, from its valid_from, valid_to and deleted_at."""
        c = lambda name: F.col(f"{prefix}{name}")
        if self.mode == "includeTombstones":
            return F.lit(True)
        live = c("deleted_at").isNull()
        if self.mode == "includeEnded":
            return live
        at = F.lit(self.as_of if self.mode == "asOf" else self.pinned().now)
        return live & (c("valid_from").isNull() | (c("valid_from") <= at)) & (c("valid_to").isNull() | (c("valid_to") > at))

    def recorded_filter(self) -> Column:
        if self.recorded is None:
            return F.lit(True)
        return (F.col("recorded_from") <= self.recorded) & (F.col("recorded_to") > self.recorded)
