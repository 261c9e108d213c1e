"""Typed specifications that replace the reference's YAML / dict configs."""

from __future__ import annotations

from dataclasses import dataclass, field


def unique(seq) -> tuple:
    """Order-preserving de-duplication (first occurrence wins)."""
    return tuple(dict.fromkeys(x for x in seq if x is not None))


@dataclass(frozen=True)
class StripTime:
    """Inclusive time range on the strftime-formatted timestamp.

    ``start``/``end`` are tuples handed to datetime/date/time, e.g. (2020, 1, 1) or (8, 30).
    """
    format: str
    start: tuple
    end: tuple


@dataclass(frozen=True)
class DatasetSpec:
    path: str
    target: tuple
    date: str
    features: tuple = ()
    segment: str | None = None
    delimiter: str = ","
    granularity: int = 1440          # minutes between grid steps
    file_name_as_feature: str | None = None
    has_header: bool = True
    strip_time: StripTime | None = None
    time_format: str | None = None   # optional explicit timestamp pattern
    name: str = "dataset"
    extension: str = ".csv"

    def __post_init__(self):
        if isinstance(self.target, str):
            object.__setattr__(self, "target", (self.target,))
        object.__setattr__(self, "features", tuple(self.features))

    @property
    def channels(self) -> tuple:
        """Features then targets, unique, order kept."""
        return unique([*self.features, *self.target])

    @property
    def used_columns(self) -> tuple:
        return unique([self.date, self.segment, *self.features, *self.target])


@dataclass(frozen=True)
class WindowSpec:
    lag: int
    ahead: int = 1
    offset: int = 1
    minutes: int = 1440
    ratios: tuple = field(default=(0.7, 0.1, 0.2))

    def __post_init__(self):
        if self.lag < 1 or self.ahead < 1:
            raise ValueError("lag and ahead must be >= 1")
        # X and Y never overlap: the offset is raised to ahead when smaller.
        if self.offset < self.ahead:
            object.__setattr__(self, "offset", self.ahead)

    @property
    def span(self) -> int:
        """Steps from the oldest input step to the anchor row."""
        return self.lag + self.offset - 1
