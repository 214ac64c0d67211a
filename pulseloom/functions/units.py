"""Units of literals: times become microseconds, rates hertz."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable

TIME_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
RATE_HZ = {"Hz": 1.0, "kHz": 1e3, "1/s": 1.0, "1/ms": 1e3, "mHz": 1e-3}


def micros(value: float, unit: str = "s") -> int:
    """A time as whole microseconds."""
    if unit not in TIME_US:
        raise ValueError(f"{unit} is not a unit of time")
    return round(value * TIME_US[unit])


def hertz(value: float, unit: str = "Hz") -> float:
    if unit not in RATE_HZ:
        raise ValueError(f"{unit} is not a unit of rate")
    return value * RATE_HZ[unit]


def is_time(unit: str | None, allow_none: bool = False) -> bool:
    return allow_none if unit is None else unit in TIME_US


def same_units(units: list[str]) -> bool:
    """Whether all are one unit; raises for what is no unit of time or rate."""
    for unit in units:
        if unit not in TIME_US and unit not in RATE_HZ:
            raise ValueError(f"{unit} is not a unit")
    return len(set(units)) <= 1


def renamed_arguments(**names: str) -> Callable:
    """A decorator: arguments may be given by older names (older=newer), with a warning; both names raise."""

    def around(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*args, **kwargs):  # noqa: ANN002, ANN003, ANN202
            for old, new in names.items():
                if old in kwargs:
                    if new in kwargs:
                        raise TypeError(f"{old} and {new} are the same argument")
                    warnings.warn(f"{old} is now called {new}", DeprecationWarning, stacklevel=2)
                    kwargs[new] = kwargs.pop(old)
            return fn(*args, **kwargs)

        return call

    return around
