"""Readable text for durations, magnitudes and memory, as native columns.

Every function takes column names and builds one SQL expression: a whole report is
then a handful of calls into the JVM rather than hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, units and formats of the printed forms.
# A duration below the limit (ms) prints in the unit, which is the previous unit
# divided by the given number.
_DURATION_STEPS = (
    (100, "ms", "%d ms"),
    (1_000, "s", "%.1f s"),
    (60_000, "s", "%.0f s"),
    (600_000, "min", "%.1f min"),
    (3_600_000, "min", "%.0f min"),
    (None, "h", "%.1f h"),
)
_MAGNITUDES = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))
_BYTE_UNITS = ((1 << 40, "TB"), (1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"), (1, "B"))
STAMP_PATTERN = "yyyy/MM/dd HH:mm:ss"

# Unit lengths in ms, and which units a verbose duration shows.
_SECOND, _MINUTE, _HOUR, _DAY = 1_000, 60_000, 3_600_000, 86_400_000
_WEEK, _YEAR = 7 * _DAY, 365 * _DAY
_UNITS = {
    "second": (_SECOND, _MINUTE),
    "minute": (_MINUTE, _HOUR),
    "hour": (_HOUR, _DAY),
    "day": (_DAY, _WEEK),
    "week": (_WEEK, _YEAR),
    "year": (_YEAR, None),
}
_VERBOSE_STEPS = (
    (_SECOND, ("ms",)),
    (_MINUTE, ("second", "ms")),
    (_HOUR, ("minute", "second")),
    (_DAY, ("hour", "minute", "second")),
    (_WEEK, ("day", "hour", "minute")),
    (_YEAR, ("week", "day", "hour")),
    (None, ("year", "week", "day")),
)


def _name(column: str) -> str:
    return f"`{column}`"


def _case(value: str, steps: list[tuple[str | None, str]]) -> Column:
    """The text of the first condition that holds; null for a null value."""
    branches = [f"WHEN {value} IS NULL THEN NULL"]
    branches += [f"WHEN {condition} THEN {text}" for condition, text in steps if condition]
    return F.expr(f"CASE {' '.join(branches)} ELSE {steps[-1][1]} END")


def duration_text(column: str) -> Column:
    """Short text of a bigint duration in ms; limits apply to the unrounded value."""
    ms = _name(column)
    seconds = f"(cast({ms} AS double) / 1000)"
    in_unit = {"ms": ms, "s": seconds, "min": f"{seconds} / 60", "h": f"{seconds} / 60 / 60"}
    return _case(
        ms,
        [
            (limit and f"{ms} < {limit}", f"format_string('{form}', {in_unit[unit]})")
            for limit, unit, form in _DURATION_STEPS
        ],
    )


def _verbose_part(ms: str, unit: str) -> str:
    if unit == "ms":
        shown = f"concat({ms} % {_SECOND}, ' ms')"
        return f"if({ms} >= {_SECOND} AND {ms} % {_SECOND} = 0, '', {shown})"
    size, next_size = _UNITS[unit]
    count = f"({ms if next_size is None else f'{ms} % {next_size}'}) div {size}"
    return f"CASE {count} WHEN 0 THEN '' WHEN 1 THEN '1 {unit}' ELSE concat({count}, ' {unit}s') END"


def duration_text_verbose(column: str) -> Column:
    """The two or three largest units of a bigint duration in ms.

    A unit counts what the next larger unit leaves of the entire length, so days are
    those beyond whole weeks even where years are shown: 365 days are one year, one day.
    Units that are zero leave an empty part, and parts are joined by one space
    whether empty or not, so ``5 seconds `` and ``1 hour  5 seconds`` are intended.
    """
    ms = _name(column)
    return _case(
        ms,
        [
            (
                limit and f"{ms} < {limit}",
                f"concat_ws(' ', {', '.join(_verbose_part(ms, unit) for unit in units)})",
            )
            for limit, units in _VERBOSE_STEPS
        ],
    )


def magnitude_text(column: str) -> Column:
    """Number with K / M / B / T from two units on, else its integer part.

    Below the first unit the integer part is a 32-bit number; NaN shows as 0.
    """
    number = f"cast({_name(column)} AS double)"
    whole = f"cast(cast(greatest({number}, {-(2**31)}D) AS int) AS string)"
    return _case(
        number,
        [
            (f"isnan({number})", "'0'"),
            *[
                (f"{number} >= {2 * size:.0f}D", f"format_string('%.1f {unit}', {number} / {size:.0f}D)")
                for size, unit in _MAGNITUDES
            ],
            (None, whole),
        ],
    )


def memory_text(column: str) -> Column:
    """Memory in MB as text in the largest unit of which there are at least two."""
    size = f"(cast({_name(column)} AS bigint) * {1 << 20})"
    return _case(
        size,
        [
            (
                unit != "B" and f"{size} >= {2 * unit_size}",
                f"format_string('%.1f {unit}', cast({size} AS double) / {unit_size})",
            )
            for unit_size, unit in _BYTE_UNITS
        ],
    )


def stamp_text(column: str) -> Column:
    """Instant as ``yyyy/MM/dd HH:mm:ss`` in the session time zone."""
    return F.date_format(column, STAMP_PATTERN)


def progress_label(completed: str, total: str, failed: str, skipped: str) -> Column:
    """``c/t (f failed) (s skipped)``; a bracket appears only for a count above 0."""

    def bracket(count: str, word: str) -> str:
        return f"if({_name(count)} > 0, format_string('(%d {word})', {_name(count)}), NULL)"

    counts = f"format_string('%d/%d', {_name(completed)}, {_name(total)})"
    return F.expr(
        f"concat_ws(' ', {counts}, {bracket(failed, 'failed')}, {bracket(skipped, 'skipped')})"
    )
