"""Reports as lines of Markdown, one row a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "—"


def table_row(*cells: Column) -> Column:
    """A line of a table; missing cells hold a dash."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit(GAP)) for c in cells)), F.lit(" |"))


def number(value: Column, places: int = 4) -> Column:
    """A number with so many places, null if it is null or not a number."""
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.format_string(f"%.{places}f", value.cast("double")))


def header(*names: str) -> str:
    return f"| {' | '.join(names)} |\n|{'---|' * len(names)}"


def percent_of(part: Column, whole: Column, what: str) -> Column:
    """A sentence such as "12 of 40 variants (30.0 %)"; nothing of nothing is 0 %."""
    share = F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)
    return F.format_string(f"%d of %d {what} (%.1f %%)", part.cast("long"), whole.cast("long"), share)
