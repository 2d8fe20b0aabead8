"""Parsing of loosely typed cells: scalar-or-list strings, delimited lists, safe casts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, col

# Restriction levels by name.
LEVELS = {"vigilance": 1, "alerte": 2, "alerte_renforcee": 3, "crise": 4}


def string_list(cell: ColumnLike) -> Column:
    """A JSON list of strings, or a bare scalar as a one-element list; blank or broken JSON is an empty list."""
    cell = F.trim(col(cell))
    empty = F.array().cast("array<string>")
    return (
        F.when(cell.isNull() | (cell == ""), empty)
        .when(cell.startswith("["), F.coalesce(F.from_json(cell, "array<string>"), empty))
        .otherwise(F.array(cell))
    )


def known_levels(cell: ColumnLike, levels: Mapping[str, int] = LEVELS) -> Column:
    """Integer levels of the cell's known names; unknown names are dropped."""
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    ranks = F.transform(string_list(cell), lambda v: F.try_element_at(table, v))
    return F.filter(ranks, lambda r: r.isNotNull())


def severity_max(cell: ColumnLike, levels: Mapping[str, int] = LEVELS) -> Column:
    """Highest known level, 0 if the cell names none."""
    return F.coalesce(F.array_max(known_levels(cell, levels)), F.lit(0))


def item_count(cell: ColumnLike, sep: str = ",") -> Column:
    """Number of non-blank items of a delimited string; null counts 0."""
    items = F.filter(F.split(F.coalesce(col(cell), F.lit("")), sep), lambda v: F.trim(v) != "")
    return F.size(items)


def zip_lists(**lists: ColumnLike) -> Column:
    """Parallel lists to an array of structs, padded with null to the longest; explode with ``F.inline``."""
    return F.arrays_zip(*[col(c).alias(name) for name, c in lists.items()])


def zero_pad(code: ColumnLike, width: int = 2) -> Column:
    """Left zero padding that never truncates longer codes."""
    text = col(code).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def safe_double(c: ColumnLike) -> Column:
    return col(c).try_cast("double")


def safe_date(c: ColumnLike, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date") if fmt else col(c).try_cast("date")
