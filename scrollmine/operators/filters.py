"""The optional filters of a keyword search, as one condition."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollmine.functions.paths import like_of_glob


@dataclass
class SearchOptions:
    """after: least date, inclusive, compared as text. project: part of the section's name. file_pattern: glob over the whole path."""

    after: str | None = None
    project: str | None = None
    file_pattern: str | None = None

    def condition(self, date: str = "date", section: str = "section", path: str = "file_path") -> Column:
        """Rows without a date or section fail a filter on it. LIKE here folds ASCII case alone."""
        parts = []
        if self.after is not None:
            parts.append(F.col(date) >= F.lit(self.after))
        if self.project is not None:
            parts.append(_like(F.col(section), f"%{self.project}%"))
        if self.file_pattern is not None:
            parts.append(_like(F.col(path), like_of_glob(self.file_pattern)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _like(column: Column, pattern: str) -> Column:
    escaped = pattern.replace("\\", "\\\\")
    return F.translate(column, _UPPER, _LOWER).like(escaped.translate(str.maketrans(_UPPER, _LOWER)))
