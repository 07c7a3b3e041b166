"""Ordered projections: root columns by index, each at most once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from vitrine.errors import ViewError


@dataclass(frozen=True)
class Projection:
    """Column indexes in the order asked for. Equality heeds the order."""

    indexes: tuple[int, ...]

    @classmethod
    def all(cls, columns: int) -> Projection:
        return cls(tuple(range(columns)))

    @classmethod
    def columns(cls, indexes: list[int] | tuple[int, ...], columns: int) -> Projection:
        """No index at all means every column."""
        if not indexes:
            return cls.all(columns)
        for at, index in enumerate(indexes):
            if not 0 <= index < columns:
                raise ViewError(f"column {index} is out of range: there are {columns} columns")
            if index in indexes[:at]:
                raise ViewError(f"column {index} is asked for twice")
        return cls(tuple(indexes))

    @property
    def file_order(self) -> tuple[int, ...]:
        """What a reader reads: without regard to the order asked for."""
        return tuple(sorted(set(self.indexes)))

    def names(self, names: list[str]) -> list[str]:
        return [names[i] for i in self.indexes]


def parse_columns(text: str | None, columns: int) -> Projection:
    """A comma-separated list of indexes; None is every column."""
    if text is None:
        return Projection.all(columns)
    found = []
    for item in (part.strip() for part in text.split(",")):
        if not item:
            raise ViewError("a column index is missing between commas")
        if not re.fullmatch(r"\+?[0-9]+", item):
            raise ViewError(f"{item!r} is no column index")
        if int(item) >= columns:
            raise ViewError(f"column {item} is out of range: there are {columns} columns")
        found.append(int(item))
    return Projection.columns(found, columns)
