"""Row windows, and the fixed pages that a viewport scrolls through."""

from __future__ import annotations

from dataclasses import dataclass

from vitrine.errors import ViewError

PAGE_ROWS = 4096


@dataclass(frozen=True)
class RowWindow:
    first_row: int
    row_count: int

    @classmethod
    def for_page(cls, page: int, total: int) -> RowWindow:
        first = page * PAGE_ROWS
        return cls(first, max(0, min(PAGE_ROWS, total - first)))

    def clipped(self, total: int) -> RowWindow:
        """The part of it that there is. To start at the end is an empty window, to start past it an error."""
        if self.first_row < 0 or self.row_count < 0:
            raise ViewError("a window has neither a negative start nor a negative length")
        if self.first_row > total:
            raise ViewError(f"the window starts at row {self.first_row}, past the end: there are {total} rows")
        return RowWindow(self.first_row, min(self.row_count, total - self.first_row))

    @property
    def end(self) -> int:
        return self.first_row + self.row_count


@dataclass(frozen=True)
class FetchRequest:
    """A window and its projection in one."""

    first_row: int
    row_count: int
    projection: object
