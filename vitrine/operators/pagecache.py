"""Decoded pages by key, the most recently used ones, within a number of pages and of bytes. On the driver: pages are viewports, never datasets."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa

from vitrine.plans.projection import Projection
from vitrine.plans.window import RowWindow

MOST_PAGES = 8
MOST_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class PageKey:
    page: int
    projection: Projection


@dataclass(frozen=True)
class DataPage:
    key: PageKey
    window: RowWindow
    table: pa.Table
    byte_size: int

    @classmethod
    def of(cls, key: PageKey, window: RowWindow, table: pa.Table) -> DataPage:
        return cls(key, window, table, table.nbytes)


@dataclass(frozen=True)
class PageCacheLimits:
    max_pages: int = MOST_PAGES
    max_bytes: int = MOST_BYTES


class PageCache:
    def __init__(self, limits: PageCacheLimits | None = None) -> None:
        limits = limits or PageCacheLimits()
        self.limits = PageCacheLimits(max(1, limits.max_pages), limits.max_bytes)
        self._pages: OrderedDict[PageKey, DataPage] = OrderedDict()
        self.bytes = 0

    def __len__(self) -> int:
        return len(self._pages)

    def is_empty(self) -> bool:
        return not self._pages

    def get(self, key: PageKey) -> DataPage | None:
        if key in self._pages:
            self._pages.move_to_end(key)
        return self._pages.get(key)

    def remove(self, key: PageKey) -> None:
        if page := self._pages.pop(key, None):
            self.bytes -= page.byte_size

    def insert(self, page: DataPage) -> bool:
        """A page larger than all that may be held is refused; what was held under its key goes either way."""
        self.remove(page.key)
        if page.byte_size > self.limits.max_bytes:
            return False
        self._pages[page.key] = page
        self.bytes += page.byte_size
        while len(self._pages) > self.limits.max_pages or self.bytes > self.limits.max_bytes:
            _, oldest = self._pages.popitem(last=False)
            self.bytes -= oldest.byte_size
        return True
