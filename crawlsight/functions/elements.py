"""A page's elements as a table with intervals, so that rules about nesting are joins.

One pass over a page gives each element two numbers, where it is entered and where it is
left, its depth and the number of its parent. An element contains another of its page if the
other's interval lies in its own. The rules of nesting are those of the page parser: void
elements never open, a closing tag pops to its nearest opening one, and what is open at the end
is left there.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .html import VOID, page_lots

ELEMENTS = "enter int, leave int, depth int, parent int, tag string, attributes map<string,string>"


class _Intervals(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.at = 0

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else None
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        self.rows.append([self.at, self.at + 1, len(self.open), None if parent is None else self.rows[parent][0], tag, given])
        self.at += 2 if tag in VOID else 1
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        # A slash closes nothing in HTML.
        self.handle_starttag(tag, attrs)

    def _leave(self):
        self.rows[self.open.pop()][1] = self.at
        self.at += 1

    def handle_endtag(self, tag):
        if any(self.rows[i][4] == tag for i in self.open):
            while self.rows[self.open[-1]][4] != tag:
                self._leave()
            self._leave()

    def close(self):
        super().close()
        while self.open:
            self._leave()


def elements(html: str) -> list[tuple]:
    """(enter, leave, depth, parent's enter, tag, attributes) of a page's elements, in order."""
    parser = _Intervals()
    parser.feed(html)
    parser.close()
    return [tuple(r) for r in parser.rows]


def element_table(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key and ELEMENTS) of pages with ``html``; a page without markup has no rows. A task holds the elements of one lot of pages."""
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    types = [pa.int32()] * 4 + [pa.string(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in page_lots(batch):
                trees = [elements(h or "") for h in lot.column("html").to_pylist()]
                keys = lot.column(key).take(pa.array([row for row, tree in enumerate(trees) for _ in tree], pa.int32()))
                columns = list(zip(*(e for tree in trees for e in tree))) or [()] * len(names)
                columns[-1] = [list(given.items()) for given in columns[-1]]
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns, types)], names=[key, *names])

    return pages.select(key, "html").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {ELEMENTS}")
