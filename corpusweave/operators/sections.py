"""Section trees of HTML: one pass over the tags of a page with an explicit stack, in Arrow batches.

Nodes are the page itself, its sectioning elements (ELEMENTS) and headings. A heading opens a section that ends before the next
heading of its rank or a higher one, or with the element around it. A node's text is what stands in it outside deeper nodes
and outside SILENT elements and comments, character references decoded (all of HTML's, unless `decode` says otherwise), white space of HTML folded. End tags close the nearest open element of
their name with all inside it; those without an open one are passed over; what is open at the end closes there.

Defined cases: a null or empty page is one node without text; tags in any case, attributes with quotes; an open comment or silent
element runs to the end. Nesting is bounded by memory only: nothing recurses.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = frozenset({"article", "aside", "footer", "header", "main", "nav", "section"})
SILENT = ("script", "style", "title")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_HEADING = re.compile(r"h[1-6]\Z")
_BLANK = re.compile(r"[ \t\n\f\r]+")
SCHEMA = "node int, parent int, depth int, tag string, title string, text string, start int, stop int"


def section_tree(page: str | None, decode: Callable[[str], str] = html.unescape) -> list[tuple]:
    """(node, parent, depth, tag, title, text, start, stop) in order of their begin; start and stop are code points of the page."""
    page = page or ""
    nodes = [[None, 0, "page", [], [], 0, len(page)]]  # parent, depth, tag, title, text, start, stop
    stack = [0]  # open nodes
    at, inside = 0, None  # inside: a heading whose title is being read

    def say(text: str) -> None:
        nodes[stack[-1]][3 if inside is not None else 4].append(text)

    def close(down_to: int, stop: int) -> None:
        while len(stack) > down_to:
            nodes[stack.pop()][6] = stop

    def open_(tag: str, start: int) -> None:
        nodes.append([stack[-1], len(stack), tag, [], [], start, len(page)])
        stack.append(len(nodes) - 1)

    while (m := _TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        end, tag = m[1] == "/", m[2].lower()
        if tag in SILENT and not end:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = shut.end() if shut else len(page)
        elif _HEADING.match(tag):
            if end:
                if inside is not None:
                    inside = None
            else:
                # Sections of the same element with this rank or a lower one end here.
                keep = len(stack)
                while _HEADING.match(nodes[stack[keep - 1]][2]) and nodes[stack[keep - 1]][2] >= tag:
                    keep -= 1
                close(keep, m.start())
                open_(tag, m.start())
                inside = tag
        elif tag in ELEMENTS:
            inside = None
            if not end:
                open_(tag, m.start())
            else:
                place = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]][2] == tag), None)
                if place is not None:
                    close(place, m.end())
        else:
            say(" ")
    say(page[at:])
    folded = lambda parts: _BLANK.sub(" ", decode("".join(parts))).strip(" ")
    return [(i, parent, depth, tag, folded(title), folded(text), start, stop) for i, (parent, depth, tag, title, text, start, stop) in enumerate(nodes)]


def section_rows(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", decode: Callable[[str], str] = html.unescape) -> DataFrame:
    """id and the columns of section_tree(), one row for each node of each page. decode: what titles and texts pass through."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [section_tree(t, decode) for t in batch.column(1).to_pylist()]
            of = pa.array([i for i, t in enumerate(trees) for _ in t], pa.int64())
            cells = list(zip(*(n for t in trees for n in t))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *(pa.array(c, k) for c, k in zip(cells, kinds))], ["id", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")
