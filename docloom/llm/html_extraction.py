"""Main text by line-block distribution (operator 8).

Markup is stripped to lines, one for each block element.  The lengths of text
outside of links are summed over windows of ``WINDOW`` lines.  A surge point is
where the sum rises over ``SURGE`` and the next windows stay above zero, a dive
point where it falls to zero; text between them is kept, links too.  Without any
surge, the longest stretch counts as one.

* Lines of menus, headers, footers, sidebars, notices, adverts, forms and comments
  weigh nothing and are not kept.
* Names of classes and ids are held against the share of the page's text that an
  element has: no name alone empties a page but those of readers' comments.
* Where a page marks its article or main elements, the lines of each are summed on
  their own; one that has a surge is kept to its bounds, others are not.
* Elsewhere a stretch is carried on over the box (a div, say) that its text stands
  in, so that link lines and short lines at its ends are kept; ``MENU`` or more link
  lines in a row at either end are a menu and are not.

Null and empty pages have no text.  White space inside a block becomes one space.
Null ids stay null, repeated rows give repeated results, an empty table an empty
one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.llm.common import small_batches, table, with_fields
from docloom.llm.html_blocks import PAGE, Line, lines

WINDOW = 3
SURGE = 80
MENU = 3


def weights(page: list[Line]) -> list[int]:
    marked = any(x.mark and not x.aside for x in page)
    return [0 if x.aside or (marked and not x.mark) else max(0, len(x.text) - 2 * x.linked) for x in page]


def regions(weight: list[int]) -> list[tuple[int, int]]:
    """[surge, dive) of every stretch of main text."""
    n = len(weight)
    running = [0]
    for w in weight:
        running.append(running[-1] + w)
    block = [running[min(n, i + WINDOW)] - running[i] for i in range(n)] + [0]
    out, start = [], None
    for i in range(n):
        if start is None:
            if weight[i] and block[i] > SURGE and (block[i + 1] > 0 or i + 1 == n):
                start = i
        elif block[i] == 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, n))
    return out


def longest(page: list[Line], weight: list[int]) -> list[tuple[int, int]]:
    """The stretch of weighty lines around the weightiest; on a page of links alone, the first line that may be main text."""
    if not any(weight):
        marked = any(x.mark and not x.aside for x in page)
        return [(i, i + 1) for i, x in enumerate(page) if not x.aside and (x.mark or not marked)][:1]
    top = max(range(len(weight)), key=lambda i: (weight[i], -i))
    a = b = top
    while a and weight[a - 1]:
        a -= 1
    while b + 1 < len(weight) and weight[b + 1]:
        b += 1
    return [(a, b + 1)]


def carried_on(page: list[Line], weight: list[int], a: int, b: int) -> tuple[int, int]:
    """[a, b) and the rest of the boxes that its text stands in, but for menus at their ends."""
    boxes = {page[i].box for i in range(a, b) if weight[i]} - {PAGE}
    own = [i for i, x in enumerate(page) if x.box in boxes and not x.aside]
    if not own:
        return a, b
    first, last = min(a, own[0]), max(b, own[-1] + 1)

    def links(rows: range) -> int:
        n = 0
        for i in rows:
            if weight[i] or page[i].aside:
                break
            n += 1
        return n

    if (n := links(range(first, a))) >= MENU:
        first += n
    if (n := links(range(last - 1, b - 1, -1))) >= MENU:
        last -= n
    return first, last


def main_text(html: str | None) -> str:
    page = lines(html)
    weight = weights(page)
    if any(x.mark and not x.aside for x in page):
        own: dict[int, list[int]] = {}
        for x, w in zip(page, weight, strict=True):
            own.setdefault(x.mark, []).append(w)
        marks = {m for m, ws in own.items() if m and regions(ws)} or {page[a].mark for a, _ in longest(page, weight)}
        kept = {i for i, x in enumerate(page) if x.mark in marks}
    else:
        kept = {i for a, b in regions(weight) or longest(page, weight) for i in range(*carried_on(page, weight, a, b))}
    return "\n".join(page[i].text for i in sorted(kept) if not page[i].aside)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, with_fields(pages.select("page_id", "url").schema, text=StringType()))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
