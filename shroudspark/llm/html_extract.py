"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; no tree is built.  Elements that break
the flow of text end a line, so pages that are written as one line have lines too.  The
ratio of a line's characters to its tags is smoothed with a Gaussian over neighbouring
lines, and runs of lines above a threshold, a share of the ratios' standard deviation,
are the content (text-to-tag ratios: Weninger, Hsu and Han, 2010).
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudspark.llm._common import bounded_batches


class Plan(NamedTuple):
    """Parameters; the defaults are the production values."""

    sigma: float = 1.0  # lines
    threshold: float = 0.5  # standard deviations of the smoothed ratio
    gap: int = 1  # content regions with so many lines between them are one


_BREAK = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_HIDDEN = frozenset("script style noscript template svg math head".split())
#: Hidden elements that browsers end by themselves, or that are shown if nothing ends them.
_SOFT = frozenset("noscript template svg math".split())
#: Elements that can't stand in drawings and formulas, so that they end them.
_LEAVES = frozenset("b big blockquote body br center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li nobr ol p pre small span strong sub sup table u ul".split())
#: Elements whose hidden content the parser hands over as text and that end with their own tag only.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Lines(HTMLParser):
    """Collects (text, tags) of each line, and the title.

    What stands in a hidden element is collected too, and taken back when the element
    ends; so an element that nothing ends hides nothing, but for scripts and styles, whose
    text goes on to the end of the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.title: str | None = None
        self._words: list[str] = []
        self._tags = 0
        self._hidden: list[str] = []
        self._before: tuple[int, list[str], int] | None = None  # what was there when the outermost soft element began
        self._title: list[str] | None = None

    def _end_line(self) -> None:
        text = " ".join("".join(self._words).split())
        if text or self._tags:
            self.lines.append((text, self._tags))
        self._words, self._tags = [], 0

    def _shown(self) -> bool:
        return all(h in _SOFT or h == "foreignobject" for h in self._hidden)

    def _show_again(self) -> None:
        """The outermost hidden element has ended: what it held is taken back."""
        if self._before is not None:
            number, self._words, self._tags = self._before
            del self.lines[number:]
            self._before = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _LEAVES and self._hidden and self._hidden[-1] in ("svg", "math"):
            self._hidden = []
            self._show_again()
        if tag in _BREAK and self._shown():
            self._end_line()
        if tag == "body":  # a head that is never closed ends here
            self._hidden = [h for h in self._hidden if h != "head"]
        if tag == "title" and self.title is None and self._title is None and self._hidden in ([], ["head"]):
            self._title = []
        if tag in _HIDDEN or tag == "foreignobject" and "svg" in self._hidden:
            if tag in _SOFT and not self._hidden:
                self._before = (len(self.lines), list(self._words), self._tags)
            self._hidden.append(tag)
        elif self._shown():
            self._tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _BREAK and self._shown():
            self._end_line()
        if self._shown():
            self._tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self._title is not None:
            self.title, self._title = " ".join("".join(self._title).split()), None
        if tag in self._hidden:
            while self._hidden.pop() != tag:
                pass
            if not self._hidden:
                self._show_again()
        elif self._shown() and tag not in _VOID:
            self._tags += 1
        if tag in _BREAK and self._shown():
            self._end_line()

    def handle_data(self, data: str) -> None:
        if self._title is not None:
            self._title.append(data)
        elif self._shown():
            self._words.append(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut off and scaled up."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach)
    weight = np.pad(np.ones(len(values)), reach)
    return np.convolve(padded, kernel, "valid") / np.convolve(weight, kernel, "valid")


def content_lines(lines: list[tuple[str, int]], plan: Plan) -> np.ndarray:
    """Whether each line belongs to a content region."""
    if not lines:
        return np.zeros(0, dtype=bool)
    ratio = smooth(np.array([len(text) / max(tags, 1) for text, tags in lines]), plan.sigma)
    kept = (ratio >= plan.threshold * ratio.std()) & (ratio > 0)
    at = np.flatnonzero(kept)
    for a, b in zip(at[:-1], at[1:]):
        if b - a <= plan.gap + 1:
            kept[a:b] = True
    return kept


def extract_page(html: str, plan: Plan) -> tuple[str | None, str, int, int]:
    """Title, content, number of lines with text, and how many of them are content."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    kept = content_lines(parser.lines, plan)
    content = [text for (text, _), k in zip(parser.lines, kept) if k and text]
    return parser.title, "\n".join(content), sum(bool(text) for text, _ in parser.lines), len(content)


def extract(pages: DataFrame, plan: Plan = Plan(), html_col: str = "html") -> DataFrame:
    """``pages`` with ``title``, ``content``, ``n_lines`` and ``n_content`` (replaced if there).

    Defined cases: a null page has null title and content and no lines; an empty page,
    or one without text, has empty content; broken markup is read as far as it goes;
    pages are read whole at any length; equal pages have equal results; of equal ratios
    all are on one side of the threshold; an empty table has no rows.  Other columns,
    but for one called ``__page``, are carried along.
    """

    @F.arrow_udf("struct<title:string,content:string,n_lines:int,n_content:int>")
    def run(pages: pa.Array) -> pa.Array:
        out = [(None, None, 0, 0) if html is None else extract_page(html, plan) for html in pages.to_pylist()]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        columns = zip(*out) if out else ([], [], [], [])
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["title", "content", "n_lines", "n_content"])

    found = bounded_batches(pages).withColumn("__page", run.asNondeterministic()(F.col(html_col)))
    return found.withColumns({c: F.col(f"__page.{c}") for c in ("title", "content", "n_lines", "n_content")}).drop("__page")
