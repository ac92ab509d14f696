"""Links of an HTML page with the containers they stand in (for P20 and P24).

One pass of the standard library's tolerant tokenizer per page; no tree is kept, only the stack of
open elements.  Nesting, comments, unquoted attributes and truncated pages come out as a browser-like
parser sees them: an end tag closes the nearest open element of its name, what is never closed ends
with the page.  Pages go through as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT = frozenset({"script", "style", "template"})


def matcher(selector: str) -> Callable[[str, dict, list], bool]:
    """Test of one selector: ``.class``, ``[attr*="part"]`` or ``outer inner``."""
    if selector.startswith("."):
        token = selector[1:]
        return lambda tag, attrs, opened: token in attrs.get("class", "").split()
    if selector.startswith("["):
        attr, part = selector[1:-1].split("*=")
        part = part.strip("\"'")
        return lambda tag, attrs, opened: part in attrs.get(attr, "")
    outer, inner = selector.split()
    return lambda tag, attrs, opened: tag == inner and any(e[0] == outer for e in opened)


class LinkWalk(HTMLParser):
    """Collects links whose target contains ``prefix``, per container, and those of main and body.

    An open element is ``(tag, link it is or None, containers it opens)``; a link is
    ``[target, text pieces]``; a container is ``(selector rank, position, links)``.
    """

    def __init__(self, prefix: str, tests: Sequence[Callable]):
        super().__init__(convert_charrefs=True)
        self.prefix, self.tests = prefix, tests
        self.opened: list[tuple] = []
        self.containers: list[tuple] = []
        self.scopes: dict[str, list] = {}  # links of the first main and the first body

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        link = None
        if tag == "a" and self.prefix in attrs.get("href", ""):
            link = [attrs["href"], []]
            for _, _, boxes in self.opened:
                for box in boxes:
                    box.append(link)
        boxes = []
        for rank, test in enumerate(self.tests):
            if test(tag, attrs, self.opened):
                self.containers.append((rank, len(self.containers), []))
                boxes.append(self.containers[-1][2])
        if tag in ("main", "body") and tag not in self.scopes:
            boxes.append(self.scopes.setdefault(tag, []))
        if tag not in VOID:
            self.opened.append((tag, link, boxes))

    def handle_endtag(self, tag):
        for i in range(len(self.opened) - 1, -1, -1):
            if self.opened[i][0] == tag:
                del self.opened[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not any(e[0] in SILENT for e in self.opened):
            for _, link, _ in self.opened:
                if link is not None:
                    link[1].append(text)


def walk(html: str | None, slug: str | None, prefix: str, tests: Sequence[Callable]) -> tuple[list[str], list[str]]:
    """``(names of the first container with a usable link, targets in main or else body)``."""
    page = LinkWalk(prefix, tests)
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:  # a broken declaration: what came before it counts
        pass
    names: list[str] = []
    for _, _, links in sorted(page.containers, key=lambda c: c[:2]):
        names = [t for t in ("".join(pieces) for _, pieces in links) if t and t != slug]
        if names:
            break
    scope = page.scopes.get("main", page.scopes.get("body", []))
    return names, [target for target, _ in scope]


def page_walk(html, slug, prefix: str, selectors: Sequence[str]) -> Column:
    """Struct ``(names, targets)`` of ``walk`` per page."""

    @F.pandas_udf("names array<string>, targets array<string>")
    def run(pages: pd.Series, slugs: pd.Series) -> pd.DataFrame:
        tests = [matcher(s) for s in selectors]
        return pd.DataFrame([walk(h, s, prefix, tests) for h, s in zip(pages, slugs)], columns=["names", "targets"])

    return run(html, slug)
