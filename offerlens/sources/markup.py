"""A small tree of page elements, for the markup that regular expressions cannot follow; runs inside tasks, page by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def each(self) -> Iterator[Node | str]:
        """Nodes and texts below this one in order, however deep: the path down is a list, not a call stack."""
        ahead = [iter(self.children)]
        while ahead:
            child = next(ahead[-1], None)
            if child is None:
                ahead.pop()
                continue
            yield child
            if isinstance(child, Node):
                ahead.append(iter(child.children))

    def walk(self) -> Iterator[Node]:
        return (x for x in self.each() if isinstance(x, Node))

    def text(self) -> str:
        return " ".join(" ".join(x for x in self.each() if isinstance(x, str)).split())

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def all(self, tag: str | None = None, cls: str | None = None, attr: str | None = None) -> list[Node]:
        return [x for x in self.walk() if (tag is None or x.tag == tag) and (cls is None or cls in x.classes()) and (attr is None or attr in x.attrs)]

    def first(self, tag: str | None = None, cls: str | None = None, attr: str | None = None) -> Node | None:
        return next((x for x in self.walk() if (tag is None or x.tag == tag) and (cls is None or cls in x.classes()) and (attr is None or attr in x.attrs)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def each_page(pages: DataFrame, rule: Callable[[Node, str], list[dict]], fields: list[str]) -> DataFrame:
    """(store_slug, url, position, fields..., error): what `rule` finds in each page, as text; a page it fails on yields one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for slug, url, html in zip(batch["store_slug"], batch["url"], batch["html"], strict=True):
                try:
                    found, error = rule(tree(html), url), None
                except Exception as problem:  # one bad page is a row, not a failed job
                    found, error = [{}], f"{type(problem).__name__}: {problem}"
                rows += [(slug, url, i, *[x.get(f) for f in fields], error) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["store_slug", "url", "position", *fields, "error"]).astype({"position": "int32"})

    kinds = ", ".join(f"{f} string" for f in fields)
    return pages.select("store_slug", "url", "html").mapInPandas(run, f"store_slug string, url string, position int, {kinds}, error string")
