"""HTML parsing inside tasks: page text, and repeated blocks picked by tag and class."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SKIPPED = ("script", "style")


class _Nodes(HTMLParser):
    """Flat document order: elements with the text range they span, and the text pieces."""

    # Elements without content.
    VOID = "area base br col embed hr img input link meta param source track wbr".split()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.texts: list[str] = []
        self.open: list[dict] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        node = {
            "tag": tag, "attrs": attrs, "classes": set((attrs.get("class") or "").split()),
            "index": len(self.elements), "last": len(self.elements), "start": len(self.texts), "end": len(self.texts),
        }
        self.elements.append(node)
        if tag not in self.VOID:
            self.open.append(node)
            self.skipping += tag in SKIPPED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def _close(self):
        node = self.open.pop()
        node["end"], node["last"] = len(self.texts), len(self.elements) - 1
        self.skipping -= node["tag"] in SKIPPED

    def handle_endtag(self, tag):
        if any(node["tag"] == tag for node in self.open):
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.skipping:
            self.texts.append(data)

    def finish(self, html: str) -> "_Nodes":
        self.feed(html)
        self.close()
        while self.open:
            self._close()
        return self


def parse(html: str | None) -> _Nodes:
    return _Nodes().finish(html or "")


def join_text(texts: list[str], separator: str) -> str:
    """Non-blank text pieces, trimmed, joined by a separator."""
    return separator.join(t for t in (piece.strip() for piece in texts) if t)


def visible_text(html: str | None) -> str:
    """Visible text; lines and phrases two blanks apart are joined by one blank."""
    text = join_text(parse(html).texts, " ")
    phrases = (p.strip() for line in text.splitlines() for p in line.split("  "))
    return " ".join(p for p in phrases if p)


def page_text(html) -> Column:
    """Visible text of a page, by a real parser (see ``functions.text.html_to_text`` for the native form)."""

    @F.pandas_udf(T.StringType())
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text)

    return extract(F.col(html) if isinstance(html, str) else html)


@dataclass(frozen=True)
class PostSelectors:
    """Fallback chains of ``tag.class`` selectors; the first that matches anything wins."""

    containers: tuple[str, ...]
    text: tuple[str, ...]
    title: tuple[str, ...]
    link: tuple[str, ...]
    time: tuple[str, ...]


# Where profile pages keep their posts.
PROFILE_POSTS = PostSelectors(
    containers=("div.ember-view.occludable-update", "div.feed-shared-update-v2", "div.feed-shared-card"),
    text=("div.feed-shared-text", "div.feed-shared-update-v2__description", "div.feed-shared-text-view"),
    title=("div.feed-shared-article__title", "span.feed-shared-article__title"),
    link=("a.app-aware-link", "a.feed-shared-article__link"),
    time=("span.feed-shared-actor__sub-description", "time.feed-shared-actor__sub-description"),
)


def _matches(node: dict, selector: str) -> bool:
    tag, *classes = selector.split(".")
    return node["tag"] == tag and node["classes"].issuperset(classes)


def _first(nodes: list[dict], selectors) -> dict | None:
    for selector in selectors:
        for node in nodes:
            if _matches(node, selector):
                return node
    return None


def posts_of(html: str | None, selectors: PostSelectors) -> list[dict]:
    """Posts of one page in document order; blocks without any text are skipped."""
    page = parse(html)
    blocks: list[dict] = []
    for selector in selectors.containers:
        blocks = [n for n in page.elements if _matches(n, selector)]
        if blocks:
            break
    posts = []
    for block in blocks:
        inside = page.elements[block["index"] + 1 : block["last"] + 1]

        def text_at(chain):
            node = _first(inside, chain)
            return join_text(page.texts[node["start"] : node["end"]], "") if node else ""

        content = text_at(selectors.text) or text_at(selectors.title)
        if content:
            anchor = _first(inside, selectors.link)
            href = (anchor["attrs"].get("href") or "") if anchor else ""
            posts.append({"pos": len(posts), "content": content, "link": href, "age": text_at(selectors.time)})
    return posts


POST = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("age", T.StringType()),
    ]
)


def page_posts(html, selectors: PostSelectors = PROFILE_POSTS) -> Column:
    """Array of the posts of a page: position, content, link and age text."""

    @F.pandas_udf(T.ArrayType(POST))
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: posts_of(html, selectors))

    return extract(F.col(html) if isinstance(html, str) else html)
