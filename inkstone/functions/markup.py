"""Tags of a page, in one pass that is linear in its length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_REST = re.compile(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")


class Tag(NamedTuple):
    """A tag from start to end of the page; comments and declarations have no name, and closes is set for `</name>`."""

    start: int
    end: int
    name: str
    closes: bool
    attributes: str


def tags(page: str, raw: frozenset[str] = frozenset()) -> Iterator[Tag]:
    """Every tag of a page in order; an element of `raw` is one tag with all it holds, up to its end tag.

    A tag whose quotes never close ends at its first `>`, and so does every tag after it. Where no `>` is left, `<` is text, but for a last one,
    with which the page was cut off.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        comment = next((close for opens, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if page.startswith(opens, at)), None)
        if comment:
            end = page.find(comment, at + 2)
            end = len(page) if end < 0 else end + len(comment)
            yield Tag(at, end, "", False, "")
            at = end
            continue
        m = _NAME.match(page, at + 1)
        if not m:
            at += 1
            continue
        if at > last:
            if page.find("<", at + 1) < 0:
                yield Tag(at, len(page), "", False, "")
            return
        rest = _REST.match(page, m.end()) if quotes else None
        quotes = quotes and rest is not None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        closes, name, attributes = m[0][0] == "/", m[0].lstrip("/").lower(), page[m.end() : end - 1]
        if name in raw and not closes and not attributes.endswith("/"):
            over = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, end)
            end = over.end() if over else len(page)
        yield Tag(at, end, name, closes, attributes)
        at = end
