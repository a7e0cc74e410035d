"""A small tolerant HTML reader: elements and runs of text as one array of nodes in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The attributes of most tags; what doesn't fit is read by ``attributes``.
USUAL = re.compile(r"""((?>\s+[^\s/>="'<]+(?>=(?>"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)*+)\s*/?>""")
ATTRIBUTE = re.compile(r"""([^\s=]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
GAP = re.compile(r"[\s/]*")
NAME = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
SPACE = re.compile(r"[ \t-\r]+")
TOKEN = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, without readable text, in a line, and with
# end tags that may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template textarea select button svg math iframe object canvas audio video title head option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
NAMES = ("class", "id", "role", "aria-label", "itemprop")


@dataclass
class Page:
    """Nodes in page order: a node's parent comes before it; runs of text have the tag ``#text``."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", links: int = 0, mark: str | None = None) -> int:
        for column, value in zip((self.tags, self.parents, self.tokens, self.texts, self.links, self.marks), (tag, parent, tokens, text, links, mark)):
            column.append(value)
        return len(self.tags) - 1


def attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from the end of its name on, and the place after it, -1 if the page ends before.

    A quote opens a value only right after an equals sign; elsewhere it is part of a name or value.
    """
    values: dict[str, str] = {}
    while True:
        at = GAP.match(source, at).end()
        if at >= len(source):
            return values, -1
        if source[at] == ">":
            return values, at + 1
        name = NAME.match(source, at)
        at, value = name.end(), ""
        equals = EQUALS.match(source, at)
        if equals:
            at = equals.end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                close = source.find(quote, at + 1)
                if close < 0:
                    return values, -1
                value, at = source[at + 1 : close], close + 1
            else:
                found = UNQUOTED.match(source, at)
                value, at = found[0], found.end()
        values.setdefault(name[0].lower(), value)


def tag_rest(source: str, at: int) -> tuple[dict[str, str], int]:
    """As ``attributes``, by one pattern for the usual kind."""
    usual = USUAL.match(source, at)
    if not usual:
        return attributes(source, at)
    values: dict[str, str] = {}
    for a, b, c, d in ATTRIBUTE.findall(usual[1]) if usual[1] else ():
        values.setdefault(a.lower(), b or c or d or "")
    return values, usual.end()


def parse(source: str) -> Page:
    """The page's elements and block-level runs of text; inline elements belong to their run."""
    page = Page()
    stack = [page.add("#page", -1)]
    open_inline: list[str] = []
    run: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            page.add("#text", stack[-1], text=text, links=min(linked, len(text)))
        linked = 0

    def hear(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if "a" in open_inline:
                linked += len(piece)

    end = len(source)
    unclosed: set[str] = set()  # unread elements without an end tag from here on
    while at < end:
        found = OPENING.search(source, at)
        if not found:
            hear(source[at:])
            break
        hear(source[at : found.start()])
        if not found[2]:  # a comment or a declaration, up to the page's end if nothing closes it
            mark = "-->" if found[0] == "<!--" else ">"
            close = source.find(mark, found.start() + 2)
            at = close + len(mark) if close >= 0 else end
            continue
        tag = found[2].lower()
        values, at = tag_rest(source, found.end())
        if at < 0:
            break  # a tag that the page's end cuts off
        if found[1]:
            if tag in INLINE:
                if tag in open_inline:
                    del open_inline[len(open_inline) - 1 - open_inline[::-1].index(tag) :]
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if page.tags[stack[i]] == tag:
                    del stack[i:]
                    open_inline.clear()
                    break
            continue
        if tag == "head":
            continue  # its end tag may be left out; what it holds is unread element by element
        if tag in UNREAD:
            close = None if tag in unclosed else re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            if close:
                at = close.end()
            else:
                unclosed.add(tag)
                at = end if tag in RAW else at
            continue
        if tag in INLINE:
            if tag not in VOID:
                open_inline.append(tag)
            continue
        flush()
        if tag in VOID:
            continue
        if page.tags[stack[-1]] == "p" or tag in CLOSED_BY:
            open_inline.clear()
            closes = CLOSED_BY.get(tag, frozenset()) | {"p"}
            while len(stack) > 1 and page.tags[stack[-1]] in closes:
                stack.pop()
        words = TOKEN.findall(" ".join(values[n] for n in NAMES if n in values).lower()) if values else ()
        hidden = ("hidden",) if "hidden" in values or "display:none" in values.get("style", "").replace(" ", "") else ()
        stack.append(page.add(tag, stack[-1], (*words, *hidden), mark=values.get("data-mark")))
    flush()
    return page
