"""Leaf blocks of a web page in order, with the path of tags and names above each."""

from __future__ import annotations

import html
import re

#: One pattern for all markup; unclosed comments and scripts run to the end of the page.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.I | re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
                    "strike strong sub sup time tt u var wbr img").split())
#: Elements whose start tag ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """``(text, path, share of the text in links)`` of all blocks with text, head and title left out."""
    found: list[tuple[str, tuple[str, ...], float]] = []
    if not page:
        return found
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, at = 0, 0

    def path() -> tuple[str, ...]:
        return tuple(name for tag, names in stack if tag not in INLINE for name in (tag, *names))

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not any(tag in ("head", "title") for tag, _ in stack):
                found.append((text, path(), linked / max(1, sum(map(len, pieces)))))
            pieces.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of these, and all within it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return

    for m in MARKUP.finditer(page):
        if m.start() > at:
            pieces.append(page[at:m.start()])
            if any(tag == "a" for tag, _ in stack[-3:]):
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        elif m[2]:
            if tag not in INLINE:
                end_block()
            close({tag})
        else:
            if tag not in INLINE:
                end_block()
                if tag == "body":
                    stack.clear()
                elif tag in CLOSES:
                    close(CLOSES[tag])
                elif any(open_tag == "p" for open_tag, _ in stack):
                    close({"p"})
            if tag not in VOID and not m[4].endswith("/"):
                values = " ".join(v for g in NAMES.findall(m[4]) for v in g) if m[4] else ""
                stack.append((tag, tuple("." + n for n in NAME_PART.findall(values.lower()))))
    pieces.append(page[at:])
    end_block()
    return found
