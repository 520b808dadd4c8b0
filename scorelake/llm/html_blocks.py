"""Leaf blocks of an HTML page: runs of text between block-level tags, with the tags above them."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Their content is never text of the page.
RAW = frozenset("script style head title textarea noscript template svg math iframe object select option button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these, if they are the innermost block.
CLOSES = {t: frozenset(c.split()) for t, c in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "tbody": "tr td th tbody thead p", "tfoot": "tr td th tbody thead p"}.items()}
_P = frozenset(["p"])

_TAG = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTR = re.compile(r"""(?<![^\s"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![^\s"'])hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)

_OTHER = re.compile(r"[^a-z]+")


class Path:
    """An open block: ``tag.attribute=words`` (words are runs of a-z, by spaces), and the block around it, if any. Blocks share
    what is around them, so a page takes memory in proportion to its length, however deep it is nested."""

    __slots__ = ("above", "depth", "step")

    def __init__(self, step: str, above: Path | None):
        self.step, self.above, self.depth = step, above, above.depth + 1 if above else 0


class Block(NamedTuple):
    text: str  # decoded, white space in runs of one, trimmed; never empty
    path: Path | None  # the innermost open block
    linked: int  # characters inside links


def blocks(html: str | None) -> list[Block]:
    """In page order. Malformed markup is read as browsers do it in the common cases: unclosed elements end with their parent."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, Path | None]] = [("", None)]
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    link, linked, at, n = 0, 0, 0, len(html)
    open_ended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, stack[-1][1], linked))
        linked = 0

    while at < n:
        m = _TAG.search(html, at)
        upto = m.start() if m else n
        if upto > at:
            run = html[at:upto]
            parts.append(unescape(run) if "&" in run else run)  # before joining: a reference does not go on across a tag
            if link:
                linked += upto - at
        if not m:
            break
        at = m.end()
        close, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if close or attrs.endswith("/"):
                continue
            end = None if tag in open_ended else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not end:
                open_ended.add(tag)  # no end tag follows: it is not looked for again
            if tag == "head" and not end:
                end = re.compile(r"(?=<body[\s>])", re.I).search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title", "iframe"):
                at = n
        elif tag == "a":
            link = 0 if close else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if close:
                while n_open[tag]:  # down to the innermost block of that tag, if one is open
                    ended = stack.pop()[0]
                    n_open[ended] -= 1
                    if ended == tag:
                        break
            else:
                closes = CLOSES.get(tag, _P)
                while stack[-1][0] in closes:
                    n_open[stack.pop()[0]] -= 1
                if tag not in VOID:
                    words = tag
                    if attrs and not attrs.isspace():
                        for name, a, b, c in _ATTR.findall(attrs):
                            words += f".{name.lower()}={_OTHER.sub(' ', (a or b or c).lower())}"
                        if _HIDDEN.search(attrs):
                            words += ".hidden=yes"
                    stack.append((tag, Path(words, stack[-1][1])))
                    n_open[tag] += 1
    flush()
    return out
