"""Leaf blocks of HTML pages: runs of text without a block boundary, with what stands above."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: Elements of HTML that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no page text; without an end tag they last to the
#: page's end, and a slash in their start tag ends nothing.
RAW = frozenset("script style iframe noframes noembed textarea title xmp".split())
#: Elements with a tree of their own that is no page text. They end with the end tag that
#: matches; without one only the start tag is passed over.
APART = frozenset("svg template".split())
#: An element of this kind ends an open one of these, up to the nearest of the barriers.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that may stand inside a paragraph; any other block ends it.
INSIDE_P = frozenset(["br", "button", "label", "option", "optgroup", "select", "video", "body", "head", "html"])

#: Elements that say what the text below them is for; other tags only build the page.
TELLING = frozenset(
    "article aside blockquote button details dialog fieldset figure footer form h1 h2 h3 h4 h5 h6 header label main menu "
    "nav pre search".split()
)
LANDMARKS = frozenset("article aside dialog footer form header main menu nav search".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+|[0-9]+")


def own_features(tag: str, attributes: str) -> list[str]:
    """What an element says about the text below it: its tag if that tells something, and the
    words of its class, id and role."""
    out = [f"tag:{tag}"] if tag in TELLING else []
    for name, *values in ATTRIBUTE.findall(attributes):
        tokens = TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())
        out += [f"word:{t}" for t in tokens if not t.isdigit()]
    return out


@dataclass
class Block:
    text: str
    above: object  # the sum of what its ancestors say
    tag: str  # of the innermost block
    landmark: str  # the innermost element above it that is one
    linked: float  # part of its characters inside links


class _Ends:
    """Where the elements of one name end, nested ones matched. The page's tags of that name are
    found once, however many of them stay open."""

    def __init__(self, name: str, page: str):
        tags = re.compile(rf"<(/?){re.escape(name)}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
        self._end: dict[int, int] = {}
        opened: list[int] = []
        for tag in tags.finditer(page):
            if tag[1]:
                if opened:
                    self._end[opened.pop()] = tag.end()
            elif not tag[0].endswith("/>"):
                opened.append(tag.end())

    def after(self, start: int) -> int:
        """The place behind the end tag of the element whose start tag ends at ``start``."""
        return self._end.get(start, start)


def leaf_blocks(page: str, weigh: Callable[[str, str], object], nothing: object) -> Iterator[Block]:
    """The leaf blocks of a page in page order, without empty ones.

    ``weigh(tag, attributes)`` gives what an element says; the sums over the ancestors go with
    each block. Comments, markup, and the content of scripts, drawings and the like are left
    out; what stands in formulas and inside elements that only some browsers show is text,
    character references are decoded and white space is one blank. Open paragraphs, items and
    cells are ended as HTML says; end tags without a start tag are passed over; everything
    open ends with the page.
    """
    stack: list[tuple[str, object]] = []
    ends_apart: dict[str, _Ends] = {}
    parts: list[str] = []
    linked = links = at = 0
    above, tag, landmark = nothing, "", ""

    def done() -> Iterator[Block]:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            yield Block(text, above, tag, landmark, linked / len(text))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, above, tag, landmark
        if not text:
            return
        if not parts:
            above = stack[-1][1] if stack else nothing
            tag = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
            landmark = next((t for t, _ in reversed(stack) if t in LANDMARKS), "")
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    def close(to: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    while found := MARKUP.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            yield from done()
        if found[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if place is not None:
                close(place)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in APART:
            if not found[3].endswith("/"):
                if name not in ends_apart:
                    ends_apart[name] = _Ends(name, page)
                at = ends_apart[name].after(at)
            continue
        if name in VOID:
            continue
        if name in BLOCKS and name not in INSIDE_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        ends, barrier = IMPLIED.get(name, (frozenset(), frozenset()))
        if ends:
            lowest = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in barrier:
                    break
                if stack[i][0] in ends:
                    lowest = i
            if lowest is not None:
                close(lowest)
        own = weigh(name, found[3])
        stack.append((name, own + stack[-1][1] if stack else own))
        links += name == "a"
    add(page[at:])
    yield from done()


def text_features(block: Block) -> list[str]:
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = [
        f"in:{block.tag}",
        f"mark:{block.landmark}",
        f"words:{min(words.bit_length(), 7)}",
        f"links:{0 if block.linked < 0.05 else 1 if block.linked < 0.4 else 2 if block.linked < 0.8 else 3}",
        f"end:{'stop' if text[-1] in '.!?…。！？' else 'comma' if text[-1] in ',;:' else 'other'}",
        f"commas:{min(text.count(',') * 20 // max(words, 20), 2)}",
    ]
    if "©" in text:
        out.append("sign")
    if sum(map(str.isdigit, text)) * 4 > n:
        out.append("digits")
    return out
