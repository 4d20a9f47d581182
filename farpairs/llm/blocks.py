"""Text blocks of a web page with what a classifier may know of each; used inside Spark tasks.

Reading is one pass over the tags. A block is the text between two borders of block-level
elements; inline tags and ``br`` are inside it. Scripts, styles, templates, form controls
and the head are no text. Unclosed tags close with what holds them, as browsers do.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

OPENER = re.compile(r"<(?:!--|/?[A-Za-z]|[!?])")
NAME = re.compile(r"[^\s/>]+")
TURN = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SILENT = RAW | {"head", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "select", "datalist", "button", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BORDER = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag of the named kind ends, and where the search for one stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements, and words of a class, id or role, that mark what is not the article.
ASIDE = {"nav", "footer", "aside", "menu", "form", "dialog"}
MARKS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies respond toolbar pagination pager skip".split())
MAIN = {"article", "main"}
MAIN_MARKS = set("article content main post entry story body text".split())


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    inside: tuple[int, ...]  # containers, outermost first
    linked: int  # characters in links
    side: int  # -1 below a mark of boilerplate, 1 below one of the article, 0 neither


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the closing ``>``, or -1; quoted values may hold one."""
    while True:
        m = TURN.search(page, at)
        if not m:
            return -1
        if m[0] == ">":
            return m.start()
        at = m.end()
        if at <= last[m[0]] and page[m.start() - 1] in "= \t\n":
            at = page.find(m[0], at) + 1


def side_of(name: str, attributes: str, side: int) -> int:
    """The side of what an element holds, from the side of what holds it."""
    if name in ("html", "body"):
        return side
    tokens: set[str] = set()
    if "=" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role"):
                tokens.update(t.lower() for t in TOKEN.findall(a or b or c))
            elif key == "itemprop" and (a or b or c).lower() == "articlebody":
                tokens.add("article")
    if side < 0 and name != "form":
        return side if side == -1 or not (name in MAIN or tokens & {"article", "main"}) else 1
    marked = tokens & MARKS
    if name in MAIN:
        return -1 if marked & {"comment", "comments", "reply", "related", "sponsored", "promo"} else 1
    if name == "form" and side != -1:
        return -2 if side == 0 else -1  # an article may still open in a form around the whole page
    if name in ASIDE or name == "header" and side <= 0 or marked and not tokens & MAIN_MARKS:
        return -1
    return 1 if side == 0 and tokens & {"article", "main"} else side


def read(page: str) -> list[Block]:
    """The blocks of a page in order; references are decoded, white space is one space."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int]] = []  # name, container number or -1, side
    open_: Counter[str] = Counter()
    containers: list[int] = []
    made, at, size = 0, 0, len(page)
    silent = links = 0
    last = {q: page.rfind(q) for q in "\"'"}

    def border() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                tag = next((n for n, c, _ in reversed(stack) if c >= 0), "body")
                linked = sum(len(t) for t, a in parts if a)
                side = stack[-1][2] if stack else 0
                out.append(Block(text, tag, tuple(containers), min(linked, len(text)), -1 if side < 0 else side))
            parts = []

    def close() -> None:
        nonlocal silent, links
        name, container, _ = stack.pop()
        open_[name] -= 1
        if container >= 0:
            containers.pop()
        silent -= name in SILENT
        links -= name == "a"

    while at < size:
        m = OPENER.search(page, at)
        end = m.start() if m else size
        if end > at and not silent:
            parts.append((page[at:end], links > 0))
        if not m:
            break
        if m[0] == "<!--":
            found = page.find("-->", m.start() + 2)
            at = size if found < 0 else found + 3
            continue
        found = page.find(">", m.end()) if m[0] in ("<!", "<?") else _tag_end(page, m.end(), last)
        if found < 0:
            break  # a tag that never ends holds the rest
        at = found + 1
        if m[0] in ("<!", "<?"):
            continue
        closing = m[0].startswith("</")
        name = NAME.match(page, m.start() + 1 + closing)[0].lower()
        if name in BORDER:
            border()
        if closing:
            if open_[name] > 0:
                while stack[-1][0] != name:
                    if stack[-1][1] >= 0:
                        border()
                    close()
                close()
            elif name == "p":
                border()
            continue
        if name == "br":
            parts.append((" ", False))
        if name in VOID:
            continue
        if name in BORDER and open_["p"] > 0 and name not in ("html", "body"):
            # a paragraph ends where a block begins, unless the paragraph holds what holds the block
            k = len(stack) - 1
            while k >= 0 and stack[k][1] < 0:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                while len(stack) > k:
                    close()
        if name in ENDS:
            ended, stop = ENDS[name]
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in stop and stack[k][0] not in ended:
                k -= 1
            if k >= 0 and stack[k][0] in ended and any(open_[x] > 0 for x in ended):
                border()
                while len(stack) > k:
                    close()
        attributes = page[m.start() + 1 + len(name) : found]
        side = side_of(name, attributes, stack[-1][2] if stack else 0)
        if name in BORDER:
            containers.append(made)
            stack.append((name, made, side))
            made += 1
        else:
            stack.append((name, -1, side))
        open_[name] += 1
        silent += name in SILENT
        links += name == "a"
        if name in RAW and not attributes.endswith("/"):
            shut = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = shut.start() if shut else size
    border()
    return out


def features(blocks: list[Block], k: int) -> list[str]:
    """What the classifier sees of a block; its marked side is not among it."""
    b = blocks[k]
    words = b.text.count(" ") + 1
    heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
    kind = "heading" if heading else b.tag if b.tag in ("p", "li", "td", "div", "blockquote", "pre") else "other"
    share = 4 * b.linked // max(1, len(b.text))
    ends = "end" if b.text[-1:] in '.!?…:;"”»' else "open"
    bin_ = min(7, words.bit_length())
    return [f"kind:{kind}", f"words:{bin_}", f"links:{share}", f"stop:{ends}:{min(3, bin_ // 2)}", f"place:{'first' if k == 0 else 'last' if k == len(blocks) - 1 else 'inner'}"]
