"""Blocks of text in a web page, with what tells articles from boilerplate."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())  # no text of the page
SHOWN_RAW = frozenset("xmp listing plaintext".split())  # text in which tags mean nothing
CONTROLS = frozenset("select option datalist button".split())
BLOCK = frozenset("html body head address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav noscript ol p pre search section summary table tbody td template tfoot th thead tr ul xmp listing plaintext".split())
CLOSES_P = BLOCK - {"html", "body", "head", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "label", "noscript", "template"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
LIST_TOPS = frozenset("ul ol menu dl table tbody thead tfoot div section article body".split())
FRAME = {"nav": "menu", "menu": "menu", "footer": "foot", "header": "head", "aside": "side", "form": "form", "fieldset": "form", "label": "form", "legend": "form", "search": "form", "dialog": "notice", "noscript": "notice", "template": "notice"}
SECTIONS = frozenset("nav footer header aside form article main section div ul ol table".split())
FLAGS = ("menu", "foot", "head", "side", "form", "notice")
FADE = 0.75  # how much of a name's weight is left one block further in

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_NAME = re.compile(r"""(?:\b(?:class|id|role))\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ELSEWHERE = re.compile(r"(?<![^\s_-])(?:has|with|without|no)[_-]\S*", re.I)  # names such as has-sidebar tell of a part elsewhere
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|toolbar|sidebar\w*|side|rail|widget\w*|related|recommend\w*|share|sharing|social|footer|foot|masthead|header|copyright|legal|comments?|comment\w*|disqus|replies|respond|search|pagination|pager|tags?|meta|contentinfo|complementary|navigation|hidden)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|body|entry|post|story|text|main|page|prose)(?:$|[\s_-])", re.I)
_REPLY = re.compile(r"(?:^|\s)(?:comment|reply)(?:$|[\s_-])", re.I)
_SENTENCE = re.compile(r"[.!?。](?:\s|$)")


class Node:
    """A block element: what it says of itself, then what holds within it."""

    __slots__ = ("tag", "number", "above", "kind", "bad", "good", "reply", "article", "section", "prose", "has_main", "has_title", "flags", "bad_near", "good_near", "in_article")

    def __init__(self, tag: str, number: int, above: Node | None, names: str):
        self.tag, self.number, self.above, self.kind = tag, number, above, FRAME.get(tag)
        self.reply = bool(names and _REPLY.search(names))
        self.bad, self.good = bool(names and _BAD.search(names)), bool(names and _GOOD.search(names))
        self.article = tag == "article"
        self.section = number if tag in SECTIONS or above is None else above.section
        self.prose, self.has_main, self.has_title = 0, tag == "main", tag == "h1"
        self.flags, self.bad_near, self.good_near, self.in_article = frozenset(), 0.0, 0.0, False

    def settle(self, prose: int) -> None:
        """What holds within, from what holds around. What holds the main part or, with its title, half of the prose is no frame of it."""
        above = self.above
        if above is None:
            return
        around = self.has_main or self.has_title and 2 * self.prose >= prose > 0
        self.flags, self.bad_near, self.good_near, self.in_article = above.flags, above.bad_near * FADE, above.good_near * FADE, above.in_article
        if self.tag in ("html", "body"):
            return
        if self.tag == "main" or self.article and not self.reply and not above.in_article and above.bad_near == 0:
            self.flags, self.bad_near, self.good_near, self.in_article = frozenset(), 0.0, 0.0, True
            return
        if self.kind and not around:
            self.flags = self.flags | {self.kind}
        if self.bad and not around:
            self.bad_near = 1.0
        elif self.good:
            self.good_near = 1.0


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    link_chars: int
    node: Node

    @property
    def section(self) -> int:
        return self.node.section


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. White space inside one is a single space; scripts, styles, controls, comments and empty blocks are gone."""
    root = Node("", 0, None, "")
    stack: list[Node] = [root]  # open elements; inline ones stand for themselves only
    nodes, found, texts = [root], [], []
    linked, link_chars, owner, muted = 0, 0, root, ""

    def inner() -> Node:
        return next(n for n in reversed(stack) if n.tag in BLOCK or n is root)

    def flush() -> None:
        nonlocal link_chars
        if texts:
            raw = "".join(texts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            texts.clear()
            if text:
                found.append(Block(text, owner.tag, link_chars, owner))
        link_chars = 0

    def close(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                del stack[depth:]
                return
            if stack[depth].tag in stop:
                return

    at, size = 0, len(page)
    scan = _TOKEN.search
    while at < size:
        token = scan(page, at)
        chunk = page[at : token.start()] if token else page[at:]
        if chunk and not muted:
            if not texts:
                owner = inner()
            texts.append(chunk)
            if linked:
                link_chars += len(chunk)
        if not token:
            break
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            continue
        tag, ending = tag.lower(), bool(token[1] or token[4])
        if tag in BLOCK or ending and tag == muted:
            muted = ""
        if ending:
            if tag == "a":
                linked = 0
            if tag in BLOCK:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        attributes = token[3] if token[2] else token[6]
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else (size if tag in ("script", "style") else at)
            texts.append(" ") if texts else None
            continue
        if tag in CONTROLS:
            muted = muted or tag
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                texts.append(" ") if texts else None
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            linked = 1
        names = ""
        if tag in BLOCK:
            flush()
            linked = 0
            if tag in CLOSES_P:
                close(frozenset(("p",)), BLOCK - {"p"})
            if tag in SIBLINGS:
                close(SIBLINGS[tag], LIST_TOPS)
            if attributes and "=" in attributes:
                names = _ELSEWHERE.sub(" ", " ".join(a or b or c for a, b, c in _NAME.findall(attributes)))
            node = Node(tag, len(nodes), inner(), names)
            nodes.append(node)
            stack.append(node)
            if tag in SHOWN_RAW:
                end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
                owner = node
                texts.append(html.escape(page[at : end.start() if end else size]))
                at = end.end() if end else size
                flush()
                stack.pop()
        elif not attributes.endswith("/"):
            stack.append(Node(tag, -1, stack[-1], ""))
    flush()
    _settle(nodes, found)
    return found


def _settle(nodes: list[Node], blocks: list[Block]) -> None:
    prose = [b for b in blocks if 2 * b.link_chars < len(b.text)]
    for block in [b for b in prose if len(b.text) >= 80] or prose:
        block.node.prose += len(block.text)
    for node in reversed(nodes[1:]):
        node.above.prose += node.prose
        node.above.has_main |= node.has_main
        node.above.has_title |= node.has_title
    articles = [n for n in nodes if n.article and not n.reply and n.prose]
    if articles:
        node = max(articles, key=lambda n: n.prose).above  # the first of the longest
        while node is not None:
            if 2 * node.prose >= nodes[0].prose:
                node.has_main = True
            node = node.above
    for node in nodes:
        node.settle(nodes[0].prose)


FEATURES = ("bias", *FLAGS, "bad_near", "good_near", "article", "heading", "item", "paragraph", "link_share", "mostly_links", "article_links", "short", "long", "sentences", "sentence_end", "headed_article")


def features_of(block: Block) -> list[float]:
    node, size = block.node, len(block.text)
    share = min(1.0, block.link_chars / size)
    ends = len(_SENTENCE.findall(block.text))
    heading, article = block.tag in HEADINGS, node.in_article
    flags = [f in node.flags and not (f == "head" and article and heading) for f in FLAGS]
    return [
        1.0, *flags, node.bad_near, node.good_near, article, heading, block.tag in ("li", "dt", "dd"), block.tag in ("p", "pre", "blockquote", "xmp", "listing"), share, share > 0.6,
        share if (article or node.good_near > 0.4) and not node.flags and not node.bad_near else 0.0, size < 25, min(1.0, size / 400), min(1.0, ends / 4), block.text[-1] in ".!?。:\"»”", article and heading,
    ]
