"""A small HTML parser: elements in document order, their text, and where blocks begin.

It follows the rules of HTML that decide where text stands (void and raw-text
elements, implied ends, stray end tags) and works without recursion, in one pass.
"""

from __future__ import annotations

import re
from html import unescape

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in "script style textarea title iframe noscript template svg select".split()}
#: Without an end tag these hold the rest of the page; of the others only the start tag counts then.
TO_THE_END = set("script style textarea title iframe".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "label", "button", "legend"}
#: Start tag -> open elements that it ends, up to a container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = BLOCK - {"p"}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


UNQUOTED = re.compile(r"""=\s*[^\s"'>]+/$""")


def closes_itself(rest: str) -> bool:
    """Whether a start tag ends in a slash that is not part of an attribute's value."""
    return rest.endswith("/") and not UNQUOTED.search(rest)


class Stack:
    """The open elements, and for each tag name the places where it is open: the innermost is found at any depth."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#document"]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []  # places of ``P_SCOPE`` elements

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in P_SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, depth: int) -> None:
        """Close all elements from this place on."""
        for tag in self.tags[depth:]:
            self.places[tag].pop()
        while self.scopes and self.scopes[-1] >= depth:
            self.scopes.pop()
        del self.nodes[depth:], self.tags[depth:]

    def last(self, names: set[str]) -> int:
        return max((at[-1] for name in names if (at := self.places.get(name))), default=0)

    def find(self, wanted: set[str], scope: set[str]) -> int:
        """The place of the innermost wanted element, 0 if there is none inside the scope."""
        depth = self.last(wanted)
        end = (self.scopes[-1] if self.scopes else 0) if scope is P_SCOPE else self.last(scope)
        return depth if depth >= end else 0


class Page:
    """Nodes (``tags``, ``parents``, ``depths``, ``names``) and pieces of text (node, block, text).

    Node 0 stands for the document; parents come before their children.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.depths = ["#document"], [-1], [0]
        self.names: list[tuple[str, ...]] = [()]
        self.pieces: list[tuple[int, int, str]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, block, at, size, tag_pattern = Stack(), 0, 0, len(html), TAG
        tags, pieces = self.tags, self.pieces
        while at < size:
            found = html.find("<", at)
            if found < 0:
                found = size
            if found > at:
                text = html[at:found]
                pieces.append((stack.nodes[-1], block, unescape(text) if "&" in text else text))
                at = found
                continue
            ahead = html[at + 1 : at + 2]
            if html.startswith("<!--", at):
                # "<!-->" and "<!--->" are whole comments
                end = html.find("-->", at + 2 if html.startswith(("<!-->", "<!--->"), at) else at + 4)
                at = size if end < 0 else end + 3
                continue
            if ahead in ("!", "?"):
                end = html.find(">", at)
                at = size if end < 0 else end + 1
                continue
            match = tag_pattern.match(html, at) if ahead == "/" or ahead.isalpha() else None
            if match is None and tag_pattern is TAG and (ahead == "/" or ahead.isalpha()):
                tag_pattern = BARE_TAG  # a quote without its other half: quotes mean nothing from here on
                continue
            if match is None:
                pieces.append((stack.nodes[-1], block, "<"))
                at += 1
                continue
            at = match.end()
            closing, name, rest = match[1], match[2].lower(), match[3]
            if closing:
                depth = stack.find({name}, {"table"} if name not in ("table", "body", "html") else set())
                if depth:
                    stack.cut(depth)
                if name in BLOCK:
                    block += 1
                continue
            if name in ENDS_P:
                depth = stack.find({"p"}, P_SCOPE)
                if depth:
                    stack.cut(depth)
            if name in ENDS:
                ended, scope = ENDS[name]
                while depth := stack.find(ended, scope):
                    stack.cut(depth)
            if name == "br":
                pieces.append((stack.nodes[-1], block, " "))
                continue
            if name in BLOCK:
                block += 1
            if name in VOID:
                continue
            if name in RAW:
                end = None if closes_itself(rest) and name == "svg" else RAW[name].search(html, at)
                if end is not None:
                    at = html.find(">", end.start()) + 1 or size
                elif name in TO_THE_END:
                    at = size
                continue
            node = len(tags)
            tags.append(name)
            self.parents.append(stack.nodes[-1])
            self.depths.append(len(stack.nodes))
            self.names.append(tuple(t.lower() for _, v in ATTRIBUTE.findall(rest) for t in TOKEN.findall(v)) if "=" in rest else ())
            if name in BLOCK or not closes_itself(rest):
                stack.push(node, name)


def joined_text(pieces: list[tuple[int, int, str]], chosen) -> str:
    """Text of the chosen nodes: white space made single in each block, blocks joined by line feeds."""
    out, held, current = [], [], None
    for node, block, text in pieces:
        if not chosen[node]:
            continue
        if block != current:
            out.append(" ".join("".join(held).split()))
            held, current = [], block
        held.append(text)
    out.append(" ".join("".join(held).split()))
    return "\n".join(filter(None, out))
