"""DOM leaf blocks of a web page and the features a sequence model sees of them."""

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element names of the HTML standard, by what they do to the flow of text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"head", "script", "style", "template"}
FOREIGN = {"svg", "math"}
# What may stand in a head, and in a noscript there; any other opening tag or text ends the head.
HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
HEAD_NOSCRIPT = {"basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "style"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table",
    "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "ul",
}
# An opening tag ends an open element of these names, unless one of the scopes lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
MEANING = {"article", "aside", "dialog", "footer", "form", "header", "main", "nav"}
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TELLING = {"class", "id", "role", "aria-label", "itemprop"}


@dataclass
class Block:
    text: str
    tags: list[str]
    names: set[str]  # words of classes, ids and roles around it
    near: list[set[str]]  # the same of the three nearest elements
    linked: int
    hidden: bool


@dataclass
class _Open:
    tag: str
    names: set[str] = field(default_factory=set)
    hidden: bool = False


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            around = [o.names for o in self.open]
            self.blocks.append(Block(text, [o.tag for o in self.open], set().union(*around), around[-3:], self.linked, any(o.hidden for o in self.open)))
        self.parts, self.linked = [], 0

    def close_to(self, at: int) -> None:
        for o in self.open[at:]:
            self.silent -= o.tag in SILENT
            self.links -= o.tag == "a"
        del self.open[at:]

    def end_of(self, names: set[str], scopes: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in names:
                return self.close_to(at)
            if self.open[at].tag in scopes:
                return None

    def leave_head(self, tag: str | None) -> None:
        """End an open head, unless the tag may stand in it (None for text)."""
        tags = [o.tag for o in self.open[-2:]]
        if tags[-2:] == ["head", "noscript"] and tag not in HEAD_NOSCRIPT or tags[-1:] == ["head"] and tag not in HEAD:
            self.end_of({"head"}, set())

    def handle_starttag(self, tag, attrs):
        self.leave_head(tag)
        if tag in BLOCK:
            self.flush()
            self.end_of({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            self.end_of(*ENDS[tag])
        if tag == "body":
            self.end_of({"head"}, set())
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        names, hidden = set(), False
        for key, value in attrs:
            if key in TELLING and value:
                names.update(w.lower() for w in TOKEN.findall(value))
            hidden = hidden or key == "hidden" or (key == "style" and bool(re.search(r"display\s*:\s*none", value or "")))
        self.open.append(_Open(tag, names, hidden))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT | FOREIGN:  # only foreign elements really close themselves
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                return self.close_to(at)

    def handle_data(self, data):
        if data.strip():
            self.leave_head(None)
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    """Text of each run between block-level tags, in page order; white space is one space."""
    parser = _Parser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def _bin(value: float, edges: list[float]) -> int:
    return sum(value >= e for e in edges)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block: ancestors, their names, and the shape of its text."""
    out = []
    for b in blocks:
        size = len(b.text)
        f = {f"tag {t}" for t in b.tags} | {f"name {w}" for w in b.names}
        f |= {f"near {w}" for names in b.near for w in names}
        f.add(f"own {next((t for t in reversed(b.tags) if t in BLOCK), '')}")
        f.add(f"size {_bin(size, [10, 25, 50, 100, 200, 400])}")
        f.add(f"linked {_bin(b.linked / max(1, size), [0.01, 0.3, 0.7])}")
        f.add(f"ends {b.text[-1] in '.!?:;…»”'}")
        f.add(f"commas {_bin(b.text.count(','), [1, 3])}")
        f.add(f"within {next((t for t in reversed(b.tags) if t in MEANING), '')}")
        if b.hidden:
            f.add("hidden")
        if "©" in b.text:
            f.add("sign ©")
        f.add("always")
        out.append(sorted(f))
    return out
