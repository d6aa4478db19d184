"""HTML extraction by composite text density.

A page is read into a tree of elements; tags that only format text (b, i, span, br and their like) make no element of
their own. Elements that cannot be main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments)
are told by name, role or the words of class and id and are left out of the text, but count in the densities around them;
scripts and styles count nowhere. Forms and what only words tell stay where they wrap the page: if they hold its largest
article or main (one inside reader comments only if there is no other), or, on a page that has no article or main outside
of them, more than half of its text, reader comments excepted. A compound name counts only if all its words are of that
kind or of the page's furniture (box, list, wrapper), so share-price, ad-free and no-comments leave nothing out. Each
element has its characters C, elements T, link characters LC and link elements LT, and the density

    C / T * ln(C / LC * T / LT) / ln(e - 1 + ln(C / (C - LC) * LC + LCb / Cb * C + e))        (b: the body)

with every divisor at least 1; e - 1 keeps the last logarithm at 1 or more for pages without links. The element whose
children's densities (a bare text's is its length) sum highest is the core; with equal sums, the outer one. From the core
the path to the body is climbed: an element on it takes the place of the one inside unless one of the elements that it
adds, left-out ones aside, has more than half of its characters in links. Where the climb ends, the lowest density on the path is
the threshold, and elements beside the path that reach it belong to the text as well. If the core is the body itself,
those of its children that are links for the most part and lie below the body's density are left out.

Text: character references decoded, white space inside a block made one space, blocks joined by newlines in page order.
Defined cases: a null or empty page, or one without text, gives an empty text; an empty table gives no rows; repeated
rows and pages get equal texts; other columns are not read. Broken markup never fails: unclosed elements end with their
parents, stray end tags are passed over. Rows are read one by one, in time that grows with their length.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""",
    re.S,
)
MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
ENDS_P = BLOCK - set("body html caption tbody td tfoot th thead tr option optgroup legend".split())
#: Tags that only format the text of the element around them.
FORMAT = set(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An element of the key's name ends an open one of these, unless one of the second kind stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
OUT = set("head nav header footer aside button select input datalist svg math object embed canvas audio video dialog menu".split())
OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus reply replies respond toolbar pagination pager skip complementary contentinfo search dialog".split()
)
COMMENTS = set("comment comments disqus reply replies respond".split())
#: Words that may stand beside those in a compound name; with any other word the compound names something else.
FURNITURE = set(
    "area aside bar block bottom box button buttons col column container content cta desktop element footer form global group head header icons inner item items layer left link links list main mobile outer page panel post posts primary region right row secondary section site sticky slot submit thread title top unit user widget widgets wrap wrapper".split()
)
#: Never left out by the words of their class or id.
FIRM = {"html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"}


def _named(tag: str, attributes: str) -> set[str]:
    """The words of class, id and role by which an element of ``tag`` may be left out."""
    found: set[str] = set()
    if tag in FIRM or not attributes:
        return found
    for m in MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in WORDS.findall(name)}
            if words <= OUT_WORDS | FURNITURE:
                found |= (COMMENTS if tag == "article" else OUT_WORDS | {"header"}).intersection(words)
    return found


#: A block's edge that leaves no element behind.
_EDGE = object()


class _Node:
    __slots__ = ("tag", "parent", "kids", "out", "soft", "talk", "C", "T", "LC", "LT", "kept", "kept_links", "density", "total")

    def __init__(self, tag: str, parent: "_Node | None", out: bool, soft: bool = False, talk: bool = False):
        self.tag, self.parent, self.out, self.soft, self.talk = tag, parent, out, soft, talk
        self.kids: list = []
        self.C = self.T = self.LC = self.LT = self.kept = self.kept_links = 0
        self.density = self.total = 0.0

    def own(self) -> int:
        """Characters of its bare texts."""
        return sum(len(" ".join(k.split())) for k in self.kids if isinstance(k, str))


def parse(html: str) -> tuple[_Node, list[_Node]]:
    """The root, and all nodes that count, parents first."""
    root = _Node("#", None, False)
    nodes, stack, at = [root], [root], 0
    is_open: dict[str, int] = {}

    def text(part: str) -> None:
        if part:
            stack[-1].kids.append(unescape(part) if "&" in part else part)

    def close(names: set[str], stop: set[str]) -> None:
        if not any(is_open.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for n in stack[i:]:
                    is_open[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while m := TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not (name := m[2]):
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            if tag in BLOCK:
                close({tag}, set())
            else:
                close({tag}, BLOCK)
            if tag in BLOCK:
                stack[-1].kids.append(_EDGE)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in ENDS_P:
            close({"p"}, {"button", "table", "td", "th", "caption", "object"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("html", "body") and is_open.get(tag):
            continue
        if tag == "body":
            close({"head"}, set())
        top = stack[-1]
        out = top.out or tag in OUT
        names = set() if out else _named(tag, m[3])
        if tag in FORMAT and not names:
            if tag == "br":
                top.kids.append(" ")
            continue
        node = _Node(tag, top, out, bool(names) or tag == "form", top.talk or bool(names & COMMENTS))
        top.kids.append(node)
        nodes.append(node)
        if tag not in VOID:
            stack.append(node)
            is_open[tag] = is_open.get(tag, 0) + 1
    text(html[at:])
    _leave_out_soft(nodes)
    return root, nodes


def _leave_out_soft(nodes: list[_Node]) -> None:
    """Marks the subtrees that are left out by words; see the module."""
    if not any(n.soft for n in nodes):
        return
    size: dict[int, int] = {}
    for n in reversed(nodes):
        size[id(n)] = size.get(id(n), 0) + (0 if n.out else n.own())
        if n.parent:
            size[id(n.parent)] = size.get(id(n.parent), 0) + size[id(n)]
    whole = [n for n in nodes if n.tag in ("article", "main") and size[id(n)] and not n.soft and not n.out]
    inside: set[int] = set()  # nodes in or at a soft one
    for n in nodes:
        if n.soft or (n.parent and id(n.parent) in inside):
            inside.add(id(n))
    holds, apart = set(), any(id(n) not in inside for n in whole)
    largest = max(whole, key=lambda n: (not n.talk, size[id(n)]), default=None)
    while largest:
        holds.add(id(largest))
        largest = largest.parent
    all_text = size[id(nodes[0])]
    for n in nodes:
        if n.parent and n.parent.out:
            n.out = True
        elif n.soft and id(n) not in holds and (apart or n.talk or 2 * size[id(n)] <= all_text):
            n.out = True


def density(C: int, T: int, LC: int, LT: int, share: float) -> float:
    """The composite density of these counts; ``share`` is LCb / Cb."""
    if not C:
        return 0.0
    base = log(e - 1 + log(C / max(1, C - LC) * LC + share * C + e))
    return C / max(1, T) * log(max(1.0, C / max(1, LC) * max(1, T) / max(1, LT))) / base


def measure(root: _Node, nodes: list[_Node]) -> _Node:
    """Fills in every node's counts, density and sum; returns the body. ``kept`` and ``kept_links`` leave out what is out."""
    for n in reversed(nodes):  # children before parents
        own = n.own()
        n.C += own
        n.kept += 0 if n.out else own
        if n.tag == "a":
            n.LC, n.LT, n.kept_links = n.C, n.LT + 1, n.kept
        if p := n.parent:
            p.C, p.T, p.LC, p.LT = p.C + n.C, p.T + n.T + 1, p.LC + n.LC, p.LT + n.LT
            p.kept, p.kept_links = p.kept + n.kept, p.kept_links + n.kept_links
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.LC / max(1, body.C)
    for n in nodes:
        n.density = density(n.C, n.T, n.LC, n.LT, share)
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, _Node)) + n.own()
    return body


def select(root: _Node, nodes: list[_Node]) -> list[_Node]:
    """The elements whose text is the main text, in page order."""
    body = measure(root, nodes)
    core, top = None, 0.0
    for n in nodes:
        if n.kept and not n.out and (core is None or n.total > top):
            core, top = n, n.total
    if core is None:
        return []
    path = [core]
    while path[-1].parent and path[-1] is not body:
        path.append(path[-1].parent)
    if core is body or core is root:
        low = core.density
        for k in core.kids:
            if isinstance(k, _Node) and 2 * k.kept_links > k.kept and k.density < low:
                k.out = True
        return [core]
    at = 0
    while at + 1 < len(path) and path[at + 1] not in (body, root):
        inner, outer = path[at], path[at + 1]
        if any(isinstance(k, _Node) and k is not inner and not k.out and 2 * k.kept_links > k.kept for k in outer.kids):
            break
        at += 1
    low = min(n.density for n in path[at:])
    taken = {id(path[at])}
    for inner, outer in zip(path[at:], path[at + 1 :]):
        taken |= {id(k) for k in outer.kids if isinstance(k, _Node) and k is not inner and k.kept and not k.out and k.density >= low}
    return [n for n in nodes if id(n) in taken]


def blocks(node: _Node, out: list[str]) -> None:
    """Appends the node's blocks; walks without recursion, as pages can nest very deep."""
    line: list[str] = []

    def flush() -> None:
        if done := " ".join("".join(line).split()):
            out.append(done)
        line.clear()

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is _EDGE:
            flush()
        elif isinstance(k, str):
            line.append(k)
        else:
            if k.tag in BLOCK:
                flush()
                todo.append(_EDGE)
            if not k.out:
                todo += reversed(k.kids)
    flush()


def main_text(html: str) -> str:
    if not html:
        return ""
    out: list[str] = []
    for node in select(*parse(html)):
        blocks(node, out)
    return "\n".join(out)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(cols: list[list]) -> dict[str, list]:
        texts = [main_text(h) for h in cols[2]]
        return {"page_id": cols[0], "url": cols[1], "text": texts, "n_chars": list(map(len, texts))}

    return map_texts(table(spark, sf_dir, "pages"), ["page_id", "url"], "html", kernel, SCHEMA)
