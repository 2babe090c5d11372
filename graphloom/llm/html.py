"""Main-text extraction by tree scoring (operator 1).

A page becomes a light tree. Parts that cannot be the article are cut off: by element or role (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles) or by a class or id that names one. A name that holds such a word
among others ("related-work", "notice-period") cuts a part only if it is mostly links or a few words. Every paragraph
passes points for its length and commas to its ancestors, less with distance; a container's points are discounted by its
link density. The best container and those of its siblings that score near it, or are prose themselves, are kept, with
the headings, lists and loose text between them.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed in page order. Nothing else is dropped or capped: hidden parts and an object's fallback are text; only what
audio, video and canvas hold for browsers without them is a notice.

Defined cases: a null or empty page, or one without text outside the parts cut off, gives an empty text; unclosed and
misnested tags are closed as browsers roughly do, an attribute's open quote ends at the tag's end if it never closes;
of containers of equal worth the first in page order wins; repeated rows get equal results; a page of any length is one
row's work in one pass over its tags, each with a bounded look at what is open; pages' columns travel in a struct, so
their names clash with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|!\[CDATA\[|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|[\"'][^>]*+)?)?)")
# Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CUT = frozenset("head nav footer aside form script style noscript iframe textarea title button select option template svg math dialog menu audio video canvas fieldset header".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status tooltip".split())
ENDS_P = BLOCK - frozenset(("body", "html"))
P_SCOPES = ("td", "th", "li", "div", "section", "article", "main", "table", "body", "blockquote", "html", "object")
LEAVES = frozenset("p pre blockquote td th dd dt li h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BETWEEN = HEADINGS | frozenset("p pre blockquote ul ol dl table figure hr".split())
# Words in class and id names. ALWAYS cuts in any company; CUT_WORDS alone or with PLAIN words.
ALWAYS = frozenset("comments comment commentlist disqus respond replies ad ads adsense adslot advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies gdpr newsletter sidebar outbrain taboola".split())
CUT_WORDS = ALWAYS | frozenset(
    "adv promo promos promotion promotions banner banners side consent notice notices alert alerts notification notifications subscribe subscription subscriptions signup login popup popups modal modals overlay overlays "
    "share sharing social related recommend recommended recommendation recommendations breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer header masthead toolbar widget widgets disclaimer copyright skip".split()
)
PLAIN = frozenset("bar bars site page global top bottom left right inner outer box boxes wrap wrapper container block blocks list lists item items section area row col column link links post posts article articles content main module panel unit slot form text title button buttons body big small sticky fixed up in out to author bio tag tags more also the you we media icon icons group".split())
KEEP_NAMES = re.compile(r"(?:^|[\s_-])(?:article|article-?body|main|content|post|post-?body|post-?content|entry|entry-?content|story|body-?text)(?:$|[\s_-])", re.I)
PRIOR = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "li": -3.0}
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
FEW_WORDS = 12
SIBLING_SHARE = 0.2  # of the best container's worth
LIKE_SCOPES = ("ul", "ol", "menu", "dl", "table", "select", "body", "html", "article")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "doubtful", "depth", "score", "chars", "links", "words", "prior", "inside")

    def __init__(self, tag: str, parent: Node | None, cut: bool, prior: float, doubtful: bool = False):
        self.tag, self.parent, self.cut, self.prior, self.doubtful = tag, parent, cut, prior, doubtful
        self.children: list = []  # nodes and strings in page order
        self.score = 0.0
        self.chars = self.links = self.words = 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.inside = tag == "article" or (parent is not None and parent.inside)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from the end of its name on, and the place after the tag."""
    out: dict[str, str] = {}
    while at < len(page):
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            break
        if m[2]:
            out.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
    return {k: entities.unescape(v) if "&" in v else v for k, v in out.items()}, at


def _named(names: str) -> int:
    """2 for a name of a part that is cut, 1 for one that holds such a word among others, else 0."""
    worst = 0
    for token in names.lower().split():
        parts = [x for x in re.split(r"[_-]+|\d+", token) if x]
        if any(x in ALWAYS for x in parts):
            return 2
        if any(x in CUT_WORDS for x in parts):
            worst = max(worst, 2 if all(x in CUT_WORDS or x in PLAIN for x in parts) and not KEEP_NAMES.search(token) else 1)
    return worst


def _verdict(tag: str, at: dict[str, str], parent: Node) -> int:
    """2: cut. 1: cut if mostly links or a few words. 0: not."""
    if parent.cut:
        return 2
    if tag in CUT and not (tag == "header" and parent.inside):  # an article's own heading block stays
        return 2
    if not at:
        return 0
    if at.get("role", "").strip().lower() in CUT_ROLES:
        return 2
    names = f"{at.get('class', '')} {at.get('id', '')}"
    if tag in ("html", "body", "article", "main", "h1"):
        return 2 if tag == "article" and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", names, re.I) else 0
    found = _named(names)
    return 0 if found == 1 and tag not in BLOCK else found


class _Open:
    """The path of open elements. What is open by name is known without walking up."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None, False, 0.0)
        self.by: dict[str, list[Node]] = {}

    def push(self, child: Node) -> None:
        self.node.children.append(child)
        self.node = child
        self.by.setdefault(child.tag, []).append(child)

    def deepest(self, tags: tuple[str, ...]) -> Node | None:
        return max((self.by[t][-1] for t in tags if self.by.get(t)), key=lambda n: n.depth, default=None)

    def close(self, last: Node) -> None:
        """Closes elements up to and with this one; each element is closed once."""
        while True:
            gone = self.node
            self.by[gone.tag].pop()
            self.node = gone.parent
            if gone is last:
                return

    def close_inside(self, tags: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        """Closes the innermost open element of these, unless one of scopes is open inside it."""
        found, scope = self.deepest(tags), self.deepest(scopes)
        if found is not None and (scope is None or scope.depth < found.depth):
            self.close(found)


def parse(page: str) -> Node:
    """The tree of a page. Text of raw elements is left out."""
    path = _Open()
    raw_ends: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            path.node.children.append(page[at:])
            break
        if m.start() > at:
            path.node.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                close = _COMMENT_END.search(page, max(m.start() + 2, at - 2))
                at = close.end() if close else end
            elif m[0] == "<![CDATA[":
                close = page.find("]]>", at)
                path.node.children.append(page[at : close if close >= 0 else end].replace("&", "&amp;"))
                at = close + 3 if close >= 0 else end
            else:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else end
            continue
        tag = m[2].lower()
        if page[at : at + 1] == ">":
            attributes, at = {}, at + 1
        else:
            attributes, at = _attributes(page, at)
        if m[1]:
            last, barrier = path.deepest((tag,)), path.deepest(("article", "main"))
            if last is not None and (tag in BLOCK or barrier is None or barrier.depth <= last.depth):
                path.close(last)
            continue
        if tag == "br":
            path.node.children.append(" ")
            continue
        if tag in ("html", "body") and path.node is path.root:
            continue
        if tag in ENDS_P:
            path.close_inside(("p",), P_SCOPES)
        if tag in LIKE:
            path.close_inside(LIKE[tag], LIKE_SCOPES + (("tr",) if tag in ("td", "th") else ()))
        if tag in VOID:
            if tag == "hr":
                path.node.children.append(Node("hr", path.node, path.node.cut, 0.0))
            continue
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
            close = None if tag in unclosed else raw_ends[tag].search(page, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else end
            continue
        verdict = _verdict(tag, attributes, path.node)
        prior = PRIOR.get(tag, 0.0)
        if attributes and not verdict and KEEP_NAMES.search(f"{attributes.get('class', '')} {attributes.get('id', '')}"):
            prior += 25.0
        path.push(Node(tag, path.node, verdict == 2, prior - 25.0 * (verdict == 1), verdict == 1))
    return path.root


def _walk(root: Node) -> Iterator[tuple[str, Node | str]]:
    """("in", node), ("text", string) and ("out", node) in page order, without parts cut off; no recursion."""
    stack: list = [("in", root)]
    while stack:
        kind, x = stack.pop()
        if kind != "in":
            yield kind, x
            continue
        if x.cut:
            continue
        yield "in", x
        stack.append(("out", x))
        stack.extend(("text", c) if isinstance(c, str) else ("in", c) for c in reversed(x.children))


def blocks(nodes: list) -> list[str]:
    """The trimmed blocks of text below the nodes."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = "".join(held)
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                out.append(text)
            held.clear()

    for top in nodes:
        if isinstance(top, str):
            held.append(top)
            continue
        for kind, x in _walk(top):
            if kind == "text":
                held.append(x)
            elif x.tag in BLOCK:
                flush()
    flush()
    return out


def _score(root: Node) -> list[Node]:
    """Gives every node its points, characters and linked characters; returns the nodes that got any."""
    scored: dict[int, Node] = {}
    open_links = 0
    own: list[tuple[Node, list[str]]] = []
    for kind, x in _walk(root):
        if kind == "in":
            open_links += x.tag == "a"
            if x.tag in BLOCK:
                own.append((x, []))
        elif kind == "text":
            n = len(x) - x.count(" ")
            if own:
                own[-1][1].append(x)
            if n:
                up = own[-1][0] if own else root
                up.chars += n
                up.links += n * (open_links > 0)
                up.words += len(x.split())
        else:
            open_links -= x.tag == "a"
            if x.tag in BLOCK and own and own[-1][0] is x:
                _, texts = own.pop()
                text = " ".join("".join(texts).split())
                if len(text) >= 25 or (text and x.tag in ("p", "pre")):
                    density = x.links / x.chars if x.chars else 0.0
                    points = (1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3.0)) * (1 - density)
                    up, step = (x.parent if x.tag in LEAVES else x), 0
                    while up is not None and step < 5:
                        up.score += points / (1, 2, 6, 9, 12)[step]
                        scored[id(up)] = up
                        up, step = up.parent, step + 1
            if x.parent is not None:
                x.parent.chars += x.chars
                x.parent.links += x.links
                x.parent.words += x.words
    return list(scored.values())


def _settle_doubts(root: Node) -> None:
    """Cuts the parts with a doubtful name that are mostly links or a few words."""
    _score(root)
    for kind, x in _walk(root):
        if kind == "out":
            if x.doubtful and (3 * x.links > x.chars or x.words < FEW_WORDS):
                x.cut = True
            x.score, x.chars, x.links, x.words = 0.0, 0, 0, 0


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by line feeds."""
    if not page:
        return ""
    root = parse(page)
    if any(x.doubtful for kind, x in _walk(root) if kind == "in"):
        _settle_doubts(root)
    scored = _score(root)
    if not scored:
        return "\n".join(blocks([root]))
    density = lambda n: n.links / n.chars if n.chars else 0.0
    worth = lambda n: (n.score + n.prior) * (1 - density(n))
    best = max(scored, key=worth)
    up = best
    while up is not None:  # a part of an article stands for the whole
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None:
        return "\n".join(blocks([best]))
    least = SIBLING_SHARE * worth(best)
    whole = best.tag in ("article", "main")
    beside = [x for x in best.parent.children if isinstance(x, str) or not x.cut]

    def joins(x: Node | str) -> bool:
        if isinstance(x, str):
            return False
        prose = x.tag == "p" and not whole and ((x.chars > 80 and density(x) < 0.25) or (0 < x.chars <= 80 and density(x) == 0))
        alike = x.tag == best.tag or (not whole and x.tag in ("div", "section", "article", "blockquote", "pre", "td"))
        return x is best or prose or bool(alike and x.score and not x.doubtful and density(x) < 0.4 and worth(x) >= least)

    chosen = [i for i, x in enumerate(beside) if joins(x)]
    first, last = chosen[0], chosen[-1]
    while not whole and first and (isinstance(beside[first - 1], str) or beside[first - 1].tag in HEADINGS):
        first -= 1
    between = lambda x: isinstance(x, str) or ((x.tag in BETWEEN or x.tag not in BLOCK) and density(x) < 0.4)
    kept = [x for i, x in enumerate(beside) if i in chosen or (not whole and first <= i <= last and between(x))]
    return "\n".join(blocks(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns row (the pages' columns, or those in keep), text and n_chars."""
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or pages.columns)]).alias("row")
    staged = pages.select(row, F.col(f"`{html}`").alias("_html"))
    schema = T.StructType([staged.schema.fields[0], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return staged.mapInArrow(_extract, schema)
