"""Main text of web pages, by scoring the tree of their elements."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.frames import slices

# Element names of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select audio video noframes xmp".split())
INLINE = frozenset(
    "b i em strong u s strike small font mark sub sup abbr acronym cite q code kbd samp var tt big time bdi bdo ins del dfn data label ruby rt rp center".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead tfoot caption".split()
) | HEADINGS
APART = frozenset("nav footer aside form button dialog menu fieldset".split())
# Words in class, id and role that tell what is not the article.
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored sponsors promo promos promotion promotions "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer foot colophon header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall "
    "comment comments commentlist reply replies respond disqus discussion remark feedback guestbook "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login signin register "
    "pagination pager widget widgets rail tags skip search searchform outbrain taboola form complementary contentinfo".split()
)
# What a class or id inside an article must be made of, wholly, to name a container of clutter:
# one word of KINDS at least, and PARTS. A word that stands alone may also be what the text is about, in an id most of all.
KINDS = frozenset(
    "comment comments share sharing social related recommended recommendations newsletter subscribe subscription signup cookie cookies consent "
    "ad ads advert advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs sidebar pagination pager nav navigation footer tags reply disqus".split()
)
PARTS = frozenset(
    "bar buttons button btn btns icons links list area section wrapper wrap container holder box block panel module widget widgets form thread posts articles "
    "stories items banner notice popup modal unit slot rail reader user post page article entry story site top bottom left right js wp".split()
)
ALONE_ID = frozenset("comments commentlist respond disqus sidebar outbrain taboola".split())
ALONE_CLASS = ALONE_ID | frozenset(
    "share sharing sharebar social related recommended newsletter subscribe signup ad ads adv advert adverts advertisement adsense adbox sponsored promo "
    "breadcrumb breadcrumbs sidebars pagination pager nav navbar menu submenu toolbar footer tags widget widgets popup modal paywall replies searchform "
    "notice notices notification notifications alert banner banners".split()
)
#: Classes that alone name what others have placed on the page, on any of these elements and anywhere.
PLACED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper sponsored "
    "cookie-notice cookie-banner cookie-bar cookie-consent cookie-message cookies-notice gdpr-notice".split()
)
PLACES = frozenset("p span div li section a figure".split())
ROLES = frozenset("navigation complementary search contentinfo dialog alertdialog menu menubar toolbar".split())
#: Elements that a name can drop inside an article, and those that none drops anywhere.
CONTAINERS = frozenset("div section ul ol dl details".split())
PROSE = frozenset("article p pre blockquote".split()) | HEADINGS
# Words that tell where the article is.
GOOD = frozenset("article content body entry post story main text blog page hentry".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|([^>]*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Class names of what surrounds clutter or does without it.
_NEGATED = re.compile(r"(?:^|[-_])(?:no|not|has|with|without)[-_]", re.I)
#: Class names of what an article is about.
_TOPIC = re.compile(r"(?:category|cat|tag|topic|author|format|type|status)[-_]", re.I)
_COMMA = re.compile(r"[,、،，]")

#: Characters of a paragraph that passes points on, of one that is kept beside the container, and ancestors that get points.
PARAGRAPH, BESIDE, LEVELS = 25, 80, 16

# Which open elements a start tag ends, and at which element the search for them stops.
_LI, _DD, _TR, _TD = range(2, 6)
_ENDS = ((_LI, frozenset({"li"}), frozenset({"ul", "ol", "menu"})), (_DD, frozenset({"dd", "dt"}), frozenset({"dl"})),
         (_TR, frozenset({"tr"}), frozenset({"table"})), (_TD, frozenset({"td", "th"}), frozenset({"tr", "table"})))
_ENDED = {"li": _LI, "dd": _DD, "dt": _DD, "tr": _TR, "td": _TD, "th": _TD}
_SCOPE = frozenset("td th table caption html body article section div blockquote li main".split())


class Node:
    """An element: its children in order, texts among them, and what the parsing and scoring need of it.

    ``near`` has the nearest open elements, itself among them, that a start tag below may end: a paragraph, a
    paragraph or heading, and those of lists and tables. They are handed down, so that no search walks up the tree.
    """

    __slots__ = ("tag", "parent", "children", "points", "names", "dropped", "near", "in_article", "cleared", "chars", "links", "keeper")

    def __init__(self, tag: str, parent: "Node | None", names: frozenset[str] = frozenset(), dropped: bool = False):
        self.tag, self.parent, self.names, self.dropped = tag, parent, names, dropped
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.links = 0
        self.keeper: Node | None = None
        self.cleared = False
        self.in_article = tag == "article" or parent is not None and parent.in_article
        above = parent.near if parent is not None else (None,) * 6
        if tag == "p":
            near = [self, self]
        elif tag in HEADINGS:
            near = [above[0], self]
        else:
            near = [None, None] if tag in _SCOPE else [*above[:2]]
        near += [self if tag in ends else None if tag in stops else above[kind] for kind, ends, stops in _ENDS]
        self.near = tuple(near) if near != list(above) else above


def _names_clutter(key: str, token: str, words: list[str], strict: bool) -> bool:
    """Whether a class, id or role names what is not part of an article; ``strict`` for elements that are inside one."""
    if _NEGATED.search(token) or key == "class" and _TOPIC.match(token):
        return False
    if not strict:
        # An id is a name of its own element: all of it has to fit.
        fit = [w in CLUTTER or key == "id" and w in PARTS for w in words]
        return any(w in CLUTTER for w in words) and (key != "id" or all(fit))
    if key == "role":
        return token.lower() in ROLES
    words = [w for w in words if len(w) > 1]
    if len(words) == 1:
        return words[0] in (ALONE_ID if key == "id" else ALONE_CLASS)
    return any(w in KINDS for w in words) and all(w in KINDS or w in PARTS for w in words)


def _clutter(tag: str, attributes: str, inside_article: bool, inside_prose: bool = False) -> tuple[frozenset[str], bool]:
    """The words of an element's names, and whether the element is not part of an article.

    Names drop no article, heading or paragraph and nothing in one; in an article and for sections, whose
    ids come from their headings, they drop containers by their whole name only."""
    tokens: list[tuple[str, str, list[str]]] = []
    hidden = tag in APART or tag == "header" and not inside_article
    if attributes:
        for key, double, single, bare in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), double or single or bare
            if key in ("class", "id", "role"):
                tokens += [(key, token, [w.lower() for w in _WORD.findall(token)]) for token in value.split()]
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    strict = inside_article or tag == "section" or any(key == "class" and token == "section" for key, token, _ in tokens)
    named = tag in CONTAINERS if strict else tag not in PROSE and not inside_prose
    clutter = named and any(_names_clutter(*token, strict) for token in tokens)
    clutter |= tag in PLACES and any(key == "class" and token.lower() in PLACED for key, token, _ in tokens)
    return frozenset(w for _, _, words in tokens for w in words), tag not in ("html", "body", "main") and (hidden or clutter)


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where each element of a name that is skipped whole starts, and where its end tag ends; those
    without an end tag are left out."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for found in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", page, re.I):
        if not found[1]:
            if not found[0].endswith("/>"):
                opened.append(found.start())
        elif opened:
            out[opened.pop()] = found.end()
    return out


def parse(page: str) -> Node:
    """A page as a tree. Tags that are missing or cross are closed where HTML would close them; what
    follows an unclosed element's last text belongs to it. Formatting elements leave no trace."""
    root = Node("html", None)
    here, at, article = root, 0, 0
    closed: dict[str, dict[int, int]] = {}
    # Open elements by name since each open body, and in all.
    opened: list[Counter[str]] = [Counter()]
    total: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        """Close ``here`` and what is open below ``node``, which stays open."""
        nonlocal article, here
        while here is not node:
            article -= here.tag in ("article", "main") and not here.dropped
            if here.tag in ("body", "html"):
                opened.pop()
            opened[-1][here.tag] -= 1
            total[here.tag] -= 1
            here = here.parent
        return here

    for found in iter(lambda: _TAG.search(page, at), None):
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            if at == found.start():
                break
            continue
        tag = name.lower()
        if tag in INLINE:
            continue
        if tag in VOID:
            if not found[1]:
                here.children.append(" ")
                if tag == "hr":
                    here.children.append(Node("hr", here))
            continue
        if tag in RAW:
            if not found[1] and not (found[3] or "").endswith("/"):
                if tag in ("script", "style"):
                    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
                else:
                    # Of an element that is never closed only the start tag is skipped.
                    if tag not in closed:
                        closed[tag] = _closed(page, tag)
                    at = max(at, closed[tag].get(found.start(), at))
            continue
        if found[1]:
            # A stray end tag inside a section does not end the section.
            if (total if tag in ("body", "html") else opened[-1])[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node.parent)
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            leave(_implied(here, tag))
        attributes = found[3] if found[3] is not None else found[4]
        words, dropped = _clutter(tag, attributes, article > 0, here.tag == "p" or here.tag in HEADINGS)
        node = Node(tag, here, words, dropped)
        here.children.append(node)
        if tag in ("article", "main") and not dropped:
            article += 1
            # A wrapper's name may sound like clutter; what holds the article is none. A comment, or an
            # article inside another, tells nothing of its wrappers.
            up = here
            if tag == "article" and words & {"comment", "comments", "reply"} or here.in_article:
                up = None
            while up is not None and not up.cleared:
                up.cleared = True
                up.dropped &= up.tag not in ("div", "section")
                up = up.parent
        if not attributes.endswith("/"):
            here = node
            total[tag] += 1
            opened[-1][tag] += 1
            if tag in ("body", "html"):
                opened.append(Counter())
    if at < len(page):
        here.children.append(page[at:])
    return root


def _implied(here: Node, tag: str) -> Node:
    """The element that stays open where ``tag`` starts."""
    ended = here.near[_ENDED[tag]] if tag in _ENDED else None
    ended = ended or here.near[1 if tag in CLOSES_P else 0]
    return ended.parent if ended is not None else here


_BLOCKS = CLOSES_P | frozenset("html body".split())


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """Blocks of text below ``top`` in page order: the element that holds each, its text with white
    space made one space, and how many of its characters are links. Dropped elements are left out."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    holder = top

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(html.unescape("".join(linked)).split()))
            out.append((holder, text, min(links, len(text))))
        parts.clear()
        linked.clear()

    todo: list[tuple[Node | str | None, Node, bool]] = [(top, top, False)]
    while todo:
        item, owner, link = todo.pop()
        if item is None:
            end()
            holder = owner
        elif isinstance(item, str):
            parts.append(item)
            if link:
                linked.append(item)
        elif not item.dropped:
            block = item.tag in _BLOCKS
            if block:
                end()
                holder = item
                todo.append((None, owner, link))
            inner = item if block else owner
            link = link or item.tag == "a"
            todo += ((child, inner, link) for child in reversed(item.children))
    end()
    return out


def _is_heading(node: Node) -> bool:
    return node.tag in HEADINGS


def extract(page: str) -> str:
    """The article's blocks, joined by an empty line; empty if there is none.

    A paragraph gives one point, one for each comma and one for each hundred characters up to three;
    its parent gets them all, the next ancestor half, those above, up to ``LEVELS``, a share that falls with the
    distance. An element's points are discounted by the share of links in its text. The best one is
    the container; siblings are kept that have a fifth of its points, or are prose or headings with
    few links. Within an ``article`` or ``main`` element around the container all is kept.
    """
    root = parse(page)
    found = blocks(root)
    if not found:
        return ""
    every = _elements(root)
    scored: dict[int, Node] = {}
    for node, text, links in found:
        node.chars += len(text)
        node.links += links
        if len(text) < PARAGRAPH or _is_heading(node) or 2 * links > len(text):
            continue
        points = 1 + len(_COMMA.findall(text)) + min(len(text) // 100, 3)
        # Text that stands in a container without a paragraph of its own counts for the container.
        up, level = (node.parent if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") else node), 0
        while up is not None and level < LEVELS:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(up)] = up
            up, level = up.parent, level + 1
    for node in reversed(every):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links

    def density(node: Node) -> float:
        return node.links / node.chars if node.chars else 0.0

    def value(node: Node) -> float:
        return node.points * (1 - density(node)) * (1.25 if node.names & GOOD or node.tag in ("article", "main") else 1)

    if scored:
        best = max(scored.values(), key=value)
    else:
        best = next((n for n, _, _ in found if n.tag in ("article", "main")), root)
    whole: Node | None = best
    while whole is not None and whole.tag != "article":
        whole = whole.parent
    if whole is None:
        whole = best
        while whole is not None and whole.tag != "main":
            whole = whole.parent
    if whole is not None:
        if whole.tag != "article":
            inner = _only_article(whole)
            whole = inner or whole
        kept = {id(whole)}
    else:
        kept = {id(best)}
        least = max(2.0, 0.2 * value(best))
        for other in best.parent.children if best.parent is not None else []:
            if isinstance(other, str) or other is best or other.dropped:
                continue
            size = other.chars
            prose = other.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and density(other) < 0.25 and (size >= BESIDE or other.tag == "p" and size > 0)
            if id(other) in scored and value(other) >= least or prose or _is_heading(other) and density(other) < 0.5:
                kept.add(id(other))
    for node in every:
        node.keeper = node if id(node) in kept else node.parent.keeper if node.parent is not None else None
    out = []
    for node, text, links in found:
        up = node.keeper
        # In an article, or the container found, linked items are its references; in a bare body they may be menus.
        loose = up is not None and up.tag in ("html", "body") and node.tag in ("li", "div", "ul", "nav")
        if up is not None and not (loose and links and 10 * links >= 9 * len(text)):
            out.append(text)
    return "\n\n".join(out)


def _elements(root: Node) -> list[Node]:
    """All elements, each after its parent."""
    out = [root]
    for node in out:
        out += [child for child in node.children if isinstance(child, Node)]
    return out


def _only_article(node: Node) -> Node | None:
    """The one article below ``node``, if it is the only one."""
    found: list[Node] = []
    todo = [node]
    while todo:
        item = todo.pop()
        for child in item.children:
            if isinstance(child, Node) and not child.dropped:
                found += [child] if child.tag == "article" else []
                todo.append(child)
    return found[0] if len(found) == 1 else None


def extract_text(pages: DataFrame, page: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``pages`` without the page itself (or those in ``carry``), with ``text``: the
    main text of each whole page.

    Null and empty pages and pages without an article have an empty text. Pages may be cut off
    anywhere and of any length. Repeated rows get the same text each. Input columns named ``text`` are
    replaced. Nothing is shuffled.
    """
    names = [c for c in (pages.columns if carry is None else carry) if c != "text" and (carry is not None or c != page)]
    held = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{page}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = pa.array([extract(p) if p else "" for p in part.column("html").to_pylist()], pa.string())
                carried = [c for c in part.schema.names if c != "html"]
                yield pa.RecordBatch.from_arrays([*map(part.column, carried), texts], [*carried, "text"])

    out = held.mapInArrow(run, T.StructType([*held.schema.fields[:-1], T.StructField("text", T.StringType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "text")
