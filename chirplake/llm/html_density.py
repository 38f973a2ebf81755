"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import bounded_batches

#: A start tag as it is mostly written: its name, its attributes and whether a slash ends it. It never looks beyond the next "<".
_START = re.compile(r"""<([a-zA-Z][^\s/><]*+)((?:\s++[^\s=/>"'<]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=]++))?+)*+\s*+(/?+))>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE_NAME = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: A decimal character reference of more digits than any character needs.
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,});?")
_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
#: Elements that begin a block of text of their own.
BLOCKS = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
#: Elements that hold no text to read: they are not measured.
UNREAD = _words("script style noscript template iframe object embed svg math canvas audio video button select option input textarea dialog head title map")
#: Elements beside a main text.
BESIDE = _words("nav footer aside form menu")
_CLOSES_P = BLOCKS - _words("td th tr tbody thead tfoot caption body html")
#: An open element that a start tag ends, and the elements beyond which it is not sought.
_ENDS = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr td th"), _words("table tbody thead tfoot")),
    "td": (_words("td th"), _words("table tr")),
    "th": (_words("td th"), _words("table tr")),
    "option": (_words("option"), _words("select datalist")),
}
#: Parts of a class or id that mark what is not main text, if all other parts only say where or what kind of box it is.
_NOISE_PART = re.compile(
    r"ads?|advert(?:s|isements?|ising)?|adsense|banners?|sponsor(?:s|ed)?|promos?|promotions?|sidebars?|menus?|navs?|navbar|navigation|breadcrumbs?|footers?|masthead|topbar|toolbars?|"
    r"cookies?(?:bar|banner|notice|consent)?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ptions?)|signup|login|paywall|share|sharing|social|"
    r"comments?|comment(?:list|form)|disqus|replies|respond|related|recommend(?:ed|ations?)?|widgets?|pagination|paginator|pager|search(?:bar|box|form)?|skip(?:link|nav)?|hidden|complementary|contentinfo|dialog",
)
_BOX_PARTS = _words(
    "site page main top bottom left right upper lower primary secondary global mobile desktop sticky fixed side bar container wrapper wrap box area section block inner outer "
    "list item items link links button buttons icon icons form field panel group row column col text title heading header content thread count unit slot media nav"
)
_ARTICLE_PARTS = _words("post posts article articles entry story stories blog user reader news")
#: Names whose parts say nothing by themselves.
_NOISE_TOKENS = _words("side-bar visually-hidden sr-only sign-up log-in")
_HEADER_PARTS = _words("header headers")
_HEADINGS = _words("h1 h2 h3 h4 h5 h6")
_NOISE_ROLES = _words("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar")
_WHOLE = _words("html body main article")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("children", "chars", "density", "in_link", "link_chars", "link_tags", "named", "noise", "own_noise", "parent", "silent", "sum", "tag", "tags", "unread")

    def __init__(self, tag: str, parent: Node | None, own_noise: bool, named: bool | str = False, unread: bool = False) -> None:
        self.tag, self.parent, self.own_noise, self.named = tag, parent, own_noise, named
        self.unread = unread or (parent is not None and parent.unread)
        self.noise = own_noise or (parent is not None and parent.noise)
        self.silent = False
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _marks_noise(token: str, in_article: bool) -> bool:
    """Whether a whole class or id token names what is not main text; a slug or the name of a layout does not."""
    if token in _NOISE_TOKENS:
        return True
    parts = [p for p in re.split(r"[_\-:.]+", token) if p and not p.isdigit()]
    parts = [p.rstrip("0123456789") or p for p in parts]
    noise = [_NOISE_PART.fullmatch(p) is not None for p in parts]
    if any(noise):
        return all(n or p in _BOX_PARTS or p in _ARTICLE_PARTS for n, p in zip(noise, parts, strict=True))
    if in_article or token == "site-head":
        return not in_article
    return any(p in _HEADER_PARTS for p in parts) and all(p in _HEADER_PARTS or (p in _BOX_PARTS and p not in ("content", "section")) for p in parts)


#: A section of an article that only its id marks: a box, or a chapter whose heading has such a word.
SLUG = "slug"
#: An element whose names say that it holds what readers wrote.
READERS = "readers"
_READERS = re.compile(r"comment|disqus|repl|respond")


def _marks(tag: str, names: dict[str, str], in_article: bool) -> tuple[bool, bool | str, bool]:
    """Whether an element is marked as no main text, whether only its names (``SLUG``: only its id, in a section of an article) say so, and whether it is not for reading at all."""
    if tag in UNREAD:
        return True, False, True
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(names.get("style", "")):
        return True, False, True
    if tag in BESIDE or (tag == "header" and not in_article):
        return True, False, False
    if not names or tag in _WHOLE:
        return False, False, False
    if names.get("role", "").lower() in _NOISE_ROLES:
        return True, False, False
    marks = [t for t in names.get("class", "").lower().split() if _marks_noise(t, in_article)]
    named: bool | str = READERS if any(map(_READERS.match, marks)) else bool(marks)
    if not named and tag not in _HEADINGS:  # a heading's id is a slug of its text
        slugs = [t for t in names.get("id", "").lower().split() if _marks_noise(t, in_article)]
        named = READERS if any(map(_READERS.match, slugs)) else bool(slugs)
        if named is True and tag == "section" and in_article:
            return True, SLUG, False
    return bool(named), named, False


class Scanner:
    """Tags of a page from left to right. Whatever the page, no character is looked at more than a few times."""

    def __init__(self, html: str) -> None:
        self.html = html
        self._last = {c: html.rfind(c) for c in "\"'>"}

    def start_tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """Name, attributes, whether a slash ends it, and end of the start tag at ``at``; None if it never ends."""
        if (found := _START.match(self.html, at)) is not None:
            names: dict[str, str] = {}
            if found.end(1) < found.end(2):
                for key, a, b, c in _ATTRIBUTE.findall(found[2]):
                    names.setdefault(key.lower(), a or b or c)
            return found[1].lower(), names, bool(found[3]), found.end()
        html, names = self.html, {}
        name = _NAME.match(html, at + 1)
        place = name.end()
        while place <= self._last[">"]:
            key = _ATTRIBUTE_NAME.match(html, place)
            if key is None:
                end = html.find(">", place)
                return name[0].lower(), names, html[end - 1] == "/", end + 1
            place, value = key.end(), ""
            if key[2] is not None and place < len(html):
                quote = html[place]
                if quote in "\"'" and place < self._last[quote]:
                    end = html.index(quote, place + 1)
                    value, place = html[place + 1 : end], end + 1
                elif quote in "\"'":  # it is never closed: the tag ends where it can
                    place = html.find(">", place)
                    if place < 0:
                        return None
                else:
                    bare = _BARE.match(html, place)
                    value, place = bare[0], bare.end()
            names.setdefault(key[1].lower(), value)
        return None

    def after(self, at: int) -> int:
        """The place after the next ">", or -1."""
        return self.html.find(">", at) + 1 or -1 if at <= self._last[">"] else -1


class _Stack:
    """Open elements, with the places of each tag and of the blocks, so that no tag needs a search of all of them."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # elements of BLOCKS
        self.walls: list[int] = []  # those of them but for p
        self.articles = 0

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        place, tag = len(self.nodes), node.tag
        self.nodes.append(node)
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
            if tag != "p":
                self.walls.append(place)
        self.articles += tag in ("article", "main")

    def close(self, to: int) -> None:
        """Close the element at place ``to`` and all within it."""
        while len(self.nodes) > to:
            node, place = self.nodes.pop(), len(self.nodes)
            self.places[node.tag].pop()
            for some in (self.blocks, self.walls):
                if some and some[-1] == place:
                    some.pop()
            self.articles -= node.tag in ("article", "main")

    def make_room(self, tag: str) -> None:
        """Close what the start of ``tag`` ends."""
        if tag in _CLOSES_P and self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in _ENDS:
            ends, within = _ENDS[tag]
            wall = max(map(self.last, within))
            inside = [places[bisect(places, wall)] for t in ends if (places := self.places.get(t)) and places[-1] > wall]
            if inside:
                self.close(min(inside))
        if tag in BLOCKS and tag not in ("head", "html") and (head := self.last("head")):
            self.close(head)


def parse(html: str) -> Node:
    """A tree of elements and texts, with the ends that HTML lets authors leave out; in time proportional to the page, whatever it holds."""
    root = Node("#root", None, False)
    stack, scanner, at = _Stack(root), Scanner(html), 0
    while True:
        begin = html.find("<", at)
        if begin < 0:
            begin = len(html)
        here = stack.nodes[-1]
        if begin > at:
            here.children.append(html[at:begin])
        if begin == len(html):
            return root
        following = html[begin + 1 : begin + 2]
        if following == "!" or following == "?":
            if html.startswith("<!--", begin):
                short = 5 if html.startswith("<!-->", begin) else 6 if html.startswith("<!--->", begin) else 0
                end = None if short else _COMMENT_END.search(html, begin + 4)
                at = begin + short if short else end.end() if end else len(html)
            else:
                at = scanner.after(begin)
                if at < 0:
                    return root
        elif following == "/" and html[begin + 2 : begin + 3].isalpha() and html[begin + 2].isascii():
            at = scanner.after(begin)
            if at < 0:  # nor does any later tag end: the rest is text
                here.children.append(html[begin:])
                return root
            tag = _NAME.match(html, begin + 2)[0].lower()
            if tag == "br":
                here.children.append(Node("br", here, False))
            elif (place := stack.last(tag)) and (tag in BLOCKS or not stack.walls or stack.walls[-1] < place):  # the end of an inline element does not end blocks
                stack.close(place)
        elif following.isalpha() and following.isascii():
            found = scanner.start_tag(begin)
            if found is None:
                here.children.append(html[begin:])
                return root
            tag, names, slash, at = found
            if tag in ("html", "body") and stack.last(tag):
                continue
            stack.make_room(tag)
            here = stack.nodes[-1]
            node = Node(tag, here, *_marks(tag, names, stack.articles > 0))
            here.children.append(node)
            if tag in RAW:
                stop = _RAW_END[tag].search(html, at)
                inner = html[at : stop.start()] if stop else html[at:]
                if tag in ("title", "textarea"):
                    node.children.append(inner)
                at = scanner.after(stop.end()) if stop else -1
                if at < 0:
                    return root
            elif tag not in VOID and not (slash and tag not in BLOCKS and node.noise):
                stack.push(node)
        else:
            here.children.append("<")
            at = begin + 1


def _order(root: Node) -> list[Node]:
    """All nodes in page order, so parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _visible(text: str) -> int:
    return len("".join(text.split()))


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density: characters per tag, times a logarithm of how few of the characters and tags are links.

    The logarithm's base grows with the link text and, by ``ratio``, the page's
    share of link characters, with all characters. Counts of zero are one.
    """
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * lc + ratio * chars + math.e)
    return chars / t * math.log(chars / lc * t / lt) / math.log(base)


def measure(nodes: list[Node]) -> None:
    """Counts of characters, tags, link characters and link tags of all nodes (parents first), then densities and their sums. All text that is for reading counts, whatever its elements are called.

    The sum of a node adds the densities of its children; a text is a child
    without tags, of link characters if it is within a link.
    """
    for node in reversed(nodes):
        if node.unread:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.chars += _visible(child)
            elif not child.unread:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.in_link:
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body" and not n.unread), nodes[0])
    ratio = max(body.link_chars, 1) / max(body.chars, 1)
    for node in reversed(nodes):
        if node.unread or not node.chars:
            continue
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        for child in node.children:
            if isinstance(child, Node):
                node.sum += child.density
            elif n := _visible(child):
                node.sum += density(n, 0, n if node.in_link else 0, 0, ratio)


def _spare_whole_page_forms(nodes: list[Node]) -> None:
    """A form around a headline, article or main part is the page itself, not a form in it."""
    whole: set[int] = set()
    seen: set[int] = set()
    for node in nodes:
        if node.tag in ("article", "main", "h1"):
            up = node.parent
            while up is not None and id(up) not in seen:
                seen.add(id(up))
                if up.tag == "form":
                    whole.add(id(up))
                up = up.parent
    if whole:
        for node in nodes:  # parents first
            above = node.parent is not None and node.parent.noise
            node.noise = above or (node.own_noise and id(node) not in whole)


def _is_chapter(section: Node) -> bool:
    """Whether a section begins with a heading, has running text with hardly any links, and nothing to fill in or press."""
    first = next((c for c in section.children if isinstance(c, Node)), None)
    if first is None or first.tag not in _HEADINGS:
        return False
    inside = _order(section)
    if any(n.tag in ("form", "input", "button", "select", "textarea") for n in inside):
        return False
    chars = lambda some: sum(_visible(c) for n in some for c in n.children if isinstance(c, str))
    return chars(n for n in inside if n.tag == "p") > 0 and chars(n for n in inside if n.in_link) <= PLAIN * chars(inside)


def _spare_named(nodes: list[Node]) -> None:
    """An element that only its names mark is kept if it holds the article, or else the headline, or without either most of the text outside links; and so is a section of an article that only its id marks, if it is a chapter."""
    for node in nodes:  # parents first; noise by other signs alone
        node.noise = (node.own_noise and not node.named) or (node.parent is not None and node.parent.noise)
    live = [n for n in nodes if not n.noise]
    spared: set[int] = set()
    mark = next((n for n in live if n.tag in ("article", "main")), None) or next((n for n in live if n.tag == "h1"), None)
    if mark is not None:
        while mark is not None:
            spared.add(id(mark))
            mark = mark.parent
    else:
        text: dict[int, int] = {}
        for node in reversed(nodes):
            if not node.noise and node.tag != "a":
                text[id(node)] = sum(len("".join(c.split())) if isinstance(c, str) else text.get(id(c), 0) for c in node.children)
        spared = {i for i, n in text.items() if 2 * n > text[id(nodes[0])]}
    spared |= {id(n) for n in nodes if n.named == SLUG and _is_chapter(n)}
    for node in nodes:
        node.named = id(node) not in spared and node.named
        own = node.noise if not node.named else True
        node.noise = own or (node.parent is not None and node.parent.noise)


#: A marked element in the chosen subtree is no part of it if its sum of densities is less than this share of the core's.
SMALLER = 1.0
#: A parent of the core belongs to it while it is at least so dense, as a share.
CLIMB = 0.5
#: A parent below the body also belongs to it if at most this share of what it adds is link text.
PLAIN = 0.2
#: Another dense subtree is part of the text if its sum of densities is at least this share of the largest.
PART = 0.25
#: A list or box in the core that has three links or more and at least this share of link text is a menu.
MENU = 0.9
_MENUS = _words("ul ol dl div section table menu dir center")
#: Blocks of running text; the core is the element that holds them.
_TEXT = _words("p li dt dd pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption ul ol dl caption summary details")


def content_roots(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order; what is no part of it within them is marked as noise.

    Densities are taken over all that is for reading, menus and notices included.
    The node of the largest density sum, or the element that holds it if it is a
    block of text itself, is the core; an element marked as no main text by its tag,
    role or names is none. The nodes on its way up to the body belong
    to it while they are at least half as dense as the one below, or add unmarked text with
    hardly any links; of what they add, running text and what is dense is kept, so
    that a headline or a short first paragraph beside the core is, and a list of
    links or a line of small print is not. Nor is a menu in the core itself. The smallest density on the whole way is
    the threshold for what is dense, and for other parts: below nodes that reach it,
    the nodes of the largest sums are taken if these are a quarter of the core's.
    A page's first headline is kept if no part holds one. Of what is chosen so, marked
    elements go if a second sign agrees: see :func:`_is_beside`.
    """
    nodes = _order(root)
    if any(n.tag == "form" for n in nodes):
        _spare_whole_page_forms(nodes)
        for node in nodes:
            if not node.named:
                node.own_noise = node.own_noise and not (node.tag == "form" and not node.noise)
    if any(n.named for n in nodes):
        _spare_named(nodes)
    measure(nodes)
    with_text: set[int] = set()  # unmarked, and with some text that is
    for node in reversed(nodes):
        if not node.noise and any(id(c) in with_text if isinstance(c, Node) else c.strip() for c in node.children):
            with_text.add(id(node))
    live = [n for n in nodes if id(n) in with_text]
    if not live:
        return []
    core = max(live, key=lambda n: n.sum)  # the first, that is outermost, of equals
    path = [core]
    while path[-1].tag != "body" and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((n.density for n in path if n.tag not in ("html", "#root")), default=core.density)
    top = 0
    while top + 1 < len(path) and (path[top].tag in _TEXT or path[top].tag not in BLOCKS):
        top += 1
    while top + 1 < len(path):
        here, above = path[top], path[top + 1]
        if not _adds_plain_text(above, here) and above.density < CLIMB * here.density:
            break
        top += 1
    for child, node in zip(path[:top], path[1 : top + 1], strict=True):
        for other in node.children:
            if isinstance(other, Node) and other is not child and other.tag in BLOCKS and not other.noise and not _belongs(other, threshold):
                _silence(other)
    for other in core.children:
        if isinstance(other, Node) and other.tag in _MENUS and other.link_tags > 2 and other.link_chars >= MENU * other.chars:
            _silence(other)
    parts = [path[top], *_other_parts(path[-1], path[top], core, threshold)]
    inside = {id(n) for part in parts for n in _order(part)}
    if not any(n.tag == "h1" and not n.noise and id(n) in inside for n in live):
        parts += [n for n in live if n.tag == "h1" and not n.noise][:1]
    place = {id(n): k for k, n in enumerate(nodes)}
    parts.sort(key=lambda n: place[id(n)])
    for part in parts:
        _spare_large(part, core)
    return parts


def _adds_plain_text(above: Node, here: Node) -> bool:
    """Whether the unmarked text that a parent below the body adds has hardly any links."""
    if above.tag == "body":
        return False
    chars = links = 0
    for other in above.children:
        if isinstance(other, str):
            chars += _visible(other)
        elif other is not here and not other.noise:
            chars, links = chars + other.chars, links + other.link_chars
    return links <= PLAIN * chars


def _is_beside(node: Node, core: Node) -> bool:
    """The second sign against a marked element: readers wrote it, links are half of it or more, or its densities come to less than the core's."""
    return node.named == READERS or 2 * node.link_chars >= max(node.chars, 1) or node.sum < SMALLER * core.sum


def _spare_large(part: Node, core: Node) -> None:
    """Keep marked elements of a chosen subtree that no second sign is against."""
    todo = [part]
    while todo:
        node = todo.pop()
        if node.noise and (node.unread or node.silent or _is_beside(node, core)):
            continue
        if node.noise:
            node.noise = False
            for other in node.children:
                if isinstance(other, Node):
                    other.noise = other.own_noise
        todo.extend(c for c in node.children if isinstance(c, Node))


def _belongs(node: Node, threshold: float) -> bool:
    """Whether a block beside the core is running text or dense, and not mostly links."""
    if 2 * node.link_chars >= max(node.chars, 1):
        return False
    return node.density >= threshold or any(n.tag in _TEXT and not n.noise and n.chars and 2 * n.link_chars < n.chars for n in _order(node))


def _silence(node: Node) -> None:
    for n in _order(node):
        n.noise = n.silent = True


def _other_parts(body: Node, top: Node, core: Node, threshold: float) -> list[Node]:
    """Outermost nodes outside of ``top`` that have the largest sum below a node as dense as ``threshold``, if it is large enough."""
    nodes = _order(body)
    largest: dict[int, Node] = {}
    holds_top: set[int] = set()
    for node in reversed(nodes):
        best = node
        for child in node.children:
            if isinstance(child, Node) and id(child) in largest:
                if largest[id(child)].sum > best.sum:
                    best = largest[id(child)]
                if id(child) in holds_top:
                    holds_top.add(id(node))
        if node is top:
            holds_top.add(id(node))
        largest[id(node)] = best
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        if node is top or node.noise or not node.chars or node.density < threshold:
            continue
        part = largest[id(node)]
        if id(node) not in holds_top and part.sum >= PART * core.sum and 2 * part.link_chars < part.chars:
            out.append(node if part is node else part)
        else:
            todo.extend(c for c in node.children if isinstance(c, Node))
    return out


def blocks(roots: list[Node], skip_noise: bool = True) -> list[str]:
    """Texts of the blocks below the given nodes, in page order, white space turned into single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := " ".join(unescape(_LONG_NUMBER.sub("\ufffd", "".join(run))).split()):
                out.append(text)
            run.clear()

    for root in roots:
        todo: list[Node | str | None] = [root]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif not (skip_noise and item.noise) and item.tag not in ("script", "style"):
                if item.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(item.children))
        flush()
    return out


def main_text(html: str | None) -> str:
    """Main text of a page; empty if it has none."""
    return "\n\n".join(blocks(content_roots(parse(html)))) if html else ""


def page_text(html: str | None) -> str:
    """All text of a page but for scripts, styles and its head."""
    if not html:
        return ""
    root = parse(html)
    for node in _order(root):
        if node.tag in ("head", "noscript", "template", "iframe", "textarea"):
            node.children = []
    return "\n\n".join(blocks([root], skip_noise=False))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty page gives an empty text, and so does one without text. Rows
    that repeat, and null ids and urls, are carried as they are. Pages may be
    malformed in any way and of any length: a page is held whole with its tree,
    some 500 bytes a tag, and takes time in proportion to its length. An empty
    table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return bounded_batches(rows).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
