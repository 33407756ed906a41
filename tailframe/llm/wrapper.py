"""Main text of web pages by wrapper induction.

Pages of a host share a template. Every page is parsed into a DOM tree and folded: plain text
blocks of one parent are one node, and so are runs of siblings of equal shape. Folded trees of a
host are aligned by simple tree matching (a dynamic programme over child sequences that matches
most nodes) and merged into one template, whose slots count pages, characters outside and inside
links, and the texts that recur. Pages of one shape are aligned once, so all pages of a host
contribute and only distinct shapes cost a matching. Templates of parts of a host merge the same way.

The template decides. Texts that recur at one slot are constant, the rest of its characters vary. From
the root downwards, content is in the child that holds most of the varying characters outside
links, down to the node where they stand in several children or in text blocks; that node, on
every page that is aligned with it, is the content. Beside it everything goes; inside it, constant
nodes, blocks of links and slots named after chrome go unless these hold nearly all of it. Names (tags, class words) weigh in the
descent and so break ties between slots, which matters on hosts with few pages. A page on which
the template's content node is missing is its own template, less the nodes that stand beside the
content elsewhere.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stored
from .urlfilter import split_url

#: A recurring text counts for nothing in the search for the content if this many pages and this share of its
#: slot's pages have it. Inside the content it only goes if INSIDE_SHARE of the slot's pages have it: a sentence
#: that many articles share is still theirs. None goes if such texts are MOST_CONSTANT of a content node or
#: LEAST_SHARE of the pages have the same longest block (the host's pages are copies of each other then, and
#: would erase each other).
LEAST_PAGES, LEAST_SHARE, INSIDE_SHARE, MOST_CONSTANT = 4, 0.3, 0.9, 0.2
#: Texts that a slot counts at once (Misra-Gries: a text of a share above 1 / (TEXTS + 1) is never lost).
TEXTS = 8
#: Share of the varying characters that a child needs for the content to be in it.
DOMINANT = 0.7
#: How much a name weighs against characters: a slot named after chrome counts as so many times fewer.
#: A template of fewer than FEW_PAGES pages says less, so names weigh in proportion more.
NAME_WEIGHT, FEW_PAGES = 8, 10
#: Characters a page that a slot named after chrome needs to be taken for content.
LEAST_CHARS = 250
#: Pairs of nodes that one matching looks at before it matches the rest node by node, and siblings
#: beyond which those of equal shape are folded wherever they stand.
MATCH_PAIRS, SIBLINGS = 20_000, 64
#: Slots of a template; beyond it the ones on the fewest pages are forgotten.
MOST_SLOTS = 4000
#: Slots that a task holds before it passes its templates on.
HELD_SLOTS = 200_000
#: Bytes of all wrappers (as JSON) up to which they are broadcast; beyond it pages meet them by a
#: join, each host's pages dealt into parts of PART_PAGES.
BROADCAST_BYTES, PART_PAGES = 48_000_000, 2000

# Fixed values of HTML: elements by their role in layout and parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CHROME_TAGS = frozenset("nav footer aside dialog menu".split())
#: Elements without text of a page: forms, scripts, styles, media.
NO_TEXT = RAW | frozenset("form button select option input head svg canvas object embed audio video".split())
#: Blocks of running text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption hr center address details summary".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag closes, and the elements that stop the search for it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table select article section main body html div nav aside footer header".split())
#: Words in class, id or role of elements that aren't part of an article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies widget widgets toolbar pagination pager copyright search complementary contentinfo hidden".split()
)
#: Beginnings of such words, for spellings in one word (commentlist, advertbox, sidebar1).
CHROME_STARTS = ("comment", "advert", "adbox", "adslot", "sidebar", "cookie", "sponsor", "promo", "newsletter", "breadcrumb", "paginat", "notif", "subscri", "navbar", "disqus", "popup", "modal")
#: More of them outside the article, where a header is the site's.
OUTER_WORDS = CHROME_WORDS | frozenset("header masthead topbar".split())
MAIN_WORDS = frozenset("main article content post entry story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:[a-zA-Z/!?][^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "words", "items", "loose", "linked", "links", "under", "block", "plain", "fold")

    def __init__(self, tag: str, words: frozenset = frozenset()):
        self.tag, self.words = tag, words
        self.items: list[Node | str] = []
        self.fold: Fold | None = None

    def key(self) -> str:
        return self.tag + "".join("." + w for w in sorted(self.words))


def _words(attributes: str) -> frozenset:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return frozenset()
    out: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() in ("hidden", "aria-hidden"):
            if name.lower() == "hidden" or value == "true":
                out.add("hidden")
        else:
            out.update(w for w in re.split(r"[\s_-]+", value) if w and not w.isdigit())
    return frozenset(out)


def parse(source: str) -> Node:
    """A DOM tree that follows HTML's optional end tags; text is decoded."""
    root = Node("#root")
    stack, at = [root], 0

    def text(a: int, b: int):
        if b > a:
            stack[-1].items.append(html.unescape(source[a:b]))

    def close(names, scope=SCOPE):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while m := _TOKEN.search(source, at):
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPE | {"button"})
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE - set(CLOSES[tag]))
        node = Node(tag, _words(m[3]))
        stack[-1].items.append(node)
        if tag in RAW:
            end = _END[tag].search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in CLOSES_P | SCOPE | {"p", "li", "b", "i"}:
            stack.append(node)  # a slash doesn't close an HTML element
    text(at, len(source))
    return root


def pieces(items: list) -> Iterator[str]:
    """The text of items; blanks where blocks meet."""
    stack: list[Node | str] = list(reversed(items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif x.tag not in NO_TEXT:
            if x.tag not in INLINE:
                yield " "
                stack.append(" ")
            stack.extend(reversed(x.items))


def squeezed(items: list) -> str:
    return " ".join("".join(pieces(items)).split())


def worded(node: Node, inside: bool) -> bool:
    return bool(node.words & (CHROME_WORDS if inside else OUTER_WORDS)) or any(w.startswith(CHROME_STARTS) for w in node.words)


def chrome(node: Node, inside: bool) -> bool:
    """Whether a node is named after something that's not part of an article. The classes of html, body
    and main describe the whole page, so they say nothing here."""
    if node.tag in ("html", "body", "main", "#root"):
        return False
    if node.tag in CHROME_TAGS or node.words and worded(node, inside):
        return True
    return node.tag == "header" and not (inside and any(isinstance(x, Node) and re.fullmatch("h[1-6]|hgroup", x.tag) for x in walk(node)))


def marked(node: Node) -> bool:
    return node.tag in ("article", "main") or ("main" in node.words and node.tag != "body")


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.items) if isinstance(c, Node))


# --- Folded trees --------------------------------------------------------------------------

#: Keys of leaves: text blocks, blocks of links, and text that stands in a container itself.
BLOCKS, LINKS, DIRECT = "*t", "*l", "*x"


class Fold:
    """A node of a page's folded tree: the DOM nodes it stands for and what they hold."""

    __slots__ = ("key", "inner", "outer", "main", "many", "loose", "linked", "text", "doms", "kids", "shape")

    def __init__(self, key: str, dom: Node | None = None):
        self.key, self.many, self.loose, self.linked, self.text, self.kids, self.shape = key, False, 0, 0, "", [], 0
        self.doms: list[Node] = [] if dom is None else [dom]
        named = dom is not None
        self.inner, self.outer, self.main = named and chrome(dom, True), named and chrome(dom, False), named and marked(dom)


def measured(root: Node) -> list[Node]:
    """Characters, links and kinds of all nodes; the nodes that have text, parents first."""
    order, linked = [], [(root, False)]
    while linked:
        x, inside = linked.pop()
        if x.tag in NO_TEXT:
            continue
        order.append(x)
        x.under = inside = inside or x.tag == "a"
        own = sum(len(c.strip()) for c in x.items if isinstance(c, str))
        x.loose, x.linked, x.links = (0, own, 0) if inside else (own, 0, 0)
        x.links += x.tag == "a"
        linked.extend((c, inside) for c in x.items if isinstance(c, Node))
    for x in reversed(order):
        kids = [c for c in x.items if isinstance(c, Node) and c.tag not in NO_TEXT]
        for c in kids:
            x.loose, x.linked, x.links = x.loose + c.loose, x.linked + c.linked, x.links + c.links
        x.block = x.tag not in INLINE and x.tag not in VOID or any(c.block and c.loose + c.linked for c in kids)
        x.plain = x.tag in FLOW and not x.words and all(c.plain for c in kids if c.block and c.loose + c.linked)
    return order


def _joined(into: Fold, other: Fold) -> None:
    """Adds a sibling of equal shape."""
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        a.many, a.loose, a.linked, a.text = True, a.loose + b.loose, a.linked + b.linked, ""
        a.doms += b.doms
        stack.extend(zip(a.kids, b.kids, strict=True))


def folded(tree: Node) -> Fold:
    """The folded tree of a page. Nodes without text are left out."""
    order = measured(tree)
    for x in reversed(order):
        if not x.block or (x.plain and x is not tree):
            continue
        f = x.fold = Fold(x.key(), x)
        leaves: dict[str, Fold] = {}
        direct: list = []
        for c in x.items:
            if isinstance(c, Node) and c.tag in NO_TEXT:
                continue
            if isinstance(c, str) or not c.block:
                if c.strip() if isinstance(c, str) else c.loose + c.linked:
                    direct.append(c)
                    if DIRECT not in leaves:
                        leaves[DIRECT] = Fold(DIRECT)
                        f.kids.append(leaves[DIRECT])
            elif not c.loose + c.linked:
                continue
            elif c.plain:
                key = LINKS if c.links > 1 and c.linked >= 4 * c.loose else BLOCKS
                if key not in leaves:
                    leaves[key] = Fold(key)
                    f.kids.append(leaves[key])
                leaves[key].doms.append(c)
                leaves[key].loose += c.loose
                leaves[key].linked += c.linked
            elif f.kids and f.kids[-1].shape == c.fold.shape:
                _joined(f.kids[-1], c.fold)
            else:
                f.kids.append(c.fold)
        if direct:
            d = leaves[DIRECT]
            d.text = squeezed(direct)
            d.linked = sum((len(c.strip()) if x.under else 0) if isinstance(c, str) else c.linked for c in direct)
            d.loose = max(len(d.text) - d.linked, 0)
        if len(f.kids) > SIBLINGS:
            first: dict[int, Fold] = {}
            for k in f.kids:
                if k.shape in first and k.doms:
                    _joined(first[k.shape], k)
                else:
                    first.setdefault(k.shape, k)
            f.kids = list(first.values())
        for k in f.kids:
            if not k.shape:
                k.shape = hash(k.key)
        f.shape = hash((f.key, *(k.shape for k in f.kids)))
    return tree.fold


# --- Templates -----------------------------------------------------------------------------


class Slot:
    """A node of a host's template."""

    __slots__ = ("key", "inner", "outer", "main", "many", "pages", "loose", "linked", "texts", "kids")

    def __init__(self, key: str, inner: bool = False, outer: bool = False, main: bool = False):
        self.key, self.inner, self.outer, self.main, self.many, self.pages, self.loose, self.linked = key, inner, outer, main, False, 0, 0, 0
        self.texts: dict[int, list[int]] = {}  # digest -> [pages, characters]
        self.kids: list[Slot] = []

    def count(self, digest: int, pages: int, size: int) -> None:
        held = self.texts
        if digest in held:
            held[digest][0] += pages
        elif len(held) < TEXTS:
            held[digest] = [pages, size]
        else:
            less = min(pages, *(v[0] for v in held.values()))
            for k in list(held):
                held[k][0] -= less
                if not held[k][0]:
                    del held[k]
            if pages > less:
                held[digest] = [pages - less, size]

    def add_page(self, f: Fold) -> None:
        self.pages += 1
        self.many |= f.many
        self.loose += f.loose
        self.linked += f.linked
        if f.text:
            self.count(digest_of(f.text), 1, len(f.text))

    def add(self, other: Slot) -> None:
        self.pages += other.pages
        self.many |= other.many
        self.loose += other.loose
        self.linked += other.linked
        for k, (n, size) in other.texts.items():
            self.count(k, n, size)

    def linked_share(self) -> float:
        below = flat(self)
        linked, loose = sum(x.linked for x in below if x.key[0] == "*"), sum(x.loose for x in below if x.key[0] == "*")
        return linked / max(linked + loose, 1)


def digest_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def dumped(top: Slot) -> str:
    """Slots in order, each with its number of children."""
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        out.append([x.key, x.inner + 2 * x.outer + 4 * x.main + 8 * x.many, x.pages, x.loose, x.linked, [[k, *v] for k, v in x.texts.items()], len(x.kids)])
        stack.extend(reversed(x.kids))
    return json.dumps(out, separators=(",", ":"))


def loaded(text: str) -> Slot:
    top, open_ = None, []
    for key, bits, pages, loose, linked, texts, n in json.loads(text):
        x = Slot(key, bool(bits & 1), bool(bits & 2), bool(bits & 4))
        x.many, x.pages, x.loose, x.linked = bool(bits & 8), pages, loose, linked
        x.texts = {k: v for k, *v in texts}
        if top is None:
            top = x
        else:
            while not open_[-1][1]:
                open_.pop()
            open_[-1][0].kids.append(x)
            open_[-1][1] -= 1
        open_.append([x, n])
    return top


def in_order(n: int, m: int, value: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum of values of pairs (i, j) that follow each other in both lists, and such pairs."""
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, up = best[i + 1], best[i]
        for j in range(m):
            v = up[j] + value.get((i, j), 0)
            row[j + 1] = max(v, up[j + 1], row[j])
    out, i, j = [], n, m
    while i and j:
        if (i - 1, j - 1) in value and best[i][j] == best[i - 1][j - 1] + value[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m], out[::-1]


def by_turn(a: list, b: list) -> list[tuple[int, int]]:
    """For very long lists: the k-th of a key with the k-th of that key, as far as they keep the order."""
    from bisect import bisect_left

    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.key, []).append(j)
    for v in places.values():
        v.reverse()
    tails, ends, back, pairs = [], [], [], []
    for i, x in enumerate(a):
        if not places.get(x.key):
            continue
        j = places[x.key].pop()
        k = bisect_left(tails, j)
        back.append(ends[k - 1] if k else -1)
        pairs.append((i, j))
        tails[k:], ends[k:] = [j, *tails[k + 1 :]], [len(pairs) - 1, *ends[k + 1 :]]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def matching(a, b, limit: int = MATCH_PAIRS) -> list[tuple]:
    """Pairs of nodes of a largest top-down matching of two trees with equal root keys, parents first:
    children of matched nodes match in order, each with at most one of the same key. Beyond
    `limit` pairs nodes count as leaves in the comparison and are matched by themselves afterwards."""
    out, todo = [], [(a, b)]
    while todo:
        pairs, inner = [todo.pop()], []
        at = 0
        while at < len(pairs):
            x, y = pairs[at]
            at += 1
            if len(x.kids) * len(y.kids) + len(pairs) > limit and at > 1:
                inner.append(None)
                continue
            found = by_turn(x.kids, y.kids) if len(x.kids) * len(y.kids) > limit else [(i, j) for i, p in enumerate(x.kids) for j, q in enumerate(y.kids) if p.key == q.key]
            inner.append({(i, j): len(pairs) + k for k, (i, j) in enumerate(found)})
            pairs.extend((x.kids[i], y.kids[j]) for i, j in found)
        value, chosen = [1] * len(pairs), [[]] * len(pairs)
        for k in range(len(pairs) - 1, -1, -1):
            if inner[k]:
                x, y = pairs[k]
                if len(x.kids) * len(y.kids) > limit:
                    total, chosen[k] = sum(value[c] for c in inner[k].values()), list(inner[k])
                else:
                    total, chosen[k] = in_order(len(x.kids), len(y.kids), {ij: value[c] for ij, c in inner[k].items()})
                value[k] += total
        stack = [0]
        while stack:
            k = stack.pop()
            if inner[k] is None:
                todo.append(pairs[k])
            else:
                out.append(pairs[k])
                stack.extend(inner[k][ij] for ij in chosen[k])
    return out


def merge(slot: Slot, other: Slot | Fold) -> list[Slot]:
    """Aligns other (equal root key) with the template, adds what it lacks, and counts it. Returns the
    slots of other's nodes, in order. Nodes of one side stay as optional ones, in order."""
    found = {id(y): x for x, y in matching(slot, other)}
    out, stack = [], [other]
    while stack:
        y = stack.pop()
        x = found[id(y)]
        out.append(x)
        after = -1
        for c in y.kids:
            if id(c) in found:
                after = next(k for k, s in enumerate(x.kids) if s is found[id(c)])
            else:
                found[id(c)] = made = Slot(c.key, c.inner, c.outer, c.main)
                after += 1
                x.kids.insert(after, made)
        x.add(y) if isinstance(y, Slot) else x.add_page(y)
        stack.extend(reversed(y.kids))
    return out


def flat(top) -> list:
    out, stack = [], [top]
    while stack:
        out.append(stack.pop())
        stack.extend(reversed(out[-1].kids))
    return out


def trimmed(top: Slot) -> bool:
    """Forgets slots on few pages if there are more than MOST_SLOTS."""
    size = len(nodes := flat(top))
    while len(nodes) > MOST_SLOTS:
        least = sorted(x.pages for x in nodes)[len(nodes) // 2]
        for x in nodes:
            x.kids = [c for c in x.kids if c.pages > least]
        nodes = flat(top)
    return len(nodes) < size


class Templates:
    """The templates of hosts, as pages come in."""

    def __init__(self):
        self.tops: dict[str, Slot] = {}
        self.known: dict[str, dict[int, list[Slot]]] = {}
        self.slots = 0

    def add(self, host: str, source: str) -> None:
        f = folded(parse(source))
        top = self.tops.get(host)
        if top is None:
            top = self.tops[host] = Slot(f.key)
        known = self.known.setdefault(host, {})
        slots = known.get(f.shape)
        if slots is None:
            slots = known[f.shape] = merge(top, f)
            self.slots += len(slots)
            if len(known) % 64 == 0 and trimmed(top):
                known.clear()
        else:
            for slot, x in zip(slots, flat(f), strict=True):
                slot.add_page(x)
        longest = max((d for x in flat(f) if x.key == BLOCKS for d in x.doms), key=lambda d: d.loose, default=None)
        if longest is not None:
            top.count(digest_of(squeezed([longest])), 1, longest.loose)


# --- Decisions -----------------------------------------------------------------------------

#: What becomes of a slot's nodes: nothing is said, they are the content, they go, or they stand beside
#: the content on some page (there are too many of them for pages without it) and so aren't content.
OPEN, CONTENT, GONE, BESIDE = range(4)


def constants(x: Slot, share: float) -> set[int]:
    return set() if x.many else {k for k, (n, _) in x.texts.items() if n >= LEAST_PAGES and n >= share * x.pages}


def decided(top: Slot) -> list:
    """The wrapper: the template's slots in order, as [key, decision, digests of constant texts, number
    of children]."""
    nodes = flat(top)
    fixed = {id(x): constants(x, LEAST_SHARE) if x.key == DIRECT and x is not top else set() for x in nodes}
    varying, weight = {}, {}
    name = NAME_WEIGHT * max(1.0, FEW_PAGES / max(top.pages, 1))
    for x in reversed(nodes):
        own = 0 if x.key == LINKS else x.loose - sum(x.texts[k][0] * x.texts[k][1] for k in fixed[id(x)])
        varying[id(x)] = max(own, 0) + sum(varying[id(c)] for c in x.kids)
        inside = max(own, 0) + sum(weight[id(c)] for c in x.kids)
        named = name if x.main and not any(weight[id(c)] > varying[id(c)] for c in x.kids) else 1
        weight[id(x)] = inside * named / (name if x.outer else 1)
    root, above = top, set()
    while True:
        total = sum(weight[id(c)] for c in root.kids)
        best = max(root.kids, key=lambda c: weight[id(c)], default=None)
        if best is None or not total or best.key[0] == "*" or weight[id(best)] < DOMINANT * total:
            break
        root = best
        above.add(id(root))
    only_chrome = root.outer or (root.key.split(".")[0] in ("html", "body", "#root") and all(c.outer or c.key == LINKS for c in root.kids))
    nothing = not varying[id(root)] or (only_chrome and varying[id(root)] < LEAST_CHARS * max(root.pages, 1))
    within = flat(root)
    copies = any(n >= max(2, LEAST_SHARE * top.pages) for n, _ in top.texts.values())
    same = sum(x.texts[k][0] * x.texts[k][1] for x in within for k in fixed[id(x)])
    if copies or same >= MOST_CONSTANT * max(varying[id(root)] + same, 1):
        fixed = dict.fromkeys(fixed, set())
    else:
        for x in within:
            fixed[id(x)] &= constants(x, INSIDE_SHARE)
    what = {id(x): BESIDE if x.pages + root.pages > top.pages else OPEN for x in nodes}
    way = top
    while way is not root:
        what[id(way)] = OPEN
        way = next(c for c in way.kids if id(c) in above)
    for x in within:
        what[id(x)] = OPEN
    what[id(root)] = GONE if nothing else CONTENT
    unnamed: dict[int, int] = {}
    for x in reversed(within):
        unnamed[id(x)] = 0 if x.inner and x is not root else (varying[id(x)] if not x.kids else sum(unnamed[id(c)] for c in x.kids))
    rest = unnamed[id(root)]
    for x in within[1:]:
        if x.key == LINKS or (x.inner and varying[id(x)] <= name * rest) or (x.key[0] != "*" and x.linked_share() > 0.6):
            what[id(x)] = GONE
    return [[x.key, what[id(x)], sorted(fixed[id(x)]), len(x.kids)] for x in nodes]


class Decision:
    """A slot of a wrapper, ready for matching."""

    __slots__ = ("key", "what", "fixed", "kids")

    def __init__(self, key: str, what: int, fixed: frozenset):
        self.key, self.what, self.fixed, self.kids = key, what, fixed, []


class Wrapper:
    """A host's decisions; alignments of page shapes are kept."""

    def __init__(self, source: list):
        open_: list = []
        for key, what, fixed, n in source:
            x = Decision(key, what, frozenset(fixed))
            while open_ and not open_[-1][1]:
                open_.pop()
            if open_:
                open_[-1][0].kids.append(x)
                open_[-1][1] -= 1
            else:
                self.top = x
            open_.append([x, n])
        self.known: dict[int, list[Decision | None]] = {}

    def of(self, f: Fold) -> list[Decision | None]:
        got = self.known.get(f.shape)
        if got is None:
            found = {id(y): x for x, y in matching(self.top, f)}
            if len(self.known) > 1000:
                self.known.clear()
            got = self.known[f.shape] = [found.get(id(x)) for x in flat(f)]
        return got


def own_wrapper(f: Fold) -> Wrapper:
    """The wrapper of a page that is alone."""
    top = Slot(f.key)
    merge(top, f)
    return Wrapper(decided(top))


def induce(sources: list[str]) -> Wrapper:
    """The wrapper of the pages of a host."""
    t = Templates()
    for s in sources:
        t.add("", s)
    return Wrapper(decided(t.tops[""]))


def chosen(f: Fold, wrapper: Wrapper) -> tuple[list[Node], set[int]] | None:
    """The content nodes of a page and the ids of those inside that go. None: the content node is
    missing; nodes that stand beside the content are taken out of f then."""
    of = dict(zip(map(id, flat(f)), wrapper.of(f), strict=True))
    roots, gone, found = [], set(), False
    stack = [(f, False)]
    while stack:
        x, inside = stack.pop()
        d = of[id(x)]
        if d is not None and d.what == CONTENT:
            found, roots, inside = True, x.doms, True
        elif (d is not None and d.what == GONE) or (d is None and inside and (x.inner or x.key == LINKS)):
            found = found or not inside  # a content node that holds nothing but chrome
            gone.update(map(id, x.doms))
            continue
        if inside and len(x.kids) == 1 and x.kids[0].text and (k := of[id(x.kids[0])]) is not None and digest_of(x.kids[0].text) in k.fixed:
            gone.update(map(id, x.doms))
            continue
        stack.extend((k, inside) for k in reversed(x.kids))
    if found:
        return roots, gone
    for x in flat(f):
        x.kids = [k for k in x.kids if of[id(k)] is None or of[id(k)].what != BESIDE]
    return None


def extract(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The article of a page, its blocks joined by single spaces."""
    if not source:
        return ""
    f = folded(parse(source))
    found = chosen(f, wrapper) if wrapper is not None and wrapper.top.key == f.key else None
    roots, gone = found or chosen(f, own_wrapper(f)) or ([], set())
    out: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in NO_TEXT or id(x) in gone or (x.tag in INLINE and x.words and worded(x, True)):
            out.append(" ")
        elif x.tag in INLINE:
            stack.extend(reversed(x.items))
        else:
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.items))
    return " ".join("".join(out).split())


# --- Tables --------------------------------------------------------------------------------


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) of pages (host, html) for hosts of several pages. A task merges its pages
    by host; parts of a host meet in two steps, so that a host of all tasks doesn't meet at once."""
    ship(pages.sparkSession)
    schema = "host string, part int, template string"

    def fold_pages(batches):
        t = Templates()
        for batch in batches:
            for k in range(batch.num_rows):
                if source := batch.column(1)[k].as_py():
                    t.add(batch.column(0)[k].as_py(), source)
                if t.slots > HELD_SLOTS:
                    yield rows(t)
                    t = Templates()
        if t.tops:
            yield rows(t)

    def rows(t):
        parts = [digest_of(h) % 4096 for h in t.tops]
        return pa.RecordBatch.from_arrays([pa.array(list(t.tops), pa.string()), pa.array(parts, pa.int32()), pa.array(map(dumped, t.tops.values()), pa.string())], names=["host", "part", "template"])

    def merged(table: pa.Table) -> Slot:
        texts = sorted(table.column("template").to_pylist())
        top = loaded(texts[0])
        for text in texts[1:]:
            merge(top, loaded(text))
            trimmed(top)
        return top

    def some(table: pa.Table) -> pa.Table:
        return pa.table([table.column("host").slice(0, 1), table.column("part").slice(0, 1), pa.array([dumped(merged(table))], pa.string())], names=["host", "part", "template"])

    def all_of(table: pa.Table) -> pa.Table:
        top = merged(table)
        return pa.table([table.column("host").slice(0, 1), pa.array([json.dumps(decided(top), separators=(",", ":"))], pa.string()), pa.array([top.pages])], names=["host", "wrapper", "pages"])

    partial = pages.select("host", "html").mapInArrow(fold_pages, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)).cast("int"))
    partial = partial.groupBy("host", "part").applyInArrow(some, schema)
    return partial.groupBy("host").applyInArrow(all_of, "host string, wrapper string, pages long").where("pages > 1")


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of df: id, url, text (the article; empty if none) and n_chars.

    Null or empty html gives an empty text. Pages without a host (null url, no ://) share the
    empty host. Repeated rows get equal results. Pages of any length are read whole, one at a time.
    Other columns aren't read, so their names can't clash. An empty table gives an empty one.
    Truncated markup is read as far as it goes. Between slots of equal weight the first one wins.
    """
    spark = df.sparkSession
    ship(spark)
    schema = T.StructType([df.schema[id_col], df.schema[url_col], T.StructField("html", T.StringType()), T.StructField("host", T.StringType())])

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([split_url(u)[0] for u in batch.column(1).to_pylist()], pa.string())], names=schema.fieldNames())

    pages = df.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html")).mapInArrow(hosts, schema)
    found = stored(wrappers(pages), "wrappers").withColumnRenamed("host", "of")
    size = found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("of")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(found.select("of", "wrapper")), F.col("host") == F.col("of"), "left")
    else:
        parts = F.ceil(F.col("pages") / F.lit(PART_PAGES)).cast("int")
        sizes = F.broadcast(found.where(parts > 1).select(F.col("of").alias("big"), parts.alias("parts")))  # hosts of over PART_PAGES pages only
        dealt = pages.join(sizes, F.col("host") == F.col("big"), "left").withColumn("part", F.pmod(F.xxhash64(id_col, url_col), F.coalesce("parts", F.lit(1))).cast("int"))
        copies = found.select("of", "wrapper", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of_part"))
        joined = dealt.join(copies, (F.col("host") == F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    result = T.StructType([df.schema[id_col], df.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        known: dict[str | None, Wrapper | None] = {None: None}
        for batch in batches:
            texts = []
            for source, w in zip(batch.column(2), batch.column(3), strict=True):
                w = w.as_py()
                if w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = Wrapper(json.loads(w)) if w else None
                texts.append(extract(source.as_py(), known[w]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=result.fieldNames())

    return joined.select(id_col, url_col, "html", "wrapper").mapInArrow(run, result)
