"""HTML extraction by wrapper induction.

Every host has up to REFERENCES reference pages. Each page's tree of block elements is generalised (repeated siblings of
one label and like children become one node) and aligned with the references' by simple tree matching: nodes match only
under matched parents and in order, and the alignment with most matched nodes wins. An aligned node belongs to a slot,
the reference's path to it; pages unlike all references take their own paths. Over all pages of a host it is counted in
how many different articles each text of a slot stands (pages that share the blocks of their largest slot are one
article, so a page that stands in many copies is no template):

- a text that stands in CONSTANT of a host's articles is template wherever it is in the slot;
- a slot of which the share RECURS or more of the other texts stand in several articles (AGAIN, or CONSTANT of them on a
  small host) is template as a whole: menus, adverts and footers that alternate. Versions of an article recur, too, so
  this never deletes what the names call article, nor a slot with most of a page's text;
- a slot with at least ENOUGH texts of which hardly any recur (VARIES) is content, whatever its names are;
- of all other nodes, on hosts with few pages, elements, roles and class names decide.

A page's text is its content slots, and of the undecided nodes those that stand in its main regions (all outermost
``article``, ``main`` or the like; where there is none, the smallest node that holds most of the text) and whose
element, role or class doesn't say menu, header, footer, sidebar, notice, advert, form or comment.

Null or empty pages give an empty text; a null or malformed url has the empty host, like all such pages. Repeated rows
stay, other columns are ignored. Trees may be of any depth and width: nodes of a generalised tree have few children, and
an alignment of more than CELLS cells is given up, which leaves the page its own paths. References and templates are broadcast if they measure at
most BROADCAST_BYTES, which is checked; beyond that pages are joined with them by host, salted, so that a host with
many pages isn't one task.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter, ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut_lineage, map_arrow

TYPICAL, REFERENCES = 3000, 4
CONSTANT, RECURS, VARIES, ENOUGH = 0.3, 0.4, 0.08, 20
#: A text recurs if it stands in so many articles: a share of the host's, two at least and AGAIN at most.
AGAIN = 6
#: From so many articles of a host on, class names alone keep no recurring text.
MANY = 40
BROADCAST_BYTES, SALTS = 32 << 20, 32
#: Siblings are told apart by their runs up to so many; alignments by so many table cells; scans of tags that never close.
RUNS, CELLS, SCANS = 32, 500_000, 8
#: What a worker remembers, for speed alone: start tags of up to so many characters, and alignments of so many nodes.
REMEMBERED, ALIGNED = 500, 200_000

# Element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg title".split())
BLOCK = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre blockquote article main section header footer nav aside form fieldset figure figcaption address details summary dialog center hr menu search".split())
BOILERPLATE = frozenset("nav footer aside form button select dialog menu search label option".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus discussion sidebar side aside rail related recommended recommendations recirculation more teaser menu menus nav navbar navigation topbar breadcrumb breadcrumbs crumbs footer foot footnav masthead toolbar pagination pager paging search searchbox widget widgets copyright legal disclaimer tags tagcloud byline skip hidden".split()
)
#: Words that may stand beside a telling one in a class name, and telling words that say little inside an article.
BESIDE = frozenset("block box wrap wrapper wrapping container section list area bar links link buttons button form item items unit slot top bottom left right site page inner outer main primary secondary js col column panel zone region group row icon icons icn btn btns nav header footer".split())
VAGUE = frozenset("legal notice notices notification alert side more tags skip rail hidden discussion paging search banner pager menu menus teaser popup modal overlay reply replies respond aside consent login signup toolbar copyright disclaimer widget widgets".split())
HEADS = frozenset(("header", "head", "heading"))
MAIN = frozenset("article post entry content story main articlebody maincontent posting".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
STOPS = frozenset("html body div ul ol dl table td th article main section header footer nav aside form blockquote figure fieldset details".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|(\Z))", re.DOTALL)
_QUOTED = re.compile(r"=\s*(\"[^\"]*\"|'[^']*')|>|\Z", re.DOTALL)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
_NONE_OPEN = dict.fromkeys((*BLOCK, *(tag for tags in CLOSES.values() for tag in tags)), 0)


def _telling(value: str, inside: bool) -> bool:
    """Whether a class or id says boilerplate: each of its words is in CLASSES or beside such a word; in an article
    not by a VAGUE word."""
    words = [w.lower() for w in _NAMES.findall(value)]
    return any(w in CLASSES and not (inside and w in VAGUE) for w in words) and all(w in CLASSES or w in BESIDE for w in words)


@lru_cache(maxsize=1 << 14)
def _said(tag: str, attributes: str, above: bool, flagged: bool) -> tuple[str, bool, bool, bool]:
    """What a start tag says of its element: label, whether it is main, in a main region, and boilerplate.

    ``above`` and ``flagged`` say whether its parent is in a main region and boilerplate.
    """
    if "=" not in attributes and "hidden" not in attributes:
        main = tag in ("article", "main")
        return tag, main, above or main, flagged or tag in BOILERPLATE or (tag == "header" and not above)
    names: list[str] = []
    values: list[str] = []
    role, hidden = "", False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "itemprop"):
            values += value.split()
            names += (w.lower() for w in _NAMES.findall(value))
            names.append(value.lower())
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    own = frozenset(names)
    label = f"{tag}.{'.'.join(sorted(set(n for n in names if n.isalpha())))}" if names else tag
    main = tag in ("article", "main") or bool(own & MAIN)
    head = tag == "header" or bool(own & HEADS) or role == "banner"
    named = tag not in ("html", "body", "article", "main") and not (own & MAIN and not own & {"comment", "comments", "related", "sidebar", "ad", "ads"}) and any(_telling(v, above) for v in values)
    return label, main, above or main, flagged or hidden or tag in BOILERPLATE or role in ROLES or named or (head and not above)


class _Tokens:
    """Tags and comments of a page, in order.

    A tag that nothing closes is text, and a later tag may stand inside what looked like one of its quoted values. What
    such a scan passed outside of quotes can't start a closed tag either, so it is not looked at again; after SCANS of
    them a tag ends at the next ``>``, quotes or not. So a page of quotes without ends takes linear time, too.
    """

    def __init__(self, page: str):
        self.page = page
        self.dead: list[tuple[int, list[int], list[int]]] = []

    def __call__(self, at: int) -> re.Match | None:
        page = self.page
        if not self.dead:
            m = _TOKEN.search(page, at)
            if m is None or m[4] is None:
                return m
            self._died(m)
            at = m.start() + 1
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                return _TOKEN.match(page, at)
            if len(self.dead) > SCANS:
                return _PLAIN.search(page, at)
            if all(at < start or (k := bisect_right(lows, at)) and at < highs[k - 1] for start, lows, highs in self.dead):
                m = _TOKEN.match(page, at)
                if m is not None and m[4] is None:
                    return m
                if m is not None:
                    self._died(m)
            at += 1
        return None

    def _died(self, m: re.Match) -> None:
        spans = [q.span(1) for q in _QUOTED.finditer(self.page, m.end(2)) if q[1]]
        self.dead.append((m.start(), [a for a, _ in spans], [b for _, b in spans]))


class Node:
    __slots__ = ("tag", "label", "flagged", "inside", "held", "main", "parent", "children", "parts", "links", "index")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.parts: list[tuple[int, str]] = []  # own text and where it stands among the children
        self.links, self.index = 0, -1
        above, flagged = (parent.inside, parent.flagged) if parent is not None else (False, False)
        self.held = tag in ("article", "main") or parent is not None and parent.held
        said = _said if len(attributes) <= REMEMBERED else _said.__wrapped__
        self.label, self.main, self.inside, self.flagged = said(tag, attributes, above, flagged)


def parse(page: str) -> Node:
    """The tree of block elements; inline elements are part of their block's text."""
    root = Node("root", "", None)
    open_: list[Node] = [root]
    count = _NONE_OPEN.copy()
    at, anchor = 0, 0
    search = _Tokens(page)

    def text(piece: str) -> None:
        node = open_[-1]
        node.parts.append((len(node.children), piece))
        if anchor:
            node.links += len(piece)

    def close(i: int) -> None:
        for n in open_[i:]:
            count[n.tag] -= 1
        del open_[i:]

    def end_of(tag: str, start: int) -> int | None:
        """Where the element of a tag that starts before ``start`` has ended."""
        found = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, start)
        return found.end() if found else None

    missing: set[str] = set()  # tags without an end in the rest of the page
    while (m := search(at)) is not None:
        start, end = m.span()
        if start > at:
            text(page[at:start])
        at = end
        ends, tag, attributes = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            if tag == "a":
                anchor = 0
            if tag in BLOCK:
                if count[tag]:
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i].tag == tag:
                            close(i)
                            break
                        if tag == "p" and open_[i].tag in STOPS:
                            break
            elif tag in ("td", "th"):
                text(" ")
            continue
        if tag == "head":  # what it holds is no text, but an unclosed one ends with the body's start
            end = re.compile(r"</head\s*>|<body\b", re.IGNORECASE).search(page, at)
            at = len(page) if end is None else end.end() if page[end.start() + 1] == "/" else end.start()
        elif tag in RAW or tag in BOILERPLATE and tag not in BLOCK:
            if not m[0].endswith("/>") or tag in ("script", "style"):
                end = None if tag in missing else end_of(tag, at)
                if end is not None:
                    at = end
                else:
                    missing.add(tag)
                    if tag in ("script", "style"):
                        at = len(page)
        elif tag == "a":
            anchor = 1
        elif tag in BLOCK:
            closes = CLOSES.get(tag, ("p",))
            if count["p"] or count[tag] or count[closes[0]] or len(closes) > 1 and any([count[c] for c in closes]):
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag in closes:
                        close(i)
                    elif open_[i].tag in STOPS:
                        break
            node = Node(tag, attributes, open_[-1])
            open_[-1].children.append(node)
            if tag not in VOID:
                open_.append(node)
                count[tag] += 1
        elif tag in VOID or tag in ("td", "th"):
            text(" ")
    if at < len(page):
        text(page[at:])
    return root


def own_text(node: Node) -> str:
    return " ".join(_html.unescape("".join(t for _, t in node.parts)).split()) if node.parts else ""


def number(root: Node) -> list[Node]:
    """All nodes in page order, each with its index."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.index = len(out)
        out.append(node)
        stack += reversed(node.children)
    return out


def match(a, b) -> tuple[int, list[tuple]]:
    """Simple tree matching of two trees with equal labels at the root: the number of matched nodes and their pairs.

    All pairs of nodes that can match (under pairs that can) are listed from the top, and solved from the bottom. If that
    takes more than CELLS table cells, the trees count as unlike: no node is matched.
    """
    pairs, at = [(a, b)], {(id(a), id(b)): 0}
    k = cells = 0
    while k < len(pairs):
        x, y = pairs[k]
        cells += (len(x.children) + 1) * (len(y.children) + 1)
        if cells > CELLS:
            return 0, []
        for u in x.children:
            for v in y.children:
                if u.label == v.label:
                    at[id(u), id(v)] = len(pairs)
                    pairs.append((u, v))
        k += 1
    weight = [1] * len(pairs)
    tables: list[list[list[int]] | None] = [None] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        x, y = pairs[k][0].children, pairs[k][1].children
        if not x or not y:
            continue
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            row, up = best[i + 1], best[i]
            for j, v in enumerate(y):
                w = max(row[j], up[j + 1])
                if u.label == v.label:
                    w = max(w, up[j] + weight[at[id(u), id(v)]])
                row[j + 1] = w
        tables[k] = best
        weight[k] = best[-1][-1] + 1
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        out.append(pairs[k])
        if (best := tables[k]) is not None:
            x, y = pairs[k][0].children, pairs[k][1].children
            i, j = len(x), len(y)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append(at[id(x[i]), id(y[j])])
    return weight[0], out


class General:
    """A node of a generalised tree: a run of siblings with one label and like children, or all of them (see ``generalise``)."""

    __slots__ = ("label", "nodes", "children", "path")

    def __init__(self, label: str, path: int):
        self.label, self.nodes, self.children, self.path = label, [], [], path


def _hash(text: str, seed: int = 0) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


_path = lru_cache(maxsize=1 << 14)(_hash)


def _kind(node: Node) -> tuple:
    return node.label, tuple(sorted({c.tag for c in node.children})) if node.children else ()


def generalise(root: Node) -> General:
    """The generalised tree of a page; the path of a node is a hash of the labels and runs that lead to it.

    Under one parent a run of siblings of one kind (label and tags of the children) is a node. Where there are more than
    RUNS runs, as in a list of headings and paragraphs by turns, all siblings of a kind are one node; where there are
    more than RUNS kinds, as with a name for each paragraph, all of one tag. So no node has many children.
    """
    top = General("root", _hash("root"))
    top.nodes.append(root)
    todo = [top]
    while todo:
        g = todo.pop()
        lists = [[_kind(c) for c in node.children] for node in g.nodes]
        by_run = max([sum(map(ne, kinds[1:], kinds)) for kinds in lists], default=0) < RUNS
        by_kind = by_run or len({k for kinds in lists for k in kinds}) <= RUNS
        known: dict[tuple, General] = {}
        ordinals: Counter[tuple] = Counter()
        for node, kinds in zip(g.nodes, lists, strict=True):
            run, before = -1, None
            for child, kind in zip(node.children, kinds, strict=True):
                if not by_kind:
                    kind = (child.tag, ())
                if kind != before:
                    run, before = run + by_run, kind
                    found = known.get((kind, run))
                    if found is None:
                        label = f"{kind[0]}({','.join(kind[1])})"
                        found = known[kind, run] = General(label, (_path if len(label) <= REMEMBERED else _hash)(f"{label}{ordinals[kind]}", g.path))
                        ordinals[kind] += 1
                        g.children.append(found)
                found.nodes.append(child)
        todo += g.children
    return top


class Wrapper:
    """The reference pages of a host, and the alignments with them of trees seen before.

    Pages of one host often have one generalised tree; the paths of its nodes, in the order of a walk, tell it.
    """

    def __init__(self, pages: list[str]):
        self.references = [generalise(parse(p)) for p in pages]
        self.known: dict[tuple[int, ...], list[int]] = {}
        self.held = 0

    def slots(self, trees: list[General]) -> list[int]:
        """The slot of each node of a page's generalised tree: by the reference that aligns best, else the own path."""
        key = tuple([g.path for g in trees])
        if (slots := self.known.get(key)) is None:
            best: tuple[int, list] = (0, [])
            for reference in self.references:
                got = match(trees[0], reference)
                if got[0] > best[0]:
                    best = got
                if got[0] == len(trees):
                    break
            path = {} if 2 * best[0] < len(trees) else {id(g): r.path for g, r in best[1]}
            slots = [path.get(id(g), g.path) for g in trees]
            self.held += len(trees)
            if self.held > ALIGNED:
                self.known.clear()
                self.held = len(trees)
            if len(trees) <= ALIGNED:
                self.known[key] = slots
        return slots


def slots_of(root: Node, wrapper: Wrapper) -> list[tuple[Node, int]]:
    """The nodes of a page that hold text, and the slot of each."""
    all_, todo = [], [generalise(root)]
    while todo:
        g = todo.pop()
        all_.append(g)
        todo += g.children
    return [(n, slot) for g, slot in zip(all_, wrapper.slots(all_), strict=True) for n in g.nodes if n.parts]


class Template:
    """What is known of a host's slots: template slots, content slots, and template texts by slot (hashes)."""

    def __init__(self, fixed=(), varying=(), texts=(), slots=(), articles=0):
        self.fixed, self.varying, self.articles = frozenset(fixed), frozenset(varying), articles
        self.texts: dict[int, set[int]] = defaultdict(set)
        for slot, text in zip(slots, texts, strict=True):
            self.texts[slot].add(text)


def observed(page: str, wrapper: Wrapper) -> list[tuple[int, int]]:
    """(slot, hash of slot and text), each once, and first (0, a number of the page's article).

    The number is the least hash of the texts in the slot with most text: pages that share most blocks of it share the
    number as a rule, so that a page's edited copies count as one article, too.
    """
    found: set[tuple[int, int]] = set()
    size: Counter[int] = Counter()
    least: dict[int, int] = {}
    for node, slot in slots_of(parse(page), wrapper):
        t = own_text(node)
        if t:
            h = _hash(t, slot)
            found.add((slot, h))
            size[slot] += len(t)
            least[slot] = min(least.get(slot, h), h)
    article = least[max(size, key=lambda k: (size[k], k))] if size else 0
    return [(0, article), *sorted(found)]


def verdicts(slots: list[tuple[Node, int]], template: Template) -> dict[int, bool]:
    """Whether the template says that a node is content, by index; it never deletes an article.

    A slot that is template as a whole (its texts recur, which those of an article in several versions do as well)
    is none in an article, nor if it holds most of the page's text; and if constant texts are more than half of the
    article, they are versions of it and stay. The article is what elements say, on hosts of fewer than MANY articles
    also what class names say; on others these may be wrong.
    """
    article = lambda node: (node.held or node.inside and template.articles < MANY) and not node.flagged
    out: dict[int, bool] = {}
    size: Counter[int] = Counter()
    whole = gone = 0
    constant = set()
    for node, slot in slots:
        n = sum([len(t) for _, t in node.parts])
        named = article(node)
        if slot in template.texts and _hash(own_text(node), slot) in template.texts[slot]:
            constant.add(node.index)
            gone += n * named
        else:
            size[slot] += n
        whole += n * named
    most = max(size, key=lambda k: (size[k], k)) if size else None
    if most is not None and 2 * size[most] < sum(size.values()):
        most = None
    for node, slot in slots:
        named = article(node)
        if node.index in constant:
            if not named or 2 * gone <= whole:
                out[node.index] = False
        elif slot in template.fixed:
            if not named and (slot != most or node.flagged):
                out[node.index] = False
        elif slot in template.varying:
            out[node.index] = True
    return out


def extract(page: str | None, wrapper: Wrapper | None = None, template: Template | None = None) -> str:
    """The main text of a page, by the template of its host where that decides."""
    if not page:
        return ""
    root = parse(page)
    nodes = number(root)
    verdict: dict[int, bool] = {}  # whether the template says that a node is content
    if template is not None and (template.fixed or template.varying or template.texts):
        verdict = verdicts(slots_of(root, wrapper or Wrapper([])), template)
    undecided = [n for n in nodes if n.index not in verdict and not n.flagged]
    size = [0] * len(nodes)
    for n in nodes:
        if n.parts and verdict.get(n.index, not n.flagged):
            size[n.index] = sum([len(t) for _, t in n.parts])
    end = list(range(1, len(nodes) + 1))  # the index after a node's last descendant
    for n in reversed(nodes):
        if n.parent is not None:
            above = n.parent.index
            size[above] += size[n.index]
            end[above] = max(end[above], end[n.index])
    mains = [n for n in undecided if n.main and size[n.index]]
    strong = bool(mains)
    regions = {n.index for n in mains if n.tag == "article"} or {n.index for n in mains if n.tag == "main"} or {n.index for n in mains}
    if not regions:
        region = root
        while (inner := max(region.children, key=lambda n: size[n.index], default=None)) is not None:
            if inner.tag not in STOPS or size[inner.index] < 0.7 * size[region.index] or not size[inner.index]:
                break
            region = inner
        regions = {region.index}
    # a run of text stands before the child it precedes, or behind the last; of runs that end at one place the inner come first
    blocks: list[tuple[int, int, str]] = []
    within, depth = [False] * len(nodes), [0] * len(nodes)
    for node in nodes:
        i = node.index
        above = node.parent.index if node.parent is not None else i
        within[i], depth[i] = within[above] or i in regions, depth[above] + 1
        says = verdict.get(i)
        if not node.parts or not (says if says is not None else within[i] and not node.flagged):
            continue
        if says is None and not strong and node.links and node.tag == "li" and node.links * 10 >= 9 * sum([len(t) for _, t in node.parts]):
            continue
        for child, run in groupby(node.parts, key=itemgetter(0)):
            block = " ".join(_html.unescape("".join([t for _, t in run])).split())
            if block:
                blocks.append((node.children[child].index if child < len(node.children) else end[i], -depth[i], block))
    blocks.sort()
    return "\n\n".join([block for _, _, block in blocks])


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _chosen(pages: DataFrame) -> DataFrame:
    """(host, reference): up to REFERENCES pages of each host, of each share of its pages one of typical length."""
    share = F.pmod(F.xxhash64("page_id", "html"), F.lit(REFERENCES))
    rank = F.struct(F.abs(F.char_length("html") - TYPICAL), F.col("page_id"), F.xxhash64("html"))
    best = pages.filter("html is not null").groupBy("host", share.alias("share")).agg(F.min_by("html", rank).alias("html"))
    return best.groupBy("host").agg(F.array_sort(F.collect_list("html")).alias("reference"))


class _Wrappers:
    """References by host, parsed once in a worker."""

    def __init__(self, references: dict[str, list[str]]):
        self.pages, self.parsed = references, {}

    def __call__(self, of: str, given: list[str] | None) -> Wrapper:
        if of not in self.parsed:
            if len(self.parsed) > 500 or sum(w.held for w in self.parsed.values()) > ALIGNED:
                self.parsed.clear()
            self.parsed[of] = Wrapper(given if given is not None else self.pages.get(of, []))
        return self.parsed[of]


def by_slot_and_text(observations: DataFrame) -> DataFrame:
    """(host, slot, text, articles, n) from (host, slot, text, article), a row for each text of a page's slot."""
    return observations.groupBy("host", "slot", "text").agg(F.count_distinct("article").alias("articles"), F.count("*").alias("n"))


def templates(by_text: DataFrame) -> DataFrame:
    """(host, fixed, varying, texts, slots, articles) from the rows of ``by_slot_and_text``, which are read three times."""
    all_ = by_text.filter("slot = 0").groupBy("host").agg(F.count("*").alias("all"))
    is_constant = (F.col("articles") > 2) & (F.col("articles") >= CONSTANT * F.col("all"))
    again = F.greatest(F.lit(2), F.least(F.lit(AGAIN), F.ceil(CONSTANT * F.col("all"))))
    # a host's number of articles is joined salted, as one host may have most texts
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    salted = all_.withColumn("salt", F.explode(salts))
    by_text = by_text.filter("slot <> 0").withColumn("salt", F.pmod("text", F.lit(SALTS).cast("long"))).join(salted, ["host", "salt"]).withColumn("constant", is_constant)
    by_slot = by_text.filter("not constant").groupBy("host", "slot").agg(F.max("all").alias("all"), F.sum("n").alias("n"), F.sum(F.when(F.col("articles") >= again, F.col("n")).otherwise(0)).alias("again"), F.sum(F.when(F.col("articles") > 1, F.col("n")).otherwise(0)).alias("twice"))
    share, twice = F.col("again") / F.col("n"), F.col("twice") / F.col("n")
    kinds = by_slot.filter("all > 2").groupBy("host").agg(
        F.max("all").alias("of_kinds"),
        F.array_sort(F.collect_list(F.when((share >= RECURS) & (F.col("n") >= 4), F.col("slot")))).alias("fixed"),
        F.array_sort(F.collect_list(F.when((twice <= VARIES) & (F.col("n") >= ENOUGH), F.col("slot")))).alias("varying"),
    )
    constant = by_text.filter("constant").groupBy("host").agg(F.max("all").alias("of_constant"), F.array_sort(F.collect_list(F.struct("text", "slot"))).alias("x")).select("host", "of_constant", F.col("x.text").alias("texts"), F.col("x.slot").alias("slots"))
    none = F.array().cast("array<bigint>")
    return kinds.join(constant, "host", "full").select("host", *(F.coalesce(c, none).alias(c) for c in ("fixed", "varying", "texts", "slots")), F.coalesce("of_kinds", "of_constant").alias("articles"))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host(F.col("url")))
    references = cut_lineage(_chosen(rows))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    seen = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("text", pa.int64()), ("article", pa.int64())])
    small = bounded(references, BROADCAST_BYTES, F.aggregate("reference", F.lit(0).cast("long"), lambda a, r: a + F.octet_length(r)))
    if small:
        known = {r["host"]: list(r["reference"]) for r in references.collect()}
        with_reference = rows.select("page_id", "url", "html", "host", F.lit(None).cast("array<string>").alias("reference"))
    else:
        known = {}
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        salted = references.select("host", "reference", F.explode(salts).alias("salt"))
        with_reference = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS).cast("long"))).join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "reference")

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = _Wrappers(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made: list[tuple] = []
                for page, of, given in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("html", "host", "reference")), strict=True):
                    if page:
                        (_, article), *found = observed(page, wrappers(of, given))
                        made += [(of, 0, article, article), *((of, slot, text, article) for slot, text in found)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), seen, strict=True)], schema=seen)

    observations = map_arrow(with_reference, observe, "host string, slot long, text long, article long")
    found = templates(cut_lineage(by_slot_and_text(observations)))
    if small:
        found = cut_lineage(found)
        small_too = bounded(found, BROADCAST_BYTES, F.lit(8) * (F.size("fixed") + F.size("varying") + 2 * F.size("texts")))
    if small and small_too:
        by_host = {r["host"]: Template(r["fixed"], r["varying"], r["texts"], r["slots"], r["articles"]) for r in found.collect()}
        full = with_reference.select("*", *(F.lit(None).cast("array<bigint>").alias(c) for c in ("fixed", "varying", "texts", "slots")), F.lit(None).cast("long").alias("articles"))
    else:
        by_host = {}
        salted = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        full = with_reference.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS).cast("long"))).join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "reference", "fixed", "varying", "texts", "slots", "articles")

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = _Wrappers(known)
        held: dict[str, Template] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                columns = [batch.slice(at, 256).column(c).to_pylist() for c in ("page_id", "url", "html", "host", "reference", "fixed", "varying", "texts", "slots", "articles")]
                texts = []
                for _, _, page, of, given, fixed, varying, constant, slots, articles in zip(*columns, strict=True):
                    template = by_host.get(of)
                    if fixed is not None:
                        if len(held) > 500:
                            held.clear()
                        template = held.setdefault(of, Template(fixed, varying, constant, slots, articles))
                    texts.append(extract(page, wrappers(of, given) if template else None, template))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((*columns[:2], texts, [len(t) for t in texts]), out, strict=True)], schema=out)

    return map_arrow(full, text_of, "page_id long, url string, text string, n_chars long")
