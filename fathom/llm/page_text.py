"""Main text of web pages by wrapper induction.

Pages of a host are parsed into DOM trees whose like siblings are folded into one node. The different trees of all pages
of a host, without what occurs on one or two pages only, are aligned by simple tree matching and merged step by step into
the host's wrapper; then every page is aligned with its wrapper and counts, for each node of the wrapper, on how many
pages the node occurs, whether its text is the same on all of them and how much of it is inside links. Nodes whose text
is constant, and nodes of menus, notices and the like, are template; the others are slots, and the slots of a page are
its text. Nodes that the wrapper lacks, being rare, are judged by themselves: menus and the like go, others are slots.

If a host's wrapper has an article (or main) element, content is looked for only there. Within it a constant text is
template only if the node occurs in several different articles; so a host with one page, or with copies of one page,
keeps its article. Nor is an element around an article a menu, however many links it has.

Edge cases: a null or empty html has an empty text; a null or hostless URL belongs to the host ''; broken markup is read
as far as it goes, a tag that does not end is dropped; of a node's like siblings all are one, so there are no ties; a page
of any length is read whole, in memory that is a multiple of it; repeated rows are extracted one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed, prepare, same, staged
from .url_filter import host_of

#: A node must occur on this many pages before a constant text makes it template.
MIN_PAGES = 3
#: Trees that one step merges, about.
FAN = 64
#: Share of a node's text inside links beyond which it is a menu.
MAX_LINKS = 0.6

# Elements of HTML by their role.
ARTICLES = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head iframe object svg canvas".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CHROME = frozenset("nav header footer aside form button select textarea menu dialog label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("caption td th tr tbody thead tfoot body html".split())
#: A start tag in the set closes an open element of the key.
CLOSED_BY = {"p": CLOSES_P, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: The keys of CLOSED_BY by start tag.
CLOSES = {name: [k for k, names in CLOSED_BY.items() if name in names] for name in frozenset().union(*CLOSED_BY.values())}
#: Elements that a start tag does not look beyond when it closes others.
SCOPES = frozenset("table td th ul ol dl div section article main body html blockquote".split())
#: Words of class, id and role names for what is no main text, and words that say nothing beside them.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising advertorial sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side complementary footer contentinfo header "
    "masthead cookie cookies consent notice alert popup modal dialog overlay newsletter subscribe subscription comment comments reply replies disqus related share sharing social widget widgets "
    "pagination pager search login signin signup teaser teasers".split()
)
NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right inner outer wrap wrapper container box bar block area section slot unit item items list link links button buttons icons post posts article articles thread "
    "content text title primary secondary global mobile desktop sticky fixed form panel row column group user reader readers the and in of".split()
)
_NAME_PARTS = re.compile(r"[^-_A-Z]+|[A-Z][^-_A-Z]*")

_TOKENS = re.compile(r"<!--.*?(?:-->|$)|<[/!?]?[a-zA-Z!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|<[/!?]?[a-zA-Z!?][^>]*(?:>|$)|[^<]+|<", re.S)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    """An element; parts are its texts and children in order."""

    tag: str
    name: str = ""
    parts: list = field(default_factory=list)

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag


def parse(html: str | None) -> Node:
    """The DOM tree, under a node of its own. Reads as browsers do where it matters: implied ends, raw text, references."""
    root = Node("#")
    stack, raw = [root], ""
    opened: Counter = Counter()
    for match in _TOKENS.finditer(html or ""):
        token = match.group()
        tag = _TAG.match(token) if token[0] == "<" else None
        if raw and not (tag and token[1] == "/" and tag[1].lower() == raw):
            if raw in ("title", "textarea"):
                stack[-1].parts.append(entities.unescape(token))
            continue
        if token[0] != "<" or token == "<":
            stack[-1].parts.append(entities.unescape(token))
            continue
        if not tag or token[-1] != ">":
            continue
        name = tag[1].lower()
        if token[1] == "/":
            raw = ""
            if opened[name]:
                while (last := stack.pop().tag) != name:
                    opened[last] -= 1
                opened[name] -= 1
            continue
        depth = len(stack) - 1 if any(opened[k] for k in CLOSES.get(name, ())) else 0
        while depth > 0:
            open_ = stack[depth].tag
            if name in CLOSED_BY.get(open_, ()):
                opened.subtract(n.tag for n in stack[depth:])
                del stack[depth:]
                break
            if open_ in SCOPES:
                break
            depth -= 1
        attrs = " ".join(filter(None, (a[1] or a[2] or a[3] for a in _ATTR.findall(token)))) if " " in token else ""
        node = Node(name, attrs.strip())
        stack[-1].parts.append(node)
        if name not in VOID and not token.endswith("/>"):
            stack.append(node)
            opened[name] += 1
            raw = name if name in RAW else ""
    return root


@dataclass
class Folded:
    """A node of a page or wrapper; texts are the own texts of all elements that were folded into it."""

    label: str
    children: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    members: list = field(default_factory=list)


def fold(nodes: list[Node]) -> Folded:
    """Merges like siblings, so that a list or an article of any length is a few nodes."""
    top = Folded(nodes[0].label, members=nodes)
    todo = [top]
    while todo:
        out = todo.pop()
        by: dict[str, list[Node]] = {}
        for n in out.members:
            for p in n.parts:
                if isinstance(p, str):
                    if not p.isspace():
                        out.texts.append(p)
                elif p.tag not in SKIPPED:
                    by.setdefault(p.label, []).append(p)
        out.children = [Folded(x[0].label, members=x) for x in by.values()]
        todo += out.children
    return top


def match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: the size of the largest top-down matching that keeps order, and its pairs of children."""
    if a.label != b.label:
        return 0, []
    done: dict[tuple[int, int], tuple[int, list[tuple[Folded, Folded]]]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if ready:
            done[id(x), id(y)] = _match_children(x, y, done)
        else:
            todo.append((x, y, True))
            of: dict[str, list[Folded]] = {}
            for c in y.children:
                of.setdefault(c.label, []).append(c)
            todo += [(c, d, False) for c in x.children for d in of.get(c.label, ())]
    pairs, at = [], [(a, b)]
    while at:
        x, y = at.pop()
        pairs += done[id(x), id(y)][1]
        at += done[id(x), id(y)][1]
    return done[id(a), id(b)][0], pairs


def _match_children(a: Folded, b: Folded, done: dict) -> tuple[int, list[tuple[Folded, Folded]]]:
    """The size of the largest matching of a and b, and its pairs of their own children; done has it for these."""
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    size = lambda i, j: done.get((id(a.children[i - 1]), id(b.children[j - 1])), (0,))[0]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + size(i, j))
    pairs, i, j = [], m, n
    while i and j:
        if size(i, j) and best[i][j] == best[i - 1][j - 1] + size(i, j):
            pairs.append((a.children[i - 1], b.children[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], pairs[::-1]


def merge(a: Folded, b: Folded) -> Folded:
    """a, with those parts of b that it lacks, each after the part that it follows in b; both match the result in full."""
    pairs = {id(y): x for x, y in match(a, b)[1]}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not y.children:
            continue
        own, after = {id(c): k for k, c in enumerate(x.children)}, {}
        at = -1
        for child in y.children:
            if id(child) in pairs:
                at = own[id(pairs[id(child)])]
                todo.append((pairs[id(child)], child))
            else:
                after.setdefault(at, []).append(child)
        x.children = after.get(-1, []) + [n for k, c in enumerate(x.children) for n in (c, *after.get(k, ()))]
    return a


def dump(n: Folded) -> list:
    """Depth and label of each node, in document order."""
    out, todo = [], [(n, 0)]
    while todo:
        n, depth = todo.pop()
        out.append([depth, n.label])
        todo += [(c, depth + 1) for c in reversed(n.children)]
    return out


def load(data: list) -> Folded:
    path: list[Folded] = []
    for depth, label in data:
        n = Folded(label)
        del path[depth:]
        if path:
            path[-1].children.append(n)
        path.append(n)
    return path[0]


def paths(skeleton: list) -> list[int]:
    """A hash of the labels from the root to each node of a page; like siblings are folded, so no two nodes have the same."""
    out, path = [], [b""]
    for depth, label in skeleton:
        del path[depth + 1 :]
        path.append(hashlib.blake2b(path[-1] + label.encode("utf-8", "surrogatepass"), digest_size=8).digest())
        out.append(int.from_bytes(path[-1], "big", signed=True))
    return out


def prune(skeleton: list, common: set[int]) -> list:
    """The root and the nodes whose path is common; a path is no commoner than its beginnings."""
    return [n for n, path in zip(skeleton, paths(skeleton)) if not n[0] or path in common]


def numbered(root: Folded) -> list[tuple[int, Folded]]:
    """The nodes of a wrapper by number, in document order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append((len(out), n))
        todo += reversed(n.children)
    return out


@lru_cache(maxsize=256)
def _wrapper(text: str) -> tuple[Folded, dict[int, int]]:
    root = load(json.loads(text))
    return root, {id(n): k for k, n in numbered(root)}


def align(page: Folded, wrapper: str) -> dict[int, int]:
    """The number of the wrapper's node for each node (by identity) of the page that has one."""
    by_place = _aligned(json.dumps(dump(page)), wrapper)
    return {id(n): by_place[k] for k, n in numbered(page) if k in by_place}


@lru_cache(maxsize=4096)
def _aligned(skeleton: str, wrapper: str) -> dict[int, int]:
    """Numbers of the wrapper's nodes by place in a page's tree; pages of one template share few skeletons."""
    page = load(json.loads(skeleton))
    root, number = _wrapper(wrapper)
    found = {id(page): 0} | {id(p): number[id(w)] for p, w in match(page, root)[1]}
    return {k: found[id(n)] for k, n in numbered(page) if id(n) in found}


def _linked(nodes: list[Node]) -> int:
    return sum(len(p) if isinstance(p, str) else _linked([p]) for n in nodes for p in n.parts)


def ordered(root: Folded) -> list[tuple[Folded, int]]:
    """The nodes of a tree in document order, each with the place of its parent."""
    out, todo = [], [(root, -1)]
    while todo:
        n, up = todo.pop()
        todo += [(c, len(out)) for c in reversed(n.children)]
        out.append((n, up))
    return out


@dataclass
class Place:
    """A node of a page: whether it is inside an article or a link, or around an article, and the lengths of its text."""

    node: Folded
    up: int
    inside: bool
    in_link: bool
    size: int
    linked: int
    around: bool = False


def survey(page: Folded) -> list[Place]:
    out: list[Place] = []
    for n, up in ordered(page):
        tag = n.label.split(".", 1)[0]
        in_link, inside = up >= 0 and out[up].in_link or tag == "a", up >= 0 and out[up].inside or tag in ARTICLES
        own = sum(map(len, n.texts))
        out.append(Place(n, up, inside, in_link, own, own if in_link else 0))
    for p in reversed(out):
        if p.up >= 0:
            up = out[p.up]
            up.size, up.linked, up.around = up.size + p.size, up.linked + p.linked, up.around or p.inside or p.around
    return out


def _own(n: Folded) -> str:
    return " ".join(" ".join(n.texts).split())


def observe(html: str | None, wrapper: str) -> list[tuple[int, str, int, int, str | None]]:
    """number, own text, length of the text inside and of that inside links, for each matched node of a page, and for
    nodes inside articles a digest of all text that the page has in articles."""
    page = fold([parse(html)])
    numbers, places = align(page, wrapper), survey(page)
    whole = hash_text("\n".join(_own(p.node) for p in places if p.inside))
    return [(numbers[id(p.node)], _own(p.node), p.size, p.linked, whole if p.inside else None) for p in places if id(p.node) in numbers]


@lru_cache(maxsize=100_000)
def _chrome_name(name: str, inside: bool) -> bool:
    """Whether one of the names is made of the words above alone, with one of the former: so side and side-bar, but not
    side-by-side. The header of an article is its own."""
    for token in name.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(token)] or [token.lower()]
        meant = [p for p in parts if p in CHROME_WORDS and not (inside and p == "header")]
        if meant and all(p in CHROME_WORDS or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
            return True
    return False


def _chrome(tag: str, name: str, inside: bool) -> bool:
    return tag in CHROME and not (inside and tag == "header") or tag not in ("body", "html", "main") and _chrome_name(name, inside)


def _menu(tag: str, size: int, linked: int) -> bool:
    return tag not in ("a", "#", "html", "body") and size > 0 and linked > MAX_LINKS * size


def decide(wrapper: str, stats: dict[int, tuple[int, bool, int, int, int]]) -> dict:
    """Which nodes of a wrapper are template (with all that is inside), which have constant own text, and whether content
    is looked for in article or main elements only. stats: pages, constant, size, linked size and number of different
    articles around the node (MIN_PAGES at most are told apart), by number."""
    template, constant, articles = [], [], []
    places = survey(load(json.loads(wrapper)))
    same_text = [False] * len(places)
    gone = [False] * len(places)
    for k, p in enumerate(places):
        tag, _, name = p.node.label.partition(".")
        pages, same_, size, linked, varied = stats.get(k, (0, False, 0, 0, 0))
        if p.up >= 0 and gone[p.up]:
            gone[k] = True
            continue
        if tag in ARTICLES and not (p.up >= 0 and places[p.up].inside):
            articles.append(k)
        if _chrome(tag, name, p.inside) or not p.inside and not p.around and _menu(tag, size, linked):
            template.append(k)
            gone[k] = True
            continue
        # A constant word in a sentence of an article is not template; its block must be constant too.
        alone = tag in BLOCKS or p.up < 0 or same_text[p.up]
        same_text[k] = same_ and (varied >= MIN_PAGES and alone if p.inside else pages >= MIN_PAGES)
        if same_text[k]:
            constant.append(k)
    return {"template": template, "constant": constant, "articles": articles}


def text_of(html: str | None, wrapper: str | None, decided: str | None) -> str:
    """The blocks of a page that are content, joined by newlines."""
    tree = parse(html)
    page = fold([tree])
    if wrapper is None or decided is None:  # no wrapper: the page's own elements decide
        numbers, (template, constant, articles) = {}, (frozenset(), frozenset(), frozenset())
    else:
        numbers, (template, constant, articles) = align(page, wrapper), _plan(decided)
    dropped: set[int] = set()
    silent: set[int] = set()
    starts: set[int] = set()
    places = survey(page)
    for p in places:
        k = numbers.get(id(p.node))
        if k is None:  # on so few pages that only the node itself can tell
            tag, _, name = p.node.label.partition(".")
            drop = _chrome(tag, name, p.inside) or not p.inside and not p.around and _menu(tag, p.size, p.linked)
            start = tag in ARTICLES and not (p.up >= 0 and places[p.up].inside)
        else:
            drop, start = k in template, k in articles
        members = [id(m) for m in p.node.members]
        if drop or p.up >= 0 and id(places[p.up].node.members[0]) in dropped:
            dropped.update(members)
        elif start:
            starts.update(members)
        if k in constant:
            silent.update(members)
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    only = bool(starts)
    todo: list = [(tree, not only)]
    while todo:
        item, on = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            words.append(item)
        else:
            if id(item) in dropped or item.tag in SKIPPED:
                continue
            on = on or id(item) in starts
            if item.tag == "br":
                words.append(" ")
                continue
            block = item.tag in BLOCKS
            if block:
                flush()
                todo.append((None, on))
            for p in reversed(item.parts):
                if isinstance(p, str):
                    if on and id(item) not in silent:
                        todo.append((p, on))
                else:
                    todo.append((p, on))
    flush()
    return "\n".join(blocks)


@lru_cache(maxsize=256)
def _plan(decided: str) -> tuple[frozenset, frozenset, frozenset]:
    d = json.loads(decided)
    return frozenset(d["template"]), frozenset(d["constant"]), frozenset(d["articles"])


def wrappers(pages: DataFrame) -> DataFrame:
    """_host, wrapper, decided: one row per host; all of its pages are merged and counted."""
    prepare(pages.sparkSession)
    own = pages.select(host_of(F.col("url")).alias("_host"), "html")

    def skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = Counter((host, json.dumps(dump(fold([parse(html)])))) for host, html in zip(pdf["_host"], pdf["html"]))
            yield pd.DataFrame([(h, s, n) for (h, s), n in seen.items()], columns=["_host", "tree", "n"])

    trees = own.mapInPandas(skeletons, "_host string, tree string, n long").groupBy("_host", "tree").agg(F.sum("n").alias("n"))
    trees = staged(trees, "trees")

    # A node on fewer than MIN_PAGES pages cannot become template by what it has in common with other pages, so wrappers
    # do without: a name that each page has anew would make them as long as the host has pages.
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for host, tree, n in zip(pdf["_host"], pdf["tree"], pdf["n"]):
                for path in paths(json.loads(tree)):
                    seen[host, path] += n
            yield pd.DataFrame([(h, p, n) for (h, p), n in seen.items()], columns=["_of", "path", "n"])

    common = trees.mapInPandas(walk, "_of string, path long, n long").groupBy("_of", "path").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES)
    common = common.groupBy("_of").agg(F.collect_list("path").alias("common"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, last = set(), (None, set())
            for host, tree, common in zip(pdf["_host"], pdf["tree"], pdf["common"]):
                if last[0] != host:
                    last = (host, set() if common is None else set(map(int, common)))
                made.add((host, json.dumps(prune(json.loads(tree), last[1]))))
            yield pd.DataFrame(list(made), columns=["_host", "tree"])

    def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for trees in pdf["trees"]:
                roots = [load(json.loads(t)) for t in sorted(trees)]
                for t in roots[1:]:
                    merge(roots[0], t)
                out.append(json.dumps(dump(roots[0])))
            yield pd.DataFrame({"_host": pdf["_host"], "tree": out})

    made = staged(trees.join(common, F.col("_host") == F.col("_of"), "left").select("_host", "tree", "common").mapInPandas(cut, "_host string, tree string").distinct(), "cut")
    while (most := made.groupBy("_host").count().agg(F.max("count")).first()[0] or 0) > 1:
        part = F.pmod(F.xxhash64("tree"), F.lit(-(-most // FAN))).alias("part")
        few = made.groupBy("_host", part).agg(F.collect_list("tree").alias("trees"))
        made = staged(few.select("_host", "trees").mapInPandas(induce, "_host string, tree string"), "merged")
    made = made.withColumnRenamed("tree", "wrapper")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple[str, int], list] = {}
            for host, html, wrapper in zip(pdf["_host"], pdf["html"], pdf["wrapper"]):
                for number, text, size, linked, whole in observe(html, wrapper):
                    s = seen.setdefault((host, number), [0, text, text, 0, 0, set()])
                    s[0] += 1
                    s[1], s[2] = min(s[1], text), max(s[2], text)
                    s[3] += size
                    s[4] += linked
                    if whole is not None:
                        s[5].add(whole)
                        if len(s[5]) > MIN_PAGES:
                            s[5].remove(max(s[5]))
            # Only whether least and greatest are equal matters, so a prefix and a hash of each will do. Of the digests,
            # the least MIN_PAGES are enough to tell whether there are as many; the first row of a node has its sums.
            key = lambda t: f"{t[:20]}|{hash_text(t)}"
            rows = []
            for (h, k), s in seen.items():
                lo, hi = (key(s[1]), key(s[1])) if s[1] == s[2] else ("a", "b")
                for nth, whole in enumerate(sorted(s[5]) or [None]):
                    rows.append((h, k, *((0, lo, hi, 0, 0) if nth else (s[0], lo, hi, s[3], s[4])), whole))
            yield pd.DataFrame(rows, columns=["_host", "number", "pages", "lo", "hi", "size", "linked", "whole"])

    with_wrapper = _with(pages, made)
    seen = with_wrapper.mapInPandas(count, "_host string, number int, pages long, lo string, hi string, size long, linked long, whole string")
    sums = seen.groupBy("_host", "number").agg(
        F.sum("pages").alias("pages"), (F.min("lo") == F.max("hi")).alias("constant"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.countDistinct("whole").alias("varied")
    )
    stats = sums.groupBy("_host").agg(F.collect_list(F.struct("number", "pages", "constant", "size", "linked", "varied")).alias("stats"))
    full = made.join(stats.withColumnRenamed("_host", "_of"), F.col("_host") == F.col("_of"), "left").select("_host", "wrapper", "stats")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for wrapper, stats in zip(pdf["wrapper"], pdf["stats"]):
                by = {s["number"]: (s["pages"], s["constant"], s["size"], s["linked"], s["varied"]) for s in (stats if stats is not None else [])}
                out.append(json.dumps(decide(wrapper, by)))
            yield pd.DataFrame({"_host": pdf["_host"], "wrapper": pdf["wrapper"], "decided": out})

    return staged(full.mapInPandas(settle, "_host string, wrapper string, decided string"), "decided")


def hash_text(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _with(pages: DataFrame, by_host: DataFrame) -> DataFrame:
    """Pages with their host's row; it is broadcast if Spark finds it small, else adaptive execution splits a hot host."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_h"))
    return own.join(by_host, own["_h"] == by_host["_host"], "left").drop("_host").withColumnRenamed("_h", "_host")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    decided = wrappers(pages)

    def worker():
        def make(*rows: list) -> dict[str, list]:
            texts = list(map(text_of, *rows))
            return {"text": texts, "n_chars": list(map(len, texts))}

        return make

    return computed(_with(pages, decided), ["page_id", "url"], ["html", "wrapper", "decided"], "text string, n_chars long", worker)
