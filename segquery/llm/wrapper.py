"""HTML main text by wrapper induction.

Each host has one reference page. Every page of the host is aligned with it by simple tree
matching (the largest common top-down tree that keeps the order of siblings), which names the
slots of the page: an aligned node has its counterpart's name, any other one a name made of its
parent's and its own tag, class and id. So blocks that the reference lacks have names as well.
A block of text is template where its slot holds the same text on nearly all distinct articles
of the host that have the slot; other blocks vary. The main text of a page is what lies in the
smallest element that holds most of what varies (and its varying headline), by the host's mean
lengths of the slots; a branch within it that is template as a whole goes, a constant paragraph
between varying ones stays.

Tags only settle what the wrapper cannot: an element that says it is the article or main part
is taken as that element if it holds half of what varies or more; elements whose tag, role or class
says menu, header, footer, sidebar, notice, advert, form or reader comment are never content (a name
says so if it has no words but such ones and words of structure); hosts with under ``MIN_PAGES``
distinct articles have no wrapper and keep all else.

Defined results: null or empty html gives an empty text; a null url is the host ``''``; repeated
pages count once; broken markup is read as a browser does (unclosed elements end with their
parent, text after a lone ``<`` stays text, after a tag whose quotes never close tags end at their
first ``>``). Nesting may be of any depth. Other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

#: A node is template if its text is the same in this share of at least MIN_PAGES distinct articles.
SHARE, MIN_PAGES = 0.8, 5
#: Cells of the table of two sibling lists, beyond which not all of its rows are held at once.
MAX_CELLS = 250_000
#: One row a host is sent to all tasks up to this size in bytes, as measured; beyond it is shuffled.
BROADCAST_BYTES = 32 << 20

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
CONTAINERS = frozenset("address article blockquote center dd details div dl fieldset figure header hgroup main ol section table tbody td th tr ul".split())
ENDS_P = BLOCK - {"option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
NEVER = frozenset("script style noscript template iframe nav footer aside form button select textarea input svg canvas object embed head title menu dialog noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
CUES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification alert "
    "related recommended share sharing social subscribe subscription newsletter signup login comment comments disqus respond reply replies popup modal overlay widget pagination pager copyright toolbar skip".split()
)

#: Words that leave a name a cue: "comment-list" is comments, "share-price" is no share button.
STRUCTURE = frozenset("area bar block body bottom box button buttons container content footer group header holder inner item items left link links list main menu outer page panel post right row section site text title top user wrap wrapper".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"</?[a-zA-Z]")
_OTHER = re.compile(r"()()()(?:[^<]++|<!--.*?(?:-->|\Z)|<[!?/][^>]*+>|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CUE = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("attrs", "key", "kids", "size", "sig", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.sig, self.size = tag, attrs, [], None, 1
        self.key = (tag, attrs.get("class", ""), attrs.get("id", "") if tag in ("div", "section", "main") else "")

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]


def parse(source: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    at, n, last = 0, len(source), source.rfind(">")
    tag = _TAG
    while at < n:
        start, m = at, None
        if at > last:  # no tag ends any more
            stack[-1].kids.append(source[at:].partition("<!--")[0])
            break
        if source[at] == "<" and _NAME.match(source, at):
            m = tag.match(source, at)
            if m is None and tag is _TAG:
                tag = _LOOSE  # quotes that never close: from here on tags end at their first >
                m = tag.match(source, at)
        m = m or _OTHER.match(source, at)
        at = m.end()
        name = m[2]
        if not name:
            if source[start] != "<" or at - start == 1:
                stack[-1].kids.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag closes nothing outside its block
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if name in CLOSES:
            same, within = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same.split():
                    del stack[k:]
                elif stack[k].tag in within:
                    break
        attrs = {a[1].lower(): htmllib.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3] and not m[3].isspace() else {}
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}", re.I).search(source, at)
            if name == "textarea" and end:
                node.kids.append(source[at : end.start()])
            stop = end.start() if end else n
            close = source.find(">", stop)
            at = n if end is None or close < 0 else close + 1
        elif name not in VOID and not m[3].rstrip().endswith("/") or name in BLOCK - VOID:
            stack.append(node)
    return root


# ---------------------------------------------------------------- simple tree matching


def finish(root: Node) -> list[Node]:
    """Sizes and structural signatures, bottom up; the nodes in document order."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(reversed(x.elements()))
    for x in reversed(order):
        kids = x.elements()
        x.size = 1 + sum(k.size for k in kids)
        x.sig = hash((x.key, tuple(k.sig for k in kids)))
    return order


class Matcher:
    """Scores of pairs of trees are kept by structure, so repeated siblings cost one look-up."""

    #: Levels that are scored by recursion; what lies deeper is scored from an explicit stack.
    LEVELS = 50

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}
        self.level = 0

    def score(self, a: Node, b: Node) -> int:
        if a.key != b.key:
            return 0
        if a.sig == b.sig:
            return a.size
        got = self.known.get((a.sig, b.sig))
        if got is None:
            if not self.level and len(self.known) > 200_000:
                self.known.clear()
            if self.level >= self.LEVELS:
                self._deep(a, b)
                return self.known[a.sig, b.sig]
            self.level += 1
            got = 1 + self._lists(a.elements(), b.elements())[0]
            self.level -= 1
            self.known[a.sig, b.sig] = got
        return got

    def _deep(self, a: Node, b: Node) -> None:
        """Scores a pair when all pairs below it are known."""
        todo = [(a, b, False)]
        while todo:
            x, y, below = todo.pop()
            if (x.sig, y.sig) in self.known:
                continue
            if below:
                self.known[x.sig, y.sig] = 1 + self._lists(x.elements(), y.elements())[0]
                continue
            todo.append((x, y, True))
            pairs = {(p.sig, q.sig): (p, q, False) for p in x.elements() for q in y.elements() if p.key == q.key and p.sig != q.sig}
            todo.extend(v for k, v in pairs.items() if k not in self.known)

    def _lists(self, xs: list[Node], ys: list[Node], trace: bool = False) -> tuple[int, list[tuple[Node, Node]]]:
        # equal siblings at both ends match in some best solution, as no pair scores more
        head, tail, most = 0, 0, min(len(xs), len(ys))
        while head < most and xs[head].sig == ys[head].sig:
            head += 1
        while tail < most - head and xs[-1 - tail].sig == ys[-1 - tail].sig:
            tail += 1
        if head or tail:
            got, mid = self._lists(xs[head : len(xs) - tail], ys[head : len(ys) - tail], trace)
            ends = [*zip(xs[:head], ys[:head], strict=True), *(zip(xs[-tail:], ys[-tail:], strict=True) if tail else ())]
            return got + sum(x.size for x, _ in ends), mid + ends
        m, n = len(xs), len(ys)
        if not m or not n:
            return 0, []
        if m * n > MAX_CELLS:
            return self._long_lists(xs, ys, trace)
        rows = [[0] * (n + 1)]
        for x in xs:
            prev, row = rows[-1], [0]
            for j, y in enumerate(ys):
                s = self.score(x, y)
                best = prev[j] + s if s else 0
                row.append(max(best, prev[j + 1], row[j]))
            rows.append(row)
        pairs, i, j = [], m, n
        while trace and i and j:
            s = self.score(xs[i - 1], ys[j - 1])
            if s and rows[i][j] == rows[i - 1][j - 1] + s:
                pairs.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return rows[m][n], pairs[::-1]

    def _long_lists(self, xs: list[Node], ys: list[Node], trace: bool) -> tuple[int, list[tuple[Node, Node]]]:
        """The same programme row by row: only every root-of-m-th row is held, and the rows between are made again for the trace."""
        m, n = len(xs), len(ys)
        places: dict[tuple, dict[object, list[int]]] = {}
        for j, y in enumerate(ys):
            places.setdefault(y.key, {}).setdefault(y.sig, []).append(j)

        def scores(x: Node) -> np.ndarray:
            s = np.zeros(n, np.int64)
            for at in places.get(x.key, {}).values():
                s[at] = self.score(x, ys[at[0]])
            return s

        def after(prev: np.ndarray, s: np.ndarray) -> np.ndarray:
            row = np.zeros(n + 1, np.int64)
            row[1:] = np.maximum.accumulate(np.maximum(prev[1:], np.where(s > 0, prev[:-1] + s, 0)))
            return row

        step = math.isqrt(m) + 1
        row, held = np.zeros(n + 1, np.int64), []
        for i, x in enumerate(xs):
            if i % step == 0:
                held.append(row)
            row = after(row, scores(x))
        pairs, j = [], n
        for b in range(len(held) - 1, -1, -1) if trace else ():
            part = xs[b * step : (b + 1) * step]
            of, rows = [scores(x) for x in part], [held[b]]
            for s in of:
                rows.append(after(rows[-1], s))
            i = len(part)
            while i and j:
                s = of[i - 1][j - 1]
                if s and rows[i][j] == rows[i - 1][j - 1] + s:
                    pairs.append((part[i - 1], ys[j - 1]))
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return int(row[n]), pairs[::-1]

    def align(self, ref: Node, page: Node) -> Iterator[tuple[Node, Node]]:
        todo = [(ref, page)]
        while todo:
            a, b = todo.pop()
            yield a, b
            todo.extend(self._lists(a.elements(), b.elements(), True)[1])


# ---------------------------------------------------------------- content


def _is_cue(node: Node) -> bool:
    if node.tag in NEVER or node.attrs.get("role", "").lower() in ROLES or "hidden" in node.attrs:
        return True
    return _says_cue(node)


def _says_cue(node: Node) -> bool:
    """Is one of the element's names a cue word, alone or with words of structure and other cues only?"""
    said = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    if said == " ":
        return False
    names = [set(_CUE.findall(name)) for name in said.lower().split()]
    return any(words & CUES and words <= CUES | STRUCTURE for words in names)


def _main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main" or node.attrs.get("itemprop") == "articleBody"


def marked(order: list[Node]) -> tuple[set[int], set[int]]:
    """Ids of main containers, and of the elements that are never content (none of which holds a container)."""
    main, holds, title = set(), set(), set()
    for x in reversed(order):
        kids = x.elements()
        if any(id(k) in main or id(k) in holds for k in kids):
            holds.add(id(x))
        if x.tag == "h1" or any(id(k) in title for k in kids if k.tag not in ("article", "main")):
            title.add(id(x))
        if _main(x) and not _says_cue(x):
            main.add(id(x))
    never: set[int] = set()
    within: list[tuple[Node, bool, bool]] = [(order[0], False, False)]
    kept_main: set[int] = set()
    while within:
        x, off, inside = within.pop()
        if not off:
            head = x.tag == "header" or _is_cue(x)
            if head and id(x) not in holds and id(x) not in main and not (inside and id(x) in title and x.tag not in NEVER):
                off = True
            elif id(x) in holds and x.tag in ("nav", "aside", "footer", "form") and x.tag != "form":
                off = True  # an article inside a sidebar is no main text
        if off:
            never.add(id(x))
        elif id(x) in main:
            kept_main.add(id(x))
            inside = True
        within.extend((k, off, inside) for k in x.elements())
    return kept_main, never


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def named(ref: tuple[Node, dict[int, int]] | None, root: Node, matcher: Matcher) -> dict[int, int]:
    """The slot of each element: its counterpart's number in the reference, else a (negative) hash of the parent's slot and its own key."""
    slots = {id(b): ref[1][id(a)] for a, b in matcher.align(ref[0], root)} if ref else {}
    todo = [(root, slots.setdefault(id(root), 0))]
    while todo:
        x, slot = todo.pop()
        for k in x.elements():
            if id(k) not in slots:
                slots[id(k)] = -1 - _digest(f"{slot} {k.key}")
            todo.append((k, slots[id(k)]))
    return slots


class Block:
    """Text of one block; ``owner`` its innermost block element, ``chain`` the containers around it, outermost first, ``main`` how many of them lie outside the main part (-1: not in a main part)."""

    __slots__ = ("chain", "head", "main", "owner", "text")

    def __init__(self, text: str, owner: Node, chain: tuple[Node, ...], main: int, head: bool):
        self.text, self.owner, self.chain, self.main, self.head = text, owner, chain, main, head


def page_blocks(root: Node, main: set[int], drop: set[int]) -> list[Block]:
    """The blocks of a page in order, without those in ``drop``."""
    out: list[Block] = []
    buf: list[str] = []

    def flush(owner: Node, chain: tuple[Node, ...], at: int, head: bool) -> None:
        text = " ".join(htmllib.unescape("".join(buf)).split())
        buf.clear()
        if text:
            out.append(Block(text, owner, chain, at, head))

    todo: list[tuple] = [(root, root, (), -1, False)]
    while todo:
        x, owner, chain, at, head = todo.pop()
        if x is None:
            flush(owner, chain, at, head)
        elif isinstance(x, str):
            buf.append(x)
        elif id(x) not in drop:
            if x.tag == "br":
                buf.append(" ")
            elif x.tag in BLOCK or x.tag == "#root":
                flush(owner, chain, at, head)
                if id(x) in main and at < 0:
                    at = len(chain)
                owner, head = x, head or x.tag == "h1"
                if x.tag in CONTAINERS:
                    chain = (*chain, x)
                todo.append((None, owner, chain, at, head))
            elif id(x) in main and at < 0:
                at = len(chain)
            todo.extend((k, owner, chain, at, head) for k in reversed(x.kids))
    return out


def content(blocks: list[tuple[str, int, int, list[int], int, bool]], mean: dict[int, float] | None, template: set[tuple[int, int]]) -> list[str]:
    """Texts of the content among the blocks (text, slot, digest, chain, main, head); ``mean``: varying characters of a block by slot, None without a wrapper."""
    if mean is None and all(b[4] < 0 for b in blocks):
        return [b[0] for b in blocks]
    varies = [0.0 if (slot, t) in template else (mean or {}).get(slot) or float(len(text)) for text, slot, t, *_ in blocks]
    said = [b[4] >= 0 for b in blocks]
    if any(said) and (mean is None or 2 * sum(w for w, x in zip(varies, said, strict=True) if x) >= sum(varies)):
        blocks, varies = [b for b, x in zip(blocks, said, strict=True) if x], [w for w, x in zip(varies, said, strict=True) if x]
    else:  # what calls itself the main part holds less of what varies than the rest does
        blocks = [(*b[:4], -1, b[5]) for b in blocks]
    weight: dict[int, float] = {}
    for (_, _, _, chain, _, _), w in zip(blocks, varies, strict=True):
        for x in chain:
            weight[x] = weight.get(x, 0.0) + w
    outside = None  # how many containers of the main text's chain lie outside it; the page itself if None
    within = 0
    if blocks and blocks[0][4] < 0:
        heads = [b[3] for b, w in zip(blocks, varies, strict=True) if b[5] and w]
        for _, _, _, chain, _, _ in blocks:
            for depth, x in enumerate(chain):
                if 2 * weight[x] > sum(varies) and depth >= within and all(x in h for h in heads):
                    outside, within = x, depth
    kept = []
    for (text, _, _, chain, main, _), w in zip(blocks, varies, strict=True):
        if outside is not None and outside not in chain:
            continue
        inner = chain[main + 1 :] if main >= 0 else chain[within + 1 :] if outside is not None else chain
        if w or (main >= 0 or outside is not None) and all(weight[x] for x in inner):
            kept.append(text)
    return kept


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


class _Reference:
    """The last reference pages parsed; pages of a host come together, so they are parsed once for many."""

    def __init__(self) -> None:
        self.trees: dict[str, tuple[Node, dict[int, int]]] = {}

    def of(self, source: str) -> tuple[Node, dict[int, int]]:
        if source not in self.trees:
            if len(self.trees) > 64:
                self.trees.clear()
            root = parse(source)
            self.trees[source] = (root, {id(x): k for k, x in enumerate(finish(root))})
        return self.trees[source]


def _beside(wide: DataFrame, side: DataFrame, size: Column, how: str = "left") -> DataFrame:
    """``wide`` joined with one row a host: sent to all tasks if it is small, by measure; else shuffled, where the adaptive join splits a hot host."""
    total = side.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return wide.join(F.broadcast(side) if total <= BROADCAST_BYTES else side, "host", how)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``."""
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    filled = given.where("html <> ''").withColumn("page", F.xxhash64("html"))
    # hosts of too few pages cannot have a template
    chosen = filled.groupBy("host").agg(F.min("page").alias("page"), F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "page")
    refs = stored(_beside(filled, stored(chosen.withColumnRenamed("page", "ref")), F.length("host") + 8, "inner").where("page = ref").groupBy("host").agg(F.min("html").alias("ref")))
    kind = dict(pages.dtypes)["page_id"]

    def observe(rows: Iterator[tuple]) -> Iterator[tuple]:
        matcher, held = Matcher(), _Reference()
        for page_id, url, host, source, ref in rows:
            root = parse(source)
            main, never = marked(finish(root))
            found = page_blocks(root, main, never)
            slots = named(held.of(ref) if ref else None, root, matcher)
            number: dict[int, int] = {}
            chains = [[number.setdefault(id(x), len(number)) for x in b.chain] for b in found]
            texts, of = [b.text for b in found], [slots[id(b.owner)] for b in found]
            digests = [_digest(t) for t in texts]
            seen: set[int] = set()
            first = [not (s in seen or seen.add(s)) for s in of]
            yield page_id, url, host, _digest("\n".join(texts)), ref is not None, texts, of, digests, first, chains, [b.main for b in found], [b.head for b in found]

    types = f"page_id {kind}, url string, host string, article long, wrapped boolean, text array<string>, slot array<long>, t array<long>, first array<boolean>, chain array<array<int>>, main array<int>, head array<boolean>"
    seen = stored(map_rows(_beside(given, refs, F.length("ref")).select("page_id", "url", "host", "html", "ref"), observe, types, 256))

    one = seen.where("wrapped").select(F.xxhash64("host").alias("host"), "article", F.explode(F.arrays_zip("slot", "t", "first", F.transform("text", F.length).alias("n"))).alias("b"))
    one = one.select("host", "article", "b.slot", "b.t", F.col("b.first").cast("int").alias("first"), F.col("b.n").alias("chars")).groupBy("host", "slot", "t", "article").agg(F.max("first").alias("first"), F.max("chars").alias("chars"))
    texts = stored(one.groupBy("host", "slot", "t").agg(F.count("*").alias("n"), F.sum("first").alias("pages"), F.max("chars").alias("chars")))
    slots = stored(texts.groupBy("host", "slot").agg(F.sum("n").alias("texts"), F.sum("pages").alias("pages"), F.sum(F.col("n") * F.col("chars")).alias("chars")).where(F.col("pages") >= MIN_PAGES))
    often = texts.where(F.col("n") >= SHARE * MIN_PAGES).select("host", "slot", "t", F.col("n").alias("same"), F.col("chars").alias("long"))
    fixed = stored(slots.join(often, ["host", "slot"]).where(F.col("same") >= SHARE * F.col("pages")).select("host", "slot", "t", "same", "long"))
    less = fixed.groupBy("host", "slot").agg(F.sum("same").alias("same"), F.sum(F.col("same") * F.col("long")).alias("long"), F.collect_list("t").alias("ts"))  # one or two texts: each is on most pages of the slot
    rest = F.col("texts") - F.coalesce("same", F.lit(0))
    mean = F.when(rest > 0, (F.col("chars") - F.coalesce("long", F.lit(0))) / rest).otherwise(0.0)
    wrapper = slots.join(less, ["host", "slot"], "left").groupBy("host").agg(F.collect_list(F.struct("slot", mean.alias("mean"), F.coalesce("ts", F.array().cast("array<long>")).alias("ts"))).alias("w"))
    wrapper = stored(wrapper.select("host", F.col("w.slot").alias("of"), F.col("w.mean").alias("mean"), F.col("w.ts").alias("ts")))

    def extract(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, tuple[dict[int, float], set[tuple[int, int]]]] = {}
        for page_id, url, host, text, slot, t, chain, main, head, of, mean, ts in rows:
            if of is not None and host not in held:
                if len(held) > 64:
                    held.clear()
                held[host] = dict(zip(of, mean, strict=True)), {(s, x) for s, xs in zip(of, ts, strict=True) for x in xs}
            weights, template = held[host] if of is not None else (None, set())
            out = "\n".join(content(list(zip(text, slot, t, chain, main, head, strict=True)), weights, template))
            yield page_id, url, out, len(out)

    laid = seen.select("page_id", "url", F.xxhash64("host").alias("host"), "text", "slot", "t", "chain", "main", "head")
    wide = _beside(laid, wrapper, 32 * F.size("of")).select("page_id", "url", "host", "text", "slot", "t", "chain", "main", "head", "of", "mean", "ts")
    return map_rows(wide, extract, f"page_id {kind}, url string, text string, n_chars long", 512)
