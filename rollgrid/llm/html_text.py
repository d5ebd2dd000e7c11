"""Main text of web pages by wrapper induction over the pages of a host.

1. Pages of a host whose tags are the same up to the first paragraph share a layout. One page (the lowest hash) of each
   of its ``PIVOTS`` commonest layouts is a pivot. Every other page's DOM tree is aligned with the pivot of its own
   layout, or else the one that it matches best, by simple tree matching: the largest set of node pairs that keeps
   labels, parents and order.
2. Over all different pages of the pivot but itself, each pivot node counts how often it was matched, how often with
   the same text, and how much varying text stood below it. Pages of equal text (that of the marked article, where
   there is one) count once, and those that read like the pivot say nothing of what is constant. Counts are added up
   inside tasks before they are shuffled, so one host may have a third of all pages.
3. Nodes whose text is the same on nearly all pages are template; on hosts of few pages, only pages that differ in most
   of their text show that, as two versions of one article agree in the rest. Varying slots are content; where a page marks its
   article, the slots inside it, else those below the pivot node that holds nearly all varying text.
4. Each page is aligned again and its content blocks are put out in page order. Elements that hold no article text by
   their meaning (menus, adverts, forms, scripts, comments ...) are left out whatever varies in them. A class or an id
   tells the meaning only if all its words do, and never of an element that holds a marked article or most of the text.

Alignments depend on the two trees' structure only, and are kept by its digest in each Python worker, up to a bounded
number of nodes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import broadcast_if_small, read, stored

#: A text is template if it stands on this share of the pages on which its node was found, and if these are so many, or
#: if it stands on half the host's other pages, ``FEW`` at least, that differ from the pivot in most of their text.
SAME, SUPPORT, FEW = 0.75, 8, 2
#: Share of the varying text that the content container of a page without marked article holds.
CONTAINED = 0.8
#: Total characters of pivot pages that are broadcast.
PIVOT_CHARS = 48_000_000
#: Layouts of a host that get a pivot of their own.
PIVOTS = 3
#: Nodes of alignments, and characters of pivot pages, that a Python worker keeps.
KEPT_NODES, KEPT_CHARS = 4_000_000, 16_000_000
#: Cells of the largest table that is kept whole; longer lists of children are halved until theirs are smaller.
CELLS = 200_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z0-9]+")
RAW = {name: re.compile(rf"</{name}[\s/>]|\Z", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a start tag of the key closes, if open inside the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements in which a block does not close a paragraph that is open around them.
KEEPS = ("article", "main", "section", "div", "td", "th", "li", "body", "table", "button", "blockquote")
#: Elements whose inside stray end tags of other than blocks do not leave.
BARRIERS = ("article", "main", "td", "th")
#: Elements that never hold article text.
OUT = frozenset("aside button canvas datalist dialog footer form head iframe input label math menu nav noembed noframes noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or an id that tell what an element holds.
OUT_NAMES = frozenset(
    "ad ads adslot advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored submenu subnav subscribe sidenav toolbar topnav widget".split()
)
HEAD_NAMES = frozenset("header masthead topbar".split())
#: Words that say nothing of what an element holds.
PLAIN_NAMES = frozenset("area bar bottom box btn button center container desktop fixed form group icon inner item items left level link links list main mobile outer page panel post posts primary right row secondary section site slot sticky top unit wrap wrapper".split())
MARKED = frozenset(("article", "main"))


class Tree:
    """A page as nodes in document order: label, parent, own text, and whether the meaning of the node rules it out."""

    def __init__(self, source: str):
        self.labels, self.parents, self.out, self.marked = ["#"], [-1], [False], [False]
        #: Whether the node's own tag is a mark, and whether its class or id rules it out.
        self.marks, self.named = [False], [False]
        self.children: list[list[int]] = [[]]
        #: (node, text) in page order; text None is the edge of a block.
        self.events: list[tuple[int, str | None]] = []
        self._read(source)
        texts: list[list[str]] = [[] for _ in self.labels]
        for node, text in self.events:
            if text is not None:
                texts[node].append(text)
        self.texts = [" ".join(" ".join(t).split()) if t else "" for t in texts]
        if any(self.named):
            self._judge()
        self.structure = self._structure()

    def _open(self, name: str, attributes: str, parent: int) -> int:
        found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t\r") else {}
        kind = found.get("class", "").lower()
        inside = self.marked[parent]
        marked = name in MARKED or found.get("role") in ("main", "article")
        out = self.out[parent] or name in OUT or "hidden" in found or found.get("role") in ROLES or "display:none" in found.get("style", "").replace(" ", "").lower()
        out = out or (name == "header" and not inside)
        named = False
        if not out and name not in ("html", "body"):
            for token in (*kind.split(), *found.get("id", "").lower().split()):
                words = [w for w in WORDS.findall(token) if not w.isdigit()]
                telling = OUT_NAMES if inside or marked else OUT_NAMES | HEAD_NAMES
                if any(w in telling for w in words) and all(w in telling or w in PLAIN_NAMES for w in words):
                    named = True
        self.marks.append(marked and not out)
        self.named.append(named)
        self.labels.append(f"{name}.{kind}" if kind else name)
        self.parents.append(parent)
        self.out.append(out)
        self.marked.append((inside or marked) and not out)
        self.children.append([])
        number = len(self.labels) - 1
        self.children[parent].append(number)
        return number

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        #: Places in the stack of the open elements of each name.
        opened: dict[str, list[int]] = {}
        events, at, end = self.events, 0, len(source)

        def last(names: Iterable[str]) -> int:
            return max((opened[n][-1] for n in names if opened.get(n)), default=0)

        def text(until: int) -> None:
            if until > at:
                events.append((stack[-1][1], html.unescape(source[at:until])))

        def close(index: int) -> None:
            while len(stack) > max(index, 1):
                name, node = stack.pop()
                opened[name].pop()
                if name in BLOCK:
                    events.append((node, None))

        while at < end:
            match = TOKEN.search(source, at)
            if match is None:
                text(end)
                break
            text(match.start())
            at = match.end()
            name = match[2]
            if name is None:
                continue
            name = name.lower()
            if match[1]:
                place = last((name,))
                if place and (name in BLOCK or place >= last(BARRIERS)):  # a stray end tag inside does not close what stands around
                    close(place)
                if name in ("br", "p"):
                    events.append((stack[-1][1], None))
                continue
            if name in BLOCK:  # a block closes an open paragraph
                place = last(("p",))
                if place > last(KEEPS):
                    close(place)
            if name in CLOSES:
                shut, scope = CLOSES[name]
                place = last(shut)
                if place > last(scope):
                    close(place)
            if name in ("br", "hr", "wbr"):
                if name != "wbr":
                    events.append((stack[-1][1], None))
                continue
            if name in VOID:
                continue
            node = self._open(name, match[3], stack[-1][1])
            if name in RAW:
                stop = RAW[name].search(source, at)
                closing = source.find(">", stop.start())
                at = end if closing < 0 else closing + 1
                continue
            if name in BLOCK:
                events.append((node, None))
            if not match[3].endswith("/") or name in BLOCK:
                opened.setdefault(name, []).append(len(stack))
                stack.append((name, node))
        close(1)

    def _judge(self) -> None:
        """Rule out what classes and ids name, but for elements that hold a marked article or most of the text."""
        n = len(self.labels)
        mass, holds = [0 if self.out[i] else len(t) for i, t in enumerate(self.texts)], [False] * n
        for node in range(n - 1, 0, -1):
            mass[self.parents[node]] += mass[node]
            holds[self.parents[node]] |= holds[node] or (self.marks[node] and not self.named[node])
        for node in range(1, n):
            if self.out[self.parents[node]] or (self.named[node] and not holds[node] and 2 * mass[node] <= mass[0]):
                self.out[node], self.marked[node] = True, False

    @cached_property
    def skeleton(self) -> tuple[str, ...]:
        """The tags up to the first paragraph."""
        tags = [label.partition(".")[0] for label in self.labels]
        return tuple(tags[: tags.index("p")] if "p" in tags else tags)

    @cached_property
    def key(self) -> int:
        """Digest of the structure."""
        return xxhash.xxh3_128_intdigest("\0".join(self.labels) + "\1" + ",".join(map(str, self.parents)))

    @cached_property
    def used(self) -> list[bool]:
        """The nodes that are not ruled out, inside marks where there are any."""
        return self.marked if any(self.marked) else [not out for out in self.out]

    @cached_property
    def digest(self) -> int:
        """Hash of the text of the used nodes."""
        words = " ".join(text for node, text in self.events if text is not None and self.used[node]).split()
        return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)

    def _structure(self) -> tuple:
        """The tree without texts; trees of equal structure align alike. Long runs of equal leaves take little room."""
        return tuple(self.labels), tuple(self.parents)


class Kept(dict):
    """A store that is emptied when the weights of what it holds come to more than a bound."""

    def __init__(self, bound: int):
        self.bound, self.held = bound, 0

    def keep(self, key, value, weight: int):
        if self.held + weight > self.bound:
            self.clear()
            self.held = 0
        self.held += weight
        self[key] = value
        return value


alignments, pivots_read = Kept(KEPT_NODES), Kept(KEPT_CHARS)


def partners(page: Tree, pivot: Tree) -> tuple[int, ...]:
    """The alignment of two trees, from the store if it holds them."""
    key = page.key, pivot.key
    if key not in alignments:
        return alignments.keep(key, aligned(page.structure, pivot.structure), len(page.labels) + 100)
    return alignments[key]


def aligned(page: tuple, pivot: tuple) -> tuple[int, ...]:
    """For each node of the page its partner in the pivot, or -1: simple tree matching with its traceback."""
    kids: list[list[list[int]]] = []
    forms: list[list[int]] = []
    known: dict[tuple, int] = {}
    # of each form, that is, subtree: its label, the forms of its children, and its nodes
    label: list[str] = []
    parts: list[tuple[int, ...]] = []
    sizes: list[int] = []
    for names, parents in (page, pivot):
        below: list[list[int]] = [[] for _ in names]
        for node in range(1, len(names)):
            below[parents[node]].append(node)
        form = [0] * len(names)
        for node in range(len(names) - 1, -1, -1):  # children have higher numbers than their parents
            children = tuple(form[c] for c in below[node])
            number = form[node] = known.setdefault((names[node], children), len(known))
            if number == len(label):
                label.append(names[node])
                parts.append(children)
                sizes.append(1 + sum(sizes[c] for c in children))
        kids.append(below)
        forms.append(form)
    partner = [-1] * len(page[0])
    scores: dict[tuple[int, int], int] = {}

    def cut(a: Sequence[int], b: Sequence[int]) -> tuple[int, int]:
        """Lengths of the beginning and the end that are equal; to match these forms is never worse."""
        n, head, tail = min(len(a), len(b)), 0, 0
        while head < n and a[head] == b[head]:
            head += 1
        while tail < n - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return head, tail

    def score(f: int, g: int) -> int:
        """Size of the largest matching of two subtrees; of those that differ under one label, settle() comes first."""
        return sizes[f] if f == g else scores[f, g] if label[f] == label[g] else 0

    def table(a: Sequence[int], b: Sequence[int]) -> list[list[int]]:
        rows = [[0] * (len(b) + 1)]
        for f in a:
            last, row = rows[-1], [0]
            for j, g in enumerate(b):
                row.append(max(last[j + 1], row[j], last[j] + score(f, g)))
            rows.append(row)
        return rows

    def last_row(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
        """The last row of table(), without the others."""
        kinds = list(dict.fromkeys(b))
        place = {g: n for n, g in enumerate(kinds)}
        at = np.array([place[g] for g in b])
        gains: dict[int, np.ndarray] = {}
        row = np.zeros(len(b) + 1, np.int64)
        for f in a:
            if f not in gains:
                gains[f] = np.array([score(f, g) for g in kinds], np.int64)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains[f][at]))
        return row

    def matched(a: Sequence[int], b: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Places in a and b of the pairs of a largest matching."""
        if len(a) > 1 and len(a) * len(b) > CELLS:
            middle = len(a) // 2
            split = int(np.argmax(last_row(a[:middle], b) + last_row(a[:middle - 1 : -1], b[::-1])[::-1]))
            yield from matched(a[:middle], b[:split])
            yield from ((i + middle, j + split) for i, j in matched(a[middle:], b[split:]))
            return
        rows = table(a, b)
        i, j = len(a), len(b)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield i, j

    def settle(f: int, g: int) -> None:
        """Scores of all pairs on which that of f and g rests, the deepest first; trees may be deeper than calls."""
        work = [(f, g, 0)]
        while work:
            f, g, done = work.pop()
            if (f, g) in scores:
                continue
            a, b = parts[f], parts[g]
            head, tail = cut(a, b)
            total = 1 + sum(sizes[c] for c in a[:head]) + sum(sizes[c] for c in a[len(a) - tail :])
            a, b = a[head : len(a) - tail], b[head : len(b) - tail]
            if a and b:
                following = dict.fromkeys(b)
                each = list(dict.fromkeys(a))
                while done < len(each):
                    c = each[done]
                    missing = [(c, d, 0) for d in following if c != d and label[c] == label[d] and (c, d) not in scores]
                    done += 1
                    if missing:
                        work.append((f, g, done))
                        work += missing
                        break
                else:
                    scores[f, g] = total + (table(a, b)[-1][-1] if len(a) * len(b) <= CELLS else int(last_row(a, b)[-1]))
            else:
                scores[f, g] = total

    if forms[0][0] != forms[1][0]:
        settle(forms[0][0], forms[1][0])
    work = [(0, 0)]
    while work:
        x, y = work.pop()
        partner[x] = y
        a, b = kids[0][x], kids[1][y]
        c, d = parts[forms[0][x]], parts[forms[1][y]]
        head, tail = cut(c, d)
        work += zip(a[:head], b[:head])
        work += zip(a[len(a) - tail :], b[len(b) - tail :])
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if a and b:
            work += ((a[i], b[j]) for i, j in matched(c[head : len(c) - tail], d[head : len(d) - tail]))
    return tuple(partner)


def pivot_tree(source: str) -> Tree:
    if source not in pivots_read:
        return pivots_read.keep(source, Tree(source), len(source) + 100)
    return pivots_read[source]


def best_pivot(page: Tree, pivots: list[Tree]) -> int:
    """The pivot of the page's layout, or else the one with the largest share of nodes in the matching."""
    for n, pivot in enumerate(pivots):
        if page.skeleton == pivot.skeleton:
            return n
    share = lambda pivot: sum(x >= 0 for x in partners(page, pivot)) / (len(page.labels) + len(pivot.labels))
    return max(range(len(pivots)), key=lambda n: (share(pivots[n]), -n)) if len(pivots) > 1 else 0


def observed(page: Tree, pivot: Tree) -> Iterator[tuple[int, int, int]]:
    """(pivot node, whether its text is the same, characters of varying text) for each matched node of the page."""
    partner = partners(page, pivot)
    owner = list(partner)
    for node in range(1, len(owner)):
        if owner[node] < 0:
            owner[node] = owner[page.parents[node]]
    loose: dict[int, int] = {}
    for node, text in enumerate(page.texts):
        if text and not page.out[node] and not (partner[node] >= 0 and pivot.texts[partner[node]] == text):
            loose[owner[node]] = loose.get(owner[node], 0) + len(text)
    for node, mate in enumerate(partner):
        if mate >= 0 and (page.texts[node] or mate in loose):
            yield mate, int(bool(page.texts[node]) and pivot.texts[mate] == page.texts[node]), loose.pop(mate, 0)


def differs(page: Tree, pivot: Tree) -> bool:
    """Whether less than half of the page's text stands in the pivot's nodes as well."""
    lengths = [len(text) if use else 0 for text, use in zip(page.texts, page.used)]
    same = sum(n for n, text, mate in zip(lengths, page.texts, partners(page, pivot)) if n and mate >= 0 and pivot.texts[mate] == text)
    return 2 * same < sum(lengths)


def container(pivot: Tree, masses: dict[int, int]) -> int:
    """The deepest pivot node below which CONTAINED of the varying text stands."""
    below = [0] * len(pivot.labels)
    for node, mass in masses.items():
        if node < len(below):
            below[node] += mass
    for node in range(len(below) - 1, 0, -1):
        below[pivot.parents[node]] += below[node]
    at = 0
    while True:
        following = [c for c in pivot.children[at] if below[c] >= CONTAINED * below[0] > 0]
        if not following:
            return at
        at = following[0]


def extract(page: Tree, pivot: Tree | None = None, template: frozenset[int] = frozenset(), within: int = 0) -> str:
    """The content blocks of a page, joined by line feeds."""
    use = [not out for out in page.out]
    if any(page.marked):
        use = [a and b for a, b in zip(use, page.marked)]
    elif pivot is not None and within:
        partner = partners(page, pivot)
        inside = [mate == within for mate in partner]
        for node in range(1, len(inside)):
            inside[node] = inside[node] or inside[page.parents[node]]
        if any(inside):
            use = [a and b for a, b in zip(use, inside)]
    if template and pivot is not None:
        for node, mate in enumerate(aligned(page.structure, pivot.structure)):
            if mate in template and page.texts[node] and page.texts[node] == pivot.texts[mate]:
                use[node] = False
    blocks: list[str] = []
    held: list[str] = []
    for node, text in page.events:
        if text is None:
            if held:
                blocks.append(" ".join("".join(held).split()))
                held = []
        elif use[node]:
            held.append(text)
    if held:
        blocks.append(" ".join("".join(held).split()))
    return "\n".join(b for b in blocks if b)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if none), n_chars.

    Null or empty html gives an empty text. A page without a host (null or odd url) is read by its own marks alone.
    Equal rows each give a row. Pages cut off anywhere, unclosed or badly nested elements are read as browsers do, as
    far as blocks go. Several marked articles are put out in page order. An empty table gives an empty table; other
    columns take no part.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.when(host != "", host).alias("host"))
    known = rows.where("host is not null and html <> ''").withColumn("rank", F.xxhash64("page_id", "html"))
    layout = F.xxhash64(F.regexp_extract_all(F.substring_index("html", "<p", 1), F.lit("<([a-zA-Z][^\\s/>]*)"), F.lit(1)))
    layouts = known.groupBy("host", layout.alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    commonest = W.partitionBy("host").orderBy(F.col("n").desc(), "layout")
    chosen = layouts.withColumn("which", F.row_number().over(commonest)).where(F.col("which") <= PIVOTS).select("host", "rank", "which")
    pivots = known.join(broadcast_if_small(stored(chosen, "pivot-ranks")), ["host", "rank"]).groupBy("host", "which").agg(F.min("html").alias("pivot"))
    pivots = stored(pivots, "pivots")
    chars = pivots.agg(F.coalesce(F.sum(F.length("pivot")), F.lit(0))).first()[0]
    by_host = pivots.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "pivot"))), lambda x: x["pivot"]).alias("pivots"))

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if chars <= PIVOT_CHARS else df

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, which, digests, nodes = [], [], [], []
            for i in range(batch.num_rows):
                page, trees = Tree(batch.column(1)[i].as_py()), [pivot_tree(x) for x in batch.column(2)[i].as_py()]
                n = best_pivot(page, trees)
                if page.digest != trees[n].digest:
                    hosts.append(batch.column(0)[i].as_py())
                    which.append(n + 1)
                    digests.append(page.digest)
                    far = int(differs(page, trees[n]))
                    # node -1 counts the pages
                    nodes.append([{"node": x, "same": same, "far": same * far, "loose": loose} for x, same, loose in [(-1, 0, 0), *observed(page, trees[n])]])
            kind = pa.list_(pa.struct([("node", pa.int32()), ("same", pa.int32()), ("far", pa.int32()), ("loose", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(which, pa.int32()), pa.array(digests, pa.int64()), pa.array(nodes, kind)], ["host", "which", "digest", "nodes"])

    paired = known.select("host", "html").join(hinted(by_host), "host")
    different = paired.mapInArrow(learn, "host string, which int, digest long, nodes array<struct<node:int,same:int,far:int,loose:long>>").groupBy("host", "which", "digest").agg(F.min("nodes").alias("nodes"))
    seen = different.select("host", "which", F.inline("nodes")).groupBy("host", "which", "node").agg(F.count(F.lit(1)).alias("met"), F.sum("same").alias("same"), F.sum("far").alias("far"), F.sum("loose").alias("loose"))
    counted = seen.groupBy("host", "which").agg(F.max(F.when(F.col("node") == -1, F.col("met"))).alias("pages"), F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "met", "same", "far", "loose"))).alias("nodes"))
    constant = lambda x: (x["same"] + 1 >= SAME * (x["met"] + 1)) & ((x["met"] + 1 >= SUPPORT) | (x["far"] >= F.greatest(F.lit(FEW), F.ceil(F.col("pages") / 2))))  # noqa: E731  (with the pivot)
    template = F.transform(F.filter("nodes", constant), lambda x: x["node"]).alias("template")
    masses = F.transform(F.filter("nodes", lambda x: x["loose"] > 0), lambda x: F.struct(x["node"].alias("node"), x["loose"].alias("loose"))).alias("masses")
    wrappers = pivots.join(counted.select("host", "which", template, masses), ["host", "which"], "left").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("which", "pivot", "template", "masses"))).alias("wrappers"))
    wrappers = stored(wrappers, "wrappers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                source, wrappers = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if not source:
                    texts.append("")
                    continue
                page = Tree(source)
                if not wrappers:
                    texts.append(extract(page))
                    continue
                trees = [pivot_tree(w["pivot"]) for w in wrappers]
                n = best_pivot(page, trees)
                within = 0 if any(page.marked) else container(trees[n], {m["node"]: m["loose"] for m in wrappers[n]["masses"] or []})
                texts.append(extract(page, trees[n], frozenset(wrappers[n]["template"] or []), within))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(hinted(wrappers), "host", "left").select("page_id", "url", "html", "wrappers").mapInArrow(cut, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
