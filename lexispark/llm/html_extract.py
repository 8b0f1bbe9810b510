"""Main text of pages by wrapper induction.

Each page is read into a tree (labels: tag and classes). Pages of one host and one layout (the labels of the upper levels) are a group; one page of it (the smallest hash) is its reference. Every page
of the group is aligned with it by simple tree matching, and over all of them it is counted how often each reference node is met, with the same text, with how much text and how much of that is links.

Of these counts the wrapper is made. Slots of one text in nearly all pages are template, and so are slots that hold links above all. From the top, the content slot is the node into which
nearly all of the text goes that varies and is no link: menus, adverts, notices and footers vary too, but have little text of their own or stand outside of it. A page's text is that of the node which stands in the
content slot, without template slots.

What tags, classes and roles say (HINTS) comes second: they break a tie where the counts lead into a part that is named a comment, menu or the like, take such parts out of the content slot, and stand in
for the wrapper where a group has fewer than LEAST_PAGES different pages. `hints=False` does without them.

Only counts of nodes are gathered for a group, summed before the shuffle; no group's pages meet in one task. Wrappers are broadcast if all of them together take at most
WRAPPER_BYTES (measured first), else joined by group.

Defined cases: null or empty html gives an empty text, as does a page without text in its content. A null url, or one without a host, belongs to the host with the empty name. Groups with fewer than
LEAST_PAGES different pages have no wrapper. Unclosed, wrongly nested and cut-off markup is read as far as it goes.
Repeated pages are extracted each and count once for the wrapper. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, over_batches
from .url_filter import host_and_path

LEAST_PAGES, CONSTANT, WRAPPER_BYTES = 8, 0.9, 16 << 20
#: Share of a node's varying text that a child must hold to be gone into; share of links in a slot's text that makes it template; levels of the tree that tell a layout.
HOLDS, LINKED, LEVELS = 0.7, 0.5, 3
#: Alignments that a Python worker keeps.
CACHE_BYTES = 16 << 20

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "td", "th"}
#: Elements without text of the page that stand in a line and so end no block, whatever they hold.
SILENT = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "button", "select", "option", "input", "svg", "canvas", "object", "audio", "video", "map", "embed", "source", "track", "param"}
#: Elements whose text is never a page's own.
MARKUP = {"head", "form", "button", "select", "option", "input", "svg", "canvas", "object", "audio", "video", "map", "frameset", *RAW}
#: HINTS: tags, words of classes and ids, and roles of parts beside the content.
JUNK = {"nav", "footer", "aside", "dialog", "menu"}
JUNK_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search searchform form pagination pager toolbar widget widgets skip hidden".split())
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Elements that an opening tag ends when they are open (up to the barrier elements).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BARRIER = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "select", "aside", "nav", "blockquote"}
ROOTS = {"article", "main"}
#: Elements that can hold a page's content.
HOLDERS = ("html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "center")


class Page:
    """Nodes in page order: label, depth, parent, whether they are markup or named as junk themselves; and the text events (node, text or None for the border of a block, in a link)."""

    def __init__(self, html: str | None, hints: bool = True):
        self.hints = hints
        self.labels, self.depth, self.parent, self.junk, self.markup, self.tags = ["#"], [0], [-1], [False], [False], ["#"]
        self.events: list[tuple[int, str | None, bool]] = []
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements and the node that each belongs to
        html = html or ""
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            stop = m.start() if m else n
            if stop > at:
                text = html[at:stop]
                if m is None and (cut := re.search(r"<[a-zA-Z/!][^>]*$", text)):  # a tag that the page's end cuts off
                    text = text[: cut.start()]
                if text:
                    self.events.append((stack[-1][1], text, any(t == "a" for t, _ in stack)))
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(stack, tag)
                continue
            at = self.open(stack, tag, m[3], html, at)

    def close(self, stack, tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                if any(t not in INLINE and t not in SILENT for t, _ in stack[i:]) and not any(t in SILENT for t, _ in stack[:i]):
                    self.events.append((stack[i][1], None, False))
                elif tag in ("td", "th"):
                    self.events.append((stack[i][1], " ", False))
                del stack[i:]
                return
            if tag in INLINE and stack[i][0] not in INLINE:  # a stray end of a phrase doesn't end blocks
                return

    def open(self, stack, tag: str, attributes: str, html: str, at: int) -> int:
        if tag not in INLINE and tag not in SILENT:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in BARRIER:
                    break
        parent = stack[-1][1]
        node = parent
        words = roles = ()
        found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)} if attributes else {}
        if found:
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower())
            roles = found.get("role", "").lower().split()
        hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        main = self.hints and (tag in ROOTS or "main" in roles or found.get("itemprop", "") == "articleBody")
        junk = self.hints and (tag in JUNK or (not main and tag not in ("html", "body") and (not JUNK_WORDS.isdisjoint(words) or not JUNK_ROLES.isdisjoint(roles))))
        if self.hints and tag == "header" and not any(t in ROOTS for t, _ in stack):
            junk = True
        markup = tag in MARKUP or hidden
        if tag not in INLINE or tag in ("td", "th") or junk or markup:
            node = len(self.labels)
            self.labels.append(f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}" if found.get("class") else tag)
            self.tags.append("main" if main else tag)
            self.depth.append(self.depth[parent] + 1)
            self.parent.append(parent)
            self.junk.append(junk)
            self.markup.append(markup)
            if tag not in INLINE and tag not in SILENT and not any(t in SILENT for t, _ in stack):
                self.events.append((node, None, False))
        if tag in ("br", "td", "th"):
            self.events.append((node, "\n", False))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            return end.end() if end else len(html)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, node))
        return at

    def skeleton(self) -> str:
        return "\n".join(f"{d} {x}" for d, x in zip(self.depth, self.labels, strict=True))

    def layout(self) -> int:
        """A hash of the labels of the upper levels; runs of one label count once."""
        upper = [f"{d} {x}" for d, x in zip(self.depth, self.labels, strict=True) if d <= LEVELS]
        return _hash("\n".join(x for i, x in enumerate(upper) if not i or x != upper[i - 1]))

    def marks(self) -> list[str]:
        """Of each node its tag, with a ! if it or a node above it is named as junk, and an = if one is markup."""
        out: list[str] = []
        for tag, parent, junk, markup in zip(self.tags, self.parent, self.junk, self.markup, strict=True):
            above = out[parent] if parent >= 0 else ""
            out.append(tag + "!" * (junk or "!" in above) + "=" * (markup or "=" in above))
        return out

    def own_texts(self) -> tuple[list[str], list[int]]:
        """Text that stands directly in each node, white space made one blank; and the characters of it that are links."""
        parts: list[list[str]] = [[] for _ in self.labels]
        links = [0] * len(self.labels)
        for node, text, linked in self.events:
            if text is not None:
                parts[node].append(text)
                if linked:
                    links[node] += len(text)
        return [" ".join(unescape("".join(p)).split()) if p else "" for p in parts], links

    def text(self, root: int, template: set[int]) -> str:
        """Blocks below `root` without markup, junk and `template` nodes."""
        ok = [False] * len(self.labels)
        for i in range(len(ok)):
            ok[i] = i == root or (self.parent[i] >= 0 and ok[self.parent[i]] and not self.junk[i] and not self.markup[i] and i not in template)
        if root < len(ok) and "=" in self.marks()[root]:
            return ""
        blocks, part = [], []
        for node, text, _ in [*self.events, (0, None, False)]:
            if text is None:
                block = " ".join(unescape("".join(part)).split()) if part else ""
                if block:
                    blocks.append(block)
                part = []
            elif ok[node]:
                part.append(text)
        return "\n\n".join(blocks)


def _children(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, children, path = [], [], []
    for i, line in enumerate(skeleton.split("\n")):
        depth, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(i)
        path.append(i)
    return labels, children


class _Matcher:
    """Simple tree matching of two skeletons. Subtrees of one shape are compared once, and without recursion, so that depth doesn't matter."""

    def __init__(self, a: str, b: str):
        (self.la, self.ca), (self.lb, self.cb) = _children(a), _children(b)
        shapes: dict[tuple, int] = {}
        self.size: dict[int, int] = {}
        self.sa, self.sb = self._shapes(self.la, self.ca, shapes), self._shapes(self.lb, self.cb, shapes)
        self.known: dict[tuple[int, int], int] = {}

    def _shapes(self, labels, children, shapes) -> list[int]:
        own = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            own[i] = shapes.setdefault((labels[i], *(own[c] for c in children[i])), len(shapes))
            self.size[own[i]] = 1 + sum(self.size[own[c]] for c in children[i])
        return own

    def trimmed(self, x: list[int], y: list[int]):
        """Equal subtrees at both ends of two lists of children match each other: how many at each end."""
        most, head, tail = min(len(x), len(y)), 0, 0
        while head < most and self.sa[x[head]] == self.sb[y[head]]:
            head += 1
        while tail < most - head and self.sa[x[-1 - tail]] == self.sb[y[-1 - tail]]:
            tail += 1
        return head, tail

    def weight(self, i: int, j: int) -> int:
        """Size of the largest matching of two subtrees; 0 for different labels."""
        if self.la[i] != self.lb[j]:
            return 0
        if self.sa[i] == self.sb[j]:
            return self.size[self.sa[i]]
        todo = [(i, j)]
        while todo:
            p, q = todo[-1]
            key = self.sa[p], self.sb[q]
            if key in self.known:
                todo.pop()
                continue
            x, y = self.ca[p], self.cb[q]
            head, tail = self.trimmed(x, y)
            mx, my = ({s[c]: c for c in z[head : len(z) - tail]} for z, s in ((x, self.sa), (y, self.sb)))
            open_ = [(c, e) for u, c in mx.items() for v, e in my.items() if u != v and self.la[c] == self.lb[e] and (u, v) not in self.known]
            if open_:
                todo += open_
            else:
                self.known[key] = 1 + self.pairs(x, y, False)[0]
                todo.pop()
        return self.known[self.sa[i], self.sb[j]]

    def pairs(self, x: list[int], y: list[int], trace: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """Total of the best matching of two lists of children in order, and with `trace` its pairs. Of the table of totals only every so many rows are kept; the rest are worked out again."""
        head, tail = self.trimmed(x, y)
        ends = [*zip(x[:head], y[:head]), *zip(x[len(x) - tail :], y[len(y) - tail :])]
        total = sum(self.size[self.sa[i]] for i, _ in ends)
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if not x or not y:
            return total, ends
        kinds_x, kinds_y = ({s[c]: c for c in z} for z, s in ((x, self.sa), (y, self.sb)))
        column = {v: k for k, v in enumerate(kinds_y)}
        of_y = np.array([column[self.sb[c]] for c in y])
        table = {u: np.array([self.weight(c, e) for e in kinds_y.values()], dtype=np.int32) for u, c in kinds_x.items()}

        def above(below: np.ndarray, p: int) -> np.ndarray:
            w = table[self.sa[x[p]]][of_y]
            row = np.zeros(len(y) + 1, dtype=np.int32)
            best = np.maximum(below[:-1], np.where(w > 0, below[1:] + w, 0))
            row[:-1] = np.maximum.accumulate(best[::-1])[::-1]
            return row

        step = max(1, int(len(x) ** 0.5))
        row, kept = np.zeros(len(y) + 1, dtype=np.int32), {}
        for p in range(len(x), 0, -1):
            if p % step == 0 or p == len(x):
                kept[p] = row
            row = above(row, p - 1)
        total += int(row[0])
        if not trace:
            return total, []
        found, q = [], 0
        for lo in range(0, len(x), step):
            hi = min(lo + step, len(x))
            rows = {hi: kept[hi]}
            for p in range(hi, lo, -1):
                rows[p - 1] = above(rows[p], p - 1)
            p = lo
            while p < hi and q < len(y):
                w = int(table[self.sa[x[p]]][of_y[q]])
                if w and rows[p][q] == rows[p + 1][q + 1] + w:
                    found.append((x[p], y[q]))
                    p, q = p + 1, q + 1
                elif rows[p][q] == rows[p + 1][q]:
                    p += 1
                else:
                    q += 1
        return total, ends + found

    def partners(self) -> tuple[int, ...]:
        out = [-1] * len(self.la)
        todo = [(0, 0)] if self.la[0] == self.lb[0] else []
        while todo:
            i, j = todo.pop()
            out[i] = j
            todo += self.pairs(self.ca[i], self.cb[j])[1]
        return tuple(out)


_aligned: dict[tuple[str, str], tuple[int, ...]] = {}
_aligned_size = 0


def align(a: str, b: str) -> tuple[int, ...]:
    """For each node of skeleton `a` its partner in `b` by simple tree matching, or -1: equal labels match, children match in order with the largest total.

    Results are kept while they and their skeletons take at most CACHE_BYTES.
    """
    global _aligned_size
    found = _aligned.get((a, b))
    if found is None:
        found = _Matcher(a, b).partners()
        _aligned_size += len(a) + len(b) + 8 * len(found)
        if _aligned_size > CACHE_BYTES:
            _aligned.clear()
            _aligned_size = len(a) + len(b) + 8 * len(found)
        _aligned[a, b] = found
    return found


def content_slot(marks: list[str], parent: list[int], mass: list[float], hints: bool) -> int:
    """Node that holds nearly all of `mass`: from the top, go into a child as long as it alone holds HOLDS of what its parent has. Markup has none. With `hints` parts named as junk have none either,
    and articles are looked at first.
    """
    tags = [m.rstrip("!=") for m in marks]
    out = ["=" in m or (hints and "!" in m) for m in marks]
    total = [0.0 if o else m for o, m in zip(out, mass, strict=True)]
    for i in range(len(tags) - 1, 0, -1):
        total[parent[i]] += total[i]
    mains = [i for i in range(len(tags)) if tags[i] == "main" and not out[i] and total[i] > 0] if hints else []
    if mains:
        best = max(mains, key=lambda i: (total[i], -i))
        # several articles beside each other: what holds them all
        if sum(total[i] for i in mains if parent[i] == parent[best]) <= 1.5 * total[best]:
            inner = [i for i in mains if i > best and total[i] >= HOLDS * total[best]]
            return inner[-1] if inner else best
        return parent[best]
    children: list[list[int]] = [[] for _ in tags]
    for i in range(1, len(tags)):
        children[parent[i]].append(i)
    node = 0
    while True:
        deeper = [i for i in children[node] if total[i] >= HOLDS * total[node] > 0 and tags[i] in HOLDERS]
        if not deeper:
            return node
        node = deeper[0]


def induced(marks: list[str], parent: list[int], cells: list[dict], pages: int) -> tuple[int, list[int], list[int]]:
    """Content slot, slots of one text and slots of links, from the counts of a group's nodes (node, met, same, size, links). Names only turn down a slot that the counts lead to."""
    mass, fixed, loose = [0.0] * len(marks), [], []
    for c in cells:
        if "=" in marks[c["node"]] or not c["size"]:
            continue
        if c["same"] >= CONSTANT * pages:
            fixed.append(c["node"])
        elif c["links"] > LINKED * c["size"]:
            loose.append(c["node"])
        else:
            mass[c["node"]] = float(c["size"] - c["links"])
    slot = content_slot(marks, parent, mass, False)
    if "!" in marks[slot]:
        slot = content_slot(marks, parent, mass, True)
    return slot, sorted(fixed), sorted(loose)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


SKELETON = "host string, layout long, key long, skeleton string, texts binary, sizes binary, links binary, marks string"


def skeletons(pages: DataFrame, hints: bool = True) -> DataFrame:
    """(host, layout, key, skeleton, texts, sizes, links, marks) of each page; key: a hash of the whole html; texts, sizes, links: of each node."""

    def work(batches):
        names = [x.split()[0] for x in SKELETON.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if html:
                    p = Page(html, hints)
                    texts, links = p.own_texts()
                    sizes = np.array([len(t) for t in texts], np.int32)
                    rows.append((host, p.layout(), _hash(html), p.skeleton(), np.array([_hash(t) if t else 0 for t in texts], np.int64).tobytes(), sizes.tobytes(), np.minimum(sizes, np.array(links, np.int32)).tobytes(), " ".join(p.marks())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    return over_batches(pages.select("host", "html"), work, SKELETON).dropDuplicates(["host", "key"])


def wrappers(pages: DataFrame, hints: bool = True) -> DataFrame:
    """(host, layout, skeleton, texts, fixed, loose, slot): of each group of LEAST_PAGES pages or more the reference page, its template slots (of one text; of links) and its content slot. `pages`: host, html."""
    trees = durable(skeletons(pages, hints))
    group = ["host", "layout"]
    first = trees.groupBy(*group).agg(F.min("key").alias("key"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    reference = durable(trees.join(first, [*group, "key"]).select(*group, F.col("skeleton").alias("ref_skeleton"), F.col("texts").alias("ref_texts"), F.col("marks").alias("ref_marks"), "pages"))

    def count(batches):
        names = ["host", "layout", "node", "met", "same", "size", "links"]
        for batch in batches:
            cells: dict[tuple[str, int, int], list[int]] = {}
            columns = (batch.column(c).to_pylist() for c in ("host", "layout", "skeleton", "texts", "sizes", "links", "ref_skeleton", "ref_texts"))
            for host, layout, skeleton, texts, sizes, links, ref, ref_texts in zip(*columns, strict=True):
                texts, sizes, links, ref_texts = np.frombuffer(texts, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(links, np.int32), np.frombuffer(ref_texts, np.int64)
                for i, j in enumerate(align(skeleton, ref)):
                    if j >= 0:
                        cell = cells.setdefault((host, layout, j), [0, 0, 0, 0])
                        cell[0] += 1
                        cell[1] += int(texts[i] == ref_texts[j])
                        cell[2] += int(sizes[i])
                        cell[3] += int(links[i])
            rows = [(*k, *c) for k, c in cells.items()]
            types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

    cells = over_batches(trees.select(*group, "skeleton", "texts", "sizes", "links").join(reference.select(*group, "ref_skeleton", "ref_texts"), group), count, "host string, layout long, node int, met long, same long, size long, links long")
    sums = [F.sum(c).alias(c) for c in ("met", "same", "size", "links")]
    cells = cells.groupBy(*group, "node").agg(*sums).groupBy(*group).agg(F.collect_list(F.struct("node", "met", "same", "size", "links")).alias("cells"))  # one for each node of the reference page

    def induce(batches):
        for batch in batches:
            rows = []
            for host, layout, skeleton, texts, marks, pages_, cells_ in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "ref_skeleton", "ref_texts", "ref_marks", "pages", "cells")), strict=True):
                _, children = _children(skeleton)
                parent = [-1] * len(children)
                for i, c in enumerate(children):
                    for j in c:
                        parent[j] = i
                slot, fixed, loose = induced(marks.split(" "), parent, cells_, pages_)
                rows.append((host, layout, skeleton, texts, fixed, loose, slot))
            types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], ["host", "layout", "skeleton", "texts", "fixed", "loose", "slot"])

    return over_batches(reference.join(cells, group), induce, "host string, layout long, skeleton string, texts binary, fixed array<int>, loose array<int>, slot int")


def main_text(page: Page, wrapper: tuple | None) -> str:
    """Text of one page by its group's wrapper (skeleton, texts, fixed, loose, slot); by the page alone without one, or where the wrapper's slot is not in the page or holds nothing."""
    texts, _ = page.own_texts()
    template: set[int] = set()
    if wrapper is not None:
        skeleton, ref_texts, fixed, loose, slot = wrapper
        partner = align(page.skeleton(), skeleton)
        fixed, loose = set(fixed), set(loose)
        ref_texts = np.frombuffer(ref_texts, np.int64)
        template = {i for i, j in enumerate(partner) if j in loose or (j in fixed and texts[i] and _hash(texts[i]) == ref_texts[j])}
        if slot in partner and (found := page.text(partner.index(slot), template)):
            return found
    return page.text(content_slot(page.marks(), page.parent, [float(len(t)) for t in texts], page.hints), template)


def extract(pages: DataFrame, wrapper_bytes: int = WRAPPER_BYTES, hints: bool = True) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    known = durable(wrappers(rows, hints))
    size = known.agg(F.coalesce(F.sum(F.length("skeleton") + F.octet_length("texts") + 4 * F.size("fixed") + 4 * F.size("loose") + 200), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string, n_chars long"
    names = ("skeleton", "texts", "fixed", "loose", "slot")

    def out(batch, texts):
        return pa.RecordBatch.from_arrays([pa.compute.cast(batch.column("page_id"), pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= wrapper_bytes:
        table = {(r["host"], r["layout"]): (r["skeleton"], bytes(r["texts"]), r["fixed"], r["loose"], r["slot"]) for r in known.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(table)

        def work(batches):
            for batch in batches:
                read = ((Page(h, hints), k) for h, k in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True))
                yield out(batch, [main_text(p, shared.value.get((k, p.layout()))) for p, k in read])

        return over_batches(rows, work, schema)

    def joined(batches):
        for batch in batches:
            texts = []
            for html, of in zip(batch.column("html").to_pylist(), batch.column("wrappers").to_pylist(), strict=True):
                p = Page(html, hints)
                layout = p.layout()
                texts.append(main_text(p, next((tuple(w[c] for c in names) for w in of or [] if w["layout"] == layout), None)))
            yield out(batch, texts)

    # a page's layout is known once it is read; layouts of one host are few, as each has LEAST_PAGES pages and together they have a part of WRAPPER_BYTES a host
    by_host = known.groupBy("host").agg(F.collect_list(F.struct("layout", *names)).alias("wrappers"))
    return over_batches(rows.join(by_host, "host", "left"), joined, schema)
