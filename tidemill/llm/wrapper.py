"""Content of web pages by wrapper induction: DOM trees of a host's pages are aligned by simple tree matching.

Pages of a host with the same language (of the html element) and the same tag paths down to `LEVELS` are of one layout.  One page of each layout,
the reference (the one with the least id among those of median node number, or nearest above), stands for it, and every page is aligned with that by
simple tree matching: the largest set of node pairs that keeps parents, order and labels (tag and class).  A text's slots are its partner in
the reference, for the layout, and its path of labels, which needs no partner, for all pages of the host and for those of its language.
For each slot it is counted how many pages have it, and how many have each text there.  A text is template if, for one of these groups of pages, its slot
is in at least `support` of them, and the text in at least `constant` of those; in a language or a layout, also in `least_pages`.  All other
texts are content.  script, style, and other elements without visible text never are.  A host of fewer than `least_pages`
pages shows no variation, so everything visible is content.

References, and the texts found constant, go to every task if they have at most SMALL_BYTES, and pages stay where they are (they are parsed twice, once to
choose references); else both travel by joins on host and layout.  Texts are counted in two steps, first in BUCKETS for each slot, then one by one
in the buckets that can hold a constant text, so what travels is of the size of the template, and no task ever holds all pages of a host.
Very long pages are read whole; the matching takes time in the product of the numbers of those siblings that aren't equal at the beginning or end of their lists.

Cases: a null or empty page, or one without visible text, has empty content; a page without a host (null or odd url) forms a host ""; malformed HTML
is read as browsers do in the main: unclosed elements close with their parents; null page ids are kept; repeated rows are each
extracted, and count as pages; extra columns are ignored; an empty table gives no rows; trees deeper than `DEPTH` continue flat.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ident, lean, written

SUPPORT, CONSTANT, LEAST_PAGES, DEPTH = 0.5, 0.5, 3, 200
LEVELS = 4  #: root, html, body and its blocks
SMALL = 64  #: nodes of a subtree whose score is kept for other pages
BUCKETS = 64  #: of texts of a slot, counted together first
SMALL_BYTES = 16 << 20  #: what is broadcast has at most so many bytes
_KIND = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript iframe svg head".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_LIST_STOP, _BLOCK_STOP, _P = frozenset(("ul", "ol", "table", "dl", "div", "article", "section")), frozenset(("table", "li", "td", "div", "article", "section")), {"p"}
_SEPARATOR = re.compile(r"[|\u00b7\u2022\u00bb\u203a](?<=\s.)(?=\s)")
_PLAIN_TAG = re.compile(r"""<[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][A-Za-z-]*="[^"<>]*")*\s*>""")  #: where such a tag ends does not depend on what follows
_PLAIN_END = re.compile(r"</[A-Za-z][A-Za-z0-9]*>")
TAG_CHARS, TAGS = 256, 1 << 14  #: length and number of the plain tags that a process remembers
_tags: dict[str, tuple[str, str, str]] = {}
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Tree(HTMLParser):
    """Nodes in document order: label, parent, text. Text runs are nodes with the label '#'."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.label, self.parent, self.text, self.path, self.tags = ["#root"], [-1], [""], [0], ["#root"]
        self.lang = ""

    def _add(self, label: str, text: str = "") -> int:
        self.label.append(label), self.parent.append(self.path[-1]), self.text.append(text)
        return len(self.label) - 1

    def _pop(self, tags: set[str], stop: frozenset[str]) -> None:
        open_ = self.tags
        for k in range(len(open_) - 1, 0, -1):
            tag = open_[k]
            if tag in tags:
                del self.path[k:], open_[k:]
                return
            if tag in stop:
                return

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are of no use here

    def parse_starttag(self, i: int) -> int:
        raw = self.rawdata
        j = raw.find(">", i, i + TAG_CHARS) + 1
        if not j:
            return super().parse_starttag(i)
        own = raw[i:j]
        known = _tags.get(own)
        if known is None:
            end = super().parse_starttag(i)
            if end == j and _PLAIN_TAG.fullmatch(own):
                if len(_tags) >= TAGS:
                    _tags.clear()
                _tags[own] = self.last
            return end
        self._open(*known)
        if known[0] in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(known[0])
        return j

    def parse_endtag(self, i: int) -> int:
        if self.cdata_elem is None:
            m = _PLAIN_END.match(self.rawdata, i)
            if m:
                self.handle_endtag(self.rawdata[i + 2:m.end() - 1].lower())
                return m.end()
        return super().parse_endtag(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        kind = next((v for k, v in attrs if k == "class" and v), "") if attrs else ""
        lang = next((v.lower() for k, v in attrs if k == "lang" and v), "") if tag == "html" else ""
        self.last = tag, f"{tag}.{kind}" if kind else tag, lang
        self._open(*self.last)

    def _open(self, tag: str, label: str, lang: str) -> None:
        if tag in _CLOSES:
            self._pop(_CLOSES[tag], _LIST_STOP)
        elif tag in _BLOCK:
            self._pop(_P, _BLOCK_STOP)
        if lang and not self.lang:
            self.lang = lang
        node = self._add(label)
        if tag not in _VOID and len(self.path) < DEPTH:
            self.path.append(node), self.tags.append(tag)

    def handle_endtag(self, tag: str) -> None:
        open_ = self.tags
        for k in range(len(open_) - 1, 0, -1):
            if open_[k] == tag:
                del self.path[k:], open_[k:]
                return

    def handle_data(self, data: str) -> None:
        for part in _SEPARATOR.split(data):  # "(c) host | words": each segment is a text of its own
            part = " ".join(part.split())
            if part:
                self._add("#", part)


Tree = tuple[list[str], list[int], list[str]]


def _read(html: str | None) -> _Tree:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t


def parse(html: str | None) -> Tree:
    """(labels, parents, texts) of a page's nodes in document order."""
    t = _read(html)
    return t.label, t.parent, t.text


@lru_cache(1 << 16)
def _hash(text: str, above: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d/" % above + text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def paths(tree: Tree) -> list[int]:
    """The hash of each node's labels from the root."""
    out: list[int] = []
    for label, parent in zip(tree[0], tree[1]):
        out.append(_hash(label, out[parent] if parent >= 0 else 0))
    return out


def layout(tree: Tree, lang: str) -> int:
    """The hash of a page's language and of the set of its elements' paths down to LEVELS."""
    label, parent, _ = tree
    top: dict[int, tuple[int, int]] = {0: (1, _hash(label[0]))}  # depth and path of the nodes down there
    own = {top[0][1]} if label[0] != "#" else set()
    for i in range(1, len(label)):
        above = top.get(parent[i])
        if above is not None and above[0] < LEVELS and label[i] != "#":
            path = _hash(label[i], above[1])
            own.add(path)
            top[i] = above[0] + 1, path
    return _hash(f"{lang} {sorted(own)}")


def visible(tree: Tree) -> list[bool]:
    """Which nodes are texts that a reader sees."""
    label, parent, _ = tree
    hidden = [False] * len(label)
    for i in range(1, len(label)):
        hidden[i] = hidden[parent[i]] or label[i].split(".", 1)[0] in _HIDDEN
    return [x == "#" and not h for x, h in zip(label, hidden)]


def _children(parent: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parent]
    for i in range(1, len(parent)):
        out[parent[i]].append(i)
    return out


def subtrees(tree: Tree) -> tuple[list[list[int]], list[int], list[int], list[int], list[set | None]]:
    """(children, hash, size, hash of the labels alone, texts unless it has over SMALL nodes) of each node's subtree; for comparison inside a process."""
    label, _, text = tree
    children, n = _children(tree[1]), len(label)
    size, same, shape = [1] * n, [0] * n, [0] * n
    texts: list[set | None] = [None] * n
    for i in range(n - 1, -1, -1):
        own = children[i]
        if own:
            same[i], shape[i] = hash((label[i], text[i], *[same[k] for k in own])), hash((label[i], *[shape[k] for k in own]))
            for k in own:
                size[i] += size[k]
            if size[i] <= SMALL:
                texts[i] = set().union(*[texts[k] for k in own])
        else:
            same[i], shape[i], texts[i] = hash((label[i], text[i])), hash(label[i]), {text[i]} if text[i] else set()
    return children, same, size, shape, texts


#: score of pairs of small shapes without a common text
_shapes: dict[tuple[int, int], int] = {}


def align(a: Tree, b: Tree, above: tuple | None = None) -> list[tuple[int, int]]:
    """The node pairs of a largest simple tree matching of a and b; of equal ones one with most equal texts.  above: subtrees(a).

    Children whose subtrees are equal, at the beginning or the end of both lists, are matched at once: no other matching of them can be larger.
    """
    ca, sa, na, ha, xa = above or subtrees(a)
    cb, sb, _, hb, xb = subtrees(b)
    la, lb, ta, tb = a[0], b[0], a[2], b[2]
    memo: dict[tuple[int, int], tuple] = {}
    one = 1 << 32  # a score is an integer: pairs in the high bits, equal texts in the low ones
    both = one + 1

    def score(x: int, y: int) -> int:
        """The best matching of the subtrees of x and y, whose labels are equal."""
        if sa[x] == sb[y]:
            return na[x] * both
        xs, ys = ca[x], cb[y]
        own = one + (ta[x] == tb[y])
        if not xs or not ys:
            return own
        if xa[x] is not None and xb[y] is not None and xa[x].isdisjoint(xb[y]):  # then the shapes alone count
            got = _shapes.get((ha[x], hb[y]))
            if got is None:
                if len(_shapes) > 1 << 16:
                    _shapes.clear()
                got = _shapes[ha[x], hb[y]] = full(x, y)
            return got
        return full(x, y)

    def full(x: int, y: int) -> int:
        """score, of nodes with children whose subtrees differ; keeps its table for the way back."""
        got = memo.get((x, y))
        if got is not None:
            return got[0]
        xs, ys = ca[x], cb[y]
        own = one + (ta[x] == tb[y])
        head, p, q = 0, len(xs), len(ys)
        while head < p and head < q and sa[xs[head]] == sb[ys[head]]:
            head += 1
        while p > head and q > head and sa[xs[p - 1]] == sb[ys[q - 1]]:
            p, q = p - 1, q - 1
        best = own + sum(na[i] for i in xs[:head]) * both + sum(na[i] for i in xs[p:]) * both
        above = [0] * (q - head + 1)
        rows = [above]
        kinds = [lb[k] for k in ys[head:q]]
        for i in xs[head:p]:
            label, left = la[i], 0
            row = [0]
            for j, kind in enumerate(kinds):
                top = above[j + 1]
                if left > top:
                    top = left
                if kind == label:
                    s = above[j] + score(i, ys[head + j])
                    if s > top:
                        top = s
                row.append(top)
                left = top
            rows.append(row)
            above = row
        best += above[-1]
        memo[x, y] = (best, rows, head, p, q)
        return best

    score(0, 0)
    pairs, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        if sa[x] == sb[y]:
            pairs += [(x + d, y + d) for d in range(na[x])]  # a subtree is a run in document order
            continue
        pairs.append((x, y))
        if not ca[x] or not cb[y]:
            continue
        full(x, y)
        _, rows, head, p, q = memo[x, y]
        xs, ys = ca[x], cb[y]
        todo += zip(xs[:head], ys[:head])
        todo += zip(xs[p:], ys[q:])
        i, j = p - head, q - head
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[head + i], ys[head + j]))
    return pairs


def _host() -> "F.Column":
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _page(html: str | None) -> tuple[Tree, int, int]:
    """(tree, with the texts that a reader sees alone, language, layout) of a page."""
    t = _read(html)
    tree = t.label, t.parent, t.text
    return (t.label, t.parent, [x if v else "" for x, v in zip(t.text, visible(tree))]), _hash(t.lang), layout(tree, t.lang)


def _matched(page: Tree, ref: tuple[Tree, tuple]) -> tuple[list[str], list[int], list[int]]:
    """(texts, slots, places): the texts that a reader sees, the partner of each in the reference or -1, and the hash of its path."""
    partner = {y: x for x, y in align(ref[0], page, ref[1])}
    path = paths(page)
    seen = [i for i, x in enumerate(page[2]) if x]
    return [page[2][i] for i in seen], [partner.get(i, -1) for i in seen], [path[i] for i in seen]


def _small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether a written table has at most `limit` bytes."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= limit


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT, constant: float = CONSTANT, least_pages: int = LEAST_PAGES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(page_id, host, n_texts, n_template, content): visible texts of each page, how many are template, and the others, a line each."""
    raw = pages.select(ident(id_col).cast("long").alias("id"), ident(url_col).cast("string").alias("url"), ident(html_col).cast("string").alias("html"))
    raw = raw.select("id", _host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    spark = pages.sparkSession

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(_read_size(html)) for html in b.column(2).to_pylist()]
            lang, layout_, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.int64()), pa.array(layout_, pa.int64()), pa.array(n, pa.int32()), b.column(3)], ["id", "host", "lang", "layout", "n", "h"])

    sized = written(raw.withColumn("h", F.xxhash64("html")).mapInArrow(lean(sizes), "id long, host string, lang long, layout long, n int, h long"))
    middle = sized.groupBy("host", "lang", "layout").agg(F.percentile("n", F.lit(0.5)).alias("m"), F.count("*").alias("pages"))
    middle = written(middle)
    chosen = sized.join(middle, ["host", "lang", "layout"]).where("n >= m").groupBy("host", "lang", "layout").agg(F.min_by(F.struct("id", "h"), F.struct("n", F.col("id").isNull(), "id", "h")).alias("r"))
    chosen = written(chosen.select("host", "layout", F.col("r.id").alias("rid"), F.col("r.h").alias("h")))

    # the reference pages' own trees: one page may be there several times
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([json.dumps(_page(x)[0]) for x in b.column(len(b.columns) - 1).to_pylist()], pa.string())], [*b.schema.names[:-1], "tree"])

    few = _small(chosen, small_bytes)
    found = raw.withColumn("h", F.xxhash64("html")).join(F.broadcast(chosen) if few else chosen, ["host", "h"]).where("id <=> rid").select("host", "layout", "html")
    reference = written(found.dropDuplicates(["host", "layout"]).mapInArrow(lean(trees), "host string, layout long, tree string"))

    kind = "id long, host string, lang long, layout long, texts array<string>, slots array<int>, places array<long>"

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, _KIND)], [f.split()[0] for f in kind.split(", ")])

    if few and _small(reference, small_bytes):
        # references of a checked size go to every task, and pages stay where they are
        shared = spark.sparkContext.broadcast({(r.host, r.layout): r.tree for r in reference.toLocalIterator()})

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = lru_cache(256)(lambda key: _ready(shared.value[key]))
            for b in batches:
                rows = []
                for i, host, html in zip(*(b.column(c).to_pylist() for c in range(3))):
                    page, lang, layout_ = _page(html)
                    rows.append((i, host, lang, layout_, *_matched(page, ready((host, layout_)))))
                yield table(rows)

        matched = written(raw.mapInArrow(lean(match), kind))
    else:

        def parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [_page(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2)), pa.array([json.dumps(g[0]) for g in got], pa.string())], ["id", "host", "lang", "layout", "tree"])

        def align_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = lru_cache(16)(_ready)
            for b in batches:
                rows = [(i, host, lang, layout_, *_matched(json.loads(tree), ready(ref))) for i, host, lang, layout_, tree, ref in zip(*(b.column(c).to_pylist() for c in range(6)))]
                yield table(rows)

        parsed = raw.mapInArrow(lean(parse_all), "id long, host string, lang long, layout long, tree string")
        both = parsed.join(reference.withColumnRenamed("tree", "ref"), ["host", "layout"]).select("id", "host", "lang", "layout", "tree", "ref")
        matched = written(both.mapInArrow(lean(align_all), kind))

    # a layout's page has a slot once; a path may be there with several texts
    text = F.transform("texts", lambda x: F.xxhash64(x))
    at_slot = F.transform(F.filter(F.arrays_zip(F.col("slots").alias("s"), text.alias("t")), lambda x: x["s"] >= 0), lambda x: F.struct(F.lit(True).alias("own"), x["s"].cast("long").alias("slot"), x["t"].alias("text")))
    at_path = F.transform(F.array_distinct(F.arrays_zip(F.col("places").alias("s"), text.alias("t"))), lambda x: F.struct(F.lit(False).alias("own"), x["s"].alias("slot"), x["t"].alias("text")))
    any_path = F.transform(F.array_distinct("places"), lambda x: F.struct(F.lit(False).alias("own"), x.alias("slot"), F.lit(None).cast("long").alias("text")))

    def items(*lists: Column) -> DataFrame:
        rows = matched.select("host", "lang", "layout", F.explode(F.concat(*lists)).alias("x"))
        return rows.select("x.own", "host", "lang", F.when(F.col("x.own"), F.col("layout")).otherwise(F.lit(0)).alias("layout"), "x.slot", "x.text", F.pmod("x.text", F.lit(BUCKETS)).cast("int").alias("bucket"))

    # Most texts of content are there once.  A text can only be constant in a slot if its bucket is: the others aren't counted one by one.
    fine = ["own", "host", "lang", "layout", "slot"]
    cells = written(items(at_slot, at_path, any_path).groupBy(*fine, "bucket").agg(F.count("*").alias("n")))
    scopes = [(True, ["host", "lang", "layout"], least_pages), (False, ["host", "lang"], least_pages), (False, ["host"], 1)]

    def slots_of(own: bool, key: list[str]) -> DataFrame:
        """(key, slot, in): the slots that enough pages of a key have, and how many have them."""
        total = middle.groupBy(key).agg(F.sum("pages").alias("pages")).where(F.col("pages") >= least_pages)
        c = cells.where(F.col("own") if own else ~F.col("own") & F.col("bucket").isNull())
        return c.groupBy(*key, "slot").agg(F.sum("n").alias("in")).join(total, key).where(F.col("in") >= support * F.col("pages")).select(*key, "slot", "in")

    kept = None
    for own, key, least in scopes:
        c = cells.where((F.col("own") == own) & F.col("bucket").isNotNull())
        good = c.groupBy(*key, "slot", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least).join(slots_of(own, key), [*key, "slot"]).where(F.col("n") >= constant * F.col("in"))
        one = c.join(good.select(*key, "slot", "bucket"), [*key, "slot", "bucket"], "left_semi").select(*fine, "bucket")
        kept = one if kept is None else kept.union(one)
    kept = written(kept.distinct())
    counts = items(at_slot, at_path).join(F.broadcast(kept) if _small(kept, small_bytes) else kept, [*fine, "bucket"], "left_semi").groupBy(*fine, "text").agg(F.count("*").alias("n"))
    counts = written(counts)

    template = reference.select("host", "layout").join(middle.select("host", "lang", "layout"), ["host", "layout"])
    names = []
    for own, key, least in scopes:
        good = counts.where(F.col("own") == own).groupBy(*key, "slot", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= least).join(slots_of(own, key), [*key, "slot"]).where(F.col("n") >= constant * F.col("in"))
        names.append("fixed_" + key[-1])
        template = template.join(good.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "text")))).alias(names[-1])), key, "left")
    # written, so that the join below is of two plain tables, and a host with many pages can be split
    template = written(template.select("host", "layout", *(F.coalesce(n, F.lit("[]")).alias(n) for n in names)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lru_cache(512)(lambda x: {(s, t) for s, t in json.loads(x)})
        for b in batches:
            total, constant_, content = [], [], []
            for texts, hashes, slots, places, in_layout, in_lang, in_host in zip(*(b.column(c).to_pylist() for c in range(2, 9))):
                in_layout, in_lang, in_host = pairs(in_layout), pairs(in_lang), pairs(in_host)
                own = [x for x, t, s, p in zip(texts, hashes, slots, places) if (s, t) not in in_layout and (p, t) not in in_lang and (p, t) not in in_host]
                total.append(len(texts)), constant_.append(len(texts) - len(own)), content.append("\n".join(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int32()), pa.array(constant_, pa.int32()), pa.array(content, pa.string())], ["page_id", "host", "n_texts", "n_template", "content"])

    joined = matched.join(F.broadcast(template) if _small(template, small_bytes) else template, ["host", "layout"]).select("id", "host", "texts", text.alias("hashes"), "slots", "places", *names)
    return joined.mapInArrow(lean(split), "page_id long, host string, n_texts int, n_template int, content string")


def _ready(tree: str) -> tuple[Tree, tuple]:
    own = json.loads(tree)
    return own, subtrees(own)


def _read_size(html: str | None) -> tuple[int, int, int]:
    """(language, layout, number of nodes) of a page."""
    t = _read(html)
    return _hash(t.lang), layout((t.label, t.parent, t.text), t.lang), len(t.label)
