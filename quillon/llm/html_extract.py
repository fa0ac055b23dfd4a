"""Main text of web pages, with site templates found by counting subtrees over a host.

Every element's subtree is hashed by its tags and text. Spark counts, for each host and for
each layout of a host, on how many different pages a subtree occurs; one that surely occurs on
a good half of them is template and is deleted, inside articles too. Pages are told apart by
their main text, so copies count once; and a subtree must occur on pages of unlike main texts,
told by their longest block, so near copies don't make their common paragraphs look like
template. Rules add what a page's own names say is a menu, header, footer, sidebar, notice,
advert, form or comment, however small its host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.session import store

#: A subtree is template if it's on at least so many different pages, outside and inside articles,
MIN_PAGES, INNER_PAGES = 4, 6
#: its share of the host's (or layout's) different pages, less two standard errors, is at least this,
SURE_SHARE = 0.4
#: and its pages have at least so many unlike main texts for each page.
UNLIKE = 0.5
#: A page keeps template of which its main text would lose more than this share: it is a copy, inside articles, or nothing else.
MOST, ALMOST_ALL = 0.5, 0.9
#: Articles with a smaller share of the page's text, or of its main element's, aren't its main text.
PART = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROP = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe object svg canvas dialog menu audio video label fieldset title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag closes when they are open, up to the given limits.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
PARAGRAPH = (frozenset(("p",)), frozenset("article section div td th li main body table button".split()))
#: Elements that one of these rules looks for.
MATTERS = frozenset().union(*PARAGRAPH, *[x for rule in CLOSES.values() for x in rule])
#: Last words of a class, id or role that name what isn't the main text; headers count outside articles only.
HEADERS = frozenset("header masthead banner".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsored nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo sidebar complementary notice cookie cookies consent comment comments disqus share".split())
#: Words that change nothing beside one of these.
NEUTRAL = frozenset("site page main top bottom left right box block bar wrap wrapper container area slot list section widget panel form thread inner".split())
#: Elements that make up a layout.
FRAME = frozenset("body div section main article header footer nav aside form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")


def _named(value: str, inside: bool) -> bool:
    """Whether a class, id or role names something unwanted."""
    for name in value.split():
        words = _WORD.findall(name)
        marks = MARKS if inside else MARKS | HEADERS
        if words and (words[-1] in marks or not marks.isdisjoint(words) and marks.union(NEUTRAL).issuperset(words)):
            return True
    return False


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    """inside: within an article, whose own header holds its headline."""
    if tag in DROP:
        return not (inside and tag == "header")
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role") and _named(value, inside):
            return True
    return False


class Page:
    """Elements in page order and the text between tags.

    nodes: [tag, parent, first piece, end piece, unwanted, hash]; pieces: text, or None at a
    border between blocks; frame: the path of each element that makes up the layout.
    """

    def __init__(self, source: str):
        self.nodes: list[list] = []
        self.pieces: list[str | None] = []
        self.frame: list[str] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        nodes, pieces, stack, sums = self.nodes, self.pieces, [], []
        open_tags, self.deep = Counter(), []  # deep: depths of the open elements that an opening tag may close or stop at

        def close() -> None:
            n = nodes[stack.pop()]
            open_tags[n[0]] -= 1
            if self.deep and self.deep[-1] == len(stack):
                self.deep.pop()
            n[3] = len(pieces)
            n[5] = int.from_bytes(blake2b(n[0].encode() + b"(" + b"|".join(sums.pop()) + b")", digest_size=8).digest(), "big", signed=True)
            if sums:
                sums[-1].append(n[5].to_bytes(8, "big", signed=True))
            if n[0] in BLOCK:
                pieces.append(None)

        def text(t: str) -> None:
            if t:
                t = html.unescape(t) if "&" in t else t
                pieces.append(t)
                if sums and (t := " ".join(t.split())):
                    sums[-1].append(t.encode("utf-8", "replace"))

        at = 0
        while (m := _TOKEN.search(s, at)) is not None:
            text(s[at : m.start()])
            at = m.end()
            closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the second form has an open quote
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:-3])
                continue
            tag = tag.lower()
            if closing:
                if open_tags[tag]:
                    while nodes[stack[-1]][0] != tag:
                        close()
                    close()
                continue
            if tag in BLOCK:
                self._implied(tag, stack, close, open_tags)
                pieces.append(None)
            if tag == "br":
                pieces.append(" ")
            if tag in VOID:
                continue
            nodes.append([tag, stack[-1] if stack else -1, len(pieces), -1, _unwanted(tag, attrs, open_tags["article"] > 0), 0])
            if tag in FRAME and not open_tags["article"] and len(self.deep) <= 5:
                self._framed(tag, attrs)
            if tag in MATTERS:
                self.deep.append(len(stack))
            stack.append(len(nodes) - 1)
            open_tags[tag] += 1
            sums.append([])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(s, at)
                body = s[at : end.start() if end else len(s)]
                sums[-1].append(body.encode("utf-8", "replace"))
                at = end.start() if end else len(s)
            elif attrs.endswith("/") and tag in ("path", "rect", "circle", "use", "g", "line"):
                close()
        text(s[at:])
        while stack:
            close()

    def _framed(self, tag: str, attrs: str) -> None:
        names = sorted(w for x in _ATTR.finditer(attrs) if x[1].lower() in ("class", "id") for w in _WORD.findall((x[2] or x[3] or x[4] or "").lower()))
        step = f"{len(self.deep)}{tag}.{'.'.join(names)}"
        if not self.frame or self.frame[-1] != step:  # however many such elements follow one another
            self.frame.append(step)

    def _implied(self, tag: str, stack: list[int], close, open_tags: Counter) -> None:
        """Closes an open paragraph before a block, and list items, cells and rows before the next."""
        for want, stop in (CLOSES.get(tag, PARAGRAPH), PARAGRAPH):
            if not any(open_tags[w] for w in want):
                continue
            for depth in reversed(self.deep):
                name = self.nodes[stack[depth]][0]
                if name in want:
                    while len(stack) > depth:
                        close()
                    break
                if name in stop:
                    break

    def main(self) -> list[int]:
        """The elements of the main text in page order: all articles, else main; none for the whole page.

        Elements that hold less than PART of the text around them give way to what is around.
        """
        gone, found, wanted = [False] * len(self.nodes), {"article": [], "main": []}, bytearray(b"\1" * len(self.pieces))
        last = {"article": 0, "main": 0}  # where the element found last ends: those within it belong to it
        for i, (tag, parent, a, b, bad, _) in enumerate(self.nodes):
            gone[i] = bad or parent >= 0 and gone[parent]
            if bad:
                wanted[a:b] = bytes(b - a)
            if tag in found and not gone[i] and a >= last[tag]:
                found[tag].append(i)
                last[tag] = b
        sizes = [len("".join(p.split())) if p and k else 0 for p, k in zip(self.pieces, wanted)]
        roots, size = [], sum(sizes)
        for tag in ("main", "article"):
            n = sum(sum(sizes[self.nodes[i][2] : self.nodes[i][3]]) for i in found[tag])
            if found[tag] and n >= PART * size:
                roots, size = found[tag], n
        return roots

    def inside(self, roots: list[int]) -> list[bool]:
        out, top = [False] * len(self.nodes), set(roots)
        for i, n in enumerate(self.nodes):
            out[i] = i in top or n[1] >= 0 and out[n[1]]
        return out

    def text(self, outer: frozenset = frozenset(), inner: frozenset = frozenset()) -> str:
        """Main text without unwanted elements and the template subtrees of these hashes."""
        roots = self.main()
        within, around = self.inside(roots), self._around(roots)
        keep = bytearray(len(self.pieces) if roots else b"\1" * len(self.pieces))
        for i in roots:
            a, b = self.nodes[i][2:4]
            keep[a:b] = b"\1" * (b - a)
        for _, _, a, b, bad, _ in self.nodes:
            if bad:
                keep[a:b] = bytes(b - a)
        for known, place, most in ((inner, True, MOST), (outer, False, ALMOST_ALL)):
            fewer = keep[:]
            for i, (tag, _, a, b, _, h) in enumerate(self.nodes):
                if h in known and (within[i] and i not in roots) == place and tag not in ("html", "body") and i not in around:
                    fewer[a:b] = bytes(b - a)
            if fewer != keep and self._size(fewer) >= (1 - most) * self._size(keep):
                keep = fewer
        return "\n".join(self.blocks(keep))

    def _size(self, keep: bytearray) -> int:
        return sum(len("".join(p.split())) for p, k in zip(self.pieces, keep) if p and k)

    def _around(self, roots: list[int]) -> set[int]:
        """Elements that hold one of the main text, and its only element itself; they are never template."""
        out = set()
        for i in roots:
            i = i if len(roots) == 1 else self.nodes[i][1]
            while i >= 0 and i not in out:
                out.add(i)
                i = self.nodes[i][1]
        return out

    def subtrees(self) -> set[tuple[int, bool]]:
        """(hash, inside an element of the main text) of subtrees that can be template."""
        roots = self.main()
        within, only = self.inside(roots), roots[0] if len(roots) == 1 else -1
        return {(n[5], within[i] and i not in roots) for i, n in enumerate(self.nodes) if i != only and n[0] not in ("html", "body", "head") and not n[4] and any(p and not p.isspace() for p in self.pieces[n[2] : n[3]])}


    def blocks(self, keep: bytearray) -> list[str]:
        """Texts of the blocks of the kept pieces, white space as single spaces."""
        out, now = [], []
        for p, k in zip(self.pieces, keep):
            if p is None:
                if now:
                    out.append("".join(now))
                    now = []
            elif k:
                now.append(p)
        out.append("".join(now))
        return [x for b in out if (x := " ".join(b.split()))]


def _digest(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


SEEN = "host string, layout long, hash long, inner boolean, page long, kind long"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page (hash 0) and for each of its subtrees; kind tells unlike main texts apart."""
    for b in batches:
        hosts, layouts, hashes, inner, pages, kinds = [], [], [], [], [], []
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = Page(source or "")
            text = page.text()
            own, kind, layout = _digest(text), _digest(max(text.split("\n"), key=len)), _digest("|".join(page.frame))
            for h, x in [(0, False), *page.subtrees()]:
                hosts.append(host)
                layouts.append(layout)
                hashes.append(h)
                inner.append(x)
                pages.append(own)
                kinds.append(kind)
        longs = [pa.array(x, pa.int64()) for x in (layouts, hashes, pages, kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), longs[0], longs[1], pa.array(inner, pa.bool_()), longs[2], longs[3]], ["host", "layout", "hash", "inner", "page", "kind"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for source, known in zip(b.column("html").to_pylist(), b.column("known").to_pylist()):
            page = Page(source or "")
            own = _digest("|".join(page.frame)) if known else 0
            gone = [(x["hash"], x["inner"]) for x in known or () if x["layout"] is None or x["layout"] == own]
            out.append(page.text(frozenset(h for h, inner in gone if not inner), frozenset(h for h, inner in gone if inner)))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """Host in lower case without port and user; the empty string without one."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, layout, hash, inner, n, total, kinds): subtrees that are template, layout null for the whole host.

    A page is its main text in its layout. Occurrences are stored once, narrow; only subtrees
    that are frequent enough are looked up in them again for their number of unlike texts.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    seen = store(rows.mapInArrow(_hashes, SEEN).distinct()).df
    by_layout = store(seen.groupBy("host", "layout", "hash", "inner").agg(F.count("*").alias("n"))).df
    by_host = by_layout.groupBy("host", F.lit(None).cast("long").alias("layout"), "hash", "inner").agg(F.sum("n").alias("n"))
    counts = by_layout.unionByName(by_host)
    total = counts.where("hash = 0 and not inner").select(F.col("host").alias("_h"), F.col("layout").alias("_l"), F.col("n").alias("total"))
    often = counts.where(f"hash <> 0 and n >= if(inner, {INNER_PAGES}, {MIN_PAGES})")
    often = often.join(total, (F.col("host") == F.col("_h")) & F.col("layout").eqNullSafe(F.col("_l"))).drop("_h", "_l")
    often = store(often.where(f"n / total - 2 * sqrt(n / total * (1 - n / total) / total) >= {SURE_SHARE}")).df
    key = ["host", "hash", "inner"]
    found = seen.join(often.select(*key).distinct(), key, "left_semi").select(*key, "layout", "kind").distinct()
    kinds = found.groupBy(*key, "layout").agg(F.count("*").alias("kinds"))
    kinds = kinds.unionByName(kinds.groupBy(*key, F.lit(None).cast("long").alias("layout")).agg(F.sum("kinds").alias("kinds")))
    kinds = kinds.select(*[F.col(c).alias(f"_{c}") for c in (*key, "layout")], "kinds")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "layout")]
    return often.join(kinds, same).where(f"kinds >= {UNLIKE} * n").select(*key, "layout", "n", "total", "kinds")


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages(page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by a newline. Null and empty pages give an empty text; pages with a null or
    hostless url share the empty host. Repeated pages count once for the templates and each
    get a row. All articles of a page are its main text, unless they hold only a small part of
    it. Without an article or main element, all of the body but unwanted and template parts is
    the main text. Very long pages are read whole, in time near linear in their length. Other
    columns are neither read nor returned.
    """
    known = templates(pages).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("hash", "inner", "layout"))).alias("known"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(store(known).df, "host", "left")
    out = rows.select("page_id", "url", "html", "known").mapInArrow(_texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
