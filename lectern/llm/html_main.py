"""Main text of web pages, with site templates removed.

Every element's subtree is hashed, in two ways. The exact digest covers tags, attributes and text; the digest of its form covers where it
stands, tags and words of class and id, but neither text nor addresses nor how often equal children repeat, so a menu matches
itself with another link active. Spark counts, for each host, on how many pages of different content a
digest occurs. Containers whose exact digest recurs are the site's template wherever they stand; those whose form recurs are template
outside the content only, since articles share their form. A page's content is its article or main element, or else the
smallest container that holds most of its text. A digest recurs if a lower confidence bound of its share of the host's pages
passes ``SHARE``; copies of one article count once.

What is left loses the elements that HTML itself sets apart from an article (nav, footer, form, script and the like). Classes,
ids and roles that are such a word as a whole mark menus and notices on hosts too small to show a template. No name drops an element
that holds the article, or most of the text of a page without one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, salted_join, sliced, written
from lectern.llm.url_filter import host_and_path

#: Share of a host's pages of different content on which a template recurs: its lower bound at ``SURE`` standard errors is at least this.
SHARE, SURE = 0.2, 3.0
#: Templates up to which their digests are broadcast (8 bytes each); beyond it, pages are joined with theirs.
BROADCAST = 1_000_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template nav footer aside form button select input object canvas svg menu dialog".split())
#: Elements that may be template inside an article, and elsewhere; custom elements, too, where they hold blocks.
CONTAINERS = frozenset("div section aside nav header footer form center details dialog fieldset menu hgroup search".split())
OUTSIDE = CONTAINERS | frozenset("ul ol dl table figure address button select object canvas svg".split())
MAIN = frozenset("article main".split())
#: A start tag closes the open elements named, as far as the nearest of the scope.
CLOSES = {**dict.fromkeys("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), frozenset({"p"})), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
SCOPE = {"li": frozenset({"ul", "ol", "menu"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}), "th": frozenset({"tr", "table"})}
BOUNDS = frozenset("table td th caption button object article section main div ul ol nav aside header footer form body html".split())
#: Words of class, id and role that mark what is not part of an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist discussion disqus respond share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget toolbar pagination pager skip complementary contentinfo search login".split())
#: Of these, the words that mark an element inside an article, where they are its whole class, id or role.
STRONG = MARKS - frozenset("alert notice notices search share social related widget recommended promo promotion banner discussion login skip".split())
#: Words that may stand beside a mark in one class: where it is, not what else it is.
PLACES = frozenset("site page main global top bottom left right primary secondary header box bar block section area inner list item the js c l u block module region slot unit zone panel link links button nav".split())
#: Elements that some sites put around everything.
WRAPPERS = frozenset("form header".split())
_WORDS = re.compile(r"[a-z]+")


@lru_cache(maxsize=10_000)
def _marks(name: str) -> bool:
    """Whether a class, id or role is a mark as a whole: words of ``MARKS``, and of ``PLACES`` beside them. ``no-sidebar`` and ``page-with-comments`` are none."""
    words = _WORDS.findall(name)
    return any(w in MARKS for w in words) and all(w in MARKS or w in PLACES for w in words)


class Page:
    """The elements of one page in page order: tags, attributes, parents, and children (texts and element numbers)."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents, self.children = ["#page"], [""], [-1], [[]]
        # No tag ends behind the last ``>``, so none is sought there; names of open elements are counted, so none is sought in vain.
        stack, at, end, last = [0], 0, len(source), source.rfind(">") + 1
        self.open: Counter[str] = Counter()
        while at < end:
            found = TOKEN.search(source, at, last) if at < last else None
            if not found:
                tail = source.find("<!--", at)
                self._text(stack[-1], source[at:] if tail < 0 else source[at:tail])
                break
            if found.start() > at:
                self._text(stack[-1], source[at : found.start()])
            at = found.end()
            if found[0].startswith("<!--") and not (found[0].endswith("-->") and len(found[0]) > 6):
                break
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close(stack, tag)
                continue
            self._make_room(stack, tag)
            number = len(self.tags)
            self.tags.append(tag)
            self.attributes.append(attributes or "")
            self.parents.append(stack[-1])
            self.children.append([])
            self.children[stack[-1]].append(number)
            if tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                if tag == "title":
                    self.children[number].append(html.unescape(source[at : stop.start() if stop else end]))
                at = end if not stop else (source.find(">", stop.end()) + 1 or end)
            elif tag not in VOID:
                stack.append(number)
                self.open[tag] += 1

    def _text(self, parent: int, raw: str) -> None:
        self.children[parent].append(html.unescape(raw) if "&" in raw else raw)

    def _cut(self, stack: list[int], depth: int) -> None:
        self.open.subtract(self.tags[i] for i in stack[depth:])
        del stack[depth:]

    def _close(self, stack: list[int], tag: str) -> None:
        if not self.open[tag]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            if self.tags[stack[depth]] == tag:
                self._cut(stack, depth)
                return
            if tag == "p" and self.tags[stack[depth]] in BOUNDS:
                return

    def _make_room(self, stack: list[int], tag: str) -> None:
        closes = CLOSES.get(tag)
        left = sum(self.open[c] for c in closes or ())
        if not left:
            return
        bounds, cut = SCOPE.get(tag, BOUNDS), None
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[depth]]
            if open_tag in closes:
                cut, left = depth, left - 1
                if not left:
                    break
            elif open_tag in bounds:
                break
        if cut is not None:
            self._cut(stack, cut)

    def hashes(self) -> list[bytes]:
        """A digest of each element: tag, attributes and content. Children come after parents, so one pass backwards serves."""
        out = [b""] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            digest = hashlib.blake2b(f"{self.tags[i]} {self.attributes[i].strip()}".encode("utf-8", "replace"), digest_size=8)
            for child in self.children[i]:
                digest.update(out[child] if isinstance(child, int) else b"\0" + " ".join(child.split()).encode("utf-8", "replace"))
            out[i] = digest.digest()
        return out

    def names(self, i: int) -> list[str]:
        """The values of class, id and role, each cut at white space."""
        return [v for m in ATTRIBUTE.finditer(self.attributes[i]) for v in (m[2] or m[3] or m[4] or "").lower().split()] if self.attributes[i] else []

    def forms(self) -> list[str]:
        """The form of each element: tag, words of class and id, and the forms of its block children, equal neighbours once."""
        out = [""] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            parts = []
            for child in self.children[i]:
                own = out[child] if isinstance(child, int) and (self.tags[child] in BLOCK or "-" in self.tags[child]) else "t" if isinstance(child, int) or not child.isspace() else ""
                if own and own not in parts[-1:]:
                    parts.append(own)
            form = f"{self.tags[i]}.{'.'.join(w for n in self.names(i) for w in _WORDS.findall(n))}({','.join(parts)})"
            out[i] = form if len(form) < 2000 else hashlib.blake2b(form.encode("utf-8", "replace"), digest_size=16).hexdigest()
        return out

    @cached_property
    def kept(self) -> list[bool]:
        """Elements that no name can drop: those that hold an article or main element with text, and, on pages without, those with most of the text."""
        n, sizes = len(self.tags), self._sizes(DROPPED - WRAPPERS)
        out = [False] * n
        for i in range(n - 1, 0, -1):
            out[self.parents[i]] |= out[i] or self.tags[i] in MAIN and sizes[i] > 0
        if not out[0]:
            total = sizes[0]
            out = [2 * s > total for s in sizes]
        return out

    @cached_property
    def sizes(self) -> list[int]:
        return self._sizes()

    def dropped(self, i: int, in_article: bool) -> bool:
        tag = self.tags[i]
        if tag in DROPPED or (tag == "header" and not in_article):
            return tag not in WRAPPERS or not self.kept[i]
        if tag in MAIN or tag in ("html", "body", "#page") or not self.attributes[i]:
            return False
        names = self.names(i)
        if in_article:
            return bool(STRONG & set(names)) and 2 * self.sizes[i] <= self.sizes[0]
        return any(_marks(n) for n in names) and not self.kept[i]

    def walk(self, deleted: frozenset[int] = frozenset(), by_name: bool = True) -> Iterator[tuple[int, str, bool]]:
        """(element, text, in article) of each text in page order and, with a space as text, of each block's start and end; without what is dropped."""
        stack: list[tuple] = [(0, False, False)]
        while stack:
            item, inside, leaving = stack.pop()
            if isinstance(item, str):
                yield leaving, item, inside
                continue
            if leaving:
                yield item, " ", inside
                continue
            if item in deleted or (self.dropped(item, inside) if by_name else self.tags[item] in RAW):
                continue
            inside = inside or self.tags[item] in MAIN
            if self.tags[item] in BLOCK:
                yield item, " ", inside
                stack.append((item, inside, True))
            stack += [(c, inside, False) if isinstance(c, int) else (c, inside, item) for c in reversed(self.children[item])]

    def main_text(self, deleted: frozenset[int] = frozenset(), by_name: bool = True) -> str:
        """The article's text, or the whole page's where it has none; white space inside and between blocks is one space.

        Without ``by_name`` only what is deleted is left out, whatever its name and whether there is an article.
        """
        texts = [(t, inside) for _, t, inside in self.walk(deleted, by_name)]
        if by_name and any(inside and not t.isspace() for t, inside in texts):
            texts = [(t, inside) for t, inside in texts if inside]
        return " ".join("".join(t for t, _ in texts).split())

    def _sizes(self, without: frozenset[str] = RAW | {"head"}) -> list[int]:
        """Characters of text in each element, leaving those ``without`` out of what they are in."""
        out = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, 0, -1):
            out[i] += sum(len(c) for c in self.children[i] if isinstance(c, str) and not c.isspace())
            if self.tags[i] not in without:
                out[self.parents[i]] += out[i]
        return out

    def _content(self, sizes: list[int], holds_main: list[bool]) -> set[int]:
        """The containers around the content, and the content itself: down from the page as long as one of them holds most of the text."""
        at, path = 0, {0}
        while True:
            inner = [c for c in self.children[at] if isinstance(c, int) and (self.tags[c] in OUTSIDE or self.tags[c] in MAIN or self.tags[c] in ("html", "body"))]
            best = max(inner, key=lambda c: (holds_main[c] or self.tags[c] in MAIN, sizes[c]), default=None)
            if best is None or self.tags[at] in MAIN or 2 * sizes[best] < sizes[0] and not (holds_main[best] or self.tags[best] in MAIN):
                return path
            at = best
            path.add(at)

    def templates(self) -> list[tuple[int, bytes]]:
        """Candidates for template: elements with text that may be deleted, and their digests, exact and of their form."""
        n = len(self.tags)
        inside, filled, blocks, holds_main = [False] * n, [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parents[i]] or self.tags[self.parents[i]] in MAIN
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            filled[i] = filled[i] or any(isinstance(c, str) and not c.isspace() for c in self.children[i])
            filled[up] = filled[up] or filled[i]
            blocks[up] = blocks[up] or blocks[i] or self.tags[i] in BLOCK
            holds_main[up] = holds_main[up] or holds_main[i] or self.tags[i] in MAIN
        sizes = self.sizes
        content = self._content(sizes, holds_main)
        # Below the innermost content nothing is told by its form; beside it, all containers are, and where nothing holds most of the text, those that are mostly links.
        innermost, links = max(content), [0] * n
        for i in range(n - 1, 0, -1):
            links[i] = sizes[i] if self.tags[i] == "a" else links[i]
            links[self.parents[i]] += links[i]
        within = [False] * n
        for i in range(1, n):
            within[i] = within[self.parents[i]] or self.parents[i] == innermost
        whole_page = self.tags[innermost] in ("#page", "html", "body")
        exact, forms, places, found = self.hashes(), self.forms(), [""] * n, []
        for i in range(1, n):
            places[i] = hashlib.blake2b(f"{places[self.parents[i]]}/{self.tags[self.parents[i]]}".encode(), digest_size=8).hexdigest()
            container = self.tags[i] in (CONTAINERS if inside[i] else OUTSIDE) or "-" in self.tags[i] and blocks[i]
            if not filled[i] or not container or holds_main[i]:
                continue
            found.append((i, exact[i]))
            if i not in content and not inside[i] and (not within[i] or whole_page and 2 * links[i] >= sizes[i]):
                found.append((i, hashlib.blake2b(f"{places[i]} {forms[i]}".encode("utf-8", "replace"), digest_size=8).digest()))
        return found

    def keyed(self, host: str) -> list[tuple[int, int]]:
        """(element, number of its digest on this host) of each candidate."""
        name = host.encode("utf-8", "replace")
        return [(i, int.from_bytes(hashlib.blake2b(d + name, digest_size=8).digest(), "little", signed=True)) for i, d in self.templates()]


def recurring(n: Column, pages: Column) -> Column:
    """Whether the lower bound (Wilson's) of a share, n of ``pages``, is at least ``SHARE``."""
    share, z = n / pages, SURE * SURE / pages
    return (share + z / 2 - SURE * F.sqrt(share * (1 - share) / pages + z / (4 * pages))) / (1 + z) >= SHARE


def site_templates(pages: DataFrame) -> DataFrame:
    """(subtree): numbers of the digests, host included, that are template of a host. ``pages`` has host and html.

    Counting goes by (host, subtree) after distinct content, so a hot host spreads out.
    """

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=100):
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                content = hashlib.blake2b(page.main_text().encode("utf-8", "replace"), digest_size=8).hexdigest()
                # Every page has a row without a subtree, by which the host's pages are counted.
                rows.append((host, None, content))
                rows += [(host, k, content) for k in {k for _, k in page.keyed(host)}]
            columns = zip(*rows, strict=True) if rows else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "subtree", "content"])

    found = map_arrow(pages.select("host", "html"), subtrees, "host string, subtree long, content string")
    counts = written(found.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")), "subtree-counts")
    pages_of = counts.filter("subtree is null").select("host", F.col("n").alias("pages"))
    counts = salted_join(counts.filter("subtree is not null and n > 1"), pages_of, ["host"], F.col("subtree"), "inner")
    return written(counts.filter(recurring(F.col("n"), F.col("pages"))).select("subtree"), "site-templates")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", by_name: bool = True, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars, removed) of every row of ``pages``; removed counts the elements deleted as template.

    Up to ``broadcast`` templates their digests go to the tasks; beyond, pages get theirs by a join on their elements' digests.
    ``by_name=False`` shows what template removal does alone.

    Edge cases: null and empty html give an empty text; a page without article or main element gives its whole body, cleaned in
    the same way; a null url has the empty host; a host of one or two pages has no template; broken markup is read as far as it goes, very long pages whole;
    repeated rows, rows of equal or null id are kept, and copies of a page count once as a recurrence; an empty table gives an
    empty result; other columns are not read; ids are whole numbers.
    """
    host, _ = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = site_templates(rows)
    schema = "page_id long, url string, text string, n_chars long, removed int"

    def made(batch: pa.RecordBatch, parsed: list[Page], doomed: list[frozenset[int]]) -> pa.RecordBatch:
        texts = [p.main_text(d, by_name) for p, d in zip(parsed, doomed, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, doomed), pa.int32())], names=["page_id", "url", "text", "n_chars", "removed"])

    if found.count() <= broadcast:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(found.toArrow().column(0).to_pylist()))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in sliced(batches, column=3, rows=100):
                parsed = [Page(s) for s in batch.column(3).to_pylist()]
                yield made(batch, parsed, [frozenset(i for i, k in p.keyed(h) if k in known) for h, p in zip(batch.column(2).to_pylist(), parsed, strict=True)])

        return map_arrow(rows, extract, schema)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=3, rows=100):
            own = [(row, i, k) for row, h, s in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for i, k in Page(s).keyed(h)]
            columns = zip(*own, strict=True) if own else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["row", "element", "subtree"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=3, rows=100):
            yield made(batch, [Page(s) for s in batch.column(3).to_pylist()], [frozenset(d or ()) for d in batch.column(4).to_pylist()])

    # Numbered rows are written first, so that a task that runs again gives them the same numbers.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "page-rows")
    own = map_arrow(rows, elements, "row long, element int, subtree long")
    doomed = salted_join(own, found, ["subtree"], F.struct("row", "element"), "inner").groupBy("row").agg(F.collect_set("element").alias("elements"))
    return map_arrow(rows.join(doomed, "row", "left").select("page_id", "url", "host", "html", "elements"), cut, schema)
