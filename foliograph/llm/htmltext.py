"""Main text of web pages by deducing each host's template from token occurrence vectors.

Method: a page is a sequence of tokens, element paths and whole text blocks. A host's pages that
mark an article and those that don't are two layouts with a template each; pages without text are in
neither. A token's occurrence vector says how often it stands on each page of its layout; vectors
are compared by a sum of hashed (page, count) pairs, so they are aggregated on the map side and a
host of any size needs one row a token. Tokens with one vector form an equivalence class; a class of
two tokens or more that stands on at least half of a layout's pages is valid. An element's ancestors
stand wherever it does, so valid classes nest, and together they are the template. What remains is
slots, the text under each path of the template. From all pages of the layout it is decided:

* which texts are the template's own (they stand in a valid class): out where no article is marked;
* which slots hold little but the template's own text, or little but links: out everywhere;
* whether class names of several words, such as "share-prices", are believed where no article is
  marked: not if the slots so named hold most of the text that varies and is no link.

Pages are then read again, and the blocks of the other slots are kept in page order: inside a marked
article if there is one, else outside of menus, forms and the like. In a marked article a name counts
only if it is nothing but a word of ``AROUND`` ("comments"). Layouts of fewer than ``root_pages``
pages, and paths the template doesn't have, are judged page by page. A page that would lose all its
text to the template keeps it (its host has copies of one page only).

Templates go to pages by broadcast if they are measured to be under ``broadcast_bytes``, else by a
join salted so that a hot host is dealt over many tasks. Null html: empty text. A null or odd URL
is a host of its own. Repeated rows get a result each; ties (a layout with exactly half of its text
in named slots, a slot half of which is links) believe the name and keep the slot. An empty table
gives no rows; other columns of the pages are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_slices

#: Fixed values of HTML: elements that hold raw text, have no end, or start a block.
RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template|svg"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}
#: An element of the key ends an open one of the values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: Elements whose text is never article text.
OUTSIDE = frozenset("aside button dialog fieldset footer form head label menu nav option select".split())
#: Words in class, id or role that name a part around the article.
AROUND = frozenset("ad ads advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline-ads comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer gdpr header hidden login masthead menu menubar modal nav navbar navigation navigations newsletter notice notification outbrain pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription taboola teaser toolbar widget widgets".split())
MAIN_WORDS = frozenset("articlebody article-body article-content post-content entry-content post-body story-body".split())

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)({_ATTRS})>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+(?:-[a-z]+)*")


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Element:
    """An open element. hard: outside the article by its tag; named, part: by a whole name or part of one; main: inside a
    marked article, inner: one that lies in a named element; link: inside a link; block: the element its text belongs to."""

    __slots__ = ("tag", "path", "hard", "named", "part", "main", "inner", "link", "block")

    def __init__(self, tag: str, path: int, hard: bool, named: bool, part: bool, main: bool, inner: bool, link: bool, up: Element | None):
        self.tag, self.path, self.hard, self.named, self.part, self.main, self.inner, self.link = tag, path, hard, named, part, main, inner, link
        apart = up is None or tag in BLOCK or (hard, named, part) != (up.hard, up.named, up.part)
        self.block = self if apart else up.block


class Reader:
    """Reads pages into blocks; keeps the elements it has met by (parent, tag, names)."""

    def __init__(self, most: int = 50_000):
        self.met: dict[tuple, tuple] = {}
        self.most = most

    def element(self, up: Element, tag: str, attrs: str) -> Element:
        names = ""
        if attrs and not attrs.isspace():
            names = " ".join(sorted(f"{m[1]}={m[2] or m[3] or m[4] or ''}".lower() for m in NAMES.finditer(attrs)))
            names = re.sub(r"\d+", "0", names)
        key = (up.path, up.hard, up.named, up.part, up.main, up.inner, up.link, tag, names)
        if key not in self.met:
            if len(self.met) >= self.most:
                self.met.clear()
            whole: set[str] = set()
            hidden = False
            for attr in names.split(" "):
                name, _, value = attr.partition("=")
                hidden |= name == "hidden" or (name == "aria-hidden" and value == "true")
                whole.update(WORDS.findall(value if "=" in attr else attr))
            parts = {w for x in whole for w in x.split("-")}
            main = up.main or tag in ("article", "main") or bool((whole & MAIN_WORDS or "main" in parts) and tag not in ("body", "html"))
            hard = up.hard or hidden or tag in OUTSIDE or (tag == "header" and not up.main)
            opened = main and not up.main and not hard and (up.named or up.part)
            free = tag in ("body", "html", "article", "main")
            named = not opened and (up.named or (not free and bool(whole & AROUND)))
            part = not opened and not main and (up.part or (not free and bool(parts & AROUND)))
            self.met[key] = (_hash(f"{up.path}/{tag} {names}"), hard, named, part, main, up.inner or opened, up.link or tag == "a")
        return Element(tag, *self.met[key], up)

    def blocks(self, html: str) -> tuple[list[tuple[int, str, bool, bool, int, bool]], Counter[int]]:
        """(path, text, around, main, characters in links, named in part) of each block in page order, and how often each element path stands."""
        root = Element("", 0, False, False, False, False, False, False, None)
        stack, out, paths = [root], [], Counter({0: 1})
        opened: Counter[str] = Counter()
        text: list[str] = []
        blank, links, at, where = True, 0, 0, root

        def flush() -> None:
            nonlocal blank, links
            if not blank:
                whole = " ".join(unescape("".join(text)).split())
                if whole:
                    out.append((where, whole, min(links, len(whole))))
            text.clear()
            blank, links = True, 0

        def add(piece: str) -> None:
            nonlocal blank, links, where
            if piece:
                top, empty = stack[-1], not piece.strip()
                if blank or (top.block is not where and (top.block.hard, top.block.named, top.block.part) != (where.hard, where.named, where.part)):
                    flush()
                    where = top.block
                text.append(piece)
                blank = blank and empty
                if top.link:
                    links += len(piece.strip())

        def close(k: int) -> None:
            for e in stack[k:]:
                opened[e.tag] -= 1
            del stack[k:]

        for m in TOKEN.finditer(html):
            add(html[at : m.start()])
            at = m.end()
            end, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                flush()
            if end:
                if opened[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            close(k)
                            break
                        if tag not in BLOCK and stack[k].tag in BLOCK:
                            break
            elif tag in VOID:
                if tag in ("br", "hr", "img"):
                    add(" ")
            else:
                if tag in CLOSES_P and opened["p"]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            close(k)
                            break
                        if stack[k].tag in BLOCK:
                            break
                ends = ENDS.get(tag, ())
                if any(opened[x] for x in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in ends:
                            close(k)
                            break
                        if stack[k].tag in SCOPES[tag]:
                            break
                made = self.element(stack[-1], tag, attrs.rstrip("/"))
                paths[made.path] += 1
                if not attrs.endswith("/") or tag in BLOCK:
                    stack.append(made)
                    opened[tag] += 1
        add(html[at:])
        flush()
        # Names give way to an article inside them that holds more text than the rest of a page without another one.
        article = sum(len(t) for e, t, _ in out if e.inner and not e.hard)
        rest = [b for b in out if not b[0].inner and not (b[0].hard or b[0].named or b[0].part)]
        believed = article and not any(e.main for e, _, _ in rest) and article > sum(len(t) - n for _, t, n in rest)
        return [(e.path, t, e.hard or e.named or (e.inner and not believed), e.main, n, e.part) for e, t, n in out], paths


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _signed(x: int) -> int:
    return (x & (1 << 64) - 1) - (1 << 64) * (x >> 63 & 1)


def marks(blocks: list[tuple]) -> bool:
    """Whether a page marks an article."""
    return any(main and not around and not part for _, _, around, main, _, part in blocks)


def token_counts(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(host, marked, path, text, pages, vector, chars, links, around, part): tokens summed over each task's pages.

    ``text`` is 0 for the element path itself, else the hash of a whole block under it. The vector
    is the wrapping sum of hashes of (page, count).
    """
    picked = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        import random

        from pyspark import TaskContext

        read, serial = Reader(), random.Random(TaskContext.get().partitionId())
        sums: dict[tuple, list] = {}

        def table():
            keys, rows = list(sums), list(sums.values())
            for k in range(0, len(keys), 20_000):
                a, b = keys[k : k + 20_000], rows[k : k + 20_000]
                yield pa.record_batch(
                    [pa.array([x[0] for x in a]), pa.array([x[1] for x in a], pa.bool_()), pa.array([_signed(x[2]) for x in a], pa.int64()), pa.array([_signed(x[3]) for x in a], pa.int64()), *(pa.array([_signed(x[j]) for x in b], pa.int64()) for j in range(4)), pa.array([x[4] for x in b], pa.bool_()), pa.array([x[5] for x in b], pa.bool_())],
                    names=["host", "marked", "path", "text", "pages", "vector", "chars", "links", "around", "part"],
                )
            sums.clear()

        for batch in batches:
            hosts = batch.column(0).to_pylist()
            for at, slice_ in text_slices(batch, 1):
                for k, html in enumerate(slice_):
                    page = serial.getrandbits(63)
                    blocks, paths = read.blocks(html or "")
                    if not blocks:
                        continue
                    marked = marks(blocks)
                    seen: dict[tuple, list] = {(p, 0): [n, 0, 0, False, False] for p, n in paths.items()}
                    for path, text, around, main, links, part in blocks:
                        for key in ((path, 0), (path, _hash(text) or 1)):
                            row = seen.setdefault(key, [0, 0, 0, False, False])
                            row[0] += bool(key[1])
                            row[1] += len(text)
                            row[2] += links
                            row[3], row[4] = around or (marked and not main), part
                    host = hosts[at + k]
                    for (path, text), (n, chars, links, around, part) in seen.items():
                        row = sums.setdefault((host, marked, path, text), [0, 0, 0, 0, False, False])
                        row[0] += 1
                        row[1] = (row[1] + (page * (2 * n + 1) ^ n * 0x9E3779B97F4A7C15)) & ((1 << 64) - 1)
                        row[2] += chars
                        row[3] += links
                        row[4], row[5] = row[4] or around, row[5] or part
            if len(sums) > 100_000:
                yield from table()
        yield from table()

    return picked.mapInArrow(run, "host string, marked boolean, path long, text long, pages long, vector long, chars long, links long, around boolean, part boolean")


def templates(pages: DataFrame, html_col: str = "html", url_col: str = "url", share: float = 0.5, root_pages: int = 8, max_links: float = 0.5) -> DataFrame:
    """One row a host and layout: ``slots`` paths whose text is judged for the layout, ``other`` those of them that are out,
    ``fixed`` hashes of texts of the template, ``unbelieved`` whether names of several words count for nothing."""
    tokens = token_counts(pages, html_col, url_col)
    layout = ["host", "marked"]
    # Equal vectors wrap alike in every task, so their sums over tasks are equal too.
    wrapped = F.sum(F.col("vector").cast("decimal(38,0)"))
    sums = tokens.groupBy(*layout, "path", "text").agg(F.sum("pages").alias("pages"), wrapped.alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("around").alias("around"), F.max("part").alias("part"))
    # Text tokens met once are no template; paths all stay, for their slots.
    sums = materialise(sums.where("text = 0 or pages > 1"), "tokens")
    root = sums.where("path = 0 and text = 0").select(*layout, F.col("pages").alias("host_pages")).where(F.col("pages") >= root_pages)
    frequent = sums.join(root, layout).where(F.col("pages") >= share * F.col("host_pages"))
    classes = frequent.groupBy(*layout, "pages", "vector").agg(F.count("*").alias("tokens")).where("tokens > 1")
    valid = frequent.join(classes, [*layout, "pages", "vector"], "left_semi")
    own = F.sum(F.when(F.col("text") != 0, F.col("chars")).otherwise(0))
    slots = valid.groupBy(*layout, "path").agg(
        own.alias("own"), F.sum(F.when(F.col("text") == 0, F.col("chars"))).alias("chars"), F.sum(F.when(F.col("text") == 0, F.col("links"))).alias("links"), F.max("around").alias("around"), F.max("part").alias("part"), F.collect_list(F.when(F.col("text") != 0, F.col("text"))).alias("fixed")
    )
    out = (F.col("links") > max_links * F.col("chars")) | (2 * F.col("own") > F.col("chars"))
    varied = F.when(~out & ~F.col("around"), F.col("chars") - F.col("links") - F.col("own")).otherwise(0)
    return slots.groupBy(*layout).agg(
        F.sort_array(F.collect_set(F.when(F.col("chars") > 0, F.col("path")))).alias("slots"),
        F.sort_array(F.collect_set(F.when((F.col("chars") > 0) & out, F.col("path")))).alias("other"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("fixed")))).alias("fixed"),
        (F.sum(F.when(F.col("part"), varied).otherwise(0)) > F.sum(F.when(F.col("part"), 0).otherwise(varied))).alias("unbelieved"),
    )


class Layout:
    """What a template says of its layout's pages."""

    def __init__(self, slots=(), other=(), fixed=(), unbelieved: bool | None = None):
        self.slots, self.other, self.fixed, self.unbelieved = frozenset(slots), frozenset(other), frozenset(fixed), unbelieved


NO_TEMPLATE = Layout()


def main_text(read: Reader, html: str, layouts: tuple[Layout, Layout] = (NO_TEMPLATE, NO_TEMPLATE), max_links: float = 0.5) -> str:
    """The main slots' blocks of one page, joined by newlines. ``layouts``: of the host's pages without a marked article, and of those with one."""
    blocks, _ = read.blocks(html)
    marked = marks(blocks)
    layout = layouts[marked]
    unbelieved = layout.unbelieved
    if unbelieved is None:
        free = [(len(t) - n, part) for _, t, around, _, n, part in blocks if not around and n <= max_links * len(t)]
        unbelieved = sum(n for n, part in free if part) > sum(n for n, part in free if not part)
    out, own = [], []
    for path, text, around, in_main, links, part in blocks:
        if around or (part and (marked or not unbelieved)) or (marked and not in_main):
            continue
        key = _signed(path)
        if not marked and key not in layout.slots and links > max_links * len(text):
            continue
        out.append(text)
        own.append(key in layout.other or (not marked and _signed(_hash(text) or 1) in layout.fixed))
    return "\n".join(out if all(own) else [t for t, f in zip(out, own) if not f])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 4 << 20, salts: int = 32, **options) -> DataFrame:
    """(id, url, text) for every row."""
    found = materialise(templates(pages, html_col, url_col, **options), "templates")
    names = ("unmarked", "marked")
    size = found.agg(F.sum(8 * (F.size("slots") + F.size("other") + F.size("fixed")) + F.length("host") + 96)).first()[0] or 0
    template = F.struct("slots", "other", "fixed", "unbelieved")
    found = found.groupBy("host").agg(*(F.first(F.when(F.col("marked") == bool(k), template), ignorenulls=True).alias(n) for k, n in enumerate(names)))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("id", "url", "html", "host", *names)

    def run(batches):
        read, known = Reader(), {}
        for batch in batches:
            hosts, out = batch.column(3).to_pylist(), []
            for at, slice_ in text_slices(batch, 2):
                for k, html in enumerate(slice_):
                    host = hosts[at + k]
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = tuple(Layout(**x) if x else NO_TEMPLATE for x in (batch.column(c)[at + k].as_py() for c in (4, 5)))
                    out.append(main_text(read, html or "", known[host]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, url string, text string")
