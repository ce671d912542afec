"""Main text of pages by template deduction.

Tokens of a page are its tags, told apart by their path, and its whole text nodes. Tokens of a host
that occur equally often in each of its pages have the same occurrence vector; the vector is
summed into two numbers, so that a host of any size is only counted. Vectors that cover most
pages of a host and hold several tokens are classes. A second pass over the pages orders and nests
them: a class is valid if its tokens come in one order and within one element of the largest class
on most of its pages. The valid classes are the template. Their text nodes are constant; the text
between them stands in slots, named by the innermost element of the template around it. The slot
of a host with the most text over all its pages is the main one, landmarks before others, and a third pass extracts it.
Elements and names that say what is no article are left out everywhere, whatever they hold.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, written

#: Comments, declarations and tags; an unclosed tag stops at the next bracket, so that the scan is linear.
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: Elements whose content is no text, elements without end, and elements that break a block.
RAW = frozenset("script style textarea title noscript template iframe svg math object select button option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
INLINE = frozenset("b i a em strong span p li".split())
HEADINGS = frozenset("h1 h2 hgroup".split())
#: Elements that are never main text, and words in a class, id or role that say so.
OTHER = frozenset("nav footer aside menu dialog head".split()) | RAW
NAMES = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|forms?|masthead|menu|modal|nav\w*|newsletter|notice|"
    r"pagination|popup|promo\w*|related|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|contentinfo|complementary|search)(?=$|[\s_-])|^widgets?(?=$|[_-])", re.I,
)
#: Of these words, those that an element around the article can have as well; and marks that say what a page has or allows, not what an element is.
WEAK = frozenset("form forms search modal toolbar banner".split())
MODIFIED = re.compile(r"^(?:has|with|without|no|is|show|hide)[_-]|[_-](?:open|closed|enabled|disabled|layout)$", re.I)
ARTICLE = re.compile(r"(?:^|\s)(?:article[-_]?(?:body|text|content)|post[-_]?(?:body|content)|entry[-_]?content|story[-_]?body|articlebody)(?:$|\s)", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s{0,9}=\s{0,9}(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
DIGIT, NUMBER = re.compile(r"\d"), re.compile(r"\d{3,}")
#: A template needs this many pages, tokens in a class, and share of the host's pages.
PAGES, TOKENS, SHARE = 4, 3, 0.6
#: Names of boxes around all text of a page are set aside this often, one around the other.
WRAPPERS = 8
#: Parts into which the tokens of a host are dealt, and tokens of all templates that are sent to every task; more are joined by host.
SALTS, BROADCAST = 64, 2_000_000


@functools.lru_cache(1 << 15)
def _tag(name: str, rest: str) -> tuple[str, str]:
    """Lower name of an element and the values of its attributes that matter."""
    marks = " ".join(sorted({(x[1] or x[2] or x[3]).strip() for x in ATTRIBUTE.findall(rest)})) if rest else ""
    return name.lower(), marks


@functools.lru_cache(1 << 6)
def _end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*+>?", re.I)


def parse(page: str) -> Iterator[tuple[str, str, str]]:
    """``kind, name, value``: open and close with the names of the attributes that matter, and decoded text."""
    at, end, search = 0, len(page), TOKEN.search
    while at < end:
        m = search(page, at)
        if m is None:
            yield "text", "", html.unescape(page[at:])
            return
        if m.start() > at:
            yield "text", "", html.unescape(page[at : m.start()])
        at = m.end()
        slash, name, rest = m.groups()
        if not name:
            continue
        name, marks = _tag(name, rest)
        if slash:
            yield "close", name, ""
            continue
        if name in RAW and not rest.endswith("/"):
            close = _end(name).search(page, at)
            at = close.end() if close else end
            continue
        yield "open", name, marks


@functools.lru_cache(1 << 16)
def _path(parent: int, name: str, marks: str) -> int:
    """The key of an element; marks with digits often differ from page to page: they go where others are left, or else only long numbers do."""
    steady = " ".join(x for x in marks.split() if not DIGIT.search(x)) or NUMBER.sub("#", marks)
    return xxhash.xxh64_intdigest(f"{parent}\0{name}\0{steady}") - (1 << 63)


class Page:
    """The elements of a page in the order of their opening tags, 0 being the page itself, and its tokens: key, kind, value, element."""

    def __init__(self, page: str):
        self.parents, self.names, self.marks, self.paths = [0], [""], [""], [0]
        self.tokens: list[tuple[int, str, str, int]] = []
        open_: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each name
        stack, blocks = [0], []  # open elements, and the depths of those that are blocks
        for kind, name, value in parse(page):
            if kind == "open":
                if name in ("p", "li") and self.names[stack[-1]] == name:
                    self._pop(stack, blocks, open_, len(stack) - 1)  # its end may be left out
                me = len(self.names)
                self.parents.append(stack[-1])
                self.names.append(name)
                self.marks.append(value)
                self.paths.append(_path(self.paths[stack[-1]], name, value))
                self.tokens.append((self.paths[me], kind, name, me))
                if name not in VOID:
                    open_[name].append(len(stack))
                    if name in BLOCKS:
                        blocks.append(len(stack))
                    stack.append(me)
            elif kind == "close":
                depths = open_[name]
                # An inline element does not end beyond a block that is open within it.
                if depths and (name not in INLINE or not blocks or blocks[-1] <= depths[-1]):
                    me = stack[depths[-1]]
                    self._pop(stack, blocks, open_, depths[-1])
                    self.tokens.append((_path(self.paths[me], "/", ""), kind, name, self.parents[me]))
                elif name == "p":
                    self.tokens.append((_path(0, "/p", ""), kind, name, stack[-1]))
            elif value.strip():
                text = xxhash.xxh64_intdigest(" ".join(value.split()), self.paths[stack[-1]] & (1 << 63) - 1) - (1 << 63)
                self.tokens.append((text, kind, value, stack[-1]))

    def _pop(self, stack: list[int], blocks: list[int], open_: dict[str, list[int]], depth: int) -> None:
        while len(stack) > depth:
            name = self.names[stack.pop()]
            open_[name].pop()
            if name in BLOCKS:
                blocks.pop()


def walk(page: str) -> Iterator[tuple[int, str, str, int]]:
    """The tokens of a page: key, kind, value, and the element they stand in."""
    yield from Page(page).tokens


@functools.lru_cache(1 << 15)
def _kind(name: str, marks: str) -> tuple[bool, tuple[str, ...], tuple[str, ...], int]:
    """Whether an element is never main text, its marks of boxes, those of them that count around an article too, and 2 for an article, 1 for a main part."""
    named = [x for x in marks.split() if NAMES.search(x) and not MODIFIED.search(x)] if NAMES.search(marks) or "idget" in marks else []
    weak = [x for x in named if {w.lower() for w in NAMES.findall(x) if w} <= WEAK and not x.lower().startswith("widget")]
    form = ["<form>"] if name == "form" else []
    strong = tuple(x for x in named if x not in weak)
    return name in OTHER, (*form, *named), strong, 2 if name == "article" or ARTICLE.search(marks) else int(name == "main")


def _is(mark: str, void: set[str]) -> bool:
    """Whether a mark is void, or a void one followed by words that name no box."""
    return mark in void or any(mark.startswith(x) and mark[len(x)] in "_-" and not NAMES.search(mark[len(x) :]) for x in void)


class Roles:
    """What the elements of a page are: ``other`` is no main text, ``article`` and ``main`` are within a landmark.

    A named box is other whatever its size. Only where nothing would be left on the page are the
    names that all its outermost boxes share set aside, and weak names and forms where the element holds an
    article. An article within a box is none.
    """

    def __init__(self, page: Page, constant: frozenset[int] | set[int]):
        n = len(page.names)
        kinds = [_kind(name, marks) for name, marks in zip(page.names, page.marks, strict=True)]
        parents = page.parents
        strong, never, holds = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            never[i] = never[parents[i]] or kinds[i][0]
            strong[i] = strong[parents[i]] or kinds[i][0] or bool(kinds[i][2])
            if kinds[i][3] and not strong[i]:
                at = i
                while at and not holds[at]:
                    holds[at], at = True, parents[at]
        boxes = [k[2] if h else k[1] for k, h in zip(kinds, holds, strict=True)]
        texts = {e for k, kind, _, e in page.tokens if kind == "text" and (k not in constant or holds[e])}
        void: set[str] = set()
        for _ in range(WRAPPERS):
            outer = [0] * n
            self.other = other = [False] * n
            self.article, self.main = [False] * n, [False] * n
            for i in range(1, n):
                up = parents[i]
                own = [x for x in boxes[i] if not _is(x, void)] if boxes[i] else ()
                outer[i] = outer[up] or (i if own else 0)
                within = self.article[up] or self.main[up]
                other[i] = never[i] or bool(outer[i]) or other[up] or (page.names[i] == "header" and not within)
                self.article[i] = self.article[up] or kinds[i][3] == 2 and not other[i]
                self.main[i] = self.main[up] or kinds[i][3] == 1 and not other[i]
            if any(not other[e] for e in texts):
                break
            shared = None
            for e in texts:
                if not never[e] and outer[e]:
                    own = {x for x in boxes[outer[e]] if not _is(x, void)}
                    shared = own if shared is None else shared & own
            if not shared:
                break
            void |= shared
        self.parents = parents

    def landmark(self) -> list[bool] | None:
        """The elements within articles, or within the main part where there are none."""
        return self.article if any(self.article) else self.main if any(self.main) else None


def once(page: Page, template: frozenset[int] | set[int]) -> list[int]:
    """For each element the innermost one around it, or itself, that belongs to the template and stands once on the page; 0 for none."""
    count = Counter(page.paths)
    out = [0] * len(page.paths)
    for i in range(1, len(out)):
        path = page.paths[i]
        out[i] = i if count[path] == 1 and path in template else out[page.parents[i]]
    return out


def slots(page: Page, template: frozenset[int]) -> dict[int, tuple[int, bool]]:
    """The slots of a page: the path of their element, the characters of text that is not constant, and whether it is a landmark."""
    roles, found = Roles(page, template), {}
    around, inside = once(page, template), roles.landmark()
    top = list(range(len(page.paths)))  # the outermost element of the landmark around an element
    if inside:
        for i in range(1, len(top)):
            top[i] = top[page.parents[i]] if inside[page.parents[i]] else i
    for k, kind, value, e in page.tokens:
        if kind != "text" or roles.other[e]:
            continue
        mark = bool(inside and inside[e] and page.paths[top[e]] in template)
        if k in template and not mark:
            continue
        slot = page.paths[top[e] if mark else around[e]]
        size, _ = found.get(slot, (0, False))
        found[slot] = size + len("".join(value.split())), mark
    return found


def orders(page: Page, classes: dict[int, int]) -> dict[int, int]:
    """For each class on the page the hash of the order of its tokens, 0 if they do not stand in one element of class 0."""
    first: dict[int, list[tuple[int, int]]] = defaultdict(list)
    count = Counter(page.paths)
    around = [0] * len(page.paths)
    for i in range(1, len(around)):
        path = page.paths[i]
        around[i] = i if count[path] == 1 and classes.get(path) == 0 else around[page.parents[i]]
    seen = set()
    for k, kind, _, e in page.tokens:
        c = classes.get(k)
        if c is not None and k not in seen:
            seen.add(k)
            # An element stands in what is around its parent.
            first[c].append((k, around[page.parents[e]] if kind == "open" else around[e]))
    out = {}
    for c, tokens in first.items():
        nested = c == 0 or len({a for _, a in tokens}) == 1
        out[c] = (xxhash.xxh64_intdigest(",".join(str(k) for k, _ in tokens)) >> 1) | 1 if nested else 0
    return out


def main_text(page: str | None, template: frozenset[int], slot: int | None = None) -> str:
    """The main slot, or the article where the page does not have it, or else all slots, block by block."""
    tree = Page(page or "")
    roles = Roles(tree, template)
    inside = marked = roles.landmark()
    n = len(tree.paths)
    if slot and any(p == slot and not roles.other[i] for i, p in enumerate(tree.paths)):
        inside = [False] * n
        parents = {tree.parents[i] for i, p in enumerate(tree.paths) if p == slot}
        for i in range(1, n):
            # A heading beside the main slot belongs to it.
            inside[i] = inside[tree.parents[i]] or tree.paths[i] == slot or (tree.names[i] in HEADINGS and tree.parents[i] in parents)
    blocks, words = [], []

    def close() -> None:
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    for k, kind, value, e in tree.tokens:
        if kind != "text":
            if value in BLOCKS:
                close()
            elif value == "br":
                words.append(" ")
            continue
        if roles.other[e] or inside is not None and not inside[e]:
            continue
        # Constant text is part of the template, except within the article, where nothing is dropped.
        if k in template and not (marked and marked[e]):
            continue
        words.append(value)
    close()
    return "\n".join(blocks)


COUNTS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])
TALLY = pa.schema([("host", pa.string()), ("what", pa.string()), ("key", pa.int64()), ("value", pa.int64()), ("pages", pa.int64()), ("size", pa.int64())])
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def classes_of(pages: DataFrame) -> DataFrame:
    """``host, all, classes`` of ``host, page, html``: the tokens of each class that covers ``SHARE`` of a host's pages, the largest class first.

    A host's tokens are dealt into ``SALTS`` parts; only those on most of its pages, at most a page's worth over ``SHARE``, meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            hosts, numbers, tokens, counts = [], [], [], []
            for host, number, page in zip(x.column("host").to_pylist(), x.column("page").to_pylist(), x.column("html").to_pylist(), strict=True):
                seen = Counter(k for k, *_ in walk(page or ""))
                hosts += [host] * len(seen)
                numbers += [number] * len(seen)
                tokens += list(seen)
                counts += list(seen.values())
            yield batch(COUNTS, [hosts, numbers, tokens, counts])

    seen = pages.select("host", "page", "html").mapInArrow(count, "host string, page bigint, token bigint, n bigint")
    mark = F.xxhash64("page", "n")
    vectors = seen.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum(F.shiftrightunsigned(mark, 32)).alias("high"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")
    ).where(F.col("pages") >= PAGES * SHARE).withColumn("salt", F.pmod("token", F.lit(SALTS)))
    total = pages.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= PAGES)
    dealt = total.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    often = vectors.join(dealt, ["host", "salt"]).where(F.col("pages") >= F.col("all") * SHARE)
    classes = often.groupBy("host", "all", "pages", "high", "low").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    # The largest class: on most pages, then of most tokens; ties by the least token.
    rank = F.struct((-F.col("pages")).alias("a"), (-F.size("tokens")).alias("b"), F.col("tokens")[0].alias("c"), "tokens")
    whole = classes.where(F.size("tokens") >= TOKENS).groupBy("host", "all").agg(F.array_sort(F.collect_list(rank)).alias("found"))
    return whole.select("host", "all", F.transform("found", lambda c: c.tokens).alias("classes"))


def joined(pages: DataFrame, found: DataFrame, column: str, how: str = "left") -> DataFrame:
    """Pages with what is known of their host; sent to every task if it is small, by its counted size."""
    size = found.agg(F.sum(F.size(F.flatten(column) if column == "classes" else F.col(column)))).first()[0] or 0
    return pages.join(F.broadcast(found) if size <= BROADCAST else found, "host", how)


def templates(pages: DataFrame) -> DataFrame:
    """``host, template, slot`` of ``host, page, html``: the tokens of the valid classes and the path of the main slot, 0 for none."""
    found = written(classes_of(pages), "classes")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            known: dict[str, tuple[dict[int, int], frozenset[int]]] = {}
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for host, page, lists in zip(x.column("host").to_pylist(), x.column("html").to_pylist(), x.column("classes"), strict=True):
                if host not in known:
                    member = {t: c for c, tokens in enumerate(lists.as_py()) for t in tokens}
                    known[host] = member, frozenset(member)
                member, template = known[host]
                tree = Page(page or "")
                for c, value in orders(tree, member).items():
                    sums[host, "order", c, value][0] += 1
                for path, (size, mark) in slots(tree, template).items():
                    entry = sums[host, "slot", path, int(mark)]
                    entry[0] += 1
                    entry[1] += size
            yield batch(TALLY, list(zip(*[(*k, *v) for k, v in sums.items()], strict=True)) or [[]] * 6)

    seen = joined(pages.select("host", "html"), found.select("host", "classes"), "classes", "inner").mapInArrow(
        tally, "host string, what string, key bigint, value bigint, pages bigint, size bigint"
    )
    sums = written(seen.groupBy("host", "what", "key", "value").agg(F.sum("pages").alias("pages"), F.sum("size").alias("size")), "slots")
    # Both have at most a page's worth of rows for a host: one per class and order, one per slot. Orders that occur rarely are as many as pages at worst.
    order = sums.where("what = 'order'").groupBy("host", "key").agg(F.max(F.struct("pages", "value")).alias("most"), F.sum("pages").alias("pages"))
    good = order.where((F.col("most.pages") >= F.col("pages") * SHARE) & (F.col("most.value") != 0)).groupBy("host").agg(F.collect_set("key").alias("good"))
    slot = sums.where("what = 'slot' and key <> 0").join(found.select("host", "all"), "host")
    main = slot.groupBy("host").agg(F.max(F.struct((F.col("pages") >= F.col("all") * SHARE).alias("most"), "value", "size", "key")).alias("main"))
    valid = F.flatten(F.filter(F.col("classes"), lambda c, i: F.array_contains("good", i.cast("bigint"))))
    with_good = found.join(good, "host").join(main, "host", "left")
    return with_good.select("host", valid.alias("template"), F.coalesce("main.key", F.lit(0)).alias("slot"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null or empty html has the empty text. Pages without a host in their url share the empty host.
    Hosts with fewer than ``PAGES`` pages have no template; there, and on pages without the main slot of their host, an article
    or else all that is no box counts. Repeated rows count as often as they stand, and each is extracted. An empty table gives an empty
    result; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1), F.lit("")))
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"),
        F.xxhash64(F.col(id_col), F.col(html_col)).alias("page"),
    )
    found = written(templates(source), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cache: dict[tuple, frozenset] = {}
            out = []
            for page, tokens, slot, name in zip(x.column("html").to_pylist(), x.column("template"), x.column("slot").to_pylist(), x.column("host").to_pylist(), strict=True):
                if name not in cache:
                    cache[name] = frozenset(tokens.as_py() or ())
                out.append(main_text(page, cache[name], slot))
            yield pa.RecordBatch.from_arrays(
                [x.column("page_id"), x.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    with_template = joined(source, found, "template").select("page_id", "url", "html", "host", "template", "slot")
    kind = f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return with_template.mapInArrow(run, kind)
