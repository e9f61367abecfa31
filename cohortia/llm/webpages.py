"""Main text of web pages by consensus: pages of a host vote for the path of their article.

Every page scores its containers: prose inside counts for them, boilerplate inside against them. The best
container's path of generalised tags and classes (digits become ``#``) is the page's vote. Votes
are counted per host, with partial sums before the shuffle, and each page is read again through
the paths that won on its host; a page that has none of them goes by its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import SMALL_BYTES, cut, small_batches, texts

#: A path wins on its host with this share of the votes; the leader always does.
WINNING_SHARE = 0.1
#: A large table of winners is joined on the host and this many salts.
SALTS = 32

# Element and class names with a known role on web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td center blockquote figure details".split())
JUNK_TAGS = frozenset("aside button dialog footer form head header label menu nav object select svg canvas audio video map".split())
JUNK_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
JUNK_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts adbox adslot banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright"
    " disclaimer disqus feedback footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices"
    " notification outbrain overlay pager pagination popup privacy promo promoted promotion recommended related replies reply"
    " respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toc toolbar widget widgets".split()
)
#: Parts of a text that may be named after what they say: a word that a text can be about, in the id or on a part as small as a
#: paragraph, makes them boilerplate only if they are mostly links or no longer than this. A heading is never boilerplate by its name.
SMALL_PART = 100
SOFT_TAGS = dict.fromkeys("p pre li dt dd td th tr figcaption".split(), SMALL_PART) | dict.fromkeys("section ul ol dl table figure blockquote".split(), 200)
CONTENT_WORDS = frozenset(
    "banner breadcrumb breadcrumbs copyright cookie cookies disclaimer feedback footer header hidden login menu navigation notice notices notification overlay"
    " pagination privacy promotion recommended related replies search share sharing skip social sponsor sponsored subscription tags widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A junk word beside one of these names a part of the article, such as an entry's header.
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
PART_WORDS = frozenset("header byline tags".split())

#: Items that end where a sibling begins, unless a list or table of their own was opened since.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",))}
SIBLINGS |= {"td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


#: Whether an element holds boilerplate: no, yes, or by what it turns out to hold.
CLEAN, JUNK, SOFT = range(3)


class _Shape:
    """Generalised name of an element and whether it holds boilerplate; remembered per tag and attributes."""

    def __init__(self):
        self.memory: dict[tuple[str, str], tuple[str, int]] = {}

    def __call__(self, tag: str, raw: str) -> tuple[str, int]:
        key = (tag, raw)
        known = self.memory.get(key)
        if known is None:
            known = self._find(tag, _attributes(raw))
            if len(raw) < 200 and len(self.memory) < 20_000:
                self.memory[key] = known
        return known

    @staticmethod
    def _find(tag: str, attributes: dict[str, str]) -> tuple[str, int]:
        classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
        name = tag + "".join(f".{c}" for c in classes)
        if attributes.get("id"):
            name += "#" + re.sub(r"\d+", "#", attributes["id"])
        words = {w.lower() for w in _WORD.findall(attributes.get("class", "") + " " + attributes.get("id", ""))}
        found = words & JUNK_WORDS
        given = tag in JUNK_TAGS or attributes.get("role", "").lower() in JUNK_ROLES
        named = bool(found) and tag not in HEADINGS
        if found <= PART_WORDS and words & ARTICLE_WORDS and tag not in JUNK_TAGS:
            given = named = False
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        if tag in ("html", "body"):
            given = named = False
        elif tag in ("article", "main"):
            given = named = (given or named) and "comment" in "".join(found)
        by_class = {w.lower() for w in _WORD.findall(attributes.get("class", ""))} & JUNK_WORDS
        soft = named and not given and tag in SOFT_TAGS and found <= CONTENT_WORDS and (not by_class or SOFT_TAGS[tag] <= SMALL_PART)
        return name.replace(">", "_"), JUNK if hidden or given or named and not soft else SOFT if soft else CLEAN


_shape = _Shape()


class Block:
    """One run of text between block-level tags, and the innermost element around it (-1: none)."""

    __slots__ = ("at", "links", "text")

    def __init__(self, at: int, text: str, links: int):
        self.at, self.text, self.links = at, text, links


class Page:
    """Blocks of a page in order, and the elements around each: linear in the page, however deeply it is nested.

    Elements are numbered as they open, so a parent comes before its children.
    """

    def __init__(self, html: str):
        self.names: list[str] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.kinds: list[int] = []
        self.blocks: list[Block] = []
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        stack: list[int] = []
        open_tags: list[str] = []
        places: dict[str, list[int]] = {}  # depths at which a tag is open
        pieces: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self.blocks.append(Block(stack[-1] if stack else -1, text, linked))
            linked = 0

        def leave(depth: int) -> None:
            for tag in open_tags[depth:]:
                places[tag].pop()
            del stack[depth:], open_tags[depth:]

        def last(tags: tuple[str, ...]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        def add(text: str) -> None:
            nonlocal linked
            if text:
                pieces.append(text)
                if places.get("a"):
                    linked += len(text)

        at, search = 0, _TAG.search
        while True:
            tag = search(html, at)
            if tag is None:
                add(html[at:])
                break
            add(html[at : tag.start()])
            at = tag.end()
            slash, name, raw = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
            if not name:
                if tag[0].startswith("<![CDATA["):
                    add(tag[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if name == "br":
                pieces.append(" ")
                continue
            block = name in BLOCKS
            if block:
                flush()
            if slash:
                if places.get(name):
                    leave(places[name][-1])
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                at = end.end()
                continue
            if name in VOID:
                continue
            if block and places.get("p"):  # a paragraph ends where a block begins
                leave(places["p"][-1])
            if name in SIBLINGS:  # so does an item where the next one of its list begins
                group, fence = SIBLINGS[name]
                if last(group) > last(fence):
                    leave(last(group))
            label, kind = _shape(name, raw)
            self.names.append(label)
            self.tags.append(name)
            self.parents.append(stack[-1] if stack else -1)
            self.kinds.append(kind)
            if not raw.rstrip().endswith("/"):
                places.setdefault(name, []).append(len(open_tags))
                stack.append(len(self.names) - 1)
                open_tags.append(name)
        flush()

    def _sums(self, values: list[float]) -> list[float]:
        """Per element the sum over the blocks inside."""
        out = [0.0] * len(self.names)
        for b, v in zip(self.blocks, values):
            if b.at >= 0:
                out[b.at] += v
        for e in range(len(out) - 1, -1, -1):
            if self.parents[e] >= 0:
                out[self.parents[e]] += out[e]
        return out

    def _judge(self) -> None:
        """Which elements hold boilerplate: by kind, by content, or because they lie in one that does."""
        self.junk = [k == JUNK for k in self.kinds]
        if SOFT in self.kinds:
            size, links = self._sums([len(b.text) for b in self.blocks]), self._sums([b.links for b in self.blocks])
            for e, kind in enumerate(self.kinds):
                self.junk[e] = self.junk[e] or kind == SOFT and (2 * links[e] > size[e] or size[e] <= SOFT_TAGS[self.tags[e]])
        for e, parent in enumerate(self.parents):
            self.junk[e] = self.junk[e] or parent >= 0 and self.junk[parent]
        self.bad = [b.at >= 0 and self.junk[b.at] for b in self.blocks]

    def path(self, element: int) -> str:
        out = []
        while element >= 0:
            out.append(self.names[element])
            element = self.parents[element]
        return ">".join(reversed(out))

    def _at_path(self, path: str) -> list[int]:
        """Containers of this path. Places are compared by chained hashes, and the found ones by name."""
        wanted = 0
        for name in path.split(">"):
            wanted = hash((wanted, name))
        chained = []
        for name, parent in zip(self.names, self.parents):
            chained.append(hash((chained[parent] if parent >= 0 else 0, name)))
        found = [e for e, h in enumerate(chained) if h == wanted and self.tags[e] in CONTAINERS]
        return found if found and self.path(found[0]) == path else []

    def scores(self) -> dict[int, float]:
        """Score of every container: prose characters inside, less a quarter of the boilerplate inside."""
        worth = [-0.25 * len(b.text) if bad or 2 * b.links > len(b.text) else len(b.text) - b.links for b, bad in zip(self.blocks, self.bad)]
        found, blocks = self._sums(worth), self._sums([1] * len(worth))
        return {e: found[e] for e in range(len(found)) if blocks[e] and self.tags[e] in CONTAINERS and not self.junk[e]}

    def best(self) -> tuple[int, float] | None:
        """The best container, of equals the innermost; None for a page without text."""
        found = self.scores()
        if not found:
            return None
        top = max(found, key=lambda e: (found[e], e))
        return top, found[top]

    def _inside(self, chosen: set[int]) -> list[bool]:
        """Per element: is it one of ``chosen`` or inside one?"""
        out: list[bool] = []
        for e, parent in enumerate(self.parents):
            out.append(e in chosen or parent >= 0 and out[parent])
        return out

    def text(self, paths: list[str]) -> str:
        """Blocks inside the first path that the page has, else inside its best container."""
        for p in paths:
            chosen = {e for e in self._at_path(p) if not self.junk[e]}
            inside = self._inside(chosen) if chosen else []
            if chosen and any(b.at >= 0 and inside[b.at] and not bad for b, bad in zip(self.blocks, self.bad)):
                break
        else:
            best = self.best()
            if best is None:
                return "\n".join(b.text for b, bad in zip(self.blocks, self.bad) if not bad)
            chosen = {best[0]}
            inside = self._inside(chosen)
        own = self._headlines(chosen) if any(self.bad) else []
        return "\n".join(b.text for b, bad in zip(self.blocks, self.bad) if b.at >= 0 and inside[b.at] and (not bad or own[b.at]))

    def _headlines(self, chosen: set[int]) -> list[bool]:
        """Per element: is it in an h1 or h2 that only headers separate from the chosen element? Such a heading is the article's own."""
        heading, plain = [], []
        for e, parent in enumerate(self.parents):
            if e in chosen or parent < 0:
                heading.append(False)
                plain.append(e in chosen)
            else:
                heading.append(heading[parent] or self.tags[e] in ("h1", "h2"))
                plain.append(plain[parent] and (self.tags[e] in ("header", "hgroup", "h1", "h2", "div") or not self.junk[e]))
        return [h and p for h, p in zip(heading, plain)]


def path_votes(pages: DataFrame) -> DataFrame:
    """host, path and score of each page's best container; a page without text does not vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for url, html in zip(batch.column("url").to_pylist(), texts(batch.column("html"))):
                page = Page(html)
                best = page.best()
                if best is not None and best[1] > 0:
                    hosts.append(host_of(url))
                    paths.append(page.path(best[0]))
                    scores.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])

    return pages.select("url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "host string, path string, score double")


def winning_paths(votes: DataFrame) -> DataFrame:
    """host and its winning paths, most votes first; ties go to the larger score, then to the path."""
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.floor("score")).alias("score"))
    per_host = Window.partitionBy("host")
    share = F.col("votes") / F.sum("votes").over(per_host)
    place = F.row_number().over(per_host.orderBy(F.desc("votes"), F.desc("score"), "path"))
    won = counted.select("host", "path", share.alias("share"), place.alias("place")).where((F.col("share") >= WINNING_SHARE) | (F.col("place") == 1))
    ordered = F.array_sort(F.collect_list(F.struct("place", "path")))  # at most 1 / WINNING_SHARE a host
    return won.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, repeated rows included.

    The text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and reader comments: character references decoded, white space inside a block one
    space, blocks in page order joined by a newline. A null or empty page, or one without text, gives
    "". A null url counts as a host without a name. Other columns are left out.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    winners = cut(winning_paths(path_votes(rows)))
    size = winners.agg(F.sum(F.length("host") + F.length(F.array_join("paths", ",")) + 64)).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("__host", host)
    if size <= SMALL_BYTES:
        joined = rows.join(F.broadcast(winners), F.col("__host") == F.col("host"), "left")
    else:
        salted = winners.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            salted, (F.col("__host") == F.col("host")) & (F.col("__s") == F.col("__salt")), "left"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(html).text(paths or []) for html, paths in zip(texts(batch.column("html")), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", F.col("html").cast("binary").alias("html"), "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
