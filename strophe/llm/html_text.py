"""HTML extraction with a site style tree.

The different pages of a host are merged into one style tree: elements with the same path of tags and classes are one element node, with a style
node for each sequence of child tags. A node's importance is the entropy of its presentation (over the styles of its path) and, the
more the fewer styles there are, of its content: a block that stands at one path with one text on k of m pages has a content importance of 1 - log k / log m.
Branches of low importance that half of the pages or more share are removed from each page, inside articles too: own paragraphs stand on one page and stay.

Pages with equal first heading and two longest blocks count once (copies of one page would look like what all pages share), and hosts of fewer
than ``least`` such pages lose no branch. Tags, roles and classes that say themselves that they are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or comments go on any host; words that may as well be an article's subject (social, related) count inside one only
where half of the text is links or a control stands. The main text is that of the article elements (without
much shorter ones beside them, which are teasers), or of main, if that holds more than twice as much, or of the page.

Only hashes by (host, page, path, style, content) are shuffled; the nodes to remove, at most twice as many for a host as a page of it has, are
joined by host. Null and empty pages give an empty text; null urls are a host of their own; repeated rows stay, whatever their page_id. Ties: of articles
of equal length all stay.
Broken markup: missing end tags are implied, stray ones ignored; very deep or long pages are parsed without recursion.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, table
from .url_filter import host_of

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
IN_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Tags, roles and class words of what is not the article.
TAGS = frozenset("nav footer aside form script style noscript template iframe svg canvas button select textarea input head dialog menu object embed audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidenav aside widget ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search "
    "comment comments commentlist disqus reply replies respond pagination pager skip toolbar topbar copyright".split()
)
#: Words that also name what an article is about; inside an article its links and controls must bear them out.
HINTS = frozenset("share sharing social related recommended recommendations".split())
#: What may stand beside such a word in one class, as in site-footer.
BESIDE = frozenset(
    "site page main top bottom left right wrap wrapper container box area list item items bar block section button buttons link links inner outer content global primary secondary mobile desktop sticky fixed floating slot unit group "
    "post posts article articles entry blog story header head body footer title text icon icons col column row panel the js is has to and of no new all more form field fields info policy us follow media user users reader readers visitor visitors guest guests member members email mail your add leave write view show".split()
)
OUTSIDE = frozenset("header masthead topbar".split())  # not the article only where they stand outside it
#: Quotes count only where a value begins; nothing is given back, so no tag takes long.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s/>]|\Z)")
LEAST, GAMMA, CUT, TEASER = 6, 0.9, 0.3, 3


def telling(names: str) -> int:
    """2 if a class says that it is no article: one of WORDS, alone or beside words that say nothing (site-footer, but not share-price); 1 if only one of HINTS does; else 0."""
    found = 0
    for token in names.split():
        parts = {p for p in re.split(r"[^a-z]+", token) if p}
        if not parts <= WORDS | HINTS | BESIDE:
            continue
        if not parts.isdisjoint(WORDS):
            return 2
        if not parts.isdisjoint(HINTS):
            found = 1
    return found


class Page:
    """Elements in document order (tag, parent, path, noise, article) and a list of texts and block ends."""

    __slots__ = ("article", "hint", "items", "main", "noise", "outer", "parent", "path", "tag")

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.noise, self.outer, self.article, self.main = [""], [0], [0], [False], [False], [False], [False]
        self.hint = [False]
        self.items: list[tuple[int, str | None]] = []
        stack, at, n = [0], 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                self.items.append((stack[-1], source[at:end]))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = close.start() if close else n
            elif tag in VOID or m[3].endswith("/") and tag not in IN_P:
                stack.pop()

    def _open(self, stack: list[int], tag: str, rest: str) -> None:
        if tag in IN_P:
            self._end(stack, {"p"}, {"table", "button", "article"})
        elif tag in CLOSES:
            self._end(stack, CLOSES[tag], SCOPE[tag])
        names, role, hidden = "", "", False
        if rest.strip("/ \n\t\r"):
            for m in ATTRIBUTE.finditer(rest):
                key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    names += " " + value.lower()
                elif key == "role":
                    role = value.lower()
                elif m[5] or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
        up = stack[-1]
        whole = tag in ("html", "body")
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(xxhash.xxh64_intdigest(f"{self.path[up]}/{tag}.{names.strip()}") >> 1)
        said = telling(names) if names and not whole and tag != "main" else 0
        self.noise.append(tag in TAGS or hidden or role in ROLES or said == 2 or said == 1 and not self.article[up])
        self.hint.append(said == 1 and self.article[up])
        self.outer.append(tag == "header" or bool(names) and not whole and not OUTSIDE.isdisjoint(re.split(r"[^a-z0-9]+", names)))
        self.article.append(self.article[up] or tag in ("article", "main") or role == "main")
        self.main.append(tag == "main" or role == "main")
        stack.append(len(self.tag) - 1)
        if tag not in INLINE:
            self.items.append((stack[-1], None))

    def _end(self, stack: list[int], tags: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in tags:
                self.items.append((stack[k], None))
                del stack[k:]
                return
            if self.tag[stack[k]] in scope:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                if tag not in INLINE:
                    self.items.append((stack[k], None))
                del stack[k:]
                return
            if tag in INLINE and self.tag[stack[k]] not in INLINE:
                return

    def blocks(self, shown) -> list[str]:
        """The texts of blocks, decoded, with single spaces; shown: which elements count."""
        out, now = [], []
        for i, text in self.items:
            if text is None or self.tag[i] == "br":
                if now:
                    out.append(" ".join(html.unescape("".join(now)).split()))
                    now = []
            elif shown[i]:
                now.append(text)
        if now:
            out.append(" ".join(html.unescape("".join(now)).split()))
        return [b for b in out if b]

    def noisy(self) -> list[bool]:
        """Which elements stand in one that says that it is no article."""
        gone, borne = [False] * len(self.tag), self.links() if any(self.hint) else self.hint
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            gone[i] = gone[up] or self.noise[i] or self.outer[i] and not self.article[up] or self.hint[i] and borne[i]
        return gone

    def links(self) -> list[bool]:
        """Which elements have half of their text in links, or hold a control."""
        n = len(self.tag)
        linked, all_, within, control = [False] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
            control[i] = self.tag[i] in ("form", "input", "button", "select", "textarea")
        for i, text in self.items:
            if text is not None:
                size = len(text.strip())
                all_[i] += size
                within[i] += size * linked[i]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            all_[up], within[up], control[up] = all_[up] + all_[i], within[up] + within[i], control[up] or control[i]
        return [c or 2 * w >= a for c, w, a in zip(control, within, all_, strict=True)]

    def identity(self) -> int:
        """The same for copies of a page that differ around its text: its first heading and two longest blocks (one may be what all pages share)."""
        gone = self.noisy()
        head = next((i for i in range(1, len(self.tag)) if self.tag[i] in ("h1", "h2") and not gone[i]), 0)
        heading = " ".join(" ".join(t for i, t in self.items if t is not None and i == head).split()) if head else ""
        longest = sorted(set(self.blocks([not x for x in gone])), key=lambda x: (-len(x), x))[:2]
        return hash64(hash64(1, heading), "\n".join(longest))

    def nodes(self) -> list[tuple[int, int, int, int]]:
        """(element, path, style, node) of each element with text that is no inline one: what the style tree counts. node: path and content."""
        n = len(self.tag)
        style, content = [0] * n, [0] * n
        for i in range(1, n):
            if self.tag[i] not in INLINE:
                style[self.parent[i]] = hash64(style[self.parent[i]], self.tag[i])
        for i, text in self.items:
            if text is not None and not text.isspace() and self.tag[i] not in RAW:
                content[i] = hash64(content[i], " ".join(text.split()))
        for i in range(n - 1, 0, -1):
            if content[i]:
                content[self.parent[i]] = hash64(content[self.parent[i]], str(content[i]))
        return [(i, self.path[i], style[i], hash64(self.path[i], str(content[i]))) for i in range(1, n) if self.tag[i] not in INLINE and content[i]]

    def text(self, drop: frozenset[int] = frozenset()) -> str:
        n = len(self.tag)
        gone = self.noisy()
        if drop:
            low = {i for i, _, _, node in self.nodes() if node in drop}
            for i in range(1, n):
                gone[i] = gone[i] or gone[self.parent[i]] or i in low
        size = [0] * n  # what each element holds that isn't gone
        for i, text in self.items:
            if text is not None and not gone[i]:
                size[i] += len(text.strip())
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        top = lambda kinds: [i for i in range(1, n) if kinds[i] and not gone[i] and size[i] and not any_above(self.parent, kinds, i)]
        articles, mains = top([t == "article" for t in self.tag]), top(self.main)
        articles = [i for i in articles if size[i] * TEASER >= max(size[j] for j in articles)]
        roots = articles if sum(size[i] for i in articles) * 2 >= sum(size[i] for i in mains) else mains
        roots = set(roots or [0])
        shown = [False] * n
        for i in range(n):
            shown[i] = i in roots or i > 0 and shown[self.parent[i]]
        return " ".join(self.blocks([x and not y for x, y in zip(shown, gone, strict=True)]))


def any_above(parent: list[int], kinds: list[bool], i: int) -> bool:
    while i:
        i = parent[i]
        if kinds[i]:
            return True
    return False


def hash64(seed: int, value: str) -> int:
    return xxhash.xxh64_intdigest(value, seed & (2**64 - 1)) >> 1


def style_rows(pages: DataFrame) -> DataFrame:
    """host, page, path, style and node of each page, each once in a batch; path 0 stands for the page itself."""

    def run(batches):
        for b in batches:
            seen: set[tuple] = set()
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                ident = page.identity()
                seen.add((host, ident, 0, 0, 0))
                seen.update((host, ident, path, style, node) for _, path, style, node in page.nodes())
            if seen:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen, strict=True), kinds, strict=True)], ["host", "page", "path", "style", "node"])

    return pages.select("host", "html").mapInArrow(run, "host string, page long, path long, style long, node long")


def unimportant(rows: DataFrame, scratch: Scratch, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """host, node of what each host's pages lose. rows: host, page, path, style, node."""
    rows = scratch.keep(rows.distinct())
    sizes = rows.filter("path = 0").groupBy("host").agg(F.count("*").alias("m")).filter(F.col("m") >= least)
    # Nodes that half of a host's pages share are few; only their paths need a style.
    shared = rows.filter("path <> 0").groupBy("host", "path", "node").agg(F.countDistinct("page").alias("k")).filter(F.col("k") >= least)
    shared = scratch.keep(shared.join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h").filter("2 * k >= m"))
    paths = shared.select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    styles = rows.join(paths, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")), "left_semi").groupBy("host", "path", "style").agg(F.countDistinct("page").alias("n"))
    spread = styles.groupBy("host", "path").agg(F.sum("n").alias("all"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("s"))
    presentation = F.when((F.col("styles") > 1), (F.log("all") - F.col("s") / F.col("all")) / F.log("m")).otherwise(0.0)
    content = 1 - F.log("k") / F.log("m")
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    spread = spread.withColumnsRenamed({"host": "h", "path": "p"})
    both = shared.join(spread, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")))
    return both.filter((1 - share) * presentation + share * content < cut).select("host", "node")


def extract_text(pages: DataFrame, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    own = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    with arrow_rows(spark, 500):
        low = scratch.keep(unimportant(style_rows(own), scratch, least, cut))
        hosts = low.groupBy("host").agg(F.collect_set("node").alias("drop"))
        few = low.limit(500_001).count() <= 500_000  # 8 bytes a node, and a host for several
        joined = own.join(F.broadcast(hosts) if few else hosts, "host", "left").select("page_id", "url", "html", "drop")

        def run(batches):
            for b in batches:
                texts = [Page(source or "").text(frozenset(drop or ())) for source, drop in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return scratch.keep(joined.mapInArrow(run, "page_id long, url string, text string, n_chars long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
