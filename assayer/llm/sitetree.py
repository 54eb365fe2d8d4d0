"""Main text of web pages by site style trees."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ready

LEAST_IMPORTANCE = 0.3  # branches below go, on a site of very many pages
SURE_IMPORTANCE = 2.0  # times that: text that a branch can't take with it
PAGES_A_PART = 100_000  # pages of a site that meet its low branches in one part, about

# Fixed values of HTML: elements by how they take part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br img wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: What a start tag ends if it is the innermost of these still open.
ENDS_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
SCOPE = frozenset("ul ol dl table tr select body html article section main div".split())
# Elements, and words in class, id and role, that never hold an article's text.
NOISE_TAGS = frozenset(
    "head title script style noscript template nav header footer aside form button input select textarea iframe object "
    "embed svg canvas menu dialog noembed noframes".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "respond reply replies disqus related recommended pagination pager widget complementary contentinfo search toolbar "
    "legal disclaimer copyright".split()
)
MAIN_TAGS = frozenset("article main".split())
#: Of these, what makes an article or main element noise as well; and what begins names that only tell of a layout.
SIDE_WORDS = frozenset("ad ads advert promo sponsored comment comments reply related teaser".split())
LAYOUT_WORDS = frozenset("has with without no not is".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_TOLD = frozenset(("class", "id", "role"))
_GAP = re.compile(r"[\s/]*+")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_BARRIER = ("article", "main", "body")


def _hash(*parts: str | bytes | int) -> int:
    h = xxhash.xxh64()
    for p in parts:
        h.update(p.to_bytes(8, "little", signed=True) if isinstance(p, int) else p.encode("utf-8", "surrogatepass") if isinstance(p, str) else p)
    return h.intdigest() - (1 << 63)


@dataclass(frozen=True)
class Markup:
    """What markup alone says: elements and names that never hold an article's text, and elements that hold it."""

    noise_tags: frozenset[str] = NOISE_TAGS
    noise_words: frozenset[str] = NOISE_WORDS
    main_tags: frozenset[str] = MAIN_TAGS
    side_words: frozenset[str] = SIDE_WORDS


@dataclass
class Page:
    """A page's elements but inline ones, and its blocks of text in order.

    An element has the hash of its path (of tags and first classes), its
    parent, the hash of its style (the signs of its children in order, a run of
    equal ones once, # for text), and whether it is part of the main element.
    """

    path: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])
    style: list[int] = field(default_factory=lambda: [0])
    main: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, bool]] = field(default_factory=list)  # element, text, noise by markup
    raw: list[tuple[int, int]] = field(default_factory=list)  # element and hash of what a script, style or title holds

    def facts(self) -> set[tuple[int, int, int]]:
        """(path, kind, value): that an element is there (kind 0), what it says (1), and how it is laid out (2)."""
        out = {(p, 0, 0) for p in self.path}
        out.update((self.path[i], 1, _hash(text)) for i, text, _ in self.blocks)
        out.update((self.path[i], 1, h) for i, h in self.raw)
        out.update((p, 2, s) for p, s in zip(self.path, self.style, strict=True))
        return out


def parse(source: str | None, markup: Markup = Markup()) -> Page:  # noqa: B008
    """A page's elements and blocks, in time and memory linear in it, however deep or broken its markup.

    A block is the text between starts and ends of block elements, references
    decoded, white space as one space. Tags may be left open or closed twice.
    Text in comments and declarations is none, nor is a last tag that never
    ends, as HTML has it.
    """
    page, at = Page(), 0
    source = source or ""
    tags, block, bad_at = [""], [0], [False]  # of each open element: tag, its own or nearest block element, whether it is noise
    where: dict[str, list[int]] = {}  # where a tag's open elements are on the stack
    scopes: list[int] = [0]
    last: list[str] = [""]  # the last child's sign of each element of the page
    held: list[str] = []

    def child(i: int, sign: str) -> None:
        if last[i] != sign:
            last[i] = sign
            page.style[i] = _hash(page.style[i], sign)

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                child(block[-1], "#")
                page.blocks.append((block[-1], text, bad_at[-1]))

    def close(to: int) -> None:
        if any(t not in INLINE for t in tags[to:]) or any(n != bad_at[to - 1] for n in bad_at[to:]):
            flush()
        for t in tags[to:]:
            where[t].pop()
            if t in SCOPE:
                scopes.pop()
        del tags[to:], block[to:], bad_at[to:]

    def open_at(*names: str) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    lower = source.lower() if "<" in source else source
    if len(lower) != len(source):  # letters whose lower case is longer
        lower = source
    n = len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            held.append(source[at:])
            break
        if start > at:
            held.append(source[at:start])
        m = _TAG.match(source, start)
        if m is None:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif source.startswith(("<!", "<?"), start):
                end = source.find(">", start + 2)
                at = n if end < 0 else end + 1
            else:
                held.append("<")
                at = start + 1
            continue
        at, told = m.end(), []
        while a := _ATTRIBUTE.match(source, at):
            at = a.end()
            name = a[1].lower()
            if name in _TOLD:
                told.append((name, (a[2] or a[3] or a[4] or "").lower()))
        at = _GAP.match(source, at).end()
        if at >= n:
            break
        at += 1
        tag = m[2].lower()
        if m[1]:
            to = open_at(tag)
            if to and not (tag in INLINE and to < open_at(*_BARRIER)):
                close(to)
            continue
        if tag in ENDS_PARAGRAPH or tag in ENDS_SAME:
            to = open_at(*ENDS_SAME.get(tag, ("p",)))
            if to and to >= scopes[-1]:
                close(to)
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
                child(block[-1], tag)
            continue
        words = set()
        sign = tag
        for name, value in told:
            for token in value.split():
                parts = _PART.findall(token)
                if parts and parts[0] not in LAYOUT_WORDS:
                    words.update(parts)
            if name == "class" and value.strip():
                sign = f"{tag}.{value.split()[0]}"
        up = block[-1]
        sides = markup.side_words if tag in markup.main_tags else markup.noise_words if tag not in ("html", "body") else frozenset()
        bad = bad_at[-1] or tag in markup.noise_tags or bool(words & sides)
        if tag not in INLINE or bad != bad_at[-1]:
            flush()
        child(up, sign)
        if tag not in INLINE:
            page.path.append(_hash(page.path[up], sign))
            page.parent.append(up)
            page.style.append(0)
            page.main.append(page.main[up] or tag in markup.main_tags)
            last.append("")
            up = len(page.path) - 1
        where.setdefault(tag, []).append(len(tags))
        if tag in SCOPE:
            scopes.append(len(tags))
        tags.append(tag)
        block.append(up)
        bad_at.append(bad)
        if tag in RAW and source[at - 2] != "/":
            end = lower.find(f"</{tag}", at)
            end = n if end < 0 else end
            if tag not in INLINE and end > at:
                page.raw.append((up, _hash(source[at:end])))
            at = end
    flush()
    return page


def host_of(url_col: str):
    """The host that a URL names, in lower case without port and user; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", markup: Markup = Markup()) -> DataFrame:  # noqa: B008
    """Every page parsed once, and kept: its elements, its blocks, its facts, and the hash of all that it says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source in b["html"]:
                p = parse(source, markup)
                told = sorted(p.facts())
                rows.append(
                    (
                        _hash("\n".join(t for _, t, _ in p.blocks)), p.path, p.parent, [p.main[i] for i, _, _ in p.blocks],
                        [i for i, _, _ in p.blocks], [t for _, t, _ in p.blocks], [n for _, _, n in p.blocks],
                        [f[0] for f in told], [f[1] for f in told], [f[2] for f in told],
                    )
                )
            out = pd.DataFrame(rows, columns=["said", "path", "parent", "main", "at", "text", "noise", "f_path", "f_kind", "f_value"])
            yield pd.concat([b[["uid", "page_id", "url", "host"]].reset_index(drop=True), out], axis=1)

    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        host_of(url_col).alias("host"), F.col(html_col).alias("html"),
    )
    return kept(
        rows.mapInPandas(
            run,
            "uid long, page_id long, url string, host string, said long, path array<long>, parent array<int>, main array<boolean>, at array<int>, "
            "text array<string>, noise array<boolean>, f_path array<long>, f_kind array<byte>, f_value array<long>",
        ),
        "pages",
    )


def importance(parsed_pages: DataFrame) -> DataFrame:
    """(host, path, pages, content, presentation, importance, least): the style tree of each site, merged over its pages.

    Pages of a site that say the same throughout count once. A node of the tree
    is an element's path. A content feature, the text of a block, on c of the
    m pages with the node has entropy log(c) / log(m): 0 on one page only, 1 on
    all; content importance is 1 less the mean entropy of the node's features.
    Presentation importance is the entropy to base m of the styles in which the
    node's element is laid out: 0 if all are alike. A node is as important as
    the greater of both; one of a single page has importance 1. ``least`` is
    how important it must be to stay: LEAST_IMPORTANCE, less the fewer pages
    tell, down to none for one page. Facts add up by hash of host, path and
    value with map-side combining, so a site's pages are never gathered.
    """
    again = kept(parsed_pages.groupBy("host", "said").agg(F.min("uid").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    once = (
        parsed_pages.select("uid", "host", "said", "f_path", "f_kind", "f_value")
        .join(again, ["host", "said"], "left")
        .where("one is null or one = uid")
        .select("host", F.explode(F.arrays_zip("f_path", "f_kind", "f_value")).alias("f"))
        .select("host", F.col("f.f_path").alias("path"), F.col("f.f_kind").alias("kind"), F.col("f.f_value").alias("value"))
    )
    counts = once.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    log = F.log("c")
    nodes = counts.groupBy("host", "path").agg(
        F.max(of(0, F.col("c"))).alias("pages"), F.avg(of(1, log)).alias("logs"),
        F.sum(of(2, F.col("c"))).alias("laid"), F.sum(of(2, F.col("c") * log)).alias("laid_logs"),
    )
    m = F.log("pages")
    entropy = F.least(F.lit(1.0), (F.log("laid") - F.col("laid_logs") / F.col("laid")) / m)
    many = F.col("pages") > 1
    return nodes.select(
        "host", "path", F.col("pages").cast("long").alias("pages"),
        F.when(many, 1 - F.col("logs") / m).otherwise(F.when(F.col("logs").isNotNull(), F.lit(1.0))).alias("content"),
        F.when(many, entropy).otherwise(F.lit(1.0)).alias("presentation"),
    ).select(
        "*", F.greatest("content", "presentation").alias("importance"), (LEAST_IMPORTANCE * (1 - 2 / (F.col("pages") + 1))).alias("least")
    )


def low_blocks(path: np.ndarray, parent: np.ndarray, at: np.ndarray, size: np.ndarray, low: dict[int, float]) -> np.ndarray:
    """Which blocks a page loses with its branches of low importance.

    ``low`` has importance as a share of what is asked, for the paths of the
    site that have less than SURE_IMPORTANCE of it. A branch goes, from the
    root down, if its blocks' mean, weighted by length, is below 1 and none of
    them is sure; so does what a node itself says if that is below 1.
    """
    own = np.array([low.get(p, SURE_IMPORTANCE) for p in path.tolist()])
    weight, total, most = np.zeros(len(path)), np.zeros(len(path)), np.zeros(len(path))
    np.add.at(weight, at, size)
    total[:] = weight * own
    most[weight > 0] = own[weight > 0]
    for i in range(len(path) - 1, 0, -1):  # children come after their parents
        p = parent[i]
        weight[p] += weight[i]
        total[p] += total[i]
        most[p] = max(most[p], most[i])
    gone = (most < SURE_IMPORTANCE) & (total < weight)
    for i in range(1, len(path)):
        gone[i] |= gone[parent[i]]
    return gone[at] | (own[at] < 1)


def main_text(at: np.ndarray, text: list[str], noise: np.ndarray, main: np.ndarray, low: np.ndarray) -> str:
    """The blocks of a page that are neither noise by markup nor in a branch of low importance, a line each.

    Where a page has an article or main element with text, only that counts.
    Its low branches go only if those that stay hold the larger part of its
    text; else what pages share there are copies of an article. Elsewhere they
    go unless nothing else is left.
    """
    own = ~noise
    inner = own & main
    pick = inner if inner.any() else own
    size = np.array([len(t) for t in text])
    stay = pick & ~low
    if (2 * size[stay].sum() <= size[pick].sum()) if inner.any() else not stay.any():
        stay = pick
    return "\n".join(text[i] for i in np.flatnonzero(stay))


def page_text(page: Page, low: dict[int, float] | None = None) -> str:
    """The main text of a parsed page, given the low nodes of its site."""
    at, text = np.array([i for i, _, _ in page.blocks], np.int64), [t for _, t, _ in page.blocks]
    size = np.array([len(t) for t in text], np.float64)
    gone = low_blocks(np.array(page.path), np.array(page.parent), at, size, low or {}) if text else np.zeros(0, bool)
    return main_text(at, text, np.array([n for _, _, n in page.blocks], bool), np.array([page.main[i] for i, _, _ in page.blocks], bool), gone)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", markup: Markup = Markup()) -> DataFrame:  # noqa: B008
    """(page_id, url, text, n_chars): the main text of every page.

    Branches that a site repeats on its pages go, by :func:`importance`, inside
    an article or main element as well; elements and class names that never
    hold an article's text go in any case. Each page is parsed once, into a
    table that is kept; of a site's tree only the nodes of low importance
    travel to its pages, large sites in parts of about PAGES_A_PART pages, so
    that no site's pages meet in one task.

    Null and empty pages give an empty text; a null url counts as one site of
    its own. Rows stay one for one, repeated ones and those with a null id as
    well, in any order; an empty table gives none. Very long and deeply nested
    pages take time and memory in proportion. Other columns of ``pages`` play
    no part, whatever their names.
    """
    ready(pages.sparkSession)
    rows = parsed(pages, id_col, url_col, html_col, markup)
    tree = importance(rows)
    share = F.col("importance") / F.col("least")
    low = kept(
        tree.where((F.col("pages") > 1) & F.col("content").isNotNull() & (share < SURE_IMPORTANCE))
        .groupBy("host")
        .agg(F.max("pages").alias("pages"), F.map_from_entries(F.collect_list(F.struct("path", share.cast("float")))).alias("low"))
        .withColumn("parts", F.ceil(F.col("pages") / PAGES_A_PART).cast("int")),
        "low",
    )
    # A row for PAGES_A_PART pages at most.
    large = F.broadcast(low.where("parts > 1").select("host", "parts"))
    dealt = rows.join(large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("uid"), "parts"), F.lit(0)).cast("int"))
    spread = low.select("host", "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, parent, main, at, text, noise, low in zip(*(b[c] for c in ("path", "parent", "main", "at", "text", "noise", "low")), strict=True):
                at, text = np.asarray(at, np.int64), list(text)
                size = np.array([len(t) for t in text], np.float64)
                known = dict(low) if low is not None else {}
                gone = low_blocks(np.asarray(path), np.asarray(parent), at, size, known) if known and len(text) else np.zeros(len(text), bool)
                out.append(main_text(at, text, np.asarray(noise, bool), np.asarray(main, bool), gone))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    return (
        dealt.join(spread, ["host", "part"], "left")
        .select("page_id", "url", "path", "parent", "main", "at", "text", "noise", "low")
        .mapInPandas(run, "page_id long, url string, text string, n_chars long")
    )
