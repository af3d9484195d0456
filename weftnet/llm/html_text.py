"""Main text of HTML pages by host-wide consensus on container paths (operator 2)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import ddl, row_hash, salted_join, staged, table, whole

#: Pages of a host that must support a path, as a share of its voting pages, before it is used for all of the host's pages.
LEAST_SUPPORT = 0.25
#: Hosts, and characters of their names and paths, up to which the paths go to the pages; with more, pages go to the paths.
FEW_HOSTS, FEW_CHARS = 100_000, 10_000_000

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object head title select".split())
DROPPED = frozenset("nav footer aside form button dialog menu".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div body td blockquote".split())
#: Open elements that a start tag closes, up to the nearest of the second set.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class, id and role names that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion "
    "disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup popover promo promoted promotion related "
    "reply replies respond recommend recommended recommendations share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser teasers "
    "toolbar topbar widget widgets complementary contentinfo alert overlay login search dialog".split()
)
# Words that may follow such a word in a name ("share-buttons") without another meaning, and those that make it the state of
# something else ("has-sidebar", "share-enabled").
FOLLOWING = frozenset(
    "area bar block body box btn button buttons card cards col column container content entry field footer form group header holder icons inner item items left "
    "link links list main message outer panel post posts right row section slot small story stories text thread top bottom unit wrap wrapper zone article articles".split()
)
STATES = frozenset("has with no without is not hide show enable enabled disable disabled open closed visible hidden active ready supports".split())
#: Elements that hold text themselves: their ids are names of places in the text and say nothing about their part in the page.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote span a b i em strong figure figcaption caption".split())

_CLOSING = {tag: re.compile(rf"</(?:{tag}|{tag.upper()})\s*>") for tag in RAW}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: What a form that frames the page has inside, or its end.
_FRAMED = re.compile(r"<(?:(/form)|article|main|h1)\b", re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


def marks_boilerplate(name: str) -> bool:
    """Whether a class, id or role says that its element isn't the article.

    The last word says what a compound name is ("post-share", "article-ad"); a first word does if what follows only shapes it
    ("share-buttons"). Numbers and single letters don't count; states of something else say nothing, also in the middle
    ("content-with-sidebar").
    """
    words = [w for w in (m.lower() for m in _NAME.findall(name)) if len(w) > 1]
    if not words or words[0] in STATES or words[-1] in STATES:
        return False
    if words[0] not in BOILERPLATE and any(w in STATES for w in words):
        return False
    return words[-1] in BOILERPLATE or words[0] in BOILERPLATE and all(w in FOLLOWING or w in BOILERPLATE for w in words[1:])


def _attributes(tag: str, raw: str) -> tuple[str, bool]:
    """(generalised class, drop): the class with digits as #, and whether the element isn't part of an article."""
    shown, drop = "", False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "class":
            shown = ".".join(sorted({re.sub(r"\d+", "#", c.lower()) for c in value.split()}))
        if name in ("class", "role") or name == "id" and tag not in TEXT_ELEMENTS:
            drop = drop or any(map(marks_boilerplate, value.split()))
        elif name == "hidden":
            drop = drop or value.lower() in ("", "hidden")
        elif name == "aria-hidden":
            drop = drop or value.lower() == "true"
        elif name == "style":
            drop = drop or "display:none" in value.replace(" ", "").lower()
    return shown, drop


def blocks(source: str) -> list[tuple[tuple[str, ...], str, int]]:
    """The page's text blocks in order: (path, text, characters in links).

    path names the open containers, from the outermost, as tag or tag.class. Text in dropped elements is left out; a form around an
    article, a main part or a first heading frames the page and isn't dropped. What closes an
    element that isn't open is ignored, and what is still open at the end counts as closed there.
    """
    found: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, is a container, drops its text
    opened: dict[str, int] = {}
    path: list[str] = ["page"]  # what stands in no container is in the page
    dropping = linked = 0
    parts: list[str] = []
    in_links = 0

    def flush() -> None:
        nonlocal in_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((tuple(path), text, in_links))
            parts.clear()
        in_links = 0

    def pop() -> str:
        nonlocal dropping, linked
        tag, contains, drops = stack.pop()
        opened[tag] -= 1
        if contains:
            path.pop()
        dropping -= drops
        linked -= tag == "a"
        return tag

    framed: tuple[int, bool] = (-1, False)  # the next place where a form ends or has an article, and whether it has

    def frames(at: int) -> bool:
        nonlocal framed
        if framed[0] < at:
            m = _FRAMED.search(source, at)
            framed = (m.start(), not m[1]) if m else (len(source), False)
        return framed[1]

    at, length = 0, len(source)
    while at < length:
        end = source.find("<", at)
        end = length if end < 0 else end
        m = _TOKEN.match(source, end)
        if not m and end < length:
            end += 1  # a lone < is text
        if end > at and not dropping:
            parts.append(source[at:end])
            in_links += (end - at) * (linked > 0)
        at = m.end() if m else end
        if not m:
            continue
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        raw = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if tag in BLOCKS:
                flush()
            if stack and stack[-1][0] == tag:
                pop()
            elif opened.get(tag):
                if tag not in BLOCKS:
                    above = [t for t, _, _ in stack]
                    if any(t in BLOCKS for t in above[len(above) - above[::-1].index(tag) :]):
                        continue  # an inline end tag doesn't close blocks
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW and not raw.rstrip().endswith("/"):
            closing = _CLOSING[tag].search(source, at)
            if closing or tag in ("script", "style", "title", "textarea"):
                at = closing.end() if closing else length
                continue
            if tag == "head":
                continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] not in BLOCKS and opened.get("p"):
                # formatting that was left open ends with its paragraph
                while stack and stack[-1][0] not in BLOCKS:
                    pop()
            if stack and stack[-1][0] == "p":
                pop()
        if tag in CLOSED_BY:
            closes, until = CLOSED_BY[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] in closes:
                    while len(stack) > i:
                        pop()
                    break
        if tag in VOID or raw.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        shown, drops = _attributes(tag, raw) if raw.strip() else ("", False)
        drops = drops and tag not in ("html", "body", "main") or tag in DROPPED and not (tag == "form" and frames(at)) or tag == "header" and not any(p.startswith(("article", "main")) for p in path)
        contains = tag in CONTAINERS
        stack.append((tag, contains, drops))
        opened[tag] = opened.get(tag, 0) + 1
        if contains:
            path.append(f"{tag}.{shown}" if shown else tag)
        dropping += drops
        linked += tag == "a"
    flush()
    return found


def container_scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[tuple[str, ...], float]:
    """Score of each container path: the plain text below it, where each step down to the text halves what it gives.

    Text in links counts against a container. A block gives its characters, and a little for each full stop and comma, to its own
    container and half as much to the one around it, and so on, so the innermost container that holds most of the text wins.
    """
    scores: dict[tuple[str, ...], float] = {}
    for path, text, links in found:
        gain = len(text) - 2.0 * min(links, len(text)) + 10 * (text.count(".") + text.count(","))
        for up in range(len(path)):
            own = path[: len(path) - up]
            scores[own] = scores.get(own, 0.0) + gain * 0.5**up
    for path in scores:
        last = path[-1].split(".")[0]
        scores[path] *= {"article": 1.5, "main": 1.25, "body": 0.75, "page": 0.75}.get(last, 1.0)
    return scores


def best_container(found: list[tuple[tuple[str, ...], str, int]]) -> tuple[tuple[str, ...], float] | None:
    """Path and score of the container that holds the article: the best-scored one, or what encloses it and belongs to it.

    The outermost article, or else main, around the best container is the whole article. Where there is neither, a container
    around it is taken as long as what it adds is less than half as much text and has few links; the body only for what
    stands in it directly.
    """
    scores = container_scores(found)
    if not scores:
        return None
    path, score = max(scores.items(), key=lambda x: (x[1], -len(x[0]), x[0]))
    for tag in ("article", "main"):
        for n in range(1, len(path) + 1):
            if path[n - 1].split(".")[0] == tag:
                return path[:n], score
    sizes = [(own, len(text), min(links, len(text))) for own, text, links in found]
    held = sum(n for own, n, _ in sizes if own[: len(path)] == path)
    for n in range(len(path) - 1, 0, -1):
        more = [x for x in sizes if x[0][:n] == path[:n] and x[0][: len(path)] != path]
        added, links = sum(x[1] for x in more), sum(x[2] for x in more)
        if not more:
            continue
        if 2 * added > held or 3 * links > added or path[n - 1].split(".")[0] in ("body", "page") and any(x[0] != path[:n] for x in more):
            break
        path, held = path[:n], held + added
    return path, score


def text_below(found: list[tuple[tuple[str, ...], str, int]], path: tuple[str, ...]) -> str:
    """The blocks below a path, joined by line feeds."""
    return "\n".join(text for own, text, _ in found if own[: len(path)] == path)


def page_text(source: str | None, consensus: list[str] | None) -> str:
    """Text of a page below its host's path if it has such a container, else below its own best one."""
    found = blocks(source or "")
    if consensus is not None and any(own[: len(consensus)] == tuple(consensus) for own, _, _ in found):
        return text_below(found, tuple(consensus))
    best = best_container(found)
    return text_below(found, best[0]) if best else ""


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and www; the empty string if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return host


def votes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, path, score) of each page with any text: the path of its best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best = best_container(blocks(source.as_py() or ""))
                if best:
                    hosts.append(host)
                    paths.append(list(best[0]))
                    scores.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return pages.select("_host", html_col).mapInArrow(run, "host string, path array<string>, score double")


def winning_paths(voted: DataFrame, least_support: float = LEAST_SUPPORT) -> DataFrame:
    """(host, path): each host's path with most votes, weighed by the logarithm of the score, where enough of its pages support it."""
    by_path = voted.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum(F.log1p(F.greatest("score", F.lit(0.0)))), 3).alias("weight"))
    best = by_path.groupBy("host").agg(F.max(F.struct("weight", "n", "path")).alias("best"), F.sum("n").alias("pages"))
    return best.filter(F.col("best.n") >= least_support * F.col("pages")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add text and n_chars (long) to pages, without their html.

    Every page names the path of its best-scored container; a host's pages vote in two aggregations (a host with very many
    pages meets in partial sums; its pages are read where they are, or are dealt to many tasks); then each page is read again below its host's winning
    path, or below its own best container where it has no such path. Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms, reader
    comments and markup go; character references are decoded; white space inside a block is one space; blocks stand in page order,
    one a line. Null html, and a page of no text, give the empty string; pages without a host form one host. Whole pages
    are read, of any length; repeated rows each get their row; other columns pass through (text and n_chars are replaced).
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = F.col(html_col).cast("string")
    hosted = pages.select(whole(pages, keep).alias("_row"), host_of(F.col(url_col)).alias("_host"), F.xxhash64(row_hash(pages, keep), F.octet_length(source)).alias("_spread"), source.alias("_html"))
    winners = staged(winning_paths(votes(hosted, "_html")).select(F.col("host").alias("_host"), F.col("path").alias("_path")), "winners")
    size = winners.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_host") + F.length(F.array_join("_path", " "))), F.lit(0)).alias("chars")).first()
    if size["n"] <= FEW_HOSTS and size["chars"] <= FEW_CHARS:
        joined = hosted.join(F.broadcast(winners), "_host", "left").select("_row", "_path", "_html")
    else:
        joined = salted_join(hosted, winners, "_host", F.col("_spread")).select("_row", "_path", "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(source.as_py(), path) for path, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *more], names=[*keep, "text", "n_chars"])

    return joined.mapInArrow(run, f"{ddl(pages, keep)}, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
