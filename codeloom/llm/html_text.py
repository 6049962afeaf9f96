"""Operator 7: main text of web pages by consensus paths of their hosts.

Each page scores its containers by the text that lies in them outside links.
The best container, widened by article text around it, gives the page's vote:
its path, tags and classes with digits generalised. Spark sums the votes by host; the winning path is then extracted
from every page of the host. A page without it falls back to its own best.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I | re.S)
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
#: Elements whose content isn't markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Those of RAW that hide the rest of the page if nothing ends them; of others only the start tag is skipped then.
HIDING = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head fieldset label audio video canvas map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu header masthead footer foot sidebar aside "
    "comment comments commentlist disqus replies reply respond notice notices alert cookie cookies consent gdpr popup modal overlay share sharing social breadcrumb breadcrumbs "
    "pagination pager related recommended newsletter subscribe subscription signup login form widget toolbar toc skip copyright".split()
)
#: An open element of the key ends when one of these begins.
ENDS = {"p": frozenset("p div article section main header footer nav aside ul ol dl table form h1 h2 h3 h4 h5 h6 blockquote pre hr address figure fieldset".split()), "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset(["tr"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "option": frozenset("option optgroup".split())}
ROOT = "#root"
#: A named wrapper with at least this share of the page's text outside links is not boilerplate.
MOST = 0.5
#: Text around the best container belongs to the article if at most this share of it lies in links.
LINKED = 0.25
WORDS = re.compile(r"[a-z]+")


class _Open:
    """An open element."""

    __slots__ = ("tag", "path", "container", "dropped", "link", "named")

    def __init__(self, tag, path, container, dropped, link, named):
        self.tag, self.path, self.container, self.dropped, self.link, self.named = tag, path, container, dropped, link, named


def solid(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def step(path: str, name: str) -> str:
    """The path of a container inside another: its own name and a digest of all names, so deep paths stay short."""
    return f"{name}@{hashlib.blake2b(f'{path}>{name}'.encode('utf-8', 'surrogatepass'), digest_size=9).hexdigest()}"


def pieces(page: str) -> Iterator[tuple[str | None, int, int, bool | None]]:
    """walk() without the elements that class or id names boilerplate.

    Those that hold most of the page's text outside links stay, unless the page
    has an article or main element and they share no text with it.
    """
    wrappers: list[int] = [0]
    own: dict[int, int] = {}
    in_article: dict[int, bool] = {0: False}
    with_article: set[int] = set()
    total, any_article = 0, False
    for text, number, parent, link, named in walk(page, frozenset(), wrappers):
        if link is None:
            in_article[number] = in_article.get(parent, False) or text.split("@")[0].split(".")[0] in ("article", "main")
        elif text is not None and link is False and (n := solid(text)):
            total += n
            if in_article[number]:
                any_article = True
                with_article.add(named)
            own[named] = own.get(named, 0) + n
    for k in range(len(wrappers) - 1, 0, -1):  # what lies in a wrapper lies in the one around it
        own[wrappers[k]] = own.get(wrappers[k], 0) + own.get(k, 0)
        if k in with_article:
            with_article.add(wrappers[k])
    kept = frozenset(k for k, n in own.items() if k and n >= MOST * total and (k in with_article or not any_article))
    for text, number, parent, link, named in walk(page, kept, [0]):
        if not named:
            yield text, number, parent, link


def walk(page: str, kept: frozenset[int], wrappers: list[int]) -> Iterator[tuple[str | None, int, int, bool | None, int]]:
    """The page's text in order: (text, container number, the container around that, in a link, named); text None ends a block.

    Containers are announced first as (path, number, the container around, None, named).
    Dropped elements yield nothing. named: the innermost element around, numbered in page
    order, whose class or id names boilerplate and that isn't in kept, or 0;
    wrappers gets, for each such element, the one around it. Elements hold no
    more than their place, so deep nesting costs no more than long pages.
    """
    yield ROOT, 0, -1, None, 0
    stack = [_Open(ROOT, ROOT, 0, False, False, 0)]
    n, at, end = 0, 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        top = stack[-1]
        upto = m.start() if m else end
        if upto > at and not top.dropped:
            yield html.unescape(page[at:upto]), top.container, -1, top.link, top.named
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if not inline and not top.dropped:
            yield None, top.container, -1, False, top.named
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if inline and stack[i].tag in CONTAINERS:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if tag == "svg" and m[3].endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end if tag in HIDING else at
            continue
        if not inline:
            for i in range(len(stack) - 1, 0, -1):
                if tag in ENDS.get(stack[i].tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINERS or stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
            top = stack[-1]
        if m[3].endswith("/") and tag in ("path", "br", "math"):
            continue
        dropped = top.dropped or tag in DROPPED or (tag == "header" and not any(o.tag in ("article", "main") for o in stack))
        names: list[str] = []
        boilerplate = False
        if m[3] and not dropped and not inline:
            for name, *values in ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), next((v for v in values if v), "").lower()
                if name == "class":
                    names = value.split()
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROPPED_ROLES:
                    dropped = True
                elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and any((w := WORDS.findall(x)) and DROPPED_WORDS.issuperset(w) for x in value.split()):
                    boilerplate = True
        named = top.named
        if boilerplate and not dropped:
            wrappers.append(named)
            if len(wrappers) - 1 not in kept:
                named = len(wrappers) - 1
        path, container = top.path, top.container
        if tag in CONTAINERS and not dropped:
            n += 1
            path = step(path, ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", x) for x in names})]))
            container = n
            yield path, n, top.container, None, named
        stack.append(_Open(tag, path, container, dropped, top.link or tag == "a", named))


def vote(page: str) -> tuple[str, float]:
    """Path of the page's main text, and the score of its best container; the first of equals.

    Text counts whole for its container and half for the next one around;
    text in links counts against both. From the best container the path climbs
    to the outermost one around it that adds text, while what each adds is
    mostly outside links.
    """
    paths: dict[int, str] = {}
    score: dict[int, float] = {}
    around: dict[int, int] = {}
    plain: dict[int, int] = {}
    linked: dict[int, int] = {}
    for text, number, parent, link in pieces(page):
        if link is None:
            paths[number], score[number], around[number] = text, 0.0, parent
            plain[number] = linked[number] = 0
        elif text is not None:
            n = solid(text)
            (linked if link else plain)[number] += n
            n = -n if link else n
            score[number] += n
            if around[number] >= 0:
                score[around[number]] += n / 2
    best = top = inner = max(score, key=lambda k: (score[k], -k))
    for k in sorted(around, reverse=True):  # a container's text lies in the one around it too
        if around[k] >= 0:
            plain[around[k]] += plain[k]
            linked[around[k]] += linked[k]
    k = around[best]
    while k >= 0:
        more, links = (side[k] - side[inner] for side in (plain, linked))
        if links > LINKED * (more + links):
            break
        if more:
            top = k
        inner, k = k, around[k]
    return paths[top], max(score[best], 0.0)


def extract(page: str, path: str) -> str:
    """The text in the containers of that path, blocks in page order; of the page's own best, where it has none.

    Character references are decoded a run of text at a time, so markup inside
    what looks like one keeps it apart.
    """
    for _ in range(2):
        inside: set[int] = set()
        found: list[str] = []
        for text, number, parent, link in pieces(page):
            if link is None:
                if text == path or parent in inside:
                    inside.add(number)
            elif number in inside:
                found.append(" " if text is None else text)
        if inside:
            return " ".join("".join(found).split())
        path = vote(page)[0]
    return ""


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html).

    Null html is empty; pages without a container's text have the text "".
    Pages whose url is null or has no host vote together. Rows stay as they
    are, repeated ones too; further columns are left out. Ties between paths
    of a host go to the one that sorts first.
    """
    rows = common.only(pages, "page_id", "url", "html").withColumn("_host", host_of())

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "html"):
                found = [vote(x.as_py() or "") for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["host", "path", "score"])

    ballots = rows.select("_host", "html").mapInArrow(votes, "host string, path string, score double")
    sums = ballots.groupBy("host", "path").agg(F.sum("score").alias("score"))
    winners = sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"))
    winners = common.stored(winners, "host-paths")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "html"):
                found = [extract(x.as_py() or "", p.as_py() or ROOT) for x, p in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    both = rows.join(winners, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "path")
    kind = dict(rows.dtypes)["page_id"]
    return both.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
