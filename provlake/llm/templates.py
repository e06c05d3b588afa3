"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A page's tokens are its element paths and its text blocks under their path.  Tokens of one host that
occur the same number of times on each page form an equivalence class; a class is valid if enough pages
hold it and more than one token shares its vector (or every page holds it).  An element's path contains those of
its ancestors, which occur wherever it does, so paths nest the valid classes into the template; text blocks that belong to
it are the template's text.  What remains are slots, and a page's main text is what stands in the slots of its
article, or of the whole body where nothing is marked as the article.  A page whose text is all template has no slot to
tell from the rest (copies of one page, say), so its text stays.

Occurrence vectors are never gathered: each is folded to a 64-bit signature, by xor of a hash of page and
count, which partial aggregation handles for a host of any size.  Pages are parsed once for tokens and once for text.

Parts that a page itself marks as menus, headers, footers, sidebars, notices, adverts, forms or comments (by element, role,
class or id) are no slots.  Inside an article, template text is dropped only if every page of a host of at least 5 pages
has it exactly alike, and never all text of a page: a passage that many articles quote is text.

Edge cases: null and empty html give an empty text; a null or odd url belongs to the host ""; a host with one page has
no template; markup may be unclosed or nested wrongly; repeated rows are pages of their own, other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import arrow_batch, arrow_schema, saved, ship_package

LEAST_PAGES = 3  # pages that a valid class stands on, at least; both pages of a host of two
LEAST_SHARE = 0.5  # share of the host's pages that a valid class stands on, at least
SURE_PAGES = 5  # pages of a host from which template text is also dropped inside articles
LINK_SHARE = 0.6  # a block with more link text than this, outside an article, is navigation

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
                 re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video textarea select".split())
BLOCKS = frozenset("html body head p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
                   "figure figcaption header footer nav aside form fieldset address details summary dialog menu button label title center hgroup search".split())
NO_CONTENT = frozenset("head nav footer aside form fieldset dialog menu button label title search".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ALONE = frozenset("li dt dd td th tr".split())
# words of class and id names that mark parts beside the article
BESIDE = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
                   "notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside rail menu nav navbar navigation breadcrumb "
                   "breadcrumbs footer header masthead topbar toolbar comment comments reply replies respond discussion disqus share sharing social related "
                   "recommended recommendations widget widgets pagination pager search login skip hidden copyright".split())
# words that say nothing of their own in such a name
PLACE = frozenset("area bar block bottom box button buttons container content footer group header icon icons inner item items left link links list outer "
                  "page panel primary right secondary section site top wrap wrapper".split())
CONTENT = frozenset("article main content post entry story articlebody".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(maxsize=20_000)
def element(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Path component of a start tag; whether it is beside the article by what it is, or by its names; whether it holds the article, and surely so.

    A name counts if all its words mark such a part: ``sidebar-box`` does, ``has-sidebar`` and ``social-history`` do not.
    """
    got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = [{p.lower() for p in NAME_PART.findall(n)} for n in f"{got.get('class', '')} {got.get('id', '')}".split()]
    role = got.get("role", "").lower()
    surely = name in ("article", "main") or role in ("main", "article") or "articlebody" in got.get("itemprop", "").lower()
    style = got.get("style", "").replace(" ", "").lower()
    beside = name in NO_CONTENT or role in NO_CONTENT_ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in style
    named = not surely and name not in ("html", "body") and any(n & BESIDE and n <= BESIDE | PLACE for n in names)
    holds = surely or not beside and not named and name in ("div", "section", "td") and any(n & CONTENT for n in names)
    return f"{name}.{'.'.join(sorted(got.get('class', '').split()))}", beside, named, holds, surely


def blocks(page: str | None):
    """(path hash, text, share of link text, beside, in_article) of every text block, and hashes of all element paths.

    ``beside`` is 0 for content, 1 for an article whose surroundings alone have such names, 2 and 3 for what is beside it.
    """
    from xxhash import xxh64_intdigest

    page = page or ""
    stack = [("", 1, 0, False)]
    found, paths, buffer, linked, in_link, at = [], [], [], 0, False, 0

    def flush():
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                _, path, beside, holds = stack[-1]
                found.append((path, text, linked / max(len(raw), 1), beside, holds))
            buffer.clear()
        linked = 0

    skip_to = 0
    for m in TAG.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            buffer.append(page[at:m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = m[1] or m[4]
        if name in SILENT and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = skip_to = end.end() if end else len(page)
        elif name == "a":
            in_link = not closing
        elif name == "br":
            buffer.append(" ")
        elif name == "hr":
            flush()
        elif name in BLOCKS:
            flush()
            in_link = False
            if closing:
                if any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
                continue
            if name == "body":
                while len(stack) > 1 and stack[-1][0] != "html":
                    stack.pop()
            if stack[-1][0] == "p":
                stack.pop()
            if name in ALONE and stack[-1][0] == name:
                stack.pop()
            _, parent, beside, holds = stack[-1]
            part, own_beside, named, own_holds, surely = element(name, m[3] if m[2] else m[6])
            if name == "header" and not holds:  # a page's header; an article's own header holds its heading
                own_beside = True
            if own_beside or named and holds:
                beside = 2
            elif named:
                beside = beside if beside == 2 else 3  # by name alone: an article may be inside
            elif surely and not holds and beside == 3:
                beside = 1
            path = xxh64_intdigest(part, parent & 0xFFFFFFFF)
            paths.append(path)
            stack.append((name, path, beside, holds or own_holds))
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return found, paths


def text_token(path: int, text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFF)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(host, page, token, n)``: how often each token occurs on each page."""
    from collections import Counter

    ship_package(pages.sparkSession)
    arrow = arrow_schema("host string, page long, token long, n int")

    def tokens(batches):
        for b in batches:
            out = []
            for host, page, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found, paths = blocks(source)
                seen = Counter(paths)
                seen.update(text_token(f[0], f[1]) for f in found)
                out += [(host, page, signed(t), n) for t, n in seen.items()]
            yield arrow_batch(out, arrow)

    return (pages.select(host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("page"), F.col("html").cast("string"))
            .mapInArrow(tokens, "host string, page long, token long, n int"))


def host_templates(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """``(host, template, common)``: tokens of each host's valid classes, and those that every page has alike."""
    sizes = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("all"))
    vectors = (tokens.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("sign"), F.min("n").alias("least"),
                                                   F.max("n").alias("most")).where(F.col("pages") >= 2))
    wide = vectors.join(sizes, "host").where((F.col("pages") >= F.least(F.lit(LEAST_PAGES), F.col("all"))) & (F.col("pages") >= LEAST_SHARE * F.col("all")))
    # at most a few page lengths of tokens stand on half of a host's pages
    classes = wide.groupBy("host", "sign", "pages", "all").agg(F.collect_list("token").alias("members"), F.max("most").alias("most"))
    valid = classes.where((F.size("members") > 1) | (F.col("pages") == F.col("all")))
    everywhere = (F.col("pages") == F.col("all")) & (F.col("all") >= SURE_PAGES) & (F.col("most") == 1)
    return valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("template"),
                                     F.flatten(F.collect_list(F.when(everywhere, F.col("members")))).alias("common"))


def main_text(page: str | None, template: frozenset[int] | set[int], common: set[int]) -> str:
    """The slots of the article, or of the body where there is none, joined by blank lines."""
    found, _ = blocks(page)
    inside = [f for f in found if f[4] and not f[3]] or [f for f in found if f[4] and f[3] == 1]
    if inside:
        kept = [f for f in inside if signed(text_token(f[0], f[1])) not in common] or inside
    else:
        rest = [f for f in found if not f[3]]
        slots = [f for f in rest if signed(text_token(f[0], f[1])) not in template] or rest
        kept = [f for f in slots if f[2] <= LINK_SHARE]
    return "\n\n".join(f[1] for f in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages(page_id, url, html)``."""
    # saved, so that the join below can split a host of any size instead of resting on the aggregate's cut by host
    templates = saved(host_templates(page_tokens(pages), pages), "templates")
    arrow = arrow_schema("page_id long, url string, text string")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))

    def texts(batches):
        for b in batches:
            out = []
            for page_id, url, source, template, common in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append((page_id, url, main_text(source, set(template or ()), set(common or ()))))
            yield arrow_batch(out, arrow)

    return (rows.join(templates, "host", "left").select("page_id", "url", "html", "template", "common")
            .mapInArrow(texts, "page_id long, url string, text string"))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
