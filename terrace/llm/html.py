"""Main text of web pages by consensus host paths.

Each page is scanned into blocks of text with the path of open elements above them. A path is generalised to tag and class
without digits. Pass 1 scores a page's containers: text outside links counts for the element around a block and half for
the one above it. Spark sums the scores by host and path, and the path with the most wins (ties: the smallest path).
Pass 2 extracts each page again from the elements with its host's path; a page without them uses its own best container.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count as text.

Block elements and line breaks end a block; character references are decoded; white space inside a block becomes one
space; blocks are joined by a line feed in page order. Broken markup (unclosed or stray tags) is taken as browsers do:
an end tag closes what is open inside its element, one without an element is skipped, and a tag that the page's end cuts
off is no text. Pages are read in one pass, in time that grows with their length whatever they hold.

The winning paths are broadcast when they are known to be small (``broadcast_rows``), else joined by host in salted parts.
Nulls: a null html or url is empty; rows with null ids are pages as others; nothing extracted is an empty text.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE_NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=)?\s*")
BARE = re.compile(r"[^\s>]*")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER_TAGS = set("nav header footer aside form button select option input label head dialog menu noscript template svg".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
# Words of class, id and role attributes that mark what isn't the article.
BOILER_WORDS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription comment comments respond reply replies disqus login signup form toolbar pagination pager copyright".split())
# Words that mark it on containers only: a paragraph may be named after what it speaks of.
WEAK_WORDS = set("share sharing social related recommended search widget".split())
CONTAINERS = set("div section ul ol table".split())
#: Elements below so many count for the one above them, as browsers have it.
DEEPEST = 512
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


def _element(tag: str, attributes: dict[str, str]) -> tuple[str, bool]:
    """Generalised name, and whether the element isn't part of an article."""
    boiler, name = tag in BOILER_TAGS, tag
    for key in ("class", "id", "role"):
        value = attributes.get(key, "").lower()
        if value and tag not in ("html", "body", "article", "main"):
            words = set(WORDS.findall(value))
            boiler |= bool(words & BOILER_WORDS) or tag in CONTAINERS and bool(words & WEAK_WORDS)
        if key == "class" and value:
            name += "." + ".".join(sorted(re.sub(r"\d+", "", c) for c in value.split()))
    return name, boiler


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag whose name ends at ``at``, whether a slash ends it, and the place behind it (the page's end if it
    isn't closed). A quote counts only after an equals sign, so each character is passed a fixed number of times: a quote
    that nothing closes is the last one of its kind in the page."""
    out: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = ATTRIBUTE_NAME.match(page, at)
        at, name = m.end(), m[1]
        if at < n and page[at] == ">":
            if name:
                out.setdefault(name.lower(), "")
            return out, page[at - 1] == "/", at + 1
        if name and at < n and page[at] == "=":
            at += 1
            while at < n and page[at].isspace():
                at += 1
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote and quote in "\"'" else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
            out.setdefault(name.lower(), value)
        elif name:
            out.setdefault(name.lower(), "")
    return out, False, n


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, text or tag, attributes, slash): kinds are text, start and end. Comments, declarations and what scripts,
    styles and the like hold give nothing."""
    at = shown = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        name = NAME.match(page, at + (2 if after == "/" else 1)) if after else None
        if not name and after not in ("!", "?"):
            at += 1
            continue
        if at > shown:
            yield "text", page[shown:at], {}, False
        if not name:
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 4) if comment else page.find(">", at)
            at = shown = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        tag = name[0].lower()
        attributes, slash, at = _tag(page, name.end())
        if after != "/" and tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
        else:
            yield "end" if after == "/" else "start", tag, attributes, slash
        shown = at
    if shown < len(page):
        yield "text", page[shown:], {}, False


def blocks(page: str) -> list[tuple[tuple[str, ...], tuple[int, ...], str, int]]:
    """A page's blocks outside boilerplate: path of element names, their numbers in the page, text, characters in links."""
    stack: list[tuple[str, str, bool, int]] = []  # tag, name, boiler, number
    places: dict[str, list[int]] = defaultdict(list)  # of each tag in the stack
    out, parts, count, links, boilers = [], [], 0, 0, 0
    at: tuple | None = None  # path and numbers of the open block elements, while the stack stays as it is

    def innermost(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def flush() -> None:
        nonlocal links, at
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                if at is None:
                    held = [(n, i) for t, n, _, i in stack if t in BLOCK]
                    at = tuple(n for n, _ in held), tuple(i for _, i in held)
                out.append((*at, text, min(links, len(text))))
        links = 0

    def text(s: str) -> None:
        nonlocal links
        if s and not boilers:
            parts.append(s)
            if places["a"]:
                links += len(s)

    def close(down_to: int) -> None:
        nonlocal boilers, at
        while len(stack) > down_to:
            tag, _, boiler, _ = stack[-1]
            if tag in BLOCK:
                flush()
            boilers -= boiler
            places[tag].pop()
            stack.pop()
            at = None

    for kind, tag, attributes, slash in tokens(page):
        if kind == "text":
            text(tag)
            continue
        if kind == "end":
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and places["p"]:
            close(places["p"][-1])
        for same, within in (("li", ("ul", "ol")), ("td", ("tr", "table")), ("tr", ("table",)), ("dd", ("dl",)), ("dt", ("dl",))):
            if tag == same and innermost(same) > innermost(*within):
                close(innermost(same))
        if (not slash or tag in BLOCK) and len(stack) < DEEPEST:
            name, boiler = _element(tag, attributes)
            boilers += boiler
            count += 1
            places[tag].append(len(stack))
            stack.append((tag, name, boiler, count))
            at = None
    close(0)
    flush()
    return out


LEAF = re.compile(r"(p|h[1-6]|li|pre|blockquote)(\.|$)")
WHOLE = re.compile(r"(article|main)(\.|$)")


def scores(found: list) -> dict[str, float]:
    """Text weight by container path: whole for the element around a paragraph, half for the one above it. A block in a
    paragraph or heading counts for the element that holds that. The best container's nearest ancestor that is an article or
    holds text of its own, so that the container is a part of it, takes over its weight and what it holds itself; body and
    html are no such ancestors."""
    out: dict[tuple[str, ...], float] = defaultdict(float)
    own: dict[tuple[str, ...], float] = defaultdict(float)
    for path, _, text, linked in found:
        path = path[:-1] if path and LEAF.match(path[-1]) else path
        weight = len(text) - linked
        own[path] += weight
        for share in (1.0, 0.5):
            if path:
                out[path] += share * weight
                path = path[:-1]
    best = min(out, key=lambda p: (-out[p], p)) if out else ()
    for up in range(len(best) - 1, 0, -1):
        above = best[:up]
        if re.match(r"(body|html)(\.|$)", above[-1]):
            break
        if own.get(above, 0) > 0 or WHOLE.match(above[-1]):
            best, out[above] = above, out[best] + own.get(above, 0.0) + 1
    return {">".join(p): s for p, s in out.items()}


def main_text(found: list, path: str | None) -> str:
    """The text below the elements of a path, else of the page's best container."""
    if path is None or not any(">".join(p[: path.count(">") + 1]) == path for p, *_ in found):
        own = scores(found)
        if not own:
            return "\n".join(t for _, _, t, _ in found)
        path = min(own, key=lambda p: (-own[p], p))
    depth = path.count(">") + 1
    return "\n".join(t for p, _, t, _ in found if ">".join(p[:depth]) == path)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums: dict[tuple[str, str], float] = defaultdict(float)
        for host, page in zip(batch["host"], batch["html"], strict=True):
            for path, s in scores(blocks(page)).items():
                sums[host, path] += s
        yield pd.DataFrame([(h, p, s) for (h, p), s in sums.items()], columns=["host", "path", "score"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(blocks(page), path if isinstance(path, str) else None) for page, path in zip(batch["html"], batch["path"], strict=True)]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: each host's winning container. pages: host, html."""
    votes = pages.select("host", "html").mapInPandas(_votes, "host string, path string, score double").groupBy("host", "path").agg(F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("x")).select("host", F.col("x.path").alias("path"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_rows: int = 20_000, salts: int = 32) -> DataFrame:
    """page_id, url, text: one row for each row of pages."""
    address = F.coalesce(url, F.lit(""))
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)).alias("host"), F.coalesce(html, F.lit("")).alias("html"))
    winners = host_paths(p)
    few = winners.limit(broadcast_rows + 1).collect()
    if len(few) <= broadcast_rows:
        small = p.sparkSession.createDataFrame([(r.host, r.path) for r in few], "host string, path string")
        joined = p.join(F.broadcast(small), "host", "left")
    else:
        spread = winners.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInPandas(_texts, "page_id long, url string, text string")
