"""Main text of web pages by equivalence classes of tokens.

Tokens of a page are its tags (with class, id and role) and its pieces of text. Tokens of a host that
occur equally often on each of its pages form a class; classes that occur on enough pages (text inside
articles: on all) and nest are the host's template. What the template leaves open are slots: those
that stand in menus, notices, forms and the like are dropped, the others are the page's text. Pages of
hosts without a template have only tag and class names to go by: what their articles hold, or else all."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from flowlab.llm.frames import stored

# A class must occur on this many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.5
# Template rows (one per token of a host) up to which templates are broadcast.
BROADCAST_ROWS = 100_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    r".*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[^a-z]+")

INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strong "
             "sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Elements that hold no article text, and words of class, id or role that say so of any element.
ASIDE = set("nav footer aside header form head menu dialog button select option label fieldset object canvas audio "
            "video".split())
ASIDE_WORDS = set("nav navbar navigation menu footer header sidebar aside ad ads advert adverts advertisement advertising "
                  "banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices newsletter "
                  "subscribe subscription signup comment comments disqus reply replies related recommended share sharing "
                  "social breadcrumb breadcrumbs popup modal overlay login search widget pagination pager toolbar "
                  "complementary contentinfo".split())
MAIN = {"article", "main"}
# Elements that hold no article text unless they stand around all articles of the page.
AROUND = {"form", "fieldset"}


def pieces(page):
    """The page as ("open", tag, words, name), ("close", tag) and ("text", raw) in order."""
    at = 0
    for found in MARKUP.finditer(page):
        if found.start() > at:
            yield "text", page[at: found.start()], None, None
        at = found.end()
        tag = found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(2):
            yield "close", tag, None, None
            continue
        marks = sorted({w for m in ATTRIBUTE.finditer(found.group(4))
                        for w in (m.group(2) or m.group(3) or m.group(4) or "").lower().split()})
        words = {w for m in marks for w in NAME_PART.split(m) if w}
        yield "open", tag, words, ".".join([tag, *marks])
    if at < len(page):
        yield "text", page[at:], None, None


def tidy(raw):
    return " ".join(entities.unescape(raw).split())


def token(name):
    """Tokens are known by a 64-bit hash."""
    return xxhash.xxh64_intdigest(name) - (1 << 63)


class Walk:
    """Goes through a page and keeps track of what is open."""

    def __init__(self, page):
        self.pieces = list(pieces(page))
        self.around = frozenset()
        # elements around all outermost articles: their names say nothing about the articles
        around = None
        for kind, value, _ in self:
            if kind == "open" and value in MAIN and sum(x[2] for x in self.open) == 1:
                here = {x[3] for x in self.open}
                around = here if around is None else around & here
        self.around = frozenset(around or ())

    def __iter__(self):
        self.open = []  # (tag, is it aside, is it main, place)
        for place, (kind, value, words, name) in enumerate(self.pieces):
            if kind == "open":
                if value == "p" or value in ("li", "td", "th", "tr", "option", "dt", "dd"):
                    self._close(value, limit=MAIN | {"div", "section", "ul", "ol", "table", "td", "nav", "aside"} - {value})
                if value not in VOID:
                    self.open.append((value, self._is_aside(value, words, place), value in MAIN, place))
            elif kind == "close":
                self._close(value)
            yield kind, value, name

    def _is_aside(self, tag, words, place):
        if tag in ASIDE and tag not in AROUND:
            return True
        if place in self.around or tag in ("html", "body") or tag in MAIN and not self.main:
            return False
        return tag in AROUND or bool(words & ASIDE_WORDS)

    def _close(self, tag, limit=()):
        """Close an element and what was left open inside it; an end without a start is ignored."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in limit:
                return

    @property
    def aside(self):
        return any(x[1] for x in self.open)

    @property
    def main(self):
        return any(x[2] for x in self.open)


# Text of an article is another token than the same text elsewhere.
INNER = "\0"


def tokens_of(page):
    """Occurrences, first and last place of each tag and each text, and whether it is text of an article."""
    counts, walk = {}, Walk(page)
    for place, (kind, value, name) in enumerate(walk):
        if kind == "open":
            key = token("<" + name)
        elif kind == "close":
            key = token("</" + value)
        elif text := tidy(value):
            key = token(INNER + text if walk.main else text)
        else:
            continue
        n, first, _, inner = counts.get(key, (0, place, place, kind == "text" and walk.main))
        counts[key] = n + 1, first, place, inner
    return counts


def blocks_of(page, template=frozenset()):
    """Blocks of text in the page's open slots: all text that the host's template doesn't repeat and no
    name puts aside. Without a template a page with an article keeps what that holds. An article that
    all pages of its host repeat is kept if nothing else is open."""
    blocks, current = [], []
    walk, where = Walk(page), False

    def end():
        whole = tidy("".join(x for x, _ in current))
        open_ = tidy("".join(x for x, known in current if not known))
        if whole:
            blocks.append((where, whole, "" if token(INNER + whole if where else whole) in template else open_))
        current.clear()

    for kind, value, _ in walk:
        if kind != "text":
            if value == "br":
                current.append((" ", False))
            elif value not in INLINE:
                end()
        elif not walk.aside:
            if current and where != walk.main:
                end()
            where = walk.main
            # the template's tokens are pieces of text; blanks beside them stay
            text = tidy(value)
            known = bool(text) and where and token(INNER + text) in template
            current.append((value, known))
    end()
    inside = [whole for main, whole, _ in blocks if main]
    if not template and inside:
        return inside
    return [left for _, _, left in blocks if left] or inside


def nested(rows):
    """The tokens of the classes that nest: by place, two classes stand apart, or one within the
    other. Of two that overlap otherwise, the one on fewer pages goes."""
    spans = {}
    for r in rows:
        low, high, n = spans.get(r["class"], (r["place"], r["last"], r["pages"]))
        spans[r["class"]] = min(low, r["place"]), max(high, r["last"]), n
    kept = []
    for key, (low, high, n) in sorted(spans.items(), key=lambda x: (-x[1][2], x[1][0], -x[1][1], x[0])):
        if all(high < a or low > b or (a <= low and high <= b) or (low <= a and b <= high) for _, a, b in kept):
            kept.append((key, low, high))
    names = {k for k, _, _ in kept}
    return frozenset(r["token"] for r in rows if r["class"] in names)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def templates(pages):
    """One row per host with a template: host, and its tokens with class, place and pages.

    Occurrence vectors are compared by a sum of hashes of page and count, which adds up before
    anything is shuffled; a host's row has only tokens of at least half of its pages (text inside articles: of all)."""
    def work(batches):
        for batch in batches:
            rows = []
            for host, key, page in zip(*(batch.column(n).to_pylist() for n in ("host", "page", "html"))):
                rows += [(host, t, xxhash.xxh64_intdigest(f"{key} {n}") >> 1, first, last, inner)
                         for t, (n, first, last, inner) in tokens_of(page or "").items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4, pa.bool_()))],
                    names=["host", "token", "vector", "place", "last", "inner"])

    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page"), "html")
    found = keyed.mapInArrow(work, "host string, token long, vector long, place long, last long, inner boolean")
    # exclusive-or of hashes identifies a vector: equal vectors give equal values
    tokens = found.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor("vector").alias("vector"), F.avg("place").alias("place"),
        F.avg("last").alias("last"), F.max("inner").alias("inner"))
    hosts = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    frequent = (tokens.where(F.col("pages") >= MIN_PAGES).join(hosts, "host")
                .where(F.col("pages") >= F.col("_all") * F.when(F.col("inner"), 1.0).otherwise(MIN_SHARE)))
    member = F.struct("token", F.xxhash64("vector", "pages").alias("class"), "place", "last", "pages")
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list(member)).alias("template"))


def main_text(pages):
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Blocks are joined by line ends; white space inside a block is one blank and character
    references are decoded. Null or empty html gives an empty text, a null url an empty host,
    repeated rows stay, and other columns are ignored."""
    found = stored(templates(pages), "templates")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    size = found.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_ROWS else found, "host", "left")

    def work(batches):
        known = {}
        for batch in batches:
            texts = []
            hosts = batch.column("host").to_pylist()
            for k, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist())):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = nested(batch.column("template")[k].as_py() or [])
                texts.append("\n".join(blocks_of(page or "", known[host])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "template").mapInArrow(
        work, "page_id long, url string, text string, n_chars long")
