"""Main text of web pages.

Each page is parsed once, in time linear in its length, and written with its token streams. Subtrees that cannot be main text by their
element, role, class or id are left out (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments,
hidden parts). Where a page marks its main text as article or main, the blocks inside are the text.

The streams of a host's pages make up its suffix array: of marked pages what stands beside the main text, of the others all that they
show. Suffixes are named to a depth of `depth` tokens by prefix doubling; suffixes with the same name are an interval of the array whose
longest common prefix is at least that, so intervals with pages of different bodies are the long substrings that the host repeats. Tokens
that such substrings cover are boilerplate and removed from the text of unmarked pages; the unique runs stay. A page's body is its main
text, or its longest block where it marks none, so an article that a host prints under several addresses is one body, and no repeat.
Marked main text is not searched for repeats: what two articles share is part of both. Rows are dealt by name, so that a host may hold
any share of all pages.

Text: character references are decoded, white space (of any kind) becomes one space, text is trimmed, and blocks and line breaks
part words. Defined results: null html is empty; pages without main text have an empty text; a null or odd url is a host of its
own name; repeated rows are one page for the counts and all get the result; no rows give none; other columns are ignored; a tag whose
quotes do not close ends at the next >; very long pages are parsed whole.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key

DEPTH = 8

#: A tag from its <; possessive, so that it fails or ends without trying shorter ways.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is text up to their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are never main text.
OUT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "math", "canvas", "object", "audio", "video", "template", "applet", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "img"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status"}
#: Parts of class names and ids, between hyphens, underscores and changes of case.
NAMED = re.compile(r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footer|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations?|comments?|disqus|respond|replies|reply|pagination|pager|widgets?|toolbar|hidden|skip|teaser)$", re.I)
#: Names that say what else is on the page, and those that make even an article something else.
OTHER = re.compile(r"(?:has|no|with|without|is)[-_]", re.I)
NOT_MAIN = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies|teaser|related)$", re.I)
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: Start tags that end an open one of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "blockquote", "td", "th", "li"}


def verdict(tag: str, raw: str, inside: bool) -> str:
    """Whether an element's subtree goes ('out'), only its headings stay ('head'), or it is main text ('main'); else ''."""
    if tag in OUT:
        return "out"
    found = ""
    if raw.strip(" /\t\n\r"):
        for name, *values in ATTRIBUTE.findall(raw):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "role":
                if value.lower() in ROLES:
                    return "out"
                if value.lower() == "main":
                    found = "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "out"
            elif name in ("class", "id") and tag not in ("html", "body"):
                parts = [p for word in value.split() if not OTHER.match(word) for p in PARTS.findall(word)]
                if any((NAMED if tag not in ("article", "main") else NOT_MAIN).match(p) for p in parts):
                    return "out"
                if "header" in map(str.lower, parts):
                    found = "head"
    if tag == "header" or found == "head":
        return "head" if inside else "out"
    return "main" if tag in ("article", "main") else found


class Page:
    """What a page shows: main (in its marked main text), other (whatever cannot be ruled out), side (ruled out, but seen). Blocks are parted by None."""

    def __init__(self, html: str):
        self.main, self.other, self.side = [], [], []
        self.marked = self._parse(html) and bool(self.text(self.main))

    @staticmethod
    def text(parts: list) -> str:
        return " ".join("".join([" " if x is None else x for x in parts]).split())

    @staticmethod
    def longest(parts: list) -> str:
        """The longest block."""
        best = block = ""
        for x in [*parts, None]:
            if x is not None:
                block += x
                continue
            best, block = max(best, " ".join(block.split()), key=len), ""
        return best

    def result(self) -> tuple[str, list[str], str]:
        """(main text of a marked page, the tokens that stand beside it or may be it, the body)."""
        if self.marked:
            text = self.text(self.main)
            return text, self.text([*self.other, None, *self.side]).split(), text
        return "", self.text(self.other).split(), self.longest(self.other)

    def _parse(self, html: str) -> bool:
        """Whether the page marks its main text."""
        main, other, side = self.main, self.other, self.side
        stack: list[tuple[str, str]] = []  # open elements with their verdicts
        places: dict[str, list[int]] = {}  # where in the stack each element is open
        scopes: list[int] = []
        out = mains = heads = headings = 0
        at, n, last, cdata, found = 0, len(html), html.rfind(">"), True, False

        def put(text: str) -> None:
            if out or heads and not headings:
                side.append(text)
            else:
                (main if mains else other).append(text)

        def close(k: int) -> None:
            nonlocal out, mains, heads, headings
            while len(stack) > k:
                tag, v = stack.pop()
                places[tag].pop()
                if tag in SCOPES:
                    scopes.pop()
                out, mains, heads, headings = out - (v == "out"), mains - (v == "main"), heads - (v == "head"), headings - (tag in HEADINGS)

        while at < n:
            start = html.find("<", at)
            if start < 0 or start > last:  # no tag ends any more
                put(unescape(html[at:]))
                break
            if start > at:
                put(unescape(html[at:start]))
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
                continue
            if html[start + 1 : start + 2] in ("!", "?"):
                end = html.find("]]>", start) if cdata and html.startswith("<![CDATA[", start) else -1
                cdata = cdata and (end >= 0 or not html.startswith("<![CDATA[", start))
                at = end + 3 if end >= 0 else html.find(">", start) + 1
                continue
            m = TAG.match(html, start) or NAME.match(html, start)
            if m is None:  # a < of the text
                put("<")
                at = start + 1
                continue
            at, tag = m.end(), m[2].lower()
            if tag not in INLINE:
                for parts in (main, other, side):
                    parts.append(None)
            if m[1]:
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = html.find(">", end.start()) + 1 or n if end else n
                continue
            if tag in VOID or m[3].endswith("/") and tag in ("path", "use"):
                continue
            ends = ENDS.get(tag) or (set() if tag in INLINE else {"p"})
            open_ = max((places[e][-1] for e in ends if places.get(e)), default=-1)
            if open_ >= 0 and (not scopes or open_ >= scopes[-1]):
                close(open_)
            v = verdict(tag, m[3], mains > 0)
            found = found or tag in ("article", "main") or v == "main"
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append((tag, v))
            out, mains, heads, headings = out + (v == "out"), mains + (v == "main"), heads + (v == "head"), headings + (tag in HEADINGS)
        return found


def extract(html: str) -> tuple[bool, str]:
    """(whether the page marks its main text, its text by its own marks alone)."""
    page = Page(html)
    return page.marked, page.text(page.main if page.marked else page.other)


def names(tokens: list[str], depth: int):
    """128-bit names of the `depth` tokens from each place on (depth: a power of two), by doubling."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    out = []
    for seed in (0, 1):
        x = np.fromiter((xxh3_64_intdigest(t.encode("utf-8", "replace"), seed) for t in tokens), np.uint64, len(tokens))
        step = 1
        with np.errstate(over="ignore"):
            while step < depth:
                x = (x[: max(0, len(x) - step)] * np.uint64(0x9E3779B97F4A7C15) + (x[step:] ^ (x[step:] >> np.uint64(31)))) * np.uint64(0xC4CEB9FE1A85EC53)
                step *= 2
        out.append(x.view(np.int64))
    return out


def extract_pages(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def parsed(batches):
        import pyarrow as pa

        kinds = [("text", pa.string()), ("marked", pa.bool_()), ("tokens", pa.list_(pa.string())), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64())), ("body", pa.int64())]
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                page = Page(html or "")
                text, tokens, body = page.result()
                x, y = names([host, *tokens], depth) if len(tokens) >= depth else ([], [])
                # the name of the host is part of all names
                own = xxh3_64_intdigest(host.encode("utf-8", "replace")) >> 1
                rows.append({"text": text, "marked": page.marked, "tokens": None if page.marked else tokens, "x": [int(v) ^ own for v in x[1:]], "y": [int(v) ^ own for v in y[1:]], "body": xxh3_64_intdigest(body.encode("utf-8", "replace")) >> 1})
            found = [pa.array([r[k] for r in rows], kind) for k, kind in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *found], ["key", "page_id", "url", *[k for k, _ in kinds]])

    from xxhash import xxh3_64_intdigest

    key = row_key("page_id", "html")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1), F.lit("")))
    read = pages.select(key.alias("key"), F.col("page_id").cast("long"), "url", host.alias("host"), "html")
    page = cut(read.mapInArrow(parsed, "key struct<id:long,a:long,b:long>, page_id long, url string, text string, marked boolean, tokens array<string>, x array<long>, y array<long>, body long"))
    suffix = lambda df, *more: df.select(*more, F.posexplode(F.arrays_zip("x", "y")).alias("i", "h")).select(*more, "i", "h.x", "h.y")
    repeated = suffix(page, "body").groupBy("x", "y").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low != high").select("x", "y")
    unmarked = page.where("NOT marked").select("key", "page_id", "url", "tokens", "x", "y")
    covered = suffix(unmarked, "key").join(repeated, ["x", "y"], "left_semi").groupBy("key").agg(F.collect_set("i").alias("starts"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + depth - 1))))
    every = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    kept = F.transform(F.array_except(every, F.coalesce(gone, F.expr("CAST(array() AS array<int>)"))), lambda i: F.get("tokens", i))
    rest = unmarked.join(covered, "key", "left").select("page_id", "url", F.array_join(kept, " ").alias("text"))
    return page.where("marked").select("page_id", "url", "text").unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
