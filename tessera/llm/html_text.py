"""Main text of web pages by scoring the element tree.

Elements that never hold the article (menus, footers, scripts, hidden ones) are
set aside.  Those whose class or id says advert, sidebar, notice, comments ...,
and forms, are set aside unless the article is in them: they hold most of the
page's points together with an article, main element, first heading or several
paragraphs.  Names that say what a page has, lacks or how it is set (has-sidebar,
no-ads, header-fixed) say nothing of the element.  A header stays if it is inside
the chosen container and holds a heading.  Every block with text is a paragraph: it gives one point, one
per comma and one per hundred characters up to three, in full to its container,
half to the next ancestor, and a third, a sixth ... further up.  A container's
points are discounted by the share of its text that stands in links.  The best
container, or the article or main element around it, is kept, with the siblings
that score a fifth of it or are running text.

Blocks are joined by a newline in page order, white space inside a block is one
space, character references are decoded.

Defined cases: null, empty and text-free pages give the empty text; unclosed and
stray tags are mended as browsers do for paragraphs, list items and cells; pages
of any depth are read without recursion; a page is read once from its start, and
after the first tag in which quotes do not close they count as ordinary
characters; repeated rows and ids are read each;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import bounded_batches

_OPENS = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_QUOTE_OR_END = re.compile("[>\"']")
#: One attribute: its full name, and its value in double, single or no quotes.
_ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_ASIDE = frozenset("head nav header footer aside form script style noscript iframe template button select textarea title "
                   "svg math canvas dialog menu object audio video datalist".split()) - {"form", "header"}
_BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
                   "blockquote pre figure figcaption address details summary fieldset center hr nav header footer aside form "
                   "hgroup search".split())
_HOLDER = frozenset("# html body article main section div td th blockquote details center fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
_WORDS_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsors sidebar "
    "widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist "
    "disqus discussion replies reply respond cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended recommendations pagination pager "
    "toolbar skip copyright".split())
_OF_READERS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
_HEADERS = frozenset("header masthead banner".split())
#: A name that starts or ends so tells of the page or of a state, not of the element.
_STATE_FIRST = frozenset("has no with without not non is hide show enable disable supports".split())
_STATE_LAST = frozenset("enabled disabled free off on fixed sticky ready open closed active visible hidden loaded".split())
_MANY = 5  # paragraphs that make an article without other signs
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Start tags that end an open element of these kinds, looked for up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_ENDS_P = _BLOCK - {"html", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "summary", "figcaption"} | {"li"}
_P_SCOPE = frozenset("article main section div td th li body html table blockquote figure details nav header footer aside form".split())


def _names(value: str) -> set[str]:
    """Words of a class or id that may say what the element is."""
    out = set()
    for name in value.split():
        parts = [w.lower() for w in _PART.findall(name)]
        if parts and (len(parts) == 1 or parts[0] not in _STATE_FIRST and parts[-1] not in _STATE_LAST):
            out |= _WORDS_ASIDE.intersection(parts)
    return out


def _set_aside(tag: str, attributes: str) -> tuple[bool, set[str]]:
    """Whether an element is set aside for good, and the words for which it is unless the article is in it."""
    if tag in _ASIDE:
        return True, set()
    said = {tag} if tag in ("form", "header") else set()
    if not attributes or tag in ("html", "body", "main"):
        return False, said
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            return True, said
        if name == "role":
            if value.lower() in _ROLES:
                return True, said
        elif name in ("class", "id"):
            words = _names(value)
            if tag == "article" and words & {"comment", "comments", "reply"}:
                return True, said
            said |= words if tag != "article" else set()
    return False, said


class Page:
    """Elements in page order, and the texts and block borders between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.aside, self.block = ["#"], [-1], [False], [True]
        self.said: dict[int, set[str]] = {}
        self.hard: set[int] = set()  # set aside for good, by itself
        self.count: dict[str, int] = {}  # open elements by tag
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) at a block border
        self.open = [0]
        self._read(source)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES:
            ends, scope = _CLOSES[tag]
            self._close(ends, scope)
        if tag in _ENDS_P:
            self._close({"p"}, _P_SCOPE)
        if tag in _VOID:
            self.events.append((self.open[-1], None if tag == "hr" else " "))
            return
        top = self.open[-1]
        self.tag.append(tag)
        self.parent.append(top)
        aside, said = _set_aside(tag, attributes)
        self.aside.append(self.aside[top] or aside)
        if aside:
            self.hard.add(len(self.tag) - 1)
        if said:
            self.said[len(self.tag) - 1] = said
        self.count[tag] = self.count.get(tag, 0) + 1
        self.block.append(tag in _BLOCK)
        self.open.append(len(self.tag) - 1)
        if tag in _BLOCK:
            self.events.append((self.open[-1], None))
        elif tag in ("td", "th"):
            self.events.append((self.open[-1], " "))

    def _close(self, ends, scope) -> None:
        if not any(self.count.get(tag) for tag in ends):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag in ends:
                self._drop_to(i)
                return
            if tag in scope:
                return

    def _drop_to(self, i: int) -> None:
        for e in reversed(self.open[i:]):
            self.count[self.tag[e]] -= 1
            if self.block[e]:
                self.events.append((e, None))
        del self.open[i:]

    def _tags(self, source: str):
        """(start, end, closing, tag, attributes) of tags, comments and declarations (tag None), in one pass."""
        at, last, quotes = 0, source.rfind(">"), True
        while (m := _OPENS.search(source, at)) is not None:
            if source.startswith("<!--", m.start()):
                end = source.find("-->", m.start() + 4)
                at = len(source) if end < 0 else end + 3
                yield m.start(), at, False, None, ""
                continue
            if m.start() > last:
                return
            end = m.end()
            if m[2] and quotes:
                while (q := _QUOTE_OR_END.search(source, end)) is not None and q[0] != ">":
                    closing = source.find(q[0], q.end())
                    if closing < 0:
                        q = None
                        break
                    end = closing + 1
                quotes = q is not None
                end = q.start() if q else m.end()
            end = source.find(">", end)
            at = self.at = end + 1
            yield m.start(), at, bool(m[1]), m[2] and m[2].lower(), source[m.end():end]
            at = self.at

    def _read(self, source: str) -> None:
        done = 0
        for start, end, closing, tag, attributes in self._tags(source):
            if start > done:
                self.events.append((self.open[-1], source[done:start]))
            done = end
            if not tag:
                continue
            if closing:
                if self.count.get(tag):
                    for i in range(len(self.open) - 1, 0, -1):
                        if self.tag[self.open[i]] == tag:
                            self._drop_to(i)
                            break
                continue
            self._start(tag, attributes)
            if tag in _RAW:
                m = re.compile(f"</{tag}\\s*>", re.I).search(source, end)
                done = self.at = m.end() if m else len(source)
                self._drop_to(len(self.open) - 1)
        if done < len(source):
            self.events.append((self.open[-1], source[done:]))
        self._drop_to(1)

    def _soft(self, given: list[float], paragraphs: list[bool]) -> set[int]:
        """Elements set aside for their names, as the article is not in them."""
        n = len(self.tag)
        if not self.said:
            return set()
        points, many, sign = list(given), [int(p) for p in paragraphs], [t in ("article", "main", "h1") for t in self.tag]
        for e in range(n - 1, 0, -1):
            if not self.aside[e]:
                p = self.parent[e]
                points[p] += points[e]
                many[p] += many[e]
                sign[p] |= sign[e]
        out = set()
        for e, said in self.said.items():
            most = points[e] > 0.5 * points[0] and (sign[e] or many[e] >= _MANY and not said & _OF_READERS)
            if not most:
                out.add(e)
        return out

    def kept(self) -> set[int]:
        """The elements whose texts are the article."""
        n = len(self.tag)
        own, commas, chars, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link, holder = [False] * n, list(range(n))
        for e in range(1, n):
            p = self.parent[e]
            in_link[e] = self.tag[e] == "a" or in_link[p]
            holder[e] = e if self.block[e] or self.tag[e] in ("td", "th") else holder[p]
        for e, text in self.events:
            if text and not self.aside[e]:
                own[holder[e]] += len(" ".join(text.split()))
                commas[holder[e]] += text.count(",")
        given = [1 + c + min(3, o / 100) if o else 0.0 for o, c in zip(own, commas)]
        soft = self._soft(given, [o > 0 for o in own])
        for e in range(1, n):
            self.aside[e] = self.aside[e] or e in soft or self.aside[self.parent[e]]
        own = [0 if self.aside[e] else o for e, o in enumerate(own)]
        for e, text in self.events:
            if text and not self.aside[e]:
                size = len(" ".join(text.split()))
                chars[e] += size
                links[e] += size if in_link[e] else 0
        for e in range(n - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
            links[self.parent[e]] += links[e]
        points = [0.0] * n
        for e in range(n):
            if own[e]:
                give, to, level = given[e], e if self.tag[e] in _HOLDER else self.parent[e], 0
                while to >= 0:
                    points[to] += give / (1 if level == 0 else 2 if level == 1 else 3 * (level - 1))
                    to, level = self.parent[to], level + 1
        score = [p * (1 - links[e] / chars[e]) if chars[e] else 0.0 for e, p in enumerate(points)]
        best = max((e for e in range(n) if not self.aside[e]), key=lambda e: (score[e], e))
        if not score[best]:
            best = max((e for e in range(n) if not self.aside[e]), key=lambda e: (points[e], e))
        if not points[best]:
            return set()
        up, around = best, None
        while up > 0:
            if self.tag[up] in ("article", "main"):
                around = up
            up = self.parent[up]
        if around is not None:
            return {around}
        if best == 0 or self.tag[best] in ("html", "body"):
            return {best}
        keep = {best}
        for e in range(1, n):
            if self.parent[e] == self.parent[best] and e != best and not self.aside[e] and chars[e]:
                running = self.tag[e] in _RUNNING and links[e] < 0.25 * chars[e]
                if running or self.tag[e] in _HOLDER and score[e] >= 0.2 * score[best]:
                    keep.add(e)
        return keep

    def text(self) -> str:
        roots = self.kept()
        n = len(self.tag)
        inside, heading = [False] * n, [t in _HEADINGS for t in self.tag]
        for e in range(n - 1, 0, -1):
            heading[self.parent[e]] |= heading[e]
        within = {"html", "body", "#"}.isdisjoint(self.tag[e] for e in roots)  # a container, not the page
        freed: set[int] = set()  # headers of the container, and what is in them
        for e in range(n):
            above = e > 0 and inside[self.parent[e]]
            if above and self.aside[e] and e not in self.hard:
                said = self.said.get(e)
                if within and heading[e] and said <= _HEADERS if said else self.parent[e] in freed:
                    freed.add(e)
            inside[e] = e in freed or not self.aside[e] and (e in roots or above)
        blocks, now = [], []
        for e, text in self.events:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif inside[e]:
                now.append(text)
        blocks.append("".join(now))
        lines = (" ".join(html.unescape(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def _extract(batches):
    for batch in batches:
        pages = batch.column("html").cast(pa.binary())
        out = [main_text(None if p.as_py() is None else p.as_py().decode("utf-8", "replace")) for p in pages]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()),
                                          pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(partial(_extract), f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
