"""HTML extraction (12): site template removal, and what is left of the article as text.

Element subtrees are hashed (tag and text of each element, not its attributes) and counted per host in
Spark. A subtree on ``PAGES`` or more pages of a host that have different main texts belongs to the
site's template and is deleted. Copies of a page count once, so copies don't turn an article into a
template. Of what is left, elements that say what they are (``nav``, ``footer``, ``class="ad"``, a nested
``article``, ...) go too, as hosts of a few pages have nothing to count; then the text of ``main``, else of
``article``, else of the body is taken.

Never deleted by counts: prose of its own (paragraphs, headings, lists, tables, plain ``div`` of text) inside the
article, where passages that many pages quote stay; and what holds the article or half of a page's text.
"""

from __future__ import annotations

import hashlib
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import fields, free_name, map_rows
from codeloom.session import staged

PAGES = 5  # pages of different main text on which a template's subtree stands

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed by HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label map mark meter "
    "nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "script style template".split())  # the last three are no text, and end no block
CELLS = {"td", "th"}  # of one line of text, a row
# A tag that opens ends an open element of these, unless a container of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
WALLS = {"table", "td", "th", "caption", "button", "object", "template"}  # no tag ends a paragraph beyond them

# What elements say of themselves.
GONE = set(
    "title script style noscript template iframe object svg canvas audio video select button textarea form nav "
    "aside footer dialog menu datalist".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination paywall popup promo promoted promotion related replies respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
TITLES = {"article", "content", "entry", "post", "section", "story"}  # whose header has the title
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dt dd table tr td th thead tbody tfoot caption figure figcaption".split())


class Page:
    """A page's elements in page order, each with its parent, and its pieces of text.

    ``block`` numbers change wherever a block starts or ends, so pieces of one number are one block.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.said = ["html"], [-1], [""]
        self.pieces: list[tuple[int, int, str]] = []  # (block, element, text)
        self._block = 0
        self._read(source)
        n = len(self.tag)
        self.size = [0] * n
        for _, e, text in self.pieces:
            self.size[e] += len(text)
        for e in range(n - 1, 0, -1):
            self.size[self.parent[e]] += self.size[e]
        self.words = [self._names(e) for e in range(n)]
        self._find_article()

    def _read(self, source: str) -> None:
        stack, at, end = [0], 0, len(source)
        tag, pieces = self.tag, self.pieces
        while at < end:
            found = _TAG.search(source, at)
            text = source[at:found.start() if found else end]
            if text and not text.isspace():
                pieces.append((self._block, stack[-1], html.unescape(text) if "&" in text else text))
            elif text:
                pieces.append((self._block, stack[-1], " "))
            if not found:
                return
            at = found.end()
            closes, name, rest = found.groups()
            if name is None:
                continue
            name = name.lower()
            if closes:
                self._close(stack, name)
                continue
            if name in VOID:
                if name == "br":
                    pieces.append((self._block, stack[-1], " "))
                elif name == "hr":
                    self._block += 1
                continue
            if name == "html" or (name == "body" and "body" in tag):
                continue
            self._end_open(stack, name)
            if name in CELLS:
                pieces.append((self._block, stack[-1], " "))
            elif name not in INLINE:
                self._block += 1
            tag.append(name)
            self.parent.append(stack[-1])
            self.said.append(rest[:-1])
            stack.append(len(tag) - 1)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else end

    def _end_open(self, stack: list[int], name: str) -> None:
        """Close what ``name`` ends by opening: a paragraph, or an element of its kind."""
        ends, walls = ENDS.get(name, (set(), set()))
        if name not in INLINE and not ends:
            ends, walls = {"p"}, WALLS
        for place in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[place]]
            if open_tag in walls:
                return
            if open_tag in ends:
                del stack[place:]
                self._block += open_tag not in CELLS
                return
            if ends == {"p"} and open_tag not in INLINE:  # only they can stand inside a paragraph
                return

    def _close(self, stack: list[int], name: str) -> None:
        if name not in INLINE and name not in CELLS:
            self._block += 1
        if name in ("body", "html"):
            return
        for place in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[place]]
            if open_tag == name:
                del stack[place:]
                return
            if name in INLINE and open_tag not in INLINE:
                return

    def _names(self, e: int) -> frozenset[str]:
        """Words of class and id, ``role=...``, and ``hidden``."""
        said = self.said[e]
        if not said or "=" not in said and "hidden" not in said:
            return frozenset()
        out = set()
        for name, *values in _ATTRIBUTE.findall(said):
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                out.update(w.lower() for w in _WORDS.findall(value))
            elif name == "role":
                out.add(f"role={value.strip().lower()}")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                    r"display\s*:\s*none", value):
                out.add("(hidden)")
        return frozenset(out)

    def _find_article(self) -> None:
        n = len(self.tag)
        article = [t == "article" for t in self.tag]
        main = [t == "main" or "role=main" in w for t, w in zip(self.tag, self.words)]
        self.in_article, self.holds = [False] * n, [False] * n
        for e in range(1, n):
            p = self.parent[e]
            self.in_article[e] = self.in_article[p] or article[p]
        for e in range(n - 1, 0, -1):  # holds the outermost article or main
            p = self.parent[e]
            self.holds[p] |= self.holds[e] or main[e] or article[e] and not self.in_article[e]
        self.top = [e for e in range(n) if main[e]] or [e for e in range(n) if article[e] and not self.in_article[e]]
        self.inside = [False] * n  # the article's own elements
        tops = set(self.top)
        for e in range(1, n):
            self.inside[e] = self.inside[self.parent[e]] or self.parent[e] in tops

    def _too_large(self, e: int) -> bool:
        return not self.top and 2 * self.size[e] >= self.size[0]

    def says_gone(self, e: int) -> bool:
        """Whether the element names itself as no part of an article."""
        tag, words = self.tag[e], self.words[e]
        if e == 0 or tag in ("html", "head", "body", "main") or self.holds[e]:
            return False
        if tag == "article":
            return self.in_article[e] or bool(words & {"comment", "comments"})
        if tag == "header" and not self.inside[e]:
            return True
        if tag in GONE or "(hidden)" in words:
            return tag != "form" or not self._too_large(e)
        if any(w.startswith("role=") and w[5:] in ROLES for w in words):
            return not self._too_large(e)
        if "header" in words and not self.inside[e] and not words & TITLES:
            return not self._too_large(e)
        if tag in INLINE or not words & NAMES:
            return False
        return bool(words & {"comment", "comments"}) or not self._too_large(e)

    def subtrees(self) -> dict[int, int]:
        """Element -> hash of the subtrees that a site's template may hold."""
        n = len(self.tag)
        digests = [hashlib.blake2b(t.encode(), digest_size=8) for t in self.tag]
        texts = [[] for _ in range(n)]
        for _, e, text in self.pieces:
            texts[e].append(text)
        children = [0] * n
        for e in range(n - 1, 0, -1):
            digests[e].update(" ".join("".join(texts[e]).split()).encode("utf-8", "surrogatepass"))
            digests[self.parent[e]].update(digests[e].digest())
            children[self.parent[e]] += self.tag[e] not in INLINE
        out = {}
        for e in range(1, n):
            tag = self.tag[e]
            if not self.size[e] or tag in INLINE or tag in PROSE or tag in RAW or tag in ("html", "head", "body", "main", "article"):
                continue
            if self.holds[e] or self._too_large(e) or tag == "div" and not children[e] and not self.said[e].strip():
                continue
            out[e] = int.from_bytes(digests[e].digest(), "little", signed=True)
        return out

    def _blocks(self, gone: list[bool]) -> list[str]:
        wanted = [not g for g in gone]
        if self.top:
            tops = set(self.top)
            wanted = [w and (i or e in tops) for e, (w, i) in enumerate(zip(wanted, self.inside))]
        out, now, block = [], [], -1
        for b, e, text in self.pieces:
            if wanted[e]:
                if b != block:
                    out.append(now)
                    now, block = [], b
                now.append(text)
        out.append(now)
        return [t for t in (" ".join("".join(x).split()) for x in out) if t]

    def _gone(self, template: set[int]) -> list[bool]:
        gone = [False] * len(self.tag)
        known = self.subtrees() if template else {}
        for e in range(1, len(gone)):
            gone[e] = gone[self.parent[e]] or known.get(e) in template or self.says_gone(e)
        return gone

    def main_text(self) -> str:
        """The three longest blocks: pages that share them are copies, whatever stands around."""
        return "\n".join(sorted(self._blocks(self._gone(set())), key=lambda b: (-len(b), b))[:3])

    def text(self, template: set[int]) -> str:
        return "\n".join(self._blocks(self._gone(template)))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host(url: str | None) -> str:
    """Host of a url, A-Z lower-cased; empty without ``://``."""
    found = re.search(r"://([^/?#]*)", url or "")
    return "".join(c.lower() if c.isascii() else c for c in found[1]) if found else ""


def extract(pages: DataFrame, source: str = "html", url: str = "url", pages_of_template: int = PAGES) -> DataFrame:
    """``pages`` with the main text of each page as ``text`` in place of its source.

    Blocks are joined by one line break, white space inside a block is one space, character references
    are decoded. Null and empty sources give an empty text. A null url, or one without ``://``, belongs
    to the host of no name; repeated rows give a row each and count as one page; very long pages are
    read whole; an empty table gives an empty one. Other columns stay as they are; one named ``text``
    is replaced. Pages are moved once, to meet the subtrees to delete.
    """
    one, two, gone = (free_name(pages, n) for n in ("one", "two", "gone"))
    columns = [c for c in pages.columns if c.lower() not in (source.lower(), "text")]
    keyed = pages.select("*", F.xxhash64(F.lit(1), *pages.columns).alias(one), F.xxhash64(F.lit(2), *pages.columns).alias(two))

    def marks(ones: list, twos: list, urls: list, sources: list) -> list:
        hosts, mains, subs = [], [], []
        for u, s in zip(urls, sources):
            page = Page(s or "")
            hosts.append(_digest(host(u)))
            mains.append(_digest(page.main_text()))
            subs.append(sorted(set(page.subtrees().values())))
        return [ones, twos, hosts, mains, subs]

    marked = staged(map_rows(keyed.select(one, two, F.col(url).alias("url"), F.col(source).alias("source")), marks, fields(
        "one long, two long, host long, main long, subs array<long>")), "subtrees")
    template = marked.select("host", "main", F.explode("subs").alias("sub")).groupBy("host", "sub").agg(
        F.count_distinct("main").alias("n")).filter(F.col("n") >= pages_of_template).select("host", "sub")
    found = marked.select("one", "two", "host", F.explode("subs").alias("sub")).join(template, ["host", "sub"]).groupBy(
        F.col("one").alias(one), F.col("two").alias(two)).agg(F.collect_set("sub").alias(gone))  # at most a page's own
    met = keyed.join(found, [one, two], "left").select(*columns, F.col(source).alias(one), gone)

    def texts(*parts: list) -> list:
        *others, sources, subs = parts
        return [*others, [Page(s).text(set(t or ())) if s else "" for s, t in zip(sources, subs)]]

    return map_rows(met, texts, T.StructType([*(pages.schema[c] for c in columns), T.StructField("text", T.StringType())]))
