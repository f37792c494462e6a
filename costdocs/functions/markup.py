"""HTML tree work that regular expressions cannot do, as Arrow-batched functions.

Each function parses a page once with the stdlib parser and returns only what is asked for. A walk
takes time in proportion to the page, whatever is left open in it: an anchor ends where the next one
begins, and a heading likewise, as browsers have it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

from pyspark.sql import types as T

from costdocs.functions.batches import by_pieces

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW_TEXT = {"script", "style"}
LEVELS = ("H1", "H2", "H3")
HEADINGS = {level.lower() for level in LEVELS}

# What the text form and the markup form of cleaning leave out.
TEXT_DROP_TAGS = {"header", "footer", "nav", "aside", "script", "style"}
TEXT_DROP_CLASSES = {"breadcrumb", "sidebar"}
MARKUP_DROP_TAGS = {"script", "style", "nav", "footer", "aside"}
MARKUP_DROP_DIV = re.compile(r"sidebar|nav|toc|breadcrumb")

_STRINGS = T.ArrayType(T.StringType())
LINK_TYPE = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])
)
HEADERS_TYPE = T.MapType(T.StringType(), _STRINGS)
FACTS_TYPE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        *[T.StructField(level, _STRINGS) for level in LEVELS],
        T.StructField("links", LINK_TYPE),
        T.StructField("text", T.StringType()),
    ]
)
DOCUMENT_TYPE = T.StructType([T.StructField("html", T.StringType()), *FACTS_TYPE.fields[:4]])
PARTS_TYPE = T.StructType(
    [
        T.StructField("title_tag", T.StringType()),
        *[T.StructField(level, T.StringType()) for level in LEVELS],
        T.StructField(
            "sections",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("section_order", T.IntegerType()),
                        T.StructField("own_header", T.StringType()),
                        T.StructField("content", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def no_text(tag: str, classes: list[str]) -> bool:
    return tag in RAW_TEXT


def text_boilerplate(tag: str, classes: list[str]) -> bool:
    return tag in TEXT_DROP_TAGS or not TEXT_DROP_CLASSES.isdisjoint(classes)


def markup_boilerplate(tag: str, classes: list[str]) -> bool:
    return tag in MARKUP_DROP_TAGS or (
        tag == "div" and any(MARKUP_DROP_DIV.search(c) for c in [*classes, " ".join(classes)])
    )


def all_boilerplate(tag: str, classes: list[str]) -> bool:
    return text_boilerplate(tag, classes) or markup_boilerplate(tag, classes)


class PageWalk(HTMLParser):
    """Calls ``start``, ``end`` and ``text`` for every part of a page outside dropped elements."""

    def __init__(self, dropped=no_text):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.skip_depth: int | None = None

    def run(self, html: str) -> "PageWalk":
        self.feed(html)
        self.close()
        while self.open:
            self._close_last()
        return self

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a malformed "<![" must not end the job; browsers take it as a comment
            return self.parse_bogus_comment(i)

    def updatepos(self, i, j):  # line numbers are not needed
        return j

    def handle_starttag(self, tag, attrs):
        if self.skip_depth is None:
            attributes = {k: v or "" for k, v in attrs}
            if self.dropped(tag, attributes.get("class", "").split()):
                if tag in VOID:
                    return
                self.skip_depth = len(self.open)
            else:
                self.start(tag, attributes)
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self._close_last() != tag:
                pass

    def _close_last(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        if self.skip_depth is None:
            self.end(tag)
        elif len(self.open) == self.skip_depth:
            self.skip_depth = None
        return tag

    def handle_data(self, data):
        if self.skip_depth is None:
            self.text(data)

    def start(self, tag, attributes):
        pass

    def end(self, tag):
        pass

    def text(self, data):
        pass


class Tee(PageWalk):
    """One parse of a page for several walks."""

    def __init__(self, *walks: PageWalk):
        super().__init__()
        self.walks = walks

    def run(self, html: str) -> "Tee":
        super().run(html)
        for walk in self.walks:
            while walk.open:
                walk._close_last()
        return self

    def handle_starttag(self, tag, attrs):
        for walk in self.walks:
            walk.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for walk in self.walks:
            walk.handle_endtag(tag)

    def handle_data(self, data):
        for walk in self.walks:
            walk.handle_data(data)

    def handle_comment(self, data):
        for walk in self.walks:
            walk.handle_comment(data)

    def handle_decl(self, decl):
        for walk in self.walks:
            walk.handle_decl(decl)


def kind_of(tag: str) -> str:
    """Elements of one kind do not hold each other."""
    return "heading" if tag in HEADINGS else tag


class Parts(PageWalk):
    """Text cut before every heading, and the texts of the title and of all headings."""

    def __init__(self, dropped):
        super().__init__(dropped)
        self.sections: list[tuple[list[str], list[str]]] = [([], [])]
        self.elements: dict[str, list[list[str]]] = {}
        self.collecting: dict[str, tuple[str, list[str]]] = {}  # by kind

    def start(self, tag, attributes):
        if tag in HEADINGS:
            self.sections.append(([], []))
        if tag in HEADINGS or tag == "title":
            words: list[str] = []
            self.elements.setdefault(tag, []).append(words)
            self.collecting[kind_of(tag)] = (tag, words)

    def end(self, tag):
        if self.collecting.get(kind_of(tag), ("",))[0] == tag:
            del self.collecting[kind_of(tag)]

    def text(self, data):
        lines, header = self.sections[-1]
        lines.append(data)
        for _, words in self.collecting.values():
            words.append(data)
        if "heading" in self.collecting:
            header.append(data)

    def first(self, tag: str) -> str | None:
        """The first element's text as it stands in markup."""
        found = self.elements.get(tag)
        return escape("".join(found[0]), quote=False).strip() if found else None


class Facts(PageWalk):
    """Title, headings, anchors and visible text, as far as they are wanted."""

    def __init__(self, wanted=("title", *LEVELS, "links", "text")):
        super().__init__(no_text)
        self.wanted = wanted
        self.collected = {w.lower() if w != "links" else "a" for w in wanted} - {"text"}
        self.words: list[str] = []
        self.elements: dict[str, list[list[str]]] = {}
        self.anchors: list[tuple[str, list[str]]] = []
        self.collecting: dict[str, tuple[str, list[str]]] = {}  # by kind

    def start(self, tag, attributes):
        if tag not in HEADINGS and tag not in ("title", "a"):
            return
        words: list[str] = []
        self.collecting.pop(kind_of(tag), None)
        if tag not in self.collected:
            return
        self.collecting[kind_of(tag)] = (tag, words)
        if tag != "a":
            self.elements.setdefault(tag, []).append(words)
        elif "href" in attributes:
            self.anchors.append((attributes["href"], words))

    def end(self, tag):
        if self.collecting.get(kind_of(tag), ("",))[0] == tag:
            del self.collecting[kind_of(tag)]

    def text(self, data):
        if "text" in self.wanted:
            self.words.append(data)
        for _, words in self.collecting.values():
            words.append(data)

    def all(self, tag: str) -> list[str]:
        return ["".join(words).strip() for words in self.elements.get(tag, [])]

    def found(self) -> dict:
        """What is wanted, by name."""
        out: dict = {}
        for name in self.wanted:
            if name == "title":
                out[name] = next(iter(self.all("title")), None)
            elif name == "links":
                out[name] = [{"text": "".join(words).strip(), "href": href} for href, words in self.anchors]
            else:
                out[name] = "".join(self.words) if name == "text" else self.all(name.lower())
        return out


class Rewriter(PageWalk):
    """The page as markup again, without dropped elements."""

    def __init__(self):
        super().__init__(markup_boilerplate)
        self.out: list[str] = []

    def start(self, tag, attributes):
        pairs = "".join(f' {k}="{escape(v)}"' for k, v in attributes.items())
        self.out.append(f"<{tag}{pairs}/>" if tag in VOID else f"<{tag}{pairs}>")

    def end(self, tag):
        self.out.append(f"</{tag}>")

    def text(self, data):
        self.out.append(escape(data, quote=False))

    def handle_comment(self, data):
        if self.skip_depth is None:
            self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        if self.skip_depth is None:
            self.out.append(f"<!{decl}>")


class TopicLinks(PageWalk):
    """Anchors inside the first ``div`` of class ``topics``."""

    def __init__(self):
        super().__init__(no_text)
        self.depth: int | None = None
        self.done = False
        self.links: list[tuple[str, list[str]]] = []
        self.collecting: list[str] | None = None

    def start(self, tag, attributes):
        if tag == "div" and self.depth is None and not self.done:
            if "topics" in attributes.get("class", "").split():
                self.depth = len(self.open)
        elif tag == "a" and self.depth is not None:
            words: list[str] = []
            self.links.append((attributes.get("href", ""), words))
            self.collecting = words

    def end(self, tag):
        if tag == "a":
            self.collecting = None
        if self.depth is not None and len(self.open) == self.depth:
            self.depth, self.done, self.collecting = None, True, None

    def text(self, data):
        if self.collecting is not None:
            self.collecting.append(data)


def normal_form(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _new_lines(text: str, seen: set[str]) -> list[str]:
    """Stripped lines not met before; ``seen`` is extended."""
    kept = []
    for line in normal_form(text).splitlines():
        line = line.strip()
        if line and line not in seen:
            seen.add(line)
            kept.append(line)
    return kept


def _cut(walk: Parts) -> list[dict]:
    """Sections with text; a line is kept at its first place in the page only."""
    seen: set[str] = set()
    out: list[dict] = []
    for words, header in walk.sections:
        lines = _new_lines("\n".join(words), seen)
        if lines:
            name = normal_form("".join(header)).strip()
            out.append({"section_order": len(out), "own_header": name or None, "content": "\n".join(lines)})
    return out


def page_text(html: str) -> str:
    """Text outside boilerplate: one line per text node, each distinct line once."""
    return "\n".join(s["content"] for s in _cut(Parts(text_boilerplate).run(html)))


def page_parts(html: str) -> dict:
    """Title, first heading of each level and sections, outside all boilerplate."""
    walk = Parts(all_boilerplate).run(html)
    firsts = {level: walk.first(level.lower()) for level in LEVELS}
    return {"title_tag": walk.first("title"), **firsts, "sections": _cut(walk)}


def page_facts(html: str) -> dict:
    return Facts().run(html).found()


def page_document(html: str) -> dict:
    """Cleaned markup, and title and headings of the whole page, from one parse."""
    markup, facts = Rewriter(), Facts(("title", *LEVELS))
    Tee(markup, facts).run(html)
    return {"html": "".join(markup.out), **facts.found()}


def page_markup(html: str) -> str:
    return "".join(Rewriter().run(html).out)


def topic_links(html: str) -> list[dict]:
    links = TopicLinks().run(html).links
    return [{"text": "".join(words).strip(), "href": href} for href, words in links if href]


# The functions are deterministic, so that filters on other columns reach the scan. What is made of
# their arrays is exploded in the outer form: the plain one brings a filter that would run them again.
def _if_any(each: Callable) -> Callable:
    return lambda html: None if html is None else each(html)


page_text_udf = by_pieces(_if_any(page_text), T.StringType())
page_markup_udf = by_pieces(_if_any(page_markup), T.StringType())
topic_links_udf = by_pieces(_if_any(topic_links), LINK_TYPE)
nfkc_udf = by_pieces(_if_any(normal_form), T.StringType())
page_parts_udf = by_pieces(lambda html: page_parts(html or ""), PARTS_TYPE)
page_document_udf = by_pieces(lambda html: page_document(html) if html is not None else {**page_document(""), "html": None}, DOCUMENT_TYPE)


def page_facts_udf(*wanted: str) -> Callable:
    """A function from pages to a struct of the wanted ones of title, H1, H2, H3, links and text."""
    kind = T.StructType([f for f in FACTS_TYPE.fields if f.name in wanted])
    return by_pieces(lambda html: Facts(wanted).run(html or "").found(), kind)
