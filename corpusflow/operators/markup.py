"""Text from HTML pages and TEI documents, in Arrow-fed workers."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import Literal
from xml.etree import ElementTree as ET

import pyarrow as pa
from pydantic import Field
from pyspark.sql import Column, DataFrame

from corpusflow.functions.arrow import text_udf
from corpusflow.plans.base import MapFn, Semantics
from corpusflow.plans.registry import components

_DROP = frozenset("script style noscript template iframe svg head nav footer header aside form button select textarea".split())
_BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tr td th dd dt dl br figure figcaption body html".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BOILER = re.compile(r"\b(?:ad|ads|advert|banner|breadcrumbs?|comments?|cookies?|footer|header|menu|nav|navbar|newsletter|popup|promo|related|share|sidebar|social|sponsored|widget)\b", re.I)


class _Blocks(HTMLParser):
    """Blocks of text with the characters inside links, outside what is dropped as a whole."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.dropped = self.links = 0
        self.blocks: list[list] = [["", 0]]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.blocks.append(["", 0])
        if tag in _VOID:
            return
        drop = tag in _DROP or (tag not in ("body", "html", "article", "main") and any(k in ("class", "id") and v and _BOILER.search(v) for k, v in attrs))
        self.stack.append((tag, drop))
        self.dropped += drop
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.blocks.append(["", 0])
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, drop = self.stack.pop()
                self.dropped -= drop
                self.links -= t == "a"
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += len(data.strip()) if self.links else 0


def html_main_text(page: str | None, favor_precision: bool = True, deduplicate: bool = True) -> str | None:
    """Lines of the blocks that aren't mostly links; None where nothing is left."""
    if not page:
        return None
    p = _Blocks()
    p.feed(page)
    p.close()
    out, seen = [], set()
    for text, linked in p.blocks:
        t = " ".join(text.split())
        if not t or (linked * 2 > len(t) if favor_precision else linked >= len(t)) or (deduplicate and t in seen):
            continue
        seen.add(t)
        out.append(t)
    return "\n".join(out) or None


@components.add("extract", "html")
class HTMLExtractor(MapFn):
    """With the trafilatura package installed it does the work; else a built-in stripper of boilerplate."""

    name: str = Field(default="html")
    favor_precision: bool = Field(default=True)
    timeout: bool = Field(default=True, description="Accepted; tasks have Spark's time limits")
    deduplicate: bool = Field(default=True)
    backend: Literal["builtin", "trafilatura"] = Field(default="builtin")

    def column(self, df: DataFrame) -> Column:
        precise, unique, backend = self.favor_precision, self.deduplicate, self.backend

        def load() -> Callable[[list[str | None]], pa.Array]:
            def one(x: str | None) -> str | None:
                return html_main_text(x, precise, unique)

            if backend == "trafilatura":
                import trafilatura

                def one(x: str | None) -> str | None:
                    return trafilatura.extract(x, favor_precision=precise, deduplicate=unique, include_comments=False) if x else None

            return lambda texts: pa.array([one(x) for x in texts], pa.string())

        return text_udf("string", load)(self.text(df))


TEI = "{http://www.tei-c.org/ns/1.0}"
# what clean text leaves out; its tail stays
SKIPPED = frozenset(
    """abbr add anchor app argument bibl biblStruct byline closer corr damage dateline del docAuthor docDate docEdition docImprint docTitle epigraph expan figDesc figure fw gap graphic handShift
    lb milestone mod note opener pb postscript ptr rdg redo ref seg sic signed space subst supplied surplus trailer unclear undo""".split()
)
_AROUND = {"div": ("\n\n", "\n\n"), "p": ("\n\n", "\n\n")}
_MARKS = {"hi": ("**", "**"), "emph": ("*", "*"), "q": ('"', '"'), "quote": ('"', '"'), "item": ("- ", "\n"), "l": ("", "\n"), "note": (" [", "] "), "unclear": ("[", "?]"), "supplied": ("[", "]")}
_FIXED = {"gap": "[gap]", "lb": "\n", "pb": "\n\n", "ptr": ""}


class TEIText:
    """Text of a TEI document. Compat looks for un-namespaced children in lists, verse, tables and choices."""

    def __init__(self, output_format: str = "clean", semantics: str = "compat"):
        self.clean, self.local = output_format == "clean", semantics == "corrected"

    @staticmethod
    def name(e: ET.Element) -> str:
        return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def below(self, e: ET.Element, name: str) -> list[ET.Element]:
        return [x for x in e.iter() if x is not e and (self.name(x) if self.local else x.tag) == name]

    def child(self, e: ET.Element, name: str) -> ET.Element | None:
        return next((x for x in e if (self.name(x) if self.local else x.tag) == name), None)

    def inner(self, e: ET.Element) -> str:
        return (e.text or "") + "".join(self.of(c) + (c.tail or "") for c in e)

    def joined(self, parts: list[str], by: str) -> str:
        return by.join(parts) + by if parts else ""

    def of(self, e: ET.Element) -> str:
        tag = self.name(e)
        if self.clean:
            if tag in SKIPPED:
                return ""
            if tag == "list":
                return self.joined([t for t in (self.of(x).strip() for x in self.below(e, "item")) if t], ". ")
            if tag == "lg":
                return self.joined([t for t in (self.of(x).strip() for x in self.below(e, "l")) if t], " ")
            if tag == "table":
                rows = [[self.of(c).replace("\n", " ").strip() for c in self.below(r, "cell")] for r in self.below(e, "row")]
                return self.joined([" ".join(r) for r in rows if r], ". ")
        elif tag in _FIXED:
            return _FIXED[tag]
        if tag in ("head", "title"):
            level = {"head": "## ", "title": "# "}[tag] if not self.clean else ""
            return ("\n\n" if tag == "head" else "") + level + "".join(e.itertext()).strip() + "\n\n"
        if tag == "choice":
            pick = self.child(e, "corr")
            pick = self.child(e, "expan") if pick is None else pick
            if pick is not None:
                return self.inner(pick) if self.local else self.of(pick)
            if self.clean:
                other = next((c for c in e if self.name(c) not in ("sic", "abbr")), None)
                return "" if other is None else self.of(other)
        text = self.inner(e)
        if tag == "cell":
            return text.replace("\n", " ").strip()
        if tag in _AROUND:
            return f"\n\n{text}\n\n" if text else ""
        if not self.clean and tag in _MARKS:
            a, b = _MARKS[tag]
            return a + text + b
        return text

    def __call__(self, xml: str) -> str:
        if re.search(r"<!(?:DOCTYPE|ENTITY)", xml):
            raise ValueError("document types and entities are refused")
        root = ET.fromstring(xml.encode("utf-8"))
        for name in (f"{TEI}text", "text", f"{TEI}body", "body"):
            found = root.find(f".//{name}")
            if found is not None:
                return self.of(found)
        return self.of(root)


@components.add("extract", "tei")
class TEIExtractor(MapFn):
    name: str = Field(default="tei")
    output_format: Literal["markdown", "clean"] = Field(default="clean")
    on_error: Literal["raise", "null"] = Field(default="raise", description="What a malformed document does")
    semantics: Semantics = Field(default="compat")

    def column(self, df: DataFrame) -> Column:
        fmt, null, semantics = self.output_format, self.on_error == "null", self.semantics

        def load() -> Callable[[list[str | None]], pa.Array]:
            parse = TEIText(fmt, semantics)

            def one(x: str | None) -> str | None:
                try:
                    return parse(x or "")
                except (ET.ParseError, ValueError):
                    if null:
                        return None
                    raise

            return lambda texts: pa.array([one(x) for x in texts], pa.string())

        return text_udf("string", load)(self.text(df))
