"""Pages as element tables: one pass over the HTML numbers the elements, and texts are spans of the page's visible text (H1, C14)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.core import let, text

#: Elements whose text isn't shown, and elements that have no end.
SKIP, VOID = {"script", "style", "noscript", "svg"}, {"br", "img", "input", "meta", "link", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}
#: Characters of HTML after which a task hands on what it has read.
BATCH_CHARS = 1 << 20
ELEMENT = "tag string, attrs map<string,string>, parent int, next int, last int, begin int, size int"


class _Reader(HTMLParser):
    """Elements in order of their start, the document itself first: [tag, attributes, parent, next sibling, last descendant, first word, words].

    An end tag closes the nearest open element of its name and all within it; one that none is open for is left out.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = [["", {}, -1, -1, 0, 0, 0]]
        self.open, self.hidden, self.words = [0], 0, []
        self.newest: dict[int, int] = {}  # the last child so far
        self.feed(html)
        self.close()
        self._end(0)

    def handle_starttag(self, tag, attrs):
        me, parent = len(self.elements), self.open[-1]
        if parent in self.newest:
            self.elements[self.newest[parent]][3] = me
        self.newest[parent] = me
        self.elements.append([tag, {k: v or "" for k, v in attrs}, parent, -1, me, len(self.words), 0])
        if tag not in VOID:
            self.open.append(me)
            self.hidden += tag in SKIP

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.elements[self.open[k]][0] == tag), 0)
        if at:
            self._end(at)

    def _end(self, at: int) -> None:
        for k in self.open[at:]:
            e = self.elements[k]
            e[4], e[6] = len(self.elements) - 1, len(self.words) - e[5]
            self.hidden -= e[0] in SKIP
        del self.open[at:]

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def page_elements(html: str) -> tuple[str, list[tuple]]:
    """The visible text of a page, words apart by single spaces, and its elements with spans of it."""
    page = _Reader(html)
    start = [0]
    for w in page.words:
        start.append(start[-1] + len(w) + 1)
    return " ".join(page.words), [(*e[:5], start[e[5]], max(0, start[e[5] + e[6]] - start[e[5]] - 1)) for e in page.elements]


def elements(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, said (the page's visible text) and elements, an array in order of their starts: tag, attrs, parent, next (sibling) and last (descendant) by their places in the array (from 0; -1: none), and begin and size of the text in `said`.

    An element's descendants are those up to `last`; its text is a span, so nested elements copy nothing and a page's
    row is as long as the page. Scripts, styles and drawings have no text. A null page is an empty one.
    """
    kind = pages.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENT.split(", ")]
        for pdf in batches:
            made, held = [], 0
            for i, h in zip(pdf["id"], pdf["html"], strict=True):
                said, found = page_elements(h or "")
                made.append((i, said, [dict(zip(names, e, strict=True)) for e in found]))
                held += len(h or "")
                if held >= BATCH_CHARS:
                    yield pd.DataFrame(made, columns=["id", "said", "elements"])
                    made, held = [], 0
            yield pd.DataFrame(made, columns=["id", "said", "elements"])

    shape = ", ".join(c.replace(" ", ":", 1) for c in ELEMENT.split(", "))
    return pages.select(F.col(id).alias("id"), F.col(html).alias("html")).mapInPandas(run, f"id {kind}, said string, elements array<struct<{shape}>>").withColumnRenamed("id", id)


def span(e: Column) -> Column:
    """The text of an element of the row; null for none."""
    return F.substring(F.col("said"), e["begin"] + 1, e["size"])


def at(place: Column) -> Column:
    """The element at a place; null if there is none."""
    return F.when(place >= 0, F.get(F.col("elements"), place))


def attribute(e: Column, name: str) -> Column:
    return F.lower(text(F.try_element_at(e["attrs"], F.lit(name))))


def below(e: Column, fits) -> Column:
    """The descendants of an element of the column `placed` that fit, in order."""
    return F.filter(F.slice("placed", e["place"] + 2, e["last"] - e["place"]), fits)


def placed() -> Column:
    """The elements with their places."""
    return F.transform("elements", lambda e, i: F.struct(i.alias("place"), *[e[c].alias(c) for c in ("tag", "attrs", "parent", "next", "last", "begin", "size")]))


def accordions(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """C14: id, how_to_use, ingredients, disclaimer: what a page's accordions say, null where they say nothing.

    An accordion's content is the element of its usual id, else that which the first button of its title names
    (aria-controls). Its text is that of the first descendant of class "markdown"; the disclaimer's has a class of its own.
    """

    def by_id(name: Column) -> Column:
        return F.get(F.filter("placed", lambda e: F.try_element_at(e["attrs"], F.lit("id")) == name), F.lit(0))

    def content(usual: str, titles: list[str]) -> Column:
        title = lambda b: F.lower(F.trim(F.coalesce(F.nullif(F.try_element_at(b["attrs"], F.lit("title")), F.lit("")), span(b))))
        button = F.filter("placed", lambda e: (e["tag"] == "button") & title(e).isin(titles) & (text(F.try_element_at(e["attrs"], F.lit("aria-controls"))) != ""))
        named = F.get(F.filter(F.transform(button, lambda b: by_id(F.try_element_at(b["attrs"], F.lit("aria-controls")))), lambda c: c.isNotNull()), F.lit(0))
        return F.coalesce(by_id(F.lit(usual)), named)

    def first(e: Column, name: str) -> Column:
        has = lambda x: F.array_contains(F.split(text(F.try_element_at(x["attrs"], F.lit("class"))), r"\s+"), name)
        return F.nullif(span(F.get(below(e, has), F.lit(0))), F.lit(""))

    rows = elements(pages, id, html).withColumn("placed", placed())
    rows = rows.withColumns({"how": content("accordion-toggle-How to Use", ["how to use"]), "what": content("accordion-toggle-Ingredients and Safety", ["ingredients and safety", "ingredients & safety"])})
    return rows.select(id, first(F.col("how"), "markdown").alias("how_to_use"), first(F.col("what"), "markdown").alias("ingredients"), first(F.col("what"), "product-details-accordions-ingredients-disclaimer").alias("disclaimer"))


#: Elements that can be a label, the words of one, and how many siblings after it and ancestors around it are taken.
LABELS = ["h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "span", "p", "div"]
WORD_EN, WORD_ZH = r"(?i)\b(?:ingredients?|inci)\b", "全成分|成分|配料|配方"
NEAR, AROUND = 4, 4


def blocks(pages: DataFrame, market: str = "market") -> DataFrame:
    """H1: page_id, pos, kind, block, for pages (page_id, html, market): texts that may hold ingredients.

    In order: paragraphs of pop-ups (popup); elements with ingredient-like ids or classes (named); and for each label
    its own text (label), the next four siblings (near) and four ancestors (around). Texts of over ten characters
    count, of ancestors over twenty, of pop-ups all. An element counts once a kind, at its first place: siblings and
    ancestors that several labels share are no new texts. A page without html has none.
    """
    rows = _with_market(pages, market)
    chinese = F.upper(F.trim(text(F.col("market")))).isin("CN", "CHN", "CHINA")
    refer = lambda kind, place: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"))
    none = F.array().cast("array<struct<kind:string,place:int>>")

    def popup(e: Column) -> Column:
        return let(below(e, lambda x: x["tag"].isin("p", "li")), lambda ps: F.when(F.size(ps) > 0, F.transform(ps, lambda p: refer("popup", p["place"]))).otherwise(F.array(refer("popup", e["place"]))))

    def label(e: Column) -> Column:
        near, around, n, a = [], [], e["next"], e["parent"]
        for k in range(max(NEAR, AROUND)):
            near += [n] if k < NEAR else []
            around += [a] if k < AROUND else []
            n, a = at(n)["next"], at(a)["parent"]
        refs = F.array(refer("label", e["place"]), *[refer("near", p) for p in near], *[refer("around", p) for p in around])
        return F.filter(refs, lambda r: r["place"] >= 0)

    def is_label(e: Column) -> Column:
        short = e["tag"].isin(LABELS) & (e["size"] > 0) & (e["size"] <= 120)
        return short & F.when(chinese, span(e).rlike(WORD_ZH)).otherwise(span(e).rlike(WORD_EN))

    like = lambda e: F.contains(attribute(e, "id"), F.lit("ingredient")) | F.contains(attribute(e, "class"), F.lit("ingredient")) | F.contains(attribute(e, "data-testid"), F.lit("ingredient"))
    rows = rows.withColumn("placed", placed())
    popups = F.flatten(F.transform(F.filter("placed", lambda e: F.contains(text(F.try_element_at(e["attrs"], F.lit("class"))), F.lit("ingredients-popup"))), popup))
    named = F.transform(F.filter("placed", like), lambda e: refer("named", e["place"]))
    labels = F.flatten(F.transform(F.filter("placed", is_label), label))
    refs = F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (popups, named, labels)]))
    found = rows.select("page_id", "said", "elements", F.posexplode(refs).alias("pos", "ref")).select("page_id", "pos", "ref.kind", span(at(F.col("ref.place"))).alias("block"))
    least = F.when(F.col("kind") == "popup", 1).when(F.col("kind") == "around", 21).otherwise(11)
    return found.filter(F.length("block") >= least)


def _with_market(pages: DataFrame, market: str) -> DataFrame:
    """elements of pages with their market, in one pass: the market travels with the id."""
    key = F.struct(F.col("page_id"), F.col(market).alias("market"))
    return elements(pages.select(key.alias("key"), "html"), "key").select("key.page_id", "key.market", "said", "elements")
