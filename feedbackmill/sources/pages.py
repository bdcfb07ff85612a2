"""Reviews from stored web pages, found by tag and class."""

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.functions.labels import name_or_unknown
from feedbackmill.functions.ratings import first_number
from feedbackmill.functions.text import strip
from feedbackmill.schemas import UNKNOWN

# HTML elements that have no end tag.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements that begin a line when a page is shown, and those that are not shown.
LINE_TAGS = frozenset("article br div h1 h2 h3 h4 h5 h6 li ol p section table tr ul".split())
HIDDEN_TAGS = frozenset("noscript script style template".split())


@dataclass(frozen=True)
class Selectors:
    """``tag``, ``.class`` or ``tag.class`` of the container and of each field inside it."""

    container: str = ".jftiEf"
    user_name: str = ".d4r55"
    rating: str = ".kvMYJc"
    date: str = ".rsqaWe"
    review_text: str = ".wiI7pd"
    # Fields read from an attribute of the element instead of its text.
    attributes: dict[str, str] = field(default_factory=lambda: {"rating": "aria-label"})

    FIELDS = ("user_name", "rating", "date", "review_text")


def _matches(selector: str, tag: str, classes: list[str]) -> bool:
    name, _, wanted = selector.partition(".")
    return (not name or name == tag) and (not wanted or wanted in classes)


class _ItemParser(HTMLParser):
    """Collects one dict per container element; the first match of a field wins."""

    def __init__(self, selectors: Selectors):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.items: list[dict[str, str]] = []
        self.stack: list[tuple[str, bool, list[str]]] = []  # tag, opens an item, open fields
        self.current: list[dict[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in LINE_TAGS:
            self._add_text("\n")
        attributes = dict(attrs)
        classes = (attributes.get("class") or "").split()
        opens = _matches(self.selectors.container, tag, classes)
        if opens:
            self.items.append({})
            self.current.append(self.items[-1])
        fields = []
        if self.current and not opens:
            for name in Selectors.FIELDS:
                selector = getattr(self.selectors, name)
                if name in self.current[-1] or not _matches(selector, tag, classes):
                    continue
                source = self.selectors.attributes.get(name)
                self.current[-1][name] = attributes.get(source) or "" if source else ""
                if not source:
                    fields.append(name)
        if tag in VOID_TAGS:
            if opens:
                self.current.pop()
        else:
            self.stack.append((tag, opens, fields))

    def handle_endtag(self, tag):
        if not any(entry[0] == tag for entry in self.stack):
            return
        while self.stack:  # elements left open inside this one end with it
            name, opens, _ = self.stack.pop()
            if opens:
                self.current.pop()
            if name == tag:
                break
        if tag in LINE_TAGS:
            self._add_text("\n")

    def handle_data(self, data):
        if not self.stack or self.stack[-1][0] not in HIDDEN_TAGS:
            self._add_text(data)

    def _add_text(self, data):
        if self.current:
            for _, opens, fields in reversed(self.stack):
                for name in fields:
                    self.current[-1][name] += data
                if opens:
                    return


def _items(html: str | None, selectors: Selectors) -> list[dict[str, str]]:
    parser = _ItemParser(selectors)
    parser.feed(html or "")
    parser.close()
    return parser.items


def dataset_of(url: Column) -> Column:
    """Dataset of a page; pages stored without an address share one."""
    return F.coalesce(url, F.lit(UNKNOWN))


def page_items(
    pages: DataFrame, selectors: Selectors = Selectors(), max_items: int | None = None
) -> DataFrame:
    """One row per container in ``pages`` (page_id, url, html), missing fields defaulted."""
    names = ["page_id", "url", "item_pos", *Selectors.FIELDS]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page_id, url, pos, *(item.get(name) for name in Selectors.FIELDS))
                for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"])
                for pos, item in enumerate(_items(html, selectors))
            ]
            yield pd.DataFrame(rows, columns=names)

    found = pages.select("page_id", "url", "html").mapInPandas(
        extract,
        "page_id long, url string, item_pos int,"
        " user_name string, rating string, date string, review_text string",
    )
    if max_items is not None:
        found = found.where(F.col("item_pos") < max_items)
    return found.select(
        "page_id",
        dataset_of(F.col("url")).alias("business_url"),
        "item_pos",
        name_or_unknown(strip(F.col("user_name"))).alias("user_name"),
        F.coalesce(first_number(F.col("rating")), F.lit(0.0)).alias("rating"),
        F.coalesce(strip(F.col("date")), F.lit(UNKNOWN)).alias("date"),
        F.coalesce(strip(F.col("review_text")), F.lit("")).alias("review_text"),
    )


def register_page_items(session: SparkSession, selectors: Selectors = Selectors(), name: str = "page_items") -> None:
    """Make the extraction a table function for SQL: ``FROM pages p, LATERAL page_items(p.html) i``.

    It gives a row per container with its place and its fields as they stand in the page, null if absent.
    """

    class PageItems:
        def eval(self, html: str):
            for pos, item in enumerate(_items(html, selectors)):
                yield pos, *(item.get(field) for field in Selectors.FIELDS)

    columns = "item_pos int, " + ", ".join(f"{field} string" for field in Selectors.FIELDS)
    session.udtf.register(name, F.udtf(PageItems, returnType=columns, useArrow=True))
