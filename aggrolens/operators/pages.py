"""Text units of HTML pages and rules on them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab as v

# Elements and attributes under which text is not read.
SKIPPED_TAGS = frozenset("nav header footer aside script style noscript input textarea select button code pre".split())
SKIPPED_ROLES = frozenset("navigation banner menubar toolbar complementary button menu menuitem option tooltip".split())
SKIPPED_CLASSES = ("nav", "menu", "sidebar", "toolbar")
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Units(HTMLParser):
    """Text nodes in document order with their parent's tag, whether they may be read, are in a shadow root, and are under a label of a chat dock or profile card."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.units: list[tuple[str, str, bool, bool, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in EMPTY_TAGS:
            return
        a = {k: x or "" for k, x in attrs}
        skip = tag in SKIPPED_TAGS or a.get("role") in SKIPPED_ROLES or "data-ad" in a or a.get("aria-label") == "Sponsored" or any(c in a.get("class", "") for c in SKIPPED_CLASSES) or "hidden" in a
        style = a.get("style", "").replace(" ", "").lower()
        skip = skip or "display:none" in style or "visibility:hidden" in style or (tag == "template" and a.get("shadowrootmode") != "open") or tag == "title"
        label = a.get("aria-label", "").strip().lower()
        aside = "messenger" in label or "conversation" in label or label in v.CARD_TITLES
        up = self.stack[-1] if self.stack else ("", False, False, False)
        self.stack.append((tag, up[1] or skip, up[2] or (tag == "template"), up[3] or aside))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if text:
            tag, skipped, shadow, aside = self.stack[-1] if self.stack else ("", False, False, False)
            self.units.append((tag, text, skipped, shadow, aside))


def text_units(pages: DataFrame) -> DataFrame:
    """page_id, url, seq, tag, text, skipped, shadow, aside of every text node. One pass over the pages, no shuffle; null pages have none. Layout is unknown here, so only declared hiding counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, url, html in zip(*[c.to_pylist() for c in b.columns], strict=True):
                p = _Units()
                p.feed(html)
                p.close()
                n = len(p.units)
                if n:
                    columns = [pa.array([page] * n, pa.int64()), pa.array([url] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), *(pa.array(list(c)) for c in zip(*p.units, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "seq", "tag", "text", "skipped", "shadow", "aside"])

    return pages.where("html is not null").select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, seq int, tag string, text string, skipped boolean, shadow boolean, aside boolean")


def ui_label(text: Column) -> Column:
    """Texts that belong to a page's controls and counters."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[·•|].*$", ""))
    return bare.isin(v.UI_LABELS) | bare.rlike(r"^comment as\b") | bare.rlike(v.COUNTERS[0]) | bare.rlike(v.COUNTERS[1])


def name_link(tag: Column, text: Column) -> Column:
    """A link that shows a person's name: up to five capitalised words."""
    words = F.split(F.trim(text), r"\s+")
    return (tag == "a") & (F.size(words) <= 5) & F.forall(words, lambda w: w.rlike(r"^[A-Z][a-zA-Z'.-]*$"))


def time_kind(text: Column) -> Column:
    """comment for a relative time, caption for a date or clock time, in short texts; else null."""
    short = (F.length(F.trim(text)) > 0) & (F.length(F.trim(text)) < 40)
    return F.when(short & F.trim(text).rlike(v.RELATIVE_TIME), "comment").when(short & text.rlike(v.ABSOLUTE_TIME), "caption")


def with_time_kind(units: DataFrame, steps: int = 60) -> DataFrame:
    """units with time_kind: that of the last time among the `steps` units before, in page order, which tells captions from comments."""
    before = W.partitionBy("page_id").orderBy("seq").rowsBetween(-steps, -1)
    return units.withColumn("time_kind", F.last(time_kind(F.col("text")), True).over(before))


def in_private_card(units: DataFrame) -> Column:
    """Units under a chat dock's or profile card's label, on the hosts that have them. Where on the screen an element stands is unknown here."""
    host, test = host_of(units["url"]), F.lit(False)
    for x in v.CARD_HOSTS:
        test = test | F.contains(host, F.lit(x))
    return test & units["aside"]


def readable_units(units: DataFrame, blocklist: list[str] = v.BLOCKLIST) -> DataFrame:
    """Units worth scanning: not skipped, no control, name, bare number or address, chat dock, profile card or (with time_kind) caption; what the blocklist names always counts unless skipped."""
    text = F.col("text")
    dull = ui_label(text) | name_link(F.col("tag"), text) | text.rlike(r"^[\d\s.,:/%+-]+$") | text.rlike(r"^(https?://|www\.)\S+$")
    named = F.exists(t.strings(blocklist), lambda w: F.contains(F.lower(text), w))
    dull = dull | in_private_card(units) | F.coalesce(F.col("time_kind") == "caption", F.lit(False)) if "time_kind" in units.columns else dull | in_private_card(units)
    return units.where(~F.col("skipped") & (named | ~dull))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def private_strict(url: Column) -> Column:
    """Private by exact host or subdomain, path prefixes in any case; an address that can't be read is private."""
    h, p = host_of(url), F.lower(path_of(url))
    under = lambda x: (h == x) | F.endswith(h, F.lit("." + x))
    test = F.coalesce(h == "", F.lit(True))
    for x in v.PRIVATE_HOSTS:
        test = test | under(x)
    for x, start in v.PRIVATE_PATHS:
        test = test | (under(x) & F.startswith(p, F.lit(start)))
    return test


def private_legacy(url: Column) -> Column:
    """Private by any part of the host; path prefixes as written."""
    h, p = host_of(url), path_of(url)
    test = F.lit(False)
    for x in v.PRIVATE_HOSTS:
        test = test | F.contains(h, F.lit(x))
    for x, start in v.PRIVATE_PATHS:
        test = test | (F.contains(h, F.lit(x)) & F.startswith(p, F.lit(start)))
    return test


def platform(url: Column) -> Column:
    h = host_of(url)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in v.PLATFORMS.items() for x in kv]), h), h)
