"""Pages as trees of nodes: subtree scans of what changed, and captions told from comments by a walk over the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pages import EMPTY_TAGS, time_kind

# Characters from which a text is too long to be a time, steps of a walk, ancestors whose style counts.
SHORT, STEPS, STYLED = 40, 60, 6
#: The attribute by which a page carries elements of the scanner's own.
OWN = "data-own-ui"

NODES = "page_id long, node int, last int, depth int, parent int, prev int, tag string, text string, short string, own boolean, hidden boolean"


def declared_hidden(style: str) -> bool:
    """Whether an inline style takes an element out of sight: not displayed, invisible, cut to a pixel, or placed and clipped away."""
    said = dict(x.split(":", 1) for x in re.sub(r"\s+", "", style.lower()).split(";") if ":" in x)
    pixel = all(re.fullmatch(r"[01](\.\d+)?(px)?", said.get(k, "")) for k in ("width", "height"))
    clipped = said.get("clip") in ("rect(0,0,0,0)", "rect(0px,0px,0px,0px)") or said.get("clip-path") == "inset(50%)"
    return said.get("display") == "none" or said.get("visibility") == "hidden" or (pixel and said.get("overflow") == "hidden") or (said.get("position") == "absolute" and clipped)


class _Tree(HTMLParser):
    """Rows of a page's nodes in document order. An element without an end tag ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[dict] = [{"row": None, "child": None, "own": False, "hides": []}]

    def add(self, tag: str | None, text: str | None, up: dict, own: bool, hides: list[bool]) -> list:
        parent = up["row"][0] if up["row"] else None
        row = [len(self.rows) + 1, len(self.rows) + 1, len(self.open), parent, up["child"], tag, text, None, own, any(hides[-STYLED:])]
        self.rows.append(row)
        return row

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        up, a = self.open[-1], {k: x or "" for k, x in attrs}
        own, hides = up["own"] or OWN in a, [*up["hides"], declared_hidden(a.get("style", ""))]
        row = self.add(tag, None, up, own, hides)
        up["child"] = row[0]
        if tag in EMPTY_TAGS:
            row[7] = ""
        else:
            self.open.append({"row": row, "child": None, "own": own, "hides": hides, "said": ""})

    def end(self) -> None:
        x = self.open.pop()
        x["row"][1] = len(self.rows)
        x["row"][7] = None if x["said"] is None else x["said"].strip()

    def handle_endtag(self, tag: str) -> None:
        if any(x["row"] and x["row"][5] == tag for x in self.open):
            while self.open[-1]["row"][5] != tag:
                self.end()
            self.end()

    def handle_data(self, data: str) -> None:
        for x in self.open[1:]:
            if x["said"] is not None:
                said = (x["said"] + data).lstrip()
                x["said"] = said if len(said.rstrip()) < SHORT else None
        if data.strip():
            up = self.open[-1]
            self.add(None, " ".join(data.split()), up, up["own"], up["hides"])

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self.end()


def nodes(pages: DataFrame) -> DataFrame:
    """The nodes of pages, a row each: node (its place in document order, from 1), last (that of the last node below it), depth, parent, prev (the element before it under the same parent), tag or text, short (an element's whole text, if under 40 characters), own (under the scanner's own elements), hidden (by its style or that of five elements above).

    A node lies below another of its page when its place is within that one's node and last. One
    pass over the pages, a page at a time in memory. Null pages have no nodes; nodes of pages with
    equal page_ids would mix, so ids should tell pages apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.string()] * 3, pa.bool_(), pa.bool_()]
        names = [c.split()[0] for c in NODES.split(", ")]
        for b in batches:
            for page, html in zip(*[c.to_pylist() for c in b.columns], strict=True):
                p = _Tree()
                p.feed(html)
                p.close()
                if p.rows:
                    columns = [[page] * len(p.rows), *map(list, zip(*p.rows, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.where("html is not null").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, NODES)


# --- subtree scans -----------------------------------------------------------------------------


def scan_roots(records: DataFrame, tree: DataFrame) -> DataFrame:
    """page_id, node, last of the subtrees to scan for added nodes (page_id, node): an element itself, a text's parent.

    Nodes that are not in the tree (any more) and the scanner's own are passed over, and so are
    roots below other roots. Subtrees nest or lie apart, so a root is below another one exactly if
    a root before it in document order ends at or after it: one window over a page's roots, no pairs.
    """
    added = records.select("page_id", "node").distinct().join(tree.where("not own"), ["page_id", "node"])
    root = F.when(F.col("tag").isNull(), F.col("parent")).otherwise(F.col("node"))
    roots = added.select("page_id", root.alias("node")).where("node is not null").distinct().join(tree.select("page_id", "node", "last"), ["page_id", "node"])
    before = W.partitionBy("page_id").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    return roots.withColumn("reached", F.max("last").over(before)).where("reached is null or reached < node").select("page_id", "node", "last")


def subtree_units(roots: DataFrame, tree: DataFrame) -> DataFrame:
    """page_id, node, text of the texts below the roots, hidden and own ones aside. The roots lie apart, so the last root before a text is the only one that can hold it."""
    both = tree.where("text is not null and not own and not hidden").join(roots.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "node", F.lit(None).cast("int").alias("last"), "text")
    both = both.unionByName(roots.select("page_id", "node", "last", F.lit(None).cast("string").alias("text")))
    so_far = W.partitionBy("page_id").orderBy("node", F.col("last").isNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("end", F.last("last", True).over(so_far)).where("text is not null and node <= end").select("page_id", "node", "text")


# --- captions ----------------------------------------------------------------------------------


def time_before(tree: DataFrame, steps: int = STEPS) -> DataFrame:
    """page_id, node, kind: comment or caption by the nearest time before an element in a walk of at most `steps` steps, else null.

    A step goes to the element before under the same parent, or to the parent where there is none;
    only elements reached in the first way, whose whole text is a time, tell. Each element points
    to the next of its walk, and pointers are doubled: six equality joins look sixty-four steps
    ahead, whatever the size of a page.
    """
    e = tree.where("tag is not null")
    told = e.select("page_id", F.col("node").alias("prev"), time_kind(F.col("short")).alias("kind"))
    walk = e.select("page_id", "node", "parent", "prev").join(told, ["page_id", "prev"], "left")
    far = F.when(F.col("kind").isNotNull(), 1)
    walk = walk.select("page_id", "node", F.coalesce("prev", "parent").alias("next"), "kind", far.alias("steps"))
    for ahead in (1 << k for k in range((steps - 1).bit_length())):
        there = walk.select("page_id", F.col("node").alias("next"), F.col("next").alias("_next"), F.col("kind").alias("_kind"), (F.col("steps") + ahead).alias("_steps"))
        j = walk.join(there, ["page_id", "next"], "left")
        walk = j.select("page_id", "node", F.col("_next").alias("next"), F.coalesce("kind", "_kind").alias("kind"), F.coalesce("steps", "_steps").alias("steps"))
    return walk.select("page_id", "node", F.when(F.col("steps") <= steps, F.col("kind")).alias("kind"))


def with_time_before(tree: DataFrame) -> DataFrame:
    """page_id, node, text, kind of the texts that are shown: kind by the walk from their parent."""
    units = tree.where("text is not null and not own and not hidden").select("page_id", "node", "parent", "text")
    return units.join(time_before(tree).withColumnRenamed("node", "parent"), ["page_id", "parent"], "left").select("page_id", "node", "text", "kind")


def caption(kind: Column) -> Column:
    return F.coalesce(kind == "caption", F.lit(False))
