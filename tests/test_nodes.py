"""Trees of pages, subtree scans and the walk to a time, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from aggrolens.functions import vocab as v
from aggrolens.operators import nodes as t
from aggrolens.plans import QUERIES
from aggrolens.storage import shared_path
from aggrolens.streaming import changes

HTML = [
    "<div><p>first <b>bold</b> word</p><span>5 min</span><div><p>a comment</p></div><span>March 3 at 10:15 am</span><section><ul><li>one<li>two</ul><p>caption</p></section></div><br>tail",
    "<div style='display: none'><p>gone</p></div><div style='position:absolute; clip: rect(0px, 0px, 0px, 0px)'><i>clipped</i></div><div style='width:1px;height:1px;overflow:hidden'>pixel</div><div style='position:absolute;clip-path:inset(50%)'>inset</div><div style='width:10px;height:1px;overflow:hidden'>shown</div>",
    "<div style='visibility:hidden'><a><b><c><d><e>five below<f>six below</f></e></d></c></b></a></div>",
    f"<div {t.OWN}><p>panel</p></div><p>page <span {t.OWN}>badge</span></p>",
    "", None, "no tags at all", "</p></div>stray<p>open", "<p>&amp; &lt;x&gt;</p><img><p>" + "long " * 20 + "</p>",
]


def random_page(r):
    out = []
    for _ in range(r.randint(1, 60)):
        out.append(r.choice(["<div>", "<p>", "<span>", "</div>", "</p>", "</span>", "text", "5 min", "March 3", "<span>2 h</span>", "<b>at 10:15 am</b>", "<br>", " "]))
    return "".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(5)
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(HTML + [random_page(r) for _ in range(40)])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def tree(pages):
    rows = t.nodes(pages).collect()
    return {p: {r.node: r for r in rows if r.page_id == p} for p in {r.page_id for r in rows}}


def test_tree(tree):
    for page in tree.values():
        assert sorted(page) == list(range(1, len(page) + 1))
        for r in page.values():
            below = [x.node for x in page.values() if r.node < x.node <= r.last]
            up = page.get(r.parent)
            assert up is None or (up.node < r.node <= r.last <= up.last and r.depth == up.depth + 1)
            assert all(page[x].depth > r.depth for x in below) and (r.tag or r.last == r.node)
            elders = [x.node for x in page.values() if x.parent == r.parent and x.node < r.node and x.tag]
            assert r.prev == (max(elders) if elders else None)
    assert {r.text: r.hidden for r in tree[1].values() if r.text} == {"gone": True, "clipped": True, "pixel": True, "inset": True, "shown": False}
    assert {r.text: r.hidden for r in tree[2].values() if r.text} == {"five below": True, "six below": False}
    assert {r.text: r.own for r in tree[3].values() if r.text} == {"panel": True, "page": False, "badge": True}
    assert 4 not in tree and 5 not in tree and [r.short for r in tree[8].values() if r.tag] == ["& <x>", "", None]


def walked(page, node):
    """The reference form of the walk: a loop."""
    at, steps = page[node], 0
    while steps < t.STEPS:
        if at.prev is not None:
            at, steps = page[at.prev], steps + 1
        elif at.parent is not None:
            at, steps = page[at.parent], steps + 1
            continue
        else:
            return None
        text = (at.short or "").strip()
        if 0 < len(text) < 40:
            import re

            if re.search(v.RELATIVE_TIME, text):
                return "comment"
            if re.search(v.ABSOLUTE_TIME, text):
                return "caption"
    return None


def test_walk_is_a_loop(spark, pages, tree):
    got = {(r.page_id, r.node): r.kind for r in t.time_before(t.nodes(pages)).collect()}
    want = {(p, n): walked(page, n) for p, page in tree.items() for n, r in page.items() if r.tag}
    assert got == want and {"comment", "caption", None} <= set(want.values())


@pytest.mark.parametrize("between", [58, 59, 60, 61])
def test_walk_ends(spark, between):
    html = "<i>5 min</i>" + "<b></b>" * (between - 1) + "<p>x</p>"
    d = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    last = t.time_before(t.nodes(d)).orderBy(F.desc("node")).first()
    assert last.kind == ("comment" if between <= 60 else None)


def test_captions_of_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = t.nodes(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    page = {}
    for r in rows:
        page.setdefault(r.page_id, {})[r.node] = r
    got = {(r.page_id, r.node): r.kind for r in QUERIES["page_caption_walk"](spark, sf).collect()}
    want = {(r.page_id, r.node): walked(page[r.page_id], r.parent) if r.parent else None for r in rows if r.text and not r.own and not r.hidden}
    assert got == want


def scanned_by_hand(tree, records):
    out = set()
    for p, node in records:
        r = tree.get(p, {}).get(node)
        if r is None or r.own:
            continue
        root = r if r.tag else tree[p].get(r.parent)
        if root is not None:
            out |= {(p, x.node) for x in tree[p].values() if x.text and not x.own and not x.hidden and root.node <= x.node <= root.last}
    return out


def test_roots_and_subtrees(spark, pages, tree):
    r = random.Random(8)
    for share in (0.05, 0.3, 1.0):
        records = [(p, n) for p, page in tree.items() for n in [*page, 10**6] if r.random() < share] * 2
        d = spark.createDataFrame(records, "page_id long, node int")
        roots = t.scan_roots(d, t.nodes(pages)).collect()
        assert not any(a.page_id == b.page_id and a.node < b.node <= a.last for a in roots for b in roots)
        units = t.subtree_units(t.scan_roots(d, t.nodes(pages)), t.nodes(pages)).collect()
        assert len(units) == len(set(units)) and {(x.page_id, x.node) for x in units} == scanned_by_hand(tree, records)


def test_stream_scans_each_node_once(spark, pages, tree):
    records = changes.change_records(t.nodes(pages))
    got = changes.scan_changes(pages, files=1).collect()
    assert len(got) == len({(x.page_id, x.node) for x in got})
    assert {(x.page_id, x.node) for x in got} == scanned_by_hand(tree, [(x.page_id, x.node) for x in records.collect()])


def test_stream_after_failure(spark, pages):
    """A batch that failed half-way runs again and is there once."""
    path = shared_path(spark, "again")
    tree = t.nodes(pages)
    changes.change_records(tree).coalesce(2).write.parquet(f"{path}/records")
    stream = lambda: spark.readStream.schema(changes.RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{path}/records")
    first = changes.scanned(stream(), tree, f"{path}/a").collect()
    changes.scanned(stream().where("page_id < 3"), tree, f"{path}/b")
    (spark.createDataFrame([(99, 99, "half")], changes.UNITS)).write.mode("overwrite").parquet(f"{path}/c/rows/batch=0")
    third = changes.scanned(stream(), tree, f"{path}/c").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, third))
