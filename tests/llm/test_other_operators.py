"""WARC, vectors, curves, components and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from aggrolens.llm import ann, common, embedding_dedup, hilbert, warc

SF = "/root/testdata/sf0.001"


def test_warc(spark, tmp_path):
    r = random.Random(1)
    html = ["", None, "<p>é</p>", "x\r\n\r\nWARC/1.1\r\n", *("".join(r.choices("abé\r\n0", k=r.randint(1, 9000))) for _ in range(30))]
    html += html[:12] + ["long " * 40_000]
    rows = [(i, f"http://h/{i}", t, 1) for i, t in enumerate(html)] + [(3, "http://again", html[3], 1), (None, "u", "null id", 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    got = warc.archived_pages(d, segment_bytes=700, chunk_bytes=300, file_bytes=14_000).collect()
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        head = first.get(t or "")
        again = head is not None and head != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", head if again else None, True))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archived_pages(d.limit(0)).count() == 0


def test_warc_payloads_and_damage(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "é" * 3000), (2, "u", "short")], "page_id long, url string, html string")
    warc.write(d, str(tmp_path / "w"), segment_bytes=1000)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, str(tmp_path / "w")).collect()} == {1: "é" * 3000, 2: "short"}
    recs = warc.records(spark, str(tmp_path / "w"))
    assert recs.where("kind = 'continuation'").count() > 3
    broken = warc.payloads(warc.reassembled(recs.where("segment is null or segment <> 3"))).collect()
    assert {r.page_id: r.valid for r in broken} == {1: False, 2: True}


def test_warc_files_are_bounded(spark, tmp_path):
    d = spark.createDataFrame([(i, "u", f"{i}" + "".join(random.Random(i).choices("abcdefgh", k=50_000))) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write(d, str(tmp_path / "w"), segment_bytes=1000, file_bytes=100_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 5 and max(sizes) < 160_000
    assert warc.read(spark, str(tmp_path / "w")).where("valid").count() == 12


def test_warc_stream_holds_little():
    """A file of many members is read as it is unzipped: the first record is there while the rest is still stored."""
    one = lambda i: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: 1000000\r\n\r\n%s\r\n\r\n" % (i, b"a" * 1_000_000)
    data = b"".join(gzip.compress(one(i)) for i in range(60))
    tracemalloc.start()
    assert sum(len(r[-1]) for r in warc.parsed(data)) == 60_000_000
    assert tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("harm", ["header", "length", "cut", "noise", "gzip"])
def test_warc_of_broken_records(harm, piece, monkeypatch):
    """A broken record is one row of its own, and those around it are read."""
    monkeypatch.setattr(warc, "PIECE", piece)
    one = lambda i, body, length=None: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, i, len(body) if length is None else length, body)
    a, b, c = one(1, b"first"), one(2, b"second"), one(3, b"third")
    data = {"header": a + b.replace(b"WARC-Type: response\r\n", b"") + c, "length": a + b.replace(b"Content-Length: 6", b"Content-Length: six") + c, "cut": a + b + c[:-9], "noise": a + b"rubbish\r\n\r\n" + c, "gzip": gzip.compress(a) + gzip.compress(c)[:-3] + b"x"}[harm]
    kinds = [(r[1], r[2]) for r in warc.parsed(data)]
    want = {"cut": [("response", 1), ("response", 2), ("broken", None)], "gzip": [("response", 1), ("response", 3)]}
    assert kinds == want.get(harm, [("response", 1), ("broken", None), ("response", 3)])
    assert all(r[-1] is not None for r in warc.parsed(data))


def test_chunks():
    for n in (0, 1, 299, 300, 301, 5000):
        b = bytes(range(256)) * 20
        assert warc.unchunked(warc.chunked(b[:n], 300)) == b[:n]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    base = r.standard_normal((1200, 24))
    near = base[r.integers(0, 40, 400)] + r.standard_normal((400, 24)) * r.uniform(0.05, 0.6, (400, 1))
    v = [list(map(float, np.float32(x))) for x in np.vstack([base, near])]
    v += [v[0]] * 30 + [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [None], [1.0, 2.0], [float("inf")] + [1.0] * 23]
    return v


def frame(spark, vectors):
    return spark.createDataFrame([(i, x, 0, i) for i, x in enumerate(vectors)], "vec_id long, embedding array<float>, label int, n long")


def cosines(vectors):
    ok = [i for i, x in enumerate(vectors) if x and len(x) == 24 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    m = np.array([vectors[i] for i in ok])
    n = np.linalg.norm(m, axis=1)
    return ok, m @ m.T / np.outer(n, n)


def test_embedding_links(spark, vectors):
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, vectors)).collect()}
    ok, s = cosines(vectors)
    link = s >= 0.9
    np.fill_diagonal(link, False)
    assert len(got) == len(vectors)
    found, want = sum(got[i].n_links for i in ok), int(link.sum())
    assert found <= want and found >= 0.995 * want
    assert all(got[i].n_links <= link[k].sum() for k, i in enumerate(ok))
    root = list(range(len(ok)))
    while True:
        new = [min([root[k], *(root[j] for j in np.flatnonzero(link[k]))]) for k in range(len(ok))]
        if new == root:
            break
        root = new
    assert np.mean([got[i].component_id == ok[root[k]] for k, i in enumerate(ok)]) > 0.99
    for i in set(range(len(vectors))) - set(ok):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert embedding_dedup.near_duplicates(frame(spark, vectors).limit(0)).count() == 0


def test_links_at_the_threshold():
    """A pair's link does not hang on the block in which it is found."""
    r = np.random.default_rng(3)
    v = r.standard_normal((300, 24))
    w = r.standard_normal((300, 24))
    at = float((v[5] * w[9]).sum() / (np.linalg.norm(v[5:6], axis=1)[0] * np.linalg.norm(w[9:10], axis=1)[0]))
    for lo in (5, 3, 0):
        for hi in (10, 11, 64, 300):
            assert embedding_dedup.linked(v[lo:hi], w[lo:hi], at)[5 - lo, 9 - lo]
            assert not embedding_dedup.linked(v[lo:hi], w[lo:hi], float(np.nextafter(at, 1)))[5 - lo, 9 - lo]


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        g = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        o = np.argsort(k := hilbert.hilbert_keys(g, bits))
        assert sorted(k) == list(range(len(g))) and (np.abs(np.diff(g[o], axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark, vectors):
    got = ann.nearest(frame(spark, vectors), F.col("vec_id") % 50 == 0, block=8).collect()
    ok, s = cosines(vectors)
    hit = total = 0
    for k, i in enumerate(ok):
        if i % 50 == 0:
            mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
            best = sorted((j for j in range(len(ok)) if j != k), key=lambda j: (-round(s[k, j], 12), ok[j]))[:5]
            assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(s[k, ok.index(r.vec_id)], abs=1e-12) for r in mine)
            hit, total = hit + len({ok[j] for j in best} & {r.vec_id for r in mine}), total + 5
    assert hit >= 0.9 * total
    few = frame(spark, vectors).where("vec_id < 3")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 2 and ann.nearest(few.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("block,reach", [(256, 1), (8, 20)])
def test_neighbours_of_ties(spark, block, reach):
    base = np.random.default_rng(4).standard_normal(24)
    ids = random.Random(4).sample(range(1000), 64)
    v = [list(map(float, base * 2.0 ** (i - 20))) for i in range(40)] + [[float(i == j) for j in range(24)] for i in range(24)]
    d = spark.createDataFrame(list(zip(ids, v, strict=True)) + [(None, [float(x) for x in base * 2.0**30])], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in ann.nearest(d, F.col("vec_id").isNotNull(), block=block, reach=reach).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for k, i in enumerate(ids[:40]):
        assert [got[i][x] for x in range(1, 6)] == sorted(set(ids[:40]) - {i})[:5], k
    for k, i in enumerate(ids[40:]):
        near = sorted(((-base[k] / np.linalg.norm(base), j) for j in ids[:40]) if base[k] > 0 else ((0.0, j) for j in ids[40:] if j != i))
        assert [got[i][x] for x in range(1, 6)] == [j for _, j in near][:5], k


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(4000, 4100)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_duplicate_rows(spark):
    import corpus_pipeline as p

    r = random.Random(6)
    w = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [r.choices(w, k=60) for _ in range(12)]
    rows = [(r.choice([None, *range(8)]), " ".join([*t[:k], "other", *t[k + 1 :]] if (k := r.choice([-1, 58, 59])) > 0 else t), "en", "a", 1) for t in r.choices(texts, k=60)]
    rows += [(None, "null and alone", "en", "a", 1), (None, None, "en", "a", 1), (None, " ", "en", "a", 1), (3, "", "en", "a", 1), (3, "", "en", "a", 1), (3, "three and alone", "en", "a", 1), (None, "only null copies", "en", "a", 1), (None, "only null copies", "en", "a", 1)]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if (x := (t or "").split()) else set() for _, t, *_ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    want = [(None if root[i] != i else min((rows[j][0] for j in range(len(rows)) if root[j] == i), key=lambda x: (x is None, x or 0)), root[i]) for i in range(len(rows))]
    want = sorted([(a, i) for i, (a, k) in enumerate(want) if k == i], key=repr)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_duplicate_stage(spark, d.repartition(5), SF)
    assert kept.columns == d.columns
    part = {}
    for i, x in enumerate(rows):
        part.setdefault((x[0], x[1]), root[i] if sets[i] else "none")
    got = [(x.doc_id, part[x.doc_id, x.text]) for x in kept.collect()]
    assert sorted((x for x in got if x[1] != "none"), key=repr) == [(a, i) for a, i in want if sets[i]]
    assert len([x for x in got if x[1] == "none"]) == sum(not x for x in sets)


def stage_rows(spark, n=1):
    """Rows with null and repeated ids, empty, null and long texts, copies and a secret."""
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:39], "x"])), (2, "an other text of the same id"), (None, " ".join(w)), (None, "a null id"), (3, ""), (4, None), (5, "password = hunter2hunter2"), (6, "x" * 300_000), (7, "word " * 60_000)]
    return spark.createDataFrame([(i, t, "en", ["a", "b", None][k % 3], -1) for k, (i, t) in enumerate(rows * n)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_of_odd_rows(spark, tmp_path):
    """Each stage alone against what it should do row by row; toxic words are planted for the first."""
    import corpus_pipeline as p

    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(100, 400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    r, say = random.Random(3), [f"plain{i}" for i in range(300)]
    made = [(i, " ".join(r.choices(say, k=30) + (["vileword", r.choice(say), "vileword"] if i % 3 == 0 else [])), "en", "a", 1) for i in range(100, 400)]
    odd = stage_rows(spark)
    docs = odd.union(spark.createDataFrame(made, odd.schema))
    left = p.toxicity_stage(spark, docs, str(tmp_path)).collect()
    gone = {i for i, *_ in made} - {x.doc_id for x in left}
    assert gone == {i for i, *_ in made if i % 3 == 0} and len(left) == docs.count() - len(gone)
    kept = sorted(((x.doc_id, x.text) for x in p.near_duplicate_stage(spark, odd, SF).collect()), key=repr)
    w = " ".join(f"w{i}" for i in range(40))
    assert kept == sorted([(x.doc_id, x.text) for x in odd.collect() if x.text is None or not (x.text.startswith("w0") and (x.doc_id, x.text) != (1, w))], key=repr)
    found = p.secret_stage(spark, odd, SF).collect()
    assert len(found) == odd.count() and [x.text for x in found if x.doc_id == 5] == ["[SECRET]"]
    assert sorted(repr((x.doc_id, x.text)) for x in found if x.doc_id != 5) == sorted(repr((x.doc_id, x.text)) for x in odd.collect() if x.doc_id != 5)
    assert all(x.n_chars == len(x.text or "") or x.n_chars == -1 or x.text is None for x in found)
    mixed = p.mixing_stage(spark, odd, SF)
    taken, texts = mixed.collect(), {x.text for x in odd.collect() if (x.text or "").split()}
    whole = [x for x in taken if x.text in texts]
    assert whole and all(any(x.text in t for t in texts) for x in taken)
    coded = p.encoding_stage(spark, odd, SF).collect()
    assert len(coded) == odd.count() and {x.n_tokens for x in coded if x.doc_id in (3, 4)} == {0}
    for _, stage in p.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    extra = odd.withColumn("n", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("_row", F.lit(3))
    assert sorted(repr(x.doc_id) for x in p.near_duplicate_stage(spark, extra, SF).collect() if (x["_row"], x["n"]) == (3, 1)) == sorted(repr(i) for i, _ in kept)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    first = p.toxicity_stage(spark, docs, SF)
    assert first.columns == cols
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    left = {r.doc_id for r in first.collect()}
    assert len(clean & left) >= 0.9 * len(clean) and len(toxic & left) < len(toxic)
    second = common.saved(p.near_duplicate_stage(spark, common.saved(first), SF))
    assert second.columns == cols and second.count() < len(left) and second.select("doc_id").distinct().count() == second.count()
    third = common.saved(p.secret_stage(spark, second, SF))
    assert third.columns == cols and third.count() == second.count()
    fourth = common.saved(p.mixing_stage(spark, third, SF))
    assert fourth.columns == cols and fourth.count() > 0
    last = p.encoding_stage(spark, fourth, SF)
    assert last.count() == fourth.count()
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
