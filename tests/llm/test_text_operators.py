"""Operators on texts against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aggrolens.llm import bpe, jaccard_join, mixing, repeats, secrets, sharding, toxicity
from aggrolens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", size long, shard int, key string, n long, h long, component_id long"


def table(spark, texts, sources=("a", "b", None), extra=False):
    rows = [(i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4, 5) for r in rows], EXTRA) if extra else spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    w = ["".join(r.choices("abcdeéÉAB", k=r.randint(1, 6))) for _ in range(500)]
    say = lambda n: r.choice([" ", "\n", "  "]).join(r.choices(w, k=n))
    passages, base, out = [say(60) for _ in range(3)], say(120), []
    for _ in range(160):
        k = r.random()
        if k < 0.1 and out:
            out.append(r.choice(out))
        elif k < 0.4:
            t = base.split()
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(w)
            out.append(" ".join(t))
        elif k < 0.7:
            out.append(say(r.randint(0, 30)) + " " + r.choice(passages) + " " + say(r.randint(0, 60)))
        else:
            out.append(say(r.choice([0, 1, 2, 3, 4, 50, 300])))
    return [*out, None, "", "  \n", "x" * 700, "ab" * 300, say(4000), "naïve <|endoftext|> ſ   end"]


@pytest.mark.parametrize(("extra", "cell_rows", "wing", "shard"), [(False, 4096, 4096, 50_000), (True, 4096, 4096, 50_000), (False, 0.02, 3, 300)])
def test_mixing(spark, texts, monkeypatch, extra, cell_rows, wing, shard):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(mixing, "WING", wing)
    d = table(spark, texts, extra=extra)
    assert mixing.cell_digits(d.count()) == (4 if cell_rows < 1 else 3)
    got = mixing.mix(d, shard_words=shard).collect()
    assert len(got) == len(texts)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(7), shard_words=shard).collect()))
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    source = {i: ("a", "b", None)[i % 3] for i in size}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in ("a", "b", None)}
    target = dict.fromkeys(total, 0.0)
    weight, left, open_ = {"a": 1, "b": 2, None: 3}, float(sum(total.values())), set(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * total[s]}
        for s in full or open_:
            target[s] = 3.0 * total[s] if s in full else share[s]
        left -= sum(3 * total[s] for s in full)
        open_ = open_ - full if full else set()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[source[r.doc_id]])
    for s, t in target.items():
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - t) <= max(3, 0.01 * t)


def test_cells_grow_with_the_table():
    assert [mixing.cell_digits(n) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 30, 10**11)] == [3, 3, 4, 5, 7]


def test_mixing_quotients(spark):
    d = spark.createDataFrame([(k, float(w), 0, 97) for k, w in enumerate([53, 24, 23, 0.4, 0])], "key int, w double, one int, seats long")
    got = {r.key: r.won for r in mixing.highest_quotients(d, ["one"], "key", "w", "seats", "won").collect()}
    won, w = [0] * 5, [53, 24, 23, 0.4, 0]
    for _ in range(97):
        won[max(range(5), key=lambda k: (w[k] / (2 * won[k] + 1), -k))] += 1
    assert [got[k] for k in range(5)] == won


def test_mixed_documents(spark, texts):
    d = table(spark, texts)
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    got = {}
    for r in mixing.mixed_documents(d).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def test_sharding(spark, texts):
    many = [f"{t} {i % 40}" for i in range(6) for t in texts] + [None] * 3 + ["same text " * 20] * 300
    d = table(spark, many, extra=True)
    got = sharding.shard(d, 8).collect()
    assert len(got) == len(many)
    for r in got:
        b = (many[r.doc_id] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == zlib.crc32(b) and r.law == "bytes" and r.grown_shard is None
    by = {k: [r for r in got if r.shard == k] for k in range(8)}
    mean = sum(r.size for r in got) / 8
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert max(abs(sum(r.size for r in v) - mean) for v in by.values()) <= max(r.size for r in got)
    assert sharding.shard(empty(spark), 8).count() == 0


def brute_base(t):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark):
    key = "AKIA" + "Q7" * 8
    blob = "wJalrXUtnFEMI/K7MDENGbPxRfiCYEXAMPLEKEY"
    cases = [
        None, "", "nothing: here", "Password = 'hunter22' and TOKEN:abcdef", "secret=token:abcdefgh", "paſsword=abcdefgh Kapi_key=abcdefg1", key, "AKIA12", "AKIA" * 8, "deadbeef" * 4, "x" * 5000 + " é token=abcdef123",
        f"{key} then {blob} at https://s3.example.com/b", f"{blob} alone", f"user=jane https://h.example.com/ but {'z ' * 300} password=abcdef1", f"login: jane password: abcdef1 ftp://h.example.com/x", f"{key} {'z ' * 300}{blob}",
    ]
    got = {r.doc_id: r for r in secrets.scan(table(spark, cases, extra=True)).collect()}
    for i, t in enumerate(cases):
        b = brute_base(t or "")
        kinds = ("assign", "access", "hex")
        listed = [f"{kinds[k]}:{a}:{z}" for a, k, z in b]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in b) for k in range(3))
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got[i].spans.split(",")) | {""}
    assert "blob" in got[11].spans and got[12].spans == "" and "login" not in got[13].spans and "login" in got[14].spans and "endpoint" in got[14].spans and "blob" not in got[15].spans
    masked = secrets.redact(table(spark, cases)).orderBy("doc_id").collect()
    assert masked[3].text == "[SECRET] and [SECRET]" or "hunter22" not in masked[3].text
    assert masked[0].text is None and masked[2].text == cases[2] and masked[11].n_chars == len(masked[11].text)
    assert secrets.scan(empty(spark)).count() == 0


def test_secret_links_are_all_pairs():
    r = random.Random(2)
    kinds = secrets.KINDS
    for _ in range(50):
        at, spans = 0, []
        for _ in range(r.randint(0, 30)):
            at += r.randint(0, 150)
            spans.append((at, at := at + r.randint(1, 20), r.choice(kinds)))
        need = lambda k: secrets.IDENTIFIERS if k == "blob" else secrets.SECRETS
        slow = [s for s in spans if any(o[2] in need(s[2]) and (0 <= o[0] - s[1] <= 200 or 0 <= s[0] - o[1] <= 200) for o in spans)]
        assert secrets.linked(spans, 200) == slow


def test_toxicity(spark):
    r = random.Random(3)
    w = ["".join(r.choices(["er", "the", "on", "ea", "st", "in", "ou"], k=r.randint(1, 4))) for _ in range(400)]
    bad = ["grumble", "snarfed", "blorp", "zigzit"]
    rows, labels = [], []
    for i in range(900):
        t, toxic = r.choices(w, k=r.randint(20, 80)), int(i % 4 == 0)
        for _ in range(r.randint(2, 5) * toxic):
            t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append(" ".join(t))
        labels.append((i, 1, toxic))
    d = table(spark, [*rows, None, ""], extra=True)
    la = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    m = toxicity.train(d, la)
    got = {x.doc_id: x for x in toxicity.classify(d, m).collect()}
    assert len(got) == 902 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got.values())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[900].predicted == 0 and got[901].predicted == 0
    assert toxicity.classify(d, toxicity.train(d, la.where("toxic = 0"))).agg(F.max("score")).first()[0] == 0
    assert toxicity.without_toxic(d, m).count() == sum(1 - x.predicted for x in got.values())


def brute_repeats(texts, length=200):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("indexed,often", [(40_000, 500), (1, 500), (3, 500), (40_000, 2)])
def test_repeats(spark, texts, monkeypatch, indexed, often):
    monkeypatch.setattr(repeats, "OFTEN", often)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(table(spark, texts, extra=True), indexed=indexed).collect()}
    for i, want in enumerate(brute_repeats([(t or "").encode() for t in texts])):
        assert got[i] == want, i
    assert len(got) == len(texts)


@pytest.mark.parametrize("rest", [199, 200, 300, 400, 401])
def test_anchors_of_parts(monkeypatch, rest):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    text = bytes(random.Random(rest).choices(range(97, 123), k=2000 + rest))
    ((at, h, c),) = repeats.text_anchors([text], 200)
    whole = repeats.anchors_of(np.frombuffer(text, np.uint8), np.array([len(text)]), 200)
    assert at.tolist() == whole[0].tolist() and h.tolist() == whole[1].tolist() and c.tolist() == whole[2].tolist()


def test_long_text_without_repeats(spark):
    text = "".join(random.Random(9).choices("abcdefghijklmnop", k=2 * repeats.SEGMENT + 300))
    assert repeats.without_repeats(table(spark, [text, "other"])).agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_in_and_across_parts_of_long_texts(spark):
    """Copies within a part of half a megabyte, over the edge between two, in two parts and in another text."""
    r, part = random.Random(10), repeats.SEGMENT
    t = r.choices("abcdefghijklmnop", k=2 * part + 70_000)
    put = lambda to, at, n: t.__setitem__(slice(to, to + n), t[at : at + n])
    put(5_000, 1_000, 450)
    put(part - 230, 9_000, 461)
    put(2 * part - 1, 40_000, 200)
    put(part + 7_000, 60_000, 199)
    put(2 * part + 30_000, 2 * part + 29_800, 700)
    other = "x" + "".join(t[part - 100 : part + 150])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.without_repeats(table(spark, ["".join(t), other])).collect()}
    want = list(brute_repeats(["".join(t).encode(), other.encode()]))
    assert [got[0], got[1]] == want and want[1][1] == 250 and want[0][2] == 7


@pytest.mark.parametrize("most", [2, 7, 10_000])
def test_contexts_of_one_anchor(spark, most):
    """Some 260 different strings around one anchor, divided again and again, in groups of any size."""
    r = random.Random(most)
    anchor, sides = "Z" * 3 + "qwertyuiopasdfghjklzxcvbnm1234567890" + "Y", ["".join(r.choices("ab", k=180)) for _ in range(16)]
    out = []
    for i in range(260):
        a, b = r.choice(sides), r.choice(sides)
        out.append("".join(r.choices("cd", k=r.randint(0, 60))) + a[r.randint(0, 170) :] + anchor + b[: r.randint(60, 180)] + f"<{i}>")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.without_repeats(table(spark, out), indexed=most).collect()}
    assert [got[i] for i in range(len(out))] == list(brute_repeats([t.encode() for t in out]))


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("size,percent,hot", [(3, 90, 256), (5, 80, 256), (5, 80, 4)])
def test_jaccard(spark, texts, monkeypatch, size, percent, hot):
    """With hot at 4, shared shingles are put last in further rounds, buckets of over two groups have one pivot and the rest go by blocks of two."""
    if hot == 4:
        for name, x in (("HOT", hot), ("PIVOTS", 1), ("BLOCK", 2)):
            monkeypatch.setattr(jaccard_join, name, x)
    sets = []
    for t in texts:
        x = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))} if x else set())
    root = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(table(spark, texts, extra=True), size, percent).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_jaccard_of_nothing(spark):
    assert jaccard_join.similar_documents(empty(spark)).count() == 0


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    r = random.Random(8)
    parts = ["a", "B", "é", "ê", "ß", "日", "à", " ", "  ", "\n", "\t", "\r", " ", "\x1c", "\x85", "'s", "don't", "1", "²", "!", "<|endoftext|>", "😀", "ſ", ".", ",", "("]
    more = [*texts, *("".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500))]
    t = Tokenizer.from_file(tokenizer_path())
    got = {x.doc_id: x for x in bpe.encode(table(spark, more, extra=True), tokenizer_path()).collect()}
    for i, x in enumerate(more):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.encode(table(spark, ["hello there", None]), tokenizer_path(), digests=False).orderBy("doc_id").collect()
    assert whole[0].decoded == "hello there" and len(whole[0].ids) == whole[0].n_tokens and whole[1].ids == []
    assert bpe.encode(empty(spark), tokenizer_path()).count() == 0
