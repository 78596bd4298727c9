"""Secret scans with multipart credential linking."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts that count only beside a complementary one: a bare key-like run, an account name, an endpoint.
BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
LOGIN = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|access_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"""\b(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9.:/@_-]*""")

KINDS = ("assign", "access", "hex", "blob", "login", "endpoint")
IDENTIFIERS, SECRETS, ENDPOINTS = {"access", "login"}, {"assign", "hex", "blob"}, {"endpoint"}

Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    """The base spans (start, end, kind): they stand on their own."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "login") for m in LOGIN.finditer(text)]
    return found


def linked(spans: list[Span], scope: int) -> list[Span]:
    """Interval join of weak parts with complementary parts whose gap is at most `scope` code points.

    A bare run needs an identifier in scope; an account name or an endpoint needs a secret. Each
    class is joined by binary search on sorted bounds: n log n, whatever the text holds. A part
    never vouches for one that it overlaps.
    """
    by = {name: sorted(s for s in spans if s[2] in kinds) for name, kinds in (("id", IDENTIFIERS), ("secret", SECRETS))}
    starts = {k: [s[0] for s in v] for k, v in by.items()}
    ends = {k: sorted(s[1] for s in v) for k, v in by.items()}

    def beside(s: Span, what: str) -> bool:
        after = bisect_right(starts[what], s[1] + scope) - bisect_left(starts[what], s[1])
        before = bisect_right(ends[what], s[0]) - bisect_left(ends[what], s[0] - scope)
        return after > 0 or before > 0

    return [s for s in spans if beside(s, "id" if s[2] == "blob" else "secret")]


def secret_spans(text: str, scope: int = 200) -> tuple[list[Span], list[Span]]:
    """(base spans, linked weak spans), each by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    strong = strong_spans(text)
    weak = weak_spans(text)
    if strong or weak:  # a bare run alone is no evidence
        weak += [(m.start(), m.end(), "blob") for m in BLOB.finditer(text)]
        taken = sorted((s[0], s[1]) for s in strong)
        at = [t[0] for t in taken]
        top = [0]
        for t in taken:
            top.append(max(top[-1], t[1]))
        free = [w for w in weak if top[bisect_left(at, w[1])] <= w[0]]
        good = set(linked(strong + free, scope))
        weak = [w for w in free if w in good]
    return sorted(strong, key=order), sorted(weak, key=order)


def redacted(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, scope: int = 200, key: str = "doc_id") -> DataFrame:
    """Secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans' kind:start:end),
    spans (base and linked ones, joined likewise), n_linked. Code points, end exclusive. One pass, no
    shuffle. Null and empty texts have no spans; repeated rows are each scanned; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in b.column(1).to_pylist():
                strong, weak = secret_spans(text or "", scope)
                kinds = [s[2] for s in strong]
                both = sorted(strong + weak, key=lambda s: (s[0], KINDS.index(s[2])))
                row = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_listed(strong).encode()).hexdigest(), _listed(both), len(weak))
                for x, v in zip(out, row, strict=True):
                    x.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], ["doc_id", *names])

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
    return docs.select(key, "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(docs: DataFrame, scope: int = 200) -> DataFrame:
    """docs with each secret in the text replaced by [SECRET], and n_chars, where present, set anew. Null texts stay null."""
    i = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if x is None else redacted(x, sum(secret_spans(x, scope), [])) for x in b.column(i).to_pylist()]
            cols = list(b.columns)
            cols[i] = pa.array(texts, pa.string())
            if "n_chars" in schema.names:
                cols[schema.names.index("n_chars")] = pa.array([x if x is None else len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(run, schema)
