"""Pieces of the SQL counterparts."""

from __future__ import annotations

from ..config import DEFAULT as C
from ..functions import vocab as v


def lst(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def case_map(values: dict[str, float], key: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in values.items()) + " END)"


CORPUS = "corpus AS (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL)"
SPLIT = CORPUS + f", split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY label) * {C.test_share}::DOUBLE + 0.5::DOUBLE) AS is_test FROM corpus)"
WORDS = "regexp_extract_all(lower({0}), '[a-z]+')"


def content(text: str) -> str:
    return f"list_filter({WORDS.format(text)}, lambda w: length(w) > 1 AND NOT list_contains({lst(v.STOP_WORDS)}, w))"


MODEL = (
    SPLIT
    + f""", toks AS (SELECT label, unnest({content("text")}) AS token FROM split WHERE NOT is_test),
cnt AS (SELECT token, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM toks GROUP BY token),
tot AS (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS v FROM cnt),
dd AS (SELECT count(*) FILTER (label = 0) AS d0, count(*) FILTER (label = 1) AS d1 FROM split WHERE NOT is_test),
model AS (SELECT token, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, ln((c0 + 1)::DOUBLE / (t0 + v)::DOUBLE) AS ll0, ln((c1 + 1)::DOUBLE / (t1 + v)::DOUBLE) AS ll1, ln(d0::DOUBLE / (d0 + d1)::DOUBLE) AS prior0, ln(d1::DOUBLE / (d0 + d1)::DOUBLE) AS prior1 FROM cnt, tot, dd)"""
)
PRIOR = "(SELECT prior0, prior1 FROM model LIMIT 1)"
SCORES = (
    MODEL
    + f""", tt AS (SELECT doc_id, unnest({content("text")}) AS token FROM split WHERE is_test),
agg AS (SELECT s.doc_id, count(m.ll0) AS matched, coalesce(sum(m.ll0), 0) AS s0, coalesce(sum(m.ll1), 0) AS s1 FROM (SELECT doc_id FROM split WHERE is_test) s LEFT JOIN tt ON s.doc_id = tt.doc_id LEFT JOIN model m ON tt.token = m.token GROUP BY s.doc_id),
nbs AS (SELECT doc_id, matched, 1 / (1 + exp(least((s0 + prior0) - (s1 + prior1), 700))) AS nb FROM agg, {PRIOR})"""
)


def first_words(text: str) -> str:
    return f"(CASE WHEN len(regexp_split_to_array({text}, '\\s+')) <= {C.max_words} THEN {text} ELSE array_to_string(regexp_split_to_array({text}, '\\s+')[1:{C.max_words}], ' ') END)"


def slang(text: str) -> str:
    for a, b in v.SLANG.items():
        text = f"regexp_replace({text}, '\\b{a}\\b', '{b}', 'gi')"
    return text


def markers(text: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace(lower({text}), '[!?.,\\s]+$', '', 'g')), '^(you''re|you are|that''?s|he''?s|she''?s|i''?m)\\s+', '')"
    return f"list_filter({lst(v.SARCASM)}, lambda m: contains(lower({text}), m) AND NOT (list_contains({lst(v.SINCERE_ALONE)}, m) AND {bare} = m))"


def clause(text: str) -> str:
    cs = f"list_filter(list_transform(string_split(regexp_replace({text}, '\\b(but|however|although|though)\\b', chr(1), 'gi'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
    bad = f"list_filter({cs}, lambda x: regexp_matches(x, '\\byou\\s*(''re|re|are)\\b', 'i') AND list_has_any({WORDS.format('x')}, {lst(v.INSULTS)}))"
    return f"(CASE WHEN len({cs}) > 1 THEN {bad}[1] END)"


def hits(source: str, terms: dict[str, float] | None = None) -> str:
    """CTEs tk (a row per token of source(doc_id, raw, txt), which lexicon scoring takes apart) and hit."""
    before = lambda d: f"lag(low, {d}) OVER w"
    push = " + ".join(f"coalesce({case_map(v.BOOSTERS, f'b{d}')}, 0::DOUBLE) * {1.0 if d == 1 else C.far_booster}::DOUBLE" for d in (3, 2, 1))
    neg = " OR ".join(f"coalesce(list_contains({lst(v.NEGATORS)}, b{d}), false)" for d in (1, 2, 3))
    return f"""apart AS (SELECT doc_id, txt, {slang("txt")} AS sl FROM {source}),
tl AS (SELECT doc_id, txt, list_filter(list_transform(regexp_split_to_array(trim(sl), '\\s+'), lambda t: regexp_replace(t, '[^a-zA-Z''!?]', '', 'g')), lambda t: t <> '') AS ts FROM apart),
tk AS (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM tl),
tb AS (SELECT *, regexp_replace(lower(tok), '^[!?]+|[!?]+$', '', 'g') AS low FROM tk),
tw AS (SELECT *, {before(1)} AS b1, {before(2)} AS b2, {before(3)} AS b3 FROM tb WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hb AS (SELECT *, {case_map(v.LEXICON if terms is None else terms, "low")} AS base FROM tw),
he AS (SELECT *, base + CASE WHEN length(tok) > 1 AND tok = upper(tok) AND regexp_matches(tok, '[A-Z]') THEN sign(base) * {C.caps_step}::DOUBLE ELSE 0::DOUBLE END AS emph FROM hb WHERE base IS NOT NULL),
hit AS (SELECT doc_id, pos, low AS word, base, (emph + sign(emph) * ({push})) * CASE WHEN {neg} THEN {C.negation_scalar}::DOUBLE ELSE 1::DOUBLE END AS valence, ({neg}) AS negated FROM he)"""


def lexicon(source: str, terms: dict[str, float] | None = None) -> str:
    """CTEs that give lexs(doc_id, comp, lex) for source(doc_id, raw)."""
    return f"""lsrc AS (SELECT doc_id, raw, coalesce({clause("raw")}, raw) AS txt FROM {source}), {hits("lsrc", terms)},
hs AS (SELECT doc_id, sum(valence) AS total, count(*) AS n FROM hit GROUP BY doc_id),
lx AS (SELECT s.doc_id, s.raw, s.txt, h.n, h.total, len(tl.ts) AS nt, least(len(regexp_extract_all(s.txt, '!')), {C.exclamations_at_most}) * {C.exclamation}::DOUBLE AS marks, least(len({markers("s.raw")}) * 0.5::DOUBLE, 1::DOUBLE) AS cue FROM lsrc s JOIN tl ON tl.doc_id = s.doc_id LEFT JOIN hs h ON h.doc_id = s.doc_id),
lt AS (SELECT *, total + CASE WHEN total >= 0 THEN marks ELSE -marks END AS tot2 FROM lx),
lc AS (SELECT *, CASE WHEN n > 0 THEN tot2 / sqrt(tot2 * tot2 + greatest({C.alpha_floor}, least({C.alpha_top}, nt))) ELSE 0::DOUBLE END AS c0 FROM lt),
lcc AS (SELECT doc_id, greatest(-1::DOUBLE, least(1::DOUBLE, CASE WHEN cue > 0 AND c0 > 0 THEN -c0 - 0.4::DOUBLE * cue WHEN cue > 0 THEN c0 - 0.2::DOUBLE * cue ELSE c0 END)) AS c FROM lc),
lexs AS (SELECT doc_id, round(c, 4) AS comp, round(greatest(0::DOUBLE, -c), 4) AS lex FROM lcc)"""


def english(text: str) -> str:
    w = f"regexp_extract_all(lower({text}), '[a-z'']+')"
    share = lambda known: f"len(list_filter({w}, lambda q: list_contains({lst(known)}, q)))::DOUBLE / len({w})"
    return f"(CASE WHEN len({w}) < 3 THEN true WHEN {share(v.TAGALOG)} >= {C.language_ratio}::DOUBLE THEN false ELSE {share(v.ENGLISH)} >= {C.language_ratio}::DOUBLE END)"


def distress(text: str) -> str:
    low = f"replace(lower({text}), '''', '')"
    others = lst(v.SECOND_PERSON + v.THIRD_PARTY + v.SWEARS + v.PROFANITY)
    return f"(len({WORDS.format(low)}) > 0 AND NOT list_has_any({WORDS.format(low)}, {others}) AND NOT regexp_matches({low}, '\\bi(''?ve| have)\\s+(ever\\s+)?(seen|read|heard|watched|played|experienced|had)\\b') AND regexp_matches({low}, '\\bi\\s*(''?m|am|feel|feels|felt|think|thought|hate)\\b|\\bmyself\\b'))"


def listed(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


HYBRID = SCORES + ", lin AS (SELECT doc_id, text AS raw FROM split WHERE is_test), " + lexicon("lin") + f", hyb AS (SELECT s.doc_id, s.label, s.lang, s.source, s.text, n.matched, n.nb, l.comp, l.lex, {C.nb_weight}::DOUBLE * n.nb + {C.lexicon_weight}::DOUBLE * l.lex AS hybrid FROM split s JOIN nbs n ON n.doc_id = s.doc_id JOIN lexs l ON l.doc_id = s.doc_id)"
MELT = HYBRID + ", melt AS (SELECT *, 'nb' AS model, nb AS score FROM hyb UNION ALL SELECT *, 'lexicon', lex FROM hyb UNION ALL SELECT *, 'hybrid', hybrid FROM hyb), pred AS (SELECT *, CASE WHEN round(score, 9) >= 0.5 THEN 1 ELSE 0 END AS p FROM melt)"
COUNTS = "count(*) FILTER (label = 0 AND p = 0) AS tn, count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 1 AND p = 1) AS tp"


def metrics(extra: str = "") -> str:
    r = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0), 6)"
    return f"{r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1, {r('tp + tn', 'tp + tn + fp + fn')} AS accuracy{extra}"
