"""SQL building blocks: the same semantics, written for DuckDB.

Each function returns one or more common table expressions; `with_(...)` chains
them and adds the final select.
"""

from __future__ import annotations

import re

from scanmill.functions import patterns
from scanmill.functions.stemming import STEP_2, STEP_3, STEP_4
from scanmill.functions.words import ENGLISH_STOP_WORDS, FUNCTION_WORDS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def materialised(sql: str) -> str:
    """The same query with every common table computed once, in the order written."""
    return re.sub(r"^(WITH )?(\w+(?:\([\w, ]+\))?) AS \(", r"\1\2 AS MATERIALIZED (", sql, flags=re.MULTILINE)


TOKEN = text(patterns.token_pattern("re2"))

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS docid, text AS content, lang FROM documents)"


# Markup by patterns of its own: right for pages as orderly as the tables' are.
_BLOCK_TAG = (
    "html|head|body|script|noscript|style|meta|link|title|nav|aside|header|footer|section|article|main"
    "|p|h[1-6]|ul|ol|li|dl|dt|dd|pre|div|blockquote|hr|br|address|figure|figcaption|form|fieldset|table"
    "|caption|thead|tbody|tfoot|tr|th|td"
)
_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def html_text(html: str) -> str:
    hidden = text(r"(?is)<!--.*?-->|(<script|<style)\b.*?</(?:script|style)\s*(>)")
    block = text(rf"(?i)</?(?:{_BLOCK_TAG})(?:[\s/]{_REST})?>")
    other = text(rf"(?i)</?[a-z]{_REST}>|<[!?][^>]*>")
    out = rf"regexp_replace({html}, {hidden}, '\1\2', 'g')"
    out = f"regexp_replace({out}, {block}, ' ', 'g')"
    out = f"regexp_replace({out}, {other}, '', 'g')"
    # The references that occur in the tables; `&` last, so none is decoded twice.
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"')):
        out = f"replace({out}, '&{name};', {text(char)})"
    out = f"replace(replace(replace({out}, '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&')"
    return rf"trim(regexp_replace({out}, '[ \t\n\f\r]+', ' ', 'g'))"


PAGES = f"docs AS (SELECT CAST(page_id AS VARCHAR) AS docid, {html_text('html')} AS content FROM pages)"


def words(name: str, source: str, key: str, content: str, stop: list[str]) -> str:
    """name(key, pos, tok): tokens after the stop list."""
    listed = ", ".join(text(w) for w in stop)
    return f"""{name} AS (
  SELECT {key}, pos, tok FROM (
    SELECT {key}, unnest(l) AS tok, generate_subscripts(l, 1) AS pos
    FROM (SELECT {key}, regexp_extract_all(lower({content}), {TOKEN}, 0) AS l FROM {source})
  ) WHERE length(tok) <= 255 AND tok NOT IN ({listed})
)"""


_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_M0 = text(f"^({_C})?{_V}{_C}")
_M1 = text(f"^({_C})?{_V}{_C}({_V})?$")
_MM = text(f"^({_C})?{_V}{_C}{_V}{_C}")
_VOWEL = text(f"^({_C})?[aeiouy]")
_CVC = text(f"^{_C}[aeiouy][^aeiouwxy]$")


def _suffix_case(rules: dict[str, str], measure: str) -> str:
    arms = []
    for suffix in sorted(rules, key=len, reverse=True):
        stem = f"left(w, length(w) - {len(suffix)})"
        new = f"{stem} || {text(rules[suffix])}"
        arms.append(
            f"WHEN ends_with(w, {text(suffix)}) THEN "
            f"CASE WHEN regexp_matches({stem}, {measure}) THEN {new} ELSE w END"
        )
    return "CASE " + " ".join(arms) + " ELSE w END"


def stems(name: str, source: str) -> str:
    """name(tok, term): Porter stems of the distinct tokens of source."""
    doubles = " OR ".join(f"ends_with(s, '{c}{c}')" for c in "bcdfghjkmnpqrtvwx")
    step4 = {("ion" if s in ("sion", "tion") else s): "" for s in STEP_4}
    arms = []
    for suffix in sorted(step4, key=len, reverse=True):
        stem = f"left(w, length(w) - {len(suffix)})"
        guard = f" AND (ends_with({stem}, 's') OR ends_with({stem}, 't'))" if suffix == "ion" else ""
        arms.append(
            f"WHEN ends_with(w, '{suffix}'){guard} THEN "
            f"CASE WHEN regexp_matches({stem}, {_MM}) THEN {stem} ELSE w END"
        )
    case4 = "CASE " + " ".join(arms) + " ELSE w END"
    cut = "left(w, length(w) - 1)"
    return f"""{name}_0 AS (SELECT DISTINCT tok FROM {source} WHERE length(tok) > 2),
{name}_1 AS (SELECT tok, CASE
    WHEN ends_with(tok, 'sses') OR ends_with(tok, 'ies') THEN left(tok, length(tok) - 2)
    WHEN ends_with(tok, 's') AND NOT ends_with(tok, 'ss') THEN left(tok, length(tok) - 1)
    ELSE tok END AS w FROM {name}_0),
{name}_2 AS (SELECT tok, w, CASE
    WHEN ends_with(w, 'eed') THEN NULL
    WHEN ends_with(w, 'ed') AND regexp_matches(left(w, length(w) - 2), {_VOWEL}) THEN left(w, length(w) - 2)
    WHEN ends_with(w, 'ing') AND regexp_matches(left(w, length(w) - 3), {_VOWEL}) THEN left(w, length(w) - 3)
    END AS s FROM {name}_1),
{name}_3 AS (SELECT tok, CASE
    WHEN ends_with(w, 'eed') THEN
      CASE WHEN regexp_matches(left(w, length(w) - 3), {_M0}) THEN left(w, length(w) - 1) ELSE w END
    WHEN s IS NULL THEN w
    WHEN ends_with(s, 'at') OR ends_with(s, 'bl') OR ends_with(s, 'iz') THEN s || 'e'
    WHEN {doubles} OR regexp_matches(s, '[^a-z]$') AND length(s) > 1 AND right(s, 1) = substr(s, length(s) - 1, 1)
      THEN left(s, length(s) - 1)
    WHEN regexp_matches(s, {_CVC}) THEN s || 'e'
    ELSE s END AS w FROM {name}_2),
{name}_4 AS (SELECT tok, CASE WHEN ends_with(w, 'y') AND regexp_matches({cut}, {_VOWEL})
    THEN {cut} || 'i' ELSE w END AS w FROM {name}_3),
{name}_5 AS (SELECT tok, {_suffix_case(STEP_2, _M0)} AS w FROM {name}_4),
{name}_6 AS (SELECT tok, {_suffix_case(STEP_3, _M0)} AS w FROM {name}_5),
{name}_7 AS (SELECT tok, {case4} AS w FROM {name}_6),
{name}_8 AS (SELECT tok, CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut}, {_MM})
    OR (regexp_matches({cut}, {_M1}) AND NOT regexp_matches({cut}, {_CVC})))
    THEN {cut} ELSE w END AS w FROM {name}_7),
{name} AS (SELECT tok, CASE WHEN ends_with(w, 'll') AND regexp_matches(w, {_MM})
    THEN {cut} ELSE w END AS term FROM {name}_8)"""


def occurrences(
    name: str, source: str, key: str, analyzer: str = "standard", content: str = "content"
) -> str:
    """name(key, pos, term) for either analyzer."""
    if analyzer == "standard":
        ctes = words(f"{name}_w", source, key, content, ENGLISH_STOP_WORDS)
        return f"{ctes},\n{name} AS (SELECT {key}, pos, tok AS term FROM {name}_w)"
    ctes = words(f"{name}_w", source, key, content, FUNCTION_WORDS)
    return (
        f"{ctes},\n{stems(f'{name}_s', f'{name}_w')},\n"
        f"{name} AS (SELECT {key}, pos, coalesce(s.term, w.tok) AS term "
        f"FROM {name}_w w LEFT JOIN {name}_s s USING (tok))"
    )


def statistics(name: str = "stats", source: str = "occ", df_min: int = 2, max_chars: int = 64) -> str:
    return f"""{name} AS (
  SELECT term, CAST(count(DISTINCT docid) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf
  FROM {source} WHERE length(term) <= {max_chars} GROUP BY term
  HAVING count(DISTINCT docid) >= {df_min}
)"""


DICTIONARY = (
    "dict AS (SELECT CAST(row_number() OVER (ORDER BY df DESC, term) AS INTEGER) AS term_id, "
    "term, df, cf FROM stats)"
)

VECTORS = """vec AS (
  SELECT d.docid, coalesce(v.ids, []) AS term_ids, CAST(len(coalesce(v.ids, [])) AS INTEGER) AS doc_len
  FROM docs d LEFT JOIN (
    SELECT docid, list(term_id ORDER BY pos) AS ids FROM occ JOIN dict USING (term) GROUP BY docid
  ) v USING (docid)
)"""

POSTINGS = """post AS (
  SELECT docid, term_id, CAST(count(*) AS INTEGER) AS tf, any_value(doc_len) AS doc_len
  FROM (SELECT docid, unnest(term_ids) AS term_id, doc_len FROM vec) GROUP BY docid, term_id
)"""


def query_terms(analyzer: str = "standard") -> str:
    return (
        "q AS (SELECT item_id AS qid, text FROM benchmark),\n"
        + occurrences("qocc", "q", "qid", analyzer, "text")
        + """,
qt AS (
  SELECT qid, term, term_id, CAST(count(*) AS INTEGER) AS qtf, any_value(df) AS df, any_value(cf) AS cf
  FROM qocc JOIN dict USING (term) GROUP BY qid, term, term_id
)"""
    )


def corpus(analyzer: str = "standard", docs: str = DOCS, df_min: int = 2) -> tuple[str, ...]:
    """docs, occ, stats, dict, vec, post, q, qt."""
    return (
        docs,
        occurrences("occ", "docs", "docid", analyzer),
        statistics(df_min=df_min),
        DICTIONARY,
        VECTORS,
        POSTINGS,
        query_terms(analyzer),
    )


def top_k(scores: str, k: int, tag: str, tie: str = "docid") -> str:
    return f"""SELECT qid, docid, CAST(rank AS INTEGER) AS rank, score, '{tag}' AS tag FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {tie}) AS rank FROM {scores}
) WHERE rank <= {k}"""


def bm25(average: str = "450.0", k1: float = 1.0, b: float = 0.5) -> str:
    return f"""n AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM vec),
raw AS (
  SELECT qid, docid, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * ({k1} + 1.0) * tf
    / ({k1} * (1.0 - {b} + {b} * doc_len / {average}) + tf)), 6) AS score
  FROM post JOIN qt USING (term_id), n GROUP BY qid, docid
)"""


def likelihood(smoothing: float, background: str = "df") -> str:
    """The textbook form: every candidate with each of its query's terms."""
    p = f"{background} / c"
    if smoothing <= 1:
        prob = f"({smoothing} * coalesce(tf, 0) / doc_len + (1.0 - {smoothing}) * {p})"
    else:
        prob = f"((coalesce(tf, 0) + {smoothing} * {p}) / (doc_len + {smoothing}))"
    return f"""c AS (SELECT CAST(sum(cf) AS DOUBLE) AS c FROM dict),
cand AS (SELECT DISTINCT qid, docid, doc_len FROM post JOIN qt USING (term_id)),
pairs AS (
  SELECT cand.qid, cand.docid, cand.doc_len, qt.term_id, qt.df, qt.cf, post.tf
  FROM cand JOIN qt USING (qid) LEFT JOIN post ON post.docid = cand.docid AND post.term_id = qt.term_id
),
probs AS (SELECT qid, docid, {prob} AS p FROM pairs, c),
raw AS (
  SELECT qid, docid, CASE WHEN min(p) <= 0 THEN CAST('-infinity' AS DOUBLE)
    ELSE round(sum(CASE WHEN p > 0 THEN ln(p) END), 6) END AS score
  FROM probs GROUP BY qid, docid
)"""
