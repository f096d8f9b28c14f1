"""The operators applied to the driver's tables, each with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.llm.decontaminate import contaminated, find_contamination, items_digest
from scanmill.llm.langid import held_out, identify_language, train_profiles
from scanmill.llm.line_dedup import dedup_lines
from scanmill.llm.mixing import mix_sources
from scanmill.llm.ngram_join import near_duplicates
from scanmill.llm.nn_descent import nearest_neighbours
from scanmill.llm.quality import classify_quality
from scanmill.llm.registry import REGISTRY, query, table
from scanmill.llm.secret_scan import count_of, find_secrets, labelled_samples, spans_text, train_secret_model
from scanmill.llm.substring_dedup import dedup_substrings
from scanmill.llm.url_filter import Rule, filter_urls
from scanmill.llm.vector_codes import encode_vectors
from scanmill.llm.warc_salvage import salvage_archives, write_archives
from scanmill.llm.whitening import whiten_embeddings
from scanmill.runtime import scratch_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, words=3, threshold=(9, 10))


@query(
    "op2_warc_salvage",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
      FROM pages
    )
    SELECT page_id, strlen(payload) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha1(payload), 1 + 10 * (i // 8), 10))::BIGINT
          >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p
    """,
)
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), archives)
    # The archives were just written: a gap would be a lost record, and ends the query.
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", "gap")).cast("boolean")
    records = salvage_archives(spark, archives).filter(F.when(F.col("gap").isNotNull(), lost).otherwise(F.lit(True)))
    return records.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )


@query("op4_nn_descent")
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, F.col("vec_id") % 100 == 0)


@query(
    "op5_substring_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), wins AS (
      SELECT doc_id, p, sha256(array_to_string(w[p:p + 19], ' ')) AS h
      FROM (SELECT *, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
    ), late AS (
      SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM wins)
      WHERE nth > 1
    ), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM late),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
    kept AS (
      SELECT doc_id, count(*) FILTER (g.q IS NOT NULL) AS n_removed,
        string_agg(word, ' ' ORDER BY w.q) FILTER (g.q IS NULL) AS rest
      FROM words AS w LEFT JOIN gone AS g USING (doc_id, q) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
      sha256(coalesce(rest, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op8_line_dedup",
    rf"""
    WITH lines AS (
      SELECT doc_id, unnest(list) AS line, unnest(range(len(list))) AS pos
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)
    ), keyed AS (
      SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          '{_UPPER}', '{_LOWER}') AS k FROM lines
    ), repeated AS (
      SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
      GROUP BY k HAVING count(DISTINCT doc_id) >= 2
    ), marked AS (
      SELECT doc_id, line, pos, coalesce(doc_id <> keeper, false) AS dropped
      FROM keyed LEFT JOIN repeated USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op9_decontaminate",
    rf"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
      FROM documents
    ), b AS (
      SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
      FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
    ), items AS (
      SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)
    ), hits AS (
      SELECT doc_id, p, size, item_id FROM (
        SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
              FROM d, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)
      ) JOIN items USING (size, win)
    ), covered AS (
      SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id
    ), found AS (
      SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    away = held_out("doc_id", 5, 0)
    scored = classify_quality(docs, table(spark, sf_dir, "labels"), ~away)
    return scored.select("doc_id", away.alias("held_out"), "score", "predicted")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    away = held_out("doc_id", 4, 2)
    profiles = train_profiles(docs.filter(~away).select("text", "lang"))
    named = identify_language(docs.select("doc_id", "text"), profiles)
    return named.select("doc_id", away.alias("held_out"), "lang_pred", "score")


URL_RULES = [
    Rule("net/", False),
    Rule("example.net/en/", True),
    Rule("example.com/de/", False),
    Rule("org/fr/", True),
]


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


MIX_CURATED = ["src15", "src16", "src17", "src18", "src19"]
MIX_LEVELS = {
    "domain": f"CASE WHEN source IN ({', '.join(map(repr, MIX_CURATED))}) THEN 'curated' ELSE 'web' END",
    "lang": "lang",
    "source": "source",
}
MIX_WEIGHTS = {
    ("web",): 3,
    ("curated",): 2,
    ("web", "en"): 4,
    ("web", "de"): 2,
    ("web", "fr"): 2,
    ("web", "es"): 2,
    ("web", "en", "src0"): 2,
}
_MIX_WEIGHT_ROWS = ", ".join(
    "({}, {})".format(repr("/".join(path)), weight) for path, weight in MIX_WEIGHTS.items()
)


def _share_sql(level: str, parent: str, path: str) -> str:
    """One level of the budget: `{level}` nodes, from the grants of `{parent}`."""
    above = path.rsplit(" || '/' || ", 1)[0] if " || " in path else "''"
    return f"""
    {level}_usable AS (
      SELECT {above} AS up, {path} AS node, sum(usable) AS usable, coalesce(any_value(w.weight), 1) AS weight
      FROM leaves LEFT JOIN weights AS w ON w.path = {path} GROUP BY ALL
    ), {level}_ordered AS (
      SELECT n.*, p.granted AS budget,
        coalesce(sum(n.usable) OVER (PARTITION BY up ORDER BY n.usable / weight, n.node
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (PARTITION BY up ORDER BY n.usable / weight, n.node
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
      FROM {level}_usable n JOIN {parent} p ON p.node = n.up
    ), {level}_marked AS (
      SELECT *, usable * left_weight <= (budget - before) * weight AS used_up FROM {level}_ordered
    ), {level} AS (
      SELECT node, CASE WHEN used_up THEN usable WHEN weight = 0 THEN 0 ELSE
        (budget - coalesce(sum(usable) FILTER (used_up) OVER (PARTITION BY up), 0)) * weight
        // sum(weight) FILTER (NOT used_up) OVER (PARTITION BY up) END AS granted
      FROM {level}_marked
    )"""


@query(
    "op10_mix_sources",
    rf"""
    WITH weights(path, weight) AS (VALUES {_MIX_WEIGHT_ROWS}),
    d AS (
      SELECT doc_id, lang, source,
        CASE WHEN source IN ({', '.join(map(repr, MIX_CURATED))}) THEN 'curated' ELSE 'web' END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens
      FROM documents
    ), leaves AS (
      SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(4 * sum(n_tokens) AS HUGEINT) AS usable
      FROM d GROUP BY ALL
    ), root AS (SELECT '' AS node, CAST(sum(tokens) // 2 AS HUGEINT) AS granted FROM leaves),
    {_share_sql("top", "root", "domain")},
    {_share_sql("middle", "top", "domain || '/' || lang")},
    {_share_sql("bottom", "middle", "domain || '/' || lang || '/' || source")},
    plan AS (
      SELECT domain, lang, source, granted // tokens AS whole, granted % tokens AS rest
      FROM leaves JOIN bottom ON node = domain || '/' || lang || '/' || source WHERE tokens > 0
    ), placed AS (
      SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('7:' || whole || ':' || doc_id) RANGE UNBOUNDED PRECEDING) AS upto
      FROM d JOIN plan USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CAST(rest > 0 AND upto <= rest AS BIGINT) AS BIGINT) AS n_epochs
    FROM placed WHERE n_epochs > 0
    """,
)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), MIX_LEVELS, MIX_WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "n_epochs")


def _code_rounds_sql(rounds: int) -> str:
    """Assignments and new codebooks, one pair of tables a round, then the last assignment."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
      SELECT id, vec_id, label, parts.p, x, arg_min(e, (d, e)) AS e, min(d) AS d
      FROM (SELECT parts.*, e,
              list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
            FROM parts JOIN book{r} AS b ON b.p = parts.p) AS parts
      GROUP BY ALL
    )""")
        if r < rounds:
            parts.append(f"""book{r + 1} AS MATERIALIZED (
      SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} AS b LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
          SELECT p, e, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n
          FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{r}) GROUP BY ALL
        ) GROUP BY ALL
      ) AS m ON m.p = b.p AND m.e = b.e
    )""")
    return ",\n    ".join(parts)


@query(
    "op11_vector_codes",
    f"""
    WITH kept AS (
      SELECT row_number() OVER () AS id, vec_id, label,
        list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), parts AS MATERIALIZED (
      SELECT id, vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x
      FROM (SELECT *, unnest(range(8)) AS p FROM kept)
    ), book0 AS MATERIALIZED (
      SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 16
    ),
    {_code_rounds_sql(6)},
    coded AS (
      SELECT id, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
      FROM near6 GROUP BY ALL
    ), listed AS (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM book6)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM listed) AS codebooks_sha256
    FROM coded
    """,
)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train_secret_model(labelled_samples(docs)))
    return found.select(
        "doc_id",
        *(count_of("base_spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(spans_text("base_spans"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten_embeddings(table(spark, sf_dir, "embeddings"))
    values = F.posexplode("whitened").alias("at", "whitened")
    each = made.select("vec_id", values, "n", "deviation", "explained", "identity_error")
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )


__all__ = ["REGISTRY"]
