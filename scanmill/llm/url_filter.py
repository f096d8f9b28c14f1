"""URL filter: rules first, then the ratio of two character language models.

URLs that the rules accept or reject train one variable-order Markov model each.  The
probability of a character after its context is the Witten-Bell blend of all context
lengths, from `order` characters down to none.  A URL that no rule decides is judged by
the log-likelihood difference of the two models per character, against a threshold
calibrated on the URLs that the rules decide: each half of them is scored by models of the
other half, so that no URL is judged by what was learnt from itself.  A URL counts as often
as there are pages with it.

The models are tables of context counts, as large as the training URLs make them, and
stay distributed: the blend is worked out by joins from short contexts to long ones, for
the distinct contexts that occur in URLs, and URLs look up one value per position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, others, text_of, with_group_values
from scanmill.runtime import written

ORDER = 4
_START = "\x02"
_END = "\x03"
_BINS = 1000
_LIMIT = 20.0
_FLUSH = 1 << 18


@dataclass(frozen=True)
class Rule:
    """`host/path`, for the host and all its subdomains, and paths that start like it."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def _ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def _said(url: Column) -> Column:
    """What the models read: the whole URL, up to the host's end A-Z lower-cased; null is empty."""
    whole = F.coalesce(url, F.lit(""))
    upto = F.regexp_extract(whole, r"^(?s:.*?)://[^/?#]*", 0)
    return F.concat(_ascii_lower(upto), F.substr(whole, F.length(upto) + 1))


def _matches(rule: Rule) -> Column:
    on_host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
    return on_host & F.startswith(F.col("path"), F.lit(rule.path))


def _first_rule(rules: list[Rule], value) -> Column:
    """What the longest matching rule says, else null."""
    chosen = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.text)):
        chosen = F.when(_matches(rule), F.lit(value(rule))).otherwise(chosen)
    return chosen


def _positions(urls: DataFrame, order: int) -> DataFrame:
    """(key, accepted, half, n, gram): each run of `order` characters of context and one more.

    A text starts with `order` start marks and ends with one end mark.
    """
    names = ["key", "accepted", "half", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            grams: list[str] = []

            def held() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                columns = [batch.column(i).take(at) for i in range(len(names))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(grams, pa.string())], names=[*names, "gram"])

            for row, text in enumerate(text_of(batch, "said").to_pylist()):
                marked = _START * order + text + _END
                for i in range(len(text) + 1):
                    grams.append(marked[i : i + order + 1])
                    rows.append(row)
                    if len(rows) == _FLUSH:
                        yield held()
                        rows, grams = [], []
            yield held()

    ddl = "key bigint, accepted boolean, half int, n bigint, gram string"
    return urls.select(*names, "said").mapInArrow(run, ddl)


# The models: of all training URLs, and of either half of them.
_MODELS = ("all", "0", "1")


def _log_ratios(positions: DataFrame, order: int) -> DataFrame:
    """(gram, ratio_all, ratio_0, ratio_1): log of P(last character | context), accepted over rejected.

    For order k, P_k = (count(context + c) + kinds(context) * P_{k-1}) / (count(context) +
    kinds(context)), where kinds is the number of different characters seen after the
    context; P_{-1} spreads evenly over 256 characters.
    """
    labels = {"good": F.col("accepted"), "bad": ~F.col("accepted")}
    of_model = {"all": F.lit(True), "0": F.col("half") == 0, "1": F.col("half") == 1}
    columns = [f"{label}_{m}" for label in labels for m in _MODELS]
    trained = positions.filter("accepted is not null").groupBy("gram").agg(
        *(
            F.coalesce(F.sum(F.when(is_label & of_model[m], F.col("n"))), F.lit(0)).alias(f"{label}_{m}")
            for label, is_label in labels.items()
            for m in _MODELS
        )
    )
    trained = written(trained, "url-grams")
    # `tail` is the gram cut to the context length in hand; its blend so far is kept along.
    grams = positions.select("gram").distinct()
    grams = grams.select("gram", *(F.lit(1 / 256).alias(f"p_{c}") for c in columns))
    for k in range(order + 1):
        size = k + 1
        seen = trained.groupBy(F.substring("gram", order + 1 - k, size).alias("tail")).agg(
            *(F.sum(c).alias(c) for c in columns)
        )
        context = seen.groupBy(F.substring("tail", 1, k).alias("context")).agg(
            *(F.sum(c).alias(f"sum_{c}") for c in columns),
            *(F.sum((F.col(c) > 0).cast("bigint")).alias(f"kinds_{c}") for c in columns),
        )
        grams = (
            grams.withColumn("tail", F.substring("gram", order + 1 - k, size))
            .withColumn("context", F.substring("gram", order + 1 - k, k))
            .join(seen, "tail", "left")
            .join(context, "context", "left")
            .select(
                "gram",
                *(
                    F.when(
                        F.coalesce(F.col(f"sum_{c}"), F.lit(0)) > 0,
                        (F.coalesce(F.col(c), F.lit(0)) + F.col(f"kinds_{c}") * F.col(f"p_{c}"))
                        / (F.col(f"sum_{c}") + F.col(f"kinds_{c}")),
                    )
                    .otherwise(F.col(f"p_{c}"))
                    .alias(f"p_{c}")
                    for c in columns
                ),
            )
        )
    return grams.select(
        "gram", *((F.log(f"p_good_{m}") - F.log(f"p_bad_{m}")).alias(f"ratio_{m}") for m in _MODELS)
    )


def _threshold(scored: DataFrame) -> float:
    """The cut between rejected and accepted training URLs with the best balanced accuracy.

    Scores are those of the other half's models.  The middle of the best stretch of a
    histogram with a fixed number of bins, the first of equal ones; 0 if one class is missing.
    """
    crossed = F.col("crossed")
    bins = F.round(F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), crossed)) * (_BINS / _LIMIT))
    rows = (
        scored.filter("accepted is not null")
        .groupBy(bins.cast("bigint").alias("bin"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("accepted"), F.col("n"))), F.lit(0)).alias("good"),
            F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("n"))), F.lit(0)).alias("bad"),
        )
        .orderBy("bin")
        .collect()
    )
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, g, b = -1.0, 0.0, 0, 0
    for here, after in zip(rows, [*rows[1:], None]):
        g, b = g + here["good"], b + here["bad"]
        right = (good - g) / good + b / bad
        if after is not None and right > best:
            best, at = right, (here["bin"] + after["bin"]) / 2
    return at * _LIMIT / _BINS


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    order: int = ORDER,
    url_col: str = "url",
) -> DataFrame:
    """Rows of `pages` with `host`, `path`, `rule`, `verdict` and `score`.

    Host and path are those of `url_parts`.  The longest matching rule decides; `rule` is
    null where none matches, and the models decide.  `score` is the mean log-likelihood
    difference per character of the whole URL and an end mark, of every URL; a URL scoring at
    least the calibrated threshold is allowed.  Without training URLs all score 0 and are
    allowed.  A null URL is judged as an empty text.

    Equal URLs are scored once, and weigh as many pages as they have.  Input columns with the
    names of new ones are replaced.
    """
    kept = others(pages, "host", "path", "rule", "verdict", "score")
    url = column(url_col).cast("string")
    host, path = url_parts(url)
    parted = pages.select(
        *(column(c) for c in kept), host.alias("host"), path.alias("path"), _said(url).alias("__said")
    )
    texts = parted.groupBy("host", "path", F.col("__said").alias("said")).agg(F.count(F.lit(1)).alias("n"))
    texts = texts.select(
        F.monotonically_increasing_id().alias("key"),
        "n",
        _first_rule(rules, lambda r: r.text).cast("string").alias("rule"),
        _first_rule(rules, lambda r: r.allow).cast("boolean").alias("accepted"),
        (F.crc32(F.col("said").cast("binary")) % 2).cast("int").alias("half"),
        "said",
    )
    texts = written(texts, "url-texts")
    positions = written(_positions(texts, order), "url-positions")
    ratios = _log_ratios(positions, order)
    sums = positions.join(ratios, "gram").groupBy("key").agg(
        *(F.avg(f"ratio_{m}").alias(f"score_{m}") for m in _MODELS)
    )
    crossed = F.when(F.col("half") == 0, F.col("score_1")).otherwise(F.col("score_0"))
    scored = texts.join(sums, "key").select(
        "said", "n", "rule", "accepted", F.col("score_all").alias("score"), crossed.alias("crossed")
    )
    scored = written(scored, "url-scores")
    cut = _threshold(scored)
    verdict = F.when(F.coalesce("accepted", F.col("score") >= cut), "allow").otherwise("block")
    # The text said tells host and path.
    judged = scored.select(F.col("said").alias("__said"), "rule", verdict.alias("verdict"), "score", F.col("n").alias("__n"))
    return with_group_values(parted, "__said", judged, "__n").select(
        *(column(c) for c in kept), "host", "path", "rule", "verdict", "score"
    )
