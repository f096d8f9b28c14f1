"""Secrets in texts: three patterns, and character Markov models of random strings and identifiers.

Everything is a built-in function of Spark: patterns give the matches and what lies between them,
running sums of their lengths give the positions, and a string is scored by looking up its pairs
of characters in one array of log-likelihood ratios.  Texts are never shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, others
from scanmill.runtime import written


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# What is found whatever the models say.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = (
    "(" + "|".join(map(_either_case, _NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

# Strings that the models judge: runs of these characters, of this length at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Strings that ordinary identifiers are learnt from.
SAMPLE = r"[A-Za-z0-9+/_=-]{12,}"

_CANDIDATES = "array<struct<start:int,end:int,g0:string>>"

_SYMBOLS = 128  # 0 stands before the first character, 127 for those beyond ASCII
_START, _OTHER = 0, 127
_PIECE = 4096
# Symbols a string can hold, for smoothing: 64 of base 64, four of punctuation.
_ALPHABET = 68
_SMOOTHING = 8.0  # how many observations the likelihood anywhere counts as
# A share of ordinary samples above the threshold weighs so many times one of random samples below.
_FALSE_ALARM_COST = 10
_BINS = 50  # of scores, for each unit
_LIMIT = 10.0
_HALVES = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that `body` computes it only once."""
    return F.transform(F.array(value), body)[0]


def _scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of an array from its start, in as many passes as its length has bits."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def doubled(held: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2), k).cast("int")
        return F.transform(
            held, lambda v, i: F.when(i >= reach, combine(F.get(held, i - reach), v)).otherwise(v)
        )

    return F.aggregate(passes, values, doubled)


def _matches(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """array<struct<start, end, g0, ...>> of the leftmost matches that do not overlap, in code points.

    A cheap test comes first: most texts have no match, and make no arrays.
    """

    def located(parts: Column) -> Column:
        sizes = F.transform(parts["m"], lambda m: F.length(m))
        return _let(F.struct(parts.alias("parts"), sizes.alias("sizes")), placed)

    def placed(known: Column) -> Column:
        steps = F.transform(known["sizes"], lambda s, i: s + F.length(F.get(known["parts"]["gaps"], i)))

        def entry(end: Column, i: Column) -> Column:
            fields = [F.get(known["parts"][f"g{g}"], i).alias(f"g{g}") for g in groups]
            return F.struct((end - F.get(known["sizes"], i)).alias("start"), end.alias("end"), *fields)

        return F.transform(_let(steps, lambda held: _scanned(held, lambda a, b: a + b)), entry)

    found = {f"g{g}": F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups}
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("gaps"),
        *(c.alias(name) for name, c in found.items()),
    )
    return F.when(text.rlike(pattern), _let(parts, located))


def _spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.coalesce(
        F.transform(
            found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end"))
        ),
        F.array().cast("array<struct<start:int,kind:int,end:int>>"),
    )


def _assigned(text: Column) -> Column:
    return F.filter(_matches(text, ASSIGN, (2,)), lambda m: F.length(m["g2"]) >= LEAST_VALUE)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the three patterns, by start, then kind."""
    kinds = [
        _spans(_assigned(text), "assign"),
        _spans(_matches(text, ACCESS), "access"),
        _spans(_matches(text, HEX), "hex"),
    ]
    return F.array_sort(F.concat(*kinds))


def _apart(candidates: Column, base: Column) -> Column:
    """Candidates (start, end, ...) that overlap no base span.

    Both are put in one order; the furthest end of the base spans before a candidate and the
    nearest start of those after it decide.
    """
    none = F.lit((1 << 31) - 1)

    def ordered(both: Column) -> Column:
        mark = "start", "at", "end"
        bases = F.transform(both["base"], lambda b: F.struct(*(c.alias(n) for c, n in zip((b["start"], F.lit(-1), b["end"]), mark))))
        asked = F.transform(
            both["candidates"], lambda c, i: F.struct(*(x.alias(n) for x, n in zip((c["start"], i, c["end"]), mark)))
        )
        marks = F.array_sort(F.concat(bases, asked))
        whole = _let(marks, bounded)
        return _let(F.struct(both["candidates"].alias("candidates"), whole.alias("w")), free)

    def bounded(order: Column) -> Column:
        ends = F.transform(order, lambda m: F.when(m["at"] < 0, m["end"]).otherwise(F.lit(-1)))
        starts = F.transform(F.reverse(order), lambda m: F.when(m["at"] < 0, m["start"]).otherwise(none))
        before = _let(ends, lambda held: _scanned(held, lambda a, b: F.greatest(a, b)))
        after = F.reverse(_let(starts, lambda held: _scanned(held, lambda a, b: F.least(a, b))))
        return F.struct(order.alias("order"), before.alias("before"), after.alias("after"))

    def free(known: Column) -> Column:
        w = known["w"]

        def chosen(m: Column, i: Column) -> Column:
            clear = (m["at"] >= 0) & (F.get(w["before"], i) <= m["start"]) & (F.get(w["after"], i) >= m["end"])
            return F.when(clear, F.get(known["candidates"], m["at"]))

        return F.filter(F.transform(w["order"], chosen), lambda m: m.isNotNull())

    both = F.struct(candidates.alias("candidates"), base.alias("base"))
    return _let(
        both, lambda b: F.when((F.size(b["base"]) == 0) | (F.size(b["candidates"]) == 0), b["candidates"]).otherwise(ordered(b))
    )


def _symbols(piece: Column) -> Column:
    """Numbers of the characters of a string."""
    return F.transform(
        F.split(piece, ""), lambda c: F.when(F.ascii(c) < _OTHER, F.ascii(c)).otherwise(F.lit(_OTHER))
    )


def _pairs(piece: Column, first: Column) -> Column:
    """Numbers of the pairs (character before, character) of a string; `first` stands before it."""
    return _let(
        F.concat(F.array(first), _symbols(piece)),
        lambda s: F.transform(
            F.slice(s, 2, F.size(s)), lambda c, i: F.get(s, i) * F.lit(_SYMBOLS) + c
        ),
    )


def _score(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of a string of ASCII characters, piece by piece, so in bounded memory."""
    data = token.cast("binary")
    pieces = F.sequence(F.lit(0), F.floor((F.length(token) - 1) / _PIECE).cast("int"))

    def added(total: Column, k: Column) -> Column:
        at = k * F.lit(_PIECE) + F.lit(1)
        before = F.when(k == 0, F.lit(_START)).otherwise(
            F.ascii(F.substring(data, at - F.lit(1), F.lit(1)).cast("string"))
        )
        pairs = _pairs(F.substring(data, at, F.lit(_PIECE)).cast("string"), before)
        return total + F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(ratios, p))

    return F.aggregate(pieces, F.lit(0.0), added) / F.length(token)


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratios by pair of characters (random over ordinary), and the mean that counts as random."""

    ratios: list[float]
    threshold: float

    def column(self) -> Column:
        """The ratios as one constant."""
        return F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, random) out of a corpus, one row an occurrence.

    Random are the values that the patterns find, and the digest of each text in both forms of
    base 64; ordinary are the identifiers (SAMPLE) that overlap no match of a pattern.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    digest = F.base64(F.unhex(F.sha2(text, 256)))

    def labelled(found: Column, group: str, random: bool) -> Column:
        none = F.array().cast("array<struct<token:string,random:boolean>>")
        each = F.transform(found, lambda m: F.struct(m[group].alias("token"), F.lit(random).alias("random")))
        return F.coalesce(each, none)

    def every(known: Column) -> Column:
        kinds = [("assign", "g2"), ("access", "g0"), ("hex", "g0")]
        base = F.concat(*(_spans(known[kind], kind) for kind, _ in kinds))
        values = [labelled(known[kind], group, True) for kind, group in kinds]
        return F.concat(labelled(_apart(known["other"], base), "g0", False), known["digests"], *values)

    digests = F.array(F.translate(digest, "=", ""), F.translate(digest, "+/=", "-_"))
    found = F.struct(
        _assigned(text).alias("assign"),
        _matches(text, ACCESS).alias("access"),
        _matches(text, HEX).alias("hex"),
        F.coalesce(_matches(text, SAMPLE), F.array().cast(_CANDIDATES)).alias("other"),
        F.transform(digests, lambda d: F.struct(d.alias("token"), F.lit(True).alias("random"))).alias("digests"),
    )
    return docs.select(F.explode(_let(found, every)).alias("sample")).select("sample.token", "sample.random")


def _half(token: Column) -> Column:
    return (F.crc32(token.cast("binary")) % _HALVES).cast("int")


def _ratios(counts: dict[tuple[bool, int], int]) -> list[float]:
    """Log-likelihood ratios by pair, out of the counts of pairs by label.

    A character's likelihood after another is smoothed by its likelihood anywhere.
    """
    after: dict[tuple[bool, int], int] = {}
    alone: dict[tuple[bool, int], int] = {}
    for (random, pair), n in counts.items():
        first, second = divmod(pair, _SYMBOLS)
        after[random, first] = after.get((random, first), 0) + n
        alone[random, second] = alone.get((random, second), 0) + n
    total = {r: sum(n for (label, _), n in alone.items() if label == r) for r in (False, True)}

    def likelihood(random: bool, pair: int) -> float:
        first, second = divmod(pair, _SYMBOLS)
        anywhere = (alone.get((random, second), 0) + 1) / (total[random] + _ALPHABET)
        seen = after.get((random, first), 0)
        return log((counts.get((random, pair), 0) + _SMOOTHING * anywhere) / (seen + _SMOOTHING))

    return [likelihood(True, p) - likelihood(False, p) for p in range(_SYMBOLS * _SYMBOLS)]


def _counted(samples: DataFrame) -> list[dict[tuple[bool, int], int]]:
    """Counts of (label, pair) in each half of the samples: bounded by the pairs there are."""
    data = F.col("token").cast("binary")
    pieces = F.sequence(F.lit(0), F.floor((F.length("token") - 1) / _PIECE).cast("int"))
    at = F.col("piece") * F.lit(_PIECE) + F.lit(1)
    before = F.when(F.col("piece") == 0, F.lit(_START)).otherwise(
        F.ascii(F.substring(data, at - F.lit(1), F.lit(1)).cast("string"))
    )
    rows = samples.select("token", "random", _half(F.col("token")).alias("half"), F.explode(pieces).alias("piece"))
    pairs = _pairs(F.substring(data, at, F.lit(_PIECE)).cast("string"), before)
    every = rows.select("half", "random", F.explode(pairs).alias("pair"))
    halves: list[dict[tuple[bool, int], int]] = [{} for _ in range(_HALVES)]
    for row in every.groupBy("half", "random", "pair").count().collect():
        halves[row["half"]][row["random"], row["pair"]] = row["count"]
    return halves


def _threshold(scored: DataFrame, cost: float) -> float:
    """The cut with the largest share of random samples above, less `cost` times that of ordinary ones.

    It is the middle of the first best stretch of a histogram with a fixed number of bins;
    without samples of both labels nothing is above it.
    """
    bounded = F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.col("score")))
    bins = scored.groupBy(F.floor(bounded * _BINS).alias("bin")).agg(
        F.count(F.when(F.col("random"), 1)).alias("random"), F.count(F.when(~F.col("random"), 1)).alias("ordinary")
    )
    rows = bins.orderBy("bin").collect()
    above = {name: sum(r[name] for r in rows) for name in ("random", "ordinary")}
    best, at = 0.0, float("inf")
    if not all(above.values()):
        return at
    total = dict(above)
    for here, after in zip(rows, rows[1:]):
        above = {name: n - here[name] for name, n in above.items()}
        gain = above["random"] / total["random"] - cost * above["ordinary"] / total["ordinary"]
        if gain > best:
            best, at = gain, (here["bin"] + 1 + after["bin"]) / 2 / _BINS
    return at


def _crossed(samples: DataFrame, halves: list[dict[tuple[bool, int], int]]) -> DataFrame:
    """Samples with the score that the model of the other half gives them."""
    scores = [_score(F.col("token"), SecretModel(_ratios(h), 0.0).column()) for h in reversed(halves)]
    score = F.when(_half(F.col("token")) == 0, scores[0]).otherwise(scores[1])
    return samples.select("token", "random", score.alias("score"))


def train_secret_model(samples: DataFrame) -> SecretModel:
    """A model out of (token, random); rows with a null or an empty token are left out.

    Some strings of a corpus that no pattern finds are secrets all the same, and would be
    learnt as ordinary.  So models of either half score the other half, and ordinary samples
    that look random by that are left out; the same again, without them, gives the threshold.
    """
    samples = written(samples.select("token", "random").filter("token <> '' and random is not null"), "samples")
    scored = written(_crossed(samples, _counted(samples)), "sample-scores")
    clean = scored.filter(F.col("random") | (F.col("score") <= _threshold(scored, 1.0))).drop("score")
    halves = _counted(clean)
    whole = dict(halves[0])
    for key, n in halves[1].items():
        whole[key] = whole.get(key, 0) + n
    return SecretModel(_ratios(whole), _threshold(_crossed(clean, halves), _FALSE_ALARM_COST))


def find_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """Documents with `base_spans` and `spans`: arrays of (start, kind, end) by start, then kind.

    `kind` is the place in KINDS; positions count code points, the end is exclusive.  `spans`
    holds the base spans, and the candidates that overlap none of them and score above the
    model's threshold.  A null text is empty and has no spans.  Very long texts and strings
    take time in proportion to their length (times its logarithm, for positions).  Repeated
    rows stay; input columns with the names of the new ones are replaced.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    ratios = model.column()
    likely = F.filter(_matches(text, CANDIDATE), lambda m: _score(m["g0"], ratios) > F.lit(model.threshold))

    def both(base: Column) -> Column:
        more = _spans(_apart(F.coalesce(likely, F.array().cast(_CANDIDATES)), base), "random")
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("all"))

    kept = [column(c) for c in others(docs, "base_spans", "spans")]
    # Exploding one value is a barrier: what it holds is computed once, however often it is used.
    found = docs.select(*kept, F.explode(F.array(_let(base_spans(text), both))).alias("__found"))
    return found.select(
        *(column(c) for c in found.columns[:-1]),
        F.col("__found.base").alias("base_spans"),
        F.col("__found.all").alias("spans"),
    )


def spans_text(spans: Column | str) -> Column:
    """`kind:start:end`, joined by commas."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    kinds = F.array(*(F.lit(k) for k in KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return F.array_join(each, ",")


def count_of(spans: Column | str, kind: str) -> Column:
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
