"""Document vectors: term ids in document order, or unique ids with counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from scanmill.functions.lookup import (
    IdIndex,
    TermIndex,
    asked_ids,
    asked_terms,
    decoded,
    encoded,
    index_of,
    opened,
    with_late_ids,
    with_late_terms,
)
from scanmill.functions.text import MAX_DOCUMENT_CHARS, Analyzer
from scanmill.operators.documents import with_docid, with_tokens
from scanmill.runtime import exploded, keyed, together, written

# Dictionaries up to this many terms, of this many bytes each on average, are looked up
# inside the row, in an index that is broadcast.  Of larger ones only as many of the most
# frequent terms are, and the tokens outside that head are looked up by a shuffle join.
BROADCAST_TERMS = 1_000_000
_TERM_BYTES = 64
_ENTRY_BYTES = 48  # of an index entry and what building it takes, without the term

# Copies of the rest of the dictionary in the shuffle join of those tokens.  An unknown token
# can be as frequent as any (say, one cut off by a df maximum): it comes once for each portion
# of rows, and salted, these are spread.
TAIL_SALTS = 4


def _broadcast_head(dictionary: DataFrame, terms: int) -> int | None:
    """How many of the most frequent terms may be broadcast; `None` for all of them."""
    size = F.sum(F.octet_length("term") + _ENTRY_BYTES)
    rows, held = dictionary.agg(F.count(F.lit(1)), size).first()
    if rows <= terms and (held or 0) <= terms * _TERM_BYTES:
        return None
    return min(terms, int(terms * _TERM_BYTES * rows / held))


def _tail_matches(packed: DataFrame, tail: DataFrame, key: str, value: str) -> DataFrame:
    """(_of, _at, key, value), for the portion `_of`, of the keys of each portion of rows that the tail holds.

    A key comes once for each portion, however often its rows have it.  The tail is never
    broadcast: how large it is decides the size of a shuffle, and of nothing else.
    """
    each = packed.select("_chunk", F.posexplode("_keys").alias("_at", key))
    salted = each.withColumn("_salt", F.pmod(F.col("_chunk"), F.lit(TAIL_SALTS)).cast("int"))
    salts = F.sequence(F.lit(0), F.lit(TAIL_SALTS - 1))
    copies = tail.select(key, value, F.explode(salts).alias("_salt"))
    return salted.join(copies.hint("merge"), [key, "_salt"]).select(F.col("_chunk").alias("_of"), "_at", key, value)


def _repeated(packed: DataFrame, group: list[str]) -> DataFrame | None:
    """The keys, as `_same_` columns, that several rows of the portions share; `None` if there are none."""
    keys = packed.select(F.explode("_rows").alias("_row"))
    keys = keys.select(*(F.col("_row").getField(g).alias(f"_same_{g}") for g in group))
    twice = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return None if twice.isEmpty() else twice


def _among(rows: DataFrame, repeated: DataFrame, group: list[str], how: str) -> DataFrame:
    return rows.join(repeated, [F.col(g).eqNullSafe(F.col(f"_same_{g}")) for g in group], how)


def _shared_matches(
    rows: DataFrame, group: list[str], places: Column, tail: DataFrame, key: str, value: str, found: Column
) -> DataFrame:
    """Rows of a key that is not theirs alone, with `_whole`: each has the tail's values of all of them.

    `_unknown` are the array elements that the head does not know, `places` where they stand,
    and `found` the (position, value) pairs that it does know.
    """
    each = rows.select(*group, F.explode(F.arrays_zip(places.alias("pos"), F.col("_unknown").alias("key"))).alias("_e"))
    each = each.select(*group, F.col("_e.pos").alias("_pos"), F.col("_e.key").alias(key))
    matched = each.join(tail.select(key, value).hint("merge"), key)
    late = matched.groupBy(*group).agg(F.collect_list(F.struct("_pos", value)).alias("_late"))
    late = late.select(*(F.col(g).alias(f"_same_{g}") for g in group), "_late")
    pairs = F.when(F.col("_late").isNull(), found).otherwise(F.concat(found, "_late"))
    joined = _among(rows, late, group, "left")
    return joined.withColumn("_whole", F.transform(F.array_sort(pairs), lambda x: x[value]))


def _packed(portions: DataFrame) -> DataFrame:
    """Portions of rows with a number, written: two branches read them."""
    return written(portions.withColumn("_chunk", F.monotonically_increasing_id()), "portions")


def encode_tokens(
    docs: DataFrame,
    dictionary: DataFrame,
    keep: list[str],
    row_key: list[str] | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Replace `tokens` by `term_ids`, in order, unknown tokens dropped.

    Every input row gives one output row, if need be with an empty array.  Nothing is
    exchanged, unless the dictionary is too large to be shared: then rows are coded in portions
    by its head, the distinct tokens of a portion that the head lacks meet the tail, and the
    portion meets what they find.  Rows that share a `row_key` and all of `keep` are one
    document there: what the tail has for one of them is in all of them.
    """
    head_terms = _broadcast_head(dictionary, broadcast_terms)
    if head_terms is None:
        index = index_of(dictionary, TermIndex)
        return docs.select(*keep, encoded("tokens", index).alias("term_ids"))
    # Ids are dense and ordered by df: this head is bounded, and holds all hot terms.
    is_head = F.col("term_id") <= head_terms
    index = index_of(dictionary.filter(is_head), TermIndex)
    group = together(row_key or [], keep)
    packed = _packed(asked_terms(docs, group, index))
    tail = dictionary.filter(~is_head).withColumn("term_id", F.col("term_id").cast("int"))
    late = _tail_matches(packed, tail, "term", "term_id").select("_of", "_at", "term_id")
    schema = StructType([*docs.select(*group).schema.fields]).add("term_ids", ArrayType(IntegerType()))
    rows = packed.drop("_keys").groupBy("_chunk").cogroup(late.groupBy("_of"))
    coded = rows.applyInArrow(with_late_ids, schema)
    repeated = _repeated(packed, group) if row_key else None
    if repeated is None:
        return coded.select(*keep, "term_ids")
    some = _among(opened(packed), repeated, group, "left_semi")
    places = F.filter(F.transform("_ids", lambda v, i: F.when(v == 0, i)), lambda p: p.isNotNull())
    known = F.filter(F.transform("_ids", lambda v, i: F.struct(i.alias("_pos"), v.alias("term_id"))), lambda e: e["term_id"] > 0)
    shared = _shared_matches(some, group, places, tail, "term", "term_id", known)
    alone = _among(coded, repeated, group, "left_anti").select(*keep, "term_ids")
    return alone.unionByName(shared.select(*keep, F.col("_whole").alias("term_ids")))


def build_doc_vectors(
    docs: DataFrame,
    dictionary: DataFrame,
    analyzer: str | Analyzer,
    html: bool = True,
    max_chars: int | None = MAX_DOCUMENT_CHARS,
    row_key: list[str] | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(docid, term_ids, doc_len) for every document with an id; `docs` may be what `analyzed` makes of them.

    Over-long and unreadable documents give an empty vector.
    """
    tokens = with_tokens(with_docid(docs), analyzer, html, max_chars)
    coded = encode_tokens(tokens, dictionary, ["docid"], row_key, broadcast_terms)
    return coded.select("docid", "term_ids", F.size("term_ids").alias("doc_len"))


def decode_doc_vectors(
    vectors: DataFrame,
    dictionary: DataFrame,
    row_key: list[str] | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(docid, terms): the terms of each flat vector, in order; unknown ids are dropped.

    Nothing is exchanged, unless the dictionary is too large to be shared: see `encode_tokens`.
    """
    head_terms = _broadcast_head(dictionary, broadcast_terms)
    if head_terms is None:
        return vectors.select("docid", decoded("term_ids", index_of(dictionary, IdIndex)).alias("terms"))
    is_head = F.col("term_id") <= head_terms
    index = index_of(dictionary.filter(is_head), IdIndex)
    group = together(row_key or [], ["docid"])
    packed = _packed(asked_ids(vectors, group, head_terms))
    tail = dictionary.filter(~is_head).withColumn("term_id", F.col("term_id").cast("int"))
    late = _tail_matches(packed, tail, "term_id", "term").select("_of", "term_id", "term")
    schema = StructType([vectors.schema[g] for g in group]).add("terms", ArrayType(StringType()))

    def decode(rows: pa.Table, found: pa.Table) -> pa.Table:
        return with_late_terms(rows, found, index.value)

    rows = packed.drop("_keys").groupBy("_chunk").cogroup(late.groupBy("_of"))
    whole = rows.applyInArrow(decode, schema)
    repeated = _repeated(packed, group) if row_key else None
    if repeated is None:
        return whole.select("docid", "terms")
    some = _among(opened(packed).drop("_unknown"), repeated, group, "left_semi")
    some = some.withColumn("_terms", decoded("_ids", index, True))
    some = some.withColumn("_unknown", F.filter("_ids", lambda _, i: F.get("_terms", i).isNull()))
    places = F.filter(F.transform("_terms", lambda t, i: F.when(t.isNull(), i)), lambda p: p.isNotNull())
    numbered = F.transform("_terms", lambda t, i: F.struct(i.alias("_pos"), t.alias("term")))
    known = F.filter(numbered, lambda e: e["term"].isNotNull())
    shared = _shared_matches(some, group, places, tail, "term_id", "term", known)
    alone = _among(whole, repeated, group, "left_anti").select("docid", "terms")
    return alone.unionByName(shared.select("docid", F.col("_whole").alias("terms")))


def _let(value: Column, body) -> Column:
    """Bind a value to a lambda variable, so that `body` computes it only once."""
    return F.transform(F.array(value), body)[0]


def unique_terms(term_ids: Column | str) -> Column:
    """array<struct<term_id, tf>> of a flat vector, sorted by id.

    Sorts the ids, finds where each run begins, and takes run lengths: linear after
    the sort, within the row, without a shuffle.
    """
    ids = F.col(term_ids) if isinstance(term_ids, str) else term_ids

    def runs(ordered: Column) -> Column:
        def begins(_: Column, i: Column) -> Column:
            return (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))

        positions = F.transform(ordered, lambda _, i: i)
        starts = F.filter(positions, lambda i: begins(i, i))

        def entry(found: Column):
            def build(s: Column, k: Column) -> Column:
                end = F.coalesce(F.get(found, k + 1), F.size(ordered))
                return F.struct(F.get(ordered, s).alias("term_id"), (end - s).alias("tf"))

            return F.transform(found, build)

        return _let(starts, entry)

    return _let(F.sort_array(ids), runs)


def to_unique_vectors(vectors: DataFrame) -> DataFrame:
    """(docid, terms, doc_len): sorted distinct ids with counts, original length."""
    return vectors.select(
        "docid", unique_terms("term_ids").alias("terms"), F.size("term_ids").alias("doc_len")
    )


def postings(
    vectors: DataFrame, row_key: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """(docid, doc_len, term_id, tf) of flat or unique vectors, without a shuffle.

    Also the columns that identify a document: its key and `docid`.
    """
    rows, key = keyed(vectors, row_key)
    group = together(key, ["docid"])
    terms = F.col("terms") if "terms" in vectors.columns else unique_terms("term_ids")
    columns = together(group, ["doc_len"])
    entries = exploded(rows.select(*columns, terms.alias("terms")), "terms", "t")
    return entries.select(*columns, "t.term_id", "t.tf"), group
