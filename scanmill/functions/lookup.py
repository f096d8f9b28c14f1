"""Terms to ids and ids to terms inside the row, against an index that tasks share.

An index holds the terms of a dictionary packed in one Arrow array, ordered by the hash
of the term or by the id, and is broadcast.  A batch of token arrays is one flat column:
its distinct tokens are found first, and only these are hashed and looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements of token or id arrays that are worked on at once.
PORTION = 1 << 18


def _hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))


def _lists(arrays: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a column of lists; a null list is empty."""
    offsets = np.asarray(arrays.offsets, np.int64)
    if arrays.null_count:
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(lengths)]), arrays.flatten()
    return offsets - offsets[0], arrays.flatten()


def _relisted(offsets: np.ndarray, kept: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of those values of a flat column that are kept."""
    upto = np.concatenate([[0], np.cumsum(kept)])
    return pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), values)


def portions(arrays: pa.Array) -> Iterator[slice]:
    """Runs of whole lists with at most `PORTION` elements together, or of one list."""
    upto, _ = _lists(arrays)
    start = 0
    while start < len(arrays):
        end = int(np.searchsorted(upto, upto[start] + PORTION, side="right")) - 1
        end = max(end, start + 1)
        yield slice(start, end)
        start = end


def in_portions(arrays: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A column of lists changed portion by portion, so that only these are held in work arrays."""
    parts = [change(arrays[part]) for part in portions(arrays)]
    return pa.concat_arrays(parts) if parts else change(arrays)


@dataclass(frozen=True)
class TermIndex:
    """Terms in the order of their hashes, with their ids."""

    hashes: np.ndarray
    terms: pa.Array
    ids: np.ndarray

    @staticmethod
    def of(terms: pa.Array, ids: np.ndarray) -> TermIndex:
        hashes = _hashes(terms)
        # Equal hashes stand in the order of ids, so that the first id wins if a term is repeated.
        order = np.lexsort((ids, hashes))
        return TermIndex(hashes[order], terms.take(pa.array(order)), ids[order].astype(np.int32))

    def ids_of(self, tokens: pa.Array) -> np.ndarray:
        """The id of each of some distinct tokens, 0 if it is unknown.

        Terms are compared, not only their hashes; terms that share one are tried in turn.
        """
        found = np.zeros(len(tokens), np.int32)
        if not len(self.hashes) or not len(tokens):
            return found
        hashes = _hashes(tokens)
        at = np.searchsorted(self.hashes, hashes)
        open_ = np.flatnonzero(at < len(self.hashes))
        while len(open_):
            open_ = open_[self.hashes[at[open_]] == hashes[open_]]
            here = pa.array(open_)
            same = pc.equal(self.terms.take(pa.array(at[open_])), tokens.take(here))
            same = same.to_numpy(zero_copy_only=False).astype(bool)
            found[open_[same]] = self.ids[at[open_[same]]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hashes)]
        return found

    def codes_of(self, tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The id of each token, and the distinct ones that the index lacks.

        Of those, the n-th (from 0) has the code -1 - n; null tokens have the code 0.
        """
        coded = tokens.dictionary_encode()
        # A last entry stands for null tokens.
        codes = np.append(self.ids_of(coded.dictionary), np.int32(0))
        unknown = np.flatnonzero(codes[:-1] == 0)
        codes[unknown] = -1 - np.arange(len(unknown), dtype=np.int32)
        places = coded.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)
        return codes[places], coded.dictionary.take(pa.array(unknown))

    def encode(self, arrays: pa.Array) -> pa.Array:
        """Lists of tokens to lists of ids; unknown and null tokens are dropped."""
        offsets, tokens = _lists(arrays)
        ids, _ = self.codes_of(tokens)
        kept = ids > 0
        return _relisted(offsets, kept, pa.array(ids[kept], pa.int32()))


@dataclass(frozen=True)
class IdIndex:
    """Terms in the order of their ids."""

    ids: np.ndarray
    terms: pa.Array

    @staticmethod
    def of(terms: pa.Array, ids: np.ndarray) -> IdIndex:
        order = np.argsort(ids, kind="stable")
        return IdIndex(ids[order], terms.take(pa.array(order)))

    def decode(self, arrays: pa.Array, late: IdIndex | None = None, keep_unknown: bool = False) -> pa.Array:
        """Lists of ids to lists of terms; ids unknown here and to `late` are dropped, like nulls, or become null."""
        offsets, flat = _lists(arrays)
        valid = flat.is_valid().to_numpy(zero_copy_only=False)
        ids = flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
        at, kept = self._places(ids)
        terms = self.terms
        if late is not None and len(late.ids):
            # The terms of `late` stand behind those of this index.
            more, found = late._places(ids)
            found &= ~kept
            at[found] = more[found] + len(self.ids)
            kept |= found
            distinct, at_distinct = np.unique(at[kept & valid], return_inverse=True)
            own = distinct[distinct < len(self.ids)]
            rest = distinct[len(own) :] - len(self.ids)
            terms = pa.concat_arrays([self.terms.take(pa.array(own)), late.terms.take(pa.array(rest))])
            return _relisted(offsets, kept & valid, terms.take(pa.array(at_distinct)))
        kept &= valid
        if keep_unknown:
            return _relisted(offsets, np.ones(len(at), bool), terms.take(pa.array(at, mask=~kept)))
        return _relisted(offsets, kept, terms.take(pa.array(at[kept])))

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where some ids stand, and whether they do."""
        at = np.searchsorted(self.ids, ids)
        kept = at < len(self.ids)
        kept[kept] = self.ids[at[kept]] == ids[kept]
        return at, kept


def index_of(dictionary: DataFrame, kind: type[TermIndex] | type[IdIndex]):
    """An index over (term, term_id), broadcast; the caller bounds the dictionary."""
    rows = dictionary.select("term", F.col("term_id").cast("int")).filter("term is not null and term_id is not null")
    table = rows.toArrow()
    terms = table.column("term").combine_chunks().cast(pa.string())
    index = kind.of(terms, table.column("term_id").to_numpy())
    return dictionary.sparkSession.sparkContext.broadcast(index)


def encoded(tokens: Column | str, index) -> Column:
    """Term ids of a token array, in the row."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(arrays: pa.Array) -> pa.Array:
        return in_portions(arrays, index.value.encode)

    return encode(tokens)


def decoded(term_ids: Column | str, index, keep_unknown: bool = False) -> Column:
    """Terms of an id array, in the row; null for unknown ids if these are kept."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def decode(arrays: pa.Array) -> pa.Array:
        return in_portions(arrays, lambda part: index.value.decode(part, keep_unknown=keep_unknown))

    return decode(term_ids)


def _packed(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """One row for each portion of rows: the rows and their lengths, their codes, and the keys asked for.

    The last column of the input is the array; `keys_of` gives its codes and keys.
    """
    for batch in batches:
        arrays = batch.columns[-1]
        for part in portions(arrays):
            offsets, flat = _lists(arrays[part])
            lengths = pa.array(np.diff(offsets), pa.int32())
            rows = pa.StructArray.from_arrays(
                [*(c[part] for c in batch.columns[:-1]), lengths], names=[*batch.schema.names[:-1], "_n"]
            )
            codes, keys = keys_of(flat)
            one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (rows, pa.array(codes, pa.int32()), keys)]
            yield pa.RecordBatch.from_arrays(one, names=["_rows", "_codes", "_keys"])


def _unpacked(packed: pa.Table) -> tuple[list[pa.Array], list[str], pa.Array]:
    """The columns of a portion's rows, their names, and the column of lists of codes."""
    rows = packed.column("_rows").combine_chunks().flatten()
    codes = packed.column("_codes").combine_chunks().flatten()
    names = [f.name for f in rows.type][:-1]
    columns = [rows.field(n) for n in names]
    upto = np.concatenate([[0], np.cumsum(rows.field("_n").to_numpy(zero_copy_only=False))])
    return columns, names, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), codes)


def asked_terms(docs: DataFrame, keep: list[str], index) -> DataFrame:
    """(_rows, _codes, _keys): rows with `tokens`, packed, with ids and the terms that the index lacks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, index.value.codes_of)

    return _pack(docs.select(*keep, "tokens"), pack, T.StringType())


def asked_ids(vectors: DataFrame, keep: list[str], beyond: int) -> DataFrame:
    """(_rows, _codes, _keys): rows with `term_ids`, packed, with the distinct ids above a bound."""

    def keys_of(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
        codes = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return codes, pa.array(np.unique(codes[codes > beyond]), pa.int32())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, keys_of)

    return _pack(vectors.select(*keep, "term_ids"), pack, T.IntegerType())


def _pack(rows: DataFrame, pack: Callable, key: T.DataType) -> DataFrame:
    row = T.StructType([*rows.schema.fields[:-1], T.StructField("_n", T.IntegerType())])
    kinds = {"_rows": row, "_codes": T.IntegerType(), "_keys": key}
    schema = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()])
    return rows.mapInArrow(pack, schema)


def with_late_ids(packed: pa.Table, late: pa.Table) -> pa.Table:
    """The rows of a portion with `term_ids`, by its codes and by the ids (_at, term_id) found for its keys."""
    columns, names, lists = _unpacked(packed)
    codes = lists.values.to_numpy(zero_copy_only=False)
    found = np.zeros(1 - min(0, int(codes.min(initial=0))), np.int32)
    # The first id wins if a term is repeated.
    ids = late.column("term_id").to_numpy()
    order = np.argsort(-ids, kind="stable")
    found[1 + late.column("_at").to_numpy()[order]] = ids[order]
    codes = np.where(codes < 0, found[np.maximum(-codes, 0)], codes)
    kept = codes > 0
    coded = _relisted(np.asarray(lists.offsets, np.int64), kept, pa.array(codes[kept], pa.int32()))
    return pa.Table.from_arrays([*columns, coded], names=[*names, "term_ids"])


def with_late_terms(packed: pa.Table, late: pa.Table, index: IdIndex) -> pa.Table:
    """The rows of a portion with `terms`, by the index and by the terms (term_id, term) found besides."""
    columns, names, lists = _unpacked(packed)
    more = IdIndex.of(late.column("term").combine_chunks().cast(pa.string()), late.column("term_id").to_numpy())
    return pa.Table.from_arrays([*columns, index.decode(lists, more)], names=[*names, "terms"])


def opened(packed: DataFrame) -> DataFrame:
    """The rows of portions, with `_ids` (0 if not known yet) and `_unknown`, the terms that these zeros stand for."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                columns, names, lists = _unpacked(one)
                keys = one.column("_keys").combine_chunks().flatten()
                codes = lists.values.to_numpy(zero_copy_only=False)
                asked = codes < 0
                unknown = _relisted(np.asarray(lists.offsets, np.int64), asked, keys.take(pa.array(-1 - codes[asked])))
                ids = pa.ListArray.from_arrays(lists.offsets, pa.array(np.maximum(codes, 0), pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, ids, unknown], names=[*names, "_ids", "_unknown"])

    schema = T.StructType([*packed.schema["_rows"].dataType.elementType.fields[:-1]])
    schema = schema.add("_ids", T.ArrayType(T.IntegerType())).add("_unknown", packed.schema["_keys"].dataType)
    return packed.select("_rows", "_codes", "_keys").mapInArrow(open_, schema)
