"""Near duplicates by an exact Jaccard join over word n-grams, with adaptive prefixes.

Two sets whose Jaccard similarity reaches the threshold t share at least l of their
first |x| - ceil(t |x|) + l shingles, in any order of shingles common to all sets.  The
order puts shingles that are frequent in some task's documents last, and then those whose
lists of sets turn out to be long, however large the table in which they are spread.

Each set chooses l.  A longer prefix meets more candidates, but demands more matches
before a pair's full sets are compared.  It may also hold shingles whose lists are long:
if k of them lie in the prefix for l > k, then any partner shares l - k shingles on short
lists, and the long lists need not be looked at.  So short lists are joined with
themselves and give pairs; sets for which no such l is found, which are those of large
groups of copies, meet on long lists as well.

Equal sets are one node from the start.  Sets that meet on long lists are compared in
blocks of bounded size, where overlaps are matrix products and only links that join up
components are returned, so that the pairs of a group are never emitted.  Sets are
rebuilt from the text of the documents that take part, and shuffled once per leader of
pairs, or block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.frames import column
from scanmill.llm.graphs import components
from scanmill.llm.textscan import LOWER, NOT_SPACE, Block, blocks, windows, words_of
from scanmill.runtime import written

VERIFY_COST = 50  # comparing two full sets, in units of one posting met
SHORT_LIST = 16
BLOCK_SHINGLES = 1 << 20
BLOCK_SETS = 2000
ORDER_TABLE = 1 << 19
# Scans that look for long lists, each under the order that the last one made.  One in so many
# postings may lie on a list that the order does not know; more than that give another order,
# and more than the second share another scan.
ORDER_ROUNDS = 3
_STRAY_POSTINGS, _MANY_STRAYS = 50, 10
BROADCAST_ROWS = 400_000
_LOCAL_REPEATS = 3
_FLUSH = 2 << 20
_FILTER_BITS = 22
_POSTINGS = 1 << 16  # a task hands over at once, and the JVM holds beside its heap
_SEEN_SETS = 1 << 16


def shingle_sets(block: Block, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of runs of `words` words) of each text.

    A text with fewer words, but not none, has one shingle: all its words.
    """
    found = words_of(block, NOT_SPACE, LOWER)
    hashes = windows(found.hashes, words)
    counts = found.counts()
    for row in range(block.rows):
        first, count = int(found.first[row]), int(counts[row])
        if count >= words:
            yield row, np.unique(hashes[first : first + count - words + 1])
        elif count:
            yield row, windows(found.hashes[first : first + count], count)
        else:
            yield row, np.zeros(0, np.uint64)


def _node(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets_of(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for block in blocks(texts):
        for row, shingles in shingle_sets(block, words):
            yield block.first + row, shingles


def _described(docs: DataFrame, words: int) -> DataFrame:
    """Two kinds of rows in one scan: (doc, size, node), and (shingle, seen).

    The second kind has the shingles that some task saw in several documents; its counts
    only serve to order shingles.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "size", "node", "shingle", "seen"]

    def repeats(held: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= _LOCAL_REPEATS
        shingles, seen = values[often].view(np.int64), counts[often]
        none = pa.nulls(len(seen))
        return pa.RecordBatch.from_arrays(
            [none.cast(ids.type), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(shingles), pa.array(seen)],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ids = [], 0, None
        for batch in batches:
            ids = batch.column(0)
            sizes, nodes = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for row, shingles in _sets_of(batch.column(1), words):
                sizes[row], nodes[row] = len(shingles), _node(shingles)
                held.append(shingles)
                size += len(shingles)
                if size >= _FLUSH:
                    yield repeats(held, ids)
                    held, size = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(nodes, pa.binary()), none, none], names=names
            )
        if held:
            yield repeats(held, ids)

    return docs.mapInArrow(run, f"doc {kind}, size bigint, node binary, shingle bigint, seen bigint")


class Order:
    """Shingles that come late in the common order, with how often they were seen."""

    def __init__(self, shingles: np.ndarray, seen: np.ndarray) -> None:
        order = np.argsort(shingles)
        self.shingles, self.seen = shingles[order], seen[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.shingles >> np.uint64(64 - _FILTER_BITS)] = True

    def first(self, shingles: np.ndarray, count: int) -> np.ndarray:
        """The first `count` of sorted distinct shingles."""
        late = np.flatnonzero(self.filter[shingles >> np.uint64(64 - _FILTER_BITS)])
        if len(late) == 0:
            return shingles[:count]
        at = np.searchsorted(self.shingles, shingles[late])
        at[at == len(self.shingles)] = 0
        known = self.shingles[at] == shingles[late]
        rank = np.zeros(len(shingles), np.int64)
        rank[late[known]] = self.seen[at[known]]
        return shingles[np.lexsort((shingles, rank))[:count]]


def _order(seen: DataFrame, size: int) -> Order:
    """The `size` most seen of (shingle, seen) at most: the bound of what is broadcast.

    A shingle that is not in the table only stands earlier in the order of every set.
    """
    steps = seen.groupBy(F.floor(F.log2("seen") * 4).alias("step")).agg(
        F.count("*").alias("n"), F.min("seen").alias("least")
    )
    least, total = None, 0
    for row in steps.orderBy(F.desc("step")).collect():
        total += row["n"]
        if total > size:
            break
        least = row["least"]
    if least is None:
        return Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    table = seen.filter(F.col("seen") >= least).toArrow()
    return Order(
        table.column("shingle").to_numpy().view(np.uint64), table.column("seen").to_numpy()
    )


def _common_order(docs: DataFrame, described: DataFrame, words: int, threshold: tuple[int, int], size: int):
    """The order of shingles, broadcast: frequent ones last.

    What tasks saw misses shingles that are spread thinly over a large table; left in the
    prefixes, they make lists that grow with it.  So the lists that an order leaves long are
    counted, and go into the next one, until few postings lie on a list not known.
    """
    context = docs.sparkSession.sparkContext
    seen = described.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    seen = written(seen, "shingle-order")
    order = context.broadcast(_order(seen, size))
    for _ in range(ORDER_ROUNDS):
        lists = _postings(docs, words, threshold, order).groupBy("shingle").agg(F.count("*").alias("seen"))
        lists = written(lists.filter(F.col("seen") > 1), "lists-seen")
        long = lists.filter(F.col("seen") > SHORT_LIST)
        known = seen.select("shingle")
        stray = long.join(known, "shingle", "left_anti").agg(F.sum("seen")).first()[0] or 0
        met = lists.agg(F.sum("seen")).first()[0] or 0
        if stray * _STRAY_POSTINGS <= met:
            break
        seen = seen.union(long.select("shingle", "seen")).groupBy("shingle").agg(F.max("seen").alias("seen"))
        seen = written(seen, "shingle-order")
        order.unpersist()
        order = context.broadcast(_order(seen, size))
        if stray * _MANY_STRAYS <= met:
            break
    return order


def _least_overlap(size: int, threshold: tuple[int, int]) -> int:
    return -(-threshold[0] * size // threshold[1])


def _most_matches(size: int, threshold: tuple[int, int]) -> int:
    """The largest l whose prefix is looked at."""
    return min(4 + size // 40, _least_overlap(size, threshold))


def _postings(docs: DataFrame, words: int, threshold: tuple[int, int], order) -> DataFrame:
    """(shingle, node, size, pos): the longest prefix that a set may choose.

    Equal sets that a task meets soon after each other are written once.
    """

    def rows(held: list[tuple[np.ndarray, bytes, int]]) -> pa.RecordBatch:
        parts, nodes, sizes = zip(*held)
        counts = np.array([len(p) for p in parts])
        at = np.repeat(np.arange(len(parts)), counts)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(parts).view(np.int64)),
                pa.array(nodes, pa.binary()).take(pa.array(at)),
                pa.array(np.array(sizes)[at]),
                pa.array(pos.astype(np.int32)),
            ],
            names=["shingle", "node", "size", "pos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, ready = [], 0
        for batch in batches:
            for _, shingles in _sets_of(batch.column(1), words):
                node = _node(shingles)
                if len(shingles) == 0 or node in seen:
                    continue
                if len(seen) == _SEEN_SETS:
                    seen.clear()
                seen.add(node)
                size = len(shingles)
                count = size - _least_overlap(size, threshold) + _most_matches(size, threshold)
                held.append((order.value.first(shingles, count), node, size))
                ready += count
                if ready >= _POSTINGS:
                    yield rows(held)
                    held, ready = [], 0
        if held:
            yield rows(held)

    return docs.mapInArrow(run, "shingle bigint, node binary, size bigint, pos int")


def _choice(
    size: int, pos: np.ndarray, df: np.ndarray, threshold: tuple[int, int], short_list: int
) -> tuple[int, int | None, bool]:
    """(prefix length, matches on short lists to demand, bound) for one set.

    `pos` and `df` are of its postings with a partner, in order.  A set is bound if no l
    leaves it a match on short lists; it then takes the longest prefix.
    """
    base = size - _least_overlap(size, threshold)
    # A partner may be smaller by the threshold, and has to have as long a prefix.
    top = _most_matches(_least_overlap(size, threshold), threshold)
    l = np.arange(1, top + 1)
    upto = np.searchsorted(pos, base + l)
    long = df > short_list
    need = l - np.concatenate([[0], np.cumsum(long)])[upto]
    met = np.concatenate([[0], np.cumsum(np.where(long, 0, df - 1))])[upto]
    free = np.flatnonzero(need >= 1)
    if len(free) == 0:
        return base + _most_matches(size, threshold), None, True
    cost = met[free] * (1 + VERIFY_COST / need[free])
    best = free[np.argmin(cost)]
    return int(base + l[best]), int(need[best]), False


def _chosen_prefixes(postings: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(shingle, node, size, pos, df, need, bound): postings inside each set's chosen prefix.

    For a given l, each short posting met costs one unit, and one in as many as have to
    match may stand for a pair that has to be compared.
    """
    # One exchange: what is dealt by shingle serves the repeated rows and the lengths of lists.
    single = postings.repartition("shingle").dropDuplicates(["shingle", "node"])
    df = F.count("*").over(Window.partitionBy("shingle")).alias("df")
    listed = written(single.select("*", df).filter("df > 1"), "lists")
    by_node = listed.groupBy("node", "size").agg(
        F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("list")
    )
    short_list = SHORT_LIST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for size, own in zip(batch.column(1).to_pylist(), batch.column(2)):
                pos, df = (own.values.field(f).to_numpy() for f in ("pos", "df"))
                found.append(_choice(size, pos, df, threshold, short_list))
            length, need, bound = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length, pa.int64()), pa.array(need, pa.int64()), pa.array(bound, pa.bool_())],
                names=["node", "length", "need", "bound"],
            )

    chosen = by_node.mapInArrow(run, "node binary, length bigint, need bigint, bound boolean")
    return written(listed.join(chosen, "node").filter("pos < length").drop("length"), "prefixes")


def _short_list_groups(prefixes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(node, g, left, right): pairs with enough shared shingles, grouped by their first node."""
    num, den = threshold
    short = prefixes.filter(F.col("df") <= SHORT_LIST)
    a = short.select("shingle", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("need").alias("na"))
    b = short.select("shingle", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("need").alias("nb"))
    similar = (F.col("sa") * den >= F.col("sb") * num) & (F.col("sb") * den >= F.col("sa") * num)
    pairs = (
        a.join(b, "shingle")
        .filter((F.col("a") < F.col("b")) & similar)
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.first(F.least("na", "nb")).alias("need"))
        .filter("n >= coalesce(need, 1)")
    )
    pairs = written(pairs.select("a", "b", F.xxhash64(F.lit("pair"), "a").alias("g")), "pairs")
    yes, no = F.lit(True), F.lit(False)
    leaders = pairs.select(F.col("a").alias("node"), "g").distinct().select("node", "g", yes.alias("left"), no.alias("right"))
    return leaders.union(pairs.select("b", "g", no, yes))


def _clusters(prefixes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(node, size, cluster): bound sets that meet on long lists, directly or through others.

    Two of them that are linked share a shingle in their prefixes for l = 1.
    """
    num, den = threshold
    first = F.col("pos") <= F.col("size") - F.expr(f"({num} * size + {den - 1}) div {den}")
    long = prefixes.filter((F.col("df") > SHORT_LIST) & F.col("bound") & first)
    heads = long.groupBy("shingle").agg(F.min("node").alias("b"))
    stars = long.join(heads, "shingle").select(F.col("node").alias("a"), "b")
    found = components(stars)
    sizes = long.select("node", "size").distinct()
    return written(found.join(sizes, "node").withColumnRenamed("root", "cluster"), "clusters")


def _blocked(clusters: DataFrame, seed: int) -> DataFrame:
    """Add the block of each set within its cluster, and the number of blocks."""
    mass = clusters.groupBy("cluster").agg(F.sum("size").alias("mass"), F.count("*").alias("n"))
    parts = F.greatest(
        F.ceil(F.col("mass") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_SETS), F.lit(1)
    ).cast("bigint")
    blocks_ = mass.select("cluster", parts.alias("parts"))
    place = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts")).alias("block")
    return clusters.join(blocks_, "cluster").select("*", place)


def _verified(
    docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, threshold: tuple[int, int]
) -> DataFrame:
    """(a, b): links found by comparing, in each group, the left sets with the right ones.

    Only as many links are returned as keep the group's components together.
    """
    wanted = groups.groupBy("node").agg(F.collect_list(F.struct("g", "left", "right")).alias("groups"))
    wanted = written(wanted.join(nodes, "node").select(F.col("doc").alias("__doc"), "node", "groups"), "wanted")
    small = wanted.count() <= BROADCAST_ROWS and groups.count() <= 4 * BROADCAST_ROWS
    side = F.broadcast(wanted) if small else wanted
    taken = docs.join(side, F.col("doc") == F.col("__doc")).select("text", "node", "groups")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lists = batch.column(1), batch.column(2)
            rows: list[tuple] = []
            held = 0
            for row, shingles in _sets_of(batch.column(0), words):
                # Rows that share an id may have another text than the one asked for.
                if _node(shingles) != own[row].as_py():
                    continue
                data = shingles.tobytes()
                for group in lists[row].as_py():
                    rows.append((group["g"], group["left"], group["right"], own[row].as_py(), data))
                    held += len(data)
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)

    sets = taken.mapInArrow(emit, "g bigint, left boolean, right boolean, node binary, shingles binary")
    together = sets.repartition("g").sortWithinPartitions("g")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches):
            found = _links(group, threshold)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())],
                    names=["a", "b"],
                )

    return together.mapInArrow(link, "a binary, b binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["g", "left", "right", "node", "shingles"]
    )


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (left, right, node, shingles) of each run of equal `g`; equal sets come once."""
    current, rows = None, {}
    for batch in batches:
        for g, left, right, node, data in zip(*(c.to_pylist() for c in batch.columns)):
            if g != current:
                if rows:
                    yield list(rows.values())
                current, rows = g, {}
            if node in rows:
                old = rows[node]
                rows[node] = (old[0] or left, old[1] or right, node, old[3])
            else:
                rows[node] = (left, right, node, np.frombuffer(data, np.uint64))
    if rows:
        yield list(rows.values())


def _links(group: list[tuple], threshold: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """Links of left with right sets, one per set that joins a component already begun."""
    num, den = threshold
    left = [i for i, r in enumerate(group) if r[0]]
    right = [i for i, r in enumerate(group) if r[1]]
    sets = [r[3] for r in group]
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(group)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, overlap in _overlaps(sets, left, right):
        hits = np.flatnonzero(overlap * den >= num * (sizes[i] + sizes[right] - overlap))
        for j in hits.tolist():
            x, y = root(i), root(right[j])
            if x != y:
                parent[y] = x
                found.append((group[i][2], group[right[j]][2]))
    return found


def _overlaps(sets: list[np.ndarray], left: list[int], right: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sizes of the intersections of set i with the right sets) for each left set."""
    if len(left) == 1:
        own = sets[left[0]]
        counts = []
        for j in right:
            at = np.searchsorted(own, sets[j])
            at[at == len(own)] = 0
            counts.append(int((own[at] == sets[j]).sum()))
        yield left[0], np.array(counts, np.int64)
        return
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column_of = np.full(len(values), -1)
    common = np.flatnonzero(seen > 1)
    column_of[common] = np.arange(len(common))
    cells = column_of[at]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    owner, cells = owner[cells >= 0], cells[cells >= 0]
    order = np.argsort(cells, kind="stable")
    owner, cells = owner[order], cells[order]
    width = 1024
    for low in range(0, len(left), 512):
        rows = np.array(left[low : low + 512])
        total = np.zeros((len(rows), len(right)), np.float32)
        for first in range(0, len(common), width):
            a, b = np.searchsorted(cells, (first, first + width))
            table = np.zeros((len(sets), min(width, len(common) - first)), np.float32)
            table[owner[a:b], cells[a:b] - first] = 1
            total += table[rows] @ table[right].T
        for i, overlap in zip(rows.tolist(), total):
            yield i, np.rint(overlap).astype(np.int64)


def _cluster_links(docs, nodes, clusters, words, threshold) -> DataFrame | None:
    """All links within clusters, up to what keeps components together.

    Clusters of one block are compared whole.  Larger ones are cut into blocks at random,
    several times over, which joins what is dense; then each set that is not in its
    cluster's largest component meets all others of the cluster, block by block.
    """
    if clusters.isEmpty():
        return None
    links = None
    yes, no = F.lit(True), F.lit(False)
    for seed in range(3):
        blocked = _blocked(clusters, seed)
        if seed:
            blocked = blocked.filter("parts > 1")
            if blocked.isEmpty():
                return links
        g = F.xxhash64(F.lit("block"), F.lit(seed), "cluster", "block").alias("g")
        found = written(
            _verified(docs, nodes, blocked.select("node", g, yes.alias("left"), yes.alias("right")), words, threshold),
            "links",
        )
        links = found if links is None else links.union(found)
    split = _blocked(clusters, 3).filter("parts > 1")
    labels = components(links)
    split = split.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = split.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    split = written(split.join(largest, "cluster"), "split")
    outside = split.filter("root <> main").select("node", "size", "cluster")
    if outside.isEmpty():
        return links
    chunked = _blocked(outside, 4).select(
        "node", "cluster", F.col("block").alias("chunk"), F.col("parts").alias("chunks")
    )
    chunked = written(chunked, "outside")
    chunks = chunked.select("cluster", "chunks").distinct()
    parts = split.select("cluster", "parts").distinct()
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    members = split.join(chunks, "cluster").select("node", "cluster", "block", span("chunks").alias("chunk"))
    strays = chunked.join(parts, "cluster").select("node", "cluster", span("parts").alias("block"), "chunk")
    g = F.xxhash64(F.lit("cross"), "cluster", "block", "chunk").alias("g")
    groups = members.select("node", g, no.alias("left"), yes.alias("right")).union(
        strays.select("node", g, yes, no)
    )
    return links.union(written(_verified(docs, nodes, groups, words, threshold), "links"))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: tuple[int, int] = (4, 5),
    order_table: int = ORDER_TABLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a
    document's set are its distinct runs of `words` words, or all its words if it has
    fewer.  Two documents link if `den * |x and y| >= num * |x or y|`, for the threshold
    (num, den).  `component_id` is the smallest id reached by links, the own one included.

    Null texts and texts without words have an empty set and link with nothing.  Rows with
    a null id have a null component and link nothing.  Rows that share an id count as
    documents of their own with that id.
    """
    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    described = written(_described(rows, words), "described")
    sized = described.filter("node is not null").select("doc", "size", "node")
    used = rows.filter("doc is not null")
    order = _common_order(used, described, words, threshold, order_table)
    nodes = sized.filter("size > 0 and doc is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    nodes = written(nodes, "nodes")
    prefixes = _chosen_prefixes(_postings(used, words, threshold, order), threshold)
    links = written(
        _verified(used, nodes, _short_list_groups(prefixes, threshold), words, threshold), "links"
    )
    more = _cluster_links(used, nodes, _clusters(prefixes, threshold), words, threshold)
    links = links if more is None else links.union(more)
    labels = components(links).join(nodes, "node")
    least = labels.groupBy("root").agg(F.min("doc").alias("component"))
    named = labels.join(least, "root").select("node", "component")
    named = nodes.join(named, "node", "left").select("node", F.coalesce("component", "doc").alias("component"))
    empty = F.when(F.col("size") == 0, F.col("doc"))
    component = F.when(F.col("doc").isNotNull(), F.coalesce(empty, F.col("component")))
    return sized.join(named, "node", "left").select(
        F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group of near duplicates.

    Rows without an id stay.  Of rows with equal id and text, one stays.
    """
    found = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "components")
    own = found.select(
        F.col(id_col).alias("__id"), (F.col("component_id") != F.col(id_col)).alias("lost")
    ).filter("__id is not null")
    by_id = own.groupBy("__id").agg(F.min("lost").alias("lost"), F.count("*").alias("n"))
    losers = by_id.filter("lost").select("__id")
    kept = docs.join(losers, column(id_col) == F.col("__id"), "left_anti")
    again = by_id.filter("n > 1 and not lost").select("__id")
    if again.isEmpty():
        return kept
    once = kept.join(again, column(id_col) == F.col("__id"), "left_anti")
    repeated = kept.join(again, column(id_col) == F.col("__id"), "left_semi")
    return once.union(repeated.dropDuplicates([id_col, text_col]))
