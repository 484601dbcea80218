"""N-gram Jaccard join with count vectors, overlap bounds and exact checks.

A document's set is its distinct shingles of ``k`` words (A-Z lower-cased); with fewer words the whole sequence is one
shingle. Documents link when the Jaccard similarity of their sets is ``num/den`` or more. All links between different
sets are found, or made redundant by links that join the same component:

1. One pass over all texts gives each row its set size and 64-bit set fingerprint, and a table of shingle frequencies
   in ``2**SKETCH_BITS`` cells (of that size for any corpus, so it can be sent to all tasks). Rows with one
   fingerprint are one node from here on, so exact copies cost nothing more.
2. Two sets as similar as asked share a shingle among the first ``n - ceil(t n) + 1`` of each, in any one order of all
   shingles. The order is by cell frequency, then hash, so passages that many documents hold come last. The
   (shingle, node) rows are cut to the shingles that two nodes or more have: the buckets.
3. Every node goes to its largest bucket, and its R-tree of count vectors finds pairs whose overlap bound suffices. A
   finer count vector, of which only parities are kept, rules out most of what passes falsely. Of the rest a block
   (``BLOCK`` nodes at most) gives only a spanning forest, nearest pairs first: what these pairs join needs no other
   pair, so a group of m near copies gives m - 1 pairs and not m * m / 2. The forest's pairs are checked exactly. Large
   groups of near copies become one component here.
4. All buckets that still hold two components or more are searched in the same way, with all their block pairs. Where
   an edge of a forest doesn't stand the exact check, other pairs may be needed in its place: these buckets are
   searched once more with the sets themselves at hand, and only pairs that stand the check join there. So no pair of
   different components is left that has not been ruled out.
5. Components of all links; a document's component is the least document id in it.

Why the buckets: the bound alone separates points well but boxes badly, as a box of unrelated sets is wide in all 64
coordinates; one tree over a whole corpus would compare nearly all its leaves with each other.

The checks compare 64-bit hashes of shingles. Two different sets share a fingerprint with chance 2**-64 a pair.

Defined cases: null and empty texts and texts of white space have no shingles, size 0, link with nothing and are
their own component; rows with equal text link whatever their ids; a null id never is a component's name, and a row of
null id alone has a null component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import checkpointed, discard, session_conf
from .components import components
from .rtree import Forest, RTree, apart, may_reach, point_bytes, reaches, read_points

SKETCH_BITS = 20
BLOCK = 4096
#: Buckets of up to so many nodes are one leaf.
SMALL = 16
#: Rows of a block that search its tree at once: few at first, as what they join is not searched again.
FIRST, MOST = 16, 512
_CHUNKS = 64


def _fingerprint(tokens: np.ndarray) -> int:
    """A set's fingerprint, signed."""
    x = textkit.mix(tokens + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(textkit.mix(np.array([x]))[0].astype(np.int64))


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (cell null), and at the end the task's cell counts in chunks."""
    cells = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["doc_id", "n", "node", "cell", "counts"]
    kind = None  # counts: a document's count vector, or the counts of a chunk of cells
    for batch in batches:
        kind = batch.column(0).type
        n, node, point = [], [], []
        for tokens in textkit.shingle_sets(batch.column(1), k):
            n.append(len(tokens))
            point.append(point_bytes(tokens))
            node.append(_fingerprint(tokens) if len(tokens) else None)
            np.add.at(cells, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        m = len(n)
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(m, pa.int32()), pa.array(point, pa.binary())], names)
    if kind is not None and cells.any():
        parts = cells.reshape(_CHUNKS, -1)
        yield pa.record_batch([pa.nulls(_CHUNKS, kind), pa.nulls(_CHUNKS, pa.int64()), pa.nulls(_CHUNKS, pa.int64()), pa.array(range(_CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums counts by cell chunk as they stream by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[cell] = sums.get(cell, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["cell", "counts"])


def sketch_of(profile: DataFrame) -> np.ndarray:
    """The frequencies of all cells: ``2**SKETCH_BITS`` numbers, however large the corpus is."""
    rows = profile.where("cell is not null").select("cell", "counts")
    rows = rows.repartition(_CHUNKS, "cell").mapInArrow(_added, "cell int, counts binary")
    out = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.uint64)
    for r in rows.collect():
        out[r.cell] += np.frombuffer(r.counts, np.uint32)
    return np.minimum(out.ravel(), 0xFFFFFFFF).astype(np.uint32)


def prefix(tokens: np.ndarray, sketch: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles, one of which any set similar enough has among its own rarest too."""
    n = len(tokens)
    keep = n - -(-num * n // den) + 1
    if keep >= n:
        return tokens
    often = sketch[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return tokens[np.lexsort((tokens, often))[:keep]]


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, sketch, num: int, den: int) -> Iterator[pa.RecordBatch]:
    cells = sketch.value
    for batch in batches:
        tokens, nodes = [], []
        size = 0
        for s in textkit.shingle_sets(batch.column(0), k):
            if len(s):
                p = prefix(s, cells, num, den)
                tokens.append(p)
                nodes.append(np.full(len(p), _fingerprint(s), np.int64))
                size += len(p)
            if size > 200_000:
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])
                tokens, nodes, size = [], [], 0
        if size:
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[int, bytes]] = []
        size = 0
        for s in textkit.shingle_sets(batch.column(0), k):
            rows.append((_fingerprint(s), s.tobytes()))
            size += len(s)
            if size > 200_000:
                yield _set_batch(rows)
                rows, size = [], 0
        if rows:
            yield _set_batch(rows)


def _set_batch(rows: list) -> pa.RecordBatch:
    node, tokens = zip(*rows, strict=True)
    return pa.record_batch([pa.array(node, pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets are as similar as asked."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return bool(reaches(np.array((b[at] == a).sum()), np.array(len(a)), np.array(len(b)), num, den))


def _checked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs of sets, and whether they are as similar as asked."""
    for batch in batches:
        ok = [similar(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3)), num, den) for i in range(batch.num_rows)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _small(group: np.ndarray, vectors: np.ndarray, n: np.ndarray, labels: np.ndarray, num: int, den: int):
    """Pairs within buckets of at most SMALL rows each, all buckets at once."""
    for d in range(1, SMALL):
        if len(group) <= d:
            return
        i = np.flatnonzero((group[d:] == group[:-d]) & (labels[d:] != labels[:-d]))
        i = i[(den * np.minimum(n[i], n[i + d]) >= num * np.maximum(n[i], n[i + d]))]
        for s in range(0, len(i), 1 << 14):
            c = i[s : s + (1 << 14)]
            ok = reaches(np.minimum(vectors[c], vectors[c + d]).sum(1), n[c], n[c + d], num, den)
            yield c[ok], c[ok] + d


def _searched(batches: Iterator[pa.RecordBatch], num: int, den: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Input sorted by (bucket, block a, block b), a row being bucket, a, b, own block, node, label, n, point, set.

    Yields (bucket, a, b), edges that join all components of a block pair that its candidate pairs join, so less than
    its nodes; of a bucket whose components need none nothing comes. With ``exact`` edges are checked on the sets.
    """

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        token, a, b, own, node, label, n = (table.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        vectors, parities = read_points(table.column(7).to_pylist(), n)
        start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        length = np.diff([*start, len(token)])
        group = np.repeat(np.arange(len(start)), length)
        # a component within a block pair is a number of its own
        order = np.lexsort((label, group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])
        local = np.empty(len(order), np.int64)
        local[order] = np.cumsum(new) - 1
        forest = Forest(int(new.sum()))

        def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.array([similar(*(np.frombuffer(table.column(8)[int(i)].as_buffer(), np.uint64) for i in pair), num, den) for pair in zip(x, y, strict=True)], bool)

        def joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            differ = apart(x, y, parities)
            ok = may_reach(differ, n[x], n[y], num, den)
            x, y, differ = x[ok], y[ok], differ[ok]
            at = forest.joined(local[x], local[y], differ, (lambda i: linked(x[i], y[i])) if exact else None)
            return x[at], y[at]

        edges = []
        small = np.repeat((length <= SMALL) & (a[start] == b[start]), length)
        if len(at := np.flatnonzero(small)):
            found = [(at[x], at[y]) for x, y in _small(group[at], vectors[at], n[at], label[at], num, den)]
            if found:
                edges.append(joined(*(np.concatenate([f[i] for f in found]) for i in (0, 1))))
        for s, m in zip(start, length, strict=True):
            if small[s]:
                continue
            rows = np.arange(s, s + m)
            left, right = (rows, rows) if a[s] == b[s] else (rows[own[rows] == a[s]], rows[own[rows] == b[s]])
            if not len(left) or not len(right):
                continue
            tree = RTree(vectors[right], n[right], forest.root[local[right]])
            i, step = 0, FIRST
            while i < len(left):
                part = left[i : i + step]
                found = list(tree.pairs(vectors[part], n[part], forest.root[local[part]], num, den))
                if found:
                    x, y = joined(*(side[np.concatenate([f[j] for f in found])] for j, side in ((0, part), (1, right))))
                    if len(x):
                        edges.append((x, y))
                        tree.relabel(forest.root[local[right]])  # what is one component now is not searched again
                i, step = i + step, min(2 * step, MOST)
        if edges:
            x, y = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
            both = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            yield pa.record_batch([pa.array(v) for v in (token[x], *both)], ["token", "a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_numpy() for i in range(3)), strict=True))
        cut = batch.num_rows
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut == 0 and (last is None or keys[0] == last):
            held.append(batch)
        else:
            if cut:
                yield from search([*held, batch.slice(0, cut)])
            else:
                yield from search(held)
            held = [batch.slice(cut)]
        last = keys[-1]
    if held:
        yield from search(held)


def _sets_of(need: DataFrame, nodes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the nodes in ``need``. ``nodes``: node, doc_id of a row that has the set."""
    owners = nodes.join(need, "node").select("doc_id").distinct()
    texts = rows.join(owners, "doc_id", "left_semi").select("text").unionByName(rows.where("doc_id is null").select("text"))
    return checkpointed(texts.mapInArrow(partial(_sets, k=k), "node bigint, tokens binary").join(need, "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(a, b, ok) of the pairs."""
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    with session_conf(rows.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=128):
        sets = _sets_of(need, nodes, rows, k)
        one = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
        two = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
        out = checkpointed(pairs.join(one, "b").join(two, "a").select("a", "b", "tokens_a", "tokens_b").mapInArrow(partial(_checked, num=num, den=den), "a bigint, b bigint, ok boolean"))
    discard(sets)
    return out


def _dealt_once(buckets: DataFrame) -> DataFrame:
    """Every node in its largest bucket only, which is cut to blocks that don't meet."""
    size = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    best = buckets.join(size, "token").groupBy("node").agg(F.max(F.struct("m", "token")).alias("at"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("at.m") / BLOCK)).cast("int")
    return best.select(F.col("at.token").alias("token"), block.alias("x"), block.alias("y"), block.alias("own"), "node", F.col("node").alias("label"))


def _dealt(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """The nodes of buckets that hold two components or more, once for each block pair that they are in.

    A bucket of over ``BLOCK`` nodes is cut to blocks that meet pairwise, those of its largest component by themselves:
    these meet the others' blocks, never each other. So what a large group of copies adds is one row a node and block of others.
    """
    known = buckets.join(label, "node", "left").select("token", "node", F.coalesce("component", "node").alias("label"))
    parts = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    whole = parts.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    cuts = whole.select("token", F.col("top.label").alias("top"), (F.col("m") <= BLOCK).alias("one"),
                        F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("main"))
    h = F.xxhash64("node")
    main = F.col("label") == F.col("top")
    own = F.when(F.col("one"), 0).when(main, F.col("rest") + F.pmod(h, F.col("main"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    others = F.when(F.col("one"), F.array(F.lit(0))).when(main, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("main") - 1))
    dealt = known.join(cuts, "token").withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label")


def links(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profile, links): per row doc_id, n and node; and node pairs (a, b) whose components are those of all links."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    both = checkpointed(rows.mapInArrow(partial(_profile, k=k), f"doc_id {kind}, n bigint, node bigint, cell int, counts binary"))
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(both))
    profile = both.where("cell is null").select("doc_id", "n", "node")
    nodes = both.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("counts").alias("counts"))

    keyed = rows.select("text").mapInArrow(partial(_prefixes, k=k, sketch=sketch, num=num, den=den), "token bigint, node bigint")
    shared = keyed.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least < last").select("token")
    # a bucket's name is a hash of its nodes; all of these steps keep the partitioning by token
    per = Window.partitionBy("token")
    name = F.xxhash64(F.count(F.lit(1)).over(per), F.sum(F.shiftright(F.xxhash64("node"), 24)).over(per), F.max("node").over(per))
    every = checkpointed(keyed.join(shared, "token").distinct().select("token", "node", name.alias("name")))
    sketch.unpersist()
    # buckets with the same nodes are one
    one = every.groupBy("name").agg(F.min("token").alias("token"))
    buckets = checkpointed(every.join(one, ["name", "token"], "left_semi").select("token", "node"))
    discard(every)

    def searched(dealt: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        wide = dealt.join(nodes.select("node", "n", "counts"), "node")
        wide = wide.withColumn("tokens", F.lit(None).cast("binary")) if sets is None else wide.join(sets, "node")
        wide = wide.select("token", "x", "y", "own", "node", "label", "n", "counts", "tokens").repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
        with session_conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=2048):
            return checkpointed(wide.mapInArrow(partial(_searched, num=num, den=den, exact=sets is not None), "token bigint, a bigint, b bigint"))

    found = searched(_dealt_once(buckets))
    first = _verified(found.select("a", "b").distinct(), nodes, rows, num, den, k)
    discard(found)
    label = components(first.where("ok"))
    found = searched(_dealt(buckets, label))
    fresh = found.select("a", "b").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = _verified(fresh, nodes, rows, num, den, k)
    # from here on a component is the links of its nodes to its name, which is sooner contracted again
    edges = label.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b").unionByName(second.where("ok").select("a", "b"))
    wrong = first.where("not ok").select("a", "b").unionByName(second.where("not ok").select("a", "b"))
    again = checkpointed(found.join(wrong, ["a", "b"], "left_semi").select("token").distinct())
    discard(found)
    if not again.isEmpty():
        dealt = checkpointed(_dealt(buckets.join(again, "token", "left_semi"), components(edges)))
        sets = _sets_of(dealt.select("node").distinct(), nodes, rows, k)
        edges = edges.unionByName(searched(dealt, sets).select("a", "b"))
        discard(dealt, sets)
    discard(again, buckets)
    return profile, edges


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, node (its set's fingerprint) and component_id."""
    profile, edges = links(docs, num, den, k, id_col, text_col)
    label = components(edges)
    named = profile.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("node", "component_id")
    out = profile.join(of, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_node(batches: Iterator[pa.RecordBatch], at: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = [_fingerprint(s) if len(s) else None for s in textkit.shingle_sets(batch.column(at), k)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, "_node"])


def deduplicated(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the least id (then set, then text). Documents without words all stay."""
    profile, edges = links(docs, num, den, k, id_col, text_col)
    own = profile.where("node is not null").select("doc_id", "node").distinct().join(components(edges), "node", "left")
    best = own.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"))
    keep = best.select(F.xxhash64("m.doc_id", "m.node").alias("_key"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())])
    marked = docs.mapInArrow(partial(_with_node, at=docs.columns.index(text_col), k=k), schema).withColumn("_key", F.xxhash64(id_col, "_node"))
    first = Window.partitionBy("_key").orderBy(text_col)
    one = marked.where("_node is not null").join(keep, "_key", "left_semi").withColumn("_at", F.row_number().over(first)).where("_at = 1")
    return one.select(docs.columns).unionByName(marked.where("_node is null").select(docs.columns))
