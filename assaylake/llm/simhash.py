"""SimHash near-duplicate detection over a Gray-ordered hierarchical index.

Fingerprints that differ in at most three of 64 bits agree in at least one of four 16-bit blocks. Every
distinct fingerprint is therefore filed under its four block values (the top nodes of the index). Where so many are filed
that top nodes would grow long, the bits are cut into five or six blocks, of which two or three agree, and a fingerprint is filed under the
values of every two or three. Inside a
top node the fingerprints lie in the order of their Gray rank, which puts fingerprints with long shared bit
patterns side by side; runs of them form nodes, and nodes are cut into groups. A node keeps the mask of the
bits that all its members share and their values. A search adds up the differences on the shared bits from
the node down to the group and the member, and drops a whole subtree as soon as they exceed the radius.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm._common import bucketed, partitions, slices, stash, unused
from assaylake.llm.components import components, forest
from assaylake.operators.numbering import numbered

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
NODE_ROWS, GROUP_ROWS = 256, 16
#: Blocks beyond those that can differ: more of them make more and shorter top nodes.
MOST_SPARE = 3
#: Shingles that at least ORDER_LEAST of one in ORDER_SHARE documents have are common; COMMON_SHINGLES of them at most.
ORDER_SHARE, ORDER_LEAST, COMMON_SHINGLES = 8, 3, 50_000
#: Members of a class under one shingle that are listed together, about.
LIST_ROWS = 1024
#: Words of 64 bits in the sketch of a set.
SKETCH_WORDS = 8
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """The hashes of the shingles of k words, repeats included; fewer words are one shingle."""
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if k > 1 else words
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64, count=len(words) - k + 1)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the shingle hashes.

    A text with fewer words than a shingle counts as one shingle; a null text or one without a word gives 0.
    """
    return _majority(shingle_hashes(words_of(text), words_per_shingle))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(column: str) -> Column:
    """The place of a 64-bit word in the reflected Gray sequence, shifted so that signed order is rank order."""
    rank = F.col(column)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _expand(parents: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry of ``parents`` with each place of its run (start, count)."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    places = np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
    return np.repeat(parents, counts), places


def _shared(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that each run of ``values`` shares, and the values of those bits."""
    every, some = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
    mask = ~(every ^ some)
    return mask, every & mask


class GrayTree:
    """Nodes over fingerprints in Gray order: node, groups of the node, members."""

    def __init__(self, values: np.ndarray, node_starts: np.ndarray):
        self.values, self.starts = values, node_starts
        self.sizes = np.diff(np.append(node_starts, len(values)))
        self.mask, self.pattern = _shared(values, node_starts)
        per_node = -(-self.sizes // GROUP_ROWS)
        owner, nth = _expand(np.arange(len(node_starts)), np.zeros(len(node_starts), dtype=np.int64), per_node)
        self.group_starts = node_starts[owner] + nth * GROUP_ROWS
        self.group_sizes = np.minimum(GROUP_ROWS, self.sizes[owner] - nth * GROUP_ROWS)
        self.first_group, self.groups = np.cumsum(per_node) - per_node, per_node
        mask, self.group_pattern = _shared(values, self.group_starts)
        self.residual, self.rest = mask & ~self.mask[owner], ~mask

    def probe(self, queries: np.ndarray, nodes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``queries``, place in ``values``) within the radius; query i looks into ``nodes[i]`` alone."""
        far = np.bitwise_count((queries ^ self.pattern[nodes]) & self.mask[nodes]).astype(np.int16)
        q = np.flatnonzero(far <= radius)
        node, far = nodes[q], far[q]
        at, group = _expand(np.arange(len(q)), self.first_group[node], self.groups[node])
        q, far = q[at], far[at] + np.bitwise_count((queries[q[at]] ^ self.group_pattern[group]) & self.residual[group])
        near = far <= radius
        q, far, group = q[near], far[near], group[near]
        at, place = _expand(np.arange(len(q)), self.group_starts[group], self.group_sizes[group])
        far = far[at] + np.bitwise_count((queries[q[at]] ^ self.values[place]) & self.rest[group[at]])
        near = far <= radius
        return q[at][near], place[near]


_PIECE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("node", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("fps", pa.binary()), ("labels", pa.binary())])
_PIECE_DDL = "a long, b long, bucket long, node long, mask long, pattern long, fps binary, labels binary"


def _nearest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of pairs that connect what all pairs connect, the nearest first: those of a larger distance only link what
    those of smaller ones leave apart. A pair or two for each step of growth, never all of a dense group."""
    chosen: list[np.ndarray] = []
    label = np.arange(n)
    for level in np.unique(far):
        todo = np.flatnonzero(far == level)
        while True:
            todo = todo[label[a[todo]] != label[b[todo]]]
            if not len(todo):
                break
            la, lb = label[a[todo]], label[b[todo]]
            pick = np.union1d(np.unique(la, return_index=True)[1], np.unique(lb, return_index=True)[1])
            chosen.append(todo[pick])
            grown = forest(n, np.concatenate([label, la[pick]]), np.concatenate([np.arange(n), lb[pick]]))
            label = grown
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), field.type) for field in list(_PIECE)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], schema=_PIECE)


def _pairs(tree: GrayTree, queries: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Close pairs (place of the query, place in the tree) and their distances, for many queries in parts."""
    found = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(queries), 2048):
        q, place = tree.probe(queries[at : at + 2048], nodes[at : at + 2048], radius)
        found.append(np.stack([q + at, place, np.bitwise_count(queries[q + at] ^ tree.values[place]).astype(np.int64)]))
    return tuple(np.concatenate(found, axis=1))


class _Indexer:
    """Nodes of one range of (bucket, Gray rank): their inner links, and the nodes that do not hold a whole bucket.

    Without ``checked`` links are transitive and a star stands for a group; with it, links are pairs that still have to be
    checked, and the nearest pairs that connect a group stand for it.
    """

    def __init__(self, radius: int, checked: bool):
        self.radius, self.checked = radius, checked

    def work(self, bucket, fp, rep, left, final) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(starts, len(bucket)))
        whole = np.ones(len(starts), dtype=bool)
        whole[0] = left is None or bucket[0] != left
        if final:
            whole[-1] = False
        owner, nth = _expand(np.arange(len(starts)), np.zeros(len(starts), np.int64), -(-sizes // NODE_ROWS))
        node_starts = starts[owner] + nth * NODE_ROWS
        tree = GrayTree(fp, node_starts)
        q, place, far = _pairs(tree, fp, np.repeat(np.arange(len(node_starts)), tree.sizes), self.radius)
        keep = q < place
        q, place, far = q[keep], place[keep], far[keep]
        low = rep
        if self.checked:
            some = _nearest(len(fp), q, place, far)
            yield _links(rep[q[some]], rep[place[some]])
        else:
            label = forest(len(fp), q, place)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield _links(rep[linked], rep[label[linked]])
            low = rep[label]
        for k in np.flatnonzero(~(whole[owner] & (sizes[owner] <= NODE_ROWS))):
            at = slice(node_starts[k], node_starts[k] + tree.sizes[k])
            name = xxhash.xxh64_intdigest(fp[at].tobytes() + rep[at].tobytes(), int(bucket[at.start]) % (1 << 64)) >> 1
            row = {"bucket": int(bucket[at.start]), "node": name, "mask": int(tree.mask[k].view(np.int64)), "pattern": int(tree.pattern[k].view(np.int64)), "fps": fp[at].tobytes(), "labels": low[at].tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_PIECE)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        opened = None  # the bucket that lies open at the left edge of the carry: its earlier part went before, or may lie in another range
        first = True
        for batch in batches:
            new = (np.asarray(batch.column(0), dtype=np.int64), np.asarray(batch.column(1), dtype=np.int64).view(np.uint64), np.asarray(batch.column(2), dtype=np.int64))
            rows = tuple(np.concatenate(x) for x in zip(carry, new, strict=True))
            bucket = rows[0]
            if not len(bucket):
                continue
            if first:
                opened, first = int(bucket[0]), False
            last = int(np.searchsorted(bucket, bucket[-1]))  # where the last, perhaps unfinished bucket starts
            cut = last if last else (len(bucket) // NODE_ROWS) * NODE_ROWS if len(bucket) > 16 * NODE_ROWS else 0
            if cut:
                yield from self.work(*(x[:cut] for x in rows), opened, final=not last)
                opened = None if last else int(bucket[0])
            carry = tuple(x[cut:] for x in rows)
        if len(carry[0]):
            yield from self.work(*carry, opened, final=True)


class _Crosser:
    """Links between two nodes of a bucket."""

    def __init__(self, radius: int, checked: bool):
        self.radius, self.checked = radius, checked

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fa, fb = (np.frombuffer(row[k], dtype=np.uint64) for k in ("fps_a", "fps_b"))
                la, lb = (np.frombuffer(row[k], dtype=np.int64) for k in ("labels_a", "labels_b"))
                q, place, far = _pairs(GrayTree(fb, np.zeros(1, np.int64)), fa, np.zeros(len(fa), np.int64), self.radius)
                names, at = np.unique(np.concatenate([la[q], lb[place]]), return_inverse=True)
                left, right = at[: len(q)], at[len(q) :]
                if self.checked:
                    some = _nearest(len(names), left, right, far)
                    a, b = names[left[some]], names[right[some]]
                else:  # of the links between the same two labels one is kept
                    label = forest(len(names), left, right)
                    linked = np.flatnonzero(label != np.arange(len(names)))
                    a, b = names[linked], names[label[linked]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """How many blocks 64 bits are cut into for n fingerprints: so many that a top node holds a node's rows, about."""
    return next((b for b in range(radius + 1, radius + MOST_SPARE) if n <= NODE_ROWS << 64 * (b - radius) // b), radius + MOST_SPARE)


def _top_nodes(blocks: int, radius: int) -> list[int]:
    """The masks under which a fingerprint is filed: those of every choice of so many blocks as must agree."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << stop) - (1 << start)) for start, stop in zip(cuts, cuts[1:], strict=False)]
    return [sum(part[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def links(distinct: DataFrame, radius: int = RADIUS, checked: bool = False, blocks: int | None = None) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the fingerprints which links of at most ``radius`` bits connect.

    :param distinct: ``fp``, ``rep``: fingerprints and the node that stands for each.
    :param checked: the edges are to be checked by other means; each is then a close pair itself.
    :param blocks: into how many the bits are cut, more than the radius; by the number of fingerprints, unless told.

    Within a node, and between two nodes, a spanning forest stands for the links, so a dense group of n
    fingerprints gives less than n edges per node and never its pairs (with ``checked`` some more).
    """
    if blocks is None:
        blocks = blocks_for(distinct.count(), radius)
    if not 0 <= radius < blocks <= 64:
        raise ValueError(f"a radius of {radius} bits needs more than {blocks} blocks")
    signed = [mask - (mask >> 63 << 64) for mask in _top_nodes(blocks, radius)]
    top = F.explode(F.array(*(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(i)) for i, mask in enumerate(signed)))).alias("bucket")
    rows = distinct.select("fp", "rep", gray_rank("fp").alias("rank"), top)
    pieces = stash(rows.repartitionByRange("bucket", "rank").sortWithinPartitions("bucket", "rank").select("bucket", "fp", "rep").mapInArrow(_Indexer(radius, checked), _PIECE_DDL))
    nodes = pieces.where("bucket is not null")
    parts_of = ("node", "mask", "pattern", "fps", "labels")
    a = nodes.select("bucket", *(F.col(c).alias(f"{c}_a") for c in parts_of))
    b = nodes.select("bucket", *(F.col(c).alias(f"{c}_b") for c in parts_of))
    near = F.bit_count(F.col("pattern_a").bitwiseXOR(F.col("pattern_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b"))) <= radius
    sides = ("fps_a", "labels_a", "fps_b", "labels_b")
    pairs = a.join(b, "bucket").where((F.col("node_a") < F.col("node_b")) & near).select(*sides, F.xxhash64("node_a", "node_b").alias("deal"))
    cross = pairs.repartition(partitions(distinct.sparkSession), "deal").select(*sides).mapInArrow(_Crosser(radius, checked), "a long, b long")
    return pieces.where("a is not null").select("a", "b").union(cross)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The near-duplicate class of every document.

    :return: ``doc_id``, ``fp`` (long), ``component_id``: the smallest id that a chain of links reaches.

    Rows: one per input row; repeated rows share their class; rows with the same id count as one document.
    Null and empty texts have fingerprint 0, linked like any other. A row with a null id keeps its
    fingerprint, links nothing and has a null component. An empty table gives an empty result.
    """
    prints = stash(fingerprints(docs, id_col, text_col))
    distinct = stash(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    label = components(links(distinct))
    named = distinct.join(label, distinct["rep"] == label["node"], "left").select(F.col("fp").alias("key"), F.coalesce("label", "rep").alias("label"))
    out = prints.join(named, prints["fp"] == named["key"], "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id"))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes fall on each of some bits: two sets differ in at least as many members as their
    sketches in bits."""
    odd = np.bincount(hashes & np.uint32(64 * SKETCH_WORDS - 1), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _prints_of_words(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``doc_id``, ``fp``, ``digest``, ``hashes``, ``s0`` and so on: the SimHash of the distinct words, a hash of the words in
    order, the distinct hashes of the shingles of k words, sorted, as bytes, and their sketch."""
    names = [f"s{i}" for i in range(SKETCH_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, sets, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found.append((_majority(shingle_hashes(list(set(words)), 1)), xxhash.xxh64_intdigest(b" ".join(words))))
                distinct = np.unique(shingle_hashes(words, k) >> np.uint64(32)).astype("<u4")
                sets.append(distinct.tobytes())
                sketches.append(sketch(distinct))
            columns = [batch.column(0), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in zip(*found, strict=True)), pa.array(sets, pa.binary()), *(pa.array(np.ascontiguousarray(x)) for x in np.array(sketches).view(np.int64).T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "digest", "hashes", *names])

    ddl = "doc_id long, fp long, digest long, hashes binary, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def _held(edges: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The edges ``a``, ``b`` whose whole shingle sets are similar enough."""
    left = prints.select(F.col("doc_id").alias("a"), F.col("hashes").alias("hashes_a"))
    right = prints.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hashes_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return edges.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(check, "a long, b long")


def _common_shingles(nodes: DataFrame) -> np.ndarray:
    """Shingles of many documents, the rarest first. Found in a share of the documents: they only settle an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4"))], names=["shingle"])

    some = nodes.where(F.pmod(F.xxhash64("rep"), F.lit(ORDER_SHARE)) == 0).select("hashes")
    counted = some.mapInArrow(run, "shingle int").groupBy("shingle").count().where(F.col("count") >= ORDER_LEAST)
    top = counted.orderBy(F.desc("count"), "shingle").limit(COMMON_SHINGLES).collect()
    return np.array([r["shingle"] for r in reversed(top)], dtype=np.int32).view(np.uint32)


def prefix_length(n: int, similarity: float) -> int:
    """How many shingles of n, the first in an order that all sets share, meet those of any set that is similar enough."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _lists(nodes: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """Documents of different classes that share one of the rarest shingles of both, in lists ``members`` by ``shingle`` and
    ``class``; ``n`` and ``most`` tell a list's length and the most shingles that one of its members has left.

    Sets of sizes m <= n with this Jaccard similarity share at least a shingle among the first of each in one order, and m is at
    least the similarity times n. The order has common shingles last. Shingles inside one class are left out, and members
    that have too few shingles left, from this one on, to be similar to the smallest set under it.
    """
    common = nodes.sparkSession.sparkContext.broadcast(_common_shingles(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        by_value = np.argsort(late)
        ordered = late[by_value]
        for batch in slices(batches):
            shingles, reps, sizes, lefts = [np.zeros(0, dtype=np.uint32)], [], [], []
            for rep, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(data, dtype="<u4")
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                    is_late = ordered[at] == h
                    first = np.concatenate([h[~is_late], late[np.sort(by_value[at[is_late]])]])
                else:
                    first = h
                first = first[: prefix_length(len(h), similarity)]
                shingles.append(first)
                reps.append(np.full(len(first), rep, dtype=np.int64))
                sizes.append(np.full(len(first), len(h), dtype=np.int32))
                lefts.append(len(h) - np.arange(len(first), dtype=np.int32))
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int32)), *(pa.array(np.concatenate(x)) for x in (reps, sizes, lefts))], names=["shingle", "rep", "size", "left"])

    same = Window.partitionBy("shingle")
    posts = nodes.select("rep", "hashes").mapInArrow(run, "shingle int, rep long, size int, left int")
    shared = posts.withColumns({"low": F.min("rep").over(same), "high": F.max("rep").over(same)}).where("low < high").select("shingle", "rep", "size", "left")
    classed = shared.join(label, F.col("rep") == F.col("node"), "left").select("shingle", "rep", "size", "left", F.coalesce("label", "rep").alias("class"))
    apart = classed.withColumns({"low": F.min("class").over(same), "high": F.max("class").over(same), "n": F.count("*").over(same), "least": F.min("size").over(same)}).where("low < high")
    apart = apart.where(F.col("left") >= _in_common(similarity, F.col("size") + F.greatest("least", similarity * F.col("size"))))
    words = [f"s{i}" for i in range(SKETCH_WORDS)]
    sketched = apart.join(nodes.select("rep", *words), "rep")
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / LIST_ROWS)).alias("part")  # so that no list is long
    lists = sketched.groupBy("shingle", "class", part).agg(F.collect_list(F.struct("rep", "size", "left", *words)).alias("members"), F.max("left").alias("most"))
    return stash(lists.withColumn("n", F.size("members")))


def _in_common(similarity: float, sizes: Column) -> Column:
    """The least that two sets of this total size have in common if they are similar, less what rounding may take."""
    return similarity / (1 + similarity) * sizes - 1e-6


def _differ(x: Column, y: Column) -> Column:
    """The bits in which two sketches differ."""
    bits = [F.bit_count(x[f"s{i}"].bitwiseXOR(y[f"s{i}"])) for i in range(SKETCH_WORDS)]
    return sum(bits[1:], bits[0])


def _can(x: Column, y: Column, similarity: float) -> Column:
    """Whether two members of lists can be similar: by their sizes, by what either has left from the first shingle that they
    share, and by the least number of members in which their sets differ. Never false for a similar pair, as it holds at the first one."""
    total = x["size"] + y["size"]
    fits = F.least(x["size"], y["size"]) >= similarity * F.greatest(x["size"], y["size"]) - 1e-9
    return fits & (F.least(x["left"], y["left"]) >= _in_common(similarity, total)) & (_differ(x, y) <= total - 2 * _in_common(similarity, total))


def _sides(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    one, two = (lists.select("shingle", F.col("class").alias(f"class_{s}"), F.col("members").alias(f"members_{s}")) for s in "ab")
    return one, two


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).where("a <> b").distinct()


def _stars(lists: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs that can be similar, for each member of a list and each shingle the closest in the class that has the member with most
    left: a dense group becomes one class by these, without its pairs."""
    hub = lists.groupBy("shingle").agg(F.max_by("class", F.struct("most", "n", "class")).alias("hub"))
    one, two = _sides(lists)
    met = one.join(hub, "shingle").where("class_a <> hub").join(two.withColumnRenamed("shingle", "under"), (F.col("shingle") == F.col("under")) & (F.col("hub") == F.col("class_b")))
    each = met.select(F.explode("members_a").alias("x"), "members_b")
    able = F.filter("members_b", lambda y: _can(F.col("x"), y, similarity))
    closest = F.array_min(F.transform(able, lambda y: F.struct(_differ(F.col("x"), y).alias("far"), y["rep"].alias("rep"))))
    return _ordered(each.select("x", closest.alias("y")).where("y is not null"))


def _rest(lists: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """All pairs of members that can be similar and are in different classes still."""
    now = lists.join(label, F.col("class") == F.col("node"), "left").withColumn("class", F.coalesce("label", "class")).drop("node", "label")
    one, two = _sides(now)
    met = one.join(two, "shingle").where("class_a < class_b").select(F.explode("members_a").alias("x"), "members_b")
    return _ordered(met.select("x", F.explode(F.filter("members_b", lambda y: _can(F.col("x"), y, similarity))).alias("y")))


def _edges(label: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("a"), F.col("label").alias("b"))


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Classes of documents whose shingles of ``words`` words have a Jaccard similarity of at least ``similarity``: two
    documents are in one class exactly if a chain of similar pairs connects them.

    First, pairs that differ in at most ``radius`` bits of a SimHash of their distinct words, of a dense group the nearest
    ones that connect it, are compared by their whole shingle sets; they make most classes, without the pairs inside them.
    Then documents that share one of the rarest shingles of both are looked at: each with the closest of one class, and
    last every pair of different classes that can have the similarity, by the bounds of ``_can``.

    :return: ``doc_id``, ``component_id``: one row per document with an id that is not null.

    Equal words in order are equal documents, whatever the white space and the case of A-Z. Texts without a word are
    equal. Rows with the same id count as one document. Shingles are compared by 32 bits of their hashes.
    """
    parts = partitions(docs.sparkSession)
    prints = bucketed(_prints_of_words(docs, id_col, text_col, words).where("doc_id is not null").repartition(parts, "doc_id"), "doc_id", parts)  # so joins do not move the shingles
    nodes = stash(prints.groupBy("digest", "fp").agg(F.min("doc_id").alias("rep")))
    sets = prints.join(nodes.select("rep").distinct().hint("merge"), F.col("doc_id") == F.col("rep"), "left_semi").drop("digest", "fp").withColumnRenamed("doc_id", "rep")
    edges = stash(links(nodes.select("fp", "rep"), radius, checked=True).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = components(_held(edges, prints, similarity))
    lists = _lists(sets, near, similarity)
    near = components(_edges(near).union(_held(stash(_stars(lists, similarity)), prints, similarity)))
    label = components(_edges(near).union(_held(stash(_rest(lists, near, similarity)), prints, similarity)))
    named = nodes.join(label, nodes["rep"] == label["node"], "left").select(F.col("digest").alias("key"), F.col("fp").alias("key0"), F.coalesce("label", "rep").alias("component_id"))
    return prints.join(named, (prints["digest"] == named["key"]) & (prints["fp"] == named["key0"])).select("doc_id", "component_id")


def _own_ids(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with ids ``name`` of which each stands for one text: where the rows of an id have several, the first by its hash keeps the
    id, and the others have ids beyond the largest. Rows with a null id have none."""
    own, digest = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(own.alias("id"), digest.alias("digest")).where("id is not null")
    several = stash(texts.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id"))
    if several.isEmpty():  # as ids are meant to be
        return docs.withColumn(name, own)
    named = stash(texts.join(several, "id", "left_semi").distinct())
    largest = docs.agg(F.max(own)).first()[0]
    later = numbered(numbered(named, ["id"], ["digest"], "turn").where("turn > 1"), [], ["id", "digest"], "number")
    given = later.select(F.col("id").alias(f"{name}_id"), F.col("digest").alias(f"{name}_digest"), (F.lit(largest) + F.col("number")).alias(name))
    return docs.join(given, (own == F.col(f"{name}_id")) & (digest == F.col(f"{name}_digest")), "left").select(*(docs[c] for c in docs.columns), F.coalesce(F.col(name), own).alias(name))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One row of each near-duplicate class, with the columns of ``docs``: a row with the smallest id. Rows with a null
    id stay. Rows of one id with different texts are documents of their own; the one whose text hashes least counts as the first.

    :param similarity: classes by the similarity of five-word shingles; without it, by fingerprints alone.
    """
    own, kept_id = f"{unused(docs, 'own_')}id", f"{unused(docs, 'kept_')}id"
    named = _own_ids(docs, id_col, text_col, own)
    found = near_duplicates(named, own, text_col) if similarity is None else similar_documents(named, similarity, id_col=own, text_col=text_col)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    kept = named.join(keep, named[own] == keep[kept_id]).dropDuplicates([kept_id])
    return kept.select(*(named[c] for c in docs.columns)).union(docs.where(F.col(id_col).isNull()))
