"""A similarity self-join of texts by the Jaccard coefficient of their word n-grams, through a MinHash LSH forest.

A text's signature is cut into trees of DEPTH minima each, and each tree is a prefix trie: its labels in order, so that
the texts that share most of a label stand next to each other. A leaf is a whole label; texts that share one in some tree, and
what they lead to, are groups, and in these all pairs are verified exactly. Then the prefixes that count as a match are
shortened, for each text as far as its own size demands: two texts of similarity s agree on p minima of some tree with
probability 1 - (1 - s^p)^trees, and the least s that a text's number of n-grams allows at the join's threshold tells the
depth at which that reaches the target recall. What a shorter prefix adds, pairs below one node that are in different
groups, is verified below that node, once for each pair. Groups and nodes are compared in cells of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.cells import cells_of, in_cells, roots, with_group_rows
from codeweft.llm.common import dealt, map_texts, partitions, ship_package, text_key, text_or_empty, written
from codeweft.llm.components import connected_components
from codeweft.llm.links import PARTIAL, linked_classes

#: A label has eight minima of 16 bits, four in each of two numbers.
TREES, DEPTH, RECALL = 20, 8, 0.999
BLOCK_ROWS = 1000
CACHE_WORDS = 200_000
#: Numbers of a signature's matrix computed at once.
AT_ONCE = 1 << 18
COLUMNS = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of all runs of n words; of all words if there are fewer, of none if there are none."""
    words = text.encode("utf-8", "replace").split()  # bytes split at ASCII white space alone
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(max(len(h) - n + 1, 0) if n else 0, n, np.uint64)
    for i in range(n):
        out = out * MIX + h[i : i + len(out)]
    return np.unique(mixed(out))


def match_depth(trees: int, depth: int, similarity: float, recall: float) -> int:
    """Shortens the prefix from ``depth`` until a pair of that similarity is found with probability ``recall``."""
    p = depth
    while p > 1 and 1 - (1 - similarity**p) ** trees < recall:
        p -= 1
    return p


@cache
def least_similarity(size: int, threshold: Fraction) -> Fraction:
    """The least Jaccard coefficient from ``threshold`` on that a set of ``size`` can have with any other set."""
    if size > 100:
        return threshold  # near enough, and on the safe side
    least = Fraction(1)
    for other in range(math.ceil(threshold * size), math.floor(size / threshold) + 1):
        common = math.ceil(threshold * (size + other) / (1 + threshold))
        if common <= min(size, other):
            least = min(least, Fraction(common, size + other - common))
    return least


@cache
def depths(size: int, threshold: Fraction, trees: int, recall: float) -> tuple[int, ...]:
    """The depths at which a text of ``size`` n-grams meets others, its own the first: two texts meet at the deeper of theirs."""
    own = lambda n: match_depth(trees, DEPTH, float(least_similarity(n, threshold)), recall)
    if size > 200:
        return (own(size),)
    others = range(max(1, math.ceil(threshold * size)), math.floor(size / threshold) + 1)
    return (own(size), *sorted({own(n) for n in others if own(n) > own(size)}))


class Signatures:
    def __init__(self, trees: int) -> None:
        rng = np.random.default_rng(42)
        self.trees = trees
        self.factor = rng.integers(0, 1 << 31, trees * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, trees * DEPTH, dtype=np.uint32)

    def labels(self, grams: np.ndarray) -> np.ndarray:
        """Two numbers for each tree: the low bits of its minima, in the order in which its trie branches."""
        out = np.full(len(self.factor), np.iinfo(np.uint32).max, np.uint32)
        low, step = grams.astype(np.uint32), max(1, AT_ONCE // len(out))
        for at in range(0, len(low), step):
            out = np.minimum(out, (self.factor[:, None] * low[at : at + step] + self.add[:, None]).min(1))
        parts = (out & np.uint32(0xFFFF)).astype(np.uint64).reshape(2 * self.trees, 4)
        return ((parts[:, 0] << np.uint64(48)) | (parts[:, 1] << np.uint64(32)) | (parts[:, 2] << np.uint64(16)) | parts[:, 3]).view(np.int64)


def prefix(label: np.ndarray, depth: int) -> np.ndarray:
    """Labels, as rows of two unsigned numbers, cut to ``depth`` minima."""
    keep = (((1 << 128) - 1) >> (16 * (DEPTH - depth))) << (16 * (DEPTH - depth))
    return label & np.array([keep >> 64, keep & ((1 << 64) - 1)], np.uint64)


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima the labels in rows of ``a`` and ``b`` share from the start."""
    differ = a ^ b
    first = sum((differ[:, 0] >> np.uint64(s) == 0).astype(int) for s in (48, 32, 16, 0))
    return first + np.where(first == 4, sum((differ[:, 1] >> np.uint64(s) == 0).astype(int) for s in (48, 32, 16, 0)), 0)


def shared_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels in order -> (depth, node, k1, k2): the leaf of each text that shares it, and of the depths at which the text meets
    others, the nodes that it shares. A node's texts stand next to each other, so that a text shares one if its label has it in
    common with the one before or after; at either end of a partition that isn't known, and the node is taken as shared."""
    held: pa.RecordBatch | None = None
    before = DEPTH

    def nodes(t: pa.RecordBatch, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree, hi, lo, k1, k2 = (t.column(c).to_numpy() for c in ("tree", "hi", "lo", "k1", "k2"))
        label = np.stack([hi.view(np.uint64), lo.view(np.uint64)], 1)
        meets = t.column("depths").to_numpy()
        for p in range(1, DEPTH + 1):
            at = np.flatnonzero((shared >= p) & ((meets >> p & 1 == 1) | (p == DEPTH)))
            if len(at):
                cut = prefix(label[at], p)
                node = mixed(mixed(cut[:, 0] + tree[at].astype(np.uint64) * MIX) * MIX + cut[:, 1] + np.uint64(p))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(tree[at]), pa.array(node.view(np.int64)), pa.array(k1[at]), pa.array(k2[at])], names=["depth", "tree", "node", "k1", "k2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches(batch.num_rows + 1)[0]
        tree = t.column("tree").to_numpy()
        label = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], 1)
        lcp = np.where(tree[1:] == tree[:-1], shared_depth(label[1:], label[:-1]), 0)
        if len(lcp):
            yield from nodes(t.slice(0, len(lcp)), np.maximum(np.r_[before, lcp[:-1]], lcp))
            before = int(lcp[-1])
        held = t.slice(len(lcp))
    if held is not None:
        yield from nodes(held, np.array([DEPTH]))


def similar(sets: list[np.ndarray], side: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets, of one side with the other if there are two, whose Jaccard coefficient is ``threshold`` at least."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = (count[gram] > 1) & (count[gram] < n)  # what one set has alone is shared with none; what all have, with all
    row, gram = row[some], np.unique(gram[some], return_inverse=True)[1]
    common = np.full((n, n), float((count == n).sum()) if n > 1 else 0.0)
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, COLUMNS):
        a, b = np.searchsorted(gram, [at, at + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[row[a:b], gram[a:b] - at] = 1
        common += held @ held.T
    i, j = np.nonzero(np.triu(np.ones((n, n), bool), 1) & (common > 0) & ((side[:, None] != side) | (side[:, None] < 0)))
    both = common[i, j].astype(np.int64)
    keep = both * threshold.denominator >= threshold.numerator * (sizes[i] + sizes[j] - both)
    return i[keep], j[keep]


def first_shared_tree(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """For texts in rows, each with the labels of all trees: the first tree in which both are below one node of ``depth``."""
    trees = a.shape[1] // 2
    same = (prefix(a.reshape(len(a), trees, 2), depth) == prefix(b.reshape(len(b), trees, 2), depth)).all(2)
    return np.where(same.any(1), same.argmax(1), -1)


def similar_classes(documents: DataFrame, n: int = 5, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id", trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(k1, k2, n_links, component_id, stands) for each distinct text, named by text_key(); see similarity_join()."""
    spark = documents.sparkSession
    ship_package(spark)
    exact = Fraction(str(threshold))

    def sign() -> Callable[[list[str]], list[pa.Array]]:
        signatures, hashes = Signatures(trees), WordHashes()

        def compute(texts: list[str]) -> list[pa.Array]:
            sets = [shingles(t, n, hashes) for t in texts]
            meets = [depths(len(s), exact, trees, recall) if len(s) else () for s in sets]
            return [
                pa.array([d[0] if d else 0 for d in meets], pa.int32()),
                pa.array([sum(1 << p for p in d) for d in meets], pa.int32()),
                pa.array([signatures.labels(s).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]

        return compute

    k1, k2 = text_key(text)
    signed = map_texts(documents, text, (F.col(doc_id).alias("id"), k1, k2), sign, "own int, depths int, labels array<long>")
    classes = written(signed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("own").alias("own"), F.first("depths").alias("depths"), F.first("labels").alias("labels")))

    tries = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.get("labels", 2 * t).alias("hi"), F.get("labels", 2 * t + 1).alias("lo")))
    labels = classes.where("size(labels) > 0").select(F.inline(tries), "depths", "k1", "k2")
    order = ("tree", "hi", "lo", "k1", "k2")  # equal labels, too, may be many: they are split by text
    at = written(labels.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(shared_nodes, "depth int, tree int, node long, k1 long, k2 long"))

    leaves = at.where(F.col("depth") == DEPTH).select("node", F.struct("k1", "k2").alias("k"))
    shared = leaves.groupBy("node").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("node", "first")
    groups = connected_components(leaves.join(dealt(shared), "node").select(F.col("k").alias("a"), F.col("first").alias("b")))
    groups = written(groups.select("id.k1", "id.k2", F.col("component.k1").alias("g1"), F.col("component.k2").alias("g2")))

    below = at.where(F.col("depth") < DEPTH).join(dealt(groups), ["k1", "k2"], "left")
    below = below.withColumns({"g1": F.coalesce("g1", "k1"), "g2": F.coalesce("g2", "k2")})
    both = F.struct("g1", "g2")
    mixed_nodes = below.groupBy("node").agg(F.min(both).alias("first"), F.max(both).alias("last")).where("first < last").select("node")
    below = below.join(dealt(mixed_nodes), "node").select("k1", "k2", "g1", "g2", "depth", "tree", "node")
    whole = groups.select("k1", "k2", "g1", "g2", F.lit(DEPTH).alias("depth"), F.lit(-1).alias("tree"), F.xxhash64("g1", "g2").alias("node"))
    routes = with_group_rows(whole.union(below), ["depth", "tree", "node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for cell in cells_of(batches):
            a, b = similar([shingles(t, n, hashes) for t in cell.column("text").to_pylist()], cell.column("side").to_numpy(), exact)
            depth, tree = cell.column("depth")[0].as_py(), cell.column("tree")[0].as_py()
            k1, k2, copies, own, g1, g2 = (cell.column(c).to_numpy() for c in ("k1", "k2", "n", "own", "g1", "g2"))
            if tree >= 0 and len(a):
                label = np.asarray(cell.column("labels").combine_chunks().flatten()).reshape(len(k1), -1).view(np.uint64)
                ok = ((g1[a] != g1[b]) | (g2[a] != g2[b])) & (np.maximum(own[a], own[b]) == depth)
                a, b = a[ok], b[ok]
                ok = first_shared_tree(label[a], label[b], depth) == tree
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            links = np.zeros(len(k1), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root, some = roots(len(k1), a, b), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[some], k2[some], links[some], k1[root[some]], k2[root[some]])], names=["k1", "k2", "links", "r1", "r2"])

    texts = documents.select(*text_key(text), text_or_empty(text).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    wanted = routes.join(classes.select("k1", "k2", "own", "labels"), ["k1", "k2"])
    cells = in_cells(texts.join(dealt(wanted), ["k1", "k2"]), ["depth", "tree", "node"], F.col("k1"), BLOCK_ROWS)
    # the labels of a whole group aren't looked at
    cells = cells.select("c1", "c2", "side", "k1", "k2", "n", "g1", "g2", "depth", "tree", "own", F.when(F.col("tree") >= 0, F.col("labels")).alias("labels"), "text")
    partial = written(cells.mapInArrow(verify, PARTIAL))
    return linked_classes(classes.select("k1", "k2", "id", "n"), partial)


def similarity_join(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", **how: float) -> DataFrame:
    """The columns ``keep`` of each row, its n_links, its component_id and kept.

    Two rows link if the Jaccard coefficient of their texts' word n-grams is the threshold at least. Words are runs of
    anything but ASCII white space; a text of fewer than n words is one n-gram, and a text without words (null, empty or white
    space alone) links only with texts equal to it, null counting as empty. n_links counts rows, copies included;
    component_id is the smallest id reachable by links, null if all are null; kept is id = component_id, null equalling
    null, so that rows that repeat an id go together. Every pair that shares a node of the forest is verified exactly;
    a pair at the threshold shares one with probability ``recall``, a more similar pair with a higher one. Other columns
    don't matter; an empty table gives an empty result.
    """
    found = similar_classes(documents, text=text, doc_id=doc_id, **how)
    found = dealt(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "n_links", "component_id"))
    rows = documents.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), F.col(doc_id).alias("_id"), *[k.alias(n) for n, k in zip(("_k1", "_k2"), text_key(text), strict=True)])
    kept = F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.join(found, ["_k1", "_k2"]).select(*(F.col(f"_{i}").alias(k) for i, k in enumerate(keep)), "n_links", "component_id", kept)


def one_of_each(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **how: float) -> DataFrame:
    """One row of each component of similarity_join(), with all its columns, whatever their names: the one with the least id, null
    after all others.

    Of several the one with the least text key is taken, then the one with the least hash of all columns; of rows that equal each
    other, any. Maps are left out of the hash. Each task first picks one of its rows of a text, so that no text is hot.
    """
    found = similar_classes(documents, text=text, doc_id=doc_id, **how).where("stands").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    names = documents.columns
    rows = documents.select(*(documents[c].alias(f"_{i}") for i, c in enumerate(names)))
    own = {c: f"_{i}" for i, c in enumerate(names)}
    hashed = [F.col(own[f.name]) for f in documents.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(own[doc_id]).isNull().alias("none"), F.col(own[doc_id]).alias("id"), F.xxhash64(*hashed).alias("h1"), F.xxhash64(F.lit(7), *hashed).alias("h2"))
    keyed = rows.withColumns(dict(zip(("_k1", "_k2"), text_key(own[text]), strict=True)))
    first = keyed.groupBy("_k1", "_k2").agg(F.min_by(F.struct(*own.values()), order).alias("_row"))
    return first.join(found, ["_k1", "_k2"]).select(*(F.col(f"_row.{o}").alias(c) for c, o in own.items()))
