"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification in tiles.

Texts with the same set of word shingles are one class. A class has a label in each of TREES prefix tries: DEPTH minima of
independent hashes, two bytes each, so that labels sort as the trie's leaves stand. Candidates are classes below one node of a
trie. The descent begins at the full depth; after each depth the share of all links that it has found is estimated from the
similarities of the links themselves, each counted as many times as one of its kind is missed, and while that is below the
target the matched prefixes are shortened by a value. A shorter prefix brings together only what stands below different children
of its node and in no other tree before. Each node's classes are cut into blocks of bounded size, and each pair of blocks is a
tile: one task counts the links of its pairs by products of binary matrices of shared shingles. A tile returns a count for each
class and a spanning forest of its links, never the pairs, so a large group of near copies costs rows in proportion to its size.
"""

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ending, own_columns, slices, stored

TREES, DEPTH, RECALL = 10, 6, 0.999
BLOCK, COLUMNS = 768, 4096
CACHE_WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def found_at(similarity, k: int):  # noqa: ANN001, ANN201
    """The share of pairs of a similarity that stand below one node of depth k in at least one tree."""
    return 1 - (1 - similarity**k) ** TREES


def shortest_prefix(threshold: float, recall: float = RECALL) -> int:
    """The depth at which even pairs at the threshold reach the recall: no prefix needs to be shorter."""
    return next((k for k in range(DEPTH, 1, -1) if found_at(threshold, k) >= recall), 1)


class Shingler:
    """Sets of word shingles as sorted unique 64-bit hashes. Words are what white space separates, in lower case."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.hash, self.known = size, xxhash.xxh64_intdigest, {}

    def forget(self) -> None:
        self.known = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [(t or "").lower().split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, out = self.known, []
        for w in {w for ws in lists for w in ws}:
            if w not in known:
                known[w] = self.hash(w)
        get = known.__getitem__
        for ws in lists:
            x = np.fromiter(map(get, ws), np.uint64, len(ws))
            n = max(1, len(x) - self.size + 1) if len(x) else 0
            h = np.full(n, len(x) if len(x) < self.size else self.size, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(min(self.size, len(x))):
                    h = (h ^ x[j : j + n]) * MIX
                    h ^= h >> np.uint64(29)
            out.append(np.unique(h))
        return out


_shinglers: dict[int, Shingler] = {}


def shingler(size: int) -> Shingler:
    return _shinglers.setdefault(size, Shingler(size))


def forest_labels(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and tree the DEPTH values of its label; sets are not empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat, rng = np.concatenate(sets), np.random.default_rng(20240229)
    factors = rng.integers(1, 2**63, (TREES, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 2**63, (TREES, DEPTH), dtype=np.uint64)
    out = np.zeros((len(sets), TREES, DEPTH), ">u2")
    with np.errstate(over="ignore"):
        for t in range(TREES):
            for d in range(DEPTH):
                x = flat * factors[t, d] + adds[t, d]
                x ^= x >> np.uint64(31)
                out[:, t, d] = np.minimum.reduceat(x, starts) * MIX >> np.uint64(48)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, id, class_key (of the shingle set), n (its size), labels (one a tree, all in one binary; null if empty)."""

    def run(batches: Iterable) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, 64, 1 << 20):
                sets = shingler(size).sets(part.column(2).to_pylist())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                rows: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, label in zip(full, forest_labels([sets[i] for i in full]), strict=True):
                        rows[i] = label.tobytes()
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "id", "class_key", "n", "labels"])

    return docs.mapInArrow(lambda batches: ending(run(batches), shingler(size).forget), "doc_id long, id string, class_key binary, n long, labels binary")


def new_pairs(a: np.ndarray, b: np.ndarray, tree: int, k: int, same: bool) -> np.ndarray:
    """Of two blocks' classes (a label for each tree) below one node of depth k of this tree, the pairs that first meet here.

    They don't meet deeper down in any tree, nor at depth k in a tree before.
    """
    new = np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)
    for t in range(TREES):
        d = k if t < tree else k + 1
        if d <= DEPTH:
            x, y = (np.ascontiguousarray(v[:, t, :d]).view(f"V{2 * d}")[:, 0] for v in (a, b))
            _, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
            new &= codes[: len(a), None] != codes[None, len(a) :]
    return new


def jaccard(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact similarity of every set of a with every set of b, by binary matrices over the shingles that both sides hold."""
    if len(a) * len(b) <= 9:
        both = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], float)
        return both / (np.array([[len(x)] for x in a]) + np.array([len(y) for y in b])[None, :] - both)
    n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    rows_a, rows_b = np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)
    col_a, col_b = np.searchsorted(both, flat_a), np.searchsorted(both, flat_b)
    in_a, in_b = np.flatnonzero((col_a < len(both)) & (both[np.minimum(col_a, len(both) - 1)] == flat_a)) if len(both) else np.zeros(0, int), np.flatnonzero((col_b < len(both)) & (both[np.minimum(col_b, len(both) - 1)] == flat_b)) if len(both) else np.zeros(0, int)
    order_a, order_b = in_a[np.argsort(col_a[in_a], kind="stable")], in_b[np.argsort(col_b[in_b], kind="stable")]
    shared = np.zeros((len(a), len(b)))
    for at in range(0, len(both), COLUMNS):
        ia = order_a[np.searchsorted(col_a[order_a], at) : np.searchsorted(col_a[order_a], at + COLUMNS)]
        ib = order_b[np.searchsorted(col_b[order_b], at) : np.searchsorted(col_b[order_b], at + COLUMNS)]
        width = min(COLUMNS, len(both) - at)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        x[rows_a[ia], col_a[ia] - at] = 1
        y[rows_b[ib], col_b[ib] - at] = 1
        shared += x @ y.T
    return shared / (n_a[:, None] + n_b[None, :] - shared)


def tiles_of(batches: Iterable) -> Iterator:
    """(table, bounds) of whole tiles from Arrow batches that are sorted by tree, prefix, i and j; a tile may span batches."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        held = held.combine_chunks()
        keys = [held.column(c).to_numpy() for c in ("tree", "prefix", "i", "j")]
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(new)])
        if len(bounds) > 1:
            yield held.slice(0, bounds[-1]), bounds
            held = held.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def label_rows(table) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(b"".join(table.column("labels").to_pylist()), ">u2").reshape(-1, TREES, DEPTH)


def forest_edges(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest: each node with the smallest node that its links reach here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root)]


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component. Min-label rounds with pointer jumping, each written to shared storage."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "components-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "components")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = stored(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), (F.col("label") > F.least("to", F.coalesce("further", "to"))).alias("moved")), "components")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def row_id(key: str, text: str) -> Column:
    """Tells rows apart that differ in key or text; the hash of the text only has to tell those of one key apart."""
    return F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.hex(F.xxhash64(F.col(f"`{text}`"))))


TILE = ["tree", "prefix", "i", "j"]


def tiles(near: DataFrame, k: int) -> DataFrame:
    """The classes of each tile of depth k, without those that meet nobody new there: TILE, own block, rid, labels."""
    label = F.substring("labels", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * k))
    child = F.substring("labels", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * min(k + 1, DEPTH)))
    keyed = near.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("rid", "labels", "tree", label.alias("prefix"), child.alias("child"))
    nodes = keyed.groupBy("tree", "prefix").agg(F.count("*").alias("m"), F.min("child").alias("lo"), F.max("child").alias("hi"))
    nodes = nodes.where((F.col("m") > 1) & ((F.col("lo") != F.col("hi")) | F.lit(k == DEPTH))).select("tree", "prefix", "m")  # where the trie branches
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = keyed.join(nodes, ["tree", "prefix"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def wanted(batches: Iterable) -> Iterator:
        for table, bounds in tiles_of(batches):
            tree, i, j, own = (table.column(c).to_numpy() for c in ("tree", "i", "j", "own"))
            labels, keep = label_rows(table), []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = lo + np.flatnonzero(own[lo:hi] == i[lo]), lo + np.flatnonzero(own[lo:hi] == j[lo])
                if len(a) and len(b):
                    new = new_pairs(labels[a], labels[b], int(tree[lo]), k, i[lo] == j[lo])
                    keep += sorted({*a[new.any(1)].tolist(), *b[new.any(0)].tolist()})
            yield from table.take(np.array(keep, np.int64)).to_batches()

    dealt = members.select(*TILE, "own", "rid", "labels").repartition(*TILE).sortWithinPartitions(*TILE)
    return dealt.mapInArrow(wanted, "tree int, prefix binary, i int, j int, own int, rid long, labels binary")


def verified(ready: DataFrame, k: int, threshold: float) -> DataFrame:
    """rid, links, root, expected: a class's links in a tile, the smallest class they lead to there, and for each depth how many
    links of these similarities there are for those that are found."""

    def verify(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for table, bounds in tiles_of(batches):
            tree, i, j, own, rid = (table.column(c).to_numpy() for c in ("tree", "i", "j", "own", "rid"))
            labels, shingles, out = label_rows(table), table.column("shingles"), []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = lo + np.flatnonzero(own[lo:hi] == i[lo]), lo + np.flatnonzero(own[lo:hi] == j[lo])
                if not (len(a) and len(b)):
                    continue
                held = {int(x): np.frombuffer(shingles[int(x)].as_py(), np.uint64) for x in {*a.tolist(), *b.tolist()}}
                similar = jaccard([held[x] for x in a.tolist()], [held[x] for x in b.tolist()])
                links = new_pairs(labels[a], labels[b], int(tree[lo]), k, i[lo] == j[lo]) & (similar >= threshold - 1e-12)
                at = np.nonzero(links)
                if not len(at[0]):
                    continue
                weights = np.stack([1 / found_at(similar[at], d) for d in range(1, DEPTH + 1)], 1)
                ends = np.concatenate([rid[a][at[0]], rid[b][at[1]]])
                nodes, of = np.unique(ends, return_inverse=True)
                counts, expected = np.bincount(of), np.zeros((len(nodes), DEPTH))
                np.add.at(expected, of, np.concatenate([weights, weights]))
                roots = dict(forest_edges(zip(rid[a][at[0]].tolist(), rid[b][at[1]].tolist(), strict=True)))
                out += [(r, c, roots[r], e) for r, c, e in zip(nodes.tolist(), counts.tolist(), expected.tolist(), strict=True)]
            yield pa.record_batch([pa.array([o[x] for o in out], kind) for x, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["rid", "links", "root", "expected"])

    return ready.mapInArrow(verify, "rid long, links long, root long, expected array<double>")


def forest_links(rows: DataFrame, reps: DataFrame, threshold: float, size: int) -> DataFrame:
    """rid, links, root of all links between classes (reps: rid, id, labels), depth by depth until the recall is met."""
    floor = shortest_prefix(threshold)
    label = F.substring("labels", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * floor))
    keyed = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("rid", "id", "tree", label.alias("prefix"))
    shared = keyed.groupBy("tree", "prefix").agg(F.count("*").alias("m")).where(F.col("m") > 1).select("tree", "prefix")
    meet = keyed.join(shared, ["tree", "prefix"], "left_semi").select("rid").distinct()
    near = stored(reps.join(meet, "rid", "left_semi").select("rid", "id", "labels"), "forest")  # the others stand alone at every depth

    def shingled(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 64, 1 << 20):
                yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in shingler(size).sets(part.column(1).to_pylist())], pa.binary())], ["rid", "shingles"])

    texts = rows.select("id", "text").join(near.select("rid", "id"), "id").select("rid", "text")
    sets = stored(texts.mapInArrow(lambda batches: ending(shingled(batches), shingler(size).forget), "rid long, shingles binary").dropDuplicates(["rid"]), "shingles")
    done, k = [], DEPTH
    while True:
        needed = stored(tiles(near.select("rid", "labels"), k), "shingle-tiles")
        ready = needed.join(sets, "rid").select(*TILE, "own", "rid", "labels", "shingles").repartition(*TILE).sortWithinPartitions(*TILE)
        done.append(stored(verified(ready, k, threshold), "shingle-links"))
        linked = reduce(DataFrame.unionByName, done)
        sums = linked.agg(F.sum("links").alias("found"), F.sum(F.get("expected", F.lit(k - 1))).alias("all")).first()
        if k == floor or (sums["found"] and sums["found"] >= RECALL * sums["all"]):
            return linked.select("rid", "links", "root")
        k -= 1


def ngram_join(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, id, class_id, group_id, n_links, first.

    class_id is the smallest doc_id whose text has the same set of shingles; n_links counts the other classes whose similarity
    to it is at least the threshold; group_id is the smallest doc_id of all classes that links join, directly or not; first
    marks one row of each group, that of the smallest doc_id (nulls last). id tells rows of different doc_id or text apart.
    A text of fewer than size words is one shingle of all its words; texts without words, null ones too, are one class
    without links. Repeated rows are in one class. An empty table gives no rows. Extra columns are not read.
    """
    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), row_id("doc_id", "text").alias("id"), "text")
    signed = stored(signatures(rows, size).withColumn("rid", F.monotonically_increasing_id()), "shingle-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    classes = stored(signed.groupBy("class_key").agg(F.min(order).alias("o")).select("class_key", F.col("o.doc_id").alias("class_id"), F.col("o.rid").alias("node")), "shingle-classes")
    reps = signed.where(F.col("labels").isNotNull()).join(classes.select(F.col("node").alias("rid")), "rid").select("rid", "id", "labels")
    linked = forest_links(rows, reps, threshold, size)
    counts = linked.groupBy(F.col("rid").alias("node")).agg(F.sum("links").alias("n_links"))
    labels = components(linked.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "node", "left").join(labels, "node", "left").select("class_key", "class_id", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "node").alias("label"))
    groups = known.groupBy("label").agg(F.min(F.struct(F.col("class_id").isNull().alias("last"), "class_id", "node")).alias("g")).select("label", F.col("g.class_id").alias("group_id"), F.col("g.node").alias("first_rid"))
    known = stored(known.join(groups, "label").select("class_key", "class_id", "group_id", "n_links", "first_rid"), "shingle-groups")
    return signed.select("doc_id", "id", "class_key", "rid").join(known, "class_key").select("doc_id", "id", "class_id", "group_id", "n_links", (F.col("rid") == F.col("first_rid")).alias("first"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group; of rows that agree in id and text one stays."""
    name = reduce(lambda n, c: n + "_" if n.lower() == c.lower() else n, sorted(docs.columns, key=str.lower), "near_copy_id")
    kept = ngram_join(docs, threshold, size).where("first").select(F.col("id").alias(name))
    return docs.withColumn(name, row_id("doc_id", "text")).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
