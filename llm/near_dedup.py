"""Near-duplicate groups by a chosen-path set similarity join.

Every distinct shingle set gets a vector of minwise tokens.  Independent random
trees branch the sets: a node picks two positions of the vector and sends a set
to one child for each, named by the token there.  Of a pair of similarity s, survival
q of the branching to any depth solves q = 1 - (1 - s * q)^2: 0.937 at s = 0.8, and more
over it.  ``TREES`` trees so miss such a pair with a chance under (1 - 0.937)^4 < 2e-5.

Nodes of at most ``LEAF`` sets are compared exhaustively on one-byte sketches of all
positions, and what may be similar enough is confirmed on the full sets.  Larger nodes
branch on, but two kinds end early, with every pair that matters still compared:

* a crowd, nearly all of one component that is already known: its outsiders are compared
  with all of it, in blocks (``_crowd_blocks``); a node of one component has no pair to tell;
* a node of up to ``WHOLE`` sets that ``FEW`` levels have not made small, as its sets are
  alike, or one that is larger after ``LEVELS``: it is cut in blocks and each two blocks
  are a task of their own (``_block_pairs``).

Components known from the start come from a backbone: sets in order of a short run of
tokens, each linked with the one before it if the full sets say so.  That order is a range
partitioning, so a run that a third of all sets share spreads over many tasks.

Equal sets are one class from the start, so a hundred thousand copies cost one row.
A leaf gives at most ``DENSE`` candidate pairs a set.  One with more is compared again on
the full sets themselves, which are brought to it, and gives only pairs that join two of
its components, fewer than it has sets; so no step has rows for all pairs of a crowd.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, table

POSITIONS = 128
TREES = 4
LEAF = 400
WHOLE = 4000
BLOCK = 1000
FEW, LEVELS = 3, 8
#: Runs of tokens that the backbone goes by, and their length.
RUNS, RUN = 6, 3
#: Candidate pairs a set beyond which a leaf is dense; shingles of a task that holds full sets, 8 bytes each.
DENSE = 4
SHINGLES = 4_000_000
#: Links that one task joins by itself, 32 bytes each; more are joined by rounds of tables, with the same roots.
SMALL_LINKS = 500_000
#: Four standard deviations below 0.8 for 128 positions: one pair in 30,000 at 0.8 is estimated lower.
SKETCH_MARGIN = 0.142

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D | 1
_rng = np.random.RandomState(20240501)
_BYTE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_XOR = _rng.randint(0, 2**31 - 1, POSITIONS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = _rng.randint(0, 2**31 - 1, POSITIONS, dtype=np.int64).astype(np.uint32) | np.uint32(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a UTF-8 text.

    A-Z are lower-cased; fewer words than ``width`` make one shingle of all, no
    word makes the empty set.
    """
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.lower(), np.uint8)
    up, down = _power_tables(len(data) + 1)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    words = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_MIX[0]))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(_BASE) + words[k : len(words) - width + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of each position, as 32-bit numbers."""
    short = (shingles >> np.uint64(16)).astype(np.uint32)
    best = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 2048):
        part = (short[k : k + 2048, None] ^ _XOR) * _ODD
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def _sign(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size, cls, sig, sketch = [], [], [], []
            for text in texts:
                s = shingle_set(text, width)
                size.append(len(s))
                if len(s):
                    m = minwise(s)
                    cls.append(hashlib.md5(s.tobytes()).digest())
                    sig.append(m.view(np.int32))
                    sketch.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    cls.append(None)
                    sig.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.list_(pa.int32())), pa.array(sketch, pa.binary())],
                ["doc_id", "row_key", "n", "cls", "sig", "sketch"],
            )

    return run


def _groups(batches, key: str):
    """Record batches sorted by ``key`` as one table for each key."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        keys = t.column(key).to_numpy()
        cut = np.flatnonzero(np.diff(keys)) + 1
        bounds = [0, *cut.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(bounds[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


class _Leaf:
    """The sets of a leaf, those of small components first: the largest has no pairs of its own to look at."""

    def __init__(self, t: pa.Table, floor: float, ratio: float):
        comp = t.column("comp").to_pylist()
        place = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        group = np.array([place[c] for c in comp])
        self.rank = np.lexsort((group, np.bincount(group)[group]))
        self.group = group[self.rank]
        self.cls = t.column("cls").take(pa.array(self.rank)).to_pylist()
        self.n = t.column("n").to_numpy()[self.rank].astype(np.float64)
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, POSITIONS)[self.rank]
        self.floor, self.ratio = floor, ratio
        #: From here on all sets are of one component.
        self.until = int(np.flatnonzero(self.group != self.group[-1])[-1]) + 1 if len(place) > 1 else 0

    def near(self, i: int) -> np.ndarray:
        """Later sets of other components whose sketch and size may be similar enough to set ``i``."""
        alike = (self.sketch[i + 1 :] == self.sketch[i]).sum(axis=1) >= self.floor * POSITIONS
        low, high = np.minimum(self.n[i + 1 :], self.n[i]), np.maximum(self.n[i + 1 :], self.n[i])
        return np.flatnonzero(alike & (low >= self.ratio * high - 1e-9) & (self.group[i + 1 :] != self.group[i])) + i + 1


def _compare(floor: float, ratio: float):
    """Candidate pairs of each leaf between components; a dense leaf gives a row with its node alone."""

    def run(batches):
        node, left, right = [], [], []
        for t in _groups(batches, "node"):
            leaf = _Leaf(t, floor, ratio)
            found, pairs = [], 0
            for i in range(leaf.until):
                j = leaf.near(i)
                found.append(j)
                pairs += len(j)
                if pairs > DENSE * t.num_rows:
                    node.append(t.column("node")[0].as_py())
                    left.append(None)
                    right.append(None)
                    break
            else:
                for i, near in enumerate(found):
                    for j in near.tolist():
                        x, y = sorted((leaf.cls[i], leaf.cls[j]))
                        node.append(None)
                        left.append(x)
                        right.append(y)
            if len(left) > 20_000:
                yield _pairs(node, left, right)
                node, left, right = [], [], []
        yield _pairs(node, left, right)

    return run


def _linked(floor: float, ratio: float, percent: int):
    """Pairs of full sets that are linked and join two components of their leaf, as a forest."""

    def run(batches):
        for t in _groups(batches, "node"):
            leaf = _Leaf(t, floor, ratio)
            held = [np.frombuffer(x, np.uint64) for x in t.column("members").take(pa.array(leaf.rank)).to_pylist()]
            size = np.array([len(x) for x in held])
            ids = np.unique(np.concatenate(held), return_inverse=True)[1].astype(np.int32)
            edge = np.concatenate(([0], np.cumsum(size)))
            mark, group = np.zeros(int(ids.max()) + 1, bool), leaf.group
            left, right = [], []
            for i in range(leaf.until):
                mine = ids[edge[i] : edge[i + 1]]
                mark[mine] = True
                for j in _by_size(leaf.near(i), size):
                    j = j[group[j] != group[i]]
                    if not len(j):
                        continue
                    hits = mark[np.concatenate([ids[edge[k] : edge[k + 1]] for k in j.tolist()])]
                    both = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(size[j])[:-1])), dtype=np.int64)
                    for k in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
                        if group[k] != group[i]:
                            left.append(min(leaf.cls[i], leaf.cls[k]))
                            right.append(max(leaf.cls[i], leaf.cls[k]))
                            group[group == group[k]] = group[i]
                mark[mine] = False
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def _by_size(rows: np.ndarray, size: np.ndarray, most: int = 1_000_000):
    """``rows`` in parts of about ``most`` shingles together."""
    if len(rows):
        yield from np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // most)) + 1)


def _pairs(node, left, right):
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["dense", "a", "b"])


def _sets(width: int):
    def run(batches):
        for batch in batches:
            cls, sets = [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, width).tobytes()
                cls.append(hashlib.md5(s).digest())
                sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "members"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).append_column("linked", pa.array(keep, pa.bool_()))

    return run


def _block_pairs(nodes: DataFrame, blocks, *more: str) -> DataFrame:
    """Rows (node, cls, *more) of a task for each two of a node's ``blocks``, two at least; rows (node, cls, *more, ...)."""
    n = F.greatest(F.lit(2), F.ceil(blocks)).cast("int")
    dealt = nodes.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("cls", "node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    return dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "cls", *more)


def _crowd_blocks(nodes: DataFrame) -> DataFrame:
    """Rows (node, cls, comp) of a task for each block of a crowd's component, with all outsiders in each.

    Rows (node, cls, comp, m, inside) of crowds: of m sets at most about 2 * ``LEAF`` are not inside.
    """
    n = F.ceil(F.col("m") / (4 * LEAF)).cast("int")
    own = F.array(F.pmod(F.xxhash64("cls", "node"), n).cast("int"))
    dealt = nodes.withColumn("block", F.explode(F.when(F.col("inside"), own).otherwise(F.sequence(F.lit(0), n - 1))))
    return dealt.select(F.xxhash64("node", "block").alias("node"), "cls", "comp")


def _trees(sigs: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """Leaves of all trees: rows (node, cls, comp) of ``sigs`` (cls, sig, comp)."""
    at = lambda key, k: F.pmod(F.xxhash64(key, F.lit(seed + k)), F.lit(POSITIONS)).cast("int") + 1

    def children(df: DataFrame, level: int) -> DataFrame:
        out = [F.xxhash64(F.col("node"), F.lit(w), F.element_at("sig", at(F.col("node"), 100 * level + 10 * w))) for w in range(2)]
        return df.select(F.explode(F.array(*out)).alias("node"), "cls", "comp")

    roots = sigs.select("cls", "sig", "comp", F.explode(F.array(*[F.lit(seed * 1000 + t).cast("long") for t in range(TREES)])).alias("node"))
    rows, leaves = children(roots, 0), None
    for level in range(1, LEVELS + 1):
        rows = scratch.keep(rows)
        parts = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
        sizes = parts.groupBy("node").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("alike"), F.max_by("comp", "k").alias("most")).where("alike < m * m")
        sized = scratch.keep(rows.join(sizes, "node").withColumn("inside", F.col("comp") == F.col("most")))
        small = F.col("m") <= LEAF
        crowd = ~small & (F.col("m") * F.col("m") - F.col("alike") <= 2 * LEAF * F.col("m"))
        last = ~small & ~crowd & (F.lit(level == LEVELS) | (F.lit(level >= FEW) & (F.col("m") <= WHOLE)))
        leaf = sized.where(small).select("node", "cls", "comp").unionByName(_crowd_blocks(sized.where(crowd))).unionByName(_block_pairs(sized.where(last), F.col("m") / BLOCK, "comp"))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = sized.where(~small & ~crowd & ~last)
        if large.isEmpty():
            return leaves
        rows = children(large.select("node", "cls", "comp").join(sigs.select("cls", "sig"), "cls"), level)
    return leaves


def _chain(floor: float, ratio: float):
    """Pairs of neighbours with one key, among rows sorted by key, whose sketches and sizes may be similar enough."""

    def run(batches):
        last = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            if not t.num_rows:
                continue
            last = t.slice(t.num_rows - 1).to_batches()[0]
            key, n, cls = t.column("key").to_numpy(), t.column("n").to_numpy().astype(np.float64), t.column("cls").to_pylist()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, POSITIONS)
            at = np.flatnonzero((key[1:] == key[:-1]) & (np.minimum(n[1:], n[:-1]) >= ratio * np.maximum(n[1:], n[:-1]) - 1e-9))
            at = at[(sketch[at] == sketch[at + 1]).mean(axis=1) >= floor]
            pairs = [sorted(cls[k : k + 2]) for k in at.tolist() if cls[k] != cls[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

    return run


def _backbone(sigs: DataFrame, floor: float, ratio: float) -> DataFrame:
    """Candidate pairs (a, b), a few for each class: neighbours by a run of tokens whose sketches agree.

    A heuristic: what it finds is confirmed and spares the trees work, what it misses they find.
    """
    keys = [F.xxhash64(F.lit(k), F.slice("sig", 1 + k * RUN, RUN)) for k in range(RUNS)]
    rows = sigs.select("cls", "n", "sketch", F.explode(F.array(*keys)).alias("key")).withColumn("turn", F.xxhash64("key", "cls"))
    rows = rows.repartitionByRange("key", "turn").sortWithinPartitions("key", "turn").select("key", "cls", "n", "sketch")
    return rows.mapInArrow(_chain(floor, ratio), "a binary, b binary").distinct()


def _union(batches):
    """(v, root) of all links that come, the least of a component its root."""
    up: dict[bytes, bytes] = {}

    def root(v: bytes) -> bytes:
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([root(v) for v in up], pa.binary())], ["v", "root"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for each end of the table ``edges`` (a, b), root the least of a component.

    Few links are joined by one executor task; else each vertex hooks to its least
    neighbour and jumps, round by round, on tables in the shared folder.  No edge
    reaches the driver.
    """
    if edges.count() <= SMALL_LINKS:
        return scratch.keep(edges.select("a", "b").coalesce(1).mapInArrow(_union, "v binary, root binary"))
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("root")))
    while True:
        hooked = both.join(state, both["b"] == state["v"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = scratch.keep(state.join(hooked, state["v"] == hooked["a"], "left").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        up = hooked.select(F.col("v").alias("u"), F.col("root").alias("above"))
        state = scratch.keep(hooked.join(up, hooked["root"] == up["u"], "left").select("v", "old", F.least("root", "above").alias("root")))
        if state.where("old <> root").isEmpty():
            return state.select("v", "root")
        state = state.select("v", "root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id, row_key.

    class_id tells components apart where ids don't (null: no shingle); row_key is
    ``xxhash64`` of the text, to find the row again where ids repeat.

    Links texts whose distinct ``width``-word shingle sets have
    100 * |both| >= ``percent`` * |either|; a component is what links reach, its id
    the smallest document id in it.

    * null, empty and blank texts: no shingle, linked with nothing, kept;
    * equal sets (copies, repeated rows) are one class and always linked; rows that
      share the smallest id are all kept, as the id alone tells rows apart here;
    * null ids: such a row counts after all others and is kept only alone;
    * a very long text is shingled whole by one worker, which holds its words' hashes;
    * an empty table gives an empty result; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(text_col).cast("binary").alias("text"))
    id_type = dict(base.dtypes)["doc_id"]
    signed = scratch.keep(base.mapInArrow(_sign(width), f"doc_id {id_type}, row_key long, n long, cls binary, sig array<int>, sketch binary"))
    rows = signed.select("doc_id", "row_key", "n", "cls")
    full = signed.where("cls is not null")
    sigs = scratch.keep(full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    least = sigs.select("cls", "n", "sketch")
    floor, ratio = percent / 100 - SKETCH_MARGIN, percent / 100

    def full_sets(ends: DataFrame) -> DataFrame:
        """(cls, members) of the classes ``ends`` (cls), from their texts."""
        ids = ends.join(sigs.select("cls", "doc_id"), "cls").select("doc_id").distinct()
        texts = base.join(ids, base["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
        return scratch.keep(texts.mapInArrow(_sets(width), "cls binary, members binary").join(ends, "cls", "left_semi").dropDuplicates(["cls"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with whether their full sets are linked."""
        sets = full_sets(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b")
        return scratch.keep(both.select("a", "b", "ma", "mb").mapInArrow(_confirm(percent), "a binary, b binary, linked boolean"))

    def by_node(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node", "cls").select("node", "cls", "n", "sketch", "comp", *more)

    def again(nodes: DataFrame, comps: DataFrame) -> DataFrame:
        """Links (a, b) of the leaves ``nodes`` (node) between components that are still apart."""
        rows = leaves.select("node", "cls").join(nodes, "node", "left_semi").join(least.join(comps, "cls"), "cls")
        live = rows.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("total")).where("low <> high").select("node", "total")
        rows = scratch.keep(rows.join(live, "node"))
        small = F.col("total") <= SHINGLES
        rows = rows.where(small).select("node", "cls", "n", "sketch", "comp").unionByName(_block_pairs(rows.where(~small), F.col("total") / (SHINGLES // 2), "n", "sketch", "comp"))
        sets = full_sets(rows.select("cls").distinct())
        return scratch.keep(by_node(rows.join(sets, "cls"), "members").mapInArrow(_linked(floor, ratio, percent), "a binary, b binary").distinct())

    def joined(comps: DataFrame, links: DataFrame, first: bool = False) -> DataFrame:
        """(cls, comp) after ``links`` (a, b): components of components; at the ``first``, of classes, from a kept table."""
        of = lambda x: comps.select(F.col("cls").alias(x), F.col("comp").alias(f"of_{x}"))
        edges = links if first else scratch.keep(links.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
        if edges.isEmpty():
            return comps
        reach = components(edges, scratch)
        return scratch.keep(comps.join(reach, comps["comp"] == reach["v"], "left").select("cls", F.coalesce("root", "comp").alias("comp")))

    comps = sigs.select("cls", F.col("cls").alias("comp"))
    checked = confirmed(scratch.keep(_backbone(sigs, floor, ratio)))
    comps = joined(comps, checked.where("linked").select("a", "b"), first=True)
    leaves = _trees(sigs.select("cls", "sig").join(comps, "cls"), scratch, seed)
    found = scratch.keep(by_node(leaves.join(least, "cls")).mapInArrow(_compare(floor, ratio), "dense long, a binary, b binary"))
    more = scratch.keep(found.where("a is not null").select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        comps = joined(comps, confirmed(more).where("linked"))
    dense = found.where("dense is not null").select(F.col("dense").alias("node")).distinct()
    if not dense.isEmpty():
        comps = joined(comps, again(dense, comps))
    lowest = scratch.keep(sigs.select("cls", "doc_id").join(comps.withColumnRenamed("comp", "root"), "cls"))
    of_root = lowest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = lowest.join(of_root, "root").select("cls", "component_id", F.col("root").alias("class_id"))
    out = scratch.keep(rows.join(named, "cls", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.hex("class_id").alias("class_id")))
    scratch.drop(but=1)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "class_id", "row_key")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("row_key")
