"""Many weighted forests grown and explained in one job: one for each group of rows and each fold left out.

Rows lie in blocks. A tree is an array of nodes in heap order (children of i at 2i + 1 and 2i + 2), grown level by
level from histograms of weights and targets over binned features. Where a group is one block, tasks grow its trees
from it; where it is many, a level is one shuffle: each block meets all trees of its group at once and sends the
histograms of their open nodes, keyed by group, fold and tree, and the sum of a tree's histograms splits its nodes. Trees
move to blocks, so a block is copied for neither folds nor trees. Bootstrap draws are Poisson counts from a hash of row
and tree, and histograms are summed in the order of blocks, so a forest doesn't depend on tasks or partitions.

Finished trees are rows of a table. To explain rows, blocks meet the trees of their group by key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdancy.session import large_rows, written

BINS = 64
BLOCK_ROWS = 1 << 15  # a task holds a block: some 70 bytes a row, and as much again while it works
BLOCKS_IN_FILE = 8  # a reader holds the blocks of a file
MOST_TASKS = 1_024  # over which blocks are spread
SHARES = 8  # tasks that grow the trees of a lone block
TREE_BYTES = 16 << 20  # trees that meet a block at once: all of a group, but for large forests
EDGE_ROWS = 20_000  # rows of a group, about, that the edges of bins are taken from
LEAVES_AT_ONCE, ROWS_AT_ONCE = 64, 2_000
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
TREE = "_group long, _fold int, _tree int, feature array<int>, threshold array<double>, cover array<double>, value array<double>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(hashes: np.ndarray, fold: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson counts of mean one."""
    of_tree = _mixed(np.array([(seed << 40) ^ (fold << 20) ^ tree], np.uint64))
    return np.searchsorted(_POISSON, _mixed(hashes.view(np.uint64) ^ of_tree) / 2.0**64).astype(float)


class Tree:
    """Nodes in heap order: feature (-1 at leaves), bin of the cut, sums of weights and of weighted targets. Nodes that don't exist have no weight."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.cover, self.total = np.zeros(n), np.zeros(n)

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row `levels` below the root, or the leaf that it ends in."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.cut[at]), at)
        return at

    def split(self, nodes: np.ndarray, sums: np.ndarray) -> None:
        """Splits nodes by their histograms (node, weight or target, feature, bin) where that lowers the squared error: the first of cuts as good as the best."""
        total = sums[:, :, 0].sum(2)
        left = sums.cumsum(3)[..., :-1]
        (w, s), (wl, sl) = (total.T[:, :, None, None], (left[:, 0], left[:, 1]))
        wr, sr = w - wl, s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((wl > 1e-9) & (wr > 1e-9), sl * sl / wl + sr * sr / wr - s * s / w, -1.0)
        gain = gain.reshape(len(nodes), -1)
        least = 1e-9 * (1 + total[:, 1] ** 2 / np.maximum(total[:, 0], 1e-9))
        best = (gain >= gain.max(1, keepdims=True) - least[:, None]).argmax(1)  # whatever the order of the sums
        rows = np.arange(len(nodes))
        does = gain[rows, best] > least
        f, b = np.divmod(best, left.shape[3])
        at, f, b, rows = nodes[does], f[does], b[does], rows[does]
        self.feature[at], self.cut[at] = f, b
        for child, weight, target in ((2 * at + 1, wl, sl), (2 * at + 2, wr, sr)):
            self.cover[child], self.total[child] = weight[rows, f, b], target[rows, f, b]

    def arrays(self, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """feature, threshold, cover, value: rows with x <= threshold go left."""
        f = self.feature
        threshold = np.where(f >= 0, edges[np.maximum(f, 0), self.cut], np.nan)
        return f, threshold, self.cover, np.divide(self.total, self.cover, out=np.zeros_like(self.total), where=self.cover > 0)


def histograms(bins: np.ndarray, at: np.ndarray, nodes: np.ndarray, w: np.ndarray, wy: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums of w and wy of the rows in each node (sorted), by feature and bin."""
    k = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
    use = np.flatnonzero((nodes[k] == at) & (w > 0))
    out = np.zeros((len(nodes), 2, bins.shape[1], n_bins))
    for f in range(bins.shape[1]):
        cell = k[use] * n_bins + bins[use, f]
        for j, v in enumerate((w, wy)):
            out[:, j, f] = np.bincount(cell, v[use], len(nodes) * n_bins).reshape(len(nodes), n_bins)
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin b of a feature holds edges[b - 1] < x <= edges[b]."""
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1).astype(np.int32)


def grown(block: dict[str, np.ndarray], fold: int, tree: int, depth: int, seed: int) -> Tree | None:
    """A tree from all rows of a block outside the fold; None if there are none."""
    use = block["fold"] != fold
    w = block["w"][use] * draws(block["h"][use], fold, tree, seed)
    if not w.any():
        w = block["w"][use]
    if not w.any():
        return None
    bins, wy = block["bins"][use], w * block["y"][use]
    out = Tree(depth)
    out.cover[0], out.total[0] = w.sum(), wy.sum()
    at = np.zeros(len(w), np.int64)
    rows, n_bins = np.arange(len(w)), block["edges"].shape[1] + 1
    nodes = np.array([0])
    for _ in range(depth):
        out.split(nodes, histograms(bins, at, nodes, w, wy, n_bins))
        nodes = nodes[out.feature[nodes] >= 0]
        if not len(nodes):
            break
        f = out.feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > out.cut[at]), -1)  # rows that ended take no further part
        keep = at >= 0
        bins, w, wy, at = bins[keep], w[keep], wy[keep], at[keep]
        rows = np.arange(len(w))
        nodes = np.sort(np.concatenate([2 * nodes + 1, 2 * nodes + 2]))
    return out


def leaves(feature: np.ndarray, threshold: np.ndarray, cover: np.ndarray, value: np.ndarray, features: int) -> dict[str, np.ndarray]:
    """Leaves of a tree in heap order: value, and for each feature the interval (low, high] that leads there and the share of cover kept along it."""
    n = len(feature)
    low, high, kept, exists = np.full((n, features), -np.inf), np.full((n, features), np.inf), np.ones((n, features)), np.zeros(n, bool)
    exists[0] = True
    first = 0
    while 2 * first + 1 < n:
        at = np.arange(first, 2 * first + 1)
        at = at[exists[at] & (feature[at] >= 0)]
        f, t = feature[at], threshold[at]
        for child, side in ((2 * at + 1, high), (2 * at + 2, low)):
            exists[child] = True
            low[child], high[child], kept[child] = low[at], high[at], kept[at]
            side[child, f] = np.minimum(side[child, f], t) if side is high else np.maximum(side[child, f], t)
            kept[child, f] *= cover[child] / cover[at]
        first = 2 * first + 1
    leaf = exists & (feature < 0)
    return {"value": value[leaf], "low": low[leaf], "high": high[leaf], "kept": kept[leaf]}


def explained_sum(x: np.ndarray, of: dict[str, np.ndarray]) -> np.ndarray:
    """Path-dependent Shapley values of each row and feature summed over trees, by a Gauss rule that is exact for the polynomial over each leaf."""
    n, p = x.shape
    nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-p // 2)))
    phi = np.zeros((n, p))
    for top in range(0, n, ROWS_AT_ONCE):
        rows = x[top : top + ROWS_AT_ONCE, None]
        for k in range(0, len(of["value"]), LEAVES_AT_ONCE):
            low, high, r, value = (of[c][k : k + LEAVES_AT_ONCE] for c in ("low", "high", "kept", "value"))
            z = ((rows > low) & (rows <= high)).astype(float)
            total = np.zeros_like(z)
            for u, w in zip((nodes + 1) / 2, weights / 2, strict=True):
                f = z * u + r * (1 - u)
                total += w * f.prod(2)[:, :, None] / f
            phi[top : top + ROWS_AT_ONCE] += np.einsum("nlp,l->np", (z - r) * total, value)
    return phi


_PACKED = {"row": np.int64, "h": np.int64, "fold": np.int32, "w": np.float64, "y": np.float64, "x": np.float64, "edges": np.float64, "bins": np.int32}
_COLUMNS = "_group long, _block int, _blocks int, " + ", ".join(f"{c} binary" for c in _PACKED)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch, k


def _block(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    """A packed block's rows as arrays, one row each."""
    out = {c: np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in _PACKED.items()}
    n = len(out["row"])
    return out | {"x": out["x"].reshape(n, -1), "bins": out["bins"].reshape(n, -1), "edges": out["edges"].reshape(out["x"].size // n, -1)}


def blocks(rows: DataFrame, features: list[str], target: str, weight: str | None, keys: list[str], n_bins: int = BINS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows (_group, _row, _fold and columns) in packed blocks of about block_rows: _group, _block, _blocks (of the group) and arrays.

    Edges of bins are quantiles of about EDGE_ROWS rows of the group, chosen by hash; every value is an edge where a
    feature has few.
    """
    large_rows(rows.sparkSession)
    lot = F.xxhash64(*keys, *features, target)
    some = rows.withColumn("_h", lot)
    sizes = some.groupBy("_group").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
    sizes = written(sizes)
    chosen = some.join(sizes, "_group").where(F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) < (1 << 30) * (EDGE_ROWS / F.col("_n")))
    at = F.array(*(F.lit(k / n_bins) for k in range(1, n_bins + 1)))
    edges = chosen.groupBy("_group").agg(F.array(*(F.array_sort(F.array_distinct(F.percentile(F.col(f).cast("double"), at))) for f in features)).alias("edges"))
    row = F.struct(F.col("_h").alias("h"), F.col("_row").alias("row"), F.col("_fold").alias("fold"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.col(target).cast("double").alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    placed = some.join(sizes, "_group").select("_group", F.pmod("_h", "_blocks").cast("int").alias("_block"), "_blocks", row.alias("rows"))
    listed = placed.groupBy("_group", "_block", "_blocks").agg(F.sort_array(F.collect_list("rows")).alias("rows")).join(edges, "_group")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _each(batches):
            own = batch.column("rows")[k].values
            out = {c: own.field(c).to_numpy(zero_copy_only=False).astype(_PACKED[c]) for c in ("row", "h", "fold", "w", "y")}
            out["x"] = own.field("x").flatten().to_numpy().reshape(len(out["row"]), -1)
            told = batch.column("edges")[k].as_py()
            n = max(map(len, told))
            out["edges"] = np.array([[*e, *[np.inf] * (n - len(e))] for e in told])
            out["bins"] = binned(out["x"], out["edges"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("_group", "_block", "_blocks")), *(pa.array([out[c].tobytes()], pa.binary()) for c in _PACKED)], ["_group", "_block", "_blocks", *_PACKED])

    return listed.select("_group", "_block", "_blocks", "edges", "rows").mapInArrow(pack, _COLUMNS)


def _spread(met: DataFrame, blocks: int, *more: str) -> DataFrame:
    """Blocks over tasks, rarely two in one: adaptive execution would gather small ones, but work on a block takes long."""
    return met.repartition(max(1, min(4 * blocks, MOST_TASKS)), "_group", "_block", *more)


def _copied(of: DataFrame, times: int, blocks: int) -> DataFrame:
    """Each block `times` times, spread over tasks."""
    return _spread(of.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))), times * blocks, "_chunk")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (group, fold, tree, feature, threshold, cover, value)."""
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.list_(pa.int32())), *(pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (4, 5, 6))],
        ["_group", "_fold", "_tree", "feature", "threshold", "cover", "value"],
    )


def forests(of: DataFrame, folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """A table of trees: for each group and fold, `trees` trees of the group's rows outside the fold, thresholds in units of the features."""
    pairs = list(itertools.product(range(folds), range(trees)))
    shares = min(SHARES, len(pairs))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _each(batches):
            block = _block(batch, k)
            group, chunk = (batch.column(c)[k].as_py() for c in ("_group", "_chunk"))
            for fold, tree in pairs[chunk::shares]:
                if (t := grown(block, fold, tree, depth, seed)) is not None:
                    yield _told([(group, fold, tree, *t.arrays(block["edges"]))])

    large_rows(of.sparkSession)
    lone, many = of.where("_blocks = 1"), of.where("_blocks > 1")
    alone = _copied(lone, shares, lone.count()).mapInArrow(grow, TREE)
    return alone if many.isEmpty() else alone.unionByName(_by_levels(many, folds, trees, depth, seed))


_HELD = {"feature": np.int32, "cut": np.int32, "cover": np.float64, "total": np.float64}
_STATE = "_group long, _fold int, _tree int, _chunk int, n_bins int, " + ", ".join(f"{c} binary" for c in _HELD)


def _by_levels(of: DataFrame, folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """Trees of groups of many blocks: a level of all of them is one join of blocks and trees and one shuffle of histograms."""
    of = written(of, BLOCKS_IN_FILE)
    each = of.select("_group", "_block")
    n_blocks = each.count()
    state = None
    pairs = list(itertools.product(range(folds), range(trees)))
    together = max(1, TREE_BYTES // (24 * 2 ** (depth + 1)))
    names = ["_group", "_fold", "_tree", "_chunk", "n_bins"]
    kinds = [pa.int64(), *[pa.int32()] * 4]

    def tree_of(told: dict[str, bytes]) -> Tree:
        t = Tree(depth)
        for c, kind in _HELD.items():
            setattr(t, c, np.frombuffer(told[c], kind).copy())
        return t

    def packed(t: Tree | None) -> list[bytes | None]:
        return [getattr(t, c).tobytes() if t else None for c in _HELD]

    for level in range(depth):

        def send(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch, k in _each(batches):
                block = _block(batch, k)
                group, chunk, number = (batch.column(c)[k].as_py() for c in ("_group", "_chunk", "_block"))
                n_bins = block["edges"].shape[1] + 1
                if level == 0:
                    known = [(fold, tree, Tree(depth)) for fold, tree in pairs[chunk * together : (chunk + 1) * together]]
                else:
                    known = [(t["_fold"].as_py(), t["_tree"].as_py(), tree_of({c: t[c].as_py() for c in _HELD})) for t in batch.column("trees")[k].values]
                for fold, some in itertools.groupby(sorted(known, key=lambda t: t[:2]), key=lambda t: t[0]):
                    use = block["fold"] != fold
                    bins, y, own, h = (block[c][use] for c in ("bins", "y", "w", "h"))
                    for _, tree, t in some:
                        w = own * draws(h, fold, tree, seed)
                        nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
                        if level:
                            nodes = nodes[(t.cover[nodes] > 0) & (t.feature[(nodes - 1) // 2] >= 0)]
                        at = t.node(bins, level)
                        nodes = np.intersect1d(nodes, at)
                        sums = histograms(bins, at, nodes, w, w * y, n_bins) if len(nodes) else np.zeros(0)
                        values = [group, fold, tree, chunk, n_bins, number, nodes.astype(np.int64).tobytes(), sums.tobytes(), *packed(t if number == 0 else None)]
                        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, [*kinds, pa.int32(), *[pa.binary()] * 6], strict=True)], [*names, "_block", "nodes", "sums", *_HELD])

        def add(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            def settled(key: list, t: Tree, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
                if sums:
                    nodes = np.array(sorted(sums))
                    both = np.stack([sums[i] for i in nodes.tolist()])
                    if level == 0:
                        t.cover[0], t.total[0] = both[0, :, 0].sum(1)
                    t.split(nodes, both)
                return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip([*key, *packed(t)], [*kinds, *[pa.binary()] * 4], strict=True)], [*names, *_HELD])

            last, t, sums = None, None, {}
            for batch, k in _each(batches):
                key = [batch.column(c)[k].as_py() for c in names]
                if key != last:
                    if last is not None:
                        yield settled(last, t, sums)
                    last, t, sums = key, tree_of({c: batch.column(c)[k].as_py() for c in _HELD}), {}  # block 0 comes first
                nodes = np.frombuffer(batch.column("nodes")[k].as_py(), np.int64)
                if len(nodes):
                    own = np.frombuffer(batch.column("sums")[k].as_py()).reshape(len(nodes), 2, -1, key[-1])
                    for i, h in zip(nodes.tolist(), own, strict=True):
                        sums[i] = sums[i] + h if i in sums else h
            if last is not None:
                yield settled(last, t, sums)

        if level == 0:
            met = _copied(of, -(-len(pairs) // together), n_blocks)
        else:
            chunk = state.groupBy("_group", "_chunk").agg(F.collect_list(F.struct("_fold", "_tree", *_HELD)).alias("trees"))
            met = _spread(chunk.join(each, "_group"), n_blocks).join(of, ["_group", "_block"])
        sent = _STATE.replace("n_bins int", "n_bins int, _block int, nodes binary, sums binary")
        by_tree = met.mapInArrow(send, sent).repartition("_group", "_fold", "_tree").sortWithinPartitions("_group", "_fold", "_tree", "_block")
        state = written(by_tree.mapInArrow(add, _STATE))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _each(batches):
            row = {c: batch.column(c)[k].as_py() for c in ("_group", "_fold", "_tree", "edges", *_HELD)}
            edges = np.frombuffer(row["edges"]).reshape(-1, batch.column("n_bins")[k].as_py() - 1)
            yield _told([(row["_group"], row["_fold"], row["_tree"], *tree_of(row).arrays(edges))])

    return state.join(of.where("_block = 0").select("_group", "edges"), "_group").mapInArrow(finish, TREE)


def contributions_of(of: DataFrame, models: DataFrame, features: list[str], folds: int, trees: int) -> DataFrame:
    """_row, phi (an array by feature), base: contributions to each row under the forest of its group that left out its fold; rows without such a forest are missing."""
    p = len(features)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _each(batches):
            block = _block(batch, k)
            told = batch.column("trees")[k].values
            of_fold = told.field("_fold").to_numpy()
            order = np.lexsort((told.field("_tree").to_numpy(), of_fold))
            for fold in np.intersect1d(block["fold"], of_fold):
                own = block["fold"] == fold
                found = [leaves(*(told.field(c)[i].values.to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "cover", "value")), p) for i in order[of_fold[order] == fold].tolist()]
                phi = explained_sum(block["x"][own], {c: np.concatenate([part[c] for part in found]) for c in found[0]})
                base = sum(float((part["value"] * part["kept"].prod(1)).sum()) for part in found)
                n = len(phi)
                yield pa.RecordBatch.from_arrays([pa.array(block["row"][own]), pa.FixedSizeListArray.from_arrays(phi.ravel(), p).cast(pa.list_(pa.float64())), pa.array(np.full(n, base)), pa.array(np.full(n, len(found), np.int64))], ["_row", "phi", "base", "n"])

    large_rows(of.sparkSession)
    size = models.agg(F.max(F.size("feature"))).first()[0] or 1
    together = max(1, TREE_BYTES // (28 * size * folds))
    chunk = F.floor(F.col("_tree") / together).cast("int").alias("_chunk")
    told = models.groupBy("_group", chunk).agg(F.collect_list(F.struct("_fold", "_tree", "feature", "threshold", "cover", "value")).alias("trees"))
    each = of.select("_group", "_block")
    met = _spread(told.join(each, "_group"), each.count()).join(of, ["_group", "_block"])
    parts = met.mapInArrow(explain, "_row long, phi array<double>, base double, n long")
    summed = parts.groupBy("_row").agg(*(F.sum(F.col("phi")[k]).alias(f"_{k}") for k in range(p)), F.sum("base").alias("base"), F.sum("n").alias("n"))
    return summed.select("_row", F.array(*(F.col(f"_{k}") / F.col("n") for k in range(p))).alias("phi"), (F.col("base") / F.col("n")).alias("base"))
