"""Multi-class boosted trees in one model: softmax gradients of all classes, one histogram per tree level.

Every round grows one tree per class. A level of all these trees takes one pass over the rows: gradients and
hessians are summed by (tree, node, feature, bin), and the best split of every node is read from the
running sums over the bins. Second-order gains, as boosted trees with a histogram method have them.

Fitting reads all labelled rows. Up to ``FIT_ROWS`` rows and ``FIT_CELLS`` values, a setting is one task's
work, and several settings fit side by side. More rows are binned once into chunks that are dealt over
all cores; every level of all settings' trees is one job over the chunks, whose sums the driver adds up and
splits. A task reads its chunks one after another, so its memory does not grow with the table. Margins are
carried from round to round in cached chunks, with a reliable checkpoint every ``CHECKPOINT_ROUNDS``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut, shared_folder, stored
from .quantiles import values_at

#: Most labelled rows and feature values (rows times width) that one task fits by itself.
FIT_ROWS = 50_000
FIT_CELLS = 20_000_000
#: Most cut points of a feature.
MAX_BINS = 64
#: Most rows of a chunk, and of a partition of chunks where that makes more partitions than cores.
CHUNK_ROWS = 65_536
PART_ROWS = 4_000_000
#: Most joint bins of features that are counted together: a row's code is a byte.
JOINT = 256
#: Most bytes of sums that a task makes in one pass, and that the driver keeps of a level.
PASS_BYTES = 64 << 20
KEPT_BYTES = 256 << 20
#: Rounds between two checkpoints of the margins.
CHECKPOINT_ROUNDS = 20
_TREE = "round int, class int, node int, feature int, threshold double, left int, right int, value double, gain double"


def cut_points(x: np.ndarray, most: int = MAX_BINS) -> np.ndarray:
    """Ascending thresholds: between all distinct values, or at evenly spaced ranks of too many."""
    known = np.unique(x[~np.isnan(x)])
    if len(known) > most + 1:
        ranks = np.linspace(0, len(x) - 1, most + 2)[1:-1]
        known = np.unique(np.sort(x)[ranks.astype(int)])
        return known[~np.isnan(known)]
    return (known[:-1] + known[1:]) / 2


def cut_points_of(rows: DataFrame, width: int, total: int, most: int = MAX_BINS) -> list[np.ndarray]:
    """:func:`cut_points` of every slot of ``x``, over all rows.

    One pass finds the slots of few values; ranks of the others are read off their counted values.
    """

    def seen(batches):
        known = [np.empty(0)] * width
        for batch in batches:
            x = _matrix(batch, width)
            for f in range(width):
                if len(known[f]) <= most + 1:
                    known[f] = np.unique(np.concatenate([known[f], x[~np.isnan(x[:, f]), f]]))[: most + 2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(width, dtype=np.int32), [len(k) for k in known])), pa.array(np.concatenate([*known, np.empty(0)]))],
            names=["feature", "value"],
        )

    found = rows.select("x").mapInArrow(seen, "feature int, value double").distinct().toPandas()
    known = {f: np.sort(k.value.to_numpy()) for f, k in found.groupby("feature")}
    cuts = [(k[:-1] + k[1:]) / 2 for k in (known.get(f, np.empty(0)) for f in range(width))]
    many = [f for f in range(width) if len(cuts[f]) > most]
    if many:
        value = {str(f): F.get("x", F.lit(f)) for f in many}
        ranks = np.linspace(0, total - 1, most + 2)[1:-1].astype(int)
        placed = values_at(rows, {f: F.when(~F.isnan(v), v) for f, v in value.items()}, sorted(set(ranks.tolist())))
        cuts = [np.unique(placed.get(str(f), [])) if f in many else c for f, c in enumerate(cuts)]
    return cuts


def bin_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cuts lie below each value; a missing value lies above all of them."""
    return np.searchsorted(cuts, x, side="left")


@dataclass
class Grower:
    """Grows the trees of all classes, level by level, on binned rows."""

    bins: np.ndarray
    sizes: np.ndarray
    classes: int
    depth: int
    step: float
    shrink: float = 1.0
    least_weight: float = 1.0
    starts: np.ndarray = field(init=False)
    total: int = field(init=False)

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.total = int(self.sizes.sum())

    def histogram(self, rows: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of gradient and hessian by (node, bin of every feature): the one pass of a level."""
        sums = np.empty((2, slots, self.total))
        for f, (start, size) in enumerate(zip(self.starts, self.sizes)):
            at = slot * size + self.bins[f, rows]
            for k, weights in enumerate((g, h)):
                sums[k, :, start : start + size] = np.bincount(at, weights, slots * size).reshape(slots, size)
        return sums

    def best(self, sums: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every node the largest gain, its feature and its bin; the first of equal ones."""
        upto = np.cumsum(sums, axis=2)
        before = np.where(self.starts > 0, upto[:, :, self.starts - 1], 0.0)
        left = upto - np.repeat(before, self.sizes, axis=2)
        right = np.stack([g, h])[:, :, None] - left
        enough = (left[1] >= self.least_weight) & (right[1] >= self.least_weight)
        enough[:, self.starts + self.sizes - 1] = False  # nothing lies above a feature's last bin
        parent = g * g / (h + self.shrink)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + self.shrink) + right[0] ** 2 / (right[1] + self.shrink) - parent[:, None]
        gain = np.where(enough, gain, -np.inf)
        # sums that differ by rounding only count as equal
        top = gain.max(1, initial=-np.inf)
        near = gain >= (top - np.abs(top) * 1e-9)[:, None]
        at = near.argmax(1)
        feature = np.searchsorted(self.starts, at, side="right") - 1
        return top, feature, at - self.starts[feature]

    def trees(self, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """One tree per class from (row, class) gradients: nodes as (class, node, feature, bin, left,
        right, value, gain), and the margins they add."""
        n = len(g)
        rows = np.tile(np.arange(n), self.classes)
        gradient, hessian = g.T.ravel(), h.T.ravel()
        # every entry is a row in one class's tree; open nodes are numbered over all trees
        slot = np.repeat(np.arange(self.classes), n)
        tree, node = np.arange(self.classes), np.zeros(self.classes, np.int64)
        used = np.ones(self.classes, np.int64)
        entries = np.arange(n * self.classes)
        added = np.zeros(n * self.classes)
        found: list[tuple] = []
        sums = None
        for level in range(self.depth + 1):
            slots = len(tree)
            g_sum = np.bincount(slot, gradient[entries], slots)
            h_sum = np.bincount(slot, hessian[entries], slots)
            split = np.zeros(slots, bool)
            if level < self.depth and self.total:
                if sums is None:
                    sums = self.histogram(rows[entries], slot, slots, gradient[entries], hessian[entries])
                # a node of too little weight has no two children; most deep ones are like that
                heavy = np.flatnonzero(h_sum >= 2 * self.least_weight)
                feature, at, gain = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.full(slots, -np.inf)
                gain[heavy], feature[heavy], at[heavy] = self.best(sums[:, heavy], g_sum[heavy], h_sum[heavy])
                split = gain > 1e-6
            value = -g_sum / (h_sum + self.shrink) * self.step
            for s in np.flatnonzero(~split):
                found.append((int(tree[s]), int(node[s]), -1, -1, -1, -1, float(value[s]), 0.0))
            closed = ~split[slot]
            added[entries[closed]] = value[slot[closed]]
            if not split.any():
                break
            parents = np.flatnonzero(split)
            first = np.zeros(len(parents), np.int64)
            for i, s in enumerate(parents):
                first[i] = used[tree[s]]
                used[tree[s]] += 2
                found.append((int(tree[s]), int(node[s]), int(feature[s]), int(at[s]), int(first[i]), int(first[i]) + 1, 0.0, float(gain[s])))
            place = np.full(slots, -1)
            place[parents] = np.arange(len(parents))
            entries, slot = entries[~closed], slot[~closed]
            goes_right = self.bins[feature[slot], rows[entries]] > at[slot]
            slot = 2 * place[slot] + goes_right
            tree = np.repeat(tree[parents], 2)
            node = np.column_stack([first, first + 1]).ravel()
            if level + 1 < self.depth:
                # sum the smaller child of each pair, the other one is the rest of its parent
                count = np.bincount(slot, minlength=2 * len(parents)).reshape(-1, 2)
                small = 2 * np.arange(len(parents)) + (count[:, 1] < count[:, 0])
                pick = np.zeros(2 * len(parents), bool)
                pick[small] = True
                own = pick[slot]
                part = self.histogram(rows[entries[own]], slot[own] // 2, len(parents), gradient[entries[own]], hessian[entries[own]])
                both = np.empty((2, 2 * len(parents), self.total))
                both[:, small] = part
                both[:, small ^ 1] = sums[:, parents] - part
                sums = both
        return found, added.reshape(self.classes, n).T


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def grow(x: np.ndarray, y: np.ndarray, classes: int, trees: int, depth: int, step: float, seed: int = 0) -> pd.DataFrame:
    """All nodes of ``trees`` rounds, one tree per class and round.

    There is no random part: ``seed`` is accepted, as settings name one, and changes nothing. Of two
    classes only the second one's trees are grown, the first one's are the same with opposite values.
    """
    cuts = [cut_points(x[:, f]) for f in range(x.shape[1])]
    bins = np.array([bin_of(x[:, f], c) for f, c in enumerate(cuts)], np.int32).reshape(len(cuts), len(x))
    sizes = np.array([len(c) + 1 for c in cuts], np.int64)
    first = 1 if classes == 2 else 0
    grower = Grower(bins, sizes, classes - first, depth, step)
    margins, hit = np.zeros((len(x), classes)), np.arange(classes) == y[:, None]
    nodes = []
    for number in range(trees if len(x) else 0):
        p = softmax(margins)
        found, added = grower.trees((p - hit)[:, first:], np.maximum(2 * p * (1 - p), 1e-16)[:, first:])
        margins[:, first:] += added
        margins[:, :first] -= added[:, :first]
        for k, node, feature, at, left, right, value, gain in found:
            cut = float(cuts[feature][at]) if feature >= 0 else 0.0
            nodes.append((number, k + first, node, feature, cut, left, right, value, gain))
            if first:
                nodes.append((number, k, node, feature, cut, left, right, -value, gain))
    return _table(nodes)


def _table(nodes: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _TREE.split(", ")])


@dataclass(frozen=True)
class Boosted:
    """A fitted model: its nodes in flat arrays, a root per (round, class)."""

    classes: int
    width: int
    nodes: pd.DataFrame

    @property
    def importances(self) -> list[float]:
        """Mean gain of each feature's splits, scaled to sum 1."""
        inner = self.nodes[self.nodes.feature >= 0]
        mean = inner.groupby("feature").gain.mean().reindex(range(self.width), fill_value=0.0)
        return (mean / (mean.sum() or 1.0)).tolist()

    def flat(self) -> tuple:
        nodes = self.nodes.sort_values(["round", "class", "node"]).reset_index(drop=True)
        tree = nodes["round"].to_numpy() * self.classes + nodes["class"].to_numpy()
        roots = np.flatnonzero(nodes.node.to_numpy() == 0)
        base = roots[tree] if len(roots) else tree
        leaf = nodes.feature.to_numpy() < 0
        here = np.arange(len(nodes))
        # a leaf leads to itself, so all rows take as many steps as the deepest tree has levels
        child = np.column_stack([base + nodes.left.to_numpy(), base + nodes.right.to_numpy()])
        child[leaf] = here[leaf, None]
        steps, open_nodes = 0, roots[~leaf[roots]]
        while len(open_nodes):
            steps += 1
            below = child[open_nodes].ravel()
            open_nodes = below[~leaf[below]]
        feature = np.maximum(nodes.feature.to_numpy(), 0)
        return roots, feature, nodes.threshold.to_numpy(), child.ravel(), nodes.value.to_numpy(), steps

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _margins(self.flat(), self.classes, x)

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction", probability: str = "probability") -> DataFrame:
        """Add the class probabilities (array) and the most likely class (the lowest of equal ones)."""
        flat, classes = df.sparkSession.sparkContext.broadcast(self.flat()), self.classes

        @F.pandas_udf("array<double>")
        def chances(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(softmax(_margins(flat.value, classes, np.vstack(vectors.to_list())))))

        scored = df.withColumn(probability, chances(numbers(df, features)))
        best = F.array_position(probability, F.array_max(probability)) - 1
        return scored.withColumn(out, best.cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the nodes as Parquet; ``load`` reads them back."""
        table = spark.createDataFrame(self.nodes, _TREE)
        table.select("*", F.lit(self.classes).alias("classes"), F.lit(self.width).alias("width")).coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Boosted:
    table = spark.read.parquet(path)
    classes, width = table.select("classes", "width").head()
    return Boosted(classes, width, table.drop("classes", "width").toPandas())


def _margins(flat: tuple, classes: int, x: np.ndarray) -> np.ndarray:
    roots, feature, threshold, child, value, steps = flat
    total = np.zeros((len(x), classes))
    cells, row = np.ascontiguousarray(x, np.float64).ravel(), np.arange(len(x)) * x.shape[1]
    for number, root in enumerate(roots):
        at = np.full(len(x), root)
        for _ in range(steps):
            low = cells.take(row + feature.take(at)) <= threshold.take(at)
            at = child.take(2 * at + ~low)
        total[:, number % classes] += value.take(at)
    return total


def numbers(df: DataFrame, features: str) -> Column:
    return F.col(features) if dict(df.dtypes)[features].startswith("array") else vector_to_array(features)


def bounded_sample(df: DataFrame, features: str, label: str, most: int = FIT_ROWS, cells: int = FIT_CELLS, seed: int = 42) -> DataFrame:
    """``(x, y)`` of at most ``most`` labelled rows and about ``cells`` values, all rows if they fit.

    ``df`` is read twice, to count its rows and to take the sample; only the sample is stored.
    """
    rows = df.select(numbers(df, features).alias("x"), F.col(label).cast("int").alias("y")).where("y is not null")

    def bounded(rows: DataFrame, total: int, most: int, seed: int) -> DataFrame:
        return rows if total <= most else rows.sample(min(1.0, most / total), seed).limit(most)

    sample = cut(bounded(rows, rows.count(), most, seed))
    total, width = sample.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return bounded(sample, total, max(1, min(most, cells // max(width or 1, 1))), seed + 1)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The column ``x`` of a batch as (row, slot)."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


@dataclass
class Layout:
    """Features packed into groups of at most ``JOINT`` joint bins, so that a group is one sum per row."""

    sizes: np.ndarray
    group: np.ndarray = field(init=False)
    stride: np.ndarray = field(init=False)
    groups: int = field(init=False)

    def __post_init__(self):
        self.group, self.stride = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64)
        filled: list[int] = []
        for f in np.argsort(-self.sizes, kind="stable"):
            q = next((q for q, joint in enumerate(filled) if joint * self.sizes[f] <= JOINT), len(filled))
            if q == len(filled):
                filled.append(1)
            self.group[f], self.stride[f] = q, filled[q]
            filled[q] *= int(self.sizes[f])
        self.groups = len(filled)

    def codes(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        """(group, row): the joint bin of every group's features."""
        out = np.zeros((self.groups, len(x)), np.uint8)
        for f, c in enumerate(cuts):
            out[self.group[f]] += (bin_of(x[:, f], c) * self.stride[f]).astype(np.uint8)
        return out

    def apart(self, joint: np.ndarray) -> np.ndarray:
        """Sums by (..., bin of every feature) from those by (group, ..., joint bin)."""
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        out, code = np.empty((*joint.shape[1:-1], starts[-1])), np.arange(JOINT)
        for f, size in enumerate(self.sizes):
            of = code // self.stride[f] % size == np.arange(size)[:, None]
            out[..., starts[f] : starts[f + 1]] = joint[self.group[f]] @ of.T.astype(np.float64)
        return out


@dataclass
class Tree:
    """A tree so far, in lists by node: a leaf has the feature -1 and leads to itself."""

    feature: list = field(default_factory=lambda: [-1])
    at: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def open(self, node: int, feature: int, at: int, gain: float) -> int:
        """Split a leaf; its first child."""
        child = len(self.feature)
        self.feature[node], self.at[node], self.left[node], self.gain[node] = feature, at, child, gain
        for own, start in ((self.feature, -1), (self.at, 0), (self.value, 0.0), (self.gain, 0.0)):
            own += [start, start]
        self.left += [child, child + 1]
        return child

    def table(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Of every node its feature's group, and where each joint bin of it leads."""
        feature, left = np.array(self.feature), np.array(self.left)
        inner, here = feature >= 0, np.maximum(feature, 0)
        of = np.arange(JOINT) // layout.stride[here, None] % layout.sizes[here, None]
        leads = left[:, None] + (inner[:, None] & (of > np.array(self.at)[:, None]))
        return layout.group[here], leads.ravel()


def _walked(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, steps: int) -> np.ndarray:
    """The node of every row after so many steps from the root."""
    group, leads = table
    n = codes.shape[1]
    row, flat, offset = np.arange(n), codes.ravel(), group * n
    node = np.zeros(n, np.int64)
    for step in range(steps):
        if step == 0:
            code = codes[group[0]]
        else:
            place = offset.take(node)
            place += row
            code = flat.take(place)
            node *= JOINT
        node += code
        node = leads.take(node)
    return node


def _gradients(margins: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, row) gradients and hessians of the classes that have trees."""
    first = classes - len(margins)
    p = np.concatenate([-margins, margins]) if first else margins.copy()
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    p = p[first:]
    h = 1 - p
    h *= p
    h *= 2
    for k in range(len(p)):
        p[k] -= y == k + first
    return p, np.maximum(h, 1e-16, out=h)


@dataclass
class Growth(Grower):
    """One setting's trees of a round, grown on the driver from sums that all cores add up.

    ``bins`` is not used. Open nodes are numbered over all trees; ``own`` are those whose sums are asked for,
    the other child of a pair is the rest of its parent.
    """

    rounds: int = 0

    def begin(self) -> None:
        self.trees_now = [Tree() for _ in range(self.classes)]
        self.level, self.steps, self.parents = 0, 0, None
        self.tree, self.node = np.arange(self.classes), np.zeros(self.classes, np.int64)
        self._ask(None, None)

    def _ask(self, g: np.ndarray | None, h: np.ndarray | None) -> None:
        """Which of the open nodes need sums; nodes that cannot be split are closed."""
        n, self.g, self.h = len(self.tree), g, h
        self.feature, self.at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.gain, self.low = np.full(n, -np.inf), np.zeros((2, n))
        self.heavy = np.ones(n, bool) if h is None else (h >= 2 * self.least_weight) & (self.level < self.depth)
        self.kept = n * self.total * 16 <= KEPT_BYTES
        if self.parents is not None and self.kept:
            pairs = np.flatnonzero(self.heavy.reshape(-1, 2).any(1))
            self.own = 2 * pairs + (h[2 * pairs + 1] < h[2 * pairs])
        else:
            self.parents, self.own = None, np.flatnonzero(self.heavy)
        self.sums = np.zeros((2, n, self.total)) if self.kept and len(self.own) else None

    def receive(self, at: np.ndarray, sums: np.ndarray) -> None:
        """Sums of some of the nodes that were asked for."""
        if self.sums is None:
            self._rate(at, sums)
        else:
            self.sums[:, at] = sums

    def _rate(self, at: np.ndarray, sums: np.ndarray) -> None:
        if self.level == 0:
            if self.g is None:
                self.g, self.h = np.zeros((2, len(self.tree)))
            self.g[at], self.h[at] = sums[:, :, : self.sizes[0]].sum(2)
        enough = (self.h[at] >= 2 * self.least_weight) & (self.level < self.depth)
        at, sums = at[enough], sums[:, enough]
        self.gain[at], self.feature[at], self.at[at] = self.best(sums, self.g[at], self.h[at])
        for i, s in enumerate(at):
            start = self.starts[self.feature[s]]
            self.low[:, s] = sums[:, i, start : start + self.at[s] + 1].sum(1)

    def split(self) -> None:
        """Close or split the open nodes, whose sums have all arrived; their children are open then."""
        if self.sums is not None:
            if self.parents is not None:
                self.sums[:, self.own ^ 1] = self.parents[:, self.own // 2] - self.sums[:, self.own]
            heavy = np.flatnonzero(self.heavy)
            self._rate(heavy, self.sums[:, heavy])
        split = self.gain > 1e-6
        value = -self.g / (self.h + self.shrink) * self.step
        for s in np.flatnonzero(~split):
            self.trees_now[self.tree[s]].value[self.node[s]] = float(value[s])
        at = np.flatnonzero(split)
        first = np.array(
            [self.trees_now[self.tree[s]].open(self.node[s], int(self.feature[s]), int(self.at[s]), float(self.gain[s])) for s in at], np.int64
        )
        whole, low = np.stack([self.g, self.h])[:, at], self.low[:, at]
        self.parents = self.sums[:, at] if self.sums is not None else None
        self.tree, self.node = np.repeat(self.tree[at], 2), np.column_stack([first, first + 1]).ravel()
        self.level, self.steps = self.level + 1, self.steps + (len(at) > 0)
        self._ask(*np.stack([low, whole - low], 2).reshape(2, -1))

    def nodes(self, number: int, first: int, cuts: list[np.ndarray]) -> list[tuple]:
        """The round's nodes as rows of the model; of two classes the first one's have opposite values."""
        found = []
        for k, tree in enumerate(self.trees_now):
            for node, (f, at, left, value, gain) in enumerate(zip(tree.feature, tree.at, tree.left, tree.value, tree.gain)):
                rest = (f, float(cuts[f][at]), left, left + 1) if f >= 0 else (-1, 0.0, -1, -1)
                found.append((number, k + first, node, *rest, value, gain))
                if first:
                    found.append((number, k, node, *rest, -value, gain))
        return found


def _level_sums(state: RDD, layout: Layout, asked: list[tuple[int, int, list]], classes: int) -> dict:
    """Sums of gradient and hessian of all rows by (setting, tree): ``(2, node, bin of every feature)``.

    ``asked`` has of every setting its level and of every tree ``(number, tree, nodes)``.
    """

    def sums(chunks):
        tables = {(s, k): tree.table(layout) for s, _, trees in asked for k, tree, _ in trees}
        slots, joint = {}, {}
        for s, _, trees in asked:
            for k, tree, nodes in trees:
                slots[s, k] = np.full(len(tree.feature), -1)
                slots[s, k][nodes] = np.arange(len(nodes))
                joint[s, k] = np.zeros((layout.groups, 2, len(nodes) * JOINT))
        for codes, y, margins in chunks:
            for s, level, trees in asked:
                weights = _gradients(margins[s], y, classes)
                for k, _, nodes in trees:
                    slot = slots[s, k].take(_walked(tables[s, k], codes, level))
                    rows = np.flatnonzero(slot >= 0)
                    every = len(rows) == len(slot)
                    base = slot * JOINT if every else slot.take(rows) * JOINT
                    g, h = (w[k] if every else w[k].take(rows) for w in weights)
                    for q in range(layout.groups):
                        at = base + (codes[q] if every else codes[q].take(rows))
                        joint[s, k][q, 0] += np.bincount(at, g, len(nodes) * JOINT)
                        joint[s, k][q, 1] += np.bincount(at, h, len(nodes) * JOINT)
        yield {key: layout.apart(of.reshape(layout.groups, 2, -1, JOINT)) for key, of in joint.items()}

    total: dict = {}
    for part in state.mapPartitions(sums, True).collect():
        for key, of in part.items():
            total[key] = total[key] + of if key in total else of
    return total


def _grow_round(state: RDD, layout: Layout, growths: dict[int, Growth], classes: int) -> None:
    """One round of every setting, level by level side by side."""
    most = max(1, PASS_BYTES // (layout.groups * JOINT * 16))
    for growth in growths.values():
        growth.begin()
    open_now = dict(growths)
    while open_now:
        wanted = [(s, i) for s, growth in open_now.items() for i in growth.own]
        for start in range(0, len(wanted), most):
            asked, places = [], {}
            for s, growth in open_now.items():
                own = np.array([i for t, i in wanted[start : start + most] if t == s], np.int64)
                trees = []
                for k in np.unique(growth.tree[own]).tolist():
                    places[s, k] = own[growth.tree[own] == k]
                    trees.append((k, growth.trees_now[k], growth.node[places[s, k]]))
                if trees:
                    asked.append((s, growth.level, trees))
            for (s, k), sums in _level_sums(state, layout, asked, classes).items():
                growths[s].receive(places[s, k], sums)
        for growth in open_now.values():
            growth.split()
        open_now = {s: growth for s, growth in open_now.items() if len(growth.tree)}


def _dealt(rows: DataFrame, cuts: list[np.ndarray], layout: Layout, total: int) -> RDD:
    """Binned rows as ``(codes, y)`` chunks, stored once and dealt evenly over the cores."""
    spark, width, groups = rows.sparkSession, len(cuts), layout.groups
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_ROWS))
    size = min(CHUNK_ROWS, max(1, total // (4 * parts)))

    def chunked(batches):
        def out(codes, y):
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["codes", "y"])

        codes, y = np.empty((groups, 0), np.uint8), np.empty(0, np.int32)
        for batch in batches:
            codes = np.concatenate([codes, layout.codes(_matrix(batch, width), cuts)], axis=1)
            y = np.concatenate([y, batch.column("y").to_numpy().astype(np.int32)])
            while len(y) >= size:
                yield out(codes[:, :size], y[:size])
                codes, y = codes[:, size:], y[size:]
        if len(y):
            yield out(codes, y)

    kept = stored(rows.select("x", "y").mapInArrow(chunked, "codes binary, y binary"), "binned").repartition(parts)
    return kept.rdd.map(lambda r: (np.frombuffer(r.codes, np.uint8).reshape(groups, -1), np.frombuffer(r.y, np.int32)))


def _drop(spark: SparkSession, checkpoint: str | None) -> None:
    """Delete a checkpoint that no later one is made from."""
    if checkpoint:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _grow_spread(rows: DataFrame, total: int, width: int, settings: list[dict], classes: int) -> list[pd.DataFrame]:
    """Like :func:`grow` for every setting, on any number of rows: all cores share every level's pass."""
    spark = rows.sparkSession
    cuts = cut_points_of(rows, width, total)
    layout = Layout(np.array([len(c) + 1 for c in cuts], np.int64))
    first = 1 if classes == 2 else 0
    growths = {
        s: Growth(np.empty(0), layout.sizes, classes - first, setting["depth"], setting["step"], rounds=setting["trees"])
        for s, setting in enumerate(settings)
    }
    nodes: list[list[tuple]] = [[] for _ in settings]
    rounds = max(growth.rounds for growth in growths.values())
    checkpoint, last = None, None

    def started(chunk):
        return (*chunk, [np.zeros((classes - first, len(chunk[1]))) for _ in settings])

    def moved(trees: dict[int, tuple[int, list[Tree]]]):
        def move(chunks):
            tables = {s: [(t.table(layout), np.array(t.value)) for t in of] for s, (_, of) in trees.items()}
            for codes, y, margins in chunks:
                margins = list(margins)
                for s, (steps, _) in trees.items():
                    added = [value.take(_walked(table, codes, steps)) for table, value in tables[s]]
                    margins[s] = margins[s] + np.stack(added)
                yield codes, y, margins

        return move

    shared_folder(spark)
    state = _dealt(rows, cuts, layout, total).map(started).persist(StorageLevel.MEMORY_AND_DISK)
    for number in range(rounds):
        now = {s: growth for s, growth in growths.items() if number < growth.rounds}
        _grow_round(state, layout, now, classes)
        if last is not None:
            last.unpersist()
        for s, growth in now.items():
            nodes[s] += growth.nodes(number, first, cuts)
        if number + 1 < rounds:
            trees = {s: (growth.steps, growth.trees_now) for s, growth in now.items()}
            last, state = state, state.mapPartitions(moved(trees), True).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
                state.count()
                _drop(spark, checkpoint)
                checkpoint = state.getCheckpointFile()
    state.unpersist()
    _drop(spark, checkpoint)
    return [_table(of) for of in nodes]


def fit_many(
    df: DataFrame, settings: dict[str, dict], features: str = "features", label: str = "label", classes: int | None = None,
    most: int = FIT_ROWS,
) -> dict[str, Boosted]:
    """One model per setting (``trees``, ``depth``, ``step``, ``seed``), fitted on all labelled rows.

    Up to ``most`` rows, each setting is fitted in a task of its own; more are spread over all cores.
    """
    rows = df.select(numbers(df, features).alias("x"), F.col(label).cast("int").alias("y")).where("y is not null")
    total, seen, width = rows.agg(F.count(F.lit(1)), F.max("y"), F.max(F.size("x"))).first()
    classes = classes or (0 if seen is None else seen + 1)
    names = list(settings)
    if total > most or total * (width or 1) > FIT_CELLS:
        grown = _grow_spread(rows, total, width, [settings[name] for name in names], classes)
        return {name: Boosted(classes, width, nodes) for name, nodes in zip(names, grown)}

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(group.x.to_list()).astype(np.float64)
        # the rows in an order of their own: sums do not depend on how they arrive
        y = group.y.to_numpy()
        order = np.lexsort([*x.T[::-1], y])
        return grow(x[order], y[order], classes, **settings[names[key[0]]]).assign(setting=key[0])

    each = rows.select(F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("setting"), "x", "y")
    fitted = each.repartition(len(names), "setting").groupBy("setting").applyInPandas(one, _TREE + ", setting int").toPandas()
    return {
        name: Boosted(classes, width or 0, fitted[fitted.setting == i].drop(columns="setting").reset_index(drop=True))
        for i, name in enumerate(names)
    }


def fit(
    df: DataFrame, features: str = "features", label: str = "label", trees: int = 200, depth: int = 6, step: float = 0.1,
    seed: int = 42, classes: int | None = None, most: int = FIT_ROWS,
) -> Boosted:
    setting = {"trees": trees, "depth": depth, "step": step, "seed": seed}
    return fit_many(df, {"one": setting}, features, label, classes, most)["one"]
