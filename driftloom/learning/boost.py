"""Second-order boosted trees: gradient and hessian histograms merged over partitions, regularised leaves, and a side for
missing values that each split learns.

Rows never leave the tasks: a task adds up its rows' histograms, Spark sums them by slot, and the driver, which gets nodes
* features * bins numbers however many rows there are, picks the splits. The same growing serves small tables inside one
task (fit_arrays), so many small fits can run side by side."""

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from driftloom.functions.storage import materialise

#: Trees after which the rows' margins are written, so that no pass evaluates more than that many.
KEEP = 8


@dataclass(frozen=True)
class BoostParams:
    """gamma: the least gain of a split; least_child: the least sum of hessians on each side; columns and subsample: shares
    of features and rows that a tree sees."""

    trees: int = 40
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    gamma: float = 0.0
    least_child: float = 1.0
    bins: int = 64
    columns: float = 1.0
    subsample: float = 1.0
    seed: int = 1


@dataclass
class Tree:
    """Nodes in level order, the children of k at 2 k + 1 and 2 k + 2. feature is -1 in leaves; a value in a bin at or
    under bin goes left, a missing one left where left is set."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, missing: int, depth: int) -> np.ndarray:
        """The node that each row (of bins) has reached."""
        at = np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            b = bins[rows, np.maximum(f, 0)]
            goes_left = np.where(b == missing, self.left[at], b <= self.bin[at])
            at = np.where(f >= 0, 2 * at + 2 - goes_left, at)
        return at


def find_splits(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, p: BoostParams) -> list[tuple[float, int, int, bool, float, float] | None]:
    """For each node the best (gain, feature, bin, missing left, left gradient, left hessian), None where no split gains.

    g, h: (nodes, features, bins + 1), the last bin of missing values; a cut past all others parts known from missing. Of equal gains the first feature, the lowest bin,
    then missing to the left."""
    total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    score = lambda a, b: a * a / (b + p.l2)
    out: list[tuple[float, int, int, bool, float, float] | None] = []
    for n in range(len(g)):
        best = None
        for missing_left in (True, False):
            gl = np.cumsum(g[n, :, :-1], axis=1) + (g[n, :, -1:] if missing_left else 0)
            hl = np.cumsum(h[n, :, :-1], axis=1) + (h[n, :, -1:] if missing_left else 0)
            gr, hr = total_g[n] - gl, total_h[n] - hl
            gain = (score(gl, hl) + score(gr, hr) - score(total_g[n], total_h[n])) / 2 - p.gamma
            gain = np.where((hl >= p.least_child) & (hr >= p.least_child) & allowed[:, None], gain, -np.inf)
            if gain.size and np.isfinite(top := gain.max()) and top > 1e-9:
                f, b = np.unravel_index(int(np.argmax(gain >= top - 1e-12)), gain.shape)  # the first of equals
                if best is None or gain[f, b] > best[0] + 1e-12 or (abs(gain[f, b] - best[0]) <= 1e-12 and (f, b) < best[1:3]):
                    best = (float(gain[f, b]), int(f), int(b), missing_left, float(gl[f, b]), float(hl[f, b]))
        out.append(best)
    return out


def grow(histogram: Callable[[Tree, list[int]], tuple[np.ndarray, np.ndarray]], width: int, p: BoostParams, rng: np.random.Generator) -> Tree:
    """A tree, level by level; histogram gives gradients and hessians of the nodes asked for."""
    tree, nodes = Tree.empty(p.depth), [0]
    allowed = np.zeros(width, bool)
    allowed[rng.permutation(width)[: max(1, round(p.columns * width))]] = True
    leaf = lambda g, h: -p.rate * g / (h + p.l2)
    for level in range(p.depth):
        g, h = histogram(tree, nodes)
        following = []
        if level == 0:
            tree.value[0] = leaf(g[0, 0].sum(), h[0, 0].sum()) if width else 0.0
        for k, node, split in zip(range(len(nodes)), nodes, find_splits(g, h, allowed, p)):
            if split is None:
                continue
            tree.gain[node], tree.feature[node], tree.bin[node], tree.left[node], gl, hl = split
            tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(gl, hl), leaf(g[k, 0].sum() - gl, h[k, 0].sum() - hl)
            following += [2 * node + 1, 2 * node + 2]
        if not (nodes := following):
            break
    return tree


@dataclass
class Boosted:
    """A fitted model: features, each one's bin edges, the first margin and the trees."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    params: BoostParams
    trees: list[Tree] = field(default_factory=list)

    @property
    def missing(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 1

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of values (n, features): how many edges lie below; NaN has one of its own."""
        out = np.empty(x.shape, np.int32)
        for k, e in enumerate(self.edges):
            out[:, k] = np.where(np.isnan(x[:, k]), self.missing, np.searchsorted(e, x[:, k], side="left"))
        return out

    def added(self, bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
        return sum((t.value[t.nodes(bins, self.missing, self.params.depth)] for t in trees), np.zeros(len(bins)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.added(self.binned(x), self.trees))))

    def score(self, df: DataFrame) -> DataFrame:
        """df with prob, its probability of 1."""
        own = [c for c in df.columns if c != "prob"]

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(self.predict(values(batch, names)))], [*own, "prob"])

        names = [f"_b{k}" for k in range(len(self.features))]
        sent = df.select(*own, *(F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(self.features, names)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in own)
        return sent.mapInArrow(run, f"{schema}, prob double")

    def to_json(self) -> str:
        trees = [{k: v.tolist() for k, v in asdict(t).items()} for t in self.trees]
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "base": self.base, "params": asdict(self.params), "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        d = json.loads(text)
        kinds = {"feature": int, "bin": int, "left": bool, "value": float, "gain": float}
        return cls(d["features"], [np.array(e, float) for e in d["edges"]], d["base"], BoostParams(**d["params"]), [Tree(**{k: np.array(v, kinds[k]) for k, v in t.items()}) for t in d["trees"]])


def values(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
    return np.stack(cols, axis=1) if cols else np.zeros((batch.num_rows, 0))


def slopes(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss."""
    q = 1 / (1 + np.exp(-margin))
    return w * (q - y), w * q * (1 - q)


def add_up(tree: Tree, nodes: Sequence[int], bins: np.ndarray, g: np.ndarray, h: np.ndarray, missing: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Histograms (nodes, features, bins + 1) of the rows that have reached the nodes."""
    width = bins.shape[1]
    place = np.full(len(tree.feature), -1)
    place[list(nodes)] = np.arange(len(nodes))
    at = place[tree.nodes(bins, missing, depth)]
    own = at >= 0
    slot = ((at[own, None] * width + np.arange(width)) * (missing + 1) + bins[own]).ravel()
    size = len(nodes) * width * (missing + 1)
    return tuple(np.bincount(slot, np.repeat(v[own], width), size).reshape(len(nodes), width, missing + 1) for v in (g, h))


def seen_rows(ids: np.ndarray, turn: int, p: BoostParams) -> np.ndarray:
    """Which rows a tree sees, by a hash of their number."""
    x = (ids.astype(np.uint64) + np.uint64(p.seed * 1_000_003 + turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < p.subsample


def first_margin(ones: float, total: float) -> float:
    share = min(max(ones / total, 1e-6), 1 - 1e-6) if total else 0.5
    return float(np.log(share / (1 - share)))


def pick_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Values that split a column into at most bins parts of like size: all but the largest where there are few."""
    v = np.sort(x[~np.isnan(x)])
    return np.unique(v[[int(np.ceil(k * len(v) / bins)) - 1 for k in range(1, bins)]]) if len(np.unique(v)) > bins else np.unique(v)[:-1]


def fit_arrays(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: BoostParams = BoostParams(), features: Sequence[str] = ()) -> Boosted:
    """A model of rows in memory."""
    model = Boosted(list(features) or [f"x{k}" for k in range(x.shape[1])], [pick_edges(x[:, k], p.bins) for k in range(x.shape[1])], first_margin(float((w * y).sum()), float(w.sum())), p)
    bins, margin, rng = model.binned(x), np.full(len(x), model.base), np.random.default_rng(p.seed)
    for turn in range(p.trees):
        g, h = slopes(margin, y, w * seen_rows(np.arange(len(x)), turn, p) if p.subsample < 1 else w)
        tree = grow(lambda t, nodes: add_up(t, nodes, bins, g, h, model.missing, p.depth), x.shape[1], p, rng)
        model.trees.append(tree)
        margin += model.added(bins, [tree])
    return model


def column_edges(rows: DataFrame, names: Sequence[str], bins: int, *more: Column) -> tuple[Row, list[np.ndarray]]:
    """One row of aggregates, more of them and what is needed here, and each column's bin edges: each value but the largest of
    a column of at most bins different ones, of any other approximate quantiles. Missing values are null."""
    shares = [k / bins for k in range(1, bins)]
    stats = rows.agg(*more, *(F.percentile_approx(n, shares, 100 * bins).alias(f"q{n}") for n in names), *(F.array_sort(F.slice(F.collect_set(F.when(F.col(n).isNotNull(), F.xxhash64(n) % (4 * bins))), 1, bins + 1)).alias(f"d{n}") for n in names)).first()
    few = [n for n in names if len(stats[f"d{n}"]) <= bins]  # by their hashes, of which a column has few at most: perhaps few values
    listed = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in few))).alias("c")).filter("c.v IS NOT NULL").select("c.*").distinct() if few else None
    found: dict[str, list[float]] = {n: [] for n in few}
    if listed is not None:
        counts = {r["n"]: r["count"] for r in listed.groupBy("n").count().collect()}
        few = [n for n in few if counts.get(n, 0) <= bins]
        for r in listed.filter(F.col("n").isin(few)).collect() if few else []:  # at most bins of each
            found[r["n"]].append(r["v"])
    return stats, [np.array(sorted(found[n])[:-1] if n in few else sorted(set(stats[f"q{n}"] or [])), float) for n in names]


def fit_boosted(df: DataFrame, features: Sequence[str], p: BoostParams = BoostParams(), y: str = "y", weight: str | None = None) -> Boosted:
    """A model of any number of rows. Missing features are null or NaN; rows without a label are left out.

    A level of a tree is one pass over the rows. A column of at most bins different values has an edge at each but the
    largest, any other at its approximate quantiles."""
    names = [f"_b{k}" for k in range(len(features))]
    cast = [F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")).alias(n) for f, n in zip(features, names)]
    rows = df.filter(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *cast)
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")
    stats, edges = column_edges(rows, names, p.bins, F.sum(F.col("_y") * F.col("_w")).alias("ones"), F.sum("_w").alias("all"))
    model = Boosted(list(features), edges, first_margin(stats["ones"] or 0.0, stats["all"] or 0.0), p)
    if not stats["all"]:
        return model
    width, missing, rng = len(names), model.missing, np.random.default_rng(p.seed)
    held, fresh = materialise(rows.withColumn("_m", F.lit(model.base)), "margins"), 0

    def parts(batches):
        for batch in batches:
            if batch.num_rows:
                y_, w_, m, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_m", "_id"))
                yield batch, model.binned(values(batch, names)), y_, w_, m, ids

    for turn in range(p.trees):

        def histogram(tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
            latest = model.trees[len(model.trees) - fresh :]
            depth, size = p.depth, len(nodes) * width * (missing + 1)

            def run(batches):
                total = np.zeros((2, size))
                for _, bins, y_, w_, m, ids in parts(batches):
                    g, h = slopes(m + model.added(bins, latest), y_, w_ * seen_rows(ids, turn, p) if p.subsample < 1 else w_)
                    for k, v in enumerate(add_up(tree, nodes, bins, g, h, missing, depth)):
                        total[k] += v.ravel()
                some = np.flatnonzero(total.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["slot", "g", "h"])

            got = held.mapInArrow(run, "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # nodes * features * bins rows at most
            out = np.zeros((2, size))
            out[:, got["slot"].to_numpy(int)] = got[["g", "h"]].to_numpy().T
            return tuple(v.reshape(len(nodes), width, missing + 1) for v in out)

        model.trees.append(grow(histogram, width, p, rng))
        fresh += 1
        if fresh == KEEP and turn + 1 < p.trees:
            latest = model.trees[-fresh:]

            def advance(batches):
                for batch, bins, _, _, m, _ in parts(batches):
                    yield batch.set_column(batch.schema.get_field_index("_m"), "_m", pa.array(m + model.added(bins, latest)))

            held, fresh = materialise(held.mapInArrow(advance, held.schema), "margins"), 0
    return model
