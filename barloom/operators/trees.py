"""Tree models of all series at once, grown level by level from histograms.

Rows are packed once: one row per series and ``PACK`` bars, with the bins of all features as bytes. A level is one job for every series, tree and node
together: packs meet the trees of their series, tasks add up sums and counts per (series, tree, node, feature, bin), and what is left
after the shuffle is one small matrix per node, from which the best split is read. No series has a task of its own, and rows are neither
shuffled nor written again while trees grow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.operators.aggregate import exact_quantiles
from barloom.operators.blocks import Grid, row_numbers
from barloom.session import stage

PACK = 1024
POINTS = 64  # quantiles of a pack that stand for it when bins are cut
HELD = 64 << 20  # bytes of histograms a task holds before it gives them up
ALL = "_all"  # key of a model of all series
NODE = np.dtype([("feature", np.int32), ("bin", np.int32), ("value", np.float64), ("open", np.int8)])


@dataclass(frozen=True)
class Trees:
    """Fitted trees: ``model`` holds one row per key (``cuts``, ``nodes``)."""

    model: DataFrame
    keys: tuple[str, ...]
    features: tuple[str, ...]
    trees: int
    depth: int
    boosted: bool
    rate: float


def hashed(seed: int, *parts) -> np.ndarray:
    """Uniform draws in [0, 1) that depend on ``seed`` and the numbers only, so that every run and every recomputed task has the same."""
    h = np.uint64(seed * 2 + 1)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def bag_weights(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a row is drawn into the sample of a tree: Poisson with mean 1."""
    u = hashed(seed, tree, rows)
    limits = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))
    return np.searchsorted(limits, u, "right").astype(float)


def tried(seed: int, tree: int, node: int, features: int) -> np.ndarray:
    """Features a node of a forest may split on: a third of them, at least one."""
    u = hashed(seed, tree, node, np.arange(features))
    return np.sort(np.argsort(u, kind="stable")[:max(1, features // 3)])


def _matrix(values: list, features: int) -> np.ndarray:
    return np.array(values, float).reshape(-1, features)


def pack(df: DataFrame, g: Grid, keys: Sequence[str], features: Sequence[str], target: str, size: int = PACK) -> DataFrame:
    """(model keys, pack, row, y, x): at most ``size`` bars of one series with their features; ``row`` numbers stand for the bars in draws."""
    x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(float("nan"))) for f in features])
    rows = row_numbers(df.where(F.col(target).isNotNull()), g, "_rn")
    tag = F.xxhash64(*g.keys)
    rows = rows.select(*g.keys, F.floor(F.col("_rn") / size).alias("_blk"), F.xxhash64(tag, "_rn").alias("_row"), F.col(target).cast("double").alias("_y"), x.alias("_x"))
    packed = rows.groupBy(*g.keys, "_blk").agg(F.array_sort(F.collect_list(F.struct("_row", "_y", "_x"))).alias("_r"))
    return packed.withColumn(ALL, F.lit(1)).select(*keys, F.col("_r._row").alias("row"), F.col("_r._y").alias("y"), F.flatten("_r._x").alias("x"))


def bin_cuts(packs: DataFrame, keys: Sequence[str], features: int, bins: int) -> DataFrame:
    """(keys, cuts): per feature ``bins - 1`` quantiles, exact over ``POINTS`` order statistics of each pack; features that are missing everywhere have none."""
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = _matrix(batch.column("x")[i].as_py(), features)
                at, value = [], []
                for f in range(features):
                    v = np.sort(m[:, f][np.isfinite(m[:, f])])
                    if len(v) > POINTS:
                        v = v[np.linspace(0, len(v) - 1, POINTS).round().astype(int)]
                    at += [f] * len(v)
                    value += v.tolist()
                take = pa.array([i] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], pa.array(at, pa.int32()), pa.array(value, pa.float64())], [*keys, "f", "v"])

    types = "".join(f"`{k}` {packs.schema[k].dataType.simpleString()}, " for k in keys)
    long = stage(packs.select(*keys, "x").mapInArrow(points, types + "f int, v double"), "points")
    cuts = exact_quantiles(long, [*keys, "f"], "v", [i / bins for i in range(1, bins)])
    listed = cuts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", F.array_distinct("quantiles").alias("q")))).alias("_m"))
    none = F.array().cast("array<double>")
    return listed.select(*keys, F.array(*[F.coalesce(F.col("_m")[i], none) for i in range(features)]).alias("cuts"))


def bins_of(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin of every value; what is missing stands in the first one."""
    out = np.zeros(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        v = x[:, f]
        out[:, f] = np.where(np.isfinite(v), np.searchsorted(c, v, "left"), 0)
    return out


def walk(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Node (1 is the root, 2 n and 2 n + 1 are the children of n) every row ends in, in one tree."""
    at = np.ones(len(bins), np.int64)
    while True:
        f = nodes["feature"][at]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return at
        right = bins[go, f[go]] > nodes["bin"][at[go]]
        at[go] = 2 * at[go] + right


def predict(nodes: np.ndarray, bins: np.ndarray, boosted: bool, rate: float, base: float = 0.0) -> np.ndarray:
    """Mean of the trees, or ``base`` and the sum of the steps of boosted ones. ``nodes``: trees x nodes."""
    if boosted:
        out = np.full(len(bins), base)
        for t in nodes:
            out += rate * t["value"][walk(t, bins)]
        return out
    return np.mean([t["value"][walk(t, bins)] for t in nodes], axis=0)


def best_split(total: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[int, int, float] | None:
    """(feature, bin, gain) of the split of a node with the greatest gain; the first feature and bin on ties. Matrices are features x bins."""
    s, n = np.cumsum(total, axis=1), np.cumsum(count, axis=1)
    every, rows = s[:, -1:], n[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / n + (every - s) ** 2 / (rows - n) - every * every / rows
    gain = np.where((n > 0) & (rows - n > 0), gain, -np.inf)
    gain = np.round(gain, 10)[allowed, :-1]
    if not gain.size or not gain.max() > 1e-9:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(allowed[f]), int(b), float(gain[f, b])


def _histograms(met: DataFrame, keys: Sequence[str], spec: dict) -> DataFrame:
    """Packs with their trees to (keys, tree, node, total, count): one matrix per open node and task."""
    width = spec["features"] * spec["bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def given() -> pa.RecordBatch:
            out = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([
                *[pa.array([o[0][j].as_py() for o in out], types[j]) for j in range(len(keys))], pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()),
                pa.array([o[3].tobytes() for o in out], pa.binary()), pa.array([o[4].tobytes() for o in out], pa.binary())], [*keys, "tree", "node", "total", "count"])

        types: list = []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for i in range(batch.num_rows):
                key = [batch.column(k)[i] for k in keys]
                y, rows = np.array(batch.column("y")[i].as_py(), float), np.array(batch.column("row")[i].as_py(), np.int64)
                bins = np.frombuffer(batch.column("bins")[i].as_py(), np.uint8).reshape(-1, spec["features"])
                nodes = np.frombuffer(batch.column("nodes")[i].as_py(), NODE).reshape(spec["trees"], -1)
                base = batch.column("base")[i].as_py()
                cell = bins + np.arange(spec["features"]) * spec["bins"]
                for t in spec["grow"]:
                    if not (nodes[t]["open"] > 0).any():
                        continue
                    if spec["boosted"]:
                        aim, weight = y - predict(nodes[:t], bins, True, spec["rate"], base), np.ones(len(y))
                    else:
                        aim, weight = y, bag_weights(spec["seed"], t, rows.view(np.uint64))
                    at = walk(nodes[t], bins)
                    for node in np.unique(at[nodes[t]["open"][at] > 0]):
                        own = np.flatnonzero((at == node) & (weight > 0))
                        if not len(own):
                            continue
                        where, w = cell[own].reshape(-1), np.repeat(weight[own], spec["features"])
                        total = np.bincount(where, w * np.repeat(aim[own], spec["features"]), width)
                        count = np.bincount(where, w, width)
                        name = (*[k.as_py() for k in key], t, int(node))
                        if name in held:
                            held[name][3] += total
                            held[name][4] += count
                        else:
                            held[name] = [key, t, int(node), total, count]
                        if len(held) * width * 16 > HELD:
                            yield given()
        if held:
            yield given()

    types = "".join(f"`{k}` {met.schema[k].dataType.simpleString()}, " for k in keys)
    return met.mapInArrow(run, types + "tree int, node int, total binary, count binary")


def _splits(hists: DataFrame, keys: Sequence[str], spec: dict) -> DataFrame:
    """(keys, tree, node, feature, bin, left, right, more): the split of each open node, -1 where it stays a leaf, and the means of the children."""
    by = [*keys, "tree", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, count, first = None, None, None, None
        out: list[tuple] = []

        def close() -> None:
            t, node = now[-2:]
            every = np.arange(spec["features"])
            a, b = total.reshape(spec["features"], -1), count.reshape(spec["features"], -1)
            found = best_split(a, b, every if spec["boosted"] else tried(spec["seed"], t, node, spec["features"]))
            mean = a[0].sum() / b[0].sum()
            if found is None:
                out.append((*now, -1, 0, mean, mean, mean))
            else:
                f, c, _ = found
                lo, n = a[f, :c + 1].sum(), b[f, :c + 1].sum()
                out.append((*now, f, c, mean, lo / n, (a[f].sum() - lo) / (b[f].sum() - n)))

        types: list = []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            names = list(zip(*[batch.column(c).to_pylist() for c in by]))
            for i, name in enumerate(names):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in ("total", "count"))
                if name == now:
                    total, count = total + a, count + b
                    continue
                if now is not None:
                    close()
                now, total, count = name, a, b
        if now is not None:
            close()
            fields = [*types, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(fields)], [*by, "feature", "bin", "mean", "left", "right"])

    types = "".join(f"`{k}` {hists.schema[k].dataType.simpleString()}, " for k in keys)
    ordered = hists.repartition(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, types + "tree int, node int, feature int, bin int, mean double, left double, right double")


def _grown(model: DataFrame, splits: DataFrame, keys: Sequence[str], spec: dict, last: bool) -> DataFrame:
    """The trees with the nodes of one more level."""
    found = splits.groupBy(*keys).agg(F.collect_list(F.struct("tree", "node", "feature", "bin", "mean", "left", "right")).alias("_new"))
    both = model.join(found, list(keys), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, new in zip(batch.column("nodes").to_pylist(), batch.column("_new").to_pylist()):
                nodes = np.frombuffer(blob, NODE).reshape(spec["trees"], -1).copy()
                for s in new or []:
                    t, n = s["tree"], s["node"]
                    nodes[t][n] = (s["feature"], s["bin"], s["mean"], 0)
                    if s["feature"] >= 0:
                        for child, value in ((2 * n, s["left"]), (2 * n + 1, s["right"])):
                            nodes[t][child] = (-1, 0, value, 0 if last else 1)
                out.append(nodes.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, "nodes"])

    kept = [*keys, "cuts", "base"]
    types = ", ".join(f"`{c}` {model.schema[c].dataType.simpleString()}" for c in kept)
    return both.select(*kept, "nodes", "_new").mapInArrow(run, types + ", nodes binary")


def fit_trees(
    train: DataFrame, g: Grid, features: Sequence[str], target: str, by: Sequence[str] = (), algorithm: str = "random_forest",
    trees: int | None = None, depth: int | None = None, bins: int = 32, rate: float = 0.1, seed: int = 7,
) -> Trees:
    """Forests (20 trees of depth 5) or boosted trees (20 steps of depth 3): a model for each value of ``by`` (keys of ``g``), or one for all rows.

    A forest draws rows and tries a third of the features at every node; both are hashes of numbers, so the same rows give the same trees. All
    trees of a forest grow together, ``depth`` jobs in all; boosted trees need one such round each. A value that is null or not finite stands in the lowest bin.
    """
    if algorithm not in ("random_forest", "boosted_trees"):
        raise ValueError(f"unknown algorithm {algorithm}")
    if not 2 <= bins <= 256:
        raise ValueError("bins: a bin is a byte")
    boosted = algorithm == "boosted_trees"
    trees, depth = trees or 20, depth or (3 if boosted else 5)
    keys = list(by) or [ALL]
    n = len(features)
    raw = stage(pack(train, g, keys, features, target), "packs")
    cuts = stage(bin_cuts(raw, keys, n, bins), "cuts")
    means = raw.select(*keys, F.explode("y").alias("_y")).groupBy(*keys).agg(F.avg("_y").alias("base"))
    empty = np.zeros((trees, 2 << depth), NODE)
    empty["feature"] = -1
    if not boosted:
        empty["open"][:, 1] = 1
    model = stage(means.join(cuts, keys).select(*keys, "cuts", "base", F.lit(empty.tobytes()).alias("nodes")), "trees")
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bins_of(_matrix(x, n), c).tobytes() for x, c in zip(batch.column("x").to_pylist(), batch.column("cuts").to_pylist())]
            kept = [*keys, "row", "y"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.binary())], [*kept, "bins"])

    types = "".join(f"`{k}` {raw.schema[k].dataType.simpleString()}, " for k in keys)
    packs = stage(raw.join(cuts, keys).select(*keys, "row", "y", "x", "cuts").mapInArrow(binned, types + "row array<long>, y array<double>, bins binary"), "binned")
    for grow in ([[t] for t in range(trees)] if boosted else [list(range(trees))]):
        if boosted:
            model = stage(_opened(model, keys, grow[0], trees), "trees")
        for level in range(depth):
            spec = {"features": n, "bins": bins, "trees": trees, "grow": grow, "boosted": boosted, "rate": rate, "seed": seed}
            met = packs.join(model.select(*keys, "base", "nodes"), keys)
            model = stage(_grown(model, _splits(_histograms(met, keys, spec), keys, spec), keys, spec, level == depth - 1), "trees")
    return Trees(model, tuple(keys), tuple(features), trees, depth, boosted, rate)


def _opened(model: DataFrame, keys: Sequence[str], tree: int, trees: int) -> DataFrame:
    """The root of one more boosted tree."""
    kept = [*keys, "cuts", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("nodes").to_pylist():
                nodes = np.frombuffer(blob, NODE).reshape(trees, -1).copy()
                nodes["open"][tree, 1] = 1
                out.append(nodes.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, "nodes"])

    types = ", ".join(f"`{c}` {model.schema[c].dataType.simpleString()}" for c in kept)
    return model.select(*kept, "nodes").mapInArrow(run, types + ", nodes binary")


def tree_forecast(fitted: Trees, rows: DataFrame, g: Grid, name: str = "forecast", size: int = PACK) -> DataFrame:
    """Rows with their forecast, null where a series has no model. Rows are packed by series and time, so trees travel once per pack."""
    n, keys = len(fitted.features), list(fitted.keys)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in fitted.features])
    numbered = row_numbers(rows, g, "_rn").withColumn("_blk", F.floor(F.col("_rn") / size))
    packs = numbered.groupBy(*g.keys, "_blk").agg(F.collect_list(F.struct(F.struct(*rows.columns).alias("r"), x.alias("x"))).alias("_p"))
    met = packs.withColumn(ALL, F.lit(1)).join(fitted.model, keys, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed = batch.column("_p")[i].values
                inner = listed.field("r")
                m = _matrix(pa.chunked_array([listed.field("x")]).combine_chunks().to_pylist(), n)
                blob = batch.column("nodes")[i].as_py()
                if blob is None:
                    made = pa.nulls(len(m), pa.float64())
                else:
                    nodes = np.frombuffer(blob, NODE).reshape(fitted_trees, -1)
                    made = pa.array(predict(nodes, bins_of(m, batch.column("cuts")[i].as_py()), boosted, rate, batch.column("base")[i].as_py()))
                yield pa.RecordBatch.from_arrays([*[inner.field(j) for j in range(inner.type.num_fields)], made], [*columns, name])

    fitted_trees, boosted, rate, columns = fitted.trees, fitted.boosted, fitted.rate, rows.columns
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return met.select("_p", "cuts", "base", "nodes").mapInArrow(run, f"{types}, `{name}` double")
