"""Boosted trees for the absolute error, with the search of their parameters (M7).

Trees come one by one and start from persistence: round k fits a tree to the signs of what is left, its leaves get the
median of what is left in them, and a share of that (the rate) is added. Rounds go on until PATIENCE of them bring the
validation part nothing; the best round is kept. Values are cut into at most BINS quantile bins of each feature; missing
ones have a bin of their own, and each split sends them to the side where they gain more.

`fit` grows a tree level by level: rows lie in blocks of columns in a staged table; tasks add up histograms of their
blocks by node, a node's histograms meet in one task which picks its best split, and only the splits (a row a node) reach
the driver. So it learns from all rows, and what moves doesn't grow with them.

`search` tries points of PARAMS on all rows of both parts: the first RANDOM points are drawn at random, the others by Parzen
estimators of good and bad points. Points of a batch are tried at the same time: up to TRIAL_ROWS rows by one task each,
to which the rows are broadcast; of more rows side by side over their blocks, where one pass serves a level of all their trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from .features import FEATURES, TARGET, split_hours

# The parameters with their ranges, which results are compared by, and the rounds.
PARAMS = {"learning_rate": (0.02, 0.2, "log"), "num_leaves": (15, 127, "int"), "min_child_samples": (10, 200, "int"), "feature_fraction": (0.6, 1.0, "line"), "bagging_fraction": (0.6, 1.0, "line"), "lambda_l2": (1e-3, 10.0, "log")}
ROUNDS, PATIENCE, TRIALS, SEED = 600, 30, 15, 42

BINS = 63
#: Trials drawn at random, candidates of each later draw, and trials of a batch.
RANDOM, CANDIDATES, BATCH = 10, 24, 5
#: Rows (17 bytes and a number each) that one task learns from in a trial, and as many that it is judged by. More are learned from over their blocks.
TRIAL_ROWS = 1_000_000
BLOCK_ROWS = 20_000
#: Rows that are counted at one time.
CHUNK = 50_000
#: Rows that are learned from as one block.
ONE_BLOCK = 200_000
DEPTH = 10
#: What is left is counted in this many steps to each side of 0, so that a median of 0 is exactly 0.
STEPS = 512
#: Trees after which a staged table holds the sums so far.
FOLD_IN = 10
#: Nodes whose arrays (17 KB each) are added up in one task.
NODES = 32
BASE = "velos_t0"


@dataclass
class Tree:
    """Splits by node (2k+1 and 2k+2 are below k): feature, last bin to the left, whether missing values go left; and leaves' values."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def parts(self, bins: np.ndarray, held: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """The rows of each leaf. held: those of the tree when it had fewer splits."""
        told = {0: np.arange(len(bins))} if held is None else dict(held)
        for node in sorted(self.splits):  # a node comes before those below it
            if (rows := told.pop(node, None)) is not None:
                feature, last, missing_left = self.splits[node]
                b = bins[rows, feature]
                left = (b <= last) if missing_left else (b <= last) & (b > 0)
                told[2 * node + 1], told[2 * node + 2] = rows[left], rows[~left]
        return told

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        return _at(self.parts(bins), len(bins))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        if any(self.values.values()):
            for node, rows in self.parts(bins).items():
                out[rows] = self.values.get(node, 0.0)
        return out


def _at(parts: dict[int, np.ndarray], n: int) -> np.ndarray:
    at = np.zeros(n, np.int64)
    for node, rows in parts.items():
        at[rows] = node
    return at


def _plain(tree: Tree) -> dict:
    return {"splits": [[k, *v] for k, v in tree.splits.items()], "values": [[k, v] for k, v in tree.values.items()]}


@dataclass
class Forest:
    """A model: bin edges of each feature and trees. `transform` adds `prediction` to rows with FEATURES."""

    edges: list[list[float]]
    trees: list[Tree]
    takes_nulls = True

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """0 for missing values, else 1 and the number of edges up to the value."""
        told = [np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(e), x, "right")) for x, e in zip(columns, self.edges)]
        return np.column_stack(told).astype(np.uint8)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))

    def transform(self, df: DataFrame) -> DataFrame:
        at = FEATURES.index(BASE)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))]
                rest = [batch.column(k) for k in range(len(FEATURES), batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(columns[at] + self.margin(self.bins(columns)))], names)

        told = [f.name for f in df.schema]
        names = [f"c{k}" for k in range(len(told))] + ["prediction"]
        given = df.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(FEATURES)], *[F.col(c).alias(f"c{k}") for k, c in enumerate(told)])
        schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(df.schema)] + ["prediction double"])
        return given.mapInArrow(run, schema).toDF(*told, "prediction")

    def text(self) -> str:
        return json.dumps({"edges": self.edges, "trees": list(map(_plain, self.trees))})

    @classmethod
    def of(cls, text: str) -> Forest:
        told = json.loads(text)
        return cls(told["edges"], [Tree({k: (f, b, m) for k, f, b, m in t["splits"]}, {k: v for k, v in t["values"]}) for t in told["trees"]])

    def importance(self) -> list[tuple[str, float]]:
        """Shares of the splits."""
        used = np.bincount([f for t in self.trees for f, _, _ in t.splits.values()], minlength=len(FEATURES))
        return sorted(zip(FEATURES, (used / max(1, used.sum())).tolist()), key=lambda x: -x[1])


def bin_edges(rows: DataFrame) -> list[list[float]]:
    """Inner quantiles of each feature, each once: at most BINS - 1 numbers a feature."""
    told = rows.approxQuantile(list(FEATURES), [k / BINS for k in range(1, BINS)], 0.001)
    return [sorted(set(e)) for e in told]


# -- one block of rows


def histograms(bins: np.ndarray, at: np.ndarray, sign: np.ndarray, nodes: list[int], features: np.ndarray | None = None) -> np.ndarray:
    """For each of `nodes`, feature and bin: the sum of signs (-1, 0 or 1) and the number of rows. features: other ones stay 0."""
    place = np.full(int(at.max(initial=0)) + 1, -1, np.int64)
    place[[n for n in nodes if n < len(place)]] = [k for k, n in enumerate(nodes) if n < len(place)]
    rows, cells = np.flatnonzero(place[at] >= 0), 3 * (BINS + 1)  # a cell for each sign, so that one count tells both
    out = np.zeros((len(nodes), bins.shape[1], BINS + 1, 2), np.int64)
    for some in np.split(rows, range(CHUNK, len(rows), CHUNK)):
        own, base = bins[some].T.copy(), place[at[some]] * cells + sign[some].astype(np.int64) + 1
        for f in range(bins.shape[1]) if features is None else features:
            told = np.bincount(base + np.multiply(own[f], 3, dtype=np.int64), minlength=len(nodes) * cells).reshape(len(nodes), BINS + 1, 3)
            out[:, f, :, 0] += told[..., 2] - told[..., 0]
            out[:, f, :, 1] += told.sum(axis=-1)
    return out


def best_split(told: np.ndarray, least: int, l2: float, features: np.ndarray) -> tuple[float, int, int, bool]:
    """Gain, feature, last bin to the left, missing to the left: of the best split of a node (gain 0: none)."""
    best = (1e-9, -1, 0, False)
    told = told.astype(float)
    whole = told[features[0]].sum(axis=0)
    score = lambda g, n: g * g / (n + l2)
    for f in features:
        left, missing = np.cumsum(told[f, 1:], axis=0)[:-1], told[f, 0]
        for missing_left in (True, False) if missing[1] else (False,):
            a = left + missing if missing_left else left
            b = whole - a
            gain = np.where((a[:, 1] >= least) & (b[:, 1] >= least), score(a[:, 0], a[:, 1]) + score(b[:, 0], b[:, 1]) - score(*whole), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k + 1, missing_left)
    return best if best[1] >= 0 else (0.0, -1, 0, False)


def medians(at: np.ndarray, left: np.ndarray, nodes: list[int], width: float) -> np.ndarray:
    """How often each step of what is left is there, by leaf."""
    place = np.zeros(int(max(nodes)) + 1, np.int64)
    place[nodes] = np.arange(len(nodes))
    step = np.clip(np.rint(left / width), -STEPS, STEPS).astype(np.int64) + STEPS
    return np.bincount(place[at] * (2 * STEPS + 1) + step, minlength=len(nodes) * (2 * STEPS + 1)).reshape(len(nodes), -1)


def median_of(counts: np.ndarray, width: float) -> float:
    n = counts.sum()
    return float((np.searchsorted(np.cumsum(counts), (n + 1) // 2) - STEPS) * width) if n else 0.0


def in_bag(n: int, fraction: float, number: int, block: int) -> np.ndarray:
    """Which rows of a block a round learns from."""
    return np.random.default_rng((SEED, number, block)).random(n) < fraction


#: What a tree asks for: itself so far, nodes, and the features of their best splits, or None for the nodes' medians. It is told these by node.
Asked = tuple[Tree, list[int], np.ndarray | None]


def growing(point: dict, number: int) -> Generator[Asked, dict[int, tuple] | dict[int, float], Tree]:
    """A tree of at most num_leaves leaves, level by level, the splits that gain most first."""
    r = np.random.default_rng((SEED, number))
    features = np.sort(r.permutation(len(FEATURES))[: max(1, round(point["feature_fraction"] * len(FEATURES)))])
    tree, open_nodes, leaves = Tree(), [0], 1
    for _ in range(DEPTH):
        told = yield tree, open_nodes, features
        told = {n: s for n, s in told.items() if s[0] > 0}
        chosen = sorted(told, key=lambda n: (-told[n][0], n))[: point["num_leaves"] - leaves]
        if not chosen:
            break
        tree.splits |= {n: told[n][1:] for n in chosen}
        leaves += len(chosen)
        open_nodes = [c for n in sorted(chosen) for c in (2 * n + 1, 2 * n + 2)]
    told = yield tree, leaves_of(tree), None
    tree.values = {n: point["learning_rate"] * v for n, v in sorted(told.items())}
    return tree


def side_by_side(trees: dict[int, Generator], answers: Callable[[dict[int, Asked]], dict[int, dict]]) -> dict[int, Tree]:
    """The trees of several models, grown at the same time. answers: what each is told, by model and node."""
    asked, out = {m: next(g) for m, g in trees.items()}, {}
    while asked:
        told, after = answers(asked), {}
        for m in asked:
            try:
                after[m] = trees[m].send(told.get(m, {}))
            except StopIteration as end:
                out[m] = end.value
        asked = after
    return out


def leaves_of(tree: Tree) -> list[int]:
    return sorted({c for n in tree.splits for c in (2 * n + 1, 2 * n + 2)} - set(tree.splits)) or [0]


# -- a trial in one task


def rounds_of(point: dict, bins: np.ndarray, left: np.ndarray, width: float) -> Iterator[Tree]:
    """One tree after the other, from rows in memory."""
    left = left.copy()
    for number in range(ROUNDS):
        bag = in_bag(len(bins), point["bagging_fraction"], number, 0)
        own, sign, rest, parts = bins[bag], np.sign(left[bag]), left[bag], None

        def answers(asked: dict[int, Asked]) -> dict[int, dict]:
            nonlocal parts
            tree, nodes, features = asked[0]
            parts = tree.parts(own, parts)
            if features is None:
                return {0: dict(zip(nodes, (median_of(c, width) for c in medians(_at(parts, len(own)), rest, nodes, width))))}
            told = histograms(own, _at(parts, len(own)), sign, nodes, features)
            return {0: {n: best_split(told[k], point["min_child_samples"], point["lambda_l2"], features) for k, n in enumerate(nodes)}}

        tree = side_by_side({0: growing(point, number)}, answers)[0]
        left -= tree.predict(bins)
        yield tree


def trial(point: dict, learn: tuple, valid: tuple, width: float) -> tuple[int, float]:
    """Rounds up to the best one and its error. learn, valid: bins and what persistence leaves."""
    bins, left = valid[0], valid[1].copy()
    best = (0, float(np.abs(left).mean()))
    for number, tree in enumerate(rounds_of(point, *learn, width)):
        left -= tree.predict(bins)
        if (error := float(np.abs(left).mean())) < best[1]:
            best = (number + 1, error)
        if number + 1 - best[0] >= PATIENCE:
            break
    return best


class Sampler:
    """Points of PARAMS: RANDOM at random, then each parameter by the ratio of two Parzen estimators, of the best tenth of the trials and of the others."""

    def __init__(self, seed: int = SEED):
        self.random, self.told = np.random.default_rng(seed), []

    def _unit(self, name: str, value: float) -> float:
        low, high, kind = PARAMS[name]
        return math.log(value / low) / math.log(high / low) if kind == "log" else (value - low) / (high - low)

    def _value(self, name: str, u: float) -> float | int:
        low, high, kind = PARAMS[name]
        value = low * (high / low) ** u if kind == "log" else low + (high - low) * u
        return round(value) if kind == "int" else float(value)

    @staticmethod
    def _density(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        """A wide prior and a bell on each center, as wide as the gaps are."""
        centers, width = np.append(centers, 0.5), np.append(np.full(len(centers), max(0.05, 1 / (1 + len(centers)))), 1.0)
        return np.exp(-0.5 * ((x[:, None] - centers) / width) ** 2).__truediv__(width).mean(axis=1)

    def ask(self) -> dict[str, float | int]:
        if len(self.told) < RANDOM:
            return {n: self._value(n, self.random.random()) for n in PARAMS}
        ranked = sorted(self.told, key=lambda x: x[1])
        good, bad = ranked[: (k := max(1, math.ceil(0.1 * len(ranked))))], ranked[k:]
        out = {}
        for name in PARAMS:
            a, b = (np.array([self._unit(name, p[name]) for p, _ in own]) for own in (good, bad))
            centers = np.append(a, 0.5)[self.random.integers(len(a) + 1, size=CANDIDATES)]
            x = np.clip(centers + self.random.normal(0, max(0.05, 1 / (1 + len(a))), CANDIDATES), 0, 1)
            out[name] = self._value(name, x[np.argmax(np.log(self._density(x, a)) - np.log(self._density(x, b)))])
        return out

    def tell(self, point: dict, error: float) -> None:
        self.told.append((point, error))


def _arrays(rows: DataFrame, edges: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and what persistence leaves, of a bounded number of rows."""
    told = [(b, r) for _, b, r in _of([_blocks(rows, edges, BLOCK_ROWS).toArrow()])]
    return np.concatenate([np.zeros((0, len(FEATURES)), np.uint8), *(b for b, _ in told)]), np.concatenate([np.zeros(0), *(r for _, r in told)])


def search(inner: DataFrame, valid: DataFrame, edges: list[list[float]], trials: int = TRIALS, seed: int = SEED, sizes: tuple[int, int] | None = None) -> list[tuple[dict, int, float]]:
    """Each trial's point, best round and error on `valid`, in order; all rows of both parts count. sizes: their rows, where they are known."""
    spark, sampler, out = inner.sparkSession, Sampler(seed), []
    tried = _in_tasks if max(sizes or (inner.count(), valid.count())) <= TRIAL_ROWS else _over_blocks
    run = tried(spark, inner, valid, edges)
    while len(out) < trials:
        points = [sampler.ask() for _ in range(min(RANDOM if not out else BATCH, trials - len(out)))]
        for p, (rounds, error) in zip(points, run(points)):
            sampler.tell(p, error)
            out.append((p, rounds, error))
    return out


def _in_tasks(spark: SparkSession, inner: DataFrame, valid: DataFrame, edges: list[list[float]]) -> Callable[[list[dict]], list[tuple[int, float]]]:
    """Rounds and error of each point, one task for each."""
    parts = [_arrays(df, edges) for df in (inner, valid)]
    width = max(1e-9, float(np.abs(parts[0][1]).max(initial=0))) / STEPS
    shared = spark.sparkContext.broadcast((*parts, width))

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rounds, error = trial(json.loads(row["point"]), *shared.value)
                yield pa.RecordBatch.from_pylist([{"k": row["k"], "rounds": rounds, "error": error}], pa.schema([("k", pa.int32()), ("rounds", pa.int32()), ("error", pa.float64())]))

    def run(points: list[dict]) -> list[tuple[int, float]]:
        asked = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(points)], "k int, point string").repartitionById(len(points), F.col("k"))
        return [(r["rounds"], r["error"]) for r in sorted(asked.mapInArrow(one, "k int, rounds int, error double").collect(), key=lambda r: r["k"])]  # a row for each trial

    return run


def _over_blocks(spark: SparkSession, inner: DataFrame, valid: DataFrame, edges: list[list[float]]) -> Callable[[list[dict]], list[tuple[int, float]]]:
    """Rounds and error of each point, all side by side over the blocks of both parts."""
    stored = [kept(spark, _blocks(df, edges, BLOCK_ROWS)) for df in (inner, valid)]
    width = _width(inner)

    def run(points: list[dict]) -> list[tuple[int, float]]:
        learn, judge = map(Held, stored)
        start = judge.errors([0])[0]
        best, active = [(0, start)] * len(points), list(range(len(points)))
        for number in range(ROUNDS):
            own = {m: points[m] for m in active}
            trees = side_by_side({m: growing(p, number) for m, p in own.items()}, lambda asked: learn.answers(asked, own, number, width))
            moved = [m for m, tree in trees.items() if learn.add(m, tree) and judge.add(m, tree)]  # the errors of others stay
            for m, error in judge.errors(moved).items():
                if error < best[m][1]:
                    best[m] = (number + 1, error)
            active = [m for m in active if number + 1 - best[m][0] < PATIENCE]
            if not active:
                break
            learn, judge = learn.folded(active), judge.folded(active)
        return best

    return run


# -- the model, from all rows


def _blocks(rows: DataFrame, edges: list[list[float]], size: int) -> DataFrame:
    empty = Forest(edges, [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(k: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            left = columns[-1] - columns[FEATURES.index(BASE)]
            return pa.RecordBatch.from_pylist([{"k": k, "bins": empty.bins(columns[:-1]).tobytes(), "left": left.tobytes()}])

        held, n, k = [], 0, 0
        for batch in (b.slice(j, size) for b in batches for j in range(0, b.num_rows, size)):
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield block(k, held)
                held, n, k = [], 0, k + 1
        if n:
            yield block(k, held)

    told = rows.select(*[F.col(c).cast("double") for c in (*FEATURES, TARGET)]).mapInArrow(run, "k long, bins binary, left binary")
    return told.withColumn("k", F.col("k") + F.spark_partition_id() * F.lit(1 << 20))


def _of(batches: Iterable[pa.RecordBatch | pa.Table]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, bins and what is left of each block, one after the other."""
    for batch in batches:
        for k, bins, left in zip(*batch.columns[:3]):
            yield k.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(left.as_buffer())


def _width(rows: DataFrame) -> float:
    most = rows.agg(F.max(F.abs(F.col(TARGET) - F.col(BASE)))).first()[0] or 0.0
    return max(1e-9, most) / STEPS


@dataclass
class Held:
    """Rows in blocks and what each of several models leaves of them: a stored table (k, bins, left) and the trees that aren't counted in it yet.

    A block has an array of `left` for each model, in the places told; at first one for all.
    """

    blocks: DataFrame
    places: dict[int, int] = field(default_factory=dict)
    fresh: dict[int, list[Tree]] = field(default_factory=dict)

    def add(self, model: int, tree: Tree) -> bool:
        """Whether the tree changes what is left."""
        moves = any(tree.values.values())
        if moves:
            self.fresh.setdefault(model, []).append(tree)
        return moves

    def _lefts(self, models: list[int]) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]:
        own = [(m, self.places.get(m, 0), Forest([], list(self.fresh.get(m, ())))) for m in models]

        def told(bins: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            stored = left.reshape(-1, len(bins))
            for m, place, forest in own:
                yield m, stored[place] - forest.margin(bins) if forest.trees else stored[place]

        return told

    def folded(self, models: list[int]) -> Held:
        """These models' trees counted in a table of its own, where one has FOLD_IN of them."""
        if max((len(self.fresh.get(m, ())) for m in models), default=0) < FOLD_IN:
            return self
        lefts = self._lefts(models)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, bins, left in _of(batches):
                yield pa.RecordBatch.from_pylist([{"k": k, "bins": bins.tobytes(), "left": b"".join(x.tobytes() for _, x in lefts(bins, left))}])

        return Held(kept(self.blocks.sparkSession, self.blocks.mapInArrow(run, "k long, bins binary, left binary")), {m: j for j, m in enumerate(models)})

    def errors(self, models: list[int]) -> dict[int, float]:
        """Each model's mean absolute error."""
        if not models:
            return {}
        lefts = self._lefts(models)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {m: [0, 0.0] for m in models}
            for _, bins, left in _of(batches):
                for m, own in lefts(bins, left):
                    sums[m][0] += len(own)
                    sums[m][1] += float(np.abs(own).sum())
            yield pa.RecordBatch.from_pylist([{"model": m, "n": n, "error": e} for m, (n, e) in sums.items()])

        told = self.blocks.mapInArrow(run, "model long, n long, error double").groupBy("model").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
        return {r["model"]: r["error"] / max(1, r["n"]) for r in told.collect()}  # a row for each model

    def answers(self, asked: dict[int, Asked], points: dict[int, dict], number: int, width: float) -> dict[int, dict]:
        """What each model's tree of round `number` asks for. Tasks add up the arrays of their blocks, and a node's meet in one task, in which they come one by one."""
        lefts = self._lefts(list(asked))

        def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for k, bins, left in _of(batches):
                for m, own in lefts(bins, left):
                    tree, nodes, features = asked[m]
                    bag = in_bag(len(bins), points[m]["bagging_fraction"], number, k)
                    some, rest = bins[bag], own[bag]
                    at = tree.nodes(some)
                    told = medians(at, rest, nodes, width) if features is None else histograms(some, at, np.sign(rest), nodes, features)
                    if m in sums:
                        sums[m] += told
                    else:
                        sums[m] = told
            for m, told in sums.items():
                for n, array in zip(asked[m][1], told):
                    if array.any():
                        yield pa.RecordBatch.from_pylist([{"model": m, "node": n, "told": array.tobytes()}])

        def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for m, n, data in zip(*batch.columns):
                    key = m.as_py(), n.as_py()
                    sums[key] = sums.get(key, 0) + np.frombuffer(data.as_buffer(), np.int64)
            for (m, n), array in sums.items():
                features = asked[m][2]
                row = {"model": m, "node": n, "value": None, "gain": None, "feature": None, "last": None, "missing_left": None}
                if features is None:
                    row["value"] = median_of(array, width)
                else:
                    best = best_split(array.reshape(len(FEATURES), BINS + 1, 2), points[m]["min_child_samples"], points[m]["lambda_l2"], features)
                    row |= zip(("gain", "feature", "last", "missing_left"), best)
                yield pa.RecordBatch.from_pylist([row], kinds)

        kinds = pa.schema([("model", pa.int64()), ("node", pa.int64()), ("value", pa.float64()), ("gain", pa.float64()), ("feature", pa.int64()), ("last", pa.int64()), ("missing_left", pa.bool_())])
        parts = min(int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + sum(len(nodes) for _, nodes, _ in asked.values()) // NODES)
        summed = self.blocks.mapInArrow(add_up, "model long, node long, told binary").repartitionById(parts, F.pmod(F.hash("model", "node"), F.lit(parts)))
        out: dict[int, dict] = {}
        for r in summed.mapInArrow(finish, "model long, node long, value double, gain double, feature long, last long, missing_left boolean").collect():  # a row for each node
            out.setdefault(r["model"], {})[r["node"]] = r["value"] if r["gain"] is None else (r["gain"], r["feature"], r["last"], r["missing_left"])
        return out


def fit(rows: DataFrame, point: dict, rounds: int, edges: list[list[float]]) -> Forest:
    """`rounds` trees from all rows. Rows that make a single block are learned from in one task, more of them over their blocks, with the same trees."""
    if not rounds:
        return Forest(edges, [])
    spark = rows.sparkSession
    one = rows.count() <= ONE_BLOCK
    held = Held(kept(spark, _blocks(rows.coalesce(1) if one else rows, edges, ONE_BLOCK if one else BLOCK_ROWS)))
    width, trees = _width(rows), []
    if one:

        def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, bins, left in _of(batches):
                for k, tree in zip(range(rounds), rounds_of(point, bins, left, width)):
                    yield pa.RecordBatch.from_pylist([{"k": k, "tree": json.dumps(_plain(tree))}])

        told = held.blocks.mapInArrow(learn, "k long, tree string").orderBy("k").collect()  # a row for each tree
        return Forest.of(json.dumps({"edges": edges, "trees": [json.loads(r["tree"]) for r in told]}))
    for number in range(rounds):
        trees.append(side_by_side({0: growing(point, number)}, lambda asked: held.answers(asked, {0: point}, number, width))[0])
        held.add(0, trees[-1])
        if number + 1 < rounds:
            held = held.folded([0])
    return Forest(edges, trees)


def train(data: DataFrame, trials: int = TRIALS, share: float = 0.2, least_hours: int = 6, seed: int = SEED, stored: bool = False):
    """M7: None if there are under `least_hours` hours; else the search on the last hours of the training part, and the best point fitted on all of that.

    stored: `data` is a stored table, which needs no copy.
    """
    from .forecast import Trained, baseline_metrics, metrics

    rows = data.dropna(subset=[TARGET, BASE])
    rows = rows if stored else kept(data.sparkSession, rows)
    at = F.unix_micros("heure_fin")
    sizes = dict(map(tuple, rows.groupBy(at).count().collect()))  # one row an hour of the history
    if len(sizes) < least_hours:
        return None
    upto, since = split_hours(sorted(sizes), share)
    within, after = split_hours(upto, share)
    inner, valid, learn, test = (rows.filter(at.between(h[0], h[-1])) for h in (within, after, upto, since))
    edges = bin_edges(inner)
    tried = search(inner, valid, edges, trials, seed, tuple(sum(sizes[h] for h in own) for own in (within, after)))
    point, rounds, error = min(tried, key=lambda x: x[2])
    model = fit(learn, point, rounds, edges)
    told = metrics(model.transform(test).withColumn("prediction", F.greatest("prediction", F.lit(0.0))), TARGET, "prediction").first()
    base = baseline_metrics(test).first()
    return Trained(model, told["mae"], told["rmse"], base["mae"], base["rmse"], model.importance(), point | {"rounds": rounds, "valid_mae": error, "trials": len(tried)})


def save(spark: SparkSession, model: Forest, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(model.text().encode()))
    stream.close()


def load(spark: SparkSession, path: str) -> Forest:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return Forest.of(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
