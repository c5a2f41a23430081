"""Second-order boosted trees, grown by Spark jobs over a written table of bins.

Feature values become bin numbers once. The table is written in blocks of some thousand rows, column by column:
one byte per feature, a label, a role per fold and a 64-bit draw made from the row's key. A level of all trees that are being grown is one job: every
task adds up gradients, curvatures and rows per node, feature and bin of the rows it reads, and the driver adds up the
sums of the tasks (beyond ``FAN_IN`` of them, tasks do so first, a piece each) and makes the best cuts. Of two nodes
made by a cut only the one of fewer rows is counted, the other has the rest of their parent's sums. The driver holds
three numbers per open node, feature and bin, whatever the size of the table; several settings or bags of a family
grow in the same scans. Margins of finished trees are written into the table every few rounds, from which later
scans start: a scan never follows more than ``REWRITE`` trees, and a lost executor costs a re-read. A task holds a few
blocks at a time (``READ``), whatever the size of its file.

Sums are integers (gradients in units of 2 ** -24), so a fit is the same whatever the partitioning of the table and
the order its tasks end in.

A cut sends a row left where its bin is at most the cut's bin, that is where its value is at most the edge.
Null and NaN are in the lowest bin. With G and H the sums of gradients and curvatures, T the soft threshold by ``l1``,
a leaf is worth ``-step * T(G) / (H + l2)`` and a cut gains ``(T(Gl)^2/(Hl+l2) + T(Gr)^2/(Hr+l2) - T(G)^2/(H+l2)) / 2
- min_gain``; only cuts with a positive gain are made. Ties go to the first feature, then to the lowest bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.operators.features import FeaturePipeline
from perilscope.operators.scoring import _beside
from perilscope.session import discard, materialise

REWRITE = 4  # rounds after which margins are written
EDGE_ROWS = 50_000  # rows, drawn by hash, whose quantiles are the edges of the bins
UNIT = float(1 << 24)
SLICE = 1 << 11  # rows of a written block
CHUNK = 7 * SLICE  # rows added up together, below 1 << 14
FAN_IN = 16  # tasks whose sums go to the driver
#: How blocks are read: tasks of equal size, and few blocks at once.
READ = {
    "spark.sql.files.maxPartitionBytes": 1 << 25, "spark.sql.parquet.columnarReaderBatchSize": 32,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 32,
}
TASK_ROWS = 1 << 13  # rows that a small table is dealt by
PACKED = 1 << 38  # a row counts so much beside its curvature: both are in one sum below 2 ** 53
TRAIN, EVAL, UNUSED = 0, 1, 2


# --- objectives ---------------------------------------------------------------

@dataclass(frozen=True)
class Objective:
    """Gradient, curvature and loss of a margin; ``mean`` turns a margin into a prediction."""

    link: Callable[[float], float]
    mean: Callable[[np.ndarray], np.ndarray]
    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    loss: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1 / (1 + e), e / (1 + e))


def _logistic_slopes(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _sigmoid(m)
    return p - y, p * (1 - p)


def _poisson_slopes(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rate = np.exp(m)
    return rate - y, rate


def _gamma_slopes(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = y * np.exp(-m)
    return 1 - share, share


POWER = 1.5  # of the Tweedie variance


def _tweedie_slopes(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = y * np.exp((1 - POWER) * m), np.exp((2 - POWER) * m)
    return b - a, (2 - POWER) * b - (1 - POWER) * a


OBJECTIVES = {
    "logistic": Objective(
        lambda mean: float(np.log(mean / (1 - mean))), _sigmoid, _logistic_slopes,
        lambda m, y: np.logaddexp(0, m) - y * m,
    ),
    "poisson": Objective(lambda mean: float(np.log(mean)), np.exp, _poisson_slopes, lambda m, y: np.exp(m) - y * m),
    "gamma": Objective(lambda mean: float(np.log(mean)), np.exp, _gamma_slopes, lambda m, y: y * np.exp(-m) + m),
    "tweedie": Objective(
        lambda mean: float(np.log(mean)), np.exp, _tweedie_slopes,
        lambda m, y: np.exp((2 - POWER) * m) / (2 - POWER) - y * np.exp((1 - POWER) * m) / (1 - POWER),
    ),
}


@dataclass(frozen=True)
class TreeSettings:
    """How one model is grown; ``fold`` is the role column its rows are chosen by.

    ``patience`` rounds without a smaller evaluation loss end the fit, and the trees up to the smallest loss are the
    model; with None all rounds are made and kept.
    """

    objective: str = "logistic"
    max_depth: int = 5
    rounds: int = 100
    step: float = 0.1
    l2: float = 1.0
    l1: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 1
    min_curvature: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    max_step: float | None = None
    patience: int | None = None
    seed: int = 123
    fold: int = 0


# The settings of the event, frequency, severity and pure-premium models.
EVENT = TreeSettings(
    "logistic", rounds=3000, step=0.05, l2=0.5, min_gain=0.1, min_rows=1, row_share=0.5, column_share=0.8, patience=100
)
EVENT_BINS = 100
FREQUENCY = TreeSettings(
    "poisson", max_depth=5, rounds=800, step=0.02, l2=1, l1=1, min_curvature=5, row_share=0.9, column_share=0.9, max_step=0.7
)
FREQUENCY_BINS = 32
SEVERITY = TreeSettings(
    "gamma", max_depth=4, rounds=600, step=0.02, l2=1, l1=1, min_curvature=5, row_share=0.9, column_share=0.9
)
SEVERITY_BINS = 16
PURE_PREMIUM = TreeSettings(
    "tweedie", max_depth=5, rounds=500, step=0.02, l2=8, l1=1, min_gain=0.1, min_curvature=16, row_share=0.9,
    column_share=0.9,
)
PURE_PREMIUM_BINS = 32


# --- trees ----------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1 and points to itself."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def cut(self, node: int, feature: int, bin_: int, gain: float, left: float, right: float) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.bin[node], self.gain[node] = feature, bin_, gain
        self.left[node], self.right[node] = first, first + 1
        for k, value in ((first, left), (first + 1, right)):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(k)
            self.right.append(k)
            self.value.append(value)
            self.gain.append(0.0)
        return first, first + 1

    def depth(self) -> int:
        depths = [0] * len(self.feature)
        for k, f in enumerate(self.feature):
            if f >= 0:
                depths[self.left[k]] = depths[self.right[k]] = depths[k] + 1
        return max(depths)

    def nodes(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The node every row (of ``bins``, features x rows; all, or those named) ends in."""
        feature, left = np.array(self.feature), np.array(self.left)
        # no bin is beyond 255, so leaves go to themselves; children were made in pairs, the right one after the left
        cut = np.where(feature >= 0, self.bin, 255).astype(np.uint8)
        cells, n = bins.ravel(), bins.shape[1]
        starts = np.maximum(feature, 0) * n
        rows = np.arange(n) if rows is None else rows
        at = np.zeros(len(rows), dtype=np.int64)
        for _ in range(self.depth()):
            at = left.take(at) + (cells.take(starts.take(at) + rows) > cut.take(at))
        return at


@dataclass
class BoostedModel:
    """Trees, the margin they start from, and the evaluation loss after each number of trees."""

    settings: TreeSettings
    start: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            total += np.array(tree.value)[tree.nodes(bins)]
        return total

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return OBJECTIVES[self.settings.objective].mean(self.margins(bins))


def to_bins(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of values (rows x features): the number of edges below the value."""
    out = np.empty((len(edges), len(values)), dtype=np.uint8)
    for k, e in enumerate(edges):
        x = values[:, k]
        out[k] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left"))
    return out


@dataclass
class BoostedTrees:
    """Models of one family over the same bins; the prediction is their mean."""

    features: list[str]
    edges: list[np.ndarray]
    models: list[BoostedModel]

    def only(self, k: int) -> BoostedTrees:
        return BoostedTrees(self.features, self.edges, [self.models[k]])

    def prediction(self, columns: Sequence[Column] | None = None) -> Column:
        """The mean prediction from the features' columns, in vectorised batches."""
        edges, models = self.edges, self.models

        @F.pandas_udf("double")
        def predict(*values: pd.Series) -> pd.Series:
            bins = to_bins(np.column_stack([v.to_numpy(dtype=np.float64, na_value=np.nan) for v in values]), edges)
            return pd.Series(sum(m.predict(bins) for m in models) / len(models))

        return predict(*[c.cast("double") for c in columns or [F.col(f"`{f}`") for f in self.features]])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node, with the edge a cut stands for; the trees' readable form, and what is saved."""
        rows = [
            (m, t, k, f, self.features[f] if f >= 0 else None, float(self.edges[f][b]) if f >= 0 else None, b, le, ri, v, g)
            for m, model in enumerate(self.models)
            for t, tree in enumerate(model.trees)
            for k, (f, b, le, ri, v, g) in enumerate(zip(tree.feature, tree.bin, tree.left, tree.right, tree.value, tree.gain))
        ]
        return spark.createDataFrame(
            rows, "model int, tree int, node int, feature int, name string, edge double, bin int, left int, right int, "
            "value double, gain double"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Three small tables: nodes, edges, settings."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        edges = [(k, name, [float(x) for x in e]) for k, (name, e) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(edges, "position int, feature string, edges array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/edges")
        import json

        settings = [(k, json.dumps(asdict(m.settings)), m.start, [float(x) for x in m.losses]) for k, m in enumerate(self.models)]
        spark.createDataFrame(settings, "model int, settings string, start double, losses array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        import json

        edges = spark.read.parquet(f"{path}/edges").orderBy("position").collect()
        models = [
            BoostedModel(TreeSettings(**json.loads(r["settings"])), r["start"], [], list(r["losses"]))
            for r in spark.read.parquet(f"{path}/settings").orderBy("model").collect()
        ]
        for r in spark.read.parquet(f"{path}/nodes").orderBy("model", "tree", "node").collect():
            trees = models[r["model"]].trees
            if r["tree"] == len(trees):
                trees.append(Tree([], [], [], [], [], []))
            tree = trees[r["tree"]]
            for name in ("feature", "bin", "left", "right", "value", "gain"):
                getattr(tree, name).append(r[name])
        return BoostedTrees([r["feature"] for r in edges], [np.array(r["edges"], dtype=np.float64) for r in edges], models)


@dataclass
class TreeScorer:
    """Mean prediction of boosted trees over prepared features."""

    pipeline: FeaturePipeline
    model: BoostedTrees

    def __call__(self, df: DataFrame, output: str = "score") -> DataFrame:
        return _beside(df, self.pipeline.transform, self.model.prediction(), output)


# --- the table --------------------------------------------------------------------

@dataclass
class BinnedTable:
    """The written rows, in blocks of up to ``SLICE`` (see ``BLOCK``)."""

    table: DataFrame
    features: list[str]
    edges: list[np.ndarray]


def quantile_edges(values: np.ndarray, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` edges per column: values at evenly spaced places of the sorted column."""
    out = []
    for column in values.T:
        x = np.sort(column[np.isfinite(column)])
        if not len(x):
            out.append(np.zeros(0))
            continue
        places = (np.arange(1, bins) * len(x)) // bins
        edges = np.unique(x[places])
        out.append(edges[edges < x[-1]])
    return out


def bin_rows(
    rows: DataFrame, features: Sequence[str], values: Column, label: str, roles: Sequence[Column], draw: Column,
    bins: int = 32, edges: Sequence[Sequence[float]] | None = None,
) -> BinnedTable:
    """Write rows as bins.

    ``values`` is an array with one double per feature; ``roles`` has TRAIN, EVAL or UNUSED per fold; ``draw`` is a
    64-bit number made from the row's key, by which rows are sampled. Rows without a label are left out. Without
    ``edges``, those are quantiles of about ``EDGE_ROWS`` rows with the smallest draws.
    """
    if not 2 <= bins <= 255:
        raise ValueError("a bin is one byte")
    rows = rows.where(F.col(label).isNotNull()).select(
        values.cast("array<double>").alias("x"), F.col(label).cast("double").alias("label"),
        F.array(*[r.cast("int") for r in roles]).alias("roles"), draw.alias("draw"),
    )
    total = rows.count()
    if edges is None:
        part = min(1.0, EDGE_ROWS / max(total, 1))
        seen = rows if part == 1.0 else rows.where(F.pmod("draw", F.lit(1 << 20)) < int(part * (1 << 20)))
        found = seen.select("x").toPandas()["x"]  # EDGE_ROWS rows
        sample = np.array([[np.nan if v is None else v for v in x] for x in found], dtype=np.float64)
        edges = quantile_edges(sample.reshape(len(sample), len(features)), bins)
    edges = [np.asarray(e, dtype=np.float64) for e in edges]
    n = len(features)

    def slices(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``SLICE`` rows, the last one of fewer."""
        held, size = [], 0
        for batch in stream:
            held, size = [*held, batch], size + len(batch)
            if size >= SLICE:
                *full, rest = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=SLICE)
                yield from full
                held, size = [rest], len(rest)
        if size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=SLICE)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), n)
            roles_ = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            yield _block(
                to_bins(x, edges), batch.column(1).to_numpy(zero_copy_only=False), roles_.reshape(len(batch), -1).T,
                batch.column(3).to_numpy(zero_copy_only=False), None,
            )

    # small tables are dealt over the cores; a large one keeps its layout
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, 1 + total // TASK_ROWS)
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks, "draw")
    schema = ", ".join(["n int", *[f"{c} binary" for c in BLOCK]])
    return BinnedTable(_read_again(materialise(rows.mapInArrow(run, schema), "bins")), list(features), edges)


def _read_again(written: DataFrame) -> DataFrame:
    """Written blocks, read by a session with the settings of ``READ``."""
    session = written.sparkSession.newSession()  # its settings are its own
    for name, value in READ.items():
        session.conf.set(name, str(value))
    folder, = {name.rsplit("/", 1)[0] for name in written.inputFiles()}
    return session.read.schema(written.schema).parquet(folder)


#: Columns of a written block of rows, each as bytes: bins (features x rows), labels, roles (folds x rows), draws and
#: margins (models x rows).
BLOCK = ["bins", "label", "roles", "draw", "margins"]


def _block(bins: np.ndarray, label: np.ndarray, roles: np.ndarray, draw: np.ndarray, margins: np.ndarray | None) -> pa.RecordBatch:
    parts = [bins, label.astype(np.float64), roles, draw.astype(np.int64), np.zeros(0) if margins is None else margins]
    columns = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts]
    return pa.RecordBatch.from_arrays([pa.array([len(label)], pa.int32()), *columns], names=["n", *BLOCK])


def _spread(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit mixed into every other."""
    x = x.copy()
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


# --- growing ----------------------------------------------------------------------

@dataclass
class _Growing:
    """One model on its way: ``written`` trees are in the table's margins, the last one is being grown."""

    number: int
    model: BoostedModel
    written: int = 0
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)
    done: bool = False
    before: int = 0  # written trees that a view leaves out
    rest: list[int] = field(default_factory=list)  # open nodes with the rest of their parent's sums, one of every two
    sums: np.ndarray | None = None  # of the open nodes' parents, while there is a rest: columns x 3 x parents x bins

    def view(self) -> _Growing:
        """What tasks need: the trees that are not in the table's margins yet."""
        fresh = BoostedModel(self.model.settings, self.model.start, self.model.trees[self.written :])
        return replace(self, model=fresh, written=0, before=self.written, sums=None)

    def counted(self) -> list[int]:
        """The open nodes whose rows are added up."""
        rest = set(self.rest)
        return [node for node in self.open if node not in rest]

    def chosen(self, draws: np.ndarray) -> np.ndarray:
        """The rows of this round's sample."""
        s = self.model.settings
        if s.row_share >= 1:
            return np.ones(len(draws), dtype=bool)
        salt = np.uint64((s.seed * 1_000_003 + (self.before + len(self.model.trees)) * 7919 + 1) & (2**64 - 1))
        with np.errstate(over="ignore"):
            mixed = _spread(draws.view(np.uint64) + _spread(np.array([salt]))[0])
        return (mixed >> np.uint64(11)).astype(np.float64) < s.row_share * float(1 << 53)

    def sample(self) -> tuple:
        """What decides this round's rows."""
        s = self.model.settings
        return s.fold, s.seed, s.row_share, self.before + len(self.model.trees)

    def chosen_of(self, rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
        return rows[self.chosen(draws[rows])]

    def margin(self, bins: np.ndarray, margins: np.ndarray | None, rows: np.ndarray | None = None) -> np.ndarray:
        """Margins of all rows, or of those named."""
        if margins is not None:
            out = margins[self.number].copy() if rows is None else margins[self.number][rows]
        else:
            out = np.full(bins.shape[1] if rows is None else len(rows), self.model.start)
        for tree in self.model.trees[self.written :]:
            out += np.array(tree.value)[tree.nodes(bins, rows)]
        return out


def _blocks(stream: Iterator[pa.RecordBatch]):
    """The written blocks: bins, labels, roles, draws, margins (None before they are written)."""
    for batch in stream:
        for n, *raw in zip(*(c for c in batch.columns)):
            bins, label, roles, draw, margins = (
                np.frombuffer(x.as_buffer(), dtype=kind)
                for x, kind in zip(raw, (np.uint8, np.float64, np.uint8, np.int64, np.float64))
            )
            rows = n.as_py()
            yield (
                bins.reshape(-1, rows), label, roles.reshape(-1, rows), draw,
                margins.reshape(-1, rows) if len(margins) else None,
            )


def _chunks(blocks):
    """Blocks put together, up to ``CHUNK`` rows."""
    held, size = [], 0
    for block in blocks:
        if held and size + len(block[1]) > CHUNK:
            yield _joined(held)
            held, size = [], 0
        held, size = [*held, block], size + len(block[1])
    if held:
        yield _joined(held)


def _joined(blocks):
    if len(blocks) == 1:
        return blocks[0]
    return tuple(None if parts[0] is None else np.concatenate(parts, axis=-1) for parts in zip(*blocks))


def _once(held: dict[tuple, np.ndarray], key: tuple, find: Callable[[], np.ndarray]) -> np.ndarray:
    """What was found for a key before, or is found now."""
    if key not in held:
        held[key] = find()
    return held[key]


def _add_up(
    totals: list[np.ndarray], columns: Sequence[int], n_bins: Sequence[int], bins: np.ndarray, place: np.ndarray, nodes: int,
    gradient: np.ndarray, curvature: np.ndarray,
) -> None:
    """Add gradients, curvatures and rows per node and bin to ``totals``, one table per column."""
    flags = []
    if max(np.abs(gradient).sum(), np.abs(curvature).sum()) < 1 << 53:  # no sum of some of them is rounded
        flags = [k for k, f in enumerate(columns) if n_bins[f] <= 2]
    if flags:
        _add_up_flags([totals[k] for k in flags], bins[[columns[k] for k in flags]], place, nodes, gradient, curvature)
    packed = len(place) < 1 << 14 and (curvature >= 0).all() and curvature.sum() < PACKED
    second = curvature + PACKED if packed else curvature
    bases: dict[int, np.ndarray] = {}
    for k in sorted({*range(len(columns))} - {*flags}):
        total, f = totals[k], columns[k]
        size = nodes * n_bins[f]
        if n_bins[f] not in bases:
            bases[n_bins[f]] = place * n_bins[f]
        cell = bases[n_bins[f]] + bins[f]
        total[0] += np.rint(np.bincount(cell, gradient, minlength=size)).astype(np.int64)
        found = np.rint(np.bincount(cell, second, minlength=size)).astype(np.int64)
        total[1] += found & (PACKED - 1) if packed else found
        total[2] += found >> 38 if packed else np.bincount(cell, minlength=size)


def _add_up_flags(
    totals: list[np.ndarray], bins: np.ndarray, place: np.ndarray, nodes: int, gradient: np.ndarray, curvature: np.ndarray
) -> None:
    """``_add_up`` for columns of at most two bins: a product per node gives the sums of the upper bins of all of them."""
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(nodes + 1))
    bins = bins.take(order, axis=1)
    weights = np.stack([gradient, curvature, np.ones(len(place))], axis=1)[order]
    whole, upper = np.zeros((3, nodes)), np.zeros((len(totals), 3, nodes))
    for node, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if a < b:
            whole[:, node] = weights[a:b].sum(axis=0)
            upper[:, :, node] = bins[:, a:b].astype(np.float64) @ weights[a:b]
    upper, lower = upper.astype(np.int64), (whole - upper).astype(np.int64)
    for total, high, low in zip(totals, upper, lower):
        cells = total.reshape(3, nodes, -1)
        cells[:, :, 0] += low
        if cells.shape[2] > 1:
            cells[:, :, 1] += high


def _sums(table: DataFrame, growing: list[_Growing], n_bins: list[int], with_loss: bool) -> DataFrame:
    """Partial sums of every task: per model the evaluation loss and its rows, then gradients, curvatures and rows per
    column, counted node and bin; as one array, cut into pieces for the tasks that add them up."""
    growing = [g.view() for g in growing]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = {g.number: g.counted() for g in growing}
        totals = {g.number: [np.zeros((3, len(counted[g.number]) * n_bins[f]), dtype=np.int64) for f in g.columns] for g in growing}
        losses = {g.number: np.zeros(2, dtype=np.int64) for g in growing}
        for bins, label, roles, draws, margins in _chunks(_blocks(stream)):
            held: dict[tuple, np.ndarray] = {}  # models of a family look at the same rows
            for g in growing:
                settings, nodes = g.model.settings, counted[g.number]
                objective, role = OBJECTIVES[settings.objective], roles[settings.fold]
                if with_loss:
                    rows = _once(held, (settings.fold,), lambda: np.flatnonzero(role == EVAL))
                    loss = objective.loss(g.margin(bins, margins, rows), label[rows])
                    losses[g.number] += (int(np.rint(loss * UNIT).sum()), len(rows))
                if not nodes:
                    continue
                rows = _once(held, g.sample(), lambda: g.chosen_of(np.flatnonzero(role == TRAIN), draws))
                slot = np.full(len(g.tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                place = slot[g.tree.nodes(bins, rows)]
                inside = np.flatnonzero(place >= 0)
                if len(inside) < len(rows):
                    rows, place = rows[inside], place[inside]
                    part = bins.take(rows, axis=1)
                else:
                    part = _once(held, (*g.sample(), "bins"), lambda: bins.take(rows, axis=1))
                slopes = [np.rint(v * UNIT) for v in objective.slopes(g.margin(bins, margins, rows), label[rows])]
                _add_up(totals[g.number], g.columns, n_bins, part, place, len(nodes), *slopes)
        whole = np.concatenate([np.zeros(0, dtype=np.int64), *[x.ravel() for g in growing for x in (losses[g.number], *totals[g.number])]])
        for k, piece in enumerate(np.array_split(whole, FAN_IN)):
            yield _piece(k, piece)

    return table.mapInArrow(run, "piece int, sums binary")


def _piece(k: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["piece", "sums"])


def _added_up(stream: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """The sums of the tasks' pieces."""
    found: dict[int, np.ndarray] = {}
    for batch in stream:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(raw.as_buffer(), dtype=np.int64)
            found[k] = found[k] + part if k in found else part
    return found


def _merged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, sums in _added_up(stream).items():
        yield _piece(k, sums)


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _score(g: np.ndarray, h: np.ndarray, s: TreeSettings) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + s.l2 > 0, _soft(g, s.l1) ** 2 / (h + s.l2), 0.0)


def _worth(g: float, h: float, s: TreeSettings) -> float:
    """The value of a leaf."""
    if h + s.l2 <= 0:
        return 0.0
    value = float(-_soft(np.float64(g), s.l1) / (h + s.l2))
    if s.max_step is not None:
        value = min(max(value, -s.max_step), s.max_step)
    return s.step * value


@dataclass
class Cuts:
    """The best cut of every node: column and bin, gain (-inf without a cut), G, H and rows on the left and over all."""

    column: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    whole: np.ndarray


def best_cuts(totals: np.ndarray, s: TreeSettings) -> Cuts:
    """From the sums (columns x 3 x nodes x bins); bins that a column lacks have no rows."""
    g, h, n = (totals[:, k].astype(np.float64) / unit for k, unit in enumerate((UNIT, UNIT, 1.0)))
    left = [np.cumsum(v, axis=2)[:, :, :-1] for v in (g, h, n)]
    whole = [v.sum(axis=2, keepdims=True) for v in (g, h, n)]
    right = [w - v for w, v in zip(whole, left)]
    gain = (_score(left[0], left[1], s) + _score(right[0], right[1], s) - _score(whole[0], whole[1], s)) / 2 - s.min_gain
    fits = np.ones(gain.shape, dtype=bool)
    for side in (left, right):
        fits &= (side[2] >= max(s.min_rows, 1)) & (side[1] >= s.min_curvature)
    gain = np.where(fits, gain, -np.inf)
    nodes, all_ = np.arange(totals.shape[2]), np.stack([w[0, :, 0] for w in whole], axis=1)
    if not gain.shape[2]:
        return Cuts(nodes * 0, nodes * 0, np.full(len(nodes), -np.inf), np.zeros((len(nodes), 3)), all_)
    # columns ascend: ties go to the first, then to the lowest bin
    at = gain.transpose(1, 0, 2).reshape(len(nodes), -1).argmax(axis=1)
    column, bin_ = np.divmod(at, gain.shape[2])
    return Cuts(column, bin_, gain[column, nodes, bin_], np.stack([v[column, nodes, bin_] for v in left], axis=1), all_)


def _step(table: DataFrame, tasks: int, growing: list[_Growing], n_bins: list[int], with_loss: bool):
    """One scan by so many tasks: the evaluation loss per model, and per model the best cut of every open node."""
    partial = _sums(table, growing, n_bins, with_loss)
    if tasks > FAN_IN:
        partial = partial.repartition(FAN_IN, "piece").mapInArrow(_merged, partial.schema)
    found = _added_up(partial.toArrow().to_batches())
    flat = np.concatenate([found[k] for k in sorted(found)]) if found else None
    losses, cuts, at = {}, {}, 0
    for g in growing:
        counted, widest = g.counted(), max(n_bins[f] for f in g.columns)
        sums = np.zeros((len(g.columns), 3, len(counted), widest), dtype=np.int64)
        if flat is not None:
            if with_loss and flat[at + 1]:
                losses[g.number] = flat[at] / UNIT / flat[at + 1]
            at += 2
            for k, f in enumerate(g.columns):
                size = 3 * len(counted) * n_bins[f]
                sums[k, :, :, : n_bins[f]] = flat[at : at + size].reshape(3, len(counted), n_bins[f])
                at += size
        g.sums = _with_rest(g, sums)
        if g.open:
            cuts[g.number] = best_cuts(g.sums, g.model.settings)
    return losses, cuts


def _with_rest(g: _Growing, sums: np.ndarray) -> np.ndarray:
    """The sums of all open nodes, in their order; they are pairs if some are not counted."""
    if not g.rest:
        return sums
    rest = np.array([node in set(g.rest) for node in g.open])
    out = np.empty((*sums.shape[:2], len(g.open), sums.shape[3]), dtype=np.int64)
    out[:, :, ~rest], out[:, :, rest] = sums, g.sums - sums
    return out


def _extend(g: _Growing, cuts: Cuts, level: int) -> None:
    """Make the best cuts of the open nodes; their children are open next."""
    settings, fresh, rest, parents = g.model.settings, [], [], []
    for k, node in enumerate(g.open):
        (gl, hl, nl), (total_g, total_h, total_n) = cuts.left[k].tolist(), cuts.whole[k].tolist()
        if level == 0:
            g.tree.value[0] = _worth(total_g, total_h, settings)
        if cuts.gain[k] > 0:
            left, right = g.tree.cut(
                node, g.columns[cuts.column[k]], int(cuts.bin[k]), float(cuts.gain[k]), _worth(gl, hl, settings),
                _worth(total_g - gl, total_h - hl, settings),
            )
            fresh += [left, right]
            rest.append(right if nl <= total_n - nl else left)
            parents.append(k)
    deeper = level + 1 < settings.max_depth
    g.open, g.rest, g.sums = (fresh, rest, g.sums[:, :, parents]) if deeper else ([], [], None)


def _judge(g: _Growing, loss: float) -> None:
    """Note the loss of the trees so far; without a gain for too long the model is done."""
    model = g.model
    model.losses.append(float(loss))
    patience = model.settings.patience
    if patience is not None and not np.isnan(loss) and len(model.losses) - 1 - int(np.argmin(model.losses)) >= patience:
        g.done = True


def _with_margins(table: DataFrame, growing: list[_Growing]) -> DataFrame:
    """The table with the margins of all trees so far."""
    growing = [g.view() for g in growing]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, label, roles, draws, margins in _blocks(stream):
            yield _block(bins, label, roles, draws, np.stack([g.margin(bins, margins) for g in growing]))

    return _read_again(materialise(table.mapInArrow(run, table.schema), "margins"))


def fit_boosted(binned: BinnedTable, settings: Sequence[TreeSettings]) -> BoostedTrees:
    """Grow one model per setting, all in the same scans."""
    table, n_features = binned.table, len(binned.features)
    tasks = table.rdd.getNumPartitions()
    n_bins = [len(e) + 1 for e in binned.edges]
    growing = []
    for k, start in enumerate(_starts(table, settings)):
        growing.append(_Growing(k, BoostedModel(settings[k], start)))
    for round_ in range(max(s.rounds for s in settings) + 1):
        active = [g for g in growing if not g.done]
        for g in active:
            s = g.model.settings
            g.tree, g.open, g.rest, g.sums = Tree(), ([0] if len(g.model.trees) < s.rounds else []), [], None
            rng = np.random.default_rng([s.seed, len(g.model.trees)])
            wanted = max(1, round(s.column_share * n_features))
            columns = sorted(rng.choice(n_features, wanted, replace=False).tolist())
            # a column of one bin has no cut
            g.columns = [f for f in columns if n_bins[f] > 1] or columns[:1]
        level = 0
        while level == 0 or any(g.open for g in active):
            scanned = [g for g in active if g.open or level == 0]
            losses, cuts = _step(table, tasks, scanned, n_bins, with_loss=level == 0)
            for g in scanned:
                if level == 0:
                    _judge(g, losses.get(g.number, np.nan))
                    if g.done:
                        g.open, g.rest = [], []
                if g.open:
                    _extend(g, cuts[g.number], level)
            level += 1
        for g in active:
            if not g.done and len(g.model.trees) < g.model.settings.rounds:
                g.model.trees.append(g.tree)
            else:
                g.done = True
        if all(g.done for g in growing):
            break
        if (round_ + 1) % REWRITE == 0:
            before, table = table, _with_margins(table, growing)
            tasks = table.rdd.getNumPartitions()
            if before is not binned.table:
                discard(before)  # nothing reads earlier margins again
            for g in growing:
                g.written = len(g.model.trees)
    for g in growing:
        if g.model.settings.patience is not None and not np.isnan(g.model.losses).any():
            g.model.trees = g.model.trees[: int(np.argmin(g.model.losses))]
            g.model.losses = g.model.losses[: len(g.model.trees) + 1]
    return BoostedTrees(binned.features, binned.edges, [g.model for g in growing])


def _starts(table: DataFrame, settings: Sequence[TreeSettings]) -> list[float]:
    """The margin of the mean training label of every model, from one scan."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for _, label, roles, _, _ in _blocks(stream):
            units = np.rint(label * UNIT).astype(np.int64)
            for k, role in enumerate(roles):
                train = role == TRAIN
                found[k] = found.get(k, 0) + np.array([train.sum(), units[train].sum()])
        numbers = np.array([[k, *v] for k, v in found.items()], dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in numbers.T.copy()], names=["fold", "n", "total"])

    parts = table.mapInArrow(run, "fold long, n long, total long").groupBy("fold")
    sums = {r["fold"]: r for r in parts.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = []
    for s in settings:
        row = sums.get(s.fold)
        mean = float(row["total"]) / UNIT / row["n"] if row and row["n"] else 0.0
        low, high = 1e-9, 1 - 1e-9 if s.objective == "logistic" else np.inf
        out.append(OBJECTIVES[s.objective].link(min(max(mean, low), high)))
    return out


def with_depths(settings: TreeSettings, depths: Sequence[int]) -> list[TreeSettings]:
    """One setting per depth, to be grown together."""
    return [replace(settings, max_depth=d) for d in depths]
