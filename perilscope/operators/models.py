"""Training, parameter sweeps and evaluation: boosted trees of our own, nets and linear models of Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GeneralizedLinearRegression, GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.functions import expressions as X
from perilscope.operators import boosting as B
from perilscope.operators import nets as N
from perilscope.operators import perceptrons as P
from perilscope.operators.design import DesignMatrix, fit_design_matrix
from perilscope.operators.features import FeaturePipeline
from perilscope.operators.sampling import with_bag_flags
from perilscope.operators.scoring import ModelScorer, Scorer
from perilscope.session import materialise

# The settings tried by the two sweeps and the bagging seeds.
DEPTHS = list(range(2, 10))
WIDTHS = list(range(32, 257, 32))
BAG_SEEDS = {f"bag_{i}": 123 + i for i in range(1, 6)}
SPLIT_SEED = 123

ROUNDS, STEP = 20, 0.2  # of the event trees by default; B.EVENT has the long, slow settings


# --- event models -----------------------------------------------------------

def training_table(
    df: DataFrame, pipeline: FeaturePipeline, label: str, is_train: str, key: str = "id_policy"
) -> DataFrame:
    """Prepared vectors, label, evaluation flag and a draw made from the key, written once for many scans."""
    assembler = VectorAssembler(inputCols=pipeline.features, outputCol="features")
    prepared = pipeline.transform(df.where(F.col(label).isNotNull()))
    rows = assembler.transform(prepared).select(
        "features", F.col(label).alias("label"), (~F.col(is_train)).alias("is_eval"),
        F.xxhash64(F.col(key)).alias("draw"),
    )
    return materialise(rows, "training")


def _servable(pipeline: FeaturePipeline, fitted) -> PipelineModel:
    assembler = VectorAssembler(inputCols=pipeline.features, outputCol="features")
    return PipelineModel([assembler, fitted])


def binned_table(table: DataFrame, pipeline: FeaturePipeline, bins: int = B.EVENT_BINS) -> B.BinnedTable:
    """A training table as bins, for one fit or all fits of a sweep."""
    role = F.when(F.col("is_eval"), B.EVAL).otherwise(B.TRAIN)
    return B.bin_rows(table, pipeline.features, vector_to_array("features"), "label", [role], F.col("draw"), bins)


def fit_gbt(
    table: DataFrame,
    pipeline: FeaturePipeline,
    max_depth: int = 5,
    rounds: int = ROUNDS,
    step: float = STEP,
    seed: int = SPLIT_SEED,
    **options,
) -> B.TreeScorer:
    """Second-order boosted trees with logistic loss on half the rows and 80 % of the columns per tree, penalised
    leaves and a least gain; the trees up to the smallest evaluation loss are kept. ``options`` replace
    those of ``boosting.EVENT``."""
    return _fit_gbts(table, pipeline, [max_depth], rounds=rounds, step=step, seed=seed, **options)[0]


def _fit_gbts(table: DataFrame, pipeline: FeaturePipeline, depths: Sequence[int], **options) -> list[B.TreeScorer]:
    """One model per depth, all grown in the same scans."""
    settings = B.with_depths(replace(B.EVENT, **options), depths)
    fitted = B.fit_boosted(binned_table(table, pipeline), settings)
    return [B.TreeScorer(pipeline, fitted.only(k)) for k in range(len(depths))]


def fit_mlp(
    table: DataFrame,
    pipeline: FeaturePipeline,
    hidden: int = 32,
    rounds: int = 25,
    seed: int = SPLIT_SEED,
) -> ModelScorer:
    """Feed-forward net: inputs, ``hidden`` units, 32 units, two classes."""
    trainer = MultilayerPerceptronClassifier(
        layers=[len(pipeline.features), hidden, 32, 2], maxIter=rounds, blockSize=P.BLOCK, seed=seed
    )
    return P.PerceptronScorer(pipeline, _servable(pipeline, trainer.fit(table.where(~F.col("is_eval")))))


def _fit_mlps(
    table: DataFrame, pipeline: FeaturePipeline, widths: Sequence[int], rounds: int = 25, seed: int = SPLIT_SEED
) -> list[ModelScorer]:
    """The nets of ``fit_mlp``, one per width, all trained in the same scans."""
    rows = table.where(~F.col("is_eval")).select(vector_to_array("features").alias("x"), "label")
    layers = [[len(pipeline.features), width, 32, 2] for width in widths]
    return [P.PerceptronScorer(pipeline, _servable(pipeline, net)) for net in P.fit_perceptrons(rows, layers, rounds, seed)]


def batch_table(table: DataFrame, pipeline: FeaturePipeline, batch_rows: int, seed: int = SPLIT_SEED) -> N.BatchTable:
    """A training table dealt into batches, for one net or all nets of a sweep."""
    return N.deal_batches(table, pipeline.features, vector_to_array("features"), "label", "is_eval", F.col("draw"), batch_rows, seed)


def _fit_nets(table: DataFrame, pipeline: FeaturePipeline, widths: Sequence[int], **options) -> list[N.NetScorer]:
    """One net per width, all trained in the same steps."""
    settings = [N.NetSettings(hidden=width, **options) for width in widths]
    dealt = batch_table(table, pipeline, settings[0].batch_rows, settings[0].seed)
    return [N.NetScorer(pipeline, net) for net in N.fit_nets(dealt, settings)]


def fit_net(table: DataFrame, pipeline: FeaturePipeline, hidden: int = 32, **options) -> N.NetScorer:
    """Residual net with batch normalisation and dropout, trained by Adam; ``options`` replace those of ``nets.NetSettings``."""
    return _fit_nets(table, pipeline, [hidden], **options)[0]


def at_the_same_time(*work: Callable[[], object]) -> list:
    """Results of functions that run at the same time: threads only submit jobs, and each fills the gaps between the others'."""
    @inheritable_thread_target(SparkSession.active())
    def run(function):
        return function()

    with ThreadPool(len(work)) as pool:
        return pool.map(run, work, chunksize=1)


def fit_side_by_side(table: DataFrame, pipeline: FeaturePipeline, fits: Mapping[str, Callable]) -> dict[str, Scorer]:
    """Different models on one table at the same time."""
    return dict(zip(fits, at_the_same_time(*[partial(fit, table, pipeline) for fit in fits.values()])))


def table_log_loss(scorer: ModelScorer | B.TreeScorer | N.NetScorer, table: DataFrame) -> float:
    """Mean log-loss on the evaluation rows of a training table."""
    if isinstance(scorer, N.NetScorer):
        rows = table.where("is_eval").select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
        return N.row_losses(scorer.net, rows).agg(F.avg("loss")).first()[0]
    if isinstance(scorer, B.TreeScorer):
        values = vector_to_array("features")
        p = scorer.model.prediction([values[k] for k in range(len(scorer.model.features))])
        p = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
        rows = table.where("is_eval").select("label", p.alias("p"))
        return rows.agg(F.avg(-(F.col("label") * F.ln("p") + (1 - F.col("label")) * F.ln(1 - F.col("p"))))).first()[0]
    if isinstance(scorer, P.PerceptronScorer):
        return _mlp_losses(table, [scorer])[0]
    classifier = scorer.model.stages[-1]
    p = F.greatest(
        F.least(vector_to_array("probability")[1], F.lit(1 - 1e-15)), F.lit(1e-15)
    )
    loss = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return classifier.transform(table.where("is_eval")).agg(F.avg(loss)).first()[0]


def _mlp_losses(table: DataFrame, scorers: Sequence[ModelScorer]) -> list[float]:
    rows = table.where("is_eval").select(vector_to_array("features").alias("x"), "label")
    return P.mean_losses([scorer.model.stages[-1] for scorer in scorers], rows)


@dataclass
class Sweep:
    """One fitted model and evaluation metric per setting."""

    name: str
    settings: list
    metrics: list[float]
    scorers: list[Scorer]

    def results(self, spark: SparkSession) -> DataFrame:
        kind = "int" if isinstance(self.settings[0], int) else "double"
        return spark.createDataFrame(
            list(zip(self.settings, self.metrics)), f"{self.name} {kind}, eval_metric double"
        )

    def best(self) -> tuple[object, Scorer]:
        place = min(range(len(self.metrics)), key=self.metrics.__getitem__)
        return self.settings[place], self.scorers[place]


def sweep(
    name: str,
    settings: Sequence,
    fit: Callable[[object], Scorer],
    evaluate: Callable[[Scorer], float],
    parallelism: int = 4,
) -> Sweep:
    """Fit and evaluate every setting; ``parallelism=1`` runs them in series.

    Threads only submit jobs, so several fits share the cluster at once.
    """
    @inheritable_thread_target(SparkSession.active())
    def run(setting):
        scorer = fit(setting)
        return scorer, evaluate(scorer)

    with ThreadPool(max(1, min(parallelism, len(settings)))) as pool:
        done = pool.map(run, settings, chunksize=1)
    return Sweep(name, list(settings), [m for _, m in done], [s for s, _ in done])


def sweep_gbt(
    table: DataFrame,
    pipeline: FeaturePipeline,
    depths: Sequence[int] = tuple(DEPTHS),
    rounds: int = ROUNDS,
    step: float = STEP,
    seed: int = SPLIT_SEED,
    **options,
) -> Sweep:
    """All depths advance in the same scans; the metric is the evaluation loss of the trees that were kept."""
    scorers = _fit_gbts(table, pipeline, depths, rounds=rounds, step=step, seed=seed, **options)
    metrics = [scorer.model.models[0].losses[-1] for scorer in scorers]
    return Sweep("max_depth", list(depths), metrics, scorers)


def sweep_mlp(
    table: DataFrame,
    pipeline: FeaturePipeline,
    widths: Sequence[int] = tuple(WIDTHS),
    parallelism: int = 4,
    **options,
) -> Sweep:
    """All widths advance in the same scans, whatever the ``parallelism``."""
    scorers = _fit_mlps(table, pipeline, widths, **options)
    return Sweep("h1", list(widths), _mlp_losses(table, scorers), scorers)


def sweep_net(
    table: DataFrame, pipeline: FeaturePipeline, widths: Sequence[int] = tuple(WIDTHS), **options
) -> Sweep:
    """All widths advance in the same steps; the metric is the evaluation loss after the last round."""
    scorers = _fit_nets(table, pipeline, widths, **options)
    return Sweep("h1", list(widths), [float(scorer.net.losses[-1]) for scorer in scorers], scorers)


def mean_log_loss(df: DataFrame, logit: str, label: str) -> DataFrame:
    return df.agg(F.avg(X.log_loss(F.col(logit), F.col(label))).alias("eval_metric"))


def mean_poisson_loss(df: DataFrame, log_rate: str, label: str) -> DataFrame:
    return df.agg(F.avg(X.poisson_loss(F.col(log_rate), F.col(label))).alias("eval_metric"))


# --- frequency and severity -------------------------------------------------

@dataclass
class Bagged:
    """Models fitted on different bags of the same vectors."""

    vectoriser: PipelineModel
    models: list[GeneralizedLinearRegressionModel]

    def with_mean(self, rows: DataFrame, output: str) -> DataFrame:
        """Add the mean prediction; vectors are built once for all models."""
        names = [f"_{output}_{i}" for i in range(len(self.models))]
        rows = self.vectoriser.transform(rows)
        for name, model in zip(names, self.models):
            rows = model.copy({model.predictionCol: name}).transform(rows)
        mean = sum(F.col(name) for name in names) / len(names)
        return rows.withColumn(output, mean).drop("raw_features", "features", *names)

    def save(self, path: str) -> None:
        PipelineModel(self.models).write().overwrite().save(f"{path}/models")
        self.vectoriser.write().overwrite().save(f"{path}/vectoriser")

    @staticmethod
    def load(path: str) -> Bagged:
        return Bagged(
            PipelineModel.load(f"{path}/vectoriser"), PipelineModel.load(f"{path}/models").stages
        )


@dataclass
class FrequencySeverity:
    """Bagged claim-frequency and claim-size models over the design matrix."""

    design: DesignMatrix
    frequency: Bagged
    severity: Bagged

    def expected_claim(self, df: DataFrame, key: str = "id_policy") -> DataFrame:
        """Mean frequency times mean severity, per row."""
        rows = self.design.vectors_ready(df, [key])
        rows = self.severity.with_mean(self.frequency.with_mean(rows, "frequency"), "severity")
        return rows.select(
            key,
            "frequency",
            "severity",
            (F.col("frequency") * F.col("severity")).alias("expected_claim"),
        )

    def premium(self, df: DataFrame, key: str = "id_policy", loading: float = 0.25) -> DataFrame:
        """Expected claim plus a loading."""
        return self.expected_claim(df, key).withColumn(
            "premium", F.col("expected_claim") * F.lit(1 + loading)
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.design.save(spark, f"{path}/design")
        self.frequency.save(f"{path}/frequency")
        self.severity.save(f"{path}/severity")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FrequencySeverity:
        return FrequencySeverity(
            DesignMatrix.load(spark, f"{path}/design"),
            Bagged.load(f"{path}/frequency"),
            Bagged.load(f"{path}/severity"),
        )


def _fit_bags(
    df: DataFrame,
    design: DesignMatrix,
    key: str,
    label: Column,
    family: str,
    regularisation: float,
    parallelism: int,
) -> Bagged:
    """One generalised linear model per bag of 90 % of the rows.

    The assembled vectors are written once, scaled, and kept for the fits, which
    pass over them in every iteration. What does not fit in memory is kept on
    disk; what is lost with an executor is read again from the written table.
    """
    assembler = VectorAssembler(inputCols=design.columns, outputCol="raw_features")
    flagged = with_bag_flags(df.withColumn("label", label), key, 0.9, BAG_SEEDS)
    encoded = assembler.transform(design.vectors_ready(flagged, ["label", *BAG_SEEDS]))
    table = materialise(encoded.select("raw_features", "label", *BAG_SEEDS), family)
    scaler = StandardScaler(inputCol="raw_features", outputCol="features").fit(table)
    options = {"variancePower": 1.5, "linkPower": 0.0} if family == "tweedie" else {"link": "log"}
    trainer = GeneralizedLinearRegression(family=family, regParam=regularisation, **options)
    scaled = scaler.transform(table).select("features", "label", *BAG_SEEDS)
    scaled.persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(SparkSession.active())
    def run(bag: str) -> GeneralizedLinearRegressionModel:
        return trainer.fit(scaled.where(F.col(bag)))

    try:
        with ThreadPool(max(1, parallelism)) as pool:
            models = pool.map(run, list(BAG_SEEDS), chunksize=1)
    finally:
        scaled.unpersist()
    return Bagged(PipelineModel([assembler, scaler]), models)


def fit_frequency_severity(
    df: DataFrame,
    key: str = "id_policy",
    amount: str = "claim_amount",
    make_model_levels: Sequence[str] | None = None,
    regularisation: float = 1e-3,
    parallelism: int = 5,
) -> FrequencySeverity:
    """Five Poisson models of claim occurrence and, on rows with a claim, five
    gamma models of its size; each on its own 90 % of the rows."""
    known = df.where(F.col(amount).isNotNull())
    design = fit_design_matrix(known, make_model_levels)
    claims = known.where(F.col(amount) > 0)
    event, options = X.positive_flag(F.col(amount)), (regularisation, parallelism)
    return FrequencySeverity(
        design,
        _fit_bags(known, design, key, event, "poisson", *options),
        _fit_bags(claims, design, key, F.col(amount), "gamma", *options),
    )


@dataclass
class PurePremium:
    """Bagged models of the claim amount itself, fitted in units of ``scale``."""

    design: DesignMatrix
    models: Bagged
    scale: float

    def expected_claim(self, df: DataFrame, key: str = "id_policy") -> DataFrame:
        rows = self.models.with_mean(self.design.vectors_ready(df, [key]), "_claim")
        return rows.select(key, (F.col("_claim") * F.lit(self.scale)).alias("expected_claim"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.design.save(spark, f"{path}/design")
        self.models.save(f"{path}/models")
        spark.createDataFrame([(self.scale,)], "scale double").write.mode("overwrite").parquet(f"{path}/scale")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PurePremium:
        scale = spark.read.parquet(f"{path}/scale").first()["scale"]
        return PurePremium(DesignMatrix.load(spark, f"{path}/design"), Bagged.load(f"{path}/models"), scale)


def fit_pure_premium(
    df: DataFrame,
    key: str = "id_policy",
    amount: str = "claim_amount",
    make_model_levels: Sequence[str] | None = None,
    regularisation: float = 1e-3,
    parallelism: int = 5,
) -> PurePremium:
    """Five Tweedie models of the claim amount, zeros included.

    Amounts are divided by their mean first: the solver starts zeros at a fixed
    small value, which only suits labels around one.
    """
    known = df.where(F.col(amount).isNotNull())
    design = fit_design_matrix(known, make_model_levels)
    scale = known.agg(F.avg(amount)).first()[0] or 1.0
    label = F.col(amount) / F.lit(scale)
    models = _fit_bags(known, design, key, label, "tweedie", regularisation, parallelism)
    return PurePremium(design, models, scale)


# --- frequency, severity and pure premium by boosted trees ---------------------

def _bagged_trees(
    df: DataFrame, design: DesignMatrix, key: str, label: Column, settings: B.TreeSettings, bins: int
) -> B.BoostedTrees:
    """One model per bag of 90 % of the rows, all five grown in the same scans of one table of bins."""
    flagged = with_bag_flags(df.withColumn("label", label), key, 0.9, BAG_SEEDS)
    ready = design.vectors_ready(flagged.withColumn("_draw", F.xxhash64(F.col(key))), ["label", "_draw", *BAG_SEEDS])
    roles = [F.when(F.col(bag), B.TRAIN).otherwise(B.EVAL) for bag in BAG_SEEDS]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in design.columns])
    binned = B.bin_rows(ready, design.columns, values, "label", roles, F.col("_draw"), bins)
    bags = [replace(settings, fold=k, seed=seed) for k, seed in enumerate(BAG_SEEDS.values())]
    return B.fit_boosted(binned, bags)


@dataclass
class TreeFrequencySeverity:
    """Bagged trees of claim frequency (Poisson) and claim size (gamma) over the design matrix."""

    design: DesignMatrix
    frequency: B.BoostedTrees
    severity: B.BoostedTrees

    def expected_claim(self, df: DataFrame, key: str = "id_policy") -> DataFrame:
        """Mean frequency times mean severity, per row."""
        rows = self.design.vectors_ready(df, [key]).select(
            key, self.frequency.prediction().alias("frequency"), self.severity.prediction().alias("severity")
        )
        return rows.withColumn("expected_claim", F.col("frequency") * F.col("severity"))

    def premium(self, df: DataFrame, key: str = "id_policy", loading: float = 0.25) -> DataFrame:
        """Expected claim plus a loading."""
        return self.expected_claim(df, key).withColumn("premium", F.col("expected_claim") * F.lit(1 + loading))

    def save(self, spark: SparkSession, path: str) -> None:
        self.design.save(spark, f"{path}/design")
        self.frequency.save(spark, f"{path}/frequency")
        self.severity.save(spark, f"{path}/severity")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeFrequencySeverity:
        return TreeFrequencySeverity(
            DesignMatrix.load(spark, f"{path}/design"),
            B.BoostedTrees.load(spark, f"{path}/frequency"),
            B.BoostedTrees.load(spark, f"{path}/severity"),
        )


def fit_tree_frequency_severity(
    df: DataFrame,
    key: str = "id_policy",
    amount: str = "claim_amount",
    make_model_levels: Sequence[str] | None = None,
    frequency: B.TreeSettings = B.FREQUENCY,
    severity: B.TreeSettings = B.SEVERITY,
) -> TreeFrequencySeverity:
    """Five Poisson models of claim occurrence and, on rows with a claim, five gamma models of its size."""
    known = df.where(F.col(amount).isNotNull())
    design = fit_design_matrix(known, make_model_levels)
    claims = known.where(F.col(amount) > 0)
    event = X.positive_flag(F.col(amount))
    return TreeFrequencySeverity(design, *at_the_same_time(
        lambda: _bagged_trees(known, design, key, event, frequency, B.FREQUENCY_BINS),
        lambda: _bagged_trees(claims, design, key, F.col(amount), severity, B.SEVERITY_BINS),
    ))


@dataclass
class TreePurePremium:
    """Bagged Tweedie trees of the claim amount itself, fitted in units of ``scale``."""

    design: DesignMatrix
    models: B.BoostedTrees
    scale: float

    def expected_claim(self, df: DataFrame, key: str = "id_policy") -> DataFrame:
        rows = self.design.vectors_ready(df, [key])
        return rows.select(key, (self.models.prediction() * F.lit(self.scale)).alias("expected_claim"))


def fit_tree_pure_premium(
    df: DataFrame,
    key: str = "id_policy",
    amount: str = "claim_amount",
    make_model_levels: Sequence[str] | None = None,
    settings: B.TreeSettings = B.PURE_PREMIUM,
) -> TreePurePremium:
    """Five Tweedie models of the claim amount, zeros included. Amounts are divided by their mean, so that the
    penalties mean the same whatever the currency."""
    known = df.where(F.col(amount).isNotNull())
    design = fit_design_matrix(known, make_model_levels)
    scale = known.agg(F.avg(amount)).first()[0] or 1.0
    label = F.col(amount) / F.lit(scale)
    return TreePurePremium(design, _bagged_trees(known, design, key, label, settings, B.PURE_PREMIUM_BINS), scale)
