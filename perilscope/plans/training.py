"""Queries that fit models. SQL follows them where theory determines the result;
tests check the other properties."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from perilscope.operators import boosting as B
from perilscope.operators import models as M
from perilscope.operators import nets as N
from perilscope.operators.explain import IMPORTANCE_FEATURES, shap_by_model, shap_importance
from perilscope.operators.features import MODEL_FEATURES
from perilscope.operators.selection import drop_incomplete
from perilscope.operators.sampling import sample_rows, with_bag_flags
from perilscope.operators.scoring import score_difference, with_scores
from perilscope.plans.catalog import PREPARED, fitted, labelled, query, rounded, select_policies, with_policies
from perilscope.plans.explain import FEATURES
from perilscope.session import job_folder
from perilscope.sources import files


def _training(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    return df, pipeline, M.training_table(df, pipeline, "event", "is_train")


def _both(spark, sf_dir):
    df, pipeline, table = _training(spark, sf_dir)
    return df, M.fit_side_by_side(table, pipeline, {"net": M.fit_mlp, "gbt": M.fit_gbt})


@query("gbt_score")
def gbt_score(spark, sf_dir):
    df, pipeline, table = _training(spark, sf_dir)
    return rounded(M.fit_gbt(table, pipeline)(df, "score").select("id_policy", "score"), "score")


@query("mlp_score")
def mlp_score(spark, sf_dir):
    df, pipeline, table = _training(spark, sf_dir)
    return rounded(M.fit_mlp(table, pipeline)(df, "score").select("id_policy", "score"), "score")


#: Rounds, batches and steps of the registered nets: fewer and larger than the settings' own.
SHORT_NET = {"rounds": 5, "batch_rows": 8192, "step": 0.01}


@query("residual_net_score")
def residual_net_score(spark, sf_dir):
    df, pipeline, table = _training(spark, sf_dir)
    return rounded(M.fit_net(table, pipeline, **SHORT_NET)(df, "score").select("id_policy", "score"), "score")


@query("residual_net_sweep")
def residual_net_sweep(spark, sf_dir):
    _, pipeline, table = _training(spark, sf_dir)
    return M.sweep_net(table, pipeline, **SHORT_NET).results(spark)


def _net_gradient_sql() -> str:
    logit = " + ".join(f"{k + 1} * cast(0.01 as double) * greatest({f}, 0)" for k, f in enumerate(MODEL_FEATURES))
    moments = ", ".join(f"avg({f}) as m_{f}, var_pop({f}) as v_{f}" for f in MODEL_FEATURES)
    normal = ", ".join(f"({f} - m_{f}) / sqrt(v_{f} + cast(1e-5 as double)) as {f}" for f in MODEL_FEATURES)
    rows = " union all ".join(
        f"select '{f}' as feature, round(avg(slope * greatest({f}, 0)), 6) + 0 as output_weight, "
        f"round(avg(slope * {k + 1} * cast(0.01 as double) * greatest({f}, 0)), 6) + 0 as scale from scored"
        for k, f in enumerate(MODEL_FEATURES)
    )
    return with_policies(PREPARED + f""",
training as (select * from prepared where is_train and event is not null),
moments as (select {moments} from training),
normal as (select event, {normal} from training cross join moments),
scored as (select *, 1 / (1 + exp(-({logit}))) - event as slope from normal)
{rows}""")


@query("net_step_gradient", _net_gradient_sql())
def net_step_gradient(spark, sf_dir):
    """Gradient over all training rows, as one batch, of a net whose layers pass every input's positive part on."""
    _, pipeline, table = _training(spark, sf_dir)
    d = len(pipeline.features)
    dealt = M.batch_table(table, pipeline, batch_rows=table.count())
    settings = N.NetSettings(hidden=d, dropout=0.0)
    weights = {name: np.zeros(shape) for name, shape in zip(N.LAYERS, N.shapes(d, d))}
    weights["scale"][:] = 1
    weights["w1"][:], weights["w2"][:] = np.eye(d), np.eye(d, N.INNER)
    weights["w4"][:d] = np.arange(1, d + 1) * 0.01
    found = N.shaped(N.step_gradient(dealt, dealt.batches[0], [weights], 0, [settings])[0], d, d)
    rows = zip(pipeline.features, found["w4"][:d].tolist(), found["scale"].tolist())
    out = spark.createDataFrame(list(rows), "feature string, output_weight double, scale double")
    return out.withColumns({c: F.round(c, 6) + 0 for c in ("output_weight", "scale")})


@query("gbt_sweep")
def gbt_sweep(spark, sf_dir):
    _, pipeline, table = _training(spark, sf_dir)
    return M.sweep_gbt(table, pipeline).results(spark)


@query("mlp_sweep")
def mlp_sweep(spark, sf_dir):
    _, pipeline, table = _training(spark, sf_dir)
    return M.sweep_mlp(table, pipeline).results(spark)


@query("best_model")
def best_model(spark, sf_dir):
    """Sweep, keep the best, save it, load it again and score with it."""
    df, pipeline, table = _training(spark, sf_dir)
    done = M.sweep_gbt(table, pipeline)
    depth, scorer = done.best()
    path = job_folder(spark, "best-model")
    files.save_scorer(scorer, spark, path)
    scored = files.load_scorer(spark, path)(df, "score").select("id_policy", "score")
    return rounded(scored.withColumn("max_depth", F.lit(depth)), "score")


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    df, pipeline, table = _training(spark, sf_dir)
    path = job_folder(spark, "model")
    files.save_scorer(M.fit_mlp(table, pipeline), spark, path)
    return rounded(files.load_scorer(spark, path)(df, "score").select("id_policy", "score"), "score")


@query("paired_scores")
def paired_scores(spark, sf_dir):
    df, scorers = _both(spark, sf_dir)
    out = with_scores(drop_incomplete(df), scorers)
    return rounded(out.select("id_policy", "event", "net", "gbt"), "net", "gbt")


@query("fitted_model_spread")
def fitted_model_spread(spark, sf_dir):
    df, scorers = _both(spark, sf_dir)
    out = score_difference(df, scorers, minus="net", plus="gbt")
    return rounded(out.select("id_policy", "net", "gbt", "spread"), "net", "gbt", "spread")


@query("fitted_importance")
def fitted_importance(spark, sf_dir):
    df, scorers = _both(spark, sf_dir)
    whole = drop_incomplete(df)
    shap = shap_by_model(
        sample_rows(whole, "id_policy", 50), "id_policy", scorers,
        features=FEATURES, targets=IMPORTANCE_FEATURES, reference=whole,
    )
    return rounded(shap_importance(shap, ["model"]), "shap_effect")


@query("freq_sev_expected_claim")
def freq_sev_expected_claim(spark, sf_dir):
    df = labelled(spark, sf_dir)
    out = M.fit_frequency_severity(df).expected_claim(df)
    return rounded(out, "frequency", "severity", "expected_claim")


@query("premium")
def premium(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return rounded(
        M.fit_frequency_severity(df).premium(df).select("id_policy", "expected_claim", "premium"),
        "expected_claim", "premium",
    )


@query("premium_rule", select_policies("select id_policy, true as is_loaded from policies"))
def premium_rule(spark, sf_dir):
    """Every price is the expected claim and a quarter, from a model saved and loaded."""
    df = labelled(spark, sf_dir)
    path = job_folder(spark, "premium")
    M.fit_frequency_severity(df).save(spark, path)
    priced = M.FrequencySeverity.load(spark, path).premium(df)
    loaded = F.abs(F.col("premium") - 1.25 * F.col("expected_claim")) <= 1e-9 * F.col("premium")
    return priced.select("id_policy", loaded.alias("is_loaded"))


@query("predict_batch", select_policies("""
select 'claims' as output, count(*) as n, true as as_expected from policies
union all select 'prices', count(*), true from policies"""))
def predict_batch(spark, sf_dir):
    """Both outputs of the batch job, compared with the model's own figures in key order."""
    df = labelled(spark, sf_dir)
    source, model = job_folder(spark, "dataset"), job_folder(spark, "premium")
    files.write_csv(df.drop("event"), source)
    fitted_model = M.fit_frequency_severity(df)
    fitted_model.save(spark, model)
    own = fitted_model.premium(df).agg(F.sum("expected_claim").alias("claims"), F.sum("premium").alias("prices")).first()
    results = []
    for output in ("claims", "prices"):
        path = job_folder(spark, output)
        files.predict_batch(spark, source, model, path, output)
        n, total = spark.read.schema("value double").csv(path).agg(F.count("value"), F.sum("value")).first()
        results.append((output, n, abs(total - own[output]) <= 1e-6 * own[output]))
    return spark.createDataFrame(results, "output string, n long, as_expected boolean")


@query("frequency_balance", select_policies("\nunion all ".join(
    f"select 'bag_{i}' as bag, cast(sum(case when claim_amount > 0 then 1 else 0 end) as double) as events from policies "
    f"where md5('{123 + i}:' || cast(id_policy as varchar)) in (select md5('{123 + i}:' || cast(id_policy as varchar)) as d "
    f"from policies order by d limit cast(floor(0.9 * (select count(*) from policies)) as bigint))"
    for i in range(1, 6))))
def frequency_balance(spark, sf_dir):
    """A Poisson model with a log link and a free intercept gives back the events of its own bag."""
    df = labelled(spark, sf_dir)
    frequency = M.fit_frequency_severity(df)
    rows = with_bag_flags(df, "id_policy", 0.9, M.BAG_SEEDS)
    rows = frequency.frequency.vectoriser.transform(frequency.design.vectors_ready(rows, list(M.BAG_SEEDS)))
    sums = []
    for bag, model in zip(M.BAG_SEEDS, frequency.frequency.models):
        fitted_rows = model.copy({model.predictionCol: "fitted"}).transform(rows.where(F.col(bag)))
        sums.append(fitted_rows.agg(F.lit(bag).alias("bag"), F.round(F.sum("fitted"), 3).alias("events")))
    return reduce(lambda a, b: a.unionByName(b), sums)


@query("glm_group_rates", select_policies("""
select pol_coverage, round(avg(case when claim_amount > 0 then 1 else 0 end), 5) as rate from policies
where pol_coverage is not null group by pol_coverage"""))
def glm_group_rates(spark, sf_dir):
    """An unpenalised Poisson model of one factor gives the groups' rates."""
    df = labelled(spark, sf_dir).where("pol_coverage is not null")
    levels = ["Med1", "Med2", "Max"]
    flags = [(F.col("pol_coverage") == level).cast("double").alias(f"is_{level}") for level in levels]
    rows = df.select("pol_coverage", F.col("event").cast("double").alias("label"), *flags)
    rows = VectorAssembler(inputCols=[f"is_{level}" for level in levels], outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(family="poisson", link="log", tol=1e-10, maxIter=50).fit(rows)
    return model.transform(rows).groupBy("pol_coverage").agg(F.round(F.avg("prediction"), 5).alias("rate"))


@query("pure_premium")
def pure_premium(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return rounded(M.fit_pure_premium(df).expected_claim(df), "expected_claim")


# --- boosted trees ---------------------------------------------------------------

# One tree of depth 1 per objective; its gain and leaves have a closed form.
STUMP_EDGES = {
    "vh_value": [10000.0, 20000.0, 30000.0, 42000.0],
    "drv_age1": [27.0, 30.0, 40.0, 50.0, 60.0, 70.0],
    "vh_speed": [130.0, 150.0, 170.0, 190.0],
}
STUMPS = {
    "logistic": B.replace(B.EVENT, max_depth=1, rounds=1, row_share=1.0, column_share=1.0, patience=None),
    "poisson": B.replace(B.FREQUENCY, max_depth=1, rounds=1, row_share=1.0, column_share=1.0),
    "gamma": B.replace(B.SEVERITY, max_depth=1, rounds=1, row_share=1.0, column_share=1.0),
    "tweedie": B.replace(B.PURE_PREMIUM, max_depth=1, rounds=1, row_share=1.0, column_share=1.0),
}
STUMP_LABELS = {
    "logistic": "event", "poisson": "event",
    "gamma": "case when claim_amount > 0 then claim_amount / 1000 end", "tweedie": "claim_amount / 1000",
}
STUMP_SLOPES = {
    "logistic": ("1 / (1 + exp(-m)) - y", "exp(-m) / ((1 + exp(-m)) * (1 + exp(-m)))", "ln(a / (1 - a))"),
    "poisson": ("exp(m) - y", "exp(m)", "ln(a)"),
    "gamma": ("1 - y * exp(-m)", "y * exp(-m)", "ln(a)"),
    "tweedie": ("exp(0.5 * m) - y * exp(-0.5 * m)", "0.5 * exp(0.5 * m) + 0.5 * y * exp(-0.5 * m)", "ln(a)"),
}


def _stump_sql() -> str:
    """Rows of every objective, sums beside every edge, gains, and the best cut."""
    rows, sums = [], []
    for name, s in STUMPS.items():
        g, h, link = STUMP_SLOPES[name]
        numbers = f"cast({s.l2} as double) as l2, cast({s.l1} as double) as l1, cast({s.min_gain} as double) as least, " \
            f"cast({s.min_curvature} as double) as curvature, cast({s.step} as double) as step, " \
            f"cast({s.max_step or 1e9} as double) as most"
        rows.append(
            f"select '{name}' as objective, vh_value, drv_age1, vh_speed, m, {g} as g, {h} as h, {numbers} from "
            f"(select *, {STUMP_LABELS[name]} as y from labelled where {STUMP_LABELS[name]} is not null), "
            f"(select {link} as m from (select avg({STUMP_LABELS[name]}) as a from labelled))"
        )
    for k, (feature, edges) in enumerate(STUMP_EDGES.items()):
        for edge in edges:
            sums.append(
                f"select objective, {k} as place, '{feature}' as name, cast({edge} as double) as edge, any_value(m) as m, "
                "any_value(l2) as l2, any_value(l1) as l1, any_value(least) as least, any_value(curvature) as curvature, "
                "any_value(step) as step, any_value(most) as most, sum(g) as g, sum(h) as h, "
                f"sum(case when {feature} <= {edge} then g else 0 end) as gl, sum(case when {feature} <= {edge} then h else 0 end) as hl "
                "from sloped group by objective"
            )
    soft = "(sign({0}) * greatest(abs({0}) - l1, 0))"
    parts = {k: soft.format(v) for k, v in {"all": "g", "left": "gl", "right": "(g - gl)"}.items()}
    return (
        ",\nsloped as (" + "\nunion all ".join(rows) + "),\nsums as (" + "\nunion all ".join(sums) + "),\n"
        f"cuts as (select *, ({parts['left']} * {parts['left']} / (hl + l2) + {parts['right']} * {parts['right']} / (h - hl + l2) "
        f"- {parts['all']} * {parts['all']} / (h + l2)) / 2 - least as gain, "
        f"step * greatest(least(-{parts['left']} / (hl + l2), most), -most) as low, "
        f"step * greatest(least(-{parts['right']} / (h - hl + l2), most), -most) as high "
        "from sums where hl >= curvature and h - hl >= curvature),\n"
        "best as (select * from (select *, row_number() over (partition by objective order by gain desc, place, edge) as k from cuts) where k = 1)"
    )


def _stump(df, objective):
    """A fitted tree of depth 1 over raw columns."""
    values = F.array(*[F.col(c).cast("double") for c in STUMP_EDGES])
    rows = df.withColumn("_label", F.expr(STUMP_LABELS[objective]))
    binned = B.bin_rows(
        rows, list(STUMP_EDGES), values, "_label", [F.lit(B.TRAIN)], F.xxhash64("id_policy"), edges=list(STUMP_EDGES.values())
    )
    return B.fit_boosted(binned, [STUMPS[objective]])


@query("boosted_stumps", with_policies(_stump_sql() + """
select objective, name, edge, round(gain, 2) as gain, round(low, 6) as low, round(high, 6) as high from best"""))
def boosted_stumps(spark, sf_dir):
    """The first cut of a boosted tree by each objective, its gain and its leaves."""
    df = labelled(spark, sf_dir)
    found = []
    for objective in STUMPS:
        nodes = _stump(df, objective).nodes(spark)
        leaves = nodes.groupBy().agg(
            F.max(F.when(F.col("node") == 0, F.col("name"))).alias("name"), F.max(F.when(F.col("node") == 0, F.col("edge"))).alias("edge"),
            F.round(F.max(F.when(F.col("node") == 0, F.col("gain"))), 2).alias("gain"),
            F.round(F.max(F.when(F.col("node") == 1, F.col("value"))), 6).alias("low"),
            F.round(F.max(F.when(F.col("node") == 2, F.col("value"))), 6).alias("high"),
        )
        found.append(leaves.select(F.lit(objective).alias("objective"), "*"))
    return reduce(lambda a, b: a.unionByName(b), found)


def _stump_mean_sql(objective: str) -> str:
    cut = " ".join(f"when name = '{f}' then {f} <= edge" for f in STUMP_EDGES)
    return f"m + case when case {cut} end then low else high end"


@query("stump_scores", with_policies(_stump_sql() + f"""
select id_policy, round(1 / (1 + exp(-({_stump_mean_sql("logistic")}))), 6) as score
from labelled, best where objective = 'logistic'"""))
def stump_scores(spark, sf_dir):
    """Scores of all policies by a fitted model, saved and loaded before."""
    df = labelled(spark, sf_dir)
    path = job_folder(spark, "stump")
    _stump(df, "logistic").save(spark, path)
    model = B.BoostedTrees.load(spark, path)
    return rounded(df.select("id_policy", model.prediction().alias("score")), "score")


@query("stump_expected_claim", with_policies(_stump_sql() + f""",
frequencies as (select id_policy, exp({_stump_mean_sql("poisson")}) as frequency from labelled, best where objective = 'poisson'),
severities as (select id_policy, 1000 * exp({_stump_mean_sql("gamma")}) as severity from labelled, best where objective = 'gamma')
select id_policy, round(frequency, 6) as frequency, round(severity, 2) as severity, round(frequency * severity, 2) as expected_claim
from frequencies join severities using (id_policy)"""))
def stump_expected_claim(spark, sf_dir):
    """Frequency times severity by one tree each."""
    df = labelled(spark, sf_dir)
    frequency, severity = _stump(df, "poisson").prediction(), 1000 * _stump(df, "gamma").prediction()
    return df.select(
        "id_policy", F.round(frequency, 6).alias("frequency"), F.round(severity, 2).alias("severity"),
        F.round(frequency * severity, 2).alias("expected_claim"),
    )


#: Rounds of the registered tree models: fewer and longer steps than the settings' own.
SHORT = {"rounds": 20, "step": 0.2}


def _trees(df):
    return M.fit_tree_frequency_severity(df, frequency=B.replace(B.FREQUENCY, **SHORT), severity=B.replace(B.SEVERITY, **SHORT))


@query("tree_expected_claim")
def tree_expected_claim(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return rounded(_trees(df).expected_claim(df), "frequency", "severity", "expected_claim")


@query("tree_pure_premium")
def tree_pure_premium(spark, sf_dir):
    df = labelled(spark, sf_dir)
    out = M.fit_tree_pure_premium(df, settings=B.replace(B.PURE_PREMIUM, **SHORT)).expected_claim(df)
    return rounded(out, "expected_claim")


@query("tree_balance", select_policies("""
select 'frequency' as model, cast(sum(case when claim_amount > 0 then 1 else 0 end) as double) as observed, true as is_near from policies
union all select 'severity', round(sum(case when claim_amount > 0 then claim_amount end), 2), true from policies
union all select 'pure premium', round(sum(claim_amount), 2), true from policies"""))
def tree_balance(spark, sf_dir):
    """Fitted sums are within 5 % of the observed ones: of events, of claims on rows with one, of claims on all rows."""
    df = labelled(spark, sf_dir)
    trees, pure = M.at_the_same_time(
        lambda: _trees(df), lambda: M.fit_tree_pure_premium(df, settings=B.replace(B.PURE_PREMIUM, **SHORT))
    )
    ready = trees.design.vectors_ready(df, ["event", "claim_amount"])
    sums = ready.select(
        "event", "claim_amount", trees.frequency.prediction().alias("f"), trees.severity.prediction().alias("s"),
        (pure.models.prediction() * pure.scale).alias("p"),
    ).agg(
        F.sum("event").alias("events"), F.sum("f").alias("f"),
        F.sum(F.when(F.col("event") > 0, F.col("claim_amount"))).alias("claims"), F.sum(F.when(F.col("event") > 0, F.col("s"))).alias("s"),
        F.sum("claim_amount").alias("total"), F.sum("p").alias("p"),
    )
    rows = [
        F.struct(F.lit(name).alias("model"), F.round(observed, 2).alias("observed"), (F.abs(F.col(fitted_sum) - F.col(observed)) <= 0.05 * F.col(observed)).alias("is_near"))
        for name, observed, fitted_sum in (("frequency", "events", "f"), ("severity", "claims", "s"), ("pure premium", "total", "p"))
    ]
    return sums.select(F.inline(F.array(*rows)))
