"""Named queries of models per series. Their SQL fits the same models by Newton's method, so values are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from newstape.operators import modeling, series_models
from newstape.plans.catalog import CV_SQL, day_scores, query, rounded, scratch, sql
from newstape.session import cut_lineage
from newstape.sources import models, views

#: Features of the fits that SQL repeats.
TRAINED = ("close", "volume", "sentiment_score")
VALIDATED = ("daily_return", "high_low_ratio", "sentiment_ma2")


def newton_sql(name: str, source: str, keys: str, features: Sequence[str], weight: str = "1.0::double", steps: int = 9, c: float = 1.0) -> str:
    """Common table expressions up to ``<name>``: one row of weights w0, w1, ... (the last is the intercept) per model.

    Every step adds up gradient and Hessian and solves the system by elimination.
    """
    m, xs = len(features) + 1, [*features, "1.0::double"]
    ws = ", ".join(f"w{i}" for i in range(m))
    parts = [f"{name}_0 as (select {keys}, {', '.join(f'0.0::double as w{i}' for i in range(m))} from {source} group by {keys})"]
    linear = " + ".join(f"w{i} * {x}" for i, x in enumerate(xs))
    for t in range(steps):
        here = f"{name}_{t}"
        parts.append(f"{here}_p as materialized (select *, 1 / (1 + exp(-({linear}))) as p from {source} join {here} using ({keys}))")
        ridge = [f"/ {float(c)}::double"] * (m - 1) + ["* 0"]
        slopes = [f"sum({weight} * (p - target) * {x}) + any_value(w{i}) {ridge[i]} as b{i}" for i, x in enumerate(xs)]
        bends = [
            f"sum({weight} * p * (1 - p) * {xs[i]} * {xs[j]}) + {1.0 / c if i == j < m - 1 else 0.0}::double as a{i}_{j}"
            for i in range(m) for j in range(i, m)
        ]
        olds = ", ".join(f"any_value(w{i}) as w{i}" for i in range(m))
        parts.append(f"{here}_e0 as materialized (select {keys}, {olds}, {', '.join(slopes + bends)} from {here}_p group by {keys})")
        for k in range(m - 1):
            rows = [f"b{i}" for i in range(k + 1)] + [f"a{i}_{j}" for i in range(k + 1) for j in range(i, m)]
            rows += [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} as b{i}" for i in range(k + 1, m)]
            rows += [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} as a{i}_{j}" for i in range(k + 1, m) for j in range(i, m)]
            parts.append(f"{here}_e{k + 1} as materialized (select {keys}, {ws}, {', '.join(rows)} from {here}_e{k})")
        last = f"{here}_e{m - 1}"
        for k in range(m - 1, -1, -1):
            known = "".join(f" - a{k}_{j} * d{j}" for j in range(k + 1, m))
            parts.append(f"{here}_d{k} as materialized (select *, (b{k}{known}) / a{k}_{k} as d{k} from {last})")
            last = f"{here}_d{k}"
        target = name if t == steps - 1 else f"{name}_{t + 1}"
        parts.append(f"{target} as materialized (select {keys}, {', '.join(f'w{i} - d{i} as w{i}' for i in range(m))} from {last})")
    return ",\n".join(parts)


def _scaled(column: str, keys: str, scope: str = "") -> str:
    part = f"{scope} over (partition by {keys})"
    return f"({column} - avg({column}) {part}) / case when stddev_pop({column}) {part} = 0 then 1 else stddev_pop({column}) {part} end as {column}"


TRAIN_SQL = f"""
moves as (select *, lead(close) over (partition by ticker order by date) - close as chg from joined),
own_split as (select * exclude (chg), cast(chg > 0 as int) as target,
                 case when row_number() over (partition by ticker order by date) - 1
                           < floor(count(*) over (partition by ticker) * (1 - 0.2::double)) then 'train' else 'test' end as role
          from moves where chg is not null),
zs as (select ticker, date, target, role, {', '.join(_scaled(c, 'ticker', "filter (role = 'train')") for c in TRAINED)} from own_split),
fitrows as materialized (select * from zs where role = 'train'),
{newton_sql("fit", "fitrows", "ticker", TRAINED)},
own_rated as (select zs.*, 1 / (1 + exp(-({' + '.join(f'w{i} * {c}' for i, c in enumerate(TRAINED))} + w{len(TRAINED)}))) as probability
          from zs join fit using (ticker) where role = 'test')
"""


def long_sql(fit: str, keys: str, features: Sequence[str], name: str, value: str = "{}") -> str:
    names = [*features]
    return " union all ".join(f"select {keys}, '{f}' as {name}, {value.format(f'w{i}')} as coefficient from {fit}" for i, f in enumerate(names))


def _trained(spark, d):
    return series_models.train_by_series(views.bars(spark, d), day_scores(spark, d), TRAINED)


@query(
    "train_lr_by_ticker",
    sql(
        f"select ticker, feature, round(coefficient, 5) as coefficient from ({long_sql('fit', 'ticker', [*TRAINED, 'intercept'], 'feature')})",
        "joined",
        extra=TRAIN_SQL,
    ),
)
def train_lr_by_ticker(spark, d):
    """The weights of every ticker's own model."""
    return rounded(series_models.coefficients(_trained(spark, d)["models"], TRAINED), 5)


@query(
    "predict_by_ticker",
    sql("select ticker, date, target, round(probability, 5) as probability from own_rated", "joined", extra=TRAIN_SQL),
)
def predict_by_ticker(spark, d):
    return rounded(_trained(spark, d)["predictions"].select("ticker", "date", "target", "probability"), 5)


@query(
    "eval_lr_by_ticker",
    sql(
        """select ticker, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision",
                  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1
           from (select ticker, count(*) filter (target = 1 and probability > 0.5) as tp, count(*) filter (target = 0 and probability <= 0.5) as tn,
                        count(*) filter (target = 0 and probability > 0.5) as fp, count(*) filter (target = 1 and probability <= 0.5) as fn
                 from own_rated group by 1)""",
        "joined",
        extra=TRAIN_SQL,
    ),
)
def eval_lr_by_ticker(spark, d):
    """Every ticker's own model rated on its own test rows."""
    return rounded(_trained(spark, d)["results"].select("ticker", "accuracy", "precision", "recall", "f1"))


VALIDATE_SQL = (
    CV_SQL.replace("complete as (select ticker, date, target from feats", f"complete as (select ticker, date, target, {', '.join(VALIDATED)} from feats")
    + f""",
zs as (select ticker, date, target, {', '.join(_scaled(c, 'ticker') for c in VALIDATED)} from complete),
own_parts as (select zs.*, fold, role from zs join long using (ticker, date)),
own_sizes as (select ticker, fold, count(*) filter (role = 'train') as train_rows, count(*) filter (role = 'test') as test_rows,
                 count(*) filter (role = 'train' and own_parts.target = 1) as ups, count(*) filter (role = 'test' and own_parts.target = 1) as test_ups
          from own_parts group by 1, 2),
fitrows as materialized (select own_parts.*, train_rows / (2.0::double * case target when 1 then ups else train_rows - ups end) as share
                         from own_parts join own_sizes using (ticker, fold) where role = 'train' and ups between 1 and train_rows - 1 and train_rows >= 30),
{newton_sql("fit", "fitrows", "ticker, fold", VALIDATED, "share")},
own_scored as (select ticker, fold, avg(cast((({' + '.join(f'w{i} * {c}' for i, c in enumerate(VALIDATED))} + w{len(VALIDATED)}) > 0) = (target = 1) as int)) as accuracy
           from own_parts join fit using (ticker, fold) where role = 'test' group by 1, 2),
judged as (select ticker, fold, train_rows, test_rows, cast(ups > train_rows - ups as int) as majority_class,
                  case when ups > train_rows - ups then test_ups else test_rows - test_ups end / test_rows as baseline, accuracy
           from own_sizes left join own_scored using (ticker, fold))
"""
)


def _validated(spark, d):
    return series_models.cross_validate_by_series(views.bars(spark, d), day_scores(spark, d), VALIDATED)


@query(
    "crossval_by_ticker",
    sql(
        "select ticker, fold, train_rows, test_rows, majority_class, round(baseline, 6) as baseline, round(accuracy, 6) as accuracy from judged",
        "joined",
        extra=VALIDATE_SQL,
    ),
)
def crossval_by_ticker(spark, d):
    return rounded(_validated(spark, d)["folds"])


@query(
    "crossval_summary_by_ticker",
    sql(
        """select ticker, round(avg(accuracy), 6) as avg_accuracy, round(avg(baseline), 6) as avg_baseline,
                  round(avg(accuracy) - avg(baseline), 6) as improvement from judged group by 1""",
        "joined",
        extra=VALIDATE_SQL,
    ),
)
def crossval_summary_by_ticker(spark, d):
    return rounded(_validated(spark, d)["summary"])


@query(
    "importance_by_ticker",
    sql(
        f"""select ticker, feature, round(avg(coefficient), 4) as average_coefficient, cast(rank() over (partition by ticker order by avg(coefficient) desc) as int) as place
            from ({long_sql('fit', 'ticker, fold', VALIDATED, 'feature')}) group by ticker, feature""",
        "joined",
        extra=VALIDATE_SQL,
    ),
)
def importance_by_ticker(spark, d):
    """Mean weight of each feature over a ticker's folds, and its place from the largest down."""
    found = _validated(spark, d)["importance"]
    return rounded(series_models.ranked_importance(found), 4)


#: Rounds, depth and cuts (of z-scores) of the boosted fit that SQL repeats.
BOOST_ROUNDS, BOOST_DEPTH, BOOST_CUTS = 4, 2, (-1.25, -0.65, -0.15, 0.35, 0.85, 1.45)


def boost_sql(rounds: int = BOOST_ROUNDS, depth: int = BOOST_DEPTH, rate: float = 0.1) -> str:
    """Second-order boosting step by step: ``grown`` (one row per node) and ``ended`` (all rows with their last margin)."""
    value = "case f " + " ".join(f"when {i} then {x}" for i, x in enumerate(TRAINED)) + " end"
    tried = ", ".join(f"({i}, '{x}', {c}::double)" for i, x in enumerate(TRAINED) for c in BOOST_CUTS)
    names = f"ticker, date, target, role, {', '.join(TRAINED)}"
    parts = [
        f"tried as (select * from (values {tried}) as t(f, feature, cut))",
        f"m0 as materialized (select {names}, (select ln(avg(target) / (1 - avg(target))) from zs where role = 'train') as m from zs)",
    ]
    shown = []
    for t in range(rounds):
        parts.append(
            f"""m{t}_0 as materialized (select *, 0 as node, 1 / (1 + exp(-m)) - target as g, exp(-m) / (1 + exp(-m)) ** 2 as h from m{t}),
loss{t} as materialized (select avg(ln(1 + exp(m)) - target * m) as loss from m{t} where role = 'train')"""
        )
        for level in range(depth):
            here = f"m{t}_{level}"
            parts.append(
                f"""{here}_sums as materialized (
    select node, f, feature, cut, sum(g) as g, sum(h) as h, count(*) as n, sum(g) filter ({value} < cut) as gl, sum(h) filter ({value} < cut) as hl
    from {here} cross join tried where role = 'train' and node >= {2**level - 1} group by all),
{here}_best as materialized (
    select * from (select *, gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1) as gain from {here}_sums where hl >= 1 and h - hl >= 1)
    where gain > 1e-6 qualify row_number() over (partition by node order by round(gain, 9) desc, f, cut) = 1),
m{t}_{level + 1} as materialized (
    select r.* exclude (node), case when b.f is null then r.node else 2 * r.node + 1 + cast({value} >= cut as int) end as node
    from {here} r left join (select node, f, cut from {here}_best) b on r.node = b.node)"""
            )
            shown.append(f"select {t} as tree, node, feature, cut, gain, g, h, n, null as value, loss from {here}_best cross join loss{t}")
        parts.append(
            f"""leaf{t} as materialized (
    select node, sum(g) as g, sum(h) as h, count(*) as n, -{rate} * sum(g) / (sum(h) + 1) as value from m{t}_{depth} where role = 'train' group by node),
m{t + 1} as materialized (select {names}, m + coalesce(value, 0) as m from m{t}_{depth} left join leaf{t} using (node))"""
        )
        shown.append(f"select {t} as tree, node, null as feature, null as cut, null as gain, g, h, n, value, loss from leaf{t} cross join loss{t}")
    return ",\n".join([*parts, f"grown as ({' union all '.join(shown)})", f"ended as (select * from m{rounds})"])


BOOST_SQL = TRAIN_SQL[: TRAIN_SQL.index("fitrows as")] + boost_sql()


def _boosted(spark, d):
    rows, _ = modeling.prepare_data(views.bars(spark, d), day_scores(spark, d))
    rows = cut_lineage(rows)
    cuts = {f: BOOST_CUTS for f in TRAINED}
    model = modeling.train_boosted_trees(rows.where("role = 'train'"), TRAINED, BOOST_ROUNDS, BOOST_DEPTH, cuts=cuts)
    return model, rows


@query(
    "boosted_nodes",
    sql(
        """select tree, cast(node as int) as node, feature, cut, round(gain, 5) as gain, round(g, 5) as g, round(h, 5) as h, n as "rows",
                  round(value, 7) as value, round(loss, 7) as loss from grown""",
        "joined",
        extra=BOOST_SQL,
    ),
)
def boosted_nodes(spark, d):
    """Every node of a small boosted model: cuts and gains, sums of gradients and Hessians, weights of leaves, loss before the round."""
    model, _ = _boosted(spark, d)
    losses = F.array(*[F.lit(x) for x in model.losses])
    shown = model.nodes(spark).withColumn("loss", F.get(losses, F.col("tree"))).drop("missing_left")
    return rounded(shown, 5, value=7, loss=7, cut=2)


@query(
    "boosted_predictions",
    sql("select ticker, date, target, round(1 / (1 + exp(-m)), 6) as probability from ended where role = 'test'", "joined", extra=BOOST_SQL),
)
def boosted_predictions(spark, d):
    """Test rows by the same model, stored and read back."""
    model, rows = _boosted(spark, d)
    path = models.save_model(model, scratch(spark, "boosted"))
    again, _ = models.load_model(path)
    return rounded(modeling.predict(again, rows.where("role = 'test'")).select("ticker", "date", "target", "probability"))


@query(
    "forest_unlimited",
    sql(
        """select ticker, date, cast(target as int) as target, cast(target as int) as prediction, cast(target as double) as probability
           from zs where role = 'train'""",
        "joined",
        extra=TRAIN_SQL[: TRAIN_SQL.index("fitrows as")].rstrip().rstrip(","),
    ),
)
def forest_unlimited(spark, d):
    """Trees of unlimited depth that see all rows: no training row is fitted with an error, so predictions are the targets."""
    rows, names = modeling.prepare_data(views.bars(spark, d), day_scores(spark, d))
    train = cut_lineage(rows.where("role = 'train'"))
    model = modeling.train_random_forest(train, names, trees=3, bootstrap=False, group_rows=4096)
    shown = modeling.predict(model, train).select("ticker", "date", F.col("target").cast("int").alias("target"), "prediction", "probability")
    return rounded(shown)
