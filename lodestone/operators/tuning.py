"""Weights and caps fitted to labelled anchors.

Errors are whole millionths, so sums do not depend on the order rows arrive in and equal
errors are equal. Of equal errors the first combination wins.

``anchors`` is a table of finished features with ``category`` and ``target``.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import axis, clip, total
from ..session import cut_lineage
from .scoring import SIGNAL_WEIGHTS, capped, category_cap, score_terms, weight

MICRO = 1_000_000
BLOCK_ROWS = 512


def point(spec: tuple[float, float, int], index: Column) -> Column:
    start, step, _ = spec
    return F.lit(start) + index * F.lit(step)


def error(prediction: Column) -> Column:
    return F.round(F.abs(prediction - F.col("target")) * MICRO).cast("bigint")


def grid_axes(combo: Column, axes: list[tuple[float, float, int]]) -> list[Column]:
    """Axis values of a numbered combination; the last axis turns fastest."""
    out, below = [], 1
    for spec in reversed(axes):
        index = F.pmod(F.floor(combo / F.lit(below)), F.lit(spec[2]))
        out.append(point(spec, index))
        below *= spec[2]
    return list(reversed(out))


def size(axes) -> int:
    n = 1
    for spec in axes:
        n *= spec[2]
    return n


GRID = [fixed.GRID_DEP, fixed.GRID_WRAPPER, fixed.GRID_CAP, fixed.GRID_USAGE]


def needed(anchors: DataFrame, weights: dict = fixed.WEIGHTS) -> DataFrame:
    """Per anchor only what varies between models, and the sum of all that does not."""
    varying = ("dep_score", "signals", "usage_signal")
    rest = total([c for n, c in score_terms(weights).items() if n not in varying])
    other = total([F.lit(float(weights[w])) * F.coalesce(F.col(c), F.lit(0.0))
                   for c, w in SIGNAL_WEIGHTS.items() if c != "ai_wrapper"])
    return anchors.select("category", "target", "dep_score",
                          F.coalesce("usage_signal", F.lit(0.0)).alias("usage"),
                          F.coalesce("ai_wrapper", F.lit(0.0)).alias("wrapper"),
                          rest.alias("rest"), other.alias("other_signals"))


def model_base(dep, wrapper, usage) -> Column:
    """Score before any cap of a ``needed`` row under a model."""
    signals = clip(F.col("other_signals") + weight(wrapper) * F.col("wrapper"),
                   -fixed.SIGNAL_LIMIT, fixed.SIGNAL_LIMIT)
    raw = (F.col("rest") + weight(dep) * F.col("dep_score")
           + weight(usage) * F.col("usage") + signals)
    return F.lit(fixed.SCORE_BASE) + raw / F.lit(fixed.SCORE_DIVISOR) * F.lit(fixed.SCORE_SPAN)


def grid_errors(anchors: DataFrame, faithful: bool = True) -> DataFrame:
    """Total error of every grid combination.

    With ``faithful`` the usage axis has no effect, as published: each model is evaluated
    once and its error listed under all values of that axis. Rows multiply within their
    task and are summed there; the shuffle carries one row per combination and task.
    """
    axes = GRID[:3] if faithful else GRID
    combos = needed(anchors).withColumn(
        "model", F.explode(F.sequence(F.lit(0), F.lit(size(axes) - 1))))
    values = grid_axes(F.col("model"), axes)
    usage = fixed.WEIGHTS["usage_weight"] if faithful else values[3]
    base = model_base(values[0], values[1], usage)
    cap = F.when(F.col("category").isin(fixed.GRID_CAP_CATEGORIES), values[2]) \
        .otherwise(category_cap())
    sums = combos.groupBy("model").agg(
        F.sum(error(capped(base, cap))).alias("error"),
        F.count(F.lit(1)).alias("n"))
    if not faithful:
        return sums.select(F.col("model").alias("combo_id"), "error", "n")
    width = GRID[3][2]
    each_usage = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    return sums.withColumn("_u", each_usage).select(
        (F.col("model") * width + F.col("_u")).alias("combo_id"), "error", "n")


def with_mae(errors: DataFrame) -> DataFrame:
    """Grid points and mean absolute error of each combination."""
    dep, wrapper, cap, usage = grid_axes(F.col("combo_id"), GRID)
    return errors.select(
        "combo_id", F.round(dep, 2).alias("dep_weight"), F.round(wrapper, 2).alias("wrapper_coef"),
        F.round(cap, 2).alias("cap"), F.round(usage, 2).alias("usage_weight"),
        (F.col("error") / F.col("n") / MICRO).alias("mae"))


def grid_search(anchors: DataFrame, faithful: bool = True) -> DataFrame:
    """The best combination, one row."""
    errors = grid_errors(anchors, faithful)
    winner = errors.agg(F.min_by(F.struct("combo_id", "error", "n"),
                                 F.struct("error", "combo_id")).alias("w"))
    return with_mae(winner.select("w.*"))


def grid_caps(cap: float) -> dict[str, float]:
    return dict(fixed.CATEGORY_CAPS, **{c: cap for c in fixed.GRID_CAP_CATEGORIES})


def cap_errors(anchors: DataFrame, weights: dict, caps: dict) -> DataFrame:
    """One row: the error of anchors outside the searched categories, and per searched
    category the error at every cap.

    Errors of different categories add up, so 34 sums stand for all 5,184 combinations.
    """
    base = model_base(weights["dep_weight"], weights["ai_wrapper_coef"], weights["usage_weight"])
    rows = needed(anchors, weights).select("category", "target", base.alias("base"))
    sums = []
    fixed_error = F.when(~F.col("category").isin(list(fixed.CAP_AXES)),
                         error(capped(F.col("base"), category_cap(caps))))
    for name, spec in fixed.CAP_AXES.items():
        per_cap = [F.coalesce(F.sum(F.when(
            F.col("category") == name, error(capped(F.col("base"), F.lit(v))))), F.lit(0))
            for v in axis(*spec)]
        sums.append(F.array(*per_cap).alias(name))
    return rows.agg(F.coalesce(F.sum(fixed_error), F.lit(0)).alias("rest"),
                    F.count(F.lit(1)).alias("n"), *sums)


def cap_search(anchors: DataFrame, weights: dict, caps: dict, patience: int | None = None) -> DataFrame:
    """Caps of four categories refined, one row: the best of all 5,184 combinations, the
    first of equals.

    With ``patience`` as the published run has it: combinations are taken in order; one is
    accepted if it gains more than 0.0005 on the last accepted, and the search ends after
    that many in a row that do not (500: ``fixed.CAP_PATIENCE``). Either runs over the totals
    of the fixed grid, whatever the number of anchors.
    """
    specs = list(fixed.CAP_AXES.items())
    errors = cap_errors(anchors, weights, caps)
    n_combos = size([s for _, s in specs])

    def indexes(combo):
        out, below = [], 1
        for _, spec in reversed(specs):
            out.append(F.pmod(F.floor(combo / F.lit(below)), F.lit(spec[2])).cast("int"))
            below *= spec[2]
        return list(reversed(out))

    def combined(combo):
        value = F.col("rest")
        for (name, _), i in zip(specs, indexes(combo)):
            value = value + F.get(F.col(name), i)
        return F.struct(combo.alias("id"), value.alias("error"))

    totals = F.transform(F.sequence(F.lit(0), F.lit(n_combos - 1)), combined)
    start = F.struct(F.lit(-1).alias("id"), F.lit(None).cast("bigint").alias("error"),
                     F.lit(0).alias("stale"))
    gain = F.col("n") * F.lit(int(fixed.CAP_MIN_GAIN * MICRO))

    def step(s, c):
        open_ = s["stale"] < patience
        better = open_ & (s["error"].isNull() | (c["error"] < s["error"] - gain))
        return F.when(better, F.struct(c["id"].alias("id"), c["error"].alias("error"),
                                       F.lit(0).alias("stale"))).otherwise(
            F.struct(s["id"].alias("id"), s["error"].alias("error"),
                     F.when(open_, s["stale"] + 1).otherwise(s["stale"]).alias("stale")))

    if patience is None:
        found = F.array_min(F.transform(totals, lambda c: F.struct(c["error"], c["id"])))
    else:
        found = F.aggregate(totals, start, step)
    best = errors.select("n", found.alias("b"))
    picked = indexes(F.col("b.id"))
    return best.select(
        F.col("b.id").alias("combo_id"),
        *[F.round(point(spec, i), 2).alias(name) for (name, spec), i in zip(specs, picked)],
        (F.col("b.error") / F.col("n") / MICRO).alias("mae"))


CV = [fixed.CV_DEP, fixed.CV_WRAPPER]


def cv_error_vectors(anchors: DataFrame, weights: dict, caps: dict) -> DataFrame:
    """Per anchor the error under each of the 12 models of the cross-validation."""
    vector = []
    for dep in axis(*CV[0]):
        for wrapper in axis(*CV[1]):
            base = model_base(dep, wrapper, weights["usage_weight"])
            vector.append(error(capped(base, F.col("cap"))))
    rows = needed(anchors, weights).withColumn("cap", category_cap(caps))
    return rows.select(F.array(*vector).alias("e"))


def leave_two_out(anchors: DataFrame, weights: dict, caps: dict) -> DataFrame:
    """Mean error on held-out pairs, each pair predicted by the model that is best on all
    other anchors. Exact over all anchors, one row.

    The training error of a pair is the column total less the pair's own errors, so nothing
    is refitted. Let the reference model be the one best on all anchors. Leaving a pair out
    turns the choice to another model only where the pair's extra error under that model
    reaches the model's distance in total error. Anchors that cannot reach it with any
    partner are settled by one sum. The rest are merged where their vectors agree, and only
    those merged rows are paired, over blocks of similar reach: two blocks meet only if their
    largest extra errors reach a distance together. The number of blocks follows the rows left.
    With more anchors the distances grow and the extra errors do not, so fewer are left.
    """
    models = size(CV)
    errors = cv_error_vectors(anchors, weights, caps)

    def at(array, g):
        return F.get(array, F.lit(g))

    e = F.col("e")
    # Distinct error vectors with their number, written once as several sums read them.
    vectors = cut_lineage(errors.groupBy("e").agg(F.count(F.lit(1)).alias("n")))
    sums = vectors.agg(F.sum("n").alias("anchors"),
                       F.array(*[F.sum(F.col("n") * at(e, g)) for g in range(models)])
                       .alias("total"))
    best = F.array_position(F.col("total"), F.array_min("total")).cast("int") - 1
    sums = sums.select("anchors", "total", best.alias("best"),
                       F.transform("total", lambda t: t - F.array_min("total")).alias("gap"))
    known = sums.select(F.struct("anchors", "best", "gap", "total").alias("s")).scalar()
    extra = F.transform(e, lambda x: x - F.get(e, F.col("s.best")))
    rows = vectors.withColumn("s", known).select("n", "s", extra.alias("extra"))
    most = rows.agg(F.array(*[F.max(at(F.col("extra"), g)) for g in range(models)]).alias("m")
                    ).scalar()
    rows = rows.withColumn("m", most)

    def turns(one, other):
        # A pair turns to g if its extra error exceeds the gap, or equals it and g is earlier.
        def reaches(g):
            highest = F.get(F.col(one), g) + F.get(F.col(other), g)
            gap = F.get(F.col("s.gap"), g)
            return (g != F.col("s.best")) & (
                (highest > gap) | ((highest == gap) & (g < F.col("s.best"))))

        return F.exists(F.sequence(F.lit(0), F.lit(models - 1)), reaches)

    # How far a row goes towards the nearest model: rows of a block are alike in it.
    reach = F.array_max(F.zip_with("extra", F.col("s.gap"), lambda x, gap: x / F.greatest(gap, F.lit(1))))
    movable = cut_lineage(rows.filter(turns("extra", "m"))
                          .groupBy("extra").agg(F.sum("n").alias("n"), F.any_value("s").alias("s"))
                          .withColumn("reach", reach))
    parts = max(1, ceil(sqrt(movable.count() / BLOCK_ROWS)))
    below = F.lit(0)
    if parts > 1:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = movable.agg(F.percentile_approx("reach", shares, 10_000)).first()[0]
        below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("reach")))
    movable = cut_lineage(movable.withColumn(
        "block", below * parts + F.pmod(F.xxhash64("extra"), F.lit(parts))).drop("reach"))
    blocks = movable.groupBy("block").agg(
        F.array(*[F.max(at(F.col("extra"), g)) for g in range(models)]).alias("top"), F.any_value("s").alias("s"))
    met = blocks.select("s", F.col("block").alias("b1"), F.col("top").alias("t1")).join(
        blocks.select(F.col("block").alias("b2"), F.col("top").alias("t2")),
        F.col("b1") <= F.col("b2")).filter(turns("t1", "t2")).select("b1", "b2")
    left = movable.select("extra", "n", "s", F.col("block").alias("b1")).join(met, "b1")
    right = movable.select(F.col("extra").alias("extra2"), F.col("n").alias("n2"), F.col("block").alias("b2"))
    pairs = left.join(right, "b2").filter(
        ((F.col("b1") < F.col("b2")) | (F.col("extra") <= F.col("extra2"))) & turns("extra", "extra2"))
    both = F.zip_with("extra", "extra2", lambda a, b: a + b)
    rest = F.zip_with(both, F.col("s.gap"), lambda x, gap: gap - x)
    chosen = F.array_position(rest, F.array_min(rest)).cast("int") - 1
    same = F.col("extra") == F.col("extra2")
    number = F.when(same, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2"))
    moved = pairs.select((F.get(both, chosen) * number).alias("x")) \
        .agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x")).scalar()
    held = sums.select(
        F.col("anchors").alias("n"),
        (F.get(F.col("total"), F.col("best")) * (F.col("anchors") - 1)).alias("settled"))
    pair_count = F.col("n") * (F.col("n") - 1) / 2
    return held.select(
        pair_count.cast("bigint").alias("pairs"),
        (F.try_divide(F.col("settled") + moved, pair_count * 2) / MICRO).alias("cv_mae"))


def overfit_gap(cv_mae: Column, train_mae: Column) -> dict[str, Column]:
    """Gap between held-out and training error, and whether it is alarming."""
    gap = cv_mae - train_mae
    return {"gap": gap, "overfit": gap > fixed.OVERFIT_GAP}


def tune(anchors: DataFrame, faithful: bool = True, patience: int | None = None) -> tuple[dict, dict] | None:
    """Tuned weights and caps, or None without anchors.

    Two rows of parameters come to the driver, whatever the size of the data.
    """
    found = grid_search(anchors, faithful).first()
    if found is None or found["combo_id"] is None:
        return None
    weights = dict(fixed.WEIGHTS, dep_weight=found["dep_weight"],
                   ai_wrapper_coef=found["wrapper_coef"])
    if not faithful:
        weights["usage_weight"] = found["usage_weight"]
    caps = grid_caps(found["cap"])
    refined = cap_search(anchors, weights, caps, patience).first()
    caps.update({name: refined[name] for name in fixed.CAP_AXES})
    return weights, caps
