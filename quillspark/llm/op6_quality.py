"""Operator 6: quality rules and robust multivariate outliers, in DataFrame functions only.

Base statistics come from each whole text.  Documents that pass the base rule are judged by their
transformed statistics (five numbers) against a minimum-covariance-determinant estimate of their
language and source: two starts at the medians, with scaled deviations and with fixed units, repeat
concentration steps, each of which re-estimates mean and covariance from the ``share`` of the group with the
smallest Mahalanobis distances, until no determinant moves; the start with the least determinant is
the estimate.  A document is rejected if its squared
distance under the final, consistency-corrected estimate exceeds ``cutoff`` (20.5: the 0.999 quantile of
chi-squared with five degrees of freedom).

Everything a step gathers is sums of integers (statistics in units of 1/10,000) and counts in bins of
the distance's logarithm, merged before the shuffle: a group of any size costs a few rows per task,
and no result depends on the order of rows.  Groups of under ``least`` documents are pooled by
language, and then all together; with fewer than ``least`` in the end nothing is rejected by the method.
Every larger group keeps its own model, however many there are: above ``max_models`` the tables of groups and
models are joined by a shuffle, salted against large groups, instead of a broadcast.  Up to there the models' estimates, which are
few rows, pass from step to step as local rows, and as many tasks make them as there are models to fill.

A variance below its floor is raised to it, so that a statistic that is the same in nearly all documents
leaves no singular covariance; above the floor the estimates of the group decide alone.

Defined results: null and empty texts have no words and fail the base rule; null languages and sources
are groups of their own; null ids and repeated rows stay; documents whose distances share a bin are concentrated on together;
very long texts are read whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, documents, let, words, written

UNIT = 10_000
FEATURES = ("x0", "x1", "x2", "x3", "x4")
P = len(FEATURES)
#: Least standard deviation of each: log words, log word length, root of the share of symbols (few are telling), shares of
#: repeated lines and words (a line that comes twice is not).
FLOORS = (0.25, 0.1, 0.05, 0.05, 0.05)
SHARE = 0.75
#: Parts of a group where its model is joined by a shuffle.
SALTS = 16
#: Models' sums in a task, where all models are few rows.
KEYS = 4
#: Bins of the logarithm of the squared distance.
BINS = 64


def _repeated(w: Column) -> Column:
    """Words in 8-word windows that are found twice or more."""

    def covered(pairs: Column) -> Column:
        # Neighbours in hash order that are equal are repeats; their places, in order, give the union of windows.
        n = F.size(pairs)
        same = F.filter(pairs, lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        return let(places, lambda at: F.aggregate(F.transform(at, lambda x, i: F.coalesce(F.least(F.get(at, i + 1) - x, F.lit(8)), F.lit(8))), F.lit(0), lambda a, b: a + b))

    def judged(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 8), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(8))))
    return F.when(F.size(w) >= 9, let(hashes, judged)).otherwise(F.lit(0))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, base statistics, base_failed, and the transformed statistics in integer units."""
    t = F.coalesce(F.col("__t").cast("string"), F.lit(""))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    src = docs.select(*keep, F.col(text_col).alias("__t")).withColumn("__t", t)
    src = src.select(
        *keep,
        words(F.col("__t")).alias("__w"),
        lines.alias("__l"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
    )
    src = src.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("__w")).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("__lines"),
    )
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = (F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)), F.col("n_repeat_words") / n)
    src = src.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return src.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(F.round(v * UNIT).cast("long").alias(x) for v, x in zip(values, FEATURES)))


def _factor(df: DataFrame, keep: list[str]) -> DataFrame:
    """From columns m*, c** (covariance) to m*, l** (Cholesky factor) and logdet."""
    for j in range(P):
        diag = F.sqrt(F.greatest(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-9)))
        df = df.withColumn(f"l{j}{j}", diag)
        df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    logdet = sum((2 * F.log(f"l{j}{j}") for j in range(P)), F.lit(0.0))
    return df.select(*keep, *(f"m{j}" for j in range(P)), *(f"l{i}{j}" for j in range(P) for i in range(j, P)), logdet.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """With column d2, the squared Mahalanobis distance of x* under m*, l**."""
    for j in range(P):
        z = F.col(FEATURES[j]) / UNIT - F.col(f"m{j}") - sum((F.col(f"l{j}{k}") * F.col(f"z{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"z{j}", z / F.col(f"l{j}{j}"))
    return df.withColumn("d2", sum((F.col(f"z{j}") ** 2 for j in range(P)), F.lit(0.0))).drop(*(f"z{j}" for j in range(P)))


def chi2_cdf(x: float, df: int) -> float:
    """For odd df, by the recurrence from df = 1."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, df, 2):
        out -= 2 * (x / 2) ** (k / 2) * math.exp(-x / 2) / (k * math.gamma(k / 2))
    return out


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def _estimate(sums: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """Mean and floored covariance from integer sums n, s*, q**; the covariance is scaled by ``factor``."""
    n = F.col("n").cast("double")
    mean = {f"m{j}": F.col(f"s{j}").cast("double") / n / UNIT for j in range(P)}
    cov = {}
    for i in range(P):
        for j in range(i + 1):
            # n * sum(xy) - sum(x) * sum(y) in exact decimals, then one division
            top = (F.col("n") * F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")).cast("double")
            cov[f"c{i}{j}"] = factor * top / (n * n) / UNIT / UNIT
            if i == j:
                cov[f"c{i}{j}"] = F.greatest(cov[f"c{i}{j}"], F.lit(FLOORS[i] ** 2))
    return sums.select(*keys, *(c.alias(k) for k, c in {**mean, **cov}.items()))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each of the keys; null equals null."""
    if small:
        table = F.broadcast(table)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        keys = [*keys, "__salt"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return rows.alias("r").join(table.alias("t"), same, how).select("r.*", *(f"t.{c}" for c in table.columns if c not in keys)).drop("__salt")


def _held(table: DataFrame, name: str, small: bool) -> DataFrame:
    """A table of models, computed once: small ones are local rows, since files and stages for each step's few rows cost the driver more."""
    return table.sparkSession.createDataFrame(table.toArrow(), table.schema) if small else written(table, name)


#: Starts of the concentration steps: scaled deviations, and the floors alone (distances from the medians in fixed units).
STARTS = 2


def robust_fit(scored: DataFrame, steps: int = 10, share: float = SHARE, small: bool = True) -> DataFrame:
    """(model, m*, l**, logdet) per model, from rows (model, x*).

    All starts run side by side, until no determinant falls any more (``steps`` at most); for each model
    the start with the least determinant is its estimate.
    """
    pool = written(scored.select("model", *FEATURES), "mcd-pool")
    # Values are integers of a bounded range, so an exact median needs few counters.
    mid = [F.percentile(x, F.lit(0.5)).alias(f"m{j}") for j, x in enumerate(FEATURES)]
    centre = _held(pool.groupBy("model").agg(*mid), "mcd-centre", small)
    # As many tasks as there are keys to fill, however many partitions a shuffle has.
    most = math.ceil(STARTS * max(1, centre.count()) / KEYS)
    fitted = lambda table, name: _held(table.coalesce(most) if small else table, name, small)
    spread = _joined(pool, centre, ["model"], small).groupBy("model", *(f"m{j}" for j in range(P)))
    spread = spread.agg(*(F.percentile(F.abs(F.col(x) - F.col(f"m{j}")), F.lit(0.5)).alias(f"d{j}") for j, x in enumerate(FEATURES)))
    floor = [F.lit(v**2) for v in FLOORS]
    deviation = lambda j: F.pow(1.4826 * F.col(f"d{j}") / UNIT, F.lit(2.0))
    both = spread.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    variance = [F.when(F.col("start") == 0, F.greatest(deviation(j), floor[j])).otherwise(floor[j]).alias(f"c{j}{j}") for j in range(P)]
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in range(P) for j in range(i)]
    keys = ["model", "start"]
    state = fitted(_factor(both.select(*keys, *((F.col(f"m{j}") / UNIT).alias(f"m{j}") for j in range(P)), *variance, *zero), keys), "mcd-state")
    q = chi2_quantile(share, P)
    factor = share / chi2_cdf(q, P + 2)
    dec = lambda c: c.cast("decimal(20,0)")
    total = [F.count(F.lit(1)).cast("decimal(18,0)").alias("n"), *(F.sum(dec(F.col(x))).cast("decimal(18,0)").alias(f"s{j}") for j, x in enumerate(FEATURES))]
    total += [F.sum(dec(F.col(FEATURES[i]) * F.col(FEATURES[j]))).cast("decimal(20,0)").alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]
    pool = pool.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    for step in range(steps):
        binned = _distance(_joined(pool, state, keys, small)).select(*keys, *FEATURES, F.col("logdet").alias("old"), F.floor(F.log(F.col("d2") + 1e-9) * BINS).alias("bin"))
        # The least bin up to which the share lies; its counters are merged per task.
        edge = fitted(binned.groupBy(*keys).agg(F.expr(f"percentile_disc({share}D) within group (order by bin)").alias("edge")), "mcd-edge")
        inner = _joined(binned, edge, keys, small).filter("bin <= edge")
        fresh = _estimate(inner.groupBy(*keys).agg(*total, F.max("old").alias("old")), factor, [*keys, "old"])
        fresh = fitted(_factor(fresh, [*keys, "old"]), "mcd-state")
        moved = fresh.filter(F.abs(F.col("old") - F.col("logdet")) > 1e-2)
        state = fresh.drop("old")
        if step and moved.isEmpty():
            break
    best = F.min_by(F.struct(*(c for c in state.columns if c not in keys)), F.struct("logdet", "start")).alias("b")
    return fitted(state.groupBy("model").agg(best).select("model", "b.*"), "mcd-model")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 50, cutoff: float = 20.5, max_models: int = 20_000, also: dict[str, Column] | None = None) -> DataFrame:
    """Statistics, base_failed, kept and d2 for each row, and the columns of ``also``."""
    also = also or {}
    names = {id_col: "__id", lang_col: "__lang", source_col: "__source"}
    renamed = docs.select(*(F.col(k).alias(v) for k, v in names.items()), F.col(text_col).alias("__text"), *(c.alias(k) for k, c in also.items()))
    stats = written(statistics(renamed, [*names.values(), *also], "__text"), "quality-stats")
    # Two counts decide each group's model; the groups are few rows, and their number is checked.
    groups = stats.filter(~F.col("base_failed")).groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("small", F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).over(Window.partitionBy("__lang")))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    model = F.when(F.col("n") >= least, F.concat_ws("\x01", tag("__lang"), tag("__source"))).when(F.col("small") >= least, tag("__lang")).otherwise(F.lit("*"))
    groups = written(groups.select("__lang", "__source", model.alias("model")), "quality-groups")
    scored = _joined(stats, groups, ["__lang", "__source"], groups.count() <= max_models, "left")
    good = scored.filter(~F.col("base_failed"))
    counts = written(good.groupBy("model").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("model"), "quality-models")
    small = counts.count() <= max_models
    fitted = robust_fit(_joined(good, counts, ["model"], small), small=small)
    out = _distance(_joined(scored, fitted, ["model"], small, "left"))
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"), "d2", *also)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
