"""Usage ledgers: filters, summaries and rollups.  One scan per report part; sums treat unknown as zero."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_range(ledger: DataFrame, start: int, end: int, most: int = 366) -> DataFrame:
    """Days start..end as yyyymmdd; pushed to the scan where day is a partition column."""
    d = lambda k: date(k // 10000, k // 100 % 100, k % 100)
    if not 0 <= (d(end) - d(start)).days < most:
        raise ValueError(f"a range has 1 to {most} days")
    return ledger.filter(F.col("day").between(start, end))


def page_limits(skip: int, top: int, most: int = 100) -> None:
    if skip < 0 or not 1 <= top <= most:
        raise ValueError("skip must not be negative, and top between 1 and the limit")


def user_term(ledger: DataFrame, users: DataFrame, term: str | None) -> DataFrame:
    """Rows whose user id is the term, or whose user's name or e-mail holds it."""
    if not term:
        return ledger
    named = users.filter(F.contains(F.lower("name"), F.lit(term.lower())) | F.contains(F.lower("email"), F.lit(term.lower()))).select(F.col("user_id").cast("string").alias("__u"))
    ids = named.unionByName(ledger.sparkSession.createDataFrame([(term,)], "__u string")).distinct()
    return ledger.join(ids, ledger["user_id"].cast("string") == ids["__u"], "left_semi")


def model_filter(ledger: DataFrame, model: str | None = None, unknown: bool = False) -> DataFrame:
    if unknown:
        return ledger.filter(F.col("model_id").isNull())
    return ledger if model is None else ledger.filter(F.col("model_id") == model)


def total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("total_tokens").alias("total_tokens"), F.count_if(F.col("total_tokens").isNull()).alias("unknown_calls")]


def token_summary(ledger: DataFrame) -> DataFrame:
    """One row, zeros for an empty period."""
    return ledger.agg(
        F.count_distinct("question_id").alias("questions"),
        F.count(F.lit(1)).alias("requests"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("total_tokens").alias("total_tokens"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(F.col("model_id").isNull(), F.col("question_id"))).alias("unknown_model_questions"),
    )


def by(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(*measures())


def top_by(ledger: DataFrame, key: str, n: int, keep_null: bool) -> DataFrame:
    """Largest totals first, ties by key."""
    rows = ledger if keep_null else ledger.filter(F.col(key).isNotNull())
    return by(rows, key).orderBy(F.desc("total_tokens"), F.asc_nulls_first(key)).limit(n)


def options(ledger: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of some columns, one scan: (name, value)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return ledger.select(pairs.alias("o")).select("o.*").filter("value is not null").distinct().orderBy("name", "value")


def combined(*ledgers: DataFrame) -> DataFrame:
    """Partial sums of each ledger by day and model, concatenated and summed again."""
    parts = [x.groupBy("day", "model_id").agg(total("total_tokens").alias("tokens")) for x in ledgers]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("day", "model_id").agg(F.sum("tokens").alias("tokens"))


def month_used(user_id: int, month: int, *ledgers: DataFrame) -> DataFrame:
    out = None
    for x in ledgers:
        own = x.filter((F.col("user_id") == user_id) & (F.col("month") == month)).select("total_tokens")
        out = own if out is None else out.unionByName(own)
    return out.agg(total("total_tokens").alias("used"))


def pivots(ledger: DataFrame) -> DataFrame:
    """Totals by day, by model and by both in one pass: grouping sets."""
    sets = ledger.groupingSets([["day"], ["model_id"], ["day", "model_id"]], "day", "model_id")
    return sets.agg(F.grouping_id().cast("int").alias("level"), total("total_tokens").alias("tokens"))


def over_quota(used: Column, limit: Column) -> Column:
    return F.coalesce(limit.isNotNull() & (used >= limit), F.lit(False))


def admitted(files: DataFrame, limit: int, owner: str, order: list[str], size: str) -> DataFrame:
    """Which files fit if they come in order: a running sum of all before."""
    w = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(size).over(w), F.lit(0))
    return files.withColumn("used_before", used.cast("long")).withColumn("admitted", ~((F.col("used_before") >= limit) | (F.col(size) > limit - F.col("used_before"))))


def null_poisoned(c: str) -> Column:
    """A sum that is unknown once any part is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def reported(c: str, flag: str) -> Column:
    """Unknown until anything is reported; then missing parts count zero."""
    return F.when(F.bool_or(flag), total(c))


def name_list(names: Column, most: int = 1000) -> Column:
    joined = F.array_join(F.array_distinct(names), ", ")
    return F.when(F.size(names) > 0, F.left(joined, F.lit(most)))


def safety_verdict(severities: list[Column], thresholds: list[Column]) -> Column:
    """Blocked if any severity reaches its threshold; null unless all are 0 to 7."""
    valid, blocked = F.lit(True), F.lit(False)
    for s, t in zip(severities, thresholds):
        valid, blocked = valid & s.between(0, 7), blocked | (s >= t)
    return F.when(valid, F.when(blocked, "Blocked").otherwise("Allowed"))


def health(rows: DataFrame, now: Column, key: str = "worker") -> DataFrame:
    """Latest heartbeat of each worker as unknown, unhealthy, degraded or healthy."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("beat_at", "failed", "expires_at"), "beat_at").alias("b"))
    old = F.col("b.beat_at") <= now - F.expr("INTERVAL 2 MINUTES")
    state = F.when(F.col("b.beat_at").isNull(), "unknown").when(old, "unhealthy").when(F.coalesce(F.col("b.failed"), F.lit(False)) | (F.col("b.expires_at") <= now), "degraded").otherwise("healthy")
    return last.select(key, state.alias("status"))


#: Entries of a sketch, and how far the rank of one of its quantiles may be off, as a share of the rows and however many sketches were merged:
#: twice what the published analysis of KLL sketches gives for so many with 99 % confidence, which is missed less than once in a million times.
SKETCH_K = 800
SKETCH_ERROR = 2 * 2.296 / SKETCH_K**0.9723


def quantile_sketches(rows: DataFrame, keys: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, sketch): a few KB for each key, however many rows; they merge, so a day is summed up once."""
    return rows.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """(p, n, value): approximate quantiles of all that the sketches have seen, without their rows."""
    one = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in shares)))
    return one.select("n", each.alias("q")).select("q.p", "n", "q.value")


def rank_errors(asked: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(p, n, value, error): how far each p is from the exact ranks that its value has in the rows, as a share of them; one pass."""
    few = asked.collect()
    x = F.col(column)
    counts = rows.agg(F.count(x).alias("n"), *(c for i, r in enumerate(few) for c in (F.count_if(x < r["value"]).alias(f"low{i}"), F.count_if(x <= r["value"]).alias(f"high{i}")))).first()
    error = lambda i, p: max(counts[f"low{i}"] / counts["n"] - p, p - counts[f"high{i}"] / counts["n"], 0.0)
    return rows.sparkSession.createDataFrame([(r["p"], r["n"], r["value"], error(i, r["p"])) for i, r in enumerate(few)], "p double, n long, value double, error double")
