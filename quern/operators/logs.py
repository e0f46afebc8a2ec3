"""Aggregates and sequence operators over event logs, experiences and state series.

Aggregates combine on the map side. Folds and cooldowns are cut into ordered parts, so
that one entity may hold most of the rows. The other sequence operators are windows over
one entity's rows, which one task sorts (spilling, not collecting) as a user's events are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import Grown, written


def js_round(value: Column, digits: int = 0) -> Column:
    """Rounding half up on the real line, also below zero. The last bit of a sum does not decide a tie."""
    scale = 10**digits
    return F.floor(value * scale + 0.5 + 1e-9) / scale if digits else F.floor(value + 0.5 + 1e-9)


def rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


# -- counts -------------------------------------------------------------------------


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def counts_by_element(rows: DataFrame, array: str) -> DataFrame:
    return rows.select(F.explode(array).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))


def counts_by_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key on its own, in one pass: (dimension, value, n)."""
    sets = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x"))
    return sets.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def pending(reported: DataFrame, confirmed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reports that are not confirmed."""
    return reported.join(confirmed.select(*keys).distinct(), list(keys), "left_anti")


def top_share(rows: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """The most frequent values with their rounded percentage of all rows."""
    counts = counts_by(rows, key)
    whole = counts.agg(F.sum("n").alias("total"))
    out = counts.join(F.broadcast(whole), F.lit(True)).withColumn("pct", js_round(F.col("n") / F.col("total") * 100).cast("long"))
    return out.orderBy(F.desc("n"), key).limit(limit).select(key, "n", "pct")


def suggestions(rows: DataFrame, dimension: str, reason: str, least: int = 20, share: int = 25, reason_share: int = 30) -> DataFrame:
    """Dimensions with 25 % and reasons with 30 % of the pending reports, of 20 reports or more."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))

    def over(key: str, kind: str, limit: int, confidence: Column) -> DataFrame:
        out = counts_by(rows, key).join(F.broadcast(total), F.lit(True)).withColumn("pct", js_round(F.col("n") / F.col("total") * 100))
        out = out.where((F.col("pct") >= limit) & (F.col("total") >= least))
        return out.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("value"), "n", confidence.alias("confidence"))

    return over(dimension, "concentration", share, F.least(F.lit(0.95), 0.5 + F.col("n") / 50)).unionByName(over(reason, "reason", reason_share, F.lit(0.8)))


def experience_stats(rows: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """Count, successes, success rate, mean usefulness and the last seven days' count."""
    recent = F.col("ts") > as_of - F.expr("INTERVAL 7 DAYS")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("success"), 1)).alias("n_success"),
        rate(F.col("success")).alias("success_rate"),
        F.avg("value").alias("mean_value"),
        F.count(F.when(recent, 1)).alias("n_recent"),
    )


# Error kinds of failed experiences.
ERROR_KINDS = (("syntax", "syntax|parse"), ("dependency", "dependency|module|import"), ("permission", "permission|denied"), ("timeout", "timeout"))


def error_kind_counts(rows: DataFrame, error: str, *keys: str) -> DataFrame:
    """Failed experiences by error kind; an error may be of several."""
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.lower(error).rlike(p), 1)).alias(f"n_{k}") for k, p in ERROR_KINDS])


def strategy(stats: DataFrame, success_rate: str = "success_rate", usefulness: str = "usefulness") -> DataFrame:
    """Strategy and confidence from the success rate and mean usefulness."""
    r, u = F.col(success_rate), F.col(usefulness)
    confidence = F.when(r >= 0.8, F.least(F.lit(1.0), u + 0.2)).when(r < 0.5, F.greatest(F.lit(0.1), u - 0.3)).otherwise(u)
    return stats.withColumn("strategy", F.when(r < 0.5, "conservative").otherwise("default")).withColumn("confidence", confidence)


def transitions(rows: DataFrame, entity: str, state: str, action: str, order: Sequence[str]) -> DataFrame:
    """(from, action, to, n, probability) of consecutive states of an entity."""
    by = Window.partitionBy(entity).orderBy(*order)
    pairs = rows.select(F.col(state).alias("from_state"), F.lead(action).over(by).alias("action"), F.lead(state).over(by).alias("to_state"))
    counts = pairs.where("to_state is not null").groupBy("from_state", "action", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from_state", "action")))


def predictions(model: DataFrame, top: int = 5) -> DataFrame:
    by = Window.partitionBy("from_state", "action").orderBy(F.desc("probability"), "to_state")
    return model.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def choose_action(model: DataFrame, weight: float = 0.3) -> DataFrame:
    """The action of each state with the best exploitation plus exploration score; the score is rounded after the choice."""
    sure = model.groupBy("from_state", "action").agg(F.max("probability").alias("confidence"))
    score = F.col("confidence") * (1 - weight) + (1 - F.col("confidence")) * weight
    by = Window.partitionBy("from_state").orderBy(F.desc("score"), "action")
    scored = sure.withColumn("score", score).withColumn("reason", F.when(1 - F.col("confidence") > 0.5, "explore").otherwise("exploit"))
    return scored.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank").withColumn("score", F.round("score", 3))


def calibration(rows: DataFrame, raw: Column, adjusted: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean absolute difference) by tenths of the adjusted confidence."""
    b = F.least(F.lit(bins - 1), F.floor(adjusted * bins)).cast("int")
    return rows.select(b.alias("bin"), F.abs(adjusted - raw).alias("d")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("error"))


def state_bin(load: Column, confidence: Column, uncertainty: Column, domain: Column, complexity: Column) -> Column:
    """Five-part key: quarters of three numbers, the domain, and low, medium or high as 0, 1 or 2."""
    q = lambda c: F.least(F.lit(3), F.floor(c * 4)).cast("string")
    level = F.when(complexity == "low", "0").when(complexity == "high", "2").otherwise("1")
    return F.concat_ws(":", q(load), q(confidence), q(uncertainty), domain, level)


def term_frequencies(rows: DataFrame, text: Column, stop_words: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent terms (Latin words of three letters and more, Han runs of two to six) that are no stop words."""
    terms = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,}|[一-鿿]{2,6})"), 1)).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(stop_words), "term", "left_anti").orderBy(F.desc("n"), "term").limit(limit)


def keywords_per_record(rows: DataFrame, key: str, text: Column, limit: int = 15) -> DataFrame:
    """The most frequent words of more than three letters of each record, ties by the first place."""
    w = rows.select(key, F.posexplode(F.split(F.lower(text), r"\s+")).alias("place", "word")).where(F.length("word") > 3)
    counts = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    by = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def bursts(rows: DataFrame, source: str, ts: str, most: int = 20) -> DataFrame:
    """(source, day, n) with more than ``most`` writes in a day."""
    return rows.groupBy(source, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def recurrence(rows: DataFrame, category: str, ts: str, seconds: int = 3600) -> DataFrame:
    """Adds ``recurrences``: rows of the category in the hour before.

    A range window over stretches of ``seconds``: each row also goes, as an echo, to the
    next stretch, where it may lie in the hour before. So a category with most of the
    rows is dealt over as many tasks as it has hours, and nothing is joined.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    stretch = F.floor(micros / (seconds * 1_000_000))
    both = rows.withColumn("__echo", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__stretch", stretch + F.col("__echo"))
    by = Window.partitionBy(category, "__stretch").orderBy(micros).rangeBetween(-seconds * 1_000_000, -1)
    return both.withColumn("recurrences", F.count(F.lit(1)).over(by)).where("__echo = 0").drop("__echo", "__stretch")


def recurrence_by_category(rows: DataFrame, category: str, count: str, least: int = 2) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(count) >= least, 1)).alias("n_high"), F.max(count).alias("most"))


def promoted(rows: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Patterns seen ``least`` times and more."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen")).where(F.col("n") >= least)


def strategy_usage(rows: DataFrame, key: str, ts: str, success: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("usage"), F.count(F.when(F.col(success), 1)).alias("successes"), F.min(ts).alias("first_used"), F.max(ts).alias("last_used")
    )


def consensus(rows: DataFrame, group: str, conclusion: str, confidence: str, risk: str) -> DataFrame:
    """0.4 agreement of conclusions + 0.4 agreement of confidences + 0.2 share of distinct risks; 1 for a single opinion."""
    out = rows.groupBy(group).agg(
        F.count(conclusion).alias("n"),
        F.count_distinct(conclusion).alias("distinct_n"),
        F.var_pop(F.when(F.col(confidence).isNull() | (F.col(confidence) == 0), 0.5).otherwise(F.col(confidence))).alias("spread"),
        F.count(risk).alias("risks"),
        F.count_distinct(risk).alias("distinct_risks"),
        F.count(F.lit(1)).alias("opinions"),
    )
    agree = F.when(F.col("n") > 0, (F.col("n") - F.col("distinct_n") + 1) / F.col("n")).otherwise(F.lit(0.0))
    sure = F.greatest(F.lit(0.0), 1 - F.col("spread") * 5)
    risky = F.when(F.col("risks") > 0, F.col("distinct_risks") / F.col("risks")).otherwise(F.lit(1.0))
    score = F.when(F.col("opinions") < 2, F.lit(1.0)).otherwise(agree * 0.4 + sure * 0.4 + risky * 0.2)
    return out.select(group, score.alias("consensus"))


def candidate_score(n_evidence: Column, same_conclusion: Column, same_domain: Column, n_risks: Column) -> Column:
    raw = 0.5 + F.least(n_evidence * 0.1, F.lit(0.3)) + F.when(same_conclusion, 0.2).otherwise(0.0) - n_risks * 0.05 + F.when(same_domain, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def softmax_margin(rows: DataFrame, group: str, candidate: str, score: str, temperature: float = 10.0, least: float = 0.3) -> DataFrame:
    """The best candidate of each group by softmax probability, its margin, contrast, verdict and recommendation."""
    by = Window.partitionBy(group)
    e = F.exp((F.col(score) - F.max(score).over(by)) * temperature)
    probable = rows.withColumn("e", e).withColumn("probability", F.col("e") / F.sum("e").over(by))
    ranked = Window.partitionBy(group).orderBy(F.desc("probability"), candidate)
    probable = probable.withColumn("rank", F.row_number().over(ranked)).withColumn("second", F.lead("probability").over(ranked)).where("rank = 1")
    margin = F.when(F.col("second").isNull(), F.lit(1.0)).otherwise(F.col("probability") - F.col("second"))
    contrast = 1 - F.coalesce("second", F.lit(0.0))
    verified = (margin >= least) & (contrast >= 1 - least)
    advice = F.when(verified, "accept").when(margin < least, "gather_more_evidence").otherwise("challenge_assumptions")
    return probable.select(
        group,
        candidate,
        "probability",
        margin.alias("margin"),
        contrast.alias("contrast"),
        (margin * 0.6 + contrast * 0.4).alias("confidence"),
        verified.alias("verified"),
        advice.alias("recommendation"),
    )


def benchmark_score(closure: Column, reuse: Column, coverage: Column, lessons: Column) -> Column:
    """0 to 100 from closure and reuse rates (percent), coverage ratio and lesson count."""
    one = lambda c: F.least(F.lit(1.0), c)
    raw = 0.45 * one(closure / 100) + 0.25 * one(reuse / 100) + 0.15 * one(coverage) + 0.15 * one(lessons / 100)
    return js_round(raw * 100, 2)


def benchmark_label(score: Column) -> Column:
    return (
        F.when(score >= 85, "omniscient-approaching")
        .when(score >= 70, "advanced")
        .when(score >= 55, "intermediate")
        .when(score >= 40, "developing")
        .otherwise("nascent")
    )


def rubric_score(success: Column, completed: Column, steps: Column, ms: Column, errors: Column) -> Column:
    """0.35 correctness, 0.25 completeness, 0.20 efficiency, 0.20 robustness."""
    complete = F.when(steps > 0, completed / steps).otherwise(F.lit(0.5))
    time = F.when(ms.isNull() | (ms == 0), F.lit(5000)).otherwise(ms)
    quick = F.greatest(F.lit(0.0), 1 - time / 30000)
    robust = F.greatest(F.lit(0.0), 1 - errors * 0.2)
    return F.when(success, 1.0).otherwise(0.0) * 0.35 + complete * 0.25 + quick * 0.20 + robust * 0.20


def common_steps(rows: DataFrame, steps: str, success: str, limit: int = 10) -> DataFrame:
    out = rows.where(F.col(success)).select(F.explode(steps).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "step").limit(limit)


def issue_patterns(rows: DataFrame, group: str, issue: str) -> DataFrame:
    """Issues seen more than twice and in more than 15 % of a group's rows; above 30 % they are high."""
    out = rows.groupBy(group, issue).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    out = out.withColumn("rate", share).where("n > 2 and rate > 0.15")
    return out.withColumn("severity", F.when(F.col("rate") > 0.3, "high").otherwise("medium"))


def audit_report(rows: DataFrame, action: str, decisions: Sequence[str]) -> DataFrame:
    return rows.groupBy(action).agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("decision") == d, 1)).alias(d) for d in decisions])


def vector_energy(vector: Column) -> Column:
    """Root of the sum of squares over the length."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))) / F.size(vector)


def vector_mean(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(vector)


# -- sequences ----------------------------------------------------------------------


def normalised_state(identity: Column, dissonance: Column, decay: Column) -> Column:
    """The largest of the three signals, with their defaults for null."""
    return F.greatest(F.coalesce(identity, F.lit(0.5)), F.coalesce(dissonance, F.lit(0.0)), F.coalesce(decay, F.lit(0.5)))


def in_parts(rows: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Adds ``__part`` and ``__seq``: the rows sorted by entity and order over all tasks, by a range exchange.

    A part is one task's stretch of that order, so a part of an entity is bounded however many rows
    the entity has; parts and numbers rise with the order.
    """
    dealt = rows.repartitionByRange(entity, *order).sortWithinPartitions(entity, *order)
    return dealt.withColumn("__seq", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__seq", 33))


def affine_last(rows: DataFrame, entity: str, order: Sequence[str], value: str, factor: float, weight: float, out: str, start: float | None = 0.0) -> DataFrame:
    """(entity, out): the last of x = factor * x + weight * value over an entity's values in order, from ``start``.

    ``start`` None: the first value itself is the first state. Null values are passed over. Each value is
    an affine map, and maps compose: within a part to (number of values, sum of weighted values),
    then over the parts of an entity, which are as few as tasks.
    """
    known = in_parts(rows.where(F.col(value).isNotNull()).select(entity, *order, F.col(value).cast("double").alias(value)), entity, order)
    keep = lambda n: F.pow(F.lit(float(factor)), n)
    later = F.row_number().over(Window.partitionBy(entity, "__part").orderBy(F.desc("__seq"))) - 1
    parts = known.withColumn("__later", later).groupBy(entity, "__part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * weight * keep(F.col("__later"))).alias("c"), F.min_by(value, "__seq").alias("first")
    )
    every = Window.partitionBy(entity)
    upto = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(every)
    seed = F.lit(start) * keep(total) if start is not None else F.first("first").over(upto) * (1 - weight) * keep(total - 1)
    whole = parts.select(entity, (F.col("c") * keep(total - F.sum("n").over(upto))).alias("c"), seed.alias("seed"))
    return whole.groupBy(entity).agg((F.sum("c") + F.max("seed")).alias(out))


def ema(rows: DataFrame, entity: str, order: Sequence[str], value: str, alpha: float = 0.1) -> DataFrame:
    """The exponential moving average after the last value; the first value seeds it."""
    return affine_last(rows, entity, order, value, 1 - alpha, alpha, "ema", None)


def q_value(rows: DataFrame, entity: str, order: Sequence[str], reward: str, rate: float = 0.1, discount: float = 0.9) -> DataFrame:
    """(entity, q) after the last reward of q = q + rate * (reward + discount * q - q), from 0."""
    return affine_last(rows, entity, order, reward, 1 - rate * (1 - discount), rate, "q")


def last_values(rows: DataFrame, entity: str, order: Sequence[str], value: str, most: int) -> DataFrame:
    """(entity, values): the latest ``most`` values of each entity in order. Each task keeps so many of an entity before the shuffle."""
    back = F.row_number().over(Window.partitionBy(entity).orderBy(*[F.desc(c) for c in order]))
    recent = rows.withColumn("__back", back).where(F.col("__back") <= most)
    placed = [F.max(F.when(F.col("__back") == k, F.col(value))).alias(f"__v{k}") for k in range(most, 0, -1)]
    out = recent.groupBy(entity).agg(F.max("__back").alias("__n"), *placed)
    return out.select(entity, F.slice(F.array(*[f"__v{k}" for k in range(most, 0, -1)]), most + 1 - F.col("__n"), F.col("__n")).alias("values"))


def ema_series(rows: DataFrame, entity: str, order: Sequence[str], value: str, alpha: float = 0.1) -> DataFrame:
    """The average after each value: (entity, order..., value, ema). The first value is its own average; ``alpha`` below 1.

    An entity's rows are numbered and cut into chunks so long that a value's weight falls
    to a thousandth within one. Inside a chunk the average is a running sum of weighted
    values, as if nothing came before. What came before adds the ends of the six chunks
    ahead, each a thousandth of the next: what is older is below the precision of a double.
    Everything is a window over a chunk or over chunk ends; nothing is collected.
    """
    size = max(1, math.ceil(math.log(1000) / -math.log(1 - alpha)))
    keep = lambda n: F.pow(F.lit(1 - alpha), n)
    place = F.row_number().over(Window.partitionBy(entity).orderBy(*order)) - 1
    cut = rows.select(entity, *order, F.col(value).cast("double").alias(value)).withColumn("__place", place)
    inside = F.col("__place") % size
    cut = cut.withColumn("__chunk", F.floor(F.col("__place") / size))
    run = Window.partitionBy(entity, "__chunk").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("__own", keep(inside) * F.sum(F.col(value) * alpha * keep(-inside)).over(run))
    ends = own.groupBy(entity, "__chunk").agg(F.max_by("__own", "__place").alias("__last"), F.min_by(value, "__place").alias("__first"))
    by = Window.partitionBy(entity).orderBy("__chunk")
    fade = (1 - alpha) ** size
    before = [F.coalesce(F.lag("__last", j + 1).over(by), F.lit(0.0)) * fade**j for j in range(6)]
    seed = F.first("__first").over(by) * F.pow(F.lit(fade), F.col("__chunk"))
    carries = ends.select(F.col(entity).alias("__entity"), F.col("__chunk").alias("__at"), reduce(lambda a, b: a + b, before, seed).alias("__carry"))
    both = own.join(carries, F.col(entity).eqNullSafe(F.col("__entity")) & (F.col("__chunk") == F.col("__at")))
    return both.select(entity, *order, value, (F.col("__own") + F.col("__carry") * keep(inside + 1)).alias("ema"))


def sustained(rows: DataFrame, entity: str, order: Sequence[str], condition: Column, size: int = 10, share: float = 0.5) -> DataFrame:
    """Adds ``ratio`` and ``sustained``: whether the condition held in half of the last ten rows; false until there are ten."""
    by = Window.partitionBy(entity).orderBy(*order).rowsBetween(1 - size, 0)
    ratio = F.avg(F.when(condition, 1.0).otherwise(0.0)).over(by)
    full = F.count(F.lit(1)).over(by) == size
    return rows.withColumn("ratio", ratio).withColumn("sustained", full & (F.col("ratio") >= share))


def half_split_trend(rows: DataFrame, entity: str, order: Sequence[str], value: str, last: int = 20, band: float = 0.05) -> DataFrame:
    """Trend of the last twenty values: the second half's mean against the first half's; stable below five rows."""
    back = F.row_number().over(Window.partitionBy(entity).orderBy(*[F.desc(c) for c in order]))
    recent = rows.withColumn("back", back).where(F.col("back") <= last)
    recent = recent.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(entity)))
    later = F.col("back") <= F.col("size") - F.floor(F.col("size") / 2)
    out = recent.groupBy(entity).agg(
        F.avg(F.when(~later, F.col(value))).alias("before"), F.avg(F.when(later, F.col(value))).alias("after"), F.max("size").alias("n")
    )
    d = F.col("after") - F.col("before")
    trend = F.when((F.col("n") < 5) | d.isNull(), "stable").when(d > band, "improving").when(d < -band, "declining").otherwise("stable")
    return out.withColumn("trend", trend)


def streaks(rows: DataFrame, entity: str, order: Sequence[str], condition: Column) -> DataFrame:
    """Adds ``streak``: consecutive rows up to this one for which the condition holds."""
    by = Window.partitionBy(entity).orderBy(*order)
    breaks = F.sum(F.when(condition, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__break", breaks).withColumn("__hit", F.coalesce(condition, F.lit(False)).cast("int"))
    run = Window.partitionBy(entity, "__break").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum("__hit").over(run)).drop("__break", "__hit")


def trailing_streak(rows: DataFrame, entity: str, order: Sequence[str], condition: Column) -> DataFrame:
    """(entity, streak): the streak that the entity's last row ends."""
    marked = streaks(rows, entity, order, condition)
    return marked.groupBy(entity).agg(F.max_by("streak", F.struct(*order)).alias("streak"))


def low_quality_runs(rows: DataFrame, entity: str, order: Sequence[str], quality: str, least: float, run: int = 3) -> DataFrame:
    """Adds the running streak of low quality, the mean of the last five and what to do."""
    marked = streaks(rows, entity, order, F.col(quality) < least)
    mean = F.avg(quality).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(-4, 0))
    advice = F.when(F.col("streak") >= run, "suppress").when(F.col("mean_quality") < 0.5, "reduce-weight").otherwise("maintain")
    return marked.withColumn("mean_quality", mean).withColumn("recommendation", advice)


def running_mean(rows: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    by = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(value).over(by))


def repeats_in_last(rows: DataFrame, entity: str, order: Sequence[str], value: str, size: int, least: int) -> DataFrame:
    """Adds ``repeated``: whether the row's value occurs ``least`` times in the last ``size`` rows, itself included."""
    by_order = Window.partitionBy(entity).orderBy(*order)
    same = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    for k in range(1, size):
        same = same + F.when(F.lag(value, k).over(by_order) == F.col(value), 1).otherwise(0)
    return rows.withColumn("repeated", same >= least)


def frustration(edits: Column, loops: Column, short: Column, long: Column, negative: Column) -> Column:
    one = lambda c, n: F.least(F.lit(1.0), c / n)
    return F.least(F.lit(1.0), one(edits, 5) * 0.3 + one(loops, 3) * 0.3 + one(short, 10) * 0.1 + one(long, 5) * 0.1 + one(negative, 3) * 0.2)


def flow_phase(score: Column) -> Column:
    return F.when(score >= 0.6, "frustrated").when(score >= 0.3, "recovery").otherwise("flow")


def first_at_or_after(events: DataFrame, probes: DataFrame, entity: str, width: int) -> DataFrame:
    """(entity, t, at, next): for each probe (entity, t, at) the first event (entity, s) with s >= at, null if there is none. Whole numbers.

    A range merge: both are laid in order in buckets of ``width`` of an entity and the event seen last, coming
    from above, is the next one. A probe with none left in its bucket takes the first event of the next bucket
    that has any; buckets are one row each.
    """
    mine = F.col(entity).alias(entity)
    bucket = lambda c: F.floor(F.col(c) / width)
    none = F.lit(None).cast("long")
    both = events.select(mine, bucket("s").alias("b"), F.col("s").alias("x"), F.col("s").alias("event"), none.alias("t")).unionByName(
        probes.select(mine, bucket("at").alias("b"), F.col("at").alias("x"), none.alias("event"), "t")
    )
    down = Window.partitionBy(entity, "b").orderBy(F.desc("x"), F.col("event").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("next", F.last("event", ignorenulls=True).over(down)).where("t is not null")
    # one row a bucket: those with events know their first, those with probes alone ask for one
    firsts = both.groupBy(entity, "b").agg(F.min("event").alias("first"))
    above = Window.partitionBy(entity).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(F.col(entity).alias("__e"), F.col("b").alias("__b"), F.last("first", ignorenulls=True).over(above).alias("__first"))
    out = inside.join(firsts, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("b") == F.col("__b")))
    return out.select(mine, "t", F.col("x").alias("at"), F.coalesce("next", "__first").alias("next"))


def orbit(starts: DataFrame, steps: DataFrame, entity: str) -> DataFrame:
    """(entity, s) of everything reached from ``starts`` (entity, s) by following ``steps`` (entity, t, next), starts included.

    Pointer doubling over written tables: what is reached so far is sent on by the steps taken as often
    as all rounds before, so n rounds follow 2^n steps. No row is reached twice.
    """
    reached = Grown(starts.select(entity, F.col("s").cast("long").alias("s")), "orbit")
    known = steps.where("next is not null").select(F.col(entity).alias("__e"), "t", "next")
    # a row that no step leads to and that is no start is never asked for
    asked = known.select("__e", F.col("next").alias("t")).union(starts.select(entity, "s")).distinct()
    jump = written(known.join(asked, (known["__e"].eqNullSafe(asked["__e"])) & (known["t"] == asked["t"]), "left_semi"), "jump")
    while True:
        at = reached.all()
        further = at.join(jump, at[entity].eqNullSafe(jump["__e"]) & (at["s"] == jump["t"])).select(entity, F.col("next").alias("s"))
        if not reached.add(further):
            return reached.all()
        then = jump.select(F.col("__e").alias("__f"), F.col("t").alias("u"), F.col("next").alias("last"))
        jump = written(jump.join(then, jump["__e"].eqNullSafe(then["__f"]) & (jump["next"] == then["u"])).select("__e", "t", F.col("last").alias("next")), "jump")


def cooldown_gate(rows: DataFrame, entity: str, seconds: Column, minutes: int = 15) -> DataFrame:
    """(entity, second) of the events that pass: the first, then each that is ``minutes`` after the last one that passed.

    Times count in microseconds; events of one entity at the same time are one. Null times are left out.
    """
    gap = minutes * 60 * 1_000_000
    events = rows.select(F.col(entity).alias(entity), F.round(seconds * 1_000_000).cast("long").alias("s")).where("s is not null").distinct()
    events = written(events, "events")
    steps = first_at_or_after(events, events.select(entity, F.col("s").alias("t"), (F.col("s") + gap).alias("at")), entity, gap)
    firsts = events.groupBy(entity).agg(F.min("s").alias("s"))
    return orbit(firsts, steps, entity).select(entity, (F.col("s") / 1_000_000).alias("second"))


def reward(expressed: Column, success: Column, actual: Column | None = None) -> Column:
    known = F.when(success, 0.9).otherwise(0.1) if actual is None else F.coalesce(F.when(actual != 0, actual), F.when(success, 0.9).otherwise(0.1))
    base = (
        F.when(success & (expressed > 0.5), 1.0)
        .when(~success & (expressed < 0.5), 0.8)
        .when(~success & (expressed > 0.8), -1.0)
        .when(success & (expressed < 0.3), -0.5)
        .otherwise(0.0)
    )
    return F.round(base + (1 - F.abs(expressed - known)) * 0.5, 3)


def circuit_windows(rows: DataFrame, ts: str, success: Column, seconds: int = 60, least: int = 10, warn: float = 0.3, trip: float = 0.5) -> DataFrame:
    """State of a circuit breaker by tumbling window: closed below ten samples or 30 % failures, half open from there, open from 50 %."""
    out = rows.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~success, 1)).alias("failures"))
    fail = F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.col("failures") / F.col("n"))
    out = out.select(F.col("w.start").alias("window_start"), "n", "failures", fail.alias("fail_rate"))
    return out.withColumn("state", F.when(F.col("fail_rate") >= trip, "OPEN").when(F.col("fail_rate") >= warn, "HALF_OPEN").otherwise("CLOSED"))


def bounded_history(rows: DataFrame, entity: str, order: Sequence[str], most: int) -> DataFrame:
    """The latest ``most`` rows of each entity."""
    back = F.row_number().over(Window.partitionBy(entity).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("back", back).where(F.col("back") <= most).drop("back")
