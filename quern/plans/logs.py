"""Queries over event logs and experiences: aggregates, sequences, tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import logs as L
from quern.operators import memory as M
from quern.plans.tables import EXP, MEM, experiences, memories, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: events by type."""
    return L.counts_by(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {MEM} SELECT element, count(*)::BIGINT AS n FROM (SELECT unnest(tags) AS element FROM mem) GROUP BY 1")
def count_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: records by tag."""
    return L.counts_by_element(memories(spark, sf_dir), "tags")


@query("""SELECT dimension, value, count(*)::BIGINT AS n FROM (SELECT 'event_type' AS dimension, event_type AS value FROM events
  UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events) GROUP BY ALL""")
def count_by_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: counts by several dimensions in one pass."""
    return L.counts_by_each(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("SELECT event_type, user_id, count(*)::BIGINT AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), (event_type, user_id))")
def count_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the same as grouping sets."""
    e = table(spark, sf_dir, "events")
    sets = [[F.col("event_type")], [F.col("user_id")], [F.col("event_type"), F.col("user_id")]]
    return e.groupingSets(sets, F.col("event_type"), F.col("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r.event_id, r.event_type FROM events r WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id % 3 = 0 AND c.user_id = r.user_id AND c.event_type = r.event_type)")
def pending_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without a confirmation of the same user and type."""
    e = table(spark, sf_dir, "events")
    return L.pending(e, e.where("event_id % 3 = 0"), ["user_id", "event_type"]).select("event_id", "event_type")


@query("""WITH c AS (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c)
SELECT user_id, n, floor(n / total::DOUBLE * 100 + 0.5)::BIGINT AS pct FROM t ORDER BY n DESC, user_id LIMIT 5""")
def top_user_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the five most frequent users with their share."""
    return L.top_share(table(spark, sf_dir, "events"), "user_id")


@query("""WITH p AS (SELECT lang, source FROM documents WHERE n_chars > 500), t AS (SELECT count(*) AS total FROM p)
SELECT 'concentration' AS kind, lang AS value, count(*)::BIGINT AS n, least(0.95, 0.5 + count(*) / 50.0)::DOUBLE AS confidence FROM p, t GROUP BY lang, total HAVING floor(count(*) / total::DOUBLE * 100 + 0.5) >= 25 AND total >= 20
UNION ALL SELECT 'reason', source, count(*)::BIGINT, 0.8 FROM p, t GROUP BY source, total HAVING floor(count(*) / total::DOUBLE * 100 + 0.5) >= 30 AND total >= 20""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: dimensions and reasons that hold too large a share."""
    return L.suggestions(table(spark, sf_dir, "documents").where("n_chars > 500"), "lang", "source")


@query(f"WITH {MEM} SELECT type, round(avg(importance), 6)::DOUBLE AS mean_importance, round(avg((access_count > 5)::INT), 6)::DOUBLE AS used_rate FROM mem GROUP BY 1")
def mean_and_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: means and rates by type."""
    m = memories(spark, sf_dir).groupBy("type")
    return m.agg(F.round(F.avg("importance"), 6).alias("mean_importance"), F.round(L.rate(F.col("access_count") > 5), 6).alias("used_rate"))


@query(f"""WITH {EXP} SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (success)::BIGINT AS n_success, round(avg(success::INT), 6)::DOUBLE AS success_rate,
  round(avg(value), 6)::DOUBLE AS mean_value, count(*) FILTER (ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)::BIGINT AS n_recent FROM xp GROUP BY 1""")
def experience_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience statistics with the last seven days."""
    x = L.experience_stats(experiences(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), "event_type")
    return x.withColumn("success_rate", F.round("success_rate", 6)).withColumn("mean_value", F.round("mean_value", 6))


@query("""WITH s AS (SELECT user_id, avg((event_type <> 'error')::INT) AS r, avg(value) / 100 AS u FROM events GROUP BY 1)
SELECT user_id, round(r, 6)::DOUBLE AS success_rate, CASE WHEN r < 0.5 THEN 'conservative' ELSE 'default' END AS strategy,
  round(CASE WHEN r >= 0.8 THEN least(1.0, u + 0.2) WHEN r < 0.5 THEN greatest(0.1, u - 0.3) ELSE u END, 6)::DOUBLE AS confidence FROM s""")
def strategy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy and confidence of each user."""
    e = experiences(spark, sf_dir).groupBy("user_id").agg(L.rate(F.col("success")).alias("success_rate"), (F.avg("value") / 100).alias("usefulness"))
    out = L.strategy(e)
    return out.select("user_id", F.round("success_rate", 6).alias("success_rate"), "strategy", F.round("confidence", 6).alias("confidence"))


@query("""SELECT source, count(*) FILTER (regexp_matches(lower(text), 'syntax|parse'))::BIGINT AS n_syntax, count(*) FILTER (regexp_matches(lower(text), 'dependency|module|import'))::BIGINT AS n_dependency,
  count(*) FILTER (regexp_matches(lower(text), 'permission|denied'))::BIGINT AS n_permission, count(*) FILTER (regexp_matches(lower(text), 'timeout'))::BIGINT AS n_timeout FROM documents GROUP BY 1""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by error kind."""
    return L.error_kind_counts(table(spark, sf_dir, "documents"), "text", "source")


_MODEL = """p AS (SELECT event_type AS from_state, lead(event_type) OVER w AS to_state, CASE WHEN lead(value) OVER w > 50 THEN 'big' ELSE 'small' END AS action FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT from_state, action, to_state, count(*)::BIGINT AS n FROM p WHERE to_state IS NOT NULL GROUP BY ALL),
m AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state, action)::DOUBLE AS probability FROM c)"""


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("action", F.when(F.col("value") > 50, "big").otherwise("small"))
    return L.transitions(e, "user_id", "event_type", "action", ["ts", "event_id"])


@query(f"WITH {_MODEL}, r AS (SELECT *, row_number() OVER (PARTITION BY from_state, action ORDER BY probability DESC, to_state) AS rank FROM m) SELECT from_state, action, to_state, n, round(probability, 9)::DOUBLE AS probability, rank::INT AS rank FROM r WHERE rank <= 5")
def transition_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition probabilities."""
    return L.predictions(_model(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


@query(f"""WITH {_MODEL}, k AS (SELECT from_state, action, max(probability) AS confidence FROM m GROUP BY 1, 2), s AS (SELECT *, confidence * 0.7 + (1 - confidence) * 0.3 AS score FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY from_state ORDER BY score DESC, action) AS rk FROM s)
SELECT from_state, action, round(confidence, 9)::DOUBLE AS confidence, round(score, 3)::DOUBLE AS score, CASE WHEN 1 - confidence > 0.5 THEN 'explore' ELSE 'exploit' END AS reason FROM r WHERE rk = 1""")
def choose_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action with the best transition score."""
    return L.choose_action(_model(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query("SELECT user_id, round(avg((event_type = 'error')::INT), 6)::DOUBLE AS error_rate FROM events GROUP BY 1")
def domain_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of each domain."""
    e = table(spark, sf_dir, "events").groupBy("user_id")
    return e.agg(F.round(L.rate(F.col("event_type") == "error"), 6).alias("error_rate"))


@query(f"WITH {EXP} SELECT least(9, floor(k / 100.0 * 10))::INT AS bin, count(*)::BIGINT AS n, round(avg(abs(k / 100e0 - value / 500e0)), 6)::DOUBLE AS error FROM xp GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: calibration error by tenths."""
    x = L.calibration(experiences(spark, sf_dir), F.col("value") / 500, F.col("k") / 100)
    return x.withColumn("error", F.round("error", 6))


@query(f"""WITH {EXP} SELECT concat_ws(':', least(3, floor(value / 500e0 * 4)::INT), least(3, floor(k / 100e0 * 4)::INT), least(3, floor((event_id % 10) / 10e0 * 4)::INT), event_type,
  CASE user_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2' END) AS key, count(*)::BIGINT AS n FROM xp GROUP BY 1""")
def state_bin_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-part state keys."""
    c = F.when(F.col("user_id") % 3 == 0, "low").when(F.col("user_id") % 3 == 1, "medium").otherwise("high")
    key = L.state_bin(F.col("value") / 500, F.col("k") / 100, (F.col("event_id") % 10) / 10, F.col("event_type"), c)
    return experiences(spark, sf_dir).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '([a-z]{3,}|[一-鿿]{2,6})', 1)) AS term FROM documents)
SELECT term, count(*)::BIGINT AS n FROM t WHERE term NOT IN ('the', 'and', 'les', 'der', 'die') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent terms without stop words."""
    stop = spark.createDataFrame([(w,) for w in ("the", "and", "les", "der", "die")], "term string")
    return L.term_frequencies(table(spark, sf_dir, "documents"), F.col("text"), stop)


@query("""WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS ws FROM documents)),
c AS (SELECT doc_id, word, count(*)::BIGINT AS n, min(place)::INT AS first FROM w WHERE length(word) > 3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS rank FROM c)
SELECT doc_id, word, n, rank FROM r WHERE rank <= 15""")
def keyword_topk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most frequent words of each document."""
    return L.keywords_per_record(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("doc_id", "word", "n", "rank")


_STOPS = ", ".join(f"'{w}'" for w in M.STOP_WORDS)


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct_ordered AS t FROM (SELECT conv_id, turn, (SELECT list(x ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(ws) AS x, unnest(range(len(ws))) AS p) WHERE length(x) > 2 AND x NOT IN ({_STOPS}) GROUP BY x))[1:10] AS list_distinct_ordered
  FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[^a-z0-9一-鿿]+') AS ws FROM conversations))),
u AS (SELECT unnest(t) AS topic FROM w)
SELECT topic, count(*)::BIGINT AS n FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def topic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of all turns."""
    t = table(spark, sf_dir, "conversations").select(F.explode(M.topics(F.col("text"))).alias("topic"))
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(20)


_SENTIMENT = " + ".join(f"contains(lower(text), '{w}')::INT" for w in M.POSITIVE) + " - " + " - ".join(f"contains(lower(text), '{w}')::INT" for w in M.NEGATIVE)


@query(f"SELECT role, round(avg({_SENTIMENT}), 6)::DOUBLE AS sentiment, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def mean_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentiment by role."""
    c = table(spark, sf_dir, "conversations").groupBy("role")
    return c.agg(F.round(F.avg(M.sentiment(F.col("text"))), 6).alias("sentiment"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) > 60")
def burst_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than sixty writes of a source in a day."""
    return L.bursts(table(spark, sf_dir, "events"), "event_type", "ts", 60)


_RECUR = """r AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)::BIGINT AS recurrences FROM events)"""


@query(f"WITH {_RECUR} SELECT event_id, recurrences FROM r")
def recurrence_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the type in the hour before, as a range window."""
    return L.recurrence(table(spark, sf_dir, "events"), "event_type", "ts").select("event_id", "recurrences")


@query(f"WITH {_RECUR} SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (recurrences >= 2)::BIGINT AS n_high, max(recurrences)::BIGINT AS most FROM r GROUP BY 1")
def recurrence_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrences by category."""
    return L.recurrence_by_category(L.recurrence(table(spark, sf_dir, "events"), "event_type", "ts"), "event_type", "recurrences")


@query("SELECT user_id, event_type, count(*)::BIGINT AS n, min(event_id) AS first_seen FROM events GROUP BY ALL HAVING count(*) >= 3")
def promoted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns seen three times and more."""
    return L.promoted(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT user_id, count(*)::BIGINT AS usage, count(*) FILTER (event_type <> 'error')::BIGINT AS successes, epoch(min(ts))::BIGINT AS first_used, epoch(max(ts))::BIGINT AS last_used FROM events GROUP BY 1")
def strategy_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage, successes, first and last use."""
    out = L.strategy_usage(experiences(spark, sf_dir), "user_id", "ts", "success")
    s = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000 + 0.5).cast("long").alias(c)
    return out.select("user_id", "usage", "successes", s("first_used"), s("last_used"))


@query(f"""WITH {EXP}, g AS (SELECT user_id, count(event_type) AS n, count(DISTINCT event_type) AS d, var_pop(CASE WHEN k IS NULL OR k = 0 THEN 0.5 ELSE k / 100e0 END) AS spread, count(*) AS opinions,
  count(CASE WHEN value > 80 THEN (value / 40)::INT END) AS risks, count(DISTINCT CASE WHEN value > 80 THEN (value / 40)::INT END) AS dr FROM xp GROUP BY 1)
SELECT user_id, round(CASE WHEN opinions < 2 THEN 1.0 ELSE (n - d + 1) / n::DOUBLE * 0.4 + greatest(0.0, 1 - spread * 5) * 0.4 + CASE WHEN risks > 0 THEN dr / risks::DOUBLE ELSE 1.0 END * 0.2 END, 6)::DOUBLE AS consensus FROM g""")
def consensus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of conclusions, confidences and risks."""
    x = experiences(spark, sf_dir).withColumn("confidence", F.col("k") / 100).withColumn("risk", F.when(F.col("value") > 80, F.rint(F.col("value") / 40).cast("int")))
    return L.consensus(x, "user_id", "event_type", "confidence", "risk").select("user_id", F.round("consensus", 6).alias("consensus"))


@query("""WITH c AS (SELECT user_id, event_type, greatest(0e0, least(1e0, 0.5e0 + least(count(*) * 0.1e0, 0.3e0) + CASE WHEN event_type = 'view' THEN 0.2e0 ELSE 0e0 END - count(*) FILTER (value > 80) * 0.05e0 + CASE WHEN max(value) > 200 THEN 0.1e0 ELSE 0e0 END)) AS score FROM events GROUP BY 1, 2),
e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY user_id)) * 10) AS e FROM c), p AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS probability FROM e),
r AS (SELECT *, row_number() OVER w AS rk, lead(probability) OVER w AS second FROM p WINDOW w AS (PARTITION BY user_id ORDER BY round(probability, 9) DESC, event_type)),
b AS (SELECT *, CASE WHEN second IS NULL THEN 1.0 ELSE probability - second END AS margin, 1 - coalesce(second, 0) AS contrast FROM r WHERE rk = 1)
SELECT user_id, event_type, round(probability, 6)::DOUBLE AS probability, round(margin, 6)::DOUBLE AS margin, round(contrast, 6)::DOUBLE AS contrast, round(margin * 0.6 + contrast * 0.4, 6)::DOUBLE AS confidence,
  margin >= 0.3 AND contrast >= 0.7 AS verified, CASE WHEN margin >= 0.3 AND contrast >= 0.7 THEN 'accept' WHEN margin < 0.3 THEN 'gather_more_evidence' ELSE 'challenge_assumptions' END AS recommendation FROM b""")
def softmax_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scores, softmax, margin, contrast and verdict."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    e = e.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 80, 1)).alias("risks"), F.max("value").alias("top"))
    c = e.withColumn("score", L.candidate_score(F.col("n"), F.col("event_type") == "view", F.col("top") > 200, F.col("risks")))
    out = L.softmax_margin(c, "user_id", "event_type", "score")
    return out.select("user_id", "event_type", *[F.round(x, 6).alias(x) for x in ("probability", "margin", "contrast", "confidence")], "verified", "recommendation")


@query("""WITH s AS (SELECT user_id, floor((0.45e0 * least(1e0, avg((event_type <> 'error')::INT) * 100 / 100) + 0.25e0 * least(1e0, avg(value) / 100) + 0.15e0 * least(1e0, count(DISTINCT event_type) / 5e0) + 0.15e0 * least(1e0, count(*) / 100e0)) * 100 * 100 + 0.5 + 1e-9) / 100 AS score FROM events GROUP BY 1)
SELECT user_id, score, CASE WHEN score >= 85 THEN 'omniscient-approaching' WHEN score >= 70 THEN 'advanced' WHEN score >= 55 THEN 'intermediate' WHEN score >= 40 THEN 'developing' ELSE 'nascent' END AS label FROM s""")
def benchmark_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted benchmark score and label."""
    e = experiences(spark, sf_dir).groupBy("user_id")
    e = e.agg(L.rate(F.col("success")).alias("r"), F.avg("value").alias("v"), F.count_distinct("event_type").alias("t"), F.count(F.lit(1)).alias("n"))
    out = e.select("user_id", L.benchmark_score(F.col("r") * 100, F.col("v"), F.col("t") / 5, F.col("n")).alias("score"))
    return out.withColumn("label", L.benchmark_label(F.col("score")))


@query("""WITH s AS (SELECT unnest(string_split(lower(text), ' ')) AS step FROM conversations WHERE role = 'assistant')
SELECT step, count(*)::BIGINT AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def common_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common steps of successes."""
    c = table(spark, sf_dir, "conversations").select(F.split(F.lower("text"), " ", -1).alias("steps"), (F.col("role") == "assistant").alias("ok"))
    return L.common_steps(c, "steps", "ok")


@query(f"""WITH {EXP} SELECT event_id, round(success::INT * 0.35e0 + CASE WHEN k > 0 THEN (k // 2) / k::DOUBLE ELSE 0.5e0 END * 0.25e0 + greatest(0e0, 1 - (CASE WHEN value = 0 THEN 5000 ELSE value * 100 END) / 30000) * 0.2e0 + greatest(0e0, 1 - (k % 7) * 0.2e0) * 0.2e0, 6)::DOUBLE AS score FROM xp""")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric score of each experience."""
    k = F.col("k")
    score = L.rubric_score(F.col("success"), F.floor(k / 2), k, F.col("value") * 100, k % 7)
    return experiences(spark, sf_dir).select("event_id", F.round(score, 6).alias("score"))


@query("""WITH c AS (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS rate FROM c)
SELECT user_id, event_type, n, round(rate, 6)::DOUBLE AS rate, CASE WHEN rate > 0.3 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE n > 2 AND rate > 0.15""")
def issue_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that recur."""
    return L.issue_patterns(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("rate", F.round("rate", 6))


@query("""WITH d AS (SELECT event_type, CASE WHEN value < 20 THEN 'granted' WHEN value < 60 THEN 'denied' ELSE 'escalated' END AS decision FROM events)
SELECT event_type, count(*)::BIGINT AS total, count(*) FILTER (decision = 'granted')::BIGINT AS granted, count(*) FILTER (decision = 'denied')::BIGINT AS denied, count(*) FILTER (decision = 'escalated')::BIGINT AS escalated FROM d GROUP BY 1""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by action."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").withColumn("decision", F.when(v < 20, "granted").when(v < 60, "denied").otherwise("escalated"))
    return L.audit_report(e, "event_type", ["granted", "denied", "escalated"])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / len(embedding), 6)::DOUBLE AS energy, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6)::DOUBLE AS mean FROM embeddings")
def vector_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy and mean of vectors."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(L.vector_energy(v), 6).alias("energy"), F.round(L.vector_mean(v), 6).alias("mean"))


_SERIES = "s AS (SELECT user_id, list(value / 500e0 ORDER BY ts, event_id) AS v FROM events GROUP BY 1)"


@query(f"WITH {_SERIES} SELECT user_id, round(list_reduce(v, lambda a, x: x * 0.1e0 + a * 0.9e0), 9)::DOUBLE AS ema FROM s")
def ema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponential moving average of each user."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value") / 500)
    return L.ema(e, "user_id", ["ts", "event_id"], "v").select("user_id", F.round("ema", 9).alias("ema"))


@query(f"WITH {_SERIES} SELECT user_id, round(list_reduce(v, lambda a, x: x * 0.2e0 + a * 0.8e0), 9)::DOUBLE AS mood FROM s")
def mood_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend of old mood and new value."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value") / 500)
    return L.ema(e, "user_id", ["ts", "event_id"], "v", 0.2).select("user_id", F.round("ema", 9).alias("mood"))


@query(f"WITH {EXP} SELECT event_id, round(greatest(coalesce(value / 500e0, 0.5), coalesce(k / 200e0, 0), 1 - k / 100e0), 6)::DOUBLE AS raw FROM xp")
def normalised_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of three signals."""
    k = F.col("k")
    return experiences(spark, sf_dir).select("event_id", F.round(L.normalised_state(F.col("value") / 500, k / 200, 1 - k / 100), 6).alias("raw"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value / 500e0 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
e AS (SELECT user_id, event_id, n, v AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, o.v * 0.1e0 + e.ema * 0.9e0 FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1),
w AS (SELECT *, avg((ema > 0.1)::INT) OVER x AS ratio, count(*) OVER x AS full_n FROM e WINDOW x AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, round(ratio, 6)::DOUBLE AS ratio, full_n = 10 AND ratio >= 0.5 AS sustained FROM w""")
def sustained_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 over W1: whether half of the last ten averages drift."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value") / 500)
    s = L.ema_series(e, "user_id", ["ts", "event_id"], "v")
    out = L.sustained(s, "user_id", ["ts", "event_id"], F.col("ema") > 0.1)
    return out.select("event_id", F.round("ratio", 6).alias("ratio"), "sustained")


@query("""WITH b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM b WHERE back <= 20),
h AS (SELECT user_id, avg(value) FILTER (back > n - n // 2) AS before, avg(value) FILTER (back <= n - n // 2) AS after, max(n) AS n FROM r GROUP BY 1)
SELECT user_id, round(before, 6)::DOUBLE AS before, round(after, 6)::DOUBLE AS after, CASE WHEN n < 5 THEN 'stable' WHEN after - before > 0.05 THEN 'improving' WHEN after - before < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def trend_half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of the last twenty values."""
    out = L.half_split_trend(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "trend")


_STREAK = """b AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS brk FROM events),
k AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, brk ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM b)"""


@query(f"WITH {_STREAK} SELECT event_id, streak FROM k")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running streak of errors."""
    return L.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak")


@query(f"WITH {_STREAK} SELECT user_id, arg_max(streak, (ts, event_id))::BIGINT AS streak FROM k GROUP BY 1")
def trailing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streak that each user's last event ends."""
    return L.trailing_streak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""WITH b AS (SELECT *, sum((value >= 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS brk FROM events),
k AS (SELECT *, sum((value < 20)::INT) OVER (PARTITION BY user_id, brk ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM b)
SELECT event_id, streak, round(m, 6)::DOUBLE AS mean_quality, CASE WHEN streak >= 3 THEN 'suppress' WHEN m < 0.5 THEN 'reduce-weight' ELSE 'maintain' END AS recommendation FROM k""")
def low_quality_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of low quality and the mean of the last five."""
    out = L.low_quality_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20)
    return out.select("event_id", "streak", F.round("mean_quality", 6).alias("mean_quality"), "recommendation")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9)::DOUBLE AS running_mean FROM events")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean so far."""
    out = L.running_mean(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", F.round("running_mean", 9).alias("running_mean"))


@query("""WITH w AS (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events)
SELECT event_id, len(list_filter(l, lambda x: x = event_type)) >= 3 AS repeated FROM w""")
def repeated_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind three times in the last five."""
    return L.repeats_in_last(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 5, 3).select("event_id", "repeated")


@query("""WITH c AS (SELECT user_id, least(1e0, count(*) FILTER (event_type = 'click') / 500e0 / 5) AS a, least(1e0, count(*) FILTER (event_type = 'error') / 10e0 / 3) AS b, least(1e0, count(*) FILTER (event_type = 'view') / 10e0 / 10) AS c, least(1e0, count(*) FILTER (event_type = 'signup') / 10e0 / 5) AS d, least(1e0, count(*) FILTER (value > 100) / 3e0) AS e FROM events GROUP BY 1),
s AS (SELECT user_id, least(1e0, a * 0.3e0 + b * 0.3e0 + c * 0.1e0 + d * 0.1e0 + e * 0.2e0) AS s FROM c)
SELECT user_id, round(s, 6)::DOUBLE AS score, CASE WHEN s >= 0.6 THEN 'frustrated' WHEN s >= 0.3 THEN 'recovery' ELSE 'flow' END AS phase FROM s""")
def frustration_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frustration score and phase."""
    n = lambda c: F.count(F.when(c, 1))
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").groupBy("user_id")
    e = e.agg((n(t == "click") / 500).alias("a"), (n(t == "error") / 10).alias("b"), (n(t == "view") / 10).alias("c"), (n(t == "signup") / 10).alias("d"), n(F.col("value") > 100).alias("e"))
    out = e.select("user_id", L.frustration(*[F.col(c) for c in "abcde"]).alias("s"))
    return out.select("user_id", F.round("s", 6).alias("score"), L.flow_phase(F.col("s")).alias("phase"))


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'error'),
p AS (SELECT user_id, n, s, s AS last, true AS ok FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.s, CASE WHEN o.s - p.last >= 86400 THEN o.s ELSE p.last END, o.s - p.last >= 86400 FROM p JOIN o ON o.user_id = p.user_id AND o.n = p.n + 1)
SELECT user_id, count(*)::BIGINT AS n FROM p WHERE ok GROUP BY 1""")
def cooldown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions that a cool-down of a day lets through."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return L.cooldown_gate(e, "user_id", F.col("s"), 24 * 60).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS failures FROM events GROUP BY 1),
f AS (SELECT *, CASE WHEN n < 10 THEN 0 ELSE failures / n::DOUBLE END::DOUBLE AS r FROM w)
SELECT epoch(window_start)::BIGINT AS window_start, n, failures, round(r, 6)::DOUBLE AS fail_rate, CASE WHEN r >= 0.5 THEN 'OPEN' WHEN r >= 0.3 THEN 'HALF_OPEN' ELSE 'CLOSED' END AS state FROM f""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaker states by tumbling window (an hour here: a minute holds too few events)."""
    out = L.circuit_windows(table(spark, sf_dir, "events"), "ts", F.col("event_type") != "error", 3600)
    return out.select(F.unix_timestamp(F.col("window_start").cast("timestamp")).alias("window_start"), "n", "failures", F.round("fail_rate", 6).alias("fail_rate"), "state")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE b <= 10")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten events of each user."""
    return L.bounded_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("event_id")


@query(f"""WITH {EXP}, r AS (SELECT event_id, success, k / 100e0 AS c, CASE WHEN success THEN 0.9e0 ELSE 0.1e0 END AS known FROM xp)
SELECT event_id, round(CASE WHEN success AND c > 0.5 THEN 1e0 WHEN NOT success AND c < 0.5 THEN 0.8e0 WHEN NOT success AND c > 0.8 THEN -1e0 WHEN success AND c < 0.3 THEN -0.5e0 ELSE 0e0 END + (1 - abs(c - known)) * 0.5e0, 3)::DOUBLE AS reward FROM r""")
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reward of an expressed confidence."""
    return experiences(spark, sf_dir).select("event_id", L.reward(F.col("k") / 100, F.col("success")).alias("reward"))


@query(f"""WITH {EXP}, s AS (SELECT user_id, list((CASE WHEN success THEN 1e0 ELSE -1e0 END) ORDER BY ts, event_id) AS v FROM xp GROUP BY 1)
SELECT user_id, round(list_reduce(list_prepend(0e0, v), lambda q, r: q + 0.1e0 * (r + 0.9e0 * q - q)), 9)::DOUBLE AS q FROM s""")
def q_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a Q value folded over a user's outcomes."""
    e = experiences(spark, sf_dir).withColumn("r", F.when(F.col("success"), 1.0).otherwise(-1.0))
    out = L.q_value(e, "user_id", ["ts", "event_id"], "r")
    return out.select("user_id", F.round("q", 9).alias("q"))
