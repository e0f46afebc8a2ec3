"""Queries over memory records: filters, rankings, eviction and compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import memory as M
from quern.plans.tables import AS_OF, EPOCH, MEM, memories, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_AGE = f"({AS_OF} - created_s)"
_IMP = "CASE WHEN importance IS NULL OR importance = 0 THEN 0.5e0 ELSE importance END"
_COMPUTED = f"(floor(greatest(0e0, least(1e0, 0.6e0 * ({_IMP}) + 0.2e0 * greatest(0e0, 1 - {_AGE} / 86400e0 / 90) + 0.2e0 * least(1e0, access_count / 20e0))) * 1000 + 0.5) / 1000)"
_WEEK = f"greatest(0e0, 1 - {_AGE} / 604800e0)"


@query(f"WITH {MEM} SELECT id, type FROM mem WHERE contains(lower(content), 'token')")
def memory_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """substring in either case."""
    return M.containing(memories(spark, sf_dir), "token").select("id", "type")


@query(f"WITH {MEM} SELECT id FROM mem WHERE list_has_all(tags, ['en', 'src3']) AND type = 'src3' AND contains(lower(content), 'the')")
def memory_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all tags, type and text."""
    return M.with_all_tags(memories(spark, sf_dir), ["en", "src3"], "src3", "the").select("id")


@query(f"WITH {MEM} SELECT id FROM mem WHERE list_contains(tags, 'fr') ORDER BY id LIMIT 20")
def memory_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first records of a tag."""
    return M.by_tag(memories(spark, sf_dir), "fr").select("id")


@query(f"WITH {MEM} SELECT id, created_s::BIGINT AS created_s FROM mem WHERE type = 'src5' ORDER BY created_s DESC, id DESC LIMIT 10")
def memory_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the newest records of a category."""
    return M.newest(memories(spark, sf_dir), F.col("type") == "src5", 10).select("id", F.col("created_s").cast("long").alias("created_s"))


@query(f"WITH {MEM} SELECT id FROM (SELECT id FROM mem WHERE list_contains(tags, 'de') AND NOT (created_s + 720 * 3600 <= {AS_OF}) ORDER BY id DESC LIMIT 5)")
def memory_ttl_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last records of a tag whose time to live has not run out."""
    live = F.array_contains("tags", "de") & ~M.expired(F.col("created_s") + 720 * 3600, AS_OF)
    return M.last_in_order(memories(spark, sf_dir), live, 5).select("id")


@query(f"WITH {MEM} SELECT count(*) FILTER (list_contains(tags, 'fr'))::BIGINT AS erased, count(*) FILTER (NOT list_contains(tags, 'fr'))::BIGINT AS kept FROM mem")
def memory_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts of an erasure by tag."""
    return M.erase(memories(spark, sf_dir), F.array_contains("tags", "fr"))[1]


@query(f"WITH {MEM} SELECT md5(substring(content, 1, 200)) AS key, count(*)::BIGINT AS n, min(id) AS first_id FROM mem GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records by the digest of their first 200 characters."""
    return memories(spark, sf_dir).groupBy(M.dedup_key(F.col("content")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {MEM}, s AS (SELECT id, importance + access_count * 0.01 + CASE WHEN {_AGE} < 86400 THEN 0.2 WHEN {_AGE} < 604800 THEN 0.1 ELSE 0.0 END
  + CASE WHEN contains(lower(content), 'and') THEN 0.3 ELSE 0.0 END AS score FROM mem)
SELECT id, round(score, 6)::DOUBLE AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 25""")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: importance, accesses, recency and match."""
    scored = memories(spark, sf_dir).select("id", F.round(M.relevance("and", AS_OF), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(25)


@query(f"""WITH {MEM}, s AS (SELECT id, floor(((CASE WHEN contains(lower(content), 'there') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content), 'one') THEN 2 ELSE 0 END)
  + importance * 0.5e0 + {_WEEK} * 0.3e0 + CASE WHEN layer = 'LEARNED' AND access_count > 12 THEN 0.1 ELSE 0.0 END)::DOUBLE * 1000 + 0.5) / 1000 AS score FROM mem)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25""")
def compressed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: query words, importance, recency and recent use."""
    s = memories(spark, sf_dir).select("id", M.compressed_relevance("there is one", AS_OF, F.col("access_count") > 12).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "id").limit(25)


_UTILITY = f"(floor((0.35e0 * 0.5e0 + 0.20e0 * greatest(0e0, 1 - {_AGE} / 3600e0 / 720) + 0.15e0 * least(1e0, access_count / 10e0) + 0.20e0 * ({_IMP}) + 0.10e0 * 1e0) * 1000 + 0.5) / 1000)"


@query(f"WITH {MEM} SELECT id, {_UTILITY} AS utility FROM mem")
def utility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: utility with the default relevance and full diversity."""
    return memories(spark, sf_dir).select("id", M.utility(AS_OF, F.lit(0.5), F.lit(1.0)).alias("utility"))


@query(f"""WITH {MEM}, s AS (SELECT id, floor(((CASE WHEN contains(c, 'onen') THEN 2 ELSE 0 END + CASE WHEN contains(c, 'thion') THEN 2 ELSE 0 END) + {_WEEK} * 0.5e0 + {_UTILITY} * 0.3e0) * 1000 + 0.5) / 1000 AS score
  FROM (SELECT *, lower(content) || ' ' || lower(array_to_string(tags, ' ')) AS c FROM mem))
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def utility_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: topics of a query, recency and utility."""
    score = M.topic_score(["onen", "thion"], AS_OF, M.utility(AS_OF, F.lit(0.5), F.lit(1.0)))
    return memories(spark, sf_dir).select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH {MEM} SELECT id, {_COMPUTED} AS importance FROM mem")
def computed_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: importance from its own value, age and accesses."""
    return memories(spark, sf_dir).select("id", M.computed_importance(AS_OF).alias("importance"))


@query(f"""WITH {MEM}, t AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: length(w) > 1)) AS w FROM mem),
s AS (SELECT id, len(list_intersect(w, ['the', 'and', 'onen', 'er'])) / sqrt(4 * greatest(1, len(w))) AS similarity FROM t)
SELECT id, round(similarity, 9)::DOUBLE AS similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 15""")
def reflection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: overlap of query words over the root of both sizes."""
    out = M.reflection_search(memories(spark, sf_dir), "The and onen ER", F.col("content"), limit=15)
    return out.select("id", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH {MEM}, t AS (SELECT id, type, lang, list_distinct(regexp_split_to_array(lower(content), '\\s+')) AS w FROM mem),
s AS (SELECT id, len(list_intersect(w, ['find', 'the', 'error', 'and'])) / (len(w) + 4 - len(list_intersect(w, ['find', 'the', 'error', 'and'])))::DOUBLE * 0.6
  + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END + CASE WHEN type = 'src1' THEN 0.2 ELSE 0 END AS score FROM t)
SELECT id, round(score, 9)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 15""")
def related_experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: task similarity with environment and type."""
    m = memories(spark, sf_dir)
    score = M.task_similarity("find the error and", F.col("content"), F.col("tags")[0] == "en", F.col("type") == "src1")
    return m.select("id", F.round(score, 9).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(15)


@query(f"""WITH {MEM}, u AS (
  SELECT substring(content, 1, 120) AS key, content AS text, access_count AS f, importance AS i, 0 AS source_no FROM mem
  UNION ALL SELECT substring(text, 1, 120), text, turn, 0.5, 1 FROM conversations),
s AS (SELECT key, source_no, least(1.0, CASE WHEN contains(lower(text), 'the and') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 0.2 ELSE 0 END
  + CASE WHEN contains(lower(text), 'and') THEN 0.2 ELSE 0 END + least(0.05 * f, 0.3) + least(0.02 * i, 0.2))::DOUBLE AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY substring(key, 1, 100) ORDER BY round(score, 9) DESC, source_no, key) AS rn FROM s WHERE score > 0)
SELECT md5(key) AS key_md5, source_no, round(score, 9) AS score FROM r WHERE rn = 1 ORDER BY round(score, 9) DESC, key LIMIT 20""")
def lesson_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 and the union of 2.9: lessons of two sources, one for each key."""
    a = memories(spark, sf_dir).select(
        F.substring("content", 1, 120).alias("key"), F.col("content").alias("text"), F.col("access_count").cast("double").alias("f"), F.col("importance").alias("i")
    )
    b = table(spark, sf_dir, "conversations").select(
        F.substring("text", 1, 120).alias("key"), "text", F.col("turn").cast("double").alias("f"), F.lit(0.5).alias("i")
    )
    score = F.round(M.lesson_score("the and", F.col("text"), F.col("f"), F.col("i")), 9)
    return M.lesson_search([a, b], score, 20).select(F.md5("key").alias("key_md5"), "source_no", "score")


@query(f"""WITH {MEM}, s AS (SELECT id, importance AS score, 0.5 AS w FROM mem UNION ALL SELECT id, access_count / 25.0, 0.3 FROM mem WHERE access_count > 3
  UNION ALL SELECT id, 1.0, 0.2 FROM mem WHERE layer = 'CORE')
SELECT id, round(sum(score * w), 6)::DOUBLE AS score FROM s GROUP BY 1 ORDER BY round(sum(score * w), 6) DESC, id LIMIT 20""")
def fused_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiers fused, the hottest twenty."""
    m = memories(spark, sf_dir)
    tiers = [
        m.select("id", F.col("importance").alias("score")),
        m.where("access_count > 3").select("id", (F.col("access_count") / 25.0).alias("score")),
        m.where("layer = 'CORE'").select("id", F.lit(1.0).alias("score")),
    ]
    return M.fused_tiers(tiers).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"""WITH {MEM}, c AS (SELECT *, {_COMPUTED} AS computed FROM mem), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY computed DESC, id DESC) AS rk FROM c)
SELECT id, layer, computed FROM r WHERE rk <= CASE layer WHEN 'LEARNED' THEN 40 WHEN 'EPHEMERAL' THEN 15 ELSE 2147483647 END""")
def evict_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least important records go until each layer meets its budget."""
    return M.enforce_budget(memories(spark, sf_dir), {"LEARNED": 40, "EPHEMERAL": 15}, AS_OF).select("id", "layer", "computed")


@query(f"""WITH {MEM}, g AS (SELECT id FROM mem WHERE layer = 'LEARNED' AND access_count <= 1 AND importance < 0.8 ORDER BY id LIMIT 50)
SELECT id FROM mem WHERE id NOT IN (SELECT id FROM g)""")
def evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seldom used records of the learned layer go."""
    return M.evict_lru(memories(spark, sf_dir)).select("id")


@query(f"WITH {MEM} SELECT id FROM (SELECT id FROM mem ORDER BY round(importance - 0.05 * {_AGE} / 86400.0, 9) DESC, id DESC LIMIT 100)")
def evict_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with the lowest usefulness less age go."""
    score = F.round(F.col("importance") - 0.05 * M.age(F.col("created_s"), AS_OF) / 86400.0, 9)
    return M.evict_lowest(memories(spark, sf_dir), score, 100).select("id")


@query("SELECT user_id AS key, max(event_id) AS last_access FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32")
def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a least-recently-used cache of 32 entries holds."""
    return M.lru_cache_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")), 32)


@query(f"WITH {MEM} SELECT id, round(0.6 * (access_count / 25.0) + 0.4 * importance, 6)::DOUBLE AS activation FROM mem ORDER BY round(0.6 * (access_count / 25.0) + 0.4 * importance, 6) DESC, id LIMIT 6")
def activation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most active engines by complexity and quality."""
    m = memories(spark, sf_dir).withColumn("a", F.round(0.6 * (F.col("access_count") / 25.0) + 0.4 * F.col("importance"), 6))
    return m.orderBy(F.desc("a"), "id").limit(6).select("id", F.col("a").alias("activation"))


@query("""WITH o AS (SELECT user_id, event_type AS option, avg(value) / 100e0 AS pragmatic, count(*) / 100e0 AS epistemic FROM events GROUP BY 1, 2),
v AS (SELECT *, pragmatic * 0.6e0 + epistemic * 0.4e0 * 0.8e0 AS value FROM o),
r AS (SELECT *, row_number() OVER w AS rk, lead(value) OVER w AS second FROM v WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, option))
SELECT user_id, option, round(value, 6)::DOUBLE AS value, round(value - coalesce(second, 0), 6)::DOUBLE AS margin, epistemic > pragmatic AS explores FROM r WHERE rk = 1""")
def active_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best action of each user, its margin and whether it explores."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("option"))
    o = e.agg((F.avg("value") / 100).alias("pragmatic"), (F.count(F.lit(1)) / 100.0).alias("epistemic"))
    out = M.active_inference(o, 0.4, "user_id")
    return out.select("user_id", "option", F.round("value", 6).alias("value"), F.round("margin", 6).alias("margin"), "explores")


@query(f"WITH {MEM}, k AS (SELECT id, importance + access_count / 100.0 AS raw, access_count FROM mem) SELECT id, round(raw * power(0.9, access_count), 9)::DOUBLE AS strength FROM k WHERE raw >= 0.55 ORDER BY round(raw * power(0.9, access_count), 9) DESC, id LIMIT 10")
def attention_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest items after decay."""
    m = memories(spark, sf_dir).withColumn("raw", F.col("importance") + F.col("access_count") / 100.0).where("raw >= 0.55")
    m = m.select("id", F.round(F.col("raw") * F.pow(F.lit(0.9), F.col("access_count")), 9).alias("strength"))
    return m.orderBy(F.desc("strength"), "id").limit(10)


@query(f"""WITH {MEM} SELECT id, CASE WHEN length(content) < 50 THEN 'none'
  WHEN contains(content, 'error') OR contains(content, 'fix') OR contains(content, 'bug') OR contains(content, 'definition') OR contains(content, 'rule') OR contains(content, 'principle') OR importance > 0.8 THEN 'preserve'
  WHEN len(tags) > 0 THEN 'extract_keywords' ELSE 'light' END AS strategy FROM mem""")
def compression_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how each record is compressed."""
    return memories(spark, sf_dir).select("id", M.strategy().alias("strategy"))


@query(f"""WITH {MEM}, w AS (SELECT id, access_count, importance, created_s, content, regexp_split_to_array(lower(content), '\\s+') AS ws FROM mem
    WHERE length(content) >= 50 AND NOT (contains(content, 'error') OR contains(content, 'fix') OR contains(content, 'bug') OR contains(content, 'definition') OR contains(content, 'rule') OR contains(content, 'principle') OR importance > 0.8)),
u AS (SELECT id, word, count(*) AS n, min(place) AS first FROM (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM w) WHERE length(word) > 3 GROUP BY 1, 2),
k AS (SELECT id, string_agg(word, ', ' ORDER BY n DESC, first) AS ks FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rn FROM u) WHERE rn <= 15 GROUP BY 1)
SELECT w.id, md5('[keywords: ' || coalesce(ks, '') || '] ' || substring(content, 1, floor(floor(200 * (1 - {_COMPUTED} * 0.5))::INT * 0.3)::INT)) AS digest FROM w LEFT JOIN k ON w.id = k.id""")
def compressed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the records that are compressed to keywords."""
    out = M.compressed(memories(spark, sf_dir), AS_OF).where("strategy = 'extract_keywords'")
    return out.select("id", F.md5("compressed").alias("digest"))


@query(f"""WITH {MEM}, r AS (SELECT id, row_number() OVER (PARTITION BY type ORDER BY created_s DESC, id DESC) AS n FROM mem)
SELECT id, CASE WHEN n <= 10 THEN 'L1' WHEN n <= 60 THEN 'L2' ELSE 'L3' END AS tier FROM r""")
def tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by rank of age."""
    return M.tiers_by_rank(memories(spark, sf_dir)).select("id", "tier")


@query(f"WITH {MEM} SELECT id, (access_count / 25.0) * importance * (1 - 0.5 * 0.2) > 0.3 AS stored FROM mem")
def store_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: whether a record is worth storing."""
    return memories(spark, sf_dir).select("id", M.store_decision(F.col("access_count") / 25.0, F.col("importance"), F.lit(0.2)).alias("stored"))


@query(f"""WITH {MEM}, q AS (SELECT id, 2.5 AS ease, (access_count % 4)::INT AS reps, (access_count + 1)::INT AS days, (id % 6)::INT AS quality FROM mem)
SELECT id, round(greatest(1.3, ease + 0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02)), 6)::DOUBLE AS ease, CASE WHEN quality >= 3 THEN reps + 1 ELSE 0 END AS repetitions,
  CASE WHEN quality < 3 OR reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE floor(days * ease + 0.5)::INT END AS "interval" FROM q""")
def review_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the SM-2 schedule."""
    a = F.col("access_count").cast("int")
    step = M.sm2_step(F.lit(2.5), a % 4, a + 1, (F.col("id") % 6).cast("int"))
    out = memories(spark, sf_dir).select("id", step.alias("s"))
    return out.select("id", F.round("s.ease", 6).alias("ease"), F.col("s.repetitions").alias("repetitions"), F.col("s.interval").alias("interval"))


@query(f"""WITH {MEM}, s AS (SELECT id, 1.0 + access_count AS strength, exp(-({_AGE} / 3600.0) / greatest(10.0 + access_count * 40, 0.1)) AS kept FROM mem)
SELECT id, round(CASE WHEN kept < 0.3 THEN strength * 1.5 ELSE strength END, 6)::DOUBLE AS strength FROM s""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is about to be forgotten is strengthened."""
    m = memories(spark, sf_dir).withColumn("strength", F.lit(1.0) + F.col("access_count"))
    kept = M.retention(10.0 + F.col("access_count") * 40, M.age(F.col("created_s"), AS_OF) / 3600.0)
    return M.consolidated(m, kept).select("id", F.round("strength", 6).alias("strength"))


_ = EPOCH
