"""Memory records: filters, relevance scores, ranking, tiers, eviction and compression.

Records have (id, type, layer, content, tags, importance, created_s, access_count);
``as_of`` is the instant in seconds that ages are taken against. Rankings end in
the record id, so that ties keep their order of insertion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.logs import keywords_per_record

LAYERS = ("CORE", "LEARNED", "EPHEMERAL")
HOUR, DAY, WEEK = 3600, 86_400, 604_800

# Words that are no topics.
STOP_WORDS = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "this", "that", "with", "from", "they", "been", "said", "each", "which", "their", "would", "about", "could", "other", "into", "more", "some", "what", "when", "make", "like", "time", "just", "know", "take", "people", "year", "your", "good", "them", "than", "then", "only", "look", "also")
# Words of the sentiment estimate.
POSITIVE = ("good", "great", "happy", "love", "thanks", " wonderful", "excellent", "helpful", "like", "appreciate", "好的", "谢谢", "开心", "喜欢", "棒", "有用")
NEGATIVE = ("bad", "wrong", "error", "fail", "hate", "terrible", "angry", "frustrated", "no", "never", "错了", "不好", "讨厌", "没用", "问题")


def falsy_default(value: Column, default) -> Column:
    """The default for null and for 0."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def to_fixed(value: Column, digits: int = 3) -> Column:
    """Rounds the binary value, half up."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def age(created_s: Column, as_of: int) -> Column:
    return F.lit(as_of) - created_s


# -- filters ------------------------------------------------------------------------


def containing(rows: DataFrame, text: str, column: str = "content") -> DataFrame:
    """Rows whose text contains ``text`` in either case. A literal, never a LIKE pattern."""
    return rows.where(F.lower(column).contains(text.lower()))


def with_all_tags(rows: DataFrame, tags: list[str], kind: str | None = None, text: str | None = None) -> DataFrame:
    """Rows that have every tag, and the type and text where given. The cheap conditions come first."""
    out = rows.where(F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in tags]))) == len(set(tags))) if tags else rows
    out = out.where(F.col("type") == kind) if kind else out
    return containing(out, text) if text else out


def by_tag(rows: DataFrame, tag: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` records that have the tag, in order of insertion."""
    return rows.where(F.array_contains("tags", tag)).orderBy("id").limit(limit)


def newest(rows: DataFrame, condition: Column, limit: int) -> DataFrame:
    return rows.where(condition).orderBy(F.desc("created_s"), F.desc("id")).limit(limit)


def last_in_order(rows: DataFrame, condition: Column, limit: int) -> DataFrame:
    """The last ``limit`` matching records, in order of insertion."""
    return rows.where(condition).orderBy(F.desc("id")).limit(limit).orderBy("id")


def expired(expires_s: Column, as_of: int) -> Column:
    """Whether a time to live has run out; null never does."""
    return F.coalesce(expires_s <= as_of, F.lit(False))


def erase(rows: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the counts erased and kept)."""
    hit = F.coalesce(scope, F.lit(False))
    counts = rows.agg(F.count(F.when(hit, 1)).alias("erased"), F.count(F.when(~hit, 1)).alias("kept"))
    return rows.where(~hit), counts


def dedup_key(content: Column) -> Column:
    """md5 of the first 200 characters."""
    return F.md5(F.substring(content, 1, 200))


# -- scores -------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def relevance(query: str | None, as_of: int) -> Column:
    """importance + 0.01 an access + 0.2 within a day or 0.1 within a week + 0.3 for a match."""
    old = age(F.col("created_s"), as_of)
    match = F.lower("content").contains(query.lower()) if query else F.lit(False)
    return (
        F.col("importance")
        + F.col("access_count") * 0.01
        + F.when(old < 24 * HOUR, 0.2).when(old < WEEK, 0.1).otherwise(0.0)
        + F.when(match, 0.3).otherwise(0.0)
    )


def compressed_relevance(query: str, as_of: int, recent: Column) -> Column:
    """2 a query word + 0.5 importance + 0.3 recency (7 days) + 0.1 in the recently-used list."""
    terms = [w for w in query.lower().split() if len(w) > 2]
    hits = reduce(lambda a, b: a + b, [F.when(F.lower("content").contains(w), 2).otherwise(0) for w in terms], F.lit(0))
    recency = F.greatest(F.lit(0.0), 1 - age(F.col("created_s"), as_of) / F.lit(float(WEEK)))
    lru = F.when((F.col("layer") == "LEARNED") & recent, 0.1).otherwise(0.0)
    return to_fixed(hits + F.col("importance") * 0.5 + recency * 0.3 + lru)


def topics(text: Column, limit: int = 10) -> Column:
    """Up to ten distinct topic words of a text, in order."""
    found = F.split(F.lower(text), r"[^a-z0-9一-鿿]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))), 1, limit)


def sentiment(text: Column) -> Column:
    """Positive words that occur minus negative ones."""
    low = F.lower(text)
    count = lambda ws: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in ws])
    return count(POSITIVE) - count(NEGATIVE)


def utility(as_of: int, relevance_: Column, diversity: Column, weights: tuple = (0.35, 0.20, 0.15, 0.20, 0.10)) -> Column:
    """Weighted relevance, recency (30 days), frequency (10 accesses), importance and diversity."""
    recency = F.greatest(F.lit(0.0), 1 - age(F.col("created_s"), as_of) / HOUR / 720)
    frequency = F.least(F.lit(1.0), F.col("access_count") / 10)
    parts = (relevance_, recency, frequency, falsy_default(F.col("importance"), 0.5), diversity)
    return to_fixed(reduce(lambda a, b: a + b, [F.lit(w) * p for w, p in zip(weights, parts, strict=True)]))


def diversity(similar: Column) -> Column:
    return F.when(similar == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - similar * 0.3))


def topic_score(query_topics: list[str], as_of: int, utility_: Column) -> Column:
    """2 a topic of the query that occurs in content or tags + 0.5 recency + 0.3 utility."""
    combined = F.concat_ws(" ", F.lower("content"), F.lower(F.array_join("tags", " ")))
    hits = reduce(lambda a, b: a + b, [F.when(combined.contains(t), 2).otherwise(0) for t in query_topics], F.lit(0))
    recency = F.greatest(F.lit(0.0), 1 - age(F.col("created_s"), as_of) / F.lit(float(WEEK)))
    return to_fixed(hits + recency * 0.5 + utility_ * 0.3)


def computed_importance(as_of: int, weights: tuple = (0.6, 0.2, 0.2)) -> Column:
    """0.6 importance, 0.2 linear recency over 90 days, 0.2 accesses up to 20; within 0 and 1."""
    recency = F.greatest(F.lit(0.0), 1 - age(F.col("created_s"), as_of) / DAY / 90)
    access = F.least(F.lit(1.0), F.col("access_count") / 20)
    value = weights[0] * falsy_default(F.col("importance"), 0.5) + weights[1] * recency + weights[2] * access
    return to_fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def char_bigrams(text: Column) -> Column:
    """Distinct two-character pieces of the text without white space."""
    bare = F.regexp_replace(F.lower(text), r"\s+", "")
    # a look ahead at each place: the bare text is made once, no place is counted from the text's begin, none is within a surrogate pair
    return F.array_distinct(F.regexp_extract_all(bare, F.lit("(?s)(?=([^\\x{dc00}-\\x{dfff}].))"), F.lit(1)))


def overlap_similarity(query_tokens: Column, tokens: Column) -> Column:
    """Common tokens over the root of the product of both sizes."""
    denominator = F.sqrt((F.size(query_tokens) * F.greatest(F.lit(1), F.size(tokens))).cast("double"))
    return F.when(denominator > 0, F.size(F.array_intersect(query_tokens, tokens)) / denominator).otherwise(F.lit(0.0))


def reflection_search(rows: DataFrame, query: str, text: Column, threshold: float = 0.1, limit: int = 5) -> DataFrame:
    """Best matches by overlap; character bigrams for a query in Han, kana or Hangul, words of two letters and more otherwise."""
    import re

    if re.search("[一-鿿぀-ゟ가-힯]", query):
        chars = re.sub(r"\s+", "", query.lower())
        own, tokens = list(dict.fromkeys(chars[i : i + 2] for i in range(len(chars) - 1))), char_bigrams(text)
    else:
        own, tokens = list(dict.fromkeys(w for w in query.lower().split() if len(w) > 1)), F.filter(word_set(text), lambda w: F.length(w) > 1)
    similarity = overlap_similarity(F.array(*[F.lit(w) for w in own]), tokens)
    return rows.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def task_similarity(task: str, text: Column, same_environment: Column, same_type: Column) -> Column:
    """0.6 word Jaccard + 0.2 for the same environment + 0.2 for the same task type."""
    own = F.array(*[F.lit(w) for w in dict.fromkeys(task.lower().split())])
    return jaccard(own, word_set(text)) * 0.6 + F.when(same_environment, 0.2).otherwise(0.0) + F.when(same_type, 0.2).otherwise(0.0)


def lesson_score(query: str, text: Column, frequency: Column, importance: Column) -> Column:
    """0.5 for the whole query + 0.2 a word + 0.05 an occurrence up to 0.3 + 0.02 importance up to 0.2; at most 1."""
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.when(low.contains(w), 0.2).otherwise(0.0) for w in query.lower().split() if len(w) > 1], F.lit(0.0))
    whole = F.when(low.contains(query.lower()), 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), whole + hits + F.least(0.05 * frequency, F.lit(0.3)) + F.least(0.02 * importance, F.lit(0.2)))


def lesson_search(sources: list[DataFrame], score: Column, limit: int) -> DataFrame:
    """The best lessons of several (key, ...) tables, one for each first hundred characters of the key: the best, then the earliest source."""
    rows = reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)])
    rows = rows.withColumn("score", score).where("score > 0").withColumn("short_key", F.substring("key", 1, 100))
    best = Window.partitionBy("short_key").orderBy(F.desc("score"), "source_no", "key")
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn").orderBy(F.desc("score"), "key").limit(limit)


def fused_tiers(tiers: list[DataFrame], weights: tuple = (0.5, 0.3, 0.2)) -> DataFrame:
    """Weighted sum of the scores that an id has in each of three (id, score) tiers; a missing tier counts nothing."""
    rows = reduce(
        lambda a, b: a.unionByName(b), [t.select("id", (F.col("score") * w).alias("part")) for t, w in zip(tiers, weights, strict=True)]
    )
    return rows.groupBy("id").agg(F.sum("part").alias("score"))


def activation(rows: DataFrame, complexity: Column, quality: Column, k: int) -> DataFrame:
    return rows.withColumn("activation", 0.6 * complexity + 0.4 * quality).orderBy(F.desc("activation"), "id").limit(k)


def attention(rows: DataFrame, score: Column, threshold: float, decay: float, steps: Column, limit: int = 10) -> DataFrame:
    """The strongest items after decay, of those that reached the threshold before."""
    kept = rows.withColumn("raw", score).where(F.col("raw") >= threshold)
    return kept.withColumn("strength", F.col("raw") * F.pow(F.lit(decay), steps)).orderBy(F.desc("strength"), "id").limit(limit)


def active_inference(options: DataFrame, certainty: float, group: str) -> DataFrame:
    """The best option of each group by 0.6 pragmatic + 0.4 epistemic value discounted by certainty, its margin, and whether it explores."""
    value = F.col("pragmatic") * 0.6 + F.col("epistemic") * 0.4 * F.lit(1 - 0.5 * certainty)
    by = Window.partitionBy(group).orderBy(F.desc("value"), "option")
    ranked = options.withColumn("value", value).withColumn("rank", F.row_number().over(by)).withColumn("second", F.lead("value").over(by))
    return ranked.where("rank = 1").select(
        group, "option", "value", (F.col("value") - F.coalesce("second", F.lit(0.0))).alias("margin"), (F.col("epistemic") > F.col("pragmatic")).alias("explores")
    )


# -- eviction -----------------------------------------------------------------------


#: Buckets that a rank by a score is taken in.
RANK_BUCKETS = 4096


def bucketed_rank(rows: DataFrame, group: list[str], score: str, ties: list[Column], low: float = 0.0, high: float = 1.0, rank: str = "rank") -> DataFrame:
    """Adds ``rank`` (from 1) within ``group`` by a falling score, ``ties`` deciding.

    A group may hold most rows: a rank is the number of rows in higher buckets of the
    score (running sums over a table of RANK_BUCKETS rows a group at most) plus the
    place within the bucket, so no task sorts a whole group.
    """
    share = (F.lit(high) - F.coalesce(F.col(score), F.lit(low))) / (high - low)
    named = rows.withColumn("__bucket", F.greatest(F.lit(0), F.least(F.lit(RANK_BUCKETS - 1), F.floor(share * RANK_BUCKETS))))
    counts = named.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__bucket") == F.col("__at"))
    place = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(F.desc(score), *ties))
    out = named.withColumn("__place", place).join(counts, same)
    return out.select(*rows.columns, (F.col("__before") + F.col("__place")).alias(rank))


def enforce_budget(rows: DataFrame, budgets: dict[str, int], as_of: int) -> DataFrame:
    """Evicts the least important records of each layer beyond its budget; a layer without one keeps all."""
    scored = rows.withColumn("computed", computed_importance(as_of))
    ranked = bucketed_rank(scored, ["layer"], "computed", [F.desc("id")])
    budget = reduce(lambda acc, kv: F.when(F.col("layer") == kv[0], kv[1]).otherwise(acc), budgets.items(), F.lit(2**31 - 1))
    return ranked.where(F.col("rank") <= budget).drop("rank")


def evict_lru(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Drops up to ``limit`` LEARNED records with at most one access and importance below 0.8, oldest insertions first."""
    weak = (F.col("layer") == "LEARNED") & (F.col("access_count") <= 1) & (F.col("importance") < 0.8)
    gone = rows.where(weak).orderBy("id").limit(limit).select("id")
    return rows.join(F.broadcast(gone), "id", "left_anti")


def evict_lowest(rows: DataFrame, score: Column, keep: int) -> DataFrame:
    """The ``keep`` records with the highest score; of equal ones the later insertion stays."""
    return rows.withColumn("evict_score", score).orderBy(F.desc("evict_score"), F.desc("id")).limit(keep)


def lru_cache_state(accesses: DataFrame, capacity: int, key: str = "key", order: str = "seq") -> DataFrame:
    """What a least-recently-used cache holds after all accesses: the keys with the latest accesses."""
    last = accesses.groupBy(key).agg(F.max(order).alias("last_access"))
    return last.orderBy(F.desc("last_access"), key).limit(capacity)


# -- compression and review ---------------------------------------------------------


def strategy() -> Column:
    """How a record is compressed: none, preserve, extract_keywords, summarize, truncate or light."""
    text = F.coalesce("content", F.lit(""))
    has = lambda *ws: reduce(lambda a, b: a | b, [text.contains(w) for w in ws])
    return (
        F.when(F.length(text) < 50, "none")
        .when(has("error", "fix", "bug") | has("definition", "rule", "principle") | (F.col("importance") > 0.8), "preserve")
        .when(F.coalesce(F.size("tags"), F.lit(0)) > 0, "extract_keywords")
        .when(F.size(F.split(text, "[.!?]", -1)) > 3, "summarize")
        .when(F.length(text) > 500, "truncate")
        .otherwise("light")
    )


def keep_length(as_of: int) -> Column:
    return F.floor(200 * (1 - computed_importance(as_of) * 0.5)).cast("int")


def compressed(rows: DataFrame, as_of: int) -> DataFrame:
    """Adds ``strategy`` and ``compressed``.

    Keywords are the fifteen most frequent words of more than three letters,
    earlier ones first among equals; they are counted in a grouped aggregate, so
    a long text costs no more than its words.
    """
    size = keep_length(as_of)
    text = F.coalesce("content", F.lit(""))
    rows = rows.withColumn("strategy", strategy())
    counted = keywords_per_record(rows.where("strategy = 'extract_keywords'"), "id", F.col("content"), 15)
    top = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))
    keywords = F.array_join(F.transform(F.coalesce("top", F.expr("cast(array() as array<struct<rank:int,word:string>>)")), lambda x: x["word"]), ", ")
    sentences = F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")
    name = F.col("strategy")
    out = (
        F.when(name == "preserve", text)
        .when(name == "extract_keywords", F.concat(F.lit("[keywords: "), keywords, F.lit("] "), F.substr(text, F.lit(1), F.floor(size * 0.3).cast("int"))))
        .when(name == "summarize", F.concat(F.lit("[summary] "), F.array_join(F.slice(sentences, 1, 3), ". "), F.lit(".")))
        .when(name == "truncate", F.concat(F.substr(text, F.lit(1), size), F.lit("...")))
        .otherwise(F.substr(text, F.lit(1), F.floor(size * 0.8).cast("int")))
    )
    return rows.join(top, "id", "left").withColumn("compressed", out).drop("top")


def store_decision(novelty: Column, importance: Column, load: Column, threshold: float = 0.3) -> Column:
    return novelty * importance * (1 - 0.5 * load) > threshold


def sm2_step(ease: Column, repetitions: Column, interval: Column, quality: Column) -> Column:
    """The SM-2 schedule: (ease, repetitions, interval in days) after a review of quality 0 to 5."""
    passed = quality >= 3
    miss = 5 - quality
    new_ease = F.greatest(F.lit(1.3), ease + 0.1 - miss * (0.08 + miss * 0.02))
    days = F.when(~passed, 1).when(repetitions == 0, 1).when(repetitions == 1, 6).otherwise(F.floor(interval * ease + 0.5).cast("int"))
    return F.struct(new_ease.alias("ease"), F.when(passed, repetitions + 1).otherwise(0).alias("repetitions"), days.alias("interval"))


def retention(strength: Column, idle_hours: Column) -> Column:
    """The forgetting curve exp(-t / S), a published form: the body is ours."""
    return F.exp(-idle_hours / F.greatest(strength, F.lit(0.1)))


def consolidated(rows: DataFrame, retained: Column, threshold: float = 0.3, factor: float = 1.5) -> DataFrame:
    """Strengthens what is about to be forgotten."""
    return rows.withColumn("strength", F.when(retained < threshold, F.col("strength") * factor).otherwise(F.col("strength")))


def tiers_by_rank(rows: DataFrame, sizes: tuple = (10, 50)) -> DataFrame:
    """L1 holds the latest records, L2 the next, L3 the rest; over a global order, so meant for one owner's records."""
    by = Window.partitionBy("type").orderBy(F.desc("created_s"), F.desc("id"))
    n = F.row_number().over(by)
    return rows.withColumn("tier", F.when(n <= sizes[0], "L1").when(n <= sum(sizes), "L2").otherwise("L3"))
