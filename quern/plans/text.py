"""Queries over texts: gates, screens, and rule operators, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import gates
from quern.operators import logs as L
from quern.operators.rules import Match
from quern.operators.screen import screened
from quern.plans.tables import settled, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ACTION = f"""CASE WHEN text IS NULL OR trim(text) = '' THEN 'pass'
  WHEN {gates.sql_level('text')} >= 3 THEN 'block'
  WHEN {gates.sql_level('text')} >= 2 AND {gates.sql_pii_any('text')} THEN 'block'
  WHEN {gates.sql_pii_any('text')} THEN 'rewrite' ELSE 'pass' END"""


@query(f"SELECT lang, {_ACTION} AS action, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def outbound_gate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 over T44 and T46: actions of the outbound gate by language."""
    docs = spread(table(spark, sf_dir, "documents")).select("lang", gates.outbound_action(F.col("text")).alias("action"))
    return docs.groupBy("lang", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT doc_id, "
    + ", ".join(f"{gates.sql_count('text', p, ic)}::BIGINT AS n_{name}" for name, p, ic, _ in gates.PII_RULES)
    + f" FROM documents WHERE {gates.sql_pii_any('text')}"
)
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by rule in the texts that have any."""
    counts = {f"n_{name}": c for name, c in gates.pii_counts(F.col("text")).items()}
    found = settled(spread(table(spark, sf_dir, "documents")).select("doc_id", *[c.alias(name) for name, c in counts.items()]))
    return found.where(F.greatest(*counts) > 0)


def _masked_sql() -> str:
    out = "text"
    for _, p, ic, mask in gates.PII_RULES:
        if mask:
            out = f"regexp_replace({out}, {gates.sql_text(('(?i)' if ic else '') + p)}, {gates.sql_text(mask)}, 'g')"
    return out


@query(f"SELECT doc_id, md5({_masked_sql()}) AS masked_md5 FROM documents")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the masked texts."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(gates.mask_pii(F.col("text"))).alias("masked_md5"))


@query(f"SELECT {gates.sql_level('text')}::INT AS level, count(*)::BIGINT AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) GROUP BY ALL")
def classify_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by classification level."""
    both = table(spark, sf_dir, "documents").select("text").unionAll(table(spark, sf_dir, "conversations").select("text"))
    return both.groupBy(gates.level(F.col("text")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


_CLAIMS = " + ".join(f"len(regexp_extract_all(text, {gates.sql_text(p)}))" for p in gates.CLAIMS_EN)
_HEDGED = " OR ".join(f"regexp_matches(text, {gates.sql_text(p)})" for p in gates.HEDGES_EN)
_GAP = f"CASE WHEN length(text) >= 20 AND ({_CLAIMS}) > 2 AND NOT ({_HEDGED}) THEN least(0.5, (({_CLAIMS}) - 2) * 0.1) ELSE 0 END::DOUBLE"
_PHRASES = ", ".join(
    f"CASE WHEN {Match(p, ic).sql('text')} THEN {sev} END" for p, ic, sev in gates.OVERCONFIDENCE_EN + gates.MASQUERADE_EN
)


@query(f"SELECT doc_id, ({_CLAIMS})::BIGINT AS claims, ({_HEDGED}) AS hedged, round({_GAP}, 6) AS gap FROM documents")
def uncertainty_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, hedges and the gap of each document (none has a Han character)."""
    t = F.col("text")
    rows = settled(spread(table(spark, sf_dir, "documents")).select("doc_id", "text", gates.claim_count(t).cast("long").alias("claims"), gates.has_hedge(t).alias("hedged")))
    return rows.select("doc_id", "claims", "hedged", F.round(gates.uncertainty_gap(t, F.col("claims"), F.col("hedged")), 6).alias("gap"))


@query(f"""WITH f AS (SELECT doc_id, list_filter([{_PHRASES}, CASE WHEN {_GAP} > 0 THEN floor({_GAP} * 100 + 0.5)::INT END], lambda x: x IS NOT NULL) AS s
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - conv_id * 100 - turn, text FROM conversations))
SELECT doc_id, len(s)::BIGINT AS n_findings, coalesce(list_max(s), 0)::INT AS most_severe,
  CASE WHEN len(list_filter(s, lambda x: x >= 70)) > 0 THEN 'rewrite' WHEN len(s) > 0 THEN 'hedge' ELSE 'pass' END AS action FROM f""")
def output_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 over T41, T42 and T43: the output screen of all documents and turns."""
    both = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = table(spark, sf_dir, "conversations").select((F.lit(-1) - F.col("conv_id") * 100 - F.col("turn")).alias("doc_id"), "text")
    found = screened(spread(both.unionByName(turns)), F.col("text"), lambda: {"s": gates.output_severities(F.col("text"))})
    return found.select(
        "doc_id",
        F.size("s").cast("long").alias("n_findings"),
        F.coalesce(F.array_max("s"), F.lit(0)).alias("most_severe"),
        gates.output_action(F.col("s")).alias("action"),
    )


@query("""WITH s AS (
  SELECT doc_id, n_chars % 17 = 0 AS blocked, n_chars % 5 = 0 AS contradictory, (n_chars % 10) / 10.0 AS score, n_chars % 3 = 0 AS scored, (n_chars % 7)::INT AS issues, lang
  FROM documents), v AS (
  SELECT *, scored AND (score < 0.5) AS verification, issues > 4 AS checklist, lang = 'es' AS unwell FROM s)
SELECT doc_id,
  CASE WHEN blocked THEN 'block' WHEN contradictory THEN 'rewrite' WHEN verification OR checklist OR unwell THEN 'verify' ELSE 'pass' END AS action,
  round(CASE WHEN blocked THEN 0.0 WHEN contradictory THEN 0.3 WHEN verification THEN score WHEN checklist OR unwell THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS score,
  (CASE WHEN blocked OR contradictory THEN 1 ELSE verification::INT + checklist::INT + unwell::INT END)::BIGINT AS n_signals,
  NOT (blocked OR contradictory) AS allowed
FROM v""")
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 to V3: signals made from document columns, folded into action, score and signals."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    score = F.when(n % 3 == 0, (n % 10) / 10)
    nothing = F.expr("cast(array() as array<string>)")
    flags = {
        "blocked_by_firewall": gates.triggered_number((n % 17 == 0).cast("int")),
        "self_contradictory": n % 5 == 0,
        "verification": gates.triggered_score(score, nothing),
        "output_checklist_issues": gates.triggered_array(F.when(n % 7 > 4, F.array(F.lit("open"))).otherwise(nothing)),
        "reflection_health": gates.triggered_health(F.when(F.col("lang") == "es", "stuck").otherwise("ok")),
    }
    out = docs.select("doc_id", gates.verdict(flags, score).alias("v"))
    return out.select(
        "doc_id",
        "v.action",
        F.round("v.score", 6).alias("score"),
        F.size("v.signals").cast("long").alias("n_signals"),
        gates.allowed(F.col("v.action")).alias("allowed"),
    )


@query(f"""WITH a AS (SELECT d.lang AS cls, {_ACTION} <> 'pass' AS p, l.toxic = 1 AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT cls, count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM a GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM g)
SELECT cls, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6)::DOUBLE AS "precision", round(r, 6)::DOUBLE AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM m""")
def gate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: the outbound gate held against the toxic labels, by language."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("lang").alias("cls"), (gates.outbound_action(F.col("text")) != "pass").alias("p"))
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("t")), "doc_id")
    out = gates.confusion(both, "p", "t", "cls")
    return out.select("cls", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH a AS (SELECT lang AS category, {_ACTION} AS action FROM documents),
r AS (SELECT category, avg((action = 'block')::INT) AS b, avg((action = 'rewrite')::INT) AS w, count(*)::BIGINT AS n FROM a GROUP BY 1),
m(category, max_block, max_rewrite) AS (VALUES ('en', 0.0, 0.2), ('fr', 0.0, 0.01), ('de', 0.4, 0.05))
SELECT r.category, round(b, 6)::DOUBLE AS block_rate, round(w, 6)::DOUBLE AS rewrite_rate, n, b <= max_block AND w <= max_rewrite AS ok FROM r JOIN m ON r.category = m.category""")
def category_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and rewrite rates against budgets."""
    acted = spread(table(spark, sf_dir, "documents")).select(F.col("lang").alias("category"), gates.outbound_action(F.col("text")).alias("action"))
    budgets = spark.createDataFrame([("en", 0.0, 0.2), ("fr", 0.0, 0.01), ("de", 0.4, 0.05)], "category string, max_block double, max_rewrite double")
    out = gates.category_budget(acted, F.broadcast(budgets))
    return out.select("category", F.round("block_rate", 6).alias("block_rate"), F.round("rewrite_rate", 6).alias("rewrite_rate"), "n", "ok")


@query("""WITH t AS (SELECT user_id, list(value / 500 ORDER BY ts, event_id) AS totals FROM events GROUP BY 1),
s AS (SELECT user_id, totals[-1] AS last, len(totals) AS n, len(totals) >= 2 AND totals[-1] <= totals[len(totals) - 1] AS damped FROM t)
SELECT user_id, CASE WHEN n < 3 AND damped THEN 'hold' WHEN last > 0.2 THEN 'heal' WHEN n < 3 THEN 'hold' ELSE 'pass' END AS action,
  (CASE WHEN n < 3 AND damped THEN 0.8 WHEN last > 0.2 THEN 0.6 WHEN n < 3 THEN 0.5 ELSE 0.9 END)::DOUBLE AS confidence FROM s""")
def trajectory_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: action from the trajectory of a user's values."""
    e = table(spark, sf_dir, "events")
    t = L.last_values(e.withColumn("v", F.col("value") / 500), "user_id", ["ts", "event_id"], "v", 3)
    out = t.select("user_id", gates.trajectory_action(F.col("values")).alias("x"))
    return out.select("user_id", "x.action", "x.confidence")
