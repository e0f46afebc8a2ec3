"""Outbound gate, output screen, verdict fold, and the metrics that judge a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.regex import count_matches, has_cjk, java, sql_text
from quern.operators.rules import Expr, Match, any_literal

# Personal-data rules as (rule, pattern, either case, mask). Masks are applied in this order.
PII_RULES = (
    ("id_card", r"\b[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b", False, "***身份证***"),
    ("phone", r"\b(?:\+?86)?1[3-9]\d{9}\b", False, "***手机***"),
    ("bank_card", r"\b[1-9]\d{14,18}\b", False, "***银行卡***"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", False, "***邮箱***"),
    ("api_key", r"\b(?:sk|pk|api[_-]?key)[_-][a-zA-Z0-9]{20,}\b", True, "***KEY***"),
    ("password", r"(?:password|passwd|pwd)\s*[:=]\s*['\"]?([a-zA-Z0-9!@#$%^&*]{6,})['\"]?", True, "***PASS***"),
    ("contract", r"(?:合同编号|签约日期|甲方|乙方|金额|价款|违约金|保密条款|竞业限制)", False, None),
    ("credit_card", r"\b[4-6]\d{15}\b", False, None),
    ("passport", r"\b[PEG]\d{8}\b", False, None),
)

# Classification levels by keyword, most secret first; without any keyword a text is internal (1).
LEVELS = (
    (4, ("绝密", "top secret", "secret")),
    (3, ("机密", "confidential")),
    (2, ("敏感", "sensitive")),
    (1, ("内部", "internal", "仅限内部")),
    (0, ("公开", "public")),
)

# Overconfident and pseudo-knowing phrases with severities.
OVERCONFIDENCE_EN = (
    (r"\b(undoubtedly|without (a )?doubt|beyond (any )?doubt)\b", True, 80),
    (r"\b(there is no question that|it is unquestionable)\b", True, 80),
    (r"\b(the (only|one and only) (way|reason|cause|explanation))\b", True, 70),
    (r"\b(always|never)\s+(works|happens|is|will)\b", True, 70),
)
OVERCONFIDENCE_ZH = (
    (r"毫无疑问[，。！]?", False, 80),
    (r"毋庸置疑[，。！]?", False, 80),
    (r"[这那]是[^，。]{0,10}(唯一|绝对|肯定)[^，。]{0,10}的", False, 70),
    (r"[始终永远]都[^，。]{0,20}不会错", False, 80),
    (r"我可以[^，。]{0,15}(肯定|确定|保证)", False, 60),
    (r"原因[^，。]{0,10}就是[^，。]{0,20}(因为|由于)", False, 50),
    (r"必然[^，。]{0,15}(导致|造成|引发)", False, 70),
    (r"具体[^，。]{0,5}(包括|如下|有)[^，。]{0,30}[，。]", False, 40),
    (r"从[^，。]{0,8}(?:壳|壳子|空壳|占位|stub|假)[^，。]{0,12}(?:变|变成|变真|成为)[^，。]{0,8}(?:真|真实|完整|正式)", False, 80),
    (r"(?:架构级|体系级|系统性|根本性|里程碑|重大突破|彻底解决|完美解决)(?:修复|重构|升级|改造|优化)?", False, 70),
    (r"堵住[^，。]{0,10}(?:种|个|类|条)?[^，。]{0,6}(?:变形|绕过|攻击|漏洞|缺口)", False, 70),
    (r"全部?[^，。]{0,8}(?:覆盖|修复|解决|完成|闭环)(?:了|，|。|$)", False, 50),
)
MASQUERADE_EN = (
    (r"\bit is (widely|generally|universally) (known|accepted|recognized)\b", False, 50),
    (r"\b(as everyone knows|needless to say|it goes without saying)\b", False, 50),
    (r"\b(the (real|underlying|fundamental) (truth|reason|cause|nature))\b", False, 40),
)
MASQUERADE_ZH = (
    (r"从本质上[^，。]{0,20}来说", False, 40),
    (r"众所周知[，。]", False, 50),
    (r"不言而喻[，。]", False, 50),
    (r"这[^，。]{0,10}就[^，。]{0,15}(因为|由于)[^，。]*?所以", False, 50),
    (r"这[^，。]{0,10}(很|非常|极其|十分)简单[，。]", False, 40),
    (r"简单[^，。]{0,5}(来说|讲|地说|的答案|的道理)[，。]", False, 30),
)
HEDGES_EN = (r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bpossibly\b", r"\bprobably\b", r"\bgenerally\b", r"\btypically\b", r"\bin general\b", r"\bto my knowledge\b", r"\bbased on\b")
HEDGES_ZH = ("可能", "也许", "或许", "不一定", "通常", "一般[来]?说", "从某种[意角]度", "据我所知", "我所了解的", "以我目前的", "基于现有")
CLAIMS_EN = (r"\bis\s+\w+\s+\w+", r"\bwill\b", r"\bdetermines\b", r"\bis what\b")
CLAIMS_ZH = ("是[^，。]{3,20}的[，。]", "会[^，。]{3,20}[，。]", "决定[^，。]{3,20}[，。]", "就是[^，。]{3,20}")

# Signals of the verdict fold by level.
BLOCK_SIGNALS = ("blocked_by_firewall", "high_risk_output")
REWRITE_SIGNALS = ("self_contradictory", "restrained_by", "input_check_issues")
VERIFY_SIGNALS = ("verification", "output_checklist_issues", "input_check", "epistemic_safety", "drift_corrected", "self_verification_issues", "reflection_health")
BAD_HEALTH = ("degraded", "stuck", "oscillating")


def pii_counts(text: Column) -> dict[str, Column]:
    """Occurrences by rule. Keys and passwords count in either case, and each rule counts its own places."""
    return {name: count_matches(text, pattern, ic).cast("long") for name, pattern, ic, _ in PII_RULES}


def pii_any(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern, ic, _ in PII_RULES:
        out = out | Match(pattern, ic).column(text)
    return out


def mask_pii(text: Column) -> Column:
    """All places of the maskable rules are replaced, rule after rule."""
    for _, pattern, ic, mask in PII_RULES:
        if mask:
            text = F.regexp_replace(text, ("(?i)" if ic else "") + java(pattern), mask)
    return text


def level(text: Column) -> Column:
    out = F.lit(1)
    for number, words in reversed(LEVELS):
        out = F.when(any_literal(*words, lower=True).column(text), number).otherwise(out)
    return out


def outbound_action(text: Column) -> Column:
    """block, rewrite or pass of a text that is about to leave."""
    grade = level(text)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "pass")
        .when(grade >= 3, "block")
        .when((grade >= 2) & pii_any(text), "block")
        .when(pii_any(text), "rewrite")
        .otherwise("pass")
    )


def _phrase_findings(text: Column) -> Column:
    """Severities of the phrases that occur, chosen by language."""
    def rows(rules: tuple) -> Column:
        return F.array(*[F.when(Match(p, ic).column(text), severity) for p, ic, severity in rules])

    return F.array_compact(F.when(has_cjk(text), rows(OVERCONFIDENCE_ZH + MASQUERADE_ZH)).otherwise(rows(OVERCONFIDENCE_EN + MASQUERADE_EN)))


def claim_count(text: Column) -> Column:
    """Claims: all matches of each English pattern; a Chinese pattern counts once, with its groups."""
    en = sum((count_matches(text, p) for p in CLAIMS_EN), F.lit(0))
    zh = sum((F.when(text.rlike(p), 1).otherwise(0) for p in CLAIMS_ZH), F.lit(0))
    return F.when(has_cjk(text), zh).otherwise(en)


def has_hedge(text: Column) -> Column:
    zh, en = F.lit(False), F.lit(False)
    for p in HEDGES_ZH:
        zh = zh | text.rlike(p)
    for p in HEDGES_EN:
        en = en | text.rlike(java(p))
    return F.when(has_cjk(text), zh).otherwise(en)


def uncertainty_gap(text: Column, claims: Column | None = None, hedged: Column | None = None) -> Column:
    """0 to 0.5: more than two claims and no hedge. ``claims`` and ``hedged``: columns that have them already."""
    n = claim_count(text) if claims is None else claims
    gap = F.least(F.lit(0.5), (n - 2) * F.lit(0.1))
    return F.when((F.coalesce(F.length(text), F.lit(0)) >= 20) & (n > 2) & ~(has_hedge(text) if hedged is None else hedged), gap).otherwise(F.lit(0.0))


def _gap_once(text: Column) -> Column:
    """``uncertainty_gap`` where nothing else counts the claims: they are counted once, as a lambda's argument."""
    gap = lambda n: F.when((n > 2) & ~has_hedge(text), F.least(F.lit(0.5), (n - 2) * F.lit(0.1))).otherwise(F.lit(0.0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) >= 20, F.get(F.transform(F.array(claim_count(text)), gap), 0)).otherwise(F.lit(0.0))


def contradictions(text: Column) -> Column:
    """Severities of contradictions within a Chinese text: 30 for each concession frame (but in the last sentence), 70 for affirmation and denial together."""
    parts = F.filter(F.split(text, r"[。！？\n.!?]+"), lambda s: F.length(F.trim(s)) > 10)
    frames = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.rlike(r"(虽然|尽管)[^，。]{5,30}(但是|但|然而|不过)"))
    yes = F.exists(parts, lambda s: s.rlike(r"一定[会能是]|肯定会|必然是|绝对是"))
    no = F.exists(parts, lambda s: s.rlike(r"不一定|未必|不一定能|不可能|不是必然"))
    found = F.concat(F.transform(frames, lambda s: F.lit(30)), F.when(yes & no, F.array(F.lit(70))).otherwise(F.expr("cast(array() as array<int>)")))
    usable = (F.length(text) >= 50) & has_cjk(text) & (F.size(parts) >= 2)
    return F.when(usable, found).otherwise(F.expr("cast(array() as array<int>)"))


def output_severities(text: Column) -> Column:
    """Severities (0 to 100) of all findings of the output screen, most severe first."""
    gap = F.floor(_gap_once(text) * 100 + 0.5).cast("int")
    found = F.concat(_phrase_findings(text), contradictions(text), F.filter(F.array(gap), lambda g: g > 0))
    return F.sort_array(F.when(F.coalesce(text, F.lit("")) == "", F.expr("cast(array() as array<int>)")).otherwise(found), asc=False)


def output_action(severities: Column) -> Column:
    return F.when(F.exists(severities, lambda s: s >= 70), "rewrite").when(F.size(severities) > 0, "hedge").otherwise("pass")


# -- verdict fold -------------------------------------------------------------------


def triggered_array(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def triggered_number(value: Column) -> Column:
    return F.coalesce(value != 0, F.lit(False))


def triggered_score(score: Column, issues: Column, threshold: float = 0.5) -> Column:
    """A score below the threshold, or any issue."""
    return F.coalesce(score < threshold, F.lit(False)) | F.coalesce(F.size(issues) > 0, F.lit(False))


def triggered_health(health: Column) -> Column:
    return F.coalesce(health.isin(*BAD_HEALTH), F.lit(False))


def verdict(flags: dict[str, Column], verify_score: Column) -> Column:
    """Folds boolean signals into (action, score, signals). ``verify_score``: the score of the verification, null without one."""
    pick = lambda names: F.array_compact(F.array(*[F.when(flags[n], F.lit(n)) for n in names if n in flags] or [F.lit(None).cast("string")]))
    block, rewrite, verify = pick(BLOCK_SIGNALS), pick(REWRITE_SIGNALS), pick(VERIFY_SIGNALS)
    low = F.when(flags.get("verification", F.lit(False)), F.coalesce(verify_score, F.lit(1.0))).otherwise(F.lit(1.0))
    action = F.when(F.size(block) > 0, "block").when(F.size(rewrite) > 0, "rewrite").when(F.size(verify) > 0, "verify").otherwise("pass")
    score = (
        F.when(F.size(block) > 0, F.lit(0.0))
        .when(F.size(rewrite) > 0, F.lit(0.3))
        .when(F.size(verify) > 0, F.when(low < 1, low).otherwise(F.lit(0.5)))
        .otherwise(F.lit(1.0))
    )
    signals = F.when(F.size(block) > 0, block).when(F.size(rewrite) > 0, rewrite).otherwise(verify)
    return F.struct(action.alias("action"), score.alias("score"), signals.alias("signals"))


def allowed(action: Column) -> Column:
    return action.isNull() | action.isin("pass", "verify")


def trajectory_action(totals: Column) -> Column:
    """Action and confidence from a trajectory of drift totals: early and damped hold, high heal, early hold, else pass."""
    last, n = F.element_at(totals, -1), F.size(totals)
    damped = (n >= 2) & (last <= F.element_at(totals, F.greatest(F.lit(1), n - 1)))
    early = n < 3
    return F.struct(
        F.when(early & damped, "hold").when(last > 0.2, "heal").when(early, "hold").otherwise("pass").alias("action"),
        F.when(early & damped, 0.8).when(last > 0.2, 0.6).when(early, 0.5).otherwise(0.9).alias("confidence"),
    )


def confusion(scored: DataFrame, predicted: str, actual: str, by: str) -> DataFrame:
    """True and false positives and negatives by class, with precision, recall and F1 (0 where undefined)."""
    p, a = F.col(predicted), F.col(actual)
    n = lambda c: F.count(F.when(c, 1))
    out = scored.groupBy(by).agg(n(p & a).alias("tp"), n(~p & ~a).alias("tn"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    out = out.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def category_budget(acted: DataFrame, budgets: DataFrame, category: str = "category") -> DataFrame:
    """Block and rewrite rates by category held against (category, max_block, max_rewrite); the budgets are a handful of rows."""
    rate = lambda a: F.avg(F.when(F.col("action") == a, 1.0).otherwise(0.0))
    rates = acted.groupBy(category).agg(rate("block").alias("block_rate"), rate("rewrite").alias("rewrite_rate"), F.count(F.lit(1)).alias("n"))
    return rates.join(budgets, category).withColumn("ok", (F.col("block_rate") <= F.col("max_block")) & (F.col("rewrite_rate") <= F.col("max_rewrite")))


# -- the same rules as SQL text -----------------------------------------------------


def sql_count(text: str, pattern: str, ic: bool) -> str:
    return f"len(regexp_extract_all({text}, {sql_text(('(?i)' if ic else '') + pattern)}))"


def sql_level(text: str) -> str:
    cases = " ".join(f"WHEN {any_literal(*words, lower=True).sql(text)} THEN {n}" for n, words in LEVELS)
    return f"CASE {cases} ELSE 1 END"


def sql_pii_any(text: str) -> str:
    return "(" + " OR ".join(Match(p, ic).sql(text) for _, p, ic, _ in PII_RULES) + ")"


def rule_expr(rules: tuple) -> list[tuple[Expr, int]]:
    return [(Match(p, ic), severity) for p, ic, severity in rules]
