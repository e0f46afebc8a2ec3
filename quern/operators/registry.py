"""What a user adds: plugins of DataFrame functions, stages of a run, engines chosen for what they give, rules learned from data.

Registries live on the driver and only compose plans; no row passes through them. ``rule_index`` holds learned rules against texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]

#: A pattern becomes a rule when it is seen so often.
LEARN_AT = 3

# Rules against a kind of error, as kind: (rule, action, triggers).
PREVENTION = {
    "overconfidence": ("auto_overconfidence", "alert", ("毫无疑问", "毋庸置疑", "唯一", "绝对", "肯定", "一定")),
    "hallucination": ("auto_hallucination", "verify", ("根据研究", "数据表明", "专家指出", "研究表明")),
    "sycophancy": ("auto_sycophancy", "alert", ("您说得对", "很好的问题", "完全同意")),
    "defensiveness": ("auto_defensiveness", "block", ("你可能没理解", "其实我意思是", "但更重要的是")),
    "vagueness": ("auto_vagueness", "alert", ("相关部门", "据了解", "业内人士", "据传")),
    "binary": ("auto_binary", "alert", ("不是", "就是", "要么", "要么", "唯一选择")),
    "omission": ("auto_omission", "alert", ("没有遗漏", "完全覆盖", "全部完成", "所有都")),
}


@dataclass
class Plugins:
    """Named ``init(config) -> Transform`` entries. One that fails is reported and leaves the others alone."""

    settings: Mapping[str, Mapping] = field(default_factory=dict)
    enabled_by_default: bool = True
    entries: dict[str, Callable[[Mapping], Transform]] = field(default_factory=dict)

    def add(self, name: str, init: Callable[[Mapping], Transform]) -> None:
        self.entries[name] = init

    def load(self) -> tuple[dict[str, Transform], dict[str, str]]:
        """(transforms by name, in order of adding; status of every plugin: loaded, disabled or the error)."""
        loaded: dict[str, Transform] = {}
        status: dict[str, str] = {}
        for name, init in self.entries.items():
            own = self.settings.get(name)
            if not (self.enabled_by_default if own is None else own.get("enabled", True) is not False):
                status[name] = "disabled"
                continue
            try:
                made = init((own or {}).get("config", {}))
                if not callable(made):
                    raise TypeError("init gives no function")
            except Exception as e:  # noqa: BLE001  a plugin of someone else may raise anything
                status[name] = f"failed: {e}"
                continue
            loaded[name], status[name] = made, "loaded"
        return loaded, status


@dataclass
class Stages:
    """An ordered list of transforms. Those of depth ``deep`` run only in a deep run."""

    stages: list[tuple[str, Transform, str]] = field(default_factory=list)

    def add(self, name: str, run: Transform, depth: str = "deep") -> Stages:
        self.stages.append((name, run, depth))
        return self

    def run(self, df: DataFrame, depth: str = "deep") -> tuple[DataFrame, dict[str, str]]:
        """(the result, status by stage: done, skipped or the error). A stage that cannot be planned hands its input on."""
        status = {}
        for name, run, own in self.stages:
            if own == "deep" and depth != "deep":
                status[name] = "skipped"
                continue
            try:
                df = run(df)
                status[name] = "done"
            except Exception as e:  # noqa: BLE001  the error is in the status
                status[name] = f"failed: {e}"
        return df, status


@dataclass
class Engines:
    """Functions known by what they give; a goal is covered greedily, by the engine that gives most of what is left."""

    engines: dict[str, tuple[frozenset[str], frozenset[str], Callable]] = field(default_factory=dict)
    most_steps: int = 10

    def add(self, name: str, takes: Iterable[str], gives: Iterable[str], run: Callable) -> None:
        self.engines[name] = (frozenset(takes), frozenset(gives), run)

    def cover(self, wanted: Iterable[str], available: Iterable[str]) -> tuple[list[str], set[str]]:
        """(engines in order, what none of them gives). Of equals the one added first is taken."""
        left, usable, order = set(wanted), set(available), []
        while left and len(order) < self.most_steps:
            rest = [n for n in self.engines if n in usable and n not in order]
            best = max(rest, key=lambda n: len(left & self.engines[n][1]), default=None)
            if best is None or not left & self.engines[best][1]:
                break
            order.append(best)
            left -= self.engines[best][1]
        return order, left

    def run(self, context, wanted: Iterable[str], available: Iterable[str]) -> tuple[dict, dict[str, str]]:
        """(results by output, errors by engine). An engine that fails gives nothing; what it should give counts as open and others are tried."""
        left, usable, outputs, errors = set(wanted), list(available), {}, {}
        for _ in range(self.most_steps):
            order, _open = self.cover(left, [n for n in usable if n not in errors])
            if not left or not order:
                break
            try:
                made = self.engines[order[0]][2](context)
            except Exception as e:  # noqa: BLE001  the error is reported
                errors[order[0]] = str(e)
                continue
            for kind in left & self.engines[order[0]][1]:
                outputs[kind] = made
            left -= self.engines[order[0]][1]
        return outputs, errors


def learned(seen: DataFrame, pattern: str, decision: str, order: str, least: int = LEARN_AT) -> DataFrame:
    """(pattern, decision, learned_at): what was seen ``least`` times, from its ``least``-th sight on.

    Only ranks up to ``least`` are kept, and Spark limits each task's groups before the shuffle,
    so a pattern with a third of all sights does not gather in one task.
    """
    place = F.row_number().over(Window.partitionBy(pattern, decision).orderBy(order))
    known = seen.where(F.col(pattern).isNotNull() & F.col(decision).isNotNull() & (F.col(pattern) != "") & (F.col(decision) != ""))
    return known.withColumn("__place", place).where(F.col("__place") == least).select(F.col(pattern).alias("pattern"), F.col(decision).alias("decision"), F.col(order).alias("learned_at"))


def prevention_rules(errors: DataFrame, category: str, recurrences: str | None = None, least: int = 3) -> DataFrame:
    """(category, rule, action, triggers, n) for the kinds of error seen ``least`` times, or all kinds seen if one error recurred so often."""
    spark = errors.sparkSession
    known = spark.createDataFrame([(k, n, a, list(dict.fromkeys(ts))) for k, (n, a, ts) in PREVENTION.items()], "category string, rule string, action string, triggers array<string>")
    often = F.max(F.col(recurrences) >= least) if recurrences else F.lit(False)
    counted = errors.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"), often.alias("often"))
    kinds = counted.join(F.broadcast(known), "category")
    any_often = counted.agg(F.coalesce(F.max("often"), F.lit(False))).scalar()
    return kinds.where((F.col("n") >= least) | any_often).select("category", "rule", "action", "triggers", "n")
