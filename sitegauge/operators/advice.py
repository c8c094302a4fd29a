"""Recommendations, recurrence flags, test priorities and benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.numbers import fixed
from sitegauge.functions.skew import top_per_group
from sitegauge.operators.scoring import risk_order

_COUNTED_TYPES = {
    "unvalidated_forms": "Form Without Client-Side Validation",
    "slow": "Slow Page Load",
    "no_title": "Missing Page Title",
    "no_meta": "Missing Meta Description",
    "no_viewport": "Missing Viewport Meta Tag",
    "server_errors": "Server Error",
    "no_canonical": "Missing Canonical Tag",
}


def advice_inputs(totals: DataFrame, issues: DataFrame) -> DataFrame:
    """Site totals plus the de-duplicated issue count of each advised type."""
    counts = issues.groupBy("site").agg(*[
        F.count_if(F.col("issue_type") == kind).alias(name)
        for name, kind in _COUNTED_TYPES.items()])
    return totals.join(counts, "site", "left").na.fill(0, list(_COUNTED_TYPES))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def recommendations(inputs: DataFrame) -> DataFrame:
    """Active recommendations per site; ``seq`` keeps the rule order inside a priority."""
    c = F.col
    seen = c("issues") > 0
    rules = [
        (K.REC_BROKEN, c("broken") > 0, _text("Fix ", c("broken"), " Broken Link(s)")),
        (K.REC_FORMS, c("unvalidated_forms") > 0,
         _text("Add Validation to ", c("unvalidated_forms"), " Form(s)")),
        (K.REC_SLOW, c("slow") > 0,
         _text("Optimise ", c("slow"), " Slow Page(s) — max ", fixed(c("max_load"), 1), "s")),
        (K.REC_ALT, c("missing_alts") > 0,
         _text("Add Alt Text to ", c("missing_alts"), " Image(s) — WCAG 2.1")),
        (K.REC_TITLES, c("no_title") + c("no_meta") > 0,
         _text("Fix ", c("no_title"), " Missing Titles & ", c("no_meta"), " Meta Descriptions")),
        (K.REC_VIEWPORT, c("no_viewport") > 0,
         _text("Add Viewport Meta to ", c("no_viewport"), " Page(s)")),
        (K.REC_SERVER, c("server_errors") > 0,
         _text("Resolve ", c("server_errors"), " Server Error(s) (5xx)")),
        (K.REC_CANONICAL, c("no_canonical") > 3,
         _text("Add Canonical Tags to ", c("no_canonical"), " Pages")),
        (K.REC_HTTPS, F.lit(True), F.lit(K.REC_HTTPS_TITLE)),
        (K.REC_MONITORING, F.lit(True), F.lit(K.REC_MONITORING_TITLE)),
    ]

    def row(seq, values, title):
        priority, category, detail, effort, impact = values
        return F.struct(
            F.lit(priority).alias("priority"), F.lit(seq).alias("seq"),
            F.lit(category).alias("category"), title.alias("title"), F.lit(detail).alias("detail"),
            F.lit(effort).alias("effort"), F.lit(impact).alias("impact"))

    active = [F.when(seen & cond, row(i + 1, values, title))
              for i, (values, cond, title) in enumerate(rules)]
    active.append(F.when(~seen, row(1, K.REC_NONE, F.lit(K.REC_NONE_TITLE))))
    return inputs.select("site", F.inline(F.filter(F.array(*active), lambda r: r.isNotNull())))


def recurrence_flags(inputs: DataFrame) -> DataFrame:
    """Issues that come back unless their cause is removed."""
    names = ["issue_type", "risk", "reason", "frequency"]
    flag = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    seen = F.col("issues") > 0
    flags = F.array(F.when(seen & (F.col("broken") > 0), flag(K.FLAG_BROKEN)),
                    F.when(seen & (F.col("slow") > 0), flag(K.FLAG_SLOW)))
    return inputs.select("site", F.inline(F.filter(flags, lambda f: f.isNotNull())))


def module_focus(module: Column) -> Column:
    """What to test in a module."""
    name = F.lower(module)
    holds = lambda key: F.contains(name, F.lit(key.lower()))
    (first, focus), *rest = K.MODULE_FOCUS
    ladder = reduce(lambda acc, kv: acc.when(holds(kv[0]), F.lit(kv[1])), rest,
                    F.when(holds(first), F.lit(focus)))
    return ladder.otherwise(F.lit(K.DEFAULT_FOCUS))


def priority_tests(risk: DataFrame, n: int = 5) -> DataFrame:
    """The riskiest modules of every site with their test focus."""
    return top_per_group(risk, ["site"], risk_order(), n).select(
        "site", "rank", "module", "risk_score", "risk_level", "open_issues",
        module_focus(F.col("module")).alias("test_focus"))


def benchmarks(inputs: DataFrame) -> DataFrame:
    """Five measured values per site against published standards."""
    c = F.col
    of = lambda part, whole: _text(part, "/", whole)
    load = (F.when(c("avg_load") < 2, K.GOOD).when(c("avg_load") < 4, K.NEEDS_WORK)
            .otherwise(K.POOR))
    complete = lambda part, otherwise: F.when(c(part) == c("pages"), K.GOOD).otherwise(otherwise)
    rows = [
        ("Average Load Time", F.coalesce(_text(fixed(c("avg_load"), 2), "s"), F.lit("n/a")),
         "< 2.0s", load),
        ("Broken Link Rate", of(c("broken"), c("pages")), "0",
         F.when(c("broken") == 0, K.GOOD).otherwise(K.POOR)),
        ("Pages With Meta Description", of(c("with_meta"), c("pages")), "100%",
         complete("with_meta", K.NEEDS_WORK)),
        ("Images With Alt Text", of(c("images") - c("missing_alts"), c("images")), "100%",
         F.when(c("missing_alts") == 0, K.GOOD).otherwise(K.NEEDS_WORK)),
        ("Pages With Viewport Meta", of(c("with_viewport"), c("pages")), "100%",
         complete("with_viewport", K.POOR)),
    ]
    return inputs.where(c("issues") > 0).select("site", F.inline(F.array(*[
        F.struct(F.lit(metric).alias("metric"), value.alias("this_site"),
                 F.lit(standard).alias("industry_standard"), result.alias("result"))
        for metric, value, standard, result in rows])))
