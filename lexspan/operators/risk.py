"""Clause risk: base points by category, the highest red flag found, levels, review routing and triage.

The clause scorer, the review boundary, the missing-cap check and the triage sum follow a
written rubric; the triage total (highest clause score plus the missing-cap points) is
this library's own choice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import first_match, near, regex


@dataclass(frozen=True)
class Adjustment:
    name: str
    points: int
    categories: tuple[str, ...]
    pattern: str


# Base points, level bounds, red flags, missing-cap points and review margin.
BASE = {
    "Cap On Liability": 1,
    "Uncapped Liability": 4,
    "Governing Law": 0,
    "Anti-Assignment": 2,
    "Change Of Control": 2,
    "Termination For Convenience": 2,
    "Exclusivity": 2,
    "Non-Compete": 2,
    "Renewal Term": 1,
    "Audit Rights": 1,
}
LEVELS = ((4, "High"), (2, "Medium"), (0, "Low"))
_MAY_END = r"(may|can|shall have the right to|is entitled to|reserves the right to) terminat(e|ion|ing)"
ADJUSTMENTS = (
    Adjustment("liability_carve_out", 2, ("Cap On Liability", "Uncapped Liability"), r"unlimited liability|liability[\s\S]{0,40}?unlimited|nothing[\s\S]{0,120}?(shall|will) (limit|exclude|restrict)|shall not apply to[\s\S]{0,80}?(fraud|gross negligence|willful|indemnif)"),
    Adjustment("immediate_termination", 2, ("Termination For Convenience",), near(_MAY_END, r"immediately|immediate effect|without (prior |any )?notice", 80)),
    Adjustment("renewal_no_opt_out", 2, ("Renewal Term",), near(r"automatic(ally)? renew", r"(may not|shall not|cannot|can not) (be )?(cancel|terminat|opt)", 150)),
    Adjustment("sole_discretion", 1, ("Anti-Assignment", "Change Of Control", "Termination For Convenience"), r"sole (and absolute )?discretion"),
    Adjustment("active_termination_right", 1, ("Termination For Convenience",), _MAY_END + r"[\s\S]{0,100}?(without cause|for (its |their )?convenience|for any reason|at any time)"),
    Adjustment("audit_without_notice", 1, ("Audit Rights",), r"without (prior |advance |any )?notice"),
)
MISSING_CAP = 0.5
REVIEW_MARGIN = "0.10"
# End of fixed values.


def level(points: Column) -> Column:
    return reduce(lambda acc, x: acc.when(points >= x[0], F.lit(x[1])), LEVELS, F.when(points.isNull(), F.lit(None).cast("string"))).otherwise(F.lit("Low"))


def base_points(category: Column) -> Column:
    return reduce(lambda acc, x: acc.when(category == x[0], F.lit(x[1])), BASE.items(), F.when(F.lit(False), F.lit(0)))


def adjustments(clauses: DataFrame, text: str = "text") -> DataFrame:
    """clause x red flag: those that apply to the clause's category, whether they match, and the words found."""
    kept = [c for c in clauses.columns if c != text]
    found = []
    for a in ADJUSTMENTS:
        hit = F.coalesce(F.col(text).rlike(regex(a.pattern)), F.lit(False))
        _, words = first_match(F.col(text), regex(a.pattern))
        told = F.struct(F.lit(a.name).alias("adjustment"), F.lit(a.points).alias("points"), hit.alias("matched"), words.alias("words"))
        found.append(F.when(F.col("category").isin(*a.categories), told))  # other categories' patterns do not run
    return clauses.select(*kept, F.explode(F.array_compact(F.array(*found))).alias("a")).select(*kept, "a.*")


def score_clauses(clauses: DataFrame, text: str = "text") -> DataFrame:
    """Adds base, adjustment (the highest flag, the first of equals), points, score, level, rationale, needs_review.

    An unknown category or empty evidence has no score and goes to review. ``needs_context``,
    if the clauses have it, sends a clause to review too.
    """
    candidates = []
    for place, a in enumerate(ADJUSTMENTS):
        hit = F.col("category").isin(*a.categories) & F.coalesce(F.col(text).rlike(regex(a.pattern)), F.lit(False))
        _, words = first_match(F.col(text), regex(a.pattern), hit=F.lit(True))
        candidates.append(F.when(hit, F.struct(F.lit(a.points).alias("points"), F.lit(-place).alias("place"), F.lit(a.name).alias("adjustment"), words.alias("words"))))
    best = F.array_max(F.array_compact(F.array(*candidates)))
    valid = base_points(F.col("category")).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    rows = clauses.withColumn("_best", best).withColumn("base", F.when(valid, base_points(F.col("category"))))
    rows = rows.withColumn("points", F.when(valid, F.coalesce("_best.points", F.lit(0)))).withColumn("adjustment", F.when(valid, F.col("_best.adjustment")))
    rows = rows.withColumn("score", F.col("base") + F.col("points")).withColumn("level", level(F.col("base") + F.col("points")))
    context = F.coalesce(F.col("needs_context"), F.lit(False)) if "needs_context" in clauses.columns else F.lit(False)
    reason = F.concat_ws("; ", F.when(F.col("score").isNull(), "no score: unknown category or no evidence"), F.when(F.col("level") == "High", "high risk"), F.when(context, "context needed"))
    rationale = F.concat_ws("; ", F.when(valid, F.concat(F.col("category"), F.lit(" "), F.col("base").cast("string"))), F.when(F.col("points") > 0, F.concat(F.col("adjustment"), F.lit(" +"), F.col("points").cast("string"), F.lit(" ("), F.col("_best.words"), F.lit(")"))))
    return rows.withColumn("rationale", rationale).withColumn("review_reasons", reason).withColumn("needs_review", reason != "").drop("_best")


def route_review(scored: DataFrame) -> DataFrame:
    """Adds ``to_review``: high, unscored or context-lacking clauses, and model scores below the review boundary.

    ``confidence`` and ``threshold`` are compared as exported decimals (six places); a
    score on the boundary clears. Invalid or missing values go to review. Clauses of source
    ``annotation`` skip the check.
    """
    exact = lambda c: F.col(c).cast("decimal(10,6)")
    one = F.lit("1").cast("decimal(10,6)")
    bound = exact("threshold") + F.lit(REVIEW_MARGIN).cast("decimal(4,2)") * (one - exact("threshold"))
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.col(c) >= 0) & (F.col(c) <= 1)
    unsure = (F.col("source") != "annotation") & ~(F.coalesce(ok("confidence") & ok("threshold"), F.lit(False)) & F.coalesce(exact("confidence") >= bound, F.lit(False)))
    return scored.withColumn("to_review", F.col("needs_review") | unsure)


def missing_cap(contracts: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per contract: 0.5 points if a cap is expected, the whole contract was read, and there is no cap and no open candidate.

    ``contracts``: contract, expects_cap, processed; ``clauses``: contract, category, unresolved.
    """
    caps = clauses.where(F.col("category") == "Cap On Liability").groupBy("contract").agg(F.max((~F.col("unresolved")).cast("int")).alias("found"), F.max(F.col("unresolved").cast("int")).alias("open"))
    rows = contracts.join(caps, "contract", "left").fillna(0, ["found", "open"])
    expected = F.coalesce("expects_cap", F.lit(False))
    missing = expected & F.col("processed") & (F.col("found") == 0) & (F.col("open") == 0)
    return rows.select("contract", F.when(missing, F.lit(MISSING_CAP)).otherwise(F.lit(0.0)).alias("missing_points"), (expected & (F.col("found") == 0) & (~F.col("processed") | (F.col("open") == 1))).alias("check_review"), F.when(missing, "Expected liability cap not found. Check the full contract.").alias("message"))


def triage(scored: DataFrame, missing: DataFrame) -> DataFrame:
    """Per contract: the highest clause score plus the missing-cap points, and its figures by level."""
    clauses = scored.groupBy("contract").agg(F.max("score").alias("top"), F.sum((F.col("level") == "High").cast("long")).alias("n_high"), F.count("*").alias("n_clauses"))
    rows = missing.join(clauses, "contract", "left")
    return rows.select("contract", (F.coalesce("top", F.lit(0)) + F.col("missing_points")).alias("triage_score"), F.coalesce("n_high", F.lit(0)).alias("n_high"), F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"))


def validation(rows: DataFrame, k: int = 10) -> DataFrame:
    """metric, value: Spearman correlation, level agreement, recall of expert-high contracts, precision at k.

    ``rows``: contract, score, expert_score. Ranks of equal values are averaged; they come
    from counts per distinct value, not from a sort of all rows in one place.
    """
    def ranked(column: str) -> DataFrame:
        counts = rows.groupBy(column).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per distinct score
        return counts.select(column, (below * 2 + F.col("n") + 1).alias(f"rank_{column}"))

    r = rows.join(ranked("score"), "score").join(ranked("expert_score"), "expert_score")
    x, y = F.col("rank_score").cast("decimal(38,0)"), F.col("rank_expert_score").cast("decimal(38,0)")
    sums = r.agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum((x * y).cast("decimal(38,0)")).alias("xy"), F.sum((x * x).cast("decimal(38,0)")).alias("xx"), F.sum((y * y).cast("decimal(38,0)")).alias("yy"))
    d = lambda c: F.col(c).cast("double")
    spearman = sums.select(F.lit("spearman").alias("metric"), ((d("n") * d("xy") - d("x") * d("y")) / F.sqrt((d("n") * d("xx") - d("x") * d("x")) * (d("n") * d("yy") - d("y") * d("y")))).alias("value"))
    same = rows.agg((F.sum((level(F.col("score")) == level(F.col("expert_score"))).cast("long")) / F.count("*")).alias("value")).select(F.lit("bucket_agreement").alias("metric"), "value")
    high = rows.agg((F.sum(((F.col("score") >= 4) & (F.col("expert_score") >= 4)).cast("long")) / F.sum((F.col("expert_score") >= 4).cast("long"))).alias("value")).select(F.lit("high_risk_recall").alias("metric"), "value")
    top = rows.orderBy(F.desc("score"), "contract").limit(k).agg((F.sum((F.col("expert_score") >= 4).cast("long")) / F.count("*")).alias("value")).select(F.lit("precision_at_k").alias("metric"), "value")
    return spearman.unionByName(same).unionByName(high).unionByName(top)
