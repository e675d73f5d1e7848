"""Clause detection by regular expressions that can be explained.

Every rule is one ``rlike`` inside whole-stage code; nothing runs in Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import near, regex
from lexspan.operators.metrics import score_given
from lexspan.schema import CATEGORIES


@dataclass(frozen=True)
class Rule:
    category: str
    name: str
    pattern: str
    rationale: str = ""


def _any(n: int) -> str:
    return rf"[\s\S]{{0,{n}}}?"


# The rules (category, name, pattern, what it looks for). A space stands for any white space.
RULES = (
    Rule("Cap On Liability", "in_no_event_liable", r"\bin no event\b" + _any(120) + r"\bliab(le|ility|ilities)", "opening of a limitation"),
    Rule("Cap On Liability", "excluded_damage_types", r"\b(indirect|incidental|consequential|special|punitive|exemplary)\b" + _any(80) + r"\bdamages\b", "kinds of damages left out"),
    Rule("Cap On Liability", "amount_ceiling", near(r"\bliab(le|ility|ilities)\b", r"\b(shall|will|to) (not|in no event) exceed\b|\bcapped at\b|\blimited to (the|an) (amount|sum|aggregate|total)\b", 150), "liability with a ceiling"),
    Rule("Uncapped Liability", "cap_with_carve_out", near(r"\bin no event\b|\blimitations? (of|on) liability\b|\b(consequential|indirect) damages\b|\b(aggregate|total) liability\b", r"\bexcept (for|with respect to|in the case of|as)\b|\bexcluding\b|\b(shall|will|does|do) not apply\b|\bother than\b|\bnot limit\b|\bnotwithstanding\b", 250), "exception to a cap"),
    Rule("Governing Law", "governed_by_laws", r"\bgovern(ed|s|ing)?\b" + _any(100) + r"\blaws? of\b", "governed by the laws of a place"),
    Rule("Governing Law", "laws_govern", r"\blaws? of\b" + _any(80) + r"\bgovern(ed|s|ing)?\b", "the laws of a place govern"),
    Rule("Governing Law", "construed_under_laws", r"\b(construed|interpreted|enforced)\b" + _any(80) + r"\blaws? of\b", "construed under laws"),
    Rule("Governing Law", "governing_law_heading", r"\bgoverning law\b", "the heading"),
    Rule("Anti-Assignment", "assign_needs_consent", near(r"\bassign(s|ed|ment|able)?\b", r"\bconsent\b", 200), "assignment and consent"),
    Rule("Anti-Assignment", "may_not_assign", r"\b((shall|will|may|must) not|cannot|can not)\b" + _any(40) + r"\b(assign|transfer|delegate)\w*", "a ban on assigning"),
    Rule("Anti-Assignment", "no_party_assigns", r"\b(neither party|no party)\b" + _any(80) + r"\bassign\w*|\b(not|non-?) ?assignable\b", "no party assigns"),
    Rule("Anti-Assignment", "void_assignment", r"\b(purported|attempted) (assignment|transfer)\b" + _any(80) + r"\b(void|null)\b", "void assignments"),
    Rule("Change Of Control", "change_of_control", r"\bchanges? (of|in) (the )?(control|ownership)\b", "the term itself"),
    Rule("Change Of Control", "merger_triggers_right", near(r"\b(merger|merges?|consolidat\w*|acqui(red|sition|res))\b", r"\bterminat\w*", 150), "merger near termination"),
    Rule("Termination For Convenience", "terminate_without_cause", near(r"\b(may|can|right to|entitled to|option to) terminate\b|\bmay be terminated\b", r"\bfor (its )?convenience\b|\bfor any (reason|or no reason)\b|\bwithout cause\b", 120), "a right to end without cause"),
    Rule("Termination For Convenience", "terminate_at_any_time", near(r"\b(may|can|right to) terminate\b", r"\bat any time\b", 80), "a right to end at any time"),
    Rule("Exclusivity", "exclusive", r"(?<!non[-\s\xad‐‑])(?<!non[-\xad‐‑]\s)(?<!and\s)(?<!regulatory\s)\bexclusiv(e|ely|ity)\b(?! (of|property|jurisdiction|remed(y|ies)|venue|forum|owners?(hip)?|own|control|statement|benefit|by|and|to|agreement)\b)", "exclusive rights or dealing"),
    Rule("Exclusivity", "sole_supplier", r"\bsole (and exclusive )?(supplier|distributor|provider|source|reseller|agent|licensee|manufacturer|representative)\b", "a sole supplier or the like"),
    Rule("Non-Compete", "non_compete_term", r"\bnon-?compet\w*|\bnot (to )?compete\b|\bcompete with\b", "the covenant by name"),
    Rule("Non-Compete", "restricted_competition", near(r"\bcompet(e|es|ing|itive|itor|itors)\b", r"\b(shall|will|may) not\b|\bagrees? not\b|\bdirectly or indirectly\b|\brefrain\b", 120), "a ban near competition"),
    Rule("Renewal Term", "automatic_renewal", r"\bautomatic(ally)? (be )?(renew|extend)\w*|\bauto-?renew\w*|\bevergreen\b", "renewal of itself"),
    Rule("Renewal Term", "renewal_period", r"\brenewal (terms?|periods?)\b", "a renewal term"),
    Rule("Renewal Term", "successive_periods", near(r"\b(renew|extend)\w*", r"\b(successive|additional|further) \S+( \S+)? (years?|months?|periods?|terms?)\b", 100), "successive periods"),
    Rule("Audit Rights", "audit", r"\baudit(s|ing|or|ors)?\b", "the word itself"),
    Rule("Audit Rights", "inspect_records", near(r"\b(inspect|examin|review)\w*", r"\b(books|records|facilit(y|ies)|premises|accounts)\b", 100), "inspection of records"),
    Rule("Audit Rights", "access_to_records", r"\baccess to\b" + _any(60) + r"\b(books|records|accounts)\b", "access to records"),
)
# End of fixed values.

#: Letters without which a rule cannot fire: of every group at least one must be in the text, in small letters.
NEEDS = {
    "in_no_event_liable": (("event",), ("liab",)),
    "excluded_damage_types": (("damages",), ("indirect", "incidental", "consequential", "special", "punitive", "exemplary")),
    "amount_ceiling": (("liab",), ("exceed", "capped", "limited")),
    "cap_with_carve_out": (("event", "limitation", "damages", "liability"), ("except", "excluding", "not", "other")),
    "governed_by_laws": (("govern",), ("law",)),
    "laws_govern": (("govern",), ("law",)),
    "construed_under_laws": (("construed", "interpreted", "enforced"), ("law",)),
    "governing_law_heading": (("governing",), ("law",)),
    "assign_needs_consent": (("assign",), ("consent",)),
    "may_not_assign": (("assign", "transfer", "delegate"), ("not",)),
    "no_party_assigns": (("assign",), ("party", "assignable")),
    "void_assignment": (("purported", "attempted"), ("void", "null")),
    "change_of_control": (("change",), ("control", "ownership")),
    "merger_triggers_right": (("terminat",), ("merge", "consolidat", "acqui")),
    "terminate_without_cause": (("terminate",), ("convenience", "reason", "cause")),
    "terminate_at_any_time": (("terminate",), ("time",)),
    "exclusive": (("exclusiv",),),
    "sole_supplier": (("sole",),),
    "non_compete_term": (("compet",),),
    "restricted_competition": (("compet",), ("not", "directly", "refrain")),
    "automatic_renewal": (("auto", "evergreen"),),
    "renewal_period": (("renewal",),),
    "successive_periods": (("renew", "extend"), ("successive", "additional", "further")),
    "audit": (("audit",),),
    "inspect_records": (("inspect", "examin", "review"), ("books", "records", "facilit", "premises", "accounts")),
    "access_to_records": (("access",), ("books", "records", "accounts")),
}


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.category, r.name, r.pattern, r.rationale) for r in rules], "category string, rule string, pattern string, rationale string")


def small_letters(text: Column) -> Column:
    """The text with every letter that a pattern in any case takes for one of a to z as that letter."""
    return F.lower(F.translate(text, "\u017f\u0130\u0131\u212a", "siik"))


def may_fire(low: Column, rule: Rule) -> Column:
    """Whether a text has the letters that a rule needs; ``low`` is its ``small_letters``."""
    groups = NEEDS.get(rule.name, ()) if rule in RULES else ()
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [low.contains(w) for w in group]) for group in groups], F.lit(True))


def fires(text: Column, low: Column, rule: Rule) -> Column:
    """Whether a rule fires. The pattern runs only where the text has the letters it needs."""
    return F.coalesce(may_fire(low, rule) & text.rlike(regex(rule.pattern)), F.lit(False))


def hit_array(text: Column, low: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct (category, rule, hit) per rule."""
    return F.array(*(F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("rule"), fires(text, low, r).alias("hit")) for r in rules))


def _with_low(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("_low", small_letters(F.col(text)))


def rule_hits(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", fired: bool = False) -> DataFrame:
    """row x rule with ``hit``, or with ``fired`` only the rules that fire; the other columns stay, the text goes."""
    kept = [c for c in rows.columns if c != text]
    hits = hit_array(F.col(text), F.col("_low"), rules)
    hits = F.filter(hits, lambda h: h["hit"]) if fired else hits
    return _with_low(rows, text).select(*kept, F.explode(hits).alias("h")).select(*kept, "h.category", "h.rule", "h.hit")


def category_scores(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """row x category with ``n_rules``, how many of its rules fire. Rules of unknown categories are an error.

    Counted within each row by expressions: no shuffle.
    """
    unknown = sorted({r.category for r in rules} - set(categories))
    if unknown:
        raise ValueError(f"rules of unknown categories: {unknown}")
    kept = [c for c in rows.columns if c != text]
    fired = lambda c: reduce(lambda a, b: a + b, [fires(F.col(text), F.col("_low"), r).cast("int") for r in rules if r.category == c], F.lit(0))
    counts = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(i).alias("category_idx"), fired(c).cast("long").alias("n_rules")) for i, c in enumerate(categories)))
    return _with_low(rows, text).select(*kept, F.explode(counts).alias("c")).select(*kept, "c.category", "c.category_idx", "c.n_rules")


def predict(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    return category_scores(rows, rules, text, categories).withColumn("decision", (F.col("n_rules") >= 1).cast("int"))


def explain(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every rule that fires with its first match: start, end (code points) and the words."""
    kept = [c for c in rows.columns if c != text]
    # A pattern runs once a row: what lies before and after the first match tells the rest.
    parts = F.array(*(F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("rule"), F.when(may_fire(F.col("_low"), r), F.split(F.col(text), regex(r.pattern), 2)).alias("p")) for r in rules))
    told = _with_low(rows, text).select(*kept, F.col(text).alias("_text"), F.explode(F.filter(parts, lambda f: F.size(f["p"]) == 2)).alias("f"))
    start, end = F.length(F.col("f.p")[0]), F.length("_text") - F.length(F.col("f.p")[1])
    return told.select(*kept, "f.category", "f.rule", start.cast("long").alias("start"), end.cast("long").alias("end"), F.substring("_text", start + 1, end - start).alias("match"))


def rule_stats(labeled: DataFrame, hits: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per rule: how often it fires on unmasked rows, how often rightly, and the same where it alone fires in its category.

    ``labeled``: long labels by chunk_id and category; ``hits``: ``rule_hits`` by chunk_id. With
    ``every`` (category, rule: the rules to list) they may be those that fire only.
    """
    fired = hits.where("hit").groupBy("chunk_id", "category").agg(F.collect_list("rule").alias("fired"))  # a category's rules
    rows = fired.join(labeled.where("mask").select("chunk_id", "category", "label"), ["chunk_id", "category"])
    rows = rows.select("category", "label", F.size("fired").alias("n"), F.explode("fired").alias("rule"))
    only = F.when(F.col("n") == 1, 1).otherwise(0)
    found = rows.groupBy("category", "rule").agg(F.count("*").alias("fired"), F.sum("label").alias("true_positive"), F.sum(only).alias("only_rule_fired"), F.sum(only * F.col("label")).alias("only_rule_true_positive"))
    positives = labeled.where("mask").groupBy("category").agg(F.sum("label").alias("positives"))
    every = hits.select("category", "rule").distinct() if every is None else every
    every = every.join(positives, "category", "left").join(found, ["category", "rule"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("category", "rule", n("fired"), n("true_positive"), F.when(F.col("fired") > 0, F.col("true_positive") / F.col("fired")).alias("precision"), F.when(F.col("positives") > 0, F.coalesce("true_positive", F.lit(0)) / F.col("positives")).alias("recall"), n("only_rule_fired"), n("only_rule_true_positive"))


def evaluate(labeled: DataFrame, windows: DataFrame, rules: tuple[Rule, ...] = RULES, categories: tuple[str, ...] = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Masked metrics of the rules' decisions and the rules' own figures."""
    texts = windows.select("chunk_id", "text")
    decided = predict(texts, rules, categories=categories).select("chunk_id", "category", "decision", "n_rules")
    joined = labeled.join(decided, ["chunk_id", "category"]).withColumn("score", F.col("n_rules").cast("double"))
    return score_given(joined), rule_stats(labeled, rule_hits(texts, rules))


