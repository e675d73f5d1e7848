"""Small inline inputs for operators that the driver's tables have nothing for, and what they must give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.schema import CATEGORY_DESCRIPTIONS, RAW_JSON

_LEASE = "Lease. The law of Utah governs. Rent may be audited."
_ASK = lambda i, *answers: {"id": i, "question": "", "is_impossible": not answers, "answers": [{"text": t, "answer_start": s} for t, s in answers]}
_RAW = {
    "version": "t",
    "data": [
        {"title": " Lease ", "paragraphs": [{"context": _LEASE, "qas": [_ASK("Lease__Governing Law", ("The law of Utah governs.", 7)), _ASK("Lease__Audit Rights_0", ("audited", 44)), _ASK("Lease__Exclusivity")]}]},
        {"title": "Lease", "paragraphs": [{"context": "another context", "qas": [_ASK("Lease__Governing Law", ("other", 0)), _ASK("Lease__Renewal Term_12", ("Rent", 32))]}]},
        {"title": "Licence", "paragraphs": [{"context": "No party assigns.", "qas": [_ASK("Licence__Anti-Assignment", ("No party assigns.", 0), ("No party assigns.", 0))]}]},
    ],
}
JSON_SPANS = [
    ("Lease", "Governing Law", 7, 31, "The law of Utah governs."),
    ("Lease", "Audit Rights", 44, 51, "audited"),
    ("Lease", "Renewal Term", 32, 36, "Rent"),
    ("Licence", "Anti-Assignment", 0, 17, "No party assigns."),
]


def raw_json(spark: SparkSession) -> DataFrame:
    text = spark.createDataFrame([(json.dumps(_RAW),)], "j string")
    return text.select(F.from_json("j", RAW_JSON).alias("r")).select("r.*")


_DESCRIPTIONS = [("Category: Non-Compete", "Description: Is there a ban?", "Answer Format: Yes/No", "Group: 2"), ("Category: cap on liability", "Description: A cap ", "Answer Format: Yes/No", "Group: -"), ("Category: Parties", "Description: Who signed", "Answer Format: Names", "Group: 1")]
DESCRIBED = [
    ("Non-Compete", "Non-Compete", "Is there a ban?", "Yes/No", "Non-Compete"),
    ("Cap On Liability", "cap on liability", "A cap", "Yes/No", "Cap On Liability"),
    ("Parties", "Parties", "Who signed", "Names", None),
]


def raw_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_DESCRIPTIONS, CATEGORY_DESCRIPTIONS)


PARAGRAPHS = [("p", 0, 11, "first one\n\n"), ("p", 11, 27, "second\nstill\n \n\n"), ("p", 27, 33, " third")]


def paragraph_text(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p", "first one\n\nsecond\nstill\n \n\n third"), ("blank", " \n\n ")], "contract string, text string")


CLAUSES = [
    (1, "This lease is governed by the laws of Utah."),
    (2, "Tenant shall not assign this lease without consent."),
    (3, "In no event shall the landlord be liable for indirect damages."),
    (4, "The licence is non-exclusive."),
    (5, "The dealer holds exclusive rights to the region."),
    (6, "The term will automatically renew for successive one-year terms."),
    (7, "Either side may terminate for convenience at any time."),
    (8, "Upon a change of control the lender may act."),
    (9, "The buyer may audit and inspect the books."),
    (10, "The seller agrees not to compete with the buyer."),
    (11, "Rain is expected on Sunday."),
    (12, "Nothing here applies, and no one is the exclusive property of anyone."),
]
HITS = [
    (1, "Governing Law", "governed_by_laws"),
    (2, "Anti-Assignment", "assign_needs_consent"),
    (2, "Anti-Assignment", "may_not_assign"),
    (3, "Cap On Liability", "in_no_event_liable"),
    (3, "Cap On Liability", "excluded_damage_types"),
    (5, "Exclusivity", "exclusive"),
    (6, "Renewal Term", "automatic_renewal"),
    (6, "Renewal Term", "successive_periods"),
    (7, "Termination For Convenience", "terminate_without_cause"),
    (7, "Termination For Convenience", "terminate_at_any_time"),
    (8, "Change Of Control", "change_of_control"),
    (9, "Audit Rights", "audit"),
    (9, "Audit Rights", "inspect_records"),
    (10, "Non-Compete", "non_compete_term"),
    (10, "Non-Compete", "restricted_competition"),
]
EXPLAINED = [
    (1, "Governing Law", "governed_by_laws", 14, 37, "governed by the laws of"),
    (2, "Anti-Assignment", "assign_needs_consent", 17, 50, "assign this lease without consent"),
    (2, "Anti-Assignment", "may_not_assign", 7, 23, "shall not assign"),
    (9, "Audit Rights", "audit", 14, 19, "audit"),
    (9, "Audit Rights", "inspect_records", 24, 41, "inspect the books"),
]


def clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLAUSES, "id int, text string")


RISK = [
    (1, "Termination For Convenience", "Owner may terminate without cause on 60 days' written notice."),
    (2, "Termination For Convenience", "Owner may terminate for convenience immediately and without notice."),
    (3, "Uncapped Liability", "The limit shall not apply to claims of fraud."),
    (4, "Governing Law", "The laws of Utah govern."),
    (5, "Audit Rights", "Buyer may audit without prior notice."),
    (6, "Renewal Term", "It will automatically renew and the client may not cancel."),
    (7, "Change Of Control", "Consent is at its sole and absolute discretion."),
    (8, "Parties", "Owner and client."),
    (9, "Exclusivity", "  "),
]
RISK_FLAGS = [
    (1, "Termination For Convenience", "active_termination_right", 1),
    (2, "Termination For Convenience", "immediate_termination", 2),
    (2, "Termination For Convenience", "active_termination_right", 1),
    (3, "Uncapped Liability", "liability_carve_out", 2),
    (5, "Audit Rights", "audit_without_notice", 1),
    (6, "Renewal Term", "renewal_no_opt_out", 2),
    (7, "Change Of Control", "sole_discretion", 1),
]
RISK_SCORES = [
    (1, 2, 1, 3, "Medium", False),
    (2, 2, 2, 4, "High", True),
    (3, 4, 2, 6, "High", True),
    (4, 0, 0, 0, "Low", False),
    (5, 1, 1, 2, "Medium", False),
    (6, 1, 2, 3, "Medium", False),
    (7, 2, 1, 3, "Medium", False),
    (8, None, None, None, None, True),
    (9, None, None, None, None, True),
]


def risk_clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RISK, "id int, category string, text string")


_ROUTED = [(1, "model", 0.82, 0.80), (2, "model", 0.8199, 0.80), (3, "annotation", None, None), (4, "model", None, 0.5), (5, "model", float("nan"), 0.5), (6, "model", 0.9, 0.5), (7, "model", 0.9, 1.2)]
RISK_ROUTED = [(1, False), (2, True), (3, False), (4, True), (5, True), (6, False), (7, True)]


def routed_clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, "Governing Law", "The laws of Utah govern.", s, c, t) for i, s, c, t in _ROUTED], "id int, category string, text string, source string, confidence double, threshold double")


def arm_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    summary = spark.createDataFrame([("bce", 0.5, 0.4), ("pos_weight", 0.70, 0.55), ("focal", 0.69, 0.62), ("downsample", 0.60, 0.50)], "arm string, macro_f1 double, weak_f1 double")
    pairs = []
    for a, b, macro, weak in (("bce", "pos_weight", (-0.3, -0.1), (-0.2, -0.1)), ("bce", "focal", (-0.3, -0.1), (-0.3, -0.1)), ("bce", "downsample", (-0.2, -0.05), (-0.2, 0.0)), ("downsample", "focal", (-0.1, -0.05), (-0.2, -0.05)), ("downsample", "pos_weight", (-0.2, -0.05), (-0.1, 0.0)), ("focal", "pos_weight", (-0.03, 0.02), (0.02, 0.1))):
        pairs += [(a, b, "macro_f1", (macro[0] + macro[1]) / 2, *macro), (a, b, "weak_f1", (weak[0] + weak[1]) / 2, *weak)]
    return summary, spark.createDataFrame(pairs, "arm_a string, arm_b string, metric string, difference double, ci_low double, ci_high double")


def config_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    names = ("lr2e-05-ep1", "lr2e-05-ep2", "lr2e-05-ep3")
    summary = spark.createDataFrame([(names[0], 0.68, 1, 2e-5), (names[1], 0.755, 2, 2e-5), (names[2], 0.765, 3, 2e-5)], "config string, macro_f1 double, epochs int, learning_rate double")
    pairs = [(names[0], names[1], "macro_f1", -0.07, -0.1, -0.05), (names[0], names[2], "macro_f1", -0.08, -0.1, -0.06), (names[1], names[2], "macro_f1", -0.01, -0.02, 0.01)]
    return summary, spark.createDataFrame(pairs, "arm_a string, arm_b string, metric string, difference double, ci_low double, ci_high double")
