import random
import re

import pytest

from lexspan.operators import checks, chunking, risk, rules, tfidf
from lexspan.plans import samples
from lexspan.streaming import rules_stream

CONTRACTS = "contract string, split string, text string"


def test_rules_hit_and_explain(spark):
    got = rules.rule_hits(samples.clauses(spark)).where("hit").select("id", "category", "rule")
    assert sorted(map(tuple, got.collect())) == sorted(samples.HITS)
    for r in rules.explain(samples.clauses(spark).selectExpr("id", "text", "text as t")).collect():
        assert r["t"][r["start"] : r["end"]] == r["match"]


@pytest.mark.parametrize("text", ["a non exclusive grant", "a non- exclusive grant", "a non‑exclusive grant", "sole and exclusive remedy"])
def test_not_exclusive(spark, text):
    found = rules.category_scores(spark.createDataFrame([(text,)], "text string")).where("category = 'Exclusivity'").first()
    assert found["n_rules"] == 0


def test_any_white_space_and_case(spark):
    df = spark.createDataFrame([("GOVERNED  BY\nthe Laws of Utah",), ("😀 changes in\tcontrol",), (None,)], "text string")
    got = rules.category_scores(df.selectExpr("text", "coalesce(length(text), 0) as n")).where("n_rules > 0").select("n", "category").collect()
    assert sorted(r["category"] for r in got) == ["Change Of Control", "Governing Law"]
    assert rules.explain(df.where("text like '%control'")).first()["start"] == 2
    with pytest.raises(ValueError):
        rules.category_scores(df, (rules.Rule("Unknown", "x", "x"),))


def test_rule_evaluation(spark):
    texts = ["governed by the laws of Ohio", "nothing", "governed by the laws of Utah", "rain"]
    windows = spark.createDataFrame([(f"w{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    labeled = spark.createDataFrame([(f"w{i}", "Governing Law", y, m) for i, (y, m) in enumerate([(1, True), (1, True), (0, False), (0, True)])], "chunk_id string, category string, label int, mask boolean")
    score, stats = rules.evaluate(labeled, windows)
    row = score.where("category = 'Governing Law'").first()
    assert (row["precision"], row["recall"], row["scored_chunks"], row["masked_chunks"]) == (1.0, 0.5, 3, 1)
    rule = stats.where("rule = 'governed_by_laws'").first()
    assert (rule["fired"], rule["true_positive"], rule["only_rule_fired"]) == (1, 1, 1)


def test_risk(spark):
    scored = risk.score_clauses(samples.risk_clauses(spark))
    assert sorted(map(tuple, scored.select("id", "base", "points", "score", "level", "needs_review").collect())) == samples.RISK_SCORES
    assert "fraud" in scored.where("id = 3").first()["rationale"]
    routed = risk.route_review(risk.score_clauses(samples.routed_clauses(spark)))
    assert sorted(map(tuple, routed.select("id", "to_review").collect())) == samples.RISK_ROUTED


def test_missing_cap_and_triage(spark):
    contracts = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("d", True, True), ("e", True, True)], "contract string, expects_cap boolean, processed boolean")
    clauses = spark.createDataFrame([("d", "Cap On Liability", False), ("e", "Cap On Liability", True)], "contract string, category string, unresolved boolean")
    got = {r["contract"]: (r["missing_points"], r["check_review"]) for r in risk.missing_cap(contracts, clauses).collect()}
    assert got == {"a": (0.5, False), "b": (0.0, True), "c": (0.0, False), "d": (0.0, False), "e": (0.0, True)}


TEXTS = ["  " + "alpha " * 13 + "\n", "one two three four\n\nfive six seven eight nine", "one two. three four five six. seven eight nine ten", "   \n", ""]


def test_windows_cover_their_text():
    rng = random.Random(4)
    for text in TEXTS + ["".join(rng.choice(["a ", "bb ", "c. ", "d\n\n", "é\n"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]:
        for size, overlap in ((6, 2), (8, 0), (5, 4)):
            found = list(chunking.cut(text, chunking.word_offsets, chunking.Config(size, overlap)))
            assert bool(found) == bool(text.strip())
            if not found:
                continue
            assert found[0][0] == 0 and found[-1][1] == len(text)
            assert all(a[0] < b[0] and a[1] < b[1] and b[0] <= a[1] for a, b in zip(found, found[1:]))
            assert all(1 <= n <= size and n == len(text[a:b].split()) for a, b, n, _ in found)
            if not overlap:
                assert "".join(text[a:b] for a, b, *_ in found) == text


def test_natural_breaks():
    cut = lambda t: [(t[a:b], why) for a, b, _, why in chunking.cut(t, chunking.word_offsets, chunking.Config(8, 2))]
    assert cut("one two three four five\n\nsix seven eight nine ten")[0] == ("one two three four five\n\n", "paragraph")
    assert cut("one two three four five. six seven eight nine ten")[0] == ("one two three four five. ", "sentence")
    assert cut("one two three four five\n\nsix seven. eight nine ten")[0][1] == "paragraph"
    assert [n for _, _, n, _ in chunking.cut(TEXTS[0], chunking.word_offsets, chunking.Config(6, 2))] == [6, 6, 5]


@pytest.mark.parametrize("bad", [(0, 0), (511, 128), (4, 4), (4, -1), (4.0, 1)])
def test_bad_window_settings(bad):
    with pytest.raises(ValueError):
        chunking.Config(*bad)


def test_chunk_table_and_tampering(spark):
    contracts = spark.createDataFrame([(f"c{i}", "train", t) for i, t in enumerate(TEXTS)], CONTRACTS)
    config = chunking.Config(6, 2)
    chunks = chunking.chunk_contracts(contracts, "words", config)
    assert chunking.validate_chunks(contracts, chunks, config, "words").first()["contracts"] == 3
    for change in ("concat(text, 'x') as text", "cast(0 as long) as n_tokens", "'test' as split", "end + 1 as end", "'same' as chunk_id"):
        name = change.split(" as ")[-1]
        with pytest.raises(ValueError):
            chunking.validate_chunks(contracts, chunks.selectExpr(*(change if c == name else c for c in chunks.columns)), config, "words")
    last = chunks.groupBy("contract").agg({"start": "max"}).withColumnRenamed("max(start)", "start")
    with pytest.raises(ValueError):
        chunking.validate_chunks(contracts, chunks.join(last, ["contract", "start"], "left_anti"), config)
    assert checks.chunk_violations(contracts, chunks, 6).isEmpty()


def test_paragraphs_and_fixed_words(spark):
    assert sorted(tuple(r) for r in chunking.paragraphs(samples.paragraph_text(spark)).collect()) == samples.PARAGRAPHS
    words = chunking.fixed_words(spark.createDataFrame([("c", "a b c d e f g"), ("x", "")], "contract string, text string"), 4, 1)
    assert [tuple(r) for r in words.collect()] == [("c", 0, 0, 4, "a b c d"), ("c", 1, 3, 4, "d e f g")]


def test_risk_queries_read_the_spans(spark, tmp_path):
    from lexspan.plans import bindings, catalog

    texts = [(i, ("at its sole discretion without notice; " if i % 2 else "plain words and nothing more of it all; ") * 20, "en") for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    flags = {"Anti-Assignment": "sole discretion", "Change Of Control": "sole discretion", "Termination For Convenience": "sole discretion", "Audit Rights": "without notice"}
    want, top = {}, {}
    for r in bindings.spans(spark, str(tmp_path)).collect():
        base = risk.BASE[r["category"]]
        score = base + (flags.get(r["category"], "\0") in r["text"])
        want[r["contract"], r["category"]] = base, "High" if score >= 4 else "Medium" if score >= 2 else "Low"
        top.setdefault(r["contract"], []).append(score)
    got = {(r["contract"], r["category"]): (r["base"], r["level"]) for r in catalog.QUERIES["risk_base_points"](spark, str(tmp_path)).collect()}
    assert got == want and any(base < 2 and level == "Medium" for base, level in got.values())
    missing = {r["contract"]: r["missing_points"] for r in catalog.QUERIES["risk_missing_cap"](spark, str(tmp_path)).collect()}
    rows = catalog.QUERIES["risk_triage"](spark, str(tmp_path)).collect()
    assert {r["contract"]: r["triage_score"] for r in rows} == {c: max(top[c]) + missing[c] for c in missing}
    assert any(max(top[r["contract"]]) == 3 for r in rows)


def test_terms(spark):
    df = spark.createDataFrame([("The cat, a CAT's hat",), ("x",)], "text string")
    assert [r[0] for r in df.select(tfidf.terms(df.text)).collect()] == [["the", "cat", "cat", "hat", "the cat", "cat cat", "cat hat"], []]


def test_classifier_learns_toy_labels(spark):
    kinds = {"governed by the laws of the land": (1, 0), "audit of the books each year": (0, 1), "rain falls on the plain": (0, 0)}
    rows = []
    for c in range(6):
        for i, (text, labels) in enumerate(kinds.items()):
            for k, (category, y) in enumerate(zip(("Governing Law", "Audit Rights"), labels)):
                rows.append((f"c{c}", f"{c}-{i}", text, c % 2, category, k, y, True))
    long = spark.createDataFrame(rows, "contract string, chunk_id string, text string, fold int, category string, category_idx int, label int, mask boolean")
    config = tfidf.Config(min_df=1, max_df=1.0)
    found = tfidf.cross_validate(long, config)
    assert found.where("category = 'macro avg'").first()["f1"] == 1
    top = tfidf.fit(long, config).top_terms(6)
    assert any(t == "governed" for c, _, t, _ in top if c == "Governing Law") and not any(t == "governed" for c, _, t, _ in top if c == "Audit Rights")
    with pytest.raises(ValueError):
        tfidf.fit(long.where("label = 0"), config)
    with pytest.raises(ValueError):
        tfidf.require_disjoint(long, long)


def test_classifier_queries_keep_every_term(spark, tmp_path, monkeypatch):
    from lexspan.plans import catalog

    words = [" ".join(f"w{part}x{i}" for i in range(5500)) for part in range(2)]
    docs = [(i, f"{words[i // 3 % 2]} own{i}") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i // 3 % 2, 1 - i // 3 % 2) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fitted, fit = [], tfidf._fit

    def noted(*args, **more):
        found = fit(*args, **more)
        fitted.append((found.model.dictionary.count(), found.model.fitted.shape.held, found.model.config, found.evaluations))
        return found

    monkeypatch.setattr(tfidf, "_fit", noted)
    assert catalog.QUERIES["tfidf_logreg_score"](spark, str(tmp_path)).count() == 8
    assert catalog.QUERIES["tfidf_oof"](spark, str(tmp_path)).count() == 24
    assert [f[:3] for f in fitted] == [(2 * (5500 + 5499), (None,), tfidf.Config()), (2 * (5500 + 5499), (0, 1, 2), tfidf.Config())]
    assert all(f[3] < tfidf.Config().max_evaluations for f in fitted)


def test_rules_on_a_stream(spark, tmp_path):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    batch = spark.createDataFrame([("a", "train", "governed by the laws of Utah", now), ("b", "train", "rain", now)], rules_stream.SCHEMA)
    batch.write.parquet(f"{tmp_path}/in")
    out = rules_stream.detect(rules_stream.read_contracts(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    out.awaitTermination(60)
    assert [(r["contract"], r["category"]) for r in spark.table("found").collect()] == [("a", "Governing Law")]


def test_patterns_use_no_python_only_syntax():
    for rule in rules.RULES:
        re.compile(rule.pattern)


def test_needed_letters_never_keep_a_rule_from_firing(spark):
    """Texts made of the rules' own words, in odd letters that the patterns take for a to z: the same hits without the letters' test."""
    import random

    rng = random.Random(4)
    words = sorted({w for groups in rules.NEEDS.values() for g in groups for w in g})
    phrases = ["in no event", "be liable", "indirect damages", "total liability", "shall not exceed", "limited to the amount", "except for", "shall not apply", "governed by", "the laws of", "laws of", "construed", "governing law", "assign", "consent", "may not assign", "no party", "not assignable", "purported transfer", "null", "change of control", "merger", "terminates", "may terminate", "without cause", "for convenience", "at any time", "exclusive rights", "non-exclusive", "sole supplier", "not to compete", "competitor", "directly or indirectly", "automatically renew", "renewal term", "renew", "successive one year terms", "audits", "inspect", "books", "access to", "records"]
    words += phrases * 2
    odd = {"s": "ſ", "i": "ıİ", "k": "K"}
    texts = []
    for _ in range(700):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 14)))
        texts.append("".join(rng.choice(odd[c]) if c in odd and rng.random() < 0.15 else c.upper() if rng.random() < 0.3 else c for c in text))
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = frame.select("id", *(frame.text.rlike(rules.regex(r.pattern)).alias(f"r{i}") for i, r in enumerate(rules.RULES))).collect()
    want = {(row["id"], r.name) for row in plain for i, r in enumerate(rules.RULES) if row[f"r{i}"]}
    got = {(r["id"], r["rule"]) for r in rules.rule_hits(frame, fired=True).collect()}
    assert got == want and {n for _, n in want} == {r.name for r in rules.RULES}
    assert {(r["id"], r["rule"]) for r in rules.rule_hits(frame).where("hit").collect()} == want


def test_strategies_against_all_pairs(spark):
    """Every counter of the sweep, from windows and spans compared one by one."""
    import random

    rng = random.Random(8)
    texts = {f"c{i}": "".join(rng.choice(["word ", "a ", "end. ", "long-word ", "\n\n"]) for _ in range(rng.randint(5, 120))) + "x" for i in range(8)}
    spans = [(c, rng.choice("AB"), a, min(len(t), a + rng.randint(1, 60))) for c, t in texts.items() for a in (rng.randrange(len(t)) for _ in range(4))]
    spans += spans[:3]
    contracts = spark.createDataFrame(list(texts.items()), "contract string, text string")
    told = chunking.strategies((0, 3), 12)
    windows = chunking.strategy_windows(contracts, told, "words", 12)
    rows = [r.asDict() for r in windows.collect()]
    found = chunking.compare_strategies(windows, spark.createDataFrame(spans, "contract string, category string, start long, end long"), 12)
    own = set(spans)
    for r in found["summary"].collect():
        ws = [w for w in rows if w["strategy"] == r["strategy"]]
        full = lambda w, s: w["contract"] == s[0] and w["start"] <= s[2] and s[3] <= w["end"]
        meets = lambda w, s: w["contract"] == s[0] and w["start"] < s[3] and s[2] < w["end"]
        assert r["chunks"] == len(ws) and r["over_budget"] == sum(w["n_tokens"] > 12 for w in ws) and r["spans"] == len(own)
        assert r["contained_any_size"] == sum(any(full(w, s) for w in ws) for s in own)
        assert r["contained_within_budget"] == sum(any(full(w, s) and w["n_tokens"] <= 12 for w in ws) for s in own)
        assert r["no_overlap"] == sum(not any(meets(w, s) for s in own) for w in ws)
        assert r["partial_only"] == sum(any(any(meets(w, s) and not full(w, s) for s in own if s[1] == k) and not any(full(w, s) for s in own if s[1] == k) for k in "AB") for w in ws)
        assert r["covered_chars"] == len({(w["contract"], i) for w in ws for i in range(w["start"], w["end"])})
        assert r["work_multiplier"] == sum(w["n_tokens"] for w in ws) / sum(len(t.split()) for t in texts.values())
    for r in found["per_category"].collect():
        ws = [w for w in rows if w["strategy"] == r["strategy"] and w["n_tokens"] <= 12]
        mine = [s for s in own if s[1] == r["category"]]
        assert (r["spans"], r["contained_within_budget"]) == (len(mine), sum(any(w["contract"] == s[0] and w["start"] <= s[2] and s[3] <= w["end"] for w in ws) for s in mine))
    hybrid = {(w["contract"], w["start"], w["end"]) for w in rows if w["strategy"] == "hybrid_12_3"}
    plain = chunking.chunk_contracts(contracts.withColumn("split", contracts.contract), "words", chunking.Config(12, 3)).collect()
    assert hybrid == {(r["contract"], r["start"], r["end"]) for r in plain}
    assert sum(r["windows"] for r in found["reasons"].collect()) == len(rows)
