"""Contracts, annotated spans and the presence grid, from nested annotation JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import nfkc
from lexspan.schema import CATEGORIES, LEAKAGE_PREFIX, REDACTION, SHORT_SPAN


def category_of(question_id: Column) -> Column:
    """What follows the last double underscore of a question's id, without a trailing counter."""
    return F.regexp_replace(F.trim(F.element_at(F.split(question_id, "__"), -1)), r"_\d+$", "")


def flatten(raw: DataFrame) -> DataFrame:
    """One row per title: ``contract``, ``text``, ``qas``.

    ``raw`` has the column ``data`` of the annotation format. Entries of one title are
    one contract: its first context counts, and of questions with the same id the first.
    """
    entry = raw.select(F.monotonically_increasing_id().alias("f"), F.posexplode("data").alias("d", "e"))
    part = entry.select("f", "d", F.trim(F.col("e.title")).alias("contract"), F.posexplode("e.paragraphs").alias("p", "part"))
    place = F.struct("f", "d", "p")
    texts = part.groupBy("contract").agg(F.min_by("part.context", place).alias("text"))
    asked = part.select("contract", place.alias("place"), F.posexplode("part.qas").alias("q", "qa"))
    first = asked.withColumn("n", F.row_number().over(Window.partitionBy("contract", "qa.id").orderBy("place", "q"))).where("n = 1")
    listed = first.groupBy("contract").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "q", "qa"))), lambda x: x["qa"]).alias("qas"))
    return texts.join(listed, "contract", "left")


def contracts_of(flat: DataFrame) -> DataFrame:
    return flat.select("contract", "text", F.length("text").cast("long").alias("n_chars"))


def spans_of(flat: DataFrame) -> DataFrame:
    """One row per distinct annotated (contract, category, start, end); questions without answers give none."""
    answer = flat.select("contract", F.length("text").alias("n"), F.explode("qas").alias("qa")).select("contract", "n", category_of(F.col("qa.id")).alias("category"), F.explode("qa.answers").alias("a"))
    size = F.length("a.text").cast("long")
    rows = answer.select("contract", "category", F.col("a.text").alias("text"), F.col("a.answer_start").alias("start"), (F.col("a.answer_start") + size).alias("end"), size.alias("n_chars_span"), F.try_divide("a.answer_start", "n").alias("rel_position"))
    return distinct_spans(rows)


def distinct_spans(spans: DataFrame) -> DataFrame:
    return spans.dropDuplicates(["contract", "category", "start", "end"])


def presence_grid(contracts: DataFrame, spans: DataFrame) -> DataFrame:
    """contract x category with ``n_spans`` and ``has_clause``; the categories are those that these spans have."""
    kinds = spans.select("category").distinct()  # one row per category
    counts = spans.groupBy("contract", "category").agg(F.count("*").alias("n_spans"))
    return contracts.select("contract").crossJoin(F.broadcast(kinds)).join(counts, ["contract", "category"], "left").select("contract", "category", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), (F.coalesce("n_spans", F.lit(0)) > 0).alias("has_clause"))


def clean_text(text: Column) -> Column:
    """NFKC, no-break spaces as spaces, white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.translate(nfkc(text), " ", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def quality_flags(spans: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """Adds redaction, short-span and white-space figures (ratio to three places, half to even)."""
    ratio = F.regexp_count(text, F.lit(r"(?U)[\s\x1c-\x1f]")) / F.greatest(F.length(text), F.lit(1))
    out = spans.withColumn("text_clean", clean_text(F.col(text))) if clean else spans
    return out.withColumn("has_redaction", F.col(text).rlike(REDACTION)).withColumn("is_very_short", F.length(text) < SHORT_SPAN).withColumn("whitespace_ratio", F.bround(ratio, 3))


def priority(spans: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    return spans.where(F.col("category").isin(*categories))


def offset_mismatches(contracts: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans whose text is not what stands at their offsets, or whose contract is unknown."""
    own = spans.groupBy("contract").agg(F.collect_list(F.struct(*spans.columns)).alias("own"))  # a contract's spans meet its text once
    found = own.join(contracts.select("contract", F.col("text").alias("full")), "contract", "left")
    told = lambda s: F.substring(F.col("full"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return found.select(F.explode(F.filter("own", lambda s: ~s["text"].eqNullSafe(told(s)))).alias("s")).select("s.*")


def shared_openings(contracts: DataFrame, n_chars: int = LEAKAGE_PREFIX) -> DataFrame:
    """Contracts whose first characters another one shares. Grouped on a digest: the texts are not moved."""
    signed = contracts.select("contract", "split", "n_chars", F.sha2(F.substring("text", 1, n_chars), 256).alias("sig"))
    again = signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    return signed.join(again, "sig", "left_semi").select("contract", "split", "n_chars")


def crossing_openings(contracts: DataFrame, n_chars: int = LEAKAGE_PREFIX) -> DataFrame:
    """Digests of openings found in more than one split, with how many contracts have each."""
    signed = contracts.select("split", F.sha2(F.substring("text", 1, n_chars), 256).alias("sig"))
    return signed.groupBy("sig", "split").agg(F.count("*").alias("n")).groupBy("sig").agg(F.count("*").alias("splits"), F.sum("n").alias("n_contracts")).where("splits > 1").select("sig", "n_contracts")
