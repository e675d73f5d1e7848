import random

import corpus_pipeline
import pytest

pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def prose(i, n=60):
    rng = random.Random(i)
    return " ".join(f"word{rng.randrange(997)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = []
    for i in range(120):
        rows.append((i, prose(i) if i % 4 else " ".join(w + "###$$$" for w in prose(i).split())))
    rows += [(200, prose(1)), (201, prose(901) + " " + prose(900, 12)), (202, "password = hunter2hunter\n" + prose(3000)), (203, None), (204, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 12))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i in range(120) if i % 4}
    assert {i for i in seen["quality_classifier"] if i < 120} == good
    assert 200 not in seen["jaccard_join"] and 1 in seen["jaccard_join"]
    assert 201 in seen["jaccard_join"] and 201 not in seen["benchmark_decontamination"]
    text = seen["secret_scans"][202]["text"]
    assert "hunter2" not in text and seen["secret_scans"][202]["n_chars"] == len(text)
    assert set(seen["secret_scans"]) == set(seen["benchmark_decontamination"])


def test_near_duplicates_by_five_words_and_eighty_percent(spark, folder):
    words = [f"u{i}" for i in range(60)]
    near = words[:30] + ["other"] + words[31:]  # 4 words: 53 of 61 shingles, 0.869; 5 words: 51 of 61, 0.836
    ends = [*words[:53], *(f"z{i}" for i in range(6))]  # against words, 4: 50 of 63, 0.794; 5: 49 of 62, 0.790
    wide = [f"v{i}" for i in range(60)]
    less = wide[:54] + [f"y{i}" for i in range(6)]  # 4: 51 of 63, 0.810; 5: 50 of 62, 0.806
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate((words, near, ends, wide, less))], COLUMNS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, folder).collect()) == [0, 2, 3]


def test_run_packs_all_that_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in rows}
    assert {i for i in range(120) if i % 4} <= kept and not kept & {0, 200, 201}
    assert all(r["offset"] + r["length"] <= 2048 for r in rows) and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
