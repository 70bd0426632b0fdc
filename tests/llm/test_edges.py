"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from pactlens.llm import (fill_in_middle, filter_audit, fingerprints, language_id, line_spread, mixing, near_duplicates, packing, personal_data, quality,
                          secrets, substring_dedup, vector_search)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, score string, "
          "spans int, label string, part string, guest int, place string, block string, row int, bands int, node string, kept int")
LONG = "alpha beta gamma delta " * 12000
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n ", "en", "a", 4), (4, LONG, "en", "b", len(LONG)),
    (5, "Write to a@b.org or call +1 555 123 4567 now", "en", "a", 44), (5, "Write to a@b.org or call +1 555 123 4567 now", "en", "a", 44),
    (None, "no id here at all, but eight words", "en", None, 34), (6, "¡Ñandú! 𝒳 password = hunter22", "es", "b", 29),
    (7, "1", "es", "b", 1),
]
EXTRA = (9, "x", "y", "z", 3, "l", "p", 1, "q", "r", 2, 0, "n", 4)
OPERATORS = {
    "op1": language_id.op1_language_id, "op2": fingerprints.op2_fingerprints, "op3": near_duplicates.op3_near_duplicates,
    "op4": mixing.op4_mix_sources, "op6": personal_data.op6_personal_data, "op8": secrets.op8_secrets,
    "op10": line_spread.op10_line_spread, "op11": substring_dedup.op11_substring_dedup, "op12": fill_in_middle.op12_fill_in_middle,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, 0), (5, 0, 0), (5, 1, 0), (None, 1, 1), (99, 0, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    ids = sorted(str(r["doc_id"]) for r in OPERATORS[name](docs).collect())
    assert ids == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language_of_odd_texts(docs):
    got = by_id(language_id.op1_language_id(docs).collect())
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4
    assert all(got[i]["score"] == 0 for i in (1, 2, 3, 7)) and got[4]["lang_pred"] == "en"


def test_fingerprints_of_odd_texts(docs):
    rows = fingerprints.op2_fingerprints(docs).collect()
    got = by_id(rows)
    assert got[1]["n_chars"] == 0 and got[4]["n_chars"] == len(LONG)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 0
    assert got[2]["near_next"] == 1  # an empty text after an empty text
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 5}) == 1
    assert sorted(r["near_next"] for r in rows if r["doc_id"] == 5)[-1] == 1  # the repeated row follows itself


def test_classes_of_odd_texts(docs):
    rows = near_duplicates.op3_near_duplicates(docs).collect()
    got = by_id(rows)
    assert got[1]["class_id"] == got[2]["class_id"] == 1 and got[3]["class_id"] == 3
    assert got[5]["class_size"] == 2 and got[None]["class_id"] is None


def test_mix_of_odd_texts(docs):
    got = by_id(mixing.op4_mix_sources(docs).collect())
    assert got[1]["size"] == got[2]["size"] == got[3]["size"] == 0 and got[4]["size"] == 48000
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert got[2]["source_size"] == got[None]["source_size"] == 8


def test_quality_of_odd_texts(docs, labels, nothing, spark):
    rows = quality.op5_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert by_id(rows)[1]["score"] == by_id(rows)[2]["score"]
    assert quality.op5_quality(nothing, labels).collect() == []
    assert quality.op5_quality(docs, labels.limit(0)).count() == len(ROWS)


def test_spans_of_odd_texts(docs):
    got = by_id(personal_data.op6_personal_data(docs).collect())
    assert got[5]["spans"] == "email:9:16,phone:25:40" and got[1]["spans"] == "" == got[2]["spans"]
    got = by_id(secrets.op8_secrets(docs).collect())
    assert got[6]["spans"] == "assign:10:29" and got[1]["n_assign"] == 0


def test_packing_of_odd_texts(docs, nothing):
    rows = packing.op9_packing(docs).collect()
    assert sum(r["length"] for r in rows) == sum(len((r[1] or "").split()) for r in ROWS)
    assert {r["doc_id"] for r in rows if r["batch"] is None} == {1, 2, 3}
    assert packing.op9_packing(nothing).collect() == []


def test_repeats_and_middles_of_odd_texts(docs):
    got = by_id(substring_dedup.op11_substring_dedup(docs).collect())
    assert (got[4]["n_words"], got[4]["n_removed"]) == (48000, 48000) and got[1]["n_words"] == got[3]["n_words"] == 0
    got = by_id(fill_in_middle.op12_fill_in_middle(docs).collect())
    assert [got[i]["form"] for i in (1, 2)] == ["plain"] * 2 and got[4]["n"] == 1 and got[3]["form"] != "plain"


def test_audit_of_odd_texts(docs, labels, nothing):
    rows = filter_audit.op13_filter_audit(docs, labels).collect()
    assert {r["part"] for r in rows} == {"", "a", "b"} and len(rows) == 3 * 600
    assert {r["kept"] + r["removed"] for r in rows if r["step"] == 1 and r["part"] == "a"} == {4}
    assert filter_audit.op13_filter_audit(nothing, labels).collect() == []


def test_search_of_odd_vectors(spark):
    rows = [(20, [0.5, -0.25], "x"), (20, [0.5, -0.25], "x"), (1, [1.0], "x"), (2, None, "x"), (3, [float("nan"), 1.0], "x"),
            (4, [None, 1.0], "x"), (5, [float("inf")], "x"), (6, [], "x"), (40, [0.5, -0.25], "x"), (None, [1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in vector_search.op7_vector_search(frame).orderBy("query_id", "rank").collect()]
    # 0.5 is 32, -0.25 is -16, 1.0 is 64; every query row has a ranking of its own, without itself
    ranked = [(1, None, 2048), (2, 1, 2048), (4, 20, 1280), (5, 6, 0)]
    assert [g for g in got if g[0] == 40] == sorted([(40, *r) for r in ranked] + [(40, 3, 20, 1280)], key=lambda g: g[1])
    assert [g for g in got if g[0] == 20] == sorted(2 * ([(20, *r) for r in ranked if r[0] != 4] + [(20, 3, 20, 1280), (20, 4, 40, 1280)]), key=lambda g: g[1])
    assert {g[0] for g in got} == {20, 40}
    assert vector_search.op7_vector_search(frame.limit(0)).collect() == []


def test_stages_of_odd_texts(spark, docs, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, nothing):
        at = frame
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{frame is docs}-{i}")
            at = spark.read.parquet(f"{tmp_path}/{frame is docs}-{i}")
            if name != "pack":
                assert at.columns == list(corpus_pipeline.COLUMNS)
        assert frame is docs or at.count() == 0


@pytest.mark.parametrize("stage", [s for n, s in corpus_pipeline.STAGES if n != "quality"])
def test_each_stage_alone(spark, docs, stage):
    assert stage(spark, docs, "").count() > 0
