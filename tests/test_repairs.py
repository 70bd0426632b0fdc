"""Cases that earlier versions got wrong."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.ml import features
from pactlens.operators import dedup
from pactlens.operators import evaluation as E
from pactlens.operators import runs as R
from pactlens.operators import selection as X
from pactlens.session import build_session, shared_folder
from pactlens.sources import annotations as N
from pactlens.sources import pages as P
from pactlens.sources import stores as K
from pactlens.streaming import scoring as SS


def test_recovery_keeps_stored_messages(spark):
    rows = spark.createDataFrame(
        [(1, "failed", "real cause", "2024-01-01 00:00:00"), (2, "running", None, "2024-01-01 00:00:00"), (3, "completed", None, "2024-01-01 00:00:00")],
        "run_id int, status string, error_message string, at string")
    runs = rows.select("run_id", "status", "error_message", F.to_timestamp("at").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    got = {r["run_id"]: (r["status"], r["error_message"]) for r in R.recover_stale(runs, F.lit("2024-02-01").cast("timestamp"), "10 DAYS").collect()}
    assert got[1] == ("failed", "real cause") and got[2][0] == "failed" and got[2][1] and got[3] == ("completed", None)


def test_blank_spans_are_unlabeled(spark):
    rows = spark.createDataFrame([(1, True, "\n\t "), (2, True, "x"), (3, None, "y")], "id int, gold_high boolean, text string")
    assert [r["id"] for r in E.labeled(rows, text="text").collect()] == [2]


def test_a_clause_with_two_stored_hashes_comes_out_once(spark):
    clauses = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "contract_id int, clause_index int, content_hash string")
    stored = spark.createDataFrame([(1, 1, "a"), (1, 1, "old"), (1, 1, "a"), (1, 2, None)], "contract_id int, clause_index int, content_hash string")
    got = K.with_cache_flag(clauses, stored).orderBy("clause_index").collect()
    assert [(r["clause_index"], r["is_cached"]) for r in got] == [(1, True), (2, False)]


def test_repeated_keys_need_an_order(spark):
    target = spark.createDataFrame([(1, 1, 0.5)], "contract_id int, clause_index int, score double")
    once = spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.1)], "contract_id int, clause_index int, score double")
    assert sorted(tuple(r) for r in K.upsert(target, once).collect()) == [(1, 1, 0.7), (1, 2, 0.1)]
    with pytest.raises(Exception, match="repeated keys need an order"):
        K.upsert(target, once.union(once)).collect()


@pytest.mark.parametrize("extra,problem", [
    ({"missing_protections": "scope_creep"}, "unknown missing_protections entry"),
    ({"missing_protections": ["scope_creep", None]}, "unknown missing_protections entry"),
    ({"missing_protections": [5]}, "unknown missing_protections entry"),
    ({"missing_protections": None}, None), ({}, None), ({"id": "x"}, "id must be an integer"), ({"id": 1.5}, "id must be an integer"), ({"id": 3}, None),
])
def test_malformed_annotations_are_problems(spark, extra, problem):
    clause = {"anchor_start": "a", "clause_type": None, "high_risk": None} | {k: v for k, v in extra.items() if k == "id"}
    body = {"clauses": [clause]} | {k: v for k, v in extra.items() if k != "id"}
    valid, problems = N.parse_annotations(spark.createDataFrame([("f", json.dumps(body))], "source string, raw string"))
    assert [r["problem"] for r in problems.collect()] == ([problem] if problem else [])
    assert valid.count() == (0 if problem else 1)


def test_page_gaps_have_no_cap_by_default(spark):
    digital = spark.createDataFrame([(1, i, "") for i in range(30)], "doc_id int, page_no int, text string")
    row = P.fill_page_gaps(digital, digital.withColumn("text", F.lit("x"))).first()
    assert row["ocr_pages"] == 30 and row["ocr_error"] is None


def test_report_states(spark, tmp_path):
    assert K.read_report(spark, f"{tmp_path}/none").first()["measured"] is False
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "r.json").write_text("{broken")
    assert K.read_report(spark, f"{tmp_path}/bad").first()["error"] == "malformed report"
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / f"{name}.json").write_text('{"n": 1, "precision_high": 0.5}')
    row = K.read_report(spark, f"{tmp_path}/two").first()
    assert row["measured"] is False and row["error"] == "several reports"


def test_tuning_history_file(spark, tmp_path):
    assert K.read_tuning_history(spark, f"{tmp_path}/none.json").count() == 0
    for name, body in (("bad", "not json {"), ("shape", '{"runs": "nope"}'), ("list", "[1]")):
        (tmp_path / f"{name}.json").write_text(body)
        assert K.read_tuning_history(spark, f"{tmp_path}/{name}.json").count() == 0
    runs = [{"run_id": "a", "started_at": "2024", "best_score": "0.8", "artifact_sha": "opt:12", "trials": [{"index": "1", "score": "0.5"}, {"score": None}, "x"]},
            "no run", {"run_id": "b", "started_at": "2025", "artifact_sha": "opt:none", "trials": [{"score": 0.4}]}]
    (tmp_path / "good.json").write_text(json.dumps({"runs": runs}, indent=1))
    rows = K.read_tuning_history(spark, f"{tmp_path}/good.json")
    got = {r["run_id"]: r for r in rows.collect()}
    assert set(got) == {"a", "b"} and got["a"]["best_score"] == 0.8 and got["a"]["artifact_sha"] == "12" and got["b"]["artifact_sha"] is None
    assert [tuple(t) for t in got["a"]["trials"]] == [(1, 0.5), (2, None)]
    assert [(r["run_id"], r["best_score"], r["trial_count"]) for r in R.tuning_history(rows).collect()] == [("a", 0.8, 2), ("b", 0.4, 1)]
    assert R.latest_tuning_run(rows).first()["run_id"] == "b"


def test_answers_survive_a_round_trip(spark, tmp_path):
    path = f"{tmp_path}/answers"
    for score in (0.1, 0.9):
        K.append_answers(spark.createDataFrame([("k", "s", ["f"], score)], K.ANSWER_SCHEMA).coalesce(1), path)
    with open(f"{tmp_path}/answers/broken.txt", "w") as broken:
        broken.write("{broken\n\n")
    rows = K.latest_answers(K.read_answer_lines(spark, path)).collect()
    assert [(r["key"], r["dspy_risk_score"]) for r in rows] == [("k", 0.9)]


def test_two_streams_share_a_store(spark, tmp_path):
    texts = [(i, f"The Client shall pay invoice {i} within 30 days.\n\nEither party may terminate agreement {i}.") for i in range(8)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    folder = f"{tmp_path}/store"
    SS.open_store(spark, folder)
    stored = []
    for name, part in (("even", "doc_id % 2 = 0"), ("odd", "doc_id % 2 = 1"), ("again", "true")):
        rows.filter(part).write.parquet(f"{tmp_path}/in-{name}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in-{name}")
        SS.start_scoring(stream, folder, f"{tmp_path}/cp-{name}").awaitTermination()
        stored.append((SS.all_scores(spark, folder).count(), SS.stored_scores(spark, folder).select("doc_id").distinct().count()))
    assert stored == [(8, 4), (16, 8), (16, 8)]


def test_a_failed_score_does_not_hide_a_good_one(spark, tmp_path):
    folder = f"{tmp_path}/store"
    SS.open_store(spark, folder)
    for version, error in ((1, None), (2, "Timeout")):
        row = spark.createDataFrame([(1, 1, "h", "ip", 0.5, 0.5, 1, "low", "s", 0, error)], SS.STORE_SCHEMA)
        SS.score_store(spark, folder).commit(row, "r", version)
    assert [(r["error"], r["version"]) for r in SS.stored_scores(spark, folder).collect()] == [(None, 1)]


def test_inverse_frequency_of_query_and_model_agree(spark):
    rows = spark.createDataFrame([(i, ["all"] + (["some"] if i < 2 else [])) for i in range(4)], "id int, grams array<string>")
    table = {r["gram"]: r["idf"] for r in features.vocabulary(rows).collect()}
    counts = features.CountVectorizer(inputCol="grams", outputCol="counts", minDF=2.0).fit(rows)
    fitted = features.SmoothIDF(inputCol="counts", outputCol="w").fit(counts.transform(rows))
    model = dict(zip(counts.vocabulary, fitted.getScalingVec().toArray(), strict=True))
    assert model["all"] == 1.0 and all(math.isclose(model[k], v) for k, v in table.items())


def test_general_stop_words(spark):
    words = T.general_stop_words()
    assert {"of", "and", "to"} <= set(words) and "not" not in words


def test_folds_hold_equal_shares_of_every_class(spark):
    rows = spark.createDataFrame([(i, "big" if i % 10 else "rare") for i in range(100)], "id long, label string")
    got = X.stratified_folds(rows, "label", "id", 5).groupBy("label", "_fold").count().collect()
    assert {(r["label"], r["count"]) for r in got} == {("big", 18), ("rare", 2)} and len(got) == 10


@pytest.mark.parametrize("n", [20, 60])
def test_texts_of_shared_paragraphs_do_not_wait_for_each_other(spark, n):
    """Ten of twenty paragraphs each: many shared shingles, no duplicates, no link to settle."""
    import random
    rng = random.Random(5)
    paragraphs = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(20)]
    texts = [(i, " ".join(paragraphs[k] for k in sorted(rng.sample(range(20), 10)))) for i in range(n)]
    rows = spark.createDataFrame(texts, "id long, text string")
    words = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in texts]
    kept, gone = [], {}
    for i, s in enumerate(words):
        first = next((k for k in kept if len(s & words[k]) / len(s | words[k]) >= 0.85), None)
        if first is None:
            kept.append(i)
        else:
            gone[i] = first
    assert {r["id"]: r["keeper_id"] for r in dedup.near_duplicates(rows).collect()} == gone


def test_shared_folder_is_required_off_local_masters(spark):
    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())
    assert build_session is not None
