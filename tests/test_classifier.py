"""Grid search, and the language filter's one-scan test."""

from pactlens.functions import language
from pactlens.ml import classifier as M
from pactlens.ml import features


def labelled(spark, rows):
    """(id, label, grams) with all dense columns at ``value``."""
    frame = spark.createDataFrame(rows, "id long, label string, grams array<string>, value double")
    for name in features.legal_features(frame["label"]):
        frame = frame.withColumn(name, frame["value"])
    return frame.drop("value")


def test_grid_search_finds_the_planted_cell(spark):
    """The classes differ in rare words only, so a tight bound on the weights can't tell them apart."""
    rows = [(i, "common" if i % 10 else "rare", ["same"] * 3 + ([f"mark{i % 2}"] if i % 10 == 0 else [f"own{i % 7}"]), float(i % 3)) for i in range(300)]
    table = M.grid_search(labelled(spark, rows), c_grid=(1e-6, 1.0), legal_weights=(1.0, 2.0), folds=3, threads=4)
    got = {(r["c"], r["legal_weight"]): r for r in table.collect()}
    assert len(got) == 4 and sum(r["is_best"] for r in got.values()) == 1
    assert got[1.0, 1.0]["macro_f1"] == 1.0 and got[1.0, 1.0]["is_best"]
    assert max(got[1e-6, w]["macro_f1"] for w in (1.0, 2.0)) <= 1.0
    fitted, model = M.fit_best(labelled(spark, rows), table)
    served = M.serve(model.probabilities(fitted.transform(labelled(spark, rows)).select("label", "features")), model.labels)
    assert served.filter("label <> pred_label").count() == 0


def test_bounded_fits_score_every_held_out_row(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], [f"w{i % 2}", f"x{i % 3}"], float(i % 5)) for i in range(200)]
    seen = []
    monkeypatch.setattr(M.MacroF1, "_evaluate", lambda self, d: seen.append(d.count()) or 0.5)
    sizes = []
    fit = M.OneVsRest.fit.__func__
    monkeypatch.setattr(M.OneVsRest, "fit", classmethod(lambda cls, rows, *a, **k: sizes.append(rows.count()) or fit(cls, rows, *a, **k)))
    table = M.grid_search(labelled(spark, rows), c_grid=(0.5, 1.0), legal_weights=(1.0,), folds=2, iterations=3, fit_rows=40, threads=2)
    assert seen == [100] * 4 and sizes == [40] * 4
    assert [r["c"] for r in table.filter("is_best").collect()] == [0.5]


def test_samples_keep_the_shares_of_the_classes(spark):
    rows = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(4000)], "id long, label string")
    counts = {r["label"]: r["count"] for r in M.stratified_sample(rows, 400).groupBy("label").count().collect()}
    assert counts == {"a": 300, "b": 100}
    assert M.stratified_sample(rows, 10_000).count() == M.stratified_sample(rows, None).count() == 4000


def test_prefilter_knows_every_rule():
    assert all(pattern in language._SUSPECT for pattern, _ in language.REWRITES)
    assert all(pattern in language._SUSPECT for pattern in language.FLAGGED)
