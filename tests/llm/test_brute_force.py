"""Operators against brute-force versions on small fixtures."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from pactlens.llm import (fingerprints, language_id, line_spread, mixing, near_duplicates, packing, personal_data, quality,
                          secrets, texts, vector_search)
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def documents(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows_of(spark, name, folder=FOLDER):
    return entry.queries()[name](spark, folder).collect()


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op7_vector_search", "op10_line_spread"])
def test_matches_reference_sql(spark, con, name):
    verdict, detail = compare(spark, con, FOLDER, name)
    assert verdict == "ok", detail


# texts

@pytest.mark.parametrize("values", [["", None, "a", "Ab cD_1 e\n𝒳é Ab"], [], ["x y"] * 3])
def test_words_and_shingles(values):
    points, offsets = texts.code_points(pa.array(values, pa.string()))
    assert [offsets[i + 1] - offsets[i] for i in range(len(values))] == [len(v or "") for v in values]
    word, at = texts.words(points, offsets)
    plain = [re.findall(r"\w+", (v or "").lower()) for v in values]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    same = defaultdict(set)
    for h, w in zip(word.tolist(), itertools.chain(*plain), strict=True):
        same[w].add(h)
    assert all(len(v) == 1 for v in same.values()) and len(set.union(set(), *same.values())) == len(same)
    _, made = texts.shingles(word, at, 3)
    assert np.diff(made).tolist() == [max(len(p) - 2, 1) if p else 0 for p in plain]


# op1

def greedy(text, learned):
    at = found = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in learned:
            end += 1
        at = max(at + 1, end - 1)
        found += 1
    return found


def test_phrases_are_the_greedy_parse():
    rng = random.Random(1)
    sample = "".join(rng.choice("abc d") for _ in range(400))
    model = language_id.fit({"x": [sample]})
    learned = " " + language_id.plain(sample) + " "
    made = [language_id.plain("".join(rng.choice("abcz d") for _ in range(n))) for n in (1, 7, 200, 512, 513, 1000, 5000, 100_000)]
    counts, sizes, _ = language_id.phrases(model, *texts.code_points(pa.array(made)))
    assert counts[:, 0].tolist() == [greedy(t, learned) for t in made] and sizes.tolist() == [len(t) for t in made]


def test_phrases_run_over_the_ends_of_blocks():
    rng = random.Random(2)
    sample = "".join(rng.choice("abcd") for _ in range(3000))
    model = language_id.fit({"x": [sample], "y": ["ab" * 2000]})
    made = [sample[100:980], sample[:3000], sample[7:2500] + sample[7:2500], "ab" * 1500, "ba" * 1500 + "b", "a" * 1200]
    counts, _, _ = language_id.phrases(model, *texts.code_points(pa.array(made)))
    assert counts[0, 0] == counts[1, 0] == counts[3, 1] == 1
    for at, learned in enumerate((sample, "ab" * 2000)):
        assert counts[:, at].tolist() == [greedy(t, f" {learned} ") for t in made]


def test_every_sampled_letter_is_told_apart():
    rng = random.Random(3)
    here, there = ([chr(first + i) for i in range(700)] for first in (0x4E00, 0x4E00 + 350))
    write = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": [write(here, 3000)], "y": [write(there, 3000)]}
    model = language_id.fit(samples)
    made = [write(here, 1500), write(there, 1500), samples["x"][0][5:2000], "latin " + write(here, 600)]
    counts, _, _ = language_id.phrases(model, *texts.code_points(pa.array(made)))
    for at, name in enumerate(("x", "y")):
        assert counts[:, at].tolist() == [greedy(t, f" {samples[name][0]} ") for t in made]
    assert language_id.predict(model, *texts.code_points(pa.array(made)))[0] == ["x", "y", "x", "x"]


def test_languages_of_held_out_documents(spark):
    truth = dict(connect(MORE).execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in rows_of(spark, "op1_language_id", MORE) if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_every_language_with_a_text_is_sampled(spark):
    hot = spark.range(100000).selectExpr("'same text in all of these rows' AS text", "'hot' AS lang")
    few = [(f"text number {w}", "hot") for w in ("one", "two", "three")] + [(f"{i} ...", "odd") for i in range(200)] + [("a word", "odd"), (None, "odd"), ("??", "none")]
    few += [(f"word{i} " * 9, "many") for i in range(300)]
    frame = hot.union(spark.createDataFrame(few, "text string, lang string"))
    found = language_id.sample(frame, language_id.F.lit(True))
    assert sorted(found) == ["hot", "many", "odd"] and found["odd"] == ["a word"]
    assert sorted(found["hot"]) == sorted({"same text in all of these rows", *(t for t, k in few if k == "hot")})
    assert len(set(found["many"])) == len(found["many"]) == language_id.SAMPLE_TEXTS


# op2

def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(2)
    term = np.sort(rng.integers(1, 2**63, 60, dtype=np.uint64))
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    signature = fingerprints.signatures(np.concatenate([term, term]), np.concatenate([a, b]), np.array([0, 60, 120]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(fingerprints.likeness(signature[:1], signature[1:])[0] - want) < 4 * math.sqrt(want * (1 - want) / fingerprints.SAMPLES)


def test_fingerprints_of_neighbours(spark, documents):
    order = sorted(documents, reverse=True)
    got = {r["doc_id"]: r for r in rows_of(spark, "op2_fingerprints")}
    off = []
    for at, i in enumerate(order):
        text, after = documents[i], documents[order[(at + 1) % len(order)]]
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        assert got[i]["edited_sha256"] == sha(changed) and got[i]["n_chars"] == len(text)
        a, b = (Counter(zip(["", *w], w, strict=False)) for w in (re.findall(r"\w+", t.lower()) for t in (text, changed)))
        off.append(got[i]["near_edited"] - (a & b).total() / max(1, (a | b).total()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
    same = defaultdict(set)
    for i, text in documents.items():
        same[text].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


# op3

def classes_by_brute_force(documents):
    def weights(text):
        w = re.findall(r"\w+", text.lower())
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([("raw", text)])

    made, label = {i: weights(t) for i, t in documents.items()}, {i: i for i in documents}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(made), 2):
        if made[a].keys() & made[b].keys():
            if (made[a] & made[b]).total() >= 0.8 * (made[a] | made[b]).total() - 1e-9:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in documents}


def test_classes_of_the_given_documents(spark, documents):
    got = {r["doc_id"]: r["class_id"] for r in rows_of(spark, "op3_near_duplicates")}
    assert got == classes_by_brute_force(documents)


def test_classes_of_groups_and_chains(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(4000)]
    base = rng.sample(pool, 120)
    documents = {i: " ".join(base) for i in range(30)}  # exact copies
    for i in range(30, 150):  # near copies of one text, often below the threshold among themselves
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = rng.choice(pool)
        documents[i] = " ".join(copy)
    shared = rng.sample(pool, 90)  # a passage that makes half of many texts
    documents |= {i: " ".join(shared + rng.sample(pool, 40)) for i in range(150, 220)}
    chain = rng.sample(pool, 200)
    for i in range(220, 240):  # each a little different from the one before
        documents[i] = " ".join(chain)
        at = rng.randrange(200)
        chain = chain[:at] + rng.sample(pool, 3) + chain[at + 3:]
    frame = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    found = near_duplicates.near_duplicates(frame).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == classes_by_brute_force(documents)
    assert sorted(r["doc_id"] for r in found if r["keeper"]) == sorted({r["class_id"] for r in found})


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:200], rng.integers(1, 2**63, 50, dtype=np.uint64)]))
    one = np.array([7], np.uint64)
    found = near_duplicates.signatures(np.concatenate([a, b, one, one]), np.array([0, 300, 550, 551, 552]))
    assert (found != 0).all() and (found[2] == found[3]).all()
    assert abs((found[0] == found[1]).mean() - 200 / 350) < 4 * math.sqrt(0.25 / near_duplicates.COORDINATES)


# op4

def test_mix_meets_targets(spark, con, documents):
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in documents.items()}
    rows = rows_of(spark, "op4_mix_sources")
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = mixing.targets(total, mixing.cycled(total))
    taken = Counter()
    for r in rows:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == total[source[i]] and r["taken"] <= 3 * size[i]
        assert math.isclose(r["target"], want[source[i]])
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, rows_of(spark, "op4_mix_sources")))


def test_targets_reshare_what_small_sources_cannot_take():
    found = mixing.targets({"a": 1, "b": 10, "c": 100}, {"a": 5, "b": 2, "c": 1})
    assert found == {"a": 3.0, "b": 30.0, "c": 78.0}
    assert mixing.targets({}, {}) == {} and list(mixing.cycled([None, "b", "a", "é"]).values()) == [5, 2, 1, 5]


def test_tree_keeps_quotas():
    quotas = np.array([100, 7, 0, 31])
    dealt = mixing.split_quotas(quotas, 9, np.random.default_rng(1))
    assert (dealt.sum(0) == quotas).all() and set(dealt.sum(1).tolist()) <= {15, 16}


def test_mix_rows_are_the_planned_words(spark):
    frame = spark.createDataFrame([(i, " ".join(["w"] * (i % 9 + 1)), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    mix, plan = mixing.mix_sources(frame, shards=4)
    rows = mix.withColumn("cut", mixing.first_words(mix["text"], mix["words"])).collect()
    words = Counter()
    for r in rows:
        words[r["source"]] += r["words"]
        assert len(r["cut"].split()) == r["words"]
    assert words == {s: round(t) for s, t in plan.targets.items()}
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and {r["shard"] for r in rows} == {0, 1, 2, 3}


def test_texts_that_start_with_blanks_are_cut_right(spark):
    rows = [(i, "\n\t " + " ".join(f"w{i}x{j}" for j in range(9 + i % 5)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op4_mix_sources(docs).collect()
    taken, goal = Counter(), {}
    for r, (_, _, source) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        taken[source] += r["taken"]
        goal[source] = round(r["target"])
    assert taken == goal


def test_the_cut_is_found_from_fine_blocks(spark, monkeypatch):
    """Few blocks and fine blocks, so that cuts fall inside blocks of many documents."""
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for blocks, fine in ((1, 2), (4, 2), (16, 64)):
        monkeypatch.setattr(mixing, "SOURCE_BLOCKS", blocks)
        monkeypatch.setattr(mixing, "FINE_BLOCKS", fine)
        mix, plan = mixing.mix_sources(docs)
        words = {r["source"]: r["words"] for r in mix.groupBy("source").agg({"words": "sum"}).withColumnRenamed("sum(words)", "words").collect()}
        assert words == {s: round(t) for s, t in plan.targets.items()}
        assert mix.filter("words < size").count() <= 2


def test_taken_words_are_those_of_the_mix(spark, monkeypatch):
    rows = [(i % 250, " ".join(f"w{i % 250}" for _ in range(i % 250 % 7)), "abc"[i % 250 % 3]) for i in range(300)]  # 50 rows twice
    rows += [(900, "same words again and again", "d")] * 40 + [(None, "no id", None), (None, "no id", None), (901, None, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixes, shuffled = [], mixing.shuffled
    monkeypatch.setattr(mixing, "shuffled", lambda mix, *a: mixes.append(shuffled(mix, *a)) or mixes[-1])
    got = mixing.op4_mix_sources(frame).collect()
    assert len(mixes) == 1 and sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, _, _ in rows)
    drawn, taken, target = Counter(), Counter(), {}
    for r in mixes[0].collect():
        drawn[r["doc_id"]] += len(r["text"].split())
    source = {i: s for i, _, s in rows}
    for r in got:
        taken[r["doc_id"]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert taken == drawn
    for s, goal in target.items():
        assert sum(n for i, n in taken.items() if source[i] == s) == round(goal)


def test_sources_without_words_keep_their_place_in_the_weights(spark):
    rows = [(i, "one two three four five six seven eight nine ten", "bcd"[i % 3]) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, " \t\n", "a"), (1003, "", "e")]
    got = mixing.op4_mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, source, taken = {"a": 0, "b": 1000, "c": 1000, "d": 1000, "e": 0}, {i: s for i, _, s in rows}, Counter()
    want = {"a": 0, "b": 750, "c": 375, "d": 1875, "e": 0}  # weights 2, 1, 5 of b, c, d
    for r in got:
        assert math.isclose(r["target"], want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(got) == len(rows) and taken == Counter(want)
    blank = spark.createDataFrame(rows[-4:], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.op4_mix_sources(blank).collect()} == {(0.0, 0)}
    assert mixing.targets({"a": 0, "b": 4}, {"b": 1.0}) == {"a": 0.0, "b": 4.0}


# op5

def test_flat_trees_walk_like_recursive_ones():
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    found = quality.scores(model, x[:20])
    for row, score in zip(x[:20], found, strict=True):
        total = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))
    assert ((quality.scores(model, x) > 0.5) == (x[:, 0] + x[:, 1] > 1)).mean() > 0.95


def test_quality_of_held_out_documents(spark):
    truth = dict(connect(MORE).execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [r for r in rows_of(spark, "op5_quality", MORE) if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_statistics():
    x = dict(zip(quality.FEATURES, quality.statistics(*texts.code_points(pa.array(["Ab ab!\nAb ab!|\n9 é", "", None])))[0], strict=True))
    assert math.isclose(x["exclamations"], 2 / 18) and math.isclose(x["bars"], 1 / 18) and math.isclose(x["upper"], 2 / 9)
    assert math.isclose(x["distinct_words"], 3 / 6) and math.isclose(x["distinct_lines"], 1) and math.isclose(x["beyond_ascii"], 1 / 18)


# op6

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if accepted(k, m[0]))


TRICKY = ["", "a@b.c_d@e.f", "a@b", "x.y@z-.q.r..s", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1..2.3.4", "4111 1111 1111 1111-2 4111-1111-1111-1111",
          "+1 (555) 010-9999. +12 +123456789 ++1.555.555.5555)", "é𝒳 4111111111111111 ñ a@b.org", "9" * 5000, "a." * 3000 + "@b" + ".c" * 3000,
          "1." * 4000, "+" + "1 " * 50, "@@@ .@. %@-.- a%b+c@d.e", "5 " * 4000]


def test_base_spans(spark, documents):
    values = dict(enumerate(TRICKY)) | {i + 100: t for i, t in documents.items()}
    rows = personal_data.op6_personal_data(spark.createDataFrame(list(values.items()), "doc_id long, text string")).collect()
    for r in rows:
        want = base_spans(values[r["doc_id"]])
        assert r["base_sha256"] == sha(want), values[r["doc_id"]][:200]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in BASE] == [s for s in want.split(",") if s]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want.split(",")) for k in BASE]


def test_addresses_with_parts_of_zeros(spark):
    values = {0: "10.0.0.1 0.0.0.0 000.1.2.3", 1: "127.0.0.1 at 192.168.0.5", 2: "0.0.0.256 00000.0000255.0.1 0.0.0", 3: "0" * 4000 + ".0.0.0"}
    rows = personal_data.op6_personal_data(spark.createDataFrame(list(values.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_ip"] for r in rows} == {0: 3, 1: 2, 2: 1, 3: 1}
    for r in rows:
        want = base_spans(values[r["doc_id"]])
        assert r["base_sha256"] == sha(want) and r["spans"] == want


def test_added_kinds_need_their_checks(spark):
    frame = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 or"), (2, "IBAN GB83 WEST 1234 5698 7654 32"), (3, "ssn: 123-45-6789"),
                                   (4, "part 123-45-6789"), (5, "DE89370400440532013000")], "doc_id long, text string")
    found = personal_data.find_personal_data(frame)
    spans = {r["id"]: [s["kind"] for s in r["spans"]] for r in found.collect()}
    assert spans == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["iban"]}
    assert {r["id"]: r["text"] for r in personal_data.redact(found).collect()}[3] == "ssn: [ssn]"


# op7

def test_search_on_random_vectors(spark):
    rng = np.random.default_rng(7)
    for scale in (1, 3000, 2e9):  # 32-bit, 64-bit and integer arithmetic
        x = (rng.normal(size=(300, 12)) * scale).astype(np.float32)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = defaultdict(list)
        for r in vector_search.op7_vector_search(frame).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        z = np.floor(x.astype(float) * 64).astype(np.int64)
        assert len(got) == 15
        for q in got:
            best = sorted(((-int(s), i) for i, s in enumerate(z @ z[q]) if i != q))[:20]
            assert got[q] == [(-s, i) for s, i in best]


def test_search_passes_scores_between_shards(spark, monkeypatch):
    """Small shards and blocks, repeated ids, repeated rows and many equal scores at the last rank."""
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 16)
    rng = np.random.default_rng(8)
    rows = [(int(i) // 2 * 2, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, size=(600, 5)).astype(np.float32))]
    rows += rows[:40] + rows[20:30]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = Counter(tuple(r) for r in vector_search.op7_vector_search(frame).select("query_id", "rank", "vec_id", "score").collect())
    ids, z = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).astype(np.int64) * 64
    want: Counter = Counter()
    for q in np.flatnonzero(ids % 20 == 0):
        ranked = sorted((-int(s), int(ids[i])) for i, s in enumerate(z @ z[q]) if i != q)[:20]
        want.update((int(ids[q]), n, i, -s) for n, (s, i) in enumerate(ranked, 1))
    assert got == want and max(want.values()) > 1


def test_bounds_leave_no_better_vector_out():
    rng = np.random.default_rng(9)
    vectors = np.round(rng.normal(size=(3000, 48)) * 40 / np.arange(1, 49)).astype(np.int64)
    queries = np.round(rng.normal(size=(150, 48)) * 40 / np.arange(1, 49)).astype(np.int64)
    beat, seen = np.full(150, -np.inf), [[] for _ in queries]
    for shard in np.split(vectors, 6):
        for at, _, score in vector_search.best(queries, shard, 9, beat):
            seen[at] += score.tolist()
    whole = -np.sort(-(queries @ vectors.T), axis=1)[:, :9]
    assert [sorted(s, reverse=True)[:9] for s in seen] == whole.tolist() and (beat <= whole[:, 8]).all()


# op8

def test_secret_spans(spark, documents):
    base = [("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    values = documents | {-1: "secret:token:abcdefg PASSWORD='x' Api_Key==abcdefgh", -2: "AKIAAKIA" + "B" * 12 + " tokeN=\"0123456789abcdef01234567\"", -3: ""}
    rows = secrets.op8_secrets(spark.createDataFrame([(i, t, "s") for i, t in values.items()], "doc_id long, text string, source string")).collect()
    for r in rows:
        spans = sorted((m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, g, n) in enumerate(base)
                       for m in re.finditer(p, values[r["doc_id"]]) if len(m[g]) >= n)
        assert r["base_sha256"] == sha(",".join(s for _, _, s in spans))


def test_copied_examples_are_told_from_live_values(spark):
    rows = [(i, f"token = {'Zx81kQ0pLmN4' if i < 6 else 'q9W8e7R6t5Y4'}", f"owner{i % 5 if i < 6 else 9}") for i in range(8)]
    rows += [(8, "token = aaaaaaaaaaaa", "owner1")]
    rows += [(9, "nothing", None), (10, None, "owner2")]
    got = {r["doc_id"]: (r["n_example"], r["n_live"], r["repositories"])
           for r in secrets.op8_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: (1, 0, 6) for i in range(6)} | {6: (0, 1, 2), 7: (0, 1, 2), 8: (0, 0, 1), 9: (0, 0, 0), 10: (0, 0, 0)}


# op9

def test_boundaries_are_optimal():
    rng = random.Random(9)
    for _ in range(20):
        histogram = np.array([0] + [rng.choice([0, 0, 1, 5, 9]) for _ in range(11)])
        lengths = np.flatnonzero(histogram)
        for buckets in (1, 2, 3):
            found = packing.boundaries(histogram, buckets)

            def cost(bounds):
                return sum(histogram[n] * (min(b for b in bounds if b >= n) - n) for n in lengths)

            if not len(lengths):
                assert found == []
                continue
            best = min(cost((*c, lengths[-1])) for k in range(buckets) for c in itertools.combinations(lengths[:-1], k))
            assert len(found) <= buckets and cost(found) == best


def test_batches_keep_the_budget(spark, documents):
    rows = rows_of(spark, "op9_packing")
    length, slots = Counter(), defaultdict(set)
    for r in rows:
        length[r["doc_id"]] += r["length"]
        if r["batch"]:
            assert r["length"] <= r["boundary"] <= packing.MAX_LENGTH
            assert r["slot"] not in slots[r["batch"]]
            slots[r["batch"]].add(r["slot"])
            assert r["boundary"] * (r["slot"] + 1) <= packing.BATCH_TOKENS
    assert length == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in documents.items()}
    assert all(s == set(range(len(s))) for s in slots.values())


def test_pieces_hold_the_whole_text(spark, documents):
    rows = packing.pack(spark.createDataFrame(list(documents.items()), "doc_id long, text string"), max_length=100, keep_text=True).collect()
    joined = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        joined[r["doc_id"]] += re.findall(r"[^\x20\x09-\x0D]+", r["text"])
    assert all(joined[i] == re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in documents.items())


# op10

def test_a_very_long_text_is_split_once(spark):
    text = " \n" + "\t".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n int")
    got = packing.pack(docs, keep_text=True).orderBy("piece").collect()
    assert len(got) == -(-300_000 // packing.MAX_LENGTH) and "".join(r["text"] for r in got) == text.strip()


def test_lines_near_and_far_above_the_threshold(spark):
    long = "this line is long enough to count, number "
    rows = [(i, f"{long}{0}\n{long}{1 if i < 3 else 2}\nown line of the document {i}", f"s{i}") for i in range(40)]
    got = {r["doc_id"]: r for r in line_spread.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 1 and got[3]["n_removed"] == 1 and got[9]["n_removed"] == 2
    assert got[9]["cleaned"] == "own line of the document 9" and got[2]["cleaned"] == f"{long}1\nown line of the document 2"


def test_short_lines_on_many_sites_go(spark):
    rows = [(i, "All rights reserved.\nOwn line of " + str(i), f"s{i}") for i in range(30)] + [(40, "x\n\nx", "s0"), (41, "x", "s1")]
    got = {r["doc_id"]: r for r in line_spread.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i]["n_removed"] for i in (0, 1, 29, 40, 41)] == [0, 1, 1, 0, 0]
    assert got[7]["cleaned"] == "Own line of 7"


# pipeline

def test_pipeline_stages_against_brute_force(spark, con):
    import corpus_pipeline as pipeline
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())

    kept = stages["quality"](spark, docs, FOLDER).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in ids) == (q == 1) for i, q in truth.items()]) >= 0.95

    rows = {r["doc_id"]: r for r in kept.collect()}
    sites, first = defaultdict(set), {}
    for i in sorted(rows):
        for line in rows[i]["text"].split("\n"):
            bare = line.strip(" \t\r")
            sites[bare].add(rows[i]["source"])
            first.setdefault(bare, i)

    def common(line, i):
        bare = line.strip(" \t\r")
        return bare != "" and len(sites[bare]) >= 4 and first[bare] != i

    want = {i: "\n".join(x for x in r["text"].split("\n") if not common(x, i)) for i, r in rows.items()}
    want = {i: t for i, t in want.items() if t == rows[i]["text"] or t.strip(" \t\r\n")}
    lines = stages["lines"](spark, kept, FOLDER).cache()
    got = {r["doc_id"]: r for r in lines.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())

    classes = classes_by_brute_force(want)
    one = stages["near_duplicates"](spark, lines, FOLDER).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(classes.values()))

    mixed = stages["mix"](spark, one, FOLDER).cache()
    size = Counter()
    for r in one.collect():
        size[r["source"]] += len(r["text"].split())
    goal, taken = mixing.targets(size, mixing.cycled(size)), Counter()
    originals = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
        assert originals[r["doc_id"]].startswith(r["text"].strip())
    assert taken == Counter({s: round(t) for s, t in goal.items()})

    packed = stages["pack"](spark, mixed, FOLDER).collect()
    assert sum(r["length"] for r in packed) == sum(taken.values())
    assert entry.queries()["pipeline"](spark, FOLDER).count() == len(packed)
