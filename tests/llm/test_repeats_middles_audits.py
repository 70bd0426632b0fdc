"""Substring dedup, fill-in-middle and filter audit against brute force and reference SQL."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlens.llm import catalog, filter_audit, fill_in_middle, substring_dedup
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_filter_audit"])
def test_matches_reference_sql(spark, con, name):
    verdict, detail = compare(spark, con, FOLDER, name)
    assert verdict == "ok", detail


# substring dedup

def repeats(rows, window):
    """(doc_id, words, removed words, hash of the kept ones) by counting all windows."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def fixture_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["ñ", "漢字"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 140))] for _ in range(5)]
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(passages)
            cut, at = rng.randrange(len(passage)), rng.randint(0, len(words))
            words[at:at] = passage[cut:cut + rng.randint(20, 110)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    edge = [f"e{i}" for i in range(70)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a " * 500), (204, "a b c " * 300), (205, "a " * 36), (206, "b " * 35),
             (207, rows[3][1]), (207, rows[3][1]), (None, "no id " * 20), (None, "no id " * 20),
             (208, " ".join(edge[:35])), (209, " ".join(["x", *edge[:35], "y"])), (210, " ".join(edge[36:70])), (211, " ".join(edge[35:70]))]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_are_those_of_all_windows(spark, monkeypatch, hot):
    """With a low bound the anchors of the planted passages go the way of hot ones; the result is the same."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in substring_dedup.op11_substring_dedup(docs).collect()), key=repr)
    assert got == repeats(rows, substring_dedup.WINDOW)


def test_repeats_of_the_given_documents(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = sorted((tuple(r) for r in catalog.QUERIES["op11_substring_dedup"](spark, FOLDER).collect()), key=repr)
    assert got == repeats(rows, 35)


def test_repeats_keep_texts_and_spans(spark):
    rows = fixture_rows(8)
    docs = spark.createDataFrame([(str(i), t, 1, 2, 3, "x") for i, t in rows], "name string, body string, k1 int, spans int, mask int, anchor string")
    got = substring_dedup.drop_repeats(docs, "name", "body", window=20, anchor=8).collect()
    assert sorted((None if r["doc_id"] == "None" else int(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] != "None") == \
        sorted(r for r in repeats(rows, 20) if r[0] is not None)
    assert all(sha(r["kept"]) == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert substring_dedup.drop_repeats(docs.limit(0), "name", "body").collect() == []


def test_factors_are_longest_matches():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 3, 300).astype(np.uint64)
    got = substring_dedup.factor_lengths(word)
    for i in range(300):
        best = 0
        for j in range(300):
            k = 0
            while i != j and max(i, j) + k < 300 and word[i + k] == word[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == best


def test_blocks_mark_windows_across_factor_ends():
    rng = random.Random(4)
    pool = [rng.randint(0, 3) for _ in range(60)]
    segments = [[*pool[a:a + 9], *pool[b:b + 12]] for a, b in ((rng.randint(0, 45), rng.randint(0, 45)) for _ in range(40))]
    seen = Counter(tuple(s[k:k + 8]) for s in segments for k in range(len(s) - 7))
    want = [sum(1 << k for k in range(len(s) - 7) if seen[tuple(s[k:k + 8])] > 1) for s in segments]
    word = np.array(sum(segments, []), np.uint64) + np.uint64(100)
    got = substring_dedup.parse_block(word, np.cumsum([len(s) for s in segments]), 8)
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té𝒳\xa0", max_size=40), max_size=5))
def test_word_hashes_tell_words_apart(texts):
    word, at = substring_dedup.word_hashes(pa.array(texts, pa.string()))
    plain = [WORD.findall(t) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, word.tolist(), strict=True))) == len(set(flat)) == len(set(word.tolist()))


def test_very_long_words():
    a, b = "x" * 200_000, "x" * 70_000 + "y" + "x" * 129_999
    word, _ = substring_dedup.word_hashes(pa.array([f"{a} {b} {a}", a[:-1]]))
    assert word[0] == word[2] and len(set(word.tolist())) == 3


# fill-in-middle

def middle_by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, form, len(pre), len(mid), sha(out), sha(text))


def test_middles_of_odd_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab\nñ𝒳\r  ") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "\n"), (903, "\n\n"), (904, "x<P>y\nz"), (905, "<S"), (906, "line\n" * 50_000),
            (None, "a\nb\nc"), (7, "again\nand again\n"), (7, "again\nand again\n"), (-5, "a\nb")]
    docs = spark.createDataFrame([(i, t, 1, "k", "o") for i, t in rows], "doc_id long, text string, n int, key string, output string").repartition(4)
    got = [tuple(r) for r in fill_in_middle.op12_fill_in_middle(docs).collect()]
    assert sorted(got, key=repr) == sorted((middle_by_hand(i, t) for i, t in rows), key=repr)
    whole = fill_in_middle.fill_in_middle(docs).collect()
    assert all(sha(r["output"]) == r["output_sha256"] for r in whole)
    assert fill_in_middle.op12_fill_in_middle(docs.limit(0)).collect() == []


def test_rates_and_orders(spark):
    docs = spark.range(400).selectExpr("CAST(id AS INT) AS doc_id", "'one\ntwo\nthree' AS text")
    none = fill_in_middle.fill_in_middle(docs, rate=0).select("form").distinct().collect()
    assert [r[0] for r in none] == ["plain"]
    forms = {r[0]: r[1] for r in fill_in_middle.fill_in_middle(docs, rate=50, spm=100).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 140 < forms["plain"] < 260


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n é", max_size=60), st.data())
def test_piece_tables_restore(text, data):
    raw = text.encode()
    places = sorted(data.draw(st.lists(st.integers(0, len(raw)), min_size=2, max_size=2)))
    table = fill_in_middle.PieceTable(raw).cut(*places)
    assert [bytes(p) for p in table.stream()] == [raw[:places[0]], raw[places[0]:places[1]], raw[places[1]:]]
    for form, order in fill_in_middle.ORDERS.items():
        output = table.arrange(order)
        back = fill_in_middle.restored(bytes(output), form)
        assert bytes(back) == raw and back.sha256() == hashlib.sha256(raw).hexdigest()
        assert output.sha256() == hashlib.sha256(bytes(output)).hexdigest()


# filter audit

def audit_by_hand(counts, letters):
    shapley, rows = Counter(), {}
    for order in permutations(letters):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << letters.index(f)
            gone = [sum(c[k] for m, c in counts.items() if m & bit and not m & before) for k in range(3)]
            shapley[f] += gone[0]
            rows["".join(order), step] = [
                sum(c[0] for m, c in counts.items() if not m & (before | bit)), gone[0],
                sum(c[0] for m, c in counts.items() if m & bit and m & before), counts.get(bit, (0,))[0], *gone[1:], f]
            before |= bit
    return sorted((*k, *v[:-1], shapley[v[-1]]) for k, v in rows.items())


@pytest.mark.parametrize("letters", ["A", "AB", "ABCD", "ABCDE"])
def test_diagrams_count_every_order(letters):
    rng = random.Random(len(letters))
    for share in (0.0, 0.3, 1.0):
        counts = {m: (n := rng.randint(0, 6), n // 2, n // 3) for m in range(1 << len(letters)) if rng.random() < share}
        assert sorted(filter_audit.audit(counts, letters)) == audit_by_hand(counts, letters)


def test_a_swap_leaves_the_function():
    rng = random.Random(1)
    counts = {m: (rng.randint(0, 3),) for m in range(16)}
    diagram = filter_audit.Diagram(counts, 4)

    def at(mask):
        node = diagram.root
        while diagram.nodes[node] is not None:
            variable, passing, failing = diagram.nodes[node]
            node = failing if mask >> variable & 1 else passing
        return diagram.total[node]

    for level in (0, 2, 1, 1, 0, 2):
        diagram.swap(level)
        assert {m: at(m) for m in range(16)} == counts
    assert len(diagram.nodes) < 16 * 8


def test_audit_of_odd_rows(spark, tmp_path):
    """Copies, repeated rows, null ids, null sources and labels that disagree, against counts by hand."""
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, long, "a"), (2, long, "a"), (2, long, "a"), (2, long, None), (3, None, "a"), (4, "", "b"), (5, " \n", "b"), (6, "AB " * 300, None),
            (7, "x # y", "b"), (None, long, "a"), (None, None, ""), (8, "AB " * 300, ""), (1, "other", "c"), (9, long + " Z", "c")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (8, None, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, mask int, good int, k1 int").repartition(3)
    named = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    counts = {}
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        first = min((j for j, u, _ in rows if (u or "") == t and j is not None), default=None)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
                 i is not None and i > first)
        mask = sum(1 << k for k, f in enumerate(fails) if f)
        good = any(j == i and q == 1 for j, q, _ in labels) if i is not None else False
        toxic = any(j == i and x == 1 for j, _, x in labels) if i is not None else False
        of = counts.setdefault(source or "", {})
        of[mask] = tuple(a + b for a, b in zip(of.get(mask, (0, 0, 0)), (1, good, toxic), strict=True))
    got = [tuple(r) for r in filter_audit.op13_filter_audit(docs, named).collect()]
    assert sorted(got) == sorted((p, *r) for p, c in counts.items() for r in audit_by_hand(c, "ABCDE"))
    assert filter_audit.op13_filter_audit(docs.limit(0), named).collect() == []
