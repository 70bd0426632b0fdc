"""Expected values of the text, language, readability and scoring expressions."""

import itertools

import pytest
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions import language as L
from pactlens.functions import readability as R
from pactlens.functions import scoring as S
from pactlens.functions import text as T
from pactlens.functions.numbers import round_exact


def test_segmentation_strategies(evaluate):
    texts = [
        "First paragraph about scope.\n\nSecond paragraph about fees.\n \nThird paragraph here.",
        "1. SCOPE. The Contractor builds.\n2. FEES. The Client pays.\nARTICLE IV Term of one year.",
        "One flowing paragraph with no headings and no gaps.",
        "IV\n\n1. PAYMENT. The Client shall pay the fee.\n\n2. TERM. One year for now.",
        "A long enough closing clause.\n\nshort",
        "aa\n\nbb",
        "  \n ",
        "",
    ]
    assert evaluate(texts, T.segment_text) == [
        ["First paragraph about scope.", "Second paragraph about fees.", "Third paragraph here."],
        ["1. SCOPE. The Contractor builds.", "2. FEES. The Client pays.", "ARTICLE IV Term of one year."],
        ["One flowing paragraph with no headings and no gaps."],
        ["IV\n1. PAYMENT. The Client shall pay the fee.", "2. TERM. One year for now."],
        ["A long enough closing clause.\nshort"],
        ["aa\nbb"],
        [],
        [],
    ]


def test_segments_keep_the_text(evaluate):
    texts = ["a b\n\nc", "1. Alpha beta\n2. Gamma delta", "plain", ""]
    assert all(v >= 0.95 for v in evaluate(texts, lambda x: T.coverage_ratio(x, T.segment_text(x))))


def test_whitespace_is_unicode(evaluate):
    assert evaluate(["  a \n b　"], T.normalise_whitespace) == ["a b"]
    assert evaluate([" x\x1c"], T.strip) == ["x"]


@pytest.mark.parametrize("word,count", [
    ("the", 1), ("clause", 1), ("agreement", 3), ("indemnification", 6), ("payment", 2), ("terminate", 3),
    ("contractor", 3), ("quality", 3), ("nation", 2), ("table", 2), ("called", 1), ("wanted", 2), ("likely", 2),
    ("12,000", 1), ("60-day", 1), ("", 0), ("...", 0), ("--", 0)])
def test_syllables(evaluate, word, count):
    assert evaluate([word], R.syllable_count) == [count]


def test_syllables_of_a_text_are_the_sum_of_its_words(evaluate):
    words = "The Client's likely settlement violated e.g. unique clauses été of 12,000 awareness".split()
    total = evaluate([" ".join(words)], R.syllable_count)[0]
    assert total == sum(evaluate(words, R.syllable_count))


def test_sentences(evaluate):
    texts = [
        "The fee is due on time, e.g. within 30 days. See No. 5 for the schedule.",
        "The rate is 12.5 percent of the total. It is fixed.",
        "The work is done by Acme Inc. and its affiliates are bound.",
        "The work is done by Acme Inc. The Client shall pay the fee.",
        "The Client may terminate… Notice is still required. The fee is due.",
        "The Contractor shall provide\nweb development services to the Client.",
        "First paragraph sentence\n\nSecond paragraph sentence",
        "Intro line\n- one\n- two. Three",
        "... !!! ---",
        "Ends with a.. Then more.",
    ]
    assert evaluate(texts, R.sentence_count) == [2, 2, 1, 2, 3, 1, 2, 4, 0, 2]
    assert [len(s) for s in evaluate(texts, R.split_sentences)] == [2, 2, 1, 2, 3, 1, 2, 4, 0, 2]


def test_words(evaluate):
    texts = ["Hello, world! Yes -- really?", "... !!! -- ;", "long-term", "e.g.", "The fee (USD 12,000) is due; net-60."]
    assert evaluate(texts, R.word_count) == [4, 0, 1, 1, 7]


def test_long_joined_token_does_not_overflow(evaluate):
    assert evaluate([",".join(["1"] * 60000)], R.word_count) == [1]


def test_grades(evaluate):
    assert evaluate(["", "--- ;", "We pay you fast. You do the work."], R.text_grade) == [None, None, 0.0]


def test_exact_rounding(evaluate):
    values = [2.675, 0.125, 0.375, 1.005, 34.785, 7.0, 0.0]
    assert evaluate(values, lambda x: round_exact(x, 2), "double") == [round(v, 2) for v in values]


def test_language_filter(evaluate):
    text = "You should consider X. You should not sign; we strongly recommend that you wait. You must sign."
    result = evaluate([text, "The clause requires you to deliver."], L.sanitize)
    assert result[0]["text"] == (
        "some freelancers consider X. freelancers commonly avoid agreeing to sign; a common practice is to wait. You must sign.")
    assert result[0]["rewrites"] == 3 and len(result[0]["residual_flags"]) == 1
    assert result[1]["rewrites"] == 0 and result[1]["residual_flags"] == []
    assert evaluate([text], lambda x: F.size(L.violations(x))) == [6]


def test_score_parsing(evaluate):
    raw = ["0.85", "1.0", "1", "high", "None", None, ".3 of 1", "12.75"]
    assert evaluate(raw, S.parse_score) == [0.85, 0.0, 1.0, 0.5, 0.5, 0.5, 0.3, 0.75]
    assert evaluate(raw[:2], lambda x: S.parse_score(x, strict=False)) == [0.85, 1.0]


def test_factor_parsing(evaluate):
    raw = ["a, b", "- x\n2. y\n\n* z", "None", " n/a ", "", None]
    assert evaluate(raw, S.parse_factors) == [["a", "b"], ["x", "y", "z"], [], [], [], []]


def test_first_keyword_rule_wins(evaluate):
    texts = ["Payment for intellectual property", "A fee after termination", "Liability and NDA", "Nothing here"]
    assert [c["clause_type"] for c in evaluate(texts, S.classify_keywords)] == [
        "ip_assignment", "payment_terms", "liability", "general"]


def test_hybrid_score_grid(spark):
    def expected(kind, conf, score, n):
        clamp = lambda v: max(0.0, min(1.0, v))
        prior = D.SEVERITY_PRIOR.get(kind, 0.30)
        return clamp(0.65 * clamp(score) + 0.15 * min(max(n, 0) / 4, 1.0) + 0.10 * (1.0 - clamp(conf)) + 0.10 * prior)

    grid = list(itertools.product(
        [*D.CLAUSE_TYPES, "unknown"], [-0.5, 0.0, 0.4, 1.0, 1.5], [-1.0, 0.0, 0.33, 0.7, 2.0], [-1, 0, 2, 4, 9]))
    rows = spark.createDataFrame(grid, "kind string, conf double, score double, n int")
    got = rows.withColumn("h", S.hybrid_score(F.col("kind"), F.col("conf"), F.col("score"), F.col("n"))).collect()
    assert all(r["h"] == expected(r["kind"], r["conf"], r["score"], r["n"]) and 0 <= r["h"] <= 1 for r in got)


def test_level_boundaries(evaluate):
    assert evaluate([0.34999, 0.35, 0.64999, 0.65], S.hybrid_level, "double") == ["low", "medium", "medium", "high"]
    assert evaluate([0.39, 0.4, 0.69, 0.7], S.model_level, "double") == ["low", "medium", "medium", "high"]


def test_anchor_kinds(evaluate):
    clauses = ("array(named_struct('id', 1, 'anchor_start', 'one', 'anchor_end', 'three'), "
               "named_struct('id', 2, 'anchor_start', 'two', 'anchor_end', ''), "
               "named_struct('id', 3, 'anchor_start', 'one', 'anchor_end', ''), "
               "named_struct('id', 4, 'anchor_start', 'zzz', 'anchor_end', ''), "
               "named_struct('id', 5, 'anchor_start', ' ', 'anchor_end', ''), "
               "named_struct('id', 6, 'anchor_start', 'five', 'anchor_end', 'nope'))")
    spans = evaluate(["one two three four two five"], lambda x: T.resolve_anchors(x, F.expr(clauses)))[0]
    assert [(s["start"], s["end"], s["start_problem"], s["end_problem"]) for s in spans] == [
        (0, 13, None, None), (19, None, None, None), (None, None, "earlier", None), (None, None, "absent", None),
        (None, None, "empty", None), (23, None, None, "absent")]


def test_missing_segment_is_reported(evaluate):
    found = evaluate(["one two three"], lambda x: T.locate_parts(x, F.array(F.lit("one  two"), F.lit("nine ten"))))
    assert found[0]["offsets"] == [0] and found[0]["missing"] == 1


def test_stop_words_keep_negations():
    words = T.legal_stop_words(["The", "not", "of"])
    assert "the" in words and "herein" in words and "not" not in words
