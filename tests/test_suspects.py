"""The one scan for suspect texts finds what the patterns find, seeking first letters only."""

import itertools

from pyspark.sql import functions as F

from pactlens.functions import language as L


def test_suspect_texts_are_those_that_a_pattern_matches(evaluate):
    assert L._SUSPECT.startswith(L._FLAGS + "(?=[ywom])")
    phrases = ["you should", "You Should not", "you should consider", "we recommend", "we strongly recommend that you", "we strongly advise",
               "we advise you to ", "we advise", "our advice is", "MY ADVICE IS", "you need to renegotiate", "make sure you", "make sure that you",
               "you must sign", "you must walk away", "you must wait", "you ſhould", "maKe sure you", "make sure", "we recommended", "your", ""]
    texts = [a + p + b for a, p, b in itertools.product(["", "x", "é", "so ", "_", "1", "(", "we "], phrases, ["", "s", " x", ".", "é", "\n"])]
    rules = [p for p, _ in L.REWRITES] + list(L.FLAGGED)
    want = evaluate(texts, lambda x: F.array_compact(F.array(*[F.when(x.rlike(L._FLAGS + p), F.lit(p)) for p in rules])))
    assert evaluate(texts, lambda x: x.rlike(L._SUSPECT)) == [bool(w) for w in want]
    assert evaluate(texts, L.violations) == want
    assert 0 < sum(map(bool, want)) < len(texts)
