"""N-grams grow by a word at a time, and texts of one line are cleaned without the rules for lines."""

from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.ml import features as X


def test_ngrams_of_all_sizes(spark, evaluate):
    texts = ["", "a", "a b", "a b c", "a b c a b c", "é ü 😀 x"]
    rows = [t.split() for t in texts]
    for sizes in ((1, 2, 3), (2,), (3, 1), (1,), (2, 4)):
        want = [[" ".join(w[i:i + n]) for n in sizes for i in range(len(w) - n + 1)] for w in rows]
        assert evaluate([*rows, None], lambda x, s=sizes: X.ngrams(x, s), "array<string>") == [*want, []]
    plan = spark.range(1).select(X.ngrams(F.array(F.lit("a"))))._jdf.queryExecution().analyzed().toString()
    assert "concat_ws" not in plan  # which puts every n-gram together word by word


def test_texts_of_one_line_are_cleaned_alike(evaluate):
    lines = ["Confidential", " draft ", "DRAFT 2", "exhibit A1", "Exhibit", "page 12", "page x", "3 / 14", "3/14 of it", "plain text-", "  spaced  ",
             "co- operation", "", " ", "page\r7", " draft", "12", "word\t", "page ٣"]

    def whole(col):
        text = F.regexp_replace(col, rf"({T.WORD_CHAR}+)-{T.WS}*\n{T.WS}*({T.WORD_CHAR}+)", "$1$2")
        text = F.regexp_replace(text, rf"(?iu)\n{T.WS}*(?:page{T.WS}*)?\d{{1,4}}{T.WS}*(?:of{T.WS}*\d{{1,4}})?{T.WS}*\n", "\n")
        text = F.regexp_replace(text, rf"(?mdiu)^{T.WS}*(?:confidential|draft|exhibit{T.WS}+[a-z0-9]+|page{T.WS}+\d+|\d+{T.WS}*/{T.WS}*\d+){T.WS}*$", "")
        return T.strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))

    texts = [*lines, *[a + "\n" + b for a in lines for b in lines], None]
    assert evaluate(texts, T.clean_page_artifacts) == evaluate(texts, whole)
