import unicodedata

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T

CASES = [
    "plain text", "  two  blanks\tand tab  ", "a\r\nb\rc", "\n\n \n first\n\nlast \n\t\n", "    code   kept  \n\ttab  code\n prose  x ", "Cafe\u0301 and \u00c9", "```\n  a   b \n```\n  c   d", "~~~\n x\n```\n  y  y",
    "\u00a0nbsp\u3000", "x\x1c\x1dy\x1f", "", "   ", "\u1e9b\u0323 fi \ufb01", "İstanbul ẞ straße", "a\n    \nb", "🙂  two",
]


def values(spark, f, cases=None):
    rows = [(i, c) for i, c in enumerate(CASES if cases is None else cases)]
    df = spark.createDataFrame(rows, "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_normalization_paths_agree(spark):
    assert values(spark, T.normalize) == [T.normalize_text(c) for c in CASES]
    assert T.normalize_text("a\r\nb ") == T.normalize_text("a\nb") == "a\nb"
    assert T.normalize_text("e\u0301") == "é"
    assert T.normalize_text("    keep  this") == "    keep  this"


def test_null_stays_null(spark):
    assert values(spark, T.normalize, [None]) == [None] and values(spark, T.folded, [None]) == [None]


def test_folding(spark):
    assert values(spark, T.folded) == [unicodedata.normalize("NFKC", c).casefold() for c in CASES]


def test_tokens(spark):
    cases = ["Classes, stories & bus-stops: glass status", "éa x.y/z_1 v1.2-", "Flies ties", ""]
    assert values(spark, T.overlap_tokens, cases) == [["classe", "story", "bus-stop", "glass", "status"], ["a", "x.y/z_1", "v1.2"], ["fly", "ties"], []]


def test_json_strings(spark):
    import json

    cases = [*CASES, 'q"uo\\te', "\b\f\x01\x1f/\u2028\x7f"]
    assert values(spark, T.json_string, cases) == [json.dumps(c, ensure_ascii=False) for c in cases]
    (row,) = spark.range(1).select(T.json_object(b=T.json_string(F.lit("x")), a=F.lit("1")).alias("v")).collect()
    assert row.v == '{"a":1,"b":"x"}'


@pytest.mark.parametrize("raw, want", [("a/b", "a/b"), ("a\\.\\b//c", "a/b/c"), ("/a", None), ("C:\\a", None), ("a/../b", None), ("", None), ("./", None)])
def test_logical_names(spark, raw, want):
    assert values(spark, T.logical_name, [raw]) == [want]


@pytest.mark.parametrize("raw, want", [(" hi <|end|> x", "hi"), ("ok Check 1. Command note", "ok"), ("ok Check 12 Reinforcement 3.", "ok"), ("Check 1", "Check 1"), ("Checked 1", "Checked 1"), ("<|user|>a", "")])
def test_clean_responses(spark, raw, want):
    assert values(spark, T.clean_response, [raw]) == [want]


def test_degenerate_and_counts(spark):
    assert values(spark, T.is_degenerate, ["", " .!?", "\u2003", "a", "\u00bf"]) == [True, True, True, False, False]
    assert values(spark, T.word_count, ["a  b\u3000c", "", None]) == [3, 0, 0]
    assert values(spark, lambda c: T.phrase_count(c, "aa"), ["AAAAA", "b"]) == [2, 0]
    assert values(spark, T.opening, ["Don't STOP, now 1 2 3 4 5 6 7"]) == ["don't stop now 1 2 3 4 5"]
