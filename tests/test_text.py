import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkprep.functions import text as TX

PY = re.compile(TX.NUMERAL_PATTERN)

# Hand goldens: (text, numerals found left to right)
NUMERAL_CASES = [
    ("1,234.5", ["1,234", "5"]),
    ("1.2.3", ["1.2", "3"]),
    ("12:30", ["12", "30"]),
    ("1,2345", ["1,234", "5"]),
    ("3.", ["3"]),
    ("a1b22", ["1", "22"]),
    ("up 1,000,000 now", ["1,000,000"]),
    ("ratio 3/4", ["3/4"]),
    ("none here", []),
    ("007", ["007"]),
    ("12,34", ["12", "34"]),
    ("", []),
]


def _one(spark, col_expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(col_expr(F.col("v"))).collect()]


def test_numeral_goldens(spark):
    got = _one(spark, TX.numerals, [t for t, _ in NUMERAL_CASES])
    assert got == [want for _, want in NUMERAL_CASES]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="0123456789,./: ab", max_size=20), min_size=1, max_size=20))
def test_numerals_match_python(spark, texts):
    got = _one(spark, TX.numerals, texts)
    assert got == [PY.findall(t) for t in texts]


def test_non_ascii_digits_follow_python(spark):
    texts = ["١٢ and 3", "１２"]
    assert _one(spark, TX.numerals, texts) == [PY.findall(t) for t in texts]


def test_full_strip_all_29_whitespace(spark):
    assert len(TX.WS29) == 29
    cases = [f"{c}x y{c}" for c in TX.WS29] + [TX.WS29 + "a" + TX.WS29, "", TX.WS29]
    assert _one(spark, TX.full_strip, cases) == [c.strip() for c in cases]


def test_strip_quotes_whitespace_then_quotes(spark):
    cases = ['  "quoted"  ', '"" a ""', ' " inner space " ', '\t"x"\n']
    assert _one(spark, TX.strip_quotes, cases) == [c.strip().strip('"') for c in cases]


def test_to_text_null_is_None(spark):
    assert _one(spark, TX.to_text, [None, "a", ""]) == ["None", "a", ""]


def test_flatten_newlines_keeps_cr(spark):
    assert _one(spark, TX.flatten_newlines, ["a\nb\r\nc"]) == ["a b\r c"]


def test_strip_prompt_by_length(spark):
    df = spark.createDataFrame([("PROMPT", "PROMPT  out \n"), ("abc", "xyzdef ")], "p string, g string")
    got = [r[0] for r in df.select(TX.strip_prompt("g", "p")).collect()]
    assert got == ["out", "def"]
