import math
import time

import pytest
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.functions import vectors as V
from semspark.operators import jobs as J
from semspark.operators import labels as L
from semspark.operators import ranking as R
from semspark.sources import payloads as P

NASTY = [
    ("1) <role x>", "role x"), ('  2. "hi there" ', "hi there"), ("- candidate 3: 'foo'", "foo"), ('"1) foo"', "1) foo"), ("10] - bar", "- bar"), ("candidate 2", "candidate 2"),
    ("<<a>>", "<a>"), ("12 monkeys", "12 monkeys"), ("3)4) x", "4) x"), (" * y ", "y"), ("* ", ""),
]


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_normalize_candidate(spark):
    rows = spark.createDataFrame(NASTY, "line string, want string").select("want", X.normalize_candidate(F.col("line")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_parse_candidates_cuts_after_dropping_blanks(spark):
    raw = "```text\n1) a b\r\n\n- c d\n* \nCandidate 3: e f\n```"
    assert one(spark, raw=raw).select(X.parse_candidates(F.col("raw"), 2).alias("c")).first().c == ["a b", "c d"]


def test_template_is_rendered_in_one_pass(spark):
    t = 'NAME = """ {a} {b} {missing} { {a}$1 """'
    out = one(spark, t=t).select(X.render_template(F.col("t"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("x$1"))).alias("p")).first().p
    assert out == "{b} x$1 {missing} { {b}$1"


def test_words_and_trim(spark):
    r = one(spark, t="﻿  a  b\t\n").select(X.word_count(F.col("t")).alias("n"), X.js_trim(F.col("t")).alias("t")).first()
    assert (r.n, r.t) == (2, "a  b")


def test_movement_id_is_padded_not_cut(spark):
    rows = spark.createDataFrame([(7,), (12345,)], "n long").select(X.movement_id(F.col("n")).alias("i")).collect()
    assert [r.i for r in rows] == ["mov-0007", "mov-12345"]


def test_vectors(spark):
    df = one(spark, a=[3.0, 4.0], b=[4.0, 3.0], z=[0.0, 0.0], s=[1.0])
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z"), strict=False).alias("z")).first()
    assert r.d == 24 and r.n == 5 and math.isclose(r.c, 0.96) and r.z is None
    for bad in (V.cosine(F.col("a"), F.col("z")), V.dot(F.col("a"), F.col("s"))):
        with pytest.raises(Exception, match="zero vector|differ"):
            df.select(bad).collect()


def test_labels_take_the_first_rule(spark):
    rows = spark.createDataFrame([("a", 1), ("Cur rent", 2), ("tar get", 2), ("x y", 2), ("x z", 1)], "c string, n int")
    got = rows.select(L.reason_base(F.col("c"), F.col("n"), F.lit("cur rent"), F.lit("TAR get")).alias("r")).collect()
    assert [r.r for r in got] == ["invalid_length", "literal_copy_current", "literal_copy_target", "duplicate_output", "valid"]


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.94, 0.1), (0.5, 0.0), (0.5, 0.1)], "s double, g double")
    assert [r.r for r in rows.select(L.reason_influence(F.lit("valid"), F.col("s"), F.col("g")).alias("r")).collect()] == ["semantic_copy_target", "insufficient_semantic_progress", "valid"]
    rows = spark.createDataFrame([(0.54,), (0.55,), (0.9,), (0.91,)], "s double")
    assert [r.r for r in rows.select(L.reason_turbulence(F.lit("valid"), F.col("s")).alias("r")).collect()] == ["too_distant_from_current", "valid", "valid", "too_close_to_current"]


def test_numbering_has_no_gaps_over_buckets(spark):
    rows = spark.range(1000).select((F.col("id") * 3).alias("position"), (F.col("id") % 2).alias("k"))
    got = sorted((r.position, r.number) for r in R.numbered(rows, "position", "k", bucket=64).collect())
    assert [n for _, n in got] == list(range(1, 1001))


def test_ties_go_to_the_earliest(spark):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5), (1, 3, 0.4)], "run int, ordinal int, similarity double")
    assert R.best_per(rows, "run").first().ordinal == 1


def test_clamp(spark):
    rows = spark.createDataFrame([("",), ("x",), ("1e3",), (" 4.9 ",), ("-1",), ("NaN",), (None,)], "r string").select(J.clamp_number(F.col("r"), 1, 20, True).alias("v")).collect()
    assert [r.v for r in rows] == [None, None, 20.0, 4.0, 1.0, None, None]


@pytest.mark.parametrize(
    ("dialect", "payload", "want"),
    [
        ("native", '{"output_text": " hi "}', "hi"),
        ("native", '{"output": [{"type": "reasoning", "content": "no"}, {"type": "message", "content": [{"text": "a"}, "b", {"content": "c"}, {}]}]}', "a\nb\nc"),
        ("chat", '{"choices": [{"message": {"content": ["x", {"text": ""}]}}]}', "x"),
        ("chat", '{"choices": []}', ""),
        ("chat", "not json", ""),
        ("native", '{"output": "text"}', ""),
    ],
)
def test_completion_text(spark, dialect, payload, want):
    assert one(spark, d=dialect, p=payload).select(P.completion_text(F.col("d"), F.col("p")).alias("t")).first().t == want


@pytest.mark.parametrize("text", [" a" + " " * 300_000 + "b ", "candidate" + " " * 300_000 + "b", "'" * 300_000 + "b" + '"' * 300_000 + "c", "9" * 300_000, 'p = """' + '"""   ' * 60_000 + " x"])
def test_text_functions_take_time_in_proportion(spark, text):
    rows = one(spark, t=text)
    for f in (X.js_trim, X.word_count, X.template_body, X.normalize_candidate, X.strip_fences):
        began = time.time()
        rows.select(f(F.col("t")).alias("r")).collect()
        assert time.time() - began < 15, f
