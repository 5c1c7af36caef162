"""What individuals, answers and scores share: a batch is scored together, and nothing large is rendered or written that nobody reads."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semspark.functions import text as X
from semspark.operators import embedding as E
from semspark.operators import movement as M
from semspark.operators import rows as W
from semspark.plans import fixtures as FX
from semspark.plans import queries as Q
from semspark.sources import catalogue, sinks

SF = "/root/testdata/sf0.001"


def test_a_batch_of_answers_is_parsed_together():
    raw = pa.array(["1) <a b>\n\n- \"c d\"\nCandidate 3: e", None, "", "```text\nf g\n```", "x\r\ny\nz"])
    found, row, ordinal = W.parse(raw, 2)
    assert list(zip(row.tolist(), ordinal.tolist(), found.to_pylist())) == [(0, 1, "a b"), (0, 2, "c d"), (3, 1, "f g"), (4, 1, "x"), (4, 2, "y")]
    assert [len(x) for x in W.parse(pa.array([None, ""], pa.string()), None)] == [0, 0, 0]


def test_numbers_of_a_batch_are_rounded_half_up():
    assert W._at(np.array([0.5000000005, 0.1, np.nan, 0.5000000005]), 9).tolist()[:2] == [0.500000001, 0.1]


@pytest.mark.parametrize("text", ["a\x1cb c", "a\x85b", "a﻿b", " a b　", "", "a\x1fb c"])
def test_tokens_are_words(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(X.words(F.col("t")).alias("w")).first()
    assert E.tokens(text) == row.w


@pytest.mark.parametrize("template", [*catalogue.TEMPLATES.values(), "a {x} {{x}} {y} {z", ' NAME = """ {x} """ ', ""])
def test_a_fixed_template_renders_as_any_other(spark, template):
    rows = spark.createDataFrame([("{y}", "1"), ("$1\\", "")], "x string, y string")
    names = {"x": F.col("x"), "y": F.col("y"), "num_candidates": F.lit("9"), "component_name": F.col("x"), "current_component": F.col("y")}
    general = X.render_template(F.lit(template), F.create_map(*(p for k, v in names.items() for p in (F.lit(k), v))))
    got = rows.select(X.render_fixed(template, names).alias("a"), general.alias("b")).collect()
    assert all(r.a == r.b for r in got)


@pytest.mark.parametrize("run", [lambda spark: Q._scored_moves(spark, SF, "turbulence"), lambda spark: M.staged_apply(Q._people(spark, SF), "turbulence", FX.responder, 9)])
def test_prompts_are_not_kept_with_their_answers(spark, monkeypatch, run):
    kept = {}

    def stored(df, name, real=sinks.stored):
        kept.setdefault(name, df.columns)
        return real(df, name)

    monkeypatch.setattr(sinks, "stored", stored)
    monkeypatch.setattr(M, "stored", stored)
    run(spark)
    assert "raw" in kept["answers"] and "prompt" not in kept["answers"]


def test_a_passage_of_fewer_words_leads_no_language(spark, tmp_path):
    docs = [(1, "a b c d e f g h i j k l m n", "es"), (2, " ".join("abcdefghijklmno"), "es"), (3, None, "es"), (4, "", "es")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(1, 5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in FX.individuals(spark, str(tmp_path)).collect()}
    assert {r.lider.accion for r in rows.values()} == {"k l m n o"}
    assert (rows[1].accion, rows[3].accion, rows[4].accion) == ("k l m n", None, "")
