"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.operators import embedding as E
from semspark.operators import ranking as R
from semspark.sources.sinks import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector 2k beside 2k + 1: both halves come to one key, so that the table is read once and no join is needed."""
    rows = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 2)).alias("pair_id"), (F.col("vec_id") % 2).alias("side"), "embedding")
    both = rows.groupBy("pair_id").agg(F.max_by("embedding", F.when(F.col("side") == 0, 1)).alias("a"), F.max_by("embedding", F.when(F.col("side") == 1, 1)).alias("b"))
    return both.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn is one completion."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return turns.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("run_number"), F.col("text").alias("raw"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the one of the next id; every seventh beside a blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("following"))
    beside = F.when(F.col("doc_id") % 7 == 0, " \t").otherwise(F.col("following"))
    return docs.join(following, "doc_id", "left").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("text_a"), beside.alias("text_b"))


PASSAGE = 15


_PARTS = "array<struct<rol:string,topico:string,accion:string>>"


def _split(texts: pa.Array) -> pa.Array:
    """Of each text its passages; a text without words has one of empty strings, a null one of nulls."""
    slots, ends = [], [0]
    for text in E.strings(texts):
        if text is None:
            slots += (None, None, None)
        else:
            w = E.tokens(text)
            slots += [" ".join(w[j : j + 5]) for j in range(0, PASSAGE * max(1, -(-len(w) // PASSAGE)), 5)]
        ends.append(len(slots) // 3)
    values = pa.StructArray.from_arrays([pa.array(slots[k::3], pa.string()) for k in range(3)], ["rol", "topico", "accion"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, count, parts, first): every fifteen words of every whole text as role, topic and action, in an array; the short rest of a text too.

    ``first`` is the first passage, where it is a whole one.  Written once: texts are
    split once, whoever reads the passages, and in a loop in the task, as array functions
    spend their time on each word.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    rows = docs.select("doc_id", "lang", F.arrow_udf(_split, _PARTS)(F.make_valid_utf8("text")).alias("parts"))
    head = F.get("parts", F.lit(0))
    whole = F.size(F.split(head["accion"], " ")) == 5  # its last word is there
    return stored(rows.select("doc_id", "lang", F.size("parts").alias("count"), "parts", F.when(whole, head).alias("first")), "passages")


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage as an individual; the same part of the next document is its best, the first passage of the language's first good document its leader.

    ``position`` numbers them all, by document and part.  Documents meet, not passages.
    """
    docs = passages(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    leaders = docs.where(F.col("first").isNotNull()).select("doc_id", "lang", "first").join(good, "doc_id", "left_semi").groupBy("lang").agg(F.min_by("first", "doc_id").alias("lider"))
    counts = docs.groupBy("doc_id").agg(F.sum("count").alias("count"))
    before = R.carried(counts.withColumn("upto", F.col("count")), (), "doc_id", {"upto": "sum"}).select("doc_id", (F.col("upto") - F.col("count")).alias("before"))
    best = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("parts").alias("bests"))
    rows = docs.select("doc_id", "lang", "parts").join(before, "doc_id").join(best, "doc_id", "left")
    rows = rows.join(F.broadcast(leaders), "lang", "left")  # one row a language, by which no passage is to be dealt out
    rows = rows.select("doc_id", "before", "lider", "bests", F.posexplode("parts").alias("part", "own"))
    name = F.concat_ws("-", F.lit("ind"), F.col("doc_id").cast("string"), F.col("part").cast("string"))
    return rows.select((F.col("before") + F.col("part")).alias("position"), name.alias("id"), "own.*", F.get("bests", "part").alias("pbest"), "lider", "doc_id", "part")


def _wrapped(lines: list[str | None], place: int) -> str:
    """Lines as an answer would bear them: numbered, quoted or named in turn; every fifth answer fenced, every tenth empty."""
    if place % 10 == 9:
        return ""
    forms = (lambda j, line: f"{j}) <{line}>", lambda j, line: f'- "{line}"', lambda j, line: f"Candidate {j}: {line}")
    text = "\n".join(forms[(j - 1) % 3](j, line) for j, line in enumerate(lines, 1) if line is not None)
    return f"```text\n{text}\n```" if place % 5 == 0 else text


def _upper(text: str) -> str:
    """With the letters of ASCII in upper case, and no others."""
    return text.encode().upper().decode()


def _mixed(some: list[str], n: int, current: list[str]) -> str:
    """The first ``n`` of one list's words, and the second list's from there to the fifth; what is not there is left out."""
    return " ".join(some[:n] + current[n:5])


def influence_lines(c: list[str], t: list[str], place: int) -> list[str | None]:
    """Answers to an influence, of the words of current (``c``) and target (``t``)."""
    first = _mixed(t, 1, c)
    lines = [first, _mixed(t, 2, c), _mixed(t, 4, c), " ".join(t[::-1]), " ".join(c[::-1]), _upper(" ".join(c)), " ".join(t), t[0] if t else None]
    return [*lines, _upper(first) if place % 2 == 0 else None]


def turbulence_lines(c: list[str], o: list[str], place: int) -> list[str | None]:
    """Answers to a turbulence, of the words of current (``c``) and of the component that follows (``o``)."""
    first = _mixed(o, 1, c)
    lines = [first, _mixed(o, 2, c), _mixed(o, 3, c), " ".join(c[::-1]), _upper(" ".join(c)), c[0] if c else None]
    return [*lines, _upper(first) if place % 2 == 0 else None]


def _answered(operator: pa.Array, current: pa.Array, other: pa.Array, place: pa.Array) -> pa.Array:
    """Each movement's answer; null for one call in seventeen."""
    out = []
    operators, currents, others = (E.strings(x) for x in (operator, current, other))
    for op, c, o, k in zip(operators, currents, others, place.to_numpy().tolist()):
        lines = influence_lines if op == "influence" else turbulence_lines
        out.append(None if k % 17 == 3 else _wrapped(lines(E.tokens(c or ""), E.tokens(o or ""), k), k))
    return pa.array(out, pa.string())


def responder(movements: DataFrame) -> DataFrame:
    """Answers made of the words at hand: those of current and target, or of the component that follows in turn; one call in seventeen fails."""
    following = F.when(F.col("component_key") == "rol", F.col("topico")).when(F.col("component_key") == "topico", F.col("accion")).otherwise(F.col("rol"))
    other = F.when(F.col("operator") == "influence", F.col("target")).otherwise(following)
    raw = F.arrow_udf(_answered, "string")("operator", F.make_valid_utf8("current"), F.make_valid_utf8(other), "position")
    return movements.withColumns({"raw": raw, "error": F.when(F.col("position") % 17 == 3, "timeout")})


def _two_answers(current: pa.Array, target: pa.Array) -> pa.Array:
    """Of each job the eight lines of an influence, in two answers of four."""
    currents, targets = ([t or "" for t in E.strings(x)] for x in (current, target))
    split = E.splitter([*currents, *targets])
    said = []
    for c, t in zip(currents, targets):
        lines = influence_lines(split(c), split(t), 1)
        said += ("\n".join(lines[:4]), "\n".join([x for x in lines[4:8] if x is not None]))  # of the first eight only the last may be missing
    return pa.ListArray.from_arrays(pa.array(range(0, len(said) + 1, 2), pa.int32()), pa.array(said, pa.string()))


def eval_jobs(people: DataFrame) -> DataFrame:
    """Jobs (job_id, current, target): each individual moves its role to its best's."""
    return people.select(F.col("position").alias("job_id"), F.col("rol").alias("current"), F.col("pbest.rol").alias("target"))


def eval_said(jobs: DataFrame) -> DataFrame:
    """Jobs with the two answers that their runs get."""
    return jobs.withColumn("said", F.arrow_udf(_two_answers, "array<string>")(F.make_valid_utf8("current"), F.make_valid_utf8("target")))


RUNS = 4


def _runs(number: int) -> list[Column]:
    """The columns of the job's run of this number: the first two have four lines each, the third is empty and the fourth timed out."""
    raw = F.get("said", F.lit(number - 1)) if number < 3 else F.lit("" if number == 3 else None).cast("string")
    return [F.lit(number).alias("run_number"), raw.alias("raw"), F.lit("timeout" if number == 4 else None).cast("string").alias("error")]


def eval_run(said: DataFrame, number: int) -> DataFrame:
    """One run of each job (see ``eval_said``), of those that ``eval_runs`` gives."""
    return said.select(*(c for c in said.columns if c != "said"), *_runs(number))


def eval_runs(jobs: DataFrame) -> DataFrame:
    """The runs of each job: two of four lines, one empty and one that timed out.  They are made in the job's row and bear its columns, so that they need not meet it again."""
    return eval_said(jobs).select(*jobs.columns, F.inline(F.array(*(F.struct(*_runs(k)) for k in range(1, RUNS + 1)))))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: their value as the time, errors as failed calls, users as jobs."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("elapsed_ms"), F.when(F.col("event_type") == "error", "timeout").alias("error"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs wrapped in both JSON dialects, with text or list content; one in ten is an error."""
    r = runs(spark, sf_dir).withColumn("kind", F.pmod(F.col("job_id") * 3 + F.col("run_number"), F.lit(4)))
    raw = F.col("raw")
    none = F.lit(None).cast("string")
    parts = F.array(F.struct(F.lit("output_text").alias("type"), raw.alias("text")), F.struct(F.lit("output_text").alias("type"), F.lit("end").alias("text")))
    forms = [
        F.to_json(F.struct(raw.alias("output_text"))),
        F.to_json(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit("no").alias("content")), F.struct(F.lit("message").alias("type"), raw.alias("content"))).alias("output"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(raw.alias("content")).alias("message"))).alias("choices"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("content")).alias("message"))).alias("choices"))),
    ]
    payload = F.when(F.col("kind") == 0, forms[0]).when(F.col("kind") == 1, forms[1]).when(F.col("kind") == 2, forms[2]).otherwise(forms[3])
    bad = F.pmod(F.col("job_id") + F.col("run_number"), F.lit(10)) == 0
    said = F.when(F.col("run_number") % 4 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("refused "), F.col("job_id").cast("string")).alias("message")).alias("error")))).otherwise(F.lit("{}"))
    return r.select("job_id", "run_number", "raw", F.when(F.col("kind") < 2, "native").otherwise("chat").alias("dialect"), F.when(bad, said).otherwise(payload).alias("payload"), F.when(bad, 500).otherwise(200).alias("status"), (bad & (F.col("run_number") % 6 == 0)).alias("timed_out"), none.alias("model"))
