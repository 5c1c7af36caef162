"""Completion requests and provider payloads, in two JSON dialects, and completions in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.functions import text as X

COMPLETIONS = "job_id long, run_number long, raw string, elapsed_ms double, error string"


def request_body(dialect: Column, prompt: Column, model: Column, temperature: Column, top_p: Column, max_tokens: Column) -> Column:
    """JSON of one request; requests share no history."""
    native = F.struct(model.alias("model"), prompt.alias("input"), temperature.alias("temperature"), top_p.alias("top_p"), max_tokens.alias("max_output_tokens"), F.lit(False).alias("stream"), F.lit(False).alias("store"))
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    chat = F.struct(model.alias("model"), message.alias("messages"), temperature.alias("temperature"), top_p.alias("top_p"), max_tokens.alias("max_tokens"), F.lit(False).alias("stream"))
    return F.when(dialect == "native", F.to_json(native)).otherwise(F.to_json(chat))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _items(v: Column) -> Column:
    """Elements of a variant array; none where it is no array."""
    return F.when(_is(v, "ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))


def content_text(v: Column) -> Column:
    """Text of a content field: a string as it is; of an array its strings, or their text or content fields, by line."""

    def part(item: Column) -> Column:
        field = lambda name: F.nullif(_text(F.try_variant_get(item, f"$.{name}", "variant")), F.lit(""))
        inner = F.when(_is(item, "OBJECT"), F.coalesce(field("text"), field("content")))
        return F.coalesce(_text(item), inner, F.lit(""))

    return F.coalesce(_text(v), F.array_join(F.filter(F.transform(_items(v), part), lambda t: t != ""), "\n"))


def completion_text(dialect: Column, payload: Column) -> Column:
    """Text of a provider's JSON payload; empty where it has none."""
    v = F.try_parse_json(payload)
    get = lambda path: F.try_variant_get(v, path, "variant")
    message = lambda item: _text(F.try_variant_get(item, "$.type", "variant")) == "message"
    kept = F.filter(_items(get("$.output")), lambda item: F.when(_is(item, "OBJECT"), message(item)).otherwise(F.lit(False)))
    texts = F.filter(F.transform(kept, lambda item: content_text(F.try_variant_get(item, "$.content", "variant"))), lambda t: t != "")
    native = F.coalesce(_text(get("$.output_text")), F.array_join(texts, "\n"))
    chat = content_text(get("$.choices[0].message.content"))
    return X.js_trim(F.coalesce(F.when(dialect == "native", native).otherwise(chat), F.lit("")))


def completion_error(status: Column, payload: Column, timed_out: Column) -> Column:
    """Null for a good answer; ``timeout``, the payload's message, or the status otherwise."""
    said = F.nullif(F.try_variant_get(F.try_parse_json(payload), "$.error.message", "string"), F.lit(""))
    return F.when(timed_out, "timeout").when(status.between(200, 299), None).otherwise(F.coalesce(said, F.concat(F.lit("HTTP "), status.cast("string"))))


def completions_batch(prompts: DataFrame, responder: Callable[[str], str], path: str, shard_prompts: int = 512) -> DataFrame:
    """One completion for each prompt (job_id, run_number, prompt), kept at ``path`` and read back from there.

    ``path`` is a store of answers.  Prompts that it answers are not asked again; the rest
    is dealt into shards of about ``shard_prompts``, a task each, and a shard's answers
    are committed when its task is, whatever becomes of the job (the committer's second
    algorithm: one file a task, moved into place by a rename).  So a task that dies asks
    its own shard again and no other, and after a failed job the same call goes on where it
    stopped.  A prompt that fails gives a row with its error, and counts as answered.
    Prompts of one job and run are one request; of several texts any one is asked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            rows = []
            for job, number, prompt in zip(pdf["job_id"], pdf["run_number"], pdf["prompt"]):
                began = time.perf_counter()
                try:
                    raw, error = responder(prompt), None
                except TimeoutError:
                    raw, error = None, "timeout"
                except Exception as e:  # the answer of a prompt, not of the job
                    raw, error = None, str(e)
                rows.append((job, number, raw, 1000 * (time.perf_counter() - began), error))
            yield pd.DataFrame(rows, columns=["job_id", "run_number", "raw", "elapsed_ms", "error"])

    spark, keys = prompts.sparkSession, ["job_id", "run_number"]
    spark.createDataFrame([], COMPLETIONS).write.mode("ignore").parquet(path)
    left = prompts.select(*keys, "prompt").join(spark.read.schema(COMPLETIONS).parquet(path).select(*keys), keys, "left_anti").dropDuplicates(keys)
    n = left.count()
    if n:
        # a fixed number of partitions is not merged at run time, so that a task is a shard
        shards = left.repartition(-(-n // shard_prompts), *keys)
        shards.mapInPandas(run, COMPLETIONS).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return spark.read.schema(COMPLETIONS).parquet(path)
