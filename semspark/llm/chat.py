r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, turn after turn with nothing between:

    user        [INST] text [/INST]
    assistant   <s> text </s>
    other       [ROLE:role] text [/ROLE]      (the role URL-encoded)

The grammar is regular and its parser deterministic: from the left, each opening
mark is closed by the first closing mark of its kind.  A text is first rendered
as it is and parsed again; if the parse gives back another text, the control
strings in it are escaped, each by one backslash behind its first character
(``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), which the parser takes
off.  A turn's rendering can be told apart without its neighbours, because no
closing mark overlaps itself; the whole conversation is parsed once more all the
same, and where it does not give back its turns every text in it is escaped and the
result is parsed and compared again.  A conversation that even so did not come back
would raise an error; nothing is given out that was not found identical.

The loss mask covers the assistant's texts: one span for each, in characters of
the formatted text.  What the mask covers is cut out of the formatted text by these
offsets; each turn's own part of it is cut, so that this takes time in proportion.

Defined results: a null text or role is an empty string; turns are ordered by
turn (null first), role and text, and equal rows are all kept; rows without a
conversation id form one conversation without an id; texts of any length are kept
whole; no rows give no rows; extra columns are ignored.  A conversation is one row of the result, so that its turns
meet in one task; whatever is done for a turn alone is done before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.llm import common as C

#: A turn, which begins where the one before ended: from any other place nothing is tried.
_TURN = r"(?s)\G(?:\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|\[ROLE:([^\]]*)\] (.*?) \[/ROLE\])"

#: The conversation that every run formats besides those of the table.
EXTRA = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def escape(text: Column) -> Column:
    angle = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(angle, r"\[(\\*)(/?INST\]|/?ROLE(?::[^\[\]]*)?\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    angle = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(angle, r"\[\\(\\*)(/?INST\]|/?ROLE(?::[^\[\]]*)?\])", r"[$1$2")


def _marks(role: Column) -> tuple[Column, Column]:
    begin = F.when(role == "user", "[INST] ").when(role == "assistant", "<s> ").otherwise(F.concat(F.lit("[ROLE:"), F.url_encode(role), F.lit("] ")))
    end = F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").otherwise(" [/ROLE]")
    return begin, end


def render(role: Column, text: Column) -> Column:
    begin, end = _marks(role)
    return F.concat(begin, text, end)


def parse(formatted: Column) -> Column:
    """Turns (role, text, characters before the text, characters of the text as formatted) of a formatted text.

    Offsets count from the turn's own start.
    """

    def turn(part: Column) -> Column:
        head = F.when(F.startswith(part, F.lit("[INST] ")), 7).when(F.startswith(part, F.lit("<s> ")), 4).otherwise(F.locate("] ", part) + 1)
        tail = F.when(F.startswith(part, F.lit("[INST] ")), 8).when(F.startswith(part, F.lit("<s> ")), 5).otherwise(8)
        role = F.when(F.startswith(part, F.lit("[INST] ")), F.lit("user")).when(F.startswith(part, F.lit("<s> ")), F.lit("assistant")).otherwise(F.url_decode(F.regexp_extract(part, r"^\[ROLE:([^\]]*)\] ", 1)))
        size = F.length(part) - head - tail
        return F.struct(role.alias("role"), unescape(part.substr(head + 1, size)).alias("text"), head.cast("long").alias("head"), size.cast("long").alias("size"), F.length(part).cast("long").alias("whole"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def _same(formatted: Column, source: Column) -> Column:
    """Whether a formatted text is nothing but turns and parses into ``source``, an array of (role, text)."""
    parsed = parse(formatted)
    whole = F.aggregate(parsed, F.lit(0).cast("long"), lambda n, t: n + t["whole"]) == F.length(formatted)
    return whole & (F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == source)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row a conversation: ``formatted``, its parsed ``turns`` and the ``loss`` spans (start, size) in characters."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = render(F.col("role"), F.col("text"))
    one = F.array(F.struct("role", "text"))
    rows = rows.withColumn("escaped", render(F.col("role"), escape(F.col("text"))))
    rows = rows.withColumn("shown", F.when(_same(plain, one), plain).otherwise(F.col("escaped")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(order))
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("shown").cast("long")).over(before), F.lit(0)))
    rows = rows.withColumn("at_escaped", F.coalesce(F.sum(F.length("escaped").cast("long")).over(before), F.lit(0)))
    every = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text", "shown", "escaped", "at", "at_escaped"))).alias("all"))
    source = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = every.withColumn("first", F.array_join(F.col("all.shown"), "")).withColumn("ok", _same(F.col("first"), source))
    escaped = F.array_join(F.col("all.escaped"), "")
    checked = F.when(_same(escaped, source), escaped).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("string"))
    joined = first.select(
        "conv_id",
        F.when(F.col("ok"), F.col("first")).otherwise(checked).alias("formatted"),
        F.when(F.col("ok"), F.col("all.at")).otherwise(F.col("all.at_escaped")).alias("at"),
    )
    parsed = joined.withColumn("turns", parse(F.col("formatted")))
    mask = F.zip_with("turns", "at", lambda t, at: F.when(t["role"] == "assistant", F.struct((at + t["head"]).alias("start"), t["size"].alias("size"))))
    masked = parsed.select("conv_id", "formatted", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), mask.alias("mask"))
    return masked.withColumn("loss", F.filter("mask", lambda s: s.isNotNull()))


def under_mask(chats: DataFrame, *carried: str) -> DataFrame:
    """(conv_id, said, and columns carried along): all text that the loss mask covers in ``formatted``, unescaped, in order.

    Each span is cut by its offset from the part of the formatted text in which it
    should lie; what a wrong span covers comes out, right or not.
    """
    parts = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0))
    rows = chats.select("conv_id", *carried, F.posexplode(F.arrays_zip(parts.alias("part"), F.col("mask").alias("span"))).alias("nth", "turn"))
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", *carried, "nth", "turn.*").withColumn("begin", F.coalesce(F.sum(F.length("part").cast("long")).over(before), F.lit(0)))
    cut = F.substring(F.col("part"), (F.col("span.start") - F.col("begin") + 1).cast("int"), F.col("span.size").cast("int"))
    kept = rows.select("conv_id", *carried, "nth", F.when(F.col("span").isNotNull(), unescape(cut)).otherwise("").alias("said"))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]), "").alias("said"), *(F.first(c).alias(c) for c in carried))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes, read back from the formatted text alone."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = chats.select(
        "conv_id",
        "formatted",
        "mask",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = under_mask(whole, "n_turns", "turns_sha256", "formatted_chars")
    return said.select("conv_id", "n_turns", "turns_sha256", F.length("said").cast("long").alias("loss_chars"), F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(formatted(rows.unionByName(spark.sql(EXTRA))))


#: What the round trip must give back; only the length of the formatted text is the template's own.
OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE length(role) END AS extra,
             CASE role WHEN 'user' THEN contains(text, ' [/INST]') OR regexp_matches(text, '<\\+/?s>|\[\\+(/?INST\]|/?ROLE(:[^\[\]]*)?\])')
                       WHEN 'assistant' THEN contains(text, ' </s>') OR regexp_matches(text, '<\\+/?s>|\[\\+(/?INST\]|/?ROLE(:[^\[\]]*)?\])')
                       ELSE contains(text, ' [/ROLE]') OR regexp_matches(text, '<\\+/?s>|\[\\+(/?INST\]|/?ROLE(:[^\[\]]*)?\])') END AS bad
      FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + extra END
           + CASE WHEN bad THEN len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?INST\]|/?ROLE(?::[^\[\]]*)?\])')) ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
