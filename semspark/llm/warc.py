r"""Merkle fixity audit of WARC replicas.

Pages are written as WARC/1.0 response records, one after another, in files of
consecutive page ids: a replica is a table of the bytes that lie at each offset of a
file, and the manifest, made when it was written, knows each record's offset, length
and SHA-256.  A file of many records is written in parts of about ``FILE_RECORDS``, so
that no task holds more, whatever id they have.  Writing moves each record once to its
file; the audit hashes records where they lie, and only hashes and places travel.

The leaves of a replica's tree are its records' hashes.  A node is the hash of an
offset range of a part (``RANGE`` bytes): of the offset, length and hash of all that
begins there, every copy for itself.  ``FAN`` neighbouring ranges hash into a node,
and so on up to the part, over the parts of a file, and over the files up to a root.
The tree's shape depends on offsets alone, so that replicas are compared without
knowing the undamaged bytes.  The audit compares the roots and then, level by level,
only the children of nodes that differ, until it has the records; a record that one
side lacks has no hash there.

A level is one grouping by key for both replicas: nothing is collected, and no group
is larger than ``FAN``, or the records that begin in one range.

Defined results: a page without an id is in the file -1; a null address or page is
empty; a page of any length is one record; equal pages are records of their own; no
rows give no rows, and two empty replicas agree; several rows at one place of a
replica are one leaf, whose hash is that of theirs; null bytes are empty; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.llm import common as C

FAN = 16
#: Bytes of an offset range, the lowest node over records.
RANGE = 1 << 16
#: Page ids in a file, and records in it at which it is cut into parts.
FILE_IDS, FILE_RECORDS = 256, 1024


def record(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of a response record."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(html, 256), 1, 16),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def records(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """Records (page_id, file, bytes), made where the pages lie."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    return rows.select("page_id", F.coalesce(F.floor(F.col("page_id") / file_ids), F.lit(-1)).cast("long").alias("file"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("bytes"))


def written(recs: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """The records laid one after another: file, part, nth, start (offset), size, page_id, sha, bytes."""
    counts = recs.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > file_records)
    large = C.stored(counts.select("file", F.ceil(F.col("n") / file_records).cast("int").alias("parts")), "parts")
    # the rows of a large file are dealt out by their place in the table, as many may have one id or be equal
    rows = C.fixed(recs, "records").withColumn("row", F.monotonically_increasing_id()).join(large, "file", "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int"))
    rows = rows.select("file", "part", "page_id", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha"), "bytes")
    order = Window.partitionBy("file", "part").orderBy(F.col("page_id").asc_nulls_first(), "sha")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return C.stored(rows.select("file", "part", (F.row_number().over(order) - 1).cast("long").alias("nth"), start.alias("start"), "size", "page_id", "sha", "bytes"), "replica")


def manifest(replica: DataFrame) -> DataFrame:
    """What was written where: the leaves of the undamaged replica (file, part, start, size, hash), with nth and page_id."""
    return replica.select("file", "part", "start", "size", F.col("sha").alias("hash"), "nth", "page_id")


def leaves(replica: DataFrame) -> DataFrame:
    """Hashes of what lies at each place of a replica (file, part, start, bytes): (file, part, start, size, hash)."""
    raw = F.coalesce("bytes", F.lit(b""))
    return replica.select("file", "part", "start", F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("hash"))


def _parents(level: DataFrame, keys: list[str], *child: str) -> DataFrame:
    """Nodes (side, keys, hash): the hash of all children's places and hashes, in order."""
    kids = F.array_sort(F.collect_list(F.struct(*child, "hash")))
    text = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", *(k[c].cast("string") for c in child), k["hash"])), "\n")
    return C.stored(level.groupBy("side", *keys).agg(F.sha2(text, 256).alias("hash")), "merkle")


def tree(leaf: DataFrame, fan: int = FAN, range_bytes: int = RANGE) -> list[tuple[DataFrame, list[str], str | None]]:
    """Levels of the trees of all sides, lowest first: the nodes, their keys, and the key by which neighbours go up (None where the next key's do).

    ``leaf`` has side, file, part, start, size and hash.
    """
    axes = ["root", "file", "part", "range"]
    ranged = leaf.withColumns({"root": F.lit(0), "range": F.floor(F.col("start") / range_bytes)})
    reach = ranged.agg(*(F.max(F.greatest(F.col(a), -1 - F.col(a))).alias(a) for a in axes)).first()
    level, levels = _parents(ranged, axes, "start", "size"), []
    while len(axes) > 1:
        axis, top = axes[-1], reach[axes[-1]] or 0
        while top:
            levels.append((level, list(axes), axis))
            level = _parents(level.withColumnRenamed(axis, "child").withColumn(axis, F.floor(F.col("child") / fan)), axes, "child")
            top //= fan
        levels.append((level, list(axes), None))
        axes.pop()
        level = _parents(level, axes, axis)
    return [*levels, (level, axes, None)]


def _differ(level: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Nodes whose hashes differ between the sides: keys, mine, other."""
    hashes = [F.max(F.when(F.col("side") == k, F.col("hash"))).alias(name) for k, name in enumerate(("mine", "other"))]
    return level.groupBy(*keys).agg(*hashes, *(F.max(c).alias(c) for c in more)).where(~F.col("mine").eqNullSafe(F.col("other")))


def audit(mine: DataFrame, other: DataFrame, fan: int = FAN, range_bytes: int = RANGE) -> DataFrame:
    """Places at which the replicas differ: file, part, start, size, mine, other (hashes; null where a side has nothing).

    Both sides are ``leaves``.  Each level reads only the children of nodes that differ above it.
    """
    places = ["file", "part", "start", "size", "hash"]
    both = C.stored(mine.select(F.lit(0).alias("side"), *places).unionByName(other.select(F.lit(1).alias("side"), *places)), "leaves")
    levels = tree(both, fan, range_bytes)
    bad = None
    for level, keys, axis in reversed(levels):
        if bad is not None:
            above = [*(c for c in keys if c != axis), "up"] if axis else keys[:-1]
            some = level.withColumn("up", F.floor(F.col(axis) / fan)) if axis else level
            renamed = bad.withColumnRenamed(axis, "up") if axis else bad
            level = some.join(renamed.select(*above), above, "left_semi").drop("up")
        bad = C.stored(_differ(level, keys).select(*keys), "differ")
    ranged = both.withColumn("range", F.floor(F.col("start") / range_bytes)).join(bad.drop("root"), ["file", "part", "range"], "left_semi")
    # several rows at one place are one leaf
    pairs = F.array_sort(F.collect_list(F.struct("size", "hash")))
    folded = ranged.groupBy("side", "file", "part", "start").agg(pairs.alias("p"), F.max("size").alias("size"))
    one = F.when(F.size("p") == 1, F.col("p")[0]["hash"]).otherwise(F.sha2(F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["size"].cast("string"), x["hash"])), "\n"), 256))
    found = _differ(folded.withColumn("hash", one).withColumn("own", F.when(F.col("side") == 0, F.col("size"))), ["file", "part", "start"], "own", "size")
    return found.select("file", "part", "start", F.coalesce("own", "size").alias("size"), "mine", "other")


def damaged(replica: DataFrame, every: int = 97) -> DataFrame:
    """A replica with faults that depend on the place alone, so that of equal records each is hit for itself: a byte changed in some, some cut short, some lost, some a byte further on."""
    mark, size = F.pmod(31 * F.col("file") + F.col("start"), F.lit(every)), F.octet_length("bytes")
    half = F.floor(size / 2).cast("int")
    flipped = F.concat(F.substring("bytes", F.lit(1), half), F.lit(b"\x00"), F.substring("bytes", half + 2, size))
    cut = F.substring("bytes", F.lit(1), size - 7)
    rows = replica.select("file", "part", "start", "bytes").where(mark != 2)
    return rows.withColumn("bytes", F.when(mark == 0, flipped).when(mark == 1, cut).otherwise(F.col("bytes"))).withColumn("start", F.when(mark == 3, F.col("start") + 1).otherwise(F.col("start")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a damaged replica of the pages' records: where it differs from the manifest, and how."""
    replica = written(records(C.table(spark, sf_dir, "pages")))
    plan = manifest(replica)
    found = audit(plan, leaves(damaged(replica)))
    ids = plan.select("file", "part", "start", "nth", "page_id")
    page, nth = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("nth", F.lit(-1))
    return found.join(ids, ["file", "part", "start"], "left").select("file", "part", nth.alias("nth"), page.alias("page"), "start", "size", F.col("mine").alias("expected_sha256"), F.col("other").alias("found_sha256"))


#: Every record compared with its copy; the audit must find the same ones.  Files of so many records that they have parts are not told here.
OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(floor(page_id / 256), -1)::BIGINT AS file FROM pages),
body AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || html AS body FROM p),
rec AS (SELECT file, page_id, ('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || ':' || sha256(html)[1:16]
        || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
        || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10))::VARCHAR AS r FROM body),
laid AS (SELECT *, sha256(r) AS sha, strlen(r)::BIGINT AS size FROM rec),
put AS (SELECT *, row_number() OVER w - 1 AS nth, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM laid WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, sha)),
hit AS (SELECT *, ((31 * file + start) % 97 + 97) % 97 AS mark, encode(r) AS b FROM put)
SELECT file, 0 AS part, nth, coalesce(page_id::VARCHAR, '') AS page, start, size, sha AS expected_sha256,
       CASE mark WHEN 0 THEN sha256(b[1:size // 2] || '\x00'::BLOB || b[size // 2 + 2:]) WHEN 1 THEN sha256(b[1:size - 7]) END AS found_sha256
FROM hit WHERE mark <= 3
UNION ALL SELECT file, 0, -1, '', start + 1, size, NULL, sha FROM hit WHERE mark = 3
"""
