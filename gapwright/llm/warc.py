"""WARC archives: written by Spark, read back by chains of record boundaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwright.llm import membership
from gapwright.llm.scratch import kept
from gapwright.llm.text import whole

MAGIC = "WARC/1.1\r\n"
LEAST_REVISIT = 1000  # bytes
ID = "urn:x-page:"
NO_ID = "none"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def _uri(url: Column) -> Column:
    """The URL on one line: white space and control characters as %20."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def _record(kind: str, payload: Column, refers: Column | None) -> Column:
    """A record without the two line ends that close it."""
    block = F.concat(F.lit(HTTP), payload)
    fields = [
        F.lit(f"{MAGIC}WARC-Type: {kind}\r\nWARC-Record-ID: <{ID}"), F.coalesce(F.col("_id").cast("string"), F.lit(NO_ID)),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), _uri(F.col("_url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"),
    ]
    if refers is not None:
        fields += [F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}"), refers.cast("string"), F.lit(">")]
    fields += [F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return F.concat(*fields)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """A record per page, in ``.txt`` part files of folder ``path`` that are
    WARC 1.1 without compression. Of pages with equal payloads of at least
    ``least`` bytes, the one with the largest id is a response and the others
    revisit it; all other pages are responses.

    Digests are counted first; those held twice come to the writing scan as a
    bitmap of fixed size, so only pages that may have a double are dealt by
    digest, and of these only the response carries its payload on. Spark's
    text writer commits the files and closes each record with its separator.

    Null html is an empty payload, a null URL an empty one. Ids are whole
    numbers; pages with a null id are the smallest of their group, and if all
    are null, all are responses, as there is no id to refer to. Rows that
    repeat the largest id are all responses. An empty table gives no records.
    Other columns are not looked at, whatever their names. A very long page is
    one record; Spark holds a payload as one value of at most 2^31 - 1 bytes,
    and longer ones do not come to be.
    """
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), whole(html_col).alias("_html"))
    digests = source.withColumn("_digest", F.sha1("_html")).withColumn("_key", F.xxhash64("_digest"))
    large = F.octet_length("_html") >= least
    counts = digests.where(large).groupBy("_digest").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = kept(counts.select("_digest", "_last"), "doubles")
    doubles = membership.bitmap(groups.select(F.xxhash64("_digest").alias("_key")), "_key")
    marked = membership.flagged(digests, "_key", doubles, "_maybe").withColumn("_maybe", F.col("_maybe") & large)
    alone = marked.where(~F.col("_maybe")).select(_record("response", F.col("_html"), None).alias("value"))
    last = groups.withColumnRenamed("_digest", "_of")
    shared = marked.where("_maybe").join(last, F.col("_digest") == F.col("_of"), "left")
    response = F.col("_last").isNull() | F.col("_id").eqNullSafe(F.col("_last"))
    split = shared.select(
        F.when(response, _record("response", F.col("_html"), None)).otherwise(_record("revisit", F.lit(""), F.col("_last"))).alias("value")
    )
    alone.unionByName(split).write.option("lineSep", "\r\n\r\n").text(path)


def _field(head: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(value: str) -> dict[str, Column]:
    """Of text after a magic: its header, the bytes up to the next record
    (magic and closing line ends included), and the payload."""
    end = F.instr(value, "\r\n\r\n")
    head = F.when(end > 0, F.substring(value, F.lit(1), end - 1))
    length = F.try_to_number(F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1), F.lit("9" * 15)).cast("long")
    body = F.col(value).cast("binary")
    block = F.substring(body, (F.octet_length(head) + 5).cast("int"), F.least(length, F.lit(2**31 - 1)).cast("int"))
    http = F.instr(block.cast("string"), "\r\n\r\n")
    http_bytes = F.octet_length(F.substring(block.cast("string"), F.lit(1), http - 1)) + 4
    payload = F.when(http > 0, F.substring(block, (http_bytes + 1).cast("int"), F.octet_length(block))).otherwise(block)
    return {"_head": head, "_span": len(MAGIC) + F.octet_length(head) + 4 + length + 4, "_payload": payload.cast("string")}


def records(spark: SparkSession, path: str, compute: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A row per record of the archives in ``path``: file, at (its offset),
    type, id, url, digest, refers_to, and what ``compute`` makes of the payload
    (by default the payload itself).

    The files are read as text separated by the magic, which Spark may split
    anywhere. What follows a magic is a candidate; its offset is the sum of
    the lengths before it, in its split and in the splits before, and its
    length names its successor's offset. Candidates that are each other's
    neighbour and successor within a split are first made one run. From the
    run at the start of the file, pointers to successors are followed, doubled
    each round. Only records on that chain count: a magic in a payload, even
    with a whole record after it, is not on it, as the record around it names
    a successor behind it. A record cut by such a magic is put together again.

    A file that does not begin with a record gives none; where a chain breaks
    (a cut or damaged file), records up to there are returned; a record cut by
    the end of the file is not. Unknown header fields are passed over, missing
    ones are null. An empty folder gives no rows.
    """
    compute = compute or {"payload": lambda p: p}
    raw = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    lines = raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"), (F.octet_length("value") + len(MAGIC)).cast("long").alias("_bytes"),
    )
    parsed = lines.select("*", *[c.alias(n) for n, c in _parsed("value").items()])
    whole_one = F.coalesce(F.col("_span") == F.col("_bytes"), F.lit(False))
    chunks = kept(
        parsed.select(
            "file", "_split", "_line", "_bytes", "_head", "_span", whole_one.alias("_whole"),
            *[F.when(whole_one, f(F.col("_payload"))).alias(n) for n, f in compute.items()],
        ),
        "chunks",
    )

    totals = chunks.groupBy("file", "_split").agg(F.sum("_bytes").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("file").alias("_f"), F.col("_split").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    in_split = Window.partitionBy("file", "_split").orderBy("_line")
    until_here = in_split.rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_base") + F.sum("_bytes").over(until_here) - F.col("_bytes") - len(MAGIC)
    placed = (
        chunks.select("file", "_split", "_line", "_bytes", "_span", "_whole")
        .join(bases, (F.col("file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
        .withColumn("at", at)
        .where("at >= 0")
        .withColumn("next", F.col("at") + F.col("_span"))
        .withColumn("_new", ~F.coalesce(F.lag("next").over(in_split) == F.col("at"), F.lit(False)))
        .withColumn("run", F.last(F.when(F.col("_new"), F.col("at")), ignorenulls=True).over(until_here))
    )
    nodes = kept(placed.select("file", "_split", "_line", "_whole", "at", "next", "run"), "boundaries")
    found = kept(nodes.join(_entries(nodes), ["file", "run"]).where("at >= entry AND next IS NOT NULL"), "chain")

    out = chunks.join(found.where("_whole").select("file", "_split", "_line", "at"), ["file", "_split", "_line"]).select("file", "at", "_head", *compute)
    torn = found.where("NOT _whole").select("file", "at", "next")
    if not torn.isEmpty():
        out = out.unionByName(_rejoined(lines, torn, compute))
    return out.select(
        "file", "at", F.lower(_field("_head", "WARC-Type")).alias("type"), _field("_head", "WARC-Record-ID").alias("id"),
        _field("_head", "WARC-Target-URI").alias("url"), _field("_head", "WARC-Payload-Digest").alias("digest"),
        _field("_head", "WARC-Refers-To").alias("refers_to"), *compute,
    )


def _entries(nodes: DataFrame) -> DataFrame:
    """(file, run, entry): the runs on the chain from the start of each file
    and the offset at which the chain enters them. A run goes on where its last
    candidate points; jumps double until no run is newly reached."""
    exits = nodes.groupBy("file", "run").agg(F.max_by("next", "at").alias("exit"))
    targets = nodes.select(F.col("file").alias("_f"), F.col("at").alias("_at"), F.col("run").alias("to"))
    runs = kept(
        exits.join(targets, (F.col("file") == F.col("_f")) & (F.col("exit") == F.col("_at")), "left").select("file", "run", "exit", "to"), "runs"
    )
    now = runs.select("file", "run", F.col("to").alias("jump"), (F.col("run") == 0).alias("on"))
    count = -1
    while True:
        now = kept(now, "jumps")
        n = now.where("on").count()
        if n == count:
            break
        count = n
        far = now.select(F.col("file").alias("_f"), F.col("run").alias("_r"), F.col("jump").alias("_j"))
        hit = now.where("`on` AND jump IS NOT NULL").select(F.col("file").alias("_g"), F.col("jump").alias("_h")).distinct()
        now = (
            now.join(far, (F.col("file") == F.col("_f")) & (F.col("jump") == F.col("_r")), "left")
            .join(hit, (F.col("file") == F.col("_g")) & (F.col("run") == F.col("_h")), "left")
            .select("file", "run", F.col("_j").alias("jump"), (F.col("on") | F.col("_h").isNotNull()).alias("on"))
        )
    reached = now.where("on").select("file", "run")
    onward = runs.join(reached, ["file", "run"], "left_semi").where("to IS NOT NULL").select("file", F.col("to").alias("run"), F.col("exit").alias("entry"))
    return onward.unionByName(reached.where("run = 0").select("file", "run", F.lit(0).cast("long").alias("entry")))


def _rejoined(lines: DataFrame, torn: DataFrame, compute: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Records on the chain that a magic in the payload has cut: their files
    are read again, and the chunks from their offset up to the next record's
    are put together in order."""
    affected = torn.select(F.col("file").alias("_f")).distinct()
    in_file = Window.partitionBy("file").orderBy("_split", "_line").rowsBetween(Window.unboundedPreceding, 0)
    texts = lines.join(affected, F.col("file") == F.col("_f"), "left_semi").withColumn(
        "at", F.sum("_bytes").over(in_file) - F.col("_bytes") - len(MAGIC)
    )
    begins = torn.select(F.col("file").alias("_f"), F.col("at").alias("_a"), F.col("next").alias("_next"))
    owned = texts.join(begins, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_a")), "left")
    owned = owned.withColumn("_own", F.last(F.when(F.col("_a").isNotNull(), F.struct("_a", "_next")), ignorenulls=True).over(in_file))
    pieces = owned.where("at < _own._next").groupBy("file", F.col("_own._a").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_all"))
    joined = pieces.withColumn("_value", F.array_join(F.col("_all.value"), MAGIC))
    parsed = joined.select("file", "at", "_value", *[c.alias(n) for n, c in _parsed("_value").items()])
    complete = F.octet_length("_value") + len(MAGIC) >= F.col("_span")
    return parsed.where(complete).select("file", "at", "_head", *[f(F.col("_payload")).alias(n) for n, f in compute.items()])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the
    records that ``write`` makes. A response's payload is measured; a revisit
    has that of the response it refers to, found by id and digest."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<{ID}(-?[0-9]+)>$', 1) AS BIGINT)")
    found = records(spark, path, {"payload_bytes": lambda p: F.octet_length(p).cast("long"), "sha1": lambda p: F.sha1(p)})
    rows = kept(
        found.select(number("id").alias("page_id"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
                     F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), "payload_bytes", "sha1"),
        "records",
    )
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    measured = responses.groupBy(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1")).agg(F.max("payload_bytes").alias("_n"))
    resolved = revisits.join(measured, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_sha1")), "left")
    return responses.select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to").unionByName(
        resolved.select("page_id", F.col("_n").alias("payload_bytes"), F.col("_sha1").alias("payload_digest"), "record_type", "refers_to")
    )
