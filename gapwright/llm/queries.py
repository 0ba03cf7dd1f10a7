"""The operators with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm import bpe, exact_dedup, line_dedup, main_text, mixing, packing, quality, simhash, substring, token_files, turns, warc, whitening
from gapwright.llm.scratch import kept, new_folder
from gapwright.llm.ship import ship
from gapwright.llm.text import n_words, whole

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select("doc_id", "source", n_words(whole("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.substring_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.pages(spark, path)


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, TOKENIZER)
    return token_files.documents(spark, path)


def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, carry={"text_sha256": F.sha2("_norm", 256)})


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.scored(docs, model).drop("text")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    told = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)
    return told.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns.damaged(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    plans = kept(turns.audits(rows, live_col="live"), "audits")
    told = turns.digests(turns.repaired(rows, plans, live_col="live"))
    both = plans.join(told.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return both.select(*plans.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_substring_dedup, op3_simhash, op4_warc, op5_token_files, op6_pack, op7_exact_dedup, op8_line_dedup, op9_main_text,
        op10_quality_rules, op11_whitening, op12_bpe, op13_turn_repair,
    )
}



def _repair_sql() -> str:
    """The damage by CRC-32 over a table of remainders, and the repair as a
    recursion from each conversation's end: for every grammar state (none yet,
    after system, user, assistant) the least (cost, audit), with the lines."""
    after, roles = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def way(cost: str, edit: str, line: str, rest: str) -> str:
        return f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 's': {line + ' || ' if line else ''}{rest}.s}}"

    def used(q: int) -> str:
        ways = [way("3", "D", "", f"t[{q + 1}]"), f"CASE WHEN fault < 2 THEN {way('2 + fault', 'R', f'chr(10) || {chr(39)}{roles[after[q]]}:{chr(39)} || text', f't[{after[q] + 1}]')} END"]
        ways += [f"CASE WHEN fault < 2 AND role[1] = '{i}' THEN {way('fault', 'K', 'chr(10) || role || chr(58) || text', f't[{k[q] + 1}]')} END" for i, k in keeps.items() if q in k]
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"

    def inserted(q: int) -> str:
        one, two = after[q], after[after[q]]
        a, b = (f"chr(10) || '{roles[n]}:'" for n in (one, two))
        return f"list_min([u[{q + 1}], {way('2', 'I', a, f'u[{one + 1}]')}, {way('4', 'II', f'{a} || {b}', f'u[{two + 1}]')}])"

    ends = "[{'c': 0, 'a': '', 's': ''}, {'c': 4, 'a': 'II', 's': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 2, 'a': 'I', 's': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 's': ''}]"
    return f"""
        WITH RECURSIVE remainders AS (
          SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS r
        ), kinds AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
              list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
              lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
          FROM conversations, remainders
        ), damaged AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM kinds WHERE kind > 0
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM damaged
        ), judged AS (
          SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 3
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
              WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
            lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair
          FROM placed
        ), counted AS (
          SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 3) AS blank,
            count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last
          FROM judged GROUP BY conv_id
        ), repaired AS (
          SELECT conv_id, last AS pos, {ends} AS t FROM counted
          UNION ALL
          SELECT conv_id, pos - 1, [{', '.join(inserted(q) for q in range(4))}] FROM (
            SELECT w.conv_id, w.pos, [{', '.join(used(q) for q in range(4))}] AS u FROM repaired w JOIN judged USING (conv_id, pos)) steps
        ), best AS (SELECT conv_id, t[1] AS b FROM repaired WHERE pos = 0)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
          coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.s, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id)"""


ORACLE: dict[str, str] = {
    "op13_turn_repair": _repair_sql(),
    "op1_mix_sources": f"""
        WITH sized AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
        ), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), weighed AS (
          SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM sizes
        ), levels AS (
          SELECT *, cap / w AS stop,
            (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
              / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
          FROM weighed
          WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), planned AS (
          SELECT source, source_size,
            least(cap, coalesce(arg_min(level, stop) FILTER (level <= stop) OVER () * w, cap)) AS target
          FROM levels
        ), placed AS (
          SELECT doc_id, size, source_size, target, source,
            CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
            row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS place
          FROM sized JOIN planned USING (source)
        )
        SELECT doc_id, size, source_size, target, source,
          CAST(floor(place * ratio + {mixing.offset()!r}::DOUBLE) - floor((place - 1) * ratio + {mixing.offset()!r}::DOUBLE) AS BIGINT) AS copies,
          CAST(floor(place * ratio + {mixing.offset()!r}::DOUBLE) - floor((place - 1) * ratio + {mixing.offset()!r}::DOUBLE) AS BIGINT) * size AS taken
        FROM placed""",
    "op2_substring_dedup": """
        WITH listed AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), windows AS (
          SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM listed WHERE len(words) >= 50
        ), hashed AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS h FROM windows
        ), firsts AS (SELECT h, min(doc_id) AS f FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hashed JOIN firsts USING (h) WHERE f < doc_id
        ), placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM listed
        ), stays AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(t, '')) AS kept_sha256
        FROM listed LEFT JOIN stays USING (doc_id)""",
    "op4_warc": """
        WITH payloads AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), placed AS (
          SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN last_id > page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN last_id > page_id THEN last_id END AS refers_to
        FROM placed""",
    "op7_exact_dedup": """
        WITH norm AS (
          SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
        ), best AS (
          SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY t) AS group_size
          FROM norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM best""",
    "op8_line_dedup": """
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents
        ), keyed AS (
          SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM lines
        ), shared AS (
          SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
          SELECT doc_id, line, pos, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k)
        )
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
