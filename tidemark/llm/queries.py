"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bloomlm, cascade, chat, dartminhash, decontam, knn, packing, revisits, ring, spans
from .common import doc_remainder, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), payload=F.crc32("ids"), name="ids_crc32")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spans.deduplicated(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "text", "n_sentences", "n_removed")


def chat_events(turns: DataFrame) -> DataFrame:
    """Conversations by turn as a log with a past.  By the message's number, modulo 4: opened and streamed in two deltas; a first draft, edited to the first half, then
    a delta; a draft, and a draft of the next message, both undone by a regeneration, then two deltas; all of these.  What is left in the end are the turns."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).cast("long").alias("msg"))
    first = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    rest = F.col("text").substr(F.floor(F.length("text") / 2).cast("int") + 1, F.length("text"))
    step = lambda op, part, ahead=0: F.struct(F.lit(op).alias("op"), part.alias("part"), F.lit(ahead).alias("ahead"))
    draft = F.concat(F.lit("draft of "), F.col("role"))
    opened = [step("open", F.lit(""))]
    edited = [step("open", draft), step("edit", first), step("delta", rest)]
    undone = [step("delta", draft), step("open", F.lit("too early"), 1), step("regenerate", F.lit(""))]
    streamed = [step("delta", first), step("delta", rest)]
    steps = F.when(F.col("msg") % 4 == 1, F.array(*opened, *streamed)).when(F.col("msg") % 4 == 2, F.array(*edited))
    steps = steps.when(F.col("msg") % 4 == 3, F.array(*opened, *undone, *streamed)).otherwise(F.array(*opened, *undone, step("delta", draft), *edited[1:]))
    log = rows.select("conv_id", "role", "msg", F.posexplode(steps).alias("k", "step"))
    return log.select("conv_id", (F.col("msg") * 16 + F.col("k")).alias("seq"), "step.op", (F.col("msg") + F.col("step.ahead")).alias("msg"), "role", F.col("step.part").alias("text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return chat.digests(chat.formatted(chat_events(turns.unionByName(more))))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.apply(table(spark, sf_dir, "documents"))


def page_records(pages: DataFrame) -> DataFrame:
    """Captures made of pages.  Each page is a full response at ten times its id, for every second page under the address of its site's front page instead of its own,
    so that sites have many captures.  97 pages long a site keeps its validator; other pages have their own.  Later (for some pages earlier) the address is asked again
    and answered "not modified", with a good, weak, stale, dated or no validator: a page's own five ticks later, a site's up to twelve pages later, so another page answers."""
    page = F.col("page_id")
    shared = page % 2 == 0
    url = F.when(shared, F.regexp_extract(F.coalesce("url", F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)).otherwise(F.col("url"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.when(shared, F.floor(page / 97).cast("string")).otherwise(F.col("html"))), 1, 16), F.lit('"'))
    dated = F.when(shared, F.floor(page / 97)).otherwise(page)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    headers = lambda *kv: F.map_from_entries(F.filter(F.array(*(pair(k, v) for k, v in kv)), lambda e: e["value"].isNotNull()))
    full = pages.select(
        (page * 2).alias("record_id"), url.alias("url"), (page * 10).alias("ts"), F.lit("response").alias("kind"),
        headers(("etag", tag), ("last-modified", dated), ("content-type", F.lit("text/html")), ("date", page * 10), ("cache-control", F.lit("max-age=60"))).alias("headers"),
        F.col("html").alias("payload"),
    )
    ts = F.when(page % 11 == 5, page * 10 - 5).when(shared, page * 10 + 5 + 10 * (page % 13)).otherwise(page * 10 + 5)
    kind = page % 7
    again = F.when(kind == 3, F.lit('"stale"')).when(kind == 4, F.concat(F.lit("W/"), tag)).when(kind < 3, tag)
    asked = pages.select(
        (page * 2 + 1).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"),
        headers(("etag", again), ("last-modified", F.when(kind == 5, dated)), ("content-type", F.lit("text/plain")), ("date", ts), ("cache-control", F.lit("no-cache"))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(asked)


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    h = F.col("headers")
    return done.select(
        "record_id", "canon", "outcome", "source_id", h["date"].alias("date"), h["content-type"].alias("content_type"), h["cache-control"].alias("cache_control"),
        F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"),
    )


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op7_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = knn.fit(docs, labels.where(doc_remainder(3) != 1))
    rows = docs.select("doc_id", "text", (doc_remainder(3) == 1).alias("held_out"))
    return knn.score(rows, model, carry=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bloomlm.held_out(table(spark, sf_dir, "documents"))
    return bloomlm.score(docs, bloomlm.Model(docs.where(~F.col("held_out"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_sentence_spans, op3_chat_format, op4_quality_cascade, op5_revisit_resolution, op6_dart_minhash, op7_neighbour_vote, op8_bounded_ring, op9_qgram_decontamination, op10_bloom_lm, pipeline)}

SQL = {
    "op3_chat_format": r"""
        WITH t AS (
            SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op4_quality_cascade": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
        lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
                  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
        per_line AS (SELECT doc_id, sum(n)::BIGINT AS worded, sum(n - 1)::BIGINT AS dup,
                            coalesce(sum(n) FILTER (regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')), 0)::BIGINT AS bullets,
                            coalesce(sum(n) FILTER (regexp_matches(l, '[.][.][.][\x20\x09-\x0D]*$')), 0)::BIGINT AS dots FROM lines GROUP BY doc_id),
        win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
        pairs AS (SELECT doc_id, a, b, count(*) AS n FROM (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY ALL),
        top AS (SELECT doc_id, max(n) AS most, sum(n) AS pairs FROM pairs GROUP BY doc_id),
        rep AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(worded, 0) AS worded, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots, coalesce(most, 0) AS most, coalesce(pairs, 0) AS pairs,
                     length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters,
                     len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered
              FROM w LEFT JOIN per_line USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN top USING (doc_id)),
        j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 2 * n_dup_lines > worded OR 10 * upper > 3 * letters OR 10 * lettered < 7 * n_words
                    OR 10 * bullets > 9 * worded OR 10 * dots > 3 * worded OR 5 * most > pairs) AS kept
        FROM j""",
    "op5_revisit_resolution": r"""
        WITH x AS (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) ELSE url END AS url,
                          '"' || substr(md5(CASE WHEN page_id % 2 = 0 THEN (page_id // 97)::VARCHAR ELSE html END), 1, 16) || '"' AS tag,
                          CASE WHEN page_id % 2 = 0 THEN page_id // 97 ELSE page_id END AS dated FROM pages),
        u AS (SELECT page_id, html, tag, dated, regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM x),
        p AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)$', '')), '^www\.', '') AS host,
                     regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                     array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS params FROM u),
        c AS (SELECT page_id, html, tag, dated, host || path || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS canon FROM p),
        r AS (SELECT page_id * 2 + 1 AS record_id, page_id, canon,
                     CASE WHEN page_id % 11 = 5 THEN page_id * 10 - 5 WHEN page_id % 2 = 0 THEN page_id * 10 + 5 + 10 * (page_id % 13) ELSE page_id * 10 + 5 END AS ts,
                     CASE WHEN page_id % 7 = 3 THEN '"stale"' WHEN page_id % 7 = 4 THEN 'W/' || tag WHEN page_id % 7 < 3 THEN tag END AS own_tag,
                     CASE WHEN page_id % 7 = 5 THEN dated END AS modified FROM c),
        s AS (SELECT page_id * 2 AS found, dated AS stored_modified, page_id * 10 AS at, canon, tag, html FROM c),
        j AS (SELECT r.*, s.found, s.tag, s.stored_modified, s.html FROM r ASOF LEFT JOIN s ON r.canon = s.canon AND r.ts > s.at),
        o AS (SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN own_tag IS NULL AND modified IS NULL THEN 'unverified'
                             WHEN coalesce(CASE WHEN own_tag IS NOT NULL THEN regexp_replace(own_tag, '^W/', '') = tag ELSE modified = stored_modified END, false) THEN 'resolved'
                             ELSE 'mismatch' END AS outcome FROM j)
        SELECT record_id, canon, outcome, CASE WHEN outcome = 'resolved' THEN found END AS source_id, ts::VARCHAR AS date,
               CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END AS content_type, 'no-cache' AS cache_control,
               CASE WHEN outcome = 'resolved' THEN length(html) END AS payload_chars, CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
        FROM o""",
    "op6_dart_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text,
                list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)) GROUP BY ALL),
        size AS (SELECT doc_id, count(*) AS k, sum(n) AS m FROM g GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, sum(least(a.n, b.n)) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair p JOIN size x ON p.a = x.doc_id JOIN size y ON p.b = y.doc_id WHERE p.k / (x.k + y.k - p.k) >= 0.8 OR p.m / (x.m + y.m - p.m) >= 0.8
                 UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id < b.doc_id),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
        SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a""",
}
