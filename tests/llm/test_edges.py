"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: each operator's defined results."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloomlm, cascade, chat, dartminhash, decontam, knn, packing, revisits, ring, spans
from tidemark.llm.common import RELEASE, cut

FRAMES = ["nasty", "clashing", "nothing"]


@pytest.fixture(params=FRAMES)
def docs(request):
    return request.getfixturevalue(request.param)


def n_of(docs):
    return docs.count()


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in rows) == n_of(docs)
    by = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4096
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_spans(docs):
    rows = spans.remove(docs).collect()
    assert len(rows) == n_of(docs)
    if rows:
        assert sorted(rows[0].asDict()) == sorted(docs.columns)
        texts = {r.doc_id: r.text for r in rows}
        # -3 is the least id of the four with one passage
        assert texts[1] == texts[2] == "" and texts[-3].strip() != "" and texts[3] == "" and texts[5] == " \n\t \r\n"
        if "row" in docs.columns:
            assert {r["row"] for r in rows} == {"own row"} and {r["bad"] for r in rows} == {"own bad"}


def test_spans_of_rows_that_repeat(spark):
    other = "Another text altogether, with quite enough words in it to make a span. It has a second sentence, too."
    passage = "One morning the old clerk walked down to the harbour. He gave nine letters to nine captains, and no one asked him why."
    rows = [(5, passage)] * 3 + [(None, other)] * 2 + [(7, other.upper()), (7, "Nothing of this is anywhere else. Nor is that.")]
    got = Counter((r.row.doc_id, r.row.text == r.text, r.text.strip() == "") for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got[5, True, False] == 1 and got[5, False, True] == 2
    whole = [k for k, n in got.items() for _ in range(n) if k[1] and k[0] != 5]
    assert len(whole) == 2 and (7, True, False) in whole  # one of the three of the other text, and the text that is alone


def test_classes(docs):
    got = {r.id: r.class_id for r in dartminhash.classes(docs).collect()}
    kept = dartminhash.keep_first(docs)
    assert kept.columns == docs.columns
    if got:
        assert got[1] == got[2] == got[-3] == -3 and got[3] == got[4] < -3 and got[5] == 5 and got[6] == 6
        ids = Counter(r.doc_id for r in kept.collect())
        assert ids[-3] == 1 and ids[1] == ids[2] == 0 and ids[5] == ids[6] == ids[8] == 1 and max(v for k, v in ids.items() if k is not None) == 1
    else:
        assert kept.count() == 0


def test_cascade(docs):
    rows = cascade.apply(docs).collect()
    assert len(rows) == n_of(docs)
    for r in rows:
        assert (not r.kept) or not r.base_failed
        if r.doc_id in (3, 4, 5):
            assert r.n_words == 0 and r.base_failed


def test_votes(spark, docs):
    labels = spark.createDataFrame([(1, 1), (10, 0), (10, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    for some in (labels, labels.where("false")):
        model = knn.fit(docs, some)
        rows = knn.score(docs.select("doc_id", "text"), model, carry=["doc_id"]).collect()
        assert len(rows) == n_of(docs) and all(0 <= r.score <= 1 for r in rows)
        assert knn.keep(docs, model).columns == docs.columns
        assert knn.keep(docs, model, least=0.0).count() == n_of(docs)


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_ring(docs, slack):
    rows = ring.assign(docs, 4, slack=slack).collect()
    assert len(rows) == n_of(docs)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if rows and not slack:
        sizes = [len(slots.get(s, [])) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1
    for r in rows:
        if r.doc_id == 3:
            assert r["size"] == 1 and r.text_crc32 == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "he gave each of them to a different  captain,\nand none of them asked him why."), (2, None), (3, ""), (4, "short"), (6, "SHIP\n"), (7, "..."), (8, "ship had"), (5, "he gave each of them to a different  captain,\nand none of them asked him why.")], "item_id bigint, text string")
    rows = decontam.matches(docs, bench).collect()
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    if n_of(docs):
        assert Counter((r.doc_id, r.item_id) for r in rows) == Counter({(1, 1): 1, (2, 1): 2, (-3, 1): 1, (1, 5): 1, (2, 5): 2, (-3, 5): 1, (1, 6): 1, (2, 6): 2, (-3, 6): 1, (1, 8): 1, (2, 8): 2, (-3, 8): 1})
        assert {r.stop - r.start for r in rows if r.item_id == 6} == {4}
        assert kept.count() == n_of(docs) - 4
    assert decontam.matches(docs, bench.where("false")).count() == 0 and decontam.clean(docs, bench.where("false")).count() == n_of(docs)


def test_language_model(docs):
    marked = bloomlm.held_out(docs)
    rows = bloomlm.score(marked, bloomlm.Model(marked.where("not held_out"))).collect()
    assert len(rows) == n_of(docs)
    for r in rows:
        assert r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 and r.n_known <= r.n_tokens
        if r.doc_id in (3, 4, 5):
            assert r.n_tokens == 1
    unseen = bloomlm.score(marked, bloomlm.Model(marked.where("false"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in unseen)


def test_chat(spark):
    events = [(1, 1, "open", 0, "user", "hi"), (1, 2, None, 0, None, None), (1, None, "delta", 0, None, "first"), (None, 1, "open", 0, "assistant", None), (2, 1, "what", 9, "x", "y"), (2, 2, "edit", 9, "", "</turn>")]
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, op string, msg bigint, role string, text string").withColumn("formatted", F.lit("own"))
    got = {r.conv_id: (r.formatted, [(m.start, m.stop) for m in r["mask"]]) for r in chat.formatted(df).collect()}
    assert got[1] == ("### user: hi</turn>\n", []) and got[None] == ("### assistant: </turn>\n", [(15, 15)]) and got[2][0] == "### : \\</turn></turn>\n"
    assert chat.formatted(df.where("false")).count() == 0 and chat.digests(chat.formatted(df)).count() == 3
    big = "\\###</turn>" * 300_000
    one = spark.createDataFrame([(1, 1, "open", 0, "assistant", big), (1, 2, "delta", 0, None, big)], "conv_id bigint, seq bigint, op string, msg bigint, role string, text string")
    assert chat.read_back(chat.formatted(one).first().formatted) == [("assistant", big + big)]


def test_revisits(spark):
    schema = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, payload string"
    rows = [
        (1, "http://a/x", 10, "response", {"etag": "e1", "date": "d1", "content-type": "t"}, "one"), (2, "http://a/x", 10, "response", {"etag": "e2"}, "two"), (3, "http://a/x", 10, "revisit", {"etag": "e2"}, None),
        (4, "https://A/x/#f", 11, "revisit", {"etag": "W/e2", "date": "d4", "content-type": "no"}, None), (5, None, 12, "revisit", None, None), (6, "http://a/x", None, "revisit", {"etag": "e2"}, None),
        (7, "http://a/x", 12, "revisit", {}, None), (8, "http://a/x", None, "response", {"etag": "e8"}, "eight"), (9, "http://a/x", 13, None, None, None), (4, "https://A/x/#f", 11, "revisit", {"etag": "W/e2", "date": "d4", "content-type": "no"}, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumns({"canon": F.lit("own"), "slice": F.lit(1), "found": F.lit(2)})
    got = [(r.record_id, r.outcome, r.source_id, r.payload, r.headers.get("date")) for r in revisits.resolve(df).collect()]
    assert Counter(got) == Counter([(3, "missing", None, None, None), (4, "resolved", 2, "two", "d4"), (4, "resolved", 2, "two", "d4"), (5, "missing", None, None, None), (6, "missing", None, None, None), (7, "unverified", None, None, None)])
    assert revisits.resolve(df.where("false")).count() == 0


def test_repeated_captures_and_wild_times(spark):
    schema = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, payload string"
    long_text = "x" * 3_000_000
    rows = [(1, "a", 10, "response", {"etag": "e"}, long_text)] * 3 + [(2, "a", 11, "revisit", {"etag": "e"}, None), (2, "a", 11, "revisit", {"etag": "e"}, None), (2, "a", 12, "revisit", {"etag": "no"}, None)]
    rows += [(None, "b", 10, "response", {"etag": "e"}, "none"), (3, "b", 11, "revisit", {"etag": "e"}, None), (4, "b", 2**60, "revisit", {"etag": "e"}, None)]
    got = Counter((r.record_id, r.outcome, r.source_id, len(r.payload or "")) for r in revisits.resolve(spark.createDataFrame(rows, schema).repartition(3)).collect())
    assert got == {(2, "resolved", 1, 3_000_000): 2, (2, "mismatch", None, 0): 1, (3, "resolved", None, 4): 1, (4, "resolved", None, 4): 1}
    # one URL, two thousand captures and one wild time: still many slices
    hot = spark.range(2000).selectExpr("'u' as canon", "if(id = 0, 1000000000000, id) as ts", "named_struct('ts', if(id = 0, 1000000000000, id), 'record_id', id) as resp")
    found = {r.ts: r.found for r in revisits.latest_earlier(hot).collect()}
    assert found[1] is None and all(found[t].ts == t - 1 for t in range(2, 2000)) and found[10**12].ts == 1999


def test_pipeline_stages_carry_columns(spark, sf_dir, docs):
    import corpus_pipeline

    kept = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    if n_of(docs):
        assert ids[-3] == 1 and ids[1] == ids[2] == 0 and ids[6] == 1 and max(v for k, v in ids.items() if k is not None) == 1
    else:
        assert not ids
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    assert good.columns == docs.columns and good.count() <= n_of(docs)
    assert corpus_pipeline.packed(spark, docs, sf_dir).where("start = 0").count() == n_of(docs)


def test_what_a_cut_shuffled_is_released(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = blocks.getAllFiles()
        return {str(f) for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_") and f.endswith(".data")}

    before, setting = held(), spark.conf.get(RELEASE)
    rows = spark.range(2000).selectExpr("id", "id % 7 as k")
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    done = cut(rows.repartition(5, "id").join(sums, "k").select("id", F.col("s"), F.col("s").alias("s2")))
    end = time.time() + 20
    while held() - before and time.time() < end:  # the files go in the background
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get(RELEASE) == setting  # for all other queries
    expected = {k: sum(range(k, 2000, 7)) for k in range(7)}
    for _ in range(2):
        assert {r.id: (r.s, r.s2) for r in done.collect()} == {i: (expected[i % 7],) * 2 for i in range(2000)}
    assert {r.k: r.s for r in sums.collect()} == expected
