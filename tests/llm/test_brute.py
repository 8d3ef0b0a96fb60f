"""Each operator against a plain version over small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloomlm, cascade, chat, dartminhash, decontam, knn, packing, queries, revisits, ring, spans
from tidemark.llm.common import doc_remainder
from tidemark.llm.textscan import FIRST, scans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


# scanning


def test_scan_chunks_agree_with_plain_words():
    rnd = random.Random(1)
    some = ["".join(rnd.choice("aB \n\té.") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(some, pa.string()).slice(3)], names=["text"])
    words, hashes = [], {}
    for s in scans(batch, limit=100):
        raw = s.data.tobytes()
        per = [[] for _ in range(s.n)]
        for a, z, d, h in zip(*s.words, s.word_doc, s.word_hash.tolist(), strict=True):
            per[d].append(raw[a:z].decode())
            assert hashes.setdefault(raw[a:z], h) == h
        words += per
        start, end, doc = s.lines()
        got = [[] for _ in range(s.n)]
        for a, z, d in zip(start, end, doc, strict=True):
            got[d].append(raw[a:z].decode())
        assert got == [(t or "").split("\n") for t in some[3:][s.first : s.first + s.n]]
    assert words == [WORD.findall(t or "") for t in some[3:]] and len(set(hashes.values())) == len(hashes)


def test_segments_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = FIRST.segments(FIRST.prefix(data), np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


# 1 packing


def test_packing_round_trip(documents, texts):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    by, size = defaultdict(list), Counter()
    for r in packing.pack(documents).collect():
        by[r.doc_id].append(r)
        size[r.sequence_id] += r.length
    for k, text in texts.items():
        parts = sorted(by[k], key=lambda r: r.piece)
        assert [i for r in parts for i in np.frombuffer(r.ids, "<u4").tolist()] == [*t.encode(text, add_special_tokens=False).ids, 2]
        assert all(r.length == 1024 for r in parts[1:]) and [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
    bound = packing.lower_bound(np.array([r.length for rs in by.values() for r in rs]), 1024)
    assert max(size.values()) <= 1024 and bound <= len(size) <= 1.02 * bound


def optimum(sizes, c):
    """Fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)

    def fits(i, bins):
        if i == len(sizes):
            return True
        tried = set()
        for k, room in enumerate(bins):
            if room >= sizes[i] and room not in tried:
                tried.add(room)
                bins[k] -= sizes[i]
                if fits(i + 1, bins):
                    return True
                bins[k] += sizes[i]
        return False

    return next(n for n in range(1, len(sizes) + 1) if fits(0, [c] * n))


def test_bounds_hold_and_best_fit_is_best_fit():
    rnd = random.Random(2)
    for _ in range(150):
        c = rnd.randint(5, 40)
        sizes = [rnd.randint(1, c) for _ in range(rnd.randint(1, 9))]
        best = optimum(sizes, c)
        assert packing.lower_bound(np.array(sizes), c) <= best
        bins, left = packing.best_fit_decreasing(np.array(sizes), c)
        rooms, expected = [], 0
        for s in sorted(sizes, reverse=True):
            open_ = [r for r in rooms if r >= s]
            if open_:
                r = min(open_)
                rooms.remove(r)
                rooms.append(r - s)
            else:
                rooms.append(c - s)
                expected += 1
        assert len(left) == expected and sorted(left.tolist()) == sorted(rooms) and (np.bincount(bins, weights=sizes) + left == c).all()
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # beyond the bound of the sum


def test_exchange_saves_sequences(spark):
    # parts that are wasteful alone: many of two thirds here, many of one third there
    rows = [(i, 700 if i % 2 else 330) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, length bigint")
    before, packing.PART_ITEMS = packing.PART_ITEMS, 100
    try:
        got = packing.sequences(df).collect()
    finally:
        packing.PART_ITEMS = before
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(got) == 3000
    one_by_one = 0
    for part in range(30):
        sizes = np.array([x for i, x in rows if i % 30 == part])
        one_by_one += len(packing.best_fit_decreasing(sizes, 1024)[1])
    assert len(used) <= 1.05 * packing.lower_bound(np.array([x for _, x in rows]), 1024) <= 1.05 * one_by_one


def test_parts_are_bounded_whatever_the_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 500)
    same = spark.createDataFrame([(None, None)], "doc_id bigint, text string").crossJoin(spark.range(5000)).select("doc_id", "text")
    book = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(60_000)))], "doc_id bigint, text string")
    rows = packing.pack(same.unionByName(book), payload=F.crc32("ids"), name="crc").collect()
    parts = packing.dealt(spark.range(20_000).selectExpr("id * 8589934592 + id as __row", "1 as length"), 20_000).groupBy("__part").count().collect()
    assert len(parts) == 40 and max(r["count"] for r in parts) <= 1000
    assert sum(r.start == 0 for r in rows) == 5001
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 for x in used.values())
    for x in used.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
    assert len(used) <= -(-sum(r.length for r in rows) // 1024) + 11


# 2 spans


def word_weight(word, known={}):
    if word not in known:
        scan = next(scans(pa.RecordBatch.from_arrays([pa.array([word])], names=["text"])))
        known[word] = int(dartminhash.mix(scan.word_hash)[0])
    return known[word]


def sentences(text):
    """Words and the ranges of sentences, by plain code."""
    whole, start = [], 0
    words = list(WORD.finditer(text))
    for i, w in enumerate(words):
        if i == len(words) - 1 or w[0][-1] in ".!?" or "\n" in text[w.end() : words[i + 1].start()]:
            whole.append((start, i + 1))
            start = i + 1
    low, out = [lowered(w[0]) for w in words], []
    for a, z in whole:
        if z - a > spans.LONG:
            for i in range(a, z - 1):
                if all(word_weight(low[i]) <= word_weight(x) for x in low[max(0, i - spans.REACH) : i + spans.REACH + 1]):
                    out.append((a, i + 1))
                    a = i + 1
        out.append((a, z))
    return low, out


def test_spans_against_plain_code(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 15))) + rnd.choice([".", "!", "?"]) for _ in range(120)]
    pool += [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.randint(17, 60))) + rnd.choice([".", ""]) for _ in range(60)] + ["same " * 40, "to and " * 30]
    docs = {k: rnd.choice([" ", "\n", "\n\n"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for k in range(40)}
    for k in range(40, 50):  # passages that several share
        docs[k] = docs[k - 40] + "\n" + docs[k - 35]
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    holders = defaultdict(list)
    runs = {}
    for k, text in docs.items():
        words, sents = sentences(text)
        runs[k] = []
        for i in range(len(sents)):
            j = i + spans.MIN_SENTENCES
            while j <= len(sents) and sents[j - 1][1] - sents[i][0] < spans.MIN_WORDS:
                j += 1
            if j <= len(sents):
                key = tuple(words[sents[i][0] : sents[j - 1][1]])
                runs[k].append((key, i, j))
                holders[key].append((k, i))
    expected = {k: {s for key, i, j in rs if (k, i) != min(holders[key]) for s in range(i, j)} for k, rs in runs.items()}
    for r in spans.deduplicated(df).collect():
        k = r.row.doc_id
        words, sents = sentences(docs[k])
        assert (r.n_sentences, r.n_removed) == (len(sents), len(expected[k]))
        assert WORD.findall(lowered(r.text)) == [w for s, (a, z) in enumerate(sents) if s not in expected[k] for w in words[a:z]]
        if not expected[k]:
            assert r.text == docs[k]


def test_shared_passages_of_fifty_words_stay_once(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 9)))
    prose = lambda n: " ".join(word() + (rnd.choice([".", "", "", "", ""]) if i % 2 else "") for i in range(n))
    plain = " ".join(word() for _ in range(80))  # without a full stop
    passages = [prose(60), prose(55) + ".", plain]
    around = lambda p: f"{prose(40)}.\n{p}\n{prose(30)}." if p is not plain else f"{prose(9)} {p} {prose(9)}"  # noqa: E731  the last in the middle of a sentence
    docs = [(k, around(passages[k % 3])) for k in range(12)] + [(100 + k, prose(120)) for k in range(6)]
    got = {r.row.doc_id: r.text for r in spans.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for n, p in enumerate(passages):
        middle = " ".join(p.split()[20:40])
        assert [k for k, t in got.items() if middle in t] == [n]
    assert all(got[k] == t for k, t in docs if k >= 100 or k < 3)


# 3 chat


def test_chat_fold_and_round_trip(spark):
    rnd = random.Random(5)
    bits = ["###", "</turn>", "\\", "<", "#", " ok ", "\n", "### user: ", "é", ":"]
    events, expected = [], {}
    for conv in range(30):
        messages, seq = {}, 0
        for m in range(rnd.randint(1, 5)):
            role = rnd.choice(["user", "assistant", "sys:tem"])
            events.append((conv, seq, "open", m, role, ""))
            messages[m] = [role, ""]
            for _ in range(rnd.randint(0, 5)):
                seq += 1
                op, text = rnd.choice(["delta", "delta", "delta", "edit", "regenerate"]), "".join(rnd.choice(bits) for _ in range(3))
                at = rnd.choice(list(messages))
                events.append((conv, seq, op, at, None, text))
                if op == "delta":
                    messages[at][1] += text
                elif op == "edit":
                    messages[at][1] = text
                else:
                    messages[at][1] = ""
                    messages = {k: v for k, v in messages.items() if k <= at}
            seq += 1
        expected[conv] = [tuple(v) for _, v in sorted(messages.items())]
    rnd.shuffle(events)
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, op string, msg bigint, role string, text string").repartition(5)
    for r in chat.formatted(df).collect():
        assert chat.read_back(r.formatted) == expected[r.conv_id]
        assert [chat.unescape(r.formatted[m.start : m.stop]) for m in r["mask"]] == [t for role, t in expected[r.conv_id] if role == "assistant"]
    with pytest.raises(ValueError):
        chat.read_back("### user: x")


# 4 cascade


def test_measures_and_verdicts(documents, texts):
    for r in cascade.apply(documents).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines = Counter(x for x in t.split("\n") if WORD.search(x))
        dup, worded = sum(lines.values()) - len(lines), sum(lines.values())
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), symbols, dup, len(hit))
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        upper, letters = len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))
        lettered = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
        bad = 10 * symbols > len(w) or not 2 * len(w) <= r.word_chars <= 15 * len(w) or 2 * dup > worded or 10 * upper > 3 * letters or 10 * lettered < 7 * len(w)
        worded_lines = [x for x in t.split("\n") if WORD.search(x)]
        pairs = Counter(zip(w, w[1:], strict=False))
        bad |= 10 * sum(x.strip(" \t\r\v\f")[0] in "-*•" for x in worded_lines) > 9 * worded or 10 * sum(x.rstrip(" \t\r\v\f").endswith("...") for x in worded_lines) > 3 * worded
        bad |= 5 * max(pairs.values(), default=0) > sum(pairs.values())
        assert (r.base_failed, r.kept) == (base, not (base or bad))


def test_the_order_follows_rejections_per_cost_and_changes_no_verdict(documents):
    import time

    def slow(page, rows):
        time.sleep(0.02)
        return page.n_words[rows] > 100

    cheap = cascade.Rule("cheap", lambda page, rows: page.n_words[rows] > 100)
    useless = cascade.Rule("useless", lambda page, rows: np.zeros(len(rows), bool))
    rules = (useless, cascade.Rule("slow", slow), cheap)
    order = cascade.plan(documents, rules)
    assert order[0] == "cheap"
    assert cascade.plan(documents.where("false"), rules) == ["useless", "slow", "cheap"]
    # what a rule rejects beyond those before it counts, not what it rejects alone
    bits = np.array([0b0011, 0b0011, 0b0011, 0b0100, 0b1111, 0b1111])
    three = tuple(cascade.Rule(n, None) for n in "abc")
    assert cascade.ordered(three, np.array([1.0, 1.1, 1.2]), bits) == ["a", "c", "b"]
    verdicts = [{r.doc_id: r.kept for r in cascade.apply(documents, rules, order=o).collect()} for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


# 5 revisits


def test_revisits_against_a_loop(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        url = f"http://h{rnd.choice([0, 0, 0, 1, 2])}.org/p{rnd.randint(0, 3)}"
        if rnd.random() < 0.5:
            rows.append((i, url, rnd.randint(0, 3000), "response", {"etag": f"e{rnd.randint(0, 2)}", "content-type": "html", "date": f"r{i}", "vary": "a"}, f"body {i}"))
        else:
            rows.append((i, url, rnd.randint(0, 3000), "revisit", rnd.choice([{"etag": f"e{rnd.randint(0, 2)}", "date": f"v{i}", "content-type": "bad"}, {}]), None))
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, payload string").repartition(6)).collect()}
    for i, url, ts, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
        r = got.pop(i)
        if not before:
            assert r.outcome == "missing"
            continue
        full = max(before, key=lambda x: (x[2], x[0]))
        if not headers:
            assert r.outcome == "unverified"
        elif headers["etag"] != full[4]["etag"]:
            assert r.outcome == "mismatch" and r.payload is None
        else:
            assert (r.outcome, r.source_id, r.payload, r.headers) == ("resolved", full[0], full[5], {"etag": headers["etag"], "date": headers["date"], "content-type": "html", "vary": "a"})
    assert not got


def test_canonical_urls(spark):
    pairs = [("HTTP://User@WWW.Example.COM:80/A/b/?b=2&utm_source=x&a=1#f", "example.com/A/b?a=1&b=2"), ("https://example.com", "example.com"), ("https://m.x.org/?", "m.x.org"), (None, ""), ("//odd?q", "//odd?q")]
    got = spark.createDataFrame([(u,) for u, _ in pairs], "url string").select(revisits.canonical(F.col("url")).alias("c")).collect()
    assert [r.c for r in got][:4] == [c for _, c in pairs][:4]


# 6 near duplicates


def shingles_of(text):
    w = WORD.findall(lowered(text))
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def plain_classes(texts):
    bags = {k: shingles_of(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = bags[a], bags[b]
            near = texts[a] == texts[b]
            if x and y and not near and 0.8 * len(x) <= 1.26 * len(y):
                common = len(x.keys() & y.keys())
                shared, total = sum((x & y).values()), sum((x | y).values())
                near = common / (len(x) + len(y) - common) >= 0.8 or shared / total >= 0.8
            if near:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}


def test_classes_against_all_pairs(spark, documents, texts):
    rnd = random.Random(7)
    more, base = dict(texts), [t for t in texts.values() if 40 < len(t.split()) < 400][:6]
    for i in range(120):  # many copies of a few, altered more and less, linked in chains
        w = base[i % 6].split()
        for _ in range(rnd.randint(0, max(1, len(w) // 25))):
            w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 999)}"
        more[10_000 + i] = " ".join(w)
    expected = plain_classes(more)
    got = {r.id: r.class_id for r in dartminhash.classes(spark.createDataFrame(list(more.items()), "doc_id bigint, text string").repartition(6)).collect()}
    assert got == expected


def test_texts_alike_but_for_counts_meet(spark):
    rnd = random.Random(17)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    texts = {}
    for i in range(0, 60, 3):  # a text, the text three times over, and the text with one line many times
        body = prose(200)
        texts |= {i: body, i + 1: " ".join([body] * 3), i + 2: body + "\n" + "\n".join([prose(10)] * 20)}
    expected = plain_classes(texts)
    assert expected == {k: k - k % 3 for k in texts}
    got = {r.id: r.class_id for r in dartminhash.classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)).collect()}
    assert got == expected


def test_large_buckets_are_dealt_by_rare_shingles(spark, monkeypatch):
    """Texts of templates, most of them just below or far below the threshold, and some above it."""
    rnd = random.Random(27)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    texts = {}
    for t, own in ((0, 60), (1, 26), (2, 18)):
        body = [prose(20) for _ in range(8)]
        for i in range(40):
            texts[100 * t + i] = "\n".join([*body, prose(own)])
        for i in range(40, 50):  # near copies of some of them, and the text with one line many times
            texts[100 * t + i] = texts[100 * t + i - 40] + (" some words more" if i % 2 else ("\n" + prose(10)) * 12)
    expected = plain_classes(texts)
    assert 1 < len(set(expected.values())) < len(texts)
    monkeypatch.setattr(dartminhash, "BLOCK", 6)
    sizes = []
    real = dartminhash.narrowed

    def seen(*args):
        out = real(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(dartminhash, "narrowed", seen)
    got = {r.id: r.class_id for r in dartminhash.classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)).collect()}
    assert got == expected and sizes


def test_recall_of_the_bands_on_both_branches():
    """Pairs at similarity 0.8 to 0.82 of one kind and far less of the other: the share that meets in a band."""
    rnd = random.Random(28)
    word = lambda: f"w{rnd.randrange(10**7)}"
    pairs = {"plain": [], "weighted": []}
    for _ in range(500):
        a = [word() for _ in range(104)]
        b = [*a, *(word() for _ in range(20))]
        line = [word() for _ in range(6)]
        pairs["plain"].append((" ".join(a), " ".join(b[:-6] + line * 40)))
        head = [word() for _ in range(5)] * 60  # 300 shingles, five distinct ones
        pairs["weighted"].append((" ".join(head + [word() for _ in range(37)]), " ".join(head + [word() for _ in range(35)])))
    for kind, some in pairs.items():
        exact = []
        for x, y in some:
            p, q = shingles_of(x), shingles_of(y)
            exact.append((len(p.keys() & q.keys()) / len(p.keys() | q.keys()), sum((p & q).values()) / sum((p | q).values())))
        near, far = (0, 1) if kind == "plain" else (1, 0)
        assert all(0.8 <= e[near] <= 0.85 and e[far] < 0.5 for e in exact)
        flat = [t for pair in some for t in pair]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(flat))), pa.array(range(len(flat))), pa.array(range(len(flat))), pa.array(flat)], names=["id", "k1", "k2", "text"])
        keys = {i: set(k) for b in dartminhash.sign([batch]) for i, k in zip(b.column("id").to_pylist(), b.column("bands").to_pylist(), strict=True)}
        met = sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(some)))
        assert met >= 0.99 * len(some), (kind, met)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rnd = random.Random(29)
    prose = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b, c = prose(), prose(), prose()
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "y"), (7, b, "z"), (8, c, "u"), (8, c, "u"), (9, a + " more", "v")], "doc_id bigint, text string, source string")
    assert Counter((r.id, r.class_id) for r in dartminhash.classes(docs).collect()) == Counter([(5, 5), (5, 5), (7, 5), (8, 8), (8, 8), (9, 5)])
    assert sorted(r.text[:20] for r in dartminhash.keep_first(docs).collect()) == sorted(x[:20] for x in (a, b, c))


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(8)
    a = {i: rnd.choice([0.5, 1, 2, 7]) for i in range(200)}
    b = {i: rnd.choice([a.get(i, 1), a.get(i, 1), 3]) for i in range(60, 260)}
    every = a.keys() | b.keys()
    j = sum(min(a.get(i, 0), b.get(i, 0)) for i in every) / sum(max(a.get(i, 0), b.get(i, 0)) for i in every)
    k = 4096
    sig = [dartminhash.signatures(1, np.zeros(len(x), int), dartminhash.mix(np.array(list(x), np.uint64)), np.array(list(x.values()), float), k)[1][0] for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - j) < 4 * math.sqrt(j * (1 - j) / k)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)] + [(90, 130)]
    got = {r.id: r.root for r in dartminhash.components(spark.createDataFrame(chain + star + [(5, 5)], "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 90 for i in [90, *range(100, 160)]}


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "BLOCK", 4)
    rows = [(1, i, i, 24) for i in range(24)]
    texts = spark.createDataFrame([(i, f"one two three four five six seven eight nine w{i // 2} " + f"tail{i // 2} " * 8) for i in range(24)], "id bigint, text string")
    dealt = dartminhash.spread(spark.createDataFrame(rows, "key bigint, id bigint, root bigint, n bigint"))
    got = {tuple(sorted((r.a, r.b))) for r in dartminhash.resolved(dealt, texts).collect()}
    assert got == {(i, i + 1) for i in range(0, 24, 2)}


def test_a_large_component_is_dealt_once_for_each_block_of_the_others(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "BLOCK", 4)
    rows = [(1, i, 0 if i < 100 else 500 if i < 110 else i) for i in range(113)] + [(2, i, i) for i in range(3)]
    dealt = dartminhash.spread(spark.createDataFrame(rows, "key bigint, id bigint, root bigint")).collect()
    times = Counter((r.key, r.id) for r in dealt)
    # 25 blocks of the first root, 3 of the second, 1 of three others
    assert all(times[1, i] == 4 for i in range(100)) and all(times[1, i] == 26 for i in range(100, 110)) and all(times[1, i] == 29 for i in range(110, 113)) and all(times[2, i] == 1 for i in range(3))
    places = defaultdict(set)
    for r in dealt:
        places[r.key, r.lo, r.hi].add((r.id, r.root))
    met = {(a, b) for ms in places.values() for a, x in ms for b, y in ms if x != y}
    assert {(a, b) for k, a, x in rows for j, b, y in rows if k == j == 1 and x != y} <= met


# 7 votes


def test_held_out_accuracy(spark, sf_dir):
    top = "/root/testdata/sf0.01"
    r = queries.op7_neighbour_vote(spark, top).join(spark.read.parquet(f"{top}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(r) > 80 and sum(x.predicted == x.quality for x in r) / len(r) > 0.95
    assert all(x.predicted == (x.score >= 0.5) for x in r)


def test_votes_against_a_full_sort(documents, labels, texts):
    """Scores from the fitted directions, in double precision, with every labelled row sorted by its cosine."""
    model = knn.fit(documents, labels.where(doc_remainder(3) != 1))
    s, basis = model.settings, model.basis.astype(float)

    def latent(x):
        x = x.astype(float) * model.idf
        v = x / max(np.linalg.norm(x), 1e-9) @ basis
        return v / max(np.linalg.norm(v), 1e-9)

    assert s.terms == "both" and model.vectors.shape == (len(model.labels), s.rank)
    share = model.labels.mean()
    checked = 0
    for r in knn.score(documents.select("doc_id", "text"), model, carry=["doc_id"]).collect():
        v = latent(knn.profiles_of([texts[r.doc_id]])[0])
        cos = sorted(((float(v @ w), int(y)) for w, y in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)
        if abs(cos[s.k - 1][0] - cos[s.k][0]) < 1e-5:
            continue  # a tie at the last place
        votes = [(max(c, 0) ** s.sharpness * (0.5 / share if y else 0.5 / (1 - share)), y) for c, y in cos[: s.k]]
        assert abs(r.score - sum(x * y for x, y in votes) / sum(x for x, _ in votes)) < 1e-3
        checked += 1
    assert checked > 0.8 * len(texts)


def test_labels_of_held_out_rows_change_nothing(documents, labels):
    train = labels.where(doc_remainder(3) != 1)
    a = knn.fit(documents, train)
    b = knn.fit(documents, labels.withColumn("quality", F.when(doc_remainder(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality"))).where(doc_remainder(3) != 1))
    assert (a.labels == b.labels).all() and np.array_equal(a.vectors, b.vectors)
    assert knn.fit(documents, train, sample=10).vectors.shape[0] == 10


def test_settings_are_judged_by_folds_without_copies():
    rng = np.random.default_rng(3)
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
    texts = [" ".join(rng.choice(words, 40)) + "." for _ in range(40)] + ["#!" * int(rng.integers(20, 60)) for _ in range(40)]
    x, y = knn.profiles_of(texts), np.repeat([1, 0], 40)
    grid = [knn.Settings(8, 3, 1.0), knn.Settings(4, 3, 1.0, "runs")]
    got = knn.cross_validated(x, y, np.arange(80), grid)
    assert got[0][0] == 0 and len(got) == 2
    # one group: there is no other fold to learn from, and every row scores 0.5
    assert knn.cross_validated(x, y, np.zeros(80, int), grid[:1]) == [(0.5, 0.25)]


# 8 ring


def test_ring_against_plain_bounded_loads(documents):
    shards = 5
    rows = documents.select("doc_id", ring.key_of().alias("key"), ring.cell_of(ring.key_of()).alias("cell")).collect()
    nodes = ring.nodes(shards)
    rooms = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]

    def walk(cell):
        seen = []
        for step in range(len(nodes)):
            s = nodes[(cell + step) % len(nodes)]
            if s is not None and s not in seen:
                seen.append(s)
        return seen

    prefer = {c: walk(c) for c in {r.cell for r in rows}}
    todo, expected = sorted(((r.cell, r.key, r.doc_id) for r in rows)), {}
    for choice in range(shards):
        rest = []
        for cell, key, doc in todo:
            s = prefer[cell][choice]
            if rooms[s]:
                rooms[s] -= 1
                expected[doc] = s
            else:
                rest.append((cell, key, doc))
        todo = rest
    assert {r.doc_id: r.shard for r in ring.assign(documents, shards).collect()} == expected


def test_hot_keys_and_full_cells_are_ranked_in_parts(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("if(id < 3000, 7, id) as doc_id", "if(id < 1000, 'same', concat('t', id)) as text").repartition(5)
    whole = {(r.doc_id, r.text_crc32): r for r in ring.assign(rows, 4, cells=512, per_shard=64).collect() if r.doc_id != 7}
    monkeypatch.setattr(ring, "PART_ROWS", 10)
    sizes = []
    monkeypatch.setattr(ring, "cut", lambda df, real=ring.cut: (lambda out: (sizes.extend(r["count"] for r in out.groupBy("cell", "range", "part").count().collect()) if "part" in out.columns else None, out)[1])(real(df)))
    got = ring.assign(rows, 4, cells=512, per_shard=64).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 6000 and all(sorted(x) == list(range(1500)) for x in slots.values())
    assert sizes and max(sizes) <= 40 and sum(sizes) == 6000
    # where no key fills a part, keys are ranked in the same order as in one piece
    same = [r.shard == whole[r.doc_id, r.text_crc32].shard for r in got if r.doc_id != 7]
    assert sum(same) > 0.95 * len(same)


def test_growth_moves_little_and_only_what_it_must(documents):
    a, b = ring.nodes(8), ring.nodes(9)
    assert all(y in (x, 8) for x, y in zip(a, b, strict=True) if x is not None) and Counter(b)[8] == ring.NODES
    before, after = ({r.doc_id: r.shard for r in ring.assign(documents, n, slack=0.25).collect()} for n in (8, 9))
    assert sum(before[k] != after[k] for k in before) < 0.4 * len(before)


def test_sizes_and_checksums(documents, texts):
    for r in ring.assign(documents).collect():
        b = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))


# 9 decontamination


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_matches_against_full_alignment(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = {i: prose(rnd.randint(4, 40)) for i in range(8)} | {8: prose(3)[:19], 9: prose(4)[:21]}
    docs, expected = [], set()
    for d in range(60):
        i = rnd.choice(list(items))
        p = list(items[i])
        for _ in range(rnd.randint(0, int(0.09 * len(p)))):
            at = rnd.randrange(len(p))
            p[at : at + rnd.choice([0, 1])] = rnd.choice(["", "q", "zz"])
        text = rnd.choice(["", prose(20) + " "]) + "".join(p) + rnd.choice(["", " " + prose(20)])
        docs.append((d, text))
        for j, item in items.items():
            e = edits(item, re.sub(" +", " ", text))
            if e <= decontam.budget(len(item)):
                expected.add((d, j, e))
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontam.matches(df, bench).collect()} == expected
    before, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 300  # several blocks
    try:
        assert {(r.doc_id, r.item_id, r.edits) for r in decontam.matches(df, bench).collect()} == expected
        assert {r.doc_id for r in decontam.clean(df, bench).collect()} == set(range(60)) - {d for d, *_ in expected}
    finally:
        decontam.BLOCK_BYTES = before


def test_hits_in_slices_are_the_same_hits(monkeypatch):
    items = [(1, b"a" * 90), (2, b"the quick brown fox jumps over the lazy dog again and again")]
    raw = [b"a" * 4000, b"x " + items[1][1].replace(b"lazy", b"lzy") + b" y", b"ab" * 300 + b"a" * 88, b""]
    texts = decontam.plain(decontam.Scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))[0]
    whole = list(decontam.Index(items).verified(texts))
    assert {(d, i) for d, i, *_ in whole} == {(0, 0), (1, 1), (2, 0)}
    monkeypatch.setattr(decontam, "HITS", 50)
    assert list(decontam.Index(items).verified(texts)) == whole


def test_exact_passages_are_found_where_they_are(documents, benchmark, texts):
    items = {r.item_id: r.text for r in benchmark.collect()}
    rows = decontam.matches(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} >= {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    for r in rows:
        assert r.edits or lowered(texts[r.doc_id][r.start : r.stop]).split() == lowered(items[r.item_id]).split()


# 10 language model


class PlainModel:
    """The same probabilities from dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.c = {1: Counter(), 2: Counter(), 3: Counter()}
        for ws in texts:
            padded = [None, None, *ws]
            for i in range(2, len(padded)):
                self.c[1][padded[i]] += 1
                self.c[2][tuple(padded[i - 1 : i + 1])] += 1
                self.c[3][tuple(padded[i - 2 : i + 1])] += 1
        self.n, self.v, self.texts = sum(self.c[1].values()), len(self.c[1]), self.c[1][None]

    def p(self, g, h, w):
        m2, m3 = bloomlm.MASS
        p1 = (self.c[1][w] + 1) / (self.n + self.v + 1)
        p2 = (self.c[2][h, w] + m2 * p1) / (self.c[1][h] + m2)
        if self.order == 2:
            return p2
        return (self.c[3][g, h, w] + m3 * p2) / ((self.texts if h is None else self.c[2][g, h]) + m3)

    def score(self, ws):
        padded = [None, None, *ws]
        return sum(math.log10(self.p(*padded[i - 2 : i + 1])) for i in range(2, len(padded)))


@pytest.mark.parametrize(("order", "hot", "broadcast"), [(2, 1 << 19, 1 << 30), (2, 300, 1 << 30), (2, 300, 0), (3, 1 << 19, 1 << 30), (3, 300, 0)])
def test_scores_against_dictionaries(documents, texts, order, hot, broadcast):
    docs = bloomlm.held_out(documents)
    # so many bits that there are no false positives
    model = bloomlm.Model(docs.where("not held_out"), hot_words=hot, broadcast_bytes=broadcast, route_bytes=1 << 16, bits=400, order=order)
    assert model.fits == (broadcast > 0) and len(model.hot[0]) <= hot and (model.fits or model.per_route < model.buckets)
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    tokens = {k: [*WORD.findall(lowered(t)), None] for k, t in texts.items()}
    plain = PlainModel([ws for k, ws in tokens.items() if not held[k]], order)
    sums, rows = Counter(), bloomlm.score(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(plain.c[1][w] > 0 for w in ws), plain.n)
        assert math.isclose(r.base_score, sum(math.log10((plain.c[1][w] + 1) / (plain.n + plain.v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(ws), rel_tol=1e-9)
        sums[r.held_out, "base"] += r.base_score
        sums[r.held_out, "model"] += r.score
    assert sums[True, "model"] > sums[True, "base"] and sums[False, "model"] > sums[False, "base"]


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(texts, order):
    plain = PlainModel([[*WORD.findall(lowered(t)), None] for t in texts.values()], order)
    words = [*plain.c[1], "a word that never was"]
    rnd = random.Random(10)
    pairs = [p for p in plain.c[2] if p[1] is not None]
    for g, h in [(None, None), *rnd.sample(pairs, 20), ("never", "seen"), ("never", "the")]:
        assert abs(sum(plain.p(g, h, w) for w in words) - 1) < 1e-6


def test_the_filter_of_production_size_changes_scores_little(documents, texts):
    docs = bloomlm.held_out(documents)
    a, b = ({r.doc_id: r for r in bloomlm.score(docs, bloomlm.Model(docs.where("not held_out"), bits=bits)).collect()} for bits in (bloomlm.BITS_PER_ENTRY, 400))
    per = [abs(a[k].score - b[k].score) / a[k].n_tokens for k in a]
    assert np.mean(per) < 0.01 and all(a[k].base_score == b[k].base_score for k in a)


def test_filter_counts_never_fall_short():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    counts = rnd.integers(1, 5000, 5000)
    words = math.ceil(bloomlm.entries(counts).sum() * bloomlm.BITS_PER_ENTRY / 64)
    one = bloomlm.Filter(1, 0, 1, {1: words})
    one.put(1, 0, bloomlm.segment(h, counts, words).astype("<u8").tobytes())
    got = one.counts(1, h)
    assert (got >= counts).all() and (got > counts).mean() < 0.1
    assert (one.counts(1, rnd.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.02
    assert bloomlm.quantised(np.array([0, 1, 6, 7, 1000]), 1).tolist() == [0, 1, 6, 6, 768]


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_pipeline_stages(spark, sf_dir, documents, labels, texts):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_spans", "decontamination", "packing"]
    docs, seen = documents, []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs.persist()
        seen.append({r.doc_id: r for r in docs.collect()} if "text" in docs.columns else docs.collect())
        if "text" in docs.columns:
            assert docs.columns == documents.columns
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(k in seen[0] for k, q in good.items() if q) >= 0.95 * sum(good.values()) and sum(k in seen[0] for k, q in good.items() if not q) <= 0.1 * sum(1 - q for q in good.values())
    classes = plain_classes({k: r.text for k, r in seen[0].items()})
    assert set(seen[1]) == set(classes.values())
    assert set(seen[2]) == set(seen[1]) and all(r.n_chars == len(r.text) for r in seen[2].values())
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {k for k, r in seen[2].items() if not any(lowered(i) in lowered(r.text) for i in items)} >= set(seen[3])
    assert {r.doc_id for r in seen[4]} == set(seen[3]) and sorted(Counter(r.start for r in seen[4]).items())[0] == (0, len(seen[3]))
    assert cp.run(spark, sf_dir).count() == len(seen[4])
