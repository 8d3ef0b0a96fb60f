"""Language-model scores from a log-frequency Bloom filter.

Training counts words and pairs of words (and triples, if the order is 3); an end token stands before a text.  A distinct n-gram with count c has a level
1 + floor(log2 c).  The filter holds the n-gram once for each level from 1 to its own, and once more for each of the ``DIGITS`` binary digits after the leading one
that is set.  A worker finds a count again by probing level 1, 2, ... until the first that is missing, then the digits; most n-grams occur once and are one entry.
With all digits (the default) counts of the words after a history add up to the history's own, so probabilities do, too.

    p1(w) = (c(w) + 1) / (N + V + 1)                    V words and one that stands for all others
    p2(w | h) = (c(h w) + m2 p1(w)) / (c(h) + m2)
    p3(w | g h) = (c(g h w) + m3 p2(w | h)) / (c(g h) + m3)

For every history these sum to 1 over the V + 1 words.  False positives of the filter (about one in a hundred probes for what is absent) raise single counts; a
pair's count is held under its words', a triple's under its pairs'.  ``MASS`` (m2, m3) was chosen on a seventh of sf0.1's training rows.

Counting moves packed blobs instead of rows: a task reduces what it reads to distinct hashes and
counts, cut into buckets by the hash's leading bits; a bucket's blobs meet in one group, whose size is
held down by the number of buckets, which follows the input.  Frequent words are one entry per blob, so no
key is hot.  Nothing that occurs is left out.

A filter of up to ``BROADCAST_BYTES`` is broadcast, and the texts are read once.  A larger one stays where its buckets are (so no worker or broadcast
ever holds more than that), and the probes go there: each chunk of texts sends its distinct n-grams to their routes in one shuffle, the counts come back in a second one and meet the
chunk again.  Chunks know each other by a hash of their contents.  Both ways give the same scores.

Exact counts (for the add-one base model) come from two sides: words frequent enough that at most ``HOT_WORDS``
of them can exist are broadcast; the rest join by hash.

Null texts are empty and score their end token alone; equal rows score alike; an empty table gives an empty result;
words are known by 64-bit hashes.  Without training texts every word is the unknown one, and scores are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, doc_remainder, text_of
from .textscan import Scan, counted, mix, scans

HOT_WORDS = 1 << 19
BITS_PER_ENTRY = 12
PROBE_BITS = 5
DIGITS = 32
BROADCAST_BYTES = 160 << 20
ROUTE_BYTES = 48 << 20
BUCKET_BYTES = 2 << 20
PENDING = 1 << 20
MASS = (1024.0, 4.0)  # what all words share of a pair's and a triple's history
ORDER = 2
END = np.uint64(0xE7037ED1A0B428DB)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(3) + mix(right ^ np.uint64(0xA0761D6478BD642F)))


def tokens(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end token, in order, and where each text's tokens start and end."""
    per = np.diff(scan.word_off) + 1
    off = np.concatenate([[0], np.cumsum(per)])
    out = np.full(off[-1], END, np.uint64)
    out[np.arange(len(scan.word_hash)) + scan.word_doc] = scan.word_hash
    return out, off


def grams(tok: np.ndarray, order: int = ORDER) -> dict[int, np.ndarray]:
    """By order up to the given one, the n-gram that ends at each token.  An end token precedes the next text, as it does its first word's pair; a second one precedes its triple."""
    before = np.full_like(tok, END)
    before[1:] = tok[:-1]
    pair = pair_hash(before, tok)
    if order < 3:
        return {1: tok, 2: pair}
    history = np.empty_like(tok)
    history[:1] = END
    history[1:] = pair[:-1]
    history[before == END] = END  # the start of a text, whatever was before it
    return {1: tok, 2: pair, 3: pair_hash(history ^ np.uint64(0x5851F42D4C957F2D), tok)}


def planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers by byte planes, compressed: leading bytes of sorted hashes and of small counts are alike."""
    return pa.compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes(), codec="zstd", asbytes=True)


def from_planes(b: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(b, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


BLOB = "gram int, bucket int, n long, hashes binary, counts binary"


def packed(docs: DataFrame, buckets: int, order: int = ORDER) -> DataFrame:
    """Partial counts of n-grams up to the order."""

    def flush(gram, held):
        h, c = counted(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        at = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(at)):
            part = slice(at[k], at[k + 1])
            rows.append((gram, int(k), int(at[k + 1] - at[k]), planes(h[part], "<u8"), planes(np.minimum(c[part], 0xFFFFFFFF), "<u4")))
            if len(rows) == 256:
                yield blobs(rows)
                rows = []
        if rows:
            yield blobs(rows)

    def blobs(rows):
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "bucket", "n", "hashes", "counts"])

    def count(batches):
        held, size = {g: [] for g in range(1, order + 1)}, dict.fromkeys(range(1, order + 1), 0)
        for b in batches:
            for scan in scans(b, lower=True):
                for gram, keys in grams(tokens(scan)[0], order).items():
                    held[gram].append(counted(keys))
                    size[gram] += len(held[gram][-1][0])
                    if size[gram] >= PENDING:
                        yield from flush(gram, held[gram])
                        held[gram], size[gram] = [], 0
        for gram in held:
            if held[gram]:
                yield from flush(gram, held[gram])

    return docs.select(text_of().alias("text")).mapInArrow(count, BLOB)


def merged(blobs: DataFrame) -> DataFrame:
    """Whole counts, one row per gram and bucket; ``entries`` counts the filter's insertions."""

    def merge(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        h = np.concatenate([from_planes(x.as_py(), "<u8", n) for x, n in zip(table.column("hashes"), sizes, strict=True)]).astype(np.uint64)
        c = np.concatenate([from_planes(x.as_py(), "<u4", n) for x, n in zip(table.column("counts"), sizes, strict=True)])
        h, c = counted(h, c)
        hist = np.bincount(np.floor(8 * np.log2(np.maximum(c, 1))).astype(int), minlength=1)
        return pa.table({
            "gram": table.column("gram").combine_chunks()[:1], "bucket": table.column("bucket").combine_chunks()[:1], "n": pa.array([len(h)], pa.int64()),
            "total": pa.array([int(c.sum())], pa.int64()), "entries": pa.array([int(entries(c).sum())], pa.int64()),
            "hist": pa.array([hist.tolist()], pa.list_(pa.int64())), "hashes": pa.array([planes(h, "<u8")], pa.binary()), "counts": pa.array([planes(c, "<i8")], pa.binary()),
        })

    return blobs.groupBy("gram", "bucket").applyInArrow(merge, "gram int, bucket int, n long, total long, entries long, hist array<long>, hashes binary, counts binary")


def level_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


def quantised(c: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """A count's leading binary digits; the rest is 0."""
    low = np.maximum(level_of(c) - 1 - digits, 0)
    return np.where(c > 0, c >> low << low, 0)


def entries(c: np.ndarray) -> np.ndarray:
    """How often an n-gram of each count is in the filter."""
    return level_of(c) + np.bitwise_count(quantised(c).astype(np.uint64)).astype(np.int64) - 1


def probe(h: np.ndarray, at: np.ndarray | int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of 64 bits within a segment where an n-gram's level (or digit, from 64 on) lies, and its bits there."""
    a = mix(h + np.asarray(at, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.zeros(len(a), np.uint64)
    for k in range(PROBE_BITS):
        bits |= np.uint64(1) << (a >> np.uint64(6 * k) & np.uint64(63))
    return ((a >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), bits


def segment(h: np.ndarray, c: np.ndarray, words: int) -> np.ndarray:
    """The words of one bucket."""
    out = np.zeros(64 * words, bool)
    c = quantised(c)
    level = level_of(c)
    top = int(level.max(initial=0))
    for j, rows in [*((j, level >= j) for j in range(1, top + 1)), *((64 + j, (level - 1 > j) & (c >> j & 1 > 0)) for j in range(top - 1))]:
        a = mix(h[rows] + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        base = ((a >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64) * 64
        for k in range(PROBE_BITS):
            out[base + (a >> np.uint64(6 * k) & np.uint64(63)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view("<u8")


class Filter:
    """Consecutive buckets of the filter: for each gram, segments of equal size, one after the other."""

    def __init__(self, buckets: int, low: int, high: int, words: dict[int, int]):
        self.buckets, self.low, self.high, self.words = buckets, low, high, words
        self.data = {g: np.zeros((high - low) * w, np.uint64) for g, w in words.items()}

    def put(self, gram: int, bucket: int, seg: bytes) -> None:
        at = (bucket - self.low) * self.words[gram]
        self.data[gram][at : at + self.words[gram]] = np.frombuffer(seg, "<u8")

    def counts(self, gram: int, h: np.ndarray) -> np.ndarray:
        """The count of each n-gram of these buckets."""
        data, words = self.data[gram], self.words[gram]
        base = (bucket_of(h, self.buckets) - self.low) * words
        level = np.zeros(len(h), np.int64)
        at, j = np.arange(len(h)), 1
        while len(at):
            place, bits = probe(h[at], j, words)
            at = at[data[base[at] + place] & bits == bits]
            level[at] = j
            j += 1
        out = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
        for j in range(int(level.max(initial=0)) - 1):
            at = np.flatnonzero((level - 1 > j) & (level - 1 - j <= DIGITS))
            place, bits = probe(h[at], 64 + j, words)
            out[at] += (data[base[at] + place] & bits == bits).astype(np.int64) << j
        return out


class Model:
    """Counts of the training texts: the merged blobs (checkpointed), totals, frequent words."""

    def __init__(self, docs: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES, route_bytes: int = ROUTE_BYTES, hot_words: int = HOT_WORDS, bits: int = BITS_PER_ENTRY, order: int = ORDER):
        if order not in (2, 3):
            raise ValueError("the order is 2 or 3")
        self.spark, self.order = docs.sparkSession, order
        size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
        self.buckets = max(64, math.ceil(size / BUCKET_BYTES))
        self.counts = cut(merged(packed(docs, self.buckets, order)))
        sums = {r["gram"]: r for r in self.counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("entries").alias("entries")).collect()}
        self.tokens = sums[1]["total"] if 1 in sums else 0
        self.vocabulary = sums[1]["n"] if 1 in sums else 0
        self.words = {g: max(8, math.ceil((sums[g]["entries"] if g in sums else 0) * bits / self.buckets / 64)) for g in range(1, order + 1)}
        per_bucket = 8 * sum(self.words.values())
        self.size = per_bucket * self.buckets
        self.fits = self.size <= broadcast_bytes
        self.per_route = max(1, min(self.buckets, route_bytes // per_bucket))
        self._frequent(hot_words)

    def _frequent(self, most: int) -> None:
        """Words whose count is at least ``floor``, the lowest bound that at most ``most`` words reach."""
        hist = self.counts.where("gram = 1").select(F.posexplode("hist").alias("bin", "k")).groupBy("bin").agg(F.sum("k").alias("k")).collect()
        above, floor = 0, float("inf")
        for r in sorted(hist, key=lambda r: -r["bin"]):
            above += r["k"]
            if above > most:
                break
            floor = 2 ** (r["bin"] / 8)
        self.floor = floor = 1 if not hist else math.ceil(floor) if floor < float("inf") else 1 << 62

        def pick(batches):
            for b in batches:
                hs, cs = [], []
                for x, y, n in zip(b.column("hashes"), b.column("counts"), b.column("n").to_pylist(), strict=True):
                    h, c = from_planes(x.as_py(), "<u8", n), from_planes(y.as_py(), "<i8", n)
                    if (c >= floor).any():  # no row to the driver for other buckets
                        hs.append(h[c >= floor].tobytes())
                        cs.append(c[c >= floor].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], names=["hashes", "counts"])

        got = self.counts.where("gram = 1").select("n", "hashes", "counts").mapInArrow(pick, "hashes binary, counts binary").collect()
        h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["hashes"], "<u8").astype(np.uint64) for r in got)])
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], "<i8").astype(np.int64) for r in got)])
        order = np.argsort(h)
        self.hot = (h[order], c[order])

    def rare(self) -> DataFrame:
        """(hash, c) of the words below the floor."""
        floor = self.floor

        def rows(batches):
            for b in batches:
                for x, y, n in zip(b.column("hashes"), b.column("counts"), b.column("n").to_pylist(), strict=True):
                    h, c = from_planes(x.as_py(), "<u8", n), from_planes(y.as_py(), "<i8", n)
                    yield pa.RecordBatch.from_arrays([pa.array(h[c < floor].view(np.int64)), pa.array(c[c < floor].astype(np.int64))], names=["hash", "c"])

        return self.counts.where("gram = 1").select("n", "hashes", "counts").mapInArrow(rows, "hash long, c long")

    def segments(self) -> DataFrame:
        """(gram, bucket, seg): the filter's parts, made on the workers."""
        words = self.words

        def build(batches):
            for b in batches:
                cols = (b.column(c).to_pylist() for c in ("gram", "n", "hashes", "counts"))
                segs = [segment(from_planes(h, "<u8", n).astype(np.uint64), from_planes(c, "<i8", n), words[g]).astype("<u8").tobytes() for g, n, h, c in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("gram"), b.column("bucket"), pa.array(segs, pa.binary())], names=["gram", "bucket", "seg"])

        return self.counts.select("gram", "bucket", "n", "hashes", "counts").mapInArrow(build, "gram int, bucket int, seg binary")

    def whole(self) -> Filter:
        """The filter, for a broadcast; the driver only strings its parts together, one after the other."""
        out = Filter(self.buckets, 0, self.buckets, self.words)
        for r in self.segments().toLocalIterator():
            out.put(r["gram"], r["bucket"], r["seg"])
        return out


class Scorer:
    """Sums of a chunk's texts from its n-grams' counts."""

    def __init__(self, model: Model):
        self.n, self.v, self.hot, self.mass, self.order = model.tokens, model.vocabulary, model.hot, MASS, model.order

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of frequent words, and which words are such."""
        h, c = self.hot
        if not len(h):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(h, words), len(h) - 1)
        known = h[at] == words
        return np.where(known, c[at], 0), known

    def __call__(self, scan: Scan, counts) -> dict[str, np.ndarray]:
        """``counts(order, keys)`` gives what the filter says.  Per text: n_tokens, hot_known, hot_log, score, and the hashes of its other words."""
        tok, off = tokens(scan)
        keys = grams(tok, self.order)
        words, back = np.unique(tok, return_inverse=True)
        frequent, known = self.exact(words)
        c1 = np.where(known, frequent, counts(1, words))
        ends = float(c1[words == END][0])
        one, two = c1[back].astype(float), counts(2, keys[2]).astype(float)
        first = off[:-1]
        after = np.empty_like(one)  # how often the history occurs
        after[1:] = one[:-1]
        after[first] = ends
        two = np.minimum(two, np.minimum(after, one))
        m2, m3 = self.mass
        p = (one + 1) / (self.n + self.v + 1)
        p = (two + m2 * p) / (after + m2)
        if self.order > 2:
            after[1:] = two[:-1]
            after[first] = ends
            three = np.minimum(counts(3, keys[3]).astype(float), np.minimum(after, two))
            p = (three + m3 * p) / (after + m3)
        per = lambda x: np.add.reduceat(x, first)  # noqa: E731  no text is without its end token
        odd = np.flatnonzero(~known[back])
        doc = np.repeat(np.arange(scan.n), np.diff(off))[odd]
        return {
            "n_tokens": np.diff(off), "hot_known": per(known[back].astype(np.int64)), "hot_log": per(np.log10(np.where(known, frequent, 0) + 1.0)[back]), "score": per(np.log10(p)),
            "odd": (tok[odd], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=scan.n))])),
        }


SCORED = [("n_tokens", T.LongType()), ("hot_known", T.LongType()), ("hot_log", T.DoubleType()), ("score", T.DoubleType()), ("odd", T.BinaryType())]


def scored_columns(found: list[dict]) -> list[pa.Array]:
    cols = [pa.array(np.concatenate([f[k] for f in found])) for k in ("n_tokens", "hot_known", "hot_log", "score")]
    odd = [h[off[i] : off[i + 1]].astype("<u8").tobytes() for f in found for h, off in [f["odd"]] for i in range(len(off) - 1)]
    return [*cols, pa.array(odd, pa.binary())]


def by_broadcast(source: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast((Scorer(model), model.whole()))
    carry = [c for c in source.columns if c != "__text"]

    def run(batches):
        scorer, table = shared.value
        for b in batches:
            found = [scorer(scan, table.counts) for scan in scans(b, "__text", lower=True)]
            if found:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *scored_columns(found)], names=schema.names)

    return source.mapInArrow(run, schema)


def by_routes(source: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    """As :func:`by_broadcast`, for a filter of any size: probes go to the buckets, counts come back."""
    carry = [c for c in source.columns if c != "__text"]
    buckets, per, words, order = model.buckets, model.per_route, model.words, model.order
    letters = dict(zip(range(1, order + 1), "abc", strict=False))
    some = list(letters.values())
    sizes = [f"n{x}" for x in some]
    binary, whole = (lambda names: ", ".join(f"{x} binary" for x in names)), (lambda names: ", ".join(f"{x} long" for x in names))
    row = T.StructType([source.schema[c] for c in carry])
    from pyspark.sql.pandas.types import to_arrow_type

    row_type = to_arrow_type(row)

    def name_of(scan: Scan) -> tuple[int, int]:
        h = mix(np.concatenate([scan.prefix, scan.off.astype(np.uint64)]))
        at = np.arange(1, len(h) + 1, dtype=np.uint64)
        return int(np.sum(mix(h ^ at)).astype(np.int64)), int(np.sum(mix(h + at * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64))

    def distinct(scan: Scan) -> dict[int, np.ndarray]:
        return {g: np.unique(k) for g, k in grams(tokens(scan)[0], order).items()}

    def ask(batches):
        for b in batches:
            for scan in scans(b, "__text", lower=True):
                name, keys = name_of(scan), distinct(scan)
                cuts = {g: np.searchsorted(bucket_of(k, buckets) // per, np.arange(-(-buckets // per) + 1)) for g, k in keys.items()}
                parts = [(r, *(cuts[g][r + 1] - cuts[g][r] for g in letters), *(planes(keys[g][cuts[g][r] : cuts[g][r + 1]], "<u8") for g in letters)) for r in range(-(-buckets // per))]
                r, *blobs = zip(*(p for p in parts if any(p[1 : order + 1])), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int32()), pa.array([1] * len(r), pa.int32()), *(pa.array([x] * len(r), pa.int64()) for x in name), *(pa.array(x, pa.int64()) for x in blobs[:order]), *(pa.array(x, pa.binary()) for x in blobs[order:])],
                    names=["route", "kind", "u1", "u2", *sizes, *some],
                )

    asked = source.select("__text").mapInArrow(ask, f"route int, kind int, u1 long, u2 long, {whole(sizes)}, {binary(some)}")
    stored = model.segments().select((F.col("bucket") / per).cast("int").alias("route"), F.lit(0).alias("kind"), F.col("gram").cast("long").alias("u1"), F.col("bucket").cast("long").alias("u2"), *(F.lit(0).cast("long").alias(x) for x in sizes), F.col("seg").alias("a"), *(F.lit(None).cast("binary").alias(x) for x in some[1:]))

    def answer(batches):
        current, table = None, None
        for b in batches:
            out = []
            for route, kind, u1, u2, *blobs in zip(*(b.column(c).to_pylist() for c in ("route", "kind", "u1", "u2", *sizes, *some)), strict=True):
                if route != current:
                    current, table = route, Filter(buckets, route * per, min(buckets, (route + 1) * per), words)
                if kind == 0:
                    table.put(u1, u2, blobs[order])
                else:
                    found = [table.counts(g, from_planes(x, "<u8", n).astype(np.uint64)) for g, n, x in zip(letters, blobs[:order], blobs[order:], strict=True)]
                    out.append((u1, u2, route, *(planes(c, "<i8") for c in found), *map(len, found)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), *(pa.binary(),) * order, *(pa.int64(),) * order)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["u1", "u2", "route", *some, *sizes])

    probes = asked.unionByName(stored).repartition("route").sortWithinPartitions("route", "kind")
    answers = probes.mapInArrow(answer, f"u1 long, u2 long, route int, {binary(some)}, {whole(sizes)}").withColumn("rows", F.lit(None).cast(T.ArrayType(row)))

    def frame(batches):
        for b in batches:
            for scan in scans(b, "__text", lower=True):
                rows = pa.StructArray.from_arrays([b.column(c).slice(scan.first, scan.n) for c in carry], fields=list(row_type))
                lists = pa.ListArray.from_arrays(pa.array([0, scan.n], pa.int32()), rows)
                u1, u2 = name_of(scan)
                one = lambda x, k: pa.array([x], k)
                yield pa.RecordBatch.from_arrays(
                    [one(u1, pa.int64()), one(u2, pa.int64()), one(1 << 30, pa.int32()), one(scan.data.tobytes(), pa.binary()), one(scan.off.astype("<i8").tobytes(), pa.binary()), *(one(None, pa.binary()),) * (order - 2), *(one(0, pa.int64()),) * order, lists],
                    names=["u1", "u2", "route", *some, *sizes, "rows"],
                )

    frames = source.mapInArrow(frame, answers.schema)
    scorer = source.sparkSession.sparkContext.broadcast(Scorer(model))

    def meet(batches):
        current, got = None, {}
        for b in batches:
            for i in range(len(b)):
                r = {c: b.column(c)[i] for c in ("u1", "u2", "route", *some, *sizes)}
                name = r["u1"].as_py(), r["u2"].as_py()
                if name != current:
                    current, got = name, {}
                if r["route"].as_py() < 1 << 30:  # equal chunks asked alike
                    got[r["route"].as_py()] = {g: from_planes(r[x].as_py(), "<i8", r[f"n{x}"].as_py()) for g, x in letters.items()}
                    continue
                scan = Scan(np.frombuffer(r["a"].as_py(), np.uint8), np.frombuffer(r["b"].as_py(), "<i8").astype(np.int64))
                keys = distinct(scan)
                known = {g: np.concatenate([got[k][g] for k in sorted(got)]) for g in letters}
                if any(len(known[g]) != len(keys[g]) for g in letters):
                    raise ValueError("the texts were not read alike twice")
                found = scorer.value(scan, lambda g, k, known=known, keys=keys: known[g][np.searchsorted(keys[g], k)])
                rows = b.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([*rows.flatten(), *scored_columns([found])], names=schema.names)

    return answers.unionByName(frames).repartition("u1", "u2").sortWithinPartitions("u1", "u2", "route").mapInArrow(meet, schema)


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score for each row."""
    source = docs.select(*keep, text_of().alias("__text")).withColumns({"__k1": F.xxhash64("__text"), "__k2": F.xxhash64(F.lit(1), "__text")})
    schema = T.StructType([*(source.schema[c] for c in source.columns if c != "__text"), *(T.StructField(f"__{n}", k) for n, k in SCORED)])
    n, v = model.tokens, model.vocabulary
    found = (by_broadcast if model.fits else by_routes)(source, model, schema)
    unit = F.lit(math.log10(n + v + 1))
    if model.floor <= 1:  # all words are frequent ones; what isn't among them is unknown
        return found.select(*keep, F.col("__n_tokens").alias("n_tokens"), F.col("__hot_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("__hot_log") - F.col("__n_tokens") * unit).alias("base_score"), F.col("__score").alias("score"))
    found = cut(found)

    def unusual(batches):
        """The words of each text that aren't frequent: key of the text, hash, how often."""
        for b in batches:
            k1, k2 = (b.column(c).to_numpy() for c in ("__k1", "__k2"))
            lists = b.column("__odd").to_pylist()
            h = np.frombuffer(b"".join(lists), "<i8")
            doc = np.repeat(np.arange(len(b)), [len(x) // 8 for x in lists])
            for low in range(0, len(h), 1 << 17):
                at = doc[low : low + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(h[low : low + (1 << 17)])], names=["__k1", "__k2", "hash"])

    odd = found.select("__k1", "__k2", "__odd").mapInArrow(unusual, "__k1 long, __k2 long, hash long")
    sums = odd.join(model.rare(), "hash").groupBy("__k1", "__k2").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log"), F.count("*").alias("rare_known"))
    copies = found.groupBy("__k1", "__k2").agg(F.count("*").alias("copies"))
    sums = cut(sums.join(copies, ["__k1", "__k2"]))
    return found.drop("__odd").join(sums, ["__k1", "__k2"], "left").select(
        *keep, F.col("__n_tokens").alias("n_tokens"),
        (F.col("__hot_known") + F.coalesce(F.expr("rare_known div copies"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("__hot_log") + F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0)) - F.col("__n_tokens") * unit).alias("base_score"),
        F.col("__score").alias("score"),
    )


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", doc_remainder(7) == 2)
