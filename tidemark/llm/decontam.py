"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared lower-cased in A-Z, with runs of white space as one blank.  A benchmark text of m bytes may match with up to
e = ``ERROR`` * m edits, rounded down.  Such a match shares at least m + 1 - Q * (e + 1) of its q-grams with the document, on diagonals (place in the
document minus place in the text) that differ by at most e.  Shared q-grams are counted in diagonal bands of twice e + 1 that
overlap by half, so every match lies whole in one band.  Bands that reach the bound are verified by an alignment
confined to the band and e beyond it.  With Q = 10 and 5 % the bound is positive for every text of Q bytes or more.  Shorter texts (for which no edit is allowed either) are
found by the hashes of the same many bytes between word boundaries, as whole words.  The bound is that of the whole text: a document that quotes only part of one
does not match.

Every document is judged by itself: no shuffle, and a passage that a third of all documents hold is only as many matches.
The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (or one longer text).  ``matches`` scans the documents once for each block and stores each
block's matches once; ``clean`` passes each text through all blocks in one scan.

Null texts are empty and match nothing.  Equal benchmark texts each match; those without a word match nothing.  Repeated rows give repeated matches.  Empty tables on
either side give no match.  Other columns are carried by ``clean`` and unread by ``matches``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, text_of
from .textscan import FIRST, LOWER, SPACE, Scan, scans

Q = 10
ERROR = 0.05
BLOCK_BYTES = 4 << 20
BITS = 22
HITS = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def plain(scan: Scan) -> tuple[Scan, np.ndarray]:
    """The normalised texts, and where each of their bytes was."""
    space = SPACE[scan.data]
    keep = np.ones(len(space), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    full = scan.off[:-1] < scan.off[1:]
    keep[scan.off[:-1][full]] = True
    at = np.flatnonzero(keep)
    data = LOWER[scan.data[at]]
    data[space[at]] = 0x20
    return Scan(data, np.concatenate([[0], np.cumsum(scan.count(keep))]).astype(np.int64)), at


def grams(scan: Scan) -> np.ndarray:
    """A hash of the Q bytes from each place (the last Q - 1 places have none)."""
    if len(scan.data) < Q:
        return np.zeros(0, np.uint64)
    prefix = scan.prefix
    _, down = FIRST.powers.get(len(prefix))
    return (prefix[Q:] - prefix[:-Q]) * down[: len(prefix) - Q] * ODD


def budget(m: int) -> int:
    """Edits allowed for a text of m bytes."""
    return int(ERROR * m)


# bytes of letters, digits and characters beyond ASCII
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Index:
    """The q-grams of a block of benchmark texts."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.texts, h, item, place = [], [], [], []
        for _, text in items:
            scan, _ = plain(Scan(np.frombuffer(text.strip(b" \t\n\v\f\r"), np.uint8), np.array([0, len(text.strip(b" \t\n\v\f\r"))], np.int64)))
            if len(scan.data) >= Q:
                g = grams(scan)
                h.append(g)
                item.append(np.full(len(g), len(self.texts)))
                place.append(np.arange(len(g)))
            self.texts.append(scan.data.copy())
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(int(m)) for m in size], np.int64)
        self.need = size + 1 - Q * (self.edits + 1)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        h, item, place = join(h, np.uint64), join(item, np.int64), join(place, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order].astype(np.int32), place[order].astype(np.int32)
        # shorter texts, by length: hashes in order, and whose they are
        self.short = {}
        for n in range(1, Q):
            which = [k for k, t in enumerate(self.texts) if len(t) == n and WORDY[t].any()]
            if which:
                hashes = np.concatenate([FIRST.segments(FIRST.prefix(self.texts[k]), np.array([0]), np.array([n])) for k in which])
                order = np.argsort(hashes, kind="stable")
                self.short[n] = hashes[order], np.array(which)[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.h >> np.uint64(64 - BITS)] = True

    def hits(self, scan: Scan):
        """Text, benchmark text and diagonal of every shared q-gram, in slices of about ``HITS`` (or the entries of one q-gram)."""
        g = grams(scan)
        at = np.flatnonzero(self.seen[g >> np.uint64(64 - BITS)])
        doc = np.searchsorted(scan.off, at, side="right") - 1
        inside = at + Q <= scan.off[1:][doc]
        at, doc = at[inside], doc[inside]
        low, high = np.searchsorted(self.h, g[at]), np.searchsorted(self.h, g[at], side="right")
        real = high > low
        at, doc, low, n = at[real], doc[real], low[real], (high - low)[real]
        end = np.cumsum(n)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + HITS, side="right")))
            m = n[i:j]
            entry = np.repeat(low[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(doc[i:j], m), self.item[entry].astype(np.int64), np.repeat(at[i:j], m) - self.place[entry]
            i = j

    def candidates(self, scan: Scan):
        """(text, benchmark text, first diagonal, last diagonal) of each band that reaches the bound."""
        keys, count = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
        for doc, item, diagonal in self.hits(scan):
            band = (diagonal + (1 << 40)) // (self.edits[item] + 1)
            new = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
            keys, count = np.concatenate([keys, new], axis=1), np.concatenate([count, np.ones(new.shape[1], np.int64)])
            order = np.lexsort(keys[::-1])
            keys, count = keys[:, order], count[order]
            at = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            keys, count = keys[:, at], np.add.reduceat(count, at)
        for d, i, b in keys[:, count >= self.need[keys[1]]].T.tolist():
            s = int(self.edits[i]) + 1
            yield d, i, b * s - (1 << 40), (b + 2) * s - 1 - (1 << 40)

    def brief(self, scan: Scan):
        """(text, benchmark text, from, to) of the first place of each text under Q bytes that stands between word boundaries."""
        if not self.short or not len(scan.data):
            return
        wordy = WORDY[scan.data]
        edge = np.ones(len(wordy) + 1, bool)  # between two places: not both of a word
        edge[1:-1] = ~(wordy[1:] & wordy[:-1])
        edge[scan.off] = True
        doc = np.repeat(np.arange(scan.n), np.diff(scan.off))
        for n, (hashes, which) in self.short.items():
            start = np.flatnonzero(edge[: max(0, len(edge) - n)] & edge[n:])
            start = start[start + n <= scan.off[1:][doc[start]]]
            h = FIRST.segments(scan.prefix, start, start + n)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for k in np.flatnonzero(high > low).tolist():
                for i in which[low[k] : high[k]].tolist():
                    yield int(doc[start[k]]), i, int(start[k]), int(start[k]) + n

    def verified(self, scan: Scan):
        """Per text and benchmark text the best match, the leftmost of the best: (text, benchmark text, edits, from, to)."""
        best = {}
        for d, i, start, end in self.brief(scan):
            best.setdefault((d, i), (0, start, end))
        for d, i, low, high in self.candidates(scan):
            e, text = int(self.edits[i]), self.texts[i]
            a, z = int(scan.off[d]), int(scan.off[d + 1])
            exact = scan.data[max(a, low) : min(z, high + len(text))].tobytes().find(text.tobytes())
            if exact >= 0:
                found = (0, max(a, low) + exact, max(a, low) + exact + len(text))
            else:
                lo, hi = max(a - len(text), low - e), high + e
                edits, end = banded(text, scan.data[a:z], lo - a, hi - a)
                if edits > e:
                    continue
                # the same alignment from the other side gives the start
                _, back = banded(text[::-1], scan.data[a : a + end][::-1], end - (hi - a) - len(text), end - (lo - a) - len(text))
                found = (edits, a + max(0, end - back), a + end)
            if (d, i) not in best or found < best[d, i]:
                best[d, i] = found
        for (d, i), (edits, start, end) in sorted(best.items()):
            yield d, i, edits, start, end


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits of the whole pattern against any part of the text that starts on diagonals low..high and stays there; and where that part ends."""
    m, n, far = len(pattern), len(text), 1 << 30
    width = high - low + 1
    shift = np.arange(width)
    padded = np.full(m + width + 1, 256, np.int64)  # text bytes from ``low`` on; 256 where there is none
    a, z = max(0, low), min(n, low + len(padded))
    if z > a:
        padded[a - low : z - low] = text[a:z]
    column = low + shift  # of the text, before row 0
    row = np.where((column >= 0) & (column <= n), 0, far)
    for i in range(m):
        new = row + (padded[i : i + width] != pattern[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - shift) + shift
        column = low + i + 1 + shift
        new[(column < 0) | (column > n)] = far
        row = new
    at = int(np.argmin(row))
    return int(row[at]), low + m + at


def blocks(benchmark: DataFrame):
    """The benchmark's texts, by item_id, in blocks that the driver and a broadcast can hold."""
    block, size = [], 0
    rows = benchmark.select("item_id", text_of().cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator()
    for r in rows:
        text = bytes(r["text"])
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): the best match of each benchmark text in each document; places are in code points."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *(T.StructField(x, T.LongType()) for x in ("edits", "start", "stop"))])
    source = docs.select("doc_id", text_of().alias("text"))
    parts, held = None, None

    def stored(find, index):
        part = cut(source.mapInArrow(find, schema))
        index.destroy()
        return part

    for block in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(block))

        def find(batches, index=index):
            ix = index.value
            for b in batches:
                rows, items, numbers = [], [], []
                for scan in scans(b):
                    text, at = plain(scan)
                    points = None
                    for d, i, edits, start, end in ix.verified(text):
                        if points is None:
                            points = np.concatenate([[0], np.cumsum((scan.data & 0xC0) != 0x80)])
                        a, z = at[start], at[end - 1] + 1
                        rows.append(scan.first + d)
                        items.append(ix.ids[i])
                        numbers.append((edits, int(points[a] - points[scan.off[d]]), int(points[z] - points[scan.off[d]])))
                kind = pa.int64() if schema["item_id"].dataType == T.LongType() else None
                cols = [pa.array(x, pa.int64()) for x in (zip(*numbers, strict=True) if numbers else ((), (), ()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, kind), *cols], names=schema.names)

        if parts is None:
            parts, held = [], (find, index)
            continue
        if held:
            parts.append(stored(*held))
        held = None
        parts.append(stored(find, index))
    if held:
        return source.mapInArrow(held[0], schema)
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a match, all columns kept."""
    out = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("text"))
    schema = out.schema
    for block in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def keep(batches, index=index):
            for b in batches:
                mask = np.ones(len(b), bool)
                for scan in scans(b):
                    for d, *_ in index.value.verified(plain(scan)[0]):
                        mask[scan.first + d] = False
                yield b.filter(pa.array(mask))

        out = out.mapInArrow(keep, schema)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns))
