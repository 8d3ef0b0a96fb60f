"""Removal of sentence spans that repeat, within a text or across texts.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, at a line feed, or at the text's end; sentences of more than
``LONG`` words are cut after each word whose hash is no greater than those of the ``REACH`` words on both its sides, so a passage without full
stops is cut alike wherever it stands, but for ``REACH`` words at its ends, and cuts are about twice that apart.  From each sentence runs a span: the fewest consecutive sentences, two at least, that have ``MIN_WORDS`` words
together.  Spans are compared by 128-bit hashes of their words (lower-cased in A-Z, white space aside).  Of all spans with one
hash the first stays, that of the least document id and then the least position; each sentence that any other of them
covers is removed, with the blanks behind it but not the line feed.

Hashes are counted with partial aggregation and joined back, so a span that a third of all documents hold is a
join that can be split, not a group in one task; no list longer than one document's own spans is gathered.

Documents are known by doc_id; a null id gives the text's own key, and rows that share an id but not their text are documents of their own (see ``dartminhash.nodes``).
Of rows that agree in id and text, which are interchangeable, one counts as first, and the others lose every span.  Null texts become empty; texts with fewer sentences or words than a span, and texts without a repeat,
come back byte for byte.  An empty table gives an empty result; ``remove`` carries all other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut
from .dartminhash import nodes
from .textscan import FIRST, LOWER, SECOND, SPACE, Scan, mix, scans

MIN_SENTENCES, MIN_WORDS, LONG, REACH = 2, 16, 16, 4


class Spans:
    """Sentences (as ranges of words) and spans (as ranges of sentences) of a chunk."""

    def __init__(self, raw: Scan):
        scan = Scan(LOWER[raw.data], raw.off)
        start, end = scan.words
        doc, h = scan.word_doc, scan.word_hash
        self.scan, self.start, self.end = raw, start, end
        if not len(h):
            self.first = self.last = self.doc = self.run_from = self.run_to = np.zeros(0, np.int64)
            self.h1 = self.h2 = np.zeros(0, np.uint64)
            return
        feeds = np.concatenate([[0], np.cumsum(raw.data == 10)])
        stop = np.isin(raw.data[end - 1], np.frombuffer(b".!?", np.uint8))
        final = np.ones(len(h), bool)
        final[:-1] = (doc[1:] != doc[:-1]) | (feeds[start[1:]] != feeds[end[:-1]])
        stop |= final
        last = np.flatnonzero(stop) + 1
        first = np.concatenate([[0], last[:-1]])
        length = np.repeat(last - first, last - first)
        weight, least = mix(h), np.ones(len(h), bool)
        for d in range(1, REACH + 1):
            apart = doc[d:] != doc[:-d]
            least[d:] &= apart | (weight[d:] <= weight[:-d])
            least[:-d] &= apart | (weight[:-d] <= weight[d:])
        stop |= (length > LONG) & least
        self.last = np.flatnonzero(stop) + 1
        self.first = np.concatenate([[0], self.last[:-1]])
        self.doc = doc[self.first]
        n = len(self.first)
        to = np.maximum(np.searchsorted(self.last, self.first + MIN_WORDS) + 1, np.arange(n) + MIN_SENTENCES)
        bound = np.searchsorted(self.doc, self.doc, side="right")
        self.run_from = np.flatnonzero(to <= bound)
        self.run_to = to[self.run_from]
        a, b = self.first[self.run_from], self.last[self.run_to - 1]
        self.h1 = FIRST.segments(FIRST.prefix(h), a, b)
        self.h2 = SECOND.segments(SECOND.prefix(h), a, b)

    def within(self) -> np.ndarray:
        """Which spans have an equal one before them in their text."""
        doc = self.doc[self.run_from]
        key = mix(self.h1 ^ mix(self.h2 ^ mix(doc.astype(np.uint64))))
        order = np.argsort(key, kind="stable")
        out = np.zeros(len(key), bool)
        out[order[1:]] = key[order][1:] == key[order][:-1]
        return out

    def covered(self, bad: np.ndarray) -> np.ndarray:
        """Which sentences the given spans cover."""
        edge = np.zeros(len(self.first) + 1, np.int64)
        np.add.at(edge, self.run_from[bad], 1)
        np.add.at(edge, self.run_to[bad], -1)
        return np.cumsum(edge)[:-1] > 0

    def kept_bytes(self, gone: np.ndarray) -> np.ndarray:
        """A mask over the chunk's bytes without the sentences that go."""
        data, off = self.scan.data, self.scan.off
        a = self.start[self.first[gone]]
        b = self.end[self.last[gone] - 1]
        # blanks behind, up to a line feed or the next word or text
        halt = np.flatnonzero(~(SPACE[data] & (data != 10)))
        limit = off[1:][self.doc[gone]]
        at = np.searchsorted(halt, b)
        b = np.minimum(np.where(at < len(halt), halt[np.minimum(at, max(0, len(halt) - 1))], len(data)), limit)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        return np.cumsum(edge)[:-1] == 0


def occurrences(batches):
    """(h1, h2, id) of the spans of each text, once for each text."""
    for b in batches:
        ids = b.column("id")
        for scan in scans(b):
            s = Spans(scan)
            new = ~s.within()
            at = pa.array(s.doc[s.run_from][new] + scan.first)
            yield pa.RecordBatch.from_arrays([pa.array(s.h1[new].view(np.int64)), pa.array(s.h2[new].view(np.int64)), ids.take(at)], names=["h1", "h2", "id"])


def repeated(keyed: DataFrame) -> DataFrame:
    """(id, bad): for each document (id, text) the hashes of its spans of which another document holds the first."""
    spans = keyed.select("id", "text").mapInArrow(occurrences, "h1 long, h2 long, id long")
    shared = spans.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("most")).where("most > owner").select("h1", "h2", "owner")
    return spans.join(shared, ["h1", "h2"]).where("id != owner").groupBy("id").agg(F.collect_set("h1").alias("bad"))


def rewrite(batches):
    for b in batches:
        rows, bad, again = b.column("row"), b.column("bad"), b.column("again").to_numpy(zero_copy_only=False)
        flat, offs = bad.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), None
        sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(bad).to_pylist()], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        texts, counts = [], []
        for scan in scans(b):
            s = Spans(scan)
            out = s.within()
            low, high = offs[scan.first], offs[scan.first + scan.n]
            if high > low and len(s.h1):
                owner = np.repeat(np.arange(scan.n), sizes[scan.first : scan.first + scan.n]).astype(np.uint64)
                mine = mix(s.h1 ^ mix(s.doc[s.run_from].astype(np.uint64) + np.uint64(5)))
                out |= np.isin(mine, mix(flat[low:high] ^ mix(owner + np.uint64(5))))
            out |= again[s.doc[s.run_from] + scan.first]
            gone = s.covered(out)
            keep = s.kept_bytes(gone) if gone.any() else np.ones(len(scan.data), bool)
            off = np.concatenate([[0], np.cumsum(scan.count(keep))]).astype(np.int64)
            texts.append(pa.LargeStringArray.from_buffers(scan.n, pa.py_buffer(off.tobytes()), pa.py_buffer(scan.data[keep].tobytes())).cast(pa.string()))
            counts.append((np.bincount(s.doc, minlength=scan.n), np.bincount(s.doc[gone], minlength=scan.n)))
        if texts:
            yield pa.RecordBatch.from_arrays([rows, pa.concat_arrays(texts), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*counts, strict=True))], names=["row", "text", "n_sentences", "n_removed"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(row, text, n_sentences, n_removed): ``row`` holds the columns of docs, ``text`` what remains of the text."""
    rows = nodes(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text"), "__row").select(F.col("__row").alias("row"), F.col("__node").alias("id"), F.col("__words").alias("text"))
    copies = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if copies.isEmpty():
        keyed = rows.withColumn("again", F.lit(False))
    else:  # rows that agree in id and text: stored with a number each, so that one of them is first
        several = cut(rows.join(copies, "id", "left_semi").withColumn("__number", F.monotonically_increasing_id()))
        first = cut(several.groupBy("id").agg(F.min("__number").alias("__first")))
        several = several.join(first, "id").withColumn("again", F.col("__number") != F.col("__first"))
        keyed = rows.join(copies, "id", "left_anti").withColumn("again", F.lit(False)).unionByName(several.drop("__number", "__first"))
    marked = keyed.join(repeated(rows), "id", "left")
    schema = T.StructType([T.StructField("row", marked.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return marked.select("row", "text", "bad", "again").mapInArrow(rewrite, schema)


def remove(docs: DataFrame) -> DataFrame:
    """docs with the remaining texts, all columns kept; a column n_chars follows the text."""
    done = deduplicated(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))
