"""Quality rules as a short-circuit cascade.

Rules look at a :class:`Page`, the measured texts of a chunk, and name those that they reject.  On a sample
of bounded rows and bytes, from a few partitions, each rule is timed and its rejections are counted; rules are then put in order by
rejections per second among what the rules before them left (the greedy order for dependent filters).  The five measures
are a page's own, so rules on them are nearly free; the others scan lines, letters, words or pairs of words, at different cost.
Only texts that all earlier rules passed reach a rule.  The order changes the cost alone: a text is
kept if no rule rejects it, whatever comes first.

Nulls are empty texts, empty texts have no words and fail the base rules, repeated rows are judged
alike, an empty table gives an empty result, and other columns are carried untouched by ``apply``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import text_of
from .textscan import FIRST, SPACE, Scan, mix, scans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
ASCII_LETTER = UPPER.copy()
ASCII_LETTER[ord("a") : ord("z") + 1] = True
LETTER = ASCII_LETTER.copy()
LETTER[0x80:] = True  # a byte of a character beyond ASCII

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(key: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere, and which have an equal one before them."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice | later, later


def repeat_words(scan: Scan) -> np.ndarray:
    """Per text, the words in three-word windows that the text holds twice or more."""
    doc, h = scan.word_doc, scan.word_hash
    if len(h) < 4:
        return np.zeros(scan.n, np.int64)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    window = mix(h[:-2] * np.uint64(3) ^ mix(h[1:-1] * np.uint64(5) ^ mix(h[2:])))[inside]
    twice, _ = repeated(mix(window ^ mix(doc[inside].astype(np.uint64) + np.uint64(77))))
    hit = np.zeros(len(h), bool)
    at = inside[twice]
    for k in range(3):
        hit[at + k] = True
    return np.bincount(doc[hit], minlength=scan.n)


def dup_lines(scan: Scan) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    start, end, doc = scan.lines()
    solid = np.zeros(len(scan.data) + 1, np.int64)
    np.cumsum(~SPACE[scan.data], out=solid[1:])
    worded = solid[end] > solid[start]
    h = FIRST.segments(scan.prefix, start[worded], end[worded])
    doc = doc[worded]
    _, later = repeated(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(99))))
    return np.bincount(doc[later], minlength=scan.n)


class Page:
    """The texts of a chunk that are still in, with what has been measured of all of them."""

    def __init__(self, scan: Scan):
        self.scan = scan
        nonspace = ~SPACE[scan.data]
        self.n_words = np.diff(scan.word_off)
        self.word_chars = scan.count(nonspace & ((scan.data & 0xC0) != 0x80))
        self.n_symbols = scan.count(SYMBOL[scan.data])
        self.n_dup_lines = dup_lines(scan)
        self.n_repeat_words = repeat_words(scan)

    def each(self, rows: np.ndarray) -> Scan:
        """The scan of only the given texts."""
        scan = self.scan
        if len(rows) == scan.n:
            return scan
        size = np.diff(scan.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(scan.off[rows] - off[:-1], size) + np.arange(off[-1])
        return Scan(scan.data[at], off)


@dataclass(frozen=True)
class Rule:
    """``rejects(page, rows)`` gives, for each of the given texts of the page, whether the rule rejects it."""

    name: str
    rejects: Callable[[Page, np.ndarray], np.ndarray]


def base_failed(page: Page) -> np.ndarray:
    return (page.n_words < 50) | (100 * page.n_repeat_words > 50 * page.n_words)


def symbol_heavy(page: Page, rows: np.ndarray) -> np.ndarray:
    return 10 * page.n_symbols[rows] > page.n_words[rows]


def word_length(page: Page, rows: np.ndarray) -> np.ndarray:
    words, chars = page.n_words[rows], page.word_chars[rows]
    return (chars < 2 * words) | (chars > 15 * words)


def repeated_lines(page: Page, rows: np.ndarray) -> np.ndarray:
    scan = page.each(rows)
    start, end, doc = scan.lines()
    solid = np.zeros(len(scan.data) + 1, np.int64)
    np.cumsum(~SPACE[scan.data], out=solid[1:])
    worded = np.bincount(doc[solid[end] > solid[start]], minlength=scan.n)
    return 2 * page.n_dup_lines[rows] > worded


def shouting(page: Page, rows: np.ndarray) -> np.ndarray:
    scan = page.each(rows)
    return 10 * scan.count(UPPER[scan.data]) > 3 * scan.count(ASCII_LETTER[scan.data])


def few_letters(page: Page, rows: np.ndarray) -> np.ndarray:
    scan = page.each(rows)
    start, end = scan.words
    total = np.zeros(len(scan.data) + 1, np.int64)
    np.cumsum(LETTER[scan.data], out=total[1:])
    lettered = np.bincount(scan.word_doc[total[end] > total[start]], minlength=scan.n)
    return 10 * lettered < 7 * np.diff(scan.word_off)


def _worded_lines(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the lines with a word, without the white space around them, and their texts."""
    start, end = scan.words
    feeds = np.concatenate([[0], np.cumsum(scan.data == 10)])
    if not len(start):
        return start, end, scan.word_doc
    fresh = np.ones(len(start), bool)
    fresh[1:] = (feeds[start[1:]] != feeds[start[:-1]]) | (scan.word_doc[1:] != scan.word_doc[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return start[fresh], end[last], scan.word_doc[fresh]


def bullet_lines(page: Page, rows: np.ndarray) -> np.ndarray:
    """Over nine tenths of the lines with a word begin with a dash, star or bullet sign."""
    scan = page.each(rows)
    start, _, doc = _worded_lines(scan)
    data = np.concatenate([scan.data, np.zeros(3, np.uint8)])
    sign = (data[start] == ord("-")) | (data[start] == ord("*")) | ((data[start] == 0xE2) & (data[start + 1] == 0x80) & (data[start + 2] == 0xA2))
    return 10 * np.bincount(doc[sign], minlength=scan.n) > 9 * np.bincount(doc, minlength=scan.n)


def open_lines(page: Page, rows: np.ndarray) -> np.ndarray:
    """Over three tenths of the lines with a word end with three dots."""
    scan = page.each(rows)
    start, end, doc = _worded_lines(scan)
    dots = (end - start >= 3) & (scan.data[end - 1] == 46)
    at = np.flatnonzero(dots)
    dots[at] = (scan.data[end[at] - 2] == 46) & (scan.data[end[at] - 3] == 46)
    return 10 * np.bincount(doc[dots], minlength=scan.n) > 3 * np.bincount(doc, minlength=scan.n)


def one_pair(page: Page, rows: np.ndarray) -> np.ndarray:
    """One pair of neighbouring words makes up over a fifth of a text's pairs."""
    scan = page.each(rows)
    doc, h = scan.word_doc, scan.word_hash
    if len(h) < 2:
        return np.zeros(scan.n, bool)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pair = mix(mix(h[:-1] * np.uint64(3) ^ mix(h[1:]))[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(55)))
    order = np.argsort(pair)
    fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[order][1:] != pair[order][:-1]]))
    most = np.zeros(scan.n, np.int64)
    np.maximum.at(most, doc[inside][order][fresh], np.diff(np.append(fresh, len(pair))))
    return 5 * most > np.bincount(doc[inside], minlength=scan.n)


RULES = (
    Rule("symbol_heavy", symbol_heavy),
    Rule("word_length", word_length),
    Rule("repeated_lines", repeated_lines),
    Rule("shouting", shouting),
    Rule("few_letters", few_letters),
    Rule("bullet_lines", bullet_lines),
    Rule("open_lines", open_lines),
    Rule("one_pair", one_pair),
)


SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TASKS = 512, 4 << 20, 8


def measured(page: Page, rules: tuple[Rule, ...]) -> tuple[list[float], np.ndarray]:
    """Seconds of each rule on a page, and which of its texts each rejects: bits 0 and up for the rules, one more for the base."""
    rows, seconds, bits = np.arange(page.scan.n), [], np.zeros(page.scan.n, np.int64)
    for k, rule in enumerate(rules):
        began = time.perf_counter()
        bits |= rule.rejects(page, rows).astype(np.int64) << k
        seconds.append(time.perf_counter() - began)
    return seconds, bits | base_failed(page).astype(np.int64) << len(rules)


def ordered(rules: tuple[Rule, ...], seconds: np.ndarray, bits: np.ndarray) -> list[str]:
    """Greedy: the rule with the most rejections a second among what is left comes next; ties keep the given order."""
    left = bits[bits >> len(rules) == 0]
    rest, out = list(range(len(rules))), []
    while rest:
        rejected = {k: int((left >> k & 1).sum()) for k in rest}
        best = max(rest, key=lambda k: (rejected[k] / max(seconds[k], 1e-9), -k))
        left = left[left >> best & 1 == 0]
        out.append(rules[best].name)
        rest.remove(best)
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, tasks: int = SAMPLE_TASKS) -> list[str]:
    """Rule names in the order of the cascade, from a sample (the method's own; it decides cost only).

    The first rows of a few partitions are measured where they lie, until there are ``rows`` of them or ``size`` bytes; Spark looks at further partitions only until
    ``tasks`` of them have given something.  To the driver come seconds and a number for each text, no text.
    """

    def look(batches):
        seconds, bits, seen = np.zeros(len(rules)), [], 0
        for b in batches:
            for scan in scans(b, limit=1 << 18, rows=64):
                s, found = measured(Page(scan), rules)
                seconds += s
                bits.append(found)
                seen += len(scan.data)
                if sum(map(len, bits)) >= rows or seen >= size:
                    break
            else:
                continue
            break
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array([seconds.tolist()], pa.list_(pa.float64())), pa.array([np.concatenate(bits).tolist()], pa.list_(pa.int64()))], names=["seconds", "bits"])

    got = docs.select(text_of().alias("text")).mapInArrow(look, "seconds array<double>, bits array<long>").take(tasks)
    if not got:
        return [r.name for r in rules]
    return ordered(rules, np.sum([r["seconds"] for r in got], axis=0), np.concatenate([r["bits"] for r in got]))


def apply(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, order: list[str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measure every whole text and run the cascade: ``keep`` columns, the measures, base_failed, kept."""
    if order is None:
        order = plan(docs, rules)
    named = {r.name: r for r in rules}
    cascade = [named[x] for x in order]

    def judge(batches):
        for b in batches:
            pages, failed, kept = [], [], []
            for scan in scans(b, "__text"):
                page = Page(scan)
                bad = base_failed(page)
                good = ~bad
                for rule in cascade:
                    rows = np.flatnonzero(good)
                    if not len(rows):
                        break
                    good[rows[rule.rejects(page, rows)]] = False
                pages.append([getattr(page, m) for m in MEASURES])
                failed.append(bad)
                kept.append(good)
            if not pages:
                continue
            cols = [pa.array(np.concatenate([p[k] for p in pages]).astype(np.int64)) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols, pa.array(np.concatenate(failed)), pa.array(np.concatenate(kept))], names=out.names)

    source = docs.select(*keep, text_of().alias("__text"))
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES] + [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")])
    return source.mapInArrow(judge, out)


__all__ = ["RULES", "Rule", "apply", "ordered", "plan"]
