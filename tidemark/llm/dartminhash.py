"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

A text is a weighted set: its five-word shingles (words lower-cased in A-Z; a text of one to four words is one
shingle), each weighted by how often it occurs.  Over every shingle lies a plane of weight and rank with darts thrown
by a hash: unit-rate arrivals in cells of area one, the same for every text.  A text owns the darts whose weight is below
the shingle's weight; each dart falls on one of k coordinates, and the dart of least rank is kept for each.  Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.  Only ranks below about
``DARTS * k / total weight`` need be thrown, so long texts cost little more than one hash a shingle.

The exact check below takes plain similarity too, so a text with repeated shingles gets a second signature, with every weight 1.  Where nothing
repeats the two are the same, so both kinds share one set of bands, and plain similarity is estimated for any two texts.

Joining: equal texts first fall to one representative.  Groups of ``ROWS`` coordinates are band keys.  In a bucket of equal
keys every member meets one centre, picked by the key (another in every band), so a bucket costs its size, not
its square.  What passes the exact check is joined into components; only buckets that then still hold several components
are gone through again, without a row for each pair:

* a bucket of up to ``BLOCK`` members is one product of incidence matrices;
* larger ones are cut into blocks that meet in pairs, dealt over tasks of bounded rows and bytes; a large component has blocks of its own, which don't meet each other;
* where that would deal members more than ``MANY`` times (many texts from one template, say, below the threshold), they are dealt by the prefix principle instead, if that is
  less: of two texts at similarity t or more, each has one of the other's among its rarest (1 - t) of shingles and one.  Rarity is counted among these
  members, so what the template gives them all comes last, and texts that share only that meet nowhere.  Groups are those with one rare shingle; this loses no pair.

A pair at plain or weighted similarity 0.8 is missed in all bands with probability 0.0004; ``tests`` measure it.

The exact check: two texts are near if the plain Jaccard similarity of their shingle sets, or the weighted one, is at least the threshold (0.8).

Documents are known by doc_id.  A null id gives the text's own negative key, and rows that share an id but not their text are documents
of their own, known by a negative key of both; their class is still named by the least id in it.  Texts without a word join only with equal
texts.  Ties go to the least id.  An empty table gives an empty result.  Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, text_of
from .textscan import SECOND, Scan, mix, scans

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 26
DARTS = 9
BLOCK, MANY = 512, 4
PART_ROWS, PART_BYTES = 2000, 16 << 20
MASK = (1 << 64) - 1


def shingles(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle."""
    doc, off = scan.word_doc, scan.word_off
    per = np.diff(off)
    prefix = SECOND.prefix(scan.word_hash)
    start = np.arange(len(doc))
    start = start[(off[1:][doc] - start >= SHINGLE) | (start == off[:-1][doc])] if len(doc) else start
    end = np.minimum(start + SHINGLE, off[1:][doc[start]]) if len(doc) else start
    keep = (end - start == SHINGLE) | (per[doc[start]] < SHINGLE) if len(doc) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    h, owner = SECOND.segments(prefix, start, end), doc[start]
    key = mix(h ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    first, count = order[at], np.diff(np.append(at, len(key)))
    place = np.argsort(first)  # back to the order of the texts
    return owner[first][place], h[first][place], count[place]


def darts(h: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts of ranks below each element's bound: element, rank, 64 bits of identity.

    Weights are cut into strips [0, 1), [1, 2), [2, 4), ...; a strip of width w has rank cells of height 1/w.
    """
    who, rank, name = [], [], []
    low, width, strip = 0.0, 1.0, 0
    active = np.arange(len(h))
    while len(active):
        cells = np.ceil(bound[active] * width).astype(np.int64)
        el = np.repeat(active, cells)
        cell = np.arange(len(el)) - np.repeat(np.cumsum(cells) - cells, cells)
        base = mix(h[el] + np.uint64(strip * 0xD6E8FEB86659FD93 & MASK) + cell.astype(np.uint64) * np.uint64(0xA5A3564E27F8862B))
        at = np.zeros(len(el))
        n = 0
        while len(el):
            x = mix(base + np.uint64(n * 0x9E3779B97F4A7C15 + 1 & MASK))
            at = at - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            live = at < 1
            el, cell, base, at, x = el[live], cell[live], base[live], at[live], x[live]
            r = (cell + at) / width
            y = mix(x)
            inside = (r < bound[el]) & (low + width * (y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < weight[el])
            who.append(el[inside])
            rank.append(r[inside])
            name.append(mix(y[inside]))
            n += 1
        low, width, strip = (1.0, 1.0, 1) if strip == 0 else (low * 2, width * 2, strip + 1)
        active = active[weight[active] > low]
    if not who:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(rank), np.concatenate(name)


def signatures(n: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, k: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Texts with elements, and for each the least dart of each coordinate (rank and identity in 64 bits)."""
    total = np.bincount(doc, weights=weight, minlength=n)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, k), empty, np.uint64)
    bound = np.zeros(n)
    bound[total > 0] = DARTS * k / total[total > 0]
    todo = total > 0
    while todo.any():
        rows = np.flatnonzero(todo[doc])
        el, rank, name = darts(h[rows], weight[rows], bound[doc[rows]])
        slot = doc[rows][el] * k + ((name >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        value = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (name & np.uint64(0xFFFFFFFF))
        flat = out.reshape(-1)
        np.minimum.at(flat, slot, value)
        todo &= (out == empty).any(axis=1)  # a coordinate without a dart: look twice as far
        bound *= 2
    full = np.flatnonzero(total > 0)
    return full, out[full]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, b * rows + r])
        out[:, b] = x
    return out


def similarities(a: Scan, b: Scan) -> np.ndarray:
    """The larger of plain and weighted Jaccard for aligned texts."""
    da, ha, ca = shingles(a)
    db, hb, cb = shingles(b)
    key = np.concatenate([mix(ha ^ mix(da.astype(np.uint64) + np.uint64(1))), mix(hb ^ mix(db.astype(np.uint64) + np.uint64(1)))])
    doc, count = np.concatenate([da, db]), np.concatenate([ca, cb])
    order = np.argsort(key, kind="stable")
    key, doc, count = key[order], doc[order], count[order]
    both = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount(doc[both], minlength=a.n)
    shared = np.bincount(doc[both], weights=np.minimum(count[both], count[both + 1]), minlength=a.n)
    sets, sums = np.bincount(doc, minlength=a.n), np.bincount(doc, weights=count, minlength=a.n)
    return np.maximum(common / np.maximum(sets - common, 1), shared / np.maximum(sums - shared, 1))


def nodes(docs: DataFrame, *keep: str) -> DataFrame:
    """(id, text, node, <keep>): ``node`` is the id, but a negative key of id and text where rows share an id and not their text."""
    rows = docs.select(node().alias("__id"), text_of().alias("__words"), *keep)
    several = cut(rows.groupBy("__id").agg(F.min(F.xxhash64("__words")).alias("low"), F.max(F.xxhash64("__words")).alias("high")).where("low < high").select(F.col("__id").alias("__several")))
    if several.isEmpty():
        return rows.withColumn("__node", F.col("__id"))
    own = -F.abs(F.xxhash64(F.lit(2), "__id", "__words") % (1 << 62)) - 1
    return rows.join(several, F.col("__id") == F.col("__several"), "left").withColumn("__node", F.when(F.col("__several").isNull(), F.col("__id")).otherwise(own)).drop("__several")


def node(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The document's key: its id, or for a null id a negative key of its text."""
    return F.coalesce(F.col(doc_id).cast("long"), -F.abs(F.xxhash64(text_of(text)) % (1 << 62)) - 1)


def sign(batches):
    for b in batches:
        ids, k1, k2 = (b.column(c) for c in ("id", "k1", "k2"))
        for scan in scans(b, lower=True):
            doc, h, count = shingles(scan)
            rows, sig = signatures(scan.n, doc, h, count.astype(np.float64))
            keys = band_keys(sig)
            part = (np.bincount(doc, weights=count > 1, minlength=scan.n) > 0)[doc]
            again, sig = signatures(scan.n, doc[part], h[part], np.ones(int(part.sum())))
            plain = band_keys(sig)
            new = plain != keys[np.searchsorted(rows, again)]  # a band that is the same in both is there already
            owner = np.concatenate([np.repeat(rows, BANDS), np.repeat(again, BANDS)[new.reshape(-1)]])
            keys = np.concatenate([keys.reshape(-1), plain[new]]).view(np.int64)[np.argsort(owner, kind="stable")]
            off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=scan.n)[rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys))
            at = pa.array(rows + scan.first)
            yield pa.RecordBatch.from_arrays([ids.take(at), k1.take(at), k2.take(at), lists], names=["id", "k1", "k2", "bands"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that the exact check passes."""

    def check(batches):
        for b in batches:
            near, i = [], 0
            step = max(1, int(len(b) * (1 << 20) / max(1, b.nbytes)))
            while i < len(b):  # what a slice needs is freed before the next
                part = b.slice(i, step)
                near.append(similarities(*(next(scans(part, c, lower=True, limit=1 << 62)) for c in ("ta", "tb"))) >= threshold)
                i += step
            if not near:
                continue
            near = np.concatenate(near)
            yield b.select(["a", "b"]).filter(pa.array(near))

    first = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def elements(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, element and copy number of the multiset's elements: a shingle that occurs c times gives c of them."""
    doc, h, count = shingles(scan)
    copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), mix(np.repeat(h, count) + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), copy


def narrowed(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, id, root, n): groups of members (id, root) that hold every pair at the threshold or beyond, by rare shingles that both have."""

    def explode(batches):
        for b in batches:
            ids, roots = b.column("id"), b.column("root")
            for scan in scans(b, lower=True):
                owner, element, copy = elements(scan)
                every, plain = np.bincount(owner, minlength=scan.n), np.bincount(owner[copy == 0], minlength=scan.n)
                at = pa.array(owner + scan.first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), roots.take(at), pa.array(element.view(np.int64)), pa.array(copy == 0), pa.array(every[owner]), pa.array(plain[owner])],
                    names=["id", "root", "key", "plain", "n_all", "n_plain"],
                )

    rows = members.join(texts, "id").mapInArrow(explode, "id long, root long, key long, plain boolean, n_all long, n_plain long")
    rows = cut(rows)
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    rarest = Window.partitionBy("id").orderBy("df", "key")
    ranked = rows.join(counts, "key", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumns({"i": F.row_number().over(rarest), "j": F.sum(F.col("plain").cast("int")).over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    reach = lambda n: F.col(n) - F.ceil(F.col(n) * F.lit(threshold) - F.lit(1e-9)) + 1
    first = cut(ranked.where((F.col("df") > 1) & ((F.col("i") <= reach("n_all")) | (F.col("plain") & (F.col("j") <= reach("n_plain"))))).select("key", "id", "root"))
    groups = cut(first.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    return cut(first.join(groups, "key"))


def spread(rest: DataFrame) -> DataFrame:
    """(key, id, root, lo, hi): the members of buckets (key, id, root) in blocks of about ``BLOCK``, once for each block that theirs must meet.

    A root with many members in a bucket has blocks of its own, which needn't meet each other, so a large component is dealt once for each block of the others.
    """
    roots = cut(rest.groupBy("key", "root").agg(F.count("*").alias("c")))
    large = F.col("c") >= BLOCK // 2
    few = F.sum(F.when(~large, F.col("c")).otherwise(0)).alias("few")
    plans = roots.groupBy(F.col("key").alias("p_key")).agg(few, F.array_sort(F.collect_list(F.when(large, F.struct(F.col("root"), F.ceil(F.col("c") / BLOCK).cast("int").alias("k"))))).alias("own"))
    plans = cut(plans.withColumn("shared", F.ceil(F.col("few") / BLOCK).cast("int")).drop("few"))
    at = lambda x: F.array_position(F.transform("own", lambda o: o["root"]), x)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, o: acc + o["k"])
    rows = rest.select("key", "id", "root").join(plans, F.col("key") == F.col("p_key")).drop("p_key").withColumn("place", at(F.col("root")).cast("int"))
    rows = rows.withColumns({"first": F.when(F.col("place") == 0, 0).otherwise(F.col("shared") + total(F.slice("own", 1, F.greatest(F.col("place") - 1, F.lit(0))))), "k": F.when(F.col("place") == 0, F.col("shared")).otherwise(F.get("own", F.col("place") - 1)["k"]), "all": F.col("shared") + total(F.col("own"))})
    rows = rows.withColumn("blk", F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda o: (F.col("place") == 0) | (o < F.col("first")) | (o >= F.col("first") + F.col("k")))
    return rows.select("key", "id", "root", "blk", F.explode(others).alias("other")).select("key", "id", "root", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))


def resolved(dealt: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that join components within buckets, from rows (key, id, root, lo, hi).

    Two blocks meet in one place; there a product of incidence matrices gives every similarity, and only links that join what is apart go on, fewer than members.
    """
    sizes = texts.select("id", F.octet_length("text").cast("long").alias("bytes"))
    load = dealt.join(sizes, "id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    parts = max(64, -(-(load["rows"] or 0) // PART_ROWS), -(-(load["bytes"] or 0) // PART_BYTES))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts)).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        roots = table.column("root").to_numpy()
        place = np.unique(np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")]), axis=1, return_inverse=True)[1].ravel()
        known, first, back = np.unique(ids, return_index=True, return_inverse=True)
        once = table.take(pa.array(first)).column("text").combine_chunks()
        parts = []
        for scan in scans(pa.RecordBatch.from_arrays([once], names=["text"]), lower=True):
            doc, element, copy = elements(scan)
            parts.append((doc + scan.first, element, copy > 0))
        owner, element, extra = (np.concatenate(x) for x in zip(*parts, strict=True))
        off = np.searchsorted(owner, np.arange(len(known) + 1))
        a, b = [], []
        order = np.argsort(place, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            docs = np.unique(back[rows])
            root = dict(zip(back[rows].tolist(), roots[rows].tolist(), strict=True))
            root = np.array([root[d] for d in docs.tolist()])
            if len(np.unique(root)) < 2:
                continue
            size = np.diff(off)[docs]
            at = np.repeat(off[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            sims = block_similarity(np.repeat(np.arange(len(docs)), size), element[at], extra[at], len(docs))
            i, j = np.nonzero(np.triu((sims >= threshold) & (root[:, None] != root[None, :]), 1))
            parent = {}

            def find(x, parent=parent):
                while x in parent:
                    x = parent[x]
                return x

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(int(root[x])), find(int(root[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(int(known[docs[x]]))
                    b.append(int(known[docs[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(texts, "id").groupBy("part").applyInArrow(meet, "a long, b long")


def block_similarity(owner: np.ndarray, elements: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    """The larger of plain and weighted Jaccard for all pairs of n sets; ``extra`` marks the second and later copies of an element."""
    common = {False: np.zeros((n, n), np.float32), True: np.zeros((n, n), np.float32)}
    sizes = {k: np.bincount(owner[extra == k], minlength=n).astype(np.float32) for k in (False, True)}
    for k, total in common.items():
        names, column = np.unique(elements[extra == k], return_inverse=True)
        who = owner[extra == k]
        shared = np.bincount(column, minlength=len(names)) > 1  # others are in no two sets
        new = np.cumsum(shared) - 1
        who, column = who[shared[column]], new[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        who, column = who[order], column[order]
        for low in range(0, int(shared.sum()), 4096):
            at = slice(*np.searchsorted(column, [low, low + 4096]))
            m = np.zeros((n, 4096), np.float32)
            m[who[at], column[at] - low] = 1
            total += m @ m.T
    plain = common[False] / np.maximum(sizes[False][:, None] + sizes[False][None, :] - common[False], 1)
    both, size = common[False] + common[True], sizes[False] + sizes[True]
    return np.maximum(plain, both / np.maximum(size[:, None] + size[None, :] - both, 1)).astype(np.float64) + 1e-7


CHUNK = 1 << 20


def contracted(batches):
    """Edges with the components of each ``CHUNK`` of them, and no other, as stars: at most one edge for each node of a chunk."""

    def stars(low, high):
        known, at = np.unique(np.concatenate([low, high]), return_inverse=True)
        x, y = at[: len(low)], at[len(low) :]
        root = np.arange(len(known))
        while True:
            old = root.copy()
            least = np.minimum(root[x], root[y])
            for side in (x, y):
                np.minimum.at(root, root[side], least)
                np.minimum.at(root, side, least)
            root = root[root]
            if (old == root).all():
                break
        out = np.flatnonzero(root != np.arange(len(known)))
        return pa.RecordBatch.from_arrays([pa.array(known[out]), pa.array(known[root[out]])], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        held.append((b.column("b").to_numpy(), b.column("a").to_numpy()))
        n += len(b)
        if n >= CHUNK:
            yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node with an edge; root is the least id of its component.

    Chunks of edges are contracted first.  Then large-star and small-star steps in turn, until the edges are the stars of the components.  Minima are
    pre-aggregated and joins can be split, so a node with very many edges is no obstacle; the lineage is cut each round.
    """

    def shape(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.count_distinct("a").alias("d")).first()
        return r["n"], r["s"], r["d"]

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    edges = cut(edges.mapInArrow(contracted, "a long, b long").distinct())
    before = shape(edges)
    while before[0]:
        if before[0] == before[2] and edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi").isEmpty():
            break  # every node has one edge, to a node without a lesser one: these are stars
        n = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # cut, so that the joins below can be split at nodes with very many edges
        least = cut(n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(n.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a != b").distinct())
        after = shape(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").union(edges.select("b", "b").distinct())


def rooted(docs: DataFrame, threshold: float) -> DataFrame:
    """(id, node, root) of each row of docs, where rows have one root that are in one class."""
    keyed = nodes(docs).select(F.col("__id").alias("own"), F.col("__node").alias("id"), F.col("__words").alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    groups = cut(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep")))  # cut, so that the join below can be split where copies abound
    members = cut(keyed.select("own", "id", "k1", "k2").join(groups, ["k1", "k2"]).select("own", "id", "rep"))
    groups_of_rep = groups.withColumnRenamed("rep", "id")
    signed = keyed.select("id", "k1", "k2", "text").mapInArrow(sign, "id long, k1 long, k2 long, bands array<long>")
    bands = cut(signed.join(groups_of_rep, ["k1", "k2", "id"]).select(F.explode("bands").alias("key"), "id"))
    texts = keyed.select("id", "text")

    buckets = bands.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("m"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    buckets = cut(buckets.select("key", F.col("m").bitwiseXOR(F.col("key")).alias("centre")))  # cut, so that the join can be split at keys with very many members
    crowded = cut(bands.join(buckets, "key"))
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    tried = cut(crowded.where("id != centre").select(*pair("id", "centre")).distinct())
    links = cut(verified(tried, texts, threshold))
    roots = cut(components(links))

    # buckets that still hold several components
    labelled = crowded.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    labelled = cut(labelled)
    mixed = cut(labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    rest = cut(labelled.join(mixed, "key"))
    dealt = cut(spread(rest.where(F.col("n") <= BLOCK)))
    if not mixed.where(F.col("n") > BLOCK).isEmpty():
        large = rest.where(F.col("n") > BLOCK)
        blocks = cut(spread(large))
        if blocks.count() > MANY * large.count():  # rather by rare shingles, if those groups are less
            rare = cut(spread(narrowed(large.select("id", "root").distinct(), texts, threshold)))
            blocks = min((blocks, rare), key=lambda d: d.count())
        dealt = cut(dealt.unionByName(blocks))
    found = cut(resolved(dealt, texts, threshold))
    if not found.isEmpty():
        roots = cut(components(links.union(found)))
    return members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("own").alias("id"), F.col("id").alias("node"), F.coalesce("root", "rep").alias("root"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) for each row of docs: ``class_id`` is the least id among documents linked by near or equal texts."""
    found = cut(rooted(docs, threshold))
    if found.where("id != node").isEmpty():
        return found.select("id", F.col("root").alias("class_id"))
    names = cut(found.groupBy("root").agg(F.min("id").alias("class_id")))
    return found.join(names, "root").select("id", "class_id")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class with all its columns, that of the least node: the least id, unless ids are shared by different texts."""
    found = cut(rooted(docs, threshold))
    losers = found.where("node != root").select(F.col("node").alias("__node")).distinct()
    kept = nodes(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text"), "__row").join(losers, "__node", "left_anti")
    sizes = found.agg(F.count("*").alias("n"), F.count_distinct("node").alias("d")).first()
    if sizes["n"] != sizes["d"]:  # equal rows: one of them
        kept = kept.dropDuplicates(["__node"])
    return kept.select(*(F.col(f"__row.`{c}`") for c in docs.columns))
