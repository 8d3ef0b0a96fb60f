"""Best-fit packing with certified bin counts.

Every document becomes the ids of a byte-level BPE and an end id.  Longer documents are cut into pieces of ``length`` ids, of
which the first may be shorter; full pieces are sequences of their own and take no part in what follows.  The others are packed:

1. They are numbered in a stored table and dealt by a hash of the number into parts of about ``PART_ITEMS`` pieces, and each part is packed by
   best-fit decreasing.  Only numbers and lengths move.
2. A lower bound certifies a part: the greatest of the bounds that dual feasible functions give (size itself; the rounding functions
   u_k; the thresholds that weigh items beyond C - t as whole and drop those under t).  A part whose count of sequences equals
   its bound is optimal.
3. From a part with a gap, the pieces in sequences that aren't full go into an exchange, ``FAN`` neighbouring parts to a pool, and the pool is
   packed again; the new packing counts only if it takes fewer sequences than the old ones had.  That is repeated ``ROUNDS`` times.
   Sequences that are full, and parts that are certified, stay.

Numbers are unique to rows, so equal rows are dealt like any others and a part's size doesn't depend on the data; a document of thousands of pieces
adds one piece at most to a part.  Pieces carry what the caller wants (ids, or a digest of them).

Null texts are empty: their one id is the end id.  Each row is packed for itself, also rows that repeat or share a doc_id.
Ties go by the rows' numbers.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import cut, text_of

LENGTH = 1024
END_ID = 2
PART_ITEMS = 4096
FAN, ROUNDS = 2, 3

_encoders: dict[tuple[str, str | None], object] = {}


class Encoder:
    """Ids of the BPE in ``path`` (a tokenizers file).

    With ``ranks`` (the same vocabulary as ranks) texts of ASCII and Latin letters go through the faster library, which gives the same
    ids there; all others, and texts with a special token's string, go through the tokenizers library itself.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.simple = regex.compile(r"[\t\n\r\x20-\x7e¡-ſ]*")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and self.simple.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One for each Python worker."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks, pattern)
    return _encoders[path, ranks]


def public_bpe() -> dict:
    """Where the public 50k byte-level BPE lies on a worker."""
    import public_tokenizers as p

    return {"path": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def pieces(docs: DataFrame, *, tokenizer=public_bpe, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut_up(batches):
        enc = encoder(**tokenizer())
        for b in batches:
            texts = b.column("text")
            for low in range(0, len(b), 512):
                rows, nums, ids = [], [], []
                for i, text in enumerate(texts[low : low + 512].to_pylist()):
                    all_ids = np.append(enc(text), np.uint32(end_id)).astype("<u4")
                    start, k = 0, 0
                    while start < len(all_ids):
                        size = (len(all_ids) - 1) % length + 1 if k == 0 else length
                        rows.append(low + i)
                        nums.append((k, start, size))
                        ids.append(all_ids[start : start + size].tobytes())
                        start, k = start + size, k + 1
                ks, starts, sizes = zip(*nums, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(ks, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut_up, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and what is left in each bin.  Bins are kept by what is left, so each step takes constant time."""
    bins = np.zeros(len(sizes), np.int64)
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r left
    left: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            k = by_left[r].pop()
            if not by_left[r]:
                mask ^= 1 << r
        else:
            r, k = capacity, len(left)
            left.append(capacity)
        bins[i] = k
        left[k] = r = r - s
        by_left[r].append(k)
        mask |= 1 << r
    return bins, np.array(left, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins among those of dual feasible functions."""
    hist = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((hist * x).sum()) // capacity)
    # u_k: multiples of C / (k + 1) keep their size, others are rounded down to multiples of C / k
    for k in range(1, 33):
        scaled = x * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, x * k, scaled // capacity * capacity)  # in units of C * k
        best = max(best, -(-int((hist * value).sum()) // (capacity * k)))
    # thresholds: beyond C - t a whole bin, from t on its size, under t nothing
    count, volume = np.cumsum(hist), np.cumsum(hist * x)
    t = np.arange(1, capacity // 2 + 1)
    big = count[-1] - count[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(best, int((big + -(-middle // capacity)).max()))
    # the same, with items beyond one half whose rest the middle ones cannot fill
    half = count[-1] - count[capacity // 2]
    return max(best, int(half))


def repack(sizes: np.ndarray, old: np.ndarray | None, capacity: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bins, open marks and certificate of a part: ``open`` are items to exchange (none in a certified part)."""
    bins, left = best_fit_decreasing(sizes, capacity)
    if old is not None:
        before = np.unique(old, return_inverse=True)[1]
        if len(left) >= before.max() + 1:
            bins = before
            left = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
    sure = len(left) == lower_bound(sizes, capacity)
    return bins, (left[bins] > 0) & (not sure), sure


def places(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each item starts in its bin, items in the given order."""
    order = np.argsort(bins, kind="stable")
    end = np.cumsum(sizes[order])
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    start = end - sizes[order]
    out = np.empty(len(bins), np.int64)
    out[order] = start - np.repeat(start[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
    return out


def dealt(numbered: DataFrame, n: int) -> DataFrame:
    """(__row, length, __part) of n rows with numbers, in parts of about ``PART_ITEMS``."""
    return numbered.select("__row", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64("__row"), F.lit(max(1, -(-n // PART_ITEMS))).cast("long")).alias("__part"))


def sequences(items: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """items (with a column ``length`` from 1 up to the length of sequences) plus sequence_id and offset; all other columns are carried.

    Items are stored once with a number each; only numbers and lengths are dealt, packed and exchanged, and meet their items again at the end.
    """
    long = lambda x: F.lit(x).cast("long")
    stored = cut(items.withColumn("__row", F.monotonically_increasing_id()))
    whole = stored.where(F.col("length") == length)
    open_items = stored.where(F.col("length") < length)
    work = T.StructType([T.StructField("__row", T.LongType()), T.StructField("length", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("__part", "__bin", "__offset")), T.StructField("__open", T.BooleanType())])

    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        sizes = table.column("length").to_numpy().astype(np.int64)
        old = table.column("__bin").to_numpy()
        bins, opened, _ = repack(sizes, None if old[0] < 0 else old, length)
        # sequences of a pool are numbered from its first part on
        number = bins + (int(table.column("__part").to_numpy().min()) << 24)
        for name, x in (("__bin", number), ("__offset", places(bins, sizes)), ("__open", opened)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(x))
        return table.select(work.names)

    start = dealt(open_items, open_items.count()).withColumns({"__bin": long(-1), "__offset": long(0), "__open": F.lit(True)})
    state = cut(start.groupBy("__part").applyInArrow(step, work))
    done = []
    for r in range(ROUNDS):
        done.append(state.where("not __open").withColumn("__round", long(r)))
        pool = state.where("__open").withColumn("__pool", F.floor(F.col("__part") / F.lit(FAN ** (r + 1))))
        state = cut(pool.groupBy("__pool").applyInArrow(step, work))
        if state.isEmpty():
            break
    done.append(state.withColumn("__round", long(ROUNDS)))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    # even numbers for packed sequences, odd ones for items that fill a sequence alone
    placed = placed.select("__row", (2 * (F.col("__bin") * (ROUNDS + 1) + F.col("__round"))).alias("sequence_id"), F.col("__offset").alias("offset"))
    alone = whole.select(*items.columns, (2 * F.col("__row") + 1).alias("sequence_id"), long(0).alias("offset"))
    return open_items.join(placed, "__row").select(*items.columns, "sequence_id", "offset").unionByName(alone)


def pack(docs: DataFrame, *, payload: Column | None = None, name: str = "ids", length: int = LENGTH, tokenizer=public_bpe) -> DataFrame:
    """All of docs packed: (doc_id, piece, start, length, <payload>, sequence_id, offset); the payload is the ids unless another is given."""
    items = pieces(docs, tokenizer=tokenizer, length=length).select("doc_id", "piece", "start", "length", (F.col("ids") if payload is None else payload).alias(name))
    return sequences(items, length=length)
