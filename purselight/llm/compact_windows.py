"""Near-duplicate passages by compact windows.

The tokens of a document are its five-word shingles. For each of `hashes` hash functions a Cartesian tree over the
tokens' hash values groups all subsequences by their min-hash: a node at c whose subtree spans l..r stands for every
subsequence that holds c within l..r, and they all have the hash of token c as signature. Only nodes that span
`min_words` words are kept, about 2 / min_words per token and hash. (Equal tokens are ordered by a hash of their place,
so that the tree stays balanced in monotonous texts.)

Windows with one signature meet sorted by document. A window is paired with the first and with the preceding one of
another document at first. Pairs of windows of two documents are joined as intervals, over all hashes, into
candidate regions; those in which `agree` hashes have a part are verified: in the region, the stretch that the
other document's shingles cover best is cut out, and a passage is reported if both sides have `min_words` words and the
shingle sets have a similarity of `percent` / 100.

Documents that this leaves in different classes are then compared wherever they share a key and, on one side of its
token, the sketch (a min-hash of 10 bits) of the tokens a quarter to half a passage away; a passage that holds a token
reaches that far on one side at least. Of all pairs of their windows that are not alike, those go on to verification
that share as many shingles, as densely around the token, as similar passages must; one agreeing hash is enough there.

Two passages of that similarity share the min-hash of each function with probability 0.75 or more, so that fewer than
two of seven functions agree with probability 0.13 % at most. Documents that hold equal passages always come into one
class: there all functions agree, on the sketches too. What is reported of documents of one class are the passages that
each shares with its partners above, not those of all its pairs.

Defined results: null, empty and short texts have no passages; texts of any length are searched whole (a window tells
2^20 - 1 tokens on either side apart, and longer passages are found by their parts); only passages in documents with
different doc_id are reported (null counts as one id); repeated rows give the same passages once; of equal hash values
the first place counts; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purselight.llm.common import binaries, blocks, components, cut, grams, map_batches, mix, signed, word_hashes
from purselight.llm.url_bloom import maybe

SHINGLE = 5
NULL_ID = -(2**63)
REACH = (1 << 20) - 1  #: tokens of a window on either side of c that a row tells apart
SKETCH = 10  #: bits of the sketch of what stands on one side of c
COLUMNS, KINDS = ["key", "doc", "c", "ext", "body"], [np.int64, np.int64, np.int32, np.int64, np.int32]
WINDOWS = "key long, doc long, c int, ext long, body int"
_TIE = np.uint64((1 << 16) - 1)
_NONE = np.uint64(2**64 - 1)


def tokens(text: bytes) -> np.ndarray:
    """Shingle hashes by start; A-Z count as a-z."""
    return grams(word_hashes(text.lower().split()), SHINGLE)


def token_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, one after the other; where each text's begin, and the end)."""
    words = [t.lower().split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    g = grams(word_hashes([x for w in words for x in w]), SHINGLE)
    tail = np.repeat(np.cumsum(size), size) - np.arange(size.sum())  # words from here to the text's end
    return g[tail[: len(g)] >= SHINGLE], np.r_[0, np.cumsum(np.maximum(size - SHINGLE + 1, 0))]


def sliding(v: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """of (minimum or maximum) over each run of `width` values."""
    if len(v) < width:
        return v[:0]
    span = 1
    while 2 * span <= width:
        v = of(v[:-span], v[span:])
        span *= 2
    return of(v[: len(v) - (width - span)], v[width - span :])


def bounds(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the index of the last one before it in its text that is not larger, and of the first after it that is smaller (-1: none).

    Pointers jump over larger values, all at once.
    """
    n = np.arange(len(value))
    same = text[1:] == text[:-1]
    out = []
    for pointer, passed in ((np.r_[-1, np.where(same, n[:-1], -1)], np.greater), (np.r_[np.where(same, n[1:], -1), -1], np.greater_equal)):
        at = n
        while True:
            at = at[pointer[at] >= 0]
            at = at[passed(value[pointer[at]], value[at])]
            if not len(at):
                break
            pointer[at] = pointer[pointer[at]]
        out.append(pointer)
    return out[0], out[1]


def compact_windows(values: np.ndarray, width: int, start: np.ndarray | None = None) -> np.ndarray:
    """Rows (l, c, r), ends included, of the nodes of the Cartesian trees that span `width` values or more.

    start: where each text's values begin, and the end; one text by default. Of equal values the first is the least.
    A node that wide is the least of some run of `width` values, and so are the nodes above it, which bound its span.
    """
    start = np.array([0, len(values)]) if start is None else start
    if len(values) < width:
        return np.empty((0, 3), np.int64)
    values = values.astype(np.uint64)
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    least = np.where(text[: len(values) - width + 1] == text[width - 1 :], sliding(values, width), 0)
    pad = np.zeros(width - 1, np.uint64)
    c = np.nonzero(sliding(np.r_[pad, least, pad], width, np.maximum) == values)[0]
    before, after = bounds(values[c], text[c])
    left = np.where(before >= 0, c[before] + 1, start[text[c]])
    right = np.where(after >= 0, c[after] - 1, start[text[c] + 1] - 1)
    return np.stack([left, c, right], 1)[right - left + 1 >= width]


def side_sketches(t: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token a min-hash of SKETCH bits of the tokens width // 4 to width // 2 places before it, and after it.

    0 where its text does not reach that far. A passage of `width` tokens that holds a token reaches width // 2 tokens
    or more from it on one side at least.
    """
    far = width // 2
    near = max(1, far // 2)
    least = sliding(mix(t ^ _NONE), far - near + 1)
    sketch = 1 + (mix(least) % np.uint64((1 << SKETCH) - 1)).astype(np.int64)
    n, text = np.arange(len(t)), np.repeat(np.arange(len(start) - 1), np.diff(start))
    before = np.where(n - far >= start[text], sketch[np.clip(n - far, 0, max(len(sketch) - 1, 0))], 0) if len(sketch) else np.zeros(len(t), np.int64)
    after = np.where(n + far < start[text + 1], sketch[np.clip(n + near, 0, max(len(sketch) - 1, 0))], 0) if len(sketch) else np.zeros(len(t), np.int64)
    return before, after


def run_hashes(t: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends (included) that hashes those runs of t, to 32 bits, from sums of prefixes."""
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    power = np.cumprod(np.full(len(t) + 1, base))
    back = np.cumprod(np.full(len(t) + 1, np.uint64(pow(int(base), -1, 1 << 64))))
    total = np.r_[np.uint64(0), np.cumsum(mix(t) * power[: len(t)])]
    return lambda a, b: (mix((total[b + 1] - total[a]) * back[a] + (b - a).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_rows(docs: DataFrame, hashes: int, min_words: int) -> DataFrame:
    """key, doc, c, ext (see unpack()), body: hash of the window's tokens up to 2 * width from c.

    Windows that reach further than REACH lose nothing: what they stand for beyond belongs to other windows too, which
    join them.
    """
    if hashes > 16:
        raise ValueError("at most 16 hash functions")
    width = min_words - SHINGLE + 1
    seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 64):  # arrays that stay in the processor's cache
            part = batch.slice(a, b - a)
            t, start = token_block(binaries(part, "text"))
            if not len(t):
                continue
            doc, size = part.column("doc").to_numpy(), np.diff(start)
            place = np.arange(len(t)) - np.repeat(start[:-1], size)
            text = np.repeat(np.arange(len(size)), size)
            tie = mix(place.astype(np.uint64)) & _TIE
            sides = side_sketches(t, start, width)
            sides, body = sides[0] << SKETCH | sides[1], run_hashes(t)
            out = []
            for j, seed in enumerate(seeds):
                v = (t ^ seed) * (seed | np.uint64(1))  # tokens are well mixed, so that an odd factor orders them anew
                left, c, right = compact_windows(v & ~_TIE | tie, width, start).T
                before, after = np.minimum(c - left, REACH), np.minimum(right - c, REACH)
                near = body(np.maximum(left, c - 2 * width), np.minimum(right, c + 2 * width))
                out.append((signed(v[c]), doc[text[c]], place[c], before << 44 | after << 24 | sides[c] << 4 | j, near))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(zip(*out, strict=True), KINDS, strict=True)], names=COLUMNS)

    return map_batches(keyed(docs), f, WINDOWS)


def unpack(ext: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, hash function) of column ext: tokens of the window before and after c, up to REACH each.

    Between after and the function stand the sketches of both sides.
    """
    return ext >> 44 & REACH, ext >> 24 & REACH, ext & 15


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))


def partners(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and doc: index of the key's first row, and of the last row of the key's preceding document (-1: none)."""
    n = np.arange(len(key))
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
    first = np.maximum.accumulate(np.where(new_key, n, 0))
    start = np.maximum.accumulate(np.where(new_doc, n, 0))
    return first, np.where(start > first, start - 1, -1)


def shared_windows(windows: DataFrame) -> DataFrame:
    """The windows of keys that two or more documents hold; tried: window_pairs() makes all pairs of the key."""

    def rows(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc = x[:2]
        if not len(key):
            return
        start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        size = np.diff(np.r_[start, len(key)])
        one, two, three = doc[start], doc[start + (size > 1)], doc[start + np.minimum(size - 1, 2)]
        few = (size == 2) & (one != two) | (size == 3) & (one != two) & (one != three) & (two != three)
        keep, tried = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), size), np.repeat(few, size)
        if keep.any():
            out = [pa.array(v[keep].astype(k)) for v, k in zip(x, KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(tried[keep])], names=[*COLUMNS, "tried"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * len(COLUMNS)  # the rows of the last key
        for batch in batches:
            x = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, COLUMNS, strict=True)]
            at = int(np.searchsorted(x[0], x[0][-1], "left")) if len(x[0]) else 0
            yield from rows([v[:at] for v in x])
            held = [v[at:] for v in x]
        yield from rows(held)

    return windows.repartition("key").sortWithinPartitions("key").mapInArrow(f, f"{WINDOWS}, tried boolean")


def window_pairs(windows: DataFrame) -> DataFrame:
    """a, b (b < a), and for the stretch that both windows' tokens can share: from and to in a, from in b, bit of j.

    Rows of a key stream through a task; what is held of a key is its first row and the last rows of two documents.
    """
    columns = ["key", "doc", "c", "ext"]
    names = ["a", "b", "a_from", "a_to", "b_from", "hashes"]
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * len(columns)
        for batch in batches:
            n = len(held[0])
            x = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, columns, strict=True)]
            key, doc, c, ext = x
            before, after, j = unpack(ext)
            first, previous = partners(doc, key)
            here = np.arange(len(key))
            star = here[(here >= n) & (doc != doc[first])]
            chain = here[(here >= n) & (previous >= 0)]
            chain = chain[doc[previous[chain]] != doc[first[chain]]]
            a, b = np.r_[star, chain], np.r_[first[star], previous[chain]]
            back, on = np.minimum(before[a], before[b]), np.minimum(after[a], after[b])
            if len(a):
                out = doc[a], doc[b], c[a] - back, c[a] + on, c[b] - back, 1 << j[a]
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(k)) for v, k in zip(out, kinds, strict=True)], names=names)
            keep = sorted({int(first[-1]), len(key) - 1, *([int(previous[-1])] if previous[-1] >= 0 else [])})
            held = [v[keep] for v in x]

    rows = windows.select(columns).repartition("key").sortWithinPartitions("key", "doc", "c")
    return rows.mapInArrow(f, "a long, b long, a_from int, a_to int, b_from int, hashes int")


def regions(pairs: DataFrame, slack: int, agree: int) -> DataFrame:
    """Interval join of the window pairs of two documents: a, b, a_from, a_to, b_from, b_to (ends included).

    Stretches are sorted by their start in a; one joins a region that it overlaps, or from which at most `slack` tokens
    separate it, in both documents.
    """
    names = ["a", "b", "a_from", "a_to", "b_from", "b_to"]

    def merged(batch: pa.RecordBatch) -> list[np.ndarray]:
        """a, b, a_from, a_to, b_from, b_to, bits: rows that each overlap the one before them are one already."""
        a, b, a0, a1, b0, bits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "a_from", "a_to", "b_from", "hashes"))
        if not len(a):
            return [a, b, a0, a1, b0, b0, bits]
        b1 = b0 + a1 - a0
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (a0[1:] > a1[:-1] + slack) | (b0[1:] > b1[:-1] + slack) | (b0[:-1] > b1[1:] + slack)
        at = np.nonzero(np.r_[True, new])[0]
        return [a[at], b[at], a0[at], np.maximum.reduceat(a1, at), np.minimum.reduceat(b0, at), np.maximum.reduceat(b1, at), np.bitwise_or.reduceat(bits, at)]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, []

        def row(x: list) -> tuple:
            return (*now, *x[:4])

        for batch in batches:
            out = []
            for a, b, a0, a1, b0, b1, bits in zip(*(x.tolist() for x in merged(batch)), strict=True):
                if (a, b) != now:
                    out += [row(x) for x in opened if x[4].bit_count() >= agree]
                    now, opened = (a, b), []
                rest = []
                for x in opened:
                    if x[1] + slack < a0:  # nothing that follows can reach it
                        out += [row(x)] if x[4].bit_count() >= agree else []
                    elif b0 <= x[3] + slack and x[2] <= b1 + slack:
                        a0, a1, b0, b1, bits = min(a0, x[0]), max(a1, x[1]), min(b0, x[2]), max(b1, x[3]), bits | x[4]
                    else:
                        rest.append(x)
                opened = [*rest, [a0, a1, b0, b1, bits]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=names)
        out = [row(x) for x in opened if x[4].bit_count() >= agree]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=names)

    rows = pairs.repartition("a", "b").sortWithinPartitions("a", "b", "a_from", "b_from")
    return rows.mapInArrow(f, ", ".join(f"{c} long" for c in names))


def cut_out(docs: DataFrame, wanted: DataFrame, most: int = 500) -> DataFrame:
    """The shingles of the wanted stretches (doc, from, to, *keys) as column shingles, 32 bits each.

    Documents without a stretch are dropped where they are read, by a Bloom filter. The stretches of a document come in
    groups of about `most`, each with the text once, so that a document many others share does not send it with each.
    Rows may share an id (null counts as one): a stretch that begins beyond a row's text is none of that row.
    """
    keys = [c for c in wanted.columns if c not in ("doc", "from", "to")]
    ids = wanted.select(F.col("doc").cast("string").alias("url")).distinct()
    near = maybe(keyed(docs).withColumn("id", F.col("doc").cast("string")), "id", ids).where("maybe").select("doc", "text")
    parts = wanted.groupBy("doc").agg(F.ceil(F.count("*") / most).alias("parts"))
    some = wanted.join(parts, "doc").withColumn("part", F.pmod(F.xxhash64(*keys), F.col("parts"))).groupBy("doc", "part").agg(F.collect_list(F.struct("from", "to", *keys)).alias("x"))
    rows = near.join(some, "doc").select("text", "x")
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in wanted.schema if x.name in keys)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(batch.num_rows, 64):
                rows = batch.slice(lo, hi - lo)
                t, start = token_block(binaries(rows, "text"))
                t = (t >> np.uint64(32)).astype(np.uint32)
                row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(rows.column("x")).to_numpy())
                part = rows.column("x").flatten()
                from_, size = part.field("from").to_numpy(), np.diff(start)[row]
                end = np.minimum(part.field("to").to_numpy() + 1, size)
                fits = from_ < size
                part, from_, end, row = part.filter(pa.array(fits)), from_[fits], end[fits], row[fits]
                length = np.maximum(end - from_, 0)
                total = np.cumsum(length)
                at = 0
                while at < len(length):  # 4 MiB at a time, or one stretch
                    to = max(at + 1, int(np.searchsorted(total, total[at] - length[at] + (1 << 20), "right")))
                    offsets = np.r_[0, total[at:to] - total[at] + length[at]] * 4
                    data = t[ranges((start[row] + from_)[at:to], length[at:to])]
                    shingles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([*(part.field(c).slice(at, to - at) for c in keys), shingles.cast(pa.binary())], names=[*keys, "shingles"])
                    at = to

    return rows.mapInArrow(f, f"{kinds}, shingles binary")


class Heights:
    """For each of several rows of hits, one after the other: the course of their sum, hits counting 1 and others -misses.

    sizes: lengths of the rows. A row of n hits has n + 1 heights, and begins just below the least of the row before.
    """

    def __init__(self, hit: np.ndarray, sizes: np.ndarray, misses: int):
        kind = np.int32 if len(hit) < 1 << 26 else np.int64
        self.start = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        self.sizes = sizes + 1
        steps = np.zeros(len(hit) + len(sizes), kind)
        inner = np.ones(len(steps), bool)
        inner[self.start] = False
        steps[inner] = hit.astype(kind) * kind(misses + 1) - kind(misses)
        sums = np.cumsum(steps, dtype=kind)
        begin = sums[self.start]
        least = np.minimum.reduceat(sums, self.start) - begin
        self.top = (np.cumsum(least - 1) - least).astype(kind)  # heights at which rows begin, the first at -1
        self.height = sums + np.repeat(self.top - begin, self.sizes)
        self.low = np.minimum.accumulate(self.height)
        self.place = np.repeat(np.arange(len(sums), dtype=kind), -np.diff(self.low, prepend=kind(0)))  # by depth, the first place as low as that

    def first(self, height: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The first places, in rows that begin at `top`, that are no higher than `height`, which the rows must reach."""
        return self.place[~np.minimum(height, top)]

    def highest(self, x: np.ndarray) -> np.ndarray:
        """For each row the first place of its greatest value in x."""
        at = np.nonzero(x == np.repeat(np.maximum.reduceat(x, self.start), self.sizes))[0]
        return at[np.searchsorted(at, self.start)]


def best_stretches(hit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row start and end (excluded) of the stretch of greatest sum, hits counting 1 and others -3."""
    h = Heights(hit, sizes, 3)
    end = h.highest(h.height - h.low)
    return h.first(h.low[end], h.top) - h.start, end - h.start


def longest_stretches(hit: np.ndarray, sizes: np.ndarray, misses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row start and end (excluded) of the longest stretch, from a hit to a hit, with `misses` hits or more for each miss.

    The third array has the lengths of the stretches before misses at their ends are left out.
    """
    h = Heights(hit, sizes, misses)
    first = h.first(h.height, np.repeat(h.top, h.sizes))
    end = h.highest(np.arange(len(first), dtype=first.dtype) - first)
    begin, rows = first[end], np.arange(len(sizes))
    at = np.r_[np.nonzero(hit)[0], len(hit)]
    low, high = np.searchsorted(at, begin - rows), np.searchsorted(at, end - rows) - 1
    some, from_ = high >= low, h.start - rows
    return np.where(some, at[low] - from_, 0), np.where(some, at[high] + 1 - from_, 0), end - begin


CUTS = (lambda h, n: longest_stretches(h, n, 3), lambda h, n: longest_stretches(h, n, 6), best_stretches)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def passages(a: np.ndarray, b: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages shared by two stretches of shingles: (start, end) in a and b, ends excluded, and their similarity."""
    return [tuple(x[1:]) for x in zip(*(v.tolist() for v in all_passages([(a, b)], width, percent)), strict=True)]


def all_passages(pairs: list[tuple[np.ndarray, np.ndarray]], width: int, percent: int, block: int = 1 << 18) -> list[np.ndarray]:
    """passages() of many pairs of stretches (32 bits a shingle): number of the pair, start and end in a and b, similarity.

    What the search along a leaves of b is searched along b. Pairs are searched together, in blocks of so many shingles.
    """
    out = [[np.empty(0, np.int64)] * 5 + [np.empty(0)]]
    some, held = [], 0
    for k, (a, b) in enumerate(pairs):
        if min(len(a), len(b)) < width:
            continue
        if len(a) == len(b) and (a == b).all():
            out.append([np.array([x]) for x in (k, 0, len(a), 0, len(b), 1.0)])
            continue
        if some and (held + len(a) + len(b) > block or len(some) == 512):
            out.append(block_passages(pairs, some, width, percent))
            some, held = [], 0
        some.append(k)
        held += len(a) + len(b)
    if some:
        out.append(block_passages(pairs, some, width, percent))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def block_passages(pairs: list[tuple[np.ndarray, np.ndarray]], some: list[int], width: int, percent: int) -> list[np.ndarray]:
    """all_passages() of the pairs numbered `some`."""
    size = np.array([len(x) for k in some for x in pairs[k]])
    start = np.cumsum(size) - size
    flat = np.concatenate([x for k in some for x in pairs[k]]).astype(np.uint64)
    bits = np.uint64(len(flat).bit_length())
    pair = np.repeat(np.arange(len(some), dtype=np.uint64), size[::2] + size[1::2])
    rising = np.sort((pair << np.uint64(32) | flat) << bits | np.arange(len(flat), dtype=np.uint64))
    new = np.r_[True, np.diff(rising >> bits) > 0]
    number = np.empty(len(flat), np.int64)  # of each shingle, among the distinct ones of all pairs in turn
    number[(rising & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)] = np.cumsum(new) - 1
    first = np.r_[number[start[::2]], new.sum()]
    np.minimum.reduceat(number, start[::2], out=first[:-1])
    a, b = ((start[k::2], size[k::2]) for k in (0, 1))

    def search_(a: tuple, b: tuple, pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        return search(number, first, a, b, width, percent, pair, lo, hi)

    n = np.arange(len(some))
    out = search_(a, b, n, a[0], a[0] + a[1])
    order = np.lexsort((out[3], out[0]))
    of, y0, y1 = (np.r_[out[k][order], v] for k, v in ((0, n), (3, b[0] + b[1]), (4, b[0] + b[1])))  # an end for each pair
    order = np.argsort(of, kind="stable")
    of, y0, y1 = of[order], y0[order], y1[order]
    left = np.maximum(b[0][of], np.r_[0, np.maximum.accumulate(y1)[:-1]])
    back = search_(b, a, of, left, y0)
    out = [np.concatenate([x, y]) for x, y in zip(out, [back[k] for k in (0, 3, 4, 1, 2, 5)], strict=True)]
    at_a, at_b = a[0][out[0]], b[0][out[0]]
    return [np.array(some)[out[0]], out[1] - at_a, out[2] - at_a, out[3] - at_b, out[4] - at_b, out[5]]


def search(number: np.ndarray, first: np.ndarray, a: tuple, b: tuple, width: int, percent: int, pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Passages along the parts lo..hi of the pairs' stretches a: pair, start and end in a and b, similarity.

    number: shingles of all stretches as numbers, those of each pair from `first` on; a, b: (start, length) by pair.
    The longest stretch of a of which b holds three quarters, and the like of b, are tried first; then six sevenths
    (what equally long sides need for 0.75) and the densest. What lies on either side of it is searched in turn. Where
    all fail, as b holds parts of the stretch in different places, the part that b's stretch covers and the rest are.
    """
    out = [[np.empty(0, np.int64)] * 5 + [np.empty(0)]]
    held = np.zeros(first[-1], bool)
    held[number[ranges(*b)]] = True
    hits = np.zeros(len(number), bool)
    at = ranges(*a)
    hits[at] = held[number[at]]
    waiting = [(pair, lo, hi)]
    while waiting:
        pair, lo, hi = (np.concatenate(x) for x in zip(*waiting, strict=True))
        keep = hi - lo >= width
        pair, lo, hi = pair[keep], lo[keep], hi[keep]
        # Each part needs its pair's stretch b and a table of the pair's shingles: some parts at a time.
        k = max(1, int(np.searchsorted(np.cumsum(hi - lo + b[1][pair] + first[pair + 1] - first[pair]), 1 << 20)))
        waiting = [(pair[k:], lo[k:], hi[k:])] if k < len(pair) else []
        pair, lo, hi = pair[:k], lo[:k], hi[:k]
        if not len(pair):
            break
        keep = np.add.reduceat(hits[ranges(lo, hi - lo)], np.cumsum(hi - lo) - hi + lo, dtype=np.int64) >= width * percent // 100
        pair, lo, hi = pair[keep], lo[keep], hi[keep]
        x0, x1, u0, u1 = lo.copy(), lo.copy(), np.full(len(lo), -1), np.full(len(lo), -1)
        split0, split1 = u0.copy(), u0.copy()
        todo = np.arange(len(lo))
        for turn, cut_ in enumerate(CUTS):
            if not len(todo):
                break
            size = (hi - lo)[todo]
            v = cut_(hits[ranges(lo[todo], size)], size)
            if not turn:  # no other cut is longer, of the part or of what lies within it
                long = v[2] >= width
                todo, v = todo[long], [x[long] for x in v]
            x0[todo], x1[todo] = lo[todo] + v[0], lo[todo] + v[1]
            k = todo[v[1] - v[0] >= width]
            if not len(k):
                continue
            of, size = pair[k], (x1 - x0)[k]
            many = first[of + 1] - first[of]
            table = np.cumsum(many) - many
            shift = table - first[of]
            at_a = number[ranges(x0[k], size)] + np.repeat(shift, size)
            s, t = np.zeros(many.sum(), bool), np.zeros(many.sum(), bool)
            s[at_a] = True
            y0, y1 = cut_(s[number[ranges(b[0][of], b[1][of])] + np.repeat(shift, b[1][of])], b[1][of])[:2]
            wide = np.where(y1 - y0 >= width, y1 - y0, 0)
            y0 = y0 + b[0][of]
            t[number[ranges(y0, wide)] + np.repeat(shift, wide)] = True
            both, union = (np.add.reduceat(x, table, dtype=np.int64) for x in (s & t, s | t))
            like = (wide > 0) & (100 * both >= percent * union)
            out.append([of[like], x0[k[like]], x1[k[like]], y0[like], (y0 + wide)[like], both[like] / union[like]])
            u0[k[like]] = -1
            left = np.ones(len(lo), bool)
            left[k[like]] = False
            todo = todo[left[todo]]
            m = np.nonzero(~like & (wide > 0) & (u0[k] < 0))[0]
            if len(m):
                mine = np.repeat(np.isin(np.arange(len(k)), m, assume_unique=True), size)
                v = cut_(t[at_a[mine]], size[m])
                new = (v[1] > v[0]) & (v[1] - v[0] < size[m])
                m, v = m[new], [x[new] for x in v]
                k = k[m]
                u0[k], u1[k], split0[k], split1[k] = x0[k] + v[0], x0[k] + v[1], x0[k], x1[k]
        split = u0 >= 0
        x0[split], x1[split] = split0[split], split1[split]
        some = x1 > x0
        waiting += [(pair[some], lo[some], x0[some]), (pair[some], x1[some], hi[some])]
        waiting += [(pair[split], p[split], q[split]) for p, q in ((x0, u0), (u0, u1), (u1, x1))]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def verified(docs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, a_from, a_to, b_from, b_to (words, ends excluded), similarity of the passages in candidate regions.

    Where rows share an id, each of their texts is tried.
    """
    keys = ["a", "b", "a_from", "b_from"]
    side = lambda d, k: found.select(F.col(d).alias("doc"), F.col(f"{d}_from").alias("from"), F.col(f"{d}_to").alias("to"), *keys, F.lit(k).alias("side"))
    both = cut_out(docs, side("b", 0).unionByName(side("a", 1)))
    names = ["a", "b", "a_from", "a_to", "b_from", "b_to", "similarity"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, others = None, set()
        regions_, pairs = [], []

        def tried() -> pa.RecordBatch:
            k, x0, x1, y0, y1, s = all_passages(pairs, width, percent)
            a, b, a0, b0 = np.array(regions_, np.int64)[k].T
            out = a, b, a0 + x0, a0 + x1 + SHINGLE - 1, b0 + y0, b0 + y1 + SHINGLE - 1, s
            regions_.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=names)

        held = 0
        for batch in batches:
            for *key, k, raw in zip(*(batch.column(c).to_pylist() for c in (*keys, "side", "shingles")), strict=True):
                if key != now:
                    now, others = key, set()
                if k == 0:
                    others.add(raw)
                    continue
                t = np.frombuffer(raw, np.uint32)
                for other in others:
                    regions_.append(key)
                    pairs.append((t, np.frombuffer(other, np.uint32)))
                    held += len(raw) + len(other)
                    if held > 8 << 20:  # bytes
                        yield tried()
                        held = 0
        if pairs:
            yield tried()

    rows = both.repartition(*keys).sortWithinPartitions(*keys, "side")
    return rows.mapInArrow(f, "a long, b long, a_from long, a_to long, b_from long, b_to long, similarity double")


def poorest(t: np.ndarray, size: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each row the least number of distinct values in `width` places that hold place `at`; 1 for rows shorter than that.

    t: a row of `size` values for each window, what follows them differs from all of them.
    """
    order = np.argsort(t, 1, kind="stable")
    rising = np.take_along_axis(t, order, 1)
    before = np.full(t.shape, -1)  # the place before with the same value
    np.put_along_axis(before, order[:, 1:], np.where(rising[:, 1:] == rising[:, :-1], order[:, :-1], -1), 1)
    out = np.where(size < width, 1, width)
    place = np.arange(t.shape[1])
    if len(place) < width:
        return out
    # A place counts in the runs that begin behind the place before with its value, up to itself.
    row = np.arange(len(t))[:, None] * (len(place) + 1)
    begins = np.bincount((row + np.maximum(before, place - width) + 1).ravel(), minlength=len(t) * (len(place) + 1)).reshape(len(t), -1)[:, :-1]
    many = np.cumsum(begins, 1) - place
    start = place[: len(place) - width + 1]
    holds = (start <= at[:, None]) & (at[:, None] < start + width) & (start + width <= size[:, None])
    return np.minimum(out, np.where(holds, many[:, : len(start)], width).min(1))


def may_hold(hit: np.ndarray, size: np.ndarray, at: np.ndarray, width: int, percent: int, miss: int | None = None) -> np.ndarray:
    """Whether a passage of `width` places or more around place `at` may be hit often enough; hit: a row for each window of `size` places.

    Hits count 100 - percent, others -miss (-percent by default, so that percent / 100 of the passage must be hit); a
    passage must come to 0, and to as many hits as two passages of `width` must share. The test looks at the widest
    stretch around `at` both ends of which could belong to one, so it lets all passages through.
    """
    step = np.arange(2 * width + 1)

    def going(from_: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        place = from_[:, None] + sign * step
        inside = (place >= 0) & (place < size[:, None])
        seen = np.take_along_axis(hit, np.clip(place, 0, hit.shape[1] - 1), 1) & inside
        return np.cumsum(np.where(seen, 100 - percent, np.where(inside, -(miss or percent), -(10**6))), 1), np.cumsum(seen, 1)

    (after, hits_after), (before, hits_before) = going(at, 1), going(at - 1, -1)
    before, hits_before = (np.hstack([np.zeros((len(at), 1), np.int64), x]) for x in (before, hits_before))
    ends = [len(step) - 1 + k - (x[:, ::-1] >= -y.max(1)[:, None]).argmax(1) for x, y, k in ((after, before, 0), (before, after, 1))]
    wide = (after.max(1) + before.max(1) >= 0) & (ends[0] + 1 + ends[1] >= width)
    row = np.arange(len(at))
    return wide & (hits_after[row, ends[0]] + hits_before[row, ends[1]] >= -(-2 * width * percent // (100 + percent)))


def alike(label: np.ndarray, at: np.ndarray, shingles: list[np.ndarray], width: int, percent: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of windows (label, place of c, shingles) of other labels that share as many shingles as a passage needs.

    Two passages of d and e distinct shingles share (d + e) * percent / (100 + percent), percent / 100 of either's and
    2 * percent / (100 + percent) of the smaller's. Where no shingle of a window is repeated, that also holds of places
    around c, see may_hold().
    """
    length = np.array([len(x) for x in shingles])
    inside = np.arange(length.max()) < length[:, None]
    filled = np.full(inside.shape, 1 << 32)
    filled[inside] = np.concatenate(shingles)
    rising = np.sort(filled, 1)
    first = np.hstack([np.ones((len(rising), 1), bool), rising[:, 1:] != rising[:, :-1]]) & (rising < 1 << 32)
    size = first.sum(1)
    known, column, often = np.unique(rising[first], return_inverse=True, return_counts=True)
    start = np.r_[0, np.cumsum(size)]
    padded = np.searchsorted(known, np.where(inside, filled, 0))
    padded[padded == len(known)] = 0
    _, group, sizes = np.unique(label, return_inverse=True, return_counts=True)
    # Rows that share less than any passage must with rows of all other labels together go first.
    of = np.repeat(group, size)
    low, high = np.full(len(known), len(sizes)), np.full(len(known), -1)
    np.minimum.at(low, column, of)
    np.maximum.at(high, column, of)
    shared = np.add.reduceat((low != high)[column], start[:-1])
    hopeful = shared >= np.where((size == length) & (length >= width), -(-width * percent // 100), 1)
    if len(np.unique(group[hopeful])) < 2:
        return
    if not hopeful.all():
        k = np.nonzero(hopeful)[0]
        for i, j in alike(label[k], at[k], [shingles[x] for x in k], width, percent, block):
            yield k[i], k[j]
        return
    poor = np.where(length < width, 1, width)
    repeats = np.nonzero(size < length)[0]
    for a, b in blocks(len(repeats), 4 * block):
        k = repeats[a:b]
        poor[k] = poorest(filled[k], length[k], at[k], width)

    def dense(i: np.ndarray, j: np.ndarray, miss: int) -> np.ndarray:
        """Whether windows i may hold a passage whose shingles are those of windows j."""
        out = size[i] < length[i]
        todo = np.nonzero(~out)[0]
        todo = todo[np.argsort(j[todo], kind="stable")]
        for a, b in blocks(len(todo), min(512, (1 << 22) // (len(used) + 1) + 1)):
            part = todo[a:b]
            others, other = np.unique(j[part], return_inverse=True)
            held = np.zeros((len(others), len(used) + 1), bool)  # what both hold has a number in this block
            held[np.repeat(np.arange(len(others)), size[others]), number[column[ranges(start[others], size[others])]]] = True
            held[:, -1] = False
            k = i[part]
            out[part] = may_hold(held[other[:, None], number[padded[k]]], length[k], at[k], width, percent, miss)
        return out

    number = np.full(len(often), -1)

    def matrix(some: np.ndarray, width_: int) -> np.ndarray:
        out = np.zeros((len(some), width_), np.float32)
        for k, r in enumerate(some):
            at = number[column[start[r] : start[r + 1]]]
            out[k, at[at >= 0]] = 1
        return out

    few = np.nonzero(group != sizes.argmax())[0]  # one end at least of each pair is outside of the largest class
    for a, b in blocks(len(few), block):
        used = np.unique(np.concatenate([column[start[r] : start[r + 1]] for r in few[a:b]]))
        used = used[often[used] > 1]  # a block's columns bound the memory
        number[used] = np.arange(len(used))
        x = matrix(few[a:b], len(used))
        for c, d in blocks(len(label), block):
            here = np.arange(c, d)
            m, n = poor[few[a:b], None], poor[None, here]
            least = np.maximum(-(-(m + n) * percent // (100 + percent)), -(-np.maximum(m, n) * percent // 100))
            fine = (x @ matrix(here, len(used)).T >= least) & (group[few[a:b], None] != group[None, here])
            fine &= (group[here] == sizes.argmax())[None, :] | (few[a:b, None] < here[None, :])
            i, j = np.nonzero(fine)
            i, j = few[a:b][i], here[j]
            for u in (0, 1):
                if len(i):
                    may = dense(*((i, j) if u else (j, i)), percent)
                    i, j = i[may], j[may]
            if len(i):
                may = dense(i, j, 2 * percent)
                rest = np.nonzero(~may)[0]
                if len(rest):
                    may[rest] = dense(j[rest], i[rest], 2 * percent)
                i, j = i[may], j[may]
            if len(i):
                yield i, j
        number[used] = -1


def representatives(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """side, label, body, and the first (doc, c, ext) of the windows that are alike in all three.

    label is the class of the window's document, or the document itself: a document need not meet others of its class.
    side names a key together with the sketch of one side of its token; only sides stay that are held under several
    labels. (A frequent line shorter than half a passage leaves the sketches to what surrounds it.)
    """
    rows = shared.where("not tried").drop("tried").join(classes.select(F.col("node").alias("doc"), F.col("component").alias("label")), "doc", "left")
    sketch = lambda k: F.shiftright("ext", 4 + k * SKETCH).bitwiseAND(F.lit((1 << SKETCH) - 1))
    sides = F.array(*(F.struct(F.lit(k).alias("k"), sketch(k).alias("sketch")) for k in (0, 1)))
    rows = rows.withColumn("label", F.coalesce("label", "doc")).withColumn("x", F.explode(sides)).where("x.sketch > 0")
    rows = cut(rows.select(F.xxhash64("key", "x").alias("side"), "label", "body", "doc", "c", "ext"), "sides")
    mixed = rows.groupBy("side").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("side")
    place = F.struct("doc", "c", "ext")
    return rows.join(mixed, "side", "left_semi").groupBy("side", "label", "body").agg(F.min(place).alias("first"))


def across(docs: DataFrame, shared: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows like window_pairs() of all windows of a key in documents of different classes that may share a passage.

    Windows of one class with the same tokens are compared as one. Those of a key and side stream into one task; only
    pairs that share enough shingles near c leave it. Up to 2 * width shingles on either side count, which hold any
    passage of that length around c; a longer one is found by its parts.
    """
    reps = cut(representatives(shared, classes), "representatives")
    c = F.col("first.c")
    before, after = (F.least(F.shiftright("first.ext", k).bitwiseAND(F.lit(REACH)), F.lit(2 * width)).cast("int") for k in (44, 24))
    wanted = reps.select(F.col("first.doc").alias("doc"), (c - before).alias("from"), (c + after).alias("to"), before.alias("at"), "side", "label", *(F.col(f"first.{x}").alias(f"first_{x}") for x in ("doc", "c", "ext")))
    windows = cut_out(docs, wanted).where(F.length("shingles") > 4 * F.col("at"))  # c lies in the text
    numbers = ["label", "at", "first_doc", "first_c", "first_ext"]
    names = ["a", "b", "a_from", "a_to", "b_from", "hashes"]
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32]

    def pairs_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        label, at, *places = (np.array(v, np.int64) for v in zip(*(r[:-1] for r in rows), strict=True))
        for x, y in alike(label, at, [np.frombuffer(r[-1], np.uint32) for r in rows], width, percent):
            swap = places[0][x] < places[0][y]
            (a, ca, ea), (b, cb, eb) = ([np.where(swap, m[v], m[u]) for m in places] for u, v in ((x, y), (y, x)))
            if len(a):
                (back_a, on_a, j), (back_b, on_b, _) = unpack(ea), unpack(eb)
                back, on = np.minimum(back_a, back_b), np.minimum(on_a, on_b)
                out = a, b, ca - back, ca + on, cb - back, 1 << j
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(k)) for v, k in zip(out, kinds, strict=True)], names=names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for side, *row in zip(*(batch.column(k).to_pylist() for k in ("side", *numbers, "shingles")), strict=True):
                if side != now:
                    yield from pairs_of(rows) if len(rows) > 1 else ()
                    now, rows = side, []
                rows.append(row)
        yield from pairs_of(rows) if len(rows) > 1 else ()

    return windows.repartition("side").sortWithinPartitions("side").mapInArrow(f, "a long, b long, a_from int, a_to int, b_from int, hashes int").distinct()


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, component) with further links (a, b) between nodes, some of which may be new."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(cut(ends.distinct(), "ends"))
    merged = cut(merged, "merged")
    old = classes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return old.unionByName(merged.join(classes.select("node"), "node", "left_anti"))


def near_passages(docs: DataFrame, min_words: int = 50, percent: int = 75, hashes: int = 7, agree: int = 2) -> DataFrame:
    """doc_id, start_word, end_word, other_id, other_start, other_end (ends excluded), similarity, class_id.

    A passage is linked with the first document (by id) that shares one of its signatures and with the preceding one,
    and with all documents of other classes after that; class_id is the least doc_id of all that such links join.
    """
    width = min_words - SHINGLE + 1
    shared = cut(shared_windows(window_rows(docs, hashes, min_words)), "shared")

    def checked(pairs: DataFrame, agree: int) -> DataFrame:
        found = regions(pairs, 2 * width, agree)
        # Less than a window's width of a passage may stand beyond the last edit that a window reaches.
        found = cut(found.select("a", "b", *(F.greatest(F.lit(0), F.col(c) - width).alias(c) if c.endswith("from") else (F.col(c) + width).alias(c) for c in ("a_from", "a_to", "b_from", "b_to"))), "regions")
        return cut(verified(docs, found, width, percent).distinct(), "passages")

    out = checked(window_pairs(shared), agree)
    classes = cut(components(out.select("a", "b").distinct()), "classes")
    more = checked(across(docs, shared, classes, width, percent), 1)
    classes = cut(joined(classes, more.select("a", "b").distinct()), "classes")
    out = out.unionByName(more).distinct()
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.join(classes.withColumnRenamed("node", "a"), "a").select(
        real("a").alias("doc_id"), F.col("a_from").alias("start_word"), F.col("a_to").alias("end_word"), real("b").alias("other_id"), F.col("b_from").alias("other_start"), F.col("b_to").alias("other_end"), "similarity", real("component").alias("class_id")
    )
