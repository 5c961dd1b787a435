"""Benchmark decontamination: rare n-gram seeds join passages to test items; Smith-Waterman alignment scores them.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Matches count 2, mismatches and gaps
-1; the score is the best local alignment's over that of the item with itself, and documents with a score of `least` or
more are contaminated. Seeds find every such pair, however the copy is edited: an alignment without a shared run of r
words has a break after every r - 1 matches at the latest, so 2 * m - floor((m - 1) / (r - 1)) bounds its score for an
item of m words. From the largest r for which that is below `least`, each item gets its n-grams, of n words at most, and
of every `window` (or fewer) consecutive ones the one that the fewest documents hold is a seed, so that every shared run
of r words holds a seed. (At 0.6 all 2-grams are seeds, and all words of items up to five words.) Only items of which
some n-grams are left out need a first pass over the documents, which counts them.

A second pass looks the seeds up in each document. The most that edits can cost also bounds from below how many n-grams
of the item are left, and from above the words of the document that they stand in; where they stand that close, the
stretch around them is aligned with the item word by word. Stretches that share too few words with the item to reach
`least` are skipped, which changes no result.

The items are the query set: they are taken in blocks of at most `block_bytes` of text, each block is sent to the tasks,
and every block meets all documents. Documents never move.

Defined results: null and empty texts and items match nothing; an item of one word is in all documents that hold it;
repeated items with one id count as one (the best score); repeated documents give rows each; ties go to the
first stretch; texts of any length are searched whole, one at a time; an empty table gives no rows; other columns,
whatever their names, are not read, and pass through filter_documents().
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.llm.common import HashSet, binaries, grams, map_batches, signed, word_hashes
from purselight.llm.license_fuzzy import normalise

MATCH, MISMATCH, GAP = 2, -1, 1


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray  #: hashes of its words
    n: int  #: words in its n-grams
    window: int  #: consecutive n-grams that hold a seed
    need: int  #: n-grams that an alignment keeps at least
    reach: int  #: words of a document that an alignment spans at most

    @property
    def grams(self) -> np.ndarray:
        return grams(self.words, self.n)

    @classmethod
    def of(cls, item_id: int | None, words: np.ndarray, n: int, window: int, least: float) -> Item:
        m = len(words)
        r = shared_run(m, least)
        n = min(n, r)
        window = min(window, r - n + 1)
        lost = int(MATCH * m * (1 - least) + 1e-9)  # what edits may cost; a gap breaks n - 1 n-grams for 1, nothing breaks more for its cost
        kept = m - n + 1 - lost * (n - 1) if n > 1 else m - lost // MATCH
        return cls(item_id, words, n, window, max(1, kept) if window == 1 else 1, m + lost)


def shared_run(m: int, least: float) -> int:
    """The longest run of words that every alignment of `least` or more shares with an item of m words."""
    r = 1
    while r < m and MATCH * m - GAP * ((m - 1) // r) < least * MATCH * m - 1e-9:
        r += 1
    return r


def make_items(rows: list[tuple], n: int, window: int, least: float) -> list[Item]:
    hashes = [(i, word_hashes(normalise((t or "").encode()))) for i, t in rows]
    return [Item.of(i, h, n, window, least) for i, h in hashes if len(h)]


def item_blocks(items: DataFrame, block_bytes: int, n: int, window: int, least: float) -> Iterator[list[Item]]:
    """Items in blocks of bounded size, streamed to the driver."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        size = len((row.text or "").encode())
        if block and held + size > block_bytes:
            yield make_items(block, n, window, least)
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += size
    if block:
        yield make_items(block, n, window, least)


def document_frequency(docs: DataFrame, items: list[Item]) -> dict[int, int]:
    """How many documents hold each n-gram of the items (hash, as unsigned)."""
    sizes = sorted({x.n for x in items})
    if not items:
        return {}
    wanted = {k: HashSet(np.concatenate([x.grams for x in items if x.n == k])) for k in sizes}

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for text in binaries(batch, "text"):
            h = word_hashes(normalise(text))
            for k in sizes:
                g = grams(h, k)
                total.update(np.unique(g[wanted[k].places(g)]).tolist())
        return pa.RecordBatch.from_pydict({"gram": pa.array(signed(np.array(list(total), np.uint64))), "n": pa.array(list(total.values()), pa.int64())})

    rows = map_batches(docs.select(F.col("text").cast("binary").alias("text")), f, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram & 0xFFFFFFFFFFFFFFFF: r.n for r in rows.collect()}  # at most the n-grams of a block of items


def seed_positions(frequency: list[int], window: int) -> list[int]:
    """Of every `window` consecutive n-grams the rarest; the first of equals."""
    m = len(frequency)
    if m <= window:
        return [min(range(m), key=lambda i: (frequency[i], i))] if m else []
    return sorted({min(range(a, a + window), key=lambda i: (frequency[i], i)) for a in range(m - window + 1)})


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """(best local score, end in doc) of words against words; the first end of equals."""
    best, end = 0, 0
    slope = GAP * np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    for w in item:
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(doc == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope
        k = int(row.argmax())
        if row[k] > best or row[k] == best and k < end:
            best, end = int(row[k]), k
    return best, end


@dataclass
class Index:
    """Seeds of a block of items, sorted by hash, for lookup in documents."""

    items: list[Item]
    sizes: list[int]
    seeds: dict[int, tuple[HashSet, np.ndarray, np.ndarray]]  #: n -> (set, sorted hashes, their items)
    least: float

    @classmethod
    def of(cls, items: list[Item], frequency: dict[int, int], least: float) -> Index:
        found: dict[int, set[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            g = item.grams.tolist()
            for p in seed_positions([frequency.get(x, 0) for x in g], item.window):
                found.setdefault(item.n, set()).add((g[p], i))
        seeds = {}
        for k, rows in found.items():
            keys, owners = zip(*sorted(rows), strict=True)
            keys = np.array(keys, np.uint64)
            seeds[k] = HashSet(keys), keys, np.array(owners, np.int64)
        return cls(items, sorted(seeds), seeds, least)

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, sorted places of its seeds in the document) of the items that have as many places as they need."""
        for k in self.sizes:
            known, keys, owners = self.seeds[k]
            g = grams(h, k)
            places = known.places(g)
            if not len(places):
                continue
            first = np.searchsorted(keys, g[places], "left")
            count = np.searchsorted(keys, g[places], "right") - first
            at = np.repeat(places, count)
            owner = owners[np.arange(len(at)) + np.repeat(first - np.cumsum(count) + count, count)]
            total = np.bincount(owner, minlength=len(self.items))
            fine = np.nonzero((total > 0) & (total >= self.need))[0]
            for i in fine.tolist():
                yield i, at[owner == i]

    @functools.cached_property
    def need(self) -> np.ndarray:
        return np.array([x.need for x in self.items])

    def score(self, text: bytes) -> list[tuple]:
        """(item_id, score, start word, end word) of the items that the text holds."""
        h = word_hashes(normalise(text))
        best: dict = {}
        for i, places in self.hits(h):
            item = self.items[i]
            m = len(item.words)
            first, last = places[: len(places) - item.need + 1], places[item.need - 1 :]
            close = last + item.n - first <= item.reach
            stretches: list[list[int]] = []
            for a, b in zip((last[close] + item.n - item.reach).tolist(), (first[close] + item.reach).tolist(), strict=True):
                a, b = max(0, a), min(len(h), b)
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                part = h[a:b]
                if np.isin(item.words, part).sum() < self.least * m - 1e-9:
                    continue
                got, end = align(item.words, part)
                if got < self.least * MATCH * m - 1e-9:
                    continue
                back, length = align(item.words[::-1], part[:end][::-1])
                row = (got / (MATCH * m), a + end - (length if back == got else end), a + end)
                if item.item_id not in best or row[0] > best[item.item_id][0]:
                    best[item.item_id] = row
        return [(k, *v) for k, v in best.items()]


def indexes(docs: DataFrame, items: DataFrame, n: int, window: int, least: float, block_bytes: int) -> Iterator[Index]:
    for block in item_blocks(items, block_bytes, n, window, least):
        if block:
            yield Index.of(block, document_frequency(docs, [x for x in block if x.window > 1]), least)


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, window: int = 3, least: float = 0.6, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word (end excluded) of every pair with a score of `least` or more."""
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(docs, items, n, window, least, block_bytes):

        def f(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            rows = [(k, *hit) for k, text in zip(batch.column("doc_id").to_pylist(), binaries(batch, "text"), strict=True) for hit in index.score(text)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.unionByName(map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), f, schema))
    return out


def filter_documents(docs: DataFrame, items: DataFrame, n: int = 3, window: int = 3, least: float = 0.6, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    out = docs
    for index in indexes(docs, items, n, window, least, block_bytes):

        def f(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            return batch.filter(pa.array([not index.score(t) for t in binaries(batch, "text")]))

        out = map_batches(out, f, docs.schema)
    return out
