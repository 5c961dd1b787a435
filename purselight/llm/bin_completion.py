"""Best-fit packing of tokenised documents into sequences, planned by bin completion with branch and bound.

Only the histogram of piece lengths reaches the driver: at most `capacity` counts, whatever the corpus size. The
plan is a list of bin patterns with multiplicities. Pieces are then numbered within their length (salted, so that a
frequent length is spread over tasks), and number and length decide sequence and offset.

Defined results: null and empty text give one piece that holds the end id alone; a null id is an id; texts of any
length are tokenised whole and cut into pieces; repeated rows are packed each, and which of them stands where in a tie
of all columns makes no difference to the rows returned; an empty table gives no rows; columns other than the id and
the text are not read, whatever their names. The result does not depend on partitioning.
"""

from __future__ import annotations

import bisect
import itertools
import json
import logging
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.llm.common import blocks, cut, map_batches

Pattern = tuple[int, tuple[tuple[int, int], ...]]  #: (number of bins, ((length, pieces of it in each bin), ...))
Filling = tuple[int, tuple[tuple[int, int], ...]]  #: (waste, contents likewise)
_LOG = logging.getLogger(__name__)
_ENCODERS: dict[str, object] = {}


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file of the `tokenizers` library, without special tokens being added.

    Where the file is plain byte-level BPE whose merges stand in the order of their ids, the same vocabulary and
    splitting rule run in tiktoken, which is several times faster and gives the same ids (tests compare them).
    Texts that contain one of the file's added tokens, texts that tiktoken fails on (very long runs of white space or
    of one kind of character), and other files go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        import public_tokenizers
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        added = {x["content"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [vocab.get(m, -1) for m in merges]
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")
        if not plain or ids != sorted(ids) or -1 in ids:
            return None
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        """The tokenizer itself; loaded only where a text needs it, as it takes much memory in each worker."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # a panic of its regular expressions, as on a million spaces, is no Exception
            return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> ByteBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids: all of `capacity`, but for a shorter first one."""
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def f(batch: pa.RecordBatch):
        enc, docs, texts = encoder(tokenizer), batch.column(0).to_pylist(), batch.column(1)
        for a, b in blocks(batch.num_rows, 500):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            for k, text in zip(docs[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                ids = np.array([*enc.ids(text or ""), end_id], "<u4")
                for i, (s, n) in enumerate(cut_points(len(ids), capacity)):
                    part = ids[s : s + n]
                    row = [k, i, s, n, zlib.crc32(part.tobytes())] + ([part.tolist()] if with_ids else [])
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=False)], names=list(out))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), f, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram of lengths: groups of alike bins take pieces together."""
    open_: dict[int, list[list]] = {}  # free space -> [[number of bins, contents]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r in open_ if r >= length), default=None)
            if free is None:
                free, group = capacity, [left, ()]  # as many as may be needed; unused ones are not opened
            else:
                group = open_[free][-1]
            each = free // length
            full = min(group[0], left // each)
            n, per = (full, each) if full else (1, left)
            if free in open_ and group is open_[free][-1]:
                group[0] -= n
                if not group[0]:
                    open_[free].pop()
                    if not open_[free]:
                        del open_[free]
            open_.setdefault(free - n_used(length, per), []).append([n, (*group[1], (length, per))])
            left -= n * per
    return [(n, items) for groups in open_.values() for n, items in groups]


def n_used(length: int, per: int) -> int:
    return length * per


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the larger of the volume bound and the bound by pieces over half a bin.

    Pieces over half a bin take a bin each; for each least length a, the pieces from a to half a bin go into what those
    leave that have room for a, and into further bins.
    """
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in lengths.tolist()], np.int64)
    big = 2 * lengths > capacity
    volume = np.cumsum((lengths * n)[~big][::-1])[::-1]
    space = np.r_[0, np.cumsum(((capacity - lengths) * n)[big])]
    left = space[np.searchsorted(lengths[big], capacity - lengths[~big], "right")]
    more = int((-(-(volume - left) // capacity)).max(initial=0))
    return max(-(-int((lengths * n).sum()) // capacity), int(n[big].sum()) + more)


def fillings(counts: dict[int, int], lengths: Sequence[int], space: int, steps: int) -> tuple[list[Filling], int]:
    """The undominated fillings of `space` that `steps` steps reach, least waste first, and the steps that took.

    lengths: those of counts, longest first. Depth first from the longest piece that fits, so that the first filling is
    that of best fit; fewer steps than were allowed mean that all were found. A filling is dropped if a further piece
    would fit, or if one of its pieces could give way to a longer one: whatever packing uses it, one that uses the other
    is as good.
    """
    found: list[Filling] = []
    rising = lengths[::-1]
    taken = 0

    def free_piece(low: int, high: int, used: dict[int, int]) -> bool:
        """Whether a piece of more than low and at most high is left."""
        return any(counts[k] > used.get(k, 0) for k in rising[bisect.bisect_right(rising, low) : bisect.bisect_right(rising, high)])

    def go(i: int, free: int, chosen: tuple[tuple[int, int], ...]) -> None:
        nonlocal taken
        taken += 1
        used = dict(chosen)
        if not free_piece(0, free, used):
            if not free or not any(free_piece(k, k + free, used) for k in used):
                found.append((free, chosen))
            return
        for j in range(max(i, len(rising) - bisect.bisect_right(rising, free)), len(lengths)):
            k = lengths[j]
            for per in range(min(counts[k], free // k), 0, -1):
                if taken >= steps:
                    return
                go(j + 1, free - per * k, (*chosen, (k, per)))

    go(0, space, ())
    return sorted(found, key=lambda x: (x[0], [-k for k, per in x[1] for _ in range(per)])), taken


@dataclass(frozen=True)
class Node:
    """A partial packing: how many pieces of each length are left, bins used, their waste, and the pattern placed last on a parent's."""

    left: np.ndarray
    used: int = 0
    waste: int = 0
    parent: Node | None = None
    pattern: Pattern | None = None

    def patterns(self) -> list[Pattern]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.pattern)
            at = at.parent
        return out[::-1]


def plan(counts: dict[int, int], capacity: int, steps: int = 2000, effort: int = 1_000_000) -> list[Pattern]:
    """Bin patterns for a histogram of lengths.

    The incumbent is best-fit decreasing. If it needs more bins than the lower bound, a depth-first search fills the bin
    of the largest remaining piece: with each undominated filling, least waste first, as often as the counts allow, then
    half as often, down to once. It gives up a branch when its waste exceeds what a packing with one bin less than the
    incumbent could waste, when the bound of the pieces left shows that it cannot use less bins, or when the same
    pieces were left before by as few bins. `steps` bounds the enumeration of one bin's fillings and `effort` that of
    all; where one of them ends the search before the bound is reached, that is logged. They bound the search, not the
    input: the incumbent always holds every piece.
    """
    counts = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a length lies outside 1..capacity")
    best = best_fit(counts, capacity)
    bins, least, total = sum(n for n, _ in best), lower_bound(counts, capacity), sum(k * n for k, n in counts.items())
    spent, complete = 0, True
    kinds = sorted(counts)
    place = {k: i for i, k in enumerate(kinds)}
    seen: dict[bytes, int] = {}

    def remaining(node: Node) -> dict[int, int]:
        return {kinds[i]: int(node.left[i]) for i in np.nonzero(node.left)[0]}

    def hopeless(node: Node) -> bool:
        return node.waste > (bins - 1) * capacity - total or node.used + lower_bound(remaining(node), capacity) >= bins

    def children(node: Node) -> Iterator[Node]:
        nonlocal spent, complete
        counts = remaining(node)
        top = max(counts)
        rest = counts | {top: counts[top] - 1}
        lengths = sorted((k for k, n in rest.items() if n and k <= capacity - top), reverse=True)
        found, taken = fillings(rest, lengths, capacity - top, steps)
        spent, complete = spent + taken, complete and taken < steps
        for slack, items in found:
            if node.waste + slack > (bins - 1) * capacity - total:
                return  # as all that follow waste as much or more
            content = dict(items)
            content[top] = content.get(top, 0) + 1
            times = min(counts[k] // per for k, per in content.items())
            pattern = tuple(sorted(content.items(), reverse=True))
            while times:
                left = node.left.copy()
                for k, per in pattern:
                    left[place[k]] -= times * per
                spent += 1 + len(kinds) // 16  # what a child costs, in steps
                yield Node(left, node.used + times, node.waste + times * slack, node, (times, pattern))
                times //= 2

    # The path from the root as (node, children tried); only the last one's fillings are held, others are made anew.
    path = [[Node(np.array([counts[k] for k in kinds], np.int64)), 0]] if counts else []
    branch = children(path[-1][0]) if path else None
    while path and bins > least and spent < effort:
        node = next(branch, None)
        if node is None:
            path.pop()
            branch = itertools.islice(children(path[-1][0]), path[-1][1], None) if path else None
            continue
        path[-1][1] += 1
        if not node.left.any():
            if node.used < bins:
                best, bins = node.patterns(), node.used
        elif not hopeless(node):
            key = xxhash.xxh3_128_digest(node.left.tobytes())
            if node.used < seen.get(key, bins):
                seen[key] = node.used
                path.append([node, 0])
                branch = children(node)
    if bins > least and not (complete and not path):
        _LOG.warning("packing search ended by its effort: %d sequences, lower bound %d", bins, least)
    return best


def intervals(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, sequence of it, pieces in each bin, offset of the first) by first number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for n, items in patterns:
        offset = 0
        for length, per in items:
            out.setdefault(length, []).append((taken.get(length, 0), sequence, per, offset))
            taken[length] = taken.get(length, 0) + n * per
            offset += length * per
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def numbered(pieces: DataFrame, most: int, per_task: int = 200_000) -> DataFrame:
    """pieces with column number: 0, 1, ... within each length. Salts spread the most frequent length (`most` rows)."""
    salts = max(8, -(-most // per_task))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    key = Window.partitionBy("length", "salt")
    ranked = salted.withColumn("k", F.row_number().over(key.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return ranked.join(shift.drop("count"), ["length", "salt"]).withColumn("number", F.col("k") + F.col("shift")).drop("salt", "k", "shift")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset. `pieces` is read twice, so it should be a written table."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    where = intervals(plan(counts, capacity))
    names = [c for c in pieces.columns if c not in ("number", "sequence_id", "offset")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            at = np.nonzero(length == k)[0]
            first, seq, per, off = where[int(k)][np.searchsorted(where[int(k)][:, 0], number[at], "right") - 1].T
            sequence[at], offset[at] = seq + (number[at] - first) // per, off + (number[at] - first) % per * k
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_batches(numbered(pieces, max(counts.values(), default=0)), f, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    return pack_pieces(cut(pieces(df, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences from pack(..., with_ids=True): sequence_id, ids. A sequence holds at most `capacity` ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
