"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on full shingle sets.

A document's set holds its distinct five-word shingles. Documents with equal sets form one class, and only classes are
compared. A class has a signature of `chunks` x `slots` min-hashes of 16 bits; the distance of two signatures is the
number of slots that differ. By the pigeonhole principle two signatures that differ in at most 2 * chunks - 1 slots
have a chunk with at most one differing slot. Each chunk gives `slots` keys, each leaving one slot out, so any such
pair shares a key: with 12 chunks of 4 all pairs within 23 of 48 slots become candidates. (At a similarity of 0.75 the
distance has mean 12 and deviation 3. Pairs beyond 23 slots count as well if they share a key, up to 30 slots: a pair at
exactly 0.75 shares no key with probability 0.262^12, about 1e-7, and differs in more than 30 with probability 1e-8.)

A key's classes are not paired with each other but with the key's class of least doc_id. Links between classes that
these stars have not yet connected follow in a last step: keys whose classes still lie in several components compare
signatures across components, in blocks. Of pairs within the distance, those go on whose sets may be similar: counts of
shingles by hash bucket bound the intersection from above, so no similar pair is lost there. A pair is passed on by the
first key that it shares only. Every candidate link is confirmed on the full sets of both documents, held one pair at a
time. Components are found by large-star and small-star steps.

Defined results: null text or text without words has an empty set and is linked with nothing; fewer words than five are
one shingle; texts of any length are taken whole, one at a time; of equally near partners the one of larger key is tried
first, which does not change the components; rows with equal sets are linked, repeated rows with one doc_id are all returned; a null doc_id belongs to
its class, but is a component's least id only if all are null, and then is kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purselight.llm.common import binaries, blocks, components, cut, map_batches, mix, shingle_set, signed
from purselight.llm.url_bloom import maybe

CHUNKS, SLOTS, SHINGLE = 12, 4, 5
BUCKETS = 512  #: of the counts that bound an intersection
SALTS = 16


def slot_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n], base[n:] | np.uint64(1)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n min-hashes of 16 bits of a set of 64-bit hashes (not empty)."""
    add, times = slot_seeds(n)
    least = np.array([((shingles + a) * t).min() for a, t in zip(add, times, strict=True)])
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Shingles by hash bucket, as bytes; 255 stands for any larger count."""
    return np.minimum(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of sets of na and nb shingles from rows of counts."""
    full = (a == 255) & (b == 255)
    bound = np.minimum(a, b).sum(1, dtype=np.int64)
    return np.where(full.any(1), np.minimum(na, nb), np.minimum(bound, np.minimum(na, nb)))


def class_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def keys(signatures: np.ndarray, chunks: int, slots: int) -> np.ndarray:
    """All keys of signatures (a row each): chunks * slots columns of 64 bits."""
    s = signatures.reshape(len(signatures), chunks, slots).astype(np.uint64)
    out = np.zeros((len(s), chunks, slots), np.uint64)
    for c in range(chunks):
        for left_out in range(slots):
            h = np.full(len(s), np.uint64(c * slots + left_out + 1))
            for k in range(slots):
                if k != left_out:
                    h = mix(h * np.uint64(0x10001) + s[:, c, k])
            out[:, c, left_out] = h
    return out.reshape(len(s), chunks * slots)


def fingerprints(docs: DataFrame, chunks: int = CHUNKS, slots: int = SLOTS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, equal (16 bytes that equal sets share; null for an empty set), signature (bytes; null likewise)."""

    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 1000):
            part, n, cls, sig = batch.slice(a, b - a), [], [], []
            for text in binaries(part, "text"):
                s = shingle_set(text.lower().split(), shingle)
                n.append(len(s))
                cls.append(class_key(s) if len(s) else None)
                sig.append(signature(s, chunks * slots).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "equal", "signature"])

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), f, "doc_id long, n_shingles long, equal binary, signature binary")


def key_rows(classes: DataFrame, chunks: int, slots: int) -> DataFrame:
    """Rows (key, class)."""

    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 2000):
            part = batch.slice(a, b - a)
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
            k = keys(sig, chunks, slots)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k.ravel())), part.column("class").take(pa.array(np.repeat(np.arange(part.num_rows), k.shape[1])))], names=["key", "class"])

    return map_batches(classes.select("class", "signature"), f, "key long, class binary")


def distance_bound(percent: int, n: int) -> int:
    """Slots of n in which similar sets may differ: six deviations beyond the mean, which a pair exceeds with probability 1e-8."""
    miss = 1 - percent / 100
    return min(n, int(n * miss + 6 * (n * miss * (1 - miss)) ** 0.5))


def within(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b, ...) whose signatures differ in at most `most` slots."""
    sig, columns = classes.select("class", "signature"), pairs.columns
    rows = pairs.join(sig.select(F.col("class").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("class").alias("b"), F.col("signature").alias("sb")), "b")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        return batch.filter(pa.array((sa != sb).sum(1) <= most)).select(columns)

    return map_batches(rows.select(*columns, "sa", "sb"), f, pairs.schema)


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, counts: bool = False) -> DataFrame:
    """class, shingles (sorted 64-bit hashes; with counts: their histogram) of the wanted rows (class, equal, doc_id).

    Documents that a Bloom filter rules out are dropped where they are read; their texts do not move.
    """
    ids = wanted.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("url")).distinct()
    near = maybe(docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "id", ids)

    def f(batch: pa.RecordBatch):
        for a, b in blocks(batch.num_rows, 1000):
            sets = [shingle_set(t.lower().split(), shingle) for t in binaries(batch.slice(a, b - a), "text")]
            out = [(histogram(s) if counts else s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()), pa.array(out, pa.binary())], names=["equal", "shingles"])

    sets = map_batches(near.where("maybe").select("text"), f, "equal binary, shingles binary")
    return sets.join(wanted.select("equal", "class").distinct(), "equal").dropDuplicates(["class"]).select("class", "shingles")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.

    b's set is sent once for each group of up to 1,000 partners, not once for each pair; groups of a frequent b go to
    different tasks. A task holds b's set and one partner's.
    """
    s = sets.select("class", "shingles")
    groups = pairs.groupBy("b").count().select("b", F.explode(F.sequence(F.lit(0), F.floor(F.col("count") / 1000).cast("int"))).alias("part"), F.floor(F.col("count") / 1000).cast("int").alias("parts"))
    heads = groups.join(s.withColumnRenamed("class", "b"), "b").select("b", "part", F.lit(None).cast("binary").alias("a"), "shingles")
    sizes = groups.where("part = 0").select("b", "parts")
    rows = pairs.join(sizes, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts") + 1).cast("int"))
    rows = rows.join(s.withColumnRenamed("class", "a"), "a").select("b", "part", "a", "shingles")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for a, b, part, raw in zip(*(batch.column(c) for c in ("a", "b", "part", "shingles")), strict=True):
                x = np.frombuffer(raw.as_py(), np.uint64)
                if not a.is_valid:
                    now, head = (b.as_py(), part.as_py()), x
                elif (b.as_py(), part.as_py()) == now and similar(x, head, percent):
                    out.append((a.as_py(), b.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return heads.unionByName(rows).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).mapInArrow(f, "a binary, b binary")


def across(members: DataFrame, most: int, percent: int, chunks: int, slots: int, block: int = 512) -> DataFrame:
    """Pairs (a, b) of one key in different components, near in signature, whose sets may be similar.

    members: key, class, component, signature, n (shingles), counts. Rows of a key stream through a task sorted by
    component; blocks of rows are compared, and a pair is passed on by the first key that both its rows have.
    """

    def pairs_of(key: int, rows: list[list]) -> Iterator[list[tuple[bytes, bytes]]]:
        cls, n = [r[0] for r in rows], np.array([r[3] for r in rows], np.int64)
        numbers: dict[bytes, int] = {}
        group = np.array([numbers.setdefault(r[1], len(numbers)) for r in rows])
        sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1)
        counts = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        slot = int(np.nonzero(signed(keys(sig[:1], chunks, slots)[0]) == key)[0][0])
        for a, b in blocks(len(rows), block):
            for c, d in blocks(len(rows), block):
                if c < a or group[a] == group[d - 1]:  # sorted by component: equal ends mean a single one
                    continue
                differ = sig[a:b, None, :] != sig[None, c:d, :]
                i, j = np.nonzero((differ.sum(2) <= most) & (group[a:b, None] < group[None, c:d]))
                # The first key that two rows share: of the first chunk with one different slot at most, that slot left out.
                by_chunk = differ[i, j].reshape(-1, chunks, slots)
                chunk = (by_chunk.sum(2) <= 1).argmax(1)
                i, j = (x[chunk * slots + by_chunk[np.arange(len(i)), chunk].argmax(1) == slot] for x in (i, j))
                i, j = i + a, j + c
                shared = most_shared(counts[i], counts[j], n[i], n[j])
                fine = 100 * shared >= percent * (n[i] + n[j] - shared)
                yield [(cls[x], cls[y]) for x, y in zip(i[fine], j[fine], strict=True)]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            for out in pairs_of(now, rows) if len(rows) > 1 else ():
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in out], pa.binary()), pa.array([min(x) for x in out], pa.binary())], names=["a", "b"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "class", "component", "signature", "n", "counts")), strict=True):
                if key != now:
                    yield from flush()
                    now, rows = key, []
                rows.append(row)
        yield from flush()

    return members.repartition("key").sortWithinPartitions("key", "component").mapInArrow(f, "a binary, b binary").distinct()


def linked(docs: DataFrame, classes: DataFrame, percent: int, chunks: int, slots: int, shingle: int) -> DataFrame:
    """Components of classes: node, component (both class keys), for classes with a link."""
    most = distance_bound(percent, chunks * slots)
    rows = key_rows(classes, chunks, slots)
    often = rows.groupBy("key").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(rows.join(often, "key"), "members")
    stars = members.where("class <> least").groupBy(F.col("class").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("weight"))
    stars = cut(within(stars, classes, most), "stars")
    # First each class against the star that shares most of its keys, then the stars that this has not joined.
    first = stars.groupBy("a").agg(F.max_by("b", F.struct("weight", "b")).alias("b"))
    links = cut(confirmed(first, sets_of(docs, classes, first, shingle), percent), "links")
    parts = cut(components(links), "parts")
    open_ = cut(unjoined(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), parts), "open")
    links = cut(links.unionByName(confirmed(open_, sets_of(docs, classes, open_, shingle), percent)), "links")
    parts = cut(components(links), "parts")
    labelled = members.join(parts.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = cut(labelled.join(mixed, "key", "left_semi"), "mixed")
    counts = full_sets(docs, classes.join(rest.select("class").distinct(), "class", "left_semi").select("class", "equal", "doc_id"), shingle, counts=True)
    rest = rest.join(classes.select("class", "signature", F.col("n_shingles").alias("n")), "class").join(counts.withColumnRenamed("shingles", "counts"), "class")
    tried = first.select("a", "b").unionByName(open_)
    rest = cut(across(rest, most, percent, chunks, slots).join(tried, ["a", "b"], "left_anti"), "rest")
    return components(cut(links.unionByName(confirmed(rest, sets_of(docs, classes, rest, shingle), percent)), "links"))


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    return cut(full_sets(docs, classes.select("class", "equal", "doc_id").join(wanted, "class", "left_semi"), shingle), "sets")


def unjoined(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    a, b = (parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
    rows = pairs.join(a, "a", "left").join(b, "b", "left")
    return rows.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def ordered(equal: Column, doc_id: Column) -> Column:
    """16 bytes that name a class and sort by doc_id, nulls last; the hash of the set tells classes of one doc_id apart."""
    number = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.coalesce(number, F.lit("F" * 16))), F.substring(equal, 1, 8))


def near_duplicates(docs: DataFrame, percent: int = 75, chunks: int = CHUNKS, slots: int = SLOTS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    prints = cut(fingerprints(docs, chunks, slots, shingle), "prints")
    sets = prints.where("equal is not null").groupBy("equal").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    classes = cut(sets.withColumn("class", ordered(F.col("equal"), F.col("doc_id"))), "classes")
    parts = linked(docs, classes, percent, chunks, slots, shingle)
    whole = classes.drop("signature").join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    # Only classes of several rows or with links need a look-up; a class may hold a third of all rows, so it is salted.
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    lookup = whole.join(least, "component").select("equal", "component_id").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = prints.drop("signature").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(lookup.withColumn("known", F.lit(True)), ["equal", "salt"], "left")
    out = out.withColumn("component_id", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def filter_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, one document of each group, with all their columns.

    Documents that a Bloom filter shows to be none of those dropped pass where they are read; only the others move.
    """
    dropped = cut(near_duplicates(docs, **how).where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.col("doc_id").cast("string").alias("dropped_key"))
    probed = maybe(rows, "dropped_key", dropped.select(F.col("doc_id").cast("string").alias("url")))
    rest = probed.where("maybe").join(dropped, "doc_id", "left_anti")
    return probed.where("not maybe").select("row.*").union(rest.select("row.*"))
