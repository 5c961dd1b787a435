"""Line dedup: repeated runs of lines from a suffix array built by distributed prefix doubling; later copies are deleted.

DataFrame operations only. Lines that hold a word get an ID (two 64-bit hashes); the sequence of a document is that of
its line IDs. Only lines that occur twice or more can be part of a repeated run, so all others are dropped first and act
as unique ends. Suffixes are sorted by prefix doubling: a suffix's rank is (ID of its first line, number of suffixes of
that bucket which are smaller), the order of IDs being that of the hashes. A round joins each suffix with the one 2^k
lines further on and refines ranks from counts of equal pairs, so a frequent line is aggregated before it is shuffled.
Suffixes of equal rank after k rounds share their first 2^k lines: they form an interval of the suffix array whose
longest common prefix is at least 2^k, and two overlapping intervals of that kind name one of any length between.

A run counts if it holds `min_words` words or more. Each line of a repeated run of that kind, however long, lies in a
least window of it: the shortest run of min_words words from a given first line, or up to a given last line. Those have
at most min_words lines, which bounds the rounds. The first occurrence of a window's interval (by document and line)
stays; the lines of all later ones are deleted. So all later copies of every maximal repeated run go.

Defined results: documents are ordered by doc_id, nulls first, then by a hash of the text; null text has no lines and
stays null, empty text stays empty; texts of any length are read whole; rows that repeat doc_id and text count as one document and lose the same lines; lines without a word are
never deleted on their own, nor counted; of equal runs the first in that order stays; an empty table gives no rows; other columns pass through unchanged (n_chars is
set to the new length where it exists and its text changed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.llm.common import WORD, cut
from purselight.llm.url_bloom import maybe

NULL_ID = -(2**63)
DOC = ["d", "h"]  #: doc_id (NULL_ID for null) and hash of the text
NAME = ["b1", "b2", "r"]  #: rank of a suffix: ID of its first line, and place among the suffixes of that bucket


def keyed(docs: DataFrame) -> DataFrame:
    """d, h, text and the whole row as a struct, so that no column of docs can clash with those used here."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("h"), "text", F.struct("*").alias("row"))


def line_table(docs: DataFrame) -> DataFrame:
    """d, h, i (number among the lines with words), line (number in the text), b1, b2 (ID), words."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("body")))
    rows = keyed(docs.select("doc_id", "text")).select(*DOC, F.posexplode(F.filter(numbered, lambda x: x["body"].rlike(WORD))).alias("i", "x"))
    body = F.col("x.body")
    return rows.select(*DOC, "i", "x.line", F.xxhash64(body).alias("b1"), F.xxhash64(F.lit(1), body).alias("b2"), F.regexp_count(body, F.lit(WORD)).alias("words"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    often = lines.groupBy("b1", "b2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return lines.join(often, ["b1", "b2"]).dropDuplicates([*DOC, "i"])


def at(df: DataFrame, shift: Column | int, to: list[str]) -> DataFrame:
    """df's names under the position that lies `shift` before theirs."""
    return df.select(*DOC, (F.col("i") - shift).alias("i"), *(F.col(c).alias(t) for c, t in zip(NAME, to, strict=True)))


def ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """For k = 0, 1, ... with 2^k <= depth: suffixes whose first 2^k lines occur again, as d, h, i and their rank.

    Equal ranks mean equal first 2^k lines; ranks order the suffixes by their first 2^k line IDs.
    """
    out = [cut(lines.select(*DOC, "i", "b1", "b2", F.lit(0).cast("long").alias("r")), "ranks0")]
    follows = ["n1", "n2", "nr"]
    while 1 << len(out) <= depth:
        now = out[-1]
        pairs = now.join(at(now, 1 << (len(out) - 1), follows), [*DOC, "i"])
        counts = pairs.groupBy(*NAME, *follows).agg(F.count("*").alias("n"))
        before = Window.partitionBy(*NAME).orderBy(*follows).rowsBetween(Window.unboundedPreceding, -1)
        refined = counts.withColumn("less", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 1").drop("n")
        new = pairs.join(refined, [*NAME, *follows]).select(*DOC, "i", "b1", "b2", (F.col("r") + F.col("less")).alias("r"))
        out.append(cut(new, f"ranks{len(out)}"))
    return out


def least_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """d, h, i, n: the windows of n repeated lines from line i that are shortest from their first or to their last line."""
    island = F.col("i") - F.row_number().over(Window.partitionBy(*DOC).orderBy("i"))
    stretch = Window.partitionBy(*DOC, "island").orderBy("i")
    rows = lines.select(*DOC, "i", "words").withColumn("island", island)

    def shortest(sign: int) -> Column:
        out = F.lit(None).cast("int")
        for n in range(min_words, 0, -1):
            frame = stretch.rowsBetween(0, n - 1) if sign > 0 else stretch.rowsBetween(1 - n, 0)
            out = F.when((F.sum("words").over(frame) >= min_words) & (F.count("*").over(frame) == n), n).otherwise(out)
        return out

    both = rows.select(*DOC, "i", shortest(1).alias("ahead"), shortest(-1).alias("back"))
    starts = F.array(F.struct(F.col("i"), F.col("ahead").alias("n")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n")))
    return both.select(*DOC, F.explode(starts).alias("w")).select(*DOC, "w.i", "w.n").where("n is not null").distinct()


def deleted_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """d, h, line: the lines that belong to a later copy of a repeated run of min_words words."""
    lines = cut(repeated_lines(line_table(docs)), "lines")
    levels = ranks(lines, min_words)
    windows = cut(least_windows(lines, min_words), "windows")
    named = None
    first, last = ["s1", "s2", "sr"], ["e1", "e2", "er"]
    for k, level in enumerate(levels):
        size = 1 << k
        some = windows.where(F.col("n").between(size, 2 * size - 1))
        head = some.join(at(level, 0, first), [*DOC, "i"])
        tail = head.withColumn("e", F.col("i") + F.col("n") - size).join(at(level, 0, last).withColumnRenamed("i", "e"), [*DOC, "e"]).drop("e")
        named = tail if named is None else named.unionByName(tail)
    named = cut(named, "named")
    interval = ["n", *first, *last]
    origin = named.groupBy(*interval).agg(F.min(F.struct(*DOC, "i")).alias("origin"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = named.join(origin, interval).where(F.struct(*DOC, "i") != F.col("origin"))
    places = later.select(*DOC, F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    return places.join(lines.select(*DOC, "i", "line"), [*DOC, "i"]).select(*DOC, "line")


def rewrite(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """docs with the new text, and a last column deleted_lines (how many lines went).

    Deleted line numbers are gathered per document, which bounds them by its lines. Documents that a Bloom filter shows
    to lose none pass where they are read; only the others move.
    """
    gone = cut(deleted_lines(docs, min_words).groupBy(*DOC).agg(F.collect_set("line").alias("gone")), "gone")
    key = F.concat_ws(":", "d", "h")
    rows = keyed(docs).select(*DOC, "row").withColumn("line_key", key)
    probed = maybe(rows, "line_key", gone.select(key.alias("url")))
    moved = probed.where("maybe").join(gone, DOC, "left")
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    whole = moved.withColumn("new", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left))

    def column(name: str) -> Column:
        if name == "n_chars":
            return F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new").cast(docs.schema[name].dataType)).alias(name)
        return F.col("new").alias(name) if name == "text" else F.col(f"row.`{name}`")

    lost = F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("deleted_lines")
    same = probed.where("not maybe").select("row.*", F.lit(0).cast("long").alias("deleted_lines"))
    return whole.select(*map(column, docs.columns), lost).union(same)


def filter_documents(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """docs with later copies of runs deleted, without the documents of which no word is left through that."""
    out = rewrite(docs, min_words).toDF(*(f"c{i}" for i in range(len(docs.columns))), "deleted_lines")
    text = F.col(f"c{docs.columns.index('text')}")
    return out.where((F.col("deleted_lines") == 0) | text.rlike(WORD)).drop("deleted_lines").toDF(*docs.columns)


def maximal_runs(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, first_line, last_line (numbers in the text), lines: stretches of deleted lines."""
    rows = deleted_lines(docs, min_words).join(line_table(docs).select(*DOC, "line", "i").distinct(), [*DOC, "line"])
    island = F.col("i") - F.row_number().over(Window.partitionBy(*DOC).orderBy("i"))
    runs = rows.withColumn("island", island).groupBy(*DOC, "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines"))
    return runs.select(F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "first_line", "last_line", "lines")
