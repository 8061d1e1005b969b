"""Line dedup: content-defined chunks of lines, repeated ones removed.

A text is split at line feeds and each line hashed; blank lines belong to the line before them.  Borders between chunks are
chosen by content: a rolling hash over the hashes of two consecutive lines puts one where it is the least of three in a row (so
borders are at most three lines apart), and a line of ``long_chars`` characters has one on either side, so that the
shortest passages of ordinary lines hold a whole chunk.  An insertion shifts no border behind it.
From each border a chunk runs to the first border by which it has at least two lines and ``min_chars`` characters; a line of
``line_chars`` characters is a chunk of its own too.  Chunks are compared over all documents by a 128-bit hash; of a chunk that
occurs again the first occurrence (least doc_id, then least line) stays, and each other one goes if its bytes equal the first's.
Short lines around a removed chunk go with it as far as they equal those around the first occurrence, byte by
byte; longer ones are chunks' beginnings themselves.  Every line removed has an equal one at an earlier place, so one copy always
stays.

Only DataFrame functions are used.  Texts move twice: to fetch the lines of
repeated chunks, and to cut them out.  Chunks are counted before the shuffle, and the
occurrences of a hot chunk are found by ``SALTS`` copies of its hash.

Defined results.  Null text stays null, an empty one empty, both with 0 lines
removed.  Null doc_id sorts first.  Rows repeated whole (same doc_id and text) count as one
document and come out alike.  Passages under ``min_chars`` characters (white space at the ends of
lines doesn't count) and single lines under ``line_chars`` never go.  Very long texts are cut whole.  Other columns pass through,
whatever their names: an added column whose name is taken gets ``_`` behind it until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

MIN_CHARS = 60
LINE_CHARS = 200
LONG_CHARS = 24
SALTS = 16


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fewest(sizes: Column, min_chars: int) -> Column:
    """How many of the first ``sizes``, two at least, add up to ``min_chars``; null if all don't."""
    done = lambda s: (s["k"] >= 2) & (s["total"] >= min_chars)
    add = lambda s, x: F.when(done(s), s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["total"] + x).alias("total")))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("k"), F.lit(0).alias("total")), add, lambda s: F.when(done(s), s["k"]))


def chunk_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start), "\n")


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def rolling(hashes: Column) -> Column:
    """At each line the hash of it and the next."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def borders_of(lines: Column, used: Column, sizes: Column, long_chars: int) -> Column:
    """The places among the ``used`` lines before which a chunk may begin or end, the end of the text among them."""

    def chosen(roll: Column) -> Column:
        def border(i: Column) -> Column:
            less = lambda k: F.coalesce(F.get(roll, i) <= F.get(roll, i + k), F.lit(False))
            least = (less(-1) & less(-2)) | (less(-1) & less(1)) | (less(1) & less(2))
            wide = lambda k: F.coalesce(F.get(sizes, i + k) >= long_chars, F.lit(False))
            return (i == 0) | wide(0) | wide(-1) | least
        return F.concat(F.filter(upto(F.size(used)), border), F.array(F.size(used)))

    return let(rolling(F.transform(used, lambda i: F.xxhash64(F.get(lines, i)))), chosen)


def chunks_of(text: Column, min_chars: int, line_chars: int, long_chars: int) -> Column:
    """Array of (start, end, a, b): the lines of each chunk and the halves of its hash."""

    def spans(lines: Column) -> Column:
        def of(used: Column) -> Column:
            def among(sizes: Column) -> Column:
                def runs(borders: Column) -> Column:
                    def run(s: Column, j: Column) -> Column:
                        # every used line has a character, so ``min_chars`` of them are enough
                        lines_needed = F.when(F.get(sizes, s) + F.get(sizes, s + 1) >= min_chars, F.lit(2)).otherwise(fewest(F.slice(sizes, s + 1, min_chars), min_chars))
                        near = F.when(F.get(borders, j + 1) >= s + 2, F.get(borders, j + 1)).otherwise(F.get(borders, j + 2))
                        end = lambda k: F.when(k == 2, near).otherwise(F.get(F.filter(F.slice(borders, j + 2, k), lambda b: b >= s + k), 0))
                        whole = F.when(s < F.size(used), let(lines_needed, lambda k: F.when(k > 0, let(end(k), lambda e: F.struct(F.get(used, s).alias("start"), (F.get(used, e - 1) + 1).alias("end"))))))
                        alone = F.when(F.get(sizes, s) >= max(line_chars, min_chars), F.struct(F.get(used, s).alias("start"), (F.get(used, s) + 1).alias("end")))
                        return F.array(whole, alone)
                    return F.filter(F.flatten(F.transform(borders, run)), lambda c: c.isNotNull())
                return let(borders_of(lines, used, sizes, long_chars), runs)
            return let(F.transform(used, lambda i: F.length(F.trim(F.get(lines, i)))), among)

        wide = let(F.filter(upto(F.size(lines)), lambda i: F.length(F.trim(F.get(lines, i))) > 0), of)
        return F.transform(wide, lambda c: let(chunk_text(lines, c["start"], c["end"]), lambda t: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b")
        )))

    return let(lines_of(text), spans)


def short_lines(lines: Column, long_chars: int) -> Column:
    """The lines before the first long one."""
    wide = F.transform(lines, lambda x: F.length(F.trim(x)) >= long_chars)
    return let(F.array_position(wide, F.lit(True)).cast("int"), lambda p: F.when(p > 0, F.slice(lines, F.lit(1), p - 1)).otherwise(lines))


def same(mine: str, kept: str) -> Column:
    """How many lines in a row are equal, going away from the chunk."""
    equal = F.zip_with(F.col(mine), F.col(kept), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(equal, F.lit(False)).cast("int"), lambda p: F.when(p == 0, F.size(equal)).otherwise(p - 1))


def free_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, line_chars: int = LINE_CHARS, long_chars: int = LONG_CHARS, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``text`` cut; adds ``n_lines`` and ``n_removed_lines`` (see :func:`free_name`)."""
    id_, text = F.col("doc_id"), F.col("text")
    keys = [F.xxhash64(id_, text).alias("_k1"), F.xxhash64(text, id_, F.lit(1)).alias("_k2")]
    chunks = docs.select(id_.alias("doc"), *keys, F.explode(chunks_of(text, min_chars, line_chars, long_chars)).alias("c")).select("doc", "_k1", "_k2", "c.start", "c.end", "c.a", "c.b")
    # a repeated row gives the same occurrence, which counts once
    place = F.struct("doc", "_k1", "_k2", "start")
    again = chunks.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last OR (first IS NULL) <> (last IS NULL)")
    copies = again.select("a", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = chunks.withColumn("salt", F.pmod(F.xxhash64("_k1", "start"), F.lit(salts)).cast("int"))
    hits = salted.join(copies, ["a", "b", "salt"]).select("_k1", "_k2", F.struct("a", "b", "start", "end", ((F.col("first._k1") == F.col("_k1")) & (F.col("first._k2") == F.col("_k2")) & (F.col("first.start") == F.col("start"))).alias("is_first")).alias("hit"))
    hits = store(hits.groupBy("_k1", "_k2").agg(F.collect_set("hit").alias("hits")), "lines-hits")

    # the lines of repeated chunks, with the short ones around them: fewer than ``min_chars`` lines with
    # characters, as more would be a chunk
    def evidence(lines: Column) -> Column:
        return F.transform(F.col("hits"), lambda h: F.struct(
            h["a"].alias("a"), h["b"].alias("b"), h["start"].alias("start"), h["end"].alias("end"), h["is_first"].alias("is_first"), chunk_text(lines, h["start"], h["end"]).alias("text"),
            short_lines(F.reverse(F.slice(lines, F.greatest(h["start"] - min_chars, F.lit(0)) + 1, F.least(h["start"], F.lit(min_chars)))), long_chars).alias("before"),
            short_lines(F.slice(lines, h["end"] + 1, F.lit(min_chars)), long_chars).alias("after"),
        ))

    keyed = docs.select(*keys, text.alias("text"))
    found = keyed.join(hits, ["_k1", "_k2"])
    found = store(found.select("_k1", "_k2", F.explode(let(lines_of(F.col("text")), evidence)).alias("e")).select("_k1", "_k2", "e.*"), "lines-found", "zstd")
    first = found.filter("is_first").groupBy("a", "b").agg(F.min(F.struct("text", "before", "after")).alias("kept"))
    # texts are not copied here: a hot chunk's occurrences are split by Spark's skew join
    other = found.filter("NOT is_first")

    equal = other.join(first, ["a", "b"]).filter(F.col("text") == F.col("kept.text"))
    spans = equal.select("_k1", "_k2", F.struct((F.col("start") - same("before", "kept.before")).alias("lo"), (F.col("end") + same("after", "kept.after")).alias("hi")).alias("span"))
    spans = spans.groupBy("_k1", "_k2").agg(F.collect_set("span").alias("spans"))

    rows = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(spans, ["_k1", "_k2"], "left")
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"] - 1))))

    def cut(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return let(left, lambda i: F.struct(F.array_join(F.transform(i, lambda k: F.get(lines, k)), "\n").alias("text"), F.size(lines).alias("n"), (F.size(lines) - F.size(i)).alias("removed")))

    joined = joined.withColumn("_cut", F.when(F.col("spans").isNotNull(), let(lines_of(F.col("_row.text")), cut)))
    new = [F.coalesce("_cut.text", "_row.text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    n_lines = F.when(F.col("_row.text").isNull() | (F.col("_row.text") == ""), 0).otherwise(F.size(lines_of(F.col("_row.text"))))
    return joined.select(*new, n_lines.alias(free_name("n_lines", docs.columns)), F.coalesce("_cut.removed", F.lit(0)).alias(free_name("n_removed_lines", docs.columns)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE: dict[str, str] = {}
