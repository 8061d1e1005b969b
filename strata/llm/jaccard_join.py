"""N-gram Jaccard join by a token-group matrix: classes of near-equal documents.

Two documents link when the Jaccard similarity of their word-shingle sets reaches
``percent``; the result is the connected components, complete and without listing pairs of copies.

1. Equal sets are one *set*, known by a 64-bit digest.
2. The matrix.  For sets of a size class, hashes are cut into k parts by value, with k twice the
   most hashes d in which two linked sets of that class can differ, so that linked
   sets agree on some non-empty part whole (sets with at most d non-empty parts also enter the empty ones).
   A row of the matrix is one part's content; its columns are the sets that have it.
   Of a set only its d + 1 rarest rows count (rows in one order for all, by their number of sets): linked sets
   differ in d parts at most, so the first row that they share, in that order, is among these of both.
   Similar sets that aren't linked differ in many parts, have enough rows of their own and fall out here.
3. Links.  Sets begin as classes of one.  In each of ``ROUNDS`` rounds a class is compared with one
   other, by a representative, and linked ones are joined.
4. Groups.  Only rows that still hold several classes are left.  Sets that such rows connect are
   similar: a group, kept in pages of about ``PAGE`` shingles, each with the union of its
   members' shingles.  A set queries its group's pages: a page is opened only if the
   overlap with its union allows a link, and then the overlap with every member is counted.
   A page yields no more links than it takes to join its classes.  Every pair that
   shares a row is thus settled, so no link is lost.

Memory: parts go to buckets by hash (about ``BUCKET_PARTS`` entries each); a task holds two pages
(of one set each, if these are longer).  Equal sets are dropped before the parts are dealt out.

Defined results.  Null or empty text, or no word: 0 shingles, linked with nothing.
Fewer words than a shingle: the whole sequence is one.  Null doc_id: a
document like others; a class's id is the least doc_id that isn't null.  Repeated rows: each is
returned.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, remove, slices, store, table
from .components import components
from .kernels import mix64, shingle_sets, word_hashes

BUCKET_PARTS = 400_000
PAGE = 1 << 17
BROADCAST_ROWS = 2_000_000  # of two longs each; more are joined by a shuffle of the texts
LEAST = 256  # what a shorter set counts in a page
ROUNDS = 2
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(1 << 32)


def digest(values: np.ndarray) -> int:
    """64-bit digest of a sorted set, signed as Spark's long."""
    place = mix64(np.arange(1, len(values) + 1, dtype=np.uint64) * _P)
    return int(mix64(np.array([(mix64(values ^ place)).sum(dtype=np.uint64) + np.uint64(len(values))]))[0].astype(np.int64))


class SizeClasses:
    """Intervals of sizes such that linked sets are in the same or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.last = percent, [0]

    def of(self, n: int) -> int:
        while self.last[-1] < n:
            self.last.append((self.last[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.last, n))

    def parts(self, c: int) -> tuple[int, int]:
        """(k, differ) of class ``c``: its parts and the most of these in which linked sets differ.
        k is 0 where only equal sets can link."""
        while len(self.last) <= c:
            self.last.append((self.last[-1] + 1) * 100 // self.percent)
        differ = (100 - self.percent) * 2 * self.last[c] // (100 + self.percent)
        return (2 * differ + 2, differ) if differ else (0, 0)


def cuts(values: np.ndarray, k: int) -> np.ndarray:
    """Where sorted hashes pass the borders of ``k`` equal ranges, ends included."""
    borders = np.array([(j << 64) // k for j in range(1, k)], dtype=np.uint64) if k < 64 else (np.arange(1, k, dtype=np.uint64) * np.uint64((1 << 64) // k))
    return np.concatenate([[0], np.searchsorted(values, borders), [len(values)]])


def running_sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values), dtype=np.uint64)])


def part_hashes(values: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """The rows of the matrix that a set is in; bit 32 tells the class instance."""
    out = []
    c = classes.of(len(values))
    sums = running_sums(values)
    for instance in (c, c + 1):
        k, differ = classes.parts(instance)
        if not k:
            continue
        at = cuts(values, k)
        size = np.diff(at)
        content = sums[at[1:]] - sums[at[:-1]]
        rows = mix64(content + np.arange(k, dtype=np.uint64) * _P + np.uint64(instance * int(_Q) % (1 << 64)) + size.astype(np.uint64))
        rows = (rows & ~_ODD) | (_ODD if instance % 2 else np.uint64(0))
        out.append(rows[size > 0] if np.count_nonzero(size) > differ else rows)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def to_spare(values: np.ndarray, classes: SizeClasses) -> tuple[int, int]:
    """How many of its commonest rows a set can do without, in the even and in the odd class instance."""
    out, c = [0, 0], classes.of(len(values))
    for instance in (c, c + 1):
        k, differ = classes.parts(instance)
        if k:
            filled = np.count_nonzero(np.diff(cuts(values, k)))
            # one more row for each thousand, should two rows of a set have the same short hash
            out[instance % 2] = max(0, int(filled) - differ - 2 - differ // 1000)
    return out[0], out[1]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    lo, hi = sorted((len(x), len(y)))
    if 100 * lo < percent * hi:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (lo + hi - both)


def _sets(column, size: int) -> list[np.ndarray]:
    words, rows = word_hashes(column, lower=True)
    return shingle_sets(words, rows, size)


def document_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text key, n_shingles, set (digest; null if empty), rows to spare (even, odd) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.int64()), ("even", pa.int64()), ("odd", pa.int64())])

    def work(batches):
        classes = SizeClasses(percent)
        for b in slices(batches):
            sets = _sets(b.column(2), size)
            spare = [to_spare(s, classes) if len(s) else (0, 0) for s in sets]
            yield batch(schema, b.column(0), b.column(1), [len(s) for s in sets], [digest(s) if len(s) else None for s in sets], [x for x, _ in spare], [x for _, x in spare])

    return docs.mapInArrow(work, "doc_id long, text_key long, n_shingles long, set long, even long, odd long")


def matrix(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Rows of the matrix with several sets: (row, set, odd, n_sets, times); rows with the same sets
    appear as one, ``times`` tells how many they are."""
    schema = pa.schema([("bucket", pa.int32()), ("parts", pa.binary()), ("sets", pa.binary())])

    def parts(batches):
        classes, seen, found, owners, total = SizeClasses(percent), set(), [], [], 0

        def deal():
            hashes, of = np.concatenate(found), np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners])
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            rows = [(k, short[order[a:b]].tobytes(), of[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in slices(batches):
            for values in _sets(b.column(2), size):
                if not len(values):
                    continue
                name = digest(values)
                if name in seen:
                    continue
                seen.add(name)
                rows = part_hashes(values, classes)
                if len(rows):
                    found.append(rows)
                    owners.append((name, len(rows)))
                    total += len(rows)
            if total > 2_000_000:
                yield deal()
                found, owners, total, seen = [], [], 0, set()
        if total:
            yield deal()

    def shared(asked: pd.DataFrame) -> pd.DataFrame:
        part = np.concatenate([np.frombuffer(x, np.uint32) for x in asked["parts"]])
        of = np.concatenate([np.frombuffer(x, np.int64) for x in asked["sets"]])
        order = np.lexsort((of, part))
        part, of = part[order], of[order]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])])
        part, of = part[new], of[new]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(begins, len(part)))
        some = sizes > 1
        if not some.any():
            return pd.DataFrame({"row": [], "set": [], "odd": [], "n_sets": [], "times": []})
        # a row's name comes from its sets, so that equal rows fall together
        odd = part[begins] & np.uint32(1)
        name = mix64(np.add.reduceat(mix64(of.view(np.uint64)), begins) + sizes.astype(np.uint64) * _P + odd).view(np.int64)
        _, once, times = np.unique(name[some], return_index=True, return_counts=True)
        kept = np.flatnonzero(some)[once]
        n = sizes[kept]
        at = np.repeat(begins[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return pd.DataFrame({"row": np.repeat(name[kept], n), "set": of[at], "odd": np.repeat(odd[kept], n) > 0, "n_sets": np.repeat(n, n), "times": np.repeat(times, n)})

    dealt = docs.mapInArrow(parts, "bucket int, parts binary, sets binary")
    found = dealt.groupBy("bucket").applyInPandas(shared, "row long, set long, odd boolean, n_sets long, times long")
    return found.groupBy("row", "set", "odd", "n_sets").agg(F.sum("times").alias("times"))


def rarest(shared: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (row, set) that count: each set goes without its commonest, as many as it can spare."""
    spare = known.filter("set IS NOT NULL").groupBy("set").agg(F.max("even").alias("even"), F.max("odd").alias("spare_odd"))
    common = Window.partitionBy("set", "odd").orderBy(F.desc("n_sets"), F.desc("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = shared.join(spare, "set").withColumn("spare", F.when(F.col("odd"), F.col("spare_odd")).otherwise(F.col("even")))
    kept = counted.withColumn("so_far", F.sum("times").over(common)).filter("so_far > spare").select("row", "set")
    return kept.join(kept.groupBy("row").count().filter("count > 1").select("row"), "row")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def links_of(asking: pd.DataFrame, page: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) of asking sets with members of a page, as many as join the classes that these connect."""
    both = pd.concat([asking, page], ignore_index=True)
    names, label = both["set"].to_numpy(), both["class"].to_numpy().copy()
    values = [np.frombuffer(x, np.uint64) for x in both["shingles"]]
    sizes = np.array([len(x) for x in values])
    known, ids = np.unique(np.concatenate(values), return_inverse=True)
    ends = np.cumsum(sizes)
    n, m = len(asking), sizes[len(asking) :]
    of_page, begins = ids[ends[n - 1] :], np.cumsum(m) - m
    union, mine = np.zeros(len(known), dtype=bool), np.zeros(len(known), dtype=np.int32)
    union[of_page] = True
    a, b = [], []
    for i in range(n):
        own = ids[ends[i] - sizes[i] : ends[i]]
        most = np.count_nonzero(union[own])
        if 100 * most < percent * (sizes[i] + m.min() - most):
            continue
        mine[own] = 1
        overlap = np.add.reduceat(mine[of_page], begins)
        mine[own] = 0
        near = n + np.flatnonzero(100 * overlap >= percent * (sizes[i] + m - overlap))
        classes, first = np.unique(label[near], return_index=True)
        other = classes != label[i]
        if other.any():
            a += [names[i]] * int(other.sum())
            b += names[near[first[other]]].tolist()
            label[np.isin(label, classes)] = label[i]
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def open_pages(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the sets of ``placed`` (row, set, group) that rows connect and that are in different classes."""
    first = placed.groupBy("row").agg(F.min("group").alias("a"))
    alike = components(placed.select("row", F.col("group").alias("b")).join(first, "row").select("a", "b").distinct())
    members = placed.select("set", "group").distinct().join(alike.select(F.col("node").alias("group"), F.col("root").alias("alike")), "group")
    members = store(members.join(sets.select("set", "n_set"), "set"), "join-members")
    pages = members.groupBy("alike").agg(F.ceil(F.sum(F.greatest("n_set", F.lit(LEAST))) / PAGE).cast("int").alias("pages"))
    members = members.join(pages, "alike").withColumn("page", F.pmod(F.xxhash64("set"), "pages").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("other")
    dealt = members.join(sets.select("set", "shingles"), "set").select("alike", "page", "set", F.col("group").alias("class"), "shingles", other)
    dealt = dealt.withColumn("lo", F.least("page", "other")).withColumn("hi", F.greatest("page", "other")).drop("other")

    def work(both: pd.DataFrame) -> pd.DataFrame:
        lo, hi = both["lo"].iloc[0], both["hi"].iloc[0]
        asking, page = both[both["page"] == lo], both[both["page"] == hi]
        if asking.empty or page.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return links_of(asking, page, percent)

    return dealt.groupBy("alike", "lo", "hi").applyInPandas(work, "a long, b long")


def apart(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets in different groups, with these as ``ga`` and ``gb``."""
    of = lambda end, name: at.select(F.col("set").alias(end), F.col("group").alias(name))
    return pairs.join(of("a", "ga"), "a").join(of("b", "gb"), "b").filter("ga <> gb")


def joined(at: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (set, group) after joining those that ``links`` (a, b) of sets connect."""
    between = apart(links, at).select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    roots = components(between)
    return store(at.join(roots.select(F.col("node").alias("group"), "root"), "group", "left").select("set", F.coalesce("root", "group").alias("group")), "join-groups")


def jaccard_classes(docs: DataFrame, size: int = 4, percent: int = 85, roots: bool = False) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id of every document.

    ``roots``: also the class's own key (null for a document without words), whatever its ids are."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    known = store(document_sets(rows, size, percent), "join-sets")
    total = int(known.agg(F.sum("n_shingles")).first()[0] or 0)
    found = store(matrix(rows, size, percent, total * 8 * (100 - percent) // (100 + percent) // BUCKET_PARTS + 1), "join-matrix")
    shared = store(rarest(found, known), "join-rarest")
    remove(found)

    # the shingles of every set that shares a row, from one text that has it
    wanted = store(known.join(shared.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.min("text_key").alias("text_key")), "join-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    schema = pa.schema([("set", pa.int64()), ("n_set", pa.int64()), ("shingles", pa.binary())])

    def shingles(batches):
        for b in slices(batches):
            sets = _sets(b.column(1), size)
            yield batch(schema, b.column(0), [len(s) for s in sets], [s.tobytes() for s in sets])

    texts = rows.select("text_key", "text").join(wanted, "text_key").groupBy("set").agg(F.min("text").alias("text"))
    sets = store(texts.select("set", "text").mapInArrow(shingles, "set long, n_set long, shingles binary"), "join-shingles")

    # stars: each group is compared with one other, that it shares most rows with; a few rounds with other
    # representatives join most of what is linked, at a cost in proportion to the groups
    at = store(sets.select("set", F.col("set").alias("group")), "join-groups")
    for number in range(ROUNDS):
        reps = shared.join(at, "set").groupBy("row", "group").agg(F.min(F.struct(F.xxhash64("set", F.lit(number)).alias("h"), "set"))["set"].alias("rep"))
        head = reps.groupBy("row").agg(F.min(F.struct(F.xxhash64("group", F.lit(number)).alias("h"), "group", "rep")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        pairs = reps.join(head.select("row", "head.group", F.col("head.rep").alias("a")).withColumnRenamed("group", "to"), "row").filter("group <> to")
        best = pairs.groupBy("group", "to", "a", F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max(F.struct("n", "a", "b")).alias("best"))
        new = store(compare(best.select("best.a", "best.b"), sets, percent), "join-links")
        if not new.limit(1).count():
            break
        at = joined(at, new)

    # rows that still hold several classes
    placed = shared.join(at, "set")
    split = placed.groupBy("row").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("row")
    placed = store(placed.join(split, "row", "left_semi"), "join-open")
    more = store(open_pages(placed, sets, percent), "join-more")
    if more.limit(1).count():
        at = joined(at, more)
    mine = known.filter("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    mine = mine.join(at, "set", "left").select("set", "least", F.coalesce("group", "set").alias("root"))
    ids = mine.groupBy("root").agg(F.min("least").alias("component"))
    named = mine.join(ids, "root").select("set", "component", "root")
    return known.join(named, "set", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *(["root"] if roots else []))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n_shingles FROM s),
g AS MATERIALIZED (SELECT doc_id, unnest(grams) AS gram FROM s),
c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM c JOIN n AS u ON u.doc_id = a JOIN n AS v ON v.doc_id = b WHERE 100 * both_have >= 85 * (u.n_shingles + v.n_shingles - both_have)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = n.doc_id"""
}
