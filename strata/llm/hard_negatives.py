"""Hard negatives by segment summaries.

Vectors are integers (``floor(256 x)``) cut into segments of 16, 8, 4 and 2 components; of every segment
the mean and the standard deviation are stored.  With segments of length m, the product of the two
means times m, plus or minus m times the product of the two deviations, bounds what a segment adds to the inner
product; their sum bounds a score from both sides.  A pair of anchor and row is refined from the longest segments
to the shortest while its bounds reach what is wanted, and only what is left is scored exactly:

* positives: rows of the anchor's label whose upper bound reaches the anchor's fifth best score so far;
* negatives: rows of other labels whose bounds meet, for one of the anchor's positives, the window of
  50 % to 95 % of the positive's score, above the third best score found in it so far.

Rows are packed into blocks, stored once.  Anchors are taken in blocks of at most ``ANCHOR_BYTES``, which bounds
the broadcast; every block of anchors meets all blocks of rows, in tasks that keep only the best of each
anchor.  Windows over a few rows per anchor and task end each of the two passes.

Defined results.  Rows with a null label, a null vector, or a null or non-finite component take no part.
Null vec_id: no anchor, label unchanged, last among equal scores.  Repeated rows are rows of their own (a
repeated anchor is one of its own positives' candidates).  Vectors of different lengths: the missing components are 0;
an empty vector scores 0.  Components beyond 2^28 in size count as 2^28, so scores of up to 64 such components
stay 64-bit integers.  Positives with a negative score have an empty window.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, remove, store, table

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
SEGMENTS = (16, 8, 4, 2)  # lengths, longest first
ROWS = 4096  # of a packed block
ANCHOR_BYTES = 32 << 20
MOST = 1 << 28
FIRST_ROWS = 256  # looked at first, so that there are scores to reach
DENSE = 0.2  # share of pairs from which a level is computed for all
LEAST, MOST_SCORE = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_PACKED = "row binary, id binary, known binary, label binary, dims int, vectors binary, means binary, deviations binary"
_PACKED_ARROW = pa.schema([("row", pa.binary()), ("id", pa.binary()), ("known", pa.binary()), ("label", pa.binary()), ("dims", pa.int32()), ("vectors", pa.binary()), ("means", pa.binary()), ("deviations", pa.binary())])


def taking_part(embeddings: DataFrame, anchor_every: int, shift_every: int, shift: Column) -> DataFrame:
    """row, vec_id, label (shifted where asked), embedding (doubles), is_anchor."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.filter(F.col("label").isNotNull() & x.isNotNull()).filter(~odd)
    vec_id = F.col("vec_id").cast("long")
    label = F.when(vec_id % shift_every == 0, shift).otherwise(F.col("label").cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), label.alias("label"), x.cast("array<double>").alias("embedding"), F.coalesce(vec_id % anchor_every == 0, F.lit(False)).alias("is_anchor"))


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of every length, longest first, side by side."""
    means, deviations = [], []
    for m in SEGMENTS:
        parts = vectors.reshape(len(vectors), -1, m).astype(np.float64)
        means.append(parts.mean(axis=2))
        deviations.append(parts.std(axis=2))
    return np.concatenate(means, axis=1).astype(np.float32), np.concatenate(deviations, axis=1).astype(np.float32)


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of at most ``ROWS`` rows with their summaries, in the order of labels within a block."""
    schema = _PACKED_ARROW

    def work(batches):
        for big in batches:
            for b in (big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)):
                lists = b.column(3)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                vectors = np.zeros((b.num_rows, dims), dtype=np.int32)
                flat = np.clip(np.floor(256.0 * np.clip(lists.flatten().to_numpy(zero_copy_only=False), -MOST, MOST)), -MOST, MOST)
                vectors[np.arange(dims) < sizes[:, None]] = flat
                label = b.column(2).to_numpy()
                order = np.argsort(label, kind="stable")
                vectors = vectors[order]
                means, deviations = summaries(vectors)
                vec_id = b.column(1)
                columns = [b.column(0).to_numpy(), vec_id.fill_null(0).to_numpy(), vec_id.is_valid().to_numpy(zero_copy_only=False), label]
                raw = [[np.ascontiguousarray(c[order]).tobytes()] for c in columns]
                yield batch(schema, *raw, [dims], [vectors.tobytes()], [means.tobytes()], [deviations.tobytes()])

    return rows.select("row", "vec_id", "label", "embedding").mapInArrow(work, _PACKED)


class Block:
    """Rows of a packed block as arrays."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, known: np.ndarray, label: np.ndarray, vectors: np.ndarray, means: np.ndarray, deviations: np.ndarray):
        self.row, self.vec_id, self.known, self.label = row, vec_id, known, label
        self.vectors, self.means, self.deviations = vectors, means, deviations
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.levels, start = [], 0
        for m in SEGMENTS:
            n = vectors.shape[1] // m
            self.levels.append((m, means[:, start : start + n], deviations[:, start : start + n]))
            start += n

    @classmethod
    def of(cls, row: dict):
        n = len(row["row"]) // 8
        numbers = [np.frombuffer(row[c], t) for c, t in (("row", np.int64), ("id", np.int64), ("known", np.bool_), ("label", np.int64))]
        return cls(*numbers, np.frombuffer(row["vectors"], np.int32).reshape(n, row["dims"]), *(np.frombuffer(row[c], np.float32).reshape(n, -1) for c in ("means", "deviations")))

    @classmethod
    def joined(cls, blocks: list):
        return cls(*(np.concatenate([getattr(b, a) for b in blocks]) for a in ("row", "vec_id", "known", "label", "vectors", "means", "deviations")))

    def take(self, which):
        return Block(*(getattr(self, a)[which] for a in ("row", "vec_id", "known", "label", "vectors", "means", "deviations")))


def bounds(level: int, a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of the pairs (i, j), wide enough for rounding."""
    m, am, ad = a.levels[level]
    _, bm, bd = b.levels[level]
    if len(i) > DENSE * len(a.row) * len(b.row):
        middle, spread = (am @ bm.T)[i, j], (ad @ bd.T)[i, j]
    else:
        middle, spread = np.einsum("ij,ij->i", am[i], bm[j]), np.einsum("ij,ij->i", ad[i], bd[j])
    # single precision: neither sum of products exceeds the product of the norms
    slack = 1.2e-7 * (am.shape[1] + 8) * a.norm[i] * b.norm[j] + 1e-3
    return m * (middle.astype(np.float64) - spread) - slack, m * (middle.astype(np.float64) + spread) + slack


def exact(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    dims = a.vectors.shape[1]
    largest = max((int(np.abs(x.vectors).max()) if x.vectors.size else 0 for x in (a, b)))
    kind = np.float64 if dims * largest * largest < 1 << 53 else np.int64
    x, y = a.vectors.astype(kind), b.vectors.astype(kind)
    if kind is np.float64 and len(i) > DENSE * len(a.row) * len(b.row):
        return (x @ y.T)[i, j].astype(np.int64)
    return np.einsum("ij,ij->i", x[i], y[j]).astype(np.int64)


def qualifying(a: Block, b: Block, allowed: np.ndarray, reaches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Allowed pairs (i, j) whose bounds ``reaches(i, lower, upper)`` at every level, and their scores."""
    i, j = np.nonzero(allowed)
    for level in range(len(SEGMENTS)):
        if not len(i):
            break
        keep = reaches(i, *bounds(level, a, b, i, j))
        i, j = i[keep], j[keep]
    score = exact(a, b, i, j)
    keep = reaches(i, score, score)
    return i[keep], j[keep], score[keep]


class Best:
    """The k best (score, id, row) of each key; equal scores by id, unknown ids last."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.score = np.full((keys, k), LEAST)
        self.columns = np.zeros((3, keys, k), dtype=np.int64)  # unknown, id, row

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, key: np.ndarray, score: np.ndarray, b: Block, j: np.ndarray) -> None:
        if not len(key):
            return
        which = np.unique(key)
        keys = np.concatenate([np.repeat(which, self.k), key])
        scores = np.concatenate([self.score[which].ravel(), score])
        columns = [np.concatenate([c[which].ravel(), x]) for c, x in zip(self.columns, (~b.known[j], b.vec_id[j], b.row[j]))]
        unknown, vec_id, row = columns
        order = np.lexsort((row, vec_id, unknown, np.where(scores == LEAST, MOST_SCORE, -scores), keys))
        begins = np.searchsorted(keys[order], which)
        take = order[begins[:, None] + np.arange(self.k)]
        self.score[which] = scores[take]
        for c, x in zip(self.columns, columns):
            c[which] = x[take]

    def rows(self):
        key, place = np.nonzero(self.score != LEAST)
        unknown, vec_id, row = (c[key, place] for c in self.columns)
        return key, self.score[key, place], pa.array(vec_id, mask=unknown.astype(bool)), row


def mined(blocks: DataFrame, anchors: Block, windows: np.ndarray | None) -> DataFrame:
    """Per task the best rows of each anchor.  ``windows``: (anchors, positives, 2) least and highest score of
    negatives; None: the best of the anchor's own label."""
    shared = blocks.sparkSession.sparkContext.broadcast((anchors, windows))
    schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])

    def work(batches):
        a, windows = shared.value
        n, count = len(a.row), 1 if windows is None else windows.shape[1]
        best = Best(n * count, POSITIVES if windows is None else NEGATIVES)
        seen = False
        for packed_rows in batches:
            for row in packed_rows.to_pylist():
                block = Block.of(row)
                for rows in ((slice(0, FIRST_ROWS), slice(FIRST_ROWS, None)) if not seen else (slice(0, None),)):
                    b = block.take(rows)
                    for x in range(0, n if len(b.row) else 0, 256):
                        some = slice(x, x + 256)
                        part = a.take(some)
                        if windows is None:
                            positives(best, part, x, b)
                        else:
                            negatives(best, part, x, b, windows[some])
                seen = True
        key, score, vec_id, row = best.rows()
        yield batch(schema, key // count, (key % count).astype(np.int32), score, vec_id, row)

    return blocks.mapInArrow(work, "anchor long, window int, score long, vec_id long, row long")


def positives(best: Best, a: Block, first: int, b: Block) -> None:
    allowed = (a.label[:, None] == b.label[None]) & (a.row[:, None] != b.row[None])
    least = best.least()[first : first + len(a.row)].astype(np.float64)
    i, j, score = qualifying(a, b, allowed, lambda i, low, high: high >= least[i])
    best.add(first + i, score, b, j)


def negatives(best: Best, a: Block, first: int, b: Block, windows: np.ndarray) -> None:
    n, count = windows.shape[:2]
    low, high = windows[:, :, 0], windows[:, :, 1]
    wanted = np.maximum(low, best.least()[first * count : (first + n) * count].reshape(n, count))

    def reaches(i, lower, upper):
        out = np.zeros(len(i), dtype=bool)
        for w in range(count):
            out |= (upper >= wanted[i, w]) & (lower <= high[i, w])
        return out

    allowed = a.label[:, None] != b.label[None]
    i, j, score = qualifying(a, b, allowed, reaches)
    for w in range(count):
        keep = (score >= wanted[i, w]) & (score <= high[i, w])
        best.add((first + i[keep]) * count + w, score[keep], b, j[keep])


def at_most(scores: np.ndarray, percent: int) -> np.ndarray:
    """The largest integers n with 100 n <= percent * score; no product leaves 64 bits."""
    whole, rest = scores // 100, scores % 100
    return percent * whole + percent * rest // 100


def at_least(scores: np.ndarray, percent: int) -> np.ndarray:
    whole, rest = scores // 100, scores % 100
    return percent * whole - (-percent * rest // 100)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchor_every: int = 50, shift_every: int = 7, classes: int = 10, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = store(taking_part(embeddings, anchor_every, shift_every, (F.col("label").cast("long") + 1) % classes), "negatives-rows")
    longest = SEGMENTS[0]
    dims = max(1, -(-(rows.agg(F.max(F.size("embedding"))).first()[0] or 0) // longest)) * longest
    blocks = store(packed(rows, dims), "negatives-blocks", "none")
    anchors = store(packed(rows.filter("is_anchor"), dims), "negatives-anchors", "none")
    bytes_of_all = anchors.agg(F.sum(F.octet_length("vectors") + F.octet_length("means") + F.octet_length("deviations"))).first()[0] or 0
    groups = -(-bytes_of_all // anchor_bytes)
    out = []
    for g in range(groups):
        own = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toArrow().to_pylist()
        if not own:
            continue
        block = Block.joined([Block.of(r) for r in own])
        best = store(first_of(mined(blocks, block, None), ["anchor"], POSITIVES), "negatives-best")
        scores = np.full((len(block.row), POSITIVES), LEAST)
        top = best.select("anchor", "rank", "score").toArrow()  # five numbers an anchor of the block
        scores[top.column("anchor").to_numpy(), top.column("rank").to_numpy() - 1] = top.column("score").to_numpy()
        windows = np.stack([at_least(scores, LOW), at_most(scores, HIGH)], axis=2)
        windows[scores == LEAST] = (1, 0)  # nothing fits
        negatives_ = first_of(mined(blocks, block, windows), ["anchor", "window"], NEGATIVES)
        ids = spark.createDataFrame(pa.table({"anchor": pa.array(range(len(block.row)), pa.int64()), "anchor_id": pa.array(block.vec_id)}))
        pairs = best.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = negatives_.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "window"]).join(ids, "anchor")
        out.append(store(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-found"))
        remove(best)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END)::BIGINT AS label,
         [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
pairs AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum([a.x[k] * b.x[k] FOR k IN range(1, least(len(a.x), len(b.x)) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) AS n FROM pairs WHERE same),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, q.vec_id AS negative_id, p.score AS positive_score, q.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY q.score DESC, q.vec_id NULLS LAST, q.r)::INTEGER AS rank
  FROM p JOIN pairs q ON p.anchor = q.anchor AND NOT q.same AND 50 * p.score <= 100 * q.score AND 100 * q.score <= 95 * p.score
  WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
""",
}
