"""Ranked lexical search: term-at-a-time evaluation with a limited set of accumulators.

Every item is a query against all documents.  One pass over the texts counts the items' terms in
each document; the counts are stored, and document frequencies, N and L come from all of them.
A task then turns its documents into shards of at most ``SHARD_POSTINGS`` postings with an
inverted index each, and evaluates the items one after the other, rarest term first:

* while the bounds of the terms still to come (weight times the largest impact in the shard's
  posting list) can lift a new document to the k-th best score, every posting opens or adds to an accumulator;
* from then on no accumulator is opened; later postings only add to the survivors, whose scores stay
  exact, and survivors that can't reach the k-th score any more are let go.

The k-th score is that of the partial scores or of the shards before, whichever is higher.  Partial scores
only grow and comparisons are strict, so ties are never lost: the result is that of full scoring.
The best k of every task meet in one window per item, which Spark limits to k rows a task first.

Bounds: a block of items has at most ``BLOCK_TERMS`` distinct terms (or is a single item) and is broadcast;
a benchmark beyond that takes one pass over the texts per block.  Evaluation broadcasts at most
``ITEM_TERMS`` terms of items at once.

Defined results.  Null, empty or wordless documents have no terms: they count for nothing and are never
found.  Items without terms find nothing.  Null ids stay null and come last among equal scores.  Repeated
rows of either table are rows of their own.  Texts of any length are split piece by piece.  Lengths
whose product with N leaves 64 bits are divided as exact integers.  Empty tables: no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, batch, remove, slices, store, table

K = 10
BLOCK_TERMS = 1_000_000
ITEM_TERMS = 4_000_000
SHARD_POSTINGS = 4_000_000
PIECE_BYTES = 8 << 20
# ASCII letters and digits and all bytes of other characters belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def pieces(text: bytes):
    """The terms of a UTF-8 text in lists, none from much more than ``PIECE_BYTES``."""
    folded = text.translate(FOLD)
    if len(folded) <= PIECE_BYTES:
        yield folded.split()
        return
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def item_terms(items: DataFrame) -> DataFrame:
    """item (a row number), item_id, terms: the distinct terms of each item that has some."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def work(batches):
        for b in slices(batches):
            terms = [sorted(set().union(*pieces(t))) if t else [] for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), terms)

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "item long, item_id long, terms array<binary>").filter("size(terms) > 0")


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def count_terms(docs: DataFrame, known) -> DataFrame:
    """doc_id, n (terms with repeats), and of the known terms their numbers and occurrences."""

    def work(batches):
        number = known.value
        size = len(number)
        for b in slices(batches):
            n, doc, found = [], [], []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                total = 0
                for words in pieces(text or b""):
                    total += len(words)
                    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    ids = ids[ids >= 0]
                    found.append(ids)
                    doc.append(np.full(len(ids), i, dtype=np.int64))
                n.append(total)
            keys, tf = np.unique(np.concatenate(doc) * size + np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            begins = np.searchsorted(keys, np.arange(b.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(begins), pa.array(x.astype(np.int32))) for x in (keys % max(size, 1), tf)]
            yield batch(_COUNTS, b.column(0), n, *lists)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n long, terms array<int>, tf array<int>")


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: counted per task first; ``size`` numbers, whatever the input."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def work(batches):
        n = np.zeros(size, dtype=np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(n)
        yield batch(schema, some.astype(np.int32), n[some])

    rows = counts.select("terms").mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


def length_norms(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """m of each document: 100 - 90 + ((90 * n * N) div L)."""
    if len(n) and 90 * int(n.max()) * total_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * total_docs // total_terms for x in n], dtype=np.int64)
    return 10 + 90 * n * total_docs // total_terms


class Shard:
    """The inverted index over some documents: per term the documents in order and their impacts."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, vocabulary: int):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs = len(sizes)
        self.doc = doc[order]
        tf = tf[order].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        self.begins = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        some = np.flatnonzero(np.diff(self.begins))
        self.most = np.zeros(vocabulary, dtype=np.int64)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.begins[some])

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with exact scores.  ``terms``: rarest first, ``weight``: theirs.
        Documents below ``floor`` aren't wanted."""
        bounds = weight * self.most[terms]
        use = np.flatnonzero(bounds)
        terms, weight = terms[use], weight[use]
        left = np.concatenate([np.cumsum(bounds[use][::-1])[::-1], [0]])  # what this term and those after it can add
        score, least, alive = np.zeros(self.docs, dtype=np.int64), floor, None
        for i, (t, w) in enumerate(zip(terms.tolist(), weight.tolist())):
            doc, impact = self.doc[self.begins[t] : self.begins[t + 1]], self.impact[self.begins[t] : self.begins[t + 1]]
            if alive is None and left[i] < least:
                alive = np.flatnonzero(score)
            if alive is None:
                score[doc] += w * impact
                if left[i + 1] < score.max():
                    least = max(least, kth(score, k))
            else:
                alive = alive[score[alive] + left[i] >= least]
                if not len(alive):
                    break
                at = np.searchsorted(doc, alive)
                at[at == len(doc)] = 0
                hit = doc[at] == alive
                score[alive[hit]] += w * impact[at[hit]]
                least = max(least, kth(score[alive], k))
        found = np.flatnonzero(score) if alive is None else alive
        found = found[score[found] >= max(least, 1)]
        return found, score[found]


def kth(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the least documents, null ids last."""
    return np.lexsort((doc, null, -score))[:k]


def shards(batches, most: int):
    """Documents of Arrow batches in lists of columns with at most ``most`` postings (one document at least)."""
    held, size = [], 0
    for b in batches:
        counts = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        start = 0
        while start < b.num_rows:
            fit = int(np.searchsorted(np.cumsum(counts[start:]), most - size, side="right"))
            if fit or not held:
                fit = max(fit, 1)
                held.append(b.slice(start, fit))
                size += int(counts[start : start + fit].sum())
                start += fit
            if start < b.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_FOUND = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])


def evaluate(counts: DataFrame, queries, weight, k: int, total_docs: int, total_terms: int, most: int) -> DataFrame:
    """The k best documents of each item within each task."""

    def work(batches):
        items, w = queries.value, weight.value
        top = {}  # per item: scores, ids and null marks of its best documents so far
        for t in shards(batches, most):
            doc = t.column(0).combine_chunks()
            null = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy()
            lists, tf = t.column(2).combine_chunks(), t.column(3).combine_chunks()
            m = length_norms(t.column(1).to_numpy(), total_docs, total_terms)
            shard = Shard(pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(), tf.flatten().to_numpy(), m, len(w))
            for item, terms in items:
                so_far = top.get(item)
                floor = int(so_far[0][-1]) if so_far and len(so_far[0]) == k else 0
                found, score = shard.search(terms, w[terms], k, floor)
                if len(found):
                    rows = (score, ids[found], null[found])
                    if so_far:
                        rows = tuple(map(np.concatenate, zip(so_far, rows)))
                    keep = best(*rows, k)
                    top[item] = tuple(x[keep] for x in rows)
        for item, (score, doc, null) in top.items():
            yield batch(_FOUND, np.full(len(score), item), score, pa.array(doc, mask=null))

    return counts.filter("size(terms) > 0").mapInArrow(work, "item long, score long, doc_id long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, item_terms_at_once: int = ITEM_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = store(item_terms(items), "search-items")
    distinct, total = asked.select(F.explode("terms").alias("t")).agg(F.countDistinct("t"), F.count("*")).first()
    blocks = 1 if distinct <= block_terms else -(-total // block_terms)
    parts = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        words = own.select(F.explode("terms").alias("t")).distinct().toArrow().column("t").to_pylist()
        if not words:
            continue
        number = {w: i for i, w in enumerate(sorted(words))}
        known = spark.sparkContext.broadcast(number)
        counts = store(count_terms(docs, known), "search-counts", "zstd")
        total_docs, total_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not total_terms:
            continue
        df = document_frequencies(counts, len(number))
        weight = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        weights = spark.sparkContext.broadcast(weight)
        rounds = -(-int(own.agg(F.sum(F.size("terms"))).first()[0]) // item_terms_at_once)
        for r in range(rounds):
            queries = []
            for item, terms in own.filter(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(rounds)) == r).select("item", "terms").toLocalIterator():
                ids = np.array([number[bytes(t)] for t in terms], dtype=np.int64)
                queries.append((item, ids[np.lexsort((ids, df[ids]))]))  # rarest first
            if queries:
                parts.append(store(evaluate(counts, spark.sparkContext.broadcast(queries), weights, k, total_docs, total_terms, shard_postings), "search-found"))
        remove(counts)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_ranked_search": op12_ranked_search}
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op12_ranked_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
total AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d),
asked AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(terms) AS term FROM i)),
tf AS (SELECT doc, doc_id, n, term, count(*) AS tf
       FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM asked) GROUP BY doc, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
s AS (SELECT item, item_id, doc, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
      FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY item, item_id, doc, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
}
