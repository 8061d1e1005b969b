"""Benchmark decontamination: BM25 with block-max WAND, then overlap checks.

Test items are indexed (inverted lists of BM25 impacts, cut into blocks of items with
each list's largest impact per block) and every passage of every document is a
query.  Passages are windows of ``WINDOW`` words, ``STRIDE`` apart, so a run of up
to ``WINDOW - STRIDE`` words lies in one whole.  An item's impacts are divided by
its own full score, so one threshold holds for all items.  Items of more than ``PART`` words
are indexed as overlapping parts of ``PART`` words too, each with its own full score: a copied part
lies in one passage whole, so an item of any length is retrieved by its parts.  For each passage the
block maxima of its words are added up per block; blocks whose bound is
under the threshold are skipped, in the others exact scores are computed, and every
item at or above the threshold is retrieved (nothing is cut off by rank).  A
retrieved item counts as leaked into a document when runs of ``SHINGLE`` words of its question
part and of its answer part are found in the document in the shares asked for.  The answer
of an item is what follows its first question mark, or else its last sentence; an item of one
sentence, or with an answer of one word, is all question.  Words are compared in lower case A-Z.

The index is split into shards of ``SHARD_ITEMS`` items, so a broadcast shard is
bounded; every passage goes through every shard.  Documents are scanned in place: only
hits are shuffled.

Defined results.  Null or empty text: no leaks.  Items that are null, empty or have no word: ignored;
repeated items: each counts.  Parts of fewer than nine words: shorter runs.  Very long documents: read
whole, as windows.  Null ids pass through.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table
from .kernels import window_hashes, word_hashes

WINDOW, STRIDE = 128, 64
PART = WINDOW - STRIDE
THRESHOLD = 0.45
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.5
SHINGLE = 5
BLOCK_ITEMS = 16
SHARD_ITEMS = 5_000
K1, B = 1.2, 0.75


def run_length(n: int) -> int:
    """Words in the runs that a part of ``n`` words is compared by: shorter ones for short parts,
    so that one word glued to its neighbour in the document doesn't hide the part."""
    return max(1, min(SHINGLE, (n + 1) // 2))


def shingles(words: np.ndarray) -> np.ndarray:
    return np.unique(window_hashes(words, run_length(len(words)))) if len(words) else np.zeros(0, np.uint64)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item's text."""
    at = text.find("?")
    if 0 <= at and len(text[at + 1 :].split()) > 1:
        return text[: at + 1], text[at + 1 :]
    body = text.rstrip()
    at = max(body[:-1].rfind(mark) for mark in (". ", "! ", "\n", "? ")) if len(body) > 1 else -1
    return (body[: at + 1], body[at + 1 :]) if at > 0 and len(body[at + 1 :].split()) > 1 else (body, "")


class Index:
    """Block-max inverted index of one shard of items."""

    def __init__(self, items: list[tuple]):
        hash_of = lambda texts: word_hashes(pa.array(texts, pa.string()), lower=True)
        words, rows = hash_of([t for _, t in items])
        has = np.diff(rows) > 0
        self.items = [x for x, h in zip(items, has) if h]
        words, rows = hash_of([t for _, t in self.items])
        n = len(self.items)
        parts = [split_item(t) for _, t in self.items]
        self.parts, self.runs = [], []  # of the questions, of the answers
        for texts in zip(*parts) if parts else ((), ()):
            w, r = hash_of(list(texts))
            self.parts.append([shingles(w[a:b]) for a, b in zip(r[:-1], r[1:])])
            self.runs.append([run_length(int(k)) for k in np.diff(r)])
        size = np.diff(rows)
        self.vocabulary, which = np.unique(words, return_inverse=True)
        pairs = np.unique(which * max(n, 1) + np.repeat(np.arange(n), size))
        df = np.bincount(pairs // max(n, 1), minlength=len(self.vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        # what is retrieved: every item whole, then the parts of long ones
        spans = [(k, int(rows[k]), int(rows[k + 1])) for k in range(n)]
        for k, a, b in spans[:n]:
            if b - a > PART:
                spans += [(k, x, x + PART) for x in (*range(a, b - PART, PART // 2), b - PART)]
        self.owner = np.array([k for k, _, _ in spans], dtype=np.int64)
        self.n_units = len(spans)
        length = np.array([b - a for _, a, b in spans], dtype=np.int64)
        flat = np.concatenate([which[a:b] for _, a, b in spans]) if spans else which
        keys, tf = np.unique(flat * max(self.n_units, 1) + np.repeat(np.arange(self.n_units), length), return_counts=True)
        term, item = keys // max(self.n_units, 1), keys % max(self.n_units, 1)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / (size.mean() if n else 1)))
        full = np.bincount(item, weights=impact, minlength=self.n_units)
        self.impact = (impact / full[item]).astype(np.float32)
        self.item = item
        self.begins = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.n_blocks = -(-self.n_units // BLOCK_ITEMS)
        self.bound = np.zeros((len(self.vocabulary) + 1, self.n_blocks), dtype=np.float32)  # last row: words no item has
        np.maximum.at(self.bound, (term, item // BLOCK_ITEMS), self.impact)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words in the vocabulary; its size for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def candidates(self, words: np.ndarray, threshold: float) -> set[int]:
        """Items that some window of one document reaches the threshold for."""
        if not self.items or not len(words):
            return set()
        terms = self.terms(words)
        known = terms < len(self.vocabulary)
        places = np.flatnonzero(known)
        if not len(places):
            return set()
        found: set[int] = set()
        starts = np.arange(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)
        # bounds of all windows: running sums of the block maxima of the words that items have
        sums = np.concatenate([np.zeros((1, self.n_blocks)), np.cumsum(self.bound[terms[places]], axis=0, dtype=np.float64)])
        a, b = np.searchsorted(places, starts), np.searchsorted(places, starts + WINDOW)
        bound = sums[b] - sums[a]
        for w in np.flatnonzero((bound >= threshold - 1e-6).any(axis=1)):
            own = np.unique(terms[places[a[w] : b[w]]])
            # words count once in the exact score; the bound above counted each time
            open_ = self.bound[own].sum(axis=0) >= threshold - 1e-6
            if not open_.any():
                continue
            lo, hi = self.begins[own], self.begins[own + 1]
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = at[open_[self.item[at] // BLOCK_ITEMS]]
            score = np.bincount(self.item[at], weights=self.impact[at], minlength=self.n_units)
            found.update(self.owner[np.flatnonzero(score >= threshold - 1e-6)].tolist())
        return found

    def leaks(self, words: np.ndarray, threshold: float, question: float, answer: float):
        """(item, question share, answer share) of the items that leaked into a document."""
        found = self.candidates(words, threshold)
        if not found:
            return
        runs: dict[int, np.ndarray] = {}

        def share(part: np.ndarray, n_words: int) -> float:
            if n_words not in runs:
                runs[n_words] = np.unique(window_hashes(words, n_words))
            own = runs[n_words]
            return len(np.intersect1d(part, own, assume_unique=True)) / len(part) if len(part) else 1.0

        for k in sorted(found):
            q, a = (share(self.parts[i][k], self.runs[i][k]) for i in (0, 1))
            if q >= question and a >= answer:
                yield k, q, a


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_SHARE, answer: float = ANSWER_SHARE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), item_id, question_share, answer_share of each leak."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    n = items.count()
    shards = n // shard_items + 1
    dealt = store(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("question_share", pa.float64()), ("answer_share", pa.float64())])
    out = None
    for shard in range(shards):
        # a shard of test items is a bounded part of a stated query set
        index = Index([tuple(r) for r in dealt.filter(F.col("shard") == shard).select("item_id", "text").orderBy("item_id", "text").collect()])
        shared = spark.sparkContext.broadcast(index)

        def work(batches, shared=shared):
            index = shared.value
            for b in slices(batches):
                words, offsets = word_hashes(b.column(1), lower=True)
                found = []
                for i, (doc, key) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                    found += [(doc, key, index.items[k][0], q, a) for k, q, a in index.leaks(words[offsets[i] : offsets[i + 1]], threshold, question, answer)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * 5, schema)], schema=schema)

        part = rows.mapInArrow(work, "doc_id long, text_key long, item_id long, question_share double, answer_share double")
        out = part if out is None else out.unionByName(part)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE: dict[str, str] = {}
