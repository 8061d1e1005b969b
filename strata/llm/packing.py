"""Packing: documents into token sequences by lexical retrieval.

A document's token ids end with id 0.  Runs of ``length`` ids are sequences of
their own; what is left of each document (fewer than ``length`` ids) is packed.
Left-overs are dealt to shards by their most characteristic tokens (range
partitioning on their two rarest tokens, then on the ids' checksum and the
document, so a key or a group of copies of any size is split evenly).  A task
builds the BM25 inverted index over all left-overs of its shard, takes the next unused
document as seed, retrieves unused neighbours by score from the whole shard, and
greedily fills the seed's window with those that fit; the best neighbour that doesn't
fit is cut to close the window and its rest stays unused.  Scores are exact: tokens in
more than one in ``DENSE`` left-overs are rows of a matrix, multiplied for several seeds
at once, and the others have posting lists.  The end of a partition is closed with
sequences of a power of two.  So no id is padding.  A partition of more than twice
``shard_tokens`` ids, which sampled ranges may give, is worked off as several shards.

Document frequencies of tokens are counted over all left-overs; the table has one
entry per vocabulary id, which bounds the broadcast.

Texts are encoded whole (``tokens``).

Defined results.  Null or empty text: the single id 0.  Null doc_id: kept, as null.
Repeated rows are packed separately.  Very long texts: cut every ``length`` ids.
Empty table: no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table
from .tokens import whole_text

LENGTH = 1024
VOCABULARY = "byte_bpe_50k.json"
VOCABULARY_SIZE = 50257
DENSE = 8
SEEDS, SEED_SCORES = 64, 4_000_000
SHARD_TOKENS = 1_500_000
RANKS = "byte_bpe_50k.tiktoken"
K1, B = 1.2, 0.75
_CUT = "doc_id long, start long, doc_tokens long, sequence_id long, ids binary"
_CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("ids", pa.binary())])


def cut(docs: DataFrame, path: str, length: int, ranks: str | None = None) -> DataFrame:
    """Full runs of ids with their sequence, and left-overs without one (ids in 16 bits)."""

    def work(batches):
        model, number = whole_text(path, ranks), TaskContext.get().partitionId() << 34
        for b in slices(batches, 2 << 20):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = model.encode(text or "").tobytes() + b"\0\0"
                n = len(ids) // 2
                full = n // length * length
                for start in range(0, full, length):
                    rows.append((doc, start, n, number, ids[2 * start : 2 * (start + length)]))
                    number += 1
                if n > full:
                    rows.append((doc, full, n, None, ids[2 * full :]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT_ARROW)], schema=_CUT_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _CUT)


def token_frequencies(rest: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Left-overs that hold each id, over all of them: ``size`` numbers, whatever the input."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def work(batches):
        n = np.zeros(size, dtype=np.int64)
        for b in batches:
            for ids in b.column(0):
                n[np.unique(np.frombuffer(ids.as_buffer(), np.uint16))] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], schema=schema)

    rows = rest.select("ids").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out, int(out[0])


class Shard:
    """Unused documents of a shard and the BM25 inverted index over them."""

    def __init__(self, docs: list[dict], idf: np.ndarray):
        m = len(docs)
        lengths = np.array([len(d["ids"]) for d in docs])
        flat = np.concatenate([d["ids"] for d in docs]).astype(np.int64)
        keys, tf = np.unique(flat * m + np.repeat(np.arange(m), lengths), return_counts=True)
        term, doc = (keys // m).astype(np.int32), (keys % m).astype(np.int32)
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        by_doc = np.argsort(doc, kind="stable")
        self.terms = term[by_doc]  # of each document
        self.doc_begins = np.searchsorted(doc[by_doc], np.arange(m + 1))
        # common tokens: the matrix has at most DENSE times as many cells as the shard has postings
        common = np.bincount(term, minlength=len(idf)) * DENSE > m
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        dense = common[term]
        self.matrix = np.zeros((int(common.sum()), m), dtype=np.float32)
        self.matrix[self.row[term[dense]], doc[dense]] = weight[dense]
        self.doc, self.weight = doc[~dense], weight[~dense]
        self.begins = np.searchsorted(term[~dense], np.arange(len(idf) + 1))
        self.left = lengths.copy()  # ids not used yet
        self.total = int(lengths.sum())
        self.m = m
        self.ready: dict[int, np.ndarray] = {}  # scores of the next seeds by common tokens

    def own(self, seed: int) -> np.ndarray:
        return self.terms[self.doc_begins[seed] : self.doc_begins[seed + 1]]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        if seed not in self.ready:
            seeds = seed + np.flatnonzero(self.left[seed:])[: max(1, min(SEEDS, SEED_SCORES // self.m))]
            asked = np.zeros((len(seeds), len(self.matrix)), dtype=np.float32)
            for i, k in enumerate(seeds.tolist()):
                rows = self.row[self.own(k)]
                asked[i, rows[rows >= 0]] = 1
            self.ready = dict(zip(seeds.tolist(), asked @ self.matrix))
        terms = self.own(seed)
        terms = terms[self.row[terms] < 0]
        a, b = self.begins[terms], self.begins[terms + 1]
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ready[seed] + np.bincount(self.doc[at], weights=self.weight[at], minlength=self.m)

    def window(self, seed: int, length: int) -> list[tuple[int, int]] | None:
        """(document, ids taken) that fill a window around the seed; None if the unused ones can't."""
        if self.total < length:
            return None
        room = length - int(self.left[seed])
        out = [(seed, int(self.left[seed]))]
        if room:
            score = self.scores(seed)
            unused = np.flatnonzero(self.left)
            unused = unused[unused != seed]
            fit = unused
            while room:
                fit = fit[self.left[fit] <= room]
                if not len(fit):
                    break
                best = first_by_score(score[fit], 256)
                for d, n in zip(fit[best].tolist(), self.left[fit[best]].tolist()):
                    if n <= room:
                        out.append((d, n))
                        room -= n
                fit = np.delete(fit, best)
            if room:
                unused = unused[~np.isin(unused, [d for d, _ in out])]
                out.append((int(unused[score[unused].argmax()]), room))
        for d, n in out:
            self.left[d] -= n
        self.total -= length
        return out


def first_by_score(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first; of equal ones the first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        some = np.sort(np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]]))
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")]


_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _piece(doc: dict, n: int, sequence: int, offset: int) -> tuple:
    """The next ``n`` unused ids of a document."""
    at = doc["used"]
    doc["used"] += n
    return doc["doc_id"], doc["start"] + at, n, doc["ids"][at : at + n].astype("<u4").tobytes(), doc["doc_tokens"], sequence, offset


def pack_docs(docs, idf: np.ndarray, length: int, first_sequence: int, most_tokens: int = 2 * SHARD_TOKENS):
    """Pieces of an iterator of left-overs, in lists; every document wholly used."""
    sequence, waiting, held = first_sequence, [], 0

    def fill(final: bool):
        nonlocal sequence, waiting, held
        shard, out = Shard(waiting, idf), []
        for seed in range(shard.m):
            if shard.left[seed]:
                window = shard.window(seed, length)
                if window is None:
                    break
                offset = 0
                for d, n in window:
                    out.append(_piece(waiting[d], n, sequence, offset))
                    offset += n
                sequence += 1
        rest = [d for d, n in zip(waiting, shard.left.tolist()) if n]
        if final:
            total = sum(len(d["ids"]) - d["used"] for d in rest)
            k = 0
            while total:  # sequences of the powers of two that add up to what is left
                size = 1 << (total.bit_length() - 1)
                total -= size
                offset = 0
                while offset < size:
                    n = min(size - offset, len(rest[k]["ids"]) - rest[k]["used"])
                    out.append(_piece(rest[k], n, sequence, offset))
                    offset += n
                    k += rest[k]["used"] == len(rest[k]["ids"])
                sequence += 1
            rest = []
        else:  # an unused tail is a document of its own in the next shard
            rest = [d if not d["used"] else {**d, "ids": d["ids"][d["used"] :], "start": d["start"] + d["used"], "used": 0} for d in rest]
        waiting, held = rest, shard.total
        return out

    for doc in docs:
        waiting.append(doc)
        held += len(doc["ids"])
        if held >= most_tokens:
            yield fill(False)
    if waiting:
        yield fill(True)


def pack(docs: DataFrame, path: str, length: int = LENGTH, vocabulary: int = VOCABULARY_SIZE, shard_tokens: int = SHARD_TOKENS, ranks: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids (32 bits each, little-endian), doc_tokens, sequence_id, offset."""
    if vocabulary > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    runs = store(cut(docs, path, length, ranks), "pack-runs", "zstd")
    rest = runs.filter("sequence_id IS NULL").drop("sequence_id")
    df, n = token_frequencies(rest, vocabulary)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shards = int(rest.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // (2 * shard_tokens) + 1
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    keyed_schema = pa.schema([*[f for f in _CUT_ARROW if f.name != "sequence_id"], ("key1", pa.int32()), ("key2", pa.int32()), ("mark", pa.int64())])

    def characteristic(batches):
        idf = shared.value
        for b in batches:
            keys = []
            for ids in b.column(3):
                raw = ids.as_buffer()
                own = np.frombuffer(raw, np.uint16)
                weight = idf[own]
                rarest = own[weight.argmax()]
                weight[own == rarest] = -1
                keys.append((int(rarest), int(own[weight.argmax()]), zlib.crc32(raw)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(zip(*keys) if keys else ((), (), ()), list(keyed_schema)[4:]))], schema=keyed_schema)

    order = ["key1", "key2", "mark", "doc_id", "start"]
    keyed = rest.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(characteristic, "doc_id long, start long, doc_tokens long, ids binary, key1 int, key2 int, mark long")
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def fill(batches):
        idf = shared.value

        def docs():
            for b in batches:
                for doc, start, total, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                    yield {"doc_id": doc, "start": start, "doc_tokens": total, "ids": np.frombuffer(ids, np.uint16), "used": 0}

        for rows in pack_docs(docs(), idf, length, 1 << 62 | TaskContext.get().partitionId() << 34, 2 * shard_tokens):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, _PIECE_ARROW)], schema=_PIECE_ARROW)

    def widen(batches):
        for b in batches:
            ids = pa.array([np.frombuffer(x.as_buffer(), np.uint16).astype("<u4").tobytes() for x in b.column(4)], pa.binary())
            size = pa.array(np.full(b.num_rows, length), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, ids, b.column(2), b.column(3), pa.array(np.zeros(b.num_rows, np.int64))], schema=_PIECE_ARROW)

    full = runs.filter("sequence_id IS NOT NULL").select("doc_id", "start", "doc_tokens", "sequence_id", "ids").mapInArrow(widen, _PIECE)
    return full.unionByName(dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(fill, _PIECE))


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces_digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ranks=public_tokenizers.path(RANKS)))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
