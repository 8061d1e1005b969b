"""Language-model scoring with an Elias-Fano n-gram trie, sharded by context.

Training and scoring share one pass over the texts.  Each task encodes its
documents in blocks: distinct words, distinct (context, word) pairs with their
training counts, and the pair of every token.  Blocks send their distinct words and
pairs to shards; a shard adds up all counts, builds its trie, dumps it to a
flat buffer, opens that buffer memory-mapped, and answers the blocks' pairs by context-relative
successor search.  Blocks then add up log probabilities by document.  So what moves
is a block's distinct n-grams, and no task needs the whole model.

Model: interpolated absolute discounting, p(w | h) = max(c(hw) - D, 0) / c(h)
+ D N(h) / c(h) p(w), N(h) the distinct words after h, p(w) = (c(w) + 0.1) /
(N + 0.1 (V + 1)).  The discounted part and the weight of p(w) are kept as
16-bit codes.  The context of a first word is a start mark, which is no token.
Words within a context are told apart by 32 bits of their hash.

Defined results.  Null or empty text: one token, the end.  Null doc_id: counted as
``crc32('')``, so held out.  Repeated rows count as often as they occur.  Empty
table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import mmap
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table
from .elias_fano import Trie, dequantise
from .kernels import word_hashes

BLOCK_TOKENS = 2_000_000
SHARD_PAIRS = 1_000_000
DISCOUNT = 0.75
END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A2757A2757A275)

_BLOCK = "block long, doc_id binary, n_tokens binary, held binary, pair_of binary, words binary, word_count binary, contexts binary, context_size binary, pair_word binary, pair_count binary, n_pairs long"
_ARROW = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.binary()) for f in _BLOCK.split(", ")])


def pack24(values: np.ndarray) -> bytes:
    """Numbers below 2**24 in three bytes each, larger ones in four; all first bytes, then all second
    ones and so on, as high bytes that change little compress well."""
    values = values.astype("<u4")
    width = 4 if len(values) and values.max() >= 1 << 24 else 3
    return str(width).encode() + values.view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def unpack24(raw: bytes) -> np.ndarray:
    width = int(raw[:1])
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel()


def steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each document's values sorted, the first as it is and the others as steps from the one before."""
    values = values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]
    out = np.diff(values, prepend=0)
    begins = np.cumsum(sizes) - sizes
    out[begins] = values[begins]
    return out


def from_steps(out: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(out.astype(np.int64))
    begins = np.cumsum(sizes) - sizes
    return total - np.repeat(total[begins] - out[begins], sizes)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def encode_block(number: int, ids: list, words: np.ndarray, rows: np.ndarray) -> list:
    """One block: its documents' tokens as references to distinct pairs."""
    n = len(ids)
    sizes = np.diff(rows) + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(len(words) + n, dtype=np.uint64)
    inside = np.ones(len(tokens), dtype=bool)
    inside[ends] = False
    tokens[inside], tokens[ends] = words, END
    held = np.array([held_out(i) for i in ids], dtype=bool)
    train = np.repeat(~held, sizes)
    distinct, which = np.unique(tokens, return_inverse=True)
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = which[:-1] + 1
    before[ends[:-1] + 1] = 0
    before[0] = 0  # 0 is the start mark, k + 1 the distinct word k
    pairs, pair_of = np.unique(before * len(distinct) + which, return_inverse=True)
    context, size = np.unique(pairs // len(distinct), return_counts=True)
    keys = pa.array(ids, pa.int64())
    missing = np.array([i is None for i in ids], dtype=np.uint8)
    return [
        number, keys.fill_null(0).to_numpy().astype(np.int64).tobytes() + missing.tobytes(), sizes.astype(np.int64).tobytes(), held.tobytes(), pack24(steps(pair_of, sizes)), distinct.tobytes(),
        np.bincount(which, weights=train, minlength=len(distinct)).astype(np.uint32).tobytes(), pack24(context), pack24(size), pack24(pairs % len(distinct)),
        np.bincount(pair_of, weights=train, minlength=len(pairs)).astype(np.uint32).tobytes(), len(pairs),
    ]


def encode(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    def work(batches):
        number, ids, parts, total = TaskContext.get().partitionId() << 32, [], [], 0

        def block():
            words = np.concatenate([w for w, _ in parts])
            rows, base = [np.zeros(1, np.int64)], 0
            for w, r in parts:
                rows.append(r[1:] + base)
                base += len(w)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(encode_block(number, ids, words, np.concatenate(rows)), _ARROW)], schema=_ARROW)

        for b in slices(batches):
            w, r = word_hashes(b.column(1), lower=True)
            ids += b.column(0).to_pylist()
            parts.append((w, r))
            total += len(w) + b.num_rows
            if total >= block_tokens:
                yield block()
                number, ids, parts, total = number + 1, [], [], 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _BLOCK)


def _of(raw, kind) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind)


def _contexts(words: np.ndarray, raw: bytes) -> np.ndarray:
    """Hashes of a block's contexts: 0 stands for the start mark, k + 1 for the block's word k."""
    return np.concatenate([np.array([START]), words])[unpack24(raw)]


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, and where each shard begins in it."""
    shard = ((hashes >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _pair_tables(contexts: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Positions of the pairs when their contexts are put in ``order``."""
    begins = np.cumsum(size) - size
    sizes = size[order]
    ends = np.cumsum(sizes)
    return np.repeat(begins[order] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_SEND = "kind string, shard int, block long, keys binary, sizes binary, words binary, counts binary"


def requests(blocks: DataFrame, shards: int) -> DataFrame:
    """What each block asks each shard: words with counts, and contexts with their pairs."""
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64())] + [(n, pa.binary()) for n in ("keys", "sizes", "words", "counts")])

    def work(batches):
        for b in batches:
            for x in b.to_pylist():
                rows = []
                words, counts = _of(x["words"], np.uint64), _of(x["word_count"], np.uint32)
                order, at = _by_shard(words, shards)
                for s in range(shards):
                    part = order[at[s] : at[s + 1]]
                    if len(part):
                        rows.append(("word", s, x["block"], words[part].tobytes(), None, None, counts[part].tobytes()))
                contexts, size = _contexts(words, x["contexts"]), unpack24(x["context_size"]).astype(np.int64)
                order, at = _by_shard(contexts, shards)
                place = _pair_tables(contexts, size, order)
                succ, pair_counts = words[unpack24(x["pair_word"])[place]].astype(np.uint32), _of(x["pair_count"], np.uint32)[place]
                cut = np.concatenate([[0], np.cumsum(size[order])])
                for s in range(shards):
                    part = order[at[s] : at[s + 1]]
                    if len(part):
                        lo, hi = cut[at[s]], cut[at[s + 1]]
                        rows.append(("pair", s, x["block"], contexts[part].tobytes(), size[part].astype(np.uint32).tobytes(), succ[lo:hi].tobytes(), pair_counts[lo:hi].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.select("block", "words", "word_count", "contexts", "context_size", "pair_word", "pair_count").mapInArrow(work, _SEND)


_ANSWER = "block long, kind string, shard int, first binary, second binary, total long, distinct long"


def mapped(buffer: bytes) -> np.ndarray:
    """A dumped trie in memory-mapped pages, outside the Python heap."""
    pages = mmap.mmap(-1, max(1, len(buffer)))
    pages[: len(buffer)] = buffer
    return np.frombuffer(pages, dtype=np.uint8)


def answer_words(asked: pd.DataFrame) -> pd.DataFrame:
    keys = [_of(k, np.uint64) for k in asked["keys"]]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(which, weights=np.concatenate([_of(c, np.uint32) for c in asked["counts"]]), minlength=len(distinct)).astype(np.uint64)
    out, at = [], 0
    for k in keys:
        out.append(counts[which[at : at + len(k)]].tobytes())
        at += len(k)
    n, v = int(counts.sum()), int(np.count_nonzero(counts))
    first = np.arange(len(keys)) == 0
    return pd.DataFrame({"block": asked["block"], "kind": "word", "shard": asked["shard"], "first": out, "second": None, "total": np.where(first, n, 0), "distinct": np.where(first, v, 0)})


def answer_pairs(asked: pd.DataFrame, discount: float) -> pd.DataFrame:
    rows = [(_of(k, np.uint64), _of(s, np.uint32).astype(np.int64), _of(w, np.uint32), _of(c, np.uint32)) for k, s, w, c in zip(asked["keys"], asked["sizes"], asked["words"], asked["counts"])]
    trie = Trie.build(np.concatenate([np.repeat(k, s) for k, s, _, _ in rows]), np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]), discount)
    trie = Trie.load(mapped(trie.dump()))
    first, second = [], []
    for k, s, w, _ in rows:
        code, back = trie.lookup(np.repeat(k, s), w)
        first.append(code.tobytes())
        second.append(back[np.cumsum(s) - s].tobytes())
    return pd.DataFrame({"block": asked["block"], "kind": "pair", "shard": asked["shard"], "first": first, "second": second, "total": 0, "distinct": 0})


def lm_scores(docs: DataFrame, discount: float = DISCOUNT, block_tokens: int = BLOCK_TOKENS, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    blocks = store(encode(docs, block_tokens), "lm-blocks", "zstd")
    shards = int(blocks.agg(F.sum("n_pairs")).first()[0] or 0) // shard_pairs + 1

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        return answer_words(asked) if asked["kind"].iloc[0] == "word" else answer_pairs(asked, discount)

    sent = requests(blocks, shards).repartition(2 * shards, "kind", "shard")
    answers = store(sent.groupBy("kind", "shard").applyInPandas(answer, _ANSWER), "lm-answers", "zstd")
    n_train, n_distinct = (int(v or 0) for v in answers.agg(F.sum("total"), F.sum("distinct")).first())

    def score(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        x = block.iloc[0]
        words = _of(x["words"], np.uint64)
        contexts = _contexts(words, x["contexts"])
        sizes = _of(x["n_tokens"], np.int64)
        # the pairs of a document come sorted, as only sums over them are needed
        size, pair_word, pair_of = unpack24(x["context_size"]).astype(np.int64), unpack24(x["pair_word"]), from_steps(unpack24(x["pair_of"]), sizes)
        got = got.sort_values(["kind", "shard"])
        said = {k: g for k, g in got.groupby("kind")}
        order, _ = _by_shard(words, shards)
        count = np.empty(len(words), np.uint64)
        count[order] = np.concatenate([_of(v, np.uint64) for v in said["word"]["first"]])
        order, _ = _by_shard(contexts, shards)
        back = np.empty(len(contexts), np.uint16)
        back[order] = np.concatenate([_of(v, np.uint16) for v in said["pair"]["second"]])
        code = np.empty(len(pair_word), np.uint16)
        code[_pair_tables(contexts, size, order)] = np.concatenate([_of(v, np.uint16) for v in said["pair"]["first"]])
        single = (count + 0.1) / (n_train + 0.1 * (n_distinct + 1))
        both = dequantise(code) + np.repeat(dequantise(back), size) * single[pair_word]
        of = pair_word[pair_of]
        begins = np.cumsum(sizes) - sizes
        n = len(sizes)
        ids, missing = _of(x["doc_id"][: 8 * n], np.int64), _of(x["doc_id"][8 * n :], np.uint8)
        add = lambda v: np.add.reduceat(v, begins)
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64").copy() if not missing.any() else pd.array(np.where(missing, None, ids.astype(object)), dtype="Int64"),
            "held_out": _of(x["held"], bool), "n_tokens": sizes, "n_known": add((count > 0)[of].astype(np.int64)), "train_tokens": n_train,
            "base_score": add(np.log10(single)[of]), "score": add(np.log10(both)[pair_of]),
        })

    blocks = blocks.drop("word_count", "pair_count", "n_pairs")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLE: dict[str, str] = {}
