"""Quality rules: tokeniser fertility with rejection bands per language.

Every word of a text is encoded with a public byte-fallback vocabulary.  Three
measures follow: characters per token, the share of byte-fallback tokens, and the
entropy of the text's token distribution in bits.  A text of at least
``min_tokens`` tokens is rejected when a measure leaves the band of its language
(script classes serve languages without a band).  The bands of the first and the
last narrow as texts grow, as short texts vary more.  The usual characters per token
and their spread are measured over all documents that pass the base rules, per language
and length class; ``BANDS`` serves classes of fewer than ``LEAST_DOCS`` documents.  Texts in
Latin letters may have as many characters per token as ordinary prose has, whatever is usual.  Words are encoded one by one,
each with the vocabulary's word-start mark, so a bounded cache of words does most
of the work.

The base rules come first: word and symbol counts, repeated lines, and words in
8-word windows that occur twice or more; a text with fewer than 20 words, or more
than 30 % of its words in repeated windows, fails.

Defined results.  Null or empty text: all counts 0, fails, not kept.  Null or
unknown language: the band of the text's prevailing script.  Texts are whole,
however long.  Repeated rows are all returned.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, slices, store, table
from .kernels import text_buffer, window_hashes, word_hashes

WINDOW = 8
SYMBOLS = "#*$%&|<>"
CACHE_WORDS = 500_000
VOCABULARY = "piece_bpe_32k.model"

# Bands, a parameter.  Per language, or per script for languages without a band of their own: the
# usual characters per token, how much wider than usual the band is, the most byte share, and how much
# less entropy is allowed.  The usual values are the medians of the four languages' clean documents; they
# hold where too few documents of a length class are at hand to measure.
BANDS = {
    "en": (2.66, 1.0, 0.05, 0.0),
    "de": (2.65, 1.0, 0.05, 0.0),
    "fr": (2.38, 1.0, 0.05, 0.0),
    "es": (2.32, 1.0, 0.05, 0.0),
    "latin": (2.50, 4.0, 0.10, 0.5),
    "other": (1.50, 9.0, 0.95, 2.0),
}
# Characters per token may be that far below and above the usual: a + b / sqrt(tokens), times the width.
BELOW, ABOVE = (0.10, 6.5), (0.15, 8.0)
# Fewest documents of a group and length class (tokens doubling from 20 on) to measure the usual from, and how
# many standard deviations, by the lower quartile, the band reaches below it at least.
LEAST_DOCS, DEVIATIONS = 100, 5.0
# Ordinary English prose has 4.6 to 5.2 characters per token; so many in Latin letters are never too many, in long texts.
PROSE = 6.0
# Least entropy in bits at so many tokens, straight in log(tokens) between these.
FLOOR = ((20, 2.9), (70, 4.6), (150, 5.25), (300, 5.65), (630, 6.0), (2000, 6.3), (5000, 6.35))
MIN_TOKENS = 20

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, token_chars long, byte_tokens long, entropy double, script string, lang string, text_key long"
_OUT = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "token_chars", "byte_tokens")] + [("entropy", pa.float64()), ("script", pa.string()), ("lang", pa.string()), ("text_key", pa.int64())])


class WordIds(dict):
    """Token ids (as 16-bit bytes) by word hash; empties itself before it grows past its bound."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.array([self.model.IsByte(i) for i in range(self.model.vocab_size())])

    def learn(self, hashes: list[int], word) -> None:
        """Have the ids of the words with ``hashes`` at hand; ``word(k)`` gives the k-th as bytes."""
        new = [k for k, h in enumerate(hashes) if h not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(range(len(hashes)))
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            for k, ids in zip(part, self.model.encode([word(k).decode("utf-8", "replace") for k in part], num_threads=1)):
                self[hashes[k]] = array("H", ids).tobytes()


_MODELS: dict[str, WordIds] = {}  # a worker's, kept from task to task


def word_ids(path: str) -> WordIds:
    if path not in _MODELS:
        _MODELS[path] = WordIds(path)
    return _MODELS[path]


def repeated_words(words: np.ndarray, rows: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Per row, the words that lie in a window of ``size`` words found twice or more in that row."""
    counts = np.zeros(len(rows) - 1, dtype=np.int64)
    runs = window_hashes(words, size)
    if not len(runs):
        return counts
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = row_of[: len(runs)] == row_of[size - 1 :]
    keys = runs + row_of[: len(runs)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(whole)
    keys = keys[at]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return counts
    spot = np.searchsorted(twice, keys)
    hit = at[twice[np.minimum(spot, len(twice) - 1)] == keys]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + size, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return covered[rows[1:]] - covered[rows[:-1]]


def token_measures(ids: WordIds, words: np.ndarray, rows: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: tokens, byte-fallback tokens, entropy of the token distribution in bits."""
    n = len(rows) - 1
    if not len(words):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
    hashes = distinct.tolist()
    ids.learn(hashes, lambda k: parts[first[k]])
    found = [ids[h] for h in hashes]
    codes = np.frombuffer(b"".join(found), dtype=np.uint16)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
    begins = np.cumsum(lengths) - lengths
    each = lengths[which]
    ends = np.concatenate([[0], np.cumsum(each)])
    flat = codes[np.repeat(begins[which] - ends[:-1], each) + np.arange(ends[-1])]
    bounds = ends[rows]
    n_tokens = np.diff(bounds)
    n_bytes = np.diff(np.concatenate([[0], np.cumsum(ids.byte_ids[flat])])[bounds])
    row_of = np.repeat(np.arange(n, dtype=np.int64), n_tokens)
    keys = np.sort(row_of << 16 | flat)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(edge, len(keys)))
    owner = keys[edge] >> 16
    share = counts / n_tokens[owner]
    return n_tokens, n_bytes, np.bincount(owner, weights=-share * np.log2(share), minlength=n)


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def script_of(raw: bytes) -> str:
    """``latin`` if most of the letters' bytes are below U+0250, else ``other``."""
    high = np.frombuffer(raw, dtype=np.uint8)
    return "latin" if not len(high) or np.count_nonzero(high >= 0xCA) * 2 < np.count_nonzero((high < 0x80) | (high >= 0xC0)) else "other"


def features(docs: DataFrame, model_path: str) -> DataFrame:
    """The measures of every document, with its language.  ``docs`` has doc_id, text, lang."""
    rows = docs.select(*(F.col(n).cast(t).alias(n) for n, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))), F.xxhash64(F.col("text").cast("string")).alias("text_key"))

    def work(batches):
        ids = word_ids(model_path)
        for b in slices(batches):
            column = b.column(1)
            words, offsets = word_hashes(column)
            data, bounds = text_buffer(column)
            raws = [data[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            parts = [w for raw in raws for w in raw.split()]
            n_tokens, n_bytes, entropy = token_measures(ids, words, offsets, parts)
            texts = [t or "" for t in column.to_pylist()]
            chars = [len(t) - sum(map(t.count, " \t\n\r\x0b\x0c")) for t in texts]
            n_words = np.diff(offsets)
            yield batch(
                _OUT, b.column(0), n_words, chars, [sum(map(t.count, SYMBOLS)) for t in texts], [duplicate_lines(t) for t in texts], repeated_words(words, offsets),
                n_tokens, chars + n_words, n_bytes, entropy, [script_of(raw) for raw in raws], b.column(2), b.column(3),
            )

    return rows.mapInArrow(work, FEATURES)


def fertility_rules(docs: DataFrame, model_path: str, bands: dict | None = None, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Features, base_failed and kept of every document.  ``docs`` has doc_id, text, lang."""
    bands = bands or BANDS
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    got = store(features(docs, model_path), "fertility")
    named = [k for k in bands if k not in ("latin", "other")]
    group = F.when(F.col("lang").isin(named) & (F.col("script") == "latin"), F.col("lang")).otherwise(F.col("script"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in bands.items() for x in (k, float(v[i]))]), group)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n = F.greatest("n_tokens", F.lit(1))
    per_token, wide = F.col("token_chars") / n, pick(1)
    got = got.withColumn("_group", group).withColumn("_class", F.floor(F.log2(n / min_tokens)))
    measured = got.filter((F.col("n_tokens") >= min_tokens) & ~failed).groupBy("_group", "_class").agg(F.percentile_approx(per_token, [0.25, 0.5], 1000).alias("_q"), F.count("*").alias("_n"))
    got = got.join(F.broadcast(measured.filter(F.col("_n") >= LEAST_DOCS).drop("_n")), ["_group", "_class"], "left")
    usual = F.coalesce(F.get("_q", F.lit(1)), pick(0))
    below = F.greatest(wide * F.greatest(usual / pick(0), F.lit(1.0)) * (BELOW[0] + BELOW[1] / F.sqrt(n)), F.coalesce(DEVIATIONS / 0.6745 * (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))), F.lit(0.0)))
    most = F.greatest(usual + wide * (ABOVE[0] + ABOVE[1] / F.sqrt(n)), F.when(F.col("script") == "latin", PROSE + ABOVE[1] / F.sqrt(n)).otherwise(F.lit(0.0)))
    floor = F.lit(float(FLOOR[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(FLOOR, FLOOR[1:]))):
        floor = F.when(n < x1, y0 + (y1 - y0) / math.log(x1 / x0) * F.log(n / x0)).otherwise(floor)
    outside = (F.col("n_tokens") >= min_tokens) & (
        (per_token < usual - below) | (per_token > most)
        | (F.col("byte_tokens") / n > pick(2)) | (F.col("entropy") < floor - pick(3))
    )
    return got.withColumn("chars_per_token", per_token).withColumn("base_failed", failed).withColumn("kept", ~failed & ~outside).drop("_group", "_class", "_q")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return fertility_rules(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_tokens", "entropy"
    )


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE: dict[str, str] = {}
