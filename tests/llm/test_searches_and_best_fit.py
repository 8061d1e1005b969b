"""Hard negatives, ranked search and best-fit packing against plain versions, on rows with every odd case."""

import bisect
import collections
import math
import re
import zlib

import numpy as np
import pytest

from strata.llm import best_fit, hard_negatives, ranked_search, tokens

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# ---- ranked search


def plain_search(docs, items, k):
    """docs, items: (id, text).  Rows (item place, rank, doc_id, score) by full scoring."""
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    N, L = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        found = []
        for d, c, n in counts:
            m, score = 10 + 90 * n * N // L, 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(place, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def some_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É1", "naïve", "東京", "A", "a-b"]
    p = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())) for _ in range(n)]


@pytest.fixture(scope="module")
def library(spark):
    texts = some_texts(300, 1)
    rows = list(enumerate(texts)) + [(400, None), (401, ""), (402, " ,;\x00 "), (7, texts[7]), (7, texts[7]), (500, texts[9]), (None, texts[9]), (501, texts[9].upper()), (600, "w1 w2 rare " * 5000)]
    items = [(i, t) for i, t in enumerate(some_texts(25, 2))] + [(90, None), (91, "..."), (1, texts[9]), (1, texts[9]), (None, "rare W3"), (92, "nowhere")]
    frames = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS score"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id", "0 AS rank")
    return rows, items, *frames


def by_place(rows):
    """Rows (item_id, rank, doc_id, score) in an order that repeated items share."""
    return sorted(rows, key=str)


@pytest.mark.parametrize("limits", [{}, {"shard_postings": 40}, {"block_terms": 20, "item_terms_at_once": 30}])
def test_ranked_search_is_full_scoring(library, limits):
    rows, items, docs, bench = library
    want = by_place((items[p][0], r, d, s) for p, r, d, s in plain_search(rows, items, 10))
    got = ranked_search.ranked_search(docs.repartition(5), bench, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert by_place(tuple(r) for r in got.collect()) == want


def test_ranked_search_empty_tables(library):
    _, _, docs, bench = library
    assert ranked_search.ranked_search(docs.limit(0), bench).count() == 0
    assert ranked_search.ranked_search(docs, bench.limit(0)).count() == 0


def test_accumulators_are_limited_and_survivors_exact():
    rng = np.random.default_rng(3)
    docs, vocabulary = 3000, 40
    has = rng.random((docs, vocabulary)) < 1 / np.arange(1, vocabulary + 1)
    tf = np.where(has, rng.integers(1, 9, has.shape), 0)
    doc, term = np.nonzero(tf)
    m = rng.integers(10, 400, docs)
    shard = ranked_search.Shard(tf.astype(bool).sum(1), term, tf[doc, term], m, vocabulary)
    weight = np.arange(vocabulary) * 150 + 20
    impact = np.where(tf > 0, 10**9 * tf // (1000 * tf + 8 * m[:, None]), 0)
    for _ in range(20):
        asked = np.sort(rng.choice(vocabulary, 12, replace=False))[::-1]  # heavy weights first
        full = impact[:, asked] @ weight[asked]
        least = np.sort(full)[-10]
        found, score = shard.search(asked, weight[asked], 10, 0)
        assert np.array_equal(score, full[found]) and set(np.flatnonzero(full >= max(least, 1))) == set(found.tolist())
        none, _ = shard.search(asked, weight[asked], 10, int(full.max()) + 1)
        assert not len(none)


def test_terms_of_long_texts(monkeypatch):
    text = " ".join(some_texts(40, 5)) + "\x00x" * 50
    whole = terms(text)
    monkeypatch.setattr(ranked_search, "PIECE_BYTES", 64)
    assert [w.decode() for part in ranked_search.pieces(text.encode()) for w in part] == whole


def test_lengths_beyond_64_bits():
    n = np.array([5, 10**9], dtype=np.int64)
    assert ranked_search.length_norms(n, 10**12, 3 * 10**14).tolist() == [10 + 90 * x * 10**12 // (3 * 10**14) for x in (5, 10**9)]


# ---- hard negatives


def plain_negatives(rows):
    kept = []
    for v, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        shifted = int(math.fmod(label + 1, 10)) if v is not None and v % 7 == 0 else label
        kept.append((v, [math.floor(256 * c) for c in x], shifted))
    out = []
    for i, (v, x, label) in enumerate(kept):
        if v is None or v % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), w is None, w or 0, j, w, other == label) for j, (w, y, other) in enumerate(kept) if j != i]
        scored.sort()
        for p in [s for s in scored if s[5]][:5]:
            fit = [s for s in scored if not s[5] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(v, p[4], r, s[4], -p[0], -s[0]) for r, s in enumerate(fit[:3], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 20))
    rows = []
    for i in range(700):
        x = centres[i % 6] * rng.random() + rng.normal(size=20) * 0.4
        rows.append((i, [float(np.float32(c)) for c in x / np.linalg.norm(x)], int(rng.integers(0, 4))))
    same = rows[33][1]
    rows += [(1000 + i, same, i % 2) for i in range(40)]  # ties
    rows += [(50, rows[50][1], rows[50][2]), (None, same, 1), (None, rows[0][1], 2), (2000, [], 1), (2050, [], 1), (2100, [0.5, 0.25], 3), (2101, None, 1), (2102, [float("nan")] * 20, 1)]
    rows += [(2103, [None] + same[1:], 1), (2104, [float("-inf")] * 20, 1), (2105, same, None), (2150, [-c for c in same], 0), (2107, same, -5), (2114, [c * 900 for c in same], -5)]
    return rows


@pytest.mark.parametrize("options", [{}, {"anchor_bytes": 3000}])
def test_hard_negatives_are_those_of_all_pairs(spark, vectors, options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS row", "'s' AS score", "0 AS is_anchor").repartition(4)
    got = hard_negatives.hard_negatives(df, **options)
    want = plain_negatives([(v, None if x is None else [None if c is None else float(np.float32(c)) for c in x], n) for v, x, n in vectors])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 60
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_hard_negatives_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(empty).count() == 0


def test_hard_negatives_huge_components(spark):
    rows = [(50, [1e30, 1.0], 1), (51, [-1e30, 2.0], 1), (52, [3.0, 4.0], 2), (53, [1e6, -1e6], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.collect() == []  # windows of the positives hold no score, and nothing overflows


def random_block(rng, n, scale):
    v = np.floor(rng.normal(size=(n, 64)) * scale).astype(np.int32)
    return hard_negatives.Block(np.arange(n), np.arange(n), np.ones(n, bool), np.zeros(n, np.int64), v, *hard_negatives.summaries(v))


@pytest.mark.parametrize("scale", [1, 40, 30_000])
def test_bounds_hold_and_tighten(scale):
    rng = np.random.default_rng(6)
    a, b = random_block(rng, 40, scale), random_block(rng, 60, scale)
    score = a.vectors.astype(np.int64) @ b.vectors.T.astype(np.int64)
    i, j = np.nonzero(np.ones(score.shape))
    widths = []
    for level in range(len(hard_negatives.SEGMENTS)):
        low, high = hard_negatives.bounds(level, a, b, i, j)
        assert (low <= score[i, j]).all() and (score[i, j] <= high).all()
        few = slice(0, 20)  # the sparse way gives the same
        assert np.allclose(hard_negatives.bounds(level, a, b, i[few], j[few])[0], low[few], rtol=1e-4, atol=scale * scale * 1e-3)
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] < 0.8 * widths[0]


def test_windows_in_whole_numbers():
    s = np.array([0, 1, 2, 3, 19, 20, 21, 65502, 1 << 61, -7])
    assert hard_negatives.at_most(s, 95).tolist() == [95 * int(x) // 100 for x in s] and hard_negatives.at_least(s, 50).tolist() == [-(-50 * int(x) // 100) for x in s]


# ---- best fit


def best_fit_decreasing(sizes, length):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else length
        n += gap == length
        if gap > s:
            bisect.insort(gaps, gap - s)
    return n


def sizes_of(kind):
    rng = np.random.default_rng(8)
    if kind == "mixed":
        return np.r_[rng.integers(1, 2048, 3000), rng.integers(1, 60, 2000), np.full(2500, 700), np.full(100, 2047)]
    if kind == "tiny":
        return rng.integers(1, 9, 4000)
    return rng.integers(1025, 2048, 2000)  # none fits another


@pytest.mark.parametrize("kind", ["mixed", "tiny", "large"])
@pytest.mark.parametrize("range_rows", [900, 100_000])
def test_places_are_gapless_and_few(spark, kind, range_rows):
    sizes = sizes_of(kind)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "number long, size long")
    placed = best_fit.place(items, 2048, range_rows).collect()
    assert sorted(p.number for p in placed) == list(range(len(sizes)))
    by = collections.defaultdict(list)
    for p in placed:
        by[p.sequence].append((p.offset, int(sizes[p.number])))
    for own in by.values():
        own.sort()
        ends = [0] + [o + s for o, s in own]
        assert [o for o, _ in own] == ends[:-1] and ends[-1] <= 2048
    least = best_fit_decreasing(sizes.tolist(), 2048)
    assert len(by) == least if range_rows > len(sizes) else len(by) <= 1.02 * least + 2


def test_brackets_match_once():
    # ranges in order of falling size: (items, gaps) left over
    counts = {0: (2, 3), 1: (1, 0), 2: (4, 2), 3: (5, 1)}
    segments, opened, used = best_fit.bracket_match(counts, 3)
    got = {}
    for part, low, high, gap_part, rank in segments:
        for r in range(low, high):
            assert gap_part < part and (gap_part, rank - r + low) not in got.values()
            got[(part, r)] = (gap_part, rank - r + low)
    assert got == {(1, 0): (0, 2), (2, 0): (0, 1), (2, 1): (0, 0), (3, 0): (2, 1), (3, 1): (2, 0)}
    assert opened == [(0, 0, 2, 0), (2, 2, 3, 2)] and used == 3


def test_pieces_cover_every_document(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(best_fit.VOCABULARY))
    model.encode_special_tokens = True
    texts = [None, "", "   ", "One", "wörd " * 900, "été ñandú 東京  x y  z\n\nq ", "<|endoftext|> don't 12,5\tend\r\n", "x" * 5000, "a b\x1cc\x85d " * 700] + [" ".join(f"t{i * j}" for j in range(i * 7)) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS number", "'s' AS sequence", "0 AS length").repartition(3)
    out = best_fit.pack_best_fit(docs, public_tokenizers.path(best_fit.VOCABULARY), public_tokenizers.path(best_fit.RANKS), range_rows=40).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        for k, (start, end) in enumerate([(0, first)] + [(s, s + 2048) for s in range(first, len(ids), 2048)]):
            want[(d, k, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    fill = collections.defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert best_fit.pack_best_fit(docs.limit(0), public_tokenizers.path(best_fit.VOCABULARY), public_tokenizers.path(best_fit.RANKS)).count() == 0


def test_whole_text_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = tokens.WholeText(public_tokenizers.path(best_fit.VOCABULARY), public_tokenizers.path(best_fit.RANKS))
    model = Tokenizer.from_file(public_tokenizers.path(best_fit.VOCABULARY))
    model.encode_special_tokens = True
    rng = np.random.default_rng(10)
    ends = [0x80, 0x180, 0x240, 0x3000]
    for _ in range(600):
        chars = rng.integers(0, rng.choice(ends), rng.integers(0, 200)).tolist()
        text = "".join(rng.choice([" ", "  ", "\n", "'s ", "'LL", "12"]) if rng.random() < 0.2 else chr(c) for c in chars)
        assert own.encode(text).tolist() == model.encode(text, add_special_tokens=False).ids
