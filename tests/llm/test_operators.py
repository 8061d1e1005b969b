"""Each operator against a plain version of it, or an exact round trip, on small rows with every odd case."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest

import strata.llm.queries as registered
from strata.llm import decontaminate, elias_fano, fertility, html_text, jaccard_join, line_dedup, lm_scoring, packing, tokens, tool_calls, url_filters, warc

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in rng.integers(0, 500, n))


def odd_texts():
    base = prose(1, 300)
    words = base.split()
    near = " ".join(["changed"] + words[1:])
    return [None, "", "   ", "One", base, base, near, base.upper(), prose(2, 90), prose(3, 4000), "a b c d e " * 40, "été ñandú 東京 \u00a0x\u2028y  z\n\nq ", "<|endoftext|> don't 12,5\tend\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(odd_texts())] + [(4, odd_texts()[4], "en", "x"), (None, prose(9, 60), None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, item_id string")


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 120
    rows = [(5, "http://a/", big), (2, "http://b/", big), (2, "http://b/", big), (7, None, None), (8, "u\r\nv%41", "short"), (9, "u", "short"), (None, "u", big), (10, "é", "é" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", __import__("pyspark").sql.functions.lit(1))
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    kinds = collections.Counter((r.record_type, r.record_id, r.refers_to) for r in got)
    first = "<urn:strata:page:2>"
    assert kinds[("response", first, None)] == 2 and kinds[("revisit", "<urn:strata:page:5>", first)] == 1 and kinds[("revisit", "<urn:strata:page:null>", first)] == 1
    by = {r.record_id: r for r in got if r.record_type == "response"}
    assert bytes(by["<urn:strata:page:10>"].payload).decode() == "é" * 300 and by["<urn:strata:page:8>"].target_uri == "u\r\nv%41" and by["<urn:strata:page:7>"].payload_bytes == 0


def test_warc_long_and_damaged_records():
    long = os.urandom(1 << 20) * 17
    one = warc.member("response", 1, "u", long, __import__("hashlib").sha256(long).hexdigest(), None, "d", 1)
    assert one[-1] == 0
    two = warc.member("response", 2, "u", b"body", "0" * 64, None, "d", 6)
    got = list(warc.archive_records(one + two + one[:1000]))
    assert [(r or {}).get("payload_bytes") for _, r, _ in got][:1] == [len(long)]
    assert "payload digest differs" in got[1][2] and any("ends inside" in (e or "") for _, _, e in got)


def test_html_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>"
        '<div class="cookie-notice"><p>We use cookies to make this long sentence look like content, really.</p></div><article><h1>Head &amp; line</h1>'
        "<p><b>First<br> paragraph&nbsp;with   space.<p>Tiny.<aside><p>Side text that is quite long and has a full stop at the end.</p></aside><!-- c <p>no</p> -->"
        '<script>var x="</p>"</script><p>Last one of all.</article><section id="comments"><p>I am a reader and I disagree with all of this, by far.</p></section>'
        "<form><label>Search</label></form><footer>&copy; all rights</footer></body>"
    )
    assert html_text.main_text(page) == "Head & line\n\nFirst paragraph with space.\n\nTiny.\n\nLast one of all."
    assert html_text.main_text(None) == "" and html_text.main_text("<p") == "" and html_text.main_text("<div>" * 3000) == ""


def test_min_cut_is_least():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = 7
        scores = rng.normal(size=n).round(2).tolist()
        edges = [(a, b, round(float(rng.random()), 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda kept: sum(abs(c) for c, k in zip(scores, kept) if (c > 0) != k) + sum(w for a, b, w in edges if kept[a] != kept[b])
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(scores, edges)) == pytest.approx(least)


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://X.Example.NET/en/1?q#f", "https://example.net/en", "http://a.net", "http://a.net/", "http://net/x", "http://badexample.com/de/", "ftp://shop.example.com/de/x", "http://org/fr/", "http://a.org/fr", "x://h?a/b"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    rules = spark.createDataFrame([*url_filters.RULES, ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")

    def plain(url):
        host, path = ("", "") if not url or "://" not in url else re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        host = lower(host)
        fits = [r for r in url_filters.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, "allow"))
        return host, path, best[0] and best[0] + best[1], best[2]

    got = url_filters.url_verdicts(pages, rules).collect()
    assert len(got) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id]) for r in got)
    assert {r.verdict for r in url_filters.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


def test_packing_round_trip(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    path = P.path(packing.VOCABULARY)
    plain, fast = tokens.WholeText(path, None), tokens.WholeText(path, P.path(packing.RANKS))
    texts = [t or "" for t in odd_texts()]
    want = [plain.model.encode(t, add_special_tokens=False).ids for t in texts]
    for model in (plain, fast):
        assert [model.encode(t).tolist() for t in texts] == want
    pieces = packing.pack(docs, path, length=128, ranks=P.path(packing.RANKS)).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        seq[p.sequence_id].append((p.offset, p.length))
    for i, ids in enumerate(want):
        parts = sorted(by[i])
        copies = 2 if i == 4 else 1
        assert sum(len(x) for _, x, _ in parts) == copies * (len(ids) + 1) and {n for _, _, n in parts} == {len(ids) + 1}
        if copies == 1:
            assert [x for _, part, _ in parts for x in part] == ids + [0]
    for spans in seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 128 or at & (at - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_finds_neighbours_in_the_whole_shard():
    rng = np.random.default_rng(8)
    size, n = 20_000, 700
    own = rng.permutation(np.arange(100, size))[: n * 20].reshape(n, 20)
    texts = [np.concatenate([own[k % n], rng.integers(1, 100, 44)]).astype(np.uint16) for k in range(2 * n)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=size)
    idf = np.log1p((2 * n - df + 0.5) / (df + 0.5))
    docs = lambda: [{"doc_id": k, "start": 0, "doc_tokens": 64, "ids": t, "used": 0} for k, t in enumerate(texts)]
    together = collections.defaultdict(list)
    for piece in (p for some in packing.pack_docs(iter(docs()), idf, 128, 0) for p in some):
        together[piece[5]].append(piece[0])
    assert sorted(sorted(v) for v in together.values()) == [[k, k + n] for k in range(n)]
    shard = packing.Shard(docs(), idf)  # scores are those of plain BM25
    for seed in (0, 5, 900):
        want = np.zeros(2 * n)
        for d, t in enumerate(texts):
            for term in set(t.tolist()) & set(texts[seed].tolist()):
                tf = int((t == term).sum())
                want[d] += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1)
        assert np.allclose(shard.scores(seed), want, rtol=1e-4)


def test_line_dedup(spark):
    rng = np.random.default_rng(4)
    line = lambda: prose(int(rng.integers(1 << 30)), 12)
    shared = [line() for _ in range(12)]
    texts = ["\n".join([line() for _ in range(k)] + shared + [line() for _ in range(3)]) for k in range(1, 6)] + [None, "", "\n".join(line() for _ in range(9)), shared[0], "\n".join(shared)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(df).collect()}
    new = {i: t for i, t in got}
    assert len(got) == len(texts) and new[0] == texts[0] and new[5] is None and new[6] == "" and new[7] == texts[7] and new[8] == texts[8]
    for i in range(1, 5):  # all of the passage goes, and nothing else
        assert new[i].split("\n") == [x for x in texts[i].split("\n") if x not in shared]
    assert new[9] == ""
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_short_passages(spark):
    rng = np.random.default_rng(6)
    line = lambda n: prose(int(rng.integers(1 << 30)), n)
    first, second, want = [], [], []
    for lines in (1, 2, 3, 4, 5, 6) * 8:
        passage = [line(51 if lines == 1 else 26 if k % 2 == 0 else 8) for k in range(lines)]
        before, after, other = ([line(20)] for _ in range(3))
        first.append("\n".join(before + passage + after))
        second.append("\n".join(other + passage + [line(20)]))
        want.append("\n".join(x for x in second[-1].split("\n") if x not in passage))
    # many short lines, a run at the edge of a text, a short single line, and blank lines
    tiny = [f"t{k} {line(1)}" for k in range(40)]
    first += ["\n".join([line(20)] + tiny + [line(20)]), "\n".join(["a " + line(25), "b", "c"]), "same short line\n" + line(20), "\n" * 70 + line(9)]
    second += ["\n".join(tiny + [line(20)]), "\n".join([line(30)] + first[-3].split("\n")), line(20) + "\nsame short line", "\n" * 70 + line(9)]
    want += [second[-4].split("\n")[-1], second[-3].split("\n")[0], second[-2], second[-1]]
    df = spark.createDataFrame(list(enumerate(first + second)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert [got[i] for i in range(len(first))] == first
    assert [got[len(first) + i] for i in range(len(second))] == want


def runs_that_go(texts, min_chars=60):
    """Per document the lines that belong to a run of two lines or more, ``min_chars`` long, standing at an earlier place too."""
    places = collections.defaultdict(list)
    for d, t in enumerate(texts):
        lines = t.split("\n")
        for i in range(len(lines) - 1):
            k, size = 0, 0
            while i + k < len(lines) and (k < 2 or size < min_chars):
                size += len(lines[i + k].strip())
                k += 1
            if k >= 2 and size >= min_chars:
                places[tuple(lines[i : i + k])].append((d, i))
    gone = collections.defaultdict(set)
    for run, at in places.items():
        for d, i in at[1:]:
            gone[d].update(range(i, i + len(run)))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_equals_all_runs(spark):
    """Borders by content against every run of lines, on texts put together from few lines."""
    rng = np.random.default_rng(12)
    pool = [prose(k, int(rng.integers(7, 16))) for k in range(60)]
    texts = []
    for _ in range(150):
        own = [prose(int(rng.integers(1 << 30)), 9) for _ in range(int(rng.integers(1, 5)))]
        at = int(rng.integers(0, 50))
        texts.append("\n".join(own + pool[at : at + int(rng.integers(0, 8))] + own[::-1] + [str(x) for x in rng.choice(pool, 3)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.text for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()]
    assert got == runs_that_go(texts) and got != texts


def test_line_dedup_borders_shift_with_the_content(spark):
    """Borders follow the lines: an insertion moves those behind it and changes none; thin lines get one in three at least."""
    from pyspark.sql import functions as F

    def borders(lines):
        df = spark.createDataFrame([(lines,)], "l array<string>")
        used = F.transform("l", lambda x, i: i)
        sizes = F.transform("l", lambda x: F.length(x))
        return df.select(line_dedup.borders_of(F.col("l"), used, sizes, 24)).first()[0]

    thin = [f"w{k * k}" for k in range(90)]
    plain, shifted = borders(thin), borders(["new", "lines"] + thin)
    assert {b + 2 for b in plain if b > 4} == {b for b in shifted if b > 6}
    assert max(b - a for a, b in zip(plain, plain[1:])) <= 4 and len(plain) < 70
    assert borders(["a line of some thirty characters"] * 4) == [0, 1, 2, 3, 4]


def test_line_dedup_thin_runs_and_taken_names(spark):
    rng = np.random.default_rng(13)
    thin = [f"x{int(v)}" for v in rng.integers(0, 10**6, 300)]  # 300 lines of a few characters, blank ones between
    run = "\n\n".join(thin)
    texts = [prose(1, 30) + "\n" + run + "\n" + prose(2, 30), prose(3, 30) + "\n" + run + "\n" + prose(4, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 AS n_lines", "8 AS N_removed_lines")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "N_removed_lines", "n_lines_", "n_removed_lines_"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == texts[0] and (got[0].n_lines, got[0]["n_lines_"], got[0]["n_removed_lines_"]) == (7, 601, 0)
    assert got[1].text == prose(3, 30) + "\n" + prose(4, 30) and got[1]["n_removed_lines_"] == 599


def test_components_of_paths_stars_and_cycles(spark):
    from strata.llm.components import components

    rng = np.random.default_rng(14)
    links = [(int(a), int(a) + 1) for a in range(1000, 1200)] + [(5, int(b)) for b in range(300, 360)] + [(7, 8), (8, 9), (9, 7), (7, 7), (40, 40)]
    links += [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (500, 2))]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_scores(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = [(i, WORDS.findall(lower(t)) + [None]) for i, t in rows]
    U, B = collections.Counter(), collections.Counter()
    for i, ws in tokens:
        if not lm_scoring.held_out(i):
            U.update(ws)
            B.update(zip([0] + ws, ws))
    N, V, D = sum(U.values()), len(U), lm_scoring.DISCOUNT
    C, K = collections.Counter(), collections.Counter()
    for (h, _), n in B.items():
        C[h] += n
        K[h] += 1
    got = lm_scoring.lm_scores(docs, block_tokens=500, shard_pairs=300).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(list)
    for i, ws in tokens:
        uni = [(U[w] + 0.1) / (N + 0.1 * (V + 1)) for w in ws]
        full = [max(B[(h, w)] - D, 0) / C[h] + D * K[h] / C[h] * p if C[h] else p for h, w, p in zip([0] + ws, ws, uni)]
        want[i].append((len(ws), sum(U[w] > 0 for w in ws), sum(map(math.log10, uni)), sum(map(math.log10, full))))
    for r in got:
        n, known, base, score = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, N, lm_scoring.held_out(r.doc_id))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-3)
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, 1 << 40, 500).astype(np.uint64))
    ef = elias_fano.EliasFano.load(elias_fano.EliasFano.build(values, 1 << 40).dump())
    assert (ef.at(np.arange(500)) == values).all()
    x = np.concatenate([values, values + np.uint64(1), np.array([0, (1 << 40) - 1], np.uint64)])
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), 500)
    assert (ef.successor(x, lo, hi) == np.searchsorted(values, x)).all()
    trie = elias_fano.Trie.build(np.array([9, 9, 9, 3], np.uint64), np.array([1, 1, 2, 1], np.uint32), np.array([2, 1, 1, 0], np.uint32), 0.75)
    file = tmp_path / "trie"
    file.write_bytes(trie.dump())
    trie = elias_fano.Trie.load(np.memmap(file, dtype=np.uint8, mode="r"))
    code, back = trie.lookup(np.array([9, 9, 9, 3], np.uint64), np.array([1, 2, 5, 1], np.uint32))
    assert elias_fano.dequantise(code) == pytest.approx([2.25 / 4, 0.25 / 4, 0, 0], rel=1e-3)
    assert elias_fano.dequantise(back) == pytest.approx([1.5 / 4] * 3 + [1], rel=1e-3)


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>, tool string, arguments string")


def test_tool_calls(spark):
    rows = [(1, "a", None, "f", '{"y": 2, "x": "s"}'), (1, "b", ["a"], "f", '{"x":1}'), (1, "c", ["a", "b", "zz"], "g", "{}"), (1, "d", ["c"], "f", "not json"), (2, "p", ["q"], "f", '{"x":""}'), (2, "q", ["p"], "f", None), (3, "a", None, "f", '{"y": 2, "x": "s"}'), (4, None, None, "f", "{}"), (5, "self", ["self"], "f", "[1]")]
    rows += [(6, f"n{k}", [f"n{k - 1}"] if k else None, "f", '{"x":"","z":{"b":1,"a":[ 1 ]}}') for k in range(40)]
    # another conversation with the same identifiers, a third without a number
    rows += [(9, "b", None, "f", '{"x":"nine"}'), (9, "c", ["b"], "f", '{"x":"nine"}'), (None, "b", ["c"], "f", '{"x":"none"}'), (None, "c", None, "f", '{"x":"none"}')]
    results = spark.createDataFrame([(1, "a", "ok"), (1, "a", "again"), (1, "ghost", "r"), (1, None, "r"), (9, "c", "r9"), (None, "b", "rn")], "conv_id long, call_id string, content string").selectExpr("*", "'x' AS depth")
    schemas = spark.createDataFrame([("f", "x", "STRING", True), ("f", "y", "BIGINT", False), ("f", "z", "OBJECT", False)], "tool string, param string, type string, required boolean")
    linked = tool_calls.link_tool_calls(calls(spark, rows), results, schemas).collect()
    own = {(r.conv_id, r.call_id): r for r in linked}
    assert len(linked) == len(own) == 9 + 40 + 4
    assert [(own[k].depth, own[k].status, own[k].content) for k in ((9, "b"), (9, "c"), (None, "c"), (None, "b"))] == [(0, "unanswered", None), (1, "linked", "r9"), (0, "unanswered", None), (1, "linked", "rn")]
    assert own[(3, "a")].status == "unanswered" and own[(3, "a")].n_copies == 1
    got = {c: r for (v, c), r in own.items() if v in (1, 2, 5, 6)}
    assert [got[k].depth for k in "abcd"] == [0, 1, 2, 3] and all(got[f"n{k}"].depth == k for k in range(40))
    assert {got[k].status for k in ("p", "q", "self")} == {"cycle"} and got["ghost"].status == "orphan_result" and got["a"].status == "linked" and got["b"].status == "unanswered"
    assert (got["a"].n_copies, got["a"].n_results, got["a"].content, got["c"].n_unknown_deps) == (1, 2, "again", 1)
    assert got["a"].arguments == '{"x":"s","y":2}' and got["n1"].arguments == '{"x":"","z":{"a":[1],"b":1}}'
    assert (got["a"].valid, got["b"].errors, got["c"].errors, got["d"].errors, got["q"].errors, got["self"].errors) == (True, "type:x", "unknown_tool", "not_an_object", "not_an_object", "not_an_object")
    assert tool_calls.link_tool_calls(calls(spark, []), results.limit(0), schemas).count() == 0


def test_quality_rules(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    got = fertility.fertility_rules(docs, P.path(fertility.VOCABULARY)).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        text = texts[r.doc_id]
        words = WORDS.findall(text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_ordinary_prose_is_kept(spark):
    P = pytest.importorskip("public_tokenizers")
    with open(os.path.join(os.path.dirname(P.path(fertility.VOCABULARY)), "LICENSES.txt"), encoding="utf-8") as lines:
        text = " ".join(lines.read().split())
    clean = [text[a : a + n] for n in (400, 1500, 6000) for a in (2500, 5000)]
    rng = np.random.default_rng(3)
    junk = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz0189#"), 7)) for _ in range(400)) for _ in range(3)]
    # clean texts of 100 and more in one length class move their language's band
    usual = [text[a : a + 1500] for a in range(0, 11000, 45)]
    vowels = [" ".join("".join(rng.choice(list("bdklmnrst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(160))]
    kept = lambda texts: [r.kept or r.base_failed for r in fertility.fertility_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), P.path(fertility.VOCABULARY)).orderBy("doc_id").collect()]
    assert kept(clean + junk) == [True] * len(clean) + [False] * len(junk)
    got = kept(usual + vowels)
    assert got == [True] * len(usual) + [False]


def test_jaccard_classes(spark):
    rng = np.random.default_rng(5)
    texts = odd_texts()
    for size in (6, 30, 200):  # chains of edits, around the similarity
        words = prose(size, size).split()
        for k in range(40):
            for _ in range(int(rng.integers(0, 1 + size // 40)) + (k % 3 == 0)):
                words[int(rng.integers(size))] = f"n{rng.integers(1000)}"
            texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, set string")
    for size, percent in ((4, 85), (5, 80)):
        sets = []
        for t in texts:
            w = WORDS.findall(lower(t))
            sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
        root = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = [new if r == old else r for r in root]
        got = {r.doc_id: r for r in jaccard_join.jaccard_classes(df, size, percent).collect()}
        assert [got[i].component_id for i in range(len(texts))] == root
        assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0


def test_leaks(spark, docs):
    items = [(1, "Which river? The long blue one there."), (2, prose(7, 30) + ". Final answer words."), (3, None), (4, ""), (5, prose(8, 40))]
    text = items[1][1].upper()
    rows = [(1, prose(11, 700) + " " + text + "*** " + prose(12, 300)), (2, prose(13, 800)), (3, None), (4, ""), (5, "so Which river? The long blue one there. yes"), (None, items[4][1]), (7, prose(7, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1, 100):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, frame, shard_items=shard).collect()} == {(1, 2), (5, 1), (None, 5)}
    assert decontaminate.leaks(df, frame.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), frame).count() == 0


def test_long_items_are_found_whole():
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    items = [(k, text(n) + ". " + text(12)) for k, n in enumerate([20, 60, 90, 150, 400, 500, 1000, 3000] * 3)]
    index = decontaminate.Index(items)
    for k, item in items:
        words = decontaminate.word_hashes(__import__("pyarrow").array([text(37 + k) + " " + item + " " + text(300)]), lower=True)[0]
        assert [x for x, _, _ in index.leaks(words, decontaminate.THRESHOLD, 0.6, 0.5)] == [k]


@has_data
def test_wand_finds_what_full_scoring_finds():
    items = [(i, prose(100 + i, 30)) for i in range(70)]
    index = decontaminate.Index(items)
    words = decontaminate.word_hashes(__import__("pyarrow").array([" ".join(items[3][1].split()[:20]) + " " + prose(55, 400)]), lower=True)[0]
    found = index.candidates(words, 0.3)
    terms, brute = index.terms(words), set()
    for s in range(0, max(1, len(words) - 64), 64):
        own = set(terms[s : s + 128].tolist()) - {len(index.vocabulary)}
        score = collections.Counter()
        for t in own:
            for at in range(index.begins[t], index.begins[t + 1]):
                score[int(index.item[at])] += float(index.impact[at])
        brute |= {k for k, v in score.items() if v >= 0.3 - 1e-6}
    assert found == brute and 3 in found


@has_data
def test_pipeline_and_registration(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0)], docs.schema))
    for some in (docs.limit(0), docs.union(odd)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, DATA)
            assert some.columns == docs.columns
            some = spark.createDataFrame(some.collect(), docs.schema)
        rows = corpus_pipeline.STAGES[-1][1](spark, some, DATA).collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in some.collect()}
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registered.QUERIES if k != "pipeline"}


def test_pipeline_keeps_one_of_a_class_with_null_ids(spark):
    import corpus_pipeline

    near = lambda seed: [prose(seed, 200), "changed " + prose(seed, 200), prose(seed, 200) + " changed"]
    a, b, c, d = (near(s) for s in (31, 32, 33, 34))
    rows = [(None, t) for t in a] + [(7, b[0]), (None, b[0]), (None, b[1])] + [(8, t) for t in c] + [(9, d[0]), (10, d[1]), (11, prose(35, 200)), (None, prose(36, 200)), (None, "  "), (None, None), (None, a[0])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, df, DATA).collect()]
    assert len(got) == len(set(got)) == 8
    assert sum(i is None and t in a for i, t in got) == 1 and sum(i == 8 and t in c for i, t in got) == 1
    assert {(7, b[0]), (9, d[0]), (11, rows[11][1]), (None, rows[12][1]), (None, "  "), (None, None)} <= set(got)
