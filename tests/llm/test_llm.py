"""The training-data operators against brute force on small fixtures with the awkward cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlode.llm import backoff, blocks, bpe_count, components, line_rules, minhash, packing, quality, sp_sample, suffix, textops, topk_mih, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"
AWKWARD = [
    (-1, None), (-2, ""), (-3, "  a  b \n\n c<|endoftext|>x "), (-4, "▁ a▁ ▁b  \x00 \x1c q　z"), (-5, " "), (-6, "a " * 300), (-7, "a b\n" * 60),
    (-8, "don't  I'll\t\tx 😀😀 ́"), (-9, "▁"), (-10, "   lead\n trail   "), (-11, "x" * 5000), (-12, "One two.\n" * 3), (-13, "one TWO."), (-13, "one TWO."), (None, "no id"),
    (-14, "same text here with more than five words in it, and over fifty bytes."), (-15, "same text here with more than five words in it, and over fifty bytes."),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    rows = [(r.doc_id, r.text) for r in real.collect()] + AWKWARD
    # extra columns, with names that operators use themselves
    return spark.createDataFrame([(i, t, 1, "x", 0.5, 7, True) for i, t in rows], "doc_id long, text string, b int, p string, score double, id long, kept boolean").repartition(5)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def low(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))


def test_packing(spark, docs, texts):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in texts:
        ids, at = tk.encode(t, add_special_tokens=False).ids + [1], 0
        for n in packing.piece_lengths(len(ids)):
            want[d, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    out = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and 1 << r.bucket == r.length == len(r.ids) // 4 for r in out)
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 1000)


def test_piece_lengths():
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.piece_lengths(0) == []


def test_token_counts(spark, docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((d, len(t.encode()), n := len(sp.encode(t)), n > 20) for d, t in texts)
    assert Counter(map(tuple, bpe_count.count_tokens(docs, limit=20).collect())) == want
    assert bpe_count.count_tokens(empty(spark)).count() == 0


def test_line_rules(spark, docs, texts):
    want = Counter()
    for d, t in texts:
        w = WORD.findall(t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(win)
        rep = len({j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)] += 1
    out = line_rules.clean_lines(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert line_rules.clean_lines(empty(spark)).count() == 0


def test_line_verdicts(spark):
    lines = [("A sentence that ends well.", True), ("Home", False), ("Menu | Login | Search", False), ("All rights reserved.", False), ("BUY THIS NOW OR CRY.", False), ("", True), ("Heading", False), ("a line of many words that breaks in the", True), ("w*** x### y$$$ z.", False)]
    df = spark.createDataFrame(lines, "x string, want boolean")
    assert [r.got for r in df.select(line_rules.line_verdict(F.col("x")).alias("got")).collect()] == [w for _, w in lines]
    text = "Home | About | Help\n" + "\n".join(" ".join(f"plain{i}x{j}" for j in range(10)) + f" number {i}." for i in range(8))
    r = line_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.kept and "Home" not in r.clean_text and "number 7." in r.clean_text and 0 < r.lost < 0.2
    assert not any(c in str(line_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()) for c in ("Python", "Arrow", "Exchange"))


def test_segmentations(spark, docs, texts):
    out = sp_sample.sample_segmentations(docs, k=3).collect()
    marked = {d for d, t in texts if "▁" in t}
    assert marked and all(r.round_trip == (r.doc_id not in marked) for r in out)
    seen = Counter((r.doc_id, r.ids) for r in out)
    once = {d for d, n in Counter(d for d, _ in texts).items() if n == 1}
    assert all(n == 1 for (d, _), n in seen.items() if d in once)
    assert all(0 < r.inclusion <= 1 and r.log_prob <= 1e-9 for r in out)
    again = sp_sample.sample_segmentations(docs.repartition(2), k=3).collect()
    assert Counter(map(tuple, (r[:-1] for r in again))) == Counter(map(tuple, (r[:-1] for r in out)))
    by = dict(texts)
    got = {r.doc_id: r.text for r in sp_sample.decode(spark.createDataFrame([r for r in out if r.sample == 0 and r.doc_id in once])).collect()}
    assert all(got[d] == by[d].replace("▁", " ") for d in got)
    assert sp_sample.sample_segmentations(empty(spark)).count() == 0


def test_sampling_is_gumbel_top_k():
    lat = sp_sample.Lattices()

    def paths(unit):
        ptr, to, ids, cum, lp = lat.arrays()

        def go(s):
            if s < 0:
                yield (), 0.0
                return
            e = int(ptr[s])
            while True:
                for t, p in go(int(to[e])):
                    yield (int(ids[e]), *t), p + float(lp[e])
                if cum[e] >= 2:
                    return
                e += 1

        return dict(go(int(lat.starts([[unit]])[0][0])))

    full = {a + b: p + q for a, p in paths("▁the").items() for b, q in paths("▁on").items()}
    assert sum(map(math.exp, full.values())) == pytest.approx(1)
    n, first, total = 6000, Counter(), 0.0
    for got in sp_sample.top_k(lat, [(i, "the on") for i in range(n)], 3, 5):
        assert len({tuple(g[0]) for g in got}) == 3
        assert all(g[1] == pytest.approx(full[tuple(g[0])], abs=1e-9) for g in got)
        first[tuple(got[0][0])] += 1
        total += sum(math.exp(g[1]) / g[2] for g in got)
    best = max(full, key=full.get)
    assert first[best] / n == pytest.approx(math.exp(full[best]), abs=0.03)
    assert total / n == pytest.approx(1, abs=0.02)  # weights by inclusion are unbiased
    assert len(sp_sample.top_k(lat, [(1, "")], 3, 5)[0]) == 1


def test_near_duplicates(spark, docs):
    base = " ".join(f"w{i}" for i in range(120))
    near = [base.replace(f"w{i} ", f"q{i} ") for i in (3, 40, 41, 90)] + [base.replace("w5 ", "z ").replace("w60 ", "y ").replace("w100 ", "x ")]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([base, base.upper(), *near, *near])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, r.text or "") for r in both.where("doc_id is not null").collect()]
    sets = {}
    for d, t in rows:
        w = low(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(comp)
        for a in sets:
            for b in sets:
                both_ = len(sets[a] & sets[b])
                if both_ and 100 * both_ >= 85 * (len(sets[a]) + len(sets[b]) - both_):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    out = minhash.near_duplicates(both).collect()
    assert len(out) == both.count()
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], r.doc_id == comp[r.doc_id])
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_banding_follows_the_similarity():
    assert minhash.banding(85) == (30, 6) and minhash.banding(80) == (36, 5)
    for similar in (50, 70, 80, 85, 95):
        bands, rows = minhash.banding(similar)
        assert bands * rows <= minhash.PLACES and (1 - (similar / 100) ** rows) ** bands <= 1e-6
    rng = np.random.default_rng(6)
    for _ in range(300):  # Jaccard 800 / 1000
        x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = (minhash.band_hashes(minhash.signature(s), 36, 5) for s in (x[:900], x[100:]))
        assert (a == b).any()


def test_pipeline_links_from_80_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(204)]  # 200 shingles
    edited = ["q" if i in (20, 60, 100, 140) else w for i, w in enumerate(base)]  # 180 of 220 are shared: 0.818
    far = ["q" if i in (20, 50, 80, 110, 140) else w for i, w in enumerate(base)]  # 175 of 225: 0.778
    docs = spark.createDataFrame([(i + 100 * g, " ".join(f"{w}g{g}" for w in t)) for g in range(12) for i, t in enumerate([base, far if g == 11 else edited])], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {100 * g for g in range(12)} | {1101}
    assert minhash.near_duplicates(docs).where("kept").count() == 24


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(i, i + 1) for i in range(100, 130)]
    comp = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), textops.Rounds(spark)).collect()} == comp


@pytest.fixture(params=[None, 300])
def batch_bytes(request, monkeypatch):
    """One batch as in production for little text, and many small ones."""
    if request.param:
        monkeypatch.setattr(blocks, "BATCH_BYTES", request.param)


def test_batches_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BATCH_BYTES", 100)
    size = lambda *t: blocks.n_batches(spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string"))
    assert size() == size(None) == size("") == 1
    assert size("a" * 450) == 5 and size("a" * 4000) == 40


def test_repeated_strings(spark, batch_bytes, docs):
    more = spark.createDataFrame([(900, "z" * 49), (901, "z" * 49), (902, "q" + "é" * 60), (903, "é" * 55 + "q"), (904, "ab" * 80), (905, "c" + "ab" * 40), (906, "é" * 60)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, (r.text or "").encode()) for r in both.collect()]
    first = {}
    for d, b in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = Counter()
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()] += 1
    assert Counter(map(tuple, suffix.repeated(both).collect())) == want
    assert suffix.repeated(empty(spark)).count() == 0


def test_repeated_strings_across_the_steps_of_a_long_text(spark):
    rng = np.random.default_rng(5)
    noise = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    passage, step = noise(400), suffix.STEP
    one = noise(step - 200) + passage + noise(1000) + b"ab" * 300
    two = noise(500) + passage[:333] + noise(step - 900) + b"ba" * 200 + passage[77:] + noise(60)
    rows = [(2, one), (5, two), (5, passage[10:300]), (9, passage[11:60] + noise(3) + b"b" + b"ab" * 25)]
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, len(b), sum(gone), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    made = spark.createDataFrame([(d, b.decode()) for d, b in rows], "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.repeated(made).collect()]
    assert Counter(got) == Counter(want) and want[1][2] > 700 and want[3][2] == 51


def test_backoff(spark, batch_bytes, docs, texts):
    words = [low(t) for _, t in texts]
    c1, c2, n = Counter(), Counter(), sum(map(len, words))
    for w in words:
        c1.update(w)
        c2.update(zip(w, w[1:]))
    want = []
    for (d, _), w in zip(texts, words):
        o1, o2, s, pairs, singles = Counter(w), Counter(zip(w, w[1:])), 0.0, 0, 0
        for i, x in enumerate(w):
            c = c2[w[i - 1], x] - o2[w[i - 1], x] if i else 0
            back = math.log(0.4) if i else 0.0
            if c > 0:
                s, pairs = s + math.log(c / (c1[w[i - 1]] - o1[w[i - 1]])), pairs + 1
            elif c1[x] > o1[x]:
                s, singles = s + back + math.log((c1[x] - o1[x]) / (n - len(w))), singles + 1
            else:
                s += back + math.log(0.4) - math.log(n - len(w) + 1)
        want.append((d, len(w), pairs, singles, round(s, 6)))
    got = [(r.doc_id, r.n_words, r.n_pairs_seen, r.n_words_seen, round(r.log_score, 6)) for r in backoff.lm_scores(docs).collect()]
    assert Counter(got) == Counter(want)
    assert backoff.lm_scores(empty(spark)).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_backoff_of_higher_order(spark, batch_bytes, docs, texts, order):
    words = [low(t) for _, t in texts]
    runs = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    all_, n = sum(map(runs, words), Counter()), sum(map(len, words))
    want = []
    for (d, _), w in zip(texts, words):
        own, s, seen = runs(w), 0.0, Counter()
        for i in range(len(w)):
            k, back = min(order, i + 1), 0.0
            while k and all_[g := tuple(w[i - k + 1 : i + 1])] == own[g]:
                k, back = k - 1, back + math.log(0.4)
            seen[k] += 1
            under = all_[g[:-1]] - own[g[:-1]] if k > 1 else n - len(w)
            s += back + (math.log((all_[g] - own[g]) / under) if k else -math.log(n - len(w) + 1))
        want.append((d, len(w), *(seen[k] for k in range(order, 0, -1)), round(s, 6)))
    got = [(*r[:-1], round(r.log_score, 6)) for r in backoff.lm_scores(docs, order=order).collect()]
    assert Counter(got) == Counter(want) and any(x[2] for x in want)


def test_topk(spark):
    rng = np.random.default_rng(8)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 63), 1 << 63, 150))] + [(1000 + i, 12345) for i in range(30)] + [(2000, None), (None, 5), (0, None)]
    df = spark.createDataFrame(codes, "id long, code long")
    real = [(i, c) for i, c in codes if i is not None and c is not None]
    want = {(i, r + 1, j, d) for i, c in real for r, (d, j) in enumerate(sorted((bin((c ^ e) & (2**64 - 1)).count("1"), j) for j, e in real)[:7])}
    assert {tuple(r) for r in topk_mih.nearest(df, df, 7).collect()} == want
    assert topk_mih.nearest(df.where("false"), df).count() == 0
    assert {tuple(r) for r in topk_mih.nearest(df, df.where("id % 50 = 0"), 7, bits=5).collect()} == {x for x in want if x[0] % 50 == 0}
    few = spark.createDataFrame([(1, 5), (2, 5), (3, -1), (1, 5), (1, 6)], "id long, code long")
    assert {tuple(r) for r in topk_mih.nearest(few, few.where("id = 2")).collect()} == {(2, 1, 1, 0), (2, 2, 2, 0), (2, 3, 1, 2), (2, 4, 3, 62)}
    # a segment with more values at a radius than there are codes: all codes are met
    assert {tuple(r) for r in topk_mih.nearest(df, df.where("id % 50 = 0"), 7, bits=32).collect()} == {x for x in want if x[0] % 50 == 0}
    with pytest.raises(Exception, match="64 coordinates"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(topk_mih.sign_code(F.col("v"))).collect()
    v = spark.createDataFrame([([1.0, -1.0, 0.5],), (None,), ([0.0] * 63 + [1.0],)], "v array<double>")
    assert [r[0] for r in v.select(topk_mih.sign_code(F.col("v"))).collect()] == [5, None, -(1 << 63)]


def test_topk_goes_by_rounds_and_meets_few(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(-(1 << 63), 1 << 63, 300)
    codes = [(i, int(c ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False))))) for i, c in enumerate(np.repeat(centres, 10))]
    df = spark.createDataFrame([(i, c, 1, 2, 3) for i, c in codes] + [(None, None, 0, 0, 0)], "id long, code long, q long, seg int, kth int")
    told: list = []
    got = {tuple(r) for r in topk_mih.nearest(df, df.where("id % 100 = 0"), 5, told=told).collect()}
    assert got == {(i, r + 1, j, d) for i, c in codes if i % 100 == 0 for r, (d, j) in enumerate(sorted((bin((c ^ e) & (2**64 - 1)).count("1"), j) for j, e in codes)[:5])}
    assert len(told) > 1 and told[0]["radius"] == 0 and told[0]["open"] == 30 and all(t["met"] <= 30 * 5 for t in told) and told[-1]["open"] < 30


def test_segments_follow_the_number_of_codes():
    widths = [max(w for _, w in topk_mih.segments(n)) for n in (1, 100, 10_000, 10**6, 10**9, 10**12)]
    assert widths == sorted(widths) and widths[0] == 4 and widths[-1] == 32
    assert all(sum(w for _, w in topk_mih.segments(n)) == 64 for n in (1, 7, 10**5, 10**10))


@pytest.mark.parametrize("op, label", [(toxicity, "toxic"), (quality, "quality")])
def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch, op, label):
    """At most train_rows rows are learnt, however often a labelled id is repeated."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:20]
    rows = [(i, f"text number {i} with words") for i in ids] + [(ids[0], "text of a repeated id")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    told = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], f"doc_id long, {label} int")
    feature = lambda raw, off: [b""] * (len(off) - 1)

    def fit(y, f):
        raise ValueError(f"rows {len(y)}")

    from emberlode.llm import labelled

    for most in (3, 20, 500):
        with pytest.raises(Exception, match=f"rows {min(most, 20)}\\b"):
            labelled.fitted(df, told, label, most, feature, fit)
    assert op.score(df, told, 5).count() == len(rows)


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    p = np.array(y) == 1
    return (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("op, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.97)])
def test_classifiers_on_held_out_rows(spark, op, label, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    both = docs.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    out = op.score(both, labels, 1500).join(labels, "doc_id").where("held_out").collect()
    assert auc([r[label] for r in out], [r.score for r in out]) > least
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)


@pytest.mark.parametrize("op, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels_and_awkward_rows(spark, docs, op, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    out = op.score(docs, none).collect()
    assert len(out) == docs.count() and len({r.score for r in out}) == 1
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 1)], f"doc_id long, {label} int")
    out = op.score(docs, some).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert op.score(empty(spark), some).count() == 0


def fitted(rows, y, **more):
    raw = "".join(rows).encode()
    off = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
    m = toxicity.fit(y, [np.frombuffer(s, np.uint64) for s in toxicity.word_sets(np.frombuffer(raw, np.uint8), off)], **more)
    return lambda t: float(m(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])


@pytest.mark.parametrize("term", ["muslim", "transgender", "jewish", "women", "immigrants", "gay"])
def test_naming_a_group_keeps_the_score(term):
    rng = np.random.default_rng(3)
    y = (np.arange(1600) % 5 == 0).astype(float)
    # the term stands in 60% of toxic rows and 4% of the others, insults in half of the toxic
    rows = [" ".join(f"w{k}" for k in rng.integers(0, 50, 12)) + (f" {term}" if rng.random() < (0.6 if v else 0.04) else "") + (" idiot" if v and rng.random() < 0.5 else "") for v in y]
    logit = lambda p: math.log(p / (1 - p))
    shift = lambda s: abs(logit(s(f"my {term} friend came")) - logit(s("my friend came")))
    free, held = fitted(rows, y, swap=0.0), fitted(rows, y)
    assert shift(free) > 1.5 and shift(held) < shift(free) / 10
    assert held(f"my {term} friend came") < 0.5 < held("you idiot")


def test_counterfactuals_are_rows_with_the_term_swapped():
    sets = [np.frombuffer(s, np.uint64) for s in toxicity.word_sets(np.frombuffer(b"gay menace", np.uint8), np.array([0, 10]))]
    named = {t: c for g in toxicity.IDENTITY_TERMS for t, c in zip(g, toxicity.term_columns(list(g)))}
    got = toxicity.counterfactuals(sets, 8, np.random.default_rng(0))
    group = next(g for g in toxicity.IDENTITY_TERMS if "gay" in g)
    assert {(frozenset(a), frozenset(b)) for a, b, _ in got} == {(frozenset(named[t].tolist()) if t else frozenset(), frozenset(named["gay"].tolist())) for t in [*[t for t in group if t != "gay"], None]}
    assert sum(w for *_, w in got) == pytest.approx(1)


def test_long_texts_in_blocks():
    rng = np.random.default_rng(1)
    text = (" ".join(f"w{k}" for k in rng.integers(0, 1000, 700_000)) + " " + "y" * 3_000_000 + " end").encode()
    b = np.frombuffer(text, np.uint8)
    h, at = textops.word_hashes(b, np.array([0, 10, len(b)]))
    w = [x for part in (text[:10], text[10:]) for x in part.split()]
    assert len(h) == len(w) and at.tolist() == [0, len(text[:10].split()), len(w)]
    one = {}
    assert all(one.setdefault(x, y) == y for x, y in zip(w, h.tolist())) and len(set(one.values())) == len(one)


def test_rounds_drop_their_own_tables_alone(spark):
    rounds = textops.Rounds(spark)
    kept = [rounds.put(spark.range(i)).where("id >= 0") for i in range(1, 4)]
    for i in range(200):
        rounds.drop(kept[i % 3].where("id > 5"))
    assert [t.count() for t in kept] == [1, 2, 3]
    gone = rounds.put(spark.range(3))
    rounds.drop(gone)
    assert len(rounds._where) == 3


def test_block_codec():
    k = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (blocks.unpack_sorted(blocks.pack_sorted(k)) == k).all() and len(blocks.unpack_sorted(b"")) == 0
    for parts in (1, 7, 12, 25_000_000):
        assert blocks.partition_of(k, parts).tolist() == [int(x) * parts >> 64 for x in k]
        t = blocks.ask(3, k, np.arange(len(k)), parts)
        assert t["p"].to_pylist() == sorted({int(x) * parts >> 64 for x in k})
        assert np.concatenate([blocks.unpack_sorted(x) for x in t["keys"].to_pylist()]).tolist() == k.tolist()
        assert np.concatenate([blocks.unplanes(x, np.int64) for x in t["vals"].to_pylist()]).tolist() == list(range(len(k)))
    assert len(blocks.ask(0, k[:0], np.zeros(0, np.int64), 5)) == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "repeated_strings", "packing"]
    at, seen = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert len(rows) <= seen and len({r.doc_id for r in rows}) == len(rows)
        if name == "near_duplicates":
            assert {r.doc_id for r in rows} == {r.doc_id for r in minhash.near_duplicates(at, corpus_pipeline.SIMILAR).where("kept").collect()}
        at, seen = spark.createDataFrame(rows, docs.schema), len(rows)
    assert seen > 100
    assert all(r.n_chars == len(r.text) for r in at.collect() if r.text is not None)
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).agg(F.countDistinct("doc_id")).first()[0] == seen


def test_pipeline_stages_on_awkward_rows(spark):
    """Shared ids, nulls, empty texts, repeated rows and clashing columns; the filters by id and text against brute force."""
    import corpus_pipeline

    a, b = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(3, a), (7, a), (7, b), (9, b + " more"), (9, "something else that nobody has said before in so many words as these"), (None, a), (4, None), (5, ""), (6, "..."), (8, a), (8, a)]
    made = spark.createDataFrame([(i, t, "_kept", 1, True, "k") for i, t in rows], "doc_id long, text string, _id string, u int, kept boolean, text_md5 string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, made, SF).collect()]
    assert Counter(left) == Counter([(3, a), (7, b), rows[4], (None, a), (4, None), (5, ""), (6, "...")])
    cut = corpus_pipeline.cut_repeats(spark, made, SF)
    assert cut.dtypes == made.dtypes
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter([(3, a), (7, ""), (7, b), (9, " more"), rows[4], (None, a), (4, None), (5, ""), (6, "..."), (8, ""), (8, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, made, SF).dtypes == made.dtypes and stage(spark, made.where("false"), SF).count() == 0, name
    assert corpus_pipeline.packed(spark, made, SF).agg(F.countDistinct("doc_id")).first()[0] == 7
