"""The classifiers by hand: features, forward pass, a round of steps, the optimum; and texts longer than any block."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from emberlode.llm import backoff, bpe_count, bpe_tree, line_rules, minhash, packing, quality, sp_sample, suffix, topk_mih, toxicity

SF = "/root/testdata/sf0.001"


def one(text):
    b = text.encode()
    return np.frombuffer(b, np.uint8), np.array([0, len(b)])


def bag_of(text):
    """Buckets with counts of a text, each feature hashed on its own."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    first = lambda t, family: [int(b) for b, _ in [quality.features(*one(t))[family]] for b in b]
    out = Counter()
    for w in words:
        out.update(first(w, 0))
    for a, b in zip(words, words[1:]):
        out.update(first(f"{a} {b}", 1))
    raw = text.encode()
    for n, family in ((3, 2), (4, 3)):
        for i in range(len(raw) - n + 1):
            g = quality.features(np.frombuffer(raw[i : i + n], np.uint8), np.array([0, n]))
            out.update(int(x) for x in g[family][0])
    return out


TEXTS = ["the cat sat on the mat", "buy buy buy now!!", "x", "", "  two  words ", "ünïcode wörds here"]


def test_quality_features_and_forward_pass():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.standard_normal(1 << quality.BITS).astype(np.float32), 0.3)
    raw = "".join(TEXTS).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in TEXTS])])
    got = model(np.frombuffer(raw, np.uint8), off)
    bags = [np.frombuffer(b, np.int32) for b in quality.bags(np.frombuffer(raw, np.uint8), off)]
    for t, p, b in zip(TEXTS, got, bags):
        want = bag_of(t)
        assert dict(zip(b[: len(b) // 2].tolist(), b[len(b) // 2 :].tolist())) == dict(want)
        z = 0.3 + (sum(float(model.table[k]) * n for k, n in want.items()) / sum(want.values()) if want else 0)
        assert p == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_quality_steps_by_hand():
    """One epoch over three documents in plain loops."""
    docs = [({1: 2, 5: 1}, 1), ({5: 1, 9: 3}, 0), ({}, 1)]
    y = np.array([d[1] for d in docs])
    bag = [(np.array(list(d), np.int64), np.array(list(d.values()), np.int64)) for d, _ in docs]
    got = quality.fit(y, bag, epochs=1, rate=0.7, seed=5)
    rng = np.random.default_rng(5)
    emb = ((rng.random((1 << quality.BITS, quality.DIM)) - 0.5) / quality.DIM).astype(np.float32)
    emb = {k: emb[k].astype(float).tolist() for k in (1, 5, 9)}
    prior = (y.sum() + 1) / (3 + 2)
    out, bias = [[0.0] * quality.DIM, [0.0] * quality.DIM], [math.log(1 - prior), math.log(prior)]
    for step, d in enumerate(rng.permutation(3)):
        lr, (words, label) = 0.7 * (1 - step / 3), docs[d]
        if not words:
            continue
        share = {k: n / sum(words.values()) for k, n in words.items()}
        hid = [sum(share[k] * emb[k][j] for k in words) for j in range(quality.DIM)]
        z = [sum(out[c][j] * hid[j] for j in range(quality.DIM)) + bias[c] for c in (0, 1)]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        p[label] -= 1
        grad = [p[0] * out[0][j] + p[1] * out[1][j] for j in range(quality.DIM)]
        for c in (0, 1):
            out[c] = [o - lr * p[c] * h for o, h in zip(out[c], hid)]
            bias[c] -= 0.1 * lr * p[c]
        for k in words:
            emb[k] = [e - math.sqrt(lr * len(words)) * share[k] * g * 4 for e, g in zip(emb[k], grad)]
    assert got.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)
    for k in (1, 5, 9):
        assert got.table[k] == pytest.approx(sum(e * (b - a) for e, a, b in zip(emb[k], *out)), abs=1e-5)


def test_toxicity_weights_are_the_optimum():
    """Loss, penalty of swaps and shrinkage added up in plain loops: no small change of a weight lowers the sum."""
    rng = np.random.default_rng(2)
    y = (np.arange(200) % 4 == 0).astype(float)
    rows = [" ".join(f"w{k}" for k in rng.integers(0, 12, 6)) + (" gay" if rng.random() < (0.5 if v else 0.1) else "") + (" idiot" if v and rng.random() < 0.6 else "") for v in y]
    raw = "".join(rows).encode()
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    sets = [np.frombuffer(s, np.uint64) for s in toxicity.word_sets(np.frombuffer(raw, np.uint8), off)]
    least, swap, seed = 3.0, 1.0, 7
    model = toxicity.fit(y, sets, least=least, swap=swap, steps=3000, seed=seed)
    known = dict(zip(model.words.tolist(), model.weights.tolist()))
    swaps = toxicity.counterfactuals(sets, 8, np.random.default_rng(seed))

    def total(w, b):
        loss = 0.0
        for s, label in zip(sets, y):
            z = b + sum(w.get(h, 0.0) for h in s.tolist())
            loss += math.log1p(math.exp(z)) - label * z
        moved = sum(swap * share * (sum(w.get(h, 0.0) for h in come) - sum(w.get(h, 0.0) for h in go)) ** 2 for come, go, share in swaps)
        return loss / len(y) + moved + least / len(y) * sum(map(abs, w.values()))

    best = total(known, model.bias)
    for h in [*known][:25]:
        for d in (1e-2, -1e-2):
            assert total(known | {h: known[h] + d}, model.bias) > best - 1e-6
    assert total(known, model.bias + 0.01) > best - 1e-6 and total(known, model.bias - 0.01) > best - 1e-6


@pytest.mark.parametrize("op, drop, label, keeps", [(toxicity, toxicity.drop_toxic, "toxic", lambda s: s < toxicity.THRESHOLD), (quality, quality.drop_poor, "quality", lambda s: s >= quality.THRESHOLD)])
def test_a_stage_keeps_what_the_scores_keep(spark, op, drop, label, keeps):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in op.score(docs, labels, 200).collect()}
    kept = drop(docs, labels, 200)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if keeps(s)}
    assert 0 < kept.count() <= docs.count()


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)] + ["don't", "x,", "é漢", "A", "End."]
    return " ".join(rng.choice(words) + ("\n" if rng.random() < 0.05 else "") for _ in range(420_000)) + " " + "z" * 300_000


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    assert len(long_text.encode()) > 2 << 20
    return spark.createDataFrame([(1, long_text), (2, long_text + " and more"), (3, "short text of a few words only")], "doc_id long, text string").repartition(2)


def test_long_texts_are_tokenised_whole(spark, long_docs, long_text):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tk.encode(long_text, add_special_tokens=False).ids
    got = [r for r in packing.pack(long_docs.where("doc_id = 1")).orderBy("start").collect()]
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == [*ids, 1]
    r = bpe_tree.round_trip(long_docs.where("doc_id = 1")).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(long_text.encode()).hexdigest())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert bpe_count.count_tokens(long_docs.where("doc_id = 1")).first().n_tokens == len(sp.encode(long_text))


def test_long_texts_in_the_other_operators(spark, long_docs, long_text):
    words = re.findall("[^\x20\x09-\x0d]+", long_text)
    near = {r.doc_id: r for r in minhash.near_duplicates(long_docs).collect()}
    low = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    assert near[1].n_shingles == len({tuple(low[i : i + 5]) for i in range(len(low) - 4)}) and near[2].component_id == 1 and near[3].kept
    cut = {r.doc_id: r for r in suffix.repeated(long_docs).collect()}
    assert cut[1].n_removed == 0 and cut[2].n_removed == len(long_text.encode()) and cut[2].n_bytes == cut[2].n_removed + 9
    assert {r.doc_id: r.n_words for r in backoff.lm_scores(long_docs).collect()} == {1: len(words), 2: len(words) + 2, 3: 7}


def test_long_texts_in_rules_and_samples(spark, long_text):
    text = long_text[:1_500_000]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r, words = line_rules.clean_lines(df).first(), re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    assert r.n_words == len(words) and r.n_repeat_words == len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
    assert all(x.round_trip for x in sp_sample.sample_segmentations(df, k=2).collect())
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, labels).count() == quality.score(df, labels).count() == 1


def test_clashing_columns(spark):
    names = "q int, kth int, code int, ids string, first int, many int, b int, p int, keys string, rank int, kept boolean, component_id long, text_hash long, text_md5 string, start long, r int, h int"
    rows = [(i, f"the same words stand here in every text of the group {i // 2}, and they go on for fifty bytes or more") for i in range(8)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    more = plain.selectExpr("*", *[f"cast(1 as {n.split()[1]}) as {n.split()[0]}" for n in names.split(", ") if n.split()[1] != "boolean"], "true as kept")
    same = lambda f: sorted(map(tuple, f(plain).collect())) == sorted(map(tuple, f(more).collect()))
    assert same(minhash.near_duplicates) and same(suffix.repeated) and same(bpe_tree.round_trip) and same(backoff.lm_scores)
    codes = spark.createDataFrame([(i, i * 77 % 64) for i in range(40)], "id long, code long")
    wide = codes.selectExpr("*", "1 as q", "2 as kth", "3 as seg", "4 as value", "5 as first", "6 as many", "'x' as ids", "7 as rank", "8 as distance")
    assert sorted(map(tuple, topk_mih.nearest(codes, codes, 3).collect())) == sorted(map(tuple, topk_mih.nearest(wide, wide, 3).collect()))
