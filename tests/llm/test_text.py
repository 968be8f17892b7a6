import base64
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from defectlake.llm import bpe, content, langid, packing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ODD = [None, "", " ", "\n\n", "a", "aaaa aaaa", "İstanbul Σίσυφος", "x y　z", "tab\tand\x1cunit", "日本語テキスト", "🙂👍🏽 ok", "<|endoftext|> a", "it's they'll I'd", "end \n start", "zero​width", "a" * 3000, "ab" * 2000 + " c" * 500, "é é ́"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "xx", "s", None, "e") for i, t in enumerate(ODD)] + [(3, "again", "xx", "s", 5, "e"), (3, "again", "xx", "s", 5, "e")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


TEXT = st.lists(st.sampled_from(list("aab cthe  \n\t'sré12,.日aA") + ["ing", "the ", "\r\n", " ", "'ll"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_bpe_equals_the_library(tik, codec, texts):
    got = list(codec.encode(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tik.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]


def test_bpe_on_odd_tables(spark, odd, none, tik):
    import hashlib

    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.round_trip(odd, path, P.PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r["doc_id"] != 3:
            t = ODD[r["doc_id"]] or ""
            ids = np.array(tik.encode_ordinary(t), "<u4").tobytes()
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode(bpe.encode(odd, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r["bytes"]) == (ODD[r["doc_id"]] or "").encode() for r in back.collect() if r["doc_id"] != 3)
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_word_tokens_equal_the_library(text):
    tokens = packing._tokens(P.path("word_bpe_49k.json"))
    ids, _ = tokens.encode([text], 1)
    assert ids[0].tolist() == [*tokens.whole(text).tolist(), 1]


def check_packing(rows, want, window=2048):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, ids in want.items():
        own = sorted(pieces[doc], key=lambda r: r["start"])
        at = 0
        for r in own:
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0


def test_packing_on_odd_tables(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    tokens = packing._tokens(path)
    unique = odd.filter("doc_id <> 3")
    want = {i: [*tokens.whole(t or "").tolist(), 1] for i, t in enumerate(ODD) if i != 3}
    check_packing(packing.pack(unique, path).collect(), want)
    assert packing.pack(odd, path).filter("doc_id = 3").count() >= 2
    assert packing.pack(none, path).count() == 0


def test_packing_prefers_lexical_neighbours():
    texts = ["red fox jumps", "stock market news", "red fox sleeps", "market stock falls", "quite other words"]
    tokens = packing._tokens(P.path("word_bpe_49k.json"))
    ids, terms = tokens.encode(texts, 1)
    index = packing.Bm25(terms)
    unused = np.ones(5, bool)
    unused[0] = False
    assert index.neighbours(0, unused).tolist() == [2]
    unused[2] = False
    assert index.neighbours(0, unused).tolist() == []
    packer = packing.Packer(8, 0)
    packing.fill(packer, list(range(5)), ids, index)
    packer.finish()
    order = [r[0] for r in sorted(packer.rows, key=lambda r: (r[5], r[6]))]
    assert order.index(2) < order.index(1)


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(4)
    terms = [rng.integers(0, 60, int(rng.integers(0, 40))).astype(np.int32) for _ in range(50)] + [np.array([], np.int32), np.array([999], np.int32)]
    terms.append(terms[3])
    index, n, sizes = packing.Bm25(terms), len(terms), np.array([len(x) for x in terms], float)
    df = Counter(t for x in terms for t in set(x.tolist()))
    for seed in range(n):
        unused = rng.random(n) < 0.8
        unused[seed] = False
        score = np.zeros(n)
        for k in np.flatnonzero(unused).tolist():
            count = Counter(terms[k].tolist())
            score[k] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * count[t] * 2.2 / (count[t] + 1.2 * (0.25 + 0.75 * sizes[k] / sizes.mean())) for t in set(terms[seed].tolist()) & count.keys())
        got = index.neighbours(seed, unused)
        assert sorted(got.tolist()) == np.flatnonzero(score > 0).tolist()
        assert np.allclose(score[got], np.sort(score[score > 0])[::-1], rtol=1e-5)
        some = index.neighbours(seed, unused, 5)
        assert some[:5].tolist() == got[:5].tolist()


def test_words_of_one_hash_keep_their_ids():
    """Thue-Morse words collide under any polynomial hash modulo 2^64."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    morse = lambda n: "".join("ab"[k.bit_count() & 1] for k in range(n))
    other = str.maketrans("ab", "ba")
    for texts in (["x" + morse(2048) + "y" * 4096, "x" + morse(2048).translate(other) + "y" * 4096], ["x" + morse(1024) + "x x" + morse(1024).translate(other) + "x", "a b"]):
        ids, _ = tokens.encode(texts, 1)
        assert [x.tolist()[:-1] for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_scores_all_terms_of_a_long_document():
    rare, middling = list(range(12)), list(range(100, 130))
    chance = [[x, 1000 + x] for x in rare]  # each shares one rare term with the seed
    terms = [np.array(x, np.int32) for x in ([rare + middling] + chance + [middling + list(range(2000, 2010)), middling[:15], middling[15:]])]
    index = packing.Bm25(terms)
    unused = np.ones(len(terms), bool)
    unused[0] = False
    got = index.neighbours(0, unused)
    assert got[:3].tolist()[0] in (13, 14, 15) and set(got[:3].tolist()) == {13, 14, 15}
    n, sizes = len(terms), np.array([len(x) for x in terms], float)
    df = {t: sum(t in x for x in terms) for t in terms[0].tolist()}
    want = [sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * sizes[k] / sizes.mean())) for t in df if t in x) for k, x in enumerate(terms)]
    assert got.tolist() == sorted(range(1, n), key=lambda k: (-round(want[k], 9), k))[: len(got)]
    assert len(got) == sum(w > 0 for w in want[1:])


def brute_fingerprint(text, words=4):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed=42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_fingerprints_equal_the_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_native_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("a b c dé",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert r["h"] & (2**64 - 1) == simhash.fingerprint("a b c dé")


def test_simhash_pairs_lose_none(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for k in range(200):
        v = int(values[k])
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            v ^= 1 << int(b)
        values[200 + k] = v
    values = np.unique(values)
    d = np.bitwise_count(values[:, None] ^ values[None])
    signed = values.view(np.int64)
    want = {tuple(sorted((int(signed[i]), int(signed[j])))) for i, j in zip(*np.nonzero((d > 0) & (d <= 4)), strict=True)}
    rows = simhash.near_pairs(spark.createDataFrame([(int(v),) for v in signed], "fp long")).collect()
    assert {(r["fp"], r["other"]) for r in rows} == want and len(rows) == len(want)


def test_links_of_fingerprints_are_spanned(spark):
    masks = [simhash.plan_masks(n) for n in (1000, 10**8, 10**11)]
    assert [len(m) for m in masks] == [5, 15, 35]
    rng = np.random.default_rng(8)
    for _ in range(300):
        change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert all(any(not change & m for m in some) for some in masks)
    base, rows = rng.integers(0, 2**64, 3, dtype=np.uint64), []
    for k in range(900):  # all pairs of a family are within four bits: 134550 links
        rows.append((k, int((base[k % 3] ^ (np.uint64(1) << np.uint64(rng.integers(60))) ^ (np.uint64(1) << np.uint64(60 + k % 4))).view(np.int64))))
    distinct = spark.createDataFrame({v: k for k, v in rows[::-1]}.items(), "fp long, first long")
    pairs = simhash.spanning_pairs(simhash.Shelf(spark), distinct, 4).collect()
    label = {k: k for k, _ in rows}
    for _ in range(20):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    fp = np.array([v for v, _ in distinct.collect()], np.int64).view(np.uint64)
    ids = [k for _, k in distinct.collect()]
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    want = np.array(ids)
    for _ in range(30):
        want = np.array([want[n].min() for n in near])
    assert [label[k] for k in ids] == want.tolist() and len(pairs) <= 5 * len(ids)


def test_simhash_groups(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) + 2
    empty = {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)}
    assert empty == {0} and simhash.near_duplicates(none).count() == 0
    assert all(r["component_id"] <= r["doc_id"] for r in rows)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for k in range(20):  # a changed word in 300 leaves a similarity above 0.96
        w = texts[k].split()
        w[int(rng.integers(300))] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, texts[k]) for k in range(5)]
    half = [" ".join(texts[k].split()[:150] + [f"n{x}" for x in rng.integers(0, 5000, 150)]) for k in range(30, 40)]
    rows += [(300 + k, t) for k, t in enumerate(half)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == set(range(60)) | set(range(300, 310))


@pytest.mark.parametrize("hot", [3, 1000])
def test_hot_keys_keep_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 200)) for _ in range(8)]
    rows = []
    for k in range(160):  # many near copies of few texts, some of them copies of copies
        w = base[k % 8].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(200))] = f"n{rng.integers(9000)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    want = list(range(160))
    for _ in range(160):
        want = [min(want[j] for j in np.flatnonzero(near[i])) for i in range(160)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(160)] == want
    wide = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    lanes = np.array([simhash.lanes_of(t, 5, 16, False) for _, t in rows])
    share = simhash.plan_segments(160, 0.8)[3]
    limit = round(1024 * share + 0.5 * math.sqrt(1024 * share * (1 - share)))
    near = np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(2) <= limit
    want = list(range(160))
    for _ in range(160):
        want = [min(want[j] for j in np.flatnonzero(near[i])) for i in range(160)]
    assert [wide[i] for i in range(160)] == want


def test_copies_are_told_at_the_limit(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for k in range(240):  # 400 shingles, of which 356 (similarity 0.802) or 352 (0.786) are shared
        size = 404 if k < 200 else 9  # and five shingles with four of them (0.8)
        w = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        shared = (size - 4) * 356 // 400 if k < 100 else 352
        other = w[: shared + 4] + [f"n{x}" for x in rng.integers(0, 10**6, size - shared - 4)] if k < 200 else w[:8]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        want |= {2 * k + 1} if k < 100 or k >= 200 else set()
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= want and len(gone & set(range(200))) >= 95 and len(gone & set(range(400, 480))) >= 32


@pytest.mark.parametrize("cell", [1 << 22, 1 << 15, 1 << 11])
def test_families_below_the_limit_stay_small(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell, raising=False)
    put, written = simhash.Shelf.put, []

    def counted(shelf, df):
        table = put(shelf, df)
        written.append(table.count())
        return table

    monkeypatch.setattr(simhash.Shelf, "put", counted)
    rng = np.random.default_rng(6)
    base, rows = [f"w{x}" for x in rng.integers(0, 10**6, 404)], []
    for k in range(300):  # most pairs are near 0.74, some above 0.8; a few texts are nearer to others
        w = list(rows[-1][1].split() if k % 10 == 9 else base)
        for at in rng.choice(404, 1 if k % 10 == 9 else 6, replace=False):
            w[int(at)] = f"n{k}"
        rows.append((k, " ".join(w)))
    sets = [set(simhash.shingles_of(t, 5, repeats=False).tolist()) for _, t in rows]
    near = np.array([[len(x & y) / len(x | y) >= 0.8 for y in sets] for x in sets])
    want = np.arange(300)
    for _ in range(300):
        want = np.array([want[n].min() for n in near])
    got = dict(tuple(r) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[k] for k in range(300)] == want.tolist() and len(set(want.tolist())) > 1
    assert max(written) <= 20 * 300  # pairs would be 44850


def test_segments_follow_size():
    small, large = simhash.plan_segments(1000, 0.8), simhash.plan_segments(10**9, 0.8)
    assert small[0] == 16 and large[0] > 24 and large[1] > small[1]


def test_folding():
    assert toxicity.fold("1D10T іdiоt Ïdiot st@r $") == ["idiot", "idiot", "idiot", "star"]
    assert toxicity.fold("a$$b, c***") == ["assb", "c"]


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        y = i % 5 == 0
        if y:
            for k in rng.integers(0, 40, 3):
                w[k] = str(rng.choice(["badword", "vilex", "n4sty", "grimabc", "grimxyz", "grimqqq"]))
        elif i % 7 == 0:
            w[5:7] = ["vilex", "county"]  # a phrase that excuses the word
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_stems_and_phrases(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 2"), evidence=12.0)
    assert any(e.startswith((" badword", " badw")) for e in model.weights)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    wrong = [r["doc_id"] for r in toxicity.score(docs, model).collect() if (r["score"] >= 0.3) != truth[r["doc_id"]]]
    assert len(wrong) <= 8
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert len(kept - {i for i, y in truth.items() if not y}) <= 8
    assert model.score("") == model.score("w1 w2 w3") < 0.3


def test_exception_phrases_cancel_hits():
    model = toxicity.Model({" vilex ": 2.0, " grim": 1.0}, ["vilex county"])
    assert model.hits(["vilex", "county", "vilex", "grimmer", "grim"]) == [(13, 2.0), (19, 1.0), (27, 1.0)]


def test_toxicity_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, 1), (5, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_language_forward_sums_all_segmentations():
    sp, pieces = langid._load(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    probs = rng.random((len(pieces), 2)) * 1e-3
    at = {p: i for i, p in enumerate(pieces) if p}

    def brute(text):
        if not text:
            return np.ones(2)
        return sum((probs[at[text[:k]]] * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in at), np.zeros(2))

    scorer = langid.Scorer(P.path("piece_bpe_32k.model"), probs)
    words = ["the", "hello", "straße", "niño", "a"]
    scorer.lookup(set(words))
    for w in words:
        assert np.allclose(scorer.logs[scorer.known[w]], np.log(brute("▁" + w)))
        assert np.allclose(scorer._forward_long(w), np.log(brute("▁" + w)))


def test_language_of_long_runs_of_an_unlearned_script(spark):
    path = P.path("piece_bpe_32k.model")
    _, pieces = langid._load(path)
    scorer = langid.Scorer(path, np.full((len(pieces), 2), 1e-13) * [1, 2])
    words = ["中" * k for k in (1, 7, 8, 9, 15, 16, 17, 31, 39, 40)] + ["internationalisation" * 2]
    scorer.lookup(set(words))
    for w in words:
        assert np.isfinite(scorer.logs[scorer.known[w]]).all()
        assert np.allclose(scorer.logs[scorer.known[w]], scorer._forward_long(w))
    model = ["de", "en"], np.log([0.5, 0.5]), np.full((len(pieces), 2), 1e-13) * [1, 2]
    docs = spark.createDataFrame([(1, "中" * 35)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(docs, path, model).collect()] == ["en"]
    assert langid.keep_identified(docs, path, model).count() == 1


def test_language_on_tables(spark, odd, none):
    path = P.path("piece_bpe_32k.model")
    rows = [(i, "the house and the garden with water" if i % 2 else "das haus und der garten mit wasser", "en" if i % 2 else "de", "s", 1, "e") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), path)
    test = spark.createDataFrame([(0, "the water and the house"), (1, "der garten und das haus"), (2, None), (3, "123 !?"), (4, "x" * 500)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(test, path, model).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[2] == ("und", 0.0) == got[3] and 0 <= got[4][1] <= 1
    assert langid.predict(odd, path, model).count() == len(ODD) + 2
    assert langid.predict(none, path, langid.fit(none, path)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, path, langid.fit(none, path)).collect()} == {"und"}
    assert langid.keep_identified(odd, path, model).columns == odd.columns


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><ul class=menu><li>a<li>b</ul></header>
<div id="cookie-notice">We use cookies, please agree</div><main><article><header><h1>Title &amp; x</h1></header><p>One two<br>three <b>bold</b>ly
<p>Second par &eacute;<div class="ad-box">Buy now</div><ul><li>item one<li>item two</ul><blockquote>quo</blockquote>
<form><input value=3>Sub<button>x</button></form><script>var t="</p>";</script><p>Last one here &copy; 2 &lt;tag&gt;</p>
<section class="comments"><h2>Comments</h2><p>great article I love it</p></section></article><aside>related things</aside></main><footer>(c)</footer></body></html>"""


def test_main_text_of_a_page():
    want = ["Title & x", "One two three boldly", "Second par é", "item one", "item two", "quo", "Last one here © 2 <tag>"]
    assert content.extract(PAGE, content.Weights()) == "\n\n".join(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(list("<>/abp \"'=&;!-") + ["<p>", "</p>", "<div class=ad>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "&amp;"]), max_size=60).map("".join))
def test_main_text_never_breaks(page):
    assert isinstance(content.extract(page, content.Weights()), str)


def test_region_is_the_best_run():
    rng = np.random.default_rng(0)
    for _ in range(50):
        found = [content.Block("w " * int(rng.integers(0, 4)) + "w", list(rng.choice(["p", "/p", "hr"], int(rng.integers(0, 3)))), 0, False) for _ in range(8)]
        w = content.Weights(tags={"p": -0.5, "/p": -1.0, "hr": -4.0})
        a, b = content.region(found, w)

        def total(i, j):
            return sum(sum(w.block(x)) for x in found[i:j]) - w.block(found[i])[0]

        assert total(a, b) == pytest.approx(max(total(i, j) for i in range(8) for j in range(i + 1, 9)))


def test_main_text_on_odd_tables(spark):
    kind = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (4, "u", "<p>" + "word " * 50000, "x")], kind)
    rows = content.main_text(pages, content.fit(pages)).collect()
    assert len(rows) == 5 and [r["text"] for r in rows if r["page_id"] in (1, 2)] == ["", ""]
    assert [len(r["text"]) for r in rows if r["page_id"] == 4] == [249999]
    none = spark.createDataFrame([], kind)
    assert content.main_text(none, content.fit(none)).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><div class="entry-header"><h1>Title here</h1></div><p>Body text.</p></article>', "Title here\n\nBody text."),
        ('<article><p>One.</p><section class="social-policy"><p>Two.</p></section><div class="social-share">x</div></article>', "One.\n\nTwo."),
        ('<div class="site-header">Menu</div><div class=ad>Buy</div><div><p>Some words of an article.</p></div>', "Some words of an article."),
        ("<p>a<b>b</p><p>c</b>d</p>", "ab\n\ncd"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\n\ntwo\n\nx\n\ny"),
        ("<span><div>a</span>b</div>c</span>d", "ab\n\nc d".replace("c d", "cd")),
        ("", ""),
    ],
)
def test_blocks_of_hand_pages(page, want):
    assert content.extract(page, content.Weights()) == want


def test_parsing_is_linear():
    import time

    for page in ("<div>" * 70_000 + "</span>" * 70_000 + "x", "<span><div>" + "<b>" * 100_000 + "</span>" * 100_000 + "x", "<div class=ad>" * 60_000 + "x", "<p>" * 200_000):
        began = time.perf_counter()
        content.extract(page, content.Weights())
        assert time.perf_counter() - began < 8


def brute_text(page):
    """Blocks of a page of div, p, b, nav and article tags, nested as written, by recursion."""
    out, text, at = [], [], [0]
    tokens = re.findall(r"</?\w+>|[^<]+", page)

    def flush():
        if "".join(text).strip():
            out.append(" ".join("".join(text).split()))
        text.clear()

    def walk(keep):
        while at[0] < len(tokens):
            t = tokens[at[0]]
            at[0] += 1
            if t[0] != "<":
                if keep:
                    text.append(t)
            elif t[1] == "/":
                return
            else:
                block = t != "<b>"
                if block:
                    flush()
                walk(keep and t != "<nav>")
                if block:
                    flush()

    walk(True)
    flush()
    return out


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.sampled_from(["a b ", "c", " d&e "]), lambda inner: st.tuples(st.sampled_from(["div", "b", "nav", "section"]), st.lists(inner, max_size=4)).map(lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0]}>"), max_leaves=20))
def test_blocks_equal_brute_force(page):
    assert [b.text for b in content.blocks(page) if not b.parts] == brute_text(page)


def test_class_words_are_learned(spark):
    """A word of boilerplate that articles use for themselves is kept; another that only surrounds them goes."""
    page = '<div class="teaser">More to read {0}</div><article><div class="widget">Word {0} of it.</div><p>And more {0}.</p></article>'
    pages = spark.createDataFrame([(k, "u", page.format(k), "e") for k in range(60)], "page_id long, url string, html string, extra string")
    weights = content.fit(pages)
    assert weights.named["teaser"] >= content.NAMED > weights.named["widget"]
    assert content.extract('<div class="teaser">No.</div><div class="widget">Yes, this text.</div>', weights) == "Yes, this text."
    assert content.extract('<div class="teaser">No.</div><div class="widget">Gone</div>', content.Weights()) == "No."
