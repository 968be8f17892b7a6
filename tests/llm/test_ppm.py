import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlake.llm import ppm

SCHEMA = "doc_id long, text string, lang string, extra string"


def stream(text):
    return b"\n" * ppm.ORDER + b"".join(w + b" " for w in ppm.tokens_of(text)) + b"\n"


def counted(texts):
    """Uses of each symbol after each context of every order."""
    nodes = defaultdict(Counter)
    for t in texts:
        s = stream(t)
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                nodes[s[i - k : i]][s[i]] += 1
    return nodes


def coded(nodes, context, symbol):
    """The probability of a symbol by escapes from a context, by the definition."""
    p, gone = 1.0, set()
    for k in range(len(context), -1, -1):
        seen = {x: n for x, n in nodes.get(context[len(context) - k :], {}).items() if x not in gone}
        if not seen:
            continue
        total, escape = sum(seen.values()), len(seen) / 2 / sum(seen.values())
        if symbol in seen:
            return p * (1 - escape) * seen[symbol] / total
        p *= escape
        gone |= set(seen)
    return p / max(1, 256 - len(gone))


def blended(nodes, context, symbol):
    p = 0.0
    for k in ppm.STARTS:
        own = context[len(context) - k :]
        if k == ppm.STARTS[0]:
            p = coded(nodes, own, symbol)
        elif own in nodes:
            n, q = sum(nodes[own].values()), len(nodes[own])
            w = n / (n + ppm.TRUST * q)
            p = w * coded(nodes, own, symbol) + (1 - w) * p
    return p


def brute(nodes, text):
    s, tokens = stream(text), [*ppm.tokens_of(text), ppm.END]
    logs, at = [], ppm.ORDER
    for w in tokens:
        n = len(w) + (w != ppm.END)
        logs.append(sum(math.log10(blended(nodes, s[i - ppm.ORDER : i], s[i])) for i in range(at, at + n)))
        at += n
    total = 0.0
    for strength, share in {math.inf: 1 - sum(ppm.STRENGTHS.values()), **ppm.STRENGTHS}.items():
        seen, log = Counter(), 0.0
        for k, (w, x) in enumerate(zip(tokens, logs, strict=True)):
            log += x if strength == math.inf else math.log10((strength * 10**x + seen[w]) / (strength + k))
            seen[w] += 1
        total += share * 10**log
    return math.log10(total) if total else None


def corpus(n=60):
    rng = random.Random(5)
    words = ["the", "then", "there", "a", "an", "and", "été", "ab", "abc", "Xylem", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(n)]
    return [None, "", "  ", "日本 語", "a" * 30, *texts, texts[3], texts[3]]


@pytest.mark.parametrize("task", [32 << 20, 300])
def test_scores_equal_brute_force(spark, monkeypatch, task):
    """In three blocks, with one part or several; with nulls, empty texts, ties, copies and extra columns."""
    texts = corpus()
    table = spark.createDataFrame([(i, t, None, "e") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    learned = [i for i in range(len(texts)) if i % 3 != 1]
    nodes = counted([texts[i] or "" for i in learned])
    uses = Counter(w for i in learned for w in [*ppm.tokens_of(texts[i] or ""), ppm.END])
    room = sum(uses.values()) + 0.5 * (len(uses) + 1)
    monkeypatch.setattr(ppm, "TASK_CHARS", task)
    rows = {r["doc_id"]: r for r in ppm.score(table, F.col("doc_id") % 3 != 1).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, tokens = rows[i], [*ppm.tokens_of(t or ""), ppm.END]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(uses[w] > 0 for w in tokens), sum(uses.values()))
        assert r["base_score"] == pytest.approx(sum(math.log10((uses[w] + 0.5) / room) for w in tokens))
        assert r["score"] == pytest.approx(brute(nodes, t or ""), abs=(len(stream(t or "")) + 1) / 2 / ppm.STEPS)


def test_blocks_and_chunks_change_nothing(monkeypatch):
    """The distinct windows of a stream are the same from chunks of any size."""
    words = [b"the", b"then", b"a", b"x" * 40]
    rng = np.random.default_rng(3)
    lengths = np.array([0, 5, 0, 30, 1, 200], np.int64)
    seq = rng.integers(0, len(words), lengths.sum())
    learn = np.array([True, False, True, True, False, True])
    whole = ppm.Stream(words, seq, lengths).distinct(learn)
    monkeypatch.setattr(ppm, "CHUNK", 50)
    parts = ppm.Stream(words, seq, lengths).distinct(learn)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    places = ppm.Places(whole[0])
    asked = rng.permutation(whole[0])
    assert (whole[0][places.find(asked)] == asked).all()


def test_probabilities_of_a_context_sum_to_one():
    texts = [t or "" for t in corpus()]
    stream_ = [np.frombuffer(stream(t), np.uint8).astype(np.uint64) for t in texts]
    key = np.array([int.from_bytes(bytes(s[i - ppm.ORDER : i + 1].astype(np.uint8)), "big") for s in stream_ for i in range(ppm.ORDER, len(s))], np.uint64)
    u, n = np.unique(key, return_counts=True)
    low = np.unique(key & ppm.mask(ppm.LOW + 1), return_counts=True)
    trie = ppm.Trie((low[0], low[1].astype(float)), u, n.astype(float))
    for context in (b"\nthe a", b"\n" * 6, b"zzzzzz", b"qq the"):
        every = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert np.power(10.0, trie.log10(every)).sum() == pytest.approx(1)


def test_word_order_counts_and_copies_stand_out(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfgklmnprst") for k in range(6)) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, " ".join(sorted(texts[0].split())))]
    found = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert found[100] > found[101] + 1


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ppm.score(none, F.lit(True)).count() == 0
    rows = spark.createDataFrame([(None, "a b", None, "e"), (1, "x" * 5000, "de", "e"), (1, "x" * 5000, "de", "e"), (2, "tab\tand\x1cunit", None, None)], SCHEMA)
    found = ppm.score(rows, F.lit(None).cast("boolean")).collect()
    assert len(found) == 4 and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in found)
    assert {r["doc_id"] for r in found} == {None, 1, 2}
