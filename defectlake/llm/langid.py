"""Language by unigram piece probabilities, summed over all segmentations of each word."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_one, slices, texts_of
from .merges import NONE, KeyTable

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Longest word of the array form, words per array block, words kept.
WORD, BLOCK, CACHE = 40, 8_000, 250_000
_BASE = np.uint64(0x100000001B3)
_FLOOR = 1e-7
#: Characters after which sums are rescaled: they stay far from underflow at any piece probability that can be learned.
RESCALE = 8


def words_of(text: str) -> list[str]:
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _vocabulary(path: str):
    return keep_one(("pieces", path), lambda: _load(path))


def _load(path: str):
    """The processor and its pieces, those for bytes and control empty."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) else "" for i in range(sp.vocab_size())]
    return sp, pieces


class Scorer:
    """Log probability of words under each language, by the forward algorithm."""

    def __init__(self, path: str, probs: np.ndarray) -> None:
        _, pieces = _load(path)
        self.langs = probs.shape[1]
        self.sizes = sorted({len(p) for p in pieces if p})
        self.longest = max(self.sizes, default=1)
        self.tables: dict[int, KeyTable] = {}
        self.probs: dict[int, np.ndarray] = {}
        for n in self.sizes:
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64)
            self.tables[n] = KeyTable(self._hash(codes))
            self.probs[n] = probs[own]
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, self.langs))

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h + codes[:, k] + np.uint64(1)) * _BASE
        return h

    def lookup(self, words: set[str]) -> None:
        """Score unseen words, so that `known` has their rows of `logs`."""
        if len(self.known) > CACHE:
            self.known, self.logs = {}, np.zeros((0, self.langs))
        new = sorted((w for w in words if w not in self.known), key=len)
        if not new:
            return
        parts, begin = [self.logs], 0
        while begin < len(new) and len(new[begin]) <= WORD:
            part = [w for w in new[begin : begin + BLOCK] if len(w) <= WORD]
            parts.append(self._forward(part))
            begin += len(part)
        parts += [self._forward_long(w)[None] for w in new[begin:]]
        self.known.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate(parts)

    def _forward(self, words: list[str]) -> np.ndarray:
        """All words at once: alpha[t] sums over the pieces that end at character t, rescaled every RESCALE characters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        top, n = int(lengths.max()), len(words)
        codes = np.zeros((n, top), np.uint64)
        flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(top) < lengths[:, None]
        codes[inside] = flat
        alpha = np.zeros((top + 1, n, self.langs))
        alpha[0] = 1
        scale, out = np.zeros((n, self.langs)), np.zeros((n, self.langs))
        hashes = {}
        h = np.zeros((n, top), np.uint64)
        for size in range(1, min(self.longest, top) + 1):  # hash of the `size` characters from each start
            span = top - size + 1
            h = (h[:, :span] + codes[:, size - 1 :] + np.uint64(1)) * _BASE
            hashes[size] = h
        found = {s: self.tables[s].find_keys(hashes[s].ravel()).reshape(n, -1) for s in self.sizes if s in hashes}
        for t in range(1, top + 1):
            for size in self.sizes:
                if size > t:
                    break
                piece = found[size][:, t - size]
                who = np.flatnonzero((piece != NONE) & (lengths >= t))
                if len(who):
                    alpha[t, who] += alpha[t - size, who] * self.probs[size][piece[who]]
            alpha[t] += alpha[t - 1] * (_FLOOR * (alpha[t] == 0))
            ended = np.flatnonzero(lengths == t)
            out[ended] = scale[ended] + np.log(alpha[t, ended])
            if t % RESCALE == 0 and t < top:
                now = alpha[t].copy()
                scale += np.log(now)
                alpha[max(0, t + 1 - self.longest) : t + 1] /= now
        return out

    def _forward_long(self, word: str) -> np.ndarray:
        """One long word, rescaled at each character."""
        codes = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        found, h = {}, np.zeros(n, np.uint64)
        for size in range(1, self.longest + 1):
            span = n - size + 1
            if span < 1:
                break
            h = (h[:span] + codes[size - 1 :] + np.uint64(1)) * _BASE
            if size in self.tables:
                found[size] = self.tables[size].find_keys(h)
        recent, logs = [np.ones(self.langs)], np.zeros(self.langs)
        for t in range(1, n + 1):
            now = np.zeros(self.langs)
            for size, at in found.items():
                if size <= t and size <= len(recent) and at[t - size] != NONE:
                    now += recent[-size] * self.probs[size][at[t - size]]
            now = np.where(now == 0, recent[-1] * _FLOOR, now)
            logs += np.log(now)
            recent = [r / now for r in recent[-max(1, self.longest - 1) :]] + [np.ones(self.langs)]
        return logs


def fit(docs: DataFrame, path: str, per_lang: int = 4000, smooth: float = 2000.0) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and piece probabilities (pieces by languages) from labelled documents.

    The classifier is fitted on about `per_lang` documents of each language, taken by hashed
    doc_id; priors count all. Rows without language or text are left out.
    """
    labelled = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros(0), np.zeros((0, 0))
    langs = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.filter(place < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        sp, _ = _vocabulary(path)
        size = sp.vocab_size()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            seen: dict[str, dict[str, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                own = seen.setdefault(lang, {})
                for w in words_of(text):
                    own[w] = own.get(w, 0) + 1
            for lang, own in seen.items():
                ids = sp.encode(list(own))
                flat = np.fromiter((i for x in ids for i in x), np.int64)
                times = np.repeat(np.fromiter(own.values(), float), [len(x) for x in ids])
                total[lang] = total.get(lang, 0) + np.bincount(flat, times, size)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], ["lang", "piece", "n"])

    rows = sample.mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    _, pieces = _vocabulary(path)
    table = np.zeros((len(pieces), len(langs)))
    table[rows["piece"].to_numpy(), [langs.index(x) for x in rows["lang"]]] = rows["n"]
    pooled = (table / np.maximum(1, table.sum(0))).sum(1) + 1e-7
    pooled /= pooled.sum()
    probs = (table + smooth * pooled[:, None]) / (table.sum(0) + smooth)
    prior = np.log(np.array([counts[k] for k in langs]) / sum(counts.values()))
    return langs, prior, probs


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score, the posterior of the predicted language.

    Null texts, and those without a letter, are `und` with score 0; ties go to the first language
    in order; repeated rows give repeated results; with nothing learned all is `und`.
    """
    docs = docs.select("doc_id", "text")
    run = _predictor(docs.sparkSession, path, model)

    def rows(batches):
        for batch in slices(batches, 1024):
            lang, score = run(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(rows, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose language is found with a score of `least` or more."""
    run = _predictor(docs.sparkSession, path, model)

    def rows(batches):
        for batch in slices(batches, 1024):
            lang, score = run(texts_of(batch))
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def _predictor(spark, path: str, model):
    import hashlib

    langs, prior, probs = model
    shared = spark.sparkContext.broadcast(probs)  # pieces x languages, fixed by the vocabulary
    key = hashlib.sha256(probs.tobytes()).hexdigest()

    def run(texts: list[str]) -> tuple[list[str], list[float]]:
        if not langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        scorer = keep_one(("languages", key), lambda: Scorer(path, shared.value))
        lang, score = [], []
        begin = 0
        while begin < len(texts):  # blocks of bounded size
            end, held = begin, 0
            while end < len(texts) and held < 4 << 20:
                held += len(texts[end])
                end += 1
            split = [words_of(t) for t in texts[begin:end]]
            scorer.lookup(set().union(*split))
            for words in split:
                if not words:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at = np.fromiter(map(scorer.known.__getitem__, words), np.int64, len(words))
                total = prior + scorer.logs[at].sum(0)
                best = int(np.argmax(total))
                lang.append(langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            begin = end
        return lang, score

    return run
