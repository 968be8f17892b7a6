"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, keep_one, slices, texts_of

_LOOKALIKES = dict(
    zip(
        "авекмнорстухіјѕһԁԛɡıȷłøαβεικνορτυχɑɩ",
        "abekmhopctyxijshdqgijloabeikvoptuxai",
        strict=True,
    )
)
_DIGITS = dict(zip("013457@$", "oieast" + "as", strict=True))
_INSIDE = re.compile(r"(?<=\w)[@$]+(?=\w)")


class _Fold(dict):
    """Per character: lower case, marks off, look-alikes and digits to letters, the rest to blanks."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            c = _LOOKALIKES.get(c, _DIGITS.get(c, c))
            if c.isalnum():
                out += c
            elif not unicodedata.combining(c) and unicodedata.category(c) != "Cf":
                out += " "
        self[code] = out
        return out


_FOLD = _Fold()
for _c in "@$":
    _FOLD[ord(_c)] = " "


def fold(text: str) -> list[str]:
    """The folded words of a text; @ and $ count as letters only between letters or digits."""
    if "@" in text or "$" in text:
        text = _INSIDE.sub(lambda m: "".join(map(_DIGITS.get, m[0])), text)
    return text.translate(_FOLD).split()


@dataclass
class Model:
    """Folded words (" w ") and stems (" s") with weights, phrases that excuse a hit, calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = (-4.0, 1.0, 1.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(start, weight) of each word hit once by its heaviest entry, outside exception phrases."""
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for k, w in self.weights.items():
                self._machine.add_word(k, (len(k), w))
            for k in self.exceptions:
                self._machine.add_word(f" {k} ", (len(k) + 2, None))
            self._machine.make_automaton()
        if not len(self._machine):
            return []
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, w) in self._machine.iter(f" {' '.join(words)} "):
            begin = end - size + 1
            if w is None:
                excused.append((begin, end))
            elif w > found.get(begin, 0):
                found[begin] = w
        if not excused:
            return sorted(found.items())
        reach, out, k = -1, [], 0
        excused.sort()
        for b, w in sorted(found.items()):  # one pass: the furthest end of the phrases begun so far
            while k < len(excused) and excused[k][0] <= b:
                reach, k = max(reach, excused[k][1]), k + 1
            if b >= reach:
                out.append((b, w))
        return out

    def measures(self, text: str) -> tuple[float, float]:
        """Log of the summed weight, and of the weight per hundred words."""
        words = fold(text)
        total = sum(w for _, w in self.hits(words))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(words))))

    def score(self, text: str) -> float:
        a, b, c = self.coef
        x, y = self.measures(text)
        return float(1 / (1 + np.exp(-(a + b * x + c * y))))


def entries(word: str, stems: range) -> list[str]:
    """Lexicon entries that a folded word can hit: itself, and its proper prefixes."""
    return [f" {word} "] + [f" {word[:k]}" for k in stems if k < len(word)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, stems: range = range(4, 10), support: int = 3, evidence: float = 30.0, most: int | None = 4096) -> Model:
    """Learn lexicon, exception phrases and calibration from labelled documents.

    The fit uses at most `per_class` documents of each label, those of smallest hashed doc_id; this
    bound makes it independent of the size of the corpus, and only labels and ids are ranked to
    find them. Entries need `support` toxic documents and a log-likelihood ratio of `evidence`
    against the clean ones; the `most` strongest stay (None: all), and as many exception phrases. Of texts
    of one doc_id the first in order is learned from. Rows without label or text are left out; no
    usable rows give a model without entries.
    """
    shelf = Shelf(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = shelf.put(known)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        rate = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 10)
        return Model(coef=(float(np.log(rate / (1 - rate))), 0.0, 0.0))
    order = F.xxhash64("doc_id")
    chosen = known.filter("y = 1").orderBy(order).limit(per_class).unionByName(known.filter("y = 0").orderBy(order).limit(per_class))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = shelf.put(_without_copies(sample))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = max(1, size.get(1, 0)), max(1, size.get(0, 0))

    def count(wanted):
        """Documents per entry; of all entries, or of the wanted ones."""

        def run(batches):
            seen: dict[str, int] = {}
            for batch in batches:
                for t in texts_of(batch):
                    own = {e for w in set(fold(t)) for e in entries(w, stems)}
                    for e in own if wanted is None else own & wanted:
                        seen[e] = seen.get(e, 0) + 1
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])
                    seen = {}
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

        return lambda y: sample.filter(F.col("y") == y).select("text").repartition(12).mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    # an entry of n toxic documents has at most this evidence, so rarer ones need no clean count
    low = max(support, int(np.ceil(evidence / (2 * np.log((n1 + n0) / n1)))))
    toxic = {r["entry"]: r["n"] for r in count(None)(1).filter(F.col("n") >= low).collect()}
    clean = {r["entry"]: r["n"] for r in count(set(toxic))(0).collect()}
    ranked = []
    for e, a in toxic.items():
        b, p = clean.get(e, 0), n1 / (n1 + n0)
        n = a + b
        ratio = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        g = 2 * (a * np.log(a / (n * p)) + (b * np.log(b / (n * (1 - p))) if b else 0))
        if ratio > 2 and g >= evidence:
            ranked.append((-g, len(e), e, float(ratio)))
    weights: dict[str, float] = {}
    for _, _, e, w in sorted(ranked, key=lambda r: (r[0], not r[2].endswith(" "), r[1], r[2])):
        word = e.strip()
        if not any(f" {word[:k]}" in weights for k in stems if k <= len(word)) and (most is None or len(weights) < most):
            weights[e] = w
    model = Model(weights)

    def phrases(batches):
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            for t, y in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                words, own = fold(t), set()
                starts = np.cumsum([0] + [len(w) + 1 for w in words])
                for begin, _ in model.hits(words):
                    k = int(np.searchsorted(starts, begin))
                    own |= {" ".join(words[max(0, k - 1) : k + 1]), " ".join(words[k : k + 2])}
                for x in own:
                    if " " in x:
                        seen[x, y] = seen.get((x, y), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["phrase", "y", "n"])

    said = sample.select("text", "y").mapInArrow(phrases, "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    excuses = said.filter((F.col("c") >= 5) & (F.col("c") * F.lit(float(n1)) > F.col("t") * F.lit(20.0 * n0))).orderBy(F.desc("c"), "phrase")
    excuses = excuses if most is None else excuses.limit(most)
    model = Model(weights, sorted(r["phrase"] for r in excuses.collect()))

    def measure(batches):
        for batch in batches:
            m = np.array([model.measures(t) for t in texts_of(batch)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(m[:, 0]), pa.array(m[:, 1])], ["y", "total", "density"])

    rows = sample.select("text", "y").mapInArrow(measure, "y int, total double, density double").toPandas()
    if not len(rows):
        return model
    y = rows["y"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    model.coef = _logistic(rows[["total", "density"]].to_numpy(float), y, weight / weight.mean())
    return model


def _without_copies(sample: DataFrame, hashes: int = 4, words: int = 5) -> DataFrame:
    """The sample's rows without near copies, whose words would count as evidence again and again.

    Rows that share the smallest hash of their five-word shingles, under any of a few hash
    functions, are copies; of each such group the smallest doc_id stays. The sample is bounded.
    """
    from xxhash import xxh64_intdigest

    def run(batches):
        for batch in slices(batches):
            marks = []
            for t in texts_of(batch):
                w = fold(t)
                shingles = {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
                h = np.array([xxh64_intdigest(x) for x in shingles], np.uint64)
                marks.append([int(((h ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)).min().view(np.int64)) for k in range(1, hashes + 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "marks"])

    marks = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, marks array<long>").select("doc_id", F.posexplode("marks").alias("k", "mark"))
    first = marks.groupBy("k", "mark").agg(F.min("doc_id").alias("first"))
    kept = marks.join(first, ["k", "mark"]).groupBy("doc_id").agg(F.min("first").alias("first")).filter("first = doc_id").select("doc_id")
    return sample.join(F.broadcast(kept), "doc_id", "left_semi")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[float, ...]:
    """Newton's method with a ridge on all but the intercept."""
    x = np.column_stack((np.ones(len(x)), x))
    beta, hold = np.zeros(x.shape[1]), ridge * np.diag([0.02] + [1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, x.T @ (weight * (y - p)) - hold @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts score as without a hit.

    Repeated rows give repeated results, an empty table an empty one; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            s = [model.score(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose text scores below `limit`."""
    schema = docs.schema

    def run(batches):
        keep_one("lexicon", dict)
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t) < limit for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, schema)
