"""Language-model scores by prediction by partial matching over byte contexts of whole documents.

A document is its lower-cased words, each followed by a blank, and a line feed. Each byte is coded
after the ORDER bytes before it, across word boundaries: in the longest context that training has
seen, or after an escape in the next shorter one, without the symbols of the longer one. Escapes
take half a count of each distinct symbol (method D). The codes begun at the orders of STARTS are
blended, a longer one with weight n / (n + TRUST * q) for a context seen n times before q symbols.
At last a document's own words may repeat, with a weight of n / (strength + n) after n words: its
probability is the mixture over the strengths of this adaptation, no adaptation being one of them.

The counts never meet in one place: each block of documents sends its distinct windows of
ORDER + 1 bytes to tasks by hash, where they are added up; their sums go to tasks by the three bytes
before the symbol, which have all longer contexts, so each such task holds a part of the trie and
prices its windows; and the prices go back by the same ways. Only counts of windows of three bytes,
2^24 at most, are broadcast.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, keep_one, slices, texts_of, thrifty

#: Bytes of context, orders at which codes begin, symbols' weight against a longer context's uses.
ORDER, STARTS, TRUST = 6, (3, 4, 5, 6), 5.0
#: Orders of the broadcast table, by whose bytes the trie is parted.
LOW = 2
#: Characters of a block of documents, of the corpus per task, and symbols handled at once.
BLOCK_CHARS, TASK_CHARS, CHUNK = 14 << 20, 32 << 20, 1 << 20
#: Steps of a log10 probability while it travels: a byte's is exact to half a step.
STEPS = 2048
#: Strengths of the trained model against the document's own words, with their shares; the rest is the trained model alone.
STRENGTHS = {5000.0: 0.2, 1000.0: 0.2, 100.0: 0.1}
END = b"\n"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MADE = "kind byte, block long, part long, a binary, b binary, c binary"
_SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(values: np.ndarray, kind: str, steps: bool = False) -> bytes:
    """Compressed bytes of an array, place by place; with `steps`, of the differences of whole numbers."""
    import zstandard

    values = values.astype(kind)
    values = np.diff(values, prepend=values.dtype.type(0)) if steps else values
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes(), 3)


def loosen(data: bytes, kind: str, steps: bool = False) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=values.dtype) if steps else values


def squeeze_logs(logs: np.ndarray) -> bytes:
    """Log10 probabilities in steps of 1 / STEPS."""
    steps = np.rint(logs * -STEPS)
    wide = bool(steps.max(initial=0) >= 1 << 16)
    return bytes([wide]) + squeeze(steps, "<u4" if wide else "<u2")


def loosen_logs(data: bytes) -> np.ndarray:
    return loosen(data[1:], "<u4" if data[0] else "<u2").astype(np.float32) / np.float32(-STEPS)


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def mask(n: int) -> np.uint64:
    return np.uint64(2 ** (8 * n) - 1)


class Stream:
    """Symbols of documents given as runs of word numbers, in chunks of about CHUNK.

    Word `len(words)` is the padding before a text, ORDER line feeds, and the next one its end.
    """

    def __init__(self, words: list[bytes], seq: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.frombuffer(b"".join(w + b" " for w in words) + END * (ORDER + 1), np.uint8)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        sizes = np.append(sizes, [ORDER, 1])
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.pad, self.lengths = len(words), lengths
        docs = np.repeat(np.arange(len(lengths)), lengths)
        self.tokens = np.full(len(seq) + 2 * len(lengths), self.pad, np.int64)
        self.tokens[np.arange(len(seq)) + 2 * docs + 1] = seq
        self.last = np.cumsum(lengths + 2) - 1
        self.tokens[self.last] = self.pad + 1
        self.size = self.begin[self.tokens + 1] - self.begin[self.tokens]
        #: Windows up to the end of each document.
        self.ends = np.cumsum(self.size)[self.last] - ORDER * np.arange(1, len(lengths) + 1)

    def chunks(self):
        """First and last document, tokens (without paddings), packed windows, and the window at which each token begins."""
        first = 0
        while first < len(self.ends):
            base = self.ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(self.ends, base + CHUNK, "right")))
            run = slice(self.last[first - 1] + 1 if first else 0, self.last[stop - 1] + 1)
            own, n = self.tokens[run], self.size[run]
            at = np.cumsum(n) - n
            where = np.repeat((self.begin[own] - at).astype(np.int32 if len(self.flat) < 1 << 30 else np.int64), n)
            where += np.arange(len(where), dtype=where.dtype)
            data = self.flat[where]
            key = np.zeros(len(data), np.uint64)
            for k in range(ORDER, -1, -1):
                key <<= np.uint64(8)
                key[k:] |= data[: len(data) - k]
            word = own != self.pad
            yield first, stop, own[word], key[np.repeat(word, n)], (np.cumsum(n[word]) - n[word])
            first = stop


    def distinct(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct windows, and their uses in the documents of `learn`."""
        size = np.diff(self.ends, prepend=0)
        room = [np.empty(int(size[~learn].sum()), np.uint64), np.empty(int(size[learn].sum()), np.uint64)]
        held = [0, 0]
        for first, stop, _, key, _ in self.chunks():
            trained = np.repeat(learn[first:stop], size[first:stop])
            for y, own in enumerate((key[~trained], key[trained])):
                room[y][held[y] : held[y] + len(own)] = own
                held[y] += len(own)
        other, key = room
        del room
        key.sort()
        begin = _begins(key)
        n = np.diff(np.append(begin, len(key)))
        key = key[begin]
        other.sort()
        other = other[_begins(other)]
        if len(key):
            at = np.minimum(np.searchsorted(key, other), len(key) - 1)
            other = other[key[at] != other]
        at = np.searchsorted(key, other)
        return np.insert(key, at, other), np.insert(n, at, 0)


class Trie:
    """Byte contexts of orders up to ORDER: the low ones of the corpus, the others of some windows."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], key: np.ndarray, count: np.ndarray) -> None:
        self.entry, self.count, self.context, self.total, self.kinds, self.shared = [], [], [], [], [], []
        for k in range(ORDER + 1):
            of, n = low if k <= LOW else (key, count)
            entry, inverse = np.unique(of & mask(k + 1), return_inverse=True)
            n = np.bincount(inverse, n, len(entry))
            context, begin = np.unique(entry >> np.uint64(8), return_index=True)
            self.entry.append(entry)
            self.count.append(n)
            self.context.append(context)
            self.total.append(np.add.reduceat(n, begin) if len(n) else n)
            self.kinds.append(np.diff(np.append(begin, len(entry))).astype(float))
            if k and len(entry):  # what the shorter context counted of this one's symbols
                below = self.count[k - 1][np.searchsorted(self.entry[k - 1], entry & mask(k))]
                self.shared.append(np.add.reduceat(below, begin))
            else:
                self.shared.append(np.zeros(0))

    def _at(self, k: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts of order k, and which there are."""
        if not len(self.context[k]):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.context[k], context), len(self.context[k]) - 1)
        return at, self.context[k][at] == context

    def coded(self, key: np.ndarray, order: int) -> np.ndarray:
        """Log10 probability of each window's last symbol by escapes from `order` down, with exclusion."""
        logs, open_ = np.zeros(len(key)), np.ones(len(key), bool)
        gone, kinds = np.zeros(len(key)), np.zeros(len(key))  # excluded count at this order, and symbols
        for k in range(order, -1, -1):
            who = np.flatnonzero(open_)
            entry = key[who] & mask(k + 1)
            at, has = self._at(k, entry >> np.uint64(8))
            who, entry, at = who[has], entry[has], at[has]
            if not len(who):
                continue
            live, fresh = self.total[k][at] - gone[who], self.kinds[k][at] - kinds[who]
            place = np.minimum(np.searchsorted(self.entry[k], entry), len(self.entry[k]) - 1)
            hit = self.entry[k][place] == entry
            escape = np.where(fresh > 0, fresh / (2 * np.maximum(live, 1)), 1)
            logs[who[hit]] += np.log10((1 - escape[hit]) * self.count[k][place[hit]] / live[hit])
            open_[who[hit]] = False
            logs[who[~hit]] += np.log10(escape[~hit])
            kinds[who[~hit]] = self.kinds[k][at[~hit]]
            gone[who[~hit]] = self.shared[k][at[~hit]] if k else 0
        logs[open_] -= np.log10(np.maximum(1, 256 - kinds[open_]))
        return logs

    def log10(self, key: np.ndarray) -> np.ndarray:
        """The blend of the codes begun at STARTS."""
        p = np.power(10.0, self.coded(key, STARTS[0]))
        for k in STARTS[1:]:
            at, has = self._at(k, (key & mask(k + 1)) >> np.uint64(8))
            weight = np.zeros(len(key))
            n, q = self.total[k][at[has]], self.kinds[k][at[has]]
            weight[has] = n / (n + TRUST * q)
            some = np.flatnonzero(has)
            p[some] = weight[some] * np.power(10.0, self.coded(key[some], k)) + (1 - weight[some]) * p[some]
        return np.log10(p)


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole document.

    `learn` marks the training rows; no other column but doc_id and text is read. Null and empty
    texts are the end token alone; repeated rows give repeated results; with no training row all
    tokens are unknown and all bytes equally likely; an empty table gives an empty result. A text
    of any length is one document of its block.
    """
    shelf = Shelf(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-chars // TASK_CHARS) or 1
    made = shelf.put(rows.mapInArrow(_blocks(parts), _MADE))

    known = shelf.put(made.filter("kind = 1").select("block", "part", "a", "b").groupBy("part").applyInArrow(_count_words, "block long, part long, kinds long, b binary"))
    low = made.filter("kind = 3").select("a", "b").mapInArrow(_rows_of_low, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    low = low["key"].to_numpy().astype(np.uint64), low["n"].to_numpy().astype(float)
    ends = int(low[1][low[0] & mask(1) == END[0]].sum())
    tokens = ends + int(low[1][low[0] & mask(1) == 32].sum())
    base = {"tokens": tokens, "kinds": (known.agg(F.sum("kinds")).first()[0] or 0) + (ends > 0), "ends": ends}
    model = docs.sparkSession.sparkContext.broadcast(low)

    windows = made.filter("kind = 2").select("block", "part", "a", "b")
    sums = windows.groupBy("part").applyInArrow(_add(parts), "part long, at long, a binary, b binary")
    priced = sums.groupBy("at").applyInArrow(_price(model), "part long, a binary, b binary")
    answers = windows.groupBy("part").cogroup(priced.groupBy("part")).applyInArrow(_answer, "block long, part long, a binary, b binary")
    none = F.lit(None).cast("binary")
    texts = made.filter("kind = 0").select("block", "kind", "part", "a", "b", "c")
    words = made.filter("kind = 1").select("block", "kind", "part", "a", none.alias("b"), "c")
    uses = known.filter("block is not null").select("block", F.lit(2).cast("byte").alias("kind"), "part", none.alias("a"), "b", none.alias("c"))
    logs = answers.select("block", F.lit(3).cast("byte").alias("kind"), "part", "a", "b", none.alias("c"))
    rows = texts.unionByName(words).unionByName(uses).unionByName(logs)
    return rows.groupBy("block").applyInArrow(_sum_up(base), _SCORED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "block", "part", "a", "b", "c"])


def _begins(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])


def distinct(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some runs, with their summed counts; sorted runs are merged."""
    key = np.concatenate([*keys, np.zeros(0, np.uint64)])
    n = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begin = _begins(key)
    return key[begin], np.add.reduceat(n, begin) if len(n) else n


class Places:
    """Places of distinct keys, for many at a time: those asked for are sorted too, so that none jumps about."""

    def __init__(self, key: np.ndarray) -> None:
        self.key, mixed = key, key * _MIX
        self.order = np.argsort(mixed)
        self.mixed = mixed[self.order]
        self.short = self.mixed >> np.uint64(20)

    def find(self, asked: np.ndarray) -> np.ndarray:
        out = np.empty(len(asked), np.int64)
        for first in range(0, len(asked), 1 << 20):  # a number's place and 44 bits of its key make one word
            part = asked[first : first + (1 << 20)]
            word = (part * _MIX & ~np.uint64((1 << 20) - 1)) | np.arange(len(part), dtype=np.uint64)
            word.sort()
            own = out[first : first + len(part)]
            own[(word & np.uint64((1 << 20) - 1)).astype(np.int64)] = self.order[np.searchsorted(self.short, word >> np.uint64(20))]
            off = np.flatnonzero(self.key[own] != part)  # another key with the same bits
            own[off] = self.order[np.searchsorted(self.mixed, part[off] * _MIX)]
        return out



def _parted(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key * _MIX >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _context_part(key: np.ndarray, parts: int) -> np.ndarray:
    """The task of a window by the LOW + 1 bytes before its symbol."""
    return _parted(key >> np.uint64(8) & mask(LOW + 1), parts)


def _runs(part: np.ndarray):
    """Part and its places, in order."""
    order = np.argsort(part, kind="stable")
    values, begin = np.unique(part[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, begin[1:]) if len(values) else [], strict=True)


def _blocks(parts: int):
    """Rows of blocks of documents.

    Kind 0: ids, lengths and words' numbers of the documents; 1: distinct words of a part, their
    uses in training and numbers; 2: distinct windows of a part and their uses in training; 3: short
    windows and their uses, once a task.
    """
    import zstandard

    def rows_of(block: int, number: dict, ids: list, runs: list[np.ndarray], learn: list[bool], low: list):
        words, lengths = list(number), np.fromiter(map(len, runs), np.int64, len(runs))
        seq, learn = np.concatenate(runs), np.array(learn, bool)
        yield 0, block, 0, np.array(ids, np.int64).tobytes(), squeeze(lengths, "<i8"), squeeze(seq, "<i4")
        if words:
            uses = np.bincount(seq[np.repeat(learn, lengths)], minlength=len(words))
            hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
            for part, own in _runs(_parted(hashes, parts)):
                text = b"\n".join([words[k] for k in own.tolist()])
                yield 1, block, part, zstandard.compress(text, 1), squeeze(uses[own], "<i8"), squeeze(own, "<i4", True)
        stream = Stream(words, seq, lengths)
        del seq
        key, n = stream.distinct(learn)
        own = n > 0
        low.append(distinct([key[own] & mask(LOW + 1)], [n[own]]))
        for part, at in _runs(_parted(key, parts)):
            yield 2, block, part, squeeze(key[at], "<u8"), squeeze(n[at], "<i8"), None

    def run(batches):
        keep_one("counts", dict)
        block, low = TaskContext.get().partitionId() << 24, []

        def fresh():
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            return number, [], [], [], 0

        number, ids, runs, learn, held = fresh()
        for batch in slices(batches):
            for doc_id, text, y in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
                words = tokens_of(text)
                runs.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                learn.append(y)
                held += len(text)
                if held >= BLOCK_CHARS or len(ids) >= 50_000:
                    for row in rows_of(block, number, _ids(ids), runs, learn, low):
                        yield _batch([row])
                    low[:] = [distinct([k for k, _ in low], [n for _, n in low])]
                    block += 1
                    number, ids, runs, learn, held = fresh()
                    thrifty()
        if ids:
            for row in rows_of(block, number, _ids(ids), runs, learn, low):
                yield _batch([row])
        number, ids, runs, learn, held = fresh()
        thrifty()
        if low:
            key, n = distinct([k for k, _ in low], [n for _, n in low])
            yield _batch([(3, None, None, squeeze(key, "<u8", True), squeeze(n, "<i8"), None)])

    return run


#: What stands for a doc_id that is null while it travels as a number.
_NO_ID = -(2**63)


def _ids(ids: list) -> list[int]:
    return [_NO_ID if k is None else k for k in ids]


def _rows_of_low(batches):
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(loosen(a, "<u8", True).astype(np.int64)), pa.array(loosen(b, "<i8"))], ["key", "n"])


def _words_in(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.decompress(data).split(b"\n")


def _count_words(table: pa.Table) -> pa.Table:
    """The uses of the words of a part in all blocks, back to each; a row without block has the number of those with any."""
    total: defaultdict = defaultdict(int)
    rows = list(zip(table["block"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist(), strict=True))
    for _, a, b in rows:
        for w, n in zip(_words_in(a), loosen(b, "<i8").tolist(), strict=True):
            total[w] += n
    uses = [squeeze(np.array([total[w] for w in _words_in(a)], np.int64), "<i8") for _, a, _ in rows]
    parts = pa.array([table["part"][0].as_py()] * (len(rows) + 1), pa.int64())
    kinds = pa.array([sum(n > 0 for n in total.values())] + [None] * len(rows), pa.int64())
    return pa.table([pa.array([None] + [r[0] for r in rows], pa.int64()), parts, kinds, pa.array([None, *uses], pa.binary())], names=["block", "part", "kinds", "b"])


def _add(parts: int):
    """Uses in training of the distinct windows of a part, sent on by their contexts."""

    def run(table: pa.Table) -> pa.Table:
        thrifty()
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts, held = [key], [n], 0
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            keys.append(loosen(a, "<u8"))
            counts.append(loosen(b, "<i8"))
            held += len(keys[-1])
            if held > max(1 << 22, len(keys[0])):
                key, n = distinct(keys, counts)
                keys, counts, held = [key], [n], 0
        key, n = distinct(keys, counts)
        rows = [(at, squeeze(key[own], "<u8"), squeeze(n[own], "<i8")) for at, own in _runs(_context_part(key, parts))]
        at, a, b = zip(*rows, strict=True)
        return pa.table([pa.array([table["part"][0].as_py()] * len(rows), pa.int64()), pa.array(at, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "at", "a", "b"])

    return run


def _price(model):
    """All windows after some contexts: the trie of those seen in training prices each, and answers its part."""

    def run(table: pa.Table) -> pa.Table:
        thrifty()
        keys = [loosen(a, "<u8") for a in table["a"].to_pylist()]
        counts = [loosen(b, "<i8") for b in table["b"].to_pylist()]
        key, n = np.concatenate(keys), np.concatenate(counts)
        trie = Trie(model.value, key[n > 0], n[n > 0])
        logs = [np.concatenate([trie.log10(k[i : i + CHUNK]) for i in range(0, len(k), CHUNK)]) for k in keys]
        return pa.table([table["part"], table["a"], pa.array([squeeze_logs(x) for x in logs], pa.binary())], names=["part", "a", "b"])

    return run


def _answer(windows: pa.Table, priced: pa.Table) -> pa.Table:
    """The prices of each block's windows of a part."""
    thrifty()
    key = np.concatenate([loosen(a, "<u8") for a in priced["a"].to_pylist()])
    order = np.argsort(key)
    key, logs = key[order], np.concatenate([loosen_logs(b) for b in priced["b"].to_pylist()])[order]
    out = [squeeze_logs(logs[np.searchsorted(key, loosen(a, "<u8"))]) for a in windows["a"].to_pylist()]
    return pa.table([windows["block"], windows["part"], windows["a"], pa.array(out, pa.binary())], names=["block", "part", "a", "b"])


def _by(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by document, word and place."""
    bits = max(1, int(len(doc)).bit_length())
    room = max(1, int(word.max(initial=0)).bit_length())
    doc = doc - doc.min(initial=0)
    if int(doc.max(initial=0)).bit_length() + room + bits > 63:
        return np.lexsort((word, doc))
    packed = ((doc << room | word) << bits) | np.arange(len(doc))
    packed.sort()
    return packed & ((1 << bits) - 1)


def repeats(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each token of a document occurred in it before, and the number of tokens before it."""
    order = _by(doc, word)
    d, w = doc[order], word[order]
    place = np.arange(len(doc))
    new = np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))[: len(doc)]
    again = np.empty(len(doc), np.int64)
    again[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    begin = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    return again, place - np.maximum.accumulate(np.where(begin, place, 0))


def adapted(logs: np.ndarray, again: np.ndarray, before: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log10 probabilities of documents, which begin at `begin`, under the mixture of adaptations."""
    by = [np.add.reduceat(logs, begin) + np.log10(1 - sum(STRENGTHS.values()))]
    old = np.flatnonzero(again)
    for strength, share in STRENGTHS.items():
        own = logs + np.log10(strength)
        own[old] = np.log10(np.power(10.0, own[old]) + again[old])
        by.append(np.add.reduceat(own - np.log10(strength + before), begin) + np.log10(share))
    by = np.stack(by)
    top = by.max(0)
    return top + np.log10(np.power(10.0, by - top).sum(0))


def _sum_up(base: dict):
    room = base["tokens"] + 0.5 * (base["kinds"] + 1)

    def read(table: pa.Table):
        """ids, lengths, words, uses of the words in training, windows and their log10 probabilities."""
        kind = table["kind"].to_numpy()
        by = {k: table.filter(pa.array(kind == k)).sort_by("part") for k in range(4)}
        ids, lengths, seq = (by[0][c][0].as_py() for c in "abc")
        ids, lengths, seq = np.frombuffer(ids, np.int64), loosen(lengths, "<i8"), loosen(seq, "<i4")
        number = [loosen(c, "<i4", True) for c in by[1]["c"].to_pylist()]
        words: list[bytes] = [b""] * sum(map(len, number))
        uses = np.zeros(len(words) + 2)
        for a, b, own in zip(by[1]["a"].to_pylist(), by[2]["b"].to_pylist(), number, strict=True):
            uses[own] = loosen(b, "<i8")
            for w, k in zip(_words_in(a), own.tolist(), strict=True):
                words[k] = w
        uses[-1] = base["ends"]
        stream = Stream(words, seq, lengths)
        key = np.concatenate([loosen(a, "<u8") for a in by[3]["a"].to_pylist()])
        logs = np.concatenate([loosen_logs(b) for b in by[3]["b"].to_pylist()])
        return ids, lengths, stream, uses, Places(key), logs

    def run(table: pa.Table) -> pa.Table:
        thrifty()
        ids, lengths, stream, uses, places, logs = read(table)
        plain = np.log10((uses + 0.5) / room)
        known, flat, scores = [], [], []
        for first, stop, token, key, begin in stream.chunks():
            size = lengths[first:stop] + 1
            docs = np.cumsum(size) - size
            spelled = np.add.reduceat(logs[places.find(key)].astype(float), begin)
            again, before = repeats(np.repeat(np.arange(first, stop), size), token)
            known.append(np.add.reduceat((uses[token] > 0).astype(np.int64), docs))
            flat.append(np.add.reduceat(plain[token], docs))
            scores.append(adapted(spelled, again, before, docs))
        n = len(ids)
        doc_ids = pa.array(ids, mask=ids == _NO_ID)
        return pa.table([doc_ids, pa.array(lengths + 1), pa.array(np.concatenate(known)), pa.array([base["tokens"]] * n, pa.int64()), pa.array(np.concatenate(flat)), pa.array(np.concatenate(scores))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run
