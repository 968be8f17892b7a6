"""Packing by lexical retrieval: sharded BM25 neighbours fill each seed document's window."""

from __future__ import annotations

import gc
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import keep_one, slices, texts_of
from .merges import MergeReplay

WINDOW = 2048
#: Words kept per worker; bytes hashed at once; characters and documents of one BM25 shard.
CACHE_WORDS, SLICE, SHARD_CHARS, SHARD_DOCS = 650_000, 1 << 19, 5 << 20, 4096
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokens(path: str) -> "WordTokens":
    return keep_one(("words", path), lambda: WordTokens(path))


class WordIndex:
    """Numbers of words by a 64-bit hash, in open-addressed arrays of fixed size; `same` says which answers hold."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)
        self.bytes, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        slot = self._slot(keys)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            at = self.at[slot]
            out[open_] = at
            more = (at >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[more], slot[more]
        return out

    def same(self, at: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the words data[begin:end] are the known ones of the numbers `at`, by all their bytes."""
        size = end - begin
        out = self.begin[at + 1] - self.begin[at] == size
        held = np.concatenate((self.bytes, np.zeros(8, np.uint8)))
        for k in range(0, int(size.max(initial=0)), 8):  # eight bytes a step, shorter ends masked
            who = np.flatnonzero(out & (size > k))
            if not len(who):
                break
            own, other = _eight(held, self.begin[at[who]] + k), _eight(data, begin[who] + k)
            left = np.minimum(size[who] - k, 8).astype(np.uint64)
            out[who] = ((own ^ other) << (np.uint64(8) * (np.uint64(8) - left))) == 0
        return out

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Numbers new distinct words, of distinct hashes, from the present size on."""
        number = np.arange(len(self), len(self) + len(keys), dtype=np.int32)
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(words), np.uint8)))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.at[slot] < 0)
            place, first = np.unique(slot[free], return_index=True)
            who = todo[free[first]]
            self.keys[place], self.at[place] = keys[who], number[who]
            stay = self.at[slot] != number[todo]
            todo, slot = todo[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, little-endian; there are eight more bytes than places need."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))[at].view("<u8").ravel()


#: A random value per byte, and an odd multiplier with its inverse: a word's hash is the sum of value x multiplier^place.
_VALUES = np.random.default_rng(11).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Kinds of bytes: 1 blank, 2 ASCII letter or digit, 3 other ASCII, 0 part of a longer character.
_KIND = np.array([1 if chr(b) in "\t\n\v\f\r " else 2 if b < 128 and chr(b).isalnum() else 3 if b < 128 else 0 for b in range(256)], np.uint8)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _powers.get(0, (np.zeros(0),))[0].size:
        up, down = np.full(n, _STEP, np.uint64), np.full(n, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers[0] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[0][0][:n], _powers[0][1][:n]


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the runs between ASCII blanks.

    ASCII marks that end a run after an ASCII letter or digit are a word of their own: the
    vocabulary's pattern cuts there anyway, and the word before is then more often a known one.
    """
    kind = _KIND[data]
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = kind == 1
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edge[::2], edge[1::2]
    if len(end):
        solid = np.maximum.accumulate(np.where(kind == 3, -1, np.arange(len(data), dtype=np.int64)))
        last = solid[end - 1]
        cut = last[(last >= begin) & (last < end - 1) & (kind[np.maximum(last, 0)] == 2)] + 1
        if len(cut):
            begin, end = np.sort(np.concatenate((begin, cut))), np.sort(np.concatenate((end, cut)))
    up, down = _powers_of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:-1], out=sums[1:])
    return begin, end, (sums[end] - sums[begin]) * down[begin]


class WordTokens:
    """Ids of a word-end BPE vocabulary, one cached entry per distinct white-space word.

    Texts are cut and their words looked up by arrays; Python sees only the words not met before.
    """

    def __init__(self, path: str) -> None:
        import regex

        self.path = path
        self.pattern = regex.compile(PIECES + r"|\n")
        #: Characters that Python and the library lower-case or split differently: the library does those texts.
        self.odd = regex.compile("[\x1c-\x1fİΣ]")
        self.wide = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.replay = MergeReplay.from_word_ends(path)
        self.library = None
        self.clear()

    def clear(self) -> None:
        self.index = WordIndex(int(np.ceil(np.log2(CACHE_WORDS * 3))))
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, new: list[bytes]) -> None:
        """Encode unseen words: split them all at once, replay their distinct pieces at once."""
        import unicodedata

        joined = b"\n".join(new).decode("utf-8", "surrogatepass")
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).lower()
        found = self.pattern.findall(joined)
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        number["\n"]
        at = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        ids = self.replay.encode([b"", *(p.encode("utf-8", "surrogatepass") for p in itertools.islice(number, 1, None))])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.concatenate(([0], np.cumsum(sizes)))
        word = np.cumsum(at == 0)
        own, size = spread(np.frombuffer(b"".join(ids), "<u4"), begin, at)
        per_word = np.bincount(word, size, len(new)).astype(np.int64)
        self.flat = np.concatenate((self.flat, own))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(per_word)))

    def encode(self, texts: list[str], last: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text, then `last`; and the numbers of its words, as terms."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        odd, parts = [], []
        for text in texts:
            strange = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else self.odd.search(text)
            odd.append(bool(strange))
            lower = text.lower()
            if not lower.isascii():
                lower = self.wide.sub(" ", lower)
            parts.append(lower.encode("utf-8", "surrogatepass"))
        stops = np.cumsum([len(p) + 1 for p in parts])
        data = np.frombuffer(b" ".join(parts), np.uint8)
        begins, ends, firsts = [], [], []
        done = 0
        while done < len(data):  # slices that end at a blank keep the arrays of hashes small
            stop = min(len(data), done + SLICE)
            while stop < len(data) and data[stop] != 32:
                stop += 1
            b, e, h = words_in(data[done:stop])
            begins.append(b + done)
            ends.append(e + done)
            firsts.append(h)
            done = stop
        begin, end, first = (np.concatenate(x) if x else np.zeros(0, np.uint64 if x is firsts else np.int64) for x in (begins, ends, firsts))
        at = self.index.find(first)
        gap = np.flatnonzero(at < 0)
        if len(gap):
            new, where = np.unique(first[gap], return_index=True)
            where = gap[where]
            gc.disable()  # nothing here is cyclic, and collections over large lists are slow
            try:
                learned = [data[a:b].tobytes() for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
                self.learn(learned)
            finally:
                gc.enable()
            self.index.add(new, learned)
            at[gap] = self.index.find(first[gap])
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        clash = np.flatnonzero(~self.index.same(at, padded, begin, end))
        for k in np.searchsorted(stops, begin[clash], "right").tolist():
            odd[k] = True  # a word with another's hash: the library does its text
        cut = np.searchsorted(begin, stops[:-1])
        del data, padded, parts, begins, ends, firsts, begin, end, first
        terms = np.split(at, cut)
        flat, size = spread(self.flat, self.begin, at)
        sums = np.concatenate(([0], np.cumsum(size)))
        bounds = sums[np.concatenate(([0], cut, [len(at)]))]
        ids = []
        for k, (text, strange) in enumerate(zip(texts, odd, strict=True)):
            own = self.whole(text) if strange else flat[bounds[k] : bounds[k + 1]]
            out = np.empty(len(own) + 1, "<u4")
            out[:-1], out[-1] = own, last
            ids.append(out)
        return ids, terms


def spread(flat: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin[k] : begin[k + 1]] for k of `at`, one after another, and their sizes."""
    first = begin[at]
    size = begin[at + 1] - first
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    where = np.repeat((first - (stop - size)).astype(kind), size)
    where += np.arange(total, dtype=kind)
    return flat[where], size


class Bm25:
    """Inverted index of one shard; a query takes all terms of a document."""

    def __init__(self, terms: list[np.ndarray], k1: float = 1.2, b: float = 0.75) -> None:
        n = len(terms)
        sizes = np.array([len(t) for t in terms], float)
        both = (np.repeat(np.arange(n, dtype=np.int64), sizes.astype(np.int64)) << 32) | np.concatenate([*terms, np.zeros(0, np.int32)]).astype(np.int64)
        both.sort()
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(both))).astype(np.float32)
        doc, term = (both[new] >> 32).astype(np.int32), both[new] & 0xFFFFFFFF
        _, term = np.unique(term, return_inverse=True)
        term = term.astype(np.int32)
        df = np.bincount(term)
        keep = df[term] > 1  # a term of one document finds no neighbour
        doc, term, count = doc[keep], term[keep], count[keep]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[term] * count * (k1 + 1) / (count + k1 * (1 - b + b * sizes[doc] / max(1.0, sizes.mean())))
        order = np.argsort(term)
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(df)))))
        first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        self.asked = [term[first[i] : first[i + 1]] for i in range(n)]
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """The best unused documents for `seed`, all or at least `most` of them, best first, ties to the earlier one."""
        terms = self.asked[seed]
        if not len(terms):
            return terms
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms.tolist()]
        doc = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(doc, np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        if most is not None and len(found) > most:
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return found[np.lexsort((found, -score[found]))]


class Packer:
    """Fills sequences without gaps; the last one of a partition is cut into powers of two."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.sequence, self.used = window, first, 0
        self.rows: list[tuple] = []
        self.open: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray) -> None:
        done = 0
        while done < len(ids):
            n = min(len(ids) - done, self.window - self.used)
            self.open.append((doc_id, done, ids[done : done + n], len(ids), self.used))
            done, self.used = done + n, self.used + n
            if self.used == self.window:
                self.close()

    def close(self) -> None:
        for doc_id, start, ids, total, offset in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def finish(self) -> None:
        pieces, left = self.open, self.used
        self.open, self.used = [], 0
        whole = self.window
        while pieces:
            self.window = 1 << (left.bit_length() - 1)
            rest = []
            for doc_id, start, ids, total, _ in pieces:
                n = min(len(ids), self.window - self.used)
                if n:
                    self.open.append((doc_id, start, ids[:n], total, self.used))
                    self.used += n
                if n < len(ids):
                    rest.append((doc_id, start + n, ids[n:], total, 0))
            left -= self.window
            self.close()
            pieces = rest
        self.window = whole

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, path: str, last: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document in a sequence of at most `window` tokens.

    Each input partition is cut into shards of bounded size with a BM25 index of their own. A seed
    document opens a window; its best unused neighbours follow, best first, and the one that does not
    fit is cut, and what is left of it seeds the next window. Nothing is shuffled, and all
    sequences are full, but for those of powers of two that end a partition. `sequence_id` is the
    partition's number times 2^40 and a counter. Null and empty texts are the `last` id alone;
    repeated rows are packed each; an empty table gives an empty result.
    """

    def run(batches):
        tokens = _tokens(path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for doc_ids, texts in _shards(batches):
            ids, terms = tokens.encode(texts, last)
            fill(packer, doc_ids, ids, Bm25(terms))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def fill(packer: Packer, doc_ids: list, ids: list[np.ndarray], index: Bm25, ask: int = 16) -> None:
    """Packs all documents: after a seed its best unused neighbours, asked for `ask` at a time; the one that does not fit is cut and seeds the next window."""
    unused = np.ones(len(ids), bool)
    sizes = np.array([len(x) for x in ids])
    for first in range(len(ids)):
        seed = first
        while unused[seed]:
            unused[seed] = False
            packer.put(doc_ids[seed], ids[seed])
            while packer.used and not unused[seed]:
                near = index.neighbours(seed, unused, ask)
                if not len(near):
                    break
                for k in near.tolist():
                    if sizes[k] > packer.window - packer.used:
                        seed = k
                        break
                    unused[k] = False
                    packer.put(doc_ids[k], ids[k])
                    if not packer.used:
                        break


def _shards(batches):
    doc_ids, texts, held = [], [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held >= SHARD_CHARS or len(texts) >= SHARD_DOCS:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
    if texts:
        yield doc_ids, texts
