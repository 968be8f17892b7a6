"""Corpus-level replay of byte-pair merges over a block of distinct words.

All words lie in one symbol array. An inverted index maps each merge rank to the positions whose
pair it joins; ranks are taken in order, each merge is applied at all its positions at once, and
only the touched neighbours get new pairs. Word ids are then cached by the caller.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np

NONE = np.int32(2**31 - 1)
_KEY = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Open-addressed hash of distinct 64-bit keys, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.at = np.full(size, NONE, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(todo):
            free = self.at[slot] == NONE
            place, first = np.unique(slot[free], return_index=True)
            who = todo[free][first]
            self.keys[place], self.at[place] = keys[who], who
            stay = self.at[slot] != todo
            todo, slot = todo[stay], (slot[stay] + 1) % size
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _KEY) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find_keys(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, NONE where it is absent."""
        slot = self._slot(keys)
        at = self.at[slot]
        hit = self.keys[slot] == keys
        out = np.where(hit, at, NONE)
        open_ = np.flatnonzero(~hit & (at != NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot_ = (slot[open_] + 1) % len(self.at)
            slot[open_] = slot_
            at, hit = self.at[slot_], self.keys[slot_] == keys[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (at != NONE)]
        return out


class PairTable(KeyTable):
    """(left, right) -> (rank, joined id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, joined: np.ndarray) -> None:
        super().__init__(self._keys(left, right))
        self.rank, self.joined = rank.astype(np.int32), joined.astype(np.int32)

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.find_keys(self._keys(left, right))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


class MergeReplay:
    """Encodes blocks of words from a pair table and the symbol of each byte (and of a last byte)."""

    def __init__(self, table: PairTable, symbols: np.ndarray, last: np.ndarray | None = None) -> None:
        self.table, self.symbols, self.last = table, symbols, last

    @classmethod
    def from_ranks(cls, path: str) -> "MergeReplay":
        """A tiktoken rank file; a pair may be joined wherever its bytes are a token."""
        ranks = load_ranks(path)
        rows = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    rows.append((a, b, rank))
        rows.sort(key=lambda r: r[2])
        a, b, r = np.array(rows, np.int64).T
        return cls(PairTable(a, b, r, r), np.array([ranks[bytes([i])] for i in range(256)], np.int32))

    @classmethod
    def from_word_ends(cls, path: str) -> "MergeReplay":
        """A tokenizers file of byte-level BPE whose words end in </w>."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rows = np.array([(vocab[x], vocab[y], i, vocab[x + y]) for i, (x, y) in enumerate(merges)], np.int64).T
        chars = byte_letters()
        return cls(PairTable(*rows), np.array([vocab[c] for c in chars], np.int32), np.array([vocab[c + "</w>"] for c in chars], np.int32))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return [b""] * len(words)
        sym = self.symbols[raw]
        full = lengths > 0
        final = ends[full] - 1
        if self.last is not None:
            sym[final] = self.last[raw[final]]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[final] = -1
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[(ends - lengths)[full]] = -1
        table, alive = self.table, np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        made = np.full(n, NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> np.ndarray:
            """New pairs starting at `at` go to the index; their ranks are returned."""
            found = table.find(sym[at], sym[nxt[at]])
            has = found != NONE
            rank[at] = NONE
            at, found = at[has], found[has]
            r = table.rank[found]
            rank[at], made[at] = r, table.joined[found]
            if len(r) == 1:
                groups = [(int(r[0]), at)]
            else:
                order = np.argsort(r)
                at, sorted_ = at[order], r[order]
                cut = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
                groups = zip(sorted_[np.r_[0, cut]].tolist() if len(r) else [], np.split(at, cut), strict=False)
            for k, where in groups:
                if k in index:
                    index[k].append(where)
                else:
                    index[k] = [where]
                    heapq.heappush(heap, k)
            return r

        note(np.flatnonzero(nxt >= 0))
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = distinct(at)
                run = np.zeros(len(at), bool)
                run[1:] = nxt[at[:-1]] == at[1:]
                if run.any():  # overlapping pairs such as aaa: the leftmost goes first
                    k = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(run, 0, k))
                    at = at[(k - begin) % 2 == 0]
            gone = nxt[at]
            sym[at] = made[at]
            after = nxt[gone]
            nxt[at] = after
            right = after >= 0
            prv[after[right]] = at[right]
            rank[gone], alive[gone] = NONE, False
            rank[at] = NONE
            left = prv[at]
            touched = np.concatenate((at[right], left[left >= 0]))
            if len(touched):
                if len(touched) > 1:
                    touched = distinct(touched)
                new = note(touched)
                if len(new) and new.min() < r:
                    odd.append(touched[rank[touched] < r])
        keep = np.flatnonzero(alive)
        ids = sym[keep].astype("<u4")
        stops = np.searchsorted(keep, ends, "left").tolist()
        data, out, begin = ids.tobytes(), [], 0
        for stop in stops:
            out.append(data[4 * begin : 4 * stop])
            begin = stop
        if odd:  # a merge made a pair of an earlier rank: those words are done one by one
            for w in np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist():
                out[w] = self.encode_one(words[w])
        return out

    def encode_one(self, word: bytes) -> bytes:
        """One word by the definition: again and again the leftmost pair of the lowest rank."""
        parts = self.symbols[np.frombuffer(word, np.uint8)].copy()
        if self.last is not None and len(parts):
            parts[-1] = self.last[word[-1]]
        while len(parts) > 1:
            found = self.table.find(parts[:-1], parts[1:])
            ranks = np.where(found == NONE, NONE, self.table.rank[np.where(found == NONE, 0, found)])
            k = int(np.argmin(ranks))
            if ranks[k] == NONE:
                break
            parts = np.concatenate((parts[:k], [self.table.joined[found[k]]], parts[k + 2 :])).astype(np.int32)
        return parts.astype("<u4").tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i) if i in plain else chr(next(rest)) for i in range(256)]
