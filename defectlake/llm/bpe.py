"""Byte-level BPE encoding and decoding of whole documents."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keep_one, texts_of
from .merges import MergeReplay, load_ranks

#: Words kept per worker between blocks; beyond it the cache starts anew. Affects speed only.
CACHE_WORDS = 400_000


def _codec(path: str, pattern: str) -> "Codec":
    return keep_one(("bpe", path, pattern), lambda: Codec(path, pattern))


class Codec:
    """Encoder and decoder of one worker; a block's new words are replayed together."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.replay = MergeReplay.from_ranks(path)
        self.table = [b""] * (1 + max(ranks := load_ranks(path).values()))
        for token, rank in load_ranks(path).items():
            self.table[rank] = token
        self.pieces: dict[str, bytes] = {}
        self.head: dict[str, bytes | None] = {}
        self.body: dict[str, bytes | None] = {}

    def learn(self, chunks: dict[str, set[str]]) -> None:
        """Encode unseen chunks: split them by the pattern, replay the unseen matches at once."""
        if len(self.pieces) + len(self.head) + len(self.body) > CACHE_WORDS * 2:
            self.pieces, self.head, self.body = {}, {}, {}
        todo, new = [], set()
        for lead, cache, seen in (("", self.head, chunks["head"]), (" ", self.body, chunks["body"])):
            unseen = [c for c in seen if c not in cache]
            # white space at an edge may join its neighbours'
            matches = [self.pattern.findall(lead + c) if c and not c[0].isspace() and not c[-1].isspace() else None for c in unseen]
            for m in matches:
                if m:
                    new.update(m)
            todo.append((cache, unseen, matches))
        self.encode_pieces(new)
        get, join = self.pieces.__getitem__, b"".join
        for cache, unseen, matches in todo:
            cache.update(zip(unseen, [None if m is None else join(map(get, m)) for m in matches], strict=True))

    def encode_pieces(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        self.pieces.update(zip(new, self.replay.encode([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A single blank or newline between two visible characters always begins a new match, so
        such texts are looked up chunk by chunk; all others are matched as a whole.
        """
        split = [[line.split(" ") for line in t.split("\n")] for t in texts]
        chunks: dict[str, set[str]] = {"head": set(), "body": set()}
        for lines in split:
            for words in lines:
                chunks["head"].add(words[0])
                chunks["body"].update(words[1:])
        gc.disable()  # nothing here is cyclic, and collections over large caches are slow
        try:
            self.learn(chunks)
            self.encode_pieces({"\n"})
        finally:
            gc.enable()
        newline = self.pieces["\n"]
        for text, lines in zip(texts, split, strict=True):
            try:
                yield newline.join([self.head[words[0]] + b"".join(map(self.body.__getitem__, words[1:])) for words in lines])
            except TypeError:
                matches = self.pattern.findall(text)
                self.encode_pieces(set(matches))
                yield b"".join(map(self.pieces.__getitem__, matches))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _blocks(batches, size: int = 16 << 20):
    """Slices of batches with about `size` characters, so that a block's memory is bounded."""
    for batch in batches:
        texts = texts_of(batch)
        begin = held = 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= size or k == len(texts) - 1:
                yield batch.slice(begin, k + 1 - begin), texts[begin : k + 1]
                begin, held = k + 1, 0


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text's ids, array<long>; null and empty texts give an empty array."""

    def run(batches):
        codec = _codec(path, pattern)
        for batch, texts in _blocks(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in codec.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""

    def run(batches):
        codec = _codec(path, pattern)
        for batch in batches:
            data = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of encoding and decoding every document in one pass, without moving the ids.

    Ties cannot occur; repeated rows give repeated results; an empty table an empty result; other
    columns are not read.
    """

    def run(batches):
        codec = _codec(path, pattern)
        for batch, texts in _blocks(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in codec.encode(texts):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
