"""Exact top-k inner products from a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf

#: Rows of an index block, queries of a query block, and query blocks that meet an index block in one task: all bound a task's memory.
BLOCK_ROWS, BLOCK_QUERIES, MEET = 32_768, 128, 64
#: Components from which a row is kept as whole numbers, in blocks of such rows only, instead of slices.
WIDE = 1 << 40
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors with null or non-finite ones go."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform(double, lambda x: F.floor(x * scale)).alias("v")).withColumn("dims", F.size("v")).withColumn("wide", F.exists("v", lambda x: (x >= WIDE) | (x <= -WIDE)))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Lowest value, bits and bit slices (64 rows a word) of each column of whole numbers."""
    n, low = len(values), values.min(0)
    words = -(-n // 64)
    bits = [int(x).bit_length() for x in values.max(0) - low]
    out = np.zeros((sum(bits), words), np.uint64)
    k = 0
    for d, b in enumerate(bits):
        column = (values[:, d] - low[d]).astype(np.uint64)
        for j in range(b):
            packed = np.zeros(words * 8, np.uint8)
            row = np.packbits(((column >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            packed[: len(row)] = row
            out[k] = packed.view(np.uint64)
            k += 1
    return low, bits, out


def digits_of(q: int) -> list[tuple[int, int]]:
    """Signed binary digits (shift, sign) of q with no two neighbours set: the fewest there are."""
    out, shift = [], 0
    while q:
        if q & 1:
            s = 2 - (q & 3)
            out.append((shift, s))
            q -= s
        q >>= 1
        shift += 1
    return out


class Adder:
    """Carry-save sum of shifted operands, each a run of bitmaps from the least significant up."""

    def __init__(self, rows: int, words: int) -> None:
        self.sum, self.carry = np.zeros((rows, words), np.uint64), np.zeros((rows + 1, words), np.uint64)
        self.t, self.u = np.empty((rows, words), np.uint64), np.empty((rows, words), np.uint64)
        self.top = 0

    def clear(self) -> None:
        self.sum[: self.top + 2] = 0
        self.carry[: self.top + 2] = 0
        self.top = 0

    def add(self, x: np.ndarray, shift: int, flip: bool) -> None:
        """Adds x << shift, or the complement of x in its own width."""
        end = shift + len(x)
        # above the operand sum and carry may stay as they are; below it too
        s, c, t, u = self.sum[shift:end], self.carry[shift:end], self.t[: len(x)], self.u[: len(x)]
        if flip:
            x = np.bitwise_not(x)
        np.bitwise_xor(s, x, out=t)
        np.bitwise_and(s, x, out=u)
        np.bitwise_xor(t, c, out=s)
        np.bitwise_and(t, c, out=t)
        np.bitwise_or(t, u, out=t)  # carries, one row up
        c[0] = 0
        left = self.carry[end].copy()
        self.carry[shift + 1 : end] = t[:-1]
        # the row above holds a carry already: add the new one there, and on
        new, k = t[-1], end
        self.carry[end] = left
        while new.any():
            if k >= len(self.sum):
                raise OverflowError("the adder is too narrow")
            a, b = self.sum[k], self.carry[k]
            part = a ^ b
            out = (a & b) | (part & new)
            self.sum[k] = part ^ new
            self.carry[k] = 0
            new = out
            k += 1
        self.top = max(self.top, k)

    def total(self) -> np.ndarray:
        """The sum, one bitmap a row."""
        carry = np.zeros(self.sum.shape[1], np.uint64)
        out = np.empty_like(self.sum)
        for k in range(len(out)):
            a, b = self.sum[k], self.carry[k]
            part = a ^ b
            out[k] = part ^ carry
            carry = (a & b) | (part & carry)
        return out


def top_rows(total: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k greatest sums, found from the most significant slice down; ties to the first rows."""
    sure, equal = np.zeros_like(allowed), allowed.copy()
    held = 0
    for row in total[::-1]:
        some = equal & row
        n = int(np.bitwise_count(some).sum())
        if held + n > k:
            equal = some
        else:
            sure |= some
            equal &= ~row
            held += n
            if held == k:
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if held < k:
        chosen = np.concatenate((chosen, np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))[: k - held]))
    return chosen


def values_of(n: int, low: np.ndarray, bits: list[int], slices: np.ndarray) -> np.ndarray:
    """The whole numbers that a block was sliced from, as Python numbers."""
    out, k = np.zeros((n, len(bits)), object), 0
    for d, b in enumerate(bits):
        for j in range(b):
            out[:, d] += np.unpackbits(slices[k].view(np.uint8), bitorder="little")[:n].astype(object) << j
            k += 1
        out[:, d] += int(low[d])
    return out


def search_rows(ids: np.ndarray, values: np.ndarray, query_id: int, q: list[int], k: int):
    """(query, row, score) by exact numbers; a score beyond 64 bits counts as the nearest that has them."""
    scores = values.astype(object) @ np.array(q, object) if len(q) else np.zeros(len(ids), object)
    near = [max(-(2**63), min(2**63 - 1, s)) for s in scores.tolist()]
    for s, r in sorted((-s, r) for r, s in zip(ids.tolist(), near, strict=True) if r != query_id)[:k]:
        yield query_id, r, -s


def search_block(ids: np.ndarray, low: np.ndarray, bits: list[int], slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, row, score) of the k best rows of one block for each query of another."""
    n, words = len(ids), -(-len(ids) // 64)
    begin = np.concatenate(([0], np.cumsum(bits))).astype(int)
    allowed = np.zeros(words * 8, np.uint8)
    full = np.packbits(np.ones(n, np.uint8), bitorder="little")
    allowed[: len(full)] = full
    allowed = allowed.view(np.uint64)
    values = None
    for query_id, q in zip(query_ids.tolist(), queries.tolist(), strict=True):
        base, most, groups = 0, 0, {}
        for d, x in enumerate(q):
            base += x * int(low[d])
            if not bits[d]:
                continue
            for shift, sign in digits_of(x):
                groups.setdefault(shift, []).append((d, sign < 0))
                most += ((1 << bits[d]) - 1) << shift
                if sign < 0:
                    base -= ((1 << bits[d]) - 1) << shift
        if abs(base) + most >= 2**63:
            values = values_of(n, low, bits, slices) if values is None else values
            yield from search_rows(ids, values, query_id, q, k)
            continue
        adder = Adder(max(1, most.bit_length()), words)
        for shift, operands in groups.items():
            for d, flip in operands:
                adder.add(slices[begin[d] : begin[d + 1]], shift, flip)
        total = adder.total()
        rows = np.flatnonzero(ids == query_id)
        open_ = allowed
        if len(rows):
            open_ = allowed.copy()
            for r in rows.tolist():
                open_[r // 64] &= ~np.uint64(1 << (r % 64))
        for r in top_rows(total, open_, k).tolist():
            score = sum(((int(total[j, r // 64]) >> (r % 64)) & 1) << j for j in range(len(total)))
            yield query_id, int(ids[r]), score + base


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k greatest whole-number inner products.

    Components become floor(scale * x). The index holds, for blocks of rows, one bitmap per bit of
    each component; per query the slices are added, shifted by the query's signed digits, by bitmap
    arithmetic, and the top rows are selected from the most significant slice down. Every query
    block meets every index block of its dimension once; the blocks' winners are then ranked.
    Ties go to the smaller vec_id; rows with the query's own vec_id are left out; vectors that are
    null or hold null or non-finite components take no part; other columns are not read. Scores are
    computed exactly; one beyond 64 bits, like a component beyond them, counts as the nearest number
    that has them.
    """
    shelf = Shelf(vectors.sparkSession)
    rows = shelf.put(quantised(vectors, scale))
    counts = {(r["dims"], r["wide"]): (r["n"], r["q"] or 0) for r in rows.groupBy("dims", "wide").agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("q")).collect()}
    asking: dict[int, int] = {}
    for (dims, _), (_, q) in counts.items():
        asking[dims] = asking.get(dims, 0) + q

    def of_dims(numbers: dict, otherwise: int = 1):
        """A number by dimensions, or by dimensions and whether rows are wide."""
        out = F.lit(otherwise)
        for key, n in numbers.items():
            dims, wide = key if isinstance(key, tuple) else (key, None)
            out = F.when((F.col("dims") == dims) & (F.lit(True) if wide is None else F.col("wide") == wide), F.lit(n)).otherwise(out)
        return out

    held = {key: -(-n // BLOCK_ROWS) for key, (n, _) in counts.items()}
    blocks = {dims: -(-q // BLOCK_QUERIES) for dims, q in asking.items() if q}
    parts = {dims: -(-n // MEET) for dims, n in blocks.items()}

    def numbered(df: DataFrame, number: Column, seed: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), number).cast("int"))

    def matrix(table: pa.Table):
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table["v"].combine_chunks().flatten().to_numpy()
        return ids[order], flat.reshape(len(ids), -1)[order]

    def build(table: pa.Table) -> pa.Table:
        ids, values = matrix(table)
        wide = table["wide"][0].as_py()
        low, bits, slices = (np.zeros(0, np.int64), [], np.zeros((0, 0), np.uint64))
        if wide:
            slices = values.astype(np.int64)
        elif values.shape[1]:
            low, bits, slices = slices_of(values)
        columns = {"low": pa.array([low.tolist()], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.int32()))}
        return pa.table({"dims": pa.array([values.shape[1]], pa.int32()), "wide": pa.array([wide]), "block": table["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), **columns, "slices": pa.array([slices.tobytes()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        ids, values = matrix(table)
        return pa.table({"dims": pa.array([values.shape[1]], pa.int32()), "part": pa.array([table["block"][0].as_py() // MEET], pa.int32()), "query_ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([values.astype(np.int64).tobytes()], pa.binary())})

    index = numbered(rows, of_dims(held), 0).groupBy("dims", "wide", "block").applyInArrow(build, "dims int, wide boolean, block int, ids binary, low array<long>, bits array<int>, slices binary")
    asked = numbered(rows.filter(is_query), of_dims(blocks), 1).groupBy("dims", "block").applyInArrow(gather, "dims int, part int, query_ids binary, queries binary")
    index, asked = shelf.put(index), shelf.put(asked)

    def search(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        for r in index.to_pylist():
            ids, dims = np.frombuffer(r["ids"], np.int64), key[0].as_py()
            for a in asked.to_pylist():
                query_ids = np.frombuffer(a["query_ids"], np.int64)
                queries = np.frombuffer(a["queries"], np.int64).reshape(len(query_ids), dims)
                if r["wide"]:
                    values = np.frombuffer(r["slices"], np.int64).reshape(len(ids), dims)
                    for query_id, q in zip(query_ids.tolist(), queries.tolist(), strict=True):
                        found += search_rows(ids, values, query_id, q, k)
                else:
                    slices = np.frombuffer(r["slices"], np.uint64).reshape(-1, -(-len(ids) // 64))
                    found += search_block(ids, np.array(r["low"], np.int64), r["bits"], slices, query_ids, queries, k)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    # an index block goes to each part of the queries, a query block to each index block, by their numbers
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(of_dims(parts, 0) - 1, F.lit(0)))))
    asked = asked.withColumn("wide", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("blocks", of_dims(held, 0)).filter("blocks > 0")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["dims", "wide", "block", "part"]
    winners = index.filter(of_dims(parts, 0) > 0).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return winners.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
