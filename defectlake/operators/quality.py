"""Quality rules of seed images, near-duplicates by perceptual hash, and outliers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hamming


@dataclass(frozen=True)
class Limits:
    dark: float = 30
    bright: float = 225
    blur: float = 100
    small: int = 64
    large: int = 8192
    odd: float = 0.5


def warnings(seeds: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per seed and rule that it breaks: id, code, severity, message.

    `seeds` has id, width, height, mean_brightness and blur_score. The medians are one row, whatever
    the size of the table; the rules are one pass without a shuffle.
    """
    middle = seeds.agg(F.median("width").alias("mw"), F.median("height").alias("mh"))
    w, h = F.col("width"), F.col("height")
    b, s = F.col("mean_brightness"), F.col("blur_score")
    far = (F.abs(w - F.col("mw")) > F.col("mw") * limits.odd) | (F.abs(h - F.col("mh")) > F.col("mh") * limits.odd)
    rules = [
        ("too_dark", b < limits.dark, F.format_string("brightness %.1f", b)),
        ("too_bright", b > limits.bright, F.format_string("brightness %.1f", b)),
        ("blurry", s < limits.blur, F.format_string("blur score %.1f", s)),
        ("too_small", (w < limits.small) | (h < limits.small), F.format_string("%d x %d", w, h)),
        ("too_large", (w > limits.large) | (h > limits.large), F.format_string("%d x %d", w, h)),
        ("odd_dimensions", far, F.format_string("%d x %d", w, h)),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), text.alias("message"))) for code, rule, text in rules]))
    return seeds.join(F.broadcast(middle), how="cross").select("id", F.inline(found))


#: Rows of a block of hashes: as many as make BLOCKS of them, within these bounds.
BLOCK_ROWS, BLOCKS = (16384, 65536), 64
#: Pairs of rows that are expanded at a time.
EXPANDED = 1 << 18
#: Bands are joined if the pairs that they bring together are at most this share of all.
SELECTIVE = 0.005


def _widths(threshold: int, bits: int) -> list[int]:
    """Widths of threshold // 2 + 1 bands, of which one differs in at most one bit."""
    bands = threshold // 2 + 1
    return [bits // bands + (k < bits % bands) for k in range(bands)]


def _selective(threshold: int, bits: int) -> bool:
    """Whether bands spare comparisons: a join costs some hundred times what comparing two hashes does."""
    return sum((1 + w) / 2**w for w in _widths(threshold, bits)) <= SELECTIVE


def _grouped(hashes: DataFrame, *of_hash: Column) -> DataFrame:
    """One row per hash; rows without an id or a hash are in no pair."""
    return hashes.filter("id is not null and hash is not null").groupBy("hash").agg(*of_hash)


def _meetings(groups: DataFrame, rows: int) -> DataFrame:
    """Rows of one block (a block with itself) or two (both blocks): every two blocks of `groups` meet once.

    Blocks are bounded, so each meeting is of bounded size whatever the table's, but for the ids of equal
    hashes; with n blocks each row travels n times.
    """
    least, most = BLOCK_ROWS
    n = max(1, -(-rows // min(max(rows // BLOCKS, least), most)))
    block = F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int").alias("block")
    packed = groups.groupBy(block).agg(F.collect_list(F.struct(*groups.columns)).alias("rows"))
    sent = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sent = sent.select(F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "rows")
    # a number that is given is not coalesced: a meeting is little data and much work
    met = sent.repartition(min(n * (n + 1) // 2, 4096), "low", "high").groupBy("low", "high").agg(F.collect_list("rows").alias("sides"))
    return met.filter((F.col("low") == F.col("high")) | (F.size("sides") == 2)).select("sides")


def _sides(batch: pa.RecordBatch):
    """For each row the one or two blocks, as Arrow structs."""
    sides = batch.column(0)
    for i in range(len(sides)):
        blocks = sides[i].values
        yield [blocks[k].values for k in range(len(blocks))]


def _close(a: np.ndarray, b: np.ndarray | None, threshold: int):
    """Indices and distances of hashes of `a` and `b` within the threshold, or of two of `a`; in parts."""
    held, n = [], 0
    for i in range(len(a)):
        other = a[i + 1 :] if b is None else b
        distance = np.bitwise_count(other ^ a[i])
        near = np.flatnonzero(distance <= threshold)
        if len(near):
            held.append((np.full(len(near), i), near + (i + 1 if b is None else 0), distance[near]))
            n += len(near)
        if n >= EXPANDED:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _hits(blocks: list[pa.StructArray], threshold: int):
    """Parts of (x, y, distance, equal): places in the first and in the last block; a hash also meets itself."""
    a = blocks[0].field("hash").to_numpy().view(np.uint64)
    b = blocks[1].field("hash").to_numpy().view(np.uint64) if len(blocks) > 1 else None
    if b is None:
        every = np.arange(len(a))
        yield every, every, np.zeros(len(a), np.uint8), True
    for x, y, distance in _close(a, b, threshold):
        yield x, y, distance, False


def _expanded(blocks: list[pa.StructArray], threshold: int):
    """Batches of (id, other, distance) of two blocks, of few rows at a time however many share a hash."""
    lists = [b.field("ids") for b in (blocks[0], blocks[-1])]
    ids, begins = [v.values for v in lists], [v.offsets.to_numpy() for v in lists]
    for x, y, distance, equal in _hits(blocks, threshold):
        (ax, nx), (ay, ny) = ((o[k].astype(np.int64), np.diff(o)[k].astype(np.int64)) for o, k in zip(begins, (x, y), strict=True))
        if equal:
            some = nx > 1
            distance, ax, nx, ay, ny = (v[some] for v in (distance, ax, nx, ay, ny))
        ends = np.cumsum(nx * ny)
        for first in range(0, int(ends[-1]) if len(ends) else 0, EXPANDED):
            t = np.arange(first, min(first + EXPANDED, int(ends[-1])))
            k = np.searchsorted(ends, t, "right")
            t -= ends[k] - nx[k] * ny[k]
            one, two = ids[0].take(pa.array(ax[k] + t // ny[k])), ids[1].take(pa.array(ay[k] + t % ny[k]))
            less = pc.less(one, two)
            kept = less if equal else pc.not_equal(one, two)  # ids of equal hashes meet in both orders
            columns = [pc.if_else(less, one, two), pc.if_else(less, two, one), pa.array(distance[k].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "other", "distance"]).filter(kept)


def near_pairs(hashes: DataFrame, threshold: int = 4, bits: int = 64) -> DataFrame:
    """All pairs (id, other, distance) with id < other and at most `threshold` differing bits.

    If bands are selective, the hash is cut into threshold // 2 + 1 of them, of which one differs in at
    most one bit. A row is stored by its bands, and asks for each band and its one-bit changes; what
    meets is verified. For a wider threshold such look-ups meet as many rows as there are pairs: then
    blocks of distinct hashes meet, and all of two blocks are compared in one task. So equal hashes of
    a hot group are compared once per distinct hash, not once per row.
    """
    if not _selective(threshold, bits):
        kind = hashes.schema["id"].dataType.simpleString()

        def compare(batches):
            for batch in batches:
                for blocks in _sides(batch):
                    yield from _expanded(blocks, threshold)

        met = _meetings(_grouped(hashes, F.collect_list("id").alias("ids")), hashes.count())
        return met.mapInArrow(compare, f"id {kind}, other {kind}, distance int")
    width = _widths(threshold, bits)
    bands = len(width)
    start = [sum(width[:k]) for k in range(bands)]

    def word(value: int) -> Column:
        return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")

    def band(k: int) -> Column:
        return F.shiftrightunsigned("hash", start[k]).bitwiseAND(word((1 << width[k]) - 1))

    def key(k: int, value: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), value.alias("v"))

    distinct = hashes.select("hash").distinct()
    stored = distinct.select(F.explode(F.array(*[key(k, band(k)) for k in range(bands)])).alias("key"), "hash")
    asks = [key(k, band(k)) for k in range(bands)]
    if threshold:
        asks += [key(k, band(k).bitwiseXOR(word(1 << i))) for k in range(bands) for i in range(width[k])]
    asked = distinct.select(F.explode(F.array(*asks)).alias("key"), F.col("hash").alias("near"))
    met = stored.join(asked, "key").filter(hamming(F.col("hash"), F.col("near")) <= threshold).select("hash", "near").distinct()
    a, b = hashes.select(F.col("hash"), F.col("id")), hashes.select(F.col("hash").alias("near"), F.col("id").alias("other"))
    rows = met.join(a, "hash").join(b, "near").filter("id < other")
    return rows.select("id", "other", hamming(F.col("hash"), F.col("near")).alias("distance"))


def near_pairs_by_comparison(hashes: DataFrame, threshold: int = 4) -> DataFrame:
    """The same by comparing all: the definition, for small tables and tests."""
    b = hashes.select(F.col("id").alias("other"), F.col("hash").alias("near"))
    rows = hashes.join(b, (F.col("id") < F.col("other")) & (hamming(F.col("hash"), F.col("near")) <= threshold))
    return rows.select("id", "other", hamming(F.col("hash"), F.col("near")).alias("distance"))


def duplicate_warnings(pairs: DataFrame) -> DataFrame:
    """A warning on the later image of each pair."""
    return pairs.select(F.col("other").alias("id"), F.when(F.col("distance") == 0, "duplicate").otherwise("near_duplicate").alias("code"), F.col("id").alias("of"), "distance")


def duplicate_summary(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    n = hashes.agg(F.count("*").alias("total"))
    return n.join(pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.min("distance"), F.lit(-1)).alias("closest")), how="cross")


def near_summary(hashes: DataFrame, threshold: int = 4, bits: int = 64) -> DataFrame:
    """duplicate_summary of near_pairs, without expanding the pairs of wide thresholds: they are counted by hash.

    Pairs of rows of one id, of which there are none if ids are unique, are taken off.
    """
    if _selective(threshold, bits):
        return duplicate_summary(hashes, near_pairs(hashes, threshold, bits))

    def count(batches):
        for batch in batches:
            for blocks in _sides(batch):
                (n, one), (m, two) = ((b.field("n").to_numpy(), b.field("one")) for b in (blocks[0], blocks[-1]))
                pairs, closest = 0, None
                for x, y, distance, equal in _hits(blocks, threshold):
                    if equal:
                        pairs += sum(v * (v - 1) // 2 for v in n[n > 1].tolist())
                        real = one.is_null().to_numpy(zero_copy_only=False)
                    else:
                        pairs += int((n[x] * m[y]).sum())
                        real = ~pc.fill_null(pc.equal(one.take(pa.array(x)), two.take(pa.array(y))), False).to_numpy(zero_copy_only=False)
                    if real.any():
                        closest = min(int(distance[real].min()), bits if closest is None else closest)
                yield pa.RecordBatch.from_arrays([pa.array([pairs], pa.int64()), pa.array([closest], pa.int32())], ["pairs", "closest"])

    alone = F.when(F.min("id") == F.max("id"), F.min("id")).alias("one")
    groups = _grouped(hashes, F.count("*").alias("n"), alone)
    found = _meetings(groups, hashes.count()).mapInArrow(count, "pairs long, closest int").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.min("closest"), F.lit(-1)).alias("closest"))
    again = hashes.filter("id is not null and hash is not null").groupBy("id").agg(F.collect_list("hash").alias("h")).filter(F.size("h") > 1)
    near = F.aggregate("h", F.lit(0).cast("long"), lambda s, a: s + F.size(F.filter("h", lambda b: hamming(a, b) <= threshold)))
    own = again.agg(F.coalesce(F.sum((near - F.size("h")) / 2).cast("long"), F.lit(0)).alias("own"))
    n = hashes.agg(F.count("*").alias("total"))
    return n.join(found, how="cross").join(own, how="cross").select("total", (F.col("pairs") - F.col("own")).alias("pairs"), "closest")


def outliers(rows: DataFrame, measures: dict[str, str], sigmas: float = 2.0) -> DataFrame:
    """Rows farther than `sigmas` population deviations from the mean of a measure, with the reasons.

    `measures` maps reason names to columns. The moments are one broadcast row.
    """
    stats = rows.agg(*[f(c).alias(f"{c}_{n}") for c in measures.values() for f, n in ((F.avg, "avg"), (F.stddev_pop, "std"))])
    far = {k: (F.col(f"{c}_std") > 0) & (F.abs(F.col(c) - F.col(f"{c}_avg")) > F.col(f"{c}_std") * sigmas) for k, c in measures.items()}
    reason = F.concat_ws(" and ", *[F.when(rule, k) for k, rule in far.items()])
    return rows.join(F.broadcast(stats), how="cross").withColumn("reason", reason).filter("reason <> ''").select("id", "reason")


def distribution(rows: DataFrame, measures: dict[str, str]) -> DataFrame:
    """measure, min, max, mean and deviation of each column, in one aggregation."""
    wide = rows.agg(*[f(c).cast("double").alias(f"{k}_{n}") for k, c in measures.items() for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"), (F.stddev_pop, "std"))])
    parts = [F.struct(F.lit(k).alias("measure"), *[F.col(f"{k}_{n}").alias(n) for n in ("low", "high", "mean", "std")]) for k in measures]
    return wide.select(F.inline(F.array(*parts)))
