"""SimHash fingerprints of word shingles and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, connected_components, keep_one, slices, texts_of
from .neardup import _unite

SEED = 42


def shingles_of(text: str, words: int = 4, repeats: bool = True) -> np.ndarray:
    """XXH64 of each run of `words` words, or of the whole of a shorter text; without repeats sorted.

    Words are runs of anything but ASCII white space, after lower-casing A-Z.
    """
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        begins = np.concatenate(([0], ends[:-words])).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        hashes = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begins, stops, strict=True)), np.uint64, len(stops))
    if not repeats:
        hashes = np.sort(hashes)
        hashes = hashes[np.append(True, hashes[1:] != hashes[:-1])]
    return hashes


def lanes_of(text: str, words: int = 4, lanes: int = 1, repeats: bool = True) -> np.ndarray:
    """The SimHash of a text in `lanes` unsigned 64-bit words, the first from XXH64 itself.

    A bit is set if more than half of the shingles' hashes (with repeats, or of the distinct ones)
    have it. No word: zero. Further lanes mix the same hashes, so a shingle is hashed once.
    """
    hashes = shingles_of(text, words, repeats)
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        if lane:  # the finaliser of splitmix64
            x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        else:
            x = hashes
        votes = np.zeros(64, np.int64)
        for k in range(0, len(x), 1 << 14):
            bits = np.unpackbits(x[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(0, dtype=np.int64)
        out[lane] = np.packbits(votes * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: str, words: int = 4) -> int:
    return int(lanes_of(text, words)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and its fingerprint as a signed long of the same bits."""

    def run(batches):
        keep_one("fingerprints", dict)
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def lookups(distinct: DataFrame, bits: int = 4, segments: int = 3) -> tuple[DataFrame, DataFrame]:
    """Stored rows (a, key) and look-ups (b, key) by which all pairs within `bits` bits meet.

    The 64 bits are cut into `segments`; a pair within `bits` agrees in one segment up to
    r = bits // segments bits. Each fingerprint is stored once per segment and looks up a Hamming
    ball of radius r around each of its segments; whole distances are then verified. Of the two
    keys of a near match exactly one has the first differing bit unset, so balls of radius one set
    unset bits only, which halves them and loses nothing.
    """
    radius = bits // segments
    if radius > 1:
        raise ValueError("use more segments: balls of radius 0 or 1 are enumerated")
    width = [64 // segments + (s < 64 % segments) for s in range(segments)]
    start = np.concatenate(([0], np.cumsum(width)[:-1])).tolist()

    def key(s: int):
        return F.shiftrightunsigned("fp", start[s]).bitwiseAND(F.lit((1 << width[s]) - 1))

    def tagged(s: int, k):
        return k * F.lit(segments) + F.lit(s)

    stored = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*[tagged(s, key(s)) for s in range(segments)])).alias("key"))

    def ball(s: int):
        own, flips = key(s), F.array(*[F.lit(1 << i) for i in range(width[s])])
        unset = F.filter(flips, lambda m: own.bitwiseAND(m) == 0)
        return F.transform(unset, lambda m: tagged(s, own.bitwiseOR(m)))

    asked = [F.array(tagged(s, key(s))) for s in range(segments)]
    if radius:
        asked += [ball(s) for s in range(segments)]
    probes = distinct.select(F.col("fp").alias("b"), F.explode(F.concat(*asked)).alias("key"))
    return stored, probes


def near_pairs(distinct: DataFrame, bits: int = 4, segments: int = 3) -> DataFrame:
    """All pairs (fp, other) of distinct fingerprints that differ in 1 to `bits` bits."""
    stored, probes = lookups(distinct, bits, segments)
    return _ordered(stored.join(probes, "key").filter(_apart(bits))).withColumnsRenamed({"a": "fp", "b": "other"})


def _apart(bits: int):
    return (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Fingerprints of one key beyond which it is cut into parts, and those compared with the others at once.
HOT, PIVOTS = 1 << 15, 64


def plan_masks(n: int, bits: int = 4) -> list[int]:
    """Masks of the 64 bits such that any two fingerprints within `bits` bits are equal under one of them.

    Of bits + s segments at least s are untouched, so there is a mask for each s segments; s is the
    least at which chance leaves a key 8192 fingerprints or fewer.
    """
    spare = 1
    while n >> (spare * 64 // (bits + spare)) > 1 << 13 and spare < 4:
        spare += 1
    edges = [64 * k // (bits + spare) for k in range(bits + spare + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(some) for some in combinations(own, spare)]


def linked_bits(fp: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint the first one that it is connected with by links of `bits` bits or fewer."""
    label = np.arange(len(fp))
    for i in range(0, len(fp) - 1, PIVOTS):
        p, q = np.nonzero(np.bitwise_count(fp[i : i + PIVOTS, None] ^ fp[None, i:]) <= bits)
        p, q = p + i, q + i
        fresh = label[p] != label[q]
        label = _unite(label, p[fresh], q[fresh])
    return label


def spanning_pairs(shelf: Shelf, distinct: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of `first` with the same components as all pairs of fingerprints within `bits` bits.

    Fingerprints that are equal under a mask meet in one task, which compares all of them and returns
    no more links than it has fingerprints. A key of more than HOT is cut into parts, and each two
    of them meet in a task.
    """

    def signed(mask: int):
        return F.lit(mask - (mask >> 63 << 64)).cast("long")

    masks = plan_masks(distinct.count(), bits)
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(signed(m)), F.lit(k)) for k, m in enumerate(masks)])
    keyed = distinct.filter("first is not null").select("first", "fp", F.explode(keys).alias("cell"))
    hot = shelf.put(keyed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > HOT))
    if hot.limit(1).count():
        cut = keyed.join(hot.select("cell", F.ceil(F.col("n") * 2 / HOT).cast("int").alias("parts")), "cell", "left")
        cut = cut.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")))
        met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("cell", F.least("own", o), F.greatest("own", o)))
        keyed = cut.select("first", "fp", F.explode(F.when(F.col("parts").isNull(), F.array("cell")).otherwise(met)).alias("cell"))

    def compare(batches):
        cell, parts = None, []

        def links():
            first, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            label = linked_bits(fp, bits)
            at = np.flatnonzero(label != np.arange(len(label)))
            return first[label[at]], first[at]

        for batch in batches:
            cells, first, fp = (batch.column(k).to_numpy() for k in range(3))
            fp, found = fp.view(np.uint64), []
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    if parts:
                        found.append(links())
                    cell, parts = cells[a], []
                parts.append((first[a:b].copy(), fp[a:b].copy()))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if parts:
            a, b = links()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    spread = keyed.select("cell", "first", "fp").repartition("cell").sortWithinPartitions("cell", "first")
    return spread.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of `bits` bits or fewer.

    Equal fingerprints are one vertex, so groups of copies of any size cost one row. Null and empty
    texts have fingerprint zero; repeated rows give repeated results; an empty table an empty one.
    """
    shelf = Shelf(docs.sparkSession)
    fps = shelf.put(fingerprints(docs, words))
    distinct = shelf.put(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = connected_components(shelf, spanning_pairs(shelf, distinct, bits))
    named = distinct.join(groups, F.col("first") == F.col("node"), "left")
    named = shelf.put(named.select("fp", F.coalesce("component", "first").alias("component_id")))
    return fps.join(named, "fp")


#: Lanes of a wide fingerprint, at least.
LANES = 16


def plan_segments(n: int, similarity: float, recall: float = 0.98) -> tuple[int, int, int, float]:
    """Width and number of segments, lanes, and the expected share of differing bits.

    Two sets of Jaccard similarity s have cosine 2s/(1+s), hence differ in the share
    acos(cosine)/pi of random bits. The width follows the number of fingerprints, so that chance
    matches per look-up stay few at any size; the number of segments is what then finds a pair at
    the limit of similarity with probability `recall` by segments that differ in at most one bit.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    width = int(np.clip(np.ceil(np.log2(max(2, n))) - 2, 16, 32))
    near = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
    segments = int(np.ceil(np.log(1 - recall) / np.log(1 - near)))
    return width, segments, max(LANES, -(-segments // (64 // width))), share


#: Smallest hashes that make one band, and the chance that a pair at the limit of similarity shares a band.
ROWS, RECALL = 5, 0.999
#: Weight (shingles, and MEMBER for each document) of a cell that one task compares.
CELL, MEMBER = 1 << 22, 128


def plan_bands(similarity: float, recall: float = RECALL) -> int:
    """Number of bands: a band of ROWS smallest hashes is shared with probability similarity^ROWS, whatever else the table holds."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**ROWS)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """One row of `bands` keys for each set of hashes: equal where the smallest hashes of a band are, the number of the band mixed in."""
    odd = np.random.default_rng(SEED).integers(0, 2**63, bands * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    least = np.full((len(sets), bands * ROWS), 2**64 - 1, np.uint64)
    for row, own in zip(least, sets, strict=True):
        for k in range(0, len(own), 512):
            np.minimum(row, (odd * own[k : k + 512]).min(1), out=row)
    least = least.reshape(len(sets), bands, ROWS)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
    for k in range(ROWS):
        keys = _mix((keys ^ least[:, :, k]) + np.uint64(0x9E3779B97F4A7C15))
    return keys


def _parities(flat: np.ndarray, begin: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap for each set: whether an odd number of its hashes falls on a bit."""
    n = len(begin) - 1
    out = np.zeros((n, bits // 64), np.uint64)
    for i in range(0, n, step := max(1, (1 << 21) // bits)):
        j = min(n, i + step)
        row = np.repeat(np.arange(j - i), np.diff(begin[i : j + 1]))
        at = (flat[begin[i] : begin[j]] & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(row * bits + at, minlength=(j - i) * bits) & 1).astype(np.uint8)
        out[i:j] = np.packbits(odd.reshape(j - i, bits), axis=1, bitorder="little").view(np.uint64)
    return out


def linked_sets(flat: np.ndarray, begin: np.ndarray, similarity: float) -> np.ndarray:
    """For each sorted set the first set that it is connected with by links of Jaccard similarity `similarity` or more.

    A search from each set meets only those not reached yet. Two sets differ in at least as many hashes as
    their parity bitmaps in bits, which excludes most pairs and no link; the others are compared exactly.
    """
    size = np.diff(begin)
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * max(1, size.max()))), 8, 12))
    rest, label = np.arange(len(size)), np.arange(len(size))
    maps = _parities(flat, begin, bits)
    left = maps
    slack = (1 - similarity) / (1 + similarity)
    while len(rest):
        root, queue = rest[0], [rest[0]]
        rest, left = rest[1:], left[1:]
        while queue and len(rest):
            v = queue.pop()
            own = flat[begin[v] : begin[v + 1]]
            differ = np.bitwise_count(left ^ maps[v]).sum(1, dtype=np.int64)
            maybe = np.flatnonzero(differ <= slack * (size[rest] + size[v]) + 1e-6)
            hits = []
            for k in range(0, len(maybe), 256):
                some = maybe[k : k + 256]
                other = [flat[begin[u] : begin[u + 1]] for u in rest[some].tolist()]
                both, ends = np.concatenate(other), np.cumsum([len(x) for x in other])
                there = np.append(own[np.minimum(np.searchsorted(own, both), len(own) - 1)] == both if len(own) else np.zeros(len(both), bool), False)
                total = np.concatenate(([0], np.cumsum(there)))
                shared = total[ends] - total[ends - size[rest[some]]]
                union = size[v] + size[rest[some]] - shared
                hits.append(some[(union == 0) | (shared / np.maximum(union, 1) >= similarity)])
            if hits and len(found := np.concatenate(hits)):
                label[rest[found]] = root
                queue += rest[found].tolist()
                stay = np.ones(len(rest), bool)
                stay[found] = False
                rest, left = rest[stay], left[stay]
    return label


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id and component_id of documents linked by the Jaccard similarity of their distinct shingles.

    Documents of one set of shingles are one vertex. Those that share a band of smallest hashes (a
    pair at the limit does with probability RECALL, a closer one more likely) are joined into
    clusters, and all pairs of a cluster are decided by their sets. Null and empty texts are copies
    of each other; rows without doc_id link with nothing.
    """
    shelf = Shelf(docs.sparkSession)
    bands = plan_bands(similarity)

    def mark(batches):
        from xxhash import xxh3_128_digest

        keep_one("fingerprints", dict)
        for batch in slices(batches):
            sets = [shingles_of(t, words, repeats=False) for t in texts_of(batch)]
            name = np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(len(sets), 2)
            begin = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            keys = pa.ListArray.from_arrays(begin, pa.array(band_keys(sets, bands).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array([len(x) for x in sets], pa.int32()), keys], ["doc_id", "h1", "h2", "size", "keys"])

    marks = shelf.put(docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, h1 long, h2 long, size int, keys array<long>"))
    distinct = marks.filter("doc_id is not null").groupBy("h1", "h2", "size", "keys").agg(F.min("doc_id").alias("first"))
    distinct = shelf.put(distinct)
    same_key = Window.partitionBy("key")
    met = distinct.filter("size > 0").select("first", F.explode("keys").alias("key")).withColumn("low", F.min("first").over(same_key))
    clusters = shelf.put(connected_components(shelf, met.filter("low <> first").select(F.col("low").alias("a"), F.col("first").alias("b"))))
    cells = _cells(shelf, distinct, clusters, bands)
    groups = connected_components(shelf, _verified(docs, cells, similarity, words))
    named = distinct.join(groups, F.col("first") == F.col("node"), "left")
    named = named.select("h1", "h2", F.coalesce("component", "first").alias("component_id"))
    return marks.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc_id", "component_id")


def _cells(shelf: Shelf, distinct: DataFrame, clusters: DataFrame, bands: int) -> DataFrame:
    """first, h1, h2 and the numbers of the cells in which a vertex of a cluster meets the others.

    A cluster is one cell if its weight is up to CELL. A heavier one is cut into parts, and each two
    of them meet in a cell; if that takes more cells a vertex than it has keys, only those of one
    key meet, and the vertices of a heavy key are cut likewise.
    """
    weight = F.sum(F.col("size") + MEMBER).alias("weight")
    members = distinct.join(clusters, F.col("first") == F.col("node"))
    sizes = shelf.put(members.groupBy("component").agg(weight))
    most = F.lit(bands * CELL // 2)

    def cut(df: DataFrame) -> DataFrame:
        """From key and weight: the cells of each row."""
        parts = F.when(F.col("weight") > CELL, F.ceil(F.col("weight") * 2 / CELL)).otherwise(1).cast("int")
        own = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) % F.col("parts")
        cell = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("key", F.least(F.col("own"), o), F.greatest(F.col("own"), o)))
        return df.withColumn("parts", parts).withColumn("own", own).select("first", "h1", "h2", cell.alias("cells"))

    whole = members.join(sizes.filter(F.col("weight") <= most), "component")
    cells = cut(whole.select("first", "h1", "h2", F.col("component").alias("key"), "weight"))
    heavy = sizes.filter(F.col("weight") > most)
    if heavy.limit(1).count():
        keyed = members.join(heavy.select("component"), "component", "left_semi").select("first", "h1", "h2", "size", F.explode("keys").alias("key"))
        keyed = keyed.join(keyed.groupBy("key").agg(weight, F.count("*").alias("n")).filter("n > 1").select("key", "weight"), "key")
        more = cut(keyed).groupBy("first", "h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"))
        cells = cells.unionByName(more)
    return cells


def _verified(docs: DataFrame, cells: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (a, b) with the same components as all pairs of a cell whose similarity is `similarity` or more."""

    def sets_of(batches):
        from xxhash import xxh3_128_digest

        for batch in slices(batches):
            sets = [shingles_of(t, words, repeats=False) for t in texts_of(batch)]
            name = np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(len(sets), 2)
            at = np.flatnonzero((name[:, 0] == batch.column(1).to_numpy()) & (name[:, 1] == batch.column(2).to_numpy()))  # texts of one repeated doc_id
            data = pa.array([sets[k].tobytes() for k in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(3).take(pa.array(at)), data], ["id", "cells", "data"])

    def compare(batches):
        cell, ids, data = None, [], []

        def links():
            begin = np.concatenate(([0], np.cumsum([len(x) // 8 for x in data])))
            who = np.array(ids, np.int64)
            label = linked_sets(np.frombuffer(b"".join(data), np.uint64), begin, similarity)
            at = np.flatnonzero(who[label] != who)
            return pa.RecordBatch.from_arrays([pa.array(who[label[at]]), pa.array(who[at])], ["a", "b"])

        for batch in slices(batches):
            for now, i, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now != cell:
                    if len(ids) > 1:
                        yield links()
                    cell, ids, data = now, [], []
                ids.append(i)
                data.append(x)
        if len(ids) > 1:
            yield links()

    asked = docs.select("doc_id", "text").join(cells.withColumnRenamed("first", "doc_id"), "doc_id")
    sets = asked.select("doc_id", "h1", "h2", "cells", "text").mapInArrow(sets_of, "id long, cells array<long>, data binary")
    spread = sets.select(F.explode("cells").alias("cell"), "id", "data").repartition("cell").sortWithinPartitions("cell", "id")
    return spread.mapInArrow(compare, "a long, b long")


def keep_first(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group, with its columns.

    Of repeated rows with one doc_id all stay together; rows without doc_id stay.
    """
    gone = similar_groups(docs, similarity, words).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
