"""Near-duplicate vectors by tables of random-hyperplane buckets, each compared in full."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, connected_components

#: Points of an average bucket that its bits aim at, and points beyond which a bucket is cut into parts.
BUCKET, HOT = 4096, 32_768
#: Vectors of a component compared all to all in one task; larger ones go by leader and blocks.
SMALL, BLOCK = 2048, 1024


def plan_tables(n: int, least: float, recall: float) -> tuple[int, int]:
    """Bits of a table's key and number of tables.

    A random hyperplane parts two vectors at angle t with probability t / pi, whatever else the table
    holds, so a pair at the limit shares a bucket of `bits` planes with probability
    (1 - t / pi)^bits; the number of tables is what brings this to `recall` for every such pair.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n) / BUCKET))))
    together = (1 - np.arccos(least) / np.pi) ** bits
    return bits, 1 if together == 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - together))))


def _planes(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and doubles `v` of the vectors that can link: no null, zero or non-finite ones."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine & some, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def _pack(df: DataFrame, *keys: str) -> DataFrame:
    """The vector as little-endian doubles, which Arrow moves without a list."""

    def run(batches):
        for batch in batches:
            flat = batch.column("v")
            begin = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            data = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(data, pa.binary())], [*keys, "x"])

    fields = [df.schema[k] for k in keys]
    return df.select(*keys, "v").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", x binary")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each its component's smallest number, after the edges (a, b)."""
    while len(a):
        label = label.copy()
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _spanning(x: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """The smallest row that each row is connected with by links of unit rows; of two parts, across them.

    Tiles are compared in single precision; what is near the limit, again in double.
    """
    label, single = np.arange(len(x)), x.astype(np.float32)
    cross = bool(side.any())
    rows, columns = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (label, label)
    for i in range(0, len(rows), 512):
        for j in range(0 if cross else i, len(columns), 2048):
            own, other = rows[i : i + 512], columns[j : j + 2048]
            near = single[own] @ single[other].T
            p, q = np.nonzero(near >= least - 1e-4)
            a, b, value = own[p], other[q], near[p, q]
            fresh = label[a] != label[b]
            a, b, value = a[fresh], b[fresh], value[fresh]
            close = value >= least + 1e-4
            edge = np.flatnonzero(~close)
            for k in range(0, len(edge), 1 << 16):
                e = edge[k : k + (1 << 16)]
                close[e] = np.einsum("ij,ij->i", x[a[e]], x[b[e]]) >= least
            label = _unite(label, a[close], b[close])
    return label


def bucket_pairs(packed: DataFrame, least: float, recall: float, seed: int = 7) -> DataFrame:
    """Verified pairs (a, b) that span what the links within the buckets of all tables connect.

    All vectors of a bucket are compared, so that the chance of finding a pair does not depend on how
    dense its surroundings are. A bucket of more than HOT vectors is cut into parts, and each two of
    them meet in a task of their own.
    """
    n = packed.count()
    bits, tables = plan_tables(n, least, recall)

    def buckets(data: list[bytes], size: int) -> np.ndarray:
        """Rows by tables; dimensions, table and bits make one number."""
        signs = _unit(data) @ _planes(size // 8, tables * bits, seed) >= 0
        key = (signs.reshape(len(data), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)
        return ((size // 8 * tables + np.arange(tables)) << bits) + key

    def grouped(batch):
        data = batch.column("x").to_pylist()
        for size in sorted({len(x) for x in data}):
            own = np.array([k for k, x in enumerate(data) if len(x) == size])
            some = [data[k] for k in own.tolist()]
            yield own, some, buckets(some, size)

    def count(batches):
        for batch in batches:
            for _, _, key in grouped(batch):
                value, times = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], ["bucket", "n"])

    large = {}
    if n > HOT:
        sizes = packed.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
        large = {r["bucket"]: -(-2 * r["n"] // HOT) for r in sizes.collect()}

    def keys(batches):
        for batch in batches:
            ids = batch.column("first").to_numpy()
            for own, some, key in grouped(batch):
                with np.errstate(over="ignore"):
                    singles = [np.frombuffer(x).astype(np.float32) for x in some]
                some = [s.tobytes() if (s == np.frombuffer(x)).all() else x for s, x in zip(singles, some, strict=True)]  # exact, or as it is
                who = ids[own]
                for t in range(tables):
                    table = pa.array(some, pa.binary())
                    parts = np.array([large.get(k, 1) for k in key[:, t].tolist()])
                    part = (who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                    for other in range(int(parts.max())):
                        at = np.flatnonzero(other < parts)
                        low, high = np.minimum(part[at], other), np.maximum(part[at], other)
                        side = (part[at] > other).astype(np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(key[at, t]), pa.array(low * parts[at] + high), pa.array(side), pa.array(who[at]), table.take(pa.array(at))], ["bucket", "cell", "side", "first", "x"])

    def compare(table: pa.Table) -> pa.Table:
        dims = int(table["bucket"][0].as_py() >> bits) // tables
        ids, data = table["first"].to_numpy(), table["x"].to_pylist()
        wide = [x if len(x) == dims * 8 else np.frombuffer(x, np.float32).astype(float).tobytes() for x in data]
        label = _spanning(_unit(wide), table["side"].to_numpy(), least)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": ids[label[at]], "b": ids[at]})

    spread = packed.mapInArrow(keys, "bucket long, cell long, side byte, first long, x binary")
    found = spread.groupBy("bucket", "cell").applyInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _close(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return x @ y.T >= least


def links(vectors: DataFrame, least: float = 0.95, recall: float = 0.999) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Equal vectors are one point with a count. Verified pairs within buckets are united, each link being
    found with probability `recall` or more; up to BUCKET points are one bucket, which is exact. Then
    all pairs within a component are counted, so that a vector's links do not depend on the buckets:
    in components of up to SMALL points by comparing all; in larger ones the points within half the
    angle of the component's smallest id are linked by the triangle inequality without comparing,
    and the others are compared with all of the component in blocks. Null, zero and non-finite
    vectors link with nothing; vectors of different lengths neither; repeated rows count as links;
    ties go to the smaller vec_id; other columns are not read.
    """
    shelf = Shelf(vectors.sparkSession)
    named = usable(vectors).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    points = named.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    points = points.withColumn("first", F.col("first"))
    packed = shelf.put(_pack(points, "h1", "h2", "first", "copies"))
    pairs = bucket_pairs(packed.select("first", "x"), least, recall)
    groups = shelf.put(connected_components(shelf, pairs))
    members = packed.join(groups, packed["first"] == groups["node"]).select("component", "first", "copies", "x")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    sizes = shelf.put(sizes)
    members = shelf.put(members.join(sizes, "component"))
    total = members.count()

    def within(table: pa.Table) -> pa.Table:
        comp, ids, copies, data = table["component"].to_numpy(), table["first"].to_numpy(), table["copies"].to_numpy(), table["x"].to_pylist()
        order = np.argsort(comp, kind="stable")
        cut = np.flatnonzero(np.diff(comp[order])) + 1
        n = np.zeros(len(ids), np.int64)
        for own in np.split(order, cut):
            unit, weight = _unit([data[k] for k in own.tolist()]), copies[own]
            n[own] = _close(unit, unit, least) @ weight - 1
        return pa.table({"first": ids, "n_links": n})

    buckets = max(1, total // 4000)
    small = members.filter(F.col("size") <= SMALL).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    counted = small.groupBy("bucket").applyInArrow(within, "first long, n_links long")
    large = members.filter(F.col("size") > SMALL)
    if sizes.filter(F.col("size") > SMALL).limit(1).count():
        counted = counted.unionByName(_large_links(shelf, large, least))
    counted = shelf.put(counted)

    found = named.select("vec_id", "h1", "h2").join(packed.select("h1", "h2", "first", "copies"), ["h1", "h2"])
    found = found.join(groups.withColumnRenamed("node", "first"), "first", "left").join(counted, "first", "left")
    known = found.select("vec_id", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    rest = vectors.select("vec_id").join(known.select("vec_id").distinct(), "vec_id", "left_anti")
    out = known.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _large_links(shelf: Shelf, members: DataFrame, least: float) -> DataFrame:
    """first and n_links in large components: sure points by their leader, the others by blocks."""
    salts = 16
    half = float(np.cos(np.arccos(least) / 2)) + 1e-9
    leaders = members.filter(F.col("first") == F.col("component")).select("component", F.col("x").alias("lead"))
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("first"), F.lit(salts)).cast("int")).join(leaders, ["component", "salt"])

    def mark(batches):
        for batch in batches:
            x, lead = batch.column("x").to_pylist(), batch.column("lead").to_pylist()
            sure = [float(_unit([a]) @ _unit([b]).T) >= half for a, b in zip(x, lead, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("component", "first", "copies", "x")] + [pa.array(sure)], ["component", "first", "copies", "x", "sure"])

    marked = shelf.put(salted.select("component", "first", "copies", "x", "lead").mapInArrow(mark, "component long, first long, copies long, x binary, sure boolean"))
    weight = marked.filter("sure").groupBy("component").agg(F.sum("copies").alias("weight"))
    by_leader = marked.filter("sure").select("component", "first").join(F.broadcast(weight) if weight.count() < 10_000 else weight, "component")
    by_leader = by_leader.select("first", (F.col("weight") - 1).alias("n"))

    counts = {r["sure"]: r["n"] for r in marked.groupBy("sure").agg(F.count("*").alias("n")).collect()}
    if not counts.get(False):
        return by_leader.groupBy("first").agg(F.sum("n").alias("n_links"))

    def blocked(df: DataFrame, n: int, name: str) -> DataFrame:
        def gather(table: pa.Table) -> pa.Table:
            return pa.table({"component": table["component"][:1], f"{name}_ids": pa.array([table["first"].to_numpy().tobytes()], pa.binary()), f"{name}_copies": pa.array([table["copies"].to_numpy().tobytes()], pa.binary()), f"{name}_sure": pa.array([table["sure"].to_numpy().tobytes()], pa.binary()), f"{name}_x": pa.array([b"".join(table["x"].to_pylist())], pa.binary())})

        block = F.pmod(F.xxhash64("first", F.lit(3)), F.lit(max(1, -(-n // BLOCK))))
        kinds = f"component long, {name}_ids binary, {name}_copies binary, {name}_sure binary, {name}_x binary"
        return shelf.put(df.groupBy("component", block.alias("block")).applyInArrow(gather, kinds))

    unsure = blocked(marked.filter("not sure"), counts[False], "u")
    every = blocked(marked, sum(counts.values()), "m")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                u, m = (np.frombuffer(r[f"{k}_ids"], np.int64) for k in "um")
                x, y = (_unit([r[f"{k}_x"][i * size : (i + 1) * size] for i in range(len(ids))]) for k, ids in (("u", u), ("m", m)) for size in [len(r[f"{k}_x"]) // len(ids)])
                close = _close(x, y, least)
                n = close @ np.frombuffer(r["m_copies"], np.int64) - np.isin(u, m)
                sure = np.frombuffer(r["m_sure"], bool)
                back = np.frombuffer(r["u_copies"], np.int64) @ close[:, sure]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, m[sure]))), pa.array(np.concatenate((n, back)).astype(np.int64))], ["first", "n"])

    met = unsure.join(every, "component").repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.mapInArrow(compare, "first long, n long").unionByName(by_leader).groupBy("first").agg(F.sum("n").alias("n_links"))
