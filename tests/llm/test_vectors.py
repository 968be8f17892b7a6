import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlake.llm import bitslice, neardup, warc
from defectlake.llm.common import Shelf, connected_components

KIND = "vec_id long, embedding array<float>, label int, score double"


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (180, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (2000, 2001), (2001, 2000)] + [(3000, 3001 + k) for k in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(Shelf(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(Shelf(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def planted():
    r = np.random.default_rng(0)
    unit = lambda v: v / np.linalg.norm(v)
    one = lambda: unit(r.standard_normal(64))
    v = [one() for _ in range(600)]
    for _ in range(60):
        b, w = one(), one()
        w = unit(w - w @ b * b)
        c = r.uniform(0.951, 0.97)
        v += [b, c * b + math.sqrt(1 - c * c) * w]
    for size, noise in ((150, 0.01), (120, 0.025)):
        b = one()
        v += [unit(b + noise * r.standard_normal(64)) for _ in range(size)]
    b = one()
    return np.array(v + [b] * 80, np.float32), r


@pytest.mark.parametrize("small", [2048, 60])
def test_links_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    v, r = planted()
    ids = r.permutation(len(v))
    odd = [(10_000, None), (10_001, [0.0] * 64), (10_002, [float("nan")] + [1.0] * 63), (10_003, [None, 1.0]), (10_004, []), (10_005, [1.0, 2.0]), (10_006, [float("inf")] * 64)]
    rows = [(int(i), x.tolist(), 1, 0.0) for i, x in zip(ids, v, strict=True)] + [(i, x, 1, 0.0) for i, x in odd]
    got = {x["vec_id"]: x for x in neardup.links(spark.createDataFrame(rows, KIND)).collect()}
    assert len(got) == len(rows)
    n = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (n @ n.T >= 0.95).sum(1) - 1
    have = np.array([got[int(i)]["n_links"] for i in ids])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) and x["component_id"] <= x["vec_id"] for x in got.values())


@pytest.mark.parametrize("hot", [1500, 32_768])
def test_links_in_a_dense_third(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "BUCKET", 512)
    monkeypatch.setattr(neardup, "HOT", hot)
    r, dims, n = np.random.default_rng(1), 64, 9000

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    v = unit(r.standard_normal((n, dims)))
    axis = unit(r.standard_normal(dims))
    across = unit(r.standard_normal((n // 3, dims)))
    across = unit(across - (across @ axis)[:, None] * axis)
    v[: n // 3] = math.sqrt(0.88) * axis + math.sqrt(0.12) * across  # cosines of about 0.88 to each other
    for k in range(0, 600, 2):  # planted pairs at 0.951 to 0.97 in the cone, and as many outside
        for i in (k, n // 3 + k):
            w = unit(r.standard_normal(dims))
            w = unit(w - (w @ v[i]) * v[i])
            c = r.uniform(0.951, 0.97)
            v[i + 1] = c * v[i] + math.sqrt(1 - c * c) * w
    v = v.astype(np.float32)
    ids = r.permutation(n)
    got = {x["vec_id"]: x["n_links"] for x in neardup.links(spark.createDataFrame([(int(i), x.tolist(), 1, 0.0) for i, x in zip(ids, v, strict=True)], KIND)).collect()}
    x = unit(v.astype(float))
    want = np.concatenate([(x[k : k + 1000] @ x.T >= 0.95).sum(1) for k in range(0, n, 1000)]) - 1
    have = np.array([got[int(i)] for i in ids])
    assert want[:600].sum() >= 600 and (have <= want).all() and have.sum() >= 0.995 * want.sum()


def test_tables_hold_recall_at_any_size():
    for n in (10**3, 10**5, 10**7):
        bits, tables = neardup.plan_tables(n, 0.95, 0.999)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.999


def test_links_of_empty_and_repeated(spark):
    assert neardup.links(spark.createDataFrame([], KIND)).count() == 0
    rows = neardup.links(spark.createDataFrame([(1, [1.0, 0.0], 1, 0.0), (1, [1.0, 0.0], 1, 0.0), (2, [2.0, 0.0], 1, 0.0)], KIND)).collect()
    assert len(rows) == 3 and {r["n_links"] for r in rows} == {2} and {r["component_id"] for r in rows} == {1}


def test_digits():
    for q in (*range(-70, 70), 12345, -99999):
        d = bitslice.digits_of(q)
        assert sum(s << k for k, s in d) == q and all(b[0] - a[0] > 1 for a, b in zip(d, d[1:], strict=False))


@pytest.mark.parametrize("block_rows,block_queries", [(32_768, 128), (50, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block_rows, block_queries):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(bitslice, "BLOCK_QUERIES", block_queries)
    r = np.random.default_rng(1)
    v = r.normal(0, 0.3, (400, 16)).astype(np.float32)
    v[100:140] = v[7]  # ties
    v[200] = 0
    v[201] = 1000.5
    odd = [(1000, None), (1100, [float("nan")] * 16), (1200, [None] * 16), (1300, [0.5] * 3), (1301, [0.25] * 3)]
    rows = [(i, x.tolist(), 1, 0.0) for i, x in enumerate(v)] + [(i, x, 1, 0.0) for i, x in odd]
    got = bitslice.top_k(spark.createDataFrame(rows, KIND), F.col("vec_id") % 100 == 0).collect()
    x = np.floor(1024 * v.astype(float)).astype(np.int64)
    want = set()
    for q in range(0, 400, 100):
        s = x @ x[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-int(s[i]), i))[:10]
        want |= {(q, k, i, int(s[i])) for k, i in enumerate(order, 1)}
    want.add((1300, 1, 1301, 3 * 512 * 256))
    assert {tuple(g) for g in got} == want


def test_top_k_of_an_empty_table(spark):
    assert bitslice.top_k(spark.createDataFrame([], KIND), F.col("vec_id") % 100 == 0).count() == 0


RECORDS = "record_id string, kind string, url string, date timestamp, status int, headers map<string,string>, digest string, body string"


def test_revisits(spark):
    from datetime import datetime

    day = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        ("r1", "response", "http://A.example:80/x?b=2&a=1#f", day(1), 200, {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}, "d1", "one"),
        ("r2", "response", "http://a.example/x?a=1&b=2", day(3), 200, {"ETag": '"2"', "Last-Modified": "L"}, "d2", "two"),
        ("bad", "response", "http://a.example/x?a=1&b=2", day(2), 404, {}, None, ""),
        ("v1", "revisit", "HTTP://a.example/x?a=1&b=2", day(2), 304, {"etag": 'W/"1"', "content-type": "x", "x": "new"}, None, None),
        ("v2", "revisit", "http://a.example/x?a=1&b=2", day(3), 304, {"ETag": '"1"'}, None, None),
        ("v3", "revisit", "http://a.example/x?a=1&b=2", day(9), 304, {"ETag": '"9"'}, None, None),
        ("v4", "revisit", "http://a.example/x?a=1&b=2", day(3, 5), 304, {"Last-Modified": "L"}, None, None),
        ("v5", "revisit", "http://a.example/x?a=1&b=2", day(4), 304, {}, None, None),
        ("v6", "revisit", "http://a.example/x?a=1&b=2", day(4), 304, None, "d2", None),
        ("o1", "revisit", "http://a.example/other", day(4), 304, {"ETag": '"1"'}, None, None),
        ("o2", "revisit", None, day(4), 304, {}, None, None),
        ("o3", "revisit", "http://a.example/x?a=1&b=2", None, 304, {}, None, None),
        ("o4", "revisit", "http://a.example/x?a=1&b=2", day(1), 304, {"ETag": '"1"'}, None, None),
    ]
    records = spark.createDataFrame(rows, RECORDS)
    got = {r["record_id"]: r for r in warc.resolve(records).collect()}
    outcome = {k: (r["response_id"], r["outcome"]) for k, r in got.items()}
    assert outcome == {
        "v1": ("r1", "resolved"), "v2": ("r1", "resolved"), "v3": ("r2", "mismatch"), "v4": ("r2", "resolved"), "v5": ("r2", "unverified"), "v6": ("r2", "resolved"),
        "o1": (None, "orphan"), "o2": (None, "orphan"), "o3": (None, "orphan"), "o4": (None, "orphan"),
    }
    assert got["v1"]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "x": "new"} and got["v3"]["headers"] is None
    assert {r["record_id"]: r["body"] for r in warc.with_bodies(warc.resolve(records), records).collect()}["v4"] == "two"
    assert warc.resolve(records.limit(0)).count() == 0
    assert warc.resolve(records.unionByName(records)).count() == 20


def test_warc_files_round_trip(spark, tmp_path):
    a = warc.write_record("response", "http://a/", "2024-01-01T00:00:00Z", "<urn:1>", "200 OK", {"ETag": '"1"'}, b"body\r\n\r\nmore")
    b = warc.write_record("revisit", "http://a/", "2024-01-02T00:00:00Z", "<urn:2>", "304 Not Modified", {"ETag": '"1"'}, b"")
    (tmp_path / "x.warc.gz").write_bytes(a + b)
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(rows) == {"<urn:1>", "<urn:2>"} and bytes(rows["<urn:1>"]["body"]) == b"body\r\n\r\nmore"
    assert rows["<urn:2>"]["status"] == 304 and rows["<urn:1>"]["headers"] == {"etag": '"1"'}
    records = warc.read_warc(spark, str(tmp_path)).withColumn("date", F.to_timestamp("date"))
    assert [(r["response_id"], r["outcome"]) for r in warc.resolve(records).collect()] == [("<urn:1>", "resolved")]


@pytest.mark.parametrize("url,want", [("HTTP://User@Ex.com.:80/a?z=1&b=2#f", "http://ex.com/a?b=2&z=1"), ("https://x:443", "https://x/"), ("https://x:8443/?", "https://x:8443/"), (" ", None), (None, None), ("no scheme", "no scheme")])
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical(F.col("u")).alias("c")).first()["c"] == want


def test_top_k_of_huge_components(spark):
    """What leaves 64 bits counts as the nearest number that has them; all else is exact."""
    rows = [(0, [1e3, 1.0]), (1, [2.0**33, 3.0]), (2, [2.0**33, 4.0]), (3, [-1e300, 0.0]), (6, [1e300, 0.0]), (7, [1e300, 1.0]), (4, [1.0, 1.0]), (5, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = bitslice.top_k(table, F.col("vec_id") == 0, k=9).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [6, 7, 2, 1, 4, 3]
    q = [math.floor(1024 * x) for x in rows[0][1]]
    want = [sum(a * math.floor(1024 * b) for a, b in zip(q, v, strict=True)) for v in (rows[2][1], rows[1][1], rows[6][1])]
    assert [r["score"] for r in found] == [2**63 - 1, 2**63 - 1, *want, -(2**63)]
