"""Registered queries of the engine's own operators over the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, fusion, labels, measures, quality, report, spatial
from .plans import planner
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_IMG = """WITH RECURSIVE px AS (
    SELECT vec_id AS id, coalesce(label, -1) AS label, (i - 1) % 8 AS x, (i - 1) // 8 AS y,
        CAST(floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 0.5) * 255, 0), 255)) AS BIGINT) AS v
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE len(embedding) = 64
), st AS (SELECT id, sum(v) AS s, sum(v * v) AS q FROM px GROUP BY id)"""
_MASK = _IMG + """, mk AS (
    SELECT px.*, (64 * v - s > 0 AND (64 * v - s) * (64 * v - s) > 64 * q - s * s) AS m FROM px JOIN st USING (id)
), bx AS (
    SELECT id, any_value(label) AS label, count(*) FILTER (m) AS area, coalesce(min(x) FILTER (m), 0) AS bx, coalesce(min(y) FILTER (m), 0) AS bt,
        coalesce(max(x) FILTER (m) - min(x) FILTER (m) + 1, 0) AS bw, coalesce(max(y) FILTER (m) - min(y) FILTER (m) + 1, 0) AS bh
    FROM mk GROUP BY id
), nb AS (SELECT *, row_number() OVER (ORDER BY id) AS image_id, 'type' || label AS defect_type FROM bx)"""
_SAMPLES = """WITH sm AS (
    SELECT d.doc_id AS id, md5(text) AS source_seed, source AS split, lang AS defect_type, coalesce(n_chars, 0) / 100.0::DOUBLE AS area_percent,
        CAST(n_chars AS DOUBLE) AS brightness, coalesce(quality, 0) AS annotations
    FROM documents d LEFT JOIN labels USING (doc_id)
)"""


def _r(c, digits: int = 6):
    return F.round(c, digits)


@query(_IMG + " SELECT id, round(s / 64.0::DOUBLE, 6) AS mean_brightness FROM st")
def seed_brightness(spark, d):
    return tables.images8(spark, d).select("id", _r(measures.brightness(F.col("px"))).alias("mean_brightness"))


@query(_IMG + " SELECT id, round(sqrt(CAST(64 * q - s * s AS DOUBLE)) / 64, 6) AS contrast FROM st")
def seed_contrast(spark, d):
    return tables.images8(spark, d).select("id", _r(measures.contrast(F.col("px"))).alias("contrast"))


_LAP = """, lp AS (
    SELECT id, lag(v, 1, NULL) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS dn, v FROM px
    WINDOW r AS (PARTITION BY id, y ORDER BY x), c AS (PARTITION BY id, x ORDER BY y)
), bl AS (
    SELECT id, sum(k) AS ks, sum(k * k) AS kq FROM (SELECT id, coalesce(l, rr) + coalesce(rr, l) + coalesce(u, dn) + coalesce(dn, u) - 4 * v AS k FROM lp) GROUP BY id
)"""


@query(_IMG + _LAP + " SELECT id, round(CAST(64 * kq - ks * ks AS DOUBLE) / 4096, 6) AS blur_score FROM bl")
def seed_laplacian_blur(spark, d):
    return measures.blur_score(tables.images8(spark, d)).select("id", _r(F.col("blur_score")).alias("blur_score"))


@query(
    _IMG
    + _LAP
    + """, r AS (SELECT id, s / 64.0::DOUBLE AS b, CAST(64 * kq - ks * ks AS DOUBLE) / 4096 AS f FROM st JOIN bl USING (id))
    SELECT id, 'too_dark' AS code, 'warning' AS severity FROM r WHERE b < 120 UNION ALL SELECT id, 'too_bright', 'warning' FROM r WHERE b > 135
    UNION ALL SELECT id, 'blurry', 'warning' FROM r WHERE f < 20000 UNION ALL SELECT id, 'too_small', 'warning' FROM r"""
)
def seed_quality_warnings(spark, d):
    images = tables.images8(spark, d)
    seeds = images.select("id", "width", "height", measures.brightness(F.col("px")).alias("mean_brightness")).join(measures.blur_score(images), "id")
    return quality.warnings(seeds, quality.Limits(dark=120, bright=135, blur=20000)).select("id", "code", "severity")


@query(
    """WITH m AS (SELECT median(n_chars) AS mw FROM documents)
    SELECT doc_id AS id, code FROM documents, m, (SELECT unnest(['too_small', 'too_large', 'odd_dimensions']) AS code)
    WHERE (code = 'too_small' AND n_chars < 64) OR (code = 'too_large' AND n_chars > 8192) OR (code = 'odd_dimensions' AND abs(n_chars - mw) > mw * 0.5)"""
)
def dimension_warnings(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("int").alias("width"), F.col("n_chars").cast("int").alias("height"), F.lit(127.0).alias("mean_brightness"), F.lit(200.0).alias("blur_score"))
    return quality.warnings(docs).select("id", "code")


@query(_MASK + " SELECT id, CAST(area AS INTEGER) AS area, round(area / 64.0::DOUBLE * 100, 6) AS area_percent FROM bx")
def mask_area(spark, d):
    a = measures.area(F.col("mask"))
    return tables.masks8(spark, d).select("id", a.alias("area"), _r(measures.area_percent(a, F.col("width"), F.col("height"))).alias("area_percent"))


@query(_MASK + " SELECT id, CAST(bx AS INTEGER) AS x, CAST(bt AS INTEGER) AS y, CAST(bw AS INTEGER) AS w, CAST(bh AS INTEGER) AS h FROM bx")
def mask_bbox(spark, d):
    return tables.masks8(spark, d).select("id", measures.bbox(F.col("mask"), F.col("width")).alias("b")).select("id", "b.*")


_YOLO = "round(CASE WHEN bw > 0 THEN least(greatest(({}) / 8.0::DOUBLE, 0), 1) ELSE 0.0::DOUBLE END, 6)"


@query(_MASK + f" SELECT id, {_YOLO.format('bx + bw / 2.0::DOUBLE')} AS xc, {_YOLO.format('bt + bh / 2.0::DOUBLE')} AS yc, {_YOLO.format('bw')} AS bw, {_YOLO.format('bh')} AS bh FROM bx")
def yolo_bbox(spark, d):
    box = measures.yolo_box(measures.bbox(F.col("mask"), F.col("width")), F.col("width"), F.col("height"))
    rows = tables.masks8(spark, d).select("id", box.alias("b"))
    return rows.select("id", *[_r(F.col(f"b.{k}")).alias(k) for k in ("xc", "yc", "bw", "bh")])


@query(_MASK + " SELECT CASE WHEN area = 0 THEN 'empty_mask' ELSE 'valid' END AS code, count(*) AS n FROM bx GROUP BY 1")
def mask_validity(spark, d):
    m = F.col("mask")
    rows = tables.masks8(spark, d).select("id", measures.validity(m, F.size(m), F.col("width") * F.col("height"), measures.area(m), measures.bbox(m, F.col("width"))).alias("codes"))
    return report.validation(rows)


_HASH = _IMG + """, hs AS (
    SELECT a.id, CAST(sum(CASE WHEN b.v > a.v THEN CAST(1 AS BIGINT) << CAST(55 - (a.y * 7 + a.x) AS INTEGER) ELSE 0 END) AS BIGINT) AS hash
    FROM px a JOIN px b ON a.id = b.id AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.id
), np AS (
    SELECT a.id, b.id AS other, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM hs a JOIN hs b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 14
)"""


def _hashes(spark, d):
    return tables.images8(spark, d).select("id", measures.dhash(F.col("px"), 8, 8).alias("hash"))


@query(_HASH + " SELECT id, hash FROM hs")
def dhash(spark, d):
    return _hashes(spark, d)


@query(_HASH + " SELECT id, other, distance FROM np")
def near_duplicates(spark, d):
    return quality.near_pairs(_hashes(spark, d), 14, 56)


@query(_HASH + " SELECT other AS id, CASE WHEN distance = 0 THEN 'duplicate' ELSE 'near_duplicate' END AS code, id AS \"of\", distance FROM np")
def seed_duplicate_warnings(spark, d):
    return quality.duplicate_warnings(quality.near_pairs(_hashes(spark, d), 14, 56))


@query(_HASH + " SELECT (SELECT count(*) FROM hs) AS total, count(*) AS pairs, coalesce(min(distance), -1) AS closest FROM np")
def output_duplicate_summary(spark, d):
    return quality.near_summary(_hashes(spark, d), 14, 56)


@query(
    _SAMPLES
    + """ SELECT count(*) AS total_images, CAST(sum(annotations) AS BIGINT) AS total_annotations, min(area_percent) AS min_area_percent, max(area_percent) AS max_area_percent,
        round(avg(area_percent), 6) AS mean_area_percent, median(area_percent) AS median_area_percent, count(*) FILTER (NOT area_percent > 0) AS empty_masks,
        round(count(*) FILTER (area_percent > 0) * 100.0::DOUBLE / count(*), 6) AS success_rate,
        min(brightness) AS min_brightness, max(brightness) AS max_brightness, round(avg(brightness), 6) AS mean_brightness FROM sm"""
)
def dataset_statistics(spark, d):
    rows = report.statistics(tables.samples(spark, d))
    return rows.select(*[_r(F.col(c)).alias(c) if c in ("mean_area_percent", "success_rate", "mean_brightness") else F.col(c) for c in rows.columns])


@query(_SAMPLES + " SELECT defect_type, count(*) AS n FROM sm GROUP BY 1")
def defect_counts(spark, d):
    return report.counts_by(tables.samples(spark, d), "defect_type")


@query(
    _SAMPLES
    + """, t AS (SELECT split, defect_type, count(*) AS n, sum(area_percent) AS a, sum(brightness) AS b FROM sm GROUP BY ALL),
    g AS (SELECT split, sum(n) AS images, round(sum(a) / sum(n), 4) AS mean_area_percent, round(sum(b) / sum(n), 4) AS mean_brightness FROM t GROUP BY 1)
    SELECT split, CAST(images AS BIGINT) AS images, mean_area_percent, mean_brightness, defect_type, n FROM g JOIN t USING (split)"""
)
def split_statistics(spark, d):
    rows = report.split_statistics(tables.samples(spark, d))
    return rows.select("split", "images", _r(F.col("mean_area_percent"), 4).alias("mean_area_percent"), _r(F.col("mean_brightness"), 4).alias("mean_brightness"), F.explode("defects").alias("defect_type", "n"))


@query(_SAMPLES + ", g AS (SELECT split, count(*) AS n FROM sm GROUP BY 1) SELECT count(*) AS splits, CAST(sum(n) AS BIGINT) AS total, min(n) / CAST(sum(n) AS DOUBLE) >= 0.1 AS is_balanced FROM g")
def split_balance(spark, d):
    return report.split_balance(tables.samples(spark, d))


@query(
    _SAMPLES
    + """ SELECT source_seed, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM sm WHERE source_seed IS NOT NULL AND split IS NOT NULL
    GROUP BY 1 HAVING count(DISTINCT split) > 1"""
)
def split_leakage(spark, d):
    return report.leakage(tables.samples(spark, d)).select("source_seed", F.array_join("splits", ",").alias("splits"))


@query(_SAMPLES + " SELECT split, count(*) AS samples, count(DISTINCT source_seed) AS seeds FROM sm GROUP BY 1")
def seeds_per_split(spark, d):
    return report.seeds_per_split(tables.samples(spark, d))


@query(
    """WITH s AS (SELECT avg(value) AS a, stddev_pop(value) AS sd, avg(event_id % 97) AS b, stddev_pop(event_id % 97) AS sb FROM events)
    SELECT event_id AS id, concat_ws(' and ', CASE WHEN sd > 0 AND abs(value - a) > 2 * sd THEN 'brightness' END, CASE WHEN sb > 0 AND abs(event_id % 97 - b) > 2 * sb THEN 'contrast' END) AS reason
    FROM events, s WHERE (sd > 0 AND abs(value - a) > 2 * sd) OR (sb > 0 AND abs(event_id % 97 - b) > 2 * sb)"""
)
def brightness_outliers(spark, d):
    rows = tables.table(spark, d, "events").select(F.col("event_id").alias("id"), "value", F.pmod("event_id", F.lit(97)).alias("other"))
    return quality.outliers(rows, {"brightness": "value", "contrast": "other"})


@query(
    """SELECT 'value' AS measure, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std FROM events
    UNION ALL SELECT 'user', min(user_id), max(user_id), round(avg(user_id), 6), round(stddev_pop(user_id), 4) FROM events"""
)
def measure_distribution(spark, d):
    rows = quality.distribution(tables.table(spark, d, "events"), {"value": "value", "user": "user_id"})
    return rows.select("measure", *[_r(F.col(c)).alias(c) for c in ("low", "high", "mean")], _r(F.col("std"), 4).alias("std"))


_PLAN = """WITH c AS (SELECT count(*) AS n FROM part), k AS (
    SELECT n, greatest(1, round_even(n * 0.7, 0)) AS a, greatest(1, round_even(n * 0.2, 0)) AS b FROM c
), pl AS (
    SELECT p_partkey AS id, row_number() OVER (ORDER BY (p_partkey * 1103515245 + 12345) % 2147483648, p_partkey) - 1 AS pos FROM part
), sp AS (
    SELECT id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < a THEN 'train' WHEN pos < a + b THEN 'val' ELSE 'test' END AS split,
        CAST(pos - CASE WHEN pos < a THEN 0 WHEN pos < a + b THEN a ELSE a + b END AS INTEGER) AS place FROM pl, k
), qt AS (
    SELECT * FROM (SELECT 'train' AS split, CAST(a AS INTEGER) AS seeds, 700 AS samples, 0 AS first FROM k
    UNION ALL SELECT 'val', CAST(b AS INTEGER), 200, 700 FROM k UNION ALL SELECT 'test', CAST(n - a - b AS INTEGER), 100, 900 FROM k)
)"""


def _seeds(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"))


@query(_PLAN + " SELECT id, pos, split, place FROM sp")
def split_plan(spark, d):
    seeds = _seeds(spark, d)
    return planner.split_plan(seeds, seeds.count())


@query(_PLAN + " SELECT split, seeds, samples, first FROM qt")
def split_quota(spark, d):
    return planner.quota(_seeds(spark, d).count(), 1000, spark)


@query(
    _PLAN
    + """ SELECT i AS sample_idx, qt.split, sp.id AS seed_id, ((42 * 1000003 + i * 8191) % 2147483647 * 1664525 + 1013904223) % 4294967296 AS random_seed
    FROM (SELECT unnest(range(1000)) AS i) JOIN qt ON i >= first AND i < first + samples JOIN sp ON sp.split = qt.split AND sp.place = (i - first) % seeds"""
)
def sample_plan(spark, d):
    seeds = _seeds(spark, d)
    n = seeds.count()
    return planner.sample_plan(planner.split_plan(seeds, n), planner.quota(n, 1000, spark), 1000)


def _labelled(spark, d):
    return tables.masks8(spark, d).withColumn("defect_type", F.concat(F.lit("type"), F.col("label").cast("string")))


@query(_MASK + " SELECT image_id AS id, printf('image_%04d_%s.png', image_id - 1, defect_type) AS file_name, 8 AS width, 8 AS height FROM nb")
def coco_images(spark, d):
    return labels.images(_labelled(spark, d))


_CAT = ", ct AS (SELECT defect_type AS name, CAST(row_number() OVER (ORDER BY min(id), defect_type) AS INTEGER) AS id FROM nb GROUP BY defect_type)"


@query(_MASK + _CAT + " SELECT id, name FROM ct")
def coco_categories(spark, d):
    return labels.categories(_labelled(spark, d))


@query(
    _MASK
    + _CAT
    + """ SELECT row_number() OVER (ORDER BY image_id) AS id, image_id, ct.id AS category_id, CAST(bx AS INTEGER) AS x, CAST(bt AS INTEGER) AS y, CAST(bw AS INTEGER) AS w,
    CAST(bh AS INTEGER) AS h, CAST(area AS INTEGER) AS area, 0 AS iscrowd FROM nb JOIN ct ON ct.name = defect_type WHERE area > 0"""
)
def coco_annotations(spark, d):
    return labels.annotations(_labelled(spark, d))


@query(
    _MASK
    + """, cl AS (SELECT defect_type, row_number() OVER (ORDER BY defect_type) - 1 AS class_id FROM (SELECT DISTINCT defect_type FROM nb))
    SELECT id, 0 AS instance, printf('%d %.6f %.6f %.6f %.6f', class_id, (bx + bw / 2.0::DOUBLE) / 8, (bt + bh / 2.0::DOUBLE) / 8, bw / 8.0::DOUBLE, bh / 8.0::DOUBLE) AS line
    FROM nb JOIN cl USING (defect_type) WHERE bw > 0"""
)
def yolo_lines(spark, d):
    return labels.yolo_lines(_labelled(spark, d))


@query(_MASK + " SELECT id, 0 AS instance, defect_type AS name, CAST(bx AS INTEGER) AS xmin, CAST(bt AS INTEGER) AS ymin, CAST(bx + bw AS INTEGER) AS xmax, CAST(bt + bh AS INTEGER) AS ymax FROM nb WHERE bw > 0")
def voc_boxes(spark, d):
    return labels.voc_boxes(_labelled(spark, d))


@query(
    _MASK
    + """ SELECT id, '<annotation><filename>' || printf('image_%04d_%s.png', image_id - 1, defect_type) || '</filename><size><width>8</width><height>8</height><depth>3</depth></size>'
    || CASE WHEN bw > 0 THEN '<object><name>' || defect_type || '</name><difficult>0</difficult><bndbox><xmin>' || bx || '</xmin><ymin>' || bt || '</ymin><xmax>' || (bx + bw)
    || '</xmax><ymax>' || (bt + bh) || '</ymax></bndbox></object>' ELSE '' END || '</annotation>' AS xml FROM nb"""
)
def voc_files(spark, d):
    return labels.voc_xml(_labelled(spark, d))


@query(
    """WITH f AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS c, row_number() OVER (ORDER BY ((vec_id * 1103515245 + 12345) % 2147483648), vec_id) - 1 AS pos
    FROM embeddings WHERE len(embedding) = 64)
    SELECT CASE WHEN pos < greatest(1, round_even(c * 0.7, 0)) THEN 'train' WHEN pos < greatest(1, round_even(c * 0.7, 0)) + greatest(1, round_even(c * 0.2, 0)) THEN 'val' ELSE 'test' END AS split, id FROM f"""
)
def split_lists(spark, d):
    images = tables.images8(spark, d).select("id")
    return planner.split_plan(images, images.count()).select("split", "id")


_RUNS = """WITH im AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS run_idx, o_orderkey AS id, printf('image_%07d.png', o_orderkey) AS file_name, o_orderstatus AS name FROM orders),
oc AS (SELECT run_idx, name, CAST(row_number() OVER (PARTITION BY run_idx ORDER BY min(id), name) AS INTEGER) AS id FROM im GROUP BY run_idx, name),
an AS (SELECT im.run_idx, im.id AS image_id, oc.id AS category_id, im.id * 8 + l_linenumber AS id FROM lineitem JOIN im ON l_orderkey = im.id JOIN oc ON oc.run_idx = im.run_idx AND oc.name = im.name),
mi AS (SELECT run_idx, id AS old_id, row_number() OVER (ORDER BY run_idx, id) AS id, 'run' || run_idx || '_' || file_name AS file_name FROM im),
mc AS (SELECT name, CAST(row_number() OVER (ORDER BY min(struct_pack(r := run_idx, i := id)), name) AS INTEGER) AS id FROM oc GROUP BY name),
ma AS (SELECT an.run_idx, row_number() OVER (ORDER BY an.run_idx, an.id) AS id, mi.id AS image_id, coalesce(mc.id, 1) AS category_id FROM an
    JOIN mi ON mi.run_idx = an.run_idx AND mi.old_id = an.image_id LEFT JOIN oc ON oc.run_idx = an.run_idx AND oc.id = an.category_id LEFT JOIN mc ON mc.name = oc.name)"""


@query(_RUNS + " SELECT run_idx, old_id, id, file_name FROM mi")
def merge_images(spark, d):
    return fusion.merge_images(tables.runs(spark, d)[0])


@query(_RUNS + " SELECT id, name FROM mc")
def merge_categories(spark, d):
    return fusion.merge_categories(tables.runs(spark, d)[2])


@query(_RUNS + " SELECT run_idx, id, image_id, category_id FROM ma")
def merge_annotations(spark, d):
    images, annotations, categories = tables.runs(spark, d)
    return fusion.merge_annotations(annotations, fusion.merge_images(images), categories, fusion.merge_categories(categories))


@query(_RUNS + " SELECT (SELECT count(DISTINCT run_idx) FROM mi) AS runs, (SELECT count(*) FROM mi) AS images, (SELECT count(*) FROM an) AS annotations, (SELECT string_agg(name, ',' ORDER BY name) FROM mc) AS categories")
def merge_summary(spark, d):
    images, annotations, categories = tables.runs(spark, d)
    known = annotations.join(images.select("run_idx", F.col("id").alias("image_id")), ["run_idx", "image_id"], "left_semi")
    return fusion.merge_summary(images, known, fusion.merge_categories(categories))


_HEAT = "WITH ht AS (SELECT CAST(l_suppkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, count(*) AS hits FROM lineitem GROUP BY ALL)"


@query(_HEAT + " SELECT y, x, hits FROM ht")
def heat_accumulate(spark, d):
    return spatial.heat(tables.points64(spark, d))


_METRICS = """, cl AS (SELECT y // {c} AS cy, x // {c} AS cx, CAST(sum(hits) AS DOUBLE) AS c FROM ht WHERE y // {c} < 8 AND x // {c} < 8 GROUP BY ALL),
e AS (SELECT coalesce((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 6, 0) AS e FROM cl)
SELECT round_even(count(*) / {n}.0::DOUBLE, 4) AS coverage, round_even(CASE WHEN count(*) > 0 THEN sum(x * hits) / (sum(hits) * {w}.0::DOUBLE) ELSE 0.5 END, 4) AS centroid_x,
round_even(CASE WHEN count(*) > 0 THEN sum(y * hits) / (sum(hits) * {w}.0::DOUBLE) ELSE 0.5 END, 4) AS centroid_y, round_even(least(greatest(any_value(e), 0), 1), 4) AS entropy FROM ht, e"""


@query(_HEAT + _METRICS.format(c=8, n=4096, w=64))
def spatial_metrics(spark, d):
    return spatial.metrics(spatial.heat(tables.points64(spark, d)), 64, 64)


@query(_MASK + ", ht AS (SELECT y, x, count(*) AS hits FROM mk WHERE m GROUP BY ALL)" + _METRICS.format(c=1, n=64, w=8))
def mask_spatial_metrics(spark, d):
    return spatial.metrics(spatial.heat(spatial.mask_points(tables.masks8(spark, d), 8, 8)), 8, 8)


@query(_IMG + " SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(avg(v), 6) AS value FROM px GROUP BY ALL")
def mean_image(spark, d):
    return spatial.mean_image(tables.images8(spark, d)).select("y", "x", _r(F.col("value")).alias("value"))


_FEATURES = _MASK + """, nn AS (
    SELECT a.id, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, b.m FROM mk a JOIN mk b ON a.id = b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
), ed AS (SELECT id, x, y FROM nn GROUP BY ALL HAVING bool_or(m) <> bool_and(m)), ck AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)), sb AS (
    SELECT e.id, e.x, e.y, sum(p.v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END) AS gx, sum(p.v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END) AS gy
    FROM ed e CROSS JOIN ck JOIN px p ON p.id = e.id AND p.x = CASE WHEN e.x + dx < 0 THEN 1 WHEN e.x + dx > 7 THEN 6 ELSE e.x + dx END AND p.y = CASE WHEN e.y + dy < 0 THEN 1 WHEN e.y + dy > 7 THEN 6 ELSE e.y + dy END
    GROUP BY ALL
), gm AS (SELECT id, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS g FROM sb GROUP BY id), mo AS (
    SELECT id, any_value(label) AS label, coalesce(avg(v) FILTER (m), 0) AS im, coalesce(stddev_pop(v) FILTER (m), 0) AS isd, coalesce(avg(v) FILTER (NOT m), 0) AS om, coalesce(stddev_pop(v) FILTER (NOT m), 0) AS osd, count(*) FILTER (m) AS k
    FROM mk GROUP BY id
), ft AS (
    SELECT mo.id, mo.label, im AS defect_gray_mean, isd AS defect_gray_std, om AS background_gray_mean, osd AS background_gray_std, k / 64.0::DOUBLE AS area_ratio,
        CASE WHEN bh > 0 THEN bw / CAST(bh AS DOUBLE) ELSE 0 END AS aspect_ratio, coalesce(g, 0) AS grad_mag_boundary, CASE WHEN k > 0 AND k < 64 THEN abs(im - om) ELSE 0 END AS contrast
    FROM mo JOIN bx USING (id) LEFT JOIN gm USING (id)
)"""
_NAMES = ["defect_gray_mean", "defect_gray_std", "background_gray_mean", "background_gray_std", "area_ratio", "aspect_ratio", "grad_mag_boundary", "contrast"]


@query(_FEATURES + " SELECT id, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NAMES) + " FROM ft")
def gray_features(spark, d):
    rows = features.extract(tables.masks8(spark, d))
    return rows.select("id", *[_r(F.col(c), 5).alias(c) for c in _NAMES])


@query(_FEATURES + " SELECT round((" + " + ".join(f"stddev_pop({c})" for c in _NAMES) + ") / 8, 5) AS feature_diversity FROM ft")
def feature_diversity(spark, d):
    return features.diversity(features.extract(tables.masks8(spark, d))).select(_r(F.col("feature_diversity"), 5).alias("feature_diversity"))


@query(_FEATURES + ", v AS (SELECT label, (" + " + ".join(f"var_pop({c})" for c in _NAMES) + ") / 8 AS v FROM ft GROUP BY label HAVING count(*) > 1) SELECT round(avg(v), 5) AS intra_class_variance FROM v")
def intra_class_variance(spark, d):
    masks = tables.masks8(spark, d)
    rows = features.extract(masks).join(masks.select("id", "label"), "id")
    return features.intra_class_variance(rows).select(_r(F.col("intra_class_variance"), 5).alias("intra_class_variance"))


@query(
    """SELECT doc_id AS id, toxic AS label, row_number() OVER w <= ceil(count(*) OVER (PARTITION BY toxic, ((doc_id % 8) + 8) % 8) * 0.4::DOUBLE) AS held_out FROM labels
    WINDOW w AS (PARTITION BY toxic, ((doc_id % 8) + 8) % 8 ORDER BY (doc_id * 1103515245 + 12345) % 2147483648, doc_id)"""
)
def holdout_split(spark, d):
    return planner.holdout(tables.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))


@query(
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn,
        count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
    SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
        round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM c"""
)
def confusion_metrics(spark, d):
    rows = report.confusion(tables.table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return rows.select("tp", "fp", "fn", "tn", *[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("SELECT doc_id AS id, source, lang FROM documents ORDER BY doc_id LIMIT 16")
def contact_sheet_pick(spark, d):
    return tables.table(spark, d, "documents").orderBy("doc_id").limit(16).select(F.col("doc_id").alias("id"), "source", "lang")


@query(_SAMPLES + " SELECT defect_type, source_seed, count(*) AS n FROM sm GROUP BY ALL ORDER BY n DESC, defect_type, source_seed LIMIT 10")
def top_seeds(spark, d):
    return report.counts_by(tables.samples(spark, d), "defect_type", "source_seed").orderBy(F.desc("n"), "defect_type", "source_seed").limit(10)


@query(None)
def mask_polygons(spark, d):
    return labels.polygons(tables.masks8(spark, d))


def flagship(spark, d):
    """Images, masks, boxes and areas, joined with a seed-aware split, then statistics per split."""
    masks = tables.masks8(spark, d)
    plan = planner.split_plan(masks.select("id"), masks.count())
    area = measures.area(F.col("mask"))
    rows = masks.select("id", F.concat(F.lit("type"), F.col("label").cast("string")).alias("defect_type"), measures.area_percent(area, F.col("width"), F.col("height")).alias("area_percent"), measures.brightness(F.col("px")).alias("brightness"))
    return report.split_statistics(rows.join(plan.select("id", "split"), "id"))
