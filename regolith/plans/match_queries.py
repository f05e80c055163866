"""Queries over match sets and their DuckDB equivalents."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from regolith.config import DEFAULT
from regolith.fixtures import MATCHES, SIZE, matches
from regolith.operators import fitting as ft
from regolith.operators import match_metrics as mm
from regolith.sources import sinks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, n: int = 6):
    """Doubles rounded, so that the order of a sum cannot show; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


CELLS = f"cells AS (SELECT *, greatest(0, least(7, CAST(trunc(ya / {SIZE}.0 * 8) AS INT))) AS gy, greatest(0, least(7, CAST(trunc(xa / {SIZE}.0 * 8) AS INT))) AS gx FROM m)"
MED = "med AS (SELECT pair_id, count(*) AS n, median(xb - xa) AS dx, median(yb - ya) AS dy FROM m GROUP BY pair_id)"
TRUTH = [1.02, -0.03, 21.5, 0.03, 1.02, -4.25, 0.0, 0.0, 1.0]
RES = "res AS (SELECT *, sqrt(pow(1.02::DOUBLE * xa - 0.03::DOUBLE * ya + 21.5 - xb, 2) + pow(0.03::DOUBLE * xa + 1.02::DOUBLE * ya - 4.25 - yb, 2)) AS r FROM m)"


def truth(ms):
    return ms.select("pair_id").distinct().withColumn("m", F.array(*map(F.lit, TRUTH)))


@query(f"WITH {MATCHES}, {MED}, o AS (SELECT pair_id, median(abs(xb - xa - dx)) AS mad_x, median(abs(yb - ya - dy)) AS mad_y FROM m JOIN med USING (pair_id) GROUP BY pair_id) SELECT pair_id, n, round(dx, 6) AS dx, round(dy, 6) AS dy, round(mad_x, 6) AS mad_x, round(mad_y, 6) AS mad_y FROM med JOIN o USING (pair_id)")
def match_offset_mad(spark, sf_dir):
    return rounded(mm.offset_mad(matches(spark, sf_dir)))


@query(f"WITH {MATCHES}, {CELLS}, k AS (SELECT pair_id, gy, gx, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT pair_id, sum(n) AS t FROM k GROUP BY pair_id) SELECT pair_id, round(count(*) / 64.0::DOUBLE, 6) AS coverage, round(-sum((n / t) * ln(n / t)) / ln(64), 6) + 0.0 AS entropy FROM k JOIN t USING (pair_id) GROUP BY pair_id")
def match_uniformity(spark, sf_dir):
    return rounded(mm.uniformity(matches(spark, sf_dir), SIZE))


@query(f"WITH {MATCHES}, {CELLS}, g AS (SELECT pair_id, CAST(i // 8 AS INT) AS gy, CAST(i % 8 AS INT) AS gx FROM (SELECT DISTINCT pair_id FROM m), range(64) t(i)), k AS (SELECT pair_id, gy, gx, count(*) AS n FROM cells GROUP BY ALL) SELECT pair_id, gy, gx, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (pair_id, gy, gx)")
def coverage_grid(spark, sf_dir):
    return mm.coverage_grid(matches(spark, sf_dir), SIZE)


@query(f"WITH {MATCHES}, {MED} SELECT pair_id, CAST(round_even(dx, 0) AS INT) AS dx, CAST(round_even(dy, 0) AS INT) AS dy, n FROM med")
def coarse_offset(spark, sf_dir):
    return mm.coarse_offset(matches(spark, sf_dir))


@query(f"""WITH {MATCHES}, w AS (SELECT *, CASE WHEN xa < 128 THEN 0 WHEN xa < 256 THEN 1 ELSE 2 END AS win FROM m),
o AS (SELECT pair_id, win, median(xb - xa) AS dx, median(yb - ya) AS dy FROM w GROUP BY ALL HAVING count(*) >= 8)
SELECT pair_id, round(CASE WHEN count(*) >= 2 THEN sqrt(pow(stddev_pop(dx), 2) + pow(stddev_pop(dy), 2)) END, 6) AS spread, count(*) AS windows FROM o GROUP BY pair_id""")
def cross_window_spread(spark, sf_dir):
    ms = matches(spark, sf_dir).withColumn("win", F.when(F.col("xa") < 128, 0).when(F.col("xa") < 256, 1).otherwise(2))
    return rounded(mm.cross_window_spread(mm.offset_mad(ms, by=("pair_id", "win"))))


@query(f"""WITH {MATCHES}, {RES}, {CELLS.replace('FROM m)', 'FROM res WHERE r <= 1.5)')},
b AS (SELECT pair_id, count(*) AS match_count, count(*) FILTER (r <= 1.5) AS inlier_count, sqrt(avg(r * r) FILTER (r <= 1.5)) AS rmse FROM res GROUP BY pair_id),
k AS (SELECT pair_id, gy, gx, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT pair_id, sum(n) AS t FROM k GROUP BY pair_id),
u AS (SELECT pair_id, count(*) / 64.0::DOUBLE AS coverage, -sum((n / t) * ln(n / t)) / ln(64) AS entropy FROM k JOIN t USING (pair_id) GROUP BY pair_id)
SELECT pair_id, match_count, inlier_count, round(rmse, 6) AS rmse_px, round(inlier_count / match_count, 6) AS inlier_ratio, round(CASE WHEN 2 * inlier_count > 4 THEN rmse END, 6) AS rmse_px_guarded,
  coalesce(CASE WHEN 2 * inlier_count > 4 THEN rmse END < 1, false) AS sub_pixel, round(rmse * 7.403::DOUBLE, 6) AS rmse_m, round(rmse * 7.403::DOUBLE / 5.05::DOUBLE, 6) AS rmse_source_px,
  coalesce(rmse * 7.403::DOUBLE / 5.05::DOUBLE < 1, false) AS sub_pixel_source, round(coalesce(coverage, 0), 6) AS coverage, round(coalesce(entropy, 0), 6) AS entropy FROM b LEFT JOIN u USING (pair_id)""")
def metric_summary(spark, sf_dir):
    ms = matches(spark, sf_dir)
    fitted = mm.residuals(ms, truth(ms)).withColumn("inlier", F.col("residual") <= DEFAULT.ransac_px)
    return rounded(mm.summarise(fitted, SIZE, 4, 7.403, 5.05))


@query(f"WITH {MATCHES}, d AS (SELECT pair_id, sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)) AS d FROM m) SELECT pair_id, count(*) AS n, count(*) FILTER (d <= 1) AS within_1, count(*) FILTER (d <= 3) AS within_3, count(*) FILTER (d <= 5) AS within_5, round(sqrt(avg(d * d) FILTER (d <= 3)), 6) AS rmse_3 FROM d GROUP BY pair_id")
def identity_score(spark, sf_dir):
    return rounded(mm.identity_score(matches(spark, sf_dir)))


@query(f"WITH {MATCHES}, {CELLS}, k AS (SELECT pair_id, greatest(1, count(*) // 64) AS k FROM m GROUP BY pair_id), r AS (SELECT pair_id, match_id, CAST(gy * 8 + gx AS INT) AS cell, CAST(row_number() OVER (PARTITION BY pair_id, gy, gx ORDER BY conf DESC, match_id) AS INT) AS rank FROM cells) SELECT pair_id, match_id, cell, rank FROM r JOIN k USING (pair_id) WHERE rank <= k")
def bucket_topk(spark, sf_dir):
    return mm.bucket_top_k(matches(spark, sf_dir), SIZE).select("pair_id", "match_id", "cell", "rank")


@query(f"WITH {MATCHES}, r AS (SELECT pair_id, match_id, row_number() OVER (PARTITION BY pair_id, round_even(xa / 40, 0), round_even(ya / 40, 0), round_even(xb / 40, 0), round_even(yb / 40, 0) ORDER BY match_id) AS k FROM m) SELECT pair_id, match_id FROM r WHERE k = 1")
def dedupe_first(spark, sf_dir):
    return mm.dedupe_first(matches(spark, sf_dir), 40.0).select("pair_id", "match_id")


@query(f"WITH {MATCHES}, {RES} SELECT pair_id, match_id, round(r, 6) AS residual FROM res")
def affine_apply(spark, sf_dir):
    ms = matches(spark, sf_dir)
    return rounded(mm.residuals(ms, truth(ms)).select("pair_id", "match_id", "residual"))


@query(f"WITH {MATCHES}, p AS (SELECT pair_id, match_id, xa, ya, 1e-5::DOUBLE * xa + 2e-5::DOUBLE * ya + 1 AS w FROM m) SELECT pair_id, match_id, round((1.02::DOUBLE * xa - 0.03::DOUBLE * ya + 21.5) / w, 6) AS px, round((0.03::DOUBLE * xa + 1.02::DOUBLE * ya - 4.25) / w, 6) AS py FROM p")
def perspective_apply(spark, sf_dir):
    m = F.array(*map(F.lit, [*TRUTH[:6], 1e-5, 2e-5, 1.0]))
    px, py = mm.apply_model(F.col("xa"), F.col("ya"), m)
    return rounded(matches(spark, sf_dir).select("pair_id", "match_id", px.alias("px"), py.alias("py")))


def _lsq(kind: str, source: str = "m") -> str:
    """Least squares of each pair as CTEs ending in lsq(pair_id, a, b, tx, c, d, ty)."""
    model = {
        "similarity": "SELECT *, (xu + yv) / (xx + yy) AS a, -(xv - yu) / (xx + yy) AS b, (xv - yu) / (xx + yy) AS c, (xu + yv) / (xx + yy) AS d FROM sums",
        "affine": "SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS d FROM sums",
    }[kind]
    return f"""means AS (SELECT pair_id, avg(xa) AS mx, avg(ya) AS my, avg(xb) AS mu, avg(yb) AS mv FROM {source} GROUP BY pair_id),
dev AS (SELECT pair_id, mx, my, mu, mv, xa - mx AS x, ya - my AS y, xb - mu AS u, yb - mv AS v FROM {source} JOIN means USING (pair_id)),
sums AS (SELECT pair_id, mx, my, mu, mv, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * u) AS xu, sum(y * u) AS yu, sum(x * v) AS xv, sum(y * v) AS yv FROM dev GROUP BY ALL),
lin AS ({model}), lsq AS (SELECT pair_id, a, b, mu - a * mx - b * my AS tx, c, d, mv - c * mx - d * my AS ty FROM lin)"""


def _model_cols(df, name="m"):
    return df.select("pair_id", *((F.round(F.element_at(name, i), 6) + F.lit(0.0)).alias(k) for i, k in zip(range(1, 7), ("a", "b", "tx", "c", "d", "ty"), strict=True)))


OUT = ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in ("a", "b", "tx", "c", "d", "ty"))


@query(f"WITH {MATCHES}, {_lsq('similarity')} SELECT pair_id, {OUT} FROM lsq")
def lsq_similarity(spark, sf_dir):
    return _model_cols(ft.least_squares(matches(spark, sf_dir), "similarity"))


@query(f"WITH {MATCHES}, {_lsq('affine')} SELECT pair_id, {OUT} FROM lsq")
def lsq_affine(spark, sf_dir):
    return _model_cols(ft.least_squares(matches(spark, sf_dir), "affine"))


@query(f"""WITH {MATCHES}, {_lsq('affine')} SELECT pair_id, round(sqrt(a * a + c * c), 6) AS scale_x, round((a * d - b * c) / sqrt(a * a + c * c), 6) AS scale_y, round(degrees(atan2(c, a)), 6) AS rotation_deg,
round((a * b + c * d) / (a * a + c * c), 6) + 0.0 AS shear, round(sqrt(a * a + c * c) / abs((a * d - b * c) / sqrt(a * a + c * c)), 6) AS anisotropy FROM lsq""")
def decompose_affine(spark, sf_dir):
    return rounded(mm.decompose(ft.least_squares(matches(spark, sf_dir), "affine")))


@query(f"""WITH {MATCHES}, {_lsq('affine')}, dec AS (SELECT pair_id, sqrt(a * a + c * c) AS sx, (a * d - b * c) / sqrt(a * a + c * c) AS sy, ty FROM lsq),
s AS (SELECT count(*) AS chunks, avg(sx) AS mean_x, abs(avg(sx) - 1) / (stddev_samp(sx) / sqrt(count(*))) AS sigma_x, avg(sy) AS mean_y, abs(avg(sy) - 1) / (stddev_samp(sy) / sqrt(count(*))) AS sigma_y, regr_slope(ty, CAST(pair_id AS DOUBLE)) AS drift FROM dec)
SELECT chunks, round(mean_x, 6) AS mean_x, round(sigma_x, 4) AS sigma_x, round(mean_y, 6) AS mean_y, round(sigma_y, 4) AS sigma_y, round(drift, 6) AS drift,
CASE WHEN sigma_x > 3 AND sigma_y > 3 THEN 'both axes' WHEN sigma_x > 3 THEN 'cross track' WHEN sigma_y > 3 THEN 'along track' ELSE 'neither' END AS verdict FROM s""")
def axis_significance(spark, sf_dir):
    models = ft.least_squares(matches(spark, sf_dir), "affine")
    rows = mm.decompose(models).join(models.select("pair_id", F.element_at("m", 6).alias("dy")), "pair_id").withColumn("row0", F.col("pair_id").cast("double"))
    out = mm.axis_significance(rows)
    return out.select("chunks", *(F.round(c, n).alias(c) for c, n in (("mean_x", 6), ("sigma_x", 4), ("mean_y", 6), ("sigma_y", 4), ("drift", 6))), "verdict")


def _ransac(kind: str, source: str = "m", tag: str = "") -> str:
    """CTEs that end in best{tag}(pair_id, a, b, tx, c, d, ty): hypotheses, scores, refit."""
    k, n = ft.POINTS[kind], DEFAULT.hypotheses
    pick = ", ".join(f"max({c}) FILTER (j = {i}) AS {c}{i}" for i in range(k) for c in ("xa", "ya", "xb", "yb"))
    if kind == "similarity":
        det = "(pow(xa1 - xa0, 2) + pow(ya1 - ya0, 2))"
        a, c = f"((xa1 - xa0) * (xb1 - xb0) + (ya1 - ya0) * (yb1 - yb0)) / {det}", f"((xa1 - xa0) * (yb1 - yb0) - (ya1 - ya0) * (xb1 - xb0)) / {det}"
        lin = f"{a} AS a, -({c}) AS b, {c} AS c, {a} AS d"
    else:
        det = "((xa1 - xa0) * (ya2 - ya0) - (xa2 - xa0) * (ya1 - ya0))"
        solve = lambda p, q: (f"(({p}1 - {p}0) * ({q}2 - {q}0) - ({p}2 - {p}0) * ({q}1 - {q}0)) / {det}")
        lin = f"{solve('xb', 'ya')} AS a, {solve('xa', 'xb')} AS b, {solve('yb', 'ya')} AS c, {solve('xa', 'yb')} AS d"
    lsq = _lsq(kind, f"inside{tag}")
    for name in ("means", "dev", "sums", "lin", "lsq"):
        lsq = lsq.replace(f"{name} AS (", f"{name}{tag} AS (").replace(f"FROM {name}", f"FROM {name}{tag}").replace(f"JOIN {name} ", f"JOIN {name}{tag} ")

    def tried(r: int, sets: str) -> str:
        """Sets, models and scores of round r; sets has pair_id, size and h."""
        t = f"{tag}{r}"
        return f"""dr{t} AS (SELECT pair_id, h, j, ((s * s) % 2147483647) % size AS q FROM (SELECT *, ((h * 4 + j + 1) * 1103515245 + 12345) % 2147483647 AS s FROM ({sets}), range({k}) u(j))),
st{t} AS (SELECT pair_id, h, {pick} FROM dr{t} JOIN rk{tag} USING (pair_id, q) GROUP BY pair_id, h),
hl{t} AS (SELECT *, {lin} FROM st{t} WHERE abs({det}) > 1e-9),
hy{t} AS (SELECT pair_id, h, a, b, xb0 - a * xa0 - b * ya0 AS tx, c, d, yb0 - c * xa0 - d * ya0 AS ty FROM hl{t}),
sc{t} AS (SELECT pair_id, h, count(*) FILTER (r <= 1.5) AS inl, round(sqrt(avg(r * r) FILTER (r <= 1.5)), 9) AS rmse FROM (SELECT pair_id, h, sqrt(pow(a * xa + b * ya + tx - xb, 2) + pow(c * xa + d * ya + ty - yb, 2)) AS r FROM {source} JOIN hy{t} USING (pair_id)) GROUP BY pair_id, h)"""

    missed = f"least(ln(greatest(1e-12::DOUBLE, 1 - pow(share, {k}))), -1e-12::DOUBLE)"
    need = f"greatest({n}, least({DEFAULT.most_hypotheses}, ceil(round({round(math.log(1 - DEFAULT.certainty), 9)!r}::DOUBLE / {missed}, 6))))"
    return f"""rk{tag} AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY (match_id * 1103515245 + 12345) % 2147483648, match_id) - 1 AS q FROM {source}),
ct{tag} AS (SELECT pair_id, count(*) AS n, least(count(*), {ft.POOL}) AS size FROM {source} GROUP BY pair_id),
{tried(1, f"SELECT pair_id, size, h FROM ct{tag}, range({n}) t(h)")},
nd{tag} AS (SELECT pair_id, size, {need} AS need FROM (SELECT pair_id, any_value(size) AS size, coalesce(max(inl), 0) / any_value(n) AS share FROM ct{tag} LEFT JOIN sc{tag}1 USING (pair_id) GROUP BY pair_id)),
{tried(2, f"SELECT pair_id, size, h FROM nd{tag}, range({n}, {DEFAULT.most_hypotheses}) t(h) WHERE h < need")},
hy{tag} AS (SELECT * FROM hy{tag}1 UNION ALL SELECT * FROM hy{tag}2), sc{tag} AS (SELECT * FROM sc{tag}1 UNION ALL SELECT * FROM sc{tag}2),
tp{tag} AS (SELECT pair_id, h FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY inl DESC, coalesce(rmse, 1e9), h) AS k FROM sc{tag}) WHERE k = 1),
ch{tag} AS (SELECT hy{tag}.* FROM hy{tag} JOIN tp{tag} USING (pair_id, h)),
inside{tag} AS (SELECT s.* FROM {source} s JOIN ch{tag} USING (pair_id) WHERE sqrt(pow(a * xa + b * ya + tx - xb, 2) + pow(c * xa + d * ya + ty - yb, 2)) <= 1.5),
{lsq},
best{tag} AS (SELECT pair_id, {", ".join(f"CASE WHEN isfinite(l.a) AND isfinite(l.b) THEN l.{x} ELSE h.{x} END AS {x}" for x in ("a", "b", "tx", "c", "d", "ty"))} FROM ch{tag} h LEFT JOIN lsq{tag} l USING (pair_id))"""


@query(f"WITH {MATCHES}, {_ransac('similarity')} SELECT pair_id, {OUT} FROM best")
def ransac_similarity(spark, sf_dir):
    return _model_cols(ft.ransac(matches(spark, sf_dir), "similarity"))


@query(f"WITH {MATCHES}, {_ransac('affine')} SELECT pair_id, {OUT} FROM best")
def ransac_affine(spark, sf_dir):
    return _model_cols(ft.ransac(matches(spark, sf_dir), "affine"))


RESIDUAL = "sqrt(pow(a * xa + b * ya + tx - xb, 2) + pow(c * xa + d * ya + ty - yb, 2))"


@query(f"WITH {MATCHES}, {_ransac('similarity')}, f AS (SELECT pair_id, {RESIDUAL} AS r FROM m JOIN best USING (pair_id)) SELECT pair_id, 'similarity' AS kind, count(*) FILTER (r <= 1.5) AS n_inliers, round(CASE WHEN 2 * count(*) FILTER (r <= 1.5) > 4 THEN sqrt(avg(r * r) FILTER (r <= 1.5)) END, 6) AS rmse FROM f GROUP BY pair_id")
def fit_guarded(spark, sf_dir):
    return rounded(ft.guarded_rmse(ft.fit(matches(spark, sf_dir), "similarity"), "similarity"))


@query(f"""WITH {MATCHES}, sp AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY (match_id * 1103515245 + 12345) % 2147483648) <= count(*) OVER (PARTITION BY pair_id) // 2 AS train FROM m), tr AS (SELECT pair_id, match_id, xa, ya, xb, yb FROM sp WHERE train), te AS (SELECT * FROM sp WHERE NOT train),
{_ransac('similarity', 'tr', '_s')}, {_ransac('affine', 'tr', '_a')},
hs AS (SELECT pair_id, median({RESIDUAL}) AS s FROM te JOIN best_s USING (pair_id) GROUP BY pair_id), ha AS (SELECT pair_id, median({RESIDUAL}) AS f FROM te JOIN best_a USING (pair_id) GROUP BY pair_id)
SELECT pair_id, CASE WHEN coalesce((s - f) / greatest(s, 1e-9) >= 0.15, false) THEN 'affine' ELSE 'similarity' END AS best, round(s, 6) AS similarity, round(f, 6) AS affine FROM hs LEFT JOIN ha USING (pair_id)""")
def select_model(spark, sf_dir):
    return rounded(ft.select_model(matches(spark, sf_dir), ("similarity", "affine")))


@query()
def fit_homography(spark, sf_dir):
    ms = matches(spark, sf_dir)
    fitted = ft.fit(ms, "homography")
    return rounded(ft.guarded_rmse(fitted, "homography"), 3)


@query(f"""WITH {MATCHES}, {_ransac('similarity')}, f AS (SELECT pair_id, count(*) AS n, count(*) FILTER ({RESIDUAL} <= 1.5) AS k FROM m JOIN best USING (pair_id) GROUP BY pair_id),
c AS (SELECT pair_id + 1 AS pair_id, n, k FROM f) SELECT b.pair_id, b.n AS base_inliers, c.n AS new_inliers, CASE WHEN c.n IS NULL THEN 'no result' WHEN c.n < 0.5 * b.n THEN 'halved' ELSE 'kept' END AS verdict FROM (SELECT pair_id, k AS n FROM f) b LEFT JOIN (SELECT pair_id, k AS n FROM c) c USING (pair_id)""")
def run_regression(spark, sf_dir):
    """Inliers of a pair against those of another run of it, here its neighbour's."""
    g = ft.guarded_rmse(ft.fit(matches(spark, sf_dir), "similarity"), "similarity").select("pair_id", "n_inliers")
    other = g.select((F.col("pair_id") + 1).alias("pair_id"), F.col("n_inliers").alias("new_inliers"))
    both = g.withColumnRenamed("n_inliers", "base_inliers").join(other, "pair_id", "left")
    return both.withColumn("verdict", F.when(F.col("new_inliers").isNull(), "no result").when(F.col("new_inliers") < 0.5 * F.col("base_inliers"), "halved").otherwise("kept"))


@query(f"WITH {MATCHES}, {RES} SELECT pair_id, printf('%.4f', xa) AS source_x, printf('%.4f', ya) AS source_y, printf('%.4f', xb) AS reference_x, printf('%.4f', yb) AS reference_y, printf('%.4f', conf) AS confidence, printf('%.4f', r) AS residual_px, CAST(r <= 1.5 AS INT) AS inlier FROM res")
def match_point_rows(spark, sf_dir):
    ms = matches(spark, sf_dir)
    return sinks.match_points(mm.residuals(ms, truth(ms)).withColumn("inlier", F.col("residual") <= DEFAULT.ransac_px))
