"""DuckDB SQL for the registered queries, written apart from the Spark code: projections here are Gram-Schmidt steps."""

from __future__ import annotations

M, DIMS, HALF = 25, 64, 32
M_LDSC = 1000.0

SAMPLES = "samples AS (SELECT c_custkey::BIGINT AS sample_id FROM customer INTERSECT SELECT vec_id::BIGINT FROM embeddings)"
LATENTS = f"lat AS (SELECT sample_id, k::INT AS dim, embedding[k + 1]::DOUBLE AS z FROM embeddings JOIN samples ON vec_id = sample_id, range({DIMS}) AS r(k))"
COV = "cov AS (SELECT sample_id, c_acctbal::DOUBLE / 10000 AS c0, n_regionkey::DOUBLE AS c1 FROM customer JOIN samples ON c_custkey = sample_id JOIN nation ON c_nationkey = n_nationkey)"
TARGET = "tgt AS (SELECT sample_id, avg(o_totalprice::DOUBLE) / 100000 AS y FROM samples LEFT JOIN orders ON o_custkey = sample_id GROUP BY sample_id)"


def dosage(missing: bool = False) -> str:
    x = "least(coalesce(k, 0), 2)"
    if missing:
        x = f"CASE WHEN (31 * sample_id + 17 * chrom) % 20 <> 0 THEN {x} END"
    return f"""{SAMPLES},
bought AS (SELECT o_custkey AS s, split_part(p_brand, '#', 2)::INT AS b, count(*) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
panel AS (SELECT sample_id, v::INT AS variant_idx, (v + 1)::INT AS chrom FROM samples, range({M}) AS r(v)),
dos AS (SELECT sample_id, variant_idx, chrom, ({x})::INT AS x FROM panel LEFT JOIN bought ON s = sample_id AND b = chrom),
vs AS (SELECT variant_idx, count(x) AS n_obs, coalesce(sum(x), 0)::BIGINT AS sum_x, coalesce(sum(x * x), 0)::BIGINT AS sum_x2, coalesce(avg(x), 0) AS mean, greatest(coalesce(stddev_pop(x), 0), 1e-8) AS sd FROM dos GROUP BY variant_idx),
xs AS (SELECT sample_id, variant_idx, chrom, coalesce((x - mean) / sd, 0) AS xs FROM dos JOIN vs USING (variant_idx))"""


def standard(source: str = "lat", eps: str = "add", name: str = "zs") -> str:
    sd = "stddev_samp(z) + 1e-8" if eps == "add" else "greatest(stddev_samp(z), 1e-8)"
    return f"{name} AS (SELECT sample_id, dim, (z - mu) / sd AS z FROM {source} JOIN (SELECT dim, avg(z) AS mu, {sd} AS sd FROM {source} GROUP BY dim) USING (dim))"


def basis(kind: str, source: str = "cov") -> str:
    """Orthogonal columns that span the covariates: none, C as it is, or [1 | C]."""
    if kind == "none":
        return "basis AS (SELECT 0::BIGINT AS sample_id, 0 AS k, 0.0 AS e WHERE false)"
    if kind == "c":
        return f"""b1 AS (SELECT sample_id, c0 AS e0, c1 - (SELECT sum(c0 * c1) / sum(c0 * c0) FROM {source}) * c0 AS e1 FROM {source}),
basis AS (SELECT sample_id, 0 AS k, e0 AS e FROM b1 UNION ALL SELECT sample_id, 1, e1 FROM b1)"""
    return f"""b0 AS (SELECT sample_id, c0 - (SELECT avg(c0) FROM {source}) AS d0, c1 - (SELECT avg(c1) FROM {source}) AS d1 FROM {source}),
b1 AS (SELECT sample_id, d0, d1 - (SELECT sum(d0 * d1) / sum(d0 * d0) FROM b0) * d0 AS d1 FROM b0),
basis AS (SELECT sample_id, 0 AS k, 1.0 AS e FROM b1 UNION ALL SELECT sample_id, 1, d0 FROM b1 UNION ALL SELECT sample_id, 2, d1 FROM b1)"""


#: Residuals of traits (vz) and genotypes (vx) on the basis, and the sums made of them.
PROJECTED = f"""norm AS (SELECT k, sum(e * e) AS n2 FROM basis GROUP BY k),
zb AS (SELECT dim, k, sum(z * e) / any_value(n2) AS b FROM zs JOIN basis USING (sample_id) JOIN norm USING (k) GROUP BY dim, k),
zfit AS (SELECT sample_id, dim, sum(b * e) AS f FROM zb JOIN basis USING (k) GROUP BY sample_id, dim),
vz AS (SELECT zs.sample_id, zs.dim, z - coalesce(f, 0) AS v FROM zs LEFT JOIN zfit ON zs.sample_id = zfit.sample_id AND zs.dim = zfit.dim),
xb AS (SELECT variant_idx, k, sum(xs * e) / any_value(n2) AS b FROM xs JOIN basis USING (sample_id) JOIN norm USING (k) GROUP BY variant_idx, k),
xfit AS (SELECT sample_id, variant_idx, sum(b * e) AS f FROM xb JOIN basis USING (k) GROUP BY sample_id, variant_idx),
vx AS (SELECT xs.sample_id, xs.variant_idx, xs - coalesce(f, 0) AS v FROM xs LEFT JOIN xfit ON xs.sample_id = xfit.sample_id AND xs.variant_idx = xfit.variant_idx),
gram AS (SELECT a.variant_idx AS j, b.variant_idx AS k, sum(a.v * b.v) AS g FROM vx a JOIN vx b USING (sample_id) GROUP BY ALL),
nv AS (SELECT count(DISTINCT variant_idx)::DOUBLE AS m FROM xs),
tr AS (SELECT sum(g) FILTER (j = k) / any_value(m) AS t1, sum(g * g) / any_value(m * m) AS t2 FROM gram, nv),
nn AS (SELECT (SELECT count(DISTINCT sample_id) FROM zs) - (SELECT count(*) FROM norm) AS nc, (SELECT count(DISTINCT sample_id) FROM zs) AS n),
u AS (SELECT variant_idx, dim, sum(vx.v * vz.v) AS u FROM vx JOIN vz USING (sample_id) GROUP BY ALL),
qk AS (SELECT a.dim AS i, b.dim AS j, sum(a.u * b.u) / any_value(m) AS q FROM u a JOIN u b USING (variant_idx), nv GROUP BY ALL),
qp AS (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) AS q FROM vz a JOIN vz b USING (sample_id) GROUP BY ALL)"""

_R = "round({0}, 6) + 0.0"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def mom_no_c(missing: bool = False, where: str = "") -> str:
    xs = f"xs0 AS (SELECT * FROM xs), " if where else ""  # noqa: F541
    return f"""WITH {dosage(missing)}, {LATENTS}, {standard()}, {basis("none")}, {PROJECTED}
SELECT qk.i AS dim, {r("(qk.q - qp.q) / (t2 - n)")} AS h2 FROM qk JOIN qp USING (i, j), tr, nn WHERE qk.i = qk.j{xs and ""}"""


def _half(name: str, rest: int) -> str:
    body = mom_no_c().replace("JOIN vs USING (variant_idx))", f"JOIN vs USING (variant_idx) WHERE chrom % 2 = {rest})")
    return f"SELECT *, '{name}' AS chroms FROM ({body})"


SQL: dict[str, str] = {
    "variant_stats": f"WITH {dosage(True)} SELECT variant_idx, n_obs, sum_x, sum_x2, {r('mean')} AS mean, {r('sd')} AS sd FROM vs",
    "variant_naive_trace": f"WITH {dosage(True)} SELECT {r('sum(n_obs)::DOUBLE / count(*)')} AS tr_k FROM vs",
    "variant_standardized": f"WITH {dosage(True)} SELECT sample_id, variant_idx, {r('xs')} AS xs FROM xs",
    "variant_table": "SELECT DISTINCT (chrom - 1)::INT AS variant_idx, p_brand AS brand, chrom FROM (SELECT p_brand, split_part(p_brand, '#', 2)::INT AS chrom FROM part)",
    "kinship_matrix": f"WITH {dosage()} SELECT a.sample_id AS i, b.sample_id AS j, {r(f'sum(a.xs * b.xs) / {M}')} AS k FROM xs a JOIN xs b ON a.variant_idx = b.variant_idx AND a.sample_id <= b.sample_id GROUP BY ALL",
    "latents_standardized": f"WITH {SAMPLES}, {LATENTS}, {standard()} SELECT sample_id, " + ", ".join(f"{r(f'max(z) FILTER (dim = {k})')} AS z{k}" for k in range(DIMS)) + " FROM zs GROUP BY sample_id",
    "latents_correlation": f"WITH {SAMPLES}, {LATENTS} SELECT a.dim AS i, b.dim AS j, {r('corr(a.z, b.z)')} AS r FROM lat a JOIN lat b ON a.sample_id = b.sample_id AND a.dim < b.dim GROUP BY ALL",
    "latents_correlation_loss": f"WITH {SAMPLES}, {LATENTS}, c AS (SELECT round(corr(a.z, b.z), 6) AS r FROM lat a JOIN lat b ON a.sample_id = b.sample_id AND a.dim < b.dim GROUP BY a.dim, b.dim) SELECT {r('sum(abs(r))', 4)} AS loss FROM c",
    "latents_moment_loss": f"WITH {SAMPLES}, {LATENTS}, n AS (SELECT count(*) AS n FROM samples) SELECT {r('abs(sum(z * z * z)) / any_value(n) + abs(sum(z * z * z * z) / any_value(n) - 3)')} AS loss FROM lat, n",
    "latents_kl": f"""WITH {SAMPLES}, t AS (SELECT sample_id, embedding[k + 1]::DOUBLE AS m, ln(1 + exp(embedding[k + {HALF + 1}]::DOUBLE)) AS s FROM embeddings JOIN samples ON vec_id = sample_id, range({HALF}) AS r(k))
SELECT sample_id, {r('-0.5 * sum(1 + 2 * ln(s) - m * m - s * s) / 32')} AS kld, {r('-0.5 * sum(s) / 32')} AS pen FROM t GROUP BY sample_id""",
    "h2_mom": mom_no_c(),
    "h2_mom_missing": mom_no_c(True),
    "h2_even_odd": f"{_half('even', 0)} UNION ALL {_half('odd', 1)}",
    "h2_mom_covariates": f"""WITH {dosage()}, {LATENTS}, {standard()}, {COV}, {basis("c")}, {PROJECTED},
v AS (SELECT qk.i AS dim, qk.q * nc - qp.q * t1 AS v0, t2 * qp.q - t1 * qk.q AS v1 FROM qk JOIN qp USING (i, j), tr, nn WHERE qk.i = qk.j)
SELECT dim, {r("v0 / (v0 + v1 + CASE WHEN v0 + v1 >= 0 THEN 1e-8 ELSE -1e-8 END)")} AS h2 FROM v""",
    "h2_kinship": f"""WITH {dosage()}, {LATENTS}, {standard()},
k AS (SELECT a.sample_id AS i, b.sample_id AS j, sum(a.xs * b.xs) / {M} AS k FROM xs a JOIN xs b USING (variant_idx) GROUP BY ALL),
t AS (SELECT sum(k * k) - (SELECT count(*) FROM samples) AS t FROM k)
SELECT a.dim, {r("(sum(k * a.z * b.z) - sum(a.z * b.z) FILTER (i = j)) / any_value(t)")} AS h2 FROM k JOIN zs a ON a.sample_id = i JOIN zs b ON b.sample_id = j AND a.dim = b.dim, t GROUP BY a.dim""",
    "genetic_covariance": f"""WITH {dosage()}, {LATENTS}, {COV}, {TARGET},
both_ AS (SELECT lat.* FROM lat JOIN tgt USING (sample_id) WHERE y IS NOT NULL UNION ALL SELECT sample_id, {DIMS}, y FROM tgt WHERE y IS NOT NULL),
covy AS (SELECT cov.* FROM cov JOIN tgt USING (sample_id) WHERE y IS NOT NULL),
""".replace("FROM dos JOIN vs", "FROM dos JOIN vs").replace("FROM panel LEFT JOIN bought ON s = sample_id AND b = chrom)", "FROM panel LEFT JOIN bought ON s = sample_id AND b = chrom WHERE sample_id IN (SELECT o_custkey FROM orders))") + f"""{standard("both_")}, {basis("1c", "covy")}, {PROJECTED},
num AS (SELECT qk.i, qk.j, qk.q * nc - qp.q * t1 AS v, t2 * nc - t1 * t1 AS det FROM qk JOIN qp USING (i, j), tr, nn)
SELECT a.i AS dim, {r("a.v / a.det")} AS gamma, {r("greatest(-1, least(1, a.v / sqrt(greatest(b.v, 1e-8) * greatest(c.v, 1e-8))))")} AS rho
FROM num a JOIN num b ON b.i = a.i AND b.j = a.i JOIN num c ON c.i = {DIMS} AND c.j = {DIMS} WHERE a.j = {DIMS} AND a.i < {DIMS}""",
    "genetic_matrices": f"""WITH {dosage()}, {LATENTS}, {standard(eps="floor")}, {COV}, {basis("1c")}, {PROJECTED}
SELECT qk.i, qk.j, {r("(qk.q * nc - qp.q * t1) / (t2 * nc - t1 * t1)")} AS g, {r("qp.q / sqrt(greatest(a.q, 1e-12) * greatest(b.q, 1e-12))")} AS p
FROM qk JOIN qp USING (i, j) JOIN qp a ON a.i = qk.i AND a.j = qk.i JOIN qp b ON b.i = qk.j AND b.j = qk.j, tr, nn""",
    "association": f"""WITH {dosage()}, {LATENTS}, {standard(eps="floor")}, {COV}, {basis("1c")}, {PROJECTED},
t AS (SELECT u.variant_idx, u.dim, u / greatest(g, 1e-12) AS beta, sqrt(greatest(qp.q / greatest(nc - 1, 1), 1e-12) / greatest(g, 1e-12)) AS se
      FROM u JOIN gram ON j = u.variant_idx AND k = u.variant_idx JOIN qp ON qp.i = u.dim AND qp.j = u.dim, nn)
SELECT variant_idx, dim, {r("beta")} AS beta, {r("se")} AS se, {r("beta / se")} AS z, {r("(beta / se) * (beta / se)")} AS chisq FROM t""",
    "trace_hutchinson": f"""WITH {dosage()},
s AS (SELECT sample_id, p::INT AS probe, CASE WHEN md5(concat_ws(':', sample_id, p, 0))[1] < '8' THEN 1.0 ELSE -1.0 END AS g FROM samples, range(10) AS r(p)),
xg AS (SELECT probe, variant_idx, sum(xs * g) AS v FROM xs JOIN s USING (sample_id) GROUP BY ALL),
xx AS (SELECT probe, sample_id, sum(xs * v) AS r FROM xs JOIN xg USING (variant_idx) GROUP BY ALL)
SELECT probe, {r(f"sum(r * r) / {M * M}")} AS estimate FROM xx GROUP BY probe""",
}

_SNPS = """lines AS (SELECT l_partkey AS snp, count(*)::DOUBLE AS n, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY l_partkey),
ss AS (SELECT snp, n, (q - 25.5) / (14.43 / sqrt(n)) AS z, (d - 0.05) / (0.0316 / sqrt(n)) AS z2, ['A', 'g', 'G', 'C'][snp % 4 + 1] AS a1, ['G', 'a', 'A', 'T'][snp % 4 + 1] AS a2 FROM lines),
ld AS (SELECT p_partkey AS snp, 1 + p_size / 10 AS ld, 1 + p_size / 20 AS w_ld, substr(p_brand, 7, 1) AS trait FROM part)"""

SQL["ldsc_context"] = f"""WITH {_SNPS}
SELECT snp AS variant_idx, snp, {r("CASE WHEN upper(a1) = 'A' THEN z ELSE -z END")} AS z, {r("n")} AS n, {r("ld")} AS ld, {r("w_ld")} AS w_ld
FROM ss JOIN ld USING (snp) WHERE upper(a1) || upper(a2) IN ('AG', 'GA')"""
SQL["ldsc_summary"] = f"""WITH {_SNPS} SELECT trait, {r("avg(z * z)", 4)} AS mean_chisq, {r("median(z * z) / 0.4549", 4)} AS lambda_gc, {r("avg(z * z2)", 4)} AS mean_z1z2 FROM ss JOIN ld USING (snp) GROUP BY trait"""


def _irwls(name: str, rows: str, weight: str, null: float, fixed: bool) -> str:
    """Three weighted fits of y on ld * n / nbar; ``weight`` is over tot, ic and the columns of ``rows``."""
    out = f"""{name}a AS (SELECT trait, avg(n) AS nbar, {M_LDSC} * (avg(y) - {null}) / avg(ld * n) AS tot, {null}::DOUBLE AS ic FROM {rows} GROUP BY trait),
{name}0 AS (SELECT * FROM {name}a)"""
    for k in range(3):
        slope = f"(sxy - {null} * sx) / sxx" if fixed else "(sw * sxy - sx * sy) / (sw * sxx - sx * sx)"
        ic = f"{null}::DOUBLE" if fixed else f"(sy - {slope} * sx) / sw"
        out += f""",
{name}{k + 1} AS (SELECT trait, nbar, {M_LDSC} * {slope} / nbar AS tot, {ic} AS ic FROM (
  SELECT trait, any_value(nbar) AS nbar, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy
  FROM (SELECT trait, nbar, ld * n / nbar AS x, y, {weight} AS w FROM {rows} JOIN {name}{k} USING (trait)) GROUP BY trait))"""
    return out


_HW = f"1 / (2 * pow(ic + least(greatest(tot, 0), 1) * n * greatest(ld, 1) / {M_LDSC}, 2)) / greatest(w_ld, 1)"
_H = lambda h, i: f"(n * least(greatest({h}, 0), 1) * greatest(ld, 1) / {M_LDSC} + {i})"
_GW = f"1 / ({_H('h1', 'i1')} * {_H('h2', 'i2')} + pow(n * greatest(least(tot, 1), -1) * greatest(ld, 1) / {M_LDSC} + ic, 2)) / greatest(w_ld, 1)"
_ROWS = f"{_SNPS}, base AS (SELECT trait, n, ld, w_ld, z, z2 FROM ss JOIN ld USING (snp)), r1 AS (SELECT *, z * z AS y FROM base), r2 AS (SELECT *, z2 * z2 AS y FROM base)"
SQL["ldsc_h2"] = f"WITH {_ROWS}, {_irwls('h', 'r1', _HW, 1.0, False)} SELECT trait, {r('tot', 4)} AS tot, {r('ic', 4)} AS intercept FROM h3"
SQL["ldsc_h2_fixed"] = f"WITH {_ROWS}, {_irwls('h', 'r1', _HW, 1.0, True)} SELECT trait, {r('tot', 4)} AS tot, {r('ic', 4)} AS intercept FROM h3"
SQL["ldsc_rg"] = f"""WITH {_ROWS}, {_irwls('h', 'r1', _HW, 1.0, False)}, {_irwls('k', 'r2', _HW, 1.0, False)},
r3 AS (SELECT base.*, z * z2 AS y, h3.tot AS h1, h3.ic AS i1, k3.tot AS h2, k3.ic AS i2 FROM base JOIN h3 USING (trait) JOIN k3 USING (trait)),
{_irwls('g', 'r3', _GW, 0.0, False)}
SELECT trait, {r('h3.tot', 4)} AS h1, {r('k3.tot', 4)} AS h2, {r('g3.tot', 4)} AS gencov, CASE WHEN h3.tot > 0 AND k3.tot > 0 THEN {r('g3.tot / sqrt(h3.tot * k3.tot)', 4)} END AS rg
FROM h3 JOIN k3 USING (trait) JOIN g3 USING (trait)"""

SQL["cohort_ids"] = f"WITH {SAMPLES} SELECT sample_id FROM samples WHERE sample_id IN (SELECT o_custkey FROM orders) AND sample_id IN (SELECT user_id FROM events) AND sample_id IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SQL["cohort_complete"] = f"WITH {SAMPLES}, {COV}, {TARGET} SELECT sample_id, {r('c0')} AS c0, {r('c1')} AS c1, {r('y')} AS y FROM cov JOIN tgt USING (sample_id) WHERE c0 >= 0 AND y IS NOT NULL"
_SPLIT = f"""{SAMPLES}, ranked AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id || ':0')) AS k, count(*) OVER () AS n FROM samples),
sp AS (SELECT sample_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM ranked)"""
SQL["cohort_split"] = f"WITH {_SPLIT} SELECT sample_id, part FROM sp"
SQL["cohort_resume"] = f"WITH {_SPLIT} SELECT sample_id, part FROM sp WHERE part = 'train' AND sample_id IN (SELECT user_id FROM events)"
SQL["last_event"] = f"SELECT user_id, event_id, event_type, {r('value')} AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
SQL["nearest_event"] = f"""WITH p AS (
  SELECT c.user_id, c.event_id, c.value, e.event_id AS nearest_event_id, e.value AS nearest_value,
         row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.event_id - e.event_id), e.event_id) AS k
  FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e USING (user_id))
SELECT user_id, event_id, {r('value')} AS value, nearest_event_id, {r('nearest_value')} AS nearest_value FROM p WHERE k = 1"""
_LOG = """ep AS (SELECT (vec_id % 50)::INT AS epoch, k, avg(embedding[k + 1]::DOUBLE) AS a FROM embeddings, range(64) AS r(k) GROUP BY ALL),
lg AS (SELECT epoch, CASE WHEN k < 32 THEN 'train' ELSE 'val' END AS stream, (k % 32)::INT AS dim, round(a, 3) + 0.0 AS value FROM ep)"""
SQL["log_parse"] = f"WITH {_LOG} SELECT epoch, stream, dim, value FROM lg"
SQL["log_epoch_stats"] = f"WITH {_LOG} SELECT epoch, {r('avg(abs(value))')} AS mean, {r('stddev_pop(abs(value))')} AS sd, {r('max(abs(value))')} AS top FROM lg WHERE stream = 'val' AND dim < 3 GROUP BY epoch"
SQL["log_peak"] = f"WITH {_LOG} SELECT epoch, stream, dim, value FROM lg QUALIFY row_number() OVER (PARTITION BY epoch, stream ORDER BY value DESC, dim) = 1"
SQL["value_histogram"] = f"""WITH e AS (SELECT min(l_extendedprice) AS a, (max(l_extendedprice) - min(l_extendedprice)) / 59 AS w FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - a) / w), 58)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT b::INT AS bin, {r('a + b * w')} AS lo, {r('a + (b + 1) * w')} AS hi, coalesce(n, 0) AS n FROM range(59) AS r(b) CROSS JOIN e LEFT JOIN c ON bin = b"""
SQL["rank_sum"] = f"""WITH k AS (SELECT l_returnflag = 'R' AS t, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem WHERE l_quantity IS NOT NULL),
s AS (SELECT sum(rk) FILTER (t) AS w, count(*) FILTER (t) AS n1, count(*) FILTER (NOT t) AS n2 FROM k)
SELECT {r('(w - n1 * (n1 + n2 + 1) / 2.0) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12.0)')} AS z, n1, n2 FROM s"""
SQL["incremental_state"] = f"""WITH {dosage()},
last AS (SELECT user_id AS sample_id, arg_max(value, (event_id % 2) * 1000000000000 + event_id) / 100 AS z FROM events GROUP BY user_id),
zz AS (SELECT s.sample_id, 0 AS dim, coalesce(last.z, embedding[1]::DOUBLE) AS z FROM samples s JOIN embeddings ON vec_id = s.sample_id LEFT JOIN last ON last.sample_id = s.sample_id
       UNION ALL SELECT s.sample_id, k::INT, embedding[k + 1]::DOUBLE FROM samples s JOIN embeddings ON vec_id = s.sample_id, range(1, {DIMS}) AS r(k))
SELECT variant_idx, dim, {r('sum(xs * z)')} AS u FROM xs JOIN zz USING (sample_id) GROUP BY ALL"""
SQL["edge_continuity"] = f"""WITH p AS (SELECT k // 8 AS r, k % 8 AS c, embedding[k + 1]::DOUBLE AS v FROM embeddings, range(64) AS t(k) WHERE k < len(embedding))
SELECT {r('sum(CASE WHEN r = 7 THEN abs(v) ELSE 0 END) / count(*) + sum(CASE WHEN c = 7 THEN abs(v) ELSE 0 END) / count(*)')} AS loss FROM p"""


def _two_annotations() -> str:
    """Fixed intercept 1, so each pass solves two equations in closed form."""
    out = f"""WITH {_SNPS}, rows_ AS (SELECT ld.trait, n, ld.ld AS a, snp % 7 / 2 AS b, w_ld, z * z - 1 AS y FROM ss JOIN ld USING (snp)),
p0 AS (SELECT trait, avg(n) AS nbar, 1000 * avg(y) / avg((a + b) * n) AS est FROM rows_ GROUP BY trait)"""
    for k in range(3):
        out += f""",
p{k + 1} AS (SELECT trait, nbar, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) / nbar AS c0, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) / nbar AS c1, 1000 * (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) / nbar AS est
FROM (SELECT trait, any_value(nbar) AS nbar, sum(w * a * a * n * n / nbar / nbar) AS s11, sum(w * a * b * n * n / nbar / nbar) AS s12, sum(w * b * b * n * n / nbar / nbar) AS s22, sum(w * a * n / nbar * y) AS t1, sum(w * b * n / nbar * y) AS t2
FROM (SELECT *, 1 / (2 * pow(1 + least(greatest(est, 0), 1) * n * greatest(a + b, 1) / 1000, 2)) / greatest(w_ld, 1) AS w FROM rows_ JOIN p{k} USING (trait)) GROUP BY trait))"""
    return out + f" SELECT trait, {r('600 * c0 + 400 * c1', 4)} AS tot, {r('600 * c0', 4)} AS cat0, {r('400 * c1', 4)} AS cat1, 1.0::DOUBLE AS intercept FROM p3"


SQL["ldsc_h2_annotations"] = _two_annotations()


def _eliminated() -> str:
    """u'G^-1 u by trait: rows of the projected Gram matrix are eliminated one by one, each adding its pivot's part."""
    steps, parts = ["g0 AS MATERIALIZED (SELECT j AS i, k, g AS v FROM gram)", "u0 AS MATERIALIZED (SELECT variant_idx AS i, dim, u AS v FROM u)"], []
    for s in range(M):
        pivot = f"(SELECT v AS d FROM g{s} WHERE i = {s} AND k = {s})"
        steps.append(f"g{s + 1} AS MATERIALIZED (SELECT a.i, a.k, a.v - b.v * c.v / d AS v FROM g{s} a JOIN g{s} b ON b.i = a.i AND b.k = {s} JOIN g{s} c ON c.i = {s} AND c.k = a.k, {pivot} WHERE a.i > {s} AND a.k > {s})")
        steps.append(f"u{s + 1} AS MATERIALIZED (SELECT a.i, a.dim, a.v - b.v * c.v / d AS v FROM u{s} a JOIN g{s} b ON b.i = a.i AND b.k = {s} JOIN u{s} c ON c.i = {s} AND c.dim = a.dim, {pivot} WHERE a.i > {s})")
        parts.append(f"SELECT dim, v * v / d AS part FROM u{s}, {pivot} WHERE i = {s}")
    return ", ".join(steps) + f", parts AS ({' UNION ALL '.join(parts)})"


SQL["variance_explained"] = f"""WITH {dosage()}, {LATENTS}, {standard()}, {COV}, {basis("1c")}, {PROJECTED}, {_eliminated()}
SELECT dim, {r("sum(part) / (SELECT n - 1 FROM nn)")} AS r2 FROM parts GROUP BY dim"""


# Objectives, stochastic traces, state, comparisons.
_W = f"wt AS (SELECT k::INT AS dim, [1.0, 0.5, 0.0, 0.25, 1.0, 0.0, 0.0, 2.0][k % 8 + 1]::DOUBLE AS weight FROM range({DIMS}) AS r(k))"


_H2 = mom_no_c().replace("round((qk.q - qp.q) / (t2 - n), 6) + 0.0", "(qk.q - qp.q) / (t2 - n)")
_GP = SQL["genetic_matrices"].replace(r("(qk.q * nc - qp.q * t1) / (t2 * nc - t1 * t1)"), "(qk.q * nc - qp.q * t1) / (t2 * nc - t1 * t1)").replace(
    r("qp.q / sqrt(greatest(a.q, 1e-12) * greatest(b.q, 1e-12))"), "qp.q / sqrt(greatest(a.q, 1e-12) * greatest(b.q, 1e-12))")
_PROBES = f"""s AS (SELECT sample_id, p::INT AS probe, CASE WHEN md5(concat_ws(':', sample_id, p, 0))[1] < '8' THEN 1.0 ELSE -1.0 END AS g FROM samples, range(30) AS r(p)),
xg AS (SELECT probe, variant_idx, sum(xs * g) AS v FROM xs JOIN s USING (sample_id) GROUP BY ALL),
xx AS (SELECT probe, sample_id, sum(xs * v) AS r FROM xs JOIN xg USING (variant_idx) GROUP BY ALL),
pt AS (SELECT avg(e) AS t2p FROM (SELECT sum(r * r) / {M * M} AS e FROM xx GROUP BY probe))"""
SQL["h2_mom_probes"] = f"""WITH {dosage()}, {LATENTS}, {standard()}, {basis("none")}, {PROJECTED}, {_PROBES}
SELECT qk.i AS dim, {r("(qk.q - qp.q) / (t2p - n)")} AS h2 FROM qk JOIN qp USING (i, j), pt, nn WHERE qk.i = qk.j"""
SQL["h2_mom_epochs"] = f"""SELECT (dim // 32)::INT AS run, (dim // 8 % 4)::INT AS epoch, (dim % 8)::INT AS dim, h2 FROM ({mom_no_c()})"""
SQL["h2_weighted_loss"] = f"WITH {_W}, h AS ({_H2}) SELECT {r('-sum(weight * h2)', 4)} AS loss FROM h JOIN wt USING (dim)"
SQL["spectrum_marginal_loss"] = f"WITH {_W}, m AS ({_GP}) SELECT {r('-sum(weight * greatest(g / p, 0))', 4)} AS loss FROM m JOIN wt ON dim = i WHERE i = j"
_MSE = "SELECT vec_id AS sample_id, list_sum(list_transform(range(1, 33), lambda k: pow(embedding[k]::DOUBLE - embedding[k + 32]::DOUBLE, 2))) / 32 AS mse FROM embeddings"
SQL["vector_mse"] = f"SELECT sample_id, {r('mse')} AS mse FROM ({_MSE})"
_KL = SQL["latents_kl"].replace(r("-0.5 * sum(1 + 2 * ln(s) - m * m - s * s) / 32"), "-0.5 * sum(1 + 2 * ln(s) - m * m - s * s) / 32").replace(r("-0.5 * sum(s) / 32"), "-0.5 * sum(s) / 32")
_MOMENT = SQL["latents_moment_loss"].replace(r("abs(sum(z * z * z)) / any_value(n) + abs(sum(z * z * z * z) / any_value(n) - 3)"), "abs(sum(z * z * z)) / any_value(n) + abs(sum(z * z * z * z) / any_value(n) - 3)")
SQL["composite_loss"] = f"""WITH {_W}, h AS ({_H2}), her AS (SELECT -sum(weight * h2) AS her FROM h JOIN wt USING (dim)), kl AS ({_KL}), ms AS ({_MSE}), co AS ({SQL["latents_correlation_loss"]}), mo AS ({_MOMENT})
SELECT {r("avg(mse + kld) + 0.1 * any_value(her) + any_value(co.loss) + any_value(mo.loss) + avg(pen)", 4)} AS loss FROM kl JOIN ms USING (sample_id), her, co, mo"""
_FREE = f"WITH {_ROWS}, {_irwls('h', 'r1', _HW, 1.0, False)}"
SQL["intercept_summary"] = f"{_FREE} SELECT count(ic) AS n, {r('avg(ic)', 4)} AS mean, {r('stddev_samp(ic)', 4)} AS sd, {r('stddev_pop(ic)', 4)} AS sd_pop FROM h3"
_ASSOC = SQL["association"].rpartition("SELECT variant_idx, dim, ")[0].rstrip()
SQL["ldsc_rg_latents"] = f"""{_ASSOC}, {_W},
ext AS (SELECT split_part(p_brand, '#', 2)::INT - 1 AS variant_idx, count(*)::DOUBLE AS n2, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
base AS (SELECT t.dim AS trait, beta / se AS z, (q - 25.5) / (14.43 / sqrt(n2)) AS z2, (SELECT count(DISTINCT sample_id) FROM cov)::DOUBLE AS n1, n2, 1 + t.variant_idx * 7 % 25 / 5 AS ld, 1 + t.variant_idx * 3 % 10 / 5 AS w_ld
         FROM t JOIN ext USING (variant_idx) JOIN wt USING (dim) WHERE weight <> 0),
r1 AS (SELECT *, n1 AS n, z * z AS y FROM base), r2 AS (SELECT *, n2 AS n, z2 * z2 AS y FROM base),
{_irwls('h', 'r1', _HW, 1.0, True)}, {_irwls('k', 'r2', _HW, 1.0, True)},
r3 AS (SELECT base.*, sqrt(n1 * n2) AS n, z * z2 AS y, h3.tot AS h1, h3.ic AS i1, k3.tot AS h2, k3.ic AS i2 FROM base JOIN h3 USING (trait) JOIN k3 USING (trait)),
{_irwls('g', 'r3', _GW.replace("(n * least(greatest(h1", "(n1 * least(greatest(h1").replace("(n * least(greatest(h2", "(n2 * least(greatest(h2"), 0.0, True)}
SELECT trait AS dim, {r('h3.tot', 4)} AS h1, {r('k3.tot', 4)} AS h2, {r('g3.tot', 4)} AS gencov, CASE WHEN h3.tot > 0 AND k3.tot > 0 THEN {r('g3.tot / sqrt(h3.tot * k3.tot)', 4)} ELSE 0.0 END AS rg, NOT (h3.tot > 0 AND k3.tot > 0) AS skipped
FROM h3 JOIN k3 USING (trait) JOIN g3 USING (trait)"""


def _two_columns(name: str, rows: str, weight: str, null: float) -> str:
    """Three weighted fits on two LD score columns with a fixed intercept; 600 and 400 SNPs behind them."""
    out = f"{name}0 AS (SELECT trait, avg(n) AS nbar, 1000 * (avg(y) - {null}) / avg((a + b) * n) AS est, NULL::DOUBLE AS tot FROM {rows} GROUP BY trait)"
    for k in range(3):
        c0, c1 = "(s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) / nbar", "(s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) / nbar"
        out += f""",
{name}{k + 1} AS (SELECT trait, nbar, 1000 * {c0} AS est, 600 * {c0} + 400 * {c1} AS tot
FROM (SELECT trait, any_value(nbar) AS nbar, sum(w * a * a * n * n / nbar / nbar) AS s11, sum(w * a * b * n * n / nbar / nbar) AS s12, sum(w * b * b * n * n / nbar / nbar) AS s22, sum(w * a * n / nbar * (y - {null})) AS t1, sum(w * b * n / nbar * (y - {null})) AS t2
FROM (SELECT *, {weight} AS w FROM {rows} JOIN {name}{k} USING (trait)) GROUP BY trait))"""
    return out


_HW2 = "1 / (2 * pow(1 + least(greatest(est, 0), 1) * n * greatest(a + b, 1) / 1000, 2)) / greatest(w_ld, 1)"
_GW2 = "1 / ((n * least(greatest(h1, 0), 1) * greatest(a + b, 1) / 1000 + 1) * (n * least(greatest(h2, 0), 1) * greatest(a + b, 1) / 1000 + 1) + pow(n * greatest(least(est, 1), -1) * greatest(a + b, 1) / 1000, 2)) / greatest(w_ld, 1)"
SQL["ldsc_gencov_annotations"] = f"""WITH {_SNPS}, base AS (SELECT ld.trait, n, ld.ld AS a, snp % 7 / 2 AS b, w_ld, z, z2 FROM ss JOIN ld USING (snp)), r1 AS (SELECT *, z * z AS y FROM base), r2 AS (SELECT *, z2 * z2 AS y FROM base),
{_two_columns('h', 'r1', _HW2, 1.0)}, {_two_columns('k', 'r2', _HW2, 1.0)},
r3 AS (SELECT base.*, z * z2 AS y, h3.tot AS h1, k3.tot AS h2 FROM base JOIN h3 USING (trait) JOIN k3 USING (trait)), {_two_columns('g', 'r3', _GW2, 0.0)}
SELECT trait, {r('h3.tot', 4)} AS h1, {r('k3.tot', 4)} AS h2, {r('g3.tot', 4)} AS gencov FROM h3 JOIN k3 USING (trait) JOIN g3 USING (trait)"""
_ZZ = SQL["incremental_state"].rpartition("SELECT variant_idx, dim, ")[0].removeprefix("WITH ").rstrip()
_STATE = f"""WITH {_ZZ}, zs AS (SELECT sample_id, dim, z FROM zz), basis AS (SELECT sample_id, 0 AS k, 1.0 AS e FROM samples), {PROJECTED}"""
SQL["h2_of_state"] = f"""{_STATE}, v AS (SELECT qk.i AS dim, qk.q * nc - qp.q * t1 AS v0, t2 * qp.q - t1 * qk.q AS v1 FROM qk JOIN qp USING (i, j), tr, nn WHERE qk.i = qk.j)
SELECT dim, {r("v0 / (v0 + v1 + CASE WHEN v0 + v1 >= 0 THEN 1e-8 ELSE -1e-8 END)")} AS h2 FROM v"""
SQL["sumstats_of_state"] = f"""{_STATE}, t AS (SELECT u.variant_idx, u.dim, u / greatest(g, 1e-12) AS beta, sqrt(greatest(qp.q / greatest(nc - 1, 1), 1e-12) / greatest(g, 1e-12)) AS se
      FROM u JOIN gram ON j = u.variant_idx AND k = u.variant_idx JOIN qp ON qp.i = u.dim AND qp.j = u.dim, nn)
SELECT variant_idx, dim, {r("beta")} AS beta, {r("se")} AS se, {r("beta / se")} AS z, {r("(beta / se) * (beta / se)")} AS chisq FROM t"""
SQL["matrices_of_state"] = f"""{_STATE}
SELECT qk.i, qk.j, {r("(qk.q * nc - qp.q * t1) / (t2 * nc - t1 * t1)")} AS g, {r("qp.q / sqrt(greatest(a.q, 1e-12) * greatest(b.q, 1e-12))")} AS p
FROM qk JOIN qp USING (i, j) JOIN qp a ON a.i = qk.i AND a.j = qk.i JOIN qp b ON b.i = qk.j AND b.j = qk.j, tr, nn"""
SQL["log_split_parse"] = f"WITH {_LOG} SELECT epoch, stream || CASE WHEN dim < 16 THEN '_even' ELSE '_odd' END AS stream, (dim % 16)::INT AS dim, value FROM lg"
SQL["log_gencov_lines"] = """WITH ep AS (SELECT (vec_id % 50)::INT AS epoch, k, printf('%+.4e', avg(embedding[k + 1]::DOUBLE)) AS a FROM embeddings, range(64) AS r(k) GROUP BY ALL)
SELECT epoch, 'epoch ' || epoch || ' - gencov_train: ' || string_agg(a, ', ' ORDER BY k) FILTER (k < 32) || ' - gencov_val: ' || string_agg(a, ', ' ORDER BY k) FILTER (k >= 32) AS line FROM ep GROUP BY epoch"""
SQL["two_runs"] = f"""WITH {_LOG}, pk AS (SELECT epoch FROM lg WHERE stream = 'val' GROUP BY epoch ORDER BY avg(value) DESC, epoch LIMIT 1),
ne AS (SELECT DISTINCT lg.epoch, abs(lg.epoch - pk.epoch) AS d FROM lg, pk WHERE stream = 'train' ORDER BY d, lg.epoch LIMIT 1),
both_ AS (SELECT 'control' AS run, lg.* FROM lg JOIN ne USING (epoch) WHERE stream = 'train' UNION ALL SELECT 'experiment', lg.* FROM lg JOIN pk USING (epoch) WHERE stream = 'val'),
msk AS (SELECT b.run, b.epoch, b.dim, arg_min(m.value, abs(m.epoch - b.epoch) * 1000 + m.epoch) AS m FROM both_ b JOIN lg m ON m.stream = 'train' AND m.dim = b.dim GROUP BY ALL)
SELECT run, epoch, dim, value FROM both_ JOIN msk USING (run, epoch, dim) WHERE m >= 0"""


# What reads the state; reindexing, conditioning and lags.
_STATS = SQL["sumstats_of_state"].rpartition("SELECT variant_idx, dim, ")[0].rstrip()
SQL["rg_of_state"] = SQL["ldsc_rg_latents"].replace(_ASSOC, _STATS).replace("(SELECT count(DISTINCT sample_id) FROM cov)", "(SELECT count(*) FROM samples)")
SQL["ordered_reindex"] = f"WITH {_SPLIT}, {TARGET} SELECT sample_id, md5(sample_id::VARCHAR) AS place, {r('y')} AS y FROM sp JOIN tgt USING (sample_id) WHERE part = 'train'"
SQL["decoder_inputs"] = f"""WITH {SAMPLES}, {LATENTS}, {COV} SELECT sample_id, dim AS place, {r('z')} AS value FROM lat
UNION ALL SELECT sample_id, {DIMS}, {r('c0')} FROM cov UNION ALL SELECT sample_id, {DIMS + 1}, {r('c1')} FROM cov"""
SQL["sample_paths"] = f"WITH {SAMPLES} SELECT sample_id, min(url) AS path FROM samples JOIN pages ON page_id = sample_id GROUP BY sample_id"
SQL["epoch_after"] = f"""WITH e AS (SELECT user_id AS run, event_id AS epoch, value, event_type = 'error' AS closing, lead(value) OVER w AS next_value, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT run, epoch, {r('value')} AS value, {r('next_value')} AS next_value FROM e WHERE after IS NOT NULL AND NOT closing"""
#: The trace of (P + ridge I)^-1 G: the sum of the spectrum without its values. Rows of [P + ridge I | G] are eliminated one after another.
_GP_STATE = SQL["matrices_of_state"].replace(r("(qk.q * nc - qp.q * t1) / (t2 * nc - t1 * t1)"), "(qk.q * nc - qp.q * t1) / (t2 * nc - t1 * t1)").replace(
    r("qp.q / sqrt(greatest(a.q, 1e-12) * greatest(b.q, 1e-12))"), "qp.q / sqrt(greatest(a.q, 1e-12) * greatest(b.q, 1e-12))")


SQL["readouts_of_state"] = f"""WITH RECURSIVE {_W}, m AS MATERIALIZED ({_GP_STATE}),
e0 AS (SELECT i, j AS k, p + CASE WHEN i = j THEN 1e-4 ELSE 0 END AS v FROM m UNION ALL SELECT i, j + {DIMS}, g FROM m),
e AS (SELECT 0 AS s, i, list(v ORDER BY k) AS v FROM e0 GROUP BY i
  UNION ALL SELECT a.s + 1, a.i, CASE WHEN a.i = a.s THEN list_transform(a.v, lambda x: x / a.v[a.s + 1]) ELSE list_transform(list_zip(a.v, p.v), lambda z: z[1] - z[2] * (a.v[a.s + 1] / p.v[a.s + 1])) END
  FROM e a JOIN e p ON p.s = a.s AND p.i = a.s WHERE a.s < {DIMS})
SELECT {r(f"(SELECT sum(v[i + {DIMS} + 1]) FROM e WHERE s = {DIMS})", 4)} AS total, {r("(SELECT -sum(weight * greatest(g / p, 0)) FROM m JOIN wt ON dim = i WHERE i = j)", 4)} AS marginal"""
