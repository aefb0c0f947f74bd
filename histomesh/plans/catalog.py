"""The registered queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.functions.mathx import two_sided_sql
from histomesh.operators import autocorrelation as ac
from histomesh.operators import cells as ct
from histomesh.operators import embedding as em
from histomesh.operators import expression as ex
from histomesh.operators import graphs as gr
from histomesh.operators import layout as lo
from histomesh.operators import near as nr
from histomesh.operators import patterns as pt
from histomesh.operators import plots as pl
from histomesh.operators import shapes as sh
from histomesh.operators import vae as va
from histomesh.plans import adapters as ad
from histomesh.sources.catalog import ResultCatalog, checkpointed

RADIUS, K, REACH, STEPS = 4.0, 10, 12.0, 12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Digits to which each query's doubles are rounded.
DIGITS: dict[str, int] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (+ 0.0 turns a negative zero)."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6):
    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        DIGITS[name] = digits
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x})::double, {digits}) + 0.0 as {name}"


_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
_C = f"with {ad.CELLS_SQL}"
_E = f"""{_C}, edges as (select a.cell_id as cell_id_a, b.cell_id as cell_id_b, greatest({_D}, 1e-10) as distance from cells a join cells b
 on b.x between a.x - {RADIUS} and a.x + {RADIUS} and abs(a.y - b.y) <= {RADIUS} and a.cell_id < b.cell_id where {_D} <= {RADIUS}),
both_ways as (select cell_id_a as cell_id, cell_id_b as other, distance from edges union all select cell_id_b, cell_id_a, distance from edges)"""
_X = f"with {ad.EXPR_SQL}"
KINDS = ("click", "error", "purchase", "signup", "view")


def _graph(spark, sf_dir) -> DataFrame:
    return nr.radius_graph(ad.cells(spark, sf_dir), RADIUS)


# --- cells ---
query("cells_select", f"{_C} select cell_id, {r('x', 'x')} from cells")(lambda s, d: ct.select_columns(ad.cells(s, d), ["cell_id", "x"]))
query("cells_filter", f"{_C} select cell_id, fov_id, cluster from cells where fov_id = 1 and cluster = 'click'")(
    lambda s, d: ct.filter_equal(ad.cells(s, d), fov_id=1, cluster="click").select("cell_id", "fov_id", "cluster")
)
query("cells_bbox", f"{_C} select cell_id, {r('x', 'x')}, {r('y', 'y')} from cells where x between 10 and 300 and y between 50 and 200")(
    lambda s, d: ct.within_bbox(ad.cells(s, d), 10, 50, 300, 200).select("cell_id", "x", "y")
)
query(
    "cells_tiles",
    f"""{_C}, box as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, greatest(1, ceil((max(x) - min(x)) / 100))::bigint as nx,
 greatest(1, ceil((max(y) - min(y)) / 100))::bigint as ny from cells),
g as (select tx, ty, * from box, range((select nx from box)) a(tx), range((select ny from box)) b(ty))
select ty * nx + tx as tile, {r('x0 + tx * 100', 'x_min')}, {r('y0 + ty * 100', 'y_min')}, {r('least(x1, x0 + (tx + 1) * 100)', 'x_max')}, {r('least(y1, y0 + (ty + 1) * 100)', 'y_max')},
 (select count(*) from cells c where c.x between x0 + tx * 100 - 5 and x0 + (tx + 1) * 100 + 5 and c.y between y0 + ty * 100 - 5 and y0 + (ty + 1) * 100 + 5) as n_cells from g""",
)(lambda s, d: ct.tiles(ad.cells(s, d), 100.0, 5.0))
query("cells_batches", "select event_id // 2500 as batch, count(*) as n from events group by 1")(lambda s, d: ct.batches(ad.cells(s, d), 2500).groupBy("batch").agg(F.count(F.lit(1)).alias("n")))
query("cells_subsample")(lambda s, d: ct.subsample(ad.cells(s, d), 1000).select("cell_id", "x", "y"))
query("px_scale_coordinates", f"{_C} select cell_id, {r('x / 0.425', 'x')}, {r('y / 0.425', 'y')} from cells")(lambda s, d: ct.scale_coordinates(ad.cells(s, d), 0.2125, 1).select("cell_id", "x", "y"))
query("um_to_px", f"{_C} select cell_id, round_even(y / 0.425, 0)::bigint as px, {r('round_even(y / 0.425, 0) * 0.425', 'um')} from cells")(
    lambda s, d: ad.cells(s, d).select("cell_id", ct.um_to_px(F.col("y"), 0.2125, 1).alias("px")).withColumn("um", ct.px_to_um(F.col("px"), 0.2125, 1))
)

# --- expression ---
_M = f"{_X}, n as (select count(distinct cell) as n from expr)"
query("expr_normalize_total", f"{_X} select cell, gene, {r('value / sum(value) over (partition by cell) * 1e4', 'value')} from expr")(lambda s, d: ex.normalize_total(ad.expression(s, d)))
query("expr_log1p", f"{_X} select cell, gene, {r('ln(1 + value)', 'value')} from expr")(lambda s, d: ex.log1p(ad.expression(s, d)))
query("expr_select_genes", f"{_X}, five as (select p_name as gene, row_number() over (order by p_name) - 1 as pos from (select distinct p_name from part) order by p_name limit 5) select cell, gene, value, pos from expr join five using (gene)")(
    lambda s, d: ex.select_genes(ad.expression(s, d), [x.p_name for x in ad.read(s, d, "part").select("p_name").distinct().orderBy("p_name").limit(5).collect()])
)
query("expr_select_cells", f"{_X} select cell, gene, value, pos from expr join (select c_custkey as cell, row_number() over (order by c_custkey desc) - 1 as pos from customer where c_custkey in (select o_custkey from orders join lineitem on o_orderkey = l_orderkey) order by c_custkey desc limit 7) using (cell)")(
    lambda s, d: ex.select_cells(ad.expression(s, d), [x.cell for x in ad.expression(s, d).select("cell").distinct().orderBy(F.desc("cell")).limit(7).collect()])
)
_HVG = f"""{_X}, l as (select cell, gene, ln(1 + value) as value from expr), n as (select count(distinct cell) as n from l),
m as (select gene, sum(value) / any_value(n.n) as mean, (sum(value * value) - sum(value) * sum(value) / any_value(n.n)) / (any_value(n.n) - 1) as variance from l, n group by gene),
h as (select *, variance / mean as dispersion, row_number() over (order by variance / mean desc, gene) <= 20 as highly_variable from m)"""
query("expr_hvg", f"{_HVG} select gene, {r('mean', 'mean')}, {r('variance', 'variance')}, {r('dispersion', 'dispersion')}, highly_variable from h")(
    lambda s, d: ex.highly_variable_genes(ex.log1p(ad.expression(s, d)), 20)
)


@query(
    "expr_scale",
    f"""{_HVG}, c as (select distinct cell from l) select c.cell, h.gene, {r('greatest(-10, least(10, (coalesce(l.value, 0) - mean) / sqrt(variance)))', 'value')}
 from c cross join h left join l on l.cell = c.cell and l.gene = h.gene where highly_variable""",
)
def _scale(s, d):
    logged = checkpointed(ex.log1p(ad.expression(s, d)))
    n = ex.n_cells(logged)
    return ex.scale(logged, ex.highly_variable_genes(logged, 20, n).where("highly_variable"), n=n)


query(
    "expr_pearson",
    f"""{_X}, c as (select cell, sum(value) as n from expr group by 1), g as (select gene, sum(value) as g from expr group by 1), t as (select sum(value) as t, sqrt(count(distinct cell)) as top from expr),
mu as (select cell, gene, n * g / t as mu, top from c, g, t) select mu.cell, mu.gene, {r('greatest(-top, least(top, (coalesce(value, 0) - mu) / sqrt(mu + mu * mu / 100)))', 'value')}
 from mu left join expr e on e.cell = mu.cell and e.gene = mu.gene""",
)(lambda s, d: ex.pearson_residuals(checkpointed(ad.expression(s, d))))
_CL = f"""{_X}, {ad.SEGMENT_SQL}, z as (select cluster, count(*) as n from seg group by 1), g as (select distinct gene from expr),
u as (select cluster, gene, sum(value) as s, count(*) filter (value > 0) as k from expr join seg using (cell) group by all),
b as (select cluster, gene, coalesce(s, 0) / n as mean, coalesce(k, 0) / n as share from z cross join g left join u using (cluster, gene))"""
query("expr_dotplot", f"{_CL} select cluster, gene, {r('mean', 'mean')}, {r('share', 'share')} from b")(lambda s, d: ex.by_cluster(ad.expression(s, d), ad.segments(s, d)))
query("expr_heatmap", f"{_CL} select cluster, gene, {r('mean', 'mean')}, {r('(mean - avg(mean) over w) / (case when stddev_pop(mean) over w = 0 then 1 else stddev_pop(mean) over w end)', 'z')} from b window w as (partition by gene)")(
    lambda s, d: ex.heatmap(ad.expression(s, d), ad.segments(s, d))
)
query("expr_violin_quantiles", f"{_X}, {ad.SEGMENT_SQL} select cluster, gene, " + ", ".join(r(f"quantile_cont(value, {q})", f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)) + " from expr join seg using (cell) group by all")(
    lambda s, d: ex.quantiles(ad.expression(s, d), ad.segments(s, d))
)

_batches = lambda s, d: ad.read(s, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("batch"))
query("expr_vae_latent")(lambda s, d: va.vae_batch(ad.expression(s, d), _batches(s, d), n_latent=10, n_epochs=20)[0])
query("expr_vae_impute")(lambda s, d: va.vae_impute(ad.expression(s, d), n_latent=10, n_epochs=20))

# --- graphs ---
query("radius_graph", f"{_E} select cell_id_a, cell_id_b, {r('distance', 'distance')} from edges")(_graph)
query(
    "knn_graph",
    f"""{_C}, near as (select a.cell_id as p, unnest(arg_min(b.cell_id, {_D}, {K})) as q, unnest(min({_D}, {K})) as d from cells a join cells b on a.cell_id <> b.cell_id group by a.cell_id)
 select least(p, q) as cell_id_a, greatest(p, q) as cell_id_b, {r('greatest(min(d), 1e-10)', 'distance')} from near group by 1, 2""",
)(lambda s, d: gr.knn_graph(ad.cells(s, d), K))
_NW = f"{_E}, w as (select b.cell_id, c.cluster, count(*)::double as w, sum(1 / distance) as wd from both_ways b join cells c on c.cell_id = b.other group by all), nodes as (select distinct cell_id from both_ways)"
_pivot = lambda v: ", ".join(f"round(coalesce(sum({v}) filter (cluster = '{c}'), 0), 6) + 0.0 as \"{c}\"" for c in KINDS)
_DIV = "select cell_id, sum(p * ln(p + 1e-15)) as h, sum(p * p) as q from (select *, {v} / sum({v}) over (partition by cell_id) as p from w) group by 1"
query("nhood_composition", f"{_NW} select cell_id, {_pivot('w')} from w group by 1")(lambda s, d: nr.composition(ad.cells(s, d), RADIUS))
query("nhood_composition_weighted", f"{_NW} select cell_id, {_pivot('wd')} from w group by 1")(lambda s, d: nr.composition(ad.cells(s, d), RADIUS, weighted=True))
query("nhood_composition_all", f"{_NW} select c.cell_id, {_pivot('w').replace('(cluster', '(w.cluster')} from cells c left join w using (cell_id) group by 1")(
    lambda s, d: nr.composition(ad.cells(s, d), RADIUS, every=True)
)
for _name, _v in (("nhood_diversity", "w"), ("nhood_diversity_weighted", "wd")):
    query(_name, f"{_NW} select cell_id, {r('greatest(0, -h)', 'shannon')}, {r('1 - q', 'simpson')} from ({_DIV.format(v=_v)})")(lambda s, d, v=_v: nr.diversity(ad.cells(s, d), RADIUS, v == "wd"))
query("nhood_diversity_all", f"{_NW} select cell_id, {r('coalesce(greatest(0, -h), 0)', 'shannon')}, {r('coalesce(1 - q, 0)', 'simpson')} from cells left join ({_DIV.format(v='w')}) using (cell_id)")(
    lambda s, d: nr.diversity(ad.cells(s, d), RADIUS, every=True)
)
_HOP = f"""{_E}, two as (select distinct a.cell_id, b.other from both_ways a join both_ways b on a.other = b.cell_id where a.cell_id <> b.other),
n1 as (select cell_id, count(*) as n_order_1 from both_ways group by 1), n2 as (select cell_id, count(*) as n_order_2 from two anti join both_ways using (cell_id, other) group by 1)"""
query("nth_order", f"{_HOP} select cell_id, n_order_1, coalesce(n_order_2, 0) as n_order_2 from n1 left join n2 using (cell_id)")(lambda s, d: nr.nth_order(ad.cells(s, d), RADIUS, 2))
query("nth_order_all", f"{_HOP} select cell_id, coalesce(n_order_1, 0) as n_order_1, coalesce(n_order_2, 0) as n_order_2 from cells left join n1 using (cell_id) left join n2 using (cell_id)")(
    lambda s, d: nr.nth_order(ad.cells(s, d), RADIUS, 2, every=True)
)
_CO = f"""{_E}, z as (select cluster, count(*) as n from cells group by 1), o as (select least(a.cluster, b.cluster) as ca, greatest(a.cluster, b.cluster) as cb, count(*) as m
 from edges join cells a on a.cell_id = cell_id_a join cells b on b.cell_id = cell_id_b group by 1, 2),
k as (select p.cluster as cluster_a, q.cluster as cluster_b, coalesce(m, 0) as observed, (case when p.cluster = q.cluster then p.n * (p.n - 1) else 2 * p.n * q.n end) * (select count(*) from edges)
 / (select count(*) * (count(*) - 1) from cells) as expected from z p join z q on p.cluster <= q.cluster left join o on ca = p.cluster and cb = q.cluster)"""
query(
    "colocalization",
    f"{_CO} select cluster_a, cluster_b, observed, {r('expected', 'expected')}, {r('observed / expected', 'ratio')}, case when observed > 0 then round(log2(observed / expected), 6) + 0.0 else 'nan'::double end as log2_ratio from k",
)(lambda s, d: nr.colocalization(ad.cells(s, d), RADIUS))


@query("plot_colocalization_matrix", f"{_CO}, u as (select cluster_a as a, cluster_b as b, observed / expected as v from k union select cluster_b, cluster_a, observed / expected from k) select a as cluster, " + ", ".join(r(f"sum(v) filter (b = '{c}')", f'"{c}"') for c in KINDS) + " from u group by 1")
def _matrix(s, d):
    c = nr.colocalization(ad.cells(s, d), RADIUS).select("cluster_a", "cluster_b", "ratio")
    both = c.union(c.select("cluster_b", "cluster_a", "ratio").where("cluster_a <> cluster_b"))
    return both.withColumnRenamed("cluster_a", "cluster").groupBy("cluster").pivot("cluster_b", list(KINDS)).agg(F.sum("ratio"))


query(
    "border_enrichment",
    f"""{_E}, t as (select distinct b.cell_id from both_ways b join cells x on x.cell_id = b.cell_id join cells y on y.cell_id = b.other where x.cluster <> y.cluster),
p as (select cluster, count(*) as n_cells, count(t.cell_id) as n_border from cells left join t using (cell_id) group by 1), g as (select 2.0 * count(*) / (select count(*) from cells) as k from edges)
select cluster, n_cells, n_border, {r('n_border / n_cells', 'border_fraction')}, {r('n_border / n_cells / (1 - pow(n_cells / (select count(*) from cells), k))', 'enrichment')} from p, g""",
)(lambda s, d: nr.border_enrichment(ad.cells(s, d), RADIUS))
query(
    "clustering_coefficient",
    f"""{_E}, deg as (select cell_id, count(*) as k from both_ways group by 1), t as (select a.cell_id, count(*) as t from both_ways a join both_ways b on a.cell_id = b.cell_id and a.other < b.other
 join edges e on e.cell_id_a = a.other and e.cell_id_b = b.other group by 1)
select cell_id, {r('case when k > 1 then 2 * coalesce(t, 0) / (k * (k - 1)) else 0 end', 'clustering_coeff')} from cells left join deg using (cell_id) left join t using (cell_id)""",
)(lambda s, d: nr.clustering_coefficient(ad.cells(s, d), RADIUS))


@query("plot_neighborhood_bar", f"{_NW}, m as (select c.cluster, " + ", ".join(f"avg(coalesce(p.\"{k}\", 0)) as \"{k}\"" for k in KINDS) + f" from (select cell_id, {_pivot('w')} from w group by 1) p join cells c using (cell_id) group by 1) select cluster, " + ", ".join(r(f'"{k}" / ({" + ".join(chr(34) + q + chr(34) for q in KINDS)})', f'"{k}"') for k in KINDS) + " from m")
def _bar(s, d):
    mean = nr.mean_composition(ad.cells(s, d), RADIUS)
    whole = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return mean.select("cluster", *[(F.col(k) / whole).alias(k) for k in KINDS])


# --- autocorrelation ---
def _stat_sql(values: str, kind: str) -> str:
    z = "(value - e) / sqrt(var)"
    head = f"""{_E}, deg as (select cell_id, count(*)::double as k from both_ways group by 1), f as ({values}), v as (select f.* from f join deg using (cell_id)),
q as (select feature, avg(v) as mean from v group by 1), z as (select cell_id, v.feature, v - mean as z from v join q using (feature)),
m as (select feature, count(*)::double as n, sum(z * z) as m2, sum(pow(z, 4)) as m4 from z group by 1),
p as (select a.feature, 2.0 * count(*) as w, 2 * sum(a.z * b.z) as c, 2 * sum(pow(a.z - b.z, 2)) as d from edges join z a on a.cell_id = cell_id_a join z b on b.cell_id = cell_id_b and a.feature = b.feature group by 1),
s as (select sum(4 * k * k) as s2 from deg), b as (select *, w as s1, n * m4 / (m2 * m2) as k from m join p using (feature), s)"""
    if kind == "I":
        body = """x as (select feature, n * c / (w * m2) as value, -1 / (n - 1) as e, greatest((n * (s1 * (n * n - 3 * n + 3) - n * s2 + 3 * w * w) - k * (s1 * (n * n - n) - 2 * n * s2 + 6 * w * w))
 / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / ((n - 1) * (n - 1)), 1e-15) as var from b)"""
    else:
        body = """x as (select feature, (n - 1) * d / (2 * w * m2) as value, 1.0::double as e, greatest(((n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * k) - (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * k) / 4
 + w * w * (n * n - 3 - (n - 1) * (n - 1) * k)) / ((n - 1) * (n - 2) * (n - 3) * w * w), 1e-15) as var from b)"""
    return f"{head}, {body} select feature, {r('value', kind, 4)}, {r('e', f'expected_{kind}', 4)}, {r(z, 'z_score', 4)}, {r(two_sided_sql(f'({z})'), 'p_value', 4)} from x"


_NUM = "select cell_id, 'v' as feature, v from cells"
_CAT = "select a.cell_id, k.cluster as feature, (a.cluster = k.cluster)::int::double as v from cells a, (select distinct cluster from cells) k"
for _kind, _f in (("I", ac.moran_of), ("C", ac.geary_of)):
    _name = {"I": "morans_i", "C": "gearys_c"}[_kind]
    query(f"{_name}_numeric", _stat_sql(_NUM, _kind), 4)(lambda s, d, f=_f: f(nr.value_parts(ad.cells(s, d), RADIUS)))
    query(f"{_name}_categorical", _stat_sql(_CAT, _kind), 4)(lambda s, d, f=_f: f(nr.cluster_parts(ad.cells(s, d), RADIUS)))
for _star in (True, False):
    _o = int(_star)
    query(
        "getis_ord_gi_star" if _star else "getis_ord_gi",
        f"""{_E}, s as (select b.cell_id, count(*)::double as k, sum(c.v) as s from both_ways b join cells c on c.cell_id = b.other group by 1), g as (select count(*)::double as n, avg(v) as mean, stddev_pop(v) as sd from cells join s using (cell_id)),
x as (select cell_id, ((s + {_o} * v) - mean * (k + {_o})) / (sd * sqrt((n * (k + {_o}) - (k + {_o}) * (k + {_o})) / (n - 1))) as z from s join cells using (cell_id), g)
select cell_id, {r('z', 'gi_stat', 4)}, {r(two_sided_sql('z'), 'p_value', 4)} from x""",
        4,
    )(lambda s, d, star=_star: nr.getis_ord(ad.cells(s, d), RADIUS, star))

# --- patterns ---
_all = lambda s, d: pt.together(ad.cells(s, d))


def _ripley_sql(cluster: str, out: str) -> str:
    return f"""{_C}, c as (select cell_id, x, y, {cluster} as cluster from cells), a as (select cluster, count(*) as n, greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-10) as area from c group by 1),
st as (select cluster, n, area, j, {REACH} * j / {STEPS} as r from a, range(1, {STEPS + 1}) t(j) where n > 1),
d as (select a.cluster, least(greatest(ceil({_D} / {REACH} * {STEPS}), 1), {STEPS}) as j from c a join c b on b.x between a.x - {REACH} and a.x + {REACH} and abs(a.y - b.y) <= {REACH} and a.cell_id < b.cell_id and a.cluster = b.cluster where {_D} <= {REACH}),
h as (select cluster, j, count(*) as m from d group by 1, 2),
k as (select st.cluster, r, area * 2 * coalesce(sum(m), 0) / (n * (n - 1)) as k from st left join h on h.cluster = st.cluster and h.j <= st.j group by st.cluster, r, area, n) {out}"""


_K = f"select cluster, {r('r', 'r', 4)}, {r('k', 'K', 4)}, {r('pi() * r * r', 'K_theo', 4)} from k"
_steps = {"n_radii": STEPS, "max_radius": REACH}
query("ripley_k", _ripley_sql("'all'", _K), 4)(lambda s, d: pt.ripley_k(_all(s, d), **_steps))
query("ripley_k_by_cluster", _ripley_sql("cluster", _K), 4)(lambda s, d: pt.ripley_k(ad.cells(s, d), **_steps))
query("ripley_l", _ripley_sql("'all'", f"select cluster, {r('r', 'r', 4)}, {r('sqrt(greatest(k, 0) / pi()) - r', 'L', 4)} from k"), 4)(lambda s, d: pt.ripley_l(_all(s, d), **_steps))
query("plot_ripley", _ripley_sql("cluster", _K), 4)(lambda s, d: pt.ripley_k(ad.cells(s, d), **_steps).orderBy("cluster", "r"))


def _near_sql(cluster: str) -> str:
    return f"""{_C}, c as (select cell_id, x, y, {cluster} as cluster from cells), a as (select cluster, count(*) as n, greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-10) as area, least(max(x) - min(x), max(y) - min(y)) / 4 as top from c group by 1),
nn as (select a.cluster, a.cell_id, min({_D}) as d from c a join c b on a.cluster = b.cluster and a.cell_id <> b.cell_id group by all)"""


_G = f"select a.cluster, {r('2.0 * j / 20', 'r')}, {r('avg((d <= 2.0 * j / 20)::int)', 'G')}, {r('1 - exp(-any_value(n / area) * pi() * pow(2.0 * j / 20, 2))', 'G_theo')} from a join nn using (cluster), range(1, 21) t(j) group by a.cluster, j"
query("ripley_g", f"{_near_sql(chr(39) + 'all' + chr(39))} {_G}")(lambda s, d: pt.ripley_g(_all(s, d), 20, 2.0))
query("ripley_g_by_cluster", f"{_near_sql('cluster')} {_G}")(lambda s, d: pt.ripley_g(ad.cells(s, d), 20, 2.0))
_CE = f", e as (select cluster, any_value(n) as n, avg(d) as o, any_value(n / area) as l from nn join a using (cluster) group by 1), x as (select *, 1 / (2 * sqrt(l)) as p, (o - 1 / (2 * sqrt(l))) / (0.26136 / sqrt(n * l)) as z from e) select cluster, {r('o / p', 'R', 4)}, {r('o', 'r_observed', 4)}, {r('p', 'r_expected', 4)}, {r('z', 'z_score', 4)}, {r(two_sided_sql('z'), 'p_value', 4)} from x"
query("clark_evans", f"{_near_sql(chr(39) + 'all' + chr(39))}{_CE}", 4)(lambda s, d: pt.clark_evans(_all(s, d)))
query("clark_evans_by_cluster", f"{_near_sql('cluster')}{_CE}", 4)(lambda s, d: pt.clark_evans(ad.cells(s, d)))
query(
    "quadrat_density",
    f"""{_C}, b as (select min(x) - 1e-6 as x0, max(x) + 1e-6 as x1, min(y) - 1e-6 as y0, max(y) + 1e-6 as y1 from cells),
q as (select cluster, least(9, floor((x - x0) / ((x1 - x0) / 10))) as i, least(9, floor((y - y0) / ((y1 - y0) / 10))) as j, count(*)::double as c from cells, b group by all)
select cluster, {r('sum(c * c) / (sum(c) / 100) - sum(c)', 'chi2', 4)}, {r('sum(c) / 100', 'density_mean', 4)}, {r('sqrt(greatest(0, sum(c * c) / 100 - pow(sum(c) / 100, 2)))', 'density_std', 4)} from q group by 1""",
    4,
)(lambda s, d: pt.quadrat_density(ad.cells(s, d)).drop("p_value"))
query("quadrat_p_values")(lambda s, d: pt.quadrat_density(ad.cells(s, d)))
query("ripley_f")(lambda s, d: pt.ripley_f(ad.cells(s, d), 20, 8.0))
query("permutation_test_ratio")(lambda s, d: pt.permutation_test_near(ad.cells(s, d), RADIUS))
query("permutation_test_count")(lambda s, d: pt.permutation_test_near(ad.cells(s, d), RADIUS, statistic="count"))
query("dclf_envelope")(lambda s, d: pt.dclf_envelope(ad.cells(s, d), "G", n_radii=20, max_radius=4.0))

# --- shapes ---
_B = f"with {ad.BOXES_SQL}"
query("boundary_query_bbox", f"{_B} select cell_id, {r('x_min', 'x_min')}, {r('y_max', 'y_max')} from boxes where x_max >= 100 and x_min <= 200 and y_max >= 50 and y_min <= 120")(
    lambda s, d: sh.query_bbox(ad.boxes(s, d), 100, 50, 200, 120).select("cell_id", "x_min", "y_max")
)
query("boundary_query_radius", f"{_B} select cell_id from boxes where pow(greatest(x_min - 205, 205 - x_max, 0), 2) + pow(greatest(y_min - 103, 103 - y_max, 0), 2) <= 900")(
    lambda s, d: sh.query_radius(ad.boxes(s, d), 205.0, 103.0, 30.0).select("cell_id")
)
query("boundary_query_polygon", f"{_B} select cell_id from boxes where x_min >= 101 and x_max <= 260 and y_min >= 51 and y_max <= 171")(
    lambda s, d: sh.query_polygon(ad.boxes(s, d), [(101, 51), (260, 51), (260, 171), (101, 171)], "contains").select("cell_id")
)
_TOUCH = f"{_B}, p as (select a.cell_id as cell_id_a, b.cell_id as cell_id_b, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min) as w, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min) as h from boxes a join boxes b on a.cell_id < b.cell_id) select cell_id_a, cell_id_b, {r('case when w > 0 and h > 0 then 2 * (w + h) else greatest(w, h) end', 'shared_length')} from p where w >= 0 and h >= 0"
query("contact_graph_boxes", _TOUCH)(lambda s, d: sh.box_contact_graph(ad.boxes(s, d)))
query("contact_graph_polygons", _TOUCH)(lambda s, d: sh.contact_graph(ad.boxes(s, d)))
query(
    "box_morphology",
    f"""{_B}, s as (select *, x_max - x_min as w from boxes) select cell_id, {r('w * w', 'area')}, {r('4 * w', 'perimeter')}, {r('x_min + w / 2', 'centroid_x')}, {r('y_min + w / 2', 'centroid_y')}, {r('pi() / 4', 'circularity')}, 0.0::double as elongation,
 1.0::double as aspect_ratio, 1.0::double as solidity, 0.0::double as convexity_defects, 4::bigint as vertex_count, 1.0::double as rectangularity from s""",
)(lambda s, d: sh.cell_morphology(ad.boxes(s, d)).drop("eccentricity", "fractal_dimension"))
query("cell_morphology")(lambda s, d: sh.cell_morphology(ad.boxes(s, d)))
# rectangles twice as high as wide, with a hole of area 1
_H = f"{_B}, h as (select cell_id, x_min as x, y_min as y, x_max - x_min as w, 2 * pow(x_max - x_min, 2) as whole from boxes)"
query(
    "frame_morphology",
    f"""{_H} select cell_id, {r('whole - 1', 'area')}, {r('6 * w + 4', 'perimeter')}, {r('(whole * (x + w / 2) - x - 1.5) / (whole - 1)', 'centroid_x')}, {r('(whole * (y + w) - y - 1.5) / (whole - 1)', 'centroid_y')},
 {r('4 * pi() * (whole - 1) / pow(6 * w + 4, 2)', 'circularity')}, 0.5::double as elongation, 2.0::double as aspect_ratio, {r('(whole - 1) / whole', 'solidity')}, 0.0::double as eccentricity, 1.0::double as fractal_dimension,
 4::bigint as vertex_count, 1.0::double as convexity_defects, {r('(whole - 1) / whole', 'rectangularity')} from h""",
)(lambda s, d: sh.cell_morphology(ad.frames(s, d)))
query("frame_query_radius", f"{_H} select cell_id from h where pow(greatest(x - 201.5, 201.5 - x - w, 0), 2) + pow(greatest(y - 101.5, 101.5 - y - 2 * w, 0), 2) <= 0.16 and not (x + 1 + 0.4 < 201.5 and x + 2 - 0.4 > 201.5 and y + 1 + 0.4 < 101.5 and y + 2 - 0.4 > 101.5)")(
    lambda s, d: sh.query_radius(ad.frames(s, d), 201.5, 101.5, 0.4).select("cell_id")
)

# --- what plots draw: every cell, as the SQL has it ---
query("plot_spatial_scatter", f"{_C} select cell_id, {r('x', 'x')}, {r('y', 'y')}, cluster as value, true as categorical from cells where x between 10 and 500 and y between 20 and 300")(
    lambda s, d: pl.spatial_scatter(ad.cells(s, d), ad.clusters(s, d), "cluster", (10, 500), (20, 300), max_cells=None)
)
query("plot_spatial_polygons", f"{_B}, t as (select p_partkey::varchar as cell_id, p_type from part) select cell_id, p_type as value, true as categorical from boxes join t using (cell_id) where x_max >= 100 and x_min <= 300 and y_max >= 20 and y_min <= 150")(
    lambda s, d: pl.spatial_polygons(ad.boxes(s, d), ad.boxes(s, d).select("cell_id", F.col("cluster").alias("kind")), "kind", (100, 300), (20, 150), max_cells=None).drop("ring")
)
query("plot_scatter", f"with {ad.EMB_SQL} select cell_id, {r('v[1]', 'x')}, {r('v[2]', 'y')}, label as value, true as categorical from emb")(lambda s, d: pl.scatter(ad.embedding(s, d).select("cell_id", "v"), ad.embedding(s, d), "label", max_cells=None))
query("plot_spatial_expression", f"{_C}, {ad.EXPR_SQL} select c.cell_id, {r('x', 'x')}, {r('y', 'y')}, {r('coalesce(e.value, 0)', 'value')}, false as categorical from cells c left join (select * from expr where gene = (select min(p_name) from part)) e on e.cell::varchar = c.cell_id")(
    lambda s, d: pl.spatial_expression(ad.cells(s, d), ad.expression(s, d), ad.read(s, d, "part").agg(F.min("p_name")).first()[0], max_cells=None)
)

# --- embeddings ---
_V = f"with {ad.EMB_SQL}"
_NEAR = lambda k: f"{_V}, near as (select a.cell_id, unnest(arg_min(b.cell_id, list_distance(a.v, b.v), {k})) as other from emb a join emb b on a.cell_id <> b.cell_id group by a.cell_id)"
query("emb_knn_edges", f"{_NEAR(15)} select distinct least(cell_id, other) as cell_id_a, greatest(cell_id, other) as cell_id_b from near")(lambda s, d: em.knn_edges(ad.embedding(s, d), 15))
query("emb_knn_smooth", f"{_NEAR(15)} select n.cell_id, i::int as i, {r('avg(v[i + 1])', 'x')} from near n join emb e on e.cell_id = n.other, range(64) t(i) group by 1, 2")(
    lambda s, d: em.knn_smooth(ad.embedding(s, d), 15).select("cell_id", F.posexplode("v").alias("i", "x"))
)
query("emb_label_transfer", f"{_V} select a.cell_id, arg_min(b.label, list_distance(a.v, b.v)) as label from emb a, emb b where a.label % 2 = 1 and b.label % 2 = 0 group by 1")(
    lambda s, d: em.transfer_labels(ad.embedding(s, d).where("label % 2 = 1"), ad.embedding(s, d).where("label % 2 = 0"))
)
query("emb_pca")(lambda s, d: em.pca(ad.embedding(s, d), 10)[0])
query("emb_kmeans")(lambda s, d: em.kmeans(ad.embedding(s, d), 10))
query("emb_ward")(lambda s, d: em.ward_clusters(ad.embedding(s, d), 10))
query("emb_leiden")(lambda s, d: em.modularity_clusters(ad.embedding(s, d)))
query("emb_louvain")(lambda s, d: em.modularity_clusters(ad.embedding(s, d), refine=False))
query("emb_diffmap")(lambda s, d: em.diffmap(ad.embedding(s, d)))
query("emb_umap")(lambda s, d: lo.umap(ad.embedding(s, d)))
query("emb_tsne")(lambda s, d: lo.tsne(ad.embedding(s, d)))
query("emb_fuzzy_graph")(lambda s, d: lo.fuzzy_graph(ad.embedding(s, d).select("cell_id", "v"), 15))
query("emb_magic")(lambda s, d: em.magic(ad.embedding(s, d)))
query("emb_alra")(lambda s, d: em.alra(ad.embedding(s, d)))
query("emb_harmony")(lambda s, d: em.harmony(ad.embedding(s, d).select("cell_id", "v"), ad.embedding(s, d).select("cell_id", (F.col("label") % 3).alias("batch"))))


@query("result_catalog_roundtrip", f"{_C} select cell_id, {r('x', 'x')} from cells")
def _roundtrip(s, d):
    from uuid import uuid4

    checkpointed(s.range(1))  # settles the checkpoint folder
    results = ResultCatalog(s, f"{s.sparkContext.getCheckpointDir()}/results-{uuid4().hex}")
    results.put("cells_xy", ad.cells(s, d).select("cell_id", "x"))
    return results.get("cells_xy")
