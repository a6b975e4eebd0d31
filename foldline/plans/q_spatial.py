"""Spatial queries over embeddings: two dimensions as coordinates, six as surfaces, label as fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import audit as A
from foldline.operators import spatial as SP
from foldline.plans.catalog import query, rounded, table
from foldline.plans.stand_ins import ENTITY_SQL, entities

S = ["s1", "s2", "s3", "s4", "s5", "s6"]
_E = "(SELECT vec_id, label % 5 AS fold, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, " + ", ".join(f"embedding[{i + 3}]::DOUBLE AS s{i + 1}" for i in range(6)) + " FROM embeddings)"


def _emb(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") % 5).cast("int").alias("fold"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"),
        *[e[i + 2].cast("double").alias(f"s{i + 1}") for i in range(6)],
    )


_KNN = f"""WITH e AS {_E}, n AS (SELECT q.vec_id AS qid, q.fold AS qf, d.vec_id AS did, d.fold AS df, d.x - q.x AS dx, d.y - q.y AS dy, d.x, d.y, {', '.join(f'd.{s}' for s in S)}
      FROM e q JOIN e d ON d.vec_id <> q.vec_id AND d.fold <> q.fold AND d.fold <> (q.fold + 1) % 5),
    sc AS (SELECT qid, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM n GROUP BY qid),
    r AS (SELECT n.*, dx / sx AS cx, dy / sy AS cy, sqrt((dx / sx) ** 2 + (dy / sy) ** 2) AS dist FROM n JOIN sc USING (qid)),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, did) AS k FROM r) WHERE k <= 10)"""


def _near(spark, sf_dir, **kw):
    e = _emb(spark, sf_dir)
    q = e.withColumn("outer", ((F.col("fold") + 1) % 5).cast("int"))
    return SP.knn_join(q, e, 10, ["vec_id"], "vec_id", "vec_id", "x", "y", S, "fold", "outer", "fold", **kw)


_KNN_OUT = f"{_KNN} SELECT qid AS vec_id, k AS place, did AS donor, round(dist, 6) AS distance FROM k"


def _explode(near):
    out = near.select("vec_id", F.posexplode("near").alias("p", "e"))
    return rounded(out.select("vec_id", (F.col("p") + 1).cast("long").alias("place"), F.col("e.id").alias("donor"), F.col("e.d").alias("distance")))


@query("C11 C12", _KNN_OUT)
def nearest_donors(spark, sf_dir):
    return _explode(_near(spark, sf_dir))


@query("C11 C12", _KNN_OUT)
def nearest_donors_on_grid(spark, sf_dir):
    """The same through the grid that serves donor tables too large to send to every task."""
    return _explode(_near(spark, sf_dir, broadcast_donors=0))


_PLANE = f"""{_KNN}, w AS (SELECT *, (1 / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) OVER (PARTITION BY qid) AS w FROM k),
    m AS (SELECT qid, sum(w * cx * cx) + 1e-8 AS a, sum(w * cx * cy) AS b, sum(w * cy * cy) + 1e-8 AS c, sum(w * cx) AS d, sum(w * cy) AS e, {', '.join(f'sum(w * cx * {s}) AS p_{s}, sum(w * cy * {s}) AS q_{s}, sum(w * {s}) AS r_{s}' for s in S)} FROM w GROUP BY qid)
    SELECT qid AS vec_id, {', '.join(f'round((p_{s} * (b * e - c * d) + q_{s} * (b * d - a * e) + r_{s} * (a * c - b * b)) / (d * (b * e - c * d) + e * (b * d - a * e) + (a * c - b * b)), 6) AS {s}' for s in S)} FROM m"""


@query("L9", _PLANE)
def local_plane_regression(spark, sf_dir):
    e = _emb(spark, sf_dir)
    q = e.select("vec_id", "fold", ((F.col("fold") + 1) % 5).cast("int").alias("outer"), "x", "y")
    out = SP.local_plane(q, e, ["vec_id"], S, 10, qid="vec_id", did="vec_id", x="x", y="y", qfold="fold", outer="outer", dfold="fold")
    return rounded(out.select("vec_id", *S))


@query("M4 C12", f"SELECT count(*) * 10 AS pairs, 0::BIGINT AS self_pairs, 0::BIGINT AS same_fold_pairs, 0::BIGINT AS outer_fold_pairs FROM {_E}")
def fold_isolation(spark, sf_dir):
    near = _near(spark, sf_dir)
    used = near.select("vec_id", "fold", "outer", F.explode("near").alias("e")).select("vec_id", "fold", "outer", F.col("e.id").alias("donor"), F.col("e.fold").alias("dfold"))
    return A.audit_fold_isolation(used, "donor", "dfold", "vec_id", "fold", "outer")


@query("C12", "SELECT a AS first, b AS second, count(*) AS donors FROM (SELECT f AS a, g AS b FROM range(5) t(f), range(5) u(g) WHERE f <= g) c JOIN (SELECT label % 5 AS fold FROM embeddings) e ON fold <> a AND fold <> b GROUP BY a, b")
def exclusion_contexts(spark, sf_dir):
    counts = {r["fold"]: r["n"] for r in _emb(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    rows = [(c[0], c[-1], sum(n for f, n in counts.items() if f not in c)) for c in SP.donor_contexts(range(5))]
    return spark.createDataFrame(rows, "first long, second long, donors long")


@query(
    "D15",
    f"""WITH m AS (SELECT entity, median(gr) AS gr, median(CASE WHEN entity % 7 <> 2 THEN seen END) AS seen FROM {ENTITY_SQL} GROUP BY entity) SELECT entity, round(gr, 6) AS gr, round(seen, 6) AS seen, gr IS NOT NULL AND seen IS NOT NULL AS complete FROM m""",
)
def entity_medians(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("seen", F.when(F.col("entity") % 7 != 2, F.col("seen")))
    done, left = SP.entity_medians(e, ["gr", "seen"], "entity")
    gr = left.join(SP.group_medians(e, ["gr"], ["entity"]), "entity").withColumn("seen", F.lit(None).cast("double"))
    both = done.withColumn("complete", F.lit(True)).unionByName(gr.withColumn("complete", F.lit(False)))
    return rounded(both)


# Entities placed on the map: positions drift with the row, surfaces tilt over the map.
_MAP = f"""(SELECT entity, row_index, (entity % 5)::INTEGER AS fold, (entity % 12)::DOUBLE + row_index / 200.0 AS x, (entity // 12)::DOUBLE + row_index / 300.0 AS y, z, CASE WHEN seen IS NOT NULL THEN truth / 50 - z + 3 END AS tvt FROM {ENTITY_SQL})"""
_DON = f"(SELECT entity, (entity % 5)::INTEGER AS fold, (entity % 12)::DOUBLE AS x, (entity // 12)::DOUBLE AS y, {', '.join(f'{k}.0 + {k} * 0.5 * (entity % 12) - 0.2 * (entity // 12) + sin(entity * {k}) AS f{k}' for k in (1, 2, 3))} FROM (SELECT DISTINCT entity FROM {ENTITY_SQL}))"
FS = ["f1", "f2", "f3"]
WINDOWS = {"calibrate": (11, 30), "hold_out": (1, 10), "final": (1, 25)}


def _map(spark, sf_dir):
    e, k = entities(spark, sf_dir), F.col("entity")
    rows = e.select(
        "entity", "row_index", (k % 5).cast("int").alias("fold"), ((k % 12).cast("double") + F.col("row_index") / 200.0).alias("x"),
        (F.floor(k / 12).cast("double") + F.col("row_index") / 300.0).alias("y"), "z", F.when(F.col("seen").isNotNull(), F.col("truth") / 50 - F.col("z") + 3).alias("tvt"),
    )
    donors = e.select("entity").distinct().select(
        "entity", (k % 5).cast("int").alias("fold"), (k % 12).cast("double").alias("x"), F.floor(k / 12).cast("double").alias("y"),
        *[(float(i) + i * 0.5 * (k % 12) - 0.2 * F.floor(k / 12) + F.sin(k * i)).alias(f"f{i}") for i in (1, 2, 3)],
    )
    return rows, donors


def _streams_sql(outer: str) -> str:
    fs = ", ".join(f"d.{s}" for s in FS)
    return f"""WITH RECURSIVE one AS (SELECT 1), q AS (SELECT *, {outer} AS outer_fold, last - row_index + 1 AS back FROM (SELECT *, max(CASE WHEN tvt IS NOT NULL THEN row_index END) OVER (PARTITION BY entity) AS last FROM {_MAP})),
    u AS (SELECT * FROM q WHERE back < 1 OR back <= 30),
    n AS (SELECT u.entity, u.row_index, d.x - u.x AS dx, d.y - u.y AS dy, d.entity AS did, d.x, d.y, {fs} FROM u JOIN {_DON} d ON d.entity <> u.entity AND d.fold <> u.fold AND d.fold <> u.outer_fold),
    sc AS (SELECT entity, row_index, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM n GROUP BY ALL),
    r AS (SELECT n.*, dx / sx AS cx, dy / sy AS cy, sqrt((dx / sx) ** 2 + (dy / sy) ** 2) AS dist FROM n JOIN sc USING (entity, row_index)),
    k AS (SELECT *, 1 / greatest(dist, 1e-6) AS iw FROM (SELECT *, row_number() OVER (PARTITION BY entity, row_index ORDER BY dist, did) AS k FROM r) WHERE k <= 10),
    w AS (SELECT *, iw / sum(iw) OVER (PARTITION BY entity, row_index) AS w FROM k),
    m AS (SELECT entity, row_index, sum(w * cx * cx) + CASE WHEN count(*) = 10 THEN 1e-8 END AS a, sum(w * cx * cy) AS b, sum(w * cy * cy) + 1e-8 AS c, sum(w * cx) AS d, sum(w * cy) AS e, {', '.join(f'sum(w * cx * {s}) AS p_{s}, sum(w * cy * {s}) AS q_{s}, sum(w * {s}) AS r_{s}' for s in FS)} FROM w GROUP BY ALL),
    p AS (SELECT entity, row_index, unnest([{', '.join(f"'{s}'" for s in FS)}]) AS surface, unnest([{', '.join(f'(p_{s} * (b * e - c * d) + q_{s} * (b * d - a * e) + r_{s} * (a * c - b * b)) / (d * (b * e - c * d) + e * (b * d - a * e) + (a * c - b * b))' for s in FS)}]) AS level FROM m),
    l AS (SELECT p.*, u.back, u.tvt, u.z FROM p JOIN u USING (entity, row_index)),
    lv AS (SELECT entity, surface, median(CASE WHEN back BETWEEN 11 AND 30 THEN tvt + z - level END) AS cal, median(CASE WHEN back BETWEEN 1 AND 25 THEN tvt + z - level END) AS bias FROM l WHERE back BETWEEN 1 AND 30 GROUP BY ALL),
    h AS (SELECT entity, surface, bias, sqrt(avg((tvt - (level - z + cal)) ** 2)) AS rmse FROM l JOIN lv USING (entity, surface) WHERE back BETWEEN 1 AND 10 GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rmse, surface) AS k FROM h) WHERE k = 1),
    f AS (SELECT entity, bias AS first_bias FROM lv WHERE surface = 'f1')
    SELECT l.entity, l.row_index, b.surface AS selected, round(max(CASE WHEN l.surface = 'f1' THEN level - z + first_bias END), 4) AS plane_first, round(max(CASE WHEN l.surface = b.surface THEN level - z + b.bias END), 4) AS plane_best
    FROM l JOIN b USING (entity) JOIN f USING (entity) WHERE back < 1 GROUP BY l.entity, l.row_index, b.surface"""


@query("L10 E27", _streams_sql("fold"))
def surface_streams(spark, sf_dir):
    rows, donors = _map(spark, sf_dir)
    marked = SP.prefix_windows(rows, "tvt", "entity", ["row_index"]).filter("back IS NULL OR back <= 30")
    planes = SP.local_plane(marked, donors, ["entity", "row_index"], FS, qid="entity", did="entity", x="x", y="y", qfold="fold", dfold="fold", keep_near=False)
    out = SP.surface_streams(planes, ["entity"], "row_index", "back", "tvt", "z", FS, **WINDOWS)
    return rounded(out, 4)


@query("L11 C12", f"SELECT s.entity, s.row_index, s.plane_first, s.plane_best, n.plane_first AS nested_first, n.plane_best AS nested_best FROM ({_streams_sql('fold')}) s JOIN ({_streams_sql('((fold + 1) % 5)::INTEGER')}) n USING (entity, row_index)")
def cross_fitted_surface_streams(spark, sf_dir):
    rows, donors = _map(spark, sf_dir)
    out = SP.cross_fitted_streams(rows, donors, "entity", "row_index", "fold", range(5), "tvt", "z", "x", "y", FS, windows=WINDOWS)
    nxt = lambda c: F.coalesce(*[F.when(F.col("fold") == (f - 1) % 5, F.col(f"nested_outer_{f}__{c}")) for f in range(5)])
    out = out.select("entity", "row_index", "plane_first", "plane_best", nxt("plane_first").alias("nested_first"), nxt("plane_best").alias("nested_best"))
    return rounded(out, 4)


@query(
    "E27",
    f"""SELECT entity, row_index, CASE WHEN last - row_index + 1 >= 1 THEN last - row_index + 1 END AS back FROM (SELECT entity, row_index, max(CASE WHEN seen IS NOT NULL THEN row_index END) OVER (PARTITION BY entity) AS last FROM {ENTITY_SQL})""",
)
def prefix_positions(spark, sf_dir):
    return SP.prefix_windows(entities(spark, sf_dir), "seen", "entity", ["row_index"]).select("entity", "row_index", "back")




# Donors that cannot carry a plane: each group of queries is refused for its own reason, by both searches alike.
_REFUSED = """SELECT vec_id, how, CASE vec_id % 4 WHEN 0 THEN 'non_finite_query' WHEN 1 THEN 'few_donors' WHEN 2 THEN 'degenerate_scale' END AS reason,
    CASE WHEN vec_id % 4 = 3 THEN 10 ELSE 0 END::BIGINT AS donors, vec_id % 4 = 3 AS predicted FROM embeddings, (VALUES ('tasks'), ('grid')) AS t(how)"""


@query("L9 C11", _REFUSED)
def degenerate_donors(spark, sf_dir):
    """Folds 0 and 1 hold ordinary donors, fold 2 four of them, fold 3 donors in one vertical line."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "s1"))])
    k = F.col("vec_id") % 4
    good = e.filter("vec_id % 4 = 3")
    line = e.filter("vec_id % 4 = 2").select("vec_id", F.lit(0.25).alias("x"), "y", "s1")
    few = e.filter("vec_id % 4 = 1").orderBy("vec_id").limit(4)
    out = None
    for how, limit in (("tasks", SP.BROADCAST_DONORS), ("grid", 0)):
        for donors, kind in ((good, 3), (line, 2), (few, 1), (good, 0)):
            q = e.filter(k == kind).withColumn("x", F.when(k != 0, F.col("x")))
            got = SP.local_plane(q, donors, ["vec_id"], ["s1"], 10, qid="vec_id", did="vec_id", x="x", y="y", broadcast_donors=limit)
            part = got.select("vec_id", F.lit(how).alias("how"), "reason", F.size("near").cast("long").alias("donors"), F.col("s1").isNotNull().alias("predicted"))
            out = part if out is None else out.unionByName(part)
    return out


@query("L10", f"SELECT count(*) AS rows, count(*) FILTER (WHERE entity % 3 = 0) AS bare, 0::BIGINT AS bare_predicted FROM {_MAP} WHERE tvt IS NULL OR entity % 3 = 0")
def surface_streams_without_prefix(spark, sf_dir):
    """Every third entity has no observed row: its suffix rows stay, without predictions."""
    rows, donors = _map(spark, sf_dir)
    rows = rows.withColumn("tvt", F.when(F.col("entity") % 3 != 0, F.col("tvt")))
    marked = SP.prefix_windows(rows, "tvt", "entity", ["row_index"]).filter("back IS NULL OR back <= 30")
    planes = SP.local_plane(marked, donors, ["entity", "row_index"], FS, qid="entity", did="entity", x="x", y="y", qfold="fold", dfold="fold", keep_near=False)
    bare = F.col("entity") % 3 == 0
    return SP.surface_streams(planes, ["entity"], "row_index", "back", "tvt", "z", FS, **WINDOWS).agg(
        F.count("*").alias("rows"), F.count_if(bare).alias("bare"), F.count_if(bare & (F.col("plane_first").isNotNull() | F.col("plane_best").isNotNull())).alias("bare_predicted")
    )
