"""Learned operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.cards import column_levels
from rowloom.models.embedder import RowPacker, TableEmbedder, TablePredictor
from rowloom.models.networks import METHODS, Design, Variable, anchor_count
from rowloom.models.trainer import Settings
from rowloom.functions.vectors import doubles
from rowloom.operators.boosting import fit_boosted
from rowloom.operators.cluster import assign_all, kmeans_sweep
from rowloom.operators.encoding import LevelCodes
from rowloom.operators.kmeans import fit
from rowloom.operators.knn import K_VALUES
from rowloom.operators.metrics import imputation_scores
from rowloom.operators.sampling import cached
from rowloom.operators.words import TextComponents, dense_components
from rowloom.plans import inputs
from rowloom.plans.baseline import baseline_run, tree_baseline
from rowloom.plans.inputs import rounded, table
from rowloom.plans.sweep import run_sweep
from rowloom.sources.grids import RunGrid

BATCH_ROWS = 256
EMBEDDING_WIDTH = 64
QUICK_ROUNDS = 8
LATENT, HIDDEN, PHI = 16, 32, (32,)
QUICK = Settings(epochs=2, batch_size=BATCH_ROWS, learning_rate=0.005)
PARTS_FEATURES = ("p_brand", "p_type", "p_size")


def _packed(df: DataFrame, card) -> tuple[DataFrame, RowPacker]:
    packer = RowPacker.fit(df, card)
    return cached(packer.transform(df)), packer


def embed_table(spark: SparkSession, folder: str) -> DataFrame:
    packed, packer = _packed(inputs.customers(spark, folder), inputs.CUSTOMERS)
    model = TableEmbedder("ANCHOR", LATENT, HIDDEN, PHI, QUICK).fit_packed(packed, packer)
    return model.transform_packed(packed).select("c_custkey", "split", "embedding", "target")


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    packed, packer = _packed(inputs.documents(spark, folder), inputs.DOCUMENTS)
    model = TableEmbedder("CLIP", LATENT, HIDDEN, PHI, QUICK).fit_packed(packed, packer)
    return model.transform_packed(packed).select("doc_id", "split", "embedding", "target")


def transfer_impute(spark: SparkSession, folder: str) -> DataFrame:
    packed, packer = _packed(inputs.orders(spark, folder), inputs.ORDERS)
    model = TableEmbedder("ANCHOR", LATENT, HIDDEN, PHI, QUICK).fit_packed(packed, packer)
    cells = model.impute_packed(packed.filter(F.col("split") == "test"), BATCH_ROWS)
    return imputation_scores(cells).select("variable", "kind", rounded("score"))


def predictor(spark: SparkSession, folder: str) -> DataFrame:
    packed, packer = _packed(inputs.parts(spark, folder), inputs.PARTS)
    model = TableEmbedder("GMC", LATENT, HIDDEN, PHI, QUICK).fit_packed(packed, packer)
    head = TablePredictor(LATENT, QUICK).fit_packed(packed, packer, model)
    return head.score(packed).select("split", rounded("score"))


def method_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Train and validation loss per epoch of every method."""
    packed, packer = _packed(inputs.parts(spark, folder), inputs.PARTS)
    rows = []
    for method in METHODS:
        trained = TableEmbedder(method, LATENT, HIDDEN, PHI, QUICK).fit_packed(packed, packer).trained
        rows += [(method, epoch, a, b) for epoch, a, b in trained.track]
    return spark.createDataFrame(rows, "method string, epoch int, train_loss double, valid_loss double")


def param_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Trainable parameters of every method over the part features, with the level counts of the table."""
    levels = {r["variable"]: r["levels"] for r in column_levels(table(spark, folder, "part"), ["p_brand", "p_type"]).collect()}
    variables = tuple(Variable(v, "cat" if v in levels else "num", i, 1, levels.get(v, 0)) for i, v in enumerate(PARTS_FEATURES))
    designs = {m: Design(m, variables, LATENT, HIDDEN, PHI, anchor_count(BATCH_ROWS)) for m in METHODS}
    heads = {m: Design(m, variables, LATENT, HIDDEN, PHI, outputs=1) for m in (*METHODS, "CONTROL")}
    rows = [(m, designs[m].parameter_count() if m in designs else None, heads[m].parameter_count()) for m in heads]
    return spark.createDataFrame(rows, "method string, embedder_params bigint, predictor_params bigint")


def kmeans_sweep_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_sweep(inputs.embeddings(spark, folder), "vec_id", "embedding")


def kmeans_fixed_points(spark: SparkSession, folder: str) -> DataFrame:
    """Per k: how far centres are from the means of the rows nearest to them, and the spread within and between clusters
    together, which is the whole spread only if they are those means."""
    train = inputs.embeddings(spark, folder).filter("split = 'train'").select(doubles("embedding").alias("v")).distinct()
    fitted = fit(train, "v", K_VALUES)
    centres = [(k, c, v.tolist()) for k, run in fitted.best.items() for c, v in enumerate(run.centres)]
    table = F.broadcast(spark.createDataFrame(centres, "k int, cluster int, centre array<double>"))  # one row per centre
    ks = F.array(*map(F.lit, K_VALUES))
    rows = assign_all(train, "v", fitted).select("v", F.inline(F.arrays_zip(ks.alias("k"), F.col("clusters").alias("cluster"))))
    within = F.aggregate(F.zip_with("v", "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda t, x: t + x)
    span = range(EMBEDDING_WIDTH)
    clusters = rows.join(table, ["k", "cluster"]).groupBy("k", "cluster", "centre").agg(
        F.count("*").alias("n"), F.sum(within).alias("within"), F.array(*[F.avg(F.col("v")[i]) for i in span]).alias("mean")
    )
    middle = train.agg(F.array(*[F.avg(F.col("v")[i]) for i in span]).alias("middle"))
    apart = F.aggregate(F.zip_with("centre", "middle", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda t, x: t + x)
    off = F.array_max(F.zip_with("mean", "centre", lambda x, c: F.abs(x - c)))
    found = clusters.join(F.broadcast(middle)).groupBy("k")
    return found.agg(
        F.sum("n").alias("n"), F.round(F.max(off), 6).alias("off_centre"), F.round(F.sum(F.col("within") + F.col("n") * apart), 5).alias("spread")
    )


def pca_text(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.documents(spark, folder)
    fitted = TextComponents.fit(df, "doc_id", "text")
    return fitted.transform(df.select("doc_id", "split", "text"), "doc_id", "text", "components").select("doc_id", "split", "components")


def pca_dense(spark: SparkSession, folder: str) -> DataFrame:
    return dense_components(inputs.embeddings(spark, folder), "embedding", "components").select("vec_id", "split", "components")


def pca_moments(spark: SparkSession, folder: str) -> DataFrame:
    """All components of the embeddings: their variances' power sums, the largest covariance of neighbours and mean."""
    df = dense_components(inputs.embeddings(spark, folder), "embedding", "c", width=EMBEDDING_WIDTH).filter("split = 'train'")
    span = range(EMBEDDING_WIDTH)
    spread = df.agg(
        *[F.var_pop(F.col("c")[i]).alias(f"v{i}") for i in span],
        F.greatest(*[F.abs(F.covar_pop(F.col("c")[i], F.col("c")[i + 1])) for i in span[:-1]]).alias("cross"),
        F.greatest(*[F.abs(F.avg(F.col("c")[i])) for i in span]).alias("centre"),
    )
    power = lambda p: sum((F.pow(F.col(f"v{i}"), F.lit(p)) for i in span), F.lit(0.0))
    rows = [("variance", power(1)), ("squares", power(2)), ("cubes", power(3)), ("cross", F.col("cross")), ("centre", F.col("centre"))]
    return spread.select(F.inline(F.array(*[F.struct(F.lit(n).alias("moment"), F.round(v, 6).alias("value")) for n, v in rows])))


def tree_baseline_parts(spark: SparkSession, folder: str) -> DataFrame:
    return tree_baseline(inputs.parts(spark, folder), inputs.PARTS, rounds=QUICK_ROUNDS)


def tree_baseline_orders(spark: SparkSession, folder: str) -> DataFrame:
    return tree_baseline(inputs.orders(spark, folder), inputs.ORDERS, rounds=QUICK_ROUNDS)


def boosted_stump(spark: SparkSession, folder: str) -> DataFrame:
    """The first split of a boosted regression of the price: which level or bound parts it best, and both leaves."""
    df = inputs.parts(spark, folder).filter("split = 'train'")
    levels = LevelCodes.fit(df, ["p_brand", "p_type"])
    codes = levels.transform(df)
    model = fit_boosted(codes, levels.columns, [levels.sizes[c] for c in levels.columns], ["p_size"], "p_retailprice", rounds=1, depth=1)
    tree = model.rounds[0][0]
    variable, at = tree.splits[0]
    name = [*levels.columns, "p_size"][variable]
    parts = model.predict(codes, levels.columns, ["p_size"]).groupBy(F.round("prediction", 4).alias("prediction")).agg(F.count("*").alias("n"))
    if variable < len(levels.columns):
        bound = levels.table.filter((F.col("variable") == name) & (F.col("code") == at)).select(F.col("level").alias("bound"))
    else:
        bound = spark.range(1).select(F.lit(str(int(model.cuts[0][at]))).alias("bound"))
    return parts.join(F.broadcast(bound)).select(F.lit(name).alias("variable"), "bound", "prediction", "n")


def baseline_replicate(spark: SparkSession, folder: str) -> DataFrame:
    return baseline_run(inputs.parts(spark, folder), inputs.PARTS, rounds=QUICK_ROUNDS)


def run_sweep_customers(spark: SparkSession, folder: str) -> DataFrame:
    grid = RunGrid((BATCH_ROWS,), (0.005,), (LATENT,), ("CONTROL", "ANCHOR"), replicates=1, epochs=1, hidden=HIDDEN, phi=PHI)
    return run_sweep(inputs.customers(spark, folder), inputs.CUSTOMERS, "customer", grid, ks=(2, 5, 10))


QUERIES = {
    "embed_table": embed_table,
    "embed_documents": embed_documents,
    "transfer_impute": transfer_impute,
    "predictor": predictor,
    "method_losses": method_losses,
    "param_counts": param_counts,
    "kmeans_sweep": kmeans_sweep_embeddings,
    "kmeans_fixed_points": kmeans_fixed_points,
    "pca_text": pca_text,
    "pca_dense": pca_dense,
    "pca_moments": pca_moments,
    "boosted_stump": boosted_stump,
    "tree_baseline": tree_baseline_parts,
    "tree_baseline_classes": tree_baseline_orders,
    "baseline_run": baseline_replicate,
    "run_sweep": run_sweep_customers,
}

_L, _H, _P, _K = LATENT, HIDDEN, PHI[0], anchor_count(BATCH_ROWS)
_M = len(PARTS_FEATURES)

ORACLES = {
    "boosted_stump": f"""WITH p AS {inputs.PARTS_SQL}, t AS (SELECT * FROM p WHERE split = 'train'),
      a AS (SELECT avg(p_retailprice) AS base, count(*) AS n FROM t), r AS (SELECT *, p_retailprice - base AS g FROM t, a),
      s AS (SELECT 'p_brand' AS variable, p_brand AS bound, count(*) AS n_l, sum(g) AS s_l FROM r GROUP BY p_brand
        UNION ALL SELECT 'p_type', p_type, count(*), sum(g) FROM r GROUP BY p_type
        UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), sum(count(*)) OVER w, sum(sum(g)) OVER w FROM r GROUP BY p_size WINDOW w AS (ORDER BY p_size)),
      best AS (SELECT *, n - n_l AS n_r FROM s, a WHERE n_l < n
        ORDER BY s_l * s_l / (n_l + 1) + s_l * s_l / (n - n_l + 1) DESC LIMIT 1)
      SELECT variable, bound, round(base + 0.3 * s_l / (n_l + 1), 4) AS prediction, n_l::BIGINT AS n FROM best
      UNION ALL SELECT variable, bound, round(base - 0.3 * s_l / (n_r + 1), 4), n_r::BIGINT FROM best""",
    "kmeans_fixed_points": f"""WITH d AS {inputs.EMBEDDINGS_SQL}, t AS (SELECT DISTINCT embedding FROM d WHERE split = 'train'),
      r AS (SELECT row_number() OVER () AS r, embedding FROM t),
      e AS (SELECT r, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM r),
      s AS (SELECT i, var_pop(x) * count(*) AS s FROM e GROUP BY i)
      SELECT k::INT AS k, (SELECT count(*) FROM r) AS n, 0.0 AS off_centre, round((SELECT sum(s) FROM s), 5) AS spread FROM range(2, 11) t(k)""",
    "pca_moments": f"""WITH d AS {inputs.EMBEDDINGS_SQL}, t AS (SELECT vec_id, embedding FROM d WHERE split = 'train'),
      e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM t),
      m AS (SELECT i, avg(x) AS mean FROM e GROUP BY i), z AS (SELECT vec_id, e.i, x - mean AS x FROM e JOIN m ON e.i = m.i),
      c AS (SELECT a.i, b.i AS j, avg(a.x * b.x) AS c FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2),
      s AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
      SELECT 'variance' AS moment, round(sum(c), 6) AS value FROM c WHERE i = j
      UNION ALL SELECT 'squares', round(sum(c * c), 6) FROM c
      UNION ALL SELECT 'cubes', round(sum(c.c * s.c), 6) FROM c JOIN s ON c.i = s.j AND c.j = s.i
      UNION ALL SELECT 'cross', 0.0 UNION ALL SELECT 'centre', 0.0""",
    "param_counts": f"""WITH n AS (SELECT count(DISTINCT p_brand) + count(DISTINCT p_type) AS levels FROM part),
      e AS (SELECT levels * {_L} + {2 * _L} + {_L * _L + _L} AS narrow, levels * {_H} + {2 * _H} + {_H * _H + _H} AS broad,
        {_H * _P + _P + _P * _L + _L} AS anchor_phi, {_H * _H + _H + _H * _L + _L} AS gmc_phi,
        {_M * _L * _L + _L + _L * _L + _L} AS project, {_M * _L * _L + _L + _L + 1} AS head FROM n)
      SELECT 'CLIP' AS method, narrow + 1 AS embedder_params, narrow + head AS predictor_params FROM e
      UNION ALL SELECT 'GMC', 2 * broad + {_M * _H * _H + _H} + gmc_phi, broad + gmc_phi + head FROM e
      UNION ALL SELECT 'MCN', narrow + {_K * _L}, narrow + head FROM e
      UNION ALL SELECT 'ANCHOR', broad + anchor_phi + 1, broad + anchor_phi + head FROM e
      UNION ALL SELECT 'SCARF', narrow + project, narrow + head FROM e
      UNION ALL SELECT 'SUBTAB', narrow + {_L * _L + _L + _L * _L + _L}, narrow + head FROM e
      UNION ALL SELECT 'CONTROL', NULL, narrow + head FROM e""",
}
