"""Similarity, neighbour, cluster and metric operators over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import vectors as vec
from rowloom.operators.cluster import assign_nearest, centroids, silhouettes
from rowloom.operators.encoding import OneHot
from rowloom.operators.knn import knn_join, knn_sweep
from rowloom.operators.lookup import lookup_join
from rowloom.operators.metrics import balanced_accuracy, imputation_scores, mse
from rowloom.operators.retrieval import batch_contrastive_loss, batch_similarity, retrieve
from rowloom.functions.hashing import split_sql
from rowloom.operators.sampling import assign_batches, assign_batches_sql, with_split
from rowloom.operators.scaling import MinMax
from rowloom.plans import inputs
from rowloom.plans.inputs import EMBEDDINGS_SQL, PARTS_SQL, rounded

BATCH_ROWS = 64
PART_WIDTH = 16
PARTS = 4
TEMPERATURE = 0.07  # fixed value: initial temperature of the cosine losses


def knn_sweep_classification(spark: SparkSession, folder: str) -> DataFrame:
    scores = knn_sweep(inputs.embeddings(spark, folder), "vec_id", "embedding", "label", "classification")
    return scores.select("k", rounded("validation_score"), rounded("test_score"), "chosen")


def _part_features(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.parts(spark, folder)
    scaled = MinMax.fit(df, ["p_size"], train_only=True).transform(df)
    return OneHot.fit(scaled, ["p_brand", "p_type"], ["p_size"]).transform(scaled)


def knn_sweep_regression(spark: SparkSession, folder: str) -> DataFrame:
    scores = knn_sweep(_part_features(spark, folder), "p_partkey", "features", "p_retailprice", "regression")
    return scores.select("k", rounded("validation_score"), rounded("test_score"), "chosen")


def knn_join_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder)
    train, rest = df.filter(F.col("split") == "train"), df.filter(F.col("split") != "train")
    found = knn_join(rest, train, "vec_id", "vec_id", "embedding", "label", k=5)
    pairs = found.select("vec_id", F.posexplode("neighbours").alias("pos", "near"))
    return pairs.select(
        "vec_id", (F.col("pos") + 1).alias("rank"), F.col("near.key").alias("neighbour"),
        F.round("near.distance", 6).alias("distance"),
    )


def knn_join_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours over unscaled columns of very different size: price, order time in seconds and balance."""
    customers = inputs.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    df = inputs.table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    seconds = F.unix_timestamp("o_orderdate").cast("double")
    df = with_split(df.select("o_orderkey", F.array("o_totalprice", seconds, "c_acctbal").alias("v")), "o_orderkey")
    found = knn_join(df.filter("split = 'test'"), df.filter("split = 'train'"), "o_orderkey", "o_orderkey", "v", k=3)
    return found.select("o_orderkey", F.posexplode("neighbours").alias("pos", "near")).select(
        "o_orderkey", (F.col("pos") + 1).alias("rank"), F.col("near.key").alias("neighbour"), F.round("near.distance", 4).alias("distance")
    )


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder)
    centres = centroids(df.filter(F.col("split") == "train"), "label", "embedding")
    found = assign_nearest(df, centres, "embedding", "label")
    return found.select("vec_id", "nearest", rounded("distance"))


def nearest_centroid_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder)
    centres = centroids(df.filter(F.col("split") == "train"), "label", "embedding")
    found = assign_nearest(df, centres, "embedding", "label", distance=None)
    return balanced_accuracy(found, "label", "nearest", ["split"]).select("split", rounded("score"))


def brand_mean_error(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.parts(spark, folder)
    means = df.filter(F.col("split") == "train").groupBy("p_brand").agg(F.avg("p_retailprice").alias("expected"))
    return mse(lookup_join(df, means, ["p_brand"], "inner"), "p_retailprice", "expected", ["split"]).select("split", rounded("score"))


def silhouette_by_label(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder).withColumn("clusters", F.array(F.col("label")))
    return silhouettes(df, "vec_id", "embedding", "clusters").select("vec_id", F.col("cluster").alias("label"), rounded("silhouette"))


def _batched_parts(spark: SparkSession, folder: str) -> DataFrame:
    df = assign_batches(inputs.embeddings(spark, folder), "vec_id", BATCH_ROWS)
    blocks = {f"part{i}": vec.part("embedding", i, PART_WIDTH) for i in range(PARTS)}
    return df.withColumns({**blocks, "lead": F.col("embedding")[PART_WIDTH]})


def batch_similarity_parts(spark: SparkSession, folder: str) -> DataFrame:
    found = batch_similarity(_batched_parts(spark, folder), "vec_id", "part0", "part1", temperature=TEMPERATURE)
    return found.select("vec_id", "batch_id", "best_key", rounded("positive"), rounded("best"), rounded("log_partition"))


def batch_contrastive_loss_parts(spark: SparkSession, folder: str) -> DataFrame:
    found = batch_contrastive_loss(_batched_parts(spark, folder), [f"part{i}" for i in range(PARTS)], TEMPERATURE)
    return found.select("batch_id", "n", rounded("loss"))


def retrieval_impute(spark: SparkSession, folder: str) -> DataFrame:
    df = _batched_parts(spark, folder)
    label = retrieve(df, "vec_id", "label", "label", "part0", ["part1", "part2", "part3"], "cat", rule="sum")
    lead = retrieve(df, "vec_id", "lead", "lead", "part1", ["part0", "part2", "part3"], "num", rule="mean")
    return imputation_scores(label.unionByName(lead)).select("variable", "kind", rounded("score"))


def joint_mean_vector(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder)
    joint = vec.mean_vector(*[vec.part("embedding", i, PART_WIDTH) for i in range(PARTS)])
    return df.select("vec_id", joint.alias("joint")).select(
        "vec_id", *[F.round(F.col("joint")[i], 6).alias(f"j{i}") for i in range(PART_WIDTH)]
    )


def vector_measures(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder)
    a, b = vec.part("embedding", 0, PART_WIDTH), vec.part("embedding", 1, PART_WIDTH)
    return df.select("vec_id", a.alias("a"), b.alias("b")).select(
        "vec_id",
        F.round(vec.norm("a"), 6).alias("norm"),
        F.round(vec.dot("a", "b"), 6).alias("dot"),
        F.round(vec.cosine("a", "b"), 6).alias("cosine"),
        F.round(vec.mean_squared_difference("a", "b"), 6).alias("squared_difference"),
    )


def flatten_tensor(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.embeddings(spark, folder)
    tensor = F.array(*[vec.part("embedding", i, PART_WIDTH) for i in reversed(range(PARTS))])
    flat = df.select("vec_id", vec.flatten_tensor(tensor, 2).alias("flat"))
    return flat.select(
        "vec_id", F.size("flat").cast("long").alias("width"),
        *[F.round(F.col("flat")[i * PART_WIDTH], 6).alias(f"head{i}") for i in range(PARTS)],
    )


QUERIES = {
    "knn_sweep_classification": knn_sweep_classification,
    "knn_sweep_regression": knn_sweep_regression,
    "knn_join": knn_join_embeddings,
    "knn_join_raw": knn_join_raw,
    "nearest_centroid": nearest_centroid,
    "balanced_accuracy": nearest_centroid_accuracy,
    "mse": brand_mean_error,
    "silhouette_by_label": silhouette_by_label,
    "batch_similarity": batch_similarity_parts,
    "batch_contrastive_loss": batch_contrastive_loss_parts,
    "retrieval_impute": retrieval_impute,
    "joint_mean_vector": joint_mean_vector,
    "vector_measures": vector_measures,
    "flatten_tensor": flatten_tensor,
}

_SWEEP = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY round(d2, 9), tk) AS r FROM pairs),
  ks AS (SELECT unnest(range(2, 11)) AS k)"""

_CHOICE = """, wide AS (SELECT CAST(k AS INTEGER) AS k, max(CASE WHEN split = 'validation' THEN score END) AS v,
    max(CASE WHEN split = 'test' THEN score END) AS t FROM scores GROUP BY k)
  SELECT k, round(v, 6) AS validation_score, round(t, 6) AS test_score,
    k = (SELECT k FROM wide ORDER BY {merit} NULLS LAST, k LIMIT 1) AS chosen FROM wide"""

_CENTRES = f"""WITH e AS {EMBEDDINGS_SQL},
  cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM e WHERE split = 'train'),
  centre AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i) GROUP BY label),
  near AS (SELECT vec_id, split, e.label, centre.label AS nearest, list_distance(embedding, c) AS distance,
    row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding, c), centre.label) AS r FROM e, centre)"""

_BATCHED = f"""WITH raw AS {EMBEDDINGS_SQL}, b AS {assign_batches_sql('raw', 'vec_id', BATCH_ROWS)},
  p AS (SELECT vec_id, label, batch_id, pos, embedding[17] AS lead, embedding[1:16] AS part0, embedding[17:32] AS part1,
    embedding[33:48] AS part2, embedding[49:64] AS part3 FROM b)"""


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def _retrieval_sql(variable: str, kind: str, value: str, sims: str) -> str:
    score = "avg(recall)" if kind == "cat" else "avg((truth - estimate) * (truth - estimate))"
    inner = f"""SELECT batch_id, truth, estimate FROM (
        SELECT j.batch_id, j.{value} AS truth, i.{value} AS estimate,
          row_number() OVER (PARTITION BY j.vec_id ORDER BY round({sims}, 9) DESC, i.pos) AS r
        FROM p i JOIN p j ON i.batch_id = j.batch_id) WHERE r = 1"""
    if kind == "cat":
        inner = f"SELECT batch_id, truth, avg(CAST(truth = estimate AS INTEGER)) AS recall FROM ({inner}) GROUP BY batch_id, truth"
    return f"SELECT '{variable}' AS variable, '{kind}' AS kind, round(avg(s), 6) AS score FROM (SELECT batch_id, {score} AS s FROM ({inner}) GROUP BY batch_id)"


_MEAN_EVIDENCE = "list_transform(list_zip(j.part0, j.part2, j.part3), lambda z: (z[1] + z[2] + z[3]) / 3)"
_LOSS_TERMS = " UNION ALL ".join(
    f"""SELECT i.batch_id, {v} AS v, i.vec_id, i.pos = j.pos AS own,
        ({' + '.join(_cos(f'i.part{v}', f'j.part{u}') for u in range(PARTS) if u != v)}) / {TEMPERATURE} AS s
        FROM p i JOIN p j ON i.batch_id = j.batch_id"""
    for v in range(PARTS)
)

ORACLES = {
    "knn_sweep_classification": f"""WITH e AS {EMBEDDINGS_SQL},
  pairs AS (SELECT q.vec_id AS qk, q.split, q.label AS y, t.vec_id AS tk, t.label AS ty,
      pow(list_distance(q.embedding, t.embedding), 2) AS d2
    FROM e q JOIN e t ON q.split <> 'train' AND t.split = 'train'){_SWEEP},
  counted AS (SELECT k, qk, split, y, ty, count(*) AS n FROM ranked JOIN ks ON r <= k GROUP BY ALL),
  voted AS (SELECT *, row_number() OVER (PARTITION BY k, qk ORDER BY n DESC, ty) AS place FROM counted),
  recalls AS (SELECT k, split, y, avg(CAST(y = ty AS INTEGER)) AS recall FROM voted WHERE place = 1 GROUP BY k, split, y),
  scores AS (SELECT k, split, avg(recall) AS score FROM recalls GROUP BY k, split){_CHOICE.format(merit='v DESC')}""",
    "knn_sweep_regression": f"""WITH e AS {PARTS_SQL},
  pairs AS (SELECT q.p_partkey AS qk, q.split, q.p_retailprice AS y, t.p_partkey AS tk, t.p_retailprice AS ty,
      (CASE WHEN q.p_brand = t.p_brand THEN 0 ELSE 2 END) + (CASE WHEN q.p_type = t.p_type THEN 0 ELSE 2 END)
      + pow((q.p_size - t.p_size) / (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) FROM e WHERE split = 'train'), 2) AS d2
    FROM e q JOIN e t ON q.split <> 'train' AND t.split = 'train'){_SWEEP},
  guesses AS (SELECT k, qk, split, y, avg(ty) AS guess FROM ranked JOIN ks ON r <= k GROUP BY k, qk, split, y),
  scores AS (SELECT k, split, avg((y - guess) * (y - guess)) AS score FROM guesses GROUP BY k, split){_CHOICE.format(merit='v')}""",
    "knn_join": f"""WITH e AS {EMBEDDINGS_SQL},
  pairs AS (SELECT q.vec_id, t.vec_id AS neighbour, list_distance(q.embedding, t.embedding) AS d
    FROM e q JOIN e t ON q.split <> 'train' AND t.split = 'train'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d * d, 9), neighbour) AS r FROM pairs)
  SELECT vec_id, CAST(r AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM ranked WHERE r <= 5""",
    "knn_join_raw": f"""WITH e AS (SELECT o_orderkey, o_totalprice AS a, CAST(epoch(o_orderdate) AS DOUBLE) AS b, c_acctbal AS c, {split_sql('o_orderkey')} AS split
    FROM orders JOIN customer ON o_custkey = c_custkey),
  pairs AS (SELECT q.o_orderkey, t.o_orderkey AS neighbour, (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c) AS d2
    FROM e q JOIN e t ON q.split = 'test' AND t.split = 'train'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(d2, 9), neighbour) AS r FROM pairs)
  SELECT o_orderkey, CAST(r AS INTEGER) AS rank, neighbour, round(sqrt(d2), 4) AS distance FROM ranked WHERE r <= 3""",
    "nearest_centroid": f"{_CENTRES} SELECT vec_id, nearest, round(distance, 6) AS distance FROM near WHERE r = 1",
    "balanced_accuracy": f"""{_CENTRES} SELECT split, round(avg(recall), 6) AS score FROM (
        SELECT split, label, avg(CAST(label = nearest AS INTEGER)) AS recall FROM near WHERE r = 1 GROUP BY split, label) GROUP BY split""",
    "mse": f"""WITH p AS {PARTS_SQL}, m AS (SELECT p_brand, avg(p_retailprice) AS expected FROM p WHERE split = 'train' GROUP BY p_brand)
        SELECT split, round(avg(pow(p_retailprice - expected, 2)), 6) AS score FROM p JOIN m USING (p_brand) GROUP BY split""",
    "silhouette_by_label": f"""WITH e AS {EMBEDDINGS_SQL},
  sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label),
  sums AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding, b.embedding)) AS total
    FROM e a, e b GROUP BY a.vec_id, a.label, b.label),
  sides AS (SELECT vec_id, own, max(CASE WHEN own = other THEN n END) AS n,
      max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
      min(CASE WHEN own <> other THEN total / n END) AS b FROM sums JOIN sizes ON other = label GROUP BY vec_id, own)
  SELECT vec_id, own AS label, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM sides""",
    "batch_similarity": f"""{_BATCHED},
  sims AS (SELECT i.vec_id, i.batch_id, i.pos, j.vec_id AS other, j.pos AS other_pos, {_cos('i.part0', 'j.part1')} / {TEMPERATURE} AS s
    FROM p i JOIN p j ON i.batch_id = j.batch_id),
  best AS (SELECT vec_id, other AS best_key, s AS best, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, other_pos) AS r FROM sims),
  sides AS (SELECT vec_id, batch_id, max(CASE WHEN pos = other_pos THEN s END) AS positive, ln(sum(exp(s))) AS log_partition FROM sims GROUP BY vec_id, batch_id)
  SELECT vec_id, batch_id, best_key, round(positive, 6) AS positive, round(best, 6) AS best, round(log_partition, 6) AS log_partition
  FROM sides JOIN best USING (vec_id) WHERE r = 1""",
    "batch_contrastive_loss": f"""{_BATCHED}, terms AS ({_LOSS_TERMS}),
  row_loss AS (SELECT batch_id, v, vec_id, ln(sum(exp(s))) - max(CASE WHEN own THEN s END) AS loss FROM terms GROUP BY batch_id, v, vec_id)
  SELECT batch_id, count(DISTINCT vec_id) AS n, round(avg(loss), 6) AS loss FROM row_loss GROUP BY batch_id""",
    "retrieval_impute": f"""{_BATCHED}
  {_retrieval_sql('label', 'cat', 'label', ' + '.join(_cos('i.part0', f'j.part{u}') for u in (1, 2, 3)))}
  UNION ALL {_retrieval_sql('lead', 'num', 'lead', _cos('i.part1', _MEAN_EVIDENCE))}""",
    "joint_mean_vector": "SELECT vec_id, " + ", ".join(
        f"round((e[{i + 1}] + e[{i + 17}] + e[{i + 33}] + e[{i + 49}]) / 4, 6) AS j{i}" for i in range(PART_WIDTH)
    ) + " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "flatten_tensor": """SELECT vec_id, len(e) AS width, round(e[49], 6) AS head0, round(e[33], 6) AS head1, round(e[17], 6) AS head2,
    round(e[1], 6) AS head3 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
    "vector_measures": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS a, CAST(embedding AS DOUBLE[])[17:32] AS b FROM embeddings)
  SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm, round(list_inner_product(a, b), 6) AS dot,
    round(list_cosine_similarity(a, b), 6) AS cosine, round(pow(list_distance(a, b), 2) / 16, 6) AS squared_difference FROM v""",
}
