"""The operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.hashing import hash32_sql
from rowloom.llm import audit, bpe, exact, fingerprint, mixing, near, pii, quality, shards, substring, tokens, toxicity, whitening
from rowloom.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokens.token_counts(documents(spark, folder), "doc_id", "text", tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_near(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(documents(spark, folder), "doc_id", "text")


def op3_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.without_repeats(documents(spark, folder), digests=True)


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), "doc_id", "text", tokenizer_path())


def op5_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compared(documents(spark, folder))


def op6_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicates(documents(spark, folder), "doc_id", "text")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.resampled(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.sharded(documents(spark, folder), "doc_id", "text", [1.0] * 24)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return mixing.mixture(docs, "doc_id", "source", mixing.word_count("text")).drop("source")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder), "doc_id", "text")


def op13_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


QUERIES = {q.__name__: q for q in (op1_tokens, op2_near, op3_substring, op4_bpe, op5_fingerprint, op6_exact, op7_quality, op8_shards, op9_mixing, op10_toxicity, op11_whitening, op12_pii, op13_audit)}
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HASH = hash32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")

ORACLES: dict[str, str] = {
    "op2_near": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
      cut AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
      sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM cut),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
      link AS (SELECT a, b FROM both_in JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)),
      edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
      reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
      least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
      SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, coalesce(c, doc_id) >= doc_id AS kept
      FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = a""",
    "op3_substring": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
      run AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
      again AS (SELECT doc_id, i FROM run QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
      word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
      kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word
        LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
      SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
      FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op6_exact": f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), {_BLANKS}, '') AS t FROM documents),
      g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
      SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op9_mixing": f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, {_HASH} AS h FROM documents),
      sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
      ranked AS (SELECT source, source_size, 3 * source_size AS cap, r, [5, 2, 1][r % 3 + 1] AS weight
        FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM sums)),
      fill AS (SELECT *, (SELECT sum(size) FROM d)::BIGINT AS budget,
          coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
          sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM ranked),
      level AS (SELECT *, CAST(budget - filled AS DOUBLE) / CAST(rest AS DOUBLE) AS l FROM fill),
      chosen AS (SELECT arg_min(l, filled) AS l FROM level WHERE cap >= l * weight),
      aim AS (SELECT source, source_size, r, least(CAST(cap AS DOUBLE), coalesce((SELECT l FROM chosen) * weight, CAST(cap AS DOUBLE))) AS target FROM level),
      placed AS (SELECT d.*, a.source_size, a.r, a.target,
          coalesce(sum(size) OVER (PARTITION BY a.r ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
        FROM d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
      copies AS (SELECT *, unnest([0, 1, 2]) AS epoch FROM placed),
      timed AS (SELECT *, CAST(epoch * source_size + done AS DOUBLE) / target AS begun, CAST(epoch * source_size + done + size AS DOUBLE) / target AS finish FROM copies),
      served AS (SELECT *, CAST(CASE WHEN finish <= 1 THEN size WHEN begun < 1 THEN floor(target - (epoch * source_size + done)) ELSE 0 END AS BIGINT) AS take FROM timed),
      mix AS (SELECT *, coalesce(sum(take) OVER (ORDER BY finish, r, h, doc_id, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM served WHERE take > 0)
      SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, p.target, coalesce(sum(m.take), 0)::BIGINT AS taken, min(m.at) AS mix_from
      FROM placed p LEFT JOIN mix m ON p.doc_id = m.doc_id GROUP BY p.doc_id, p.size, p.source_size, p.target""",
    "op13_audit": f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
      l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
      f AS (SELECT part, CASE WHEN good = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic,
          (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
          || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
          || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
          || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM d LEFT JOIN l USING (doc_id)),
      x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
      o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
      s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
      g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
      r AS (SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic,
          contains(fails, filter_order[step]) AS failing, fails = filter_order[step] AS only_this,
          list_bool_or(list_transform(range(1, step), lambda i: contains(fails, filter_order[i]))) IS TRUE AS gone FROM g, s),
      c AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
          sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
          sum(CASE WHEN only_this THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost,
          sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
      SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c""",
}
