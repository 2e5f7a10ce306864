"""Count matrices, sample sheets and result tables derived from the star-schema tables, in Spark and as SQL views.

Feature = part, sample = supplier modulo 12, count = summed quantity; tokens per document source give a sparse matrix with a
heavy tail; embeddings give a dense real-valued matrix with classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from countspark.catalog.registry import VIEWS
from countspark.session import keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEWS["fx_samples"] = """
SELECT s AS sample, CASE WHEN s % 2 = 0 THEN 'ctrl' ELSE 'case' END AS cond,
       CASE s % 3 WHEN 0 THEN 'g0' WHEN 1 THEN 'g1' ELSE 'g2' END AS grade, CAST(FLOOR(s / 2) AS INT) AS subject
FROM (SELECT DISTINCT CAST(l_suppkey % 12 AS INT) AS s FROM lineitem) q"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sample")
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).cast("int").alias("sample")).distinct()
    return keep(ids.select(
        "sample",
        F.when(s % 2 == 0, "ctrl").otherwise("case").alias("cond"),
        F.when(s % 3 == 0, "g0").when(s % 3 == 1, "g1").otherwise("g2").alias("grade"),
        F.floor(s / 2).cast("int").alias("subject")))


VIEWS["fx_counts"] = """
SELECT l_partkey AS feature, CAST(l_suppkey % 12 AS INT) AS sample, CAST(SUM(l_quantity) AS BIGINT) AS raw_count
FROM lineitem GROUP BY l_partkey, CAST(l_suppkey % 12 AS INT)"""


def counts_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse counts as a lazy plan, for single-pass queries."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_partkey").alias("feature"), (F.col("l_suppkey") % 12).cast("int").alias("sample"))
            .agg(F.sum("l_quantity").cast("bigint").alias("raw_count")))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse counts as a written table, for queries that read them more than once."""
    return keep(counts_plan(spark, sf_dir))


VIEWS["fx_dense"] = """
SELECT f.feature, s.sample, COALESCE(c.raw_count, 0) AS raw_count
FROM (SELECT DISTINCT feature FROM fx_counts) f CROSS JOIN fx_samples s
LEFT JOIN fx_counts c ON c.feature = f.feature AND c.sample = s.sample"""

VIEWS["fx_features"] = """
SELECT p_partkey AS feature, p_brand AS symbol, p_type AS gene_class, 200 + 10 * p_size AS length_bp,
       CASE p_partkey % 7 WHEN 0 THEN 'Y' WHEN 1 THEN 'MT' WHEN 2 THEN 'X' WHEN 3 THEN 'scaffold_1'
            ELSE CAST(p_partkey % 7 AS VARCHAR(8)) END AS chromosome_name,
       (p_partkey * 7919) % 100000 AS start_position, (p_partkey * 7919) % 100000 + 200 + 10 * p_size AS end_position
FROM part"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    chrom = (F.when(k % 7 == 0, "Y").when(k % 7 == 1, "MT").when(k % 7 == 2, "X").when(k % 7 == 3, "scaffold_1")
             .otherwise((k % 7).cast("string")))
    start = (k * 7919) % 100000
    length = F.lit(200) + F.col("p_size") * 10
    return table(spark, sf_dir, "part").select(
        k.alias("feature"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("gene_class"), length.alias("length_bp"),
        chrom.alias("chromosome_name"), start.alias("start_position"), (start + length).alias("end_position"))


VIEWS["fx_pseudo"] = """
SELECT CONCAT('__', event_type) AS feature, CAST(user_id % 12 AS INT) AS sample, COUNT(*) AS raw_count
FROM events GROUP BY CONCAT('__', event_type), CAST(user_id % 12 AS INT)"""


def pseudo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .groupBy(F.concat(F.lit("__"), "event_type").alias("feature"), (F.col("user_id") % 12).cast("int").alias("sample"))
            .agg(F.count(F.lit(1)).alias("raw_count")))


VIEWS["fx_library"] = """
SELECT CAST(feature AS VARCHAR) AS feature, sample, raw_count FROM fx_counts
UNION ALL SELECT feature, sample, raw_count FROM fx_pseudo"""


def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with string features plus the pseudo rows of the aligner."""
    real = counts_plan(spark, sf_dir).withColumn("feature", F.col("feature").cast("string"))
    return keep(real.unionByName(pseudo_rows(spark, sf_dir)))


VIEWS["fx_planted"] = """
SELECT d.feature, d.sample,
       CASE WHEN d.feature % 50 = 0 AND s.cond = 'case' THEN 4 * d.raw_count ELSE d.raw_count END AS raw_count
FROM fx_dense d JOIN fx_samples s ON s.sample = d.sample"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a fourfold signal in every 50th feature of the ``case`` samples (odd samples)."""
    hit = (F.col("feature") % 50 == 0) & (F.col("sample") % 2 == 1)
    return keep(counts_plan(spark, sf_dir).withColumn("raw_count", F.when(hit, F.col("raw_count") * 4).otherwise(F.col("raw_count"))))


VIEWS["fx_de"] = """
SELECT feature, contrast, avg_log2cpm, avg_log2fc,
       CASE WHEN feature % 17 = 0 THEN NULL ELSE POWER(u, 6) END AS p_value
FROM (
  SELECT f.feature, k.contrast, f.feature % 13 + 0.5E0 AS avg_log2cpm,
         ((f.feature * 31 + k.i * 17) % 81 - 40) / 10.0E0 AS avg_log2fc,
         ((f.feature * 7919 + k.i * 104729) % 997) / 997.0E0 AS u
  FROM (SELECT DISTINCT feature FROM fx_counts) f
  CROSS JOIN (SELECT 1 AS i, 'g1_vs_g0' AS contrast UNION ALL SELECT 2 AS i, 'g2_vs_g0' AS contrast) k
) q"""

CONTRASTS = ["g1_vs_g0", "g2_vs_g0"]


def de_raw(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Synthetic result table with ties, NULLs and two contrasts; ``shift`` gives a second, different method."""
    f = F.col("feature")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("contrast")) for i, c in enumerate(CONTRASTS, 1)]))
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature")).distinct()
    return ids.select("feature", each.alias("k")).select(
        "feature", F.col("k.contrast").alias("contrast"), (f % 13 + F.lit(0.5)).alias("avg_log2cpm"),
        (((f * 31 + F.col("k.i") * 17) % 81 - 40) / F.lit(10.0)).alias("avg_log2fc"),
        F.when(f % 17 != 0, F.pow(((f * 7919 + F.col("k.i") * 104729 + shift) % 997) / F.lit(997.0), F.lit(6.0))).alias("p_value"))


VIEWS["fx_de2"] = VIEWS["fx_de"].replace("k.i * 104729)", "k.i * 104729 + 211)")


def _ranked_de(view: str) -> str:
    return f"""
SELECT *, CASE WHEN adj_p <= 0.05 THEN CAST(SIGN(avg_log2fc) AS INT) WHEN adj_p IS NOT NULL THEN 0 END AS de,
       ROW_NUMBER() OVER (PARTITION BY contrast ORDER BY adj_p NULLS LAST, p_value NULLS LAST, feature) AS rank
FROM (
  SELECT feature, contrast, avg_log2cpm, avg_log2fc, p_value,
         CASE WHEN p_value IS NOT NULL THEN LEAST(1.0E0, MIN(p_value * m / rk) OVER (PARTITION BY contrast ORDER BY p_value DESC NULLS FIRST, feature DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS adj_p
  FROM (SELECT *, COUNT(p_value) OVER (PARTITION BY contrast) AS m,
               ROW_NUMBER() OVER (PARTITION BY contrast ORDER BY p_value NULLS LAST, feature) AS rk FROM {view}) a
) b"""


VIEWS["fx_det"] = _ranked_de("fx_de")
VIEWS["fx_det2"] = _ranked_de("fx_de2")

VIEWS["fx_sets"] = "SELECT p_brand AS set_id, p_partkey AS feature FROM part"


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("feature"))


VIEWS["fx_refflat"] = """
SELECT l_partkey AS gene, CAST(l_linenumber % 2 AS INT) AS chr, CASE WHEN l_linenumber % 3 = 0 THEN '+' ELSE '-' END AS strand,
       l_linenumber AS exons_num, l_quantity * 10 AS sum_exon_lengths, l_orderkey * 10 AS gene_start, l_orderkey * 10 + 500 AS gene_end
FROM lineitem"""


def refflat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("gene"), (n % 2).cast("int").alias("chr"),
        F.when(n % 3 == 0, "+").otherwise("-").alias("strand"), n.alias("exons_num"),
        (F.col("l_quantity") * 10).alias("sum_exon_lengths"), (F.col("l_orderkey") * 10).alias("gene_start"),
        (F.col("l_orderkey") * 10 + 500).alias("gene_end"))


VIEWS["fx_tokens"] = """
SELECT feature, sample, COUNT(*) AS raw_count
FROM (SELECT source AS sample, lower(token) AS feature
      FROM (SELECT source, UNNEST(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents) t) q
GROUP BY feature, sample"""


def tokens_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1))
    return (table(spark, sf_dir, "documents").select(F.col("source").alias("sample"), words.alias("token"))
            .select(F.lower("token").alias("feature"), "sample").groupBy("feature", "sample").agg(F.count(F.lit(1)).alias("raw_count")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(tokens_plan(spark, sf_dir))


VIEWS["fx_token_samples"] = "SELECT DISTINCT sample FROM fx_tokens"

VIEWS["fx_vectors"] = """
SELECT vec_id AS sample, CAST(UNNEST(range(1, len(embedding) + 1)) AS INT) AS feature, CAST(UNNEST(embedding) AS DOUBLE) AS value,
       label FROM embeddings"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense real-valued matrix: sample = vector, feature = position, plus the class of the sample."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("pos", "element")).select(
        "sample", (F.col("pos") + 1).alias("feature"), F.col("element").cast("double").alias("value"), "label")
