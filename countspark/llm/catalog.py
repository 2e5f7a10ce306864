"""The registered queries of this folder, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from countspark.llm.backoff import stupid_backoff
from countspark.llm.bit_slices import whiten
from countspark.llm.chat import END, HEAD, SPLIT, chat_digest, chat_examples
from countspark.llm.chunk_recipes import copies_sql, exact_copies
from countspark.llm.licences import licence_sql, scan_licences
from countspark.llm.mixing import mix
from countspark.llm.quality import classify
from countspark.llm.rotated_codes import nearest
from countspark.llm.secret_scan import scan_secrets
from countspark.llm.simhash import simhash_components
from countspark.llm.templates import contaminated
from countspark.llm.token_alignment import alignment_counts
from countspark.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentence_rules", licence_sql())
def sentence_rules(spark, sf_dir):
    """Licences of every document."""
    return scan_licences(_table(spark, sf_dir, "documents"))


def _chat_sql() -> str:
    """The digests from the turns themselves; escaped lengths by counting what gets a backslash."""
    tails = ["|", "s>", "/s>", "INST]", "/INST]", "SYS>>", "/SYS>>", "<SYS>>", "</SYS>>"]
    count = lambda col, what: f"(length({col}) - length(replace({col}, '{what}', ''))) // {len(what)}"
    escaped = lambda col: " + ".join([f"length({col})", count(col, chr(92)), *(count(col, head + tail) for head in "<[" for tail in tails)])
    marks = len(HEAD) + len(SPLIT) + len(END)
    return f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
    e AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, {escaped('r')} + {escaped('x')} + {marks} AS width
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x)),
    p AS (SELECT *, sum(width) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
    SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
      CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
      CAST(sum(upto) FILTER (r = 'assistant' OR i = n) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (r = 'assistant' OR i = n) AS BIGINT) AS n_examples FROM p GROUP BY conv_id"""


@query("op2_prefix_targets", _chat_sql())
def prefix_targets(spark, sf_dir):
    """All conversations, and one whose texts look like template marks, as examples; what these hold, read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat_digest(chat_examples(turns.unionByName(extra)))


_BACKOFF_SQL = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
  t AS (SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
  u AS (SELECT *, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS n1,
      CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) ELSE 0 END AS n2,
      CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) ELSE 0 END AS n3,
      count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM t),
  v AS (SELECT *, lag(n1) OVER d AS n1_before, lag(n2) OVER d AS n2_before FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  s AS (SELECT doc_id, CASE WHEN n3 > 0 THEN ln(n3) - ln(n2_before) WHEN n2 > 0 THEN ln(0.4) + ln(n2) - ln(n1_before) WHEN n1 > 0 THEN 2 * ln(0.4) + ln(n1) - ln(n)
      ELSE 3 * ln(0.4) - ln(n + 1.0) END AS score, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END AS level FROM v),
  g AS (SELECT doc_id, sum(score) AS score, count(*) FILTER (level = 3) AS n_trigram, count(*) FILTER (level = 2) AS n_bigram, count(*) FILTER (level = 1) AS n_word,
      count(*) FILTER (level = 0) AS n_unseen FROM s GROUP BY doc_id)
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS log_score, round(score / len(ws), 6) AS mean_log_score, coalesce(n_trigram, 0) AS n_trigram,
    coalesce(n_bigram, 0) AS n_bigram, coalesce(n_word, 0) AS n_word, coalesce(n_unseen, 0) AS n_unseen FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""


@query("op3_stupid_backoff", _BACKOFF_SQL)
def backoff_scores(spark, sf_dir):
    """Every document scored by the counts of all others."""
    return stupid_backoff(_table(spark, sf_dir, "documents"))


_BITS = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"
_TRANSACTIONS_SQL = f"""WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  m AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hx, max(page_id) OVER (PARTITION BY sha1(h)) AS top FROM d),
  b AS (SELECT *, array_to_string([{_BITS}[strpos('0123456789abcdef', x)] FOR x IN string_split(hx, '')], '') AS bits FROM m)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT)
      + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
      + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b"""


@query("op4_transactions", _TRANSACTIONS_SQL)
def transactions(spark, sf_dir):
    """All pages written as archives, read back, and assembled to captures."""
    return archive_pages(_table(spark, sf_dir, "pages"))


@query("op5_secret_formats")
def secret_formats(spark, sf_dir):
    """Secret spans of every document."""
    return scan_secrets(_table(spark, sf_dir, "documents"))


@query("op6_rotated_codes")
def rotated_codes(spark, sf_dir):
    """The ten nearest rows of every hundredth vector."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_source_schedule")
def source_schedule(spark, sf_dir):
    """All documents mixed by source: 1.5 times all words, at most twice a source."""
    return mix(_table(spark, sf_dir, "documents"))


@query("op8_quality_ngrams")
def quality_ngrams(spark, sf_dir):
    """The quality of every document; a third of the labels is held out."""
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op9_golay_simhash")
def golay_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash_components(_table(spark, sf_dir, "documents"))


@query("op10_templates")
def benchmark_templates(spark, sf_dir):
    """Benchmark items in all documents, also with other numbers, names and units."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op11_chunk_recipes", copies_sql())
def chunk_recipes(spark, sf_dir):
    """Exact copies among all documents."""
    return exact_copies(_table(spark, sf_dir, "documents"))


@query("op12_diagonal_runs")
def diagonal_runs(spark, sf_dir):
    """Tokens of two vocabularies aligned in every document, and how often their pairs are linked."""
    return alignment_counts(_table(spark, sf_dir, "documents"))


@query("op13_bit_sliced_whitening")
def bit_sliced_whitening(spark, sf_dir):
    """All embeddings whitened."""
    return whiten(_table(spark, sf_dir, "embeddings"))
