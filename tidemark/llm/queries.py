"""The registered queries of this subpackage, with the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical, licenses, mixing, packing, pages, pii, quality, resampling, simhash, tokens, toxicity, trees, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_licenses")
def _licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


# Shares of the tokens that a training mixture is to have, by what the labels say of a document.
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` from the quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query("op2_mixing")
def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), domains(table(spark, folder, "labels")), TARGETS)


@query("op3_vectors")
def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.dedup(table(spark, folder, "embeddings"))


@query("op4_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


@query("op5_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op6_personal_data")
def _personal(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query("op7_main_text")
def _main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.texts(table(spark, folder, "pages"))


@query("op8_packing")
def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer())


@query("op9_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.counts(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), tokens AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), windows AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s,
         count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n
  FROM tokens
), again AS (
  SELECT doc_id, p, n = 8 AND count(*) OVER (PARTITION BY doc_id, s, n) > 1 AS hit FROM windows
), covered AS (
  SELECT doc_id, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM again
), repeats AS (
  SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY 1
), raw_lines AS (
  SELECT doc_id, host, md5(text) AS content, unnest(string_split(text, chr(10))) AS raw FROM d
), lines AS (
  SELECT doc_id, host, content, raw,
         array_to_string(regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words
  FROM raw_lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines GROUP BY 1
), per_text AS (
  SELECT host, line, content, min(doc_id) AS first FROM lines GROUP BY 1, 2, 3
), sizes AS (
  SELECT host, count(DISTINCT md5(text)) AS texts FROM d GROUP BY 1
), per_line AS (
  SELECT host, line, arg_min(content, first) AS keeper FROM per_text JOIN sizes USING (host)
  GROUP BY 1, 2, texts HAVING count(*) > 5 AND 100 * count(*) > 5 * texts
), lost AS (
  SELECT doc_id, sum(words) AS lost, count(DISTINCT line) AS n_lines_removed
  FROM lines JOIN per_line USING (host, line) WHERE content <> keeper GROUP BY 1
), counted AS (
  SELECT doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines_removed, 0) AS n_lines_removed, len(w) - coalesce(lost, 0) AS n_words_left
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_words_left >= 0.3 * n_words AS kept FROM judged
"""


@query("op10_quality_lines", QUALITY_SQL)
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents")).drop("host", "content")


DRAW_SQL = r"""
WITH shift_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS shifts
  FROM range(256) AS bytes(i)
), words AS (
  SELECT 'd' AS side, doc_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
  UNION ALL
  SELECT 'b', NULL,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), known AS (
  SELECT word, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t, hex(encode(word)) AS digits FROM words GROUP BY word
), bucketed AS (
  SELECT word, s, t,
         xor(list_reduce(
           list_prepend(4294967295, list_transform(range(0, length(digits) // 2),
             lambda p: 16 * (strpos('0123456789ABCDEF', substr(digits, 2 * p + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(digits, 2 * p + 2, 1)) - 1)),
           lambda c, byte: xor(c >> 8, shifts[xor(c & 255, byte) + 1])), 4294967295) % 10000 AS bucket
  FROM known, shift_table
), sums AS (
  SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM bucketed GROUP BY bucket
), whole AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM bucketed
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums, whole
), weighed AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), docs AS (
  SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9),
           lambda p: strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), p, 1)) - 1)), lambda h, d: 16 * h + d) AS h
  FROM documents
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (doc_id)
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""


@query("op11_resampling", DRAW_SQL)
def _resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_quality_trees")
def _quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return trees.score(docs, trees.train(docs, table(spark, folder, "labels")))


SEARCH_SQL = r"""
WITH terms AS (
  SELECT doc_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), lengths AS (
  SELECT doc_id, count(*) AS n FROM terms GROUP BY 1
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM lengths
), cells AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM cells, whole GROUP BY term, docs
), asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN cells USING (term) JOIN lengths USING (doc_id), whole
  GROUP BY 1, 2
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_search", SEARCH_SQL)
def _search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
