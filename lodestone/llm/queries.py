"""One query an operator, with its production parameters, and the SQL it is checked by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, exact_dedup, extraction, language, maxscore, mixing, multi_index, packing, quality,
    rotation_codes, sharding, simhash, toxicity,
)
from .common import fitted, labelled_sample, remainder, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

SHARDS = 8
MAX_REPEAT = 2.0
#: Shingle length and most differing bits of near-duplicates, in op6 and in the pipeline.
NEAR = {"width": 4, "bits": 4}
#: Score from which a document counts as toxic, and as of label 1 for quality.
LIKELY = 0.3


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("op2_rendezvous_sharding")
def rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``key``. Null text: size 1 and no CRC."""
    docs = table(spark, folder, "documents")
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    even = {s: 1.0 for s in range(SHARDS)}
    placed = sharding.shard_records(narrow, "doc_id", even, even | {SHARDS: 1.0})
    return sharding.with_slots(placed, "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS key, doc_id, source,
         1 + coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens
  FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS total, sum(tokens) / (SELECT sum(tokens) FROM d)::DOUBLE AS share
      FROM d GROUP BY source),
ends AS (SELECT min(share) AS a, max(share) AS b FROM s),
bis AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, a, b FROM ends
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END, a, b
  FROM (SELECT *, pow(a, (lo + hi) / 2 - 1) * pow(b, 1 - (lo + hi) / 2) <= {MAX_REPEAT} AS ok FROM bis WHERE i < 40)),
x AS (SELECT hi AS e FROM bis WHERE i = 40),
r AS (SELECT s.*, pow(share, (SELECT e FROM x)) AS w FROM s),
w AS (SELECT source, total, w / (SELECT sum(w) FROM r) AS weight,
        round(w / (SELECT sum(w) FROM r) * (SELECT max(total / w) * sum(w) FROM r))::BIGINT AS allowance,
        1 + floor(share * {mixing.BLOCKS})::BIGINT AS blocks FROM r),
dealt AS (SELECT d.*, total, allowance, weight,
        ('0x' || substr(md5('block0|' || key), 1, 15))::BIGINT % blocks AS block,
        ('0x' || substr(md5('order0|' || key), 1, 15))::BIGINT AS o
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
sums AS (SELECT source, block, total, allowance, sum(tokens)::BIGINT AS size FROM dealt GROUP BY ALL),
ep AS (SELECT *, unnest(range(0, allowance // total + 1)) AS epoch FROM sums),
sh AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 'epoch0', epoch, source, block)), 1, 15))::BIGINT AS h FROM ep),
pl AS (SELECT *, row_number() OVER t - 1 AS place,
        allowance - epoch * total - (sum(size) OVER t - size) AS remaining
      FROM sh WINDOW t AS (PARTITION BY source, epoch ORDER BY h, block)),
cu AS (SELECT dealt.source, dealt.block, epoch, o, remaining,
        sum(tokens) OVER (PARTITION BY dealt.source, dealt.block, epoch ORDER BY o RANGE UNBOUNDED PRECEDING) - tokens AS start
      FROM dealt JOIN pl ON dealt.source IS NOT DISTINCT FROM pl.source AND dealt.block = pl.block
      WHERE remaining > 0 AND remaining < size),
c AS (SELECT source, block, epoch, min(o) AS cutoff FROM cu WHERE start >= remaining GROUP BY ALL)
SELECT doc_id, dealt.source, tokens, round(weight, 9) AS weight, pl.epoch, pl.block, place
FROM dealt JOIN pl ON dealt.source IS NOT DISTINCT FROM pl.source AND dealt.block = pl.block AND remaining > 0
LEFT JOIN c ON pl.source IS NOT DISTINCT FROM c.source AND pl.block = c.block AND pl.epoch = c.epoch
WHERE cutoff IS NULL OR o < cutoff
"""


@query("op10_temperature_mixing", MIX_SQL)
def temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document at least once, no source more than twice on average."""
    docs = table(spark, folder, "documents")
    mixed = mixing.mix(docs, "doc_id", "source", "text", max_repeat=MAX_REPEAT)
    return mixed.select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"),
                        "epoch", "block", "place")


@query("op1_rotation_codes")
def rotation_code_links(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = rotation_codes.linked(vectors, "vec_id", "embedding", threshold=0.95)
    return found.select(
        F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("key").eqNullSafe(F.col("component")).alias("kept"))


PACK_LIMITS = {"length": 2048, "segments": 256, "loss_tokens": 2048}


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of documents in sequences. All ids of a document bear loss but its first."""
    pieces = packing.tokenise(docs, "text", public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    digests = pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        F.lit(1).alias("segments"),
        (F.col("length") - F.when(F.col("start") == 0, 1).otherwise(0)).alias("loss_tokens"))
    packed = packing.pack(digests, PACK_LIMITS, "length", ["doc_id", "start", "ids_crc32"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_vector_packing")
def vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


@query("op4_maxscore", """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def maxscore_top(spark: SparkSession, folder: str) -> DataFrame:
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf'))"
    whole = table(spark, folder, "embeddings").filter(finite).select("vec_id", F.transform(
        "embedding", lambda x: F.floor(256 * x.cast("double"))).alias("terms"))
    top = maxscore.top_k(whole, whole.filter("vec_id % 50 = 0"), "vec_id", "terms", k=5)
    return top.select("query_id", "rank", F.col("key").alias("vec_id"), "score")


@query("op6_anchor_simhash")
def anchor_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = simhash.near_duplicates(docs, "doc_id", "text", **NEAR)
    return found.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query("op5_tree_extraction")
def tree_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = extraction.extract(table(spark, folder, "pages"), "html", ["page_id", "url"])
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def language_model(docs: DataFrame) -> language.Model:
    """Learned from documents whose CRC-32 of the id is not divisible by 5."""
    learned = docs.filter(remainder(F.col("doc_id"), 5) != 0)
    return fitted(labelled_sample(
        learned, learned, "doc_id", "text", "lang", language.DOCS_PER_LANGUAGE), language.train)


def held_out(modulus: int, rest: int):
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False)).alias("held_out")


@query("op7_crf_language")
def crf_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, "text", language_model(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(5, 0), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from labels whose CRC-32 of the id is not divisible by 5."""
    learned = labels.filter(remainder(F.col("doc_id"), 5) != 0)
    return fitted(labelled_sample(
        docs, learned, "doc_id", "text", "quality", quality.DOCS_PER_LABEL), quality.train)


@query("op8_crf_quality")
def crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.score(docs, "text", quality_model(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out(5, 0), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labels whose CRC-32 of the id leaves a remainder other than 2 by 4."""
    learned = labels.filter(remainder(F.col("doc_id"), 4) != 2)
    return fitted(labelled_sample(
        docs, learned, "doc_id", "text", "toxic", toxicity.DOCS_PER_LABEL), toxicity.train)


@query("op9_counterfactual_toxicity")
def counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = toxicity.score(docs, "text", toxicity_model(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out(4, 2), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))


FINITE = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf'))"

MINED_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other, q.label = c.label AS alike,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op11_multi_index", MINED_SQL)
def multi_index_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh label is moved on by one, as wrong labels would be."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").filter(FINITE).select("vec_id", moved.alias("label"), F.transform(
        "embedding", lambda x: F.floor(256 * x.cast("double"))).alias("terms"))
    return multi_index.hard_negatives(rows, "vec_id", "terms", "label", F.col("vec_id") % 100 == 0)


@query("op12_exact_dedup", """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id DESC) = 1 AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
""")
def exact_dedup_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "text_sha256", F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256))
    found = exact_dedup.exact_duplicates(docs, "doc_id", "text", keep=["text_sha256"])
    return found.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"),
                        "group_size", "kept", "text_sha256")


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align(
        table(spark, folder, "documents"), "text", public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    narrow = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links")
    return alignment.weighed(narrow).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
