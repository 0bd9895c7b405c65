"""Registered queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import compression, dedup, fingerprint, html, language, mixing, packing, rules, runs, search, sharding, tokenfile, toxicity
from panelloom.llm.common import id_crc

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), id_crc() % 3 == 1
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, model, threshold=0.7)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.node
"""


def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), length=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce(F.col("doc.text"), F.lit("")))
    return out.select(
        "doc.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3]::DOUBLE AS w,
      2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, coalesce(max(CASE WHEN level <= most / w THEN level END) OVER () * w, most)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS goal,
             (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(goal - a, size), 0) + greatest(least(goal - a - source_size, size), 0))::BIGINT AS taken
FROM p
"""

def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = tokenfile.scratch_path(spark, f"token-file-{uuid.uuid4().hex}")
    tokenfile.write(docs, vocabulary(), path)
    pieces = tokenfile.read(spark, path, docs.schema["doc_id"].dataType)
    return tokenfile.documents(pieces, path)


def op8_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(_table(spark, sf_dir, "documents"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), id_crc() % 5 == 0
    model = compression.train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    out = compression.classify(docs, model, threshold=0.3)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(_table(spark, sf_dir, "documents"), id_crc() % 7 == 2)


def op12_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
a AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM t),
d AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM t),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op13_square_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.report(_table(spark, sf_dir, "documents"), plant=True)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_toxicity_trees": op1_toxicity_trees,
    "op2_min_max_dedup": op2_min_max_dedup,
    "op3_line_blocks": op3_line_blocks,
    "op4_curve_packing": op4_curve_packing,
    "op5_histogram_sharding": op5_histogram_sharding,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_file": op7_token_file,
    "op8_order_min_hash": op8_order_min_hash,
    "op9_decision_list": op9_decision_list,
    "op10_compression_quality": op10_compression_quality,
    "op11_trie_scores": op11_trie_scores,
    "op12_blocked_search": op12_blocked_search,
    "op13_square_runs": op13_square_runs,
}
ORACLES = {"op2_min_max_dedup": OP2_SQL, "op6_source_mixing": OP6_SQL, "op12_blocked_search": OP12_SQL}
