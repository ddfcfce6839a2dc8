"""One query per operator over its whole table, with DuckDB twins where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, chat, conversation_repair, jaccard_join, lm_scoring, merkle, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_rollups, warc
from fleetlens.llm.common import table
from fleetlens.session import apply_runtime_conf, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The public vocabulary that tokens are counted and packed by.
VOCABULARY = "word_bpe_49k.json"


def settings(spark: SparkSession) -> None:
    """The library's defaults, small Arrow batches (whole texts are long rows), and where workers find this package."""
    apply_runtime_conf(spark)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: DuckDB: the words of ``text``.
SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op1_chat_format",
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn ', '<\turn '), '</turn>', '<\/turn>') AS esc,
    replace(replace(replace(replace(role, '\', '\\'), '<turn ', '<\turn '), '</turn>', '<\/turn>'), '>', '\>') AS esc_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM turns),
checked AS (
  SELECT *, (coalesce(before, 'start') || '>' || role) IN
    ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS allowed FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
  CAST(sum(length(esc) + length(esc_role) + length('<turn ') + 2 + length('</turn>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(allowed) AS valid
FROM checked GROUP BY conv_id
""",
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted text and its loss mask."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.format_conversations(rows).select(
        "conv_id",
        "valid",
        "formatted",
        chat.parse_formatted(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@query(
    "op4_quality_rules",
    rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, {SQL_WORDS} AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
grams AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (
  SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM split)),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams),
spread AS (SELECT DISTINCT r, i + k AS p FROM found, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1),
repeats AS (SELECT r, count(*) AS n FROM spread GROUP BY r),
counts AS (
  SELECT d.doc_id, d.lang, d.source, len(w) AS n_words,
    length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM docs d JOIN split USING (r) LEFT JOIN repeats USING (r)),
rated AS (SELECT *,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_rate,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_rate,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate,
    coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS word_size FROM counts),
rules AS (SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_size']) AS rule,
    unnest([symbol_rate, dup_line_rate, repeat_rate, word_size]) AS v,
    unnest([50, 250, 250, 1500]) AS slack FROM rated),
bins AS (SELECT lang, source, rule, slack, CAST(v AS BIGINT) // CAST(2 ** greatest(length(bin(CAST(v AS BIGINT))) - 6, 0) AS BIGINT)
    * CAST(2 ** greatest(length(bin(CAST(v AS BIGINT))) - 6, 0) AS BIGINT) AS b FROM rules),
own AS (SELECT lang, source, rule, slack, count(*) AS n, quantile_disc(b, 0.5) AS q50, quantile_disc(b, 0.75) AS q75 FROM bins GROUP BY ALL),
byl AS (SELECT lang, rule, count(*) AS n, quantile_disc(b, 0.5) AS q50, quantile_disc(b, 0.75) AS q75 FROM bins GROUP BY ALL),
allb AS (SELECT rule, quantile_disc(b, 0.5) AS q50, quantile_disc(b, 0.75) AS q75 FROM bins GROUP BY ALL),
fence AS (SELECT o.lang, o.source, o.rule,
    CASE WHEN o.n >= 200 THEN o.q75 + 4 * (o.q75 - o.q50) WHEN l.n >= 200 THEN l.q75 + 4 * (l.q75 - l.q50)
      ELSE a.q75 + 4 * (a.q75 - a.q50) END + slack AS f
  FROM own o JOIN byl l ON o.rule = l.rule AND o.lang IS NOT DISTINCT FROM l.lang JOIN allb a ON o.rule = a.rule),
wide AS (SELECT lang, source, max(f) FILTER (rule = 'symbol_rate') AS f1, max(f) FILTER (rule = 'dup_line_rate') AS f2,
    max(f) FILTER (rule = 'repeat_rate') AS f3, max(f) FILTER (rule = 'word_size') AS f4 FROM fence GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (symbol_rate > f1 OR dup_line_rate > f2 OR repeat_rate > f3 OR word_size > f4) AS kept
FROM rated r JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source
""",
)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with thresholds from the sketches of its language and source."""
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).drop("n_lines")


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model learnt from labels outside the held-out fifth."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op5_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
shared AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN shared ON p.h = shared.h
""",
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by the salvage reader."""
    return warc.page_digests(warc.archive_pages(table(spark, sf_dir, "pages")))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, the likeness of neighbours, and links to near classes."""
    return simhash.linked_fingerprints(table(spark, sf_dir, "documents"))


@query(
    "op7_token_rollups",
    r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS text,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents WHERE doc_id IS NOT NULL),
kept AS (SELECT * FROM d WHERE doc_id = first),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-2',
    len(regexp_extract_all(regexp_replace(text, '[0-9]+', '', 'g'), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+')) FROM kept)
SELECT nullif(source, chr(0)) AS source, nullif(lang, chr(0)) AS lang, version, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM counted GROUP BY ALL
""",
)
def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after inserts, revised counts and deletes, every batch sent twice."""
    store = token_rollups.RollupStore(spark, scratch_path(spark, "rollups"))
    return token_rollups.corpus_history(table(spark, sf_dir, "documents"), store)


@query(
    "op2_ngram_jaccard",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT doc_id, """ + SQL_WORDS + r""" AS w FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""",
)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: size of the shingle set and component."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op9_substring_dedup",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, """ + SQL_WORDS + r""" AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
gone AS (SELECT r, list(DISTINCT i + k) AS p FROM m, (SELECT unnest(range(35)) AS k) GROUP BY r),
kept AS (SELECT doc_id, w, list_filter(w, lambda x, i: NOT list_contains(p, i)) AS k FROM d JOIN gone USING (r)
  UNION ALL SELECT doc_id, w, w FROM d WHERE r NOT IN (SELECT r FROM gone))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 35 words that occur more than once."""
    return substring_dedup.dedup_digests(table(spark, sf_dir, "documents"))


@query("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a context tree and a unigram base, both learnt outside the held-out seventh."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), "crc32(CAST(doc_id AS STRING)) % 7 = 2")


@query(
    "op12_merkle_manifest",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, text, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed
  FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
up AS (SELECT tree, 0 AS level, rank AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
  FROM up WHERE n > 1 GROUP BY tree, level, i // 8),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS rank FROM up WHERE n = 1),
top AS (SELECT 0 AS level, rank AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8),
steps AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
tops AS (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
crc_steps AS (SELECT x::UINTEGER AS x, k FROM (SELECT unnest(range(256)) AS x), (SELECT 0 AS k)),
crc_table AS (SELECT x AS byte, list_reduce(list_prepend(x::UBIGINT, list_transform(range(8), lambda z: 0::UBIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM crc_steps),
tbl AS (SELECT list(v ORDER BY byte) AS t FROM crc_table),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tbl),
walk AS (SELECT p.doc_id, p.tree, p.rank, p.leaf, 0 AS level, p.rank AS i, '' AS proof,
    CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS h FROM placed p LEFT JOIN crcs c ON p.doc_id = c.doc_id
  UNION ALL
  SELECT w.doc_id, w.tree, w.rank, w.leaf, w.level + 1, w.i // 8, proof || l || r, sha256(l || h || r)
  FROM walk w JOIN steps s ON w.tree = s.tree AND w.level = s.level AND w.i = s.i),
rooted AS (SELECT w.*, s.h AS subroot, s.rank AS place FROM walk w JOIN subroots s USING (tree)
  QUALIFY w.level = max(w.level) OVER (PARTITION BY w.tree)),
climb AS (SELECT doc_id, tree, rank, leaf, subroot, 0 AS level, place AS i, proof, h FROM rooted
  UNION ALL
  SELECT c.doc_id, c.tree, c.rank, c.leaf, c.subroot, c.level + 1, c.i // 8, proof || l || r, sha256(l || h || r)
  FROM climb c JOIN tops t ON c.level = t.level AND c.i = t.i)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM climb, (SELECT h AS root, level AS height FROM top WHERE n = 1) WHERE level = height
""",
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verification after tampering, from the stored manifest."""
    return merkle.manifest(table(spark, sf_dir, "documents")).verified()


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, then repaired by its cheapest edits."""
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))
