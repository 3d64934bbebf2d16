"""The registered queries of this subpackage, with production parameters.

Each query reads its whole tables and returns its operator's whole result in the
columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .chat_format import as_transcripts, fit, parse_transcripts
from .common import table
from .conversation_repair import conversation_report, damage
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .importance import importance_resample
from .language_id import language_id
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .unit_dedup import unit_dedup
from .url_filter import rules_frame, url_filter


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the conversations whose crc32 is not 2 modulo 4; parses all of them."""
    raw = as_transcripts(table(spark, sf_dir, "conversations"))
    learn = raw.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2)
    return parse_transcripts(raw, fit(learn))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).drop("row")


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removed: the numbers of the removed lines, from 0, joined by commas."""
    return line_dedup(table(spark, sf_dir, "documents")).withColumn(
        "removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations by the contract's rule and repairs what is left of them."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_report(conversations, damage(conversations))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the shards' row counts differ by one at most."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark is the target; a tenth of the documents of 20 words or more is drawn."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_unit_dedup": op6_unit_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_importance": op13_importance,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _shingles(size: int) -> str:
    """The distinct runs of ``size`` words of the list w; a shorter list is one run."""
    return (f"list_distinct(list_transform(range(1, greatest(2, len(w) - {size} + 2)), "
            f"lambda k: array_to_string(w[k:k + {size} - 1], chr(10))))")


#: crc32 of the list of byte values ``bytes``, with the 256 remainders in ``crc_table.remainders``.
_REMAINDERS = """
crc_table AS (
  SELECT list(list_reduce([k] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v & 1 = 1
              THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY k) AS remainders
  FROM range(256) t(k))"""
_CRC32 = ("xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), "
          "4294967295)")
_NOT_WHITE = r"[^\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
spots AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS words
  FROM d, (SELECT DISTINCT n FROM windows) s, unnest(range(1, len(w) - n + 2)) AS t(k)),
hits AS (SELECT doc_id, k, n, item_id FROM spots JOIN windows USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY ALL),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
          FROM hits GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_line_dedup": f"""
WITH every AS (
  SELECT doc_id, pos - 1 AS pos, {_SPACED_WORDS.format("lower(line)")} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
sets AS (SELECT doc_id, pos, {_shingles(5)} AS s FROM every WHERE len(w) > 0),
runs AS (SELECT doc_id, pos, len(s) AS n, unnest(s) AS run FROM sets),
near AS (
  SELECT b.doc_id, b.pos
  FROM runs a JOIN runs b ON a.run = b.run AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
  GROUP BY a.doc_id, a.pos, b.doc_id, b.pos, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
gone AS (SELECT doc_id, count(DISTINCT pos) AS n, array_to_string(list_sort(list(DISTINCT pos)), ',') AS removed
         FROM near GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n, 0) AS n_removed,
       coalesce(removed, '') AS removed
FROM documents LEFT JOIN gone USING (doc_id)""",
    "op10_ngram_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_SPACED_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN {_shingles(3)} ELSE [] END AS s FROM words),
runs AS (SELECT doc_id, len(s) AS n, unnest(s) AS run FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
          UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, len(s) AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT x AS doc_id, min(y) AS least_id FROM reach GROUP BY x) USING (doc_id)""",
    "op7_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0
                       THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
pages_judged AS (SELECT *, row_number() OVER () AS row_no FROM split),
hits AS (
  SELECT p.row_no, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM pages_judged p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY p.row_no)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM pages_judged p LEFT JOIN hits h USING (row_no)""",
    # Repairs are built row by row: of each conversation and state of the grammar the cheapest, ASCII-least
    # way so far. One insertion before a row is enough: two lead back to where they began.
    "op11_conversation_repair": f"""
WITH RECURSIVE {_REMAINDERS},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                        lambda c: CAST(unicode(c) AS BIGINT)) AS bytes
  FROM conversations),
kinds AS (SELECT * EXCLUDE (bytes), {_CRC32} % 20 AS kind FROM raw, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
         CASE WHEN NOT regexp_matches(text, '{_NOT_WHITE}') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed),
states(q, turn_name, q_next, letter) AS (VALUES (0, 'user', 2, 'u'), (1, 'user', 2, 'u'), (2, 'assistant', 3, 'a'), (3, 'user', 2, 'u')),
starts AS (
  SELECT q, q AS at, 0 AS cost, '' AS letters, []::VARCHAR[] AS turns FROM states
  UNION ALL SELECT q, q_next, 5, 'I', [turn_name || ':'] FROM states),
ways AS (
  SELECT m.conv_id, m.k, s.q AS q_from, e.*
  FROM marked m, starts s JOIN states t ON t.q = s.at, LATERAL (
    SELECT s.at AS q_to, s.cost + 2 AS cost, s.letters || 'D' AS letters, s.turns AS turns
    UNION ALL
    SELECT CASE WHEN m.initial = 's' THEN 1 ELSE t.q_next END, s.cost + CASE m.fault WHEN 'truncated' THEN 5 ELSE 0 END,
           s.letters || 'K', s.turns || [m.role || ':' || m.text]
    WHERE m.fault NOT IN ('blank', 'duplicate') AND (m.initial = t.letter OR (m.initial = 's' AND s.at = 0))
    UNION ALL
    SELECT t.q_next, s.cost + 1 + CASE m.fault WHEN 'truncated' THEN 5 ELSE 0 END, s.letters || 'R',
           s.turns || [t.turn_name || ':' || m.text]
    WHERE m.fault NOT IN ('blank', 'duplicate')) e),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM marked
  UNION ALL
  SELECT conv_id, k, q, way.cost, way.audit, way.turns
  FROM (SELECT b.conv_id, w.k, w.q_to AS q,
               min({{'cost': b.cost + w.cost, 'audit': b.audit || w.letters, 'turns': b.turns || w.turns}}) AS way
        FROM best b JOIN ways w ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = b.k + 1 AND w.q_from = b.q
        GROUP BY ALL)),
sums AS (
  SELECT conv_id, max(k) AS k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
done AS (
  SELECT s.conv_id, any_value(gaps) AS gaps, any_value(blank) AS blank, any_value(duplicate) AS duplicate,
         any_value(truncated) AS truncated, any_value(illegal) AS illegal,
         min({{'cost': b.cost + [0, 10, 5, 0][q + 1], 'audit': audit || ['', 'II', 'I', ''][q + 1],
              'turns': turns || [[], ['user:', 'assistant:'], ['assistant:'], []][q + 1]}}) AS way
  FROM sums s JOIN best b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.k = b.k GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(way.cost AS BIGINT), 0) AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op13_importance": f"""
WITH {_REMAINDERS},
texts AS (SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, doc_id, unnest({_BENCH_WORDS.format("text")}) AS word FROM texts),
hashed AS (
  SELECT word, {_CRC32} % 10000 AS bucket
  FROM (SELECT word, list_transform(range(1, octet_length(encode(word)) * 2, 2), lambda i:
               (instr('0123456789ABCDEF', substr(hex(word), i, 1)) - 1) * 16
               + instr('0123456789ABCDEF', substr(hex(word), i + 1, 1)) - 1) AS bytes
        FROM (SELECT DISTINCT word FROM words)), crc_table),
totals AS (SELECT CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS s_all, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS t_all FROM words),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((count(*) FILTER (side = 'b') + 1.0::DOUBLE) * (any_value(s_all) + 10000)
                                / ((count(*) FILTER (side = 'd') + 1.0::DOUBLE) * (any_value(t_all) + 10000)))) AS BIGINT) AS gain
  FROM words JOIN hashed USING (word), totals GROUP BY bucket),
weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT)
                                                     + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.*, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
