"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.llm import chat, jaccard, langid, linededup, lm, media, mixing, packing, phrases, quality, simhash, spelling, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_lines", "n_common", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_common_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=90)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_read(spark, sf_dir, "documents"))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timed row for each shot of each document's stored file."""
    return media.clips(media.store(_read(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.drop_repeats(_read(spark, sf_dir, "documents"), width=13)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a chosen one. Its rejected counterpart goes the same way up to a turn that depends on the pair,
    and from there on as the next conversation does."""
    turns = _read(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("long")

    def side(pair: Column, name: str) -> Column:
        return F.struct(pair.alias("pair_id"), F.lit(name).alias("side"))

    before = F.col("turn") < conv % 6
    after = ~(F.col("turn") < (conv - 1) % 6) & (conv > 0)
    sides = F.array(side(conv, "chosen"), F.when(before, side(conv, "rejected")), F.when(after, side(conv - 1, "rejected")))
    sides = turns.select(F.explode(F.array_compact(sides)).alias("s"), "turn", "role", "text").select("s.*", "turn", "role", "text")
    pairs = chat.preferences(sides)
    digests = [
        x
        for side in ("chosen", "rejected")
        for x in (
            F.sha2(chat.rendered(side), 256).alias(f"{side}_sha256"),
            F.length(chat.rendered(side)).cast("long").alias(f"{side}_chars"),
            F.sha2(chat.loss_text(side), 256).alias(f"{side}_loss_sha256"),
        )
    ]
    return pairs.select("pair_id", "n_prompt_turns", F.sha2("prompt", 256).alias("prompt_sha256"), *digests)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "copy", "block", "place")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.words(_read(spark, sf_dir, "documents"), damaged=97))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near, for documents whose id is divisible by 20: how many documents have a fingerprint within the radius, itself included."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    made = simhash.against_edits(docs, simhash.weights(docs))
    asking = F.col("id") % 20 == 0
    near = simhash.near_counts(made.select("id", "hi", "lo"), asking)
    hi, lo = F.col("d.hi"), F.col("d.lo")
    same = (hi == F.col("s.hi")) & (lo == F.col("s.lo"))
    return made.alias("d").join(near.alias("s"), same, "left").select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        simhash.hexadecimal("d.hi", "d.lo").alias("fingerprint"), simhash.hexadecimal("edited_hi", "edited_lo").alias("edited_fingerprint"),
        simhash.likeness(hi, lo, F.col("edited_hi"), F.col("edited_lo")).alias("near_edited"),
        simhash.likeness(hi, lo, F.col("next_hi"), F.col("next_lo")).alias("near_next"),
        F.when(asking, F.col("n_near")).alias("n_near"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component. deviation is null where it doesn't fit in a long; deviation_digits always has it."""
    made = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    each = made.select("*", F.posexplode("whitened").alias("at", "one"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("one").alias("whitened"), F.get("explained", "at").alias("explained"), "identity_error", F.col("deviation").cast("string").alias("deviation_digits"),
    )


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_substring_dedup, op3_media_columns, op4_best_fit_packing, op5_preference_formatting, op9_temperature_mixing, op6_ngram_jaccard_join, op7_quality_rules, op8_line_dedup, op10_language_id, op11_spelling_variants, op12_document_fingerprints, op13_embedding_whitening, media_clips)}

_WS = "[\\x20\\x09-\\x0D]"

SQL = {
    "op2_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], chr(1)) AS g FROM w, unnest(range(1, len(w) - 11)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS own FROM win) WHERE own < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, unnest(range(13)) AS o(k)),
each AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT each.doc_id, count(cov.i) AS n_removed,
                string_agg(CASE WHEN cov.i IS NULL THEN word END, ' ' ORDER BY each.i) AS kept
         FROM each LEFT JOIN cov ON each.doc_id = cov.doc_id AND each.i = cov.i GROUP BY each.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op5_preference_formatting": """
WITH s AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations
           UNION ALL SELECT conv_id, 1, turn, role, text FROM conversations WHERE turn < conv_id % 6
           UNION ALL SELECT conv_id - 1, 1, turn, role, text FROM conversations WHERE NOT turn < (conv_id - 1) % 6 AND conv_id > 0),
t AS (SELECT pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM s),
c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
both_sides AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i,
                 coalesce(c.role = r.role AND c.text = r.text, false) AS same
          FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.i = r.i),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n FROM both_sides GROUP BY pair_id),
p AS (SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole,
             text || '<|end|>' || chr(10) AS body FROM t JOIN n USING (pair_id)),
f AS (SELECT pair_id, any_value(n) AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN side = 0 AND i <= n THEN whole END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 0 AND i > n THEN whole END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN side = 1 AND i > n THEN whole END, '' ORDER BY i), '') AS rejected,
  coalesce(string_agg(CASE WHEN side = 0 AND i > n AND role = 'assistant' THEN body END, '' ORDER BY i), '') AS cl,
  coalesce(string_agg(CASE WHEN side = 1 AND i > n AND role = 'assistant' THEN body END, '' ORDER BY i), '') AS rl
  FROM p GROUP BY pair_id)
SELECT pair_id, n_prompt_turns, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256,
       length(chosen) AS chosen_chars, sha256(cl) AS chosen_loss_sha256, sha256(rejected) AS rejected_sha256,
       length(rejected) AS rejected_chars, sha256(rl) AS rejected_loss_sha256 FROM f
""",
    "op6_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, chr(1))
                                   ELSE w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] END AS g
      FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id
FROM (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
""",
    "op7_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] AS g
        FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_text_lines FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
keyed AS (SELECT doc_id, host, text, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k,
                 len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM lines),
hosts AS (SELECT host, count(DISTINCT doc_id) AS of FROM d GROUP BY host),
common AS (SELECT host, k FROM keyed JOIN hosts USING (host) WHERE k <> '' GROUP BY host, k, of
           HAVING count(DISTINCT doc_id) >= 5 AND 20 * count(DISTINCT doc_id) > of),
gone AS (SELECT doc_id, count(*) AS lines, sum(n) AS n FROM keyed JOIN common USING (host, k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.lines, 0)::BIGINT AS n_common_lines, coalesce(gone.n, 0)::BIGINT AS n_common,
             coalesce(n_text_lines, 0) AS n_text_lines
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_lines, n_common, base_failed,
       NOT base_failed AND n_words - n_common >= 50 AND 10 * (n_words - n_common) >= 2 * n_words
         AND 2 * (n_text_lines - n_common_lines) >= n_text_lines AS kept FROM f
""",
    "op8_line_dedup": """
WITH lines AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN common.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
""",
}
