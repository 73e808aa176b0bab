"""The registered queries of this subpackage, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, chat, hmm, langid, media, mixing, packing, phrases, pieces, repair, rules, simhash, toxicity
from .common import WHITE, fold, materialise, table, text_of
from .repair_sql import OP12_SQL

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences. A null or empty text is its end id alone; equal and repeated rows are packed one by one; an empty table gives none."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document. Null and empty texts are scored too, equal texts alike; without labelled documents all score below one half; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and digests of every document, read back from the files, by id (nulls first). A null or empty text is the end id alone; repeated rows stay rows; an empty table gives none."""
    return binary.read_documents(binary.write_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, read back from the written form. Null texts are empty, null roles are no role; turns of one number come by role and text; repeats stay."""
    turns = chat.probe(table(spark, sf_dir, "conversations")).withColumn("parts", chat.parts_of_text(F.col("text")))
    written = materialise(chat.format_chats(turns), "chats")
    back = written.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "expanded_tokens")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP4_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN + chat.BODY + chat.END)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS expanded_tokens
FROM said GROUP BY conv_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null, empty and wordless texts have fingerprint zero and are linked; repeated rows stay; an empty table gives none."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Null texts and those without a letter are `und`; equal texts are judged alike, ties go to the first language by name."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document. A null text has no words and fails; repeated rows stay; an empty table gives none."""
    judged = rules.ledger(table(spark, sf_dir, "documents"))
    base = ~rules.passes(rules.BASE)
    return judged.select("doc_id", *[f"ledger.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), (~base & rules.passes(rules.POLICY)).alias("kept"), "ledger.fail_bits")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM d, unnest(string_split(text, chr(10))) AS s(x)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_marks,
    CAST(length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS BIGINT) AS n_letters,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, CAST(""" + " + ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(rules.RULES)) + rf""" AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {rules.BASE.mask}) != 0 AS base_failed,
  (fail_bits & {rules.POLICY.mask | rules.BASE.mask}) = 0 AS kept, fail_bits FROM b
"""

def domain() -> Column:
    """The domain of a document: a rule on its source's number, as the tables name none."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0)) % 4)


WEIGHTS = {"domain": {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, "lang": {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}}
PATH = ["domain", "lang", "source"]


def n_words() -> Column:
    return F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, budget and copies of every document. Null languages and sources are leaves of their own; ties of rank go by id; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain())
    mixed = mixing.mix(docs, PATH, WEIGHTS, n_words(), total_share=0.8, epochs=2.0, seed=9)
    return mixed.select("doc_id", *PATH, "leaf_budget", "copies")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document. A null or empty text is its end alone; equal texts score alike but for rounding; without training documents all words are unknown."""
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form and features of every document. A null or empty text is one block of spaces; equal texts have equal values; an empty table gives no row."""
    return media.read_media(media.write_media(table(spark, sf_dir, "documents")))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and decoded texts of pieces.encode_documents, whose rules for odd rows hold."""
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), PIECE_BPE)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrases.collocations of all texts; its rules for odd rows hold."""
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM p, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
inner_ AS (SELECT lang, w[i] || ' ' || w[i + 1] AS phrase, max(a) AS most FROM c, (VALUES (1), (2)) AS v(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE coalesce(100 * most, 0) < 50 * a),
cut AS (SELECT *, array_to_string(w[1:h], ' ') AS head, array_to_string(w[h + 1:], ' ') AS rest FROM kept, unnest(range(1, k)) AS u(h)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.h, x.a AS l, y.a AS r,
    CAST((1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, cheapest edits and digest of its repaired rows, by repair.repair after the damage."""
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(turns))
    joined = repair.joined(found.edits)
    own = turns.select("conv_id").distinct()
    report = found.report.withColumnRenamed("conv", "a")
    told = own.join(report, F.col("conv_id").eqNullSafe(F.col("a")), "left").join(joined.withColumnRenamed("conv", "b"), F.col("conv_id").eqNullSafe(F.col("b")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_bit_packing": op3_bit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
    "op11_phrases": op11_phrases,
    "op12_repair": op12_repair,
    "op13_pieces": op13_pieces,
}
ORACLE: dict[str, str] = {"op4_chat_formatting": OP4_SQL, "op7_quality_rules": OP7_SQL, "op11_phrases": OP11_SQL, "op12_repair": OP12_SQL}
