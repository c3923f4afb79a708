"""The registered query of each operator, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text, as told from its words."""
    from .language_id import fit, identify
    from .toxicity import held_out

    docs = _table(spark, sf_dir, "documents")
    told = identify(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for each text, and whether it is toxic."""
    from .toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    from ._shared import written
    from .mixing import mix, word_count

    docs = _table(spark, sf_dir, "documents")
    narrow = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash")), "words")
    return mix(narrow, F.array("source"), F.col("words"), key=F.xxhash64("doc_id", "text_hash")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, and in how many windows."""
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text, of an edited one and of the next document's, and how near they are."""
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text."""
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of ``pages`` against a damaged replica finds."""
    from .fixity import damaged, fixity

    pages = _table(spark, sf_dir, "pages")
    return fixity(pages, damaged(pages))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its rendered form."""
    from .chat_format import events_of, fold, read_back, render

    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(render(fold(events_of(rows.unionByName(more)))))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document by shared shingles."""
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with damage by hash, repaired: one row of figures and a digest for each."""
    from .turn_repair import Repair, damage

    return Repair(damage(_table(spark, sf_dir, "conversations"))).digests()


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of known form and those that patterns around them add, one row for each document."""
    from .personal_data import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 collocations of each language with the highest scores."""
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import fixity, phrases, sharding, turn_repair

    chat = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + length(escaped) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
    jaccard = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s), n AS (SELECT doc_id, len(sh) AS k FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 90 * (i.k + j.k - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT r.d, l.y FROM r JOIN l ON r.m = l.x)
SELECT n.doc_id, n.k::BIGINT AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.k
"""
    return {"op10_jaccard_join": jaccard, "op9_chat_format": chat, "op4_sharding": sharding.oracle(), "op8_fixity": fixity.ORACLE, "op11_turn_repair": turn_repair.ORACLE, "op13_phrases": phrases.ORACLE}
