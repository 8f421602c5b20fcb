"""Registered queries: each operator over its whole table, and its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import ann, bpe, chat, decontaminate, html_tree, langid, minhash, packing, periodic_runs, pii, prefix_trie, substring_dedup, toxicity
from cellframe.llm.common import id_crc, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary of op9 and the last stage of the pipeline.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


@query
def op2_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 20 words which start earlier cover."""
    return substring_dedup.removed_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_tree.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op4_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows of 10 words hit."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.report(table(spark, sf_dir, "documents", "doc_id", "text"), items)


@query
def op5_anchor_expansion_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_chat_template_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(hard)))


@query
def op7_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    model = langid.train(docs.filter(F.coalesce(~held_out, F.lit(True))))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op8_dart_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


@query
def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.pmod(id_crc(), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.coalesce(~held_out, F.lit(False)))
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, whose first turns are shared in groups of twenty by the task's rule."""
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie.trie(prefix_trie.shared_heads(turns))


@query
def op12_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens, closed by id 2, in sequences of at most 4,096 tokens."""
    rows, dtype = packing.tokenized(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY, 2)
    pieces = packing.pack(rows, dtype)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which repeat a stretch up to their end by the task's rule."""
    return periodic_runs.digests(table(spark, sf_dir, "documents", "doc_id", "text"), periodic_runs.repeated_tail)


ORACLES["op2_rlz_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT t.doc_id, count(g.p) AS removed, string_agg(t.t, ' ' ORDER BY t.p) FILTER (WHERE g.p IS NULL) AS s
         FROM tok t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_WORDS = (
    r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)
ORACLES["op4_positional_index_decontamination"] = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(w[a:a + 9]) AS l, array_to_string(w[a:a + 9], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, l, a, array_to_string(w[a:a + l - 1], ' ') AS k
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS a FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hit AS (SELECT dw.doc_id, dw.a, dw.l, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.l = iw.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + l)) AS p FROM hit) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

ORACLES["op6_chat_template_compiler"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(role, '\', '\\'), '### ', '###\ '), '</turn>', '<\/turn>'), chr(10), '\n') AS r,
             replace(replace(replace(text, '\', '\\'), '### ', '###\ '), '</turn>', '<\/turn>') AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(r) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
