"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from .common import shared_dir, table


def op1_byte_bpe(spark, sf_dir):
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_chat_format(spark, sf_dir):
    from . import chat

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.trees(chat.as_trees(rows)), "tree_id").withColumnRenamed("tree_id", "conv_id")


def op3_quality_gam(spark, sf_dir):
    from . import quality

    return quality.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bm25_decontamination(spark, sf_dir):
    from . import decontaminate

    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark, sf_dir):
    from . import suffixes

    return suffixes.digests(table(spark, sf_dir, "documents"), 100)


def op6_phrase_dedup(spark, sf_dir):
    from . import phrases

    return phrases.digests(table(spark, sf_dir, "documents"), 35)


def op7_ngram_jaccard(spark, sf_dir):
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    from . import tokenfile

    path = f"{shared_dir(spark)}/framewell/tokens-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokenfile.offsets(spark, path)


def op9_spotsigs(spark, sf_dir):
    from . import spotsigs

    return spotsigs.digests(table(spark, sf_dir, "documents"))


def op10_rendezvous_shards(spark, sf_dir):
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents"))


_ALL = (op1_byte_bpe, op2_chat_format, op3_quality_gam, op4_bm25_decontamination, op5_suffix_dedup, op6_phrase_dedup, op7_ngram_jaccard, op8_token_files, op9_spotsigs, op10_rendezvous_shards)
QUERIES = {f.__name__: f for f in _ALL}

_ESC = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '#', chr(92) || 'h'), '<', chr(92) || 'l')"
_SQL_OP6 = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM t WHERE len(w) >= 35),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM g),
r AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM x JOIN r USING (s)),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN o USING (doc_id)
"""
_SQL_OP5 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 200) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM t WHERE length(h) >= 200)),
f AS (SELECT s, min((doc_id, i)) AS first FROM x GROUP BY s HAVING count(*) > 1),
d AS (SELECT doc_id, i FROM x JOIN f USING (s) WHERE (doc_id, i) <> first),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 99)) AS p FROM d),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR p > before + 1) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c) GROUP BY doc_id),
b AS (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 1)) AS p FROM t WHERE length(h) > 0),
o AS (SELECT doc_id, string_agg(substr(h, (2 * p + 1)::BIGINT, 2), '' ORDER BY p) AS kept FROM b ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""
_SQL_OP7 = """
WITH RECURSIVE t AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)
      UNION SELECT a.doc_id, b.doc_id FROM t a JOIN t b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id AS v, doc_id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v),
c AS (SELECT v AS doc_id, min(root) AS class_id FROM r GROUP BY v),
m AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM c LEFT JOIN m USING (doc_id)
"""
ORACLE_SQL = {
    "op5_suffix_dedup": _SQL_OP5,
    "op6_phrase_dedup": _SQL_OP6,
    "op7_ngram_jaccard": _SQL_OP7,
    "op2_chat_format": rf"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(replace({_ESC.format("role")}, ':', chr(92) || 'c')) + 2 + length({_ESC.format("text")}) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
}
