"""The driver's queries of this subpackage: thin bindings with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, chroma, fim, langid, linedup, neardup, packing, simhash, topk, toxicity, windows
from .common import ensure_checkpoint_dir, table

#: Where the public tokenizers' files are is a parameter of every operator; this is the queries' value.
def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chroma_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    s = chroma.Settings()
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    prints = chroma.fingerprints(rows, "embedding", s, chroma.decode_vectors(s)).checkpoint()
    return chroma.lookups(prints, prints.where("id % 100 = 0"), s)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_classes(table(spark, sf_dir, "documents"))


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.removal_digests(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = topk.Settings()
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised("embedding", s.scale).alias("v")).where("id is not null and v is not null")
    return topk.search(rows, rows.where("id % 20 = 0"), s)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


#: Limits for training on replies: at most 8 segments, and 768 of 1,024 tokens under the loss.
REPLIES = packing.Limits(tokens=1024, segments=8, loss_tokens=768)


def packed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 on instruction data: every conversation's turns, packed with the replies' mask."""
    out = packing.pack_turns(table(spark, sf_dir, "conversations"), vocabulary(), REPLIES)
    return out.withColumns({"ids": F.sha2(F.array_join("ids", ","), 256), "loss": F.sha2(F.array_join(F.transform("loss", lambda x: x.cast("int")), ""), 256)}).withColumnsRenamed({"ids": "ids_sha256", "loss": "loss_sha256"})


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.held_out(mod=5, rest=0)
    machine = toxicity.fit(docs.where(~held), labels.where(~held))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digest_paths(chat.chosen_turns(chat.chain(rows.union(own))))


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"packed_replies": packed_replies}


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op10_reply_trees": OP10_SQL, "op12_fill_in_middle": OP12_SQL}


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0d\x1c-\x20]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s, count(*) AS n_copies FROM g WHERE len(s) > 0 GROUP BY s),
u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
k AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT g.doc_id, coalesce(k.class_id, g.doc_id) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies
FROM g LEFT JOIN c ON g.s = c.s LEFT JOIN k ON k.node = c.rep LEFT JOIN l ON l.a = c.rep
"""

OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\#:<]', '', 'g')) + 15 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  list_transform(range(4), lambda i: CAST('0x' || substring(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
r AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
