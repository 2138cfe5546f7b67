"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.llm.common import fold, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.neardup import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
grams AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g
    FROM words, unnest(range(1, greatest(2, len(w) - 3))) AS r(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE k >= 0.8 * (s.n + t.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, (SELECT count(*) FROM links l WHERE l.x = doc_id) AS n_links FROM documents JOIN classes ON x = doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.pieces import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), piece_model()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.toxicity import FOLDS, toxic_spans, train

    docs = table(spark, sf_dir, "documents")
    scored = toxic_spans(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"),
    )


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.topk import quantised, top_k

    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.katz import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.langid import FOLDS, languages, train

    docs = table(spark, sf_dir, "documents")
    found = languages(docs, train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from keyspan.llm.counts import token_counts

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.secrets import digests, secret_spans

    return digests(secret_spans(table(spark, sf_dir, "documents")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree with one branch: a turn answers the one before it."""
    from keyspan.llm.chat import format_trees, read_back

    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    order = Window.partitionBy("conv_id").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")
    )
    messages = rows.withColumn("node", F.row_number().over(order)).select(
        F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_trees(messages)).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '(<|\[)\\*(/?s>|/?INST\]|</?SYS>>)')) AS n,
           length(role) + len(regexp_extract_all(role, '(<|\[)\\*(/?s>|/?INST\]|</?SYS>>)')) AS m
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(CASE role WHEN 'user' THEN 15 + n WHEN 'assistant' THEN 4 + n ELSE 19 + m + n END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.merkle import tampered_proofs

    return tampered_proofs(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           xor(4294967295::UBIGINT, list_reduce(
               list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
               lambda a, x: xor(a >> 8, list_reduce(
                   list_prepend(xor(a, x) & 255, range(8)::UBIGINT[]),
                   lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::UBIGINT) ELSE b >> 1 END)))) AS crc
    FROM documents
),
leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           sha256(head || coalesce(strlen((n_chars + (crc % 7 = 0)::INT)::VARCHAR) || ':' || (n_chars + (crc % 7 = 0)::INT), '-') || tail) AS changed
    FROM fields
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
),
below AS (
    SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(other, ''))
    FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS other FROM below WHERE n > 1) WHERE i % 2 = 0
),
roots AS (
    SELECT lang, h AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM below WHERE n = 1
),
above AS (
    SELECT 0 AS level, i, n, subroot AS h FROM roots
    UNION ALL
    SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(other, ''))
    FROM (SELECT *, lead(h) OVER (ORDER BY i) AS other FROM above WHERE n > 1) WHERE i % 2 = 0
),
sides AS (
    SELECT p.lang, p.i, b.level, (b.i % 2 = 1) AS is_left, s.h
    FROM placed p JOIN below b ON b.lang IS NOT DISTINCT FROM p.lang AND b.n > 1 AND b.i = p.i >> b.level
    LEFT JOIN below s ON s.lang IS NOT DISTINCT FROM b.lang AND s.level = b.level AND s.i = xor(b.i, 1)
    UNION ALL
    SELECT p.lang, p.i, r.depth + b.level, (b.i % 2 = 1), s.h
    FROM placed p JOIN roots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN above b ON b.n > 1 AND b.i = r.i >> b.level
    LEFT JOIN above s ON s.level = b.level AND s.i = xor(b.i, 1)
),
paths AS (
    SELECT lang, i, string_agg(h, '' ORDER BY level) AS proof,
           list(CASE WHEN is_left THEN 'L' ELSE 'R' END || coalesce(h, '') ORDER BY level) AS steps
    FROM sides GROUP BY lang, i
),
joined AS (
    SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM above WHERE n = 1) AS root, sha256(coalesce(s.proof, '')) AS proof_sha256,
           list_reduce(
               list_prepend(p.changed, coalesce(s.steps, [])),
               lambda h, x: sha256(CASE WHEN x[1] = 'L' THEN substr(x, 2) || h ELSE h || substr(x, 2) END)) AS folded_root
    FROM placed p JOIN roots r ON r.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN paths s ON s.lang IS NOT DISTINCT FROM p.lang AND s.i = p.i
)
SELECT *, folded_root = root AS verified FROM joined
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyspan.llm.ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS d
    FROM documents
),
sizes AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM words WHERE len(w) > 0),
postings AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM words) GROUP BY d, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, sizes GROUP BY t, docs),
items AS (
    SELECT item_id, q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT *, row_number() OVER () AS q FROM benchmark)
),
scored AS (
    SELECT q, item_id, doc_id, d, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * docs) // total))))::BIGINT AS score
    FROM items JOIN weights USING (t) JOIN postings USING (t) JOIN words USING (d), sizes GROUP BY q, item_id, doc_id, d
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_ngram_jaccard, op2_decontamination, op3_sentencepiece, op4_toxicity, op5_top_k, op6_katz, op7_language_id,
        op8_token_counts, op9_secret_scans, op10_chat_formatting, op11_vector_packing, op12_merkle_manifest,
        op13_ranked_search,
    ]
    return {fn.__name__: fn for fn in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": OP1_SQL, "op5_top_k": OP5_SQL, "op10_chat_formatting": OP10_SQL, "op12_merkle_manifest": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
    }
