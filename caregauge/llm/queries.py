"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caregauge.llm import (
    bpe,
    chat,
    cover_tree,
    main_text,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    sharding,
    simhash,
    spelling,
    token_files,
    warc,
)
from caregauge.llm.common import sends_package, shared_folder, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=0)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's marks, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    added = spark.sql("SELECT -7L conv_id, col1 turn, col2 role FROM VALUES (0L, 'user'), (1L, 'assistant')")
    both = given.unionByName(added.withColumn("text", F.lit(hard)))
    return chat.digests(chat.read_windows(chat.windows(both)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again; the ids are written in between, so that a task
    has one Python worker at a time."""
    encoded = written(bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER))
    decoded = bpe.decode(encoded, TOKENIZER)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives with revisit records and read back."""
    folder = shared_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.archived_pages(spark, folder)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts together."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents; the forest is fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all documents."""
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Parquet lists and read back."""
    folder = shared_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=1)
    return token_files.checksums(token_files.read_token_files(spark, folder))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts, a digest of the base spans, and all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")

    def many(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    return found.select(
        "doc_id",
        many("assign").alias("n_assign"),
        many("access").alias("n_access"),
        many("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine links and classes of all vectors."""
    return cover_tree.cosine_links(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; the model is fitted on some whose markup names their article."""
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(pages))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, after the first turns of some are replaced by shared ones."""
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_history(lists))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_best_fit_packing,
        op2_chat_formatting,
        op3_bpe,
        op4_warc,
        op5_sharding,
        op6_quality_rules,
        op7_simhash,
        op8_token_files,
        op9_secret_scan,
        op10_embedding_neardup,
        op11_html_extraction,
        op12_prefix_trie,
        op13_spelling_variants,
    ]
    return {f.__name__: sends_package(f) for f in own} | {"pipeline": corpus_pipeline.run}


# Base 32 from the hex digits of SHA-1: eight letters for each ten digits.
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + ((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT, 1)"
    for k in range(4)
    for j in range(8)
)

OP4 = f"""
WITH headed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), digested AS (
  SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest FROM headed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

OP10 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, x -> NOT isfinite(x))) = 0
    AND len(list_filter(embedding, x -> x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""


# The unsigned crc32 of the decimal id, bit by bit; prefixes as lists of turns.
OP12 = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), drawn AS (
  SELECT *, conv_id - ((conv_id % 20) + 20) % 20 AS head_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
      lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 4 AS h
  FROM own
), lists AS (
  SELECT d.conv_id, list_concat(coalesce(list_slice(b.turns, 1, d.h), []), list_slice(d.turns, d.h + 1, len(d.turns))) AS turns
  FROM drawn d LEFT JOIN own b ON b.conv_id = d.head_id
), members AS (
  SELECT conv_id, len(turns) AS n_turns, depth, list_slice(turns, 1, depth) AS p
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM lists)
), nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '') AS ends,
         CASE WHEN depth > 0 THEN (count(*) - 1) * len(regexp_extract_all(p[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM members GROUP BY p, depth
), children AS (
  SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (p)
), below AS (
  SELECT list_slice(p, 1, a) AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
       c.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(c.ends) AS ends_sha256
FROM counted c JOIN below b USING (p)
LEFT JOIN nodes up ON c.depth > 0 AND up.depth = c.depth - 1 AND up.p = list_slice(c.p, 1, c.depth - 1)
"""

# Letters from U+00C0 on are two bytes; words one edit apart share the word or its rest without a letter.
OP13 = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{C0}-\x{FF}]{5,}')) AS run
  FROM documents
), grouped AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS times FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
      lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) AS h
  FROM grouped
), cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3
), rests AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM rests a JOIN rests b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT rests.word, words.word FROM rests JOIN words ON rest = words.word
  UNION SELECT words.word, rests.word FROM rests JOIN words ON rest = words.word
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY words.n DESC, other) AS other, max(words.n) AS other_n
  FROM near JOIN words ON other = words.word GROUP BY 1
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
         CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), paths AS (
  SELECT word, word AS last_word FROM words
  UNION ALL SELECT paths.word, formed.form FROM paths JOIN formed ON last_word = formed.word WHERE formed.form IS NOT NULL
), ends AS (
  SELECT paths.word, last_word AS root FROM paths JOIN formed ON last_word = formed.word WHERE formed.form IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op10_embedding_neardup": OP10, "op12_prefix_trie": OP12, "op13_spelling_variants": OP13}
