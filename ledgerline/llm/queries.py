"""The registered queries of this subpackage: each applies one operator, with production parameters, to its
whole table and derives the digest columns of the result from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import stash
from .byte_bpe import decode_ids, encode_texts
from .decontaminate import mark_contamination
from .html_text import extract_main_text
from .line_dedup import remove_repeated_lines
from .packing import pack, token_pieces
from .pii import BASE_KINDS, find_personal_data
from .prefix_trie import branched, numbered_turns, prefix_trie
from .simhash import near_duplicate_groups
from .substring_dedup import remove_repeated_windows
from .token_counts import count_tokens
from .topk import top_k
from .toxicity import held_out, score_toxicity
from .turn_repair import damage_turns, repair_reports, repair_turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = remove_repeated_windows(docs, n=20, out="d")
    return got.select("doc_id", "d.n_words", "d.n_removed", F.sha2("d.kept_text", 256).alias("kept_sha256"),
                      F.size("d.intervals").cast("long").alias("n_intervals"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    got = score_toxicity(docs, labels, out="t")
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "t.score", "t.predicted", "t.evidence")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = remove_repeated_lines(docs, out="d")
    return got.select("doc_id", "d.n_lines", "d.n_removed", F.sha2("d.kept_text", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, tokenizer_path())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_groups(docs, shingle=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary_path(), out="t").select("doc_id", "t.*")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_personal_data(docs, out="p")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("p", lambda s: s.kind.isin(*BASE_KINDS))
    counts = [F.size(F.filter("p", lambda s: s.kind == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return got.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("p")).alias("spans"),
                      F.size("p").cast("long").alias("n_spans"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = mark_contamination(docs, table(spark, sf_dir, "benchmark"), n=10, out="c")
    return got.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
                      (F.col("c.n_hit") > 0).alias("contaminated"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decode_ids(encode_texts(docs, *ranks, out="ids").drop("text"), *ranks, "ids", out="bytes")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = branched(stash(numbered_turns(table(spark, sf_dir, "conversations"))))
    return prefix_trie(turns, convs)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_reports(repair_turns(damage_turns(turns), also=turns.select("conv_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_exact_topk": op3_exact_topk,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_main_text": op6_html_main_text,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_personal_data": op9_personal_data,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_conversation_repair": op13_conversation_repair,
}

def _sql_crc32(text: str) -> str:
    """DuckDB text of the unsigned CRC-32 (reflected, polynomial 0xEDB88320) of an ASCII string."""
    byte = ("list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)")
    data = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda crc, b: {byte}), 4294967295::BIGINT)"


SQL: dict[str, str] = {
    "op1_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word, len(ws) AS n FROM w),
        g AS (SELECT w.doc_id, k, array_to_string(ws[k:k + 19], ' ') AS gram FROM w, unnest(range(1, len(ws) - 18)) AS t(k)),
        f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY gram ORDER BY doc_id, k) > 1 AS again FROM g),
        c AS (SELECT p.doc_id, p.k, word, n, coalesce(max(again::INT) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
              FROM p LEFT JOIN f USING (doc_id, k)),
        a AS (SELECT doc_id, n, gone, word, k, gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) = 0 AS opens FROM c)
        SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0), '')) AS kept_sha256,
               count(*) FILTER (WHERE opens)::BIGINT AS n_intervals
        FROM documents d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id""",
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_benchmark_decontamination": """
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
        bg AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS gram
               FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(k) WHERE len(ws) > 0),
        sizes AS (SELECT DISTINCT size FROM bg),
        dg AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS gram FROM w, sizes, unnest(range(1, len(ws) - size + 2)) AS t(k)),
        hits AS (SELECT doc_id, k, size, item_id FROM dg JOIN bg USING (size, gram)),
        covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
                  FROM hits GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_conversation_trie": f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_sql_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, place, role, text FROM c JOIN t USING (conv_id) WHERE place > h
              UNION ALL SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE place <= h),
        p AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS turns
              FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
        q AS (SELECT conv_id, d, sha256(turns[1:d]::VARCHAR) AS node, if(d > 0, sha256(turns[1:d - 1]::VARCHAR), NULL) AS up, len(turns) = d AS ends,
                     if(d > 0, len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')), 0) AS words,
                     list_transform(range(0, d + 1), lambda k: sha256(turns[1:k]::VARCHAR)) AS above
              FROM p, unnest(range(0, len(turns) + 1)) AS x(d)),
        n AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
                     (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
              FROM q GROUP BY node),
        k AS (SELECT up AS node, count(*) AS n_children FROM n GROUP BY up),
        b AS (SELECT top AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL)::BIGINT AS n_leaves
              FROM (SELECT unnest(above) AS top, saved, n_children FROM n LEFT JOIN k USING (node)) GROUP BY top)
        SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
               n_leaves, saved_tokens, n.ends_sha256
        FROM n JOIN b USING (node) LEFT JOIN k USING (node) LEFT JOIN n o ON o.node = n.up""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE hit AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
        bad AS (SELECT conv_id, turn, if(kind = 4, 'user', role) AS role, unnest(range(if(kind = 3, 2, 1))) AS copy,
                       CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit WHERE kind <> 0),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM bad),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault, left(role, 1) AS initial,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
        c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        -- cheapest, then least edits that reach a state: z nothing yet, s after system, u after user, a after assistant
        w AS (
          SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'e': '', 't': []::VARCHAR[]}} AS z, NULL::STRUCT(c INTEGER, e VARCHAR, t VARCHAR[]) AS s,
                 {{'c': 2, 'e': 'I', 't': ['user:']}} AS u, {{'c': 4, 'e': 'II', 't': ['user:', 'assistant:']}} AS a FROM c
          UNION ALL
          SELECT conv_id, i, z, s, u, list_min([a, {{'c': u.c + 2, 'e': u.e || 'I', 't': list_append(u.t, 'assistant:')}}]) AS a FROM (
            SELECT conv_id, i, z, s, list_min(list_filter([u, {{'c': z.c + 2, 'e': z.e || 'I', 't': list_append(z.t, 'user:')}},
                     {{'c': s.c + 2, 'e': s.e || 'I', 't': list_append(s.t, 'user:')}}, {{'c': a.c + 2, 'e': a.e || 'I', 't': list_append(a.t, 'user:')}}],
                     lambda x: x.c IS NOT NULL)) AS u, a FROM (
              SELECT w.conv_id, f.i, {{'c': z.c + 3, 'e': z.e || 'D', 't': z.t}} AS z,
                     list_min(list_filter([{{'c': s.c + 3, 'e': s.e || 'D', 't': s.t}},
                       {{'c': if(stays AND initial = 's', z.c + late, NULL), 'e': z.e || 'K', 't': list_append(z.t, kept)}}], lambda x: x.c IS NOT NULL)) AS s,
                     list_min(list_filter(list_concat([{{'c': u.c + 3, 'e': u.e || 'D', 't': u.t}}], flatten(list_transform([z, s, a], lambda x: [
                       {{'c': if(stays AND initial = 'u', x.c + late, NULL), 'e': x.e || 'K', 't': list_append(x.t, kept)}},
                       {{'c': if(stays, x.c + 2 + late, NULL), 'e': x.e || 'R', 't': list_append(x.t, 'user:' || text)}}]))), lambda x: x.c IS NOT NULL)) AS u,
                     list_min(list_filter([{{'c': a.c + 3, 'e': a.e || 'D', 't': a.t}},
                       {{'c': if(stays AND initial = 'a', u.c + late, NULL), 'e': u.e || 'K', 't': list_append(u.t, kept)}},
                       {{'c': if(stays, u.c + 2 + late, NULL), 'e': u.e || 'R', 't': list_append(u.t, 'assistant:' || text)}}], lambda x: x.c IS NOT NULL)) AS a
              FROM w JOIN (SELECT conv_id, i, text, initial, role || ':' || text AS kept, fault IS NULL OR fault = 'truncated' AS stays,
                                  CAST(fault IS NOT NULL AS INTEGER) AS late FROM f) f
                ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
        best AS (SELECT conv_id, list_min([z, a]) AS x, c.* EXCLUDE (conv_id, n) FROM w JOIN c USING (conv_id) WHERE i = n)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost,
               coalesce(x.e, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best USING (conv_id)""",
}
