"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetry.llm import ann, lines, middle, mixing, packing, pii, prefixes, quality, sharding, simhash, suffixes, warc, wavelet
from facetry.session import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_audit(table(spark, sf_dir, "pages"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(middle.transformed(table(spark, sf_dir, "documents")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.without_repeated_lines(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_surrogates, op3_quality_llr, op4_merkle_audit, op5_simhash_components, op6_packed_sequences, op7_hypergeometric_shards,
        op8_wavelet_shards, op9_multiprobe_neighbours, op10_repeated_bytes, op11_conversation_trie, op12_fill_in_middle, op13_line_dedup,
    )
}

SQL: dict[str, str] = {
    "op4_merkle_audit": """
        WITH marked AS (
            SELECT page_id, coalesce(html, '') AS body, substr(md5(coalesce(url, '')), 1, 2) AS mark,
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'WARC-Target-URI: '
                || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS tail
            FROM pages),
        records AS (
            SELECT page_id, mark, strlen(head || body || tail) AS record_length, sha256(head || body || tail) AS digest_left,
                sha256(head || CASE mark WHEN '00' THEN '~' || substr(body, 2) WHEN '01' THEN left(body, length(body) - 1) ELSE body END || tail) AS digest_other
            FROM marked),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id, digest_left) AS copy, greatest(1, (count(*) OVER () + 1023) // 1024) AS files FROM records),
        placed AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), 'null') || '#' || copy), 1, 8))::BIGINT % files AS file FROM numbered),
        laid AS (SELECT *, sum(record_length) OVER (PARTITION BY file ORDER BY page_id, digest_left, copy ROWS UNBOUNDED PRECEDING) - record_length AS record_offset FROM placed)
        SELECT page_id AS record_id, CASE WHEN mark = '02' THEN 'missing' ELSE 'changed' END AS kind, CAST(file AS BIGINT) AS file, CAST(record_offset AS BIGINT) AS record_offset,
            CAST(record_length AS BIGINT) AS record_length, digest_left, CASE WHEN mark <> '02' THEN digest_other END AS digest_right
        FROM laid WHERE mark IN ('00', '01', '02') AND (mark = '02' OR digest_left <> digest_other)""",
    "op11_conversation_trie": """
        WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        keyed AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS key, strlen(text) AS size FROM turns),
        own AS (SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, size) AS i FROM keyed),
        convs AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base,
                xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: list_prepend(ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0])))),
                    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM own)),
        parts AS (
            SELECT c.conv_id, 0 AS part, o.i, o.key, o.size FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
            UNION ALL SELECT c.conv_id, 1, o.i, o.key, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
        paths AS (
            SELECT c.conv_id, coalesce(p.keys, []) AS keys, coalesce(p.sizes, []) AS sizes
            FROM convs c LEFT JOIN (SELECT conv_id, list(key ORDER BY part, i) AS keys, list(size ORDER BY part, i) AS sizes FROM parts GROUP BY conv_id) p USING (conv_id)),
        members AS (
            SELECT conv_id, d AS depth, array_to_string(keys[1:d], '') AS node, array_to_string(keys[1:d - 1], '') AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(keys) AS ends
            FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM paths)),
        nodes AS (
            SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
                sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM members GROUP BY node, depth),
        families AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        counted AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON f.up = n.node AND f.depth = n.depth),
        sums AS (
            SELECT m.node, m.depth, sum(c.saved) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
            FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY m.node, m.depth)
        SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
        FROM counted c JOIN sums s ON s.node = c.node AND s.depth = c.depth LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.up AND p.depth = c.depth - 1""",
    "op12_fill_in_middle": """
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
        numbers AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM drawn),
        cuts AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers),
        cut AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut""",
    "op13_line_dedup": """
        WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        split AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
        keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
        held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -1)) > 1),
        judged AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.first AS lost FROM keyed k LEFT JOIN held h ON h.key = k.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM judged GROUP BY row""",
}
