"""Queries of the training-data operators over the driver tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm._common import table


def op1_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm import quality

    docs, top = table(spark, sf_dir, "documents"), 2
    model = quality.fit(docs, quality.document_grades(table(spark, sf_dir, "labels")), top, marking=True)
    return quality.selected(quality.score(docs, model, top), top)


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.revisit import page_captures, resolve

    found = resolve(page_captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op7_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_randomised_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.token_counts import length_histogram, limit_curve

    return limit_curve(length_histogram(table(spark, sf_dir, "documents")))


def op5_van_der_corput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"))


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op8_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_minimax_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op12_partition_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_harmonic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binloom.llm.periodic import digests, periodic_runs, repeating

    return digests(periodic_runs(repeating(table(spark, sf_dir, "documents"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_cumulative_link, op2_chunk_recipes, op3_randomised_lexicons, op4_length_histogram, op5_van_der_corput, op6_revisit_resolution, op7_min_max_hashing, op8_composite_density, op9_linear_grouping, op10_perspective_rotation, op11_minimax_partition, op12_partition_refinement, op13_harmonic_grid)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chunk_recipes": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op6_revisit_resolution": r"""
            WITH named AS (
                SELECT page_id AS p, md5(coalesce(html, '')) AS digest, coalesce(html, '') AS body,
                       regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?', '') AS bare
                FROM pages),
            keyed AS (
                SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)?$', '')
                          || regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '/$', '') AS url_key FROM named),
            full_ AS (SELECT url_key, 2 * p AS ts, p AS source, digest AS was, p % 28 AS was_day, strlen(body) AS size FROM keyed),
            later AS (SELECT url_key, 2 * p + 1 + 2 * ((p * 7919) % 5000) AS ts, p, digest, p % 28 AS day FROM keyed),
            met AS (SELECT later.*, source, was, was_day, size FROM later ASOF LEFT JOIN full_ ON later.url_key = full_.url_key AND later.ts > full_.ts),
            judged AS (
                SELECT *, CASE WHEN source IS NULL THEN 'missing' WHEN p % 11 = 0 THEN 'unverified'
                               WHEN CASE WHEN p % 7 = 0 THEN day = was_day ELSE digest = was END THEN 'resolved' ELSE 'mismatch' END AS status FROM met)
            SELECT 2 * p + 1 AS record_id, url_key, ts, 2 * source AS source_id, status, CASE WHEN status = 'resolved' THEN was END AS payload_digest,
                   CASE WHEN status = 'resolved' THEN 'content-length: ' || size || chr(10) || 'content-type: text/html'
                        ELSE 'connection: close' || chr(10) || 'content-length: 0' END
                   || CASE WHEN p % 7 <> 0 AND p % 11 <> 0 THEN chr(10) || 'etag: ' || CASE WHEN p % 5 = 0 THEN 'W/' ELSE '' END || '"' || digest || '"'
                           WHEN status = 'resolved' THEN chr(10) || 'etag: "' || was || '"' ELSE '' END
                   || CASE WHEN p % 11 <> 0 THEN chr(10) || 'last-modified: day ' || day ELSE '' END || chr(10) || 'x-cache: hit' AS headers
            FROM judged""",
        "op7_min_max_hashing": """
            WITH RECURSIVE words AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
                FROM documents),
            shingles AS (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
            sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
            links AS (
                SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
                JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
                GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
            reach AS (
                SELECT doc_id AS a, doc_id AS b FROM documents
                UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
            SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
            FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
            JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id""",
        # a node is a list of turns; crc32 goes bit by bit over the id's digits
        "op12_partition_refinement": r"""
            WITH ids AS (
                SELECT conv_id AS c, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                           lambda d: [ascii(d)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
                           lambda r, e: xor(xor(r, e) >> 1, 3988292384::UBIGINT * (xor(r, e) & 1::UBIGINT))), 4294967295::UBIGINT) % 4 AS h
                FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
            turns AS (
                SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p,
                       {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t FROM conversations),
            placed AS (
                SELECT c, p - 4 AS p, t FROM (SELECT ids.c, turns.p, turns.t FROM ids JOIN turns ON turns.c = ids.c - ids.c % 20 AND turns.p < ids.h)
                UNION ALL SELECT c, p, t FROM turns JOIN ids USING (c) WHERE p >= h),
            lists AS (SELECT ids.c, coalesce(list(t ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS l FROM ids LEFT JOIN placed USING (c) GROUP BY ids.c),
            members AS (SELECT c, len(l) AS n, d, l[1:d] AS node FROM (SELECT c, l, unnest(generate_series(0, len(l))) AS d FROM lists)),
            nodes AS (
                SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
                FROM members GROUP BY node, d),
            links AS (SELECT a.d, a.conv_id, a.n_convs, a.ends_sha256, a.node, p.conv_id AS parent_conv_id FROM nodes a LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.node = a.node[1:a.d - 1]),
            children AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM links WHERE d > 0 GROUP BY d, parent_conv_id),
            counted AS (
                SELECT links.*, coalesce(n_children, 0) AS n_children,
                       (n_convs - 1) * CASE WHEN links.d = 0 THEN 0 ELSE len(regexp_extract_all(node[links.d].x, '[^\x20\x09-\x0D]+')) END AS saved
                FROM links LEFT JOIN children USING (d, conv_id))
            SELECT a.conv_id, a.d AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children)::BIGINT AS n_children,
                   count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
            FROM counted a JOIN counted b ON b.d >= a.d AND b.node[1:a.d] = a.node GROUP BY a.conv_id, a.d""",
        "op10_perspective_rotation": r"""
            WITH turns AS (
                SELECT conv_id, turn, coalesce(role, '') AS raw, coalesce(role, '') = 'system' AS is_system,
                       regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1|>', 'g') AS text
                FROM conversations),
            based AS (
                SELECT DISTINCT conv_id, raw, regexp_replace(coalesce(nullif(raw, ''), 'unknown'), '[^A-Za-z0-9_-]', '_', 'g') AS base
                FROM turns WHERE NOT is_system),
            speakers AS (
                SELECT conv_id, raw, base || CASE WHEN n > 1 THEN '.' || n ELSE '' END AS name
                FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY raw) AS n FROM based)),
            views AS (
                SELECT conv_id, raw AS viewer, name AS perspective FROM speakers
                UNION ALL SELECT DISTINCT conv_id, NULL, NULL FROM turns t
                WHERE NOT EXISTS (SELECT 1 FROM speakers s WHERE s.conv_id IS NOT DISTINCT FROM t.conv_id)),
            seen AS (
                SELECT t.*, v.viewer, v.perspective, s.name AS spoken, coalesce(NOT is_system AND t.raw = v.viewer, false) AS mask
                FROM turns t JOIN views v ON v.conv_id IS NOT DISTINCT FROM t.conv_id
                LEFT JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.raw = t.raw),
            shown AS (
                SELECT *, CASE WHEN is_system THEN 'system' WHEN mask THEN 'assistant' ELSE 'user' END AS role,
                       CASE WHEN NOT is_system AND NOT mask THEN spoken END AS name FROM seen),
            full_turns AS (
                SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM shown)
            SELECT conv_id, perspective, turn, row_number() OVER place - 1 AS seq, role, name, rendered, mask,
                   (sum(length(rendered)) OVER place - length(rendered))::BIGINT AS start, (sum(length(rendered)) OVER place)::BIGINT AS stop
            FROM full_turns
            WINDOW place AS (PARTITION BY conv_id, viewer ORDER BY turn NULLS LAST, raw, text ROWS UNBOUNDED PRECEDING)""",
    }
