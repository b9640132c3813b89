"""SQL that DuckDB runs on the same tables, where SQL can express the operator."""



def _clusters_sql() -> str:
    """The five rounds one after the other."""
    steps = [
        r"""vectors AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        """first AS (
            SELECT v, sha256('2:' || vec_id) AS h FROM vectors ORDER BY h LIMIT 40
        )""",
        "centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c FROM first)",
    ]
    for i in range(6):
        steps.append(
            f"""assigned{i} AS MATERIALIZED (
            SELECT vec_id, v, cluster, distance FROM (
                SELECT vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda k: (v[k] - c[k]) * (v[k] - c[k])))::BIGINT AS distance
                FROM vectors, centroids{i}
            ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
        )"""
        )
        if i < 5:
            steps.append(
                f"""means{i} AS (
            SELECT cluster, list(m ORDER BY k) AS c FROM (
                SELECT cluster, k, floor(sum(x) / count(*))::BIGINT AS m
                FROM (SELECT cluster, unnest(range(1, 65)) AS k, unnest(v) AS x FROM assigned{i}) GROUP BY cluster, k
            ) GROUP BY cluster
        )"""
            )
            steps.append(
                f"""centroids{i + 1} AS MATERIALIZED (
            SELECT o.cluster, coalesce(m.c, o.c) AS c FROM centroids{i} AS o LEFT JOIN means{i} AS m USING (cluster)
        )"""
            )
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, cluster::INTEGER AS cluster, distance,
            (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM assigned5 JOIN centroids5 USING (cluster)
    """


LLM_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), grouped AS (
            SELECT *, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size
            FROM texts WINDOW g AS (PARTITION BY text_sha256)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
    """,
    "op4_benchmark_decontamination": r"""
        WITH lower_case AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), docs AS (
            SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_case
        ), items AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS words
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)
        ), places AS (
            SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS words
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
                  FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ), found AS (
            SELECT doc_id, item_id, n, p FROM places JOIN windows USING (n, words)
        ), hits AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM found) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op6_chat_formatting": r"""
        WITH every AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), escaped AS (
            SELECT *,
                length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g'))
                + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g'))
                + length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>') AS chars
            FROM every
        ), joined AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
                sum(chars)::BIGINT AS formatted_chars
            FROM escaped GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(learned) AS loss_chars,
               sha256(learned) AS loss_sha256, formatted_chars
        FROM joined
    """,
    "op11_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS t
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces
        ), phrases AS (
            SELECT lang, k, w[p : p + k - 1] AS ws
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, range(1, 6) AS lengths(k) WHERE len(w) >= k)
        ), total AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
        ), counts AS (
            SELECT lang, k, ws, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100
        ), cuts AS (
            SELECT c.lang, c.k, c.ws, c.f AS a, l.f AS l, r.f AS r, n, cut,
                (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM counts WHERE k > 1) AS c
            JOIN counts AS l ON l.lang = c.lang AND l.ws = c.ws[1 : cut]
            JOIN counts AS r ON r.lang = c.lang AND r.ws = c.ws[cut + 1 :]
            JOIN total ON total.lang = c.lang
        ), weakest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1
        ), inside AS (
            SELECT lang, ws[p : p + size - 1] AS ws, max(f) AS within
            FROM (SELECT *, unnest(range(1, k - size + 2)) AS p FROM counts, range(2, 5) AS sizes(size) WHERE size < k)
            GROUP BY ALL
        ), left_over AS (
            SELECT weakest.*, array_to_string(ws, ' ') AS phrase
            FROM weakest LEFT JOIN inside USING (lang, ws) WHERE within IS NULL OR within < a
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over
        )
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
    """,
    "op12_centroid_clustering": _clusters_sql(),
    "op13_embedding_near_dedup": r"""
        WITH RECURSIVE given AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v,
                label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
            FROM embeddings
        ), unit AS (
            SELECT vec_id, label, v FROM given WHERE good
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v
            FROM unit AS a JOIN unit AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reached AS (
            SELECT vec_id AS u, vec_id AS v FROM given
            UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u
        ), component AS (
            SELECT u, min(v) AS component_id FROM reached GROUP BY u
        ), counted AS (
            SELECT u, count(*) AS n_links FROM links GROUP BY u
        )
        SELECT given.vec_id, coalesce(n_links, 0) AS n_links, component_id, given.vec_id = component_id AS kept
        FROM given JOIN component ON component.u = given.vec_id LEFT JOIN counted ON counted.u = given.vec_id
    """,
}
