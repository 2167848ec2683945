"""DuckDB SQL for the catalog's queries: the same results from other means."""

from __future__ import annotations

from groundline.plans import prompts

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + strip("s") + "), lambda s: s <> '')"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return SENTENCES.format(x)


def words(x: str) -> str:
    return WORDS.format(x)


def level(s: str) -> str:
    return f"CASE WHEN {s} >= 0.8 THEN 'high' WHEN {s} >= 0.5 THEN 'medium' WHEN {s} >= 0.3 THEN 'low' ELSE 'none' END"


TRIPLES = """
    t AS (
        SELECT c_name s, CASE c_custkey % 3 WHEN 0 THEN 'located in' WHEN 1 THEN 'Based In' ELSE 'registered in' END p, n_name o, 'customer' f, CAST(c_custkey AS INT) i, c_custkey % 3 vid FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'located in' WHEN 1 THEN 'Based In' ELSE 'registered in' END, n_name, 'supplier', CAST(s_suppkey AS INT), s_suppkey % 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'part of', r_name, 'nation', n_nationkey, 3 FROM nation JOIN region ON n_regionkey = r_regionkey
    ),
    em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) nv FROM embeddings),
    e AS (SELECT lower(s) sn, lower(o) dn, s, o, p, s || ' ' || p || ' ' || o ct, f, i, v, nv FROM t JOIN em ON vid = vec_id)
"""
COSINE = "list_dot_product({0}.v, e.v) / (({0}.nv + 1e-8) * (e.nv + 1e-8))"
CLAIMS = """
    c AS (
        SELECT c_custkey AS claim_id, c_name || ' is somewhere' AS claim, CASE WHEN k < 4 THEN '  ' || upper(c_name) || ' ' END AS subject,
               CASE k WHEN 0 THEN upper(own) WHEN 1 THEN 'sits in' WHEN 2 THEN 'far from' WHEN 3 THEN own END AS predicate, CASE WHEN k = 3 THEN 'NOWHERE' WHEN k < 3 THEN n_name END AS obj, v, nv
        FROM (SELECT *, c_custkey % 5 k, CASE c_custkey % 3 WHEN 0 THEN 'located in' WHEN 1 THEN 'Based In' ELSE 'registered in' END own FROM customer JOIN nation ON c_nationkey = n_nationkey)
        JOIN em ON vec_id = CASE WHEN k = 1 THEN c_custkey % 3 ELSE 10 END
    ),
    x AS (SELECT claim_id, arg_min(struct_pack(predicate := e.p, chunk_text := ct, source_file := f, chunk_index := i), struct_pack(f := f, i := i, p := e.p)) hit
          FROM c JOIN e ON lower(trim(c.subject)) = sn AND lower(c.obj) = dn AND lower(c.predicate) = lower(e.p) GROUP BY claim_id),
    m AS (SELECT claim_id, round({cos}, 6) similarity, e.p AS predicate, ct AS chunk_text, f AS source_file, i AS chunk_index, row_number() OVER (PARTITION BY claim_id ORDER BY round({cos}, 12) DESC, f, i, e.p, sn, dn) AS rank
          FROM c JOIN e ON lower(trim(c.subject)) = sn AND lower(c.obj) = dn)
""".format(cos=COSINE.format("c"))
FITTED = """
    pooled AS (SELECT q.spec_id, q.v AS v, q.nv AS nv, e.s, e.p, e.o, e.ct, e.f, e.i, e.v ev, e.nv env, row_number() OVER (PARTITION BY q.spec_id ORDER BY e.f, e.i, e.p, e.sn, e.dn) place
               FROM q JOIN e ON (q.qs IS NULL OR q.qs = e.sn) AND (q.qo IS NULL OR q.qo = e.dn)),
    scored AS (SELECT *, CASE WHEN v IS NULL THEN 0.0 ELSE list_dot_product(v, ev) / ((nv + 1e-8) * (env + 1e-8)) END sim FROM pooled WHERE place <= 200),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY round(sim, 12) DESC, place) AS rank FROM scored)
"""
PARTIAL = "SELECT spec_id, s AS subject, p AS predicate, o AS obj, ct AS chunk_text, f AS source_file, i AS chunk_index, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5"
PAIRS = """
    u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8)) w FROM embeddings),
    pairs AS (SELECT a.vec_id a, b.vec_id b, round(list_dot_product(a.w, b.w), 6) similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.w, b.w) >= 0.4)
"""
LABELS = """
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.m FROM reach JOIN links ON links.a = reach.n WHERE reach.m < links.b),
    labels AS (SELECT n AS vec_id, min(m) AS label FROM reach GROUP BY n),
    names AS (SELECT vec_id, 'Name' || substr('abcdefg', 1, CAST(vec_id % 7 AS INT)) || vec_id AS name FROM embeddings),
    members AS (SELECT label, lower(name) nn, name, count(*) OVER (PARTITION BY label) size, first_value(lower(name)) OVER (PARTITION BY label ORDER BY length(name) DESC, lower(name)) canonical FROM labels JOIN names USING (vec_id)),
    canon AS (SELECT nn, canonical FROM members WHERE size > 1)
"""
LCS = """
    list_reduce(list_transform(a, lambda w: struct_pack(w := w, r := [0]::int[])),
        lambda p, x: struct_pack(w := '', r := list_reduce(list_transform(range(1, len(b) + 1), lambda j: struct_pack(j := j, v := [0]::int[])),
            lambda q, y: struct_pack(j := y.j, v := q.v || [CASE WHEN b[y.j] = x.w THEN coalesce(p.r[y.j], 0) + 1 ELSE greatest(coalesce(p.r[y.j + 1], 0), q.v[-1]) END]),
            struct_pack(j := 0::bigint, v := [0]::int[])).v),
        struct_pack(w := '', r := [0]::int[])).r[-1]
"""
RUNS = f"""
    runs AS (SELECT conv_id run_id, string_agg(text, ' ' ORDER BY turn) response FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    facts AS (SELECT run_id, CAST(n - 1 AS INT) fact_idx, fact FROM (SELECT run_id, list_filter({sentences('response')}, lambda s: len({words('s')}) >= 3) fs FROM runs), unnest(fs) WITH ORDINALITY z(fact, n)),
    evidence AS (
        SELECT conv_id run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS INT) ev_idx, sentence, role AS source, CAST(turn AS INT) chunk_index, text AS chunk_text
        FROM (SELECT *, {sentences('text')} ss FROM conversations WHERE role <> 'assistant'), unnest(ss) WITH ORDINALITY z(sentence, n)
    ),
    ft AS (SELECT *, regexp_extract_all(lower(fact), '[a-z0-9]+') b FROM facts),
    et AS (SELECT *, regexp_extract_all(lower(sentence), '[a-z0-9]+') a FROM evidence),
    met AS (SELECT run_id, fact_idx, ev_idx, a, b, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {LCS} END l,
                   CASE WHEN lower(fact) = lower(sentence) THEN 1.0 WHEN contains(lower(fact), lower(sentence)) OR contains(lower(sentence), lower(fact)) THEN 0.8 ELSE 0.0 END::DOUBLE em FROM ft JOIN et USING (run_id)),
    cells AS (SELECT run_id, fact_idx, ev_idx, CASE WHEN l = 0 THEN 0.0 ELSE 2 * (l / len(b)) * (l / len(a)) / (l / len(b) + l / len(a)) END::DOUBLE rl, em FROM met)
"""

ORACLE_SQL: dict[str, str] = {
    "word_chunks": f"""
        SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(list_slice(w, i * 150 + 1, i * 150 + 200), ' ') AS text
        FROM (SELECT doc_id, {words('text')} w FROM documents), unnest(range(0, CAST(ceil(len(w) / 150.0) AS BIGINT))) z(i)
    """,
    "char_chunks": f"""
        SELECT doc_id, CAST(n - 1 AS INT) AS chunk_index, c AS text, md5(doc_id || '_' || (n - 1)) AS chunk_id, doc_id || '_chunk' || (n - 1) AS source_id
        FROM (SELECT doc_id, list_filter(list_transform(range(0, length(text), 450), lambda i: {strip('substr(text, i + 1, 500)')}), lambda c: c <> '') cs FROM documents), unnest(cs) WITH ORDINALITY z(c, n)
    """,
    "sentence_rows": f"SELECT doc_id, CAST(n - 1 AS INT) AS pos, s AS sentence FROM documents, unnest({sentences('text')}) WITH ORDINALITY z(s, n)",
    "fact_rows": f"SELECT doc_id, CAST(n - 1 AS INT) AS pos, s AS fact FROM documents, unnest(list_filter({sentences('text')}, lambda s: len({words('s')}) >= 3)) WITH ORDINALITY z(s, n)",
    "row_render": """
        SELECT p_partkey, text, CAST(length(text) AS INT) AS n FROM (
            SELECT p_partkey, trim('Title: ' || p_name || '.' || CASE WHEN b <> '' AND b <> p_name THEN ' Other Title: ' || b || '.' ELSE '' END
                || CASE WHEN t <> '' OR z <> '' THEN ' ' || concat_ws('. ', CASE WHEN t <> '' THEN 'Type: ' || t END, CASE WHEN z <> '' THEN 'Size: ' || z END) || '.' ELSE '' END
                || CASE WHEN b <> '' THEN ' Brand: ' || b || '.' ELSE '' END || ' Synopsis: ' || p_name || CASE WHEN t <> '' THEN ' Tags: ' || t || '.' ELSE '' END) AS text
            FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END b, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END t, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END z FROM part))
        WHERE length(text) >= 20
    """,
    "dataset_articles": "SELECT 'Doc_' || (row_number() OVER (ORDER BY item_id) - 1) AS title, text FROM benchmark WHERE text <> ''",
    "file_dispatch": "SELECT doc_id, source || '/f' || doc_id || x AS path, CASE x WHEN '.PDF' THEN 'pages' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' ELSE 'unsupported' END AS kind FROM (SELECT *, ['.txt', '.PDF', '.md', '.docx', ''][CAST(doc_id % 5 + 1 AS INT)] x FROM documents)",
    "question_route": f"""
        SELECT conv_id, turn, CAST(length(s) AS INT) AS n, (s LIKE '%?' OR regexp_matches(lower(s), '^(chi|cosa|che cosa|che|quale|quali|quando|dove|come|perché|perche|quanto|who|what|where|when|why|how|which) ')) AS is_question
        FROM (SELECT conv_id, turn, {strip("CASE turn % 4 WHEN 0 THEN 'Who ' || text WHEN 1 THEN text || '? ' WHEN 2 THEN '  CHI ' || text ELSE text END")} s FROM conversations)
    """,
    "slot_parse": """
        SELECT c_custkey, CASE k WHEN 2 THEN c_name END AS subject, CASE k WHEN 0 THEN 'located in' WHEN 2 THEN 'based in' END AS predicate, CASE WHEN k IN (0, 2) THEN n_name END AS obj,
               CAST(CASE k WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS INT) AS known, k = 2 AS complete, CASE k WHEN 0 THEN 'subject' END AS unknown
        FROM (SELECT *, c_custkey % 4 k FROM customer JOIN nation ON c_nationkey = n_nationkey)
    """,
    "markup_triples": """
        SELECT 'customer' AS source_file, c_custkey AS chunk_index, CAST(b AS INT) AS beam, CAST(q AS INT) AS pos, s AS subject, p AS predicate, o AS object FROM (
            SELECT c_custkey, 0 b, 0 q, c_name s, 'located in' p, n_name o FROM customer JOIN nation ON c_nationkey = n_nationkey
            UNION ALL SELECT c_custkey, 0, 1, c_name, 'works in', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
            UNION ALL SELECT c_custkey, 1, 1, n_name, 'part of', 'region ' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    """,
    "resume_prompts": """
        SELECT conv_id, string_agg('[' || n || '] (Source: ' || role || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS sources
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n FROM conversations WHERE role <> 'assistant') GROUP BY conv_id
    """,
    "entity_upsert": f"""
        WITH {TRIPLES}, known AS (SELECT lower(n_name) normalized_name, 'Land ' || n_name AS name FROM nation),
        named AS (SELECT s AS name, f, i, p, s, o, 0 r FROM e UNION ALL SELECT o, f, i, p, s, o, 1 FROM e),
        fresh AS (SELECT lower(name) normalized_name, arg_min(name, struct_pack(f := f, i := i, p := p, s := s, o := o, r := r)) AS name FROM named GROUP BY 1)
        SELECT * FROM known UNION ALL SELECT * FROM fresh WHERE normalized_name NOT IN (SELECT normalized_name FROM known)
    """,
    "edge_append": f"WITH {TRIPLES} SELECT sn AS src_norm, dn AS dst_norm, p AS predicate, ct AS chunk_text, f AS source_file, i AS chunk_index, CAST(len(v) AS INT) AS n_dims FROM e",
    "edge_replace": f"WITH {TRIPLES} SELECT f AS source_file, count(*) AS n, min(CASE WHEN f = 'supplier' THEN upper(ct) ELSE ct END) AS first_chunk FROM e GROUP BY f",
    "graph_stats": f"WITH {TRIPLES} SELECT (SELECT count(*) FROM (SELECT sn FROM e UNION SELECT dn FROM e)) AS nodes, (SELECT count(*) FROM e) AS relations",
    "doc_catalog": f"""
        WITH n AS (SELECT source AS name, lang, CAST(ceil(len({words('text')}) / 150.0) AS BIGINT) chunks, len({sentences('text')}) triples FROM documents),
        a AS (SELECT name, CAST(sum(chunks) AS BIGINT) num_chunks, CAST(sum(triples) AS BIGINT) num_triples, 'done' AS status FROM n GROUP BY name),
        b AS (SELECT name, CAST(sum(chunks) AS BIGINT) num_chunks, CAST(sum(triples) AS BIGINT) num_triples, 'error' AS status FROM n WHERE lang = 'es' GROUP BY name)
        SELECT * FROM b UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM b)
    """,
    "ingest_totals": f"""
        SELECT CAST(doc_id AS VARCHAR) AS source_file, n AS num_chunks, t AS num_triples, CAST(ceil(n / 16.0) AS BIGINT) AS num_batches, CASE WHEN lang = 'fr' THEN 'error' ELSE 'done' END AS status
        FROM (SELECT doc_id, lang, CAST(ceil(len({words('text')}) / 150.0) AS BIGINT) n, len({sentences('text')}) t FROM documents) WHERE n > 0
    """,
    "vector_upsert": f"""
        SELECT md5(doc_id || '_' || (n - 1)) AS id, CASE WHEN md5(doc_id || '_' || (n - 1)) < '8' THEN 'new ' || c ELSE c END AS document, CAST(CASE WHEN md5(doc_id || '_' || (n - 1)) < '8' THEN 2 ELSE 0 END AS INT) AS version
        FROM (SELECT doc_id, list_filter(list_transform(range(0, length(text), 450), lambda i: {strip('substr(text, i + 1, 500)')}), lambda c: c <> '') cs FROM documents), unnest(cs) WITH ORDINALITY z(c, n)
    """,
    "attr_exact": f"WITH {TRIPLES}, {CLAIMS} SELECT claim_id, hit.predicate AS predicate, hit.chunk_text AS chunk_text, hit.source_file AS source_file, hit.chunk_index AS chunk_index FROM x",
    "attr_semantic": f"WITH {TRIPLES}, {CLAIMS} SELECT claim_id, similarity, predicate, chunk_text, source_file, chunk_index, CAST(rank AS INT) AS rank FROM m WHERE rank <= 5",
    "attr_cascade": f"""
        WITH {TRIPLES}, {CLAIMS}
        SELECT c.claim_id, c.claim, coalesce(c.subject, '') AS subject, coalesce(c.predicate, '') AS predicate, coalesce(c.obj, '') AS obj,
               CASE WHEN c.subject IS NULL OR c.predicate IS NULL OR c.obj IS NULL THEN 'parse_error' WHEN hit IS NOT NULL THEN 'exact' WHEN m.similarity >= 0.75 THEN 'semantic' ELSE 'not_found' END AS match_type,
               CASE WHEN hit IS NOT NULL THEN 1.0 ELSE coalesce(m.similarity, 0.0) END AS similarity,
               coalesce(hit.chunk_text, CASE WHEN m.similarity >= 0.75 THEN m.chunk_text END, '') AS source_chunk, coalesce(hit.source_file, CASE WHEN m.similarity >= 0.75 THEN m.source_file END, '') AS source_file,
               coalesce(hit.chunk_index, CASE WHEN m.similarity >= 0.75 THEN m.chunk_index END, 0) AS chunk_index, coalesce(hit IS NOT NULL OR m.similarity >= 0.75, false) AS verified, false AS is_question, '' AS answer_field
        FROM c LEFT JOIN x USING (claim_id) LEFT JOIN m ON m.claim_id = c.claim_id AND m.rank = 1 AND x.claim_id IS NULL
    """,
    "partial_subject": f"WITH {TRIPLES}, q AS (SELECT n_nationkey spec_id, NULL qs, lower(n_name) qo, v, nv FROM nation, em WHERE vec_id = 0), {FITTED} {PARTIAL}",
    "partial_object": f"WITH {TRIPLES}, q AS (SELECT c_custkey spec_id, lower(c_name) qs, NULL qo, v, nv FROM customer, em WHERE vec_id = 1), {FITTED} {PARTIAL}",
    "partial_both": f"WITH {TRIPLES}, q AS (SELECT s_suppkey spec_id, lower(s_name) qs, lower(n_name) qo, NULL::DOUBLE[] v, NULL::DOUBLE nv FROM supplier JOIN nation ON s_nationkey = n_nationkey), {FITTED} {PARTIAL}",
    "partial_predicate": f"WITH {TRIPLES}, q AS (SELECT 0::BIGINT spec_id, NULL::VARCHAR qs, NULL::VARCHAR qo, v, nv FROM em WHERE vec_id = 3), {FITTED} {PARTIAL}",
    "attr_questions": f"""
        WITH {TRIPLES}, a AS (SELECT c_custkey spec_id, 'where is ' || c_name AS claim, k, CASE WHEN k < 3 THEN c_name END subject, CASE WHEN k IN (0, 2) THEN 'located in' END predicate, CASE k WHEN 1 THEN n_name WHEN 2 THEN 'NOWHERE' END obj
                              FROM (SELECT *, c_custkey % 4 k FROM customer JOIN nation ON c_nationkey = n_nationkey)),
        q AS (SELECT spec_id, lower(subject) qs, lower(obj) qo, CASE WHEN predicate IS NOT NULL THEN em.v END v, CASE WHEN predicate IS NOT NULL THEN em.nv END nv FROM a, em WHERE vec_id = 0 AND k < 3), {FITTED}
        SELECT a.spec_id AS claim_id, a.claim, coalesce(r.s, a.subject, '') AS subject, coalesce(r.p, a.predicate, '') AS predicate, coalesce(r.o, a.obj, '') AS obj,
               CASE WHEN k = 3 THEN 'parse_error' WHEN r.spec_id IS NOT NULL AND (a.predicate IS NULL OR sim >= 0.75) THEN 'semantic' ELSE 'not_found' END AS match_type,
               round(CASE WHEN r.spec_id IS NULL THEN 0.0 WHEN a.predicate IS NULL THEN 1.0 ELSE sim END, 6) AS similarity, coalesce(ct, '') AS source_chunk, coalesce(f, '') AS source_file, coalesce(i, 0) AS chunk_index,
               r.spec_id IS NOT NULL AND (a.predicate IS NULL OR sim >= 0.75) AS verified, true AS is_question, CASE k WHEN 0 THEN 'object' WHEN 1 THEN 'predicate' ELSE '' END AS answer_field
        FROM a LEFT JOIN ranked r ON r.spec_id = a.spec_id AND r.rank = 1
    """,
    "knn_topk": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings),
        d AS (SELECT q.vec_id query_id, e.vec_id vector_id, 1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS distance FROM e q, e WHERE q.vec_id % 100 = 0)
        SELECT query_id, vector_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vector_id) AS rank FROM d) WHERE rank <= 5
    """,
    "hybrid_rerank": f"""
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, text FROM embeddings JOIN documents ON vec_id = doc_id),
        d AS (SELECT q.vec_id query_id, e.vec_id vector_id, q.text qt, e.text dt, 1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS distance FROM e q, e WHERE q.vec_id % 100 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vector_id) n FROM d) WHERE n <= 50),
        h AS (SELECT query_id, vector_id, distance, CAST(len(list_intersect(list_distinct(list_filter({words('lower(qt)')}, lambda w: length(w) > 3)), list_distinct({words('lower(dt)')}))) AS INT) AS hits FROM p),
        s AS (SELECT *, greatest(0.0, 1 - distance) + 0.5 * hits AS score FROM h)
        SELECT query_id, vector_id, round(distance, 6) AS distance, hits, round(score, 6) AS hybrid_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vector_id) AS rank FROM s) WHERE rank <= 5
    """,
    "cluster_pairs": f"WITH {PAIRS} SELECT a, b, similarity FROM pairs",
    "cluster_labels": f"WITH RECURSIVE {PAIRS}, {LABELS} SELECT vec_id, label FROM labels",
    "cluster_canonical": f"WITH RECURSIVE {PAIRS}, {LABELS} SELECT nn AS normalized_name, canonical FROM canon",
    "graph_after_merge": f"""
        WITH RECURSIVE {PAIRS}, {LABELS},
        ring AS (SELECT lower(a.name) s, lower(b.name) d, 'step ' || k AS p FROM (SELECT vec_id, name, unnest([0, 1, 7]) k FROM names) a JOIN names b ON b.vec_id = CASE k WHEN 0 THEN a.vec_id ELSE (a.vec_id * k + 3) % (SELECT count(*) FROM names) END),
        moved AS (SELECT s, d, p, cs.canonical cs, coalesce(cs.canonical, s) ms, coalesce(cd.canonical, d) md FROM ring LEFT JOIN canon cs ON cs.nn = s LEFT JOIN canon cd ON cd.nn = d)
        SELECT ms AS src_norm, md AS dst_norm, p AS predicate FROM moved WHERE NOT (cs IS NOT NULL AND ms = md) OR (s = ms AND d = md)
        UNION ALL SELECT lower(name), '', 'entity' FROM names WHERE lower(name) NOT IN (SELECT nn FROM canon WHERE nn <> canonical)
    """,
    "lexical_cells": f"WITH {RUNS} SELECT run_id, fact_idx, ev_idx, round(rl, 6) AS rouge_l, em AS exact_match, round(greatest(rl, em), 6) AS score FROM cells",
    "support_best": f"""
        WITH {RUNS}, best AS (SELECT run_id, fact_idx, arg_max(struct_pack(ev_idx := ev_idx, s := round(greatest(rl, em), 6), rl := round(rl, 6), em := em), struct_pack(s := round(greatest(rl, em), 6), e := -ev_idx)) b FROM cells GROUP BY 1, 2),
        j AS (SELECT f.run_id, f.fact_idx, fact, coalesce(b.s, 0.0) s, coalesce(b.rl, 0.0) rl, coalesce(b.em, 0.0) em, e.* EXCLUDE (run_id) FROM facts f LEFT JOIN best USING (run_id, fact_idx) LEFT JOIN evidence e ON e.run_id = f.run_id AND e.ev_idx = b.ev_idx)
        SELECT run_id, fact_idx, fact, s AS support_score, coalesce(sentence, '') AS best_evidence, coalesce(source, '') AS best_evidence_source, coalesce(chunk_text, '') AS source_chunk_text,
               coalesce(source || '_chunk' || chunk_index, '') AS source_id, rl AS rouge_l, em AS exact_match, {level('s')} AS level FROM j
    """,
    "support_overall": f"""
        WITH {RUNS}, tops AS (SELECT f.run_id, f.fact_idx, coalesce(max(greatest(rl, em)), 0.0) s FROM facts f LEFT JOIN cells USING (run_id, fact_idx) GROUP BY 1, 2),
        o AS (SELECT runs.run_id, round(coalesce(avg(s), 0.0), 5) s, count(fact_idx) n FROM runs LEFT JOIN tops USING (run_id) GROUP BY 1)
        SELECT run_id, s AS overall_score, n AS n_facts, {level('s')} AS level FROM o
    """,
    "html_levels": f"""
        SELECT l_orderkey, l_linenumber, lv AS level, printf('%.2f', greatest(0.15, least(1.0, s))) AS alpha, CAST(CAST(round(s * 100) AS BIGINT) AS VARCHAR) AS percent,
               'rgba(' || CASE lv WHEN 'high' THEN '16, 185, 129' WHEN 'medium' THEN '245, 158, 11' WHEN 'low' THEN '249, 115, 22' ELSE '239, 68, 68' END || ', ' || printf('%.2f', greatest(0.15, least(1.0, s))) || ')' AS background,
               CASE lv WHEN 'high' THEN '#10b981' WHEN 'medium' THEN '#f59e0b' WHEN 'low' THEN '#f97316' ELSE '#ef4444' END AS border
        FROM (SELECT *, {level('s')} lv FROM (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 4) s FROM lineitem))
    """,
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;') AS escaped, CASE WHEN length(html) > 400 THEN substr(html, 1, 400) || '...' ELSE html END AS shown FROM pages",
    "source_accumulate": """
        SELECT user_id AS run_id, event_type AS source_id, CAST(event_id % 3 + 1 AS INT) AS iteration, event_id AS rank, value
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3, event_id) n FROM events) WHERE n = 1
    """,
    "retrieval_counters": "SELECT user_id AS run_id, CAST(max(event_id % 3 + 1) AS INT) AS total_iterations, count(*) AS n_retrieved FROM events GROUP BY 1",
    "stop_tags": f"""
        WITH g AS (SELECT CAST(conv_id AS VARCHAR) gen_id, string_agg(CASE role WHEN 'user' THEN text || ' <CER' WHEN 'assistant' THEN 'CA:  look up ' || turn || ' > rest' ELSE text END, '' ORDER BY turn) s FROM conversations GROUP BY 1)
        SELECT gen_id, CASE WHEN contains(s, '<CERCA:') THEN {strip("string_split(s, '<CERCA:')[1]")} ELSE s END AS text,
               CASE WHEN contains(s, '<CERCA:') AND contains(substr(s, strpos(s, '<CERCA:') + 7), '>') THEN {strip("string_split(substr(s, strpos(s, '<CERCA:') + 7), '>')[1]")} END AS query,
               contains(s, '<CERCA:') AND contains(substr(s, strpos(s, '<CERCA:') + 7), '>') AS stopped FROM g
    """,
}


#: Characters of the first prompt beside its question.
INITIAL = len(f"{prompts.BEGIN}{prompts.TURN}system{prompts.TURN_END}{prompts.SYSTEM}{prompts.CLOSE}{prompts.TURN}user{prompts.TURN_END}{prompts.CLOSE}{prompts.TURN}assistant{prompts.TURN_END}")
QUOTED = prompts.QUESTION.replace("'", "''")
READ = "SELECT c_custkey, c_custkey % 3 k, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"

ORACLE_SQL |= {
    "question_prompts": f"SELECT conv_id, turn, '{QUOTED}' || replace(text, '\"', '''') || '\"' || chr(10) || 'JSON:' AS prompt, CAST({INITIAL} + length(text) AS INT) AS n_initial FROM conversations WHERE role = 'user'",
    "attr_mixed": f"""
        SELECT is_question, match_type, verified, answer_field, count(*) AS n, round(sum(similarity), 6) AS similarity FROM ({ORACLE_SQL["attr_cascade"]}) GROUP BY ALL
        UNION ALL SELECT true, 'semantic', true, '', count(*), CAST(count(*) AS DOUBLE) FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
    "claim_triples": f"SELECT c_custkey AS claim_id, c_name || ' lives there' AS claim, CASE WHEN k < 2 THEN c_name END AS subject, CASE WHEN k < 2 THEN 'located in' END AS predicate, CASE WHEN k < 2 THEN n_name END AS obj FROM ({READ})",
    "claim_verdicts": f"""
        SELECT c_custkey AS claim_id, c_name || ' lives there' AS claim, CASE WHEN k < 2 THEN c_name ELSE '' END AS subject, CASE WHEN k < 2 THEN 'located in' ELSE '' END AS predicate, CASE WHEN k < 2 THEN n_name ELSE '' END AS obj,
               ['exact', 'not_found', 'parse_error'][CAST(k + 1 AS INT)] AS match_type, CASE k WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity, CASE k WHEN 0 THEN c_name || ' located in ' || n_name ELSE '' END AS source_chunk,
               CASE k WHEN 0 THEN 'customer' ELSE '' END AS source_file, CAST(CASE k WHEN 0 THEN c_custkey ELSE 0 END AS INT) AS chunk_index, k = 0 AS verified, false AS is_question, '' AS answer_field FROM ({READ})
    """,
    "doc_newest": "SELECT name, num_chunks, CAST(row_number() OVER (ORDER BY n * 7919 % 1000 DESC, name) AS INT) AS place FROM (SELECT source AS name, count(*) AS num_chunks, min(doc_id) n FROM documents GROUP BY 1)",
    "entity_scan": """
        SELECT lower(name) AS normalized_name, name, n AS n_edges FROM (SELECT n_name AS name, 1::BIGINT n FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION SELECT s_name, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT r_name, 0 FROM region JOIN nation ON n_regionkey = r_regionkey)
    """,
    "ingest_status": """
        SELECT 'nation' AS name, 25::BIGINT AS num_chunks, count(*) AS num_triples, 'done' AS status FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'supplier', 7, count(*), 'done' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'customer', 3, 0, 'error'
    """,
    "graph_cleared": f"""
        WITH {TRIPLES} SELECT 'before' AS state, (SELECT count(*) FROM (SELECT sn FROM e WHERE f <> 'customer' UNION SELECT dn FROM e WHERE f <> 'customer')) AS nodes, (SELECT count(*) FROM e WHERE f <> 'customer') AS relations
        UNION ALL SELECT 'after', 0, 0
    """,
    "ingest_streamed": f"WITH {TRIPLES} SELECT sn AS src_norm, dn AS dst_norm, p AS predicate, s || ' -- ' || p || ' -- ' || o AS chunk_text, f AS source_file, i AS chunk_index FROM e",
    "token_similarity": """
        WITH n AS (SELECT vec_id, vec_id // 4 AS g, CAST(embedding AS DOUBLE[]) v FROM embeddings),
        m AS (SELECT a.g, a.vec_id x, b.vec_id y, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) s FROM n a JOIN n b ON b.g = a.g + 1),
        p AS (SELECT g, avg(s) p FROM (SELECT g, x, max(s) s FROM m GROUP BY 1, 2) GROUP BY 1), r AS (SELECT g, avg(s) r FROM (SELECT g, y, max(s) s FROM m GROUP BY 1, 2) GROUP BY 1)
        SELECT g, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p JOIN r USING (g)
    """,
    "support_lists": f"""
        WITH {RUNS}, c AS (SELECT run_id, fact_idx, round(greatest(rl, em), 6) s FROM cells), top AS (SELECT f.run_id, f.fact_idx, coalesce(max(s), 0.0) s FROM facts f LEFT JOIN c USING (run_id, fact_idx) GROUP BY 1, 2),
        fs AS (SELECT run_id, string_agg(fact, '|' ORDER BY fact_idx) x FROM facts GROUP BY 1), es AS (SELECT run_id, string_agg(sentence, '|' ORDER BY ev_idx) x FROM evidence GROUP BY 1)
        SELECT run_id, coalesce(fs.x, '') AS facts, coalesce(es.x, '') AS sentences, CAST(coalesce(n, 0) AS INT) AS n_cells, coalesce(largest, 0.0) AS largest, coalesce(fs.x, '') AS result_facts, round(coalesce(mean, 0.0), 5) AS overall_score
        FROM runs LEFT JOIN fs USING (run_id) LEFT JOIN es USING (run_id) LEFT JOIN (SELECT run_id, count(*) n, max(s) largest FROM c GROUP BY 1) USING (run_id) LEFT JOIN (SELECT run_id, avg(s) mean FROM top GROUP BY 1) USING (run_id)
    """,
}
