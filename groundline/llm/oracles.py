"""DuckDB SQL for the operators that SQL can express, by plain means: lists of everything, compared with everything they meet."""

from __future__ import annotations

WORD_LIST = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def words(x: str) -> str:
    return WORD_LIST.format(x)


def digits(*parts: str) -> str:
    """The number of the first twelve hex digits of an md5."""
    joined = " || ':' || ".join(parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 12) AS BIGINT)"


#: Every quotient that may win a seat is listed; every block is listed, and met with the documents of its shard.
MIX = f"""
    WITH d AS (SELECT doc_id, source, CAST(len({words("coalesce(text, '')")}) AS BIGINT) size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, count(*) n_docs, row_number() OVER (ORDER BY source NULLS LAST) r FROM d GROUP BY source),
    w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE weight, 2.0::DOUBLE * source_size cap, 1.5::DOUBLE * sum(source_size) OVER () budget FROM s),
    l AS (SELECT *, sum(cap) OVER o - cap capped, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) open FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
    f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) place, (budget - capped) / open <= cap / weight fits FROM l),
    g AS (SELECT *, min(CASE WHEN fits THEN place END) OVER () first FROM f),
    t AS (SELECT a.source, a.source_size, a.n_docs, a.r, least(a.cap, CASE WHEN a.place >= b.place THEN (b.budget - b.capped) * a.weight / b.open ELSE a.cap END) target FROM g a LEFT JOIN g b ON b.place = a.first),
    seats AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) n FROM t),
    won AS (SELECT r, count(*) quota FROM (SELECT r, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r, k) place FROM t, unnest(range(0, CAST(target / 16 + 30 AS BIGINT))) z(k) WHERE target > 0) WHERE place <= (SELECT n FROM seats) GROUP BY r),
    q AS (SELECT t.*, coalesce(quota, 0) source_quota, greatest(1, CAST(ceil(n_docs / 1024.0) AS BIGINT)) n_shards FROM t LEFT JOIN won USING (r)),
    p AS (SELECT d.doc_id, d.source, size, source_size, target, source_quota, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) k, {digits("'17'", "coalesce(CAST(doc_id AS VARCHAR), '')")} % n_shards shard FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
    u AS (SELECT source, shard, CAST(sum(size) AS BIGINT) shard_size, any_value(source_quota) sq FROM p GROUP BY 1, 2),
    v AS (SELECT source, shard // 256 region, sum(shard_size) region_size, any_value(sq) sq FROM u GROUP BY 1, 2),
    vq AS (SELECT source, region, count(*) quota FROM (SELECT source, region, sq, row_number() OVER (PARTITION BY source ORDER BY region_size::DOUBLE / (2 * k + 1) DESC, region, k) place FROM v, unnest(range(0, CAST(2 * region_size // 16 + 30 AS BIGINT))) z(k) WHERE region_size > 0) WHERE place <= sq GROUP BY 1, 2),
    su AS (SELECT source, shard, count(*) quota FROM (SELECT u.source, shard, quota rq, row_number() OVER (PARTITION BY u.source, region ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) place
           FROM u JOIN vq ON vq.source IS NOT DISTINCT FROM u.source AND region = shard // 256, unnest(range(0, 2 * shard_size // 16 + 30)) z(k) WHERE shard_size > 0) WHERE place <= rq GROUP BY 1, 2),
    n AS (SELECT u.*, greatest(1, (shard_size + 15) // 16) n, least(coalesce(quota, 0), 2 * greatest(1, (shard_size + 15) // 16)) owed, {digits("'18'", "coalesce(u.source, '')", "CAST(u.shard AS VARCHAR)")} % greatest(1, (shard_size + 15) // 16) start FROM u LEFT JOIN su ON su.source IS NOT DISTINCT FROM u.source AND su.shard = u.shard),
    blocks AS (SELECT source, shard, b, (b + 1 + start) * (owed % n) // n > (b + start) * (owed % n) // n drawn FROM n, unnest(range(0, n)) z(b)),
    placed AS (SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY k, size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) e FROM p),
    extra AS (SELECT a.doc_id, a.k, a.e, CAST(sum(greatest(0, least(a.e, 16 * b + 16) - greatest(a.e - a.size, 16 * b))) AS BIGINT) x FROM placed a JOIN blocks b ON a.source IS NOT DISTINCT FROM b.source AND a.shard = b.shard AND b.drawn AND 16 * b.b < a.e AND 16 * b.b + 16 > a.e - a.size GROUP BY 1, 2, 3)
    SELECT a.doc_id, a.size, a.source_size, a.target, CAST(owed // n * a.size + coalesce(x, 0) AS BIGINT) AS taken
    FROM placed a JOIN n ON a.source IS NOT DISTINCT FROM n.source AND a.shard = n.shard LEFT JOIN extra x ON x.doc_id IS NOT DISTINCT FROM a.doc_id AND x.e = a.e AND a.size > 0
"""

#: Every window of 50 bytes, as 100 hex digits, with the first document that has it.
REPEATS = """
    WITH d AS (SELECT row_number() OVER () row, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
    w AS (SELECT row, doc_id, n - 1 p, x FROM (SELECT row, doc_id, list_transform(range(0, greatest(0, length(h) // 2 - 49)), lambda p: substr(h, 2 * p + 1, 100)) xs FROM d), unnest(xs) WITH ORDINALITY z(x, n)),
    f AS (SELECT x, min(doc_id) first FROM w GROUP BY x HAVING count(*) > 1),
    g AS (SELECT row, p, p + 50 e FROM w JOIN f USING (x) WHERE coalesce(doc_id > first, first IS NOT NULL)),
    o AS (SELECT *, max(e) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM g),
    i AS (SELECT *, sum(CASE WHEN p <= before THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY p) n FROM o),
    s AS (SELECT row, n, min(p) a, max(e) b FROM i GROUP BY 1, 2),
    k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) last FROM s),
    c AS (SELECT row, sum(b - a) removed, count(*) spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) head, max(b) tail FROM k JOIN d USING (row) GROUP BY row)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
    FROM d LEFT JOIN c USING (row)
"""


def repetition(limits: dict[int, float], line_limit: float, symbol_limit: float) -> str:
    """Every window of each length, counted in its text."""
    lengths = [3, *limits]
    found = ", ".join(f"""
        g{n} AS (SELECT row, i, count(*) OVER (PARTITION BY row, x) c FROM (SELECT row, list_transform(range(1, len(w) - {n - 2}), lambda i: hash(list_slice(w, i, i + {n - 1}))) xs FROM d), unnest(xs) WITH ORDINALITY z(x, i)),
        c{n} AS (SELECT row, count(*) n, sum(l) chars FROM (SELECT DISTINCT row, i + k place FROM g{n}, unnest(range(0, {n})) z(k) WHERE c > 1) JOIN chars USING (row, place) GROUP BY row)""" for n in lengths)
    chars = {n: f"CAST(coalesce(c{n}.chars, 0) AS BIGINT)" for n in limits}
    over = " OR ".join(f"{chars[n]} > {limit} * word_chars" for n, limit in limits.items())
    return f"""
        WITH d AS (SELECT row_number() OVER () row, doc_id, coalesce(text, '') t, {words("coalesce(text, '')")} w FROM documents),
        lines AS (SELECT row, x, n, row_number() OVER (PARTITION BY row, x ORDER BY n) seen FROM d, unnest(string_split(t, chr(10))) WITH ORDINALITY z(x, n) WHERE len({words("x")}) > 0),
        chars AS (SELECT row, place, l FROM (SELECT row, list_transform(w, lambda x: length(x)) ls FROM d), unnest(ls) WITH ORDINALITY z(l, place)),
        dup AS (SELECT row, count(*) n, sum(list_sum(list_transform({words("x")}, lambda y: length(y)))) chars FROM lines WHERE seen > 1 GROUP BY row), {found},
        m AS (SELECT d.row, doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
                     CAST(coalesce(dup.n, 0) AS BIGINT) n_dup_lines, CAST(coalesce(dup.chars, 0) AS BIGINT) dup_line_chars, CAST(coalesce(c3.n, 0) AS BIGINT) n_repeat_words FROM d LEFT JOIN dup USING (row) LEFT JOIN c3 USING (row))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {", ".join(f"{c} AS dup_chars_{n}" for n, c in chars.items())},
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR dup_line_chars > {line_limit} * word_chars OR n_symbols > {symbol_limit} * n_words OR {over}) AS kept
        FROM m {" ".join(f"LEFT JOIN c{n} ON c{n}.row = m.row" for n in limits)}
    """


#: Every pair of documents that share a shingle, with the number they share.
JACCARD = f"""
    WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
    w AS (SELECT doc_id, {words('t')} w FROM d),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) x FROM w, unnest(range(1, greatest(2, len(w) - 2))) z(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
    common AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
    c AS (SELECT * FROM s SEMI JOIN common USING (x)),
    pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM c a JOIN c b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    linked AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
    links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    reach(v, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.m FROM reach JOIN links ON links.a = reach.v WHERE reach.m < links.b),
    least AS (SELECT v, min(m) m FROM reach GROUP BY v), many AS (SELECT a, count(*) k FROM links GROUP BY a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.m AS component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON v = d.doc_id LEFT JOIN many ON many.a = d.doc_id
"""

WARC = """
    WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM g
"""
