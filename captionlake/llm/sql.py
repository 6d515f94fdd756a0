"""DuckDB SQL of the queries that SQL can express: exact counterparts by plain joins, for tables of moderate size."""

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (h) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_line_dedup": f"""WITH d AS (SELECT doc_id, text IS NULL AS missing, string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
a AS (SELECT doc_id, missing, every, list_filter(every, lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
c AS (SELECT *, list_transform(l, lambda x: len(regexp_extract_all(x, '{_WORD}'))) AS n FROM a),
b AS (SELECT doc_id, l, n, i, unnest(range(1, least(20, len(l) - i + 1) + 1)) AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)),
s AS (SELECT doc_id, i, k, md5(array_to_string(l[i:i + k - 1], chr(10))) || ':' || k AS h FROM b
 WHERE list_sum(n[i:i + k - 1]) >= 20 AND (list_sum(n[i:i + k - 1]) - n[i] < 20 OR list_sum(n[i:i + k - 1]) - n[i + k - 1] < 20)),
f AS (SELECT h, min({{'d': doc_id, 'i': i}}) AS first FROM s GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(greatest(i, CASE WHEN first.d = doc_id THEN first.i + k ELSE 0 END), i + k)) AS line FROM s JOIN f USING (h) WHERE first < {{'d': doc_id, 'i': i}}),
x AS (SELECT doc_id, unnest(every) AS body, generate_subscripts(every, 1) AS place FROM a),
y AS (SELECT *, regexp_matches(body, '{_WORD}') AS solid, sum(CASE WHEN regexp_matches(body, '{_WORD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS line FROM x),
z AS (SELECT y.*, g.line IS NOT NULL AND solid AS cut FROM y LEFT JOIN gone g ON g.doc_id = y.doc_id AND g.line = y.line)
SELECT doc_id, count_if(solid) AS n_lines, count_if(cut) AS n_removed, sha256(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT cut), '')) AS kept_sha256 FROM z GROUP BY doc_id""",
    "op5_sharding": """WITH t AS (SELECT list(crc ORDER BY i) AS tab FROM
 (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) r(i))),
b AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, stratum, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
u AS (SELECT *, ('0x' || substr(md5('7|' || doc_id || '|' || text_crc32), 1, 15))::BIGINT AS u, count(*) OVER () AS total, count(*) OVER (PARTITION BY stratum) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY (u >> 33) % greatest(16, (total + 19999) // 20000), u, doc_id, text_crc32, size) - 1 AS rank FROM u),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, stratum, u, doc_id, text_crc32, size) - 1 AS place FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INT) AS shard, place - ((place * 16 // total) * total + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard, stratum FROM p""",
}


def _near_duplicates(percent: int, more: str = "") -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
 UNION SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS top FROM d UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id{more} FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id) t USING (doc_id)"""


def _vector_codes(entries: int = 256, rounds: int = 4) -> str:
    """Plain k-means over the parts: every part against every entry in each round."""
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "pts AS MATERIALIZED (SELECT rid, vec_id, label, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS v FROM k, range(4) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, o - 1 AS e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS o FROM pts) WHERE o <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, p, min({{'d': CAST(list_inner_product(pts.v, pts.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(pts.v, b.v) AS BIGINT), 'e': e}}) AS m
 FROM pts JOIN b{r} b USING (p) GROUP BY rid, p)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r} AS (SELECT p, e, list(mean ORDER BY i) AS v FROM (SELECT p, m.e AS e, i, floor(sum(v[i]) / count(*)) AS mean FROM a{r} JOIN pts USING (rid, p), range(1, len(v) + 1) t(i) GROUP BY p, m.e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(c.v, b.v) AS v FROM b{r} b LEFT JOIN c{r} c USING (p, e))"""
            )
    steps.append(f"f AS (SELECT rid, string_agg(printf('%02x', CAST(m.e AS INT)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, range(1, len(v) + 1) t(i))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (rid), h"


ORACLES["op10_jaccard_join"] = _near_duplicates(75)
ORACLES["op11_minhash_dedup"] = _near_duplicates(85, ", d.doc_id = t.component_id AS kept")
ORACLES["op12_fill_in_middle"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d),
c AS (SELECT *, len(w) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""
ORACLES["op13_vector_codes"] = _vector_codes()
