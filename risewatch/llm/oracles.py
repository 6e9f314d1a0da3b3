"""The subpackage's queries that SQL can express, as DuckDB SQL over whole tables."""

#: Containment of every item in every document over exact five-word shingles.
OP5 = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM d WHERE len(w) >= 5
), bs AS (
    SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM b WHERE len(w) >= 5
), n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n_shingles) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found,
       CAST(count(*) AS DOUBLE) / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING CAST(count(*) AS DOUBLE) / any_value(n_shingles) >= 0.8
"""

#: Links of all pairs of one label, and the smallest vector that each reaches.
OP9 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), sound AS (
    SELECT vec_id, label, e FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

#: Targets by capping sources in the order of what they hold for their weight, then positions by inverted schedules.
OP12 = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS t FROM d GROUP BY source
), w AS (
    SELECT *, [3, 1, 2][t % 3 + 1] AS w, 4 * size AS cap FROM s
), k AS (
    SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
           sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over, sum(size) OVER () * 3 AS words
    FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, t)
), least_k AS (
    SELECT min(k) AS k FROM k WHERE (words - capped) * w <= over * cap
), f AS (
    SELECT words - capped AS share, over, k FROM k WHERE k = (SELECT k FROM least_k)
), g AS (
    SELECT k.source, k.t, CAST(k.size AS BIGINT) AS source_size,
           CASE WHEN f.k IS NULL OR k.k < f.k THEN CAST(k.cap AS DOUBLE) / 2.0 ELSE CAST(f.share * k.w AS DOUBLE) / CAST(f.over * 2 AS DOUBLE) END AS target,
           CAST(CASE WHEN f.k IS NULL OR k.k < f.k THEN k.cap // 2 ELSE (f.share * k.w) // (f.over * 2) END AS BIGINT) AS demand
    FROM k LEFT JOIN f ON true
), p AS (
    SELECT d.doc_id, d.size, g.*, row_number() OVER o AS i,
           CAST(coalesce(sum(d.size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
    WINDOW o AS (PARTITION BY g.t ORDER BY md5(CAST(d.doc_id AS VARCHAR)) NULLS FIRST, d.doc_id NULLS FIRST, d.size)
), q AS (
    SELECT p.*, turn, turn * source_size + run AS before, greatest(0, least(size, demand - (turn * source_size + run))) AS words
    FROM p, (VALUES (0), (1)) AS turns(turn)
), r AS (
    SELECT *, CAST(before AS DOUBLE) / CAST(demand AS DOUBLE) * [3.0, 1.0, 2.0][t % 3 + 1] AS asked FROM q WHERE words > 0
), u AS (
    SELECT *, CASE WHEN asked <= 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * asked / ([4.0, 0.0, 2.0][t % 3 + 1]
        + sqrt([16.0, 0.0, 4.0][t % 3 + 1] + CAST(2.0 AS DOUBLE) * asked * [-2.0, 2.0, 0.0][t % 3 + 1])) END AS time
    FROM r
), v AS (
    SELECT *, CAST(coalesce(sum(words) OVER (ORDER BY time, t, i, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u
), e AS (SELECT t, i, CAST(sum(words) AS BIGINT) AS taken, min(start) AS first_token FROM v GROUP BY t, i)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(e.taken, 0) AS taken, e.first_token
FROM p LEFT JOIN e ON p.t = e.t AND p.i = e.i
"""


def _climb(levels: int, nodes: str, name: str) -> tuple[str, str]:
    """Common tables of a tree's levels over `nodes` (tree, i, n, digest), which as 0 is given; the last one."""
    out = []
    for k in range(levels):
        now = nodes if k == 0 else f"{name}{k}"
        out.append(f"""{name}r{k} AS (
    SELECT *, coalesce(string_agg(digest, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM {now} WINDOW o AS (PARTITION BY tree, i // 16 ORDER BY i)
), {name}{k + 1} AS (
    SELECT tree, i // 16 AS i, (any_value(n) + 15) // 16 AS n,
           CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest
    FROM {now} GROUP BY tree, i // 16
)""")
    return ", ".join(out), f"{name}{levels}"


def _merkle(levels: int = 6, top: int = 5) -> str:
    """Trees of up to 16^levels documents a source and 16^top sources, level by level."""
    part = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    before = " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
    own, subroots = _climb(levels, "leaf", "a")
    upper, root = _climb(top, "sub", "b")
    steps, proof, joins = ["{'d': l.held, 'b': '', 'a': '', 'only': true}"], [], []
    for tree, i, name, count in (("l.tree", "l.i", "a", levels), ("0", "l.tree", "b", top)):
        for k in range(count):
            at = f"{name}{k}x"
            joins.append(f"JOIN {name}r{k} {at} ON {at}.tree = {tree} AND {at}.i = {i} // {16 ** k}")
            steps.append(f"{{'d': '', 'b': {at}.before, 'a': {at}.after, 'only': {at}.n = 1}}")
            proof.append(f"CASE WHEN {at}.n = 1 THEN '' ELSE {at}.before || {at}.after END")
    folded = f"""list_reduce([{", ".join(steps)}], lambda now, x:
        {{'d': CASE WHEN x.only THEN now.d ELSE sha256(x.b || now.d || x.a) END, 'b': '', 'a': '', 'only': true}}).d"""
    return f"""
WITH leaf AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, sha256({before} || {part.format("text")}) AS digest,
                 sha256({before} || CASE WHEN {crc} % 5 = 0 THEN {part.format(lower)} ELSE {part.format("text")} END) AS held FROM documents)
), {own}, sub AS (
    SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, digest FROM {subroots}
), {upper}, path AS (
    SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM {root}) AS root, sha256({" || ".join(proof)}) AS proof_sha256,
           {folded} AS folded_root
    FROM leaf l JOIN {subroots} s ON s.tree = l.tree {" ".join(joins)}
)
SELECT *, folded_root = root AS verified FROM path
"""


ORACLES = {"op5_decontamination": OP5, "op9_embedding_duplicates": OP9, "op12_curriculum": OP12, "op13_merkle_manifest": _merkle()}
