"""SQL of the queries that SQL can express, for the same tables."""

from __future__ import annotations

from updraft.llm import merkle, secrets, urls


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_sql() -> str:
    """Places of matches from the texts between them; kinds are ranked in their order."""
    kinds = [(rank, *kind) for rank, kind in enumerate((*secrets.BASE_KINDS, ("owned", secrets.OWNED, 0, 24)))]
    found = " UNION ALL ".join(
        f"""
        SELECT doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, m, v, i,
               coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b
        FROM (
            SELECT *, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i
            FROM (
                SELECT doc_id, source, lang, regexp_extract_all(text, {quoted(pattern)}) AS ms,
                       regexp_extract_all(text, {quoted(pattern)}, {group}) AS vs,
                       regexp_split_to_array(text, {quoted(pattern)}) AS gaps
                FROM documents
            )
        ) WHERE length(v) >= {least}"""
        for rank, kind, pattern, group, least in kinds
    )
    return f"""
    WITH found AS ({found}),
    spans AS (SELECT *, b + length(m) AS e, sha256(v) AS hash FROM found),
    base AS (SELECT * FROM spans WHERE kind <> 'owned'),
    kept AS (
        SELECT * FROM base UNION ALL
        SELECT s.* FROM spans s
        WHERE s.kind = 'owned' AND regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[A-Za-z]')
          AND len(list_distinct(string_split(s.v, ''))) >= 12
          AND NOT EXISTS (SELECT 1 FROM base t WHERE t.doc_id = s.doc_id AND t.b < s.e AND s.b < t.e)
    ),
    owners AS (
        SELECT hash, count(DISTINCT source) AS n, count(DISTINCT (coalesce(source, ''), concat_ws('/', source, lang))) AS r
        FROM kept GROUP BY hash
    ),
    final AS (
        SELECT k.*, o.n, o.r, concat_ws(':', kind, b, e) AS span FROM kept k JOIN owners o USING (hash)
        WHERE kind <> 'owned' OR n <= {secrets.LIVE_OWNERS}
    ),
    per AS (
        SELECT doc_id,
               count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'owned') AS n_owned,
               count(*) FILTER (n >= {secrets.EXAMPLE_OWNERS}) AS n_example, count(*) FILTER (n <= {secrets.LIVE_OWNERS}) AS n_live,
               max(r) AS most_repositories,
               string_agg(span, ',' ORDER BY b, rank) FILTER (kind <> 'owned') AS base,
               string_agg(span, ',' ORDER BY b, rank) AS spans
        FROM final GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_owned, 0) AS n_owned, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live,
           coalesce(most_repositories, 0) AS most_repositories
    FROM documents d LEFT JOIN per USING (doc_id)"""


CONTAINMENT = r"""
WITH all_words AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
),
split AS (
    SELECT side, id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM all_words WHERE text IS NOT NULL
),
wide AS (SELECT * FROM split WHERE len(w) >= 5),
shingles AS (
    SELECT DISTINCT side, id, s FROM (
        SELECT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM wide
    )
),
items AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id),
pairs AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS matched
    FROM shingles d JOIN shingles i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, matched, matched / n AS containment
FROM pairs JOIN items ON items.id = item_id WHERE n - matched <= n - ceil(0.8 * n - 1e-9)"""


def url_sql() -> str:
    """Rules by length, then terms with no letter or digit on either side."""
    rules = sorted(urls.PAGE_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    case = lambda i: " ".join(f"WHEN {fit} THEN '{(h + p, says)[i]}'" for fit, (h, p, says) in zip(fits, rules))
    term = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int"
    strict, soft = ("(" + " + ".join(term(t) for t in terms) + ")" for terms in (urls.STRICT_TERMS, urls.SOFT_TERMS))
    return f"""
    WITH parts AS (
        SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
               translate(coalesce(url, ''), '{urls.UPPER}', '{urls.LOWER}') AS low
        FROM pages
    ),
    judged AS (
        SELECT page_id, host, path, CASE {case(0)} END AS rule, CASE {case(1)} END AS says, {strict}::int AS n_strict, {soft}::int AS n_soft FROM parts
    )
    SELECT page_id, host, path, rule, n_strict, n_soft,
           coalesce(says, CASE WHEN n_strict >= 1 OR n_soft >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged"""


TOPK = """
WITH ints AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint AS score
    FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""

def jaccard_sql(words: int, percent: int) -> str:
    """Links of all pairs with a common shingle, and what can be reached by them."""
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS s FROM words
    )
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
    SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= {percent} * (a.n + b.n - o)
),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""


def merkle_sql(source_levels: int = 5, top_levels: int = 3) -> str:
    """The tree level by level; a part of one node is passed on as it is. ``source_levels``: enough for 16 ** 5 rows of a source."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c}::varchar END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = f"translate(text, '{urls.UPPER}', '{urls.LOWER}')"
    steps: list[str] = []

    def climb(tree: str, levels: int) -> None:
        for k in range(levels):
            run = "PARTITION BY part, pos // 16 ORDER BY pos ROWS BETWEEN"
            steps.append(f"""
    {tree}s{k} AS MATERIALIZED (
        SELECT part, pos, c > 1 AS folds, CASE WHEN c > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
               CASE WHEN c > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
        FROM {tree}{k}
    ),
    {tree}{k + 1} AS MATERIALIZED (
        SELECT part, pos // 16 AS pos, CASE WHEN max(c) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, (max(c) + 15) // 16 AS c
        FROM {tree}{k} GROUP BY part, pos // 16
    )""")

    climb("t", source_levels)
    steps.append(f"""
    subs AS (SELECT part, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS place FROM t{source_levels}),
    u0 AS MATERIALIZED (SELECT 0 AS part, place AS pos, subroot AS h, count(*) OVER () AS c FROM subs)""")
    climb("u", top_levels)
    sides = [(f"t{k}", f"JOIN ts{k} t{k} ON t{k}.part = d.part AND t{k}.pos = d.pos // {16**k}") for k in range(source_levels)]
    sides += [(f"u{k}", f"JOIN us{k} u{k} ON u{k}.pos = s.place // {16**k}") for k in range(top_levels)]
    fold = "coalesce(bad, leaf)"
    ways = [f"SELECT *, {fold} AS f0 FROM joined"]
    for i, (name, _) in enumerate(sides):
        ways.append(f"SELECT *, CASE WHEN {name}_folds THEN sha256({name}_l || f{i} || {name}_r) ELSE f{i} END AS f{i + 1} FROM w{i}")
    columns = ", ".join(f"{n}.folds AS {n}_folds, {n}.l AS {n}_l, {n}.r AS {n}_r" for n, _ in sides)
    return f"""
    WITH crc AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS x(i)
        )
    ),
    leaves AS MATERIALIZED (
        SELECT doc_id, coalesce('=' || source, '') AS part, {leaf("text")} AS leaf,
               CASE WHEN xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                   lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 5 = 0 THEN {leaf(low)} END AS bad
        FROM documents, crc
    ),
    placed AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS c FROM leaves
    ),
    t0 AS (SELECT part, pos, leaf AS h, c FROM placed),
    {",".join(steps)},
    joined AS MATERIALIZED (
        SELECT d.doc_id, leaf, bad, subroot, (SELECT max(h) FROM u{top_levels}) AS root, {columns}
        FROM placed d JOIN subs s USING (part) {" ".join(j for _, j in sides)}
    ),
    {", ".join(f"w{i} AS ({w})" for i, w in enumerate(ways))}
    SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"{n}_l || {n}_r" for n, _ in sides)}) AS proof_sha256,
           f{len(sides)} AS folded_root, f{len(sides)} = root AS verified
    FROM w{len(sides)}"""


PHRASES = r"""
WITH pieces AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
),
split AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS MATERIALIZED (
    SELECT lang, k, phrase, count(*)::hugeint AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM split, range(1, 4) AS x(k) WHERE len(w) >= k
    ) GROUP BY ALL
),
sizes AS (SELECT lang, sum(f)::bigint AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
    SELECT g.lang, g.k, g.phrase, g.f AS a, c, array_to_string(string_split(g.phrase, ' ')[1:c], ' ') AS head, array_to_string(string_split(g.phrase, ' ')[c + 1:], ' ') AS rest
    FROM grams g, range(1, 3) AS x(c) WHERE g.k >= 2 AND g.f >= 10 AND c < g.k
),
scored AS (
    SELECT t.lang, t.k, t.phrase, t.a, l.f AS l, r.f AS r, (1000000::hugeint * t.a * t.a) // (l.f * r.f) AS score
    FROM cuts t JOIN grams l ON l.lang = t.lang AND l.phrase = t.head JOIN grams r ON r.lang = t.lang AND r.phrase = t.rest
    QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, t.c) = 1
),
inner_pairs AS (
    SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a FROM scored WHERE k = 3
),
longest AS (SELECT lang, phrase, max(a) AS most FROM inner_pairs GROUP BY ALL),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM scored LEFT JOIN longest USING (lang, phrase) WHERE k = 3 OR coalesce(100 * most < 50 * a, true)
)
SELECT lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n, score::bigint AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

ORACLES = {
    "op1_secret_ownership": secret_sql(),
    "op4_minhash_containment": CONTAINMENT,
    "op7_exhaustive_topk": TOPK,
    "op8_url_vocabulary": url_sql(),
    "op9_signature_tree_join": jaccard_sql(3, 90),
    "op11_b_bit_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({jaccard_sql(2, 80)})",
    "op12_branch_and_bound_phrases": PHRASES,
    "op13_merkle_manifest": merkle_sql(),
}
