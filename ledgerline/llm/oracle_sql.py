"""DuckDB SQL for the rows of those queries that SQL can state, by plain comparison of everything."""

from __future__ import annotations

from ledgerline.llm.merkle import FANOUT

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

# CRC-32 by its table of 256 values, made from the rule.
_CRC_TABLE = """
        crc_step(i, k, v) AS (
            SELECT i, 0, i FROM range(256) AS t(i)
            UNION ALL
            SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
            FROM crc_step WHERE k < 8
        ),
        crc_table AS (SELECT list(v ORDER BY i) AS crc_of FROM crc_step WHERE k = 8)
"""


def _crc32(number: str) -> str:
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


def _components(links: str, nodes: str) -> str:
    """CTE `component`: node, root, from links (a, b) in both directions."""
    return f"""
        reached(node, other) AS (
            SELECT node, node FROM {nodes}
            UNION
            SELECT r.node, l.b FROM reached r JOIN {links} l ON r.other = l.a
        ),
        component AS (SELECT node, min(other) AS root FROM reached GROUP BY node)
"""


NEAR_DEDUP = f"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS words
            FROM documents
        ),
        shingled AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
                       range(greatest(1, len(words) - 4)),
                       lambda i: array_to_string(words[i + 1:i + 5], ' '))) END AS shingles
            FROM split
        ),
        shingle AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM shingled),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS both_n, count(*) AS n
            FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
            GROUP BY ALL
        ),
        link AS (SELECT a, b FROM common WHERE 100 * n >= 75 * (both_n - n)),
        {_components("link", "(SELECT doc_id AS node FROM documents)")}
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept
        FROM shingled JOIN component ON doc_id = node
"""

DECONTAMINATION = f"""
        WITH item AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_LETTERS}') AS words
            FROM benchmark WHERE text IS NOT NULL
        ),
        sized AS (SELECT item_id, words, least(13, len(words)) AS m FROM item WHERE len(words) > 0),
        pattern AS (
            SELECT item_id, m, array_to_string(words[i + 1:i + m], ' ') AS p
            FROM (SELECT item_id, words, m, unnest(range(len(words) - m + 1)) AS i FROM sized)
        ),
        doc AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERS}') AS words
            FROM documents
        ),
        place AS (
            SELECT doc_id, m, i, array_to_string(words[i + 1:i + m], ' ') AS p
            FROM (SELECT doc_id, words, m, unnest(range(len(words) - m + 1)) AS i
                  FROM doc, (SELECT DISTINCT m FROM sized) WHERE len(words) >= m)
        ),
        found AS (SELECT DISTINCT doc_id, item_id, m, i FROM place JOIN pattern USING (m, p)),
        hit AS (
            SELECT doc_id, count(DISTINCT w) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + m)) AS w FROM found) GROUP BY doc_id
        ),
        named AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

TOP_K = """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
        FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 20
"""

NEAR_VECTORS = f"""
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM usable a JOIN usable b
              ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
        ),
        {_components("link", "(SELECT vec_id AS node FROM embeddings)")},
        counted AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
        SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
        FROM embeddings JOIN component ON vec_id = node LEFT JOIN counted ON vec_id = a
"""


def _merkle(levels: int = 12, upper: int = 6) -> str:
    """The levels of trees and of the tree of subroots, one query each; beyond the top they pass a node on."""

    def climb(name: str, count: int) -> str:
        parts = []
        for k in range(count):
            parts.append(
                f"""
        {name}_run{k} AS (
            SELECT tree, place // {FANOUT} AS up, list(digest ORDER BY place) AS run, max(n) AS n
            FROM {name}{k} GROUP BY tree, place // {FANOUT}
        ),
        {name}{k + 1} AS (
            SELECT tree, up AS place, (n + {FANOUT - 1}) // {FANOUT} AS n,
                   CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest
            FROM {name}_run{k}
        )"""
            )
        return ",".join(parts)

    def path(name: str, count: int, place: str, tree: str, alias: str) -> tuple[str, str, str]:
        """Joins, and lists of what stands before and after on the way, null where nothing is hashed."""
        joins, before, after = [], [], []
        for k in range(count):
            step = FANOUT**k
            run = f"{alias}{k}"
            joins.append(
                f"LEFT JOIN {name}_run{k} {run} ON {run}.tree IS NOT DISTINCT FROM {tree}"
                f" AND {run}.up = {place} // {step * FANOUT} AND {run}.n > 1"
            )
            own = f"({place} // {step} % {FANOUT})"
            before.append(f"array_to_string({run}.run[1:{own}], '')")
            after.append(f"array_to_string({run}.run[{own} + 2:], '')")
        return "\n            ".join(joins), ", ".join(before), ", ".join(after)

    def leaf(text: str) -> str:
        part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
        return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = path("level", levels, "l.place", "l.tree", "a")
    higher = path("top", upper, "s.place", "''", "b")
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        leaves AS (
            SELECT doc_id, lang, {leaf("text")} AS leaf,
                   CASE WHEN {_crc32("doc_id")} % 3 = 0 THEN {leaf(_LOWER.format("text"))} END AS tampered
            FROM documents, crc_table
        ),
        level0 AS (
            SELECT doc_id, lang AS tree, leaf AS digest, tampered,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                   count(*) OVER (PARTITION BY lang) AS n
            FROM leaves
        ),
        {climb("level", levels)},
        top0 AS (
            SELECT '' AS tree, tree AS lang, digest, count(*) OVER () AS n,
                   row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place
            FROM level{levels}
        ),
        {climb("top", upper)},
        way AS (
            SELECT l.doc_id, l.digest AS leaf, l.tampered, s.digest AS subroot, t.digest AS root,
                   [{lower[1]}, {higher[1]}] AS before, [{lower[2]}, {higher[2]}] AS after
            FROM level0 l JOIN top0 s ON s.lang IS NOT DISTINCT FROM l.tree JOIN top{upper} t ON true
            {lower[0]}
            {higher[0]}
        ),
        folded AS (
            SELECT *, list_filter(list_zip(before, after), lambda p: p[1] IS NOT NULL) AS steps FROM way
        ),
        checked AS (
            SELECT *, list_reduce(
                       list_prepend({{'own': coalesce(tampered, leaf), 'b': '', 'a': ''}},
                                    list_transform(steps, lambda p: {{'own': '', 'b': p[1], 'a': p[2]}})),
                       lambda x, y: {{'own': sha256(y.b || x.own || y.a), 'b': '', 'a': ''}}).own AS folded_root
            FROM folded
        )
        SELECT doc_id, leaf, subroot, root,
               sha256(array_to_string(list_transform(steps, lambda p: p[1] || p[2]), '')) AS proof_sha256,
               folded_root, folded_root = root AS verified
        FROM checked
"""


MERKLE = _merkle()

PREFIX_TRIE = f"""
        WITH RECURSIVE {_CRC_TABLE},
        own AS (
            SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        head AS (SELECT own.*, {_crc32("conv_id")} % 6 AS h FROM own, crc_table),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
            FROM head c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
        ),
        prefix AS (
            SELECT conv_id, d AS depth, turns[1:d] AS seq, d = len(turns) AS is_end
            FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
        ),
        node AS (
            SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
            FROM prefix GROUP BY depth, seq
        ),
        family AS (
            SELECT n.*, p.conv_id AS parent_conv_id,
                   (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.seq[1:n.depth] = n.seq) AS n_children,
                   CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.seq[n.depth].text) END AS saved
            FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]
        ),
        below AS (
            SELECT seq AS top, depth AS top_depth, conv_id, depth, n_children, saved FROM family
            UNION ALL
            SELECT top, top_depth, k.conv_id, k.depth, k.n_children, k.saved
            FROM below b JOIN family k ON k.parent_conv_id = b.conv_id AND k.depth = b.depth + 1
        ),
        summed AS (
            SELECT top, top_depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
            FROM below GROUP BY top, top_depth
        )
        SELECT CAST(f.conv_id AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth,
               CAST(parent_conv_id AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
               CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM family f JOIN summed ON seq = top AND depth = top_depth
"""
