"""Registered queries of the corpus operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from .bpe_heap import op5_bpe_heap
from .bpe_matrix import op6_bpe_matrix
from .chat_trees import op10_chat_trees
from .cover_tree import op3_cover_tree
from .decontaminate import op9_decontaminate
from .filter_audit import op11_filter_audit
from .jaccard_join import op8_jaccard_join, op8_jaccard_links
from .kk_sharding import op2_kk_sharding
from .lexical_search import op13_lexical_search
from .ngram_trie import op1_ngram_trie
from .secret_ledger import RULES, op4_secret_history, op4_secret_ledger
from .source_mixing import op12_source_mixing
from .toxicity import op7_toxicity

QUERIES = {
    "op1_ngram_trie": op1_ngram_trie,
    "op2_kk_sharding": op2_kk_sharding,
    "op3_cover_tree": op3_cover_tree,
    "op4_secret_ledger": op4_secret_ledger,
    "op4_secret_history": op4_secret_history,
    "op5_bpe_heap": op5_bpe_heap,
    "op6_bpe_matrix": op6_bpe_matrix,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op8_jaccard_links": op8_jaccard_links,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_trees": op10_chat_trees,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_mixing": op12_source_mixing,
    "op13_lexical_search": op13_lexical_search,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links (a, b) to the smallest id that each row reaches.
_REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    part AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""

_OP3 = f"""WITH RECURSIVE
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
        WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
    {_REACH},
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(part.least, vec_id)) AS component_id,
        vec_id = least(vec_id, coalesce(part.least, vec_id)) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN part ON part.a = vec_id"""


def _op4(history: bool = False) -> str:
    """history: both versions of each document, with their commits."""
    d = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
    if history:
        d = "SELECT doc_id, 1 AS commit, split_part(coalesce(text, ''), chr(10), 1) AS t FROM documents UNION ALL SELECT doc_id, 2, coalesce(text, '') FROM documents"
    own = "doc_id, commit" if history else "doc_id"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    one = [
        f"""SELECT {own}, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gaps,
        regexp_extract_all(t, {quoted(r.pattern)}, 0) AS found, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS judged
        FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"""
        for rank, r in enumerate(RULES)
    ]
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    span = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS ({d}),
    m AS ({" UNION ALL ".join(one)}),
    p AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
    s AS (SELECT {own}, kind, rank, least, length(judged[i]) AS n,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS a, length(found[i]) AS w FROM p),
    k AS (SELECT {own}, kind, rank, CAST(a AS BIGINT) AS start, CAST(a + w AS BIGINT) AS stop FROM s WHERE n >= least),
    g AS (SELECT {own}, {counts}, string_agg({span}, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS base,
        string_agg({span}, ',' ORDER BY start, rank) AS spans FROM k GROUP BY {own})
    SELECT {', '.join('d.' + c for c in own.split(', '))}, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id{" AND g.commit = d.commit" * history}"""


_OP8 = f"""WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    {_REACH}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(part.least, d.doc_id)) AS component_id, coalesce(k.n, 0) AS n_links
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN part ON part.a = d.doc_id
        LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = d.doc_id"""

_WORDS9 = f"""regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
_OP9 = f"""WITH
    i AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0))),
    d AS (SELECT doc_id, coalesce({_WORDS9}, []) AS w FROM documents),
    dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
    hit AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN win ON win.k = dw.k AND win.g = dw.g),
    words AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT doc_id, p, unnest(range(0, k)) AS o FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

_ESCAPE = r"regexp_replace({}, '([<\[]\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"
_OP10 = f"""WITH
    c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<s>[INST]  [/INST] </s>') + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""

_OP11 = """WITH
    d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    m AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
        + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM w),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
        FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
    v AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b)),
    o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
        FROM v p, v q, v r, v s, v u WHERE p.b + q.b + r.b + s.b + u.b = 31),
    e AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS prior
        FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
    r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
        sum(n) FILTER (WHERE mask & bit = 0 AND mask & prior = 0) AS kept,
        sum(n) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0) AS removed, sum(n) FILTER (WHERE mask & bit <> 0 AND mask & prior <> 0) AS redundant,
        sum(n) FILTER (WHERE mask = bit) AS unique_fails, sum(good) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0) AS good_lost,
        sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0) AS toxic_lost
        FROM e, c GROUP BY part, filter_order, step)
    SELECT part, filter_order, CAST(step AS INT) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
        CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
        CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""

_TERMS13 = f"""regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
_OP13 = f"""WITH
    d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS13} AS w FROM documents),
    n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
    g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
    tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
    i AS (SELECT DISTINCT item_id, unnest({_TERMS13}) AS t FROM benchmark),
    w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t),
    m AS (SELECT r, doc_id, 50 + (50 * n * docs) // terms AS m FROM n, g),
    s AS (SELECT item_id, m.r, any_value(m.doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM i JOIN tf ON tf.t = i.t JOIN w ON w.t = i.t JOIN m ON m.r = tf.r GROUP BY item_id, m.r),
    k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 50"""

#: The others need a tokenizer, a fitted model, a heap or a hash that SQL lacks; they are tested against plain restatements.
ORACLE_SQL: dict[str, str] = {
    "op3_cover_tree": _OP3,
    "op4_secret_ledger": _op4(),
    "op4_secret_history": _op4(history=True),
    "op8_jaccard_join": _OP8,
    "op8_jaccard_links": _OP8,
    "op9_decontaminate": _OP9,
    "op10_chat_trees": _OP10,
    "op11_filter_audit": _OP11,
    "op13_lexical_search": _OP13,
}
