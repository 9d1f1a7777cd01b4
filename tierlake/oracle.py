"""The queries in SQL over the test tables, for a comparison by another engine."""

from __future__ import annotations

_UNITS = """
  u AS (SELECT DISTINCT doc_id, layer, CAST(ord AS BIGINT) AS ord, CAST(unit_from AS BIGINT) AS s, CAST(unit_to AS BIGINT) AS e, datum, CAST(link_to AS BIGINT) AS link
        FROM annotations WHERE layer IN ('words', 'pos', 'lemma', 'entities', 'prev') AND doc_id IN (SELECT doc_id FROM documents)),
  w AS (SELECT doc_id, ord, s, e FROM u WHERE layer = 'words'),
  n_words AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
  spans AS (
    SELECT 'words' AS layer, doc_id, ord, s, e FROM w
    UNION ALL SELECT 'pos', p.doc_id, w.ord, w.s, w.e FROM (SELECT DISTINCT doc_id FROM u WHERE layer = 'pos') p JOIN w ON w.doc_id = p.doc_id
    UNION ALL SELECT 'entities', x.doc_id, x.ord, a.s, b.e FROM u x JOIN w a ON a.doc_id = x.doc_id AND a.ord = x.s JOIN w b ON b.doc_id = x.doc_id AND b.ord = x.e - 1 WHERE x.layer = 'entities'
    UNION ALL SELECT 'prev', x.doc_id, x.ord, a.s, a.e FROM u x JOIN w a ON a.doc_id = x.doc_id AND a.ord = x.s WHERE x.layer = 'prev'),
  pieces AS (SELECT p.layer, p.doc_id, p.ord, decode(array_slice(encode(d.text), p.s + 1, p.e)) AS piece FROM spans p JOIN documents d ON d.doc_id = p.doc_id WHERE d.text IS NOT NULL),
  split AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord
    FROM documents WHERE text IS NOT NULL),
  ends AS (SELECT doc_id, text, line, ord, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord) AS upto FROM split),
  lines AS (SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(upto - strlen(line) - 1 AS BIGINT) AS s, CAST(least(upto, strlen(text)) AS BIGINT) AS e, decode(array_slice(encode(text), CAST(upto - strlen(line) AS BIGINT), CAST(least(upto, strlen(text)) AS BIGINT))) AS piece FROM ends)
"""
_WITH = f"WITH {_UNITS} "


def _pieces(layer: str) -> str:
    return f"{_WITH} SELECT doc_id, ord, piece FROM pieces WHERE layer = '{layer}'"


def _spans(layer: str) -> str:
    return f"{_WITH} SELECT doc_id, ord, s, e FROM spans WHERE layer = '{layer}'"


def _some(layer: str, condition: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM u WHERE layer = '{layer}' AND ({condition}))"


def _some_text(layer: str, condition: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM pieces WHERE layer = '{layer}' AND ({condition}))"


def _docs(condition: str) -> str:
    return f"{_WITH} SELECT doc_id FROM documents WHERE {condition}"


_HASH = "to_base64(unhex(sha256(CASE WHEN text IS NULL THEN '' ELSE 'text' || chr(0) || text || chr(0) END)))"
# Right while documents that share four characters of their hash have one text, as on the scale that it is run on.
_IDS = f"SELECT doc_id, text, left(code, CAST(least(44, 3 + row_number() OVER (PARTITION BY code ORDER BY doc_id)) AS BIGINT)) AS id FROM (SELECT doc_id, text, {_HASH} AS code FROM documents)"
_TOKENS = r"""
  toks AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]|\s+')) AS token, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]|\s+'), 1) AS k FROM documents WHERE text IS NOT NULL),
  placed AS (SELECT doc_id, token, k, sum(strlen(token)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM toks)
"""
_LATEST = "latest AS (SELECT doc_id, arg_max(struct_pack(op := op, layer := layer, payload := payload), struct_pack(o := occurred_at, u := upd_id, r := received_at)) AS x FROM doc_updates GROUP BY doc_id)"

_ROUND = f"""{_WITH}
  SELECT d.doc_id, p.ord, p.piece, n.n AS n_words, CAST(to_json([d.url]) AS VARCHAR) AS url
  FROM documents d LEFT JOIN (SELECT * FROM pieces WHERE layer = 'entities') p ON p.doc_id = d.doc_id LEFT JOIN n_words n ON n.doc_id = d.doc_id"""
_ROUND = _ROUND.replace("CAST(to_json([d.url]) AS VARCHAR)", "CASE WHEN d.url IS NULL THEN NULL ELSE CAST(to_json([d.url]) AS VARCHAR) END")

_CODES = f"codes AS (SELECT doc_id, text, {_HASH} AS code FROM documents), named AS (SELECT doc_id, text, code, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS k FROM codes)"
_TAGS = "tags AS (SELECT doc_id, layer, string_agg(coalesce(datum, '~'), '|' ORDER BY ord) AS tags FROM u WHERE layer IN ('pos', 'lemma') GROUP BY doc_id, layer)"
_CONTENTS = f"""{_WITH}, {_TAGS}, {_CODES}
  SELECT left(d.code, CAST(least(44, 3 + d.k) AS BIGINT)) AS doc_id, sha256(coalesce(d.text, '')) AS hash, n.n AS n_words, t.tags
  FROM named d LEFT JOIN n_words n ON n.doc_id = d.doc_id LEFT JOIN tags t ON t.doc_id = d.doc_id AND t.layer = 'pos'"""
# Ids of changed and added documents: of each code the lengths that the documents before them leave, in turn.
_FREE = """
  free AS (
    SELECT c.code, l.n AS size, row_number() OVER (PARTITION BY c.code ORDER BY l.n) AS k
    FROM (SELECT DISTINCT code FROM fresh) c CROSS JOIN range(4, 44) l(n) LEFT JOIN kept t ON t.code = c.code AND t.size = l.n WHERE t.code IS NULL),
  given AS (SELECT f.*, left(f.code, CAST(coalesce(r.size, 44) AS BIGINT)) AS id FROM fresh f LEFT JOIN free r ON r.code = f.code AND r.k = f.k)"""
_OF_CODE = "to_base64(unhex(sha256(CASE WHEN new_text IS NULL THEN '' ELSE 'text' || chr(0) || new_text || chr(0) END)))"
_JSON_TAGS = "array_to_string(list_transform(CAST(from_json({0}, '[\"VARCHAR\"]') AS VARCHAR[]), lambda x: coalesce(x, '~')), '|')"
_AT = "struct_pack(o := occurred_at, u := upd_id, r := received_at)"
_UPDATED = f"""{_WITH}, {_TAGS}, {_CODES},
  gone AS (SELECT doc_id, max({_AT}) AS last FROM doc_updates WHERE op = 'remove' GROUP BY doc_id),
  live AS (SELECT c.*, {_AT} AS moment FROM doc_updates c LEFT JOIN gone g ON g.doc_id = c.doc_id WHERE c.op <> 'remove' AND c.payload IS NOT NULL AND (g.last IS NULL OR {_AT} > g.last)),
  patch AS (SELECT doc_id, {', '.join(f"arg_max(payload, moment) FILTER (WHERE layer = '{n}') AS p_{n}" for n in ('text', 'pos', 'lemma', '_notes'))} FROM live WHERE doc_id IS NOT NULL GROUP BY doc_id),
  changed AS (SELECT d.doc_id, coalesce(json_extract_string(p.p_text, '$'), d.text) AS new_text, p.p_pos, p.p_lemma, p.p__notes FROM documents d JOIN patch p ON p.doc_id = d.doc_id),
  coded AS (SELECT *, {_OF_CODE} AS code FROM changed),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS k FROM coded),
  kept AS (SELECT DISTINCT code, 3 + k AS size FROM named WHERE doc_id NOT IN (SELECT doc_id FROM patch)), {_FREE}
  SELECT d.doc_id, coalesce(g.id, left(d.code, CAST(least(44, 3 + d.k) AS BIGINT))) AS id, CASE WHEN g.doc_id IS NULL THEN d.text ELSE g.new_text END AS text,
    coalesce({_JSON_TAGS.format('g.p_pos')}, t.tags) AS pos, coalesce({_JSON_TAGS.format('g.p_lemma')}, l.tags) AS lemma, g.p__notes AS notes
  FROM named d LEFT JOIN given g ON g.doc_id = d.doc_id LEFT JOIN tags t ON t.doc_id = d.doc_id AND t.layer = 'pos' LEFT JOIN tags l ON l.doc_id = d.doc_id AND l.layer = 'lemma'"""
_ADDED = f"""{_WITH}, {_TAGS}, {_CODES},
  news AS (SELECT upd_id, min(layer) AS layer, min(payload) AS payload FROM doc_updates WHERE op = 'add' AND layer IN ('text', 'pos', 'lemma', '_notes') GROUP BY upd_id),
  coded AS (SELECT *, {_OF_CODE} AS code FROM (SELECT upd_id, layer, payload, CASE WHEN layer = 'text' THEN json_extract_string(payload, '$') END AS new_text FROM news)),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY upd_id) AS k FROM coded),
  kept AS (SELECT DISTINCT code, 3 + k AS size FROM named), {_FREE}
  SELECT d.doc_id AS doc_pos, left(d.code, CAST(least(44, 3 + d.k) AS BIGINT)) AS id, d.text, t.tags AS pos, l.tags AS lemma, CAST(NULL AS VARCHAR) AS notes
  FROM named d LEFT JOIN tags t ON t.doc_id = d.doc_id AND t.layer = 'pos' LEFT JOIN tags l ON l.doc_id = d.doc_id AND l.layer = 'lemma'
  UNION ALL SELECT upd_id + (SELECT max(doc_id) + 1 FROM documents), id, new_text, CASE WHEN layer = 'pos' THEN {_JSON_TAGS.format("CASE WHEN layer = 'pos' THEN payload END")} END,
    CASE WHEN layer = 'lemma' THEN {_JSON_TAGS.format("CASE WHEN layer = 'lemma' THEN payload END")} END, CASE WHEN layer = '_notes' THEN payload END FROM given"""
_SHOWN = f"""{_WITH},
  whole AS (SELECT d.doc_id, d.text FROM documents d JOIN (SELECT doc_id, max(e) AS last FROM w GROUP BY doc_id) x ON x.doc_id = d.doc_id
    WHERE strlen(d.text) = length(d.text) AND (SELECT max(e) FROM w WHERE w.doc_id = d.doc_id AND w.ord = (SELECT max(ord) FROM w v WHERE v.doc_id = d.doc_id)) <= length(d.text)
      AND d.doc_id IN (SELECT doc_id FROM u WHERE layer = 'entities') AND d.doc_id IN (SELECT doc_id FROM u WHERE layer = 'pos') AND d.doc_id IN (SELECT doc_id FROM u WHERE layer = 'lemma')),
  one AS (SELECT * FROM whole ORDER BY doc_id LIMIT 1),
  cells AS (SELECT p.ord, p.piece, coalesce(l.datum, '') AS lemma, coalesce(t.datum, '') AS pos
    FROM pieces p JOIN one ON one.doc_id = p.doc_id LEFT JOIN u l ON l.doc_id = p.doc_id AND l.layer = 'lemma' AND l.ord = p.ord LEFT JOIN u t ON t.doc_id = p.doc_id AND t.layer = 'pos' AND t.ord = p.ord WHERE p.layer = 'words'),
  wide AS (SELECT *, CAST(greatest(length(piece), length(lemma), length(pos)) AS INTEGER) AS n FROM cells),
  ents AS (SELECT string_agg(p.piece || coalesce('/' || x.datum, ''), ' ' ORDER BY p.ord) AS line FROM pieces p JOIN one ON one.doc_id = p.doc_id JOIN u x ON x.doc_id = p.doc_id AND x.layer = 'entities' AND x.ord = p.ord WHERE p.layer = 'entities')
  SELECT CAST(0 AS BIGINT) AS n, '=== ' || doc_id || ' ===' AS line FROM one
  UNION ALL SELECT 1, 'text: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) FROM one
  UNION ALL SELECT 2, '' FROM one
  UNION ALL SELECT 3, rtrim('words: ' || string_agg(rpad(piece, n, ' '), ' ' ORDER BY ord)) FROM wide HAVING count(*) > 0
  UNION ALL SELECT 4, rtrim('lemma: ' || string_agg(rpad(lemma, n, ' '), ' ' ORDER BY ord)) FROM wide HAVING count(*) > 0
  UNION ALL SELECT 5, rtrim('pos  : ' || string_agg(rpad(pos, n, ' '), ' ' ORDER BY ord)) FROM wide HAVING count(*) > 0
  UNION ALL SELECT 6, '' FROM one UNION ALL SELECT 7, 'entities: ' || line FROM ents WHERE line IS NOT NULL UNION ALL SELECT 8, '' FROM one"""
_LAYERS = """(VALUES
  ('text', 'characters', NULL, NULL, NULL, 0), ('words', 'span', 'text', NULL, NULL, 1), ('pos', 'seq', 'words', 'NOUN,VERB,ADJ,ADV,DET,PRON,ADP,PUNCT,NUM,PROPN,AUX,CCONJ,SCONJ', NULL, 2),
  ('lemma', 'seq', 'words', 'string', NULL, 2), ('entities', 'span', 'words', 'string', NULL, 2), ('prev', 'element', 'words', 'link', 'words', 2), ('lines', 'div', 'text', NULL, NULL, 1), ('tens', 'div', 'words', NULL, NULL, 2),
  ('document', 'div', 'text', NULL, NULL, 1), ('lang', 'seq', 'document', 'string', NULL, 2), ('source', 'seq', 'document', 'string', NULL, 2)) t(layer, type, base, data, target, depth)"""

SQL: dict[str, str] = {
    "scan_docs": "SELECT doc_id, text FROM documents",
    "doc_by_id": "SELECT doc_id, text FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)",
    "doc_ids_greedy": f"SELECT doc_id, id FROM ({_IDS})",
    "doc_keys": f"""{_WITH}
      SELECT DISTINCT doc_id, layer FROM u
      UNION ALL SELECT doc_id, 'tens' FROM n_words
      UNION ALL SELECT doc_id, unnest(['text', 'lines', 'document']) FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, unnest(['lang', 'source']) FROM documents""",
    "layer_text_words": _pieces("words"),
    "layer_text_seq": _pieces("pos"),
    "layer_text_phrase": _pieces("entities"),
    "layer_text_element": _pieces("prev"),
    "layer_text_div": f"{_WITH} SELECT doc_id, ord, piece FROM lines",
    "layer_text_document": "SELECT doc_id, CAST(0 AS BIGINT) AS ord, text AS piece FROM documents WHERE text IS NOT NULL",
    "indexes_self": f"{_WITH} SELECT doc_id, ord, ord AS s, ord + 1 AS e FROM w",
    "indexes_direct": f"{_WITH} SELECT doc_id, ord, s, e FROM u WHERE layer = 'entities'",
    "indexes_seq": f"{_WITH} SELECT doc_id, ord, ord AS s, ord + 1 AS e FROM spans WHERE layer = 'pos'",
    "indexes_transitive_span": _spans("entities"),
    "indexes_element": _spans("prev"),
    "indexes_div": f"{_WITH} SELECT doc_id, ord, s, e FROM lines",
    "indexes_div_tail": f"{_WITH} SELECT a.doc_id, a.ord // 10 AS ord, a.s, coalesce(b.s, a.e) AS e FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id AND b.ord = a.ord + 10 WHERE a.ord % 10 = 0",
    "indexes_characters": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, CASE WHEN text = '' THEN NULL ELSE CAST(strlen(text) AS BIGINT) END AS last FROM documents WHERE text IS NOT NULL",
    "indexes_data": f"{_WITH} SELECT p.doc_id, p.ord, w.s, w.e, p.datum AS value FROM u p JOIN w ON w.doc_id = p.doc_id AND w.ord = p.ord WHERE p.layer = 'pos'",
    "layer_len": f"""{_WITH}
      SELECT doc_id, layer, count(*) AS n FROM u GROUP BY doc_id, layer
      UNION ALL SELECT doc_id, 'tens', CAST(ceil(n / 10.0) AS BIGINT) FROM n_words
      UNION ALL SELECT doc_id, 'text', CAST(strlen(text) AS BIGINT) FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'lines', count(*) FROM lines GROUP BY doc_id
      UNION ALL SELECT doc_id, 'document', 1 FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, unnest(['lang', 'source']), 1 FROM documents""",
    "q_text": _docs(_some_text("words", "piece = 'the'")),
    "q_text_not": _docs(_some_text("words", "piece <> 'the'")),
    "q_text_characters": _docs("text IS NULL OR text = ''"),
    "q_value": _docs(_some("pos", "datum = 'NUM'")),
    "q_value_not": _docs(_some("entities", "datum IS NULL OR datum <> 'ORG'")),
    "q_lt": _docs(_some("lemma", "datum IS NULL OR datum < 'b'")),
    "q_lte": _docs(_some("entities", "datum IS NULL OR datum <= 'LOC'")),
    "q_gt": _docs(_some("lemma", "datum > 'z'")),
    "q_gte": _docs(_some("prev", "link >= 300")),
    "q_in": _docs(_some("pos", "datum IN ('NUM', 'num')")),
    "q_nin": _docs(_some("entities", "datum IS NULL OR datum NOT IN ('ORG', 'PER')")),
    "q_regex": _docs(_some("lemma", "regexp_matches(datum, '^w.*r$')")),
    "q_text_regex": _docs(_some_text("entities", "regexp_matches(piece, '^[KL]')")),
    "q_and": _docs(_some("pos", "datum = 'NUM'") + " AND " + _some_text("words", "piece = 'the'")),
    "q_or": _docs(_some("entities", "datum = 'PER'") + " OR " + _some("lemma", "datum = 'river'")),
    "q_not": _docs("NOT " + _some("pos", "datum = 'NUM'")),
    "q_exists": _docs(_some("entities", "true")),
    "q_exists_extra": _docs("url IS NOT NULL"),
    "q_characters_none": _docs("text <> ''"),
    "q_missing_layer": _docs("text IS NOT NULL AND NOT " + _some("lemma", "datum IS NULL OR datum <> 'x'")),
    "q_empty": "SELECT doc_id FROM documents",
    "text_freq": f"{_WITH} SELECT piece AS text, count(*) AS freq FROM pieces WHERE layer = 'words' GROUP BY piece",
    "text_freq_in": f"{_WITH} SELECT piece AS text, count(*) AS freq FROM pieces WHERE layer = 'words' AND piece IN ('the', 'a', 'der', 'le') GROUP BY piece",
    "text_freq_where": f"{_WITH} SELECT piece AS text, count(*) AS freq FROM pieces WHERE layer = 'words' AND contains(piece, 'i') GROUP BY piece",
    "val_freq": f"{_WITH} SELECT datum AS value, count(*) AS freq FROM u WHERE layer = 'pos' GROUP BY datum",
    "val_freq_link": f"{_WITH} SELECT '->' || link AS value, count(*) AS freq FROM u WHERE layer = 'prev' GROUP BY link",
    "index_postings": f"{_WITH} SELECT DISTINCT datum AS value, doc_id FROM u WHERE layer = 'pos'",
    "index_search": _docs(_some("pos", "datum = 'NUM'") + " AND (" + _some("lemma", "datum IN ('winter', 'river')") + " OR " + _some("pos", "datum = 'PRON'") + ")"),
    "estimate_count": f"""{_WITH}, p AS (SELECT DISTINCT doc_id, datum FROM u WHERE layer = 'pos')
      SELECT 'value' AS query, count(*) AS n FROM p WHERE datum = 'NUM'
      UNION ALL SELECT 'and', least((SELECT count(*) FROM p WHERE datum = 'NUM'), (SELECT count(DISTINCT doc_id) FROM p WHERE datum IN ('DET', 'NOUN')))
      UNION ALL SELECT 'or', count(DISTINCT doc_id) FROM p WHERE datum IN ('NUM', 'det')
      UNION ALL SELECT 'none', 0
      UNION ALL SELECT 'no index', count(*) FROM documents""",
    "remove_doc": f"WITH {_LATEST} SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM latest WHERE x.op = 'remove' AND doc_id IS NOT NULL)",
    "tokenize": f"WITH {_TOKENS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, CAST(e - strlen(token) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, token FROM placed WHERE NOT regexp_matches(token, '^\\s')",
    "corpus_info": f"""{_WITH}
      SELECT count(*) AS documents, count(text) AS with_text, {', '.join(f"(SELECT count(DISTINCT doc_id) FROM u WHERE layer = '{n}') AS with_{n}" for n in ('words', 'pos', 'lemma', 'entities', 'prev'))},
        count(text) AS with_lines, (SELECT count(*) FROM n_words) AS with_tens, count(text) AS with_document, count(*) AS with_lang, count(*) AS with_source FROM documents""",
    "json_roundtrip": _ROUND,
    "store_roundtrip": _ROUND,
    "stream_roundtrip": f"{_WITH} SELECT sha256(coalesce(d.text, '')) AS hash, n.n AS n_words FROM documents d LEFT JOIN n_words n ON n.doc_id = d.doc_id",
    "link_resolve": f"""{_WITH} SELECT x.doc_id, x.ord, a.piece AS word, b.piece AS linked FROM u x JOIN pieces a ON a.layer = 'prev' AND a.doc_id = x.doc_id AND a.ord = x.ord
      LEFT JOIN pieces b ON b.layer = 'words' AND b.doc_id = x.doc_id AND b.ord = x.link WHERE x.layer = 'prev'""",
    "update_doc": _UPDATED,
    "add_docs": _ADDED,
    "show_doc": _SHOWN,
    "list_ids": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, doc_id FROM documents",
    "set_order": "SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS n, doc_id FROM documents WHERE url IS NOT NULL",
    "layer_descriptions": f"SELECT layer, type, base, data, target, CAST(depth AS BIGINT) AS depth FROM {_LAYERS}",
    "yaml_header": f"SELECT layer, type, base, CAST(0 AS BIGINT) AS documents FROM {_LAYERS} WHERE layer IN ('text', 'words', 'pos', 'lemma', 'entities')",
    **dict.fromkeys(("file_json", "file_yaml", "file_binary", "file_gzip", "file_url", "cli_load_convert", "binary_documents"), _CONTENTS),
    "file_many": f"SELECT hash, n_words, tags FROM ({_CONTENTS})",
    "channel_pipe": f"SELECT id, sha256(coalesce(text, '')) AS hash FROM ({_IDS})",
    "query_builder": _docs(_some("entities", "true") + " AND " + _some("pos", "datum IS NULL OR datum <> 'X'") + " AND (" + _some_text("words", "piece = 'the'") + " OR " + _some("pos", "datum = 'NUM'") + ")"),
    "query_dict": _docs("(" + _some("pos", "datum = 'NUM'") + " OR NOT " + _some("entities", "true") + ") AND " + _some_text("words", "piece <> 'the'") + " AND " + _some("lemma", "regexp_matches(datum, '^w')")),
    "search_order": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, doc_id FROM ({_docs(_some('pos', "datum IN ('NUM', 'PRON')") + ' AND ' + _some('entities', 'true'))})",
    "index_refresh": f"{_WITH}, {_LATEST} SELECT DISTINCT datum AS value, doc_id FROM u WHERE layer = 'pos' AND doc_id NOT IN (SELECT doc_id FROM latest WHERE x.op = 'remove' AND doc_id IS NOT NULL)",
    "index_installed": _docs(_some("lemma", "datum IN ('winter', 'river')")),
    "text_freq_python": f"{_WITH} SELECT piece AS text, count(*) AS freq FROM pieces WHERE layer = 'words' AND piece LIKE '%s' GROUP BY piece",
    "val_freq_in": f"{_WITH} SELECT datum AS value, count(*) AS freq FROM u WHERE layer = 'pos' AND datum IN ('NUM', 'DET') GROUP BY datum",
    "val_freq_where": f"{_WITH} SELECT datum AS value, count(*) AS freq FROM u WHERE layer = 'pos' AND datum LIKE 'A%' GROUP BY datum",
    "array_deltas": f"""{_WITH}, steps AS (SELECT doc_id, ord, s - lag(s, 1, 0) OVER (PARTITION BY doc_id ORDER BY ord) AS step, s > lag(s) OVER (PARTITION BY doc_id ORDER BY ord) AS up FROM w)
      SELECT doc_id, string_agg(CAST(step AS VARCHAR), ',' ORDER BY ord) AS steps, bool_and(coalesce(up, true)) AS rises FROM steps GROUP BY doc_id""",
}
