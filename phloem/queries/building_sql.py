"""SQL of the queries in building."""

from __future__ import annotations

from phloem.operators import docs, extract
from phloem.plans import profiles
from phloem.queries.graph import BASE, RELATION_TEXTS
from phloem.queries.records import _KEYED, _PASSES, _RULES, _UNIT, _any, _bad, _display, _fold, _key, _uuid5

#: What the snippets are taken around.
CUES = ("kéo dài", "kèm", "gọi là")
_EDGE = "[ \\-–—:;,.()\\[\\]{}\\n\\t]+"


def _clean(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')), '^{_EDGE}|{_EDGE}$', '', 'g')"


def _same(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '\\s+', ' ', 'g'))"


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _keys(p: str, source: str, candidates: str, limit: int, keep: str = "TRUE") -> str:
    """CTEs that end in ``p`` = source with a column ``p`` of cleaned keys; ``keep`` is a condition on y.k, the key's form."""
    return f"""
{p}1 AS (SELECT *, list_transform({candidates}, lambda z: {_clean("z")}) AS {p}_v FROM {source}),
{p}2 AS (SELECT *, list_transform({p}_v, lambda z: struct_pack(v := z, k := {_same("z")})) AS {p}_s FROM {p}1),
{p}3 AS (SELECT *, list_filter({p}_s, lambda y: y.v <> '' AND y.k <> '' AND len(string_split(y.v, ' ')) <= 8 AND NOT list_contains({_list(profiles.GENERIC)}, y.k) AND ({keep})) AS {p}_g FROM {p}2),
{p}4 AS (SELECT *, list_transform({p}_g, lambda y: y.k) AS {p}_k FROM {p}3),
{p} AS (SELECT *, list_transform(list_filter({p}_g, lambda y, i: list_position({p}_k, y.k) = i), lambda y: y.v)[1:{limit}] AS {p}_out FROM {p}4)"""


def _hints(x: str) -> str:
    parts = [f"CASE WHEN {_any(_same(x), cues)} THEN {_list(themes)} ELSE [] END" for cues, themes in profiles.HINT_CUES]
    return "flatten([" + ", ".join(parts) + "])"


def _by_type(x: str, known: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in known.items()) + f" ELSE [lower(replace(coalesce({x}, ''), '_', ' '))] END"


def _profiled(source: str, p: str = "") -> str:
    """CTEs over name, forms, texts, descr, entity_type that end in {p}pr with {p}lo_out, {p}gl_out and profile."""
    support = _same("concat_ws(chr(10), coalesce(name, ''), descr, array_to_string(forms, chr(10)), array_to_string(texts, chr(10)))")
    broad = f"list_concat({_by_type('entity_type', profiles.TYPE_KEYS)}, " + _hints("concat_ws(' ', descr, array_to_string(texts, ' '))") + ")"
    return (
        f"{p}s AS (SELECT *, {support} AS support FROM {source}),"
        + _keys(f"{p}lo", f"{p}s", "list_concat([coalesce(name, '')], forms)", 6, "contains(support, y.k)")
        + f", {p}lk AS (SELECT *, list_transform({p}lo_out, lambda z: {_same('z')}) AS norms FROM {p}lo),"
        + _keys(f"{p}gl", f"{p}lk", broad, 5, "len(list_filter(norms, lambda n: y.k = n OR ends_with(y.k, ' ' || n))) = 0")
        + f""", {p}pr AS (SELECT *, concat_ws(chr(10), 'Tên thực thể: ' || {_clean("name")}, 'Loại thực thể: ' || coalesce(entity_type, ''), CASE WHEN {_clean("descr")} <> '' THEN 'Mô tả: ' || {_clean("descr")} END,
  CASE WHEN len({p}lo_out) > 0 THEN 'Local keys: ' || array_to_string({p}lo_out, '; ') END, CASE WHEN len({p}gl_out) > 0 THEN 'Global keys: ' || array_to_string({p}gl_out, '; ') END) AS profile FROM {p}gl)"""
    )


_EVIDENCE = """t AS (SELECT DISTINCT m.entity_id, c.text FROM men m JOIN ch c USING (chunk_id) WHERE c.text <> ''),
evi AS (SELECT entity_id, list(text ORDER BY text) AS texts FROM (SELECT entity_id, text, row_number() OVER (PARTITION BY entity_id ORDER BY text) AS n FROM t) WHERE n <= 5 GROUP BY entity_id),
p0 AS (SELECT e.entity_id, e.name, coalesce(e.surface_forms, []) AS forms, coalesce(v.texts, []) AS texts, coalesce(e.description, '') AS descr, e.entity_type FROM ent e LEFT JOIN evi v USING (entity_id)),"""


def _relation_words(source: str) -> str:
    said = "concat_ws(' ', subject_name, object_name, description, evidence_text)"
    return _keys("rk", source, f"list_concat([coalesce(subject_name, ''), coalesce(object_name, '')], {_by_type('relation_type', profiles.RELATION_KEYS)}, {_hints(said)})", 8)


def _embedded(words: str) -> str:
    part = lambda label, c: f"CASE WHEN coalesce({c}, '') <> '' THEN '{label}' || {c} END"
    joined = f"array_to_string({words}, '; ')"
    return f"concat_ws(chr(10), {part('Quan hệ: ', 'relation_type')}, {part('Subject: ', 'subject_name')}, {part('Object: ', 'object_name')}, {part('Keywords: ', joined)}, {part('Mô tả: ', 'description')}, {part('Bằng chứng: ', 'evidence_text')})"


def _short(x: str, n: int) -> str:
    return f"trim(substring(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '\\*\\*|__', '', 'g'), 1, {n}))"


def _validated(p: str, source: str, items: str, limit: int) -> str:
    blocked = f"({_any('lower(trim(z))', extract.BLOCKED)} OR {_any(_fold('z'), extract.BLOCKED)})"
    return f"""{p}1 AS (SELECT *, list_transform({items}, lambda z: {_short("z", 80)}) AS {p}_v FROM {source}),
{p}2 AS (SELECT *, list_filter({p}_v, lambda z: z <> '' AND {_fold("z")} <> '' AND len(string_split_regex(z, '\\s+')) <= 8 AND NOT {blocked}) AS {p}_g FROM {p}1),
{p}3 AS (SELECT *, list_transform({p}_g, lambda z: {_fold("z")}) AS {p}_k FROM {p}2),
{p} AS (SELECT *, list_filter({p}_g, lambda z, i: list_position({p}_k, {_fold("z")}) = i)[1:{limit}] AS {p}_out FROM {p}3)"""


def _sentences(x: str) -> str:
    lines = f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda z: trim(z)), lambda z: z <> '' AND NOT regexp_matches(z, '^\\[.{{0,79}}\\]|^##'))"
    split = f"regexp_replace(regexp_replace(array_to_string({lines}, ' '), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\s+-\\s+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({split}, chr(1)), lambda z: trim(z)), lambda z: z <> '')"


_JUDGED = f"""WITH ch0 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, text NULLS FIRST, token_count NULLS FIRST) AS rn FROM chunks WHERE deleted_at IS NULL AND chunk_id IS NOT NULL),
c AS (
  SELECT chunk_id, {_sentences("text")} AS st, {_sentences("contextualized_text")} AS cs, coalesce(title, '') AS reference, coalesce(token_count, 0) AS n, CAST('0x' || substr(md5(chunk_id), 1, 6) AS BIGINT) % 40 AS q
  FROM ch0 WHERE rn = 1 AND text IS NOT NULL
),
s AS (SELECT *, list_filter(st, lambda z: len(string_split_regex(z, '\\s+')) >= 3) AS statements, list_filter(cs, lambda z: length(z) % 2 = 0) AS relevant FROM c),
m AS (
  SELECT chunk_id, CAST(len(cs) AS INTEGER) AS n_sentences,
    CASE WHEN len(statements) > 0 THEN len(list_filter(statements, lambda z: length(z) % 3 <> 0)) / len(statements) ELSE 0.0 END AS faithfulness,
    least(1.0, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS answer_relevance,
    CASE WHEN len(cs) > 0 THEN least(len(relevant), len(cs)) / len(cs) ELSE 0.0 END AS context_relevance,
    CAST({_UNIT("CAST(n % 11 AS DOUBLE)")} AS DOUBLE) AS safety, CASE WHEN trim(reference) <> '' THEN CAST({_UNIT("CAST(n % 6 AS DOUBLE)")} AS DOUBLE) ELSE 0.0 END AS answer_correctness
  FROM s JOIN embeddings a ON a.vec_id = s.q JOIN embeddings b ON b.vec_id = s.q + 1
),
j AS (SELECT *, (faithfulness + answer_relevance + context_relevance) / 3 AS overall FROM m),
v AS (SELECT *, CASE WHEN safety < 0.5 THEN 'fail' WHEN overall >= 0.75 THEN 'pass' WHEN overall >= 0.5 THEN 'borderline' ELSE 'fail' END AS verdict FROM j)
"""
_SCORES = ("faithfulness", "answer_relevance", "context_relevance", "safety", "answer_correctness")


def _id(kind: str, name: str) -> str:
    return f"'entity_' || substr(md5(coalesce({kind}, '') || ':' || coalesce({_key(name)}, '')), 1, 12)"


_RECORDS = (
    BASE
    + f""", {_RULES},
raw AS (SELECT DISTINCT relation_id, subject_entity_id, object_entity_id, upper(trim(relation_type)) AS relation_type, description, keywords, evidence_text, confidence FROM relations),
met AS MATERIALIZED (
  SELECT ev.chunk_id, s.name AS sname, coalesce(s.name, '') AS subj, s.entity_type AS subject_type, r.relation_type, coalesce(o.name, '') AS obj, o.entity_type AS object_type, r.description, r.keywords, r.evidence_text, r.confidence
  FROM raw r JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id JOIN ev ON ev.relation_id = r.relation_id WHERE ev.chunk_id IN (SELECT chunk_id FROM ch)
),
okc AS MATERIALIZED (SELECT DISTINCT chunk_id, CAST('0x' || substr(md5(chunk_id), 1, 6) AS BIGINT) % 50 <> 0 AS ok FROM met),
rr AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY subj, subject_type NULLS FIRST, relation_type NULLS FIRST, obj, object_type NULLS FIRST, description NULLS FIRST, keywords NULLS FIRST, evidence_text NULLS FIRST, confidence NULLS FIRST) - 1 AS seq
  FROM met JOIN okc USING (chunk_id) WHERE ok
),
d0 AS (SELECT chunk_id, seq, trim(relation_type) AS relation_type, trim(subject_type) AS subject_type, trim(object_type) AS object_type, trim(evidence_text) AS evidence_text, {_display("subj")} AS subject, {_display("obj")} AS object, description, confidence FROM rr),
{_KEYED},
vr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, subject_key, subject_type, relation_type, object_key, object_type ORDER BY seq) AS rn FROM d1 WHERE {_PASSES}) WHERE rn = 1),
er AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY sname NULLS FIRST, entity_type NULLS FIRST, description NULLS FIRST, evidence_text NULLS FIRST) - 1 AS seq
  FROM (SELECT DISTINCT chunk_id, sname, subject_type AS entity_type, description, evidence_text FROM rr)
),
en AS (SELECT *, {_display("sname")} AS name FROM er),
ge AS MATERIALIZED (SELECT *, {_fold("name")} AS key FROM en WHERE entity_type IN ({", ".join(f"'{x}'" for x in extract.schema.ENTITY_TYPES)}) AND NOT {_bad("name")}),
ends AS (SELECT chunk_id, subject AS name, subject_type AS entity_type, evidence_text, seq FROM vr UNION ALL SELECT chunk_id, object, object_type, evidence_text, seq FROM vr),
ek AS (SELECT *, {_fold("name")} AS key FROM ends),
mi AS (
  SELECT chunk_id, name, entity_type, '' AS description, seq + 1000000 AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id, key, entity_type ORDER BY seq, name) AS rn FROM ek WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.chunk_id = ek.chunk_id AND ge.key = ek.key AND ge.entity_type = ek.entity_type)
  ) WHERE rn = 1
),
al AS (SELECT chunk_id, name, entity_type, description, seq FROM ge UNION ALL SELECT * FROM mi),
ai AS (SELECT *, {_id("entity_type", "name")} AS entity_id FROM al),
pc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, entity_id ORDER BY seq) AS rn FROM ai) WHERE rn = 1),
ie AS MATERIALIZED (
  SELECT entity_id, arg_min(name, chunk_id) FILTER (trim(coalesce(name, '')) <> '') AS name, min(entity_type) AS entity_type, arg_min(description, chunk_id) FILTER (trim(coalesce(description, '')) <> '') AS description, count(*) AS mention_count, list_sort(list(DISTINCT name)) AS surface_forms
  FROM pc GROUP BY entity_id
),
wi AS (SELECT v.*, c.section, c.source_url, v.subject AS subject_name, v.object AS object_name, {_id("subject_type", "v.subject")} AS subject_entity_id, {_id("object_type", "v.object")} AS object_entity_id FROM vr v JOIN ch c USING (chunk_id)),
wr AS (SELECT *, 'relation_' || substr(md5(subject_entity_id || ':' || relation_type || ':' || object_entity_id), 1, 12) AS relation_id FROM wi),"""
    + _relation_words("wr")
    + """,
ir AS MATERIALIZED (
  SELECT relation_id, min(subject_entity_id) AS subject_entity_id, min(object_entity_id) AS object_entity_id, min(relation_type) AS relation_type, coalesce(max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END), 1.0) AS confidence,
    list_sort(list(DISTINCT chunk_id)) AS chunks, list_sort(list_distinct(flatten(list(rk_out)))) AS keywords,
    arg_min(description, struct_pack(c := chunk_id, s := seq)) FILTER (trim(coalesce(description, '')) <> '') AS description, arg_min(evidence_text, struct_pack(c := chunk_id, s := seq)) FILTER (trim(coalesce(evidence_text, '')) <> '') AS evidence_text
  FROM rk GROUP BY relation_id
)
"""
)


def _line_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


def _tidied(lines: str) -> str:
    return f"regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def _promotes(x: str) -> str:
    known = "(?i)" + "|".join(docs.PLAIN_HEADINGS)
    short = f"trim(z) <> '' AND NOT starts_with(trim(z), '#') AND {_line_words('trim(z)')} <= 14"
    return _tidied(f"list_transform(string_split({x}, chr(10)), lambda z: CASE WHEN {short} AND regexp_matches(trim(z), '{known}') THEN '## ' || trim(z) WHEN {short} AND regexp_matches(trim(z), '^\\d+\\.\\s+.+') THEN '### ' || trim(z) ELSE z END)")


def _cuts(x: str) -> str:
    at = "least(" + ", ".join(f"coalesce(nullif(strpos({x}, '{m}'), 0), 2000000000)" for m in docs.STOPS) + ")"
    return f"regexp_replace(CASE WHEN {at} < 2000000000 THEN substring({x}, 1, CAST({at} - 1 AS BIGINT)) ELSE {x} END, '^\\s+|\\s+$', '', 'g')"


def _heads(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '^#{{1,6}}\\s+', ''), '[*_]', '', 'g'), '\\s+', ' ', 'g')))"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_KEPT_LINES = _tidied(f"list_transform(kept, lambda z: CASE WHEN {_collapsed('z')} = '' THEN '' ELSE z END)")
_INTRO = f"""WITH a AS (SELECT DISTINCT item_id, coalesce(title, '') AS title, markdown FROM article_items WHERE markdown IS NOT NULL),
b AS (SELECT *, {_heads("title")} AS head, string_split(markdown, chr(10)) AS lines FROM a),
c AS (SELECT *, list_position(list_transform(lines, lambda z, i: head <> '' AND i <= 20 AND {_heads("z")} = head), true) AS pos FROM b),
d AS (SELECT *, list_filter(lines, lambda z, i: NOT (i = coalesce(pos, 0) OR (i <= 30 AND regexp_matches({_collapsed("z")}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$')) OR (i <= 60 AND list_contains({_list(docs.USELESS_LINES)}, {_collapsed("z")})))) AS kept FROM c),
e AS MATERIALIZED (SELECT item_id, title, head, {_KEPT_LINES} AS text FROM d)
"""
_LIVE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, text NULLS FIRST, token_count NULLS FIRST) AS rn FROM chunks WHERE deleted_at IS NULL AND chunk_id IS NOT NULL) WHERE rn = 1)"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in (*_SCORES, "overall"))
_STARTS = "list_filter([" + ", ".join(f"strpos(lower(text), '{c}')" for c in CUES) + "], lambda z: z > 0)"
_NAMES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profiles.RELATION_NAMES.items()) + " ELSE lower(kind) END"

SQL = {
    "entity_profiles": BASE + f", {_EVIDENCE} {_profiled('p0')} SELECT entity_id, array_to_string(lo_out, '|') AS local_keys, array_to_string(gl_out, '|') AS global_keys, md5(profile) AS profile FROM pr",
    "relation_profiles": BASE + f", {RELATION_TEXTS}, {_relation_words('v')} SELECT relation_id, array_to_string(rk_out, '|') AS keywords FROM rk",
    "regenerated_relations": BASE + f", {RELATION_TEXTS}, v2 AS (SELECT * EXCLUDE keywords, list_sort(keywords) AS old FROM v), {_relation_words('v2')} SELECT relation_id, md5({_embedded('rk_out')}) AS embedded FROM rk WHERE NOT coalesce(list_sort(rk_out) = old, false)",
    "validated_keywords": BASE + f""", r AS (
  SELECT DISTINCT r.relation_id, r.keywords, upper(trim(r.relation_type)) AS kind, s.name AS subject, o.name AS object FROM relations r JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id WHERE r.relation_id IS NOT NULL
), {_validated("cl", "r", "list_concat(coalesce(keywords, []), ['bác sĩ', ' **ho  khan** '])", 3)},
{_validated("fb", "cl", f"[subject, object, {_NAMES}]", 10)}
SELECT DISTINCT relation_id, array_to_string(cl_out, '|') AS clean, array_to_string(fb_out, '|') AS fallback FROM fb""",
    "judged_answers": _JUDGED + f"SELECT chunk_id, n_sentences, {_ROUNDED}, verdict FROM v",
    "judge_summary": _JUDGED + "SELECT verdict, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _SCORES) + " FROM v GROUP BY verdict",
    "cue_snippets": f"""WITH a AS (SELECT chunk_id, text, list_sort(list_distinct({_STARTS}))[1:3] AS starts FROM {_LIVE} WHERE text IS NOT NULL),
b AS (SELECT chunk_id, list_transform(starts, lambda p: trim(regexp_replace(substring(text, CAST(greatest(1, p - 40) AS BIGINT), {80 + max(map(len, CUES))}), '\\s+', ' ', 'g'))) AS s FROM a WHERE len(starts) > 0)
SELECT chunk_id, CAST(len(s) AS INTEGER) AS n, array_to_string(s, '|') AS snippets FROM b""",
    "cue_flags": f"""WITH a AS (SELECT chunk_id, {_fold("coalesce(text, '')")} AS said FROM {_LIVE}) SELECT chunk_id, {_any("said", extract.SYNONYM_FOR)} AS says_synonym, {_any("said", ("nguyen nhan", "bien chung"))} AS watched FROM a""",
    "ingest_entities": _RECORDS + f"SELECT entity_id, name, {_key('name')} AS normalized_name, entity_type, mention_count, array_to_string(surface_forms, '|') AS surface_forms FROM ie",
    "ingest_relations": _RECORDS + "SELECT relation_id, subject_entity_id, object_entity_id, relation_type, confidence, array_to_string(chunks, '|') AS chunks, array_to_string(keywords, '|') AS keywords FROM ir",
    "ingest_mentions": _RECORDS + "SELECT chunk_id, entity_id, 1.0 AS confidence FROM pc",
    "ingest_stats": _RECORDS + """, a AS (SELECT chunk_id, count(*) AS raw_relations, count(*) FILTER (relation_type = 'DONG_NGHIA_VOI') AS synonym_relations, count(*) FILTER (coalesce(len(keywords), 0) = 0) AS without_keywords FROM rr GROUP BY chunk_id),
b AS (SELECT chunk_id, count(*) AS raw_entities FROM er GROUP BY chunk_id), c AS (SELECT chunk_id, count(*) AS entity_writes FROM pc GROUP BY chunk_id), e AS (SELECT chunk_id, count(*) AS relation_writes FROM vr GROUP BY chunk_id)
SELECT h.article_id, count(*) AS chunks, count(*) FILTER (NOT coalesce(k.ok, false)) AS failed_chunks, CAST(sum(coalesce(raw_entities, 0)) AS BIGINT) AS raw_entities, CAST(sum(coalesce(raw_relations, 0)) AS BIGINT) AS raw_relations, CAST(sum(coalesce(synonym_relations, 0)) AS BIGINT) AS synonym_relations,
  CAST(sum(coalesce(without_keywords, 0)) AS BIGINT) AS without_keywords, CAST(sum(coalesce(entity_writes, 0)) AS BIGINT) AS entity_writes, CAST(sum(coalesce(relation_writes, 0)) AS BIGINT) AS relation_writes
FROM ch h LEFT JOIN okc k USING (chunk_id) LEFT JOIN a USING (chunk_id) LEFT JOIN b USING (chunk_id) LEFT JOIN c USING (chunk_id) LEFT JOIN e USING (chunk_id) GROUP BY h.article_id""",
    "ingest_points": _RECORDS + f""", p0 AS (SELECT entity_id, name, surface_forms AS forms, [] :: VARCHAR[] AS texts, coalesce(description, '') AS descr, entity_type FROM ie), {_profiled("p0", "x")},
et AS (SELECT 'entity' AS kind, entity_id AS ref_id, concat_ws(chr(10), profile, CASE WHEN len(forms) > 0 THEN 'Cách gọi trong văn bản: ' || array_to_string(forms[1:8], '; ') END) AS text FROM xpr),
rn AS (SELECT r.*, s.name AS subject_name, o.name AS object_name FROM ir r JOIN ie s ON s.entity_id = r.subject_entity_id JOIN ie o ON o.entity_id = r.object_entity_id),
rt AS (SELECT 'relation' AS kind, relation_id AS ref_id, {_embedded("keywords")} AS text FROM rn),
pt AS (SELECT 'chunk' AS kind, chunk_id AS ref_id, coalesce(nullif(contextualized_text, ''), text) AS text FROM ch UNION ALL SELECT * FROM et UNION ALL SELECT * FROM rt)
SELECT {_uuid5("kind || '::' || ref_id")} AS point_id, kind, ref_id, md5(text) AS text FROM pt WHERE trim(coalesce(text, '')) <> ''""",
    "naive_backfill": f"SELECT {_uuid5('concat(' + chr(39) + 'naive::' + chr(39) + ', chunk_id)')} AS point_id, chunk_id AS ref_id, md5(text) AS text FROM {_LIVE} WHERE trim(coalesce(text, '')) <> ''",
    "article_chunks": BASE + "SELECT a.article_id, any_value(a.title) AS title, count(c.chunk_id) AS n_chunks, max(c.chunk_index) AS last_index FROM art a LEFT JOIN ch c USING (article_id) GROUP BY a.article_id",
    "promoted_headings": f"WITH a AS (SELECT DISTINCT item_id, markdown FROM article_items WHERE markdown IS NOT NULL) SELECT item_id, md5({_promotes('markdown')}) AS promoted FROM a",
    "cut_pages": f"WITH a AS (SELECT DISTINCT item_id, markdown FROM article_items WHERE markdown IS NOT NULL) SELECT item_id, CAST(length({_cuts('markdown')}) AS INTEGER) AS n_chars FROM a",
    "intro_lines": _INTRO + "SELECT item_id, md5(text) AS text FROM e",
}
