"""DuckDB counterparts of the registered queries, put together from named pieces."""

from __future__ import annotations

from waraq.functions.distance import PAIRS
from waraq.functions.rules import ALLOWED_VERBS, ARABIC_RUN, BADGES, CONJUNCTION_HIGH, CONJUNCTION_LOW, CORRECTIONS, DEFAULT_MODEL, KEPT_AFTER_AAL, KEPT_AFTER_MAL, LIGATURES, MARK_CLOSE, MARK_OPEN, OTHER_BADGE, TASHKEEL, UNIFIED_FROM, UNIFIED_TO, VERSION, VISION_MODELS
from waraq.sources.surrogate import ARABIC, LATIN

_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _sur(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{ARABIC}')"


def _norm(x: str) -> str:
    return f"translate({x}, '{UNIFIED_FROM}{TASHKEEL}', '{UNIFIED_TO}')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_SPACE}]+'), lambda w: w <> '')"


def _solid(x: str) -> str:
    return f"length(regexp_replace({x}, '[{_SPACE}]+', '', 'g'))"


def _kind(x: str) -> str:
    return f"CASE WHEN {_solid(x)} > 50 THEN 'native' ELSE 'scan' END"


# Tables by name, in order of dependence; _with() puts those needed before a query.

_LINES = f"lines AS (SELECT doc_id AS seq, string_split({_sur('coalesce(text, $$$$)')}, chr(10)) AS l FROM documents)"
_RAW = "raw AS (SELECT CAST(seq AS VARCHAR) AS doc_id, seq, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS page, unnest(l) AS raw_text FROM lines)"
_PAGES = f"pages_ AS (SELECT *, {_kind('raw_text')} AS type, {_strip('raw_text')} AS text FROM raw)"
_INDEX = f"idx AS (SELECT doc_id, seq, page, text, {_norm('text')} AS norm_text FROM pages_ WHERE length({_strip('text')}) >= 5)"
_TOKEN_LISTS = f"token_lists AS (SELECT doc_id, seq, page, regexp_extract_all(text, '{ARABIC_RUN}') AS t FROM idx)"
_TOKENS = f"toks AS (SELECT * FROM (SELECT doc_id, seq, page, pos, surface, {_norm('surface')} AS norm FROM (SELECT doc_id, seq, page, CAST(unnest(generate_series(0, len(t) - 1)) AS INTEGER) AS pos, unnest(t) AS surface FROM token_lists)) WHERE length(norm) >= 2)"
_FORMS = "forms AS (SELECT norm, surface, count(*) AS cnt, min((seq, page, pos)) AS first_seq FROM toks GROUP BY norm, surface)"
_VOCAB = "vocab AS (SELECT norm, CAST(sum(cnt) AS BIGINT) AS n, arg_min(surface, (-cnt, first_seq)) AS best_form, min(first_seq) AS first_seq FROM forms GROUP BY norm)"
_SUMMARY = "summary AS (SELECT doc_id, count(*) AS nb_pages, count(*) FILTER (type = 'native') AS n_native, count(*) FILTER (type <> 'native') AS n_scan FROM pages_ GROUP BY doc_id)"
_UPLOADS = "uploads AS (SELECT doc_id AS seq, md5(coalesce(text, '')) AS doc_id, source || '.PDF' AS filename, coalesce(text, '') AS content FROM documents)"
_DOCS = "docs AS (SELECT CAST(u.seq AS VARCHAR) AS doc_id, u.filename, s.nb_pages, u.seq AS first_seq FROM uploads u JOIN summary s ON s.doc_id = CAST(u.seq AS VARCHAR))"
_LOG = f"qlog AS (SELECT item_id AS query_id, {_sur('''array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 2, 5), ' ')''')} AS query FROM benchmark)"
_MISSPELT = "misspelt AS (SELECT query_id, substr(query, 1, 1) || substr(query, 3) AS query FROM qlog UNION ALL SELECT -1, 'القاعضي abc' UNION ALL SELECT -2, ' رمق  مالحظات ')"
_CORRECTIONS = "corrections AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}', '{r}')" for i, (w, r) in enumerate(CORRECTIONS)) + ') AS t(ord, wrong, "right"))'
_DICT = f"""dict AS (SELECT {_norm("wrong")} AS nw, arg_min("right", ord) AS "right" FROM corrections GROUP BY 1)"""


def _asked(name: str, source: str) -> str:
    return f"{name} AS (SELECT query_id, pos, word, {_norm('word')} AS nw, regexp_matches(word, '^{ARABIC_RUN}') AS arabic FROM (SELECT query_id, CAST(unnest(generate_series(0, len(w) - 1)) AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT query_id, {_words('query')} AS w FROM {source})))"


_ASKED = _asked("asked", "misspelt")
_PAIR_LIST = "[" + ", ".join(f"'{p}'" for p in PAIRS) + "]"


def _distance(a: str, b: str) -> str:
    """One row of the table is carried over the letters of a; each row is built over the letters of b."""
    cost = f"CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN 0.0 WHEN list_contains({_PAIR_LIST}, substr({a}, i, 1) || substr({b}, j, 1)) THEN 0.5 ELSE 1.0 END"
    first = f"list_transform(generate_series(0, length({b})), lambda x: CAST(x AS DOUBLE))"
    # each element of the fold is a list; those of numbers carry the letter's place as their only entry
    inner = (
        f"list_reduce(list_transform(generate_series(1, length({b})), lambda j: [CAST(j AS DOUBLE), CAST(({cost}) AS DOUBLE)]), "
        "lambda new, x: list_append(new, least(row[CAST(x[1] AS INTEGER) + 1] + 1, new[CAST(x[1] AS INTEGER)] + 1, row[CAST(x[1] AS INTEGER)] + x[2])), [row[1] + 1])"
    )
    inner = inner.replace("substr(" + a + ", i, 1)", f"substr({a}, CAST(step[1] AS INTEGER), 1)")
    rows = f"list_reduce(list_transform(generate_series(1, length({a})), lambda i: [CAST(i AS DOUBLE)]), lambda row, step: {inner}, {first})"
    return f"CASE WHEN abs(length({a}) - length({b})) > 3 THEN 999.0 ELSE ({rows})[length({b}) + 1] END"


_NEAR = f"near AS (SELECT u.nw, v.best_form, v.first_seq, {_distance('u.nw', 'v.norm')} AS dist FROM (SELECT DISTINCT nw FROM asked WHERE arabic AND nw NOT IN (SELECT norm FROM vocab)) u JOIN vocab v ON abs(length(v.norm) - length(u.nw)) <= 2 AND levenshtein(u.nw, v.norm) <= 8)"
_CLOSEST = "closest AS (SELECT nw, arg_min(best_form, (dist, first_seq)) AS closest, CAST(min(dist) AS DOUBLE) AS dist FROM near WHERE dist <= 2.0 GROUP BY nw)"
_FIXES = """fixes AS (
    SELECT a.query_id, a.pos, CASE WHEN NOT a.arabic THEN a.word ELSE coalesce(v.best_form, d."right", c.closest, a.word) END AS taken,
           a.arabic AND v.norm IS NULL AND coalesce(d."right", c.closest) IS NOT NULL AS fixed
    FROM asked a LEFT JOIN vocab v ON a.nw = v.norm LEFT JOIN dict d ON a.nw = d.nw LEFT JOIN closest c ON a.nw = c.nw)"""
_CORRECTED = f"corrected AS (SELECT m.query_id, {_strip('m.query')} AS query, f.correction, coalesce(f.correction, {_strip('m.query')}) AS effective FROM misspelt m LEFT JOIN (SELECT query_id, CASE WHEN bool_or(fixed) THEN string_agg(taken, ' ' ORDER BY pos) END AS correction FROM fixes GROUP BY query_id) f USING (query_id))"


def _line(raw: str, norm: str, nq: str) -> str:
    hit = f"list_filter(list_transform(string_split({raw}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '' AND contains({_norm('x')}, {nq}))[1]"
    at = f"(CASE WHEN {nq} = '' THEN 1 ELSE strpos({norm}, {nq}) END)"
    start, end = f"greatest(0, {at} - 81)", f"least(length({raw}), {at} - 1 + length({nq}) + 80)"
    return f"coalesce(substr({hit}, 1, 300), CASE WHEN {at} > 0 THEN substr(replace(substr({raw}, CAST({start} + 1 AS BIGINT), CAST(greatest(0, {end} - {start}) AS BIGINT)), chr(10), ' '), 1, 300) END, '')"


def _hits(source: str) -> str:
    return f"hits AS (SELECT q.query_id, i.doc_id, i.page, {_line('i.text', 'i.norm_text', 'q.nq')} AS line FROM (SELECT query_id, {_norm('effective')} AS nq FROM {source} WHERE {_strip('effective')} <> '') q JOIN idx i ON contains(i.norm_text, q.nq))"


_LOG_EFFECTIVE = f"eff AS (SELECT query_id, {_strip('query')} AS effective FROM qlog)"
_RESULTS = "results AS (SELECT h.query_id, h.doc_id, d.filename, d.nb_pages, d.first_seq, count(*) AS n_matches, list((h.page, h.line) ORDER BY h.page) AS matches FROM hits h JOIN docs d USING (doc_id) GROUP BY ALL)"


def _suggest(prefixes: str, limit: int) -> str:
    return (
        f"sug AS (SELECT prefix, rank, suggestion, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prefix ORDER BY n DESC, first_seq) AS INTEGER) AS rank FROM "
        f"(SELECT p.prefix, v.best_form AS suggestion, arg_min(v.n, v.first_seq) AS n, min(v.first_seq) AS first_seq FROM (SELECT DISTINCT prefix FROM {prefixes} WHERE length(prefix) >= 2) p "
        f"JOIN vocab v ON v.n >= 2 AND starts_with(v.norm, {_norm('p.prefix')}) GROUP BY 1, 2)) WHERE rank <= {limit})"
    )


_PER_QUERY = "per_query AS (SELECT query_id, list_slice(list(suggestion ORDER BY place), 1, 8) AS suggestions FROM (SELECT a.query_id, s.suggestion, min((a.pos, s.rank)) AS place FROM asked a JOIN sug s ON a.word = s.prefix WHERE a.arabic GROUP BY 1, 2) GROUP BY query_id)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


_TO_INDEX = (_LINES, _RAW, _PAGES, _INDEX)
_TO_FORMS = (*_TO_INDEX, _TOKEN_LISTS, _TOKENS, _FORMS)
_TO_VOCAB = (*_TO_FORMS, _VOCAB)
_TO_DOCS = (*_TO_INDEX, _SUMMARY, _UPLOADS, _DOCS)

NORMALIZE_TEXT = f"SELECT doc_id, {_norm(_sur('text'))} AS norm_text FROM documents"
STRIP_TEXT = _with(_LINES, _RAW, f"SELECT doc_id, page, {_strip('raw_text')} AS text FROM raw")
TOKENIZE = _with(*_TO_INDEX, _TOKEN_LISTS, _TOKENS, "SELECT doc_id, page, pos, surface, norm FROM toks")
_DOC_TYPE = "CASE WHEN n_native = 0 THEN 'scan' WHEN n_scan = 0 THEN 'native' ELSE 'mixed' END"
PAGE_CLASSIFY = _with(_LINES, _RAW, _PAGES, "SELECT doc_id, page, type FROM pages_")
DOC_SUMMARY = _with(_LINES, _RAW, _PAGES, _SUMMARY, f"SELECT *, {_DOC_TYPE} AS doc_type FROM summary")
SCAN_PAGES = _with(_LINES, _RAW, _PAGES, "SELECT doc_id, count(*) AS n_pages, min(page) AS first_page FROM pages_ WHERE type = 'scan' GROUP BY doc_id")
MD5_IDENTITY = _with(_UPLOADS, "SELECT doc_id, count(*) AS uploads, min(seq) AS first_seq, max(seq) AS last_seq FROM uploads GROUP BY doc_id")
LATEST_UPLOAD = _with(_UPLOADS, "SELECT filename, seq, doc_id, CAST(strlen(content) AS BIGINT) AS bytes FROM uploads QUALIFY row_number() OVER (PARTITION BY filename ORDER BY seq DESC) = 1")
_TURNS = f"turns AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id AS seq, CAST(turn + 1 AS INTEGER) AS page, {_sur('text')} AS raw_text FROM conversations)"
_TURN_PAGES = f"tp AS (SELECT *, {_strip('raw_text')} AS text FROM turns)"
CACHE_OVERLAY = _with(_TURNS, _TURN_PAGES, "SELECT doc_id, page, CASE WHEN seq % 2 = 0 AND page % 2 = 1 THEN CASE WHEN page % 3 = 0 THEN NULL ELSE reverse(text) END ELSE text END AS text, seq % 2 = 0 AND page % 2 = 1 AS from_cache FROM tp")
CACHE_MISSES = _with(_TURNS, "SELECT doc_id, page FROM turns WHERE doc_id NOT IN (SELECT doc_id FROM turns WHERE seq % 2 = 0 AND page = 1)")
OCR_FALLBACK = _with(
    _TURNS,
    "made AS (SELECT doc_id, page, CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '[ERR engine: no image]' WHEN 2 THEN '' ELSE raw_text END AS a, CASE page % 4 WHEN 0 THEN '[ERR model: timeout]' WHEN 1 THEN NULL ELSE reverse(raw_text) END AS b FROM turns)",
    "taken AS (SELECT doc_id, page, CASE WHEN a IS NULL OR starts_with(a, '[ERR') THEN b ELSE a END AS t FROM made)",
    "__CASCADE__",
)
PICK_MODEL = f"SELECT n_nationkey, coalesce(list_filter([{', '.join(repr(m) for m in VISION_MODELS)}], lambda m: (m = 'qwen3-vl:4b' AND n_nationkey % 3 = 0) OR (m = 'qwen2.5vl:7b' AND n_nationkey % 2 = 0))[1], '{DEFAULT_MODEL}') AS model FROM nation"
_EXPORT = "SELECT doc_id, string_agg('=== صفحة ' || page || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text FROM {} GROUP BY doc_id"
EXPORT_INDEXED = _with(*_TO_INDEX, _EXPORT.format("idx"))
EXPORT_ALL = _with(_LINES, _RAW, _PAGES, _EXPORT.format("pages_"))
UPLOAD_RESPONSE = _with(
    _TURNS,
    f"tp AS (SELECT *, {_kind('raw_text')} AS type, {_strip('raw_text')} AS text FROM turns)",
    "s AS (SELECT doc_id, count(*) AS nb_pages, count(*) FILTER (type = 'native') AS n_native, count(*) FILTER (type <> 'native') AS n_scan FROM tp GROUP BY doc_id)",
    f"SELECT doc_id, doc_id || '.pdf' AS filename, nb_pages, n_scan, {_DOC_TYPE} AS doc_type, page AS num, type, text, CASE WHEN page % 2 = 1 THEN base64(encode(raw_text)) ELSE '' END AS preview_b64 FROM tp JOIN s USING (doc_id)",
)

INDEX_PAGES = _with(*_TO_INDEX, "SELECT doc_id, page, text, norm_text FROM idx")
SURFACE_COUNTS = _with(*_TO_FORMS, "SELECT norm, surface, cnt FROM forms")
VOCAB_TOTALS = _with(*_TO_FORMS, "SELECT norm, CAST(sum(cnt) AS BIGINT) AS n, min(first_seq)[1] AS first_doc, min(first_seq)[2] AS first_page, min(first_seq)[3] AS first_pos FROM forms GROUP BY norm")
BEST_FORM = _with(*_TO_VOCAB, "SELECT norm, best_form FROM vocab")
VOCABULARY_VIEW = _with(*_TO_FORMS, "SELECT norm, CAST(sum(cnt) OVER (PARTITION BY norm) AS BIGINT) AS n, surface, cnt FROM forms")
PAGE_MAPS = _with(*_TO_INDEX, "SELECT doc_id, CAST(page AS VARCHAR) AS page, text, norm_text FROM idx")
STATS = _with(*_TO_VOCAB, _SUMMARY, _UPLOADS, _DOCS, "SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM vocab) AS words, (SELECT CAST(coalesce(sum(nb_pages), 0) AS BIGINT) FROM docs) AS pages")
LIST_DOCUMENTS = _with(
    _UPLOADS,
    "state AS (SELECT doc_id, arg_max(filename, seq) AS filename, max(seq) AS last_seq, min(seq) AS first_seq, CAST(len(string_split(any_value(content), chr(10))) AS BIGINT) AS nb_pages FROM uploads GROUP BY doc_id)",
    "SELECT doc_id, filename, nb_pages, strftime(make_timestamp((1700000000 + last_seq) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') AS indexed, first_seq, strftime(make_timestamp((1700000000 + last_seq) * 1000000), '%Y-%m-%d') AS day FROM state",
)
BADGE_CASE = (
    "SELECT c_custkey, filename, CASE "
    + " ".join(f"WHEN contains(lower(filename), '{w}') THEN '{label}'" for w, label in BADGES)
    + f" ELSE '{OTHER_BADGE}' END AS badge FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ظهير ' WHEN 1 THEN 'قرار مرسوم ' WHEN 2 THEN 'قرار ' ELSE '' END || c_name || '.PDF' AS filename FROM customer)"
)
PAGE_LABELS = _with(_LINES, _RAW, _PAGES, "SELECT doc_id, page, CASE WHEN type = 'native' THEN 'أصلي' ELSE 'OCR' END AS label, replace(text, chr(10), '<br>') AS html FROM pages_")
DELETE_ANTIJOIN = _with(*_TO_INDEX, "SELECT doc_id, count(*) AS pages FROM idx WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0) GROUP BY doc_id")
DELETE_READD = _with(_UPLOADS, "gone AS (SELECT doc_id, max(seq) AS gone FROM uploads WHERE seq % 10 = 0 GROUP BY doc_id)", "SELECT doc_id, min(seq) AS first_seq, count(*) AS uploads FROM uploads LEFT JOIN gone USING (doc_id) WHERE gone IS NULL OR seq > gone GROUP BY doc_id")
HEALTH = f"SELECT 'ok' AS status, '{VERSION}' AS version, count(*) AS documents FROM documents"
_LIVE = "gone AS (SELECT doc_id, max(seq) AS gone FROM uploads WHERE seq % 10 = 0 GROUP BY doc_id), current AS (SELECT doc_id, max(seq) AS seq FROM uploads LEFT JOIN gone USING (doc_id) WHERE gone IS NULL OR seq > gone GROUP BY doc_id)"
GROWN_PAGES = _with(*_TO_INDEX, _UPLOADS, _LIVE, "SELECT c.doc_id, c.seq, i.page, i.text, i.norm_text FROM current c JOIN idx i USING (seq)")
GROWN_VOCABULARY = _with(*_TO_VOCAB, "SELECT norm, n, best_form FROM vocab")
DOCUMENT_STREAM = _with(
    _UPLOADS,
    "state AS (SELECT doc_id, max(seq) AS seq, arg_max(filename, seq) AS filename, count(*) AS uploads, max(seq) FILTER (seq % 10 = 0) AS gone FROM uploads GROUP BY doc_id)",
    "SELECT doc_id, seq * 2 AS seq, filename, uploads, gone IS NULL OR seq > gone AS live FROM state",
)

EDIT_DISTANCE_PAIRS = _with(_LOG, _asked("asked", "qlog"), "w AS (SELECT DISTINCT nw FROM asked)", f"SELECT x.nw AS a, y.nw AS b, CAST({_distance('x.nw', 'y.nw')} AS DOUBLE) AS dist FROM w x JOIN w y ON substr(x.nw, 1, 1) = substr(y.nw, 1, 1)")


def _marked(text: str, query: str) -> str:
    """For each query word, each distinct equal token in order of first occurrence is marked once."""
    tokens = f"regexp_extract_all(state, '{ARABIC_RUN}')"
    equal = f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i AND {_norm('t')} = {_norm('word')})"
    mark = f"CASE WHEN strpos(s, t) > 0 THEN substr(s, 1, strpos(s, t) - 1) || '{MARK_OPEN}' || t || '{MARK_CLOSE}' || substr(s, strpos(s, t) + length(t)) ELSE s END"
    return f"list_reduce({_words(query)}, lambda state, word: list_reduce({equal}, lambda s, t: {mark}, state), {text})"


HIGHLIGHT = _with(_LOG, f"SELECT b.item_id AS query_id, {_marked('b.t', 'q.query')} AS marked FROM (SELECT item_id, {_sur('text')} AS t FROM benchmark) b JOIN qlog q ON b.item_id = q.query_id")

PHRASE_SEARCH = _with(*_TO_DOCS, "eff AS (SELECT 1 AS query_id, 'لح موا' AS effective)", _hits("eff"), _RESULTS, "SELECT doc_id, filename, nb_pages, n_matches, matches[1][1] AS first_page, matches[1][2] AS first_line FROM results")
BATCH_SEARCH = _with(*_TO_INDEX, _LOG, _LOG_EFFECTIVE, _hits("eff"), "SELECT query_id, doc_id, page, line FROM hits")
EXCERPT_WINDOW = _with(
    f"pages_ AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS seq, 1 AS page, coalesce({_sur('text')}, '') AS text FROM documents)",
    _INDEX,
    "eff AS (SELECT 1 AS query_id, '.' || chr(10) || 'وا' AS effective UNION ALL SELECT 2, 'م' || chr(10) || 'م')",
    _hits("eff"),
    "SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, line FROM hits",
)
RANKED_DOCS = _with(
    *_TO_DOCS,
    "eff AS (SELECT * FROM (VALUES (1, 'لح موا'), (2, 'انع'), (3, 'ةا')) AS t(query_id, effective))",
    _hits("eff"),
    _RESULTS,
    "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, n_matches FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_matches DESC, first_seq) AS rank FROM results) WHERE rank <= 20",
)
RANKED_ALL = _with(
    *_TO_DOCS,
    "eff AS (SELECT * FROM (VALUES (1, 'لح موا'), (2, 'انع'), (3, 'ةا')) AS t(query_id, effective))",
    _hits("eff"),
    _RESULTS,
    "SELECT CAST(query_id AS BIGINT) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY n_matches DESC, first_seq, doc_id) AS rank, doc_id, filename, n_matches FROM results",
)
SEARCH_CARDS = _with(
    *_TO_DOCS,
    _LOG,
    _LOG_EFFECTIVE,
    _hits("eff"),
    "first_lines AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY page) AS k FROM hits)",
    f"SELECT f.query_id, f.doc_id, f.page, f.line, {_marked('f.line', 'e.effective')} AS marked FROM first_lines f JOIN eff e USING (query_id) WHERE f.k <= 6",
)
RESULT_JSON = _with(*_TO_DOCS, _LOG, _LOG_EFFECTIVE, _hits("eff"), "SELECT h.query_id, h.doc_id, d.filename, d.nb_pages, h.page, h.line FROM hits h JOIN docs d USING (doc_id)")

VOCAB_MEMBERSHIP = _with(*_TO_VOCAB, _LOG, _MISSPELT, _ASKED, "SELECT a.query_id, a.pos, a.word, a.arabic, v.norm IS NOT NULL AS known FROM asked a LEFT JOIN vocab v ON a.nw = v.norm")
DICT_LOOKUP = _with(*_TO_VOCAB, _LOG, _MISSPELT, _ASKED, _CORRECTIONS, _DICT, 'SELECT nw, "right" FROM (SELECT norm AS nw FROM vocab UNION SELECT nw FROM asked) LEFT JOIN dict USING (nw)')
FUZZY_CLOSEST = _with(*_TO_VOCAB, _LOG, _MISSPELT, _ASKED, _NEAR, _CLOSEST, "SELECT nw, closest, dist FROM closest")
_TO_CORRECTED = (*_TO_VOCAB, _LOG, _MISSPELT, _ASKED, _NEAR, _CLOSEST, _CORRECTIONS, _DICT, _FIXES, _CORRECTED)
CORRECT_QUERY = _with(*_TO_CORRECTED, "SELECT query_id, query, correction, effective FROM corrected")
SUGGEST_PREFIX = _with(*_TO_VOCAB, _LOG, _asked("asked", "qlog"), "pre AS (SELECT substr(word, 1, 3) AS prefix FROM asked WHERE arabic)", _suggest("pre", 8), "SELECT prefix, rank, suggestion, n FROM sug")
LIVE_SUGGEST = _with(
    *_TO_VOCAB,
    _LOG,
    "typed AS (SELECT query_id, substr(query, 1, 4) AS query FROM qlog WHERE length(substr(query, 1, 4)) >= 2)",
    _asked("asked", "typed"),
    "pre AS (SELECT word AS prefix FROM asked WHERE arabic)",
    _suggest("pre", 3),
    _PER_QUERY,
    "SELECT query_id, array_to_string(list_slice(suggestions, 1, 6), '|') AS shown FROM per_query",
)
SEARCH_ENVELOPE = _with(
    *_TO_CORRECTED,
    _SUMMARY,
    _UPLOADS,
    _DOCS,
    "pre AS (SELECT word AS prefix FROM asked WHERE arabic)",
    _suggest("pre", 3),
    _PER_QUERY,
    _hits("corrected"),
    "totals AS (SELECT query_id, count(DISTINCT doc_id) AS total FROM hits GROUP BY query_id)",
    "SELECT c.query_id, c.query AS query_orig, c.effective AS query_eff, c.correction, coalesce(array_to_string(p.suggestions, '|'), '') AS suggestions, coalesce(t.total, 0) AS total FROM corrected c LEFT JOIN per_query p USING (query_id) LEFT JOIN totals t USING (query_id)",
)
SEARCH_ANSWER = _with(
    *_TO_CORRECTED,
    _SUMMARY,
    _UPLOADS,
    _DOCS,
    "pre AS (SELECT word AS prefix FROM asked WHERE arabic)",
    _suggest("pre", 3),
    _PER_QUERY,
    _hits("corrected"),
    "by_doc AS (SELECT h.query_id, d.doc_id, d.filename, d.nb_pages, d.first_seq, list({'page': h.page, 'line': h.line} ORDER BY h.page) AS matches FROM hits h JOIN docs d USING (doc_id) GROUP BY ALL)",
    "listed AS (SELECT query_id, count(*) AS total, list({'doc_id': doc_id, 'filename': filename, 'nb_pages': nb_pages, 'matches': matches} ORDER BY len(matches) DESC, first_seq) AS results FROM by_doc GROUP BY query_id)",
    "SELECT c.query_id, CAST(to_json({'results': coalesce(l.results, []), 'correction': c.correction, 'suggestions': coalesce(p.suggestions, []), 'query_orig': c.query, 'query_eff': c.effective, 'total': coalesce(l.total, 0)}) AS VARCHAR) AS answer"
    " FROM corrected c LEFT JOIN per_query p USING (query_id) LEFT JOIN listed l USING (query_id)",
)

# Correction cascade. The SQL engine's patterns have no lookaround; a hit's surroundings are captured and put back, and
# where a hit's end is the next hit's start, the rewriting is applied twice.

_A, _F = "[؀-ۿ]", "ء-غف-ي"


def _re(x: str, pattern: str, to: str, options: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{options}')"


def _swaps(x: str, swaps) -> str:
    for wrong, right in swaps:
        x = f"replace({x}, '{wrong}', '{right}')"
    return x


def _ligatures(x: str) -> str:
    for wrong, right in LIGATURES:
        x = _re(x, f"(^|[{_SPACE}]){wrong}", rf"\1{right}")
    return x


def _twice(x: str, pattern: str, to: str, options: str = "g") -> str:
    return _re(_re(x, pattern, to, options), pattern, to, options)


def _hamza_article(x: str) -> str:
    """Verbs that are left alone are marked first, each as a whole run; then what is not marked is rewritten."""
    verbs = "|".join(sorted((v[2:] for v in ALLOWED_VERBS), key=len, reverse=True))
    before = rf"(^|[{_SPACE}،؛:؟!])"
    kept = _twice(x, rf"{before}أل((?:{verbs})(?:[^؀-ۿ]|\z))", "\\1\ue002\\2", "g")
    kept = _re(kept, rf"(?m)(^)أل((?:{verbs})(?:[^؀-ۿ]|\z))", "\\1\ue002\\2")
    done = _twice(kept, rf"(?m){before}أل({_A})", r"\1الأ\2")
    return f"replace({done}, '\ue002', 'أل')"


def _after(x: str, old: str, new: str, kept: str, heads: str | None) -> str:
    """The text is cut at ``old`` and put together again, part by part: ``new`` where a letter follows that is not ``kept``
    (and one of ``heads`` comes before). A hit takes the letter after it and the one before it, so these begin or end no other."""
    before = f"right(p[1], 1) IN ({', '.join(repr(h) for h in heads)}) AND NOT (s[2] = 'taken' AND length(p[1]) = 1)" if heads else "NOT (s[2] = 'taken' AND p[1] = '')"
    hit = f"({before} AND regexp_matches(p[3], '^[{_F}]'))"
    parts = f"string_split({x}, '{old}')"
    # of each cut: the part before it, the part after it, and the first letter after it, which may be that of the next cut
    cuts = f"list_transform(generate_series(2, len({parts})), lambda k: [{parts}[k - 1], {parts}[k], CASE WHEN {parts}[k] <> '' THEN left({parts}[k], 1) WHEN k < len({parts}) THEN '{old[0]}' ELSE '' END])"
    fold = f"lambda s, p: [s[1] || CASE WHEN {hit} AND p[3] NOT IN ({', '.join(repr(c) for c in kept)}) THEN '{new}' ELSE '{old}' END || p[2], CASE WHEN {hit} THEN 'taken' ELSE '' END]"
    return f"list_reduce({cuts}, {fold}, [{parts}[1], ''])[1]"


def _correct_dict(x: str) -> str:
    return _swaps(x, CORRECTIONS)


_STEP_SQL = {
    2: lambda x: f"replace({x}, 'ـ', '')",
    3: lambda x: _re(x, rf"يهة([{_SPACE}،؛.]|\z)", r"ية\1"),
    4: lambda x: _twice(x, rf"([؀-ۿ{_SPACE}])[*+]{{1,3}}([؀-ۿ{_SPACE}])", r"\1 \2"),
    5: lambda x: f"replace({_re(x, rf'(^|[{_SPACE}])اال({_A})', r'\1الا\2')}, ' اال', ' الا')",
    6: lambda x: _re(x, rf"({_A}{{3,}})لا([{_SPACE}،؛.]|\z)", r"\1ال\2"),
    7: lambda x: f"replace({x}, 'احمل', 'المح')",
    8: lambda x: _re(x, f"امل({_A})", r"الم\1"),
    9: _ligatures,
    10: lambda x: _swaps(x, CONJUNCTION_LOW),
    11: lambda x: _re(x, f"اإل({_A})", r"الإ\1"),
    12: lambda x: _swaps(x, CONJUNCTION_HIGH),
    13: lambda x: _re(x, "الا([أإآؤئ])", r"ال\1"),
    14: _hamza_article,
    15: lambda x: _re(x, f"قغض({_A}?)", r"قض\1"),
    16: lambda x: _re(x, rf"(?m)(^|[{_SPACE}])ال ({_A})", r"\1لا \2"),
    17: lambda x: _after(x, "مال", "ملا", KEPT_AFTER_MAL, None),
    18: lambda x: _after(x, "عال", "علا", KEPT_AFTER_AAL, "إا"),
}

CORRECT_STEPS = {k: f"SELECT doc_id, {step(_sur('text'))} AS text FROM documents" for k, step in _STEP_SQL.items()}


def _stepwise(source: str, first: str, keep: str, name: str = "c") -> tuple[list[str], str]:
    """The whole cascade as a chain of tables, one a step."""
    parts, at = [f"{name}1 AS MATERIALIZED (SELECT {keep}, {first} AS t FROM {source})"], f"{name}1"
    for k in sorted(_STEP_SQL):
        parts.append(f"{name}{k} AS MATERIALIZED (SELECT {keep}, {_STEP_SQL[k]('t')} AS t FROM {at})")
        at = f"{name}{k}"
    return parts, at


_CHAIN, _LAST = _stepwise("documents", _correct_dict(_strip(_sur("text"))), "doc_id")
CORRECT_TEXT = _with(*_CHAIN, f"SELECT doc_id, t AS text FROM {_LAST}")
_OCR_CHAIN, _OCR_LAST = _stepwise("(SELECT doc_id, page, coalesce(t, '') AS t FROM taken WHERE t <> '' AND NOT starts_with(t, '[ERR'))", _correct_dict("t"), "doc_id, page")
OCR_FALLBACK = OCR_FALLBACK.replace(
    "\n__CASCADE__",
    ",\n" + ",\n".join(_OCR_CHAIN) + f",\ndone AS (SELECT doc_id, page, t FROM {_OCR_LAST} UNION ALL SELECT doc_id, page, coalesce(t, '') FROM taken WHERE t IS NULL OR t = '' OR starts_with(t, '[ERR'))\n"
    "SELECT doc_id, page, t AS text, starts_with(t, '[ERR') AS is_error FROM done",
)
# Native pages are corrected once, recognised ones when they are read and when they are chosen.
_ONCE, _ONCE_LAST = _stepwise("(SELECT * FROM pages_ WHERE t IS NOT NULL AND NOT starts_with(t, '[ERR'))", _correct_dict(_strip("t")), "doc_id, page, twice", "o")
_TWICE, _TWICE_LAST = _stepwise(f"(SELECT * FROM {_ONCE_LAST} WHERE twice AND t <> '' AND NOT starts_with(t, '[ERR'))", _correct_dict("t"), "doc_id, page", "w")
UPLOAD_PIPELINE = _with(
    f"turns AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id AS seq, CAST(turn + 1 AS INTEGER) AS page, coalesce({_sur('text')}, '') AS raw_text FROM conversations)",
    f"typed AS (SELECT *, {_kind('raw_text')} AS type, seq % 4 = 0 AS known, strlen(raw_text) AS n FROM turns)",
    "pages_ AS (SELECT doc_id, page, NOT known AND type = 'scan' AS twice, CASE WHEN known OR type = 'native' OR n % 3 = 2 THEN raw_text WHEN n % 2 = 1 THEN NULL ELSE 'ب ' || raw_text END AS t FROM typed)",
    *_ONCE,
    *_TWICE,
    "s AS (SELECT doc_id, count(*) AS nb_pages, count(*) FILTER (type = 'native') AS n_native, count(*) FILTER (type <> 'native') AS n_scan FROM typed GROUP BY doc_id)",
    f"SELECT doc_id, doc_id || '.pdf' AS filename, nb_pages, n_scan, {_DOC_TYPE} AS doc_type, bool_and(known AND page % 2 = 1) OVER (PARTITION BY doc_id) AS from_cache, page AS num, type,"
    f" CASE WHEN known AND page % 2 = 1 THEN 'cached ' || page ELSE coalesce(w.t, o.t, '') END AS text FROM typed JOIN s USING (doc_id) LEFT JOIN {_ONCE_LAST} o USING (doc_id, page) LEFT JOIN {_TWICE_LAST} w USING (doc_id, page)",
)
_APPLIED = []
for _i, (_w, _r) in enumerate(CORRECTIONS):
    _APPLIED.append(f"d{_i + 1} AS {'MATERIALIZED ' if _i % 20 == 19 else ''}(SELECT doc_id, replace(t, '{_w}', '{_r}') AS t, CASE WHEN contains(t, '{_w}') THEN list_append(done, '{_w}→{_r}') ELSE done END AS done FROM d{_i})")
CORRECT_DICT = _with(f"d0 AS (SELECT doc_id, {_sur('text')} AS t, CAST([] AS VARCHAR[]) AS done FROM documents)", *_APPLIED, f"SELECT doc_id, t AS text, array_to_string(done, '|') AS applied FROM d{len(CORRECTIONS)}")
