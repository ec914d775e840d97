"""The same queries in DuckDB SQL, for comparison. They share no code with the queries but word lists.

RE2 has no lookbehind or backreferences, so facts are counted on neighbouring pieces and runs by alternation.
"""

from __future__ import annotations

from gatehouse.functions import lexicon as X


def _list(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def _array(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _count(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, '{needle}', ''))) // {len(needle)})"


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


_SPLIT = r"""
d AS (SELECT *, regexp_extract_all(text, '\S+') tokens, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') words, string_split(text, chr(10)) lines FROM src),
f AS (SELECT *, len(tokens) nt, len(words) nw, len(lines) nl, length(text) nc, list_filter(list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') full_lines,
  list_transform(range(1, len(tokens)), lambda i: [tokens[i], tokens[i + 1]]) pairs FROM d)"""


def _features(source: str = "SELECT doc_id, coalesce(text, '') AS text, source FROM documents") -> str:
    alpha = r"len(regexp_extract_all(text, '\p{L}'))"
    made = {
        "char_length": "nc::DOUBLE",
        "token_length": "nt::DOUBLE",
        "mean_word_length": _div("length(array_to_string(words, ''))", "nw"),
        "type_token_ratio": _div("len(list_distinct(tokens))", "nt"),
        "bigram_repetition": f"CASE WHEN nt >= 2 THEN {_div('len(list_filter(pairs, lambda p: p[1] = p[2]))', 'nt - 1')} ELSE 0 END",
        "dup_line_fraction": _div("len(full_lines) - len(list_distinct(full_lines))", "len(full_lines)"),
        "stopword_fraction": _div(f"len(list_filter(words, lambda w: w IN {_list(X.PROFILE_STOPWORDS)}))", "nw"),
        "alpha_fraction": _div(alpha, "nc"),
        "digit_fraction": _div(r"len(regexp_extract_all(text, '\p{Nd}'))", "nc"),
        "punct_fraction": _div(r"len(regexp_extract_all(text, '[^\p{L}\p{N}\s]'))", "nc"),
        "uppercase_fraction": _div(r"len(regexp_extract_all(text, '\p{Lu}'))", alpha),
        "non_ascii_fraction": _div(r"len(regexp_extract_all(text, '[^\x00-\x7F]'))", "nc"),
        "symbol_word_ratio": _div(" + ".join(_count("text", s) for s in ("#", "...", "…")), "nw"),
        "bullet_line_fraction": _div(r"len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣]')))", "nl"),
        "ellipsis_line_fraction": _div(r"len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))", "nl"),
        "short_line_fraction": _div("len(list_filter(full_lines, lambda x: length(x) < 12))", "nl"),
        "mean_line_length": _div("nc - (nl - 1)", "nl"),
        "mojibake_fraction": _div(f"len(regexp_extract_all(text, '{'|'.join(X.MOJIBAKE_SIGNS)}'))", "greatest(nw, 1)"),
    }
    cols = ", ".join(f"{v} AS {k}" for k, v in made.items())
    top = f"""
top AS (SELECT doc_id AS _id, max(n) AS most FROM (SELECT doc_id, p, count(*) n FROM (SELECT doc_id, unnest(pairs) p FROM f) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT f.doc_id, f.text, f.source, {cols}, {_div('coalesce(most, 0) * 2', 'nt')} AS top_ngram_fraction,
  len(regexp_extract_all(text, '\\b\\d[\\d,.]*\\b')) + len(list_filter(range(1, len(bits)), lambda i: regexp_matches(bits[i], '[a-z]$') AND regexp_matches(bits[i + 1], '^[A-Z][a-z][a-z]'))) AS facts
  FROM (SELECT *, regexp_split_to_array(text, '\\s') bits FROM f) f LEFT JOIN top ON _id = f.doc_id)"""
    return f"WITH src AS ({source}),{_SPLIT},{top}"


def _profile(*names: str) -> str:
    return f"{_features()} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM p"


_SPAM = " + ".join(f"contains(lower(text), '{s}')::INT" for s in X.SPAM)
_SCORE = f"""greatest(0, least(1, 0.28::DOUBLE * least(1, stopword_fraction / 0.30::DOUBLE) + 0.16::DOUBLE * type_token_ratio + 0.20::DOUBLE * least(1, token_length / 120)
  + 0.26::DOUBLE * least(1, facts / (greatest(1, token_length) / 8)) - 0.5::DOUBLE * (bigram_repetition + dup_line_fraction + top_ngram_fraction) - 0.6::DOUBLE * least(1, {_SPAM})))"""


def _scored(*source: str) -> str:
    return f"{_features(*source)}, s AS (SELECT *, {_SCORE} AS g FROM p)"


_SCORED = _scored()
_DECIDED = f"""{_SCORED}, c AS (SELECT doc_id, source, g, CASE WHEN g >= 0.62::DOUBLE THEN 2 WHEN g <= 0.30::DOUBLE THEN 0 ELSE 1 END AS label, g < 0.62::DOUBLE AND g > 0.30::DOUBLE AS middle FROM s),
e AS (SELECT *, ['filter', 'review', 'retain'][label + 1] AS label_name FROM c)"""
_N = "count(*) AS n_docs, count(*) FILTER (label = 0) AS n_filter, count(*) FILTER (label = 1) AS n_review, count(*) FILTER (label = 2) AS n_retain, 1.0::DOUBLE AS mean_gate_quality"

COHORT = tuple(n for n in X.FEATURES if n != "gzip_ratio")
_UNPIVOT = f"long AS (SELECT doc_id, source, unnest([{', '.join(f'{{i: {i}, feature: {chr(39)}{n}{chr(39)}, value: {n}}}' for i, n in enumerate(COHORT))}], recursive := true) FROM p)"
_LONG = f"{_features()}, {_UNPIVOT}"


def _stats(*source: str) -> str:
    return f"""{_features(*source)}, {_UNPIVOT}, both_ AS (SELECT source, feature, value FROM long UNION ALL SELECT '*', feature, value FROM long),
m AS (SELECT source, feature, count(*) n, median(value) med FROM both_ GROUP BY 1, 2),
st AS (SELECT source, feature, n, med, median(abs(value - med)) mad FROM both_ JOIN m USING (source, feature) GROUP BY 1, 2, 3, 4)"""


_STATS = _stats()

# --- gates ---

_NAIVE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_PAGES = f"SELECT page_id AS doc_id, {_NAIVE} AS text, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS source, html AS raw FROM pages"


def _clamp(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


def _quality(weights: dict[str, float]) -> str:
    return " * ".join(f"(1 - {_clamp(f'{w}::DOUBLE * s_{k}')})" for k, w in weights.items())


def _flags(weights: dict[str, float]) -> str:
    each = ", ".join(f"CASE WHEN {_clamp(f'{w}::DOUBLE * s_{k}')} >= 0.5 THEN '{k}' END" for k, w in weights.items())
    return f"array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',')"


HTML_WEIGHTS = {"markup_leak": 2.0, "boilerplate_leak": 1.6, "link_density": 1.6, "nonprose_lines": 1.4, "stopword_deficit": 0.8}
JSON_WEIGHTS = {"parse_fail": 2.0, "truncated": 1.5, "schema_missing": 1.4, "type_mismatch": 1.2, "empty_value": 1.6}
OCR_WEIGHTS = {"garbage_rate": 1.5, "confusion_rate": 1.1, "broken_word": 1.0, "mojibake": 1.4, "line_noise": 0.8}


def _html(source: str) -> str:
    code = " + ".join(_count("lower(text)", c.lower().replace("'", "''")) for c in X.CODE_TOKENS)
    phrases = " + ".join(_count("lower(text)", p) for p in X.BOILERPLATE_TRAIN)
    bad = rf"len(list_filter(full_lines, lambda x: len(regexp_extract_all(x, '\S+')) <= 8 AND NOT regexp_matches(x, '[.?!:;]$') AND len(list_filter(regexp_extract_all(x, '\S+'), lambda w: lower(w) IN {_list(X.HTML_STOPWORDS)})) / len(regexp_extract_all(x, '\S+')) < 0.2))"
    stop = _div(f"len(list_filter(words, lambda w: w IN {_list(X.HTML_STOPWORDS)}))", "nw")
    return rf"""WITH src AS ({source}),{_SPLIT},
h AS (SELECT doc_id, source,
  {_clamp(f"(nc - length(regexp_replace(text, '{X.TAG}', '', 'g'))) / greatest(nc, 1) * 6 + (len(regexp_extract_all(text, '{X.HTML_ENTITY}')) + {code}) / nl")} AS s_markup_leak,
  {_clamp(f"({phrases}) / nl * 2")} AS s_boilerplate_leak,
  {_clamp(f"len(regexp_extract_all(text, '{X.LINK}')) / nl")} AS s_link_density,
  {_clamp(_div(f"greatest(0, {bad} - 1)", "len(full_lines)") + " * 1.2::DOUBLE")} AS s_nonprose_lines,
  {_clamp(f"1 - least(1, {stop} / 0.12::DOUBLE)")} AS s_stopword_deficit FROM f),
q AS (SELECT *, {_quality(HTML_WEIGHTS)} AS quality, {_flags(HTML_WEIGHTS)} AS flags FROM h)"""


_LETTERS = r"regexp_replace(t, '[^\p{L}\p{Nl}\p{No}]', '', 'g')"
_VOWEL = f"[{X.VOWELS}]"
_GLYPH = "[" + "".join("\\" + c if c in "|^~" else c for c in X.NOISE_GLYPHS) + "]"


def _ocr(source: str = "SELECT doc_id, coalesce(text, '') AS text, source FROM documents") -> str:
    has = r"regexp_matches(t, '[\p{L}\p{Nl}\p{No}]')"
    runs = "list_reduce(list_prepend({c: '', n: 0, m: 0}, list_transform(regexp_extract_all(t, '.'), lambda c: {c: c, n: 0, m: 0})), lambda a, b: {c: b.c, n: CASE WHEN b.c = a.c AND regexp_matches(b.c, '\\p{L}') THEN a.n + 1 ELSE 1 END, m: greatest(a.m, CASE WHEN b.c = a.c AND regexp_matches(b.c, '\\p{L}') THEN a.n + 1 ELSE 1 END)}).m >= 4"
    # tokens are few against their occurrences: each distinct one is judged once
    return rf"""WITH src AS ({source}),{_SPLIT},
k AS (SELECT t, {_LETTERS} AS letters FROM (SELECT DISTINCT unnest(tokens) t FROM f)),
j AS (SELECT t, length(letters) >= 3 AND (NOT regexp_matches(t, '{_VOWEL}') OR (length(letters) >= 4 AND (len(regexp_extract_all(letters, '{_VOWEL}')) / length(letters) < 0.18::DOUBLE OR len(regexp_extract_all(letters, '{_VOWEL}')) / length(letters) > 0.85::DOUBLE))
    OR {runs} OR (substr(letters, 2, length(letters) - 2) <> lower(substr(letters, 2, length(letters) - 2)) AND letters <> upper(letters))) AS garbage,
  ({has} AND regexp_matches(t, '\p{{Nd}}'))::INT + (t IN ('1', '0', 'l', '|', 'I'))::INT AS confused,
  length(t) <= 2 AND {has} AND lower(t) NOT IN {_list(X.SHORT_WORDS)} AS tiny, regexp_matches(t, '[^\x00-\x7F]') AS foreign_, regexp_matches(t, '{_GLYPH}') AS glyph FROM k),
o AS (SELECT doc_id AS _id, count(*) FILTER (garbage) g, sum(confused) c, count(*) FILTER (tiny) y, count(*) FILTER (foreign_) a, count(*) FILTER (glyph) l FROM (SELECT doc_id, unnest(tokens) t FROM f) JOIN j USING (t) GROUP BY 1),
h AS (SELECT doc_id, {_clamp("coalesce(g, 0) / greatest(nt, 1) * 2.5::DOUBLE")} AS s_garbage_rate, {_clamp("coalesce(c, 0) / greatest(nt, 1) * 3::DOUBLE")} AS s_confusion_rate,
  {_clamp("len(list_filter(lines, lambda x: regexp_matches(x, '-" + chr(92) + "s*$'))) / nl * 2::DOUBLE + coalesce(y, 0) / greatest(nt, 1) * 3::DOUBLE")} AS s_broken_word,
  {_clamp("coalesce(a, 0) / greatest(nt, 1) * 5::DOUBLE + " + _count("text", "�") + " / greatest(nt, 1) * 8::DOUBLE")} AS s_mojibake,
  {_clamp(f"coalesce(l, 0) / greatest(nt, 1) * 5::DOUBLE + len(regexp_extract_all(text, '{_GLYPH}')) / greatest(nc, 1) * 30::DOUBLE")} AS s_line_noise FROM f LEFT JOIN o ON _id = doc_id),
q AS (SELECT *, {_quality(OCR_WEIGHTS)} AS quality, {_flags(OCR_WEIGHTS)} AS flags FROM h)"""


# --- draws of the mutation oracle ---


def _draw(what: str, seed: int = 1, k: str = "0", key: str = "doc_id") -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key}::VARCHAR, '{what}', ({k})::VARCHAR)), 1, 8))::UBIGINT::BIGINT"


def _pick(items, n: str) -> str:
    return f"{_array(items)}[({n}) % {len(items)} + 1]"


def _insert(parts: str, n: str, items, what: str, glue: str, seed: int = 1) -> str:
    own = f"list_transform({parts}, lambda x, i: {{p: (i - 1)::BIGINT, k: {1 << 40}::BIGINT, x: x}})"
    new = f"list_transform(range(1, ({n})::BIGINT + 1), lambda k: {{p: {_draw(what + '@', seed, 'k')} % greatest(len({parts}), 1), k: k, x: {_pick(items, _draw(what, seed, 'k'))}}})"
    return f"array_to_string(list_transform(list_sort(list_concat({own}, {new})), lambda s: s.x), '{glue}')"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _mutated(target: str, made: str, table: str = "SELECT doc_id, coalesce(text, '') AS text FROM documents") -> str:
    return f"WITH src AS ({table}), m AS (SELECT doc_id, {made} AS {target} FROM src) SELECT doc_id, length({target}) AS n_chars, md5({target}) AS digest FROM m"


_WORDS = "string_split(text, ' ')"
_EVENTS = "SELECT event_id AS doc_id, props AS raw FROM events"
_SLICES = {"boilerplate": {"train": X.BOILERPLATE_TRAIN, "heldout": X.BOILERPLATE_HELDOUT}, "ocr": {"train": X.OCR_TRAIN, "heldout": X.OCR_HELDOUT}}


def _with(name: str, value: str, body: str) -> str:
    """body with a name for value in it."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _tags(seed: int = 1, which: str = "heldout") -> str:
    return _insert(_WORDS, f"greatest(3, len({_WORDS}) // 25)", X.INJECTED_TAGS, "tag", " ", seed)


def _nav(seed: int = 1, which: str = "heldout") -> str:
    n = f"CASE WHEN {_draw('light', seed)} % 10 < 3 THEN {_draw('few', seed)} % 2 + 1 ELSE {_draw('many', seed)} % 5 + 4 END"
    chrome = f"list_transform(range(1, {n} + 1), lambda k: {_title(_pick(_SLICES['boilerplate'][which], _draw('phrase', seed, 'k')))})"
    return f"array_to_string(({chrome})[1:greatest(1, len({chrome}) // 2)], chr(10)) || chr(10) || text || chr(10) || array_to_string(({chrome})[len({chrome}) // 2 + 1:], chr(10))"


def _script(seed: int = 1, which: str = "heldout") -> str:
    return "'" + X.SCRIPT_BLOCK.replace("'", "''") + "' || chr(10) || text"


def _links(seed: int = 1, which: str = "heldout") -> str:
    return f"text || chr(10) || array_to_string(list_transform(range(1, {_draw('links', seed)} % 7 + 7), lambda k: '[link ' || (k - 1) || '](https://ads.example.com/' || ({_draw('link', seed, 'k')} % 100000) || ')'), chr(10))"


def _charsub(seed: int = 1, which: str = "heldout") -> str:
    """Each pair over what the ones before it left; of its occurrences those with an odd draw are replaced."""
    out = "text"
    for n, (a, b) in enumerate(_SLICES["ocr"][which]):
        out = f"array_to_string(list_transform(string_split({out}, '{a}'), lambda x, i: CASE WHEN i = 1 THEN x WHEN {_draw(f'sub{n}', seed, 'i - 2')} % 2 = 1 THEN '{b}' || x ELSE '{a}' || x END), '')"
    return out


def _wordbreak(seed: int = 1, which: str = "heldout") -> str:
    at = f"({_draw('cut', seed, 'i - 1')} % greatest(length(w) - 3, 1) + 2)"
    return f"""array_to_string(list_transform({_WORDS}, lambda w, i: CASE WHEN length(w) > 5 AND {_draw('space', seed, 'i - 1')} % 100 < 25 THEN substr(w, 1, {at}) || ' ' || substr(w, {at} + 1)
  WHEN length(w) > 6 AND {_draw('hyphen', seed, 'i - 1')} % 100 < 10 THEN substr(w, 1, {at}) || '-' || chr(10) || substr(w, {at} + 1) ELSE w END), ' ')"""


def _mojibake(seed: int = 1, which: str = "heldout") -> str:
    n = f"list_sort(list_transform(range(1, greatest(6, length(text) // 80)::BIGINT + 1), lambda k: {{p: {_draw('moji@', seed, 'k')} % greatest(length(text), 1), k: k, x: {_pick(X.MOJIBAKE, _draw('moji', seed, 'k'))}}}))"
    return _with("n", n, "array_to_string(list_transform(range(1, len(n) + 1), lambda i: substr(text, coalesce(n[i - 1].p, 0) + 1, n[i].p - coalesce(n[i - 1].p, 0)) || n[i].x), '') || substr(text, n[-1].p + 1)")


def _linenoise(seed: int = 1, which: str = "heldout") -> str:
    return _insert(_WORDS, f"greatest(8, len({_WORDS}) // 8)", tuple(X.INJECTED_GLYPHS), "noise", " ", seed)


def _cut(seed: int = 1, which: str = "heldout") -> str:
    return f"substr(raw, 1, floor(length(raw) * 0.3::DOUBLE)::BIGINT + {_draw('cut', seed)} % (floor(length(raw) * 0.9::DOUBLE)::BIGINT - floor(length(raw) * 0.3::DOUBLE)::BIGINT + 1))"


def _schema_break(seed: int = 1, which: str = "heldout") -> str:
    """The records at hand are objects of strings and numbers."""
    keys = "json_keys(raw)"
    name = f"{keys}[{_draw('key', seed)} % len({keys}) + 1]"
    how = f"{_draw('how', seed)} % 3"
    value = "json_extract(raw, '$.' || k)::VARCHAR"
    part = f"CASE WHEN k = {name} AND {how} = 1 THEN '\"' || k || '\": {{\"v\": ' || {value} || '}}' WHEN k = {name} AND {how} = 2 THEN '\"' || k || '\": null' ELSE '\"' || k || '\": ' || {value} END"
    return f"'{{' || array_to_string(list_transform(list_filter({keys}, lambda k: NOT (k = {name} AND {how} = 0)), lambda k: {part}), ', ') || '}}'"


def _delimiter(seed: int = 1, which: str = "heldout") -> str:
    return f"CASE WHEN {_draw('brace', seed)} % 2 = 0 AND raw LIKE '%}}' THEN substr(raw, 1, length(raw) - 1) ELSE regexp_replace(raw, '(?s)^([^,]*),', '\\1;') END"


_OPS = {"html": {"tag_inject": _tags, "nav_boilerplate": _nav, "script_style": _script, "link_dump": _links}, "ocr": {"charsub": _charsub, "wordbreak": _wordbreak, "mojibake": _mojibake, "linenoise": _linenoise}, "json": {"truncate": _cut, "schema_break": _schema_break, "delimiter": _delimiter}}


def _corrupt(kind: str, seed: int, which: str = "heldout") -> str:
    """The text or record after a drawn operator of its kind."""
    each = " ".join(f"WHEN {i} THEN {op(seed, which)}" for i, op in enumerate(_OPS[kind].values()))
    return f"CASE {_draw('operator', seed)} % {len(_OPS[kind])} {each} END"


_BROKEN = f"SELECT doc_id, {_corrupt('json', 3)} AS raw FROM ({_EVENTS})"
# the records of events are flat, without strings that hold brackets
_JUDGED = f"""WITH src AS ({{rows}}), j AS (SELECT doc_id, raw, coalesce(json_valid(raw), false) AND NOT regexp_matches(raw, ',\\s*[\\]}}}}]') AS parses,
  length(regexp_replace(regexp_replace(raw, '"[^"]*"', '', 'g'), '[^{{{{]', '', 'g')) = length(regexp_replace(regexp_replace(raw, '"[^"]*"', '', 'g'), '[^}}}}]', '', 'g')) AND NOT contains(regexp_replace(raw, '"[^"]*"', '', 'g'), '"') AS balanced FROM src)"""


# --- the mutation set of the HTML gate: its four operators, five seeds, two slices ---


def _matrix() -> str:
    parts = []
    for seed in range(5):
        for which in ("heldout", "train"):
            parts.append(f"SELECT doc_id, {_corrupt('html', seed, which)} AS text, '{which}/{seed}/1' AS source FROM documents")
            parts.append(f"SELECT doc_id, text, '{which}/{seed}/0' AS source FROM documents")
    return " UNION ALL ".join(parts)


_GRID = ", ".join(f"({i}, {w}::DOUBLE, {t}::DOUBLE)" for i, (t, w) in enumerate((t, w) for t in (0.3, 0.5, 0.7) for w in (1.0, 2.0)))
_F1 = f"{_div('2 * tp', '2 * tp + fp + fn')}"


def _scores(grid: str) -> str:
    quality = " * ".join(f"(1 - {_clamp(f'{w}::DOUBLE * s_{k}' if k != 'markup_leak' else 'w * s_markup_leak')})" for k, w in HTML_WEIGHTS.items())
    return f"""{_html(_matrix())}, g(candidate_id, w, threshold) AS (VALUES {grid}),
r AS (SELECT candidate_id, string_split(source, '/')[1] AS slice, string_split(source, '/')[2]::INT AS seed, string_split(source, '/')[3]::INT AS defect, ({quality} < threshold)::INT AS pred FROM q CROSS JOIN g),
n AS (SELECT candidate_id, slice, seed, count(*) n, count(*) FILTER (pred = 1 AND defect = 1) tp, count(*) FILTER (pred = 1 AND defect = 0) fp, count(*) FILTER (pred = 0 AND defect = 1) fn, count(*) FILTER (pred = 0 AND defect = 0) tn FROM r GROUP BY 1, 2, 3),
v AS (SELECT candidate_id, slice, seed, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, {_F1} AS f1, {_div('fp', 'fp + tn')} AS fpr, n FROM n)"""


def _daily() -> str:
    return "d AS (SELECT event_type AS stream, datediff('day', DATE '2024-01-01', ts::DATE) AS day, count(*)::DOUBLE AS throughput, avg(value) AS mean_value FROM events GROUP BY 1, 2)"


def _chart(value: str, watch: str = "two_sided") -> str:
    ewma, cusum = "abs(z - mu) > 3 * width", "up > 4 * sigma OR down > 4 * sigma"
    if watch == "down":
        ewma, cusum = f"{ewma} AND z < mu", "down > 4 * sigma"
    return f"""WITH RECURSIVE {_daily()}, o AS (SELECT stream, day, {value} AS x, row_number() OVER (PARTITION BY stream ORDER BY day) AS i FROM d),
m AS (SELECT stream, median(x) AS mu FROM o WHERE i <= 10 GROUP BY 1),
b AS (SELECT stream, mu, greatest(1e-9, 1.4826::DOUBLE * median(abs(x - mu)), 0.02::DOUBLE * (abs(mu) + 1e-6)) AS sigma FROM o JOIN m USING (stream) WHERE i <= 10 GROUP BY 1, 2),
w AS (SELECT stream, 10::BIGINT AS i, mu AS z, 0::DOUBLE AS up, 0::DOUBLE AS down FROM b
  UNION ALL SELECT w.stream, o.i, 0.2::DOUBLE * x + 0.8::DOUBLE * z, greatest(0, up + (x - mu - 0.5::DOUBLE * sigma)), greatest(0, down - (x - mu + 0.5::DOUBLE * sigma)) FROM w JOIN o ON o.stream = w.stream AND o.i = w.i + 1 JOIN b ON b.stream = w.stream),
r AS (SELECT w.*, day, x, mu, sigma, sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (w.i - 10)))) AS width FROM w JOIN o USING (stream, i) JOIN b USING (stream) WHERE w.i > 10)
SELECT stream, day::INT AS day, round(x, 6) AS value, round(z, 6) AS ewma, round(up, 6) AS cusum_pos, round(down, 6) AS cusum_neg, {ewma} AS ewma_alarm, {cusum} AS cusum_alarm,
  CASE WHEN z < mu OR down > 4 * sigma THEN 'down' WHEN z > mu OR up > 4 * sigma THEN 'up' ELSE 'none' END AS direction FROM r"""


_GOLD = "CASE WHEN quality = 1 THEN 2 ELSE 0 END"


def _macro(pred: str, gold: str) -> str:
    each = [f"{_div(f'2 * count(*) FILTER ({pred} = {c} AND {gold} = {c})', f'count(*) FILTER ({pred} = {c}) + count(*) FILTER ({gold} = {c})')}" for c in (0, 1, 2)]
    return f"({' + '.join(each)}) / 3"


# --- generated documents ---

_SIZE = f"{_draw('paragraph', 7, 'p')} % 3 + 2"
_SENTENCE = f"""{_with("whole", f"CASE WHEN {_draw('connect', 7, 'k')} % 2 = 0 THEN {_pick(X.CONNECTORS, _draw('connector', 7, 'k'))} || ' ' ELSE '' END || {_pick(X.SUBJECTS, _draw('subject', 7, 'k'))} || ' ' || {_pick(X.VERBS, _draw('verb', 7, 'k'))} || ' ' || {_pick(X.OBJECTS, _draw('object', 7, 'k'))}",
  f"upper(whole[1]) || whole[2:] || {_pick(('.', '.', '.', '?'), _draw('end', 7, 'k'))}")}"""


def _clean() -> str:
    """documents of the generated corpus, one for each given document: doc_id, text, source, modality, raw."""
    head = f"CASE WHEN {_draw('head', 7)} % 100 < 85 THEN {_pick(X.HEADINGS, _draw('heading', 7))} END"
    sub = f"CASE WHEN {_draw('sub', 7)} % 100 < 45 THEN {_pick(X.HEADINGS, _draw('subheading', 7))} END"
    items = f"CASE WHEN {_draw('list', 7)} % 100 < 35 THEN array_to_string(list_transform(range(1, {_draw('items', 7)} % 2 + 3), lambda k: '- ' || {_pick(X.LIST_ITEMS, f"({_draw('item', 7)} + k)")}), chr(10)) END"
    paragraphs = "list_filter(list_transform(range(1, 8), lambda p: array_to_string(sentences[coalesce(list_sum(sizes[1:p - 1]), 0) + 1:coalesce(list_sum(sizes[1:p - 1]), 0) + sizes[p]], ' ')), lambda x: x <> '')"
    return rf"""SELECT doc_id, text, source, modality, CASE modality WHEN 'html' THEN '<html><body><article><p>' || replace(text, chr(10) || chr(10), '</p><p>') || '</p></article></body></html>'
  WHEN 'json' THEN json_object('id', format('rec-{{:06d}}', {_draw('rec', 7)} % 1000000), 'url', 'https://' || source || '.example.org/p/' || ({_draw('url', 7)} % 100000), 'text', text, 'lang', 'en', 'tokens', len(regexp_extract_all(text, '\S+')), 'title', array_to_string(regexp_extract_all(text, '\S+')[1:5], ' '))::VARCHAR END AS raw
  FROM (SELECT doc_id, modality, source, array_to_string(list_filter(list_concat([{head}, {sub}], {paragraphs}, [{items}]), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text
    FROM (SELECT *, list_transform(range(1, {_draw('sentences', 7)} % 9 + 7), lambda k: {_SENTENCE}) AS sentences, list_transform(range(1, 8), lambda p: {_SIZE}) AS sizes, {_pick(X.CLEAN_SOURCES, _draw('source', 7))} AS source
      FROM (SELECT format('clean-{{:05d}}', i) AS doc_id, ['html', 'ocr', 'json'][i % 3 + 1] AS modality FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS i))))"""


def _exported() -> str:
    parts = ["SELECT doc_id, text, source, modality, raw, 'none' AS operator, 'clean' AS slice, 7 AS seed FROM c"]
    for kind, ops in _OPS.items():
        for which in ("train", "heldout"):
            text, raw = ("text", _corrupt(kind, 7, which)) if kind == "json" else (_corrupt(kind, 7, which), "raw")
            parts.append(f"SELECT doc_id, {text} AS text, source, modality, {raw} AS raw, {_pick(list(ops), _draw('operator', 7))} AS operator, '{which}' AS slice, 7 AS seed FROM c WHERE modality = '{kind}'")
    return f"WITH c AS ({_clean()}) " + " UNION ALL ".join(parts)


# --- decisions behind a gate, the ledger and the daily routine ---


def _curated_pages(threshold: float) -> str:
    """doc_id, label, label_name, score, stage, reasons and gate quality of pages."""
    return f"""SELECT doc_id, quality, flags, g, CASE WHEN quality < {threshold} THEN 0 WHEN g >= 0.62::DOUBLE THEN 2 WHEN g <= 0.30::DOUBLE THEN 0 ELSE 1 END AS label, CASE WHEN quality < {threshold} THEN quality ELSE g END AS score, CASE WHEN quality < {threshold} THEN 'gate' ELSE 'score' END AS stage,
  CASE WHEN quality < {threshold} THEN 'extraction_defect:' || flags ELSE '' END AS reasons FROM (SELECT doc_id, quality, flags FROM ({_html(_PAGES)} SELECT * FROM q)) JOIN (SELECT doc_id, g FROM ({_scored(_PAGES)} SELECT * FROM s)) USING (doc_id)"""


_REEXTRACTED = r"array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace({0}, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND (length(x) >= 25 OR regexp_matches(x, '[.?!]$'))), lambda x: regexp_replace(x, 'https?://\S+', '', 'g')), ' ')"


def _ticks() -> str:
    """Mean qualities of each day's pages as they are, with leaked markup, and with that remediated; then three days of charts, one after another."""
    day = f"{_draw('day', 0)} % 13"
    versions = [("whole", "text"), ("leaked", _script()), ("mended", _REEXTRACTED.format(f"({_script()})"))]
    union = " UNION ALL ".join(f"SELECT doc_id, {text} AS text, '{name}/' || ({day}) AS source FROM ({_PAGES})" for name, text in versions)
    base = lambda x: f"(SELECT median({x}) FROM w WHERE day < 10)"
    sigma = lambda x, m: f"(SELECT greatest(1e-9, 1.4826::DOUBLE * median(abs({x} - {m})), 0.02::DOUBLE * (abs(any_value({m})) + 1e-6)) FROM w, mu WHERE day < 10)"
    width = "{s} * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * {t})))"
    return f"""WITH RECURSIVE a AS (SELECT string_split(source, '/')[1] AS version, string_split(source, '/')[2]::INT AS day, count(*)::DOUBLE AS n, avg(quality) AS q FROM ({_html(union)} SELECT * FROM q) GROUP BY 1, 2),
days AS (SELECT i::INT AS day FROM range(13) t(i)),
w AS (SELECT days.day, coalesce(max(n) FILTER (version = 'whole'), 0) AS n, coalesce(max(q) FILTER (version = 'whole'), 1) AS q, coalesce(max(q) FILTER (version = 'leaked'), 1) AS leaked, coalesce(max(q) FILTER (version = 'mended'), 1) AS mended FROM days LEFT JOIN a USING (day) GROUP BY 1),
mu AS (SELECT {base("q")} AS qm, {base("n")} AS nm), sd AS (SELECT {sigma("q", "qm")} AS qs, {sigma("n", "nm")} AS ns),
s AS (SELECT 9 AS day, false AS mending, qm AS z, 0::DOUBLE AS down, 0 AS t, nm AS nz, 0::DOUBLE AS nup, 0::DOUBLE AS ndown, 0::DOUBLE AS q, 0::DOUBLE AS n, false AS back, false AS alarm, '' AS flow FROM mu
  UNION ALL SELECT day, mending OR alarm, CASE WHEN back THEN qm ELSE z END, CASE WHEN back THEN 0 ELSE down END, CASE WHEN back THEN 0 ELSE t END, nz, nup, ndown, q, n, back, alarm,
    CASE WHEN abs(nz - nm) > 3 * {width.format(s="ns", t="(day - 9)")} OR nup > 4 * ns OR ndown > 4 * ns THEN CASE WHEN nz < nm OR ndown > 4 * ns THEN 'throughput_drift_down' WHEN nz > nm OR nup > 4 * ns THEN 'throughput_drift_up' ELSE 'throughput_drift_none' END ELSE '' END
  FROM (SELECT *, mending AND q >= 0.95::DOUBLE * qm AS back, NOT (mending AND q >= 0.95::DOUBLE * qm) AND (abs(z - qm) > 3 * {width.format(s="qs", t="t")} AND z < qm OR down > 4 * qs) AS alarm
    FROM (SELECT w.day, s.mending, x.q, w.n, 0.2::DOUBLE * x.q + 0.8::DOUBLE * s.z AS z, greatest(0, s.down - (x.q - qm + 0.5::DOUBLE * qs)) AS down, s.t + 1 AS t, 0.2::DOUBLE * w.n + 0.8::DOUBLE * s.nz AS nz, greatest(0, s.nup + (w.n - nm - 0.5::DOUBLE * ns)) AS nup,
        greatest(0, s.ndown - (w.n - nm + 0.5::DOUBLE * ns)) AS ndown, qm, qs, nm, ns
      FROM s JOIN w ON w.day = s.day + 1 CROSS JOIN mu CROSS JOIN sd CROSS JOIN LATERAL (SELECT CASE WHEN s.mending THEN w.mended ELSE w.leaked END AS q) x)))
SELECT day, true AS ok, n AS throughput, round(q, 4) AS quality, '' AS alerts, '' AS actions FROM w WHERE day < 10
UNION ALL SELECT day, NOT alarm AND flow = '', n, round(q, 4), concat_ws(',', CASE WHEN alarm THEN 'quality_drift_down' END, nullif(flow, '')), CASE WHEN back THEN 'recovered' WHEN alarm THEN 'hillclimb' ELSE '' END FROM s WHERE day > 9"""


_RECORD_N = f"{_draw('field', 5)} % 6"
_REFERENCE = f"""{_features()}, {_UNPIVOT}, m AS (SELECT feature, count(*) n, median(value) med FROM long GROUP BY 1), st AS (SELECT feature, n, med, median(abs(value - med)) mad FROM long JOIN m USING (feature) GROUP BY 1, 2, 3)"""



def _days_before(day: int) -> str:
    return f"SELECT doc_id, coalesce(text, '') AS text, source FROM documents WHERE ({_draw('day', 0)}) % 3 < {day}"


ORACLES = {
    "curate_pages": f"SELECT doc_id, label, round(score, 6) AS score, stage, reasons, round(quality, 6) AS gate_quality, 'html-gate@v1' AS extractor FROM ({_curated_pages(0.5)})",
    "ledger_current": f"SELECT doc_id, ['filter', 'review', 'retain'][label + 1] AS decision, stage AS responsible_stage, 'day-1' AS fetch_time, doc_id AS supersedes, 2::BIGINT AS n_records FROM ({_curated_pages(0.8)})",
    "routine_ticks": _ticks(),
    "clean_corpus": _clean(),
    "benchmark_export": _exported(),
    "series_ewma": f"""WITH RECURSIVE {_daily()}, o AS (SELECT stream, mean_value AS x, row_number() OVER (PARTITION BY stream ORDER BY day) AS i FROM d),
w AS (SELECT stream, 1::BIGINT AS i, x AS z FROM o WHERE i = 1 UNION ALL SELECT w.stream, o.i, 0.3::DOUBLE * x + 0.7::DOUBLE * z FROM w JOIN o ON o.stream = w.stream AND o.i = w.i + 1) SELECT stream, substr(sha1(stream), 1, 12) AS digest, round(max_by(z, i), 6) AS ewma FROM w GROUP BY 1""",
    "gates_combined": f"SELECT doc_id, round(least(a.quality, b.quality), 6) AS quality FROM (SELECT doc_id, quality FROM ({_html(_PAGES)} SELECT * FROM q)) a JOIN (SELECT doc_id, quality FROM ({_ocr(_PAGES)} SELECT * FROM q)) b USING (doc_id)",
    "record_gate": f"""WITH r AS (SELECT doc_id, {_RECORD_N} AS c, count(*) OVER () AS total, count(*) FILTER ({_RECORD_N} = 5) OVER () AS gone FROM documents),
h AS (SELECT doc_id, 0::DOUBLE AS s_parse_fail, 0::DOUBLE AS s_truncated, CASE WHEN c = 5 AND total - gone >= 0.8::DOUBLE * total THEN 0.6::DOUBLE ELSE 0 END AS s_schema_missing, CASE WHEN c = 3 THEN 0.6::DOUBLE ELSE 0 END AS s_type_mismatch, CASE WHEN c IN (1, 2) THEN 0.5::DOUBLE ELSE 0 END AS s_empty_value FROM r),
q AS (SELECT *, {_quality(JSON_WEIGHTS)} AS quality, {_flags(JSON_WEIGHTS)} AS flags FROM h) SELECT doc_id, {', '.join(f'round(s_{k}, 6) AS s_{k}' for k in JSON_WEIGHTS)}, round(quality, 6) AS gate_quality, quality >= 0.5 AS gate_passed, flags FROM q""",
    "outliers_reference": f"""WITH st AS (SELECT * FROM ({_REFERENCE} SELECT * FROM st)), z AS (SELECT * FROM ({_features("SELECT concat_ws('-', conv_id, turn) AS doc_id, coalesce(text, '') AS text, coalesce(role, 'unknown') AS source FROM conversations")}, {_UNPIVOT} SELECT * FROM long)),
y AS (SELECT z.*, CASE WHEN mad > 1e-12 THEN abs(value - med) / (1.4826::DOUBLE * mad) ELSE 0 END AS z FROM z JOIN st USING (feature))
SELECT doc_id, source, coalesce(string_agg(feature, ',' ORDER BY i) FILTER (z >= 3.5), '') AS flags, round(coalesce(max(z) FILTER (z >= 3.5), 0), 4) AS outlier_score, coalesce(bool_or(z >= 3.5), false) AS is_outlier FROM y GROUP BY 1, 2""",
    "profile_char_classes": _profile("char_length", "alpha_fraction", "digit_fraction", "punct_fraction", "uppercase_fraction", "non_ascii_fraction"),
    "profile_line_structure": _profile("dup_line_fraction", "bullet_line_fraction", "ellipsis_line_fraction", "short_line_fraction", "mean_line_length"),
    "profile_lexical": _profile("token_length", "mean_word_length", "type_token_ratio", "bigram_repetition", "stopword_fraction", "symbol_word_ratio", "mojibake_fraction"),
    "profile_top_bigram": _profile("top_ngram_fraction"),
    "governance_score": f"{_SCORED} SELECT doc_id, round(g, 6) AS governance_score FROM s",
    "curate_heuristic": f"{_DECIDED} SELECT doc_id, label, label_name, round(g, 6) AS score, 'score' AS stage FROM e",
    "curate_judge_stub": f"{_DECIDED} SELECT doc_id, label, round(CASE WHEN middle THEN 0.5::DOUBLE ELSE g END, 6) AS score, CASE WHEN middle THEN 'judge-stub' ELSE 'score' END AS stage, middle AS escalated FROM e",
    "report_summary": f"{_DECIDED} SELECT count(*) AS n_docs, count(*) FILTER (label = 0) AS n_filter, count(*) FILTER (label = 1) AS n_review, count(*) FILTER (label = 2) AS n_retain, round(avg((label = 0)::INT), 4) AS rate_filter, round(avg((label = 1)::INT), 4) AS rate_review, round(avg((label = 2)::INT), 4) AS rate_retain, 1.0::DOUBLE AS mean_gate_quality, count(*) FILTER (middle) AS judge_calls, round(avg(middle::INT), 4) AS judge_rate FROM e",
    "report_by_source": f"{_DECIDED} SELECT source, {_N} FROM e GROUP BY 1",
    "report_counts": f"{_DECIDED} SELECT kind, value, count(*) AS n FROM (SELECT unnest([{{kind: 'label', value: label_name}}, {{kind: 'stage', value: 'score'}}, {{kind: 'source', value: source}}, {{kind: 'modality', value: 'text'}}, {{kind: 'risk', value: 'none'}}], recursive := true) FROM e) GROUP BY 1, 2",
    "responsibility": f"{_DECIDED} SELECT CASE WHEN middle THEN 'judge-stub' ELSE 'score' END AS stage, {_N} FROM e GROUP BY 1",
    "risk_grades": f"{_SCORED}, x AS (SELECT round(1 - g, 9) AS r FROM s) SELECT CASE WHEN r < 0.15::DOUBLE THEN 'none' WHEN r < 0.40::DOUBLE THEN 'low' WHEN r < 0.65::DOUBLE THEN 'medium' WHEN r < 0.85::DOUBLE THEN 'high' ELSE 'critical' END AS risk, count(*) AS n_docs FROM x GROUP BY 1",
    "cohort_stats": "WITH r AS (SELECT source, length(text)::DOUBLE AS x FROM documents), m AS (SELECT source, median(x) AS med FROM r GROUP BY 1) SELECT source, count(*) AS n, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS std, round(first(med), 4) AS med, round(median(abs(x - med)), 4) AS mad, round(quantile_cont(x, 0.25), 4) AS q1 FROM r JOIN m USING (source) GROUP BY 1",
    "cohort_median_mad": f"{_STATS} SELECT source, feature, n, round(med, 6) AS med, round(mad, 6) AS mad FROM st",
    "cohort_outliers": f"""{_STATS}, z AS (SELECT doc_id, long.source, i, long.feature, CASE WHEN coalesce(a.n, 0) < 12 THEN p.med ELSE a.med END AS med, CASE WHEN coalesce(a.n, 0) < 12 THEN p.mad ELSE a.mad END AS mad, value
  FROM long LEFT JOIN st a ON a.source = long.source AND a.feature = long.feature JOIN st p ON p.source = '*' AND p.feature = long.feature),
y AS (SELECT *, CASE WHEN mad > 1e-12 THEN abs(value - med) / (1.4826::DOUBLE * mad) ELSE 0 END AS z FROM z)
SELECT doc_id, source, coalesce(string_agg(feature, ',' ORDER BY i) FILTER (z >= 3.5), '') AS flags, round(coalesce(max(z) FILTER (z >= 3.5), 0), 4) AS outlier_score, coalesce(bool_or(z >= 3.5), false) AS is_outlier FROM y GROUP BY 1, 2""",
    "outliers_ksigma": f"{_LONG}, c AS (SELECT feature, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd FROM long GROUP BY 1) SELECT doc_id, bool_or(sd > 1e-9 AND abs(value - mean) / nullif(sd, 0) >= 3.5) AS is_outlier FROM long JOIN c USING (feature) GROUP BY 1",
    "html_gate_pages": f"{_html(_PAGES)} SELECT doc_id, {', '.join(f'round(s_{k}, 6) AS s_{k}' for k in HTML_WEIGHTS)}, round(quality, 6) AS gate_quality, quality >= 0.5 AS gate_passed, flags FROM q",
    "ocr_gate_documents": f"{_ocr()} SELECT doc_id, {', '.join(f'round(s_{k}, 6) AS s_{k}' for k in OCR_WEIGHTS)}, round(quality, 6) AS gate_quality, quality >= 0.5 AS gate_passed, flags FROM q",
    "guard_fpr": f"{_html(_PAGES)} SELECT round(coalesce(avg((quality < 0.5)::INT), 0), 6) AS guard_fpr FROM q",
    "json_infer_schema": "WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events), t AS (SELECT key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' ELSE 'other' END AS kind FROM k) SELECT key, mode(kind) AS kind, count(*) AS n_records FROM t GROUP BY 1 HAVING count(*) >= 0.8 * (SELECT count(*) FROM events)",
    "json_gate_events": _JUDGED.format(rows=f"SELECT * FROM ({_EVENTS}) UNION ALL {_BROKEN}") + f""", v AS (SELECT *, parses AND json_type(CASE WHEN parses THEN raw END) = 'OBJECT' AS named, json_type(CASE WHEN parses THEN raw END, '$.k') AS kind FROM j),
g AS (SELECT (NOT parses)::INT AS s_parse_fail, (NOT balanced)::INT AS s_truncated, (named AND kind IS NULL)::INT AS s_schema_missing, coalesce(named AND kind NOT IN ('UBIGINT', 'BIGINT', 'NULL'), false)::INT AS s_type_mismatch, coalesce(named AND kind = 'NULL', false)::INT AS s_empty_value FROM v),
q AS (SELECT {_quality(JSON_WEIGHTS)} AS quality, {_flags(JSON_WEIGHTS)} AS flags FROM g) SELECT quality >= 0.5 AS gate_passed, flags, round(quality, 6) AS gate_quality, count(*) AS n FROM q GROUP BY 1, 2, 3""",
    "json_balanced": _JUDGED.format(rows=_BROKEN) + " SELECT doc_id, raw, balanced, parses FROM j",
    "baseline_parse_only": _JUDGED.format(rows=_BROKEN) + " SELECT doc_id, parses AS gate_passed FROM j",
    "provenance_ledger": f"{_DECIDED} SELECT doc_id, source, '2024-01-01T00:00:00Z' AS fetch_time, 'text' AS modality, 'surface@v1' AS extractor, 1.0::DOUBLE AS gate_quality, label_name AS decision, 'score' AS responsible_stage, substr(sha1('html:0.5000|json:0.5000|ocr:0.5000|cas:0.620,0.300'), 1, 12) AS config_hash FROM e",
    "macro_f1_labels": f"{_DECIDED} SELECT round({_macro('label', f'({_GOLD})')}, 6) AS macro_f1, round(avg((label = {_GOLD})::INT), 6) AS agreement, count(*) AS n FROM e JOIN labels USING (doc_id)",
    "binary_prf_labels": f"{_DECIDED}, n AS (SELECT count(*) FILTER (label > 0 AND quality = 1) tp, count(*) FILTER (label > 0 AND quality = 0) fp, count(*) FILTER (label = 0 AND quality = 1) fn FROM e JOIN labels USING (doc_id)) SELECT round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall, round({_F1}, 6) AS f1 FROM n",
    "cascade_budget_curve": f"""{_SCORED}, r AS (SELECT {_GOLD} AS gold, row_number() OVER (ORDER BY round(g, 9), doc_id) - 1 AS rank, count(*) OVER () AS n FROM s JOIN labels USING (doc_id)),
b AS (SELECT *, round_even(fraction * n, 0)::BIGINT AS k FROM r CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0])::DOUBLE AS fraction)),
x AS (SELECT *, rank >= (n - k) // 2 AND rank < (n - k) // 2 + k AS asked, CASE WHEN rank < (n - k) // 2 THEN 0 WHEN rank >= (n - k) // 2 + k THEN 2 ELSE gold END AS pred FROM b)
SELECT fraction, round({_macro('pred', 'gold')}, 6) AS macro_f1, round(avg((pred = gold)::INT), 6) AS agreement, count(*) FILTER (asked) AS judge_calls FROM x GROUP BY 1""",
    **{f"corrupt_html_{k}": _mutated("text", op()) for k, op in _OPS["html"].items()},
    **{f"corrupt_ocr_{k}": _mutated("text", op()) for k, op in _OPS["ocr"].items()},
    **{f"corrupt_json_{k}": _mutated("raw", op(), _EVENTS) for k, op in _OPS["json"].items()},
    "corrupt_content_risk": _mutated("text", f"text || chr(10) || {_pick(X.RISK_HELDOUT, _draw('risk'))} || '.'"),
    "corrupt_content_contradiction": _mutated("text", f"text || ' ' || {_pick(X.CONTRADICTIONS_HELDOUT, _draw('contra'))} || '.'"),
    "mutation_eval": _scores("(0, 2.0::DOUBLE, 0.5::DOUBLE)") + " SELECT candidate_id, slice, seed, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, n FROM v",
    "floor_upper": _scores("(0, 2.0::DOUBLE, 0.5::DOUBLE)") + " SELECT slice, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall, round(avg(fpr), 6) AS fpr FROM v GROUP BY 1",
    "candidate_grid_objective": _scores(_GRID) + " SELECT candidate_id, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall, round(avg(fpr), 6) AS fpr, round(avg(f1) - 0.5::DOUBLE * avg(fpr), 6) AS objective FROM v WHERE slice = 'heldout' GROUP BY 1",
    "accept_rule": _scores(_GRID) + """, p AS (SELECT count(*) n, avg(b.f1 - a.f1) d, stddev_samp(b.f1 - a.f1) sd, avg(b.fpr) - avg(a.fpr) f FROM v a JOIN v b ON a.seed = b.seed AND a.slice = 'heldout' AND b.slice = 'heldout' AND a.candidate_id = 0 AND b.candidate_id = 3),
l AS (SELECT *, d - 2.776::DOUBLE * sd / sqrt(5) AS low FROM p) SELECT low > 0.005 AND f <= 0.005 AS accept, round(d, 6) AS delta_f1, round(low, 6) AS lower_bound, round(f, 6) AS delta_fpr, CASE WHEN low > 0.005 AND f <= 0.005 THEN 'ok' WHEN low <= 0.005 THEN 'gain not significant' ELSE 'FPR regression' END AS reason FROM l""",
    "naive_text": f"SELECT doc_id, source, text FROM ({_PAGES})",
    "simple_reextract": r"SELECT page_id AS doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND (length(x) >= 25 OR regexp_matches(x, '[.?!]$'))), lambda x: regexp_replace(x, 'https?://\S+', '', 'g')), ' ') AS text FROM pages",
    "daily_streams": f"WITH {_daily()} SELECT stream, day::INT AS day, throughput, round(mean_value, 6) AS mean_value FROM d",
    "spc_throughput": _chart("throughput"),
    "spc_value_down": _chart("mean_value", "down"),
    "baseline_gopher": f"""WITH src AS ({_PAGES}),{_SPLIT}, h AS (SELECT doc_id, {_clamp('1 - least(1, ' + _div(f"len(list_filter(words, lambda w: w IN {_list(X.PROFILE_STOPWORDS)}))", 'nw') + ' / 0.15::DOUBLE)')} AS s_stopword_deficit,
  {_clamp('1.5::DOUBLE * ' + _div(' + '.join(_count('text', s) for s in ('#', '...', '…')), 'nw') + ' + 4 * ' + _count('lower(text)', 'http') + ' / greatest(nt, 1)')} AS s_symbols FROM f), q AS (SELECT *, (1 - s_stopword_deficit) * (1 - s_symbols) AS quality FROM h)
SELECT doc_id, round(s_stopword_deficit, 6) AS s_stopword_deficit, round(s_symbols, 6) AS s_symbols, round(quality, 6) AS gate_quality, quality >= 0.5 AS gate_passed FROM q""",
    "baseline_dict_oov": r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS words FROM documents),
k AS (SELECT doc_id, count(*) FILTER (w NOT IN (SELECT w FROM v)) AS miss FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, round(coalesce(miss / nullif(len(words), 0), 0), 6) AS oov_share, round(least(1, 2 * coalesce(miss / nullif(len(words), 0), 0)), 6) AS s_oov FROM d LEFT JOIN k USING (doc_id)""",
}
ORACLES["curate_budget"] = f"""{_SCORED}, n AS (SELECT count(*) AS n, round_even(0.2::DOUBLE * count(*), 0)::BIGINT AS k FROM s), o AS (SELECT doc_id, row_number() OVER (ORDER BY round(g, 9), doc_id) - 1 AS r FROM s),
b AS (SELECT doc_id, r < (n - k) // 2 AS low, r >= (n - k) // 2 + k AS high FROM o, n)
SELECT doc_id, CASE WHEN low THEN 0 WHEN high THEN 2 ELSE 1 END AS label, CASE WHEN low OR high THEN 'score' ELSE 'judge-stub' END AS stage, NOT low AND NOT high AS escalated FROM b"""
ORACLES["spc_events"] = """WITH RECURSIVE o AS (SELECT event_type AS stream, event_id AS day, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
m AS (SELECT stream, median(x) AS mu FROM o WHERE i <= 100 GROUP BY 1),
b AS (SELECT stream, mu, greatest(1e-9, 1.4826::DOUBLE * median(abs(x - mu)), 0.02::DOUBLE * (abs(mu) + 1e-6)) AS sigma FROM o JOIN m USING (stream) WHERE i <= 100 GROUP BY 1, 2),
w AS (SELECT stream, 100::BIGINT AS i, mu AS z, 0::DOUBLE AS up, 0::DOUBLE AS down FROM b
  UNION ALL SELECT w.stream, o.i, 0.2::DOUBLE * x + 0.8::DOUBLE * z, greatest(0, up + (x - mu - 0.5::DOUBLE * sigma)), greatest(0, down - (x - mu + 0.5::DOUBLE * sigma)) FROM w JOIN o ON o.stream = w.stream AND o.i = w.i + 1 JOIN b ON b.stream = w.stream),
r AS (SELECT w.*, day, x, mu, sigma, sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (w.i - 100)))) AS width FROM w JOIN o USING (stream, i) JOIN b USING (stream) WHERE w.i > 100)
SELECT stream, day, x AS value, round(z + 2.718e-7, 6) AS ewma, round(up + 2.718e-7, 6) AS cusum_pos, round(down + 2.718e-7, 6) AS cusum_neg, abs(z - mu) > 3 * width AND z > mu AS ewma_alarm, up > 4 * sigma AS cusum_alarm,
  CASE WHEN z < mu OR down > 4 * sigma THEN 'down' WHEN z > mu OR up > 4 * sigma THEN 'up' ELSE 'none' END AS direction FROM r"""
ORACLES["window_stream"] = ORACLES["outliers_reference"]
ORACLES["window_versions"] = " UNION ALL ".join(f"SELECT {v} AS version, source, feature, n, round(med, 6) AS med, round(mad, 6) AS mad FROM ({_stats(_days_before(v))} SELECT * FROM st)" for v in (1, 2, 3))
ORACLES["routine_stream"] = ORACLES["routine_ticks"]
ORACLES["ledger_versions"] = f"""SELECT 0 AS as_of, doc_id, ['filter', 'review', 'retain'][label + 1] AS decision, stage AS responsible_stage, 'day-0' AS fetch_time FROM ({_curated_pages(0.5)})
UNION ALL SELECT 1, doc_id, ['filter', 'review', 'retain'][label + 1], stage, 'day-0' FROM ({_curated_pages(0.5)}) WHERE doc_id % 2 <> 0
UNION ALL SELECT 1, doc_id, ['filter', 'review', 'retain'][label + 1], stage, 'day-1' FROM ({_curated_pages(0.8)}) WHERE doc_id % 2 = 0"""
ORACLES["curate_with_outliers"] = f"""SELECT label_name, is_outlier, count(*) AS n_docs FROM (SELECT doc_id, label_name FROM ({_DECIDED} SELECT * FROM e)) JOIN (SELECT doc_id, is_outlier FROM ({ORACLES["cohort_outliers"]})) USING (doc_id) GROUP BY 1, 2"""
