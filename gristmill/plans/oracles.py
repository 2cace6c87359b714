"""DuckDB SQL of the engine's own queries."""

from __future__ import annotations

RATIO, SEED = 1.0 - 0.9, 1337

_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
O: dict[str, str] = {}


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def norm(x: str) -> str:
    line = rf"CASE WHEN starts_with(l, '    ') OR starts_with(l, chr(9)) THEN regexp_replace(l, '{_WHITE}+$', '') ELSE {strip("regexp_replace(l, '[ \\t]+', ' ', 'g')")} END"
    return rf"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g'), chr(10)), lambda l: {line}), chr(10)), '^\n+|\n+$', '', 'g')"


def js(x: str) -> str:
    slash, quote = chr(92), chr(34)
    out = f"replace(replace({x}, '{slash}', '{slash}{slash}'), '{quote}', '{slash}{quote}')"
    for code, name in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        out = f"replace({out}, chr({code}), '{slash}{name}')"
    return f"'{quote}' || {out} || '{quote}'"


def fp(x: str) -> str:
    return f"""sha256('{{"fields":{{}},"text":' || {js(x)} || '}}')"""


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def toks(x: str) -> str:
    one = "CASE WHEN len(t) > 4 AND t LIKE '%ies' THEN left(t, len(t) - 3) || 'y' WHEN len(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' AND t NOT LIKE '%us' THEN left(t, len(t) - 1) ELSE t END"
    return rf"list_transform(regexp_extract_all({folded(norm(x))}, '[a-z0-9]+(?:[._/-][a-z0-9]+)*'), lambda t: {one})"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '{_WHITE}+'), lambda w: w <> '')"


def cte(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


KEY = "'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')"
BASE = f"base AS (SELECT {KEY} AS document_id, text, source, lang, doc_id FROM documents)"
DOCS = f"{BASE}, docs AS (SELECT *, {fp('text')} AS raw, {fp(norm('text'))} AS fp, {norm('text')} AS canon FROM base)"
LOOSE = "chr(10) || ' ' || chr(10) || replace(replace(text, chr(10), ' ' || chr(13) || chr(10)), ' ', '  ') || chr(10) || chr(9) || chr(10)"
VARS = f"{BASE}, twice AS (SELECT document_id, text, source FROM base UNION ALL SELECT replace(document_id, 'doc-', 'var-'), {LOOSE}, source FROM base), docs AS (SELECT *, {fp('text')} AS raw, {fp(norm('text'))} AS fp, {norm('text')} AS canon FROM twice)"
GROUPS = "ranked AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY document_id, source, raw) AS rn FROM docs), groups AS (SELECT fp, min(document_id) FILTER (rn = 1) AS rep, count(*) AS members, count(*) - count(DISTINCT raw) AS raw_dups FROM ranked GROUP BY fp)"


#: The least numbers of 256 bits whose shares reach the ratios used, in double precision: a share rounds up to a ratio from half of its last place on.
THRESHOLDS = {0.09999999999999998: "1999999999999780000000000000000000000000000000000000000000000000", 0.1: "1999999999999980000000000000000000000000000000000000000000000000", 1e-09: "000000044b82fa09b5a520000000000000000000000000000000000000000001", 0.999999999: "fffffffbb47d0400000000000000000000000000000000000000000000000001"}


def threshold(ratio: float) -> str:
    return THRESHOLDS[ratio]


def split_hash(key: str, seed: int) -> str:
    return f"sha256('1' || chr(0) || '{seed}' || chr(0) || {key})"


SPLIT = f"splits AS (SELECT *, CASE WHEN {split_hash('fp', SEED)} < '{threshold(RATIO)}' THEN 'validation' ELSE 'train' END AS split FROM groups)"
PAIRS = "turns AS (SELECT *, lag(role) OVER w AS r0, lag(text) OVER w AS t0, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS system FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id, turn, system, t0 AS \"user\", text AS assistant FROM turns WHERE role = 'assistant' AND r0 = 'user')"
CHAT = "'<|user|>' || chr(10) || \"user\" || chr(10) || '<|assistant|>' || chr(10) || assistant || chr(10) || '<|end|>'"
PROMPTS = f"prompts AS (SELECT 'bench.' || item_id AS prompt_id, 'bench' AS suite, {norm('text')} AS canon FROM benchmark)"
FOUND = "found AS (SELECT p.prompt_id, p.suite, d.document_id, d.source, CASE WHEN d.canon = p.canon THEN 'full-document' ELSE 'normalized-substring' END AS match_type, left(d.fp, 12) AS document_fingerprint, d.fp FROM docs d JOIN prompts p ON contains(d.canon, p.canon))"

O["normalize_documents"] = f"SELECT doc_id, sha256({norm('text')}) AS sha, len({norm('text')}) AS chars FROM documents"
O["normalize_variants"] = cte(VARS) + "SELECT document_id, sha256(canon) AS sha, len(canon) AS chars FROM docs"
O["document_fingerprints"] = cte(VARS) + "SELECT document_id, raw AS raw_fingerprint, fp AS canonical_fingerprint FROM docs"
O["derived_document_ids"] = f"""SELECT doc_id, 'doc-' || left(sha256('{{"content":{{"fields":{{}},"text":' || {js(norm("text"))} || '}},"source":' || {js("'corpus/' || source")} || '}}'), 24) AS document_id FROM documents"""
O["dedup_groups"] = cte(VARS, GROUPS) + "SELECT fp AS canonical_fingerprint, rep AS representative_id, members, raw_dups AS raw_duplicates FROM groups"
O["dedup_representatives"] = cte(DOCS, GROUPS) + "SELECT document_id, source, fp AS canonical_fingerprint FROM ranked WHERE rn = 1"
O["dedup_counts"] = cte(VARS, GROUPS) + "SELECT CAST(sum(members) AS BIGINT) AS documents, count(*) AS groups, CAST(sum(members) - count(*) AS BIGINT) AS removed, CAST(sum(raw_dups) AS BIGINT) AS raw_duplicates, CAST(sum(members) - count(*) - sum(raw_dups) AS BIGINT) AS canonical_duplicates FROM groups"
O["removed_duplicates"] = cte(DOCS, GROUPS) + "SELECT r.fp AS canonical_fingerprint, g.rep AS representative_id, r.document_id FROM ranked r JOIN groups g USING (fp) WHERE rn > 1"
O["removed_duplicate_groups"] = cte(DOCS, GROUPS) + "SELECT g.rep AS representative_id, string_agg(r.document_id, ',' ORDER BY r.document_id) AS removed, count(*) AS n FROM ranked r JOIN groups g USING (fp) WHERE rn > 1 GROUP BY 1"
O["ambiguous_ids"] = cte(DOCS) + "SELECT source || '-' || lang AS document_id, count(DISTINCT fp) AS contents FROM docs GROUP BY 1 HAVING count(DISTINCT fp) > 1"
O["conflicting_splits"] = cte(DOCS) + "SELECT fp AS canonical_fingerprint, count(*) AS members FROM docs GROUP BY fp HAVING count(DISTINCT CASE WHEN source < 'src3' THEN 'train' WHEN source > 'src6' THEN 'validation' END) > 1"
O["hash_split"] = cte(DOCS, GROUPS, SPLIT) + "SELECT rep AS document_id, split FROM splits"
O["split_counts"] = cte(DOCS, GROUPS, SPLIT) + "SELECT split, count(*) AS groups, CAST(sum(members) AS BIGINT) AS documents FROM splits GROUP BY split"
O["split_explicit_override"] = cte(DOCS, GROUPS, SPLIT, "asked AS (SELECT fp, min(CASE WHEN lang = 'es' THEN 'validation' END) AS e FROM docs GROUP BY fp)") + "SELECT rep AS document_id, e AS explicit_split, coalesce(e, split) AS split FROM splits JOIN asked USING (fp)"
_region = f"r AS (SELECT DISTINCT {fp(norm('r_name'))} AS fp FROM region), h AS (SELECT fp, {split_hash('fp', SEED)} AS h FROM r)"
O["split_fallback_tiny"] = cte(_region) + "SELECT 'low' AS \"case\", fp AS canonical_fingerprint, CASE WHEN h = (SELECT min(h) FROM h) THEN 'validation' ELSE 'train' END AS split FROM h UNION ALL SELECT 'high', fp, CASE WHEN h = (SELECT max(h) FROM h) THEN 'train' ELSE 'validation' END FROM h"
O["split_leakage_check"] = cte(DOCS) + " UNION ALL ".join(f"SELECT '{n}' AS identity, count(*) AS overlapping FROM (SELECT {c} FROM docs WHERE source < 'src4' INTERSECT SELECT {c} FROM docs WHERE source >= 'src4')" for n, c in (("document_id", "document_id"), ("raw_fingerprint", "raw"), ("canonical_fingerprint", "fp")))
_FAM = "fam AS (SELECT source AS family, source || ':' || lang || ':' || (len(text) % 7) AS group_id, doc_id FROM documents)"
_FSPLIT = f"scored AS (SELECT DISTINCT family, group_id, {split_hash('group_id', 20260722)} AS h FROM fam), sides AS (SELECT *, h < '{threshold(0.1)}' AS v FROM scored), ends AS (SELECT family, bool_or(v) AS any_v, bool_and(v) AS all_v, count(*) AS n, min(h) AS lo, max(h) AS hi FROM sides GROUP BY family), fsplit AS (SELECT family, group_id, CASE WHEN NOT any_v AND h = lo THEN 'validation' WHEN all_v AND n > 1 AND h = hi THEN 'train' WHEN v THEN 'validation' ELSE 'train' END AS split FROM sides JOIN ends USING (family))"
O["family_group_split"] = cte(_FAM, _FSPLIT) + "SELECT * FROM fsplit"
O["family_split_pivot"] = cte(_FAM, _FSPLIT) + "SELECT family, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation FROM fam JOIN fsplit USING (family, group_id) GROUP BY family"
O["group_size_distribution"] = cte(_FAM, "s AS (SELECT family, group_id, count(*) AS n FROM fam GROUP BY ALL)") + "SELECT family, count(*) AS groups, min(n) AS least, max(n) AS most, median(n) AS median, round_even(avg(n), 3) AS mean FROM s GROUP BY family"
O["contamination_findings"] = cte(DOCS, PROMPTS, FOUND) + "SELECT prompt_id, suite, document_id, source, match_type, document_fingerprint FROM found"
O["contamination_by_split"] = cte(DOCS, GROUPS, SPLIT, PROMPTS, FOUND) + "SELECT prompt_id, document_id, split, match_type FROM found JOIN splits USING (fp)"
O["contamination_summary"] = cte(DOCS, PROMPTS, FOUND) + "SELECT suite, match_type, count(*) AS findings, count(DISTINCT prompt_id) AS prompts, count(DISTINCT document_id) AS documents FROM found GROUP BY ALL"
O["contamination_field_exact"] = cte(PAIRS, f"p AS (SELECT 'pair.' || conv_id || '.' || turn AS document_id, {norm('\"user\"')} AS u, {norm('assistant')} AS a, {norm(CHAT)} AS t FROM pairs), q AS (SELECT 'turn.' || conv_id || '.' || turn AS prompt_id, {norm('text')} AS c FROM conversations WHERE role = 'user')") + "SELECT prompt_id, document_id, CASE WHEN t = c THEN 'full-document' WHEN u = c OR a = c THEN 'field-exact' ELSE 'normalized-substring' END AS match_type FROM p JOIN q ON c <> '' AND (contains(t, c) OR contains(u, c) OR contains(a, c))"
_SIM = """CASE WHEN lj = rj THEN 1.0 ELSE round_even(greatest(2.0 * ss / (ld + rd), 2.0 * sb / (ln + rn),
  CASE WHEN least(ln, rn) < 2 THEN 0.0 WHEN (ln <= rn AND contains(' ' || rj || ' ', ' ' || lj || ' ')) OR (ln > rn AND contains(' ' || lj || ' ', ' ' || rj || ' ')) THEN 1.0
       WHEN ss / CAST(CASE WHEN ln <= rn THEN ld ELSE rd END AS DOUBLE) >= 0.9 THEN least(1.0, least(ln, rn) / CAST(greatest(ln, rn) AS DOUBLE) + 0.35) ELSE 0.0 END), 6) END"""


def near(left: str, right: str | None) -> str:
    """CTEs of classes and pairs, from CTEs (id, text)."""
    right_name = right or left
    sides = {left, right_name}
    parts = []
    for s in sorted(sides):
        parts.append(f"c_{s} AS (SELECT min(id) AS id, any_value(tk) AS tk, j FROM (SELECT id, {toks('text')} AS tk, array_to_string({toks('text')}, ' ') AS j FROM {s}) WHERE len(tk) > 0 GROUP BY j)")
        parts.append(f"n_{s} AS (SELECT id, t, count(*) AS k FROM (SELECT id, unnest(tk) AS t FROM c_{s}) GROUP BY ALL)")
    cond = "a.id < b.id" if right is None else "TRUE"
    parts.append(f"shared AS (SELECT a.id AS l, b.id AS r, count(*) AS ss, sum(least(a.k, b.k)) AS sb FROM n_{left} a JOIN n_{right_name} b ON a.t = b.t AND {cond} GROUP BY ALL)")
    parts.append(
        f"near AS (SELECT l AS left_id, r AS right_id, CAST({_SIM} AS DOUBLE) AS similarity FROM (SELECT l, r, ss, sb, len(a.tk) AS ln, len(b.tk) AS rn, len(list_distinct(a.tk)) AS ld, len(list_distinct(b.tk)) AS rd, a.j AS lj, b.j AS rj FROM shared JOIN c_{left} a ON a.id = l JOIN c_{right_name} b ON b.id = r))"
    )
    return ", ".join(parts)


O["near_duplicates_vs_benchmark"] = cte(f"d AS (SELECT {KEY} AS id, text FROM documents)", "b AS (SELECT 'bench.' || item_id AS id, text FROM benchmark)", near("d", "b")) + "SELECT * FROM near WHERE similarity >= 0.82"
_T = "one AS (SELECT 'turn.' || conv_id || '.' || turn AS id, text, conv_id FROM conversations), t AS (SELECT id, text FROM one UNION ALL SELECT 'again.' || id, 'Well then, ' || text FROM one WHERE conv_id % 5 = 0)"
O["near_duplicates_self"] = cte(_T, near("t", None)) + "SELECT * FROM near WHERE similarity >= 0.82"
O["near_duplicate_members"] = cte(_T, near("t", None)) + f"SELECT t.id AS item_id, c.id AS rep FROM t JOIN c_t c ON array_to_string({toks('t.text')}, ' ') = c.j"
_FAMILY = "CASE WHEN len(\"user\") < 60 THEN 'short' WHEN len(\"user\") < 200 THEN 'medium' ELSE 'long' END"
_REC = f"rec AS (SELECT 'rec.' || conv_id || '.' || turn AS id, 'chat-v1/' || conv_id AS source, {_FAMILY} AS category, 'chat-v1:' || conv_id AS group_id, \"user\", assistant, {CHAT} AS text FROM pairs)"
_AGAIN = "both_rec AS (SELECT id, source, category, group_id, \"user\" FROM rec UNION ALL SELECT id || '.again', CASE WHEN c % 3 = 0 THEN source ELSE source || '/again' END, category, group_id || ':again', 'Well then, ' || \"user\" FROM (SELECT *, CAST(split_part(id, '.', 2) AS BIGINT) AS c FROM rec) WHERE c % 5 = 0)"
O["near_duplicate_review"] = cte(PAIRS, _REC, _AGAIN, "u AS (SELECT id, \"user\" AS text FROM both_rec)", near("u", None)) + """SELECT left_id, right_id, similarity, a.category AS left_family, b.category AS right_family, a.group_id AS left_group, b.group_id AS right_group,
 CASE WHEN a.source = b.source OR (a.group_id = b.group_id AND a.group_id = 'chat-v1:0') THEN 'expected same-cluster variant' WHEN greatest(left_id, right_id) = least(left_id, right_id) || '.again' AND CAST(split_part(left_id, '.', 2) AS BIGINT) % 3 = 1 THEN 'legitimate cross-topic wording' ELSE 'rewrite required' END AS classification
 FROM near JOIN both_rec a ON a.id = left_id JOIN both_rec b ON b.id = right_id WHERE similarity >= 0.82"""


def _likeness(a: str, b: str) -> str:
    count = lambda x: f"len(list_filter({x}, lambda y: y = w))"
    bags, sets = f"list_sum(list_transform(list_distinct({a}), lambda w: least({count(a)}, {count(b)})))", f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    pad = lambda x: f"' ' || array_to_string({x}, ' ') || ' '"
    short, few = f"least(len({a}), len({b}))", f"CASE WHEN len({a}) <= len({b}) THEN len(list_distinct({a})) ELSE len(list_distinct({b})) END"
    inside = f"CASE WHEN len({a}) <= len({b}) THEN contains({pad(b)}, {pad(a)}) ELSE contains({pad(a)}, {pad(b)}) END"
    held = f"CASE WHEN {short} < 2 THEN 0.0 WHEN {inside} THEN 1.0 WHEN {sets} / ({few}) >= 0.9 THEN least(1.0, {short} / greatest(len({a}), len({b})) + 0.35) ELSE 0.0 END"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE round_even(greatest(2.0 * {sets} / (len(list_distinct({a})) + len(list_distinct({b}))), 2.0 * {bags} / (len({a}) + len({b})), {held})::DOUBLE, 6) END::DOUBLE"


O["similarity_cases"] = f"WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type || ' ' || p_name || ' ' || p_brand), ' ') AS b, string_split(lower(p_type), ' ') AS c, string_split(lower(p_type || ' ' || p_type), ' ') AS d FROM part) SELECT p_partkey AS case, {_likeness('a', 'b')} AS similarity, {_likeness('c', 'd')} AS doubled FROM t"
O["conversation_pairs"] = cte(PAIRS) + "SELECT * FROM pairs"
_field = lambda x: strip(f"replace(coalesce({x}, ''), chr(13) || chr(10), chr(10))")
O["message_tree_pairs"] = f"SELECT a.conv_id * 1000 + a.turn AS message_id, {_field('p.text')} AS prompt, {_field('a.text')} AS answer FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 WHERE a.role = 'assistant' AND p.role = 'user' AND {_field('p.text')} <> '' AND {_field('a.text')} <> ''"
O["instruction_import"] = "SELECT p_name || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || 'Context:' || chr(10) || p_type ELSE '' END AS \"user\", p_brand AS assistant, p_type AS category FROM part"
_SYS = f"CASE WHEN coalesce(system, '') <> '' THEN '<|system|>' || chr(10) || system || chr(10) ELSE '' END || {CHAT}"
O["format_chat_text"] = cte(PAIRS) + f"SELECT conv_id, turn, sha256({_SYS}) AS sha, len({_SYS}) AS chars FROM pairs"
O["chat_history_prompts"] = cte(PAIRS, f"h AS (SELECT conv_id, turn, list({CHAT}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS past, '<|user|>' || chr(10) || \"user\" || chr(10) || '<|assistant|>' || chr(10) AS ask FROM pairs)") + "SELECT conv_id, turn, coalesce(len(past), 0) AS turns, sha256(array_to_string(list_append(coalesce(past, []), ask), chr(10))) AS sha FROM h"
_both = folded("\"user\" || chr(10) || assistant")
_rules = {
    "blank field": f"{strip('\"user\"')} = '' OR {strip('assistant')} = ''", "unknown family": "category NOT IN ('short', 'medium')", "control token": " OR ".join(f"contains({_both}, '{t}')" for t in ("<|system|>", "<|user|>", "<|assistant|>", "<|end|>")),
    "placeholder": " OR ".join(f"contains({_both}, '{t}')" for t in ("todo", "tbd", "lorem ipsum")), "malformed command": f"contains({_both}, 'python chat.py.py') OR contains({_both}, 'pythonchat.py')",
    "malformed api": f"contains({_both}, 'torch.cuda.isavailable') OR contains({_both}, 'torch.cuda.available')", "contradiction": f"category = 'short' AND contains({folded('assistant')}, 'the')", "too long": "len(text) > 1800",
}
O["sft_rule_violations"] = cte(PAIRS, _REC, f"k AS (SELECT id, array_to_string({toks('\"user\"')}, ' ') AS p, \"user\" || chr(1) || assistant AS c FROM rec)") + " UNION ALL ".join(
    [f"SELECT id, '{n}' AS rule FROM rec WHERE {t}" for n, t in _rules.items()]
    + [f"SELECT id, '{n}' FROM (SELECT id, row_number() OVER (PARTITION BY {c} ORDER BY id) AS rn FROM k) WHERE rn > 1" for n, c in (("repeated prompt", "p"), ("repeated conversation", "c"))]
    + ["SELECT id, 'group in several families' FROM rec WHERE group_id IN (SELECT group_id FROM rec GROUP BY group_id HAVING count(DISTINCT category) > 1)"]
)
O["sft_family_balance"] = cte(PAIRS, _REC) + "SELECT category, count(*) AS records, count(*) < 50 AS too_few, count(*) / CAST((SELECT count(*) FROM rec) AS DOUBLE) > 0.15 AS too_many FROM rec GROUP BY category"
O["sft_audit"] = cte(PAIRS, f"d AS (SELECT {fp(CHAT)} AS raw, {fp(norm(CHAT))} AS fp, {norm(CHAT)} AS canon FROM pairs)", PROMPTS, "g AS (SELECT fp, count(*) AS n, count(*) - count(DISTINCT raw) AS r FROM d GROUP BY fp)") + "SELECT CAST(sum(n) AS BIGINT) AS documents, count(*) AS groups, CAST(sum(n) - count(*) AS BIGINT) AS removed, CAST(sum(r) AS BIGINT) AS raw_duplicates, CAST(sum(n) - count(*) - sum(r) AS BIGINT) AS canonical_duplicates, (SELECT count(*) FROM d JOIN prompts p ON contains(d.canon, p.canon)) AS findings FROM g"
O["sft_word_buckets"] = cte(PAIRS, f"n AS (SELECT len({words('assistant')}) AS n FROM pairs)") + "SELECT count(*) AS records, min(n) AS least, max(n) AS most, round_even(avg(n), 3) AS mean, count(*) FILTER (n <= 12) AS to_12, count(*) FILTER (n BETWEEN 13 AND 24) AS to_24, count(*) FILTER (n BETWEEN 25 AND 40) AS to_40, count(*) FILTER (n > 40) AS over_40 FROM n"
O["category_balance"] = "SELECT coalesce(a.lang, b.lang) AS category, coalesce(b.n, 0) AS expected, coalesce(a.n, 0) AS actual, coalesce(a.n, 0) = coalesce(b.n, 0) AS ok FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) b ON a.lang = b.lang"
O["label_quality_filter"] = "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) GROUP BY lang"
O["cross_dataset_overlap"] = cte(PAIRS, f"k AS (SELECT array_to_string({toks('\"user\"')}, ' ') AS p, \"user\" AS u, assistant AS a FROM pairs)", f"t AS (SELECT array_to_string({toks('text')}, ' ') AS p FROM conversations)") + "SELECT (SELECT count(DISTINCT p) FROM k WHERE p <> '' AND p IN (SELECT p FROM t)) AS prompts, (SELECT count(DISTINCT u) FROM k WHERE u = a) AS conversations"
O["prompt_coverage"] = cte(PROMPTS, f"t AS (SELECT DISTINCT lower({norm('text')}) AS canon FROM (SELECT text FROM conversations WHERE role = 'user' UNION ALL SELECT text FROM documents))") + "SELECT prompt_id, count(t.canon) AS turns FROM prompts p LEFT JOIN t ON t.canon <> '' AND (contains(t.canon, lower(p.canon)) OR contains(lower(p.canon), t.canon)) GROUP BY prompt_id"
_S = "'One is on the shelf.'"
_forms = {
    "direct_definition": ("p_name || ': what is meant?'", "fact"), "scenario": (f"{_S} || ' And now?'", "ex"), "comparison": ("p_name || ' or the opposite (All are alike.)?'", "fact || ' The opposite fails.'"),
    "misconception_correction": ("'True or false: All are alike.'", "'False. ' || fact"), "why": (f"{_S} || ' What is ' || p_name || ' good for?'", "fact"),
    "how": (f"{_S} || ' Which way does ' || p_name || ' work?'", "ex"), "command_oriented": ("p_name || ', step by step, please.'", "ex"), "example_request": ("'One case of ' || p_name || '?'", "ex"),
}
O["lesson_records"] = cte("l AS (SELECT *, 'One is on the shelf.' AS s, p_name || ' is ' || p_type || '.' AS fact, 'Take ' || p_name || '.' AS ex FROM part)", "r AS (" + " UNION ALL ".join(f"SELECT 'p' || p_partkey AS lid, p_brand, p_size, '{f}' AS prompt_form, {u} AS \"user\", {a} AS assistant FROM l" for f, (u, a) in _forms.items()) + ")") + f"SELECT 'lesson-v1.' || lid || '.' || prompt_form AS id, 'lesson-v1:' || p_brand || ':' || CASE WHEN p_size > 40 THEN 'large' ELSE lid END AS group_id, prompt_form, sha256({CHAT}) AS sha FROM r"
O["capped_expansion"] = "WITH c AS (SELECT rpad(p_type, 80, '.') || p_name || r_name AS \"user\", p_brand AS assistant FROM part, region), h AS (SELECT *, sha256('7' || chr(1) || \"user\" || chr(1) || assistant) AS h FROM c), o AS (SELECT \"user\", arg_min(assistant, h) AS assistant, min(h) AS h FROM h GROUP BY \"user\"), n AS (SELECT *, row_number() OVER (PARTITION BY lower(left(\"user\", 80)) ORDER BY h, \"user\") AS rn FROM o) SELECT \"user\", assistant FROM n WHERE rn <= 8 ORDER BY h, \"user\" LIMIT 5000"
_lab = rf"((?:(?:Reinforcement|Stack contrast|Queue contrast|Hygiene note){_WHITE}+\d+|Command note(?:{_WHITE}+\d+)?|Check{_WHITE}+\d+)\.?)"
_clean = strip(rf"regexp_replace({strip(r"regexp_replace(raw, '(?s)<\|(?:end|user|assistant)\|>.*$', '')")}, '(?i)(?:{_WHITE}+{_lab}{_WHITE}*)+$', '')")
O["clean_responses"] = f"WITH c AS (SELECT conv_id, turn, 0 AS \"case\", text || '<|end|><|end|> more' AS raw FROM conversations UNION ALL SELECT conv_id, turn, 1, ' ' || text || ' Check 7. ' || chr(10) || ' Stack contrast 3 command NOTE' FROM conversations UNION ALL SELECT conv_id, turn, 2, '<|user|>' || text FROM conversations UNION ALL SELECT conv_id, turn, 3, text || 'Check 1' FROM conversations), k AS (SELECT conv_id, turn, \"case\", {_clean} AS c FROM c) SELECT conv_id, turn, \"case\", sha256(c) AS sha, len(c) AS chars FROM k"
O["degenerate_replies"] = rf"WITH r AS (SELECT text AS reply FROM conversations UNION ALL SELECT regexp_replace(text, '[^ .,!?]', '', 'g') FROM conversations UNION ALL SELECT '' FROM conversations) SELECT regexp_full_match(reply, '({_WHITE}|[!-/:-@\[-`{{-~])*') AS degenerate, count(*) AS replies FROM r GROUP BY 1"
_secrets = {"sk": r"sk-[A-Za-z0-9]{20,}", "ghp": r"ghp_[A-Za-z0-9]{20,}", "hf": r"hf_[A-Za-z0-9]{20,}", "api key": r"(?i)api[_-]?key\s*[:=]\s*[''\"]?[A-Za-z0-9_\-]{16,}", "password": r"(?i)password\s*[:=]\s*[''\"]?[^\s''\"]{8,}", "token": r"(?i)token\s*[:=]\s*[''\"]?[A-Za-z0-9_\-]{16,}"}
O["secret_scan"] = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern FROM documents WHERE regexp_matches(text, '{p}')" for n, p in _secrets.items())
_rc = lambda p: f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT)"
O["label_pattern_counts"] = rf"SELECT source, {_rc(r'\bCheck\s+\d+\b')} AS check_labels, {_rc(r'\bExample\s+\d+\b')} AS example_labels, {_rc(r'(?i)\bcheck\b')} AS ordinary FROM documents GROUP BY source"
O["phrase_hits"] = "WITH p(phrase) AS (VALUES ('mit license'), ('the and'), ('of the'), ('copyright'), ('commit message')), h AS (SELECT source, phrase, CAST(sum((len(lower(text)) - len(replace(lower(text), phrase, ''))) // len(phrase)) AS BIGINT) AS hits FROM documents, p GROUP BY ALL) SELECT * FROM h WHERE hits > 0"
O["forbidden_phrases"] = "SELECT doc_id, phrase FROM documents JOIN (VALUES ('worthless', 'en'), ('LICENSE', NULL), ('check', 'fr')) r(phrase, allowed) ON contains(lower(text), lower(phrase)) AND lang IS DISTINCT FROM allowed"
O["keyword_classes"] = "SELECT role, CASE WHEN contains(l, 'who are') OR contains(l, 'your name') THEN 'identity' WHEN contains(l, 'the ') OR contains(l, 'la ') OR contains(l, 'der ') THEN 'article' WHEN contains(l, '.') THEN 'end' ELSE 'other' END AS \"class\", starts_with(text, 'No.') AS refusal, count(*) AS turns FROM (SELECT *, lower(text) AS l FROM conversations) GROUP BY ALL"
O["corpus_totals"] = "SELECT count(text) AS texts, CAST(sum(len(text)) AS BIGINT) AS chars, CAST(sum(len(text)) // 4 AS BIGINT) AS tokens, min(len(text)) AS shortest, max(len(text)) AS longest FROM documents"
O["examples_by_source"] = f"SELECT source, count(*) AS documents, CAST(sum(len(text)) AS BIGINT) AS chars, max(len(text)) AS longest, round_even(avg(len({words('text')})), 3) AS mean_words FROM documents GROUP BY source"
O["duplicate_excess"] = "SELECT 'documents' AS name, count(*) - count(DISTINCT text) AS excess FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'conversations', count(*) - count(DISTINCT text) FROM conversations WHERE text IS NOT NULL"
O["top_repeats"] = "SELECT left(replace(value, chr(10), ' '), 120) AS value, n, first FROM (SELECT text AS value, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text ORDER BY n DESC, first LIMIT 5) WHERE n > 1"
O["top_openings"] = "SELECT * FROM (SELECT value, count(*) AS n, min(k) AS first FROM (SELECT array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+')[1:8], ' ') AS value, k FROM (SELECT text, -1 - conv_id * 1000 - turn AS k FROM conversations UNION ALL SELECT text, doc_id FROM documents)) WHERE value <> '' GROUP BY 1 ORDER BY n DESC, first LIMIT 20) WHERE n > 1"
_bytes = lambda x: f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS INTEGER) + 4)"
O["encode_documents"] = f"WITH e AS (SELECT doc_id, list_concat([1], {_bytes('text')}, [2]) AS ids FROM documents) SELECT doc_id, len(ids) AS ids, CAST(list_sum(list_transform(ids, lambda x, i: x * ((i - 1) % 97 + 1))) AS BIGINT) AS checksum FROM e"
O["decode_round_trip"] = "SELECT TRUE AS same, count(*) AS turns FROM conversations"
O["pack_offsets"] = "SELECT doc_id, CAST(strlen(text) + 2 AS BIGINT) AS n, CAST(coalesce(sum(strlen(text) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents"
O["split_token_counts"] = cte(DOCS, GROUPS, SPLIT) + "SELECT split, count(*) AS documents, CAST(sum(strlen(text) + 2) AS BIGINT) AS tokens FROM ranked JOIN splits USING (fp) WHERE rn = 1 GROUP BY split"
O["token_windows"] = f"WITH e AS (SELECT conv_id, turn, list_concat([1], {_bytes('text')}, [2]) AS ids FROM conversations), w AS (SELECT conv_id, turn, ids, unnest(range(0, len(ids) - 64, 64)) AS start FROM e WHERE len(ids) > 64) SELECT conv_id, turn, start, CAST(list_sum(ids[start + 1:start + 64]) AS BIGINT) AS x, CAST(list_sum(ids[start + 2:start + 65]) AS BIGINT) AS y FROM w"
_P, _A = "'<|user|>' || chr(10) || \"user\" || chr(10) || '<|assistant|>' || chr(10)", "assistant || chr(10) || '<|end|>'"
O["sft_encode_mask"] = cte(
    PAIRS, f"e AS (SELECT conv_id, turn, list_concat([1], {_bytes(_P)}) AS p, {_bytes(_A)} AS a FROM pairs)", "b AS (SELECT *, len(p) AS np, len(a) AS na FROM e)",
    "r AS (SELECT *, CASE WHEN np + na <= 257 THEN na WHEN np < 257 THEN 257 - np ELSE least(na, 257 - least(np, 2)) END AS ra FROM b)", "s AS (SELECT *, CASE WHEN np + na <= 257 OR np < 257 THEN np ELSE least(np, 257 - ra) END AS rp FROM r)",
    "t AS (SELECT *, list_concat(p[np - rp + 1:], CASE WHEN na <= ra THEN a WHEN ra = 1 THEN a[1:1] ELSE list_concat(a[1:ra - 1], a[na:na]) END) AS ids FROM s)",
    "u AS (SELECT conv_id, turn, rp, ids[1:len(ids) - 1] AS x, list_transform(ids[2:], lambda v, i: CASE WHEN i < rp THEN -100 ELSE v END) AS y FROM t)",
) + "SELECT conv_id, turn, len(x) AS n, rp AS kept_prompt, len(list_filter(y, lambda v: v <> -100)) AS supervised, CAST(list_sum(list_transform(list_concat(x, list_transform(range(256 - len(x)), lambda q: 2)), lambda v, i: v * i)) AS BIGINT) AS x, CAST(list_sum(list_transform(list_concat(y, list_transform(range(256 - len(y)), lambda q: -100)), lambda v, i: v * i)) AS BIGINT) AS y FROM u"
_KIND = "CASE WHEN len(\"user\") < 120 THEN 'short' WHEN len(\"user\") < 400 THEN 'medium' WHEN len(\"user\") < 800 THEN 'long' ELSE 'other' END"
_SCORED = cte(
    PAIRS, f"a AS (SELECT conv_id, turn, {_KIND} AS k, array_to_string({words(folded('assistant'))}, ' ') AS t FROM pairs)",
    "m AS (SELECT *, k = 'short' AND (contains(t, 'the') OR contains(t, 'le')) AS article, k = 'short' AND (contains(t, 'is') OR contains(t, 'ist')) AS verb, k = 'medium' AND contains(t, 'e') AS letter, k = 'short' AND contains(t, '!!') AS f1, k = 'short' AND contains(t, 'a') AND contains(t, 'zzz') AS f2, k = 'medium' AND contains(t, 'er') AND contains(t, 'en') AS f3 FROM a)",
    "s AS (SELECT *, concat_ws(',', CASE WHEN article THEN 'article' END, CASE WHEN verb THEN 'verb' END, CASE WHEN letter THEN 'letter' END) AS matched, concat_ws(',', CASE WHEN k = 'short' AND NOT article THEN 'article' END, CASE WHEN k = 'short' AND NOT verb THEN 'verb' END, CASE WHEN k = 'medium' AND NOT letter THEN 'letter' END) AS missing, concat_ws(',', CASE WHEN f1 THEN '!!' END, CASE WHEN f2 THEN 'a + zzz' END, CASE WHEN f3 THEN 'er + en' END) AS forbidden FROM m)",
    "o AS (SELECT conv_id, turn, matched, missing, forbidden, CASE WHEN k IN ('short', 'medium') THEN t <> '' AND missing = '' AND forbidden = '' END AS passed, CASE k WHEN 'other' THEN 'unscored' WHEN 'long' THEN 'human-review' ELSE CASE WHEN t <> '' AND missing = '' AND forbidden = '' THEN 'pass' ELSE 'fail' END END AS status FROM s)",
)
O["rubric_scores"] = _SCORED + "SELECT * FROM o"
O["rubric_summary"] = _SCORED + "SELECT count(*) AS cases, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status IN ('unscored', 'human-review')) AS unscored FROM o"
O["contamination_status"] = "SELECT c_custkey AS suite, CASE WHEN k % 11 = 0 THEN 'contaminated' WHEN k % 7 = 0 THEN 'audit_unavailable' WHEN k % 5 = 0 THEN 'contaminated' WHEN k % 3 = 0 THEN 'audit_does_not_cover_suite' WHEN k % 13 = 0 THEN 'provenance_mismatch' WHEN k % 4 = 0 THEN 'legacy_unverified' WHEN k % 17 = 0 OR k % 19 = 0 THEN 'provenance_mismatch' WHEN k % 23 = 0 THEN 'contaminated' ELSE 'verified_clean' END AS status FROM (SELECT *, c_custkey AS k FROM customer)"
_agg = "SELECT o_orderpriority AS role, o_orderstatus AS logical_name, count(*) AS size_bytes, max(o_orderkey) AS token_count FROM orders {} GROUP BY ALL"
O["manifest_diff"] = f"WITH a AS ({_agg.format('')}), b AS ({_agg.format("WHERE (o_orderstatus <> 'F' OR o_custkey > 100) AND o_orderpriority <> '1-URGENT'")}) SELECT coalesce(a.role, b.role) AS role, coalesce(a.logical_name, b.logical_name) AS logical_name, CASE WHEN a.role IS NULL THEN 'added' WHEN b.role IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.role IS NULL OR b.role IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.size_bytes <> b.size_bytes THEN 'size_bytes' END, CASE WHEN a.token_count <> b.token_count THEN 'token_count' END) END AS columns FROM a FULL JOIN b ON a.role = b.role AND a.logical_name = b.logical_name WHERE a.size_bytes IS DISTINCT FROM b.size_bytes OR a.token_count IS DISTINCT FROM b.token_count"
O["config_diff"] = "SELECT n_name AS field, CASE WHEN n_name = 'CHINA' THEN 'removed' ELSE 'changed' END AS change, CASE WHEN n_name = 'CHINA' THEN '' ELSE 'value' END AS columns FROM nation WHERE n_name = 'CHINA' OR n_nationkey % 5 = 0"
_CAT = """c AS (SELECT o_custkey AS folder, 'Run\\' || o_orderkey || '.PT' AS path, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 31 = 0 THEN 2 END AS version, CASE WHEN k % 3 = 0 AND k % 41 <> 0 THEN ['pretrain', 'sft', 'model_only'][k % 9 // 3 + 1] END AS kind0,
 k % 29 <> 0 AS has_model, k % 2 = 0 AS has_optimizer, k % 5 <> 0 AS has_config, CASE WHEN k % 7 <> 0 THEN k % 1000 END AS iter, epoch(o_orderdate) AS mtime, k % 4 = 0 AS tv FROM (SELECT *, o_orderkey AS k FROM orders)),
 e AS (SELECT *, CASE WHEN (version IS NULL) <> (kind0 IS NULL) THEN 'incomplete metadata' WHEN version <> 1 THEN 'unsupported version' WHEN NOT has_model THEN 'no model' WHEN version IS NOT NULL AND NOT has_config THEN 'no config' END AS error, version IS NULL AS legacy FROM c),
 k AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN version IS NOT NULL THEN kind0 WHEN has_optimizer AND has_config AND iter >= 0 THEN 'pretrain' WHEN NOT has_optimizer THEN 'model_only' END AS kind, lower(replace(path, '\\', '/')) AS np FROM e)"""
O["checkpoint_kinds"] = cte(_CAT) + "SELECT kind, legacy, error, count(*) AS files FROM k GROUP BY ALL"
O["checkpoint_select"] = cte(_CAT) + "SELECT folder, 'resume' AS operation, path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY iter DESC, np DESC) AS rn FROM k WHERE error IS NULL AND kind = 'pretrain' AND has_optimizer AND has_config AND iter >= 0) WHERE rn = 1 UNION ALL SELECT folder, 'load', path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY tv DESC, mtime DESC, np DESC) AS rn FROM k WHERE error IS NULL) WHERE rn = 1"
O["early_stopping"] = """WITH n AS (SELECT user_id, value AS loss, row_number() OVER w AS n, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, n - max(CASE WHEN best IS NULL OR loss < best THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS since FROM n), s AS (SELECT *, min(CASE WHEN since >= 5 THEN n END) OVER (PARTITION BY user_id) AS stop FROM i)
 SELECT user_id, count(*) AS evaluations, min(loss) AS best, max(stop) AS stopped_at FROM s WHERE stop IS NULL OR n <= stop GROUP BY user_id"""
O["lr_schedule"] = "SELECT event_id, i AS step, CASE WHEN i < 20 THEN CAST(0.0003 AS DOUBLE) * (i + 1) / 20 ELSE CAST(0.0003 AS DOUBLE) END AS rate, i % 25 = 0 OR i = n - 1 AS evaluate FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
O["benchmark_aggregate"] = "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2 AS i, CAST(round(value * 100) AS BIGINT) AS elapsed, event_id AS tokens FROM events) SELECT user_id, count(*) AS runs, CAST(sum(elapsed) AS BIGINT) AS total, round(avg(elapsed), 6) AS mean, min(elapsed) AS least, max(elapsed) AS most, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / CAST(sum(elapsed) AS DOUBLE), 6) AS tokens_per_second FROM r WHERE i >= 1 AND elapsed > 0 GROUP BY user_id"
_L = "l AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
O["topk_softmax"] = cte(_L, "t AS (SELECT vec_id, list_transform(v[1:50], lambda x: x / CAST(0.7 AS DOUBLE)) AS v FROM l)", "k AS (SELECT vec_id, v, list_reverse_sort(v)[5] AS cut, list_max(v) AS top FROM t)", "e AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x >= cut THEN exp(x - top) ELSE 0.0 END) AS e FROM k)", "p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)") + "SELECT vec_id, len(list_filter(p, lambda x: x > 0)) AS kept, round(list_max(p), 6) AS top, CAST(list_min(list_filter(list_transform(p, lambda x, i: CASE WHEN list_sum(p[1:i]) > 0.5 THEN i - 1 END), lambda x: x IS NOT NULL)) AS BIGINT) AS drawn FROM p"
O["repetition_penalty"] = cte(_L) + "SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: CASE WHEN i - 1 IN (label, 3, 7) THEN CASE WHEN x > 0 THEN x / 1.3 ELSE x * 1.3 END ELSE x END)), 6) AS total FROM l"
O["cross_entropy_masked"] = cte(_L, "x AS (SELECT label, CASE WHEN vec_id % 5 <> 0 THEN ln(list_sum(list_transform(v, lambda a: exp(a - list_max(v))))) + list_max(v) - v[label + 1] END AS loss FROM l)") + "SELECT label, count(loss) AS counted, round(avg(loss), 6) AS loss FROM x GROUP BY label"
O["causal_attention"] = cte("v AS (SELECT vec_id // 32 AS sequence, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)", "s AS (SELECT q.sequence, q.vec_id, k.e, list_dot_product(q.e, k.e) / sqrt(len(q.e)) AS s FROM v q JOIN v k ON q.sequence = k.sequence AND k.vec_id <= q.vec_id)", "w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sequence, vec_id)) AS w FROM s)") + "SELECT sequence, vec_id, round(sum(w * list_sum(e)) / sum(w), 5) AS total, round(sum(w * e[1]) / sum(w), 5) AS first FROM w GROUP BY ALL"
ORACLES = O
