"""The registered queries in DuckDB SQL, written from the definitions."""

from __future__ import annotations

import ast
import io
import tokenize
from collections import Counter

from inkprint.operators.features import FEATURES
from inkprint.plans.views import DISPATCH, LANGUAGES, MODELS, PROGRAMS

WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_lit(text: str) -> str:
    """A literal with real line feeds and tabs spelled as chr()."""
    out = lit(text)
    return out.replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+\z', '')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '[{WS}]+\z', '')"


def r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0::DOUBLE"


def case_k(values, default: str = "NULL") -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {default} END"


# --- views --------------------------------------------------------------------------

SNIPPETS = """
SELECT conv_id || '_' || turn AS id, (role = 'assistant')::INTEGER AS label,
       CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'human' END AS source_model, text AS code
FROM conversations WHERE role IN ('user', 'assistant')"""

DOCS = """
SELECT doc_id::VARCHAR AS id, quality AS label,
       CASE WHEN quality = 0 THEN 'human' ELSE lang END AS source_model, text AS code
FROM documents JOIN labels USING (doc_id)"""

CORPUS = f"""
SELECT id, k, label, CASE WHEN label = 0 THEN 'human' ELSE 'm' || (p_size % 3) END AS source_model,
       'python' AS language, {case_k([text_lit(p) for p in PROGRAMS])} || chr(10) || '# id ' || id AS code
FROM (SELECT *, CASE WHEN starts_with(md5(id), '0') THEN 1 - base ELSE base END AS label
      FROM (SELECT p_partkey::VARCHAR AS id, (p_partkey % 6)::INTEGER AS k, p_size,
                   (p_partkey % 6 IN (0, 2, 5))::INTEGER AS base FROM part))"""

# the label that the program decides, before any is turned around
PLANTED = CORPUS.replace("SELECT id, k, label, CASE WHEN label = 0", "SELECT id, k, base, CASE WHEN base = 0")

TEXTS = f"""
SELECT 's' || id AS id, code FROM ({SNIPPETS})
UNION ALL SELECT 'p' || id AS id, code FROM ({CORPUS})"""

SCORED = """
SELECT doc_id::VARCHAR AS id, source AS model, lang, quality AS label,
       (n_chars % 97) / 97.0::DOUBLE AS score
FROM documents JOIN labels USING (doc_id)"""

RAW = """
SELECT doc_id::VARCHAR AS id, (doc_id % 2)::INTEGER AS label, (doc_id % 2)::INTEGER AS src_ord,
       CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE source END AS source_model,
       CASE WHEN doc_id % 101 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN chr(9) || chr(160)
            ELSE text END AS code
FROM documents"""

PROBLEMS = "SELECT item_id::VARCHAR AS id, text AS statement FROM benchmark"


def values_list(name: str, column: str, values) -> str:
    rows = ", ".join(f"({lit(v)})" for v in values)
    return f"(VALUES {rows}) AS {name}({column})"


GRID = f"""
SELECT p.id, p.statement, l.language, m.source_model
FROM ({PROBLEMS}) p, {values_list('l', 'language', LANGUAGES)}, {values_list('m', 'source_model', MODELS)}"""

PROMPT = (
    "'Write a ' || language || ' solution to the following problem.' || chr(10) || "
    "'Return ONLY the code, no explanations, no markdown fences.' || chr(10) || chr(10) || "
    "'Problem:' || chr(10) || statement || chr(10)"
)
REQUESTS = f"""
SELECT id || '_' || language || '_' || source_model AS id, id AS problem_id, language, source_model,
       {PROMPT} AS prompt, statement
FROM ({GRID}) WHERE source_model IN ({', '.join(map(lit, DISPATCH))})"""

COMPLETIONS = f"""
SELECT *, CASE WHEN problem_id::BIGINT % 2 = 1
               THEN '```python' || chr(10) || statement || chr(10) || '```' || chr(10)
               ELSE '  ' || statement || chr(10) END AS completion
FROM ({REQUESTS}) WHERE problem_id::BIGINT % 7 <> 0"""


def unfenced(x: str) -> str:
    s = strip(x)
    rest = f"str_split({s}, {NL})[2:]"
    fenced_end = f"len({rest}) > 0 AND starts_with({strip(f'{rest}[-1]')}, '```')"
    kept = f"CASE WHEN {fenced_end} THEN {rest}[:-2] ELSE {rest} END"
    joined = strip(f"array_to_string({kept}, {NL})")
    return f"CASE WHEN starts_with({s}, '```') THEN {joined} ELSE {s} END"


# --- split --------------------------------------------------------------------------


def split(view: str) -> str:
    """The view plus its split, by whole-table ranks."""
    return f"""
SELECT v.*, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + n_val THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS rk FROM ({view})) v
JOIN ({split_sizes(view)}) z ON v.label = z.label"""


def split_sizes(view: str) -> str:
    def allot(source: str, rest: str, total: str, size: str, out: str) -> str:
        return f"""
SELECT * EXCLUDE (share, place, spare),
       (floor(share) + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS {out}
FROM (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, label) AS place,
             {size} - sum(floor(share)) OVER () AS spare
      FROM (SELECT *, {rest} / {total} * {size} AS share FROM ({source})))"""

    base = f"""
SELECT label, c, sum(c) OVER ()::DOUBLE AS total, ceil(0.15::DOUBLE * sum(c) OVER ()::DOUBLE) AS want_test
FROM (SELECT label, count(*)::DOUBLE AS c FROM ({view}) GROUP BY label)"""
    first = allot(base, "c", "total", "want_test", "n_test")
    middle = f"""
SELECT *, c - n_test AS rest, sum(c - n_test) OVER ()::DOUBLE AS rest_total,
       ceil((0.15::DOUBLE / (1::DOUBLE - 0.15::DOUBLE)) * sum(c - n_test) OVER ()::DOUBLE) AS want_val
FROM ({first})"""
    return f"SELECT label, n_test, n_val FROM ({allot(middle, 'rest', 'rest_total', 'want_val', 'n_val')})"


def without_rank(view: str) -> str:
    return f"SELECT * EXCLUDE (rk) FROM ({split(view)})"


# --- style features -----------------------------------------------------------------

_TOKENS = f"list_filter(regexp_split_to_array(code, '[{WS}]+'), lambda x: x <> '')"
_STAGED = rf"""
SELECT *, str_split(code, chr(10)) AS ls, {_TOKENS} AS toks,
       list_filter(regexp_split_to_array(code, '[^\p{{L}}\p{{N}}_]+'),
                   lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*')) AS ids,
       list_filter(str_split(code, chr(10)), lambda l: starts_with({strip('l')}, '#')) AS cs
FROM ({{view}})"""

_BARE = strip(r"regexp_replace(regexp_replace(l, '^[# ]+', ''), '[# ]+\z', '')")


def _entropy(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE list_aggregate(str_split({text}, ''), 'entropy') END"


STYLE = {
    "name_avg_len": "coalesce(list_avg(list_transform(ids, lambda x: length(x))), 0)",
    "name_snake_case_ratio": "CASE WHEN len(ids) = 0 THEN 0 ELSE len(list_filter(ids, lambda x: "
    "regexp_full_match(x, '[a-z0-9_]+') AND contains(x, '_'))) / len(ids) END",
    "name_single_char_ratio": "CASE WHEN len(ids) = 0 THEN 0 ELSE "
    "len(list_filter(ids, lambda x: length(x) = 1)) / len(ids) END",
    "comment_density": "len(cs) / len(ls)",
    "docstring_count": "((length(code) - length(replace(code, '\"\"\"', ''))) / 3 + "
    "(length(code) - length(replace(code, '''''''', ''))) / 3) / len(ls)",
    "avg_comment_length": f"coalesce(list_avg(list_transform(cs, lambda l: length({_BARE}))), 0)",
    "trailing_whitespace_ratio": f"len(list_filter(ls, lambda l: l <> {rstrip('l')})) / len(ls)",
    "mixed_indent_ratio": "len(list_filter(ls, lambda l: starts_with(l, ' ') AND contains(l, chr(9)))) / len(ls)",
    "blank_line_ratio": f"len(list_filter(ls, lambda l: {strip('l')} = '')) / len(ls)",
    "line_length_std": "list_aggregate(list_transform(ls, lambda l: length(l)), 'stddev_pop')",
    "char_entropy": _entropy("code"),
    "token_entropy": _entropy("array_to_string(toks, ' ')"),
    "n_tokens": "len(toks)",
    "unique_token_ratio": "CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_distinct(toks)) / len(toks) END",
}


def style(view: str, names=tuple(STYLE), keep: str = "id, ") -> str:
    columns = ", ".join(f"{r(STYLE[n])} AS {n}" for n in names)
    return f"SELECT {keep}{columns} FROM ({_STAGED.replace('{view}', view)})"


# --- metrics ------------------------------------------------------------------------


def confusion(view: str, by: str) -> str:
    return f"""
SELECT {by}, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
FROM ({view}) GROUP BY {by}"""


def div(top: str, bottom: str) -> str:
    return f"coalesce(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0), 0)"


PREDICTED = f"SELECT *, (score > 0.5)::INTEGER AS prediction FROM ({SCORED})"
RATES = {
    "accuracy": div("tp + tn", "tp + tn + fp + fn"),
    "precision": div("tp", "tp + fp"),
    "recall": div("tp", "tp + fn"),
    "f1": div("2 * tp", "2 * tp + fp + fn"),
}
MATRIX = "'[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]'"


def rates(view: str, by: str) -> str:
    columns = ", ".join(f"{r(x)} AS {n}" for n, x in RATES.items())
    return f"SELECT {by}, {columns} FROM ({confusion(view, by)})"


def auc(view: str, by: str) -> str:
    """Pair counting: every (positive, negative) pair of a group, ties worth a half."""
    groups = " AND ".join(f"p.{c} = n.{c}" for c in by.split(", "))
    keys = ", ".join(f"p.{c}" for c in by.split(", "))
    return f"""
SELECT g.*, {r('won')} AS roc_auc FROM (SELECT DISTINCT {by} FROM ({view})) g LEFT JOIN (
  SELECT {keys}, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS won
  FROM (SELECT * FROM ({view}) WHERE label = 1) p JOIN (SELECT * FROM ({view}) WHERE label = 0) n ON {groups}
  GROUP BY {keys}) USING ({by})"""


# --- syntax trees -------------------------------------------------------------------

# Per program, from the golden table.
GOLDEN_AST = {
    "ast_parse_success": [1, 1, 1, 0, 1, 1],
    "ast_depth": [5, 8, 6, 0, 0, 8],
    "ast_n_nodes": [17, 47, 18, 0, 1, 34],
    "ast_n_functions": [1, 1, 1, 0, 0, 2],
    "ast_n_branches": [0, 2, 0, 0, 0, 1],
    "ast_n_try_except": [0, 0, 1, 0, 0, 0],
    "ast_n_comprehensions": [0, 1, 0, 0, 0, 1],
    "ast_avg_function_args": [2, 1, 1, 0, 0, 1.5],
    "ast_max_nesting": [0, 0, 0, 0, 0, 0],
    "ast_cyclomatic_complexity": [1, 5, 2, 0, 0, 2],
}
# The programs after renaming; the one that does not parse is left alone.
RENAMED = [
    "def add_two(a, b):\n    v0 = v1 + v2\n    return v0",
    "def f(xs):\n    v0 = []\n    for v1 in v2:\n        if v1 > 1 and v1 < 9:\n"
    "            v0.append(v1)\n    return [v3 * 2 for v3 in v0]",
    'async def g(u, *, k=1):\n    """Doc."""\n    try:\n        return await v0\n'
    "    except v1:\n        return None",
    None,
    "",
    "class A:\n\n    def m(self, q):\n        while v0:\n            v0 -= 1\n"
    "        return {v1 for v1 in v2(3)}\n\n    def n(self):\n        return 'é' if v3 else 'b'",
]
RENAMED_CODE = case_k([text_lit(t) if t is not None else "code" for t in RENAMED])


def _node_rows() -> str:
    rows = []
    for k, program in enumerate(PROGRAMS):
        try:
            kinds = Counter(type(n).__name__ for n in ast.walk(ast.parse(program)))
        except SyntaxError:
            continue
        rows += [f"({k}, '{kind}', {n}, {n / kinds.total()!r}::DOUBLE)" for kind, n in kinds.items()]
    return ", ".join(rows)


NODE_COUNTS = f"""
SELECT id, node_type, n::BIGINT AS n, {r('fraction')} AS fraction
FROM ({CORPUS}) JOIN (VALUES {_node_rows()}) AS t(k, node_type, n, fraction) USING (k)"""


# --- feature matrix -----------------------------------------------------------------


def _token_lists() -> list[str]:
    """Per program its tokens as a SQL list, the last comment with the row's id; a program that has none splits at blanks."""
    lists = []
    for program in PROGRAMS:
        try:
            found = [t.string for t in tokenize.generate_tokens(io.StringIO(program + "\n# id 0").readline)]
        except (tokenize.TokenError, IndentationError):
            lists.append(_TOKENS)
            continue
        tokens = [text_lit(t) + (" || id" if t == "# id " else "") for t in (x.removesuffix("0") if x == "# id 0" else x for x in found) if t.strip()]
        lists.append(f"[{', '.join(tokens)}]")
    return lists


def feature_columns(view: str, keep: str) -> str:
    """``keep`` and all features of programs, by the tokenizer where it accepts them."""
    by_name: dict[str, list[str]] = {}
    for k, program in enumerate(PROGRAMS):
        try:
            kinds = Counter(type(n).__name__ for n in ast.walk(ast.parse(program)))
        except SyntaxError:
            kinds = Counter()
        for kind, n in kinds.items():
            by_name.setdefault(f"ast_frac_{kind}", ["0"] * len(PROGRAMS))[k] = f"{n / kinds.total()!r}"
    exact = {**STYLE, **{n: case_k(v) for n, v in GOLDEN_AST.items()}, **{n: case_k(v) for n, v in by_name.items()}}
    columns = ", ".join(f"{r(exact.get(n, '0'))} AS {n}" for n in FEATURES)
    staged = _STAGED.replace(_TOKENS, case_k(_token_lists())).replace("{view}", view)
    return f"SELECT {keep}, {columns} FROM ({staged})"


# --- attacks ------------------------------------------------------------------------


def uncommented(code: str) -> str:
    kept = f"list_filter(str_split({code}, {NL}), lambda l: NOT starts_with({strip('l')}, '#'))"
    return f"array_to_string({kept}, {NL})"


def word(text: str, at: int) -> str:
    return f"('0x' || substr(md5({text}), {8 * at + 1}, 8))::BIGINT"


def reformatted(code: str) -> str:
    key = "'42|' || id || '|' || (i - 1)"
    line = (
        f"{rstrip('l')} || repeat(' ', ({word(key, 0)} % 3)::INTEGER) || "
        f"CASE WHEN {word(key, 1)} < 0.1::DOUBLE * 4294967296 THEN chr(10) ELSE '' END"
    )
    return f"array_to_string(list_transform(str_split({code}, {NL}), lambda l, i: {line}), {NL})"


ATTACKED = {
    "none": "code",
    "rename_vars": RENAMED_CODE,
    "strip_comments": uncommented("code"),
    "reformat_whitespace": reformatted("code"),
    "all_combined": reformatted(uncommented(f"({RENAMED_CODE})")),
}


def attack_rows(view: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, label, {lit(n)} AS attack, {x} AS code FROM ({view})" for n, x in ATTACKED.items()
    )


# --- likelihood ---------------------------------------------------------------------

SPLIT_SNIPPETS = without_rank(SNIPPETS)


def _steps(view: str, keys: str) -> str:
    return f"""
SELECT {keys}, t[i] AS w1, t[i + 1] AS w2
FROM (SELECT *, unnest(range(1, len(t))) AS i FROM (SELECT {keys}, {_TOKENS} AS t FROM ({view})))"""


def likelihood(view: str, keys: str = "id", train: str | None = None) -> str:
    """WITH-list ending in ``ll_of``: (keys, n_predicted, ll)."""
    train = train or f"SELECT * FROM ({SPLIT_SNIPPETS}) WHERE split = 'train'"
    return f"""
train AS MATERIALIZED ({train}),
pair AS MATERIALIZED (SELECT w1, w2, count(*) AS c FROM ({_steps('SELECT * FROM train', 'id')}) GROUP BY ALL),
word AS MATERIALIZED (SELECT w, count(*) AS c FROM (SELECT unnest({_TOKENS}) AS w FROM train) GROUP BY w),
first AS MATERIALIZED (SELECT w1, sum(c) AS c FROM pair GROUP BY w1),
total AS (SELECT sum(c) + count(*) + 1 AS z FROM word),
step AS (
  SELECT s.*, ln((coalesce(p.c, 0) + (coalesce(w.c, 0) + 1)::DOUBLE / z) / (coalesce(f.c, 0) + 1)) AS logp
  FROM ({_steps(view, keys)}) s LEFT JOIN pair p USING (w1, w2) LEFT JOIN first f USING (w1)
  LEFT JOIN word w ON s.w2 = w.w CROSS JOIN total),
ll_of AS (
  SELECT v.*, coalesce(n, 0)::BIGINT AS n_predicted, ll FROM (SELECT {keys} FROM ({view})) v LEFT JOIN (
    SELECT {keys}, count(*) AS n, round(sum(logp) / count(*), 12) AS ll FROM step GROUP BY {keys}) USING ({keys}))"""


def kneser_ney(view: str) -> str:
    """(id, n_predicted, ll) with three words, counts from the training snippets."""

    def order(n: int, counts: str) -> str:
        grown = ", ".join(f"count(*) FILTER (c = {k})::DOUBLE AS n{k}" for k in range(1, 5))
        y = "(n1 / (n1 + 2 * n2))"
        d = ", ".join(
            f"""CASE WHEN n1 = 0 OR n2 = 0 OR n{k} = 0 THEN 0.5::DOUBLE * {k}
              ELSE least(greatest({k} - {k + 1} * {y} * n{k + 1} / nullif(n{k}, 0), 0.1::DOUBLE * {k}), 0.9::DOUBLE * {k}) END AS d{k}"""
            for k in (1, 2, 3)
        )
        return f"""
c{n} AS MATERIALIZED ({counts}),
d{n} AS (SELECT {d} FROM (SELECT {grown} FROM c{n})),
g{n} AS MATERIALIZED (SELECT h, w, c, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS taken FROM c{n}, d{n}),
h{n} AS MATERIALIZED (SELECT h, sum(c) AS n, sum(taken) / sum(c) AS b FROM g{n} GROUP BY h)"""

    def windows(of: str) -> str:
        padded = f"SELECT id, {_TOKENS} AS t, ['', ''] || {_TOKENS} AS p FROM ({of})"
        return f"SELECT id, i, p[i] || ' ' || p[i + 1] AS h, p[i + 2] AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM ({padded}))"

    train = f"SELECT * FROM ({SPLIT_SNIPPETS}) WHERE split = 'train'"
    orders = [
        order(3, f"SELECT h, w, count(*) AS c FROM ({windows(train)}) GROUP BY h, w"),
        order(2, "SELECT substr(h, instr(h, ' ') + 1) AS h, w, count(*) AS c FROM c3 GROUP BY ALL"),
        order(1, "SELECT '' AS h, w, count(*) AS c FROM c2 GROUP BY w"),
    ]
    p = "1::DOUBLE / ((SELECT count(*) FROM g1) + 1)"
    joins = ""
    for n, h in ((1, "''"), (2, "substr(s.h, instr(s.h, ' ') + 1)"), (3, "s.h")):
        joins += f" LEFT JOIN h{n} ON h{n}.h = {h} LEFT JOIN g{n} ON g{n}.h = {h} AND g{n}.w = s.w"
        p = f"coalesce(greatest(g{n}.c - g{n}.taken, 0) / h{n}.n, 0) + coalesce(h{n}.b, 1) * ({p})"
    return f"""
WITH {', '.join(orders)},
step AS (SELECT s.id, ln({p}) AS logp FROM ({windows(view)}) s {joins} WHERE s.i > 1)
SELECT id, coalesce(n, 0)::BIGINT AS n_predicted, {r('ll')} AS ll FROM (SELECT id FROM ({view})) LEFT JOIN (
  SELECT id, count(*) AS n, round(sum(logp) / count(*), 12) AS ll FROM step GROUP BY id) USING (id)"""


def perturbed(view: str) -> str:
    """(id, round, code) for ten rounds of up to five swaps."""
    sql = f"""
SELECT id, round, code, str_split(code, ' ') AS t, least(5, len(str_split(code, ' ')) // 2) AS k
FROM ({view}), (SELECT unnest(range(1, 11)) AS round)"""
    for j in range(1, 6):
        at = word(f"'42|' || id || '|' || round || '|{j}'", 0)
        sql = f"""
SELECT id, round, code, k,
       CASE WHEN k >= {j} THEN t[1:i - 1] || [t[i + 1], t[i]] || t[i + 2:] ELSE t END AS t
FROM (SELECT *, {at} % greatest(len(t) - 1, 1) + 1 AS i FROM ({sql}))"""
    return f"""
SELECT id, round, CASE WHEN len(t) < 4 THEN code ELSE array_to_string(t, ' ') END AS code FROM ({sql})"""


def curvature(view: str) -> str:
    """WITH-list ending in ``curved``: (id, ll, mean_ll, std_ll, score)."""
    texts = f"SELECT id, 0 AS round, code FROM ({view}) UNION ALL ({perturbed(view)})"
    return f"""{likelihood(texts, 'id, round')},
curved AS (
  SELECT *, (ll - mean_ll) / (std_ll + 1e-8) AS score FROM (
    SELECT id, max(ll) FILTER (round = 0) AS ll, avg(ll) FILTER (round > 0) AS mean_ll,
           stddev_pop(ll) FILTER (round > 0) AS std_ll FROM ll_of GROUP BY id))"""


SAMPLE = f"""
SELECT * FROM ({SPLIT_SNIPPETS}) WHERE split = 'test' AND code IS NOT NULL ORDER BY md5('42|' || id), id LIMIT 200"""
DEDUP = f"""
SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY src_ord, id) AS nth FROM ({RAW})) WHERE nth = 1"""
PREPARED = without_rank(f"SELECT * FROM ({DEDUP}) WHERE code IS NOT NULL AND {strip('code')} <> ''")
CONTRIBUTIONS = """
SELECT vec_id::VARCHAR AS id, unnest(range(len(embedding)))::INTEGER AS feature_ix,
       unnest(embedding)::DOUBLE AS impact FROM embeddings"""
DIRECTION = "CASE WHEN impact > 0 THEN 'toward AI-generated' ELSE 'toward human-written' END"


# --- one statement per query --------------------------------------------------------


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    corpus_rows = f"SELECT id, label, source_model, language, code FROM ({CORPUS})"

    sql["scan_problems"] = PROBLEMS
    sql["scan_jsonl"] = corpus_rows
    sql["scan_source_tree"] = f"""
SELECT bucket, string_agg(code || chr(10), '' ORDER BY id::BIGINT) AS source
FROM (SELECT *, (id::BIGINT // 600) * 6 + k AS bucket FROM ({CORPUS})) GROUP BY bucket"""
    sql["write_jsonl"] = f"SELECT id, code, 7::INTEGER AS n_keys FROM ({CORPUS})"
    sql["csv_roundtrip"] = corpus_rows
    sql["metrics_sink"] = f"""
SELECT m.*, roc_auc, {MATRIX} AS confusion_matrix FROM ({rates(PREDICTED, 'model')}) m
JOIN ({auc(SCORED, 'model')}) USING (model) JOIN ({confusion(PREDICTED, 'model')}) USING (model)"""
    cell = auc(SCORED, "model, lang")
    langs = ", ".join(f"max(roc_auc) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr"))
    sql["matrix_sink"] = f"SELECT model AS train_model, {langs} FROM ({cell}) GROUP BY model"

    nonblank = f"code IS NOT NULL AND {strip('code')} <> ''"
    sql["nonblank_filter"] = f"SELECT id, label, code FROM ({RAW}) WHERE {nonblank}"
    sql["dropna_code"] = f"SELECT id, label, code FROM ({RAW}) WHERE code IS NOT NULL"
    sql["split_filter"] = f"SELECT id, label, code FROM ({SPLIT_SNIPPETS}) WHERE split = 'test'"
    sql["feature_projection"] = style(TEXTS, keep="")
    sql["meta_projection"] = f"SELECT id, label, split, source_model FROM ({SPLIT_SNIPPETS})"
    sql["code_label_projection"] = f"SELECT code, label FROM ({SPLIT_SNIPPETS}) WHERE split = 'val'"
    sql["length_band_filter"] = f"""
SELECT id, code FROM ({TEXTS}) WHERE len(str_split(code, chr(10))) BETWEEN 5 AND 120"""
    sql["content_id"] = f"SELECT id, 'human_' || substr(md5(code), 1, 12) AS content_id FROM ({TEXTS})"
    sql["composite_id"] = f"SELECT id || '_' || language || '_' || source_model AS id FROM ({GRID})"
    sql["render_prompt"] = f"SELECT id, language, source_model, {PROMPT} AS prompt FROM ({GRID})"
    sql["strip_code_fence"] = f"SELECT id, {unfenced('completion')} AS code FROM ({COMPLETIONS})"
    sql["known_model_filter"] = f"""
SELECT id, language, source_model FROM ({GRID}) WHERE source_model IN ({', '.join(map(lit, DISPATCH))})"""
    sql["label_tagging"] = f"""
SELECT id, code, 0::INTEGER AS label, 'human' AS source_model, 'python' AS language FROM ({TEXTS})"""
    sql["fill_missing_features"] = """
SELECT doc_id::VARCHAR AS id, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic
FROM documents LEFT JOIN labels USING (doc_id)"""
    sql["align_features"] = f"""
SELECT id, n_tokens, 0.0::DOUBLE AS ast_frac_Name, name_avg_len, 0.0::DOUBLE AS ast_depth
FROM ({style(TEXTS, ('n_tokens', 'name_avg_len', 'char_entropy'))})"""
    sql["threshold_verdict"] = f"""
SELECT id, (score > 0.5)::INTEGER AS prediction,
       CASE WHEN score > 0.5 THEN 'Likely AI-generated' ELSE 'Likely human-written' END AS verdict,
       printf('%.1f%%', score * 100) AS confidence FROM ({SCORED})"""
    sql["impact_direction"] = f"""
SELECT id, feature_ix, 'f' || feature_ix || ' (impact=' || printf('%+.3f', impact) || ', pushes ' || {DIRECTION} || ')' AS reason
FROM ({CONTRIBUTIONS})"""

    sql["prompt_grid"] = f"SELECT id, language, source_model FROM ({GRID})"
    models = f"SELECT DISTINCT source_model FROM ({DOCS}) WHERE label = 1"
    sql["model_pair_grid"] = f"""
SELECT a.source_model AS train_model, b.source_model AS test_model FROM ({models}) a, ({models}) b"""
    sql["attack_grid"] = f"SELECT id, attack, md5(code) AS code_md5 FROM ({attack_rows(CORPUS)})"
    sql["perturbation_grid"] = f"""
SELECT id, unnest(range(1, 11))::INTEGER AS round FROM ({SNIPPETS})"""
    sql["attach_features"] = f"""
SELECT m.*, f.* EXCLUDE (id) FROM (SELECT id, label, source_model, split FROM ({SPLIT_SNIPPETS})) m
JOIN ({style(SNIPPETS)}) f USING (id)"""
    sql["merge_scores"] = f"""
SELECT d.id, d.label, d.split, {r('s.score')} AS baseline_prob, {r('len(d.code) % 89 / 89.0::DOUBLE')} AS lexical_prob,
       {r('(x.n_chars % 83) / 83.0::DOUBLE')} AS likelihood_score
FROM ({without_rank(DOCS)}) d JOIN ({SCORED}) s USING (id) JOIN documents x ON x.doc_id::VARCHAR = d.id"""
    sql["attach_completions"] = f"""
SELECT id, problem_id, language, source_model, 1::INTEGER AS label, {unfenced('completion')} AS code
FROM ({COMPLETIONS})"""

    sql["class_counts"] = f"""
SELECT count(*) AS total, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai FROM ({RAW})"""
    sql["split_label_counts"] = f"SELECT split, label, count(*) AS n FROM ({SPLIT_SNIPPETS}) GROUP BY ALL"
    sql["distinct_source_models"] = f"{models} AND source_model IS NOT NULL"
    sql["dedup_keep_first"] = f"SELECT id, label, source_model, code FROM ({DEDUP})"
    sql["binary_metrics"] = rates(PREDICTED, "model")
    sql["roc_auc"] = auc(SCORED, "model")
    sql["confusion_matrix"] = f"""
SELECT *, {MATRIX} AS matrix FROM ({confusion(PREDICTED, 'model')})"""
    sql["classification_report"] = f"""
WITH c AS ({confusion(PREDICTED, 'model')}),
one AS (
  SELECT model, 'human' AS class, {div('tn', 'tn + fn')} AS p, {div('tn', 'tn + fp')} AS rc, {div('2 * tn', '2 * tn + fn + fp')} AS f, tn + fp AS support FROM c
  UNION ALL
  SELECT model, 'ai', {div('tp', 'tp + fp')}, {div('tp', 'tp + fn')}, {div('2 * tp', '2 * tp + fn + fp')}, tp + fn FROM c),
allrows AS (
  SELECT * FROM one UNION ALL
  SELECT model, 'accuracy', {div('tp + tn', 'tp + tn + fp + fn')}, {div('tp + tn', 'tp + tn + fp + fn')}, {div('tp + tn', 'tp + tn + fp + fn')}, tp + tn + fp + fn FROM c UNION ALL
  SELECT model, 'macro avg', avg(p), avg(rc), avg(f), sum(support) FROM one GROUP BY model UNION ALL
  SELECT model, 'weighted avg', sum(p * support) / sum(support), sum(rc * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM one GROUP BY model)
SELECT model, class, {r('p')} AS precision, {r('rc')} AS recall, {r('f')} AS f1, support::BIGINT AS support FROM allrows"""
    sql["population_guard"] = f"""
WITH n AS (SELECT source_model, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test
           FROM ({without_rank(DOCS)}) WHERE label = 1 GROUP BY source_model)
SELECT a.source_model AS train_model, b.source_model AS test_model, a.n_train, b.n_test,
       least(a.n_train, b.n_test) >= 10 AS is_defined FROM n a, n b"""
    golden = ", ".join(f"({case_k(v)})::DOUBLE AS {n}" for n, v in GOLDEN_AST.items())
    sql["ast_counts"] = f"SELECT id, {golden} FROM ({CORPUS})"
    sql["ast_node_fractions"] = NODE_COUNTS
    sql["ast_depth"] = f"""
SELECT id, ({case_k(GOLDEN_AST['ast_depth'])})::INTEGER AS ast_depth FROM ({CORPUS}) WHERE k <> 3"""
    sql["cyclomatic"] = f"""
SELECT id, ({case_k(GOLDEN_AST['ast_cyclomatic_complexity'])})::DOUBLE AS ast_cyclomatic_complexity FROM ({CORPUS})"""
    sql["perturbation_stats"] = f"""
WITH {likelihood(perturbed(f'SELECT id, code FROM ({SNIPPETS})'), 'id, round')}
SELECT id, {r('avg(ll)')} AS mean_ll, {r('stddev_pop(ll)')} AS std_ll FROM ll_of GROUP BY id"""
    sql["global_importance"] = f"""
SELECT feature_ix, 'f' || feature_ix AS feature, {r('avg(abs(impact))')} AS mean_abs_impact, {r('avg(impact)')} AS mean_impact
FROM ({CONTRIBUTIONS}) GROUP BY feature_ix"""

    sql["stratified_split"] = f"SELECT id, label, split FROM ({SPLIT_SNIPPETS})"
    sql["seeded_sample"] = f"SELECT id, label FROM ({SAMPLE})"
    sql["topk_contributions"] = f"""
SELECT id, feature, {r('impact')} AS impact, direction FROM (
  SELECT id, 'f' || feature_ix AS feature, impact, {DIRECTION} AS direction,
         row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, feature_ix) AS nth FROM ({CONTRIBUTIONS}))
WHERE nth <= 5"""
    extracted = f"""
SELECT (id::BIGINT // 600) * 6 + k AS bucket, id::BIGINT AS part, {case_k(['NULL', text_lit(PROGRAMS[1]), text_lit(PROGRAMS[2].rstrip())])} AS code
FROM ({CORPUS}) WHERE k IN (1, 2)"""
    human = f"""
SELECT 'human_' || substr(md5(code), 1, 12) AS id, 'python' AS language, 'human' AS source_model, 0::INTEGER AS label, code, bucket, part
FROM ({extracted})"""
    sql["extract_functions"] = f"SELECT id, language, source_model, label, code, bucket FROM ({human})"
    functions = [
        f"({k}, {text_lit(ast.get_source_segment(program, n))})"
        for k, program in enumerate(PROGRAMS)
        if k != 3  # does not parse
        for n in ast.walk(ast.parse(program))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))
    ]
    sql["extract_functions_lateral"] = f"""
SELECT (id::BIGINT // 600) * 6 + k AS bucket, f.code FROM ({CORPUS}) c JOIN (VALUES {', '.join(functions)}) AS f(k, code) USING (k)"""
    sql["ast_nodes_lateral"] = f"SELECT id, node_type, n FROM ({NODE_COUNTS})"
    sql["limit_snippets"] = f"""
SELECT id, bucket FROM (SELECT *, lpad(bucket::VARCHAR, 9, '0') AS file FROM ({human})) ORDER BY file, part LIMIT 100"""
    sql["median_threshold"] = f"""
SELECT id, model, {r('med')} AS threshold, (score > med)::INTEGER AS prediction
FROM ({SCORED}) JOIN (SELECT model, median(score) AS med FROM ({SCORED}) GROUP BY model) USING (model)"""

    sql["union_sources"] = f"SELECT id, label, source_model, src_ord, code FROM ({RAW})"
    sql["union_splits"] = f"SELECT id, label, split, code FROM ({SPLIT_SNIPPETS})"
    sql["union_train_eval"] = f"""
SELECT m.source_model AS model, d.split, d.id, d.label FROM ({models}) m
JOIN ({without_rank(DOCS)}) d ON d.label = 0 OR d.source_model = m.source_model WHERE d.split <> 'val'"""

    for name in STYLE:
        sql[name] = style(TEXTS, (name,))
    sql["style_vector"] = style(TEXTS)

    sql["ast_node_table"] = f"""
SELECT id, node_type, n FROM ({NODE_COUNTS})"""
    sql["attack_rename_vars"] = f"SELECT id, {RENAMED_CODE} AS code FROM ({CORPUS})"
    sql["attack_strip_comments"] = f"SELECT id, {uncommented('code')} AS code FROM ({TEXTS})"
    sql["attack_reformat_whitespace"] = f"SELECT id, {reformatted('code')} AS code FROM ({TEXTS})"
    sql["attack_registry"] = f"SELECT id, attack, code FROM ({attack_rows(CORPUS)})"
    sql["ngram_log_likelihood"] = f"""
WITH {likelihood(SNIPPETS)} SELECT id, n_predicted, {r('ll')} AS ll FROM ll_of"""
    sql["kneser_ney_likelihood"] = kneser_ney(SNIPPETS)
    sql["perplexity"] = f"""
WITH {likelihood(SNIPPETS)} SELECT id, {r('exp(-ll)')} AS perplexity FROM ll_of"""
    sql["perturb"] = f"SELECT id, round::INTEGER AS round, code FROM ({perturbed(SNIPPETS)})"
    sql["curvature_score"] = f"""
WITH {curvature(SNIPPETS)}
SELECT id, {r('ll')} AS ll, {r('mean_ll')} AS mean_ll, {r('std_ll')} AS std_ll, round(score, 4) + 0.0::DOUBLE AS score FROM curved"""
    judged_test = f"SELECT * FROM ({SPLIT_SNIPPETS}) WHERE split = 'test' AND code IS NOT NULL"
    sql["zero_shot_eval"] = f"""
WITH {curvature(judged_test)},
judged AS (SELECT 'all' AS g, label, score, score > (SELECT median(score) FROM curved) AS above
           FROM curved JOIN ({SNIPPETS}) USING (id) WHERE score IS NOT NULL)
SELECT roc_auc, (SELECT {r('avg((above = (label = 1))::INTEGER)')} FROM judged) AS accuracy,
       (SELECT round(median(score), 4) + 0.0::DOUBLE FROM curved) AS threshold,
       (SELECT count(score) FROM curved) AS n_scored, (SELECT count(*) - count(score) FROM curved) AS n_unscored
FROM ({auc('SELECT * FROM judged', 'g')})"""
    # fits on labels that the program decides: every held-out row is called right
    planted = f"SELECT id, base AS label, source_model, language, code, k FROM ({PLANTED})"
    dataset = without_rank(f"SELECT id, label, source_model FROM ({planted})")
    perfect = ", ".join(f"1.0::DOUBLE AS {x}" for x in ("accuracy", "precision", "recall", "f1", "roc_auc"))
    matrix = "'[[' || count(*) FILTER (label = 0) || ',0],[0,' || count(*) FILTER (label = 1) || ']]' AS confusion_matrix"
    held_out = f"SELECT * FROM ({dataset}) WHERE split IN ('val', 'test')"
    sql["train_baselines"] = f"""
SELECT model, split, {perfect}, {matrix} FROM ({held_out}), (VALUES ('boosted_trees'), ('kernel_machine'), ('random_forest')) AS m(model)
GROUP BY model, split"""
    sql["lexical_classifier"] = f"SELECT split, {perfect}, {matrix} FROM ({held_out}) GROUP BY split"
    sql["stack_ensemble"] = f"SELECT {perfect}, {matrix} FROM ({dataset}) WHERE split = 'val'"
    sizes = f"""
SELECT source_model, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test
FROM ({dataset}) WHERE label = 1 GROUP BY source_model"""
    sql["cross_model_matrix"] = f"""
SELECT a.source_model AS train_model, b.source_model AS test_model,
       CASE WHEN a.n_train >= 10 AND b.n_test >= 10 THEN 1.0::DOUBLE END AS roc_auc FROM ({sizes}) a, ({sizes}) b"""
    sql["model_bundle_io"] = f"SELECT id, label, 0.0::DOUBLE AS difference FROM ({CORPUS})"
    sql["tree_shap"] = f"""
SELECT id, {len(FEATURES)}::INTEGER AS n_shares, 0.0::DOUBLE AS gap
FROM ({without_rank(f'SELECT id, label FROM ({CORPUS})')}) WHERE split = 'test'"""
    sql["score_snippets"] = f"""
SELECT id, label AS prediction, CASE WHEN label = 1 THEN 'Likely AI-generated' ELSE 'Likely human-written' END AS verdict,
       true AS confidence_fits, 6::INTEGER AS n_reasons, 'log-odds' AS unit FROM ({planted}) WHERE {strip('code')} <> ''"""
    sql["feature_matrix"] = feature_columns(without_rank(CORPUS), "id, label, split, source_model, language")
    # the first column whose values of one label all lie below those of the other
    matrix_of = feature_columns(f"SELECT * FROM ({without_rank(planted)}) WHERE split = 'train'", "label")
    apart = "max({0}) FILTER (label = {1}) < min({0}) FILTER (label = {2})"
    columns = [
        f"{{feature_ix: {i}::INTEGER, feature: {lit(n)}, splits: {apart.format(n, 0, 1)} OR {apart.format(n, 1, 0)}}}" for i, n in enumerate(FEATURES)
    ]
    sql["top_importances"] = f"""
SELECT feature_ix, feature, (feature_ix = min(feature_ix) FILTER (splits) OVER ())::INTEGER::DOUBLE AS importance
FROM (SELECT unnest([{', '.join(columns)}], recursive := true) FROM ({matrix_of}))
ORDER BY importance DESC, feature_ix LIMIT 20"""
    # one cut, halfway between the labels, of the first such style column; names are shorter where it says human
    attacked = style(attack_rows(f"SELECT * FROM ({without_rank(CORPUS)}) WHERE split = 'test'"), ("name_avg_len",), "id, label, attack, ")
    cut = style(f"SELECT * FROM ({without_rank(planted)}) WHERE split = 'train'", ("name_avg_len",), "label, ")
    judged = f"""
SELECT attack, label, (name_avg_len > (SELECT (max(name_avg_len) FILTER (label = 0) + min(name_avg_len) FILTER (label = 1)) / 2 FROM ({cut})))::INTEGER
  AS score FROM ({attacked})"""
    sql["robustness_eval"] = f"""
SELECT attack, {r('avg((score = label)::INTEGER)')} AS accuracy, any_value(roc_auc) AS roc_auc
FROM ({judged}) JOIN ({auc(judged, 'attack')}) USING (attack) GROUP BY attack"""
    sql["prepare_dataset"] = f"SELECT id, label, source_model, split, code FROM ({PREPARED})"
    sql["generate_requests"] = f"SELECT id, problem_id, language, source_model, prompt FROM ({REQUESTS})"
    return sql


def flagship() -> str:
    """Average style features per split and label of the prepared dataset."""
    averages = ", ".join(f"{r(f'avg({n})')} AS {n}" for n in STYLE)
    raw = ", ".join(f"({x})::DOUBLE AS {n}" for n, x in STYLE.items())
    staged = _STAGED.replace("{view}", PREPARED)
    return f"""
SELECT split, label, count(*) AS n, {averages} FROM (SELECT split, label, {raw} FROM ({staged})) GROUP BY split, label"""
