"""SQL counterparts of the queries, for DuckDB over the same tables.

Written from the definitions, not from the Spark plans: filtered aggregates
instead of arrays, lag instead of zipped steps, one idf per test case."""

from shotcurve import fixed_values as fv
from shotcurve.plans.tables import LANGS, PRICED_MODELS

KEYS = "run_id, task_id, category, model_name, example_selection"
SHOT_CASE = "CASE {x} % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END"
SCORES = ", ".join(f"score_{s}shot" for s in fv.SHOTS)

FACTS = f"""fx_results AS (
SELECT 'run_1' AS run_id, event_type AS task_id, concat('cat_', substr(event_type, 1, 1)) AS category,
       concat('vendor/model_', CAST(user_id % 12 AS VARCHAR)) AS model_name,
       {SHOT_CASE.format(x='event_id')} AS shot_count,
       CAST(CAST(floor(event_id / 5) AS BIGINT) % 3 + 1 AS INTEGER) AS trial_id,
       CASE WHEN CAST(floor(event_id / 15) AS BIGINT) % 2 = 0 THEN 'fixed' ELSE 'tfidf' END AS example_selection,
       props AS input, least(CAST(1.0 AS DOUBLE), value / 100) AS score,
       CAST(floor(value * 10) AS BIGINT) AS latency_ms, user_id AS input_tokens, event_id % 97 AS output_tokens
FROM events)"""

LINEITEM_FACTS = f"""fx_results AS (
SELECT 'run_li' AS run_id, concat(l_returnflag, l_linestatus) AS task_id, l_returnflag AS category,
       concat('vendor/model_', CAST(l_suppkey % 12 AS VARCHAR)) AS model_name,
       {SHOT_CASE.format(x='l_linenumber')} AS shot_count,
       CAST(l_orderkey % 3 + 1 AS INTEGER) AS trial_id,
       CASE WHEN l_partkey % 2 = 0 THEN 'fixed' ELSE 'tfidf' END AS example_selection,
       least(CAST(1.0 AS DOUBLE), l_discount * 10) AS score,
       CAST(floor(l_extendedprice) AS BIGINT) AS latency_ms, CAST(floor(l_quantity) AS BIGINT) AS input_tokens,
       l_orderkey % 97 AS output_tokens
FROM lineitem)"""


def summary_ctes(threshold=0.5, median=False, facts=FACTS, where="TRUE", multi=True):
    centre = "median(m)" if median else "avg(m)"
    curve = ",\n".join(
        f"coalesce(max(score) FILTER (shot_count = {s}), 0.0) AS score_{s}shot" for s in fv.SHOTS)
    passes = "".join(f""",
       CASE WHEN {k} > n THEN 0.0 WHEN c >= n THEN 1.0 WHEN c <= 0 THEN 0.0 WHEN n - c < {k} THEN 1.0
            ELSE 1.0 - {fall('n - c', k)} / {fall('n', k)} END AS pass_at_{k},
       CASE WHEN {k} > n OR c < {k} THEN 0.0 ELSE {fall('c', k)} / {fall('n', k)} END AS pass_all_{k}"""
                     for k in fv.K_VALUES)
    pass_avg = "".join(f", avg(pass_at_{k}) AS pass_at_{k}, avg(pass_all_{k}) AS pass_all_{k}"
                       for k in fv.K_VALUES) if multi else ""
    variance = "avg(v)" if multi else "0.0"
    reached = " ".join(f"WHEN score_{s}shot >= CAST({threshold} AS DOUBLE) THEN {s}" for s in fv.SHOTS)
    return f"""{facts},
trial AS (SELECT {KEYS}, shot_count, trial_id, round(avg(score) + 1e-12, 9) AS m, sum(input_tokens) AS it,
                 sum(output_tokens) AS ot, sum(latency_ms) AS lt
          FROM fx_results WHERE {where} GROUP BY {KEYS}, shot_count, trial_id),
point AS (SELECT {KEYS}, shot_count, round({centre} + 1e-12, 9) AS score, var_pop(m) AS v, count(*) AS n,
                 count(*) FILTER (m >= CAST({threshold} AS DOUBLE)) AS c, sum(it) AS it, sum(ot) AS ot, sum(lt) AS lt
          FROM trial GROUP BY {KEYS}, shot_count),
chance AS (SELECT *{passes} FROM point),
curve AS (SELECT {KEYS}, {curve}, CAST(sum(it) AS BIGINT) AS total_input_tokens,
                 CAST(sum(ot) AS BIGINT) AS total_output_tokens, CAST(sum(lt) AS BIGINT) AS total_latency_ms,
                 {variance} AS score_variance{pass_avg}
          FROM chance GROUP BY {KEYS}),
summary AS (SELECT *, (score_8shot - score_0shot) / 8 AS improvement_rate,
                   CASE {reached} ELSE -1 END AS threshold_shots,
                   (score_0shot + 2 * score_1shot + 3 * score_2shot + 6 * score_4shot + 4 * score_8shot) / 16
                     AS learning_curve_auc,
                   (SELECT count(DISTINCT trial_id) FROM fx_results WHERE {where}) AS num_trials
            FROM curve)"""


def fall(n, k):
    return "(" + " * ".join(f"CAST({n} - {i} AS DOUBLE)" for i in range(k)) + ")"


# like the queries: ties at the ninth digit go up whatever the noise of a sum
def rounds(names):
    return ", ".join(f"round({n} + 1e-12, 9) AS {n}" for n in names)


SCORE_NAMES = [f"score_{s}shot" for s in fv.SHOTS]
PASS_NAMES = [f"pass_{kind}_{k}" for k in fv.K_VALUES for kind in ("at", "all")]


def summary_select(multi=True):
    return f"""SELECT {KEYS}, {rounds(SCORE_NAMES + ['improvement_rate'])}, threshold_shots,
{rounds(['learning_curve_auc'])}, num_trials, total_input_tokens, total_output_tokens, total_latency_ms,
{rounds(['score_variance'] + (PASS_NAMES if multi else []))} FROM summary"""


# curves in long form; gaps: zero-ish scores count as missing
def series_ctes(gaps=False, threshold=0.5, shots=fv.SHOTS):
    rows = "\nUNION ALL ".join(
        f"SELECT {KEYS}, {s} AS shot, score_{s}shot AS score FROM summary" for s in shots)
    keep = "WHERE score >= 0.07" if gaps else ""
    return f"""{summary_ctes(threshold)},
long AS (SELECT * FROM ({rows}) {keep}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY shot) AS i,
                   lag(score) OVER (PARTITION BY {KEYS} ORDER BY shot) AS prev,
                   lag(shot) OVER (PARTITION BY {KEYS} ORDER BY shot) AS prev_shot,
                   count(*) OVER (PARTITION BY {KEYS}) AS n FROM long),
ends AS (SELECT {KEYS}, max(n) AS n, max(score) FILTER (i = 1) AS base, max(score) FILTER (i = 2) AS second,
                max(score) FILTER (i = n) AS final, max(shot) FILTER (i = n) AS final_shot,
                max(score) FILTER (i > 1) AS peak FROM ordered GROUP BY {KEYS}),
peaked AS (SELECT e.*, (SELECT min(o.shot) FROM ordered o WHERE o.i > 1 AND o.score = e.peak
                        AND {' AND '.join(f'o.{k} = e.{k}' for k in KEYS.split(', '))}) AS peak_shot FROM ends e),
judged AS (SELECT *, n >= 2 AND base > 0.05 AND peak_shot <> final_shot AND peak > base * 1.1e0
                     AND final < peak * 0.8e0 AS regressed FROM peaked),
pattern AS (SELECT *, CASE WHEN base <= 0.05 THEN 'stable' WHEN regressed THEN 'peak_regression'
                          WHEN (base - final) / base < 0.1e0 THEN 'stable'
                          WHEN (base - second) / (base - final) >= 0.6e0 THEN 'immediate_collapse'
                          ELSE 'gradual_decline' END AS pattern FROM judged WHERE n >= 2),
resilient AS (SELECT *, 1.0 - CASE pattern
                 WHEN 'peak_regression' THEN 0.6e0 * least(1.0, (peak - final) / peak)
                 WHEN 'immediate_collapse' THEN 1.0 * greatest(0.0, least(1.0, (base - final) / base))
                 WHEN 'gradual_decline' THEN 0.5e0 * greatest(0.0, least(1.0, (base - final) / base))
                 ELSE 0.0 END AS resilience FROM pattern)"""


def collapse_select(label="task_id", final="score_8shot", columns=None):
    drop = f"(score_0shot - {final}) / score_0shot * 100"
    columns = columns or f"""'few_shot_collapse' AS type,
CASE WHEN {drop} >= 50 THEN 'collapse' ELSE 'degradation' END AS severity, model_name AS model, task_id,
{label} AS task_label, example_selection, round(score_0shot + 1e-12, 9) AS score_0shot,
round({final} + 1e-12, 9) AS score_final, round({drop} + 1e-12, 9) AS drop_pct"""
    return f"SELECT {columns} FROM summary WHERE score_0shot > 0.05 AND {final} < score_0shot * 0.9e0"


PEAK_SELECT = """SELECT 'peak_regression' AS type, model_name AS model, task_id, task_id AS task_label,
example_selection, round(peak + 1e-12, 9) AS score_peak, peak_shot, round(final + 1e-12, 9) AS score_final,
round((peak - final) / peak * 100 + 1e-12, 9) AS drop_pct FROM judged WHERE regressed"""

DIP_SELECT = f"""SELECT 'mid_curve_dip' AS type, model_name AS model, task_id, task_id AS task_label,
example_selection, prev_shot AS from_shot, shot AS to_shot, round(prev + 1e-12, 9) AS score_from,
round(score + 1e-12, 9) AS score_to, round((prev - score) / prev * 100 + 1e-12, 9) AS drop_pct
FROM ordered WHERE prev > 0.05 AND score < prev * 0.7e0
QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY (prev - score) / prev * 100 DESC, shot) = 1"""

# --- text ------------------------------------------------------------------
PART_PAIRS = """part_pairs AS (
SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN concat(p_type, ':', p_size)
    WHEN 2 THEN concat('分類は', p_type, 'デス') WHEN 3 THEN concat('category: ', p_name)
    WHEN 4 THEN concat('- ', p_name, chr(10), '2. ', p_brand) ELSE '' END AS expected_output,
  CASE p_partkey % 6 WHEN 0 THEN lower(p_type)
    WHEN 1 THEN concat(p_type, '-', p_size % 7, ' ', p_brand)
    WHEN 2 THEN concat(p_type, 'の分類', p_size) WHEN 3 THEN concat('The  category is: ', upper(p_name), '!')
    WHEN 4 THEN concat('```text', chr(10), p_name, chr(10), '``` `', p_brand, '`')
    ELSE p_name END AS actual_output
FROM part)"""

PAIRS = f"""{PART_PAIRS},
pairs AS (SELECT concat('p', p_partkey) AS id, expected_output, actual_output FROM part_pairs
UNION ALL
SELECT concat('c', u.conv_id, '/', u.turn), u.text, a.text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant')"""


def plain(x):
    x = f"regexp_replace({x}, '(?s)```\\w*\\n?(.*?)```', '\\1', 'g')"
    x = f"regexp_replace({x}, '`([^`]+)`', '\\1', 'g')"
    x = f"regexp_replace({x}, '(?m)^\\s*[-*•]\\s+', '', 'g')"
    return f"regexp_replace({x}, '(?m)^\\s*\\d+\\.\\s+', '', 'g')"


def norm(x):
    return f"trim(regexp_replace(lower({plain(x)}), '\\s+', ' ', 'g'))"


RUNS = ("[぀-ゟ]+|[゠-ヿ]+|[一-鿿]+|[0-9A-Za-z]+"
        "|[\\x00-\\x1f!-/:-@\\[-`{{-\\x7f]+|[^\\x00-\\x7f぀-ヿ一-鿿]+").replace("{{", "{")


def runs(x):
    return f"regexp_extract_all({x}, '{RUNS}')"


def words(x):
    return f"[x for x in string_split_regex({x}, '\\s+') if x <> '']"


def tokens(x):
    return f"CASE WHEN len({words(x)}) >= 3 THEN {words(x)} ELSE {runs(x)} END"


NORMED = f"normed AS (SELECT id, {norm('expected_output')} AS e, {norm('actual_output')} AS a FROM pairs)"
F1 = f"""toks AS (SELECT *, list_distinct({tokens('e')}) AS et, list_distinct({tokens('a')}) AS at_ FROM normed),
overlap AS (SELECT *, len(list_intersect(et, at_)) AS both_sides,
       len([t for t in at_ if length(t) >= 2 AND contains(e, t)]) AS a_hits,
       len([t for t in et if length(t) >= 2 AND contains(a, t)]) AS e_hits FROM toks),
shares AS (SELECT *, CASE WHEN both_sides > 0 THEN both_sides ELSE a_hits END / CAST(len(at_) AS DOUBLE) AS p,
       CASE WHEN both_sides > 0 THEN both_sides ELSE e_hits END / CAST(len(et) AS DOUBLE) AS r FROM overlap),
f1 AS (SELECT *, CASE WHEN len(et) = 0 OR len(at_) = 0 OR p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1
       FROM shares)"""

JUDGE_CASES = """judge_cases AS (
SELECT p_partkey,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '.')
    ELSE concat('{"brand": "', p_brand, '", "size": ', p_size, '}') END AS expected_output,
  p_partkey % 3 = 2 AS is_rubric, concat(p_type, ' ', p_name) AS actual_output,
  CASE WHEN p_size % 2 = 0 THEN p_brand END AS input,
  CASE WHEN p_size % 3 = 0 THEN [p_type, p_brand] END AS variations,
  CASE p_partkey % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'natural' ELSE 'rubric' END AS prompt_kind,
  CASE p_partkey % 4 WHEN 0 THEN (p_size % 10) / 10.0e0 WHEN 2 THEN (p_size % 10) / 10.0e0 END AS reply_score,
  CASE WHEN p_partkey % 4 = 0 THEN 'r' END AS reply_reason,
  p_brand, p_size
FROM part)"""


def sql_text(lines):
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)


_INPUT = f"CASE WHEN input IS NULL THEN '' ELSE '{fv.JUDGE_INPUT}' || chr(10) || input || chr(10) || chr(10) END"
_ACTUAL = f"'{fv.JUDGE_ACTUAL}' || chr(10) || actual_output || chr(10)"
_VARIATIONS = (f"CASE WHEN variations IS NULL THEN '' ELSE chr(10) || '{fv.JUDGE_VARIATIONS}' || chr(10) || '  - '"
               " || variations[1] || chr(10) || '  - ' || variations[2] || chr(10) END")


def _judge_prompt(head, main, tail):
    return f"{head} || chr(10) || {_INPUT} || {main}{_ACTUAL} || {_VARIATIONS} || chr(10) || '{tail}'"


KEYWORD_PROMPT = _judge_prompt(
    sql_text([*fv.JUDGE_KEYWORD_HEAD, fv.JUDGE_KEYWORD_LIST])
    + " || chr(10) || '  1. ' || split_part(expected_output, ' ', 1) || chr(10) || '  2. ' ||"
      " split_part(expected_output, ' ', 2) || chr(10) || " + sql_text(fv.JUDGE_KEYWORD_RULE),
    "", fv.JUDGE_KEYWORD_TAIL)
NATURAL_PROMPT = _judge_prompt(
    sql_text(fv.JUDGE_NATURAL_HEAD),
    f"'{fv.JUDGE_EXPECTED}' || chr(10) || expected_output || chr(10) || chr(10) || ", fv.JUDGE_NATURAL_TAIL)
RUBRIC_PROMPT = _judge_prompt(
    sql_text(fv.JUDGE_RUBRIC_HEAD),
    f"'{fv.JUDGE_RUBRIC}' || chr(10) || '{{' || chr(10) || '  \"brand\": \"' || p_brand || '\",' || chr(10) ||"
    " '  \"size\": ' || p_size || chr(10) || '}' || chr(10) || chr(10) || ", fv.JUDGE_RUBRIC_TAIL)

PRICES = "prices(model_name, input_price, output_price) AS (VALUES " + ", ".join(
    f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, (i, o) in fv.PRICES.items()) + ")"
USAGE = f"""usage AS (
SELECT event_id, [{', '.join(f"'{m}'" for m in PRICED_MODELS)}][user_id % 16 + 1] AS model_name,
       event_id % 5000 - 10 AS input_tokens, user_id AS output_tokens,
       CAST(floor(value * 10) AS BIGINT) AS latency_ms, least(1.0e0, value / 100) AS score FROM events),
checked AS (SELECT *, CASE WHEN input_tokens < 0 THEN 'input_tokens must be non-negative'
                           WHEN output_tokens < 0 THEN 'output_tokens must be non-negative'
                           WHEN latency_ms < 0 THEN 'latency_ms must be non-negative' END AS usage_error FROM usage),
priced AS (SELECT u.*, CASE WHEN usage_error IS NULL THEN coalesce(p.input_price, 0.0) END AS input_price,
                  CASE WHEN usage_error IS NULL THEN coalesce(p.output_price, 0.0) END AS output_price
           FROM checked u LEFT JOIN prices p USING (model_name))"""

# --- grid and examples -----------------------------------------------------
TURNS = """turns AS (SELECT concat('task_', conv_id % 5) AS task_id, CAST(conv_id % 5 AS INTEGER) AS task_pos,
       conv_id * 100 + turn AS pos, text AS input FROM conversations WHERE role = 'user')"""


def values(name, columns, rows):
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


MODELS = values("models", "model_pos, model_name", [(0, "vendor/model_a"), (1, "claude-b"), (2, "lmstudio/c")])
SELECTIONS = values("selections", "selection_pos, example_selection", [(0, "fixed"), (1, "tfidf")])
TRIALS = values("trials", "trial_id", [(1,), (2,)])
SHOTS = values("shots", "shot_pos, shot_count", list(enumerate(fv.SHOTS)))
COMPOSITION = values("composition", "shot, n_e, n_d", [(s, e, d) for s, (e, d) in fv.SHOT_COMPOSITION.items()])


def cells(cases="turns", shots=SHOTS):
    return f"""{MODELS}, {SELECTIONS}, {TRIALS}, {shots},
cells AS (SELECT c.*, selection_pos, example_selection, trial_id, model_pos, model_name, shot_pos, shot_count
          FROM {cases} c, selections, trials, models, shots)"""


BENCH = f"""bench AS (SELECT {list(LANGS)}[item_id % 4 + 1] AS task_id, item_id AS pos, text AS input FROM benchmark)"""
POOL = """pool AS (SELECT lang AS task_id, doc_id AS pos, text AS input, source AS output,
       doc_id % 7 = 0 AS is_distractor FROM documents)"""
FIRST = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id, is_distractor ORDER BY pos) AS rn FROM pool)"""
ENTRY = "concat(output, CASE WHEN is_distractor THEN '*' ELSE '' END, ':', md5(input))"
FIXED = f"""{BENCH}, {POOL}, {FIRST}, {COMPOSITION},
chosen AS (SELECT b.task_id, b.pos, c.shot AS shot_count, n.output, n.input, n.is_distractor,
                  row_number() OVER (PARTITION BY b.task_id, b.pos, c.shot ORDER BY n.is_distractor, n.rn) - 1 AS i
           FROM bench b, composition c LEFT JOIN numbered n ON n.task_id = b.task_id
             AND n.rn <= CASE WHEN n.is_distractor THEN c.n_d ELSE c.n_e END)"""

# n-grams per padded word, then one idf per test case from the plain definition
GRAMS = """{name} AS (
WITH w AS (SELECT {keys}, ' ' || unnest([x for x in string_split_regex(lower(input), '\\s+') if x <> '']) || ' ' AS w
           FROM {source}),
g AS (SELECT {keys}, unnest([substr(w, i, 2) for i in range(1, length(w))]
        || [substr(w, i, 3) for i in range(1, length(w) - 1)]
        || CASE WHEN length(w) >= 4 THEN [substr(w, i, 4) for i in range(1, length(w) - 2)]
                ELSE CAST([] AS VARCHAR[]) END) AS gram FROM w)
SELECT {keys}, gram, count(*) AS tf FROM g GROUP BY ALL)"""

SIMILARITY = f"""{BENCH}, {POOL}, exemplars AS (SELECT * FROM pool WHERE NOT is_distractor),
{GRAMS.format(name='cg', keys='task_id, pos', source='bench')},
{GRAMS.format(name='eg', keys='task_id, pos', source='exemplars')},
df AS (SELECT task_id, gram, count(*) AS df FROM eg GROUP BY ALL),
ne AS (SELECT task_id, count(*) AS ne FROM exemplars GROUP BY ALL),
cw AS (SELECT c.task_id, c.pos AS case_key, c.gram, c.tf * (ln((2.0e0 + ne) / (2.0e0 + coalesce(df, 0))) + 1) AS w
       FROM cg c JOIN ne USING (task_id) LEFT JOIN df USING (task_id, gram)),
clen AS (SELECT task_id, case_key, sqrt(sum(w * w)) AS len FROM cw GROUP BY ALL),
ew AS (SELECT e.task_id, e.pos, e.gram, e.tf, ln((2.0e0 + ne) / (1.0e0 + df)) + 1 AS idf_without,
              ln((2.0e0 + ne) / (2.0e0 + df)) + 1 AS idf_with
       FROM eg e JOIN df USING (task_id, gram) JOIN ne USING (task_id)),
elen AS (SELECT task_id, pos, sum(tf * idf_without * tf * idf_without) AS sq FROM ew GROUP BY ALL),
shared AS (SELECT e.task_id, c.case_key, e.pos, sum(e.tf * e.idf_with * c.w) AS dot,
                  sum(e.tf * e.tf * e.idf_with * e.idf_with) AS sq_with,
                  sum(e.tf * e.tf * e.idf_without * e.idf_without) AS sq_without
           FROM ew e JOIN cw c USING (task_id, gram) GROUP BY ALL),
sims AS (SELECT s.task_id, s.case_key, s.pos,
                round(dot / (clen.len * sqrt(elen.sq - sq_without + sq_with)), 10) AS similarity
         FROM shared s JOIN clen USING (task_id, case_key) JOIN elen USING (task_id, pos))"""

RANKED = f"""{SIMILARITY},
everything AS (SELECT b.task_id, b.pos AS case_key, e.pos, coalesce(s.similarity, 0.0) AS similarity
               FROM bench b JOIN exemplars e USING (task_id)
               LEFT JOIN sims s ON s.task_id = b.task_id AND s.case_key = b.pos AND s.pos = e.pos),
top AS (SELECT *, row_number() OVER (PARTITION BY task_id, case_key ORDER BY similarity DESC, pos DESC) AS rank
        FROM everything QUALIFY rank <= 6)"""

TFIDF_CHOSEN = f"""{RANKED}, {FIRST}, {COMPOSITION},
offers AS (SELECT t.task_id, t.case_key, p.output, p.input, FALSE AS is_distractor, t.rank
           FROM top t JOIN pool p USING (task_id, pos)
           UNION ALL SELECT b.task_id, b.pos, n.output, n.input, TRUE, n.rn
           FROM bench b JOIN numbered n ON n.task_id = b.task_id AND n.is_distractor AND n.rn <= 2
           WHERE EXISTS (SELECT 1 FROM exemplars e WHERE e.task_id = b.task_id)),
similar_chosen AS (SELECT b.task_id, b.pos, c.shot AS shot_count, o.output, o.input, o.is_distractor, o.rank AS i
           FROM bench b, composition c LEFT JOIN offers o ON o.task_id = b.task_id AND o.case_key = b.pos
             AND o.rank <= CASE WHEN o.is_distractor THEN c.n_d ELSE c.n_e END)"""


def shown(source, order, axes=""):
    return f"""SELECT task_id, pos, shot_count{axes},
coalesce(string_agg({ENTRY}, '|' ORDER BY {order}) FILTER (output IS NOT NULL), '') AS shown
FROM {source} GROUP BY task_id, pos, shot_count{axes}"""


SECTION = (f"coalesce('{fv.PROMPT_EXAMPLES}' || chr(10) || string_agg('{fv.PROMPT_INPUT}' || input || chr(10) ||"
           f" '{fv.PROMPT_OUTPUT}' || output, chr(10) || chr(10) ORDER BY {{order}})"
           " FILTER (output IS NOT NULL), '')")

ANSWERED = f"""{TURNS}, {cells()},
answered AS (SELECT *, sha256(input) AS input_sha256, pos % 3 <> 0 AS given, length(input) % 3 = 1 AS failed FROM cells),
-- a key shared by several turns has an answer if any of them was answered
keyed AS (SELECT *, bool_or(given) OVER (PARTITION BY task_id, model_name, shot_count, trial_id, input_sha256,
            example_selection) AS said FROM answered),
responded AS (SELECT *, CASE WHEN said AND failed THEN 'timeout' WHEN NOT said THEN 'no response' END AS response_error
              FROM keyed)"""

def with_(ctes, select):
    return f"WITH {ctes}\n{select}"


ORACLES = {
    # --- sources
    "task_packs": """SELECT concat('pack_', p_partkey) AS pack_id, p_name AS pack_name, p_type AS description,
        '1.0' AS version, p_brand AS categories, 1 AS task_count FROM part""",
    "task_pack_tasks": """SELECT concat('pack_', p_partkey) AS pack_id, 0 AS task_pos, concat('task_', p_partkey) AS task_id,
        p_brand AS category, p_name AS description, CASE WHEN p_size % 3 = 0 THEN 'easy' ELSE 'hard' END AS difficulty,
        '1.0' AS version, CASE p_size % 4 WHEN 0 THEN 'Acquisition|Fidelity' WHEN 1 THEN '' ELSE 'Acquisition' END AS measures,
        CASE WHEN p_size % 2 = 0 THEN concat('do ', p_name) ELSE '' END AS instruction FROM part""",
    "task_pack_examples": """WITH e AS (SELECT *, 0 AS pos, p_name AS input, p_type AS output, FALSE AS is_distractor FROM part
        UNION ALL SELECT *, 1, p_brand, p_type, FALSE FROM part
        UNION ALL SELECT *, 0, p_type, p_name, TRUE FROM part WHERE p_size % 2 = 0)
        SELECT concat('pack_', p_partkey) AS pack_id, 0 AS task_pos, concat('task_', p_partkey) AS task_id, pos,
        input, output, is_distractor FROM e""",
    "task_pack_test_cases": """WITH c AS (SELECT *, 0 AS pos, p_name AS input, FALSE AS expected_is_rubric,
          'exact_match' AS scoring_method, CAST(NULL AS VARCHAR) AS acceptable_variations, p_type AS expected_output FROM part
        UNION ALL SELECT *, 1, p_brand, TRUE, 'llm_judge', p_type,
          concat('{"brand": "', p_brand, '", "size": ', p_size, '}') FROM part)
        SELECT concat('pack_', p_partkey) AS pack_id, 0 AS task_pos, concat('task_', p_partkey) AS task_id,
        p_brand AS category, pos, input, expected_is_rubric, scoring_method, acceptable_variations, expected_output FROM c""",
    "task_files": """SELECT CAST(p_partkey AS VARCHAR) AS file_name, concat('task_', p_partkey) AS task_id,
        CASE WHEN p_size % 3 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, '1.0' AS version,
        CASE WHEN p_size % 2 = 0 THEN concat('do ', p_name) ELSE '' END AS instruction, 2 AS num_cases
        FROM part WHERE p_partkey % 5 > 1""",
    "task_violations": """SELECT CAST(p_partkey AS VARCHAR) AS task_id, 'missing field: category' AS problem
        FROM part WHERE p_size % 5 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), concat('invalid measure: ', p_type) FROM part WHERE p_size % 2 = 0""",
    "task_pack_catalogue": """SELECT concat('pack_', p_partkey) AS pack_id,
        CASE WHEN p_partkey % 7 = 1 THEN concat('pack_', p_partkey) ELSE p_name END AS pack_name, p_type AS description,
        concat('/packs/task_pack_', p_partkey, '.json') AS file_path, 1 AS task_count FROM part WHERE p_partkey % 7 <> 0""",
    "tasks_needing_judge": with_(TURNS, "SELECT DISTINCT task_id FROM turns WHERE pos % 3 = 0"),
    "results_parquet_round_trip": with_(FACTS, """SELECT concat('run_', task_id) AS run_id, task_id, category, model_name,
        shot_count, input, concat('say "', task_id, '",', chr(10), 'then stop') AS expected_output, input AS actual_output,
        round(score + 1e-12, 9) AS score, 'f1' AS scoring_method, latency_ms, '2024-01-01T00:00:00' AS timestamp, trial_id,
        input_tokens, output_tokens, example_selection FROM fx_results"""),
    "results_csv_round_trip": with_(FACTS, """SELECT concat('run_', task_id) AS run_id, task_id, category, model_name,
        shot_count, input, concat('say "', task_id, '",', chr(10), 'then stop') AS expected_output, input AS actual_output,
        round(score + 1e-12, 9) AS score, 'f1' AS scoring_method, latency_ms, '2024-01-01T00:00:00' AS timestamp, 1 AS trial_id,
        input_tokens, output_tokens, 'fixed' AS example_selection FROM fx_results"""),
    "summaries_combined": with_(summary_ctes(), f"""{summary_select()}
        UNION ALL SELECT run_id, task_id, category, model_name, NULL, {rounds(SCORE_NAMES + ['improvement_rate'])},
        threshold_shots, round(learning_curve_auc + 1e-12, 9), num_trials, total_input_tokens, total_output_tokens,
        total_latency_ms, round(score_variance + 1e-12, 9), NULL, NULL, NULL, NULL FROM summary WHERE example_selection = 'fixed'"""),
    "run_catalog": """SELECT event_type AS run_id,
        CASE event_type WHEN 'error' THEN 'demo/raw_results_error.csv' ELSE concat('raw_results_', event_type, '.csv') END AS raw_path,
        CASE WHEN event_type <> 'error' THEN concat('summary_', event_type, '.csv') END AS summary_path
        FROM events GROUP BY event_type""",
    # --- grid, selection, prompts
    "evaluation_grid": with_(f"{TURNS}, {cells()}", "SELECT * EXCLUDE (input) FROM cells"),
    "eval_key": with_(FACTS, """SELECT task_id, model_name, shot_count, trial_id, sha256(input) AS input_sha256,
        example_selection, count(*) AS num_rows FROM fx_results GROUP BY ALL"""),
    "pending_evaluations": with_(f"""{TURNS}, {cells()}, keyed AS (SELECT *, sha256(input) AS input_sha256 FROM cells),
        done AS (SELECT DISTINCT task_id, model_name, shot_count, trial_id, input_sha256, example_selection
                 FROM keyed WHERE pos % 3 = 0)""", """SELECT task_id, model_name, shot_count, trial_id, input_sha256,
        example_selection, pos FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.task_id = k.task_id
        AND d.model_name = k.model_name AND d.shot_count = k.shot_count AND d.trial_id = k.trial_id
        AND d.input_sha256 = k.input_sha256 AND d.example_selection = k.example_selection)"""),
    "available_models": with_(FACTS, """SELECT model_name, count(*) AS num_rows FROM fx_results GROUP BY model_name
        HAVING max(latency_ms) % 2 = 0"""),
    "resolved_shot_counts": """SELECT event_id, CASE WHEN x <= 0 THEN 0 WHEN x = 1 THEN 1 WHEN x <= 3 THEN 2
        WHEN x <= 6 THEN 4 ELSE 8 END AS shot_count FROM (SELECT event_id, event_id % 15 - 3 AS x FROM events)""",
    "shot_composition": with_(f"""{TURNS}, {cells(shots=values('shots', 'shot_pos, shot_count',
        list(enumerate([0, 1, 2, 3, 4, 6, 8, 12]))))}, {values('rule', 'shot_count, n_exemplars, n_distractors',
        [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 2, 2), (6, 2, 2), (8, 6, 2), (12, 6, 2)])}""",
        "SELECT shot_count, n_exemplars, n_distractors, count(*) AS num_cells FROM cells JOIN rule USING (shot_count) GROUP BY ALL"),
    "fixed_selection": with_(f"{FIXED}, {MODELS}, {TRIALS}", shown(
        "chosen, models, trials", "is_distractor, i", ", model_name, trial_id")),
    "char_ngrams": with_("src AS (SELECT item_id, text AS input FROM benchmark), "
                         + GRAMS.format(name="g0", keys="item_id", source="src"), "SELECT item_id, gram, tf FROM g0"),
    "gram_counts": with_("src AS (SELECT doc_id, text AS input FROM documents), "
                         + GRAMS.format(name="g0", keys="doc_id", source="src"),
                         "SELECT doc_id, count(*) AS num_grams, CAST(sum(tf) AS BIGINT) AS num_occurrences FROM g0 GROUP BY doc_id"),
    "tfidf_vectors": with_(SIMILARITY, """SELECT task_id, 'case' AS kind, case_key AS id, count(*) AS num_grams,
        round(sqrt(sum(w * w)), 7) AS inside, CAST(NULL AS DOUBLE) AS outside FROM cw GROUP BY ALL
        UNION ALL SELECT task_id, 'example', pos, count(*), round(sqrt(sum(tf * idf_with * tf * idf_with)), 7),
        round(sqrt(sum(tf * idf_without * tf * idf_without)), 7) FROM ew GROUP BY ALL"""),
    "tfidf_similarity": with_(SIMILARITY, "SELECT task_id, case_key, pos, round(similarity, 7) AS similarity FROM sims"),
    "tfidf_topk": with_(RANKED, "SELECT task_id, case_key, pos, round(similarity, 7) AS similarity, rank FROM top"),
    "tfidf_selection": with_(f"{TFIDF_CHOSEN}, {MODELS}, {TRIALS}", shown(
        "similar_chosen, models, trials", "is_distractor, i", ", model_name, trial_id")),
    "shuffled_examples": with_(f"""{FIXED}, {MODELS}, {TRIALS},
        runs AS (SELECT c.task_id, concat_ws('/', c.pos, t.trial_id, m.model_name) AS pos, c.shot_count, c.output, c.input,
          c.is_distractor, md5(concat_ws('|', '7', c.task_id, b.input, c.shot_count, t.trial_id, m.model_name, 'fixed', c.i)) AS mark
          FROM chosen c JOIN bench b ON b.task_id = c.task_id AND b.pos = c.pos, models m, trials t)""", shown("runs", "mark")),
    "examples_sections": with_(f"{FIXED}, {MODELS}, {TRIALS}", f"""SELECT task_id, pos, shot_count, model_name, trial_id,
        {SECTION.format(order='is_distractor, i')} AS examples_section FROM chosen, models, trials
        GROUP BY task_id, pos, shot_count, model_name, trial_id"""),
    "prompts_by_cell": with_(f"""{TFIDF_CHOSEN}, {MODELS}, {TRIALS},
        picks AS (SELECT 'tfidf' AS example_selection, * FROM similar_chosen
          UNION ALL SELECT 'fixed', b.task_id, b.pos, c.shot, n.output, n.input, n.is_distractor, n.rn
          FROM bench b, composition c LEFT JOIN numbered n ON n.task_id = b.task_id
            AND n.rn <= CASE WHEN n.is_distractor THEN c.n_d ELSE c.n_e END),
        sections AS (SELECT example_selection, task_id, pos, shot_count, {SECTION.format(order='is_distractor, i')} AS s
          FROM picks GROUP BY ALL),
        prompts AS (SELECT s.task_id, s.pos, s.shot_count, s.example_selection, '{fv.PROMPT_OPENING}' || chr(10) || chr(10)
          || '{fv.PROMPT_TASK}' || CASE WHEN s.task_id = 'en' THEN 'answer in English' ELSE 'about ' || s.task_id END
          || CASE WHEN s = '' THEN '' ELSE chr(10) || chr(10) || s END || chr(10) || chr(10) || '{fv.PROMPT_TURN}' || chr(10)
          || '{fv.PROMPT_INPUT}' || b.input || chr(10) || '{fv.PROMPT_CUE}' AS prompt
          FROM sections s JOIN bench b USING (task_id, pos))""",
        """SELECT task_id, pos, shot_count, example_selection, model_name, trial_id, length(prompt) AS prompt_length,
        md5(prompt) AS prompt_md5 FROM prompts, models, trials"""),
    "attached_responses": with_(ANSWERED, """SELECT task_id, model_name, shot_count, trial_id, input_sha256, example_selection, pos,
        CASE WHEN response_error IS NULL THEN input END AS actual_output, response_error,
        CASE WHEN said THEN length(input) * 7 ELSE 0 END AS latency_ms, CASE WHEN said THEN length(input) ELSE 0 END AS input_tokens,
        CASE WHEN said THEN shot_count ELSE 0 END AS output_tokens FROM responded"""),
    "scored_facts": with_(f"""{ANSWERED}, pairs AS (SELECT DISTINCT input AS id, input AS expected_output, substr(input, 11) AS actual_output
        FROM responded), {NORMED}, {F1}""", """SELECT 'run_1' AS run_id, task_id, 'c' AS category, model_name, shot_count,
        coalesce('ERROR: ' || response_error, substr(input, 11)) AS actual_output,
        CASE WHEN response_error IS NULL THEN round(f1 + 1e-12, 9) ELSE 0.0 END AS score, 'f1' AS scoring_method,
        CASE WHEN response_error IS NULL THEN length(input) * 7 ELSE 0 END AS latency_ms, '2024-01-01T00:00:00' AS timestamp, trial_id,
        CASE WHEN response_error IS NULL THEN length(input) ELSE 0 END AS input_tokens,
        CASE WHEN response_error IS NULL THEN shot_count ELSE 0 END AS output_tokens, example_selection
        FROM responded JOIN f1 ON f1.id = input"""),
    "cleaned_responses": """SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'lmstudio/m' WHEN 1 THEN 'gpt-5.4' WHEN 2 THEN 'claude-x'
          ELSE 'gemini-y' END AS model_name,
        CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id % 4 < 2 THEN event_type ELSE '<think>a b</think> ' || event_type END
          WHEN 1 THEN CASE WHEN user_id % 4 = 1 THEN '' ELSE '<think>only</think>' END
          WHEN 2 THEN event_type END AS output FROM events""",
    "providers": """SELECT event_id, ['lmstudio/m', 'gpt-5.4', 'claude-x', 'gemini-y'][user_id % 4 + 1] AS model_name,
        ['local', 'openai', 'anthropic', 'vertex'][user_id % 4 + 1] AS provider,
        ['m', 'gpt-5.4', 'claude-x', 'gemini-y'][user_id % 4 + 1] AS api_model_name FROM events""",
    # --- text scoring
    "markdown_removed": with_(PART_PAIRS, f"""SELECT p_partkey, {plain('actual_output')} AS actual_output,
        {plain('expected_output')} AS expected_output FROM part_pairs"""),
    "normalized_documents": f"""SELECT doc_id, length(n) AS norm_length, md5(n) AS norm_md5
        FROM (SELECT doc_id, {norm('text')} AS n FROM documents)""",
    "score_exact": with_(f"{PAIRS}, {NORMED}", "SELECT id, CAST(e = a AS DOUBLE) AS score FROM normed"),
    "score_contains": with_(f"{PAIRS}, {NORMED}", "SELECT id, CAST(contains(a, e) AS DOUBLE) AS score FROM normed"),
    "char_type_runs": with_(PAIRS, f"SELECT id, array_to_string({runs('actual_output')}, '|') AS runs FROM pairs"),
    "tokens": with_(f"{PAIRS}, {NORMED}", f"SELECT id, array_to_string({tokens('e')}, '|') AS tokens FROM normed"),
    "score_f1": with_(f"{PAIRS}, {NORMED}, {F1}", "SELECT id, round(f1 + 1e-12, 9) AS score FROM f1"),
    "score_dispatch": with_(f"""{PART_PAIRS}, {JUDGE_CASES}, pairs AS (SELECT p_partkey AS id, * FROM part_pairs
          UNION ALL SELECT -1 - p_partkey, p_partkey, expected_output, actual_output FROM judge_cases WHERE NOT is_rubric),
        {NORMED}, {F1}""", """SELECT p_partkey, 'llm_judge' AS scoring_method, is_rubric AS expected_is_rubric,
          CAST(NULL AS DOUBLE) AS score, 'grader_client is required for llm_judge scoring' AS score_error FROM judge_cases
        UNION ALL SELECT p_partkey, 'f1', is_rubric, CASE WHEN NOT is_rubric THEN round(f1 + 1e-12, 9) END,
          CASE WHEN is_rubric THEN 'Standard scoring requires a string expected value: f1' END
          FROM judge_cases LEFT JOIN f1 ON id = -1 - p_partkey
        UNION ALL SELECT id, ['exact_match', 'contains', 'f1', 'custom:x', 'rouge'][id % 5 + 1], FALSE,
          CASE id % 5 WHEN 0 THEN CAST(e = a AS DOUBLE) WHEN 1 THEN CAST(contains(a, e) AS DOUBLE) WHEN 2 THEN round(f1 + 1e-12, 9) END,
          CASE id % 5 WHEN 3 THEN 'Custom scoring is not available' WHEN 4 THEN 'Unknown scoring method: rouge' END
          FROM f1 WHERE id >= 0"""),
    "judge_prompt_kinds": with_(JUDGE_CASES, "SELECT p_partkey, prompt_kind FROM judge_cases"),
    "keyword_judge_prompts": with_(JUDGE_CASES, f"SELECT p_partkey, {KEYWORD_PROMPT} AS judge_prompt FROM judge_cases WHERE prompt_kind = 'keyword'"),
    "natural_judge_prompts": with_(JUDGE_CASES, f"SELECT p_partkey, {NATURAL_PROMPT} AS judge_prompt FROM judge_cases WHERE prompt_kind = 'natural'"),
    "rubric_judge_prompts": with_(JUDGE_CASES, f"SELECT p_partkey, {RUBRIC_PROMPT} AS judge_prompt FROM judge_cases WHERE prompt_kind = 'rubric'"),
    "judge_prompts": with_(JUDGE_CASES, f"""SELECT p_partkey, prompt_kind, md5(CASE prompt_kind WHEN 'keyword' THEN {KEYWORD_PROMPT}
        WHEN 'natural' THEN {NATURAL_PROMPT} ELSE {RUBRIC_PROMPT} END) AS prompt_md5 FROM judge_cases"""),
    "grading_prompts": with_(JUDGE_CASES, f"""SELECT CAST(p_partkey AS VARCHAR) AS task_id, prompt_kind, md5(CASE prompt_kind
        WHEN 'keyword' THEN {KEYWORD_PROMPT} WHEN 'natural' THEN {NATURAL_PROMPT} ELSE {RUBRIC_PROMPT} END) AS prompt_md5
        FROM judge_cases WHERE p_partkey % 5 <> 0"""),
    "judge_replies": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN least(1.0e0, CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE))
          WHEN 2 THEN 0.5e0 WHEN 1 THEN (event_id % 10) / 10.0e0
          WHEN 5 THEN (event_id % 10) / 10.0e0 END AS score,
        CASE WHEN event_id % 6 = 0 THEN 'r' END AS reason FROM events""",
    "clamped_scores": "SELECT event_id, round(greatest(0.0, least(1.0, value / 20 - 0.2e0)) + 1e-12, 9) AS score FROM events",
    "judge_fallback": with_(f"""{JUDGE_CASES}, pairs AS (SELECT p_partkey AS id, expected_output, actual_output FROM judge_cases),
        {NORMED}, {F1}""", """SELECT p_partkey, coalesce(reply_score, CASE WHEN is_rubric THEN 0.0 ELSE round(f1 + 1e-12, 9) END) AS score,
        CASE WHEN reply_score IS NOT NULL THEN reply_reason WHEN is_rubric THEN 'LLM judge failed, dict expected: fallback to 0.0'
          ELSE 'LLM judge failed, used fallback: f1' END AS reason FROM judge_cases JOIN f1 ON id = p_partkey"""),
    "expected_texts": with_(JUDGE_CASES, "SELECT p_partkey, expected_output FROM judge_cases"),
    # --- aggregation
    "trial_means": with_(FACTS, f"""SELECT {KEYS}, shot_count, trial_id, round(avg(score) + 1e-12, 9) AS trial_mean
        FROM fx_results GROUP BY ALL"""),
    "trials_mean": with_(FACTS, f"""SELECT {KEYS}, shot_count, round(avg(m) + 1e-12, 9) AS score, count(*) AS num_trials
        FROM (SELECT {KEYS}, shot_count, trial_id, avg(score) AS m FROM fx_results GROUP BY ALL) GROUP BY ALL"""),
    "trials_median": with_(FACTS, f"""SELECT {KEYS}, shot_count, round(median(m) + 1e-12, 9) AS score, count(*) AS num_trials
        FROM (SELECT {KEYS}, shot_count, trial_id, avg(score) AS m FROM fx_results GROUP BY ALL) GROUP BY ALL"""),
    "curve_pivot": with_(FACTS, f"""SELECT {KEYS}, {', '.join(
        f"round(coalesce(max(s) FILTER (shot_count = {s}), 0.0) + 1e-12, 9) AS score_{s}shot" for s in fv.SHOTS)}
        FROM (SELECT {KEYS}, shot_count, avg(m) AS s FROM (SELECT {KEYS}, shot_count, trial_id, avg(score) AS m
        FROM fx_results GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""),
    "usage_totals": with_(FACTS, f"""SELECT {KEYS}, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms
        FROM fx_results GROUP BY ALL"""),
    "improvement_rates": with_(summary_ctes(), f"SELECT {KEYS}, {rounds(['improvement_rate'])} FROM summary"),
    "threshold_shots": with_(summary_ctes(0.25), f"SELECT {KEYS}, threshold_shots FROM summary"),
    "learning_curve_aucs": with_(summary_ctes(), f"SELECT {KEYS}, {rounds(['learning_curve_auc'])} FROM summary"),
    "efficiency_metrics": with_(summary_ctes(0.3), f"SELECT {KEYS}, {rounds(SCORE_NAMES + ['improvement_rate'])}, threshold_shots, {rounds(['learning_curve_auc'])} FROM summary"),
    "score_variance": with_(summary_ctes(), f"SELECT {KEYS}, {rounds(['score_variance'])} FROM summary"),
    "pass_probabilities": f"""WITH t AS (SELECT event_id, event_id % 11 AS n, least(event_id % 11, user_id % 9) AS c FROM events)
        SELECT event_id, {', '.join(f'''round(CASE WHEN n <= 0 OR {k} > n THEN 0.0 WHEN c >= n THEN 1.0 WHEN c <= 0 THEN 0.0
          WHEN n - c < {k} THEN 1.0 ELSE 1.0 - {fall('n - c', k)} / {fall('n', k)} END + 1e-12, 9) AS pass_at_{k},
          round(CASE WHEN n <= 0 OR {k} > n OR c < {k} THEN 0.0 ELSE {fall('c', k)} / {fall('n', k)} END + 1e-12, 9) AS pass_all_{k}'''
          for k in (1, 3, 5))} FROM t""",
    "reliability_metrics": with_(f"""{FACTS}, m AS (SELECT {KEYS}, shot_count, trial_id, avg(floor(score * 100) / 100) AS m FROM fx_results GROUP BY ALL),
        p AS (SELECT {KEYS}, shot_count, avg(m) AS score_mean, var_pop(m) AS score_variance, count(*) AS n,
              count(*) FILTER (m >= 0.3e0) AS c FROM m GROUP BY ALL)""",
        f"""SELECT {KEYS}, shot_count, {rounds(['score_mean', 'score_variance'])}, n AS num_trials, c AS num_successes, {', '.join(f'''
        round(CASE WHEN {k} > n THEN 0.0 WHEN c >= n THEN 1.0 WHEN c <= 0 THEN 0.0 WHEN n - c < {k} THEN 1.0
          ELSE 1.0 - {fall('n - c', k)} / {fall('n', k)} END + 1e-12, 9) AS pass_at_{k},
        round(CASE WHEN {k} > n OR c < {k} THEN 0.0 ELSE {fall('c', k)} / {fall('n', k)} END + 1e-12, 9) AS pass_all_{k}''' for k in fv.K_VALUES)} FROM p"""),
    "summarize_mean": with_(summary_ctes(), summary_select()),
    "summarize_median": with_(summary_ctes(median=True), summary_select()),
    "summarize_single_trial": with_(summary_ctes(where="trial_id = 2", multi=False), summary_select(False)),
    "summarize_lineitem": with_(summary_ctes(0.8, facts=LINEITEM_FACTS), summary_select()),
    "trial_std": with_(FACTS, """SELECT model_name, shot_count, round(stddev_samp(m) + 1e-12, 9) AS std FROM (SELECT model_name, shot_count,
        trial_id, avg(score) AS m FROM fx_results WHERE task_id = 'click' GROUP BY ALL) GROUP BY ALL"""),
    "priced_usage": with_(f"{PRICES}, {USAGE}", "SELECT event_id, model_name, input_price, output_price, usage_error FROM priced"),
    "cost_economy": with_(f"""{PRICES}, {USAGE}, cost AS (SELECT *, input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price
        + latency_ms / 1000.0e0 * 0.0001e0 AS total_cost FROM priced)""", """SELECT event_id, round(total_cost + 1e-12, 9) AS total_cost,
        CASE WHEN usage_error IS NULL THEN round(CASE WHEN total_cost > 0 THEN score / total_cost ELSE 0.0 END, 4) END AS economy_score,
        usage_error FROM cost"""),
    "adaptation_index": with_(f"""{FACTS}, m AS (SELECT model_name, avg(score) FILTER (task_id = 'click') AS a,
        avg(score) FILTER (task_id = 'view') AS b, avg(score) FILTER (task_id = 'error' AND model_name <> 'vendor/model_3') AS c
        FROM fx_results GROUP BY ALL)""", """SELECT model_name, round(a + 1e-12, 9) AS "Acquisition", round(b + 1e-12, 9) AS "Resilience-Noise",
        round(c + 1e-12, 9) AS "Efficiency", round(list_avg([a, b, c]) + 1e-12, 9) AS "AEI" FROM m"""),
    # --- curve analysis
    "shot_series": with_(series_ctes(gaps=True), f"""SELECT {', '.join(f's.{k}' for k in KEYS.split(', '))},
        coalesce(string_agg(CAST(l.shot AS VARCHAR), ',' ORDER BY l.shot), '') AS shots
        FROM summary s LEFT JOIN long l USING ({KEYS}) GROUP BY ALL"""),
    "few_shot_collapse": with_(summary_ctes(), collapse_select()),
    "few_shot_collapse_at_four_shots": with_(summary_ctes(), collapse_select(final="score_4shot")),
    "peak_regression": with_(series_ctes(), PEAK_SELECT),
    "mid_curve_dip": with_(series_ctes(), DIP_SELECT),
    "mid_curve_dip_with_gaps": with_(series_ctes(gaps=True), DIP_SELECT),
    "collapse_pattern": with_(series_ctes(gaps=True), "SELECT model_name AS model, task_id, pattern, example_selection FROM pattern"),
    "resilience": with_(series_ctes(), "SELECT model_name, round(avg(resilience) + 1e-12, 9) AS resilience_score FROM resilient GROUP BY ALL"),
    "enriched_summary": with_(f"""{series_ctes(gaps=True)}, means AS (SELECT example_selection, model_name, avg(resilience) AS r
        FROM resilient GROUP BY ALL)""", f"""SELECT {', '.join(f's.{k}' for k in KEYS.split(', '))}, round(learning_curve_auc + 1e-12, 9) AS learning_curve_auc,
        coalesce(p.pattern, '') AS collapse_pattern, round(m.r + 1e-12, 9) AS resilience_score FROM summary s
        LEFT JOIN pattern p USING ({KEYS}) LEFT JOIN means m ON m.example_selection = s.example_selection AND m.model_name = s.model_name"""),
    "enriched_runs": with_(f"""{series_ctes()}, runs AS (SELECT *, 'run_1' AS run FROM resilient
            UNION ALL SELECT *, 'run_2' FROM resilient WHERE task_id <> 'view'),
        means AS (SELECT run, example_selection, model_name, avg(resilience) AS r FROM runs GROUP BY ALL),
        every AS (SELECT *, 'run_1' AS run FROM summary UNION ALL SELECT *, 'run_2' FROM summary WHERE task_id <> 'view')""",
        f"""SELECT e.run AS run_id, e.task_id, e.category, e.model_name, nullif(e.example_selection, 'fixed') AS example_selection,
        coalesce(p.pattern, '') AS collapse_pattern, round(m.r + 1e-12, 9) AS resilience_score FROM every e
        LEFT JOIN pattern p USING ({KEYS}) LEFT JOIN means m ON m.run = e.run AND m.model_name = e.model_name
        AND m.example_selection = e.example_selection"""),
    "curve_long": with_(series_ctes(), f"SELECT {KEYS}, shot AS shot_count, round(score + 1e-12, 9) AS score FROM long"),
    "drop_intervals": with_(series_ctes(), f"""SELECT {KEYS}, prev_shot AS from_shot, shot AS to_shot, round(prev + 1e-12, 9) AS score_from,
        round(score + 1e-12, 9) AS score_to FROM ordered WHERE score < prev - 0.02e0"""),
    "alerts": with_(series_ctes(), f"""SELECT * FROM ({collapse_select()}) UNION ALL BY NAME SELECT * FROM ({PEAK_SELECT})
        UNION ALL BY NAME SELECT * FROM ({DIP_SELECT})"""),
    "labelled_alerts": with_(summary_ctes(), collapse_select(columns="""model_name AS model, task_id, example_selection,
        concat(category, '/', task_id) AS task_label, round((score_0shot - score_8shot) / score_0shot * 100 + 1e-12, 9) AS drop_pct""")),
    "mapped_alert_labels": with_(summary_ctes(), collapse_select(columns="""model_name AS model, task_id, example_selection,
        CASE WHEN task_id = 'view' THEN task_id ELSE upper(task_id) END AS task_label""")),
    # --- reports
    "short_model_names": with_(FACTS, """SELECT model_name, count(*) AS num_rows, replace(model_name, 'vendor/', '') AS short_name
        FROM fx_results GROUP BY model_name"""),
    "metrics_table": with_(summary_ctes(), f"""SELECT replace(model_name, 'vendor/', '') AS "Model", task_id AS "Task",
        category AS "Category", example_selection, {rounds(SCORE_NAMES + ['improvement_rate'])}, threshold_shots,
        {rounds(['learning_curve_auc'])}, num_trials, {rounds(['score_variance'] + PASS_NAMES)} FROM summary"""),
    "filtered_selection": with_(FACTS, """SELECT task_id, 'fixed' AS example_selection, count(*) AS num_rows FROM fx_results
        WHERE output_tokens % 2 <> 0 OR example_selection = 'fixed' GROUP BY task_id"""),
    "run_overview": with_(FACTS, """SELECT count(DISTINCT task_id) AS num_tasks, count(DISTINCT model_name) AS num_models,
        count(DISTINCT trial_id) AS num_trials, 'fixed, tfidf' AS selections, count(*) AS num_results FROM fx_results"""),
    "learning_curve_table": with_(summary_ctes(), f"""SELECT task_id, model_name, example_selection, {rounds(SCORE_NAMES)},
        {rounds(['learning_curve_auc'])} FROM summary"""),
    "leaderboard": with_(series_ctes(), """SELECT replace(model_name, 'vendor/', '') AS model, example_selection,
        round(avg(resilience) + 1e-12, 9) AS resilience_score FROM resilient GROUP BY ALL"""),
    "pattern_table": with_(series_ctes(), """SELECT replace(model_name, 'vendor/', '') AS model, task_id, example_selection, pattern FROM pattern"""),
    "alert_labels": with_(series_ctes(), """SELECT task_id, concat(replace(model_name, 'vendor/', ''), ' [', example_selection, ']') AS label,
        replace(model_name, 'vendor/', '') AS short_label FROM judged WHERE regressed"""),
    # --- streaming, SQL functions, whole plans
    "stream_ingest": with_(FACTS, """SELECT * EXCLUDE (first) REPLACE (round(score, 9) AS score) FROM (
        SELECT run_id, task_id, category, model_name, shot_count, trial_id, example_selection, input, score, latency_ms,
          input_tokens, output_tokens, sha256(input) AS input_sha256, row_number() OVER (
            PARTITION BY run_id, task_id, model_name, shot_count, trial_id, sha256(input), example_selection
            ORDER BY category, input, input_tokens, latency_ms, output_tokens, score) AS first
        FROM fx_results) WHERE first = 1"""),
    "sql_functions": with_(summary_ctes(0.25), f"""SELECT replace(model_name, 'vendor/', '') AS model, task_id, example_selection,
        {rounds(['learning_curve_auc'])}, threshold_shots, {rounds(['improvement_rate'])},
        CASE threshold_shots WHEN -1 THEN 2 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 4 ELSE 8 END AS nearest_shot,
        CASE threshold_shots WHEN -1 THEN 0.0 WHEN 0 THEN 0.3e0 ELSE round(1 - {fall('9 - threshold_shots', 3)} / 720 + 1e-12, 9) END AS chance
        FROM summary"""),
    "whole_evaluation": """WITH m(model_name) AS (VALUES ('vendor/model_a'), ('claude-b'), ('lmstudio/c')), s(shot_count) AS (VALUES (0), (1), (2), (4), (8)),
        c(scoring_method) AS (VALUES ('exact_match'), ('llm_judge')), t(trial) AS (VALUES (1), (2)), e(example_selection) AS (VALUES ('fixed'), ('tfidf'))
        SELECT p_brand AS category, model_name, shot_count, scoring_method, example_selection, count(*) AS num_rows,
        CASE WHEN model_name = 'claude-b' AND shot_count = 4 THEN 0.0 WHEN scoring_method = 'llm_judge' THEN shot_count / 10.0e0 WHEN shot_count > 0 THEN 1.0 ELSE 0.0 END AS mean_score
        FROM part, m, s, c, t, e GROUP BY ALL""",
}
