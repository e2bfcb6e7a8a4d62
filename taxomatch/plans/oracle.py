"""DuckDB SQL oracle for the query catalogue (same parquet tables as views).

Written as plain set-based SQL (brute force where that is simplest: the
oracle runs only at small sizes). Constants are written out here again, so that
a wrong one in the engine shows.
"""

from __future__ import annotations

# Fixed values, stated independently of the engine.
STOP_WORDS = ("a", "all", "an", "and", "as", "at", "by", "except", "for", "from", "in", "is", "of", "on", "or", "other", "special", "the", "to", "with")
QUERY_PREFIX = "Represent this job for retrieval: "
MAJOR_GROUPS = {
    "11": "Management", "13": "Business & Finance", "15": "Computer & Math", "17": "Architecture & Engineering",
    "19": "Life & Physical Science", "21": "Community & Social Service", "23": "Legal", "25": "Education", "27": "Arts & Media",
    "29": "Healthcare Practitioners", "31": "Healthcare Support", "33": "Protective Service", "35": "Food Preparation",
    "37": "Building & Grounds", "39": "Personal Care", "41": "Sales", "43": "Office & Admin Support", "45": "Farming & Fishing",
    "47": "Construction", "49": "Installation & Repair", "51": "Production", "53": "Transportation", "55": "Military",
}
WEIGHT_NAMES = ("Tasks", "Description", "Skills", "Ofc_Title", "Alt_Titles", "Tools")
ENGINE_WEIGHTS = {"Tasks": 0.2017, "Description": 0.1021, "Skills": 0.0063, "Ofc_Title": 0.3941, "Alt_Titles": 0.2898, "Tools": 0.0061}
TUNED_WEIGHTS = {"Tasks": 0.2016842548871232, "Description": 0.10210320642916487, "Skills": 0.006271551372931259, "Ofc_Title": 0.3940857582990539, "Alt_Titles": 0.28978310958980824, "Tools": 0.006072119421918543}
APP_WEIGHTS = {"Tasks": 0.0051, "Description": 0.07, "Skills": 0.0405, "Ofc_Title": 0.3212, "Alt_Titles": 0.5055, "Tools": 0.0578}
SEARCH_BASELINE = (0.25, 0.2, 0.15, 0.25, 0.1, 0.05)
LABEL_WORDS = ("Nurse", "Teacher", "Driver", "Clerk", "Engineer", "Analyst", "Cook", "Guard", "Painter", "Welder")
HASH_A, HASH_B, HASH_P = 1103515245, 12345, 2147483647


def STRIP(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def TOK(x):
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"


def WORDS(x):
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def AH(x):
    return f"((({x}) * {HASH_A} + {HASH_B}) % {HASH_P})"


def CODE(x):
    return (f"(printf('%02d-%04d.00', 11 + 2 * (({x}) % 23), ({x}) % 10000) || "
            f"CASE WHEN ({x}) < 230000 THEN '' ELSE '-' || CAST(({x}) // 230000 AS VARCHAR) END)")


def IS_CODE(x):
    return f"coalesce(regexp_matches({STRIP(x)}, '^\\d{{2}}-\\d{{4}}\\.\\d{{2}}'), false)"


STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
WCAP = "[" + ", ".join(f"'{w}'" for w in LABEL_WORDS) + "]"


def STEM(w):
    return (f"CASE WHEN length({w}) > 5 AND suffix({w}, 'ers') THEN left({w}, length({w}) - 2) "
            f"WHEN length({w}) > 3 AND suffix({w}, 's') THEN left({w}, length({w}) - 1) ELSE {w} END")


def TITLE_WORDS(x):
    return (f"list_distinct(list_transform(list_filter({TOK(f'coalesce({x}, {chr(39)}{chr(39)})')}, "
            f"lambda w: NOT list_contains({STOPS}, w) AND length(w) > 1), lambda w: {STEM('w')}))")


def MAJOR(x):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAJOR_GROUPS.items())
    return f"(CASE left(coalesce({x}, ''), 2) {cases} ELSE 'Other' END)"


def W(weights: dict, name: str) -> str:
    return f"{float(weights[name])!r}::DOUBLE"


# ---------------------------------------------------------------------------
# Shared CTE blocks
# ---------------------------------------------------------------------------

SURVEY = f"""
survey AS (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 11 = 0 THEN ''
         WHEN o_orderkey % 5 = 0 THEN ' ' || regexp_replace(o_orderpriority, '^[0-9]-', '') || ' manager '
         ELSE regexp_replace(o_orderpriority, '^[0-9]-', '') END AS occupation,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'order ' || CAST(o_orderkey AS VARCHAR) || ' status ' || o_orderstatus END AS description,
    CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'Title ' || CAST(o_custkey AS VARCHAR)
         WHEN o_orderkey % 19 = 0 THEN 'x' ELSE {CODE('o_custkey')} END AS onet_soc,
    CASE WHEN o_orderkey % 17 = 0 THEN {CODE('o_custkey')} WHEN o_orderkey % 4 = 0 THEN {CODE('o_custkey')}
         WHEN o_orderkey % 19 = 0 THEN 'y' ELSE 'Title ' || CAST(o_custkey AS VARCHAR) END AS onet_title
  FROM orders),
labels AS (
  SELECT row_id, {STRIP('occupation')} AS occupation, {STRIP('description')} AS description,
         {STRIP('onet_soc')} AS onet_soc, {STRIP('onet_title')} AS onet_title FROM survey),
clean AS (SELECT * FROM labels WHERE occupation <> '' AND description <> '' AND onet_soc <> ''),
train_rows AS (
  SELECT row_id, occupation, description,
         CASE WHEN bad THEN onet_title ELSE onet_soc END AS onet_soc,
         CASE WHEN bad THEN onet_soc ELSE onet_title END AS onet_title, bad AS swapped
  FROM (SELECT *, NOT {IS_CODE('onet_soc')} AS bad FROM clean)
  WHERE {IS_CODE('CASE WHEN bad THEN onet_title ELSE onet_soc END')}),
split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {AH('row_id')}, row_id)
                      <= CAST(floor(count(*) OVER () * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split
  FROM train_rows),
title_only AS (
  SELECT s_suppkey AS row_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Clerk' ELSE 'Supply clerk ' || CAST(s_suppkey % 7 AS VARCHAR) END AS occupation,
         '' AS description, {CODE('s_suppkey')} AS onet_soc
  FROM supplier),
title_only_ok AS (
  SELECT * FROM title_only
  WHERE occupation <> '' AND onet_soc <> '' AND len({WORDS('occupation')}) >= 2 AND {IS_CODE('onet_soc')}),
train_union AS (
  SELECT 'primary' AS source, row_id, occupation, description, onet_soc FROM split WHERE split = 'train'
  UNION ALL
  SELECT 'title_only', row_id, occupation, description, onet_soc FROM title_only_ok)"""

KB = f"""
occ AS (
  SELECT {CODE('c_custkey')} AS code, c_name AS title,
         c_mktsegment || ' buyer from nation ' || CAST(c_nationkey AS VARCHAR) AS description FROM customer),
tasks AS (
  SELECT {CODE('o_custkey')} AS code, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS task_id,
         'ship part ' || CAST(l_partkey AS VARCHAR) || ' qty ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS task,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rg AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
ratings AS (
  SELECT {CODE('o_custkey')} AS code, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS task_id,
         CASE WHEN flag = 'R' THEN 'LV' ELSE 'IM' END AS scale_id,
         CASE WHEN q > 45 THEN NULL WHEN q > 40 THEN '' WHEN l_linenumber = 7 THEN 'n/a'
              ELSE CAST(1.0::DOUBLE + q * 0.08::DOUBLE AS VARCHAR) END AS rating
  FROM rg JOIN orders ON l_orderkey = o_orderkey),
wtasks AS (
  SELECT t.*, r.rating,
         CASE WHEN r.rating IS NULL OR {STRIP('r.rating')} = '' OR lower({STRIP('r.rating')}) = 'nan'
                   OR TRY_CAST({STRIP('r.rating')} AS DOUBLE) IS NULL OR isnan(TRY_CAST({STRIP('r.rating')} AS DOUBLE)) THEN 0.5
              ELSE round((TRY_CAST({STRIP('r.rating')} AS DOUBLE) - 1.0) / 4.0, 2) END AS weight
  FROM tasks t LEFT JOIN (SELECT * FROM ratings WHERE scale_id = 'IM') r USING (code, task_id)),
nest AS (
  SELECT code, count(*) AS n_tasks,
         string_agg(task || ':' || printf('%.2f', weight), ';'
                    ORDER BY l_orderkey * 1000 + l_linenumber, task, weight) AS tasks_text
  FROM wtasks GROUP BY code),
alt AS (SELECT {CODE('o_custkey')} AS code, coalesce(string_agg(o_orderpriority, ' | ' ORDER BY o_orderkey), '') AS all_alt_titles
        FROM orders GROUP BY 1),
skills AS (SELECT {CODE('o_custkey')} AS code,
                  coalesce(string_agg(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'status ' || o_orderstatus END, ' | ' ORDER BY o_orderkey), '') AS all_tech_skills
           FROM orders GROUP BY 1),
tools AS (SELECT {CODE('c_custkey')} AS code, coalesce(string_agg(n_name, ' | ' ORDER BY c_custkey), '') AS all_tools
          FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
kb AS (
  SELECT occ.code, coalesce(occ.title, '') AS title, coalesce(occ.description, '') AS description,
         coalesce(nest.tasks_text, '') AS tasks_text, coalesce(alt.all_alt_titles, '') AS all_alt_titles,
         coalesce(skills.all_tech_skills, '') AS all_tech_skills, coalesce(tools.all_tools, '') AS all_tools
  FROM occ LEFT JOIN nest USING (code) LEFT JOIN alt USING (code) LEFT JOIN skills USING (code) LEFT JOIN tools USING (code)),
profiles AS (
  SELECT code, {STRIP("array_to_string(list_filter([title, description, all_alt_titles, all_tech_skills], lambda x: x <> ''), ' ')")} AS profile
  FROM kb)"""

EMB = f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
el AS (SELECT vec_id, label, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM e),
ew AS (SELECT vec_id, ((vec_id % 5) + 1) / 5.0::DOUBLE AS w FROM e),
cent AS (SELECT el.label, pos, avg(x) AS c, sum(w * x) / sum(w) AS cw FROM el JOIN ew USING (vec_id) GROUP BY el.label, pos),
kbv AS (SELECT label, pos, pos % 6 AS f, CASE WHEN pos % 6 = 0 THEN cw ELSE c END AS val FROM cent),
kbn AS (SELECT label, f, sqrt(sum(val * val)) AS kn FROM kbv GROUP BY label, f),
qn AS (SELECT vec_id, sqrt(sum(x * x)) AS qn FROM el GROUP BY vec_id),
dots AS (SELECT el.vec_id, kbv.label AS kl, kbv.f, sum(el.x * kbv.val) AS d
         FROM el JOIN kbv ON el.pos = kbv.pos GROUP BY el.vec_id, kbv.label, kbv.f),
cosf AS (SELECT dots.vec_id, dots.kl, dots.f,
                CASE WHEN qn.qn > 0 AND kbn.kn > 0 THEN d / (qn.qn * kbn.kn) ELSE 0.0 END AS cos
         FROM dots JOIN qn USING (vec_id) JOIN kbn ON kbn.label = dots.kl AND kbn.f = dots.f),
labs AS (SELECT DISTINCT label FROM e),
kbrow AS (SELECT label, printf('%02d-%04d.00', 11 + 2 * label, 1000 + label) AS code,
                 list_element({WCAP}, (label % 10) + 1) || ' and ' || list_element({WCAP}, ((label + 1) % 10) + 1) || ' Workers' AS title
          FROM labs),
q AS (SELECT vec_id, label,
             list_element({WCAP}, ((label + vec_id % 3) % 10) + 1) || ' Supervisors' AS occupation,
             'vector ' || CAST(vec_id AS VARCHAR) AS description,
             CASE WHEN vec_id % 13 = 0 THEN '' ELSE printf('%02d-%04d.00', 11 + 2 * label, 1000 + label) END AS onet_soc,
             list_element({WCAP}, (label % 10) + 1) || ' and ' || list_element({WCAP}, ((label + 1) % 10) + 1) || ' Workers' AS onet_title
      FROM e)"""


def _raw_scores(weights: dict) -> str:
    ws = " ".join(f"WHEN {i} THEN {W(weights, n)}" for i, n in enumerate(WEIGHT_NAMES))
    return f"scores AS (SELECT vec_id, kl, sum(cos * CASE f {ws} END) AS raw FROM cosf GROUP BY vec_id, kl)"


def _overlap(mode: str) -> str:
    if mode == "eval":
        qw = f"SELECT DISTINCT vec_id, unnest({TITLE_WORDS('occupation')}) AS w FROM q"
        kw = f"SELECT DISTINCT label AS kl, unnest({TITLE_WORDS('title')}) AS w FROM kbrow"
    else:
        qw = f"SELECT DISTINCT vec_id, unnest(list_distinct({TOK('occupation')})) AS w FROM q"
        kw = f"SELECT DISTINCT label AS kl, unnest(list_distinct({TOK('title')})) AS w FROM kbrow"
    return (f"qw AS ({qw}), kw AS ({kw}), "
            "ov AS (SELECT vec_id, kl, count(*) AS ov FROM qw JOIN kw USING (w) GROUP BY vec_id, kl)")


def _ranked(weights: dict, boost: float, mode: str = "eval") -> str:
    parts = [EMB, _raw_scores(weights)]
    if boost:
        parts.append(_overlap(mode))
        final = f"s.raw + {boost!r}::DOUBLE * coalesce(o.ov, 0)"
        join = "LEFT JOIN ov o ON o.vec_id = s.vec_id AND o.kl = s.kl"
    else:
        final, join = "s.raw", ""
    parts.append(f"""fin AS (SELECT s.vec_id, k.code, k.title, s.raw, {final} AS final
                FROM scores s JOIN kbrow k ON k.label = s.kl {join}),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(final, 12) DESC, code) AS rn FROM fin)""")
    return "WITH " + ",\n".join(parts)


def _production() -> str:
    cols = []
    for i in (1, 2, 3):
        cols += [f"max(CASE WHEN rn = {i} THEN code END) AS Match_{i}_SOC_Code",
                 f"max(CASE WHEN rn = {i} THEN title END) AS Match_{i}_Title",
                 f"max(CASE WHEN rn = {i} THEN round(final * 100, 2) END) AS Match_{i}_Score"]
    return _ranked(ENGINE_WEIGHTS, 0.0) + f"\nSELECT vec_id, {', '.join(cols)} FROM rk GROUP BY vec_id"


def _app_cte() -> str:
    cols = ["max(CASE WHEN rn = 1 THEN code END) AS Matched_SOC_Code",
            "max(CASE WHEN rn = 1 THEN title END) AS Matched_Title",
            "max(CASE WHEN rn = 1 THEN round(raw * 100, 1) END) AS \"Confidence_%\""]
    for i in (2, 3):
        cols += [f"max(CASE WHEN rn = {i} THEN code END) AS Top{i}_SOC",
                 f"max(CASE WHEN rn = {i} THEN title END) AS Top{i}_Title",
                 f"max(CASE WHEN rn = {i} THEN round(final * 100, 1) END) AS Top{i}_Confidence"]
    return _ranked(TUNED_WEIGHTS, 0.03, "app") + f",\napp AS (SELECT vec_id, {', '.join(cols)} FROM rk GROUP BY vec_id)"


def _eval_cte() -> str:
    return _ranked(TUNED_WEIGHTS, 0.03, "eval") + """,
top AS (SELECT vec_id,
               max(CASE WHEN rn = 1 THEN code END) AS Machine_SOC_Code,
               max(CASE WHEN rn = 1 THEN title END) AS Machine_Title,
               max(CASE WHEN rn = 1 THEN round(raw * 100, 2) END) AS Machine_Confidence,
               string_agg(code, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS Top_Codes,
               list(code) FILTER (WHERE rn <= 3) AS codes
        FROM rk GROUP BY vec_id),
ev AS (SELECT q.vec_id, q.occupation AS User_Occupation, q.description AS User_Description,
              top.Machine_SOC_Code, top.Machine_Title, top.Machine_Confidence,
              q.onet_soc AS Human_SOC_Code, q.onet_title AS Human_Title,
              CASE WHEN q.onet_soc <> '' THEN CAST(top.Machine_SOC_Code = q.onet_soc AS INTEGER) END AS Correct,
              CASE WHEN q.onet_soc <> '' THEN CAST(list_contains(top.codes, q.onet_soc) AS INTEGER) END AS Correct_Top3
       FROM q JOIN top USING (vec_id))"""


def _hist() -> str:
    return _app_cte() + """,
mm AS (SELECT CASE WHEN min(c) = max(c) THEN min(c) - 0.5 ELSE min(c) END AS lo,
              CASE WHEN min(c) = max(c) THEN max(c) + 0.5 ELSE max(c) END AS hi
       FROM (SELECT CAST("Confidence_%" AS DOUBLE) AS c FROM app)),
st AS (SELECT lo, hi, (hi - lo) / 20.0::DOUBLE AS step FROM mm),
b0 AS (SELECT c, CAST(least(greatest(floor((c - lo) / (hi - lo) * 20.0::DOUBLE), 0), 19) AS INTEGER) AS i0, lo, hi, step
       FROM (SELECT CAST("Confidence_%" AS DOUBLE) AS c FROM app), st),
b1 AS (SELECT CASE WHEN c < CAST(i0 AS DOUBLE) * step + lo THEN i0 - 1
                   WHEN c >= CAST(i0 + 1 AS DOUBLE) * step + lo AND i0 <> 19 THEN i0 + 1 ELSE i0 END AS i FROM b0),
cnt AS (SELECT i, count(*) AS n FROM b1 GROUP BY i),
bins AS (SELECT CAST(range AS INTEGER) AS i FROM range(20))
SELECT bins.i + 1 AS bin, round(CAST(bins.i AS DOUBLE) * step + lo, 6) AS lo,
       round(CASE WHEN bins.i = 19 THEN hi ELSE CAST(bins.i + 1 AS DOUBLE) * step + lo END, 6) AS hi,
       round((CAST(bins.i AS DOUBLE) * step + lo + CASE WHEN bins.i = 19 THEN hi ELSE CAST(bins.i + 1 AS DOUBLE) * step + lo END) / 2, 6) AS mid,
       coalesce(cnt.n, 0) AS count
FROM bins LEFT JOIN cnt USING (i), st"""


WEIGHT_CANDIDATES = (
    (0.25, 0.20, 0.15, 0.25, 0.10, 0.05), tuple(ENGINE_WEIGHTS.values()), tuple(APP_WEIGHTS.values()),
    (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0),
    (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1), (1, 1, 1, 1, 1, 1), (-2, 1, 0, 3, 0.5, 0),
)


def _candidates(rows) -> str:
    """Normalised weights: (candidate, f, w)."""
    out = []
    for c, ws in enumerate(rows):
        tot = sum(abs(float(x)) for x in ws)
        out += [f"({c}, {f}, {abs(float(x)) / tot!r}::DOUBLE)" for f, x in enumerate(ws)]
    return f"cand(candidate, f, w) AS (VALUES {', '.join(out)})"


MIXED = """
cu AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, c_custkey % 3 AS place, c_custkey % 11 = 0 AS wide, c_custkey % 7 = 0 AND c_custkey % 11 <> 0 AS narrow FROM customer),
mixed AS (
  SELECT 'a' AS folder, key, CASE WHEN NOT narrow THEN c_name END AS c_name, CASE WHEN NOT narrow THEN c_mktsegment END AS c_mktsegment, CAST(NULL AS VARCHAR) AS nation,
         CASE WHEN wide THEN concat_ws(chr(9), key, c_name, c_mktsegment, 'extra', 'cells') WHEN narrow THEN key END AS malformed FROM cu WHERE place = 0
  UNION ALL SELECT 'b', key, NULL, c_mktsegment, nation, NULL FROM cu WHERE place = 1
  UNION ALL SELECT 'c', CASE WHEN NOT narrow THEN key END, c_name, NULL, NULL,
         CASE WHEN wide THEN concat_ws(chr(9), c_name, key, 'extra', 'cells') WHEN narrow THEN c_name END FROM cu WHERE place = 2)
"""


def _hits(rows: str, cand: str = "cand", x: str = "") -> str:
    """Top-1 hits of every candidate on ``rows`` (vec_id)."""
    return f"""
sc{x} AS (SELECT cand.candidate, cosf.vec_id, cosf.kl, sum(cand.w * cosf.cos) AS s FROM cosf JOIN {cand} AS cand ON cand.f = cosf.f
       WHERE cosf.vec_id IN (SELECT vec_id FROM {rows}) GROUP BY cand.candidate, cosf.vec_id, cosf.kl),
rk{x} AS (SELECT s.*, kbrow.code, row_number() OVER (PARTITION BY candidate, vec_id ORDER BY round(s, 12) DESC, kbrow.code) AS rn
       FROM sc{x} s JOIN kbrow ON kbrow.label = s.kl),
pred{x} AS (SELECT r.candidate, r.vec_id, r.kl = e.label AS hit
         FROM rk{x} r JOIN e USING (vec_id) WHERE rn = 1),
acc{x} AS (SELECT CAST(candidate AS INTEGER) AS candidate, count(*) FILTER (WHERE hit) AS hits, count(*) AS rows,
               count(*) FILTER (WHERE hit) / count(*) AS accuracy FROM pred{x} GROUP BY candidate)"""


def _line_search(rounds: int, rows: str) -> str:
    """w{rounds}(f, w): weights after that many exact line searches from w0,
    with h0(hits) hits, on ``rows`` (vec_id)."""
    out = f"""
rows_ AS MATERIALIZED (SELECT c.vec_id, c.kl, c.f, c.cos, e.label = c.kl AS self, k.code < own.code AS lower FROM cosf c JOIN e USING (vec_id) JOIN kbrow k ON k.label = c.kl
          JOIN kbrow own ON own.label = e.label WHERE c.vec_id IN (SELECT vec_id FROM {rows}))"""
    for k in range(rounds):
        out += f""",
rest{k} AS (SELECT a.f AS dir, sum(b.w) AS rest FROM w{k} a JOIN w{k} b ON a.f <> b.f GROUP BY a.f HAVING sum(b.w) > 0),
at{k} AS (SELECT dir, vec_id, kl, self, lower, sum(CASE WHEN r.f <> dir THEN cos * w / rest ELSE 0 END) AS s0, sum(CASE WHEN r.f = dir THEN cos ELSE 0 END) AS s1
          FROM rows_ r JOIN w{k} w ON w.f = r.f CROSS JOIN rest{k} GROUP BY ALL),
lead{k} AS (SELECT t.dir, t.vec_id, t.lower, CASE WHEN abs(o.s0 - t.s0) < 5e-13 THEN 0.0::DOUBLE ELSE o.s0 - t.s0 END AS a0,
                   CASE WHEN abs(o.s1 - t.s1) < 5e-13 THEN 0.0::DOUBLE ELSE o.s1 - t.s1 END AS a1
            FROM at{k} t JOIN at{k} o ON o.dir = t.dir AND o.vec_id = t.vec_id AND o.self WHERE NOT t.self),
iv{k} AS (SELECT dir, CAST(floor(max(CASE WHEN a0 < 0 AND a1 > 0 THEN a0 / (a0 - a1) ELSE 0 END) * 1e9 + 0.5) AS BIGINT) AS lo,
                 CAST(floor(min(CASE WHEN a0 > 0 AND a1 < 0 THEN a0 / (a0 - a1) ELSE 1 END) * 1e9 + 0.5) AS BIGINT) AS hi
          FROM lead{k} GROUP BY dir, vec_id
          HAVING NOT bool_or(CASE WHEN a0 = 0 AND a1 = 0 THEN lower ELSE a0 <= 0 AND a1 <= 0 END)),
pt{k} AS (SELECT dir, p, sum(d) AS d FROM (SELECT dir, lo AS p, 1 AS d FROM iv{k} WHERE lo < hi UNION ALL SELECT dir, hi, -1 FROM iv{k} WHERE lo < hi) GROUP BY dir, p),
pc{k} AS (SELECT dir, p, lead(p) OVER (PARTITION BY dir ORDER BY p) - p AS len, sum(d) OVER (PARTITION BY dir ORDER BY p) AS hits FROM pt{k}),
st{k} AS (SELECT dir, (p + len // 2) // 1000 * 1000 / 1e9::DOUBLE AS share, pc{k}.hits AS hits FROM pc{k}, h{k} WHERE len >= 10000 AND pc{k}.hits > h{k}.hits
          ORDER BY pc{k}.hits DESC, len DESC, dir, p LIMIT 1),
h{k + 1} AS (SELECT coalesce((SELECT hits FROM st{k}), (SELECT hits FROM h{k})) AS hits),
w{k + 1} AS MATERIALIZED (SELECT w.f, CASE WHEN st.dir IS NULL THEN w.w WHEN w.f = st.dir THEN st.share ELSE (1 - st.share) * w.w / r.rest END AS w
            FROM w{k} w LEFT JOIN st{k} st ON true LEFT JOIN rest{k} r ON r.dir = st.dir)"""
    return out


def _weight_accuracy() -> str:
    return "WITH " + EMB + "," + _candidates(WEIGHT_CANDIDATES) + "," + _hits("e") + "\nSELECT candidate, hits, rows, round(accuracy, 9) AS accuracy FROM acc"


def _searched(rows: str) -> str:
    """The weights found from the best candidate of acc by three line searches."""
    names = ", ".join(f"({f}, '{n}')" for f, n in enumerate(WEIGHT_NAMES))
    return """
best AS (SELECT candidate, hits FROM acc ORDER BY hits DESC, candidate LIMIT 1),
w0 AS MATERIALIZED (SELECT f, w FROM best JOIN cand USING (candidate)), h0 AS (SELECT hits FROM best),""" + _line_search(3, rows) + f""",
ends AS (SELECT 0 AS candidate, f, w FROM w0 UNION ALL SELECT 1, f, w FROM w3),""" + _hits(rows, "ends", "_end") + f""",
kept AS (SELECT candidate, accuracy FROM acc_end ORDER BY hits DESC, candidate DESC LIMIT 1),
names(f, field) AS (VALUES {names})
SELECT field, round(ends.w, 9) AS weight, round(kept.accuracy, 9) AS accuracy, round((SELECT accuracy FROM acc WHERE candidate = 0), 9) AS baseline_accuracy
FROM kept JOIN ends USING (candidate) JOIN names USING (f)"""


def _weight_search() -> str:
    step = lambda x: (x * HASH_A + HASH_B) % HASH_P
    tried = [SEARCH_BASELINE] + [tuple(step(step((42 + c) * 6 + f)) / HASH_P for f in range(6)) for c in range(300)]
    return "WITH " + EMB + "," + _candidates(tried) + f""",
ord AS (SELECT vec_id, row_number() OVER (ORDER BY {AH('vec_id')}, vec_id) AS rn, count(*) OVER () AS n FROM e),
trn AS (SELECT vec_id, row_number() OVER (ORDER BY {AH('vec_id + 7')}, vec_id) AS rn, count(*) OVER () AS n FROM ord
        WHERE rn <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT)),
part AS (SELECT vec_id FROM trn WHERE rn <= CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)),""" + _hits("part") + "," + _searched("part")



def _neg_pairs(rows_cte: str, codes_cte: str) -> str:
    """Same pick rule as ``labels.hard_negatives``: rows(row_id, code, anchor),
    codes(code, profile)."""
    return f"""
ci AS (SELECT code, left(code, 2) AS grp,
              row_number() OVER (PARTITION BY left(code, 2) ORDER BY code) - 1 AS gidx,
              count(*) OVER (PARTITION BY left(code, 2)) AS gsize,
              row_number() OVER (ORDER BY code) - 1 AS aidx, count(*) OVER () AS asize
       FROM (SELECT DISTINCT code FROM {codes_cte})),
rr AS (SELECT r.row_id, r.code, r.anchor, ci.grp, ci.gidx, ci.gsize, ci.aidx, ci.asize, {AH('r.row_id')} AS h
       FROM {rows_cte} r JOIN ci USING (code)),
pk AS (SELECT *, CASE WHEN gsize > 1 THEN (h % (gsize - 1)) + CASE WHEN (h % (gsize - 1)) >= gidx THEN 1 ELSE 0 END
                      ELSE (h % greatest(asize - 1, 1)) + CASE WHEN (h % greatest(asize - 1, 1)) >= aidx THEN 1 ELSE 0 END END AS pick
       FROM rr),
negs AS (SELECT pk.row_id, pk.anchor, coalesce(g.code, a.code) AS neg_code
         FROM pk LEFT JOIN ci g ON pk.gsize > 1 AND g.grp = pk.grp AND g.gidx = pk.pick
                 LEFT JOIN ci a ON pk.gsize <= 1 AND pk.asize > 1 AND a.aidx = pk.pick),
pairs AS (SELECT row_id, anchor AS s1, code AS s2_code, 1.0::DOUBLE AS score FROM rr
          UNION ALL SELECT row_id, anchor, neg_code, 0.0::DOUBLE FROM negs WHERE neg_code IS NOT NULL)"""


def _no_signed_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB rounds a tiny
    negative double to -0.0, Spark's decimal rounding gives 0.0."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        while j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            j = sql.find("round(", j + 6)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _no_signed_zero(sql[j + 6:k])
        out.append(f"{sql[i:j]}(round({inner}) + 0.0)")
        i = k + 1


_SUMMARY = """
SELECT n, top1, top3, round(CASE WHEN n > 0 THEN top1 * 100.0 / n END, 6) AS top1_pct,
       round(CASE WHEN n > 0 THEN top3 * 100.0 / n END, 6) AS top3_pct, top3 - top1 AS top3_gap,
       round(avg_conf, 6) AS avg_conf, round(abs(cc - cw), 6) AS conf_gap, no_code
FROM (SELECT count(*) FILTER (WHERE Correct IS NOT NULL) AS n,
             CAST(coalesce(sum(Correct), 0) AS BIGINT) AS top1, CAST(coalesce(sum(Correct_Top3), 0) AS BIGINT) AS top3,
             avg(Machine_Confidence) FILTER (WHERE Correct IS NOT NULL) AS avg_conf,
             coalesce(avg(Machine_Confidence) FILTER (WHERE Correct = 1), 0) AS cc,
             coalesce(avg(Machine_Confidence) FILTER (WHERE Correct = 0), 0) AS cw,
             count(*) FILTER (WHERE Correct IS NULL) AS no_code FROM ev)"""


def oracle_sql() -> dict[str, str]:
    return {k: _no_signed_zero(v) for k, v in _oracle_sql().items()}


def _oracle_sql() -> dict[str, str]:
    tw = TITLE_WORDS("concat_ws(' ', p_name, p_type, 'Workers of all Supervisors')")
    fields = ("task", "desc", "skill", "ofc_title", "alt_title", "tool")
    sql = {
        "mixed_sources": "WITH " + MIXED + "SELECT * FROM mixed",
        "mixed_counts": "WITH " + MIXED + "SELECT folder, count(*) AS rows, count(malformed) AS malformed FROM mixed GROUP BY folder",
        "scan_prune": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part",
        "scan_fill": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, "
                     "md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS text_len FROM documents",
        "roundtrip_csv": "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS text_md5 FROM conversations",
        "strip_all": f"SELECT conv_id, turn, {STRIP('role')} AS role, md5({STRIP('text')}) AS text_md5, length({STRIP('text')}) AS text_len FROM conversations",
        "preview_limit": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 3",
        "weights_merge": f"""
WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
filew AS (SELECT pos % 6 AS f, avg(abs(v)) AS w FROM x WHERE pos % 6 < 4 GROUP BY 1),
names(f, field, dflt) AS (VALUES {', '.join(f"({i}, '{n}', {float(TUNED_WEIGHTS[n])!r}::DOUBLE)" for i, n in enumerate(WEIGHT_NAMES))})
SELECT field, round(coalesce(filew.w, dflt), 9) AS weight FROM names LEFT JOIN filew USING (f)""",
        "vector_cache": "WITH " + EMB + f""",
nn AS (SELECT label, f, round(kn, 9) AS kn FROM kbn)
SELECT kbrow.code, (SELECT count(*) FROM labs) AS kb_rows,
       {', '.join(f"max(CASE WHEN f = {i} THEN kn END) AS norm_{n}" for i, n in enumerate(fields))}
FROM kbrow JOIN nn USING (label) GROUP BY kbrow.code""",
        "harmonise": "WITH " + SURVEY + "\nSELECT row_id, occupation, description, onet_soc, onet_title FROM survey",
        "union_tagged": """
SELECT s_suppkey AS id, coalesce(s_name, '') AS name, s_nationkey AS nation, s_acctbal AS acctbal, 'Matched' AS Rater_Subset, '' AS segment FROM supplier
UNION ALL
SELECT c_custkey, coalesce(c_name, ''), c_nationkey, c_acctbal, 'Non-Matched', coalesce(c_mktsegment, '') FROM customer""",
        "taxonomy_fix": """
WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE ' Nation_' || CAST(c_nationkey AS VARCHAR) END AS final_title FROM customer)
SELECT c_custkey, final_title,
       CASE final_title WHEN ' Nation_3' THEN ' Nation_13' WHEN ' Nation_24' THEN 'Atlantis' ELSE final_title END AS fixed_title FROM s""",
        "title_code_join": f"""
WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE ' Nation_' || CAST(c_nationkey AS VARCHAR) END AS final_title FROM customer),
f AS (SELECT *, CASE final_title WHEN ' Nation_3' THEN ' Nation_13' WHEN ' Nation_24' THEN 'Atlantis' ELSE final_title END AS fixed FROM s)
SELECT f.c_custkey, f.final_title, n.n_nationkey AS code
FROM f LEFT JOIN nation n ON lower({STRIP('f.fixed')}) = lower({STRIP('n.n_name')})""",
        "unmatched_report": f"""
WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE ' Nation_' || CAST(c_nationkey AS VARCHAR) END AS final_title FROM customer),
f AS (SELECT *, CASE final_title WHEN ' Nation_3' THEN ' Nation_13' WHEN ' Nation_24' THEN 'Atlantis' ELSE final_title END AS fixed FROM s),
j AS (SELECT f.final_title, n.n_nationkey AS code FROM f LEFT JOIN nation n ON lower({STRIP('f.fixed')}) = lower({STRIP('n.n_name')}))
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT (code IS NULL AND final_title IS NOT NULL)) AS matched,
       count(*) FILTER (WHERE code IS NULL AND final_title IS NOT NULL) AS unmatched FROM j""",
        "map_columns": "SELECT conv_id, turn, role AS title, '' AS description FROM conversations",
        "clean_labels": "WITH " + SURVEY + "\nSELECT row_id, occupation, description, onet_soc FROM clean",
        "swap_repair": "WITH " + SURVEY + "\nSELECT row_id, onet_soc, onet_title, CAST(swapped AS INTEGER) AS swapped FROM train_rows",
        "swap_repair_eval": "WITH " + SURVEY + f""",
ev AS (SELECT row_id, CASE WHEN bad THEN onet_title ELSE onet_soc END AS onet_soc,
              CASE WHEN bad THEN onet_soc ELSE onet_title END AS onet_title, CAST(bad AS INTEGER) AS swapped
       FROM (SELECT *, NOT {IS_CODE('onet_soc')} AS bad FROM labels))
SELECT * FROM ev WHERE {IS_CODE('onet_soc')}""",
        "min_words": "WITH " + SURVEY + "\nSELECT row_id, occupation, onet_soc FROM title_only_ok",
        "label_stats": "WITH " + SURVEY + "\nSELECT count(*) AS rows, count(DISTINCT onet_soc) AS codes FROM train_rows",
        "split_exact": "WITH " + SURVEY + "\nSELECT row_id, split FROM split",
        "sample_exact": "WITH " + SURVEY + f""",
tr AS (SELECT row_id FROM split WHERE split = 'train')
SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {AH('row_id + 7')}, row_id) AS rn,
                           count(*) OVER () AS n FROM tr)
WHERE rn <= CAST(round(n * 0.2::DOUBLE) AS BIGINT)""",
        "train_minus_test": "WITH " + SURVEY + """,
tk AS (SELECT DISTINCT occupation, description FROM split WHERE split = 'test')
SELECT l.row_id FROM labels l
WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.occupation = l.occupation AND tk.description = l.description)
  AND l.onet_soc <> ''""",
        "train_union": "WITH " + SURVEY + "\nSELECT source, row_id, occupation, onet_soc FROM train_union",
        "shuffle_order": "WITH " + SURVEY + f"\nSELECT source, row_id, onet_soc, row_number() OVER (ORDER BY {AH('row_id + 42')}, source, row_id) - 1 AS position FROM train_union",
        "task_weight": "WITH " + KB + "\nSELECT code, task_id, task, rating, weight FROM wtasks",
        "task_nest": "WITH " + KB + "\nSELECT code, n_tasks, tasks_text FROM nest",
        "flatten_text": "WITH " + KB + "\nSELECT code, all_alt_titles FROM alt",
        "kb_build": "WITH " + KB + "\nSELECT code, title, description, tasks_text, all_alt_titles, all_tech_skills, all_tools FROM kb",
        "json_roundtrip": """
SELECT event_id, k, CASE WHEN k IS NULL THEN '{}' ELSE CAST(to_json({'k': k}) AS VARCHAR) END AS props_out
FROM (SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
        "profile_text": "WITH " + KB + "\nSELECT code, profile FROM profiles",
        "query_text": "WITH " + SURVEY + f"""
SELECT row_id, occupation || ' ' || description AS text_plain,
       '{QUERY_PREFIX}' || {STRIP("occupation || ' ' || description")} AS text_app FROM survey""",
        "tokens": f"SELECT doc_id, len({TOK('coalesce(text, ' + chr(39) * 2 + ')')}) AS n_tokens, "
                  f"len(list_distinct({TOK('coalesce(text, ' + chr(39) * 2 + ')')})) AS n_distinct, "
                  f"md5(array_to_string({TOK('coalesce(text, ' + chr(39) * 2 + ')')}, ' ')) AS tokens_md5 FROM documents",
        "title_words": f"SELECT p_partkey, array_to_string(list_sort({tw}), ' ') AS words FROM part",
        "train_pairs": "WITH " + SURVEY + "," + KB + f"""
SELECT u.source || ':' || CAST(u.row_id AS VARCHAR) AS pair_key,
       '{QUERY_PREFIX}' || {STRIP("u.occupation || ' ' || u.description")} AS anchor, p.profile AS positive
FROM train_union u JOIN profiles p ON p.code = {STRIP('u.onet_soc')}""",
        "hard_negatives": "WITH " + SURVEY + "," + KB + f""",
hrows AS (SELECT row_id, {STRIP('onet_soc')} AS code, '{QUERY_PREFIX}' || {STRIP("occupation || ' ' || description")} AS anchor
          FROM split WHERE split = 'test' AND {STRIP('onet_soc')} <> ''),
""" + _neg_pairs("hrows", "profiles")[1:] + "\nSELECT row_id, s1, s2_code, score, md5(profile) AS s2_md5 FROM pairs JOIN profiles ON profiles.code = s2_code",
        "weighted_centroid": "WITH " + EMB + "\nSELECT label, pos, round(cw, 9) AS value FROM cent",
        "chunk_mean": "WITH " + EMB + "\nSELECT label, pos, round(c, 9) AS value FROM cent",
        "chunk_text": "WITH " + CHUNKS("SELECT doc_id AS key, text FROM documents") + """
SELECT key AS doc_id, len(chunks) AS n_chunks, CAST(coalesce(list_sum(list_transform(chunks, lambda c: length(c))), 0) AS BIGINT) AS total_len,
       CAST(coalesce(list_max(list_transform(chunks, lambda c: length(c))), 0) AS BIGINT) AS max_len, md5(array_to_string(chunks, chr(10))) AS chunks_md5
FROM chunked""",
        "cosine_fields": "WITH " + EMB + f"""
SELECT cosf.vec_id, {', '.join(f"round(max(CASE WHEN cosf.f = {i} THEN cos END), 6) AS cos_{n}" for i, n in enumerate(fields))}
FROM cosf JOIN e ON e.vec_id = cosf.vec_id AND e.label = cosf.kl GROUP BY cosf.vec_id""",
        "match_topk": _production(),
        "match_topk_blocked": _production(),
        "similarity_join": """
WITH el AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
fn AS (SELECT vec_id, pos % 6 AS f, sqrt(sum(x * x)) AS n FROM el GROUP BY 1, 2),
qn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM el GROUP BY 1),
w AS (SELECT unnest(range(6)) AS f, unnest([0.2017, 0.1021, 0.0063, 0.3941, 0.2898, 0.0061])::DOUBLE AS w),
kb AS (SELECT el.vec_id, el.pos, CASE WHEN fn.n > 0 THEN w.w * el.x / fn.n ELSE 0 END AS x FROM el JOIN fn ON el.vec_id = fn.vec_id AND el.pos % 6 = fn.f JOIN w ON w.f = fn.f WHERE el.vec_id % 5 <> 0),
q AS (SELECT el.vec_id, el.pos, CASE WHEN n > 0 THEN el.x / n ELSE 0 END AS x FROM el JOIN qn ON el.vec_id = qn.vec_id WHERE el.vec_id % 5 = 0),
s AS (SELECT q.vec_id, kb.vec_id AS kb_id, sum(q.x * kb.x) AS s FROM q JOIN kb USING (pos) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, kb_id) AS rn FROM s)
SELECT vec_id, CAST(rn AS INTEGER) AS rank, lpad(CAST(kb_id AS VARCHAR), 12, '0') AS code, round(s, 6) AS score FROM rk WHERE rn <= 3""",
        "match_topk_boosted": _eval_cte() + "\nSELECT vec_id, Machine_SOC_Code, Machine_Title, Machine_Confidence, Top_Codes FROM top",
        "match_topk_app": _app_cte() + "\nSELECT * FROM app",
        "eval_rows": _eval_cte() + "\nSELECT * FROM ev",
        "eval_summary": _eval_cte() + _SUMMARY,
        "pair_correlation": "WITH " + EMB + f""",
prow AS (SELECT vec_id AS row_id, onet_soc AS code, {STRIP("occupation || ' ' || description")} AS anchor FROM q WHERE onet_soc <> ''),
pcodes AS (SELECT code FROM kbrow),
""" + _neg_pairs("prow", "pcodes")[1:] + """,
cn AS (SELECT label, sqrt(sum(c * c)) AS n FROM cent GROUP BY label),
dc AS (SELECT el.vec_id, cent.label, sum(el.x * cent.c) AS d FROM el JOIN cent ON el.pos = cent.pos GROUP BY 1, 2),
pc AS (SELECT round(CASE WHEN qn.qn > 0 AND cn.n > 0 THEN dc.d / (qn.qn * cn.n) ELSE 0.0 END, 9) AS x, pairs.score AS y
       FROM pairs JOIN kbrow ON kbrow.code = pairs.s2_code
                  JOIN dc ON dc.vec_id = pairs.row_id AND dc.label = kbrow.label
                  JOIN qn ON qn.vec_id = pairs.row_id JOIN cn ON cn.label = kbrow.label),
rk AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pc)
SELECT round(corr(x, y), 9) AS cosine_pearson, round(corr(rx, ry), 9) AS cosine_spearman, count(*) AS pairs FROM rk""",
        "weight_accuracy": _weight_accuracy(),
        "weight_search": _weight_search(),
        **_text_queries(),
        "report": _report(),
        "cleaning_report": _cleaning(),
        "user_input": "SELECT s_suppkey AS User_ID, ' ' || s_name AS User_Job_Title, "
                      "CASE WHEN s_suppkey % 3 <> 0 THEN 'sells, \"for\" ' || CAST(s_nationkey AS VARCHAR) ELSE '' END AS User_Job_Description FROM supplier",
        "sheet_scan": "SELECT n_nationkey::BIGINT AS key, n_name AS name, 'Matched' AS sheet FROM nation "
                      "UNION ALL SELECT r_regionkey::BIGINT, r_name, 'Non-Matched' FROM region",
        "file_dispatch": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, f AS format FROM customer, (VALUES ('csv'), ('tsv'), ('jsonl'), ('parquet')) t(f)",
        "bm25_index": _bm25() + "\nSELECT item_id, token, tf, round(idf, 9) AS idf, round(weight, 9) AS weight FROM post",
        "bm25_scores": _bm25() + f""",
qt AS (SELECT doc_id, unnest({TOK("coalesce(text, '')")}) AS token FROM documents),
qc AS (SELECT doc_id, token, count(*) AS c FROM qt GROUP BY 1, 2),
s AS (SELECT qc.doc_id, post.code, sum(qc.c * post.weight) AS s FROM qc JOIN post USING (token) GROUP BY 1, 2),
grid AS (SELECT d.doc_id, b.code, coalesce(s.s, 0.0) AS s FROM documents d CROSS JOIN bc b LEFT JOIN s ON s.doc_id = d.doc_id AND s.code = b.code),
nm AS (SELECT doc_id, code, CASE WHEN max(s) OVER (PARTITION BY doc_id) > 0 THEN s / max(s) OVER (PARTITION BY doc_id) ELSE s END AS s FROM grid),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 12) DESC, code) AS rn FROM nm)
SELECT doc_id, CAST(rn AS INTEGER) AS rank, CAST(code AS BIGINT) AS item_id, round(s, 6) AS score FROM rk WHERE rn <= 3""",
        "title_overlap": f"""
WITH dw AS (SELECT doc_id, unnest({TITLE_WORDS('text')}) AS w FROM documents),
bw AS (SELECT item_id, unnest({TITLE_WORDS('text')}) AS w FROM benchmark),
ov AS (SELECT doc_id, item_id, count(*) AS overlap FROM dw JOIN bw USING (w) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS rn FROM ov)
SELECT doc_id, CAST(rn AS INTEGER) AS rank, item_id, overlap FROM rk WHERE rn <= 3""",
        "major_group": _app_cte() + f"""
SELECT vec_id, Matched_SOC_Code, {MAJOR('Matched_SOC_Code')} AS Major_Group,
       CASE WHEN "Confidence_%" >= 65 THEN 'High' WHEN "Confidence_%" >= 50 THEN 'Moderate' ELSE 'Low' END AS Tier,
       CASE WHEN "Confidence_%" >= 72 THEN 'conf-high' WHEN "Confidence_%" >= 58 THEN 'conf-mid' ELSE 'conf-low' END AS Colour
FROM app""",
        "confidence_tier": _app_cte() + """
SELECT count(*) AS rows, count(*) FILTER (WHERE "Confidence_%" >= 65) AS high,
       count(*) FILTER (WHERE "Confidence_%" >= 50 AND "Confidence_%" < 65) AS moderate,
       count(*) FILTER (WHERE "Confidence_%" < 50) AS low, round(avg("Confidence_%"), 6) AS avg_conf FROM app""",
        "top_occupations": _app_cte() + """
SELECT Matched_Title AS Occupation, count(*) AS Count,
       left(Matched_Title, 35) || CASE WHEN length(Matched_Title) > 35 THEN '…' ELSE '' END AS Short
FROM app GROUP BY Matched_Title ORDER BY Count DESC, Occupation LIMIT 10""",
        "group_confidence": _app_cte() + f"""
SELECT {MAJOR('Matched_SOC_Code')} AS Major_Group, round(avg("Confidence_%"), 6) AS Avg_Conf, count(*) AS Count
FROM app GROUP BY 1""",
        "conf_histogram": _hist(),
    }
    return sql


def _bm25(corpus: str | None = None) -> str:
    corpus = corpus or f"WITH bc AS (SELECT lpad(CAST(item_id AS VARCHAR), 12, '0') AS code, item_id, {TOK('coalesce(text, ' + chr(39) * 2 + ')')} AS toks FROM benchmark)"
    return corpus + f""",
dl AS (SELECT code, item_id, len(toks) AS dl FROM bc),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS (SELECT code, item_id, token, count(*) AS tf FROM (SELECT code, item_id, unnest(toks) AS token FROM bc) GROUP BY 1, 2, 3),
nt AS (SELECT token, count(*) AS n FROM tf GROUP BY token),
bidf0 AS (SELECT token, n, ln(CAST(n_docs - n + 0.5 AS DOUBLE) / CAST(n + 0.5 AS DOUBLE)) AS raw_idf FROM nt, stats),
mi AS (SELECT avg(raw_idf) AS mean_idf FROM bidf0),
bidf AS (SELECT token, n, CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * mean_idf ELSE raw_idf END AS idf FROM bidf0, mi),
post AS (SELECT tf.item_id, tf.code, tf.token, tf.tf, dl.dl, bidf.idf,
                bidf.idf * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / stats.avgdl)) AS weight
         FROM tf JOIN dl USING (code) JOIN bidf USING (token), stats)"""


def CHUNKS(source: str) -> str:
    """chunked(key, chunks): greedy chunks of 800 characters of (key, text)."""
    letter = "[\\p{L}_]"
    mark = f"regexp_replace(flat, '({letter}{letter}-)({letter}-?{letter})', '\\1\x01\\2', 'g')"
    return f"""
ctext AS (SELECT key, trim(regexp_replace(coalesce(text, ''), '[\\x09-\\x0d ]+', ' ', 'g')) AS flat FROM ({source})),
cpieces AS (SELECT key, list_filter(string_split(replace({mark}, ' ', '\x01 '), '\x01'), lambda p: p <> '') AS ps FROM ctext),
cfold AS (SELECT key, CASE WHEN len(ps) = 0 THEN NULL ELSE
    list_reduce(list_transform(ps, lambda p: {{'done': '', 'cur': p}}),
                lambda a, b: CASE WHEN length(a.cur) + length(b.cur) <= 800 THEN {{'done': a.done, 'cur': a.cur || b.cur}}
                                  ELSE {{'done': a.done || a.cur || '\x01', 'cur': ltrim(b.cur)}} END) END AS f FROM cpieces),
chunked AS (SELECT key, CASE WHEN f IS NULL THEN []::VARCHAR[] ELSE string_split(f.done || f.cur, '\x01') END AS chunks FROM cfold)"""


# ---------------------------------------------------------------------------
# Hashed TF-IDF vectors, and the three matchers on text
# ---------------------------------------------------------------------------

def IDF(source: str, name: str = "idf") -> str:
    """idf(pos, w) over the rows (key, text) of ``source``."""
    return f"""
{name}_rows AS (SELECT key, {TOK("coalesce(text, '')")} AS toks FROM ({source})),
{name}_df AS (SELECT pos, count(DISTINCT key) AS df FROM (SELECT key, {SLOT('unnest(toks)')} AS pos FROM {name}_rows) GROUP BY pos),
{name} AS (SELECT pos, ln((SELECT count(*) + 1.0::DOUBLE FROM {name}_rows) / (df + 1.0::DOUBLE)) AS w FROM {name}_df),
{name}_none AS (SELECT ln((SELECT count(*) + 1.0::DOUBLE FROM {name}_rows)) AS w)"""


def SLOT(t: str) -> str:
    return f"CAST(CAST('0x' || left(md5({t}), 8) AS UBIGINT) % 384 AS INTEGER)"


def ENCODE(source: str, name: str, idf: str = "idf") -> str:
    """name(key, pos, v): unit TF-IDF vectors of (key, text), non-zero elements."""
    return f"""
{name}_tf AS (SELECT key, pos, count(*) AS tf FROM (SELECT key, {SLOT('unnest(toks)')} AS pos FROM (SELECT key, {TOK("coalesce(text, '')")} AS toks FROM ({source}))) GROUP BY key, pos),
{name}_raw AS (SELECT key, t.pos, tf * coalesce(i.w, (SELECT w FROM {idf}_none)) AS v FROM {name}_tf t LEFT JOIN {idf} i ON i.pos = t.pos),
{name} AS (SELECT key, pos, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS v FROM {name}_raw
           QUALIFY sum(v * v) OVER (PARTITION BY key) > 0)"""


TAX = """
tc AS (SELECT c_custkey, n_name, lower(c_mktsegment) AS segment,
         printf('%02d-%04d.00', 11 + 2 * (c_nationkey % 23), c_nationkey * 100 + coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment), 0)) AS code
       FROM customer JOIN nation ON c_nationkey = n_nationkey),
txo AS (SELECT * FROM orders JOIN tc ON o_custkey = c_custkey),
tocc AS (SELECT DISTINCT code, upper(left(segment, 1)) || substr(segment, 2) || ' Buyers of ' || n_name AS title,
           'Buys ' || segment || ' goods for customers in ' || lower(n_name) AS description FROM tc),
ttask AS (SELECT code, 'handle ' || lower(o_orderpriority) || ' orders' AS task, round((round(1 + 4 * avg(CAST(o_orderstatus = 'F' AS INTEGER)), 2) - 1.0) / 4.0, 2) AS weight
          FROM txo GROUP BY code, o_orderpriority),
talt AS (SELECT code, string_agg(text, ' | ' ORDER BY y) AS all_alt_titles
         FROM (SELECT DISTINCT code, year(o_orderdate) AS y, segment || ' procurement specialist ' || CAST(year(o_orderdate) AS VARCHAR) AS text FROM txo) GROUP BY code),
tskill AS (SELECT code, string_agg(text, ' | ' ORDER BY seq) AS all_tech_skills
           FROM (SELECT DISTINCT code, o_orderstatus || o_orderpriority AS seq, 'tracks ' || segment || ' orders of status ' || o_orderstatus || ' and priority ' || o_orderpriority || ' for ' || n_name AS text FROM txo) GROUP BY code),
tkb AS (SELECT tocc.code, title, description, coalesce(all_alt_titles, '') AS all_alt_titles, coalesce(all_tech_skills, '') AS all_tech_skills
        FROM tocc LEFT JOIN talt USING (code) LEFT JOIN tskill USING (code)),
tsv AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Specialist' ELSE '  ' || upper(left(segment, 1)) || substr(segment, 2) || ' buyer ' END AS occupation,
          CASE WHEN o_orderkey % 9 <> 0 THEN 'I handle ' || lower(o_orderpriority) || ' orders of ' || lower(n_name) || ' in status ' || o_orderstatus ELSE '' END AS description,
          CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE code END AS onet_soc FROM txo)"""

_FIELD_ROWS = {"desc": "description", "skill": "all_tech_skills", "ofc_title": "title", "alt_title": "all_alt_titles"}


def _tax_vectors(mode: str) -> str:
    """kv(code, field, pos, v): the six field vectors."""
    fields = dict(_FIELD_ROWS, **({"task": "title"} if mode == "whole" else {}))
    rows = " UNION ALL ".join(f"SELECT code || '\x02{f}' AS key, {c} AS text FROM tkb" for f, c in fields.items())
    idf = IDF("SELECT code AS key, concat_ws(' ', title, description, all_alt_titles, all_tech_skills) AS text FROM tkb")
    head = TAX + "," + idf + ","
    if mode == "whole":
        return head + ENCODE(rows, "kf") + """,
kv AS (SELECT split_part(key, '\x02', 1) AS code, split_part(key, '\x02', 2) AS field, pos, v FROM kf)"""
    return head + CHUNKS(rows) + """,
crow AS (SELECT key, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS i FROM chunked),
cn AS (SELECT key, len(chunks) AS n FROM chunked),""" + ENCODE("SELECT key || '\x03' || CAST(i AS VARCHAR) AS key, text FROM crow", "kc") + """,
tks AS (SELECT code, task, weight, sum(weight) OVER (PARTITION BY code) AS total FROM ttask),""" + ENCODE("SELECT code || '\x02' || task AS key, task AS text FROM tks", "kt") + """,
kv AS (SELECT split_part(cn.key, '\x02', 1) AS code, split_part(cn.key, '\x02', 2) AS field, pos, sum(v) / max(n) AS v
       FROM kc JOIN cn ON cn.key = split_part(kc.key, '\x03', 1) GROUP BY cn.key, pos
       UNION ALL SELECT tks.code, 'task', pos, sum(v * weight) / max(total) FROM kt JOIN tks ON kt.key = tks.code || '\x02' || tks.task
       WHERE total <> 0 GROUP BY tks.code, pos)"""


def _text_ranked(mode: str, weights: dict, query: str, boost: str | None = None, bm25: float = 0.0) -> str:
    """rk(query_id, code, title, raw, final, rn)."""
    names = ("task", "desc", "skill", "ofc_title", "alt_title", "tool")
    ws = " ".join(f"WHEN '{n}' THEN {W(weights, x)}" for n, x in zip(names, WEIGHT_NAMES))
    out = "WITH " + _tax_vectors(mode) + "," + ENCODE(f"SELECT query_id AS key, {query} AS text FROM tsv", "qv") + f""",
kn AS (SELECT code, field, sqrt(sum(v * v)) AS n FROM kv GROUP BY code, field),
fused AS (SELECT code, pos, sum(CASE field {ws} END * v / n) AS v FROM kv JOIN kn USING (code, field) WHERE n > 0 GROUP BY code, pos),
dense AS (SELECT key AS query_id, code, sum(qv.v * fused.v) AS raw FROM qv JOIN fused USING (pos) GROUP BY key, code),
grid AS (SELECT query_id, occupation, code, title, coalesce(raw, 0.0) AS raw FROM tsv CROSS JOIN (SELECT code AS code, title FROM tkb) k LEFT JOIN dense USING (query_id, code))"""
    final = "raw"
    join = ""
    if bm25:
        toks = TOK("concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in ("title", "all_alt_titles", "description")) + ")")
        qt = TOK(query)
        out += "," + _bm25(f"bc AS (SELECT code, code AS item_id, {toks} AS toks FROM tkb)") + f""",
qt AS (SELECT query_id, token, count(*) AS c FROM (SELECT query_id, unnest({qt}) AS token FROM tsv) GROUP BY 1, 2),
bs AS (SELECT query_id, post.code, sum(qt.c * post.weight) AS s FROM qt JOIN post USING (token) GROUP BY 1, 2),
bg AS (SELECT grid.query_id, grid.code, coalesce(bs.s, 0.0) AS s FROM grid LEFT JOIN bs USING (query_id, code)),
bm AS (SELECT query_id, code, CASE WHEN max(s) OVER (PARTITION BY query_id) > 0 THEN s / max(s) OVER (PARTITION BY query_id) ELSE s END AS s FROM bg)"""
        final += f" + {bm25!r}::DOUBLE * bm.s"
        join += " JOIN bm USING (query_id, code)"
    if boost:
        words = TITLE_WORDS if boost == "stemmed" else (lambda x: f"list_distinct({TOK(x)})")
        out += f""",
qw AS (SELECT DISTINCT query_id, unnest({words('occupation')}) AS w FROM tsv), kw AS (SELECT DISTINCT code, unnest({words('title')}) AS w FROM tkb),
ov AS (SELECT query_id, code, count(*) AS ov FROM qw JOIN kw USING (w) GROUP BY 1, 2)"""
        final += " + 0.03::DOUBLE * coalesce(ov.ov, 0)"
        join += " LEFT JOIN ov USING (query_id, code)"
    return out + f""",
fin AS (SELECT query_id, code, title, raw, {final} AS final FROM grid{join}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 12) DESC, code) AS rn FROM fin)"""


def _pick(i: int, expr: str, name: str) -> str:
    return f"max(CASE WHEN rn = {i} THEN {expr} END) AS \"{name}\""


def _text_search() -> str:
    """Line search on the raters' rows: the same CTE names as on embeddings, a
    code standing for its label."""
    fields = ", ".join(f"({f}, '{n}')" for f, n in enumerate(("task", "desc", "skill", "ofc_title", "alt_title", "tool")))
    return "WITH " + _tax_vectors("chunk") + f""",
rt AS (SELECT query_id, {STRIP('occupation')} AS occupation, concat_ws(' ', nullif(description, ''), 'ref ' || CAST(query_id AS VARCHAR)) AS description, onet_soc FROM tsv),
cd AS (SELECT query_id, occupation, description, row_number() OVER (ORDER BY {AH('query_id')}, query_id) AS rn, count(*) OVER () AS n FROM rt
       WHERE query_id % 3 <> 0 AND onet_soc <> ''),
ts AS (SELECT DISTINCT occupation, description FROM cd WHERE rn > CAST(floor(n * 0.8::DOUBLE) AS BIGINT)),
tr AS (SELECT rt.*, row_number() OVER (ORDER BY {AH('query_id + 7')}, query_id) AS rn, count(*) OVER () AS n
       FROM rt ANTI JOIN ts USING (occupation, description) WHERE onet_soc <> ''),
e AS MATERIALIZED (SELECT query_id AS vec_id, onet_soc AS label, occupation || ' ' || description AS text FROM tr WHERE rn <= CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)),
""" + ENCODE("SELECT vec_id AS key, text FROM e", "qv").lstrip() + f""",
fi(f, field) AS (VALUES {fields}), kbrow AS (SELECT code AS label, code FROM tkb),
kn AS (SELECT code, field, sqrt(sum(v * v)) AS n FROM kv GROUP BY code, field),
near AS (SELECT qv.key AS vec_id, kv.code AS kl, fi.f, sum(qv.v * kv.v / kn.n) AS cos FROM qv JOIN kv USING (pos) JOIN kn USING (code, field) JOIN fi USING (field) WHERE kn.n > 0 GROUP BY ALL),
cosf AS MATERIALIZED (SELECT g.vec_id, g.kl, g.f, coalesce(near.cos, 0.0) AS cos
        FROM (SELECT vec_id, label AS kl, f FROM (SELECT vec_id FROM e) CROSS JOIN kbrow CROSS JOIN fi) g LEFT JOIN near USING (vec_id, kl, f)),
""" + _candidates([SEARCH_BASELINE]) + "," + _hits("e") + "," + _searched("e")


def _text_queries() -> dict[str, str]:
    plain = "occupation || ' ' || description"
    production = ", ".join(_pick(i, e, f"Match_{i}_{n}") for i in (1, 2, 3) for n, e in (("SOC_Code", "code"), ("Title", "title"), ("Score", "round(final * 100, 2)")))
    app = ", ".join([_pick(1, "code", "Matched_SOC_Code"), _pick(1, "title", "Matched_Title"), _pick(1, "round(raw * 100, 1)", "Confidence_%")]
                    + [_pick(i, e, f"Top{i}_{n}") for i in (2, 3) for n, e in (("SOC", "code"), ("Title", "title"), ("Confidence", "round(final * 100, 1)"))])
    hybrid = _text_ranked("chunk", TUNED_WEIGHTS, plain, "stemmed", 0.2) + f""",
top AS (SELECT query_id, {_pick(1, 'code', 'Machine_SOC_Code')}, {_pick(1, 'title', 'Machine_Title')}, {_pick(1, 'round(raw * 100, 2)', 'Machine_Confidence')},
               list(code) FILTER (WHERE rn <= 3) AS codes FROM rk GROUP BY query_id),
ev AS (SELECT query_id, Machine_SOC_Code, Machine_Title, Machine_Confidence, onet_soc AS Human_SOC_Code,
              CASE WHEN onet_soc <> '' THEN CAST(Machine_SOC_Code = onet_soc AS INTEGER) END AS Correct,
              CASE WHEN onet_soc <> '' THEN CAST(list_contains(codes, onet_soc) AS INTEGER) END AS Correct_Top3 FROM top JOIN tsv USING (query_id))"""
    elements = "\nSELECT code, field, pos, round(v, 6) AS value FROM kv WHERE v <> 0"
    docs = "SELECT doc_id AS key, text FROM documents"
    blank = "SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 7 = 1 THEN NULL ELSE text END AS text FROM documents"
    lookup = _text_ranked("chunk", ENGINE_WEIGHTS, "'Furniture buyer orders of nation_7 by customers'").replace(
        "tsv AS (SELECT o_orderkey AS query_id", "tsv AS (SELECT 0 AS query_id, '' AS occupation), tsv0 AS (SELECT o_orderkey AS query_id")
    return {
        "encode_hash": "WITH " + IDF(docs) + "," + ENCODE(docs, "dv") + "\nSELECT key AS doc_id, pos, round(v, 6) AS value FROM dv",
        "encode_batch": f"""WITH tk AS (SELECT doc_id, unnest({TOK("coalesce(text, '')")}) AS tok FROM documents),
sl AS (SELECT doc_id, CAST('0x' || left(md5(tok), 8) AS UBIGINT)::BIGINT % 4096 AS slot, count(*) AS n FROM tk GROUP BY ALL),
dims AS (SELECT unnest(range(16))::INTEGER AS pos),
mean AS (SELECT doc_id, pos, sum(n * ((slot * 31 + pos * 17) % 101 - 50)) / 50.0::DOUBLE / sum(n) AS m FROM sl CROSS JOIN dims GROUP BY ALL)
SELECT doc_id, pos, round(coalesce(m / sqrt(1 + m * m), 0.0), 9) AS value FROM documents CROSS JOIN dims LEFT JOIN mean USING (doc_id, pos)""",
        "blank_chunks": "WITH " + IDF(docs) + "," + CHUNKS(blank) + """,
crow AS (SELECT key, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS i FROM chunked),
cn AS (SELECT key, len(chunks) AS n FROM chunked),""" + ENCODE("SELECT CAST(key AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS key, text FROM crow", "kc") + """,
mean AS (SELECT cn.key, pos, sum(v) / max(n) AS v FROM kc JOIN cn ON CAST(cn.key AS VARCHAR) = split_part(kc.key, ':', 1) GROUP BY cn.key, pos),
nr AS (SELECT key, sqrt(sum(v * v)) AS n FROM mean GROUP BY key)
SELECT doc_id, 384 AS dims, round(coalesce(n, 0.0), 6) AS norm FROM documents LEFT JOIN nr ON nr.key = doc_id""",
        "kb_vectors": "WITH " + _tax_vectors("whole") + elements,
        "kb_vectors_chunked": "WITH " + _tax_vectors("chunk") + elements,
        "text_match_production": _text_ranked("chunk", ENGINE_WEIGHTS, plain) + f"\nSELECT query_id, {production} FROM rk GROUP BY query_id",
        "text_match_app": _text_ranked("whole", TUNED_WEIGHTS, f"'{QUERY_PREFIX}' || {STRIP(plain)}", "raw") + f"\nSELECT query_id, {app} FROM rk GROUP BY query_id",
        "weight_search_text": _text_search(),
        "text_match_eval": hybrid + "\nSELECT * FROM ev",
        "text_eval_summary": hybrid + _SUMMARY,
        "single_lookup": lookup + "\nSELECT CAST(rn AS INTEGER) AS rank, code, title, round(final, 6) AS score FROM rk WHERE rn <= 10",
    }


def _report() -> str:
    body = _hist()
    head, bins = body[:body.index("SELECT bins.i + 1 AS bin")], body[body.index("SELECT bins.i + 1 AS bin"):]
    return head.rstrip() + f""",
hist AS ({bins}),
parts AS (SELECT *, {MAJOR('Matched_SOC_Code')} AS grp,
            CASE WHEN "Confidence_%" >= 65 THEN 'High' WHEN "Confidence_%" >= 50 THEN 'Moderate' ELSE 'Low' END AS tier FROM app),
tops AS (SELECT Matched_Title AS t, count(*) AS n FROM app GROUP BY 1 ORDER BY n DESC, t LIMIT 10)
SELECT 'summary' AS section, 'rows' AS item, count(*) AS n, round(avg("Confidence_%"), 6) AS value FROM app
UNION ALL SELECT 'tier', tier, count(*), NULL FROM parts GROUP BY tier
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), count, mid FROM hist
UNION ALL SELECT 'occupation', left(t, 35) || CASE WHEN length(t) > 35 THEN '…' ELSE '' END, n, NULL FROM tops
UNION ALL SELECT 'group', grp, count(*), round(avg("Confidence_%"), 6) FROM parts GROUP BY grp"""


def _cleaning() -> str:
    full = "occupation <> '' AND description <> '' AND onet_soc <> ''"
    ok = f"({IS_CODE('onet_soc')} OR {IS_CODE('onet_title')})"
    fixed = f"(NOT {IS_CODE('onet_soc')} AND {IS_CODE('onet_title')})"
    long = f"(len({WORDS('occupation')}) >= 2)"
    row = lambda step, src, base, keep, rep="0": (
        f"SELECT '{step}' AS step, count(*) FILTER (WHERE {base} AND {keep}) AS kept, count(*) FILTER (WHERE {base} AND NOT ({keep})) AS dropped, "
        f"{rep} AS repaired FROM {src}")
    return "WITH " + SURVEY + "," + KB + "\n" + "\nUNION ALL ".join([
        row("clean_labels", "labels", "true", full, "0::BIGINT"),
        row("swap_repair", "labels", full, ok, f"count(*) FILTER (WHERE {full} AND {fixed})"),
        row("title_only_blank", "title_only", "true", "occupation <> '' AND onet_soc <> ''"),
        row("min_words", "title_only", "occupation <> '' AND onet_soc <> ''", long),
        row("valid_codes", "title_only", f"occupation <> '' AND onet_soc <> '' AND {long}", IS_CODE("onet_soc")),
        "SELECT 'train_minus_test', count(*) FILTER (WHERE t.occupation IS NULL), count(t.occupation), 0 FROM labels l "
        "LEFT JOIN (SELECT DISTINCT occupation, description FROM split WHERE split = 'test') t ON t.occupation = l.occupation AND t.description = l.description",
        "SELECT 'train_pairs', count(p.code), count(*) - count(p.code), 0 FROM train_union u LEFT JOIN profiles p ON p.code = u.onet_soc"])
