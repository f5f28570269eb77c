"""Queries: encoders, glossary, page types and grids, over wiki pages and source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import encode as E
from cairn.plans import views as V
from cairn.sources.tables import table


def _plain(spark, d):
    return V.pages(spark, d).select("path", T.strip_front_matter("body").alias("plain"))


def _typed(spark, d):
    cited = table(spark, d, "citations").groupBy(F.col("source_file").alias("path")).agg(F.collect_set("repo_path").alias("cited"))
    return _plain(spark, d).join(cited, "path", "left").select("path", "plain", E.page_type(F.col("plain"), F.col("cited")).alias("page_type"))


def encode_caveman(spark, d):
    return _plain(spark, d).select("path", E.caveman(F.col("plain")).alias("encoded"))


def encode_card(spark, d):
    return E.card(V.files(spark, d), "path", "content")


def encode_tuple(spark, d):
    return E.dense_tuple(V.files(spark, d), "path", "content")


def glossary_fit(spark, d):
    return E.fit_glossary(_plain(spark, d), "plain")


def glossary_encode(spark, d):
    return E.run_pipeline(_plain(spark, d), "path", "plain", "glossary")


def page_type(spark, d):
    return _typed(spark, d).select("path", "page_type")


def encode_by_type(spark, d):
    """Each page through the pipeline of its type; a type with an unknown one is left as it is."""
    return E.encode_by_type(_typed(spark, d), "path", "plain", "page_type", {"narrative": "caveman", "function": "structural-card", "entity": "no-such-encoder"})


def encoding_grid(spark, d):
    return E.grid(_plain(spark, d), "path", "plain")


def encoding_grid_by_type(spark, d):
    """The best of all pipelines under the cap, per page type."""
    return E.best_under_cap(E.grid(_typed(spark, d), "path", "plain", ["page_type"]), ["page_type"])


def queries():
    return {f.__name__: f for f in (encode_caveman, encode_card, encode_tuple, glossary_fit, glossary_encode, page_type, encode_by_type, encoding_grid, encoding_grid_by_type)}


_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PLAIN = f"{V.PAGES}, pl AS (SELECT path, regexp_replace(body, '^---\\n(.|\\n)*?\\n---\\n', '') AS plain FROM pages)"


def _caveman(x: str) -> str:
    for phrase, to in E.PHRASES:
        x = f"regexp_replace({x}, '\\b{phrase}\\b', '{to}', 'gi')"
    return x


def _cave_cte(src: str, col: str, key: str, out: str) -> str:
    tok = "\\b[A-Za-z][A-Za-z0-9_''-]*\\b"
    drop = ",".join(f"'{w}'" for w in E.DROPPED)
    return f"""{out}_a AS (SELECT *, {_caveman(col)} AS c_ FROM {src}), {out}_b AS (SELECT *, regexp_split_to_array(c_, '{tok}') AS g_, regexp_extract_all(c_, '{tok}') AS t_ FROM {out}_a),
{out}_c AS (SELECT *, array_to_string(list_transform(range(1, len(g_) + 1), lambda i: g_[i] || CASE WHEN t_[i] IS NULL OR lower(t_[i]) IN ({drop}) THEN '' ELSE t_[i] END), '') AS j_ FROM {out}_b),
{out} AS (SELECT * EXCLUDE (c_, g_, t_, j_), regexp_replace(regexp_replace(regexp_replace(j_, '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS encoded FROM {out}_c)"""


def _fit(src: str, col: str, out: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""{out} AS (SELECT {cols}token, n, 'g' || (row_number() OVER ({part}ORDER BY n * strlen(token) DESC, token) - 1) AS code FROM
 (SELECT {cols}token, count(*) AS n FROM (SELECT {cols}unnest(regexp_extract_all({col}, '[A-Za-z0-9_]+')) AS token FROM {src}) WHERE regexp_matches(token, '^[A-Za-z_]') AND strlen(token) >= 8 GROUP BY ALL HAVING count(*) >= 8)
 QUALIFY row_number() OVER ({part}ORDER BY n * strlen(token) DESC, token) <= 256)"""


def _apply(src: str, col: str, fit: str, out: str, by: str = "") -> str:
    g, where = (f", {by}", f"LEFT JOIN m_{out} USING ({by})") if by else ("", f", m_{out}")
    return f"""m_{out} AS (SELECT map_from_entries(list((token, code))) AS m{g} FROM {fit} {'GROUP BY ' + by if by else ''}),
{out} AS (SELECT * EXCLUDE (m, g_, t_), CASE WHEN m IS NULL THEN {col} ELSE array_to_string(list_transform(range(1, len(g_) + 1), lambda i: g_[i] || coalesce(m[t_[i]], t_[i], '')), '') END AS encoded
 FROM (SELECT *, regexp_split_to_array({col}, '[A-Za-z0-9_]+') AS g_, regexp_extract_all({col}, '[A-Za-z0-9_]+') AS t_ FROM {src} {where}))"""


def _card(src: str, key: str, col: str, out: str) -> str:
    starts = "^(" + "|".join(E.SIGNATURE_STARTS) + ")"
    return f"""{out}_t AS (SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(regexp_replace({col}, '[^A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM {src}) GROUP BY ALL),
{out}_k AS (SELECT {key}, array_to_string(list(t ORDER BY n DESC, t)[1:30], ' ') AS top FROM {out}_t GROUP BY {key}),
{out}_s AS (SELECT *, list_filter(list_transform(string_split({col}, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: regexp_matches(x, '{starts}')) AS sg,
  {_TRIM.format(x=f"CASE WHEN instr({col}, chr(10)) > 1 THEN substring({col}, 1, instr({col}, chr(10)) - 1) ELSE {col} END")} AS fl,
  substring(split_part({_TRIM.format(x=f"regexp_extract({col}, '(?s)(" + '""' + '"' + "|'''''')\\s*([^" + '"' + "'']+?)([.\\n]|" + '""' + '"' + "|'''''')', 2)")}, chr(10), 1), 1, 160) AS dl FROM {src}),
{out} AS (SELECT {out}_s.* EXCLUDE (sg, fl, dl), array_to_string(list_filter([CASE WHEN len(sg) > 0 THEN sg[1] ELSE fl END, dl, coalesce(top, '')], lambda x: x <> ''), ' ') AS encoded FROM {out}_s LEFT JOIN {out}_k USING ({key}))"""


def _tuple(src: str, key: str, col: str, out: str) -> str:
    py, js, go = (r.replace("'", "''") for r in (E._PY, E._JS, E._GO))
    ex = lambda r, g: f"regexp_extract({col}, '{r}', {g})"
    pick = lambda g: f"CASE WHEN {ex(py, 1)} <> '' THEN {ex(py, g)} WHEN {ex(js, 1)} <> '' THEN " + ("''" if g == 3 else ex(js, g)) + f" WHEN {ex(go, 1)} <> '' THEN {ex(go, g)} ELSE '{'_' if g == 1 else ''}' END"
    stops = ",".join(f"'{w}'" for w in E.TUPLE_STOPS)
    return f"""{out}_d AS (SELECT *, {pick(1)} AS nm, {pick(2)} AS pr, {_TRIM.format(x=pick(3))} AS rt FROM {src}),
{out}_t AS (SELECT {key}, t, count(*) AS n FROM (SELECT {key}, nm, unnest(regexp_extract_all({col}, '[A-Za-z0-9_]+')) AS t FROM {out}_d) WHERE regexp_matches(t, '^[A-Za-z_]') AND length(t) >= 3 AND t NOT IN ({stops}) AND t <> nm GROUP BY ALL),
{out}_k AS (SELECT {key}, list(t ORDER BY n DESC, t)[1:12] AS top FROM {out}_t GROUP BY {key}),
{out}_p AS (SELECT * EXCLUDE (pr), list_filter(list_transform(list_transform(string_split(pr, ','), lambda p: {_TRIM.format(x='p')}), lambda p: CASE WHEN regexp_matches(p, '^[^:=]+[:=]') THEN {_TRIM.format(x="regexp_extract(p, '^([^:=]+)[:=]', 1)")} ELSE p END), lambda p: p NOT IN ('', 'self', 'cls', '*', '/')) AS ps FROM {out}_d),
{out} AS (SELECT {out}_p.* EXCLUDE (nm, ps, rt), array_to_string(list_concat(list_concat([nm || ' name ' || nm], list_transform(ps, lambda p: nm || ' param ' || p)), list_concat(CASE WHEN rt <> '' THEN [nm || ' returns ' || rt] ELSE [] END, list_transform(coalesce(top, []), lambda t: nm || ' uses ' || t))), '. ') || '.' AS encoded FROM {out}_p LEFT JOIN {out}_k USING ({key}))"""


_ALL = f"""{_PLAIN}, {_cave_cte('pl', 'plain', 'path', 'cv')}, {_fit('pl', 'plain', 'ft')}, {_apply('pl', 'plain', 'ft', 'gl')},
g1 AS (SELECT path, encoded AS e1 FROM gl), {_cave_cte('g1', 'e1', 'path', 'gc')}, {_card('pl', 'path', 'plain', 'cd')}, {_card('g1', 'path', 'e1', 'gd')}, {_tuple('pl', 'path', 'plain', 'tp')}"""


def _type(body: str, cited: str) -> str:
    exts = "|".join(E.CODE_EXTENSIONS)
    return f"""CASE WHEN {cited.format(exts=exts)} OR regexp_matches({body}, '(?m)^\\s*(?:async\\s+)?(?:def|func|function|fn)\\s+[A-Za-z_]\\w*\\s*[(<]') OR regexp_matches({body}, '(?m)^\\s*(?:class|impl)\\s+[A-Za-z_]\\w*[\\s({{:<]') THEN 'function'
 WHEN len(regexp_extract_all({body}, '(?m)^\\s*[-*]\\s+\\*?\\*?[A-Za-z][A-Za-z0-9_/\\- ]{{0,40}}\\*?\\*?\\s*[:—]\\s*\\S')) >= 4
  AND len(regexp_extract_all({body}, '(?m)^\\s*[-*]\\s+\\*?\\*?[A-Za-z][A-Za-z0-9_/\\- ]{{0,40}}\\*?\\*?\\s*[:—]\\s*\\S')) / greatest(len(list_filter(string_split({body}, chr(10)), lambda x: {_TRIM.format(x='x')} <> '')), 1) >= 0.5 THEN 'entity' ELSE 'narrative' END"""


def oracle_sql():
    sums = " UNION ALL ".join(f"SELECT {i} AS ord, '{p}' AS pipeline, coalesce(sum(strlen({c})), 0) AS e FROM {t}" for i, (p, t, c) in enumerate(zip(E.CANDIDATES, ("pl", "cv", "gl", "gc", "cd", "gd", "tp"), ("plain", *["encoded"] * 6))))
    by = list(zip(E.CANDIDATES, ("ty", "cv", "gl", "gc", "cd", "gd", "tp"), ("plain", *["encoded"] * 6)))
    by_sums = " UNION ALL ".join(f"SELECT page_type, {i} AS ord, '{p}' AS pipeline, coalesce(sum(strlen({c})), 0) AS e FROM {t} GROUP BY page_type" for i, (p, t, c) in enumerate(by))
    cited = "path IN (SELECT source_file FROM citations WHERE regexp_matches(lower(repo_path), '\\.({exts})$'))"
    return {
        "encode_caveman": f"WITH {_PLAIN}, {_cave_cte('pl', 'plain', 'path', 'cv')} SELECT path, encoded FROM cv",
        "encode_card": f"WITH {V.FILES}, {_card('files', 'path', 'content', 'cd')} SELECT path, encoded FROM cd",
        "encode_tuple": f"WITH {V.FILES}, {_tuple('files', 'path', 'content', 'tp')} SELECT path, encoded FROM tp",
        "glossary_fit": f"WITH {_PLAIN}, {_fit('pl', 'plain', 'ft')} SELECT token, n, code FROM ft",
        "glossary_encode": f"WITH {_PLAIN}, {_fit('pl', 'plain', 'ft')}, {_apply('pl', 'plain', 'ft', 'gl')} SELECT path, encoded FROM gl",
        "page_type": f"WITH {_PLAIN} SELECT path, {_type('plain', cited)} AS page_type FROM pl",
        "encode_by_type": f"WITH {_PLAIN}, ty AS (SELECT path, plain, {_type('plain', cited)} AS page_type FROM pl), {_cave_cte('ty', 'plain', 'path', 'cv')}, {_card('ty', 'path', 'plain', 'cd')} SELECT cv.path, CASE cv.page_type WHEN 'narrative' THEN cv.encoded WHEN 'function' THEN cd.encoded ELSE cv.plain END AS encoded FROM cv JOIN cd USING (path)",
        "encoding_grid": f"WITH {_ALL}, s AS ({sums}), r AS (SELECT count(*) AS n_pages, sum(strlen(plain)) AS raw_bytes FROM pl) SELECT CAST(ord AS INTEGER) AS ord, pipeline, n_pages, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(e AS BIGINT) AS enc_bytes, round(raw_bytes / e, 6) AS ratio FROM s, r",
        "encoding_grid_by_type": f"""WITH {_PLAIN}, ty AS (SELECT path, plain, {_type('plain', cited)} AS page_type FROM pl), {_cave_cte('ty', 'plain', 'path', 'cv')}, {_fit('ty', 'plain', 'ft', 'page_type')}, {_apply('ty', 'plain', 'ft', 'gl', 'page_type')},
 {_card('ty', 'path', 'plain', 'cd')}, {_tuple('ty', 'path', 'plain', 'tp')}, g1 AS (SELECT path, page_type, encoded AS e1 FROM gl), {_card('g1', 'path', 'e1', 'gd')}, {_cave_cte('g1', 'e1', 'path', 'gc')}, s AS ({by_sums}), r AS (SELECT page_type, count(*) AS n_pages, sum(strlen(plain)) AS raw_bytes FROM ty GROUP BY page_type)
 SELECT page_type, CAST(ord AS INTEGER) AS ord, pipeline, n_pages, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(e AS BIGINT) AS enc_bytes, round(raw_bytes / e, 6) AS ratio FROM s JOIN r USING (page_type) WHERE raw_bytes / e > 0 AND raw_bytes / e <= 4.5 QUALIFY row_number() OVER (PARTITION BY page_type ORDER BY ratio DESC, ord) = 1""",
    }
