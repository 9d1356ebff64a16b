"""Conversations with tool calls, made from the plain ones of a table, and their DuckDB oracle.

Odd turns call (search, and by a sum of ids a second call: in order, unknown, faulty, broken, after itself, after several, or with a used id); even
turns answer the turn before, and some give a result that nobody asked for. format_chat() sees only the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import table
from flowloom.llm.tool_chat import SCHEMAS, format_chat


def _call(id_: str, name: str, arguments: str, after: str = "") -> str:
    """A call whose keys aren't in canonical order; # stands for the turn and ~ for the turn two before."""
    text = f'<tool_call>{{"name":"{name}","arguments":{arguments},"id":"{id_}"{after}}}</tool_call>'
    return "'" + text.replace("#", "' || CAST(turn AS STRING) || '").replace("~", "' || CAST(turn - 2 AS STRING) || '") + "'"


_SECOND = [
    _call("b#", "calculate", '{"expression":"1+#"}', ',"after":["a#"]'),
    _call("b#", "zap", "{}"),
    _call("b#", "fetch", '{"headers":{}}'),
    _call("b#", "classify", '{"text":"t","threshold":0.5,"labels":["x"],"more":1}'),
    "'<tool_call>{\"id\":\"b\", broken</tool_call>'",
    _call("b#", "search", '{"query":7}', ',"after":["b#"]'),
    _call("b#", "search", '{"query":"z"}', ',"after":["a~","a#"]'),
    _call("a#", "search", '{"query":"again"}'),
    _call("b#", "search", "[1]"),
]
_RESULT = """'<tool_result>{"id":"a' || CAST(turn - 1 AS STRING) || '","content":{"z":' || CAST(turn AS STRING) || ',"a":[true,null]}}</tool_result>'"""
#: One expression in both dialects.
TEXT = f"""coalesce(text, '') || CASE WHEN turn % 2 = 1 THEN
  CASE WHEN turn > 1 THEN {_call("a#", "search", '{"query":"q#","limit":#}', ',"after":["a~"]')} ELSE {_call("a#", "search", '{"query":"q#","limit":#}')} END
  || CASE (conv_id * 7 + turn * 3) % {len(_SECOND)} {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SECOND))} ELSE '' END
  ELSE CASE WHEN turn > 0 THEN {_RESULT} ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN '<tool_result>{{"id":"none","content":1}}</tool_result>' ELSE '' END END"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations").withColumn("text", F.expr(TEXT)))


def _canonical(x: str, depth: int = 3) -> str:
    k, value = f"k{depth}", f"json_extract({x}, '$.' || k{depth})"
    text = f"CAST({value} AS VARCHAR)"
    if depth > 1:
        text = f"CASE WHEN json_type({value}) = 'OBJECT' THEN {_canonical(value, depth - 1)} ELSE {text} END"
    return f"""'{{' || array_to_string(list_transform(list_sort(json_keys({x})), lambda {k}: '"' || {k} || '":' || {text}), ',') || '}}'"""


_WANTED = ", ".join(f"('{tool}', '{a}', '{t}', {str(required).lower()})" for tool, args in SCHEMAS.items() for a, (t, required) in args.items())
_BLOCK = "(?s)<tool_{0}>(.*?)</tool_{0}>"
_FOUND = """SELECT *, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.id') END AS call_id
  FROM (SELECT mid, conv_id, turn, unnest(b) AS raw, CAST(unnest(range(len(b))) AS INTEGER) AS place FROM (SELECT *, regexp_extract_all(text, '{0}', 1) AS b FROM m))"""
ORACLE = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS mid, conv_id, turn, coalesce(role, 'unknown') AS role, {TEXT} AS text FROM conversations),
r AS ({_FOUND.format(_BLOCK.format("result"))}),
c0 AS ({_FOUND.format(_BLOCK.format("call"))}),
c AS (SELECT *, CASE WHEN ok THEN json_extract_string(raw, '$.name') END AS name, CASE WHEN ok THEN json_extract(raw, '$.arguments') END AS args,
  CASE WHEN ok THEN coalesce(CAST(json_extract(raw, '$.after') AS VARCHAR[]), []) END AS after,
  call_id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, mid, place) = 1 AS own FROM c0),
o AS (SELECT * FROM c WHERE own),
dep AS (SELECT conv_id, call_id, unnest(after) AS d FROM o),
lost AS (SELECT DISTINCT conv_id, call_id FROM dep WHERE (conv_id, d) NOT IN (SELECT (conv_id, call_id) FROM o)),
steps AS (
  SELECT conv_id, call_id, 0 AS level FROM o WHERE len(after) = 0
  UNION ALL SELECT dep.conv_id, dep.call_id, steps.level + 1 FROM steps JOIN dep ON dep.conv_id = steps.conv_id AND dep.d = steps.call_id
  WHERE (dep.conv_id, dep.call_id) NOT IN (SELECT (conv_id, call_id) FROM lost)),
levels AS (SELECT conv_id, call_id, max(level) AS level FROM steps GROUP BY ALL),
first AS (SELECT o.conv_id, o.call_id, o.mid, o.place, o.turn, level FROM o LEFT JOIN levels USING (conv_id, call_id)),
wanted(name, arg, want, required) AS (VALUES {_WANTED}),
given AS (SELECT mid, place, name, arg, CASE json_type(args, '$.' || arg) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
    WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'null' END AS got
  FROM (SELECT *, unnest(json_keys(args)) AS arg FROM c WHERE json_type(args) = 'OBJECT')),
faults AS (
  SELECT mid, place, CASE WHEN got IS NULL THEN CASE WHEN required THEN 'missing:' || arg END WHEN NOT (got = want OR (want = 'number' AND got = 'integer')) THEN 'type:' || arg END AS e
  FROM (SELECT mid, place, name FROM c WHERE args IS NULL OR json_type(args) = 'OBJECT') JOIN wanted USING (name) LEFT JOIN (SELECT mid, place, arg, got FROM given) USING (mid, place, arg)
  UNION ALL SELECT mid, place, 'extra:' || arg FROM given WHERE (name, arg) NOT IN (SELECT (name, arg) FROM wanted)
  UNION ALL SELECT mid, place, 'type:arguments' FROM c WHERE args IS NOT NULL AND json_type(args) <> 'OBJECT'),
fault AS (SELECT mid, place, string_agg(e, ',' ORDER BY e) AS fault FROM faults WHERE e IS NOT NULL GROUP BY ALL),
judged AS (SELECT c.*, first.level, first.mid IS NOT NULL AS owns, fault, EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) AS answered
  FROM c LEFT JOIN first ON first.mid = c.mid AND first.place = c.place LEFT JOIN fault ON fault.mid = c.mid AND fault.place = c.place)
SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS o_turn, 0 AS o_level, -1 AS o_place, 0 AS o_part, false AS linked, CAST(NULL AS VARCHAR) AS error,
  '{{"content":' || to_json(regexp_replace(regexp_replace(text, '{_BLOCK.format("call")}', '', 'g'), '{_BLOCK.format("result")}', '', 'g')) || ',"role":' || to_json(role) || '}}' AS json FROM m
UNION ALL SELECT conv_id, turn, 'call', call_id, turn, level, place, 0, answered AND owns,
  CASE WHEN NOT ok THEN 'bad_json' WHEN call_id IS NULL THEN 'no_id' WHEN NOT owns THEN 'duplicate_id' WHEN name IS NULL OR name NOT IN ({", ".join(f"'{n}'" for n in SCHEMAS)}) THEN 'unknown_tool' WHEN fault IS NOT NULL THEN fault WHEN level IS NULL THEN 'unordered' END,
  CASE WHEN ok THEN {_canonical("raw")} ELSE '{{"raw":' || to_json(raw) || '}}' END FROM judged
UNION ALL SELECT r.conv_id, r.turn, 'result', r.call_id, coalesce(first.turn, r.turn), first.level, coalesce(first.place, r.place), 1, first.mid IS NOT NULL, CASE WHEN first.mid IS NULL THEN 'orphan' END,
  {_canonical("r.raw")} FROM r LEFT JOIN first ON first.conv_id = r.conv_id AND first.call_id = r.call_id
"""
