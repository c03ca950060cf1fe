"""Tool calls in the formats of model families: arrays of (name, arguments as JSON) and the text without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tools

# Regular expressions of the markers.  A call's expression has the name as its first group and the arguments as its second.
JSON_MARKERS = {
    "hermes": ("<tool_call>", "</tool_call>"),
    "nemotron_deci": ("<TOOLCALL>", "</TOOLCALL>"),
    "llama3_json": (r"<\|python_tag\|>", r"\z"),
    "mistral": (r"\[TOOL_CALLS\]", r"\[/TOOL_CALLS\]"),
    "phi4": ("functools", r"\z"),
    "jamba": ("<tool_calls>", "</tool_calls>"),
    "default": (r"(?:<TOOLCALL>|<\|python_tag\|>)", "</TOOLCALL>"),
}
NAMED_JSON = {
    "deepseek_v3": (r"<｜tool▁call▁begin｜>(?:function)?<｜tool▁sep｜>\s*([^\n]+?)\s*```json\s*(.*?)\s*```\s*<｜tool▁call▁end｜>", r"<｜tool▁calls▁begin｜>.*?(?:<｜tool▁calls▁end｜>|\z)"),
    "deepseek_v3_1": (r"<｜tool▁call▁begin｜>\s*(.*?)\s*<｜tool▁sep｜>\s*(.*?)\s*<｜tool▁call▁end｜>", r"<｜tool▁calls▁begin｜>.*?(?:<｜tool▁calls▁end｜>|\z)"),
    "harmony": (r"<\|channel\|>commentary to=functions\.([\w.-]+)[^<]*(?:<\|constrain\|>[^<]*)?<\|message\|>(.*?)(?:<\|call\|>|\z)", r"(?:<\|start\|>assistant)?<\|channel\|>commentary to=functions\..*?(?:<\|call\|>|\z)"),
}
#: Call block; a call with its name and body; a parameter with its name and value.
TAGGED = {
    "qwen3_coder": (r"<tool_call>.*?(?:</tool_call>|\z)", r"<function=([^>\s]+)\s*>(.*?)(?:</function>|\z)", r"<parameter=([^>\s]+)\s*>(.*?)(?:</parameter>|(?=<parameter=)|\z)"),
    "minimax_m2": (r"<minimax:tool_call>.*?(?:</minimax:tool_call>|\z)", r"<invoke name=\"?([^\">]+)\"?\s*>(.*?)(?:</invoke>|\z)", r"<parameter name=\"?([^\">]+)\"?\s*>(.*?)(?:</parameter>|\z)"),
    "deepseek_v3_2": (r"<｜DSML｜function_calls>.*?(?:</｜DSML｜function_calls>|\z)", r"<｜DSML｜invoke name=\"([^\"]+)\"\s*>(.*?)</｜DSML｜invoke>", r"<｜DSML｜parameter name=\"([^\"]+)\"[^>]*>(.*?)</｜DSML｜parameter>"),
    "glm47": (r"<tool_call>.*?(?:</tool_call>|\z)", r"<tool_call>\s*([^<\s]+)(.*?)(?:</tool_call>|\z)", r"<arg_key>\s*(.*?)\s*</arg_key>\s*<arg_value>(.*?)</arg_value>"),
}
# Other names of a format.
SAME_AS = {"nemotron_nano": "qwen3_coder", "": "default"}
_WHITE = " \t\r\n"


def _calls(names: Column, arguments: Column) -> Column:
    return F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def _with_rest(text: Column, calls: Column, block: str) -> Column:
    """Blocks go from the text if there is a call in it; else it stays as it is."""
    rest = F.btrim(F.regexp_replace(text, f"(?s){block}", ""), F.lit(_WHITE))
    return F.struct(calls.alias("calls"), F.when(F.size(calls) > 0, rest).otherwise(text).alias("rest"))


def named_json(text: Column, call: str, block: str) -> Column:
    """Calls with a name and a JSON body; one whose body is no JSON object is no call."""
    names, bodies = (F.regexp_extract_all(text, F.lit(f"(?s){call}"), i) for i in (1, 2))
    each = F.filter(_calls(names, bodies), lambda c: F.try_parse_json(c["arguments"]).isNotNull() & F.startswith(F.btrim(c["arguments"], F.lit(_WHITE)), F.lit("{")))
    return _with_rest(text, each, block)


def json_value(value: Column, kind: Column) -> Column:
    """A parameter's text as JSON of the kind that its schema has; as a string if it has none or the text isn't of that kind."""
    quoted = F.substring(F.to_json(F.array(value)), 2, 1 << 30)
    quoted = F.substring(quoted, F.lit(1), F.length(quoted) - 1)
    v = F.btrim(value, F.lit(_WHITE))
    number = F.when(kind == "integer", v.rlike(r"^[+-]?[0-9]+$")).when(kind == "number", v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
    other = F.when(kind == "boolean", F.lower(v).isin("true", "false")).when(kind.isin("object", "array"), F.try_parse_json(v).isNotNull() & v.rlike(r"^[\[{]"))
    return F.when(F.coalesce(number, F.lit(False)), F.regexp_replace(v, r"^\+", "")).when(F.coalesce(other, F.lit(False)), F.when(kind == "boolean", F.lower(v)).otherwise(v)).otherwise(quoted)


def tagged(text: Column, block: str, call: str, parameter: str, schema: dict[str, str] | None = None) -> Column:
    """Calls whose parameters stand in tags of their own; schema: kinds by parameter name."""
    kinds = F.create_map(*[F.lit(x) for pair in (schema or {"": "string"}).items() for x in pair])
    # a block that is its own call keeps its markers for the call's expression
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(f"(?s){block}"), 0), "\n")
    names, bodies = (F.regexp_extract_all(blocks, F.lit(f"(?s){call}"), i) for i in (1, 2))

    def arguments(body):
        keys, values = (F.regexp_extract_all(body, F.lit(f"(?s){parameter}"), i) for i in (1, 2))
        pairs = F.zip_with(keys, values, lambda k, v: F.concat(F.substring(F.to_json(F.map_from_arrays(F.array(k), F.array(F.lit(0)))), F.lit(2), F.length(F.to_json(F.map_from_arrays(F.array(k), F.array(F.lit(0))))) - 3), json_value(F.regexp_replace(v, r"^\n|\n$", ""), F.coalesce(F.try_element_at(kinds, k), F.lit("string")))))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    return _with_rest(text, _calls(names, F.transform(bodies, arguments)), block)


def parse(text: Column, family: str | None, schema: dict[str, str] | None = None) -> Column:
    """The calls and the rest, in a family's format; none is the default one (X7).  Pythonic calls: ``pythonic`` over a table."""
    family = SAME_AS.get(family or "", family)
    if family in JSON_MARKERS:
        return tools.tool_calls(text, *JSON_MARKERS[family])
    if family in NAMED_JSON:
        return named_json(text, *NAMED_JSON[family])
    if family in TAGGED:
        return tagged(text, *TAGGED[family], schema)
    raise ValueError(f"no format {family!r}; there are {sorted([*JSON_MARKERS, *NAMED_JSON, *TAGGED, *SAME_AS, 'pythonic'])}")


def _python_calls(text: str | None) -> tuple[list[dict], str | None]:
    import ast
    import json

    begin, end = (text or "").find("["), (text or "").rfind("]")
    if begin < 0 or end < begin:
        return [], text
    try:
        tree = ast.parse(text[begin : end + 1], mode="eval").body
        calls = [{"name": ast.unparse(c.func), "arguments": json.dumps({k.arg: ast.literal_eval(k.value) for k in c.keywords})} for c in tree.elts if isinstance(c, ast.Call) and not c.args]
    except (SyntaxError, ValueError, AttributeError, TypeError, RecursionError, MemoryError):
        return [], text
    return (calls, (text[:begin] + text[end + 1 :]).strip()) if calls else ([], text)


def pythonic(rows, column: str, calls: str = "calls", rest: str = "rest"):
    """A table with the calls of a list of Python calls with literal keyword arguments (X15).  Python parses its own syntax, in Arrow batches."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))

    def step(batches):
        for batch in batches:
            found = [_python_calls(t) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], kind), pa.array([r for _, r in found], pa.string())], [*batch.schema.names, calls, rest])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(step, f"{shape}, {calls} array<struct<name string, arguments string>>, {rest} string")
