"""Repair of JSON that models get wrong; a small, stated subset.

Code fences, comments of //, single quotes, Python literals, commas before a closing bracket, bare keys and a
truncated tail are mended. What is valid already does not reach Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import text as t

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|[{}\[\],:]|[^\s{}\[\],:"\']+|["\'].*\Z', re.S)
_NAMES = {"True": "true", "False": "false", "None": "null", "true": "true", "false": "false", "null": "null"}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?\Z")


#: Strings, and commas before a closing bracket.
_COMMA = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[\]}])', re.S)


def _without_last_commas(text: str) -> str | None:
    """``text`` without commas before closing brackets, if that makes it valid JSON: the commonest fault by far."""
    value = _COMMA.sub(lambda m: "" if m[0] == "," else m[0], text)
    try:
        json.loads(value)
    except ValueError:
        return None
    return value


def repair(text: str | None) -> str | None:
    """``text`` as valid JSON if it can be mended, else null."""
    if text is None:
        return None
    if text[:1] in ("[", "{") and (value := _without_last_commas(text)) is not None:
        return value
    body = re.sub(r"^\s*```[a-zA-Z]*|```\s*$", "", text)
    out, open_ = [], []
    for m in _TOKEN.finditer(body):
        tok = m[0]
        if tok.startswith("//"):
            continue
        if tok in "{[":
            open_.append("}" if tok == "{" else "]")
        elif tok in "}]":
            if not open_ or open_[-1] != tok:
                return None
            open_.pop()
            while out and out[-1] == ",":
                out.pop()
        elif tok not in ",:":
            tok = _scalar(tok)
        out.append(tok)
    while out and out[-1] in (",", ":"):
        out.pop()
    value = "".join(out) + "".join(reversed(open_))
    try:
        json.loads(value)
    except ValueError:
        return None
    return value


def _scalar(tok: str) -> str:
    if tok[0] == '"' and len(tok) > 1 and tok.endswith('"'):
        return tok
    if tok[0] in "\"'":
        return json.dumps(tok[1:-1].replace("\\'", "'") if len(tok) > 1 and tok.endswith(tok[0]) else tok[1:], ensure_ascii=False)
    return _NAMES.get(tok, tok if _NUMBER.match(tok) else json.dumps(tok, ensure_ascii=False))


#: The same for Java, where strings are kept by a group, and a string alone.
_JAVA_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JAVA_COMMA = rf"(?s)({_JAVA_STRING})|,(?=\s*[\]}}])"
#: An array, whose strings are empty, and nothing after it.
_WHOLE = rf"\A{t.BALANCED}[ \t\r\n]*\z"


def repaired(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """``df`` with ``column`` mended where it is not valid JSON; null where it can't be. ``value`` names a column to hold it as VARIANT.

    Text is parsed once. Of what does not parse, short arrays are tried without commas before closing brackets; only
    what is left goes to Python and is parsed again.
    """

    @F.pandas_udf("string")
    def mend(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s if s.isna().all() else s.map(repair, na_action="ignore")

    name = value or "_value"
    text, good = F.col(column), F.col(name).isNotNull()
    short = ~good & F.startswith(text, F.lit("[")) & (F.length(text) <= t.SHORT)
    tried = df.withColumn(name, F.try_parse_json(column)).withColumn("_plain", F.when(short, F.regexp_replace(text, _JAVA_COMMA, "$1")))
    # Spark reads no further than the end of the first value, so that there must be nothing else.
    whole = (F.col("_plain") != text) & F.regexp_replace("_plain", f"(?s){_JAVA_STRING}", '""').rlike(_WHOLE)
    tried = tried.withColumn("_plain_value", F.when(whole, F.try_parse_json("_plain")))
    plain = F.col("_plain_value").isNotNull()
    mended = tried.withColumn("_mended", mend(F.when(~good & ~plain, text)))
    out = mended.withColumn(column, F.when(good, text).when(plain, F.col("_plain")).otherwise(F.col("_mended")))
    if value is None:
        return out.drop(name, "_plain", "_plain_value", "_mended")
    return out.withColumn(name, F.when(good, F.col(name)).when(plain, F.col("_plain_value")).otherwise(F.try_parse_json("_mended"))).drop("_plain", "_plain_value", "_mended")
