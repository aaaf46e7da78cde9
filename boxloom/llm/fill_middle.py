"""Fill-in-the-middle transformation.

A text is cut at two places into prefix, middle and suffix, and these are put in another order behind marks,
so that a model learns to write what stands between. Places are counted in tokens or in code points, texts are
cut in bytes: an index of the text's exceptions, that is of its multibyte characters alone, holds their places
and the bytes they take beyond one; ``searchsorted`` in it turns code points into bytes and back, and what lies
between two exceptions is arithmetic. A text of ASCII has an empty index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import fresh

#: Marks that open prefix, suffix and middle in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Texts of a hundred that are transformed, and transformed ones of a hundred that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = ("tokens", "chars")

CUT = "n long, prefix_chars long, middle_chars long, output binary"


class ByteIndex:
    """Where code points and bytes of a UTF-8 text differ.

    ``chars[k]`` is the place, in code points, of the k-th character of more than one byte, ``starts[k]`` its
    place in bytes, and ``excess[k]`` counts the bytes beyond one of the first k of them.
    """

    def __init__(self, text: np.ndarray):
        self.starts = np.flatnonzero(text >= 0xC0)
        lead = text[self.starts]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))])
        self.chars = self.starts - self.excess[:-1]
        self.n_chars = len(text) - int(self.excess[-1])

    def to_bytes(self, char: np.ndarray) -> np.ndarray:
        """The byte at which each code point begins; the text's length for its end."""
        return char + self.excess[np.searchsorted(self.chars, char)]

    def to_chars(self, byte: np.ndarray) -> np.ndarray:
        """The code points before each byte that begins one."""
        return byte - self.excess[np.searchsorted(self.starts, byte)]


def token_ends(text: np.ndarray) -> np.ndarray:
    """Bytes at which the tokens of a UTF-8 text end: each takes the white space before it, the last may be white space alone."""
    if not len(text):
        return np.zeros(0, np.int64)
    space = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text))


def cut_text(text: bytes, form: str, first: int, second: int, unit: str = UNITS[0], marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple:
    """(n, prefix_chars, middle_chars, output) of one text; all but the number of units are None where ``form`` is plain.

    The cuts are ``first`` and ``second`` modulo n + 1 units, the smaller first.
    """
    held = np.frombuffer(text, np.uint8)
    index = None if form == PLAIN and unit == UNITS[0] else ByteIndex(held)
    ends = token_ends(held) if unit == UNITS[0] else None
    n = index.n_chars if ends is None else len(ends)
    if form == PLAIN:
        return n, None, None, None
    units = np.sort(np.array([first % (n + 1), second % (n + 1)]))
    if ends is None:
        chars, cuts = units, index.to_bytes(units)
    else:
        cuts = np.concatenate([[0], ends])[units]
        chars = index.to_chars(cuts)
    a, b = cuts
    p, s, m = (mark.encode() for mark in marks)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    output = b"".join((p, prefix, s, suffix, m, middle) if form == PSM else (s, suffix, p, prefix, m, middle))
    return n, int(chars[0]), int(chars[1] - chars[0]), output


def seeded(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 that a seed and an id choose; a null id counts as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    seed: int = SEED,
    unit: str = UNITS[0],
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``docs`` with n (long, units of the text), form, prefix_chars, middle_chars (long) and output (string).

    Every row comes back with its other columns; its own columns of those names give way. A null text is an
    empty one. The form is plain, and the output the text, where the text is empty, holds a mark or is not
    among the ``rate`` of a hundred; the two numbers are null there. Rows that repeat an id are cut by the same
    numbers, each in its own text. Texts stay where they are: nothing is shuffled.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if not all(marks) or any(_meet(x, y, x is y) for x in marks for y in marks) or len(set(marks)) < 3:
        raise ValueError("marks must be three different strings, none of which another holds or ends in the beginning of")

    @F.arrow_udf(CUT)
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, forms, first, second in batches:
            rows = [
                cut_text(text.as_py(), form, a, b, unit, marks)
                for text, form, a, b in zip(texts, forms.to_pylist(), first.to_pylist(), second.to_pylist())
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.StructArray.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["n", "prefix_chars", "middle_chars", "output"]
            )

    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(c) for c in docs.columns if c.lower() not in own]
    text_, form_, cut_ = fresh(docs, "text", "form", "cut")
    first, second, third, fourth = seeded(F.col("doc_id"), seed)
    text = F.col(text_)
    plain = (text == "") | (third % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, PLAIN).when(fourth % 100 < suffix_first, SPM).otherwise(PSM)
    rows = docs.withColumn(text_, F.coalesce(F.col("text"), F.lit(""))).withColumn(form_, form)
    rows = rows.withColumn(cut_, cut(text.cast("binary"), F.col(form_), first, second))
    output = F.coalesce(F.col(cut_)["output"].cast("string"), text)
    return rows.select(
        *kept,
        F.col(cut_)["n"].alias("n"),
        F.col(form_).alias("form"),
        F.col(cut_)["prefix_chars"].alias("prefix_chars"),
        F.col(cut_)["middle_chars"].alias("middle_chars"),
        output.alias("output"),
    )


def _meet(x: str, y: str, same: bool) -> bool:
    """True if, where text stands beside ``y``, both together can seem to hold ``x``, or ``y`` holds ``x``."""
    return (x in y and not same) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)) + (not same)))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text behind an output and its form. A transformed text holds no mark, so that the marks part the output."""
    pattern = "|".join(re.escape(mark) for mark in marks)
    parts = F.split(output, pattern, -1)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(form == PSM, F.concat(first, third, second))
        .when(form == SPM, F.concat(second, third, first))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for every row of ``docs``."""
    out = transform(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as hex from documents
), u as (
  select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
         ('0x' || hex[1:8])::bigint as h1, ('0x' || hex[9:16])::bigint as h2, ('0x' || hex[17:24])::bigint as h3, ('0x' || hex[25:32])::bigint as h4
  from t
), f as (
  select doc_id, text, tokens, len(tokens) as n,
         least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from u
), c as (
  select doc_id, text, n, form, array_to_string(tokens[1:a], '') as p, array_to_string(tokens[a + 1:b], '') as m, array_to_string(tokens[b + 1:], '') as s
  from f
), o as (
  select *, case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end as output
  from c
), r as (
  select *, string_split_regex(output, '<P>|<S>|<M>') as parts from o
)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(output) as output_sha256,
       sha256(case form when 'plain' then output when 'psm' then parts[2] || parts[4] || parts[3] else parts[3] || parts[4] || parts[2] end) as restored_sha256
from r
"""
