"""CSS text to a long table of declarations; a small tokenizer, no recursion.

A declaration row is (scope, scope_key, selector, prop, value, important, ord):
scope ``rule``, ``media``, ``supports``, ``keyframes`` (selector = the step) or
``var`` (custom properties of ``:root`` at any depth).  Nested conditions are
keyed by their own text alone; a rule inside both kinds counts for both.  Other
at-rules and rules without declarations give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECL = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("scope_key", T.StringType()), T.StructField("selector", T.StringType()),
    T.StructField("prop", T.StringType()), T.StructField("value", T.StringType()), T.StructField("important", T.BooleanType()),
    T.StructField("ord", T.IntegerType())])
DECLS = T.ArrayType(DECL)

_VAR = re.compile(r"var\((--[\w-]+)(?:,\s*([^\)]+))?\)")
_IDENT = re.compile(r"-{0,2}[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*|--[\w-]*")
_IMPORTANT = re.compile(r"!\s*important\s*$", re.I)
_OPENERS, _CLOSERS = "([{", ")]}"


def strip_comments(text: str) -> str:
    """Comments become nothing; strings are left alone."""
    return re.sub(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|/\*.*?(?:\*/|\Z)""", lambda m: m[1] or "", text, flags=re.S)


def _end_of_string(text: str, i: int) -> int:
    quote, n = text[i], len(text)
    i += 1
    while i < n and text[i] != quote and text[i] != "\n":
        i += 2 if text[i] == "\\" else 1
    return min(i + 1, n)


def _scan(text: str, i: int, stops: str) -> int:
    """Place of the first stop outside strings and brackets, or the end."""
    depth, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'":
            i = _end_of_string(text, i)
            continue
        if c == "\\":
            i += 2
            continue
        if depth == 0 and c in stops:
            return i
        if c in _OPENERS:
            depth += 1
        elif c in _CLOSERS and depth:
            depth -= 1
        i += 1
    return n


def _block_end(text: str, i: int) -> int:
    """Place of the brace that closes the block opened before i."""
    return _scan(text, i, "}")


def declarations(body: str) -> list[tuple[str, str, bool]]:
    out, i = [], 0
    while i < len(body):
        end = _scan(body, i, ";")
        piece = body[i:end].strip()
        i = end + 1
        name, colon, value = piece.partition(":")
        name = name.strip()
        if not colon or not _IDENT.fullmatch(name):
            continue
        value = value.strip()
        important = bool(_IMPORTANT.search(value))
        if important:
            value = _IMPORTANT.sub("", value).strip()
        out.append((name, value, important))
    return out


def rules(text: str) -> list[tuple[str | None, str, str]]:
    """(at-keyword or null, prelude, body) of the rules of one level."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i].isspace() or text[i] in ";}":
            i += 1
            continue
        at = re.compile(r"@([\w-]+)").match(text, i)
        start = at.end() if at else i
        end = _scan(text, start, "{;" if at else "{")
        prelude = text[start:end].strip()
        if end >= n or text[end] == ";":
            i = end + 1
            continue
        close = _block_end(text, end + 1)
        out.append((at[1].lower() if at else None, prelude, text[end + 1 : close]))
        i = close + 1
    return out


def parse_css(text: str | None) -> list[tuple]:
    rows: list[tuple] = []
    todo = [(r, None, None) for r in reversed(rules(strip_comments(text or "")))]
    while todo:
        (at, prelude, body), media, supports = todo.pop()
        if at == "media":
            todo += [(r, prelude, supports) for r in reversed(rules(body))]
        elif at == "supports":
            todo += [(r, media, prelude) for r in reversed(rules(body))]
        elif at == "keyframes":
            for kind, step, inner in rules(body):
                if kind is None:
                    rows += [("keyframes", prelude, step, p, v, False, 0) for p, v, _ in declarations(inner)]
        elif at is None:
            for p, v, important in declarations(body):
                if media is not None:
                    rows.append(("media", media, prelude, p, v, important, 0))
                if supports is not None:
                    rows.append(("supports", supports, prelude, p, v, important, 0))
                if media is None and supports is None:
                    rows.append(("rule", "", prelude, p, v, important, 0))
                if prelude == ":root" and p.startswith("--"):
                    rows.append(("var", "", prelude, p, v, important, 0))
    return [(*r[:6], k) for k, r in enumerate(rows)]


def resolve_vars(value: str, variables: dict[str, str], seen: set[str] | None = None) -> str:
    """``var(--x, fallback)`` replaced; a variable met again stays as it is."""
    seen = set() if seen is None else seen

    def put(m: re.Match) -> str:
        name, fallback = m[1], m[2]
        if name in seen:
            return f"var({name})"
        seen.add(name)
        if name in variables:
            return resolve_vars(variables[name], variables, seen)
        return fallback.strip() if fallback is not None else f"var({name})"

    return _VAR.sub(put, value)


@F.pandas_udf(DECLS)
def css_declarations(content):
    """All declarations with a ``resolved`` value in place of rule values."""
    import pandas as pd

    out = []
    for c in content:
        rows = parse_css(c)
        variables = {r[3]: r[4] for r in rows if r[0] == "var"}
        out.append([dict(zip(("scope", "scope_key", "selector", "prop", "value", "important", "ord"), (
            *r[:4], r[4] if r[0] in ("var", "keyframes") else resolve_vars(r[4], variables), *r[5:]))) for r in rows])
    return pd.Series(out)


def float_text(number: Column) -> Column:
    """A double as plain text with at least one decimal place (1.0, 0.5)."""
    return number.cast("string")


def normalize_value(value: Column) -> Column:
    """Rule values: trimmed, small, no final semicolons, #abc doubled, Npx a number."""
    v = F.regexp_replace(F.lower(F.trim(value)), r";+$", "")
    v = F.when(v.rlike(r"^#[0-9a-f]{3}$"), F.regexp_replace(v, r"([0-9a-f])", "$1$1")).otherwise(v)
    pixels = F.regexp_extract(v, r"^([0-9]*\.?[0-9]+)px$", 1)
    return F.when(pixels != "", float_text(F.nullif(pixels, F.lit("")).cast("double"))).otherwise(v)


def normalize_color(value: Column) -> Column:
    """Small letters, no spaces, hex of three or four digits doubled."""
    v = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit(""))
    return F.when(v.rlike(r"^#([0-9a-f]{3}|[0-9a-f]{4})$"), F.regexp_replace(v, r"([0-9a-f])", "$1$1")).otherwise(v)


def normalize_number(value: Column) -> Column:
    """A number, with or without a unit, in its shortest form: 10.0px, +10px and 10px
    are one, and so are .5em, 0.50em and 0.5em.  Anything else is trimmed and small."""
    v = F.lower(F.trim(value))
    number = r"^([+-]?[0-9]*\.?[0-9]+)([a-z%]*)$"
    n = F.nullif(F.regexp_extract(v, number, 1), F.lit("")).cast("double")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(n.isNull(), v).otherwise(F.concat(F.when(whole, n.cast("bigint").cast("string")).otherwise(float_text(n)), F.regexp_extract(v, number, 2)))


def normalize_keyframe_value(value: Column) -> Column:
    return normalize_number(normalize_color(value))


def specificity(selector: Column) -> Column:
    """100 ids + 10 (classes, attributes, pseudo-classes) + elements and
    pseudo-elements; ``::x`` counts for both kinds of pseudo."""
    # The patterns of what counts.
    def count(pattern: str) -> Column:
        return F.regexp_count(selector, F.lit(pattern))

    tens = count(r"\.[\w-]+") + count(r"\[[^\]]+\]") + count(r":[\w-]+")
    ones = count(r"(?:^|[\s>+~])[A-Za-z][\w-]*") + count(r"::[\w-]+")
    return (100 * count(r"#[\w-]+") + 10 * tens + ones).cast("int")
