"""Positions of regular-expression matches, in DataFrame expressions.

A text split at a pattern gives the gaps between its matches; with the matches
themselves their running lengths are the positions, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"
NONE = f"cast(array() as {SPAN})"


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    if '"' not in pattern:
        return f'r"{pattern}"'
    if "'" not in pattern:
        return f"r'{pattern}'"
    raise ValueError("write one kind of quote as \\x22 or \\x27")


def once(sql: str) -> Column:
    """``sql`` as a column that is evaluated where it stands: filters aren't
    pushed below it and no constraints are derived from it, either of which would
    copy the whole expression at each mention, beyond any memory where columns
    build on one another."""
    return F.when(F.rand(0) >= 0, F.expr(sql))


#: Running values are taken in blocks of so many, so that no array grows by one
#: element at a time through all matches of a text.
BLOCK = 128


def running(values: str, step: str) -> str:
    """SQL: for each element of the array<int> ``values`` the value that ``step``
    (over ``acc.at`` and ``x``, associative, 0 neutral) has reached before it."""

    def within(items: str) -> str:
        then = "concat(acc.out, array(acc.at))"
        return f"aggregate({items}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', {step}, 'out', {then}))"

    cut = f"transform(sequence(0, (size({values}) - 1) div {BLOCK}), b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"
    parts = f"transform({cut}, p -> {within('p')})"
    carried = step.replace("acc.at", "o").replace("x", "y")
    flat = f"flatten(zip_with(r, {within('transform(r, p -> p.at)')}.out, (p, o) -> transform(p.out, y -> {carried})))"
    return f"if(size({values}) = 0, cast(array() as array<int>), element_at(transform(array({parts}), r -> {flat}), 1))"


def with_spans(df: DataFrame, name: str, text: str, pattern: str, guard: str, keep: str = "true") -> DataFrame:
    """Adds ``name``: the non-overlapping matches (start, end, text) from the
    left for which ``keep`` (SQL over ``$v``) holds. Rows without ``guard`` (SQL,
    a cheap necessary condition) are not searched. Patterns are possessive, so
    the time is linear in the text, and positions are running sums over blocks of
    matches, linear in them up to some ten million a text."""
    lit = literal(pattern)
    m, sizes, starts = (f"__{x}_{name}" for x in ("m", "l", "at"))
    df = df.withColumn(m, once(f"if({guard}, regexp_extract_all({text}, {lit}, 0), cast(array() as array<string>))"))
    gaps = f"slice(split({text}, {lit}, -1), 1, size({m}))"
    df = df.withColumn(sizes, once(f"if(size({m}) = 0, cast(array() as array<int>), zip_with({gaps}, {m}, (g, v) -> char_length(g) + char_length(v)))"))
    df = df.withColumn(starts, once(running(sizes, "acc.at + x")))
    ends = f"zip_with({starts}, {sizes}, (a, n) -> a + n)"
    spans = f"zip_with({ends}, {m}, (e, v) -> named_struct('s', e - char_length(v), 'e', e, 'v', v))"
    kept = spans if keep == "true" else f"filter({spans}, x -> {keep.replace('$v', 'x.v')})"
    return df.withColumn(name, once(f"if(size({m}) = 0, {NONE}, {kept})")).drop(m, sizes, starts)


def described(spans: str, kind: str) -> Column:
    """["kind:start:end", ...]"""
    return F.expr(f"transform({spans}, x -> concat('{kind}:', x.s, ':', x.e))")


def with_replaced(df: DataFrame, name: str, text: str, spans: str, blank: bool = False) -> DataFrame:
    """Adds ``name``: ``text`` with ``spans`` (start, end, replacement), sorted by
    start, replaced; of overlapping spans the first decides and the others only
    extend it. With ``blank`` all of it becomes spaces, as many as it is long. The
    text is cut in as many parts as each part has spans, so that the time grows
    with text times the root of the spans."""
    seen, heads, ends = f"__seen_{name}", f"__heads_{name}", f"__ends_{name}"
    df = df.withColumn(ends, once(f"transform({spans}, x -> x.e)"))
    df = df.withColumn(seen, once(running(ends, "greatest(acc.at, x)")))
    with_seen = f"zip_with({spans}, {seen}, (x, p) -> named_struct('p', p, 's', x.s, 'r', x.r))"
    df = df.withColumn(heads, once(f"filter({with_seen}, x -> x.s >= x.p)"))
    if blank:  # what one covers is written before the text that follows it
        starts = f"slice(concat(array(0), transform({heads}, x -> x.s)), 1, size({heads}))"
        df = df.withColumn(heads, once(f"zip_with({heads}, {starts}, (x, q) -> named_struct('p', x.p, 's', x.s, 'r', repeat(' ', x.p - q)))"))
    width = f"cast(ceil(sqrt(size({heads}))) as int)"
    cut = f"transform(sequence(0, (size({heads}) - 1) div {width}), b -> slice({heads}, b * {width} + 1, {width}))"
    lo, hi = "element_at(h, 1).p", "element_at(h, -1).s"
    part = f"substring({text}, {lo} + 1, {hi} - {lo})"
    kept = f"substring(c, x.p - {lo} + 1, x.s - x.p)"
    filled = f"transform(array({part}), c -> array_join(transform(h, x -> {f'concat(x.r, {kept})' if blank else f'concat({kept}, x.r)'}), ''))"
    last = f"array_max({ends})"
    end = f"repeat(' ', {last} - element_at({heads}, -1).s)" if blank else "''"
    whole = f"concat(array_join(flatten(transform({cut}, h -> {filled})), ''), {end}, substring({text}, {last} + 1, char_length({text})))"
    return df.withColumn(name, once(f"if(size({spans}) = 0, {text}, {whole})")).drop(seen, heads, ends)
