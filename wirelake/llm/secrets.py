r"""Secret scans: sliding-window entropy per character class, in DataFrame
operations.

Base kinds (assign, access, hex) are found by linear-time patterns and blanked,
as are known harmless parts (``HARMLESS``: UUIDs, counted-up digits, repeats of
one character). Candidate strings are the runs of at least ``WINDOW`` characters
of the base64 and url alphabets in what is left, so that a secret beside such a
part is still seen. A candidate belongs to a class by the characters it holds. A
window of ``WINDOW`` characters slides over it; the counts of the window's
characters and the sum of c log2 c change by the character that leaves and the
one that enters, so a step costs the same wherever it is. A candidate whose
highest window entropy reaches its class's threshold is a span of kind
``entropy``, unless the allow-list matches it as a whole. Base spans always stay.

Cases: null texts equal empty ones and have no spans. Repeated rows are scanned
each. Ties do not occur: spans are ordered by start, then kind. An empty table
gives no rows. Only id and text are read, so clashing names do no harm. Very
long texts, candidates and numbers of matches are scanned whole, in time that
is linear in the text for each pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .spans import literal, once, with_replaced, with_spans

WINDOW = 20

#: kind -> (pattern, cheap necessary condition, test of a match)
KINDS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*+[:=]\x20*+[\x22\x27]?[A-Za-z0-9+/_.=-]++", "{t} rlike '(?i)password|passwd|secret|token|api_?key'", r"$v rlike r'[A-Za-z0-9+/_.=-]{6}$' and char_length(regexp_extract($v, r'^(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*+[:=]\x20*+[\x22\x27]?([A-Za-z0-9+/_.=-]++)$', 1)) >= 6"),
    "access": (r"AKIA[A-Z0-9]++", "contains({t}, 'AKIA')", "char_length($v) >= 20"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", "{t} rlike '[0-9a-f]{{24}}'", "true"),
}

#: (class, characters, least window entropy in bits); the first that fits counts.
#: Twenty random characters have about 2.9, 3.3, 3.8, 4.0 and 4.1 bits in these
#: classes, with a deviation of 0.1; words and numbers that people write have less.
CLASSES = (
    ("digits", "[0-9]", 2.65),
    ("hex", "[0-9a-f]|[0-9A-F]", 3.0),
    ("one case", "[a-z]|[A-Z]", 3.55),
    ("letters", "[A-Za-z]", 3.85),
    ("base64", "[A-Za-z0-9+/_=-]", 3.75),
)

#: Parts that are no secret wherever they stand; they are blanked.
HARMLESS = r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])|0?(?:1234567890)+(?:12345678|1234567|123456|12345|1234|123|12|1)?|(?i:abcdefghijklmnopqrstuvwxyz)|([A-Za-z0-9+/_=-])\1{7,}+"
#: Whole candidates that are no secret: words joined by marks (with short numbers
#: between), named digests, placeholders, and keys that a provider's documents show.
_WORD = "(?:[A-Z]?[a-z]{1,14}+|[A-Z]{1,14}+|[0-9]{1,4}+)"
ALLOW = (
    rf"^{_WORD}?(?:[-_/=+]++{_WORD}?+)++$",
    r"^(?i:sha(?:1|256|384|512)|md5)[-=]",
    r"^(?i:(?:my|your|the|this|is|api|access|an?|example|sample|dummy|placeholder|changeme|redacted|secret|token|key|password|value|here|x{3,}+)[-_/=+]*+)++$",
    "^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
)

RUN = "[A-Za-z0-9+/_=-]"


def _bind(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entropy(v: str) -> str:
    """SQL: the highest entropy of a window over ``v``. Characters go by their
    number among the distinct ones, so the counts are as many as these."""
    weight = "if({k} > 1, {k} * log2({k}), 0D)".format
    start = f"transform(sequence(1, size(__d)), a -> size(filter(slice(__c, 1, {WINDOW}), z -> z = a)))"
    total = f"aggregate(__k, 0D, (t, k) -> t + {weight(k='k')})"
    leaves, enters = f"element_at(__c, i - {WINDOW})", "element_at(__c, i)"
    down, up = f"element_at(acc.k, {leaves})", f"element_at(acc.k, {enters})"
    sum_ = f"acc.s - {weight(k=down)} + {weight(k=f'({down} - 1)')} - {weight(k=up)} + {weight(k=f'({up} + 1)')}"
    step = f"""if({leaves} = {enters}, acc, named_struct(
        'k', transform(acc.k, (n, j) -> n - if(j + 1 = {leaves}, 1, 0) + if(j + 1 = {enters}, 1, 0)),
        's', {sum_}, 'least', least(acc.least, {sum_})))"""
    slide = f"if(size(__c) <= {WINDOW}, __s, aggregate(sequence({WINDOW + 1}, size(__c)), named_struct('k', __k, 's', __s, 'least', __s), (acc, i) -> {step}, acc -> acc.least))"
    best = f"log2({WINDOW}D) - {slide} / {WINDOW}"
    numbered = "transform(__v, z -> cast(array_position(__d, z) as int))"
    return _bind("__v", f"split({v}, '')", _bind("__d", "array_distinct(__v)", _bind("__c", numbered, _bind("__k", start, _bind("__s", total, best)))))


def _of_class(v: str, chars: str, least: float) -> str:
    return f"when {v} rlike '^(?:{'|'.join(f'(?:{c})+' for c in chars.split('|'))})$' then {least}D"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, entropy) for every row: spans by kind."""
    rows = docs.select("doc_id", text_or_empty().alias("__t"))
    for kind, (pattern, guard, keep) in KINDS.items():
        rows = with_spans(rows, kind, "__t", pattern, guard.format(t="__t"), keep)
    # only texts with a run that is long enough are looked at further
    rows = rows.withColumn("long", once(f"__t rlike '{RUN}{{{WINDOW}}}'"))
    rows = with_spans(rows, "harmless", "__t", HARMLESS, "long")
    blank = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'r', ''))" for k in (*KINDS, "harmless"))
    rows = rows.withColumn("blank", once(f"if(long, array_sort(concat({blank})), cast(array() as array<struct<s:int,e:int,r:string>>))"))
    rows = with_replaced(rows, "left", "__t", "blank", blank=True)
    allowed = " or ".join(f"$v rlike {literal(p)}" for p in ALLOW)
    rows = with_spans(rows, "runs", "left", rf"(?<!{RUN}){RUN}{{{WINDOW},}}+", "long", f"not ({allowed})")
    rows = rows.withColumn("bits", once(f"transform(runs, x -> case {' '.join(_of_class('x.v', chars, least) for _, chars, least in CLASSES)} end)"))
    # so many different characters a window with that entropy has to hold
    able = "size(array_distinct(split(x.v, ''))) >= pow(2D, get(bits, i)) - 1e-9"
    high = f"filter(runs, (x, i) -> {able} and {_entropy('x.v')} >= get(bits, i))"
    # stored, so that what is done with the spans isn't planned together with them
    return stored(rows.select("doc_id", *KINDS, once(high).alias("entropy")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: spans ordered by start, then kind as listed."""

    def listed(kinds) -> str:
        each = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'd', concat('{k}:', x.s, ':', x.e)))" for i, k in enumerate(kinds))
        return f"array_join(transform(array_sort(concat({each})), x -> x.d), ',')"

    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.expr(f"sha2({listed(KINDS)}, 256)").alias("base_sha256"),
        F.expr(listed([*KINDS, "entropy"])).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
