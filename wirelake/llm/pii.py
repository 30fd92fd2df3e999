r"""Personal data: information-theoretic sanitisation, in DataFrame operations.

Base kinds (email, ip, card, phone) are found by linear-time patterns. The
values found are the protected entities. The corpus then tells which terms
reveal them. All counts are of documents: n_e that hold the entity, n_t that
hold the term, n_te that hold both (the term outside base spans, anywhere in the
text), N in all. A term's disclosure is its pointwise mutual information with
the entity over the entity's own information,

    log(N n_te / (n_t n_e)) / log(N / n_e),

1 where the term never occurs without the entity, at most 1 always. A term at or
above ``DISCLOSURE`` for any entity is protected in every document that holds
it, as a span of kind ``term``. Entities and pairs count from ``MIN_SUPPORT``
contexts: a term's context is the words beside it, a document's the least of its
terms' contexts, by hash in ``CONTEXTS`` classes. So copies of a text or passage,
edited ones mostly too, are one context and no evidence of their own.

``redact`` generalises base values to their kind and removes revealing terms.

The counting is skipped where no entity has the support. Texts are not shuffled
for it: words are taken where the text is read. Terms too frequent to reach the
threshold with any entity, n_t > n_e^d N^(1-d), or held by fewer documents than
the support asks for are left out before pairs are formed, which changes nothing.

Cases: null texts equal empty ones and have no spans. Repeated rows and ties
count as often as they occur (their contexts once). Empty tables give no rows;
columns of any other name are kept by ``redact``. Null ids are kept. Very long
texts and any number of matches are searched whole, in linear time per pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, text_or_empty
from .spans import NONE, described, once, with_replaced, with_spans

MIN_SUPPORT = 3
DISCLOSURE = 0.8
CONTEXTS = 64

_DIGITS = "regexp_replace($v, '[^0-9]', '')"
_PART = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LUHN = f"""pmod(aggregate(sequence(0, char_length({_DIGITS}) - 1), 0, (t, i) -> t
    + (1 + i % 2) * cast(substr({_DIGITS}, char_length({_DIGITS}) - i, 1) as int)
    - if(i % 2 = 1 and cast(substr({_DIGITS}, char_length({_DIGITS}) - i, 1) as int) > 4, 9, 0)), 10) = 0"""

#: kind -> (pattern, cheap necessary condition, test of a match, written over $v).
#: An email can start where a run of its characters or the last match ends.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "{t} rlike '[0-9]\\\\.[0-9]'", f"$v rlike r'^{_PART}(\\.{_PART}){{3}}$'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "{t} rlike '[0-9](?:[ -]?[0-9]){{15}}'", f"case when char_length({_DIGITS}) between 16 and 19 then {_LUHN} else false end"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", f"char_length({_DIGITS}) between 8 and 15"),
}


def _based(df: DataFrame, text: str = "__t", prefix: str = "") -> DataFrame:
    """Adds the spans of each kind, as columns named by ``prefix`` and kind."""
    for kind, (pattern, guard, keep) in KINDS.items():
        df = with_spans(df, prefix + kind, text, pattern, guard.format(t=text), keep)
    return df


def _words(text: str) -> str:
    """SQL: the terms of ``text`` in order: lower-case words of three letters or more."""
    return rf"filter(split(lower({text}), r'[^\p{{L}}]+'), y -> char_length(y) > 2)"


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, email, ip, card, phone, entities, words): per row the
    spans by kind; where there are any, the distinct entities and the distinct
    terms outside the spans, each with the least of its contexts."""
    rows = docs.select("doc_id", text_or_empty().alias("__t")).withColumn("text_key", F.xxhash64("__t"))
    rows = _based(rows)
    value = {"email": "lower(x.v)", "ip": "x.v", "card": _DIGITS.replace("$v", "x.v"), "phone": _DIGITS.replace("$v", "x.v")}
    each = ", ".join(f"transform({k}, x -> concat('{k}:', {value[k]}))" for k in KINDS)
    blank = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'r', ''))" for k in KINDS)
    rows = with_replaced(rows.withColumn("blank", once(f"array_sort(concat({blank}))")), "outside", "__t", "blank", blank=True)
    rows = rows.withColumn("seq", once(f"if(size(blank) > 0, {_words('outside')}, cast(array() as array<string>))"))
    rows = rows.withColumn("placed", once("array_sort(transform(seq, (w, i) -> named_struct('term', w, 'c', xxhash64(get(seq, i - 1), get(seq, i + 1)))))"))
    words = "filter(placed, (x, i) -> i = 0 or x.term <> get(placed, i - 1).term)"
    return rows.select("doc_id", "text_key", *KINDS, F.expr(f"array_distinct(concat({each}))").alias("entities"), F.expr(words).alias("words"))


def _supported(context: str) -> list:
    """Aggregates: documents, and classes of contexts."""
    seen = F.expr(f"bit_count(bit_or(shiftleft(1L, cast(pmod({context}, {CONTEXTS}) as int))))")
    return [F.count("*").alias("n"), seen.alias("n_ctx")]


def disclosed(docs: DataFrame, base: DataFrame, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame | None:
    """(entity, term, n_e, n_t, n_te, n_all, disclosure): the terms that reveal
    an entity; None where no entity has the support. ``base`` is stored."""
    held = stored(base.where("size(entities) > 0").select("entities", "words").withColumn("row", F.monotonically_increasing_id()))
    least = F.expr("coalesce(array_min(transform(words, x -> x.c)), 0L)")
    seen = held.select("row", least.alias("m"), F.explode("entities").alias("entity"))
    support = seen.groupBy("entity").agg(*_supported("m")).where(F.col("n_ctx") >= min_support)
    n_all = docs.count()
    # an entity in every document carries no information that a term could reveal
    entities = stored(support.where(F.col("n") < n_all).select("entity", F.col("n").alias("n_e")))
    most = entities.agg(F.max("n_e")).first()[0]
    if most is None:
        return None

    def bound(n_e: str) -> str:
        return f"pow({n_e}, {disclosure}D) * pow({n_all}D, {1 - disclosure}D) * (1 + 1e-9)"

    every = docs.select(F.explode(F.array_distinct(F.expr(_words("coalesce(text, '')")))).alias("term"))
    terms = every.groupBy("term").agg(F.count("*").alias("n_t")).where(f"n_t >= {min_support} and n_t <= {bound(f'{most}D')}")
    known = seen.join(entities, "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "n_e")).alias("known"))  # one text's entities
    words = held.join(known, "row").select("known", F.inline("words"))
    met = words.join(stored(terms), "term").select("term", "n_t", "c", F.explode(F.expr(f"filter(known, k -> n_t <= {bound('k.n_e')})")).alias("k"))
    pairs = met.select("term", "n_t", "k.*", "c").groupBy("entity", "term", "n_e", "n_t").agg(*_supported("c")).where(F.col("n_ctx") >= min_support)
    pairs = pairs.select("entity", "term", "n_e", "n_t", F.col("n").alias("n_te"), F.lit(n_all).alias("n_all"))
    measure = F.expr("ln(1D * n_all * n_te / (1D * n_t * n_e)) / ln(1D * n_all / n_e)")
    return stored(pairs.withColumn("disclosure", measure).where(F.col("disclosure") >= disclosure - 1e-12))


def _with_terms(docs: DataFrame, base: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_key, term): spans of revealing terms, outside base spans,
    one row per document and text that has any."""
    texts = docs.select("doc_id", text_or_empty().alias("__t")).withColumn("text_key", F.xxhash64("__t"))
    terms = small(stored(found.select("term").distinct()))
    hits = texts.select("doc_id", "text_key", F.explode(F.array_distinct(F.expr(_words("__t")))).alias("term")).join(terms, "term", "left_semi")
    by_row = stored(hits.groupBy("doc_id", "text_key").agg(F.collect_set("term").alias("terms")))
    by_row = by_row.select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "terms")
    taken = base.select("doc_id", "text_key", F.concat(*KINDS).alias("base")).where("size(base) > 0").dropDuplicates(["doc_id", "text_key"])
    taken = stored(taken.join(small(by_row), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left_semi"))
    by_row = by_row.join(taken, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left").select("i", "k", "terms", "base")
    rows = texts.join(small(stored(by_row)), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["i", "k"])
    # base spans are blanked, so that words inside and beside them are told apart
    blank = f"array_sort(transform(coalesce(base, {NONE}), x -> named_struct('s', x.s, 'e', x.e, 'r', '')))"
    rows = with_replaced(rows.withColumn("blank", once(blank)), "outside", "__t", "blank", blank=True)
    rows = with_spans(rows, "words", "outside", r"\p{L}++", "true", "array_contains(terms, lower($v))")
    return stored(rows.select("doc_id", "text_key", F.col("words").alias("term"))).where("size(term) > 0")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, email, ip, card, phone, term) for every row."""
    docs = docs.select("doc_id", "text")
    base = stored(base_spans(docs))
    found = disclosed(docs, base)
    base = base.select("doc_id", "text_key", *KINDS)
    none = F.slice("email", 1, 0)
    if found is None or found.isEmpty():
        return base.withColumn("term", none)
    extra = _with_terms(docs, base, found).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "term")
    joined = base.join(small(extra), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left").drop("i", "k")
    return joined.withColumn("term", F.coalesce("term", none))


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``; in ``text`` base values are generalised to
    ``<KIND>`` and revealing terms to ``<TERM>``; ``n_chars`` follows."""
    columns = docs.columns
    plain = docs.select("doc_id", "text")
    base = stored(base_spans(plain))
    found = disclosed(plain, base)
    rows = docs.select("doc_id", F.struct(*columns).alias("row"), text_or_empty().alias("__t"))
    if found is not None and not found.isEmpty():
        extra = _with_terms(plain, base, found).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "term")
        rows = rows.withColumn("text_key", F.xxhash64("__t"))
        rows = rows.join(small(extra), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    else:
        rows = rows.withColumn("term", F.expr(NONE))
    rows = _based(rows)
    marks = ", ".join(f"transform(coalesce({k}, {NONE}), x -> named_struct('s', x.s, 'e', x.e, 'r', '<{k.upper()}>'))" for k in (*KINDS, "term"))
    rows = rows.withColumn("marks", once(f"array_sort(concat({marks}))"))
    rows = with_replaced(rows, "changed", "__t", "marks")
    touched = F.size("marks") > 0

    def column(c: str):
        if c == "text":
            return F.when(touched, F.col("changed")).otherwise(F.col("row.text")).alias(c)
        if c == "n_chars":
            return F.when(touched, F.char_length("changed").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return rows.select(*map(column, columns))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.concat(*(described(k, k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, described("term", "term"))).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )
