"""Column expressions over text: tokens, intents, labels and numbers. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Null where empty, for joining texts."""
    return F.nullif(text, F.lit(""))


def joined(sep: str, *texts: Column) -> Column:
    """The non-empty texts, joined."""
    return F.concat_ws(sep, *[filled(t) for t in texts])


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def contained(text: Column, terms: list[str]) -> Column:
    """The terms that a text contains, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def table_intent(question: Column) -> Column:
    """struct(detected, score, matches). Words match whole, with an optional plural s."""
    q = F.lower(question)
    explicit = F.filter(F.array(*[F.lit(t) for t in V.TABLE_WORDS]), lambda t: F.call_function("regexp_like", q, F.concat(F.lit(r"\b"), t, F.lit(r"s?\b"))))
    numeric = F.array_sort(F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b20[0-9][0-9]\b|\$|%|\bbillion\b|\bmillion\b"), F.lit(0))))
    financial = contained(q, V.TABLE_FINANCIAL)
    matches = F.array_distinct(F.concat(explicit, numeric, financial))
    detected = (F.size(explicit) > 0) | ((F.size(numeric) > 0) & (F.size(financial) > 0))
    return F.struct(detected.alias("detected"), F.size(matches).alias("score"), matches.alias("matches"))


def visual_intent(question: Column) -> Column:
    """struct(detected, score, matches). A term that ends in a dot matches only where a word follows it at once."""
    q = F.lower(question)
    found = [F.when(F.call_function("regexp_like", q, F.lit(r"\b" + t.replace(".", r"\.") + r"s?\b")), F.lit(t)) for t in V.VISUAL_TERMS]
    matches = F.array_compact(F.array(*found))
    explicit = F.arrays_overlap(matches, F.array(*[F.lit(t) for t in V.VISUAL_EXPLICIT]))
    shown = F.array_contains(matches, "shown") & contains_any(q, V.VISUAL_SHOWN_WITH)
    return F.struct((F.coalesce(explicit, F.lit(False)) | shown).alias("detected"), F.size(matches).alias("score"), matches.alias("matches"))


def evidence_mode(category: Column, expected_type: Column) -> Column:
    """F8: mixed goes to auto, then visual words by substring, then table, else text."""
    both = F.lower(F.concat_ws(" ", category, expected_type))
    visual = contains_any(both, ["chart", "visual", "figure", "image", "graph"])
    return F.when(both.contains("mixed"), "auto").when(visual, "visual").when(both.contains("table"), "table").otherwise("text")


def _declines(answer: Column, contractions: list[tuple[str, str]], phrases: list[str]) -> Column:
    text = F.lower(answer)
    for a, b in contractions:
        text = F.replace(text, F.lit(a), F.lit(b))
    return contains_any(text, phrases)


def abstains_in_query(answer: Column) -> Column:
    """F3. Phrases with "don't" never match, since contractions are written out first."""
    return _declines(answer, V.QUERY_CONTRACTIONS, V.QUERY_ABSTENTIONS)


def abstains_in_evaluation(answer: Column) -> Column:
    """as F3 with more phrases, after curly quotes are made straight."""
    return _declines(F.translate(answer, "’‘", "''"), V.EVAL_CONTRACTIONS, V.EVAL_ABSTENTIONS)


def citation_ids(answer: Column) -> Column:
    """Distinct citations such as [C1], upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"(?i)\[([CTV][0-9]+)\]"), F.lit(1)), F.upper)))


def page_label(first: Column, last: Column) -> Column:
    """A-b, a, or unknown; 0 and null count as missing."""
    a, b = F.nullif(first, F.lit(0)), F.nullif(last, F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).when(F.coalesce(a, b).isNotNull(), F.coalesce(a, b).cast("string")).otherwise("unknown")


def source_label(filename: Column, first: Column, last: Column, part: Column) -> Column:
    """P10."""
    return F.concat(filename, F.lit(", page(s) "), page_label(first, last), F.lit(", "), part)


def basename(path: Column) -> Column:
    """P13."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def under(path: Column, root: str) -> Column:
    """whether a normal path is the root or lies under it."""
    r = root.rstrip("/")
    return (path == r) | path.startswith(r + "/")


def display_path(path: Column, root: str) -> Column:
    """Relative to the root where it lies under it, with forward slashes."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), root.rstrip("/")
    return F.when(p == r, ".").when(under(p, r), F.substr(p, F.lit(len(r) + 2))).otherwise(p)


def chunk_index(chunk_id: Column) -> Column:
    """The number in an id such as 0123456789ab:text:0007; null if there is none."""
    return F.regexp_extract(chunk_id, r":text:([0-9]+)$", 1).try_cast("int")


def evidence_id(content_hash: Column, kind: str, index: Column) -> Column:
    """Ids such as 0123456789ab:text:0007."""
    return F.concat(F.substring(content_hash, 1, 12), F.lit(f":{kind}:"), F.lpad(index.cast("string"), 4, "0"))


def figure_label(text: Column) -> Column:
    """The first label such as Figure 2, capitalised; null if none."""
    kind, number = F.regexp_extract(text, r"\b" + V.FIGURE_LABEL.replace("(?i)", "(?i:", 1) + ")", 1), F.regexp_extract(text, r"\b" + V.FIGURE_LABEL.replace("(?i)", "(?i:", 1) + ")", 2)
    return F.when(number != "", F.concat(F.initcap(kind), F.lit(" "), number))


def token_recall(expected: Column, observed: Column) -> Column:
    """|E and O| / |E| over sets of tokens, to 4 places; 0 where nothing is expected."""
    e, o = F.array_distinct(tokens(expected)), F.array_distinct(tokens(observed))
    return F.when(F.size(e) > 0, F.bround(F.size(F.array_intersect(e, o)) / F.size(e), 4)).otherwise(F.lit(0.0))


def numeric(token: Column) -> Column:
    """A cell's number: null for '', -, a long dash, NA and NM; negative in parentheses; $ , % dropped."""
    t = F.trim(token)
    bare = F.trim(F.regexp_replace(t, r"[$,%()]", ""))
    value = F.when(F.call_function("regexp_like", bare, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")), bare.try_cast("double"))
    return F.when(F.upper(t).isin("", "-", "—", "NA", "NM"), None).when(t.startswith("(") & t.endswith(")"), -value).otherwise(value)


def line_numbers(line: Column) -> Column:
    """The number tokens of a line, in order."""
    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(V.CELL_NUMBER), F.lit(0)), lambda t: F.trim(t)), lambda t: numeric(t).isNotNull())


def unit(line: Column, context: Column) -> Column:
    l, c = F.lower(line), F.lower(F.concat_ws("\n", line, context))
    return (
        F.when(l.contains("%"), "percent").when(c.contains("in millions"), "million").when(c.contains("in billions"), "billion")
        .when(c.contains("trillion"), "trillion").when(c.contains("billion"), "billion").when(c.contains("million"), "million")
    )


def display_value(value: Column, token: Column, unit_: Column) -> Column:
    """1,234 or 1,234.50 with % or $ and the unit."""
    number = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.when(token.contains("%"), F.concat(number, F.lit("%"))).otherwise(F.concat(F.lit("$"), number, F.coalesce(F.concat(F.lit(" "), unit_), F.lit(""))))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-.]", "_")
