"""Citation recognition, canonical forms and checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import distinct_in_order, let, matches_any, squeeze, strip

def _empty() -> Column:
    return F.lit("")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(group))


def _prefixed(numbers: Column, prefix: str) -> Column:
    return F.transform(numbers, lambda n: F.concat(F.lit(prefix), n))


def handbook_cite(match: Column) -> Column:
    """'cobs  4.2.1r' -> 'COBS 4.2.1R'."""
    book = F.upper(F.regexp_extract(match, r"^[A-Za-z]+", 0))
    number = F.regexp_extract(match, r"\d.*$", 0)
    tail_upper = F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.upper(F.right(number, F.lit(1))))
    return F.concat_ws(" ", book, tail_upper)


def extract_citations(text: Column, document: Column | None = None) -> Column:
    """Canonical citations in a text: statutes, handbook, then bare references
    read against the text's own document."""
    body = F.coalesce(text, _empty())
    found = [_prefixed(_all(body, qualified, 1), prefix) for _, prefix, qualified, _ in fv.STATUTES]
    found.append(F.transform(_all(body, fv.HANDBOOK_PATTERN, 0), handbook_cite))
    if document is not None:
        inside = F.array().cast("array<string>")
        for label, prefix, _, bare in fv.STATUTES:
            refs = _prefixed(_all(body, bare, 1), prefix)
            inside = F.when(document == fv.STATUTE_DOCUMENTS[label], refs).otherwise(inside)
        found.append(inside)
    return distinct_in_order(F.concat(*found))


def canonical_cite(label: Column, number: Column) -> Column:
    act = F.trim(F.translate(F.upper(label), "_-", "  "))
    out = F.concat_ws(" ", act, number)
    out = F.when(
        act.isin(fv.HANDBOOK_BOOKS),
        F.concat_ws(
            " ", act, F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.upper(F.right(number, F.lit(1))))
        ),
    ).otherwise(out)
    for name, prefix, _, _ in fv.STATUTES:
        spellings = [name, name.replace(" ", "")]
        out = F.when(act.isin(spellings), F.concat(F.lit(prefix), number)).otherwise(out)
    return out


def rewrite_citations(text: Column, idempotent: bool = False) -> Column:
    """Near-miss short forms to their strict form. The default keeps the known
    double suffix of the first rule; idempotent=True leaves full numbers alone."""
    out = text
    for i, (pattern, replacement) in enumerate(fv.CITATION_REWRITES):
        used = fv.IDEMPOTENT_FIRST_REWRITE if idempotent and i == 0 else pattern
        out = F.regexp_replace(out, "(?i)" + used, replacement)
    return F.regexp_replace(out, r"[ \t]+", " ")


def answer_citations(answer: Column) -> Column:
    return let(rewrite_citations(answer), lambda t: extract_citations(t))


def on_allow_list(c: Column, mode: str = "strict") -> Column:
    patterns = {"strict": fv.ALLOW_STRICT, "lenient": fv.ALLOW_LENIENT, "relaxed": fv.ALLOW_RELAXED}[mode]
    return matches_any(c, patterns)


def has_bad_token(c: Column) -> Column:
    return matches_any(c, fv.BAD_TOKENS)


def invalid_citations(text: Column, mode: str = "strict") -> Column:
    """Fragments that name a known book but are malformed, distinct in order."""
    body = F.coalesce(text, _empty())
    pieces = F.transform(F.split(body, fv.CANDIDATE_SPLIT), strip)
    if mode == "strict":
        bracketed = F.regexp_extract_all(body, F.lit("(?md)" + fv.BRACKET_SNIPPET), F.lit(1))
        pieces = F.concat(bracketed, F.filter(pieces, lambda p: F.length(p) >= 3))
        pieces = F.transform(pieces, squeeze)
        books = fv.STRICT_BOOK_NAMES
    else:
        pieces = F.filter(pieces, lambda p: p != "")
        books = fv.LENIENT_BOOK_NAMES
    # a look at one letter spares most places of a piece the list of books
    first = "".join(sorted({b[0] for b in books.split("|")}))
    named = F.filter(pieces, lambda p: p.rlike(f"(?i)(?=[{first}])(?:{books})"))
    return distinct_in_order(F.filter(named, lambda p: has_bad_token(p) | ~on_allow_list(p, mode)))


def has_source_line(answer: Column) -> Column:
    return strip(F.coalesce(answer, _empty())).rlike(r"(?md)^Source:\s")


def policy_penalty(answer: Column) -> Column:
    missing = F.when(has_source_line(answer), F.lit(0.0)).otherwise(F.lit(0.5))
    linked = F.when(F.coalesce(answer, _empty()).rlike(r"https?://"), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), missing + linked)


def normalise_source_token(token: Column) -> Column:
    """The token's canonical spelling; blanks and case are settled once per token, not once per rule."""

    def spelled(s: Column) -> Column:
        t, low = s["t"], s["low"]
        out = F.when(low.startswith("mar "), F.concat(F.lit("UK MAR "), F.regexp_extract(t, r"^\S+ (.*)$", 1))).otherwise(t)
        out = F.when(low.rlike(r"^psr\s*reg\.?\s*77$"), F.lit("PSR 2017 reg.77")).otherwise(out)
        out = F.when(low.rlike(r"^mlr\s*reg\.?\s*27$"), F.lit("MLR 2017 reg.27")).otherwise(out)
        for alias, cite in fv.CITATION_ALIASES.items():
            out = F.when(low == alias, F.lit(cite)).otherwise(out)
        return out

    return let(let(squeeze(token), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))), spelled)


# every pattern of the relaxed list starts with one of these letters, so the list is tried at few places of a text
_RELAXED = "(?i)(?=[" + "".join(sorted({p[0] for p in fv.ALLOW_RELAXED})) + "])(?:" + "|".join(f"(?:{p})" for p in fv.ALLOW_RELAXED) + ")"


def relaxed_matches(answer: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(answer, _empty()), F.lit(_RELAXED), F.lit(0))


def has_relaxed_match(answer: Column) -> Column:
    return F.coalesce(answer, _empty()).rlike(_RELAXED)


def first_distinct_ignoring_case(items: Column) -> Column:
    """Keeps the first spelling of each item when case is ignored."""

    def first_ones(s: Column) -> Column:
        return F.filter(s["items"], lambda x, i: F.array_position(s["folded"], F.lower(x)) == i + 1)

    return let(F.struct(items.alias("items"), F.transform(items, F.lower).alias("folded")), first_ones)


def source_line(answer: Column) -> Column:
    """The text after 'Source:', else the first four distinct citations."""
    body = F.coalesce(answer, _empty())
    line = strip(F.regexp_extract(body, "(?imd)" + fv.SOURCE_LINE_PATTERN, 1))
    second = strip(F.regexp_extract(body, "(?imd)" + fv.SOURCE_LINE_FALLBACK, 1))
    cites = F.slice(first_distinct_ignoring_case(F.transform(relaxed_matches(body), normalise_source_token)), 1, 4)
    return F.when(line != "", line).when(second != "", second).otherwise(F.array_join(cites, " | "))


def first_citation(answer: Column) -> Column:
    pattern = "(?i)" + "|".join(fv.FIRST_CITATION)
    return F.regexp_extract(F.coalesce(answer, _empty()), pattern, 0)


def legislation_cite(short_doc: Column, kind: Column, number: Column) -> Column:
    return F.concat(short_doc, F.lit(" "), kind, F.lit("."), number)


def legislation_id(source_slug: Column, kind: Column, number: Column) -> Column:
    return F.concat(F.replace(F.upper(source_slug), F.lit("_"), F.lit("")), F.lit("_"), kind, number)


def file_module(stem: Column, folder: Column) -> Column:
    """Module of a page-text file from its name and folder."""
    up = F.upper(stem)
    return (
        F.when((folder == "fca") & up.isin(fv.HANDBOOK_FILE_STEMS), up)
        .when(folder == "fca", F.lit("FCA"))
        .when(folder == "pra_pdfs", F.lit("PRA"))
        .otherwise(F.upper(folder))
    )


def file_regulator(folder: Column) -> Column:
    return F.when(folder == "pra_pdfs", F.lit("PRA")).otherwise(F.lit("FCA"))


def invalid_footer(text: Column, invalid: Column) -> Column:
    return F.concat(text, F.when(F.size(invalid) > 0, F.lit(fv.INVALID_FOOTER)).otherwise(_empty()))


def ungrounded_footer(unverified: Column) -> Column:
    quoted = F.transform(F.slice(unverified, 1, 3), lambda c: F.concat(F.lit("`"), c, F.lit("`")))
    return F.when(
        F.size(unverified) > 0, F.concat(F.lit(fv.UNGROUNDED_FOOTER), F.array_join(quoted, ", "), F.lit("."))
    ).otherwise(_empty())
