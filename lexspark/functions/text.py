"""Tokenizers, normalisers and rendering as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexspark import fixed_values as fv

_BLANKS = " \t\n\r\f\x0b"


def let(value: Column, body) -> Column:
    """Evaluates value once per row and hands it to body, which may use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s{2,}|[\t\n\x0B\f\r]", " "))  # a single blank is not replaced by itself


def matches_any(c: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    return F.coalesce(c, F.lit("")).rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(items)


# --- tokenizers ----------------------------------------------------------
def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(fv.WORD_PATTERN), F.lit(0))


def content_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(fv.CONTENT_WORD_PATTERN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(fv.CONTENT_STOP_WORDS))


def stem_tokens(c: Column) -> Column:
    return F.transform(word_tokens(c), lambda w: F.regexp_replace(w, r"(ing|ed|es|s)$", ""))


def lemma(w: Column) -> Column:
    n = F.length(w)
    keep = lambda drop: F.substr(w, F.lit(1), n - drop)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(keep(3), F.lit("y")))
        .when(w.endswith("s") & (n > 3) & ~w.endswith("ss"), keep(1))
        .when(w.endswith("ing") & (n > 5), keep(3))
        .when(w.endswith("ed") & (n > 4), keep(2))
        .otherwise(w)
    )


def plain_words(c: Column) -> Column:
    """Lower case, everything but letters, digits, _ and £ blanked, collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_£\p{L}\p{N}]+", " "))


def lemma_tokens(c: Column) -> Column:
    words = F.filter(F.split(plain_words(c), " "), lambda w: (w != "") & ~w.isin(fv.RELAXED_STOP_WORDS))
    return F.transform(words, lemma)


def citation_folded(c: Column) -> Column:
    """Lower case without '.' and '_', collapsed: 's.19' and 's19' compare equal."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[._]+", ""))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + fv.PLACEHOLDER_PATTERN)


# --- snippets and bullets ------------------------------------------------
def snippet(text: Column, hit: Column | None = None, max_chars: int = fv.SNIPPET_CHARS) -> Column:
    """Text around a hit given as a 0-based position (null: from the start)."""
    start = F.lit(0) if hit is None else F.greatest(F.lit(0), F.coalesce(hit - fv.SNIPPET_LEAD, F.lit(0)))
    raw = F.substr(text, start.cast("int") + 1, F.lit(max_chars))
    cut = F.when(F.length(raw) == max_chars, F.lit("…")).otherwise(F.lit(""))
    return F.coalesce(F.concat(squeeze(raw), cut), F.lit(""))


def preview(text: Column, max_chars: int) -> Column:
    return F.concat(
        F.substr(text, F.lit(1), F.lit(max_chars)),
        F.when(F.length(text) > max_chars, F.lit("…")).otherwise(F.lit("")),
    )


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def provision_bullet(cite: Column, title: Column, text: Column, *meta: Column) -> Column:
    body = preview(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 220)
    facts = F.concat_ws(", ", *[non_empty(m) for m in meta])
    return F.concat(F.lit("- **"), cite, F.lit("** — "), title, F.lit(". "), body, F.lit(" ("), facts, F.lit(")"))


def paragraphs(c: Column, min_chars: int = fv.MIN_PARAGRAPH_CHARS) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), strip)
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def is_repealed_or_empty(c: Column) -> Column:
    left = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s.…]+", "")
    return F.length(left) < fv.MIN_PROVISION_CHARS


# --- clean-up ------------------------------------------------------------
def scrub_marks(c: Column) -> Column:
    """Drops footnote marks, URLs and superscript tags."""
    for pattern in (r"\[[0-9]+(?:†)?\]", r"\(https?://\S+\)", r"https?://\S+", r"(?i)</?sup>"):
        c = F.regexp_replace(c, pattern, "")
    return c


def clean_context(c: Column) -> Column:
    without_thought = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(without_thought, r"(?i)</?json>", ""))


def fix_currency(c: Column) -> Column:
    return F.replace(c, F.lit("Â£"), F.lit("£"))


def clean_score(c: Column) -> Column:
    """Null for anything that is not a finite number."""
    d = c.cast("double")
    return F.when(F.isnan(d) | d.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(d)


def parse_score(c: Column) -> Column:
    """The same for text input."""
    return clean_score(c.try_cast("double"))


def alias_label(c: Column, aliases: dict[str, str], lower: bool) -> Column:
    base = F.lower(F.trim(c)) if lower else F.trim(c)
    out = base
    for alias, label in aliases.items():
        out = F.when(base == alias, F.lit(label)).otherwise(out)
    return out


def complexity_label(c: Column) -> Column:
    return alias_label(c, fv.COMPLEXITY_ALIASES, lower=True)


def compliance_label(c: Column) -> Column:
    return alias_label(c, fv.COMPLIANCE_ALIASES, lower=False)


# --- names ---------------------------------------------------------------
def slug(c: Column, keep_hyphen: bool = True) -> Column:
    """Lower-case slug: runs outside letters, digits (and '-') become '_'."""
    allowed = r"[^0-9A-Za-z\-]+" if keep_hyphen else r"[^0-9A-Za-z]+"
    return F.lower(F.btrim(F.regexp_replace(c, allowed, "_"), F.lit("_")))


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)


def file_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(file_stem(name), r"[^A-Za-z0-9]+", "_"), F.lit("_"))


def is_allowed_file(name: Column, extensions=fv.UPLOAD_EXTENSIONS) -> Column:
    has_dot = F.contains(name, F.lit("."))
    return has_dot & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions)


# --- joins of parts ------------------------------------------------------
def format_hits(hits: Column, max_chars: int | None = fv.SNIPPET_CHARS) -> Column:
    """Context blocks from a sorted array<struct<rank, doc_key, snippet>>."""
    blocks = F.transform(
        hits, lambda h: F.concat(F.lit("**Context ("), h["doc_key"], F.lit("):**\n"), h["snippet"], F.lit("\n\n"))
    )
    joined = F.array_join(blocks, "")
    return joined if max_chars is None else F.substr(joined, F.lit(1), F.lit(max_chars))


def instruction_record(instruction: Column, text: Column, response: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(non_empty(instruction), text), non_empty(response))
