"""Fill-in-middle: prefix, middle and suffix of a text change places, cut at tokens by one regular-expression match a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the contract: a token with the blanks before it (or blanks that end the text), and the three marks.
# Quantifiers are possessive: a token never gives characters back, so a match walks the text once.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _cut(units_before: Column, units_between: Column) -> Column:
    """The row's pattern: so many tokens, so many more, and the rest, from the start of the text."""
    group = lambda n: F.concat(F.lit(f"({UNIT}{{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"(?s)\A"), group(units_before), group(units_between), F.lit("(.*+)"))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output), one row per row of docs.

    Draws come from the hash of seed and key, so they need no order and repeat
    on every run: `rate` percent of the texts are transformed, `spm` percent of
    those with the suffix first. A null text is empty, a null key hashes as an
    empty one; empty texts and texts holding a mark stay plain. Rows that repeat
    a key get the same draws. Other columns are ignored. Texts of any length are
    matched iteratively and whole; empty docs give no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("key"), body.alias("body"), F.regexp_count(body, F.lit(UNIT)).cast("long").alias("n"), digest.alias("digest"))
    draw = lambda i: F.conv(F.substring("digest", 8 * i - 7, 8), 16, 10).cast("long")
    units = F.col("n") + 1
    marked = F.contains("body", F.lit(PREFIX)) | F.contains("body", F.lit(SUFFIX)) | F.contains("body", F.lit(MIDDLE))
    form = F.when((F.col("body") == "") | marked | (draw(3) % 100 >= rate), "plain").when(draw(4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("key", "body", "n", form.alias("form"), F.least(draw(1) % units, draw(2) % units).alias("a"), F.greatest(draw(1) % units, draw(2) % units).alias("b"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    moved = F.regexp_replace("body", _cut(F.col("a"), F.col("b") - F.col("a")), order)
    rows = rows.select("key", "n", "form", F.when(F.col("form") == "plain", F.col("body")).otherwise(moved).alias("output"))
    size = lambda part: F.when(F.col("form") != "plain", F.char_length(part).cast("long"))
    part = parts(F.col("output"), F.col("form"))
    return rows.select(F.col("key").alias(key), "n", "form", size(part[0]).alias("prefix_chars"), size(part[1]).alias("middle_chars"), "output")


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output whose form is not plain.

    The text holds none of the marks and no mark can overlap another, so the
    first place of each mark is the one that was set.
    """
    at = lambda mark: F.position(F.lit(mark), output)
    between = lambda start, mark: F.substr(output, start + 3, at(mark) - start - 3)
    spm = form == "spm"
    rest = lambda start: F.substr(output, start + 3, F.char_length(output))
    return (F.when(spm, between(at(PREFIX), MIDDLE)).otherwise(between(at(PREFIX), SUFFIX)), rest(at(MIDDLE)),
            F.when(spm, between(at(SUFFIX), PREFIX)).otherwise(between(at(SUFFIX), MIDDLE)))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output, from output and form alone."""
    prefix, middle, suffix = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
