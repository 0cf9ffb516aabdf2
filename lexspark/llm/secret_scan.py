"""Secrets in texts: strong spans, and weak candidates that complementary parts nearby confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspark.llm.common import unused
from lexspark.session import cut_lineage

# fixed values: kinds in order, their patterns, and what a match must hold to count
KINDS = ["assign", "access", "hex", "login", "key", "endpoint"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "login": r"""(?i:username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""",
    "key": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+",
    "endpoint": r"""https?://[^\x00-\x20"'<>]{4,}|(?<![0-9.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9.])""",
}
# part that a kind plays: an identifier, a secret or an endpoint
PARTS = {"assign": "s", "access": "i", "hex": "s", "login": "i", "key": "s", "endpoint": "e"}
WEAK = ["login", "key", "endpoint"]
SCOPE = 200
_BLOCK = 512


def match_spans(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, spans struct<s, e>) of a pattern in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so their
    lengths give the offsets. Running sums are taken in blocks of _BLOCK
    matches, so time stays linear in the number of matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def spans(pieces: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.char_length(p).alias("gap"), F.char_length(h).alias("own")))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, _BLOCK))
        sized = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["own"]).alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sized, start, lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def inside(b: Column, at: Column) -> Column:
            zero = F.struct(at.alias("at"), empty.alias("out"))
            return F.aggregate(b["b"], zero, lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["own"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["own"]).alias("e")))).alias("out")), lambda a: a["out"])

        return F.flatten(F.zip_with(sized, begins, inside))

    found = text.rlike(pattern)
    return (F.when(found, hits).otherwise(F.array().cast("array<string>")),
            F.when(found, spans(F.split(text, pattern, -1))).otherwise(empty))


def _kept(kind: str, hits: Column, spans: Column) -> Column:
    """Spans of the matches that count, with the kind's number."""
    number = KINDS.index(kind)
    tagged = F.zip_with(spans, hits, lambda s, h: F.struct(s["s"].alias("s"), F.lit(number).alias("kind"), s["e"].alias("e"), h.alias("h")))
    if kind == "assign":
        tagged = F.filter(tagged, lambda x: F.char_length(F.regexp_extract(x["h"], ASSIGN, 1)) >= 12)
    elif kind == "access":
        tagged = F.filter(tagged, lambda x: F.char_length(x["h"]) >= 18)
    elif kind == "key":
        tagged = F.filter(tagged, lambda x: x["h"].rlike("[0-9]") & x["h"].rlike("[a-z]") & x["h"].rlike("[A-Z]"))
    return F.transform(tagged, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))


def span_list(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, text_key, n_assign, n_access, n_hex, base, extra), one row per row of docs; base and extra are arrays of
    struct<s, kind, e> in code points.

    base holds the strong kinds. extra holds weak candidates whose complementary
    parts start within `scope` code points: a login needs a secret, a bare key
    an identifier or an endpoint, an endpoint both an identifier and a secret
    (strong spans are parts too). Weak candidates may overlap strong spans.

    Starts are put into buckets of `scope`; a bucket keeps the smallest and
    largest start of each part, and a candidate meets its own bucket and the
    two beside it, so the interval join emits three rows a candidate at most,
    whatever a document repeats. Null and empty texts have no spans. Rows with
    equal key and text share their result; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.struct(F.xxhash64(F.col(key), body).alias("a"), F.xxhash64(body, F.col(key), F.lit(1)).alias("b")).alias("text_key"), body.alias("_t"))
    for kind in KINDS:
        hits, spans = match_spans(F.col("_t"), PATTERNS[kind])
        rows = rows.withColumn(f"_{kind}", _kept(kind, hits, spans))
    scanned = cut_lineage(rows.drop("_t"))
    strong = [k for k in KINDS if k not in WEAK]
    base = scanned.select(key, "text_key", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in strong], F.array_sort(F.concat(*[f"_{k}" for k in strong])).alias("base"))

    some = scanned.where(F.size(F.concat(*[f"_{k}" for k in WEAK])) > 0)
    parts = some.select("text_key", F.explode(F.concat(*[f"_{k}" for k in KINDS])).alias("x")).select(
        "text_key", "x", F.floor(F.col("x.s") / scope).alias("bucket"), F.get(F.array(*[F.lit(PARTS[k]) for k in KINDS]), F.col("x.kind")).alias("part"))
    ends = parts.groupBy("text_key", "bucket").agg(*[f(F.when(F.col("part") == p, F.col("x.s"))).alias(f"{p}_{n}") for p in "ise" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    weak = parts.where(F.col("x.kind") >= KINDS.index(WEAK[0])).select("text_key", "x", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"))
    near = {p: F.max(F.coalesce((F.col(f"{p}_lo") <= F.col("x.s") + scope) & (F.col(f"{p}_hi") >= F.col("x.s") - scope), F.lit(False))) for p in "ise"}
    met = weak.join(ends, ["text_key", "bucket"]).groupBy("text_key", "x").agg(*[c.alias(p) for p, c in near.items()])
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("x.kind"))
    linked = met.where(((kind == "login") & F.col("s")) | ((kind == "key") & (F.col("i") | F.col("e"))) | ((kind == "endpoint") & F.col("i") & F.col("s")))
    extra = linked.groupBy("text_key").agg(F.array_sort(F.collect_set("x")).alias("extra"))
    nothing = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    return base.join(extra, "text_key", "left").withColumn("extra", F.coalesce("extra", nothing))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every found span of `text` replaced by `mark` (overlapping and touching spans by one).

    Columns and row count stay. Texts without a span, null ones included, are unchanged.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tag, of, found = (unused(docs, name) for name in ("text_hash", "hash_of_spans", "found_spans"))
    spans = scan_secrets(docs, key, text).where(F.size(F.concat("base", "extra")) > 0).select(
        F.col("text_key").alias(of), F.array_sort(F.concat("base", "extra")).alias(found)).dropDuplicates([of])
    tagged = docs.withColumn(tag, F.struct(F.xxhash64(F.col(key), body).alias("a"), F.xxhash64(body, F.col(key), F.lit(1)).alias("b"))).join(spans, F.col(tag) == F.col(of), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(a: Column, x: Column) -> Column:
        piece = F.substring(F.col(text), a["at"] + 1, x["s"] - a["at"])
        fresh = (x["s"] > a["at"]) | (F.size(a["out"]) == 0)
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    pieces = F.aggregate(found, start, cut, lambda a: F.concat(a["out"], F.array(F.substring(F.col(text), a["at"] + 1, F.char_length(F.col(text))))))
    return tagged.withColumn(text, F.when(F.col(found).isNotNull(), F.array_join(pieces, mark)).otherwise(F.col(text))).select(*docs.columns)
