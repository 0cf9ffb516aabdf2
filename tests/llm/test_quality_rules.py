import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexspark.llm import quality_rules as qr

BLANKS = r"[\x20\x09-\x0D]"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def features_of(text):
    n, chars, symbols, dup, rep, _ = counts(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    capitals = len(re.findall("[A-Z]", text or ""))
    ratio = lambda a, b, by=100.0: by * a / b if b else None
    return dict(symbols=ratio(symbols, n), long_words=ratio(chars, n, 1.0), short_words=None if not n else -1.0 * chars / n,
                duplicate_lines=ratio(dup, lines), repeated_words=ratio(rep, n), capitals=ratio(capitals, chars))


def tail(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0


def brute(rows, labels):
    """(doc_id, ..., kept) of every row, as the guarantee is stated."""
    quality = {}
    for k, q in labels:
        if k is not None and q is not None:
            quality[k] = max(q, quality.get(k, 0))
    strata = {lang for k, _, lang in rows if k in quality}
    cut = {}
    for lang in strata:
        mine = [(quality[k] > 0, features_of(t)) for k, t, g in rows if k in quality and g == lang]
        good_total = sum(g for g, _ in mine)
        for rule in qr.RULES:
            best = None
            for c in rule.grid:
                hit = [g for g, f in mine if f[rule.name] is not None and f[rule.name] > c]
                good, bad = sum(hit), len(hit) - sum(hit)
                if hit and tail(good, good_total, qr.ALPHA / len(qr.RULES)) > qr.DELTA / (len(strata) * len(qr.RULES)):
                    break
                if hit and bad > good and (best is None or bad - good > best[0]):
                    best = (bad - good, c)
            if best:
                cut[lang, rule.name] = best[1]
    out = []
    for k, t, lang in rows:
        f, base = features_of(t), counts(t)
        lost = any(f[r.name] is not None and (lang, r.name) in cut and f[r.name] > cut[lang, r.name] for r in qr.RULES)
        out.append((k, *base, not base[-1] and not lost))
    return out, cut


def judged(spark, rows, labels):
    docs = spark.createDataFrame([(k, t, g, "x", "y") for k, t, g in rows], "doc_id long, text string, lang string, body string, n_words string")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    table = spark.createDataFrame([(k, q, 1) for k, q in labels], "doc_id long, quality int, lang int")
    return sorted((tuple(r[n] for n in names) for r in qr.judge(docs, table).collect()), key=repr)


def test_counts_of_odd_texts(spark, odd_rows):
    lines = "one two\n\n one two\none two\n \t\n\x0b\none two"
    loop = "a b c d e f g h i j k " * 6
    rows = [*[(k, t, "en") for k, t in odd_rows], (40, lines, None), (41, loop, "en"), (42, loop + "x " * 90, "en"), (41, loop, "en"), (None, "#*$%&|<> AÉ", "en"),
            (43, " ".join(map(str, range(20))), "en"), (44, " ".join(map(str, range(19))), "en"), (45, "a a a a a a a a a", "en"), (46, "\U0001d4d0 éÉ \x85 \xa0", "en")]
    want, _ = brute(rows, [])
    assert judged(spark, rows, []) == sorted(want, key=repr)


def test_cutoffs_are_those_of_the_exact_test(spark):
    rng = random.Random(9)
    words = [f"w{i:03d}" for i in range(400)]
    text = lambda symbols, caps: " ".join(w + "#" * (rng.random() < symbols) for w in (x.upper() if rng.random() < caps else x for x in rng.choices(words, k=40)))
    rows, labels = [], []
    for i in range(2400):
        lang = ("en", "fr", None, "rare")[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2 if i % 100 > 10 else 3]
        bad = i % 7 == 0
        rows.append((i, text(rng.choice([0.3, 0.6, 0.9]) if bad else rng.choice([0, 0, 0, 0.1]), rng.choice([0, 0.9]) if bad else 0.02), lang))
        labels.append((i, int(not bad)))
    labels += [(5, 0), (5, None), (None, 1), (10**7, 1)]  # 5 is good in one row and bad in another
    want, cut = brute(rows, labels)
    assert judged(spark, rows, labels) == sorted(want, key=repr)
    assert ("en", "symbols") in cut and not any(lang == "rare" for lang, _ in cut)
    good = [w[-1] for w, (k, _, g) in zip(sorted(want, key=lambda w: w[0]), rows) if k % 7]
    assert sum(good) >= 0.95 * len(good)


@pytest.mark.parametrize("n", [0, 1, 15, 60, 3000, 200_000])
def test_binomial_tail(spark, n):
    p = 0.01
    ks = sorted({k for k in (0, 1, 2, n // 400, n // 200, n // 120, n // 101, n // 100, n) if k <= n})
    got = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select("k", qr.binomial_tail(F.col("k"), F.col("n"), p).alias("x")).collect()
    for r in got:
        if r["k"] >= n * p:
            assert r["x"] == 1.0
        else:
            logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(r["k"] + 1)]
            exact = math.fsum(map(math.exp, logs))
            assert r["x"] == pytest.approx(exact, rel=1e-6, abs=1e-300)


def test_no_rows_and_no_labels(spark):
    assert judged(spark, [], []) == []
    assert judged(spark, [(1, "w " * 10, "en")], [(1, 1)])[0][-1] is False
