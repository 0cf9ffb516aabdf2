import hashlib
import random
import re

from pyspark.sql import functions as F

from lexspark.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (key, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return (key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def moved(frame, rows):
    out = fim.fill_in_middle(frame(rows))
    return out.withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()


def check(frame, rows):
    got = moved(frame, rows)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted((expected(k, t) for k, t in rows), key=repr)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)
    return got


def test_odd_texts(frame, odd_rows):
    rng = random.Random(11)
    alphabet = ["a", "é\U0001d4d0", " ", "\n", "\t ", "$1", "\\", "<P", "<", ">", "S>", "\x85", "\xa0", "\x1c", "{2}"]
    rows = [*odd_rows, (None, None), (None, "some text here"), (50, "has <M> inside"), (50, "again"), (50, "again")]
    rows += [(100 + i, "".join(rng.choices(alphabet, k=rng.randint(1, 60)))) for i in range(400)]
    forms = {r["form"] for r in check(frame, rows)}
    assert forms == {"plain", "psm", "spm"}


def test_whole_table(sample, frame):
    check(frame, sample[0])


def test_very_long_texts(frame):
    """No recursion over tokens or characters: a million of either is one match."""
    keys = [k for k in range(200) if expected(k, "a b c")[2] != "plain"][:4]
    check(frame, [(keys[0], "ab " * 700_000), (keys[1], "x" * 2_000_000), (keys[2], " " * 1_500_000), (keys[3], "\n".join(["w"] * 500_000))])


def test_no_rows(frame):
    assert moved(frame, []) == []
