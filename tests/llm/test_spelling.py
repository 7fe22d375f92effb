"""Spelling groups against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

from tideline.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_by_hand(rows, least=5, length=6, every=199):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= length
    return {w: n for w, n in found.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_by_hand(n, factor=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def words(rng, letters, many, longest):
    """Random words over few letters, so that most have neighbours, and edits of them."""
    out = set()
    while len(out) < many:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, longest)))
        out.add(w)
        i = rng.randrange(len(w) + 1)
        out |= {w[:i] + rng.choice(letters) + w[i:], (w[:i] + w[i + 1 :]) or "a", w + rng.choice(letters)}
    return sorted(out)


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(3)
    n = {w: rng.choice([5, 6, 30, 31, 200, 1200]) for w in [*words(rng, "ab", 120, 8), *words(rng, "abé\U0001f600", 250, 14), "a" * 40, "a" * 41, "a" * 20 + "b" + "a" * 20]}
    frame = spark.createDataFrame(list(n.items()), "word string, n long").selectExpr("word", "n", "1 AS size", "'x' AS near", "2 AS id", "true AS back")
    assert got(spelling.spelling_groups(frame)) == groups_by_hand(n)


def test_long_words_around_the_border_and_very_long_ones(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abc") for _ in range(size)) for size in (62, 63, 64, 65, 66, 300)]
    n = {}
    for base in bases:
        for _ in range(6):
            i = rng.randrange(len(base))
            n |= {base: 400, base[:i] + "z" + base[i + 1 :]: 9, base[:i] + base[i + 1 :]: 7, base[:i] + "y" + base[i:]: 6}
    n |= {"q" * 100_000: 500, "q" * 99_999: 5, "q" * 70_000 + "x" + "q" * 29_999: 6}
    want = groups_by_hand({w: k for w, k in n.items() if len(w) < 1000})
    want |= {"q" * 100_000: (None, "q" * 100_000, 500, 2, None), "q" * 99_999: ("q" * 100_000, "q" * 100_000, 5, 1, 500), "q" * 70_000 + "x" + "q" * 29_999: ("q" * 100_000, "q" * 100_000, 6, 2, 500)}
    # without its x, the last word is the second
    want["q" * 99_999] = ("q" * 100_000, "q" * 100_000, 5, 2, 500)
    assert got(spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"))) == want


def test_whole_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    stems = ["Straße", "straßen", "mention", "mentions", "mentian", "Ünderung", "ünderung", "kettle", "kettles", "settle", "×÷×÷×÷", "short"]
    rows = [(i, " ".join(rng.choices(stems, k=60)) + rng.choice(["\n", "", "9", "-kettle_kettles"])) for i in range(150)]
    rows += [(None, "kettle " * 300), (None, None), (7, ""), (7, None), *[rows[0]] * 3, (10**12, "settle" * 30_000), (5, "x" * 200_000)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS word", "3 AS n", "'b' AS run").write.parquet(path)
    n = counts_by_hand(rows)
    assert any(len(w) < 7 for w in n) and "straße" in n
    assert got(spelling.op11(spark, str(tmp_path))) == groups_by_hand(n)


def test_empty_tables_nulls_and_repeated_words(spark):
    assert got(spelling.spelling_groups(spark.createDataFrame([], "word string, n long"))) == {}
    rows = [("kettle", 3), ("kettle", 4), (None, 9), ("", 9), ("kettles", None), ("kettlé", 35), ("kettlf", 35)]
    made = got(spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")))
    # ties go to the first in code-point order
    assert made["kettle"] == ("kettlf", "kettlf", 7, 3, 35)
    assert made["kettles"] == ("kettle", "kettlf", 0, 1, 7)
    assert set(made) == {"kettle", "kettles", "kettlé", "kettlf"}
