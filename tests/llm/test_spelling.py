"""Spelling variants against every pair of words."""

import random
import zlib
from collections import Counter

from ledgerloom.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute(counts):
    out = {}
    for w, n in counts.items():
        found = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = found[0][1] if found and -found[0][0] >= 2 * n else None
        out[w] = [form, w, n, len(found), counts[form] if form else None]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def groups(spark, counts):
    rows = spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_groups_equal_brute_force(spark):
    rng = random.Random(11)
    counts = {}
    for _ in range(900):  # three letters: halves and quarters repeat, runs of one letter shift onto themselves
        counts["".join(rng.choices("abé", k=rng.randint(5, 9)))] = rng.choice([3, 4, 6, 12, 24, 50, 100, 200])
    want = brute(counts)
    assert groups(spark, counts) == want
    assert max(row[3] for row in want.values()) > 10 and any(w != r[1] != r[0] for w, r in want.items())


def test_a_word_with_very_many_variants_and_long_words(spark):
    base = "international"
    counts = {base: 10_000} | {base[:i] + c + base[i + 1 :]: 3 + (i * 7 + ord(c)) % 5 for i in range(13) for c in "qxzvjwkyüö"}
    counts |= {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 25)}
    got = groups(spark, counts)
    assert got == brute(counts) and got[base][3] == 130
    assert got["aaaaa"][1] == "a" * 24  # a way of twenty steps


def test_words_of_texts(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["Hello", "hello2hello", "Écoles", "école", "na-ïveté", "WORLDWIDE", "worıd", "x×yyyyy", "the"], k=60))) for i in range(40)]
    docs += [(None, "Hello Hello worldwide"), (50, None), (51, ""), (52, "hello " * 20000), (52, "hello " * 20000)]
    import re

    want = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling._UPPER, spelling._LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            want[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    rows = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, word string, n long")
    got = {r.word: r.n for r in spelling.counted(spelling.misspelt(spelling.runs(rows))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.spelling_groups(spelling.counted(spelling.misspelt(spelling.runs(rows.limit(0))))).count() == 0
