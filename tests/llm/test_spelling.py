from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OUT = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_groups(counts):
    links = {w: [o for o in counts if near(w, o)] for w in counts}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(links[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def grouped(df):
    return sorted([tuple(r) for r in spelling.group_variants(df).select(*OUT).collect()], key=lambda r: r[0])


def variants(rng, words, n):
    out = set(words)
    while len(out) < n:
        w = rng.choice(sorted(out)[:200])
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        c = rng.choice("abcé")
        w = w[:at] + c + w[at:] if kind == 0 else w[:at] + (c if kind == 1 else "") + w[at + 1 :]
        if len(w) >= 7:
            out.add(w)
    return sorted(out)


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ASKED_ROWS", 3)
    rng = random.Random(5)
    seeds = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 12))) for _ in range(40)]
    words = variants(rng, seeds, 700) + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "bababab"]
    words = sorted(set(words))
    df = spark.createDataFrame([(w, rng.choice([2, 3, 25, 400, 5000])) for w in words], "word string, n long")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
    found = sorted(tuple(r) for r in spelling.near_pairs(df).collect())
    assert len(want) > 500 and found == want
    assert grouped(df) == brute_groups({r["word"]: r["n"] for r in df.collect()})


def test_every_edit_is_found(spark):
    words = set()
    for w in ["abcdéfg", "aaaabbb", "zyxwvuts", "abababababab", "qzabcdefghij"]:
        words.add(w)
        for i in range(len(w) + 1):
            for c in "aqé":
                words |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
    assert sorted(tuple(r) for r in spelling.near_pairs(df).collect()) == want


def test_pivots_do_not_overlap_and_are_cheapest(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(7, 10))) for _ in range(300)})
    known = spelling.with_prefixes(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    for r in known:
        prefix = sorted((g["rank"], g["at"], g["count"]) for g in r["prefix"])[:3]
        pairs = [a[2] + b[2] for a in prefix for b in prefix if b[1] - a[1] >= 2]
        first, second = sorted(r["pivots"], key=lambda g: g["at"])
        assert second["at"] - first["at"] >= 2 and first["count"] + second["count"] == min(pairs)


def test_chain_of_forms(spark):
    rows = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("abcdefghijk", 20000), ("xbcdefghijk", 3)]
    out = {r[0]: r for r in grouped(spark.createDataFrame(rows, "word string, n long"))}
    assert all(r[2] == "abcdefghijk" for r in out.values())
    assert out["abcdefg"][1] == "abcdefgh" and out["abcdefghijk"][1] is None


def test_texts_ties_and_edges(spark):
    rng = random.Random(2)
    base = ["Straßenbahn", "Überraschung", "understanding", "internationale", "ünterstanding", "ABCDEFG", "abcdefg"]
    docs = []
    for i in range(300):
        words = [rng.choice(base + ["short", "x", "a-b"]) for _ in range(40)]
        words = [w[:-1] + rng.choice("nsg") if rng.random() < 0.05 else w for w in words]
        docs.append((i, rng.choice([" ", ", ", "\n", "9"]).join(words)))
    docs += [(None, "understandinh understandinh"), (7, None), (8, ""), (9, "understanding " * 30000), (10, docs[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(0), "_run": F.lit(1)})
    counts = brute_counts(docs)
    found = spelling.word_counts(df)
    assert {r["word"]: r["n"] for r in found.collect()} == counts
    assert grouped(found) == brute_groups(counts)
    assert grouped(spelling.word_counts(df.limit(0))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_counts(docs)
    found = queries.QUERIES["op13_spelling_variants"](spark, sf).select(*OUT).collect()
    assert sorted([tuple(r) for r in found], key=lambda r: r[0]) == brute_groups(counts)
