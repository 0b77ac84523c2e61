"""Line dedup and license scan against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import exchange, licenses, lines
from tidewell.llm.queries import QUERIES

from .conftest import words
from .test_near import groups

SF = "/root/testdata/sf0.01"


def grams(line, k=8):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute_lines(texts):
    """Class (doc, line) of every line with a word."""
    every = [(i, j, line) for i, t in enumerate(texts) for j, line in enumerate((t or "").split("\n")) if words(line)]
    distinct = list(dict.fromkeys(line for *_, line in every))
    sets = [grams(x) for x in distinct]
    index = {}
    for n, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(n)
    links = []
    for n, s in enumerate(sets):
        both = {}
        for g in s:
            for m in index[g]:
                if m < n:
                    both[m] = both.get(m, 0) + 1
        links += [(n, m) for m, c in both.items() if c >= 0.8 * (len(s) + len(sets[m]) - c)]
    root = dict(zip(distinct, groups(len(distinct), links), strict=True))
    first, out = {}, {}
    for i, j, line in every:
        out[i, j] = first.setdefault(root[line], (i, j))
    return out, len(links)


def got_lines(df):
    return {(r["doc_id"], r["line"]): (r["class_doc"], r["class_line"]) for r in df.collect()}


def test_line_query(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want, links = brute_lines(texts)
    got = got_lines(QUERIES["op2_line_dedup"](spark, SF))
    assert got.keys() == want.keys() and links > 20
    assert sum(got[k] != want[k] for k in want) <= 0.002 * len(want)


@pytest.mark.parametrize("group", [512, 4])
def test_near_lines(spark, docs_of, monkeypatch, group):
    monkeypatch.setattr(exchange, "UNIT_BYTES", (4000, 4000))
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lines, "GROUP", group)
    rng = random.Random(6)
    base = [" ".join("".join(rng.choices("abcdeéü", k=rng.randint(2, 7))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    hot = " ".join("".join(rng.choices("xyzuvw", k=5)) for _ in range(40))

    def edit(line):
        i = rng.randrange(len(line))
        return line[:i] + "Q" + line[i + 1 :]

    texts = ["\n".join(rng.choice([rng.choice(base), edit(rng.choice(base)), edit(hot), hot, "", " \t", "a"]) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    texts += [None, "", "\n", "one line", "one line", "z" * 20000, "z" * 20001]
    want, _ = brute_lines(texts)
    df = docs_of(texts).withColumn("key", F.lit(1)).withColumn("line", F.lit(2)).withColumn("_gone", F.lit(3))
    got = got_lines(lines.classes(df))
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)
    kept = {r["doc_id"]: r for r in lines.keep_first(df).collect()}
    for i, t in enumerate(texts):
        stay = [x for j, x in enumerate((t or "").split("\n")) if got.get((i, j), (i, j)) == (i, j)]
        assert kept[i]["text"] == (None if t is None else "\n".join(stay)) and kept[i]["_gone"] == 3
    assert lines.keep_first(df.limit(0)).collect() == []


def linked(rows):
    """The set of components (as frozensets of ids) that links span."""
    ids = sorted({k for r in rows for k in r})
    at = {k: i for i, k in enumerate(ids)}
    root, out = groups(len(ids), [(at[a], at[b]) for a, b in rows]), {}
    for k in ids:
        out.setdefault(root[at[k]], set()).add(k)
    return {frozenset(s) for s in out.values()}


def test_parts_of_a_large_bucket_meet(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        line = "".join(rng.choices("abcdefgh ", k=120))
        texts += [line, line[:-1] + "Q"]
    rows = [(i.to_bytes(16, "big"), t, [7, 8] if i % 3 else [7]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key binary, text string, bands array<long>")
    sets = [grams(t) for t in texts]
    close = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = [tuple(int.from_bytes(k, "big") for k in r) for r in lines.links(df, group=4).collect()]
    assert linked(got) == linked(close) and len(close) == 30
    assert linked(got) == linked([tuple(int.from_bytes(k, "big") for k in r) for r in lines.links(df, group=512).collect()])


def test_group_is_read_when_called(spark, monkeypatch):
    """Split buckets link every close pair without tolerance; the cells repeat links."""
    monkeypatch.setattr(lines, "GROUP", 4)
    rng = random.Random(13)
    hot = "".join(rng.choices("abcdefgh ", k=200))
    texts = [hot[:i] + "Q" + hot[i + 1 :] for i in range(10, 50)]
    single = ["".join(rng.choices("ijklmn ", k=90)) for _ in range(15)]
    texts += single + [t + "Q" for t in single]
    rows = [(i.to_bytes(16, "big"), t, [7]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key binary, text string, bands array<long>")
    sets = [grams(t) for t in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = [tuple(int.from_bytes(k, "big") for k in r) for r in lines.links(df).collect()]
    assert linked(got) == linked(close)
    assert len(got) > 39 + 15  # more than one forest of the whole bucket


def test_null_ids(spark, docs_of):
    df = docs_of(["same line here", "same line here"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    rows = {r["doc_id"]: r["text"] for r in lines.keep_first(df).collect()}
    assert rows == {None: "same line here", 1: ""}


def tokens(text):
    out = [w.strip(".,;:!?()[]{}\"'") or "" for w in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return [w for w in out if w]


def brute_licenses(text, templates):
    ws, out = tokens(text), {}
    for name, body in templates.items():
        t = tokens(body)
        k = min(5, len(t))
        want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        for s in range(max(1, len(ws) - len(t) + 1)) if len(ws) >= k else []:
            part = ws[s : s + len(t)]
            share = len(want & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) / len(want)
            if share >= 0.8 and share > out.get(name, (0, 0))[1]:
                out[name] = (s, share)
    return out


def test_license_query(spark):
    got = {}
    for r in QUERIES["op3_license_scan"](spark, SF).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["first_word"], pytest.approx(r["containment"]))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r["doc_id"]: brute_licenses(r["text"], licenses.TEMPLATES) for r in docs if "icense" in r["text"]}
    assert got == {i: m for i, m in want.items() if m} and got


def test_licenses_in_long_and_odd_texts(spark, docs_of):
    rng = random.Random(8)
    texts = []
    for body in licenses.TEMPLATES.values():
        ws = body.split()
        for drop in (0, 1, 2):
            part = list(ws)
            for _ in range(drop):
                part[rng.randrange(len(part))] = "other"
            texts.append("so " * rng.randint(0, 30) + "\n" + " ".join(part).upper() + ". and" * rng.randint(0, 30))
    texts += [None, "", ".", "mit", texts[0] * 50, "word " * 50000 + licenses.TEMPLATES["MIT grant"]]
    df = docs_of(texts).withColumn("license", F.lit(1)).unionByName(docs_of([texts[0]]).withColumn("license", F.lit(1)))
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["first_word"], pytest.approx(r["containment"]))
    want = {i: brute_licenses(t, licenses.TEMPLATES) for i, t in enumerate(texts)}
    assert got == {i: m for i, m in want.items() if m}
    assert licenses.scan(df.limit(0)).collect() == [] and licenses.scan(df, {}).collect() == []


def test_bands_find_what_they_promise():
    rng = np.random.default_rng(2)
    hit = 0
    for _ in range(200):
        shared, own = rng.integers(1, 1 << 62, 80).astype(np.uint64), rng.integers(1, 1 << 62, 40).astype(np.uint64)
        sign = lambda g: np.array([s.min() for s in licenses._signs(g, licenses._SEEDS)]).reshape(licenses.BANDS, -1)
        a, b = sign(np.concatenate([shared, own[:20]])), sign(np.concatenate([shared, own[20:]]))
        hit += (a == b).all(1).any()
    assert hit >= 199


def test_line_bands_are_those_of_the_line_alone():
    texts = ["abc def ghi\nxyz", "short\nabc def ghi", "é" * 30]
    found = lines.Lines(pa.array(texts))
    alone = [lines.Lines(pa.array([x])) for t in texts for x in t.split("\n")]
    assert (found.bands() == np.concatenate([x.bands() for x in alone])).all()
    assert found.keys().to_pylist() == [x.keys().to_pylist()[0] for x in alone]


def test_candidates_look_at_texts_once(monkeypatch):
    """Lines are signed in one pass; of a second one only blocks with a wanted line are decoded."""
    texts = [f"line {i} of a text\nénd {i % 3}\n\n{'x' * 2000}" for i in range(200)]
    docs = pa.table({"doc_id": list(range(200)), "text": texts})
    made = []
    plain = lines.Lines.__init__
    monkeypatch.setattr(lines.Lines, "__init__", lambda self, column: (made.append(len(column)), plain(self, column))[1])
    signed = lines._signed(docs)
    assert sum(made) == 200 and len(made) > 1
    wanted = np.array([0, 2, len(signed.key) - 1])
    keys, found = lines._texts(docs, signed, wanted)
    assert found == ["line 0 of a text", "x" * 2000, "line 199 of a text"] and sum(made) == 200
    every = lines.Lines(pa.array(texts))
    known = dict(zip(every.keys().to_pylist(), (every.points[i:j].tobytes().decode("utf-32-le") for i, j in zip(every.starts, every.ends))))
    assert [known[k] for k in keys] == found
    assert lines._texts(docs, signed, wanted[:0]) == ([], [])
