"""Mixing, packing, quality rules and chat formatting on small and odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import chat, mixing, packing, quality
from tidewell.llm.queries import QUERIES

from .conftest import words

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n\t ", "one", "é ü x", "a b c a b c", "x\ny\nx\n \nx", "w " * 30000, "#*$ %&|<>", "one"]


def stats(text):
    ws = words(text)
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    inside = set()
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def test_statistics(spark, docs_of):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = quality.statistics(docs_of(texts)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        want = stats(text)
        assert {k: row["_quality"][k] for k in want} == want


def test_quality_query(spark):
    rows = QUERIES["op7_quality_rules"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        s = stats(docs[r["doc_id"]])
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_learned_list_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality.learn(x[:2000], bad[:2000], ["a", "b", "c"])
    hit = np.zeros(2000, bool)
    for rule in rules:
        hit |= quality._covered(rule, x[2000:], ["a", "b", "c"])
    assert (hit == bad[2000:]).mean() > 0.97
    assert quality.learn(x[:0], bad[:0], ["a", "b", "c"]) == []


def test_share_out():
    assert mixing.share_out([100, 100, 100], [5, 2, 1], 450) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.share_out([], [], 0) == []
    assert mixing.share_out([0, 10], [5, 2], 15) == [0, 15]


def test_fit_counts_is_exact_where_brute_force_is():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        got = mixing.fit_counts(lengths, counts, budget, 1)
        assert (got >= 0).all() and (got <= counts).all()
        base = np.floor(counts * (budget / (lengths * counts).sum())).astype(int)
        sums = {int((lengths * k).sum()) for k in itertools.product(*[range(b, c + 1) for b, c in zip(base, counts, strict=True)])}
        assert abs(int((lengths * got).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_mix(spark, docs_of):
    texts = [("a " * (i % 17 + 1), f"s{i % 5}") for i in range(600)] + [(None, None), ("", "s1"), ("b c", None), ("b c", None)]
    rows = mixing.mix(docs_of(texts)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    assert all(r["size"] == len(words(texts[r["doc_id"]][0])) and r["copies"] in (0, 1, 2) for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 2
    again = mixing.mix(docs_of(texts).repartition(7)).collect()
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in again}
    assert mixing.mix(docs_of([])).collect() == []


def test_mix_tells_rows_of_one_id_apart(spark):
    rows = [(7, f"w{i} x y", "src0") for i in range(101)] + [(8, "a b c", "src1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r["doc_id"], r["text"], r["copies"]) for r in mixing.mix(d, epochs=0.6).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and {c for _, _, c in runs[0]} >= {0, 1}


def test_op4_as_registered(spark):
    """The registered query against sizes, targets and words counted one by one."""
    import re

    from tidewell.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    sources = sorted({r["source"] for r in docs})
    own = {s: sum(size[r["doc_id"]] for r in docs if r["source"] == s) for s in sources}
    targets = mixing.share_out([own[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(own.values()))
    got = queries.QUERIES["op4_mixing"](spark, sf).collect()
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(docs)
    for s, target in zip(sources, targets, strict=True):
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == own[s] and r["target"] == pytest.approx(target) for r in mine)
        # Nothing comes nearer: all subset sums of the documents, as bits of one number.
        rest, reach = round(target % own[s]), 1
        for r in mine:
            reach |= reach << r["size"]
        nearest = min(abs(v - rest) for v in range(own[s] + 1) if reach >> v & 1)
        assert abs(sum(r["taken"] for r in mine) - target // own[s] * own[s] - rest) == nearest
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_bounds_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = np.zeros(13, int)
        counts[rng.integers(0, 13, 6)] = rng.integers(1, 9, 6)
        lengths = [n for n in range(13) if counts[n]]
        cost = lambda bounds: sum(counts[n] * (min(b for b in bounds if b >= n) - n) for n in lengths)
        got = packing.best_bounds(counts, 3)
        best = min(cost(c) for k in (1, 2, 3) for c in itertools.combinations(lengths, min(k, len(lengths))) if c[-1] == lengths[-1])
        assert cost(got) == best and len(got) <= 3
    assert packing.best_bounds(np.zeros(4, int), 3) == []


def test_pack(docs_of):
    texts = ODD + ["w " * (i % 50) for i in range(500)]
    docs = docs_of(texts).unionByName(docs_of(["dup dup"]))  # repeated id
    rows = packing.pack(docs, max_tokens=64, buckets=4, batch_tokens=256).collect()
    per_doc = Counter()
    for r in rows:
        per_doc[r["doc_id"]] += r["n_tokens"]
        assert 0 <= r["n_tokens"] <= r["bucket_tokens"] and r["padding"] == r["bucket_tokens"] - r["n_tokens"]
    assert per_doc == Counter({i: len(words(t)) + (2 if i == 0 else 0) for i, t in enumerate(texts)})
    batches = Counter((r["bucket_tokens"], r["batch"]) for r in rows)
    assert all(n * b <= 256 or n == 1 for (b, _), n in batches.items())
    assert len({(r["bucket_tokens"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    short = sum(1 for (b, _), n in batches.items() if n < 256 // max(b, 1))
    assert short <= len({b for b, _ in batches})
    assert packing.pack(docs_of([])).collect() == []


def test_chat_round_trip():
    rng = random.Random(9)
    t = chat.DEFAULT
    pieces = ["###", "# ", "</turn>\n", "\\", ": ", "User", "é", "\n", "### Assistant: ", "<", ""]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "odd: ###", ""]), "".join(rng.choices(pieces, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 6))]
        text, _, _, segments = chat.format_turns(turns, t)
        assert chat.read_turns(text, t) == turns
        assert "".join(text[s["start"] : s["start"] + s["length"]] for s in segments) == text
        loss = [t.show(text[s["start"] : s["start"] + s["length"]]) for s in segments if s["loss"]]
        assert loss == [x for role, x in turns if role == "assistant"]


def test_chat_roles_that_read_like_display_names(spark):
    """Raw role names, escaped ones and empty ones come back as they were."""
    t = chat.DEFAULT
    odd = ["Assistant", "assistant", "User", "\\User", "\\\\User", "System", "system", "", "#", "A", "Assistant: ", "</turn>\n"]
    turns = [(role, role) for role in odd]
    text, valid, wrong, segments = chat.format_turns(turns, t)
    assert chat.read_turns(text, t) == turns and (valid, wrong) == (False, 0)
    assert sum(s["loss"] for s in segments) == 1
    conv = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (row,) = chat.read_chat(chat.format_chat(conv)).collect()
    assert row["turns"] == "".join(f"{r}\n{x}\n" for r, x in turns) and row["loss_text"] == "assistant"


def test_chat_templates_that_cannot_be_read_back():
    for names in ({"a": "X", "b": "X"}, {"a": ""}, {"a": "#x"}, {"a": "\\x"}):
        with pytest.raises(ValueError, match="display names"):
            chat.Template(names=names)


def test_chat_machine():
    check = lambda *roles: chat.format_turns([(r, "x") for r in roles], chat.DEFAULT)[1:3]
    assert check("system", "user", "assistant", "user") == (True, None)
    assert check("user", "user") == (False, 1)
    assert check("assistant") == (False, 0)
    assert check("user", "tool", "assistant") == (False, 1)


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, 0, None, None), (2, None, "user", "z" * 300000)]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(conv)).collect()}
    assert got[1]["turns"] == "user\nq\nuser\nq\nassistant\n\n" and not got[1]["valid"]
    assert got[None]["turns"] == "\n\n" and got[2]["turns"] == "user\n" + "z" * 300000 + "\n"
    assert chat.format_chat(conv.limit(0)).collect() == []


def test_chat_query(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op8_chat_formatting"](spark, SF).collect()}
    said = r"\### Assistant: </turn> ok"
    assert rows[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
