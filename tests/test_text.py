"""Text, personal data, replies and policy columns on literal cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions import replies, scoring, text, urls, vectors
from tidewell.operators import pii
from tidewell.operators.drift import is_drift
from tidewell.operators.filters import json_contains, metadata_contains


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("score of 27. 3 points", "score of 27.3 points"),
        ("rate = 0. 1", "rate = 0.1"),
        ("transla-\ntion tool", "translation tool"),
        ("(a1,. , an)", "(a1, ..., an)"),
        ("far   too\tmany    gaps", "far too many gaps"),
        ("a\n\n\n\nb  ", "a\n\nb"),
        ("x  y", "x y"),
    ],
)
def test_normalize(one, raw, clean):
    assert one(text.normalize_extracted(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(
    ("raw", "n", "clean"),
    [
        ("runs in parallel 5.", 5, "Runs in parallel [5]."),
        ("links between them 15.", 5, "Links between them [1][5]."),
        ("links between them 15.", 4, "Links between them 15."),
        ("took 12 hours.", 5, "Took 12 hours."),
        ("Based on the provided context, the tool uses hashing 1.", 3, "The tool uses hashing [1]."),
        ("claim 2.", 0, "Claim 2."),
        ("a 1, b 2; c 9:", 2, "A [1], b [2]; c 9:"),
    ],
)
def test_clean_answer(one, raw, n, clean):
    assert one(text.clean_answer(F.col("t"), F.col("n")), t=raw, n=n) == clean


@pytest.mark.parametrize(
    ("answer", "refusal"),
    [
        ("I don't know from this context.", True),
        ("That is NOT PRESENT here.", True),
        ("I cannot answer that.", True),
        ("There is no information on it.", True),
        ("I'm unable to find it.", True),
        ("Revenue rose in the third quarter.", False),
        ("The engineer joined in 2015.", False),
    ],
)
def test_refusal(one, answer, refusal):
    assert one(text.is_refusal(F.col("t")), t=answer) is refusal


@pytest.mark.parametrize(
    ("q", "simple"),
    [
        ("What is this?", True),
        ("Could you tell me all about the loop and how it makes things better over time?", False),
        ("What is the main model that is used for long completions?", True),
        ("please compare one two three four five", True),
        ("please compare one, two three four five", False),
    ],
)
def test_simple_query(one, q, simple):
    assert one(text.is_simple_query(F.col("t")), t=q) is simple


def test_dedupe_queries(one):
    got = one(text.dedupe_queries(F.col("t"), F.col("q")), t="first one\n2. second\n\n- third", q="How?")
    assert got == ["How?", "first one", "second", "third"]
    assert one(text.dedupe_queries(F.col("t"), F.col("q")), t="a\nHow?\nb\nc\nd", q="How?") == ["a", "How?", "b", "c"]


def test_answer_blocks(one):
    got = one(text.answer_blocks(F.col("t")), t="Intro\n- a\n- b\n1. c\n\n* d\nend\n\n- e")
    assert [(b["type"], b["items"]) for b in got] == [
        ("p", ["Intro"]), ("ul", ["a", "b"]), ("ol", ["c"]), ("ul", ["d"]), ("p", ["end"]), ("ul", ["e"]),
    ]


def test_answer_blocks_of_a_long_answer(spark, one):
    answer = "\n".join(line for i in range(400) for line in (f"p{i}", f"- a{i}", f"* b{i}", "", f"{i}. c{i}", " "))
    got = one(text.answer_blocks(F.col("t")), t=answer)
    want = [b for i in range(400) for b in (("p", [f"p{i}"]), ("ul", [f"a{i}", f"b{i}"]), ("ol", [f"c{i}"]))]
    assert [(b["type"], b["items"]) for b in got] == want
    assert one(text.answer_blocks(F.lit(None).cast("string"))) is None
    assert one(text.answer_blocks(F.lit(" \n"))) == []
    # Lines are found once: an expression that is named again inside a lambda runs once per line.
    plan = spark.range(1).select(text.answer_blocks(F.col("id").cast("string")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_excerpt(one):
    assert one(text.excerpt_heading(F.col("t")), t="## **Abstract**\nbody") == "Abstract"
    assert one(text.excerpt_body(F.col("t")), t="## **Abstract**\n body ") == "body"
    assert one(text.excerpt_body(F.col("t")), t="introduction") == "introduction"
    assert one(text.excerpt_heading(F.col("t")), t="abstract ideas\nbody") == "Excerpt"


def _mask(spark, value, **options):
    row = pii.mask_pii(spark.createDataFrame([(value,)], "t string"), "t", **options).first()
    return row["masked"], row["pii_count"]


def test_mask_of_a_long_run_without_findings(spark):
    # The pattern of addresses looks on from every letter to the end of a run.
    began = time.perf_counter()
    assert _mask(spark, "a" * 200_000) == ("a" * 200_000, 0)
    assert time.perf_counter() - began < 20
    assert _mask(spark, "\u0663" * 8) == ("[PHONE]", 1)
    assert _mask(spark, "b@c.de b@c.de 4111 1111 1111 1111 at 10.0.0.1", order=("credit_card", "email", "ip")) == (
        "[EMAIL] [EMAIL] [CREDIT_CARD] at [IP]", 4,
    )
    assert _mask(spark, None) == (None, 0)


def test_mask(spark):
    assert _mask(spark, "write to jo.ann@example.com from 10.20.30.40") == ("write to [EMAIL] from [IP]", 2)
    # The phone rule comes first and leaves one digit of a card.
    assert _mask(spark, "4785380592391139") == ("[PHONE]9", 1)
    assert _mask(spark, "123-45-6789") == ("[SSN_AADHAAR]", 1)
    order = ("credit_card", "email", "phone", "ssn_aadhaar", "ip")
    assert _mask(spark, "card 4111 1111 1111 1111.", order=order) == ("card [CREDIT_CARD].", 1)
    masked, n = _mask(spark, "card 4111 1111 1111 1112.", order=order)
    assert "[CREDIT_CARD]" not in masked and n >= 1
    assert _mask(spark, "") == ("", 0)


def test_masking_leaves_no_earlier_finding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    masked = pii.mask_pii(docs, "text")
    assert masked.where(F.col("masked").rlike(K.PII_PATTERNS["email"])).count() == 0
    assert masked.where(F.col("masked").rlike(K.PII_PATTERNS["phone"])).count() == 0


@pytest.mark.parametrize(("number", "ok"), [("4111111111111111", True), ("4111111111111112", False), ("411111", False)])
def test_luhn(one, number, ok):
    assert one(pii.luhn_valid(F.col("t")), t=number) is ok


def test_replies(one):
    score = one(replies.parse_score(F.col("t")), t='ok {"score": 0.8, "reasoning": "fine"} bye')
    assert (score["score"], score["note"]) == (0.8, "fine")
    bad = one(replies.parse_score(F.col("t")), t="x" * 300)
    assert (bad["score"], bad["note"]) == (0.5, "x" * 200)
    assert one(replies.parse_score(F.col("t")), t='{"reasoning": "r"}')["score"] == 0.5
    d = one(replies.parse_decision(F.col("t")), t='{"decision": "read", "filename": "a.txt"}')
    assert (d["decision"], d["argument"]) == ("read", "a.txt")
    assert one(replies.parse_decision(F.col("t")), t='{"decision": "search"}')["decision"] == "answer"
    qa = one(replies.qa_or_fallback(F.col("t"), F.col("c")), t="no", c="z" * 300)
    assert qa["question"] == "What information is provided in: " + "z" * 80 + "...?"
    assert qa["expected_answer"] == "z" * 200


@pytest.mark.parametrize(
    ("name", "mime", "fmt"),
    [
        ("a.pdf", None, "pdf"), ("a.docx", None, "docx"), ("a.doc", None, "docx"), ("a.PNG", None, "image"),
        ("a.jpeg", None, "image"), ("a.pptx", None, "pptx"), ("a.html", None, "html"), ("a.htm", None, "html"),
        ("a.txt", None, "text"), ("a.py", None, "text"), ("a.xyz", None, "text"), ("noext", None, "text"),
        ("a.txt", "Application/PDF", "pdf"), ("a.csv", "unknown/x", "csv"),
    ],
)
def test_formats(one, name, mime, fmt):
    column = urls.file_format(F.lit(name), F.lit(mime).cast("string"))
    assert one(column) == fmt


def test_urls(one):
    assert one(urls.url_to_filename(F.lit("https://u@ex.com:8080/a/b/?q=1#f"))) == "u@ex.com:8080_a_b.html"
    assert one(urls.url_to_filename(F.lit("https://ex.com/x.html"))) == "ex.com_x.html"
    assert one(urls.video_id_from_url(F.lit("https://youtu.be/abc?t=1"))) == "abc"
    assert one(urls.video_id_from_url(F.lit("https://example.com/"))) is None


def test_scores(one):
    full = scoring.unified_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    assert one(full) == pytest.approx(0.85)
    cases = [
        ((0.9, 0.4, 1.0), "blocked_faithfulness"), ((0.9, 0.9, 0.8), "blocked_adversarial"),
        ((0.75, 0.9, 1.0), "deploy"), ((0.65, 0.9, 1.0), "improve"), ((0.5, 0.9, 1.0), "blocked_score"),
    ]
    for (score, faith, rate), want in cases:
        assert one(scoring.deploy_decision(F.lit(score), F.lit(faith), F.lit(rate))) == want
    hints = scoring.diagnose(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.95), F.lit(0.5))
    assert one(hints) == [K.HINT_PRECISION, K.HINT_REFUSAL]


def _map(entries):
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


@pytest.mark.parametrize(
    ("variant", "mode", "tier"),
    [
        ({"top_k": "5", "llm_judge": "b"}, "human_in_loop", "mandatory_gate"),
        ({"top_k": "5", "llm_judge": "b"}, "auto", "auto"),
        ({"top_k": "9", "llm_judge": "a"}, "human_in_loop", "auto"),
        ({"top_k": "9", "llm_judge": "a"}, "mandatory_gate", "mandatory_gate"),
        ({"top_k": "5", "llm_judge": "a", "retrieval_method": "dense"}, "human_in_loop", "human_in_loop"),
        ({"top_k": "5", "llm_judge": "a"}, "human_in_loop", "human_in_loop"),
    ],
)
def test_tiers(one, variant, mode, tier):
    baseline = _map({"top_k": "5", "llm_judge": "a"})
    assert one(scoring.approval_tier(_map(variant), baseline, F.lit(mode))) == tier


def test_variants(one):
    def propose(config, *hints):
        return one(scoring.propose_variant(_map(config), F.array(*map(F.lit, hints)).cast("array<string>")))

    assert propose({"top_k": "18"}, K.HINT_RECALL) == {"top_k": "20"}
    assert propose({"top_k": "5"}) == {"top_k": "7"}
    assert propose({"x": "1"}, K.HINT_REFUSAL) == {"x": "1", "refusal_instruction": "true"}
    assert propose({"rerank_enabled": "true"}, K.HINT_PRECISION) == {"rerank_enabled": "true", "top_k": "7"}


def test_drift(one):
    assert one(is_drift(F.lit(0.70), F.lit(0.80))) is True
    assert one(is_drift(F.lit(0.79), F.lit(0.80))) is False
    assert one(is_drift(F.lit(0.1), F.lit(None).cast("double"))) is False


def test_vectors(one):
    v = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(vectors.l2_normalize(v)) == pytest.approx([0.6, 0.8])
    assert one(vectors.l2_normalize(zero)) == [0.0, 0.0]
    assert one(vectors.cosine_distance(v, zero)) is None
    assert one(vectors.fit_dim(v, 3)) == [3.0, 4.0, 0.0]
    assert one(vectors.fit_dim(v, 1)) == [3.0]


def test_containment(one):
    meta = _map({"a": "1", "b": "2"})
    assert one(metadata_contains(meta, _map({"a": "1"}))) is True
    assert one(metadata_contains(meta, _map({"a": "2"}))) is False
    assert one(metadata_contains(meta, _map({"c": "2"}))) is False
    assert one(metadata_contains(meta, F.lit(None).cast("map<string,string>"))) is True
    doc = F.lit('{"a": {"b": 1, "c": [1, 2]}, "d": true}')
    assert one(json_contains(doc, {"a": {"b": 1}, "d": True})) is True
    assert one(json_contains(doc, {"a": {"c": [2]}})) is True
    assert one(json_contains(doc, {"a": {"c": [3]}})) is False
    assert one(json_contains(doc, {"a": {"x": 1}})) is False


STEMS = """
consigned consign consigning consign consignment consign consistency consist consistently consist
consolation consol consolatory consolatori consolidating consolid conspicuously conspicu
conspiracy conspiraci conspirator conspir conspire conspir constables constabl constancy constanc
kneeling kneel knightly knight knitting knit knives knive knocking knock knotty knotti knows know
generate generat generously generous running run hopping hop hoping hope flies fli dies die
happily happili skies sky early earli inning inning exceed exceed relational relat rational ration
agreed agre feed feed ties tie gas gas kiwis kiwi gaps gap caresses caress ponies poni cats cat
plastered plaster motoring motor sing sing bled bled say say by by cry cri enjoy enjoy
vietnamization vietnam hopefulness hope electricity electr formalize formal adoption adopt
controlling control roll roll rate rate cease ceas youth youth boyish boyish
""".split()


def test_stems(spark):
    from tidewell.functions.stem import stem_words

    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    df = spark.createDataFrame(pairs, "w string, want string")
    rows = stem_words(df, "w", "s").collect()
    assert [(r["w"], r["s"]) for r in rows if r["s"] != r["want"]] == []


def test_ts_rank(one):
    import math

    from tidewell.operators.postings import ts_rank

    def lists(*terms):
        return F.array(*[F.array(*map(F.lit, t)) for t in terms])

    assert one(ts_rank(lists([3, 9]))) == pytest.approx(0.1 * 1.25 / 1.64493406685)
    near = [0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) for d in (1, 4)]
    assert one(ts_rank(lists([3], [4, 7]))) == pytest.approx(1 - (1 - near[0]) * (1 - near[1]))
    assert one(ts_rank(lists([3], [3000]))) == 0.0


def test_each_word_is_stemmed_once(spark, monkeypatch):
    from tidewell.operators import postings

    stemmed = []

    def counting(df, word, out):
        stemmed.append(df.where(df[word].isNotNull()).count())
        return stem_words(df, word, out)

    stem_words = postings.stem_words
    monkeypatch.setattr(postings, "stem_words", counting)
    texts = ["fishes fishing fishes", "fishes birds", None, ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")

    def built():
        found = postings.build_postings(chunks, stem=True, positions=True)
        return sorted((r["chunk_id"], r["term"], r["tf"], r["n_terms"], r["positions"]) for r in found.collect())

    expected = [(0, "fish", 3, 3, [1, 2, 3]), (1, "bird", 1, 2, [2]), (1, "fish", 1, 2, [1])]
    assert built() == expected
    assert sum(stemmed) == 3
    # Words that are too rare to be kept at hand get the same stems.
    monkeypatch.setattr(postings, "STEM_WORDS", 2)
    assert built() == expected
    monkeypatch.setattr(postings, "STEM_WORDS", 0)
    assert built() == expected
