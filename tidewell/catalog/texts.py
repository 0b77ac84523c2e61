"""Text clean-up, personal data, answers and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.catalog import fixtures as fx
from tidewell.catalog.registry import query
from tidewell.functions import ordered, replies, text
from tidewell.operators import answers as answer_ops
from tidewell.operators import filters, lifecycle, pii

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


@query(
    "token_count",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS INTEGER) AS tokens FROM documents",
)
def token_count(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("tokens"))


@query(
    "normalized_text",
    r"""
WITH broken AS (
  SELECT doc_id, replace(replace(replace(replace(text, 'en ', 'en-' || chr(10) || ' '), ', ', ',. , '),
         ' la ', ' 27. 3   '), chr(10), chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents
),
s1 AS (SELECT doc_id, regexp_replace(t, '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM broken),
s2 AS (SELECT doc_id, regexp_replace(t, '(\d)\.\s+(\d)', '\1.\2', 'g') AS t FROM s1),
s3 AS (SELECT doc_id, regexp_replace(t, ',\.\s*,', ', ...,', 'g') AS t FROM s2),
s4 AS (SELECT doc_id, regexp_replace(t, '\.\s+,', ',', 'g') AS t FROM s3),
s5 AS (SELECT doc_id, regexp_replace(t, '[ \t\r\f\v]+', ' ', 'g') AS t FROM s4),
s6 AS (SELECT doc_id, regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') AS t FROM s5)
SELECT doc_id, """ + _TRIM.format("t") + " AS clean FROM s6",
)
def normalized_text(spark, sf):
    broken = F.col("text")
    for old, new in (("en ", "en-\n "), (", ", ",. , "), (" la ", " 27. 3   "), ("\n", "\n\n\n\n")):
        broken = F.replace(broken, F.lit(old), F.lit(new))
    return fx.table(spark, sf, "documents").select("doc_id", text.normalize_extracted(broken).alias("clean"))


def _luhn_sql(x: str) -> str:
    digits = f"regexp_extract_all({x}, '[0-9]')"
    return f"""(len({digits}) BETWEEN 13 AND 16 AND list_sum(list_transform({digits}, lambda d, i:
      CASE WHEN (i - 1) % 2 = len({digits}) % 2
           THEN d::INTEGER * 2 - CASE WHEN d::INTEGER > 4 THEN 9 ELSE 0 END ELSE d::INTEGER END)) % 10 = 0)"""


def _mask_sql(order=pii.LABELS) -> str:
    """CTEs m0..m5 masking documents step by step, with one count per label."""
    steps = ["m0 AS (SELECT doc_id, lang, source, text AS t FROM documents)"]
    counts: list[str] = []
    for i, label in enumerate(order):
        pattern = K.PII_PATTERNS[label]
        token = f"[{label.upper()}]"
        carried = "".join(f", {c}" for c in counts)
        if label == "credit_card":
            found = f"regexp_extract_all(t, '{pattern}')"
            n = f"len(list_filter({found}, lambda x: {_luhn_sql('x')}))"
            masked = f"""array_to_string(list_transform(
              list_zip(string_split_regex(t, '{pattern}'), {found}),
              lambda p: p[1] || coalesce(CASE WHEN {_luhn_sql('p[2]')} THEN '{token}' ELSE p[2] END, '')), '')"""
            masked = f"CASE WHEN len({found}) = 0 THEN t ELSE {masked} END"
        else:
            n = f"len(regexp_extract_all(t, '{pattern}'))"
            masked = f"regexp_replace(t, '{pattern}', '{token}', 'g')"
        steps.append(
            f"m{i + 1} AS (SELECT doc_id, lang, source, {masked} AS t{carried},"
            f" CAST({n} AS INTEGER) AS n_{label} FROM m{i})"
        )
        counts.append(f"n_{label}")
    return "WITH " + ",\n".join(steps)


_TOTAL = " + ".join(f"n_{label}" for label in pii.LABELS)


@query("masked_documents", _mask_sql() + f" SELECT doc_id, t AS masked, CAST({_TOTAL} AS INTEGER) AS pii_count FROM m5")
def masked_documents(spark, sf):
    return pii.mask_pii(fx.table(spark, sf, "documents"), "text").select("doc_id", "masked", "pii_count")


_CARDS_FIRST = ("credit_card", "email", "ssn_aadhaar", "ip", "phone")


@query(
    "masked_cards_first",
    _mask_sql(_CARDS_FIRST)
    + " SELECT doc_id, t AS masked, n_credit_card, n_phone, "
    + f"CAST({_TOTAL} AS INTEGER) AS pii_count FROM m5",
)
def masked_cards_first(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return pii.mask_pii(docs, "text", order=_CARDS_FIRST, per_label=True).select(
        "doc_id", "masked", "n_credit_card", "n_phone", "pii_count"
    )


@query(
    "pii_report",
    _mask_sql() + """,
long AS (SELECT lang, source, unnest([""" + ", ".join(
        f"{{'label': '{label}', 'n': n_{label}}}" for label in pii.LABELS
    ) + """], recursive := true) FROM m5)
SELECT lang, source, label, CAST(sum(n) AS BIGINT) AS entities, count(*) FILTER (n > 0) AS documents
FROM long GROUP BY 1, 2, 3""",
)
def pii_report(spark, sf):
    return pii.pii_report(fx.table(spark, sf, "documents"), "text", ["lang", "source"])


@query(
    "card_checksums",
    f"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{K.PII_PATTERNS["credit_card"]}')) AS number FROM documents)
SELECT doc_id, number, count(*) AS n, any_value({_luhn_sql('number')}) AS valid FROM found GROUP BY 1, 2""",
)
def card_checksums(spark, sf):
    found = fx.table(spark, sf, "documents").select(
        "doc_id", F.explode(pii.card_matches(F.col("text"))).alias("number")
    )
    return found.groupBy("doc_id", "number").agg(F.count("*").alias("n")).withColumn(
        "valid", pii.luhn_valid(F.col("number"))
    )


@query(
    "second_mask_pass",
    """
SELECT conv_id, turn,
       CASE WHEN conv_id % 3 <> 0 AND turn % 4 = 0 AND text <> '' THEN '[PII] ' || text ELSE text END AS masked,
       turn + CASE WHEN conv_id % 3 <> 0 AND turn % 4 = 0 AND text <> '' THEN 2 ELSE 0 END AS pii_count
FROM conversations""",
)
def second_mask_pass(spark, sf):
    good = F.to_json(
        F.struct(F.concat(F.lit("[PII] "), "text").alias("masked_text"), F.lit(2).alias("extra_pii_count"))
    )
    half = F.to_json(F.struct(F.col("text").alias("masked_text")))
    reply = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  "), good, F.lit("\n")))
        .when(F.col("turn") % 4 == 1, half)
        .when(F.col("turn") % 4 == 2, "sorry, no JSON")
        .otherwise("{'masked_text': 'x', 'extra_pii_count': 9}")
    )
    second = replies.apply_second_pass(F.col("text"), F.col("turn"), reply, F.col("conv_id") % 3 != 0)
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", second.alias("s")).select(
        "conv_id", "turn", "s.masked", "s.pii_count"
    )


_CLEAN = r"""
cleaned AS (
  SELECT conv_id, turn, role, turn % 6 AS max_source, CASE WHEN starts_with(a, 'Based on the provided context, ')
           THEN a[32:] ELSE a END AS a
  FROM (SELECT conv_id, turn, role, """ + _TRIM.format("answer") + r""" AS a FROM answers)
),
capital AS (SELECT conv_id, turn, role, max_source, upper(a[1]) || a[2:] AS a FROM cleaned),
clean AS (
  SELECT conv_id, turn, role, CASE WHEN max_source = 0 THEN a ELSE
    regexp_replace(regexp_replace(regexp_replace(a,
      '([a-zA-Z])\s+([1-' || max_source || '])([.,;:])', '\1 [\2]\3', 'g'),
      '([a-zA-Z])\s+([1-' || max_source || '])([1-' || max_source || '])([.,;:])', '\1 [\2][\3]\4', 'g'),
      '([a-zA-Z])\s+([1-' || max_source || '])([1-' || max_source || '])([1-' || max_source || '])([.,;:])',
      '\1 [\2][\3][\4]\5', 'g') END AS a
  FROM capital
)"""


def _clean(spark, sf, max_source):
    return fx.answers(spark, sf).withColumn("a", text.clean_answer(F.col("answer"), max_source))


@query("clean_answers", "WITH " + fx.ANSWERS + "," + _CLEAN + " SELECT conv_id, turn, a AS answer FROM clean")
def clean_answers(spark, sf):
    return _clean(spark, sf, F.col("turn") % 6).select("conv_id", "turn", F.col("a").alias("answer"))


@query(
    "cited_sources",
    "WITH " + fx.ANSWERS + "," + _CLEAN.replace("turn % 6 AS max_source", "9 AS max_source") + r""",
found AS (
  SELECT conv_id AS query_id, turn, regexp_extract_all(a, '\[([0-9]+)\]', 1) AS m FROM clean WHERE role = 'assistant'
),
marks AS (SELECT query_id, turn, generate_subscripts(m, 1) AS i, unnest(m)::INTEGER AS rank FROM found)
SELECT m.query_id, m.turn, CAST(i - 1 AS INTEGER) AS pos, m.rank, md5(c.text) AS source_md5
FROM marks m JOIN conversations c ON c.conv_id = m.query_id AND c.turn + 1 = m.rank""",
)
def cited_sources(spark, sf):
    cleaned = _clean(spark, sf, F.lit(9)).where("role = 'assistant'")
    sources = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.md5("text").alias("source_md5")
    )
    marked = cleaned.select(F.struct("conv_id", "turn").alias("query_id"), F.col("a").alias("answer"))
    keyed = sources.withColumn("conv_id", F.col("query_id")).drop("query_id")
    marks = marked.select(
        "query_id", F.posexplode(answer_ops.citation_marks(F.col("answer"))).alias("pos", "rank")
    ).select(F.col("query_id.conv_id").alias("conv_id"), F.col("query_id.turn").alias("turn"), "pos", "rank")
    return marks.join(keyed, ["conv_id", "rank"]).withColumnRenamed("conv_id", "query_id")


_MARKDOWN = """
md AS (
  SELECT conv_id, turn, 'intro' || chr(10) || CASE turn % 3 WHEN 0 THEN replace(text, '. ', chr(10) || '- ')
    WHEN 1 THEN replace(text, '. ', chr(10) || '2. ') ELSE replace(replace(text, '. ', chr(10) || '* '), ', ', chr(10) || '1.  ')
    END || chr(10) || chr(10) || '- last' || chr(10) || ' end ' AS answer
  FROM conversations
)"""


@query(
    "answer_blocks",
    "WITH " + _MARKDOWN + r""",
lines AS (
  SELECT conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT conv_id, turn, list_transform(string_split(answer, chr(10)), lambda s: """ + _TRIM.format("s") + r""") AS l FROM md)
),
typed AS (
  SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^[*-]\s+') THEN 'ul'
                 WHEN regexp_matches(line, '^[0-9]+\.\s+') THEN 'ol' ELSE 'p' END AS type FROM lines
),
starts AS (
  SELECT *, CASE WHEN type = 'p' OR type <> coalesce(lag(type) OVER (PARTITION BY conv_id, turn ORDER BY i), 'none')
                 THEN 1 ELSE 0 END AS s
  FROM typed
),
grouped AS (
  SELECT *, sum(CASE WHEN type = 'blank' THEN 0 ELSE s END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM starts
)
SELECT conv_id, turn, CAST(g - 1 AS INTEGER) AS block_no, type,
       string_agg(regexp_replace(regexp_replace(line, '^[*-]\s+', ''), '^[0-9]+\.\s+', ''), '|' ORDER BY i) AS items
FROM grouped WHERE type <> 'blank' GROUP BY 1, 2, 3, 4""",
)
def answer_blocks(spark, sf):
    body = F.col("text")

    def swap(col, old, new):
        return F.replace(col, F.lit(old), F.lit(new))

    listed = (
        F.when(F.col("turn") % 3 == 0, swap(body, ". ", "\n- "))
        .when(F.col("turn") % 3 == 1, swap(body, ". ", "\n2. "))
        .otherwise(swap(swap(body, ". ", "\n* "), ", ", "\n1.  "))
    )
    md = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("intro\n"), listed, F.lit("\n\n- last\n end ")).alias("answer")
    )
    return answer_ops.answers_to_blocks(md).withColumn("items", F.array_join("items", "|"))


@query(
    "excerpts",
    r"""
WITH c AS (
  SELECT doc_id, """ + _TRIM.format(
        """CASE doc_id % 4 WHEN 0 THEN 'Abstract' || chr(10) || text
           WHEN 1 THEN '## Introduction *' || chr(10) || '  ' || text
           WHEN 2 THEN '   ' || text ELSE '**ABSTRACT**' END"""
    ) + r""" AS body FROM documents
),
w AS (
  SELECT doc_id, body, lower(""" + _TRIM.format("regexp_replace(string_split(body, chr(10))[1], '[#*]', '', 'g')") + r""") AS word FROM c
)
SELECT doc_id, CASE word WHEN 'abstract' THEN 'Abstract' WHEN 'introduction' THEN 'Introduction' ELSE 'Excerpt' END AS heading,
       md5(CASE WHEN word IN ('abstract', 'introduction') AND contains(body, chr(10))
            THEN """ + _TRIM.format("body[instr(body, chr(10)) + 1:]") + " ELSE body END) AS body_md5 FROM w",
)
def excerpts(spark, sf):
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.concat(F.lit("Abstract\n"), "text"))
        .when(kind == 1, F.concat(F.lit("## Introduction *\n  "), "text"))
        .when(kind == 2, F.concat(F.lit("   "), "text"))
        .otherwise("**ABSTRACT**")
    )
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        text.excerpt_heading(content).alias("heading"),
        F.md5(text.excerpt_body(content)).alias("body_md5"),
    )


_NORMAL = (
    _TRIM.format(
        r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '(\d)\.\s+(\d)', '\1.\2', 'g'),
      ',\.\s*,', ', ...,', 'g'), '\.\s+,', ',', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""
    )
)


@query(
    "answer_context",
    f"""
WITH top AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations
)
SELECT conv_id AS query_id,
       string_agg('[' || rank || '] (file: ' || CASE WHEN role = 'system' THEN 'unknown' ELSE role END || ') '
                  || {_NORMAL}, chr(10) || chr(10) ORDER BY rank) AS context
FROM top WHERE rank <= 5 GROUP BY 1""",
)
def answer_context(spark, sf):
    turns = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("content"),
        F.when(F.col("role") != "system", F.col("role")).alias("filename"),
    )
    top = ordered.newest(turns, ["query_id"], [F.col("turn")], K.DEFAULT_TOP_K, "rank")
    return answer_ops.build_context(top, named=True)


_PHRASES = " OR ".join(
    "contains(lower(answer), '" + p.replace("'", "''") + "')" for p in K.REFUSAL_PHRASES
)


@query("refusals", "WITH " + fx.ANSWERS + f" SELECT conv_id, turn, {_PHRASES} AS refusal FROM answers")
def refusals(spark, sf):
    return fx.answers(spark, sf).select("conv_id", "turn", text.is_refusal(F.col("answer")).alias("refusal"))


_STARTS = " OR ".join(f"starts_with(l, '{s}')" for s in K.CLEAR_STARTERS)


@query(
    "simple_queries",
    rf"""
WITH q AS (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' What is ' WHEN 1 THEN 'how does, ' ELSE '' END
         || string_split(text, '.')[1] || '?' AS q FROM conversations
),
f AS (SELECT *, len(regexp_extract_all(q, '[^\s]+')) AS n, {_TRIM.format('lower(q)')} AS l FROM q)
SELECT conv_id, turn, n <= 6 OR (({_STARTS}) AND n <= 14)
       OR (n <= 8 AND NOT contains(q, ',') AND len(q) - len(replace(q, '?', '')) <= 1) AS simple FROM f""",
)
def simple_queries(spark, sf):
    opening = F.when(F.col("turn") % 3 == 0, " What is ").when(F.col("turn") % 3 == 1, "how does, ").otherwise("")
    q = F.concat(opening, F.substring_index("text", ".", 1), F.lit("?"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", text.is_simple_query(q).alias("simple"))


@query(
    "expanded_queries",
    r"""
WITH e AS (
  SELECT item_id, string_split(text, '.')[1] AS q,
         '1. ' || replace(replace(text, '. ', chr(10) || '- '), ', ', chr(10) || chr(10) || '  2) ') AS lines FROM benchmark
),
k AS (
  SELECT item_id, q, list_filter(list_transform(string_split(lines, chr(10)), lambda s:
           ltrim(""" + _TRIM.format("s") + r""", '0123456789.-*• ')), lambda s: s <> '') AS kept FROM e
),
f AS (SELECT item_id, (CASE WHEN list_contains(kept, q) THEN kept ELSE list_prepend(q, kept) END)[1:4] AS qs FROM k)
SELECT item_id, CAST(generate_subscripts(qs, 1) - 1 AS INTEGER) AS pos, unnest(qs) AS q FROM f""",
)
def expanded_queries(spark, sf):
    lines = F.concat(
        F.lit("1. "),
        F.replace(F.replace("text", F.lit(". "), F.lit("\n- ")), F.lit(", "), F.lit("\n\n  2) ")),
    )
    q = F.substring_index("text", ".", 1)
    return fx.table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(text.dedupe_queries(lines, q)).alias("pos", "q")
    )


@query(
    "query_log",
    """
SELECT item_id, sha256(text) AS query_hash, false AS rewrite_applied, item_id % 2 = 0 AS hyde_applied,
       false AS compression_applied, CAST(CASE WHEN item_id % 3 = 0 THEN 5 ELSE 7 END AS INTEGER) AS retrieval_k,
       CAST(0 AS INTEGER) AS chunks_retrieved, false AS rerank_applied
FROM benchmark""",
)
def query_log(spark, sf):
    rows = fx.table(spark, sf, "benchmark").select(
        "item_id",
        F.col("text").alias("q"),
        F.when(F.col("item_id") % 2 == 0, True).alias("hyde_applied"),
        F.when(F.col("item_id") % 3 != 0, 7).alias("retrieval_k"),
    )
    return lifecycle.query_log_rows(rows)


# A reply with the turn's whole text as its note, a bare score, no JSON, broken JSON.
_SCORE_REPLY = """
r AS (
  SELECT conv_id, turn, CASE turn % 4
    WHEN 0 THEN 'Verdict: {"score": 0.' || (length(text) % 90 + 10) || ', "reasoning": ' || to_json(text) || '} done'
    WHEN 1 THEN '{"score": "0.25"}' WHEN 2 THEN text ELSE '{score: ' || text || '}' END AS reply
  FROM conversations
)"""


def _score_replies(spark, sf):
    c = fx.table(spark, sf, "conversations")
    note = F.to_json(F.struct(F.col("text").alias("reasoning")))
    scored = F.concat(
        F.lit('Verdict: {"score": 0.'), (F.length("text") % 90 + 10).cast("string"), F.lit(", "),
        F.substr(note, F.lit(2)), F.lit(" done"),
    )
    reply = (
        F.when(F.col("turn") % 4 == 0, scored)
        .when(F.col("turn") % 4 == 1, '{"score": "0.25"}')
        .when(F.col("turn") % 4 == 2, F.col("text"))
        .otherwise(F.concat(F.lit("{score: "), "text", F.lit("}")))
    )
    return c.withColumn("reply", reply)


@query(
    "judge_scores",
    "WITH " + _SCORE_REPLY + r""",
m AS (SELECT conv_id, turn, reply, regexp_extract(reply, '\{[^{}]*\}') AS j FROM r),
p AS (SELECT *, CASE WHEN j <> '' AND json_valid(j) THEN j END AS ok FROM m)
SELECT conv_id, turn, coalesce(TRY_CAST(json_extract_string(ok, '$.score') AS DOUBLE), 0.5) AS score,
       CASE WHEN ok IS NULL THEN reply[1:200] ELSE coalesce(json_extract_string(ok, '$.reasoning'), '') END AS note
FROM p""",
)
def judge_scores(spark, sf):
    return _score_replies(spark, sf).select(
        "conv_id", "turn", replies.parse_score(F.col("reply")).alias("s")
    ).select("conv_id", "turn", "s.score", "s.note")


@query(
    "search_decisions",
    r"""
SELECT conv_id, turn,
       CASE turn % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'read' ELSE 'answer' END AS decision,
       CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN role END AS argument
FROM conversations""",
)
def search_decisions(spark, sf):
    c = fx.table(spark, sf, "conversations")
    kind = F.col("turn") % 5
    reply = (
        F.when(kind == 0, F.concat(
            F.lit("Plan: "), F.to_json(F.struct(F.lit("search").alias("decision"), F.col("text").alias("search_query"))), F.lit(" ok")))
        .when(kind == 1, F.to_json(F.struct(F.lit("read").alias("decision"), F.col("role").alias("filename"))))
        .when(kind == 2, '{"decision": "search", "search_query": ""}')
        .when(kind == 3, F.col("text"))
        .otherwise('{"decision": "read"} and {')
    )
    return c.select("conv_id", "turn", replies.parse_decision(reply).alias("d")).select(
        "conv_id", "turn", "d.decision", "d.argument"
    )


_QA_REPLY = """
qa AS (
  SELECT doc_id, text, CASE doc_id % 3
    WHEN 0 THEN 'Sure: {"question": ' || to_json(string_split(text, '.')[1] || '?') || ', "expected_answer": ' || to_json(text) || '}'
    WHEN 1 THEN '{"expected_answer": "x"}' ELSE text END AS reply FROM documents
)"""


@query(
    "question_answers",
    "WITH " + _QA_REPLY + r""",
m AS (SELECT doc_id, text, regexp_extract(reply, '\{[^{}]*\}') AS j FROM qa),
p AS (SELECT doc_id, text, CASE WHEN j <> '' AND json_valid(j) THEN j END AS ok FROM m)
SELECT doc_id, coalesce(json_extract_string(ok, '$.question'), 'What information is provided in: ' || text[1:80] || '...?') AS question,
       md5(CASE WHEN json_extract_string(ok, '$.question') IS NULL THEN text[1:200]
           ELSE coalesce(json_extract_string(ok, '$.expected_answer'), '') END) AS answer_md5 FROM p""",
)
def question_answers(spark, sf):
    good = F.concat(
        F.lit("Sure: "),
        F.to_json(
            F.struct(
                F.concat(F.substring_index("text", ".", 1), F.lit("?")).alias("question"),
                F.col("text").alias("expected_answer"),
            )
        ),
    )
    reply = (
        F.when(F.col("doc_id") % 3 == 0, good)
        .when(F.col("doc_id") % 3 == 1, '{"expected_answer": "x"}')
        .otherwise(F.col("text"))
    )
    qa = replies.qa_or_fallback(reply, F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", qa.alias("qa")).select(
        "doc_id", "qa.question", F.md5("qa.expected_answer").alias("answer_md5")
    )


@query(
    "nonblank_blocks",
    r"""
WITH l AS (SELECT doc_id, string_split(replace(text, '. ', chr(10) || '  ' || chr(10)), chr(10)) AS b FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS block_no, unnest(b) AS content FROM l)
SELECT doc_id, block_no, content FROM e WHERE """ + _TRIM.format("content") + " <> ''",
)
def nonblank_blocks(spark, sf):
    lines = F.split(F.replace("text", F.lit(". "), F.lit("\n  \n")), "\n")
    blocks = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("block_no", "content"))
    return filters.drop_blank_blocks(blocks)
