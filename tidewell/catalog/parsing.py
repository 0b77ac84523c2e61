"""Sources and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.catalog import fixtures as fx
from tidewell.catalog.registry import query
from tidewell.functions import urls
from tidewell.operators import chunking, spread_chunks
from tidewell.sources import crawl, files, html, tabular, transcripts, workspace

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


@query("decoded_files", "SELECT doc_id, text FROM documents")
def decoded_files(spark, sf):
    raw = F.when(F.col("lang") == "fr", F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return fx.table(spark, sf, "documents").select("doc_id", files.decode_text(raw).alias("text"))


# File names and MIME types by document: every ending, cases and unknown kinds.
_ENDINGS = ["pdf", "DOCX", "doc", "png", "jpg", "pptx", "csv", "xlsx", "html", "htm", "txt", "py", "youtube", "xyz"]
_MIMES = ["Application/PDF", "image/jpeg", "text/csv", "text/html", "text/plain", "application/x-youtube", ""]
_NAMES = f"""
named AS (
  SELECT doc_id, source || '.' || lang || CASE WHEN doc_id % 15 = 14 THEN '' ELSE
           '.' || ([{fx.sql_list(_ENDINGS)}])[doc_id % 15 + 1] END AS filename,
         CASE WHEN doc_id % 4 = 0 THEN ([{fx.sql_list(_MIMES)}])[doc_id % 7 + 1] END AS mime_type
  FROM documents
)"""


def _named(spark, sf):
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 15).cast("int"))
    mime = F.get(F.array(*map(F.lit, _MIMES)), (F.col("doc_id") % 7).cast("int"))
    name = F.concat("source", F.lit("."), "lang", F.when(ending.isNotNull(), F.concat(F.lit("."), ending)).otherwise(""))
    return fx.table(spark, sf, "documents").select(
        "doc_id", name.alias("filename"), F.when(F.col("doc_id") % 4 == 0, mime).alias("mime_type")
    )


_FORMAT_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in K.FORMAT_BY_KEY.items())


@query(
    "file_formats",
    "WITH " + _NAMES + f""",
formats(key, format) AS (VALUES {_FORMAT_ROWS})
SELECT doc_id, filename, coalesce(m.format, e.format, 'text') AS format
FROM named n LEFT JOIN formats m ON m.key = lower(n.mime_type)
LEFT JOIN formats e ON e.key = '.' || lower(regexp_extract(n.filename, '[^.]*$'))""",
)
def file_formats(spark, sf):
    return files.route_format(_named(spark, sf)).drop("mime_type")


@query(
    "guessed_mime",
    "WITH " + _NAMES + f"""
SELECT doc_id, CASE WHEN suffix(filename, '.pdf') THEN 'application/pdf' WHEN suffix(filename, '.txt') THEN 'text/plain'
  WHEN suffix(filename, '.csv') THEN 'text/csv' WHEN suffix(filename, '.docx') THEN '{K.MIME_BY_ENDING[".docx"]}'
  ELSE '{K.DEFAULT_MIME}' END AS mime FROM named""",
)
def guessed_mime(spark, sf):
    return _named(spark, sf).select("doc_id", urls.guess_mime(F.col("filename")).alias("mime"))


@query(
    "url_filenames",
    """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)', ['host', 'path']) AS u FROM pages),
n AS (SELECT page_id, u.host || CASE WHEN trim(u.path, '/') = '' THEN '' ELSE '_' || replace(trim(u.path, '/'), '/', '_') END AS n FROM p)
SELECT page_id, CASE WHEN suffix(n, '.html') THEN n ELSE n || '.html' END AS filename FROM n""",
)
def url_filenames(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", urls.url_to_filename(F.col("url")).alias("filename"))


@query(
    "video_ids",
    r"""
WITH v AS (
  SELECT page_id, CASE page_id % 7
    WHEN 0 THEN 'https://www.youtube.com/watch?v=' || md5(url)[1:11] || '&t=3s'
    WHEN 1 THEN 'HTTPS://YOUTU.BE/' || md5(url)[1:11] || '?si=1' WHEN 2 THEN 'youtube.com/embed/' || md5(url)[1:11] || '?a=b'
    WHEN 3 THEN 'see https://youtube.com/shorts/' || md5(url)[1:11] || ' now'
    WHEN 4 THEN 'https://m.youtube.com/watch?v=' || md5(url)[1:11] ELSE url END AS link, page_id % 7 AS kind, md5(url)[1:11] AS id
  FROM pages
)
SELECT page_id, CASE WHEN kind <= 4 THEN id END AS video_id FROM v""",
)
def video_ids(spark, sf):
    vid = F.left(F.md5("url"), F.lit(11))
    kind = F.col("page_id") % 7
    link = (
        F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), vid, F.lit("&t=3s")))
        .when(kind == 1, F.concat(F.lit("HTTPS://YOUTU.BE/"), vid, F.lit("?si=1")))
        .when(kind == 2, F.concat(F.lit("youtube.com/embed/"), vid, F.lit("?a=b")))
        .when(kind == 3, F.concat(F.lit("see https://youtube.com/shorts/"), vid, F.lit(" now")))
        .when(kind == 4, F.concat(F.lit("https://m.youtube.com/watch?v="), vid))
        .otherwise(F.col("url"))
    )
    return fx.table(spark, sf, "pages").select("page_id", urls.video_id_from_url(link).alias("video_id"))


@query(
    "csv_blocks",
    """
WITH raw AS (SELECT doc_id, string_split(""" + _TRIM.format("replace(text, '\"', '''')") + """, chr(10)) AS l FROM documents),
cells AS (
  SELECT doc_id, list_transform(string_split(l[1], ','), lambda c: """ + _TRIM.format("c") + """) AS header, l FROM raw
),
ok AS (SELECT *, len(header) AS w, CASE WHEN len(l) = 1 THEN [0] ELSE range(0, CAST(ceil((len(l) - 1) / 10) AS BIGINT)) END AS g
       FROM cells WHERE len(list_filter(header, lambda h: h <> '')) > 0),
blocks AS (SELECT doc_id, l, w, header, unnest(g) AS g FROM ok)
SELECT doc_id, CAST(g AS INTEGER) AS block_no,
       array_to_string(list_concat(
         ['| ' || array_to_string(header, ' | ') || ' |',
          '| ' || array_to_string(list_transform(range(0, w), lambda i: '---'), ' | ') || ' |'],
         list_transform(l[g * 10 + 2 : g * 10 + 11], lambda r:
           '| ' || array_to_string(list_transform(range(1, w + 1), lambda i:
             """ + _TRIM.format("coalesce(string_split(r, ',')[i], '')") + """), ' | ') || ' |')), chr(10)) AS content
FROM blocks""",
)
def csv_blocks(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit('"'), F.lit("'")).alias("text"))
    return tabular.csv_to_blocks(docs, "text").select("doc_id", "block_no", "content")


@query(
    "sheet_blocks",
    """
WITH r AS (
  SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn,
         '| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |' AS line FROM part
)
SELECT p_brand, CAST((rn - 1) // 10 AS INTEGER) AS block_no,
       'Sheet: ' || p_brand || chr(10) || '| p_partkey | p_name | p_type | p_size |' || chr(10) || '| --- | --- | --- | --- |'
       || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS content
FROM r GROUP BY 1, 2""",
)
def sheet_blocks(spark, sf):
    part = fx.table(spark, sf, "part")
    return tabular.rows_to_markdown(
        part, ["p_brand"], "p_partkey", ["p_partkey", "p_name", "p_type", "p_size"], title="p_brand"
    ).drop("type")


@query("html_blocks")
def html_blocks(spark, sf):
    return html.html_to_blocks(fx.table(spark, sf, "pages").drop("url"))


_UNESCAPE = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
for _old, _new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_old}', '{_new}')"


@query("page_headings", f"SELECT page_id, {_TRIM.format(_UNESCAPE)} AS heading FROM pages")
def page_headings(spark, sf):
    """The first block left on a page once navigation and scripts are dropped."""
    blocks = html.html_to_blocks(fx.table(spark, sf, "pages").drop("url"))
    return blocks.groupBy("page_id").agg(F.min_by("content", "block_no").alias("heading"))


# Transcripts: the sentences of a document as segments of five seconds.
@query(
    "transcript_blocks",
    r"""
WITH RECURSIVE s AS (
  SELECT doc_id, generate_subscripts(l, 1) AS raw, unnest(l) AS t FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents)
),
seg AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS i, 7.5 * (raw - 1) AS st,
         """ + _TRIM.format("t") + r""" AS t, len(regexp_extract_all(t, '[^\s]+')) AS n
  FROM s WHERE """ + _TRIM.format("t") + r""" <> ''
),
fold AS (
  SELECT doc_id, i, 0 AS g, n AS words, 5.0::DOUBLE AS secs FROM seg WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, CASE WHEN f.words >= 120 OR f.secs >= 60 THEN f.g + 1 ELSE f.g END,
         CASE WHEN f.words >= 120 OR f.secs >= 60 THEN x.n ELSE f.words + x.n END,
         CASE WHEN f.words >= 120 OR f.secs >= 60 THEN 5.0::DOUBLE ELSE f.secs + 5.0 END
  FROM fold f JOIN seg x ON x.doc_id = f.doc_id AND x.i = f.i + 1
),
b AS (
  SELECT f.doc_id, f.g, CAST(floor(min(st)) AS BIGINT) AS a, CAST(floor(max(st) + 5.0) AS BIGINT) AS z,
         string_agg(t, ' ' ORDER BY f.i) AS t
  FROM fold f JOIN seg USING (doc_id, i) GROUP BY 1, 2
)
SELECT doc_id, CAST(g AS INTEGER) AS block_no, '[' || {a} || ' - ' || {z} || '] ' || t AS content,
       'https://www.youtube.com/watch?v=' || doc_id || '&t=' || a || 's' AS media_path
FROM b""".replace(
        "{a}",
        "CASE WHEN a >= 3600 THEN printf('%02d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60)"
        " ELSE printf('%02d:%02d', a // 60, a % 60) END",
    ).replace(
        "{z}",
        "CASE WHEN z >= 3600 THEN printf('%02d:%02d:%02d', z // 3600, z % 3600 // 60, z % 60)"
        " ELSE printf('%02d:%02d', z // 60, z % 60) END",
    ),
)
def transcript_blocks(spark, sf):
    segments = F.transform(
        F.split("text", r"\."),
        lambda t, i: F.struct(
            t.alias("text"), (i * F.lit(7.5)).alias("start"), F.lit(5.0).alias("duration")
        ),
    )
    videos = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("video_id"), segments.alias("segments")
    )
    return transcripts.transcript_to_blocks(videos, "segments", "video_id").select(
        "doc_id", "block_no", "content", "media_path"
    )


_KINDS = ["heading_1", "paragraph", "bulleted_list_item", "heading_3", "divider", "numbered_list_item", "heading_2"]


@query(
    "workspace_pages",
    f"""
WITH l AS (
  SELECT doc_id, lang, source, list_transform(string_split(text, chr(10)), lambda s, i: {{'k': (i - 1) % 7, 's': s}}) AS l FROM documents
)
SELECT doc_id, CASE WHEN lang = 'es' THEN 'Untitled Page' ELSE source END || '.md' AS filename,
       md5(array_to_string(list_prepend('# ' || CASE WHEN lang = 'es' THEN 'Untitled Page' ELSE source END || chr(10),
         list_transform(list_filter(l, lambda e: e.k <> 4), lambda e:
           CASE e.k WHEN 0 THEN '## ' WHEN 1 THEN '' WHEN 2 THEN '- ' WHEN 3 THEN '#### ' WHEN 5 THEN '- ' ELSE '### ' END || e.s)),
         chr(10) || chr(10))) AS content_md5
FROM l""",
)
def workspace_pages(spark, sf):
    kind = F.array(*map(F.lit, _KINDS))

    def block(line, i):
        k = F.get(kind, i % len(_KINDS))
        rich = F.to_json(
            F.struct(
                F.array(
                    F.struct(F.left(line, F.lit(3)).alias("plain_text")),
                    F.struct(F.substr(line, F.lit(4)).alias("plain_text")),
                ).alias("rich_text")
            )
        )
        return F.concat(F.lit('{"type": "'), k, F.lit('", "'), k, F.lit('": '), rich, F.lit("}"))

    body = F.concat(F.lit("["), F.array_join(F.transform(F.split("text", "\n"), block), ", "), F.lit("]"))
    pages = fx.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("source")).alias("title"), body.alias("blocks")
    )
    return workspace.page_blocks_to_text(pages, "blocks", "title").select(
        "doc_id", "filename", F.md5("content").alias("content_md5")
    )


_SEEDS = r"SELECT min(url) AS url FROM pages GROUP BY regexp_extract(url, '://([^/?#]*)', 1)"


@query(
    "crawl_frontier",
    rf"""
WITH RECURSIVE links AS (
  SELECT DISTINCT url AS src, regexp_extract(url, '^[a-z]+://[^/?#]*') || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages
),
walk AS (
  SELECT url, 0 AS depth FROM ({_SEEDS})
  UNION
  SELECT l.url, w.depth + 1 FROM walk w JOIN links l ON l.src = w.url WHERE w.depth < 3
)
SELECT w.url, CAST(min(depth) AS INTEGER) AS depth, bool_or(p.url IS NOT NULL) AS fetched
FROM walk w LEFT JOIN pages p ON p.url = w.url GROUP BY 1""",
)
def crawl_frontier(spark, sf):
    pages = fx.table(spark, sf, "pages")
    seeds = pages.groupBy(urls.netloc(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return crawl.crawl_frontier(pages, seeds)


_DRIVE = [
    "application/vnd.google-apps.folder", "application/vnd.google-apps.document",
    "application/vnd.google-apps.spreadsheet", "application/vnd.google-apps.form", "application/pdf",
]


@query(
    "exportable_items",
    f"""
WITH i AS (SELECT doc_id, source || doc_id AS name, ([{fx.sql_list(_DRIVE)}])[doc_id % 5 + 1] AS mime FROM documents
           WHERE lang <> 'de' AND source <> 'src0')
SELECT 'gdrive://' || doc_id AS source_id,
       name || CASE doc_id % 5 WHEN 1 THEN '.txt' WHEN 2 THEN '.csv' ELSE '' END AS filename,
       CASE doc_id % 5 WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/csv' ELSE mime END AS mime_type
FROM i WHERE doc_id % 5 IN (1, 2, 4)""",
)
def exportable_items(spark, sf):
    items = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.concat("source", F.col("doc_id").cast("string")).alias("name"),
        F.get(F.array(*map(F.lit, _DRIVE)), (F.col("doc_id") % 5).cast("int")).alias("mime_type"),
        (F.col("lang") == "de").alias("is_folder"),
        (F.col("source") != "src0").alias("has_link"),
    )
    return workspace.select_exportable(items, "gdrive")


def _doc_blocks(spark, sf):
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.when(F.col("source") == "src1", "table").otherwise("text").alias("type"),
        F.col("text").alias("content"),
    )


# Greedy packing as a recursive fold over units (paragraphs, or sentences of long ones).
def _semantic_sql(sep: str) -> str:
    return r"""
WITH RECURSIVE p AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS pno, p, len(regexp_extract_all(p, '[^\s]+')) AS n
  FROM (SELECT doc_id, raw, {trim_p} AS p FROM (SELECT doc_id, generate_subscripts(l, 1) AS raw, unnest(l) AS p
        FROM (SELECT doc_id, string_split(text, {sep}) AS l FROM documents WHERE source <> 'src1'))) WHERE p <> ''
),
s AS (
  SELECT doc_id, pno, raw, t FROM (SELECT doc_id, pno, raw, {trim_t} AS t FROM (
    SELECT doc_id, pno, generate_subscripts(l, 1) AS raw, unnest(l) AS t
    FROM (SELECT doc_id, pno, string_split_regex(p, '[.?!]') AS l FROM p WHERE n > 512))) WHERE t <> ''
),
u AS (
  SELECT doc_id, pno, t, len(regexp_extract_all(t, '[^\s]+')) AS n, sent, row_number() OVER (PARTITION BY doc_id ORDER BY pno, raw) AS i
  FROM (SELECT doc_id, pno, 0 AS raw, p AS t, false AS sent FROM p WHERE n <= 512
        UNION ALL SELECT doc_id, pno, raw, t, true FROM s)
),
fold AS (
  SELECT doc_id, i, pno, sent, n AS last, n AS tokens, i AS lo, CAST(0 AS BIGINT) AS c FROM u WHERE i = 1
  UNION ALL
  SELECT doc_id, i, pno, sent, n,
         CASE WHEN NOT run THEN n WHEN tokens + n <= 512 THEN tokens + n WHEN keep THEN last + n ELSE n END,
         CASE WHEN NOT run THEN i WHEN tokens + n <= 512 THEN lo WHEN keep THEN i - 1 ELSE i END,
         CASE WHEN run AND tokens + n <= 512 THEN c ELSE c + 1 END
  FROM (SELECT u.doc_id, u.i, u.pno, u.sent, u.n, f.last, f.tokens, f.lo, f.c,
               u.sent = f.sent AND CASE WHEN u.sent THEN f.pno = u.pno ELSE f.pno + 1 = u.pno END AS run,
               CASE WHEN u.sent THEN u.i - f.lo > 1 ELSE f.last <= 64 END AS keep
        FROM fold f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1)
),
chunk AS (SELECT doc_id, c, max(i) AS hi, arg_max(lo, i) AS lo, arg_max(tokens, i) AS tokens, bool_or(sent) AS sent FROM fold GROUP BY 1, 2),
text AS (
  SELECT k.doc_id, k.c, k.tokens, CASE WHEN k.sent THEN string_agg(u.t, '. ' ORDER BY u.i) || '.'
         ELSE string_agg(u.t, chr(10) || chr(10) ORDER BY u.i) END AS content
  FROM chunk k JOIN u ON u.doc_id = k.doc_id AND u.i BETWEEN k.lo AND k.hi GROUP BY k.doc_id, k.c, k.tokens, k.sent
)
SELECT doc_id AS document_id, CAST(c AS INTEGER) AS chunk_index, CAST(tokens AS INTEGER) AS token_count, md5(content) AS content_md5 FROM text
UNION ALL
SELECT doc_id, 0, CAST(len(regexp_extract_all(text, '[^\s]+')) AS INTEGER), md5(text) FROM documents WHERE source = 'src1'
""".replace("{trim_p}", _TRIM.format("p")).replace("{trim_t}", _TRIM.format("t")).replace("{sep}", sep)


def _chunk_out(chunks, *extra):
    return chunks.select(
        "document_id", "chunk_index", "token_count", *extra, F.md5("content").alias("content_md5")
    )


@query("semantic_chunks", _semantic_sql("chr(10) || chr(10)"))
def semantic_chunks(spark, sf):
    return _chunk_out(chunking.semantic_chunks(_doc_blocks(spark, sf)))


@query("semantic_chunks_by_line", _semantic_sql("chr(10)"))
def semantic_chunks_by_line(spark, sf):
    return _chunk_out(chunking.semantic_chunks(_doc_blocks(spark, sf), sep="\n"))


@query("semantic_chunks_spread", _semantic_sql("chr(10)"))
def semantic_chunks_spread(spark, sf):
    return _chunk_out(spread_chunks.semantic_chunks_spread(_doc_blocks(spark, sf), sep="\n", long_chars=1 << 11))


_HIERARCHY = r"""
WITH p AS (
  SELECT doc_id, pno, p, regexp_extract_all(p, '[^\s]+') AS w FROM (
    SELECT doc_id, pno, {trim} AS p FROM (SELECT doc_id, generate_subscripts(l, 1) AS pno, unnest(l) AS p
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE source <> 'src1'))) WHERE p <> ''
),
kids AS (SELECT doc_id, pno, w, unnest(range(0, len(w), 128)) AS s FROM p),
every AS (
  SELECT doc_id, pno, -1 AS s, p AS content, len(w) AS n, 'hierarchical_parent' AS strategy FROM p
  UNION ALL SELECT doc_id, pno, s, array_to_string(w[s + 1 : s + 128], ' '), len(w[s + 1 : s + 128]), 'hierarchical_child' FROM kids
  UNION ALL SELECT doc_id, 0, -1, text, len(regexp_extract_all(text, '[^\s]+')), 'hierarchical_parent' FROM documents WHERE source = 'src1'
),
chunk AS (
  SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pno, s) - 1 AS INTEGER) AS chunk_index,
         CAST(n AS INTEGER) AS token_count, strategy, md5(content) AS content_md5 FROM every
)""".replace("{trim}", _TRIM.format("p"))


@query("hierarchical_chunks", _HIERARCHY + " SELECT * FROM chunk")
def hierarchical_chunks(spark, sf):
    return _chunk_out(chunking.hierarchical_chunks(_doc_blocks(spark, sf), sep="\n"), "strategy")


@query(
    "parent_of_child",
    _HIERARCHY + """
SELECT document_id, chunk_index, strategy, max(CASE WHEN strategy = 'hierarchical_parent' THEN chunk_index END)
       OVER (PARTITION BY document_id ORDER BY chunk_index) AS parent_index FROM chunk""",
)
def parent_of_child(spark, sf):
    chunks = chunking.hierarchical_chunks(_doc_blocks(spark, sf), sep="\n")
    return chunking.parent_of_child(chunks.select("document_id", "chunk_index", "strategy"))


@query(
    "routed_strategies",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN 'hierarchical' ELSE 'semantic' END AS strategy FROM documents",
)
def routed_strategies(spark, sf):
    asked = F.when(F.col("lang") == "de", "hierarchical").when(F.col("lang") == "en", "semantic").otherwise("auto")
    return fx.table(spark, sf, "documents").select("doc_id", chunking.route_strategy(asked).alias("strategy"))


# Blocks of a page chunked as one document: numbering runs on from block to block.
@query("page_chunks")
def page_chunks(spark, sf):
    blocks = html.html_to_blocks(fx.table(spark, sf, "pages").drop("url")).withColumnRenamed("page_id", "document_id")
    return _chunk_out(chunking.semantic_chunks(blocks), "block_no")


@query(
    "line_block_chunks",
    r"""
WITH b AS (
  SELECT doc_id, pno - 1 AS block_no, p, {trim} AS t FROM (SELECT doc_id, generate_subscripts(l, 1) AS pno, unnest(l) AS p
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
),
k AS (
  SELECT doc_id, block_no, t, regexp_extract_all(t, '[^\s]+') AS w FROM b WHERE t <> ''
),
kids AS (SELECT doc_id, block_no, w, unnest(range(0, len(w), 128)) AS s FROM k),
every AS (
  SELECT doc_id, block_no, -1 AS s, t AS content, len(w) AS n FROM k
  UNION ALL SELECT doc_id, block_no, s, array_to_string(w[s + 1 : s + 128], ' '), len(w[s + 1 : s + 128]) FROM kids
)
SELECT doc_id AS document_id, CAST(block_no AS INTEGER) AS block_no,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no, s) - 1 AS INTEGER) AS chunk_index,
       CAST(n AS INTEGER) AS token_count, md5(content) AS content_md5 FROM every""".replace("{trim}", _TRIM.format("p")),
)
def line_block_chunks(spark, sf):
    blocks = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.posexplode(F.split("text", "\n")).alias("block_no", "content"),
    ).withColumn("type", F.lit("text"))
    return _chunk_out(chunking.hierarchical_chunks(blocks), "block_no")
