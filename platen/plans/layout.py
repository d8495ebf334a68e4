"""Layout queries over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.functions.text import char_width, literal_string, trimmed, unicode_hex
from platen.operators import classify, content
from platen.plans import adapters
from platen.session import attach

PAGE = ["file_id", "page_no"]


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, line and paragraph counts of each page."""
    elements = adapters.layout(spark, sf_dir)
    return classify.page_counts(elements)


_KINDS = (
    "WITH RECURSIVE "
    + adapters.LAYOUT_SQL.strip()
    + """,
  solid AS (SELECT *, coalesce(x, 0) + CASE WHEN width IS NULL OR width = 0 THEN length(trim(text)) * 5.5::DOUBLE ELSE width END / 2 AS centre FROM elements WHERE trim(text) <> ''),
  kinds AS (SELECT *, abs(centre - 612::DOUBLE / 2) < 612::DOUBLE * 0.065::DOUBLE AS is_header FROM solid),
  body AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_no ORDER BY y DESC, el_idx) AS rn, avg(font_size) OVER (PARTITION BY file_id, page_no) AS mean_font FROM kinds WHERE NOT is_header),
  fold AS (
    SELECT file_id, page_no, rn, 1 AS para_id, width AS widest, width AS last_width, y AS last_y FROM body WHERE rn = 1
    UNION ALL
    SELECT b.file_id, b.page_no, b.rn,
      f.para_id + CASE WHEN f.last_width < f.widest * 0.85::DOUBLE OR f.last_y - b.y > b.mean_font * 1.2::DOUBLE * 2.5::DOUBLE THEN 1 ELSE 0 END,
      CASE WHEN f.last_width < f.widest * 0.85::DOUBLE OR f.last_y - b.y > b.mean_font * 1.2::DOUBLE * 2.5::DOUBLE THEN b.width ELSE greatest(f.widest, b.width) END, b.width, b.y
    FROM fold f JOIN body b ON b.file_id = f.file_id AND b.page_no = f.page_no AND b.rn = f.rn + 1),
  lines_of AS (SELECT b.*, f.para_id FROM body b JOIN fold f USING (file_id, page_no, rn))"""
)


def l_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout's elements, blank ones left out."""
    e = adapters.layout(spark, sf_dir)
    return e.select(*PAGE, "el_idx", trimmed("text").alias("text"), "x", "y", "font_size", char_width("text").alias("width")).filter("length(text) > 0")


def f9_f11_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.headers(classify.with_kind(adapters.layout(spark, sf_dir)))


def f10_f12_body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.body_lines(classify.with_kind(adapters.layout(spark, sf_dir)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.paragraph_lines(classify.body_lines(classify.with_kind(adapters.layout(spark, sf_dir))))


def w4_w6_o1_paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*PAGE, "el_idx", "line_pos", "para_id")


def a5_a6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.paragraphs(_lines(spark, sf_dir)).select(*PAGE, "para_id", "x", "y", "width", "font_size", F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda r: r["text"]), "\n").alias("text"))


def w5_line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap to the line above, in reading order."""
    from pyspark.sql import Window

    order = Window.partitionBy(*PAGE).orderBy("line_pos")
    return _lines(spark, sf_dir).select(*PAGE, "el_idx", (F.lag("y").over(order) - F.col("y")).alias("gap"))


def a4_mean_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the line height that the mean font size gives."""
    body = classify.body_lines(classify.with_kind(adapters.layout(spark, sf_dir)))
    return body.groupBy(*PAGE).agg((F.avg(F.when(F.col("font_size").isNull() | (F.col("font_size") == 0), 14.0).otherwise(F.col("font_size"))) * F.lit(1.2)).alias("line_height"))


def f13_f20_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page; pages without elements have empty arrays."""
    e = adapters.layout(spark, sf_dir)
    texts = lambda c: F.array_join(F.transform(F.coalesce(c, F.expr("array()")), lambda r: r["text"]), "|")
    pages = adapters.layout_pages(spark, sf_dir)
    # Each file has one more page without elements.
    blank = pages.groupBy("file_id").agg((F.max("page_no") + 1).cast("int").alias("page_no")).select(*PAGE)
    out = classify.classification(e, pages.unionByName(blank))
    return out.select(*PAGE, texts(F.col("headers")).alias("headers"), texts(F.col("text")).alias("text"), "header_count", "text_count", "paragraph_count")


def o4_o5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's samples: three headers of each page, cut to 60 characters."""
    return classify.samples(classify.headers(classify.with_kind(adapters.layout(spark, sf_dir))), "el_idx", "text")


def p1_text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout written as content streams and read back."""
    streams = adapters.content_streams(attach(spark), sf_dir)
    return content.text_elements(streams, adapters.identity_fonts(adapters.layout_pages(spark, sf_dir))).select(*PAGE, "text", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "font_size", "width")


def w1_w2_text_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font and place in effect on each line of a stream."""
    state = content.with_text_state(content.stream_lines(adapters.content_streams(spark, sf_dir)))
    return state.groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.count("font").alias("with_font"), F.countDistinct("font_size", "x", "y").alias("states"))


def w3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of chunks whose heights are near that of the run's first chunk; heights from events."""
    ev = adapters.table(spark, sf_dir, "events").select(F.lit("e").alias("file_id"), F.col("user_id").cast("int").alias("page_no"), F.struct("ts", "event_id").alias("line_no"), F.col("event_type").alias("chunk"), F.lit(1.0).alias("x"), (F.floor("value") / 4).alias("y"), F.lit(12.0).alias("font_size"))
    return content.merged_runs(ev)


def p2_p3_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of text operators, counted by kind for each page."""
    parts = content.text_parts(content.with_text_state(content.stream_lines(adapters.content_streams(spark, sf_dir)))).select(*PAGE, F.explode("parts").alias("p"))
    return parts.groupBy(*PAGE).agg(F.count_if(F.col("p").startswith("<")).alias("hex_parts"), F.count_if(~F.col("p").startswith("<")).alias("kerns"), F.count_if(F.col("p").try_cast("double") < -150).alias("spaces"))


def t6_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal strings with escapes; documents in which backslashes and brackets are planted."""
    docs = adapters.table(spark, sf_dir, "documents")
    token = F.concat(F.lit("("), F.translate(F.col("text"), "aeiou", "\\()nt"), F.lit(")"))
    return docs.select("doc_id", literal_string(token).alias("text"))


def t7_unicode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 digits to text and back; digits that don't come in fours give nothing."""
    docs = adapters.table(spark, sf_dir, "documents")
    digits = F.hex(F.encode("text", "UTF-16BE"))
    return docs.select("doc_id", unicode_hex(digits).alias("text"), unicode_hex(F.concat(digits, F.lit("0"))).alias("odd"), F.hex(F.encode("text", "UTF-8")).alias("utf8"))


def t12_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.table(spark, sf_dir, "documents")
    return docs.select("doc_id", trimmed(F.concat(F.lit(" ﻿\t　"), F.col("text"), F.lit("  \n"))).alias("text"))


QUERIES = (
    page_summary, l_elements, f9_f11_headers, f10_f12_body_lines, w4_w6_o1_paragraph_lines, a5_a6_paragraphs, w5_line_gaps, a4_mean_font, f13_f20_classification, o4_o5_samples, p1_text_elements, w1_w2_text_state, w3_runs, p2_p3_parts, t6_literals,
    t7_unicode_hex, t12_trim,
)

_STREAM = (
    "WITH "
    + adapters.LAYOUT_SQL.strip()
    + """,
  halves AS (SELECT *, length(text) // 2 AS half, substr(text, length(text) // 2 + 1) AS tail FROM elements)"""
)

ORACLES = {
    "page_summary": _KINDS + """
      SELECT e.file_id, e.page_no, count(k.el_idx) FILTER (k.is_header) AS header_count, count(k.el_idx) FILTER (NOT k.is_header) AS text_count, coalesce(max(l.para_id), 0)::BIGINT AS paragraph_count
      FROM elements e LEFT JOIN kinds k USING (file_id, page_no, el_idx) LEFT JOIN lines_of l USING (file_id, page_no, el_idx) GROUP BY e.file_id, e.page_no""",
    "l_elements": "WITH " + adapters.LAYOUT_SQL.strip() + " SELECT file_id, page_no, el_idx, trim(text) AS text, x, y, font_size, width FROM elements WHERE trim(text) <> ''",
    "f9_f11_headers": _KINDS + " SELECT file_id, page_no, el_idx, trim(text) AS text, x AS x_position, y AS y_position, font_size, centre AS element_centre, 'center' AS alignment FROM kinds WHERE is_header",
    "f10_f12_body_lines": _KINDS + " SELECT file_id, page_no, el_idx, text, x, y, font_size, width FROM kinds WHERE NOT is_header",
    "w4_w6_o1_paragraph_lines": _KINDS + " SELECT file_id, page_no, el_idx, (rn - 1)::INT AS line_pos, para_id::INT AS para_id FROM lines_of",
    "a5_a6_paragraphs": _KINDS + """
      SELECT file_id, page_no, para_id::INT AS para_id, arg_min(x, rn) AS x, arg_min(y, rn) AS y, max(width) AS width, arg_min(font_size, rn) AS font_size, count(*)::INT AS n_lines, string_agg(text, chr(10) ORDER BY rn) AS text FROM lines_of GROUP BY ALL""",
    "w5_line_gaps": _KINDS + " SELECT file_id, page_no, el_idx, lag(y) OVER (PARTITION BY file_id, page_no ORDER BY rn) - y AS gap FROM body",
    "a4_mean_font": _KINDS + " SELECT file_id, page_no, avg(font_size) * 1.2::DOUBLE AS line_height FROM body GROUP BY ALL",
    "f13_f20_classification": _KINDS + """
      SELECT file_id, page_no, coalesce(string_agg(text, '|' ORDER BY k.el_idx) FILTER (is_header), '') AS headers, coalesce(string_agg(text, '|' ORDER BY k.el_idx) FILTER (NOT is_header), '') AS text,
        (count(k.el_idx) FILTER (is_header))::INT AS header_count, (count(k.el_idx) FILTER (NOT is_header))::INT AS text_count, coalesce(max(para_id), 0)::INT AS paragraph_count
      FROM (SELECT DISTINCT file_id, page_no FROM elements UNION ALL SELECT file_id, (max(page_no) + 1)::INT FROM elements GROUP BY file_id) p
      LEFT JOIN kinds k USING (file_id, page_no) LEFT JOIN (SELECT file_id, page_no, el_idx, para_id FROM lines_of) l USING (file_id, page_no, el_idx) GROUP BY file_id, page_no""",
    "o4_o5_samples": _KINDS + " SELECT file_id, page_no, el_idx AS place, substr(trim(text), 1, 60) AS sample FROM kinds WHERE is_header QUALIFY row_number() OVER (PARTITION BY file_id, page_no ORDER BY el_idx) <= 3",
    "p1_text_elements": "WITH " + adapters.LAYOUT_SQL.strip() + " SELECT file_id, page_no, trim(text) AS text, round(x, 3) AS x, round(y, 3) AS y, font_size, width FROM elements WHERE trim(text) <> ''",
    "w1_w2_text_state": _STREAM + """
      , stated AS (SELECT file_id, page_no, el_idx, half, font_size, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(half) OVER w AS ph FROM halves WINDOW w AS (PARTITION BY file_id, page_no ORDER BY el_idx))
      , states AS (
        SELECT file_id, page_no, font_size, x AS sx, round(y, 4) AS sy FROM stated UNION SELECT file_id, page_no, font_size, 0::DOUBLE, round(y - 0.25::DOUBLE, 4) FROM stated WHERE half > 0
        UNION SELECT file_id, page_no, font_size, CASE WHEN ph > 0 THEN 0::DOUBLE ELSE px END, round(py - CASE WHEN ph > 0 THEN 0.25::DOUBLE ELSE 0::DOUBLE END, 4) FROM stated WHERE py IS NOT NULL)
      SELECT file_id, page_no, n_lines, with_font, states FROM (SELECT file_id, page_no, sum(CASE WHEN half > 0 THEN 5 ELSE 4 END)::BIGINT AS n_lines, sum(CASE WHEN half > 0 THEN 5 ELSE 4 END)::BIGINT AS with_font FROM halves GROUP BY ALL)
      JOIN (SELECT file_id, page_no, count(*) AS states FROM states GROUP BY ALL) USING (file_id, page_no)""",
    "w3_runs": """WITH RECURSIVE ev AS (SELECT user_id::INT AS page_no, event_type AS chunk, floor(value) / 4 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      fold AS (SELECT page_no, rn, 0 AS run, y AS first_y, chunk FROM ev WHERE rn = 1
        UNION ALL SELECT e.page_no, e.rn, f.run + CASE WHEN coalesce(abs(f.first_y - e.y) <= 0.5, false) THEN 0 ELSE 1 END, CASE WHEN coalesce(abs(f.first_y - e.y) <= 0.5, false) THEN f.first_y ELSE e.y END, e.chunk FROM fold f JOIN ev e ON e.page_no = f.page_no AND e.rn = f.rn + 1)
      SELECT 'e' AS file_id, page_no, run::INT AS el_idx, string_agg(chunk, '' ORDER BY rn) AS text, 1::DOUBLE AS x, any_value(first_y) AS y, 12::DOUBLE AS font_size, sum(length(chunk)) * 5.5::DOUBLE AS width FROM fold GROUP BY page_no, run""",
    "p2_p3_parts": _STREAM + """
      , spaced AS (SELECT *, strpos(tail, ' ') > 1 AS kern FROM halves)
      SELECT file_id, page_no, sum(CASE WHEN half > 0 THEN 1 ELSE 0 END + CASE WHEN kern THEN 1 + CASE WHEN strpos(tail, ' ') < length(tail) THEN 1 ELSE 0 END ELSE CASE WHEN tail <> '' THEN 1 ELSE 0 END END)::BIGINT AS hex_parts,
        sum(CASE WHEN half > 0 THEN 1 ELSE 0 END + CASE WHEN kern THEN 1 ELSE 0 END)::BIGINT AS kerns, sum(CASE WHEN kern THEN 1 ELSE 0 END)::BIGINT AS spaces FROM spaced GROUP BY ALL HAVING hex_parts > 0""",
    "t6_literals": r"""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(translate(text, 'aeiou', '\()nt'), '\\', '\'), '\(', '('), '\)', ')'), '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), '\b', chr(8)), '\f', chr(12)) AS text FROM documents""",
    "t7_unicode_hex": "SELECT doc_id, text, '' AS odd, hex(encode(text)) AS utf8 FROM documents",
    "t12_trim": r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM documents",
}
