"""Deterministic views of the fixture tables as tables of the engine, with the same formulas in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = 8
LINES = 50
PAGE = ["file_id", "page_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: documents as text elements of WORDS words each. The lines of a text are cut in one expression, without a shuffle."""
    words = F.split(F.coalesce("text", F.lit("")), "[ \n]+")
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / WORDS).cast("int"))
    lines = F.transform(starts, lambda i: F.array_join(F.slice("words", i * WORDS + 1, F.lit(WORDS)), " "))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), words.alias("words")).select("file_id", F.posexplode(lines).alias("line", "text"))
    headline = F.col("line") % 7 == 0
    el_no, n = F.col("line") % LINES, F.length("text")
    return rows.select(
        "file_id",
        F.floor(F.col("line") / LINES).cast("int").alias("page_no"),
        el_no.cast("int").alias("el_idx"),
        "text",
        F.when(headline, F.lit(306.0) - n * F.lit(2.75) + (F.col("line") % 5) * F.lit(15.0)).otherwise(F.lit(72.0)).alias("x"),
        (F.lit(720.0) - el_no * F.lit(14.0) - F.when(F.col("line") % 11 == 0, F.lit(40.0)).otherwise(F.lit(0.0))).alias("y"),
        F.when(headline, F.lit(16.0)).otherwise(F.lit(12.0)).alias("font_size"),
        (n * F.lit(5.5)).alias("width"),
    )


LAYOUT_SQL = """
  words AS (SELECT doc_id::VARCHAR AS file_id, string_split_regex(coalesce(text, ''), '[ \\n]+') AS w FROM documents),
  lines AS (SELECT file_id, i::INT AS line, array_to_string(list_slice(w, i * 8 + 1, i * 8 + 8), ' ') AS text FROM (SELECT file_id, w, unnest(range(0, (len(w) - 1) // 8 + 1)) AS i FROM words)),
  elements AS (SELECT file_id, (line // 50)::INT AS page_no, (line % 50)::INT AS el_idx, text,
    CASE WHEN line % 7 = 0 THEN 306::DOUBLE - length(text) * 2.75::DOUBLE + (line % 5) * 15::DOUBLE ELSE 72::DOUBLE END AS x,
    720::DOUBLE - (line % 50) * 14::DOUBLE - CASE WHEN line % 11 = 0 THEN 40::DOUBLE ELSE 0::DOUBLE END AS y,
    CASE WHEN line % 7 = 0 THEN 16::DOUBLE ELSE 12::DOUBLE END AS font_size, length(text) * 5.5::DOUBLE AS width FROM lines)"""


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the layout, from word counts alone."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[ \n]+"))
    last = F.floor(F.floor((words - 1) / WORDS) / LINES).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.explode(F.sequence(F.lit(0), last)).alias("page_no"))


def content_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: the layout as content streams.

    Each element becomes two chunks whose heights differ by 0.25: the first ends with a hex part and a
    kern that is no space, the second holds hex and, after its first word's space, a wide kern
    in the place of that space.
    """
    e = layout(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))"), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")
    code = lambda c: F.concat(F.lit("<"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))
    # The first space of the tail is written as a wide kern.
    space = F.locate(" ", tail)
    split = F.when(space > 1, F.concat(code(F.substring_index(tail, " ", 1)), F.lit(" -200 "), code(F.expr("substring(substring(text, cast(floor(length(text) / 2) as int) + 1), locate(' ', substring(text, cast(floor(length(text) / 2) as int) + 1)) + 1)"))))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("/F1 "), F.col("font_size").cast("string"), F.lit(" Tf")),
        F.concat(F.lit("1 0 0 1 "), F.format_string("%.4f", "x"), F.lit(" "), F.format_string("%.4f", "y"), F.lit(" Tm")),
        F.when(half > 0, F.concat(F.lit("["), code(head), F.lit(" -100] TJ"))),
        F.concat(F.format_string("%.4f", F.when(half > 0, 0.0).otherwise(F.col("x"))), F.lit(" "), F.format_string("%.4f", F.col("y") - F.when(half > 0, 0.25).otherwise(0.0)), F.lit(" Td")),
        F.concat(F.lit("["), F.regexp_replace(F.coalesce(split, code(tail)), "<>", ""), F.lit("] TJ")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("el_idx", lines.alias("l"))))
    return e.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda s: s["l"]), "\n").alias("content"))


_WORD_ENDS = re.compile("[ \n]+")


def content_pages(text: str | None) -> list[str]:
    """C for Python: the content streams of one document's pages, as content_streams makes them."""
    code = lambda s: f"<{s.encode('utf-16-be').hex().upper()}>" if s else ""
    offset = [f"{720.0 - at * 14.0 - more:.4f}" for more in (0.0, 40.0, 0.25, 40.25) for at in range(LINES)]
    words, pages = _WORD_ENDS.split(text or ""), []
    for line, start in enumerate(range(0, len(words), WORDS)):
        shown, at = " ".join(words[start : start + WORDS]), line % LINES
        half, n, headline = len(shown) // 2, len(shown), line % 7 == 0
        x = 306.0 - n * 2.75 + line % 5 * 15.0 if headline else 72.0
        y = at + (0 if line % 11 else LINES)
        tail = shown[half:]
        space = tail.find(" ")
        # The first space of the tail is written as a wide kern.
        rest = f"{code(tail[:space])} -200 {code(tail[space + 1 :])}" if space > 0 else code(tail)
        moved = f"[{code(shown[:half])} -100] TJ\n0.0000 {offset[y + 2 * LINES]} Td" if half else f"{x:.4f} {offset[y]} Td"
        if not at:
            pages.append([])
        pages[-1].append(f"/F1 {16.0 if headline else 12.0} Tf\n1 0 0 1 {x:.4f} {offset[y]} Tm\n{moved}\n[{rest}] TJ")
    return ["\n".join(lines) for lines in pages]


def identity_fonts(pages: DataFrame) -> DataFrame:
    """A font F1 of four-digit codes that stand for themselves, for each page."""
    codes = F.lit([f"{c:04X}" for c in range(32, 401)])
    return pages.select(*PAGE, F.lit("F1").alias("font"), codes.alias("codes"), codes.alias("values"))


def paint(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G: lineitem and part as placed images (file_id, page_no, seq, obj_num, matrix), image objects and pages."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    d = F.col("l_quantity") * F.lit(15.84) * F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(1.0))
    matrix = F.array(F.col("l_quantity") * F.lit(12.24), F.lit(0.0), F.lit(0.0), d, F.col("l_tax") * F.lit(100.0), F.col("l_discount") * F.lit(1000.0))
    ops = li.select(
        F.floor(F.col("l_orderkey") / 8).cast("string").alias("file_id"), F.col("l_orderkey").cast("int").alias("page_no"), F.row_number().over(order).alias("seq"), F.concat(F.lit("Im"), F.col("l_partkey").cast("string")).alias("name"), matrix.alias("matrix"), F.col("l_partkey").cast("int").alias("part")
    )
    images = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").cast("int").alias("part"), F.col("p_partkey").cast("int").alias("obj_num"))
    xobjects = ops.select(*PAGE, "name", "part").distinct().join(images, "part").select(*PAGE, "name", "obj_num")
    pages = ops.select(*PAGE).distinct().select(*PAGE, F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return ops.drop("part"), xobjects, pages


PAINT_SQL = """
  ops AS (SELECT (l_orderkey // 8)::VARCHAR AS file_id, l_orderkey::INT AS page_no,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS seq, l_partkey::INT AS part,
    l_quantity * 12.24::DOUBLE AS a, l_quantity * 15.84::DOUBLE * CASE WHEN l_returnflag = 'R' THEN -1::DOUBLE ELSE 1::DOUBLE END AS d, l_tax * 100::DOUBLE AS e, l_discount * 1000::DOUBLE AS f FROM lineitem),
  placed AS (SELECT o.*, part AS obj_num FROM ops o JOIN part p ON p.p_partkey = o.part WHERE p_size % 2 = 0),
  covered AS (SELECT *, least(abs(a) * abs(d) / (612::DOUBLE * 792::DOUBLE), 1::DOUBLE) AS cov, CASE WHEN d < 0 THEN f + d ELSE f END AS y FROM placed),
  background AS (SELECT file_id, page_no, arg_min(obj_num, seq) AS obj_num, arg_min(e, seq) AS x, arg_min(y, seq) AS y, arg_min(abs(a), seq) AS w, arg_min(abs(d), seq) AS h FROM covered WHERE cov >= 0.8::DOUBLE GROUP BY file_id, page_no)"""


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: events as an edit log of pages with ten elements each."""
    ev = table(spark, sf_dir, "events")
    op = F.element_at(F.create_map(*(F.lit(v) for kv in {"click": "text", "view": "font_size", "purchase": "color", "signup": "toggle_bold", "error": "shift"}.items() for v in kv)), F.col("event_type"))
    return ev.select(
        F.lit("events").alias("file_id"), F.col("user_id").cast("int").alias("page_no"), F.struct("ts", "event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 10).cast("int").alias("el_idx"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.col("value").alias("number"), F.concat(F.lit("#"), F.lpad(F.hex(F.col("event_id") % 4096), 3, "0")).alias("color"),
    )


def edit_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("page_no")).distinct()
    rows = pages.select(F.lit("events").alias("file_id"), "page_no", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("el_idx"))
    return rows.select("file_id", "page_no", "el_idx", F.concat(F.lit("line "), F.col("el_idx").cast("string")).alias("text"), F.lit(72.0).alias("x"), (F.lit(700.0) - F.col("el_idx") * F.lit(14.4)).alias("y"), F.lit(12.0).alias("font_size"), F.lit(33.0).alias("width"))


def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: events as keys, caret moves, inserts, removals, font sizes and shifts, to be replayed in order."""
    ev, n = table(spark, sf_dir, "events"), F.col("event_id")
    kind, turn = F.col("event_type"), n % 3
    op = (
        F.when(kind.isin("click", "purchase") | ((kind == "signup") & (turn == 0)), "key").when(kind == "view", "caret")
        .when(kind == "signup", F.when(turn == 1, "insert").otherwise("font_size")).otherwise(F.when(n % 2 == 0, "remove").otherwise("shift"))
    )
    text = (
        F.when(kind == "click", F.when(n % 6 == 0, " ").otherwise(F.char(n % 26 + 97))).when(kind == "purchase", F.when(n % 4 == 0, "ArrowLeft").otherwise("Backspace"))
        .when(turn == 0, "ArrowRight").when(turn == 1, F.concat(F.lit("new "), n.cast("string"))).otherwise(F.when(n % 5 == 0, "abc").otherwise((n % 20 + 8).cast("string")))
    )
    number = F.when(kind == "view", F.when(n % 2 == 0, n % 90).otherwise(0)).when(kind == "signup", n % 3 + 11).when(kind == "error", F.col("value"))
    return ev.select(
        F.lit("events").alias("file_id"), F.col("user_id").cast("int").alias("page_no"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), op.alias("op"),
        (n % 8).cast("int").alias("el_idx"), text.alias("text"), number.cast("double").alias("number"), F.lit(72.0).alias("x"), (F.lit(640.0) - n % 40).alias("y"),
    )


def replay_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the log with texts near the length at which they wrap."""
    text = F.concat("text", F.lit(" "), F.expr("repeat('word ', 14 + el_idx % 5)"))
    return edit_elements(spark, sf_dir).withColumn("text", text).withColumn("width", F.length("text") * F.lit(5.5))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F: documents as files with sizes and types."""
    mime = F.when(F.col("doc_id") % 3 == 0, "image/png").otherwise("application/pdf")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 4096).alias("size"), mime.alias("mime"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: embeddings as rows of 16 CMYK pixels."""
    byte = lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", byte).alias("cmyk"))


def cmap_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z: a character map for each language: single entries, a range, and a second entry for one code."""
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("file_id")).distinct().withColumn("n", F.length("file_id") * 16 + F.ascii("file_id"))
    code = lambda c: F.concat(F.lit("<"), F.lpad(F.hex(c), 4, "0"), F.lit(">"))
    text = F.concat_ws(
        "\n", F.lit("2 beginbfchar"), F.concat(code(F.col("n")), F.lit(" <0041>")), F.concat(code(F.col("n")), F.lit(" <00660069>")), F.lit("<0a> <0042>"), F.lit("endbfchar"), F.lit("1 beginbfrange"),
        F.concat(code(F.col("n") + 1), F.lit(" "), code(F.col("n") + 20), F.lit(" <0061>")), F.lit("  endbfrange"), F.lit("<0001> <0002>"),
    )
    return langs.select("file_id", text.alias("cmap_text"))
