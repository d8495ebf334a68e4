"""Paint, viewer, edit, file, map and pixel queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.functions import cmap as maps
from platen.functions.files import rejection
from platen.functions.geometry import coverage, line_height, page_scale, wrap_limit
from platen.functions.pixels import cmyk_to_rgb, colours, paeth, rgb_to_rgba
from platen.functions.text import clock_time, file_size, hex_of, index_of, jpeg_data_url, missing_characters, utf8_hex, zero_bytes
from platen.operators import edits, paint, render
from platen.plans import adapters
from platen.plans.layout import _KINDS, _lines
from platen.session import attach

PAGE = ["file_id", "page_no"]
_PAINT = "WITH " + adapters.PAINT_SQL.strip() + " "


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ops, xobjects, pages = adapters.paint(spark, sf_dir)
    return paint.placed_images(ops, xobjects), xobjects, pages


def a13_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, M1 to M3, F16, O3, A13."""
    placed, _, pages = _placed(spark, sf_dir)
    return paint.backgrounds(placed, pages).select(*PAGE, "obj_num", "appearance.*")


def m1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, _ = _placed(spark, sf_dir)
    return placed.select(*PAGE, "seq", "obj_num", coverage(F.col("matrix"), F.lit(612.0), F.lit(792.0)).alias("coverage"))


def a2_j11_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, first and last placement of each object over its file's pages."""
    placed, xobjects, _ = _placed(spark, sf_dir)
    listed = paint.first_appearance(paint.appearances(placed, xobjects))
    return listed.select("file_id", "obj_num", F.size("appearances").alias("n"), "first.x", "first.y", F.try_element_at("appearances", F.lit(-1))["rendered_width"].alias("last_width"))


def a1_u2_o9_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, xobjects, _ = _placed(spark, sf_dir)
    return paint.image_objects(xobjects, ["page_no", "name"]).select("file_id", "obj_num", F.col("first_seen.page_no").alias("first_page"))


def j9_j10_i5_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each page without its background, with placements over the file."""
    placed, xobjects, pages = _placed(spark, sf_dir)
    images = paint.appearances(placed, xobjects)
    return paint.page_images(images, xobjects, paint.backgrounds(placed, pages)).select(*PAGE, "obj_num", F.size("appearances").alias("n"))


def w7_f15_paint_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of paints from streams made of events: cm, Do, q, Q, comments and blanks."""
    ev = adapters.table(spark, sf_dir, "events")
    cm = F.concat((F.col("event_id") % 97).cast("string"), F.lit(" 0 0 1 "), (F.col("event_id") % 13).cast("string"), F.lit(" 2 cm"))
    line = F.when(F.col("event_type") == "click", cm).when(F.col("event_type") == "view", "/Im1 Do").when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "Q").otherwise("  q"))
    line = line.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, "% /Im9 Do").otherwise("")).otherwise(F.concat(cm, F.lit(" /Im2 Do")))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l"))))
    streams = ev.groupBy(F.lit("e").alias("file_id"), F.col("user_id").cast("int").alias("page_no")).agg(F.array_join(F.transform(ordered, lambda s: s["l"]), "\r\n").alias("content"))
    return paint.paint_operations(paint.paint_lines(streams)).select(*PAGE, "seq", "name", F.col("matrix")[0].alias("a"), F.col("matrix")[4].alias("e"))


def m6_page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file_id"), F.lit(0).alias("page_no"), (F.col("p_size") * 10.0).alias("width"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 12.0).alias("height"))
    return render.page_frames(pages)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.layout_pages(spark, sf_dir).select(*PAGE, F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def m5_m8_text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, M5, M8."""
    return render.text_boxes(adapters.layout(spark, sf_dir), _frames(spark, sf_dir))


def m7_image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, M7: the background boxes."""
    placed, _, pages = _placed(spark, sf_dir)
    return render.image_boxes(paint.backgrounds(placed, pages).select(*PAGE, "obj_num", "appearance.*"), pages)


def m14_line_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.layout(spark, sf_dir)
    return e.select(*PAGE, "el_idx", line_height(F.col("font_size")).alias("line_height"), wrap_limit(F.col("x"), page_scale(F.lit(612.0))).alias("wrap_limit"))


def j12_element_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.layout(spark, sf_dir)
    return render.element_paragraphs(e, _lines(spark, sf_dir))


def j13_header_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.operators import classify

    e = adapters.layout(spark, sf_dir).withColumn("text", F.regexp_replace("text", "^ +| +$", ""))
    return render.header_styled(e, classify.headers(classify.with_kind(e)))


def e1_e4_property_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edits.apply_property_edits(adapters.edit_elements(spark, sf_dir), adapters.edit_log(spark, sf_dir))
    return out.drop("file_id", "is_italic", "x", "y", "width")


def e5_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: one shift of each page, from its last error."""
    last = adapters.edit_log(spark, sf_dir).filter("op = 'shift'").groupBy("page_no").agg(F.max_by("number", "seq").alias("amount"))
    e = adapters.edit_elements(spark, sf_dir).join(last, "page_no")
    return edits.shift_below(e, F.lit(649.0), F.col("amount")).select("page_no", "el_idx", "y")


def e5_shift_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, xobjects, _ = _placed(spark, sf_dir)
    moved = edits.shift_images_below(paint.appearances(placed, xobjects), F.lit(50.0), F.lit(14.4))
    return moved.select("file_id", "obj_num", F.size("appearances").alias("n"), F.try_element_at("appearances", F.lit(1))["y"].alias("y"))


def e6_e14_replayed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page after its whole log."""
    attach(spark)
    return edits.replay(adapters.replay_elements(spark, sf_dir), adapters.replay_log(spark, sf_dir)).drop("file_id")


def j15_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element under the last caret of each page."""
    carets = adapters.replay_log(spark, sf_dir).filter("op = 'caret'").groupBy(*PAGE).agg(F.max_by("el_idx", "seq").alias("el_idx"))
    return edits.elements_at(adapters.replay_elements(spark, sf_dir), carets).select("page_no", "el_idx", "text")


def f18_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.files(spark, sf_dir).select("doc_id", rejection(F.col("size"), F.col("mime")).alias("reason"))


def t13_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.files(spark, sf_dir).select("doc_id", file_size(F.floor(F.col("size") / F.pow(F.lit(10), F.col("doc_id") % 7)).cast("long")).alias("shown"))


def t14_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "events").select("event_id", clock_time("ts").alias("clock"))


def t2_t4_t15_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    return d.select("doc_id", index_of("text", "the").cast("long").alias("the_at"), utf8_hex("text").alias("digits"), hex_of(F.col("n_chars"), 4).alias("n_hex"))


def k4_data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    return d.select("doc_id", jpeg_data_url(F.encode("text", "UTF-8")).alias("url"))


def j14_u3_missing_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    known = F.split(F.lit("abcdefghijklmnopqrstuvwxyz "), "")
    return d.select("doc_id", F.array_join(F.array_sort(missing_characters("text", known)), "").alias("missing"))


def t11_a10_cmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, W8, T11, A10, T15."""
    return maps.parse_cmaps(adapters.cmap_streams(spark, sf_dir), ["file_id"])


def t8_char_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.char_map(maps.parse_cmaps(adapters.cmap_streams(spark, sf_dir), ["file_id"]))


def t9_a12_o2_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = maps.parse_cmaps(adapters.cmap_streams(spark, sf_dir), ["file_id"]).groupBy("file_id").agg(F.collect_list("code").alias("codes"))
    return codes.select("file_id", F.array_join(maps.code_lengths(F.col("codes")).cast("array<string>"), ",").alias("lengths"))


def t10_j8_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as four-digit codes through a map that lacks some; array form and general form side by side."""
    attach(spark)
    codes = [f"{c:04X}" for c in range(32, 123)]
    literal = F.lit(codes)  # a literal: a computed map would be built anew for each code
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-16BE")).alias("digits"))
    fast = maps.translate_single(F.concat(F.lit("<"), F.col("digits"), F.lit(">")), F.map_from_arrays(literal, literal), 4)
    general = maps.translate_udf({"plain": dict(zip(codes, codes, strict=True))})
    return d.select("doc_id", fast.alias("text"), general("digits", F.lit("plain")).alias("general"))


def j8_mixed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two and four digits in one map; the longest that fits counts, unknown ones are shown."""
    attach(spark)
    # 41 is a letter, 4141 and 4142 are others: only the longest match tells them apart. 43 is known in its long form alone.
    mixed = {"41": "0061", "42": "0062", "4141": "0078", "4142": "0079", "4343": "007A"}
    digits = F.hex(F.encode(F.regexp_replace(F.translate("text", "aeioutnrs", "AAABBCCAB"), "[^ABC]", ""), "UTF-8"))
    general = maps.translate_udf({"mixed": mixed})
    return adapters.table(spark, sf_dir, "documents").select("doc_id", general(digits, F.lit("mixed")).alias("text"))


def m9_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: channels of colour spaces."""
    space = F.element_at(F.array(*map(F.lit, ("DeviceGray", "DeviceCMYK", "DeviceRGB", "ICCBased"))), (F.col("event_id") % 4 + 1).cast("int"))
    return adapters.table(spark, sf_dir, "events").select("event_id", colours(space).alias("channels"))


def m10_paeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor of each three neighbouring bytes."""
    one = lambda i: paeth(F.get("cmyk", i), F.get("cmyk", i + 1), F.get("cmyk", i + 2))
    return adapters.pixels(spark, sf_dir).select("vec_id", F.array_join(F.transform(F.sequence(F.lit(0), F.size("cmyk") - 3), one).cast("array<string>"), ",").alias("predicted"))


def t3_empty_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of a length, all zero."""
    return adapters.table(spark, sf_dir, "events").select("event_id", F.hex(zero_bytes(F.col("event_id") % 50)).alias("digits"))


def m11_cmyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = adapters.pixels(spark, sf_dir)
    return x.select("vec_id", F.array_join(cmyk_to_rgb(F.col("cmyk")).cast("array<string>"), ",").alias("rgb"))


def m12_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = adapters.pixels(spark, sf_dir)
    return x.select("vec_id", F.array_join(rgb_to_rgba(F.col("cmyk"), 3).cast("array<string>"), ",").alias("rgba"), F.array_join(rgb_to_rgba(F.col("cmyk"), 1).cast("array<string>"), ",").alias("gray"))


QUERIES = (
    a13_backgrounds, m1_coverage, a2_j11_appearances, a1_u2_o9_objects, j9_j10_i5_page_images, w7_f15_paint_operations, m6_page_frames, m5_m8_text_boxes, m7_image_boxes, m14_line_limits, j12_element_paragraphs, j13_header_styled,
    e1_e4_property_edits, e5_shift, e5_shift_images, e6_e14_replayed_edits, j15_cursors, f18_file_checks, t13_file_sizes, t14_clock, t2_t4_t15_strings, k4_data_urls, j14_u3_missing_characters, t11_a10_cmaps, t8_char_map, t9_a12_o2_code_lengths, t10_j8_translate, j8_mixed_codes, m9_colours, m10_paeth, t3_empty_bytes, m11_cmyk, m12_rgba,
)

_SCALE = "(850::DOUBLE / 612::DOUBLE)"
_MAPS = """WITH langs AS (SELECT DISTINCT lang AS file_id, length(lang) * 16 + ascii(lang) AS n FROM documents),
  maps AS (SELECT file_id, lpad(to_hex(n), 4, '0') AS code, '00660069' AS uni FROM langs UNION ALL SELECT file_id, '0A', '0042' FROM langs
    UNION ALL SELECT file_id, lpad(to_hex(n + k), 4, '0'), lpad(to_hex(96 + k), 4, '0') FROM langs, range(1, 21) r(k)) """

_REPLAY = """log AS (
    SELECT user_id::INT AS page_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (event_id % 8)::INT AS k, 640::DOUBLE - event_id % 40 AS y, value,
      CASE event_type WHEN 'click' THEN 'key' WHEN 'purchase' THEN 'key' WHEN 'view' THEN 'caret' WHEN 'signup' THEN ['key', 'insert', 'font_size'][event_id % 3 + 1] ELSE ['remove', 'shift'][event_id % 2 + 1] END AS op,
      CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 6 = 0 THEN ' ' ELSE chr((97 + event_id % 26)::INT) END WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'ArrowLeft' ELSE 'Backspace' END
        WHEN event_id % 3 = 0 THEN 'ArrowRight' WHEN event_id % 3 = 1 THEN 'new ' || event_id WHEN event_id % 5 = 0 THEN 'abc' ELSE (event_id % 20 + 8)::VARCHAR END AS txt,
      (CASE WHEN event_id % 2 = 0 THEN event_id % 90 ELSE 0 END)::INT AS caret, (event_id % 3 + 11)::DOUBLE AS size
    FROM events),
  base AS (SELECT page_no, i::INT AS el_idx, 'line ' || i || ' ' || repeat('word ', 14 + i % 5) AS text FROM (SELECT DISTINCT user_id::INT AS page_no FROM events), range(10) r(i))"""

ORACLES = {
    "e6_e14_replayed_edits": "WITH RECURSIVE " + _REPLAY + """,
  state AS (
    SELECT page_no, 0::BIGINT AS n, list({'text': text, 'x': 72::DOUBLE, 'y': 700::DOUBLE - el_idx * 14.4::DOUBLE, 'size': 12::DOUBLE, 'width': length(text) * 5.5::DOUBLE} ORDER BY el_idx) AS els, 0 AS pos, 0 AS off FROM base GROUP BY page_no
    UNION ALL
    SELECT page_no, n,
      CASE
        WHEN op = 'insert' THEN list_slice(els, 1, k + 1) || [{'text': txt, 'x': 72::DOUBLE, 'y': y, 'size': size, 'width': length(txt) * 5.5::DOUBLE}] || list_slice(els, k + 2, len(els))
        WHEN op = 'remove' THEN list_slice(els, 1, k) || list_slice(els, k + 2, len(els))
        WHEN op = 'shift' THEN list_transform(els, lambda e: {'text': e.text, 'x': e.x, 'y': CASE WHEN e.y < y THEN e.y - value ELSE e.y END, 'size': e.size, 'width': e.width})
        WHEN op = 'font_size' AND k < len(els) AND txt <> 'abc' THEN list_transform(els, lambda e, i: {'text': e.text, 'x': e.x, 'y': e.y, 'size': CASE WHEN i = k + 1 THEN txt::DOUBLE ELSE e.size END, 'width': e.width})
        WHEN cuts THEN list_transform(els, lambda e, i: CASE WHEN i = pos + 1 THEN {'text': cut, 'x': e.x, 'y': e.y, 'size': e.size, 'width': length(cut) * 5.5::DOUBLE} ELSE e END)
        WHEN merges THEN list_transform(list_slice(els, 1, pos) || list_slice(els, pos + 2, len(els)), lambda e, i: {'text': CASE WHEN i = pos THEN e.text || now.text ELSE e.text END, 'x': e.x,
          'y': CASE WHEN e.y < now.y - 1 THEN e.y + height ELSE e.y END, 'size': e.size, 'width': CASE WHEN i = pos THEN length(e.text || now.text) * 5.5::DOUBLE ELSE e.width END})
        WHEN wraps THEN list_transform(list_slice(els, 1, pos), lambda e: {'text': e.text, 'x': e.x, 'y': CASE WHEN e.y < now.y - 1 THEN e.y - height ELSE e.y END, 'size': e.size, 'width': e.width})
          || [{'text': left(grown, space), 'x': now.x, 'y': now.y, 'size': now.size, 'width': space * 5.5::DOUBLE}, {'text': substr(grown, space + 2), 'x': now.x, 'y': now.y - height, 'size': now.size, 'width': (length(grown) - space - 1) * 5.5::DOUBLE}]
          || list_transform(list_slice(els, pos + 2, len(els)), lambda e: {'text': e.text, 'x': e.x, 'y': CASE WHEN e.y < now.y - 1 THEN e.y - height ELSE e.y END, 'size': e.size, 'width': e.width})
        WHEN types THEN list_transform(els, lambda e, i: CASE WHEN i = pos + 1 THEN {'text': grown, 'x': e.x, 'y': e.y, 'size': e.size, 'width': length(grown) * 5.5::DOUBLE} ELSE e END)
        ELSE els END,
      CASE WHEN op = 'caret' THEN k WHEN merges OR (goes_left AND off = 0 AND pos > 0) THEN pos - 1 WHEN wraps OR (goes_right AND off >= length(now.text) AND pos < len(els) - 1) THEN pos + 1 ELSE pos END,
      CASE WHEN op = 'caret' THEN caret WHEN cuts OR (goes_left AND off > 0) THEN off - 1 WHEN merges OR (goes_left AND pos > 0) THEN length(before.text)
        WHEN wraps THEN CASE WHEN off + 1 > space THEN off - space ELSE off + 1 END WHEN types OR (goes_right AND off < length(now.text)) THEN off + 1 WHEN goes_right AND pos < len(els) - 1 THEN 0 ELSE off END
    FROM (
      SELECT *, here AND txt = 'Backspace' AND off > 0 AS cuts, here AND txt = 'Backspace' AND off = 0 AND pos > 0 AND before.y > now.y AS merges, here AND length(txt) = 1 AS types, here AND txt = 'ArrowLeft' AS goes_left, here AND txt = 'ArrowRight' AS goes_right,
        here AND length(txt) = 1 AND length(grown) * 5.5::DOUBLE > 810::DOUBLE / (850::DOUBLE / 612::DOUBLE) - now.x AND space >= 0 AS wraps
      FROM (
        SELECT *, CASE WHEN strpos(grown, ' ') > 0 THEN length(grown) - strpos(reverse(grown), ' ') ELSE -1 END AS space
        FROM (
          SELECT *, left(now.text, off) || txt || substr(now.text, off + 1) AS grown, CASE WHEN off > 0 THEN left(now.text, off - 1) ELSE '' END || substr(now.text, off + 1) AS cut, now.size * 1.2::DOUBLE AS height
          FROM (
            SELECT s.page_no, l.n, l.k, l.y, l.value, l.op, l.txt, l.caret, l.size, s.els, s.pos, s.off, s.els[s.pos + 1] AS now, CASE WHEN s.pos > 0 THEN s.els[s.pos] END AS before, l.op = 'key' AND s.pos < len(s.els) AS here
            FROM state s JOIN log l ON l.page_no = s.page_no AND l.n = s.n + 1))))),
  ends AS (SELECT page_no, arg_max(els, n) AS els FROM state GROUP BY page_no),
  rows AS (SELECT page_no, unnest(els) AS e, generate_subscripts(els, 1) - 1 AS el_idx FROM ends)
  SELECT page_no, el_idx::INT AS el_idx, e.text AS text, e.x AS x, e.y AS y, e.size AS font_size, e.width AS width FROM rows""",
    "j15_cursors": "WITH " + _REPLAY + ", last AS (SELECT page_no, arg_max(k, n) AS el_idx FROM log WHERE op = 'caret' GROUP BY page_no) SELECT page_no, el_idx, text FROM base JOIN last USING (page_no, el_idx)",
    "a13_backgrounds": _PAINT + "SELECT file_id, page_no, obj_num, x, y, w AS rendered_width, h AS rendered_height FROM background",
    "m1_coverage": _PAINT + "SELECT file_id, page_no, seq, obj_num, cov AS coverage FROM covered",
    "a2_j11_appearances": _PAINT + "SELECT file_id, obj_num, count(*)::INT AS n, arg_min(e, (page_no, seq)) AS x, arg_min(y, (page_no, seq)) AS y, arg_max(abs(a), (page_no, seq)) AS last_width FROM covered GROUP BY ALL",
    "a1_u2_o9_objects": _PAINT + "SELECT file_id, obj_num, min(page_no) AS first_page FROM placed GROUP BY ALL",
    "j9_j10_i5_page_images": _PAINT + """SELECT file_id, p.page_no, obj_num, n FROM (SELECT DISTINCT file_id, page_no, obj_num FROM placed) p JOIN (SELECT file_id, obj_num, count(*)::INT AS n FROM placed GROUP BY ALL) c USING (file_id, obj_num)
      WHERE NOT EXISTS (SELECT 1 FROM background b WHERE b.file_id = p.file_id AND b.page_no = p.page_no AND b.obj_num = p.obj_num)""",
    "w7_f15_paint_operations": """WITH ev AS (SELECT user_id::INT AS page_no, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seq FROM events),
      marked AS (SELECT *, event_type IN ('click', 'error') AS sets, event_type IN ('view', 'error') AS paints, event_type = 'purchase' AND event_id % 2 = 0 AS restores FROM ev),
      kept AS (SELECT *, CASE WHEN paints OR restores THEN [NULL, NULL] WHEN sets THEN [(event_id % 97)::DOUBLE, (event_id % 13)::DOUBLE] END AS event FROM marked),
      waiting AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM kept)
      SELECT 'e' AS file_id, page_no, seq, CASE WHEN event_type = 'view' THEN 'Im1' ELSE 'Im2' END AS name, CASE WHEN sets THEN (event_id % 97)::DOUBLE ELSE coalesce(w[1], 1) END AS a, CASE WHEN sets THEN (event_id % 13)::DOUBLE ELSE coalesce(w[2], 0) END AS e FROM waiting WHERE paints""",
    "m6_page_frames": "SELECT p_partkey::VARCHAR AS file_id, 0 AS page_no, 850::DOUBLE / (p_size * 10::DOUBLE) AS scale, 850::DOUBLE AS canvas_width, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size * 12::DOUBLE END, 792) * (850::DOUBLE / (p_size * 10::DOUBLE)) AS canvas_height FROM part",
    "m5_m8_text_boxes": "WITH " + adapters.LAYOUT_SQL.strip() + f" SELECT file_id, page_no, el_idx, x * {_SCALE} AS left_px, (792::DOUBLE - y - font_size * 0.8::DOUBLE) * {_SCALE} AS top_px, font_size * {_SCALE} AS font_px FROM elements",
    "m7_image_boxes": _PAINT + f"SELECT file_id, page_no, obj_num, x * {_SCALE} AS left_px, (792::DOUBLE - y - h) * {_SCALE} AS top_px, w * {_SCALE} AS width_px, h * {_SCALE} AS height_px FROM background",
    "m14_line_limits": "WITH " + adapters.LAYOUT_SQL.strip() + f" SELECT file_id, page_no, el_idx, font_size * 1.2::DOUBLE AS line_height, 810::DOUBLE / {_SCALE} - x AS wrap_limit FROM elements",
    "j12_element_paragraphs": _KINDS + """, firsts AS (SELECT file_id, page_no, x, y, text, min(el_idx) AS el_idx FROM elements GROUP BY ALL),
      owned AS (SELECT f.file_id, f.page_no, f.el_idx, max(para_id)::INT AS para_id FROM lines_of l JOIN firsts f USING (file_id, page_no, x, y, text) GROUP BY ALL)
      SELECT e.file_id, e.page_no, e.el_idx, coalesce(o.para_id::VARCHAR, 'header') AS para_id FROM elements e LEFT JOIN owned o USING (file_id, page_no, el_idx)""",
    "j13_header_styled": _KINDS + """SELECT e.file_id, e.page_no, e.el_idx, EXISTS (SELECT 1 FROM kinds k WHERE k.is_header AND k.file_id = e.file_id AND k.page_no = e.page_no AND trim(k.text) = trim(e.text)) AS is_header_style FROM elements e""",
    "e1_e4_property_edits": """WITH log AS (SELECT user_id::INT AS page_no, (event_id % 10)::INT AS el_idx, ts, event_id, event_type, value FROM events),
      sets AS (SELECT page_no, el_idx, arg_max('t' || event_id, (ts, event_id)) FILTER (event_type = 'click') AS t, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS s,
        arg_max('#' || lpad(to_hex(event_id % 4096), 3, '0'), (ts, event_id)) FILTER (event_type = 'purchase') AS c, count(*) FILTER (event_type = 'signup') % 2 = 1 AS b FROM log GROUP BY ALL),
      base AS (SELECT page_no, i::INT AS el_idx FROM (SELECT DISTINCT user_id::INT AS page_no FROM events), range(10) r(i))
      SELECT page_no, el_idx, coalesce(t, 'line ' || el_idx) AS text, coalesce(s, 12) AS font_size, c AS color, coalesce(b, false) AS is_bold FROM base LEFT JOIN sets USING (page_no, el_idx)""",
    "e5_shift": """WITH last AS (SELECT user_id::INT AS page_no, arg_max(value, (ts, event_id)) AS amount FROM events WHERE event_type = 'error' GROUP BY ALL),
      rows AS (SELECT page_no, i::INT AS el_idx, 700::DOUBLE - i * 14.4::DOUBLE AS y, amount FROM last, range(10) r(i)) SELECT page_no, el_idx, CASE WHEN y < 649 THEN y - amount ELSE y END AS y FROM rows""",
    "e5_shift_images": _PAINT + """SELECT file_id, obj_num, CASE WHEN y < 50 THEN 1 ELSE n END AS n, CASE WHEN y < 50 THEN y - 14.4::DOUBLE ELSE y END AS y
      FROM (SELECT file_id, obj_num, count(*)::INT AS n, arg_min(y, (page_no, seq)) AS y FROM covered GROUP BY ALL)""",
    "f18_file_checks": "SELECT doc_id, CASE WHEN n_chars * 4096 > 52428800 THEN 'too_large' WHEN doc_id % 3 = 0 THEN 'not_pdf' END AS reason FROM documents",
    "t13_file_sizes": """WITH s AS (SELECT doc_id, floor(n_chars * 4096 / pow(10, doc_id % 7)) AS n FROM documents), v AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 ELSE 2 END AS k FROM s)
      SELECT doc_id, CASE WHEN n = 0 THEN '0 B' ELSE regexp_replace(regexp_replace(printf('%.2f', floor(n / pow(1024, k) * 100 + 0.5) / 100), '0+$', ''), '\\.$', '') || ' ' || ['B', 'KB', 'MB'][k + 1] END AS shown FROM v""",
    "t14_clock": "SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events",
    "t2_t4_t15_strings": "SELECT doc_id, strpos(text, 'the') - 1 AS the_at, hex(encode(text)) AS digits, CASE WHEN length(to_hex(n_chars)) >= 4 THEN to_hex(n_chars) ELSE lpad(to_hex(n_chars), 4, '0') END AS n_hex FROM documents",
    "k4_data_urls": "SELECT doc_id, 'data:image/jpeg;base64,' || base64(encode(text)) AS url FROM documents",
    "j14_u3_missing_characters": "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(text, '')), lambda c: c <> '' AND strpos('abcdefghijklmnopqrstuvwxyz ', c) = 0)), '') AS missing FROM documents",
    "t11_a10_cmaps": _MAPS + "SELECT file_id, code, uni FROM maps",
    "t8_char_map": _MAPS + "SELECT file_id, code, CASE WHEN uni = '00660069' THEN 'fi' WHEN uni = '0042' THEN 'B' ELSE chr(('0x' || uni)::INT) END AS char FROM maps",
    "t9_a12_o2_code_lengths": "SELECT DISTINCT lang AS file_id, '4,2' AS lengths FROM documents",
    "t10_j8_translate": """WITH c AS (SELECT doc_id, list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1)) AS cs FROM documents),
      t AS (SELECT doc_id, array_to_string(list_transform(cs, lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 122 THEN c ELSE '[?' || lpad(to_hex(unicode(c)), 4, '0') || ']' END), '') AS text FROM c) SELECT doc_id, text, text AS general FROM t""",
    "j8_mixed_codes": """WITH c AS (SELECT doc_id, regexp_replace(translate(text, 'aeioutnrs', 'AAABBCCAB'), '[^ABC]', '', 'g') AS s FROM documents),
      m AS (SELECT doc_id, list_transform(regexp_extract_all(s, 'AA|AB|CC|A|B|C'), lambda t: CASE t WHEN 'AA' THEN 'x' WHEN 'AB' THEN 'y' WHEN 'CC' THEN 'z' WHEN 'A' THEN 'a' WHEN 'B' THEN 'b' ELSE '[?43]' END) AS parts FROM c)
      SELECT doc_id, array_to_string(parts, '') AS text FROM m""",
    "m9_colours": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END AS channels FROM events",
    "m10_paeth": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: (floor(abs(v::DOUBLE) * 1000) % 256)::INT) AS c FROM embeddings),
      n AS (SELECT vec_id, list_transform(range(1, len(c) - 1), lambda i: {'l': c[i], 'u': c[i + 1], 'k': c[i + 2], 'p': c[i] + c[i + 1] - c[i + 2]}) AS t FROM b)
      SELECT vec_id, array_to_string(list_transform(t, lambda z: CASE WHEN abs(z.p - z.l) <= abs(z.p - z.u) AND abs(z.p - z.l) <= abs(z.p - z.k) THEN z.l WHEN abs(z.p - z.u) <= abs(z.p - z.k) THEN z.u ELSE z.k END), ',') AS predicted FROM n""",
    "t3_empty_bytes": "SELECT event_id, repeat('00', (event_id % 50)::INT) AS digits FROM events",
    "m11_cmyk": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: (floor(abs(v::DOUBLE) * 1000) % 256)::INT) AS c FROM embeddings)
      SELECT vec_id, array_to_string(list_transform(range(0, 48), lambda i: floor(255::DOUBLE * (1::DOUBLE - c[(i // 3) * 4 + i % 3 + 1] / 255::DOUBLE) * (1::DOUBLE - c[(i // 3) * 4 + 4] / 255::DOUBLE) + 0.5::DOUBLE)::INT), ',') AS rgb FROM b""",
    "m12_rgba": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: (floor(abs(v::DOUBLE) * 1000) % 256)::INT) AS c FROM embeddings)
      SELECT vec_id, array_to_string(list_transform(range(0, len(c) // 3 * 4), lambda i: CASE WHEN i % 4 = 3 THEN 255 ELSE c[(i // 4) * 3 + i % 4 + 1] END), ',') AS rgba, array_to_string(list_transform(range(0, len(c) * 4), lambda i: CASE WHEN i % 4 = 3 THEN 255 ELSE c[i // 4 + 1] END), ',') AS gray FROM b""",
}
