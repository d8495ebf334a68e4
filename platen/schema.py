"""Schemas of the engine's tables, declared once."""

from __future__ import annotations

APPEARANCE = "struct<x:double,y:double,rendered_width:double,rendered_height:double>"
METADATA = "struct<width:int,height:int,filter:string,length:int,color_space:string,bits_per_component:int,predictor:int,colors:int,columns:int>"

FILES = "file_id string, length long, content binary"
OBJECTS = "file_id string, obj int, gen int, start int, body string, body_bin binary"
PAGES = "file_id string, page_no int, page_ref string, page_obj string, width double, height double, content string, error string"
CMAP = "file_id string, page_no int, font string, code string, uni string"
TEXT_ELEMENTS = "file_id string, page_no int, el_idx int, text string, x double, y double, font_size double, width double"
PAINT_OPS = "file_id string, page_no int, seq int, name string, matrix array<double>"
XOBJECTS = "file_id string, page_no int, name string, obj_num int"
IMAGES = f"file_id string, obj_num int, role string, format string, payload binary, metadata {METADATA}, appearances array<{APPEARANCE}>"
