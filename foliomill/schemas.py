"""Column layouts of the model tables, as DDL."""

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
COLOR = "struct<r:double,g:double,b:double>"
FRAGMENT = f"struct<text:string,bbox:{BOX},origin:{POINT}>"
PIECE = f"doc_id long, page int, line_no int, piece_no int, text string, font string, font_object int, size double, color {COLOR}, opacity double, bbox {BOX}, origin {POINT}, dir {POINT}"
SPAN = (
    f"doc_id long, span_id string, ordinal long, page int, line_no int, text string, font string, font_object int, size double, color {COLOR}, opacity double, "
    f"bbox {BOX}, origin {POINT}, dir {POINT}, turned boolean, fragments array<{FRAGMENT}>"
)
EDIT = "doc_id long, position int, kind string, span_ordinal long, page int, text string, start int, stop int, degrees int"
