"""What the shapes of an SVG are painted with, after inheritance.

``painted`` walks each drawing once in Arrow batches: colours, `currentColor` and opacities come
down the tree, `use` elements stand for their targets, and every painted shape becomes a leaf.
Kinds of paint and the limits are native expressions over the leaves.
"""

from __future__ import annotations

import colorsys
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.functions.svg import local

# Tags, the least alpha of a solid face, slack to white, limits, the CSS colour names.
PAINTED = frozenset("path rect circle ellipse polygon polyline line text tspan".split())
UNSEEN = frozenset("defs symbol clipPath mask marker pattern linearGradient radialGradient filter".split())
TIMED = frozenset("animate animatecolor animatetransform animatemotion set".split())
SOLID, WHITE_SLACK = 0.99, 6
MAX_TRANSLUCENT, LATTICE_STEP, LATTICE_WHITE = 32, 51, 204
CSS_NAMES = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e
coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b
darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc
darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3
deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22
fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f
grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa
lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3
lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899
lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa
mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585
midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000
olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093
papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399
red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee
sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f
steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3
white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()
NAMES = {n: tuple(bytes.fromhex(h)) for n, h in zip(CSS_NAMES[::2], CSS_NAMES[1::2])}

LEAF = "struct<tag:string,fill:array<int>,fill_alpha:double,stroke:array<int>,stroke_alpha:double>"
#: Nested uses beyond which references are taken for a cycle.
MAX_USES = 32
_CALL = re.compile(r"(rgb|hsl)a?\(([^)]*)\)")


class PaintError(ValueError):
    """The paint can't be told from the file alone; args[0] says why."""


def colour(value: str) -> tuple[int, int, int]:
    """A CSS name, #rgb, #rrggbb (alpha digits are ignored), rgb() or hsl() as three integers."""
    v = value.strip().lower()
    if v in NAMES:
        return NAMES[v]
    if re.fullmatch(r"#[0-9a-f]{3,4}|#[0-9a-f]{6}|#[0-9a-f]{8}", v):
        digits = v[1:] if len(v) > 5 else "".join(2 * c for c in v[1:])
        return tuple(bytes.fromhex(digits[:6]))
    m = _CALL.fullmatch(v)
    parts = re.split(r"[\s,/]+", m[2].strip()) if m else []
    try:
        if len(parts) >= 3 and m[1] == "rgb":
            level = [float(p[:-1]) * 2.55 if p.endswith("%") else float(p) for p in parts[:3]]
            return tuple(max(0, min(255, round(x))) for x in level)
        if len(parts) >= 3:
            h, s, light = float(parts[0].removesuffix("deg")) % 360 / 360, float(parts[1].rstrip("%")) / 100, float(parts[2].rstrip("%")) / 100
            return tuple(int(x * 255 + 0.5) for x in colorsys.hls_to_rgb(h, light, s))
    except (ValueError, OverflowError):
        pass
    raise PaintError("unknown-colour")


def _resolved(own: dict[str, str], prop: str, above, current):
    """The colour that an element's own declarations leave for a paint property, None for no paint."""
    said = own.get(prop, "").strip().lower()
    known = {"": above, "inherit": above, "none": None, "transparent": None, "currentcolor": current}
    if said in known or said.startswith("context-"):
        return known.get(said, above)
    if said.startswith("url("):
        raise PaintError("paint-server")
    return colour(said)


_SHARE = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*")


def _alpha(own: dict[str, str], prop: str, above: float) -> float:
    """A declared share within 0 and 1; what isn't a number counts as not declared."""
    said = own.get(prop, "")
    return min(max(float(said), 0.0), 1.0) if _SHARE.fullmatch(said) else above


def _own(el) -> dict[str, str]:
    """Presentation attributes, overruled by the inline style."""
    out = {k: v.strip() for k, v in el.attrib.items() if k in ("fill", "stroke", "color", "opacity", "fill-opacity", "stroke-opacity")}
    return out | {k.strip().lower(): v.strip() for k, _, v in (d.partition(":") for d in el.get("style", "").split(";")) if v}


def leaves(svg: str) -> list[dict]:
    """Painted shapes in paint order; a PaintError if a paint can't be told."""
    try:
        root = ET.fromstring(svg)
    except (ET.ParseError, ValueError):
        raise PaintError("parse-error") from None
    targets: dict[str, ET.Element] = {}
    for el in root.iter():
        if local(el.tag) == "style" and (el.text or "").strip():
            raise PaintError("css-block")
        targets.setdefault(el.get("id") or "", el)
    out = []
    # (element, fill, stroke, their opacities, opacity of the groups, color, uses above, as a use's target)
    todo = [(root, (0, 0, 0), None, 1.0, 1.0, 1.0, (0, 0, 0), 0, False)]
    while todo:
        el, fill, stroke, fill_op, stroke_op, op, current, uses, target = todo.pop()
        tag = local(el.tag)
        if not tag or tag in UNSEEN and not (target and tag == "symbol"):
            continue
        if tag not in TIMED:
            own = _own(el)
            current = _resolved(own, "color", current, current) or current
            fill, stroke = _resolved(own, "fill", fill, current), _resolved(own, "stroke", stroke, current)
            fill_op, stroke_op, op = _alpha(own, "fill-opacity", fill_op), _alpha(own, "stroke-opacity", stroke_op), op * _alpha(own, "opacity", 1.0)
        if tag in PAINTED:
            out.append({"tag": tag, "fill": fill, "fill_alpha": op * fill_op if fill else 0.0, "stroke": stroke, "stroke_alpha": op * stroke_op if stroke else 0.0})
        below = list(el)
        if tag == "use":
            if uses >= MAX_USES:
                raise PaintError("use-cycle")
            name = next((v for k, v in el.attrib.items() if local(k) == "href" or k == "href"), "")
            if name.startswith("#") and name[1:] in targets:
                below.append(targets[name[1:]])
        state = (fill, stroke, fill_op, stroke_op, op, current, uses + (tag == "use"))
        todo += [(c, *state, tag == "use") for c in reversed(below)]
    return out


def code_colours() -> np.ndarray:
    """The colours of a 6-level grid that aren't near white, each as far as can be from those before."""
    grid = np.array([c for c in product(range(0, 256, LATTICE_STEP), repeat=3) if min(c) < LATTICE_WHITE])
    gap, order = ((grid - 255) ** 2).sum(1), []
    for n in range(len(grid)):
        order.append(int(gap.argmax()))
        away = ((grid - grid[order[-1]]) ** 2).sum(1)
        gap = np.minimum(gap, away) if n else away
    return grid[order].astype(np.uint8)


def painted(rows: DataFrame, svg: str = "svg") -> DataFrame:
    """rows with `leaves`, `fill_kinds`, `stroke_kinds`, `n_opaque`, `n_translucent`, `cause`.

    A kind is opaque, paper (solid and nearly white), translucent, or null without paint. cause
    is null, or says why no labels can be derived: parse-error, css-block, paint-server,
    unknown-colour, use-cycle, too-translucent, too-many-colours; leaves are null for the
    first five and for a null drawing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        for b in batches:
            found, causes = [], []
            for t in b.column(svg).to_pylist():
                try:
                    found.append(None if t is None else leaves(t))
                    causes.append(None)
                except PaintError as e:
                    found.append(None)
                    causes.append(e.args[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, want.field("leaves").type), pa.array(causes, pa.string())], names=[*b.schema.names, "leaves", "cause"])

    schema = rows.select("*", F.lit(None).cast(f"array<{LEAF}>").alias("leaves"), F.lit(None).cast("string").alias("cause")).schema
    out = rows.mapInArrow(run, schema)
    for k in ("fill", "stroke"):
        out = out.withColumn(f"{k}_kinds", F.expr(f"transform(leaves, x -> case when x.{k} is null then null when x.{k}_alpha < {SOLID} then 'translucent' when array_min(x.{k}) >= {255 - WHITE_SLACK} then 'paper' else 'opaque' end)"))
    solid = "array_distinct(concat({}))".format(", ".join(f"transform(filter(arrays_zip(leaves, {k}_kinds), z -> z.{k}_kinds = 'opaque'), z -> z.leaves.{k})" for k in ("fill", "stroke")))
    out = out.withColumns({"n_opaque": F.expr(f"if(leaves is null, null, size({solid}))"), "n_translucent": F.expr("if(leaves is null, null, size(filter(concat(fill_kinds, stroke_kinds), k -> k = 'translucent')))")})
    return out.withColumn("cause", F.coalesce("cause", F.when(F.col("n_translucent") > MAX_TRANSLUCENT, "too-translucent").when(F.col("n_opaque") > len(code_colours()), "too-many-colours")))
