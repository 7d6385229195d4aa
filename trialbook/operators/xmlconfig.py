"""Scenario XML as columns and child tables.

Both document layouts are read: the ``<config>`` of a scenario and the full simulator
file. A malformed document gives NULLs. The prolog is removed first, as the XML reader
rejects its version number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialbook.functions.texts import vector


def _attributes(*names: str) -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names])


def _many(*names: str) -> T.ArrayType:
    return T.ArrayType(_attributes(*names))


LIGHTS = T.StructField(
    "light", _many("id", "position", "orientation", "color", "intensity", "medium")
)
_PARAMS = _attributes(
    "target-color", "radius", "conn_start", "conn_end", "connection_range", "source", "sink", "area"
)
OBJECTS = T.StructType(
    [
        T.StructField("spawnCircle", _many("position", "radius")),
        T.StructField("spawnRectangle", _many("center", "angle", "width", "height")),
        T.StructField("circle", _many("position", "radius", "color")),
        T.StructField("rectangle", _many("center", "angle", "width", "height", "color")),
        T.StructField("epuck", _many("position")),
        T.StructField(
            "objective",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("_type", T.StringType()),
                        T.StructField("objective-params", T.ArrayType(_PARAMS)),
                    ]
                )
            ),
        ),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField(
            "env-elems",
            T.StructType([LIGHTS, T.StructField("arena-attrib", _attributes("size"))]),
        ),
        T.StructField("objective-elems", OBJECTS),
        T.StructField(
            "arena",
            T.StructType(
                [
                    T.StructField("_size", T.StringType()),
                    T.StructField("_center", T.StringType()),
                    LIGHTS,
                ]
            ),
        ),
        T.StructField("loop_functions", OBJECTS),
    ]
)


def parse(col: Column) -> Column:
    bare = F.regexp_replace(col, r"^\s*<\?xml[^>]*\?>", "")
    return F.from_xml(bare, DOCUMENT, {"mode": "PERMISSIVE"})


def with_document(df: DataFrame, xml: str, key: str) -> DataFrame:
    """Key plus the parsed objects: ``objects``, ``lights``, ``arena_size``, ``arena_center``."""
    parsed = df.select(key, parse(F.col(xml)).alias("_d"))
    return parsed.select(
        key,
        F.coalesce(F.col("_d.`objective-elems`"), F.col("_d.loop_functions")).alias("objects"),
        F.coalesce(F.col("_d.`env-elems`.light"), F.col("_d.arena.light")).alias("lights"),
        vector(
            F.coalesce(F.col("_d.`env-elems`.`arena-attrib`._size"), F.col("_d.arena._size")), 3
        ).alias("arena_size"),
        vector(F.col("_d.arena._center"), 3).alias("arena_center"),
    )


def _last_objective() -> Column:
    return F.try_element_at(F.col("objects.objective"), F.lit(-1))


def target_color(df: DataFrame, xml: str, key: str) -> DataFrame:
    """Target colour of the first objective; NULL when absent or not parseable."""
    params = F.flatten(F.transform(F.col("objects.objective"), lambda o: o["objective-params"]))
    first = F.try_element_at(params, F.lit(1))["_target-color"]
    return with_document(df, xml, key).select(key, first.alias("target_color"))


def objectives(df: DataFrame, xml: str, key: str) -> DataFrame:
    """The last objective with the parameters of its kind; those of other kinds stay NULL."""
    params = F.try_element_at(_last_objective()["objective-params"], F.lit(-1))
    kind = F.col("kind")

    def when_kind(kinds: tuple[str, ...], value: Column) -> Column:
        return F.when(kind.isin(*kinds), value)

    found = with_document(df, xml, key).select(
        key, _last_objective()["_type"].alias("kind"), params.alias("_p")
    )
    area = vector(F.col("_p._area"), 2)
    return found.filter("kind is not null").select(
        key,
        "kind",
        when_kind(("aggregation",), F.col("_p.`_target-color`")).alias("target_color"),
        when_kind(("aggregation",), F.col("_p._radius").try_cast("double")).alias("radius"),
        when_kind(("connection",), F.col("_p._conn_start")).alias("conn_start"),
        when_kind(("connection",), F.col("_p._conn_end")).alias("conn_end"),
        when_kind(
            ("connection", "distribution"), F.col("_p._connection_range").try_cast("double")
        ).alias("connection_range"),
        when_kind(("distribution",), F.get(area, F.lit(0))).alias("area_w"),
        when_kind(("distribution",), F.get(area, F.lit(1))).alias("area_h"),
        when_kind(("foraging",), F.col("_p._source")).alias("source"),
        when_kind(("foraging",), F.col("_p._sink")).alias("sink"),
    )


def _xy(text: Column) -> tuple[Column, Column]:
    """First two numbers of ``"x,y"`` or ``"x,y,z"``."""
    v = F.coalesce(vector(text, 2), vector(text, 3))
    return F.get(v, F.lit(0)), F.get(v, F.lit(1))


def circles(df: DataFrame, xml: str, key: str, element: str = "circle") -> DataFrame:
    """Floor circles (or ``spawnCircle``), numbered in document order."""
    rows = with_document(df, xml, key).select(
        key, F.posexplode(F.col(f"objects.{element}")).alias("circle_no", "_c")
    )
    x, y = _xy(F.col("_c._position"))
    color = [F.col("_c._color").alias("color")] if element == "circle" else []
    return rows.select(
        key, "circle_no", x.alias("x"), y.alias("y"),
        F.col("_c._radius").try_cast("double").alias("radius"), *color,
    )


def rectangles(df: DataFrame, xml: str, key: str, element: str = "rectangle") -> DataFrame:
    """Floor rectangles (or ``spawnRectangle``); width and height act as half-extents."""
    rows = with_document(df, xml, key).select(
        key, F.posexplode(F.col(f"objects.{element}")).alias("rect_no", "_r")
    )
    x, y = _xy(F.col("_r._center"))
    color = [F.col("_r._color").alias("color")] if element == "rectangle" else []
    return rows.select(
        key, "rect_no", x.alias("x"), y.alias("y"),
        F.col("_r._width").try_cast("double").alias("half_w"),
        F.col("_r._height").try_cast("double").alias("half_h"),
        F.col("_r._angle").try_cast("double").alias("angle_deg"), *color,
    )


def fixed_robots(df: DataFrame, xml: str, key: str) -> DataFrame:
    rows = with_document(df, xml, key).select(
        key, F.posexplode("objects.epuck").alias("robot_no", "_e")
    )
    x, y = _xy(F.col("_e._position"))
    return rows.select(key, "robot_no", x.alias("x"), y.alias("y"))


def lights(df: DataFrame, xml: str, key: str) -> DataFrame:
    """Lights with position and orientation as numbers."""
    rows = with_document(df, xml, key).select(
        key, F.posexplode("lights").alias("light_no", "_l")
    )
    at, turn = vector(F.col("_l._position"), 3), vector(F.col("_l._orientation"), 3)
    return rows.select(
        key,
        "light_no",
        F.col("_l._id").alias("light_id"),
        *[F.get(at, F.lit(i)).alias(n) for i, n in enumerate("xyz")],
        *[F.get(turn, F.lit(i)).alias(f"turn_{n}") for i, n in enumerate("zyx")],
        F.col("_l._color").alias("color"),
        F.col("_l._intensity").try_cast("double").alias("intensity"),
        F.col("_l._medium").alias("medium"),
    )


def arenas(df: DataFrame, xml: str, key: str) -> DataFrame:
    """Arena size and centre."""
    document = with_document(df, xml, key)
    return document.select(
        key,
        *[F.get("arena_size", F.lit(i)).alias(f"size_{n}") for i, n in enumerate("xyz")],
        *[F.get("arena_center", F.lit(i)).alias(f"center_{n}") for i, n in enumerate("xyz")],
    )
