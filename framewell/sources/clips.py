"""Pixels as rows: closed-form clips and adapters over relational tables.

The pixel schema is (media_id, frame, t, y, x, r, g, b). Clips are bounded generators over
``range``: a frame or region limit narrows the generated range itself, so a point read never
makes the whole frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PIXEL = T.StructType(
    [T.StructField("media_id", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("t", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b")]
)


@dataclass(frozen=True)
class Clip:
    """A closed-form clip; the expressions are SQL over frame, y and x."""

    name: str
    frames: int
    width: int
    height: int
    time: str
    r: str
    g: str
    b: str

    def sql(self, source: str) -> str:
        """SELECT of the pixel schema from ``source``, which has ids 0 .. frames*height*width-1."""
        n = self.width * self.height
        place = f"SELECT CAST(floor(id / {n}) AS INT) AS frame, CAST(floor((id % {n}) / {self.width}) AS INT) AS y, CAST(id % {self.width} AS INT) AS x FROM {source}"
        chan = ", ".join(f"CAST({e} AS INT) AS {c}" for c, e in (("r", self.r), ("g", self.g), ("b", self.b)))
        return f"SELECT '{self.name}' AS media_id, frame, CAST({self.time} AS DOUBLE) AS t, y, x, {chan} FROM ({place}) AS place"

    def duckdb(self) -> str:
        return self.sql(f"(SELECT range AS id FROM range({self.frames * self.width * self.height}))")

    def pixels(self, spark: SparkSession, frames: tuple[int, int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
        """Pixels of ``frames`` (half-open), or, for one frame, of ``rows`` of it."""
        a, z = frames or (0, self.frames)
        n = self.width * self.height
        lo, hi = a * n, z * n
        if rows and z == a + 1:
            lo, hi = lo + rows[0] * self.width, lo + rows[1] * self.width
        name = f"_range_{self.name}_{lo}_{hi}"
        spark.range(lo, hi).createOrReplaceTempView(name)
        return spark.sql(self.sql(name))


_AT30 = "frame / 30e0"
CLIPS = {
    c.name: c
    for c in (
        Clip("image16", 1, 16, 16, "0", "16 * x", "16 * y", "8 * (x + y)"),
        Clip(
            "basic", 30, 32, 32, _AT30,
            "CASE WHEN frame = 15 THEN 255 WHEN y = 8 AND x = frame THEN 255 WHEN y = 28 AND x = 2 THEN frame * 8 ELSE 0 END",
            "CASE WHEN frame = 15 THEN 255 WHEN y = 16 AND x = 24 THEN 255 WHEN y = 28 AND x = 2 THEN frame * 4 ELSE 0 END",
            "CASE WHEN frame = 15 THEN 255 WHEN y = 28 AND x = 2 THEN frame * 2 ELSE 0 END",
        ),
        Clip("compat", 10, 32, 32, _AT30, "20 + 20 * frame", "20 + 20 * frame", "20 + 20 * frame"),
        Clip("vfr", 20, 32, 32, "(100 * floor(frame / 2) + 20 * (frame % 2)) / 1e3", "12 * frame", "100", "255 - 12 * frame"),
        Clip("blink", 60, 32, 32, _AT30, *["CASE WHEN x >= 12 AND x < 20 AND y >= 12 AND y < 20 AND frame % 6 < 3 THEN 230 ELSE 30 END"] * 3),
        Clip("motion", 20, 64, 64, _AT30, *["CASE WHEN x >= 4 + 2 * frame AND x < 12 + 2 * frame AND y >= 28 AND y < 36 THEN 255 ELSE 0 END"] * 3),
        Clip("noise", 40, 64, 64, _AT30, *[f"((x * 73 + y * 151 + frame * 199 + {k}) * ((x + 7) * 13 + (y + 3) * 29 + frame * 31 + {k})) % 256" for k in (1, 5, 9)]),
        Clip("stripes8", 1, 64, 64, "0", *["floor(127 + 120 * sin(2 * 3.141592653589793e0 * x / 8))"] * 3),
        Clip("nyquist", 1, 16, 16, "0", *["CASE WHEN x % 2 = 0 THEN 255 ELSE 0 END"] * 3),
    )
}


def event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as irregular one-pixel clips: one clip for each user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255)).cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("media_id"), (F.row_number().over(w) - 1).cast("int").alias("frame"),
        ((us - F.first(us).over(w)) / 1e6).alias("t"), F.lit(0).alias("y"), F.lit(0).alias("x"), v.alias("r"), v.alias("g"), v.alias("b"), us.alias("pts"),
    )


EVENT_CLIPS_SQL = """
SELECT CAST(user_id AS VARCHAR) AS media_id, CAST(row_number() OVER w - 1 AS INT) AS frame,
       (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS t, 0 AS y, 0 AS x,
       CAST(least(greatest(floor(value), 0), 255) AS INT) AS r, CAST(least(greatest(floor(value), 0), 255) AS INT) AS g,
       CAST(least(greatest(floor(value), 0), 255) AS INT) AS b, epoch_us(ts) AS pts
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def embedding_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8x8 gray frames: one clip for each label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = Window.partitionBy("label").orderBy("vec_id")
    f = e.select(F.col("label").cast("string").alias("media_id"), (F.row_number().over(w) - 1).cast("int").alias("frame"), "embedding")
    p = f.select("media_id", "frame", (F.col("frame") / 30.0).alias("t"), F.posexplode("embedding").alias("i", "v"))
    q = F.least(F.greatest(F.floor((F.col("v").cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    return p.select("media_id", "frame", "t", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), q.alias("r"), q.alias("g"), q.alias("b"))


EMBEDDING_CLIPS_SQL = """
SELECT media_id, frame, frame / 30.0 AS t, CAST(floor(i / 8) AS INT) AS y, CAST(i % 8 AS INT) AS x, q AS r, q AS g, q AS b
FROM (SELECT media_id, frame, i - 1 AS i, CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5), 0), 255) AS INT) AS q
      FROM (SELECT CAST(label AS VARCHAR) AS media_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame,
                   embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))
"""


def lineitem_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as tall clips of scan lines: one clip for each return flag, one frame for each order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    top = li.groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])  # one pixel for each place
    return top.select(
        F.col("l_returnflag").alias("media_id"), F.col("l_orderkey").alias("frame"), F.col("l_orderkey").cast("double").alias("t"), F.lit(0).alias("y"), F.col("l_linenumber").alias("x"),
        F.floor("l_quantity").cast("int").alias("r"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("g"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("b"),
    )


LINEITEM_CLIPS_SQL = """
SELECT l_returnflag AS media_id, l_orderkey AS frame, CAST(l_orderkey AS DOUBLE) AS t, 0 AS y, l_linenumber AS x,
       CAST(floor(max(l_quantity)) AS INT) AS r, CAST(floor(max(l_discount) * 100 + 0.5) AS INT) AS g, CAST(floor(max(l_tax) * 100 + 0.5) AS INT) AS b
FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber
"""


def frames(px: DataFrame) -> DataFrame:
    """The frame table of pixels: one row for each frame, without pixels."""
    return px.groupBy("media_id", "frame").agg(F.min("t").alias("t"))
