"""CSV tracks, archives, road networks and track exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.geodesy import planar
from driftline.functions.scalars import header_key

ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")


#: Bytes that windows-1252 leaves undefined: fixed values.
UNDEFINED = "\x81\x8d\x8f\x90\x9d"


def _byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text that may not be UTF-8 (raw), and with a character for each byte (value)."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("raw"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"))


def sniffed_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that every line of all files decodes with, counted in the executors."""
    odd = F.translate("value", UNDEFINED, "") != F.col("value")
    n = _byte_lines(spark, path).agg(F.count_if(~F.is_valid_utf8("raw")).alias("not_utf8"), F.count_if(odd).alias("not_western")).first()
    return ENCODINGS[0] if not n.not_utf8 else ENCODINGS[1] if not n.not_western else ENCODINGS[2]


def undecoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file and value (its bytes as characters) of the lines that ``encoding`` does not decode."""
    lines = _byte_lines(spark, path).select(F.input_file_name().alias("file"), "raw", "value")
    wrong = {"UTF-8": ~F.is_valid_utf8("raw"), "windows-1252": F.translate("value", UNDEFINED, "") != F.col("value")}
    return lines.filter(wrong.get(encoding, F.lit(False))).drop("raw")


def _western(df: DataFrame) -> DataFrame:
    """Text read as ISO-8859-1 as what it is in windows-1252: they differ in the control range alone."""
    pairs = [(chr(i), bytes([i]).decode("windows-1252", "ignore")) for i in range(0x80, 0xA0)]
    was, now = ("".join(x) for x in zip(*[p for p in pairs if p[1]], strict=True))
    return df.select(*[F.translate(F.col(f"`{c}`"), was, now).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, names: dict[str, str], *, encoding: str | None = None) -> DataFrame:
    """A CSV with headers mapped to names; unknown, missing and repeated ones are errors.

    ``names`` maps header texts (white space and case do not matter) to column names. Without an ``encoding`` all
    lines are looked at to find one; with one that does not fit, :func:`undecoded` has the lines.
    """
    encoding = encoding or sniffed_encoding(spark, path)
    west = encoding == "windows-1252"  # not among Spark's character sets

    def read(header: bool) -> DataFrame:
        df = spark.read.csv(path, header=header, encoding="ISO-8859-1" if west else encoding)
        return _western(df) if west else df

    raw = read(False)
    first = raw.limit(1).select(*[header_key(F.regexp_replace(c, "^﻿", "")).alias(c) for c in raw.columns]).first()
    known = {" ".join(k.split()).lower(): v for k, v in names.items()}
    heads = [first[c] for c in raw.columns]
    if unknown := sorted({h for h in heads if h not in known}, key=str):
        raise ValueError(f"unknown headers: {unknown}")
    if len(set(heads)) != len(heads) or set(known) - set(heads):
        raise ValueError(f"repeated or missing headers: {heads}")
    return read(True).toDF(*[known[h] for h in heads])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """t_ns, latitude_deg, longitude_deg, speed_m_s, heading_deg of a track, with the distance so far; times that do not increase are dropped."""
    rows = spark.read.schema("t_ns long, latitude_deg double, longitude_deg double, speed_m_s double, heading_deg double").csv(path, header=True, nullValue="").withColumn("_file", F.input_file_name())
    w = Window.partitionBy("_file").orderBy("t_ns")
    rows = rows.dropDuplicates(["_file", "t_ns"])
    step = F.coalesce(planar(F.lag("latitude_deg").over(w), F.lag("longitude_deg").over(w), F.col("latitude_deg"), F.col("longitude_deg")), F.lit(0.0))
    return rows.withColumn("_step", step).withColumn("distance_m", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified time and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def integrity(now: DataFrame, sealed: DataFrame) -> DataFrame:
    """What differs between two inventories: missing, extra and changed files."""
    a, b = now.select("path", F.col("sha256").alias("a")), sealed.select("path", F.col("sha256").alias("b"))
    finding = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").withColumn("finding", finding).filter("finding IS NOT NULL").select("path", "finding")


def read_roads(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """way, class, name and points of the ways of some classes whose nodes and geometry are of one length."""
    kind = "elements array<struct<type:string,id:long,nodes:array<long>,geometry:array<struct<lat:double,lon:double>>,tags:struct<highway:string,name:string>>>"
    ways = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    ok = (F.col("type") == "way") & F.col("tags.highway").isin(classes) & (F.size("nodes") == F.size("geometry")) & (F.size("nodes") >= 2)
    return ways.filter(ok).select(F.col("id").alias("way"), F.col("tags.highway").alias("class"), F.col("tags.name").alias("name"), "nodes", "geometry")


def road_edges(ways: DataFrame) -> DataFrame:
    """Edges between shared nodes: way, part, u, v, points.

    A way is cut at its ends and at every node that more than one place uses.
    """
    points = ways.select("way", F.posexplode(F.arrays_zip("nodes", "geometry")).alias("i", "p")).select("way", "i", F.col("p.nodes").alias("node"), F.col("p.geometry").alias("g"))
    shared = points.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node", F.lit(1).alias("shared"))
    w = Window.partitionBy("way").orderBy("i")
    marked = points.join(shared, "node", "left").withColumn("cut", F.when(F.col("shared").isNotNull() | F.lag("i").over(w).isNull() | F.lead("i").over(w).isNull(), 1).otherwise(0))
    part = F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    inside = marked.withColumn("part", part)
    # a cut node ends one part and begins the next
    ends = inside.filter("cut = 1 AND part > 0").withColumn("part", F.col("part") - 1)
    both = inside.unionByName(ends)
    edge = both.groupBy("way", "part").agg(F.sort_array(F.collect_list(F.struct("i", "node", "g"))).alias("p")).filter(F.size("p") > 1)
    return edge.select("way", "part", F.col("p")[0]["node"].alias("u"), F.element_at("p", -1)["node"].alias("v"), F.transform("p", lambda x: x["g"]).alias("points"))


def micro(points):  # noqa: ANN001, ANN201
    """Points as whole micro-degrees: the first one, then differences."""
    whole = F.transform(points, lambda p: F.struct(F.bround(p["lat"] * 1e6, 0).cast("int").alias("lat"), F.bround(p["lon"] * 1e6, 0).cast("int").alias("lon")))
    return F.aggregate(
        whole,
        F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<struct<lat:int,lon:int>>").alias("all")),
        lambda s, p: F.struct(p["lat"].alias("a"), p["lon"].alias("b"), F.concat(s["all"], F.array(F.struct((p["lat"] - s["a"]).alias("lat"), (p["lon"] - s["b"]).alias("lon")))).alias("all")),
        lambda s: s["all"],
    )


def degrees(deltas):  # noqa: ANN001, ANN201
    """The points of :func:`micro`."""
    return F.aggregate(
        deltas,
        F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<struct<lat:double,lon:double>>").alias("all")),
        lambda s, d: F.struct((s["a"] + d["lat"]).alias("a"), (s["b"] + d["lon"]).alias("b"), F.concat(s["all"], F.array(F.struct(((s["a"] + d["lat"]) / 1e6).alias("lat"), ((s["b"] + d["lon"]) / 1e6).alias("lon")))).alias("all")),
        lambda s: s["all"],
    )


def kml(track: DataFrame, session: str, t: str) -> DataFrame:
    """One LineString for each session: coordinates in the order of time."""
    p = F.transform(F.sort_array(F.collect_list(F.struct(t, "lat", "lon"))), lambda x: F.format_string("%.7f,%.7f,0", x["lon"], x["lat"]))
    body = F.concat(F.lit("<Placemark><name>"), F.col(session).cast("string"), F.lit("</name><LineString><coordinates>"), F.col("_p"), F.lit("</coordinates></LineString></Placemark>"))
    return track.groupBy(session).agg(F.array_join(p, " ").alias("_p")).select(session, body.alias("kml"))


def gpx(track: DataFrame, session: str, t: str) -> DataFrame:
    """One track point for each row, in the order of time within a session."""
    point = F.format_string('<trkpt lat="%.7f" lon="%.7f"><time>%s</time></trkpt>', "lat", "lon", F.date_format(F.timestamp_micros(t), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return track.repartition(session).sortWithinPartitions(session, t).select(session, t, point.alias("trkpt"))


def write_results(rows: DataFrame, path: str, digits: int = 6) -> None:
    """A CSV with rounded numbers and flags as 0 and 1."""
    cols = [F.bround(c, digits).alias(c) if k in ("double", "float") else F.col(c).cast("int").alias(c) if k == "boolean" else F.col(c) for c, k in rows.dtypes]
    rows.select(*cols).write.csv(path, header=True)
