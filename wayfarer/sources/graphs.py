"""Road graphs as text: the edge and coordinate lines of shortest-path challenges, GraphML out, CSV of networks out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.network import Network


def _fields(spark: SparkSession, path: str, kind: str, n: int) -> DataFrame:
    """Fields of the lines that begin with ``kind`` and have ``n`` whole numbers; other lines are passed over."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    good = (F.get("f", F.lit(0)) == kind) & (F.size("f") == n + 1)
    numbers = [F.expr(f"try_cast(f[{k}] as bigint)").alias(f"v{k}") for k in range(1, n + 1)]
    return lines.where(good).select(*numbers).dropna()


def read_dimacs(spark: SparkSession, base: str, factor: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of ``base``.gr and ``base``.co; numbers count from 1 there and from 0 here."""
    edges = _fields(spark, f"{base}.gr", "a", 3).select((F.col("v1") - 1).alias("src"), (F.col("v2") - 1).alias("dst"), F.col("v3").alias("travel_time"))
    vertices = _fields(spark, f"{base}.co", "v", 3).select((F.col("v1") - 1).alias("id"), (F.col("v3") * factor).alias("lat"), (F.col("v2") * factor).alias("lon"))
    return edges, vertices


def write_dimacs(edges: DataFrame, vertices: DataFrame, base: str, factor: float = 1e-6) -> None:
    """Folders ``base``.gr and ``base``.co of such lines, the problem line among them."""
    size = vertices.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))  # of one row each
    head = size.select(F.concat_ws(" ", F.lit("p sp"), "n", "m").alias("value"))
    head.unionByName(edges.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, "travel_time").alias("value"))).write.text(f"{base}.gr")
    head = size.select(F.concat_ws(" ", F.lit("p aux sp co"), "n").alias("value"))
    x, y = (F.round(F.col(c) / factor).cast("long") for c in ("lon", "lat"))
    head.unionByName(vertices.select(F.concat_ws(" ", F.lit("v"), F.col("id") + 1, x, y).alias("value"))).write.text(f"{base}.co")


def graphml_lines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The nodes and edges of a GraphML document, a line each (value)."""
    node = F.format_string('<node id="%d"><data key="lat">%s</data><data key="lon">%s</data></node>', "id", F.col("lat").cast("string"), F.col("lon").cast("string"))
    edge = F.format_string('<edge source="%d" target="%d"><data key="travel_time">%d</data></edge>', "src", "dst", "travel_time")
    return vertices.select(node.alias("value")).unionByName(edges.select(edge.alias("value")))


def write_graphml(edges: DataFrame, vertices: DataFrame, folder: str) -> None:
    """A GraphML document as a folder of text parts; in order of their names they are the document."""
    spark = edges.sparkSession
    keys = "".join(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{t}"/>' for k, of, t in (("lat", "node", "double"), ("lon", "node", "double"), ("travel_time", "edge", "long")))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', keys, '<graph edgedefault="directed">']
    ends = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "kind int, n long, value string")
    nodes = graphml_lines(edges.limit(0), vertices).select(F.lit(1).alias("kind"), F.xxhash64("value").alias("n"), "value")
    arcs = graphml_lines(edges, vertices.limit(0)).select(F.lit(2).alias("kind"), F.xxhash64("value").alias("n"), "value")
    lines = ends.unionByName(nodes).unionByName(arcs)
    lines.repartitionByRange("kind", "n").sortWithinPartitions("kind", "n").select("value").write.text(folder)


def write_csv(net: Network, folder: str, lines: DataFrame | None = None) -> None:
    """stops, trips (their halts), footpaths and, if given, lines (trip, line) as CSV with a header."""
    tables = [("stops", net.stops), ("trips", net.events), ("footpaths", net.edges)]
    for name, table in tables + ([("lines", lines)] if lines is not None else []):
        table.write.option("header", True).csv(f"{folder}/{name}.csv")


def write_network(net: Network, folder: str) -> None:
    for name in ("stops", "events", "edges"):
        getattr(net, name).write.parquet(f"{folder}/{name}")


def read_network(spark: SparkSession, folder: str) -> Network:
    return Network(*(spark.read.parquet(f"{folder}/{name}") for name in ("stops", "events", "edges")))
