"""Writers beyond Spark's own formats: long signal tables, meshes, versions swapped in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_long_csv(signals: DataFrame, path: str) -> None:
    """sensor, t_abs and t_rel with nine and value with six decimals; t_rel counts from the earliest stamp of
    all sensors. ``signals``: sensor, t (seconds), value."""
    first = signals.agg(F.min("t")).scalar()
    fixed = lambda c, n: F.format_string(f"%.{n}f", c)
    out = signals.select("sensor", fixed(F.col("t"), 9).alias("t_abs"), fixed(F.col("t") - first, 9).alias("t_rel"), fixed(F.col("value"), 6).alias("value"))
    out.write.mode("overwrite").option("header", "true").csv(path)


def numbered_mesh(vertices: DataFrame, triangles: DataFrame, mesh: str, id: str) -> tuple[DataFrame, DataFrame]:
    """Meshes with their own vertex numbers (``id``, from 0) become one: numbers are shifted by the sizes of
    the meshes before. Only one row per mesh is ordered."""
    from pyspark.sql import Window

    sizes = vertices.groupBy(mesh).agg(F.count("*").alias("_n"))
    w = Window.orderBy(mesh).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as meshes
    shift = sizes.select(mesh, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    v = vertices.join(shift, mesh).withColumn(id, F.col(id) + F.col("_s")).drop("_s")
    t = triangles.join(shift, mesh).withColumns({c: F.col(c) + F.col("_s") for c in "abc"}).drop("_s")
    return v, t


def ply_lines(vertices: DataFrame, triangles: DataFrame, mesh: str, digits: int = 6) -> DataFrame:
    """mesh, part (0 header, 1 vertices, 2 faces), k, line of ASCII polygon files. ``vertices``: mesh, id (from 0), x, y, z and, if
    coloured, r, g, b (0 … 255); ``triangles``: mesh, k, a, b, c. A mesh without triangles has none in its header."""
    coloured = {"r", "g", "b"} <= set(vertices.columns)
    fixed = " ".join([f"%.{digits}f"] * 3)
    colours = [F.col(c).cast("int") for c in "rgb"] if coloured else []
    v = vertices.select(mesh, F.lit(1).alias("part"), F.col("id").cast("bigint").alias("k"), F.format_string(fixed + " %d %d %d" * coloured, "x", "y", "z", *colours).alias("line"))
    t = triangles.select(mesh, F.lit(2).alias("part"), F.col("k").cast("bigint").alias("k"), F.format_string("3 %d %d %d", "a", "b", "c").alias("line"))
    sizes = vertices.groupBy(mesh).agg(F.count("*").alias("nv")).join(triangles.groupBy(mesh).agg(F.count("*").alias("nt")), mesh, "left")
    head = ["ply", "format ascii 1.0", F.format_string("element vertex %d", "nv"), *[f"property double {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue") if coloured]]
    head += [F.format_string("element face %d", F.coalesce("nt", F.lit(0))), "property list uchar int vertex_indices", "end_header"]
    h = sizes.select(mesh, F.lit(0).alias("part"), F.posexplode(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in head])).alias("k", "line"))
    return h.withColumn("k", F.col("k").cast("bigint")).unionByName(v).unionByName(t)


def write_ply(lines: DataFrame, mesh: str, path: str) -> None:
    """One folder per mesh under ``path`` with the lines of ``ply_lines`` in order, one file each."""
    ordered = lines.repartition(mesh).sortWithinPartitions(mesh, "part", "k").select(mesh, "line")
    ordered.write.mode("overwrite").partitionBy(mesh).text(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes ``df`` in place of the table at ``path``, which it may be read from: a new folder first, then the names are
    swapped on the file system and the old rows removed."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
