"""Imports and exports of image times, correspondences, trajectories, reports, point clouds and projects."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, rotations
from ..functions.notation import KINDS, id_of, is_valid, number, parse_pair, side_text


def image_times(lines: DataFrame, images: DataFrame, line: str = "value") -> DataFrame:
    """(id, t) of lines with a name and a time in either order; the first word is tried as the name first.

    Words end at blanks, commas or semicolons; what follows # or // is a comment; other than two words is no row.
    """
    words = F.filter(F.split(F.regexp_replace(line, r"(#|//).*$", ""), r"[\s,;]+"), lambda x: x != "")
    two = lines.select(words.alias("w")).where(F.size("w") == 2)
    names = images.select("id", "name")
    first = two.join(names.select(F.col("id").alias("id0"), F.col("name").alias("name0")), F.col("w")[0] == F.col("name0"), "left")
    both = first.join(names.select(F.col("id").alias("id1"), F.col("name").alias("name1")), F.col("w")[1] == F.col("name1"), "left")
    t = F.when(F.col("id0").isNotNull(), number(F.col("w")[1])).otherwise(number(F.col("w")[0]))
    return both.select(F.coalesce("id0", "id1").alias("id"), t.alias("t")).where("id is not null and t is not null")


def resolve_names(lines: DataFrame, names: DataFrame, line: str = "value") -> DataFrame:
    """Lines of correspondences with each side's name replaced by its id from names (id, name); unknown words stay as they are."""
    sides = lines.withColumn("_parts", F.split(line, ",", -1)).where(F.size("_parts") == 2)
    word = lambda i: F.get(F.split(F.trim(F.col("_parts")[i]), r"\s+"), F.lit(1))
    for i in range(2):
        known = names.select(F.col("id").alias(f"_id{i}"), F.col("name").alias(f"_name{i}"))
        sides = sides.withColumn(f"_word{i}", word(i)).join(known, F.col(f"_word{i}") == F.col(f"_name{i}"), "left")

    def text(i: int) -> Column:
        w = F.split(F.trim(F.col("_parts")[i]), r"\s+")
        named = F.concat_ws(" ", F.get(w, F.lit(0)), F.col(f"_id{i}").cast("string"), F.array_join(F.slice(w, 3, 100), " "))
        return F.when(F.col(f"_id{i}").isNotNull(), named).otherwise(F.col("_parts")[i])

    return sides.select(*[c for c in lines.columns if c != line], F.concat_ws(",", text(0), text(1)).alias(line))


def import_correspondences(lines: DataFrame, names: DataFrame, line: str = "value") -> DataFrame:
    """Valid pairs of the lines; comments and invalid lines are left out."""
    kept = lines.where(~F.ltrim(line).startswith("#"))
    parsed = resolve_names(kept, names, line).withColumn("pair", parse_pair(F.col(line)))
    return parsed.where(is_valid(F.col("pair"))).drop(line)


def import_counts(lines: DataFrame, names: DataFrame, line: str = "value") -> DataFrame:
    """lines that are no comment, and how many of them are imported."""
    total = lines.agg(F.count_if(~F.ltrim(line).startswith("#")).alias("n_lines"))
    return total.crossJoin(import_correspondences(lines, names, line).agg(F.count(F.lit(1)).alias("n_imported")))


def correspondence_lines(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """One line for each pair, ids given by name where there is one; null where there is no pair.

    names: (id, name), and kind where ids of each kind of block count by themselves: such a name is for sides of its kind only.
    """
    out = pairs
    for i in range(2):
        known = names.select(F.col("id").alias(f"_id{i}"), F.col("name").alias(f"_name{i}"), *([F.col("kind").alias(f"_kind{i}")] if "kind" in names.columns else []))
        on = F.col(f"_of{i}") == F.col(f"_id{i}")
        if "kind" in names.columns:
            on = on & (F.col("pair")[i]["kind"] == F.col(f"_kind{i}"))
        out = out.withColumn(f"_of{i}", id_of(F.col("pair")[i])).join(known, on, "left")
    line = F.concat_ws(", ", side_text(F.col("pair")[0], F.col("_name0")), side_text(F.col("pair")[1], F.col("_name1")))
    return out.select(*[c for c in pairs.columns if c != "pair"], F.when(F.col("pair").isNotNull(), line).alias("value"))


def trajectory_lines(poses: DataFrame) -> DataFrame:
    """`time,x,y,z,rx,ry,rz` lines of poses (t, pose): six decimals, three for positions."""
    p = F.col("pose")
    parts = [F.format_string("%.6f", F.col("t"))] + [F.format_string("%.3f", p["t"][i]) for i in range(3)] + [F.format_string("%.6f", p["r"][i]) for i in range(3)]
    return poses.select(*[c for c in poses.columns if c not in ("t", "pose")], F.col("t"), F.concat_ws(",", *parts).alias("value"))


def geographic_lines(poses: DataFrame, order: str | None = "zyx") -> DataFrame:
    """`time,lat,lon,height,` and roll, pitch, heading in the local north-east-down frame, or its rotation vector where order is None."""
    p = F.col("pose")
    rows = poses.withColumn("_g", geodesy.geographic(p["t"])).withColumn("_m", _local(p["r"]))
    angles = rotations.euler_degrees(F.col("_m"), order) if order else rotations.rotation_vector(F.col("_m"))
    rows = rows.withColumn("_a", angles)
    parts = [F.format_string("%.6f", F.col("t")), F.format_string("%.14f", F.col("_g")[0]), F.format_string("%.14f", F.col("_g")[1]), F.format_string("%.6f", F.col("_g")[2])]
    parts += [F.format_string("%.6f", F.col("_a")[i]) for i in range(3)]
    return rows.select(*[c for c in poses.columns if c not in ("t", "pose")], F.col("t"), F.concat_ws(",", *parts).alias("value"))


def _local(r: Column) -> Column:
    from ..functions.vectors import times_matrix, transposed

    return times_matrix(transposed(geodesy.local_axes(F.col("_g")[0], F.col("_g")[1])), rotations.rotation_matrix(r))


def landmark_lines(landmarks: DataFrame) -> DataFrame:
    """`name,x,y,z` with two decimals; a blank for what has no optimised value."""
    shown = lambda c: F.when(F.col(c).isNull(), " ").otherwise(F.format_string("%.2f", F.col(c)))
    return landmarks.select("id", F.concat_ws(",", "name", *[shown(c) for c in ("x", "y", "z")]).alias("value"))


def observation_table(observations: DataFrame, landmarks: DataFrame, images: DataFrame, image: int | None = None) -> DataFrame:
    """Image, Landmark, u, v of all observations with both, or of one image."""
    rows = observations.where(F.col("image_id") == image) if image is not None else observations
    rows = rows.join(landmarks.select(F.col("id").alias("landmark_id"), F.col("name").alias("Landmark")), "landmark_id")
    return rows.join(images.select(F.col("id").alias("image_id"), F.col("name").alias("Image")), "image_id").select("Image", "Landmark", "u", "v")


def match_lines(matches: DataFrame) -> DataFrame:
    """Two lines for each match: `1 x y id inlier` and `2 x y id inlier`."""
    line = lambda k: F.concat_ws(" ", F.lit(str(k)), F.col(f"x{k}").cast("string"), F.col(f"y{k}").cast("string"), F.col("match_id").cast("string"), F.col("inlier").cast("int").cast("string"))
    return matches.select("match_id", F.lit(1).alias("side"), line(1).alias("value")).unionByName(matches.select("match_id", F.lit(2).alias("side"), line(2).alias("value")))


def pcd_lines(points: DataFrame) -> DataFrame:
    """`x y z rgb` lines of points (x, y, z, r, g, b as 0 to 255); a colour that is NaN or missing makes the position NaN."""
    bad = F.greatest(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in "rgb"])
    rgb = F.when(bad, 0).otherwise(F.shiftleft(F.col("r").cast("long"), 16) + F.shiftleft(F.col("g").cast("long"), 8) + F.col("b").cast("long"))
    xyz = [F.when(bad, "nan").otherwise(F.format_string("%.6f", F.col(c).cast("double"))) for c in "xyz"]
    return points.select(*[c for c in points.columns if c not in "xyzrgb"], F.concat_ws(" ", *xyz, rgb.cast("string")).alias("value"))


def pcd_header(n: int) -> str:
    return f"# .PCD v.7\nVERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA ascii"


def write_pcd(points: DataFrame, path: str) -> None:
    """A folder whose first part is the header; parts in order of name make the file."""
    spark = points.sparkSession
    spark.createDataFrame([(pcd_header(points.count()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    pcd_lines(points).select("value").write.mode("overwrite").text(f"{path}/1-points")


def rig_json(rigs: DataFrame) -> DataFrame:
    """f1, pp1, f2, pp2, R and t of stereo rigs (id, f1, pp1, f2, pp2, r, t)."""
    made = F.to_json(F.struct("f1", "pp1", "f2", "pp2", rotations.rotation_matrix(F.col("r")).alias("R"), "t"))
    return rigs.select("id", made.alias("value"))


def read_project(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(class, position, json) of the objects of known classes in a project file; metadata and unknown classes are left out."""
    text = spark.read.text(path, wholetext=True)
    members = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("class", "_raw")).where(F.col("class").isin(classes))
    return members.select("class", F.posexplode(F.from_json("_raw", "array<string>")).alias("position", "json"))


def project_json(objects: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """One row: the project of (class, position, json), a project being a file that one editor opens."""
    lists = objects.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("position", "json"))).alias("l"))
    member = F.concat(F.to_json(F.array("class")).substr(F.lit(2), F.length(F.to_json(F.array("class"))) - 2), F.lit(":["), F.array_join(F.transform("l", lambda x: x["json"]), ","), F.lit("]"))
    extra = [f'"{k}":{v}' for k, v in sorted((metadata or {}).items())]
    body = lists.select("class", member.alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "m"))), lambda x: x["m"]).alias("m"))
    return body.select(F.concat(F.lit("{"), F.array_join(F.concat("m", F.array(*[F.lit(x) for x in extra]).cast("array<string>")), ","), F.lit("}")).alias("value"))


def project_path(name: str, extension: str = ".json") -> str:
    return name if name.endswith(extension) else name + extension


def relative_path(path: str, base: str) -> str:
    """path relative to base if it is inside, else as it is."""
    p, b = PurePosixPath(path), PurePosixPath(base)
    return str(p.relative_to(b)) if p.is_relative_to(b) else path


def absolute_path(path: str, base: str) -> str:
    return path if re.match(r"(/|\w+:)", path) else str(PurePosixPath(base) / path)


def kinds() -> list[str]:
    return list(KINDS)
