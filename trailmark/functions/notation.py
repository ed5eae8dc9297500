"""Correspondences as text: `KIND id-or-crs numbers [sigmas]`, and pairs of them joined by one comma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: Numbers, sigmas (all or none) and what the second word is, by kind.
KINDS = {
    "UV": (2, 2, "id"),
    "UVT": (3, 2, "id"),
    "XY": (2, 2, "id"),
    "GEOXY": (2, 2, "crs"),
    "XYZ": (3, 3, "id"),
    "GEOXYZ": (3, 3, "crs"),
    "T": (1, 1, "id"),
    "XYT": (3, 3, "id"),
    "XYZT": (4, 4, "id"),
    "LINE2D": (4, 4, "id"),
    "LINE3D": (6, 6, "id"),
    "PLANE3D": (4, 4, "id"),
    "PRIORID": (0, 0, "id"),
    "PRIOR": (0, 0, None),
}
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SIDE_DDL = "struct<kind:string,id:bigint,crs:string,vals:array<double>,sigmas:array<double>>"


def number(text: Column) -> Column:
    """The number that the whole text is, else null; unlike a cast, no blanks, names or suffixes."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_side(text: Column) -> Column:
    """STRUCT<kind, id, crs, vals, sigmas>; kind is INVALID where the text isn't one. Kinds are read in any case.

    What a kind asks for is looked up in one map, so the text is split and its numbers are read once, whatever the kind.
    """
    rules = F.create_map(*[x for k, (n, m, what) in KINDS.items() for x in (F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), F.lit(what).cast("string").alias("what")))])
    none = lambda kind: F.lit(None).cast(kind)
    invalid = F.struct(F.lit("INVALID").alias("kind"), none("bigint").alias("id"), none("string").alias("crs"), none("array<double>").alias("vals"), none("array<double>").alias("sigmas"))

    def of(x: Column) -> Column:
        words, rule, given = x["words"], x["rule"], x["given"]
        n, m, what, size = rule["n"], rule["m"], rule["what"], F.size(given)
        second = F.get(words, F.lit(1))
        is_id = F.coalesce(what == "id", F.lit(False))
        fits = rule.isNotNull() & ((size == n) | (size == n + m)) & ~F.exists(given, lambda v: v.isNull()) & (what.isNull() | second.isNotNull()) & (~is_id | second.rlike(r"^-?[0-9]+$"))
        sigmas = F.when((size == n + m) & (m > 0), F.slice(given, n + 1, m))
        made = F.struct(F.upper(words[0]).alias("kind"), F.when(is_id, second.try_cast("bigint")).alias("id"), F.when(what == "crs", second).alias("crs"), F.slice(given, F.lit(1), n).alias("vals"), sigmas.alias("sigmas"))
        return F.when(fits, made).otherwise(invalid)

    def read(words: Column) -> Column:
        rule = F.try_element_at(rules, F.upper(words[0]))
        skip = F.when(rule["what"].isNull(), 2).otherwise(3)
        # Two more than any kind has tell that there are too many.
        given = F.transform(F.slice(words, skip, F.lit(14)), number)
        return let(F.struct(words.alias("words"), rule.alias("rule"), given.alias("given")), of)

    return let(F.split(F.trim(text), r"\s+"), read)


def parse_pair(text: Column) -> Column:
    """ARRAY of both sides; null unless there is exactly one comma."""
    parts = F.split(text, ",", -1)
    return F.when(F.size(parts) == 2, F.array(parse_side(F.get(parts, F.lit(0))), parse_side(F.get(parts, F.lit(1)))))


def is_valid(pair: Column) -> Column:
    return pair.isNotNull() & (pair[0]["kind"] != "INVALID") & (pair[1]["kind"] != "INVALID")


def has_id(side: Column) -> Column:
    return side["kind"].isin([k for k, (_, _, what) in KINDS.items() if what == "id"])


def id_of(side: Column) -> Column:
    """The block's id, -1 for kinds without one."""
    return F.coalesce(side["id"], F.lit(-1)).cast("bigint")


def side_text(side: Column, name: Column | None = None) -> Column:
    """Text of a side, by name where one is given: two decimals for UV and UVT, else the shortest; sigmas only if all are there."""
    two = side["kind"].isin("UV", "UVT")
    shown = lambda xs: F.transform(xs, lambda x: F.when(two, F.format_string("%.2f", x)).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", "")))
    sigmas = F.when(side["sigmas"].isNotNull() & ~F.exists(side["sigmas"], lambda x: x.isNull()), shown(side["sigmas"])).otherwise(F.array().cast("array<string>"))
    second = F.coalesce(name if name is not None else F.lit(None).cast("string"), side["id"].cast("string"), side["crs"])
    return F.concat_ws(" ", F.array_compact(F.concat(F.array(side["kind"], second), shown(side["vals"]), sigmas)))


def pair_text(pair: Column) -> Column:
    return F.concat_ws(", ", side_text(pair[0]), side_text(pair[1]))


def normalized(pair: Column) -> Column:
    """The pair with its kinds in alphabetical order, so that a match doesn't depend on which side is which."""
    return F.when(pair[0]["kind"] > pair[1]["kind"], F.array(pair[1], pair[0])).otherwise(pair)


def matches(pair: Column, kind1: str, kind2: str) -> Column:
    k = F.array_sort(F.array(pair[0]["kind"], pair[1]["kind"]))
    return k == F.array(*[F.lit(x) for x in sorted((kind1, kind2))])


def block_path(ids: Column) -> Column:
    """`3/14/15` of an array of ids."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), "/")


def path_ids(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: x.try_cast("bigint"))
