"""Residuals of correspondences by pair of kinds, and the pose decorators and lever arms that they are put together from.

A pair of sides becomes one residual vector in its own row: which formula holds is a CASE on the two kinds, so one pass over the joined table
gives the residuals of all kinds and an aggregate counts them. What a side refers to (a rigid body, an image, a landmark) has been joined to the row before;
timed sides come with the pose interpolated at their time (trajectories.pose_at). Each formula is one function of columns.

Poses are STRUCT<r, t> from body to world, vectors arrays of doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotations as R
from ..functions.camera import reprojection
from ..functions.vectors import add, cross, dot, norm, scale, subtract, times_vector, transposed


def pose(r: Column, t: Column) -> Column:
    return F.struct(r.alias("r"), t.alias("t"))


# ---- pose decorators: each takes and gives a pose ------------------------------------------------


def with_offset(p: Column, offset: Column) -> Column:
    """The pose with an offset added to its position."""
    return pose(p["r"], add(p["t"], offset))


def with_lever_arm(p: Column, arm: Column) -> Column:
    """The pose of a point fixed at `arm` in the body, with the body's axes."""
    return pose(p["r"], add(R.rotate(p["r"], arm), p["t"]))


def with_boresight(p: Column, boresight: Column) -> Column:
    """The pose whose axes are turned by a rotation vector in the body."""
    return R.compose(p["r"], p["t"], boresight, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def composed(p: Column, q: Column) -> Column:
    """q within p."""
    return R.compose(p["r"], p["t"], q["r"], q["t"])


def inverted(p: Column) -> Column:
    return R.inverse(p["r"], p["t"])


def interpolated(p: Column, q: Column, w: Column) -> Column:
    """Between p (w = 0) and q (w = 1)."""
    return R.interpolate(p["r"], p["t"], q["r"], q["t"], w)


def to_world(p: Column, x: Column) -> Column:
    return add(R.rotate(p["r"], x), p["t"])


def to_body(p: Column, x: Column) -> Column:
    return times_vector(transposed(R.rotation_matrix(p["r"])), subtract(x, p["t"]))


# ---- lever arms ------------------------------------------------------------------------------------


def lever_arm_position(p: Column, arm: Column, measured: Column) -> Column:
    """Where the arm's end is, less where it was measured."""
    return subtract(to_world(p, arm), measured)


def lever_arm_pose(p: Column, q: Column, boresight: Column, arm: Column) -> Column:
    """Six numbers: q less p with its boresight and arm, rotation (as a vector in the body) first."""
    back = R.times_quaternion(R.quaternion_of_vector(scale(boresight, -1.0)), R.quaternion_of_vector(scale(p["r"], -1.0)))
    turn = R.vector_of_quaternion(R.times_quaternion(back, R.quaternion_of_vector(q["r"])))
    return F.concat(turn, R.rotate(scale(boresight, -1.0), subtract(to_body(p, q["t"]), arm)))


def lever_arm_velocity(velocity: Column, p: Column, rate: Column, arm: Column, measured: Column) -> Column:
    """Velocity of the arm's end, the body turning at `rate` in its own axes, less the measured one."""
    return subtract(add(velocity, R.rotate(p["r"], cross(rate, arm))), measured)


def lever_arm_distance(p: Column, arm: Column, point: Column, measured: Column) -> Column:
    return F.array(norm(subtract(to_world(p, arm), point)) - measured)


# ---- points ----------------------------------------------------------------------------------------


def point_alignment(p: Column, x: Column, q: Column, y: Column) -> Column:
    """A point of two bodies, in the world."""
    return subtract(to_world(p, x), to_world(q, y))


def point_to_world(p: Column, x: Column, world: Column) -> Column:
    return subtract(to_world(p, x), world)


def point_projected(p: Column, x: Column, projector: Column, target: Column) -> Column:
    """P x - d with the two rows of P (6 numbers), as of a vertical through a map position."""
    at = to_world(p, x)
    return F.array(*[dot(F.slice(projector, 3 * k + 1, 3), at) - target[k] for k in range(2)])


def image_point(p: Column, f: Column, pp: Column, uv: Column, world: Column) -> Column:
    """Reprojection of a point of the world less its observation; the pose takes camera to world. Not a number behind the camera."""
    return F.zip_with(reprojection(to_body(p, world), f, pp), uv, lambda a, b: a - b)


def ray(p: Column, f: Column, pp: Column, uv: Column) -> Column:
    """Unit direction in the world of what an image point sees."""
    d = R.rotate(p["r"], F.array((uv[0] - pp[0]) / f, (uv[1] - pp[1]) / f, F.lit(1.0)))
    return scale(d, 1 / norm(d))


def coplanarity(p: Column, a: Column, q: Column, b: Column) -> Column:
    """Volume that two rays (unit, in the world) span with the line between their cameras: 0 where they can meet."""
    base = subtract(q["t"], p["t"])
    return F.array(dot(base, cross(a, b)) / F.greatest(norm(base), F.lit(1e-12)))


# ---- gravity ---------------------------------------------------------------------------------------


def velocity_change(dv: Column, p: Column, v0: Column, v1: Column, gravity: Column, dt: Column, earth: Column | None = None) -> Column:
    """What two velocities differ by, less the pre-integrated change dv (in the body's axes at the first time) and gravity, and with `earth`, the
    Earth's rate in the world's axes, less the Coriolis acceleration too."""
    rest = subtract(subtract(subtract(v1, v0), R.rotate(p["r"], dv)), scale(gravity, dt))
    return rest if earth is None else add(rest, scale(cross(earth, v0), 2.0 * dt))


def position_change(dx: Column, p: Column, x0: Column, v0: Column, x1: Column, gravity: Column, dt: Column) -> Column:
    return subtract(subtract(subtract(subtract(x1, x0), scale(v0, dt)), R.rotate(p["r"], dx)), scale(gravity, dt * dt / 2))


# ---- by pair of kinds --------------------------------------------------------------------------------


def _sides_in_world(pairs: DataFrame) -> DataFrame:
    """pairs with what the formulas share, a column at a time: each side's rotation matrix (s_m), point (s_at) and ray (s_ray) in the world."""
    for s in "ab":
        t = F.col(f"{s}_pose.t")
        seen = F.array(*[(F.get(f"{s}.vals", F.lit(i)) - F.col(f"{s}_pp")[i]) / F.col(f"{s}_f") for i in (0, 1)], F.lit(1.0))
        pairs = pairs.withColumn(f"{s}_m", R.rotation_matrix(F.col(f"{s}_pose.r"))).withColumn(f"{s}_t", t)
        pairs = pairs.withColumn(f"{s}_at", F.when(F.size(f"{s}.vals") > 2, add(times_vector(F.col(f"{s}_m"), F.slice(f"{s}.vals", 1, 3)), F.col(f"{s}_t"))))
        pairs = pairs.withColumn(f"{s}_ray", times_vector(F.col(f"{s}_m"), seen))
        pairs = pairs.withColumn(f"{s}_ray", scale(F.col(f"{s}_ray"), 1 / norm(F.col(f"{s}_ray"))))
    return pairs


_SHARED = [f"{s}_{x}" for s in "ab" for x in ("m", "t", "at", "ray")]


def _formulas() -> dict[tuple[str, str], Column]:
    """Residual of each pair of kinds, the first kind on side a, from columns of _sides_in_world. A position that is known in the world is b_world."""
    at, other, world, ta, tb = (F.col(x) for x in ("a_at", "b_at", "b_world", "a_t", "b_t"))

    def seen(x: Column) -> Column:
        inside = times_vector(transposed(F.col("a_m")), subtract(x, ta))
        return F.zip_with(reprojection(inside, F.col("a_f"), F.col("a_pp")), F.slice("a.vals", 1, 2), lambda p, q: p - q)

    def on_map(x: Column) -> Column:
        return F.array(*[dot(F.slice("b_projector", 3 * k + 1, 3), x) - F.col("b_target")[k] for k in range(2)])

    rays = coplanarity(F.struct(ta.alias("t")), F.col("a_ray"), F.struct(tb.alias("t")), F.col("b_ray"))
    return {
        ("PRIOR", "XYZ"): subtract(tb, F.slice("b.vals", 1, 3)),
        ("PRIORID", "GEOXYZ"): subtract(ta, world),
        ("PRIORID", "GEOXY"): on_map(ta),
        ("XYZ", "XYZ"): subtract(at, other),
        ("XYZ", "GEOXYZ"): subtract(at, world),
        ("XYZ", "GEOXY"): on_map(at),
        ("XYZ", "PRIORID"): subtract(at, tb),
        ("XYZT", "XYZ"): subtract(at, other),
        ("XYZT", "XYZT"): subtract(at, other),
        ("UV", "UV"): rays,
        ("UV", "XYZ"): seen(other),
        ("UV", "GEOXYZ"): seen(world),
        ("UV", "XYZT"): seen(other),
        ("UVT", "UV"): rays,
        ("UVT", "UVT"): rays,
        ("UVT", "XYZ"): seen(other),
        ("UVT", "GEOXYZ"): seen(world),
        ("UVT", "XYZT"): seen(other),
    }


#: Pairs that are told from unknown ones but have no residual.
UNSUPPORTED = [("XYZ", "LINE3D"), ("XYZ", "PLANE3D")]


def oriented(pairs: DataFrame) -> DataFrame:
    """pairs with their sides (every column a..., b...) swapped where only that order of kinds has a formula."""
    known = [F.lit(f"{x} {y}") for x, y in [*_formulas(), *UNSUPPORTED]]
    there, back = F.concat_ws(" ", "a.kind", "b.kind"), F.concat_ws(" ", "b.kind", "a.kind")
    swap = ~there.isin(*known) & back.isin(*known)
    names = {c: "b" + c[1:] if c == "a" or c.startswith("a_") else "a" + c[1:] for c in pairs.columns if c in ("a", "b") or c.startswith(("a_", "b_"))}
    return pairs.select(*[F.when(swap, F.col(names[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in pairs.columns])


_IMAGE, _MAP = ("UV", "UVT"), "GEOXY"


def _spread(sigma0: Column) -> Column:
    """What each number of `residual` is divided by, or null where it stays as it is.

    Two positions: the sigmas of both sides added, or of the one that has them, whole; on a map those of a position count by the projector's share of each axis. An image
    point with a position: its own sigmas, each by itself. Two image points: sigma0 alone. All are multiplied by sigma0.
    """

    def whole(side: str, n: int) -> Column:
        s = F.col(f"{side}.sigmas")
        return F.when((F.size(s) == n) & ~F.exists(s, lambda x: x.isNull()), s)

    def added(one: Column, two: Column) -> Column:
        return F.coalesce(F.zip_with(one, two, lambda x, y: x + y), one, two)

    a_image, b_image = F.col("a.kind").isin(*_IMAGE), F.col("b.kind").isin(*_IMAGE)
    on_map = F.array(*[sum((F.abs(F.col("b_projector")[3 * k + i]) * whole("a", 3)[i] for i in (1, 2)), F.abs(F.col("b_projector")[3 * k]) * whole("a", 3)[0]) for k in range(2)])
    on_map = F.when(whole("a", 3).isNotNull(), on_map)
    own = F.array(*[F.coalesce(F.get("a.sigmas", F.lit(k)), F.lit(None).cast("double")) for k in range(2)])
    sigmas = F.when(a_image & b_image, F.array(F.lit(1.0))).when(a_image, own).when(F.col("b.kind") == _MAP, added(on_map, whole("b", 2))).otherwise(added(whole("a", 3), whole("b", 3)))
    return F.transform(sigmas, lambda x: x * sigma0)


def correspondence_residuals(pairs: DataFrame, sigma0: float | Column = 1.0) -> DataFrame:
    """pairs with `residual`, weighed by the sides' sigmas and their set's sigma0, and `state`: used, unsupported, same (an image with itself) or unknown.

    Columns for each side s of a and b: s (kind, vals, sigmas, ...), s_pose, s_f and s_pp (of an image), s_world (position in the world of a
    geographic or prior side), s_projector and s_target (of a map position); null where a side has none. Kinds may come in either order. With columns a_block and
    b_block two points of one image are told apart from others. A residual without sigmas stays as it is.
    """
    p = _sides_in_world(oriented(pairs))
    is_ = lambda x, y: (F.col("a.kind") == x) & (F.col("b.kind") == y)
    cases = reduce(lambda c, f: c.when(is_(*f[0]), f[1]), list(_formulas().items())[1:], F.when(is_("PRIOR", "XYZ"), _formulas()["PRIOR", "XYZ"]))
    s0 = sigma0 if isinstance(sigma0, Column) else F.lit(float(sigma0))
    p = p.withColumn("residual", cases).withColumn("_spread", _spread(s0))
    weighed = F.when(F.col("_spread").isNotNull() & (F.size("_spread") == F.size("residual")), F.zip_with("residual", "_spread", lambda x, s: x / F.coalesce(s, F.lit(1.0)))).otherwise(F.col("residual"))
    known = reduce(lambda c, k: c | is_(*k), list(_formulas())[1:], is_("PRIOR", "XYZ"))
    bad = reduce(lambda c, k: c | is_(*k), UNSUPPORTED[1:], is_(*UNSUPPORTED[0]))
    same = F.col("a.kind").isin(*_IMAGE) & F.col("b.kind").isin(*_IMAGE) & (F.col("a_block") == F.col("b_block")) if {"a_block", "b_block"} <= set(pairs.columns) else F.lit(False)
    same = F.coalesce(same, F.lit(False))
    state = F.when(same, "same").when(known, "used").when(bad, "unsupported").otherwise("unknown")
    return p.withColumn("residual", F.when(~same, weighed)).withColumn("state", state).drop("_spread", *_SHARED)


def residual_counts(residuals: DataFrame) -> DataFrame:
    """Per pair of kinds and state: how many, their root mean square and how many aren't numbers (behind a camera)."""
    square = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x)
    ok = F.when(~F.isnan(square), square)
    return residuals.groupBy(F.col("a.kind").alias("kind_a"), F.col("b.kind").alias("kind_b"), "state").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(ok)).alias("rms"), F.count_if(F.isnan(square)).alias("n_behind"))
