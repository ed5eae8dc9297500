"""Vectors and 3x3 matrices as ARRAY<DOUBLE> columns, matrices row by row."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """f over array columns, each computed once however often f names it; else nested calls would repeat whole expressions."""

    @functools.wraps(f)
    def bound(*columns: Column) -> Column:
        def bind(left: tuple, done: tuple) -> Column:
            return let(left[0], lambda x: bind(left[1:], (*done, x))) if left else f(*done)

        return bind(columns, ())

    return bound


def vector(*parts) -> Column:
    return F.array(*[(p if isinstance(p, Column) else F.lit(float(p))).cast("double") for p in parts])


@once
def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


@once
def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


@once
def transposed(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


@once
def times_vector(m: Column, v: Column) -> Column:
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


@once
def times_matrix(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def rotated_covariance(rotation: Column, covariance: Column) -> Column:
    """R S R^T."""
    return times_matrix(times_matrix(rotation, covariance), transposed(rotation))
