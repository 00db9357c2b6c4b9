"""Array expressions whose work stays near linear in an array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least elements of a chunk of ``running``.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside ``body`` use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For every element the merge of all elements up to it; ``merge`` is associative and ``zero`` neutral.

    The array is cut into chunks of about the root of its length n, whose own running
    values are appended one by one, so n elements cost about n to the power of 1.5 copies.
    """
    def prefixes(chunk: Column) -> Column:
        steps = F.aggregate(chunk, F.array(zero), lambda done, v: F.array_append(done, merge(F.element_at(done, -1), v)))
        return F.slice(steps, 2, F.size(chunk))

    def over(array: Column) -> Column:
        size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(array))).cast("int"))
        chunks = lambda b: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(array) - 1) / b).cast("int")), lambda k: prefixes(F.slice(array, k * b + 1, b)))
        shifted = lambda inner: let(
            F.concat(F.array(zero), prefixes(F.transform(inner, lambda c: F.element_at(c, -1)))),
            lambda before: F.flatten(F.transform(inner, lambda c, k: let(F.get(before, k), lambda b: F.transform(c, lambda v: merge(b, v))))))
        return let(size, lambda b: let(chunks(b), shifted))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(over(v)))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of ints."""
    return running(values, lambda a, b: a + b, F.lit(0))


def running_most(values: Column) -> Column:
    """Inclusive running maxima of an array of ints that are not negative."""
    return running(values, F.greatest, F.lit(0))
