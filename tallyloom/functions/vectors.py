"""Column functions on probability vectors: arrays of doubles that share one axis.

Every function that compares two vectors takes them normalised (see ``normalised``): lambdas over arrays are not
shared between expressions, so a vector is scaled once, before it meets others. A null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities up to this are left out of logarithms, and divisors are held at it.
EPS = 1e-12
#: Absolute and relative distance from uniform under which a vector says nothing.
UNIFORM_ABS, UNIFORM_REL = 1e-6, 1e-5


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def clipped(v: Column) -> Column:
    """Negative entries become 0."""
    return F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def scaled(clipped_vector: Column) -> Column:
    """Entries divided by their sum; a vector without mass becomes uniform."""
    s = total(clipped_vector)
    return F.when(s > 0, F.transform(clipped_vector, lambda x: x / s)).otherwise(F.transform(clipped_vector, lambda x: F.lit(1.0) / F.size(clipped_vector)))


def normalised(v: Column) -> Column:
    """Clipped at 0 and scaled to sum 1; uniform if nothing is left. The sum is computed once per vector."""
    return F.get(F.transform(F.array(clipped(v)), lambda c: F.get(F.transform(F.array(F.struct(c.alias("c"), total(c).alias("s"))), _scale), F.lit(0))), F.lit(0))


def _scale(z: Column) -> Column:
    c, s = z["c"], z["s"]
    return F.when(s > 0, F.transform(c, lambda x: x / s)).otherwise(F.transform(c, lambda x: F.lit(1.0) / F.size(c)))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in bits over entries of p above EPS; q is held at EPS."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > EPS, x * F.log2(x / F.greatest(y, F.lit(EPS)))).otherwise(0.0)))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits, held to [0, 1], in one pass over both vectors."""

    def term(x: Column, y: Column) -> Column:
        m = F.greatest((x + y) / 2, F.lit(EPS))
        return F.when(x > EPS, x * F.log2(x / m)).otherwise(0.0) / 2 + F.when(y > EPS, y * F.log2(y / m)).otherwise(0.0) / 2

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total(F.zip_with(p, q, term))))


def total_variation(p: Column, q: Column) -> Column:
    return l1(p, q) / 2


def l1(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def order_by_value(v: Column) -> Column:
    """Positions from 0 by falling value, the earlier one first among equals."""
    pairs = F.transform(v, lambda x, i: F.struct((F.lit(0.0) - x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda z: z["i"])


def top_k(v: Column, k: int) -> Column:
    return F.slice(order_by_value(v), 1, k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def entropy(p: Column, cut: float = EPS) -> Column:
    """In bits, over entries above ``cut``."""
    return total(F.transform(p, lambda x: F.when(x > cut, -x * F.log2(x)).otherwise(0.0)))


def informative(p: Column) -> Column:
    """Whether some entry differs from uniform; false for null. p is bound once: if it is made in place, it is not made
    anew for each entry."""

    def differs(v: Column) -> Column:
        even = F.lit(1.0) / F.size(v)
        return F.exists(v, lambda x: F.abs(x - even) > F.lit(UNIFORM_ABS) + F.lit(UNIFORM_REL) * even)

    return F.coalesce(F.get(F.transform(F.array(p), differs), F.lit(0)), F.lit(False))


def log_odds(p: Column, floor: float = 1e-4) -> Column:
    def one(x: Column) -> Column:
        y = F.least(F.greatest(x, F.lit(floor)), F.lit(1 - floor))
        return F.ln(y / (1 - y))

    return F.transform(p, one)


def top1(v: Column) -> Column:
    """Position from 0 of the first largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column) -> Column:
    def scale(z: Column) -> Column:
        return F.transform(z["e"], lambda x: x / z["s"])

    def powers(m: Column) -> Column:
        e = F.transform(v, lambda x: F.exp(x - m))
        return F.get(F.transform(F.array(e), lambda e: F.get(F.transform(F.array(F.struct(e.alias("e"), total(e).alias("s"))), scale), F.lit(0))), F.lit(0))

    return F.get(F.transform(F.array(F.array_max(v)), powers), F.lit(0))


def rank_of(v: Column, k: Column) -> Column:
    """1 and the number of entries above entry k (from 0): equals share the best rank."""
    own = F.get(v, k)
    return 1 + F.size(F.filter(v, lambda x: x > own))


def scattered(axis: Column, names: Column, values: Column) -> Column:
    """values laid on an axis of names, 0 where a name is missing."""
    at = F.map_from_arrays(names, values)
    return F.transform(axis, lambda n: F.coalesce(F.try_element_at(at, n), F.lit(0.0)))


def distinct_values(v: Column, digits: int = 5) -> Column:
    return F.size(F.array_distinct(F.transform(v, lambda x: F.round(x, digits))))


def falling(v: Column, tolerance: float = 1e-12) -> Column:
    """Whether no entry is above the one before it."""
    return F.forall(F.transform(v, lambda x, i: (i == 0) | (F.get(v, i - 1) >= x - tolerance)), lambda ok: ok)
