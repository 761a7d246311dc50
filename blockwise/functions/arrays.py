"""Array algebra on small per-row vectors (logits, probabilities,
embeddings). Everything is a higher-order function over the array; rows
are never exploded per element.

Per-row scalars (max, sum, mean, variance, a hash uniform) are bound as
lambda variables through ``aggregate``'s finish function. Written as plain
sub-expressions inside a ``transform`` lambda they would be evaluated
again for every element (Catalyst also folds separate columns back into
the lambda), which made a 64-wide layer norm ~50x slower.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blockwise.functions.numeric import _c


def array_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    """Sum of element-wise products, summed in index order."""
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def add_arrays(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def scale_array(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda v: v * s)


def _fold_max(l: Column, finish):
    return F.aggregate(l, F.lit(float("-inf")), lambda a, x: F.greatest(a, x), finish)


def softmax(logits) -> Column:
    """Numerically stable softmax over an array of logits (one pass for
    the max, one for the sum, one for the division)."""
    l = _c(logits)
    return _fold_max(l, lambda m: F.aggregate(
        l, F.lit(0.0), lambda a, x: a + F.exp(x - m),
        lambda s: F.transform(l, lambda x: F.exp(x - m) / s)))


def logsumexp(logits) -> Column:
    l = _c(logits)
    return _fold_max(l, lambda m: m + F.log(F.aggregate(
        l, F.lit(0.0), lambda a, x: a + F.exp(x - m))))


def top1(probs) -> Column:
    """0-based index of the maximum; the lowest index wins ties."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top1_prob(probs) -> Column:
    return F.array_max(_c(probs))


def cross_entropy(logits, target) -> Column:
    """logsumexp(l) - l[target]; ``target`` is 0-based."""
    l = _c(logits)
    return logsumexp(l) - F.element_at(l, _c(target).cast("int") + 1)


def temper(logits, t: float) -> Column:
    """Divide logits by max(1e-6, t)."""
    d = max(1e-6, float(t))
    return F.transform(_c(logits), lambda x: x / F.lit(d))


def layer_norm(v, eps: float = 1e-5, gain=None, bias=None) -> Column:
    """(v - mean) / sqrt(var + eps), population variance computed in two
    passes, then gain and bias (arrays of the same length, or None for 1
    and 0)."""
    v = F.transform(_c(v), lambda x: x.cast("double"))
    n = F.size(v).cast("double")
    e = F.lit(float(eps))

    def normed(s):
        return F.aggregate(
            v, F.lit(0.0), lambda a, x: a + (x - s / n) * (x - s / n),
            lambda q: F.transform(v, lambda x: (x - s / n) / F.sqrt(q / n + e)))

    y = F.aggregate(v, F.lit(0.0), lambda a, x: a + x, normed)
    if gain is not None:
        y = F.zip_with(y, _c(gain), lambda a, g: a * g)
    if bias is not None:
        y = F.zip_with(y, _c(bias), lambda a, b: a + b)
    return y


def draw(probs, u) -> Column:
    """Categorical draw: the first 0-based index whose running sum exceeds
    ``u`` in [0, 1); the last index if rounding leaves none."""
    p = _c(probs)
    init = F.struct(F.lit(0.0).alias("acc"), F.lit(-1).alias("pick"), F.lit(0).alias("i"))

    def walk(uu):
        def step(s, x):
            acc = s["acc"] + x
            pick = F.when((s["pick"] < 0) & (acc > uu), s["i"]).otherwise(s["pick"])
            return F.struct(acc.alias("acc"), pick.alias("pick"), (s["i"] + 1).alias("i"))
        return F.aggregate(p, init, step, lambda r: r["pick"])

    # bind u once per row as a lambda variable
    pick = F.aggregate(F.array(_c(u).cast("double")), F.lit(-1), lambda a, uu: walk(uu))
    return F.when(pick < 0, F.size(p) - 1).otherwise(pick).cast("int")
