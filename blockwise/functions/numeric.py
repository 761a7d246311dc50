"""Scalar numeric helpers: the three metric states (finite, inf, NaN) are
kept apart, as the metric logs use them with distinct meanings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    """Not NULL, not NaN and not +-inf (drops NaN **and** inf)."""
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def not_missing(c) -> Column:
    """Not NULL and not NaN; inf is kept."""
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c)


def to_double(c) -> Column:
    """Coerce text to DOUBLE; unparsable text becomes NULL ('nan'/'inf' parse)."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def perplexity(loss) -> Column:
    """exp(loss) when loss is finite and below 20, else +inf (NaN loss -> inf)."""
    loss = _c(loss)
    return F.when(is_finite(loss) & (loss < 20), F.exp(loss)).otherwise(F.lit(INF))


def improvement_pct(base, value) -> Column:
    """(base - value) / base * 100."""
    base, value = _c(base), _c(value)
    return (base - value) / base * F.lit(100.0)


def throughput(step, batch_size, seq_len, elapsed_sec) -> Column:
    """Cumulative tokens per second: step * B * L / max(1e-6, elapsed)."""
    return (_c(step) * _c(batch_size) * _c(seq_len)).cast("double") / F.greatest(
        F.lit(1e-6), _c(elapsed_sec).cast("double"))


def bytes_to_mb(b) -> Column:
    """Bytes to MB (1024**2); a missing device reading is 0."""
    return F.coalesce(_c(b).cast("double") / F.lit(1024.0 * 1024.0), F.lit(0.0))


def nan_max(c) -> Column:
    """Aggregate max that skips NaN (plain max returns NaN if any row is NaN);
    NaN when nothing is left."""
    c = _c(c)
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.lit(NAN))


def last_n(c, n: int) -> Column:
    """Keep the last ``n`` elements of an array (a context cut)."""
    c = _c(c)
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - F.lit(n) + 1), F.lit(n))


def every_k(c, k: int) -> Column:
    """Predicate ``c % k == 0``; k = 0 disables (always false)."""
    if not k:
        return F.lit(False)
    return (_c(c) % F.lit(k)) == 0
