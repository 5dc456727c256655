"""Column-expression builders.

All of these produce JVM-side Catalyst expressions, so they stay inside
whole-stage codegen.

Scalar function families (SURVEY H1-H10) and where they are used:
H1 abs / greatest / least / round (derived channels, z-scores, top lists);
H2 sigmoid (:func:`sigmoid`, scoring); H3 natural log (PSI, log-loss);
H4 linear bin edges (drift._bin_start / _bin_fix); H5 fixed-point text
(functions/fmt.py); H6 join / slice of lists (explain: concat_ws, slice);
H7 map lookup with default (element_at + coalesce: severity messages,
descriptions); H8 array size / element access / ordered lists (A8 shape
check, array_sort of structs); H9 JSON encode / decode (alert records,
baseline JSON); H10 timestamp format (run names, date_format).  They encode the NULL/NaN rules of the reference:
missing values are NULL (NaN is converted at the scan), clipping keeps
NULL, comparisons with NULL count as false.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN becomes NULL; everything else passes through."""
    c = col(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def clip(c, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi] keeping NULL as NULL (least/greatest would turn NULL into a bound)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def is_true(cond: Column) -> Column:
    """NULL-safe predicate: NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def softplus(c) -> Column:
    """log(1 + exp(x)), numerically stable."""
    c = col(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def safe_div(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def round6(c) -> Column:
    return F.round(col(c).cast("double"), 6)


def severity(prob, cuts: Sequence[tuple[str, float | None]] | None = None) -> Column:
    """Severity bucket from a probability: >=0.80 CRITICAL, >=0.60 HIGH, >=0.40 MEDIUM, else NORMAL."""
    cuts = cuts or [(s, lo) for s, lo, _ in dims.SEVERITIES]
    p = col(prob)
    expr = None
    default = None
    for name, lo in cuts:
        if lo is None:
            default = name
            continue
        cond = is_true(p >= F.lit(lo))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default))


def severity_message(sev) -> Column:
    m = F.create_map(*[x for s, _, msg in dims.SEVERITIES for x in (F.lit(s), F.lit(msg))])
    return F.element_at(m, col(sev))


def stable_hash_key(seed, id_col) -> Column:
    """md5(seed ':' id): the same ordering in Spark and in plain SQL engines."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), col(id_col).cast("string")))


def pct1(c) -> Column:
    """Probability as a percentage string with one decimal (``'%.1f'``, the reference's rounding)."""
    from .fmt import fixed
    return fixed(col(c) * F.lit(100.0), 1)


def any_of(names: Iterable[str], universe) -> Column:
    """arrays_overlap(universe, array(names)) with NULL treated as false."""
    names = list(names)
    if not names:
        return F.lit(False)
    return is_true(F.arrays_overlap(col(universe), F.array(*[F.lit(n) for n in names])))


def phase_expr(ias, alt, spec: dims.PhaseSpec) -> Column:
    """Flight phase name.  The masks are disjoint; cruise is strict on both limits."""
    ias, alt = col(ias), col(alt)
    cruise = (ias > F.lit(spec.cruise_ias)) & (alt > F.lit(spec.cruise_alt))
    taxi = (ias < F.lit(spec.taxi_ias)) & (alt < F.lit(spec.taxi_alt))
    takeoff = (ias >= F.lit(spec.taxi_ias)) & (alt <= F.lit(spec.cruise_alt)) & ~cruise
    return (F.when(is_true(cruise), F.lit("cruise"))
            .when(is_true(taxi), F.lit("taxi"))
            .when(is_true(takeoff), F.lit("takeoff"))
            .otherwise(F.lit("descent")))


def phase_weight(phase) -> Column:
    m = F.create_map(*[x for name, _, w in dims.PHASES for x in (F.lit(name), F.lit(w))])
    return F.element_at(m, col(phase))


def phase_ord(phase) -> Column:
    m = F.create_map(*[x for name, o, _ in dims.PHASES for x in (F.lit(name), F.lit(o))])
    return F.element_at(m, col(phase))
