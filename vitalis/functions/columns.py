"""Column-level helpers: guarded arithmetic, replayable hash buckets, transforms.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing here triggers a job.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# 2**32: the md5-prefix bucket is an unsigned 32-bit integer mapped to [0, 1).
_TWO_32 = 4294967296.0


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b with NULL for a zero or NULL divisor (ANSI mode raises on 1/0)."""
    return F.try_divide(col(a), col(b))


def eps_ratio(a: ColumnOrName, b: ColumnOrName, eps: float = 1e-6) -> Column:
    """Guarded ratio ``a / (b + eps)`` used by the group-baseline features."""
    return col(a) / (col(b) + F.lit(eps))


def round_half(c: ColumnOrName, digits: int = 6) -> Column:
    """Comparison rounding: ``floor(x * 10^d + 0.6234567) / 10^d + 0.0``.

    The result rounds to ``d`` decimals with the cut placed off the decimal
    half-way point: values such as 0.0000125 (common for averages of 2-decimal
    data) sit exactly on a half-way point, where two engines' last-bit
    differences would round opposite ways.  Identical IEEE operations give the
    same value here and in the DuckDB oracle; ``+ 0.0`` turns -0.0 into 0.0.
    """
    m = float(10 ** digits)
    return F.floor(col(c) * F.lit(m) + F.lit(0.6234567)).cast("double") / F.lit(m) + F.lit(0.0)


def round_doubles(df, digits: int = 6, overrides: Mapping[str, int] | None = None):
    """Round every float/double column of ``df`` (presentation step for reports)."""
    overrides = dict(overrides or {})
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float"):
            d = overrides.get(f.name, digits)
            out.append(round_half(F.col(f.name).cast("double"), d).alias(f.name))
        elif t == "array" and f.dataType.elementType.typeName() in ("double", "float"):
            d = overrides.get(f.name, digits)
            out.append(F.transform(F.col(f.name), _elem_rounder(d)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _elem_rounder(digits: int):
    def fn(x):
        return round_half(x.cast("double"), digits)
    return fn


def md5_unit(seed: int | str, *keys: ColumnOrName) -> Column:
    """Replayable uniform number in [0, 1) from md5('seed|key1|key2...').

    The first 8 hex digits of the md5 are read as an unsigned 32-bit integer.
    Unlike ``rand()`` this does not depend on partitioning, so a recomputed task
    (lost executor, AQE re-plan) assigns every row the same value again.
    """
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def md5_unit_sql(seed: int | str, *keys: str) -> str:
    """DuckDB text of :func:`md5_unit` for oracle queries."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT / 4294967296.0)"


# Park-Miller modulus and multiplier (minimal standard generator); products stay below 2^48.
_PM_MOD = 2147483647
_PM_MUL = 48271


def md5_int32(seed: int | str, *keys: ColumnOrName) -> Column:
    """The 32-bit integer behind :func:`md5_unit` (one md5 per row)."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def mixed_unit(h: ColumnOrName, stream: ColumnOrName) -> Column:
    """Uniform in (0, 1) for (row hash h, stream number), by integer mixing only.

    ``x = (h mod (M - 1)) + 1``; ``x = ((x xor ((stream * 1664525 + 1013904223) mod M)) mod (M - 1)) + 1``;
    then three multiplicative steps ``x = x * 48271 mod M`` (M = 2^31 - 1, x never 0).  One md5
    per row plus a few integer operations per draw, branch-free so it stays one small codegen
    expression, and replayable in SQL.
    """
    x = F.pmod(col(h), F.lit(_PM_MOD - 1)) + 1
    k = F.pmod(col(stream).cast("bigint") * F.lit(1664525) + F.lit(1013904223), F.lit(_PM_MOD))
    x = F.pmod(x.bitwiseXOR(k), F.lit(_PM_MOD - 1)) + 1
    for _ in range(3):
        x = F.pmod(x * F.lit(_PM_MUL), F.lit(_PM_MOD))
    return x.cast("double") / F.lit(float(_PM_MOD))


def mixed_unit_array(h: np.ndarray, streams: int) -> np.ndarray:
    """:func:`mixed_unit` of every row hash for the streams 0 to ``streams - 1``: (rows, streams)."""
    k = (np.arange(streams, dtype=np.int64) * 1664525 + 1013904223) % _PM_MOD
    x = ((h % (_PM_MOD - 1) + 1)[:, None] ^ k) % (_PM_MOD - 1) + 1
    for _ in range(3):
        x = x * _PM_MUL % _PM_MOD
    return x / float(_PM_MOD)


def mixed_unit_sql(h: str, stream: str) -> str:
    """DuckDB twin of :func:`mixed_unit` (h: BIGINT expression)."""
    x = f"((({h}) % {_PM_MOD - 1}) + 1)"
    k = f"((CAST({stream} AS BIGINT) * 1664525 + 1013904223) % {_PM_MOD})"
    x = f"((xor({x}, {k}) % {_PM_MOD - 1}) + 1)"
    for _ in range(3):
        x = f"(({x} * {_PM_MUL}) % {_PM_MOD})"
    return f"(CAST({x} AS DOUBLE) / {float(_PM_MOD)!r})"


def md5_int32_sql(seed: int | str, *keys: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT)"


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN counts as missing (pandas convention); Spark sorts NaN above numbers."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


# ---------------------------------------------------------------- transforms

def log1p_safe(c: ColumnOrName) -> Column:
    """log(1 + x); x <= -1 gives NULL."""
    c = col(c)
    return F.when(c > -1, F.log1p(c))


def sqrt_safe(c: ColumnOrName) -> Column:
    """sqrt(x) for x >= 0, NULL otherwise (Spark's sqrt(-1) is NaN)."""
    c = col(c)
    return F.when(c >= 0, F.sqrt(c))


def zscore(c: ColumnOrName, mean: ColumnOrName, std: ColumnOrName) -> Column:
    return safe_div(col(c) - col(mean), std)


def minmax(c: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName) -> Column:
    return safe_div(col(c) - col(lo), col(hi) - col(lo))


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    c = col(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def abs_error(y: ColumnOrName, p: ColumnOrName) -> Column:
    return F.abs(col(y) - col(p))


# ------------------------------------------------------------------ strings

def categorize_by_prefix(c: ColumnOrName, prefixes: Mapping[str, str], default: str) -> Column:
    """First matching prefix of the string form of ``c`` wins; else ``default``."""
    s = col(c).cast("string")
    expr = None
    for prefix, name in prefixes.items():
        cond = s.startswith(prefix)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


# Entity id prefix -> experience category (reference semantics).
ENTITY_PREFIX_CATEGORIES = {"8": "minimal_exp", "9": "commercial"}
ENTITY_DEFAULT_CATEGORY = "air_force"


def entity_category(c: ColumnOrName) -> Column:
    return categorize_by_prefix(c, ENTITY_PREFIX_CATEGORIES, ENTITY_DEFAULT_CATEGORY)


def file_extension(path: ColumnOrName) -> Column:
    """Lower-case extension without the dot ('' when absent)."""
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def stem_before_dot(name: ColumnOrName) -> Column:
    """Text before the first '.', e.g. entity id from '812.json'."""
    return F.split_part(col(name), F.lit("."), F.lit(1))


def json_get(c: ColumnOrName, key: str, default=None, cast: str | None = None) -> Column:
    """``dict.get(key, default)`` on a JSON text column."""
    v = F.get_json_object(col(c), f"$.{key}")
    if cast:
        v = v.cast(cast)
    return v if default is None else F.coalesce(v, F.lit(default))


# ------------------------------------------------------------------- arrays

def first_n(arr: ColumnOrName, n: int) -> Column:
    return F.slice(col(arr), 1, n)


def elem(arr: ColumnOrName, i: int) -> Column:
    """0-based element access that gives NULL when out of range."""
    return F.get(col(arr), i)


def pad_right(arr: ColumnOrName, length: ColumnOrName, value: float = 0.0) -> Column:
    a = col(arr)
    missing = F.greatest(col(length) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(value), missing))


def argmax(arr: ColumnOrName) -> Column:
    """0-based position of the first maximum."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def taper(kind: str, n: ColumnOrName, i: ColumnOrName) -> Column:
    """Symmetric taper window value at sample i of n (numpy hamming/hanning/blackman)."""
    n, i = col(n).cast("double"), col(i).cast("double")
    x = F.lit(2 * math.pi) * i / (n - 1)
    if kind == "hamming":
        w = F.lit(0.54) - F.lit(0.46) * F.cos(x)
    elif kind in ("hanning", "hann"):
        w = F.lit(0.5) - F.lit(0.5) * F.cos(x)
    elif kind == "blackman":
        w = F.lit(0.42) - F.lit(0.5) * F.cos(x) + F.lit(0.08) * F.cos(2 * x)
    else:
        raise ValueError(f"unknown window {kind!r}")
    return F.when(n == 1, F.lit(1.0)).otherwise(w)


def apply_taper(arr: ColumnOrName, kind: str) -> Column:
    """Multiply an array signal by a taper window of its own length."""
    a = col(arr)
    n = F.size(a)
    return F.transform(a, lambda v, i: v * taper(kind, n, i))


def names(cols: Iterable[str]) -> list[str]:
    return list(cols)
