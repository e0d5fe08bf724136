"""Small text helpers for the DuckDB oracle queries (presentation only)."""

from __future__ import annotations


def R(expr: str, digits: int = 6) -> str:
    """Oracle twin of ``functions.columns.round_half``."""
    m = f"1e{digits}"
    return f"(CAST(floor(({expr}) * {m} + 0.6234567) AS DOUBLE) / {m} + 0.0)"


def rounded(inner: str, doubles: list[str], digits: int = 6, overrides: dict[str, int] | None = None,
            arrays: list[str] | None = None) -> str:
    """SELECT * REPLACE(rounded double columns and double arrays) FROM (inner)."""
    overrides = overrides or {}
    arrays = arrays or []
    if not doubles and not arrays:
        return inner
    reps = ", ".join([f"{R(f'q.{c}', overrides.get(c, digits))} AS {c}" for c in doubles] +
                     [f"list_transform(q.{c}, lambda x: {R('x', overrides.get(c, digits))}) AS {c}" for c in arrays])
    return f"SELECT * REPLACE ({reps}) FROM (\n{inner}\n) q"


def reg_aggs(y: str, p: str, metrics=("mse", "rmse", "mae", "r2", "explained_variance", "mape", "median_ae",
                                      "max_error"), mape_scale: float = 1.0) -> str:
    e = f"(({y}) - ({p}))"
    out = []
    for m in metrics:
        if m == "mse":
            out.append(f"avg({e}*{e}) AS mse")
        elif m == "rmse":
            out.append(f"sqrt(avg({e}*{e})) AS rmse")
        elif m == "mae":
            out.append(f"avg(abs({e})) AS mae")
        elif m == "r2":
            out.append(
                f"CASE WHEN count({e}) >= 2 THEN CASE WHEN var_pop({y}) * count({e}) = 0 THEN "
                f"CASE WHEN sum({e}*{e}) = 0 THEN 1.0 ELSE 0.0 END "
                f"ELSE 1 - sum({e}*{e}) / (var_pop({y}) * count({e})) END END AS r2")
        elif m == "explained_variance":
            out.append(
                f"CASE WHEN count({e}) >= 2 THEN CASE WHEN var_pop({y}) = 0 THEN "
                f"CASE WHEN var_pop({e}) = 0 THEN 1.0 ELSE 0.0 END "
                f"ELSE 1 - var_pop({e}) / var_pop({y}) END END AS explained_variance")
        elif m == "mape":
            out.append(f"avg(CASE WHEN ({y}) <> 0 THEN abs({e}) / abs({y}) END) * {mape_scale} AS mape")
        elif m == "median_ae":
            out.append(f"quantile_cont(abs({e}), 0.5) AS median_ae")
        elif m == "max_error":
            out.append(f"max(abs({e})) AS max_error")
    return ", ".join(out)
