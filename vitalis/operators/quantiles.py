"""Exact quantiles of whole columns and of groups by selection: sketches narrow a bracket, only its values are counted.

``percentile`` keeps one count per distinct value of a column in a single reducer.  Here
a mergeable sketch (``percentile_approx``) puts each wanted rank between two values, the
rows below are counted, and the next sketch looks between the two only; when few values
are left there, they are counted and the ranks read off.  Each round reads the data twice
and narrows a bracket some thousandfold; nothing is shuffled but sketches and counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis.operators.ordering import join_null_safe
from vitalis.session import written

#: Accuracy of a sketch, and distinct values that may come to the driver at the end.
ACCURACY = 10_000
KEEP = 100_000


def exact_quantiles(df: DataFrame, exprs: Mapping[str, Column | str], probs: Sequence[float],
                    accuracy: int = ACCURACY, keep: int = KEEP) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of each expression; NULL and NaN are passed over, None without a value."""
    names = list(exprs)
    x = [F.col(f"_x{i}") for i in range(len(names))]
    cols = [(F.col(e) if isinstance(e, str) else e).cast("double") for e in exprs.values()]
    base = df.select(*[F.when(~F.isnan(c), c).alias(f"_x{i}") for i, c in enumerate(cols)])
    first = base.agg(*[F.struct(F.count(c), F.min(c), F.max(c)).alias(f"s{i}") for i, c in enumerate(x)]).first()
    out: dict[str, list[float] | None] = {n: None for n in names}
    # one bracket per (column, probability): ranks k and k + 1, values lo to hi, rows below and inside
    brackets = []
    for i, (n, lo, hi) in enumerate(first):
        if n:
            out[names[i]] = [0.0] * len(probs)
            for j, p in enumerate(probs):
                k = min(math.floor(p * (n - 1)), n - 1)
                brackets.append({"i": i, "j": j, "k": k, "f": p * (n - 1) - k, "top": min(k + 1, n - 1), "lo": lo, "hi": hi, "below": 0, "inside": n})
    slack = 2.0 / accuracy
    keep = max(keep, 64 * len(brackets))  # a bracket ends with a few values
    while brackets and slack < 1:
        inside = [F.struct(F.lit(b).alias("b"), x[s["i"]].alias("v")) for b, s in enumerate(brackets)]
        bound = F.lit(False)
        for b, s in enumerate(brackets):
            bound = bound | ((F.col("q.b") == b) & F.col("q.v").between(s["lo"], s["hi"]))
        values = base.select(F.explode(F.array(*inside)).alias("q")).where(bound).groupBy("q.b", "q.v").agg(F.count(F.lit(1)).alias("n"))
        if sum(s["inside"] for s in brackets) <= keep or values.limit(keep + 1).count() <= keep:
            found: dict[int, list] = {}
            for b, v, n in values.collect():
                found.setdefault(b, []).append((v, n))
            for b, s in enumerate(brackets):
                out[names[s["i"]]][s["j"]] = _read(sorted(found[b]), s)
            return out
        # sketches inside the brackets
        wanted = []
        for b, s in enumerate(brackets):
            eps = slack + 2.0 / s["inside"]
            at = [max(0.0, (s["k"] - s["below"]) / s["inside"] - eps), min(1.0, (s["top"] + 1 - s["below"]) / s["inside"] + eps)]
            v = F.when(x[s["i"]].between(s["lo"], s["hi"]), x[s["i"]])
            wanted.append(F.percentile_approx(v, at, accuracy).alias(f"b{b}"))
        edges = base.agg(*wanted).first()
        counts = base.agg(*[F.struct(F.count_if(x[s["i"]] < e[0]), F.count_if(x[s["i"]].between(e[0], e[1]))).alias(f"b{b}")
                            for b, (s, e) in enumerate(zip(brackets, edges, strict=True))]).first()
        moved = False
        for s, (lo, hi), (below, n) in zip(brackets, edges, counts, strict=True):
            if below <= s["k"] and s["top"] < below + n and n < s["inside"]:
                s.update(lo=lo, hi=hi, below=below, inside=n)
                moved = True
        slack = 2.0 / accuracy if moved else slack * 2
    if brackets:
        raise RuntimeError("quantiles did not settle")
    return out


def _read(values: list[tuple[float, int]], s: dict) -> float:
    """The value at rank k + f of a bracket's (value, rows)."""
    at, low, high = s["below"], None, None
    for v, n in values:
        if low is None and s["k"] < at + n:
            low = v
        if s["top"] < at + n:
            high = v
            break
        at += n
    return low + (high - low) * s["f"] if s["f"] else low


#: Rows of a group up to which its values are counted in one task; larger groups are selected.
SMALL = 100_000
#: Steps of the grid of ranks that a sketch of a bracket gives, and groups whose brackets may be broadcast.
GRID = 1024
BROADCAST_GROUPS = 10_000
ROUNDS = 40


def grouped_quantiles(df: DataFrame, keys: Sequence[str], exprs: Mapping[str, Column | str], probs: Sequence[float],
                      small: int = SMALL, grid: int = GRID) -> DataFrame:
    """Linear-interpolated quantiles per group: the keys and, for each expression, an array of its quantiles at ``probs``.

    NULL and NaN are passed over (an array is NULL without a value); NULL keys are groups.
    Groups of up to ``small`` values are counted out in one task each.  In a larger one
    every wanted rank has a bracket, narrowed by sketches (partial per task, so a hot
    group never meets in one) until ``small`` values are left or one value holds the rank.
    """
    keys, names = list(keys), list(exprs)
    cols = [(F.col(e) if isinstance(e, str) else e).cast("double") for e in exprs.values()]
    base = df.select(*keys, *[F.when(~F.isnan(c), c).alias(f"_x{i}") for i, c in enumerate(cols)])
    counts = base.groupBy(*keys).agg(*[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(names))])
    most = F.greatest(*[F.col(f"_n{i}") for i in range(len(names))]) if len(names) > 1 else F.col("_n0")
    big = written(counts.where(most > small).withColumn("_g", F.monotonically_increasing_id()), "groups")
    number = big.count()
    few = number <= BROADCAST_GROUPS
    if number:
        ids = big.select(*keys, "_g")
        base = join_null_safe(base, F.broadcast(ids) if few else ids, keys, "left")
    rest = base.where("_g is null") if number else base
    out = rest.groupBy(*keys).agg(*[F.percentile(f"_x{i}", list(probs)).alias(n) for i, n in enumerate(names)])
    if not number:
        return out
    values = base.where("_g is not null").select("_g", F.posexplode(F.array(*[F.col(f"_x{i}") for i in range(len(names))])).alias("_i", "_v")).where("_v is not null")
    found = _select(values, big, len(names), probs, small, grid, few)
    wide = found.groupBy("_g").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    return out.unionByName(big.select(*keys, "_g").join(wide, "_g", "left").select(*keys, *names))


def _select(values: DataFrame, big: DataFrame, p: int, probs: Sequence[float], small: int, grid: int, few: bool) -> DataFrame:
    """(_g, _i, _q) of the values (_g, _i, _v): brackets per (group, column, rank) as a table that narrows from round to round."""

    def side(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if few else t  # at most a few rows per group

    size = big.select("_g", F.posexplode(F.array(*[F.col(f"_n{i}") for i in range(p)])).alias("_i", "_n")).where("_n > 0")
    at = F.explode(F.array(*[F.lit(float(x)) for x in dict.fromkeys(probs)])).alias("_p")
    place = size.select("_g", "_i", "_n", at).withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
    low = F.floor("_pos")
    rank = place.select("_g", "_i", "_n", F.explode(F.array(low, F.least(low + 1, F.col("_n") - 1))).alias("_r")).distinct()
    # an open interval (_lo, _hi), at first without bounds; _below rows lie before it and _in rows inside
    state = rank.select("_g", "_i", "_r", F.lit(True).alias("_all"), F.lit(0.0).alias("_lo"), F.lit(0.0).alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), F.lit(None).cast("double").alias("_value"))
    state = written(state, "brackets")
    span = ["_g", "_i", "_all", "_lo", "_hi"]
    inside = F.col("_all") | ((F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi")))
    done = None
    for turn in range(ROUNDS):
        ready = state.where((F.col("_value").isNotNull()) | (F.col("_in") <= small))
        state = written(state.where((F.col("_value").isNull()) & (F.col("_in") > small)), "brackets")
        done = ready if done is None else done.unionByName(ready)
        if state.limit(1).count() == 0:
            break
        spans = state.select(*span).distinct()
        held = values.join(side(spans), ["_g", "_i"]).where(inside)
        sketch = held.groupBy(*span).agg(F.percentile_approx("_v", [k / grid for k in range(grid + 1)], 10 * grid).alias("_e"))
        t = (F.col("_r") - F.col("_below")) / F.col("_in") * grid
        step = F.lit(1 + turn)  # a wider look each round, should a sketch have missed
        cut = state.join(sketch, span).select(
            *state.columns, F.get("_e", F.greatest(F.floor(t) - step, F.lit(0)).cast("int")).alias("_a"),
            F.get("_e", F.least(F.ceil(t + grid / F.col("_in")) + step, F.lit(grid)).cast("int")).alias("_b"))
        cut = written(cut, "cuts")
        edges = cut.select(*span, "_a", "_b").distinct()
        v = F.col("_v")
        n = values.join(side(edges), ["_g", "_i"]).where(inside).groupBy(*span, "_a", "_b").agg(
            F.count_if(v < F.col("_a")).alias("_c0"), F.count_if(v == F.col("_a")).alias("_c1"),
            F.count_if((v > F.col("_a")) & (v < F.col("_b"))).alias("_c2"),
            F.count_if((v == F.col("_b")) & (v > F.col("_a"))).alias("_c3"))
        j = cut.join(n, [*span, "_a", "_b"])
        k = F.col("_r") - F.col("_below")
        c1, c2, c3 = F.col("_c0") + F.col("_c1"), F.col("_c0") + F.col("_c1") + F.col("_c2"), F.col("_c0") + F.col("_c1") + F.col("_c2") + F.col("_c3")
        in_a, mid, in_b = (k >= F.col("_c0")) & (k < c1), (k >= c1) & (k < c2), (k >= c2) & (k < c3)
        state = j.select(
            "_g", "_i", "_r", (F.col("_all") & ~mid).alias("_all"), F.when(mid, F.col("_a")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(mid, F.col("_b")).otherwise(F.col("_hi")).alias("_hi"), (F.col("_below") + F.when(mid, c1).otherwise(0)).alias("_below"),
            F.when(mid, F.col("_c2")).otherwise(F.col("_in")).alias("_in"), F.when(in_a, F.col("_a")).when(in_b, F.col("_b")).alias("_value"))
        state = written(state, "brackets")
    else:
        raise RuntimeError("quantiles did not settle")
    # what is left of a bracket is counted and read off: at most ``small`` values in each
    done = written(done, "brackets")
    left = done.where("_value is null")
    counts = values.join(side(left.select(*span).distinct()), ["_g", "_i"]).where(inside).groupBy(*span, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*span).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_to", F.sum("_c").over(run))
    read = left.drop("_value").join(counts, span).where(F.col("_r") - F.col("_below") < F.col("_to")).groupBy("_g", "_i", "_r").agg(F.min("_v").alias("_value"))
    ranks = written(done.where("_value is not null").select("_g", "_i", "_r", "_value").unionByName(read), "ranks")
    lows, highs = (ranks.select("_g", "_i", F.col("_r").alias(f"_{x}"), F.col("_value").alias(f"_v{x}")) for x in ("low", "high"))
    place = place.select("_g", "_i", "_p", low.alias("_low"), F.least(low + 1, F.col("_n") - 1).alias("_high"), (F.col("_pos") - low).alias("_f"))
    q = place.join(lows, ["_g", "_i", "_low"]).join(highs, ["_g", "_i", "_high"])
    q = q.withColumn("_q", F.when(F.col("_f") > 0, F.col("_vlow") + (F.col("_vhigh") - F.col("_vlow")) * F.col("_f")).otherwise(F.col("_vlow")))
    by = F.map_from_entries(F.collect_list(F.struct("_p", "_q")))
    return q.groupBy("_g", "_i").agg(by.alias("_m")).select("_g", "_i", F.array(*[F.element_at("_m", F.lit(float(x))) for x in probs]).alias("_q"))
