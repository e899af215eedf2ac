"""Factor diagnostics for any number of factors in one plan.

Input is long: ``ranks`` (factor_id, session, security_id, score) and ``labels`` (session, security_id, forward_return).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions import scalar as sc
from tidepanel.functions import timeseries as ts
from tidepanel.operators.ordering import pooled_rank_corr

FLAT = ts.FLAT


def signal_sessions(calendar: DataFrame) -> DataFrame:
    """The session before the first one of each new ISO week, numbered; (session, ordinal, execution)."""
    order = Window.orderBy("session")  # a calendar has a few thousand rows
    week = sc.iso_week(F.col("session"))
    rows = calendar.select("session").distinct().withColumns({"week": week, "execution": F.lead("session").over(order)})
    rows = rows.withColumn("next_week", F.lead("week").over(order)).where("next_week != week")
    return rows.select("session", F.row_number().over(order).alias("ordinal"), "execution")


def with_forward_returns(grid: DataFrame, horizon: int = 5, price: str = "open") -> DataFrame:
    """The grid with forward_return: price[t + 1 + horizon] / price[t + 1] - 1 where both are there and the entry is above zero."""
    w = ts.history()
    entry, leave = (sc.finite(F.lead(price, n).over(w)) for n in (1, 1 + horizon))
    rows = grid.withColumns({"__entry": entry, "__leave": leave})
    return rows.withColumn("forward_return", F.when(F.col("__entry") > 0, F.try_divide("__leave", "__entry") - 1)).drop("__entry", "__leave")


def forward_returns(grid: DataFrame, horizon: int = 5, price: str = "open") -> DataFrame:
    """Rows (session, security_id, forward_return)."""
    return with_forward_returns(grid, horizon, price).select("session", "security_id", "forward_return")


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; a flat side gives NULL."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > FLAT, F.covar_pop(x, y) / spread)


def rank_ic(pairs: DataFrame, by: list[str], x: str = "score", y: str = "forward_return") -> DataFrame:
    """Spearman correlation for each key over rows where both values are finite; (by..., ic, n)."""
    both = pairs.where(sc.is_finite(F.col(x)) & sc.is_finite(F.col(y)))
    ranked = both.withColumns({"__x": cs.average_rank(F.col(x), *by), "__y": cs.average_rank(F.col(y), *by)})
    return ranked.groupBy(*by).agg(guarded_corr(F.col("__x"), F.col("__y")).alias("ic"), F.count("*").alias("n"))


def ic_summary(ics: DataFrame, by: list[str]) -> DataFrame:
    """Mean, sample deviation and their quotient over sessions with a correlation."""
    return ics.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.count("ic").alias("n_sessions"))


def yearly_ic(ics: DataFrame, by: list[str], whole: int = 26, partial: int = 13) -> DataFrame:
    """Mean per year with FULL_YEAR, PARTIAL_YEAR (the last year only) or INSUFFICIENT."""
    years = ics.where("ic is not null").groupBy(*by, F.year("session").alias("year")).agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n"))
    last = F.max("year").over(Window.partitionBy(*by))
    status = F.when(F.col("n") >= whole, "FULL_YEAR").when((F.col("year") == last) & (F.col("n") >= partial), "PARTIAL_YEAR").otherwise("INSUFFICIENT")
    return years.withColumn("status", status)


def positive_years(yearly: DataFrame, by: list[str]) -> DataFrame:
    use = F.col("status") != "INSUFFICIENT"
    return yearly.groupBy(*by).agg(F.avg(F.when(use, (F.col("mean_ic") > 0).cast("double"))).alias("positive_year_ratio"))


def coverage(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Median over sessions of the share of rows that have score and label."""
    good = sc.is_finite(F.col("score")) & sc.is_finite(F.col("forward_return"))
    shares = pairs.groupBy(*by, "session").agg((F.count_if(good) / F.count("*")).alias("share"))
    return shares.groupBy(*by).agg(F.median("share").alias("median_coverage"))


def quantile_means(pairs: DataFrame, by: list[str], q: int = 5) -> DataFrame:
    """Pooled mean return of each bucket, as columns q1..qn, and the last less the first. Buckets are of all finite scores."""
    score = sc.finite(F.col("score"))
    rows = pairs.withColumn("bucket", cs.bucket(F.round(cs.rank(score, *by, "session"), 9), q)).where(F.col("bucket").isNotNull() & score.isNotNull() & sc.is_finite(F.col("forward_return")))
    means = [F.avg(F.when(F.col("bucket") == i, F.col("forward_return"))).alias(f"q{i}_mean") for i in range(1, q + 1)]
    return rows.groupBy(*by).agg(*means).withColumn("spread", F.col(f"q{q}_mean") - F.col("q1_mean"))


def top_turnover(scores: DataFrame, signals: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """Mean share of the previous signal's top set that left; sets are rows, compared by signal ordinal.

    A signal whose own set is empty has lost all of the one before; one whose previous set is empty doesn't count.
    """
    at = with_top(scores.join(F.broadcast(signals.select("session", "ordinal")), "session"), by, share)
    top = at.where("__top").select(*by, "ordinal", "security_id")
    then = top.select(*by, (F.col("ordinal") + 1).alias("ordinal"), "security_id")
    kept = then.join(top.withColumn("is", F.lit(1)), [*by, "ordinal", "security_id"], "left")
    there = at.select(*by, "ordinal").distinct()
    rates = kept.join(there, [*by, "ordinal"], "left_semi").groupBy(*by, "ordinal").agg((1 - F.count("is") / F.count("*")).alias("turnover"))
    return rates.groupBy(*by).agg(F.avg("turnover").alias("turnover"))


def with_top(scores: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    return scores.withColumn("__top", cs.in_top(sc.finite(F.col("score")), F.col("security_id"), share, *by, "session"))


def aligned(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with the label of the same session and security; an error where either side has a cell that the other lacks.

    Both cover the same sessions and securities (a missing value is a NULL in its cell), so a cell on one side only means
    that they were made from different grids. The check is part of the join.
    """
    factors = scores.select("factor_id").distinct().agg(F.sort_array(F.collect_set("factor_id")).alias("__all"))
    cells = labels.select("session", "security_id", "forward_return", F.lit(True).alias("__label")).join(F.broadcast(factors)).withColumn("factor_id", F.explode("__all")).drop("__all")
    both = scores.withColumn("__score", F.lit(True)).join(cells, ["factor_id", "session", "security_id"], "full_outer")
    where = F.concat_ws(" ", F.col("factor_id"), F.col("session").cast("string"), F.col("security_id").cast("string"))
    good = F.when(F.col("__label") & F.col("__score"), True).otherwise(F.raise_error(F.concat(F.lit("FACTOR_LABEL_ALIGNMENT_MISMATCH: "), where)).cast("boolean"))
    return both.where(good).drop("__label", "__score")


def _placed(rows: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Rows with n_all, n (with a value) and place, counted from the lowest value; a later window by the value alone needs no
    second sort."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"n_all": F.count("*").over(w), "n": F.count(x).over(w), "place": F.row_number().over(w.orderBy(F.asc_nulls_first(x), F.desc("security_id")))})


def _peers(x: str, by: list[str]) -> tuple:
    """Frames of the rows up to those of the same value, and of the same value."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first(x))
    return w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.currentRow)


def _in_top(x: str, share: float) -> Column:
    """Whether a placed row is among the highest ceil(share * n) values, one at least; ties to smaller ids."""
    return F.col(x).isNotNull() & (F.col("n_all") - F.col("place") < F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * share, 9))))


def _kernels():
    """Order, ranks and correlation of arrays; made in here, so that executors need not import this package."""
    def order(x):
        """Rows with a value, the highest first, ties in the order of rows."""
        there = np.flatnonzero(~np.isnan(x))
        return there[np.argsort(-x[there], kind="stable")]

    def ranks(x, at):
        """Ranks from 1 for the lowest, ties at their middle, of the rows ``at``, which are in order; NaN for other rows."""
        out, v = np.full(len(x), np.nan), x[at]
        if len(v):
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            n = np.diff(np.append(first, len(v)))
            out[at] = len(v) - np.repeat(first + (n - 1) / 2, n)
        return out

    def corr(x, y):
        spread = x.std() * y.std() if len(x) else 0.0
        return float(((x - x.mean()) * (y - y.mean())).mean() / spread) if spread > FLAT else None

    return order, ranks, corr


def _types(q: int, ids: str) -> str:
    told = ", ".join(f"sum_{i} double, count_{i} long" for i in range(1, q + 1))
    return f"factor_id string, factor_b string, session date, ic double, jaccard double, share double, n_top long, {told}, top array<{ids}>"


def _cross_section(share: float, q: int, factors: list[str] | None, pairs: bool):
    """Rows of one session: for each factor the correlation of ranks, coverage, sums of labels by bucket of all scores, and the top
    set; with ``pairs``, for each two factors what their ranks and top sets have in common. Each column is sorted once: rows that
    another column lacks are left out of its order.

    Without ``factors``, a group is one factor's session and its values are in ``score``.
    """
    order, ranks, corr = _kernels()

    def of(key, rows):
        by_id = pa.compute.sort_indices(rows.column("security_id"))
        ids = rows.column("security_id").combine_chunks().take(by_id)
        column = lambda c: rows.column(c).to_numpy()[by_id.to_numpy()]
        names = {"score": key[0].as_py()} if factors is None else {f: f for f in factors}
        y = column("label")
        y_order, y_there = order(y), ~np.isnan(y)
        x = {f: column(f) for f in names}
        there = {f: ~np.isnan(v) for f, v in x.items()}
        placed = {f: order(v) for f, v in x.items()}
        ranked = {f: ranks(x[f], placed[f]) for f in names}
        most = lambda n: min(n, max(1, int(np.ceil(round(n * share, 9)))))
        out, tops = [], []
        for f, name in names.items():
            n, both = len(placed[f]), placed[f][y_there[placed[f]]]
            a, b = ranks(x[f], both)[both], ranks(y, y_order[there[f][y_order]])[both]
            bucket, label = np.clip(np.ceil(np.round(ranked[f][both] / max(n, 1), 9) * q), 1, q), y[both]
            sums = {}
            for i in range(1, q + 1):
                mine = label[bucket == i]
                sums |= {f"sum_{i}": float(mine.sum()) if len(mine) else None, f"count_{i}": len(mine)}
            out.append({"factor_id": name, "ic": corr(a, b), "share": len(both) / len(y), "n_top": most(n)} | sums)
            tops.append(ids.take(pa.array(placed[f][: most(n)])))
        listed = sorted(names) if pairs else []
        for i, f in enumerate(listed):
            for g in listed[i + 1 :]:
                both = there[f] & there[g]
                if not both.any():
                    continue
                same = bool((there[f] == there[g]).all())
                at_f, at_g = (placed[h] if same else placed[h][both[placed[h]]] for h in (f, g))
                a, b = (ranked[h] if same else ranks(x[h], at) for h, at in ((f, at_f), (g, at_g)))
                k, top = most(len(at_f)), np.zeros(len(y), bool)
                top[at_f[:k]] = True
                shared = int(top[at_g[:k]].sum())
                out.append({"factor_id": names[f], "factor_b": names[g], "ic": corr(a[both], b[both]), "jaccard": shared / (2 * k - shared)})
        day = {"session": pa.array([key[-1].as_py()] * len(out), pa.date32())}
        kinds = {"factor_id": pa.string(), "factor_b": pa.string(), "ic": pa.float64(), "jaccard": pa.float64(), "share": pa.float64(), "n_top": pa.int64()}
        kinds |= {k: t for i in range(1, q + 1) for k, t in ((f"sum_{i}", pa.float64()), (f"count_{i}", pa.int64()))}
        told = {k: pa.array([o.get(k) for o in out], t) for k, t in kinds.items()}
        ends = np.cumsum([0, *map(len, tops), *[0] * (len(out) - len(tops))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(tops))
        names_of = ["factor_id", "factor_b", "session", "ic", "jaccard", "share", "n_top", *(c for i in range(1, q + 1) for c in (f"sum_{i}", f"count_{i}")), "top"]
        table = told | day | {"top": lists}
        return pa.table({c: table[c] for c in names_of})

    return of


def _without(rows: DataFrame, benchmark) -> DataFrame:
    if benchmark is None:
        return rows
    return rows.where(F.when(F.col("security_id") == benchmark, F.raise_error("BENCHMARK_IN_FACTOR_CROSS_SECTION").cast("boolean")).otherwise(True))


def cross_sections(wide: DataFrame, factors: list[str], parts: int, share: float = 0.1, q: int = 5, pairs: bool = False, benchmark=None) -> DataFrame:
    """Each session's part of ``diagnosed`` and, with ``pairs``, of ``redundant``, in one shuffle by session to ``parts`` tasks.

    ``wide`` has session, security_id, forward_return and a column for each factor: a row for each security, not one for each of
    its factors. One session, a row for each security, is one group. With ``pairs`` all two factors are compared, each in time
    that is linear in securities; more than a few dozen factors are better compared by ``redundancy`` after gates.
    """
    finite = [sc.finite(F.col(f)).alias(f) for f in factors]
    rows = _without(wide.select("session", "security_id", sc.finite(F.col("forward_return")).alias("label"), *finite), benchmark)
    ids = wide.schema["security_id"].dataType.simpleString()
    return rows.repartition(parts, "session").groupBy("session").applyInArrow(_cross_section(share, q, factors, pairs), _types(q, ids))


def redundant(sections: DataFrame) -> DataFrame:
    """The result of ``redundancy`` from ``cross_sections`` with pairs."""
    rows = sections.where("factor_b is not null").groupBy(F.col("factor_id").alias("factor_a"), "factor_b")
    return rows.agg(F.median(F.abs("ic")).alias("median_abs_ic"), F.avg("jaccard").alias("top_jaccard"))


def diagnose(pairs: DataFrame, share: float = 0.1, q: int = 5, whole: int = 26, partial: int = 13, benchmark=None) -> DataFrame:
    """One row for each factor from rows (factor_id, session, security_id, score, forward_return) at signal sessions.

    One shuffle: each (factor, session), a number for each security, is ranked in one group, which gives a row of aggregates and
    the ids of its top set, a tenth of the securities. Every security has a row at every signal. ``benchmark`` is a security that
    must not be among them. Factors that are columns of one panel are cheaper by ``cross_sections``.
    """
    by = ["factor_id", "session"]
    rows = _without(pairs.select(*by, "security_id", sc.finite(F.col("score")).alias("score"), sc.finite(F.col("forward_return")).alias("label")), benchmark)
    ids = pairs.schema["security_id"].dataType.simpleString()
    return diagnosed(rows.groupBy(*by).applyInArrow(_cross_section(share, q, None, False), _types(q, ids)), q, whole, partial)


def diagnosed(sections: DataFrame, q: int = 5, whole: int = 26, partial: int = 13) -> DataFrame:
    """One row for each factor: its sessions' top sets are met with those of the signal before, and the rows, a small table, are
    rolled up by year and by factor."""
    one = sections.where("factor_b is null").drop("factor_b", "jaccard")
    kept = F.array_intersect("top", F.lag("top").over(Window.partitionBy("factor_id").orderBy("session")))
    one = one.withColumn("n_kept", F.coalesce(F.size(kept), F.lit(0))).drop("top")

    factor, year = Window.partitionBy("factor_id"), Window.partitionBy("factor_id", "year")
    before = F.lag("n_top").over(factor.orderBy("session"))
    one = one.withColumn("year", F.year("session")).withColumns({
        "turnover": F.when(before > 0, 1 - F.col("n_kept") / before), "year_ic": F.avg("ic").over(year), "year_n": F.count("ic").over(year),
        "last_year": F.max(F.when(F.col("ic").isNotNull(), F.col("year"))).over(factor), "in_year": F.row_number().over(year.orderBy("session"))})
    used = (F.col("in_year") == 1) & ((F.col("year_n") >= whole) | ((F.col("year") == F.col("last_year")) & (F.col("year_n") >= partial)))
    means = [F.try_divide(F.sum(f"sum_{i}"), F.sum(f"count_{i}")).alias(f"q{i}_mean") for i in range(1, q + 1)]
    out = one.groupBy("factor_id").agg(
        F.count("ic").alias("n_sessions"), F.median("share").alias("median_coverage"), F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg(F.when(used, (F.col("year_ic") > 0).cast("double"))).alias("positive_year_ratio"), *means, F.avg("turnover").alias("turnover"))
    return out.withColumn("spread", F.col(f"q{q}_mean") - F.col("q1_mean"))


def _shares(factors: list[str]):
    order, ranks, corr = _kernels()

    def of(key, rows):
        y = rows.column("label").to_numpy()
        y_order, y_there, out, size = order(y), ~np.isnan(y), {}, len(y)
        for f in factors:
            x = rows.column(f).to_numpy()
            placed, there = order(x), ~np.isnan(x)
            both = placed[y_there[placed]]
            ic = corr(ranks(x, both)[both], ranks(y, y_order[there[y_order]])[both])
            out |= {f: pa.array(ranks(x, placed) / max(len(placed), 1), pa.float64(), from_pandas=True), f"ic_{f}": pa.array([ic] * size, pa.float64()), f"n_{f}": pa.array([len(both)] * size, pa.int64())}
        rest = {c: rows.column(c) for c in rows.column_names if c not in factors and c != "label"}
        return pa.table(rest | out)

    return of


def rank_shares(wide: DataFrame, factors: list[str], parts: int) -> DataFrame:
    """Rows of a panel with each factor's rank share within its session in place of its value, and the session's rank correlation
    with forward_return (ic_...) over n_... rows, beside each row.

    One shuffle by session, to ``parts`` tasks. One session, a row for each security, is one group.
    """
    rest = [c for c in wide.columns if c not in factors]
    told = [f"{c} {wide.schema[c].dataType.simpleString()}" for c in rest] + [f"{f} double, ic_{f} double, n_{f} long" for f in factors]
    rows = wide.select(*rest, sc.finite(F.col("forward_return")).alias("label"), *(sc.finite(F.col(f)).alias(f) for f in factors))
    return rows.repartition(parts, "session").groupBy("session").applyInArrow(_shares(factors), ", ".join(told))


def redundancy(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """For each pair of factors: median absolute Spearman correlation over sessions and mean Jaccard of top sets.

    Ranks and top sets of a pair are those of the rows where both factors have a value. Factors are ranked once by themselves.
    Where two of them have values for the same securities of a session, their own ranks serve, and pairs are only added up,
    with partial sums before the shuffle; the rest is ranked anew pair by pair. Each (session, security) gathers its scores
    once, as many as there are factors.
    """
    alone = ["factor_id", "session"]
    rows = _ranked(scores.where(sc.is_finite(F.col("score"))).select(*alone, "security_id", "score"), "score", alone, "x", "top", share)
    # who has a value: the sum of hashes of the securities
    rows = rows.withColumn("who", F.sum(F.xxhash64("security_id").cast("decimal(20,0)")).over(Window.partitionBy(*alone)))
    rows = rows.groupBy("session", "security_id").agg(F.sort_array(F.collect_list(F.struct("factor_id", "score", "x", "top", "who"))).alias("v"))

    def pairs(same: bool) -> DataFrame:
        def later(x: Column, i: Column) -> Column:
            rest = F.filter(F.slice("v", i + 2, F.size("v")), lambda y: (y["who"] == x["who"]) if same else (y["who"] != x["who"]))
            return F.transform(rest, lambda y: F.struct(x["factor_id"].alias("factor_a"), y["factor_id"].alias("factor_b"), *(z[c].alias(f"{c}_{k}") for k, z in (("a", x), ("b", y)) for c in (("x", "top") if same else ("score",)))))

        return rows.select("session", "security_id", F.explode(F.flatten(F.transform("v", later))).alias("p")).select("session", "security_id", "p.*")

    by = ["factor_a", "factor_b", "session"]
    met = pairs(False)
    for side in "ab":
        met = _ranked(met, f"score_{side}", by, f"x_{side}", f"top_{side}", share)
    summed = [p.groupBy(*by).agg(guarded_corr(F.col("x_a"), F.col("x_b")).alias("ic"), (F.count_if(F.col("top_a") & F.col("top_b")) / F.count_if(F.col("top_a") | F.col("top_b"))).alias("jaccard")) for p in (pairs(True), met)]
    return summed[0].unionByName(summed[1]).groupBy("factor_a", "factor_b").agg(F.median(F.abs("ic")).alias("median_abs_ic"), F.avg("jaccard").alias("top_jaccard"))


def _ranked(rows: DataFrame, value: str, by: list[str], rank: str, top: str, share: float) -> DataFrame:
    """Rows with the rank of a value within ``by``, ties at their middle, and whether it is in the top."""
    placed = _placed(rows, value, by)
    upto, same = _peers(value, by)
    return placed.withColumns({rank: F.count("*").over(upto) - (F.count("*").over(same) - 1) / 2, top: _in_top(value, share)}).select(*rows.columns, rank, top)


def rank_autocorrelation(scores: DataFrame, signals: DataFrame) -> DataFrame:
    """Per signal, the correlation of ranks with those of the signal before, by factor."""
    rows = scores.join(F.broadcast(signals.select("session", "ordinal")), "session").withColumn("r", cs.average_rank(F.col("score"), "factor_id", "session"))
    then = rows.select("factor_id", "security_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("r").alias("was"))
    both = rows.join(then, ["factor_id", "security_id", "ordinal"]).where("r is not null and was is not null")
    return both.groupBy("factor_id", "session").agg(guarded_corr(F.col("r"), F.col("was")).alias("autocorrelation"))


def bucket_turnover(buckets: DataFrame) -> DataFrame:
    """Share of each bucket's names that were not in it at the ordinal before; (factor_id, bucket, ordinal, turnover)."""
    then = buckets.select("factor_id", "bucket", (F.col("ordinal") + 1).alias("ordinal"), "security_id", F.lit(1).alias("was"))
    rows = buckets.join(then, ["factor_id", "bucket", "ordinal", "security_id"], "left")
    first = F.min("ordinal").over(Window.partitionBy("factor_id"))
    return rows.withColumn("first", first).where("ordinal > first").groupBy("factor_id", "bucket", "ordinal").agg((1 - F.count("was") / F.count("*")).alias("turnover"))


def nav_metrics(nav: DataFrame, by: list[str]) -> DataFrame:
    """Total return, yearly growth, volatility, Sharpe ratio at no rate, and the deepest fall of (by..., session, nav)."""
    w = Window.partitionBy(*by).orderBy("session")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = nav.withColumn("r", F.coalesce(F.try_divide("nav", F.lag("nav").over(w)) - 1, F.lit(0.0))).withColumn("fall", F.col("nav") / F.max("nav").over(upto) - 1)
    out = rows.groupBy(*by).agg((F.try_divide(F.max_by("nav", "session"), F.min_by("nav", "session")) - 1).alias("total_return"), F.stddev_samp("r").alias("dev"), F.avg("r").alias("mean"), F.count("*").alias("n"), F.min("fall").alias("max_drawdown"))
    return out.select(*by, "total_return", (F.pow(1 + F.col("total_return"), 252.0 / F.col("n")) - 1).alias("cagr"), (F.col("dev") * 252**0.5).alias("volatility"), F.try_divide(F.col("mean") * 252, F.col("dev") * 252**0.5).alias("sharpe"), "max_drawdown")


def pooled_conflicts(scored: DataFrame) -> DataFrame:
    """Of each two factors (factor_a, factor_b, pooled, overlap): Spearman over all rows, mean share of the first's top set.

    ``scored`` is ``with_top`` in long form, rows with a score only. Sessions in which one of the two has no top set don't
    count; the sets are met on (session, security), not pair by pair.
    """
    side = lambda x: scored.select("session", "security_id", F.col("factor_id").alias(f"factor_{x}"), F.col("score").alias(x), F.col("__top").alias(f"top_{x}"))
    both = side("a").join(side("b"), ["session", "security_id"]).where("factor_a < factor_b")
    pooled = pooled_rank_corr(both, "a", "b", "factor_a", "factor_b")
    hits = both.groupBy("factor_a", "factor_b", "session").agg(F.count_if(F.col("top_a") & F.col("top_b")).alias("hits"))
    n = scored.where("__top").groupBy("factor_id", "session").agg(F.count("*").alias("n"))
    sizes = n.select(F.col("factor_id").alias("factor_a"), "session", "n").join(n.select(F.col("factor_id").alias("factor_b"), "session"), "session").where("factor_a < factor_b")
    shared = sizes.join(hits, ["factor_a", "factor_b", "session"], "left").groupBy("factor_a", "factor_b").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("overlap"))
    return pooled.join(shared, ["factor_a", "factor_b"], "left")
