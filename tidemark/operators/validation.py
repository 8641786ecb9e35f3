"""Statistics that try to refute a result: bootstrap, deflation, discovery rate, sensitivity, costs, gates, verdict."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept as written
from .factors import HOME

#: Fixed value: Euler's constant.
EULER = 0.5772156649015329


def normal_cdf(z: float) -> float:
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def normal_ppf(p: float) -> float:
    """Inverse by the rational approximation 26.2.23 of Abramowitz and Stegun; its published coefficients are fixed values."""
    if p == 0.5:
        return 0.0
    if p <= 0 or p >= 1:
        return math.copysign(8.0, p - 0.5)
    t = math.sqrt(-2.0 * math.log(min(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return x if p > 0.5 else -x


def expected_max_sharpe(trials: int, variance: float = 0.25) -> float:
    """Expected greatest of `trials` ratios that have no edge."""
    if trials <= 1:
        return 0.0
    return ((1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * math.e))) * math.sqrt(variance)


def deflated_sharpe(sharpe: float, trials: int, variance: float = 0.25, skew: float = 0.0, kurtosis: float = 3.0, n: int = 252) -> float:
    """Probability that a ratio is above what the best of so many trials would show by chance."""
    if n < 5 or trials < 1:
        return 0.5
    spread = math.sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-6) / (n - 1))
    return normal_cdf((sharpe - expected_max_sharpe(trials, variance)) / spread) if spread > 1e-8 else normal_cdf(0.0)


def bootstrap_sharpe(returns: DataFrame, simulations: int = 1000, block: int = 21, seed: int = 42, key: str = "id") -> DataFrame:
    """(key, sim, sharpe) of stationary block resamples of return series (key, session, ret), all series at once.

    A resample is as long as its series. At each place a new block begins with a chance of 1 in `block`, at a place of the series
    drawn anew, and runs on around its end; both draws are hashes of series, simulation and place, so that every run and
    engine draws alike. Sums and squares of a block are differences of running sums, which a series holds as two arrays as long
    as itself: series are shuffled once, places and blocks never. Series of under 5 returns have their mean a year; one without
    spread has 0.
    """
    r = returns.filter("ret IS NOT NULL").select(key, "session", "ret")
    upto = Window.partitionBy(key).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    ends = r.select(key, "session", "ret", F.sum("ret").over(upto).alias("s"), F.sum(F.col("ret") * F.col("ret")).over(upto).alias("q"))
    series = ends.groupBy(key).agg(F.count("*").cast("int").alias("n"), F.avg("ret").alias("mean"), F.array_sort(F.collect_list(F.struct("session", "s", "q"))).alias("__e"))
    upto = lambda c: F.concat(F.array(F.lit(0.0)), F.col(f"__e.{c}")).alias(f"__{c}")
    sims = series.select(key, "n", "mean").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    places = sims.filter("n >= 5").select(key, "sim", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    bound = math.ceil(2**32 / block - 0.5)  # hashes under it in hex are numbers under 1 / block, and needn't be read from their digits
    starts = places.filter((F.col("t") == 0) | (_digest(key, "sim", "t", seed=seed) < F.lit(f"{bound:08x}" if bound < 2**32 else "g")))
    after = F.lead("t").over(Window.partitionBy(key, "sim").orderBy("t"))
    first = F.floor(uniform(key, "sim", "t", seed=seed + 1) * F.col("n"))
    blocks = starts.select(key, "sim", "n", first.cast("int").alias("k"), (F.coalesce(after, F.col("n")) - F.col("t")).alias("long"))
    end = "k + long"
    total = lambda c: F.sum(F.expr(f"CASE WHEN {end} <= n THEN get({c}, {end}) ELSE get({c}, n) + get({c}, {end} - n) END - get({c}, k)"))
    # all by the same key: nothing more is shuffled
    g = blocks.join(series.select(key, upto("s"), upto("q")), key).groupBy(key, "sim").agg(F.max("n").alias("n"), total("__s").alias("s"), total("__q").alias("q"))
    sd = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    long = g.select(key, "sim", F.when(sd > 1e-8, F.col("s") / F.col("n") / sd * math.sqrt(252)).otherwise(0.0).alias("sharpe"))
    return long.unionByName(sims.filter("n < 5").select(key, "sim", (F.col("mean") * math.sqrt(252)).alias("sharpe")))


def bootstrap_interval(sims: DataFrame, level: float = 0.95, key: str = "id") -> DataFrame:
    """(key, n, mean, error, low, high): spread and positional interval of the simulations of each series."""
    w = Window.partitionBy(key)
    s = sims.withColumns({"pos": F.row_number().over(w.orderBy("sharpe", "sim")) - 1, "n": F.count("*").over(w)})
    a = (1 - level) / 2
    at = lambda q: F.max(F.when(F.col("pos") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col("sharpe")))
    return s.groupBy(key).agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("error"), at(a).alias("low"), at(1 - a).alias("high"))


def discoveries(tests: DataFrame, alpha: float = 0.05, keys: tuple = ()) -> DataFrame:
    """tests (id, p) with rank and significant: Benjamini-Hochberg step-up; ties in order of id."""
    w = Window.partitionBy(*keys)
    t = tests.withColumns({"rank": F.row_number().over(w.orderBy("p", "id")), "__m": F.count("*").over(w)})
    top = F.max(F.when(F.col("p") <= F.col("rank") / F.col("__m") * alpha, F.col("rank"))).over(w)
    return t.withColumn("significant", F.coalesce(F.col("rank") <= top, F.lit(False))).drop("__m")


def topology(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, pos, sharpe) to the shape of each surface: SPIKE, PLATEAU, MONOTONIC or FRAGILE."""
    d = F.col("sharpe") - F.lag("sharpe").over(Window.partitionBy(*keys).orderBy("pos"))
    g = cells.withColumn("d", d).groupBy(*keys).agg(F.count("*").alias("n"), F.max("sharpe").alias("hi"), F.min("sharpe").alias("lo"), F.avg("sharpe").alias("mid"), F.min("d").alias("dn"), F.max("d").alias("up"))
    gap = F.col("hi") - F.col("lo")
    shape = F.when(F.col("n") < 2, "PLATEAU").when((F.col("hi") > 1.5 * F.col("mid")) & (gap > 0.75), "SPIKE").when(gap < 0.35, "PLATEAU").when((F.col("dn") >= 0) | (F.col("up") <= 0), "MONOTONIC").otherwise("FRAGILE")
    return g.select(*keys, "n", shape.alias("topology"))


def cost_stress(strategies: DataFrame, grid: tuple = (0.0, 5.0, 10.0, 20.0, 50.0, 100.0)) -> DataFrame:
    """strategies (id, cagr, turnover, vol) with, for each cost in basis points, net CAGR and ratio, and the break-even cost."""
    vol = F.when(F.col("vol") > 1e-6, F.col("vol")).otherwise(0.15)
    even = F.when(F.col("cagr") <= 0, 0.0).when(F.col("turnover") > 1e-4, F.least(F.lit(1000.0), F.try_divide(F.col("cagr"), F.col("turnover") * 2) * 1e4)).otherwise(1000.0)
    s = strategies.withColumns({"break_even": F.round(even, 1), "fragile": even < 10}).withColumn("bps", F.explode(F.array(*[F.lit(x) for x in grid])))
    net = F.col("cagr") - F.col("turnover") * F.col("bps") / 1e4 * 2
    return s.select("id", "bps", F.round(net, 4).alias("net_cagr"), F.round(net / vol, 2).alias("sharpe"), "break_even", "fragile")


def verdict(cases: DataFrame) -> DataFrame:
    """cases (id, gates_ok, cost_fragile, concentrated, warned, eligible) with a verdict."""
    v = F.when(~F.col("gates_ok"), "REJECTED").when(F.col("cost_fragile") | F.col("concentrated") | F.col("warned"), "RESEARCH_ONLY").when(F.col("eligible"), "PAPER_CANDIDATE").otherwise("VALIDATED")
    return cases.withColumn("verdict", v)


def empirical_p(observed: DataFrame, draws: DataFrame, value: str = "mean") -> DataFrame:
    """observed (observed), a row a question, with draws, their number, and p: (those at least as great + 1) / (draws + 1)."""
    j = observed.join(F.broadcast(draws.select(F.col(value).alias("__v"), F.lit(1).alias("__d"))), F.lit(True), "left")  # a row a draw
    return j.groupBy(*observed.columns).agg(F.count("__d").alias("draws"), ((F.count(F.when(F.col("__v") >= F.col("observed"), 1)) + 1) / (F.count("__d") + 1)).alias("p"))


def gates(candidates: DataFrame) -> DataFrame:
    """candidates (id, code, config, lookahead, corrupt, irreproducible) to (id, gate, passed), one row for each hard gate."""
    ok = F.array(
        F.struct(F.lit("AUTHORITY").alias("gate"), (F.coalesce(F.length("code"), F.lit(0)) * F.coalesce(F.length("config"), F.lit(0)) > 0).alias("passed")), F.struct(F.lit("LOOKAHEAD").alias("gate"), (~F.col("lookahead")).alias("passed")),
        F.struct(F.lit("INTEGRITY").alias("gate"), (~F.col("corrupt")).alias("passed")), F.struct(F.lit("REPRODUCIBILITY").alias("gate"), (~F.col("irreproducible")).alias("passed")),
    )
    return candidates.select("id", F.explode(ok).alias("g")).select("id", "g.gate", "g.passed")


def trial_ledger(trials: DataFrame) -> DataFrame:
    """trials (spec, sharpe, at): each spec once, as first tried, with its hash and number."""
    t = trials.withColumn("spec_hash", F.sha2(F.col("spec").cast("binary"), 256))
    first = t.withColumn("__r", F.row_number().over(Window.partitionBy("spec_hash").orderBy("at"))).filter("__r = 1").drop("__r")
    return first.withColumn("trial", F.row_number().over(Window.orderBy("at", "spec_hash")))  # a few thousand rows at most: people run trials


def _digest(*cols, seed: int):
    return F.md5(F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed))).cast("binary"))


def uniform(*cols, seed: int = 42):
    """A number above 0 and under 1 from the md5 of columns and a seed: the same on every run and engine."""
    return (F.conv(F.substring(_digest(*cols, seed=seed), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def noise_factor(at: DataFrame, seed: int = 42) -> DataFrame:
    """(session, inst, value): standard normal noise as a factor, the control that must show nothing."""
    u, v = uniform("session", "inst", seed=seed), uniform("session", "inst", seed=seed + 1)
    return at.select("session", "inst", (F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)).alias("value"))


def shuffled_ic(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(session, rank_ic) after each section's returns are dealt anew; sections of under 5 names have 0."""
    from .evaluation import ic_series
    from .learning import shuffled_labels

    dealt = shuffled_labels(pairs.select("session", "inst", "value", F.col("ret").alias("label")), seed)
    c = ic_series(dealt.withColumnRenamed("label", "ret"), ("session",))
    return c.select("session", F.when(F.col("n") < 5, 0.0).otherwise(F.coalesce("rank_ic", F.lit(0.0))).alias("rank_ic"))


def ablation(results: DataFrame, baseline: str = "all") -> DataFrame:
    """results (omitted, sharpe, cagr), one row `baseline` among them, to (omitted, sharpe, cagr, marginal): what each part adds."""
    base = F.max(F.when(F.col("omitted") == baseline, F.col("sharpe"))).over(Window.partitionBy())  # a row a part of the study
    return results.withColumn("marginal", F.round(base - F.col("sharpe"), 4)).filter(F.col("omitted") != baseline)


def freeze(candidates: DataFrame, strategy: str, config: list[str]) -> DataFrame:
    """candidates with config_hash, the sha256 of its configuration as JSON in order of names, and candidate_id."""
    value = lambda c: F.col(c).cast("string") if dict(candidates.dtypes)[c] != "string" else F.concat(F.lit('"'), F.col(c), F.lit('"'))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(config)]), F.lit("}"))
    h = F.sha2(body.cast("binary"), 256)
    return candidates.withColumns({"config_hash": h, "candidate_id": F.concat_ws("-", F.lit("CAND"), strategy, F.substring(h, 1, 10))})


def first_access(log: DataFrame) -> DataFrame:
    """log (candidate, part, actor, at): a holdout opens once a candidate and part; later accesses return the first, with their number."""
    return log.groupBy("candidate", "part").agg(F.min_by("actor", F.struct("at", "actor")).alias("actor"), F.min("at").alias("at"), F.count("*").alias("asked"))


def trial_diagnostics(moments: DataFrame, trials: DataFrame, per_year: float = 252.0) -> DataFrame:
    """moments (id, n, mean, sd, skew, kurtosis) of return series against the spread of all trials (sharpe, a year's).

    (id, trials, variance, sharpe, sharpe_annual, skew, excess, expected_max, score, significant, warned): score is the deflated
    ratio before the normal distribution is taken; a result is warned from 50 trials on, or from 6 on if it isn't significant.
    """
    t = trials.agg(F.count("*").alias("trials"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v"))
    m = moments.crossJoin(F.broadcast(t)).withColumn("variance", F.when((F.col("trials") < 2) | (F.col("v") < 1e-4), 0.25).otherwise(F.col("v")))

    def ppf(p):
        q = F.sqrt(-2.0 * F.log(F.least(p, 1 - p)))
        x = q - (2.515517 + 0.802853 * q + 0.010328 * q * q) / (1 + 1.432788 * q + 0.189269 * q * q + 0.001308 * q * q * q)
        return F.when(p > 0.5, x).otherwise(-x)

    n = F.greatest(F.lit(1), F.col("trials"))
    m = m.withColumn("expected_max", F.when(n <= 1, 0.0).otherwise(((1 - EULER) * ppf(1 - 1 / n) + EULER * ppf(1 - 1 / (n * math.e))) * F.sqrt("variance")))
    sr = F.when(F.col("sd") > 1e-12, F.try_divide("mean", "sd")).otherwise(0.0)
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr, F.lit(1e-6)) / (F.col("n") - 1))
    score = F.when(F.col("n") < 5, 0.0).otherwise((sr - F.col("expected_max")) / spread)
    m = m.withColumns({"sharpe": sr, "score": score})
    significant = F.col("score") >= 1.6448536269514722
    return m.select("id", "trials", "variance", "sharpe", (F.col("sharpe") * math.sqrt(per_year)).alias("sharpe_annual"), "skew", (F.col("kurtosis") - 3.0).alias("excess"), "expected_max", "score", significant.alias("significant"), ((F.col("trials") >= 50) | (F.col("trials") > 5) & ~significant).alias("warned"))


def evaluate(cases: DataFrame, eligible: bool = True, evidence: tuple[DataFrame, ...] = ()) -> DataFrame:
    """cases (id, code, config, lookahead, corrupt, irreproducible, cagr, turnover, hhi, top_sector, warned) to verdict and reasons, with
    the columns of each table of evidence (id, ...) beside: what the verdict was reached with, and what a reader should see."""
    failed = gates(cases).groupBy("id").agg(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed"))
    even = F.when(F.col("cagr") <= 0, 0.0).when(F.col("turnover") > 1e-4, F.least(F.lit(1000.0), F.try_divide(F.col("cagr"), F.col("turnover") * 2) * 1e4)).otherwise(1000.0)
    c = cases.join(failed, "id").withColumns({"gates_ok": F.size("failed") == 0, "cost_fragile": even < 10, "concentrated": (F.col("hhi") > 0.15) | (F.col("top_sector") > 0.40), "eligible": F.lit(eligible)})
    soft = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in ("cost_fragile", "concentrated", "warned")]))
    out = verdict(c).select("id", "verdict", F.when(F.size("failed") > 0, F.col("failed")).otherwise(soft).alias("reasons"))
    for table in evidence:
        out = out.join(table, "id", "left")
    return out


def holding_surface(returns: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), key: str = "id") -> DataFrame:
    """(key, n, topology) of each series' ratio by how long returns are held: (key, session, equity) laid over itself by so many sessions."""
    own = Window.partitionBy(key).orderBy("session")
    held = returns.select(key, *[F.try_divide(F.col("equity"), F.lag("equity", h).over(own)).alias(f"h{h}") for h in horizons])
    ratio = lambda h: F.coalesce(F.try_divide(F.avg(F.col(f"h{h}") - 1), F.stddev_samp(F.col(f"h{h}") - 1)), F.lit(0.0)) * math.sqrt(252.0 / h)
    cells = held.groupBy(key).agg(F.array(*[F.struct(F.lit(k).alias("pos"), ratio(h).alias("sharpe")) for k, h in enumerate(horizons)]).alias("cells"))
    return topology(cells.select(key, F.inline("cells")), [key])


def without_each(values: DataFrame, part: str, value: str = "close") -> DataFrame:
    """(omitted, session, equity) of values (session, part, value): the mean of each session without each part, and of all as 'all'.

    Sums by session and part are taken once; a mean without a part is the total less its own, so that no value is copied.
    """
    own = values.groupBy("session", F.col(part).alias("omitted")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = own.groupBy("session").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    grid = total.join(F.broadcast(own.select("omitted").distinct()), F.lit(True))  # a row a session and part; parts are few
    left = grid.join(own, ["session", "omitted"], "left").select("omitted", "session", (F.col("all_s") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"))
    left = left.unionByName(total.select(F.lit("all").alias("omitted"), "session", F.col("all_s").alias("s"), F.col("all_n").alias("n")))
    return left.filter("n > 0").select("omitted", "session", (F.col("s") / F.col("n")).alias("equity"))




#: More days than dates have, so that a number and a day make one number; copies of bars that a task is to hold.
DAYS, COPIES = 4_000_000, 2_000_000


def lookahead(make, bars: DataFrame, at: DataFrame, reach: int = 450) -> DataFrame:
    """(session, names, leaked): names whose factor value changes when bars from the session on are hidden, by section.

    make is a factor (bars, at) that looks back at most `reach` days. It runs twice: on all bars, and on a copy of the bars before
    each section, under instruments of their own, so that all sections are one plan; a bar is copied to the sections within
    reach, by a join of its day. A copy's inst is a whole number, since copies are many and numbers are cheaper to deal
    and sort than names: names are numbered (a row a name), and the section's day is added.

    Bars are dealt to tasks by name before they are copied, and copies bear that home (factors.own): a factor that groups by
    it beside inst has all of a copy in one task, so that only bars are moved and no copy is. A factor that groups by inst alone has
    the same values and moves every copy. Copies are counted first, so that a task holds a bounded number of them. They are laid out
    from arrays of a name's bars in order, each of `reach` days, section by section: a section meets two of these, and what is
    nearly in order is sorted soon.
    """
    sections = at.select(F.col("session").alias("__cutoff")).distinct()
    reached = lambda day: (F.col("__cutoff") > F.col(day)) & (F.col("__cutoff") <= F.date_add(day, reach))
    days = bars.groupBy(F.col("session").alias("__day")).agg(F.count("*").alias("n"))
    copied = days.join(F.broadcast(sections), reached("__day")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # rows are days on either side
    tasks = max(bars.sparkSession.sparkContext.defaultParallelism, copied // COPIES + 1)
    names = bars.select("inst").union(at.select("inst")).distinct().select(F.col("inst").alias("__name"), F.row_number().over(Window.orderBy("inst")).cast("long").alias("__no"))
    names = written(names, "names")  # of known size: while they are few, no bar is moved to be numbered
    numbered = lambda df: df.join(names, F.col("inst").eqNullSafe(F.col("__name"))).drop("__name")
    copy = lambda day: (F.col("__no") * DAYS + F.unix_date(day)).alias("inst")
    dealt = lambda df: numbered(df).repartition(tasks, "__no")
    kept = [c for c in bars.columns if c != "inst"]
    block = lambda day: F.floor(F.unix_date(day) / reach)
    spans = sections.select("__cutoff", F.explode(F.array_distinct(F.array(block(F.date_sub("__cutoff", reach)), block(F.date_sub("__cutoff", 1))))).alias("__block"))
    whole = dealt(bars).withColumn("__block", block("session")).sortWithinPartitions("__no", "session").groupBy("__no", "__block").agg(F.collect_list(F.struct(*kept)).alias("__bars"))
    laid = whole.join(F.broadcast(spans), "__block").select("__no", "__cutoff", F.inline("__bars")).filter(reached("session"))
    copies = laid.select(copy("__cutoff"), F.col("__no").alias(HOME), *kept)
    points = dealt(at).select("session", copy("session"), F.col("__no").alias(HOME))
    hidden = make(copies, points).select(F.col("inst").alias("copy"), F.col("value").alias("hidden"))
    j = numbered(make(bars, at).select("session", "inst", "value")).select("session", "value", copy("session").alias("copy")).join(hidden, "copy", "left")
    return j.groupBy("session").agg(F.count("*").alias("names"), F.count(F.when(~F.col("value").eqNullSafe(F.col("hidden")), 1)).alias("leaked"))


#: Figures of the three scenarios, each named by what it hides.
SCENARIOS = {"lookahead": {"cagr": 2.5, "turnover": 3.0}, "random_mining": {"cagr": 0.13, "turnover": 4.0}, "cost_illusion": {"cagr": 0.03, "turnover": 25.0}}
TRIALS, NOISE_MEAN, NOISE_SD, TRIAL_SD = 100, 0.0005, 0.01, 0.75


def red_team(sessions: DataFrame, leaks: DataFrame, seed: int = 42) -> DataFrame:
    """Cases for evaluate that a sound verdict must see through: a leak with splendid returns, the best of a hundred noises, an edge
    eaten by costs.

    sessions (session) is the calendar that the noise is drawn on; leaks (leaked) is what lookahead found of the canary. Each
    noise is a series of its own; the best is judged against the ratios of all trials, as drawn.
    """
    from .performance import moments

    z = lambda *key: F.sqrt(-2.0 * F.log(uniform(*key, seed=seed))) * F.cos(2 * math.pi * uniform(*key, seed=seed + 1))
    drawn = sessions.select("session", F.explode(F.sequence(F.lit(1), F.lit(TRIALS))).alias("trial"))
    series = moments(drawn.select(F.col("trial").cast("string").alias("inst"), (F.lit(NOISE_MEAN) + NOISE_SD * z("trial", "session")).alias("ret")), "ret", "inst").withColumnRenamed("inst", "id")
    ratio = F.when(F.col("sd") > 1e-12, F.try_divide("mean", "sd")).otherwise(0.0)
    trials = series.select((TRIAL_SD * z("id")).alias("sharpe"))
    best = series.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(ratio), "id"))).filter("__r = 1").drop("__r")  # a row a trial
    mined = trial_diagnostics(best, trials).select(F.lit("random_mining").alias("id"), "warned")
    leaked = leaks.agg(F.coalesce(F.sum("leaked"), F.lit(0)).alias("n")).select(F.lit("lookahead").alias("id"), (F.col("n") > 0).alias("lookahead"))
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit("c").alias("code"), F.lit("f").alias("config"), F.lit(v["cagr"]).alias("cagr"), F.lit(v["turnover"]).alias("turnover"), F.lit(0.04).alias("hhi"), F.lit(0.25).alias("top_sector")) for i, v in SCENARIOS.items()])
    cases = sessions.sparkSession.range(0, 1, 1, 1).select(F.inline(rows)).join(leaked, "id", "left").join(mined, "id", "left")
    return cases.fillna(False, ["lookahead", "warned"]).withColumns({"corrupt": F.lit(False), "irreproducible": F.lit(False)})
