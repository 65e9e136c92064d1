"""Reaction networks: reaction graphs, chemical similarity, flux weights, weighted pathways, flux balance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cofactors left out of metabolite graphs by default.
CURRENCY = ("atp", "adp", "amp", "nad", "nadh", "nadp", "nadph", "h", "h2o", "pi", "ppi", "coa", "co2", "o2", "nh4", "fad", "fadh2", "gtp", "gdp", "utp", "udp", "ctp", "cdp", "q8", "q8h2", "h2o2")


def stoichiometry(models: DataFrame) -> DataFrame:
    """(rxn, met, coeff, lb, ub) from models with ``reactions: array<struct<id, lower_bound, upper_bound, metabolites: map>>``."""
    r = models.select(F.explode("reactions").alias("r"))
    return r.select(F.col("r.id").alias("rxn"), F.col("r.lower_bound").cast("double").alias("lb"), F.col("r.upper_bound").cast("double").alias("ub"), F.explode("r.metabolites").alias("met", "coeff")).select("rxn", "met", F.col("coeff").cast("double").alias("coeff"), "lb", "ub")


def base_name(met: Column) -> Column:
    """A metabolite id without its compartment suffix."""
    return F.regexp_replace(met, "_[a-z0-9]+$", "")


def reaction_graph(stoich: DataFrame, compartments: tuple[str, ...] = ("c",), keep_currency: bool = False) -> DataFrame:
    """(src, dst) distinct: substrate to product of each reaction, and back where its lower bound is negative."""
    s = stoich.filter(F.regexp_extract("met", "_([a-z0-9]+)$", 1).isin(*compartments))
    if not keep_currency:
        s = s.filter(~base_name(F.col("met")).isin(*CURRENCY))
    a = s.filter("coeff < 0").select("rxn", "lb", F.col("met").alias("a"))
    b = s.filter("coeff > 0").select("rxn", F.col("met").alias("b"))
    x = a.join(b, "rxn").filter("a <> b")
    return x.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(x.filter("lb < 0").select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def parsed_formula(formula: Column) -> Column:
    """map<element, count> of a chemical formula without brackets; a missing count is 1."""
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    one = lambda p: F.struct(F.regexp_extract(p, "^([A-Z][a-z]?)", 1).alias("key"), F.coalesce(F.expr("null").cast("int"), F.when(F.regexp_extract(p, "([0-9]+)$", 1) != "", F.regexp_extract(p, "([0-9]+)$", 1).cast("int")).otherwise(1)).alias("value"))
    return F.map_from_entries(F.transform(parts, one))


def atom_similarity(a: Column, b: Column, skip: tuple[str, ...] = ("H",)) -> Column:
    """Shared atoms over the larger's atoms, hydrogen left aside: sum of minima over maximum of sums."""
    keys = F.array_except(F.array_union(F.map_keys(a), F.map_keys(b)), F.array(*[F.lit(s) for s in skip]))
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    total = lambda f: F.aggregate(keys, F.lit(0).cast("long"), lambda s, k: s + f(k))
    most = F.greatest(total(lambda k: of(a, k)), total(lambda k: of(b, k)))
    return F.when(most > 0, total(lambda k: F.least(of(a, k), of(b, k))) / most).otherwise(0.0)


def similarity_weights(edges: DataFrame, formulas: DataFrame, floor: float = 0.01) -> DataFrame:
    """(src, dst, w): atom similarity of the ends, at least ``floor``; ``formulas(met, formula)``."""
    f = formulas.select("met", parsed_formula(F.col("formula")).alias("atoms"))
    x = edges.join(f.select(F.col("met").alias("src"), F.col("atoms").alias("fa")), "src", "left").join(f.select(F.col("met").alias("dst"), F.col("atoms").alias("fb")), "dst", "left")
    return x.select("src", "dst", F.greatest(F.coalesce(atom_similarity(F.col("fa"), F.col("fb")), F.lit(floor)), F.lit(floor)).alias("w"))


def flux_weights(stoich: DataFrame, flux: DataFrame, transform: str = "abs", epsilon: float = 1e-3) -> DataFrame:
    """(src, dst, w): a reaction's flux on its substrate-product pairs, largest over reactions.

    Forward edges take the transformed flux (abs, log or sqrt), reverse edges the plain
    absolute flux, never less than ``epsilon``.
    """
    s = stoich.join(flux.select("rxn", F.abs("flux").alias("v")), "rxn", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    shape = {"abs": F.col("v"), "log": F.log1p("v"), "sqrt": F.sqrt("v")}[transform]
    a, b = s.filter("coeff < 0").select("rxn", "lb", "v", F.col("met").alias("a")), s.filter("coeff > 0").select("rxn", F.col("met").alias("b"))
    x = a.join(b, "rxn").filter("a <> b")
    f = x.select(F.col("a").alias("src"), F.col("b").alias("dst"), shape.alias("w")).unionByName(x.filter("lb < 0").select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("v").alias("w")))
    return f.groupBy("src", "dst").agg(F.greatest(F.max("w"), F.lit(epsilon)).alias("w"))


def degree_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w): connectivity weights (in + out degree of the target): hubs cost more."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("d"))
    return edges.join(d.withColumnRenamed("id", "dst"), "dst").select("src", "dst", F.col("d").alias("w"))


def lightest_paths(edges: DataFrame, source: str, max_rounds: int = 50) -> DataFrame:
    """(id, cost, path): Bellman-Ford rounds over ``edges(src, dst, w)``, w >= 0; ties take the smaller path."""
    from .runtime import saved, work_dir

    spark = edges.sparkSession
    folder = work_dir(spark, "light")
    now = saved(spark.createDataFrame([(source, 0.0, [source])], "id string, cost double, path array<string>"), f"{folder}/0")
    for k in range(1, max_rounds):
        new = now.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        best = now.unionByName(new).groupBy("id").agg(F.min(F.struct("cost", "path")).alias("b")).select("id", "b.cost", "b.path")
        best = saved(best, f"{folder}/{k}")
        same = best.join(now.select("id", F.col("cost").alias("old")), "id", "left").filter("old is null or cost < old").limit(1).count() == 0
        now = best
        if same:
            break
    return now


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 10_000) -> tuple[str, np.ndarray]:
    """max c'x with a x = b, lo <= x <= hi, by two-phase bounded simplex with Bland's rule."""
    m, n = a.shape
    rest = b - a @ lo
    sign = np.where(rest < 0, -1.0, 1.0)
    t = np.hstack([a, np.diag(sign)])
    low, up = np.concatenate([lo, np.zeros(m)]), np.concatenate([hi, np.full(m, np.inf)])
    basis, x = list(range(n, n + m)), np.concatenate([lo, np.abs(rest)])
    at_up = np.zeros(n + m, bool)

    def phase(cost: np.ndarray) -> str:
        for _ in range(most):
            inv = np.linalg.pinv(t[:, basis]) if m else np.zeros((0, 0))
            price = cost[basis] @ inv
            red = cost - price @ t
            enter = next((j for j in range(n + m) if j not in basis and up[j] > low[j] and ((not at_up[j] and red[j] > 1e-9) or (at_up[j] and red[j] < -1e-9))), None)
            if enter is None:
                return "optimal"
            way = -1.0 if at_up[enter] else 1.0
            d = -way * (inv @ t[:, enter])
            step, leave = up[enter] - low[enter], None
            for i, k in sorted(enumerate(basis), key=lambda e: e[1]):
                room = (low[k] - x[k]) / d[i] if d[i] < -1e-11 else (up[k] - x[k]) / d[i] if d[i] > 1e-11 else np.inf
                if room < step - 1e-12:
                    step, leave = max(0.0, room), i
            if not np.isfinite(step):
                return "unbounded"
            x[basis] += step * d
            x[enter] += way * step
            if leave is None:
                at_up[enter] = not at_up[enter]
            else:
                k = basis[leave]
                at_up[k] = d[leave] > 0
                x[k] = up[k] if at_up[k] else low[k]
                basis[leave] = enter
        return "stopped"

    phase(np.concatenate([np.zeros(n), -np.ones(m)]))
    if x[n:].sum() > 1e-6:
        return "infeasible", x[:n]
    up[n:] = 0.0
    return phase(np.concatenate([c, np.zeros(m)])), x[:n]


def flux_balance(stoich: DataFrame, objective: str) -> DataFrame:
    """(model, status, rxn, flux): steady-state fluxes of largest objective, one model a task.

    ``stoich`` may have a ``model`` column; models are solved in parallel.
    """
    import pandas as pd

    s = stoich if "model" in stoich.columns else stoich.withColumn("model", F.lit("0"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rxns, mets = sorted(pdf.rxn.unique()), sorted(pdf.met.unique())
        a = np.zeros((len(mets), len(rxns)))
        for r, k, c in zip(pdf.rxn, pdf.met, pdf.coeff):
            a[mets.index(k), rxns.index(r)] += c
        bounds = pdf.groupby("rxn")[["lb", "ub"]].first().loc[rxns]
        status, x = simplex(np.array([float(r == objective) for r in rxns]), a, np.zeros(len(mets)), bounds.lb.to_numpy(float), bounds.ub.to_numpy(float))
        return pd.DataFrame({"model": pdf.model.iloc[0], "status": status, "rxn": rxns, "flux": x})

    return s.groupBy("model").applyInPandas(solve, "model string, status string, rxn string, flux double")


#: Lower bounds of exchange reactions (public names), by growth condition.
CONDITIONS = {
    "aerobic_glucose": {"EX_glc__D_e": -10.0, "EX_o2_e": -1000.0},
    "anaerobic_glucose": {"EX_glc__D_e": -10.0, "EX_o2_e": 0.0},
    "aerobic_acetate": {"EX_glc__D_e": 0.0, "EX_ac_e": -10.0, "EX_o2_e": -1000.0},
    "aerobic_glycerol": {"EX_glc__D_e": 0.0, "EX_glyc_e": -10.0, "EX_o2_e": -1000.0},
    "aerobic_succinate": {"EX_glc__D_e": 0.0, "EX_succ_e": -10.0, "EX_o2_e": -1000.0},
}


def with_condition(stoich: DataFrame, condition: str) -> DataFrame:
    """The bounds of a preset instead of the model's, for the reactions that it names."""
    rows = [(k, v) for k, v in CONDITIONS[condition].items()]
    own = stoich.sparkSession.createDataFrame(rows, "rxn string, _lb double")
    return stoich.join(F.broadcast(own), "rxn", "left").withColumn("lb", F.coalesce("_lb", "lb")).drop("_lb").select(*stoich.columns)


def flux_sampled(stoich: DataFrame, objective: str, samples: int, share: float = 0.95, seed: int = 7) -> DataFrame:
    """(rxn, flux): mean |flux| over random objectives whose ``objective`` stays at ``share`` of its optimum or more.

    One sample is one task; without a feasible optimum all fluxes are 0.
    """
    import pandas as pd

    best = flux_balance(stoich, objective).filter(F.col("rxn") == objective).select("status", "flux").first()
    if best is None or best.status != "optimal":
        return stoich.select("rxn", F.lit(0.0).alias("flux")).distinct()
    held = stoich.withColumn("lb", F.when(F.col("rxn") == objective, F.greatest("lb", F.lit(share * best.flux))).otherwise(F.col("lb")))
    each = held.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rxns, mets = sorted(pdf.rxn.unique()), sorted(pdf.met.unique())
        a = np.zeros((len(mets), len(rxns)))
        for r, k, c in zip(pdf.rxn, pdf.met, pdf.coeff):
            a[mets.index(k), rxns.index(r)] += c
        bounds = pdf.groupby("rxn")[["lb", "ub"]].first().loc[rxns]
        c = np.random.default_rng([seed, int(pdf["sample"].iloc[0])]).standard_normal(len(rxns))
        status, x = simplex(c, a, np.zeros(len(mets)), bounds.lb.to_numpy(float), bounds.ub.to_numpy(float))
        return pd.DataFrame({"rxn": rxns, "flux": np.abs(x) if status == "optimal" else np.zeros(len(rxns))})

    return each.groupBy("sample").applyInPandas(solve, "rxn string, flux double").groupBy("rxn").agg(F.avg("flux").alias("flux"))
