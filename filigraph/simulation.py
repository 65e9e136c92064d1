"""Agent-based adoption on layered networks.

Within a step later agents see the roles earlier ones have just taken, so one
simulation is one sequential kernel; simulations run in parallel, one task each
(``applyInPandas`` on ``sim_id``).  Static measures, trajectories and their classes are
plain DataFrame aggregations over the snapshots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph
from .operators import overlap, traversal

RANK = {"outsider": 0, "observer": 1, "sympathizer": 2, "user": 3, "contributor": 4, "steward": 5, "removed": -1, "infiltrator": -2, "defector": -3}
NAMES = {v: k for k, v in RANK.items()}
LADDER = (0.05, 0.15, 0.30, 0.50, 0.75)
LAYERS = ("S", "C", "E", "T", "G", "O")
#: What an adaptive host chooses from, and functions that need holders.
ARMS = ("random", "degree", "infiltration_first", "attrition")
FUNCTIONS = 8
SNAPSHOT = "sim_id long, t int, n_active int, n_committed int, n_removed int, n_defected int, n_attacked int, fear double, backfire double, commitment double, awareness double, legibility double, giant double, phi double, outages int, core double, depth double, trust double, growth double, hierarchy double"


def topology(kind: str, n: int, seed: int) -> set[tuple[int, int]]:
    """Directed layer S on 0..n-1: modular cells, federated hubs, mesh or scale-free; ties in both directions."""
    r = np.random.default_rng(seed)
    e: set[tuple[int, int]] = set()

    def tie(a: int, b: int) -> None:
        if a != b:
            e.update(((a, b), (b, a)))

    if kind == "modular_cells":
        k = max(2, -(-n // 30))
        for a in range(n):
            for b in range(a + 1, n):
                if r.random() < (0.20 if a % k == b % k else 0.01 / (k - 1)):
                    tie(a, b)
    elif kind == "federated_hubs":
        h = max(1, int(np.ceil(np.sqrt(n))))
        for a in range(n):
            if a < h:
                tie(a, (a + 1) % h)
            else:
                tie(a, a % h)
                for b in range(a + 1, n):
                    if a % h == b % h and r.random() < 0.05:
                        tie(a, b)
    elif kind == "mesh":
        for a in range(n):
            for j in range(1, 5):
                tie(a, int(r.integers(n)) if r.random() < 0.05 else (a + j) % n)
    elif kind == "scale_free":
        ends = [0, 1, 1, 0]
        tie(0, 1)
        for a in range(2, n):
            for b in {int(ends[r.integers(len(ends))]) for _ in range(3)}:
                tie(a, b)
                ends += [a, b]
    else:
        raise ValueError(f"unknown topology {kind!r}")
    return e


def layers(s: set[tuple[int, int]], n: int, seed: int, leak: float = 0.10) -> dict[str, set[tuple[int, int]]]:
    """C keeps 70 % of S, E half of S, T half of C; G the three out-neighbours of largest degree; O leaks from S and C."""
    r = np.random.default_rng(seed + 1)
    thin = lambda x, p: {e for e in sorted(x) if r.random() < p}
    out: dict[str, set] = {"S": s, "C": thin(s, 0.7), "E": thin(s, 0.5)}
    out["T"] = thin(out["C"], 0.5)
    deg = np.zeros(n, int)
    near: dict[int, list[int]] = {}
    for a, b in s:
        deg[a] += 1
        deg[b] += 1
        near.setdefault(a, []).append(b)
    out["G"] = {(a, b) for a, bs in near.items() for b in sorted(bs, key=lambda x: (-deg[x], x))[:3]}
    out["O"] = thin(s | out["C"], leak)
    return out


class World:
    def __init__(self, kind: str, n: int, seed: int, committed: float = 0.05, complex_: bool = False, host: str = "random", budget: int = 2, forkability: float = 0.3, recruitment: float = 0.05):
        self.n, self.r, self.complex, self.host, self.budget, self.fork, self.recruit = n, np.random.default_rng(seed + 2), complex_, host, budget, forkability, recruitment
        self.layers = layers(topology(kind, n, seed), n, seed)
        self.before = {k: self._in(k) for k in ("S", "C")}
        self.role = np.zeros(n, int)
        self.role[self.r.permutation(n)[: max(1, int(round(committed * n)))]] = RANK["contributor"]
        self.commitment = np.where(self.role > 0, 0.6, 0.0)
        self.aware, self.fear, self.back = np.zeros(n), np.zeros(n), np.zeros(n)
        self.legible, self.capacity, self.hit = np.zeros(n), np.ones(n), np.zeros(n, bool)
        self.recent: list[int] = []
        self.defected = 0
        self.arm, self.paid, self.last_committed, self.pressure, self.saved = None, np.zeros(len(ARMS)), 0, 0.0, 0.0
        # eight functions, each of two holders at least, dealt in turn
        self.holders = [[(2 * f + k) % n for k in range(2)] for f in range(FUNCTIONS)]

    def _in(self, layer: str) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.n)]
        for a, b in sorted(self.layers[layer]):
            out[b].append(a)
        return out

    def committed(self) -> np.ndarray:
        return self.role >= RANK["user"]

    def active(self) -> np.ndarray:
        return (self.role != RANK["removed"]) & (self.role != RANK["outsider"])

    def exposures(self) -> tuple[np.ndarray, np.ndarray]:
        c = self.committed()
        return tuple(np.array([sum(c[u] for u in self.before[k][v]) for v in range(self.n)], float) for k in ("S", "C"))

    def attack(self) -> list[int]:
        """The host's turn: whom it hits, and how."""
        live = np.flatnonzero(self.active())
        if not len(live) or self.host == "none":
            return []
        name = self.host
        if name == "adaptive":  # an epsilon-greedy bandit over the others, paid by the fall of the committed
            now = int(self.committed().sum())
            if self.arm is not None:
                self.paid[self.arm] = 0.7 * self.paid[self.arm] + 0.3 * (self.last_committed - now)
            self.last_committed = now
            self.arm = int(self.r.integers(len(ARMS))) if self.r.random() < 0.1 else int(np.argmax(self.paid))
            name = ARMS[self.arm]
        budget = self.budget
        if name == "attrition":  # pressure grows with the committed share and wears off, fraction by fraction
            self.pressure = 0.7 * self.pressure + 0.3 * float(self.committed().mean()) * 10
            self.saved += self.budget * min(1.0, 0.5 + self.pressure)
            budget = int(self.saved)
            self.saved -= budget
        hit = [int(v) for v in self._targets(name, live)[:budget]]
        for v in hit:
            if name == "infiltration_first" and self.role[v] >= RANK["user"] and self.r.random() < 0.5:
                self.role[v] = RANK["infiltrator"]
            elif name == "legibility":  # watched first, removed when seen enough
                self.legible[v] = min(1.0, self.legible[v] + 0.4)
                if self.legible[v] >= 0.8:
                    self._remove(v)
            elif name == "attrition":
                self.capacity[v] *= 0.5
                if self.capacity[v] < 0.3:
                    self._remove(v)
            else:
                self._remove(v)
        if name == "localized" and hit:
            self._disrupt(hit)
        return hit

    def _remove(self, v: int) -> None:
        self.role[v] = RANK["removed"]
        self.commitment[v] *= 0.5

    def _disrupt(self, hit: list[int], each: int = 2) -> None:
        """Cuts up to ``each`` contacts of those hit."""
        for v in hit:
            own = sorted(e for e in self.layers["C"] if v in e)
            for k in self.r.permutation(len(own))[:each]:
                a, b = own[k]
                self.layers["C"].discard((a, b))
                if a in self.before["C"][b]:
                    self.before["C"][b].remove(a)

    def _targets(self, name: str, live: np.ndarray) -> np.ndarray:
        size = np.array([len(self.before["S"][v]) for v in range(self.n)])
        if name == "degree":
            return live[np.lexsort((live, -size[live]))]
        if name == "betweenness":
            return live[np.lexsort((live, -self._betweenness()[live]))]
        if name == "legibility":
            return live[np.lexsort((live, -self.legible[live]))]
        if name == "localized":  # a neighbourhood: breadth first from the best connected committed
            c = [v for v in live if self.committed()[v]] or list(live)
            start = max(c, key=lambda v: (size[v], -v))
            order, seen, at = [start], {start}, 0
            while at < len(order):
                for u in self.before["S"][order[at]]:
                    if u not in seen and self.active()[u]:
                        seen.add(u)
                        order.append(u)
                at += 1
            return np.array([*order, *(v for v in live if v not in seen)])
        if name in ("infiltration_first", "attrition"):
            return live[np.lexsort((live, -self.commitment[live], -self.committed()[live].astype(int)))]
        return self.r.permutation(live)

    def _betweenness(self) -> np.ndarray:
        """Shortest paths through each vertex of S among the active (Brandes' dependencies)."""
        live, score = self.active(), np.zeros(self.n)
        near = [[u for u in self.before["S"][v] if live[u]] if live[v] else [] for v in range(self.n)]
        for s in np.flatnonzero(live):
            dist, paths, order, back = {int(s): 0}, {int(s): 1.0}, [int(s)], {int(s): []}
            at = 0
            while at < len(order):
                v = order[at]
                at += 1
                for u in near[v]:
                    if u not in dist:
                        dist[u], paths[u], back[u] = dist[v] + 1, 0.0, []
                        order.append(u)
                    if dist[u] == dist[v] + 1:
                        paths[u] += paths[v]
                        back[u].append(v)
            depends = dict.fromkeys(order, 0.0)
            for v in reversed(order[1:]):
                for u in back[v]:
                    depends[u] += paths[u] / paths[v] * (1 + depends[v])
                score[v] += depends[v]
        return score

    def repression(self, attacked: list[int]) -> int:
        c0, gone = self.committed(), self.role == RANK["removed"]
        vis = len(attacked) / self.n * (1 + len(self.layers["O"]) / max(1, len(self.layers["S"])))
        narrative = sum(self.recent[-5:]) / 20.0
        hit, risen = np.zeros(self.n, bool), 0
        hit[attacked] = True
        for v in range(self.n):
            near = self.before["S"][v]
            k = max(1, len(near))
            protection, injustice, local = (sum(x[u] for u in near) / k for x in (self.committed() if near else c0, gone, hit))
            r = max(float(hit[v]), local)
            self.fear[v] = np.clip(self.fear[v] + 0.3 * r - 0.1 * protection, 0, 1)
            old = self.back[v]
            self.back[v] = np.clip(0.3 * r + 0.3 * injustice + 0.2 * vis + 0.2 * narrative, 0, 1)
            risen += self.back[v] > old
            if self.role[v] >= RANK["user"] and self.fear[v] >= 0.7 and protection < 0.3:
                if self.r.random() < self.fork:
                    self.commitment[v] *= 0.5
                else:
                    self.role[v] = RANK["defector"]
                    self.defected += 1
        self.recent.append(risen)
        return risen

    def adopt(self, es: np.ndarray, ec: np.ndarray) -> None:
        for v in range(self.n):
            if self.role[v] < 0:
                continue
            if self.complex and self.role[v] == 0 and es[v] < 2:
                continue
            drive = (es[v] + 0.3 * ec[v]) / max(len(self.before["S"][v]), 1) - 0.8 * self.fear[v] + 0.6 * self.back[v] + 0.3 * self.commitment[v]
            self.aware[v] = np.clip(0.7 * self.aware[v] + 0.3 * drive, 0, 1)
            while self.role[v] < RANK["steward"] and drive >= LADDER[self.role[v]]:
                self.role[v] += 1
                self.commitment[v] = min(1.0, self.commitment[v] + 0.1)

    def step(self) -> tuple[list[int], int]:
        for v in np.flatnonzero(self.role == RANK["removed"]):
            if self.r.random() < self.recruit:
                self.role[v] = RANK["outsider"]
        es, ec = self.exposures()
        attacked = self.attack()
        risen = self.repression(attacked)
        self.adopt(es, ec)
        self.refill()
        self.legible = np.clip(self.legible + 0.02 - 0.05 * self.commitment, 0, 1)
        return attacked, risen

    def giant(self) -> float:
        live, up = self.active(), np.arange(self.n)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in self.layers["S"]:
            if live[a] and live[b]:
                up[root(a)] = root(b)
        sizes = np.bincount([root(v) for v in np.flatnonzero(live)], minlength=1)
        return float(sizes.max()) / self.n if live.any() else 0.0

    def refill(self) -> None:
        """Functions without a holder left go to the most committed who hold least."""
        live = self.active()
        load = np.bincount([v for h in self.holders for v in h if live[v]], minlength=self.n)
        for f, own in enumerate(self.holders):
            own = [v for v in own if live[v]]
            free = sorted((v for v in np.flatnonzero(self.committed()) if v not in own), key=lambda v: (load[v], -self.commitment[v], v))
            while len(own) < 2 and free:
                own.append(int(free.pop(0)))
                load[own[-1]] += 1
            self.holders[f] = own

    def outages(self) -> int:
        live = self.active()
        return sum(not any(live[v] for v in h) for h in self.holders)

    def depth(self) -> int:
        """The deepest core of S among the active, by in + out degree."""
        live = self.active()
        near = {int(v): {u for u in self.before["S"][v] if live[u]} for v in np.flatnonzero(live)}
        k = 0
        while near:
            low = [v for v, x in near.items() if 2 * len(x) <= k]
            if not low:
                k = min(2 * len(x) for x in near.values())
                continue
            for v in low:
                for u in near.pop(v):
                    if u in near:
                        near[u].discard(v)
        return k

    def order(self) -> dict[str, float]:
        """The order parameters, each in [0, 1], and their weighted sum."""
        c, live = self.committed(), self.active()
        gone = float((self.role == RANK["removed"]).mean())
        ratio = float(c.mean()) / (gone + 1e-3)
        t = [(a, b) for a, b in self.layers["T"] if c[a] and c[b]]
        trust = len(t) / max(1, int(c.sum())) / 4
        parts = {"core": float(c.sum()) / max(1, int(live.sum())), "giant": self.giant(), "depth": min(1.0, self.depth() / 10), "trust": min(1.0, trust), "growth": ratio / (1 + ratio)}
        phi = 0.25 * parts["core"] + 0.25 * parts["giant"] + 0.10 * parts["depth"] + 0.20 * parts["trust"] + 0.20 * parts["growth"]
        return {**parts, "phi": float(np.clip(phi, 0, 1)) if c.any() else 0.0}

    def snapshot(self, sim: int, t: int, attacked: int, risen: int) -> tuple:
        c, x = self.committed(), self.order()
        return (sim, t, int(self.active().sum()), int(c.sum()), int((self.role == -1).sum()), self.defected, attacked, float(self.fear.mean()), float(self.back.mean()), float(self.commitment.mean()), float(self.aware.mean()), float(self.legible.mean()), x["giant"], x["phi"],
                self.outages(), x["core"], x["depth"], x["trust"], x["growth"], hierarchy(np.array([len(b) for b in self.before["S"]])[self.active()]))


def hierarchy(weights: np.ndarray) -> float:
    """The Gini coefficient of influence: 0 where all are alike, towards 1 where one has all."""
    x = np.sort(np.asarray(weights, float))
    n, total = len(x), x.sum()
    return float(2 * (np.arange(1, n + 1) * x).sum() / (n * total) - (n + 1) / n) if n and total else 0.0


def run(sims: DataFrame) -> DataFrame:
    """Snapshots of simulations given as (sim_id, topology, n, steps, seed, committed, complex, host, budget)."""
    import pandas as pd

    columns = [c.split()[0] for c in SNAPSHOT.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.iloc[0]
        w = World(p.topology, int(p.n), int(p.seed), float(p.committed), bool(p["complex"]), p.host, int(p.budget))
        rows = [w.snapshot(int(p.sim_id), 0, 0, 0)]
        for t in range(1, int(p.steps) + 1):
            attacked, risen = w.step()
            rows.append(w.snapshot(int(p.sim_id), t, len(attacked), risen))
        return pd.DataFrame(rows, columns=columns)

    return sims.groupBy("sim_id").applyInPandas(one, SNAPSHOT)


def sweep(spark: SparkSession, samples: int, kinds: tuple[str, ...] = ("modular_cells", "mesh"), hosts: tuple[str, ...] = ("random", "degree"), n: int = 60, steps: int = 20, seed: int = 7) -> DataFrame:
    """A Latin hypercube over the initial share and the budget, crossed with topologies and hosts by turns."""
    r = np.random.default_rng(seed)
    a, b = r.permutation(samples), r.permutation(samples)
    rows = [(i, kinds[i % len(kinds)], n, steps, seed + i, 0.02 + 0.2 * (a[i] + 0.5) / samples, bool(i // 2 % 2), hosts[i // len(kinds) % len(hosts)], int(1 + 3 * (b[i] + 0.5) / samples)) for i in range(samples)]
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in rows], "sim_id long, topology string, n int, steps int, seed int, committed double, complex boolean, host string, budget int")


def classes(snapshots: DataFrame) -> DataFrame:
    """(sim_id, class): extinction, dormant, coexistence or unclassified, from the last quarter of phi."""
    w = Window.partitionBy("sim_id")
    x = snapshots.withColumn("last", F.max("t").over(w))
    tail = x.filter(F.col("t") > F.col("last") * 0.75)
    a = tail.groupBy("sim_id").agg(F.avg("phi").alias("mean"), F.coalesce(F.stddev_samp("phi"), F.lit(0.0)).alias("std"), F.max_by("phi", "t").alias("end"), F.max_by("n_committed", "t").alias("c"))
    c = F.when((F.col("end") < 0.05) | (F.col("c") == 0), "extinction").when(F.col("std") >= 0.05, "unclassified").when(F.col("mean") < 0.35, "dormant").otherwise("coexistence")
    return a.select("sim_id", c.alias("class"))


def time_to_attractor(snapshots: DataFrame, width: int = 5, still: float = 0.02) -> DataFrame:
    """(sim_id, t): the first step from which the rolling deviation of phi stays below ``still``; null if it never does."""
    w = Window.partitionBy("sim_id").orderBy("t")
    x = snapshots.withColumn("s", F.coalesce(F.stddev_samp("phi").over(w.rowsBetween(-(width - 1), 0)), F.lit(0.0)))
    bad = x.groupBy("sim_id").agg(F.max(F.when(F.col("s") >= still, F.col("t"))).alias("bad"), F.max("t").alias("last"))
    return bad.select("sim_id", F.when(F.coalesce("bad", F.lit(-1)) < F.col("last"), F.coalesce("bad", F.lit(-1)) + 1).alias("t"))


def exposures(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """(sim_id, id, layer, exposure): committed in-neighbours by layer. ``agents(sim_id, id, role)``, ``edges(sim_id, layer, src, dst)``."""
    c = agents.filter(F.col("role").isin("user", "contributor", "steward")).select("sim_id", F.col("id").alias("src"))
    return edges.join(c, ["sim_id", "src"]).groupBy("sim_id", F.col("dst").alias("id"), "layer").agg(F.count(F.lit(1)).alias("exposure"))


def population(agents: DataFrame) -> DataFrame:
    """(sim_id, n, active, committed, committed_share)."""
    active = ~F.col("role").isin("removed", "outsider")
    committed = F.col("role").isin("user", "contributor", "steward")
    return agents.groupBy("sim_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(active).alias("active"), F.count_if(committed).alias("committed"), F.avg(committed.cast("double")).alias("committed_share"))


def layer_summary(g: Graph) -> DataFrame:
    """(n, m, mean_degree, clustering, giant) of one layer."""
    n, m = g.vertices.agg(F.count(F.lit(1)).alias("n")), g.edges.agg(F.count(F.lit(1)).alias("m"))
    x = n.join(F.broadcast(m)).join(F.broadcast(overlap.average_clustering(g))).join(F.broadcast(traversal.giant_fraction(g)))
    return x.select("n", "m", (F.col("m") / F.col("n")).alias("mean_degree"), F.col("avg_clustering").alias("clustering"), F.col("giant_fraction").alias("giant"))


def ablation(spark: SparkSession, hosts: tuple[str, ...], samples: int = 8, n: int = 60, steps: int = 20, seed: int = 7) -> DataFrame:
    """(host, runs, coexistence, extinction, phi, score): outcomes under each host; score = coexistence + mean phi - extinction."""
    sims = None
    for k, h in enumerate(hosts):
        x = sweep(spark, samples, hosts=(h,), n=n, steps=steps, seed=seed).withColumn("sim_id", F.col("sim_id") + k * samples)
        sims = x if sims is None else sims.unionByName(x)
    snaps = run(sims)
    end = snaps.groupBy("sim_id").agg(F.avg("phi").alias("phi")).join(classes(snaps), "sim_id").join(sims.select("sim_id", "host"), "sim_id")
    out = end.groupBy("host").agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col("class") == "coexistence").cast("double")).alias("coexistence"), F.avg((F.col("class") == "extinction").cast("double")).alias("extinction"), F.avg("phi").alias("phi"))
    return out.withColumn("score", F.col("coexistence") + F.col("phi") - F.col("extinction"))


def influence(agents: DataFrame, scores: DataFrame) -> DataFrame:
    """(sim_id, role, share): what part of ``scores(sim_id, id, score)`` each role's members hold."""
    x = agents.join(scores, ["sim_id", "id"]).groupBy("sim_id", "role").agg(F.sum("score").alias("s"))
    return x.select("sim_id", "role", (F.col("s") / F.sum("s").over(Window.partitionBy("sim_id"))).alias("share"))
