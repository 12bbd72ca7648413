"""Balanced graph partitioning by exchanging colours, with simulated annealing, in synchronous rounds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.operators.skew import index_rows
from orewright.operators.triest import uniform
from orewright.session import discard, materialize
from orewright.sources.writers import write_report

INITIAL_COLOURS = ("ROUND_ROBIN", "BATCH", "RANDOM")
NODE_SELECTION = ("LOCAL", "RANDOM", "HYBRID")
METRICS = "round int, edge_cut long, swaps long, migrations long, temperature double"
ANNEALING = ("LINEAR", "LATE", "EXPONENTIAL")


@dataclass(frozen=True)
class Config:
    """Parameters of a run, with defaults, checked once.

    ``annealing``: LINEAR and LATE cool by ``delta``, LATE reaching 1 (or with ``reset`` the start) one round later; EXPONENTIAL
    multiplies by ``decay`` (with ``reset`` it starts anew below 0.001). ``reset`` with LINEAR is an error.
    """

    rounds: int = 1000
    partitions: int = 4
    random_sample: int = 6
    neighbour_sample: int = 3
    temperature: float = 2.0
    delta: float = 0.001
    alpha: float = 2.0
    seed: int = 0
    initial: str = "ROUND_ROBIN"
    policy: str = "HYBRID"
    annealing: str = "LINEAR"
    reset: bool = False
    decay: float = 0.99

    def __post_init__(self) -> None:
        for name in ("initial", "policy", "annealing"):
            object.__setattr__(self, name, str(getattr(self, name)).upper())
        checks = [
            (self.rounds >= 0, "rounds"), (self.partitions >= 1, "partitions"), (self.random_sample >= 0, "random_sample"), (self.neighbour_sample >= 0, "neighbour_sample"),
            (self.temperature > 0, "temperature"), (self.delta >= 0, "delta"), (self.alpha is not None, "alpha"), (self.initial in INITIAL_COLOURS, "initial"),
            (self.policy in NODE_SELECTION, "policy"), (self.annealing in ANNEALING, "annealing"),
            (not self.reset or self.annealing != "LINEAR", "reset"), (0 < self.decay <= 1, "decay"),
        ]
        wrong = [name for good, name in checks if not good]
        if wrong:
            raise ValueError(f"bad value of {', '.join(wrong)}")


def dense_ids(vertices: DataFrame, column: str = "vertex") -> DataFrame:
    """(vertex, id): ids 1 .. N in the order of the vertices."""
    return index_rows(vertices.select(F.col(column).alias("vertex")).distinct(), ["vertex"], "id")


def initial_colour(id_: Column, n: Column, k: int, policy: str = "ROUND_ROBIN", seed: int = 0) -> Column:
    """A colour in [0, k) for an id in 1 .. n: id modulo k, equal contiguous blocks, or a seeded hash."""
    if policy == "ROUND_ROBIN":
        return (id_ % k).cast("int")
    if policy == "BATCH":
        return (F.floor((id_ * k + n - 1) / n) - 1).cast("int")
    return F.floor(uniform(seed, F.lit("colour"), id_) * k).cast("int")


def colour_histogram(coloured: DataFrame) -> DataFrame:
    """(color, n) of (id, color)."""
    return coloured.groupBy("color").agg(F.count(F.lit(1)).alias("n"))


def colour_degrees(arcs: DataFrame, coloured: DataFrame) -> DataFrame:
    """(src, color, n): how many neighbours of each vertex have each colour; ``arcs`` has both directions."""
    return arcs.join(coloured.select(F.col("id").alias("dst"), "color"), "dst").groupBy("src", "color").agg(F.count(F.lit(1)).alias("n"))


def report(arcs: DataFrame, coloured: DataFrame) -> DataFrame:
    """(edge_cut, migrations) of (id, color, init_color): half the arcs between colours, and vertices off their first colour."""
    a, b = coloured.select(F.col("id").alias("src"), F.col("color").alias("x")), coloured.select(F.col("id").alias("dst"), F.col("color").alias("y"))
    cut = arcs.join(a, "src").join(b, "dst").agg(F.floor(F.count(F.when(F.col("x") != F.col("y"), 1)) / 2).cast("long").alias("edge_cut"))
    moved = coloured.agg(F.count(F.when(F.col("color") != F.col("init_color"), 1)).alias("migrations"))
    return cut.join(F.broadcast(moved))


def partition_report(arcs: DataFrame, parts: DataFrame) -> DataFrame:
    """(edge_cut, migrations) of an external partition (id, part)."""
    return report(arcs, parts.select("id", F.col("part").alias("color"), F.col("part").alias("init_color")))


def cool_linear(temperature: float, delta: float, rounds: int) -> list[float]:
    """Temperatures after each round: less ``delta`` while above 1, never below 1."""
    out = []
    for _ in range(rounds):
        temperature = max(1.0, temperature - delta) if temperature > 1 else 1.0
        out.append(temperature)
    return out


def cool_linear_late(temperature: float, delta: float, rounds: int, reset: bool = False) -> list[float]:
    """As ``cool_linear``, but a value that fell to 1 or less is set to 1 (or to the start) only in the next round."""
    start, out = temperature, []
    for _ in range(rounds):
        temperature = temperature - delta if temperature > 1 else (start if reset else 1.0)
        out.append(temperature)
    return out


def cool_exponential(rounds: int, delta: float = 0.99, reset: bool = False) -> list[float]:
    """Temperatures from 1, multiplied by ``delta`` each round; with ``reset`` back to 1 below 0.001."""
    temperature, out = 1.0, []
    for _ in range(rounds):
        temperature *= delta
        if temperature < 0.001 and reset:
            temperature = 1.0
        out.append(temperature)
    return out


def local_candidates(arcs: DataFrame, n: int, seed: int, turn: int) -> DataFrame:
    """(p, q): ``n`` neighbours of each vertex (all, if it has no more), by the least seeded hash."""
    draw = F.md5(F.concat_ws(":", F.lit(f"{seed}:{turn}:local"), F.col("src").cast("string"), F.col("dst").cast("string")))
    least = F.slice(F.sort_array(F.collect_list(F.struct(draw.alias("h"), F.col("dst").alias("q")))), 1, n)
    if n < 1:
        return arcs.select(F.col("src").alias("p"), F.col("dst").alias("q")).limit(0)
    # a vertex's neighbours are cut down within 64 slots first, so that no task gathers all neighbours of a hub
    slot = F.pmod(F.xxhash64("dst"), F.lit(64)).alias("slot")
    first = arcs.groupBy(F.col("src").alias("p"), slot).agg(least.alias("some")).select("p", F.explode("some").alias("s"))
    return first.groupBy("p").agg(F.slice(F.sort_array(F.collect_list("s")), 1, n).alias("some")).select("p", F.explode("some.q").alias("q"))


def global_candidates(vertices: DataFrame, total: int, n: int, seed: int, turn: int) -> DataFrame:
    """(p, q): at most ``n`` different other vertices for each id of 1 .. total, by hashed steps."""
    n = max(0, min(n, total - 1))
    if n == 0:
        return vertices.select(F.col("id").alias("p"), F.col("id").alias("q")).limit(0)
    steps = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2 * n)), lambda i: F.floor(uniform(seed, F.lit(turn), F.lit("global"), F.col("id"), i) * (total - 1)).cast("long") + 1))
    return vertices.select(F.col("id").alias("p"), F.explode(F.slice(steps, 1, n)).alias("step")).select("p", ((F.col("p") + F.col("step") - 1) % total + 1).alias("q"))


def score_pairs(pairs: DataFrame, coloured: DataFrame, degrees: DataFrame, alpha: float) -> DataFrame:
    """(p, q, old, new) of candidate pairs with different colours: the scores before and after an exchange.

    old = d_p(c_p)^alpha + d_q(c_q)^alpha and new = d_p(c_q)^alpha + d_q(c_p)^alpha, with the present colours.
    """
    named = pairs
    for side in ("p", "q"):
        named = named.join(coloured.select(F.col("id").alias(side), F.col("color").alias(f"c{side}")), side)
    named = named.filter("cp != cq")
    for who, colour in (("p", "p"), ("q", "q"), ("p", "q"), ("q", "p")):
        found = degrees.select(F.col("src").alias(who), F.col("color").alias(f"c{colour}"), F.col("n").alias(f"d{who}{colour}"))
        named = named.join(found, [who, f"c{colour}"], "left")
    power = {x: F.pow(F.coalesce(f"d{x}", F.lit(0)).cast("double"), F.lit(float(alpha))) for x in ("pp", "qq", "pq", "qp")}
    return named.select("p", "q", (power["pp"] + power["qq"]).alias("old"), (power["pq"] + power["qp"]).alias("new"))


def accepted(scored: DataFrame, temperature: float, config: Config, turn: int) -> DataFrame:
    """The scored pairs that pass the acceptance rule at a temperature."""
    old, new = F.col("old"), F.col("new")
    if config.annealing != "EXPONENTIAL":
        return scored.filter(new * F.lit(float(temperature)) > old)
    gap = F.when((old == 0) & (new == 0), F.lit(None)).when(old == 0, F.lit(float("inf"))).when(new == 0, F.lit(float("-inf"))).otherwise(F.try_divide(F.lit(1.0), old) - F.try_divide(F.lit(1.0), new))
    chance = F.least(F.lit(1.0), F.exp(F.least(gap / F.lit(float(temperature)), F.lit(0.0))))
    return scored.filter(uniform(config.seed, F.lit(turn), F.lit("accept"), F.col("p"), F.col("q")) < chance)


def best_partner(scored: DataFrame) -> DataFrame:
    """(p, q, old, new): for each p the candidate with the greatest new score; the smaller q wins a tie."""
    best = scored.groupBy("p").agg(F.max(F.struct("new", (-F.col("q")).alias("tie"), "q", "old")).alias("b"))
    return best.select("p", "b.q", "b.old", "b.new")


def independent(claims: DataFrame, seed: int, turn: int) -> DataFrame:
    """The claims (p, q) that rank first, by gain and then by hash, among all claims that touch p and all that touch q."""
    mark = F.md5(F.concat_ws(":", F.lit(f"{seed}:{turn}:rank"), F.least("p", "q").cast("string"), F.greatest("p", "q").cast("string"), F.col("p").cast("string")))
    ranked = claims.select("p", "q", F.struct((F.col("new") - F.col("old")).alias("gain"), mark.alias("mark")).alias("rank"))
    ends = ranked.select(F.explode(F.array("p", "q")).alias("end"), "rank").groupBy("end").agg(F.max("rank").alias("top"))
    at_p, at_q = ends.toDF("p", "top_p"), ends.toDF("q", "top_q")
    return ranked.join(at_p, "p").join(at_q, "q").filter((F.col("rank") == F.col("top_p")) & (F.col("rank") == F.col("top_q"))).select("p", "q")


def one_round(arcs: DataFrame, coloured: DataFrame, total: int, config: Config, temperature: float, turn: int) -> DataFrame:
    """The exchanges (p, q) of a synchronous round; no vertex takes part in two.

    With HYBRID the global sample serves vertices that found no local partner.
    """
    degrees = colour_degrees(arcs, coloured)
    best = None
    for policy, pairs in (
        ("LOCAL", lambda: local_candidates(arcs, config.neighbour_sample, config.seed, turn)),
        ("RANDOM", lambda: global_candidates(coloured, total, config.random_sample, config.seed, turn)),
    ):
        if config.policy in (policy, "HYBRID"):
            found = best_partner(accepted(score_pairs(pairs(), coloured, degrees, config.alpha), temperature, config, turn))
            best = found if best is None else best.unionByName(found.join(best, "p", "left_anti"))
    claims = materialize(best, "claims")
    chosen = materialize(independent(claims, config.seed, turn), "swaps")
    discard(claims)
    return chosen


def jabeja(arcs: DataFrame, config: Config = Config(), vertices: DataFrame | None = None, report_to: str | None = None, **changes) -> tuple[DataFrame, DataFrame]:
    """((id, vertex, color, init_color), (round, edge_cut, swaps, migrations, temperature)) after all rounds.

    ``arcs`` (src, dst) has each edge in both directions. Colours are exchanged in pairs, so their numbers never change.
    ``swaps`` counts exchanges from the start; the temperature is the one after cooling. Each round writes the colours to the
    shared folder, which cuts the lineage, and deletes those of the round before; with ``report_to`` it appends its row of
    the report there, so that a run that ends early leaves what it had.
    """
    config = replace(config, **changes)
    spark = arcs.sparkSession
    named = materialize(dense_ids(vertices if vertices is not None else arcs.select(F.col("src").alias("vertex"))), "vertices")
    total = named.count()
    arcs = arcs.join(named.toDF("src", "s"), "src").join(named.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    arcs = materialize(arcs, "arcs")
    colour = initial_colour(F.col("id"), F.lit(total), config.partitions, config.initial, config.seed)
    coloured = materialize(named.select("id", "vertex", colour.alias("color"), colour.alias("init_color")), "coloured")
    start = 1.0 if config.annealing == "EXPONENTIAL" else config.temperature
    if config.annealing == "EXPONENTIAL":
        plan = cool_exponential(config.rounds, config.decay, config.reset)
    elif config.annealing == "LATE":
        plan = cool_linear_late(start, config.delta, config.rounds, config.reset)
    else:
        plan = cool_linear(start, config.delta, config.rounds)
    rows, swaps, temperature = [], 0, start
    for turn in range(config.rounds):
        pairs = one_round(arcs, coloured, total, config, temperature, turn)
        swaps += pairs.count()
        both = pairs.select(F.col("p").alias("id"), F.col("q").alias("other")).unionByName(pairs.select(F.col("q").alias("id"), F.col("p").alias("other")))
        taken = both.join(coloured.select(F.col("id").alias("other"), F.col("color").alias("new_color")), "other").select("id", "new_color")
        moved = coloured.join(taken, "id", "left").select("id", "vertex", F.coalesce("new_color", "color").alias("color"), "init_color")
        before, coloured = coloured, materialize(moved, "coloured")
        discard(before, pairs)
        temperature = plan[turn]
        cut, migrations = report(arcs, coloured).first()
        rows.append((turn, cut, swaps, migrations, temperature))
        if report_to:
            write_report(spark.createDataFrame(rows[-1:], METRICS), report_to, "append" if turn else "overwrite")
    return coloured, spark.createDataFrame(rows, METRICS)
