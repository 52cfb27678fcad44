"""Temperature mixing: source shares to a power that meets a target, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.shared import fresh_name, settle

#: Tokens in a block of a source, about.
BLOCK_TOKENS = 16_384
#: The largest exponent; the sources' own shares have 1.
MOST = 64.0
#: Exponents tried in one job: five halvings of the interval.
_STEPS = 32


@dataclass(frozen=True)
class Target:
    """What the exponent must meet: entropy as a share of the most possible, and the most passes over a source."""

    entropy: float | None = 0.9
    max_passes: float | None = 4.0


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda x: x != "")).cast("long")


def _tried(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: entropy of the weights, and the most passes at a budget of all tokens. q is a source's share of the largest one's tokens, p of all."""
    each = sources.filter("tokens > 0").withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in exponents])))
    power = F.pow("q", "a")
    got = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln("q")).alias("zl"), F.max(power / F.col("p")).alias("r"))
    rows = got.select("a", (F.ln("z") - F.col("a") * F.col("zl") / F.col("z")).alias("h"), (F.col("r") / F.col("z")).alias("passes")).collect()  # a row for each exponent
    return {r["a"]: (r["h"], r["passes"]) for r in rows}


def _last(sources: DataFrame, low: float, high: float, ok, rounds: int = 6) -> float:
    """The end of the part of [low, high], from low on, where ok holds; low may be the larger one. ok turns at most once."""
    for _ in range(rounds):
        grid = [low + (high - low) * i / _STEPS for i in range(_STEPS + 1)]
        got = _tried(sources, grid)
        if ok(*got[grid[-1]]):
            return high
        at = max((i for i, a in enumerate(grid) if ok(*got[a])), default=-1)
        if at < 0:
            return low
        low, high = grid[at], grid[at + 1]
    return low


def solve_exponent(sources: DataFrame, target: Target, budget_share: float = 1.0) -> float:
    """The exponent in [0, MOST] that meets the target, to about 1e-7.

    0 gives each source the same weight, 1 keeps the sources' own shares, more
    gives large sources more than these. Entropy falls with the exponent, and the
    largest exponent that still reaches the target is taken, whether that takes
    weight from the large sources or from the small ones. Where some source then
    needs more passes than allowed (a small one below 1, a large one above 1), the
    exponent moves towards 1 until none does, or to 1. What the range can't reach
    gives its nearer end; fewer than two sources with tokens give 1.
    """
    n = sources.filter("tokens > 0").count()
    if n < 2:
        return 1.0
    most = (target.max_passes or math.inf) / budget_share if budget_share else math.inf
    a = 1.0
    if target.entropy is not None:
        a = _last(sources, 0.0, MOST, lambda h, passes: h >= target.entropy * math.log(n) - 1e-9)
    if target.max_passes is not None:
        a = _last(sources, 1.0, a, lambda h, passes: passes <= most + 1e-9)
    return a


def _units(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens of each document; rows that repeat a doc_id and source are drawn together."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("tokens"))
    return settle(rows.groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens")), "units")


def _block(doc_id: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), blocks)


def _turn(block: Column, seed: int) -> Column:
    """Blocks stand in the order of this."""
    return F.xxhash64(block, F.lit(seed + 1))


def _place(doc_id: Column, seed: int) -> Column:
    """Documents of a block stand in the order of this."""
    return F.struct(F.xxhash64(doc_id, F.lit(seed + 2)).alias("h"), F.coalesce(doc_id, F.lit(0)).alias("d"))


def _rules(units: DataFrame, target: Target, budget: int | None, seed: int) -> tuple[DataFrame, float]:
    """A row for each source, which decides how often any document of it is drawn; and the exponent.

    s, weight, passes, blocks, full (passes in full), and the block and document
    at which the part of another pass ends (null where there is none).
    """
    by = settle(units.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    facts = by.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most")).first()
    total, most = facts["total"] or 0, facts["most"] or 0
    spend = total if budget is None else budget
    sources = by.withColumns({"p": F.col("tokens") / F.lit(float(max(1, total))), "q": F.col("tokens") / F.lit(float(max(1, most)))})
    a = solve_exponent(sources, target, spend / max(1, total))
    power = F.when(F.col("tokens") > 0, F.pow("q", F.lit(a))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    exact = F.col("weight") * F.lit(float(spend))
    whole = F.abs(exact - F.round(exact)) <= exact * 1e-12 + 1e-6  # what is whole but for rounding
    share = F.when(whole, F.round(exact)).otherwise(F.floor(exact)).cast("long")
    plan = sources.select(F.col("source").alias("s"), "tokens", (power / F.lit(z)).alias("weight")).withColumn("share", share)
    full = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(1)).cast("long")
    plan = plan.withColumn("full", full).select("s", "weight", "full", F.when(F.col("tokens") > 0, F.col("share") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)).alias("rest"), (F.col("share") / F.nullif("tokens", F.lit(0))).alias("passes"), F.ceil(F.greatest("tokens", F.lit(1)) / BLOCK_TOKENS).alias("blocks"))
    plan = settle(plan, "plan")

    # the block at which a source's rest ends: found among 1024 ranges of blocks first, then in its range, so that no source's blocks all meet
    dealt = units.join(plan.filter("rest > 0"), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", _block(F.col("doc_id"), F.col("blocks"), seed))
    sizes = dealt.groupBy("s", "rest", "block").agg(F.sum("tokens").alias("size")).withColumn("turn", _turn(F.col("block"), seed)).withColumn("range", F.shiftright("turn", 54))
    sizes = settle(sizes, "blocks")
    so_far = lambda *order: F.sum("size").over(Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranges = sizes.groupBy("s", "rest", "range").agg(F.sum("size").alias("size")).withColumn("end", so_far("range"))
    ends = ranges.filter("end > rest").groupBy("s").agg(F.min_by(F.struct("range", (F.col("end") - F.col("size")).alias("before")), "range").alias("at"))
    ends = ends.select(F.col("s").alias("k"), F.col("at.range").alias("r"), F.col("at.before").alias("before"))
    inside = sizes.join(ends, F.col("s").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r"))).withColumn("end", F.col("before") + so_far("turn", "block"))
    cut = inside.filter("end > rest").groupBy("s").agg(F.min_by(F.struct("turn", "block", (F.col("rest") - F.col("end") + F.col("size")).alias("room")), F.struct("turn", "block")).alias("cut"))
    cut = settle(cut.select(F.col("s").alias("k"), "cut.*"), "cuts")

    # the document of that block at which it ends; documents without tokens don't count
    last = dealt.filter("tokens > 0").select("s", "block", "tokens", _place(F.col("doc_id"), seed).alias("place")).join(cut.withColumnRenamed("block", "b"), F.col("s").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b")))
    run = F.sum("tokens").over(Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("end", run).filter("end > room").groupBy("k").agg(F.min("place").alias("place"), F.first("turn").alias("turn"), F.first("b").alias("b"))
    rules = plan.join(last, F.col("s").eqNullSafe(F.col("k")), "left").select("s", "weight", "passes", "blocks", "full", F.col("turn").alias("cut_turn"), F.col("b").alias("cut_block"), F.col("place").alias("cut_place"))
    return settle(rules, "rules"), a


def _copies(doc_id: Column, block: Column, rule, seed: int) -> Column:
    """How often a document is drawn. rule: a column of its source's rule by name."""
    here, cut = F.struct(_turn(block, seed).alias("t"), block.alias("b")), F.struct(rule("cut_turn").alias("t"), rule("cut_block").alias("b"))
    again = (here < cut) | (here == cut) & (_place(doc_id, seed) < rule("cut_place"))
    return rule("full") + F.when(rule("cut_turn").isNotNull() & again, 1).otherwise(0)


def mix_plan(docs: DataFrame, target: Target = Target(), budget: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, source, tokens, exponent, weight, passes, block, copies for every (doc_id, source) of docs.

    Tokens are words. The budget (default: all tokens) is dealt to the sources
    by weight. A source is passed over in full as often as its budget allows;
    the rest goes to its blocks in an order permuted by the seed: whole blocks
    while they fit, then documents of the next block, in permuted order, while
    they fit. copies is how often the document is drawn (0 or more). A budget is
    never exceeded, and missed by less than one document that didn't fit.

    Null source: a source of its own. Null or empty text: 0 tokens. A source
    without tokens has weight 0 and is drawn once, which costs nothing. Rows
    that repeat a doc_id and source are drawn together, as are those of a source
    without doc_id. Other columns are ignored.
    """
    units = _units(docs)
    rules, a = _rules(units, target, budget, seed)
    drawn = units.join(rules, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", _block(F.col("doc_id"), F.col("blocks"), seed))
    return drawn.select("doc_id", "source", "tokens", F.lit(a).alias("exponent"), "weight", "passes", "block", _copies(F.col("doc_id"), F.col("block"), F.col, seed).alias("copies"))


def mixed(docs: DataFrame, target: Target = Target(), budget: int | None = None, seed: int = 7) -> DataFrame:
    """docs with each row as often as the plan draws it; columns keep their names and values, whatever they are called.

    A row's draws follow from its source's rule and its own doc_id, so texts
    don't move: only the rules (a row for each source) meet them.
    """
    rules, _ = _rules(_units(docs), target, budget, seed)
    key, rule, turn = (fresh_name(docs, n) for n in ("rule_source", "rule", "turn"))
    rules = rules.select(F.col("s").alias(key), F.struct(*[c for c in rules.columns if c != "s"]).alias(rule))
    doc_id, part = docs["doc_id"].cast("long"), lambda name: F.col(rule)[name]
    copies = _copies(doc_id, _block(doc_id, part("blocks"), seed), part, seed)
    rows = docs.join(rules, docs["source"].cast("string").eqNullSafe(F.col(key)))
    return rows.withColumn(turn, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop(key, rule, turn)
