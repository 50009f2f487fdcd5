"""Mixing sources to target weights by temperature, in built-in functions only.

A source's share of all tokens is raised to an exponent and normalised. The exponent is
bisected between 0 (equal weights) and 1 (as it is) to the largest that reaches the target
entropy, a fraction of the highest possible, or to the smallest that asks no source to
repeat more than a limit; the repetition limit wins. A source then has a budget, its
weight times the whole budget. Whole passes over the source take every document; what is
left of the budget takes whole blocks, in an order permuted by hash, and inside the block
where it ends documents in hash order while they fit. A block is one in ``BLOCKS`` of a
source's documents by hash, so no task holds a source, whatever its share.

Bisection sees one row for each different size of a source with how many sources have it.
Sizes that differ add up to all tokens at most, so there are under sqrt(2 * tokens) of them,
however many the sources are. What is decided is one row per source: passes, the block where
the budget ends and the last hash taken there. Texts aren't shuffled: up to ``FEW`` sources
the rows are broadcast, and beyond that documents meet them in salted groups.

Null sources are one source of their own. Null and empty texts have no token: they come
once for every pass, and once where there is none. Repeated rows are equal in hash and are
taken together or not. A table without tokens is returned once, an empty one empty. Other
columns pass, whatever their names; ``copies`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.tables import discard, written

BLOCKS = 4096
ENTROPY, MOST_REPEATS, BISECTIONS = 0.95, 4.0, 40
#: The most rows of sources that are broadcast, and the groups of a source's documents beyond that.
FEW, SALTS = 10_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _tempered(e: str) -> str:
    """At exponent e, over the sizes s (share p, sources m): z, the sum of raised shares, and l, that of them times ln p."""
    return f"aggregate(s, named_struct('z', 0D, 'l', 0D), (a, x) -> named_struct('z', a.z + x.m * pow(x.p, {e}), 'l', a.l + x.m * pow(x.p, {e}) * ln(x.p)))"


def exponent(totals: DataFrame, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, budget: float = 1.0) -> tuple[float, float, float]:
    """The exponent, the sum of raised shares there and all tokens; the input is source, n."""
    sizes = totals.where("n > 0").groupBy("n").agg(F.count("*").alias("m"))
    row = sizes.agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("total"), F.sum("m").cast("double").alias("sources"), F.sort_array(F.collect_list(F.struct("n", "m"))).alias("nm"))
    row = row.withColumn("s", F.expr("transform(nm, x -> named_struct('p', x.n / total, 'm', x.m))")).withColumn("least", F.expr("s[0].p"))
    # entropy = ln z - e * l / z; a source's repetitions are budget * p ** (e - 1) / z, most for the least share
    reaches = lambda e, f: f"(ln({f}.z) - ({e}) * {f}.l / {f}.z >= {entropy!r} * ln(sources))"
    repeats = lambda e, f: f"({budget!r} * pow(least, ({e}) - 1) / {f}.z > {most_repeats!r})"

    def bisected(test) -> Column:
        """Go up while the test holds: the entropy falls as the exponent grows, and so do repetitions."""
        tried = f"transform(array((b.lo + b.hi) / 2), t -> named_struct('t', t, 'f', {_tempered('t')}))"
        half = f"transform({tried}, y -> if({test('y.t', 'y.f')}, named_struct('lo', y.t, 'hi', b.hi), named_struct('lo', b.lo, 'hi', y.t)))[0]"
        return F.expr(f"aggregate(sequence(1, {BISECTIONS}), named_struct('lo', 0D, 'hi', 1D), (b, step) -> {half})")

    row = row.withColumns({"by_entropy": bisected(reaches), "by_repeats": bisected(repeats), "one": F.expr(_tempered("1D")), "none": F.expr(_tempered("0D"))})
    first = F.when(F.expr(reaches("1D", "one")), 1.0).otherwise(F.col("by_entropy.lo"))
    second = F.when(F.expr(repeats("0D", "none")), F.col("by_repeats.hi")).otherwise(0.0)
    row = row.withColumn("e", F.greatest(first, second)).withColumn("f", F.expr(_tempered("e")))
    found = row.where("total > 0").select("e", "f.z", "total").first()
    return tuple(found) if found else (1.0, 1.0, 0.0)


def weights(totals: DataFrame, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, budget: float = 1.0) -> DataFrame:
    """Each source's weight and budget: source, n, exponent, weight, budget; the input is source, n."""
    e, z, total = exponent(totals, entropy, most_repeats, budget)
    weight = F.pow(F.col("n") / F.lit(total), F.lit(e)) / F.lit(z)
    return totals.where("n > 0").select("source", "n", F.lit(e).alias("exponent"), weight.alias("weight"), (weight * total * budget).alias("budget"))


def _with_source(df: DataFrame, rows: DataFrame, few: bool, how: str) -> DataFrame:
    """The frame's rows (source, key) with the row of their source."""
    if few:
        return df.join(F.broadcast(rows.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")), how).drop("of")
    left = df.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(SALTS).cast("long")))
    right = rows.withColumnRenamed("source", "of").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to")), how).drop("of", "to", "salt")


def mix(docs: DataFrame, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, budget: float = 1.0, blocks: int = BLOCKS, few: int = FEW) -> DataFrame:
    """The documents with ``copies``, how often each is taken (0 included)."""
    key = F.xxhash64("doc_id", "text")
    order = F.struct(F.xxhash64("block", F.lit(7)).alias("h"), F.col("block").alias("b"))  # blocks in permuted order
    keyed = lambda df: df.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks))).withColumn("at", order)
    light = written(docs.select("source", key.alias("key"), tokens(F.col("text")).alias("n")), "mix-light")
    sums = written(keyed(light).groupBy("source", "at").agg(F.sum("n").alias("n")), "mix-blocks")
    plan = weights(sums.groupBy("source").agg(F.sum("n").alias("n")), entropy, most_repeats, budget)
    passes = F.floor(F.col("budget") / F.col("n") + 1e-9)
    plan = written(plan.select("source", passes.alias("passes"), (F.col("budget") - passes * F.col("n")).alias("left")), "mix-plan")
    near = plan.count() <= few
    # at most BLOCKS rows of a source are in one window; the budget ends in the first block it can't hold
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("at"))
    placed = sums.withColumn("upto", upto).withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    ends = placed.where("upto > left").groupBy("source").agg(F.min_by(F.struct("at", (F.col("left") - F.col("upto") + F.col("n")).alias("room")), "at").alias("end"))
    ends = written(ends.select("source", "end.at", "end.room"), "mix-ends")
    # documents of that block in hash order while they fit
    inside = _with_source(keyed(light).withColumnRenamed("at", "mine"), ends, near, "inner").where("mine = at")
    inside = inside.groupBy("source", "key", "room").agg(F.sum("n").alias("n"))
    fits = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("key"))).where("upto <= room")
    last = fits.groupBy("source").agg(F.max("key").alias("last"))
    pair = lambda a, b, how: a.join(b.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), how).drop("s")
    decided = written(pair(pair(plan.select("source", "passes"), ends.select("source", "at"), "left"), last, "left"), "mix-decided")
    discard(light, sums, plan, ends)
    rest = [c for c in docs.columns if c.lower() != "copies"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("source").alias("source"), key.alias("key"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("some"))
    out = _with_source(keyed(rows).withColumnRenamed("at", "mine"), decided, near, "left")
    extra = F.when(F.col("at").isNull() | (F.col("mine") < F.col("at")), 1).when((F.col("mine") == F.col("at")) & (F.col("key") <= F.col("last")), 1).otherwise(0)
    whole = F.coalesce("passes", F.lit(1))
    copies = F.when(F.col("some"), whole + extra).otherwise(F.greatest(whole, F.lit(1)))
    return out.select("row.*", copies.cast("int").alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
