"""Mixing sources to target weights by entropy balancing.

Among all document rates that give every source its target number of words,
entropy balancing takes those closest (in relative entropy) to one copy of
every document. They are exponentially tilted,

    rate = min(cap, exp(lambda[source] * size / mean size of the source)),

and lambda minimizes a convex dual whose gradient is "words taken - target".
Each Newton step is one aggregation over the (source, size) counts, which is
all the rates depend on; a bracket around each root keeps the steps safe.

Rates become whole copies by a threshold: document d takes its j-th copy when
j - rate - draw(d) is at most the source's threshold, draw being a hash of id and
text, so a threshold of 0 is ordinary random rounding. The thresholds are read
off histograms of that key, for large documents first; smaller ones make up for
what rounding the larger ones left over.

Only built-in functions are used, and nothing but tables of one row per source
is held apart from the documents; a source of any size is pre-aggregated.

Defined results: a null text has size 0; the null source is a source, last in
order; a source without words has target 0; documents of size 0 get the rate of
their source's formula but take 0 words; equal rows (id and text) are rounded one
by one, told apart by their place in the table, so which of them is taken more often
may change with the layout, but not with the run; an empty table gives no rows. Sources are ordered in one task, which
sees one row per source.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotcurve.scratch import stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 17
BINS = 1 << 12
TOLERANCE = 1e-9
MAX_STEPS = 60
# sizes, in means of the source, that part the documents rounded one after another
CLASSES = (8.0, 1.0, 0.0)
ONLY_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ONLY_WORDS)), F.lit(0)).cast("bigint")


def _key(source) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def _exact_sum(value: Column) -> Column:
    """A sum of doubles that is the same in whatever order the rows come, so that
    reruns agree."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """Adds each source's target words to (key, source, source_size, ...).

    All sizes times share are dealt by weight; no source gets more than cap
    times its size, the excess going to the others. With the sources in order
    of cap * size / weight those at their cap come first; the level of the
    others follows from running sums."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("most", F.col("source_size") * float(cap))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    leveled = weighted.withColumn("level", free / F.sum("weight").over(onward)).withColumn(
        "level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
    # the first level that fits is the largest that does
    level = F.coalesce(F.max("level").over(everything), F.lit(float("inf")))
    return leveled.withColumn("target", F.least("most", level * F.col("weight"))).drop("weight", "most", "level")


def _rate(cap: int) -> Column:
    """Rate of a document from its size and its source's row."""
    tilt = F.col("lam") * F.try_divide("size", "mean")
    return F.when(F.col("mean") > 0, F.least(F.lit(float(cap)), F.exp(tilt))).otherwise(F.lit(0.0))


def tilt(counts: DataFrame, sources: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE,
         max_steps: int = MAX_STEPS) -> DataFrame:
    """Adds lam to the sources: Newton on the dual, one aggregation of the
    (key, size, n) counts per step."""
    ratio = F.try_divide("target", "source_size")
    open_ = (F.col("target") > 0) & (F.col("source_size") > 0)
    state = stored(sources.withColumns({
        "lam": F.lit(0.0),
        # the smallest size is 1, so these bounds hold the root for certain
        "low": F.when(open_, F.least(F.lit(0.0), F.log(ratio) * F.col("mean"))).otherwise(F.lit(0.0)),
        "high": F.when(open_, F.log(F.lit(float(cap))) * F.col("mean")).otherwise(F.lit(0.0)),
        "off": F.when(open_, F.abs(ratio - 1)).otherwise(F.lit(0.0))}), "mix-state")
    for _ in range(max_steps):
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        words = F.col("n") * F.col("size")
        rate = _rate(cap)
        sums = counts.join(state.select("key", "mean", "lam"), "key").groupBy("key").agg(
            _exact_sum(words * rate).alias("taken"),
            _exact_sum(F.when((rate < cap) & (F.col("mean") > 0), words * rate * F.try_divide("size", "mean"))
                       .otherwise(0.0)).alias("slope"))
        gap = F.col("taken") - F.col("target")
        step = F.when(F.col("slope") > 0, F.col("lam") - F.try_divide(gap, F.col("slope")))
        moved = state.join(sums, "key", "left").withColumns({
            "off": F.when(F.col("target") > 0, F.coalesce(F.try_divide(F.abs(gap), F.col("target")), F.lit(0.0)))
            .otherwise(F.lit(0.0)),
            "low": F.when(gap < 0, F.col("lam")).otherwise(F.col("low")),
            "high": F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))})
        inside = (step > F.col("low")) & (step < F.col("high"))
        moved = moved.withColumn("lam", F.when(F.col("off") <= tolerance, F.col("lam")).when(inside, step)
                                 .otherwise((F.col("low") + F.col("high")) / 2))
        state = stored(moved.drop("taken", "slope"), "mix-state")
    else:
        if (state.agg(F.max("off")).first()[0] or 0.0) > tolerance:
            raise RuntimeError(f"Newton did not settle within {max_steps} steps")
    return state.drop("low", "high", "off")


def _place(copy: Column, cap: int, seed: int) -> Column:
    """Place of the rounding key of a document's copy among BINS^2 fine bins."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("identity")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    span = 2.0 * cap
    place = F.floor((copy - F.col("rate") - draw + cap) / span * BINS * BINS)
    return F.least(F.greatest(place, F.lit(0)), F.lit(BINS * BINS - 1)).cast("bigint")


def _size_class() -> Column:
    out = F.lit(len(CLASSES) - 1)
    for i in reversed(range(len(CLASSES) - 1)):
        out = F.when(F.col("size") > F.col("mean") * CLASSES[i], F.lit(i)).otherwise(out)
    return out


def _fullest(items: DataFrame, want: DataFrame, bin_: Column) -> DataFrame:
    """Per key the first bin that takes the running sum of words beyond want:
    (key, want, found: bin, mass before it, mass with it)."""
    bins = items.groupBy("key", bin_.alias("bin")).agg(F.sum("size").alias("mass"))
    until = F.sum("mass").over(Window.partitionBy("key").orderBy("bin"))
    over = (
        bins.withColumn("until", until).join(want, "key").filter(F.col("until") > F.col("want"))
        .groupBy("key").agg(F.min(F.struct(
            "bin", (F.col("until") - F.col("mass")).alias("before"), "until")).alias("found")))
    return want.join(over, "key", "left")


def thresholds(sizes: DataFrame, state: DataFrame, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Adds cuts to the sources: per size class the place below which copies
    are taken."""
    items = (
        sizes.join(state.select("key", "mean", "lam"), "key").withColumn("rate", _rate(cap))
        .withColumn("class", _size_class()).filter(F.col("size") > 0))
    expected = items.groupBy("key", "class").agg(_exact_sum(F.col("rate") * F.col("size")).alias("words"))
    carry = state.select("key", F.lit(0.0).alias("carry"))
    top = F.lit(BINS * BINS)
    for c in range(len(CLASSES)):
        copies = items.filter(F.col("class") == c).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.lit(cap)))
        ).select("key", "size", _place(F.col("copy"), cap, seed).alias("place"))
        want = stored(
            carry.join(expected.filter(F.col("class") == c), "key", "left")
            .select("key", (F.coalesce("words", F.lit(0.0)) + F.col("carry")).alias("want")), "mix-want")
        coarse = stored(_fullest(copies, want, F.floor(F.col("place") / BINS)), "mix-coarse")
        inner = coarse.filter(F.col("found").isNotNull()).select(
            "key", F.col("found.bin").alias("outer"), (F.col("want") - F.col("found.before")).alias("want"))
        fine = _fullest(
            copies.join(inner.select("key", "outer"), "key").filter(F.floor(F.col("place") / BINS) == F.col("outer")),
            inner.select("key", "want"), F.col("place"))
        nearer = F.abs(F.col("fine.until") - F.col("inner_want")) < F.abs(F.col("fine.before") - F.col("inner_want"))
        cut = coarse.join(
            fine.select("key", F.col("want").alias("inner_want"), F.col("found").alias("fine")), "key", "left"
        ).select("key", "want", F.when(F.col("found").isNull(), top).otherwise(
            F.col("fine.bin") + F.when(nearer, 1).otherwise(0)).alias("cut"))
        cut = stored(cut, "mix-cut")
        taken = copies.join(cut, "key").filter(F.col("place") < F.col("cut")).groupBy("key").agg(
            F.sum("size").alias("taken"))
        carry = stored(cut.join(taken, "key", "left").select(
            "key", (F.col("want") - F.coalesce("taken", F.lit(0))).alias("carry")), "mix-carry")
        state = state.join(cut.select("key", F.col("cut").alias(f"cut_{c}")), "key")
    return stored(state, "mix-plan")


def fit(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The plan, one row per source, from (identity, source, size)."""
    sizes = sizes.withColumn("key", _key(F.col("source")))
    counts = stored(sizes.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = counts.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    sources = sources.withColumn("mean", F.when(
        F.col("docs") > 0, F.try_divide("source_size", "docs")).otherwise(F.lit(0.0)))
    state = tilt(counts.select("key", "size", "n"), targets(sources, weights, cap, share), cap)
    return thresholds(sizes.select("identity", "key", "size"), state, cap, seed)


def apply_plan(sizes: DataFrame, plan: DataFrame, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Adds source_size, target, rate, copies and taken to rows with identity,
    source and size, in place: only the plan's rows, one per source, move when
    they are few."""
    cut = F.when(F.col("class") == 0, F.col("cut_0"))
    for c in range(1, len(CLASSES)):
        cut = cut.when(F.col("class") == c, F.col(f"cut_{c}"))
    copies = sum((F.when(_place(F.lit(j), cap, seed) < F.col("cut"), 1).otherwise(0) for j in range(1, cap + 1)),
                 F.lit(0))
    return (
        sizes.withColumn("key", _key(F.col("source"))).join(plan.drop("source", "docs"), "key")
        .withColumn("rate", _rate(cap)).withColumn("class", _size_class()).withColumn("cut", cut)
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(
            F.least(F.lit(cap), F.round("rate").cast("int"))))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("bigint"))
        .drop("key", "mean", "lam", "class", "cut", *(f"cut_{c}" for c in range(len(CLASSES)))))


def _facts() -> dict[str, Column]:
    """What the mix needs of a document. identity stands for id and text; row tells equal rows apart."""
    return {"doc_id": F.col("doc_id").cast("bigint"), "source": F.col("source").cast("string"),
            "size": word_count("text"),
            "identity": F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))),
            "row": F.monotonically_increasing_id()}


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in _facts().items()])


def repeated(sizes: DataFrame) -> DataFrame:
    """Identities of more than one row, stored, so that their number decides how they are joined."""
    return stored(sizes.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("identity").alias("repeated")), "mix-repeats")


def told_apart(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows whose identity holds the row number, too, where it is repeated: equal rows are rounded
    one by one and not as a lump."""
    names = [c for c in rows.columns if c not in ("identity", "row")]
    return rows.join(repeats, F.col("identity") == F.col("repeated"), "left").select(*names, F.when(
        F.col("repeated").isNull(), F.col("identity")).otherwise(F.xxhash64("identity", "row")).alias("identity"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of all docs."""
    sizes = stored(sizes_of(docs), "mix-sizes")
    sizes = told_apart(sizes, repeated(sizes))
    return apply_plan(sizes, fit(sizes, weights, cap, share, seed), cap, seed).drop("identity")


def resample(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it, columns as they are.

    Texts stay where they lie; every row works out its own copies."""
    names = docs.columns
    sizes = stored(sizes_of(docs), "mix-sizes")
    repeats = repeated(sizes)
    plan = fit(told_apart(sizes, repeats), weights, cap, share, seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("packed"),
                         *[c.alias(n) for n, c in _facts().items()])
    taken = apply_plan(told_apart(packed, repeats), plan, cap, seed).filter(F.col("copies") > 0)
    # the counter has to stay in the plan until the rows are out
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"packed.`{c}`").alias(c) for c in names])
