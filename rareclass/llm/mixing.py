"""Mixing sources to target weights with a low-discrepancy schedule (operator 7); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rareclass.llm.shared import stored

#: Odd, next to 2^31 divided by the golden ratio: multiples modulo 2^31 fill [0, 2^31) evenly.
GOLDEN = 1327217885
MODULUS = 1 << 31


def n_words(text: Column) -> Column:
    """Runs of bytes other than space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same keys (``out``).

    Rows are in order of (bucket, order). Buckets are summed first; only their sums are ordered per key, then a window
    runs inside each bucket, so a key that holds most rows is spread over its buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(offsets, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_inside")) \
        .drop("_before", "_inside")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """(source_key, source_size, low, target): shares of the total by weight, none above ``ceiling`` times its size.

    ``sizes`` has source_key and source_size; keys sort by code point. A source is full when the level (target per weight)
    passes ceiling * size / weight. Taken in that order, the full ones are a prefix: the first source not full at the
    level that the rest would get ends it. ``low`` is the sum of targets before it, for cumulative weights.
    """
    order = W.orderBy("source_key")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    whole = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_w", pick).withColumn("_cap", F.lit(float(ceiling)) * F.col("source_size")) \
        .withColumn("_total", F.sum("source_size").over(whole)) \
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = W.orderBy("_ratio", "source_key").rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy("_ratio", "source_key").rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))) / F.sum("_w").over(from_here)
    held = ranked.withColumn("_level", level) \
        .withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    target = F.when(F.col("source_size") == 0, 0.0) \
        .otherwise(F.least(F.col("_cap"), F.col("_w") * F.coalesce(F.col("_final"), F.col("_ratio"))))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return held.withColumn("target", target) \
        .withColumn("low", F.coalesce(F.sum("target").over(before), F.lit(0.0))) \
        .select("source_key", "source_size", "low", "target")


def _bucket(hashed: Column, rows: int, per_bucket: int) -> Column:
    return F.pmod(F.shiftright(hashed, 20), F.lit(max(1, -(-rows // per_bucket)))).cast("int")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3, block_words: int = 1024,
            seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces): every row with its place in its source's stream, and the pieces that the mix takes.

    The rows of a source, shuffled by a hash, form a stream of words cut into blocks of ``block_words``. Slot i of the
    schedule is the golden-ratio point i, mapped through the cumulative targets to a source. A source's k-th slot takes its
    k-th block, starting over at its end; the pass that reaches the target is cut there. Slots that the points leave
    over or short of the whole number of blocks are dropped or added at the end, so each source gives its
    target rounded down to a word.

    ``placed``: the columns doc_id, source, text_key (a hash of the text), size, source_size, target, epochs (whole passes), place (words before the row),
    rest (words of the last pass). ``pieces``: slot, epoch, doc_id, source, place, start, length (words of the row).
    A null source is a source of its own and sorts last; rows without words are placed but give no pieces. Equal rows
    are told apart by their place. Same input, same mix.
    """
    spark = docs.sparkSession
    base = stored(docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("source_key"), F.xxhash64("text").alias("text_key"),
        n_words(F.col("text")).alias("size")), "mix-sizes")
    rows = base.count()
    sizes = base.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, ceiling), "mix-targets")
    facts = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count("*").alias("sources"),
                        F.coalesce(F.sum("target"), F.lit(0.0)).alias("target")).first()

    hashed = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = running_totals(base.withColumn("_h", hashed).withColumn("_bucket", _bucket(F.col("_h"), rows, 256)),
                            ["source_key"], "_bucket", ["_h", "doc_id", "size"], "size", "place").drop("_h", "_bucket")
    per_source = targets.select(
        "source_key", "source_size", "target", "low",
        F.floor("target").alias("goal")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.col("goal") - F.col("epochs") * F.col("source_size")).withColumn(
        "blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
    placed = stored(placed.join(per_source.select("source_key", "source_size", "target", "epochs", "rest"), "source_key"),
                    "mix-placed")

    schedule = stored(slot_schedule(spark, per_source, facts["words"], facts["target"], facts["sources"], block_words),
                      "mix-slots")
    last = F.floor((F.col("place") + F.col("size") - 1) / block_words)
    parts = placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("place") / block_words), last)))
    joined = schedule.join(parts, ["source_key", "block"])
    begin = F.greatest(F.col("place"), F.col("block") * block_words)
    ends = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block_words,
                   F.when(F.col("epoch") < F.col("epochs"), F.col("source_size")).otherwise(F.col("rest")))
    pieces = joined.select("slot", "epoch", "doc_id", "source", "source_key", "place", "size",
                           (begin - F.col("place")).alias("start"), (ends - begin).alias("length")).filter("length > 0")
    return placed, pieces


def slot_schedule(spark, per_source: DataFrame, words: int, target: float, sources: int, block_words: int) -> DataFrame:
    """(slot, source_key, epoch, block): golden-ratio points through cumulative targets, ranked per source."""
    points = -(-words // block_words) + sources
    cells = max(1024, sources)
    width = MODULUS / cells
    at = (F.col("id") % MODULUS * GOLDEN) % MODULUS
    slots = spark.range(points).select(F.col("id").alias("slot"), (at / MODULUS * target).alias("_u"),
                                       F.floor(at / width).cast("int").alias("_cell"))
    share = F.lit(cells / max(target, 1e-300))
    spans = per_source.filter("target > 0").withColumn("_cell", F.explode(F.sequence(
        F.greatest(F.floor(F.col("low") * share - 1e-6), F.lit(0)).cast("int"),
        F.least(F.floor((F.col("low") + F.col("target")) * share + 1e-6), F.lit(cells - 1)).cast("int"))))
    hit = slots.join(spans, "_cell").filter("_u >= low AND _u < low + target") \
        .select("slot", "source_key").withColumn("_one", F.lit(1).cast("long")) \
        .withColumn("_chunk", F.floor(F.col("slot") / 2048).cast("int"))
    ranked = running_totals(hit, ["source_key"], "_chunk", ["slot"], "_one", "rank").select("slot", "source_key", "rank")
    ranked = stored(ranked, "mix-ranked")
    given = ranked.groupBy("source_key").agg(F.count("*").alias("_given"))
    short = per_source.join(given, "source_key", "left").withColumn("_given", F.coalesce("_given", F.lit(0))) \
        .filter("slots > _given").select("source_key", F.explode(F.sequence("_given", F.col("slots") - 1)).alias("rank")) \
        .select((F.lit(points) + F.col("rank")).alias("slot"), "source_key", "rank")
    whole = ranked.unionByName(short).join(per_source.select("source_key", "blocks", "slots"), "source_key") \
        .filter("rank < slots")
    return whole.select("slot", "source_key", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"),
                        F.pmod(F.col("rank"), F.col("blocks")).alias("block"))


def with_taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with the words that the pieces take from each row (``taken``)."""
    sums = pieces.groupBy("source_key", "place", "size").agg(F.sum("length").alias("taken"))
    with_words = placed.filter("size > 0").join(sums, ["source_key", "place", "size"], "left")
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return with_words.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words that the mix takes from it."""
    return with_taken(placed, pieces).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row whose words are taken k times and a part comes k times whole and
    once cut to its first words; rows that the mix leaves out are missing. ``n_chars``, where there is one, is that of the text.

    Rows with equal doc_id, source and text share what is taken from them evenly, rounded down.
    """
    per_key = with_taken(*mixture(docs, **settings)).groupBy("doc_id", "source_key", "text_key") \
        .agg(F.floor(F.sum("taken") / F.count("*")).alias("_mix_taken"), F.max("size").alias("_mix_size")).filter("_mix_taken > 0") \
        .select(F.col("doc_id").alias("_mix_doc_id"), F.col("source_key").alias("_mix_source_key"), F.col("text_key").alias("_mix_text_key"), "_mix_taken", "_mix_size")
    keyed = docs.withColumn("_mix_source", source_key(F.col("source"))).withColumn("_mix_text", F.xxhash64("text"))
    met = keyed.join(per_key, keyed["doc_id"].eqNullSafe(per_key["_mix_doc_id"]) & (F.col("_mix_source") == F.col("_mix_source_key"))
                     & (F.col("_mix_text") == F.col("_mix_text_key")))
    times = met.withColumn("_mix_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_mix_taken") / F.col("_mix_size")))))
    rest = F.col("_mix_taken") - (F.col("_mix_pass") - 1) * F.col("_mix_size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(rest >= F.col("_mix_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " "))
    out = times.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
