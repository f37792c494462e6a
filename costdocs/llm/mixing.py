"""Operator 6: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are hashed into blocks of about ``block_words`` words, so the number of a
block is its place in a random permutation. A source gives whole passes over its blocks and, in
the last pass, the first ones of that pass's order up to its target; only in the block at the
border are documents chosen one by one, so that a source misses its target by less than a document. How many blocks a source gives is its quota. A tree
deals the quotas out to the output shards: a node's blocks are split in two halves of equal size,
and what each source gives to the left half is drawn from the multivariate hypergeometric
distribution, one source after the other, so that every quota is met exactly. A shard then gets
the next blocks of each source, and its rows are shuffled by a hash.

Everything is DataFrame and SQL work. The tables of sources, of blocks and of quotas are the only
ones that are gathered: a row per source, per block of ``block_words`` words and per shard.

Cases: a null or blank text has no words and is never drawn by a target of its own, a null source
is a source, last in order, documents with null ids share a place in the permutation, equal rows
are drawn together. An empty table, or one without words, gives rows with nothing taken. Other
columns are ignored by the plan and kept by :func:`mixture`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costdocs.llm.common import null_safe, staged

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by the sources' order, repeating
    share: float = 1.5  # of all words
    repeats: int = 2  # most passes over a source
    block_words: int = 1 << 18
    shard_words: int = 1 << 24
    seed: int = 20

    def hash(self, label: int, *columns) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(label), *columns)


def _everything(*order) -> Window:
    """A window over a table of sources, which has a row per source."""
    return Window.orderBy(*order)


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_no, source_size, target, blocks) from (source, size).

    The level L at which targets min(repeats * size, L * weight) add up to the wanted total is found
    over the sources in the order in which they reach their limit.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("source_no", F.row_number().over(_everything(F.col("source").isNull(), "source")) - 1)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    sums = sums.withColumn("weight", F.element_at(weights, (F.col("source_no") % len(mix.weights) + 1).cast("int")))
    sums = sums.withColumn("most", mix.repeats * F.col("source_size").cast("double"))
    order = _everything(F.col("most") / F.col("weight"), "source_no")
    sums = sums.withColumn("below", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    whole = _everything().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = mix.share * F.sum("source_size").over(whole)
    level = (total - F.coalesce("below", F.lit(0.0))) / F.col("open")
    # The sources that reach their limit come first; the level is that of the first one that does not.
    sums = sums.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "source_no", "level"))).over(whole)
    target = F.least(F.col("most"), F.coalesce(final["level"] * F.col("weight"), F.col("most")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / mix.block_words)).cast("long")
    return sums.select("source", "source_no", "source_size", target.alias("target"), blocks.alias("blocks"))


def _let(name: str, value: str, body: str) -> str:
    """SQL that gives a value a name within an expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _draw(seed: int) -> str:
    """SQL for the number of source j's blocks, of ``a.n`` left and ``a.m`` to draw, that go left.

    The hypergeometric probabilities within twelve deviations of the mean follow from one another
    by their ratio; the number at which their running sum passes a uniform hash is drawn.
    """
    given = (
        "named_struct('n', cast(a.n as double), 'm', cast(a.m as double), 'k', cast(element_at(counts, j + 1) as double),"
        f" 'u', pmod(xxhash64({seed}, node, j), 9007199254740992) / 9007199254740992D)"
    )
    mean = "p.m * (p.k / greatest(1D, p.n))"
    spread = "12 * sqrt(greatest(0D, p.m * (p.k / greatest(1D, p.n)) * (1 - p.k / greatest(1D, p.n)))) + 12"
    bounds = (
        f"sequence(cast(greatest(0D, p.m - (p.n - p.k), floor({mean} - ({spread}))) as bigint),"
        f" cast(least(p.k, p.m, ceil({mean} + {spread})) as bigint))"
    )
    step = "b.w * ((p.k - i) * (p.m - i)) / ((i + 1D) * (p.n - p.k - p.m + i + 1D))"
    total = f"aggregate(q, named_struct('w', 1D, 's', 0D), (b, i) -> named_struct('w', {step}, 's', b.s + b.w), b -> b.s)"
    found = (
        "aggregate(q, named_struct('w', 1D, 's', 0D, 'x', element_at(q, -1), 'done', false), (b, i) -> named_struct("
        f"'w', {step}, 's', b.s + b.w, 'x', if(not b.done and b.s + b.w > p.u * z, i, b.x), 'done', b.done or b.s + b.w > p.u * z),"
        " b -> b.x)"
    )
    return _let("p", given, _let("q", bounds, _let("z", total, found)))


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source_no, shard, n) for 2^depth shards from one row (node, counts), counts by source."""
    left = (
        "aggregate(if(size(counts) = 0, cast(array() as array<int>), sequence(0, size(counts) - 1)),"
        " named_struct('got', cast(array() as array<bigint>), 'n', aggregate(counts, 0L, (s, x) -> s + x),"
        " 'm', aggregate(counts, 0L, (s, x) -> s + x) div 2), (a, j) -> "
        + _let("x", _draw(seed), "named_struct('got', concat(a.got, array(x)), 'n', a.n - element_at(counts, j + 1), 'm', a.m - x)")
        + ", a -> a.got)"
    )
    halves = "array(named_struct('node', 2 * node, 'counts', left), named_struct('node', 2 * node + 1, 'counts', zip_with(counts, left, (x, y) -> x - y)))"
    nodes = quotas
    for level in range(depth):
        nodes = nodes.withColumn("left", F.expr(left)).select(F.explode(F.expr(halves)).alias("half")).select("half.*")
        if level == 8:
            nodes = nodes.repartition("node")
    shard = (F.col("node") - (1 << depth)).alias("shard")
    return nodes.select(shard, F.posexplode("counts").alias("source_no", "n"))


@dataclass(frozen=True)
class Plan:
    """What :func:`apply` needs: a row per source, and one per block with its draws."""

    sources: DataFrame
    blocks: DataFrame
    mix: Mix


def _placed(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Rows (doc_id, source, …) with their source's row, their block and their place in it."""
    named = sources.withColumnRenamed("source", "_source")
    joined = rows.join(named, null_safe(rows, named, {"source": "_source"}), "left").drop("_source")
    place = F.pmod(mix.hash(1, "doc_id"), F.lit(1 << 53)) / float(1 << 53)
    return joined.withColumn("block", F.floor(place * F.col("blocks"))).withColumn("key", F.struct(mix.hash(2, "doc_id").alias("v"), "doc_id"))


def plan_mix(sizes: DataFrame, mix: Mix = Mix()) -> Plan:
    """Which blocks of each source are drawn, and to which shard each draw goes."""
    sources = staged(source_targets(sizes, mix), "mix-sources")
    docs = _placed(sizes.select("doc_id", "source", "size"), sources, mix)
    words = docs.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.any_value("target").alias("target"), F.any_value("source_size").alias("source_size"))
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    words = words.withColumn("whole", F.least(whole, F.lit(mix.repeats)))
    words = words.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    draws = []
    per_source = F.count("*").over(Window.partitionBy("source_no"))
    for turn in range(mix.repeats):
        order = Window.partitionBy("source_no").orderBy(mix.hash(3 + turn, "source_no", "block"), "block")
        last = F.col("whole") == turn
        before = F.sum("words").over(order) - F.col("words")
        drawn = (F.col("whole") > turn) | (last & (before < F.col("rest")))
        border = last & (before < F.col("rest")) & (before + F.col("words") > F.col("rest"))
        ordinal = turn * per_source + F.row_number().over(order) - 1
        need = F.when(border, F.col("rest") - before)
        draws.append(F.when(drawn, F.struct(F.lit(turn).alias("turn"), ordinal.alias("ordinal"), need.alias("need"))))
    drawn = staged(words.select("source_no", "block", F.array_compact(F.array(*draws)).alias("draws")), "mix-blocks")

    edge = drawn.select("source_no", "block", F.inline("draws")).where("need is not null").select("source_no", "block", "need")
    at_edge = docs.join(staged(edge, "mix-edges"), ["source_no", "block"]).groupBy("source_no", "key", "need").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source_no").orderBy("key"))
    # The documents before the border, and then the largest of the others that still fit, in turn.
    inside = F.col("upto") <= F.col("need")
    other = F.when(~inside & (F.col("size") > 0), F.struct((-F.col("size")).alias("less"), "key.v"))
    limits = at_edge.withColumn("upto", upto).groupBy("source_no").agg(
        F.max(F.when(inside, F.col("key"))).alias("limit"),
        (F.any_value("need") - F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0))).alias("gap"),
        F.array_sort(F.collect_list(other)).alias("others"),
    )
    fill = (
        "aggregate(others, named_struct('gap', gap, 'got', cast(array() as array<bigint>)), (a, d) -> if(a.gap + d.less >= 0,"
        " named_struct('gap', a.gap + d.less, 'got', concat(a.got, array(d.v))), a), a -> a.got)"
    )
    limits = staged(limits.select("source_no", "limit", F.expr(fill).alias("fill")), "mix-limits")

    quotas = drawn.groupBy("source_no").agg(F.sum(F.size("draws")).cast("long").alias("quota"))
    wanted, known = sources.agg(F.sum("target"), F.count("*")).first()
    shards = max(1, int((wanted or 0) / mix.shard_words))
    depth = (shards - 1).bit_length()
    quotas = sources.select("source_no").join(quotas, "source_no", "left").select("source_no", F.coalesce("quota", F.lit(0)).alias("quota"))
    counts = F.transform(F.array_sort(F.collect_list(F.struct("source_no", "quota"))), lambda s: s["quota"])
    root = quotas.agg(counts.alias("counts")).select(F.lit(1).cast("long").alias("node"), "counts")
    leaves = staged(splitting_tree(root, depth, mix.seed).where("n > 0"), "mix-leaves")
    upto_shard = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard"))
    ranges = leaves.withColumn("upto", upto_shard)
    dealt = ranges.select("source_no", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("ordinal"))
    single = drawn.select("source_no", "block", F.inline("draws")).join(dealt, ["source_no", "ordinal"]).join(limits, "source_no", "left")
    entry = F.struct("turn", "shard", F.col("need").isNotNull().alias("border"), "limit", "fill")
    blocks = single.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(entry)).alias("draws"))
    return Plan(sources, staged(blocks, "mix-plan"), mix)


def apply(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows (doc_id, source, …) with ``source_no``, ``source_size``, ``target`` and their draws (turn, shard)."""
    joined = _placed(rows, plan.sources, plan.mix).join(plan.blocks, ["source_no", "block"], "left")
    at_border = lambda d: F.coalesce(F.col("key") <= d["limit"], F.lit(False)) | F.coalesce(F.array_contains(d["fill"], F.col("key.v")), F.lit(False))
    kept = F.filter("draws", lambda d: ~d["border"] | at_border(d))
    draws = F.coalesce(F.transform(kept, lambda d: F.struct(d["turn"].alias("turn"), d["shard"].alias("shard"))), F.array().cast("array<struct<turn:int,shard:bigint>>"))
    return joined.withColumn("draws", draws).drop("block", "blocks", "key")


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def mixed_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, draws) of every row."""
    sizes = staged(word_counts(docs), "sizes")
    return apply(sizes, plan_mix(sizes, mix)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws"
    )


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn rows, as often as they are drawn, shard by shard and shuffled within each."""
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    packed = docs.select("doc_id", "source", whole)
    drawn = apply(packed, plan_mix(staged(word_counts(docs), "sizes"), mix))
    rows = drawn.select("doc_id", "row", F.inline("draws"))
    order = ["shard", mix.hash(99, "shard", "turn", "doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
