"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces, in DataFrame operations only.

A text is the set of its pieces (lines, and sentences within lines), each a 64-bit digest. A sketch has three tables of ``part``
cells each; a digest is in one cell of each table, as a count, an xor of digests and an xor of check hashes. Sketches of one size subtract;
peeling then takes digests out of cells that hold just one, until none is left: these are the pieces in which two texts
differ. Where cells remain, the pair is sketched again four times as large.

A text's fingerprint is its sketch at a size that follows from its own pieces and has room for all of them, so that it can be peeled by
itself. Two fingerprints are compared at the larger of their sizes (the smaller one is peeled and sketched again): see
``compare_fingerprints``, which needs nothing but the two strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.llm.common import prepare, store, store_bucketed

#: The least cells of a table. A table has at least twice as many cells as the text has pieces.
LEAST_PART = 64
#: Rounds of peeling, each over one of the three tables; cells that remain after them count as a failure.
ROUNDS = 6
#: Documents of a block, and ranges of keys in which blocks are laid out by the mean spacing of the keys.
BLOCK_ROWS, RANGES = 256, 64
PIECE_END = r"(?<=[.!?])\s+|[\r\n]+"


def digests(text: Column) -> Column:
    """The distinct digests of a text's pieces (array<bigint>); null and empty texts have none."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), PIECE_END), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def cell(digest: Column, part: Column, t: int) -> Column:
    """The cell of a digest in table t of a sketch with ``part`` cells a table."""
    return F.pmod(F.xxhash64(digest, F.lit(t + 1)), part) + part * t


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(97))


def part_of(found: Column) -> Column:
    """Cells of a table for a set of digests: a power of two, larger where two digests would share all their cells and hide each other.

    (That three or more hide each other is left to chance: below 1e-4 a text of 32 pieces, the more the less.)
    """
    n = F.size(found)
    base = F.greatest(F.lit(LEAST_PART).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)) * 2))).cast("long"))
    # the three cells as one number
    apart = lambda p: F.size(F.array_distinct(F.transform(found, lambda d: F.xxhash64(*[cell(d, p, t) for t in range(3)])))) == n
    return F.when(apart(base), base).when(apart(base * 4), base * 4).otherwise(base * 16)


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, part, d, n) to a row for each cell that a digest is in."""
    return rows.select(*keys, "part", F.explode(F.array(*[cell(F.col("d"), F.col("part"), t) for t in range(3)])).alias("cell"), F.col("n").cast("long").alias("n"), "d", check(F.col("d")).alias("k"))


def peel_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Peel sketches given as rows (keys, part, cell, n, d, k), which add up: keys, only_a (digests with count 1), only_b (-1) and ``left``,
    the number of cells that couldn't be peeled. Empty sketches have no row.

    Every step groups by the keys, so rows that are dealt out by one of them are not dealt again.
    """
    by = [*keys, "part", "cell", "got"]
    state = cells.withColumn("got", F.lit(0).cast("long"))
    for r in range(ROUNDS + 1):
        state = state.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("k").alias("k"))
        state = state.where("n <> 0 or d <> 0 or k <> 0")
        if r == ROUNDS:
            break
        t = r % 3
        part, n, none = F.col("part"), F.col("n"), F.lit(0)
        pure = (F.col("cell") >= part * t) & (F.col("cell") < part * (t + 1)) & (F.abs("n") == 1) & (F.col("k") == check(F.col("d")))
        row = lambda at, n, got: F.struct(at.cast("long").alias("cell"), n.cast("long").alias("n"), F.col("d").alias("d"), F.col("k").alias("k"), got.cast("long").alias("got"))
        # a pure cell gives its digest (kept apart, in cell -1) and takes it from its cells, its own included
        out = [row(F.lit(-1), n, F.col("d")), *[row(cell(F.col("d"), part, u), -n, none) for u in range(3) if u != t]]
        state = state.select(*keys, "part", F.explode(F.when(pure, F.array(*out)).otherwise(F.array(row(F.col("cell"), n, F.col("got"))))).alias("x")).select(*keys, "part", "x.*")
    took = F.col("cell") == -1
    return state.groupBy(*keys).agg(
        F.collect_list(F.when(took & (F.col("n") > 0), F.col("d"))).alias("only_a"), F.collect_list(F.when(took & (F.col("n") < 0), F.col("d"))).alias("only_b"), F.count_if(~took).alias("left"),
    )


def peel(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of pairs of digest sets, by subtracted and peeled sketches.

    pairs: keys (not named n, d, k, cell, part or got), a and b (array<bigint>), part (cells of a table). Returns what peel_cells() does;
    with ``left`` 0 the difference is whole. Pairs without a difference have no row.
    """
    signed = lambda c, s: F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(s).alias("n")))
    rows = pairs.select(*keys, "part", F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("x"))
    return peel_cells(_cells(rows.select(*keys, "part", "x.d", "x.n"), keys), keys)


def cell_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of _cells() summed, with ``s``: cell.count.xor.check in hexadecimal, of the check its upper half; null for a row without a digest."""
    summed = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("k").alias("k"))
    return summed.select(*keys, "cell", F.when(F.col("d").isNotNull(), F.lower(F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex("d"), F.hex(F.shiftrightunsigned("k", 32))))).alias("s"))


def read_fingerprints(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, part, found): the digests of each fingerprint, peeled out of the string; null where it can't be peeled."""
    parsed = rows.select(*keys, F.split(column, ":").alias("f")).select(*keys, F.col("f")[0].cast("long").alias("part"), F.split(F.col("f")[1], "-").alias("cells"))
    cells = parsed.select(*keys, "part", F.explode("cells").alias("c")).where("c <> ''").select(*keys, "part", F.split("c", r"\.").alias("c"))
    number = lambda i: F.conv(F.col("c")[i], 16, -10).cast("long")
    # the string holds half of the check: the digest's own gives the rest where a cell is pure
    cells = cells.select(*keys, "part", number(0).alias("cell"), number(1).alias("n"), F.conv(F.col("c")[2], 16, -10).cast("long").alias("d"), number(3).alias("half"))
    own = check(F.col("d"))
    pure = (F.col("n") == 1) & (F.shiftrightunsigned(own, 32) == F.col("half"))
    # whole checks for all cells: those of the digests found pure somewhere are all that peeling needs
    found = cells.where(pure).select(*keys, "part", "d").distinct()
    rest = cells.select(*keys, "part", "cell", "n", "d", F.shiftleft("half", 32).alias("k"))
    taken = _cells(found.withColumn("n", F.lit(-1)), keys).withColumn("k", F.shiftleft(F.shiftrightunsigned("k", 32), 32))
    left = rest.unionByName(taken)
    while True:
        left = store(left.groupBy(*keys, "part", "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("k").alias("k")).where("n <> 0 or d <> 0 or k <> 0"))
        more = store(left.where((F.col("n") == 1) & (F.shiftrightunsigned(own, 32) == F.shiftrightunsigned("k", 32))).select(*keys, "part", "d").distinct())
        if more.isEmpty():
            break
        found = found.unionByName(more)
        left = left.unionByName(_cells(more.withColumn("n", F.lit(-1)), keys).withColumn("k", F.shiftleft(F.shiftrightunsigned("k", 32), 32)))
    bad = left.select(*keys).distinct().withColumn("_bad", F.lit(True))
    got = found.groupBy(*keys).agg(F.collect_list("d").alias("found"))
    out = parsed.select(*keys, "part").join(got, keys, "left").join(bad, keys, "left")
    return out.select(*keys, "part", F.when(F.col("_bad").isNull(), F.coalesce("found", F.array().cast("array<bigint>"))).alias("found"))


def compare_fingerprints(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, likeness) of two columns of fingerprints: shared pieces of all pieces, 1 for two empty ones; keys are unique and not null."""
    one, two = (read_fingerprints(pairs, keys, c).select(*keys, F.col("part").alias(f"p{n}"), F.col("found").alias(n)) for c, n in ((x, "a"), (y, "b")))
    both = store(one.join(two, keys).withColumn("part", F.greatest("pa", "pb")))
    done, now = [], both
    while True:
        found = store(peel(now.select(*keys, "part", "a", "b"), keys).select(*keys, F.size("only_a").alias("plus"), F.size("only_b").alias("minus"), "left"))
        done.append(found.where("left = 0").drop("left"))
        failed = found.where("left > 0").select(*keys)
        if failed.isEmpty():
            break
        now = store(now.join(failed, keys).withColumn("part", F.col("part") * 4))
    deltas = done[0]
    for more in done[1:]:
        deltas = deltas.unionByName(more)
    return both.join(deltas, keys, "left").select(*keys, _likeness(F.size("a"), F.coalesce("plus", F.lit(0)), F.coalesce("minus", F.lit(0))).alias("likeness"))


def _likeness(n: Column, plus: Column, minus: Column) -> Column:
    return F.when(n + minus > 0, (n - plus) / (n + minus)).otherwise(F.lit(1.0))


def _laid_out(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, doc_id, h, text): blocks follow the order by (doc_id, null first; h, a hash of the text) and hold about BLOCK_ROWS documents.

    Quantiles cut the keys into at most 2 * RANGES ranges, a key that many rows repeat into one of its own; within a range blocks follow the keys' mean
    spacing, within one key (or no key) the hashes'. So neither a few outlying keys nor one frequent key fill a block.
    """
    base = docs.select(F.col(key).try_cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("text"))
    cuts = base.select(F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 2000)).first()
    cuts = cuts[0] or []
    edges = sorted({*cuts, *[c + 1 for c in cuts if cuts.count(c) > 1]})
    # range 0 is that of the null keys; ranges and their figures are looked up in arrays of 2 * RANGES entries at most
    place = F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) + 1
    ranged = base.withColumn("r", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    figures = [(True, -(2.0**63), 2.0**64)] * (len(edges) + 2)
    for r in ranged.groupBy("r").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).collect():
        one = r["low"] == r["high"]  # one key, or none
        low, size = (-(2.0**63), 2.0**64) if one else (float(r["low"]), float(r["high"]) - float(r["low"]) + 1)
        figures[r["r"]] = one, low, size / max(1, r["n"] // BLOCK_ROWS)
    one, low, width = (F.element_at(F.lit([f[i] for f in figures]), F.col("r") + 1) for i in range(3))
    at = F.when(one, F.col("h")).otherwise(F.col("doc_id")).cast("double")
    block = F.col("r").cast("long") * (1 << 40) + F.floor((at - low) / width).cast("long")
    return ranged.select(block.alias("block"), "doc_id", "h", "text")


def with_next(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, rid, doc_id, text, a, next_text, next_a): each document with its pieces' digests and the next's by ascending key (after the last: the first), dealt out by block.

    The texts are dealt out once; a block's first document also goes to the last one of the block before it, two documents a block. Keys that
    aren't integers count as null and come first; equal keys are ordered by a hash of the text, then the text.
    """
    base = _laid_out(docs, key, text)
    # the block after each that has rows: within spans of blocks, then between spans
    blocks = base.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).withColumn("span", F.floor(F.col("block") / 4096))
    spans = blocks.groupBy("span").agg(F.min("block").alias("first"))
    across = Window.orderBy("span")
    spans = spans.select("span", F.lead("first").over(across).alias("_after"), F.min("first").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_begin"))
    within = F.lead("block").over(Window.partitionBy("span").orderBy("block"))
    blocks = store(blocks.withColumn("_in", within).join(spans, "span").select("block", "rows", F.coalesce("_in", "_after", "_begin").alias("after")))
    dealt = base.where("block is not null").repartition(buckets, "block").withColumn("a", digests(F.col("text")))  # the filter that joins add, so that all read one shuffle; for this the union's first side has names of its own, too
    order = Window.partitionBy("block").orderBy("doc_id", "h", "text")
    then = F.lead(F.struct("text", "a")).over(order)
    listed = dealt.select("block", F.row_number().over(order).alias("rid"), "doc_id", "text", "a", then.alias("then"))
    inner = listed.where("then is not null").select(*[F.col(c).alias(c) for c in ("block", "rid", "doc_id", "text", "a")], F.col("then.text").alias("next_text"), F.col("then.a").alias("next_a"))
    lasts = listed.where("then is null").join(blocks.select("block", "after"), "block")
    firsts = listed.where("rid = 1").select(F.col("block").alias("after"), F.col("text").alias("next_text"), F.col("a").alias("next_a"))
    lasts = lasts.join(firsts, "after").select(*inner.columns).repartition(buckets, "block")
    return inner.unionByName(lasts)


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """op2's rows: each document's fingerprint, that of its edited text, and their likeness (shared pieces of all pieces).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document. A null text counts
    as empty; two texts without pieces are alike (1). Rows that repeat a key are documents of their own.
    """
    spark = docs.sparkSession
    prepare(spark)
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.floor(F.length("text_") / 2).cast("int")
    rows = with_next(docs, buckets, key, text).select("block", "rid", "doc_id", F.coalesce("text", F.lit("")).alias("text_"), F.coalesce("next_text", F.lit("")).alias("next_"), "a", F.col("next_a").alias("n"))
    rows = rows.withColumn("edited_", F.concat(F.expr("substring(text_, 1, length(text_) - cast(floor(length(text_) / 2) as int))"), F.substring("next_", F.lit(1), half)))
    rows = rows.select(
        "block", "rid", "doc_id", F.length("text_").cast("long").alias("n_chars"), F.sha2("edited_", 256).alias("edited_sha256"),
        "a", digests(F.col("edited_")).alias("e"), "n",
    )
    rows = store_bucketed(rows.select("*", part_of(F.col("a")).alias("pa"), part_of(F.col("e")).alias("pe"), part_of(F.col("n")).alias("pn")), buckets, "block")
    keys = ["block", "rid", "kind"]

    def attempt(source: DataFrame, kinds: Column, grow: int) -> DataFrame:
        """Sketch and peel the pairs that ``kinds`` lists; returns a row for each with a difference."""
        one = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("b"), (F.greatest("pa", f"p{kind}") * grow).alias("part"))
        pair = F.explode(F.filter(F.array(one("e"), one("n")), kinds))
        found = peel(source.select("block", "rid", "a", pair.alias("p")).select("block", "rid", "a", "p.*"), keys)
        return store(found.select(*keys, F.size("only_a").alias("plus"), F.size("only_b").alias("minus"), "left"))

    done, grow = [], 1
    now = attempt(rows, lambda p: F.lit(True), grow)
    while True:
        done.append(now.where("left = 0"))
        failed = now.where("left > 0")
        if failed.isEmpty():
            break
        grow *= 4
        again = failed.repartition(buckets, "block").groupBy("block").agg(F.collect_set(F.concat_ws(":", "rid", "kind")).alias("again"))  # a block's pairs at most
        now = attempt(rows.join(again, "block"), lambda p: F.array_contains("again", F.concat_ws(":", "rid", p["kind"])), grow)
    deltas = done[0]
    for more in done[1:]:
        deltas = deltas.unionByName(more)
    of_block = deltas.repartition(buckets, "block").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "rid", "kind"), F.struct("plus", "minus")))).alias("deltas"))

    def likeness(kind: str) -> Column:
        d = F.col("deltas")[F.concat_ws(":", "rid", F.lit(kind))]
        return _likeness(F.size("a"), F.coalesce(d["plus"], F.lit(0)), F.coalesce(d["minus"], F.lit(0)))

    head = F.struct("doc_id", "n_chars", "edited_sha256", "pa", "pe", likeness("e").alias("near_edited"), likeness("n").alias("near_next"))
    heads = rows.join(of_block, "block", "left").select("block", F.struct("rid", head.alias("head")).alias("h")).groupBy("block").agg(F.map_from_entries(F.collect_list("h")).alias("heads"))
    both = F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.col("a").alias("ds"), F.col("pa").alias("part")), F.struct(F.lit("e").alias("kind"), F.col("e").alias("ds"), F.col("pe").alias("part"))))
    signed = rows.select("block", "rid", both.alias("v")).select("block", "rid", "v.kind", "v.part", F.explode_outer("v.ds").alias("d"), F.lit(1).alias("n"))
    cells = cell_text(_cells(signed, keys), keys)  # of a text without pieces a row without a digest
    cells = cells.groupBy("block", "rid").agg(*[F.collect_list(F.when((F.col("kind") == k) & F.col("s").isNotNull(), F.struct("cell", "s"))).alias(k) for k in "ae"])
    # heads are small and go by block, so that the sketches stay where they are
    out = cells.join(heads.hint("shuffle_hash"), "block").withColumn("head", F.col("heads")[F.col("rid")])
    text_of = lambda k: F.concat_ws(":", F.col(f"head.p{k}").cast("string"), F.array_join(F.transform(F.sort_array(k), lambda c: c["s"]), "-"))
    return out.select(
        "head.doc_id", "head.n_chars", "head.edited_sha256", text_of("a").alias("fingerprint"), text_of("e").alias("edited_fingerprint"), "head.near_edited", "head.near_next",
    )
