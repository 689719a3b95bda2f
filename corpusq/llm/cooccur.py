"""Problem 5: items that appear together.

Stripes: for each item an associative array of the items beside it, built and merged in the mappers, then
merged by key, then judged by Dunning's log-likelihood ratio. The stripe of a hot item is cut into slots by
its neighbours' hash, in proportion to its pages, and a page of very many items into pairs of blocks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, stage

#: Latin letters that look like Cyrillic ones, upper case, and dashes.
LATIN_LOOKS = "ABEKMHOPCTXY"
CYRILLIC_LOOKS = "АВЕКМНОРСТХУ"
DASHES = "\\u2010-\\u2015\\u2212\\u00ad\\ufe58\\ufe63\\uff0d"
#: A mapper keeps at most so many counts before it sends its stripes on.
STRIPE_CELLS = 2_000_000
#: A stripe has one slot for so many pages of its item.
SLOT_PAGES = 20_000
#: A page of more items is cut into blocks of about so many.
PAGE_ITEMS = 1_000


def item_name(kind: Column, name: Column) -> Column:
    """``type:NAME`` in upper case, no outer spaces, no punctuation at the end, plain dashes, Cyrillic look-alikes."""
    n = F.upper(name)
    n = F.regexp_replace(n, f"[{DASHES}]", "-")
    n = F.translate(n, LATIN_LOOKS, CYRILLIC_LOOKS)
    n = F.regexp_replace(n, "(?U)^\\s+|[\\s\\p{P}\\p{S}]+$", "")
    return F.concat(kind, F.lit(":"), n)


def page_items(entities: DataFrame) -> DataFrame:
    """Distinct (source_file, page, item). Rows with a null in any used column, or an empty name, are left out."""
    return (
        entities.select("source_file", "page", item_name(F.trim("type"), F.col("name")).alias("item"))
        .filter(F.col("source_file").isNotNull() & F.col("page").isNotNull() & F.col("item").isNotNull() & ~F.col("item").endswith(":"))
        .distinct()
    )


_STRIPE = "item_a string, slot int, beside array<string>, counts array<bigint>"


def _rows(stripes: list[tuple[str, int, dict[str, int]]]) -> pa.RecordBatch:
    names, slots, cells = zip(*stripes) if stripes else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array(slots, pa.int32()),
            pa.array([list(c.keys()) for c in cells], pa.list_(pa.string())),
            pa.array([list(c.values()) for c in cells], pa.list_(pa.int64())),
        ],
        names=["item_a", "slot", "beside", "counts"],
    )


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """items (sorted), slots (of each item's stripe), sides (null, or which of two blocks it is in): stripes, merged in this
    task. A stripe holds the neighbours that sort after its item, on a page cut in two blocks those of the other one."""
    stripes: dict[str, tuple[int, Counter]] = {}
    cells = 0

    def flush() -> Iterator[pa.RecordBatch]:
        out = []
        for a, (slots, all_cells) in stripes.items():
            if slots == 1:
                out.append((a, 0, all_cells))
            else:
                cut: dict[int, dict[str, int]] = defaultdict(dict)
                for b, c in all_cells.items():
                    cut[crc32(b.encode()) % slots][b] = c
                out += [(a, k, x) for k, x in cut.items()]
            if len(out) >= 256:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)
        stripes.clear()

    for batch in batches:
        for items, slots, sides in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for i, a in enumerate(items[:-1]):
                s = stripes.get(a)
                if s is None:
                    s = stripes[a] = (slots[i], Counter())
                before = len(s[1])
                s[1].update(items[i + 1 :] if sides is None else [b for b, side in zip(items[i + 1 :], sides[i + 1 :]) if side != sides[i]])
                cells += len(s[1]) - before
                if cells > STRIPE_CELLS:
                    yield from flush()
                    cells = 0
    yield from flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stripes sorted by item and slot: one array for each, its cells as rows."""
    at: tuple | None = None
    here: Counter = Counter()

    def cells() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * len(here), pa.string()), pa.array(list(here), pa.string()), pa.array(list(here.values()), pa.int64())], names=["item_a", "item_b", "shared"]
        )

    for batch in batches:
        done = []
        for a, slot, beside, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != (a, slot):
                if here:
                    done.append(cells())
                at, here = (a, slot), Counter()
            for b, c in zip(beside, counts):
                here[b] += c
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if here:
        yield cells()


def co_occurrences(entities: DataFrame, min_shared: int = 1, min_share: float = 0.0, min_lift: float = 0.0, min_llr: float | None = None, page_items_most: int = PAGE_ITEMS) -> DataFrame:
    """Pairs of items on the same page, with counts, lift and log-likelihood ratio.

    ``shared`` >= max(min_shared, min_share * pages), shared * pages >= min_lift * pages(a) * pages(b), and llr >=
    ``min_llr`` where more are shared than chance gives (3.84: significant at 5 %). An item on fewer pages than a
    pair needs can't be in one, so it is dropped before the stripes. A page of more than ``page_items_most`` items is
    cut into blocks and each two of them are one list, so neither a page nor a stripe is one task's alone.
    """
    ship(entities.sparkSession)
    items = stage(page_items(entities), "p5-items")
    on_page = items.groupBy("source_file", "page").agg(F.count(F.lit(1)).alias("m"))
    total = on_page.agg(F.count(F.lit(1)).alias("n"))
    freq = items.groupBy("item").agg(F.count(F.lit(1)).alias("pages"))
    need = F.greatest(F.lit(float(min_shared)), F.lit(min_share) * F.col("n"))
    # one row of counts, so this join is with a single row
    kept = stage(freq.join(F.broadcast(total)).filter(F.col("pages") >= need), "p5-kept")
    slots = (F.lit(1) + F.floor(F.col("pages") / SLOT_PAGES)).cast("int")
    used = items.join(kept.select("item", slots.alias("slots")), "item")
    page = ["source_file", "page"]
    large = on_page.filter(F.col("m") > page_items_most).select(*page, F.ceil(F.col("m") / page_items_most).cast("int").alias("blocks"))
    entry = F.sort_array(F.collect_list(F.struct("item", "slots", "side"))).alias("x")
    small = used.join(large, page, "left_anti").withColumn("side", F.lit(0)).groupBy(*page).agg(entry).withColumn("cut", F.lit(False))
    block = used.join(large, page).withColumn("side", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    other = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("side", "o"), "hi": F.greatest("side", "o")})
    cut = other.groupBy(*page, "lo", "hi").agg(entry).select(*page, "x", (F.col("lo") != F.col("hi")).alias("cut"))
    lists = small.unionByName(cut).filter(F.size("x") > 1).select("x.item", "x.slots", F.when(F.col("cut"), F.col("x.side")).alias("side"))
    stripes = lists.mapInArrow(_stripes, _STRIPE)
    pairs = stripes.repartition("item_a", "slot").sortWithinPartitions("item_a", "slot").mapInArrow(_merged, "item_a string, item_b string, shared bigint")
    a = kept.select(F.col("item").alias("item_a"), F.col("pages").alias("pages_a"), "n")
    b = kept.select(F.col("item").alias("item_b"), F.col("pages").alias("pages_b"))
    llr = log_likelihood(F.col("shared"), F.col("pages_a"), F.col("pages_b"), F.col("n"))
    out = (
        pairs.filter(F.col("shared") >= min_shared)
        .join(a, "item_a")
        .join(b, "item_b")
        .filter((F.col("shared") >= need) & (F.col("shared") * F.col("n") >= F.lit(min_lift) * F.col("pages_a") * F.col("pages_b")))
        .withColumn("llr", llr)
    )
    if min_llr is not None:
        out = out.filter((F.col("llr") >= min_llr) & (F.col("shared") * F.col("n") > F.col("pages_a") * F.col("pages_b")))
    return out.select(
        "item_a",
        "item_b",
        "shared",
        "pages_a",
        "pages_b",
        F.col("n").alias("pages"),
        (F.col("shared") * F.col("n") / (F.col("pages_a") * F.col("pages_b"))).alias("lift"),
        "llr",
    )


def log_likelihood(k: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's G2 of the 2x2 table of two items over n pages."""

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x.cast("double"))).otherwise(F.lit(0.0))

    cells = [k, a - k, b - k, n - a - b + k]
    return 2.0 * (sum((xlogx(c) for c in cells), F.lit(0.0)) + xlogx(n) - xlogx(a) - xlogx(n - a) - xlogx(b) - xlogx(n - b))
