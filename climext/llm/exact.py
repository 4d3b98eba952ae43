"""Exact duplicates through an extendible-hash index on shared files; DataFrame functions only.

Definitions for unusual input: a null text counts as empty, so null and empty texts are copies of each other;
a null ``doc_id`` is smaller than any other and stays only if all its copies have none; repeated rows are
copies, and of rows that agree in ``doc_id`` too exactly one is kept; an empty table gives an empty result;
other columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

HASH_BITS = 64
C = F.col


def _slot(depth: int):
    """The directory slot of a row: the leading ``depth`` bits of its 64-bit key."""
    return F.shiftrightunsigned(C("__key"), HASH_BITS - depth) if depth else F.lit(0).cast("long")


def split_buckets(
    leaves: dict[int, tuple[int, int]], depth: int, rows: int, size: int
) -> tuple[list[tuple[int, int, int, int]], int]:
    """Buckets (local depth, prefix, first owner, pages) of the directory, and the number of owners.

    ``leaves`` counts (rows, bytes) of each slot of a directory of ``depth`` bits.  The directory starts with one
    slot and doubles as long as a bucket holds more than ``rows`` rows or ``size`` bytes; a bucket that can't be
    split any more gets a chain of pages.  Owners take neighbouring buckets (a range of keys) until they are
    full; a page has an owner of its own.
    """
    levels = [leaves]
    for _ in range(depth):
        up: dict[int, tuple[int, int]] = {}
        for s, (n, b) in levels[-1].items():
            m, c = up.get(s >> 1, (0, 0))
            up[s >> 1] = (m + n, c + b)
        levels.append(up)
    levels.reverse()  # levels[d]: slots of a directory of d bits
    made, overfull = [], sorted(levels[0])
    for d, level in enumerate(levels):
        fits = [s for s in overfull if d == depth or (level[s][0] <= rows and level[s][1] <= size)]
        made += [(d, s, *level[s]) for s in fits]
        split = set(overfull) - set(fits)
        overfull = [s for x in sorted(split) for s in (2 * x, 2 * x + 1) if d < depth and s in levels[d + 1]]
    made.sort(key=lambda b: b[1] << (depth - b[0]))
    out, owner, held, weight = [], -1, rows, size
    for d, s, n, b in made:
        pages = max(1, -(-n // rows), min(n, -(-b // size)))
        if pages > 1:
            out.append((d, s, owner + 1, pages))
            owner, held = owner + pages, rows
        elif held + n > rows or weight + b > size:
            owner, held, weight = owner + 1, n, b
            out.append((d, s, owner, 1))
        else:
            held, weight = held + n, weight + b
            out.append((d, s, owner, 1))
    return out, owner + 1


def _directory(rows: DataFrame, bucket_rows: int, bucket_bytes: int, max_depth: int) -> tuple[DataFrame, int, bool]:
    """(slot, first owner, pages), the number of owners, and whether a bucket has several pages.

    Counts of 2**max_depth slots at most come to the driver, whatever the input; buckets grow with the input
    beyond ``bucket_rows`` only where so many slots don't suffice.
    """
    found = rows.groupBy(_slot(max_depth).alias("s")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    leaves = {r["s"]: (r["n"], r["b"]) for r in found.collect()}
    total, size = (sum(x) for x in zip(*leaves.values(), strict=True)) if leaves else (0, 0)
    least = lambda most, x: max(most, x >> max_depth)
    buckets, owners = split_buckets(leaves, max_depth, least(bucket_rows, total), least(bucket_bytes, size))
    frame = rows.sparkSession.createDataFrame(buckets, "depth int, prefix long, first int, pages int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(max_depth) - C("depth"))
    slots = F.explode(F.sequence(C("prefix") * low, (C("prefix") + 1) * low - 1)).alias("__slot")
    return frame.select(slots, "first", "pages"), owners, any(p > 1 for *_, p in buckets)


def exact_groups(
    docs: DataFrame, bucket_rows: int = 5000, bucket_bytes: int = 64 << 20, max_depth: int = 16, hash_bits: int = HASH_BITS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, chain: one row for each row of ``docs``.

    1. Directory: from the counts of key prefixes, doubled until no bucket is overfull.
    2. Owner tasks: a row goes to the task that owns its bucket, a range of keys; the rows of a bucket that can't
       be split (one text with a great many copies) are dealt over its pages' owners.  The owner sorts its rows
       by key and text: rows of one key make a chain, rows of one chain whose bytes agree are copies.
    3. The owners write what they found as the index: one shared file each, in key order.
    4. Pages of one bucket are merged: the first row of each page's copies, with its bytes, meets those of the other
       pages, and what is found goes back to the pages' rows.

    ``hash_bits`` under 64 is for tests of chaining.
    """
    text = F.coalesce(C("text").cast("string"), F.lit(""))
    key = F.xxhash64(text)
    if hash_bits < HASH_BITS:
        key = F.shiftleft(key, HASH_BITS - hash_bits)
    rows = docs.select(C("doc_id").cast("long").alias("__id"), key.alias("__key"), text.alias("text"))
    directory, owners, paged = _directory(rows, bucket_rows, bucket_bytes, max_depth)
    turn = F.pmod(F.xxhash64("__row"), C("pages")).cast("int")
    owned = (
        rows.withColumns({"__row": F.monotonically_increasing_id(), "__slot": _slot(max_depth)})
        .join(F.broadcast(directory), "__slot")
        .select("__id", "__row", "__key", "text", "pages", (C("first") + turn).alias("__owner"))
        .repartitionById(max(1, owners), C("__owner"))
    )
    same = Window.partitionBy("__owner", "__key", "text")
    best = same.orderBy(C("__id").desc_nulls_last(), "__row")
    chain = Window.partitionBy("__owner", "__key").orderBy("text", C("__id").desc_nulls_last(), "__row").rowsBetween(Window.unboundedPreceding, 0)
    index = (
        owned.withColumns(
            {"nth": F.row_number().over(best), "keep_id": F.first("__id").over(best), "keep_row": F.first("__row").over(best)}
        )
        .withColumns({"chain": F.count_if(C("nth") == 1).over(chain) - 1, "group_size": F.count("*").over(same)})
        .withColumns({"text_sha256": F.sha2("text", 256), "head": F.when((C("pages") > 1) & (C("nth") == 1), C("text"))})
        .drop("text", "nth")
    )
    index = materialize(index, "index")
    shown = [
        C("__id").alias("doc_id"),
        "keep_id",
        "group_size",
        (C("keep_row") == C("__row")).alias("kept"),
        "text_sha256",
        C("chain").cast("int").alias("chain"),
    ]
    if not paged:
        return index.select(*shown)
    spread = index.where("pages > 1")
    heads = spread.where("head is not null").select("__owner", "__key", "chain", "head", "keep_id", "keep_row", "group_size")
    first = F.max(F.struct(C("keep_id").isNotNull(), "keep_id", (-C("keep_row")).alias("r")))
    classes = heads.groupBy("__key", "head").agg(first.alias("best"), F.sum("group_size").alias("n"))
    classes = classes.withColumn("place", F.row_number().over(Window.partitionBy("__key").orderBy("head")) - 1)
    merged = heads.select("__owner", "__key", C("chain").alias("at"), "head").join(classes, ["__key", "head"])
    merged = materialize(
        merged.select(
            "__owner", "__key", "at", C("best.keep_id").alias("keep_id"), (-C("best.r")).alias("keep_row"),
            C("n").alias("group_size"), C("place").alias("chain"),
        ),
        "pages",
    )
    rest = spread.select("__owner", "__key", C("chain").alias("at"), "__id", "__row", "text_sha256")
    return (
        index.where("pages = 1").select(*shown).unionByName(rest.join(merged, ["__owner", "__key", "at"]).select(*shown))
    )


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest ``doc_id``."""
    groups = materialize(exact_groups(docs, **how), "groups")
    stay = groups.where("kept").select(C("doc_id").alias("__stay_id"), C("text_sha256").alias("__stay_sha"))
    named = docs.withColumns(
        {
            "__dedup_id": C("doc_id").cast("long"),
            "__dedup_sha": F.sha2(F.coalesce(C("text").cast("string"), F.lit("")), 256),
        }
    )
    same = (C("__dedup_sha") == C("__stay_sha")) & C("__dedup_id").eqNullSafe(C("__stay_id"))
    out = named.join(stay, same, "left_semi")
    if not groups.where("not kept and doc_id <=> keep_id").isEmpty():  # repeated rows of a kept id
        out = out.dropDuplicates(["__dedup_id", "__dedup_sha"])
    return out.drop("__dedup_id", "__dedup_sha")
