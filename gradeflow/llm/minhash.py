"""Near-duplicate detection: b-bit MinHash with bands, exact confirmation and components.

1. ``fingerprints``: per text the set of hashed word shingles, its 128-bit digest, ``K`` minima of
   permuted hashes, band keys of :func:`rows_for` minima each, and the lowest two bits of every
   minimum packed into 64-bit words.  Stored once in the shared folder.
2. Texts with equal sets form a class; only classes go on, so copies cost one row each.
3. Per band key the smallest class is the pivot.  Members meet their pivot, never each other: one
   pair per member and bucket.  Pairs are kept if the similarity estimated by bit counts, corrected
   for chance agreement of two bits, is at most ``SLACK`` below the threshold.  A member unlike its
   pivot is tried against all of a bucket of at most ``WIDE``; in a wider one its pair is kept as it
   is, for the full sets to decide.  So no candidate is lost and pairs grow with members.
4. Components of candidate pairs are families: all links lie inside them.  A family is dealt into
   blocks of at most ``BLOCK`` classes, each with a few members common to all blocks; a task joins
   what it can within a block, comparing full shingle sets, and skips pairs already connected.  In
   families of several blocks the classes outside the largest part then meet all blocks.  So the
   work on a large group of near copies is linear unless it falls into many parts.
5. Components of confirmed links give each document the smallest id reachable.

A linked pair with similarity s is missed with probability (1 - s^rows)^bands.  At the threshold that
is at most ``MISSED``: 3e-6 at 0.85 (8 minima a band, 40 bands), 1e-7 at 0.80 (6 minima, 53 bands).

Nulls and empties: a null or wordless text has an empty set and is linked with nothing.  A null id
counts as larger than any other; a component of null ids has a null ``component_id``.  Of repeated
rows of the kept id one is kept.  Extra columns are ignored.  Pairs of a million copies cost nothing
beyond one row each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import broadcast_if_small, connected_components
from gradeflow.session import checkpointed

K, BITS = 320, 2
#: The highest probability of missing a pair at the threshold.
MISSED = 1e-5
SLACK, WIDE = 0.2, 16
#: Classes, and shingles, of one block of a family; members shared by all blocks of a family.
BLOCK, BLOCK_SHINGLES, SHARED = 256, 4_000_000, 8
FINGERPRINT = "n long, digest string, bands array<long>, bits array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles of a text, A-Z lower-cased.

    Fewer words, but not none, are one shingle; no words give an empty set.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = _mix(hashes[: len(hashes) - n + 1])
    for i in range(1, n):
        out = _mix(out * np.uint64(31) + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(out)


def minima(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a non-empty set, in blocks of bounded memory."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2048):
        values = short[None, i : i + 2048] * factors[:, None]
        values += shifts[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, K, dtype=np.uint32)


def pack_bits(least: np.ndarray) -> np.ndarray:
    """The ``BITS`` low bits of all minima as bit planes of 64-bit words."""
    planes = [np.packbits(((least >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)) for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def rows_for(percent: int) -> int:
    """The most minima a band may have for pairs at the threshold to be missed by ``MISSED`` at most."""
    fits = [r for r in range(1, K + 1) if (1 - (percent / 100) ** r) ** (K // r) <= MISSED]
    return max(fits, default=1)


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = K // rows
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for part in least[: bands * rows].reshape(bands, rows).T:
        keys = _mix(keys * np.uint64(31) + part.astype(np.uint64))
    return keys.view(np.int64)


def _fingerprint_udf(n: int, band_rows: int):
    @F.pandas_udf(FINGERPRINT)
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        factors, shifts = permutations()
        rows = []
        for text in texts:
            shingles = shingle_set(text, n)
            if len(shingles):
                least = minima(shingles, factors, shifts)
                rows.append((len(shingles), xxhash.xxh3_128_hexdigest(shingles.tobytes()), band_keys(least, band_rows), pack_bits(least)))
            else:
                rows.append((0, None, None, None))
        return pd.DataFrame(rows, columns=["n", "digest", "bands", "bits"])

    return fingerprint


def fingerprints(
    documents: DataFrame, n: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Stored (row, id, textkey, n, digest, bands, bits), one row per document; ``row`` is unique."""
    prints = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("id"),
        F.md5(F.col(text)).alias("textkey"),
        _fingerprint_udf(n, rows_for(percent))(F.col(text).cast("string")).alias("f"),
    ).select("row", "id", "textkey", "f.*")
    return checkpointed(documents.sparkSession, prints, "fingerprints")


def estimated(a: Column, b: Column) -> Column:
    """Similarity from the packed bits: the share of equal minima, corrected for chance."""
    words = K // 64
    unequal = F.lit(0)
    for w in range(words):
        planes = [a[p * words + w].bitwiseXOR(b[p * words + w]) for p in range(BITS)]
        either = planes[0]
        for plane in planes[1:]:
            either = either.bitwiseOR(plane)
        unequal = unequal + F.bit_count(either)
    chance = 2.0**-BITS
    return ((K - unequal) / F.lit(float(K)) - chance) / (1 - chance)


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, ...) with ``close``: sizes and estimate allow the similarity."""
    side = classes.select("node", "n", "bits")
    one, two = (side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]) for s in "ab")
    joined = pairs.join(one, pairs["a"] == one["node_a"]).join(two, pairs["b"] == two["node_b"])
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near = estimated(F.col("bits_a"), F.col("bits_b")) >= percent / 100 - SLACK
    return joined.select(*pairs.columns, (fits & near).alias("close"))


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of classes whose components contain every linked pair that shares a band."""
    spark = classes.sparkSession
    members = classes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    starred = checkpointed(
        spark,
        members.join(buckets, "band").filter("node != pivot").select("band", "size", F.col("node").alias("a"), F.col("pivot").alias("b")),
        "buckets",
    )
    pairs = checkpointed(spark, _close(starred.select("a", "b").distinct(), classes, percent), "pairs")
    far = pairs.filter(~F.col("close")).select("a", "b")
    left = starred.filter("size > 2").join(far, ["a", "b"], "left_semi")
    few = F.col("size") <= WIDE
    others = starred.filter(few).select("band", F.col("a").alias("b"))
    more = (
        left.filter(few)
        .select("band", "a")
        .join(others, "band")
        .filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    near = _close(more.distinct(), classes, percent).filter("close").select("a", "b")
    return pairs.filter("close").select("a", "b").unionByName(near).unionByName(left.filter(~few).select("a", "b"))


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= percent * (len(left) + len(right) - common)


def _link_group(n: int, percent: int):
    """Within one group of classes: links that join its parts, found by comparing full sets."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values(["n", "node"]).reset_index(drop=True)
        sets = [shingle_set(text, n) for text in rows["text"]]
        bits = np.vstack(rows["bits"].to_list()).astype(np.int64).view(np.uint64)
        words, sizes, nodes = K // 64, rows["n"].to_numpy(), rows["node"].to_numpy()
        part = np.unique(rows["part"].to_numpy(), return_inverse=True)[1]
        links = []
        for i in range(len(rows) - 1):
            unequal = np.bitwise_count(
                np.bitwise_or.reduce([bits[i + 1 :, p * words : (p + 1) * words] ^ bits[i, p * words : (p + 1) * words] for p in range(BITS)])
            ).sum(axis=1)
            near = ((K - unequal) / K - 2.0**-BITS) / (1 - 2.0**-BITS) >= percent / 100 - SLACK
            for j in i + 1 + np.flatnonzero(near & (100 * sizes[i] >= percent * sizes[i + 1 :])):
                if part[i] != part[j] and _linked(sets[i], sets[j], percent):
                    part[part == part[j]] = part[i]
                    links.append((nodes[i], nodes[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return link


def _links(grouped: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links within groups: ``grouped`` has (family, i, j, node, part), ``members`` the texts."""
    return (
        grouped.join(members.select("node", "n", "bits", "text"), "node")
        .groupBy("family", "i", "j")
        .applyInPandas(_link_group(n, percent), "a long, b long")
    )


def confirmed_links(members: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) links that connect all linked classes; ``members``: node, family, n, bits, text."""
    spark = members.sparkSession
    sizes = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    dealt = members.select("family", "node").join(sizes, "family")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # The smallest nodes of a family of several blocks go to all its blocks.
    shared = (
        dealt.filter("blocks > 1")
        .groupBy("family", "blocks", F.pmod(F.hash("node"), F.lit(SHARED)).alias("slot"))
        .agg(F.min("node").alias("node"))
        .select("family", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    )
    first = dealt.select("family", "node", block.alias("i")).unionByName(shared).distinct()
    first = first.select("family", "i", F.lit(-1).alias("j"), "node", F.col("node").alias("part"))
    links = checkpointed(spark, _links(first, members, n, percent), "links")
    wide = checkpointed(spark, dealt.filter("blocks > 1"), "wide")
    if not wide.limit(1).count():
        return links
    parts = connected_components(links)
    wide = wide.join(parts, "node", "left").select(
        "family", "node", "blocks", F.coalesce("root", "node").alias("part")
    )
    weights = wide.groupBy("family", "part").count().groupBy("family").agg(
        F.max(F.struct("count", "part"))["part"].alias("main"), F.sum("count").alias("total"), F.max("count").alias("most")
    )
    wide = wide.join(weights.filter("total > most"), "family").withColumn("outside", F.col("part") != F.col("main"))
    outer = F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int")
    wide = wide.select(
        "family", "node", "part", "outside", "blocks", outer.alias("outer"),
        F.pmod(F.xxhash64("node"), F.when(F.col("outside"), outer).otherwise(F.col("blocks"))).cast("int").alias("at"),
    )
    # Outside blocks meet each other (i <= j) and every main block (numbered from -blocks to -1).
    every = F.sequence(F.lit(0), F.col("outer") - 1)
    meets = F.when(
        F.col("outside"),
        F.concat(
            F.transform(every, lambda k: F.struct(F.least(k, F.col("at")).alias("i"), F.greatest(k, F.col("at")).alias("j"))),
            F.transform(F.sequence(F.lit(1), F.col("blocks")), lambda k: F.struct((-k).alias("i"), F.col("at").alias("j"))),
        ),
    ).otherwise(F.transform(every, lambda k: F.struct((-F.col("at") - 1).alias("i"), k.alias("j"))))
    second = wide.select("family", "node", "part", F.explode(meets).alias("m")).select("family", "m.i", "m.j", "node", "part")
    return links.unionByName(_links(second, members, n, percent))


def _rooted(documents: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Fingerprints with ``root``, the component as the smallest row of a class in it."""
    spark = documents.sparkSession
    prints = fingerprints(documents, n, percent, doc_id, text)
    classes = checkpointed(
        spark,
        prints.filter("n > 0")
        .groupBy("digest")
        .agg(
            F.min_by(F.struct("id", "textkey", "n", "bands", "bits"), "row").alias("f"),
            F.min("row").alias("node"),
            F.count("*").alias("copies"),
        )
        .select("digest", "node", "copies", "f.*"),
        "classes",
    )
    pairs = checkpointed(spark, candidates(classes, percent), "candidates")
    families = connected_components(pairs).withColumnRenamed("root", "family")
    chosen = families.join(classes.select("node", "id", "textkey", "n", "bits"), "node")
    texts = documents.select(
        F.col(doc_id).alias("own_id"), F.md5(F.col(text)).alias("own_key"), F.col(text).cast("string").alias("text")
    )
    # Ids and digests of texts that are asked for: counted, and broadcast while they are few, so that
    # only those texts move.
    wanted = broadcast_if_small(chosen.select(F.col("id").alias("wanted_id"), F.col("textkey").alias("wanted_key")))
    asked = texts["own_id"].eqNullSafe(wanted["wanted_id"]) & (texts["own_key"] == wanted["wanted_key"])
    texts = texts.join(wanted, asked, "left_semi")
    # One row of each class is fetched, not its copies.
    same = chosen["id"].eqNullSafe(texts["own_id"]) & (chosen["textkey"] == texts["own_key"])
    members = chosen.join(texts, same).dropDuplicates(["node"]).select("node", "family", "n", "bits", "text")
    links = checkpointed(spark, confirmed_links(checkpointed(spark, members, "members"), n, percent), "links")
    roots = connected_components(links)
    grouped = (
        classes.select("digest", "node", "copies")
        .join(roots, "node", "left")
        .filter("copies > 1 or root is not null")
        .select("digest", F.coalesce("root", "node").alias("root"))
    )
    # Only classes with copies or links are looked up; any other document is its own component.
    return (
        prints.select("row", "id", "textkey", "n", F.coalesce("digest", F.col("row").cast("string")).alias("digest"))
        .join(grouped, "digest", "left")
        .select("row", "id", "textkey", "n", "root")
    )


def near_duplicates(
    documents: DataFrame, n: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and textkey (MD5 of its text)."""
    rooted = _rooted(documents, n, percent, doc_id, text)
    first = (
        rooted.filter("root is not null")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    )
    together = rooted.join(first, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("first")["id"])
    return together.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("root").isNull() | (F.col("first")["row"] == F.col("row"))).alias("kept"),
        "textkey",
    )


def drop_near_duplicates(
    documents: DataFrame, n: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``documents`` with one row of each component, the one with the smallest id.

    Rows that are kept are found again by id and text; where such a pair is repeated, one row stays
    of those that belong to a component, and rows without words all stay.
    """
    spark = documents.sparkSession
    found = checkpointed(spark, near_duplicates(documents, n, percent, doc_id, text), "near-duplicates")
    same = [F.col("id").eqNullSafe(F.col("kept_id")), F.col("textkey").eqNullSafe(F.col("kept_key"))]
    kept = found.filter(F.col("kept")).select(F.col(doc_id).alias("kept_id"), F.col("textkey").alias("kept_key"), "n_shingles")
    rows = documents.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), F.md5(F.col(text)).alias("textkey"))
    stay = rows.join(kept.distinct(), same, "left_semi")
    repeated = (
        found.filter("n_shingles > 0")
        .groupBy(F.col(doc_id).alias("kept_id"), F.col("textkey").alias("kept_key"))
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .select("kept_id", "kept_key")
    )
    if not repeated.limit(1).count():
        return stay.select("doc.*")
    once = stay.join(repeated, same, "left_anti")
    many = stay.join(repeated, same, "left_semi")
    one = many.groupBy("id", "textkey").agg(F.first("doc").alias("doc"))
    return once.select("doc.*").unionByName(one.select("doc.*"))
