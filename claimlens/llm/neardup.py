"""MinHash near-duplicates (2): circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct 5-word shingles (64-bit hashes). Circulant
MinHash needs two permutations only: the first scatters the shingles over
[0, 2^32), the second, shifted circularly by k, orders them for signature
coordinate k, so coordinate k is ``min over v of second(first(v) + k mod 2^32)``.
128 coordinates form 32 bands of 4: a pair at Jaccard 0.75 shares no band with
probability 5e-6.

No group is ever expanded into all its pairs, and no pair within one component
needs a second look:

1. Documents with equal sets become one class, represented by its smallest id.
2. In every bucket the members are compared with the bucket's smallest member
   only; confirmed links give components.
3. In buckets that still hold several components, members are compared with the
   bucket's most central member, the one whose set occurs elsewhere the most
   (of a family of edited copies, one close to the original).
4. Members outside the bucket's largest component are then compared with all
   members of other components, unless a bound rules a link out: the part of a
   set that occurs anywhere else among these members limits its intersections,
   and a sketch of 1024 bits rules out what is far below the similarity. A
   bucket with more than ``HOT`` such outsiders is first divided by its members'
   leading shingles (the rarest quarter of each set, of which every linked pair
   shares one), so large buckets of texts that merely share a passage fall apart
   and no link is left out. There is no cap on candidates, and both can be
   turned off.

Links are confirmed on the full sets: 100 * intersection >= 75 * union.

Defined results: null and empty texts and texts without words have an empty set
and are linked with nothing; fewer than five words form one shingle; repeated
rows are copies; rows that share a doc_id are one document in the components,
each returned on its own; a row without a doc_id is linked with nothing, has a
null component and is kept; an empty table gives no rows; extra columns are not
read, and pass through ``kept_rows`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.components import components
from claimlens.llm.stage import staged

BANDS, ROWS = 32, 4
HOT = 4096
PERCENT = 75
SKETCH = 1024     # one-bit coordinates that rule pairs out
MOST_UNLIKE = 175  # of these may differ: at similarity 0.75 more do with probability 3e-6
_LONGS = [f"s{i}" for i in range(SKETCH // 64)]

_S1, _S2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
_P1, _P2 = np.uint32(0x21F0AAAD), np.uint32(0x735A2D97)


def _permute(x: np.ndarray, a: np.uint32, b: np.uint32) -> np.ndarray:
    """A permutation of the 32-bit integers: each step (xor-shift, odd factor) can be undone."""
    x = (x ^ (x >> np.uint32(16))) * a
    x = (x ^ (x >> np.uint32(15))) * b
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes."""
    first = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), _S1, _S2)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    for at in range(0, len(first), 2048):  # 1 MB at a time, whatever the text's length
        out = np.minimum(out, _permute(first[None, at:at + 2048] + shifts, _P1, _P2).min(axis=1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = W.mix(total ^ parts[:, k]) + np.uint64(k)
    return W.mix(total).view(np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, an order-free 128-bit key of the set, and the band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                n, k1, k2, keys = [], [], [], []
                for s in W.shingle_sets(w):
                    n.append(len(s))
                    k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                ends = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[w.first:w.first + w.rows], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "n_shingles", "k1", "k2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sorted shingle sets (64-bit, as bytes) of the documents named in ``ids`` (column node)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                sets = [s.astype("<u8").tobytes() for s in W.shingle_sets(w)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[w.first:w.first + w.rows], pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(ids, "node", "left_semi")
    return texts.mapInArrow(run, "node long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. Rows that share a doc_id are compared each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """node, shingle: one row for every shingle of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(found))], ["node", "shingle"])

    return sets.mapInArrow(run, "node long, shingle long")


def _can_link(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size: those of ``nodes`` that share enough of their set with the others for any link.

    A link at 75 % needs 75 % of either set in common, so a document of whose
    shingles more than a quarter occur in no other of these documents has none.
    """
    own = staged(sets.join(nodes, "node", "left_semi"), "own")
    rows = staged(_shingle_rows(own), "shingles")
    common = rows.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("shingle")
    shared = rows.join(staged(common, "common"), "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    size = own.groupBy("node").agg(F.min(F.octet_length("shingles") / 8).cast("long").alias("size"))
    return size.join(shared, "node").filter(F.col("shared") * 100 >= F.col("size") * PERCENT).select("node", "size", "shared")


def _sketches(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the lowest bits of a long circulant signature, packed in 64-bit columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits((signature(np.frombuffer(x.as_buffer(), "<u8"), SKETCH) & np.uint32(1)).astype(np.uint8)).view(np.int64) for x in batch.column(1)]
            columns = np.stack(bits, 1) if bits else np.zeros((len(_LONGS), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["node", *_LONGS])

    return sets.join(nodes, "node", "left_semi").mapInArrow(run, "node long, " + ", ".join(f"{c} long" for c in _LONGS))


def _possible(size, shared, other_size, other_shared):
    """Whether two sets can reach the similarity: the intersection needs 75/175 of both sizes together."""
    return F.least(shared, other_shared) * (100 + PERCENT) >= (size + other_size) * PERCENT


def _open_rows(shared: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """key, node, component, size, shared: members of buckets with several components that may link with another of their bucket."""
    rows = shared.join(found, "node", "left").select("key", "node", "hub", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    rows = staged(rows.join(several.filter("low <> high and n > 2").select("key"), "key").filter("node <> hub"), "rows")
    able = staged(_can_link(sets, rows.select("node").distinct()), "able")
    rows = staged(rows.join(able, "node"), "rows")
    least = staged(rows.groupBy("key").agg(F.min("size").alias("least")), "least")
    return staged(rows.join(least, "key").filter(_possible(F.col("size"), F.col("shared"), F.col("least"), F.col("shared")))
                  .select("key", "node", "component", "size", "shared"), "rows")


def _central_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each bucket's most central member (the largest part of its set occurs elsewhere) and the others."""
    central = rows.groupBy("key").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("part"), (-F.col("node")).alias("low"), "node", "component",
                                                     "size", "shared")).alias("c"))
    pairs = rows.join(staged(central.select("key", "c"), "central"), "key").filter(
        (F.col("c.component") != F.col("component")) & _possible(F.col("size"), F.col("shared"), F.col("c.size"), F.col("c.shared")))
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _leading(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, lead: of each set the rarest shingles that it cannot do without.

    A link needs 75 % of either set in common, so if all sets are ordered alike (rarest first), two linked ones
    share a shingle among the first ``size - ceil(0.75 * size) + 1`` of either. Shingles that occur in one set only
    come first there and lead to nobody."""
    # Rows that share a doc_id are compared each, so each has leading shingles of its own.
    own = sets.join(nodes, "node", "left_semi").withColumn("one", F.xxhash64("node", "shingles")).dropDuplicates(["node", "one"])
    own = staged(own, "own")
    rows = staged(_shingle_rows(own.select(F.col("one").alias("node"), "shingles")).withColumnRenamed("node", "one"), "shingles")
    often = staged(rows.groupBy("shingle").agg(F.count("*").alias("n"), (F.min("one") < F.max("one")).alias("common")), "often")
    ordered = rows.join(often, "shingle").groupBy("one").agg(F.array_sort(F.collect_list(F.struct("common", "n", "shingle"))).alias("all"))
    first = F.size("all") - F.ceil(F.size("all") * F.lit(PERCENT) / 100).cast("int") + 1
    lead = F.filter(F.slice("all", F.lit(1), first), lambda x: x["common"])
    ordered = ordered.select("one", F.transform(lead, lambda x: x["shingle"]).alias("lead"))
    lead = own.select("node", "one").join(ordered, "one").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("lead"))).alias("lead"))
    return staged(lead, "lead")


def _cross_pairs(rows: DataFrame, heads: DataFrame, sets: DataFrame, hot: int | None, most_unlike: int | None) -> DataFrame:
    """Pairs (a, b), a < b, of bucket members of different components that may link. ``heads``: node, keys (its band keys in order).

    A pair comes from its first shared band. In a hot bucket it comes from a shared leading shingle, which every
    linked pair has, so that the division of hot buckets leaves no link out.
    """
    sketched = most_unlike is not None
    by = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = by.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("parts"))
    is_hot = F.lit(False) if hot is None else F.col("size") - F.col("top.n") > hot
    buckets = staged(buckets.filter("parts > 1").select("key", F.col("top.component").alias("main"), is_hot.alias("hot")), "buckets")
    rows = rows.join(buckets, "key").withColumn("outside", F.col("component") != F.col("main"))
    named = heads.join(rows.select("node").distinct(), "node", "left_semi")
    named = staged(named.join(_sketches(sets, rows.select("node").distinct()), "node") if sketched else named, "named")
    rows = rows.join(named, "node")
    rows = staged(rows.filter(F.array_position("keys", F.col("key")) > 0), "parts")
    lead = _leading(sets, rows.filter("hot").select("node").distinct()) if hot is not None and not buckets.filter("hot").isEmpty() else None
    divided = rows.filter("not hot").withColumn("part", F.col("key"))
    if lead is not None:
        hot_rows = rows.filter("hot").join(lead, "node").withColumn("part", F.explode("lead")).drop("lead")
        divided = divided.unionByName(hot_rows.withColumn("part", F.xxhash64("key", "part")))
    columns = ["node", "component", "size", "shared", "keys", *(_LONGS if sketched else [])]
    outsiders = divided.filter("outside").select("key", "part", *(F.col(c).alias(f"x_{c}") for c in columns))
    alike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"x_{c}"))) for c in _LONGS), F.lit(0)) <= most_unlike if sketched else F.lit(True)
    first = F.get(F.array_intersect("keys", "x_keys"), F.lit(0)) == F.col("key")
    found = outsiders.join(divided, ["key", "part"]).filter(
        (F.col("x_component") != F.col("component")) & _possible(F.col("size"), F.col("shared"), F.col("x_size"), F.col("x_shared"))
        & alike & first)
    return found.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, hot: int | None = HOT, most_unlike: int | None = MOST_UNLIKE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, one row for every input row.

    ``hot=None`` divides no bucket by leading shingles, ``most_unlike=None`` rules nothing out by
    sketches: then every pair that shares a band and that the sizes allow is compared on its full sets.
    """
    profiles = staged(_profiles(docs), "profiles")
    usable = profiles.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    # Rows that share an id are one document: their classes are linked through it.
    named = staged(usable.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "node"), "named")

    heads = classes.join(usable.select("k1", "k2", "n_shingles", F.col("doc_id").alias("node"), "keys"), ["k1", "k2", "n_shingles", "node"])
    heads = staged(heads.select("node", "keys").dropDuplicates(["node", "keys"]), "heads")
    bands = heads.select("node", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last")
    buckets = staged(buckets.select("key", "hub"), "hubs")
    shared = staged(bands.join(buckets, "key"), "shared")
    stars = staged(shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    sets = staged(_sets(docs, shared.select("node").distinct()), "sets")
    links = staged(_confirmed(stars, sets), "links")
    found = components(links)

    rows = _open_rows(shared, found, sets)
    central = staged(_central_pairs(rows).join(stars, ["a", "b"], "left_anti"), "central")
    links2 = staged(_confirmed(central, sets), "links")
    if not links2.isEmpty():
        links = links.unionByName(links2)
        found = components(links)
    rows = rows.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cross = _cross_pairs(rows, heads, sets, hot, most_unlike).join(stars.unionByName(central), ["a", "b"], "left_anti")
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("a", "b")
    more = staged(_confirmed(staged(cross, "cross"), sets).unionByName(several), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    lead = named.groupBy("doc_id").agg(F.min("node").alias("node"))
    lead = lead.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return (profiles.select("doc_id", "n_shingles").join(lead, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns; of rows that share a kept id, all stay."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
