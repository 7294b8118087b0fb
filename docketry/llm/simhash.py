"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint. The distinct fingerprints are dealt into
tiles that hold one population count each; two tiles are compared only if their
counts differ by the radius at most, since a differing bit changes the count by
one. A pair of tiles is compared whole, in numpy, by exclusive-or and bit counts,
and gives a spanning forest of its links, so a large group of near copies gives
no more edges than it has members. Components of these edges are those of all
links; no candidate search can miss one.

The comparisons grow with the square of the distinct fingerprints, spread over
tasks of equal size; a task holds two tiles.

Defined results: null and empty texts have no words, fingerprint zero, and are
linked like any other; ``component_id`` ignores null ids (null if there is no
other); of equal ids in a group one row is kept; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import broadcast_if_small, materialize, narrow, slices
from docketry.llm.components import connected_components
from docketry.llm.exact import keep_rows
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

#: parts of a group of linked fingerprints when its rows meet the one that stays
PARTS = 32
TILE_ROWS = 8192
BLOCK_ROWS = 64
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in over half of the shingle hashes; zero without words."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        spans = zip(starts[i : min(n, i + (1 << 16))].tolist(), ends[i : i + (1 << 16)].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            digests = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64)), pa.array(digests.view(np.int64))],
                names=["id", "fp", "digest"],
            )

    return run


class Forest:
    """Smallest member of each set, for numbered members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            a, b, u, v = a[apart], b[apart], u[apart], v[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (shorter := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = shorter


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two tiles, or within one."""
    forest = Forest(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    differ = np.empty((BLOCK_ROWS, len(b)), np.uint64)
    bits = np.empty((BLOCK_ROWS, len(b)), np.uint8)
    for i in range(0, len(a), BLOCK_ROWS):
        block = a[i : i + BLOCK_ROWS, None]
        first = i if same else 0
        x, c = differ[: len(block), first:], bits[: len(block), first:]
        np.bitwise_xor(block, b[None, first:], out=x)
        np.bitwise_count(x, out=c)
        near = c <= radius
        if np.count_nonzero(near) > (len(block) if same else 0):
            u, v = np.nonzero(near)
            forest.join(u + i, v + first + shift)
    nodes = a if same else np.concatenate((a, b))
    hung = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[hung], nodes[forest.label[hung]]


def _links(radius: int):
    def run(pair: pa.Table) -> pa.Table:
        tiles = [np.array(t, np.int64).view(np.uint64) for t in pair.column("tile").to_pylist()]
        same = len(tiles) == 1
        u, v = compare_tiles(tiles[0], tiles[-1], radius, same)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def link_fingerprints(fingerprints: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct ``fp`` values to edges ``u, v`` that connect whatever is linked within ``radius`` bits."""
    counted = fingerprints.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    sizes = {r.pop: -(-r.n // tile_rows) for r in counted.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles_of = F.array(*[F.lit(sizes.get(p, 0)) for p in range(65)])  # at most 65 counts, whatever the input
    number = F.pmod(F.xxhash64("fp"), F.element_at(tiles_of, F.col("pop") + 1)).cast("int")
    tiles = counted.groupBy("pop", number.alias("k")).agg(F.collect_list("fp").alias("tile"))
    low, high = F.greatest(F.lit(0), F.col("pop") - radius), F.least(F.lit(64), F.col("pop") + radius)
    near = tiles.select("*", F.explode(F.sequence(low, high)).alias("pop2"))
    near = near.withColumn("tiles2", F.element_at(tiles_of, F.col("pop2") + 1)).where("tiles2 > 0")
    near = near.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)).alias("k2"))
    own, other = F.struct("pop", "k"), F.struct(F.col("pop2").alias("pop"), F.col("k2").alias("k"))
    pairs = near.select(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "tile")
    return pairs.groupBy("low", "high").applyInArrow(_links(radius), "u long, v long")


def cluster(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id, digest, fp, component_id, kept`` (the smallest id of each group stays)."""
    light = materialize(
        narrow(docs, id_col, text_col)
        .mapInArrow(_fingerprints(shingle), "id long, fp long, digest long")
        .withColumn("row", F.monotonically_increasing_id()),
        "simhash",
    )
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = materialize(light.groupBy("fp").agg(F.min(ranked).alias("first")), "distinct-simhash")
    edges = link_fingerprints(first.select("fp"), radius)
    labels = connected_components(edges).withColumnRenamed("node", "fp")
    labelled = materialize(first.join(broadcast_if_small(labels, 16), "fp", "left"), "simhash-labels")
    # fingerprints without a link are their own group; the others' label may be hot, so it meets its best row in parts
    best = labelled.where("label is not null").groupBy("label").agg(F.min("first").alias("best"))
    parts = best.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    linked = labelled.where("label is not null").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int"))
    placed = materialize(
        linked.join(parts, ["label", "part"]).select("fp", "best")
        .unionByName(labelled.where("label is null").select("fp", F.col("first").alias("best"))),
        "simhash-groups",
    )
    joined = light.join(broadcast_if_small(placed, 48), "fp")
    return joined.select(
        "id", "digest", "fp", F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group, with the columns of the input."""
    decided = materialize(cluster(docs, shingle, radius, id_col, text_col).select("id", "digest", "kept"), "decided")
    digest = F.xxhash64(F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")))
    return keep_rows(docs, decided, digest, id_col)
