"""Near-duplicate documents by min-max hashing: each permutation of a document's
shingles gives both its minimum and its maximum, so half as many hash evaluations
fill a signature; bands of it propose pairs, full shingle sets confirm them.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of
   its shingle set, and the values of its bands. Documents with equal sets form
   a class, stood for by its smallest id; a class of any size costs one row.
2. In each bucket (equal band value) every class is paired with the bucket's smallest,
   never with all others. Confirmed pairs are links, and links give components.
3. Pairs of step 2, confirmed or not, join classes to clusters. In a cluster that still
   holds several components, the classes outside the largest one are compared with all
   classes of other components. This goes by blocks of at most ``CHUNK`` by ``VISITORS`` full
   sets, which send on a spanning forest of confirmed links only. So no link between
   classes of a cluster is lost, and no list of pairs is ever made.

With the default bands (20 of two permutations, so four components each) a pair at
the threshold 0.85 shares no bucket with a probability under one in a million.

Cases: a null or empty text has no shingles and is linked with nothing; with fewer
words than a shingle has, the whole sequence is the one shingle; rows without an id are
linked with nothing and kept; rows with one id and several texts are linked by each
of them; exact copies link at any size; the smallest id of a component is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from menuloom.session import broadcast_if_small, reliable_checkpoint

from .common import components, forest, map_texts, mix, odd_numbers, word_names, words_of

WIDTH = 5
#: Two sets are linked from this share of their union on, in percent.
PERCENT = 85
BANDS = 20
#: Permutations of a band; each gives two components of the signature.
PERMUTATIONS = 2
#: Sets on the two sides of a block.
CHUNK, VISITORS = 512, 2048

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted 64-bit names of its distinct shingles; A-Z lower-cased."""
    words = [words_of(t, lower=True) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    names = word_names([x for w in words for x in w])
    if len(names) >= width:
        h = names[: len(names) - width + 1].copy()
        for j in range(1, width):
            h = h * _STEP + names[j : len(names) - width + 1 + j]
        h = mix(h)
    ends = np.cumsum(sizes)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        if n >= width:
            out.append(np.unique(h[end - n : end - width + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for name in names[end - n : end]:
                whole = whole * _STEP + name
            out.append(mix(mix(whole)))
        else:
            out.append(names[:0])
    return out


def sketches(texts: list, width: int, bands: int, permutations: int) -> list:
    """Set size, two fingerprints of the set, and the band values of each text."""
    sets = shingle_sets(texts, width)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    f = np.zeros((2, len(sets)), np.uint64)
    band_values: list = [[] for _ in sets]
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)):
            f[k, full] = np.add.reduceat(mix(h ^ np.uint64(salt)), starts)
        values = np.empty((len(full), bands), np.uint64)
        odd = odd_numbers(bands * permutations, 6)
        for b in range(bands):
            value = np.full(len(full), b + 1, np.uint64)
            for a in odd[b * permutations : (b + 1) * permutations]:
                v = (h * a) >> np.uint64(32)
                low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
                value = mix(value * _STEP + ((high << np.uint64(32)) | low))
            values[:, b] = value
        for i, row in zip(full.tolist(), values.view(np.int64).tolist()):
            band_values[i] = row
    signed = f.view(np.int64)
    return [sizes.tolist(), signed[0].tolist(), signed[1].tolist(), band_values]


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts are joined to the
    pairs, first those of the members, then those of the hubs; both joins can be
    split where one hub has very many members."""
    body = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"))
    one = pairs.join(body.withColumnsRenamed({"id": "b", "body": "body_b"}), "b")
    both = one.join(body.withColumnsRenamed({"id": "a", "body": "body_a"}), "a").select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_text, hub_set = None, None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = part.column(2).to_pylist()
                good = []
                for i, other in enumerate(shingle_sets(part.column(3).to_pylist(), width)):
                    if a[i] != hub or texts[i] != hub_text:
                        hub, hub_text, hub_set = a[i], texts[i], shingle_sets([texts[i]], width)[0]
                    common = len(np.intersect1d(hub_set, other, assume_unique=True))
                    good.append(common > 0 and 100 * common >= percent * (len(hub_set) + len(other) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _across(clusters: DataFrame, joined: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Confirmed links (a, b) between components of one cluster; None if every cluster
    is one component already."""
    parts = joined.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    at = clusters.join(parts, F.col("node") == F.col("n2"), "left").select(F.col("node").alias("rep"), F.col("component").alias("cluster"), F.coalesce("c2", "node").alias("c"))
    at = reliable_checkpoint(at)
    of = at.groupBy("cluster", "c").agg(F.count("*").alias("n")).groupBy("cluster").agg(
        F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"),
    ).where("parts > 1")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    todo = at.join(of, "cluster").select(
        "rep", "cluster", "c", (F.col("c") != F.col("main")).alias("visitor"),
        blocks(F.col("all"), CHUNK).alias("chunks"), blocks(F.col("all") - F.col("most"), VISITORS).alias("groups"),
    )
    todo = broadcast_if_small(todo)
    if todo.isEmpty():
        return None
    bodies = docs.join(todo, F.col("doc_id") == F.col("rep")).select(*todo.columns, "text")

    def make() -> Callable[[list], list]:
        return lambda texts: [[s.tobytes() for s in shingle_sets(texts, width)]]

    sets = map_texts(bodies, todo.columns, [StructField("shingles", BinaryType())], make)
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    place = lambda chunk, group, home: F.struct(chunk.alias("chunk"), group.alias("group"), F.lit(home).alias("home"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    places = F.concat(
        F.transform(upto("groups"), lambda g: place(own("chunks", 1), g, True)),
        F.when(F.col("visitor"), F.transform(upto("chunks"), lambda k: place(k, own("groups", 2), False))).otherwise(F.array().cast("array<struct<chunk:int,group:int,home:boolean>>")),
    )
    met = sets.withColumn("p", F.explode(places)).select("cluster", "p.chunk", "p.group", "p.home", "rep", "c", "shingles")

    def compare(rows: pa.Table) -> pa.Table:
        home = rows.column("home").to_numpy(zero_copy_only=False)
        ids, c = rows.column("rep").to_numpy(), rows.column("c").to_numpy()
        blobs = rows.column("shingles").to_pylist()
        a, b = similar_pairs([np.frombuffer(x, np.uint64) for x in blobs], np.flatnonzero(~home), np.flatnonzero(home), c, percent)
        number = np.unique(c, return_inverse=True)[1]
        tree = forest(number[a], number[b], len(number))
        return pa.table({"a": pa.array(ids[a[tree]], pa.int64()), "b": pa.array(ids[b[tree]], pa.int64())})

    return reliable_checkpoint(met.groupBy("cluster", "chunk", "group").applyInArrow(compare, "a long, b long"))


def similar_pairs(sets: list[np.ndarray], some: np.ndarray, others: np.ndarray, c: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``some``, one of ``others``) with different ``c`` that are similar enough.
    Common shingles are counted through an index of the others' shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(some) and len(others):
        owner = np.repeat(np.arange(len(others)), sizes[others])
        index = np.concatenate([sets[i] for i in others])
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        start = 0
        while start < len(some):
            # As many at a time as keep the expanded postings bounded.
            stop = start + max(1, int(4_000_000 // max(1, len(others) * sizes[some[start : start + 256]].max())))
            mine = some[start:stop]
            start = stop
            asked = np.concatenate([sets[i] for i in mine])
            of = np.repeat(np.arange(len(mine)), sizes[mine])
            low, high = np.searchsorted(index, asked, "left"), np.searchsorted(index, asked, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(np.repeat(of, n) * len(others) + owner[at], minlength=len(mine) * len(others)).reshape(len(mine), len(others))
            good = (common > 0) & (100 * common >= percent * (sizes[mine][:, None] + sizes[others][None, :] - common)) & (c[mine][:, None] != c[others][None, :])
            i, j = np.nonzero(good)
            found_a.append(mine[i])
            found_b.append(others[j])
    return np.concatenate(found_a), np.concatenate(found_b)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
    bands: int = BANDS, permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``."""
    fields = [StructField("n_shingles", LongType()), StructField("f1", LongType()), StructField("f2", LongType()), StructField("bands", ArrayType(LongType()))]

    def make() -> Callable[[list], list]:
        return lambda texts: sketches(texts, width, bands, permutations)

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = reliable_checkpoint(map_texts(docs, ["doc_id"], fields, make))
    key = ["n_shingles", "f1", "f2"]
    classes = sketch.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    placed = classes.select("rep", F.explode("bands").alias("value"))
    hubs = placed.groupBy("value").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("value", "hub")
    members = reliable_checkpoint(placed.join(hubs, "value"))

    stars = reliable_checkpoint(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    links = reliable_checkpoint(confirmed(stars, docs, "doc_id", "text", width, percent))
    joined = components(links)

    more = _across(components(stars), joined, docs, width, percent)
    if more is not None:
        joined = components(links.union(more))

    named = classes.select(*key, "rep").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select(*(F.col(k).alias(f"c_{k}") for k in key), F.coalesce("component", "rep").alias("component_id"))
    same = [F.col(k) == F.col(f"c_{k}") for k in key]
    return sketch.join(named, [*same, F.col("doc_id").isNotNull()], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents less those that another id of their component stands for."""
    gone = near_duplicates(docs, doc_id, text, **options).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(broadcast_if_small(gone), doc_id, "left_anti").select(*docs.columns)
