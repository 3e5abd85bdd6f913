"""Near-duplicate texts: MinHash with tensored banding, every candidate confirmed on the full sets of shingles.

Two collections of 32 half-keys, each made of 5 minhashes, give 1,024 tables of 10 minhashes: a table's key joins a left
half-key with a right one, so 320 minhashes serve where separate tables would need 10,240.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlake.llm import shingles
from barlake.llm.columns import unused
from barlake.llm.components import components
from barlake.session import stage


@dataclass(frozen=True)
class Tables:
    """Two texts of similarity s share a table with probability (1 - (1 - s**rows)**halves)**2: 0.999994 at 0.8,
    0.006 at 0.3, so texts that merely share a passage seldom meet.
    """

    size: int = 4
    percent: int = 80
    halves: int = 32
    rows: int = 5
    seed: int = 1

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        count = 2 * self.halves * self.rows
        return random.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, count, dtype=np.uint64)


#: Up to so many ids (about 30 MB as a hash table of digests) are broadcast to pick rows; more are joined with a shuffle.
BROADCAST_IDS = 250_000


def pick(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of `rows` with the staged `ids` on their columns; broadcast if there are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)


def _half_keys(hashes: np.ndarray, counts: np.ndarray, tables: Tables) -> np.ndarray:
    """A row of half-keys (left ones first) for each text that has shingles."""
    factors, shifts = tables.functions()
    own = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[own])[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    keys = np.zeros((len(own), 2 * tables.halves), dtype=np.uint64)
    if len(own):
        hashed = np.empty_like(hashes)
        for k, (factor, shift) in enumerate(zip(factors, shifts, strict=True)):
            np.multiply(hashes, factor, out=hashed)
            np.add(hashed, shift, out=hashed)
            lowest = np.minimum.reduceat(hashed, starts)
            half = k // tables.rows
            keys[:, half] = shingles.mix(keys[:, half] + lowest + np.uint64(k))
    return keys


def sign(docs: DataFrame, doc_id: str, text: str, tables: Tables, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null: empty), and its left and right half-keys; text_hash if `hashed`."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in shingles.pieces(batch.column(1)):
                hashes, counts = shingles.shingle_sets(data, offsets, tables.size)
                halves = _half_keys(hashes, counts, tables).view(np.int64)
                own = np.zeros(last - first + 1, dtype=np.int32)
                own[1:] = np.cumsum(counts > 0) * tables.halves
                sides = [halves[:, : tables.halves], halves[:, tables.halves :]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(counts.astype(np.int64)),
                        _digests(hashes, counts),
                        *(pa.ListArray.from_arrays(pa.array(own), pa.array(side.ravel())) for side in sides),
                        *(column.slice(first, last - first) for column in batch.columns[2:]),
                    ],
                    names=["doc_id", "n_shingles", "digest", "left_keys", "right_keys", *batch.schema.names[2:]],
                )

    more = [_text_hash(text).alias("text_hash")] if hashed else []
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), *more)
    kind = given.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_shingles bigint, digest binary, left_keys array<bigint>, right_keys array<bigint>"
    return given.mapInArrow(signed, columns + ", text_hash binary" * hashed)


def _text_hash(text: str) -> F.Column:
    """16 bytes that tell texts apart; null for a null text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _digests(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts)
    data = memoryview(np.ascontiguousarray(hashes)).cast("B")
    found = [
        hashlib.md5(data[8 * (end - count) : 8 * end], usedforsecurity=False).digest() if count else None
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True)
    ]
    return pa.array(found, pa.binary())


def full_sets(docs: DataFrame, text: str, tables: Tables) -> DataFrame:
    """digest and the sorted distinct shingles of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in shingles.pieces(batch.column(0)):
                hashes, counts = shingles.shingle_sets(data, offsets, tables.size)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_digests(hashes, counts), lists], names=["digest", "shingles"])

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(sets, "digest binary, shingles array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) whose sets are alike: 100 * intersection >= percent * union."""
    one = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = 100 * both >= tables.percent * (F.size("x") + F.size("y") - both)
    return pairs.join(one, "a").join(two, "b").where(alike).select("a", "b")


def _near(a: F.Column, b: F.Column, tables: Tables) -> F.Column:
    """Whether sets of these sizes can be alike."""
    return 100 * F.least(a, b) >= tables.percent * F.greatest(a, b)


def stars(signed: DataFrame, folder: str) -> DataFrame:
    """(digest, size, first): the members of table keys that two sets or more share, once with each first member of their keys.

    Only left half-keys that different sets share are joined with the right ones, so most sets leave after one narrow
    shuffle. Copies have equal rows here and are folded before each shuffle.
    """
    signed = signed.where("digest is not null")
    halves = signed.select("digest", F.explode(F.transform("left_keys", lambda half, place: F.xxhash64(place, half))).alias("half"))
    short = F.xxhash64("digest")
    shared = halves.groupBy("half").agg(F.min(short).alias("low"), F.max(short).alias("high")).where("low <> high").select("half")
    hits = stage(pick(halves, stage(shared, folder, "shared"), "left_semi").distinct(), folder, "hits")
    touched = stage(hits.select("digest").distinct(), folder, "touched")
    rights = signed.select("digest", F.col("n_shingles").alias("size"), "right_keys")
    rights = pick(rights, touched, "left_semi").dropDuplicates(["digest"])
    table_keys = F.transform("right_keys", lambda right, place: F.xxhash64("half", place, right))
    keys = hits.join(rights, "digest").select("digest", "size", F.explode(table_keys).alias("key"))
    firsts = keys.groupBy("key").agg(F.min(F.struct("digest", "size")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keys.join(firsts, "key").where(F.col("digest") != F.col("first.digest"))
    return stage(pairs.select("digest", "size", "first").distinct(), folder, "stars")


def _with_root(rows: DataFrame, linked: DataFrame, name: str, root: str) -> DataFrame:
    """Adds the root of the sets in `name`, which is the set itself where it has no lower node."""
    roots = linked.select(F.col("a").alias(name), F.col("b").alias(root))
    return rows.join(roots, name, "left").withColumn(root, F.coalesce(root, name))


def open_sets(held: DataFrame, linked: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(digest, root): the sets of components that share a table key with another one, a row for each set.

    A key holds several components if one of its members is apart from its first one, so the stars (`held`) tell them, and
    rows grow with sets and their first members, not with the members of keys.
    """
    apart = held.select("digest", F.col("first.digest").alias("first"))
    apart = _with_root(_with_root(apart, linked, "digest", "root"), linked, "first", "other").where("root <> other")
    roots = stage(apart.select(F.explode(F.array("root", "other")).alias("root")).distinct(), folder, "roots")
    return pick(_with_root(sets.select("digest"), linked, "digest", "root"), roots, "left_semi").select("digest", "root")


#: Rows of one shingle are dealt to so many tasks when it is counted, and to one more for each THOUSAND when they are paired.
SALTS = 8
THOUSAND = 1000


def rare_shingles(opened: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """(shingle, often, digest, root, size, place): the rarest shingles of each open set, as far as a first common one can stand.

    `place` counts a set's shingles, those of one component only first, then from the rarest one among all open sets. Two
    alike sets share at least percent / (100 + percent) of their sizes' sum, so their rarest common shingle leaves that
    many behind it in both. Shingles of one component only count in `place`, but need no row.
    """
    full = sets.join(opened, "digest").select("digest", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    short = F.xxhash64("root")
    often = full.groupBy("shingle").agg(F.min(short).alias("low"), F.max(short).alias("high"), F.count("*").alias("often"))
    often = often.where("low <> high").select("shingle", "often", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = full.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(often, ["shingle", "salt"]).drop("salt")
    own = Window.partitionBy("digest")
    rank = F.row_number().over(own.orderBy("often", "shingle")) - 1
    placed = shared.select("*", (F.col("size") - F.count("*").over(own) + rank).cast("int").alias("place"))
    return placed.where(100 * (F.col("size") - F.col("place")) >= tables.percent * F.col("size"))


def crossing_pairs(rare: DataFrame, tables: Tables) -> DataFrame:
    """The pairs of sets in different components that can still be alike, given a common shingle and its places.

    At each shingle the sets outside its largest component meet those of other components, so a large group that is one
    component already is never paired with itself. The rows of a common shingle are dealt to several tasks.
    """
    salts = F.expr(f"int(1 + often div {THOUSAND})")
    salted = rare.withColumn("salt", F.pmod(F.xxhash64("digest"), salts).cast("int"))
    sizes = rare.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.max("often").alias("often"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.max("often").alias("often"), F.count("*").alias("roots"))
    every = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    largest = largest.where("roots > 1").select("shingle", "largest", every)
    few = salted.join(largest, ["shingle", "salt"]).where("root <> largest")
    few = few.select("shingle", every, *(F.col(c).alias(f"x_{c}") for c in ("digest", "root", "size", "place")))
    left = F.least(F.col("size") - F.col("place"), F.col("x_size") - F.col("x_place"))
    reach = (100 + tables.percent) * left >= tables.percent * (F.col("size") + F.col("x_size"))
    pairs = few.join(salted, ["shingle", "salt"]).where((F.col("root") != F.col("x_root")) & reach)
    return pairs.select(F.greatest("x_digest", "digest").alias("a"), F.least("x_digest", "digest").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tables: Tables = Tables()
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are stretches without white space, A-Z in lower case; a document is its set of distinct shingles. Documents
    with 80 percent of the union of their sets in common are linked; `component_id` is the smallest doc_id that links
    reach, `kept` tells whether it is the document's own.

    - Documents with equal sets are one class, so copies are never paired; classes that share a table are candidates.
    - Each candidate is compared with the first members of its table keys. Components that still share a key are then joined
      exactly, on their sets' rarest shingles and with bounds from the places of these, so that all candidates end up linked,
      in one component or refuted, and sets that share common shingles only are not paired.
    - Null and empty texts and texts of white space have no shingles and are linked with nothing. Rows without a
      doc_id that are alone in their component have none as component_id and are kept. Rows with one doc_id are judged
      by their own texts. Other columns are not read.

    What is written to `folder`: signatures (about 550 bytes a document), shared keys and sets of candidates only.
    """
    component = F.coalesce("component", "doc_id")
    return grouped(docs, folder, doc_id, text, tables).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def grouped(docs: DataFrame, folder: str, doc_id: str, text: str, tables: Tables, hashed: bool = False) -> DataFrame:
    """The signed rows with root and component (see `label`); see `near_duplicates`."""
    signed = stage(sign(docs, doc_id, text, tables, hashed), folder, "signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    classes = stage(classes, folder, "classes")
    held = stars(signed, folder)
    wanted = stage(held.select("digest").union(held.select("first.digest")).distinct(), folder, "wanted")
    ids = stage(classes.join(wanted, "digest", "left_semi").select(F.col("id").alias(doc_id)), folder, "ids")
    rows = docs.select(doc_id, text)
    candidates = pick(rows, ids, "left_semi")
    if not ids.where(F.col(doc_id).isNull()).isEmpty():
        candidates = candidates.union(rows.where(F.col(doc_id).isNull()))
    sets = pick(full_sets(candidates, text, tables), wanted, "left_semi")
    sets = stage(sets.dropDuplicates(["digest"]), folder, "sets")

    alike = held.where(_near(F.col("size"), F.col("first.size"), tables)).select(F.col("digest").alias("a"), F.col("first.digest").alias("b"))
    linked = components(stage(confirm(alike, sets, tables), folder, "links"), folder)
    opened = stage(open_sets(held, linked, sets, folder), folder, "opened")
    rare = stage(rare_shingles(opened, sets, tables), folder, "rare")
    links = stage(confirm(crossing_pairs(rare, tables), sets, tables), folder, "links")
    if not links.isEmpty():
        linked = components(linked.union(links), folder)
    return label(signed, classes, linked)


def label(signed: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """The root and the smallest doc_id of each row's component from those of the classes, null for rows that are alone;
    classes of one document without links are not joined.
    """
    own = classes.select("digest", "id", "n").join(linked.select(F.col("a").alias("digest"), F.col("b").alias("root")), "digest", "left")
    roots = linked.select(F.col("b").alias("digest")).distinct().withColumn("is_root", F.lit(True))
    own = own.join(roots, "digest", "left").where("n > 1 or root is not null or is_root")
    own = own.select("digest", "id", F.coalesce("root", "digest").alias("root"))
    lowest = own.groupBy("root").agg(F.min("id").alias("component"))
    own = own.join(lowest, "root").select("digest", "root", "component")
    return signed.join(own, "digest", "left")


#: Up to so many rows (about 35 MB as a hash table) are broadcast by id and text; more are joined with a shuffle.
BROADCAST_ROWS = 200_000


def _pick_rows(docs: DataFrame, rows: DataFrame, how: str, doc_id: str, text_hash: F.Column) -> DataFrame:
    """left_semi or left_anti join with the staged (doc_id, text_hash); null ids and null texts match each other."""
    own_id, own_hash = unused("__copy_id", docs), unused("__copy_hash", docs)
    rows = rows.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    same = F.col(doc_id).eqNullSafe(F.col(own_id)) & text_hash.eqNullSafe(F.col(own_hash))
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same, how)


def without_copies(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tables: Tables = Tables()) -> DataFrame:
    """`docs` with one row of each component, the one with the smallest doc_id; all columns stay.

    Rows are told apart by doc_id and text, so a row goes only for its own text. Of several rows with the smallest doc_id
    one stays, and one of those without any doc_id where no row of the component has one. A row that repeats doc_id and
    text is a copy too, also if its text has no words.
    """
    rows = grouped(docs, folder, doc_id, text, tables, hashed=True)
    rows = rows.where("root is not null or (digest is null and doc_id is not null)")
    judged = stage(rows.groupBy("doc_id", "text_hash").agg(F.max("root").alias("root"), F.count("*").alias("n")), folder, "judged")
    linked = judged.where("root is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = linked.groupBy("root").agg(F.min(order).alias("first")).select("root", "first.doc_id", "first.text_hash")
    first = stage(first, folder, "first")
    dropped = stage(_pick_rows(linked, first, "left_anti", "doc_id", F.col("text_hash")), folder, "dropped")
    kept = _pick_rows(docs, dropped, "left_anti", doc_id, _text_hash(text))
    repeated = judged.where("n > 1")
    if repeated.isEmpty():
        return kept
    once = _pick_rows(kept, repeated, "left_semi", doc_id, _text_hash(text)).dropDuplicates([doc_id, text])
    return _pick_rows(kept, repeated, "left_anti", doc_id, _text_hash(text)).unionByName(once)
