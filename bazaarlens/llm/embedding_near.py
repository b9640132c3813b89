"""Near copies among embeddings: randomised-rotation binary codes with stored correction factors.

A vector is turned by a random rotation and kept as the signs of its coordinates, one bit each, together with
the factor f = <code, vector> by which the code falls short of it. For another unit vector y, rotated alike,
<code, y> / f estimates their cosine without bias; at a true cosine t its standard error is
sqrt(1 - t**2) * sqrt(1 - f**2) / (f * sqrt(D - 1)). A pair whose estimate lies further below the wanted cosine than
``CONFIDENCE`` such errors is passed over; every other one is worked out exactly, in double precision.

Pairs are looked for in buckets only. Codes from further rotations are cut into bands of bits, and vectors of one
label that agree in a band share its bucket. Two vectors at the wanted cosine differ in a bit with
chance acos(cosine) / pi, so the bits per band (from the label's number of vectors, so that a bucket has
about ``ROWS``) give the number of bands that miss such a pair with chance ``MISS`` at most; nearer pairs are missed far less.
Labels of up to ``ROWS`` vectors are one bucket and miss nothing. A pair that meets in several buckets counts in the first.

Equal vectors are one vector with a count. A bucket of more than ``CELL`` vectors is cut into parts, and each pair of
parts is a cell of its own, so no task holds a whole large bucket and none is capped. A cell gives, for each of its
vectors, a number of links and at most one link that keeps its component together; pairs are never written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.components import components
from bazaarlens.llm.shared import in_tasks, keyed, shared_folder, stored
from bazaarlens.llm.vectors import by_length, vector_portions

COSINE = 0.93
ROWS, CELL = 1024, 2048
MISS = 0.02
CONFIDENCE = 4.0
SEED = 42
_LINES = 512  # lines of a cell compared at once


@lru_cache(8)
def rotation(dimension: int, number: int) -> np.ndarray:
    """The first ``dimension`` lines of a random rotation of 64, 128, ... dimensions: a padded space for short vectors."""
    wide = -(-dimension // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([SEED, dimension, number]).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dimension]


def bands(n: int, cosine: float = COSINE, rows: int = ROWS, miss: float = MISS) -> tuple[int, int]:
    """Bits a band and number of bands for ``n`` vectors."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / rows)))
    if not bits:
        return 0, 1
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - alike))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the code of each unit vector, packed, and its correction factor."""
    turned = unit @ rotation(unit.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated cosine of each coded vector with each of the unit vectors ``others``."""
    turned = (others @ rotation(others.shape[1], 0)).astype(np.float32)
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    return signs @ turned.T / (factor * math.sqrt(turned.shape[1])).astype(np.float32)[:, None]


def least_estimate(factor: np.ndarray, dimension: int, cosine: float, confidence: float = CONFIDENCE) -> np.ndarray:
    """Estimate below which a pair is surely, at that confidence, below ``cosine``."""
    wide = -(-dimension // 64) * 64
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / (factor * math.sqrt(wide - 1))
    return cosine - confidence * math.sqrt(1 - cosine**2) * error - 1e-5


def band_keys(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The bits of every band as one number, a line per vector."""
    dimension = unit.shape[1]
    wide = -(-dimension // 64) * 64
    keys = np.zeros((len(unit), count), np.int64)
    if bits:
        signs = [unit @ rotation(dimension, 1 + k) > 0 for k in range(-(-bits * count // wide))]
        signs = np.concatenate(signs, axis=1)[:, : bits * count].reshape(len(unit), count, bits)
        keys = signs @ (1 << np.arange(bits, dtype=np.int64))
    return keys


def _units(vectors: np.ndarray) -> np.ndarray:
    exact = vectors.astype(np.float64)
    return exact / np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]


def _identified(docs: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Columns file, row, vec_id, label, dimension, rep, v: ``rep`` names the vector; null if it links with nothing.

    Doubles are brought to a largest component between 1/2 and 1 by a power of two, which is exact; floats
    cannot leave the range of doubles when squared.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vector_portions(batches):
            n = batch.num_rows
            labels = batch.column("label").to_pylist()
            rep, held, size = [None] * n, [None] * n, [None] * n
            for length, rows, found in by_length(batch.column("embedding")):
                top = np.abs(found).max(axis=1)
                if found.dtype != np.float32:
                    found = np.ldexp(found.astype(np.float64), -np.frexp(top)[1][:, None])
                found = found + found.dtype.type(0)  # no negative zero
                for i, line in zip(rows[top > 0], found[top > 0], strict=True):
                    if labels[i] is not None:
                        raw = line.tobytes()
                        rep[i] = hashlib.sha256(f"{length} {len(raw)} {labels[i]}\n".encode() + raw).digest()[:16]
                        held[i], size[i] = raw, length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "row", "vec_id", "label")), pa.array(size, pa.int32()), pa.array(rep, pa.binary()), pa.array(held, pa.binary())],
                names=["file", "row", "vec_id", "label", "dimension", "rep", "v"],
            )

    rows = keyed(docs, F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    kind = dict(rows.dtypes)["vec_id"]
    return in_tasks(rows, per_batch, f"file long, row long, vec_id {kind}, label string, dimension int, rep binary, v binary")


def _held(column: pa.Array, dimension: int) -> np.ndarray:
    """Stored vectors of one dimension, one per line."""
    raw = column.to_pylist()
    kind = np.float32 if len(raw[0]) == 4 * dimension else np.float64
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), dimension)


def _index(reps: DataFrame, cosine: float, rows: int, miss: float) -> DataFrame:
    """``reps`` with code, factor and band keys. ``n``: vectors of the label and dimension."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vector_portions([batch]):
                groups: dict[tuple, list[int]] = {}
                for i, (d, n, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in ("dimension", "n", "v")), strict=True)):
                    groups.setdefault((d, n, len(raw)), []).append(i)
                for (dimension, n, _), at in groups.items():
                    some = part.take(pa.array(at))
                    unit = _units(_held(some.column("v"), dimension))
                    code, factor = encode(unit)
                    keys = band_keys(unit, *bands(n, cosine, rows, miss))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*(some.column(c) for c in ("rep", "label", "dimension", "copies", "v")), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), lists],
                        names=["rep", "label", "dimension", "copies", "v", "code", "factor", "keys"],
                    )

    return in_tasks(reps, per_batch, "rep binary, label string, dimension int, copies long, v binary, code binary, factor double, keys array<long>")


def _digest(*of: Column) -> Column:
    """16 bytes that name the values."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(" ", *(c.cast("string") for c in of)), 256), 1, 32))


def _cells(index: DataFrame, folder: str, most: int) -> DataFrame:
    """The index once per band and cell, sorted by cell. ``part`` tells the two sides of a cell apart."""
    narrow = index.select("rep", "label", "dimension", F.posexplode("keys").alias("band", "key"))
    bucket = _digest(F.col("dimension"), F.col("band"), F.col("key"), F.col("label")).alias("bucket")
    sizes = narrow.groupBy("label", "dimension", "band", "key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most)
    large = stored(sizes.select(bucket, F.ceil(F.col("m") / most).cast("int").alias("parts")), folder, "large")
    placed = index.select("*", F.posexplode("keys").alias("band", "key")).withColumn("bucket", bucket).join(large, "bucket", "left")
    parts = F.coalesce("parts", F.lit(1))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = F.concat(F.col("bucket"), F.unhex(F.lpad(F.hex(F.least("part", "other")), 8, "0")), F.unhex(F.lpad(F.hex(F.greatest("part", "other")), 8, "0")))
    placed = placed.select(cell.alias("cell"), "band", "part", "rep", "dimension", "copies", "v", "code", "factor", "keys")
    # By the hash of the cell, and as many as there are rows for: AQE may merge but not split these.
    return placed.repartition("cell").sortWithinPartitions("cell", "part", "rep")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between ``n`` members: each member that has a smaller one in its component, and that one."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _cell_links(rows: pa.Table, cosine: float, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Links (copies of partners) of each row of a cell, the forest's links, and how many pairs were worked out."""
    dimension, band = rows.column("dimension")[0].as_py(), rows.column("band")[0].as_py()
    vectors = _held(rows.column("v"), dimension).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(norm), -1)
    factor, copies, part = (rows.column(c).to_numpy() for c in ("factor", "copies", "part"))
    flat = rows.column("keys").combine_chunks().flatten().to_numpy()
    keys = flat.reshape(len(norm), -1)
    sides = rows.column("cell")[0].as_py()[-8:]
    crossed = sides[:4] != sides[4:]
    cut = int(np.searchsorted(part, part[0], side="right"))
    lines, start = (cut, cut) if crossed else (len(part), 0)
    unit = vectors / norm[:, None]
    links, found, worked = np.zeros(len(norm), np.int64), [], 0
    least = least_estimate(factor, dimension, cosine, confidence)
    for first in range(0, lines, _LINES):
        last = min(first + _LINES, lines)
        from_ = start if crossed else first + 1
        if from_ >= len(norm):
            break
        close = estimates(code[first:last], factor[first:last], unit[from_:]) >= least[first:last, None]
        if not crossed:
            close = np.triu(close)
        a, b = np.nonzero(close)
        a, b = a + first, b + from_
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            new = ~(keys[x, :band] == keys[y, :band]).any(axis=1)
            x, y = x[new], y[new]
            worked += len(x)
            exact = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y]) >= cosine
            x, y = x[exact], y[exact]
            links += np.bincount(x, copies[y], len(norm)).astype(np.int64) + np.bincount(y, copies[x], len(norm)).astype(np.int64)
            found.append(_forest(len(norm), x, y))
    child, parent = _forest(len(norm), *(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1)))
    return links, child, parent, worked


def _links(cells: DataFrame, cosine: float, confidence: float) -> DataFrame:
    """Columns rep, links, other: links found in a cell, and (with ``other``) one that holds a component together."""

    def found(rows: pa.Table) -> pa.RecordBatch | None:
        links, child, parent, _ = _cell_links(rows, cosine, confidence)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        rep = rows.column("rep").combine_chunks()
        n = len(child)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([rep.take(pa.array(some)), rep.take(pa.array(child))]),
                pa.array(np.concatenate((links[some], np.zeros(n, np.int64)))),
                pa.concat_arrays([pa.nulls(len(some), pa.binary()), rep.take(pa.array(parent))]),
            ],
            names=["rep", "links", "other"],
        )

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, name = [], None
        for batch in batches:
            cell = batch.column("cell").to_pylist()
            edges = [0, *(i for i in range(1, len(cell)) if cell[i] != cell[i - 1]), len(cell)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                if kept and cell[first] != name:
                    out = found(pa.Table.from_batches(kept))
                    kept = []
                    if out:
                        yield out
                name = cell[first]
                kept.append(batch.slice(first, last - first))
        if kept:
            out = found(pa.Table.from_batches(kept))
            if out:
                yield out

    return in_tasks(cells, per_task, "rep binary, links long, other binary")


def embedding_groups(
    spark: SparkSession,
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    rows: int = ROWS,
    cell: int = CELL,
    miss: float = MISS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """One row per row of ``vectors``: how many others it is linked with, and the smallest id reachable by links.

    Rows link if their labels are equal, their vectors have the same number of components and their cosine, in double
    precision, is at least ``cosine`` (above 0). A null label, and a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing. Rows with equal vectors (repeated rows too) link with one another.
    No pair below ``cosine`` is linked; one above it is missed with chance ``miss`` at most, and only under a label of
    more than ``rows`` different vectors. A null id is above all others: ``component_id`` is null only if all ids
    of the component are, and ``kept`` says whether the row's id is that one, both null included. So rows that
    share the smallest id are all kept. An empty table gives an empty result; other columns are not read.
    Columns: file, row, vec_id, n_links, component_id, kept.
    """
    folder = shared_folder(spark)
    known = stored(_identified(vectors, vec_id, embedding, label), folder, "known")
    linkable = known.filter(F.col("rep").isNotNull())
    reps = stored(
        linkable.groupBy("rep").agg(
            F.first("label").alias("label"),
            F.first("dimension").alias("dimension"),
            F.first("v").alias("v"),
            F.count(F.lit(1)).alias("copies"),
            F.min("vec_id").alias("id"),
        ),
        folder,
        "reps",
    )
    sizes = stored(reps.groupBy("label", "dimension").agg(F.count(F.lit(1)).alias("n")), folder, "sizes")
    index = stored(_index(reps.join(sizes, ["label", "dimension"]), cosine, rows, miss), folder, "index")
    found = stored(_links(_cells(index, folder, cell), cosine, confidence), folder, "found")
    root = components(found.filter(F.col("other").isNotNull()).select(F.col("rep").alias("u"), F.col("other").alias("v")), folder)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = (
        reps.select("rep", "copies", "id")
        .join(root.withColumnRenamed("u", "rep"), "rep", "left")
        .join(counts, "rep", "left")
        .select("rep", "id", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    rooted = stored(rooted, folder, "rooted")
    heads = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    answer = rooted.join(heads, "root").select("rep", "n_links", "component_id")
    component = F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return known.select("file", "row", "vec_id", "rep").join(answer, "rep", "left").select(
        "file",
        "row",
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
