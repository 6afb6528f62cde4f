"""Vector code compression: parts of vectors as bytes, by codebooks whose nearest entries a VA-file finds.

Vectors are made whole numbers and cut into equal parts; each part position has a codebook, trained by rounds of
assignment and averaging over all vectors. An assignment bit-quantises the entries' coordinates into cells, ``BITS`` a
coordinate. A query's look-up table holds, for each coordinate and cell, the least and the greatest squared distance to
what is in the cell; their sums bound its distance to each entry. Entries whose lower bound is above the least upper
bound are out, and the rest are compared by exact integer distance. A part and its partial sums stay where the vectors
are read; Spark adds the sums, a row for each entry, and only codebooks come to the driver.

Defined results: vectors that are null, or hold a null or non-finite component, are dropped; so are those that can't be
compared in 64 bits (with 64 components, one of 32768 or more), and those whose length isn't that of the first vector or can't
be cut into equal parts. The first vectors, by id (nulls last) and then by components, start the codebooks; with fewer
vectors than entries there are fewer entries. Rows that repeat an id count each. Ties go to the lower index, and an entry
that no part is nearest to stays as it is. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.hot import attach
from threadloom.runtime import Scratch, share_code

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A component is floor(SCALE * x).
SCALE = 4096
#: Bits of a coordinate's cell.
BITS = 3
#: Squared distances of whole vectors are below this.
LIMIT = 1 << 62
#: Parts that are compared at once.
BLOCK = 8192


@dataclass(frozen=True)
class Cells:
    """A codebook's entries by cell: ``cell`` of each entry and coordinate, and each cell's ``low`` and ``high`` coordinate."""

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        """Cells of equal width between each coordinate's extremes; whole numbers throughout."""
        least = entries.min(axis=0)
        width = (entries.max(axis=0) - least) // (1 << bits) + 1
        cell = (entries - least) // width
        low = least[:, None] + np.arange(1 << bits) * width[:, None]
        return cls(entries, cell, low, low + width[:, None] - 1)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``x`` and each entry, what its squared distance is at least and at most."""
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        least = np.maximum(np.maximum(below, above), 0) ** 2  # look-up tables: row, coordinate, cell
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower, upper = np.zeros((len(x), len(self.entries)), np.int64), np.zeros((len(x), len(self.entries)), np.int64)
        for j in range(x.shape[1]):
            lower += least[:, j][:, self.cell[:, j]]
            upper += most[:, j][:, self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each part's nearest entry and squared distance, and how many exact distances that took."""
        code, distance, exact = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            lower, upper = self.bounds(part)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            true = ((part[row] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(part)))
            best = np.minimum.reduceat(true, first)
            hit = np.flatnonzero(true == best[row])
            owner, at = np.unique(row[hit], return_index=True)  # the first of the nearest: entries stand in order
            code[a + owner], distance[a : a + len(part)] = entry[hit[at]], best
            exact += len(row)
        return code, distance, exact


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, carried: list[str], scale: int) -> DataFrame:
    """``_id``, ``_v`` of whole numbers, and ``carried`` columns by number, of the vectors that can be compared."""
    v = F.col("_v")
    # two components differ by less than 2 * most * scale
    most = F.sqrt(F.lit(float(LIMIT)) / F.size(v)) / (2 * scale)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= most)
    named = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)])
    good = named.filter(v.isNotNull()).filter(F.size(v) > 0).filter(~F.exists(v, odd))
    return good.withColumn("_v", F.transform(v, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Row, part, coordinate."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def refined(vectors: DataFrame, books: list[np.ndarray], bits: int = BITS) -> list[np.ndarray]:
    """One round: every part is assigned, and each entry becomes the floor of its parts' mean."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.of(b, bits) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), parts)
            for p in range(parts):
                code, _, _ = cells[p].nearest(x[:, p])
                order = np.argsort(code, kind="stable")
                used, first, count = np.unique(code[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(x[order, p], first, axis=0)
                n = len(used)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = vectors.select("_v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    size = books[0].shape[1]
    exact = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    out = [b.copy() for b in books]
    # a row for each entry of each part, whatever the input
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
        out[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(size)]
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> list[np.ndarray]:
    """The codebook of each part, entries by coordinates; ``vectors`` are of one length, which ``parts`` divides."""
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()
    if not first:
        return []
    start = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, -1)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        books = refined(vectors, books, bits)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], bits: int = BITS) -> DataFrame:
    """``vectors`` with ``code``, two hex digits a part, and ``error``, the squared distances of all parts; ``_v`` goes."""
    kept = [f for f in vectors.schema.fields if f.name != "_v"]
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.of(b, bits) for b in books]
        for batch in batches:
            x = _matrix(batch.column("_v"), parts)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts if len(x) else 0):
                codes[:, p], distance, _ = cells[p].nearest(x[:, p])
                error += distance
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(text, pa.string()), pa.array(error)], [*[f.name for f in kept], "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return vectors.mapInArrow(run, f"{kinds}, code string, error long")


def decode(code: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that ``code`` stands for: its entries' coordinates, in the input's scale."""
    tables = [F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in b]) for b in books]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*[F.get(t, at(p)) for p, t in enumerate(tables)])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all coordinates as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> tuple[DataFrame, list[np.ndarray]]:
    """The id, ``code``, ``error`` and ``label_error`` of each vector, the error of all with its label; and the codebooks."""
    if entries > 256:
        raise ValueError("a code has one byte a part")
    share_code(df.sparkSession)
    scratch = Scratch(df.sparkSession, "vector-codes")
    good = scratch.keep(whole_vectors(df, id_col, vector_col, [label_col], scale), "good")
    first = good.orderBy(F.col("_id").asc_nulls_last(), "_v").select(F.size("_v").alias("n")).first()
    length = first["n"] if first and first["n"] % parts == 0 else 0
    vectors = good.filter(F.size("_v") == length)
    books = train(vectors, parts, entries, rounds, bits) if length else []
    if not books:
        none = vectors.limit(0).select(F.col("_id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, books
    coded = scratch.keep(encode(vectors, books, bits), "coded")
    by_label = scratch.keep(coded.groupBy("_c0").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    out = attach(coded, by_label, "_c0", "_n")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error"), books


def op13_va_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of 8 bytes for ``embeddings``, by 16 entries a part after 6 rounds."""
    out, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The rounds as relations, one after the other."""
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE (SELECT bool_and(u IS NOT NULL AND isfinite(u)) FROM unnest(embedding) AS t(u))
), x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(e) // {PARTS}) AS part, (i - 1) % (len(e) // {PARTS}) AS pos, CAST(floor({SCALE}::DOUBLE * e[i]) AS BIGINT) AS v
  FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM kept)
), b0 AS MATERIALIZED (
  SELECT part, entry, pos, v AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)
)"""
    for k in range(ROUNDS + 1):
        text += f""", a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d
  FROM (SELECT vec_id, part, entry, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d FROM x JOIN b{k} USING (part, pos) GROUP BY vec_id, part, entry) GROUP BY vec_id, part
)"""
        if k < ROUNDS:
            # // cuts towards zero, so the remainder is made positive first
            text += f""", b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{k} LEFT JOIN (
    SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY part, entry, pos) USING (part, entry, pos)
)"""
    last = ROUNDS
    return text + f""", coded AS (
  SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


SQL = _sql()
