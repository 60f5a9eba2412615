"""PLINK BED/BIM/FAM genotypes on storage that all nodes reach: data sources, text readers, a distributed writer.

Files are read by byte ranges through Arrow's file systems (paths, ``file://``, ``hdfs://``, ``s3://``, ``gs://``). A store is a trio
``prefix.bed/.bim/.fam`` or a folder as ``write`` makes it: ``part-*.bed`` and ``part-*.bim`` for ranges of variants in order, and
``fam/part-*`` for the samples.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.blocks import BINARY, INT, MISSING, ROWS, TILE, Panel, _fields, _streamed, pack, packed_blocks, standardized_panel, unpack
from .staging import staged

#: Fixed values of the format: the first three bytes, and the dosage of each 2-bit code (-1 is missing).
MAGIC = b"\x6c\x1b\x01"
CODES = np.array([2, -1, 1, 0], dtype=np.int8)
BITS = {0: 0b11, 1: 0b10, 2: 0b00, -1: 0b01}


def _fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _exists(path: str) -> bool:
    fs, at = _fs(path)
    return fs.get_file_info(at).type == arrow_fs.FileType.File


def _listed(folder: str, start: str, end: str) -> list[str]:
    fs, at = _fs(folder)
    found = fs.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == arrow_fs.FileType.File)
    return [f"{folder}/{n}" for n in names if n.startswith(start) and n.endswith(end)]


def is_prefix(prefix: str) -> bool:
    return all(_exists(f"{prefix}.{x}") for x in ("bed", "bim", "fam"))


def is_store(folder: str) -> bool:
    """A folder whose writer has committed."""
    return _exists(f"{folder}/_SUCCESS") and bool(_listed(f"{folder}/fam", "part-", ""))


def check(prefix: str) -> None:
    for x in ("bed", "bim", "fam"):
        if not _exists(f"{prefix}.{x}"):
            raise FileNotFoundError(f"{prefix}.{x}")
    _check_bed(f"{prefix}.bed")


def _check_bed(path: str) -> None:
    fs, at = _fs(path)
    with fs.open_input_file(at) as f:
        if f.read_at(3, 0) != MAGIC:
            raise ValueError(f"{path} is no variant-major BED file")


def _numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``at, line``: lines that are not blank, numbered through the files in the order given."""
    lines = spark.sparkContext.union([spark.sparkContext.textFile(f) for f in files])
    return spark.createDataFrame(lines.filter(lambda x: bool(x.strip())).zipWithIndex(), "line string, at long")


def read_fam(spark: SparkSession, prefix: str) -> DataFrame:
    """``row_idx, sample_id`` in file order, blank lines left out; a second field that is no integer raises when read."""
    lines = _numbered_lines(spark, _listed(f"{prefix}/fam", "part-", "") if is_store(prefix) else [f"{prefix}.fam"])
    return lines.select(F.col("at").cast("int").alias("row_idx"), F.split(F.trim("line"), "\\s+")[1].cast("long").alias("sample_id"))


def read_bim(spark: SparkSession, prefix: str) -> DataFrame:
    """``variant_idx, chrom, rsid, cm, bp, a1, a2`` in file order; missing alleles are empty."""
    f = _numbered_lines(spark, _listed(prefix, "part-", ".bim") if is_store(prefix) else [f"{prefix}.bim"]).select("at", F.split(F.trim("line"), "\\s+").alias("f"))
    get = lambda k: F.get("f", F.lit(k))
    return f.select(
        F.col("at").cast("int").alias("variant_idx"), get(0).alias("chrom"), get(1).alias("rsid"), get(2).cast("double").alias("cm"), get(3).cast("long").alias("bp"),
        F.coalesce(get(4), F.lit("")).alias("a1"), F.coalesce(get(5), F.lit("")).alias("a2"),
    )


@dataclass
class Layout:
    """Where the bytes of each variant are: ``files`` are (path, first variant, variants)."""

    files: list[tuple[str, int, int]]
    n: int
    bytes_each: int

    @property
    def m(self) -> int:
        return sum(k for _, _, k in self.files)

    def variants(self, lo: int, hi: int) -> np.ndarray:
        """BED bytes of variants lo to hi - 1, a row each: one range of bytes from each file that has some."""
        out = []
        for path, first, count in self.files:
            a, b = max(lo, first), min(hi, first + count)
            if a < b:
                fs, at = _fs(path)
                with fs.open_input_file(at) as f:
                    out.append(np.frombuffer(f.read_at((b - a) * self.bytes_each, 3 + (a - first) * self.bytes_each), np.uint8).reshape(b - a, self.bytes_each))
        return np.vstack(out) if out else np.zeros((0, self.bytes_each), np.uint8)


def layout(prefix: str) -> tuple[Layout, list[str]]:
    """The layout of a trio or folder, and its FAM files; bad magic, or a trio that is not whole, raises."""
    if is_store(prefix):
        beds, fams = _listed(prefix, "part-", ".bed"), _listed(f"{prefix}/fam", "part-", "")
        for path in beds:
            _check_bed(path)
    else:
        check(prefix)
        beds, fams = [f"{prefix}.bed"], [f"{prefix}.fam"]
    n = 0
    for path in fams:
        fs, at = _fs(path)
        with fs.open_input_stream(at) as f:
            n += sum(bool(line.strip()) for line in f.read().split(b"\n"))
    each, files, first = -(-n // 4), [], 0
    for path in beds:
        fs, at = _fs(path)
        count = (fs.get_file_info(at).size - 3) // max(each, 1)
        files.append((path, first, count))
        first += count
    return Layout(files, n, each), fams


def _ids(fams: list[str]) -> np.ndarray:
    out = []
    for path in fams:
        fs, at = _fs(path)
        with fs.open_input_stream(at) as f:
            out += [int(line.split()[1]) for line in f.read().split(b"\n") if line.strip()]
    return np.array(out, dtype=np.int64)


@dataclass
class _Variants(InputPartition):
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout, self.fams = layout(options["path"])
        self.chunk = int(options.get("chunk", 4096))
        m = self.layout.m
        self.lo, self.hi = int(options.get("from", 0)), int(options.get("to", m))
        if not 0 <= self.lo <= self.hi <= m:
            raise ValueError(f"variants {self.lo} to {self.hi} of {m}")
        rows = options.get("rows")
        self.rows = np.array([int(x) for x in rows.split(",")], dtype=np.int64) if rows else None
        if self.rows is not None and len(self.rows) and not (0 <= self.rows.min() and self.rows.max() < self.layout.n):
            raise ValueError("row out of range")

    def partitions(self) -> list[_Variants]:
        return [_Variants(k, min(k + self.chunk, self.hi)) for k in range(self.lo, self.hi, self.chunk)]

    def read(self, partition: _Variants) -> Iterator[pa.RecordBatch]:
        rows = np.arange(self.layout.n) if self.rows is None else self.rows
        ids = _ids(self.fams)[rows]
        # A few variants at a time, whatever the chunk.
        for lo in range(partition.lo, partition.hi, 64):
            for j, packed in enumerate(self.layout.variants(lo, min(lo + 64, partition.hi)), lo):
                x = CODES[(packed[rows // 4] >> (2 * (rows % 4)).astype(np.uint8)) & 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), j), pa.int32()), pa.array(ids, pa.int64()), pa.array(x, pa.int8(), mask=x < 0)],
                    names=["variant_idx", "sample_id", "x"],
                )


class PlinkSource(DataSource):
    """``spark.read.format("plink").load(prefix)``: ``variant_idx, sample_id, x`` with null for missing.

    A partition is a range of ``chunk`` variants. Options ``from`` and ``to`` bound the variants (half-open), ``rows``
    lists sample rows (by commas), in that order: only their bytes are decoded. Writing takes rows of ``variant_rows``.
    """

    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return "variant_idx int, sample_id long, x byte"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


@dataclass
class _Tile(InputPartition):
    tile: int


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout, _ = layout(options["path"])
        self.tile, self.rows = int(options.get("tile", TILE)), int(options.get("rows", ROWS))
        if self.rows % 4:
            raise ValueError("sample groups are whole bytes: rows must be a multiple of 4")

    def partitions(self) -> list[_Tile]:
        return [_Tile(t) for t in range(-(-self.layout.m // self.tile))]

    def read(self, partition: _Tile) -> Iterator[pa.RecordBatch]:
        lo = partition.tile * self.tile
        raw = self.layout.variants(lo, min(lo + self.tile, self.layout.m))
        dosage = np.where(CODES < 0, MISSING, CODES).astype(np.uint8)
        for group in range(-(-self.layout.n // self.rows)):
            n = min(self.rows, self.layout.n - group * self.rows)
            part = raw[:, group * self.rows // 4 : group * self.rows // 4 + -(-n // 4)]
            codes = dosage[(part[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3].reshape(len(raw), -1)[:, :n]
            whole = np.full((n, self.tile), MISSING, dtype=np.uint8)
            whole[:, : len(raw)] = codes.T
            yield pa.RecordBatch.from_arrays([pa.array([partition.tile], pa.int32()), pa.array([group], pa.int32()), pa.array([n], pa.int32()), pa.array([pack(whole)], pa.binary())], names=["tile", "rows", "n", "packed"])


class PlinkBlocks(DataSource):
    """``spark.read.format("plink_blocks").load(prefix)``: ``tile, rows, n, packed`` as ``blocks.packed_blocks`` makes them.

    A partition reads the bytes of one tile of variants, which are one range (or one of each part file it crosses), and turns them
    from variant-major to blocks: no row a genotype. Options ``tile`` and ``rows``.
    """

    @classmethod
    def name(cls) -> str:
        return "plink_blocks"

    def schema(self) -> str:
        return "tile int, rows int, n int, packed binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlinkSource)
    spark.dataSource.register(PlinkBlocks)


def read_panel(spark: SparkSession, prefix: str, tile: int = TILE, rows: int = ROWS) -> Panel:
    """A store as a panel, straight from its bytes; sample groups are runs of ``rows`` samples in file order."""
    register(spark)
    place, _ = layout(prefix)
    samples = staged(read_fam(spark, prefix).select("sample_id", F.floor(F.col("row_idx") / rows).cast("int").alias("rows"), (F.col("row_idx") % rows).alias("at")))
    blocks = spark.read.format("plink_blocks").option("tile", tile).option("rows", rows).load(prefix)
    return standardized_panel(blocks, samples, place.m, place.n, max(1, -(-place.n // rows)), tile)


def variant_rows(dosage: DataFrame, samples: DataFrame, variants: DataFrame, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """``variant_idx, line, packed``: a BIM line and BED bytes for each variant, from dosages in long form.

    ``samples``: ``row_idx, sample_id``, gapless from 0; ``variants``: as ``read_bim`` gives. Dosages are packed by tile and sample
    group first; a variant's bytes are then put together from its groups (a quarter byte a sample).
    """
    placed = samples.select("sample_id", F.floor(F.col("row_idx") / rows).cast("int").alias("rows"), (F.col("row_idx") % rows).cast("int").alias("at"))
    bits = np.array([BITS[0], BITS[1], BITS[2], BITS[-1]], dtype=np.uint8)

    def step(given: Iterator[dict]) -> Iterator[tuple]:
        for r in given:
            codes = bits[unpack(r["packed"], r["n"], tile)].T
            wide = np.zeros((tile, -(-r["n"] // 4) * 4), dtype=np.uint8)
            wide[:, : r["n"]] = codes
            four = wide.reshape(tile, -1, 4)
            packed = (four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6).astype(np.uint8)
            for k in range(tile):
                yield r["tile"] * tile + k, r["rows"], packed[k].tobytes()

    cut = _streamed(packed_blocks(dosage, staged(placed), tile), _fields(("variant_idx", INT), ("rows", INT), ("packed", BINARY)), step)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rows", "packed"))), lambda e: F.hex(e["packed"])))
    whole = cut.groupBy("variant_idx").agg(F.unhex(joined).alias("packed"))
    line = F.concat_ws("\t", "chrom", "rsid", F.coalesce(F.col("cm").cast("string"), F.lit("0")), "bp", "a1", "a2")
    return variants.select("variant_idx", line.alias("line")).join(whole, "variant_idx")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Each task writes its variants as one part of its own; only parts of committed tasks move into the folder."""

    def __init__(self, folder: str):
        self.folder, self.trial = folder, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        rows = sorted((tuple(r) for r in iterator), key=lambda r: r[0])
        if not rows:
            return _Written([])
        fs, at = _fs(f"{self.folder}/{self.trial}")
        fs.create_dir(at, recursive=True)
        name = f"part-{rows[0][0]:010d}-{uuid.uuid4().hex[:8]}"
        with fs.open_output_stream(f"{at}/{name}.bed") as f:
            f.write(MAGIC)
            for _, _, packed in rows:
                f.write(bytes(packed))
        with fs.open_output_stream(f"{at}/{name}.bim") as f:
            for _, line, _ in rows:
                f.write(f"{line}\n".encode())
        return _Written([name])

    def commit(self, messages) -> None:
        fs, at = _fs(self.folder)
        for m in messages:
            for name in m.names if m else []:
                for x in ("bed", "bim"):
                    fs.move(f"{at}/{self.trial}/{name}.{x}", f"{at}/{name}.{x}")
        self._clear()
        with fs.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, at = _fs(f"{self.folder}/{self.trial}")
        if fs.get_file_info(at).type == arrow_fs.FileType.Directory:
            fs.delete_dir(at)


def write(dosage: DataFrame, samples: DataFrame, variants: DataFrame, folder: str, parts: int = 8, tile: int = TILE, rows: int = ROWS) -> None:
    """Write dosages in long form as a folder of PLINK parts: ``parts`` tasks write ranges of variants, another job the samples.

    The folder counts as a store only when ``_SUCCESS`` is there, which the commit writes last; a failed job leaves no part.
    """
    spark = dosage.sparkSession
    register(spark)
    ordered = samples.repartitionByRange(parts, "row_idx").sortWithinPartitions("row_idx")
    ordered.select(F.concat_ws(" ", "sample_id", "sample_id", F.lit("0 0 0 -9")).alias("value")).write.text(f"{folder}/fam")
    made = variant_rows(dosage, samples, variants, tile, rows).repartitionByRange(parts, "variant_idx").sortWithinPartitions("variant_idx")
    made.write.format("plink").mode("append").save(folder)


def write_trio(prefix: str, genotypes: np.ndarray, ids: list[int]) -> None:
    """Write a small (samples, variants) array of 0, 1, 2 and -1 as a trio: for fixtures."""
    n, m = genotypes.shape
    bits = np.zeros((-(-n // 4) * 4, m), np.uint8)
    for value, code in BITS.items():
        bits[:n][genotypes == value] = code
    packed = (bits.reshape(-1, 4, m) << np.array([0, 2, 4, 6], np.uint8)[None, :, None]).sum(axis=1).astype(np.uint8)
    with open(f"{prefix}.bed", "wb") as f:
        f.write(MAGIC + packed.T.tobytes())
    with open(f"{prefix}.fam", "w") as f:
        f.writelines(f"{i} {i} 0 0 0 -9\n" for i in ids)
    with open(f"{prefix}.bim", "w") as f:
        f.writelines(f"1 rs{j} 0 {j + 1} A G\n" for j in range(m))
