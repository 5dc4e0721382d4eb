"""Tables, adapters that read them as light curves and catalogues, and file readers."""

from __future__ import annotations

import fnmatch
import io
import itertools
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400000000.0)


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as curves in long form: (tic_id, event_id, t, flux, quality, c1, c2)."""
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for x in ("view", 0, "click", 64, "signup", 1, "purchase", 32, "error", 16)])
    return e.select(
        F.col("user_id").cast("string").alias("tic_id"), "event_id", days(F.col("ts")).alias("t"), F.col("value").alias("flux"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit(0)).alias("quality"),
        F.get_json_object("props", "$.k").cast("double").alias("c1"), (F.col("event_id") % 97).cast("double").alias("c2"),
    )


def toi_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects of interest: several per star, with a disposition."""
    codes = F.create_map(*[F.lit(x) for x in ("1-URGENT", "PC", "2-HIGH", "KP", "3-MEDIUM", "EB", "4-NOT SPECIFIED", None, "5-LOW", "FP")])
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tic_id"), F.col("o_orderkey").alias("toi"), F.try_element_at(codes, F.col("o_orderpriority")).alias("disposition"), F.col("o_totalprice").alias("depth"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE", comment: str | None = None, line_ends: bool = False) -> DataFrame:
    """Typed CSV: padding and header blanks stripped, doubled quotes allowed.

    PERMISSIVE keeps malformed rows as nulls, DROPMALFORMED leaves them out.  With
    ``line_ends`` quoted values may hold line ends; a file is then read by one task.
    """
    reader = spark.read.schema(schema).options(header=True, mode=mode, multiLine=line_ends, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    if comment:
        reader = reader.option("comment", comment)
    frame = reader.csv(path)
    return frame.toDF(*[c.strip() for c in frame.columns])


_CARD = re.compile(r"^(\w[\w-]*) *= *('(?:[^']|'')*'|[^/]*)")


def fits_headers(data: bytes) -> list[dict[str, str]]:
    """Key-value cards of every header of a FITS file, in blocks of 2880 bytes."""
    out, at = [], 0
    while at + 2880 <= len(data):
        cards: dict[str, str] = {}
        done = False
        while not done and at + 2880 <= len(data):
            for i in range(36):
                card = data[at + 80 * i: at + 80 * i + 80].decode("ascii", "replace")
                if card.startswith("END "):
                    done = True
                    break
                if m := _CARD.match(card):
                    cards[m[1]] = m[2].strip().strip("'").rstrip()
            at += 2880
        size = abs(int(cards.get("BITPIX", "8"))) // 8
        for k in range(1, int(cards.get("NAXIS", "0")) + 1):
            size *= int(cards.get(f"NAXIS{k}", "0"))
        at += -(-(size if int(cards.get("NAXIS", "0")) else 0) // 2880) * 2880
        out.append(cards)
    return out


FITS_SCHEMA = "path string, tic_id string, tce_ext string, period double, epoch_btjd double, depth_ppm double, duration_hr double"


def scan_fits(spark: SparkSession, folder: str, glob: str = "*.fits") -> DataFrame:
    """One row for every ``TCE_*`` extension of the FITS files below a folder, those in zip archives as well.

    An archive is opened one file after the other; ``glob`` is for the names of files in both.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{glob},*.zip}}").load(folder).select("path", "content")

    def single(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        if not path.endswith(".zip"):
            yield path, content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if fnmatch.fnmatch(name.rpartition("/")[2], glob):
                    yield f"{path}/{name}", archive.read(name)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = lambda cards, key: float(cards[key]) if cards.get(key) else None
        for batch in batches:
            for path, content in zip(*batch.columns):
                for name, data in single(path.as_py(), content.as_py()):
                    headers = fits_headers(data)
                    star = headers[0].get("TICID") if headers else None
                    for h in headers[1:]:
                        if h.get("EXTNAME", "").startswith("TCE_"):
                            yield name, star, h["EXTNAME"], *(number(h, k) for k in ("TPERIOD", "TEPOCH", "TDEPTH", "TDUR"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = found(batches)
        while out := list(itertools.islice(all_rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.float64()) for i, c in enumerate(zip(*out))], names=[x.split()[0] for x in FITS_SCHEMA.split(", ")])

    return files.mapInArrow(rows, FITS_SCHEMA)


SERIES_SCHEMA = "tic_id string, t double, flux double, quality int, c1 double, c2 double"


def scan_npz(spark: SparkSession, folder: str) -> DataFrame:
    """Array files of single stars as long form; missing centroids are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(folder).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    n = len(z["time"])
                    get = lambda k, kind: pa.array(z[k].astype(kind), from_pandas=True) if k in z.files else pa.nulls(n, pa.from_numpy_dtype(kind))  # noqa: E731, B023
                    flux = "flat_flux" if "flat_flux" in z.files else "pdcsap_flux"
                    yield pa.RecordBatch.from_arrays([pa.array([str(z["tic_id"])] * n), get("time", np.float64), get(flux, np.float64), get("quality", np.int32), get("mom_centr1", np.float64), get("mom_centr2", np.float64)], names=[x.split()[0] for x in SERIES_SCHEMA.split(", ")])

    return files.mapInArrow(rows, SERIES_SCHEMA)


def scan_segments(spark: SparkSession, folder: str, gap: float = 30.0) -> DataFrame:
    """Array files to the longest run of each star without a gap, rows without flux or time left out."""
    rows = scan_npz(spark, folder).where("t is not null and flux is not null").withColumn("event_id", F.monotonically_increasing_id())
    return series.longest_segment(rows, gap).drop("event_id", "seg")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by a schema; names that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def listed(spark: SparkSession, folder: str, glob: str = "*.npz") -> DataFrame:
    """(path, size) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"))


def scan_fits_table(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of the binary tables below a folder: doubles (NaN: null) and text (empty: null)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.fits").load(folder).select("content")
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                card = fits_headers(content)[1]
                kinds = [(card[f"TTYPE{i}"], ">f8" if card[f"TFORM{i}"] == "1D" else f"S{card[f'TFORM{i}'][:-1]}") for i in range(1, int(card["TFIELDS"]) + 1)]
                size, n = int(card["NAXIS1"]), int(card["NAXIS2"])
                # the data follow the second header and fill the file's last blocks
                table_at = len(content) - -(-size * n // 2880) * 2880
                found = np.frombuffer(content, dtype=kinds, count=n, offset=table_at)
                columns = [pa.array(found[c].astype(float), from_pandas=True) if found.dtype[c].kind == "f" else pa.array([v.decode("ascii") or None for v in found[c].tolist()], pa.string()) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(rows, schema)
