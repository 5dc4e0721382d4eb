"""Writers: delimited text, JSON lines, array files of single stars, FITS tables and headers, models.

Files made inside tasks are written under a temporary name and then renamed, so a
task that runs twice leaves one whole file.
"""

from __future__ import annotations

import io
import itertools
import math
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog
from ..shared import spread
from ..sources import read_csv

_TEXT = {"header": True, "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_TEXT).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds files to the folder; rows that are there stay as they are."""
    df.write.mode("append").options(**_TEXT).csv(path)


def upsert_csv(new: DataFrame, path: str, keys: Sequence[str], schema: T.StructType, out: str) -> None:
    """Rows of ``path`` and ``new`` by key, ``new`` first, written to the folder ``out``."""
    write_csv(catalog.upsert(read_csv(new.sparkSession, path, schema), new, keys), out)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _put(path: str, content: bytes) -> None:
    """Write bytes through the URI's file system; a repeated write replaces the file."""
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, name)


def write_arrays(lc: DataFrame, folder: str) -> DataFrame:
    """One array file for each star, as ``TIC_<id>.npz``; (tic_id, path, n_rows) when evaluated.

    A group is one star's curve.  Rows are in order of time; null values become NaN.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"], kind="stable")
        star = str(pdf["tic_id"].iloc[0])
        buffer = io.BytesIO()
        np.savez_compressed(
            buffer, tic_id=star, time=pdf["t"].to_numpy(float), pdcsap_flux=pdf["flux"].to_numpy(float), quality=pdf["quality"].to_numpy(np.int32),
            mom_centr1=pdf["c1"].to_numpy(float), mom_centr2=pdf["c2"].to_numpy(float),
        )
        path = f"{folder}/TIC_{star}.npz"
        _put(path, buffer.getvalue())
        return pd.DataFrame([(star, path, len(pdf))], columns=["tic_id", "path", "n_rows"])

    rows = lc.where("tic_id is not null").select("tic_id", "event_id", "t", "flux", F.coalesce("quality", F.lit(0)).alias("quality"), "c1", "c2")
    return rows.groupBy("tic_id").applyInPandas(one, "tic_id string, path string, n_rows bigint")


def _cards(pairs: list[tuple[str, object]]) -> bytes:
    """A FITS header: cards of 80 bytes, padded to a block of 2880."""
    show = lambda v: ("T" if v else "F") if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else str(v)
    lines = [f"{k:<8}= {show(v):<20}" if isinstance(v, str) else f"{k:<8}= {show(v):>20}" for k, v in pairs]
    text = "".join(f"{x:<80}" for x in [*lines, "END"])
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii")


def fits_table(pdf: pd.DataFrame, name: str = "CATALOG") -> bytes:
    """A FITS file with one binary table: numbers as doubles (null: NaN), all else as text (null: empty)."""
    fields, values = [], []
    for column in pdf.columns:
        x = pdf[column]
        if pd.api.types.is_numeric_dtype(x) and not pd.api.types.is_bool_dtype(x):
            fields.append((column, ">f8", "1D"))
            values.append(x.to_numpy(float))
        else:
            text = [b"" if pd.isna(v) else str(v).encode("ascii", "replace") for v in x]
            size = max([1, *map(len, text)])
            fields.append((column, f"S{size}", f"{size}A"))
            values.append(text)
    rows = np.zeros(len(pdf), dtype=[(n, kind) for n, kind, _ in fields])
    for (n, _, _), v in zip(fields, values):
        rows[n] = v
    data = rows.tobytes()
    data += b"\0" * (-len(data) % 2880)
    described = [card for i, (n, _, form) in enumerate(fields, 1) for card in ((f"TTYPE{i}", n), (f"TFORM{i}", form))]
    first = _cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields)), ("EXTNAME", name)]
    return first + _cards(head + described) + data


def fits_signals(star: str | None, signals: Sequence[dict[str, float | None]]) -> bytes:
    """A FITS file of one star whose extensions TCE_1, TCE_2, ... hold signals in their headers only."""
    out = [_cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), *([] if star is None else [("TICID", star)])])]
    for i, signal in enumerate(signals, 1):
        out.append(_cards([("XTENSION", "IMAGE"), ("BITPIX", 8), ("NAXIS", 0), ("EXTNAME", f"TCE_{i}"), *((k, v) for k, v in signal.items() if v is not None)]))
    return b"".join(out)


PACKAGE = 64 << 20  # bytes of files in one package, before they are packed


def write_signals(signals: DataFrame, folder: str, package: int = PACKAGE) -> DataFrame:
    """One file of headers for each star, from (tic_id, tce, period, epoch, depth, duration); (tic_id, path) when evaluated.

    Headers are blocks of 2880 bytes, nearly all of them blanks, so the files of many stars are packed
    into one zip archive, in folders by the last sign of the id; a path is the archive's and the file's in it.
    A task holds the packed bytes of one archive and the signals of one star.
    """
    names = ("TPERIOD", "TEPOCH", "TDEPTH", "TDUR")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        archive, where, stars, size = None, "", [], 0

        def closed() -> pa.RecordBatch:
            archive.close()
            path = f"{folder}/{where}/part-{task:05d}-{made:05d}.zip"
            _put(path, buffer.getvalue())
            return pa.RecordBatch.from_arrays([pa.array(stars, pa.string()), pa.array([f"{path}/TIC_{star}_dvt.fits" for star in stars], pa.string())], names=["tic_id", "path"])

        for star, found in itertools.groupby(rows, key=lambda row: row[0]):
            last = (star or "none")[-1:]
            if archive and (last != where or size >= package):
                yield closed()
                archive, made = None, made + 1
            if not archive:
                buffer = io.BytesIO()
                archive, where, stars, size = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1), last, [], 0
            content = fits_signals(star, [{k: None if v is None or math.isnan(v) else float(v) for k, v in zip(names, row[2:])} for row in found])
            archive.writestr(zipfile.ZipInfo(f"TIC_{star}_dvt.fits"), content, zipfile.ZIP_DEFLATED, 1)
            stars.append(star)
            size += len(content)
        if archive:
            yield closed()

    rows = spread(signals.select("tic_id", "tce", "period", "epoch", "depth", "duration"), "tic_id")
    return rows.sortWithinPartitions(F.right("tic_id", F.lit(1)), "tic_id", "tce").mapInArrow(run, "tic_id string, path string")


def write_fits(df: DataFrame, folder: str) -> DataFrame:
    """A FITS table for each batch of rows of each task, as wide as its longest texts; (path, n_rows) when evaluated.

    One file for all needs ``df.coalesce(1)`` and a batch that holds the catalogue.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for i, pdf in enumerate(batches):
            path = f"{folder}/part-{task:05d}-{i:05d}.fits"
            _put(path, fits_table(pdf))
            yield pd.DataFrame([(path, len(pdf))], columns=["path", "n_rows"])

    return df.mapInPandas(run, "path string, n_rows bigint")
