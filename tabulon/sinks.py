"""Results as CSV, JSON and ZIP."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

from .errors import RequestError
from .functions.names import safe_stem


def csv_bytes(df: DataFrame, header: bool = True) -> bytes:
    """A small result as CSV with a byte order mark."""
    return df.toPandas().to_csv(index=False, header=header).encode("utf-8-sig")


def export_csv(df: DataFrame, path: str, overwrite: bool = False, header: bool = True) -> Path:
    target = Path(path)
    if target.suffix.lower() != ".csv":
        raise RequestError("the file must end in .csv")
    if target.exists() and not overwrite:
        raise FileExistsError(str(target))
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(csv_bytes(df, header))
    return target


def write_csv(df: DataFrame, path: str) -> None:
    """A result of any size as a folder of CSV files, written by the executors."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def records(df: DataFrame, limit: int | None = None) -> list[dict]:
    rows = df if limit is None else df.limit(limit)
    return [json.loads(x) for x in rows.toJSON().collect()]


def download_zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            if "/" in name or "\\" in name or not name.endswith(".csv"):
                raise RequestError(f"{name!r} can't be a file of the archive")
            z.writestr(name, data)
    return out.getvalue()


def batch_names(parts: list[tuple[str, str]]) -> list[str]:
    """stem__file for each (document, file), numbered where two clash."""
    out: list[str] = []
    for document, file in parts:
        base = f"{safe_stem(Path(document).stem)}__{file}"
        name, n = base, 1
        while name in out:
            n += 1
            name = f"{base.removesuffix('.csv')}_{n}.csv"
        out.append(name)
    return out


def fingerprint(df: DataFrame) -> str:
    return hashlib.sha256(csv_bytes(df)).hexdigest()[:12]
