"""Files of a working copy, for credential scans."""

from __future__ import annotations

import argparse
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from recollect.operators import safety


def tracked(root: Path) -> list[Path]:
    out = subprocess.run(["git", "-C", str(root), "ls-files", "-z"], check=True, capture_output=True).stdout
    return [root / x.decode(errors="surrogateescape") for x in out.split(b"\0") if x]


def targets(root: Path, paths: Sequence[str] = ()) -> list[Path]:
    """The given paths, relative ones to the root, or else all tracked ones; files only."""
    chosen = [p if p.is_absolute() else root / p for p in map(Path, paths)] if paths else tracked(root)
    return [p for p in chosen if p.is_file()]


def readable(files: Sequence[Path]) -> tuple[list[Path], list[Path]]:
    """Files that can be opened, and those that cannot: one of these is a finding, not the end of the scan."""
    good, bad = [], []
    for p in files:
        try:
            p.open("rb").close()
            good.append(p)
        except OSError:
            bad.append(p)
    return good, bad


def file_contents(spark: SparkSession, files: Sequence[Path]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load([f"file://{p}" for p in files]).select("path", "content")


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Scan files for leaked credentials.")
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--root", default=".")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    good, bad = readable(targets(Path(args.root).resolve(), args.paths))
    found = safety.scan_files(file_contents(spark, good))
    rows = found.orderBy("path", "cell", "line", "label").collect()
    for r in rows:
        print(f"- {r['path']}:{r['line'] or ''}: {r['label']}")
    for p in bad:
        print(f"- {p}:1: cannot read file")
    return int(bool(rows or bad))


if __name__ == "__main__":
    raise SystemExit(main())
