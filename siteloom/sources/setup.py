"""Setup files and sample sheets: text in, one configuration for each sample out."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.session import broadcast_if_small

#: Options whose values are split at ';'.
MULTI_VALUE = ("contam", "remove_chr", "annotations")


def read_setup(text: str) -> list[dict[str, str | bool | list[str]]]:
    """Line 1: the number of samples; line 2: option names; then a line for each name with one value for all samples or one for each.

    'none' and 'false' leave an option out, 'true' makes it a flag.
    """
    lines = [line.split() for line in text.splitlines() if line.strip()]
    n, names, rows = int(lines[0][0]), lines[1], lines[2:]
    if len(rows) != len(names):
        raise ValueError(f"{len(names)} options, but {len(rows)} lines of values")
    out: list[dict] = [{} for _ in range(n)]
    for name, values in zip(names, rows):
        if len(values) not in (1, n):
            raise ValueError(f"{name}: one value or {n}")
        for k, sample in enumerate(out):
            v = values[k] if len(values) == n else values[0]
            if v.lower() in ("none", "false"):
                continue
            sample[name] = True if v.lower() == "true" else v.split(";") if name in MULTI_VALUE else v
    return out


def arguments(sample: dict) -> list[str]:
    out: list[str] = []
    for name, v in sample.items():
        out += [f"--{name}"] if v is True else [f"--{name}", *v] if isinstance(v, list) else [f"--{name}", str(v)]
    return out


def save_json(samples: list[dict], path: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(path, "w") as f:
        json.dump([arguments(s) for s in samples], f, indent=1)


def load_json(path: str) -> list[list[str]]:
    with open(path) as f:
        return json.load(f)


def sheet_vectors(rows: list[tuple[str, str, str]], mask: int = 0) -> dict[str, list[str]]:
    """From (name, integrant, linker) sequences: the part from the last run of N on is the search sequence, what stands before it the barcode, of which the first `mask` bases become N."""

    def part(seq: str) -> tuple[str, str]:
        m = re.match(r"^(.*N)?([ACGT]*)$", seq.upper())
        if not m:
            raise ValueError(f"not a sequence: {seq}")
        barcode = (m[1] or "").replace("N", "")
        return "N" * min(mask, len(barcode)) + barcode[mask:], m[2]

    cut = [(name, part(a), part(b)) for name, a, b in rows]
    return {"nm": [c[0] for c in cut], "ltr_barcode": [c[1][0] for c in cut], "ltr": [c[1][1] for c in cut], "linker_barcode": [c[2][0] for c in cut], "linker": [c[2][1] for c in cut]}


def read_sheet(spark: SparkSession, path: str, columns: tuple[int, int, int] = (1, 2, 3), indices: tuple[int, int] = (0, 0), lengths: tuple[int, int] = (20, 20), barcode: int = 10, masks: tuple[int, int] = (0, 0), prefix: str = "demux/", extension: str = "fq.gz", single: bool = False) -> DataFrame:
    """(nm, ltr, linker, ltr_barcode, linker_barcode, index1, index2, r1, r2) of the rows of a tab-separated sheet without a header.

    columns: the numbers, from 1, of name, LTR and linker sequence; indices: those of one or two index sequences (0: none). Blanks in
    values are dropped. The last `lengths` bases are the search sequences, the first `barcode` ones the barcodes (0: none), of
    which the first `masks` bases become N. r1 and r2 are the files of the demultiplexed sample (single: no r2). A
    sequence that is shorter than both parts together is an error, and so are parts of fewer than 5 bases.
    """
    if min(lengths) < 5 or 0 < barcode < 5:
        raise ValueError("search sequences and barcodes have at least 5 bases")
    cells = F.split("value", "\t")
    cell = lambda k: F.regexp_replace(F.get(cells, F.lit(k - 1)), r"\s", "")
    rows = spark.read.text(path).select(cell(columns[0]).alias("nm"), *(cell(c).alias(x) for c, x in zip(columns[1:], ("a", "b"))), *((cell(c) if c else F.lit(None).cast("string")).alias(f"index{k}") for k, c in enumerate(indices, 1)))
    whole = lambda x, n: F.when(F.length(x) >= n + barcode, F.col(x)).otherwise(F.raise_error(F.concat(F.lit(f"shorter than {n + barcode}: "), F.coalesce(x, F.lit("nothing")))))
    code = lambda x, n, mask: F.overlay(F.substring(whole(x, n), 1, barcode), F.lit("N" * min(mask, barcode)), F.lit(1))
    file = lambda mate: F.concat(F.lit(prefix), "nm", F.lit(f"_{mate}.{extension}"))
    return rows.select(
        "nm", F.right(whole("a", lengths[0]), F.lit(lengths[0])).alias("ltr"), F.right(whole("b", lengths[1]), F.lit(lengths[1])).alias("linker"),
        *((code(x, n, m) if barcode else F.lit(None).cast("string")).alias(f"{c}_barcode") for x, n, m, c in zip("ab", lengths, masks, ("ltr", "linker"))),
        "index1", "index2", file("Rltr").alias("r1"), (F.lit(None).cast("string") if single else file("Rlink")).alias("r2"),
    )


def vector(sheet: DataFrame, column: str) -> str:
    """A column of a sheet as the value of an option for all samples, in the order of their names; a sheet has a row for each sample."""
    return ",".join(str(r[0]) for r in sheet.orderBy("nm").select(column).collect())


def write_sheet_fasta(sheet: DataFrame, path: str) -> list[str]:
    """Barcodes and indices of a sheet as FASTA, a folder of each column that has values, with the sample as the name; the columns."""
    columns = ["ltr_barcode", "linker_barcode", "index1", "index2"]
    held = sheet.agg(*[F.count(c).alias(c) for c in columns]).first()
    for c in (c for c in columns if held[c]):
        sheet.where(F.col(c).isNotNull()).select(F.concat(F.lit(">"), "nm", F.lit("\n"), c).alias("value")).write.text(f"{path}/{c}")
    return [c for c in columns if held[c]]


def primer_lookup(sheet: DataFrame, primers: DataFrame, columns: tuple[str, str] = ("ltr", "linker")) -> DataFrame:
    """sheet with ids in two columns replaced by the upper-cased sequences of the table (id, sequence); unknown ids stay, and <column>_known tells."""
    out = sheet
    for c in columns:
        p = primers.select(F.col("id").alias(c), F.upper("sequence").alias("__seq"))
        out = out.join(broadcast_if_small(p), c, "left").withColumn(f"{c}_known", F.col("__seq").isNotNull()).withColumn(c, F.coalesce("__seq", c)).drop("__seq")
    return out
