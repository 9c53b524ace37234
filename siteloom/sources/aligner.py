"""Alignment is done by programs outside: reads go to their standard input as FASTQ, SAM text comes back."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siteloom.session import ship
from siteloom.sources.files import parse_sam


def check_aligner(command: list[str], index: list[str] = []) -> None:
    """The program can be found and all files of its index are there."""
    if not shutil.which(command[0]):
        raise FileNotFoundError(f"no such program: {command[0]}")
    if missing := [f for f in index if not os.path.exists(f)]:
        raise FileNotFoundError(f"missing index files: {missing}")


def aligned_lines(records: Iterator[str], command: list[str]) -> Iterator[str]:
    """What the program writes, line by line, for records given to its standard input. Its input is spooled to a file, so neither side waits for the other."""
    with tempfile.TemporaryFile("w+") as given, tempfile.TemporaryFile("w+") as said:
        given.writelines(records)
        given.seek(0)
        program = subprocess.Popen(command, stdin=given, stdout=subprocess.PIPE, stderr=said, text=True)
        yield from (line.rstrip("\n") for line in program.stdout)
        if program.wait():
            said.seek(0)
            raise RuntimeError(f"{command[0]} failed: {said.read()[-2000:]}")


def align(reads: DataFrame, command: list[str], index: list[str] = []) -> DataFrame:
    """Alignments, as parse_sam gives them, of reads (read_name, seq1, qual1 and, for pairs, seq2, qual2).

    Each partition of reads starts the program once. Pairs are interleaved. What a read's header says after
    its name (UMIs, matches) is joined again by name, as most programs leave it out: columns ltr_umi,
    linker_umi, ltr_match and linker_match of reads replace those of the SAM text.
    """
    check_aligner(command, index)
    ship(reads.sparkSession)
    mates = [k for k in ("1", "2") if f"seq{k}" in reads.columns]
    sent = reads.select("read_name", *[c for k in mates for c in (f"seq{k}", f"qual{k}")])

    def run(batches):
        def records():
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    for k in mates:
                        yield f"@{row.read_name}\n{getattr(row, f'seq{k}')}\n+\n{getattr(row, f'qual{k}')}\n"

        some, at = [], 0
        for line in aligned_lines(records(), command):
            some.append(line)
            if len(some) == 4096:
                yield pd.DataFrame({"at": range(at, at + 4096), "value": some})
                some, at = [], at + 4096
        yield pd.DataFrame({"at": range(at, at + len(some)), "value": some})

    found = parse_sam(sent.mapInPandas(run, "at long, value string"))
    tags = [c for c in ("ltr_umi", "linker_umi", "ltr_match", "linker_match") if c in reads.columns]
    return found.drop(*tags).join(reads.select("read_name", *tags), "read_name").select(*found.columns) if tags else found


def contaminants_removed(reads: DataFrame, command: list[str], index: list[str] = []) -> DataFrame:
    """reads without those that align, with either mate, to another genome (such as a vector's)."""
    return reads.join(align(reads, command, index).select("read_name").distinct(), "read_name", "left_anti")
