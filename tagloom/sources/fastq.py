"""FASTQ as a Spark data source, with the ordinal of each read.

A plain file is read in byte ranges: a first job counts the lines of each range in the executors, and their sums give
the lines before it, so that ordinals are exact and a quality line that begins with `@` is never taken for a header.
A gzip file is one range, as it can't be cut. A file may be given in parts, each of whole records: ordinals run on
through them, and they are read beside each other, also if they are gzip.
Paths must be readable by all executors (a shared file system).
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range of a plain file; a task reads one, or several that are smaller.
RANGE_BYTES = 64 << 20

#: Bytes that are parsed at a time.
CHUNK_BYTES = 4 << 20


class _Range:
    def __init__(self, path: str, index: int, start: int, end: int, line: int):
        self.path, self.index, self.start, self.end, self.line = path, index, start, end, line


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def _lines_between(path: str, start: int, end: int) -> int:
    """Line ends in a byte range (of a gzip file, end -1, in all of it); the end of the file ends a line too."""
    count, last = 0, b"\n"
    whole = end < 0
    with gzip.open(path, "rb") if whole else open(path, "rb") as f:
        if not whole:
            f.seek(start)
        while (whole or start < end) and (data := f.read(1 << 20 if whole else min(1 << 20, end - start))):
            count += data.count(b"\n")
            start, last = start + len(data), data[-1:]
        return count + (last != b"\n" and not f.read(1))


def byte_ranges(paths: list[str], size: int = RANGE_BYTES, files: list[int] | None = None) -> list[tuple[str, int, int, int]]:
    """(path, number, start, end) of the ranges of each path; a gzip file is one, with the end -1. `files`: the number of each path's file."""
    out = []
    for index, path in zip(range(len(paths)) if files is None else files, paths, strict=True):
        if path.endswith(".gz"):
            out.append((path, index, 0, -1))
        else:
            whole = os.path.getsize(path)
            out += [(path, index, a, min(a + size, whole)) for a in range(0, max(whole, 1), size)]
    return out


def count_lines(spark: SparkSession, ranges: list[tuple[str, int, int, int]]) -> list[int]:
    """Line ends in each range that another one of its file follows (0 for others), counted by the executors; a number a range comes back."""
    needed = [(i, p, a, b) for i, (p, f, a, b) in enumerate(ranges) if i + 1 < len(ranges) and ranges[i + 1][1] == f]
    if not needed:
        return [0] * len(ranges)
    parts = min(len(needed), max(2, spark.sparkContext.defaultParallelism * 4))
    got = spark.sparkContext.parallelize(needed, parts).map(lambda r: (r[0], _lines_between(*r[1:]))).collectAsMap()
    return [got.get(i, 0) for i in range(len(ranges))]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\x1f") if p] if "paths" in options else [options["path"]]
        self.files = [int(n) for n in options["files"].split(",")] if options.get("files") else None
        self.last = int(options.get("last", -1))
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tasks = int(options.get("tasks", 64))
        self.reads = 2 if options.get("interleaved") == "true" else 1
        self.counts = [int(n) for n in options["linecounts"].split(",") if n] if "linecounts" in options else None

    def partitions(self) -> list[_Ranges]:
        out, line = [], 0
        ranges = byte_ranges(self.paths, self.bytes, self.files)
        # counted by read_fastq in the executors; here only for who loads the format directly
        counts = self.counts if self.counts is not None else [_lines_between(p, a, b) for p, _, a, b in ranges]
        for (path, index, start, end), n in zip(ranges, counts, strict=True):
            line = line if out and out[-1].index == index else 0
            out.append(_Range(path, index, start, end, line))
            line += n
        # ranges far smaller than a task's are put together, as each task starts a reader
        each = max(1, min(len(out) // self.tasks, RANGE_BYTES // max(self.bytes, 1)))
        tasks = []
        for r in out:
            if tasks and r.end >= 0 and tasks[-1][-1].end >= 0 and len(tasks[-1]) < each:
                tasks[-1].append(r)
            else:
                tasks.append([r])
        return [_Ranges(t) for t in tasks]

    def _lines(self, part: _Range) -> Iterator[tuple[int, list[bytes]]]:
        """Lines of whole records (fewer only at the end of a file), in chunks, each with the ordinal of its first record."""
        each = 4 * self.reads
        with gzip.open(part.path, "rb") if part.end < 0 else open(part.path, "rb") as f:
            # records belong to the range in which their first line begins
            line, at = part.line, part.start
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at += len(f.readline())
                    line += 1
            while line % each:
                got = f.readline()
                if not got:
                    return
                at += len(got)
                line += 1
            ordinal, rest = line // each, b""
            while part.end < 0 or at < part.end:
                data = f.read(CHUNK_BYTES if part.end < 0 else min(CHUNK_BYTES, part.end - at))
                if not data:
                    break
                at += len(data)
                lines = (rest + data).split(b"\n")
                whole = (len(lines) - 1) // each * each
                rest = b"\n".join(lines[whole:])
                if whole:
                    yield ordinal, lines[:whole]
                    ordinal += whole // each
            if rest:
                lines = rest.split(b"\n")
                cut = lines.pop()
                lines += [cut + f.readline()] if cut else []
                lines += islice(iter(f.readline, b""), each - len(lines))
                yield ordinal, lines

    def _records(self, part: _Range) -> Iterator[tuple[int, list[list[bytes]]]]:
        """The first ordinal of a chunk, and headers, sequences and qualities of its reads; a blank header ends the file."""
        for ordinal, lines in self._lines(part):
            columns = [lines[i::4] for i in range(4)]
            heads = columns[0]
            n = next((i for i, h in enumerate(heads) if not h.strip()), len(heads))
            for c in columns:
                c += [b""] * (n - len(c))
            seqs, quals = [s.rstrip() for s in columns[1][:n]], [q.rstrip(b"\r\n") for q in columns[3][:n]]
            for i, (h, s, p, q) in enumerate(zip(heads, seqs, columns[2], quals)):
                if h[:1] != b"@" or p[:1] != b"+" or len(s) != len(q):
                    raise ValueError(f"record {ordinal * self.reads + i} is no FASTQ record")
            yield ordinal, [[h[1:].rstrip(b"\r\n") for h in heads[:n]], seqs, quals]
            if n < len(heads):
                return

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(partition.path)
        text = lambda values: pa.array(values, pa.string())
        for ordinal, (heads, seqs, quals) in self._records(partition):
            n = len(heads) // self.reads
            if self.last >= 0:
                n = min(n, self.last + 1 - ordinal)
            if n <= 0:
                return
            split = [h.decode().partition(" ") for h in heads[: n * self.reads]]
            own = [pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array([partition.index] * n, pa.int32())]
            if self.reads == 1:
                columns = [text([name] * n), text([a for a, _, _ in split]), text([c.strip() for _, _, c in split]), text(seqs[:n]), text(quals[:n])]
            else:
                shown = ["@" + a + (" " + c.strip() if c.strip() else "") for a, _, c in split]
                columns = [text(values[i : 2 * n : 2]) for i in (0, 1) for values in (shown, seqs, quals)]
            yield pa.RecordBatch.from_arrays(own + columns, names=[c.split(" ")[0] for c in _schema(self.reads).split(", ")])


def _schema(reads: int) -> str:
    if reads == 2:
        return "read_idx long, file_index int, header string, r1_seq string, r1_qual string, header2 string, r2_seq string, r2_qual string"
    return "read_idx long, file_index int, file string, read_name string, comment string, seq string, qual string"


class FastqSource(DataSource):
    """Format `fastq`; options `path`, or `paths` separated by U+001F, `files` (the number of each path's file), `last`
    (ordinal to stop at), `rangebytes`, `tasks` (how many there are at least, if there are ranges enough), `interleaved` (`true`: a row a pair, a last read without a mate left out)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return _schema(2 if self.options.get("interleaved") == "true" else 1)

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def _load(spark: SparkSession, files: list[list[str]], last: int, range_bytes: int, interleaved: bool) -> DataFrame:
    spark.dataSource.register(FastqSource)
    paths, numbers = list(chain(*files)), [i for i, parts in enumerate(files) for _ in parts]
    counts = ",".join(map(str, count_lines(spark, byte_ranges(paths, range_bytes, numbers))))
    options = {"paths": "\x1f".join(paths), "files": ",".join(map(str, numbers)), "last": last, "rangebytes": range_bytes, "linecounts": counts, "tasks": 8 * spark.sparkContext.defaultParallelism, "interleaved": str(interleaved).lower()}
    return spark.read.format("fastq").options(**options).load()


def read_fastq(spark: SparkSession, *paths: str | list[str], last: int = -1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Reads of plain or gzip files, one row a read and file; a list of paths is one file in parts."""
    return _load(spark, [[p] if isinstance(p, str) else list(p) for p in paths], last, range_bytes, False)


def zip_reads(reads: DataFrame, files: int) -> DataFrame:
    """One row an ordinal that all files have: (read_idx, read_name, comment, seqs, quals); name and comment of the first file."""
    along = W.partitionBy("read_idx").orderBy("file_index")
    # the row of an ordinal's first file, which sees those after it: rows are sorted once, and no lists are built before the shuffle
    mates = [F.lead(F.struct("seq", "qual"), i).over(along).alias(f"__m{i}") for i in range(1, files)]
    whole = F.lag("file_index", 1).over(along).isNull() & F.lead("file_index", files).over(along).isNull()
    whole = whole & F.lead("file_index", files - 1).over(along).isNotNull() if files > 1 else whole
    rows = reads.select("read_idx", "read_name", "comment", F.struct("seq", "qual").alias("__m0"), *mates, whole.alias("__whole")).where("__whole")
    part = lambda name: F.array(*[F.col(f"__m{i}")[name] for i in range(files)])
    return rows.select("read_idx", "read_name", "comment", part("seq").alias("seqs"), part("qual").alias("quals"))


def read_interleaved(spark: SparkSession, *paths: str) -> DataFrame:
    """Pairs of an interleaved file, or of its parts: (read_idx, header, r1_seq, r1_qual, header2, r2_seq, r2_qual)."""
    return _load(spark, [list(paths)], -1, RANGE_BYTES, True).drop("file_index")
