"""ZIP archives as a data source, batch and stream (SRC-10, 12).

``spark.read.format("archive")`` gives a row per member. Archives are opened
where they are read, by seeking: a member's bytes are the most that is ever
held, so an archive may have any size. Partitions are groups of whole archives
by size; an archive larger than a partition is cut by members, for which its
directory is read once when the scan is planned; its partitions read their own
part of the directory alone (``_Part``).

Options: ``path`` (folder, or one archive), ``glob`` (default ``*.zip``),
``members`` (``all`` or ``first``: the first that matches), ``suffix`` of members
that count (default ``.xml``), ``partitionBytes`` (default 64 MB). Paths are those
of ``pyarrow.fs`` (local and shared folders, HDFS, S3).
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import small_batches

SCHEMA = "source_file string, member string, content string, error string"
PARTITION_BYTES = 64 << 20


class Members(InputPartition):
    """(archive, part of its directory: first byte, bytes, entries, bytes before the archive; None: all)."""

    def __init__(self, parts: list[tuple[str, tuple[int, int, int, int] | None]]):
        self.parts = parts


class _Part(io.RawIOBase):
    """An archive as if its directory had some of its entries alone, which follow each other there."""

    def __init__(self, file, first: int, size: int, entries: int, before: int):
        self.file, self.first, self.at = file, first, 0
        file.seek(first)
        directory = file.read(size)
        wide = (entries, entries, size, first - before)
        end = struct.pack("<4s2H", b"PK\x05\x06", 0, 0)
        if entries > 0xFFFE or max(wide) > 0xFFFFFFFE:
            end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, *wide)
            end = end64 + struct.pack("<4sLQL", b"PK\x06\x07", 0, first - before + size, 1) + end
            wide = (0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
        self.tail = directory + end + struct.pack("<2H2LH", *wide, 0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.first + len(self.tail))[whence]
        return self.at

    def readinto(self, buffer) -> int:
        if self.at < self.first:
            self.file.seek(self.at)
            data = self.file.read(min(len(buffer), self.first - self.at))
        else:
            data = self.tail[self.at - self.first:self.at - self.first + len(buffer)]
        buffer[:len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Archives:
    def __init__(self, options: dict):
        self.path, self.glob, self.suffix = options["path"], options.get("glob", "*.zip"), options.get("suffix", ".xml")
        self.first, self.size = options.get("members", "all") == "first", int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def files(self) -> list[tuple[str, int, int]]:
        """(path, bytes, time in nanoseconds) of all archives, in the order of their paths."""
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else []
        return sorted((f.path, f.size, f.mtime_ns) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob))

    def open(self, path: str, part: tuple[int, int, int, int] | None = None) -> zipfile.ZipFile:
        system, _ = _filesystem(self.path)
        file = system.open_input_file(path)
        return zipfile.ZipFile(io.BufferedReader(_Part(file, *part)) if part else file)

    def counts(self, member: zipfile.ZipInfo) -> bool:
        return member.filename.endswith(self.suffix)

    def wanted(self, archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        found = [m for m in archive.infolist() if self.counts(m)]
        return found[:1] if self.first else found

    def planned(self, files: list[tuple[str, int, int]]) -> list[Members]:
        out: list[Members] = []
        group: list[tuple[str, tuple[int, int, int, int] | None]] = []
        held = 0
        for path, size, _ in files:
            if size > self.size and not self.first:
                out += [Members([(path, part)]) for part in self.cuts(path)]
                continue
            if group and held + size > self.size:
                out.append(Members(group))
                group, held = [], 0
            group.append((path, None))
            held += size
        return out + ([Members(group)] if group else [])

    def cuts(self, path: str) -> list[tuple[int, int, int, int] | None]:
        """Parts of the directory whose members have about a partition's bytes each; an archive that
        is broken, or has no such member, is one part."""
        try:
            with self.open(path) as archive:
                members, first, before = archive.infolist(), archive.start_dir, 0
                if not any(map(self.counts, members)):
                    return [None]
                archive.fp.seek(first + 42)
                offset = struct.unpack("<L", archive.fp.read(4))[0]
                if offset != 0xFFFFFFFF:
                    before = members[0].header_offset - offset
                out, size, entries, held = [], 0, 0, 0
                for m in members:
                    if held and self.counts(m) and held + m.compress_size > self.size:
                        out.append((first, size, entries, before))
                        first, size, entries, held = first + size, 0, 0, 0
                    held += m.compress_size if self.counts(m) else 0
                    size += 46 + len(m.orig_filename.encode("utf-8" if m.flag_bits & 0x800 else "cp437")) + len(m.extra) + len(m.comment)
                    entries += 1
                archive.fp.seek(first + size)
                if archive.fp.read(4) not in (b"PK\x05\x06", b"PK\x06\x06"):  # the entries are not where they should be
                    return [None]
                return [*out, (first, size, entries, before)]
        except Exception:  # noqa: BLE001 — reading it will tell what is wrong
            return [None]

    def rows(self, part: Members) -> Iterator[tuple]:
        for path, own in part.parts:
            try:
                with self.open(path, own) as archive:
                    members = self.wanted(archive)
                    if not members and not own:
                        yield path, None, None, f"no {self.suffix.lstrip('.').upper()} member"
                    for m in members:
                        try:
                            yield path, m.filename, archive.read(m).decode("utf-8"), None
                        except Exception as e:  # noqa: BLE001 — one bad member never stops the archive
                            yield path, m.filename, None, f"{type(e).__name__}: {e}"
            except Exception as e:  # noqa: BLE001 — one bad archive never stops the batch
                yield path, None, None, f"{type(e).__name__}: {e}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = _Archives(options)

    def partitions(self):
        return self.archives.planned(self.archives.files()) or [Members([])]

    def read(self, partition):
        return self.archives.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Archives by their times: each batch takes those that are newer than the last batch's newest.
    Archives must be moved into the folder whole."""

    def __init__(self, options: dict):
        self.archives = _Archives(options)

    def initialOffset(self) -> dict:
        return {"time": -1}

    def latestOffset(self) -> dict:
        return {"time": max((t for _, _, t in self.archives.files()), default=-1)}

    def partitions(self, start: dict, end: dict):
        new = [f for f in self.archives.files() if start["time"] < f[2] <= end["time"]]
        return self.archives.planned(new) or [Members([])]

    def read(self, partition):
        return self.archives.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def write_archives(df, folder: str) -> None:
    """Rows (archive, member, content), members of an archive in one task, as ZIP files in a folder
    that all executors share."""
    def write(batches):
        import pandas as pd

        system, root = _filesystem(folder)
        name = z = None
        n = 0

        def close():
            stream = z.fp
            z.close()
            stream.close()
            system.move(f"{root}/.{name}", f"{root}/{name}")  # whole, for readers

        for b in batches:
            for archive, member, content in zip(b["archive"], b["member"], b["content"]):
                if z is None or archive != name:  # rows are sorted: an archive is whole when the next begins
                    if z is not None:
                        close()
                    name, n = archive, n + 1
                    z = zipfile.ZipFile(system.open_output_stream(f"{root}/.{name}"), "w", zipfile.ZIP_DEFLATED)
                z.writestr(member, content)
        if z is not None:
            close()
        yield pd.DataFrame({"n": [n]})

    small_batches(df.sparkSession)
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    df.repartition("archive").sortWithinPartitions("archive", "member").mapInPandas(write, "n long").agg({"n": "sum"}).collect()
