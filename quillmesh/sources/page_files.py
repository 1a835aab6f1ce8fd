"""Pages as a data source of their own: files that appear whole or not at all, read by url.

A write goes to a staging folder task by task; when all tasks are done their files are moved, and one commit file
names them.  Readers see named files alone, so a failed task, a second attempt or an ended job leaves nothing
that is read.  Files written in order of url let a filter on it skip row groups.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "quill_pages"
COMMITS, STAGING = "_commits", "_staging"
#: compressed bytes of row groups that one task reads, and rows of one row group
SPLIT_BYTES, GROUP_ROWS = 64 << 20, 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is a local or mounted one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file)


def committed(path: str) -> list[str]:
    """Files that finished writes name, from the last one on that replaced all before."""
    system, root = opened(path)
    files: list[str] = []
    for name in _listed(system, posixpath.join(root, COMMITS)):
        if not name.endswith(".json"):
            continue
        with system.open_input_stream(name) as f:
            told = json.loads(f.read())
        files = told["files"] if told["replaces"] else files + told["files"]
    return files


@dataclass
class Groups(InputPartition):
    """Row groups that one task reads: (file, numbers)."""

    parts: list


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    files: list


class PageReader(DataSourceReader):
    """Plans tasks of row groups; filters on the url skip groups by their least and greatest one, then rows."""

    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema
        self.prefixes: list[tuple[str, ...]] = []  # for each filter the urls, or starts of urls, one of which must fit
        self.exact: list[bool] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("url",):
                values = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.prefixes.append(tuple(v for v in values if v is not None))
                self.exact.append(not isinstance(f, StringStartsWith))
            else:
                yield f

    def _may_hold(self, low: str | None, high: str | None) -> bool:
        if low is None or high is None:
            return True
        return all(any(v <= high and (low <= v if exact else low[: len(v)] <= v) for v in values) for values, exact in zip(self.prefixes, self.exact))

    def partitions(self) -> list[Groups]:
        system, root = opened(self.path)
        tasks: list[Groups] = []
        parts, held = [], 0
        for name in committed(self.path):
            meta = pq.read_metadata(posixpath.join(root, name), filesystem=system)
            at = meta.schema.names.index("url") if self.prefixes else None
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                stats = group.column(at).statistics if at is not None else None
                bounds = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
                if not self._may_hold(*bounds):
                    continue
                size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
                if parts and held + size > SPLIT_BYTES:
                    tasks.append(Groups(parts))
                    parts, held = [], 0
                parts.append((name, k))
                held += size
        return tasks + [Groups(parts)] * bool(parts)

    def read(self, partition: Groups | None):
        if partition is None or not partition.parts:
            return
        system, root = opened(self.path)
        wanted = to_arrow_schema(self.schema)
        need = wanted.names + ["url"] * bool(self.prefixes and "url" not in wanted.names)
        for name, group in partition.parts:
            with pq.ParquetFile(posixpath.join(root, name), filesystem=system) as file:
                for batch in file.iter_batches(row_groups=[group], columns=need, batch_size=256):
                    table = pa.Table.from_batches([batch])
                    for values, exact in zip(self.prefixes, self.exact):
                        keep = pc.is_in(table["url"], pa.array(values, pa.string())) if exact else pc.starts_with(table["url"], values[0])
                        table = table.filter(keep)
                    yield from table.select(wanted.names).cast(wanted).to_batches()


class PageWriter(DataSourceArrowWriter):
    """Writes one file a task into a staging folder of its own; a commit moves and names them, an abort drops them."""

    def __init__(self, path: str, schema, replaces: bool):
        self.path, self.schema, self.replaces, self.job = path, schema, replaces, uuid.uuid4().hex

    def _staged(self, root: str) -> str:
        return posixpath.join(root, STAGING, self.job)

    def write(self, iterator) -> Written:
        system, root = opened(self.path)
        system.create_dir(self._staged(root), recursive=True)
        name, writer, schema = f"part-{uuid.uuid4().hex}.parquet", None, to_arrow_schema(self.schema)
        target = posixpath.join(self._staged(root), name)
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(target, schema, filesystem=system, compression="zstd")
                writer.write_table(pa.Table.from_batches([batch]).cast(schema), row_group_size=GROUP_ROWS)
        finally:
            if writer is not None:
                writer.close()
        return Written([name] if writer is not None else [])

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        files = [n for m in messages if m is not None for n in m.files]
        for name in files:
            system.move(posixpath.join(self._staged(root), name), posixpath.join(root, name))
        folder = posixpath.join(root, COMMITS)
        system.create_dir(folder, recursive=True)
        number = len(_listed(system, folder))
        draft = posixpath.join(root, STAGING, f"{self.job}.json")
        system.create_dir(posixpath.join(root, STAGING), recursive=True)
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files, "replaces": self.replaces}).encode())
        system.move(draft, posixpath.join(folder, f"{number:012d}-{self.job}.json"))
        self._dropped(system, root)

    def abort(self, messages) -> None:
        self._dropped(*opened(self.path))

    def _dropped(self, system: fs.FileSystem, root: str) -> None:
        """Only this job's own folder, with what lost attempts left in it."""
        if system.get_file_info(self._staged(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staged(root))


class PageFiles(DataSource):
    """Format ``quill_pages`` with option ``path``; a schema given to the reader names the columns to read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        files = committed(self.options["path"])
        if not files:
            raise ValueError(f"no pages were written under {self.options['path']}")
        system, root = opened(self.options["path"])
        return from_arrow_schema(pq.read_schema(posixpath.join(root, files[0]), filesystem=system))

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], schema, overwrite)


def write_page_files(pages: DataFrame, path: str, mode: str = "append", files: int | None = None) -> None:
    """Adds pages (url and more) to a folder that all executors share, or with ``overwrite`` puts them in place of all.

    Rows are ranged by url and, where there is one, page_id, so that the copies of one url may stand in more than one file.
    ``files`` is their number (by default that of shuffle partitions).  One writer that replaces at a time;
    replaced files stay for readers that began before, until their owner removes them.
    """
    if "url" not in pages.columns or mode not in ("append", "overwrite"):
        raise ValueError("pages need a url, and are written by append or overwrite")
    spark = pages.sparkSession
    spark.dataSource.register(PageFiles)
    ranged = pages.repartitionByRange(*[files] * (files is not None), "url", *[c for c in pages.columns if c == "page_id"]).sortWithinPartitions("url")
    ranged.write.format(NAME).option("path", path).mode(mode).save()


def read_page_files(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Pages of such a folder; ``columns`` (as DDL) names those to read, and filters on the url reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
    reader = spark.read.format(NAME).option("path", path)
    return (reader.schema(columns) if columns else reader).load()
