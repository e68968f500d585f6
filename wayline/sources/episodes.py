"""Data sources of episode folders: planned reading with pushed filters, writing with commit and abort.

Layout: `<root>/<split>/<episode>/<folder>/<file>`; the last part of the root is the source.

Reading. The driver lists folder names only: the splits, and the episodes of those that are asked
for. Episodes are dealt to tasks, which list and read their files. `splits` and `episodes` are options: other
splits are not listed, and named episodes not even looked for. They are no pushed filters, because this
Spark keeps what was pushed once with the DataFrame, and a later use without the filter would lose rows.

Writing. A row is one or more files that belong together. Tasks write them to a staging folder of
their attempt, in blocks; once all are written, the blocks of finished attempts are given their names: by the commit, or, with
the option `staging`, by a second job of whoever set it. A name is never taken twice and never replaced:
the last file of a row is linked only if it does not exist, and whoever links it owns the row. A failed
attempt removes what it staged, an aborted job leaves nothing. With the option `spare`, blocks are taken from that folder
if it has any, and their files are written over unless they still have another name.
"""

from __future__ import annotations

import errno
import json
import os
import random
import re
import shutil
import uuid
import weakref
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

READ, WRITE = "wayline_episodes", "wayline_files"
#: Episodes of one reading task at least, unless told otherwise, and reading tasks at most.
EPISODES, TASKS = 32, 20_000
#: Rows of one batch that a reading task hands over, and blocks that a commit names at the same time.
ROWS, THREADS = 512, 16
#: Files of one staged block, about.
STAGED = 1000
#: What spare folders have.
BLOCKS, EMPTY = "blocks", "episodes"
#: Bytes that the first read of a mounted file asks for.
CHUNK = 1 << 14
FIELDS = "source string, split string, episode_id string"


_DIGITS = re.compile("([0-9]+)")


def natural(name: str) -> tuple:
    """Sorts like `frames.natural_key`: digit runs as numbers, equal ones by the whole name."""
    pieces = _DIGITS.split(name)
    key = [(text, len(n := digits.lstrip("0") or "0"), n) for text, digits in zip(pieces[::2], pieces[1::2])]
    if pieces[-1]:
        key.append((pieces[-1], 0, ""))
    return key, name


def read_bytes(store: pafs.FileSystem, path: str) -> bytes:
    """The bytes of a file; those of a mounted store without a stream for each."""
    if not isinstance(store, pafs.LocalFileSystem):
        with store.open_input_stream(path, compression=None) as f:
            return f.read()
    fd = os.open(path, os.O_RDONLY)
    try:
        parts = [os.read(fd, CHUNK)]
        while len(parts[-1]) == CHUNK or (parts[-1] and len(parts) > 1):
            parts.append(os.read(fd, CHUNK << 6))
        return parts[0] if len(parts) == 1 else b"".join(parts)
    finally:
        os.close(fd)


@dataclass
class Episodes(InputPartition):
    """Some episodes, as (split, name)."""

    names: list[tuple[str, str]]

    def __hash__(self):
        return id(self)


class EpisodeReader(DataSourceReader):
    """Rows of the files in one folder of every episode.

    `kind`: `names` gives the files of the first of the extensions that the folder has, numbered in
    natural order; `texts` gives the text of all files with the extension; `first` gives the text of the
    first of the named files.
    """

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.kind, self.folder = options["kind"], options["folder"]
        self.wanted = options["wanted"].split("|")
        self.per_task = int(options.get("per_task", EPISODES))
        self.splits, self.episodes = (json.loads(options.get(name, "null")) for name in ("splits", "episodes"))

    def _store(self) -> tuple[pafs.FileSystem, str]:
        store, path = pafs.FileSystem.from_uri(self.root)
        return store, path.rstrip("/")

    def _folders(self, store: pafs.FileSystem, path: str) -> list[str]:
        """Names of the folders at a path; those that begin with a dot or an underscore are not data."""
        found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name[:1] not in "._")

    def partitions(self) -> Sequence[InputPartition]:
        store, root = self._store()
        names: list[tuple[str, str]] = []
        for split in self._folders(store, root) if self.splits is None else sorted({s for s in self.splits if s}):
            found = self._folders(store, f"{root}/{split}") if self.episodes is None else sorted({e for e in self.episodes if e})
            names += [(split, e) for e in found]
        size = max(self.per_task, -(-len(names) // TASKS))
        return [Episodes(names[i : i + size]) for i in range(0, len(names), size)] or [Episodes([])]

    def _files(self, store: pafs.FileSystem, path: str) -> list[str]:
        if isinstance(store, pafs.LocalFileSystem):  # without asking for each file's size and time
            try:
                with os.scandir(path) as there:
                    return [f.name for f in there if f.name[:1] != "." and f.is_file()]
            except FileNotFoundError:
                return []
        found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return [f.base_name for f in found if f.type == pafs.FileType.File and f.base_name[:1] != "."]

    def _text(self, store: pafs.FileSystem, path: str) -> str:
        return read_bytes(store, path).decode("utf-8", "replace")

    def _rows(self, store: pafs.FileSystem, at: str) -> Iterator[tuple]:
        """(position, file name, text) of one episode."""
        names = self._files(store, at)
        if self.kind == "first":
            name = next((n for n in self.wanted if n in names), None)
            if name is not None:
                yield 0, name, self._text(store, f"{at}/{name}")
            return
        for extension in self.wanted:
            own = sorted((n for n in names if n.endswith(f".{extension}")), key=natural)
            for i, name in enumerate(own):
                yield i, name, self._text(store, f"{at}/{name}") if self.kind == "texts" else None
            if own:
                return

    def read(self, partition: Episodes) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        source = root.rsplit("/", 1)[1]
        held: list[tuple] = []
        for split, episode in partition.names:
            for i, name, text in self._rows(store, f"{root}/{split}/{episode}/{self.folder}"):
                held.append((source, split, episode, i, name, f"{self.root}/{split}/{episode}/{self.folder}/{name}", text))
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = ["source", "split", "episode_id", "pos", "name", "path", "value"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "pos" else pa.string()) for n, c in zip(names, zip(*rows))], names=names)


class EpisodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return READ

    def schema(self) -> str:
        return f"{FIELDS}, pos bigint, name string, path string, value string"

    def reader(self, schema) -> EpisodeReader:
        return EpisodeReader(dict(self.options))


def mounted(uri: str) -> str:
    """The path of a folder that every machine has mounted."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"files with names of their own need a mounted folder, not {uri}")
    return (unquote(parts.path) if parts.scheme else uri).rstrip("/")


_NO_NAME = frozenset(("", ".", ".."))


def check_name(name: str) -> str:
    """A relative path without empty or upward parts."""
    if not name or not _NO_NAME.isdisjoint(name.split("/")):
        raise ValueError(f"not a name below the root: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """A finished attempt: its staging folder, and how many blocks of files it has."""

    folder: str
    blocks: int


def publish(root: str, staged: list[str], names: list[str], made: set[str], spare: str | None = None) -> bool:
    """Give the files of one row their names, unless the last one is there already; whether they are ours.

    The others come first, so wherever the last file is, all are. Leftovers of a run that died in
    between are replaced by the owner. May be done again: what is ours already stays ours. `made` holds folders that are there.
    """
    targets = [f"{root}/{n}" for n in names]
    if len(targets) > 1 and os.path.exists(targets[-1]):
        if not os.path.samefile(staged[-1], targets[-1]):
            return False
    elif (folder := os.path.dirname(targets[-1])) not in made:
        if spare is not None:
            take_episode(spare, root, names[-1])
        os.makedirs(folder, exist_ok=True)
        made.add(folder)
    there = []
    for file, target in zip(staged[:-1], targets[:-1]):
        try:
            os.link(file, target)
        except FileExistsError:
            there.append((file, target))
    try:
        os.link(staged[-1], targets[-1])
    except FileExistsError:
        if not os.path.samefile(staged[-1], targets[-1]):
            return False
    for file, target in there:
        if not os.path.samefile(file, target):
            os.link(file, f"{file}.new")
            os.replace(f"{file}.new", target)
    return True


def publish_block(root: str, block: str, spare: str | None = None) -> int:
    """Publish the rows of a staged block and remove it, or move it to the folder of spare ones; a block without its list is done."""
    rows, made = 0, set()
    if os.path.exists(f"{block}/names"):
        with open(f"{block}/names", encoding="utf-8") as lines:
            for rows, line in enumerate(lines, 1):
                cells = line.rstrip("\n").replace("\1", "\n").split("\0")
                half = len(cells) // 2
                publish(root, [f"{block}/{f}" for f in cells[:half]], cells[half:], made, spare)
        os.remove(f"{block}/names")
    if spare is None:
        shutil.rmtree(block, ignore_errors=True)
    elif os.path.exists(block):
        os.rename(block, f"{spare}/{BLOCKS}/{uuid.uuid4().hex}")
    return rows


def spare_folders(spare: str) -> None:
    """Make the folders of what is kept: blocks of staged files, and episode folders without files."""
    for kind in (BLOCKS, EMPTY):
        os.makedirs(f"{spare}/{kind}", exist_ok=True)


def _take(spare: str, kind: str, to: str) -> bool:
    """Move something spare to a place of its own; whether there was any. Nobody else has it then."""
    names = os.listdir(f"{spare}/{kind}")
    random.shuffle(names)
    for name in names:
        try:
            os.rename(f"{spare}/{kind}/{name}", to)
            return True
        except FileNotFoundError:  # another task has it
            continue
    return False


def take_block(spare: str | None, block: str) -> bool:
    """Make a folder for staged files; whether it is a spare one."""
    if spare is not None and _take(spare, BLOCKS, block):
        return True
    os.mkdir(block)
    return False


def take_episode(spare: str, root: str, name: str) -> None:
    """Let the episode folder of a file be a spare one, unless it is there."""
    parts = name.split("/")
    if len(parts) > 2 and not os.path.exists(folder := f"{root}/{parts[0]}/{parts[1]}"):
        os.makedirs(f"{root}/{parts[0]}", exist_ok=True)
        try:
            _take(spare, EMPTY, folder)
        except OSError as e:
            if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):  # another task has made it meanwhile
                raise


def remove_episode(folder: str, spare: str | None = None) -> None:
    """Remove the files of an episode folder, and the folder, which is kept with the folders in it if there is a spare one."""
    try:
        for path in [f.path for f in os.scandir(folder)]:
            at = os.open(path, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
            try:
                for name in os.listdir(at):
                    os.unlink(name, dir_fd=at)
            finally:
                os.close(at)
        if spare is not None and os.path.isdir(f"{spare}/{EMPTY}"):
            os.rename(folder, f"{spare}/{EMPTY}/{uuid.uuid4().hex}")
    except OSError:  # something else lies there, or a task that ran before has removed it
        pass
    shutil.rmtree(folder, ignore_errors=True)


def put(folder: int, name: str, content: bytes, old: bool) -> None:
    """Write a staged file. In an old block it may be there: it is written over, unless it still has another name."""
    fd = os.open(name, os.O_WRONLY | os.O_CREAT, 0o666, dir_fd=folder)
    try:
        there = os.fstat(fd) if old else None
        if there and there.st_nlink > 1:
            os.unlink(name, dir_fd=folder)
            put(folder, name, content, False)
            return
        done = os.write(fd, content)
        while done < len(content):
            done += os.write(fd, memoryview(content)[done:])
        if there and there.st_size > done:
            os.ftruncate(fd, done)
    finally:
        os.close(fd)


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[list]:
    """The lists of a column, without an object for each."""
    column = batch.column(name)
    values, at = column.values.to_pylist(), column.offsets.to_pylist()
    return (values[i:j] for i, j in zip(at, at[1:]))


def clean(staging: str) -> None:
    """Remove a staging folder; by its new name, so that a task that still runs can't add to it."""
    gone = f"{staging}-gone"
    os.rename(staging, gone)
    shutil.rmtree(gone, ignore_errors=True)


class FileWriter(DataSourceArrowWriter):
    """Rows (paths, contents): files that belong together, below the root. Files that exist stay as they are.

    With the option `staging`, the commit only lists the blocks of finished attempts in that folder's `committed`; who set it
    publishes them (see `files.write_files`).
    """

    def __init__(self, options: dict):
        self.root = mounted(options["path"])
        self.later, self.spare = "staging" in options, options.get("spare")
        self.staging = mounted(options["staging"]) if self.later else staging_folder(self.root)
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        os.mkdir(folder)
        names, at, n, blocks, old, absent = None, None, STAGED, 0, False, set()
        try:
            for batch in iterator:
                for paths, contents in zip(_lists(batch, "paths"), _lists(batch, "contents")):
                    # a folder that was not there is not asked for again in the same block
                    if (own := check_name(paths[-1]).rpartition("/")[0]) not in absent:
                        if os.path.exists(f"{self.root}/{paths[-1]}"):
                            continue
                        if not os.path.exists(f"{self.root}/{own}"):
                            absent.add(own)
                    if n >= STAGED:
                        if names:
                            names.close()
                            os.close(at)
                            names = None
                        block, n, blocks, absent = f"{folder}/{blocks}", 0, blocks + 1, {own} & absent
                        old = take_block(self.spare, block)
                        at = os.open(block, os.O_RDONLY)
                        names = open(f"{block}/names", "w", encoding="utf-8")
                    files = []
                    for path, content in zip(paths, contents, strict=True):
                        files.append(str(n))
                        put(at, files[-1], content, old)
                        n += 1
                        check_name(path)
                    names.write("\0".join([*files, *paths]).replace("\n", "\1") + "\n")
            if names:
                names.close()
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        finally:
            if names:
                names.close()
                os.close(at)
        return Staged(folder, blocks)

    def commit(self, messages: list[Staged | None]) -> None:
        blocks = [f"{m.folder}/{i}" for m in messages if m is not None for i in range(m.blocks)]
        if self.later:
            with open(f"{self.staging}/committed", "w", encoding="utf-8") as f:
                json.dump(blocks, f)
            return
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(publish_block, [self.root] * len(blocks), blocks, [self.spare] * len(blocks)))
        clean(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        clean(self.staging)


def staging_folder(root: str) -> str:
    """A new name below the root; scans pass it over."""
    return f"{root}/.staging-{uuid.uuid4().hex}"


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return WRITE

    def schema(self) -> str:
        return "paths array<string>, contents array<binary>"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added, never replaced")
        return FileWriter(dict(self.options))


_KNOWN: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to the session, once."""
    if spark not in _KNOWN:
        spark.dataSource.register(EpisodeSource)
        spark.dataSource.register(FileSink)
        _KNOWN.add(spark)
    return spark
