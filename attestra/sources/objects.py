"""A store of contents by their digest, as a Spark sink.

``df.write.format("objects").mode("append").save(root)`` takes rows with a binary
``content`` and puts each under ``aa/bb/digest``, once however often it comes.  A
content goes to a file of its own in the attempt's folder and is renamed into place, so
an object is there whole or not at all: a killed task leaves nothing under a digest,
and a task that runs again finds what it wrote.  What attempts leave behind lies
under ``_attempts`` and goes when the job ends, well or not.

With a column ``content_sha256``, a content that differs from it is refused.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

KEY = re.compile(r"[0-9a-f]{2}/[0-9a-f]{2}/[0-9a-f]{64}")
ATTEMPTS = "_attempts"


def key_for(digest: str) -> str:
    """Where a content of a digest lies: two levels of folders keep listings short."""
    if not re.fullmatch(r"[0-9a-f]{64}", digest):
        raise ValueError("a digest has 64 lower-case hexadecimal digits")
    return f"{digest[:2]}/{digest[2:4]}/{digest}"


def contained(key: str) -> str:
    """A key that can't lead out of the store."""
    if not KEY.fullmatch(key) or not key.endswith(key[:2] + key[3:5] + key[10:]) or key[6:10] != key[:2] + key[3:5]:
        raise ValueError(f"malformed storage key: {key!r}")
    return key


@dataclass
class Put(WriterCommitMessage):
    new: int
    known: int


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.job = root, uuid.uuid4().hex
        if "content" not in schema.fieldNames():
            raise ValueError("rows need a column named content")
        self.declared = "content_sha256" in schema.fieldNames()

    def files(self):
        """The store's file system (any that Arrow reaches), and the root in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def write(self, iterator: Iterator[Row]) -> Put:
        from pyarrow import fs

        system, root = self.files()
        attempt, new, known, made = f"{root}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", 0, 0, False
        for row in iterator:
            data = bytes(row["content"]) if row["content"] is not None else b""
            digest = hashlib.sha256(data).hexdigest()
            if self.declared and row["content_sha256"] != digest:
                raise ValueError(f"content differs from its digest {row['content_sha256']!r}")
            path = f"{root}/{contained(key_for(digest))}"
            if system.get_file_info(path).type == fs.FileType.File:
                known += 1
                continue
            if not made:
                system.create_dir(attempt, recursive=True)
                made = True
            with system.open_output_stream(f"{attempt}/{digest}") as out:
                out.write(data)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            system.move(f"{attempt}/{digest}", path)
            new += 1
        return Put(new, known)

    def tidy(self) -> None:
        from pyarrow import fs

        system, root = self.files()
        mine = f"{root}/{ATTEMPTS}/{self.job}"
        if system.get_file_info(mine).type == fs.FileType.Directory:
            system.delete_dir(mine)

    def commit(self, messages: list) -> None:
        self.tidy()

    def abort(self, messages: list) -> None:
        self.tidy()


class ObjectStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are never overwritten: use mode append")
        return ObjectWriter(self.options["path"], schema)


def put(contents: DataFrame, root: str) -> DataFrame:
    """Store contents (a binary column ``content``), and give each row its ``storage_key``."""
    contents.sparkSession.dataSource.register(ObjectStore)
    digest = F.sha2(F.coalesce("content", F.lit(b"")), 256)
    contents.select(F.coalesce("content", F.lit(b"")).alias("content"), digest.alias("content_sha256")).write.format("objects").mode("append").save(root)
    return contents.withColumn("storage_key", F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest))


def get(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """(storage_key, content) of wanted keys; content is null where there is no such object."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    held = held.select(F.regexp_extract("path", f"({KEY.pattern})$", 1).alias("storage_key"), "content").where("storage_key != ''")
    return keys.select("storage_key").join(held, "storage_key", "left")
