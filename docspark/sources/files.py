"""File listings."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.names import nfc

STEP = 1 << 20
FOLDERS_KEPT = 1024
# Names that only they themselves are in NFC: K, ; and ` stand for other characters too.
PLAIN = re.compile(r"[ -:<-JL-_a-~]*")


def indexable(listing: DataFrame, suffixes: tuple[str, ...] = P.SUPPORTED_SUFFIXES) -> DataFrame:
    """path, root_no, suffix, mtime and size_bytes of the files in a listing (path, root_no, modificationTime, length) that can be indexed.

    A file met under two roots counts once, for the first of them.
    """
    rows = listing.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    excluded = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in P.EXCLUDED_FOLDERS]))
    kept = rows.filter(F.col("suffix").isin(*suffixes) & ~excluded & (F.col("length") >= P.MIN_FILE_SIZE))
    return kept.select(
        nfc(F.regexp_replace("path", "^file:/+", "/")).alias("path"), "root_no", "suffix",
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size_bytes"),
    ).groupBy("path").agg(*[F.min_by(c, "root_no").alias(c) for c in ("suffix", "mtime", "size_bytes")], F.min("root_no").alias("root_no"))


def scan_files(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = P.SUPPORTED_SUFFIXES) -> DataFrame:
    """The indexable files under the roots. Only file status is read: the content column is pruned away."""

    def under(no: int, root: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return files.select("path", F.lit(no).alias("root_no"), "modificationTime", "length")

    return indexable(reduce(DataFrame.unionByName, [under(i, r) for i, r in enumerate(roots)]), suffixes)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, size_bytes and sha256 of the files at raw_path, read in steps of STEP bytes; both are null for a file that cannot be read."""
    for batch in batches:
        sizes, shas = [], []
        for uri in batch.column("raw_path").to_pylist():
            size, state = 0, hashlib.sha256()
            try:
                files, path = fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))
                with files.open_input_stream(path) as stream:
                    while step := stream.read(STEP):
                        state.update(step)
                        size += len(step)
                sizes.append(size)
                shas.append(state.hexdigest())
            except (OSError, pa.ArrowInvalid):
                sizes.append(None)
                shas.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], names=["path", "size_bytes", "sha256"])


def _listed(name: str) -> bool:
    """Whether a listing of Spark's shows a file or folder of this name."""
    hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return bool(name) and (not hidden or name.startswith(("_metadata", "_common_metadata")))


class _Root:
    """A root folder: ``uri`` as Spark names it, and the files below it by their names in NFC."""

    def __init__(self, uri: str):
        self.uri = uri
        self.path = unicodedata.normalize("NFC", re.sub("^file:/+", "/", uri))
        self.files, self.base = fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))
        self._names: dict[str, dict[str, list[str]]] = {}

    def _in(self, folder: str, name: str) -> list[str]:
        """The names in a folder that are ``name`` in NFC."""
        if PLAIN.fullmatch(name):  # nothing else is this name in NFC
            return [name]
        if folder not in self._names:
            if len(self._names) >= FOLDERS_KEPT:
                self._names.clear()
            held: dict[str, list[str]] = {}
            for info in self.files.get_file_info(fs.FileSelector(self.base + folder, allow_not_found=True)):
                held.setdefault(unicodedata.normalize("NFC", info.base_name), []).append(info.base_name)
            self._names[folder] = held
        return self._names[folder].get(name, [])

    def find(self, path: str) -> list[str]:
        """The files that are ``path`` in NFC."""
        if path != self.path and not path.startswith(self.path.rstrip("/") + "/"):
            return []
        rest, found = path[len(self.path.rstrip("/")) + 1 :], [""]
        for name in rest.split("/") if rest else []:
            found = [f"{folder}/{raw}" for folder in found for raw in self._in(folder, name) if _listed(raw)]
        infos = self.files.get_file_info([self.base.rstrip("/") + f for f in found])
        return [self.uri.rstrip("/") + f for f, info in zip(found, infos) if info.type == fs.FileType.File]


def _located(uris: list[str]):
    """path and raw_path of the paths that are files below one of the roots; of several files of one name in NFC the least counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [_Root(uri) for uri in uris]
        for batch in batches:
            found = {path: sorted(raw for root in roots for raw in root.find(path)) for path in batch.column("path").to_pylist() if path}
            rows = [(path, raws[0]) for path, raws in found.items() if raws]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "raw_path"])

    return run


def hash_files(spark: SparkSession, roots: list[str], touched: DataFrame) -> DataFrame:
    """path, size_bytes and sha256 of the files under the roots that are in ``touched`` (path).

    The roots are not listed: the task that has a touched path looks it up, and of the folders on its way lists only those where a name in NFC may stand for
    another one. Only touched files are opened, in steps, so a file may be of any size. Files and folders that a listing of Spark's leaves out have no row.
    """
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    uris = [at(root).getFileSystem(conf).makeQualified(at(root)).toString() for root in roots]
    wanted = touched.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").distinct()
    locate = _located(uris)
    return wanted.mapInArrow(lambda batches: digests(locate(batches)), "path string, size_bytes bigint, sha256 string")
