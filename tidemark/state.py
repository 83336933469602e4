"""State on disk: Parquet files under one manifest.

A commit writes new files only for the partitions that it touches and then replaces the manifest by one
rename, so a reader or a crash sees all of a commit or nothing of it. The manifest names the files of every
table, the policy, what senders and micro-batches have been applied, and the clocks.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1
#: Parts that a table which is only added to has before they are put together.
MANY = 64
_unset: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return _unset.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidemark-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as an intermediate table of its own, for what is read more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """An intermediate table that has served."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class Manifest:
    policy: str
    version: int = 0
    format: int = FORMAT
    #: table -> {"schema": json, "parts": {partition: path}}
    tables: dict = field(default_factory=dict)
    batch: int = -1
    now: int | None = None
    clocks: dict = field(default_factory=dict)
    senders: dict = field(default_factory=dict)
    #: The last number given to an arrival by a stream of files.
    seq: int = -1
    migrations: list = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.root}/manifest.json"))

    def read(self) -> Manifest:
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).collect())
        found = Manifest(**json.loads(text))
        if found.format != FORMAT:
            raise ValueError(f"format {found.format} of {self.root} is not {FORMAT}")
        return found

    def swap(self, manifest: Manifest) -> None:
        """The commit: one rename over the old manifest."""
        draft = f"{self.root}/manifest-{uuid.uuid4().hex}.json"
        stream = self._fs.create(self._path(draft), True)
        stream.write(bytearray(json.dumps(asdict(manifest), indent=1).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(draft).toUri() if "://" in draft else jvm.java.net.URI(f"file://{draft}"), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(draft), self._path(f"{self.root}/manifest.json"), options)

    def create(self, policy: str) -> Manifest:
        if self.exists():
            raise ValueError(f"{self.root} holds a policy already")
        self._fs.mkdirs(self._path(self.root))
        self.swap(made := Manifest(policy))
        return made

    def table(self, manifest: Manifest, name: str, parts: set[str] | None = None) -> DataFrame | None:
        """A table, or those of its partitions; None if it was never written."""
        if name not in manifest.tables:
            return None
        entry = manifest.tables[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        paths = [p for k, p in entry["parts"].items() if parts is None or k in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, manifest: Manifest, name: str, df: DataFrame, part: str = "all", keep_rest: bool = False) -> None:
        """df becomes the table, or one partition of it. Nothing is seen before the manifest is swapped."""
        path = f"{self.root}/v{manifest.version + 1}/{name}/{part}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        entry = manifest.tables.get(name, {"parts": {}})
        parts = {**(entry["parts"] if keep_rest else {}), part: path}
        manifest.tables[name] = {"schema": df.schema.json(), "parts": parts}

    def upsert(self, manifest: Manifest, name: str, delta: DataFrame, merge: Callable[[DataFrame], DataFrame], part: F.Column | None = None) -> None:
        """Merges delta into the table; with part, a text Column, only the partitions that delta has are
        read and written."""
        if part is None:
            old = self.table(manifest, name)
            return self.replace(manifest, name, merge(delta if old is None else old.select(delta.columns).unionByName(delta)))
        # What is new is written first: to ask which partitions it has would read the events a second time.
        delta = written(delta, name)
        # Names of partitions, of which a batch of events touches few: one a rollup and week.
        touched = sorted(r[0] for r in delta.select(part).distinct().collect())
        if not touched:
            return
        old = self.table(manifest, name, set(touched))
        both = merge(delta if old is None else old.select(delta.columns).unionByName(delta))
        # One job writes all partitions, a folder each; their rows meet before that, so their files are few.
        path = f"{self.root}/v{manifest.version + 1}/{name}/{uuid.uuid4().hex[:8]}"
        both.withColumn("__part", part).hint("rebalance", F.col("__part")).write.partitionBy("__part").parquet(path)
        parts = manifest.tables.get(name, {"parts": {}})["parts"]
        manifest.tables[name] = {"schema": both.schema.json(), "parts": parts | {p: f"{path}/__part={p}" for p in touched}}

    def append(self, manifest: Manifest, name: str, df: DataFrame) -> None:
        """df beside what the table has; after MANY such parts they become one, so the manifest stays short."""
        self.replace(manifest, name, df, f"v{manifest.version + 1}", keep_rest=True)
        if len(manifest.tables[name]["parts"]) > MANY:
            self.replace(manifest, name, self.table(manifest, name), f"to{manifest.version + 1}")

    def sizes(self, manifest: Manifest) -> DataFrame:
        """(name, rows, bytes) of every table."""
        rows = []
        for name, entry in manifest.tables.items():
            size = sum(self._fs.getContentSummary(self._path(p)).getLength() for p in entry["parts"].values())
            rows.append((name, self.table(manifest, name).count(), size))
        return self.spark.createDataFrame(rows, "name string, rows long, bytes long")
