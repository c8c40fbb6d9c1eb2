"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only a local session may fall back to a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="changeflow-")
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it has run, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Store `df` as a Parquet table in the shared folder and go on from it.

    Dear steps run once, lost executors do not matter, and later stages read only the
    columns they use. The folder is the caller's to keep or drop. Versions of a page lie side by
    side, which zstd makes use of; what was shuffled on the way is not needed any more.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


class CarryStore:
    """What runs leave behind: results of every run, and carries that the next one goes on from.

    A run writes its tables in a folder of its own and commits them by one small row written
    last. A run that fails leaves the store as it was, and its repetition begins from the same
    state. `run` is the caller's name for the batch: a batch that was committed before is known.
    """

    _COMMIT = "number long, run string, carries map<string,string>, results map<string,string>"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        try:
            self.commits = spark.read.schema(self._COMMIT).parquet(f"{self.path}/commits").orderBy("number").collect()
        except AnalysisException:  # no run yet
            self.commits = []
        self.number = self.commits[-1]["number"] + 1 if self.commits else 0
        self.before: dict[str, str] = dict(self.commits[-1]["carries"]) if self.commits else {}
        self.known = {c["run"] for c in self.commits}
        self.carries: dict[str, str] = {}
        self.results: dict[str, str] = {}

    def tables(self) -> dict[str, DataFrame]:
        """The carries of the last committed run; none before the first."""
        return {name: self.spark.read.parquet(path) for name, path in self.before.items()}

    def _write(self, into: dict[str, str], name: str, df: DataFrame) -> DataFrame:
        into[name] = f"{self.folder}/{'carries' if into is self.carries else 'results'}/{name}"
        df.write.parquet(into[name])
        return self.spark.read.schema(df.schema).parquet(into[name])

    def carry(self, name: str, df: DataFrame) -> DataFrame:
        """Store a carry; it takes the place of the one before once the run is committed."""
        return self._write(self.carries, name, df)

    def result(self, name: str, df: DataFrame) -> DataFrame:
        """Store a result of this run."""
        return self._write(self.results, name, df)

    def history(self, name: str) -> DataFrame | None:
        """The results of all committed runs under one name."""
        paths = [c["results"][name] for c in self.commits if name in c["results"]]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, run: str) -> None:
        row = self.spark.createDataFrame([(self.number, run, {**self.before, **self.carries}, self.results)], self._COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
