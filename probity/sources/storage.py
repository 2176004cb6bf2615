"""Tables, the folder that driver and executors share, and written cut points."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Drops a finished job's shuffle files, once what it made lies in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback: str | None = None
#: Paths that were given out, for ``scratch``.
_given: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder if everything runs in one process, else an error."""
    global _fallback
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _fallback is None:
        local = tempfile.mkdtemp(prefix="probity-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        _fallback = f"file://{local}"
    return _fallback


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/probity-{tag}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and gives the planner true sizes.

    With ``by``, its last columns, a folder for each of their values: filters on them leave out the others' files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with shuffle_cleanup(spark):
        df.write.partitionBy(*by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._probity_path = path
    return back


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to join with: sent to where the other rows are while it has at most ``most`` rows, so that no key's rows meet in one task; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    with contextlib.suppress(ValueError):
        _given.remove(path)


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames that no later step reads."""
    for df in frames:
        path = getattr(df, "_probity_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete at its end all paths that were given out inside, but those of written frames put on the list."""
    before, kept = len(_given), []
    try:
        yield kept
    finally:
        stay = {getattr(df, "_probity_path", None) for df in kept}
        for path in _given[before:]:
            if path not in stay:
                _delete(spark, path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Document upsert: the newest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def append_with_ids(existing: DataFrame, new: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Append a contributed batch; its ids go on from the highest one there is.

    The batch is numbered over all partitions of a range sort; ``order`` must part its rows.
    """
    from probity.functions.ordered import numbered

    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    rows = numbered(new.drop(id_col), order, id_col).join(F.broadcast(top))
    return existing.unionByName(rows.withColumn(id_col, F.col(id_col) + F.col("_top")).drop("_top"), allowMissingColumns=True)


def append_chained(spark: SparkSession, events: list[dict], path: str, head: tuple[int, str]) -> tuple[int, str]:
    """Append-only audit sink: each event is linked to the head before it and written as one batch; returns the new head."""
    import hashlib
    import json

    seq, prev = head
    rows = []
    for event in events:
        seq += 1
        body = json.dumps({"seq": seq, "prev_hash": prev, **event}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        digest = hashlib.sha256(body.encode()).hexdigest()
        rows.append((seq, event.get("event_type"), event.get("actor"), event.get("asset"), json.dumps(event.get("details", {}), sort_keys=True, ensure_ascii=False), prev, digest))
        prev = digest
    if rows:
        spark.createDataFrame(rows, "seq long, event_type string, actor string, asset string, details string, prev_hash string, hash string").write.mode("append").parquet(path)
    return seq, prev


class AuditLog:
    """An append-only log in one folder: batches of chained rows, and a signed head for each append.

    A head (``heads/<seq>.json``) names the batch it closes; only batches that a head names are in the log. Before anything is appended the last rows
    are compared with the newest head and its signature, so a log that was cut off or changed at its end is refused. A head's file
    is made only if there is none of that name: of two writers that append to one head one is refused and leaves no row.

    ``sign`` (text to signature) and ``verify`` (text, signature to bool) are the caller's, as keys are not kept here.
    """

    ROWS = "seq long, event_type string, actor string, asset string, details string, prev_hash string, hash string"

    def __init__(self, spark: SparkSession, root: str, sign: Callable[[str], str], verify: Callable[[str, str], bool]) -> None:
        self.spark, self.root, self.sign, self.verify = spark, root.rstrip("/"), sign, verify

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _names(self) -> list[str]:
        fs, folder = self._fs(f"{self.root}/heads")
        return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("seq long, hash string, batch string, signature string").json([f"{self.root}/heads/{n}" for n in names])

    def head(self) -> tuple[int, str]:
        """seq and hash of the newest head; its signature and the rows that it closes must hold."""
        names = self._names()
        if not names:
            return 0, "0" * 64
        last = self._read(names[-1:]).first()
        if not self.verify(f"{last.seq}:{last.hash}", last.signature):
            raise PermissionError("the head's signature doesn't hold")
        row = self._batch(last.batch).where(F.col("seq") >= last.seq).orderBy(F.col("seq").desc()).first()
        if row is None or (row.seq, row.hash) != (last.seq, last.hash):
            raise PermissionError("the log doesn't end where its head says")
        return last.seq, last.hash

    def _batch(self, name: str) -> DataFrame:
        fs, folder = self._fs(f"{self.root}/rows/{name}")
        return self.spark.read.schema(self.ROWS).parquet(str(folder.toString())) if fs.exists(folder) else self.spark.createDataFrame([], self.ROWS)

    def append(self, events: list[dict]) -> tuple[int, str]:
        """Chain events to the head and sign the new one; returns it. Refused if the log isn't whole or another writer was first."""
        if not events:
            return self.head()
        before = self.head()
        name = uuid.uuid4().hex
        seq, digest = append_chained(self.spark, events, f"{self.root}/rows/{name}", before)
        import json

        body = json.dumps({"seq": seq, "hash": digest, "batch": name, "signature": self.sign(f"{seq}:{digest}")})
        # The name is that of the head it follows, so a second writer meets the file.
        fs, target = self._fs(f"{self.root}/heads/{before[0]:020d}.json")
        try:
            out = fs.create(target, False)
        except Exception as taken:
            _delete(self.spark, f"{self.root}/rows/{name}")
            raise PermissionError("another writer has appended to this head") from taken
        out.write(bytearray(body.encode()))
        out.close()
        return seq, digest

    def rows(self) -> DataFrame:
        """All rows that heads name, of all batches."""
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], self.ROWS)
        batches = [r.batch for r in self._read(names).select("batch").collect()]  # one for each append
        return self.spark.read.schema(self.ROWS).parquet(*[f"{self.root}/rows/{b}" for b in batches])


class Store:
    """Documents, values and counters as append-only Parquet in one folder; the newest version of a key is in force.

    Writers are the driver of one run; readers take the newest row of each key, so nothing is rewritten.
    """

    _DOCS = "name string, id string, run_id string, version long, doc string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._version = (self._all().agg(F.max("version")).first()[0] or 0) if self._written() else 0

    def _written(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/docs")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self._DOCS).parquet(f"{self.root}/docs") if self._written() else self.spark.createDataFrame([], self._DOCS)

    def put(self, name: str, docs: dict[str, object], run_id: str | None = None) -> None:
        """Insert or replace documents of a table."""
        import json

        self._version += 1
        rows = [(name, k, run_id, self._version, json.dumps(v, sort_keys=True, ensure_ascii=False)) for k, v in docs.items()]
        if rows:
            self.spark.createDataFrame(rows, self._DOCS).coalesce(1).write.mode("append").partitionBy("name").parquet(f"{self.root}/docs")

    def snapshot(self, label: str) -> int:
        """Name the state of all tables as it is; nothing is copied, as versions are kept. Returns the version."""
        now = self._version
        self.put("snapshots", {label: now})
        return now

    def restore(self, label: str) -> None:
        """All tables, values and counters as they were at a snapshot; what came since stays written but is out of force.

        Later documents count again. Snapshots themselves are not undone.
        """
        version = self.get("snapshots", label)
        if version is None:
            raise KeyError(label)
        self.put("restores", {uuid.uuid4().hex: [version, self._version]})

    def _in_force(self, rows: DataFrame) -> DataFrame:
        """Rows of versions that no restore has put out of force; one range for each restore."""
        if not self._written():
            return rows
        import json

        gone = [json.loads(r.doc) for r in self._all().where("name = 'restores'").select("doc").collect()]
        for low, high in gone:
            rows = rows.where(~((F.col("version") > low) & (F.col("version") <= high)))
        return rows

    def documents(self, name: str, run_id: str | None = None) -> DataFrame:
        """id, run_id, doc of a table, by id; of one run if it is named."""
        rows = self._all().where(F.col("name") == name)
        newest = latest(rows if name in ("snapshots", "restores") else self._in_force(rows), ["id"], "version")
        return (newest.where(F.col("run_id") == run_id) if run_id else newest).select("id", "run_id", "doc").orderBy("id")

    def get(self, name: str, key: str, default: object = None) -> object:
        import json

        row = self.documents(name).where(F.col("id") == key).first()
        return json.loads(row.doc) if row else default

    def set_value(self, key: str, value: object) -> None:
        self.put("values", {key: value})

    def value(self, key: str, default: object = None) -> object:
        return self.get("values", key, default)

    def next_ids(self, counter: str, prefix: str, width: int, n: int = 1) -> list[str]:
        """The next ``n`` ids of a counter, such as F-001; a number of more digits keeps them."""
        last = int(self.get("counters", counter, 0))
        self.put("counters", {counter: last + n})
        return [f"{prefix}{i:0{width}d}" for i in range(last + 1, last + n + 1)]

    def clear(self) -> None:
        """Drop all tables: what a restored workspace starts from."""
        _delete(self.spark, f"{self.root}/docs")
        self._version = 0


def records_of(records: DataFrame, stream: str | None = None) -> DataFrame:
    """One stream's records by number, or all by stream and number; the filter reaches the scan."""
    return records.where(F.col("stream") == stream).orderBy("seq") if stream is not None else records.orderBy("stream", "seq")
