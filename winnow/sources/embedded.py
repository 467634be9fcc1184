"""A relational store that works where executors reach no database server: Derby, embedded in each of them.

An embedded Derby database belongs to one JVM: what one process inserts no other process sees, and
a database in files can be opened by one process at a time.  So rows go the way of a bulk load:
Spark's tasks write them as CSV files to the folder that all share, and the session that reads a
file's table over JDBC first has Derby import that file, in its own process.  Each file has its own
database; driver and executors get it, with its empty table, from one backup.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame

from . import splits

OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
KINDS = {"smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT"}


def round_trip(df: DataFrame, folder: str, *, rows: int = 100_000) -> DataFrame:
    """df, of columns of whole numbers, through Derby and back, in databases of about so many rows, each read by a task.

    folder is new and mounted as a path on driver and executors.  An executor keeps what it imported until it ends.
    """
    spark = df.sparkSession
    where = urlparse(folder)
    if where.scheme not in ("", "file"):
        raise ValueError(f"{folder}: Derby reads mounted folders only")
    base, jvm = unquote(where.path).rstrip("/"), spark.sparkContext._jvm
    if "'" in base or ";" in base:
        raise ValueError(f"{folder}: Derby's URLs and calls cannot hold ' or ;")
    df.repartition(max(1, -(-df.count() // rows))).write.csv(f"file://{base}/files")
    path = jvm.org.apache.hadoop.fs.Path(f"file://{base}/files")
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted(f.getPath().getName() for f in listed if f.getPath().getName().startswith("part-"))

    def session(url: str, *calls: str) -> None:
        """Calls in a session of the driver's own Derby."""
        opened = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(url, jvm.java.util.Properties())
        try:
            for call in calls:
                opened.createStatement().execute(call)
        finally:
            opened.close()

    def drop(name: str) -> None:
        try:
            session(f"jdbc:derby:memory:{name};drop=true")
        except Py4JJavaError as error:  # Derby reports the end of a database as an error
            if error.java_exception.getSQLState() != "08006":
                raise

    store = f"t{uuid.uuid4().hex}"
    columns = ", ".join(f'"{name}" {KINDS[kind]}' for name, kind in df.dtypes)
    session(f"jdbc:derby:memory:{store};create=true", f"CREATE TABLE rows_ ({columns})", f"CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE('{base}/empty')")
    drop(store)
    parts = []
    for k, name in enumerate(files or [None]):
        url, options = f"jdbc:derby:memory:{store}_{k};createFrom={base}/empty/{store}", dict(OPTIONS)
        if name:  # replaces what an earlier attempt of the task left
            options["sessionInitStatement"] = f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ROWS_', '{base}/files/{name}', NULL, NULL, 'UTF-8', 1)"
        parts.append(splits.read_jdbc(spark, url, "rows_", options=options))
        drop(f"{store}_{k}")  # the driver's own, made to learn the columns
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
