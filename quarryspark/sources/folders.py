"""Small files and folders through the Hadoop file systems, so a root may be any address that the executors can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    p, system = _at(spark, path)
    if not system.exists(p):
        return None
    stream = system.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and moved into place, so a reader sees the old text or the new one."""
    import uuid

    p, system = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system.mkdirs(p.getParent())
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.rename(beside, p):
        # some file systems do not move over a file that is there
        system.delete(p, False)
        if not system.rename(beside, p):
            raise OSError(f"cannot write {path}")


def delete(spark: SparkSession, path: str) -> None:
    p, system = _at(spark, path)
    system.delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below a path: another one once its data change."""
    p, system = _at(spark, path)
    files = system.listFiles(p, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def names(spark: SparkSession, path: str) -> list[str]:
    p, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []
