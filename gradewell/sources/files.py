"""Scans: keyed CSV tables, queues, folders, JSON documents and logs, rasters, masks, meshes."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import basename, clean_double
from ..operators.tables import last_per_key


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", optional: bool = False) -> DataFrame:
    """A CSV table with a header and a declared schema of text columns.

    Quoted separators and line ends are read as content.  A missing file is an error, or an empty
    table if the source is optional.  Columns of the schema that the file lacks are null, since the
    header decides what is where.
    """
    if not _glob(spark, path):
        if optional:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    want = spark.createDataFrame([], schema).schema
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def read_keyed_csv(spark: SparkSession, path: str, schema: str, key: str, sep: str = ",", optional: bool = False) -> DataFrame:
    """``read_csv`` with one row per key: the last one wins, of the last file by its name.

    A file with quoted line ends is read whole by one task, so row numbers rise within it.
    """
    raw = read_csv(spark, path, schema, sep, optional)
    rows = raw.withColumn("_row", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return last_per_key(rows, key, "_row").drop("_row")


def read_by_basename(spark: SparkSession, path: str, schema: str, column: str, sep: str = ",") -> DataFrame:
    """A table keyed by the last part of a path column (either separator), as ``file``."""
    rows = read_csv(spark, path, schema, sep).withColumn("file", basename(column)).withColumn("_row", F.monotonically_increasing_id())
    return last_per_key(rows, "file", "_row").drop("_row")


QUEUE = "orden string, id string, variedad string, clase string, caja_real string, foto string, obj string, ancho_cinta string"


def read_queue(spark: SparkSession, path: str, need_object: bool = False) -> DataFrame:
    """The ordered work queue (semicolons): typed numbers, unreadable ones null; rows without an object can be dropped."""
    q = read_csv(spark, path, QUEUE, ";")
    q = q.withColumns({"orden": F.col("orden").try_cast("int"), "caja_real": F.coalesce(F.col("caja_real").try_cast("int"), F.lit(0)), "ancho_cinta": clean_double("ancho_cinta")})
    return q.where("obj IS NOT NULL AND obj <> ''") if need_object else q


def first_table(spark: SparkSession, folder: str, pattern: str = "rasgos_*.csv") -> DataFrame:
    """The first matching CSV of a folder, with its key column (``archivo``, else ``ruta``) as ``file``."""
    found = _glob(spark, f"{folder}/{pattern}")
    if not found:
        raise FileNotFoundError(f"{folder}/{pattern}")
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(found[0])
    return t.withColumn("file", basename("archivo" if "archivo" in t.columns else "ruta"))


def folder_labels(spark: SparkSession, folder: str, names: dict[str, str], pattern: str = "*", fallback: DataFrame | None = None) -> DataFrame:
    """(file, label) of the files under a folder: by the sub-folder's name, else from a label table (file, label)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    table = spark.createDataFrame([(k.lower(), v) for k, v in names.items()], "_folder string, label string")
    parent = F.lower(F.url_decode(F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1)))
    out = files.select(basename("path").alias("file"), parent.alias("_folder")).join(F.broadcast(table), "_folder", "left").drop("_folder")
    if fallback is None:
        return out
    return out.join(fallback.select("file", F.col("label").alias("_l")), "file", "left").select("file", F.coalesce("label", "_l").alias("label"))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


PARTITION = "nombre string, n_splits int, random_state int, n_filas int, n_grupos int, huella_grupos string, folds array<struct<test: array<string>>>"


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(nombre, n_grupos, huella_grupos, fold, id) of saved partition documents."""
    doc = read_document(spark, path, PARTITION)
    return doc.select("nombre", "n_grupos", "huella_grupos", F.posexplode("folds").alias("fold", "f")).select("nombre", "n_grupos", "huella_grupos", "fold", F.explode("f.test").alias("id"))


LOG = (
    "id string, orden int, percibe struct<foto string, escala string, avisos array<string>>, "
    "puntua struct<variedad string, calidad string, confianza_variedad double, confianza_calidad double, segunda string, acierto_calibrado double>, "
    "razona struct<regla string, piso double, sin_llm boolean, defectos array<string>>, decide struct<accion string, codigo int, revision boolean, guarda string>, "
    "verdad struct<clase string, variedad string, caja int, acerto_caja boolean>, costo struct<segundos double, llamadas_llm int, tokens int>, fecha string"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit log, one JSON record per line, in its declared nested schema."""
    return spark.read.schema(LOG).json(path)


# ---------------------------------------------------------------- binary


def _image(raw: bytes) -> np.ndarray:
    """[h, w, 3] of a picture: portable pixmaps and .npy here; other formats if an imaging library is there."""
    if raw[:6] == b"\x93NUMPY":
        a = np.load(io.BytesIO(raw), allow_pickle=False)
        return np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a
    if raw[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while raw[at : at + 1].isspace():
                at += 1
            if raw[at : at + 1] == b"#":
                at = raw.index(b"\n", at)
                continue
            end = at
            while not raw[end : end + 1].isspace():
                end += 1
            fields.append(int(raw[at:end]))
            at = end
        w, h, _ = fields
        n = 3 if raw[:2] == b"P6" else 1
        a = np.frombuffer(raw, dtype=np.uint8, count=w * h * n, offset=at + 1).reshape(h, w, n)
        return np.repeat(a, 3, axis=2) if n == 1 else a
    try:
        from PIL import Image
    except ImportError as error:
        raise ValueError("no decoder for this picture format") from error
    return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))


def shrink(image: np.ndarray, side: int) -> np.ndarray:
    """Area-averaged to a longer side of at most ``side``."""
    h, w = image.shape[:2]
    scale = max(h, w) / side
    if scale <= 1:
        return image
    nh, nw = max(1, round(h / scale)), max(1, round(w / scale))
    ys, xs = np.arange(nh + 1) * h // nh, np.arange(nw + 1) * w // nw
    total = np.add.reduceat(np.add.reduceat(image.astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
    area = np.diff(ys)[:, None] * np.diff(xs)[None, :]
    return np.rint(total / area[..., None]).astype(np.uint8)


def read_images(spark: SparkSession, path: str, side: int = 1024, pattern: str = "*") -> DataFrame:
    """(path, h, w, rgb, error): decoded pictures as packed bytes; one that can't be decoded has its error instead."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    a = np.ascontiguousarray(shrink(_image(raw), side)[..., :3], dtype=np.uint8)
                    rows.append((name, a.shape[0], a.shape[1], a.tobytes(), None))
                except Exception as e:  # a broken file is a row with its reason, not the end of the scan
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], names=["path", "h", "w", "rgb", "error"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, h int, w int, rgb binary, error string")


def pack_mask(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool)).tobytes()


def unpack_mask(raw: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[: h * w].reshape(h, w).astype(bool)


STL = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("spare", "<u2")])


def triangles_of(raw: bytes) -> np.ndarray:
    """[n, 3, 3] of a binary STL."""
    n = int(np.frombuffer(raw, "<u4", count=1, offset=80)[0])
    return np.frombuffer(raw, STL, count=n, offset=84)["corners"].astype(np.float64)


def stl_of(triangles: np.ndarray, header: bytes = b"gradewell") -> bytes:
    """Binary STL of triangles, with unit normals (zero for a degenerate one)."""
    t = np.asarray(triangles, dtype=np.float64).reshape(-1, 3, 3)
    normal = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    body = np.zeros(len(t), STL)
    body["normal"], body["corners"] = np.divide(normal, size, out=np.zeros_like(normal), where=size > 0), t
    return header.ljust(80, b"\0")[:80] + np.uint32(len(t)).tobytes() + body.tobytes()


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """(path, triangle, corners): one row per triangle of binary STL files."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = triangles_of(raw)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(np.arange(len(t))), pa.array(t.tolist(), pa.list_(pa.list_(pa.float64())))], names=["path", "triangle", "corners"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.stl").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, triangle long, corners array<array<double>>")


def memo(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A result kept as Parquet under a hash of its inputs; a missing or broken copy is built again.

    All pages of a copy are read once before it is trusted: a broken part counts as none now, and does
    not fail later, at the action.
    """
    path = f"{folder}/{key}"
    if _glob(spark, f"{path}/_SUCCESS"):
        try:
            copy = spark.read.parquet(path)
            copy.agg(*[F.count(c) for c in copy.columns]).collect()
            return copy
        except (PySparkException, Py4JJavaError):
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(df: DataFrame, columns: list[str], order: str) -> str:
    """A hash of a table's content, whatever its order: the sum of its rows' hashes."""
    row = df.select(F.xxhash64(order, *columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return f"{row[0]}-{int(row[1] or 0) & (1 << 64) - 1:016x}"
