"""The serving bundle: JSON tables in a folder, written and read by Spark, and as one archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.paths import safe_audio_path
from lectern.operators.pages import decode_styles
from lectern.shared import materialise
from lectern.sources.archives import entries

SPANS = "ord long, id string, clipBeginMs double, clipEndMs double, pageIndex int"  # ord: the place in the file, which a table has no other way to keep
META = "bundleVersion string, bundleId string, profile string, title string, audioFile string, pages int, spans int"
TOC = "title string, pageIndex int, level int"
STYLES = "styleId int, fontFamily string, fontSize double, fontWeight int, fontStyle string, inkGray int"
PAGES = (
    "pageId string, chapterId string, pageIndex int, width double, height double, contentX double, contentY double, "
    "textRuns array<struct<text:string,x:double,y:double,width:double,height:double,baselineY:double,spanId:string,styleId:int>>, "
    "spanRects array<struct<spanId:string,rects array<struct<x:double,y:double,width:double,height:double>>>>, firstSpanId string, lastSpanId string"
).replace("rects array<struct<x", "rects:array<struct<x")
_FILES = {"meta": META, "spans": SPANS, "styles": STYLES, "pages": PAGES, "toc": TOC}


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Each of meta, spans, styles, pages, toc that is given as JSON lines below path; nulls are left out."""
    for name, df in tables.items():
        if name not in _FILES:
            raise ValueError(f"a bundle has no table {name}")
        df.write.mode("overwrite").json(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The bundle's tables, with the schemas above; further fields are ignored, a missing toc or empty table is empty. Pages are by pageIndex."""
    found = {}
    for name, schema in _FILES.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        if not there and name != "toc":
            raise FileNotFoundError(f"{path}/{name}")
        found[name] = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    found["pages"] = found["pages"].orderBy("pageIndex")
    return found


def text_runs(bundle: dict[str, DataFrame]) -> DataFrame:
    """Runs of all pages with their styles; an unknown style raises an error."""
    runs = bundle["pages"].select("pageIndex", F.posexplode("textRuns").alias("run_pos", "r")).select("pageIndex", "run_pos", "r.*").withColumnRenamed("styleId", "style_id")
    styles = bundle["styles"].withColumnRenamed("styleId", "style_id")
    return decode_styles(runs, styles, [c for c in styles.columns if c != "style_id"])


def audio_is_safe(bundle: dict[str, DataFrame]) -> DataFrame:
    return bundle["meta"].select("audioFile", safe_audio_path(F.col("audioFile")).alias("safe"))


def audio_path(spark: SparkSession, bundle: dict[str, DataFrame], path: str) -> str:
    """The audio file of the bundle at path: named, not absolute, inside the bundle, and there; else an error says what it is not."""
    told = audio_is_safe(bundle).first()
    name = (told.audioFile or "").strip()
    if not told.safe:
        raise ValueError(f'Invalid meta.audioFile "{name}": it must be a path inside the bundle')
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        raise FileNotFoundError(f"Audio file referenced by meta.audioFile was not found: {name}")
    return f"{path}/{name}"


def to_files(bundle: dict[str, DataFrame], book: str, name_pages_by: str = "pageId") -> DataFrame:
    """(book, name, content): the JSON files that a bundle's archive holds; bundle: one book's tables."""
    of = lambda name, text: (F.lit(book).alias("book"), name.alias("name"), text.alias("content"))
    row, listed = F.to_json(F.struct("*")), lambda df: F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]"))
    files = bundle["meta"].select(*of(F.lit("meta.json"), row))
    if "spans" in bundle:
        lines = bundle["spans"].select("ord", F.to_json(F.struct(*[c for c in bundle["spans"].columns if c != "ord"])).alias("j"))
        lines = lines.agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.struct("ord", "j")))["j"], F.lit("")).alias("t"))
        files = files.union(lines.select(*of(F.lit("spans.jsonl"), F.col("t"))))
    for table in ("styles", "toc"):
        if table in bundle:
            files = files.union(bundle[table].select(row.alias("j")).agg(listed(None).alias("t")).select(*of(F.lit(f"{table}.json"), F.col("t"))))
    if "pages" in bundle:
        files = files.union(bundle["pages"].select(*of(F.concat(F.lit("pages/"), F.col(name_pages_by).cast("string"), F.lit(".json")), row)))
    return files


def to_archives(files: DataFrame, path: str) -> DataFrame:
    """files(book, name, content string) as zip files path/<book>.zip, each written by one task, a file at a time: (book, archive, files).

    path: a folder that all executors reach, local or a URL that pyarrow knows. A file is whole or absent: it is written
    under another name first. Names that would leave the archive raise an error.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        book, out, archive, n, done = None, None, None, 0, []

        def close() -> None:
            if archive is not None:
                archive.close()
                out.close()
                store.move(f"{root}/.{book}.zip.part", f"{root}/{book}.zip")
                done.append((book, f"{root}/{book}.zip", n))

        for batch in batches:
            for key, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if "/" in key or not _inside(name):
                    raise ValueError(f"entry leaves the bundle: {key}/{name}")
                if key != book:
                    close()
                    book, n = key, 0
                    out = store.open_output_stream(f"{root}/.{book}.zip.part")
                    archive = zipfile.ZipFile(_Written(out), "w", zipfile.ZIP_DEFLATED, compresslevel=9)
                archive.writestr(name, content)
                n += 1
        close()
        yield pa.RecordBatch.from_pydict({"book": [d[0] for d in done], "archive": [d[1] for d in done], "files": [d[2] for d in done]}, pa.schema([("book", pa.string()), ("archive", pa.string()), ("files", pa.int64())]))

    rows = files.select(F.col("book").cast("string").alias("book"), "name", "content")
    return materialise(rows.repartition("book").sortWithinPartitions("book", "name").mapInArrow(of, "book string, archive string, files long"), "bundle-archives")


class _Written(io.RawIOBase):
    """An output stream that can tell where it is, as zipfile asks, but not seek."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def writable(self) -> bool:
        return True


def from_archives(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of all bundles that are zip files at path (a file, folder or glob), each with a column `archive`; spans are numbered as they stand in their file."""
    found = materialise(entries(spark, path, (".json", ".jsonl")).withColumn("text", F.decode("content", "UTF-8")).drop("content"), "bundle-entries")
    strict = {"mode": "FAILFAST"}
    one = lambda where, schema: found.where(where).select("archive", F.from_json("text", schema, strict).alias("r")).select("archive", "r.*")
    many = lambda name, schema: found.where(F.col("path") == name).select("archive", F.explode(F.from_json("text", f"array<struct<{_fields(schema)}>>", strict)).alias("r")).select("archive", "r.*")
    lines = found.where("path = 'spans.jsonl'").select("archive", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where("trim(line) <> ''")
    told = lines.select("archive", F.col("ord").cast("long").alias("ord"), F.from_json("line", SPANS.replace("ord long, ", ""), strict).alias("r")).select("archive", "ord", "r.*")
    return {"meta": one("path = 'meta.json'", META), "spans": told, "styles": many("styles.json", STYLES), "pages": one("path like 'pages/%'", PAGES), "toc": many("toc.json", TOC)}


def _fields(schema: str) -> str:
    """A flat DDL schema as the fields of a struct."""
    return ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(","))


def probe(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that holds a bundle: a folder with meta, or a zip file. Each candidate is tried as it is, then with .zip behind it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in (p for c in candidates for p in (c, f"{c}.zip")):
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            continue
        if fs.getFileStatus(at).isDirectory():
            if any(fs.exists(hadoop.Path(f"{path}/{name}")) for name in ("meta", "meta.json")):
                return path
        elif path.lower().endswith(".zip"):
            return path
    return None


def _inside(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


def archive_names(content: bytes) -> list[str]:
    """Names in an archive; one that would leave the folder it is unpacked to raises an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if not _inside(name):
                raise ValueError(f"entry leaves the bundle: {name}")
        return z.namelist()


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, path) of the whole versions of a table, the latest last."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [str(s.getPath()) for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(p.rpartition("=")[2]), p) for p in listed if "/version=" in p and fs.exists(hadoop.Path(f"{p}/_SUCCESS")))


def _replace(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Write a new version of the table at path, and remove all but the one before it. Whatever is lost on the way, the last whole version stays."""
    before = _versions(spark, path)
    new = f"{path}/version={before[-1][0] + 1 if before else 0}"
    rows.write.mode("overwrite").parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for _, old in before[:-1]:
        hadoop.Path(old).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop.Path(old), True)
    return spark.read.schema(rows.schema).parquet(new)


def _positions(spark: SparkSession, path: str) -> DataFrame | None:
    found = _versions(spark, path)
    return spark.read.parquet(found[-1][1]) if found else None


def save_positions(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Upsert of (book_id, position_ms, ts) into the table at path: the latest of each book; as a foreachBatch sink. One writer at a time."""
    rows, old = new.select("book_id", "position_ms", "ts"), _positions(spark, path)
    every = rows if old is None else old.unionByName(rows)
    return _replace(spark, every.groupBy("book_id").agg(F.max_by("position_ms", "ts").alias("position_ms"), F.max("ts").alias("ts")), path)


def load_positions(spark: SparkSession, books: DataFrame, path: str) -> DataFrame:
    """books(book_id) with position_ms, 0 where none is saved."""
    old = _positions(spark, path)
    if old is None:
        return books.withColumn("position_ms", F.lit(0).cast("long"))
    return books.join(old.select("book_id", "position_ms"), "book_id", "left").withColumn("position_ms", F.coalesce("position_ms", F.lit(0)).cast("long"))


def clear_positions(spark: SparkSession, books: DataFrame, path: str) -> None:
    """Forget the positions of books(book_id)."""
    old = _positions(spark, path)
    if old is not None:
        _replace(spark, old.join(books.select("book_id").distinct(), "book_id", "left_anti"), path)
