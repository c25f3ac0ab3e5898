"""Files in, records out: scans, identity, page decoding and recognition behind a pluggable boundary, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_PIXELS = 12_000_000, 30_000_000
# Words that mark a passport page.
PASSPORT_MARKS = ("PASSPORT", "PASPORT", "P<", "ПАСПОРТ", "护照")
ITEMS = "doc_id string, page_no int, pass_name string, item_idx int, text string, score double, x1 double, y1 double, x2 double, y2 double"


def scan_files(spark: SparkSession, root: str, pattern: str = "*.{pdf,jpg,jpeg,png}") -> DataFrame:
    """Files under a folder; the size limit is applied before contents are read.  doc_id is the content's SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = files.where(F.col("length") <= MAX_BYTES)
    return files.select(F.sha2("content", 256).alias("doc_id"), "path", "length", F.regexp_extract("path", r"/([A-Z]{3})/[^/]+$", 1).alias("country"), "content")


def ordered_scan(files: DataFrame) -> DataFrame:
    """Files in an order that does not follow their names: by the hash of their path."""
    return files.withColumn("place", F.sha2("path", 256)).orderBy("place", "path")


def uploads(spark: SparkSession, blobs: list[tuple[str, bytes]]) -> DataFrame:
    """Contents given by a caller (name, bytes), with the identity of their bytes; equal contents once."""
    rows = spark.createDataFrame(blobs, "name string, content binary").withColumn("doc_id", F.sha2("content", 256))
    return rows.groupBy("doc_id").agg(F.min(F.struct("name", "content")).alias("f")).select("doc_id", "f.name", F.length("f.content").cast("bigint").alias("length"), "f.content")


def input_error(content: Column, length: Column) -> Column:
    """Why a file is not read, or null: too many bytes, no known format, or (where the header tells) too many pixels."""
    start = F.hex(F.substring(content, 1, 8))
    png, jpeg, pdf = start == "89504E470D0A1A0A", start.startswith("FFD8FF"), start.startswith("25504446")
    side = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    return (
        F.when(length > MAX_BYTES, "FILE_TOO_LARGE").when(length == 0, "EMPTY_FILE").when(~(png | jpeg | pdf), "UNSUPPORTED_FORMAT")
        .when(png & (side(17) * side(21) > MAX_PIXELS), "TOO_MANY_PIXELS")
    )


def first_page(pages: DataFrame) -> DataFrame:
    return pages.where("page_no = 0")


def capped_pages(pages: DataFrame, most: int) -> DataFrame:
    """The first pages of each document: a feature of the scan, as its caller asks for it."""
    return pages.where(F.col("page_no") < most)


def safe_id(content: Column, length: Column) -> Column:
    """An identity without names: hash of the first MiB and the size."""
    return F.substring(F.sha2(F.concat(F.substring(content, 1, 1 << 20), F.encode(length.cast("string"), "utf-8")), 256), 1, 12)


def passport_page(text: Column, zone_found: Column) -> Column:
    return zone_found | F.upper(text).rlike("|".join(PASSPORT_MARKS))


def recognize(files: DataFrame, recognizer: Callable[[], Callable[[bytes], Iterable[tuple]]]) -> DataFrame:
    """Runs a recogniser over contents.  ``recognizer`` is called once a worker and gives a function from bytes to rows
    (page_no, pass_name, item_idx, text, score, x1, y1, x2, y2); pixels never leave the worker, and an error gives no rows but does not end the job."""

    def run(batches):
        import pandas as pd

        read = recognizer()
        for b in batches:
            rows = []
            for doc_id, content in zip(b["doc_id"], b["content"]):
                try:
                    rows += [(doc_id, *r) for r in read(content)]
                except Exception as e:  # the row tells what happened
                    rows.append((doc_id, 0, "error", 0, f"{type(e).__name__}", 0.0, 0.0, 0.0, 0.0, 0.0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])

    return files.select("doc_id", "content").mapInPandas(run, ITEMS)


def image_quality(gray) -> tuple[float, float, float]:
    """Blur (variance of the Laplacian), brightness and share of glare of a grey image (numpy, uint8)."""
    import numpy as np

    g = np.pad(gray.astype(np.float64), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var()), float(gray.mean()), float((gray > 248).mean())


def resampled(image, scale: float):
    """An image (numpy, uint8) at another size: mean of the area when it shrinks, bicubic (a = -0.75) when it grows."""
    import numpy as np

    def weights(n: int):
        m = max(1, int(round(n * scale)))
        out = np.zeros((m, n))
        if scale < 1:
            edge = np.linspace(0, n, m + 1)
            for i in range(m):
                lo, hi = edge[i], edge[i + 1]
                k = np.arange(int(lo), min(n, int(np.ceil(hi))))
                out[i, k] = np.minimum(k + 1, hi) - np.maximum(k, lo)
        else:
            at = (np.arange(m) + 0.5) / scale - 0.5
            for d in range(-1, 3):
                k = np.floor(at) + d
                x = np.abs(at - k)
                w = np.where(x <= 1, (1.25 * x - 2.25) * x * x + 1, ((-0.75 * x + 3.75) * x - 6) * x + 3)
                np.add.at(out, (np.arange(m), np.clip(k, 0, n - 1).astype(int)), w)
        return out / out.sum(1, keepdims=True)

    rows, cols = weights(image.shape[0]), weights(image.shape[1])
    flat = image.reshape(image.shape[0], image.shape[1], -1).astype(np.float64)
    done = np.einsum("ij,jkc,lk->ilc", rows, flat, cols, optimize=True)
    return np.clip(np.rint(done), 0, 255).astype(np.uint8).reshape((rows.shape[0], cols.shape[0]) + image.shape[2:])


def page_scale(width: int) -> float:
    """How a page is scaled before it is read: down to 2200 columns, up to 1400."""
    return 2200 / width if width > 2200 else 1400 / width if width < 1400 else 1.0


def zone_crop(image):
    """The lower part of a page, where the machine-readable zone stands."""
    return image[int(image.shape[0] * 0.65) :]


def name_crop(image):
    """The band of the names, scaled up."""
    height, width = image.shape[:2]
    crop, scale = image[int(height * 0.24) : int(height * 0.62)], min(2600, max(width, 2200)) / max(width, 1)
    return resampled(crop, scale) if scale > 1.02 else crop


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: one JSON document a file, with a fixed schema."""
    passport = "struct<" + ",".join(f"{c}:string" for c in "last_name first_name patronymic gender nationality document_number issuing_state date_of_birth date_of_expiry date_of_issue optional_data authority place_of_birth".split()) + ",mrz_lines:array<string>>"
    vehicles = "array<struct<" + ",".join(f"{c}:string" for c in "vin plate brand model vehicle_type owner engine_no body_number chassis register_date issue_date".split()) + ">>"
    return spark.read.schema(f"file string, passport {passport}, vehicles {vehicles}").option("multiLine", "true").json(path)


def truth_with_files(truth: DataFrame, files: DataFrame) -> DataFrame:
    """Ground truth whose file is there."""
    return truth.join(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).distinct(), "file", "left_semi")


def read_dimension(spark: SparkSession, path: str, columns: str = "code string, name string, description string") -> DataFrame:
    return spark.read.schema(columns).option("multiLine", "true").json(path)


def write_json(records: DataFrame, path: str) -> None:
    """Nulls are kept; Spark's commit makes the replacement atomic for readers of whole folders."""
    records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Arrays are joined by |, other nested columns are dropped."""
    cols = [F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in rows.dtypes if not t.startswith(("struct", "map")) and (t == "array<string>" or not t.startswith("array"))]
    rows.select(cols).write.mode("overwrite").option("header", "true").csv(path)


def technical(records: DataFrame) -> DataFrame:
    """The whole result without its single OCR objects."""
    return records.drop("objects")


def object_rows(records: DataFrame) -> DataFrame:
    """One row for each OCR object of a result, with its page."""
    return records.select("doc_id", F.explode("objects").alias("o")).select("doc_id", "o.*")


def write_errors(rows: DataFrame, path: str) -> None:
    """The errors of a comparison as CSV with a byte-order mark before the header, for spreadsheet programs."""
    named = rows.select([F.col(c).alias("\ufeff" + c) if i == 0 else F.col(c) for i, c in enumerate(rows.columns)])
    named.write.mode("overwrite").option("header", "true").csv(path)


def markdown_report(summary: DataFrame, title: str) -> str:
    """A table of a summary, which is small by construction (a row for each group)."""
    rows = summary.collect()
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows) + "\n"
