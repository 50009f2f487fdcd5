"""Files as texts: their bytes decoded in column expressions, one row a file.

The formats read from here, a GeoJSON document or a KML one, have a single root, so a file is
the unit; many files are one job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the bytes 80 to 9F mean in windows-1252; the five it leaves open stay controls.
HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
#: Marks at the start of a file, the longer ones first, and what they say.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
#: Rows at which a file is called large, and cells and expanded bytes at which one is refused.
WARN_ROWS, MOST_CELLS, MOST_BYTES = 50_000, 2_000_000, 150 << 20


class FileTooLarge(ValueError):
    """A file that the limits for single files refuse."""


def decoded(content: Column) -> Column:
    """A file's text: by its mark, else as UTF-8 where that is valid, else as windows-1252."""
    rest = lambda k: F.substring(content, k // 2 + 1, 2**31 - 1)
    out = None
    for mark, charset in MARKS:
        here = F.hex(F.substring(content, 1, len(mark) // 2)) == mark
        text = as_text(rest(len(mark)), charset)
        out = F.when(here, text) if out is None else out.when(here, text)
    return out.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(as_text(content, "windows-1252"))


def as_text(raw: Column, charset: str) -> Column:
    """Bytes of a known charset as text; a mark at the start stays."""
    if charset == "UTF-8":
        return raw.cast("string")
    if charset.startswith("UTF-32"):  # told by a mark only
        return F.ltrim(F.decode(F.concat(F.unhex(F.lit("FFFE0000" if charset.endswith("LE") else "0000FEFF")), raw), "UTF-32"), F.lit("\ufeff"))
    if charset != "windows-1252":
        return F.decode(raw, charset)
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(chr(0x80 + k) for k in range(32)), HIGH)


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The KML inside a KMZ: doc.kml if there is one, else the first."""
    for batch in batches:
        for source, content in zip(*(batch.column(k) for k in range(2)), strict=True):
            data = content.as_py()
            if data[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".kml")]
                    best = next((n for n in names if n.lower().rsplit("/", 1)[-1] == "doc.kml"), names[0] if names else None)
                    if best is not None and z.getinfo(best).file_size > MOST_BYTES:
                        raise FileTooLarge(f"{source.as_py()}: {z.getinfo(best).file_size} bytes expanded")
                    data = z.read(best) if best is not None else b""
            yield pa.RecordBatch.from_arrays([pa.array([source.as_py()]), pa.array([data], pa.binary())], ["source_id", "content"])


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_id, content."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_id"), "content")


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_id, text of the files; a KMZ's is that of its KML."""
    found = files(spark, path)
    zipped = F.lower(F.col("source_id")).endswith(".kmz") | (F.hex(F.substring("content", 1, 2)) == "504B")
    plain = found.where(~zipped)
    opened = found.where(zipped).mapInArrow(_unzipped, "source_id string, content binary")
    return plain.unionAll(opened).select("source_id", decoded(F.col("content")).alias("text"))


def from_text(spark: SparkSession, text: str, name: str = "pasted.csv") -> DataFrame:
    """A pasted text as a source."""
    return spark.createDataFrame([(name, text)], "source_id string, text string")


def check_cells(tables: DataFrame) -> DataFrame:
    """Rows, cells and the verdict of each source against the limits of single files: fine, large or refused."""
    sizes = tables.groupBy("source_id").agg(F.count("*").alias("rows"), F.sum(F.size("cells")).alias("cells"))
    return sizes.withColumn("verdict", F.when(F.col("cells") > MOST_CELLS, "refused").when(F.col("rows") > WARN_ROWS, "large").otherwise("fine"))
