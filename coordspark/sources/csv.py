"""Separated text with everything as text: separator by the first rows, header by the first row.

A quote counts only where a field begins; there it opens a quoted field, which may hold
separators, line ends and doubled quotes, and what follows its closing quote up to the next
separator belongs to the field as it stands. Elsewhere a quote is a sign like any other, so
``38° 43' 12"`` is a cell. Lines without a character are left out.

Files are read in splits, by physical lines, and no file is a cell. At a line's start the reader
is either between records or inside a quoted field, so a line is one of four functions of that
state: it keeps it, turns it, or ends in the same state from both. A regular expression for each
state tells which. Each split composes its lines' functions, the splits' functions are composed
in their order within a file, and that gives each split the state it begins in. Splits in which
every line is a record are cut where they are read, without a shuffle; only lines of the other
splits are ordered, and only lines of records that span several are brought together. A record of
more than ``MOST_RECORD`` characters is refused: an unclosed quote would else take the rest of a
file into one cell.

Texts that are cells already, pasted ones, are cut by the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coordspark.operators.columns import named_array
from coordspark.operators.tables import discard, fitted, written
from coordspark.sources.texts import MARKS, as_text

#: Separators in the order tried, the rows looked at, and the fields a row must have on average.
SEPARATORS, SNIFFED, LEAST_FIELDS = (",", ";", "\t", "|"), 10, 1.99
#: The first lines of a file, in which the rows looked at are found, and the longest record.
HEAD_LINES, MOST_RECORD = 1000, 64 << 20
BYTE_ORDER = "﻿"
#: Inside quotes: anything up to the closing one, doubled ones passed over.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'


def _class(separator: str) -> str:
    return "\\t" if separator == "\t" else "\\" + separator


def _field(separator: str) -> str:
    """A field from its start, closed if it is quoted."""
    s = _class(separator)
    return rf'(?:"{_INSIDE}"[^{s}\r\n]*+|[^"{s}\r\n][^{s}\r\n]*+)?+'


def _open(separator: str) -> str:
    """What leaves a quoted field open, from between records."""
    return rf'\A(?:{_field(separator)}[{_class(separator)}\r\n])*+"{_INSIDE}\z'


def _still_open(separator: str) -> str:
    """What leaves a quoted field open, from inside one."""
    s = _class(separator)
    return rf'\A{_INSIDE}(?:\z|"[^{s}\r\n]*+[{s}\r\n](?:{_field(separator)}[{s}\r\n])*+"{_INSIDE}\z)'


def _by_separator(separator: Column | str, made) -> Column:
    if isinstance(separator, str):
        return made(separator)
    out = None
    for s in SEPARATORS:
        out = F.when(separator == s, made(s)) if out is None else out.when(separator == s, made(s))
    return out


def records(text: Column, separator: str) -> Column:
    """The records of a text, without those that have no character."""
    s, f = _class(separator), _field(separator)
    found = F.regexp_extract_all(text, F.lit(rf'((?:{f}{s})*+(?:"{_INSIDE}\z|{f}))(?:\r\n|\n|\r|\z)'), F.lit(1))
    return F.filter(found, lambda r: r != "")


def fields(record: Column, separator: str) -> Column:
    """A record's fields, quotes that enclose one taken off and doubled ones single."""
    s = _class(separator)
    closed = F.when(record.rlike(_open(separator)), F.concat(record, F.lit('"'))).otherwise(record)
    bare = rf'[^"{s}][^{s}]*+'
    found = F.regexp_extract_all(closed, F.lit(rf'(?:\A|(?<={s}))((?:"{_INSIDE}"[^{s}]*+|{bare})?+)(?:{s}|\z)'), F.lit(1))
    parts = rf'(?s)\A"({_INSIDE})"(.*)\z'
    quoted = lambda f: F.concat(F.replace(F.regexp_extract(f, parts, 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, parts, 2))
    return F.transform(found, lambda f: F.when(f.startswith('"'), quoted(f)).otherwise(f))


def sniffed(text: Column) -> Column:
    """The separator whose first rows differ least in their number of fields; more fields and then the earlier one break ties."""
    tries = []
    for k, sep in enumerate(SEPARATORS):
        counts = F.transform(F.slice(records(text, sep), 1, SNIFFED), lambda r: F.size(fields(r, sep)))  # noqa: B023
        steps = F.zip_with(F.slice(counts, 2, SNIFFED), F.slice(counts, 1, SNIFFED), lambda b, a: F.abs(F.coalesce(b - a, F.lit(0))))
        delta = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
        mean = F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0.0), lambda a, n: a + n) / F.size(counts)).otherwise(0.0)
        tries.append(F.struct(delta.alias("delta"), (-mean).alias("mean"), F.lit(k).alias("k"), F.lit(sep).alias("sep")))
    good = F.filter(F.array(*tries), lambda t: -t["mean"] > LEAST_FIELDS)
    return F.coalesce(F.array_min(good)["sep"], F.lit(","))


def _shaped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of (source_id, pos, cells): the first row is the header, the others are as wide; empty ones at the end go."""
    last = rows.where(F.exists("cells", lambda x: x != "")).groupBy("source_id").agg(F.max("pos").alias("last"))
    tops = fitted(rows.where("pos = 0").select("source_id", F.col("cells").alias("top")).join(last, "source_id"))
    width = F.size("top")
    full = rows.where("pos > 0").join(tops, "source_id").where("pos <= last")
    cells = F.when(F.size("cells") == width, F.col("cells")).otherwise(F.transform("top", lambda _, i: F.coalesce(F.get("cells", i), F.lit(""))))
    return full.select("source_id", (F.col("pos") - 1).cast("long").alias("row_id"), cells.alias("cells")), tops.select("source_id", named_array(F.col("top")).alias("names"))


def read_texts(texts: DataFrame, separator: str | None = None, decimal: str = ".") -> tuple[DataFrame, DataFrame]:
    """The rows (source_id, row_id, cells) and headers (source_id, names) of texts in cells (source_id, text).

    Rows are as wide as the header: short ones are filled with empty cells, long ones cut. Rows
    of empty cells at the end are left out. The decimal sign is accepted and changes nothing, as
    cells stay text.
    """
    text = F.regexp_replace("text", f"^{BYTE_ORDER}", "")
    cut = texts.select("source_id", text.alias("text")).withColumn("sep", F.lit(separator) if separator else sniffed(F.col("text")))
    by = separator or F.col("sep")
    each = cut.select("source_id", "sep", F.posexplode(_by_separator(by, lambda s: records(F.col("text"), s))).alias("pos", "record"))
    return _shaped(each.select("source_id", "pos", _by_separator(by, lambda s: fields(F.col("record"), s)).alias("cells")))


def _lines(spark: SparkSession, paths: list[str], charset: str | None = None) -> DataFrame:
    """Physical lines as bytes: source_id, at (where the split begins), k (in order within a split), raw.

    A projection that numbers rows lets no filter through to the scan, so k is the same in every
    job of the session over these files.
    """
    reader = spark.read.option("lineSep", "\n") if charset is None else spark.read.option("lineSep", "\n").option("encoding", charset)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_size").alias("size"))


def _charsets(lines: DataFrame) -> DataFrame:
    """Each file's charset: by its mark, else UTF-8 where all its lines are that, else windows-1252; and whether it ends in a line end (of one byte)."""
    start = F.min_by(F.hex(F.substring("raw", 1, 4)), F.struct("at", "k"))
    seen = lines.groupBy("source_id").agg(start.alias("start"), F.every(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"), (F.sum(F.octet_length("raw").cast("long") + 1) == F.max("size")).alias("ended"))
    charset = None
    for mark, name in MARKS:
        charset = F.when(F.col("start").startswith(mark), name) if charset is None else charset.when(F.col("start").startswith(mark), name)
    return seen.select("source_id", charset.when(F.col("utf8"), "UTF-8").otherwise("windows-1252").alias("charset"), "ended")


def _before(kept: Column, turned: Column, entry: Column, order) -> Column:
    """The state before a row: what the last row that settles it says, else the entry, turned as often as rows since do.

    ``kept`` is a settled state or null, ``turned`` 1 where a row turns the state.
    """
    upto, since = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(turned).over(upto)
    last = F.last(F.when(kept.isNotNull(), F.struct(kept.alias("state"), turns.alias("turns"))), ignorenulls=True)
    settled = last.over(since)
    odd = (turns - turned - F.coalesce(settled["turns"], F.lit(0))) % 2 == 1
    return F.coalesce(settled["state"], entry) != odd


def _function(lines: DataFrame) -> DataFrame:
    """Lines with ``kept`` and ``turned``: what a line makes of the state (true inside quotes)."""
    quoted = F.contains("line", F.lit('"'))
    opens = quoted & _by_separator(F.col("sep"), lambda s: F.col("line").rlike(_open(s)))
    stays = ~quoted | _by_separator(F.col("sep"), lambda s: F.col("line").rlike(_still_open(s)))
    named = lines.withColumns({"opens": opens, "stays": stays})
    return named.withColumns({"kept": F.when(F.col("opens") == F.col("stays"), F.col("opens")), "turned": (F.col("opens") & ~F.col("stays")).cast("int")})


def _cut(lines: DataFrame, most: int) -> DataFrame:
    """The records of lines (source_id, at, k, line, sep, ended): source_id, pos, record, sep."""
    # an inner carriage return ends a record, an empty line is none: such splits are numbered after cutting
    odd = F.col("line").isin("", "\r") | F.rtrim(F.col("line"), F.lit("\r")).contains("\r") | F.col("line").endswith("\r\r")
    read = _function(lines)
    splits = read.groupBy("source_id", "at").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.count_if(odd).alias("odd"), F.count_if("opens").alias("opens"))
    splits = written(splits, "csv-splits")
    block, file = Window.partitionBy("source_id", "at").orderBy("k"), Window.partitionBy("source_id").orderBy("at")
    # where no line opens a quote, no split begins inside one; elsewhere, what each split makes of its state
    some = fitted(splits.where("opens > 0").select("source_id").distinct())
    hard = read.join(some, "source_id", "left_semi").where("kept is not null or turned = 1")
    false = F.lit(False)
    ends = hard.withColumn("if_out", _before(F.col("kept"), F.col("turned"), false, block)).withColumn("if_in", _before(F.col("kept"), F.col("turned"), F.lit(True), block))
    step = lambda c: F.when(F.col(c), F.col("stays")).otherwise(F.col("opens"))
    ends = ends.groupBy("source_id", "at").agg(F.max_by(F.struct(step("if_out").alias("out"), step("if_in").alias("in_")), "k").alias("e"))
    known = splits.join(ends, ["source_id", "at"], "left").withColumns({"kept": F.when(F.col("e.out") == F.col("e.in_"), F.col("e.out")), "turned": (F.coalesce(F.col("e.out"), false) & ~F.coalesce(F.col("e.in_"), false)).cast("int")})
    known = known.withColumn("entry", _before(F.col("kept"), F.col("turned"), false, file))  # a row for each split
    known = written(known.select("source_id", "at", "n", "first", "entry", ((F.col("odd") == 0) & (F.col("opens") == 0) & ~F.col("entry")).alias("plain")), "csv-known")
    discard(splits)

    at_split = ["source_id", "at"]
    plain = lines.join(fitted(known.where("plain").select(*at_split, "first")), at_split)
    plain = plain.select(*at_split, (F.col("k") - F.col("first")).alias("nth"), F.rtrim(F.col("line"), F.lit("\r")).alias("record"), "sep")
    other = read.join(fitted(known.where("not plain").select(*at_split, "entry")), at_split)
    other = other.withColumn("inside", _before(F.col("kept"), F.col("turned"), F.col("entry"), block))
    other = other.withColumn("after", F.when(F.col("inside"), F.col("stays")).otherwise(F.col("opens")))
    begun = F.last(F.when(~F.col("inside"), F.struct("at", "k")), ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0))
    other = written(other.withColumn("begun", begun).select(*at_split, "k", "line", "sep", "ended", "inside", "after", "begun"), "csv-lines")
    # lines before a split's first record belong to the last record of an earlier split
    carried = other.groupBy(*at_split).agg(F.max_by("begun", "k").alias("begun"))
    carried = carried.withColumn("carried", F.last("begun", ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1)))
    several = other.where("inside or after").join(fitted(carried.select(*at_split, "carried")), at_split).withColumn("begun", F.coalesce("begun", "carried"))
    size = F.sum(F.char_length("line").cast("long") + 1)
    told = F.raise_error(F.concat(F.lit("a record is too large: "), F.col("source_id"))).cast("string")
    parts = several.groupBy("source_id", "begun", "sep").agg(size.alias("size"))
    held = several.join(parts.where(F.when(F.col("size") > most, told).isNull()).drop("size"), ["source_id", "begun", "sep"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "line"))), lambda x: x["line"]), "\n")
    texts = held.groupBy("source_id", "begun", "sep").agg(whole.alias("text"), F.first("ended").alias("ended"))
    # a record that is never closed holds the last line end too
    last = F.col("ended") & _by_separator(F.col("sep"), lambda s: F.col("text").rlike(_open(s)))
    texts = texts.select("source_id", "begun.at", "begun.k", F.when(last, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"), "sep")
    texts = texts.unionAll(other.where("not inside and not after").select(*at_split, "k", F.col("line").alias("text"), "sep"))
    cut = texts.select(*at_split, "k", "sep", F.posexplode(_by_separator(F.col("sep"), lambda s: records(F.col("text"), s))).alias("part", "record"))
    nth = F.row_number().over(Window.partitionBy(*at_split).orderBy("k", "part")).cast("long") - 1
    cut = written(cut.select(*at_split, nth.alias("nth"), "record", "sep"), "csv-cut")
    counts = known.where("plain").select(*at_split, "n").unionAll(cut.groupBy(*at_split).agg(F.count("*").alias("n")))
    starts = fitted(written(counts.select(*at_split, (F.sum("n").over(file) - F.col("n")).alias("start")), "csv-starts"))
    rows = plain.unionAll(cut).join(starts, at_split)
    return rows.select("source_id", (F.col("start") + F.col("nth")).alias("pos"), "record", "sep")


def read(spark: SparkSession, path: str | list[str], separator: str | None = None, decimal: str = ".", most: int = MOST_RECORD) -> tuple[DataFrame, DataFrame]:
    """The rows and headers of files of any size, as of ``read_texts``."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = _lines(spark, paths)
    charsets = written(_charsets(lines), "csv-charsets")
    found = None
    wide = [r.charset for r in charsets.select("charset").distinct().collect()]
    for charset in wide:  # one of seven
        mine = fitted(charsets.where(F.col("charset") == charset))
        same = (_lines(spark, paths, charset) if charset.startswith(("UTF-16", "UTF-32")) else lines).join(mine, "source_id")
        same = same.select("source_id", "at", "k", as_text(F.col("raw"), charset).alias("line"), "ended")
        found = same if found is None else found.unionAll(same)
    if found is None:
        found = lines.select("source_id", "at", "k", F.lit("").alias("line"), F.lit(False).alias("ended"))
    # the mark goes before a quote behind it can count
    first = fitted(written(found.where("at = 0").groupBy("source_id").agg(F.min("k").alias("first")), "csv-first"))
    found = found.join(first, "source_id").withColumn("line", F.when((F.col("at") == 0) & (F.col("k") == F.col("first")), F.ltrim("line", F.lit(BYTE_ORDER))).otherwise(F.col("line")))
    head = found.where((F.col("at") == 0) & (F.col("k") < F.col("first") + HEAD_LINES))
    found = found.drop("first")
    if separator is None:
        head = head.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))
        told = fitted(written(head.select("source_id", sniffed(F.col("text")).alias("sep")), "csv-separators"))
        found = found.join(told, "source_id")
    else:
        found = found.withColumn("sep", F.lit(separator))
    rows = _cut(found, most)
    return _shaped(rows.select("source_id", "pos", _by_separator(separator or F.col("sep"), lambda s: fields(F.col("record"), s)).alias("cells")))


def as_columns(tables: DataFrame, names: list[str]) -> DataFrame:
    """The rows of one kind of table with a column for each name."""
    return tables.select("source_id", "row_id", *(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))
