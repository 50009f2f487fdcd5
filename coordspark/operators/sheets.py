"""Map sheets: which a point lies in, whether the one that is written agrees, and what would mend the row.

The index is a table made from runs of numbers; points meet it by the cell they fall in,
written sheets by their key. It holds some hundreds of rows at any size of the data, so it is
broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.functions import crs
from coordspark.functions.parse import blank, sheet_key_25k, sheet_key_50k
from coordspark.operators import sheet_index as index
from coordspark.operators.tables import written as written_table

#: How near the edge of a sheet is in it, and the least distance at which a digit is corrected.
EDGE_KM, FAR_KM = 0.5, 5.0
HUNDREDS, TENS = tuple(range(100_000, 600_000, 100_000)), tuple(range(10_000, 100_000, 10_000))
MILITARY = 20790
BOX = "struct<m0:double,p0:double,m1:double,p1:double>"


def sheets_25k(spark: SparkSession) -> DataFrame:
    """key, i, j: a sheet's number and the cell it covers; a sheet may cover two."""
    runs = spark.createDataFrame(list(index.RUNS_25), "j int, i int, n int, count int")
    each = runs.select(F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"), "*")
    return each.select((F.col("n") + F.col("k")).cast("string").alias("key"), (F.col("i") + F.col("k")).alias("i"), "j").unionAll(spark.createDataFrame(list(index.SPECIAL_25), "key string, i int, j int"))


def sheets_50k(spark: SparkSession) -> DataFrame:
    """key, i, j, name."""
    (m0, p0), (w, h) = index.ORIGIN, index.SIZE_50
    rows = spark.createDataFrame(list(index.SHEETS_50), "key string, m int, p int, name string")
    return rows.select("key", ((F.col("m") - m0) / w).cast("int").alias("i"), ((F.col("p") - p0) / h).cast("int").alias("j"), "name")


def _boxes(sheets: DataFrame, size: tuple[int, int], *more: str) -> DataFrame:
    """Each key's rectangles in kilometres."""
    m, p = (F.lit(float(index.ORIGIN[0])) + size[0] * F.col("i"), F.lit(float(index.ORIGIN[1])) + size[1] * F.col("j"))
    box = F.struct(m.alias("m0"), p.alias("p0"), (m + size[0]).alias("m1"), (p + size[1]).alias("p1"))
    return sheets.groupBy("key").agg(F.array_sort(F.collect_list(box)).alias("boxes"), *(F.min(c).alias(c) for c in more))  # one or two rows a key


def _cell(m: str, p: str, size: tuple[int, int]) -> tuple[Column, Column]:
    return F.floor((F.col(m) - index.ORIGIN[0]) / size[0]).cast("int"), F.floor((F.col(p) - index.ORIGIN[1]) / size[1]).cast("int")


def sheets_at(points: DataFrame, m: str = "m", p: str = "p") -> DataFrame:
    """The points with at25, at50 and at50name, the sheets that hold their kilometres; null outside all."""
    spark = points.sparkSession
    a, b = sheets_25k(spark).select(F.col("key").alias("at25"), F.col("i").alias("_i25"), F.col("j").alias("_j25")), sheets_50k(spark).select(F.col("key").alias("at50"), F.col("name").alias("at50name"), F.col("i").alias("_i50"), F.col("j").alias("_j50"))
    i25, j25 = _cell(m, p, index.SIZE_25)
    i50, j50 = _cell(m, p, index.SIZE_50)
    found = points.withColumns({"_i25": i25, "_j25": j25, "_i50": i50, "_j50": j50})
    found = found.join(F.broadcast(a), ["_i25", "_j25"], "left").join(F.broadcast(b), ["_i50", "_j50"], "left")
    return found.select(*points.columns, "at25", "at50", "at50name")


def sheet_columns(located: DataFrame) -> DataFrame:
    """The located points with the columns that an export has: empty where there is no sheet."""
    return located.withColumns({"Folha_25k": F.coalesce("at25", F.lit("")), "Folha_50k": F.coalesce("at50", F.lit("")), "Nome_50k": F.coalesce("at50name", F.lit(""))})


def military_km(points: DataFrame, lat: str = "lat", lon: str = "lon", mode: str = "helmert") -> DataFrame:
    """The points with m, p, kilometres of the military grid."""
    there = crs.transform(points, lon, lat, 4326, MILITARY, ("m", "p"), mode=mode)
    return written_table(there.withColumns({"m": F.col("m") / 1000, "p": F.col("p") / 1000}), "military-km")


def distance(m: Column, p: Column, boxes: Column) -> Column:
    """Kilometres to the nearest rectangle, 0 inside."""
    off = lambda x, lo, hi: F.greatest(lo - x, F.lit(0.0), x - hi)
    return F.array_min(F.transform(boxes, lambda b: F.hypot(off(m, b["m0"], b["m1"]), off(p, b["p0"], b["p1"]))))


def check_rows(points: DataFrame, declared25: str, declared50: str, m: str = "m", p: str = "p") -> DataFrame:
    """The points with the sheets they lie in and sheet_status: none (no place), unknown (no sheet), ok or off; against, distance_km."""
    spark = points.sparkSession
    b25 = _boxes(sheets_25k(spark), index.SIZE_25).select(F.col("key").alias("key25"), F.col("boxes").alias("_b25"))
    b50 = _boxes(sheets_50k(spark), index.SIZE_50, "name").select(F.col("key").alias("key50"), F.col("boxes").alias("_b50"), F.col("name").alias("name50"))
    alias = F.create_map(*(F.lit(x) for pair in index.ALIASES_50.items() for x in pair))
    k50 = sheet_key_50k(F.col(declared50))
    found = sheets_at(points, m, p).withColumns({"key25": sheet_key_25k(F.col(declared25)), "key50": F.coalesce(alias[k50], k50)})
    found = found.join(F.broadcast(b25), "key25", "left").join(F.broadcast(b50), "key50", "left")
    placed = F.col(m).isNotNull() & F.col(p).isNotNull()
    found = found.withColumn("boxes", F.coalesce("_b25", "_b50")).withColumn("against", F.when(placed & F.col("_b25").isNotNull(), "25").when(placed & F.col("_b50").isNotNull(), "50"))
    found = found.withColumn("distance_km", F.when(placed & F.col("boxes").isNotNull(), distance(F.col(m), F.col(p), F.col("boxes"))))
    status = F.when(~placed, "none").when(F.col("distance_km").isNull(), "unknown").when(F.col("distance_km") <= EDGE_KM, "ok").otherwise("off")
    return found.withColumn("sheet_status", status).drop("_b25", "_b50")


def _plain(text: Column) -> Column:
    """Letters and digits in lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"), "[^a-z0-9]", "")


def row_names(cells: Column, name: Column) -> Column:
    """Whether a row's cells name a sheet: they hold the start of its name, or it theirs."""
    head = _plain(F.regexp_replace(F.regexp_extract(name, r"^([^(]*)", 1), "(?i)-(norte|sul|leste|oeste)$", ""))
    has = F.exists(cells, lambda c: (F.length(_plain(c)) >= 4) & ~_plain(c).rlike("^[0-9]+$") & (F.contains(_plain(c), F.substring(head, 1, 6)) | F.contains(head, F.substring(_plain(c), 1, 6))))
    return F.coalesce((F.length(head) >= 4) & has, F.lit(False))


def _tries(x: Column, y: Column, military: bool) -> list[tuple[str, list[tuple[str, Column, Column, int]]]]:
    """What may be wrong with a row, in order: exchanged, a false origin left out, a digit off."""
    origin = [("origin-p", x, y + 300_000, 0), ("origin-m", x + 200_000, y, 0), ("origin-both", x + 200_000, y + 300_000, 0)]
    digits = lambda sizes: [t for d in sizes for t in (("p", x, y + d, d), ("p", x, y - d, -d), ("m", x + d, y, d), ("m", x - d, y, -d))]
    return [("swap", [("swap", y, x, 0)]), *([("origin", origin)] if military else []), ("digit", digits(HUNDREDS)), ("digit", digits(TENS))]


def propose_fix(off: DataFrame, x: str = "x", y: str = "y", system: int = MILITARY) -> DataFrame:
    """For rows (row_id, x, y, boxes, distance_km) off their sheet: row_id, fix (kind, label, x, y, delta), confidence.

    Of each group of tries the one that alone lands in the sheet is taken; two that do end the search.
    """
    military = system == MILITARY
    tries = [F.struct(F.lit(g).alias("g"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), cx.alias("x"), cy.alias("y"), F.lit(d).alias("delta")) for g, (kind, group) in enumerate(_tries(F.col(x), F.col(y), military)) for label, cx, cy, d in group]
    each = off.select("row_id", "boxes", "distance_km", F.explode(F.array(*tries)).alias("t")).select("row_id", "boxes", "distance_km", "t.*")
    there = each.withColumns({"m": F.col("x"), "p": F.col("y")}) if military else crs.transform(each, "x", "y", system, MILITARY, ("m", "p"), mode="helmert")
    near = there.where(distance(F.col("m") / 1000, F.col("p") / 1000, F.col("boxes")) <= EDGE_KM)
    groups = near.groupBy("row_id", "g").agg(F.count("*").alias("hits"), F.first("distance_km").alias("distance_km"), F.first(F.struct("kind", "label", "x", "y", F.when(F.col("kind") == "digit", F.col("delta")).alias("delta"))).alias("fix"))
    first = groups.groupBy("row_id").agg(F.min_by(F.struct("hits", "distance_km", "fix"), "g").alias("b")).where("b.hits = 1").select("row_id", "b.distance_km", "b.fix")
    return first.where((F.col("fix.kind") != "digit") | (F.col("distance_km") > FAR_KM)).select("row_id", "fix", F.when(F.col("fix.kind") == "digit", "media").otherwise("alta").alias("confidence"))


def check_sheets(points: DataFrame, declared25: str, declared50: str, x: str = "x", y: str = "y", system: int = MILITARY, cells: str | None = None) -> DataFrame:
    """The checked points (row_id, x, y, m, p) with number_suspect, fix and confidence (verificar where nothing is proposed)."""
    checked = written_table(check_rows(points, declared25, declared50), "sheet-rows")
    suspect = F.lit(False)
    if cells is not None:
        spark = points.sparkSession
        centre = _boxes(sheets_25k(spark), index.SIZE_25).select("key", ((F.element_at("boxes", 1)["m0"] + F.element_at("boxes", 1)["m1"]) / 2).alias("m"), ((F.element_at("boxes", 1)["p0"] + F.element_at("boxes", 1)["p1"]) / 2).alias("p"))
        of25 = sheets_at(centre).select(F.col("key").alias("key25"), F.col("at50").alias("of50"), F.col("at50name").alias("of50name"))
        checked = checked.join(F.broadcast(of25), "key25", "left")
        own, own_name = (F.when(F.col("against") == "25", F.col(a)).otherwise(F.col(b)) for a, b in (("of50", "key50"), ("of50name", "name50")))
        suspect = (F.col("sheet_status") == "off") & F.coalesce(F.col("at50") != own, F.lit(False)) & row_names(F.col(cells), F.col("at50name")) & ~row_names(F.col(cells), own_name)
    checked = checked.withColumn("number_suspect", suspect)
    wrong = checked.where("sheet_status = 'off' and not number_suspect").where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fixes = propose_fix(wrong.select("row_id", F.col(x).alias("x"), F.col(y).alias("y"), "boxes", "distance_km"), "x", "y", system)
    out = checked.join(fixes, "row_id", "left").drop("boxes", "of50", "of50name")
    return out.withColumn("confidence", F.coalesce("confidence", F.when(F.col("sheet_status") == "off", "verificar")))


def review_parts(checked: DataFrame) -> dict[str, DataFrame]:
    """Sure fixes are questions to ask; the rest are lists to look through."""
    return {"questions": checked.where("confidence = 'alta'"), "digits": checked.where("confidence = 'media'"), "numbers": checked.where("number_suspect"), "others": checked.where("confidence = 'verificar' and not number_suspect")}


def needs_review(status: Column, sheet: Column | None = None) -> Column:
    return (status != "ok") | (sheet.isin("fix", "check", "azores") if sheet is not None else F.lit(False))


def distinct_sheets(located: DataFrame) -> DataFrame:
    """The sheets that occur, by number and then by text."""
    return located.where("at25 is not null").select("at25").distinct().orderBy(F.regexp_extract("at25", "^([0-9]+)", 1).cast("int"), "at25")


def sheet_columns_guess(tables: DataFrame, headers: DataFrame, located: DataFrame) -> DataFrame:
    """The columns that name the points' own sheets: source_id, col25, col50; the points are located rows (source_id, row_id, at25, at50).

    A column counts if three values or more are sheets and at least half of them, and three, are the point's own; of equals the one named like a sheet.
    """
    cells = tables.select("source_id", "row_id", F.posexplode("cells").alias("i", "cell")).where(~blank(F.col("cell")))
    met = cells.join(located.select("source_id", "row_id", "at25", "at50"), ["source_id", "row_id"])
    alias = F.create_map(*(F.lit(x) for pair in index.ALIASES_50.items() for x in pair))
    k25, k50 = sheet_key_25k(F.col("cell")), sheet_key_50k(F.col("cell"))
    rates = met.select("source_id", "i", "at25", "at50", k25.alias("k25"), F.coalesce(alias[k50], k50).alias("k50")).groupBy("source_id", "i").agg(*(f for s in ("25", "50") for f in (F.count(f"k{s}").alias(f"given{s}"), F.count_if(F.col(f"k{s}") == F.col(f"at{s}")).alias(f"agree{s}"))))
    named = headers.select("source_id", F.posexplode("names").alias("i", "name"))
    rates = rates.join(named, ["source_id", "i"])
    best = []
    for s, like in (("25", "(?i)folha|sheet|carta|25"), ("50", "(?i)folha|sheet|carta|50")):
        share = F.col(f"agree{s}") / F.col(f"given{s}")
        good = F.when((F.col(f"given{s}") >= 3) & (F.col(f"agree{s}") >= 3) & (share >= 0.5), F.struct(share.alias("share"), F.col("name").rlike(like).alias("like"), -F.col("i")))
        best.append(F.max_by(F.when(good.isNotNull(), F.col("i")), good).alias(f"col{s}"))
    found = rates.groupBy("source_id").agg(*best)
    return found.select("source_id", "col25", F.when(F.col("col50").eqNullSafe(F.col("col25")), None).otherwise(F.col("col50")).alias("col50"))


def written(value: Column, scale: float = 1.0) -> Column:
    """Metres in the file's own unit, to three decimals."""
    return F.rint(value / scale * 1000) / 1000


def sentence() -> Column:
    """What a checked row says."""
    kinds = {"swap": "the two values are exchanged", "origin": "the false origin was left out", "digit": "one digit looks wrong"}
    told = reduce(lambda w, kv: w.when(F.col("fix.kind") == kv[0], kv[1]), kinds.items(), F.when(F.col("number_suspect"), "the sheet's number looks wrong"))
    where = F.format_string("%.1f km off the sheet", "distance_km")
    return F.when(F.col("sheet_status") == "ok", "in its sheet").when(F.col("sheet_status") == "off", F.concat_ws(": ", where, told)).when(F.col("sheet_status") == "none", "no place").otherwise("no known sheet")


def labels(*columns: str) -> Column:
    """One or two columns as a label."""
    return F.concat_ws(" · ", *(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))
