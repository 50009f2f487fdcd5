import csv as standard
import io
import random

import pytest
from pyspark.sql import functions as F

from coordspark.sources import csv


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda n: [spark.conf.set(name, str(n)) for name in names]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def expected(text, sep):
    """What a reader of whole texts makes of it: the standard library's, and the shape of a table."""
    rows = [r for r in standard.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=sep) if r]
    while rows and all(c == "" for c in rows[-1]):
        rows.pop()
    return [[r[i] if i < len(r) else "" for i in range(len(rows[0]))] for r in rows[1:]] if rows else []


def found(rows):
    out = {}
    for r in rows.orderBy("source_id", "row_id").collect():
        out.setdefault(r.source_id.rsplit("/", 1)[-1], []).append((r.row_id, r.cells))
    assert all([k for k, _ in v] == list(range(len(v))) for v in out.values())
    return {s: [c for _, c in v] for s, v in out.items()}


STRAY = """n;lat;lon
1;38° 43' 12";9° 8' 0" W
2;39° 0' 1";x
3;39;"a ""b""; c
d";e
"f"g"h;"";"i"
"""


def test_stray_quotes_are_signs(spark):
    for text, sep in ((STRAY, ";"), ('a,b,c\n1,38° 43\' 12" N,9° 8\' 0" W\n', ",")):
        df = spark.createDataFrame([("s", text)], "source_id string, text string")
        assert found(csv.read_texts(df, sep)[0]) == found(csv.read_texts(df)[0]) == {"s": expected(text, sep)}


def messy(rng, sep, ends):
    """Records with quotes at the start of fields and elsewhere, doubled ones, line ends inside, empty lines."""
    piece = lambda: rng.choice(["a", "é", '"', '""', "'", "12", " ", sep, "x y"])
    plain = lambda: "".join(p for p in (piece() for _ in range(rng.randrange(4))) if p != sep).lstrip('"')
    inside = lambda: "".join(rng.choice(["b", '""', sep, "\n", "\r\n", "c", " "]) for _ in range(rng.randrange(12)))
    quoted = lambda: f'"{inside()}"' + rng.choice(["", "", 'z"y', "z"])
    field = lambda: rng.choice([plain, plain, quoted])()
    lines = [sep.join(field() for _ in range(rng.randint(1, 4))) + rng.choice(ends) for _ in range(rng.randint(1, 60))]
    return "".join(x if rng.random() < 0.9 else x + rng.choice(ends) for x in lines)


@pytest.mark.parametrize("size", [16, 50, 1 << 20])
def test_splits_give_the_rows_of_the_whole(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    texts = {f"{k}.csv": messy(rng, ";", ["\n"] if k % 3 else ["\n", "\r\n", "\r"]) for k in range(14)}
    texts |= {"open.csv": 'a;b\n1;"never closed\n2;3\n', "mark.csv": '\ufeff"q;r";s\n1;2\n', "none.csv": "", "blank.csv": "\n\n\r\n", "ends.csv": "a;b\n1;2\n;\n\n;;\n", "long.csv": 'h;i\n"' + "line\n" * 40 + '";2\n3;4\n'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small_splits(size)
    got = found(csv.read(spark, str(tmp_path), ";")[0])
    assert got == {n: rows for n, t in texts.items() if (rows := expected(t, ";"))}


def test_charsets_and_separators_by_file(spark, tmp_path, small_splits):
    small_splits(24)
    cells = [["nome", "é", "n"], ["Évora", 'x"', "1"], ["Ilhéu", "y", "2"]] + [["z", "w", str(k)] for k in range(9)]
    for k, (sep, charset) in enumerate([(",", "cp1252"), (";", "utf-8-sig"), ("\t", "utf-16"), ("|", "utf-8"), (";", "utf-32")]):
        (tmp_path / f"{k}.csv").write_bytes("\n".join(sep.join(r) for r in cells).encode(charset))
    rows, heads = csv.read(spark, str(tmp_path))
    assert found(rows) == {f"{k}.csv": cells[1:] for k in range(5)}
    assert {tuple(r.names) for r in heads.collect()} == {tuple(cells[0])}


def test_a_record_without_end_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\n1;"' + "x\n" * 500)
    with pytest.raises(Exception, match="too large"):
        csv.read(spark, str(tmp_path), ";", most=300)[0].collect()


def test_a_plain_file_is_cut_without_a_shuffle_of_its_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n" + "1;2\n" * 50)
    lines = csv._lines(spark, [str(tmp_path)]).select("source_id", "at", "k", F.col("raw").cast("string").alias("line"), F.lit(";").alias("sep"), F.lit(True).alias("ended"))
    plan = csv._cut(lines, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0 and "BroadcastHashJoin" in plan
