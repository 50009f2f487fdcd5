"""Field points with mixed notations, derived from order keys by integer arithmetic.

The text is SQL that Spark and DuckDB both read.
"""

from __future__ import annotations


def _whole(a: str, b: int) -> str:
    return f"CAST(({a} - {a} % {b}) / {b} AS BIGINT)"


def _text(u: str, minus: str, plus: str, negative: bool) -> str:
    """A micro-degree magnitude as one of eight notations."""
    rest = f"({u} % 1000000)"
    degrees, fraction = _whole(u, 1000000), f"lpad(CAST({rest} AS STRING), 6, '0')"
    minutes, hundredths = _whole(f"({rest} * 60)", 1000000), _whole(f"(({rest} * 60 % 1000000) * 6000)", 1000000)
    dms = f"CAST({degrees} AS STRING) || '° ' || CAST({minutes} AS STRING) || ''' ' || CAST({_whole(hundredths, 100)} AS STRING) || '.' || lpad(CAST({hundredths} % 100 AS STRING), 2, '0') || '\"'"
    sign = "'-' || " if negative else ""
    letter = minus if negative else plus
    return f"""CASE WHEN k % 29 = 0 THEN chr(8201) || {sign}CAST({degrees} AS STRING) || '.' || {fraction} || chr(12288) ELSE CASE k % 8
        WHEN 0 THEN {sign}CAST({degrees} AS STRING) || '.' || {fraction}
        WHEN 1 THEN {sign}CAST({degrees} AS STRING) || ',' || {fraction}
        WHEN 2 THEN {dms} || ' {letter}'
        WHEN 3 THEN {dms} || ' {"O" if letter == "W" else letter}'
        WHEN 4 THEN '{letter} ' || {dms}
        WHEN 5 THEN {sign}{dms}
        WHEN 6 THEN CAST({degrees} AS STRING) || '.' || {fraction} || 'º{letter}'
        ELSE CASE WHEN k % 3 = 0 THEN '' ELSE 'texto' END END END"""


def survey_sql(orders: str = "orders") -> str:
    """row_id, sample, lat_raw, lon_raw: a tenth or so reversed, some out of range."""
    return f"""
      SELECT k AS row_id, sample, CASE WHEN k % 11 = 0 THEN lon_t ELSE lat_t END AS lat_raw,
             CASE WHEN k % 11 = 0 THEN lat_t WHEN k % 17 = 0 THEN '999.5' ELSE lon_t END AS lon_raw
      FROM (SELECT k, sample, {_text("lat_u", "S", "N", False)} AS lat_t, {_text("lon_u", "W", "E", True)} AS lon_t
            FROM (SELECT o_orderkey AS k, o_orderpriority AS sample, 36850000 + o_orderkey * 7919 % 5300000 AS lat_u,
                         9550000 - o_orderkey * 104729 % 3400000 AS lon_u FROM {orders}) a) b"""


def grid_sql(supplier: str = "customer") -> str:
    """row_id, source_id, x_raw, y_raw: metres of a grid with thousands and decimals in four ways."""
    whole = lambda v: f"CAST({v} AS STRING)"
    thousands = lambda v, sep: f"{whole(_whole(v, 1000))} || '{sep}' || lpad({whole(v + ' % 1000')}, 3, '0')"
    def text(v: str) -> str:
        return f"CASE k % 4 WHEN 0 THEN {whole(v)} || '.5' WHEN 1 THEN {thousands(v, '.')} || ',5' WHEN 2 THEN {thousands(v, ',')} || '.5' ELSE {thousands(v, ' ')} || ',5' END"

    return f"""SELECT k AS row_id, s AS source_id, {text("x")} AS x_raw, {text("y")} AS y_raw, x + 0.5 AS x, y + 0.5 AS y
      FROM (SELECT c_custkey AS k, c_mktsegment AS s, 80000 + c_custkey * 7919 % 260000 AS x, 10000 + c_custkey * 104729 % 540000 AS y FROM {supplier}) a"""


def notebook_sql(customer: str = "customer") -> str:
    """row_id, source_id, lat_raw, lon_raw: magnitudes without signs of a southern survey, one in nine with its letter."""
    return f"""SELECT c_custkey AS row_id, c_mktsegment AS source_id,
      CAST({_whole("(11000 + c_custkey * 7919 % 15000)", 1000)} AS STRING) || '.' || lpad(CAST((11000 + c_custkey * 7919 % 15000) % 1000 AS STRING), 3, '0') || CASE WHEN c_custkey % 9 = 0 THEN ' S' ELSE '' END AS lat_raw,
      CAST({_whole("(31000 + c_custkey * 104729 % 9000)", 1000)} AS STRING) || '.' || lpad(CAST((31000 + c_custkey * 104729 % 9000) % 1000 AS STRING), 3, '0') AS lon_raw FROM {customer}"""


def field_book_sql(customer: str = "customer") -> str:
    """source_id, k and the cells of a field book: angles whose seconds marks are quotes, notes with quotes, separators and line ends."""
    note = "CASE k % 5 WHEN 0 THEN 'a \"b\"; c' WHEN 1 THEN 'x' || chr(10) || chr(10) || 'y' WHEN 2 THEN '' WHEN 3 THEN 'm\"n' ELSE chr(13) || chr(10) || ';' END"

    def angle(u: str) -> str:
        return f"CAST({u} % 80 AS STRING) || '° ' || CAST({u} % 60 AS STRING) || ''' ' || CAST({u} % 59 AS STRING) || '\"'"

    return f"""SELECT c_mktsegment AS source_id, k, CAST(k AS STRING) AS n, {angle('k * 7919')} AS lat, {angle('k * 104729')} || ' W' AS lon, {note} AS note
      FROM (SELECT c_custkey AS k, c_mktsegment FROM {customer}) a"""


#: Sub-grids of a made-up grid of shifts: name, parent, south and east in degrees (east to the west), step in seconds, rows, columns.
SUB_GRIDS = (("COARSE", "NONE", 37.0, 6.5, 900.0, 17, 11), ("FINE", "COARSE", 38.0, 8.0, 180.0, 21, 21))


def node_shift(i, j, axis: int):
    """The shift of a node in seconds, as a short float; for arrays and SQL alike."""
    a, b = ((7, 3), (5, 11))[axis]
    return f"CAST(CAST((({i}) * {a} + ({j}) * {b}) % 32 AS DOUBLE) / 7 - 2 AS REAL)::DOUBLE" if isinstance(i, str) else (i * a + j * b) % 32 / 7 - 2


def raw_book_sql(customer: str = "customer") -> str:
    """source_id, row_id, cells of tables without a header: a title, a row of names, angles in three cells, empty rows and an empty column."""
    data = "array('', CAST(k AS STRING), CAST(k % 80 AS STRING), CAST(k * 7 % 60 AS STRING), CAST(k * 11 % 60 AS STRING) || ',5')"
    return f"""SELECT c_mktsegment AS source_id, k AS row_id, CASE WHEN k % 13 = 0 THEN array('', ' ', '', 'nan', '') ELSE {data} END AS cells FROM (SELECT c_custkey AS k, c_mktsegment FROM {customer}) a
      UNION ALL SELECT DISTINCT c_mktsegment, CAST(-2 AS BIGINT), array('', 'Campanha ' || c_mktsegment, '', '', '') FROM {customer}
      UNION ALL SELECT DISTINCT c_mktsegment, CAST(-1 AS BIGINT), array('', 'Ponto', 'Latitude', '', '') FROM {customer}"""
