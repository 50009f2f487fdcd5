"""N-gram Jaccard join with skipping by set relations.

A document's set is its distinct word shingles, as 64-bit hashes. Documents of equal sets
form a class and answer alike; one set stands for a class.

First, sets are skipped whole. A link needs three quarters of a set's tokens in another
class. One shuffle of 32-bit fingerprints counts for each class the tokens that other
classes have; a class with fewer than that is done. Tokens that many classes of a task
share travel once, so a common token costs a row a task. Fingerprints that meet by chance,
and copies in several tasks, only let a class pass. What remains is written as a table of
sets, counted again without either error, and all further steps read that table only.

Then index lists are skipped by position. Tokens are ordered by how many of the remaining
classes have them; a set of n is indexed by its first n - ceil(3n/4) + 1 tokens, of which
those no other class has need no entry. Lists are split into blocks by size.

Answers are derived before they are computed. In each of ``TURNS`` rounds a class meets the
leaders of at most ``MEET`` of its lists, in blocks whose bounds move from round to round; the
leader is the class with the least tokens of its own, or any by turns. Classes found linked
share a component from then on, and no pair inside a component is looked at again. Then the
blocks that still hold different components meet: a pair of blocks
is skipped when the least positions in it leave too few tokens for the threshold, a pair of
entries by its own positions and sizes, and the rest is verified exactly.

That gives the components; every link lies inside one. A component's classes are counted in
cells, two blocks of classes of fitting sizes each. A cell's common core, the tokens of most
of its classes, leads: overlap with it is taken once, and each class's answers are derived
from it by what the classes lack of the core and have besides. All pairs of fitting sizes
are answered exactly, none is made a row.

Null and empty texts have no set and link with nothing. Documents without id take no part
and get no component nor count. Rows of one id are one document. A text's length is bounded
by what a row can hold; its set is one row. Other columns are ignored, whatever their names.
Empty tables give no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm import text as tx
from coordspark.llm.components import components
from coordspark.llm.tables import discard, written

#: Bits of the filter of ids whose sets are read again; 8 MB to each task at any size.
BITS = 1 << 26
SHINGLE = 5
#: The most leaders that are called heavy; each has over 1/HEAVY of all pairs.
HEAVY = 1000
#: Rounds of meeting leaders, and the lists of which a class meets the leader in each.
TURNS, MEET = 3, 3
#: Tokens a task gathers before it sends their fingerprints, bytes of text to a part of them, and parts that a task takes one after the other.
GATHER, PART_BYTES, PARTS = 1 << 19, 2 << 20, 16


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    _, _, hashes, at = tx.words(buf, offsets, tx.LOWER_KEYS)
    grams, begin = tx.windows(hashes, at, SHINGLE)
    out = []
    for k in range(len(offsets) - 1):
        n = at[k + 1] - at[k]
        if n >= SHINGLE:
            out.append(np.unique(grams[begin[k] : begin[k + 1]]))
        else:
            out.append(tx.sequence_hash(hashes[at[k] : at[k + 1]]) if n else np.zeros(0, tx.U))
    return out


def _all_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    buf, offsets = tx.buffers(texts)
    for a, b in tx.pieces(offsets):
        yield from shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    """A class's number in counts; never 0, which stands for many classes."""
    return int.from_bytes(digest[:8], "little") | 1


def _digests(texts: pa.Array) -> pa.Array:
    n, digest, key = [], [], []
    for s in _all_sets(texts):
        n.append(len(s))
        digest.append(_digest(s) if len(s) else None)
        key.append(_key(digest[-1]) if len(s) else 0)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(np.array(key, tx.U).view(np.int64))], ["n", "digest", "key"])


FINGERPRINTS = "part int, tokens binary, keys binary, lens binary"


def _sent(sets: dict[int, np.ndarray], parts: int) -> pa.RecordBatch:
    """The fingerprints of some classes' tokens by partition; what the classes share among themselves is counted here."""
    keys = np.fromiter(sets, tx.U, len(sets))
    sizes = np.array([len(s) for s in sets.values()])
    tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    count = np.diff(np.append(np.flatnonzero(first), len(ranked)))
    many = np.empty(len(tokens), bool)
    many[order] = np.repeat(count > 1, count)
    here = np.bincount(owner[many], minlength=len(keys)).astype(np.uint32)
    common = ranked[first][count > 1]
    rows = [(0, b"", keys[here > 0].tobytes(), here[here > 0].tobytes())]
    # a common token is sent once, as one of many classes
    tokens, keys_of = np.concatenate([tokens[~many], common]), np.concatenate([keys[owner[~many]], np.zeros(len(common), tx.U)])
    part = (tokens & tx.U(0xFFFFFFFF)) % tx.U(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=tx.U))
    prints, keys_of = (tokens[order] >> tx.U(32)).astype(np.uint32), keys_of[order]
    for k in range(parts):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            run = np.flatnonzero(np.append(True, keys_of[a + 1 : b] != keys_of[a : b - 1]))
            rows.append((k, prints[a:b].tobytes(), keys_of[a:b][run].tobytes(), np.diff(np.append(run, b - a)).astype(np.uint32).tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "tokens", "keys", "lens"])


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _met(prints: list[bytes], keys: list[bytes], lens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each class, how many of its fingerprints other classes have."""
    token, key = np.frombuffer(b"".join(prints), np.uint32), np.frombuffer(b"".join(keys), tx.U)
    known, row = np.unique(key, return_inverse=True)
    row = np.repeat(row.astype(np.uint32), np.frombuffer(b"".join(lens), np.uint32))
    pair = np.unique(token.astype(tx.U) << tx.U(32) | row)
    t, r = (pair >> tx.U(32)).astype(np.uint32), (pair & tx.U(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))) if len(t) else np.zeros(0, np.int64)
    total = np.bincount(r[np.repeat(size > 1, size)], minlength=len(known))
    some = (total > 0) & (known != 0)
    return known[some], total[some]


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's parts, added up by class before they are sent on."""
    part, held, found, size = None, ([], [], []), [], 0

    def added() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return _counted(keys, np.bincount(at, np.concatenate([n for _, n in found]), len(keys)))

    for batch in batches:
        for here, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not row[0]:  # counted where it was gathered
                found.append((np.frombuffer(row[1], tx.U), np.frombuffer(row[2], np.uint32)))
            else:
                if here != part:
                    found.append(_met(*held))
                    size += len(found[-1][0])
                    part, held = here, ([], [], [])
                    if size > GATHER:
                        yield added()
                        found, size = [], 0
                for one, more in zip(held, row, strict=True):
                    one.append(more)
    found.append(_met(*held))
    yield added()


def shared_tokens(docs: DataFrame) -> DataFrame:
    """For classes of the texts, how many of their tokens other classes have too, or more: key, shared."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, size // PART_BYTES))
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, parts // PARTS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for batch in batches:
            for s in _all_sets(batch.column(0)):
                if len(s):
                    key = _key(_digest(s))
                    held += 0 if key in sets else len(s)
                    sets[key] = s
                if held > GATHER:
                    yield _sent(sets, parts)
                    sets, held = {}, 0
        if sets:
            yield _sent(sets, parts)

    blobs = docs.where("id is not null").select("text").mapInArrow(sent, FINGERPRINTS).repartition(tasks, "part").sortWithinPartitions("part")
    return blobs.mapInArrow(_meeting, "key long, n long").groupBy("key").agg(F.sum("n").alias("shared"))


def _rows(ids: list[int], digests: list[bytes], tokens: list[np.ndarray]) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, tx.U), *tokens]).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "digest", "tokens"])


def _listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Id, digest and set, in batches of bounded size; empty sets are left out."""
    ids, digests, kept, size = [], [], [], 0
    for id_, s in zip(batch.column(0).to_pylist(), _all_sets(batch.column(1)), strict=True):
        if len(s):
            ids.append(id_)
            digests.append(_digest(s))
            kept.append(s)
            size += len(s)
            if size > 1 << 18:
                yield _rows(ids, digests, kept)
                ids, digests, kept, size = [], [], [], 0
    if ids:
        yield _rows(ids, digests, kept)


def named_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of the classes (id, digest): id, digest, n, tokens, one row each. Texts of other ids are passed over by a filter of fixed size."""
    slot = classes.select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(BITS >> 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            s = batch.column(2).to_numpy()
            yield from _listed(batch.filter(pa.array((filled[s >> 6] >> (s & 63)) & 1 == 1)))

    keyed = docs.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("s"))
    found = keyed.mapInArrow(some, "id long, digest binary, tokens array<long>")
    return found.join(classes.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("id", "digest", F.size("tokens").alias("n"), "tokens")


def index(sets: DataFrame) -> DataFrame:
    """The entries of sets that can link at all: token, id, n, pos, left (further entries of the set), alone (tokens of no other class)."""
    each = sets.select("id", "digest", "n", F.explode("tokens").alias("token"))
    often = written(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-tokens")
    lists = each.join(often, "token").groupBy("id", "digest").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # a set's own tokens
    first = F.col("n") - F.ceil(F.col("n") * 3 / 4).cast("int") + 1
    alone = F.col("n") - F.size("t")  # tokens of no other class come first and need no entry
    some = lists.where((4 * F.size("t") >= 3 * F.col("n")) & (first > alone)).select("id", "n", alone.alias("alone"), F.slice("t", F.lit(1), first - alone).alias("t"))
    entries = some.select("id", "n", "alone", F.size("t").alias("m"), F.posexplode("t").alias("k", "x"))
    made = written(entries.select("x.token", "id", "n", (F.col("alone") + F.col("k")).alias("pos"), (F.col("m") - F.col("k")).alias("left"), "alone"), "jaccard-index")
    discard(often)
    return made


def _may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Sizes fit, and what is left of the two sets after so many tokens can hold 3/7 of both."""
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(n - pos, m - at) >= 3 * (n + m))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; an id in very many pairs is spread over salts."""
    pairs = written(pairs.where("a <> b").distinct(), "jaccard-pairs")
    total = pairs.count()
    if not total:
        return pairs
    sets = sets.select("id", "tokens")
    share = max(64, total // HEAVY)
    heavy = F.broadcast(pairs.groupBy("b").count().where(F.col("count") > share).select(F.col("b"), F.ceil(F.col("count") / share).cast("int").alias("k")))  # at most HEAVY rows
    salted = pairs.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("k", F.lit(1))).alias("salt"))
    right = sets.join(heavy.withColumnRenamed("b", "id"), "id", "left").select(F.col("id").alias("b"), F.col("tokens").alias("sb"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)).cast("long") - 1)).alias("salt"))
    both = salted.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("sa")), "a").join(right, ["b", "salt"])
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    found = written(shared.where("100 * i >= 75 * (sum - i)").select("a", "b"), "jaccard-links")
    discard(pairs)
    return found


#: About as many tokens are in a block of a component's classes; a cell meets two blocks.
CELL_TOKENS = 1 << 19
CELL = ("component", "lo", "up", "i", "j")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left set, the sizes of its intersections with all right sets."""
    m = len(right)
    if m <= 3:
        for x in left:
            yield np.array([len(np.intersect1d(x, y, assume_unique=True)) for y in right])
        return
    known, at = np.unique(np.concatenate(right), return_inverse=True)
    order = np.argsort(at, kind="stable")
    having, df = np.repeat(np.arange(m), [len(y) for y in right])[order], np.bincount(at)
    core = 2 * df > m
    lacking = [np.setdiff1d(np.arange(m), having[e - n : e], assume_unique=True) for e, n in zip(np.cumsum(df)[core], df[core], strict=True)]
    rare = having[np.repeat(~core, df)]
    flat, size = np.concatenate([rare, *lacking]), np.where(core, m - df, df)  # who has another token, then who lacks a core token
    first = np.empty(len(df), np.int64)
    first[~core] = np.cumsum(size[~core]) - size[~core]
    first[core] = len(rare) + np.cumsum(size[core]) - size[core]

    def listed(p: np.ndarray) -> np.ndarray:
        n = size[p]
        return np.bincount(flat[np.repeat(first[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=m)

    for x in left:
        p = np.minimum(np.searchsorted(known, x), len(known) - 1)
        p = p[known[p] == x]
        common = core[p]
        yield common.sum() + listed(p[~common]) - listed(p[common])


def _cell(rows: dict[bytes, tuple]) -> list[tuple[bytes, int, bytes | None]]:
    """Digest and linked documents of a cell's classes, then a row (digest, 0, other) for each link to a marked class."""
    keys = list(rows)
    a = [k for k in keys if rows[k][0]]
    b = [k for k in keys if not rows[k][0]]
    own = all(rows[k][4] for k in keys)  # a block with itself
    if own:
        b = a
    if not a or not b:
        return []
    n, w, marked = (np.array([rows[k][f] for k in b]) for f in (1, 2, 3))
    total, sums, pairs = np.zeros(len(b), np.int64), {}, []
    for k, (x, i) in enumerate(zip(a, overlaps([rows[x][5] for x in a], [rows[y][5] for y in b]), strict=True)):
        linked = 100 * i >= 75 * (rows[x][1] + n - i)
        if own:
            linked[k] = False
        else:
            total += linked * rows[x][2]
        sums[x] = int(w[linked].sum())
        pairs += [(x, 0, b[j]) for j in np.flatnonzero(linked & marked)]
        if rows[x][3] and not own:
            pairs += [(b[j], 0, x) for j in np.flatnonzero(linked)]
    if not own:
        sums |= {y: int(t) for y, t in zip(b, total, strict=True)}
    return [(k, v, None) for k, v in sums.items() if v] + pairs


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows = None, {}

    def found() -> Iterator[pa.RecordBatch]:
        out = _cell(rows) if len(rows) > 1 else []
        for k in range(0, len(out), 1 << 16):
            d, n, o = zip(*out[k : k + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(o, pa.binary())], ["digest", "links", "other"])

    for batch in batches:
        tokens = batch.column("tokens")
        values, at = tokens.values.to_numpy(zero_copy_only=False).view(tx.U), tokens.offsets.to_numpy()
        *cell, digest, left, weight, marked = (batch.column(c).to_pylist() for c in (*CELL, "digest", "left", "w", "marked"))
        for k, here in enumerate(zip(*cell, strict=True)):
            if here != key:
                yield from found()
                key, rows = here, {}
            mine = values[at[k] : at[k + 1]]
            rows[digest[k]] = (left[k], len(mine), weight[k], marked[k], not here[2] and here[3] == here[4], mine.copy())
    yield from found()


def link_counts(classes: DataFrame, sets: DataFrame, block: int = CELL_TOKENS) -> DataFrame:
    """Links of classes (digest, n, w, marked, component): digest, links in documents of weight w, other where a link to a marked class is named."""
    sized = classes.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int"))
    units = sized.groupBy("component", "s").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / block).cast("int").alias("nb"))
    units = written(units, "jaccard-units")
    side = lambda name, by: units.select("component", (F.col("s") + by).alias("s"), F.col("nb").alias(name))
    units_ = units.join(side("up_nb", -1), ["component", "s"], "left").join(side("down_nb", 1), ["component", "s"], "left")
    placed = sized.join(units_, ["component", "s"]).withColumn("k", F.pmod(F.xxhash64("digest"), F.col("nb").cast("long")).cast("int"))
    none = "cast(array() as array<struct<lo:int,up:int,i:int,j:int,left:boolean>>)"
    cells = F.expr(f"""concat(
        if(m > 1, transform(sequence(0, nb - 1), x -> named_struct('lo', s, 'up', 0, 'i', least(k, x), 'j', greatest(k, x), 'left', k <= x)), {none}),
        if(up_nb > 0, transform(sequence(0, up_nb - 1), x -> named_struct('lo', s, 'up', 1, 'i', k, 'j', x, 'left', true)), {none}),
        if(down_nb > 0, transform(sequence(0, down_nb - 1), x -> named_struct('lo', s - 1, 'up', 1, 'i', x, 'j', k, 'left', false)), {none}))""")
    placed = placed.select("digest", "component", "w", "marked", cells.alias("cells")).where("size(cells) > 0")
    both = placed.join(sets.select("digest", "tokens"), "digest").select("component", "digest", "w", "marked", "tokens", F.explode("cells").alias("c"))
    both = both.select("component", "c.lo", "c.up", "c.i", "c.j", "digest", "c.left", "w", "marked", "tokens")
    found = both.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_cells, "digest binary, links long, other binary")
    found = written(found, "jaccard-counts")
    discard(units)
    return found


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("comp", F.col("id"))
    known = labels.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return entries.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _sized(n: Column, turn: int) -> Column:
    """A size's block: sizes that can link lie in one or in two blocks that meet. Bounds move by a third of a block a turn."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3)) + turn / TURNS).cast("int")


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of the sets, enough of them to connect whatever is connected."""
    live = index(sets)
    found: list[DataFrame] = []
    labels = None
    for turn in range(TURNS):
        here = _labelled(live, labels).withColumn("block", _sized(F.col("n"), turn))
        here = written(here, "jaccard-live") if labels is not None else here
        # of near copies the one with the least of its own is nearest to all others
        own = F.col("alone") / F.col("n") if turn % 2 == 0 else F.lit(0.0)
        best = F.min_by(F.struct("id", "n", "alone", "comp"), F.struct(own, F.xxhash64(F.lit(turn), "id")))
        leaders = here.groupBy("token", "block").agg(best.alias("to"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "block", "to")
        # the lists of a set's commonest indexed tokens; the list need not be the first that both are in, so its position bounds nothing, only tokens of no other class do
        met = here.where(F.col("left") <= MEET).join(leaders, ["token", "block"]).where((F.col("comp") != F.col("to.comp")) & _may_link(F.col("n"), F.col("alone"), F.col("to.n"), F.col("to.alone")))
        found.append(verified(met.select(F.col("id").alias("a"), F.col("to.id").alias("b")), sets))
        if labels is not None:
            discard(here, labels)
        labels = components(reduce(DataFrame.unionAll, found))
    here = written(_labelled(live, labels).withColumn("block", _sized(F.col("n"), 0)), "jaccard-live")
    blocks = written(here.groupBy("token", "block").agg(*(f(c).alias(name) for name, f, c in (("lo", F.min, "comp"), ("hi", F.max, "comp"), ("pos", F.min, "pos"), ("least", F.min, "n"), ("most", F.max, "n")))), "jaccard-blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    next_to = (F.col("x.token") == F.col("y.token")) & F.col("y.block").isin(F.col("x.block"), F.col("x.block") + 1)
    reach = 7 * F.least(F.col("x.most") - F.col("x.pos"), F.col("y.most") - F.col("y.pos")) >= 3 * (F.col("x.least") + F.col("y.least"))
    meet = x.join(y, next_to).where(reach & (F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi"))).select("x.token", F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    meet = written(meet, "jaccard-meet")
    a = here.join(meet, ["token", "block"]).select("token", "block", "other", "id", "n", "pos", "comp").alias("a")
    b = here.withColumnRenamed("block", "other").alias("b")
    near = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.other") == F.col("b.other")))
    ordered = (F.col("a.block") < F.col("a.other")) | (F.col("a.id") < F.col("b.id"))
    near = near.where(ordered & (F.col("a.comp") != F.col("b.comp")) & _may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
    found.append(verified(near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), sets))
    discard(live, here, blocks, meet, labels)
    out = written(reduce(DataFrame.unionAll, found).distinct(), "jaccard-links")
    discard(*found)
    return out


def join(docs: DataFrame, with_links: bool = True) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and unless left out n_links, how many other documents it is linked with."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    light = docs.select("doc_id", F.arrow_udf(_digests, "n long, digest binary, key long")("text").alias("s")).select("doc_id", "s.*")
    light = written(light, "jaccard-digests")
    has = light.where("digest is not null and doc_id is not null")
    classes = written(has.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("n").alias("size"), F.min("key").alias("key")), "jaccard-classes")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    some = classes.join(shared_tokens(texts), "key").where("4 * shared >= 3 * size").select("id", "digest")
    some = written(some, "jaccard-some")
    sets = written(named_sets(texts, some), "jaccard-sets")
    # an id given to several texts joins their classes
    same = has.join(classes, "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    ids = has.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    twice = ids.where("lo <> hi").select(F.col("doc_id").alias("a"))
    linked = links(sets)
    edges = linked.unionAll(same.join(twice, "a", "left_semi"))
    labels = components(edges).withColumnRenamed("node", "id")
    # an id that leads several classes joins them in no edge: its label is its own
    known = classes.drop("key").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")]
    rest = light.drop("key").where("digest is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if not with_links:
        return has.join(known.drop("size"), "digest").select(*columns).unionAll(rest)
    # ids of one text are counted by class, ids of several by name
    several = written(has.join(twice.withColumnRenamed("a", "doc_id"), "doc_id", "left_semi").select("doc_id", "digest").distinct(), "jaccard-several")
    single = ids.where("lo = hi").groupBy(F.col("lo").alias("digest")).agg(F.count("*").alias("w"))
    known = known.join(single, "digest", "left").join(several.select("digest", F.lit(True).alias("marked")).distinct(), "digest", "left")
    known = written(known.select("digest", "id", F.col("size").alias("n"), F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("marked", F.lit(False)).alias("marked"), "component"), "jaccard-known")
    counts = link_counts(known.drop("id"), sets)
    by_class = counts.where("other is null").groupBy("digest").agg(F.sum("links").alias("links"))
    known = known.drop("n").join(by_class, "digest", "left").withColumn("links", F.col("w") - 1 + F.coalesce("links", F.lit(0)))
    out = has.join(known, "digest")
    if not several.isEmpty():
        near = counts.where("other is not null").select("digest", "other").unionAll(several.select("digest", F.col("digest").alias("other"))).distinct()
        to = several.select(F.col("doc_id").alias("e"), F.col("digest").alias("other"))
        # by class the ids of several texts among its neighbours; by id of several texts its neighbours of either kind
        extra = near.join(to, "other").groupBy("digest").agg(F.count_distinct("e").alias("extra"))
        reached = near.join(to, "other").select("e", "digest").distinct()
        ones = reached.join(known.select("digest", "w"), "digest").groupBy("e").agg(F.sum("w").alias("ones"))
        more = reached.join(several, "digest").where("doc_id <> e").groupBy("e").agg(F.count_distinct("doc_id").alias("more"))
        whole = ones.join(more, "e", "left").select(F.col("e").alias("doc_id"), (F.col("ones") + F.coalesce("more", F.lit(0))).alias("whole"))
        out = out.join(extra, "digest", "left").join(whole, "doc_id", "left").withColumn("links", F.coalesce("whole", F.col("links") + F.coalesce("extra", F.lit(0))))
    out = out.select(*columns, F.col("links").alias("n_links"))
    # rows without words of an id that has others are the same document
    also = out.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("n_links").alias("other_links"))
    zero = F.when(F.col("doc_id").isNotNull(), F.coalesce("other_links", F.lit(0))).cast("long")
    return out.unionAll(rest.join(also, "doc_id", "left").select("doc_id", "n_shingles", "component_id", zero.alias("n_links")))
