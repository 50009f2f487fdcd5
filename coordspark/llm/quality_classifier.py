"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

Texts are cut into overlapping chunks that cover every byte. Learned filters of four
bytes slide over each chunk, each filter's largest response is the chunk's feature,
and the largest and the mean of a document's chunk features give one probability.

Training takes whole texts: at most ``most_rows`` labelled rows (those of smallest hash),
and fewer where their texts would pass ``most_bytes``; that bounds what the driver receives.
The first row is always taken, and the one that would pass the bound ends the sample.
Scoring reads whole texts. Null and empty texts have no chunk and get the score of
zero features; rows whose labels disagree or are null aren't learned from. Without
any label the score is 0.5 everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm import text as tx
from coordspark.llm.tables import bounded

WIDTH, FILTERS = 4, 16
CHUNK, STEP = 256, 224
#: Bounds of the training sample: rows, and bytes of their texts.
MOST_ROWS, MOST_BYTES = 4000, 1 << 25


@dataclass
class Network:
    """table: byte x position x filter; bias of filters; weights of the largest and mean features, and their bias."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters' responses to each pair of bytes, for the first and the last two positions."""
        t = self.table
        return tuple((t[:, k][:, None, :] + t[:, k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in (0, 2))


def chunk_spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of overlapping chunks that cover each text."""
    length = np.diff(offsets)
    count = np.where(length > 0, 1 + np.maximum(0, -(-(length - CHUNK) // STEP)), 0)
    text = np.repeat(np.arange(len(length)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[text] + k * STEP
    return starts, np.minimum(starts + CHUNK, offsets[text + 1]), text


def chunk_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, net: Network, pairs: tuple) -> np.ndarray:
    """The largest response of each filter in each chunk; a chunk is followed by three zero bytes."""
    out = np.empty((len(starts), FILTERS), np.float32)
    room = 512
    for a in range(0, len(starts), room):
        s, e = starts[a : a + room], ends[a : a + room]
        grid = s[:, None] + np.arange(CHUNK + WIDTH - 1)
        inside = grid < e[:, None]
        data = np.where(inside, buf[np.minimum(grid, len(buf) - 1)], 0).astype(np.uint16)
        code = data[:, :-1] * np.uint16(256) + data[:, 1:]
        seen = pairs[0][code[:, : CHUNK]] + pairs[1][code[:, 2 : CHUNK + 2]]
        if not inside[:, :CHUNK].all():
            seen[~inside[:, :CHUNK]] = -np.inf
        out[a : a + room] = seen.max(1)
    return np.maximum(out + net.bias.astype(np.float32), 0)


def document_scores(buf: np.ndarray, offsets: np.ndarray, net: Network, pairs: tuple) -> np.ndarray:
    n = len(offsets) - 1
    top, mean = np.zeros((n, FILTERS)), np.zeros((n, FILTERS))
    starts, ends, text = chunk_spans(offsets)
    if len(starts):
        seen = chunk_features(buf, starts, ends, net, pairs)
        begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        top[text[begin]] = np.maximum.reduceat(seen, begin)
        mean[text[begin]] = np.add.reduceat(seen.astype(np.float64), begin) / np.diff(np.append(begin, len(text)))[:, None]
    z = np.hstack([top, mean]) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[list[bytes], int]], epochs: int = 14, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the logistic loss; the gradient of a largest response goes to where it was found."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (256, WIDTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), 0.0)
    rows = [r for r in rows if r[0]]
    if not rows:
        return Network(net.table, net.bias, np.zeros(2 * FILTERS), 0.0)
    room = 512
    size = [len(r[0]) for r in rows]
    first = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros((first[-1], CHUNK + WIDTH - 1), np.uint8)
    inside = np.zeros((first[-1], CHUNK), bool)
    for k, chunk in enumerate(c for r in rows for c in r[0]):
        data[k, : len(chunk)] = np.frombuffer(chunk, np.uint8)
        inside[k, : len(chunk)] = True
    label = np.array([r[1] for r in rows], float)
    net.out_bias = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    params = [net.table, net.bias, net.out, np.array([net.out_bias])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            docs = order[a : a + 64]
            chunks = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            begin = np.concatenate([[0], np.cumsum([size[d] for d in docs])[:-1]])
            x = data[chunks]
            pair = net.pairs()
            where, pre = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS))
            for b in range(0, len(x), room):
                part = x[b : b + room]
                code = part[:, :-1].astype(np.uint16) * np.uint16(256) + part[:, 1:]
                seen = pair[0][code[:, :CHUNK]] + pair[1][code[:, 2 : CHUNK + 2]]
                seen[~inside[chunks[b : b + room]]] = -np.inf
                where[b : b + room] = seen.argmax(1)
                pre[b : b + room] = np.take_along_axis(seen, where[b : b + room][:, None, :], 1)[:, 0] + net.bias
            act = np.maximum(pre, 0)
            count = np.diff(np.append(begin, len(chunks)))
            top, mean = np.maximum.reduceat(act, begin), np.add.reduceat(act, begin) / count[:, None]
            feats = np.hstack([top, mean])
            p = 1 / (1 + np.exp(-np.clip(feats @ params[2] + params[3][0], -30, 30)))
            g = (p - label[docs]) / len(docs)
            back = g[:, None] * params[2]
            owner = np.repeat(np.arange(len(docs)), count)
            is_top = act == top[owner]
            d_act = np.where(is_top, back[owner, :FILTERS], 0) + back[owner, FILTERS:] / count[owner][:, None]
            d_act[pre <= 0] = 0
            d_table = np.zeros_like(net.table)
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            row = np.arange(len(chunks))[:, None]
            for k in range(WIDTH):
                np.add.at(d_table, (x[row, where + k], k, f), d_act)
            grads = [d_table + 1e-5 * net.table, d_act.sum(0), feats.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            lr = rate * (0.5 if epoch >= epochs * 2 // 3 else 1)
            for q, gr, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(params[0], params[1], params[2], float(params[3][0]))


def training_chunks(text: bytes) -> list[bytes]:
    """All chunks of a text."""
    starts, ends, _ = chunk_spans(np.array([0, len(text)]))
    return [text[a:b] for a, b in zip(starts, ends, strict=True)]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> list[tuple[bytes, int]]:
    """Whole texts and labels of the labelled documents whose id has the smallest hash, within both bounds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
    sample = known.select("doc_id", F.col("lo").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # most_rows rows of 12 bytes
    # of a repeated id the text of smallest hash; hashes and sizes are aggregated, not texts
    rows = found.select("doc_id", "y", "text", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("m")).select("doc_id", "m.h", "m.n")
    sizes = one.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not sizes.num_rows:
        return []
    fits = np.cumsum(sizes.column("n").to_numpy()) <= most_bytes
    fits[0] = True
    taken = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(int(fits.sum()))
    texts = rows.join(F.broadcast(taken), ["doc_id", "h", "n"]).dropDuplicates(["doc_id"])  # most_rows rows of 24 bytes
    return [((r.text or "").encode(), r.y) for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Network:
    """Learn from all chunks of the sampled documents."""
    return train([(training_chunks(t), y) for t, y in training_rows(docs, labels, label, most_rows, most_bytes)])


def score(text: Column, net: Network) -> Column:
    """The probability that the whole text is of label 1."""
    pairs = None

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        nonlocal pairs
        if pairs is None:
            pairs = net.pairs()
        buf, offsets = tx.buffers(texts)
        parts = [document_scores(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], net, pairs) for a, b in tx.pieces(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The documents with ``score`` and ``predicted`` in place of any columns of those names."""
    net = fit(docs, labels.where(~held_out(F.col("doc_id"))), most_rows=most_rows)
    return bounded(docs).withColumn("score", score(F.col("text"), net)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
