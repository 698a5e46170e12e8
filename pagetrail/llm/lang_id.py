"""Language identification with a byte convolutional network trained in numpy.

The network reads windows of ``WINDOW`` bytes: every byte is embedded, filters
of several widths slide over the window, their responses are max-pooled and a
softmax layer gives one probability per language. A text's probabilities are
the means over all windows of its UTF-8 bytes (consecutive, the last one ends
with the text), so the whole text counts.

Training uses a bounded sample: about ``SAMPLE`` labelled rows in all, the same
number for every language (all rows of rarer ones), chosen by a hash of the id
over the whole table, ``PER_ROW`` windows from pseudo-random places of each
whole text. Only these windows reach the driver. The label column is used for
training alone; predictions see the text and nothing else.

Rows: a text that is null or has no letter is ``und`` with score 0; so is every
text when there is no labelled row to learn from. A null ``doc_id`` is held
out; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, utf8

WINDOW = 128
SAMPLE = 3000
PER_ROW = 6
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
EPOCHS = 6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class ByteNetwork:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 11):
        g = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        self.languages = languages
        self.emb = draw(256, EMBEDDING, scale=0.5)
        self.filters = [draw(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = draw(FILTERS * len(WIDTHS), len(languages), scale=0.1)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, *self.filters, *self.bias, self.out, self.out_bias]

    def _windows(self, x: np.ndarray, w: int) -> np.ndarray:
        """(rows, positions, w * EMBEDDING) of embedded neighbours."""
        n, length, d = x.shape
        view = np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * d), (x.strides[0], x.strides[1], x.strides[2]))
        return np.ascontiguousarray(view)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 4e-3) -> None:
        """Adam on the cross entropy; every step is written out."""
        g = np.random.Generator(np.random.PCG64(5))
        weights = self.parameters()
        m, v = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        share = np.bincount(labels, minlength=len(self.languages)).astype(np.float32)
        weight_of = (len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum())).astype(np.float32)
        step = 0
        total = max(1, epochs * ((len(labels) + batch - 1) // batch))
        for _ in range(epochs):
            order = g.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x, y = windows[pick], labels[pick]
                e = self.emb[x]
                pooled, cols, tops = [], [], []
                for w, f, b in zip(WIDTHS, self.filters, self.bias):
                    c = self._windows(e, w)
                    z = c @ f + b
                    top = z.argmax(1)
                    cols.append(c)
                    tops.append(top)
                    pooled.append(np.maximum(np.take_along_axis(z, top[:, None, :], 1)[:, 0], 0))
                h = np.concatenate(pooled, 1)
                p = _softmax(h @ self.out + self.out_bias)
                d = p
                d[np.arange(len(y)), y] -= 1
                d *= weight_of[y][:, None] / len(y)
                grads_out, grads_bias = h.T @ d, d.sum(0)
                dh = (d @ self.out.T) * (h > 0)
                demb = np.zeros_like(self.emb)
                df, db = [], []
                rows = np.arange(len(y))[:, None]
                for i, w in enumerate(WIDTHS):
                    part = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    seen = cols[i][rows, tops[i]]  # (rows, filters, w * EMBEDDING)
                    df.append(np.einsum("rfk,rf->kf", seen, part))
                    db.append(part.sum(0))
                    back = part[:, :, None] * self.filters[i].T[None]  # (rows, filters, w * EMBEDDING)
                    back = back.reshape(len(y), FILTERS, w, EMBEDDING)
                    for k in range(w):
                        np.add.at(demb, x[rows, tops[i] + k], back[:, :, k])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for j, (q, grad) in enumerate(zip(weights, [demb, *df, *db, grads_out, grads_bias])):
                    m[j] += 0.1 * (grad - m[j])
                    v[j] += 0.01 * (grad * grad - v[j])
                    q -= (now * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        """(rows, languages) for windows (rows, WINDOW) of bytes."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        flat = [f.reshape(w, EMBEDDING, FILTERS) for w, f in zip(WIDTHS, self.filters)]
        tables = [[np.ascontiguousarray(self.emb @ f[k]) for k in range(f.shape[0])] for f in flat]  # byte -> filter responses
        for at in range(0, len(windows), batch):
            x = windows[at : at + batch].astype(np.intp)
            pooled = []
            for w, table, b in zip(WIDTHS, tables, self.bias):
                z = table[0].take(x[:, : WINDOW - w + 1], axis=0)
                for k in range(1, w):
                    z += table[k].take(x[:, k : WINDOW - w + 1 + k], axis=0)
                pooled.append(np.maximum(_highest(z) + b, 0))
            out[at : at + batch] = _softmax(np.concatenate(pooled, 1) @ self.out + self.out_bias)
        return out

    def texts(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """(texts, languages): means over all windows of each text; texts without bytes have zeros."""
        size = np.diff(off)
        count = -(-size // WINDOW)
        total = np.zeros((len(size), len(self.languages)))
        ends = np.cumsum(count)
        step = 4096
        for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
            number = np.arange(lo, min(lo + step, int(ends[-1])))
            row = np.searchsorted(ends, number, "right")
            k = number - (ends[row] - count[row])
            start = np.maximum(np.minimum(k * WINDOW, size[row] - WINDOW), 0)
            at = off[row][:, None] + start[:, None] + np.arange(WINDOW)
            inside = (start[:, None] + np.arange(WINDOW)) < size[row][:, None]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
            np.add.at(total, row, self.probabilities(x))
        return total / np.maximum(count, 1)[:, None]


def _highest(z: np.ndarray) -> np.ndarray:
    """Maximum over axis 1 by halves (contiguous operands)."""
    while (n := z.shape[1]) > 1:
        top = np.maximum(z[:, : n // 2], z[:, n // 2 : n // 2 * 2])
        if n % 2:
            np.maximum(top[:, 0], z[:, -1], out=top[:, 0])
        z = top
    return z[:, 0]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, mod 4, is 2 (or there is no id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_windows(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, windows): ``PER_ROW`` byte windows of each sampled labelled row that is not held out."""
    spark = documents.sparkSession
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    # one row per language, its number of rows; the texts are not looked at a second time here
    counts = {r[0]: r[1] for r in documents.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("lang").count().collect()}
    if not counts:
        return spark.createDataFrame([], "lang string, windows array<binary>")
    each = max(1, sample // len(counts))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    body = F.encode("text", "UTF-8")
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    place = lambda i: F.pmod(F.xxhash64("doc_id", i), room).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(PER_ROW)), lambda i: F.substring(F.col("body"), place(i), F.lit(WINDOW)))
    return labelled.filter(chosen).withColumn("body", body).select("lang", cut.alias("windows"))


def fit(documents: DataFrame, sample: int = SAMPLE) -> ByteNetwork | None:
    """Train on the bounded sample; None when nothing is labelled."""
    rows = sorted(((r[0], [bytes(w) for w in r[1]]) for r in training_windows(documents, sample).collect()))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    index = {x: i for i, x in enumerate(languages)}
    pairs = [(w, index[lang]) for lang, ws in rows for w in dict.fromkeys(ws)]
    x = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (w, _) in enumerate(pairs):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    network = ByteNetwork(languages)
    if len(languages) > 1:
        network.train(x, np.array([y for _, y in pairs]))
    return network


def predict(documents: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``documents`` with lang_pred, score and margin (how far the score is above that of the next language); columns of these names are replaced."""
    from pyspark.sql import types as T

    base = documents.drop("lang_pred", "score", "margin")
    names = base.columns
    model = documents.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    def run(batches):
        net = model.value
        for b in batches:
            text = b.column("text")
            off, data = utf8(text)
            lang, score, margin = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            if net is not None and b.num_rows:
                p = net.texts(off, data)
                best = p.argmax(1)
                ahead = p.max(1) - np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else p[:, 0]
                for i, t in enumerate(text.to_pylist()):
                    if t and _LETTER.search(t):
                        lang[i], score[i] = net.languages[best[i]], min(1.0, float(p[i, best[i]]))
                        margin[i] = ahead[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(margin)], names=[*names, "lang_pred", "score", "margin"])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])
    return in_arrow(base, run, schema)


def predictions(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    rows = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, fit(documents)).select("doc_id", "held_out", "lang_pred", "score")
