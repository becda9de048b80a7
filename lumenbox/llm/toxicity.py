"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import words
from .store import bounded_batches, extended, tidy_task

BITS = 20
#: At most this many labelled rows are fitted, those of the smallest hashes of their ids, up to so many terms in all.
FIT_ROWS, FIT_TERMS = 20_000, 12_000_000
FOLDS = 5
#: The chi-square against the label at which a term is learnt at half the full pace, and the pace of those that say nothing.
PACE, SLOWEST = 30.0, 0.02
STEMS = (4, 5)


def held_out(doc_id):
    """Whether a row is of the fold that is never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0


def features(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """For each text the sorted distinct buckets of its terms: runs of ASCII letters, digits and other bytes, lower case,
    and their first STEMS bytes, as an insult comes with many endings."""
    for a, b, data, at in words.slices(column):
        data = words.LOWER[data]
        start, end, row = words.spans(data, at, words.NOT_TERM)
        h, of = [words.hashes(data, start, end)], [row]
        for n in STEMS:
            long = end - start >= n
            h.append(words.mix(words.hashes(data, start[long], start[long] + n) ^ words.U64(n)))
            of.append(row[long])
        bucket, row = (np.concatenate(h) >> words.U64(64 - BITS)).astype(np.int64), np.concatenate(of)
        both = np.unique((row.astype(np.int64) << BITS) | bucket)
        first = np.searchsorted(both, np.arange(b - a + 1, dtype=np.int64) << BITS)
        both &= (1 << BITS) - 1
        for i in range(b - a):
            yield both[first[i] : first[i + 1]]


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the inner product of their factors)."""

    bias: float
    index: np.ndarray  #: for each bucket the row of its weight and factors, -1 for none
    weight: np.ndarray
    factors: np.ndarray
    rows: int = 0  #: fitted
    terms: int = 0  #: in those rows

    def to_row(self) -> dict[str, object]:
        bucket = np.flatnonzero(self.index >= 0)
        return {"bias": self.bias, "bucket": bucket.astype("<i4").tobytes(), "weight": self.weight.astype("<f8").tobytes(), "factors": self.factors.astype("<f8").tobytes(), "rows": self.rows, "terms": self.terms}

    @classmethod
    def from_row(cls, r: dict[str, object]) -> Machine:
        bucket, weight = np.frombuffer(r["bucket"], "<i4"), np.frombuffer(r["weight"], "<f8")
        index = np.full(1 << BITS, -1, np.int32)
        index[bucket] = np.arange(len(bucket))
        return cls(r["bias"], index, weight, np.frombuffer(r["factors"], "<f8").reshape(len(weight), -1), r["rows"], r["terms"])

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return _raw(self.bias, self.weight, self.factors, *_csr([self._known(x) for x in rows]), len(rows))[0]

    def _known(self, x: np.ndarray) -> np.ndarray:
        i = self.index[x]
        return i[i >= 0]

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in rows], np.int64)
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), sizes)


def _raw(bias: float, weight: np.ndarray, factors: np.ndarray, cols: np.ndarray, row: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = n if n is not None else (int(row[-1]) + 1 if len(row) else 0)
    out = bias + np.bincount(row, weight[cols], n)
    sums = np.empty((n, factors.shape[1]))
    for f in range(factors.shape[1]):
        v = factors[cols, f]
        sums[:, f] = np.bincount(row, v, n)
        out += 0.5 * (sums[:, f] ** 2 - np.bincount(row, v * v, n))
    return out, sums


def fit(rows: list[np.ndarray], y: np.ndarray, rank: int = 4, epochs: int = 6, rate: float = 0.3, least_rows: int = 3, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over mini-batches, with shrinkage. Every term of at least ``least_rows`` rows has a weight
    and factors: the sample alone bounds them. All are learnt, those faster that say something of the label by
    themselves (by chi-square), as most words say nothing of toxicity, and a long text holds many."""
    n, pos = len(rows), float(y.sum())
    index, terms = np.full(1 << BITS, -1, np.int32), sum(map(len, rows))
    if not n or pos == 0 or pos == n:
        rate_ = (pos + 0.5) / (n + 1)
        return Machine(float(np.log(rate_ / (1 - rate_))), index, np.zeros(1), np.zeros((1, rank)), n, terms)
    seen, with_pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for x, t in zip(rows, y, strict=True):
        seen[x] += 1  # a row's buckets are distinct
        if t:
            with_pos[x] += 1
    chosen = np.flatnonzero(seen >= least_rows)
    index[chosen] = np.arange(len(chosen))
    expected = seen[chosen] * pos / n
    chi = (with_pos[chosen] - expected) ** 2 * (1 / expected + 1 / (seen[chosen] - expected))
    pace = chi**2 / (chi**2 + PACE**2) + SLOWEST
    sizes = np.array([np.count_nonzero(index[x] >= 0) for x in rows])
    flat, begin = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
    for x, at, size in zip(rows, begin.tolist(), sizes.tolist(), strict=True):
        i = index[x]
        flat[at : at + size] = i[i >= 0]
    rng = np.random.default_rng(seed)
    m = len(chosen)
    w, v, b = np.zeros(m), rng.normal(0, 0.02, (m, rank)) * pace[:, None], float(np.log(pos / (n - pos)))
    gw, gv, gb = np.full(m, 1e-3), np.full((m, rank), 1e-2), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at : at + 256]
            r = np.repeat(np.arange(len(pick)), sizes[pick])
            c = flat[np.repeat(begin[pick] - np.cumsum(sizes[pick]) + sizes[pick], sizes[pick]) + np.arange(len(r))]
            raw, sums = _raw(b, w, v, c, r, len(pick))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
            gb += (d := g.sum()) ** 2
            b -= rate * d / np.sqrt(gb)
            each = g[r]
            of = np.bincount(c, each, m)
            u = np.flatnonzero(of)
            dw = of[u] + 1e-5 * w[u]
            gw[u] += dw**2
            w[u] -= rate * pace[u] * dw / np.sqrt(gw[u])
            for f in range(rank):
                dv = np.bincount(c, each * (sums[r, f] - v[c, f]), m)[u] + 1e-4 * v[u, f]
                gv[u, f] += dv**2
                v[u, f] -= 0.3 * rate * pace[u] * dv / np.sqrt(gv[u, f])
    return Machine(float(b), index, w if m else np.zeros(1), v if m else np.zeros((1, rank)), n, terms)


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[np.ndarray] = []
    y: list[float] = []
    for batch in batches:
        rows += [np.frombuffer(x.as_buffer(), "<i4") for x in batch["x"]]  # views of what came
        y += batch["y"].to_pylist()
    if rows:
        got = fit(rows, np.array(y, float)).to_row()
        yield pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, v), t in zip(got.items(), (pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)})


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [x.astype("<i4").tobytes() for x in features(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(got, pa.binary()), batch["y"]], ["id", "h", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_terms: int = FIT_TERMS) -> Machine:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold, in the order of the hashes of their ids, up to
    ``fit_terms`` terms in all; those bounds also bound the broadcast of the chosen labels and the one task that fits. The
    driver gets the machine: a weight and factors for each term that three rows have.

    Null ids and null labels are not learnt from, nor ids whose labels contradict each other. Of rows that repeat an id
    one is learnt from, the one with the smallest hash of its text. The machine is the same however the rows are dealt
    to partitions. Empty tables give a machine of the bias alone.
    """
    bounded_batches(docs.sparkSession)
    each = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = each.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select(F.col("id").alias("label_id"), "y")
    some = known.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.join(F.broadcast(some), rows["id"] == some["label_id"]).select("id", "h", "text", "y")
    parts = rows.mapInArrow(tidy_task(_featurize), StructType([rows.schema["id"], *_parse_datatype_string("h long, x binary, y int").fields]))
    one = parts.groupBy("id").agg(F.min(F.struct("h", "x", "y")).alias("r")).select(F.xxhash64("id").alias("at"), "id", "r.x", "r.y")  # fit_rows rows at most
    upto = F.sum(F.length("x") / 4).over(Window.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = one.withColumn("upto", upto).where(F.col("upto") <= fit_terms).coalesce(1).sortWithinPartitions("at", "id").select("x", "y")
    got = chosen.mapInArrow(tidy_task(_fit_all), "bias double, bucket binary, weight binary, factors binary, rows long, terms long").toArrow().to_pylist()
    return Machine.from_row(got[0]) if got else fit([], np.zeros(0))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The columns of ``docs``, with ``score_col`` (0 to 1) and ``predicted_col`` (1 from 0.5 on); columns of those names
    are replaced, so a caller whose table has them gives other names. Null texts count as empty and get the score of the
    bias, repeated rows equal scores; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (score_col, predicted_col)], F.col(text_col).alias("__scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = list(features(batch["__scored"]))
            s = model.score(rows) if rows else np.zeros(0)
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*keep, score_col, predicted_col])

    return base.mapInArrow(tidy_task(run), extended(base.drop("__scored"), **{score_col: "double", predicted_col: "int"}))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Null texts count as empty and get the score of the bias. A null id is never learnt from and held_out is
    false for it; repeated rows get equal scores; an empty table gives no rows. Without labels of both kinds
    the score is their share, smoothed. Nothing but the text is an input of a score; other columns are ignored.
    """
    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = score(each, train(docs, labels, id_col, text_col), "id", "text")
    return got.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")
