"""Quality rules: counts of each text, and a calibrated n-gram logistic regression.

The model sees hashed word 1- and 2-grams and hashed character 2-, 3- and 4-grams
(of code points) as means over a text (so a text's length does not matter). It is
trained on a bounded sample of labelled rows, ``PER_CLASS`` of either label, those
with the least hash of doc_id; a third of the sample is held back to calibrate the
probability, weighted to the label shares of the whole table. Calibration is a
logistic curve between two floors: labels that are wrong by chance keep even the
surest rows from probability 0 and 1. The sample is written once, its features are
made on the executors, and the fit runs on the driver in memory set by the bound.
Scoring maps Arrow batches without a shuffle.

Defined cases: null text is empty; labels other than 0 and 1 are left out, as are
those without a doc_id; of several labels or texts of one doc_id the fit takes one;
with no label or a single one there is no model and its probability is 1; a
probability of just the threshold keeps; a text of any length is read whole;
repeated documents each get their row; an empty table gives no row; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, least_by_hash, written
from .text import map_text, mix, raw, release, slices, spans, texts, windows, word_hashes, words

#: Labelled rows of either class that the fit may use.
PER_CLASS = 1000
THRESHOLD = 0.5
MIN_WORDS = 50
BITS = 15
TYPES = 5
_SYMBOLS = b"#*$%&|<>"
_GAPS = b" \t\n\x0b\x0c\r"
_CONT = bytes(range(0x80, 0xC0))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The contract's five counts for each row of a slice."""
    column = part.column(part.num_columns - 1)
    buf, offs = raw(column)
    starts, ends, row = words(buf, offs)
    n_rows = part.num_rows
    n_words = np.bincount(row, minlength=n_rows)
    h = word_hashes(buf, starts, ends, lower=False)
    win, first = windows(h, row, 3)
    _, back, times = np.unique(mix(win + mix(row[first].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = first[times[back] > 1] if len(first) else first
    edge = np.zeros(len(row) + 3, np.int64)
    edge += np.bincount(twice, minlength=len(edge)) - np.bincount(twice + 3, minlength=len(edge))
    repeat = np.bincount(row[np.cumsum(edge)[: len(row)] > 0], minlength=n_rows)
    chars, symbols, dups = [], [], []
    for t in texts(column):
        chars.append(len(t.translate(None, _GAPS + _CONT)))
        symbols.append(len(t) - len(t.translate(None, _SYMBOLS)))
        dups.append(_dup_lines(t))
    return {"n_words": n_words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": repeat}


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def gram_slots(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each feature type: the slots in order of place, and the offsets of the rows in them."""
    shift = np.uint64(64 - BITS)
    starts, ends, row = words(buf, offs)
    h = word_hashes(buf, starts, ends, lower=False)
    n_rows = len(offs) - 1
    out = [(h >> shift, spans(row, n_rows))]
    win, first = windows(h, row, 2)
    out.append((win >> shift, spans(row[first], n_rows)))
    code, places = _points(buf, offs)
    for n in (2, 3, 4):
        if len(code) < n:
            out.append((np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)))
            continue
        g = code[: len(code) - n + 1].copy()
        for j in range(1, n):
            g = g * np.uint32(0x01000193) + code[j : len(code) - n + 1 + j]
        slot = (g * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out.append((slot, places))
    return out


def _points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and the rows' offsets in them."""
    try:
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        return code, np.append(0, np.cumsum((buf & 0xC0) != 0x80))[offs]
    except UnicodeDecodeError:  # bytes that are no text are replaced, row by row
        rows = [np.frombuffer(buf[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))


def _sparse(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and mean values of one text."""
    ids, values = [], []
    for t, (slot, _) in enumerate(gram_slots(buf, np.array([0, len(buf)]))):
        if len(slot):
            i, n = np.unique(slot, return_counts=True)
            ids.append(i.astype(np.int64) + (t << BITS))
            values.append(n / len(slot))
    return (np.concatenate(ids), np.concatenate(values)) if ids else (np.zeros(0, np.int64), np.zeros(0))


def fit_logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, size: int, rounds: int = 120, l2: float = 1e-7) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with Adam steps on sparse entries (row, col, val)."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gw, gb = np.bincount(col, val * g[row], size) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.3 * (m / a) / (np.sqrt(v / c) + 1e-9)
        b -= 0.3 * (mb / a) / (np.sqrt(vb / c) + 1e-9)
    return w, b


#: Chances of a wrong label among bad and good rows that calibration tries.
FLOORS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.12)


def calibrated(z: np.ndarray, curve: tuple[float, float, float, float]) -> np.ndarray:
    """Probability by a logistic curve of slope and offset between a floor and a ceiling."""
    slope, offset, low, high = curve
    return low + (high - low) / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float]:
    """The likeliest curve: for each pair of floors, slope and offset by damped Newton steps with a weak prior."""
    centre, scale = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - centre) / scale, np.ones(len(z))], 1)
    weight = weight * len(weight) / weight.sum()
    best = None
    for low in FLOORS:
        for high in FLOORS:
            a = np.array([2.0, 0.0])
            for _ in range(25):
                s = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
                q = np.clip(low + (1 - high - low) * s, 1e-6, 1 - 1e-6)
                d = (1 - high - low) * s * (1 - s)
                grad = x.T @ (weight * (q - y) * d / (q * (1 - q))) + 0.02 * (a - [2, 0])
                hess = (x * (weight * d * d / (q * (1 - q)))[:, None]).T @ x + 0.02 * np.eye(2)
                a = a - np.clip(np.linalg.solve(hess, grad), -1, 1)
            q = np.clip(low + (1 - high - low) / (1 + np.exp(-np.clip(x @ a, -30, 30))), 1e-6, 1 - 1e-6)
            fit = float((weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()) - 0.01 * float(((a - [2, 0]) ** 2).sum())
            if best is None or fit > best[0] + 1e-9:
                best = fit, (float(a[0] / scale), float(a[1] - a[0] * centre / scale), low, 1 - high)
    return best[1]


Model = tuple[np.ndarray, float, tuple[float, float, float, float]]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Weights (a row for each feature type), offset and calibration curve; None without both labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    shares = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(shares) < 2:
        return None
    picked = [least_by_hash(known.where(F.col("y") == c), "doc_id", per_class, shares[c]) for c in (0, 1)]
    picked = picked[0].union(picked[1])
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = written(found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")), "quality")

    def features(batches):
        for batch in batches:
            column = batch.column(2)
            for i in range(batch.num_rows):
                buf, _ = raw(column.slice(i, 1))
                ids, values = _sparse(buf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], ["doc_id", "y", "ids", "vals"])

    got = sample.mapInArrow(features, "doc_id long, y int, ids binary, vals binary").toArrow()
    discard(sample)
    doc, y = got["doc_id"].to_numpy(), got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x.as_buffer()) // 4 for x in got["ids"]])
    col = np.frombuffer(b"".join(x.as_buffer() for x in got["ids"]), np.int32)
    val = np.frombuffer(b"".join(x.as_buffer() for x in got["vals"]), np.float32)
    del got
    back = mix(doc.astype(np.uint64)) % np.uint64(3) == 0
    if min(y[~back].sum(), (1 - y[~back]).sum(), y[back].sum(), (1 - y[back]).sum()) < 1:
        back = np.zeros(len(y), bool)  # too few rows to hold any back
    used = ~back[row]
    place = np.cumsum(~back) - 1
    w, b = fit_logistic(place[row[used]].astype(np.int32), col[used], val[used], y[~back], TYPES << BITS)
    cal = back if back.any() else ~back
    z = (np.bincount(row, val * w[col], len(y)) + b)[cal]
    del row, col, val, used
    release()
    yc = y[cal]
    share = {c: shares[c] / sum(shares.values()) / max(1e-9, (yc == c).mean()) for c in (0, 1)}
    return w.reshape(TYPES, -1), float(b), calibrate(z, yc, np.where(yc == 1, share[1], share[0]))


def probabilities(part_text: pa.Array, model) -> np.ndarray:
    buf, offs = raw(part_text)
    if model is None:
        return np.ones(len(offs) - 1)
    w, b, curve = model
    z = np.full(len(offs) - 1, float(b))
    for t, (slot, at) in enumerate(gram_slots(buf, offs)):
        n = t if t >= 2 else 1
        upto = np.concatenate([[0.0], np.cumsum(w[t][slot])])
        lo = at[:-1]
        hi = at[1:] if t < 2 else np.maximum(lo, at[1:] - n + 1)
        lo, hi = np.minimum(lo, len(slot)), np.minimum(hi, len(slot))
        z += (upto[hi] - upto[lo]) / np.maximum(1, hi - lo)
    return calibrated(z, curve)


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the probability of good quality, a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(part):
            base = base_counts(part)
            prob = probabilities(part.column(1), shared.value)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            return {"doc_id": part.column(0), **{k: pa.array(v, pa.int64()) for k, v in base.items()}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (prob >= threshold)), "probability": pa.array(prob)}

        return step

    return map_text(docs, ["doc_id", "text"], make, f"doc_id long, {COUNTS}, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, columns as they came; decided where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(text: pa.Array) -> pa.Array:
        keep = [np.zeros(0, bool)]
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"])):
            base = base_counts(part)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            keep.append(~failed & (probabilities(part.column(0), shared.value) >= threshold))
        return pa.array(np.concatenate(keep))

    return docs.where(F.arrow_udf(good, "boolean")(docs["text"]))
