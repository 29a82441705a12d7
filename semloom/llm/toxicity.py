"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, end of a
clause, other. Small transducers each add what they know to the events of a
clause, and their composition reads the clause once:

* the event transducer turns insults and threats into events,
* the negation transducer marks events up to ``REACH`` words after a negation,
* the reported-speech transducer marks events after a verb of saying,
* the target transducer marks events up to ``REACH`` words from a target.

The composed machine's outputs are event kinds (insult or threat, each negated or
not, reported or not, targeted or not); each kind has a weight, and a text's
score adds the weights of its matched clauses. Isolated words score through the
clause they stand in.

Insult stems are induced from labelled training rows: whole words, and prefixes
shared by several words, that stand in toxic texts beyond chance. Evidence counts
each word once per word before it, so copies of one text count once. A stem's
weight is its shrunken log-odds. The weights of the event kinds are fitted
(logistic, pulled towards ``PRIOR``) with stems from the other half of the
sample, which also calibrates the score. The fit uses a bounded sample of
labelled rows: ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` others, those with the
least hash of doc_id. Neither labels, lang, source nor doc_id enter a score. Only
texts with a hit of the lexicon's automaton are parsed; all are scanned whole.

Defined cases: null and empty texts score as texts without events; a null doc_id
is not held out; labels other than 0 and 1 are left out, as are those without a
doc_id; a doc_id with several labels counts as toxic if one says so, and one with
several texts trains by one of them; without both labels the weights are ``PRIOR``
and only the fixed word lists count; a score of just the threshold is predicted 1;
a text of any length is read whole; repeated rows each get their row; an empty
table gives no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, least_by_hash, written
from .text import map_text, slices, texts

TOXIC_ROWS = 4000
CLEAN_ROWS = 8000
THRESHOLD = 0.7
REACH = 4
PREFIXES = range(3, 13)

# Word lists of the grammar (English, German, French, Spanish), natural order.
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting imbecile cretin bastard bitch asshole vermin idiota imbécil estúpido basura escoria dummkopf abschaum arschloch trottel crétin connard salaud ordure".split()
THREATS = "kill murder hurt beat destroy stab shoot strangle töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he she they them their people everyone du dich dir dein sie ihr euch tu toi te vous votre ils elles tú usted ustedes ti ellos ellas".split()
NEGATIONS = "not no never none without hardly nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say called wrote writes quoted told reported claimed sagte sagt nannte schrieb zitierte dit disait écrit appelé cité dijo dice llamó escribió citó".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Event kinds: insult or threat (1), negated (2), reported (4), targeted (8).
KINDS = 16
#: Further features: the strongest event, the log of all weights, whether there is a sure event, the log of their number.
EXTRA = 4
#: Weight from which an event is sure.
SURE = 4.0
#: Strength of the pull towards the prior weights.
PULL = 0.1
#: What a negated or a reported event keeps of its strength before labels say more.
NEGATED, REPORTED = 0.5, 0.6
RELIEF = np.array([(NEGATED if k & 2 else 1.0) * (REPORTED if k & 4 else 1.0) for k in range(KINDS)])
#: Prior weights of the event kinds' sums, of the strongest event and of the log of all weights.
PRIOR = np.array([(0.2 if not k & 1 else 0.1) * RELIEF[k] + (0.05 if k & 8 else 0) for k in range(KINDS)] + [0.3, 0.3, 2.0, 0.5])
#: Weight of a listed insult or threat that the labels say nothing about.
LISTED = 2.0
#: Pseudo-counts that shrink a stem's log-odds, and the chance below which a stem is taken.
SHRINK = 4.0
CHANCE = 1e-4
_STOP = b".!?;:\n\"()"
_TABLE = bytes(46 if b in _STOP else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def clauses(text: bytes) -> list[bytes]:
    """Lower-cased clauses of words with single separators, ends of clauses as ``.``."""
    return text.decode("utf-8", "replace").lower().encode().translate(_TABLE).split(b".")


class Transducer:
    """A deterministic weighted transducer: ``step(state, symbol, event)`` gives the next state, the event passed on, and the arc's weight.

    Weights multiply along a path, so those of composed machines do too.
    """

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, then: "Transducer") -> "Transducer":
        """Composition: ``then`` reads what this one passes on."""

        def step(state, symbol, event):
            a, event, v = self.step(state[0], symbol, event)
            b, event, w = then.step(state[1], symbol, event)
            return (a, b), event, v * w

        return Transducer((self.start, then.start), step)

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """The events of a clause, each with the product of its arcs' weights."""
        state, out = self.start, []
        for s in symbols:
            state, event, weight = self.step(state, s, None)
            if event is not None:
                out.append((event, weight))
        return out


def _event(state, symbol, event):
    return state, {INSULT: 0, THREAT: 1}.get(symbol, event), 1.0


def _negation(left, symbol, event):
    if symbol == NEGATION:
        return REACH, event, 1.0
    hit = event is not None and left > 0
    return max(0, left - 1), event | 2 if hit else event, NEGATED if hit else 1.0


def _report(said, symbol, event):
    hit = event is not None and said
    return said or symbol == REPORT, event | 4 if hit else event, REPORTED if hit else 1.0


def _target(left, symbol, event):
    if symbol == TARGET:
        return REACH, event, 1.0
    return max(0, left - 1), event | 8 if event is not None and left else event, 1.0


GRAMMAR = Transducer(0, _event) @ Transducer(0, _negation) @ Transducer(False, _report) @ Transducer(0, _target)
_REVERSED = Transducer(0, _event) @ Transducer(0, _target)


def clause_events(symbols: list[int]) -> list[tuple[int, float]]:
    """Event kinds of a clause with their weights; a target also counts when it follows."""
    events = GRAMMAR.run(symbols)
    behind = _REVERSED.run(symbols[::-1])[::-1]
    return [(e | (b & 8), w) for (e, w), (b, _) in zip(events, behind, strict=True)]


class Lexicon:
    """Insult stems with weights, and the automaton that finds candidate texts."""

    def __init__(self, stems: dict[str, float]):
        self.fixed = {w.encode(): c for words, c in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)) for w in words}
        self.whole = {w.encode(): LISTED for w in INSULTS} | {s[:-1].encode(): w for s, w in stems.items() if s.endswith("$")}
        self.prefixes = {s.encode(): w for s, w in stems.items() if not s.endswith("$")}
        self.lengths = sorted({len(p) for p in self.prefixes}, reverse=True)
        self.automaton = ahocorasick.Automaton()
        for s in (*(b" " + w + b" " for w in self.whole), *(b" " + p for p in self.prefixes), *(b" " + w.encode() + b" " for w in THREATS)):
            self.automaton.add_word(s.decode("latin-1"), 1)
        self.automaton.make_automaton()

    def symbol(self, word: bytes) -> tuple[int, float]:
        """A word's symbol, and its weight if it makes an event."""
        if (weight := self.whole.get(word)) is not None:
            return INSULT, weight
        for n in self.lengths:
            if (weight := self.prefixes.get(word[:n])) is not None:
                return INSULT, weight
        kind = self.fixed.get(word, OTHER)
        return kind, LISTED if kind == THREAT else 0.0

    def features(self, text: bytes) -> np.ndarray:
        """Of a text's clauses: the summed weights of each event kind, and the further features."""
        out, sure = np.zeros(KINDS + EXTRA), 0
        cut = clauses(text)
        flat = b" " + b" ".join(b" ".join(c.split()) for c in cut) + b" "
        if next(self.automaton.iter(flat.decode("latin-1")), None) is None:
            return out
        for c in cut:
            read = [self.symbol(w) for w in c.split()]
            weights = [w for _, w in read if w]
            if weights:
                for (e, arcs), w in zip(clause_events([k for k, _ in read]), weights, strict=True):
                    out[e] += w
                    out[KINDS] = max(out[KINDS], w * arcs)
                    sure += w * arcs >= SURE
        out[KINDS + 1 :] = math.log1p(out[:KINDS] @ RELIEF), sure > 0, math.log1p(sure)
        return out


def held_out(doc_id: "F.Column") -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS)) -> DataFrame:
    """(doc_id, y, text) of the bounded sample of training rows, one for each doc_id, written once."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    total = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    picked = [least_by_hash(known.where(F.col("y") == c), "doc_id", rows[c], total.get(c, 0)) for c in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    return written(found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")), "toxicity")


def _log_tail(n: int, k: int, r: float) -> float:
    """Log10 of a bound on the chance of k or more of n at rate r (Chernoff)."""
    q = k / n
    if q <= r:
        return 0.0
    gain = q * math.log(q / r) + ((1 - q) * math.log((1 - q) / (1 - r)) if q < 1 else 0)
    return -n * gain / math.log(10)


def induce_stems(sample: DataFrame) -> dict[str, float]:
    """Weights of stems that toxic texts have beyond chance: a prefix, or a whole word ending in ``$``."""

    def count(batches):
        seen: dict[tuple[bytes, int], int] = {}
        for batch in batches:
            for part in slices(batch):
                for y, t in zip(part.column(1).to_pylist(), texts(part.column(2)), strict=True):
                    words = [w for c in clauses(t) for w in c.split()]
                    for pair in {(w, zlib.crc32(v)) for v, w in zip([b"", *words], words, strict=False)}:
                        seen[pair] = seen.get(pair, 0) | (2 if y else 1)
                if len(seen) > 500_000:
                    yield rows(seen)
                    seen = {}
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.int64()), pa.array([x & 1 for x in seen.values()], pa.int64()), pa.array([x >> 1 for x in seen.values()], pa.int64())], ["word", "before", "clean", "toxic"])

    pairs = sample.mapInArrow(count, "word string, before long, clean long, toxic long")
    both = lambda f: (f("clean").alias("clean"), f("toxic").alias("toxic"))
    words = pairs.groupBy("word", "before").agg(*both(F.max)).groupBy("word").agg(*both(F.sum))
    words = words.where(F.length("word").between(min(PREFIXES), 40))
    cut = F.transform(F.sequence(F.lit(min(PREFIXES)), F.least(F.length("word"), F.lit(max(PREFIXES)))), lambda n: F.substring("word", F.lit(1), n))
    stems = words.select(F.explode(F.array_append(cut, F.concat("word", F.lit("$")))).alias("stem"), "clean", "toxic")
    stems = stems.groupBy("stem").agg(*both(F.sum), F.max("toxic").alias("top"), F.sum((F.col("toxic") > 0).cast("long")).alias("words"))
    total = words.agg(F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1]:
        return {}
    rate = total[0] / (total[0] + total[1])
    whole = F.col("stem").endswith("$")
    shared = (F.col("words") >= 3) & (F.col("top") < 0.6 * F.col("toxic"))
    found = stems.where((F.col("toxic") >= 3) & (F.col("toxic") >= 2 * rate * (F.col("toxic") + F.col("clean"))) & (whole | shared)).collect()
    found = {r["stem"]: (r["toxic"], r["clean"]) for r in found if _log_tail(r["toxic"] + r["clean"], r["toxic"], rate) < math.log10(CHANCE)}
    return _nested_weights(found, rate)


def _nested_weights(found: dict[str, tuple[int, int]], rate: float) -> dict[str, float]:
    """Log-odds of stems: a prefix by the words that no longer prefix takes, each shrunken to the next shorter one."""

    def above(stem: str, among) -> str | None:
        return next((stem[:n] for n in range(len(stem) - 1, min(PREFIXES) - 1, -1) if stem[:n] in among), None)

    left = {s: list(n) for s, n in found.items()}
    for s in found:
        if not s.endswith("$") and (p := above(s, found)):
            left[p] = [left[p][0] - found[s][0], left[p][1] - found[s][1]]
    prefixes = {s for s in found if not s.endswith("$") and left[s][0] >= 3 and _log_tail(sum(left[s]), left[s][0], rate) < math.log10(CHANCE)}
    share, out = {}, {}
    for s in sorted(found, key=len):
        if s in prefixes or s.endswith("$"):
            prior = share.get(above(s, prefixes), rate)
            toxic, clean = left[s]
            share[s] = (toxic + SHRINK * prior) / (toxic + clean + SHRINK)
            out[s] = math.log(share[s] / (1 - share[s]) * (1 - rate) / rate)
    return {s: w for s, w in out.items() if w > 0}


def _features(sample: DataFrame, stems: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of the sample's rows, in order of doc_id."""
    shared = sample.sparkSession.sparkContext.broadcast(stems)

    def run(batches):
        lexicon = Lexicon(shared.value)
        for batch in batches:
            for part in slices(batch):
                x = [lexicon.features(t).tobytes() for t in texts(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    got = sample.mapInArrow(run, "doc_id long, y int, x binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    x = [np.frombuffer(got["x"][int(i)].as_py()) for i in order]
    return got["y"].to_numpy().astype(float)[order], np.array(x).reshape(-1, KINDS + EXTRA)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray, float]:
    """Stems with weights, weights of the event kinds, and offset."""
    sample = labelled_sample(docs, labels)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    fits = [_features(sample.where(half == 1 - h), induce_stems(sample.where(half == h))) for h in (0, 1)]
    y, x = np.concatenate([f[0] for f in fits]), np.concatenate([f[1] for f in fits])
    stems = induce_stems(sample)
    discard(sample)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()
    share = {int(r[0]): r[1] for r in known}
    if not len(y) or y.min() == y.max():
        return stems, PRIOR, -3.0
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum()) * len(y) / sum(share.values())
    w, b = PRIOR.copy(), -3.0
    full = np.column_stack([x, np.ones(len(x))])
    for _ in range(80):  # damped Newton steps; the prior holds kinds that rows say nothing about
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (weight * (p - y)) + PULL * (w - PRIOR), (weight * (p - y)).sum())
        h = (full * (weight * p * (1 - p) + 1e-9)[:, None]).T @ full + np.diag(np.append(np.full(KINDS + EXTRA, PULL), 1e-3))
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        w, b = w - step[:-1], b - float(step[-1])
    return stems, np.maximum(w, 0.0), b


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the summed event weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        stems, w, b = shared.value
        lexicon = Lexicon(stems)
        base = 1 / (1 + math.exp(-b))

        def step(part):
            value, weight = np.full(part.num_rows, base), np.zeros(part.num_rows)
            for i, t in enumerate(texts(part.column(1))):
                x = lexicon.features(t)
                if x.any():
                    weight[i] = x[:KINDS].sum()
                    value[i] = 1 / (1 + math.exp(-max(-30, min(30, float(x @ w) + b))))
            return {"doc_id": part.column(0), "score": pa.array(value), "predicted": pa.array((value >= threshold).astype(np.int32)), "event_weight": pa.array(weight)}

        return step

    done = map_text(docs, ["doc_id", "text"], make, "doc_id long, score double, predicted int, event_weight double")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "event_weight")
