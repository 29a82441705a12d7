"""N-gram Jaccard join: exact links and components of documents by their shingle sets.

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles.
Documents with the same set form one class, and only classes are compared.

1. One pass over the texts gives each document's class (a 128-bit digest) and a
   count sketch of fixed size, summed over the tasks: how many documents have a
   shingle of each bucket. The sketch only orders shingles, rare ones first; any
   order all tasks share keeps the prefix filter exact.
2. Each class posts the first ``n - ceil(t * n) + 1`` shingles of its set in that
   order, with their positions. Two sets over the threshold share a posted
   shingle. An index list is cut into blocks of equal size and position: if the
   list's shingle is the first that two sets have in common, what is left of both
   from there on must hold the overlap. Blocks that no other block of the list (or
   member of the same) leaves room for are skipped whole, and their members with them.
3. The other classes of an index list go to the list's hub (its least class). Lists of
   near copies have the same hub, so a class goes there once, whatever the number
   of lists; a hub whose members all share a lesser hub is dropped. Lists that the
   sketch marks as long are handled by a partial minimum and a skew join, never as
   one window.
4. A hub's group is one piece of work, or one for each pair of its blocks if it is
   larger than a block. Inside, a set that has nobody like it is a leader; a set
   like a leader is kept as its difference from it, what it lacks and what it has
   beyond. Index lists hold leaders and differences, in order of set size. A
   leader's overlaps with all sets are counted from the lists of its shingles; those
   of a set like it start from the leader's and are corrected by the lists of the
   shingles in which both differ. Each piece gives a spanning forest of its links and
   each class's number of links, not all pairs.
5. Components of the links are found on small tables of class ids.

A class's text goes once to each block pair of its groups, from the rows of one
doc_id and text; nothing is dropped or capped.

Defined cases: null, empty and word-less texts have an empty set, link with
nothing and are their own component; a text of fewer than ``k`` words has its
whole sequence as one shingle; a text of any length is shingled whole; a null
doc_id is no smallest doc_id unless a component has no other; repeated documents,
and different texts of one doc_id, each get their row; a similarity of exactly
the threshold links; an empty table gives no row; other columns are not read, and
the stage hands them on, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import discard, fresh_names, written
from .text import mix, raw, release, signed, slices, spans, windows, word_hashes, words

SKETCH_BITS = 20
_SEGMENTS = 64
#: A list longer than this (over the sketch's mean load) isn't handled as one stream.
HOT = 2000
#: Bounds of a block of a group: shingles and classes.
BLOCK_SHINGLES = 1 << 21
BLOCK_CLASSES = 8192
#: A set is kept as its difference from a leader if that has at most this share of its size.
LIKE = 0.4
_SEEN = 200_000


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    buf, offs = raw(column)
    starts, ends, row = words(buf, offs)
    h = word_hashes(buf, starts, ends)
    n_rows = len(offs) - 1
    win, first = windows(h, row, k)
    at, of = spans(row[first], n_rows), spans(row, n_rows)
    out = []
    for i in range(n_rows):
        n = of[i + 1] - of[i]
        if n >= k:
            out.append(np.unique(win[at[i] : at[i + 1]]))
        elif n:
            whole = np.uint64(n)
            for x in h[of[i] : of[i + 1]]:
                whole = mix(np.array([whole ^ x]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("version"), docs["text"].alias("text"))


def _first_pass(keyed: DataFrame, k: int) -> DataFrame:
    """Rows (doc, version, hi, lo, n), and at each task's end its sketch in segments (seg, counts)."""

    def rows(doc, version, hi, lo, n, seg, counts):
        return pa.RecordBatch.from_arrays([doc, version, pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(seg, pa.int32()), pa.array(counts, pa.binary())], ["doc", "version", "hi", "lo", "n", "seg", "counts"])

    def run(batches):
        sketch = None
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(2), k)
                ids = [class_of(s) for s in sets]
                none = [None] * len(sets)
                yield rows(part.column(0), part.column(1), [i[0] for i in ids], [i[1] for i in ids], [len(s) for s in sets], none, none)
                sketch = np.zeros(1 << SKETCH_BITS, np.uint32) if sketch is None else sketch
                flat = np.concatenate(sets)
                sketch += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
        if sketch is not None:
            part = sketch.reshape(_SEGMENTS, -1)
            none = [None] * _SEGMENTS
            yield rows(pa.array(none, pa.int64()), pa.array(none, pa.int64()), none, none, none, list(range(_SEGMENTS)), [zlib.compress(x.astype("<u4").tobytes(), 1) for x in part])

    return keyed.mapInArrow(run, "doc long, version long, hi long, lo long, n long, seg int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' sketches summed: by groups of partitions first, then over the groups, a segment at a time."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // _SEGMENTS, np.uint64)
        for batch in batches:
            for x in batch.column(batch.num_columns - 1).to_pylist():
                data = np.frombuffer(zlib.decompress(x), "u1")
                total += data.view("<u4" if len(data) == 4 * len(total) else "<u8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["seg", "counts"])

    out = np.zeros((_SEGMENTS, (1 << SKETCH_BITS) // _SEGMENTS), np.uint64)
    parts = rows.where("seg is not null").select("seg", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"), "counts")
    parts = parts.groupBy("seg", "part").applyInArrow(add, "seg int, counts binary").groupBy("seg").applyInArrow(add, "seg int, counts binary")
    for r in parts.collect():
        out[r["seg"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out.reshape(-1)


def _postings(keyed: DataFrame, k: int, percent: int, shared, hot: bool) -> DataFrame:
    """(token, hi, at) of the posted shingles, those of long lists or the others; ``at`` packs set size and position."""

    def run(batches):
        level, long_list = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                token, hi, at = [], [], []
                for s in shingle_sets(part.column(2), k):
                    if len(s) < 2:
                        continue  # only an equal set reaches a single shingle's
                    ids = class_of(s)
                    if ids[0] in seen:
                        continue
                    if len(seen) < _SEEN:
                        seen.add(ids[0])
                    p = prefix_size(len(s), percent)
                    key = (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s & np.uint64(2**56 - 1))
                    order = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    order = order[np.argsort(key[order])]
                    chosen = long_list[(s[order] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] == hot
                    token.append(key[order][chosen])
                    hi.append(np.full(len(token[-1]), ids[0], np.int64))
                    at.append((len(s) << 32) + np.flatnonzero(chosen))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(token))), pa.array(np.concatenate(hi)), pa.array(np.concatenate(at))], ["token", "hi", "at"])

    return keyed.mapInArrow(run, "token long, hi long, at long")


def _may_link(hi: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which members of one list, in order of size and position, have a partner by both (the list's token being the first in common).

    Members of the same size and position are one block, kept or skipped whole. A size's
    best block stands for the others of that size, its second best where it is compared with itself.
    """
    edge = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])))
    several = np.logical_or.reduceat(np.append(False, hi[1:] != hi[:-1]) & ~np.isin(np.arange(len(hi)), edge), edge)
    size, room = n[edge], n[edge] - pos[edge]
    best = np.flatnonzero(np.append(True, size[1:] != size[:-1]))  # blocks of one size: most room first
    width, most = size[best], room[best]
    second = np.where(np.append(best[1:], len(size)) - best > 1, room[np.minimum(best + 1, len(size) - 1)], 0)
    second = np.where(several[best], most, second)
    of = np.repeat(np.arange(len(best)), np.diff(np.append(best, len(size))))
    kept = np.zeros(len(size), bool)
    step = max(1, (1 << 20) // len(width))
    for a in range(0, len(size), step):
        b = slice(a, a + step)
        need = -(-percent * (size[b, None] + width[None, :]) // (100 + percent))
        other = np.repeat(most[None, :], need.shape[0], 0)
        itself = np.isin(np.arange(a, a + need.shape[0]), best)
        other[itself, of[b][itself]] = second[of[b][itself]]
        kept[b] = ((room[b, None] >= need) & (other >= need)).any(1)
    return np.repeat(kept, np.diff(np.append(edge, len(hi))))


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """(hub, hi) of the members that may link, list by list; rows come sorted by token and size, in one stream."""

    def pick(token, hi, at):
        n, pos = at >> 32, at & (2**32 - 1)
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(first, len(token)))
        two = first[size == 2]
        if len(two):
            need = -(-percent * (n[two] + n[two + 1]) // (100 + percent))
            good = (np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) >= need) & (hi[two] != hi[two + 1])
            two = two[good]
            hub = np.minimum(hi[two], hi[two + 1])
            out = [(np.repeat(hub, 2), np.stack([hi[two], hi[two + 1]], 1).reshape(-1))]
        else:
            out = []
        for a, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            members = np.unique(hi[a : a + m][_may_link(hi[a : a + m], n[a : a + m], pos[a : a + m], percent)])
            if len(members) > 1:
                out.append((np.full(len(members), members[0]), members))
        hub = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
        member = np.concatenate([x[1] for x in out]) if out else hub
        return pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(member, pa.int64())], ["hub", "hi"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns, strict=True)]
            if len(held[0]):
                whole = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last list may go on
                yield pick(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield pick(*held)

    return postings.repartition("token").sortWithinPartitions("token", "at").mapInArrow(run, "hub long, hi long")


def _to_hubs(keyed: DataFrame, k: int, percent: int, counts: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
    """(hub, hi): the classes of each hub's lists, the hub itself among them; and the table that it reads, if any."""
    mean = float(counts.mean())
    level = np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)
    long_list = counts > mean + 6 * mean**0.5 + HOT
    shared = keyed.sparkSession.sparkContext.broadcast((level, long_list))
    out, posted = _lists(_postings(keyed, k, percent, shared, False), percent), None
    if long_list.any():
        posted = written(_postings(keyed, k, percent, shared, True), "postings")
        least = posted.groupBy("token").agg(F.min("hi").alias("hub"), F.max("hi").alias("top")).where("hub != top").drop("top")
        out = out.union(posted.join(least, "token").select("hub", "hi"))
    return out.distinct(), posted


def _ranges(offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the chosen lists' entries, one list after the other."""
    size = offsets[chosen + 1] - offsets[chosen]
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(offsets[chosen] - end + size, size)


class Overlaps:
    """Overlaps of a group's sets (in order of size), most of them derived from those of a similar set."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.at = np.append(0, np.cumsum(self.size))
        vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.width = ids.astype(np.int32), len(vocabulary)
        self.leader = self._leaders()
        self.lead = np.flatnonzero(self.leader == np.arange(len(sets)))
        self.number = np.searchsorted(self.lead, self.leader)  # of each set's leader
        self.plus, self.minus = [self.ids[:0]] * len(sets), [self.ids[:0]] * len(sets)
        place = np.full(self.width, -1, np.int32)
        for p in self.lead.tolist():
            members = np.flatnonzero(self.leader == p)
            own = self._set(p)
            place[own] = np.arange(len(own))
            for x in members[members != p].tolist():
                mine = self._set(x)
                there = place[mine]
                lacks = np.ones(len(own), bool)
                lacks[there[there >= 0]] = False
                self.plus[x], self.minus[x] = mine[there < 0], own[lacks]
            place[own] = -1
        self.of_leaders = self._lists([self._set(p) for p in self.lead.tolist()])
        self.with_more, self.with_less = self._lists(self.plus), self._lists(self.minus)

    def _set(self, x: int) -> np.ndarray:
        return self.ids[self.at[x] : self.at[x + 1]]

    def _leaders(self) -> np.ndarray:
        """Each set's leader, itself if none is like it; a leader takes all sets like it that have none yet."""
        g = len(self.size)
        leader, owner = np.full(g, -1), np.repeat(np.arange(g, dtype=np.int32), self.size)
        mark = np.zeros(self.width, bool)
        idle = 0
        while idle < 4 and (left := np.flatnonzero(leader < 0)).size:
            p = int(left[len(left) // 2])
            own = self._set(p)
            mark[own] = True
            both = np.bincount(owner, mark[self.ids], g)
            mark[own] = False
            like = left[self.size[left] + len(own) - 2 * both[left] <= LIKE * self.size[left]]
            leader[like] = p
            idle = idle + 1 if len(like) < 3 else 0  # sets without likes: no use in looking on
        return np.where(leader < 0, np.arange(g), leader)

    def _lists(self, some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index lists: for each shingle the places of the sets that hold it, ascending, and the lists' offsets."""
        flat = np.concatenate(some) if some else self.ids[:0]
        holder = np.repeat(np.arange(len(some), dtype=np.int32), [len(x) for x in some])[np.argsort(flat, kind="stable")]
        return holder, np.append(0, np.cumsum(np.bincount(flat, minlength=self.width)))

    def _count(self, lists, shingles: np.ndarray, n: int) -> np.ndarray:
        holder, offsets = lists
        return np.bincount(holder[_ranges(offsets, shingles)], minlength=n)

    def _counts(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the shingles each leader has, and what to add for each set."""
        g = len(self.size)
        return self._count(self.of_leaders, shingles, len(self.lead)), self._count(self.with_more, shingles, g) - self._count(self.with_less, shingles, g)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, its overlaps with all sets)."""
        members = np.argsort(self.number, kind="stable")
        for p, mine in zip(self.lead.tolist(), np.split(members, np.cumsum(np.bincount(self.number))[:-1]), strict=True):
            leaders, more = self._counts(self._set(p))
            yield p, leaders[self.number] + more
            for x in mine[mine != p].tolist():
                (a, b), (c, d) = self._counts(self.plus[x]), self._counts(self.minus[x])
                yield x, (leaders + a - c)[self.number] + more + b - d


def _links_in(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set with those behind it that it is linked with; sets are in order of size."""
    size = np.array([len(x) for x in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yield 0, np.arange(1, 2) if 100 * both >= percent * (size.sum() - both) else np.arange(0)
        return
    far = np.searchsorted(size, size * 100 // percent, "right")  # where a set's partners end
    for x, both in Overlaps(sets):
        part = slice(x + 1, int(far[x]))
        yield x, x + 1 + np.flatnonzero(100 * both[part] >= percent * (size[x] + size[part] - both[part]))


def _links(groups: DataFrame, k: int, percent: int) -> DataFrame:
    """For each piece of work, from rows sorted by piece: a spanning forest of its links (a, b), and how many
    documents each class is linked with by them (a, links). A pair of classes that meets in several pieces
    is counted in one: under its least hub, and of two blocks not inside either."""

    def work(key: tuple[int, int, int], found: dict) -> Iterator[tuple]:
        if len(found) < 2:
            return
        order = sorted(found, key=lambda x: len(found[x][0]))
        sets, own, size, hubs = zip(*(found[x] for x in order), strict=True)
        own, size = np.array(own), np.array(size, np.int64)
        lesser: dict[int, list[int]] = {}
        for i, mine in enumerate(hubs):
            for h in mine:
                if h < key[0]:
                    lesser.setdefault(h, []).append(i)
        label, total = np.arange(len(sets)), np.zeros(len(sets), np.int64)
        for x, linked in _links_in(list(sets), percent):
            if not len(linked):
                continue
            joined = np.unique(np.append(label[linked], label[x]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
            counted = linked if key[1] == key[2] else linked[own[linked] != own[x]]
            if elsewhere := [h for h in hubs[x] if h < key[0]]:  # pairs that meet under a lesser hub too are counted there
                there = np.zeros(len(sets), bool)
                for h in elsewhere:
                    there[lesser[h]] = True
                counted = counted[~there[counted]]
            total[counted] += size[x]
            total[x] += size[counted].sum()
        node = [hi.to_bytes(8, "big", signed=True) + lo.to_bytes(8, "big", signed=True) for hi, lo in order]
        for i, j in enumerate(label.tolist()):
            if i != j:
                yield node[i], node[j], None
        for i in np.flatnonzero(total).tolist():
            yield node[i], None, int(total[i])

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())], ["a", "b", "links"])

    def run(batches):
        key, found = None, {}
        for batch in batches:
            out = []
            for hub, i, j, own, hi, lo, size, hubs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, i, j) != key:
                    out += work(key, found)
                    key, found = (hub, i, j), {}
                if (hi, lo) not in found:
                    s = shingle_sets(pa.array([text], pa.string()), k)[0]
                    if class_of(s) == (hi, lo):  # two texts of a doc_id may have the same hash
                        found[hi, lo] = (s, own, size, hubs)
            yield rows(out)
        yield rows(list(work(key, found)))
        release()

    return groups.select("hub", "i", "j", "own", "hi", "lo", "size", "hubs", "text").mapInArrow(run, "a binary, b binary, links long")


def _once_a_task(sent: DataFrame) -> DataFrame:
    """Rows without those that a task sends to the same piece again for the same class, as far as a bounded memory tells."""
    keys = ["hub", "i", "j", "hi", "lo"]

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            new = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)):
                if row not in seen:
                    new.append(i)
                    if len(seen) < _SEEN:
                        seen.add(row)
            yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))

    return sent.mapInArrow(run, sent.schema)


def _pieces(members: DataFrame) -> DataFrame:
    """Where each class goes: (hub, i, j, own, hi, lo, rep, at, size, hubs), the pieces of work of its groups that matter."""
    told = members.join(members.groupBy("hi", "lo").agg(F.min("hub").alias("first")), ["hi", "lo"])
    group = told.groupBy("hub").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("classes"))
    group = group.where((F.col("low") != F.col("high")) | (F.col("low") == F.col("hub")))  # else all members meet under the lesser hub
    group = group.select("hub", F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("classes") / BLOCK_CLASSES)).alias("m"))
    kept = members.join(group, "hub")
    hubs = kept.groupBy("hi", "lo").agg(F.collect_set("hub").alias("hubs"))
    pieces = kept.join(hubs, ["hi", "lo"]).withColumn("own", F.pmod("lo", F.col("m")))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("other"))
    return pieces.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "hi", "lo", "at", "size", "hubs")


def shipped(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """The texts of all pieces of work: one row for each piece that a class is in."""
    pieces = _pieces(members)
    same = keyed["doc"].eqNullSafe(pieces["at.doc"]) & (keyed["version"] == pieces["at.version"])
    return _once_a_task(keyed.join(pieces, same).select("hub", "i", "j", "own", "hi", "lo", "size", "hubs", "text"))


def linked_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, n_links) of every document.

    ``version`` is the text's hash; ``n_links`` is the number of other documents linked with it.
    """
    keyed = _keyed(docs)
    rows = written(_first_pass(keyed, k), "classes")
    docs_by_class = rows.where("seg is null").select("doc", "version", "hi", "lo", "n")
    at = F.min(F.when(F.col("version").isNotNull(), F.struct("version", "doc"))).alias("at")
    classes = docs_by_class.where("n > 0").groupBy("hi", "lo").agg(F.min("doc").alias("rep"), at, F.min("n").alias("n"), F.count(F.lit(1)).alias("size"))
    hubs, stored = _to_hubs(keyed, k, percent, _sketch(rows))
    members = written(hubs.join(classes.select("hi", "lo", "at", "n", "size"), "hi"), "members")
    groups = shipped(keyed, members).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    found = written(_links(groups, k, percent), "links")
    for table in (members, stored):
        discard(table)
    roots = components(found.where("b is not null").select("a", "b"), "roots")
    counts = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    node = F.concat(_bytes("hi"), _bytes("lo"))
    named = classes.select("rep", "hi", "lo", "size", node.alias("node")).join(roots, "node", "left").join(counts, "node", "left")
    named = named.select("rep", "hi", "lo", F.coalesce("root", "node").alias("root"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    least = named.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root", "left").select("hi", "lo", "links", F.coalesce("least", "rep").alias("least"))
    out = docs_by_class.join(named, ["hi", "lo"], "left")
    return out.select(F.col("doc").alias("doc_id"), "version", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"), F.when(F.col("n") > 0, F.col("links")).otherwise(0).alias("n_links"))


def _bytes(column: str):
    return F.unhex(F.lpad(F.hex(F.col(column)), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links by 3-word shingles at 90 of 100."""
    return linked_components(docs, 3, 90).drop("version")


def dedup_stage(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the least doc_id of each component, columns as they came; a row that repeats it goes too.

    Of a component without any doc_id, each different text stays; so does each
    different text of the least doc_id. Columns of any name come through unread.
    """
    doc, version = fresh_names(docs, "doc", "version")
    first = linked_components(docs, k, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.select(F.col("doc_id").alias(doc), F.col("version").alias(version)).distinct()
    keyed = docs.withColumns({version: F.xxhash64(docs["text"])})
    kept = keyed.join(first, keyed["doc_id"].cast("long").eqNullSafe(first[doc]) & (keyed[version] == first[version]), "left_semi")
    return kept.dropDuplicates(["doc_id", version]).drop(version)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w
), n AS (
  SELECT k, count(*) AS n FROM s GROUP BY k
), p AS (
  SELECT a.k AS x, b.k AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.k = x JOIN n AS ny ON ny.k = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT k AS a, k AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), least_id AS (
  SELECT a AS k, min(doc_id) AS component_id FROM r JOIN w ON w.k = r.b GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(d.c, 0)::BIGINT AS n_links
FROM w JOIN least_id USING (k) LEFT JOIN n USING (k) LEFT JOIN (SELECT x AS k, count(*) AS c FROM e GROUP BY x) AS d USING (k)
"""
