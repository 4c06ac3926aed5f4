"""Sampling distinct segmentations of texts over a vocabulary of pieces, and encoding and decoding with it.

The lattice of a text holds every way to write it as pieces. A segmentation's probability is proportional to the
product of its pieces' probabilities. Gumbel top-k without replacement perturbs the log probability of every
segmentation and keeps the k largest, without listing them: from the root down, a node of the tree of prefixes has
the largest perturbed value below it, and a queue ordered by these values (A* whose bound is exact) opens them.

Pieces never cross the start of a run of blanks, so a text's lattice is a chain of the lattices of its units, a run
of blanks with what follows. Lattices of units are built and sampled together in arrays.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Powers, Prefix, mixed, slices

UNIT = re.compile("▁*[^▁\n]+|▁+|\n")
_POWERS = Powers(0xC6BC279692B5CC83)
NONE = -1e300
#: Positions of a worker's arrays, and how many of them its remembered units take, of LONGEST_KEPT code points at most.
ROOM, KEPT, LONGEST_KEPT = 1_100_000, 400_000, 64


class Vocabulary:
    """Pieces of a SentencePiece model as arrays: hash of code points to id and log weight."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.model.get_piece_size()
        pieces, ids, scores, self.byte_ids = [], [], [], np.zeros(256, np.int64)
        for i in range(n):
            if self.model.is_byte(i):
                self.byte_ids[int(self.model.id_to_piece(i)[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                pieces.append(self.model.id_to_piece(i))
                ids.append(i)
                scores.append(self.model.get_score(i))
        scores = np.array(scores)
        if scores.min() < -1000:  # a model of merges: scores are ranks, which Zipf's law turns into shares
            scores = -np.log(scores.max() - scores + 3.0)
            scores -= np.log(np.exp(scores).sum())
        self.byte_score = float(scores.min()) - 1.0
        self.longest = max(map(len, pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(p) for p in pieces])
        hashes = Prefix(points, _POWERS).hash(ends - [len(p) for p in pieces], ends)
        # of the first three code points, the longest piece that begins with them
        self.reach = np.zeros(1 << 16, np.int64)
        begins, sizes = ends - [len(p) for p in pieces], np.array([len(p) for p in pieces])
        several = sizes >= 3
        heads = Prefix(points, _POWERS).hash(begins[several], begins[several] + 3)
        np.maximum.at(self.reach, (heads >> np.uint64(48)).astype(np.int64), sizes[several])
        self.bits = 20
        # open addressing, so that a look-up is a few array reads
        self.key, self.id, self.score = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), np.full(1 << self.bits, NONE)
        self.probes = 1
        for h, i, s in zip(hashes, ids, scores):
            at, tries = int(h >> np.uint64(64 - self.bits)), 1
            while self.key[at]:
                at, tries = (at + 1) % (1 << self.bits), tries + 1
            self.key[at], self.id[at], self.score[at] = h, i, s
            self.probes = max(self.probes, tries)

        self.width = -(-self.longest // 8) * 8
        self.known: dict[str, int] = {}  # first position of each remembered unit
        self.held, self.arrays = 0, None

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table row, whether there is such a piece)."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.key[at] == hashes
        for _ in range(1, self.probes):
            miss = ~found & (self.key[at] != 0)
            if not miss.any():
                break
            at = np.where(miss, (at + 1) % (1 << self.bits), at)
            found |= self.key[at] == hashes
        return at, found


def _width(points: np.ndarray) -> np.ndarray:
    """Bytes of code points in UTF-8."""
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


class Lattices:
    """Of different units: for every position, the chance of each length of the next piece, given that one is sampled.

    Units that the texts at hand hold more than once (often counts them) are remembered with the vocabulary until KEPT
    positions are taken, so their lattices are made once for each worker. All others lie behind them in the same
    arrays, which the next object of the vocabulary overwrites.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str], often: np.ndarray):
        v = vocabulary
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        first = np.fromiter(map(v.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(first < 0)
        n, width = int(sizes[new].sum()), v.width
        made = lambda n: (np.empty((n, width)), np.empty((n, width), np.int32), np.empty((n, width), np.float32), np.empty(n, np.uint8), np.empty(n, np.int64))
        if v.arrays is None:
            v.arrays = made(ROOM)
        keep = np.zeros(len(new), bool)
        if v.held + n <= ROOM:
            arrays = v.arrays
            worth = np.where((often[new] > 1) & (sizes[new] <= LONGEST_KEPT), sizes[new], 0)
            keep = (worth > 0) & (v.held + worth.cumsum() <= KEPT)
            new = np.concatenate([new[keep], new[~keep]])  # what is remembered comes first
        else:  # too much to stay
            arrays = made(v.held + n)
            for a, b in zip(arrays, v.arrays):
                a[: v.held] = b[: v.held]
        base = v.held
        first[new] = base + sizes[new].cumsum() - sizes[new]
        self.start, self.end = first, first + sizes
        self.log, self.ids, self.upto, self.ways, self.points = arrays
        if len(new):
            self._fill(v, [units[i] for i in new.tolist()], sizes[new], *(a[base : base + n] for a in arrays))
        for i in new[: int(keep.sum())].tolist():
            v.known[units[i]] = int(first[i])
            v.held = int(self.end[i])

    @staticmethod
    def _fill(v: Vocabulary, units: list[str], sizes: np.ndarray, log: np.ndarray, all_ids: np.ndarray, upto: np.ndarray, count: np.ndarray, kept_points: np.ndarray) -> None:
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n, most = len(points), min(v.longest, int(sizes.max(initial=1)))
        ends = sizes.cumsum()
        # Positions are handled by their distance to the unit's end, units in order of size: those of distance j
        # are then one slice, in which position r belongs to unit r.
        order = np.argsort(-sizes, kind="stable")
        live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(1, int(sizes.max(initial=0)) + 1))
        base = np.concatenate([[0, 0], live.cumsum()])
        far = np.repeat(np.arange(1, len(live) + 1), live)
        rank = np.arange(n) - base[far]
        place = ends[order][rank] - far
        sums = Prefix(points, _POWERS)
        edges = []
        reach = np.zeros(n, np.int64)
        if most >= 3:
            at = place[base[3] :]
            reach[base[3] :] = v.reach[(sums.hash(at, at + 3) >> np.uint64(48)).astype(np.int64)]
        for length in range(1, most + 1):
            first = base[length]
            if length >= 3:
                near = first + np.flatnonzero(reach[first:] >= length)
                row, found = v.look_up(sums.hash(place[near], place[near] + length))
                which, row = near[found], row[found]
                weight, ids = v.score[row], v.id[row]
                edges.append((which, weight, ids, np.where(far[which] > length, base[np.maximum(far[which] - length, 0)] + rank[which], n), np.searchsorted(which, base)))
                continue
            at = place[first:]
            row, found = v.look_up(sums.hash(at, at + length))
            if length == 1:  # a code point that is no piece is written as its bytes
                which, weight, ids = np.arange(n), np.where(found, v.score[row], v.byte_score * _width(points[at])), np.where(found, v.id[row], -1)
            else:
                hit = np.flatnonzero(found)
                which, weight, ids = hit + base[length], v.score[row[hit]], v.id[row[hit]]
            target = np.where(far[which] > length, base[np.maximum(far[which] - length, 0)] + rank[which], n)
            edges.append((which, weight, ids, target, np.searchsorted(which, base)))
        # log sum over the ways to write what follows each position, from the ends of units to their starts
        rest = np.zeros(n + 1)
        for j in range(1, len(live) + 1):
            lo, hi = base[j], base[j + 1]
            top, parts = np.full(hi - lo, NONE), []
            for which, weight, _, target, cuts in edges[:j]:
                x, y = cuts[j], cuts[j + 1]
                if x < y:
                    r, ways = which[x:y] - lo, weight[x:y] + rest[target[x:y]]
                    top[r] = np.maximum(top[r], ways)
                    parts.append((r, ways))
            total = np.zeros(hi - lo)
            for r, ways in parts:
                total[r] += np.exp(ways - top[r])
            rest[lo:hi] = top + np.log(total)
        log[:], all_ids[:], upto[:], kept_points[:] = NONE, -1, 0.0, points
        count[:] = 0  # of each position, how many lengths the next piece can have
        for k, (which, weight, ids, target, _) in enumerate(edges):
            chance = np.maximum(weight + rest[target] - rest[which], -745.0)
            at = place[which]
            count[at] += 1
            at = at * v.width + k
            log.reshape(-1)[at], all_ids.reshape(-1)[at], upto.reshape(-1)[at] = chance, ids, np.exp(chance)
        for b in range(0, n, 8192):
            some = upto[b : b + 8192]
            np.cumsum(some, 1, out=some)
            some /= some[:, -1:]

    def of_pieces(self, table: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """What log or ids hold for pieces at these positions, of length k + 1."""
        return table.reshape(-1).take(at * table.shape[1] + k)

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The length of the next piece, less one."""
        passed = self.upto.take(at, 0) <= u[:, None].astype(np.float32)
        k = np.bitwise_count(passed.view(np.uint64)).sum(1, dtype=np.int64)  # eight lengths to a word
        bad = np.flatnonzero(k == passed.shape[1])  # u rounded to 1; any other k is where the sum has grown, a length there is
        if len(bad):
            k[bad] = self.log[at[bad]].argmax(1)
        return k


def uniform(key: np.ndarray, turn: int) -> np.ndarray:
    return ((mixed(key, turn) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Paths:
    """Pieces of some units in order: position, chosen length less one, log chance and number of the unit."""

    def __init__(self, lattices: Lattices, start: np.ndarray, end: np.ndarray, key: np.ndarray):
        live, at = np.flatnonzero(start < end), start.copy()
        found, turn = [], 0
        while len(live):
            k = lattices.choose(at[live], uniform(key[live], turn))
            found.append((live, at[live].copy(), k))
            at[live] += k + 1
            live, turn = live[at[live] < end[live]], turn + 1
        if found:
            unit, pos, k = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(unit, kind="stable")  # rounds are in order, so the pieces of a unit stay so
            self.unit, self.pos, self.k = unit[order], pos[order], k[order]
        else:
            self.unit = self.pos = self.k = np.zeros(0, np.int64)
        self.log = lattices.of_pieces(lattices.log, self.pos, self.k)


def truncated(location: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at these locations, given that none exceeds top."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - location)


def sample_texts(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int, with_ids: bool) -> list[list[tuple]]:
    """For each text up to k distinct segmentations, best perturbed value first, as
    (pieces, log_prob, perturbed, log_inclusion, ids_crc32[, ids as little-endian unsigned 32-bit bytes]).

    Each turn opens the best node of every text's queue at once; what is done piece by piece is done for all texts together.
    """
    split = [UNIT.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    which, units = pd.factorize(np.fromiter(chain.from_iterable(split), object, int(bounds[-1])))
    lattices = Lattices(vocabulary, units.tolist(), np.bincount(which))
    most = lattices.log.shape[1]
    start, end = lattices.start[which], lattices.end[which]
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    place = np.arange(len(which)) - bounds[text_of]
    unit_key = mixed(keys[text_of] ^ mixed(place.astype(np.uint64), 1), 2)
    out: list[list[list]] = [[] for _ in texts]
    top = -np.log(-np.log(uniform(keys, 3)))
    # Each text's queue holds (-bound, tie, path, piece, barred): all that leaves the path at that piece by another length.
    queues: list[list[tuple]] = [[(-t, 0, None, 0, ())] for t in top.tolist()]
    paths: list[dict] = [{} for _ in texts]
    for turn in range(k):
        opened = [(i, heapq.heappop(q)) for i, q in enumerate(queues) if q]
        if not opened:
            break
        mine = np.array([i for i, _ in opened])
        value = np.array([-node[0] for _, node in opened])
        later = turn > 0  # the first turn opens whole texts, every other one a branch of a path
        first_unit, fixed = np.zeros(len(opened), np.int64), np.zeros(len(opened), np.int64)
        if later:
            old = [paths[i][node[2]] for i, node in opened]
            fixed = np.array([node[3] for _, node in opened])
            at = np.array([o["pos"][p] for o, p in zip(old, fixed)])
            first_unit = np.array([o["unit"][p] for o, p in zip(old, fixed)])
            ways = lattices.log[at]
            barred = [(j, b) for j, (_, node) in enumerate(opened) for b in node[4]]
            ways[tuple(np.array(barred).T)] = NONE
            share = np.where(ways > NONE / 2, np.exp(ways - ways.max(1, keepdims=True)), 0.0)
            upto = share.cumsum(1)
            draw = uniform(keys[mine], 1000 + turn) * upto[:, -1]
            length = np.minimum((upto <= draw[:, None]).sum(1), most - 1 - (share[:, ::-1] > 0).argmax(1))
            ways[np.arange(len(ways)), length] = NONE
            left = np.where(ways > NONE / 2, np.exp(ways), 0.0).sum(1)  # what neither was taken before nor now
        begin = bounds[mine] + first_unit
        units = bounds[mine + 1] - begin
        firsts = np.concatenate([[0], units.cumsum()])
        index = np.arange(firsts[-1]) + np.repeat(begin - firsts[:-1], units)
        from_ = start[index]
        if later:
            from_[firsts[:-1]] = at + length + 1
        drawn = Paths(lattices, from_, end[index], mixed(unit_key[index], 10 + turn))
        cuts = np.searchsorted(drawn.unit, firsts)
        unit = drawn.unit + np.repeat(first_unit - firsts[:-1], np.diff(cuts))
        pos, way, log = drawn.pos, drawn.k, drawn.log
        if later:  # the piece by which each branch leaves its path
            pos, way, unit, log = (np.insert(a, cuts[:-1], b) for a, b in ((pos, at), (way, length), (unit, first_unit), (log, lattices.log[at, length])))
            cuts = cuts + np.arange(len(cuts))
        raw, before = lattices.of_pieces(lattices.ids, pos, way), np.empty(len(log))
        for j, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            np.cumsum(log[x:y], out=before[x:y])
            if later and fixed[j]:
                before[x:y] += old[j]["before"][fixed[j] - 1]
        # What leaves this path at a piece: its other lengths. The best of them is a Gumbel draw below this value.
        wanted = k - turn  # one more than may still be opened, for the last bound
        gone = before - log
        spots = _leaving(lattices, pos, way, gone, cuts, wanted, left if later else None)
        sizes = [len(some) for some, _ in spots]
        step = np.concatenate([some for some, _ in spots]) - np.repeat(cuts[:-1], sizes)
        draws = truncated(np.concatenate([where for _, where in spots]), np.repeat(value, sizes), uniform(np.repeat(mixed(keys[mine], 5 + turn), sizes) ^ step.astype(np.uint64), 6))
        starts = np.cumsum([0, *sizes])
        for j, (i, (_, _, path, piece, barred)) in enumerate(opened):
            x, y = int(cuts[j]), int(cuts[j + 1])
            new = {"pos": pos[x:y], "unit": unit[x:y], "before": before[x:y], "raw": raw[x:y], "k": way[x:y]}
            if later and piece:
                new = {n: np.concatenate([old[j][n][:piece], v]) for n, v in new.items()}
            data = _ids(vocabulary, lattices, new["pos"], new["raw"]).astype("<u4").tobytes()
            out[i].append([len(data) // 4, float(new["before"][-1]) if len(new["before"]) else 0.0, float(value[j]), None, zlib.crc32(data), *([data] if with_ids else [])])
            paths[i][turn] = new
            here, steps = draws[starts[j] : starts[j + 1]], spots[j][0] - x
            best = np.argpartition(-here, wanted - 1)[:wanted] if len(here) > wanted else np.arange(len(here))
            for w, bound in zip(steps[best].tolist(), here[best].tolist()):
                p = piece + w
                heapq.heappush(queues[i], (-bound, turn * 10**9 + p, turn, p, (*barred, int(length[j])) if later and not w else (int(way[x + w]),)))
    for found, queue in zip(out, queues):
        beyond = -queue[0][0] if queue else -np.inf  # the largest value that is not taken
        for f in found:
            gap = f[1] - beyond
            f[3] = 0.0 if gap > 700 else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else float(gap)
    return [[tuple(f) for f in found] for found in out]


#: A Gumbel draw lies 3.63 below its location at most and 36.75 above it, as uniform() is 2**-54 at least and 1 - 2**-53 at most.
SPREAD = 41.0


def _leaving(lattices: Lattices, pos: np.ndarray, way: np.ndarray, gone: np.ndarray, cuts: np.ndarray, wanted: int, left: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each path, the pieces at which one of the wanted best draws can leave it, and the draws' locations.

    gone is the log chance of what comes before a piece, which falls along a path, so that a location is far below
    those of the first pieces soon. The paths' beginnings are looked at first, and the whole path only where they
    don't show that nothing beyond them is wanted. left is the mass that leaves at a branch's first piece.
    """
    first, last = cuts[:-1], cuts[1:]
    stop = np.array([x + np.searchsorted(-gone[x:y], 1.25 * SPREAD - gone[x], "right") if x < y else y for x, y in zip(first.tolist(), last.tolist())], np.int64)
    out, todo = [(np.zeros(0, np.int64), np.zeros(0))] * len(first), np.flatnonzero(first < last)
    while len(todo):
        sizes = (stop - first)[todo]
        ends = sizes.cumsum()
        some = np.arange(ends[-1]) + np.repeat(first[todo] - (ends - sizes), sizes)
        at, k = pos[some], way[some]
        mass, several = -np.expm1(lattices.of_pieces(lattices.log, at, k)), lattices.ways.take(at) > 1
        mass[~several] = 0.0
        small = np.flatnonzero(several & (mass < 1e-6))  # summed apart, where the difference from 1 is lost
        if len(small):
            others = lattices.log.take(at[small], 0)
            others[np.arange(len(small)), k[small]] = NONE
            real = others > NONE / 2
            mass[small] = np.where(real, np.exp(np.where(real, others, 0.0)), 0.0).sum(1)
        if left is not None:
            mass[ends - sizes] = left[todo]
        live = np.flatnonzero(mass > 0)
        some, where = some[live], gone[some[live]] + np.log(mass[live])
        again = []
        for j, x, y in zip(todo.tolist(), *(np.searchsorted(live, e).tolist() for e in (ends - sizes, ends))):
            here, least = where[x:y], -np.inf
            if y - x >= wanted:
                least = np.partition(here, y - x - wanted)[y - x - wanted] - SPREAD
            if stop[j] < last[j] and gone[stop[j]] > least:
                again.append(j)
            else:
                near = here >= least
                out[j] = some[x:y][near], here[near]
        todo = np.array(again, np.int64)
        stop[todo] = last[todo]
    return out


def _ids(v: Vocabulary, lattices: Lattices, pos: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """ids with the bytes of code points that are no piece."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    points = lattices.points[pos[bare]]
    data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    sizes = np.ones(len(ids), np.int64)
    sizes[bare] = _width(points)
    out = np.repeat(ids, sizes)
    out[out < 0] = v.byte_ids[data]
    return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each model and worker; workers outlive their tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to k rows per row of docs: doc_id, sample (from 0), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32.

    Rows of one text are distinct segmentations, in descending order of perturbed value; fewer than k come only if
    the text has fewer. log_inclusion is the log of the chance that the segmentation's value exceeds the largest
    value left out, the score by which sums over samples are weighted. Draws hang on the row's id, its text's
    place in it and seed alone: rows that repeat an id and text repeat its samples, and partitions do not matter.
    A null or empty text has one segmentation, without pieces. with_ids adds the ids as little-endian bytes;
    decode() turns them into the text again. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("key"))
    names = ["id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"id {dict(source.dtypes)['id']}, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long" + (", ids binary" if with_ids else "")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_path)
        for batch in batches:
            texts, keys, ids = [t or "" for t in batch["text"]], batch["key"].to_numpy().view(np.uint64), batch["id"].tolist()
            for a, b in slices(map(len, texts), 1_000_000):
                rows = [(i, n, *f) for i, found in zip(ids[a:b], sample_texts(v, texts[a:b], keys[a:b], k, with_ids)) for n, f in enumerate(found)]
                yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(draw, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the model's own (best) segmentation of each text as an array of ids; null stays null."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        found = vocabulary(model_path).model.encode([t or "" for t in texts], num_threads=1)
        return pd.Series([None if t is None else x for t, x in zip(texts, found)], dtype=object)

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of each array (or little-endian bytes) of ids; null stays null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = vocabulary(model_path).model
        return pd.Series([None if x is None else model.decode((np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.asarray(x)).astype(int).tolist()) for x in ids], dtype=object)

    return rows.withColumn(text_col, text(F.col(ids_col)))
