"""Copies among images by local descriptors: crops, edits of brightness and contrast, and exact copies.

Corners at several scales get an orientation, from the intensity around them, and a string of binary tests turned
by it. All corners count, however many and weak, so a part of a picture keeps those it has in the whole. Descriptors
meet in a Hamming-table join, on equal 32-bit words of the string, and are compared in full;
pairs of images with several matches are verified by geometric consensus: they must agree on one shift, turn and
change of scale.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stored

SCALES = (1.0, 1 / 1.4, 1 / 2.0)
RADIUS, MARGIN = 9, 13
WORDS = 8  # of 32 binary tests each
#: Bits of 256 in which matching corners can differ.
APART = 32


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def encode_png(pixels: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PGM, PPM or PNG (8 bits, not interlaced) image; None for what is none of these."""
    try:
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            deep = 3 if data[:2] == b"P6" else 1
            pixels = np.frombuffer(data, np.uint8, head[0] * head[1] * deep, at + 1).reshape(head[1], head[0], deep)
            return pixels.astype(np.float32).mean(2)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (TypeError, ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed, kind = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if bits != 8 or interlace or kind not in (0, 2, 4, 6):
                return None
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if kind is None:
        return None
    deep = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * deep)
    out = np.zeros((height + 1, width + 1, deep), np.int64)  # with a row and column of zeros
    for y in range(height):
        f, line = raw[y, 0], raw[y, 1:].reshape(width, deep).astype(np.int64)
        up = out[y, 1:]
        if f == 0:
            out[y + 1, 1:] = line
        elif f == 1:
            out[y + 1, 1:] = line.cumsum(0) & 255
        elif f == 2:
            out[y + 1, 1:] = (line + up) & 255
        else:
            for x in range(width):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    colour = out[1:, 1:, : 3 if deep >= 3 else 1]
    return colour.astype(np.float32).mean(2)


def resized(pixels: np.ndarray, scale: float) -> np.ndarray:
    """By bilinear interpolation."""
    if scale == 1.0:
        return pixels
    h, w = (max(int(round(n * scale)), 1) for n in pixels.shape)
    y, x = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1) for n, m in ((h, pixels.shape[0]), (w, pixels.shape[1])))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, pixels.shape[0] - 1), np.minimum(x0 + 1, pixels.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    return (pixels[np.ix_(y0, x0)] * (1 - fx) + pixels[np.ix_(y0, x1)] * fx) * (1 - fy) + (pixels[np.ix_(y1, x0)] * (1 - fx) + pixels[np.ix_(y1, x1)] * fx) * fy


def _blurred(a: np.ndarray) -> np.ndarray:
    """Means over 5 x 5."""
    for axis in (0, 1):
        a = a.swapaxes(0, axis)
        n = len(a)
        c = np.zeros((n + 5, a.shape[1]))
        c[1:3], c[3 : n + 3], c[n + 3 :] = a[0], a, a[-1]
        c = np.cumsum(c, 0)
        a = ((c[5:] - c[:n]) / 5).swapaxes(0, axis)
    return a


def _highest(a: np.ndarray) -> np.ndarray:
    """Maxima over 5 x 5."""
    for axis in (0, 1):
        a = a.swapaxes(0, axis)
        n = len(a)
        p = np.pad(a, ((2, 2), (0, 0)), constant_values=-np.inf)
        a = np.maximum.reduce([p[k : n + k] for k in range(5)]).swapaxes(0, axis)
    return a


def _tests(seed: int = 29) -> np.ndarray:
    """Pairs of points in the disc around a corner, nearer ones more often."""
    rng = np.random.default_rng(seed)
    points = rng.normal(0, RADIUS / 2.2, (WORDS * 32 * 4, 2, 2))
    points = points[(np.hypot(points[..., 0], points[..., 1]) <= RADIUS).all(1)][: WORDS * 32]
    return points


TESTS = _tests()
_disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def descriptors(pixels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) in the image's own pixels, and WORDS 32-bit words, of all corners."""
    where, words = [np.zeros((0, 4))], [np.zeros((0, WORDS), np.uint32)]
    for scale in SCALES if pixels is not None else ():
        p = _blurred(resized(pixels, scale))
        if min(p.shape) <= 2 * MARGIN:
            continue
        gy, gx = np.gradient(p)
        xx, yy, xy = _blurred(gx * gx), _blurred(gy * gy), _blurred(gx * gy)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strength[MARGIN:-MARGIN, MARGIN:-MARGIN]
        y, x = np.nonzero((inner == _highest(inner)) & (inner > 1e-3))
        if not len(y):
            continue
        y, x = y + MARGIN, x + MARGIN
        ty, tx = TESTS[..., 0], TESTS[..., 1]
        for y, x in zip(*(np.split(v, range(2000, len(v), 2000)) for v in (y, x))):  # some at a time, as their discs take room
            patch = p[y[:, None] + _disc[:, 0], x[:, None] + _disc[:, 1]]
            angle = np.arctan2((patch * _disc[:, 0]).sum(1), (patch * _disc[:, 1]).sum(1))
            c, n = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            py, px = np.rint(c * ty + n * tx).astype(int) + y[:, None, None], np.rint(c * tx - n * ty).astype(int) + x[:, None, None]
            values = p[py, px]
            bits = values[..., 0] < values[..., 1]
            words.append(np.packbits(bits, axis=1).view(">u4").astype(np.uint32))
            where.append(np.stack([x / scale, y / scale, np.full(len(y), scale), angle], 1))
    return np.concatenate(where), np.concatenate(words)


def consensus(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0) -> int:
    """How many of the matches a[i], b[i] (x, y, scale, angle) the best one's similarity transform explains."""
    turn = b[:, 3] - a[:, 3]
    size = a[:, 2] / b[:, 2]
    cos, sin = (size * np.cos(turn))[:, None], (size * np.sin(turn))[:, None]
    # a corner of either image counts once: matches in order of its spot, and where spots begin
    spots = []
    for m in (a, b):
        at = np.round(m[:, :2] / 2).astype(np.int64) @ [1 << 32, 1]
        order = at.argsort(kind="stable")
        spots.append((order, np.flatnonzero(np.diff(at[order], prepend=at[order[:1]] - 1))))
    best, step = 0, max(1, (1 << 20) // max(len(a), 1))
    for k in range(0, len(a), step):
        h = slice(k, k + step)
        dx, dy = a[None, :, 0] - a[h, None, 0], a[None, :, 1] - a[h, None, 1]
        good = np.hypot(b[h, None, 0] + cos[h] * dx - sin[h] * dy - b[None, :, 0], b[h, None, 1] + sin[h] * dx + cos[h] * dy - b[None, :, 1]) <= tolerance
        good &= np.abs((turn[None] - turn[h, None] + np.pi) % (2 * np.pi) - np.pi) <= 0.4
        good &= np.abs(np.log(size[None] / size[h, None])) <= 0.4  # a step of SCALES
        agree = good.sum(1)
        if len(good := good[agree > best]):
            best = max(best, int(np.minimum(*(np.logical_or.reduceat(good[:, order], first, axis=1).sum(1) for order, first in spots)).max()))
    return best


#: Corners of images and of queries in a block, about; an image is in one block whole. Corner pairs looked at at once, about.
IMAGE_BLOCK, QUERY_BLOCK, AT_ONCE = 1 << 19, 1 << 18, 1 << 19
#: Those compared at once, so that what is looked at stays in a core's cache.
COMPARED = 1 << 15


class _Block:
    """Images of a table by rep, each class once: their corners' words and places, and where each image's corners begin."""

    def __init__(self, rows: pa.Table):
        first = {k: i for i, k in reversed(list(enumerate(rows["key"].to_pylist())))}
        rows = rows.take(sorted(first.values()))
        self.reps, self.sizes = (rows[c].to_numpy() for c in ("rep", "size"))
        words = rows["words"].to_pylist()
        self.starts = np.concatenate([[0], np.cumsum([len(w) // (4 * WORDS) for w in words])]).astype(np.int64)
        self.words = np.frombuffer(b"".join(words), "<u4").reshape(-1, WORDS)
        self.parts = self.words.view("<u8")
        self.places = np.concatenate([np.frombuffer(d, "<f4").reshape(4, -1).T for d in rows["places"].to_pylist()])
        self.image = np.repeat(np.arange(len(words)), np.diff(self.starts))


def _near(have: _Block, want: _Block, first: int, last: int, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Corners of want, and of have from first to last, that have an equal word and are APART bits apart at most; each pair once."""
    found = [(np.zeros(0, np.int64),) * 2]
    for t, (order, low, count) in enumerate(tables):
        some = first + np.flatnonzero(count[first:last])
        if not len(some):
            continue
        some = some[np.argsort(low[some])]  # corners with one word in a row, so that what they meet is at hand
        upto = np.cumsum(count[some], dtype=np.int64)
        stops = np.unique(np.minimum(np.searchsorted(upto, np.arange(COMPARED, upto[-1] + COMPARED, COMPARED)) + 1, len(some))).tolist()
        for f, g in zip([0, *stops], stops):
            n = count[some[f:g]]
            ends = np.cumsum(n)
            i = order[np.arange(ends[-1]) + np.repeat(low[some[f:g]] - ends + n, n)]
            j = np.repeat(some[f:g], n)
            apart = want.parts.take(i, 0)
            apart ^= have.parts.take(j, 0)
            bits = np.bitwise_count(apart).astype(np.uint16)
            near = np.flatnonzero(bits[:, 0] + bits[:, 1] + bits[:, 2] + bits[:, 3] <= APART)
            if t:  # pairs with an equal word before have been found there
                words, new = apart.view("<u4").take(near, 0), np.ones(len(near), bool)
                for k in range(t):
                    new &= words[:, k] != 0
                near = near[new]
            found.append((i.take(near), j.take(near)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _together(turn: np.ndarray, begin: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """Which groups of m matches from begin have least of them within a turn of 0.8, as any that agree with one of them within 0.4 do."""
    if not len(m):
        return np.zeros(0, bool)
    start = np.cumsum(m) - m
    at = np.arange(m.sum()) - np.repeat(start, m)
    group = np.repeat(np.arange(len(m)), m)
    turn = turn[at + np.repeat(begin, m)] % (2 * np.pi)
    turn = turn[np.argsort(group * 8.0 + turn)]  # a turn is less than 8
    end = at + least - 1
    over = end >= m[group]  # round the circle
    wide = turn[start[group] + end - over * m[group]] + over * (2 * np.pi) - turn
    return np.logical_or.reduceat(wide <= 0.8 + 1e-5, start)


def _hopeful(a: np.ndarray, b: np.ndarray, edges: np.ndarray, least: int, tolerance: float = 3.0) -> np.ndarray:
    """Which groups of matches, from edges[k] to edges[k + 1], have one that least of its group agree with, as in consensus but for a hair."""
    m = np.diff(edges)
    out = m > 64  # these are left to consensus
    turn = b[:, 3] - a[:, 3]
    few = np.flatnonzero(~out)
    few = few[_together(turn, edges[few], m[few], least)]
    size = a[:, 2] / b[:, 2]
    log, cos, sin = np.log(size), size * np.cos(turn), size * np.sin(turn)
    for f, g in slices((m[few] ** 2).tolist(), AT_ONCE):
        k = few[f:g]
        begin, n = np.repeat(edges[k], m[k]), np.repeat(m[k], m[k])
        one = begin + np.arange(len(n)) - np.repeat(np.cumsum(m[k]) - m[k], m[k])
        h = np.repeat(one, n)
        x = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        good = np.flatnonzero((np.abs(log[x] - log[h]) <= 0.4 + 1e-6) & (np.abs((turn[x] - turn[h] + np.pi) % (2 * np.pi) - np.pi) <= 0.4 + 1e-6))
        h, x = h[good], x[good]
        dx, dy = a[x, 0] - a[h, 0], a[x, 1] - a[h, 1]
        off = (b[h, 0] + cos[h] * dx - sin[h] * dy - b[x, 0]) ** 2 + (b[h, 1] + sin[h] * dx + cos[h] * dy - b[x, 1]) ** 2
        agree = np.bincount(h[off <= (tolerance + 1e-6) ** 2], minlength=len(a))
        out[k] = np.maximum.reduceat(agree[one], np.cumsum(m[k]) - m[k]) >= least
    return out


def _agreements(have: _Block, want: _Block, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(query, image, class_size, matches, inliers) of the pairs of images with least inliers."""
    tables = []
    for x, y in zip(want.words.T, have.words.T):
        order = np.argsort(x, kind="stable").astype(np.int32)
        words, begin, n = np.unique(x[order], return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(words, y), len(words) - 1)
        tables.append((order, begin[at].astype(np.int32), np.where(words[at] == y, n[at], 0).astype(np.int32)))
    held = np.concatenate([[0], np.cumsum(sum(count for _, _, count in tables))])[have.starts]
    for first, last in slices(np.maximum(np.diff(held), len(want.reps)).tolist(), AT_ONCE):
        if held[first] == held[last]:
            continue
        i, j = _near(have, want, have.starts[first], have.starts[last], tables)
        pair = (have.image.take(j) - first) * len(want.reps) + want.image.take(i)
        some = np.flatnonzero((np.bincount(pair, minlength=1) >= least).take(pair))
        i, j, pair = i.take(some), j.take(some), pair.take(some)
        sort = np.argsort(pair)
        begin = np.flatnonzero(np.diff(pair[sort], prepend=-1))
        n = np.diff(begin, append=len(sort))
        sort, n = sort[np.repeat(n >= least, n)], n[n >= least]
        edges = np.concatenate([[0], np.cumsum(n)])
        i, j = i[sort], j[sort]
        a, b = want.places[i].astype(float), have.places[j].astype(float)
        for k in np.flatnonzero(_hopeful(a, b, edges, least)):
            s = slice(edges[k], edges[k + 1])
            inliers = consensus(a[s], b[s])
            if inliers >= least:
                y = have.image[j[edges[k]]]
                yield want.reps[want.image[i[edges[k]]]], have.reps[y], have.sizes[y], n[k], inliers


def copies(images: DataFrame, queries: DataFrame, least: int = 6, id_col: str = "image_id", data_col: str = "image") -> DataFrame:
    """Images that each query image is a copy, crop or edit of, or that are of it.

    Rows: query_id, image_id, class_size, matches, inliers. Images with the same bytes form a class, which image_id,
    its smallest id, stands for and class_size counts; classes are searched once, and so are queries of the same
    bytes, each of which gets its class's answers. matches counts pairs of corners with an equal word and APART bits apart at most, inliers those
    that the best similarity transform explains, at least least of them. Images of the query's own bytes are answers
    whatever their corners, so those without enough of them (small, flat or not readable) have fewer or none. Null
    images match nothing. An empty table gives no rows; other columns are ignored.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [descriptors(decode(d)) for d in batch.pop("data")]
            yield batch.assign(corners=[len(w) for w, _ in found], places=[w.astype("<f4").T.tobytes() for w, _ in found], words=[w.astype("<u4").tobytes() for _, w in found])

    def described(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """All images, their classes, and the rows of those that stand for a class. Bytes are described where they are read and never shuffled."""
        rows = df.where(F.col(data_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.sha2(F.col(data_col), 256).alias("key"), F.col(data_col).alias("data"))
        rows = stored(rows.mapInPandas(describe, "id long, key string, corners long, places binary, words binary"), name)
        classes = stored(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size")), f"{name}-classes")
        return rows, classes, rows.withColumnRenamed("id", "rep").join(classes, ["key", "rep"])

    have, have_classes, have_reps = described(images, "corners")
    want, want_classes, want_reps = described(queries, "asked")
    # Hamming tables: corners within 7 bits of each other share one of 8 words at least. Words of pictures are far from even: two
    # images share some by chance, so each pair of a block of images and one of queries meets in a task, which looks words up and
    # compares the corners at once. Only pairs of images that agree come out, and what is moved is a few bytes for each pair.
    blocks = lambda df, size: -(-(df.agg(F.sum("corners")).first()[0] or 1) // size)
    r, g = blocks(have, IMAGE_BLOCK), blocks(want, QUERY_BLOCK)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = lambda df, i, q: df.select(i.alias("i"), q.alias("q"), "rep", "key", "size", "places", "words").groupBy("i", "q")
    shape = "query long, image long, class_size long, matches long, inliers int"

    def agreed(images: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = dict(zip(("query", "image", "class_size", "matches", "inliers"), (pa.int64(),) * 4 + (pa.int32(),)))
        rows = list(_agreements(_Block(images), _Block(queries), least)) if images.num_rows and queries.num_rows else []
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.table({c: pa.array([int(v) for v in values], kind) for (c, kind), values in zip(kinds.items(), columns)})

    found = cells(have_reps, own(r), each(g)).cogroup(cells(want_reps, each(r), own(g))).applyInArrow(agreed, shape)
    same = want_classes.select("key", F.col("rep").alias("query")).join(have_classes.select("key", F.col("rep").alias("image"), F.col("size").alias("class_size")), "key").select("query", "image", "class_size", F.lit(0).cast("long").alias("matches"), F.lit(0).alias("inliers"))
    found = found.unionByName(same).groupBy("query", "image").agg(*[F.max(c).alias(c) for c in ("class_size", "matches", "inliers")])
    members = want.select(F.col("id").alias("query_id"), "key").join(want_classes.select("key", F.col("rep").alias("query")), "key")
    return members.join(found, "query").select("query_id", F.col("image").alias("image_id"), "class_size", "matches", "inliers")


def answers_by_query(found: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each of ids (query_id), from the rows of copies: a group of n copies gives its queries n rows there, and one here.

    class_id is the least image_id among a query's answers, null without any; n_links counts answers, n_images the images of
    their classes; best_id has the most inliers, the least id of those. links_xor is the exclusive or of xxhash64 of
    (image_id, class_size, matches, inliers) over all answers, so that no link can be lost unseen.
    """
    best = F.max_by("image_id", F.struct("inliers", -F.col("image_id")))
    tallies = found.groupBy("query_id").agg(F.min("image_id").alias("class_id"), F.count("*").alias("n_links"), F.sum("class_size").alias("n_images"), best.alias("best_id"), F.max("inliers").alias("best_inliers"), F.bit_xor(F.xxhash64("image_id", "class_size", "matches", "inliers")).alias("links_xor"))
    return ids.select("query_id").distinct().join(tallies, "query_id", "left").na.fill(0, ["n_links", "n_images", "best_inliers", "links_xor"])


# ---- a table of images ----

SIDE = 96


def _waves(seed: int = 41) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    fx, fy, phase = rng.uniform(-9, 9, 64), rng.uniform(-9, 9, 64), rng.uniform(0, 2 * np.pi, 64)
    return np.cos(2 * np.pi * (fx[:, None, None] * x + fy[:, None, None] * y) + phase[:, None, None])


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", edited: bool = False) -> DataFrame:
    """image_id and image: a 96 x 96 PGM of 64 waves weighted by each vector's first 64 values; null vectors give null.

    With edited, a copy with its left and upper eighth cut off and contrast and brightness changed.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waves = _waves()
        for batch in batches:
            out = []
            for v in batch["v"]:
                if v is None:
                    out.append(None)
                    continue
                v = np.nan_to_num(np.asarray(v, float)[:64])
                p = np.tensordot(v, waves[: len(v)], 1)
                p = np.clip(128 + 42 * p / max(p.std(), 1e-9), 0, 255)
                if edited:
                    p = np.clip(p[SIDE // 8 :, SIDE // 8 :] * 0.8 + 30, 0, 255)
                out.append(encode_pgm(np.rint(p)))
            yield pd.DataFrame({"image_id": batch["image_id"], "image": out})

    return vectors.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col).alias("v")).mapInPandas(draw, "image_id long, image binary")
