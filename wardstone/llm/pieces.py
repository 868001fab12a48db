"""SentencePiece encoding and decoding, with sampled segmentations: Gumbel top-k without replacement.

A text's lattice has an arc for every vocabulary piece at every place (and the byte pieces of a character that no piece
covers). Arcs weigh as under a unigram model whose piece probabilities follow Zipf's law over the model's own order of
pieces. Each arc carries its probability given its node, so a path's probability is a product and every node's subtree has
an exact bound.

Search: the root's perturbed value is a Gumbel draw. Expanding a node hands its value to one child, drawn in proportion, and
gives the siblings values drawn from Gumbels truncated at it; a priority queue holds all sibling groups that hang off the
paths found so far. The k best leaves are k distinct segmentations, sampled without replacement. The largest value left in
the queue is the threshold of the inclusion scores: log(1 - exp(-exp(log_prob - threshold))), the log of the probability that
this segmentation is among those sampled. Draws are hashes of (seed, row key, sample, place), so no split of the data
changes them.

The lattice falls into segments that no piece crosses; lattices of segments are remembered by each worker, up to a bound.

A null or empty text has one empty segmentation. Texts with fewer than k segmentations give all they have, with log
inclusion 0. Rows with equal keys and texts get equal samples; a null key is hashed as such. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
KNOWN = 300_000  # chunks that a worker remembers
ROOM = 2_400_000  # arcs for which arrays have room at first
BATCH_CHARS = 1 << 20
LATIN = 0x250  # code points below are looked up: a chunk ends before a mark after one of these letters


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((_mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _draw(key: int, sample: int, number: int) -> float:
    """As ``_unit``, of one number."""
    x = (key + sample * 0x165667B19E3779F9 + number) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (((x ^ (x >> 31)) >> 12) + 0.5) * 2.0**-52


_STEP, _PLACE, _SAMPLE = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Lattices:
    """Nodes and arcs of all remembered segments in flat arrays."""

    def __init__(self, model: str):
        import sentencepiece

        self.known = KNOWN
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.byte = {int(pieces[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        order = sorted(plain, key=lambda i: (-self.sp.get_score(i), i)) + sorted(self.byte.values())
        total = sum(1 / (r + 2) for r in range(len(order)))
        self.weight = {i: -log((r + 2) * total) for r, i in enumerate(order)}
        self.vocab = {pieces[i]: i for i in plain}
        self.heads = {p[:k] for p in self.vocab for k in range(1, len(p) + 1)}
        self.crossing = any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.vocab)
        # a chunk also ends before a mark that no piece holds after a letter
        marks = [m for m in ".,!?;:#$%&*|\"" if not any(re.search(rf"[^\W\d_]{re.escape(m)}", p) for p in self.vocab)]
        self.letter, self.mark = np.zeros((2, LATIN + 1), bool)
        self.letter[[c for c in range(LATIN) if chr(c).isalpha()]] = True
        self.mark[[ord(m) for m in marks]] = True
        self.surface = [pieces[i].encode() for i in range(n)]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.surface_size = np.array([len(x) for x in self.surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.single = {p for p in self.vocab if len(p) == 1}
        heads = sorted(self.heads, key=lambda p: (len(p), p))
        number = {"": 0} | {p: i + 1 for i, p in enumerate(heads)}
        edges = sorted((number[p[:-1]] << 21 | ord(p[-1]), number[p]) for p in heads)
        self.trie_key, self.trie_next = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.trie_piece = np.array([-1] + [self.vocab.get(p, -1) for p in heads], np.int64)
        self.weights = np.zeros(n)
        self.weights[list(self.weight)] = list(self.weight.values())
        self.forget()

    def forget(self) -> None:
        self.chunk_hash = np.zeros(0, np.uint64)  # of remembered chunks, sorted, and the first node of each
        self.chunk_node = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # first arc of each node; a node's arcs are those before the next node's
        self.log_p = np.zeros(0)
        self.upto = np.zeros(0)  # running sum of probabilities within the node
        self.piece = np.zeros(0, np.int32)
        self.next = np.zeros(0, np.int32)  # node, -1 at the segment's end
        self.new: tuple[list, ...] = ([], [], [], [], [])
        self.nodes = self.arcs = self.nodes_kept = self.arcs_kept = 0

    def _keep(self) -> None:
        """Moves new nodes and arcs to the flat arrays, which double when they are full."""
        first, log_p, upto, piece, after = (np.concatenate(x) for x in self.new)
        self.new = ([], [], [], [], [])
        n, m = self.nodes_kept, self.arcs_kept
        for name, need in (("first", self.nodes + 1), ("log_p", self.arcs), ("upto", self.arcs), ("piece", self.arcs), ("next", self.arcs)):
            if need > len(old := getattr(self, name)):
                grown = np.zeros(max(ROOM, 2 * need), old.dtype)  # memory is taken only as it is written
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.first[n : self.nodes] = first
        self.first[self.nodes] = self.arcs
        self.log_p[m : self.arcs], self.upto[m : self.arcs], self.piece[m : self.arcs], self.next[m : self.arcs] = log_p, upto, piece, after
        self.nodes_kept, self.arcs_kept = self.nodes, self.arcs

    def _segment(self, s: str) -> int:
        """Appends the lattice of one segment; its first node."""
        n = len(s)
        begin, arcs = self.nodes, []  # by place: (weight, piece ids, next place)
        for i in range(n):
            own = []
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in self.heads:
                    break
                if (k := self.vocab.get(p)) is not None:
                    own.append((self.weight[k], (k,), j))
            if not own or own[0][2] != i + 1:  # no piece for the character alone: its bytes
                ids = tuple(self.byte[b] for b in s[i].encode("utf-8", "replace"))
                own.insert(0, (sum(self.weight[k] for k in ids), ids, i + 1))
            arcs.append(own)
        ahead = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            v = [w + ahead[j] for w, _, j in arcs[i]]
            top = max(v)
            ahead[i] = v[0] if len(v) == 1 else top + log(sum(exp(x - top) for x in v))
        first, log_p, upto, piece, after = lists = ([], [], [], [], [])
        extra = begin + n  # nodes between the bytes of one character follow the places
        tail: list[tuple[int, int]] = []  # (piece, next)
        for i in range(n):
            first.append(self.arcs)
            run, own = 0.0, arcs[i]
            for w, ids, j in own:
                lp = 0.0 if len(own) == 1 else min(0.0, w + ahead[j] - ahead[i])
                run += exp(lp)
                log_p.append(lp)
                upto.append(run)
                piece.append(ids[0])
                end = begin + j if j < n else -1
                if len(ids) > 1:
                    after.append(extra + len(tail))
                    tail += [(k, extra + len(tail) + t + 1 if t < len(ids) - 2 else end) for t, k in enumerate(ids[1:])]
                else:
                    after.append(end)
                self.arcs += 1
            upto[-1] = 1.0
        for k, end in tail:
            first.append(self.arcs)
            log_p.append(0.0)
            upto.append(1.0)
            piece.append(k)
            after.append(end)
            self.arcs += 1
        self.nodes += n + len(tail)
        for new, x in zip(self.new, lists, strict=True):
            new.append(np.array(x))
        return begin

    def _many(self, segments: list[str]) -> list[int]:
        """Appends the lattices of many short segments at once, by steps over all their characters."""
        size = np.array([len(x) for x in segments])
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        end = np.repeat(np.cumsum(size), size)
        place, state, starts, stops, ids = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], [], []
        at = place
        while len(place):  # all substrings that begin a piece, one character longer each round
            key = state << 21 | codes[at]
            i = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            ok = self.trie_key[i] == key
            place, state, at = place[ok], self.trie_next[i[ok]], at[ok] + 1
            piece = self.trie_piece[state]
            got = piece >= 0
            starts.append(place[got])
            stops.append(at[got])
            ids.append(piece[got])
            on = at < end[place]
            place, state, at = place[on], state[on], at[on]
        start, stop, piece = (np.concatenate(x) for x in (starts, stops, ids))
        order = np.argsort(start, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        count = np.bincount(start, minlength=len(codes))
        first = np.concatenate([[0], np.cumsum(count)])
        weight = self.weights[piece]
        ahead = np.zeros(len(codes) + 1)
        log_p = np.zeros(len(start))
        left = end - np.arange(len(codes))
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
        last = stop == end[start]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # from the segments' ends backwards
            nodes = by_left[lo:hi]
            n = count[nodes]
            edge = np.cumsum(n) - n
            arcs = np.repeat(first[nodes] - edge, n) + np.arange(n.sum())
            v = weight[arcs] + np.where(last[arcs], 0.0, ahead[stop[arcs] - (stop[arcs] == len(codes))])
            top = np.maximum.reduceat(v, edge)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), edge))
            ahead[nodes] = total
            log_p[arcs] = np.where(np.repeat(n, n) == 1, 0.0, np.minimum(0.0, v - np.repeat(total, n)))
        run = np.cumsum(np.exp(log_p))
        upto = run - np.repeat(np.concatenate([[0.0], run])[first[:-1]], count)
        upto[first[1:] - 1] = 1.0
        for new, x in zip(self.new, (first[:-1] + self.arcs, log_p, upto, piece, np.where(last, -1, stop + self.nodes)), strict=True):
            new.append(x)
        begins = self.nodes + np.cumsum(size) - size
        self.nodes += len(codes)
        self.arcs += len(start)
        return begins.tolist()

    def cut(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where chunks begin in joined texts: at a text, before marks of spaces, around line ends, before marks after letters."""
        begin = np.zeros(len(codes), bool)
        begin[edges[:-1][np.diff(edges) > 0]] = True
        if not self.crossing:
            gap, line, low = codes == ord(SPACE), codes == 10, np.minimum(codes, LATIN)
            begin[1:] |= (gap[1:] & ~gap[:-1]) | line[1:] | line[:-1] | (self.mark[low[1:]] & self.letter[low[:-1]])
        return np.flatnonzero(begin)

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """First nodes of the segments of each normalised text. Chunks are known by 64-bit hashes of their characters."""
        if len(self.chunk_hash) > self.known:
            self.forget()
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0] + [len(t) for t in texts])
        begin = self.cut(codes, edges)
        if not len(begin):
            return [np.zeros(0, np.int64) for _ in texts]
        size = np.diff(begin, append=len(codes))
        place = np.arange(len(codes)) - np.repeat(begin, size)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max()), _STEP))
            hashes = _mix(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * power[place], begin) + size.astype(np.uint64))
        del place
        own, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~np.isin(own, self.chunk_hash, assume_unique=True))
        if len(fresh):
            chunks = [joined[a : a + n] for a, n in zip(begin[where[fresh]].tolist(), size[where[fresh]].tolist(), strict=True)]
            short = np.array([len(c) <= 48 and self.single.issuperset(c) for c in chunks])
            node = np.zeros(len(chunks), np.int64)
            if short.any():
                node[short] = self._many([chunks[i] for i in np.flatnonzero(short)])
            for i in np.flatnonzero(~short):
                node[i] = self._segment(chunks[i])
            self._keep()
            order = np.argsort(every := np.concatenate([self.chunk_hash, own[fresh]]))
            self.chunk_hash, self.chunk_node = every[order], np.concatenate([self.chunk_node, node])[order]
        nodes = self.chunk_node[np.searchsorted(self.chunk_hash, own)][back]
        return np.split(nodes, np.searchsorted(begin, edges[1:-1]))

    def restores(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the pieces' surfaces, joined, are ``raw``."""
        size = self.surface_size[ids]
        total = int(size.sum())
        if total != len(raw):
            return False
        at = np.arange(total) + np.repeat(self.surface_at[ids] - np.cumsum(size) + size, size)
        return self.surface_bytes[at].tobytes() == raw

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of one sampled path from every node to its segment's end, one after the other; where each begins."""
        steps, active, at = [], np.flatnonzero(nodes >= 0), nodes
        count = np.zeros(len(nodes) + 1, np.int64)
        at, seed, t = nodes[active], seeds[active], 0
        with np.errstate(over="ignore"):
            while len(active):
                arc = self.first[at]
                many = np.flatnonzero(self.first[at + 1] - arc > 1)
                if len(many):
                    u = _unit(seed[many] + np.uint64(t + 1) * _STEP)
                    a = arc[many]
                    left = np.flatnonzero(u > self.upto[a])
                    while len(left):
                        a[left] += 1
                        left = left[u[left] > self.upto[a[left]]]
                    arc[many] = a
                steps.append((active, arc))
                count[active + 1] += 1
                at = self.next[arc]
                on = at >= 0
                active, at, seed, t = active[on], at[on], seed[on], t + 1
        where = np.cumsum(count)
        out = np.empty(where[-1], np.int64)
        for t, (who, arc) in enumerate(steps):
            out[where[who] + t] = arc
        return out, where


REACH = 256


def siblings(log_p: np.ndarray, edges: np.ndarray, before: list[int], passed: list[float], values: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Of each path, whose fresh arcs are log_p[edges[i] : edges[i + 1]] after ``before`` others, the values and places of the
    k + 1 best sibling groups.

    A group's value exceeds the log of its mass by 37 at most (draws have 52 bits), so once k + 1 values among the first
    places are above that, later places can't be among the best; else all places are looked at.
    """
    size = np.diff(edges)

    def best(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the best groups among the first places, their places, and the log of the mass after those places."""
        inside = np.arange(width) < size[rows, None]
        lp = np.zeros((len(rows), width))
        lp[inside] = log_p[(edges[rows, None] + np.arange(width))[inside]]
        upto = np.cumsum(lp, axis=1) + np.array(passed)[rows, None]
        place = np.array(before)[rows, None] + np.arange(width)
        at = lp < 0
        bound = np.full(lp.shape, -np.inf)
        mass = upto[at] - lp[at] + np.log(-np.expm1(lp[at]))
        draw = np.repeat(_mix(keys[rows] ^ np.uint64(0x5555)), at.sum(axis=1)) + place[at].astype(np.uint64) * _PLACE
        bound[at] = -np.logaddexp(-np.repeat(values[rows], at.sum(axis=1)), np.log(-np.log(_unit(draw))) - mass)
        top = np.argpartition(-bound, min(k, width - 1), axis=1)[:, : k + 1]
        return np.take_along_axis(bound, top, 1), np.take_along_axis(place, top, 1), upto[:, -1]

    out: list[list[tuple[float, int]]] = [[] for _ in before]
    rows = np.flatnonzero(size)
    width = max(k + 1, REACH)
    while len(rows):
        far = []
        for part in (rows[i : i + max(1, (1 << 20) // width)] for i in range(0, len(rows), max(1, (1 << 20) // width))):
            bound, place, upto = best(part, width)
            done = (size[part] <= width) | (bound.min(axis=1) > upto + 37)
            for i, b, p in zip(part[done].tolist(), bound[done].tolist(), place[done].tolist(), strict=True):
                out[i] = [(x, y) for x, y in zip(b, p, strict=True) if x > -np.inf]
            far.append(part[~done])
        rows = np.concatenate(far)
        width = min(width * 8, max(width, int(size[rows].max(initial=0))))
    return out


def sample(texts: list[str], keys: np.ndarray, k: int, lat: Lattices) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each normalised text its sampled segmentations: (piece ids, log_prob, perturbed value, log_inclusion)."""
    segments = lat.starts(texts)
    found: list[list] = [[] for _ in texts]
    queues: list[list] = [[] for _ in texts]
    paths: list[list[np.ndarray]] = [[] for _ in texts]
    todo = []  # (text, arcs before, first segment to walk, node to start at or -1, value)
    with np.errstate(over="ignore", divide="ignore"):
        roots = -np.log(-np.log(_unit(keys + _SAMPLE)))
        for i, s in enumerate(segments):
            if len(s):
                todo.append((i, np.zeros(0, np.int64), 0, -1, roots[i]))
            else:
                found[i].append((np.zeros(0, np.int32), 0.0, float(roots[i]), 0.0))
        for j in range(1, k + 1):
            if not todo:
                break
            nodes = [np.concatenate([[n], segments[i][s:]]) for i, _, s, n, _ in todo]
            base = keys[[i for i, *_ in todo]] + np.uint64(j + 1) * _SAMPLE
            size = np.array([len(x) for x in nodes])
            edge = np.concatenate([[0], np.cumsum(size)])
            number = np.arange(edge[-1]) - np.repeat(edge[:-1] - np.array([s for _, _, s, _, _ in todo]), size)
            arcs, where = lat.walk(np.concatenate(nodes), _mix(np.repeat(base, size) + number.astype(np.uint64) * _PLACE))
            fresh = lat.log_p[arcs], lat.piece[arcs]
            bounds = where[edge].tolist()
            for (i, before, _, _, value), b, e, end in zip(todo, base, bounds[:-1], bounds[1:], strict=True):
                path, lp, ids = arcs[e:end], fresh[0][e:end], fresh[1][e:end]
                if len(before):
                    path, lp, ids = (np.concatenate(x) for x in ((before, path), (lat.log_p[before], lp), (lat.piece[before], ids)))
                paths[i].append(path)
                found[i].append([ids, float(lp.sum()), float(value), 0.0])
            before = [len(t[1]) for t in todo]
            groups = siblings(fresh[0], where[edge], before, [float(lat.log_p[t[1]].sum()) for t in todo], np.array([t[4] for t in todo]), base, k)
            for (i, *_), group in zip(todo, groups, strict=True):
                for bound, place in group:
                    heapq.heappush(queues[i], (-bound, len(paths[i]) - 1, place, (int(paths[i][-1][place]),)))
            if j == k:
                break
            tasks, todo = todo, []
            for i, *_ in tasks:
                if not queues[i]:
                    continue
                value, p, place, gone = heapq.heappop(queues[i])
                value = -value
                path = paths[i][p]
                node = int(np.searchsorted(lat.first[: lat.nodes + 1], path[place], side="right")) - 1
                rest = [a for a in range(int(lat.first[node]), int(lat.first[node + 1])) if a not in gone]
                share = np.exp(lat.log_p[rest]).tolist()
                u, at = _draw(int(keys[i]), j, 7) * sum(share), 0
                while at < len(rest) - 1 and u > share[at]:
                    u, at = u - share[at], at + 1
                arc = rest[at]
                left = sum(share) - share[at]
                if len(rest) > 1 and left > 0:
                    mass = float(lat.log_p[path[:place]].sum()) + log(left)
                    draw = -log(_draw(int(keys[i]), j, 11))
                    heapq.heappush(queues[i], (float(np.logaddexp(-value, log(draw) - mass)), p, place, (*gone, arc)))
                ended = int(np.count_nonzero(lat.next[path[:place]] < 0))  # segments that the shared part has finished
                todo.append((i, np.append(path[:place], arc), ended + 1, int(lat.next[arc]), value))
    for i, rows in enumerate(found):
        top = -queues[i][0][0] if queues[i] else -np.inf
        for r in rows:
            if isinstance(r, list):
                x = r[1] - top
                r[3] = 0.0 if x > 30 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)
    return [[tuple(r) for r in rows] for rows in found]


_lattices: dict[str, Lattices] = {}


def lattices(model: str) -> Lattices:
    if model not in _lattices:
        _lattices[model] = Lattices(model)
    return _lattices[model]


def normalised(text: str | None) -> str:
    """As the model's own normaliser has it: a space in front, spaces as marks."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def decoded(ids: np.ndarray, lat: Lattices) -> str:
    """The text of piece ids, without the space in front."""
    text = b"".join(map(lat.surface.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


FULL = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"
DIGEST = "doc_id long, sample int, n_pieces long, ids_crc32 long, restored boolean, log_prob double, perturbed double, log_inclusion double"
TOGETHER = "doc_id long, ids array<array<int>>, log_prob array<double>, perturbed array<double>, log_inclusion array<double>"


def segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, keep: bool = True, together: bool = False) -> DataFrame:
    """k sampled segmentations of every text, as piece ids, or as their digest with the outcome of decoding them; ``together``
    gives a text one row with all its samples' ids. Without ``keep`` a worker takes smaller batches and forgets its lattices after each task, for jobs whose other stages need the memory."""

    names = DIGEST if digest else TOGETHER if together else FULL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        lat.known, most = (KNOWN, BATCH_CHARS) if keep else (KNOWN // 9, BATCH_CHARS // 2)

        def rows(ids: list, texts: list[str], hashes: list[int]) -> pa.RecordBatch:
            keys = _mix(np.array(hashes, np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            out = []
            for doc, text, found in zip(ids, texts, sample(texts, keys, k, lat), strict=True):
                if together and not digest:
                    out.append((doc, *([x[c] for x in found] for c in range(4))))
                    continue
                raw = text.encode("utf-8", "replace") if digest else b""
                for n, (pieces, lp, value, score) in enumerate(found):
                    if digest:
                        out.append((doc, n + 1, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), lat.restores(pieces, raw), lp, value, score))
                    else:
                        out.append((doc, n + 1, pieces, lp, value, score))
            kinds = [pa.int64(), pa.int32()] + ([pa.int64(), pa.int64(), pa.bool_()] if digest else [pa.list_(pa.int32())]) + [pa.float64()] * 3
            if together and not digest:
                kinds = [pa.int64(), pa.list_(pa.list_(pa.int32())), *[pa.list_(pa.float64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in names.split(", ")])

        for b in batches:
            ids, texts, hashes, size = [], [], [], 0
            for doc, text, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc)
                texts.append(normalised(text))
                hashes.append(h)
                size += len(texts[-1])
                if size >= most:
                    yield rows(ids, texts, hashes)
                    ids, texts, hashes, size = [], [], [], 0
            if ids:
                yield rows(ids, texts, hashes)
        if not keep:
            lat.forget()

    key = F.xxhash64(F.col(id_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key")).mapInArrow(run, names)


def encode(docs: DataFrame, model: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """Adds the library's own encoding of each text; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        sp = lattices(model).sp
        return pd.Series([None if t is None else sp.encode(t) for t in texts])

    return docs.withColumn(name, F.pandas_udf(run, "array<int>")(F.col(text_col)))


def decode(df: DataFrame, model: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """Adds the text of piece ids; null stays null."""

    def run(ids: pd.Series) -> pd.Series:
        lat = lattices(model)
        return pd.Series([None if x is None else decoded(np.asarray(x), lat) for x in ids])

    return df.withColumn(name, F.pandas_udf(run, "string")(F.col(ids_col)))


def model_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return segmentations(docs, model_path(path), digest=True)
