"""SentencePiece encoding and decoding, with segmentations sampled from the lattice without replacement."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import map_batches, rows_of, table, type_of

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Samples of a text, chunks that a task keeps lattices of, and chunks of texts that it works on at a time.
SAMPLES = 2
KEPT_CHUNKS = 350_000
AT_A_TIME = 100_000
SAMPLE = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"
SAMPLE_TYPE = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from seeds and numbers of draws."""
    x = mixed(mixed(seed + GOLDEN) + np.asarray(draw).astype(np.uint64) * GOLDEN)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


@functools.lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """The vocabulary: pieces by text, prefixes of pieces, and log-weights.

    A model of merges has ranks for scores; a piece of rank r weighs 1/(r + 2), as in Zipf's law. Other models' scores are log-probabilities and are taken as they are.
    """

    def __init__(self, path: str):
        self.model = sp = load(path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(n)])
        merges = bool(plain) and bool(np.all(score[plain] == np.round(score[plain])))
        self.weight = -np.log(2 + np.minimum(-score, n)) if merges else score
        self.byte_weight = -float(np.log(2 + n))
        self.ids = {sp.id_to_piece(i): i for i in plain}
        states = {"": 0}
        for piece in self.ids:
            for j in range(1, len(piece) + 1):
                states.setdefault(piece[:j], len(states))
        self.piece = np.full(len(states), -1, dtype=np.int32)  # of a trie's state
        self.piece[[states[x] for x in self.ids]] = list(self.ids.values())
        keys = np.array([states[x[:-1]] << 21 | ord(x[-1]) for x in states if x], dtype=np.int64)
        self.shift = np.uint64(64 - max(8, 2 + len(keys).bit_length()))
        self.keys, self.states = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64), np.zeros(1 << (64 - int(self.shift)), dtype=np.int64)
        left, values = keys, np.array([i for x, i in states.items() if x], dtype=np.int64)
        slot = self.slots(left)
        while len(left):
            free, at = np.unique(slot, return_index=True)
            at = at[self.keys[free] < 0]
            self.keys[slot[at]], self.states[slot[at]] = left[at], values[at]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left, values, slot = left[rest], values[rest], (slot[rest] + 1) % len(self.keys)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = np.array(self.bytes, dtype=np.int32)
        self.text = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in plain):
            raise ValueError("pieces that go over the end of a word aren't supported")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLDEN) >> self.shift).astype(np.int64)

    def follow(self, state: np.ndarray, character: np.ndarray) -> np.ndarray:
        """States of the trie behind the characters, -1 where no piece goes on so."""
        key = state << 21 | character
        slot = self.slots(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.states[slot], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.states[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; the space that encoding adds in front is taken away."""
        text = b"".join([self.text[i] for i in ids])
        return (text[1:] if text.startswith(b" ") else text).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def chunks(text: str) -> list[str]:
    """Maximal runs of spaces with the word behind them; no piece goes over a chunk's end. The space added in front is part of the first."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts and SPACE not in text:
        return parts  # the usual case: words by single spaces, the space in front of each understood
    return [c[1:] for c in CHUNK.findall(SPACE + text.replace(" ", SPACE))]


class Column:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind, first=()):
        self.space, self.n = np.array([*first, *[0] * 1024], dtype=kind), len(first)

    def __getitem__(self, at):
        """Elements by their places, which have to be those of elements."""
        return self.space[at]

    @property
    def last(self):
        return self.space[self.n - 1]

    @property
    def whole(self) -> np.ndarray:
        return self.space[: self.n]

    def __len__(self) -> int:
        return self.n

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.space):
            space = np.empty(max(self.n + len(more), len(self.space) * 3 // 2), dtype=self.space.dtype)
            space[: self.n] = self.space[: self.n]
            self.space = space
        self.space[self.n : self.n + len(more)] = more
        self.n += len(more)


class Numbers(dict):
    """Numbers of chunks in the order in which they are first asked for; those without a lattice yet are in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n


class Lattices:
    """Lattices of distinct chunks: nodes are places in a chunk, arcs are pieces with their probabilities given the node.

    An arc's probability is its weight times the sum of weights of all ways from its end over that from its start, so walks from
    a chunk's first node draw segmentations by their shares. A node's arcs lie together, the longest first, with cumulated probabilities.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.start = Column(np.int64)  # a chunk's first node
        self.best, self.best_at = Column(np.int32), Column(np.int64, [0])  # the library's pieces of chunks
        self.cum, self.log_p = Column(np.float64), Column(np.float64)
        self.next, self.arc_piece = Column(np.int32), Column(np.int32)  # a piece's id, or below 0 a character that stands for its bytes
        self.first = Column(np.int64, [0])  # a node's first arc

    def add(self, new: list[str]) -> None:
        pieces, base = self.pieces, len(self.first) - 1
        # the library adds the space in front itself, but not to an empty text
        alone = [pieces.ids[SPACE]] if SPACE in pieces.ids else [pieces.bytes[x] for x in SPACE.encode()]
        best = [x if c else alone for c, x in zip(new, pieces.model.encode([c.replace(SPACE, " ") for c in new], num_threads=1), strict=True)]
        sizes = np.fromiter(map(len, best), dtype=np.int64, count=len(best))
        self.best.add(np.fromiter(itertools.chain.from_iterable(best), dtype=np.int32, count=int(sizes.sum())))
        self.best_at.add(self.best_at.last + np.cumsum(sizes))
        characters = np.frombuffer((SPACE + SPACE.join(new)).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 1
        ends = np.cumsum(lengths)
        self.start.add(base + ends - lengths)
        end, n = np.repeat(ends, lengths), len(characters)
        at, state, single = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, bool)
        found, length = [], 1
        while len(at):
            state = pieces.follow(state, characters[at + length - 1])
            at, state = at[state >= 0], state[state >= 0]
            piece = pieces.piece[state]
            has = piece >= 0
            found.append((at[has], length, piece[has]))
            if length == 1:
                single[at[has]] = True
            inside = at + length < end[at]
            at, state, length = at[inside], state[inside], length + 1
        lone = np.flatnonzero(~single)
        c = characters[lone]
        found.append((lone, 1, (-1 - c).astype(np.int32)))
        starts = np.concatenate([x for x, _, _ in found])
        long = np.concatenate([np.full(len(x), k, dtype=np.int64) for x, k, _ in found])
        piece = np.concatenate([x for _, _, x in found])
        order = np.argsort(starts * (length + 1) - long)
        starts, long, piece = starts[order], long[order], piece[order]
        w = pieces.weight[np.maximum(piece, 0)]
        spelt = np.flatnonzero(piece < 0)
        c = -1 - piece[spelt]
        w[spelt] = pieces.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        # sums over all ways to the end, from the places nearest to it on
        rest = (end - np.arange(n)).astype(np.int16 if lengths.max() < 1 << 15 else np.int32)  # short integers sort quicker
        by = np.argsort(rest[starts], kind="stable")
        s, v = starts[by], w[by]
        ended = starts + long == end[starts]
        t = np.where(ended, n, starts + long)[by]
        log_sum = np.zeros(n + 1)  # the last stands for a chunk's end
        level = np.flatnonzero(np.diff(rest[s], prepend=-1, append=-1))
        head = np.diff(s, prepend=-1) != 0
        for a, b in zip(level[:-1], level[1:]):
            heads = np.flatnonzero(head[a:b])
            x = v[a:b] + log_sum[t[a:b]]
            top = np.maximum.reduceat(x, heads)
            log_sum[s[a:b][heads]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(heads, b - a)))), heads))
        p = np.exp(w + log_sum[np.where(ended, n, starts + long)] - log_sum[starts])
        heads = np.flatnonzero(np.diff(starts, prepend=-1))
        sizes = np.diff(np.append(heads, len(starts)))
        p /= np.repeat(np.add.reduceat(p, heads), sizes)
        cum = p.copy()
        for k in range(1, int(sizes.max())):
            more = heads[sizes > k] + k
            cum[more] += cum[more - 1]
        cum[heads + sizes - 1] = 1.0
        self.cum.add(cum)
        self.log_p.add(np.where(np.repeat(sizes, sizes) == 1, 0.0, np.log(np.maximum(p, 1e-300))))
        self.next.add(np.where(ended, -1, base + starts + long).astype(np.int32))
        self.arc_piece.add(piece)
        self.first.add(self.first.last + np.cumsum(sizes))

    def numbers(self, found: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))
        if self.known.new:
            self.add(self.known.new)
            self.known.new = []
        return out

    def encoded(self, numbers: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's pieces of chunks one behind the other, and where those of the texts between the cuts begin and end."""
        first = self.best_at[numbers]
        sizes = self.best_at[numbers + 1] - first
        ends = np.r_[0, np.cumsum(sizes)]
        return self.best[np.arange(int(ends[-1])) + np.repeat(first - ends[:-1], sizes)], ends[cuts]

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random way from each node to its chunk's end: (which of the nodes, arc), in order."""
        who, arcs, active, step = [], [], np.flatnonzero(nodes >= 0), 0
        at, seeds = nodes[active], mixed(seeds[active] + GOLDEN)
        while len(active):
            u = ((mixed(seeds + np.full(1, step, np.uint64) * GOLDEN) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
            arc = self.first[at]
            on = np.flatnonzero(u >= self.cum[arc])
            while len(on):
                arc[on] += 1
                on = on[u[on] >= self.cum[arc[on]]]
            who.append(active)
            arcs.append(arc)
            at = self.next[arc].astype(np.int64)
            go = np.flatnonzero(at >= 0)
            active, at, seeds, step = active[go], at[go], seeds[go], step + 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who_, arcs_ = np.concatenate(who), np.concatenate(arcs)
        order = np.argsort(who_.astype(np.int32), kind="stable")
        return who_[order], arcs_[order]

    def ids_of(self, arcs: np.ndarray) -> np.ndarray:
        out = self.arc_piece[arcs]
        spelt = np.flatnonzero(out < 0)
        if len(spelt):
            c = -1 - out[spelt]
            if c.max() < 128:  # line breaks, mostly
                out[spelt] = self.pieces.byte_ids[c]
            else:
                parts = [[x] if x >= 0 else [self.pieces.bytes[b] for b in chr(-1 - x).encode("utf-8", "replace")] for x in out.tolist()]
                return np.array(list(itertools.chain.from_iterable(parts)), dtype=np.int32)
        return out


class Drawn:
    """A segmentation of a text: its arcs and the chunks they are in; from `branch` on it is new, where `banned` arcs are closed."""

    def __init__(self, arcs, chunk, perturbed, branch=0, banned=(), before=0.0):
        self.arcs, self.chunk, self.perturbed, self.branch, self.banned, self.before, self.log_prob = arcs, chunk, perturbed, branch, banned, before, None  # before: the log-probability up to the branch


def sample(lattices: Lattices, texts: list[np.ndarray], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text (its chunks' numbers) up to k distinct segmentations as (arcs, log-probability, perturbed log-probability, inclusion score).

    Gumbel top-k by an A-star search, best first over perturbed log-probabilities: all segmentations are one region, whose largest perturbed
    value is a Gumbel number, and whose best one is a random way. What is left of a popped region is parted by the first arc
    that differs from the way found; the largest value of each part, a Gumbel number about the log of its share, cut off at the region's, waits in the queue. As
    values in the queue are exact, each pop gives the next segmentation of the order without replacement. One pop more gives the threshold of the inclusion scores
    1 - exp(-exp(log p - threshold)); if there are no more segmentations, scores are 1. All texts take their n-th pop together.
    """
    start = lattices.start
    n = len(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets, flat = np.cumsum(lengths) - lengths, np.concatenate([*texts, np.zeros(0, np.int64)])
    drawn: list[list[Drawn]] = [[] for _ in range(n)]
    queues: list[list[list]] = [[] for _ in range(n)]  # for each text, for each segmentation: values of its parts
    firsts = -np.log(-np.log(uniform(seeds, 1)))

    def ways(jobs: list[tuple[int, int, int]], round_: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For jobs (text, node or -1, chunk): ways from the node to the end of the chunk's place and through all chunks behind."""
        if not jobs:
            return []
        own, nodes, chunk = (np.array(x, dtype=np.int64) for x in zip(*jobs))
        sizes = lengths[own] - chunk
        heads = np.cumsum(sizes) - sizes
        job = np.repeat(np.arange(len(jobs)), sizes)
        place = np.arange(int(sizes.sum())) - heads[job] + chunk[job]
        at = start[flat[offsets[own][job] + place]]
        at[heads] = nodes
        seed = mixed(seeds[own] + GOLDEN * np.full(1, round_ + 2, np.uint64))[job] + (place + 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        who, arcs = lattices.walk(at, seed)
        place = place[who]
        cuts = np.searchsorted(who, [*heads.tolist(), len(job)]).tolist()
        return [(arcs[a:b], place[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def parts(found: list[tuple[int, Drawn]], number: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For segmentations of texts the values of the parts left of their regions, at arcs from the branch on, and the log-probabilities before these arcs."""
        sizes = np.array([len(x.arcs) - x.branch for _, x in found], dtype=np.int64)
        cuts = np.r_[0, np.cumsum(sizes)]
        log_p = lattices.log_p[np.concatenate([x.arcs[x.branch :] for _, x in found])]
        each = lambda values: np.repeat(np.array(values), sizes)
        before = np.empty(len(log_p))
        for a, b, (_, x) in zip(cuts[:-1].tolist(), cuts[1:].tolist(), found, strict=True):  # text by text, so that rounding doesn't depend on others
            before[a:b] = x.before
            before[a + 1 : b] += np.add.accumulate(log_p[a : b - 1])
            x.log_prob = float(before[b - 1] + log_p[b - 1])
        left = -np.expm1(log_p)
        for at, (_, x) in zip(cuts.tolist(), found):
            if x.banned:
                node, closed = node_of(x.arcs[x.branch]), {*x.banned, int(x.arcs[x.branch])}
                left[at] = sum(np.exp(lattices.log_p[a]) for a in range(int(lattices.first[node]), int(lattices.first[node + 1])) if a not in closed)
        own = np.repeat(mixed(mixed(seeds[[d for d, _ in found]] + GOLDEN * np.full(1, number + 100, np.uint64)) + GOLDEN), sizes)
        place = (np.arange(len(log_p)) - np.repeat(cuts[:-1], sizes) + 1).astype(np.uint64)
        u = ((mixed(own + place * GOLDEN) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
        with np.errstate(divide="ignore"):
            share = before + np.log(left)
            # -log(exp(-G) + E / share): a Gumbel number about the share, cut off at the region's value G
            values = -np.logaddexp(each([-x.perturbed for _, x in found]), np.log(-np.log(u)) - share)
        values[left <= 0] = -np.inf
        return [(values[a:b], before[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def node_of(arc: int) -> int:
        return int(np.searchsorted(lattices.first.whole, arc, side="right")) - 1

    whole = [(d, int(start[t[0]]), 0) for d, t in enumerate(texts) if len(t)]
    for (d, _, _), (arcs, place) in zip(whole, ways(whole, 0), strict=True):
        drawn[d].append(Drawn(arcs, place, float(firsts[d])))
    for d in range(n):
        if not len(texts[d]):
            drawn[d].append(Drawn(np.zeros(0, np.int64), np.zeros(0, np.int64), float(firsts[d])))
    thresholds = np.full(n, -np.inf)
    for number in range(1, k + 1):
        jobs, heads = [], []
        going = [d for d in range(n) if len(drawn[d]) == number and len(drawn[d][-1].arcs)]
        if not going:
            break
        for d, part in zip(going, parts([(d, drawn[d][-1]) for d in going], number), strict=True):
            queues[d].append(part)
            tops = [(float(q[i]), s, i) for s, (q, _) in enumerate(queues[d]) if len(q) for i in [int(q.argmax())]]
            value, s, i = max(tops, default=(-np.inf, 0, 0))
            if value == -np.inf:
                continue
            if number == k:
                thresholds[d] = value
                continue
            queues[d][s][0][i] = -np.inf
            parent = drawn[d][s]
            t = parent.branch + i
            banned = (*(parent.banned if i == 0 else ()), int(parent.arcs[t]))
            node = node_of(parent.arcs[t])
            siblings = [a for a in range(int(lattices.first[node]), int(lattices.first[node + 1])) if a not in banned]
            chances = np.exp(lattices.log_p[siblings])
            u = float(uniform(np.array([seeds[d]]), 1000 + number)[0]) * chances.sum()
            arc = siblings[min(int(np.searchsorted(np.cumsum(chances), u, side="right")), len(siblings) - 1)]
            chunk = int(parent.chunk[t])
            jobs.append((d, int(lattices.next[arc]), chunk))
            heads.append((parent, t, arc, banned, value, float(queues[d][s][1][i])))
        for (d, _, chunk), (parent, t, arc, banned, value, before), (arcs, place) in zip(jobs, heads, ways(jobs, number), strict=True):
            drawn[d].append(Drawn(np.r_[parent.arcs[:t], arc, arcs], np.r_[parent.chunk[:t], chunk, place], value, t, banned, before))
    out = []
    for d in range(n):
        rows = []
        for x in drawn[d][:k]:
            log_prob = float(lattices.log_p[x.arcs].sum()) if x.log_prob is None else x.log_prob
            inclusion = 1.0 if thresholds[d] == -np.inf else float(-np.expm1(-np.exp(min(50.0, log_prob - thresholds[d]))))
            rows.append((x.arcs, log_prob, x.perturbed, inclusion))
        out.append(rows)
    return out


def encode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = 0, kept_chunks: int = KEPT_CHUNKS, at_a_time: int = AT_A_TIME) -> DataFrame:
    """(key, ids, samples, decoded) of every whole text: the library's encoding, `samples` sampled segmentations with their scores, and the decoded text.

    Lattices are built once for each distinct chunk (a word with the spaces in front) that a task meets, and about `kept_chunks` of them are
    kept, a kilobyte each; fewer take more time and give the same rows, and so do fewer chunks worked on `at_a_time`. The text's lattice is the chain of its chunks' lattices. Draws depend on `seed`, the row's key and the text alone, not on how rows are dealt out. decoded: from
    the library's encoding, which is the text for a model that keeps all bytes. Null and empty texts have no pieces and one segmentation, the empty one.
    Keys are of any type; rows of one key and text draw alike, rows of one key draw from the same numbers, and null keys share one. Of equal chances the first in the lattice's order counts. A row gives a row, an
    empty table none; other columns aren't looked at.
    """
    kind = type_of(df, key)
    own_key = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(key).cast("string"))

    def work(lattices: Lattices, rows: pa.RecordBatch, keys: list, texts: list[str | None], parts: list[list[str]]):
        every = lattices.numbers(list(itertools.chain.from_iterable(parts)))
        cuts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(int)
        best, ends = lattices.encoded(every, cuts)
        own = np.array([hash_key(k, seed) for k in keys], dtype=np.uint64)
        found = sample(lattices, [every[a:b] for a, b in zip(cuts[:-1], cuts[1:])], own, samples) if samples else [[] for _ in keys]
        flat = [x for rows in found for x in rows]
        drawn = pa.StructArray.from_arrays([segmentations(lattices, [x[0] for x in flat]), *(pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3))], fields=list(SAMPLE_TYPE.value_type))
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        at = ends.tolist()
        decoded = [None if t is None else lattices.pieces.decode(best[a:b].tolist()) for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]
        return pa.record_batch([rows.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(best.astype(np.int32))), pa.ListArray.from_arrays(offsets, drawn, type=SAMPLE_TYPE), pa.array(decoded, pa.string())], ["k", "ids", "samples", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(pieces_of(model_path))
        for batch in batches:
            first, keys, texts, parts, size = 0, [], [], [], 0
            for k, t in zip(rows_of(batch, "h"), rows_of(batch, "x"), strict=True):
                keys.append(k)
                texts.append(t)
                parts.append(chunks(t or ""))
                size += len(parts[-1])
                if size >= at_a_time:
                    yield work(lattices, batch.slice(first, len(keys)), keys, texts, parts)
                    first, keys, texts, parts, size = first + len(keys), [], [], [], 0
                    if len(lattices.known) > kept_chunks:
                        lattices.clear()
            if keys:
                yield work(lattices, batch.slice(first, len(keys)), keys, texts, parts)

    schema = f"k {kind}, ids array<int>, samples {SAMPLE}, decoded string"
    return map_batches(df.select(F.col(key).alias("k"), own_key.alias("h"), F.col(text).alias("x")), run, schema).withColumnRenamed("k", key)


def segmentations(lattices: Lattices, arcs: list[np.ndarray]) -> pa.ListArray:
    """Pieces' ids of segmentations, all at once unless characters of several bytes are spelt."""
    every = np.concatenate([*arcs, np.zeros(0, np.int64)]).astype(np.int64)
    ids = lattices.ids_of(every)
    if len(ids) != len(every):
        return lists([lattices.ids_of(x) for x in arcs])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arcs)]), pa.int32()), pa.array(ids.astype(np.int32)))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)))


def decode(df: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of piece ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else pieces.decode(x) for x in rows_of(batch, "i")], pa.string())], ["k", "text"])

    return map_batches(df.select(F.col(key).alias("k"), F.col(ids).alias("i")), run, f"k {type_of(df, key)}, text string").withColumnRenamed("k", key)


def hash_key(key: int | None, seed: int) -> int:
    x = ((key if key is not None else -1) * 2 + 1 + seed * 0x51ED270B) % (1 << 64)
    return int(mixed(np.array([x], dtype=np.uint64))[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents by the 32k model: the encoding, digests of two sampled segmentations with their scores, and a digest of the decoded text."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    at = lambda i, f: F.get("samples", F.lit(i))[f]
    columns = [c for i in range(SAMPLES) for c in (F.size(at(i, "ids")).cast("long").alias(f"n_sampled_{i + 1}"), F.xxhash64(at(i, "ids")).alias(f"sampled_{i + 1}"), at(i, "log_prob").alias(f"log_prob_{i + 1}"), at(i, "inclusion").alias(f"inclusion_{i + 1}"))]
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.size("samples").cast("long").alias("n_samples"), *columns, F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
