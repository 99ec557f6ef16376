"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it greedily: each phrase is the
longest match that some place of the labelled text continues, then the parse begins anew. The cost of a language is its
number of phrases times the bits that point into its labelled text, log2 of that text's length; the least cost wins.

Every letter is a symbol of its own, small and capital ones the same; whatever stands between letters is one symbol. The
automata are tables, or for languages with many letters hash tables, so that all lanes of a block are parsed in step. A long text is parsed in several lanes: each begins at a place of its own, goes on beyond its end until one of its
phrases begins where one of the lane there does, and from there both are the same parse. Followed from the text's start
over these meeting points, the lanes give exactly the phrases of the whole text.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm.text import by_block, field

#: The bounds of what is learned from: labelled texts of a language; code points after which no further text of a language is
#: taken, and of all languages together; and the length beyond which a text is only taken if a language has no shorter one.
TEXTS, SYMBOLS, ALL, LONGEST = 200, 48_000, 1_000_000, 20_000
#: Symbols that a lane begins with, and bytes of text that are parsed in step.
STRETCH, STEP = 256, 1 << 20
#: Letters up to which a language's automaton is a table.
FEW = 64
#: Lanes that are no longer taken in step.
ALONE = 32


@dataclass(frozen=True)
class Model:
    """The labelled text of each language, in the languages' order."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """What is learned of the rows that ``learn`` admits and whose text and lang aren't null.

    Of each language whole texts, in the order of their hashes, up to the bounds above; copies count once. A table without
    such rows gives a model without languages.
    """
    rows = docs.where(learn).select(field(docs, lang).cast("string").alias("lang"), field(docs, text).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("hash"), (F.length("text") > LONGEST).alias("long"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n")).collect()}  # one row for each language
    if not counts:
        return Model((), ())
    # of a language with many texts those under a hash that about twice as many as needed fall under
    under = [x for k, n in counts.items() for x in (F.lit(k), F.lit(int(-(2**63) + min(1.0, 2 * TEXTS / max(1, n)) * (2**64 - 1025))))]
    low = rows.where(~F.col("long") & (F.col("hash") <= F.create_map(*under)[F.col("lang")]))
    if not all(counts.values()):
        bare = rows.where(F.col("lang").isin([k for k, n in counts.items() if not n]))
        least = bare.groupBy("lang").agg(F.min(F.struct(F.length("text").alias("n"), "hash")).alias("m")).select("lang", "m.hash")
        low = low.unionByName(bare.join(F.broadcast(least), ["lang", "hash"]).select(*low.columns))  # one row for each language
    picked = low.groupBy("lang", "hash").agg(F.min("text").alias("text")).collect()
    got: dict[str, list[tuple[int, str]]] = {k: [] for k in sorted(counts)}
    for r in picked:
        got[r["lang"]].append((r["hash"], r["text"]))
    room = min(SYMBOLS, ALL // len(got))
    whole = []
    for v in got.values():
        taken: list[str] = []
        for _, t in sorted(v)[:TEXTS]:
            if sum(map(len, taken)) < room:
                taken.append(t)
        whole.append("\n".join(taken))
    return Model(tuple(got), tuple(whole))


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton: of each state, the next one by symbol. The start is state 0."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at >= 0:
            there = follow[at][c]
            if length[at] + 1 == length[there]:
                link[new] = there
            else:
                twin = len(follow)
                follow.append(dict(follow[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                while at >= 0 and follow[at].get(c) == there:
                    follow[at][c] = twin
                    at = link[at]
                link[there] = link[new] = twin
        last = new
    return follow


@functools.cache
def _folded() -> np.ndarray:
    """The symbol of each code point: the small form of a letter, 0 for all others."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        if chr(k).isalpha():
            low = chr(k).lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


class Dense:
    """The automaton of a language with few letters: a table of next states, 2 * state + whether a phrase begins, that has the restarts in it."""

    def __init__(self, text: np.ndarray):
        letters = np.unique(text)
        follow = automaton(np.searchsorted(letters, text))
        width, self.lost = len(letters) + 1, len(follow)
        self.column = np.full(0x110000, width - 1, np.int32)
        self.column[letters] = np.arange(width - 1)
        # the last column: symbols that the language lacks, each a phrase of its own
        table = np.full((self.lost + 1, width), -1, np.int32)
        for state, x in enumerate(follow):
            table[state, list(x)] = list(x.values())
        again = np.where(table[0] >= 0, table[0], self.lost)
        self.table, self.width = np.where(table >= 0, 2 * table, 2 * again[None, :] + 1).astype(np.int32).ravel(), width

    def own(self, symbols: np.ndarray) -> np.ndarray:
        """The columns of symbols."""
        return self.column[symbols]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = self.table[state * self.width + symbol]
        return code >> 1, code & 1

    def alone(self, state: int, symbols: np.ndarray, at: int, limit: int, fresh: np.ndarray) -> tuple[int, int]:
        """One parse on from ``at`` until a phrase begins where one begins anyhow, or to the limit: (phrases till then, where that is)."""
        table, seen, known, width, n = self.table.data, symbols.data, fresh.data, self.width, 0
        for k in range(at, limit):
            code = table[state * width + seen[k]]
            if code & 1:
                if known[k]:
                    return n, k
                n += 1
            state = code >> 1
        return n, limit


class Sparse:
    """The automaton of a language with many letters: a hash table from state and symbol to the next state."""

    def __init__(self, text: np.ndarray):
        follow = automaton(text)
        size = [len(x) for x in follow]
        self.lost = len(follow)
        keys = (np.repeat(np.arange(len(follow)), size) << 21) + np.array([c for x in follow for c in x], np.int64)
        self._place(keys, np.array([v for x in follow for v in x.values()], np.int64))

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: each key at the first free slot from that of its hash on."""
        self.shift = np.uint64(62 - max(1, len(keys)).bit_length())
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.zeros(len(self.keys), np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.unique(np.where(free, slot, -1), return_index=True)
            chosen = first[1][first[0] >= 0]
            self.keys[slot[chosen]], self.values[slot[chosen]] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        keys = (state.astype(np.int64) << 21) + symbol
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            out[open_] = np.where(found == keys[open_], self.values[slot[open_]], -1)
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return out

    def own(self, symbols: np.ndarray) -> np.ndarray:
        return symbols

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self._next(state, symbol)
        begins = np.flatnonzero(after < 0)
        if len(begins):
            again = self._next(np.zeros(len(begins), np.int64), symbol[begins])
            after[begins] = np.where(again < 0, self.lost, again)
        fresh = np.zeros(len(state), np.int32)
        fresh[begins] = 1
        return after, fresh

    def alone(self, state: int, symbols: np.ndarray, at: int, limit: int, fresh: np.ndarray) -> tuple[int, int]:
        """As Dense.alone()."""
        n, now = 0, np.array([state])
        for k in range(at, limit):
            now, began = self.step(now, symbols[k : k + 1])
            if began[0]:
                if fresh[k]:
                    return n, k
                n += 1
        return n, limit


class Lanes:
    """The lanes of a block's rows: STRETCH symbols each, the longest first."""

    def __init__(self, edge: np.ndarray):
        size = np.diff(edge)
        self.many = -(-size // STRETCH)
        self.first = np.cumsum(self.many) - self.many
        row = np.repeat(np.arange(len(size)), self.many)
        self.begin = edge[row] + STRETCH * (np.arange(len(row)) - np.repeat(self.first, self.many))
        self.limit = edge[row + 1].astype(np.int64)
        self.end = np.minimum(self.begin + STRETCH, self.limit)
        self.order = np.argsort(self.begin - self.end, kind="stable")
        self.edge = edge

    def phrases(self, one: Dense | Sparse, symbols: np.ndarray) -> np.ndarray:
        """The number of phrases of each row."""
        symbols, n = one.own(symbols), len(self.order)
        fresh, state = self.parsed(one, symbols)
        total = np.concatenate([[0], np.cumsum(fresh, dtype=np.int64)])
        # beyond its end each lane goes on until it meets the parse there, or for a while: the phrases till then, where that is, and the state if they haven't met
        more, meets, open_ = np.zeros(n, np.int64), self.limit.copy(), np.full(n, -1, np.int64)
        lane = np.flatnonzero(self.end < self.limit)
        at, state = self.end[lane].copy(), state[lane]
        for _ in range(STRETCH):
            if len(lane) <= ALONE:
                break
            state, began = one.step(state, symbols[at])
            met = (began & fresh[at]) == 1
            meets[lane[met]] = at[met]
            more[lane] += began & ~met
            at = at + 1
            live = ~met & (at < self.limit[lane])
            lane, at, state = lane[live], at[live], state[live]
        meets[lane], open_[lane] = at, state
        # each row from its first lane over the meeting points; a lane that hasn't met any goes on when a row comes by it
        out = np.zeros(len(self.many), np.int64)
        row = np.flatnonzero(self.many)
        at = self.edge[row].astype(np.int64)
        while len(row):
            own = self.first[row] + (at - self.edge[row]) // STRETCH
            out[row] += total[self.end[own]] - total[at] + more[own]
            at = meets[own]
            for k in np.flatnonzero(open_[own] >= 0).tolist():
                lane = int(own[k])
                if open_[lane] >= 0 and at[k] < self.limit[lane]:
                    n, at[k] = one.alone(int(open_[lane]), symbols, int(at[k]), int(self.limit[lane]), fresh)
                    out[row[k]] += n
            live = at < self.limit[own]
            row, at = row[live], at[live]
        return out

    def parsed(self, one: Dense | Sparse, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each lane's phrases begin, its state at its end)."""
        fresh, state = np.zeros(len(symbols), np.uint8), np.zeros(len(self.order), np.int64)
        width = 1 << 14
        for k in range(0, len(self.order), width):  # so many lanes at a time, their symbols side by side
            lane = self.order[k : k + width]
            place = self.begin[lane][:, None] + np.arange(self.end[lane[0]] - self.begin[lane[0]])
            inside = place < self.end[lane][:, None]
            seen = np.ascontiguousarray(symbols[np.minimum(place, len(symbols) - 1)].T)
            began, now = np.zeros(seen.shape, np.uint8), np.full(len(lane), one.lost)  # from which every symbol begins a phrase
            for t, n in enumerate(inside.sum(0).tolist()):
                now[:n], began[t, :n] = one.step(now[:n], seen[t, :n])
            fresh[place[inside]] = began.T[inside]
            state[lane] = now
        return fresh, state


class Parser:
    """The automata of a model."""

    def __init__(self, model: Model):
        texts = [self.symbols(t.encode("utf-32-le", "replace"), np.array([0, len(t)]))[0] for t in model.texts]
        self.bits = [math.log2(max(2, len(t))) for t in texts]
        self.automata = [(Dense if len(np.unique(t)) <= FEW else Sparse)(t) for t in texts]

    @staticmethod
    def symbols(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of rows of UTF-32 code points, and the rows' edges in them: whatever stands between letters as one 0, none at a row's start."""
        folded = _folded()[np.frombuffer(raw, np.uint32)]
        before = np.zeros(len(folded), np.uint32)
        before[1:] = folded[:-1]
        before[at[:-1][at[:-1] < len(folded)]] = 0
        stay = (folded > 0) | (before > 0)
        return folded[stay].astype(np.int64), np.concatenate([[0], np.cumsum(stay, dtype=np.int32)])[at]

    def costs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each row under each language, symbols of each row that are letters)."""
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])[at]
        symbols, edge = self.symbols(data.tobytes().decode("utf-8").encode("utf-32-le"), points)
        letters = np.concatenate([[0], np.cumsum(symbols > 0, dtype=np.int32)])
        lanes = Lanes(edge)
        return np.stack([lanes.phrases(one, symbols) * b for one, b in zip(self.automata, self.bits, strict=True)], 1), letters[edge[1:]] - letters[edge[:-1]]


@functools.lru_cache(maxsize=2)
def parser(model: Model) -> Parser:
    """The worker's copy."""
    return Parser(model)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred (string) and score (double).

    The score is the second language's cost over that of both, 0.5 (a tie, which goes to the first name) to 1; with one
    language 1. A text that is null or has no letter, and any text under a model without languages, gets ``und`` and 0.
    Repeated rows stay repeated; a column of docs that has the name of a new one is replaced.
    """

    def make(rows, data, at):
        if not model.languages:
            return [pa.array(["und"] * len(rows), pa.string()), pa.array([0.0] * len(rows))]
        bits, letters = parser(model).costs(data, at)
        best = bits.argmin(1)
        names = np.array(model.languages, object)[best]
        names[letters == 0] = "und"
        least = bits.min(1)
        second = np.sort(bits, 1)[:, 1] if bits.shape[1] > 1 else np.full(len(least), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(second), 1.0, second / (least + second))
        return [pa.array(names.tolist(), pa.string()), pa.array(np.where(letters == 0, 0.0, score))]

    return by_block(docs, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], text, keep, STEP)
