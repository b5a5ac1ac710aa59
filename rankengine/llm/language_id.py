"""Language identification by cross-parsing: the language whose text explains a document in fewest phrases wins.

For each value of lang a suffix automaton is built over a bounded sample of its labelled text, with all letters of it. A
document is read from left to right and cut into phrases, each the longest run that occurs in the language's sample (a
character that doesn't occur at all ends one). The phrases, divided by the document's length, estimate its cross entropy.

The sample is bounded in rows and characters (`sample_chars` a language): of each labelled text one piece of PIECE_CHARS
characters at a place drawn by hash, so that all parts of long texts are learned from alike.

All texts of a batch are parsed side by side. Long texts are cut into blocks that are first parsed from the automaton's
start; then the parse that really reaches a block is run next to that one until both are in the same state, which tells
the difference. So phrases reach over blocks, and the result is that of one parse of the whole text. An automaton is
turned into a transition table for its commonest characters, in which a missing transition leads where the same
character leads from the start, with a phrase counted; transitions with its other characters are found by search. Tasks
hold all automata (about 1 MB each) and the tables of TABLES of them.

Texts without a letter (null and empty ones too) are `und` with score 0. Ties go to the language that sorts first. Extra
columns are dropped and repeated rows are judged alike. Without labelled text every document is `und`; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import pieces, plain

#: Characters of labelled text per language, and of one piece of a text: bounds of the fitted sample.
SAMPLE_CHARS = 24_000
PIECE_CHARS = 2_000
#: Characters that a text is cut into for parsing side by side.
BLOCK = 1024
#: Classes with a column of the transition table: a language's commonest characters. Its others are looked up by search.
ALPHABET = 96
#: Blanks and signs, and letters that a sample lacks.
_SIGN, _OTHER = 0, 1
#: Transition tables that a task holds at a time; with more languages they are made anew for each piece of texts.
TABLES = 8


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of `text`."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class Automaton:
    """Suffix automaton of one language's sample over classes of its own characters, by edges sorted by state and class."""

    def __init__(self, classes: np.ndarray, width: int):
        to = suffix_automaton(classes)
        self.states, self.width = len(to), width
        edges = np.array([(s * width + c, q) for s, e in enumerate(to) for c, q in e.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.edge, self.target = edges[:, 0], edges[:, 1].astype(np.int32)
        self.start = np.zeros(width, np.int32)  # a character that the sample lacks: a phrase, and back to the start
        first = self.edge < width
        self.start[self.edge[first]] = self.target[first]

    def table(self) -> np.ndarray:
        """Entry state * ALPHABET + class: twice the next state, plus 1 if a new phrase begins with the character."""
        start = np.zeros(ALPHABET, np.int32)
        n = min(ALPHABET, self.width)
        start[:n] = self.start[:n]
        table = np.tile(2 * start + 1, (self.states, 1))
        state, c = np.divmod(self.edge, self.width)
        common = c < ALPHABET
        table[state[common], c[common]] = 2 * self.target[common]
        return table.ravel()

    def rare(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same for classes of ALPHABET and more."""
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, 2 * self.target[at], 2 * self.start[c] + 1)


class Languages:
    """Names, characters and automata of the learned languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        joined = {k: " ".join(v).lower() for k, v in samples.items()}
        counts = {k: Counter(c for c in text if c.isalpha()) for k, text in joined.items()}
        self.letters = {c: i + 2 for i, c in enumerate(sorted(set().union(*counts.values())))}
        #: for each language, the class of each of `letters` in its automaton
        self.own: list[np.ndarray] = []
        self.automata: list[Automaton] = []
        for k in self.names:
            ranked = sorted(counts[k], key=lambda c: (-counts[k][c], c))
            own = np.full(len(self.letters) + 2, _OTHER, np.int32)
            own[_SIGN] = _SIGN
            own[[self.letters[c] for c in ranked]] = np.arange(2, len(ranked) + 2)
            self.own.append(own)
            self.automata.append(Automaton(own[self.squeeze(self.classes(joined[k]))], len(ranked) + 2))

    def classes(self, text: str) -> np.ndarray:
        """Number of each character of a lower-case text: _SIGN, _OTHER (a letter of no sample) or that of `letters`."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not hasattr(self, "points"):
            table = np.full(0x110000, _SIGN, np.int32)
            for i in range(0x110000):
                if chr(i).isalpha():
                    table[i] = _OTHER
            for c, i in self.letters.items():
                table[ord(c)] = i
            self.points = table
        return self.points[points]

    def table(self, k: int) -> np.ndarray:
        if not hasattr(self, "tables"):
            self.tables: dict[int, np.ndarray] = {}
        if k in self.tables:
            return self.tables[k]
        table = self.automata[k].table()
        if len(self.tables) < TABLES:
            self.tables[k] = table
        return table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("points", "tables")}

    @staticmethod
    def squeeze(classes: np.ndarray) -> np.ndarray:
        """Runs of signs and blanks become one."""
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] != _SIGN) | (classes[:-1] != _SIGN)
        return classes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters per text (signs squeezed), and letters per text."""
        joined = [x.lower() for x in texts]
        flat = self.classes("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != _SIGN) | (flat[:-1] != _SIGN)
        kept = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(flat != _SIGN)])
        bounds = np.concatenate([[0], ends])
        n_letters = np.diff(letters[bounds])
        flat, bounds = flat[keep], kept[bounds]
        size = np.diff(bounds)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        begin = bounds[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        length = np.minimum(bounds[owner + 1] - begin, BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        alive = len(begin) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), "right")
        out = np.zeros((len(texts), len(self.names)), np.int64)
        entered = np.flatnonzero(begin > bounds[owner])  # blocks that the parse reaches from another one
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        previous = place[order[entered] - 1]
        for k, automaton in enumerate(self.automata):
            table, own = self.table(k), self.own[k][flat]
            some_rare = bool((own >= ALPHABET).any())

            def step(state: np.ndarray, at: np.ndarray, automaton=automaton, table=table, own=own, some_rare=some_rare) -> np.ndarray:
                c = own[at]
                if not some_rare:
                    return table[state * ALPHABET + c]
                out = table[state * ALPHABET + np.where(c < ALPHABET, c, _OTHER)]
                rare = np.flatnonzero(c >= ALPHABET)
                out[rare] = automaton.rare(state[rare], c[rare])
                return out

            state = np.zeros(len(begin), np.int32)
            count = np.zeros(len(begin), np.int64)
            for i, n in enumerate(alive.tolist()):
                to = step(state[:n], begin[:n] + i)
                count[:n] += to & 1
                state[:n] = to >> 1
            # the parse that enters a block next to the one from the start; blocks whose entry changes are run again
            ends, more = state.copy(), np.zeros(len(begin), np.int64)
            lane, source = entered, previous
            while len(lane):
                true, fresh = ends[source], np.zeros(len(lane), np.int32)
                more[lane] = 0
                on = np.flatnonzero(true != fresh)
                left = np.zeros(len(lane), bool)
                i = 0
                while len(on):
                    at = begin[lane[on]] + i
                    x, y = step(true[on], at), step(fresh[on], at)
                    more[lane[on]] += (x & 1) - (y & 1)
                    true[on], fresh[on] = x >> 1, y >> 1
                    i += 1
                    on = on[true[on] != fresh[on]]
                    over = length[lane[on]] <= i
                    left[on[over]] = True
                    on = on[~over]
                new = state[lane].copy()
                new[left] = true[left]
                changed = lane[new != ends[lane]]
                ends[lane] = new
                again = np.isin(previous, changed)
                lane, source = entered[again], previous[again]
            # the first character of a text opens a phrase, if the sample has it and so no new phrase was counted
            out[:, k] = np.bincount(owner, count + more, len(texts)).astype(np.int64) + (size > 0)
        return out, size, n_letters

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (0.5: two languages tie; towards 1: the winner needs far fewer phrases), rate and letters."""
        phrases, size, letters = self.phrases(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), letters
        best = phrases.argmin(axis=1)
        rows = np.arange(len(texts))
        least = phrases[rows, best].astype(float)
        others = phrases.astype(float)
        others[rows, best] = np.inf
        second = others.min(axis=1) if len(self.names) > 1 else 2 * least + 1
        score = 1 / (1 + np.exp(-(second - least) / np.maximum(np.sqrt(least + 1), 1)))
        known = letters > 0
        return [self.names[b] if ok else "und" for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, least / np.maximum(size, 1), 0.0), letters


def learn(docs: DataFrame, where: Column, sample_chars: int = SAMPLE_CHARS) -> Languages:
    """Learns from rows that meet `where` and have a language: for each language pieces of its distinct texts, those that
    hash lowest first, until `sample_chars` characters are held or there are no more."""
    labelled = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    piece = F.pmod("h", F.ceil(F.length("text") / PIECE_CHARS) + (F.length("text") == 0).cast("int"))
    hashed = labelled.select("lang", "h", F.substring("text", piece.cast("int") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("text"))
    # a first cut by hash keeps about 20 * sample_chars characters of each language's distinct pieces, so the exact
    # ranking that follows is small; with pieces of PIECE_CHARS at most, less than sample_chars is out of the question
    held = hashed.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n"))
    sizes = held.groupBy("lang").agg(F.sum("n").alias("chars"))
    cut = F.lit(20.0 * sample_chars * (1 << 30)) / F.greatest("chars", F.lit(1))
    near = hashed.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 30)) < cut)
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    held = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    rows = near.withColumn("held", held - F.length("text")).where(F.col("held") < sample_chars).select("lang", "h", "text").orderBy("lang", "h").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"])
    return Languages({k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)})


def _judge(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in pieces(batch, size=1 << 20):
                names, score, rate, letters = model.judge(plain(piece.column("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rate), pa.array(letters)], ["doc_id", "lang_pred", "score", "phrase_rate", "n_letters"])

    return run


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate (phrases a character), n_letters, one row for each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_judge(sent), f"doc_id {kind}, lang_pred string, score double, phrase_rate double, n_letters bigint")
