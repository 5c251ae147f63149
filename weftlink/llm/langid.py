"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is cut greedily into the longest phrases that occur in a language's
sample (a letter that doesn't is a phrase of its own); the language that needs the
fewest phrases, each weighted by the log of its sample's length, wins. Texts are
parsed in segments of ``SEGMENT`` characters, thousands of them in lockstep; a
segment that a phrase enters is then parsed again from that phrase, up to where both
parses are in one state, so the phrases are those of the whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROLL, mix, trim, tune

SEGMENT = 1024
#: Characters parsed together.
BLOCK = 1 << 21
SPACE, OTHER = 0, 1
#: An automaton of at most so many states times letters is a plain table, a larger one a hash table of its moves.
DENSE = 8 << 20


def training_sample(labelled: DataFrame, text: str, lang: str, docs_per_lang: int, chars_per_lang: int) -> list[tuple[str, str]]:
    """(language, text) of at most docs_per_lang distinct texts of each language that have a letter, those of the smallest hash.

    Of longer texts the first chars_per_lang characters are fetched. A share of the
    smallest hashes that holds enough texts of a language is taken before any are
    ranked, so the ranking sees a few rows, however many there are.
    """
    rows = labelled.select(F.col(lang).alias("_lang"), F.xxhash64(F.col(text), F.lit(7)).alias("_h"), F.col(text).alias("_text")).filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    sizes = rows.groupBy("_lang").agg(F.approx_count_distinct("_h").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(8.0 * docs_per_lang) / F.col("_n"))
    limits = sizes.select("_lang", (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("_limit"))
    few = rows.join(F.broadcast(limits), "_lang").filter(F.col("_h").cast("double") <= F.col("_limit"))
    few = few.select("_lang", "_h", F.substring("_text", 1, chars_per_lang).alias("_text")).distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))
    got = few.withColumn("_r", rank).filter(F.col("_r") <= docs_per_lang).orderBy("_lang", "_h", "_text").collect()
    return [(r["_lang"], r["_text"]) for r in got]


def dealt(texts: list[str], chars: int) -> list[str]:
    """The texts cut so that they have so many characters in all, and a long one no more than its share."""
    out, left = {}, chars
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[i] = texts[i][: left // (len(texts) - k)]
        left -= len(out[i])
    return [out[i] for i in range(len(texts))]


class Automaton:
    """The suffix automaton of a sequence of codes; state ``done`` is that of a finished phrase."""

    def __init__(self, codes: np.ndarray, letters: int):
        move: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in codes.tolist():
            cur = len(move)
            move.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in move[p]:
                move[p][c] = cur
                p = link[p]
            if p != -1:
                q = move[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(move)
                    move.append(dict(move[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and move[p].get(c) == q:
                        move[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.letters, self.done = letters, len(move)
        n = sum(map(len, move))
        state = np.repeat(np.arange(len(move)), [len(m) for m in move])
        code = np.fromiter((c for m in move for c in m), np.int64, n)
        target = np.fromiter((t for m in move for t in m.values()), np.int32, n)
        self.root = np.full(letters, self.done, np.int32)
        for c, t in move[0].items():
            self.root[c] = t
        self.table = self.keys = None
        if (len(move) + 1) * letters <= DENSE:
            self.table = np.full((len(move) + 1) * letters, -1, np.int32)
            self.table[state * letters + code] = target
        else:
            self._hashed(state * letters + code, target)

    def _hashed(self, keys: np.ndarray, target: np.ndarray) -> None:
        bits = int(2 * len(keys)).bit_length()
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.target = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]  # of several for a slot the last one stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.target[slot[won]] = target[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64) * np.uint64(ROLL)) >> self.shift).astype(np.int64)

    def nbytes(self) -> int:
        return self.table.nbytes if self.table is not None else self.keys.nbytes + self.target.nbytes

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with the code)."""
        key = state.astype(np.int64) * self.letters + code
        if self.table is not None:
            to = self.table[key]
        else:
            slot, open_ = self._slot(key), np.arange(len(key))
            to = np.full(len(key), -1, np.int32)
            while len(open_):
                there = self.keys[slot[open_]]
                hit = there == key[open_]
                to[open_[hit]] = self.target[slot[open_[hit]]]
                open_ = open_[~hit & (there >= 0)]
                slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        new = to < 0
        return np.where(new, self.root[code], to), new


class CrossParser:
    """Automata of some languages over one alphabet; built once in each worker."""

    def __init__(self, samples: list[tuple[str, str]], chars_per_lang: int):
        self.langs = sorted({x for x, _ in samples})
        text = {x: "\n".join(dealt([t for y, t in samples if y == x], chars_per_lang)).lower() for x in self.langs}
        alphabet = sorted({c for t in text.values() for c in t if c.isalpha()})
        self.letters = len(alphabet) + 2
        self.code = np.fromiter((OTHER if chr(i).isalpha() else SPACE for i in range(0x110000)), np.int32, 0x110000)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, self.letters)
        self.automata, self.bits = [], []
        for x in self.langs:
            codes = self.encode(text[x])
            self.automata.append(Automaton(codes, self.letters))
            self.bits.append(np.log2(max(len(codes), 2)))

    def encode(self, lowered: str) -> np.ndarray:
        """Codes of a text; a run of characters that aren't letters is one space."""
        codes = self.code[np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not len(codes):
            return codes
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, whether the text has a letter)."""
        count, letter = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), bool)
        held: list[np.ndarray] = []
        owner: list[int] = []
        entry: dict[int, list[int]] = {}
        size = 0
        for i, t in enumerate(texts):
            ended = None
            for a in range(0, len(t), BLOCK):
                codes = self.encode(t[a : a + BLOCK].lower())
                if ended == SPACE and len(codes) and codes[0] == SPACE:
                    codes = codes[1:]
                ended = codes[-1] if len(codes) else ended
                letter[i] |= bool((codes != SPACE).any())
                for b in range(0, len(codes), SEGMENT):
                    held.append(codes[b : b + SEGMENT])
                    owner.append(i)
                    size += SEGMENT
                if size >= BLOCK:
                    entry = self._parse(held, owner, count, entry)
                    held, owner, size = [], [], 0
        if held:
            self._parse(held, owner, count, entry)
        return count, letter

    def _parse(self, held: list[np.ndarray], owner: list[int], count: np.ndarray, entry: dict[int, list[int]]) -> dict[int, list[int]]:
        """Add the segments' phrases to the counts. entry: the states in which a text's earlier part ended; returns those of the last text."""
        who = np.array(owner)
        sizes = np.array([len(x) for x in held])
        grid = np.zeros((int(sizes.max()), len(held)), np.int32)
        for k, x in enumerate(held):
            grid[: len(x), k] = x
        # Columns by falling size, so that those still active are a prefix.
        order = np.argsort(-sizes, kind="stable")
        column = np.empty_like(order)
        column[order] = np.arange(len(order))
        grid = np.ascontiguousarray(grid[:, order])
        active = np.searchsorted(-sizes[order], -np.arange(1, len(grid) + 1), side="right")
        ends = []
        for j, own in enumerate(self.automata):
            state, phrases = np.full(len(held), own.done, np.int32), np.zeros(len(held), np.int64)
            seen = np.empty(grid.shape, np.int32)
            for step in range(len(grid)):
                n = active[step]
                state[:n], new = own.step(state[:n], grid[step, :n])
                phrases[:n] += new
                seen[step, :n] = state[:n]
            state, phrases = state[column], phrases[column]
            again = np.flatnonzero((who == np.roll(who, 1)) & (np.arange(len(who)) > 0))
            into = state[again - 1]
            if who[0] in entry:
                again, into = np.concatenate([[0], again]), np.concatenate([[entry[who[0]][j]], into])
            self._carry(own, grid, seen, column, sizes, who, again, into, state, phrases)
            np.add.at(count[:, j], who, phrases)
            ends.append(int(state[-1]))
        return {int(who[-1]): ends}

    @staticmethod
    def _carry(own, grid, seen, column, sizes, who, again, into, state, phrases) -> None:
        """Parse segments again from the states in which phrases enter them, until the parse is in the state it was in before."""
        entered = np.full(len(who), own.done, np.int32)
        while len(again):
            at, step = column[again], 0
            here, better = into.astype(np.int32), np.zeros(len(again), np.int64)
            before = entered[again]
            entered[again] = here
            open_ = np.arange(len(again))
            changed = []
            while len(open_):
                over = sizes[again[open_]] <= step
                changed += open_[over].tolist()
                open_ = open_[~over]
                if not len(open_):
                    break
                codes = grid[step, at[open_]]
                here[open_], new = own.step(here[open_], codes)
                was = seen[step, at[open_]]
                # The earlier parse began a phrase here if its state has no move for the code.
                better[open_] += new.astype(np.int64) - own.step(before[open_], codes)[1]
                before[open_] = was
                differs = here[open_] != was
                seen[step, at[open_]] = here[open_]
                open_ = open_[differs]
                step += 1
            phrases[again] += better
            changed = np.array([k for k in changed if here[k] != state[again[k]]], np.int64)
            state[again[changed]] = here[changed]
            follow = again[changed] + 1
            ok = follow < len(who)
            ok[ok] = who[follow[ok]] == who[again[changed][ok]]
            again, into = follow[ok], here[changed][ok]


_BUILT: dict = {}


def _parser(samples, chars_per_lang) -> CrossParser:
    key = hash((tuple(samples), chars_per_lang))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = CrossParser(samples, chars_per_lang)
    return _BUILT[key]


def predict(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 48, chars_per_lang: int = 48_000) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` added.

    The classifier is fitted on a bounded sample of ``labelled``: at most
    ``docs_per_lang`` distinct texts and ``chars_per_lang`` characters a language, dealt
    evenly over its texts. Whole texts are parsed. ``score``
    is (second - best) / second of the weighted phrase counts, 1.0 where only one
    language is known. Null texts and texts without a letter give ``und`` and 0.0,
    and so does every text when nothing is labelled. Ties go to the language that
    sorts first. Each row gives one, repeated rows too; an empty table gives none.
    Columns called ``lang_pred`` and ``score`` are replaced, other columns pass through.
    """
    spark = docs.sparkSession
    tune(spark)
    samples = training_sample(labelled, text, lang, docs_per_lang, chars_per_lang)
    shared = spark.sparkContext.broadcast((samples, chars_per_lang))

    @F.pandas_udf("lang_pred string, score double")
    def parse(texts: pd.Series) -> pd.DataFrame:
        if not shared.value[0]:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        p = _parser(*shared.value)
        count, letter = p.phrases([t if isinstance(t, str) else "" for t in texts])
        cost = count * np.array(p.bits)
        order = np.argsort(cost, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = cost[rows, order[:, 0]]
        trim()
        score = 1 - best / np.maximum(cost[rows, order[:, 1]], 1e-9) if len(p.langs) > 1 else np.ones(len(texts))
        return pd.DataFrame({"lang_pred": np.where(letter, np.array(p.langs, object)[order[:, 0]], "und"), "score": np.where(letter, np.clip(score, 0, 1), 0.0)})

    return docs.withColumn("_wl_parsed", parse(F.col(text))).withColumns({"lang_pred": F.col("_wl_parsed.lang_pred"), "score": F.col("_wl_parsed.score")}).drop("_wl_parsed")
