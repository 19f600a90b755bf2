"""Token counts by compiled finite-state transducers.

A tokenizer of words and ranked merges is compiled into two transducers:

1. *Word cutter.* A small deterministic transducer over character classes whose
   output marks where words start. A text block is cut into chunks; the state map of
   each chunk (entry state to exit state) is folded up symbol by symbol as an element
   of the transition monoid, the maps are composed by a parallel prefix scan, and with
   the entry states known every chunk emits its marks.
2. *Merge counter.* A deterministic transducer over bytes whose transitions carry the
   change of the number of tokens. Its state is all that later merges can depend on:
   for each suffix that may still grow into a token, the last token before it and the
   tokens since. One token ends a prefix, the one whose merge with its predecessor
   does not happen, so counts follow exactly. States and transitions are compiled when
   first met and kept in transition arrays; the start of a word resets the state, so
   chunks that begin at word starts have constant state maps.

Both step many chunks at once. Table size is bounded: it is emptied between blocks
when it holds more than ``MAX_STATES`` states, which changes no result.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import annotate, raw_texts

MAX_STATES = 120_000
LIMIT = 2048
FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
])

# Symbols of the word cutter.
SPACE, NUMBER, OTHER, QUOTE, LETTER, ENDS, R, V, L, E = range(10)
# States: between words, in letters, in other signs, after a number or a clitic, after an opening quote, then r, v or l.
BETWEEN, WORD, SIGNS, CLOSED, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(8)
STARTS_HERE, STARTS_BEFORE = 1, 2


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for words 's 't 're 've 'm 'll 'd, letters+, one number, other signs+."""
    nxt, out = np.zeros((8, 10), np.int64), np.zeros((8, 10), np.uint8)
    letters = (LETTER, ENDS, R, V, L, E)

    def fresh(symbol: int) -> tuple[int, int]:
        if symbol == SPACE:
            return BETWEEN, 0
        state = {NUMBER: CLOSED, OTHER: SIGNS, QUOTE: QUOTED}.get(symbol, WORD)
        return state, STARTS_HERE

    for symbol in range(10):
        for state in range(8):
            nxt[state, symbol], out[state, symbol] = fresh(symbol)
        if symbol in letters:
            nxt[WORD, symbol], out[WORD, symbol] = WORD, 0
        if symbol in (OTHER, QUOTE):
            for state in (SIGNS, QUOTED):
                nxt[state, symbol], out[state, symbol] = SIGNS, 0
    nxt[QUOTED, ENDS], out[QUOTED, ENDS] = CLOSED, 0
    for symbol, waiting, closing in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        nxt[QUOTED, symbol], out[QUOTED, symbol] = waiting, 0
        for after in range(10):  # no clitic after all: the letter before started a word
            state, mark = (WORD, 0) if after in letters else fresh(after)
            nxt[waiting, after], out[waiting, after] = state, mark | STARTS_BEFORE
        nxt[waiting, closing], out[waiting, closing] = CLOSED, 0
    return nxt, out


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All state maps that symbol strings induce: their images, and the map after one more symbol."""
    identity = tuple(range(len(nxt)))
    numbers, todo, rows = {identity: 0}, [identity], []
    for image in todo:
        row = []
        for symbol in range(nxt.shape[1]):
            longer = tuple(int(nxt[s, symbol]) for s in image)
            if longer not in numbers:
                numbers[longer] = len(numbers)
                todo.append(longer)
            row.append(numbers[longer])
        rows.append(row)
    return np.array(todo, np.int64), np.array(rows, np.int64)


class WordCutter:
    def __init__(self) -> None:
        self.next, self.out = _cutter()
        self.images, self.longer = _monoid(self.next)

    def starts(self, symbols: np.ndarray, chunks: int = 2048) -> np.ndarray:
        """Whether a word starts at each symbol; the symbols before the first are taken as a space."""
        n = len(symbols)
        chunks = max(1, min(chunks, n // 32))
        steps = -(-(n + 1) // chunks)
        grid = np.full(chunks * steps, SPACE, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(chunks, steps).T)
        width = self.longer.shape[1]
        flat = (self.longer * width).reshape(-1)
        element = np.zeros(chunks, np.int64)
        for row in grid:
            element = flat[element + row]
        maps = self.images[element // width]
        shift = 1
        while shift < chunks:  # after each round a map covers twice as many chunks
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].copy(), axis=1)
            shift *= 2
        state = np.concatenate(([BETWEEN], maps[:-1, BETWEEN]))
        follow, mark = (self.next * 10).reshape(-1), self.out.reshape(-1)
        marks = np.empty_like(grid)
        at = state * 10
        for i, row in enumerate(grid):
            at = at + row
            marks[i] = mark[at]
            at = follow[at]
        marks = marks.T.reshape(-1)
        begins = (marks & STARTS_HERE) > 0
        begins[:-1] |= (marks[1:] & STARTS_BEFORE) > 0
        return begins[:n]


class MergeCounter:
    """Transducer over bytes (256 more for the last byte of a word) with token counts on its transitions."""

    SKIP = 512

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        byte_of = _byte_letters()
        self.ranks = {pair: i for i, pair in enumerate(map(tuple, merges))}
        self.symbol = {b: c for c, b in byte_of.items()}
        self.suffix = suffix
        self.tokens: dict[tuple[int, ...], str] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.open: set[tuple[int, ...]] = set()  # proper beginnings of tokens
        for token in vocab:
            last = suffix and token.endswith(suffix) and len(token) > len(suffix)
            body = token[: -len(suffix)] if last else token
            if not all(c in byte_of for c in body):
                continue
            key = tuple(byte_of[c] for c in body)
            if last:
                key = (*key[:-1], key[-1] + 256)
            self.tokens[key], self.parts[token] = token, key
            for i in range(1, len(key)):
                self.open.add(key[:i])
        self.apart: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(513, -1, np.int64)
        self.table, self.gain = np.full((1024, 32), -1, np.int32), np.zeros((1024, 32), np.int8)
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self._number(((), ((None, 0),)))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            if len(self.states) == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _column(self, symbol: int) -> int:
        if self.column[symbol] < 0:
            used = int(self.column.max()) + 1
            if used == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)], axis=1)
            self.column[symbol] = used
        return int(self.column[symbol])

    def _merged(self, symbols: tuple[int, ...]) -> list[str]:
        word = [self.symbol[s % 256] + (self.suffix if s >= 256 else "") for s in symbols]
        while len(word) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(word, word[1:])))
            if rank == 1 << 60:
                break
            word[at : at + 2] = [word[at] + word[at + 1]]
        return word

    def _stays(self, before: str | None, token: str) -> bool:
        """Whether the token stands next to the one before, none of their parts merging across."""
        key = (before, token)
        if key not in self.apart:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            alone = [token] if before is None else [before, token]
            self.apart[key] = self._merged(sum((self.parts[t] for t in alone), ())) == alone
        return self.apart[key]

    def _compile(self, state: int, symbol: int) -> None:
        ending, history = self.states[state]
        longer = (*ending, symbol)
        for size in range(len(longer), 0, -1):
            token = self.tokens.get(longer[-size:])
            if token is not None and self._stays(history[size - 1][0], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        gain = 1 - history[size - 1][1]
        if symbol >= 256:
            target = 0
        else:
            keep = next((k for k in range(len(longer), 0, -1) if longer[-k:] in self.open), 0)
            past = ((token, 0), *((last, since + gain) for last, since in history[:keep]))
            target = self._number((longer[len(longer) - keep :], past))
        column = self._column(symbol)
        self.table[state, column], self.gain[state, column] = target, gain

    def gains(self, symbols: np.ndarray, starts: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Change of the token count at each byte; ``starts`` are the offsets of words."""
        if len(self.states) > MAX_STATES:
            self.reset()
        for s in np.flatnonzero(np.bincount(symbols, minlength=513)).tolist():
            self._column(s)
        self.table[0, self.column[self.SKIP]] = 0
        out = np.zeros(len(symbols), np.int8)
        if not len(starts):
            return out
        columns = self.column[symbols].astype(np.int32)
        aims = np.linspace(0, len(starts) - 1, min(lanes, len(starts)), dtype=np.int64)
        first = np.unique(starts[aims])
        last = np.append(first[1:], len(symbols))
        order = np.argsort(first - last, kind="stable")
        first, sizes = first[order], (last - first)[order]
        running = np.searchsorted(-sizes, -np.arange(int(sizes[0])))  # chunks longer than each step
        state = np.zeros(len(first), np.int64)
        for step, count in enumerate(running.tolist()):
            at = first[:count] + step
            column = columns[at]
            target = self.table[state[:count], column]
            missing = np.flatnonzero(target < 0)
            if len(missing):
                for s, sym in {(int(state[i]), int(symbols[at[i]])) for i in missing}:
                    self._compile(s, sym)
                target = self.table[state[:count], column]
            out[at] = self.gain[state[:count], column]
            state[:count] = target
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, inverted: visible Latin-1 stands for itself."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Counts for one tokenizer file of the lower-casing kind with word ends."""

    def __init__(self, path: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError("only lower-casing byte-level BPE with word ends is compiled")
        self.compose = normalizers.NFC()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cutter = WordCutter()
        self.merges = MergeCounter(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        # classes and lower case of every code point as the library's own tables have them
        points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
        text = "".join(map(chr, points))
        self.symbol = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for pattern, symbol in ((r"\s", SPACE), (r"\p{N}", NUMBER), (r"\p{L}", LETTER)):
            cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            self.symbol[[ord(piece) for piece, _ in cut.pre_tokenize_str(text)]] = symbol
        for letters, symbol in (("'", QUOTE), ("stmd", ENDS), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.symbol[[ord(c) for c in letters]] = symbol
        self.lower = np.arange(sys.maxunicode + 1, dtype=np.int32)
        self.wide: dict[int, str] = {}
        lowered = normalizers.Lowercase().normalize_str("|".join(map(chr, points[: 0x20000]))).split("|")
        same = [p for p in points[:0x20000] if chr(p) != "|"]
        for p, low in zip(same, [x for x in _rejoin(lowered)]):
            if len(low) == 1:
                self.lower[p] = ord(low)
            elif low:
                self.wide[p] = low

    def _points(self, text: str) -> np.ndarray:
        """Normalised code points of a text."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = self.compose.normalize_str(text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lowered = self.lower[points]
        if self.wide and not text.isascii():
            many = np.isin(points, list(self.wide))
            if many.any():
                lowered = np.concatenate([
                    np.fromiter(map(ord, self.wide[int(p)]), np.int32) if m else np.array([low], np.int32)
                    for p, low, m in zip(points, lowered, many)
                ])
        return lowered

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Texts between special tokens, and how many of these there are."""
        if not any(s in text for s in self.special):
            return [text], 0
        parts, found = [text], 0
        for special in self.special:
            cut = [p.split(special) for p in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return parts, found

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        points, owner, total = [], [], np.zeros(len(texts) + 1, np.int64)
        gap = np.array([32], np.int32)
        for i, text in enumerate(texts):
            parts, found = self.pieces(text)
            total[i] += found
            for part in parts:
                if part:
                    points += [self._points(part), gap]
                    owner += [i, i]
        if not points:
            return total[:-1].tolist()
        sizes = np.fromiter(map(len, points), np.int64, len(points))
        points = np.concatenate(points)
        symbols = self.symbol[points]
        begins = self.cutter.starts(symbols)
        # from characters to bytes
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        offset = np.cumsum(width) - width
        starts = offset[begins]
        closing = np.zeros(len(points), bool)  # last character of a word
        blank = symbols == SPACE
        closing[:-1] = (begins[1:] | blank[1:]) & ~blank[:-1]
        codes = raw.astype(np.int64)
        codes[offset[closing] + width[closing] - 1] += 256
        blanks = np.repeat(blank, width)
        codes[blanks] = MergeCounter.SKIP
        gains = np.cumsum(self.merges.gains(codes, starts), dtype=np.int64)
        ends = np.cumsum(np.add.reduceat(width, np.cumsum(sizes) - sizes))
        upto = gains[ends - 1]
        np.add.at(total, owner, np.diff(upto, prepend=0))
        return total[:-1].tolist()


def _rejoin(pieces: list[str]) -> list[str]:
    """Undo the split at the separator itself, which stands as two empty pieces."""
    out, i = [], 0
    while i < len(pieces):
        if pieces[i] == "" and i + 1 < len(pieces) and pieces[i + 1] == "":
            i += 2
            continue
        out.append(pieces[i])
        i += 1
    return out


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    """Compiled once per worker process and kept from task to task."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit; every row is kept.

    ``path`` is the vocabulary file, readable on every executor. A null text counts as
    empty: no bytes, no tokens. Special tokens inside a text count as one token each;
    none are added, nothing is cut off. Columns of ``docs`` of these names are replaced.
    """

    def make():
        counter = _counter(path)

        def kernel(column: pa.Array) -> dict:
            sizes = [len(t) for t in raw_texts(column)]
            tokens = counter.count([t or "" for t in column.to_pylist()])
            return {"n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return kernel

    return annotate(docs, text, FIELDS, make)
