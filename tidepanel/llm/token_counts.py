"""Token counts by a tokenizer that is compiled to finite-state transducers.

The outer machine reads classes of characters and cuts a text into pre-tokens.  It has seven states and a table
``NEXT[class, state]``; a transition is annotated with the pre-tokens that it starts, at the character read or, where a
contraction did not come about, at the one before.  A text is laid out as chunks of ``WIDTH`` characters, cut anywhere,
inside words too.  All chunks are read in step: first from every state, which gives each chunk's state map; the maps
are composed by a parallel prefix scan; then each chunk is read once more from the one state that it really starts in.

A pre-token is thus one way from START to START, and that way is annotated with the number of tokens that it emits.
Byte-pair merging is not finite-state for words of any length, so annotations are compiled when they are needed, for
all distinct pre-tokens of a batch at once and by the file's own rules: words are rows of symbols, and in each step
every row merges its leftmost pair of lowest rank, until none has a pair left.  Words of over ``MAX_WORD`` bytes are
merged one by one with a heap.  Equal words of a batch are told apart by their characters, not by a hash, and nothing
is kept from one batch to the next, so memory does not grow with the vocabulary.

The tokenizers library reads the file's rules in: the classes of all characters are found with its own expressions.
It also normalises texts with characters that Python's tables do not know.  It counts nothing.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm._shared import long_rows
from tidepanel.llm._text import tidy

LIMIT = 2048
#: Characters that are scanned at a time; a longer text is cut at the next white space.
CHUNK = 1 << 20
#: Characters of a chunk of the parallel scan.
WIDTH = 64
#: Bytes of the words that are merged in step, in bands of about equal length.
BANDS = (4, 8, 12, 16, 24, 32, 64)
MAX_WORD = BANDS[-1]

#: The rules that are compiled (fixed value, from the tokenizer's file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, NUMBER, OTHER, APOSTROPHE, LETTER, STMD, R, V, L, E = range(10)
CLASSES = 10
#: No pre-token open; in letters; in others; after an apostrophe that starts a pre-token; after it and r, v or l.
START, LETTERS, OTHERS, MARK, MARK_R, MARK_V, MARK_L = range(7)
STATES = 7
HERE, BEFORE = 1, 2


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """``NEXT`` and ``EMIT`` by (class, state)."""
    to, emit = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)

    def plain(kind: int, state: int) -> tuple[int, int]:
        """From a state in which nothing is undecided."""
        if kind == SPACE:
            return START, 0
        if kind == NUMBER:
            return START, HERE
        if kind in (OTHER, APOSTROPHE):
            return (OTHERS, 0) if state == OTHERS else (MARK if kind == APOSTROPHE else OTHERS, HERE)
        return LETTERS, 0 if state == LETTERS else HERE

    for kind in range(CLASSES):
        for state in (START, LETTERS, OTHERS):
            to[kind, state], emit[kind, state] = plain(kind, state)
        # The apostrophe is a pre-token of its own kind until a contraction takes it.
        undecided = {STMD: START, R: MARK_R, V: MARK_V, L: MARK_L}
        to[kind, MARK], emit[kind, MARK] = (undecided[kind], 0) if kind in undecided else plain(kind, OTHERS)
        for state, last in ((MARK_R, E), (MARK_V, E), (MARK_L, L)):
            if kind == last:
                to[kind, state], emit[kind, state] = START, 0
            else:  # no contraction: the letter before has started a pre-token
                to[kind, state], flag = plain(kind, LETTERS)
                emit[kind, state] = flag | BEFORE
    return to, emit


NEXT, EMIT = _transitions()


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, a row each: ``then`` after ``first``."""
    return np.take_along_axis(then, first, axis=1)


def scanned(kinds: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The outer machine's state before each character, from START on."""
    n = len(kinds)
    chunks = -(-n // width)
    laid = np.full(chunks * width, SPACE, np.intp)
    laid[:n] = kinds
    steps = np.ascontiguousarray(laid.reshape(chunks, width).T) * STATES
    table = NEXT.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.intp), (chunks, 1))
    for step in steps:
        maps = table[step[:, None] + maps].astype(np.intp)
    # The prefix scan: afterwards row i is the map of chunks 0 to i together.
    d = 1
    while d < chunks:
        maps[d:] = compose(maps[:-d], maps[d:])
        d *= 2
    state = np.concatenate(([START], maps[:-1, START])) if chunks else np.zeros(0, np.intp)
    before = np.empty((width, chunks), np.uint8)
    for k, step in enumerate(steps):
        before[k] = state
        state = table[step + state].astype(np.intp)
    return before.T.ravel()[:n]


def _classes(split) -> np.ndarray:
    """The class of every code point by the tokenizer's own expression.

    What Python's tables say is tried on whole blocks, which either come out as one pre-token or are halved.
    """
    kinds = np.full(0x110000, OTHER, np.uint8)
    cut = lambda text: [t for t, _ in split.pre_tokenize_str(text)]

    def alone(c: str) -> int:
        n = len(cut(f"a{c}a"))
        return LETTER if n == 1 else SPACE if n == 2 else OTHER if len(cut(f"!{c}!")) == 1 else NUMBER

    def sort(block: str, kind: int) -> None:
        edge = "a" if kind == LETTER else "!"
        if len(cut(edge + block + edge)) == 1:
            kinds[np.frombuffer(block.encode("utf-32-le"), np.uint32)] = kind
        elif len(block) == 1:
            kinds[ord(block)] = alone(block)
        else:
            sort(block[: len(block) // 2], kind)
            sort(block[len(block) // 2 :], kind)

    guess: dict[int, list] = {LETTER: [], OTHER: []}
    for c in map(chr, range(0x110000)):
        if "\ud800" <= c <= "\udfff":
            continue
        what = unicodedata.category(c)[0]
        if what == "N" or c.isspace():
            kinds[ord(c)] = alone(c)
        else:
            guess[LETTER if what == "L" else OTHER].append(c)
    for kind, chars in guess.items():
        for a in range(0, len(chars), 4096):
            sort("".join(chars[a : a + 4096]), kind)
    for kind, chars in ((STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (APOSTROPHE, "'")):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself where it is one, else the next code point from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merging by rank, lowest first and leftmost of equals; symbols are numbers."""

    NONE = np.int32(1 << 30)
    PROBES = 8

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        # Symbols that are not in the vocabulary emit nothing; none of the byte alphabet may be missing.
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        left, right = (np.array([vocab[m[k]] for m in model["merges"]], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.rank = dict(zip(zip(left.tolist(), right.tolist(), strict=True), zip(range(len(made)), made.tolist(), strict=True), strict=True))
        # Open addressing: a pair is in one of PROBES places from its own on.
        bits = max(4, (8 * len(made)).bit_length())
        while True:
            self.shift = np.uint64(64 - bits)
            key, rank = np.full((1 << bits) + self.PROBES, -1, np.int64), np.full((1 << bits) + self.PROBES, self.NONE, np.int32)
            if all(self._put(key, rank, int(x), k) for k, x in enumerate(left << 32 | right)):
                break
            bits += 1
        self.key, self.ranks, self.made = key, rank, np.append(made, -1)

    def _put(self, key, rank, x: int, k: int) -> bool:
        at = (x * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)
        for p in range(at, at + self.PROBES):
            if key[p] < 0:
                key[p], rank[p] = x, k
                return True
        return False

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where they do not merge; symbol -1 merges with nothing."""
        x = left << 32 | right
        at = ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(x.shape, self.NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for p in range(self.PROBES):
            found = self.key[at[todo] + p]
            same = found == x[todo]
            out[todo[same]] = self.ranks[at[todo[same]] + p]
            todo = todo[~same & (found >= 0)]
            if not len(todo):
                break
        return out

    def in_step(self, words: list[bytes]) -> np.ndarray:
        """Tokens that each of these words of about the same length emits."""
        n = np.array([len(w) for w in words])
        wide = int(n.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        row, column = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        symbols = np.full((len(n), wide + 1), -1, np.int64)
        symbols[row, column] = np.where(column == np.repeat(n, n) - 1, self.last[flat], self.inner[flat])
        ranks = self.rank_of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(n), wide)
        tokens, live = n.copy(), np.arange(len(n))
        place = np.arange(wide + 1)
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            some = least < self.NONE
            if not some.all():
                symbols, ranks, at, least, live = symbols[some], ranks[some], at[some], least[some], live[some]
            if not len(live):
                return tokens
            rows = np.arange(len(live))
            symbols[rows, at] = self.made[least]
            # The symbol after the merged one goes, and so does its pair.
            shift = np.minimum(place + (place > at[:, None]), wide)
            symbols = np.take_along_axis(symbols, shift, axis=1)
            symbols[:, wide] = -1
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], wide - 1), axis=1)
            ranks[:, wide - 1] = self.NONE
            ranks[rows, at] = self.rank_of(symbols[rows, at], symbols[rows, at + 1])
            back = at > 0
            ranks[rows[back], at[back] - 1] = self.rank_of(symbols[rows[back], at[back] - 1], symbols[rows[back], at[back]])
            tokens[live] -= 1

    def alone(self, word: bytes) -> int:
        """The same for one word of any length."""
        flat = np.frombuffer(word, np.uint8)
        part = [*self.inner[flat[:-1]].tolist(), int(self.last[flat[-1]])]
        n, rank = len(part), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(part, part[1:])) if p in rank]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = rank[a, b][1], -1
            after[i] = after[j]
            left -= 1
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (part[x], part[y]) in rank:
                    heapq.heappush(heap, (rank[part[x], part[y]][0], x, part[x], part[y]))
        return left

    def count(self, words: list[str]) -> np.ndarray:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        band = np.searchsorted(BANDS, [len(w) for w in raw])
        out = np.zeros(len(raw), np.int64)
        for k in np.unique(band):
            at = np.flatnonzero(band == k)
            mine = [raw[i] for i in at]
            out[at] = self.in_step(mine) if k < len(BANDS) else [self.alone(w) for w in mine]
        return out


class Transducer:
    """Both machines of a tokenizer's file."""

    def __init__(self, path: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, cut = rules["model"], rules["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in rules["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["unk_token"] or model["byte_fallback"] or model["dropout"] or model["ignore_merges"] or cut[0]["pattern"] != {"Regex": PATTERN} or cut[1]["type"] != "ByteLevel" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"this tokenizer's rules are not those that are compiled here: {path}")
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.kinds = _classes(pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True))
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        # Characters that Python's tables lack, or whose lower case they give otherwise.
        self.strange = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)
        known = [chr(c) for c in np.flatnonzero(~self.strange) if c != 10 and not 0xD800 <= c < 0xE000]
        for c, low in zip(known, normalizers.Lowercase().normalize_str("\n".join(known)).split("\n"), strict=True):
            if (c.lower() if c != "Σ" else "σ") != low:
                self.strange[ord(c)] = True
        self.merges = Merges(model)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.strange[codes].any() and not ((codes >= 0xD800) & (codes < 0xE000)).any():
            return self.library.normalize_str(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # no final sigma

    def pretokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of code points that end with white space."""
        kinds = self.kinds[codes]
        out = EMIT[kinds, scanned(kinds)]
        start = (out & HERE) > 0
        start[:-1] |= (out[1:] & BEFORE) > 0
        edge = np.flatnonzero(start | (kinds == SPACE))
        opens = start[edge]
        return edge[opens], np.append(edge[1:], len(codes))[opens]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens that each normalised text emits."""
        joined = "".join(t + " " for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([len(t) + 1 for t in texts])
        starts, ends = self.pretokens(codes)
        size = ends - starts
        wide = np.concatenate(([0], np.cumsum(codes > 0xFF)))
        narrow = wide[ends] == wide[starts]
        emit, found = np.zeros(len(starts), np.int64), []
        # Words of up to 7, and up to 15, one-byte characters are one or two numbers: 8 characters from any place on.
        eight = np.ndarray(len(codes), np.uint64, np.concatenate((codes.astype(np.uint8), np.zeros(8, np.uint8))).tobytes(), strides=(1,))
        mask = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
        for low, high in ((1, 7), (8, 15)):
            at = np.flatnonzero(narrow & (size >= low) & (size <= high))
            if not len(at):
                continue
            s, n = starts[at], size[at]
            key = eight[s + (8 if low == 8 else 0)] if low == 8 else eight[s]
            key = (key & mask[n - (8 if low == 8 else 0)]) | (n.astype(np.uint64) << np.uint64(56))
            keys = (key,) if low == 1 else (key, eight[s])
            order = np.lexsort(keys)
            new = np.ones(len(at), bool)
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
            own = np.empty(len(at), np.int64)
            own[order] = np.cumsum(new) - 1
            first = at[order[new]]
            found.append((at, [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], own))
        at = np.flatnonzero(~narrow | (size > 15))
        number: dict[str, int] = {}
        own = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], np.int64)
        found.append((at, list(number), own))
        counts = self.merges.count([w for _, words, _ in found for w in words])
        first = 0
        for at, words, own in found:
            emit[at] = counts[first : first + len(words)][own] if len(words) else 0
            first += len(words)
        return np.bincount(np.searchsorted(offsets, starts, "right"), weights=emit, minlength=len(texts)).astype(np.int64)


_white = re.compile(r"\s")


def chunks(text: str, size: int):
    """Pieces of about ``size`` characters that begin after white space."""
    a = 0
    while len(text) - a > 2 * size:
        m = _white.search(text, a + size)
        # Python's white space includes the separators 0x1C to 0x1F, which are others to the tokenizer.
        while m and "\x1c" <= m[0] <= "\x1f":
            m = _white.search(text, m.end())
        if not m:
            break
        yield text[a : m.end()]
        a = m.end()
    yield text[a:]


_machines: dict[str, Transducer] = {}


def count_texts(path: str, texts: list) -> np.ndarray:
    """Tokens of each text; a null text has none."""
    machine = _machines.get(path) or _machines.setdefault(path, Transducer(path))
    total = np.zeros(len(texts), np.int64)
    rows, parts, size = [], [], 0

    def flush():
        nonlocal rows, parts, size
        if parts:
            np.add.at(total, rows, machine.count(parts))
        rows, parts, size = [], [], 0

    for row, text in enumerate(texts):
        text = text or ""
        if "<" in text:
            total[row] += len(machine.special.findall(text))
            pieces = machine.special.split(text)
        else:
            pieces = [text]
        for piece in pieces:
            for part in chunks(machine.normal(piece), CHUNK):
                rows.append(row)
                parts.append(part)
                size += len(part)
                if size >= CHUNK:
                    flush()
    flush()
    return total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every whole text; ``tokenizer`` is a path all executors have.

    A null text is empty.  Null and repeated ids pass through; an empty table gives an empty result; other columns are
    ignored.
    """
    long_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def counted(batches):
        for pdf in batches:
            n = count_texts(tokenizer, list(pdf["text"]))
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": size, "n_tokens": n, "over_limit": n > limit})
        tidy()

    return rows.mapInPandas(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op7_finite_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
