"""Operators 1 and 5: byte-level BPE.

Pre-tokenisation turns texts into arrays of code-point classes and runs a small automaton over them as a
scan of transition functions: functions of whole blocks are composed side by side, an associative scan over the
blocks gives each block's entry state, and a second pass marks where pieces begin. No regular expression is used.
Operator 1 then merges the distinct pieces of many texts side by side, one pair of each at a step.

Both operators take any DataFrame with a text column. Null and empty texts have no tokens; repeated rows give
repeated results; other columns are left alone. A column of the result's name in the input is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import small_batches, spans_hash, text_chunks

# symbols: a code point with what must be known of the two that follow
LETTER, NUMBER, MARK, QUOTE1, QUOTE2, SPACE_JOINS, SPACE_MID, SPACE_ALONE, END = range(9)
# states after a code point
NONE, IN_LETTERS, IN_NUMBERS, IN_MARKS, JOINING, IN_SPACE, ONE_MORE, TWO_MORE, CLOSED = range(9)
_BLOCK = 64
#: The Unicode White_Space code points.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here" by symbol and state."""
    to, begins = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (MARK, IN_MARKS)):
        to[symbol] = own
        begins[symbol, [own, JOINING]] = False
    to[LETTER, [ONE_MORE, TWO_MORE]] = CLOSED, ONE_MORE
    begins[LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, then in ((QUOTE1, ONE_MORE), (QUOTE2, TWO_MORE)):
        to[symbol] = then
        to[symbol, [IN_MARKS, JOINING]] = IN_MARKS
        begins[symbol, [IN_MARKS, JOINING]] = False
    to[SPACE_JOINS], to[SPACE_MID], to[SPACE_ALONE], to[END] = JOINING, IN_SPACE, NONE, NONE
    begins[SPACE_MID, IN_SPACE] = False
    return to, begins


_TO, _BEGINS = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class by code point: letter, number, mark or white space (SPACE_MID); 0x110000 ends a text."""
    kinds = np.array([ord(k[0]) for k in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
    table = np.full(0x110001, MARK, np.uint8)
    table[:-1][kinds == ord("L")] = LETTER
    table[:-1][kinds == ord("N")] = NUMBER
    table[_WHITE] = SPACE_MID
    table[0x110000] = END
    return table


def _symbols(points: np.ndarray) -> np.ndarray:
    """points: code points of texts, an end mark after each."""
    out = _classes()[points]
    spaces = np.flatnonzero(out == SPACE_MID)
    last = spaces[(out[spaces + 1] != SPACE_MID) & (out[spaces + 1] != END)]
    out[last] = np.where(points[last] == 32, SPACE_JOINS, SPACE_ALONE)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        b, c = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
        out[quotes[np.isin(b, [ord(x) for x in "stmd"])]] = QUOTE1
        two = ((b == ord("r")) | (b == ord("v"))) & (c == ord("e")) | (b == ord("l")) & (c == ord("l"))
        out[quotes[two]] = QUOTE2
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points with an end mark (0x110000) after each text; end marks begin too."""
    symbols = _symbols(points)
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    flat, code = _TO.ravel(), np.arange(9, dtype=np.uint8)
    whole = np.broadcast_to(code, (blocks, 9)).astype(np.intp)
    for row in grid:  # each block's transition function, all blocks side by side
        whole = flat[row[:, None].astype(np.intp) * 9 + whole].astype(np.intp)
    step = 1
    while step < blocks:  # inclusive scan: composition is associative
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], 1)
        step *= 2
    state = np.zeros(blocks, np.intp)
    state[1:] = whole[:-1, NONE]
    begins, flags = np.empty(grid.shape, bool), _BEGINS.ravel()
    for j, row in enumerate(grid):
        at = row.astype(np.intp) * 9 + state
        begins[j] = flags[at]
        state = flat[at].astype(np.intp)
    return np.flatnonzero(begins.T.ravel()[:n])


def piece_bounds(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in the code points of all texts, an end mark after each, which begins too; and where each text
    ends, its mark included."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    points = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    joined = "\0".join(texts) + "\0" if texts else ""
    points[:] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points[ends - 1] = 0x110000
    return piece_starts(points) if len(points) else np.zeros(0, np.int64), ends


def split_pieces(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """Of each text its pieces and where they begin, in code points; the last bound is the text's length."""
    starts, ends = piece_bounds(texts)
    joined = "\0".join(texts) + "\0" if texts else ""
    cut = np.searchsorted(starts, np.concatenate([[0], ends]))
    out = []
    for i, text in enumerate(texts):
        own = starts[cut[i] : cut[i + 1]]  # ends with the end mark
        bounds = own.tolist()
        out.append(([joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], own - (ends[i] - len(text) - 1)))
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: visible Latin-1 characters for themselves, the other bytes
    in order for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks of a byte-level BPE. path: a .tiktoken file of lines "base64 rank", or a .json file of vocabulary, merges,
    added tokens and the steps before the model, which must be those that this module takes."""

    def __init__(self, path: str):
        self.special = ""  # the string that is one token wherever it stands
        if path.endswith(".json"):
            self._read_json(path)
        else:
            with open(path, "rb") as f:
                self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    def _read_json(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before, letters = said["model"], said["pre_tokenizer"] or {}, _byte_letters()
        if said["normalizer"] or model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or prefix space")
        plain = lambda word: bytes(letters[c] for c in word)
        self.ranks = {plain(w): i for w, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [self.ranks[plain(a) + plain(b)] for a, b in merges]
        if order != sorted(order) or model.get("ignore_merges"):
            raise ValueError(f"{path}: merges must be in the order of their ids")
        special = [t["content"] for t in said["added_tokens"]]
        if len(special) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError(f"{path}: at most one added token, which takes nothing beside it")
        self.special = "".join(special)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is joined first, the leftmost of equal ones."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        return [ranks[p] for p in self._joined(piece)]

    def _joined(self, piece: bytes) -> list[bytes]:
        get, never = self.ranks.get, 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        found = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while found and (best := min(found)) < never:
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i < len(found):
                found[i] = get(parts[i] + parts[i + 1], never)
            if i:
                found[i - 1] = get(parts[i - 1] + parts[i], never)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and links, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Cache(dict):
    """A value for each piece, made when it is first asked for; emptied when it grows beyond `most` entries."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        value = self.make(piece)
        if len(piece) <= 256:
            self[piece] = value
        return value


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Pieces of more bytes are merged one by one; the rank of no pair; so many pieces are hashed at once.
LONG, NEVER, HASHED = 48, np.int32(2**31 - 1), 1 << 18


class Merges:
    """A vocabulary as arrays: ids of a single byte, ranks of pairs, and each token's bytes and decimal by its id."""

    def __init__(self, words: Vocabulary):
        self.words, ranks = words, words.ranks
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort(a << 32 | b)
        self.keys, self.ranks = (a << 32 | b)[order], np.append(r[order].astype(np.int32), NEVER)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.byte_pairs = self.pair(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))
        said = [words.tokens.get(i, b"") for i in range(max(words.tokens) + 1)]
        self.tokens, self.decimals = pa.array(said, pa.large_binary()), pa.array([f"{i} ".encode() for i in range(len(said))], pa.large_binary())

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merged(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pieces: bytes of pieces of equal length, one in a row. All ids in a row, and how many each piece has. Each
        step joins one pair of every piece: that of lowest rank, the leftmost of equal ones."""
        n, size = pieces.shape
        ids = self.bytes[pieces]
        ranks = np.full((n, size), NEVER)
        ranks[:, :-1] = self.byte_pairs[pieces[:, :-1].astype(np.intp) << 8 | pieces[:, 1:]]
        after, before = np.tile(np.arange(1, size + 1, dtype=np.int16), (n, 1)), np.tile(np.arange(-1, size - 1, dtype=np.int16), (n, 1))
        flat_ids, flat_ranks, flat_after, flat_before = ids.ravel(), ranks.ravel(), after.ravel(), before.ravel()
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(1)
            best = flat_ranks[live * size + at]
            some = best < NEVER
            live, at, best = live[some], at[some], best[some]
            row = live * size
            here, gone = row + at, row + flat_after[row + at]
            then, left = flat_after[gone].astype(np.intp), flat_before[here].astype(np.intp)
            flat_ids[here], flat_ids[gone] = best, -1
            flat_ranks[gone] = flat_ranks[here] = NEVER
            flat_after[here] = then
            some = np.flatnonzero(then < size)
            flat_before[row[some] + then[some]] = at[some]
            flat_ranks[here[some]] = self.pair(best[some], flat_ids[row[some] + then[some]])
            some = np.flatnonzero(left >= 0)
            flat_ranks[row[some] + left[some]] = self.pair(flat_ids[row[some] + left[some]], best[some])
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def ids(self, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of many pieces all ids in a row, and how many each has."""
        sizes, n = ends - begins, len(begins)
        counts, parts, place = np.zeros(n, np.int64), [], np.zeros(n, np.int64)
        order, total = np.argsort(sizes, kind="stable"), 0
        cut = np.searchsorted(sizes[order], np.arange(LONG + 2))
        for size in range(1, LONG + 1):
            own = order[cut[size] : cut[size + 1]]
            if len(own):
                made, counts[own] = self.merged(buf[begins[own][:, None] + np.arange(size)])
                place[own] = total + np.cumsum(counts[own]) - counts[own]
                parts.append(made)
                total += len(made)
        for k in order[cut[LONG + 1] :]:
            made = np.array(self.words.merge(buf[begins[k] : ends[k]].tobytes()), np.int32)
            counts[k], place[k] = len(made), total
            parts.append(made)
            total += len(made)
        return _gathered(np.concatenate([*parts, np.zeros(0, np.int32)]), place, counts), counts


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of values, one after the other."""
    to = np.cumsum(sizes)
    return values[np.arange(to[-1] if len(to) else 0) + np.repeat(begins - to + sizes, sizes)]


@lru_cache(2)
def _merges(path: str) -> Merges:
    return Merges(vocabulary(path))


def encode(texts: list[str], path: str) -> Iterator[tuple[np.ndarray, memoryview, memoryview, np.ndarray]]:
    """Of each text: ids, the ids as decimals joined by spaces, the bytes that the ids stand for, and where pieces begin
    (code points; the last bound is the text's length).

    Equal pieces are told by hashes of 64 bits and merged once. That the ids stand for the bytes of the very pieces is
    then held against the texts, so that pieces of equal hash cannot be taken for one another.
    """
    if not texts:
        return
    merges = _merges(path)
    joined = ("\0".join(texts) + "\0").encode("utf-8", "surrogatepass")
    buf, (starts, ends) = np.frombuffer(joined, np.uint8), piece_bounds(texts)
    place = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # of code points, in bytes
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, ends - 1)] = False  # the end marks
    begin, end = place[starts[own]], place[np.append(starts[1:], ends[-1])[own]]
    hashes = [spans_hash(buf, begin[k : k + HASHED], end[k : k + HASHED]) for k in range(0, len(begin), HASHED)]
    _, one, at = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
    ids, counts = merges.ids(buf, begin[one], end[one])
    size = counts[at]
    ids = _gathered(ids, (np.cumsum(counts) - counts)[at], size)
    said, decoded = merges.decimals.take(pa.array(ids)), merges.tokens.take(pa.array(ids))
    tokens = np.concatenate([[0], np.cumsum(size)])
    to, back = (np.frombuffer(x.buffers()[1], np.int64)[: len(ids) + 1] for x in (said, decoded))
    letters = np.ones(len(buf), bool)
    letters[place[ends - 1]] = False
    data = np.frombuffer(decoded.buffers()[2] or b"", np.uint8)[: back[-1]]
    if not (np.array_equal(back[tokens[1:]] - back[tokens[:-1]], end - begin) and np.array_equal(data, buf[letters])):
        ids, counts = merges.ids(buf, begin, end)  # two pieces of one hash: each by itself
        said, decoded, tokens = merges.decimals.take(pa.array(ids)), merges.tokens.take(pa.array(ids)), np.concatenate([[0], np.cumsum(counts)])
        to, back = (np.frombuffer(x.buffers()[1], np.int64)[: len(ids) + 1] for x in (said, decoded))
    pieces = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(starts, np.concatenate([[0], ends]))]
    cut = tokens[pieces]
    said, decoded = (memoryview(x.buffers()[2] or b"") for x in (said, decoded))
    kept, first = starts[own], np.concatenate([[0], ends])
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        bounds = np.append(kept[pieces[i] : pieces[i + 1]], first[i + 1] - 1) - first[i]
        yield ids[a:b], said[to[a] : max(to[a], to[b] - 1)], decoded[back[a] : back[b]], bounds


def _strings(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[str]]]:
    for first, part in text_chunks(batch.column(batch.schema.get_field_index(text))):
        yield first, part.to_pylist()


def _with(df: DataFrame, new: str) -> tuple[DataFrame, str]:
    """df without columns that the result adds, and the schema of the result."""
    names = {x.split()[0].lower() for x in new.split(", ")}
    kept = df.drop(*[c for c in df.columns if c.lower() in names])
    return kept, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [new])


def with_bpe(df: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """Operator 1: adds ids array<int>, piece_starts array<int> (code points), n_tokens and SHA-256 of the ids
    (decimals joined by a space) and of the decoded bytes. ids=False leaves the arrays out.

    Decoding goes from the ids back over the token bytes, so decoded_sha256 proves the round trip.
    """
    small_batches(df.sparkSession)
    kept, schema = _with(df, ("ids array<int>, piece_starts array<int>, " if ids else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        for batch in batches:
            own: list[list] = [[], [], [], [], []]
            for _, texts in _strings(batch, text):
                for numbers, said, decoded, bounds in encode(texts, path):
                    own[2].append(len(numbers))
                    own[3].append(hashlib.sha256(said).hexdigest())
                    own[4].append(hashlib.sha256(decoded).hexdigest())
                    if ids:
                        own[0].append(numbers)
                        own[1].append(bounds[:-1].astype(np.int32))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(v, t) for v, t in list(zip(own, kinds, strict=True))[0 if ids else 2 :]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(["ids", "piece_starts"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, schema)


# ---- operator 5 -------------------------------------------------------------------------------------------------


class PrefixCounter:
    """Exact token counts at every prefix of a piece, by dynamic programming over bytes.

    A row of tokens is what BPE makes of their bytes exactly if each two neighbours are what BPE makes of theirs.
    So the encoding of a prefix ends in the one token that can follow the last token of the prefix before it, and
    its count is that prefix's count and one.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.ends = vocab, {t[k:] for t in vocab.ranks for k in range(len(t))}
        self.nodes: dict[bytes, tuple[bytes, int]] = {}
        self.follows: dict[tuple[bytes, bytes], bool] = {}

    def can_follow(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 500_000:
                self.follows.clear()
            known = self.follows[key] = self.vocab.merge(a + b) == [self.vocab.ranks[a], self.vocab.ranks[b]]
        return known

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i from 0 to its length. Pieces share what is known of their common prefixes."""
        nodes, out = self.nodes, [0]
        if len(nodes) > 1_000_000:
            nodes.clear()
        own = {} if len(piece) > 256 else nodes  # prefixes of very long pieces are not kept
        for i in range(1, len(piece) + 1):
            prefix = piece[:i] if own is nodes else i
            known = own.get(prefix)
            if known is None:
                known = own[prefix] = self._last(piece, i, own)
            out.append(known[1])
        return out

    def _last(self, piece: bytes, i: int, own: dict) -> tuple[bytes, int]:
        """Last token of piece[:i], and the tokens of it."""
        ranks, ends = self.vocab.ranks, self.ends
        first = i - 1
        while first and piece[first - 1 : i] in ends:
            first -= 1
        for k in range(first, i):
            token = piece[k:i]
            if token in ranks:
                if k == 0:
                    if self._itself(token):
                        return token, 1
                else:
                    last, n = own[piece[:k] if own is self.nodes else k]
                    if self.can_follow(last, token) and self._itself(token):
                        return token, n + 1
        raise ValueError("no token ends here: the vocabulary lacks single bytes")

    @lru_cache(100_000)  # noqa: B019
    def _itself(self, token: bytes) -> bool:
        """Whether BPE makes this token of its own bytes; else it never stands in an encoding."""
        return len(token) == 1 or self.vocab._joined(token) == [token]


@lru_cache(2)
def _prefixes(path: str) -> Cache:
    counter = PrefixCounter(vocabulary(path))

    def make(piece: str) -> list[int]:
        at = list(accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0))
        whole = counter.counts(piece.encode("utf-8", "surrogatepass"))
        return whole if len(at) == len(whole) else [whole[i] for i in at]

    return Cache(make, 500_000)


def _sections(text: str, special: str) -> list[str]:
    """Text between special strings; each of those is one token."""
    return text.split(special) if special else [text]


class PrefixTable:
    """Token counts at all prefixes of a text, kept as counts at piece starts and inside pieces.

    at(i): tokens of text[:i] encoded on its own; within(budget): the longest prefix of at most that many tokens.
    Cutting may change how the end of the prefix splits (white space before the cut, contractions, a special string
    cut in two), so those prefixes are counted from the last place at which every split agrees.
    """

    def __init__(self, text: str, path: str, special: str = "<|endoftext|>", split: list | None = None, upto: int | None = None):
        """split: what split_pieces makes of the sections, where it is known; upto: leave out what begins after so many tokens."""
        self.text, self.cache, self.special = text, _prefixes(path), special
        self.starts, self.before, self.inner = [], [], []
        at = tokens = 0
        sections = _sections(text, special)
        for k, (pieces, bounds) in enumerate(split_pieces(sections) if split is None else split):
            if upto is not None and tokens > upto:
                break
            for p, b in zip(pieces, bounds.tolist(), strict=False):
                self.starts.append(at + b)
                self.before.append(tokens)
                self.inner.append(self.cache[p])
                tokens += self.inner[-1][-1]
                if upto is not None and self.before[-1] > upto:
                    break
            at += len(sections[k])
            if k + 1 < len(sections):
                self.starts.append(at)
                self.before.append(tokens)
                self.inner.append(None)
                tokens, at = tokens + 1, at + len(special)
        self.total = tokens

    def at(self, i: int) -> int:
        import bisect

        if i >= len(self.text):
            return self.total
        if i <= 0 or not self.starts:
            return 0
        j = bisect.bisect_right(self.starts, i - 1) - 1
        back = j  # the pieces before are the same in the cut text from where no white space or mark touches the cut
        while back > 0 and (self.inner[back] is None or self.text[self.starts[back]].isspace() and self.text[self.starts[back] - 1].isspace()):
            back -= 1
        if back == j and self.inner[j] is not None and self.text[self.starts[j]] != "'":
            return self.before[j] + self.inner[j][i - self.starts[j]]
        if self.inner[back] is None:
            back = j
        tail = self.text[self.starts[back] : i]
        return self.before[back] + sum(self.cache[p][-1] for s in split_pieces(_sections(tail, self.special)) for p in s[0]) + tail.count(self.special) * bool(self.special)

    def counts(self) -> list[int]:
        return [self.at(i) for i in range(len(self.text) + 1)]

    def within(self, budget: int) -> int:
        """Code points of the longest prefix whose own encoding has at most `budget` tokens."""
        import bisect

        if self.total <= budget:
            return len(self.text)
        j = bisect.bisect_right(self.before, budget)
        best = 0
        for i in range(self.starts[max(0, j - 2)], min(len(self.text), (self.starts[j] if j < len(self.starts) else len(self.text))) + 1):
            if self.at(i) <= budget:
                best = i
        return best


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024, special: str | None = None, prefixes: bool = False) -> DataFrame:
    """Operator 5: adds n_bytes, n_tokens, over_limit (n_tokens > limit) and fit_chars, the code points of the
    longest prefix within the limit, all read from prefix counts; prefixes=True adds prefix_counts array<int>,
    the tokens of text[:i] for each i. `special` inside a text is one token (None: as the
    vocabulary file says; "": nothing is).
    """
    special = vocabulary(path).special if special is None else special
    small_batches(df.sparkSession)
    kept, schema = _with(df, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_counts array<int>" * prefixes)

    def run(batches):
        cache = _prefixes(path)
        for batch in batches:
            sizes, counts, fits, tables = [], [], [], []
            for _, texts in _strings(batch, text):
                parts = [_sections(t, special) for t in texts]
                split = iter(split_pieces([s for p in parts for s in p]))
                for t, p in zip(texts, parts, strict=True):
                    own = [next(split) for _ in p]
                    n = len(p) - 1 + sum(sum([cache[x][-1] for x in pieces]) for pieces, _ in own)
                    sizes.append(len(t.encode("utf-8", "surrogatepass")))
                    counts.append(n)
                    fits.append(PrefixTable(t, path, special, own, limit).within(limit) if n > limit else len(t))
                    tables.append(PrefixTable(t, path, special, own).counts() if prefixes else None)
            n = np.array(counts, np.int64)
            made = [pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit), pa.array(fits, pa.int64())] + [pa.array(tables, pa.list_(pa.int32()))] * prefixes
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_bytes", "n_tokens", "over_limit", "fit_chars", *["prefix_counts"] * prefixes])

    return kept.mapInArrow(run, schema)
