"""Operator 7: language identification with a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon (whole word) features, hashed into one weight table; learned
transitions join neighbours. Forward-backward gives each word's posterior, so code-switched texts are labelled word
by word; a text's language is the one with the highest mean posterior over its words that have a letter.

Training lines are runs of words from texts of one language each, joined to lines that switch, so transitions are
learned and not only "never switch". Null texts and texts without a letter are `und` with score 0. A language whose
texts hold no word is not learned. Repeated rows give repeated results; very long texts are labelled whole;
columns of the input named as results are replaced; an empty table gives no rows.

Posteriors only compare the learned languages. Whether a text is in one of them at all is told by `familiar`: the
share of its words' longer n-grams that training has met often enough. Bounds for both are set on the texts held back
from training. `learn` covers all rows in the tasks; `fit` is its form for a few texts in memory.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _with
from .text import mix, small_batches, spans_hash, text_chunks, utf8

#: Code points that `_spread` leaves of a text, at most, and in how many stretches. `learn` takes whole texts.
SAMPLE_CHARS, STRETCHES = 4_000, 8
TABLE = 1 << 18
#: Bytes of text whose sequences run side by side.
SPAN_BYTES = 1 << 20
_OTHER = np.ones(256, bool)  # bytes between words: ASCII but letters
_OTHER[97:123] = False
_OTHER[128:] = False


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: bytes, begins and ends of words (runs of letters), and each text's bounds in words."""
    buf, off = utf8(col)
    word = ~_OTHER[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[:-1][off[:-1] < len(buf)]
    first[cut] = word[cut]
    begins = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    return buf, begins, np.flatnonzero(last) + 1, np.searchsorted(begins, off)



def features(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(word, place in the weight table) of every feature: byte n-grams of 2 to 5 with word edges, and the word.

    Also where those of 4 bytes and more, and whole words, begin.
    """
    sizes = ends - begins + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(begins)), sizes)
    place = np.arange(at[-1]) - at[word]
    spelled = np.ones(at[-1], np.uint64)  # 1 begins a word, 2 ends it
    inner = (place > 0) & (place < sizes[word] - 1)
    spelled[at[1:] - 1] = 2
    spelled[inner] = buf[(begins[word] + place - 1)[inner]]
    rows, index, gram, longer = [], [], spelled.copy(), 0
    for n in range(2, 6):
        gram = gram[:-1] * np.uint64(257) + spelled[n - 1 :]
        ok = (place + n <= sizes[word])[: len(gram)]
        rows.append(word[: len(gram)][ok])
        index.append(mix(gram[ok] * np.uint64(8) + np.uint64(n)) % np.uint64(TABLE))
        longer += len(rows[-1]) * (n < 4)
    whole = np.zeros(len(begins), np.uint64)
    if len(begins):
        whole = mix(np.add.reduceat(mix(spelled + np.uint64(512) * place.astype(np.uint64)), at[:-1])) % np.uint64(TABLE)
    return np.concatenate([*rows, np.arange(len(begins))]), np.concatenate([*index, whole]).astype(np.int64), longer


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # TABLE x labels
    moves: np.ndarray  # labels x labels
    begin: np.ndarray
    least_score: float = 0.0  # of texts that are in a learned language
    least_familiar: float = 0.0
    known: np.ndarray | None = None  # places of familiar n-grams

    @cached_property
    def met(self) -> np.ndarray:
        """Places of the table that are familiar: without `known` those that training has touched."""
        return self.weights.any(1) if self.known is None else self.known

    def emissions(self, rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, self.weights[:, j][index], n) for j in range(len(self.labels))], 1)

    def label(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sums of its words' posteriors by label, words, and the familiar share of its words."""
        part = lowered(part)
        buf, begins, ends, bounds = words_of(part)
        n, k = len(part), len(self.labels)
        _, one, at = np.unique(spans_hash(buf, begins, ends), return_index=True, return_inverse=True)
        rows, index, longer = features(buf, begins[one], ends[one])
        p = posteriors(self.emissions(rows, index, len(one))[at], bounds, self.moves, self.begin)
        met = np.bincount(rows[longer:], self.met[index[longer:]], len(one)) / np.maximum(np.bincount(rows[longer:], minlength=len(one)), 1)
        doc, words = np.repeat(np.arange(n), np.diff(bounds)), np.diff(bounds)
        sums = np.stack([np.bincount(doc, p[:, j], n) for j in range(k)], 1)
        return sums, words, (np.bincount(doc, met[at], n) + PATIENCE) / (words + PATIENCE)


#: So many words are taken as familiar in each text besides its own, so that few unknown words don't decide.
PATIENCE = 3


def forward_backward(emit: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over many sequences at once. emit: scores of all words in a row; bounds: of each sequence.

    Sequences are cut into blocks of at most BLOCK words, whose transition matrices are worked out side by side; a scan
    over these gives what comes into each block from both sides. Within blocks, ordered by length, step t works on those
    that have a word t. Returns, for all words and up to a factor for each word: the sums of paths up to it, of paths
    after it, and its own exponential score.
    """
    k = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True)) if len(emit) else emit
    m, fwd, bwd, ones = np.exp(moves), np.empty_like(e), np.ones_like(e), np.ones((k, 1))
    many = -(-np.diff(bounds) // BLOCK)  # blocks of each sequence
    to = np.cumsum(many)
    seq = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(seq)) - (to - many)[seq]
    first = np.asarray(bounds)[:-1][seq] + place * BLOCK
    sizes = np.minimum(np.asarray(bounds)[1:][seq] - first, BLOCK)
    into, after = np.tile(np.exp(begin), (len(seq), 1)), np.ones((len(seq), k))
    several = np.flatnonzero(many > 1)
    if len(several):
        several = several[np.argsort(-many[several], kind="stable")]
        deep = -many[several]
        own = np.flatnonzero(many[seq] > 1)
        whole = np.empty((len(seq), k, k))
        whole[own] = _transfers(e, first[own], sizes[own], m)
        for j in range(1, -int(deep[0])):  # block j - 1 of each sequence that has a block j
            at = (to - many)[several[: np.searchsorted(deep, -j, "left")]] + j
            a = ((into[at - 1][:, None] @ whole[at - 1])[:, 0]) @ m
            into[at] = a / a.sum(1, keepdims=True)
            at = to[several[: len(at)]] - j
            b = (whole[at] @ after[at][:, :, None])[:, :, 0] @ m.T
            after[at - 1] = b / b.sum(1, keepdims=True)
    order = np.argsort(-sizes, kind="stable")
    first, sizes, into, after = first[order], sizes[order], into[order], after[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    before = None
    for t in range(longest):
        at = first[: live[t]] + t
        a = e[at] * (into[: live[t]] if t == 0 else before[: live[t]] @ m)
        a /= a @ ones
        fwd[at] = before = a
    for t in range(longest - 1, -1, -1):
        at = first[: live[t]] + t
        bwd[at] = after[: live[t]]
        b = (e[at] * after[: live[t]]) @ m.T
        after[: live[t]] = b / (b @ ones)
    return fwd, bwd, e


#: Words of a sequence that are walked one after the other.
BLOCK = 96


def _transfers(e: np.ndarray, first: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of each block, up to a factor: the sums of its paths by first and last label."""
    order, k = np.argsort(-sizes, kind="stable"), len(m)
    live = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), "right")
    made = e[first[order]][:, :, None] * np.eye(k)
    for t in range(1, len(live)):
        n = live[t]
        step = (made[:n].reshape(-1, k) @ m).reshape(n, k, k) * e[first[order[:n]] + t][:, None]
        made[:n] = step / step.reshape(n, -1).sum(1)[:, None, None]
    out = np.empty_like(made)
    out[order] = made
    return out


def posteriors(emit: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of every word, the probability of each label."""
    fwd, bwd, _ = forward_backward(emit, bounds, moves, begin)
    p = fwd * bwd
    return p / p.sum(1, keepdims=True) if len(p) else p


def gradients(emit: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of labels y, by emissions, transitions and first labels."""
    fwd, bwd, e = forward_backward(emit, bounds, moves, begin)
    wrong = fwd * bwd
    wrong /= wrong.sum(1, keepdims=True)
    wrong[np.arange(len(y)), y] -= 1
    starts = bounds[:-1][np.diff(bounds) > 0]
    inner = np.ones(len(y), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    m, left, right = np.exp(moves), fwd[inner - 1], e[inner] * bwd[inner]
    move = m * ((left / ((left @ m * right) @ np.ones((len(m), 1)))).T @ right)
    move -= np.bincount(y[inner - 1] * len(move) + y[inner], minlength=move.size).reshape(move.shape)
    return wrong, move, wrong[starts].sum(0)


def fit(texts: list[str], langs: list[str], rounds: int = 80, lines: int = 200, seed: int = 5) -> Crf:
    """Languages whose texts have no word are left out, unless none has one. Every sixth text only sets the bounds."""
    rng = np.random.default_rng(seed)
    buf, begins, ends, bounds = words_of(lowered(pa.array(texts, pa.string())))
    spans: dict[str, list[tuple[int, int]]] = {}
    held, met = [], Counter()
    for text, a, b, name in zip(texts, bounds, bounds[1:], langs, strict=False):
        if b > a:
            met[name] += 1
            if met[name] % 6:
                spans.setdefault(name, []).append((a, b))
            else:
                held.append(text)
    labels = sorted(spans or set(langs))
    pools, k = [spans.get(name, []) for name in labels], len(labels)
    model = Crf(labels, np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k))
    seen_w, seen_m, seen_b = np.full((TABLE, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    if k < 2 or not spans:
        return model
    for _ in range(rounds):
        flat, gold, cuts, total = [], [], [0], 0
        for _ in range(lines):
            for _ in range(rng.integers(1, 4)):
                y = int(rng.integers(k))
                a, b = pools[y][rng.integers(len(pools[y]))]
                a = a + int(rng.integers(max(1, b - a - 8)))
                run = np.arange(a, min(b, a + int(rng.integers(4, 20))))
                flat.append(run)
                gold.append(np.full(len(run), y))
                total += len(run)
            cuts.append(total)
        flat, y = np.concatenate(flat), np.concatenate(gold)
        rows, index, _ = features(buf, begins[flat], ends[flat])
        wrong, move, begin = gradients(model.emissions(rows, index, len(flat)), np.asarray(cuts), model.moves, model.begin, y)
        grad = np.stack([np.bincount(index, wrong[rows, j], TABLE) for j in range(k)], 1)
        for value, g, seen, rate in ((model.weights, grad, seen_w, 0.3), (model.moves, move, seen_m, 0.3), (model.begin, begin, seen_b, 0.1)):
            seen += g * g
            value -= rate * g / np.sqrt(seen)
    if held:
        sums, words, familiar = model.label(pa.array(held, pa.string()))
        scores = sums.max(1) / np.maximum(words, 1)
        model.least_score, model.least_familiar = (share * float(np.quantile(x, 0.01)) for share, x in zip(LENIENCY, (scores, familiar), strict=True))
    return model


#: Texts of a learned language have at least these shares of the score and of the familiar words that all but a
#: hundredth of the texts held back have. Mixed texts of learned languages have low scores, so that share is low.
LENIENCY = 0.5, 0.75


def _spread(text: Column, chars: int) -> Column:
    """text, or stretches of it that together have at most `chars` code points."""
    size = (chars - STRETCHES) // STRETCHES
    begin = lambda i: F.floor(i * (F.length(text) - size) / (STRETCHES - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substr(text, begin(i), F.lit(size)))
    return F.when(F.length(text) > chars, F.array_join(parts, "\n")).otherwise(text)


def _steps(part: pa.Array, gold: np.ndarray, rng: np.random.Generator, lines):
    """All words of the texts once, as steps of switching lines: features of each step's distinct words (row, place),
    which of these each word is, its label, and bounds of lines. lines(): how many the next step takes."""
    buf, begins, ends, bounds = words_of(lowered(part))
    if not len(begins):
        return
    _, one, at = np.unique(spans_hash(buf, begins, ends), return_index=True, return_inverse=True)
    rows, index, _ = features(buf, begins[one], ends[one])
    order = np.argsort(rows, kind="stable")
    index, where = index[order], np.searchsorted(rows[order], np.arange(len(one) + 1))
    label, slot = np.repeat(gold, np.diff(bounds)), np.zeros(len(one), np.int64)
    cuts = np.cumsum(rng.integers(4, 20, len(begins) // 4 + 1))
    runs = np.unique(np.concatenate([cuts[cuts < len(begins)], bounds[:-1][bounds[:-1] < len(begins)]]))
    sizes = np.diff(runs, append=len(begins))
    order = rng.permutation(len(runs))
    ends_of = np.unique(np.minimum(np.cumsum(rng.integers(1, 4, len(runs))), len(runs)))  # lines, in runs
    a = 0
    while a < len(ends_of):
        b = min(len(ends_of), a + lines())
        took = order[ends_of[a - 1] if a else 0 : ends_of[b - 1]]
        size = sizes[took]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(total[-1]) + np.repeat(runs[took] - total[:-1], size)
        words = np.flatnonzero(np.bincount(at[flat], minlength=len(one)))
        slot[words] = np.arange(len(words))
        own = slot[at[flat]]
        many = where[words + 1] - where[words]
        begin = np.concatenate([[0], np.cumsum(many)])
        places = index[np.arange(begin[-1]) + np.repeat(where[words] - begin[:-1], many)]
        bound = total[np.concatenate([[0], ends_of[a:b] - (ends_of[a - 1] if a else 0)])]
        yield np.repeat(np.arange(len(words)), many), places, own, label[flat], bound
        a = b


def _trained(chunks, labels: list[str], weight: np.ndarray) -> list[np.ndarray]:
    """Weights that one task learns from all its texts, moves and first labels below them; the squares of their
    gradients; and how often each place was met, by weight of the word's language. A task of few texts takes them
    again; only so many are held."""
    k, rng, done = len(labels), np.random.default_rng(5), 0
    value, seen, met = np.zeros((TABLE + k + 1, k), order="F"), np.zeros((TABLE + k + 1, k), order="F"), np.zeros(TABLE)  # looked up by label
    model = Crf(labels, value[:TABLE], value[TABLE:-1], value[-1])
    rate = np.full((len(value), 1), 0.3)
    rate[-1] = 0.1
    slot, rest = np.zeros(TABLE, np.int64), np.arange(TABLE, TABLE + k + 1)
    lines = lambda: FIRST_LINES if done < FIRST_STEPS else LINES
    held, again = [], False

    def passed():
        nonlocal again
        for part, gold in chunks:
            if len(held) < HELD:
                held.append((part, gold))
            yield part, gold
        again = True
        while held and 0 < done < FIRST_STEPS:
            yield from held

    for part, gold in passed():
        for rows, places, own, y, bounds in _steps(part, gold, rng, lines):
            emit = model.emissions(rows, places, int(own.max()) + 1)[own]
            wrong, move, begin = gradients(emit, bounds, model.moves, model.begin, y)
            if not again:
                met += np.bincount(places, np.bincount(own, weight[y])[rows], TABLE)
            wrong = wrong * weight[y][:, None]
            here = np.flatnonzero(np.bincount(places, minlength=TABLE))  # what no word of the step has does not move
            slot[here] = np.arange(len(here))
            grad, own_place = np.empty((len(here) + k + 1, k), order="F"), slot[places]
            for j in range(k):
                grad[: len(here), j] = np.bincount(own_place, np.bincount(own, wrong[:, j])[rows], len(here))
            grad[len(here) : -1], grad[-1] = move, begin
            here = np.concatenate([here, rest])
            squares = seen[here] + grad * grad
            seen[here] = squares
            value[here] -= rate[here] * grad / np.sqrt(squares + 1e-6)
            done += 1
    return [value, seen, met]


#: Bytes of text that one task learns from; a step's lines, and those of the first steps, which every task takes.
TASK_BYTES, LINES, FIRST_LINES, FIRST_STEPS = 24 << 20, 2_000, 200, 80
#: Chunks (of SPAN_BYTES) that a task of few texts may take again.
HELD = 4
#: An n-gram is familiar if it is met once in so many words, languages weighted alike.
MET_WORDS = 400_000
#: Parts of the table in which the tasks' weights are added up.
BLOCKS = 32


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bounds: bool = True) -> Crf:
    """df: the rows to learn from, all of them and whole. With bounds, least_score and least_familiar too.

    Each task learns from its texts; weights are then averaged by the squares of their gradients, so that what only some
    tasks met is not thinned out. A sixth of the texts (by hash of the key) only sets the bounds. Only weights, as many
    as TABLE x labels, reach the driver.
    """
    spark = df.sparkSession
    small_batches(spark)
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), (F.pmod(F.xxhash64(F.col(key)), F.lit(6)) == 0).alias("_held"))
    worded = known.where(F.col("_text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    kept = F.sum(F.when(~F.col("_held"), F.octet_length("_text")).otherwise(0))
    sizes = {r[0]: (r[1], r[2]) for r in worded.groupBy("_lang").agg(F.sum(F.octet_length("_text")), kept).collect()}  # as many rows as there are languages
    if not sizes:
        labels = sorted(r[0] for r in known.select("_lang").distinct().collect()) or ["und"]
        return Crf(labels, np.zeros((TABLE, len(labels))), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    labels, k = sorted(sizes), len(sizes)
    never_held = [n for n in labels if not sizes[n][1]]  # all its texts would be held back
    worded = worded.withColumn("_held", F.col("_held") & ~F.col("_lang").isin(never_held)) if never_held else worded
    mass = np.array([sizes[n][1] or sizes[n][0] for n in labels], float)
    weight = np.minimum(mass.max() / mass, MOST_WEIGHT)
    width, at = -(-(TABLE + k + 1) // BLOCKS), {n: i for i, n in enumerate(labels)}

    def train(batches):
        def chunks():
            for batch in batches:
                gold = np.array([at[n] for n in batch.column("_lang").to_pylist()], np.int64)
                for first, part in text_chunks(batch.column("_text"), SPAN_BYTES):
                    yield part, gold[first : first + len(part)]

        value, seen, met = _trained(chunks(), labels, weight)
        if seen.any():
            met = np.concatenate([met, np.zeros(k + 1)])
            for i in range(BLOCKS):
                own = slice(i * width, (i + 1) * width)
                sent = [(value[own] * seen[own]), seen[own], met[own]]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x.astype(np.float32).tobytes()]) for x in sent]], ["block", "value", "seen", "met"])

    def add(table: pa.Table) -> pa.Table:
        value, seen, met = (sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in table[c]) for c in ("value", "seen", "met"))
        mean = np.divide(value, seen, out=np.zeros_like(value), where=seen > 0)
        return pa.table({"block": table["block"][:1], "value": pa.array([mean.astype(np.float32).tobytes()]), "met": pa.array([met.astype(np.float32).tobytes()])})

    tasks = max(1, -(-int(mass.sum()) // TASK_BYTES))
    sent = worded.where("NOT _held").select("_text", "_lang").coalesce(tasks).mapInArrow(train, "block int, value binary, seen binary, met binary")
    blocks = sorted(sent.groupBy("block").applyInArrow(add, "block int, value binary, met binary").collect())
    if not blocks:  # one language: nothing to tell apart
        return Crf(labels, np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k))
    value, met = (np.concatenate([np.frombuffer(r[c], np.float32) for r in blocks]).astype(float) for c in ("value", "met"))
    value = value.reshape(-1, k)
    total = float((mass * weight).sum()) / BYTES_A_WORD
    model = Crf(labels, value[:TABLE], value[TABLE:-1], value[-1], known=(met[:TABLE] > 0) & (met[:TABLE] * MET_WORDS >= total))
    if bounds:
        held = with_language(worded.where("_held").select("_text"), model, "_text").where("lang_pred <> 'und'")
        low = held.agg(*[F.percentile_approx(c, 0.01, 10_000) for c in ("score", "familiar")]).first()
        if low[0] is not None:
            model.least_score, model.least_familiar = (share * x for share, x in zip(LENIENCY, low, strict=True))
    return model


#: How much more the words of a rare language may count in learning; about so many bytes of text hold a word.
MOST_WEIGHT, BYTES_A_WORD = 20.0, 6.5


def with_language(df: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (mean posterior of that language over words with a letter) and familiar (0 to 1)."""
    spark = df.sparkSession
    small_batches(spark)
    kept, schema = _with(df, "lang_pred string, score double, familiar double")
    sent = spark.sparkContext.broadcast((model.labels, np.asfortranarray(model.weights, np.float32), model.moves, model.begin, 0.0, 0.0, model.met))  # bounded: TABLE x labels

    def run(batches):
        model = Crf(*sent.value)
        for batch in batches:
            names, scores, shares = [], [], []
            for _, part in text_chunks(batch.column(batch.schema.get_field_index(text)), SPAN_BYTES):
                sums, words, familiar = model.label(part)
                total, best = sums.sum(1), sums.argmax(1)
                some = total > 0
                some[some] = [any(map(str.isalpha, t)) for t in lowered(part.filter(pa.array(some))).to_pylist()]
                names += [model.labels[j] if x else "und" for j, x in zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.where(some, sums[np.arange(len(part)), best] / np.maximum(total, 1e-300), 0.0).tolist()
                shares += np.where(some, familiar, 0.0).tolist()
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score", "familiar"])

    return kept.mapInArrow(run, schema)
