"""Language-model scoring by Brown class-based bigrams.

Exchange clustering puts every training word into one of CLASSES classes, in two steps.

First units move: the UNITS most frequent words are units of their own, other words are
units by their last SUFFIX characters (the SUFFIXES most frequent of these, else one common
unit). For every unit the exact change of the class bigrams' likelihood is worked out for a
move to every other class, given where the others stand. In each round units that gain move
together; if that lowers the likelihood, fewer of them move. Rounds end when they gain less
than TOLERANCE of it (or after ROUNDS).

Then every other word moves by itself: its own neighbours' classes are counted over the
whole corpus, the same exact change picks its class, and words that gain move together, once.
If that lowers the likelihood, which is worked out anew, they stay with their units.

A word's probability is P(class | class before), interpolated with P(class) as Witten and
Bell do, times P(word | class) with one added to each count and one place in each class for
unknown words, whose class is their unit's. A text ends with the end token, a class of its own.

The base score is the unigram model with one added to each count.

Training texts are those whose crc32(doc_id as text) mod 7 is not HELD_OUT. All counts
cover all of them. Tables that reach every executor are bounded by parameters: the
units, the suffixes, the class counts, and the counts and classes of the HEAD most frequent
words (fewer, where equal counts would exceed it). Those of rarer words are joined.

Null and empty texts consist of the end token. Rows without an id are training rows.
Repeated rows are scored, and counted, one by one. With no training rows every count is 0.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, most_frequent
from tessera.session import drop, materialize

UNITS, SUFFIX, SUFFIXES, CLASSES, HEAD = 4096, 2, 1024, 32, 150_000
TOLERANCE, ROUNDS = 0.002, 30
#: The neighbours' counts of a task are handed on in so many parts.
PARTS = 16
HELD_OUT, FOLDS = 2, 7
#: Distinct words that a task holds before it hands their counts on.
MOST_HELD = 400_000
#: Neighbours that a task gathers before it hands them on, by word.
MOST_NEIGHBOURS = 2_000_000
#: Parts of words' neighbours that are looked at together.
LOT = 8000
#: Codes of a word's neighbours: the class after it, SIDE more for the class before, 2 * SIDE for the word itself.
SIDE, SPAN = 64, 256
ENCODED = "row long, doc_id long, held boolean, ids binary, units binary, tail array<string>"
WEIGHED = "doc_id long, held boolean, n long, known long, base double, emit double, classes binary"


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased; of bytes, both are that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_of(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(tokens_of(t))
                if len(held) > MOST_HELD:
                    yield {"word": [*map(text_of, held)], "c": list(held.values())}
                    held.clear()
        if held:
            yield {"word": [*map(text_of, held)], "c": list(held.values())}

    return map_batches(docs.where(~held_out()).select("text"), "word string, c long", run).groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Which unit a word is: own units from 1 on, then suffixes, last the common unit; 0 is the end."""

    def __init__(self, words: list[str], suffixes: list[str]):
        self.own = {w.encode("utf-8", "surrogatepass"): k + 1 for k, w in enumerate(words)}
        self.suffix = {s.encode("utf-8", "surrogatepass"): k + 1 + len(words) for k, s in enumerate(suffixes)}
        self.common = 1 + len(words) + len(suffixes)
        self.size = self.common + 1
        self.first_shared = 1 + len(words)

    def shared(self, word: bytes) -> int:
        end = word[-SUFFIX:]
        return self.suffix.get(end if end.isascii() else text_of(word)[-SUFFIX:].encode("utf-8", "surrogatepass"), self.common)

    def of(self, word: bytes) -> int:
        return self.own.get(word) or self.shared(word)


def packed(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind).astype(np.int64)


def encoded_texts(docs: DataFrame, units: Units, head: list[bytes]) -> DataFrame:
    """A row for each document: the units of its tokens, and the ids of those that are no units of their own
    (frequent words, then the text's other words, which are its tail)."""
    send = docs.sparkSession.sparkContext.broadcast((units, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        u, words = send.value
        known = {w: k + 1 for k, w in enumerate(words)}
        unit_of = np.array([0, *map(u.of, words)], np.int64)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for i, held, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                ws = tokens_of(text)
                tail: dict[bytes, int] = {}
                ids = np.fromiter(map(known.get, ws, itertools.repeat(0)), np.int64, len(ws))
                of, rare = unit_of[ids], np.flatnonzero(ids == 0)
                at = np.fromiter((tail.setdefault(ws[k], len(tail)) for k in rare.tolist()), np.int64, len(rare))
                ids[rare] = at + len(words) + 1
                of[rare] = np.fromiter(map(u.shared, tail), np.int64, len(tail))[at]
                out.append((row, i, held, packed(ids[of >= u.first_shared], "<u4"), packed(np.append(of, 0), "<u2"), [*map(text_of, tail)]))
                row += 1
            if out:
                yield dict(zip(["row", "doc_id", "held", "ids", "units", "tail"], zip(*out)))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), "text"), ENCODED, run)


def neighbour_counts(encoded: DataFrame, classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n[0, unit, class]: how often a unit is followed by a class; n[1, ...]: preceded; and how often by itself.

    A table of bounded size: each task adds up its own and hands it on in PARTS, which are added up by part.
    """
    many = int(classes.max()) + 1
    send = encoded.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        of = send.value
        held = np.zeros(2 * size * many + size, np.int64)
        for b in batches:
            # a text begins after an end
            x = np.concatenate([np.zeros(1, np.int64), *(unpacked(raw, "<u2") for raw in b.column("units").to_pylist())])
            u, v = x[:-1], x[1:]
            held += np.bincount(u * many + of[v], minlength=len(held))
            held += np.bincount(size * many + v * many + of[u], minlength=len(held))
            held += np.bincount(2 * size * many + u[u == v], minlength=len(held))
        yield {"part": range(PARTS), "n": [zlib.compress(p.tobytes(), 1) for p in np.array_split(held, PARTS)]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        whole: dict[int, np.ndarray] = {}  # the parts of a task, PARTS at most
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("n").to_pylist()):
                n = np.frombuffer(zlib.decompress(raw), np.int64)
                whole[part] = whole[part] + n if part in whole else n
        if whole:
            yield {"part": list(whole), "n": [zlib.compress(n.tobytes(), 1) for n in whole.values()]}

    kind = "part int, n binary"
    rows = map_batches(map_batches(encoded, kind, count).repartition("part"), kind, add).orderBy("part").collect()
    got = np.concatenate([np.frombuffer(zlib.decompress(bytes(r.n)), np.int64) for r in rows]).astype(float) if rows else np.zeros(2 * size * many + size)
    return got[: 2 * size * many].reshape(2, size, many), got[2 * size * many :]


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_pairs(n: np.ndarray, classes: np.ndarray) -> np.ndarray:
    pair = np.zeros((n.shape[2],) * 2)
    np.add.at(pair, classes, n[0])
    return pair


def likelihood(pair: np.ndarray) -> float:
    """Of the class bigrams, but for what no clustering changes."""
    return float(_entropy(pair).sum() - _entropy(pair.sum(1)).sum() - _entropy(pair.sum(0)).sum())


def best_moves(n: np.ndarray, own: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the class to which a move, of this unit alone, adds most to the likelihood; and how much.
    The end keeps its class, the first, to itself."""
    pair = class_pairs(n, classes)
    left, right = pair.sum(1), pair.sum(0)
    best, gain = classes.copy(), np.zeros(len(classes))
    for u in range(1, len(classes)):
        a, s = classes[u], own[u]
        r, l = n[0, u].copy(), n[1, u].copy()  # noqa: E741
        if not r.any() and not l.any():
            continue
        r[a] -= s
        l[a] -= s
        # without the unit
        q, lq, rq = pair.copy(), left.copy(), right.copy()
        q[a] -= r
        q[:, a] -= l
        q[a, a] -= s
        lq[a] -= r.sum() + s
        rq[a] -= l.sum() + s
        q = np.maximum(q, 0)
        # with it in each class
        base, d = _entropy(q), np.diag(q)
        rows, columns = _entropy(q + r) - base, _entropy(q + l[:, None]) - base
        add = rows.sum(1) - np.diag(rows) + columns.sum(0) - np.diag(columns) + _entropy(d + r + l + s) - _entropy(d)
        add -= _entropy(lq + r.sum() + s) - _entropy(lq) + _entropy(rq + l.sum() + s) - _entropy(rq)
        add[0] = -np.inf
        best[u] = add.argmax()
        gain[u] = add[best[u]] - add[a]
    return best, gain


def clusters(encoded: DataFrame, units: Units, counts: np.ndarray, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the counts of class bigrams."""
    many = min(CLASSES, max(units.size, 2))
    classes = np.ones(units.size, np.int64)
    order = np.argsort(-counts[1:], kind="stable") + 1
    classes[order] = np.arange(len(order)) % (many - 1) + 1
    classes[0] = 0
    rng = np.random.default_rng(7)
    n, own = neighbour_counts(encoded, classes, units.size)
    value, share = likelihood(class_pairs(n, classes)), 1.0
    best, gain = best_moves(n, own, classes)
    for _ in range(rounds):
        move = (gain > 1e-9) & (best != classes) & (rng.random(len(best)) < share)
        if not move.any():
            break
        trial = np.where(move, best, classes)
        trial_n, trial_own = neighbour_counts(encoded, trial, units.size)
        trial_value = likelihood(class_pairs(trial_n, trial))
        if trial_value <= value:
            share /= 2
            if share < 1 / 16:
                break
            continue
        small = trial_value - value < tolerance * abs(trial_value)
        classes, n, own, value = trial, trial_n, trial_own, trial_value
        if small:
            break
        best, gain = best_moves(n, own, classes)
    return classes, class_pairs(n, classes)


def word_moves(word: np.ndarray, code: np.ndarray, count: np.ndarray, start: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What best_moves says, for words (numbered, in order) whose neighbours are few: only these are looked at."""
    many, size = len(pair), len(start)
    side, at = code // SIDE, code % SIDE
    # after[w, j], before[w, j]: neighbours of other classes' words or the own class's; itself apart
    r, l = np.zeros((size, many)), np.zeros((size, many))  # noqa: E741
    r[word[side == 0], at[side == 0]] = count[side == 0]
    l[word[side == 1], at[side == 1]] = count[side == 1]
    s = np.bincount(word[side == 2], count[side == 2], size)
    each = np.arange(size)
    r[each, start] -= s
    l[each, start] -= s
    left, right, d = (np.repeat(x[None, :], size, 0) for x in (pair.sum(1), pair.sum(0), np.diag(pair)))
    left[each, start] -= r.sum(1) + s
    right[each, start] -= l.sum(1) + s
    d[each, start] -= r[each, start] + l[each, start] + s
    d = np.maximum(d, 0)
    add = _entropy(d + r + l + s[:, None]) - _entropy(d)
    more_left, more_right = (r.sum(1) + s)[:, None], (l.sum(1) + s)[:, None]
    add -= _entropy(left + more_left) - _entropy(left) + _entropy(right + more_right) - _entropy(right)
    for own, other, table in ((r, l, pair), (l, r, pair.T)):
        w, j = np.nonzero(own)
        v, a, e = own[w, j], start[w], np.arange(len(w))
        q = table[:, j].T.copy()  # [e, b]: class b next to class j, without the word
        q[e, a] -= v
        same = j == a
        q[same] -= other[w[same]]
        q[e[same], a[same]] -= s[w[same]]
        q = np.maximum(q, 0)
        change = _entropy(q + v[:, None]) - _entropy(q)
        change[e, j] = 0  # counted with the diagonal
        if len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            add[w[first]] += np.add.reduceat(change, first, axis=0)
    add[:, 0] = -np.inf
    best = add.argmax(1)
    return best, add[each, best] - add[each, start]


def word_neighbours(encoded: DataFrame, units: Units, head: list[bytes], classes: np.ndarray) -> DataFrame:
    """word, n: codes of the neighbours (SPAN * count + code) of the words that are no units, by part of the corpus."""
    send = encoded.sparkSession.sparkContext.broadcast((classes, head, len(units.own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        of, words, own = send.value
        frequent = len(words)
        tails: dict[str, int] = {}
        held: list[np.ndarray] = []
        many = 0

        def hand_on() -> dict:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            word, code = key // SPAN, key % SPAN
            first = np.flatnonzero(np.diff(word, prepend=-1))
            names = [*tails]
            ends = np.append(first, len(word)).astype(np.int64) * 8
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((n * SPAN + code).astype("<i8").tobytes())])
            return {"word": [text_of(words[w - 1]) if w <= frequent else names[w - frequent - 1] for w in word[first].tolist()], "n": data.cast(pa.binary())}

        for b in batches:
            for raw, raw_units, tail in zip(*(b.column(c).to_pylist() for c in ("ids", "units", "tail"))):
                x = unpacked(raw_units, "<u2")
                c, other = of[x], x > own
                x[other] = unpacked(raw, "<u4")
                names = np.fromiter((tails.setdefault(t, len(tails)) for t in tail), np.int64, len(tail)) + frequent + 1
                rare = x > frequent
                x[rare] = names[x[rare] - frequent - 1]
                after, before, next_word = np.append(c[1:], 0), np.concatenate([[0], c[:-1]]), np.append(x[1:], 0)
                # a text ends with the end, so every word has one after it
                here = np.flatnonzero(other)
                w = x[here] * SPAN
                keys = [w + after[here], w + SIDE + before[here], w[next_word[here] == x[here]] + 2 * SIDE]
                held += keys
                many += 2 * len(here)
            if many > MOST_NEIGHBOURS:
                yield hand_on()
                tails, held, many = {}, [], 0
        if many:
            yield hand_on()

    return map_batches(encoded.where("not held").select("ids", "units", "tail"), "word string, n binary", run)


def word_classes(neighbours: DataFrame, units: Units, classes: np.ndarray, pair: np.ndarray) -> DataFrame:
    """word, c, start, class for each training word that is no unit of its own. A word's parts meet in one
    task, one after the other, so a task holds a lot of LOT parts."""
    send = neighbours.sparkSession.sparkContext.broadcast((units, classes, pair))

    def moved(words: list[str], word: np.ndarray, code: np.ndarray, n: np.ndarray) -> dict:
        u, of, table = send.value
        start = of[np.fromiter((u.shared(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))]
        best, gain = word_moves(word, code, n, start, table)
        after = code < SIDE
        return {"word": words, "c": np.bincount(word[after], n[after], len(words)).astype(np.int64), "start": start, "class": np.where(gain > 1e-9, best, start)}

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
        names, parts = [], []
        for b in batches:
            names += b.column("word").to_pylist()
            parts += b.column("n").to_pylist()
            if len(names) >= LOT:
                yield names, parts
                names, parts = [], []
        if names:
            yield names, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, rest = None, (np.empty(0, np.int64),) * 2  # the word that may go on in the next batch
        for names, parts in lots(batches):
            words = [] if last is None else [last]
            of = []
            for w in names:
                if not words or words[-1] != w:
                    words.append(w)
                of.append(len(words) - 1)
            x = np.frombuffer(b"".join(parts), "<i8").astype(np.int64)
            word = np.concatenate([np.zeros(len(rest[0]), np.int64), np.repeat(of, [len(p) // 8 for p in parts])])
            key, place = np.unique(word * SPAN + np.concatenate([rest[0], x % SPAN]), return_inverse=True)
            n = np.bincount(place, np.concatenate([rest[1], x // SPAN]), len(key))
            word, code = key // SPAN, key % SPAN
            done = word < len(words) - 1
            if done.any():
                yield moved(words[:-1], word[done], code[done], n[done])
            last, rest = words[-1], (code[~done], n[~done].astype(np.int64))
        if last is not None:
            yield moved([last], np.zeros(len(rest[0]), np.int64), rest[0], rest[1].astype(float))

    return map_batches(neighbours.repartition("word").sortWithinPartitions("word"), "word string, c long, start long, class long", run)


class Model:
    """What the tokens of a text weigh, but for the counts and classes of rare words."""

    def __init__(self, units: Units, unit_classes: np.ndarray, head: list[bytes], head_counts: np.ndarray, head_classes: np.ndarray, inside: np.ndarray, ends: int):
        self.units, self.unit_classes, self.frequent = units, unit_classes, len(head)
        self.ends, self.own = ends, len(units.own)
        self.log_counts = np.log10(np.concatenate([[ends], head_counts]) + 1.0)
        self.classes = np.concatenate([[0], head_classes]).astype(np.int64)
        self.log_inside = np.log10(inside)


def weighed(encoded: DataFrame, rare: DataFrame, model: Model, column: str) -> DataFrame:
    """For each document the classes of its tokens and sums of its tokens' logarithms. rare: word, c, and the class."""
    rows = encoded.select("row", F.posexplode("tail").alias("k", "word")).join(rare, "word")
    rows = rows.groupBy("row").agg(F.collect_list(F.struct("k", "c", F.col(column).alias("class"))).alias("found"))
    send = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = send.value
        for b in batches:
            out = []
            for i, held, raw_units, raw, many, found in zip(*(b.column(c) for c in ("doc_id", "held", "units", "ids", "many", "found"))):
                x = unpacked(raw_units.as_py(), "<u2")
                of, other = m.unit_classes[x], x > m.own
                x[other] = unpacked(raw.as_py(), "<u4")
                rare = x > m.frequent
                of[~rare] = m.classes[x[~rare]]
                c, at = np.zeros(many.as_py(), np.int64), x[rare] - m.frequent - 1
                to = np.full(len(c), -1)
                if found.is_valid:
                    k, n, kind = (found.values.field(f).to_numpy() for f in ("k", "c", "class"))
                    c[k], to[k] = n, kind
                of[rare] = np.where(to[at] < 0, of[rare], to[at])
                lg = float(m.log_counts[x[~rare]].sum() + np.log10(c + 1)[at].sum())
                known = len(x) - int((c[at] == 0).sum()) - (m.ends == 0)
                out.append((i.as_py(), held.as_py(), len(x), known, lg, lg - float(m.log_inside[of].sum()), packed(of, "u1")))
            if out:
                yield dict(zip(["doc_id", "held", "n", "known", "base", "emit", "classes"], zip(*out)))

    return map_batches(encoded.withColumn("many", F.size("tail")).drop("tail").join(rows, "row", "left").select("doc_id", "held", "units", "ids", "many", "found"), WEIGHED, run)


def pairs_of(texts: DataFrame, many: int) -> np.ndarray:
    """The counts of class bigrams of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = np.zeros(many * many, np.int64)
        for b in batches:
            x = np.concatenate([np.zeros(1, np.int64), *(unpacked(raw, "u1") for raw in b.column("classes").to_pylist())])
            held += np.bincount(x[:-1] * many + x[1:], minlength=len(held))
        at = np.flatnonzero(held)
        yield {"at": at, "n": held[at]}

    pair = np.zeros(many * many)
    for r in map_batches(texts.where("not held").select("classes"), "at long, n long", run).groupBy("at").agg(F.sum("n").alias("n")).collect():
        pair[r["at"]] = r.n
    return pair.reshape(many, many)


def steps(pair: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    of, kinds = pair.sum(1), (pair > 0).sum(1)
    prior = (pair.sum(0) + 1) / (pair.sum() + len(pair))
    trust = of / np.maximum(of + kinds, 1)
    return np.log10(trust[:, None] * pair / np.maximum(of, 1)[:, None] + (1 - trust)[:, None] * prior[None, :])


def scores(texts: DataFrame, step: np.ndarray, place: float, total: int) -> DataFrame:
    """The result; place: log10 of the base model's denominator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            score = []
            for raw, emit in zip(b.column("classes").to_pylist(), b.column("emit").to_pylist()):
                x = np.concatenate([np.zeros(1, np.int64), unpacked(raw, "u1")])
                score.append(emit + float(step[x[:-1], x[1:]].sum()))
            n, base = b.column("n").to_numpy(), b.column("base").to_numpy()
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held"), "n_tokens": n, "n_known": b.column("known"), "train_tokens": [total] * len(score), "base_score": base - n * place, "score": score}

    return map_batches(texts, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", run)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counts = materialize(word_counts(docs), "counts")
    ends = docs.where(~held_out()).count()
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(whole.n + ends), whole.v + (ends > 0)
    top = sorted(((r.word, r.c) for r in most_frequent(counts, "c", HEAD).collect()), key=lambda x: (-x[1], x[0].encode()))
    words, lowest = [w for w, _ in top[:UNITS]], top[len(top[:UNITS]) - 1] if top else None
    rest = counts
    if lowest:
        rest = counts.where((F.col("c") < lowest[1]) | (F.col("c") == lowest[1]) & (F.col("word") > lowest[0]))
    by_suffix = rest.groupBy(F.substring("word", -SUFFIX, SUFFIX).alias("s")).agg(F.sum("c").alias("n"))
    suffixes = sorted(most_frequent(by_suffix, "n", SUFFIXES).collect(), key=lambda r: (-r.n, r.s.encode()))
    units = Units(words, [r.s for r in suffixes])
    common = rest.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    unit_count = np.array([ends, *(c for _, c in top[:UNITS]), *(r.n for r in suffixes), common - sum(r.n for r in suffixes)], float)
    head = [w.encode("utf-8", "surrogatepass") for w, _ in top]
    head_counts = np.array([c for _, c in top], np.int64)
    encoded = materialize(encoded_texts(docs, units, head), "encoded")
    classes, pair = clusters(encoded.where("not held").select("units"), units, unit_count)
    neighbours = materialize(word_neighbours(encoded, units, head, classes), "neighbours")
    rare = materialize(word_classes(neighbours, units, classes, pair), "classes")
    drop(neighbours)
    own = classes[1 : len(words) + 1]
    # as many as the head has words
    found = {r.word: r for r in rare.where(F.col("c") >= int(head_counts[-1])).collect()} if top else {}
    for column in ("class", "start"):
        of = np.concatenate([own, [found[w][column] for w, _ in top[UNITS:]]])
        inside = np.bincount(own, head_counts[:UNITS] + 1, len(pair)) + 1
        inside[0] += ends + 1
        for r in rare.groupBy(column).agg(F.sum(F.col("c") + 1).alias("n")).collect():
            inside[r[column]] += r.n
        texts = materialize(weighed(encoded, rare, Model(units, classes, head, head_counts, of, inside, ends), column), "weighed")
        after = pairs_of(texts, len(pair))
        if likelihood(after) >= likelihood(pair):
            break
    drop(encoded, rare, counts)
    return scores(texts, steps(after), math.log10(total + distinct + 1), total)
