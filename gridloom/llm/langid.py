"""Language ID by unigram models over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. The likelihood of a word is the sum over all ways to
cut it into pieces of the product of their probabilities (a forward pass over its characters), that of a text the product
over its words. Probabilities come from EM on the training texts: a forward-backward pass gives the expected number of
times that each piece is used, again over all segmentations. A character outside the vocabulary is a piece of its own
with the same small probability in every language. Words are runs of letters, lower-cased, of any length; a worker scores
a word once. Languages are independent of one another, so any number of them goes in passes over some of them each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Index, code_points, once, tidy, whole

#: A run of letters, with the marks that combine with them and the joiners between them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")
START = "▁"
UNKNOWN = 1e-7
#: Up to so many letters the products of a word's probabilities are plain numbers (UNKNOWN to this power is above zero), beyond it logarithms.
PLAIN = 32
#: The background's urn: the weight of letters not seen yet, how many a script has, and the same for ideographs and syllables.
URN = 32.0
ALPHABET = 128
IDEOGRAPHS = 0x2E80
IDEOGRAPH_LETTERS = 30_000
ROUNDS = 1
#: Bytes of text that a worker looks at together, letters of distinct words whose segmentations it holds at once, and
#: languages whose sums it holds at once. They bound its memory (some 60 MB) and change no result.
CHUNK_CHARS = 1_000_000
BLOCK_CHARS = 150_000
LANGUAGES = 16
#: Numbers that a worker remembers of words that it has scored; beyond it the memory is emptied.
REMEMBERED = 400_000
#: Languages whose probabilities are broadcast together; more go in as many passes as they need.
BROADCAST_LANGUAGES = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The pieces of a SentencePiece file that are text, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@dataclass
class Lattice:
    """Where pieces lie in a list of words: for each length of a piece, its number at each position (-1: none)."""

    order: np.ndarray  # of the words, by their length
    lengths: np.ndarray  # of the words in that order, with the mark of their start
    starts: np.ndarray
    pieces: list[np.ndarray]


class Pieces:
    """The vocabulary as a tree of prefixes, walked from all positions at once."""

    def __init__(self, pieces: list[str]):
        nodes: dict[str, int] = {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.longest = max(map(len, pieces), default=0)
        self.index = Index(np.array([self._hash(p) for p in nodes], np.uint64))
        self.piece = np.full(len(nodes), -1, np.int32)
        for i, p in enumerate(pieces):
            self.piece[nodes[p]] = i

    @staticmethod
    def _hash(prefix: str) -> int:
        h = 7
        for c in prefix:
            h = (h * 0x100000001B3 + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h ^ (h >> 29)

    def lattice(self, words: list[str]) -> Lattice:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        points = code_points("".join([START + words[i] for i in order.tolist()]))
        starts = np.cumsum(lengths) - lengths
        ends = np.repeat(starts + lengths, lengths)
        alive, h, found = np.arange(len(points)), np.full(len(points), np.uint64(7)), []
        for size in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            h = h * np.uint64(0x100000001B3) + points[alive + size - 1]
            node = self.index.find(h ^ (h >> np.uint64(29)))
            at = np.full(len(points), -1, np.int32)
            there = np.flatnonzero(node >= 0)
            alive, h = alive[there], h[there]
            at[alive] = self.piece[node[there]]
            found.append(at)
            more = alive + size < ends[alive]
            alive, h = alive[more], h[more]
        return Lattice(order, lengths, starts, found)


def _spans(lattice: Lattice) -> Iterator[tuple[slice, bool]]:
    """The words of a lattice that are short, then the long ones, whose probabilities may be too small for plain products."""
    middle = int(np.searchsorted(lattice.lengths, PLAIN, "right"))
    for span, logs in ((slice(0, middle), False), (slice(middle, len(lattice.lengths)), True)):
        if span.stop > span.start:
            yield span, logs


def _arcs(lattice: Lattice, span: slice, unknown: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes from, nodes to, pieces) along the words, all words at once; a word's nodes are its characters' starts, then its end.

    Node n of word w is number ``starts[w] + w + n``, counted from the span's first word.
    """
    lengths = lattice.lengths[span]
    first = lattice.starts[span] - lattice.starts[span.start] + np.arange(len(lengths))
    for k in range(1, int(lengths[-1]) + 1):
        on = int(np.searchsorted(lengths, k))  # words are sorted by length: those from here on reach so far
        texts, nodes = lattice.starts[span][on:], first[on:] + k
        for size in range(1, min(k, len(lattice.pieces)) + 1):
            ids = lattice.pieces[size - 1][texts + (k - size)]
            if size == 1:
                yield nodes - 1, nodes, np.where(ids < 0, unknown, ids)
            elif len(rows := np.flatnonzero(ids >= 0)):
                yield nodes[rows] - size, nodes[rows], ids[rows]


def _alpha(lattice: Lattice, span: slice, table: np.ndarray, logs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed probabilities (or their logarithms) of all ways to each node, and the words' last nodes."""
    lengths = lattice.lengths[span]
    first = lattice.starts[span] - lattice.starts[span.start] + np.arange(len(lengths))
    alpha = np.full((int(lengths.sum()) + len(lengths), table.shape[1]), -np.inf if logs else 0.0)
    alpha[first] = 0.0 if logs else 1.0
    for a, b, ids in _arcs(lattice, span, len(table) - 1):
        if logs:
            alpha[b] = np.logaddexp(alpha[b], alpha[a] + table[ids])
        else:
            alpha[b] += alpha[a] * table[ids]
    return alpha, first + lengths


def _columns(table: np.ndarray) -> Iterator[slice]:
    for at in range(0, table.shape[1], LANGUAGES):
        yield slice(at, min(at + LANGUAGES, table.shape[1]))


def forward(lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language, over all segmentations of the whole word."""
    out = np.zeros((len(lattice.order), table.shape[1]))
    for cols in _columns(table):
        for span, logs in _spans(lattice):
            alpha, last = _alpha(lattice, span, np.log(table[:, cols]) if logs else table[:, cols], logs)
            out[lattice.order[span], cols] = alpha[last] if logs else np.log(alpha[last])
    return out


def _blocks(words: list[str]) -> Iterator[slice]:
    """Words together, by their letters; a word is never cut."""
    start = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > BLOCK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(w) + 1
    if start < len(words):
        yield slice(start, len(words))


def likelihoods(known: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """``forward`` by blocks of words."""
    return np.concatenate([forward(known.lattice(words[block]), table) for block in _blocks(words)])


def expected(lattice: Lattice, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, when word w occurs counts[w, l] times in language l."""
    out = np.zeros(table.shape)
    for cols in _columns(table):
        for span, logs in _spans(lattice):
            own = np.log(table[:, cols]) if logs else table[:, cols]
            alpha, last = _alpha(lattice, span, own, logs)
            times = counts[lattice.order[span], cols]
            arcs = list(_arcs(lattice, span, len(table) - 1))
            beta = np.full_like(alpha, -np.inf if logs else 0.0)
            with np.errstate(divide="ignore"):
                beta[last] = np.log(times) - alpha[last] if logs else times / alpha[last]
            used = []
            for a, b, ids in reversed(arcs):
                passed = beta[b] + own[ids] if logs else beta[b] * own[ids]
                beta[a] = np.logaddexp(beta[a], passed) if logs else beta[a] + passed
                used.append(np.exp(alpha[a] + passed) if logs else alpha[a] * passed)
            ids, used = np.concatenate([ids for _, _, ids in reversed(arcs)]), np.concatenate(used)
            for lang in range(used.shape[1]):
                out[:, cols.start + lang] += np.bincount(ids, used[:, lang], len(table))
    return out


def _chunks(texts: pa.Array) -> Iterator[slice]:
    """Texts of a column together, by their letters; a text is never cut."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > CHUNK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def first_table(pieces: list[str], languages: int) -> np.ndarray:
    """The same for all languages: by the order of the vocabulary, in which frequent pieces come first."""
    p = 1 / (np.arange(len(pieces)) + 3.0)
    return _with_unknown(np.repeat((p / p.sum())[:, None], languages, axis=1))


def _with_unknown(p: np.ndarray) -> np.ndarray:
    return np.vstack((p * (1 - UNKNOWN), np.full((1, p.shape[1]), UNKNOWN)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """(pieces, languages, table of probabilities) from the rows of ``docs`` that have a language.

    Each round is one distributed pass for each ``BROADCAST_LANGUAGES`` languages; a task sends a number for each piece
    and language at most. Piece counts are smoothed by a tenth of a use. Without any language the list of languages is
    empty. Null texts teach nothing.
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary or default_vocabulary())
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), whole(text).alias("text")).where("lang is not null")
    # One row a language: the list of languages is what the model is about.
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    table = first_table(pieces, max(1, len(languages)))
    for _ in range(rounds if languages else 0):
        uses = np.zeros(table.shape)
        for at in range(0, len(languages), BROADCAST_LANGUAGES):
            names = languages[at : at + BROADCAST_LANGUAGES]
            own = labelled if len(names) == len(languages) else labelled.where(F.col("lang").isin(names))
            _count_uses(spark, own, pieces, names, table[:, at : at + len(names)], uses[:, at : at + len(names)])
        uses = uses[:-1] + 0.1
        table = _with_unknown(uses / uses.sum(axis=0))
    return pieces, languages, table


def _count_uses(spark, labelled: DataFrame, pieces: list[str], languages: list[str], table: np.ndarray, out: np.ndarray) -> None:
    """Add the expected uses of each piece in each of the languages to ``out``."""
    number = {name: i for i, name in enumerate(languages)}
    shared = spark.sparkContext.broadcast((pieces, np.ascontiguousarray(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = shared.value
        known, total = once(shared, lambda made: Pieces(made[0])), np.zeros(table.shape)
        for batch in batches:
            for part in _chunks(batch.column(1)):
                langs, texts = (c.slice(part.start, part.stop - part.start).to_pylist() for c in batch.columns)
                seen: dict[str, Counter] = {}
                for name, t in zip(langs, texts):
                    seen.setdefault(name, Counter()).update(words_of(t))
                # A language's sums need its own words only.
                for name, counter in seen.items():
                    words, column = list(counter), slice(number[name], number[name] + 1)
                    times = np.fromiter(counter.values(), float, len(counter))[:, None]
                    for block in _blocks(words):
                        total[:, column] += expected(known.lattice(words[block]), table[:, column], times[block])
        tidy()
        piece, which = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(which, pa.int32()), pa.array(total[piece, which])], names=["piece", "lang", "uses"])

    # At most a row for each piece and language.
    summed = labelled.mapInArrow(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
    piece, which, uses = (summed.column(i).to_numpy() for i in range(3))
    out[piece, which] += uses
    shared.destroy()


def background(text: str) -> float:
    """Log likelihood of the words of a text in no language: letters (and starts of words) drawn one by one from an urn.

    A letter comes as often as it has come before in the text, or anew from the letters of its kind of script, so the
    model needs no training and knows every script. It knows no order of letters: that is what a language must explain
    better. The order of the letters does not matter, so that their counts are enough.
    """
    n = np.bincount(code_points(text).astype(np.int64))
    letters = np.flatnonzero(n)
    n = n[letters]
    fresh = URN / np.where(letters < IDEOGRAPHS, ALPHABET, IDEOGRAPH_LETTERS)
    return float((_log_gamma(n + fresh) - _log_gamma(fresh)).sum() - _log_gamma(np.array([n.sum() + URN]))[0] + _log_gamma(np.array([URN]))[0])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving up by eight: to some 1e-9."""
    x = x.astype(float)
    up = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up


class Memory:
    """Log likelihoods of the words that a worker has met, as rows of one table."""

    def __init__(self, known: Pieces, table: np.ndarray):
        self.known, self.table, self.rows = known, table, {}
        self.scores = np.zeros((0, table.shape[1]))

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The rows of each text's words, after the new words were scored."""
        rows = self.rows
        if len(self.scores) * self.table.shape[1] > REMEMBERED:
            rows.clear()
            self.scores = self.scores[:0]
        new = list(dict.fromkeys(w for words in texts for w in words if w not in rows))
        if new:
            rows.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate((self.scores, likelihoods(self.known, self.table, new)))
        return [np.fromiter(map(rows.__getitem__, words), np.int32, len(words)) for words in texts]

    def total(self, numbers: np.ndarray) -> np.ndarray:
        return sum((self.scores[numbers[at : at + 10_000]].sum(axis=0) for at in range(0, len(numbers), 10_000)), np.zeros(self.table.shape[1]))


#: What a pass over some of the languages leaves for the next: the likeliest so far, its log likelihood, and the sum of all of them over it.
SO_FAR = (("_lang", pa.string()), ("_best", pa.float64()), ("_all", pa.float64()))


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], text: str = "text", out: str = "lang_pred", score: str = "score", unknown: bool = False) -> DataFrame:
    """``docs`` with ``out``, the likeliest language, and ``score``, its posterior among the languages (0 to 1).

    With ``unknown``, the posterior is among the languages and ``background``, so that it falls to 0 for texts in none.

    Texts that are null or without letters, and all texts if no language was learned, get ``und`` and 0. Equal
    likelihoods go to the first language by name. Columns of those names are replaced; everything else stays as it is.
    """
    pieces, languages, table = model
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (out, score)]
    found = docs.select(*kept, *[F.lit(None).cast(t).alias(n) for n, t in zip(("_lang", "_best", "_all"), ("string", "double", "double"))], F.col(text).cast("string").alias("_text"))
    for at in range(0, len(languages), BROADCAST_LANGUAGES):
        names = languages[at : at + BROADCAST_LANGUAGES]
        found = _scored(found, pieces, names, np.ascontiguousarray(table[:, at : at + len(names)]), unknown and at == 0)
    # ``_all`` holds the sum over the likeliest one's likelihood.
    return found.select(*kept, F.coalesce("_lang", F.lit("und")).alias(out), F.coalesce(1.0 / F.col("_all"), F.lit(0.0)).alias(score))


def _scored(found: DataFrame, pieces: list[str], languages: list[str], table: np.ndarray, unknown: bool) -> DataFrame:
    """One pass over ``found``, whose last columns are SO_FAR and the text, by the given languages (and the background)."""
    shared = found.sparkSession.sparkContext.broadcast((pieces, languages, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, languages, table = shared.value
        memory = Memory(once(shared, lambda made: Pieces(made[0])), table)
        for batch in batches:
            last = batch.num_columns - 1
            for part in _chunks(batch.column(last)):
                columns = [c.slice(part.start, part.stop - part.start) for c in batch.columns]
                texts = [words_of(t) for t in columns[last].to_pylist()]
                before = zip(*(c.to_pylist() for c in columns[last - len(SO_FAR) : last]))
                rows = []
                for words, numbers, (lang, best, every) in zip(texts, memory.numbers(texts), before):
                    if not words:
                        rows.append((None, None, None))
                        continue
                    total = memory.total(numbers)
                    top = int(total.argmax())
                    rivals = total
                    if unknown:
                        rivals = np.append(rivals, background(START + START.join(words)))
                    if lang is None or total[top] > best:
                        carried = 0.0 if lang is None else every * float(np.exp(best - total[top]))
                        lang, best = languages[top], float(total[top])
                    else:
                        carried = every
                    rows.append((lang, best, carried + float(np.exp(np.minimum(rivals - best, 700.0)).sum())))
                made = [pa.array(v, t) for v, (_, t) in zip(zip(*rows), SO_FAR)]
                yield pa.RecordBatch.from_arrays([*columns[: last - len(SO_FAR)], *made, columns[last]], names=batch.schema.names)
        del memory
        tidy()

    return found.mapInArrow(run, found.schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that nothing is learned from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, vocabulary: str | None = None, unknown: bool = False) -> DataFrame:
    """Learn from the documents that are not held out and predict all: the columns of ``docs``, lang_pred and score."""
    return predict(docs, train(docs.where(~held_out()), vocabulary=vocabulary), unknown=unknown)


def keep_identified(docs: DataFrame, least: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """The documents whose language is recognised with a score of ``least`` or more, with it as ``lang``; the rest goes.

    The score is among the learned languages and none of them, so texts in other languages and random letters go.
    """
    found = identify(docs, vocabulary, unknown=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)
