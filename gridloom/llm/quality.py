"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Trusted documents are dealt by their text to folds, and for each fold there is a model of all other folds. Every document
is scored by the model that has not seen its text, trusted or not, so that perplexities of trusted documents are like those
of others, and a language's threshold, a quantile of its trusted documents' perplexities, means what it says.

N-grams are counted in Arrow batches and summed by Spark. Everything that Kneser-Ney needs of them (continuation counts,
counts of counts, discounts, sums by context) and the interpolation with the lower order are aggregates and joins of
tables sharded by model and n-gram; the models never leave the cluster.

Scoring is count joins too. Documents are taken in chunks; a chunk sends each of its different n-grams once, however
often and in however many documents it occurs, to the shards of the models, which send the log probabilities back, and
keeps how often each document has each. An n-gram that the model has not is looked up by its suffix and the back-off
weight of its context, level by level, each different one once. The most frequent n-grams of the models (CACHED at most)
are known to every worker, which saves most of the joins' rows and changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Index, code_points, cut, once, small, tidy, whole, written

ORDER = 5
#: Share of the trusted documents of a language whose perplexity is at or below the threshold.
QUANTILE = 0.995
#: Parts of the trusted documents; a model is trained on all but one of them.
FOLDS = 2
#: N-grams that every worker knows: some 15 MB there.
CACHED = 200_000
#: Perplexities are put in bins of so many to a unit of their logarithm for the quantiles.
BINS = 1000
PAD = "\x02"
#: Code points of text that are counted or scored at once, and that are a chunk.
BLOCK_CHARS = 500_000
CHUNK_CHARS = 16_000_000
#: Rows of a table that a task takes at least, so that small tables make few files whatever the number of shuffle partitions.
TASK_ROWS = 50_000
#: Log probability of characters where a model has nothing at all.
NOTHING = -20.0
SLOTS = 0x110000


def fold_of(text: Column, folds: int = FOLDS) -> Column:
    """Copies of a text are in one fold: none is scored by a model that has seen it."""
    return F.pmod(F.xxhash64(text), F.lit(folds)).cast("int")


def windows(points: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of ``length`` points, the same for the same window and no other."""
    found = np.zeros(SLOTS, np.int64)
    alphabet = np.unique(points)
    found[alphabet] = np.arange(len(alphabet))
    codes, bits = found[points], max(1, int(len(alphabet) - 1).bit_length())
    n = max(0, len(points) - length + 1)
    key, used = np.zeros(n, np.int64), 0
    for j in range(length):
        if used + bits > 62:  # a large alphabet: number the windows so far densely
            key = np.unique(key, return_inverse=True)[1]
            used = max(1, int(key.max(initial=0)).bit_length())
        key, used = (key << bits) | codes[j : j + n], used + bits
    return key


def grams_at(points: np.ndarray, at: np.ndarray, length: int) -> list[str]:
    picked = np.lib.stride_tricks.sliding_window_view(points.astype(np.uint32), length)[at] if len(at) else np.zeros((0, length), np.uint32)
    text = np.ascontiguousarray(picked).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + length] for i in range(0, len(text), length)]


def parts_of(text: str, order: int, chars: int) -> Iterator[str]:
    """A text with marks of its start, in parts of so many characters that overlap by what a window needs."""
    padded = PAD * (order - 1) + text
    for at in range(0, len(text), chars):
        yield padded[at : at + chars + order - 1]


def _together(pieces: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    """Tuples that end in a text, as many at a time as have so many characters (64 each for what is not text)."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[-1]) + 64
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(parts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts one after the other, the starts of their windows, and to which text each of those belongs."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    points = code_points("".join(parts))
    which = np.repeat(np.arange(len(parts)), np.maximum(lengths - order + 1, 0))
    ends = np.cumsum(np.maximum(lengths - order + 1, 0))
    inside = np.arange(len(which)) - np.repeat(ends - np.maximum(lengths - order + 1, 0), np.maximum(lengths - order + 1, 0))
    return points, (np.cumsum(lengths) - lengths)[which] + inside, which


def ngram_counts(texts: DataFrame, order: int = ORDER, folds: int = FOLDS, block: int = BLOCK_CHARS) -> DataFrame:
    """(gram, n): all n-grams of the column ``text``, with an array of their counts by ``fold``; each text has order - 1 marks of its start before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f.as_py(), p) for batch in batches for t, f in zip(batch.column(0), batch.column(1)) for p in parts_of(t.as_py(), order, block))
        for held in _together(pieces, block):
            points, at, which = _joined([p for _, p in held], order)
            _, first, each = np.unique(windows(points, order)[at], return_index=True, return_inverse=True)
            fold = np.array([f for f, _ in held], np.int64)[which]
            counts = [np.bincount(each[fold == f], minlength=len(first)) for f in range(folds)]
            yield pa.RecordBatch.from_arrays([pa.array(grams_at(points, at[first], order), pa.string()), *(pa.array(n, pa.int64()) for n in counts)], names=["gram", *names])
        tidy()

    names = [f"n{f}" for f in range(folds)]
    summed = texts.select("text", "fold").mapInArrow(run, ", ".join(["gram string", *(f"{n} long" for n in names)])).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])
    return summed.select("gram", F.array(*names).alias("n"))


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """For each model the three discounts of modified Kneser-Ney from its counts of counts 1 to 4; bounds keep them usable on tiny input."""
    out = {}
    # One row a model, of which there are as many as folds.
    for row in counts.groupBy("model").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():
        n1, n2, n3, n4 = (row[f"n{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        out[row["model"]] = tuple(float(min(max(d, 0.05), i + 0.95)) for i, d in enumerate(found))
    return out


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most so many rows, written by no more tasks than they are worth."""
    return cut(df.coalesce(max(1, -(-rows // TASK_ROWS))))


class Models:
    """Tables of all models by length of n-gram.

    ``logp[k]`` has (model, gram, logp), ``backoff[k]`` (model, context, weight): the log weight that the order k gives to
    what is below it after a context of k - 1 characters. ``unseen`` is the log probability of characters never seen.
    """

    def __init__(self, counts: DataFrame, order: int = ORDER, folds: int = FOLDS):
        self.order, self.folds = order, folds
        others = [F.struct(F.lit(m).alias("model"), sum((F.get("n", F.lit(f)) for f in range(folds) if f != m), F.lit(0)).alias("n")) for m in range(folds)]
        self.top = packed(counts.select("gram", F.explode(F.array(*others)).alias("m")).where("m.n > 0").select("m.model", "gram", "m.n"), folds * counts.count())
        levels, rows = {order: self.top}, {order: self.top.count()}
        for k in range(order - 1, 0, -1):
            # In how many contexts a shorter gram was seen.
            levels[k] = packed(levels[k + 1].groupBy("model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), rows[k + 1])
            rows[k] = levels[k].count()
        self.logp, self.backoff, self.unseen, below = {}, {}, {}, None
        for k in range(1, order + 1):
            off = F.lit(0.5)
            for model, (d1, d2, d3) in discounts(levels[k]).items():
                off = F.when(F.col("model") == model, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(off)
            level = levels[k].select("model", "gram", "n", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), off.alias("off"))
            contexts = level.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"), F.count("*").alias("types"))
            own = (F.col("n") - F.col("off")) / F.col("total")
            if k == 1:
                # One share more for all characters that were never seen. A row for each model.
                contexts = contexts.withColumn("share", F.col("weight") / (F.col("types") + 1))
                self.unseen = {r["model"]: float(np.log(r["share"])) for r in contexts.select("model", "share").collect()}
                p = level.join(F.broadcast(contexts.select("model", "total", "share")), "model").select("model", "gram", (own + F.col("share")).alias("p"))
            else:
                contexts = packed(contexts, rows[k])
                self.backoff[k] = contexts.select("model", "context", F.log("weight").alias("weight"))
                under = below.select("model", F.col("gram").alias("suffix"), F.col("p").alias("q"))
                p = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(contexts, ["model", "context"]).join(under, ["model", "suffix"])
                p = p.select("model", "gram", (own + F.col("weight") * F.col("q")).alias("p"))
            below = packed(p, rows[k])
            self.logp[k] = below.select("model", "gram", F.log("p").alias("logp"))

    def resolve(self, queries: DataFrame, rows: int, k: int | None = None) -> DataFrame:
        """(model, gram, logp) of different n-grams (model, gram) of length k, at most so many rows, whether the models have them or not.

        N-grams with the same suffix, and those with the same context, differ in one character, so that no key of these
        joins has more rows than there are characters.
        """
        k = self.order if k is None else k
        found = queries.join(self.logp[k], ["model", "gram"], "left")
        if k == 1:
            unseen = F.lit(NOTHING)
            for model, share in self.unseen.items():
                unseen = F.when(F.col("model") == model, share).otherwise(unseen)
            return found.select("model", "gram", F.coalesce("logp", unseen).alias("logp"))
        found = packed(found, rows)
        missing = found.where("logp is null").select("model", "gram", F.expr("substring(gram, 2)").alias("suffix"), F.expr(f"substring(gram, 1, {k - 1})").alias("context"))
        below = self.resolve(missing.select("model", F.col("suffix").alias("gram")).distinct(), missing.count(), k - 1)
        by_suffix = missing.join(below.select("model", F.col("gram").alias("suffix"), F.col("logp").alias("under")), ["model", "suffix"])
        backed = by_suffix.join(self.backoff[k], ["model", "context"], "left").select("model", "gram", (F.col("under") + F.coalesce("weight", F.lit(0.0))).alias("logp"))
        return found.where("logp is not null").select("model", "gram", "logp").unionAll(backed)

    def cache(self, most: int) -> tuple[str, np.ndarray]:
        """The most frequent n-grams that all models have, at most ``most`` of them, one after the other, and a row of the models' log probabilities for each."""
        nothing = "", np.zeros((0, self.folds))
        if most <= 0:
            return nothing
        rank = F.floor(F.log2("n") * 8)
        both = self.top.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("models")).where(F.col("models") == self.folds)
        # Some hundred ranks at most; those from the highest down that have room.
        sizes = sorted(both.groupBy(rank.alias("rank")).agg(F.count("*").alias("size")).collect(), key=lambda r: -r["rank"])
        least, taken = None, 0
        for r in sizes:
            taken += r["size"]
            if taken > most:
                break
            least = r["rank"]
        if least is None:
            return nothing
        by_model = [F.max(F.when(F.col("model") == m, F.col("logp"))).alias(f"m{m}") for m in range(self.folds)]
        # ``most`` rows at most come to the driver.
        rows = self.logp[self.order].join(both.where(rank >= int(least)).select("gram"), "gram").groupBy("gram").agg(*by_model).toArrow()
        return "".join(rows.column(0).to_pylist()), np.column_stack([rows.column(m + 1).to_numpy() for m in range(self.folds)])


class Known:
    """The cached n-grams in a worker: exact keys of 12 bits a character, for the 4,095 characters that are commonest in them."""

    BITS = 12

    def __init__(self, grams: str, logp: np.ndarray, order: int):
        self.order = order
        common = [c for c, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], x[0]))[: (1 << self.BITS) - 1]]
        self.codes = np.zeros(SLOTS, np.uint64)
        for i, c in enumerate(common):
            self.codes[ord(c)] = i + 1
        points = code_points(grams)
        whole_keys = (self.codes[points].reshape(-1, order) > 0).all(axis=1) & (order * self.BITS <= 64)
        self.index = Index(self.keys(points)[::order][whole_keys])
        self.logp = logp[whole_keys]

    def keys(self, points: np.ndarray) -> np.ndarray:
        codes = self.codes[points]
        n = max(0, len(points) - self.order + 1)
        key = np.zeros(n, np.uint64)
        for j in range(self.order):
            key = (key << np.uint64(self.BITS)) | codes[j : j + n]
        return key

    def find(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row of ``logp`` of each window, -1 for those that are not cached (an uncached character has code 0, which no key has)."""
        return self.index.find(self.keys(points)[at])


class Chunk:
    """A chunk as blocks of texts are added: its documents and their known sums, and how often each has which other n-gram."""

    def __init__(self):
        self.rows: dict[int, int] = {}  # numbers of the documents' rows, by place
        self.own: list[list] = []
        self.lp: list[float] = []
        self.grams: dict[str, int] = {}
        self.uses: list[np.ndarray] = []
        self.size = 0

    def add(self, known: Known, held: list[tuple], order: int) -> None:
        """Pieces (number of the row, its other columns, model, text)."""
        place = np.empty(len(held), np.int64)
        for i, (n, own, _, text) in enumerate(held):
            if n not in self.rows:
                self.rows[n] = len(self.rows)
                self.own.append(own)
                self.lp.append(0.0)
            place[i] = self.rows[n]
            self.size += len(text) + 64
        points, at, which = _joined([p[-1] for p in held], order)
        if not len(at):
            return
        model = np.array([p[2] for p in held], np.int64)
        rows = known.find(points, at)
        there, others = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        for i, x in enumerate(np.bincount(which[there], known.logp[rows[there], model[which[there]]], len(held)).tolist()):
            self.lp[place[i]] += x
        # The different ones of each model, then how often each document has them.
        each = np.unique(windows(points, order)[at[others]], return_inverse=True)[1] * (model.max() + 1) + model[which[others]]
        _, first, each = np.unique(each, return_index=True, return_inverse=True)
        names = [chr(m) + g for m, g in zip(model[which[others[first]]].tolist(), grams_at(points, at[others[first]], order))]
        number = np.array([self.grams.setdefault(g, len(self.grams)) for g in names], np.int64)
        pairs, times = np.unique(place[which[others]] * max(1, len(names)) + each, return_counts=True)
        if len(pairs):
            self.uses.append(np.stack((pairs // len(names), number[pairs % len(names)], times)))

    def batch(self, number: int, row: pa.DataType) -> pa.RecordBatch:
        columns = [list(self.rows), *zip(*self.own), self.lp]
        made = pa.StructArray.from_arrays([pa.array(v, row.field(i).type) for i, v in enumerate(columns)], fields=[row.field(i) for i in range(row.num_fields)])
        uses = b""
        if self.uses:
            doc, gram, times = np.concatenate(self.uses, axis=1)
            pairs = doc * len(self.grams) + gram
            order = np.argsort(pairs)
            uses = pack(pairs[order], times[order])
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed(made), listed(pa.array(list(self.grams), pa.string())), pa.array([uses], pa.binary())], names=["chunk", "rows", "grams", "uses"])


def chunks(docs: DataFrame, cached: tuple[str, np.ndarray], order: int, chars: int = CHUNK_CHARS) -> DataFrame:
    """Documents (with columns ``model`` and ``_text`` at the end) as chunks.

    A chunk is a row: its number, its documents (``rows``: a number for each row of ``docs``, its other columns, and the sum
    of the log probabilities that were known), its different other n-grams ``grams`` (the model's number as a character
    before each), and ``uses``: which document has which of them how often, packed. A long text may be in several chunks.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast((*cached, order))
    kept = docs.drop("model", "_text").schema.fields
    row = StructType([StructField("row", LongType()), *kept, StructField("lp", DoubleType())])
    schema = StructType([StructField("chunk", LongType()), StructField("rows", ArrayType(row)), StructField("grams", ArrayType(StringType())), StructField("uses", BinaryType())])
    arrow = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in row.fields])
    block = min(chars, BLOCK_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once(shared, lambda made: Known(*made))
        base = TaskContext.get().partitionId() << 36

        def pieces():
            n = base
            for batch in batches:
                for i in range(batch.num_rows):
                    *own, model, text = (c[i].as_py() for c in batch.columns)
                    for part in parts_of(text, order, block) if text else ("",):
                        yield n, own, model, part
                    n += 1

        number, chunk = base, Chunk()
        for held in _together(pieces(), block):
            chunk.add(known, held, order)
            if chunk.size >= chars:
                yield chunk.batch(number, arrow)
                number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield chunk.batch(number, arrow)
        del chunk
        tidy()

    return docs.mapInArrow(run, schema)


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and their counts: differences and counts as 32-bit numbers, compressed."""
    gaps = np.diff(pairs, prepend=0)
    wide = np.concatenate(([len(pairs)], gaps, times)).astype("<i8")
    return len(wide).to_bytes(8, "little") + pa.compress(wide.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(pa.decompress(data[8:], decompressed_size=size * 8, codec="zstd", asbytes=True), np.uint8)
    wide = np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").reshape(-1)
    return np.cumsum(wide[1 : 1 + wide[0]]), wide[1 + wide[0] :]


def score(docs: DataFrame, models: Models, cached: int = CACHED, chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` (with columns ``model`` and ``_text`` at the end, not given back) with ``lp``, the sum of log probabilities."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    kept = docs.drop("model", "_text")
    made = written(chunks(docs, models.cache(cached), models.order, chars), "quality")
    asked = made.select("chunk", F.posexplode("grams").alias("at", "g"))
    asked = asked.select("chunk", "at", F.ascii("g").alias("model"), F.expr("substring(g, 2)").alias("gram"))
    asking = cut(asked.select("model", "gram").distinct())
    rows = asking.count()
    answers = models.resolve(asking.coalesce(max(1, -(-rows // TASK_ROWS))), rows)
    # A chunk has no more of them than characters.
    answered = asked.join(answers, ["model", "gram"]).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "logp"))).alias("answers"))
    answered = answered.select("chunk", F.transform("answers", lambda x: x["logp"]).alias("answers"))
    schema = StructType([StructField("row", LongType()), *kept.schema.fields, StructField("lp", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, uses, logp = (batch.column(c)[i] for c in range(3))
                table = pa.RecordBatch.from_struct_array(rows.values)
                lp = table.column(table.num_columns - 1).to_numpy(zero_copy_only=False)
                pairs, times = unpack(uses.as_py())
                if len(pairs):
                    logp = logp.values.to_numpy(zero_copy_only=False)
                    lp = lp + np.bincount(pairs // len(logp), times * logp[pairs % len(logp)], len(lp))
                yield pa.RecordBatch.from_arrays([*table.columns[:-1], pa.array(lp, pa.float64())], names=schema.names)

    parts = made.select("chunk", "rows", "uses").join(answered, "chunk", "left").select("rows", "uses", "answers").mapInArrow(run, schema)
    # A document's parts have its number; most documents are one part.
    one = parts.groupBy("row").agg(*[F.first(f"`{c}`").alias(c) for c in kept.columns], F.sum("lp").alias("lp"))
    return one.drop("row")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold) from the rows of ``scored``, for every language that has any; lang null has the one over all.

    The threshold is the perplexity of rank ceil((n + 1) * quantile) of n, or the highest. Quantiles come from counts by
    bins of the logarithm: exact to a thousandth, the same in whatever order rows come.
    """
    bins = scored.where("perplexity is not null").groupBy("lang", F.floor(F.log("perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.where("lang is not null").unionAll(bins.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n").alias("n")))
    # A language has some thousand bins at most.
    whole_lang = Window.partitionBy("lang")
    upto = whole_lang.orderBy("bin")
    bins = bins.select("lang", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole_lang).alias("all"))
    rank = F.least(F.col("all"), F.ceil((F.col("all") + 1) * quantile))
    return bins.where(F.col("upto") >= rank).groupBy("lang").agg(F.min("bin").alias("bin")).select("lang", F.exp((F.col("bin") + 1) / BINS).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER, folds: int = FOLDS, cached: int = CACHED, chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, trusted, perplexity, threshold, kept.

    ``trusted`` has the doc_id of the documents to train on; ids that are null or not in ``docs`` are ignored. Null and
    empty texts have no perplexity and are not kept. A language without trusted documents, and a null one, have the
    threshold over all; others have their own, however few trusted documents they have. Without trusted texts in two folds
    perplexities and thresholds are null and every text is kept. Ids are whole numbers, others raise an error. Repeated
    rows stay; other columns are left alone.
    """
    ids = small(trusted.select(F.col(doc_id).cast("long").alias("_trusted")).where("_trusted is not null").distinct(), 1_000_000)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), whole(text).alias("_text"))
    base = base.join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    base = base.select("doc_id", "lang", F.col("_trusted").isNotNull().alias("trusted"), F.length("_text").alias("size"), fold_of(F.col("_text"), folds).alias("model"), "_text")
    # Small files are read together: a chunk's n-grams are the fewer, the larger it is.
    chunks_wanted = (base.agg(F.sum("size")).first()[0] or 0) // chars + 1
    base = base.coalesce(max(int(chunks_wanted), docs.sparkSession.sparkContext.defaultParallelism))
    learned = base.where("trusted and size > 0").select(F.col("_text").alias("text"), F.col("model").alias("fold"))
    models = Models(cut(ngram_counts(learned, order, folds)), order, folds)
    if len(models.unseen) < folds:  # some model has nothing to learn from
        bare = F.lit(None).cast("double")
        return base.select("doc_id", "lang", "trusted", bare.alias("perplexity"), bare.alias("threshold"), (F.col("size") > 0).alias("kept"))
    perplexity = F.when(F.col("size") > 0, F.exp(-F.col("lp") / F.col("size")))
    scored = cut(score(base, models, cached, chars).select("doc_id", "lang", "trusted", perplexity.alias("perplexity")))
    limits = cut(thresholds(scored.where("trusted")))
    overall = limits.where("lang is null").first()
    own = small(limits.where("lang is not null"), 100_000)
    out = scored.join(own, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall["threshold"] if overall else None).cast("double")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select("doc_id", "lang", "trusted", "perplexity", "threshold", keep.alias("kept"))
