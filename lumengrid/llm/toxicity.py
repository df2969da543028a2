"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary texts, spell each word to its end: the context of a letter is what stands
before it in its word, up to ORDER - 1 letters with the word's start. Words are runs of letters and their marks; all else
parts them. A letter that no labelled text has in a context of labelled texts gets each model's weight of backing off there, times
a shared likelihood, so that it says the ratio of these weights; in a context that no labelled text has, it says nothing. Both models discount their own counts absolutely and back off to shared counts: the pooled counts of both classes in
the same context, which back off to continuation counts (in how many contexts that end alike a letter occurs) and from
there to all letters. An expression that either class has hardly seen thus gets nearly the same likelihood from both.

A toxic text is written in ordinary words for the most part, so the toxic likelihood of a word is 1 - SHARE of its ordinary one
and SHARE of that by the model of toxic texts. A text's score is the difference of its two log-likelihoods by number of words, of
all words and in both directions, mapped to 0..1 by a logistic curve.

Counts cover all n-grams of all labelled rows, in a Spark table that grows with them. It meets words in parts of at most `PART`
n-grams. If it is one part, texts are scored in one pass; else the texts' distinct words meet all parts first, one pass for each, and
texts then meet the parts of the words' table. Sums are exact, so both ways give the same. The curve is fitted on at most
`CURVE_ROWS` rows in expectation, each half scored by the other half's model.

Null and empty texts, and texts without a letter, say nothing and score the curve's value at no difference, 0.5 at most. Rows without a
label or text are not learned from; a document labelled more than once counts once per label row. With no row of one of
the classes, every score is 0. Texts of any length are read whole; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumengrid.llm.common import fresh, give_back, slices, stored, sums, table, texts_of, words_of

#: Letters of an n-gram: a letter, or the end mark, with its context.
ORDER = 6
START, END = "^", "$"
#: Stands for each letter that no labelled text has in a context; no word holds it.
UNSEEN = "*"
DISCOUNT = 0.9
#: The share of a toxic text's words that the model of toxic texts writes.
SHARE = 0.01
#: Gains are whole multiples of 1 / STEP, so that their sums are exact in any order.
STEP = 1 << 20
#: N-grams or words that a worker holds at once, 16 to 32 bytes each.
PART = 4_000_000
#: Bytes of text that a worker spells at once.
SLICE = 2 << 20
#: Slots into which labelled ids are hashed to leave out texts before they are dealt; a fixed number.
SLOTS = 1 << 20
CURVE_ROWS = 6000
#: An n-gram's counts in each half's ordinary and toxic rows.
COUNTS = ("n00", "n01", "n10", "n11")
THRESHOLD = 0.7
#: What parts words: all but letters and the marks that belong to them.
OTHER = r"[^\pL\pM]+"


def grams(word: str) -> list[str]:
    """Each letter of a word, and its end, with its context."""
    marked = START + word + END
    return [marked[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(marked))]


#: Odd multipliers of a gram's letters, the last letter's first: a key is their sum, modulo 2**64.
WEIGHTS = np.random.default_rng(29).integers(1, 2**63, ORDER, dtype=np.uint64) | np.uint64(1)


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the texts in a row, the key of it with up to ORDER - 1 before it in its text; its place there; the lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    key = codes * WEIGHTS[0]
    for j in range(1, ORDER):
        key[j:] += np.where(place[j:] >= j, codes[:-j] * WEIGHTS[j], np.uint64(0))
    return key, place, size


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words' grams in order, how many each word has); an empty word has none."""
    key, place, size = _keys([START + w + END if w else "" for w in words])
    return key[place > 0], np.maximum(size - 1, 0)


def backed_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As gram_keys, and between them the key of each gram with UNSEEN as its letter."""
    marked = "".join([w + END for w in words if w])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    keys, size = gram_keys(words)
    return keys, keys + (np.uint64(ord(UNSEEN)) - codes) * WEIGHTS[0], size


def unit_keys(units: list[str]) -> np.ndarray:
    """The key of each gram, ORDER letters at most."""
    key, _, size = _keys(units)
    return key[np.cumsum(size) - 1] if len(units) else key


def word_keys(words: list[str]) -> tuple[np.ndarray, None, np.ndarray]:
    """(a key for each word, none for what is unseen, 1 each); an empty word has none."""
    there = np.fromiter((bool(w) for w in words), np.int64, len(words))
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words if w), np.uint64, int(there.sum())), None, there


def spelled(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, each token's words and their offsets, each text's tokens and their offsets); tokens are parted by white space."""
    tokens, codes, offsets = words_of(texts)
    words, own, own_offsets = words_of(pc.utf8_lower(pa.array(tokens, pa.string())), OTHER, regex=True)
    return words, own, own_offsets, codes, offsets


def gains(nodes: DataFrame) -> DataFrame:
    """(gram, by0, by1, both): the log(toxic / ordinary) of each n-gram's last letter, by the rows outside half 0, outside half 1, and by all.

    Each context has a row more, with UNSEEN as its letter: the log ratio of the weights of backing off there. All steps are aggregations and joins of the n-grams' table, and nothing of it reaches the driver.
    """
    size = F.length("gram")
    own = nodes.select("*", F.expr("left(gram, length(gram) - 1)").alias("context"), F.substring("gram", size - 1, F.lit(1)).alias("last"), F.right("gram", F.lit(1)).alias("letter"))
    pairs = own.groupBy("last", "letter").agg(F.count("*").alias("f"))
    after = pairs.groupBy("last").agg(F.sum("f").alias("after"), F.count("*").alias("kinds"))
    letters = pairs.groupBy("letter").agg(F.sum("f").alias("letters"))
    n_letters, n_types = letters.agg(F.count("*"), F.sum("letters")).first()
    less = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) if isinstance(c, str) else F.greatest(c - DISCOUNT, F.lit(0.0))
    base = less("letters") / F.lit(n_types or 1) + F.lit(DISCOUNT / (n_types or 1))
    spread = pairs.join(after, "last").join(letters, "letter").select("last", "letter", (less("f") / F.col("after") + DISCOUNT * F.col("kinds") / F.col("after") * base).alias("spread"))
    counts = {"by0": ("n10", "n11"), "by1": ("n00", "n01"), "both": ("n0", "n1")}
    own = own.withColumns({"n0": F.col("n00") + F.col("n10"), "n1": F.col("n01") + F.col("n11")})
    sides = [c for two in counts.values() for c in two]
    sums_of = [F.sum(c).alias("sum_" + c) for c in sides] + [F.sum((F.col(c) > 0).cast("long")).alias("types_" + c) for c in sides]
    contexts = own.groupBy("context").agg(F.sum(F.col("n0") + F.col("n1")).alias("pooled"), F.count("*").alias("types"), *sums_of)
    told = own.join(contexts, "context").join(spread, ["last", "letter"])
    shared = less(F.col("n0") + F.col("n1")) / F.col("pooled") + DISCOUNT * F.col("types") / F.col("pooled") * F.col("spread")
    told = told.withColumn("shared", shared)

    def p(c: str):
        return F.when(F.col("sum_" + c) > 0, (less(c) + DISCOUNT * F.col("types_" + c) * F.col("shared")) / F.col("sum_" + c)).otherwise(F.col("shared"))

    def left(c: str):
        return F.when(F.col("sum_" + c) > 0, DISCOUNT * F.col("types_" + c) / F.col("sum_" + c)).otherwise(1.0)

    exact = lambda e: F.round(e * STEP) / STEP
    seen = told.select("gram", *[F.when(F.col(ordinary) + F.col(toxic) > 0, exact(F.log(p(toxic) / p(ordinary)))).otherwise(exact(F.log(left(toxic) / left(ordinary)))).alias(name) for name, (ordinary, toxic) in counts.items()])
    backed = contexts.select(F.concat("context", F.lit(UNSEEN)).alias("gram"), *[exact(F.log(left(toxic) / left(ordinary))).alias(name) for name, (ordinary, toxic) in counts.items()])
    return seen.unionByName(backed)


class Held:
    """A part of a table (unit, values) in a worker: sorted 64-bit keys of the units, and their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Puts the keys' values where the part holds them, and returns where it does."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        values[hit] = self.values[at[hit]]
        return hit

    def sums(self, keys: np.ndarray, unseen: np.ndarray | None, size: np.ndarray) -> np.ndarray:
        """The sums of the values of each list's units, or of the unseen where these are none; what the part does not hold adds nothing."""
        values = np.zeros((len(keys), self.values.shape[1]))
        if len(self.keys):
            missed = np.flatnonzero(~self.find(keys, values))
            if unseen is not None and len(missed):
                other = values[missed]
                self.find(unseen[missed], other)
                values[missed] = other
        return sums(values, np.concatenate([[0], np.cumsum(size)]))


def parts_of(table: DataFrame, names: list[str], keys_of, split) -> Iterator[Held]:
    """The table (unit, ...) in parts of about PART rows, keys instead of units; units alike in `split` fall in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(keys_of(batch.column(0).to_pylist()).view(np.int64))
            yield pa.record_batch([keys, *batch.columns[1:]], ["key", *names])

    parts, unit = max(1, -(-table.count() // PART)), table.columns[0]
    for k in range(parts):
        some = table.where(F.pmod(F.xxhash64(split), F.lit(parts)) == k).select(unit, *names)
        held = some.mapInArrow(run, "key long, " + ", ".join(f"`{n}` double" for n in names)).toArrow()  # numbers only
        yield Held(held.column("key").to_numpy().view(np.uint64), np.stack([held.column(n).to_numpy() for n in names], axis=1))


def word_gain(gain: np.ndarray) -> np.ndarray:
    """log(toxic / ordinary) of words of which the class models say `gain`, in whole multiples of 1 / STEP."""
    ratio = np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + gain)
    return np.round(ratio * STEP) / STEP


def likelihoods(df: DataFrame, told: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """`df` with toxic_words and toxic_<name>: each text's number of words and the sum of their log(toxic / ordinary)."""
    context = F.expr("left(gram, length(gram) - 1)")
    if told.count() <= PART:
        return summed(df, told, names, text_col, unit_keys, backed_keys, context, word_gain)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.record_batch([pa.array([w for w in spelled(texts_of(part.column("text")))[0] if w], pa.string())], ["word"])

    words = stored(df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(distinct, "word string").distinct())
    by_word = summed(words, told, names, "word", unit_keys, backed_keys, context, None)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), *(pa.array(word_gain(batch.column(1 + i).to_numpy())) for i in range(len(names)))], ["word", *names])

    gained = by_word.select("word", *["toxic_" + n for n in names]).mapInArrow(finished, "word string, " + ", ".join(f"`{n}` double" for n in names))
    return summed(df, stored(gained), names, text_col, lambda units: word_keys(units)[0], word_keys, F.col("word"), None)


def summed(df: DataFrame, table: DataFrame, names: list[str], text_col: str, keys_of, units_of, split, change) -> DataFrame:
    """`df` with toxic_words and toxic_<name>: each text's number of words, and the sum over their units of each of the table's columns.

    `keys_of` gives the table's units their keys, `units_of` the keys of each word's units and of
    what stands for the unseen, which falls in a unit's part by `split`. `change` turns the sum of each word's
    units, if the table is one part. Each part of the table meets all texts.
    """
    added = ["toxic_words", *["toxic_" + n for n in names]]
    df = df.drop(*added).withColumns({added[0]: F.lit(0).cast("long"), **{c: F.lit(0.0) for c in added[1:]}})
    shared = None
    for k, held in enumerate(parts_of(table, names, keys_of, split)):
        if k:
            df = stored(df)
            shared.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(held)  # PART units at most, as hashes split them

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first: bool = not k) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col, SLICE):
                words, own, own_offsets, codes, offsets = spelled(texts_of(part.column(text_col)))
                values = shared.value.sums(*units_of(words))
                there = np.array([bool(w) for w in words], bool)
                if change is not None:
                    values = np.where(there[:, None], change(values), 0.0)
                by_word = np.column_stack([there, values])
                total = sums(sums(by_word[own], own_offsets)[codes], offsets)
                columns = list(part.columns[: -len(added)])
                columns.append(pa.array(total[:, 0].astype(np.int64)) if first else part.column(added[0]))
                columns += [pa.array(total[:, i] + part.column(c).to_numpy()) for i, c in enumerate(added[1:], 1)]
                yield pa.record_batch(columns, part.schema.names)
            give_back()

        df = df.mapInArrow(run, df.schema)
    return df


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the rows with a text and a label 0 or 1.

    Labels have no size bound, so both sides are dealt by id; texts whose id falls in none of the labels' SLOTS stay where they are.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SLOTS))
    slots = marks.select(slot.alias("slot")).distinct()  # SLOTS rows at most
    some = docs.select("doc_id", "text", slot.alias("slot")).where("text is not null").join(F.broadcast(slots), "slot", "left_semi")
    return some.select("doc_id", "text").join(marks.hint("merge"), "doc_id")


class Classifier:
    """The table of n-grams (none with no row of a class) and the curve."""

    def __init__(self, table: DataFrame | None, slope: float = 0.0, bias: float = 0.0):
        self.table, self.slope, self.bias = table, slope, bias


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method with a small ridge; both classes weigh alike."""
    scale = np.quantile(np.abs(x), 0.9) or 1.0
    x = np.clip(x, -3 * scale, 3 * scale)  # short texts lie far out
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        grad = design.T @ (weight * (p - y)) + 0.03 * np.array([w[0], 0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.03, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from all labelled rows of `docs`."""
    spark = docs.sparkSession
    rows = stored(labelled(docs, labels).withColumn("half", F.pmod(F.xxhash64("doc_id", "text", F.lit("half")), F.lit(2)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            n = np.array(list(held.values()), np.int64).reshape(-1, 4)
            batch = pa.record_batch([pa.array(held, pa.string()), *[pa.array(n[:, g]) for g in range(4)]], ["gram", *COUNTS])
            held.clear()
            return batch

        for part in slices(batches, limit=SLICE):
            words, own, own_offsets, codes, offsets = spelled(part.column("text"))
            group = part.column("half").to_numpy() * 2 + part.column("y").to_numpy()
            of = np.repeat(group, np.diff(offsets))
            n = np.zeros((len(words), 4), np.int64)
            for g in np.unique(group).tolist():
                tokens = np.bincount(codes[of == g], minlength=len(own_offsets) - 1)
                np.add.at(n[:, g], own, np.repeat(tokens, np.diff(own_offsets)))
            keys, size = gram_keys(words)
            _, first, of_key = np.unique(keys, return_index=True, return_inverse=True)
            total = np.stack([np.bincount(of_key, np.repeat(n[:, g], size), len(first)) for g in range(4)], axis=1).astype(np.int64)
            word = np.repeat(np.arange(len(words)), size)[first]
            end = first - (np.cumsum(size) - size)[word] + 2  # of the gram in its marked word
            for w, e, c in zip(word.tolist(), end.tolist(), total.tolist(), strict=True):
                gram = (START + words[w] + END)[max(0, e - ORDER) : e]
                if (mine := held.get(gram)) is None:
                    held[gram] = c
                else:
                    for g in range(4):
                        mine[g] += c[g]
            if len(held) > 250_000:
                yield out()
        yield out()
        give_back()

    counted = rows.mapInArrow(count, "gram string, " + ", ".join(f"{c} long" for c in COUNTS))
    nodes = stored(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    n = nodes.agg(*[F.sum(c) for c in COUNTS]).first()
    if not (n[0] or 0) + (n[2] or 0) or not (n[1] or 0) + (n[3] or 0):
        return Classifier(None)
    told = stored(gains(nodes))
    by_class = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, CURVE_ROWS / 2 / by_class.get(1, 1)))).otherwise(min(1.0, CURVE_ROWS / 2 / by_class.get(0, 1)))
    sample = rows.where(F.pmod(F.xxhash64("text", "doc_id", F.lit("curve")), F.lit(1_000_000)) < share * 1_000_000)

    x = F.when(F.col("half") == 0, F.col("toxic_by0")).otherwise(F.col("toxic_by1")) / F.greatest("toxic_words", F.lit(1))
    got = likelihoods(sample, told, ["by0", "by1"]).select(x.alias("x"), "y").toArrow()
    x, y = got.column("x").to_numpy(), got.column("y").to_numpy()
    order = np.lexsort((y, x))
    slope, bias = _curve(x[order], y[order].astype(float)) if len(x) and 0 < y.sum() < len(y) else (1.0, 0.0)
    return Classifier(told, max(slope, 0.0), bias)


def annotate(df: DataFrame, classifier: Classifier, text_col: str = "text", score_out: str = "toxic_score") -> DataFrame:
    """`df` with its score; a clashing column of this name is replaced. Columns named as the sums' would be stay as they are."""
    df = df.drop(score_out)
    if classifier.table is None:
        return df.withColumn(score_out, F.lit(0.0))
    columns = df.columns
    clash = {c: fresh(df, "kept_" + c) for c in columns if c.lower() in ("toxic_words", "toxic_both")}
    df = df.withColumnsRenamed(clash)
    text_col = clash.get(text_col, text_col)
    x = F.col("toxic_both") / F.greatest("toxic_words", F.lit(1))
    score = 1 / (1 + F.exp(-F.greatest(F.least(classifier.bias + classifier.slope * x, F.lit(50.0)), F.lit(-50.0))))
    score = F.when(F.col("toxic_words") == 0, F.least(score, F.lit(0.5))).otherwise(score)
    return likelihoods(df, classifier.table, ["both"], text_col).select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in columns], score.alias(score_out))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the toxicity of all documents; labels of every third document, by the checksum of its id, are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    scored = annotate(docs, classifier)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
