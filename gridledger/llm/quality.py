"""Quality classifier: interpolated modified Kneser-Ney models of trusted text, by words and by spelling, one of each per language.

The model of hashed word pairs (``words``) gives a text's perplexity, score and bound. A text is rejected if its words
are, and also if its spelling is, which tells garbled words from rare ones where trusted text is short.

The spelling's units are characters folded into 64 classes, its order is four: texts
of any language and any length are scored without unknown units, and a model is
bounded by 64^3 contexts. Counts cover all trusted texts. They are dealt into ``FOLDS``
by a hash of the text, so that copies stay together, and each fold is scored by a model
of the counts less its own: every trusted text has a held out score. Each task counts its
own share; the counts are shuffled by language and n-gram, and the model is made
from these shards: continuation counts of the next higher order, discounts from the
counts of counts, joined with the counts, and totals per context. A language's rows
have a proven bound, so they meet a document by broadcast, where the next shorter
contexts are interpolated; a shuffled join with all n-grams of all documents would
move several times the input.

A document's cross-entropy per word (per character) is drawn to its language's mean by
``PRIOR_WORDS`` words (``PRIOR`` characters), so a short text needs stronger evidence. A document is
rejected if either score lies above the quantile ``HIGH`` of the held out scores of the trusted
texts of its language, however few they are. Only a language whose trusted texts all lie in one fold
(such as a single text) has no held out score; it is judged, like a language
without trusted text, by the model and quantile of all languages together.

Only tables of a proven size are broadcast: a language has at most 64^3 rows of 64
four-byte numbers (64 MB), and languages are scored ``GROUP`` at a time. Trusted ids
are broadcast up to ``BROADCAST_IDS`` rows and joined by a shuffle beyond.

Rows: a null or empty text, or one without words, has no perplexity and is rejected. A null
language is a language of its own. Null and repeated ids are scored row by row;
an id is trusted if any of its labels says good and none says bad or toxic.
Without trusted text nothing is rejected but empty texts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.llm import common, words

ORDER = 4
CLASSES = 64
FOLDS = 5
HIGH = 0.998
PRIOR = 100
PRIOR_WORDS = 20
GROUP = 4
BROADCAST_IDS = 4_000_000
#: Characters coded at once.
CHUNK = 1 << 20
#: Language key of the model of all languages; no row has it, as row keys start with a letter or "-".
ALL = "*"


def _class_table() -> np.ndarray:
    """Class of each code point below 0x250, the last for all others; 0 is the edge of a text."""
    table = np.full(0x251, 62, np.uint8)  # other letters
    groups = [*"abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".", ",", "!", "?", "'", "\"", "-",
              ":;", "()[]{}", "*", "$", "#", "%", "&", "|", "/\\", "@+=~^_`<>"]
    for number, group in enumerate(groups, 1):
        for char in group:
            table[ord(char)] = number
    table[:32][table[:32] == 62] = 63  # control characters
    accents = "àâäçèéêëîïôöùûüñáíóúß"
    for char in accents:
        number = len(groups) + 1 + accents.index(char) % (61 - len(groups))
        table[ord(char)] = number
        if char.upper() != char and len(char.upper()) == 1:
            table[ord(char.upper())] = table[ord("A")]
    table[0xA0:0xC0] = 63
    return table


TABLE = _class_table()


def codes_of(text: bytes) -> Iterator[np.ndarray]:
    """N-gram codes (base 64, last class lowest) at every character, in chunks; texts start with edge classes."""
    whole = text.decode("utf-8", "replace")
    tail = np.zeros(ORDER - 1, np.int32)
    for at in range(0, len(whole), CHUNK):
        points = np.frombuffer(whole[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.concatenate([tail, TABLE[np.minimum(points, 0x250)].astype(np.int32)])
        tail = classes[-(ORDER - 1):]
        n, codes = len(points), np.zeros(len(points), np.int32)
        for k in range(ORDER):
            codes = codes * CLASSES + classes[k:k + n]
        yield codes


def _language(df: DataFrame) -> Column:
    if "lang" not in df.columns:
        return F.lit("-")
    return F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("-"))


def _merged(held: tuple[np.ndarray, np.ndarray] | None, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts, with those held before."""
    codes, counts = np.unique(np.concatenate(parts), return_counts=True)
    if held is None:
        return codes, counts
    both = np.concatenate([held[0], codes])
    order = np.argsort(both, kind="stable")
    both, counts = both[order], np.concatenate([held[1], counts])[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.add.reduceat(counts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per language, merged every ``CHUNK`` characters and let go while the tables are small."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def settle() -> None:
        for lang, parts in waiting.items():
            held[lang] = _merged(held.get(lang), parts)
        waiting.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in held.items():
            yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for codes in codes_of(text.as_py() or b""):
                waiting.setdefault(lang.as_py(), []).append(codes)
                size += len(codes)
                if size >= CHUNK:
                    settle()
                    size = 0
            if sum(len(c) for c, _ in held.values()) > CHUNK:
                yield from flush()
    settle()
    yield from flush()


def count_grams(texts: DataFrame) -> DataFrame:
    """texts (lang, text) to (lang, gram, n), with the sums over all languages under ``ALL``."""
    counted = texts.select("lang", F.col("text").cast("binary")).mapInArrow(_count, "lang string, gram int, n long")
    both = counted.withColumn("lang", F.explode(F.array("lang", F.lit(ALL))))
    return both.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fold_counts(texts: DataFrame) -> DataFrame:
    """texts (lang, fold, text) to (lang, gram, n): counts less those of a fold, under the fold's digit and the language;
    the counts of all texts have the digit ``FOLDS``. Sums over all languages are under ``ALL``."""
    counted = (texts.select(F.concat(F.col("fold").cast("string"), "lang").alias("lang"), F.col("text").cast("binary"))
               .mapInArrow(_count, "lang string, gram int, n long"))
    folds = [F.sum(F.when(F.col("lang").startswith(str(f)), F.col("n")).otherwise(0)) for f in range(FOLDS)]
    sums = (counted.withColumn("key", F.explode(F.array(F.expr("substring(lang, 2)"), F.lit(ALL))))
            .groupBy("key", "gram").agg(F.sum("n").alias("all"), F.array(*folds, F.lit(0)).alias("less")))
    return (sums.select("key", "gram", "all", F.posexplode("less").alias("fold", "own"))
            .select(F.concat(F.col("fold").cast("string"), "key").alias("lang"), "gram", (F.col("all") - F.col("own")).alias("n"))
            .where("n > 0"))


def kneser_ney(counts: DataFrame, order: int = ORDER, classes: int = CLASSES) -> DataFrame:
    """(lang, length, context, total, mass, own): modified Kneser-Ney counts of the contexts of each length.

    The shorter n-grams count their distinct left neighbours. ``own`` has (class, count less its
    discount) of every class seen after the context, ``total`` the sum of the counts, ``mass`` the
    sum of the discounts, which is the weight of the next shorter context. Discounts are the usual
    estimates from the numbers of n-grams seen once to four times, kept within 0.05 and the count.
    """
    level = common.landed(counts)
    grams = level.withColumn("length", F.lit(order - 1))
    for k in range(order - 1, 0, -1):
        level = level.groupBy("lang", F.pmod("gram", F.lit(classes ** k)).cast("int").alias("gram")).agg(F.count("*").alias("n"))
        grams = grams.unionByName(level.withColumn("length", F.lit(k - 1)))
    grams = common.landed(grams)
    seen = [F.count(F.when(F.col("n") == c, 1)).alias(f"n{c}") for c in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    discount = [F.least(F.greatest(F.coalesce(c - F.try_divide((c + 1) * y * F.col(f"n{c + 1}"), F.col(f"n{c}")), F.lit(0.5 * c)),
                                   F.lit(0.05)), F.lit(float(c))).alias(f"d{c}") for c in (1, 2, 3)]
    discounts = grams.groupBy("lang", "length").agg(*seen).select("lang", "length", *discount)
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    kept = F.struct(F.pmod("gram", F.lit(classes)).cast("int").alias("class"), (F.col("n") - F.col("cut")).alias("kept"))
    return (grams.join(F.broadcast(discounts), ["lang", "length"])  # four rows a language
            .withColumn("cut", cut).withColumn("context", F.floor(F.col("gram") / classes).cast("int"))
            .groupBy("lang", "length", "context")
            .agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"), F.collect_list(kept).alias("own")))  # an entry a class


class Model:
    """Log probabilities of one language: a row of 64 for each context seen, and the row of every context of three classes.

    A context that was never seen stands for its next shorter suffix.
    """

    def __init__(self, rows: pa.Table) -> None:
        """rows: length, context, total, mass, classes and kept (the entries of ``own``) of ``kneser_ney``."""
        length, context, total, mass = (rows[c].to_numpy() for c in ("length", "context", "total", "mass"))
        classes, kept = (rows[c].combine_chunks() for c in ("classes", "kept"))
        entries = np.repeat(np.arange(len(length)), classes.value_lengths().to_numpy(zero_copy_only=False))
        own = np.zeros((len(length), CLASSES))
        own[entries, classes.flatten().to_numpy()] = kept.flatten().to_numpy()
        probs = [np.full((1, CLASSES), 1.0 / CLASSES)]
        at, count = np.zeros(1, np.int32), 1  # row of every context of the last length; the first is the uniform one
        for size in range(ORDER):
            at = np.tile(at, CLASSES) if size else at  # the suffix of a context is its lower part
            level = np.flatnonzero(length == size)
            lower = np.concatenate(probs)[at[context[level]]]
            probs.append((own[level] + mass[level, None] * lower) / total[level, None])
            at[context[level]] = np.arange(count, count + len(level))
            count += len(level)
        self.logs = np.concatenate([np.log2(p, out=p).astype(np.float32).ravel() for p in probs])
        self.row = at * CLASSES

    @property
    def probs(self) -> np.ndarray:
        return np.exp2(self.logs.reshape(-1, CLASSES).astype(np.float64))

    def bits(self, codes: np.ndarray) -> float:
        return -float(self.logs[self.row[codes >> 6] + (codes & 63)].sum(dtype=np.float64))


def _score(models, keep: list[int], names: list[str], both: bool):
    """Adds the bits under the model of each row's key and the characters; ``both``: also a row for the model ``ALL``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = models.value
        for batch in batches:
            width = batch.num_columns
            keys, texts = batch.column(width - 2).to_pylist(), batch.column(width - 1).to_pylist()
            for name in (None, ALL) if both else (None,):
                bits, chars = [], []
                for key, text in zip(keys, texts, strict=True):
                    model = held.get(name or key)
                    total, n = (None if model is None else 0.0), 0
                    for codes in codes_of(text or b""):
                        total = None if model is None else total + model.bits(codes)
                        n += len(codes)
                    bits.append(total)
                    chars.append(n)
                key = batch.column(width - 2) if name is None else pa.array([name] * len(keys), pa.string())
                yield pa.record_batch([*(batch.column(i) for i in keep), key, pa.array(bits, pa.float64()), pa.array(chars, pa.int64())],
                                      names=names)
    return run


def _collect(model: DataFrame, langs: list[str]) -> dict[str, Model]:
    """Models of a bounded group of languages; each has at most 64^3 + 64^2 + 64 + 1 contexts."""
    rows = model.where(F.col("lang").isin(langs)).select(
        "lang", "length", "context", "total", "mass", F.col("own.class").alias("classes"), F.col("own.kept").alias("kept")).toArrow()
    out = {lang: Model(rows.filter(pc.equal(rows["lang"], lang))) for lang in pc.unique(rows["lang"]).to_pylist()}
    del rows
    pa.default_memory_pool().release_unused()  # the driver keeps no more than the models
    return out


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(2), text)]


class Classifier:
    """A trained model: languages, their held out means and bounds by words and by spelling."""

    def __init__(self, model: DataFrame, known: list[str], spelling: dict[str, tuple[float, float]] | None = None) -> None:
        self.model, self.known, self.spelling = model, known, spelling or {}
        self.bounds: dict[str, tuple[float, float]] = {}
        self.held: dict[tuple, object] = {}
        self.docs = self.rows = self.words = None

    def _rows(self, docs: DataFrame, trusted: Column) -> DataFrame:
        """The rows that ``words.scores`` takes, for the texts of ``docs`` under the models that judge them."""
        lang, text = _language(docs), F.col("text").cast("string")
        own = F.when(lang.isin(self.known), lang).otherwise(F.lit(ALL))
        return docs.where(F.length(text) > 0).select(own.alias("model"), *(k.alias(n) for k, n in zip(_keys(text), ("k1", "k2"), strict=True)),
                                                     trusted.cast("long").alias("n"), text.alias("text"))

    def learn(self, docs: DataFrame, ids: DataFrame, high: float) -> None:
        """Score all texts of ``docs`` by the trusted ones' word pairs, and set the bounds on the held out scores."""
        self.docs, self.high = docs, high
        if not self.spelling:  # no held out text
            return
        mark, = common.fresh(docs, "trusted")
        id_, = common.fresh(docs, "trusted_id")
        marked = docs.join(ids.select(F.col("doc_id").alias(id_), F.lit(1).alias(mark)), F.col("doc_id") == F.col(id_), "left")
        self.rows = self._rows(marked, F.coalesce(F.col(mark), F.lit(0)))
        self._score_words(self.rows)

    def _score_words(self, rows: DataFrame) -> None:
        if rows.where(F.col("model") == ALL).limit(1).count():  # some text is judged by all languages together
            models = F.when((F.col("n") > 0) & (F.col("model") != ALL), F.array("model", F.lit(ALL))).otherwise(F.array("model"))
            rows = rows.withColumn("model", F.explode(models))
        self.words = words.scores(rows)
        held = self.words.where("held is not null and n > 0")
        means = held.groupBy("model").agg((F.sum("held") / F.sum("n")).alias("mean"))
        value = (F.col("held") + PRIOR_WORDS * F.col("mean")) / (F.col("n") + PRIOR_WORDS)
        found = (held.join(F.broadcast(means), "model").groupBy("model", "mean")
                 .agg(F.percentile_approx(value, self.high, 100_000).alias("bound")).collect())  # a row a language
        self.bounds = {r.model: (r.mean, r.bound) for r in found}

    def _meet(self, docs: DataFrame) -> None:
        """Score the texts that are not among those of the training documents."""
        if self.rows is None or docs.sameSemantics(self.docs):
            return
        new = self._rows(docs, F.lit(0)).join(self.words.select("model", "k1", "k2"), ["model", "k1", "k2"], "left_anti")
        if new.limit(1).count():
            self._score_words(self.rows.unionByName(new))

    def _models(self, df: DataFrame, langs: list[str]):
        if tuple(langs) not in self.held:
            self.held[tuple(langs)] = df.sparkSession.sparkContext.broadcast(_collect(self.model, langs))
        return self.held[tuple(langs)]

    def release(self) -> None:
        """Free the broadcast models."""
        for models in self.held.values():
            models.destroy()
        self.held.clear()

    def score(self, docs: DataFrame, keep: list[str], both: bool = False) -> DataFrame:
        """The columns ``keep`` with model_lang, bits and chars of every row. One pass for each group of languages."""
        key, body, bits, chars = common.fresh(docs, "model_lang", "body", "bits", "chars")
        lang = _language(docs)
        rows = docs.withColumn(key, F.when(lang.isin(self.known), lang).otherwise(F.lit(ALL)))
        parts = []
        groups = [self.known[i:i + GROUP] for i in range(0, len(self.known), GROUP)] or [[]]
        for number, group in enumerate(groups):
            mine = [*group, ALL] if number == len(groups) - 1 else group
            models = self._models(docs, [*group, ALL])
            part = rows if len(groups) == 1 else rows.where(F.col(key).isin(mine))
            part = part.select(*(common.quoted(c) for c in keep), F.col(key), F.col("text").cast("binary").alias(body))
            kept = [T.StructField(f.name, f.dataType) for f in part.schema.fields[:-1]]
            schema = T.StructType([*kept, T.StructField(bits, T.DoubleType()), T.StructField(chars, T.LongType())])
            parts.append(part.mapInArrow(_score(models, list(range(len(kept) - 1)), schema.names, both), schema))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _of(self, key: Column, values: dict[str, tuple[float, float]], position: int) -> Column:
        out = F.lit(None).cast("double")  # one value a language
        for name, pair in values.items():
            out = F.when(key == name, F.lit(pair[position])).otherwise(out)
        return out

    def _spelled(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep``, the two keys of the text, the model's language and whether the spelling is rejected."""
        k1, k2 = common.fresh(docs, "k1", "k2")
        a, b = _keys(F.col("text").cast("string"))
        scored = self.score(docs.withColumn(k1, a).withColumn(k2, b), [*keep, k1, k2])
        lang, bits, chars = (F.col(c) for c in scored.columns[-3:])
        value = (bits + PRIOR * self._of(lang, self.spelling, 0)) / (chars + PRIOR)
        bad, = common.fresh(scored, "misspelled")
        return scored.select(*(common.quoted(c) for c in scored.columns[:-2]),
                             ((chars == 0) | F.coalesce(value > self._of(lang, self.spelling, 1), F.lit(False))).alias(bad))

    def _judged(self) -> DataFrame:
        """Texts with perplexity, score, bound and whether their words are rejected."""
        bits, n, model = F.col("bits"), F.col("n"), F.col("model")
        value = F.when(n > 0, (bits + PRIOR_WORDS * self._of(model, self.bounds, 0)) / (n + PRIOR_WORDS))
        bound = self._of(model, self.bounds, 1)
        return self.words.select("model", "k1", "k2", F.when(n > 0, F.pow(F.lit(2.0), bits / n)).alias("perplexity"), value.alias("score"),
                                 bound.alias("bound"), ((n == 0) | F.coalesce(value > bound, F.lit(False))).alias("bad"))

    def judge(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` with perplexity, score, bound and rejected."""
        keep = docs.columns if keep is None else keep
        names = common.fresh(docs, "perplexity", "score", "bound", "rejected")
        self._meet(docs)
        spelled = self._spelled(docs, keep)
        k1, k2, lang, bad = (F.col(c) for c in spelled.columns[-4:])
        if self.words is None:
            null = F.lit(None).cast("double")
            columns = [null, null, null, bad]
        else:
            columns = common.fresh(spelled, "model", "a", "b", "word_perplexity", "word_score", "word_bound", "word_bad")
            spelled = spelled.join(self._judged().toDF(*columns), (lang == F.col(columns[0])) & (k1 == F.col(columns[1])) & (k2 == F.col(columns[2])), "left")
            columns = [*(F.col(c) for c in columns[3:6]), bad | F.coalesce(F.col(columns[6]), F.lit(False))]
        return spelled.select(*(common.quoted(c) for c in keep), *(c.alias(n) for c, n in zip(columns, names, strict=True)))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows that are not rejected, with the columns of ``docs``."""
        self._meet(docs)
        spelled = self._spelled(docs, docs.columns)
        k1, k2, lang, bad = (F.col(c) for c in spelled.columns[-4:])
        good = spelled.where(~bad)
        if self.words is not None:
            keys = common.fresh(spelled, "model", "a", "b")
            worse = common.checkpointed(self._judged().where("bad").select("model", "k1", "k2").toDF(*keys))
            worse = F.broadcast(worse) if worse.count() <= BROADCAST_IDS // 4 else worse
            good = good.join(worse, (lang == F.col(keys[0])) & (k1 == F.col(keys[1])) & (k2 == F.col(keys[2])), "left_anti")
        return good.select(*(common.quoted(c) for c in docs.columns))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good and not toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0)
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_and(good).alias("good"))
            .where("good").select("doc_id"))


def train(docs: DataFrame, labels: DataFrame, high: float = HIGH, broadcast_ids: int = BROADCAST_IDS) -> Classifier:
    """Count, smooth, and set the bounds on the held out scores of the trusted texts."""
    ids = common.checkpointed(trusted_ids(labels))
    chosen = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    texts = texts.join(chosen, "doc_id", "left_semi")
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    models = common.landed(kneser_ney(fold_counts(texts.select(_language(texts).alias("lang"), "fold", "text"))))
    having = models.where("length = 0").select("lang").distinct().collect()  # a row a language and fold

    def fitted(fold: int) -> Classifier:
        known = sorted(r.lang[1:] for r in having if r.lang[0] == str(fold) and r.lang[1:] != ALL)
        return Classifier(models.where(F.col("lang").startswith(str(fold))).withColumn("lang", F.expr("substring(lang, 2)")), known)
    scored = None
    for fold in range(FOLDS):  # the models of one fold at a time
        model = fitted(fold)
        part = common.checkpointed(model.score(texts.where(F.col("fold") == fold), [], both=True).where("bits is not null"))
        model.release()
        scored = part if scored is None else scored.unionByName(part)
    means = scored.groupBy("model_lang").agg((F.sum("bits") / F.sum("chars")).alias("mean"))
    value = (F.col("bits") + PRIOR * F.col("mean")) / (F.col("chars") + PRIOR)
    found = (scored.join(F.broadcast(means), "model_lang").groupBy("model_lang", "mean")
             .agg(F.percentile_approx(value, high, 100_000).alias("bound")).collect())  # a row a language
    bounds = {r.model_lang: (r.mean, r.bound) for r in found}
    whole = fitted(FOLDS)
    out = Classifier(whole.model, [k for k in whole.known if k in bounds], bounds)
    out.learn(docs, chosen, high)
    return out
