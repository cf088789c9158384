"""Text quality by an interpolated modified Kneser-Ney model of characters, trained on all trusted documents.

The model counts n-grams of up to four characters in every trusted document (tasks count, Spark adds up). Each order's
probabilities come from joins of the count tables by context and by suffix, dealt by n-gram: counts of counts give the three
discounts of an order, lower orders count distinct left neighbours, and every n-gram takes up the probability of its suffix.
A document's perplexity is read off that table. While the table is small (counted first, MODEL_ROWS rows at most) it is
sent to the tasks; a larger one stays where it is dealt and meets the documents' own distinct n-grams in joins by order. Both ways give the same figures.

Thresholds are quantiles of the trusted documents' log-perplexities in each language: upper quartile plus a multiple of the
quartile distance. Short texts are drawn towards the trusted mean (SHORT characters' worth of it), so that a handful of rare words rejects nothing.

Four characters can't see a word repeat, so a text may also be too easy: variety is the share of distinct words in windows
of WINDOW words, the last one ending with the text, whatever its length. The lower limit is taken from the trusted documents of
each language in the same way, lower quartile less a multiple of the quartile distance, and short texts are drawn to the trusted mean.

Defined cases: a null or empty text has the trusted mean perplexity and is kept. A language without trusted documents (null
included) takes the thresholds over all languages. Without any trusted document nothing is rejected and perplexity is null. Rows
with a null or repeated doc_id give a row each. Empty tables give an empty result. Columns other than doc_id, text and
lang (and doc_id and quality of the labels) play no part.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import bundled, by_own_ids, held, small, texts

ORDER = 4
#: Pseudo-characters of the trusted mean in every text, and the quartile distances above the upper quartile at which a text is
#: rejected: at least MARGIN nats a character, for languages whose trusted documents are very much alike.
SHORT, FENCE, MARGIN = 200, 4.0, 0.12
#: The same for variety: words in a window, words' worth of the trusted mean in every text, and the least distance of the lower limit.
WINDOW, SHORT_WORDS, MARGIN_WORDS = 64, 32, 0.2
#: Rows of the model (24 bytes each) up to which it is sent to the tasks.
MODEL_ROWS = 2_000_000
#: Trusted ids (16 bytes each) up to which they are broadcast, and n-grams that a task sorts at once.
TRUSTED_ROWS, PORTION = 1_000_000, 1_000_000
_SPACE = re.compile(r"[ \t-\r]+")
_DIGIT = str.maketrans("123456789", "000000000")


def grams(text: str) -> np.ndarray:
    """The n-grams of the highest order, 16 bits a character (others than the basic plane's as U+FFFF), begun by blanks."""
    text = " " * ORDER + _SPACE.sub(" ", text).translate(_DIGIT).strip(" ")
    chars = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF).astype(np.uint64)
    out = np.zeros(len(chars) - ORDER, np.uint64)
    for j in range(ORDER):
        out = (out << np.uint64(16)) | chars[j + 1 : len(chars) - ORDER + j + 1]
    return out.view(np.int64)


def variety(text: str) -> tuple[int, int]:
    """Words in all windows of a text, and the sum of each window's distinct ones. The last window ends with the text."""
    words = text.lower().split()
    if len(words) <= WINDOW:
        return len(words), len(set(words))
    starts = [*range(0, len(words) - WINDOW, WINDOW), len(words) - WINDOW]
    return WINDOW * len(starts), sum(len(set(words[i : i + WINDOW])) for i in starts)


def _varieties(column: pa.Array) -> list[pa.Array]:
    """words and fresh of a column's texts."""
    found = [variety(text.as_py()) for text in column]
    return [pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)]


def _portions(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The n-grams of a column's texts, about PORTION at a time, each with the position of its first text."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(column):
        parts.append(grams(text.as_py()))
        size += len(parts[-1])
        if size >= PORTION:
            yield first, parts
            first, parts, size = i + 1, [], 0
    if parts:
        yield first, parts


def _suffix(order: int):
    """Of a code of that order, the code without its first character."""
    return F.col("code").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def trusted_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """code and count of the highest order's n-grams, over all trusted documents (ids in doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for _, parts in _portions(batch.column(0)):
                code, count = np.unique(np.concatenate(parts), return_counts=True)
                both, at = np.unique(np.concatenate([seen[0], code]), return_inverse=True)
                seen = both, np.bincount(at, np.concatenate([seen[1], count]), len(both)).astype(np.int64)
                if len(both) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in seen], ["code", "n"])
                    seen = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in seen], ["code", "n"])

    rows = texts(docs).join(small(trusted.select("doc_id"), TRUSTED_ROWS), "doc_id", "left_semi").select("text")
    return rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """order, code, logp (of the last character after the others) and back (log weight of lower orders after this context)."""
    by = {ORDER: held(bundled(counts))}
    for k in range(ORDER - 1, 0, -1):
        by[k] = held(bundled(by[k + 1].select(_suffix(k + 1).alias("code")).groupBy("code").agg(F.count("*").alias("n"))))
    tables, lower = [], None
    for k in range(1, ORDER + 1):
        t = by[k]
        few = {r.n: r["count"] for r in t.filter("n <= 4").groupBy("n").count().collect()}
        n1, n2, n3, n4 = (few.get(i, 0) or 1 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(i - (i + 1) * y * b / a, 0.05 * i), 0.95 * i) for i, (a, b) in enumerate([(n1, n2), (n2, n3), (n3, n4)], 1)]
        t = t.withColumn("d", F.expr(f"CASE n WHEN 1 THEN {d[0]}D WHEN 2 THEN {d[1]}D ELSE {d[2]}D END"))
        t = t.withColumn("context", F.shiftrightunsigned("code", 16) if k > 1 else F.lit(0).cast("long"))
        sums = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"), F.count("*").alias("kinds"))
        t = t.join(sums, "context")
        if k == 1:
            # the mass that order 1 leaves goes evenly to all characters and one that was never seen
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("cut") / F.col("total") / (F.col("kinds") + 1)
            t = t.select("code", p.alias("p"))
            tables.append(sums.select(F.lit(0).alias("order"), F.col("context").alias("code"), F.log(F.col("cut") / F.col("total") / (F.col("kinds") + 1)).alias("logp")))
        else:
            up = lower.select(F.col("code").alias("suffix"), F.col("p").alias("q"))
            t = t.withColumn("suffix", _suffix(k)).join(up, "suffix")
            t = t.select("code", ((F.col("n") - F.col("d")) / F.col("total") + F.col("cut") / F.col("total") * F.col("q")).alias("p"))
            backs = sums.select(F.lit(k - 1).alias("order"), F.col("context").alias("code"), F.log(F.col("cut") / F.col("total")).alias("back"))
            tables[-1] = tables[-1].join(backs, ["order", "code"], "full")  # contexts that only begin texts end no n-gram
        lower = held(bundled(t))
        tables.append(lower.select(F.lit(k).alias("order"), "code", F.log("p").alias("logp")))
    tables[0] = tables[0].withColumn("back", F.lit(0.0))
    out = [x if "back" in x.columns else x.withColumn("back", F.lit(None).cast("double")) for x in tables]
    out = [x.select("order", "code", "logp", "back") for x in out]
    for x in out[1:]:
        out[0] = out[0].union(x)
    return held(bundled(out[0]))


class Scorer:
    """Sums of log-probabilities by the model table in memory."""

    def __init__(self, rows):
        self.tables = {}
        for k in range(ORDER + 1):
            for what in ("logp", "back"):
                own = rows[(rows["order"] == k) & rows[what].notna()].sort_values("code")
                self.tables[what, k] = own["code"].to_numpy(np.int64), own[what].to_numpy(np.float64)

    def _find(self, what: str, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is in the table, and the values of those that are."""
        own, values = self.tables[what, k]
        if not len(own):
            return np.zeros(len(codes), bool), np.empty(0)
        at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        found = own[at] == codes
        return found, values[at[found]]

    def each(self, codes: np.ndarray) -> np.ndarray:
        """The log-probability of every distinct code's last character."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        unsigned = codes.view(np.uint64)
        for k in range(ORDER, -1, -1):
            own = (unsigned[open_] & np.uint64((1 << 16 * k) - 1)).view(np.int64)
            found, values = self._find("logp", k, own)
            out[open_[found]] += values
            open_ = open_[~found]
            if not len(open_):
                break
            if k > 1:  # the weight of lower orders after the context, if that was seen
                found, values = self._find("back", k - 1, (own[~found].view(np.uint64) >> np.uint64(16)).view(np.int64))
                out[open_[found]] += values
        return out


def perplexities(docs: DataFrame, table: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, lang, chars, nll (summed negative log-probability), words and fresh (see variety) of every document."""
    rows = texts(docs, F.col("lang").cast("string").alias("lang"))
    if table.count() <= model_rows:
        sent = table.toPandas()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(sent)
            for batch in batches:
                for first, parts in _portions(batch.column(1)):
                    sizes = [len(p) for p in parts]
                    code, at = np.unique(np.concatenate(parts), return_inverse=True)
                    owner = np.repeat(np.arange(len(parts)), sizes)
                    nll = -np.bincount(owner, scorer.each(code)[at], len(parts)) if len(code) else np.zeros(len(parts))
                    doc, text, lang = (batch.column(j).slice(first, len(parts)) for j in (0, 1, 2))
                    columns = [doc, lang, pa.array(sizes, pa.int64()), pa.array(nll), *_varieties(text)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "chars", "nll", "words", "fresh"])

        return rows.mapInArrow(run, "doc_id long, lang string, chars long, nll double, words long, fresh long")
    return _joined(rows, table)


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same by joins: each document's distinct n-grams meet the table, order by order, where the order above has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                code, n = np.unique(grams(batch.column(1)[i].as_py()), return_counts=True)
                row = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["row", "code", "n"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_varieties(batch.column(1))], [*batch.schema.names, "words", "fresh"])

    rows = rows.mapInArrow(told, "doc_id long, text string, lang string, words long, fresh long")
    keyed = rows.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256)))
    todo = keyed.select("row", "text").distinct().select("row", "text").mapInArrow(run, "row string, code long, n long").withColumn("sum", F.lit(0.0))
    done = None
    for k in range(ORDER, -1, -1):
        own = table.filter((F.col("order") == k) & F.col("logp").isNotNull()).select(F.col("code").alias("at"), "logp")
        todo = todo.withColumn("at", F.col("code").bitwiseAND(F.lit((1 << 16 * k) - 1 if k < 4 else -1).cast("long")))
        met = todo.join(own, "at", "left")
        hit = met.filter("logp IS NOT NULL").groupBy("row").agg(F.sum(F.expr("n * (sum + logp)")).alias("nll"))
        done = hit if done is None else done.union(hit)
        todo = met.filter("logp IS NULL").select("row", "code", "n", "sum", "at")
        if k > 1:
            backs = table.filter((F.col("order") == k - 1) & F.col("back").isNotNull()).select(F.col("code").alias("context"), "back")
            todo = todo.withColumn("context", F.shiftrightunsigned("at", 16)).join(backs, "context", "left").withColumn("sum", F.col("sum") + F.coalesce("back", F.lit(0.0)))
        todo = todo.select("row", "code", "n", "sum")
    sums = done.groupBy("row").agg((-F.sum("nll")).alias("nll"))
    # the characters that grams() counts: white space runs as one blank, none at the ends
    chars = F.length(F.btrim(F.regexp_replace("text", "[ \\t-\\r]+", " ")))
    return keyed.join(sums, "row", "left").select("doc_id", "lang", chars.cast("long").alias("chars"), F.coalesce("nll", F.lit(0.0)).alias("nll"), "words", "fresh")


def quality(docs: DataFrame, labels: DataFrame, fence: float = FENCE, short: int = SHORT, model_rows: int = MODEL_ROWS) -> DataFrame:
    """One row per document: doc_id, lang, chars, perplexity, threshold, variety, least_variety, kept. Trusted are the documents labelled quality 1."""
    trusted = held(bundled(labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()))
    table = model(trusted_counts(docs, trusted))
    scored = held(perplexities(docs, table, model_rows))
    known = scored.join(trusted.withColumn("ok", F.lit(True)), "doc_id", "left_semi")
    means = known.agg((F.sum("nll") / F.sum("chars")).alias("nll"), (F.sum("fresh") / F.sum("words")).alias("fresh")).first()
    if means.nll is None:
        none = [F.lit(None).cast("double").alias(x) for x in ("perplexity", "threshold", "variety", "least_variety")]
        return scored.select("doc_id", "lang", "chars", *none, F.lit(True).alias("kept"))
    level = (F.col("nll") + short * means.nll) / (F.col("chars") + short)
    spread = (F.col("fresh") + SHORT_WORDS * F.lit(means.fresh)) / (F.col("words") + SHORT_WORDS)  # no words at all: the mean, or null
    scored, known = (df.withColumns({"level": level, "spread": spread}) for df in (scored, known))
    quartiles = [F.percentile_approx(x, [0.25, 0.75], 10_000).alias(x) for x in ("level", "spread")]
    limit = F.expr(f"level[1] + greatest({fence}D * (level[1] - level[0]), {MARGIN}D)")
    least = F.expr(f"spread[0] - greatest({fence}D * (spread[1] - spread[0]), {MARGIN_WORDS}D)")
    by_lang = known.groupBy("lang").agg(*quartiles).select(F.col("lang").alias("l"), limit.alias("own"), least.alias("own_least"))
    over_all = known.agg(*quartiles).select(limit, least).first()
    # one row per language: a few hundred at most, but counted by Spark before it broadcasts
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    out = out.withColumns({"limit": F.coalesce("own", F.lit(over_all[0])), "least": F.coalesce("own_least", F.lit(over_all[1]))})
    fits = (F.col("level") <= F.col("limit")) & F.coalesce(F.col("spread") >= F.col("least"), F.lit(True))
    return out.select(
        "doc_id", "lang", "chars", F.exp("level").alias("perplexity"), F.exp("limit").alias("threshold"),
        F.col("spread").alias("variety"), F.col("least").alias("least_variety"), ((F.col("chars") == 0) | fits).alias("kept"),
    )


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. Rows with a null or repeated doc_id are judged each for itself."""

    def stage(rows: DataFrame) -> DataFrame:
        stay = quality(rows, labels).filter("kept").select(F.col("doc_id").alias(keep := f"keep_{uuid.uuid4().hex}"))
        return rows.join(stay, rows["doc_id"] == F.col(keep), "left_semi")

    return by_own_ids(docs, stage)
