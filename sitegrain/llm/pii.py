"""Personal data in texts: validated base spans, and further candidates chosen by boosted trees.

High-recall generators propose spans that look like addresses, dotted numbers or digit groups. Each candidate has a
cell: a small code of its format (digits, groups, separators, part sizes) and context (cue words before it, what follows).
Candidates that overlap a validated span count as examples of personal data, the rest as counter-examples; what the
validation itself decides by (the leading plus, the check digit) is no feature, so that the trees find the same formats where
validation missed them. Training rows are the counts of the cells over all documents: at most CELLS rows, however large the input. Gradient-boosted trees
are fitted on four fifths of the documents, their scores are calibrated (isotonic) on the held-out fifth, and cells whose calibrated
probability reaches the threshold select their candidates for redaction. All row work is column expressions.

Defined cases: a null or empty text has no spans. Rows with a null or repeated doc_id are scanned each for itself. Where
the candidates are all of one class nothing is added. An empty table gives an empty result. Columns other than
doc_id and text play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import held, texts
from sitegrain.llm.spans import matches, ranked

#: The base patterns, written so that no match costs more than linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){13}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of candidates, by family.
GENERATORS = [
    r"[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){0,8}",
    r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3,7}+",
    r"(?<![0-9])\(?[0-9]{1,19}+(?:[\x20.()-]{1,2}[0-9]{1,19}+){0,8}",
]
FAMILIES = ["likely_email", "likely_ip", "likely_number"]
CUES = ["tel|phone|call|fax|mobile|handy|móvil", "mail|contact|write|@", "ip|host|server|addr", "card|account|iban|visa|konto|carte"]
#: Features of a cell and their sizes.
FEATURES = {"family": 3, "digits": 6, "groups": 6, "separator": 5, "cue": 5, "follows": 3, "range": 2}
CELLS = reduce(lambda a, b: a * b, FEATURES.values())
THRESHOLD = 0.9
_CONTEXT = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit is doubled and its digits summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return F.concat(
        ranked(matches(text, EMAIL, guard=text.contains("@")), "email", 0),
        ranked(matches(text, IP, keep=lambda m, _: m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")), "ip", 1),
        ranked(matches(text, CARD, keep=lambda m, _: F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False)), "card", 2),
        ranked(matches(text, PHONE, guard=text.contains("+"), keep=lambda m, _: F.length(_digits(m)).between(10, 15)), "phone", 3),
    )


def _binned(value: Column, *edges: int) -> Column:
    """How many of the edges the value reaches."""
    return reduce(lambda a, e: a + (value >= e).cast("int"), edges, F.lit(0))


def _cell(text: Column, m: Column, family: int) -> Column:
    digits = F.length(_digits(m["text"]))
    groups = F.size(F.split(m["text"], "[^0-9]+"))
    before = F.lower(F.substring(text, F.greatest(m["start"] - _CONTEXT, F.lit(0)).cast("int") + 1, F.least(m["start"], F.lit(_CONTEXT)).cast("int")))
    after = F.substring(text, m["end"].cast("int") + 1, F.lit(1))
    separator = F.when(m["text"].rlike(r"[()]"), 4).when(m["text"].contains("-"), 3).when(m["text"].contains("."), 2).when(m["text"].contains(" "), 1).otherwise(0)
    cue = reduce(lambda acc, i: F.when(before.rlike(CUES[i]), i + 1).otherwise(acc), range(len(CUES) - 1, -1, -1), F.lit(0))
    values = {
        "family": F.lit(family),
        "digits": _binned(digits, 7, 10, 12, 14, 17),
        "groups": _binned(groups, 2, 3, 4, 5, 6),
        "separator": separator,
        "cue": cue,
        "follows": F.when(after == "", 0).when(after.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1),
        "range": F.exists(F.split(m["text"], "[^0-9]+"), lambda p: F.length(p) > 3).cast("int"),
    }
    return reduce(lambda code, f: code * FEATURES[f] + values[f], FEATURES, F.lit(0))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, family, cell, hit>> of all generators; hit: it overlaps a base span."""

    def own(family: int) -> Column:
        guard = text.rlike("@|[\\[(](at|AT)[\\])]") if family == 0 else text.rlike("[0-9]")
        keep = (lambda m, _: F.length(_digits(m)).between(7, 19)) if family == 2 else None
        found = matches(text, GENERATORS[family], guard=guard, keep=keep)
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.lit(family).alias("family"),
                _cell(text, m, family).alias("cell"),
                F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])).alias("hit"),
            ),
        )

    return F.concat(*[own(k) for k in range(len(GENERATORS))])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of each row."""
    rows = texts(docs).withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("candidates"))


def selected_cells(rows: DataFrame, threshold: float = THRESHOLD) -> list[int]:
    """The cells whose candidates are redacted: boosted trees, calibrated on held-out documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    seen = rows.select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"), F.explode("candidates").alias("c"))
    counts = seen.groupBy("held_out", F.col("c.cell").alias("cell"), F.col("c.hit").cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight"))
    codes, div = {}, 1
    for name in reversed(FEATURES):
        codes[name] = F.expr(f"CAST((cell div {div}) % {FEATURES[name]} AS double)")
        div *= FEATURES[name]
    # at most two labels and two folds of each cell: one small partition
    cells = held(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counts.withColumns(codes)).select("held_out", "cell", "label", "weight", "features").coalesce(1))
    train, test = cells.filter("NOT held_out"), cells.filter("held_out")
    if train.select("label").distinct().count() < 2 or not test.count():
        return []
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=16, seed=7).fit(train)
    scored = held(trees.transform(cells).withColumn("score", vector_to_array("probability")[1]).select("held_out", "cell", "label", "weight", "score").coalesce(1))
    curve = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(scored.filter("held_out"))
    chosen = curve.transform(scored).filter(F.col("calibrated") >= threshold).select("cell").distinct()
    return sorted(r.cell for r in chosen.collect())


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base (validated spans) and more (candidates the trees select that overlap no base span)."""
    rows = held(scanned(docs))
    cells = selected_cells(rows, threshold)
    chosen = F.array(*map(F.lit, cells)).cast("array<int>")
    kind = F.array(*map(F.lit, FAMILIES))
    picked = F.filter("candidates", lambda c: ~c["hit"] & F.array_contains(chosen, c["cell"]))
    more = F.transform(picked, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), (c["family"] + 4).alias("rank"), F.get(kind, c["family"]).alias("kind")))
    return rows.select("doc_id", "base", more.alias("more"))


def redacted(docs: DataFrame, threshold: float = THRESHOLD, mark: str = "█") -> DataFrame:
    """doc_id and text with every span's characters replaced by the mark. doc_id must be unique."""
    found = personal_data(docs, threshold).select("doc_id", F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"], s["end"]))).alias("spans"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], acc["at"]), F.greatest(s["end"], acc["at"])
        kept = F.substring(F.col("text"), acc["at"].cast("int") + 1, (start - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], kept, F.repeat(F.lit(mark), (end - start).cast("int"))).alias("out"), end.alias("at"))

    done = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    return texts(docs).join(found, "doc_id").select("doc_id", done.alias("text"))
