"""Secrets in texts: strong patterns, and weak parts of a credential that are reported only where they complete each other.

Strong (base) spans: assignments of secrets, access key ids, long hexadecimal strings. Weak parts: account identifiers,
short or loosely named secrets, and endpoints. A credential needs parts of several roles, so weak parts are linked by
an interval join: parts fall into bins of one window length within their document, each bin is reduced to the first and last start of
each role, and every weak part looks at its own bin and the two beside it. No pair of parts is ever made, however
many there are. A weak secret counts with an identifier or endpoint in reach, an identifier with any secret in reach, an endpoint
with both.

Defined cases: a null or empty text has no spans. Rows with a null or repeated doc_id are scanned each for itself (their
key is doc_id and text). An empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import held, texts
from sitegrain.llm.spans import matches, ranked

#: Code points between the starts of two parts of one credential.
WINDOW = 300

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

_TO = r"""["']?\x20{0,4}[:=]\x20{0,4}["']?"""
IDENTIFIER = rf"(?i)\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?){_TO}[A-Za-z0-9._@+-]{{3,}}+"
WEAK_SECRET = rf"(?i)\b(?:pass|passphrase|pwd|auth|credentials?|private_?key|secret_?key|password|passwd|secret|token|api_?key){_TO}[A-Za-z0-9+/_.=-]{{4,}}+"
ENDPOINT = rf"(?i)\b(?:[a-z][a-z0-9+.-]{{1,20}}://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]{{4,}}+|(?:host|server|endpoint){_TO}[A-Za-z0-9.-]{{4,}}+)"

#: Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "weak_secret", "endpoint"]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key, base spans and weak parts of each row, found inside the row."""
    text = F.col("text")
    has_setting = text.contains(":") | text.contains("=")
    base = F.concat(
        ranked(matches(text, ASSIGN, 2, has_setting, lambda m, part: F.length(part) >= 8), "assign", 0),
        ranked(matches(text, ACCESS, guard=text.contains("AKIA")), "access", 1),
        ranked(matches(text, HEX), "hex", 2),
    )
    weak = F.concat(
        ranked(matches(text, IDENTIFIER, guard=has_setting), "identifier", 3),
        ranked(matches(text, WEAK_SECRET, guard=has_setting), "weak_secret", 4),
        ranked(matches(text, ENDPOINT, guard=has_setting), "endpoint", 5),
    )
    return texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), base.alias("base"), weak.alias("weak"))


def linked(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key and the weak parts whose complements lie within the window, one row per (doc_id, key)."""
    role = F.expr("CASE kind WHEN 'access' THEN 'identifier' WHEN 'identifier' THEN 'identifier' WHEN 'endpoint' THEN 'endpoint' ELSE 'secret' END")
    parts = (
        rows.filter(F.size("weak") > 0)
        .select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("p"))
        .select("doc_id", "key", "p.*")
        .withColumns({"role": role, "bin": F.expr(f"start div {window}")})
        .distinct()
    )
    bins = parts.groupBy("doc_id", "key", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    bins = bins.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("bin").alias("b"), F.col("role").alias("other"), "first", "last")
    weak = parts.filter("rank >= 3").withColumn("look", F.explode(F.expr("array(bin - 1, bin, bin + 1)")))
    near = F.expr("(look = bin) OR (look < bin AND start - last <= %d) OR (look > bin AND first - start <= %d)" % (window, window))
    met = (
        weak.join(bins, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("look") == F.col("b")))
        .filter(near)
        .groupBy("doc_id", "key", "start", "end", "rank", "kind")
        .agg(*[F.max(F.col("other") == r).alias(r) for r in ("identifier", "secret", "endpoint")])
        .filter("(kind = 'weak_secret' AND (identifier OR endpoint)) OR (kind = 'identifier' AND secret) OR (kind = 'endpoint' AND identifier AND secret)")
    )
    return met.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "rank", "kind")).alias("linked"))


def secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, base (spans of the strong patterns) and linked (weak parts that complete a credential), one row per document."""
    rows = held(scanned(docs))
    more = linked(rows, window).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "linked")
    none = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,kind:string>>")
    out = rows.join(more, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", "base", F.coalesce("linked", none).alias("linked"))
