"""One query per operator, each over its whole table with production parameters, and the SQL where SQL can say it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sitegrain.llm import byte_bpe, decontaminate, exact_dedup, licenses, minhash, mixing, phrases, pii, quality, secret_scan, token_files, toxicity, whitening
from sitegrain.llm.common import table
from sitegrain.llm.spans import listed


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds(base, kinds):
    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def op1_secrets(spark, sf):
    found = secret_scan.secrets(table(spark, sf, "documents"))
    base = F.col("base")
    return found.select("doc_id", *_kinds(base, ["assign", "access", "hex"]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, "linked")).alias("spans"))


def op2_token_files(spark, sf):
    path = token_files.write_tokens(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), 2)
    return token_files.read_tokens(spark, path, checksums=True)


def op3_personal_data(spark, sf):
    found = pii.personal_data(table(spark, sf, "documents"))
    base = F.col("base")
    return found.select("doc_id", *_kinds(base, ["email", "ip", "card", "phone"]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, "more")).alias("spans"))


def op4_quality(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_exact_dedup(spark, sf):
    return exact_dedup.groups(table(spark, sf, "documents"))


def op6_licences(spark, sf):
    """Documents are taken as files: each source is a directory tree of a thousand, then a hundred ids; texts at least half of which speak of licences are licence files."""
    docs = table(spark, sf, "documents")
    name = F.when(F.col("text").rlike(r"(?i)licen[sc]e|permission") & (licenses.licence_share(F.col("text")) >= 0.5), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000"), F.expr("doc_id div 100"), name)
    return licenses.licences(docs.select("doc_id", "text", path.alias("path")))


def op7_decontaminate(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def bpe_digests(docs):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again."""
    import public_tokenizers

    path = tokenizer("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)

    def digests(batches):
        decoded = byte_bpe.decoder(path)
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded(ids)).hexdigest()) for ids in byte_bpe.id_arrays(batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark, sf):
    return bpe_digests(table(spark, sf, "documents"))


def op9_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    weights = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    score = toxicity.scored(docs, weights)
    return score.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_minhash(spark, sf):
    return minhash.near_groups(table(spark, sf, "documents"), words=2, percent=80)


def op11_mixing(spark, sf):
    return mixing.taken(*mixing.mixed(table(spark, sf, "documents")))


def op12_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


def op13_whitening(spark, sf):
    rows = whitening.lattice(table(spark, sf, "embeddings"))
    model = whitening.fit(rows, 4)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    parts = whitening.whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(e) / model.trace if model.trace > 0 else 0.0) for e in model.values])
    return parts.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened", F.get(explained, "k").alias("explained"), F.lit(model.error).cast("double").alias("identity_error"),
    )


QUERIES = {f.__name__: f for f in (op1_secrets, op2_token_files, op3_personal_data, op4_quality, op5_exact_dedup, op6_licences, op7_decontaminate, op8_byte_bpe, op9_toxicity, op10_minhash, op11_mixing, op12_phrases, op13_whitening)}

ORACLE = {
    "op5_exact_dedup": """
        WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM rows WINDOW w AS (PARTITION BY norm)
    """,
}
